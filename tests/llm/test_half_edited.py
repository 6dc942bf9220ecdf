"""A text that keeps half of itself is seen by its fingerprint."""

import random

from edgeloom.llm import fingerprint


def test_few_half_edited_texts_are_missed(spark):
    r = random.Random(3)
    texts = [(i, " ".join(f"w{r.randrange(5000)}" for _ in range(80))) for i in range(400)]
    got = fingerprint.compare(spark.createDataFrame(texts, "doc_id long, text string"), blocks=4).collect()
    assert len(got) == 400 and sum(x["near_edited"] == 0 for x in got) <= 4
    assert sum(x["near_next"] > 0 for x in got) <= 4
