"""Language identification, word first.

A known word scores by its log frequency in each language; an unseen word falls back to the longest
order of character n-grams of which any is known, then to shorter ones. A text's language is the
one with the largest sum. The model is fitted on a bounded sample of labelled rows and so has a
bounded size (see ``Bounds``); all its languages, words and n-grams count. Scoring runs over every
whole text, in Arrow batches.

Defined results: null text or no letters gives ``und`` with score 0; without any labelled row every
text is ``und``; ties go to the language that more training rows have, then to the smaller name;
repeated rows give repeated rows; texts of any length are read whole; empty tables give empty results;
other columns are ignored, whatever their names.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from edgeloom.storage import materialise

_LETTERS = re.compile(r"[^\W\d_]+")


@dataclass(frozen=True)
class Bounds:
    """The sample: labelled rows of a language, and of all languages together; the longest n-grams."""

    documents: int = 2000
    rows: int = 100_000
    order: int = 5
    cache: int = 300_000


class Model:
    def __init__(self, counts: dict[str, list[tuple[str, int]]], rows: dict[str, int], bounds: Bounds):
        self.bounds = bounds
        self.languages = sorted(counts, key=lambda k: (-rows.get(k, 0), k))
        self.words = self._logs({k: dict(v) for k, v in counts.items()})
        self.grams: dict[int, dict[str, list[float]]] = {}
        for n in range(bounds.order, 0, -1):
            grams = {}
            for k, v in counts.items():
                c: Counter = Counter()
                for w, x in v:
                    for g in self.pieces(w, n):
                        c[g] += x
                grams[k] = dict(c)
            self.grams[n] = self._logs(grams)

    @staticmethod
    def pieces(word: str, n: int) -> list[str]:
        w = f"^{word}$" if n > 1 else word
        return [w[i : i + n] for i in range(len(w) - n + 1)]

    def _logs(self, counts: dict[str, dict[str, int]]) -> dict[str, list[float]]:
        names = set().union(*counts.values()) if counts else set()
        out = {w: [0.0] * len(self.languages) for w in names}
        for j, k in enumerate(self.languages):
            total = sum(counts[k].values()) + 0.5 * (len(names) + 1)
            for w in names:
                out[w][j] = math.log((counts[k].get(w, 0) + 0.5) / total)
        return out

    def vector(self, word: str) -> list[float] | None:
        """Log frequency in each language; None if nothing of the word is known."""
        if word in self.words:
            return self.words[word]
        for n in range(self.bounds.order, 0, -1):
            known = [v for g in self.pieces(word, n) if (v := self.grams[n].get(g))]
            if known:
                return [sum(x) / len(known) for x in zip(*known)]
        return None

    def predictor(self):
        """A function of a text to (language, score), with a bounded cache of words."""
        cache: dict[str, int] = {}
        none = np.zeros(len(self.languages))
        rows: list[np.ndarray] = []

        def predict(text: str | None) -> tuple[str, float]:
            found = Counter(w for w in _LETTERS.findall(text.lower())) if text else Counter()
            if not self.languages or not any(c.isalpha() for w in found for c in w):
                return "und", 0.0
            if len(cache) > self.bounds.cache:
                cache.clear()
                rows.clear()
            at = []
            for w in found:
                i = cache.get(w)
                if i is None:
                    v = self.vector(w)
                    i = cache[w] = len(rows)
                    rows.append(none if v is None else np.array(v))
                at.append(i)
            total = np.array(list(found.values()), dtype=float) @ np.array([rows[i] for i in at])
            best = int(np.argmax(total))
            tempered = np.exp((total - total[best]) / math.sqrt(sum(found.values())))
            return self.languages[best], float(1.0 / tempered.sum())

        return predict


def fit(labelled: DataFrame, bounds: Bounds = Bounds()) -> Model:
    """Fit on (text, lang) rows with neither null; ``key`` decides which rows the sample takes."""
    rows = labelled.where("text is not null and lang is not null").select("key", "text", "lang")
    per = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "lang").collect()}
    if not per:
        return Model({}, {}, bounds)
    each = max(1, min(bounds.documents, bounds.rows // len(per)))
    part = F.create_map(*[x for k, n in per.items() for x in (F.lit(k), F.lit(int(min(1.0, each / n) * 1_000_000)))])
    sample = rows.where(F.pmod(F.xxhash64("key", F.lit("language sample")), F.lit(1_000_000)) < F.coalesce(F.try_element_at(part, F.col("lang")), F.lit(0)))
    said = sample.select("lang", F.explode(F.regexp_extract_all(F.lower("text"), F.lit(r"\p{L}+"), F.lit(0))).alias("word"))
    counts = materialise(said.groupBy("lang", "word").agg(F.count(F.lit(1)).alias("n")), "language-words")
    top: dict[str, list[tuple[str, int]]] = defaultdict(list)
    # As many words as the sample has, at most.
    for r in counts.orderBy("lang", "word").collect():
        top[r["lang"]].append((r["word"], r["n"]))
    return Model({k: top[k] for k in per}, per, bounds)


def predict(documents: DataFrame, model: Model, keep: list[Column]) -> DataFrame:
    """``keep`` columns of every row, with lang_pred and score of its ``text``."""
    spark = documents.sparkSession
    shared = spark.sparkContext.broadcast(model)
    rows = documents.select(*keep, F.col("text").alias("__text"))
    schema = rows.drop("__text").schema.add("lang_pred", "string").add("score", "double")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        say = shared.value.predictor()
        for b in batches:
            got = [say(t) for t in b.pop("__text")]
            b["lang_pred"], b["score"] = [x for x, _ in got], [y for _, y in got]
            yield b

    return rows.mapInPandas(run, schema)
