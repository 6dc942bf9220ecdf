import pytest


@pytest.fixture(scope="session")
def docs(spark):
    """A small table with every awkward case: nulls, empties, copies, ties, repeated rows, odd columns."""
    long = " ".join(f"alpha{i} beta{i % 7} gamma{i % 13}" for i in range(3000))
    base = " ".join(f"word{i}" for i in range(60))
    near = base.replace("word59", "other59")
    line = "a common line that every site has"
    rows = [(0, None, "en", "s0"), (1, "", "en", "s1"), (2, "   \n\t ", None, None), (3, long, "en", "s0"), (4, base, "en", "s1"), (5, base, "en", "s2"), (6, near, "fr", "s3"), (7, "one", "fr", None), (8, "two words", "fr", "s4")]
    rows += [(10 + i, f"{line}\nunique text number {i} of site\nx", "de", f"s{i % 12}") for i in range(24)]
    rows += [(40, "repeated row", "en", "s1"), (40, "repeated row", "en", "s1"), (None, "a row without an id", "en", "s1")]
    return spark.createDataFrame([(*r, i, "kept") for i, r in enumerate(rows)], "doc_id long, text string, lang string, source string, size long, line string")


@pytest.fixture(scope="session")
def empty(docs):
    return docs.where("1 = 0")
