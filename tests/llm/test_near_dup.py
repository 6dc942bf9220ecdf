"""Near-duplicates against brute force over all pairs, where groups are large, nested, or odd."""

import random

import pytest
from pyspark.sql import functions as F

from edgeloom.llm import near_dup


def sets_of(text, k):
    w = (text or "").translate({c: c + 32 for c in range(65, 91)}).split()
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


def brute(rows, k, percent):
    """{doc_id: component} by comparing all pairs; rows of one doc_id are one document."""
    root = {d: d for d, _ in rows if d is not None}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    sets = [(d, sets_of(t, k)) for d, t in rows if d is not None]
    for i, (a, s) in enumerate(sets):
        for b, t in sets[:i]:
            if s and t:
                both = len(s & t)
                if 100 * both >= percent * (len(s) + len(t) - both):
                    x, y = sorted((find(a), find(b)))
                    root[y] = x
    return {d: find(d) for d in root}


def edited(rng, base, n, new):
    w = list(base)
    for _ in range(n):
        i = rng.randrange(len(w))
        if rng.random() < 0.25:
            del w[i]
        elif rng.random() < 0.2:
            w.insert(i, rng.choice(new))
        else:
            w[i] = rng.choice(new)
    return w


@pytest.fixture(scope="module")
def rows():
    """Near copies that are unlike each other, passages that many share, cuts, and chains."""
    rng = random.Random(5)
    words = [f"w{i}" for i in range(4000)]
    out = []
    base = [rng.choice(words) for _ in range(120)]
    out += [" ".join(edited(rng, base, rng.randint(0, 11), words)) for _ in range(160)]
    passage = [rng.choice(words) for _ in range(70)]
    out += [" ".join(passage + [rng.choice(words) for _ in range(rng.randint(10, 40))]) for _ in range(90)]
    out += [" ".join(base[rng.randint(0, 20) : rng.randint(85, 120)]) for _ in range(40)]
    chain = [rng.choice(words) for _ in range(100)]
    for _ in range(30):
        out.append(" ".join(chain))
        chain = edited(rng, chain, 2, words)
    out += [" ".join(rng.choice(words) for _ in range(rng.randint(1, 60))) for _ in range(30)]
    rng.shuffle(out)
    return list(enumerate(out))


@pytest.mark.parametrize("k,percent,few,most", [(4, 80, 2, 8), (3, 60, 8, 256)])
def test_whole_groups(spark, rows, k, percent, few, most):
    got = near_dup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), k=k, percent=percent, few=few, most=most).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == brute(rows, k, percent)
    assert all(r["kept"] == (r["component_id"] == r["doc_id"]) for r in got)
    assert {r["doc_id"]: r["n_shingles"] for r in got} == {d: len(sets_of(t, k)) for d, t in rows}


def test_split_leaves_few_pairs(spark):
    """Near copies in one cluster meet by what differs from the core: all links, few other pairs."""
    rng = random.Random(6)
    words = [f"w{i}" for i in range(4000)]
    base = [rng.choice(words) for _ in range(120)]
    rows = [(i, " ".join(edited(rng, base, rng.randint(0, 11), words))) for i in range(250)]
    docs = spark.createDataFrame(rows, "cid long, text string")
    members = docs.select(F.lit(0).cast("long").alias("cluster"), "cid", F.col("cid").alias("comp"), F.lit(len(rows)).cast("long").alias("many"))
    links, split = near_dup._split(near_dup._differences(members, docs, 4, 80), 80)
    sets = {d: sets_of(t, 4) for d, t in rows}
    alike = {(a, b) for a in sets for b in sets if a < b and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])}
    sure = {tuple(sorted((r["a"], r["b"]))) for r in links.collect()}
    assert sure and sure <= alike
    pairs = {tuple(sorted((r["a"], r["b"]))) for r in near_dup._split_pairs(split, 80).collect()}
    hubs = {x for p in sure for x in p}
    assert {p for p in alike if not (p[0] in hubs and p[1] in hubs)} <= pairs
    assert len(pairs) < len(rows) * (len(rows) - 1) / 2 / 10


def test_one_document_with_two_texts(spark):
    """Document 7 has the texts b and c: 9 is near b and 11 near c, so 1 (b), 7, 9 and 11 are one component."""
    b, c = [f"b{i}" for i in range(60)], [f"c{i}" for i in range(60)]
    rows = [(1, b), (7, b), (7, c), (9, b[:-1] + ["x"]), (11, c[:-1] + ["y"]), (12, ["z"] * 3), (12, ["z"] * 3)]
    rows = [(d, " ".join(t)) for d, t in rows] + [(None, " ".join(b)), (None, " ".join(b)), (None, None), (13, None), (14, " \n")]
    docs = spark.createDataFrame([(d, t, i, i) for i, (d, t) in enumerate(rows)], "doc_id long, text string, comp int, __id int")
    got = near_dup.near_duplicates(docs, k=4).collect()
    assert {(r["doc_id"], r["component_id"]) for r in got} == {(1, 1), (7, 1), (9, 1), (11, 1), (12, 12), (13, 13), (14, 14), (None, None)}
    assert len(got) == len(rows)
    kept = near_dup.keep_one(docs, k=4)
    assert kept.columns == docs.columns
    assert sorted((-1 if r["doc_id"] is None else r["doc_id"], r["text"] or "") for r in kept.collect()) == sorted([(1, " ".join(b)), (12, "z z z"), (13, ""), (14, " \n"), (-1, " ".join(b)), (-1, "")])


def test_empty(spark, empty):
    assert near_dup.near_duplicates(empty).count() == 0 and near_dup.keep_one(empty).count() == 0
