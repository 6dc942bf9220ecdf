"""Work on edges with a number a node in the tasks: the joins' results, and no edges written or shuffled on the way."""

import pytest
from pyspark.sql import functions as F

from edgeloom import storage
from edgeloom.operators import around, folds, graph, sampling, split
from edgeloom.plans import base, registry
from tests.test_settled import folder, left  # noqa: F401


@pytest.fixture(scope="module")
def edges(spark):
    # Several components, one of them a long path; negative and large ids.
    near = [(i * 7 % 60, (i * i * 3 + i // 60 * 11 + 3) % 60) for i in range(400)] + [(i, i + 1) for i in range(100, 105)] + [(-5, 1 << 40), (7, 7), (500, 500)]
    return storage.materialise(graph.canonical_edges(spark.createDataFrame(near, "a long, b long")), "fold-edges")


def rows(df):
    return sorted(map(tuple, df.select("src", "trg").collect()))


@pytest.mark.parametrize("block", [7, 2_000_000])
def test_forest_and_split_are_those_of_joins(edges, monkeypatch, block):
    monkeypatch.setattr(around, "BLOCK", block)
    made = lambda: (rows(graph.spanning_forest(edges)), [rows(split.test_of(edges, 0.25, s)) for s in (0, 5)], rows(split.test_of(edges, 0.99, tolerant=True)))
    with monkeypatch.context() as m:
        m.setattr(graph, "bfs_levels", None)
        got = made()
    monkeypatch.setattr(around, "MAX_ENDS", 0)
    assert folds.forest(edges) is None
    assert got == made()


@pytest.mark.parametrize("n", [0, 1, 37, 50, 99, 100, 101])
def test_cut(spark, n):
    df = spark.range(100).select((F.col("id") % 10 * 1_000_003 - (1 << 33)).alias("h"))
    keys = sorted(r["h"] for r in df.collect())
    cut = folds.smallest(df, "h", n)
    if n >= 100:
        assert cut is None
    else:
        assert cut == (keys[n], n // 10 * 10, 10)


def test_split_shuffles_and_writes_no_edges(spark, edges, folder, monkeypatch):  # noqa: F811
    tags = []
    real = storage.Table.__init__
    monkeypatch.setattr(storage.Table, "__init__", lambda self, df, tag, *a: (tags.append((tag, df.count())), real(self, df, tag, *a))[1])
    n = edges.count()
    assert split.test_of(edges, 0.25).count() == n // 4
    assert sum(k for _, k in tags) < n / 2, tags


def test_copurchases_are_shuffled_once(spark, tmp_path):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        df = base._copurchase(spark, "/root/testdata/sf0.001", "l_returnflag = 'R'")
        df.collect()
        assert "ReusedExchange" in df._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_both_directions_are_not_written(spark, folder, tmp_path):  # noqa: F811
    (tmp_path / "sf0.001").symlink_to("/root/testdata/sf0.001")
    sym = base.train_sym(spark, str(tmp_path / "sf0.001"))
    assert storage.materialise(sym, "again") is sym
    assert set(left(folder)) == {"edges", "test", "train"}


@pytest.mark.parametrize("biased", [False, True])
def test_draws_are_looked_up(spark, edges, biased):
    sym = graph.symmetric(edges)
    listed, ends = storage.materialise(sampling.stubs(sym, biased), "stubs"), sampling.ends(sym, biased)
    assert sorted(map(tuple, ends.table().collect())) == sorted(map(tuple, listed.collect()))
    assert "Join" not in sampling.draw_pairs(ends, 50)._jdf.queryExecution().executedPlan().toString()
    # The last one draws more pairs than there are.
    for size in (1, 60, 900):
        one, two = (sorted(map(tuple, sampling.negatives(p, edges, size, 3).collect())) for p in (listed, ends))
        assert one == two and len(one) == size


def test_target_is_no_table(spark, folder, tmp_path):  # noqa: F811
    (tmp_path / "sf0.001").symlink_to("/root/testdata/sf0.001")
    rows = base.target(spark, str(tmp_path / "sf0.001"))
    assert rows.count() == 4 * base.test_edges(spark, str(tmp_path / "sf0.001")).count()
    assert set(left(folder)) == {"edges", "test", "train", "negatives-uniform", "negatives-biased"}


def test_ranks_are_made_without_lists_of_ends(spark, folder, tmp_path, monkeypatch):  # noqa: F811
    (tmp_path / "sf0.001").symlink_to("/root/testdata/sf0.001")
    tags = set()
    real = storage.Table.__init__
    monkeypatch.setattr(storage.Table, "__init__", lambda self, df, tag, *a: (tags.add(tag), real(self, df, tag, *a))[1])
    assert registry.queries()["rank_models"](spark, str(tmp_path / "sf0.001")).count() == 20
    assert not tags & {"stubs", "target", "train-sym", "bfs", "star", "split-rest"}, tags
