"""What queries leave in the shared folder: the tables that others read, and nothing that these were made from."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

from edgeloom import storage

SHARED = {"edges", "test", "train", "train-sym", "train-degrees", "negatives-uniform", "negatives-biased", "target"}


@pytest.fixture
def folder(tmp_path, monkeypatch):
    shared = tmp_path / "shared"
    shared.mkdir()
    monkeypatch.setattr(storage, "scratch_root", lambda _: str(shared))
    return shared


def left(folder):
    return Counter(p.name.rpartition("-")[0] for p in folder.iterdir())


def test_settled_deletes_what_it_was_made_from(spark, folder):
    kept = storage.materialise(spark.range(3), "kept")

    def inner():
        return storage.materialise(kept.select((F.col("id") + 1).alias("id")), "inside")

    out = storage.settled(lambda: storage.settled(inner, "part").union(storage.materialise(kept, "again")), "out")
    assert left(folder) == {"kept": 1, "out": 1}
    assert sorted(r["id"] for r in out.collect()) == [0, 1, 1, 2, 2, 3]


@pytest.mark.parametrize("name", ["pivot_ranks", "auc_by_model_sampler", "rank_models", "rank_change", "topk_lpi", "topk_lrw"])
def test_only_shared_tables_stay(spark, folder, tmp_path, name):
    import __spark_entry__

    # Another path: nothing made for other tests is used.
    (tmp_path / "sf0.001").symlink_to("/root/testdata/sf0.001")
    assert __spark_entry__.queries()[name](spark, str(tmp_path / "sf0.001")).count()
    assert all(n == 1 for n in left(folder).values()) and set(left(folder)) <= SHARED


def shuffles(spark):
    """The shuffle files that Spark holds on disk."""
    files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    found = (files.apply(i) for i in range(files.size()))
    return {f.getName(): f.length() for f in found if f.getName().startswith("shuffle_")}


def test_written_tables_leave_no_shuffle_files(spark, folder):
    import time

    before = shuffles(spark)
    out = storage.materialise(spark.range(1000).groupBy((F.col("id") % 7).alias("u")).count(), "counts")
    until = time.time() + 5
    while shuffles(spark).keys() - before.keys() and time.time() < until:
        time.sleep(0.1)
    assert not shuffles(spark).keys() - before.keys()
    assert out.count() == 7
    assert spark.conf.get(storage._CLEANUP, "false") == "false"
