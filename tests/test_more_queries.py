"""Helpers of file names and grids, and calibration, on small input."""

from edgeloom.operators.features import calibrated
from edgeloom.sources import io


def test_templates_and_names():
    assert io.expand("{a}-{b}-{c}", a=[1, 2], b="x") == ["1-x-{c}", "2-x-{c}"]
    assert io.expand("{a}", a=[1, 1]) == ["1"]
    assert io.make_filename("score", "csv", ["dim", "model"]) == "score_dim~{dim}_model~{model}.csv"
    assert io.constrain_by(["a.b", "c"]) == r"(a\.b|c)"
    assert io.list_networks(["net_b.csv", "net_a.npz", "net_a.csv", "other.csv"]) == ["a", "b"]


def test_files_with_parameters(spark, tmp_path):
    from edgeloom import schema

    (tmp_path / "edges_dim~64_model~ra.csv").write_text("src,trg\n1,2\n")
    (tmp_path / "edges_dim~8.csv").write_text("src,trg\n3,4\n")
    rows = io.read_with_params(spark, str(tmp_path / "*.csv"), schema.EDGES, ["dim", "model"]).select("src", "trg", "dim", "model")
    assert sorted(map(tuple, rows.collect())) == [(1, 2, "64", "ra"), (3, 4, "8", None)]


def test_calibration_is_a_probability_in_the_scores_order(spark):
    valid = spark.createDataFrame([(int(x >= 3) if x != 5 else 0, float(x)) for x in range(10)], "y int, score double")
    rows = spark.createDataFrame([(i, float(i)) for i in range(-5, 15)], "id int, score double")
    got = [r["score"] for r in calibrated(valid, rows).orderBy("id").collect()]
    assert all(0 <= x <= 1 for x in got) and got == sorted(got)
    # The fit's probabilities sum to the number of ones on the rows it was fitted on.
    assert abs(sum(got[5:15]) - valid.where("y = 1").count()) < 1e-3
