"""The benchmark builder: fit a graph, get its training edges and labelled target pairs."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from edgeloom import schema
from edgeloom.operators.graph import canonical_edges, symmetric
from edgeloom.operators.sampling import all_negatives, both_directions, negatives, sbm_sample, stubs
from edgeloom.operators.split import held_out, mixed
from edgeloom.storage import materialise


def as_edges(spark: SparkSession, graph) -> DataFrame:
    """An edge table from a DataFrame, pairs of ids, or a square array (of weights or 0/1)."""
    if isinstance(graph, DataFrame):
        return canonical_edges(graph)
    if hasattr(graph, "nonzero") and hasattr(graph, "shape"):
        rows = list(zip(*(x.tolist() for x in graph.nonzero())))
    else:
        rows = [(int(a), int(b)) for a, b in graph]
    return canonical_edges(spark.createDataFrame(rows, schema.EDGES))


@dataclass
class TrainTestEdgeSplitter:
    fraction: float = 0.25
    seed: int = 0
    tolerant: bool = False

    def fit(self, edges: DataFrame) -> TrainTestEdgeSplitter:
        self.test_edges_, self.train_edges_ = held_out(edges, self.fraction, self.seed, self.tolerant)
        return self

    def transform(self) -> tuple[DataFrame, DataFrame]:
        return self.train_edges_, self.test_edges_


@dataclass
class NegativeEdgeSampler:
    """Pairs without an edge, ends drawn by degree or uniformly.

    ``allow_duplicated_negatives`` fills up with repeats where the graph is too dense.
    """

    degree_correction: bool = True
    allow_duplicated_negatives: bool = False
    seed: int = 0

    def fit(self, edges: DataFrame) -> NegativeEdgeSampler:
        self.edges_ = materialise(edges, "sampler-edges")
        self.population_ = materialise(stubs(symmetric(self.edges_), self.degree_correction), "sampler-stubs")
        return self

    def sampling(self, size: int, test_edges: DataFrame | None = None, nth: int = 0) -> DataFrame:
        banned = self.edges_ if test_edges is None else self.edges_.union(test_edges.select("src", "trg"))
        got = negatives(self.population_, banned, size, self.seed + 1000 * nth, pad=True)
        return got.select("src", "trg")


@dataclass
class LinkPredictionDataset:
    """``fit(graph)`` then ``transform()``: (train edges, target table src, trg, isPositiveEdge).

    ``exclude``: which edges no negative may be - train, train_test or full. ``negative_edge_sampler``:
    uniform, degreeBiased, sbm, or a function (train edges, size, nth) -> DataFrame(src, trg); it
    overrides ``degree_correction``. ``all_negatives`` takes every non-edge. Rows come in hash order.
    """

    test_edge_fraction: float = 0.25
    degree_correction: bool = True
    negatives_per_positive: int = 1
    allow_duplicated_negatives: bool = False
    negative_edge_sampler: object = None
    all_negatives: bool = False
    exclude: str = "train_test"
    membership: DataFrame | None = None
    seed: int = 0
    bidirectional: bool = False

    def fit(self, graph, spark: SparkSession | None = None) -> LinkPredictionDataset:
        spark = spark or (graph.sparkSession if isinstance(graph, DataFrame) else SparkSession.getActiveSession())
        self.edges_ = materialise(as_edges(spark, graph), "dataset-edges")
        self.splitter_ = TrainTestEdgeSplitter(self.test_edge_fraction, self.seed).fit(self.edges_)
        biased = self.degree_correction if self.negative_edge_sampler is None else self.negative_edge_sampler == "degreeBiased"
        base = self.edges_ if self.exclude == "full" else self.splitter_.train_edges_
        self.sampler_ = NegativeEdgeSampler(biased, self.allow_duplicated_negatives, self.seed).fit(base)
        return self

    def get_positive_edges(self) -> DataFrame:
        return self.splitter_.test_edges_

    def get_negative_edges(self) -> DataFrame:
        if self.all_negatives:
            nodes = symmetric(self.edges_).select(F.col("u").alias("id")).distinct()
            return all_negatives(self.edges_, nodes)
        size = self.splitter_.test_edges_.count()
        test = self.splitter_.test_edges_ if self.exclude != "train" else None
        out = None
        for nth in range(self.negatives_per_positive):  # distinct within a round only
            if callable(self.negative_edge_sampler):
                got = self.negative_edge_sampler(self.splitter_.train_edges_, size, nth)
            elif self.negative_edge_sampler == "sbm":
                pairs = sbm_sample(symmetric(self.splitter_.train_edges_), self.membership, 4 * size, seed=self.seed + nth)
                got = canonical_edges(pairs.where("src <> trg").select("src", "trg")).join(self.edges_, ["src", "trg"], "left_anti")
                got = got.orderBy(mixed(self.seed + nth), "src", "trg").limit(size)
            else:
                got = self.sampler_.sampling(size, test, nth)
            out = got if out is None else out.unionAll(got)
        return out

    def transform(self) -> tuple[DataFrame, DataFrame]:
        pos = self.get_positive_edges().withColumn("isPositiveEdge", F.lit(1))
        target = pos.unionByName(self.get_negative_edges().withColumn("isPositiveEdge", F.lit(0)))
        target = both_directions(target) if self.bidirectional else target
        return self.splitter_.train_edges_, target

    def fit_transform(self, graph, spark: SparkSession | None = None) -> tuple[DataFrame, DataFrame]:
        return self.fit(graph, spark).transform()


def edges_of(pairs: Iterable[tuple[int, int]], spark: SparkSession) -> DataFrame:
    return as_edges(spark, pairs)
