"""Toxicity by weak supervision.

1. Mine candidate signs from a bounded sample of labelled rows: words, and word beginnings (patterns),
   that are more frequent in texts labelled toxic.
2. The precise ones, a fixed lexicon and patterns of style are voters. A generative label model
   estimates by expectation maximisation how often each voter fires on either class (its accuracy),
   from the votes alone. Correlations within the classes are estimated from the same votes; a voter's
   evidence is divided by one plus its positive correlations with the others, so voters that say the same
   thing count once.
3. A logistic regression over all signs is trained on the posterior labels. The labels themselves are no
   target: they pick the sample and the voters, start the estimates, and give the share of toxic texts.
4. Every whole text is scored in Arrow batches: a weight a word, looked up once for each word of a text.

Defined results: null, empty and unknown texts get the model's base score; without labels of both
kinds every score is 0; repeated rows give repeated rows, and a labelled doc_id with several texts is
learned from the first of them; a doc_id with several labels counts as toxic if any is; null ids and
labels are not learned from; ties are resolved by name; texts of any length are read whole; empty tables
give empty results; other columns are kept by ``clean`` and ignored otherwise, whatever their names.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from edgeloom.llm.common import small_batches
from edgeloom.storage import materialise

_LETTERS = re.compile(r"[^\W\d_]+")

# A lexicon of common insults in English.
LEXICON = ("idiot", "moron", "stupid", "dumb", "scum", "trash", "loser", "pathetic", "worthless", "disgusting", "clown", "fool", "imbecile", "filthy", "vermin")


@dataclass(frozen=True)
class Bounds:
    """The sample of labelled rows (toxic, other), and what a sign needs to be a feature or a voter."""

    positives: int = 2000
    negatives: int = 4000
    support: int = 4
    feature_z: float = 3.0
    voter_z: float = 3.0
    precise: float = 0.9
    cache: int = 100_000


@dataclass
class Model:
    weights: dict[str, float] = field(default_factory=dict)
    bias: float = -30.0
    voters: list[str] = field(default_factory=list)
    accuracies: list[tuple[float, float]] = field(default_factory=list)
    discounts: list[float] = field(default_factory=list)

    def scorer(self, cache_size: int):
        cache: dict[str, float] = {}
        get = self.weights.get

        def score(text: str | None) -> float:
            if self.bias <= -30:
                return 0.0
            total = self.bias
            if len(cache) > cache_size:
                cache.clear()
            seen: set[str] = set()
            for w in set(_LETTERS.findall(text.lower())) if text else ():
                x = cache.get(w)
                if x is None:
                    x = cache[w] = sum(map(abs, (get(f, 0.0) for f in names(w))))
                if x:
                    seen.update(names(w))
            total += sum(get(f, 0.0) for f in sorted(seen))
            total += sum(get(f, 0.0) for f in style(text))
            return 1.0 / (1.0 + math.exp(-max(-30.0, min(30.0, total))))

        return score


def names(word: str) -> list[str]:
    """Feature names of a word: itself, and its beginnings of 3 to 7 letters if longer."""
    return [f"w:{word}"] + [f"p:{word[:n]}" for n in range(3, min(8, len(word)))]


def style(text: str | None) -> list[str]:
    """Names of the patterns of style that a text shows."""
    if not text:
        return []
    out = []
    raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    capitals = int(((raw >= 65) & (raw <= 90)).sum())
    small = int(((raw >= 97) & (raw <= 122)).sum())
    if capitals + small > 20 and capitals > small:
        out.append("s:capitals")
    if text.count("!") > 0.02 * len(text):
        out.append("s:exclaims")
    return out


def features_of(text: str | None) -> set[str]:
    found = set(_LETTERS.findall(text.lower())) if text else set()
    return {f for w in found for f in names(w)}.union(style(text))


def _count(sample: DataFrame) -> DataFrame:
    """(feature, positives, negatives) over the labelled rows; added up within tasks first."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        yes: Counter = Counter()
        no: Counter = Counter()
        for b in batches:
            for t, y in zip(b["text"], b["toxic"]):
                (yes if y else no).update(features_of(t))
        # A feature must be in a toxic text to matter.
        rows = [(f, n, no.get(f, 0)) for f, n in yes.items()]
        rows += [(f, 0, n) for f, n in no.items() if f not in yes]
        for i in range(0, len(rows), 50_000):
            yield pd.DataFrame(rows[i : i + 50_000], columns=["feature", "pos", "neg"])

    counted = sample.select("text", "toxic").mapInPandas(run, "feature string, pos long, neg long")
    return counted.groupBy("feature").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))


def _label_model(votes: np.ndarray, share: float, precision: np.ndarray, rounds: int = 50):
    """Expectation maximisation over 0/1 votes (rows, voters): (posterior, rates, discounts).

    A voter that doesn't fire abstains: most are of one language and say nothing about the others. One
    more voter, the last, fires where all others abstain and speaks for the clean class.
    """
    votes = np.column_stack([votes, votes.sum(axis=1) == 0]).astype(float)
    precision = np.append(precision, share / 4)
    fired = votes.mean(axis=0)
    a = np.clip(precision * fired / max(share, 1e-6), 1e-3, 0.95)
    b = np.clip((1 - precision) * fired / (1 - share), 1e-4, 0.99)
    prior, discount = share, np.ones(votes.shape[1])
    p = np.zeros(len(votes))
    for i in range(rounds):
        z = math.log(prior / (1 - prior)) + votes @ (np.log(a / b) / discount)
        p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        a = np.clip((p @ votes + 0.5) / (p.sum() + 10), 1e-3, 0.95)
        b = np.clip(((1 - p) @ votes + 0.02) / ((1 - p).sum() + 10), 1e-4, 0.99)
        prior = float(np.clip(p.mean(), share / 2, min(0.9, 2 * share)))
        if i in (4, 9, 19):  # correlations within the classes
            rho = np.zeros((votes.shape[1],) * 2)
            for q, rate in ((p, a), (1 - p, b)):
                d = (votes - rate) * np.sqrt(q)[:, None]
                cov = d.T @ d / max(q.sum(), 1.0)
                sd = np.sqrt(np.maximum(np.diag(cov), 1e-6))
                rho += 0.5 * np.clip(cov / np.outer(sd, sd), 0, 1)
            np.fill_diagonal(rho, 0)
            rho[rho < 0.2] = 0  # noise
            discount = 1 + rho.sum(axis=1)
    return p, list(zip(a.tolist(), b.tolist()))[:-1], discount[:-1]


def _logistic(rows: list[list[int]], target: np.ndarray, weight: np.ndarray, width: int, l2: float = 1.0, steps: int = 400):
    """Logistic regression over sparse 0/1 rows, by accelerated gradient steps.

    A step is halved for good whenever it would raise the loss, so features that go together don't make it swing.
    """
    at = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    col = np.array([c for r in rows for c in r], dtype=int)
    freq = np.maximum(np.bincount(col, weights=weight[at], minlength=width), 5.0)

    def margins(x: np.ndarray) -> np.ndarray:
        return x[-1] + np.bincount(at, weights=x[col], minlength=len(rows))

    def loss(x: np.ndarray, z: np.ndarray) -> float:
        return float(weight @ (np.logaddexp(0, z) - target * z)) + 0.5 * l2 * float(x[:-1] @ x[:-1])

    x = np.append(np.zeros(width), math.log(max(target.mean(), 1e-3)))
    scale, rate, momentum, last = np.append(freq, weight.sum()), 0.3, 1.0, x
    best = loss(x, margins(x))
    for _ in range(steps):
        after = (1 + math.sqrt(1 + 4 * momentum * momentum)) / 2
        ahead = x + (momentum - 1) / after * (x - last)
        z = margins(ahead)
        e = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - target) * weight
        g = np.append(np.bincount(col, weights=e[at], minlength=width) + l2 * ahead[:-1], e.sum())
        new = ahead - rate * g / scale
        now = loss(new, margins(new))
        if now > best + 1e-9:
            # Start again from here, slower.
            rate, momentum, last = rate / 2 if ahead is x or momentum == 1.0 else rate * 0.8, 1.0, x
            continue
        last, x, momentum, best = x, new, after, now
    return x[:-1], float(x[-1])


def fit(documents: DataFrame, labels: DataFrame, bounds: Bounds = Bounds()) -> Model:
    """Fit on ``documents`` (doc_id, text) and ``labels`` (doc_id, toxic), both of the training part."""
    marked = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    texts = documents.where("text is not null and doc_id is not null").select("doc_id", "text")
    marked = materialise(marked.join(texts.select("doc_id").distinct(), "doc_id", "left_semi"), "toxicity-marks")
    n = {r["toxic"]: r["n"] for r in marked.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not n.get(1) or not n.get(0):
        return Model()
    draw = F.xxhash64("doc_id", F.lit("toxicity sample"))
    picked = marked.where("toxic = 1").orderBy(draw, "doc_id").limit(bounds.positives).union(marked.where("toxic = 0").orderBy(draw, "doc_id").limit(bounds.negatives))
    picked = materialise(picked, "toxicity-labels")  # at most positives + negatives rows, so it is broadcast
    sample = texts.join(F.broadcast(picked), "doc_id").groupBy("doc_id", "toxic").agg(F.min("text").alias("text"))
    sample = materialise(sample, "toxicity-sample")

    pos, neg = min(n[1], bounds.positives), min(n[0], bounds.negatives)
    # Back to the labels' own proportions, of which the sample may have changed the balance.
    scale = (n[0] / neg) / (n[1] / pos)
    counts = _count(sample).where(F.col("pos") + F.col("neg") >= bounds.support)
    odds = F.log((F.col("pos") + 0.5) / (pos + 1.0)) - F.log((F.col("neg") + 0.5) / (neg + 1.0))
    z = odds / F.sqrt(1 / (F.col("pos") + 0.5) + 1 / (F.col("neg") + 0.5))
    # Only signs of toxicity are features: a text without any gets the base score, whatever its topic.
    best = counts.select("feature", "pos", "neg", z.alias("z")).where(F.col("z") >= bounds.feature_z).orderBy(F.desc("z"), "feature").collect()
    index = {r["feature"]: i for i, r in enumerate(best)}
    for w in LEXICON:
        index.setdefault(f"w:{w}", len(index))
    precise = {r["feature"]: (r["pos"] + 0.2) / (r["pos"] + scale * r["neg"] + 0.4) for r in best}
    started = {r["feature"]: (r["pos"] + 0.2) / (r["pos"] + r["neg"] + 0.4) for r in best}
    voters = [r["feature"] for r in best if r["z"] >= bounds.voter_z and precise[r["feature"]] >= bounds.precise]
    voters += [f for f in (f"w:{w}" for w in LEXICON) if f not in precise] + [x for x in ("s:capitals", "s:exclaims") if x in index and x not in voters]

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"toxic": b["toxic"].astype("float64"), "at": [sorted(index[f] for f in features_of(t) if f in index) for t in b["text"]], "doc_id": b["doc_id"]})

    coded = sample.mapInPandas(encode, "toxic double, at array<int>, doc_id long").toPandas().sort_values("doc_id", kind="stable")
    rows = [list(x) for x in coded["at"]]
    label = coded["toxic"].to_numpy(dtype=float)
    ids = {index[f]: j for j, f in enumerate(voters) if f in index}
    votes = np.zeros((len(rows), len(voters)))
    for i, r in enumerate(rows):
        for c in r:
            if c in ids:
                votes[i, ids[c]] = 1.0
    posterior, rates, discount = _label_model(votes, pos / (pos + neg), np.array([started.get(f, 0.8) for f in voters]))
    weight = np.where(label == 0, scale, 1.0)  # the sample's balance, undone
    w, bias = _logistic(rows, posterior, weight, len(index))
    weights = {f: float(w[i]) for f, i in index.items() if abs(w[i]) > 1e-4}
    return Model(weights, float(bias), voters, rates, discount.tolist())


def score(documents: DataFrame, model: Model, keep: list[Column], threshold: float = 0.3, bounds: Bounds = Bounds()) -> DataFrame:
    """``keep`` columns of every row, with score and predicted of its ``text``."""
    small_batches(documents.sparkSession)
    shared = documents.sparkSession.sparkContext.broadcast(model)
    rows = documents.select(*keep, F.col("text").alias("__text"))
    schema = rows.drop("__text").schema.add("score", "double").add("predicted", "integer")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        say = shared.value.scorer(bounds.cache)
        for b in batches:
            got = [say(t) for t in b.pop("__text")]
            b["score"], b["predicted"] = got, [int(x >= threshold) for x in got]
            yield b

    return rows.mapInPandas(run, schema)


def clean(documents: DataFrame, model: Model, threshold: float = 0.3, bounds: Bounds = Bounds()) -> DataFrame:
    """``documents`` without the rows predicted toxic. Every column passes once, as Arrow."""
    small_batches(documents.sparkSession)
    shared = documents.sparkSession.sparkContext.broadcast(model)
    at = documents.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        say = shared.value.scorer(bounds.cache)
        for b in batches:
            yield b.filter(pa.array([say(t) < threshold for t in b.column(at).to_pylist()], pa.bool_()))

    return documents.mapInArrow(run, documents.schema)
