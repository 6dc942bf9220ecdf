"""Node embeddings: degree, random projection, skip-gram, spectral, message passing.

Anything that is sparse matrix times skinny matrix is a join and an element-wise sum, at any size.
Spectral methods solve small graphs (``max_nodes``) as dense matrices; larger ones by products with the
neighbour lists (``spectral``), which the driver, and for ``netmf`` every task, holds.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from edgeloom.operators import around, spectral
from edgeloom.operators.features import dense, large_graph
from edgeloom.operators.graph import degrees
from edgeloom.operators.walks import start_walks, walk_sentences, walks
from edgeloom.storage import materialise, shuffle_width

EMBEDDINGS: dict[str, Callable[..., DataFrame]] = {}


def embedding(name: str):
    def put(f):
        EMBEDDINGS[name] = f
        return f

    return put


def capped_dim(dim: int, n: int) -> int:
    return max(1, min(dim, n - 5))


def score_by_dot(emb: DataFrame, pairs: DataFrame, cleaned: bool = True) -> DataFrame:
    """pairs with the inner product of their ends' vectors."""
    from edgeloom.functions.expressions import clean_vector, dot

    e = emb.select("id", clean_vector("vec").alias("vec")) if cleaned else emb
    one = pairs.join(e.select(F.col("id").alias("src"), F.col("vec").alias("a")), "src").join(e.select(F.col("id").alias("trg"), F.col("vec").alias("b")), "trg")
    return one.select(*pairs.columns, dot("a", "b").alias("score"))


def log_degree_corrected(scores: DataFrame, deg: DataFrame) -> DataFrame:
    """score + log of both degrees."""
    from edgeloom.operators.scorers import with_degrees

    df = with_degrees(deg, scores)
    log = lambda c: F.log(F.greatest(c, F.lit(1)).cast("double"))
    return df.withColumn("score", F.col("score") + log("ki") + log("kj")).select(*scores.columns)


def sum_vectors(rows: DataFrame, by: str, dim: int, column: str = "vec") -> DataFrame:
    """Element-wise sums of vectors by key: one aggregate a dimension, combined before the shuffle."""
    sums = [F.sum(F.get(column, F.lit(i))).alias(f"_{i}") for i in range(dim)]
    return rows.groupBy(by).agg(*sums).select(by, F.array(*[f"_{i}" for i in range(dim)]).alias("vec"))


def hash_gaussian(id_: Column, dim: int, seed: int = 0) -> Column:
    """A vector of pseudo-random normals of an id (sum of twelve uniforms, from 64-bit hashes)."""
    unit = lambda i, j: F.pmod(F.xxhash64(id_, F.lit(seed), i, F.lit(j)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    return F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda i: sum((unit(i, j) for j in range(12)), F.lit(-6.0)))


@embedding("degree")
def degree_embedding(sym: DataFrame, dim: int, **_) -> DataFrame:
    zeros = [F.lit(0.0)] * (dim - 1)
    return degrees(sym).select(F.col("u").alias("id"), F.array(F.col("k").cast("double"), *zeros).alias("vec"))


@embedding("fastrp")
def fast_random_projection(sym: DataFrame, dim: int, window: int = 5, beta: float = -1.0, seed: int = 0, **_) -> DataFrame:
    """Mean over ``window`` steps of P^t applied to a random projection weighted by degree ** beta."""
    deg = materialise(degrees(sym), "rp-degrees")
    sym = materialise(sym.join(deg, "u").select("u", "v", (F.lit(1.0) / F.col("k")).alias("p")), "rp-steps")
    total = float(deg.agg(F.sum("k")).first()[0] or 1)
    weight = F.pow(F.col("k") / F.lit(total), F.lit(beta))
    first = deg.select("u", F.transform(hash_gaussian(F.col("u"), dim, seed), lambda x: x * weight).alias("vec"))

    def step(x: DataFrame) -> DataFrame:
        moved = sym.join(x.select(F.col("u").alias("v"), "vec"), "v").select("u", F.transform("vec", lambda a: a * F.col("p")).alias("vec"))
        return materialise(sum_vectors(moved, "u", dim), "rp")

    power = materialise(first, "rp")
    total_rows = None
    for _i in range(window):
        power = step(power)
        total_rows = power if total_rows is None else total_rows.union(power)
    out = sum_vectors(total_rows, "u", dim)
    return out.select(F.col("u").alias("id"), F.transform("vec", lambda a: a / F.lit(float(window))).alias("vec"))


def _skip_gram(found: DataFrame, dim: int, window: int, seed: int) -> DataFrame:
    from pyspark.ml.feature import Word2Vec
    from pyspark.ml.functions import vector_to_array

    model = Word2Vec(vectorSize=dim, windowSize=window, minCount=0, seed=seed, inputCol="sentence", outputCol="x", numPartitions=1).fit(walk_sentences(found))
    return model.getVectors().select(F.col("word").cast("long").alias("id"), vector_to_array("vector").alias("vec"))


def _starts(sym: DataFrame, num_walks: int) -> DataFrame:
    from edgeloom.operators.graph import global_rank

    nodes = global_rank(sym.select(F.col("u").alias("node")).distinct(), ["node"], "nth")
    return start_walks(nodes, num_walks)


@embedding("node2vec")
def node2vec(sym: DataFrame, dim: int, num_walks: int = 10, walk_length: int = 40, window: int = 10, p: float = 1.0, q: float = 1.0, seed: int = 0, **_) -> DataFrame:
    return _skip_gram(walks(sym, _starts(sym, num_walks), walk_length, p, q, seed=seed), dim, window, seed)


@embedding("deepwalk")
def deepwalk(sym: DataFrame, dim: int, **options) -> DataFrame:
    return node2vec(sym, dim, **options)


@embedding("line")
def line(sym: DataFrame, dim: int, **options) -> DataFrame:
    return node2vec(sym, dim, **{**options, "window": 1})


@embedding("nonbacktracking_walk")
def nonbacktracking_walk(sym: DataFrame, dim: int, num_walks: int = 10, walk_length: int = 40, window: int = 10, seed: int = 0, **_) -> DataFrame:
    return _skip_gram(walks(sym, _starts(sym, num_walks), walk_length, non_backtracking=True, seed=seed), dim, window, seed)


def _back(sym: DataFrame, ids: list[int], x: np.ndarray) -> DataFrame:
    x = np.real(x)
    return sym.sparkSession.createDataFrame([(int(i), [float(a) for a in row]) for i, row in zip(ids, x)], "id long, vec array<double>")


def _top(m: np.ndarray, dim: int, drop_first: bool) -> tuple[np.ndarray, np.ndarray]:
    s, u = np.linalg.eigh(m)
    order = np.argsort(-s)[int(drop_first) : dim + int(drop_first)]
    return s[order], u[:, order]


def _normalised(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    k = np.maximum(a.sum(axis=1), 1e-32)
    return a / np.sqrt(np.outer(k, k)), k


def _normalised_product(g: around.Graph) -> spectral.Product:
    root = np.sqrt(np.maximum(g.k, 1))[:, None]
    return lambda x: g.around(x / root) / root


def _log_walk_rows(sym: DataFrame, n: int, steps: int) -> DataFrame:
    """(at, rows): rows from number ``at`` on of log(max(mean of P^1..P^steps / k * sum k, 1e-12)), a block as bytes."""
    spark, shared = sym.sparkSession, around.held(sym)
    block = max(1, min(64, around.BLOCK // max(n, 1)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        g = shared.value
        slots, k = around.Slots(g), g.k[:, None].astype(float)
        for b in batches:
            for at in (b.column("id").to_numpy() * block).tolist():
                rows = np.arange(at, min(at + block, n))
                power = np.zeros((n, len(rows)))
                power[rows, np.arange(len(rows))] = 1.0
                total = np.zeros_like(power)
                for _i in range(steps):
                    power = slots.around(power / k)
                    total += power / steps
                got = np.log(np.maximum(total / k * k.sum(), 1e-12))
                yield pa.RecordBatch.from_arrays([pa.array([at], pa.int64()), pa.array([got.T.tobytes()], pa.binary())], ["at", "rows"])

    blocks = -(-n // block)
    return spark.range(0, blocks, 1, min(blocks, max(shuffle_width(spark), 24))).mapInArrow(run, "at long, rows binary")


def _rows_product(rows: DataFrame, x: np.ndarray) -> np.ndarray:
    """The matrix of ``_log_walk_rows`` times ``x``, each block where it is."""
    sent = rows.sparkSession.sparkContext.broadcast(x)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [(np.frombuffer(r.as_buffer(), dtype=float).reshape(-1, len(sent.value)) @ sent.value).tobytes() for r in b.column("rows")]
            yield pa.RecordBatch.from_arrays([b.column("at"), pa.array(got, pa.binary())], ["at", "got"])

    out = np.empty_like(x)
    for at, got in zip(*(c.to_pylist() for c in rows.mapInArrow(run, "at long, got binary").toArrow().columns)):
        y = np.frombuffer(got, dtype=float).reshape(-1, x.shape[1])
        out[at : at + len(y)] = y
    sent.destroy()
    return out


@embedding("leigenmap")
def laplacian_eigenmap(sym: DataFrame, dim: int, max_nodes: int = 5000, **_) -> DataFrame:
    g = large_graph(sym, max_nodes)
    if g is not None:
        s, u = spectral.top_eigen(_normalised_product(g), len(g.ids), dim + 1)
        return _back(sym, g.ids, u[:, 1:] / np.sqrt(g.k)[:, None] * np.sqrt(np.abs(s[1:])))
    ids, a = dense(sym, max_nodes)
    m, k = _normalised(a)
    s, u = _top(m, dim, True)
    return _back(sym, ids, u / np.sqrt(k)[:, None] * np.sqrt(np.abs(s)))


@embedding("adjspec")
def adjacency_spectral(sym: DataFrame, dim: int, max_nodes: int = 5000, **_) -> DataFrame:
    g = large_graph(sym, max_nodes)
    if g is not None:
        s, u = spectral.top_eigen(g.around, len(g.ids), dim, "magnitude")
        return _back(sym, g.ids, u * s**2)
    ids, a = dense(sym, max_nodes)
    u, s, _vt = np.linalg.svd(a)
    return _back(sym, ids, u[:, :dim] * s[:dim] ** 2)


@embedding("modspec")
def modularity_spectral(sym: DataFrame, dim: int, max_nodes: int = 5000, **_) -> DataFrame:
    g = large_graph(sym, max_nodes)
    if g is not None:
        s, u = spectral.top_eigen(g.around, len(g.ids), dim + 1)
        return _back(sym, g.ids, u[:, 1:] * np.sqrt(np.abs(s[1:])))
    ids, a = dense(sym, max_nodes)
    s, u = _top(a, dim, True)
    return _back(sym, ids, u * np.sqrt(np.abs(s)))


@embedding("highorder_modularity")
def high_order_modularity(sym: DataFrame, dim: int, steps: int = 10, max_nodes: int = 5000, **_) -> DataFrame:
    g = large_graph(sym, max_nodes)
    if g is not None:
        pi, near = (g.k / g.k.sum())[:, None], around.Near(g)

        def product(x: np.ndarray) -> np.ndarray:
            power, total = x, np.zeros_like(x)
            for _i in range(steps):
                power = near.around(power) / g.k[:, None]
                total += power / steps
            return pi * (total - pi.T @ x)

        found = spectral.wide_eigen(product, len(g.ids), dim, 1e-9, symmetric=True)
        s, u = spectral.top_eigen(product, len(g.ids), dim, "magnitude", width=max(64, min(300, 27_000_000 // len(g.ids)))) if found is None else found
        return _back(sym, g.ids, u * np.sqrt(np.abs(s)))
    ids, a = dense(sym, max_nodes)
    k = a.sum(axis=1)
    p, pi = a / k[:, None], k / k.sum()
    power, total = np.eye(len(ids)), np.zeros_like(a)
    for _i in range(steps):
        power = power @ p
        total += power / steps
    u, s, _vt = np.linalg.svd(pi[:, None] * total - np.outer(pi, pi))
    return _back(sym, ids, u[:, :dim] * np.sqrt(s[:dim]))


@embedding("linearized_node2vec")
def linearised_node2vec(sym: DataFrame, dim: int, steps: int = 10, max_nodes: int = 5000, **_) -> DataFrame:
    g = large_graph(sym, max_nodes)
    if g is not None:
        ids, k = g.ids, g.k
        s, u = spectral.top_eigen(_normalised_product(g), len(ids), dim + 1)
        s, u = s[1:], u[:, 1:]
    else:
        ids, a = dense(sym, max_nodes)
        m, k = _normalised(a)
        s, u = _top(m, dim, True)
    s = np.where(np.abs(1 - s) < 1e-12, 1.0, s * (1 - s**steps) / (steps * np.where(np.abs(1 - s) < 1e-12, 1, 1 - s)))
    return _back(sym, ids, u / np.sqrt(k)[:, None] * np.sqrt(np.abs(s)))


@embedding("nonbacktracking")
def nonbacktracking_spectral(sym: DataFrame, dim: int, max_nodes: int = 2000, **_) -> DataFrame:
    g = large_graph(sym, max_nodes)
    if g is not None:
        n, slots = len(g.ids), around.Near(g)

        def product(x: np.ndarray) -> np.ndarray:
            return np.concatenate([(g.k - 1.0)[:, None] * x[n:], slots.around(x[n:]) - x[:n]])

        return _back(sym, g.ids, spectral.top_eigen_general(product, 2 * n, dim)[1][n:])
    ids, a = dense(sym, max_nodes)
    n = len(ids)
    m = np.block([[np.zeros((n, n)), np.diag(a.sum(axis=1)) - np.eye(n)], [-np.eye(n), a]])
    s, u = np.linalg.eig(m)
    order = np.argsort(-np.abs(s))[:dim]
    return _back(sym, ids, np.real(u[n:, order]))


@embedding("netmf")
def walk_matrix_factorisation(sym: DataFrame, dim: int, steps: int = 10, max_nodes: int = 5000, **_) -> DataFrame:
    g = large_graph(sym, max_nodes)
    if g is not None:
        # The executors keep what they have memory for; other rows of the logarithms are made anew for each product.
        rows = _log_walk_rows(sym, len(g.ids), steps).persist(StorageLevel.MEMORY_ONLY)
        s, u = spectral.top_eigen(lambda x: _rows_product(rows, x), len(g.ids), dim, "magnitude", width=96)
        rows.unpersist()
        return _back(sym, g.ids, u * np.sqrt(np.abs(s)))
    ids, a = dense(sym, max_nodes)
    k = a.sum(axis=1)
    p = a / k[:, None]
    power, total = np.eye(len(ids)), np.zeros_like(a)
    for _i in range(steps):
        power = power @ p
        total += power / steps
    u, s, _vt = np.linalg.svd(np.log(np.maximum(total / k[None, :] * k.sum(), 1e-12)))
    return _back(sym, ids, u[:, :dim] * np.sqrt(s[:dim]))


@embedding("spectral_transformation")
def spectral_transformation(sym: DataFrame, dim: int, kernel: str = "exp", matrix: str = "adjacency", alpha: float | None = None, max_nodes: int = 5000, **_) -> DataFrame:
    """Eigenvectors scaled by a kernel of eigenvalues: exp or neumann, of A, the normalised A or the Laplacian.

    Without ``alpha`` it is fitted by golden section to predict a held-out third of the edges.
    """
    g = large_graph(sym, max_nodes)
    if g is None:
        ids, a = dense(sym, max_nodes)
        i, j = np.nonzero(np.triu(a, 1))
    else:
        ids, i, j = g.ids, np.repeat(np.arange(len(g.ids)), g.k), g.near.astype(np.int64)
        i, j = i[i < j], j[i < j]
    out = (i * 73856093 + j * 19349663) % 3 == 0

    def base(x: np.ndarray) -> np.ndarray:
        m, k = _normalised(x)
        return {"adjacency": x, "normalised": m, "laplacian": x - np.diag(x.sum(axis=1))}[matrix]

    def top(train: bool) -> tuple[np.ndarray, np.ndarray]:
        """Of the whole matrix, or of that without the held-out edges."""
        if g is None:
            x = a.copy()
            if train:
                x[i[out], j[out]] = x[j[out], i[out]] = 0
            return _top(base(x), dim, False)
        gone = around.Graph(np.concatenate([i[out], j[out]]), np.concatenate([j[out], i[out]])) if train and out.any() else None
        k = g.k.astype(float)
        if gone is not None:
            k[gone.ids] -= gone.k
        root = np.sqrt(np.maximum(k, 1e-32))[:, None]

        def product(x: np.ndarray) -> np.ndarray:
            y = x / root if matrix == "normalised" else x
            z = g.around(y)
            if gone is not None:
                z[gone.ids] -= gone.around(y[gone.ids])
            # A node that has lost all edges has an empty row; what is left there is rounding.
            z[k == 0] = 0.0
            return z / root if matrix == "normalised" else z - k[:, None] * x if matrix == "laplacian" else z

        return spectral.top_eigen(product, len(ids), dim)

    def scaled(s: np.ndarray, t: float) -> np.ndarray:
        return np.exp(t * s) if kernel == "exp" else 1 / np.maximum(1 - t * s, 1e-6)

    if alpha is None:
        s, u = top(True)

        def cost(t: float) -> float:
            got = np.einsum("nd,nd->n", u[i[out]] * scaled(s, t), u[j[out]])
            return float(((got - 1) ** 2).mean() + 1e-2 * t * t)

        lo, hi, gold = 0.0, 1.0 / max(float(np.abs(s).max()), 1e-9), (5**0.5 - 1) / 2
        for _i in range(40):
            x, y = hi - gold * (hi - lo), lo + gold * (hi - lo)
            lo, hi = (lo, y) if cost(x) < cost(y) else (x, hi)
        alpha = (lo + hi) / 2
    s, u = top(False)
    return _back(sym, ids, u * np.sqrt(np.abs(scaled(s, alpha))))


@embedding("dcsbm")
def block_model_embedding(sym: DataFrame, dim: int, membership: DataFrame | None = None, **_) -> DataFrame:
    """Eigenvectors of the normalised block matrix, by node times its degree. Without a membership
    the blocks come from label propagation over hashes (see communities)."""
    from edgeloom.operators.communities import label_propagation
    from edgeloom.operators.sampling import block_matrix

    membership = materialise(membership if membership is not None else label_propagation(sym), "dcsbm-blocks")
    blocks = block_matrix(sym, membership).collect()
    names = sorted({r["ga"] for r in blocks})
    at = {g: i for i, g in enumerate(names)}
    b = np.zeros((len(names),) * 2)
    for r in blocks:
        b[at[r["ga"]], at[r["gb"]]] = r["w"]
    m, k = _normalised(b)
    s, u = _top(m, min(dim, len(names)), False)
    x = u * np.sqrt(np.abs(s)) / np.sqrt(k)[:, None]
    rows = sym.sparkSession.createDataFrame([(int(g), [float(v) for v in x[at[g]]] + [0.0] * (dim - x.shape[1])) for g in names], "g long, b array<double>")
    deg = degrees(sym)
    out = deg.join(membership.select(F.col("node").alias("u"), "g"), "u").join(rows, "g")
    return out.select(F.col("u").alias("id"), F.transform("b", lambda v: v * F.col("k")).alias("vec"))


def randomised_svd(entries: DataFrame, ids: DataFrame, dim: int, extra: int = 10, rounds: int = 5, seed: int = 0) -> tuple[DataFrame, np.ndarray]:
    """(id, vec) of left singular vectors and the singular values of a symmetric matrix given by entries
    (u, v, w): products with skinny matrices are joins; QR works on (dim + extra)-sized Gram matrices."""
    width = dim + extra

    def times(x: DataFrame) -> DataFrame:
        rows = entries.join(x.select(F.col("id").alias("v"), "vec"), "v").select(F.col("u").alias("id"), F.transform("vec", lambda a: a * F.col("w")).alias("vec"))
        return materialise(sum_vectors(rows, "id", width), "rsvd")

    def gram(x: DataFrame) -> np.ndarray:
        row = x.agg(*[F.sum(F.get("vec", F.lit(i)) * F.get("vec", F.lit(j))).alias(f"g{i}_{j}") for i in range(width) for j in range(i, width)]).first()
        g = np.zeros((width, width))
        for i in range(width):
            for j in range(i, width):
                g[i, j] = g[j, i] = row[f"g{i}_{j}"] or 0.0
        return g

    def apply(x: DataFrame, m: np.ndarray) -> DataFrame:
        cols = [sum((F.get("vec", F.lit(i)) * F.lit(float(m[i, j])) for i in range(width)), F.lit(0.0)) for j in range(m.shape[1])]
        return materialise(x.select("id", F.array(*cols).alias("vec")), "rsvd")

    def orthonormal(x: DataFrame) -> DataFrame:
        s, u = np.linalg.eigh(gram(x))
        keep = np.maximum(s, 1e-12 * max(s.max(), 1e-300))
        return apply(x, u / np.sqrt(keep))

    x = materialise(ids.select("id", hash_gaussian(F.col("id"), width, seed).alias("vec")), "rsvd")
    for _i in range(rounds):
        x = orthonormal(times(x))
    y = times(x)
    s, u = np.linalg.eigh(gram(y))
    order = np.argsort(-s)[:dim]
    values = np.sqrt(np.maximum(s[order], 0))
    return apply(y, u[:, order] / np.maximum(values, 1e-300)), values


def principal_components(emb: DataFrame, dim: int) -> DataFrame:
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import array_to_vector, vector_to_array

    data = emb.select("id", array_to_vector("vec").alias("x"))
    return PCA(k=dim, inputCol="x", outputCol="y").fit(data).transform(data).select("id", vector_to_array("y").alias("vec"))


def message_pass(sym: DataFrame, emb: DataFrame, dim: int, how: str = "mean") -> DataFrame:
    """One aggregation of neighbours' vectors: sum, mean, max, or the symmetrically normalised sum (gcn)."""
    if how == "max":
        rows = sym.join(emb.select(F.col("id").alias("v"), "vec"), "v")
        most = [F.max(F.get("vec", F.lit(i))).alias(f"_{i}") for i in range(dim)]
        return rows.groupBy(F.col("u").alias("id")).agg(*most).select("id", F.array(*[f"_{i}" for i in range(dim)]).alias("vec"))
    deg = degrees(sym)
    rows = sym.join(deg.select("u", F.col("k").alias("ku")), "u").join(deg.select(F.col("u").alias("v"), F.col("k").alias("kv")), "v").join(emb.select(F.col("id").alias("v"), "vec"), "v")
    w = {"sum": F.lit(1.0), "mean": 1.0 / F.col("ku"), "gcn": 1.0 / F.sqrt(F.col("ku") * F.col("kv").cast("double"))}[how]
    return sum_vectors(rows.select(F.col("u").alias("id"), F.transform("vec", lambda a: a * w).alias("vec")), "id", dim)
