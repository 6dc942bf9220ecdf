"""Column expressions for edges, vectors and results."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

Name = Column | str


def _c(x: Name) -> Column:
    return F.col(x) if isinstance(x, str) else x


def edge_key(u: Name, v: Name) -> Column:
    """The undirected key of a pair: a struct (lo, hi)."""
    return F.struct(F.least(_c(u), _c(v)).alias("lo"), F.greatest(_c(u), _c(v)).alias("hi"))


def cantor_pair(a: Name, b: Name, unordered: bool = False) -> Column:
    """Cantor pairing number as a long; ``unordered`` adds the smaller number instead of the second."""
    s = _c(a) + _c(b)
    tail = F.least(_c(a), _c(b)) if unordered else _c(b)
    return F.floor(s * (s + 1) / F.lit(2)).cast("long") + tail


def cantor_unpair(z: Name) -> Column:
    """The two numbers of an ordered Cantor pairing, as a struct (a, b)."""
    w = F.floor((F.sqrt(8 * _c(z) + 1) - 1) / 2).cast("long")
    # The root may be off by one in floating point: correct it exactly.
    w = F.when((w * (w + 1)) / 2 > _c(z), w - 1).when(((w + 1) * (w + 2)) / 2 <= _c(z), w + 1).otherwise(w)
    b = (_c(z) - F.floor(w * (w + 1) / F.lit(2))).cast("long")
    return F.struct((w - b).alias("a"), b.alias("b"))


def safe_log(x: Name, least: float = 1e-12) -> Column:
    return F.log(F.greatest(_c(x).cast("double"), F.lit(least)))


def clean_vector(v: Name) -> Column:
    """A vector with NaN and null elements as 0."""
    return F.transform(_c(v), lambda x: F.coalesce(F.nanvl(x.cast("double"), F.lit(0.0)), F.lit(0.0)))


def dot(a: Name, b: Name) -> Column:
    return F.aggregate(F.zip_with(_c(a), _c(b), lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Name) -> Column:
    return F.sqrt(dot(a, a))


def distance(a: Name, b: Name, metric: str = "euclidean") -> Column:
    """euclidean, cosine (1 - cos), angular (arccos of cos) or dot (negated product)."""
    if metric == "euclidean":
        return F.sqrt(F.aggregate(F.zip_with(_c(a), _c(b), lambda x, y: (x - y).cast("double") * (x - y)), F.lit(0.0), lambda s, x: s + x))
    if metric == "dot":
        return -dot(a, b)
    cos = dot(a, b) / F.greatest(norm(a) * norm(b), F.lit(1e-300))
    return 1 - cos if metric == "cosine" else F.acos(F.greatest(F.least(cos, F.lit(1.0)), F.lit(-1.0)))


def recode(x: Name, mapping: dict[str, str], keep: bool = False) -> Column:
    """Dictionary lookup; what isn't in it becomes null, or stays with ``keep``."""
    m = F.create_map(*[F.lit(p) for kv in mapping.items() for p in kv]) if mapping else None
    found = F.try_element_at(m, _c(x)) if m is not None else F.lit(None).cast("string")
    return F.coalesce(found, _c(x)) if keep else found


def in_or_null(x: Name, values: list) -> Column:
    """Whether a value is in the list or missing."""
    return _c(x).isin(*values) | _c(x).isNull()


def logistic(x: Name) -> Column:
    return 1.0 / (1.0 + F.exp(-_c(x)))


def normal_cdf(x: Name, terms: int = 80) -> Column:
    """Standard normal distribution function by its power series, good to 1e-9 for abs(x) <= 6."""
    z = F.greatest(F.least(_c(x).cast("double"), F.lit(6.0)), F.lit(-6.0))
    start = F.struct(z.alias("term"), z.alias("total"))

    def add(s: Column, i: Column) -> Column:
        term = s["term"] * z * z / (2 * i + 1)
        return F.struct(term.alias("term"), (s["total"] + term).alias("total"))

    series = F.aggregate(F.sequence(F.lit(1), F.lit(terms)), start, add)["total"]
    return 0.5 + series * F.exp(-z * z / 2) / F.lit(2.5066282746310002)
