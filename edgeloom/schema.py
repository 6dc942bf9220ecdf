"""Fixed schemas of the tables that graphs, scores and results travel in."""

from pyspark.sql.types import ArrayType, DoubleType, IntegerType, LongType, StringType, StructField, StructType


def _of(**kinds) -> StructType:
    return StructType([StructField(k, t) for k, t in kinds.items()])


L, D, I, S = LongType(), DoubleType(), IntegerType(), StringType()

EDGES = _of(src=L, trg=L)
NODES = _of(id=L)
TARGETS = _of(src=L, trg=L, isPositiveEdge=I)
SCORES = _of(src=L, trg=L, y=I, ypred=D)
EMBEDDING = _of(id=L, vec=ArrayType(D))
TOPK = _of(u=L, v=L, score=D, rank=L)
WALKS = _of(walk_id=L, path=ArrayType(L))
MEMBERSHIP = _of(node_id=L, membership=I)
GROUPS = _of(node_id=L, group_id=D)
AUC = _of(score=D, metric=S, data=S)
RETRIEVAL = _of(rec=D, prec=D, topk=I, data_name=S)
COMMUNITY_SCORE = _of(score=D, score_type=S)
NETWORK_STATS = _of(
    network=S, n_nodes=L, n_edges=L, averageDegree=D, maxDegree=L, degreeKurtosis=D, degreeSkewness=D, degreeVariance=D,
    degreeVariance_normalized=D, degreeAssortativity=D, globalTransitivity=D, localTransitivity=D, degreeHeterogeneity=D,
    lognorm_mu=D, lognorm_sigma=D,
)
