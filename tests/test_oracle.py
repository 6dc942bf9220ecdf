"""Registered queries against their SQL, on the smallest tables."""

import os

import pytest

SF = "/root/testdata/sf0.001"
NAMES = ["edges_canonical", "degree_distribution", "spanning_forest", "train_test_split", "negatives_uniform", "score_ra", "auc_by_sampler", "topk_cn", "precision_recall_at_k", "network_stats", "nmi", "element_centric_similarity", "filename_params", "theory_lognormal_auc", "ranking_candidates", "rwr_matrix", "second_order_graph", "short_path", "closeness", "personalised_pagerank", "knn_log_degree", "rank_by_embedding", "rank_by_embedding_degree", "log_degree_corrected", "power_sum", "walk_context", "sample_with_replacement", "recode_sentinels", "global_top", "lda_separation", "edge_csv_scan", "table_scan_orc", "windowed_edge_counts", "theory_zeta_auc"]


@pytest.fixture(scope="module")
def con():
    import duckdb

    c = duckdb.connect()
    for f in os.listdir(SF):
        c.sql(f"create view {f.split('.')[0]} as select * from '{SF}/{f}'")
    return c


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the test tables")
@pytest.mark.parametrize("name", NAMES)
def test_query(spark, con, name):
    import __spark_entry__ as e

    got = e.queries()[name](spark, SF).toPandas()
    want = con.sql(e.oracle_sql()[name]).df()
    cols = sorted(got.columns)
    assert cols == sorted(want.columns)
    key = lambda df: sorted(tuple(round(float(x), 6) if isinstance(x, (int, float)) or hasattr(x, "dtype") else str(x) for x in r) for r in df[cols].itertuples(index=False))
    assert key(got) == key(want)
