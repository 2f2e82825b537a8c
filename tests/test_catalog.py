"""The registered analytics queries against DuckDB on the smallest tables."""

import os

import duckdb
import pytest

from quillon.plans import catalog, catalog_factors, catalog_graphs, catalog_joins, catalog_models, catalog_more, catalog_reports, catalog_sources, catalog_spatial  # noqa: F401  they fill the registry

FOLDER = "/root/testdata/sf0.001"
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")
SOME = (
    "cohort_spearman_summary", "describe_by_sample", "mann_whitney_by_sample", "multiple_testing", "meta_inverse_variance", "program_overlaps", "program_components", "label_agreement", "local_moran", "permutation_null", "term_enrichment_p", "composition_balances",
    "pooled_and_by_dataset", "threshold_sweep_by_sample", "binned_profile_by_sample", "correlation_tests_by_sample", "chi_square_test_by_sample", "fisher_test_by_nation", "mean_tests_by_dataset", "checked_orders", "source_match", "customer_centroids", "label_morans",
    "ring_compositions", "robust_program_edges", "retained_components", "set_scores", "background_matched_scores", "subset_null", "set_permutations", "sign_flips", "ols_by_sample", "cross_validated_r2", "nested_f_by_sample", "segment_permanova", "spot_groups",
    "class_separation", "program_identity", "filtered_spots", "lattice_blocks", "part_rule_votes", "gmt_round_trip", "matrix_round_trip", "sink_audit",
    "gee_independent", "gee_exchangeable", "family_separation", "strongest_eight", "order_balances", "gene_models", "source_alignment", "set_overlap_audit", "partial_spearman_two", "sided_enrichment_p",
    "trended_parts", "part_residuals", "segment_pseudo_f", "matched_smoothness", "smoothed_part_scores", "family_coherence", "flag_markers", "pair_summaries", "scaled_spots",
)


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no tables")
@pytest.mark.parametrize("name", SOME)
def test_equals_duckdb(spark, name):
    df = catalog.QUERIES[name](spark, FOLDER)
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    ran = con.execute(catalog.SQL[name])
    names = [d[0] for d in ran.description]
    assert sorted(names) == sorted(df.columns)
    order = sorted(names)
    mine = sorted(repr(tuple(r[c] for c in order)) for r in df.collect())
    theirs = sorted(repr(tuple(r[names.index(c)] for c in order)) for r in ran.fetchall())
    assert mine == theirs


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no tables")
@pytest.mark.parametrize("name", ["program_tree", "program_merges", "program_order", "family_stability", "program_map", "customer_programs", "customer_components", "matched_customers"])
def test_iterative_queries_run(spark, name):
    rows = catalog.QUERIES[name](spark, FOLDER).collect()
    assert rows and all(not isinstance(v, float) or v == v for r in rows for v in r)


def test_every_query_has_a_name_and_most_have_sql():
    assert set(catalog.SQL) <= set(catalog.QUERIES)
    assert len(catalog.QUERIES) - len(catalog.SQL) <= 20


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no tables")
def test_rings_start_all_over_the_lattice(spark):
    test_equals_duckdb(spark, "high_rings")
    got = catalog.QUERIES["high_rings"](spark, FOLDER).collect()
    assert {r.ring for r in got} == {0, 1, 2, 3} and {r.sample for r in got} == {0, 1, 2, 3}
    values = [(r.p_partkey % 4, float(r.p_retailprice)) for r in spark.read.parquet(f"{FOLDER}/part.parquet").collect()]
    high = 0
    for sample in range(4):
        x = [v for s, v in values if s == sample]
        mean = sum(x) / len(x)
        high += sum(v >= mean + (sum((y - mean) ** 2 for y in x) / len(x)) ** 0.5 for v in x)
    assert sum(r.ring == 0 for r in got) == high > 0


def test_lisa_finds_a_hot_spot(spark, tmp_path):
    hot = {41, 42, 81, 82, 1, 2}  # places of one sample in rows 0 to 2
    parts = [(4 * i, 1000.0 if i in hot else 900.0 + i % 7) for i in range(120)]
    spark.createDataFrame(parts, "p_partkey long, p_retailprice double").write.parquet(f"{tmp_path}/part.parquet")
    got = {r.node // 4: r for r in catalog.QUERIES["lisa_permutation"](spark, str(tmp_path)).collect()}
    assert len(got) == 120 and all(got[i].p < 0.05 and got[i].quadrant == "High-High" for i in (41, 42))
    assert all(round(r.p * 1000, 2) == int(round(r.p * 1000, 2)) >= 1 for r in got.values())
