import __spark_entry__ as entry_module
from siftwork import queries


def test_entry_and_registry(spark):
    assert entry_module.entry(spark).count() == 42
    assert set(queries.QUERIES) <= set(entry_module.queries()) and set(entry_module.oracle_sql()) <= set(entry_module.queries())


def test_some_core_queries_give_rows_on_the_smallest_tables(spark):
    for name in ("nn_counts", "cosine_pairs", "threshold_components", "differing_features", "q_check", "q_filters", "stage_times"):
        assert queries.QUERIES[name](spark, "/root/testdata/sf0.001").count() > 0, name
