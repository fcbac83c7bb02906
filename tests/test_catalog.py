"""Every core query that has SQL against DuckDB on the smallest tables."""

import os

import pytest

from wingbeat.plans import catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings".split()
#: One of each family here; all of them are compared by the driver.
NAMES = [
    "prepare_training_set", "prepare_multilabel", "select_task_splits", "weighted_sample", "mix_pairs", "inject_nocall", "add_noise", "scale_features_robust", "mel_features", "cluster_events", "cluster_events_fixed",
    "split_by_file", "kfold_by_file", "kfold_by_site", "tail_split", "tail_split_by_site", "train_test_split", "average_precision", "auroc_macro", "metric_set", "metric_states", "map_codes", "known_codes", "unmatched_codes", "class_mask", "restrict_logits",
    "event_rows", "event_rows_sql", "level_events", "read_vocabulary", "read_code_list", "write_codes", "write_metrics", "write_read_prepared", "list_noise_files", "stream_explode_events", "stream_metric_counts", "stream_metric_states",
]


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    if not os.path.isdir(SF):
        pytest.skip("no tables")
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def plain(v):
    return round(float(v), 6) + 0.0 if isinstance(v, float) or type(v).__name__ == "Decimal" else v


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, duck, name):
    df = catalog.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted(str([plain(r[c]) for c in columns]) for r in df.collect())
    want = duck.sql(catalog.ORACLES[name])
    at = [want.columns.index(c) for c in columns]
    assert got == sorted(str([plain(r[i]) for i in at]) for r in want.fetchall())
