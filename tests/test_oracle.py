"""Every catalogue query against its DuckDB oracle on the smallest table folder."""

import pytest

from __spark_entry__ import oracle_sql, queries
from tools.check_oracle import compare

# model training: covered by test_ml, against a walk through the nodes and a known best error
SLOW = {"predict_rul", "rul_latest", "train_rul_model", "model_folds", "model_io"}
# what SQL cannot state: a model's numbers, and the dates of files (test_edges, against the file system)
NO_SQL = {"predict_rul", "rul_latest", "train_rul_model", "model_folds", "file_inventory"}


@pytest.mark.parametrize("name", sorted(set(queries()) - SLOW))
def test_query_matches_oracle(spark, duck, sf, name):
    res = compare(spark, duck, name, sf, queries()[name], oracle_sql().get(name))
    assert res["status"] in ("EXACT", "rows-only"), res


def test_every_catalogue_query_has_an_oracle():
    from wearline.plans.catalog import QUERIES

    assert set(QUERIES) - NO_SQL == set(oracle_sql()) & set(QUERIES)


def test_entry_runs(spark):
    from __spark_entry__ import entry

    df = entry(spark)
    assert df.columns == ["unit_number", "max_life", "avg_temp_lpc", "avg_temp_hpc",
                          "avg_pressure_hpc", "health_index"]
    rows = df.collect()
    assert rows and all(r.max_life >= 1 and r.health_index is not None for r in rows)
