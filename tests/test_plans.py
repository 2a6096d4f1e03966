"""Physical plan properties: pruning, push-down, no Python in the hot path, partial aggs."""

import pytest

from __spark_entry__ import queries


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_dataset_filter_prunes_partitions_and_columns(spark, sf):
    plan = _plan(queries()["q02_group_by_unit"](spark, sf))
    assert "PartitionFilters: [isnotnull(dataset_id" in plan
    assert "ReadSchema: struct<unit_number:int,time_cycles:int>" in plan


def test_unit_filter_is_pushed_to_parquet(spark, readings):
    from wearline.operators.reads import unit_series

    plan = _plan(unit_series(readings, 3))
    assert "PushedFilters: [IsNotNull(unit_number), EqualTo(unit_number,3)]" in plan


@pytest.mark.parametrize("name", sorted(set(queries()) - {"predict_rul", "rul_latest", "train_rul_model", "model_folds", "model_io"}))
def test_no_python_udf_or_cross_join_in_plans(spark, sf, name):
    plan = _plan(queries()[name](spark, sf))
    for node in ("BatchEvalPython", "ArrowEvalPython", "FlatMapGroupsInPandas",
                 "MapInPandas", "PythonUDF"):
        assert node not in plan, (name, node)
    # no cross joins: one-row statistics are scalar subqueries
    for node in ("CartesianProduct", "BroadcastNestedLoopJoin"):
        assert node not in plan, (name, node)


def test_feature_summary_aggregates_partially(spark, sf):
    plan = _plan(queries()["feature_summary"](spark, sf))
    assert "partial_count" in plan or "partial_" in plan


def test_train_test_join_sees_aggregated_sides(spark, sf):
    df = queries()["q17_train_test_join"](spark, sf)
    opt = df._jdf.queryExecution().optimizedPlan().toString()
    # each join input is an Aggregate (one row per unit and side)
    join_at = opt.find("Join Inner")
    assert join_at >= 0 and opt.count("Aggregate", join_at) >= 2


def test_global_statistics_are_one_reused_subquery(spark, sf):
    df = queries()["q09_anomalies"](spark, sf)
    df.collect()
    final = df._jdf.queryExecution().executedPlan().toString()
    assert "Subquery" in final and "CartesianProduct" not in final


def test_degradation_reduces_each_split_before_the_shuffle(spark):
    """One unit of 3,000 rows in six splits: at most 2 k rows a split are shuffled, once."""
    from wearline.functions.series import first_last_candidates

    df = spark.range(3000, numPartitions=6).selectExpr("'u' AS unit", "CAST(id AS INT) AS cycle")
    out = first_last_candidates(df, ["unit"], ["cycle"], k_max=10)
    rows = out.collect()
    assert len(rows) == 6 * 20 and {r.series_rows for r in rows} == {3000}
    assert sorted(r.cycle for r in rows if r.asc_rank <= 10) == list(range(10))
    plan = _plan(out).split("Initial Plan")[0]
    assert plan.count("Exchange hashpartitioning") == 1
    assert plan.index("Exchange hashpartitioning") < plan.index("MapInArrow")  # printed from the result down


def test_series_numbering_has_no_window_over_a_whole_series(spark, sf):
    from wearline.sources.fixtures import load_table, readings_from_lineitem

    import re

    plan = _plan(readings_from_lineitem(load_table(spark, sf, "lineitem")))
    specs = re.findall(r"row_number\(\) windowspecdefinition\(([^)]*)", plan)
    # every row_number window is partitioned by (series, ship-date block)
    assert specs and all("_blk" in spec for spec in specs), specs


def test_series_join_splits_a_hot_unit(spark):
    """Half of the rows on one unit, no broadcast: the join's largest partition is split."""
    conf = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
            "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "64k",
            "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5",
            "spark.sql.adaptive.advisoryPartitionSizeInBytes": "64k",
            "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    old = {k: spark.conf.get(k, None) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        df = spark.range(300_000).selectExpr("CASE WHEN id % 2 = 0 THEN 1L ELSE id % 1000 END AS u", "id AS c",
                                             "rand(1) AS s").repartition(16)
        from wearline.functions.series import attach_series_aggregates, first_by

        out = attach_series_aggregates(df, ["u"], first_by("s", "c").alias("first"))
        assert out.count() == 300_000
        rows = out.agg({"first": "count", "c": "sum", "s": "sum"})
        rows.collect()
        assert "skew=true" in rows._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in old.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


@pytest.mark.parametrize("name", ["feature_summary", "sensor_statistics", "degradation_trend"])
def test_wide_aggregates_are_compiled(spark, sf, name):
    """Every hash aggregate is part of a generated stage (the few result rows may be collected)."""
    df = queries()[name](spark, sf)
    df.collect()
    lines = [x for x in _plan(df).split("Initial Plan")[0].splitlines() if " HashAggregate(" in x]
    assert lines and all("*(" in x for x in lines), lines


def test_quantiles_read_the_table_twice(spark, readings):
    """One scan for the sketches (run before), one pass for the result."""
    from wearline.functions.quantiles import exact_quantiles

    out = exact_quantiles(readings, ["dataset_id"], {"a": ("sensor_3", 0.5), "b": ("sensor_11", 0.1)}, small=0)
    plan = _plan(out)
    assert plan.count("FileScan") == 1 and "Window" not in plan and "Join" not in plan


def test_fleet_summary_scans_and_groups_once(spark, sf):
    plan = _plan(queries()["fleet_summary"](spark, sf))
    assert plan.count("FileScan") == 1
    assert "keys=[dataset_id#" in plan and "unit_number#" not in "".join(x for x in plan.splitlines() if "keys=[" in x and "unit_number" in x.split("functions")[0])


def test_readings_are_shuffled_narrow_and_once(spark, sf):
    """Numbering joins nothing and deals the table once, before the sensors are computed; the
    stored layout adds no shuffle."""
    from wearline.sources.fixtures import load_table, readings_from_lineitem

    df = readings_from_lineitem(load_table(spark, sf, "lineitem"))
    plan = _plan(df).split("Initial Plan")[0]
    assert "Join" not in plan and plan.count("Exchange rangepartitioning") == 1
    assert plan.index("518.5 AS ") < plan.index("Exchange rangepartitioning")  # printed from the result down
    assert "_blk" in plan.split("Exchange rangepartitioning")[1].splitlines()[0]


def test_text_and_csv_writes_do_not_sort_wide_rows(spark, sf, monkeypatch, tmp_path):
    """Few file names are written side by side; parts are compressed except for the listings."""
    from wearline.plans import tables
    from wearline.sources import text

    monkeypatch.setattr(tables, "scratch_dir", lambda s: str(tmp_path))
    tables._LAYOUTS.clear(), tables._FRAMES.clear()
    open_now = []
    real = tables.open_writers
    for module in (tables, text):
        monkeypatch.setattr(module, "open_writers", lambda s: open_now.append(1) or real(s))
    try:
        a = tables.lines(spark, sf, "blank").select("value")
        b = tables.lines(spark, sf, "blank", plain=True).select("value")
        tables.rul_text(spark, sf)
        assert a.count() == b.count() > 0 and a.exceptAll(b).count() == 0
        assert {p.suffix for p in tmp_path.rglob("*-gz/source=*/part-*")} == {".gz"}
        assert {p.suffix for p in tmp_path.rglob("lines-blank/source=*/part-*")} == {".txt"}
        text.csv_write(tables.readings_unstored(spark, sf).limit(50), str(tmp_path / "csv"))
        assert len(open_now) == 4
        assert spark.conf.get("spark.sql.maxConcurrentOutputFileWriters") == "0"
    finally:
        tables._LAYOUTS.clear(), tables._FRAMES.clear()


def test_a_numbering_task_sorts_few_rows(spark):
    """Tasks follow the table's estimated size (here of generated rows, nothing is run)."""
    import re

    from wearline.sources.fixtures import readings_from_lineitem

    rows = 30_000_000
    cols = [f"id AS {c}" for c in ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber")]
    cols += [f"CAST(id AS DOUBLE) AS {c}" for c in ("l_quantity", "l_extendedprice", "l_discount", "l_tax")]
    cols += ["CAST(id AS STRING) AS l_returnflag", "CAST(id AS STRING) AS l_linestatus", "timestamp_seconds(id) AS l_shipdate"]
    df = readings_from_lineitem(spark.range(rows).selectExpr(*cols))
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    tasks = int(re.search(r"RepartitionByExpression \[.*\], (\d+)", plan).group(1))
    assert rows / tasks <= 150_000


def test_job_result_filter_stores_one_text(spark, sf, monkeypatch, tmp_path):
    from wearline.plans import tables

    monkeypatch.setattr(tables, "scratch_dir", lambda s: str(tmp_path))
    tables._LAYOUTS.clear(), tables._FRAMES.clear()
    try:
        assert queries()["job_result_filter"](spark, sf).count() == 6
        assert len({p for p in tmp_path.rglob("lines-*") if p.is_dir()}) == 1
    finally:
        tables._LAYOUTS.clear(), tables._FRAMES.clear()
