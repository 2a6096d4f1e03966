"""Edge cases: short series, constant columns, malformed lines, re-ingest, changes."""

import math
import os
import random
import tempfile

import pytest
from pyspark.sql import functions as F

from wearline.operators import jobs as J
from wearline.operators import reads as RD
from wearline.operators import warehouse as W
from wearline.schema import RAW_COLUMNS, READING_COLUMNS


def _brute_degradation(rows):
    """Plain-Python statement of the job's rule for one unit: rows = [(cycle, t, p, f, c, u)]."""
    rows = sorted(rows)
    n = len(rows)
    if n < 2:
        return None
    k = min(10, n // 4)
    early = rows[:k]
    late = rows[-k:] if k else rows

    def mean(win, i):
        return sum(r[i] for r in win) / len(win) if win else 0.0

    pct = []
    for i in range(1, 6):
        e, l_ = mean(early, i), mean(late, i)
        pct.append(round((l_ - e) / abs(e) * 100, 2) if e != 0 else 0.0)
    return (rows[-1][0], *pct, round(-pct[0] + pct[1], 2),
            round(mean(early, 1), 2), round(mean(late, 1), 2),
            round(mean(early, 2), 2), round(mean(late, 2), 2))


def test_degradation_short_and_long_series(spark):
    rnd = random.Random(7)
    lines, series = [], {}
    for unit, n in enumerate([1, 2, 3, 4, 5, 39, 40, 41, 200], start=1):
        for c in rnd.sample(range(1, 500), n):
            vals = [rnd.uniform(1, 1000) for _ in range(21)]
            if unit == 5:
                vals[2] = 0.0  # sensor_3 == 0 at every cycle: early mean 0 -> 0 %
            fields = [str(unit), str(c), "0.1", "0.2", "100.0"] + [repr(v) for v in vals]
            lines.append(("train_FD001.txt", ",".join(fields)))
            series.setdefault(unit, []).append(
                (c, vals[2], vals[10], vals[7], vals[8], vals[11]))
    df = spark.createDataFrame(lines, "source string, value string")
    got = {r["unit_number"]: r for r in J.degradation_metrics(df.repartition(3)).collect()}
    for unit, rows in series.items():
        want = _brute_degradation(rows)
        if want is None:
            assert unit not in got
            continue
        g = got[unit]
        have = (g["total_cycles"], g["temp_hpc_pct_change"], g["pressure_hpc_pct_change"],
                g["fan_speed_pct_change"], g["core_speed_pct_change"],
                g["fuel_ratio_pct_change"], g["health_index"], g["early_avg_temp"],
                g["late_avg_temp"], g["early_avg_pressure"], g["late_avg_pressure"])
        assert have == pytest.approx(want, abs=0.011), unit


def test_degradation_skips_blank_separated_lines_by_default(spark):
    df = spark.createDataFrame([("train_FD001.txt", " ".join(["1"] * 26))] * 3,
                               "source string, value string")
    assert J.degradation_metrics(df).count() == 0
    assert J.degradation_metrics(df, dual=True).count() == 1


def test_constant_column_correlation_is_null(readings):
    from wearline.functions.safe import safe_corr

    row = readings.agg(safe_corr("sensor_1", "sensor_2").alias("r")).first()
    assert row["r"] is None


def test_parse_malformed_lines(spark):
    from wearline.sources.text import parse_lines_dual, parse_readings

    good = " ".join(str(i) for i in range(1, 27))
    lines = spark.createDataFrame([
        ("/x/train_FD002.txt", "  " + good.replace(" ", "   ", 1) + "  "),  # extra blanks
        ("/x/train_FD002.txt", ",".join(str(i) for i in range(1, 27))),   # comma form
        ("/x/train_FD002.txt", "1 2 3"),                                   # short
        ("/x/train_FD002.txt", good.replace(" 16 ", " x16 ")),             # letter
        ("/x/train_FD002.txt", "   "),                                     # blank
        ("/x/notes.txt", good),                                            # other file
    ], "source string, value string")
    p = parse_readings(lines).orderBy("parse_ok").collect()
    assert len(p) == 4
    assert [r["parse_ok"] for r in p] == [False, False, True, True]
    assert all(r["dataset_id"] == "FD002" and r["dataset_type"] == "train" for r in p)
    short = [r for r in p if r["time_cycles"] == 2 and r["op_setting_1"] == 3.0
             and r["sensor_1"] is None]
    assert len(short) == 1
    bad = [r for r in p if r["sensor_11"] is None and r["sensor_12"] == 17.0]
    assert len(bad) == 1
    assert parse_lines_dual(lines, 26).count() == 4


def test_file_metadata_names(spark):
    from wearline.sources.text import file_metadata

    df = spark.createDataFrame([("hdfs://n/raw/RUL_FD004.txt",), ("/a/test_FD003.txt",),
                                ("/a/source=train_FD001.txt/part-0.txt",), ("/a/x.csv",)],
                               "source string")
    ds, ty = file_metadata(F.col("source"))
    got = [tuple(r) for r in df.select(ds, ty).collect()]
    assert got == [("FD004", "rul"), ("FD003", "test"), ("FD001", "train"), (None, None)]


def test_replace_ingest_is_idempotent(spark, readings):
    from wearline.sources.ingest import data_layout, delete_partitions, replace_ingest

    path = os.path.join(tempfile.mkdtemp(prefix="wearline-ingest-"), "t")
    data_layout(readings, path)
    before = {tuple(r[:2]): r[2] for r in spark.read.parquet(path)
              .groupBy("dataset_id", "dataset_type").count().collect()}
    part = readings.where("dataset_id = 'FD001' AND dataset_type = 'test'")
    replace_ingest(part, path).collect()
    rep = replace_ingest(part, path).collect()
    assert [(r["dataset_id"], r["dataset_type"]) for r in rep] == [("FD001", "test")]
    after = {tuple(r[:2]): r[2] for r in spark.read.parquet(path)
             .groupBy("dataset_id", "dataset_type").count().collect()}
    assert after == before
    n = delete_partitions(spark, path, "FD001", "test")
    assert n == before[("FD001", "test")]
    left = {tuple(r[:2]) for r in spark.read.parquet(path)
            .select("dataset_id", "dataset_type").distinct().collect()}
    assert ("FD001", "test") not in left and ("FD001", "train") in left


def test_update_without_match_and_type_preference(spark, readings):
    none = readings.limit(0).select(*RD.ROW_KEY, "sensor_11")
    rep = RD.update_report(readings, none).first()
    assert (rep["matched_count"], rep["modified_count"]) == (0, 0)
    # both a train and a test reading share this key in the fixture
    key = readings.groupBy("dataset_id", "unit_number", "time_cycles").agg(
        F.count_distinct("dataset_type").alias("t")).where("t = 2").orderBy(
        "dataset_id", "unit_number", "time_cycles").first()
    out = RD.update_sensor_data(readings, key["dataset_id"], key["unit_number"],
                                key["time_cycles"], {"sensor_11": -1.0})
    hit = out.where("sensor_11 = -1.0").collect()
    assert len(hit) == 1 and hit[0]["dataset_type"] == "train"
    assert out.count() == readings.count()


def test_condition_key_has_no_negative_zero(spark):
    from wearline.functions.safe import condition_key

    df = spark.createDataFrame([(-0.002, -0.04, 100.0), (42.0, 0.84, 60.0), (2.5, 0.25, 0.5)],
                               "op_setting_1 double, op_setting_2 double, op_setting_3 double")
    assert [r[0] for r in df.select(condition_key()).collect()] == [
        "0-0-100", "42-0.8-60", "2-0.2-0"]


@pytest.mark.parametrize("splits", [1, 7])
def test_first_last_candidates_over_splits(spark, splits):
    from wearline.functions.series import first_last_candidates

    rows = [("A", c) for c in range(1, 1001)] + [("B", c) for c in range(5, 8)]
    df = spark.createDataFrame(rows, "k string, c int").repartition(splits)  # A spans the splits
    out = first_last_candidates(df, ["k"], ["c"], k_max=10)
    a = out.where("k = 'A'").collect()
    assert sorted(r["c"] for r in a if r["asc_rank"] <= 10) == list(range(1, 11))
    assert sorted(r["c"] for r in a if r["desc_rank"] <= 10) == list(range(991, 1001))
    assert {r["series_rows"] for r in a} == {1000}
    b = out.where("k = 'B'").collect()
    assert len(b) == 3 and {r["series_rows"] for r in b} == {3}


def test_q13_threshold_variants(readings):
    strict = W.q13_threshold_alert(readings).collect()
    loose = W.q13_threshold_alert(readings, temp_quantile=0.55, pressure_quantile=0.45).collect()
    assert len(loose) >= len(strict)


def test_csv_short_rows_fill_null(spark):
    from wearline.sources.text import csv_read

    d = tempfile.mkdtemp(prefix="wearline-csv-")
    with open(os.path.join(d, "a.csv"), "w") as f:
        f.write(",".join(["1", "2"] + ["0.5"] * 24 + ["FD001"]) + "\n")
        f.write("1,3,abc\n")
    rows = csv_read(spark, d).orderBy("time_cycles").collect()
    assert rows[0]["dataset_id"] == "FD001" and rows[0]["sensor_21"] == 0.5
    assert rows[1]["op_setting_1"] is None and rows[1]["sensor_21"] is None


def test_raw_columns_shape():
    assert len(RAW_COLUMNS) == 26 and len(READING_COLUMNS) == 28


def test_block_row_number_equals_window(spark):
    from pyspark.sql import Window

    from wearline.functions.series import block_row_number

    rnd = random.Random(3)
    rows = [(rnd.choice("xyz"), rnd.randint(1, 20), i) for i in range(2000)]
    df = spark.createDataFrame(rows, "k string, day int, id int").repartition(5)
    got = block_row_number(df, ["k"], ["day", "id"], "day", name="rn")
    want = df.withColumn("rn", F.row_number().over(Window.partitionBy("k").orderBy("day", "id")))
    assert sorted(got.select("k", "id", "rn").collect()) == sorted(
        want.select("k", "id", "rn").collect())


def test_block_row_number_with_null_blocks_and_coarse_blocks(spark):
    """Rows without a block take the first numbers and are left out, as those without a key; the
    numbers are the same for fine and for coarse blocks, and any number of ranges."""
    from pyspark.sql import Window

    from wearline.functions.series import block_row_number

    rnd = random.Random(5)
    rows = [(rnd.choice(["x", "y", "z", None]), rnd.choice([None, *range(1, 41)]), i) for i in range(2000)]
    df = spark.createDataFrame(rows, "k string, day int, id int").repartition(5)
    want = sorted(df.withColumn("rn", F.row_number().over(Window.partitionBy("k").orderBy("day", "id")))
                  .where("k IS NOT NULL AND day IS NOT NULL").select("k", "id", "rn").collect())
    for block, n in (("day", None), (F.col("day") / 10, 3), (F.floor(F.col("day") / 20), 17)):
        got = block_row_number(df, ["k"], ["day", "id"], block, name="rn", partitions=n)
        assert sorted(got.select("k", "id", "rn").collect()) == want


def test_condition_chart_only_for_multi_condition_sets(spark, readings):
    from wearline.operators.pipelines import condition_metrics_top15
    from wearline.schema import dataset_dim

    assert condition_metrics_top15(readings, dataset_dim(spark), "FD001").count() == 0
    assert condition_metrics_top15(readings, dataset_dim(spark), "FD002").count() > 0


def test_write_changes_replaces_only_touched_partition(spark, readings, tmp_path):
    from wearline.sources.ingest import data_layout

    path = str(tmp_path / "table")
    data_layout(readings, path)
    table = spark.read.parquet(path)
    before = table.groupBy("dataset_id", "dataset_type").count().collect()
    key = table.where("dataset_id = 'FD001' AND dataset_type = 'train'").orderBy(
        "unit_number", "time_cycles").first()
    changed = RD.update_sensor_data(table, "FD001", key["unit_number"], key["time_cycles"],
                                    {"sensor_11": -5.0}, "train")
    RD.write_changes(changed, path, "FD001", "train").collect()
    after = spark.read.parquet(path)
    assert sorted(after.groupBy("dataset_id", "dataset_type").count().collect()) == sorted(before)
    hit = after.where("sensor_11 = -5.0").collect()
    assert len(hit) == 1 and hit[0]["unit_number"] == key["unit_number"]


def test_degradation_json_output_form(spark):
    import json

    rows = [("train_FD001.txt", ",".join([str(u), str(c)] + ["1.5"] * 24))
            for u in (1, 2) for c in range(1, 9)]
    df = spark.createDataFrame(rows, "source string, value string")
    out = J.degradation_json(J.degradation_metrics(df)).orderBy("unit_number").collect()
    v = json.loads(out[0]["value"])
    assert v["unit"] == 1 and v["total_cycles"] == 8
    assert set(v["degradation"]) == {"temp_hpc_pct_change", "pressure_hpc_pct_change",
                                     "fan_speed_pct_change", "core_speed_pct_change",
                                     "fuel_ratio_pct_change"}
    assert v["health_index"] == 0.0 and v["early_avg_temp"] == 1.5


def test_storage_summary_areas_and_total(spark, tmp_path):
    from wearline.sources.files import list_files, storage_summary

    for area, n in (("train", 2), ("test", 1), ("rul", 1)):
        d = tmp_path / area
        d.mkdir()
        for i in range(n):
            (d / f"f{i}.txt").write_text("x" * (10 * (i + 1)))
    (tmp_path / "readme.md").write_text("abc")
    rows = {r["area"]: (r["files"], r["bytes"])
            for r in storage_summary(list_files(spark, str(tmp_path))).collect()}
    assert rows == {"train": (2, 30), "test": (1, 10), "rul": (1, 10), "other": (1, 3),
                    "TOTAL": (5, 53)}


def test_storage_summary_of_raw_files(spark, sf, tmp_path):
    """Raw files by their names, a folder of parts as one file; the whole raw text against the disk."""
    from pathlib import Path

    from wearline.plans import tables
    from wearline.plans.catalog import QUERIES
    from wearline.sources.files import list_files, raw_files, storage_summary

    for name, n in (("train_FD001.txt/part-0.txt", 5), ("train_FD001.txt/part-1.txt", 7), ("test_FD001.txt", 3),
                    ("RUL_FD002.txt", 2), ("old.txt", 1)):
        f = tmp_path / name
        f.parent.mkdir(exist_ok=True)
        f.write_text("x" * n)
    listed = list_files(spark, str(tmp_path))
    assert {r.path.split("/")[-1]: (r.length, int(r.modified.timestamp())) for r in listed.collect()} == {
        f.name: (f.stat().st_size, int(f.stat().st_mtime)) for f in tmp_path.rglob("*.txt") if f.is_file()}
    assert {tuple(r) for r in storage_summary(raw_files(listed)).collect()} == {
        ("train", 1, 12), ("test", 1, 3), ("rul", 1, 2), ("other", 1, 1), ("TOTAL", 4, 18)}

    got = {r.area: (r.files, r.bytes) for r in QUERIES["storage_summary"](spark, sf).collect()}
    want = {}
    for root in (tables.lines_path(spark, sf, "mixed"), tables.rul_lines_path(spark, sf)):
        for f in Path(root.removeprefix("file:")).rglob("part-*.txt"):
            file = f.parent.name.removeprefix("source=")
            for area in (file.split("_")[0].lower(), "TOTAL"):
                files, size = want.setdefault(area, [set(), 0])
                want[area] = [files | {file}, size + f.stat().st_size]
    assert got == {area: (len(files), size) for area, (files, size) in want.items()} and len(got) == 4


def test_ingest_statuses_names_and_deliveries(spark, tmp_path):
    """Newest delivery of a name wins, whole names only, every file is reported."""
    from wearline.sources.ingest import ingest_files

    good = " ".join(["0.5"] * 24)

    def put(name, text, when):
        f = tmp_path / "raw" / name
        f.parent.mkdir(parents=True, exist_ok=True)
        f.write_text(text)
        os.utime(f, (when, when))

    put("a/train_FD001.txt", f"1 1 {good}\n1 2 {good}\n1 3 {good}\n", 2000)
    put("b/train_FD001.txt", f"9 1 {good}\n", 1000)  # older, though later in path order
    put("a/test_FD001.txt", f"1 1 {good}\n1 2 x\n", 1000)
    put("a/train_FD002.txt", "a b c\n", 1000)
    put("a/test_FD002.txt", "", 1000)  # Spark's readers do not list empty files
    put("a/train_FD003.txt.bak", f"1 1 {good}\n", 1000)
    put("a/my_train_FD003.txt", f"1 1 {good}\n", 1000)
    put("train_FD004.txt_old/RUL_FD002.txt", "7 \n", 1000)
    put("parts/train_FD004.txt/part-0", f"1 1 {good}\n", 1000)
    put("parts/train_FD004.txt/part-1", f"1.0 2.0 {good}\n", 1500)
    table, labels = str(tmp_path / "t"), str(tmp_path / "l")
    got = {(r["file_name"], r["status"], r["rows"], r["bad_rows"])
           for r in ingest_files(spark, str(tmp_path / "raw"), table, labels).collect()}
    assert got == {
        ("train_FD001.txt", "success", 3, 0), ("train_FD001.txt", "superseded", None, None),
        ("test_FD001.txt", "partial", 2, 1), ("train_FD002.txt", "failure", 1, 1),
        ("train_FD003.txt.bak", "skipped", None, None),
        ("my_train_FD003.txt", "skipped", None, None), ("RUL_FD002.txt", "success", 1, 0),
        ("train_FD004.txt", "success", 2, 0)}
    rows = spark.read.parquet(table)
    assert rows.where("dataset_id = 'FD001' AND dataset_type = 'train'").count() == 3
    assert {(r.unit_number, r.time_cycles) for r in rows.where("dataset_id = 'FD004'").collect()} == {(1, 1), (1, 2)}


def _readings(spark, rows):
    """(unit, cycle, sensor_11) rows of FD001 train, every other value 1."""
    from wearline.schema import READINGS_SCHEMA

    def full(u, c, s, kind):
        return tuple(u if f.name == "unit_number" else c if f.name == "time_cycles" else s if f.name == "sensor_11"
                     else "FD001" if f.name == "dataset_id" else kind if f.name == "dataset_type" else 1.0
                     for f in READINGS_SCHEMA.fields)

    return spark.createDataFrame([full(*r) for r in rows], READINGS_SCHEMA)


NULL_ROWS = [(1, 1, 5.0, "train"), (1, 2, 7.0, "train"), (None, 1, 3.0, "train"), (None, 4, 4.0, "train"),
             (2, None, 9.0, "train"), (2, 3, 2.0, "train"), (3, 1, None, "train")]


def test_series_joins_lose_no_row(spark):
    from wearline.operators.ml import rul_label

    r = _readings(spark, NULL_ROWS)
    drift = {(x.unit_number, x.time_cycles): x.pressure_drift for x in W.q12_drift(r).collect()}
    assert drift == {(1, 1): 0.0, (1, 2): 2.0, (None, 1): 0.0, (None, 4): 1.0, (2, None): 0.0, (2, 3): -7.0, (3, 1): None}
    rul = {(x.unit_number, x.time_cycles): x.rul for x in rul_label(r).collect()}
    assert rul == {(1, 1): 1.0, (1, 2): 0.0, (None, 1): 3.0, (None, 4): 0.0, (2, None): None, (2, 3): 0.0, (3, 1): 0.0}


def test_scoring_keeps_rows_with_missing_features(spark):
    from wearline.operators import ml as ML

    train = _readings(spark, [(u, c, float(c), "train") for u in range(1, 6) for c in range(1, 9)] + NULL_ROWS[2:])
    report = ML.training_report(train).first()
    assert report["training_rows"] + report["left_out"] == 45 and report["left_out"] == 2
    model = ML.train_rul_model(train, num_trees=3, max_depth=3)
    test = _readings(spark, [(1, 1, 1.0, "test"), (1, 2, None, "test"), (2, 1, None, "test")])
    scored = ML.predict_rul(model, test)
    got = {(r.unit_number, r.time_cycles): (r.prediction is None, r.reason) for r in scored.collect()}
    assert got == {(1, 1): (False, None), (1, 2): (True, "missing feature"), (2, 1): (True, "missing feature")}
    latest = {r.unit_number: (r.current_cycle, r.predicted_rul) for r in ML.rul_latest(scored).collect()}
    assert latest == {1: (2, None), 2: (1, None)}


def test_whole_numbers_follow_one_rule(spark):
    from wearline.sources.text import parse_readings

    good = " ".join(["0.5"] * 24)
    lines = spark.createDataFrame([("/d/train_FD001.txt", f"1.0 2.7 {good}"), ("/d/train_FD001.txt", f"x 1e1 {good}")],
                                  "source string, value string")
    assert [(r.unit_number, r.time_cycles) for r in parse_readings(lines).collect()] == [(1, 2), (None, 10)]


def _discrete(values, q):
    v = sorted(x for x in values if x is not None and not math.isnan(x))
    return v[max(0, math.ceil(q * len(v)) - 1)] if v else None


@pytest.mark.parametrize("n,sketch,inside", [(1, 4096, 100_000), (2, 8, 1), (7, 4096, 100_000), (1000, 64, 20), (20_000, 4096, 100_000),
                                             (20_000, 200, 50)])
def test_exact_quantiles(spark, n, sketch, inside):
    """Also with brackets that take several narrowing passes, ties, NULL and NaN values."""
    from wearline.functions.quantiles import exact_quantiles

    rnd = random.Random(n)
    rows = [(rnd.choice(["a", "b", None]), rnd.choice([None, math.nan, float(rnd.randint(0, 50)), rnd.random(), rnd.gauss(0, 1e6)]),
             rnd.randint(1, 400)) for _ in range(n)]
    df = spark.createDataFrame(rows, "dataset_id string, v double, w int").repartition(4).cache()
    wanted = {f"{c}{q}": (c, q) for c in "vw" for q in (0.0, 0.05, 0.5, 0.95, 1.0)}
    got = {r.dataset_id: r for r in exact_quantiles(df, ["dataset_id"], wanted, sketch, inside, small=0).collect()}
    whole = exact_quantiles(df, [], wanted, sketch, inside, small=0).first()
    # a small input in one aggregate
    assert {r.dataset_id: r for r in exact_quantiles(df, ["dataset_id"], wanted, small=1 << 40).collect()} == got
    assert exact_quantiles(df, [], wanted, small=1 << 40).first() == whole
    for name, (c, q) in wanted.items():
        i = "vw".index(c) + 1
        assert whole[name] == _discrete([r[i] for r in rows], q)
        for g in {r[0] for r in rows}:
            assert got[g][name] == _discrete([r[i] for r in rows if r[0] == g], q)
    assert got.keys() == {r[0] for r in rows}


def test_exact_quantiles_of_nothing(spark):
    from wearline.functions.quantiles import exact_quantiles

    df = spark.createDataFrame([("a", None)], "dataset_id string, v double")
    for small in (0, 1 << 40):
        assert exact_quantiles(df, ["dataset_id"], {"q": ("v", 0.5)}, small=small).collect() == [("a", None)]
        assert exact_quantiles(df.limit(0), [], {"q": ("v", 0.5)}, small=small).collect() == [(None,)]
    with pytest.raises(ValueError):
        exact_quantiles(df, ["v"], {"q": ("v", 0.5)})


def test_update_can_set_null(spark, readings):
    first = readings.orderBy(*RD.ROW_KEY).limit(1).select(*RD.ROW_KEY)
    ups = first.withColumn("sensor_11", F.lit(None).cast("double"))
    assert RD.apply_updates(readings, ups).where("sensor_11 IS NULL").count() == 0
    assert RD.apply_updates(readings, ups, null_means_keep=False).where("sensor_11 IS NULL").count() == 1


def test_duplicate_update_keys_do_not_add_rows(spark, readings):
    first = readings.orderBy(*RD.ROW_KEY).limit(1).select(*RD.ROW_KEY)
    ups = first.withColumn("sensor_11", F.lit(1.0)).unionByName(
        first.withColumn("sensor_11", F.lit(2.0)))
    out = RD.apply_updates(readings, ups)
    assert out.count() == readings.count()
    assert out.where("sensor_11 = 2.0").count() == 1
    rep = RD.update_report(readings, ups).first()
    assert rep["matched_count"] == 1


def test_ingest_files_raw_folder(spark, tmp_path):
    from wearline.sources.ingest import ingest_files

    raw = tmp_path / "raw"
    raw.mkdir()
    good = " ".join(["0.5"] * 24)
    (raw / "train_FD003.txt").write_text(
        "".join(f"{u} {c}  {good} \n" for u in (1, 2) for c in (1, 2, 3)))
    (raw / "test_FD003.txt").write_text(f"1 1 {good}\n1 2 x {good}\n")
    (raw / "RUL_FD003.txt").write_text("112 \n98 \n")
    (raw / "readme.md").write_text("not data\n")
    table, labels = str(tmp_path / "t"), str(tmp_path / "l")
    rep = {r["file_name"]: (r["rows"], r["bad_rows"], r["status"])
           for r in ingest_files(spark, str(raw), table, labels).collect()}
    assert rep == {"train_FD003.txt": (6, 0, "success"), "test_FD003.txt": (2, 1, "partial"),
                   "RUL_FD003.txt": (2, 0, "success"), "readme.md": (None, None, "skipped")}
    t = spark.read.parquet(table)
    assert t.count() == 8 and t.where("dataset_id = 'FD003'").count() == 8
    assert sorted(r["rul"] for r in spark.read.parquet(labels).collect()) == [98.0, 112.0]
    # ingesting the same folder again replaces, never duplicates
    ingest_files(spark, str(raw), table, labels).collect()
    assert spark.read.parquet(table).count() == 8
    assert spark.read.parquet(labels).count() == 2


def test_degradation_exact_when_one_unit_dominates(spark):
    rnd = random.Random(11)
    lines, series = [], {}
    sizes = {1: 5000, 2: 7, 3: 40, 4: 2}  # unit 1 holds most lines, spread over partitions
    for unit, n in sizes.items():
        for c in rnd.sample(range(1, 20000), n):
            vals = [rnd.uniform(1, 1000) for _ in range(21)]
            fields = [str(unit), str(c), "0.1", "0.2", "100.0"] + [repr(v) for v in vals]
            lines.append(("train_FD002.txt", ",".join(fields)))
            series.setdefault(unit, []).append(
                (c, vals[2], vals[10], vals[7], vals[8], vals[11]))
    rnd.shuffle(lines)
    df = spark.createDataFrame(lines, "source string, value string").repartition(6)
    got = {r["unit_number"]: r for r in J.degradation_metrics(df).collect()}  # partition salt
    for unit, rows in series.items():
        want = _brute_degradation(rows)
        g = got[unit]
        have = (g["total_cycles"], g["temp_hpc_pct_change"], g["pressure_hpc_pct_change"],
                g["fan_speed_pct_change"], g["core_speed_pct_change"],
                g["fuel_ratio_pct_change"], g["health_index"], g["early_avg_temp"],
                g["late_avg_temp"], g["early_avg_pressure"], g["late_avg_pressure"])
        assert have == pytest.approx(want, abs=0.011), unit


@pytest.mark.parametrize("n", [1, 2, 3])
def test_parse_head_equals_full_parse_prefix(spark, n):
    from wearline.sources.text import parse_head, parse_lines_dual

    vals = ["1 2 3", "  7\t 8  ", "5", "a,b", "1,,3", ",2", "x y", "  ", "1, 2 ,3",
            "9 10 11 12", "3,4,5,6", "\t", "4  5\t6"]
    df = spark.createDataFrame([("s", v) for v in vals], "source string, value string")
    full = sorted(tuple(r[0][:n]) for r in parse_lines_dual(df, n).select("fields").collect())
    head = sorted(tuple(r[0]) for r in parse_head(df, n).select("fields").collect())
    assert head == full


def test_reference_subsets_by_parameters(readings):
    """The warehouse queries' own subsets (units <= 10, unit 1 first 100 cycles, units <= 5
    first 200 rows) are parameters of the operators; the catalogue runs whole tables."""
    q11 = W.q11_cycle_windows(readings, max_unit=10)
    whole = W.q11_cycle_windows(readings)
    assert q11.agg(F.sum("observation_count")).first()[0] <= whole.agg(
        F.sum("observation_count")).first()[0]
    q12 = W.q12_drift(readings, unit_number=1, limit=100).collect()
    assert len(q12) <= 100 and {r["unit_number"] for r in q12} <= {1}
    assert [r["time_cycles"] for r in q12] == sorted(r["time_cycles"] for r in q12)
    if q12:
        assert q12[0]["pressure_drift"] == 0.0
    q18 = W.q18_ml_features(readings, max_unit=5, limit=200).collect()
    assert len(q18) <= 200 and all(r["unit_number"] <= 5 for r in q18)


@pytest.mark.parametrize("seed", range(4))
def test_exact_means_in_any_order(spark, seed):
    """Within one unit in the last place of the exact mean, and the same bits for any splits."""
    from fractions import Fraction

    from wearline.functions.sums import mean_text, with_parts

    rnd = random.Random(seed)
    rows = [(rnd.randint(0, 3), rnd.choice([None, rnd.uniform(-2000, 2000), rnd.gauss(0, 1e-3), 518.67, 0.1, rnd.uniform(0, 2 ** 20)]))
            for _ in range(2000)] + [(4, None), (5, math.inf), (5, 1.0), (6, math.nan), (6, 1.0), (7, 3e280), (7, 1.0)]
    df = spark.createDataFrame(rows, "k int, x double")
    found = set()
    for i in range(5):
        got = {r.k: r.m for r in df.repartition(i * 3 + 1).transform(with_parts, ["k"], ["x"]).groupBy("k").agg(F.expr(mean_text("x")).alias("m")).collect()}
        found.add(tuple(sorted((k, v) for k, v in got.items() if k < 4)))
        assert got[4] is None and got[5] == math.inf and math.isnan(got[6]) and got[7] == 1.5e280
    assert len(found) == 1
    for k in range(4):
        v = [x for g, x in rows if g == k and x is not None]
        exact = sum(map(Fraction, v)) / len(v)
        assert abs(Fraction(got[k]) - exact) <= 2 * Fraction(math.ulp(float(exact)))


def test_means_do_not_depend_on_the_splits(readings):
    from wearline.operators import pipelines as P

    results = {(tuple(map(tuple, P.degradation_trend(x).collect())), tuple(map(tuple, P.condition_metrics(x).collect())))
               for x in (readings, readings.repartition(3), readings.repartition(17))}
    assert len(results) == 1


def test_distinct_numbers_by_bitmap(spark):
    from wearline.functions.distinct import distinct_numbers

    rnd = random.Random(2)
    rows = [(rnd.choice("abc"), rnd.choice([None, -3, 0, 32_767, 32_768, 10 ** 9, rnd.randint(0, 500)])) for _ in range(3000)] + [("d", None)]
    df = spark.createDataFrame(rows, "k string, n int").repartition(5)
    got = {r.k: r.n for r in df.groupBy("k").agg(distinct_numbers("n").alias("n")).collect()}
    assert got == {k: len({n for g, n in rows if g == k and n is not None}) for k in "abcd"}


def test_fleet_summary_counts_units_without_a_number(spark):
    from wearline.operators.pipelines import fleet_summary
    from wearline.schema import dataset_dim

    rows = [("FD001", "train", 1), ("FD001", "train", 1), ("FD001", "test", 1), ("FD009", "train", None), ("FD009", "train", 70_000)]
    got = fleet_summary(spark.createDataFrame(rows, "dataset_id string, dataset_type string, unit_number int"), dataset_dim(spark)).collect()
    assert [(r.dataset_id, r.train_count, r.test_count) for r in got] == [("FD001", 2, 1), ("FD009", 2, 0)]
    assert {(r.total_records, r.distinct_unit_numbers, r.engines, r.dataset_ids) for r in got} == {(5, 2, 4, "FD001,FD009")}


@pytest.mark.parametrize("bins", [1, 3, 7])
def test_lifetime_histogram(spark, bins):
    rnd = random.Random(bins)
    rows = [(rnd.choice(["FD001", None]), "train", u, rnd.choice([5, 5, rnd.randint(1, 40)])) for u in range(200)]
    df = spark.createDataFrame(rows, "dataset_id string, dataset_type string, unit_number int, max_cycle int")
    got = {(r.dataset_id, r.bin): (r.lower_life, r.upper_life, r.units) for r in J.lifetime_histogram(df, bins).collect()}
    for d in ("FD001", None):
        v = sorted(x for i, _, _, x in rows if i == d)
        ends = [v[max(0, math.ceil(len(v) * i / bins) - 1)] for i in range(bins + 1)]
        left = list(v)
        for i in range(1, bins + 1):
            inside = [x for x in left if x <= ends[i]]
            left = left[len(inside):]
            assert got[d, i] == (ends[i - 1], ends[i], len(inside))
        assert not left


def test_file_inventory_against_the_file_system(spark, tmp_path):
    from wearline.sources.files import file_inventory, list_files, raw_files

    sizes = {}
    for area, name, parts in (("train", "train_FD001.txt", 3), ("train", "train_FD002.txt", 1), ("rul", "RUL_FD001.txt", 2)):
        folder = tmp_path / area / f"source={name}"
        folder.mkdir(parents=True)
        for i in range(parts):
            (folder / f"part-{i}.txt").write_text("x" * (10 + i + len(name)))
            os.utime(folder / f"part-{i}.txt", (1_700_000_000 + i, 1_700_000_000 + i))
        sizes[area, name] = (sum(p.stat().st_size for p in folder.iterdir()), 1_700_000_000 + parts - 1)
    (tmp_path / "other").mkdir()
    (tmp_path / "other" / "notes.txt").write_text("abc")
    files = raw_files(list_files(spark, [str(tmp_path / "train"), str(tmp_path / "rul"), str(tmp_path / "other")], "*.txt"))
    got = {(r.area, r.file_name): r for r in file_inventory(files).collect()}
    for (area, name), (size, date) in sizes.items():
        r = got[area, name]
        assert (r.files, r.bytes, int(r.modified.timestamp()), r.dataset_id) == (1, size, date, name[-9:-4])
    total = sum(s for s, _ in sizes.values())
    assert (got["TOTAL", "*"].files, got["TOTAL", "*"].bytes) == (4, total + 3)
    assert got["train", "*"].files == 2 and got["other", "notes.txt"].bytes == 3


def test_ingest_reports_are_appended(spark, tmp_path):
    from wearline.sources.ingest import ingest_files, ingest_reports

    raw = tmp_path / "raw"
    raw.mkdir()
    line = " ".join(["1", "1", *["0.5"] * 24])
    (raw / "train_FD001.txt").write_text(f"{line}\n{line}\n")
    (raw / "notes.txt").write_text("x\n")
    runs = [ingest_files(spark, str(raw), str(tmp_path / "t"), report_path=str(tmp_path / "reports")) for _ in range(2)]
    for r in runs:
        assert sorted((x.file_name, x.rows, x.status) for x in r.collect()) == [("notes.txt", None, "skipped"), ("train_FD001.txt", 2, "success")]
    table = ingest_reports(spark, str(tmp_path / "reports"))
    assert table.count() == 4 and table.select("run").distinct().count() == 2


def test_ingest_of_files_in_unit_order_shuffles_no_rows(spark, tmp_path, monkeypatch):
    """Parts in unit order are parsed into the table straight; parts whose units overlap are
    ranged.  Rows, order and report are the same."""
    from wearline.sources import ingest

    ranged = []
    real = ingest._layout_frame
    monkeypatch.setattr(ingest, "_layout_frame", lambda *a: ranged.append(1) or real(*a))

    def load(name, *parts):
        folder = tmp_path / name / "raw" / "train_FD001.txt"
        folder.mkdir(parents=True)
        for i, units in enumerate(parts):
            (folder / f"part-{i}").write_text("".join(
                f"{u} {c} " + " ".join(["x" if (u, c) == (3, 2) else "0.5"] * 24) + "\n" for u in units for c in (2, 1)))
        (tmp_path / name / "raw" / "test_FD001.txt").write_text("\n \n")  # nothing to load
        table = str(tmp_path / name / "table")
        report = ingest.ingest_files(spark, str(tmp_path / name / "raw"), table).collect()
        for f in (tmp_path / name / "table").rglob("part-*.parquet"):
            keys = [(r.unit_number, r.time_cycles) for r in spark.read.parquet(str(f)).collect()]
            assert keys == sorted(keys)
        return sorted(map(str, report)), sorted(map(str, spark.read.parquet(table).collect()))

    straight = load("a", [4, 5], [1, 2], [2, 3])  # unit 2 goes on in the next part
    assert not ranged and len(straight[1]) == 12
    assert any("train_FD001.txt" in r and "rows=12, bad_rows=1" in r for r in straight[0])
    assert load("b", [4, 1], [5, 2], [2, 3]) == straight
    assert ranged


def test_readings_in_ranges_are_rewritten_where_they_lie(spark, sf, readings, tmp_path, monkeypatch):
    """A stored table's tasks hold ranges of units: loading it again shuffles no rows.  Others do."""
    from wearline.plans import catalog
    from wearline.session import own_splits
    from wearline.sources import ingest as IN

    dealt = str(tmp_path / "dealt")
    readings.repartition(3).write.parquet(dealt)
    expected = {tuple(r) for r in readings.groupBy("dataset_id", "dataset_type").count().collect()}
    with own_splits(spark):
        assert IN.in_unit_ranges(readings)
        assert not IN.in_unit_ranges(spark.read.parquet(dealt))
        monkeypatch.setattr(IN, "_layout_frame", lambda *a: pytest.fail("rows were shuffled"))
        IN.data_layout(readings, str(tmp_path / "t"), ranged=True)
    assert spark.read.parquet(str(tmp_path / "t")).exceptAll(readings).isEmpty()
    assert {tuple(r) for r in catalog.QUERIES["replace_ingest"](spark, sf).collect()} == expected
    left = {tuple(r) for r in catalog.QUERIES["delete_stored"](spark, sf).collect()}
    gone = next(n for d, t, n in expected if (d, t) == ("FD002", "test"))
    assert left == {(d, t, n, gone) for d, t, n in expected if (d, t) != ("FD002", "test")}
