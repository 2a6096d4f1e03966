"""Streaming ingest: files dropped into a folder land in the partitioned table."""

def test_stream_ingest_replaces_partitions(spark, tmp_path):
    from wearline.streaming.ingest import ingest_stream

    src = tmp_path / "drop"
    src.mkdir()
    good = " ".join(str(float(i)) for i in range(26))

    def line(unit, cycle):
        return f"{unit} {cycle} " + good.split(" ", 2)[2] + "  \n"

    (src / "train_FD001.txt").write_text("".join(line(u, c) for u in (1, 2) for c in (1, 2, 3)))
    (src / "test_FD001.txt").write_text("".join(line(1, c) for c in (1, 2)))
    (src / "notes.txt").write_text("not data\n")
    (src / "RUL_FD001.txt").write_text("112 \n98 \n")
    table, labels = str(tmp_path / "table"), str(tmp_path / "labels")
    q = ingest_stream(spark, str(src), table, checkpoint=str(tmp_path / "ckpt"),
                      labels_path=labels)
    q.awaitTermination(120)
    counts = {(r[0], r[1]): r[2] for r in spark.read.parquet(table)
              .groupBy("dataset_id", "dataset_type").count().collect()}
    assert counts == {("FD001", "train"): 6, ("FD001", "test"): 2}
    assert sorted(r["rul"] for r in spark.read.parquet(labels).collect()) == [98.0, 112.0]

    # a later file for the same data set and type replaces that partition only
    (src / "delivery-2").mkdir()
    (src / "delivery-2" / "train_FD001.txt").write_text(
        "".join(line(7, c) for c in (1, 2, 3, 4)))
    q = ingest_stream(spark, str(src), table, checkpoint=str(tmp_path / "ckpt"),
                      labels_path=labels)
    q.awaitTermination(120)
    rows = spark.read.parquet(table)
    counts = {(r[0], r[1]): r[2] for r in rows.groupBy("dataset_id", "dataset_type")
              .count().collect()}
    assert counts == {("FD001", "train"): 4, ("FD001", "test"): 2}
    assert {r[0] for r in rows.where("dataset_type = 'train'").select("unit_number")
            .distinct().collect()} == {7}


def test_result_does_not_depend_on_micro_batches(spark, tmp_path):
    """Two deliveries in one run, or in two, give the same table: the newer file."""
    from wearline.streaming.ingest import ingest_stream

    good = " ".join(["0.5"] * 24)
    for name, splits in (("one", False), ("two", True)):
        src = tmp_path / name
        for i, units in enumerate(((1, 2, 3), (4, 5))):
            d = src / f"delivery-{i}"
            d.mkdir(parents=True)
            (d / "train_FD001.txt").write_text("".join(f"{u} 1 {good}\n" for u in units))
            if splits or i == 1:
                ingest_stream(spark, str(src), str(tmp_path / f"t-{name}"), checkpoint=str(tmp_path / f"c-{name}")
                              ).awaitTermination(120)
        units = {r[0] for r in spark.read.parquet(str(tmp_path / f"t-{name}")).select("unit_number").collect()}
        assert units == {4, 5}
