"""The registered queries: SQL parity, edge tables, the pipeline, the native plans."""

import pytest

import corpus_pipeline
from tools.check_oracle import compare
from wearline.llm import common, mixing, rules
from wearline.llm.common import table
from wearline.llm.oracle import ORACLE
from wearline.llm.queries import QUERIES
from wearline.session import path_exists


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_matches_sql(spark, duck, sf, name):
    res = compare(spark, duck, name, sf, QUERIES[name], ORACLE[name])
    assert res["status"] == "EXACT", res


def folder(spark, path, documents, pages=(), labels=(), conversations=()):
    d = (f"{path}/documents.parquet", f"{path}/pages.parquet", f"{path}/labels.parquet")
    spark.createDataFrame([(*r, 1, "s") for r in conversations], "conv_id long, turn long, role string, text string, part int, seg string"
                          ).write.parquet(f"{path}/conversations.parquet")
    extra = ", n int, size string, kept string, bucket int, words int, score string, target string, c int, v int"
    pad = (1, "s", "k", 2, 3, "x", "t", 4, 5)
    spark.createDataFrame([(*r, *pad) for r in documents],
                          "doc_id long, text string, lang string, source string, n_chars long" + extra).write.parquet(d[0])
    spark.createDataFrame([(*r, "t") for r in pages], "page_id long, url string, html string, text string").write.parquet(d[1])
    spark.createDataFrame([(*r, "t") for r in labels], "doc_id long, quality int, toxic int, text string").write.parquet(d[2])
    return str(path)


LONG = " ".join(f"word{i % 977}" for i in range(60_000))
EDGES = [(1, None, None, None, None), (2, "", "en", "", 0), (3, " \n\t\x0b ", None, "s", 5), (4, LONG, "en", "s", len(LONG)),
         (5, "same words in a row, five", "en", "s", 25), (6, "same words in a row, five", "en", "t", 25),
         (6, "same words in a row, five", "en", "t", 25), (None, "no id at all here", "en", None, 17),
         (None, None, None, None, None), (7, "é漢\U0001f600 " * 40, "xx", "s", 160), (8, LONG, "en", "t", len(LONG))]


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_edge_rows(spark, tmp_path, name):
    path = folder(spark, tmp_path / "x", EDGES, [(1, None, None), (None, "u", "<p>x"), (1, "u", ""), (1, "u", "")],
                  [(1, 1, 0), (4, 0, 0), (4, 0, 0), (5, 1, None), (None, 1, 1), (6, None, 0)],
                  [(1, None, None, None), (1, 0, "user", ""), (1, 0, "user", ""), (2, 1, "user", LONG), (None, 1, "", "x")])
    got = QUERIES[name](spark, path).collect()
    if name.startswith("op13_"):
        got = [r for r in got if r.start == 0]  # one piece of each document begins it
    rows = {"op4": 4, "op11": 3, "op12": 0}  # no word of six letters
    assert len(got) == rows.get(name.split("_")[0], len(EDGES))


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_empty_tables(spark, tmp_path, name):
    path = folder(spark, tmp_path / "x", [])
    assert QUERIES[name](spark, path).collect() == []


def test_pipeline_edge_rows_and_columns(spark, tmp_path):
    path = folder(spark, tmp_path / "x", EDGES, labels=[(1, 1, 0), (4, 0, 0)])
    docs = table(spark, path, "documents")
    names, rows = docs.columns, docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        rows = stage(spark, rows, path)
        rows.write.parquet(out := str(tmp_path / name))
        rows = spark.read.parquet(out)
        assert rows.columns == names
    out = corpus_pipeline.run(spark, path)
    assert out.columns == ["doc_id", "n_tokens", "ids", "decoded"]
    # only the last result is left of the run's tables, until it is swept
    base = common._MADE[-1]
    assert [path_exists(spark, f"{base}/{i}") for i in range(5)] == [False] * 4 + [True]
    with common.sweeping(spark):
        mixing.mix(docs).count()
        made = common._MADE[-1]
        assert path_exists(spark, made)
    assert not path_exists(spark, made) and path_exists(spark, base)
    common.sweep(spark)
    assert not path_exists(spark, base)


def test_pipeline_of_empty_tables(spark, tmp_path):
    assert corpus_pipeline.run(spark, folder(spark, tmp_path / "x", [])).count() == 0


def test_pipeline_stages_take_effect(spark, sf):
    """Each stage against its operator's own result on the stage's input."""
    from wearline.llm import classifier, near, repeats

    docs = table(spark, sf, "documents")
    good = corpus_pipeline.quality(spark, docs, sf).cache()
    scores = {r.doc_id: r.predicted for r in classifier.quality_scores(docs, table(spark, sf, "labels")).collect()}
    assert {r.doc_id for r in good.collect()} == {d for d, p in scores.items() if p == 1}
    single = corpus_pipeline.near_dedup(spark, good, sf).cache()
    assert {r.doc_id for r in single.collect()} == {r.doc_id for r in near.near_duplicates(good, percent=80).where("kept").collect()}
    cut = corpus_pipeline.substring_dedup(spark, single, sf).cache()
    removed = {r.doc_id: (r.n_words, r.n_removed) for r in repeats.remove_repeats(single).collect()}
    assert {r.doc_id: len(r.text.encode().split()) for r in cut.collect()} == {d: n - g for d, (n, g) in removed.items()}
    mixed = corpus_pipeline.source_mix(spark, cut, sf)
    counts = {r.source: r.words for r in mixed.groupBy("source").agg({"text": "count"}).withColumnRenamed("count(text)", "words").collect()}
    assert counts and all(n > 0 for n in counts.values())


def test_native_operators_use_no_python(spark, sf):
    docs = table(spark, sf, "documents")
    for df in (rules.measures(docs), rules.quality_rules(docs), mixing.mix(docs)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert not any(word in plan for word in ("Python", "Pandas", "Arrow"))


def test_targets_by_repeated_sharing(spark):
    """The water level against sharing the excess again and again."""
    sizes = {"a": 1000, "b": 10, "c": 300, "d": 5, "e": 90, "f": 0, None: 40}
    df = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
    got = {r.source: r.target for r in mixing.source_targets(df).collect()}
    names = sorted((s for s in sizes if s is not None)) + [None]
    weight = {s: (1, 2, 3)[i % 3] for i, s in enumerate(names)}
    target, capped = dict.fromkeys(names, 0.0), set()
    while True:
        rest = sum(sizes.values()) - sum(3 * sizes[s] for s in capped)
        open_ = [s for s in names if s not in capped]
        for s in open_:
            target[s] = rest * weight[s] / sum(weight[x] for x in open_)
        over = {s for s in open_ if target[s] > 3 * sizes[s]}
        if not over:
            break
        capped |= over
        target.update({s: 3.0 * sizes[s] for s in over})
    assert got == pytest.approx(target)


@pytest.mark.parametrize("shares,seats", [([53, 24, 23], 7), ([1, 1, 1], 2), ([0, 5, 0], 3), ([100, 1, 1, 1], 5), ([7, 3], 0),
                                          ([10**9, 3, 2 * 10**8, 77], 1000)])
def test_apportionment_by_highest_quotients(spark, shares, seats):
    df = spark.createDataFrame([(i, s, seats) for i, s in enumerate(shares)], "pos int, share long, blocks long")
    got = {r.pos: r.quota for r in mixing.apportion(df, ["pos"], [], "share", "blocks", "quota").collect()}
    expected = [0] * len(shares)
    for _ in range(seats):
        best = max(range(len(shares)), key=lambda i: (shares[i] / (2 * expected[i] + 1), -i))
        expected[best] += 1
    assert [got[i] for i in range(len(shares))] == expected


def test_mix_meets_targets(spark, sf):
    rows = mixing.mix(table(spark, sf, "documents"), shard_words=2_000).collect()
    taken, target = {}, {}
    for r in rows:
        assert 0 <= r.taken <= 3 * r.size
        taken[r.source] = taken.get(r.source, 0) + r.taken
        target[r.source] = r.target
    for s, t in target.items():
        assert taken[s] == pytest.approx(t, abs=max(64, 0.02 * t))


def test_hot_source_meets_many_shards(spark):
    rows = [(i, "w " * 50, "hot" if i % 3 else f"s{i % 7}") for i in range(600)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    out = mixing.mix(df, shard_words=1000, block_words=10)
    again = mixing.mix(df.repartition(3), shard_words=1000, block_words=10)
    assert sorted(map(tuple, out.collect())) == sorted(map(tuple, again.collect()))


def test_no_source_is_lost_beside_a_large_one(spark):
    """One source of 60,000 words beside 60 sources of ten: each meets its target within one
    word, and the pipeline's stage keeps their documents."""
    rows = [(0, "w " * 60_000, "large")] + [(i, " ".join(["small"] * 10), f"s{i:02}") for i in range(1, 61)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    mixed = mixing.mix(df)
    for r in mixed.groupBy("source").agg({"taken": "sum", "target": "max"}).collect():
        assert abs(r["sum(taken)"] - r["max(target)"]) <= 1
    kept = {r.doc_id for r in mixing.repeat_by_taken(df, mixed).collect()}
    assert kept == {r[0] for r in rows}
