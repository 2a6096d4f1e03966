"""Quality classifier, language model and fingerprints."""

import bisect
import hashlib
import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from wearline.llm import classifier, fingerprints, ngrams
from wearline.llm.common import WordHash, table

DOCS = "doc_id long, text string"


def test_classifier_accuracy_on_held_out_labels(spark, sf):
    big = sf.replace("sf0.001", "sf0.01")
    docs, labels = table(spark, big, "documents"), table(spark, big, "labels")
    scores = classifier.quality_scores(docs, labels)
    assert scores.count() == docs.count()
    joined = scores.join(labels, "doc_id").where("held_out").collect()
    good = [r.score for r in joined if r.quality == 1]
    bad = [r.score for r in joined if r.quality == 0]
    assert len(good) > 40 and len(bad) > 5
    assert np.mean([g > b for g in good for b in bad]) > 0.97
    assert np.mean([r.predicted == r.quality for r in joined]) > 0.95


def test_classifier_is_the_quadratic_discriminant(spark):
    rng = random.Random(3)
    rows = [(i, " ".join(rng.choice(["Good", "words,", "here."] if i % 2 else ["BAD!!", "$$$"]) for _ in range(rng.randint(5, 60))))
            for i in range(200)] + [(500, None), (501, ""), (None, "x")]
    docs = spark.createDataFrame(rows, DOCS)
    stats = classifier.features(docs)
    model = classifier.fit(stats.where("doc_id < 200").selectExpr("*", "cast(doc_id % 2 as int) AS q"), "q", 0.1)
    x = np.array([classifier.statistics((t or "").encode(), WordHash()) for _, t in rows])
    train = x[:200]
    spread = train.std(axis=0)
    spread[spread < 1e-6] = 1e-6
    logs = []
    for c in (0, 1):
        z = train[c::2]
        cov = np.cov((z / spread).T, bias=True)
        cov = 0.9 * cov + (0.1 * np.trace(cov) / len(cov) + 1e-9) * np.eye(len(cov))
        cov = cov * np.outer(spread, spread)
        d = x - z.mean(axis=0)
        logs.append(math.log(0.5) - 0.5 * np.einsum("ij,jk,ik->i", d, np.linalg.inv(cov), d)
                    - 0.5 * np.linalg.slogdet(cov)[1])
    expected = 1 / (1 + np.exp(-np.clip(logs[1] - logs[0], -60, 60)))
    assert np.allclose(model.score(x), expected, atol=1e-5)


@pytest.mark.parametrize("labels,expected", [([], 0.5), ([(0, 1), (1, 1)], 1.0), ([(0, 0), (1, 0)], 0.0),
                                             ([(0, 1), (0, 0), (None, 1), (1, None)], 0.5)])
def test_classifier_without_two_classes(spark, labels, expected):
    docs = spark.createDataFrame([(0, "a b"), (1, None)], DOCS)
    got = classifier.quality_scores(docs, spark.createDataFrame(labels, "doc_id long, quality int")).collect()
    assert [r.score for r in got] == [expected, expected]


def brute_model(rows):
    def tokens(t):
        return [*(t or "").encode().lower().split(), "</e>"]

    def held(i):
        return i is not None and zlib.crc32(str(i).encode()) % 7 == 2

    words, pairs = Counter(), Counter()
    for i, t in rows:
        if not held(i):
            w = tokens(t)
            words.update(w)
            pairs.update(zip(["<s>", *w[:-1]], w))
    n, v = sum(words.values()), len(words)

    def discount(counts):
        c = Counter(counts)
        return ngrams.discounts(c[1], c[2], c[3], c[4])

    d2, ends = discount(pairs.values()), Counter(w for _, w in pairs)
    d1, total = discount(ends.values()), len(pairs)
    context = defaultdict(lambda: [0, 0, 0, 0])
    for (a, _), c in pairs.items():
        context[a][0] += c
        context[a][min(c, 3)] += 1
    spare = sum(d1[min(c, 3)] for c in ends.values()) / total if total else 1.0

    def low(w):
        return (max(ends[w] - d1[min(ends[w], 3)], 0) / total if total else 0) + spare / (v + 1)

    def p(a, w):
        if a not in context:
            return low(w)
        x, c = context[a], pairs[a, w]
        return max(c - d2[min(c, 3)], 0) / x[0] + sum(d2[k] * x[k] for k in (1, 2, 3)) / x[0] * low(w)

    for a in [*list(context)[:4], "never seen"]:
        assert abs(sum(p(a, w) for w in words) + p(a, "never seen") - 1) < 1e-9
    out = []
    for i, t in rows:
        w = tokens(t)
        out.append((i, held(i), len(w), sum(x in words for x in w), n,
                    sum(math.log10((words[x] + 1) / (n + v + 1)) for x in w),
                    sum(math.log10(p(a, x)) for a, x in zip(["<s>", *w[:-1]], w))))
    return out


@pytest.mark.parametrize("flush", [700, 100_000])
def test_language_model_matches_brute_force(spark, flush):
    rng = random.Random(2)
    rows = [(i, " ".join(rng.choice("a b c d e f A gg".split()) + str(rng.randrange(9)) for _ in range(
        rng.choice([0, 1, 5, 50, 3000 if i == 7 else 3])))) for i in range(60)]
    rows += [(None, "a1 b2"), (100, None), (101, "q"), (101, "q")]
    marked = spark.createDataFrame(rows, DOCS).repartition(3).select("doc_id", ngrams.held_out(), "text")
    model = ngrams.train(marked.where("not held_out"), flush_words=flush)
    got = ngrams.scores(marked, model, flush_words=flush).collect()
    key = lambda r: (r[0] is None, r[0] or 0, r[5])
    for a, b in zip(sorted(map(tuple, got), key=key), sorted(brute_model(rows), key=key), strict=True):
        assert a[:5] == b[:5]
        assert a[5:] == pytest.approx(b[5:], rel=1e-9, abs=1e-9)


def test_language_model_beats_unigrams_on_held_out_texts(spark, sf):
    rows = ngrams.train_and_score(table(spark, sf.replace("sf0.001", "sf0.01"), "documents")).where("held_out").collect()
    tokens = sum(r.n_tokens for r in rows)
    assert sum(r.score for r in rows) / tokens > sum(r.base_score for r in rows) / tokens + 0.3


def test_language_model_without_training_rows(spark):
    held = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 7 == 2)
    got = ngrams.train_and_score(spark.createDataFrame([(held, "a b")], DOCS)).first()
    assert (got.n_tokens, got.n_known, got.train_tokens, got.base_score, got.score) == (3, 0, 0, 0.0, 0.0)


def test_model_shards_need_a_mounted_folder():
    assert ngrams.mounted("file:///shared/x") == ngrams.mounted("/shared/x") == ngrams.mounted("file:/shared/x") == "/shared/x"
    for path, default in (("hdfs://store/x", "file:///"), ("/shared/x", "hdfs://store")):
        with pytest.raises(ValueError):
            ngrams.mounted(path, default)


def test_mixing_of_pair_numbers_is_invertible():
    x = np.random.default_rng(0).integers(0, 1 << 63, 1000).astype(np.uint64)
    assert (ngrams.unmixed(ngrams.mixed(x)) == x).all()


def test_fingerprints_are_homomorphic():
    h = WordHash()
    a, b, c = "one two three four\nfive six", "seven eight nine ten eleven", "five six"
    f = [fingerprints.to_text(x) for x in (
        fingerprints.fingerprint(f"{a}\n\n {b} ", h), fingerprints.fingerprint(f"{b}\n{a}", h),
        fingerprints.insert(fingerprints.fingerprint(a, h), fingerprints.fingerprint(b, h)))]
    assert f[0] == f[1] == f[2]
    less = fingerprints.delete(fingerprints.fingerprint(a, h), fingerprints.fingerprint(c, h))
    assert fingerprints.to_text(less) == fingerprints.to_text(fingerprints.fingerprint("one two three four", h))
    assert fingerprints.to_text(fingerprints.from_text(f[0])) == f[0] != fingerprints.to_text(fingerprints.fingerprint(a, h))
    assert fingerprints.to_text(fingerprints.fingerprint("one two three four five six", h)) != fingerprints.to_text(
        fingerprints.fingerprint(a, h))


def test_edited_texts_and_likeness(spark, sf):
    docs = table(spark, sf, "documents")
    rows = sorted((r.doc_id, r.text or "") for r in docs.collect())
    got = {r.doc_id: r for r in fingerprints.edit_fingerprints(docs).collect()}
    assert len(got) == len(rows)
    for (d, t), (_, following) in zip(rows, [*rows[1:], rows[0]]):
        half = len(t) // 2
        assert got[d].n_chars == len(t)
        assert got[d].edited_sha256 == hashlib.sha256((t[:len(t) - half] + following[:half]).encode()).hexdigest()
    long = [got[d] for d, t in rows if len(t) > 400]
    assert np.mean([r.near_edited for r in long]) == pytest.approx(0.5, abs=0.1)
    assert np.mean([r.near_next for r in long]) < 0.15
    assert all(r.near_edited > r.near_next for r in long if r.near_next < 0.9)


def test_next_document_across_ranges_nulls_and_repeats(spark):
    rows = [(5, "abcd"), (5, "abcd"), (None, "zéßx"), (7, None), (10**12, "x" * 100)]
    order = sorted([(i if i is not None else -1, t or "") for i, t in rows])
    expected = []
    for (i, t), (_, following) in zip(order, [*order[1:], order[0]]):
        expected.append((i, hashlib.sha256(fingerprints.edited(t, following).encode()).hexdigest()))
    got = fingerprints.edit_fingerprints(spark.createDataFrame(rows, DOCS)).collect()
    assert sorted((r.doc_id if r.doc_id is not None else -1, r.edited_sha256) for r in got) == sorted(expected)
    assert len({r.fingerprint for r in got if r.doc_id == 5}) == 1
    single = fingerprints.edit_fingerprints(spark.createDataFrame([(1, "a b c d")], DOCS)).first()
    assert single.near_next == 1.0


def test_likeness_of_a_text_with_one_run_very_often():
    h = fingerprints.WordHash()
    long, half = (fingerprints.fingerprint("a " * (n + 2), h) for n in (65_536, 32_768))
    assert fingerprints.likeness(long, half) == pytest.approx(0.8)


def test_an_outlying_id_leaves_the_ranges_even(spark):
    rows = [(i, f"text {i}") for i in [*range(1, 2001), 10**15]] + [(None, "none")]
    ranged = fingerprints.in_order(spark.createDataFrame(rows, DOCS), 32).where("ghost = 0")
    assert sorted(r.doc_id for r in ranged.collect() if r.doc_id is not None) == [i for i, _ in rows[:-1]]
    sizes = [r["count"] for r in ranged.groupBy("bucket").count().collect()]
    assert max(sizes) <= 100 and len(sizes) > 50


@pytest.mark.parametrize("at_once", [1000, 5])
def test_cuts_are_even_in_one_or_two_levels(spark, at_once):
    places = spark.range(4000).selectExpr("CAST(CASE WHEN id < 10 THEN id * 1e12 ELSE id END AS DOUBLE) AS place")
    cuts = fingerprints.cuts_of(places, 20, at_once)
    assert cuts == sorted(set(cuts)) and len(cuts) >= 19
    values = sorted(r.place for r in places.collect())
    edges = [bisect.bisect_left(values, c) for c in cuts]
    assert max(b - a for a, b in zip([0, *edges], [*edges, len(values)])) <= 2 * len(values) / 20


def test_counts_beyond_32_bits(tmp_path):
    counts = np.array([1, 2 ** 40, 3, ngrams.FULL, ngrams.FULL - 1, 2 ** 33 + 5])
    path = str(tmp_path / "pairs-0.count")
    ngrams.write_counts(path, counts)
    model = ngrams.Vocabulary(str(tmp_path), 1, np.zeros(2, np.int64), 0)
    got = ngrams.counts_at(model.array("pairs-0.count", np.uint32), model.large("pairs-0.count"), np.array([5, 0, 1, 3, 4, 2]))
    assert got.tolist() == counts[[5, 0, 1, 3, 4, 2]].tolist()
    ngrams.write_counts(str(tmp_path / "pairs-1.count"), counts[:1])
    assert model.large("pairs-1.count").shape == (0, 2)
