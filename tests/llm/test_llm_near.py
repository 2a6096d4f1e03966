"""Near duplicates, components and repeats against brute force."""

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from wearline.llm import repeats
from wearline.llm.common import WordHash
from wearline.llm.components import components
from wearline.llm.near import drop_near_duplicates, least_shared, near_duplicates
from wearline.llm.repeats import cut_repeats, remove_repeats

DOCS = "doc_id long, text string"


def shingles(text):
    w = (text or "").encode().lower().split()
    if not w:
        return frozenset()
    return frozenset([tuple(w)]) if len(w) < 5 else frozenset(tuple(w[i:i + 5]) for i in range(len(w) - 4))


def brute_near(rows, percent):
    sets = [shingles(t) for _, t in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    holders = defaultdict(list)
    for i, s in enumerate(sets):
        if rows[i][0] is not None:
            for x in s:
                holders[x].append(i)
    for i, s in enumerate(sets):
        counts = defaultdict(int)
        if rows[i][0] is not None:
            for x in s:
                for j in holders[x]:
                    counts[j] += j > i
        for j, n in counts.items():
            if n and 100 * n >= percent * (len(s) + len(sets[j]) - n):
                parent[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(least.get(find(i), d), d)
    return [(d, len(sets[i]), least.get(find(i)) if d is not None else None) for i, (d, _) in enumerate(rows)]


def edit(rng, vocabulary, text, n):
    text = list(text)
    for _ in range(n):
        i = rng.randrange(max(1, len(text)))
        kind = rng.random()
        if kind < 0.6 and text:
            text[i] = rng.choice(vocabulary)
        elif kind < 0.8 and len(text) > 1:
            del text[i]
        else:
            text.insert(i, rng.choice(vocabulary))
    return text


def near_rows():
    rng, vocabulary = random.Random(5), [f"w{i}" for i in range(2000)]
    base = [rng.choice(vocabulary) for _ in range(150)]
    rows = [(i, " ".join(edit(rng, vocabulary, base, rng.randint(0, 8)))) for i in range(250)]
    for i in range(300, 400):
        b = [rng.choice(vocabulary) for _ in range(rng.choice([1, 3, 4, 5, 6, 10, 30, 70, 400]))]
        rows.append((i, " ".join(b)))
        if rng.random() < 0.5:
            rows.append((1000 + i, " ".join(edit(rng, vocabulary, b, rng.randint(0, 3)))))
        if rng.random() < 0.3:
            rows.append((2000 + i, " ".join(b).upper()))
    chain = [rng.choice(vocabulary) for _ in range(300)]
    for i in range(40):  # each links with the next only
        rows.append((5000 - i, " ".join(chain)))
        chain = edit(rng, vocabulary, chain, 3)
    passage = " ".join(vocabulary[:40])
    rows += [(6000 + i, passage + " " + " ".join(rng.choice(vocabulary) for _ in range(60))) for i in range(60)]
    return rows + [(9000, None), (9001, ""), (9002, "  \n"), (None, "x y z"), (None, None), (9003, "x y z"),
                   (9003, "x y z"), (9004, "x y z"), (9005, "long " * 30000)]


@pytest.mark.parametrize("percent", [85, 80, 50])
def test_near_duplicates_match_brute_force(spark, percent):
    rows = near_rows()
    got = near_duplicates(spark.createDataFrame(rows, DOCS).repartition(5), percent=percent).collect()
    key = lambda r: tuple((x is None, x or 0) for x in r)
    assert sorted([tuple(r)[:3] for r in got], key=key) == sorted(brute_near(rows, percent), key=key)
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_shared_values_of_a_pair_at_the_threshold():
    """Drawn pairs at the threshold never share fewer retained values than the bound."""
    rng = random.Random(9)
    for percent, n in ((85, 1700), (80, 500)):
        both = n * percent // 100
        for _ in range(200):
            values = rng.sample(range(1 << 40), n)
            common, left, right = values[:both], values[both:(both + n) // 2], values[(both + n) // 2:]
            a, b = sorted(common + left)[:64], sorted(common + right)[:64]
            assert len(set(a) & set(b)) >= least_shared(64, percent)


def test_one_of_each_group_stays_with_all_columns(spark):
    rows = [(3, "a b c d e f g", "x", 1), (1, "A b c d e f g", "y", 2), (2, "other words entirely here now", "z", 3),
            (None, "a b c d e f g", "n", 4)]
    df = spark.createDataFrame(rows, "doc_id long, text string, kept string, c int")
    out = drop_near_duplicates(df)
    assert out.columns == df.columns
    assert sorted(r.kept for r in out.collect()) == ["n", "y", "z"]


@pytest.mark.parametrize("seed", range(3))
def test_components(spark, seed):
    rng = random.Random(seed)
    edges = [(rng.randrange(80), rng.randrange(80)) for _ in range(45)] + [(200 + i, 201 + i) for i in range(60)]
    edges += [(500, 500), (300, None)]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if b is not None and a != b:
            x, y = sorted((find(a), find(b)))
            parent[y] = x
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for x in parent}


def brute_repeats(rows, width=20):
    words = [(t or "").encode().split() for _, t in rows]
    first = {}
    for i in sorted(range(len(rows)), key=lambda i: rows[i][0]):
        for s in range(len(words[i]) - width + 1):
            first.setdefault(tuple(words[i][s:s + width]), (rows[i][0], s))
    out = []
    for (d, _), w in zip(rows, words):
        gone = set()
        for s in range(len(w) - width + 1):
            if first[tuple(w[s:s + width])] != (d, s):
                gone.update(range(s, s + width))
        out.append((d, len(w), len(gone), b" ".join(x for j, x in enumerate(w) if j not in gone)))
    return out


def repeat_rows():
    rng = random.Random(1)
    rows = [(d, " ".join(rng.choice("ab") for _ in range(rng.choice([0, 5, 19, 20, 21, 60, 400])))) for d in range(60)]
    base = [f"w{i}" for i in range(300)]
    for d in range(60, 160):
        a, b = rng.randint(0, 250), rng.randint(0, 250)
        rows.append((d, " ".join(base[a:a + rng.randint(10, 80)] + [f"x{rng.randint(0, 999)}"] * rng.randint(0, 9)
                                 + base[b:b + rng.randint(15, 40)])))
    rows += [(160, None), (161, "z " * 3000), (162, "z " * 700), (163, " ".join(base)), (164, " ".join(base))]
    rows += [(165, "Z\x0bz\x1fz é " * 30)]
    return rows


@pytest.mark.parametrize("flush", [300, 100_000])
def test_repeats_match_brute_force(spark, flush):
    rows = repeat_rows()
    got = remove_repeats(spark.createDataFrame(rows, DOCS).repartition(7), flush_words=flush).collect()
    expected = [(d, n, g, hashlib.sha256(k).hexdigest()) for d, n, g, k in brute_repeats(rows)]
    assert sorted(map(tuple, got)) == sorted(expected)


def test_cut_texts(spark):
    rows = repeat_rows()
    df = spark.createDataFrame([(d, t, len(t or ""), "s") for d, t in rows], DOCS + ", n_chars long, spans string")
    got = {r.doc_id: r for r in cut_repeats(df).collect()}
    assert cut_repeats(df).columns == df.columns
    for (d, t), (_, _, gone, kept) in zip(rows, brute_repeats(rows)):
        assert got[d].text == (t if not gone else kept.decode())
        assert got[d].n_chars == len(got[d].text or "")


def test_repeated_rows_are_one_document(spark):
    t = " ".join(f"q{i}" for i in range(30))
    rows = [(1, t), (1, t), (2, t), (None, t), (1, t + " more")]
    got = sorted((r.doc_id or 0, r.n_words, r.n_removed) for r in remove_repeats(spark.createDataFrame(rows, DOCS)).collect())
    assert got[0] == (0, 30, 0)  # NULL comes first
    assert [g[2] for g in got[1:]] == [30, 30, 30, 30]


def phrase_rows(n=900):
    """Most documents share a phrase of 12 words between words of their own; some are copies."""
    rng = random.Random(8)
    phrase = " ".join(f"shared{i}" for i in range(12))
    rows = []
    for d in range(n):
        a, b = (" ".join(f"w{rng.randint(0, 10**6)}" for _ in range(40)) for _ in range(2))
        rows.append((d, f"{a} {phrase} {b}" if d % 5 else f"{a} {b}"))
    return rows + [(n + i, rows[i][1]) for i in range(1, 30)]


def test_a_phrase_in_most_documents_is_dealt_to_all_buckets(spark):
    rows = phrase_rows()
    docs = spark.createDataFrame(rows, DOCS).repartition(6)
    hot = repeats.hot_anchors(docs, 20, 6, 96, one_in=2)
    assert 1 <= len(hot) <= 60  # the phrase, and copies in so small a sample
    sizes = {}
    for anchors in ([], hot):
        flush = repeats.Flush(20, 6, 24, np.array(anchors, np.uint64))
        for d, t in rows:
            flush.add(d, 0, WordHash().of(t.encode().split()))
        per = Counter()
        for bucket, kind, payload in flush.rows():
            per[bucket] += len(payload) * (kind == repeats.SEEDS)
        sizes[len(anchors) > 0] = max(per.values()) / sorted(per.values())[len(per) // 2]
    assert sizes[False] > 4 > sizes[True]


@pytest.mark.parametrize("one_in", [1, 3])
def test_repeats_with_hot_anchors_match_brute_force(spark, one_in):
    rows = phrase_rows(300)
    docs = spark.createDataFrame(rows, DOCS).repartition(7)
    got = remove_repeats(docs, flush_words=2_000, sample_one_in=one_in).collect()
    expected = [(d, n, g, hashlib.sha256(k).hexdigest()) for d, n, g, k in brute_repeats(rows)]
    assert sorted(map(tuple, got)) == sorted(expected)
