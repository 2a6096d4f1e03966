"""Spelling variants against plain Python: edits, tries cut into branches, chains of forms."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from wearline.llm import spelling


def near(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    if len(a) > len(b):
        a, b = b, a
    return any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def made(seed, n, alphabet="abeté", sizes=(6, 9)):
    rng = random.Random(seed)
    words = {"".join(rng.choice(alphabet) for _ in range(rng.randint(*sizes))) for _ in range(n)}
    for w in list(words)[: n // 2]:
        i = rng.randrange(len(w))
        words |= {w[:i] + w[i + 1:], w[:i] + rng.choice(alphabet) + w[i:], w[:i] + rng.choice(alphabet) + w[i + 1:]}
    return sorted(words)


@pytest.mark.parametrize("alphabet,sizes", [("abeté", (6, 9)), ("aeto", (1, 4)), ("xyzqÿ", (30, 60))])
def test_search_finds_exactly_the_near_words(alphabet, sizes):
    words = made(3, 250, alphabet, sizes)
    trie = spelling.Trie(words, [1] * len(words))
    queries = spelling.Words(words)
    got = set()
    for q, w in spelling.best_near(trie, queries, pairs=500):
        got |= {(words[i], trie.words.words[j]) for i, j in zip(q.tolist(), w.tolist())}
    assert got == {(a, b) for a in words for b in words if near(a, b)}


def test_one_edit_of_very_long_words():
    a = "ab" * 30_000
    words = spelling.Words([a, a + "c", a[:1000] + "z" + a[1001:], a[:5] + a[6:], "z" + a[1:-1] + "z"])
    got = spelling.one_edit(words, np.zeros(5, np.int64), words, np.arange(5))
    assert got.tolist() == [False, True, True, True, False]


def vocabulary(rows, least=6, count=5, one_in=199):
    n = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            w = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{w}".encode())
            if h % one_in == 0:
                w = w[:h % len(w)] + w[h % len(w) + 1:]
            n[w] += 1
    return {w: c for w, c in n.items() if len(w) >= least and c >= count}


def table(n, ratio=5):
    near_of = {w: [v for v in n if near(w, v)] for w in n}
    form = {w: min(v, key=lambda x: (-n[x], x)) for w, v in near_of.items() if v}
    form = {w: v for w, v in form.items() if n[v] >= ratio * n[w]}
    out = {}
    for w in n:
        root = w
        while root in form:
            root = form[root]
        out[w] = (form.get(w), root, n[w], len(near_of[w]), n[form[w]] if w in form else None)
    return out


def rows_of(seed):
    """Documents whose words are one, five, twenty-five ... times as common as their variants."""
    rng = random.Random(seed)
    words = made(seed, 60)
    weights = [rng.choice([1, 3, 15, 80, 400]) for _ in words]
    rows = [(i, " ".join(rng.choices(words, weights, k=200)).replace("b", "B") + rng.choice([".", "", " É"])) for i in range(60)]
    return [*rows, (None, "ébetab " * 9), (7, None), (8, ""), (9, "Xyzzyx1xyzzyx\n" * 400 + "xyzzx " * 50), (9, "Xyzzyx " * 2)]


@pytest.mark.parametrize("branch_words", [None, 25])
def test_variants_against_plain_python(spark, branch_words):
    rows = rows_of(4)
    df = spark.createDataFrame([(*r, "x", 1, 2) for r in rows], "doc_id long, text string, word string, n int, branch int").repartition(5)
    got = {r.word: (r.form, r.root, r.n, r.n_near, r.form_n)
           for r in spelling.variants(df, branch_words=branch_words, query_batch=40).collect()}
    expected = table(vocabulary(rows))
    assert got == expected
    assert max(1 + (expected[f][0] is not None) for f, *_ in expected.values() if f) == 2  # chains occur


def test_top_of_the_trie_holds_every_word_once(spark):
    words = made(9, 300)
    df = spark.createDataFrame([(w, 1) for w in words], "word string, n long")
    top = spelling.top_of(df, len(words), 20)
    counts = spelling.Words(words).counts.tolist()
    for c in counts:
        assert sum(v is not None and tuple(c[:len(p)]) == p for p, v in top.items()) == 1
    dealt = spelling.map_arrow(df, spelling._dealer(top), spelling.DEALT).collect()
    home = [r.word for r in dealt if r.role == 0]
    assert sorted(home) == words
    sizes = Counter(r.branch for r in dealt if r.role == 0)
    assert max(sizes.values()) <= 2 * 20


def test_chains_are_followed_to_the_end(spark):
    chain = [(f"w{i:02}", f"w{i + 1:02}") for i in range(9)] + [("other", "w04")]
    got = {r.word: r.root for r in spelling.last_forms(spark.createDataFrame(chain, "word string, form string"), 5 ** 11, 5, 5).collect()}
    assert got == {w: "w09" for w, _ in chain}


def test_no_words(spark):
    df = spark.createDataFrame([(1, None), (2, "short words only")], "doc_id long, text string")
    assert spelling.variants(df).collect() == []
