"""Spelling variants: words one edit apart, found in tries of letter-group frequencies.

1. *Count.*  Tasks count their words before the shuffle, so a word that makes up a third of
   all text leaves a task once per flush.  Words seen often enough make the vocabulary.
2. *Trie.*  A word is the path of its letter-group counts, one level a group.  One edit
   changes two words' counts by a surplus of at most one and a deficit of at most one, over
   all levels together.
3. *Deal.*  The top of the trie is cut where a branch holds at most ``branch_words`` words;
   each branch is one task's index.  A word goes as a query to the branches that the same
   budget reaches.  A last-level node above the bound (anagrams by groups) is split by hash
   and searched part by part.
4. *Search.*  In its branch a depth-first search carries the queries that can still pay the
   way to a node; at small nodes the words left are verified letter by letter.
5. Only the number of near words and the most frequent one leave a branch.  Forms are followed
   to the last by doubling: a form occurs ``ratio`` times as often as its word, so chains are
   logarithmic in the counts.

* NULL or empty text has no words; a NULL id counts as an empty one.  Repeated rows count each.
* Ties of frequency go to the smaller word in code-point order.
* Very long words are words like others; very long texts are read whole.  Empty tables give an
  empty vocabulary.  Further columns are not read.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wearline.llm.common import batch_bytes_of, map_arrow, shared_folder, stored

# Letters by level of the trie, common ones first; any other letter belongs to the last level.
GROUPS = ("e", "t", "a", "n", "o", "i", "h", "s", "r", "l", "d", "u", "c", "m", "fg", "py", "wb", "vkjqxz")
LEVELS = len(GROUPS) + 1
_LEVEL = np.full(256, LEVELS - 1, np.int64)
for _i, _letters in enumerate(GROUPS):
    for _c in _letters:
        _LEVEL[ord(_c)] = _i


def runs_of(text: bytes, least: int) -> list[str]:
    """Maximal runs of the letters A-Z, a-z and U+00C0-U+00FF of at least ``least`` letters,
    A-Z lowered."""
    return _runs(least).findall(text.lower().decode())


def _runs(least: int) -> re.Pattern:
    return re.compile(f"[a-zÀ-ÿ]{{{least},}}")


def changed(runs: list[str], doc_id: int | None, one_in: int) -> list[tuple[str, str]]:
    """(run, run without one letter) for those distinct runs of a document whose crc32 of
    ``doc_id:run`` is divisible by ``one_in``."""
    start = zlib.crc32(b"%s:" % (b"" if doc_id is None else str(doc_id).encode()))
    words = list(set(runs))
    sums = np.fromiter((zlib.crc32(w.encode(), start) for w in words), np.uint32, len(words))
    out = []
    for i in np.flatnonzero(sums % one_in == 0).tolist():
        w, at = words[i], int(sums[i]) % len(words[i])
        out.append((w, w[:at] + w[at + 1:]))
    return out


def _counter(least: int, one_in: int, flush_words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Counter = Counter()

        def give() -> Iterator[pa.RecordBatch]:
            words = [w for w in found if len(w) >= least]
            for i in range(0, len(words), 50_000):
                some = words[i:i + 50_000]
                yield pa.record_batch([pa.array(some, pa.string()), pa.array(map(found.__getitem__, some), pa.int64())],
                                      names=["word", "n"])
            found.clear()

        pattern = _runs(least)
        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch_bytes_of(batch, "text"), strict=True):
                if not text:
                    continue
                runs = pattern.findall(text.lower().decode())
                found.update(runs)
                for w, v in changed(runs, doc_id, one_in):
                    times = runs.count(w)
                    found[w] -= times
                    found[v] += times
            if len(found) > flush_words:
                yield from give()
        yield from give()

    return run


def vocabulary(docs: DataFrame, *, least_letters: int = 6, least_count: int = 5, one_in: int = 199,
               flush_words: int = 400_000) -> DataFrame:
    """``word, n`` of the words of at least ``least_letters`` letters that occur at least
    ``least_count`` times, after one in ``one_in`` runs of a document lost a letter."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    found = map_arrow(rows, _counter(least_letters, one_in, flush_words), "word string, n long")
    return found.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_count)


class Words:
    """Words as arrays: code points in a row, lengths, letter-group counts."""

    def __init__(self, words: list[str]):
        self.words = words
        self.codes = np.frombuffer("".join(words).encode("utf-16-le"), np.uint16)
        self.sizes = np.fromiter(map(len, words), np.int64, len(words))
        self.starts = np.cumsum(self.sizes) - self.sizes
        of = np.repeat(np.arange(len(words)), self.sizes)
        counts = np.bincount(of * LEVELS + _LEVEL[self.codes], minlength=len(words) * LEVELS)
        self.counts = counts.reshape(-1, LEVELS).astype(np.int32)
        # Up to three letters at either end as one number.  An edit lies in one half of a word,
        # so near words of at least six letters share the letters at one of their ends.
        self.shortest = int(self.sizes.min()) if len(words) else 0
        self.front, self.back = (self._end(r) for r in (False, True))

    def _end(self, backwards: bool) -> np.ndarray:
        out = np.zeros(len(self.words), np.int64)
        for k in range(min(3, self.shortest // 2)):
            at = self.starts + (self.sizes - 1 - k if backwards else k)
            out = out * 65536 + self.codes[at]
        return out

    def padded(self, which: np.ndarray, width: int, backwards: bool) -> np.ndarray:
        """Code points of the chosen words, one row each, 0 beyond a word's end."""
        at = np.arange(width)
        inside = at < self.sizes[which, None]
        place = (self.sizes[which, None] - 1 - at if backwards else at) + self.starts[which, None]
        return np.where(inside, self.codes[np.where(inside, place, 0)], 0)


def one_edit(a: Words, i: np.ndarray, b: Words, j: np.ndarray) -> np.ndarray:
    """Whether word ``i`` of ``a`` and word ``j`` of ``b`` differ by exactly one insertion,
    deletion or replacement: what they share at the front and at the back is then all but
    one letter of the longer one."""
    out = np.zeros(len(i), bool)
    longer = np.maximum(a.sizes[i], b.sizes[j])
    for lo, hi in _by_width(longer):
        x, y, long_ = i[lo:hi], j[lo:hi], longer[lo:hi]
        width = int(long_.max()) + 1
        front, back = (_shared(a.padded(x, width, r), b.padded(y, width, r)) for r in (False, True))
        equal = (front == long_) & (a.sizes[x] == b.sizes[y])
        out[lo:hi] = ~equal & (np.abs(a.sizes[x] - b.sizes[y]) <= 1) & (front + back >= long_ - 1)
    return out


def _shared(u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Letters that padded words share from their first one on."""
    return np.argmax((u != v) | (u == 0), axis=1)


def _by_width(longer: np.ndarray, cells: int = 2_000_000) -> Iterator[tuple[int, int]]:
    """Slices of pairs so that their padded letters stay within ``cells`` (a pair at least)."""
    lo = 0
    while lo < len(longer):
        hi = min(len(longer), lo + max(1, cells // int(longer[lo:lo + 50_000].max() + 1)), lo + 50_000)
        yield lo, hi
        lo = hi


class Trie:
    """Words in the order of their count vectors; a node is a range of them."""

    def __init__(self, words: list[str], n: list[int]):
        w = Words(words)
        order = np.lexsort(w.counts.T[::-1])
        self.words = Words([words[i] for i in order.tolist()])
        self.n = np.asarray(n, np.int64)[order]

    def search(self, queries: Words, leaf: int = 24) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(query, word) pairs whose counts differ by a surplus and a deficit of at most one,
        depth first; a query leaves the search where its budget is spent."""
        total, counts, asked = len(self.words.words), self.words.counts, queries.counts
        same_ends = min(self.words.shortest, queries.shortest) >= 6
        none = np.zeros(len(queries.words), np.int8)
        stack = [(0, total, 0, np.arange(len(queries.words)), none, none)] if total else []
        while stack:
            lo, hi, level, who, more, less = stack.pop()
            if hi - lo <= leaf or level == LEVELS:
                step = max(1, 400_000 // ((hi - lo) * LEVELS))
                for k in range(0, len(who), step):
                    some = slice(k, k + step)
                    d = counts[None, lo:hi, level:] - asked[who[some], None, level:]
                    fits = ((np.maximum(d, 0).sum(axis=2) + more[some, None] <= 1)
                            & (np.maximum(-d, 0).sum(axis=2) + less[some, None] <= 1))
                    q, w = np.nonzero(fits)
                    q, w = who[some][q], w + lo
                    if same_ends:
                        ends = (queries.front[q] == self.words.front[w]) | (queries.back[q] == self.words.back[w])
                        q, w = q[ends], w[ends]
                    if len(q):
                        yield q, w
                continue
            values, firsts = np.unique(counts[lo:hi, level], return_index=True)
            ends = [*(firsts[1:] + lo).tolist(), hi]
            mine = asked[who, level]
            for value, first, end in zip(values.tolist(), (firsts + lo).tolist(), ends):
                d = value - mine
                ok = (d == 0) | ((d == 1) & (more == 0)) | ((d == -1) & (less == 0))
                if ok.any():
                    dd = d[ok]
                    stack.append((first, end, level + 1, who[ok], more[ok] + (dd == 1), less[ok] + (dd == -1)))


def best_near(trie: Trie, queries: Words, pairs: int = 500_000) -> Iterator[tuple[np.ndarray, ...]]:
    """Verified (query, word) index pairs, in portions of about ``pairs`` candidates."""
    held: list[tuple[np.ndarray, np.ndarray]] = []
    size = 0

    def checked() -> tuple[np.ndarray, np.ndarray]:
        q, w = (np.concatenate(x) for x in zip(*held))
        order = np.argsort(np.maximum(queries.sizes[q], trie.words.sizes[w]), kind="stable")
        q, w = q[order], w[order]
        near = one_edit(queries, q, trie.words, w)
        return q[near], w[near]

    for q, w in trie.search(queries):
        held.append((q, w))
        size += len(q)
        if size >= pairs:
            yield checked()
            held.clear()
            size = 0
    if held:
        yield checked()


NEAR = "word string, n_near long, best_n long, best string"


def _search(query_batch: int):
    """The Arrow function over rows sorted by branch, index words (role 0) first."""

    def answer(trie: Trie, words: list[str]) -> pa.RecordBatch:
        queries = Words(words)
        n_near = np.zeros(len(words), np.int64)
        best: list[tuple[int, str] | None] = [None] * len(words)
        for q, w in best_near(trie, queries):
            n_near += np.bincount(q, minlength=len(words))
            order = np.lexsort((-trie.n[w], q))
            q, w = q[order], w[order]
            top = np.flatnonzero(np.r_[True, q[1:] != q[:-1]]) if len(q) else np.zeros(0, np.int64)
            ends = np.r_[top[1:], len(q)]
            for a, b in zip(top.tolist(), ends.tolist()):
                high = trie.n[w[a]]
                tied = [trie.words.words[x] for x in w[a:b][trie.n[w[a:b]] == high].tolist()]
                found = (-int(high), min(tied))
                i = int(q[a])
                if best[i] is None or found < best[i]:
                    best[i] = found
        some = np.flatnonzero(n_near).tolist()
        return pa.record_batch(
            [pa.array([words[i] for i in some], pa.string()), pa.array(n_near[some], pa.int64()),
             pa.array([-best[i][0] for i in some], pa.int64()), pa.array([best[i][1] for i in some], pa.string())],
            names=["word", "n_near", "best_n", "best"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        branch, trie = None, None
        index: list[tuple[str, int]] = []
        asked: list[str] = []

        def close() -> Iterator[pa.RecordBatch]:
            nonlocal trie
            if trie is None and index:
                trie = Trie([w for w, _ in index], [n for _, n in index])
            if trie is not None:
                for i in range(0, len(asked), query_batch):
                    yield answer(trie, asked[i:i + query_batch])
            asked.clear()

        for batch in batches:
            for b, role, word, n, ask in zip(*(batch.column(c).to_pylist() for c in ("branch", "role", "word", "n", "ask"))):
                if b != branch:
                    yield from close()
                    branch, trie = b, None
                    index.clear()
                if role == 0:
                    index.append((word, n))
                if ask:
                    asked.append(word)
                    if role == 1 and len(asked) >= query_batch:
                        yield from close()
        yield from close()

    return run


Top = dict[tuple[int, ...], tuple[int, int] | None]  # trie node -> (branch number, parts), None: divided


def top_of(words: DataFrame, size: int, branch_words: int) -> Top:
    """The top of the trie: nodes above ``branch_words`` words, and their children as branches.

    Nodes are counted eight levels at a time, below those that are still too large.  A level
    has at most ``words / branch_words`` large nodes, so what comes to the driver does not
    grow with the vocabulary as long as ``branch_words`` grows with it."""
    top: Top = {}
    depth, numbers = 0, 0
    if size <= branch_words:
        return {(): (0, 1)}
    large: list[tuple[int, ...]] = [()]
    top[()] = None
    vectors = words.select(F.array(*[level_count(i) for i in range(LEVELS)]).alias("v"))
    while large and depth < LEVELS:
        deeper = min(LEVELS, depth + 8)
        spark = words.sparkSession
        below = spark.createDataFrame([(list(p),) for p in large], "p array<int>")
        rows = vectors if depth == 0 else vectors.join(F.broadcast(below), F.slice("v", 1, depth) == F.col("p"), "left_semi")
        nodes = (rows.groupBy(F.slice("v", 1, deeper).alias("v")).agg(F.count(F.lit(1)).alias("n"))
                 .select("n", F.explode(F.expr(f"transform(sequence({depth + 1}, {deeper}), k -> slice(v, 1, k))")).alias("p"))
                 .groupBy("p").agg(F.sum("n").alias("n")))
        parents = nodes.where(F.col("n") > branch_words).select(F.col("p").alias("q"))
        found = nodes.join(parents, F.slice(nodes.p, 1, F.size(nodes.p) - 1) == parents.q, "left_semi") if depth + 1 < deeper else nodes
        first = nodes.where(F.size("p") == depth + 1)
        counted = {tuple(r.p): r.n for r in first.unionByName(found).distinct().collect()}
        large = []
        for p in sorted(counted, key=lambda p: (len(p), p)):
            if top.get(p[:-1], 0) is not None:
                continue  # its parent is a branch already
            if counted[p] > branch_words and len(p) < LEVELS:
                top[p] = None
                if len(p) == deeper:
                    large.append(p)
            else:
                parts = -(-counted[p] // branch_words)
                top[p] = (numbers, parts)
                numbers += parts
        depth = deeper
    return top


def level_count(level: int):
    """How many letters of ``word`` belong to the level."""
    if level < len(GROUPS):
        return F.length(F.regexp_replace("word", f"[^{GROUPS[level]}]", "")).cast("int")
    return F.length(F.regexp_replace("word", f"[{''.join(GROUPS)}]", "")).cast("int")


def _dealer(top: Top):
    """The Arrow function that gives every word its branch, and the branches it is asked in."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        children: dict[tuple, list[tuple]] = {}
        for p in top:
            if p:
                children.setdefault(p[:-1], []).append(p)
        for batch in batches:
            words = batch.column("word").to_pylist()
            n = batch.column("n").to_numpy()
            counts = Words(words).counts
            part = np.fromiter((zlib.crc32(w.encode()) for w in words), np.int64, len(words))
            none = np.zeros(len(words), np.int8)
            stack = [((), np.arange(len(words)), none, none)]
            while stack:
                p, who, more, less = stack.pop()
                if top[p] is not None:
                    number, parts = top[p]
                    home = (more == 0) & (less == 0)  # no surplus or deficit: the word's own path
                    for k in range(parts):
                        mine = home & (part[who] % parts == k)
                        yield pa.record_batch(
                            [pa.array(np.full(len(who), number + k), pa.int32()), pa.array(~mine, pa.int8()),
                             batch.column("word").take(pa.array(who)), pa.array(n[who], pa.int64()),
                             pa.array(np.ones(len(who), bool))], names=["branch", "role", "word", "n", "ask"])
                    continue
                mine = counts[who, len(p)]
                for child in children.get(p, ()):
                    d = child[-1] - mine
                    ok = (d == 0) | ((d == 1) & (more == 0)) | ((d == -1) & (less == 0))
                    if ok.any():
                        dd = d[ok]
                        stack.append((child, who[ok], more[ok] + (dd == 1), less[ok] + (dd == -1)))

    return run


DEALT = "branch int, role byte, word string, n long, ask boolean"


def branch_size(words: int) -> int:
    """Words of a branch: 20,000, more for a vocabulary of over 20 million (so that the top of
    the trie stays small), at most 400,000 (a few hundred MB in a task)."""
    return min(400_000, max(20_000, words // 1000))


def near_words(words: DataFrame, *, branch_words: int | None = None, query_batch: int = 8192) -> DataFrame:
    """``word, n_near, best_n, best`` of the words with a word one edit away: how many, and the
    most frequent one (ties: the smallest).  ``words`` (``word, n``) should be a stored table;
    its words are distinct."""
    size = words.count()
    top = top_of(words, size, branch_words or branch_size(size))
    branches = sum(v[1] for v in top.values() if v)
    rows = map_arrow(words, _dealer(top), DEALT)
    dealt = rows.repartitionById(min(branches, 4000), F.pmod("branch", F.lit(min(branches, 4000))))
    found = map_arrow(dealt.sortWithinPartitions("branch", "role"), _search(query_batch), NEAR)
    first = F.min(F.struct((-F.col("best_n")).alias("less"), F.col("best")))
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), first.alias("_first")).select(
        "word", "n_near", (-F.col("_first")["less"]).alias("best_n"), F.col("_first")["best"].alias("best"))


def last_forms(forms: DataFrame, most: int, ratio: int, least: int) -> DataFrame:
    """``word, root``: the end of every word's chain of forms (``word, form``), by doubling.

    The n of a form is at least ``ratio`` times its word's, which bounds a chain by a
    logarithm of ``most``, the highest n."""
    spark = forms.sparkSession
    steps = max(1, math.ceil(math.log(max(most, 1) / least) / math.log(ratio)) + 1)
    base = shared_folder(spark, "spelling-roots")
    roots = forms.select("word", F.col("form").alias("root"))
    for i in range(math.ceil(math.log2(steps)) if steps > 1 else 0):
        roots = stored(roots, f"{base}/{i}")
        further = roots.select(F.col("word").alias("_w"), F.col("root").alias("_r"))
        roots = roots.join(further, roots.root == further["_w"], "left").select("word", F.coalesce("_r", "root").alias("root"))
    return roots


def variants(docs: DataFrame, *, least_letters: int = 6, least_count: int = 5, one_in: int = 199, ratio: int = 5,
             branch_words: int | None = None, query_batch: int = 8192) -> DataFrame:
    """``word, form, root, n, n_near, form_n`` of every word of the vocabulary: its form is its
    most frequent near word if that occurs ``ratio`` times as often, its root the last form."""
    spark = docs.sparkSession
    base = shared_folder(spark, "spelling")
    words = stored(vocabulary(docs, least_letters=least_letters, least_count=least_count, one_in=one_in), f"{base}/words")
    near = near_words(words, branch_words=branch_words, query_batch=query_batch)
    better = F.col("best_n") >= ratio * F.col("n")
    table = stored(words.join(near, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"),
        F.when(better, F.col("best")).alias("form"), F.when(better, F.col("best_n")).alias("form_n")), f"{base}/forms")
    most = words.agg(F.max("n")).first()[0] or 1
    roots = last_forms(table.where(F.col("form").isNotNull()), most, ratio, least_count).withColumnRenamed("word", "_w")
    return table.join(roots, table.word == F.col("_w"), "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
