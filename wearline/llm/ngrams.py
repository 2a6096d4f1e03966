"""Language-model scoring: interpolated modified Kneser-Ney over word pairs.

*Counting* is two Spark aggregations of packed rows.  A task turns a few million words into
sorted (hash, count) arrays and cuts them by hash range; a bucket merges the arrays of all
tasks.  Hot words and hot pairs are summed in the task, so each reaches its bucket once per
flush, however many rows hold it.

*The model* is a folder of sorted hash arrays in the shared folder, one shard per hash range:

* ``words-*``: hashes of the training words, ascending, and their counts.  A word's id is
  its place over all shards.
* ``pairs-*``: mixed 64-bit numbers of (id, id) pairs, ascending (the mixing is one-to-one,
  so pairs never collide), and their counts.
* ``lower-*``: by id, how many pairs begin with the word, by count 1, 2 and more, and how
  many pairs end with it.

Workers memory-map the shards: their pages belong to the operating system's cache, are
shared by all workers of a machine and can be dropped at any time.  A batch's distinct
hashes are sorted before they are looked up, so every shard is read in one direction.

*Probabilities.*  With discounts D(c) from the counts of counts (Chen and Goodman),
p(w|v) = (c(vw) - D(c(vw))) / c(v) + g(v) p(w), and p(w) in the same way from the number of
words that w follows, over a uniform share for each training word and one unknown word.
A text's score is the sum of log10 p over its words and its end, after a start mark.

* NULL text counts as empty: one token, the end.
* A row with NULL id is training data and not held out.  Repeated rows train as often as
  they occur and are scored each.
* No training row at all: every token has the uniform share of one unknown word, score 0.
* A text of any length is scored in pieces of a bounded number of words.
* An empty table gives no rows; only ``doc_id`` and ``text`` are read, so further columns may have
  any name.

The shards are files that executors write and map, so the shared folder must be mounted on
them (``file:`` in ``spark.checkpoint.dir``); another kind of store is refused.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wearline.llm.common import (
    WordHash, batch_bytes_of, buckets_for, crc_mod, map_arrow, mixed, shared_folder, stored)

END = np.uint64(0x656E64)  # stands for the end token among word hashes
PACKED = "bucket int, payload binary"
SCORED = ("doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, "
          "score double")
UNKNOWN = np.int64(-1)


def mounted(path: str, default: str = "file:///") -> str:
    """The local form of a shared path; ``default`` is the file system of paths without a
    scheme."""
    if "://" not in path and not path.startswith("file:"):
        path = default.rstrip("/") + "/" + path.lstrip("/")
    if not path.startswith("file:"):
        raise ValueError(f"the model's shards are memory-mapped; {path} is not a mounted folder")
    return "/" + path[5:].lstrip("/")


def bucket_of(h: np.ndarray, buckets: int) -> np.ndarray:
    """Hash range of each hash: ascending with the hash."""
    return ((h >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)


def write_array(path: str, values: np.ndarray) -> None:
    """Publish an array by renaming it: a repeated or speculative task writes the same."""
    part = f"{path}.{uuid.uuid4().hex}.part"
    values.tofile(part)
    os.replace(part, path)


def read_array(path: str, kind) -> np.ndarray:
    return np.memmap(path, kind, "r") if os.path.getsize(path) else np.zeros(0, kind)


FULL = (1 << 32) - 1  # a count of this or more stands in the array beside


def write_counts(path: str, counts: np.ndarray) -> None:
    """Counts as 32 bits each; the rare ones that need more, with their places, in a second
    array (pairs of 64 bits, places ascending)."""
    large = np.flatnonzero(counts >= FULL)
    if len(large):
        write_array(f"{path}-large", np.stack([large, counts[large]], axis=1).astype(np.int64))
    write_array(path, np.minimum(counts, FULL).astype(np.uint32))


def counts_at(narrow: np.ndarray, large: np.ndarray, places: np.ndarray) -> np.ndarray:
    """Counts at some places of an array written by ``write_counts``."""
    out = narrow[places].astype(np.int64)
    full = np.flatnonzero(out == FULL)
    if len(full):
        out[full] = large[np.searchsorted(large[:, 0], places[full]), 1]
    return out


def merged(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, ascending, and the sums of their counts."""
    if not len(keys):
        return keys, counts.astype(np.int64)
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    new = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
    return keys[new], np.add.reduceat(counts[order].astype(np.int64), new)


def _packed(keys: np.ndarray, counts: np.ndarray, buckets: int) -> pa.RecordBatch:
    """Sorted keys with counts as one packed row per hash range; a count over 255 is split
    into several entries."""
    times = np.maximum(1, -(-counts // 255))
    if times.max(initial=1) > 1:
        keys, rest = np.repeat(keys, times), np.repeat(counts, times)
        nth = np.arange(len(keys)) - np.repeat(np.append(0, np.cumsum(times)[:-1]), times)
        counts = np.minimum(255, rest - 255 * nth)
    edges = np.searchsorted(bucket_of(keys, buckets), np.arange(buckets + 1))
    found = np.flatnonzero(np.diff(edges))
    small = counts.astype(np.uint8)
    return pa.record_batch(
        [pa.array(found, pa.int32()),
         pa.array([np.int64(edges[b + 1] - edges[b]).tobytes() + keys[edges[b]:edges[b + 1]].tobytes()
                   + small[edges[b]:edges[b + 1]].tobytes() for b in found], pa.binary())],
        names=["bucket", "payload"])


def _unpacked(payloads: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    keys, counts = [], []
    for p in payloads:
        n = int(np.frombuffer(p, np.int64, 1)[0])
        keys.append(np.frombuffer(p, np.uint64, n, 8))
        counts.append(np.frombuffer(p, np.uint8, n, 8 + 8 * n))
    return np.concatenate(keys), np.concatenate(counts)


def texts_as_words(batches: Iterator[pa.RecordBatch], hashes: WordHash, piece: int):
    """(batch, row, word hashes, whether the text ends with them), texts cut to pieces of at
    most ``piece`` words."""
    for batch in batches:
        for row, text in enumerate(batch_bytes_of(batch, "text")):
            words = (text or b"").lower().split()
            for at in range(0, len(words) + 1, piece):
                h = hashes.of(words[at:at + piece])
                last = at + piece > len(words)
                yield batch, row, at == 0, (np.append(h, END) if last else h), last


def _by_bucket(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[bytes]]]:
    """Payloads of each bucket, from batches sorted by bucket."""
    now, held = None, []
    for batch in batches:
        for bucket, payload in zip(batch.column("bucket").to_pylist(), batch.column("payload").to_pylist(), strict=True):
            if bucket != now and held:
                yield now, held
                held = []
            now = bucket
            held.append(payload)
    if held:
        yield now, held


def dealt(rows: DataFrame, buckets: int) -> DataFrame:
    return rows.repartitionById(buckets, "bucket").sortWithinPartitions("bucket")


def _count_words(buckets: int, flush: int):
    def run(batches):
        hashes, held, size = WordHash(), [], 0
        for _, _, _, h, _ in texts_as_words(batches, hashes, flush):
            held.append(h)
            size += len(h)
            if size >= flush:
                yield _packed(*np.unique(np.concatenate(held), return_counts=True), buckets)
                held, size = [], 0
        if held:
            yield _packed(*np.unique(np.concatenate(held), return_counts=True), buckets)

    return run


def _store_words(folder: str):
    def run(batches):
        for bucket, payloads in _by_bucket(batches):
            keys, counts = merged(*_unpacked(payloads))
            write_array(f"{folder}/words-{bucket}.hash", keys)
            write_array(f"{folder}/words-{bucket}.count", counts)
            yield pa.record_batch([pa.array([bucket], pa.int32()), pa.array([len(keys)], pa.int64()),
                                   pa.array([int(counts.sum())], pa.int64())], names=["bucket", "n", "total"])

    return run


@dataclass
class Vocabulary:
    """The words of the training texts: shards of hashes and counts."""

    folder: str
    buckets: int
    offsets: np.ndarray  # id of each shard's first word, and the number of words
    total: int
    opened: dict = field(default_factory=dict, repr=False)

    def __getstate__(self):
        return {**self.__dict__, "opened": {}}

    @property
    def size(self) -> int:
        return int(self.offsets[-1])

    @property
    def start(self) -> int:
        """The start mark's id: it begins pairs like a word but is none."""
        return self.size

    def array(self, name: str, kind) -> np.ndarray:
        if name not in self.opened:
            self.opened[name] = read_array(f"{self.folder}/{name}", kind)
        return self.opened[name]

    def large(self, name: str) -> np.ndarray:
        """(place, count) of the counts that did not fit into the array ``name``."""
        key = f"{name}-large"
        if key not in self.opened:
            path = f"{self.folder}/{key}"
            self.opened[key] = read_array(path, np.int64).reshape(-1, 2) if os.path.exists(path) else np.zeros((0, 2), np.int64)
        return self.opened[key]

    def find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(id or UNKNOWN, count) of ascending distinct word hashes."""
        ids, counts = np.full(len(h), UNKNOWN), np.zeros(len(h), np.int64)
        for bucket, lo, hi in _shards(h, self.buckets, np.diff(self.offsets)):
            keys = self.array(f"words-{bucket}.hash", np.uint64)
            at, hit = _search(keys, h[lo:hi])
            ids[lo:hi][hit] = at[hit] + self.offsets[bucket]
            counts[lo:hi][hit] = self.array(f"words-{bucket}.count", np.int64)[at[hit]]
        return ids, counts


def _shards(h: np.ndarray, buckets: int, sizes: np.ndarray) -> Iterator[tuple[int, int, int]]:
    edges = np.searchsorted(bucket_of(h, buckets), np.arange(buckets + 1))
    for b in np.flatnonzero(np.diff(edges)):
        if sizes[b]:
            yield int(b), int(edges[b]), int(edges[b + 1])


def _search(keys: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
    return at, np.asarray(keys[at] == h)


def pair_hash(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """One-to-one 64-bit mix of two ids of at most 32 bits."""
    return mixed(first.astype(np.uint64) << np.uint64(32) | second.astype(np.uint64))


def unmixed(h: np.ndarray) -> np.ndarray:
    """Inverse of ``mixed``."""
    def unshift(x, s):
        out = x
        for _ in range(64 // s + 1):
            out = x ^ (out >> np.uint64(s))
        return out

    with np.errstate(over="ignore"):
        h = unshift(h, 33)
        h = h * np.uint64(pow(0x81DADEF4BC2DD44D, -1, 1 << 64))
        h = unshift(h, 27)
        h = h * np.uint64(pow(0x7FB5D329728EA185, -1, 1 << 64))
        return unshift(h, 31)


class Pieces:
    """Word ids of gathered texts, looked up together."""

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary = vocabulary
        self.held: list[np.ndarray] = []
        self.first: list[bool] = []
        self.size = 0
        self.tail = UNKNOWN  # last id of the previous flush, for a text cut there

    def add(self, words: np.ndarray, first: bool) -> None:
        self.held.append(words)
        self.first.append(first)
        self.size += len(words)

    def take(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids, counts, id before) of all gathered words; the first word of a text stands
        after the start mark."""
        h = np.concatenate(self.held)
        distinct, inverse = np.unique(h, return_inverse=True)
        ids, counts = self.vocabulary.find(distinct)
        ids, counts = ids[inverse], counts[inverse]
        before = np.empty(len(ids), np.int64)
        before[1:] = ids[:-1]
        before[0] = self.tail
        lengths = np.array([len(x) for x in self.held])
        begins = np.append(0, np.cumsum(lengths)[:-1])[np.array(self.first)]
        before[begins] = self.vocabulary.start
        self.tail = ids[-1]
        self.held, self.first, self.size = [], [], 0
        return ids, counts, before


def _count_pairs(vocabulary: Vocabulary, buckets: int, flush: int):
    def run(batches):
        hashes, pieces = WordHash(), Pieces(vocabulary)

        def out():
            ids, _, before = pieces.take()
            return _packed(*np.unique(pair_hash(before, ids), return_counts=True), buckets)

        for _, _, first, h, _ in texts_as_words(batches, hashes, flush):
            if len(h):
                pieces.add(h, first)
            if pieces.size >= flush:
                yield out()
        if pieces.size:
            yield out()

    return run


LOWER = "bucket int, payload binary, n long, c1 long, c2 long, c3 long, c4 long"


def _store_pairs(folder: str, buckets: int, width: int):
    """Writes the pairs of each hash range; its contexts and ends go on, by id range."""
    def run(batches):
        for bucket, payloads in _by_bucket(batches):
            keys, counts = merged(*_unpacked(payloads))
            write_array(f"{folder}/pairs-{bucket}.hash", keys)
            write_counts(f"{folder}/pairs-{bucket}.count", counts)
            raw = unmixed(keys)
            first, second = (raw >> np.uint64(32)).astype(np.int64), (raw & np.uint64(0xFFFFFFFF)).astype(np.int64)
            kind = np.minimum(counts, 3)  # 1, 2 or more; ends have kind 0
            code = np.concatenate([first * 4 + kind, second * 4])
            code, times = np.unique(code, return_counts=True)
            edges = np.searchsorted(code // 4 // width, np.arange(buckets + 1))
            found = np.flatnonzero(np.diff(edges))
            rows = [(int(b), np.int64(edges[b + 1] - edges[b]).tobytes()
                     + (code[edges[b]:edges[b + 1]] - 4 * width * b).astype(np.uint32).tobytes()
                     + times[edges[b]:edges[b + 1]].astype(np.uint32).tobytes(), 0, 0, 0, 0, 0) for b in found]
            rows.append((int(bucket), None, len(keys), *(int((counts == c).sum()) for c in (1, 2, 3, 4))))
            columns = list(zip(*rows, strict=True))
            kinds = (pa.int32(), pa.binary(), *[pa.int64()] * 5)
            yield pa.record_batch([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)],
                                  names=[x.split()[0] for x in LOWER.split(", ")])

    return run


def _store_lower(folder: str, width: int):
    def run(batches):
        for bucket, payloads in _by_bucket(batches):
            table = np.zeros(4 * width, np.int64)
            for p in payloads:
                n = int(np.frombuffer(p, np.int64, 1)[0])
                np.add.at(table, np.frombuffer(p, np.uint32, n, 8), np.frombuffer(p, np.uint32, n, 8 + 4 * n))
            write_array(f"{folder}/lower-{bucket}.count", table.astype(np.uint32))
            ends = table[0::4]
            yield pa.record_batch(
                [pa.array([bucket], pa.int32()), pa.array([int(ends.sum())], pa.int64()),
                 pa.array([int((ends > 0).sum())], pa.int64()),
                 *[pa.array([int((ends == c).sum())], pa.int64()) for c in (1, 2, 3, 4)]],
                names=["bucket", "total", "n", "c1", "c2", "c3", "c4"])

    return run


def discounts(n1: int, n2: int, n3: int, n4: int) -> np.ndarray:
    """D(0), D(1), D(2), D(3+) of modified Kneser-Ney; where counts of counts are missing a
    discount falls back to 0.5, 1 and 1.5, and none exceeds its count."""
    y = n1 / (n1 + 2 * n2) if n1 and n2 else 0.5
    d1 = 1 - 2 * y * n2 / n1 if n1 and n2 else 0.5
    d2 = 2 - 3 * y * n3 / n2 if n2 and n3 else 1.0
    d3 = 3 - 4 * y * n4 / n3 if n3 and n4 else 1.5
    return np.array([0.0, min(max(d1, 0.05), 1.0), min(max(d2, 0.05), 2.0), min(max(d3, 0.05), 3.0)])


@dataclass
class Model:
    """The trained model: small numbers, and the folder of its shards."""

    vocabulary: Vocabulary
    texts: int  # training texts: how often the start mark occurs
    pair_sizes: np.ndarray
    pair_discounts: np.ndarray
    width: int  # ids per shard of the lower order
    lower_shards: frozenset
    ends: int  # number of distinct pairs
    end_kinds: tuple[int, int, int]  # words by the number of words they follow: 1, 2, more
    end_discounts: np.ndarray

    def lower(self, ids: np.ndarray) -> np.ndarray:
        """(ends, begins with count 1, 2, more) for ids; zeros for unknown ones."""
        out = np.zeros((len(ids), 4), np.int64)
        distinct, inverse = np.unique(ids, return_inverse=True)
        rows = np.zeros((len(distinct), 4), np.int64)
        edges = np.searchsorted(distinct // self.width, np.arange(len(self.pair_sizes) + 1))
        for b in np.flatnonzero(np.diff(edges)):
            if b in self.lower_shards:
                table = self.vocabulary.array(f"lower-{b}.count", np.uint32).reshape(-1, 4)
                rows[edges[b]:edges[b + 1]] = table[distinct[edges[b]:edges[b + 1]] - b * self.width]
        out[:] = rows[inverse]
        return out

    def pair_counts(self, before: np.ndarray, ids: np.ndarray) -> np.ndarray:
        known = (before >= 0) & (ids >= 0)
        distinct, inverse = np.unique(pair_hash(before[known], ids[known]), return_inverse=True)
        counts = np.zeros(len(distinct), np.int64)
        for b, lo, hi in _shards(distinct, len(self.pair_sizes), self.pair_sizes):
            at, hit = _search(self.vocabulary.array(f"pairs-{b}.hash", np.uint64), distinct[lo:hi])
            counts[lo:hi][hit] = counts_at(self.vocabulary.array(f"pairs-{b}.count", np.uint32),
                                           self.vocabulary.large(f"pairs-{b}.count"), at[hit])
        out = np.zeros(len(ids), np.int64)
        out[known] = counts[inverse]
        return out

    def probabilities(self, ids: np.ndarray, counts: np.ndarray, before: np.ndarray, before_counts: np.ndarray) -> np.ndarray:
        """p(word | word before) for each position."""
        uniform = 1.0 / (self.vocabulary.size + 1)
        if not self.ends:
            return np.full(len(ids), uniform)
        d = self.end_discounts
        spare = float(np.dot(d[1:], self.end_kinds)) / self.ends
        ends = self.lower(ids)[:, 0]
        low = np.maximum(ends - d[np.minimum(ends, 3)], 0.0) / self.ends + spare * uniform
        d = self.pair_discounts
        pair = self.pair_counts(before, ids)
        begins = self.lower(before)[:, 1:]
        total = np.maximum(before_counts, 1)
        high = np.maximum(pair - d[np.minimum(pair, 3)], 0.0) / total
        weight = np.where(before_counts > 0, begins @ d[1:] / total, 1.0)
        return high + weight * low


def train(docs: DataFrame, *, bucket_mb: int = 64, flush_words: int = 1_500_000) -> Model:
    """Count the words and pairs of all of ``docs`` and store the model's shards."""
    spark = docs.sparkSession
    base = shared_folder(spark, "ngrams")
    hadoop = spark.sparkContext._jsc.hadoopConfiguration()
    folder = mounted(base, hadoop.get("fs.defaultFS", "file:///")) + "/model"
    os.makedirs(folder, exist_ok=True)
    texts = docs.select("text")
    buckets = buckets_for(texts, bucket_mb)

    words = dealt(texts.transform(map_arrow, _count_words(buckets, flush_words), PACKED), buckets)
    sizes = stored(words.transform(map_arrow, _store_words(folder), "bucket int, n long, total long"), f"{base}/words").collect()
    per = np.zeros(buckets, np.int64)
    for r in sizes:  # one row per hash range
        per[r["bucket"]] = r["n"]
    vocabulary = Vocabulary(folder, buckets, np.append(0, np.cumsum(per)), sum(r["total"] for r in sizes))
    if vocabulary.size >= (1 << 32) - 1:
        raise ValueError("more than 2^32 - 2 distinct words")
    end = vocabulary.find(np.array([END]))[1][0]

    width = -(-(vocabulary.size + 1) // buckets)
    pairs = dealt(texts.transform(map_arrow, _count_pairs(vocabulary, buckets, flush_words), PACKED), buckets)
    lower = stored(pairs.transform(map_arrow, _store_pairs(folder, buckets, width), LOWER), f"{base}/lower-rows")
    per = np.zeros(buckets, np.int64)
    kinds = np.zeros(4, np.int64)
    for r in lower.where("payload IS NULL").collect():  # one row per hash range
        per[r["bucket"]] = r["n"]
        kinds += [r[f"c{c}"] for c in (1, 2, 3, 4)]
    shards = stored(dealt(lower.where("payload IS NOT NULL").select("bucket", "payload"), buckets).transform(map_arrow, _store_lower(folder, width), "bucket int, total long, n long, c1 long, c2 long, c3 long, c4 long"),
        f"{base}/ends").collect()
    total = {k: sum(r[k] for r in shards) for k in ("total", "n", "c1", "c2", "c3", "c4")}
    more = total["n"] - total["c1"] - total["c2"]
    return Model(vocabulary, int(end), per, discounts(*kinds.tolist()), width, frozenset(r["bucket"] for r in shards),
                 total["total"], (total["c1"], total["c2"], more),
                 discounts(total["c1"], total["c2"], total["c3"], total["c4"]))


def _score_function(model: Model, flush: int):
    vocabulary = model.vocabulary

    def run(batches):
        hashes, pieces = WordHash(), Pieces(vocabulary)
        waiting: list[list] = []  # rows not yet given out: id, held out, tokens, known, base, score
        of: list[int] = []  # per piece, its place in `waiting`
        ended: list[bool] = []
        tail_count = 0

        def settle() -> None:
            nonlocal tail_count
            lengths = np.array([len(x) for x in pieces.held])
            first = np.array(pieces.first)
            ids, counts, before = pieces.take()
            before_counts = np.empty(len(ids), np.int64)
            before_counts[1:] = counts[:-1]
            before_counts[0] = tail_count
            at = np.append(0, np.cumsum(lengths)[:-1])
            before_counts[at[first]] = model.texts
            tail_count = counts[-1]
            p = np.log10(model.probabilities(ids, counts, before, before_counts))
            base = np.log10((counts + 1.0) / (vocabulary.total + vocabulary.size + 1.0))
            for place, n, known, b, s in zip(of, lengths.tolist(), np.add.reduceat(counts > 0, at, dtype=np.int64).tolist(),
                                             np.add.reduceat(base, at).tolist(), np.add.reduceat(p, at).tolist(),
                                             strict=True):
                row = waiting[place]
                row[2] += n
                row[3] += known
                row[4] += b
                row[5] += s

        def out(rows: list[list]) -> pa.RecordBatch:
            i, held, n, known, base, score = zip(*rows, strict=True)
            return pa.record_batch(
                [pa.array(i, pa.int64()), pa.array(held, pa.bool_()), pa.array(n, pa.int64()), pa.array(known, pa.int64()),
                 pa.array([vocabulary.total] * len(n), pa.int64()), pa.array(base, pa.float64()),
                 pa.array(score, pa.float64())], names=[x.split()[0] for x in SCORED.split(", ")])

        def columns():
            for batch in batches:
                columns.ids = batch.column("doc_id").cast(pa.int64()).to_pylist()
                columns.held = batch.column("held_out").to_pylist()
                yield batch

        for _, row, first, h, last in texts_as_words(columns(), hashes, flush):
            if first:
                waiting.append([columns.ids[row], columns.held[row], 0, 0, 0.0, 0.0])
            if len(h):
                pieces.add(h, first)
                of.append(len(waiting) - 1)
            if pieces.size >= flush:
                settle()
                done = waiting if last else waiting[:-1]
                if done:
                    yield out(done)
                waiting, of = ([] if last else waiting[-1:]), []
        if pieces.size:
            settle()
        if waiting:
            yield out(waiting)

    return run


def scores(docs: DataFrame, model: Model, *, flush_words: int = 1_000_000) -> DataFrame:
    """Per document: tokens, known tokens, the model's log10 probability and that of the
    add-one unigram model.  ``docs`` has ``doc_id, held_out, text``; a narrow transformation."""
    return docs.select("doc_id", "held_out", "text").transform(map_arrow, _score_function(model, flush_words), SCORED)


def held_out(modulus: int = 7, remainder: int = 2):
    return F.coalesce(crc_mod("doc_id", modulus) == remainder, F.lit(False)).alias("held_out")


def train_and_score(docs: DataFrame, *, modulus: int = 7, remainder: int = 2, bucket_mb: int = 64) -> DataFrame:
    """Scores of all documents under the model of those that are not held out."""
    marked = docs.select("doc_id", held_out(modulus, remainder), "text")
    model = train(marked.where(~F.col("held_out")), bucket_mb=bucket_mb)
    return scores(marked, model)


def perplexity(scored: DataFrame) -> DataFrame:
    """Adds ``perplexity``, 10 to the power of the negative mean score per token."""
    return scored.withColumn("perplexity", F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")))
