"""Substring dedup: seed and extend over winnowed anchors.

A window is ``width`` consecutive words.  Of the ``seed_words``-word hashes inside a window
the smallest (the first of equal ones) is its anchor.  The choice depends on the window's
words alone, so wherever the same words stand, the same anchor stands at the same place in
them: two equal windows always meet at one seed.

1. *Seed.*  Documents are cut into anchor occurrences.  Each carries the position and, for
   every window that holds it as anchor, the hash of that window, which is the seed extended
   to both sides up to the length threshold.
2. Occurrences are dealt by anchor into hash buckets as packed rows.  Within one flush of a
   task, windows seen before are marked at once and only the first is sent on, so a passage
   that a third of all documents share reaches its bucket once per flush.  A short phrase that
   many documents share between different words is one anchor of many windows: anchors that
   are frequent in a sample of the documents are *hot*, and their windows are dealt one by one
   by a second hash of the window.  The sample decides only who compares them.
3. *Extend.*  Per bucket, occurrences of an anchor are compared by their window hashes: 64
   bits of the seed (of the second window hash, if it is hot) and 64 of the window must agree.
   All but the first in the order of documents and positions start a repeat.
4. Overlapping repeats are merged to the maximal ones, ``[start, end)`` in words, and joined
   to their documents.

* NULL or empty text, and one of fewer than ``width`` words, has no repeats.
* NULL ids come before all others.  Rows of the same id and text are one document: none is
  earlier than the other, and each gets the same spans.  Rows of one id and different texts
  are different documents, in the order of the texts' hashes.
* Memory per task is one flush, one bucket, or one very long document, whose windows are all
  in one flush.  An empty table has no spans; other columns keep their names and values.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wearline.llm.common import (
    MULT, WordHash, batch_bytes_of, buckets_for, map_arrow, mixed, shared_folder, stored, window_hashes)

NO_ID = -(1 << 63)  # stands for a NULL id, before all others
SEEDS, SPANS = 0, 1
PACKED = "bucket int, kind int, payload binary"
SPAN_ROWS = "key long, text_key int, start int, stop int"


def doc_key() -> Column:
    return F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID))


def text_key() -> Column:
    """31 bits of the text's hash: tells texts of one id apart."""
    return F.shiftrightunsigned(F.xxhash64(F.coalesce("text", F.lit(""))), 33).cast("int")


def anchors(words: np.ndarray, width: int, seed_words: int, hot: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Per window: hash of its anchor (of the window anew, if that is one of the sorted ``hot``
    ones), hash of the window."""
    windows = window_hashes(words, width)
    if not len(windows):
        return windows, windows
    seeds = window_hashes(words, seed_words)
    anchor = np.lib.stride_tricks.sliding_window_view(seeds, width - seed_words + 1).min(axis=1)
    if hot is not None and len(hot):
        is_hot = hot[np.minimum(np.searchsorted(hot, anchor), len(hot) - 1)] == anchor
        if is_hot.any():
            anchor = np.where(is_hot, window_hashes(mixed(words), width), anchor)
    return anchor, windows


def hot_anchors(docs: DataFrame, width: int, seed_words: int, buckets: int, one_in: int, most: int = 50_000) -> np.ndarray:
    """Sorted hashes of the anchors that hold, by a sample of one in ``one_in`` documents, over a
    twentieth of a bucket's windows: by that measure fewer than 20 a bucket, ``most`` at the
    utmost (400 KB to every task).

    The sample is drawn by a hash of the id.  Tasks count before the shuffle and send only
    anchors seen twice in one flush of the sample."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, held, size = WordHash(), [], 0

        def give() -> pa.RecordBatch:
            found, n = np.unique(np.concatenate(held), return_counts=True)
            often = n > 1
            return pa.record_batch([pa.array(np.append(found[often], np.uint64(0)).view(np.int64)), pa.array(np.append(n[often], 0)),
                                    pa.array(np.append(np.zeros(often.sum(), np.int64), n.sum()))], names=["anchor", "n", "total"])

        for batch in batches:
            for content in batch_bytes_of(batch, "text"):
                words = (content or b"").split()
                if len(words) >= width:
                    held.append(anchors(hashes.of(words), width, seed_words)[0])
                    size += len(held[-1])
                if size > 1_000_000:
                    yield give()
                    held, size = [], 0
        if held:
            yield give()

    sample = docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(one_in)) == 0).select("text")
    counts = (sample.transform(map_arrow, run, "anchor long, n long, total long").groupBy("anchor")
              .agg(F.sum("n").alias("n"), F.sum("total").alias("total")))
    counts = stored(counts, shared_folder(docs.sparkSession, "repeats-anchors"))
    total = counts.agg(F.sum("total")).first()[0] or 0
    least = max(16, total // (20 * buckets))
    rows = counts.where((F.col("n") > least)).orderBy(F.desc("n"), "anchor").limit(most).select("anchor").collect()
    return np.sort(np.array([r[0] for r in rows], np.int64).view(np.uint64))


def _not_first(anchor: np.ndarray, window: np.ndarray, doc: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Marks windows whose words also start earlier.  Input in the order of documents and
    starts; ``doc`` is equal for rows of one document."""
    if not len(anchor):
        return np.zeros(0, bool)
    with np.errstate(over="ignore"):
        key = anchor * MULT + window
    order = np.argsort(key, kind="stable")
    a, w = anchor[order], window[order]
    new = np.ones(len(order), bool)
    new[1:] = (a[1:] != a[:-1]) | (w[1:] != w[:-1])
    first = order[np.flatnonzero(new)[np.cumsum(new) - 1]]
    later = np.empty(len(order), bool)
    later[order] = (doc[order] != doc[first]) | (start[order] != start[first])
    return later


def _runs(breaks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and lengths of the runs that begin where ``breaks`` is true."""
    at = np.flatnonzero(breaks)
    return at, np.diff(np.append(at, len(breaks)))


def _span_payload(key, text, start, width: int) -> bytes:
    """Marked windows (in order) as packed spans of words."""
    new = np.ones(len(start), bool)
    new[1:] = (key[1:] != key[:-1]) | (text[1:] != text[:-1]) | (start[1:] != start[:-1] + 1)
    at, n = _runs(new)
    return b"".join([np.int32(len(at)).tobytes(), key[at].tobytes(), text[at].tobytes(),
                     start[at].astype(np.int32).tobytes(), (start[at] + n - 1 + width).astype(np.int32).tobytes()])


def _take(payload: bytes, at: int, kind, n: int) -> tuple[np.ndarray, int]:
    return np.frombuffer(payload, kind, n, at), at + n * np.dtype(kind).itemsize


class Flush:
    """The windows of the documents gathered by a task since the last flush."""

    def __init__(self, width: int, seed_words: int, buckets: int, hot: np.ndarray | None = None):
        self.width, self.seed_words, self.buckets, self.hot = width, seed_words, buckets, hot
        self.docs: list[tuple[int, int, np.ndarray, np.ndarray]] = []
        self.size = 0

    def add(self, key: int, text: int, words: np.ndarray) -> None:
        anchor, window = anchors(words, self.width, self.seed_words, self.hot)
        if len(anchor):
            self.docs.append((key, text, anchor, window))
            self.size += len(anchor)

    def rows(self) -> Iterator[tuple[int, int, bytes]]:
        """Packed rows: marked spans, and per bucket the seeds not seen before."""
        docs = sorted(self.docs, key=lambda d: d[:2])
        self.docs, self.size = [], 0
        if not docs:
            return
        lengths = [len(d[2]) for d in docs]
        number, last = [], None
        for d in docs:  # rows of the same id and text share a number
            number.append(number[-1] + (d[:2] != last) if number else 0)
            last = d[:2]
        doc = np.repeat(np.array(number, np.int32), lengths)
        key = np.repeat(np.array([d[0] for d in docs], np.int64), lengths)
        text = np.repeat(np.array([d[1] for d in docs], np.int32), lengths)
        start = np.concatenate([np.arange(n, dtype=np.int32) for n in lengths])
        anchor = np.concatenate([d[2] for d in docs])
        window = np.concatenate([d[3] for d in docs])
        del docs
        later = _not_first(anchor, window, doc, start)
        if later.any():
            yield int(doc[-1]) % self.buckets, SPANS, _span_payload(key[later], text[later], start[later], self.width)
            left = ~later
            doc, key, text, start, anchor, window = (x[left] for x in (doc, key, text, start, anchor, window))
        if not len(anchor):
            return
        new = np.ones(len(anchor), bool)  # runs of windows around one anchor occurrence
        new[1:] = (anchor[1:] != anchor[:-1]) | (doc[1:] != doc[:-1]) | (start[1:] != start[:-1] + 1)
        at, n = _runs(new)
        # A long run of one repeated word has one anchor: cut it to counts that fit a byte.
        while n.max() > 255:
            new[at[n > 255] + 255] = True
            at, n = _runs(new)
        bucket = (anchor[at] % np.uint64(self.buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        edges = np.searchsorted(bucket[order], np.arange(self.buckets + 1))
        for b in np.flatnonzero(np.diff(edges)):
            runs = order[edges[b]:edges[b + 1]]
            first, count = at[runs], n[runs]
            inside = np.repeat(first - np.append(0, np.cumsum(count)[:-1]), count) + np.arange(count.sum())
            w = window[inside]
            yield int(b), SEEDS, b"".join([
                np.array([len(runs), len(w)], np.int32).tobytes(), anchor[first].tobytes(), key[first].tobytes(),
                text[first].tobytes(), start[first].tobytes(), w.tobytes(), count.astype(np.uint8).tobytes()])


def _seed_function(width: int, seed_words: int, buckets: int, flush_words: int, hot=None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, flush = WordHash(), Flush(width, seed_words, buckets, hot)

        def packed(rows) -> pa.RecordBatch:
            kinds = (pa.int32(), pa.int32(), pa.binary())
            return pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)],
                                   names=["bucket", "kind", "payload"])

        def out() -> Iterator[pa.RecordBatch]:
            rows, size = [], 0
            for row in flush.rows():
                rows.append(row)
                size += len(row[2])
                if size > 8 << 20:
                    yield packed(rows)
                    rows, size = [], 0
            if rows:
                yield packed(rows)

        for batch in batches:
            keys, texts = batch.column("key").to_pylist(), batch.column("text_key").to_pylist()
            for key, text, content in zip(keys, texts, batch_bytes_of(batch, "text"), strict=True):
                words = (content or b"").split()
                if len(words) >= width:
                    flush.add(key, text, hashes.of(words))
                if flush.size >= flush_words:
                    yield from out()
        yield from out()

    return run


def _bucket_spans(payloads: list[bytes], width: int) -> list[np.ndarray]:
    """Spans (key, text, start, stop) of the repeats among the seeds of one bucket."""
    columns: list[list[np.ndarray]] = [[] for _ in range(6)]
    for p in payloads:
        (runs, windows), at = _take(p, 0, np.int32, 2)
        for i, (kind, n) in enumerate(((np.uint64, runs), (np.int64, runs), (np.int32, runs), (np.int32, runs),
                                       (np.uint64, windows), (np.uint8, runs))):
            x, at = _take(p, at, kind, n)
            columns[i].append(x)
    anchor, key, text, start, window, count = map(np.concatenate, columns)
    count = count.astype(np.int64)
    first = np.append(0, np.cumsum(count)[:-1])
    order = np.lexsort((start, text, key))
    n = count[order]
    offset = np.arange(n.sum()) - np.repeat(np.append(0, np.cumsum(n)[:-1]), n)
    window = window[np.repeat(first[order], n) + offset]
    starts = (np.repeat(start[order], n) + offset).astype(np.int32)
    key, text = np.repeat(key[order], n), np.repeat(text[order], n)
    new = np.ones(len(key), bool)
    new[1:] = (key[1:] != key[:-1]) | (text[1:] != text[:-1])
    later = _not_first(np.repeat(anchor[order], n), window, np.cumsum(new), starts)
    if not later.any():
        return []
    return [_span_payload(key[later], text[later], starts[later], width)]


def _unpack_spans(payload: bytes) -> pa.RecordBatch:
    (n,), at = _take(payload, 0, np.int32, 1)
    out = []
    for kind in (np.int64, np.int32, np.int32, np.int32):
        x, at = _take(payload, at, kind, n)
        out.append(pa.array(x))
    return pa.record_batch(out, names=["key", "text_key", "start", "stop"])


def _extend_function(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []
        for batch in batches:  # sorted by bucket
            for bucket, kind, payload in zip(*(batch.column(c).to_pylist() for c in ("bucket", "kind", "payload")),
                                             strict=True):
                if kind == SPANS:
                    yield _unpack_spans(payload)
                    continue
                if bucket != now and held:
                    yield from map(_unpack_spans, _bucket_spans(held, width))
                    held = []
                now = bucket
                held.append(payload)
        if held:
            yield from map(_unpack_spans, _bucket_spans(held, width))

    return run


def repeat_spans(docs: DataFrame, *, width: int = 20, seed_words: int = 6, bucket_mb: int = 32,
                 flush_words: int = 500_000, sample_one_in: int = 50) -> DataFrame:
    """``key, text_key, spans``: per document the word spans whose windows occur earlier.

    One shuffle of packed seeds (about 11 bytes a word) and one of the spans; a sample of the
    documents, one in ``sample_one_in``, is read before for its frequent anchors."""
    if not 1 <= seed_words <= width:
        raise ValueError("seed_words must lie between 1 and width")
    buckets = buckets_for(docs.select("doc_id", "text"), bucket_mb)
    hot = hot_anchors(docs, width, seed_words, buckets, sample_one_in)
    seeds = docs.select(doc_key().alias("key"), text_key().alias("text_key"), "text").transform(
        map_arrow, _seed_function(width, seed_words, buckets, flush_words, hot), PACKED)
    spans = (seeds.repartitionById(buckets, "bucket").sortWithinPartitions("bucket")
             .transform(map_arrow, _extend_function(width), SPAN_ROWS))
    return spans.groupBy("key", "text_key").agg(F.collect_list(F.struct("start", "stop")).alias("spans"))


def _cut_function(make, handle):
    """Arrow function that passes (batch, made, n words, n removed) per batch to ``handle``;
    ``made`` holds ``make(kept words joined by one space, number removed)`` of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for first in range(0, len(whole), 1000):
                batch = whole.slice(first, 1000)
                made, total, removed = [], [], []
                for content, spans in zip(batch_bytes_of(batch, "text"), batch.column("__llm_spans").to_pylist(), strict=True):
                    words = (content or b"").split()
                    n = len(words)
                    if spans:
                        gone = np.zeros(n + 1, np.int32)
                        for s in spans:
                            gone[s["start"]] += 1
                            gone[s["stop"]] -= 1
                        words = [words[i] for i in np.flatnonzero(np.cumsum(gone[:-1]) == 0)]
                    made.append(make(b" ".join(words), n - len(words)))
                    total.append(n)
                    removed.append(n - len(words))
                yield handle(batch, made, total, removed)

    return run


def _with_spans(docs: DataFrame, **options) -> DataFrame:
    spans = repeat_spans(docs, **options).select(
        F.col("key").alias("__llm_id"), F.col("text_key").alias("__llm_text"), F.col("spans").alias("__llm_spans"))
    keyed = docs.withColumn("__llm_k", doc_key()).withColumn("__llm_t", text_key())
    return keyed.join(spans, (F.col("__llm_k") == F.col("__llm_id")) & (F.col("__llm_t") == F.col("__llm_text")),
                      "left").drop("__llm_k", "__llm_t", "__llm_id", "__llm_text")


def remove_repeats(docs: DataFrame, **options) -> DataFrame:
    """``doc_id, n_words, n_removed, kept_sha256`` for every document."""

    def handle(batch, made, total, removed):
        return pa.record_batch(
            [batch.column("doc_id").cast(pa.int64()), pa.array(total, pa.int64()), pa.array(removed, pa.int64()),
             pa.array(made, pa.string())],
            names=["doc_id", "n_words", "n_removed", "kept_sha256"])

    schema = "doc_id long, n_words long, n_removed long, kept_sha256 string"
    joined = _with_spans(docs.select("doc_id", "text"), **options)
    return joined.transform(map_arrow, _cut_function(lambda text, _: hashlib.sha256(text).hexdigest(), handle), schema)


def cut_repeats(docs: DataFrame, **options) -> DataFrame:
    """All columns of ``docs`` with the repeats cut out of ``text`` (kept words joined by one
    space; texts without repeats unchanged) and ``n_chars`` brought up to date if present."""
    names, schema = docs.columns, docs.schema

    def handle(batch, made, total, removed):
        old = batch.column("text").to_pylist()
        new = [t if m is None else m.decode() for t, m in zip(old, made, strict=True)]
        columns = []
        for name in names:
            column = batch.column(name)
            if name == "text":
                column = pa.array(new, column.type)
            elif name == "n_chars":
                column = pa.array([c if not r else len(t) for c, t, r in zip(
                    column.to_pylist(), new, removed, strict=True)], column.type)
            columns.append(column)
        return pa.record_batch(columns, names=names)

    return _with_spans(docs, **options).transform(map_arrow, _cut_function(lambda text, removed: text if removed else None, handle), schema)
