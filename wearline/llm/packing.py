"""Packing along a space-filling curve: similar documents share sequences.

1. *Encode.*  A document becomes its token ids and an end id.  Blanks are safe boundaries of
   the tokenizer, so the distinct words of a batch are encoded, many to a call, and the ids of
   a text are gathered from them.
2. *Project.*  Ids are hashed into a vector of counts; its logarithms, centred and of unit
   length, are projected on a few fixed random directions.  The cell of the point in a fine
   grid has a place on the Hilbert curve: that is the document's key.
3. *Sort.*  Only keys, ids of rows and lengths are ranged and sorted; a running sum within
   each range, and the sums of the ranges before it, give the place of a document's first
   token along the curve.
4. *Pack.*  Token ``p`` of the curve belongs to sequence ``p // length``: every sequence is
   full, and a document is cut where a sequence ends.  The rest at the end of the curve goes
   to sequences whose lengths are powers of two, so nothing is padded.

* NULL and empty texts are the end id alone.  NULL ids come first among equal keys; repeated
  rows are documents of their own, next to each other.
* A very long text fills several sequences; it is encoded as a batch of its own.
* Equal keys (copies) are ordered by id, so a group of copies is dealt to many ranges.
* An empty table gives no pieces; further columns are not read.
"""

from __future__ import annotations

import json
import zlib
from bisect import bisect_right
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wearline.llm.common import map_arrow, shared_folder, shares, stored
from wearline.llm.tokens import drops_blanks, load_tokenizer

BINS, DIMENSIONS, BITS = 128, 4, 15
PIECES = ("doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")


# Words of small letters that every step before the merges leaves as they are: composed, in lower
# case, one run of letters.  Fixed ranges of ASCII and Latin-1.
SMALL = "a-zß-öø-ÿ"
PLAIN = f"^[{SMALL}]+$"
LATIN = "^[A-Za-zÀ-ÖØ-öø-ÿ]+$"
# ASCII marks between such a letter and a blank are a word of their own to the tokenizer (but an
# apostrophe may begin one).
MARKED = f"([{SMALL}])([!-&(-/:-@\\[-`{{-~]+)(\\s|$)"


def plain_tokenizer(content: bytes):
    """The tokenizer without the steps that leave ``PLAIN`` words alone, for such words parted by
    blanks; None if its rules are others than those this holds for: white space and case are
    normalised, runs of letters are words, a word's last token bears a suffix."""
    rules = json.loads(content)
    steps = [n["type"] for n in (rules.get("normalizer") or {}).get("normalizers", [])]
    parts = (rules.get("pre_tokenizer") or {}).get("pretokenizers", [])
    if (set(steps) - {"NFC", "Replace", "Lowercase"} or [x["type"] for x in parts] != ["Split", "ByteLevel"]
            or "[\\p{L}]+" not in str(parts[0]["pattern"].get("Regex")) or not rules["model"].get("end_of_word_suffix")):
        return None
    rules["normalizer"], rules["added_tokens"] = None, []
    rules["pre_tokenizer"]["pretokenizers"][0] = {"type": "WhitespaceSplit"}
    return load_tokenizer("json", json.dumps(rules).encode())


@lru_cache(maxsize=2)
def tokenizers_of(content: bytes):
    """The tokenizer and the one for plain words, loaded once per worker."""
    by_words = drops_blanks("json", content)
    return load_tokenizer("json", content), by_words, plain_tokenizer(content) if by_words else None


class TextIds:
    """Token ids of texts, through a bounded table of words where blanks part them safely."""

    def __init__(self, content: bytes, cache_words: int, together: int = 200):
        self.tokenizer, self.by_words, self.plain = tokenizers_of(content)
        self.cache_words, self.together = cache_words, together
        self.size = self.tokenizer.get_vocab_size(with_added_tokens=True)
        if self.plain is not None:
            suffix = json.loads(content)["model"]["end_of_word_suffix"]
            self.last = np.array([(self.tokenizer.id_to_token(i) or "").endswith(suffix) for i in range(self.size)])
        self._clear()

    def _clear(self) -> None:
        self.places: dict[str, int] = {}  # word -> its number
        self.ids: list[np.ndarray] = [np.zeros(0, np.uint32)]
        self.counts: list[np.ndarray] = [np.zeros(0, np.int64)]

    def _alone(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, words: pa.Array) -> None:
        """Add words to the table: plain ones many to a call, told apart again by the suffix of
        a word's last token; any other one by itself."""
        if self.plain is not None:
            lowered = pc.if_else(pc.match_substring_regex(words, LATIN), pc.utf8_lower(words), words)
            is_plain = pc.match_substring_regex(lowered, PLAIN)
            plain, lowered = words.filter(is_plain).to_pylist(), lowered.filter(is_plain).to_pylist()
            words = words.filter(pc.invert(is_plain))
            for k in range(0, len(plain), self.together):
                some = slice(k, k + self.together)
                ids = np.array(self.plain.encode_batch_fast([" ".join(lowered[some])], add_special_tokens=False)[0].ids, np.uint32)
                self._add(plain[some], ids, np.diff(np.flatnonzero(self.last[ids]), prepend=-1))
        rest = words.to_pylist()
        found = self._alone(rest)
        self._add(rest, np.fromiter((i for ids in found for i in ids), np.uint32), np.fromiter(map(len, found), np.int64, len(found)))

    def _add(self, words: list[str], ids: np.ndarray, counts: np.ndarray) -> None:
        if len(counts) != len(words) or counts.sum() != len(ids):
            raise ValueError("the tokenizer parts words otherwise than its rules say")
        first = len(self.places)
        self.places.update(zip(words, range(first, first + len(words))))
        self.ids.append(ids)
        self.counts.append(counts)

    def of(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts in a row, number of ids of each text)."""
        if not self.by_words:
            found = self._alone(texts.to_pylist())
            return np.fromiter((i for ids in found for i in ids), np.uint32), np.fromiter(map(len, found), np.int64, len(found))
        if self.plain is not None:  # fewer words differ; a special token's string stays as it is
            ready = pc.replace_substring_regex(pc.ascii_lower(texts), MARKED, r"\1 \2\3")
            texts = pc.if_else(pc.match_substring(texts, "<|"), texts, ready)
        lists = pc.ascii_split_whitespace(texts)
        numbered = pc.dictionary_encode(lists.flatten())
        words = numbered.dictionary.to_pylist()
        if len(self.places) > self.cache_words:
            self._clear()
        new = [w not in self.places for w in words]
        if any(new):
            self._learn(numbered.dictionary.filter(pa.array(new)))
        pool, sizes = (np.concatenate(x) for x in (self.ids, self.counts))
        self.ids, self.counts = [pool], [sizes]
        starts = np.cumsum(sizes) - sizes
        word = np.fromiter(map(self.places.__getitem__, words), np.int64, len(words))[numbered.indices.to_numpy()]
        n = sizes[word]
        ends = np.cumsum(n)
        total = int(ends[-1]) if len(ends) else 0
        ids = pool[np.repeat(starts[word] - (ends - n), n) + np.arange(total)]
        cuts = np.r_[0, ends][lists.offsets.to_numpy() - lists.offsets[0].as_py()]
        return ids, np.diff(cuts)


def hilbert(cells: np.ndarray, bits: int) -> np.ndarray:
    """Place on the Hilbert curve of grid cells (one row of ``dimensions`` coordinates below
    ``2 ** bits`` each): the curve's rotations are undone from the highest bit down, the rest
    is the inverse of a Gray code over the interleaved bits."""
    x = [c.copy() for c in cells.T.astype(np.uint64)]
    one = np.uint64(1)
    for bit in range(bits - 1, 0, -1):
        q, low = np.uint64(1 << bit), np.uint64((1 << bit) - 1)
        for i in range(len(x)):
            upper = (x[i] & q) != 0
            swap = np.where(upper, 0, (x[0] ^ x[i]) & low)
            x[0] ^= np.where(upper, low, swap)
            x[i] ^= swap
    for i in range(1, len(x)):
        x[i] ^= x[i - 1]
    flip = np.zeros(len(cells), np.uint64)
    for bit in range(bits - 1, 0, -1):
        flip ^= np.where(x[-1] & np.uint64(1 << bit), np.uint64((1 << bit) - 1), np.uint64(0))
    key = np.zeros(len(cells), np.uint64)
    for bit in range(bits - 1, -1, -1):
        for c in x:
            key = (key << one) | (((c ^ flip) >> np.uint64(bit)) & one)
    return key.astype(np.int64)


def directions(seed: int = 13) -> np.ndarray:
    return np.random.default_rng(seed).standard_normal((BINS, DIMENSIONS))


def curve_keys(ids: np.ndarray, counts: np.ndarray, onto: np.ndarray) -> np.ndarray:
    """Hilbert keys of documents given by their ids in a row and the number of each."""
    of = np.repeat(np.arange(len(counts)), counts)
    bins = (ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(57)).astype(np.int64)  # 7 bits
    v = np.log1p(np.bincount(of * BINS + bins, minlength=len(counts) * BINS).reshape(-1, BINS))
    v -= v.mean(axis=1, keepdims=True)
    v /= np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)
    share = 1 / (1 + np.exp(-1.7 * (v @ onto)))  # close to even over the grid for a normal law
    return hilbert(np.minimum((share * (1 << BITS)).astype(np.int64), (1 << BITS) - 1), BITS)


ENCODED = "row long, doc_id long, key long, n long, print long, ids binary"


def _encoder(content, end_id: int, cache_words: int, batch_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = TextIds(content.value, cache_words)
        unit = np.uint16 if max(encoder.size, end_id + 1) <= 1 << 16 else np.uint32
        onto = directions()
        for batch in batches:
            texts = pc.fill_null(batch.column("text").cast(pa.string()), "")
            for group in shares(batch_bytes, pc.binary_length(texts).to_pylist()):
                some = slice(group[0], group[-1] + 1)
                ids, counts = encoder.of(texts[some])
                keys = curve_keys(ids, counts, onto)
                ends = np.cumsum(counts)
                blobs = [np.append(ids[b - c:b], end_id).astype(unit).tobytes() for b, c in zip(ends.tolist(), counts.tolist())]
                yield pa.record_batch(
                    [batch.column("row")[some], batch.column("doc_id")[some].cast(pa.int64()), pa.array(keys, pa.int64()),
                     pa.array(counts + 1, pa.int64()), pa.array(map(zlib.crc32, blobs), pa.int64()), pa.array(blobs, pa.binary())],
                    names=["row", "doc_id", "key", "n", "print", "ids"])

    return run


def encoded(docs: DataFrame, tokenizer: str, *, end_id: int = 2, cache_words: int = 400_000, batch_bytes: int = 8 << 20) -> DataFrame:
    """``row, doc_id, key, n, print, ids`` of every document: a number of the row, the curve's
    key, tokens with the end id, a check sum of the ids, and the ids as packed integers (two
    bytes where the vocabulary allows it, else four).  Stored, so that texts are encoded once."""
    with open(tokenizer, "rb") as f:
        content = docs.sparkSession.sparkContext.broadcast(f.read())
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    run = _encoder(content, end_id, cache_words, batch_bytes)
    return stored(map_arrow(rows, run, ENCODED), shared_folder(docs.sparkSession, "packing-ids"))


def _running(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Tokens before each document within its range."""
    part, before = TaskContext.get().partitionId(), 0
    for batch in batches:
        n = batch.column("n").to_numpy()
        ends = before + np.cumsum(n)
        yield pa.record_batch([pa.array(np.full(len(n), part), pa.int32()), batch.column("row"), pa.array(ends - n, pa.int64()),
                               batch.column("n")], names=["part", "row", "before", "n"])
        before = int(ends[-1]) if len(n) else before


def places(documents: DataFrame) -> tuple[DataFrame, int]:
    """(``row, place`` of every document's first token along the curve, number of tokens).

    The sums of the ranges, one number a task, pass through the driver."""
    spark = documents.sparkSession
    order = ["key", F.col("doc_id").asc_nulls_first(), "print", "row"]
    ranged = documents.select("key", "doc_id", "print", "row", "n").repartitionByRange(*order).sortWithinPartitions(*order)
    local = stored(map_arrow(ranged, _running, "part int, row long, before long, n long"), shared_folder(spark, "packing-places"))
    total, first = 0, []
    for part, tokens in sorted((r.part, r.tokens) for r in local.groupBy("part").agg(F.sum("n").alias("tokens")).collect()):
        first.append((part, total))
        total += tokens
    starts = spark.createDataFrame(first, "p int, first long")
    return local.join(F.broadcast(starts), F.col("part") == F.col("p")).select(
        F.col("row").alias("r"), (F.col("first") + F.col("before")).alias("place")), total


class Sequences:
    """Where sequences begin and end along the curve of ``total`` tokens."""

    def __init__(self, total: int, length: int):
        self.length, self.full = length, total // length
        rest, self.tail = total % length, [self.full * length]
        while rest:
            power = 1 << (rest.bit_length() - 1)
            self.tail.append(self.tail[-1] + power)
            rest -= power

    def at(self, place: int) -> tuple[int, int, int]:
        """(number, begin, end) of the sequence that holds the place."""
        if place < self.tail[0]:
            k = place // self.length
            return k, k * self.length, (k + 1) * self.length
        k = bisect_right(self.tail, place)
        return self.full + k - 1, self.tail[k - 1], self.tail[k]

    def pieces(self, place: int, n: int) -> Iterator[tuple[int, int, int, int]]:
        """(start in the document, length, sequence, offset there) of a document's pieces."""
        at = 0
        while at < n:
            k, begin, end = self.at(place + at)
            size = min(n - at, end - place - at)
            yield at, size, k, place + at - begin
            at += size


def _cutter(sequences: Sequences, digests: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[list] = [[] for _ in range(7)]
            for doc_id, n, place, blob in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "n", "place", "ids"))):
                wide = np.frombuffer(blob, np.uint16 if len(blob) == 2 * n else np.uint32).astype("<u4").tobytes()
                for start, size, k, offset in sequences.pieces(place, n):
                    own = wide[4 * start:4 * (start + size)]
                    for column, v in zip(rows, (doc_id, start, size, zlib.crc32(own) if digests else own, n, k, offset)):
                        column.append(v)
            kind = pa.int64() if digests else pa.binary()
            yield pa.record_batch([pa.array(c, kind if i == 3 else pa.int64()) for i, c in enumerate(rows)],
                                  names=["doc_id", "start", "length", "ids_crc32" if digests else "ids", "doc_tokens", "sequence_id",
                                         "offset"])

    return run


def pack(docs: DataFrame, tokenizer: str, *, length: int = 4096, end_id: int = 2, digests: bool = False) -> DataFrame:
    """The pieces of every document: ``doc_id, start, length, ids, doc_tokens, sequence_id,
    offset``; ids as little-endian unsigned 32-bit numbers, or their crc32 with ``digests``."""
    documents = encoded(docs, tokenizer, end_id=end_id)
    place, total = places(documents)
    rows = documents.select("row", "doc_id", "n", "ids").join(place, F.col("row") == F.col("r")).select("doc_id", "n", "place", "ids")
    schema = PIECES if digests else PIECES.replace("ids_crc32 long", "ids binary")
    return map_arrow(rows, _cutter(Sequences(total, length), digests), schema)


def sequences(pieces: DataFrame) -> DataFrame:
    """``sequence_id, ids`` (an array) of pieces with their ids: what a trainer reads."""
    whole = pieces.groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("offset", "ids"))).alias("p"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = [np.frombuffer(b"".join(x["ids"] for x in p), "<u4").astype(np.int32) for p in batch.column("p").to_pylist()]
            yield pa.record_batch([batch.column("sequence_id"), pa.array(ids, pa.list_(pa.int32()))], names=["sequence_id", "ids"])

    return map_arrow(whole, run, "sequence_id long, ids array<int>")
