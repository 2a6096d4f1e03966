"""BPE encoding and decoding by reuse of content-defined chunks.

A rolling hash over the bytes of a text cuts it wherever the hash of the last sixteen bytes
falls on a mask.  The cut places depend on the content alone, so a passage that many
documents share is cut alike in all of them, and each of its chunks is encoded once per
worker (its closed words through a table of words).  Cuts may fall inside a word, so a chunk
keeps its first and last word open wherever no blank ends them.

Where chunks are joined, the open end and the open start that follows (over as many chunks as
it takes until blanks close the span) are encoded anew together with the closed words on either
side.  The new tokens must begin with the tokens that the chunk before has for its word and end
with those that the chunk after has for its own; then both encodings agree outside the span, and
what lies between them repairs the join.  A text with a join that does not agree is encoded whole.

* NULL text counts as empty: no tokens, the hashes of empty strings.
* Repeated rows are encoded each (from the cache); ids may be NULL.
* A very long text without a cut is one chunk; nothing is cut off.
* An empty table gives no rows; only ``doc_id`` and ``text`` are read, so further columns may have
  any name.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wearline.llm.common import BLANK, batch_bytes_of, map_arrow, shares
from wearline.llm.tokens import drops_blanks, load_tokenizer

ENCODED = "doc_id long, n_tokens long, ids string, decoded string"
DIGESTS = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
# Multiplier table of the rolling hash, one value per byte.
GEAR = (np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(32)).astype(np.uint32)
BLANKS = frozenset(BLANK)


def cuts(text: bytes, mask: int) -> list[int]:
    """Ends of the chunks of ``text``, the last one included (none for an empty text).

    A cut follows every byte at which the hash of the last 16 bytes is 0 under ``mask``,
    unless the next byte continues a character."""
    n = len(text)
    if n == 0:
        return []
    x = np.frombuffer(text, np.uint8)
    h = GEAR[x]
    for step in (1, 2, 4, 8):
        g = h.copy()
        g[step:] += h[:-step] << np.uint32(step) if n > step else 0
        h = g
    at = np.flatnonzero((h & np.uint32(mask)) == 0) + 1
    at = at[at < n]
    at = at[(x[at] & 0xC0) != 0x80]
    return [*at.tolist(), n]


# What one run of words encodes to: token count, ids and tokens as spaced text.
Part = tuple[int, str, str]


def together(parts: list[Part]) -> Part:
    """Parts in a row; empty ones leave no extra space."""
    if len(parts) == 1:
        return parts[0]
    if not all(p[0] for p in parts):
        parts = [p for p in parts if p[0]]
    if not parts:
        return 0, "", ""
    counts, ids, tokens = zip(*parts)
    return sum(counts), " ".join(ids), " ".join(tokens)


# A chunk's closed middle, its words that a neighbour may continue, and its first and last closed
# word: (starts with a blank, open first word, middle, open last word, ends with a blank, first, last).
Chunk = tuple[bool, bytes | None, Part, bytes | None, bool, bytes, bytes]
# A join: the closed word before (or empty), the span, the closed word after (or empty).
Join = tuple[bytes, bytes, bytes]


class ChunkEncoder:
    """Encodes texts chunk by chunk; both look-up tables are bounded and start anew when full."""

    def __init__(self, content: bytes, mask: int, cache_chunks: int, cache_words: int):
        if not drops_blanks("json", content):
            raise ValueError("chunk reuse needs a tokenizer that drops white space")
        if json.loads(content).get("decoder"):
            raise ValueError("chunk reuse needs a tokenizer without a decoder step")
        if '"Lowercase"' not in content.decode():
            raise ValueError("chunk reuse needs a tokenizer that lowers case")
        self.tokenizer = load_tokenizer("json", content)
        # This kind of tokenizer has no decoder step: decoding joins its tokens by a space.
        size = self.tokenizer.get_vocab_size(with_added_tokens=True)
        self.names = [self.tokenizer.id_to_token(i) for i in range(size)]
        self.digits = [str(i) for i in range(size)]
        self.mask, self.cache_chunks, self.cache_words = mask, cache_chunks, cache_words
        self.chunks: dict[bytes, Chunk] = {}
        self.words: dict[bytes, Part] = {}
        self.passing: list[bytes] = []

    def learn(self, words: set[bytes]) -> None:
        """Encode the words not known yet.  Once the table is full, new words stay only
        until the next call."""
        for w in self.passing:
            del self.words[w]
        new = list(words.difference(self.words))
        digits, names = self.digits, self.names
        for w, e in zip(new, self.tokenizer.encode_batch_fast([w.decode() for w in new], add_special_tokens=False),
                        strict=True):
            ids = e.ids
            self.words[w] = (len(ids), " ".join([digits[i] for i in ids]),
                             " ".join([names[i] for i in ids]))
        self.passing = new if len(self.words) > self.cache_words else []

    def split(self, chunk: bytes) -> tuple[bool, bytes | None, list[bytes], bytes | None, bool]:
        """(starts with a blank, open first word, closed words, open last word, ends with one).

        A chunk that is one word without a blank has it as head, and no tail."""
        lead, trail = chunk[0] in BLANKS, chunk[-1] in BLANKS
        words = chunk.split()
        head = tail = None
        if not lead and words:
            head = words.pop(0)
        if not trail and words:
            tail = words.pop()
        return lead, head, words, tail, trail

    def part_of(self, ids: list[int]) -> Part:
        return len(ids), " ".join([self.digits[i] for i in ids]), " ".join([self.names[i] for i in ids])

    def repaired(self, joins: list[Join]) -> dict[Join, Part | None]:
        """The tokens of each join's span from an encoding together with its neighbours; None
        where that encoding and those of the neighbours do not agree."""
        out: dict[Join, Part | None] = {}
        found = self.tokenizer.encode_batch_fast([b" ".join(filter(None, j)).decode() for j in joins], add_special_tokens=False)
        nothing: Part = (0, "", "")
        for join, e in zip(joins, found, strict=True):
            before, after = (self.words[w] if w else nothing for w in (join[0], join[2]))
            ids = e.ids
            start, stop = before[0], len(ids) - after[0]
            agree = start <= stop and all(
                " ".join([self.digits[i] for i in side]) == part[1] for side, part in ((ids[:start], before), (ids[stop:], after)))
            out[join] = self.part_of(ids[start:stop]) if agree else None
        return out

    def batch(self, texts: list[bytes]) -> Iterator[Part]:
        """The encoding of each text, in order."""
        chunks, plans, fresh, ready = self.chunks, [], {}, []
        for t in texts:
            if b"<|" not in t:  # no special token: the tokenizer lowers case, so fewer words differ
                t = t.lower()
            ready.append(t)
            start, plan = 0, []
            for end in cuts(t, self.mask):
                chunk = t[start:end]
                start = end
                plan.append(chunk)
                if chunk not in chunks and chunk not in fresh:
                    fresh[chunk] = self.split(chunk)
            plans.append(plan)
        if len(chunks) + len(fresh) > self.cache_chunks:
            chunks = self.chunks = {}
            fresh = {c: self.split(c) for plan in plans for c in plan}
        needed = {w for _, _, words, _, _ in fresh.values() for w in words}
        joined = [self.joins(plan, fresh) for plan in plans]
        needed.update(w for js in joined for j in js if j for w in (j[0], j[2]) if w)
        self.learn(needed)
        part = self.words.__getitem__
        for chunk, (lead, head, words, tail, trail) in fresh.items():
            chunks[chunk] = (lead, head, together(list(map(part, words))), tail, trail, words[0] if words else b"", words[-1] if words else b"")
        spans = self.repaired(list({j for js in joined for j in js if j}))
        for t, plan, js in zip(ready, plans, joined, strict=True):
            if any(j and spans[j] is None for j in js):
                yield self.part_of(self.tokenizer.encode(t.decode(), add_special_tokens=False).ids)
                continue
            parts = [spans[js[0]]] if js[0] else []
            for chunk, j in zip(plan, js[1:], strict=True):
                parts.append(chunks[chunk][2])
                if j:
                    parts.append(spans[j])
            yield together(parts)

    def joins(self, plan: list[bytes], fresh: dict) -> list[Join | None]:
        """Per chunk boundary (text start and end included) the word that spans it, with the
        closed words of the chunks beside it.

        An open word is carried on until a blank closes it: a chunk that is one unbroken
        word only widens the span.  Two words meet at a boundary with a blank on one side;
        then the closed one is given to the boundary before or after its chunk."""
        out: list[Join | None] = [None]
        carry = b""
        before = b""  # closed word before the span that is open
        for chunk in plan:
            made = fresh.get(chunk)
            if made is not None:
                lead, head, words, tail, trail = made
                first, final = (words[0], words[-1]) if words else (b"", b"")
            else:
                lead, head, _, tail, trail, first, final = self.chunks[chunk]
            if lead:
                out[-1] = (before, carry, first) if carry else None
                carry = b""
            if head is not None:
                carry += head
                if tail is None and not trail:  # one unbroken word: widen
                    out.append(None)
                    continue
                out[-1] = (before, carry, first) if carry else None
                carry = b""
            before = final
            if tail is not None:
                carry = tail
            out.append(None)
        if carry:
            out[-1] = (before, carry, b"")
        return out


def _encoder(content, mask: int, cache_chunks: int, cache_words: int, digests: bool, batch_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = ChunkEncoder(content.value, mask, cache_chunks, cache_words)
        for batch in batches:
            texts = [t or b"" for t in batch_bytes_of(batch, "text")]
            ids = batch.column("doc_id").cast(pa.int64())
            for group in shares(batch_bytes, map(len, texts)):
                found = enc.batch([texts[i] for i in group])
                n, a, b = [], [], []
                for count, id_text, token_text in found:
                    n.append(count)
                    a.append(hashlib.sha256(id_text.encode()).hexdigest() if digests else id_text)
                    b.append(hashlib.sha256(token_text.encode()).hexdigest() if digests else token_text)
                yield pa.record_batch(
                    [ids.slice(group[0], len(group)), pa.array(n, pa.int64()), pa.array(a, pa.string()),
                     pa.array(b, pa.string())],
                    names=["doc_id", "n_tokens", *(("ids_sha256", "decoded_sha256") if digests
                                                   else ("ids", "decoded"))])

    return run


def encode(docs: DataFrame, tokenizer: str, *, digests: bool = False, mask_bits: int = 11,
           cache_chunks: int = 10_000, cache_words: int = 250_000,
           batch_bytes: int = 1 << 20) -> DataFrame:
    """Token ids and decoded text of every document.

    Returns ``doc_id, n_tokens, ids array<int>, decoded``; with ``digests`` the SHA-256 of
    the spaced ids and of the decoded text instead (made where the ids are, so that they
    need not leave the worker).  Chunks have about ``2 ** mask_bits`` bytes.  No shuffle;
    memory per worker is one Arrow batch plus two bounded tables."""
    with open(tokenizer, "rb") as f:
        content = docs.sparkSession.sparkContext.broadcast(f.read())
    run = _encoder(content, (1 << mask_bits) - 1, cache_chunks, cache_words, digests, batch_bytes)
    out = docs.select("doc_id", "text").transform(map_arrow, run, DIGESTS if digests else ENCODED)
    if digests:
        return out
    ids = F.when(F.col("ids") == "", F.array().cast("array<int>")).otherwise(
        F.split("ids", " ").cast("array<int>"))
    return out.withColumn("ids", ids)


def decode(encoded: DataFrame, tokenizer: str) -> DataFrame:
    """The library's decoding of ``ids`` (special tokens kept): ``doc_id, decoded``.

    NULL or empty ids decode to the empty string."""
    with open(tokenizer, "rb") as f:
        content = encoded.sparkSession.sparkContext.broadcast(f.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = load_tokenizer("json", content.value)
        for batch in batches:
            ids = [x or [] for x in batch.column("ids").to_pylist()]
            yield pa.record_batch([batch.column("doc_id").cast(pa.int64()),
                                   pa.array(t.decode_batch(ids, skip_special_tokens=False), pa.string())],
                                  names=["doc_id", "decoded"])

    return encoded.select("doc_id", "ids").transform(map_arrow, run, "doc_id long, decoded string")
