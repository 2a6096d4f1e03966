"""Token counts: batch encoding in Arrow functions that return lengths only.

A text is split at safe boundaries: places where no token of the tokenizer can span and
where its normaliser treats both sides independently, so the lengths of the parts add up to
the length of the whole.  For a vocabulary that drops white space the ASCII blanks are such
places.  The parts of an Arrow batch that were not seen before go to the library in batches
of about ``batch_bytes`` bytes; a part that occurs again costs a dictionary look-up.  The
look-up table holds at most ``cache_parts`` parts per worker.

* NULL text counts as empty: 0 bytes, 0 tokens.
* Repeated rows are counted each; ids may be NULL.
* A text without a boundary is one part, however long.
* An empty table gives no rows; only ``doc_id`` and ``text`` are read, so further columns may have
  any name.
"""

from __future__ import annotations

import os
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from wearline.llm.common import batch_bytes_of, map_arrow, shares

SCHEMA = "doc_id long, n_bytes long, n_tokens long, over_limit boolean"


def load_tokenizer(kind: str, content: bytes):
    """A library tokenizer from the content of its file (``json`` or ``model``)."""
    # Spark already runs one task per core: the libraries' own threads would only compete.
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    if kind == "json":
        from tokenizers import Tokenizer

        t = Tokenizer.from_str(content.decode())
        t.no_truncation()
        t.no_padding()
        return t
    if kind == "model":
        import sentencepiece

        return sentencepiece.SentencePieceProcessor(model_proto=content)
    raise ValueError(f"unknown tokenizer kind {kind!r}; json or model expected")


def drops_blanks(kind: str, content: bytes) -> bool:
    """True if the tokenizer's own rules remove white space between pre-tokens, which makes
    every ASCII blank a safe boundary."""
    if kind != "json":
        return False
    import json

    rules = json.loads(content).get("pre_tokenizer") or {}
    first = (rules.get("pretokenizers") or [rules])[0]
    return (first.get("type") == "Split" and first.get("behavior") == "Removed"
            and first.get("invert") is True and "\\s" in str(first.get("pattern")))


def whole(text: bytes) -> list[bytes]:
    """No safe boundary is known: the text stays in one part."""
    return [text]


class PartLengths:
    """Token counts of parts, each encoded once per worker while the table has room."""

    def __init__(self, tokenizer, kind: str, batch_bytes: int, cache_parts: int):
        self.tokenizer, self.kind = tokenizer, kind
        self.batch_bytes, self.cache_parts = batch_bytes, cache_parts
        self.known: dict[bytes, int] = {}
        self.passing: list[bytes] = []

    def lengths(self, parts: list[bytes]) -> list[int]:
        texts = [p.decode() for p in parts]
        if self.kind == "model":
            return [len(x) for x in self.tokenizer.encode(texts, num_threads=1)]
        return [len(e) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def learn(self, parts: Iterable[bytes]) -> dict[bytes, int]:
        """The table with all of ``parts``, the new ones encoded in batches balanced by
        bytes.  Once the table is full, new parts stay only until the next call."""
        for p in self.passing:
            del self.known[p]
        new = list(set(parts).difference(self.known))
        for group in shares(self.batch_bytes, map(len, new)):
            batch = [new[i] for i in group]
            self.known.update(zip(batch, self.lengths(batch), strict=True))
        self.passing = new if len(self.known) > self.cache_parts else []
        return self.known


def counter(content, kind: str, batch_bytes: int, cache_parts: int, limit: int):
    """The Arrow function: (doc_id, text) batches to ``SCHEMA`` batches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw = content.value
        split = bytes.split if drops_blanks(kind, raw) else whole
        table = PartLengths(load_tokenizer(kind, raw), kind, batch_bytes, cache_parts)
        for batch in batches:
            texts = [t or b"" for t in batch_bytes_of(batch, "text")]
            tokens: list[int] = []
            for group in shares(batch_bytes, map(len, texts)):
                parts = [split(texts[i]) for i in group]
                known = table.learn(w for p in parts for w in p)
                tokens.extend(sum(map(known.__getitem__, p)) for p in parts)
            yield pa.record_batch(
                [batch.column("doc_id").cast(pa.int64()), pa.array(map(len, texts), pa.int64()),
                 pa.array(tokens, pa.int64()), pa.array([n > limit for n in tokens], pa.bool_())],
                names=["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return run


def token_counts(docs: DataFrame, tokenizer: str, *, limit: int = 2048,
                 batch_bytes: int = 1 << 20, cache_parts: int = 400_000) -> DataFrame:
    """Bytes and tokens of every text; ``over_limit`` marks more than ``limit`` tokens.

    ``tokenizer`` is the path of a ``.json`` or ``.model`` file on the driver; its content
    (a few MB, fixed) is broadcast.  No shuffle; memory per worker is one Arrow batch plus
    the bounded look-up table."""
    kind = tokenizer.rsplit(".", 1)[-1]
    with open(tokenizer, "rb") as f:
        content = docs.sparkSession.sparkContext.broadcast(f.read())
    run = counter(content, kind, batch_bytes, cache_parts, limit)
    return docs.select("doc_id", "text").transform(map_arrow, run, SCHEMA)
