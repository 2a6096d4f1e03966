"""Tokens: exact agreement with the library on whole texts, at every chunk size."""

import random

import public_tokenizers
import pytest

from wearline.llm import bpe, tokens
from wearline.llm.common import shares

PATH = public_tokenizers.path("word_bpe_49k.json")


def texts() -> list[str]:
    rng = random.Random(0)
    words = "that's it the naïve 12 o'clock, Σίσυφος <|endoftext|> x<|startoftext|>y 漢字 é ́a \x85 \xa0b".split(" ")
    out = ["", " ", "a", " \n\t ", "x" * 5000, "é" * 2000 + " b", "\n".join(["again and again"] * 400)]
    for _ in range(150):
        out.append("".join(rng.choice(words) + rng.choice([" ", "  ", "\n", "", "\r\n"]) for _ in range(rng.randint(1, 200))))
    return out + out[7:30]


@pytest.fixture(scope="module")
def library():
    with open(PATH, "rb") as f:
        return tokens.load_tokenizer("json", f.read())


@pytest.mark.parametrize("bits", [0, 2, 5, 8])
def test_chunks_agree_with_library(library, bits):
    with open(PATH, "rb") as f:
        encoder = bpe.ChunkEncoder(f.read(), (1 << bits) - 1, cache_chunks=50, cache_words=60)
    given = texts()
    raw = [t.encode() for t in given]
    found = [p for group in shares(4000, map(len, raw)) for p in encoder.batch([raw[i] for i in group])]
    for text, (n, ids, decoded) in zip(given, found, strict=True):
        expected = library.encode(text, add_special_tokens=False).ids
        assert (n, ids) == (len(expected), " ".join(map(str, expected)))
        assert decoded == library.decode(expected, skip_special_tokens=False)


def test_chunks_repeat_where_content_repeats():
    passage = b" ".join(b"word%d" % i for i in range(2000))
    def chunks(t):
        ends = bpe.cuts(t, 255)
        return [t[a:b] for a, b in zip([0, *ends], ends)]
    one, two = chunks(b"first text " + passage), chunks(b"quite another beginning, " + passage + b" end")
    assert b"".join(one) == b"first text " + passage
    assert len(set(one) & set(two)) >= len(one) - 3


def counted(encoder, calls):
    """The encoder with a tokenizer that notes how many bytes it is given."""
    class Counting:
        def __init__(self, tokenizer):
            self.tokenizer = tokenizer

        def encode_batch_fast(self, batch, **options):
            calls.append(sum(map(len, batch)))
            return self.tokenizer.encode_batch_fast(batch, **options)

        def encode(self, text, **options):
            calls.append(len(text))
            return self.tokenizer.encode(text, **options)

    encoder.tokenizer = Counting(encoder.tokenizer)
    return encoder


def test_shared_chunks_are_encoded_once(library):
    """A passage seen before is taken from its chunks: only the cut places around it are encoded."""
    passage = " ".join(f"word{i}ing, and {i * 7}" for i in range(1500))
    with open(PATH, "rb") as f:
        calls = []
        encoder = counted(bpe.ChunkEncoder(f.read(), 255, cache_chunks=10_000, cache_words=10), calls)
    first, second = f"Beginning {passage}", f"other words before {passage} and after"
    for t in (first, second):
        calls.append(0)
        (n, ids, _), = encoder.batch([t.encode()])
        assert ids == " ".join(map(str, library.encode(t, add_special_tokens=False).ids))
    at = calls.index(0, 1)
    assert sum(calls[:at]) > len(passage) / 2 and sum(calls[at:]) < len(passage) / 5


@pytest.mark.parametrize("bits", [3, 6])
def test_joins_that_do_not_agree_are_encoded_whole(library, bits):
    with open(PATH, "rb") as f:
        encoder = bpe.ChunkEncoder(f.read(), (1 << bits) - 1, cache_chunks=50, cache_words=60)
    encoder.repaired = lambda joins: dict.fromkeys(joins)  # none agrees
    raw = [t.encode() for t in texts()]
    for text, (_, ids, _) in zip(texts(), encoder.batch(raw), strict=True):
        assert ids == " ".join(map(str, library.encode(text, add_special_tokens=False).ids))


def test_encode_and_decode_round_trip(spark, library):
    rows = [(i, t) for i, t in enumerate(texts()[:40])] + [(None, None), (3, None), (3, None)]
    encoded = bpe.encode(spark.createDataFrame(rows, "doc_id long, text string"), PATH).cache()
    got = {(r.doc_id, r.n_tokens, tuple(r.ids), r.decoded) for r in encoded.collect()}
    for i, t in rows:
        ids = library.encode(t or "", add_special_tokens=False).ids
        assert (i, len(ids), tuple(ids), library.decode(ids, skip_special_tokens=False)) in got
    back = bpe.decode(encoded, PATH).collect()
    assert sorted(map(repr, back)) == sorted(map(repr, encoded.select("doc_id", "decoded").collect()))


def test_counts(spark, library):
    rows = [(i, t) for i, t in enumerate(texts())] + [(None, None), (0, "")]
    got = tokens.token_counts(spark.createDataFrame(rows, "doc_id long, text string"), PATH, limit=100,
                              cache_parts=40, batch_bytes=2000).collect()
    key = lambda r: (r[0] is None, r[0] or 0, *r[1:])
    expected = []
    for i, t in rows:
        n = len(library.encode(t or "", add_special_tokens=False).ids)
        expected.append((i, len((t or "").encode()), n, n > 100))
    assert sorted(map(tuple, got), key=key) == sorted(expected, key=key)


@pytest.mark.parametrize("name", ["piece_bpe_32k.model", "byte_bpe_50k.json"])
def test_counts_of_tokenizers_without_safe_boundaries(spark, name):
    path = public_tokenizers.path(name)
    with open(path, "rb") as f:
        t = tokens.load_tokenizer(name.rsplit(".", 1)[-1], f.read())
    rows = [(1, "Hello  world, it's 5"), (2, ""), (3, "a" * 300)]
    got = {r.doc_id: r.n_tokens for r in tokens.token_counts(
        spark.createDataFrame(rows, "doc_id long, text string"), path).collect()}
    for i, text in rows:
        ids = t.encode(text) if name.endswith("model") else t.encode(text, add_special_tokens=False).ids
        assert got[i] == len(ids)
