"""Packing against the library on whole texts, the curve against its definition."""

import itertools
import zlib

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from wearline.llm import packing
from wearline.llm.common import table
from wearline.llm.queries import tokenizer_path


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(tokenizer_path())


ODD = ["", " ", "Hello, WORLD!\n\tit's 12 o'clock ^ and ^^ again^", "<|endoftext|> <|ENDOFTEXT|> a<|startoftext|>b", "é é 漢字  x y",
       "a\x0bb\x0cc\rd\x1ce", "word " * 3000, "x" * 5000, "İstanbul ﬁne K K ; ^", "\x85next​zero", "Don't 'Twas 'S", "no mark",
       "ÀÉ ß&& Straße!! e\u0301!! e\u0301. x'. it's. a.b, c&&d && 'tis' ñ' Ñ÷ µ. end.", "Σίσυφος ΣΑΣ. ǅ İ! ª º ×÷"]


def test_ids_equal_the_library(library):
    with open(tokenizer_path(), "rb") as f:
        content = f.read()
    for cache in (3, 1000):
        encoder = packing.TextIds(content, cache, together=7)
        for texts in (ODD, ODD[::-1], ODD[2:5], [""], []):
            ids, counts = encoder.of(pa.array(texts, pa.string()))
            assert [x.tolist() for x in np.split(ids, np.cumsum(counts))[:-1]] == [
                library.encode(t, add_special_tokens=False).ids for t in texts]


@pytest.mark.parametrize("dimensions,bits", [(2, 1), (2, 4), (3, 3), (4, 2)])
def test_hilbert_curve_visits_neighbours(dimensions, bits):
    cells = np.array(list(itertools.product(range(1 << bits), repeat=dimensions)))
    keys = packing.hilbert(cells, bits)
    assert sorted(keys.tolist()) == list(range(len(cells)))
    walk = cells[np.argsort(keys)]
    assert (np.abs(np.diff(walk, axis=0)).sum(axis=1) == 1).all()


@pytest.mark.parametrize("total,length", [(0, 8), (5, 8), (8, 8), (8 * 5 + 7, 8), (4096 * 2 + 2500, 4096), (100, 10)])
def test_sequences_are_full_or_powers_of_two(total, length):
    s = packing.Sequences(total, length)
    found = list(s.pieces(0, total))
    assert sum(size for _, size, _, _ in found) == total
    assert [k for _, _, k, _ in found] == list(range(len(found)))
    for _, size, _, offset in found:
        assert offset == 0 and (size == length or size & (size - 1) == 0)


def check(pieces, docs, library, length):
    """Every id in exactly one piece, offsets gapless, sequences full or powers of two."""
    expected = sorted((d is not None, d or 0, [*library.encode(t or "", add_special_tokens=False).ids, 2]) for d, t in docs)
    by_doc, by_sequence = {}, {}
    for p in pieces:
        by_sequence.setdefault(p.sequence_id, []).append((p.offset, p.length))
        by_doc.setdefault(p.doc_id, []).append(p)
    for parts in by_sequence.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at == length or at & (at - 1) == 0
    assert sorted(by_sequence) == list(range(len(by_sequence)))
    whole = []
    for d, parts in by_doc.items():
        if len({p.doc_tokens for p in parts}) == 1 and sum(p.length for p in parts) == parts[0].doc_tokens:
            whole.append((d is not None, d or 0, np.frombuffer(b"".join(p.ids for p in sorted(parts, key=lambda p: p.start)), "<u4").tolist()))
    single = [e for e in expected if sum(e[:2] == x[:2] for x in expected) == 1]
    assert [e for e in single if e not in whole] == []
    assert sum(p.length for p in pieces) == sum(len(e[2]) for e in expected)


@pytest.mark.parametrize("length", [16, 4096])
def test_pieces_hold_every_id_once(spark, library, length):
    docs = [(i, t) for i, t in enumerate(ODD)] + [(None, None), (50, None), (50, "again"), (50, "again")] + [(100 + i, "copy of a text") for i in range(80)]
    df = spark.createDataFrame([(*d, 1, 2, "x") for d in docs], "doc_id long, text string, row int, n int, key string").repartition(6)
    pieces = packing.pack(df, tokenizer_path(), length=length).collect()
    check(pieces, docs, library, length)


def test_digests_and_sequences(spark, sf, library):
    docs = table(spark, sf, "documents")
    pieces = packing.pack(docs, tokenizer_path(), length=512).cache()
    got = pieces.collect()
    check(got, [(r.doc_id, r.text) for r in docs.collect()], library, 512)
    digests = packing.pack(docs, tokenizer_path(), length=512, digests=True).collect()
    assert sorted((p.doc_id, p.start, zlib.crc32(p.ids)) for p in got) == sorted((p.doc_id, p.start, p.ids_crc32) for p in digests)
    rows = {r.sequence_id: r.ids for r in packing.sequences(pieces).collect()}
    assert sum(map(len, rows.values())) == sum(p.length for p in got)
    for p in got:
        assert rows[p.sequence_id][p.offset:p.offset + p.length] == np.frombuffer(p.ids, "<u4").tolist()


def test_neighbours_on_the_curve_are_alike(spark):
    """Two vocabularies: documents of one kind mostly stand next to each other."""
    rng = np.random.default_rng(3)
    kinds = [[f"alpha{i}" for i in range(40)], [f"omega{i}" for i in range(40)]]
    docs = [(i, " ".join(rng.choice(kinds[i % 2], 60))) for i in range(300)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    order = [r.doc_id % 2 for r in sorted(packing.pack(df, tokenizer_path()).where("start = 0").collect(), key=lambda p: (p.sequence_id, p.offset))]
    changes = sum(a != b for a, b in zip(order, order[1:]))
    assert changes < 60  # 150 by chance


def test_no_documents(spark):
    assert packing.pack(spark.createDataFrame([], "doc_id long, text string"), tokenizer_path()).collect() == []
