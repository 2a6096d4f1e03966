"""Conversation repair against exhaustive search, and its pieces against whole conversations."""

import hashlib
import itertools
import random
import re
import zlib

import pytest

from wearline.llm import conversations, lattice


def exhaustive(symbols):
    """Every sequence of edits with at most three inserts in a row."""
    best = None

    def go(i, cost, audit, roles, inserts):
        nonlocal best
        if cost > 3 * len(symbols):
            return
        if i == len(symbols) and re.fullmatch("(s?(ua)+)?", roles) and (best is None or (cost, audit) < best):
            best = (cost, audit)
        if inserts < 3:
            for r in "ua":
                go(i, cost + 2, audit + "I", roles + r, inserts + 1)
        if i < len(symbols):
            c = symbols[i]
            go(i + 1, cost + 3, audit + "D", roles, 0)
            if c != "-":
                go(i + 1, cost + c.isupper(), audit + "K", roles + c.lower(), 0)
                for r in "ua":
                    go(i + 1, cost + 2 + c.isupper(), audit + "R", roles + r, 0)

    go(0, 0, "", "", 0)
    return best


def test_lattice_against_exhaustive_search():
    for n in range(4):
        for t in itertools.product("suxUA-", repeat=n):
            assert lattice.cheapest("".join(t)) == exhaustive("".join(t)), t


def test_joined_pieces_equal_the_whole():
    rng = random.Random(5)
    for _ in range(150):
        s = "".join(rng.choice("suaxSUAX-uaua") for _ in range(rng.randint(0, 25)))
        a, b = sorted(rng.randint(0, len(s)) for _ in range(2))
        assert lattice.all_joined([lattice.table_of(x) for x in (s[:a], s[a:b], s[b:])]) == lattice.cheapest(s)


BLANKS = " \t\n\x0b\x0c\r"


def expected(rows):
    """The report of one conversation in plain Python; rows are (turn, role, text)."""
    rows = sorted(((t, r if r is not None else " ", x if x is not None else " ") for t, r, x in rows),
                  key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
    seen, symbols = set(), ""
    count = dict.fromkeys(("blank", "duplicate", "truncated"), 0)
    for _, role, text in rows:
        initial, held = role[:1], text.rstrip(BLANKS)
        symbol = initial if initial and initial in "sua" else "x"
        if not held:
            count["blank"] += 1
            symbol = "-"
        elif (role, text) in seen:
            count["duplicate"] += 1
            symbol = "-"
        elif held[-1] not in ".!?":
            count["truncated"] += 1
            symbol = symbol.upper()
        seen.add((role, text))
        symbols += symbol
    turns = [t for t, _, _ in rows if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
    cost, audit = lattice.cheapest(symbols)
    lines = [f"{r}:{t}" for _, r, t in lattice.applied(audit, [(r, t) for _, r, t in rows])[0]]
    assert re.fullmatch("(s?(ua)+)?", "".join(x[:1] for x in lines))
    return (gaps, count["blank"], count["duplicate"], count["truncated"], illegal, cost, audit,
            hashlib.sha256("\n".join(lines).encode()).hexdigest())


def turns_of(seed, n, conv):
    rng = random.Random(seed)
    texts = ["Yes.", "No!", "why", "", " \n", None, "Long one?  ", "é漢.", "cut, "]
    return [(conv, rng.choice([None, i // 2, i, i + rng.randint(0, 2)]), rng.choice(["system", "user", "assistant", "tool", "", None]),
             rng.choice(texts) if rng.random() < 0.5 else f"Text {i}.") for i in range(n)]


SCHEMA = "conv_id long, turn long, role string, text string, part int, seg string, state int, c long, n string"


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, "x", 2, 3, "y") for r in rows], SCHEMA)


@pytest.mark.parametrize("segment_rows", [1, 3, 1024])
def test_reports_against_plain_python(spark, segment_rows):
    """Null, empty and repeated rows, ties of turns, a conversation of two thirds of all rows."""
    rows = turns_of(1, 200, 7) + [r for c in range(20) for r in turns_of(c, c % 9, c + 10)] + turns_of(3, 6, None)
    rows += [(99, 1, "user", "Copy.")] * 70
    df = frame(spark, rows).repartition(5)
    ids = spark.createDataFrame([(c,) for c in {r[0] for r in rows} | {-1}], "conv_id long")
    got = {r[0]: tuple(r)[1:] for r in conversations.repair(df, of=ids, segment_rows=segment_rows).collect()}
    assert set(got) == {r[0] for r in ids.collect()}
    for c in got:
        assert got[c] == expected([r[1:] for r in rows if r[0] == c]), c


def test_repaired_rows_alternate(spark):
    rows = turns_of(1, 90, 7) + turns_of(2, 9, 8)
    segs = conversations.segments(frame(spark, rows), segment_rows=7)
    out = sorted((r.conv_id, r.part, r.seg, r.pos, r.role, r.text) for r in conversations.repaired_turns(segs).collect())
    reports = {r.conv_id: r for r in conversations.repair_reports(segs, frame(spark, rows)).collect()}
    for c in (7, 8):
        mine = [x for x in out if x[0] == c]
        assert re.fullmatch("(s?(ua)+)?", "".join(x[4][:1] for x in mine))
        lines = "\n".join(f"{x[4]}:{x[5]}" for x in mine)
        assert hashlib.sha256(lines.encode()).hexdigest() == reports[c].repaired_sha256


def test_damage_rules(spark):
    rows = [(c, t, "assistant", "One. Two! Three? ") for c in (1, 2, None) for t in [*range(60), None]]
    got = {}
    for r in conversations.damage(frame(spark, rows)).collect():
        got.setdefault((r.conv_id, r.turn), []).append((r.role, r.text))
    for c, t, role, text in rows:
        f = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        want = {0: None, 1: [(role, "")], 2: [(role, "One Two Three ")], 3: [(role, text)] * 2, 4: [("user", text)]}.get(f, [(role, text)])
        assert got.get((c, t)) == want


def test_no_conversations(spark):
    assert conversations.repair(frame(spark, [])).collect() == []
