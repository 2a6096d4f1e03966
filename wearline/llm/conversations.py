"""Repair of conversation structure: the cheapest edits that make the roles alternate.

The roles of a repaired conversation read ``(s?(ua)+)?`` by their initials.  Rows may be kept,
given another role, deleted or joined by inserted turns; ``lattice`` finds the cheapest edits
by a bidirectional Dijkstra search.  On Spark:

1. Equal rows (conversation, turn, role, text) are counted first, and the first turn of every
   (role, text) comes from a partial aggregate, so neither a much repeated row nor a very long
   conversation meets in one task.
2. Rows are ranged by (conversation, turn, role, text) and read as a stream in that order.  A
   task cuts it into segments of at most ``segment_rows`` rows or ``segment_bytes`` bytes, the
   most it holds.  A conversation that lies in one segment, inside one range, is repaired there.
3. The others (two a range at most, besides those longer than a segment) give a table a
   segment: the cheapest edits for every pair of grammar states at its ends.  Tables of
   neighbours join by adding costs and audits; only they, no text, meet by conversation.
4. The audit's slices go back to the segments, which apply them to their rows.

* NULL role and NULL text stand for one space; NULL turns come first.  The NULL conversation is
  one like the others.  Rows of one turn follow by role and text (UTF-8 order); an empty role
  has no initial and can only be deleted or get another role.
* Equal rows are all there: each but the first is a duplicate.  Empty texts are blank rows.
* A very long text is a segment of its own.  A text's digest is one sequential hash by
  definition: it reads a conversation's segments as a stream, in one task each.
* An empty table gives no rows; further columns are not read.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from itertools import groupby

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wearline.llm import lattice
from wearline.llm.common import BLANK, map_arrow, shared_folder, stored

LEGAL = frozenset((b"su", b"ua", b"au"))
BROADCAST_REPEATS = 500_000
COUNTS = ("blank", "duplicate", "truncated", "illegal")
SEGMENT = ("conv_id long, part int, seg long, open boolean, n_rows long, blank long, duplicate long, truncated long, "
           "illegal long, first string, last string, min_turn long, max_turn long, turns long, cost long, audit string, "
           "edges string, repaired_sha256 string, rows array<struct<role: string, text: string>>")
RESULT = ("conv_id", "gaps", *COUNTS, "cost", "audit", "repaired_sha256")


def same(a: Column, b: Column) -> Column:
    return a.eqNullSafe(b)


def damage(turns: DataFrame) -> DataFrame:
    """Rows damaged by the crc32 of ``conv_id:turn`` modulo 20: 0 drops a row, 1 empties its
    text, 2 removes its sentence ends, 3 repeats it, 4 makes it a user's."""
    key = F.concat(F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")), F.lit(":"),
                   F.coalesce(F.col("turn").cast("string"), F.lit(" ")))
    fault = F.crc32(key.cast("binary")) % 20
    text = F.coalesce(F.col("text"), F.lit(" "))
    return (turns.select("conv_id", "turn", F.coalesce("role", F.lit(" ")).alias("role"), text.alias("text"), fault.alias("fault"))
            .where(F.col("fault") != 0)
            .select("conv_id", "turn",
                    F.when(F.col("fault") == 4, F.lit("user")).otherwise(F.col("role")).alias("role"),
                    F.when(F.col("fault") == 1, F.lit("")).when(F.col("fault") == 2, F.regexp_replace("text", "[.!?]", ""))
                    .otherwise(F.col("text")).alias("text"),
                    F.explode(F.when(F.col("fault") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))).alias("_copy"))
            .drop("_copy"))


def _ordered(turns: DataFrame) -> DataFrame:
    """Distinct rows with their ``copies`` and whether the same role and text stand in an
    earlier turn (``again``), ranged and sorted by conversation, turn, role and text.

    What stands in several turns is found by hashes, without the texts, and broadcast up to
    ``BROADCAST_REPEATS`` rows (some 60 bytes each), beyond that joined by shuffle."""
    spark = turns.sparkSession
    turns = turns.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.coalesce("role", F.lit(" ")).alias("role"),
                         F.coalesce("text", F.lit(" ")).alias("text"))
    text_hash = F.md5(F.col("text").cast("binary"))
    several = (turns.groupBy(F.col("conv_id").alias("c"), F.col("role").alias("r"), text_hash.alias("p"))
               .agg(F.min("turn").alias("first_turn"), F.max("turn").alias("last_turn"), F.count_if(F.col("turn").isNull()).alias("no_turn"))
               .where((F.col("first_turn") < F.col("last_turn")) | ((F.col("no_turn") > 0) & F.col("first_turn").isNotNull())))
    several = stored(several, shared_folder(spark, "conversations-repeats"))
    if several.count() <= BROADCAST_REPEATS:
        several = F.broadcast(several)
    rows = (turns.groupBy("conv_id", "turn", "role", "text").agg(F.count(F.lit(1)).alias("copies"))
            .withColumn("print", text_hash))
    again = (F.col("no_turn").isNotNull() & F.col("turn").isNotNull()
             & ((F.col("no_turn") > 0) | (F.col("turn") > F.col("first_turn"))))
    rows = rows.join(several, same(rows.conv_id, F.col("c")) & (rows.role == F.col("r")) & (rows["print"] == F.col("p")), "left")
    order = [F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), "role", "text"]
    return (rows.select("conv_id", "turn", "role", "text", "copies", again.alias("again"))
            .repartitionByRange(*order).sortWithinPartitions(*order))


class Segment:
    """Consecutive rows of one conversation, and what their repair needs."""

    def __init__(self, conv: int | None, seg: int):
        self.conv, self.seg, self.size = conv, seg, 0
        self.rows: list[tuple[bytes, bytes]] = []
        self.symbols: list[str] = []
        self.turns: list[int | None] = []
        self.counts = dict.fromkeys(COUNTS, 0)

    def add(self, turn: int | None, role: bytes, text: bytes, again: bool) -> None:
        if self.rows and role_initial(self.rows[-1][0]) + role_initial(role) not in LEGAL:
            self.counts["illegal"] += 1
        held = text.rstrip(BLANK)
        initial = role_initial(role).decode()
        symbol = initial if initial in ("s", "u", "a") else "x"
        if not held:
            self.counts["blank"] += 1
            symbol = lattice.MUST_GO
        elif again:
            self.counts["duplicate"] += 1
            symbol = lattice.MUST_GO
        elif held[-1] not in b".!?":
            self.counts["truncated"] += 1
            symbol = symbol.upper()
        self.rows.append((role, text))
        self.symbols.append(symbol)
        self.turns.append(turn)
        self.size += len(text) + len(role)

    def record(self, part: int, is_open: bool, keep_rows: bool) -> dict:
        """The segment as a row of ``SEGMENT``: repaired if the conversation is whole."""
        known = [t for t in self.turns if t is not None]
        symbols = "".join(self.symbols)
        out = {"conv_id": self.conv, "part": part, "seg": self.seg, "open": is_open, "n_rows": len(self.rows), **self.counts,
               "first": role_initial(self.rows[0][0]).decode(), "last": role_initial(self.rows[-1][0]).decode(),
               "min_turn": known[0] if known else None, "max_turn": known[-1] if known else None, "turns": len(set(known))}
        if is_open:
            out["edges"] = json.dumps([[*k, *v] for k, v in lattice.table_of(symbols).items()])
        else:
            out["cost"], out["audit"] = lattice.whole(symbols)
            out["repaired_sha256"] = hashlib.sha256("\n".join(
                f"{r}:{t}" for _, r, t in lattice.applied(out["audit"], self.texts())[0]).encode()).hexdigest()
        if is_open or keep_rows:
            out["rows"] = [{"role": r, "text": t} for r, t in self.texts()]
        return out

    def texts(self) -> list[tuple[str, str]]:
        return [(r.decode(), t.decode()) for r, t in self.rows]


def role_initial(role: bytes) -> bytes:
    """First code point of the role, as UTF-8."""
    return role.decode()[:1].encode()


def _segments(segment_rows: int, segment_bytes: int, keep_rows: bool, schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        ready: list[dict] = []

        def give(least: int) -> Iterator[pa.RecordBatch]:
            if len(ready) >= least:
                yield pa.RecordBatch.from_pylist(ready, schema=schema)
                ready.clear()

        now: Segment | None = None
        edge = True  # the conversation may have begun in the range before
        for batch in batches:
            columns = [batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).cast(pa.binary()).to_pylist(),
                       batch.column(3).cast(pa.binary()).to_pylist(), batch.column(4).to_pylist(), batch.column(5).to_pylist()]
            for conv, turn, role, text, copies, again in zip(*columns, strict=True):
                if now is not None and conv != now.conv:
                    ready.append(now.record(part, edge or now.seg > 0, keep_rows))
                    now, edge = None, False
                    yield from give(256)
                for copy in range(copies):
                    if now is None:
                        now = Segment(conv, 0)
                    elif len(now.rows) >= segment_rows or now.size + len(text) > segment_bytes:
                        ready.append(now.record(part, True, keep_rows))
                        now = Segment(conv, now.seg + 1)
                        yield from give(16)
                    now.add(turn, role, text, again or copy > 0)
        if now is not None:
            ready.append(now.record(part, True, keep_rows))
        yield from give(1)

    return run


ARROW = {"long": pa.int64(), "int": pa.int32(), "boolean": pa.bool_(), "string": pa.string()}


def _arrow_schema() -> pa.Schema:
    plain, _, _ = SEGMENT.partition(", rows ")
    row = pa.struct([("role", pa.string()), ("text", pa.string())])
    return pa.schema([(n, ARROW[t]) for n, t in (f.split() for f in plain.split(", "))] + [("rows", pa.list_(row))])


def segments(turns: DataFrame, *, segment_rows: int = 1024, segment_bytes: int = 8 << 20, keep_rows: bool = True) -> DataFrame:
    """The table of segments (``SEGMENT``), stored in the shared folder; ``keep_rows`` keeps
    the rows of conversations that are repaired already."""
    run = _segments(segment_rows, segment_bytes, keep_rows, _arrow_schema())
    spark = turns.sparkSession
    return stored(map_arrow(_ordered(turns), run, SEGMENT), shared_folder(spark, "conversations"))


SLICES = "conv_id long, part int, seg long, state int, slice string, cost long, audit string, extra_illegal long, shared_turns long"


def _compose(conv: int | None, found: list[dict]) -> list[dict]:
    """A conversation's audit from the tables of its segments, cut at the segments' rows."""
    found.sort(key=lambda s: (s["part"], s["seg"]))
    cost, audit = lattice.all_joined([{(q, p): (c, a) for q, p, c, a in json.loads(s["edges"])} for s in found])
    out, at = [], 0
    for i, s in enumerate(found):
        start, left = at, s["n_rows"]
        while left:
            left -= audit[at] != "I"
            at += 1
        if i == len(found) - 1:
            at = len(audit)
        out.append({"conv_id": conv, "part": s["part"], "seg": s["seg"], "slice": audit[start:at]})
    # In a repaired conversation the state follows from the number of turns before, and an odd
    # number in total means that the first is a system turn.
    system = (len(audit) - audit.count("D")) % 2
    before = 0
    for x in out:
        x["state"] = lattice.START if before == 0 else lattice.SYSTEM if before == system else (
            lattice.USER if (before - system) % 2 else lattice.ANSWER)
        before += len(x["slice"]) - x["slice"].count("D")
    edges = list(zip(found, found[1:]))
    out[0] |= {"cost": cost, "audit": audit,
               "extra_illegal": sum((a["last"] + b["first"]).encode() not in LEGAL for a, b in edges),
               "shared_turns": sum(a["max_turn"] is not None and a["max_turn"] == b["min_turn"] for a, b in edges)}
    return out


def _slices(segs: DataFrame) -> DataFrame:
    """Per open segment its slice of the audit; the first one of a conversation also has the
    whole audit and what counts between segments.  Texts stay where they are."""
    kinds = {"int": pa.int32(), "long": pa.int64(), "string": pa.string()}
    schema = pa.schema([(n, kinds[t]) for n, t in (f.split() for f in SLICES.split(", "))])

    def run(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        return pa.Table.from_pylist(_compose(rows[0]["conv_id"], rows), schema=schema)

    return (segs.where("open").select("conv_id", "part", "seg", "n_rows", "first", "last", "min_turn", "max_turn", "edges")
            .groupBy("conv_id").applyInArrow(run, SLICES))


def _with_slices(segs: DataFrame, slices: DataFrame) -> DataFrame:
    s = slices.select(F.col("conv_id").alias("c"), F.col("part").alias("p"), F.col("seg").alias("g"), "state", "slice")
    return segs.where("open").join(s, same(segs.conv_id, s.c) & (segs.part == s.p) & (segs.seg == s.g)).drop("c", "p", "g")


def _digests(segs: DataFrame, slices: DataFrame) -> DataFrame:
    """SHA-256 of the repaired text of every conversation of several segments, read as a
    stream of segments."""
    schema = pa.schema([("conv_id", pa.int64()), ("repaired_sha256", pa.string())])

    def turns(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int | None, str]]:
        for batch in batches:
            for s in batch.to_pylist():
                yield s["conv_id"], "\n".join(f"{r}:{t}" for _, r, t in lattice.applied(
                    s["slice"], [(x["role"], x["text"]) for x in s["rows"]], s["state"])[0])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for conv, pieces in groupby(turns(batches), key=lambda x: x[0]):
            digest, empty = hashlib.sha256(), True
            for _, text in pieces:
                if text:
                    digest.update(("" if empty else "\n").encode() + text.encode())
                    empty = False
            yield pa.record_batch([pa.array([conv], pa.int64()), pa.array([digest.hexdigest()])], schema=schema)

    rows = (_with_slices(segs, slices).select("conv_id", "part", "seg", "state", "slice", "rows")
            .repartition("conv_id").sortWithinPartitions(F.col("conv_id").asc_nulls_first(), "part", "seg"))
    return map_arrow(rows, run, "conv_id long, repaired_sha256 string")


def repair_reports(segs: DataFrame, ids: DataFrame) -> DataFrame:
    """One row per ``conv_id`` of ``ids``: gaps in its turns, faulty rows by kind, cost and
    audit of the repair, SHA-256 of the repaired ``role:text`` lines.  Conversations without
    rows have zeros, an empty audit and the hash of nothing."""
    spark = segs.sparkSession
    slices = stored(_slices(segs), shared_folder(spark, "conversations-slices"))
    gaps = F.coalesce(F.col("max_turn") - F.col("min_turn") + 1 - F.col("turns"), F.lit(0))
    closed = segs.where(~F.col("open")).select("conv_id", gaps.alias("gaps"), *COUNTS, "cost", "audit", "repaired_sha256")
    parts = segs.where("open").groupBy("conv_id").agg(
        F.min("min_turn").alias("min_turn"), F.max("max_turn").alias("max_turn"), F.sum("turns").alias("turns"),
        *[F.sum(c).alias(c) for c in COUNTS])
    first = slices.where(F.col("audit").isNotNull()).select(F.col("conv_id").alias("c"), "cost", "audit", "extra_illegal", "shared_turns")
    digests = _digests(segs, slices).withColumnRenamed("conv_id", "d")
    several = parts.join(first, same(parts.conv_id, first.c)).join(digests, same(F.col("conv_id"), F.col("d")))
    several = several.select("conv_id", (gaps + F.coalesce("shared_turns", F.lit(0))).alias("gaps"), "blank", "duplicate", "truncated",
                             (F.col("illegal") + F.col("extra_illegal")).alias("illegal"), "cost", "audit", "repaired_sha256")
    found = closed.unionByName(several).withColumnRenamed("conv_id", "found_id")
    ids = ids.select(F.col("conv_id").cast("long")).distinct()
    empty = {"audit": "", "repaired_sha256": hashlib.sha256(b"").hexdigest()}
    return ids.join(found, same(ids.conv_id, found.found_id), "left").select(
        "conv_id", *[F.coalesce(F.col(c), F.lit(empty.get(c, 0))).alias(c) for c in RESULT[1:]])


def repaired_turns(segs: DataFrame) -> DataFrame:
    """The repaired conversations as rows: ``conv_id, part, seg, pos`` (their order), ``edit``
    (``K``, ``R`` or ``I``), ``role``, ``text``.  ``segs`` must have its rows kept."""
    schema = "conv_id long, part int, seg long, pos long, edit string, role string, text string"
    kinds = pa.schema([("conv_id", pa.int64()), ("part", pa.int32()), ("seg", pa.int64()), ("pos", pa.int64()), ("edit", pa.string()),
                       ("role", pa.string()), ("text", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for s in batch.to_pylist():
                rows = [(x["role"], x["text"]) for x in s["rows"]]
                for pos, (e, r, t) in enumerate(lattice.applied(s["slice"], rows, s["state"])[0]):
                    out.append({"conv_id": s["conv_id"], "part": s["part"], "seg": s["seg"], "pos": pos, "edit": e, "role": r, "text": t})
            yield pa.RecordBatch.from_pylist(out, schema=kinds)

    names = ["conv_id", "part", "seg", "state", "slice", "rows"]
    slices = stored(_slices(segs), shared_folder(segs.sparkSession, "conversations-slices"))
    closed = segs.where(~F.col("open")).withColumn("state", F.lit(lattice.START)).withColumn("slice", F.col("audit")).select(*names)
    return map_arrow(closed.unionByName(_with_slices(segs, slices).select(*names)), run, schema)


def repair(turns: DataFrame, *, of: DataFrame | None = None, segment_rows: int = 1024, segment_bytes: int = 8 << 20) -> DataFrame:
    """Reports of the repair of every conversation of ``turns`` (or of those ``of`` names)."""
    segs = segments(turns, segment_rows=segment_rows, segment_bytes=segment_bytes, keep_rows=False)
    return repair_reports(segs, turns if of is None else of)
