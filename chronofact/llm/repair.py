"""Repair of the structure of conversations at the least cost.

A repair is a row of macro edits: for each turn a run of inserts and then Keep, Rerole or Delete, and a last run of inserts. Written as their
initials, macro edits are codes of which none begins another, so two different repairs of the same turns first differ in a code, and
comparing repairs as strings is comparing their codes one by one. A dynamic program over the turns therefore needs no strings: for each state
of the grammar `(s?(ua)+)?` it keeps the cost, and the rank that the least audit among the cheapest has among those of the other states. The
rank of a longer audit follows from the rank of what it extends and the order of the codes. Parent pointers give the audit back.

A long conversation is cut into segments of bounded size. A segment's costs and ranks from each state to each state are a small table; the
tables of a conversation are folded in order, which gives each segment the states it is entered and left by, and each then finds its edits alone.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from functools import cache

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronofact.llm.text import named
from chronofact.session import stored

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 2, 3, 2, 1
#: States: nothing yet, a system turn, a user turn last, an assistant turn last; and where each may end.
NOTHING, SYSTEM, USER, ASSISTANT = range(4)
ENDS = (NOTHING, ASSISTANT)
#: Longer runs come back to a state that a shorter one reaches.
LONGEST_RUN = 2
#: Bytes of a segment: its texts, and a thousand for each row.
SEGMENT = 4 * 2**20
ROW_BYTES = 1000
FAR = 1 << 60

#: A row's fault: rows that damage dropped stay as `gone`, so that their conversation isn't lost.
NONE, BLANK, DUPLICATE, CUT, GONE = range(5)
FAULTS = {"none": NONE, "blank": BLANK, "duplicate": DUPLICATE, "truncated": CUT, "gone": GONE}


def damaged(turns: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, n: turns (conv_id, turn, role, text; null roles and texts are a space) after damage by the CRC-32 of
    `conv_id:turn`, in which a null is a space too. Equal rows are one with their number n; a dropped one has n = 0."""
    said = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(said("conv_id"), F.lit(":"), said("turn"))) % 20
    rows = named(turns, "conv_id", "turn", "role", "text").withColumn("k", kind)
    text = F.when(F.col("k") <= 1, "").when(F.col("k") == 2, F.regexp_replace(said("text"), "[.!?]", "")).otherwise(said("text"))
    role = F.when(F.col("k") == 0, "").when(F.col("k") == 4, "user").otherwise(said("role"))
    n = F.when(F.col("k") == 0, 0).when(F.col("k") == 3, 2).otherwise(1).cast("long")
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), n.alias("n")).groupBy("conv_id", "turn", "role", "text").agg(F.sum("n").alias("n"))


def _first_seen(rows: DataFrame) -> DataFrame:
    """rows (conv_id, turn, role, text, n, d: digest of the text) with `first`: whether no row of a turn before has the same role and text. What
    is said in several turns is found by a partial aggregate of digests, and is rare in most conversations."""
    spark = rows.sparkSession
    said = rows.where("n > 0").groupBy("conv_id", "role", "d").agg(F.max(F.col("turn").isNull()).alias("null_turn"), F.min("turn").alias("least"), F.count("*").alias("k"))
    again = stored(spark, said.where("k > 1").select(F.col("conv_id").alias("_c"), F.col("role").alias("_r"), F.col("d").alias("_d"), "null_turn", "least"), "again")
    alike = F.col("conv_id").eqNullSafe(F.col("_c")) & (F.col("role") == F.col("_r")) & (F.col("d") == F.col("_d"))
    found = rows.join(again, alike, "left")
    first = F.when(F.col("_d").isNull(), True).when(F.col("null_turn"), F.col("turn").isNull()).otherwise(F.col("turn") == F.col("least"))
    return found.withColumn("first", first).drop("_c", "_r", "_d", "null_turn", "least")


def faulty(rows: DataFrame) -> DataFrame:
    """rows of damaged() with the fault of the first of n; the others are its duplicates, unless it is blank."""
    rows = _first_seen(rows.withColumn("d", F.md5("text")))
    blank = ~F.col("text").rlike(r"[^\x20\x09-\x0D]")
    whole = F.col("text").rlike(r"[.!?][\x20\x09-\x0D]*\z")
    kinds = ((F.col("n") == 0, "gone"), (blank, "blank"), (~F.col("first"), "duplicate"), (~whole, "truncated"))
    fault = F.lit(FAULTS["none"])
    for condition, name in reversed(kinds):
        fault = F.when(condition, FAULTS[name]).otherwise(fault)
    return rows.withColumn("fault", fault)


def segments(rows: DataFrame, segment: int = SEGMENT) -> DataFrame:
    """rows with place (in the conversation, by turn with nulls first, role, and MD5 of the text), segment and total (the conversation's
    size in segments' bytes). Rows are sorted into ranges, so a long conversation spreads over many tasks; sizes of ranges
    are added up, and what stands before a row gives its segment."""
    order = ["conv_id", "turn", "role", "d"]
    cut = stored(rows.sparkSession, rows.repartitionByRange(*order).withColumn("part", F.spark_partition_id()), "turns")
    weight = F.octet_length("text") + ROW_BYTES
    sizes = cut.groupBy("part", "conv_id").agg(F.count("*").alias("rows"), F.sum(weight).alias("size"))
    of = Window.partitionBy("conv_id")
    earlier = of.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = sizes.select(F.col("part").alias("_part"), F.col("conv_id").alias("_conv"), *[F.coalesce(F.sum(c).over(earlier), F.lit(0)).alias(f"{c}_before") for c in ("rows", "size")], F.sum("size").over(of).alias("total"))
    own = Window.partitionBy("part", "conv_id").orderBy("turn", "role", "d")
    out = cut.withColumn("nth", F.row_number().over(own)).withColumn("ahead", F.coalesce(F.sum(weight).over(own.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    out = out.join(before, (F.col("part") == F.col("_part")) & F.col("conv_id").eqNullSafe(F.col("_conv")))
    return out.select("conv_id", "turn", "role", "text", "n", "fault", "total", (F.col("rows_before") + F.col("nth")).alias("place"), F.floor((F.col("size_before") + F.col("ahead")) / segment).alias("segment"))


def _after(state: int, role: str) -> int | None:
    """The state after a turn of a role (its initial), if the grammar allows it."""
    allowed = {("s", NOTHING): SYSTEM, ("u", NOTHING): USER, ("u", SYSTEM): USER, ("u", ASSISTANT): USER, ("a", USER): ASSISTANT}
    return allowed.get((role, state))


def _said_next(state: int) -> str:
    """The only role of user and assistant that may follow."""
    return "a" if state == USER else "u"


CODES = sorted("I" * run + edit for run in range(LONGEST_RUN + 1) for edit in "DKR")


@cache
def macro_edits(initial: str, fault: int) -> tuple[tuple[int, int, int, int], ...]:
    """state, next state, cost, code (its place in CODES) for a turn: of each pair of states the cheapest, of those the least code."""
    best: dict[tuple[int, int], tuple[int, int]] = {}
    for start in range(4):
        for code, text in enumerate(CODES):
            at, cost = start, INSERT * (len(text) - 1)
            for _ in text[:-1]:
                at = _after(at, _said_next(at))
            if text[-1] == "D":
                end, cost = at, cost + DELETE
            elif fault in (BLANK, DUPLICATE):
                continue
            else:
                end = _after(at, initial if text[-1] == "K" else _said_next(at))
                cost += (KEEP if text[-1] == "K" else REROLE) + (TRUNCATED if fault == CUT else 0)
            if end is not None:
                best[start, end] = min(best.get((start, end), (FAR, 0)), (cost, code))
    return tuple((s, t, cost, code) for (s, t), (cost, code) in sorted(best.items()))


def _ranked(keys: list[tuple | None]) -> list[int]:
    """Places of the keys in their order; those that are None come last."""
    order = sorted({k for k in keys if k is not None})
    return [len(order) if k is None else order.index(k) for k in keys]


class Layers:
    """The dynamic program over turns (initial, fault, n), entered by a state. Of a turn that is there n times, all but the first are deleted
    and change no state: an insert before a delete is worse as a string than one after it, so none stands there."""

    def __init__(self, entry: int) -> None:
        self.cost = [FAR] * 4
        self.cost[entry] = 0
        self.rank = [0] * 4
        self.parents: list[tuple[list[tuple[int, int] | None], int]] = []

    def add(self, initial: str, fault: int, n: int) -> None:
        best: list[tuple[int, int, int, int] | None] = [None] * 4
        for s, t, cost, code in macro_edits(initial, fault):
            if self.cost[s] < FAR and (best[t] is None or (self.cost[s] + cost, self.rank[s], code) < best[t][:3]):
                best[t] = (self.cost[s] + cost, self.rank[s], code, s)
        self.rank = _ranked([b and b[1:3] for b in best])
        self.cost = [b[0] + DELETE * (n - 1) if b else FAR for b in best]
        self.parents.append(([b and (b[3], b[2]) for b in best], n - 1))

    def edits(self, end: int) -> list[tuple[str, int, int]]:
        """For each turn, in order, its code, the state before it, and how many copies are deleted after it."""
        out = []
        for links, copies in reversed(self.parents):
            end, code = links[end]
            out.append((CODES[code], end, copies))
        return out[::-1]


def last_run(cost: list[int], rank: list[int]) -> tuple[int, int, int]:
    """The least total cost, the state after the last turn, and the length of the run of inserts that ends there."""
    found = []
    for state in range(4):
        at, run = state, 0
        while at not in ENDS:
            at, run = _after(at, _said_next(at)), run + 1
        found.append((cost[state] + INSERT * run, rank[state], state, run))
    total, _, state, run = min(found)
    return total, state, run


class Turns:
    """What is counted of the turns of a segment, in order, and folded over segments."""

    NAMES = ("rows", "blank", "duplicate", "truncated", "illegal", "turns", "first_turn", "last_turn", "first_initial", "last_initial")

    def __init__(self) -> None:
        self.rows = self.blank = self.duplicate = self.truncated = self.illegal = self.turns = 0
        self.first_turn = self.last_turn = self.first_initial = self.last_initial = None

    def add(self, turn: int | None, initial: str, fault: int, n: int) -> None:
        own = Turns()
        own.rows, own.blank, own.truncated = n, n * (fault == BLANK), int(fault == CUT)
        own.duplicate = n - 1 if fault in (NONE, CUT) else n * (fault == DUPLICATE)
        own.illegal = n - 1  # a role next to itself
        own.turns, own.first_turn, own.last_turn = int(turn is not None), turn, turn
        own.first_initial = own.last_initial = initial
        self.fold(own)

    def fold(self, after: Turns) -> None:
        if not after.rows:
            return
        if self.rows and f"{self.last_initial}{after.first_initial}" not in ("su", "ua", "au"):
            self.illegal += 1
        for name in ("rows", "blank", "duplicate", "truncated", "illegal", "turns"):
            setattr(self, name, getattr(self, name) + getattr(after, name))
        if after.first_turn is not None:
            self.turns -= int(self.last_turn == after.first_turn)
            self.first_turn = after.first_turn if self.first_turn is None else self.first_turn
            self.last_turn = after.last_turn
        self.first_initial = after.first_initial if self.first_initial is None else self.first_initial
        self.last_initial = after.last_initial

    @property
    def gaps(self) -> int:
        return 0 if self.last_turn is None else min(self.last_turn - self.first_turn + 1 - self.turns, 2**63 - 1)


NAMES = {"s": "system", "u": "user", "a": "assistant"}


def written(code: str, state: int, role: str | None, text: str | None) -> tuple[list[str], int]:
    """The lines of a macro edit, and the state after it. Without a role it is a run of inserts."""
    lines = []
    for edit in code:
        if edit == "D":
            continue
        own = _said_next(state) if edit != "K" else role[0]
        lines.append(f"{NAMES[own]}:" if edit == "I" else f"{NAMES[own]}:{text}" if edit == "R" else f"{role}:{text}")
        state = _after(state, own)
    return lines, state


RESULT = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
ARROW = pa.schema([pa.field(n, pa.int64() if k == "long" else pa.large_string()) for n, k in (c.split() for c in RESULT.split(", "))])


def _sorted_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*[batch.column(i).to_pylist() for i in range(batch.num_columns)])


def _groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[tuple[tuple, Iterator[tuple]]]:
    """Runs of rows that are equal in their first columns."""
    from itertools import groupby

    yield from groupby(_sorted_rows(batches), key=lambda r: r[:keys])


def _told(seen: Turns, cost: int, audit: str, digest: str, conv: int | None) -> dict:
    return {"conv_id": conv, "gaps": seen.gaps, "blank": seen.blank, "duplicate": seen.duplicate, "truncated": seen.truncated, "illegal": seen.illegal, "cost": cost, "audit": audit, "repaired_sha256": digest}


def _batches(found: Iterator[dict], schema: pa.Schema, most: int = 500) -> Iterator[pa.RecordBatch]:
    held: list[dict] = []
    for row in found:
        held.append(row)
        if len(held) == most:
            yield pa.RecordBatch.from_pylist(held, schema)
            held = []
    if held:
        yield pa.RecordBatch.from_pylist(held, schema)


def _pieces(rows: list[tuple[str, str]], edits: list[tuple[str, int, int]], entry: int) -> tuple[str, list[str]]:
    state, lines = entry, []
    for (role, text), (code, _, _) in zip(rows, edits):
        own, state = written(code, state, role, text)
        lines += own
    return "".join(code + "D" * copies for code, _, copies in edits), lines


def repair_whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Results of conversations of one segment each: conv_id, turn, role, text, n, fault in order."""

    def found() -> Iterator[dict]:
        for (conv,), rows in _groups(batches, 1):
            seen, layers, kept = Turns(), Layers(NOTHING), []
            for _, turn, role, text, n, fault in rows:
                if fault != GONE:
                    seen.add(turn, role[:1], fault, n)
                    layers.add(role[:1], fault, n)
                    kept.append((role, text))
            cost, state, run = last_run(layers.cost, layers.rank)
            audit, lines = _pieces(kept, layers.edits(state), NOTHING)
            lines += written("I" * run, state, None, None)[0]
            yield _told(seen, cost, audit + "I" * run, hashlib.sha256("\n".join(lines).encode()).hexdigest(), conv)

    return _batches(found(), ARROW)


#: Of a segment: what it counts, and its costs and ranks from each state to each state.
TABLE = "conv_id long, segment long, rows long, blank long, duplicate long, truncated long, illegal long, turns long, first_turn long, last_turn long, first_initial string, last_initial string, cost array<long>, rank array<long>"


def tabled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The table of each segment: conv_id, segment, turn, role, n, fault in order."""
    kinds = {"long": pa.int64(), "string": pa.string(), "array<long>": pa.list_(pa.int64())}
    schema = pa.schema([pa.field(n, kinds[k]) for n, k in (c.split() for c in TABLE.split(", "))])

    def found() -> Iterator[dict]:
        for (conv, segment), rows in _groups(batches, 2):
            seen, layers = Turns(), [Layers(s) for s in range(4)]
            for _, _, turn, role, n, fault in rows:
                if fault != GONE:
                    seen.add(turn, role[:1], fault, n)
                    for own in layers:
                        own.add(role[:1], fault, n)
                        own.parents.clear()
            yield {"conv_id": conv, "segment": segment, **{c: getattr(seen, c) for c in Turns.NAMES}, "cost": [c for x in layers for c in x.cost], "rank": [r for x in layers for r in x.rank]}

    return _batches(found(), schema)


#: Of a segment: the states it is entered and left by, and of its conversation what is counted.
ROUTE = "conv_id long, segment long, entry int, leave int, run int, gaps long, blank long, duplicate long, truncated long, illegal long, cost long"


def folded(tables: pd.DataFrame) -> pd.DataFrame:
    """The tables of a conversation folded in order, and its way through their states walked back."""
    tables = tables.sort_values("segment")
    cost, rank, links, seen = [0, FAR, FAR, FAR], [0] * 4, [], Turns()
    for row in tables.to_dict("records"):
        after = Turns()
        for c in Turns.NAMES:
            setattr(after, c, None if pd.isna(row[c]) else row[c] if c.endswith("initial") else int(row[c]))
        seen.fold(after)
        best: list[tuple | None] = [None] * 4
        for s in range(4):
            for t in range(4):
                c, r = int(row["cost"][4 * s + t]), int(row["rank"][4 * s + t])
                if cost[s] < FAR and c < FAR and (best[t] is None or (cost[s] + c, rank[s], r) < best[t][:3]):
                    best[t] = (cost[s] + c, rank[s], r, s)
        cost, rank = [b[0] if b else FAR for b in best], _ranked([b and b[1:3] for b in best])
        links.append([b and b[3] for b in best])
    total, state, run = last_run(cost, rank)
    route = []
    for link in reversed(links):
        route.append((link[state], state))
        state = link[state]
    out = tables[["conv_id", "segment"]].copy()
    out["entry"], out["leave"] = [r[0] for r in route[::-1]], [r[1] for r in route[::-1]]
    out["run"] = [0] * (len(out) - 1) + [run]
    for c in ("gaps", "blank", "duplicate", "truncated", "illegal"):
        out[c] = getattr(seen, c)
    out["cost"] = total
    return out


PIECE = "conv_id long, segment long, audit string, repaired string, lines long"


def edited(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The audit and the repaired lines of each segment: conv_id, segment, entry, leave, run, role, text, n, fault in order."""
    kinds = {"long": pa.int64(), "string": pa.large_string()}
    schema = pa.schema([pa.field(n, kinds[k]) for n, k in (c.split() for c in PIECE.split(", "))])

    def found() -> Iterator[dict]:
        for (conv, segment, entry, leave, run), rows in _groups(batches, 5):
            layers, kept = Layers(entry), []
            for *_, role, text, n, fault in rows:
                if fault != GONE:
                    layers.add(role[:1], fault, n)
                    kept.append((role, text))
            audit, lines = _pieces(kept, layers.edits(leave), entry)
            lines += written("I" * run, leave, None, None)[0]
            yield {"conv_id": conv, "segment": segment, "audit": audit + "I" * run, "repaired": "\n".join(lines), "lines": len(lines)}

    return _batches(found(), schema, 1)


def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The audit and the digest of each conversation from its pieces in order; texts stream through the digest."""

    def found() -> Iterator[dict]:
        for (conv,), pieces in _groups(batches, 1):
            audit, digest, begun = [], hashlib.sha256(), False
            for _, _, own, text, lines in pieces:
                audit.append(own)
                if lines:
                    digest.update((("\n" if begun else "") + text).encode())
                    begun = True
            yield {"conv_id": conv, "audit": "".join(audit), "repaired_sha256": digest.hexdigest()}

    return _batches(found(), pa.schema([ARROW.field("conv_id"), ARROW.field("audit"), ARROW.field("repaired_sha256")]))


def _in_order(rows: DataFrame, *keys: str) -> DataFrame:
    return rows.repartition(*keys).sortWithinPartitions(*keys, "place")


def _long(rows: DataFrame) -> DataFrame:
    """Results of conversations of several segments."""
    table = stored(rows.sparkSession, _in_order(rows, "conv_id", "segment").select("conv_id", "segment", "turn", "role", "n", "fault").mapInArrow(tabled, TABLE), "tables")
    route = stored(rows.sparkSession, table.groupBy("conv_id").applyInPandas(folded, ROUTE), "routes")  # a small row for each 4 MB
    way = route.select(F.col("conv_id").alias("_c"), F.col("segment").alias("_s"), "entry", "leave", "run")
    own = rows.join(way, F.col("conv_id").eqNullSafe(F.col("_c")) & (F.col("segment") == F.col("_s")))
    pieces = _in_order(own, "conv_id", "segment").select("conv_id", "segment", "entry", "leave", "run", "role", "text", "n", "fault").mapInArrow(edited, PIECE)
    ended = pieces.repartition("conv_id").sortWithinPartitions("conv_id", "segment").mapInArrow(joined, "conv_id long, audit string, repaired_sha256 string")
    counts = route.where("segment = 0").select(F.col("conv_id").alias("_c"), "gaps", "blank", "duplicate", "truncated", "illegal", "cost")
    both = ended.join(counts, F.col("conv_id").eqNullSafe(F.col("_c")))
    return both.select(*[c.split()[0] for c in RESULT.split(", ")])


def repair(turns: DataFrame, segment: int = SEGMENT) -> DataFrame:
    """Damaged conversations repaired: for each conv_id of turns (conv_id, turn, role, text) the columns of RESULT.

    Rows are taken by turn (nulls first), then role, then the MD5 of the text. Null roles and texts are one space, whose initial no grammar
    allows; an empty role has no initial, so its row can't be kept. A row that repeats is a row of its own, and a duplicate. Null conv_ids are
    one conversation. Texts are read whole; a segment holds one text at least. The turns of a conversation can be any number: only its audit
    and, in order, its digest are made in one task. Gaps beyond a long are the greatest long. Other columns are ignored, and an empty
    table gives an empty result."""
    rows = stored(turns.sparkSession, segments(faulty(damaged(turns)), segment), "segments")
    whole = _in_order(rows.where(F.col("total") <= segment), "conv_id").select("conv_id", "turn", "role", "text", "n", "fault").mapInArrow(repair_whole, RESULT)
    long = rows.where(F.col("total") > segment)
    return whole.unionByName(_long(long)) if long.limit(1).count() else whole
