"""Repair of conversations: the cheapest edits after which roles alternate, found by A* on the lattice of rows and roles.

Rows are sorted over all partitions by conversation and turn, and packed into blocks of consecutive rows, so a conversation of any
length is spread over many tasks. A block has four entries (nothing yet, after a system, user or assistant turn). Where a
conversation has several blocks, each gives the least costs between its entries and exits; these are chained from the end, so
that every block knows what remains to be paid after it, and then A* finds each block's edits apart. Texts of such a
conversation meet again only in a stream in its order, of which one block at a time is held.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from barline.llm.scratch import Scratch
from barline.llm.sized import bounded

# Costs of the edits.
REROLE, DELETE, INSERT, TRUNCATED = 2, 3, 2, 1
FINE, BLANK, CUT, AGAIN = 0, 1, 2, 3
SPACE = " \t\n\x0b\x0c\r"

BLOCK_ROWS, BLOCK_CHARS = 1024, 1 << 20

#: Places of the grammar (s?(ua)+)?: nothing yet, after s, after u, after a.
START, S, U, A = range(4)
NEXT = {START: ("u", U), S: ("u", U), U: ("a", A), A: ("u", U)}
#: What is left to insert at the end.
ENDS = {START: "", S: "II", U: "I", A: ""}
END_COSTS = [INSERT * len(ENDS[s]) for s in range(4)]
FAR = 1 << 40


def _keeps(initial: str, state: int) -> int | None:
    """The place after a kept row; None if its role does not fit."""
    if state == START and initial == "s":
        return S
    role, after = NEXT[state]
    return after if initial == role else None


def cheapest(initials: list[str], faults: list[int], entry: int = START, ends: list[int] = END_COSTS) -> tuple[int, str, int]:
    """Cost, edits and exit of the cheapest way from an entry over all rows; ends: what each exit costs later.

    A*: what is still to be deleted, and a point for each truncated row, whatever becomes of it, bounds the rest from
    below. The queue is keyed by cost plus bound, then by the edits so far, so the first arrival is the least text of all
    cheapest ones. No edits of one arrival begin with all those of another: the last one always takes a row.
    """
    n, later = len(initials), min(ends)
    bound = [0] * (n + 1)
    for i in range(n - 1, -1, -1):
        bound[i] = bound[i + 1] + (DELETE if faults[i] in (BLANK, AGAIN) else TRUNCATED if faults[i] == CUT else 0)
    queue, seen = [(bound[0] + later, "", 0, entry, 0)], set()
    if not n:
        return ends[entry], "", entry
    while queue:
        total, edits, i, state, cost = heapq.heappop(queue)
        if i == n:
            return total, edits, state
        if (i, state) in seen:
            continue
        seen.add((i, state))
        role, after = NEXT[state]
        steps = [(DELETE, "D", i + 1, state), (INSERT, "I", i, after)]
        if faults[i] in (FINE, CUT):
            paid = TRUNCATED if faults[i] == CUT else 0
            steps.append((REROLE + paid, "R", i + 1, after))
            if (kept := _keeps(initials[i], state)) is not None:
                steps.append((paid, "K", i + 1, kept))
        for more, edit, j, to in steps:
            if (j, to) not in seen:
                rest = ends[to] if j == n else bound[j] + later
                heapq.heappush(queue, (cost + more + rest, edits + edit, j, to, cost + more))
    raise AssertionError("every row can be deleted")


def crossing(initials: list[str], faults: list[int]) -> list[int]:
    """Least cost from each entry to each exit (16 values) of the ways that end with a row."""
    out = []
    for entry in range(4):
        here = [FAR] * 4
        here[entry] = 0
        for initial, fault in zip(initials, faults, strict=True):
            for _ in range(3):
                for state, (_, after) in NEXT.items():
                    here[after] = min(here[after], here[state] + INSERT)
            there = [c + DELETE for c in here]
            if fault in (FINE, CUT):
                paid = TRUNCATED if fault == CUT else 0
                for state, (_, after) in NEXT.items():
                    there[after] = min(there[after], here[state] + REROLE + paid)
                    if (kept := _keeps(initial, state)) is not None:
                        there[kept] = min(there[kept], here[state] + paid)
            here = [min(c, FAR) for c in there]
        out += here
    return out


def edited(roles: list[str], texts: list[str], edits: str, state: int) -> Iterator[tuple[str, str]]:
    """Roles and texts after the edits, which begin at a place of the grammar."""
    i = 0
    for edit in edits:
        if edit == "D":
            i += 1
            continue
        role, after = NEXT[state]
        if edit == "I":
            yield ("user" if role == "u" else "assistant"), ""
        elif edit == "R":
            yield ("user" if role == "u" else "assistant"), texts[i]
        else:
            yield roles[i], texts[i]
            after = _keeps(roles[i][:1], state)
        i += edit != "I"
        state = after


_BLOCKS = "conv_id long, part int, block int, turns array<long>, roles array<string>, texts array<string>, faults array<int>, keys array<binary>"


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "array<long>": pa.list_(pa.int64()), "array<int>": pa.list_(pa.int32()), "array<string>": pa.list_(pa.string()), "array<binary>": pa.list_(pa.binary())}
    fields = [f.split() for f in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[k]) for c, (_, k) in zip(zip(*rows, strict=True), fields, strict=True)], names=[n for n, _ in fields])


def _rows(batches: Iterable[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for low in range(0, batch.num_rows, 64):
            yield from batch.slice(low, 64).to_pylist()


def fault(role: str, text: str, seen: set[bytes], key: bytes) -> int:
    """The first fault of a row, given the keys of the rows before it; adds its own."""
    again = key in seen
    seen.add(key)
    told = text.rstrip(SPACE)
    if not told:
        return BLANK
    return AGAIN if again else FINE if told[-1] in ".!?" else CUT


def _pack(batches: Iterator[pa.RecordBatch], block_rows: int) -> Iterator[pa.RecordBatch]:
    """Blocks of sorted rows; faults as far as this partition tells."""
    part, block, held, chars, seen, last = TaskContext.get().partitionId(), 0, [], 0, set(), None

    def flush() -> pa.RecordBatch:
        turns, roles, texts, faults, keys = (list(c) for c in zip(*held, strict=True))
        return _batch([(last, part, block, turns, roles, texts, faults, keys)], _BLOCKS)

    for row in _rows(batches):
        if held and (row["conv_id"] != last or len(held) >= block_rows or chars >= BLOCK_CHARS):
            yield flush()
            block, held, chars = block + 1, [], 0
        if row["conv_id"] != last:
            seen = set()
        last = row["conv_id"]
        key = hashlib.blake2b(f"{len(row['role'])}:{row['role']}{row['text']}".encode(), digest_size=16).digest()
        held.append((row["turn"], row["role"], row["text"], fault(row["role"], row["text"], seen, key), key))
        chars += len(row["text"])
    if held:
        yield flush()


def _same_block(left: str, right: str) -> Column:
    return (F.col(f"{left}.part") == F.col(f"{right}.part")) & (F.col(f"{left}.block") == F.col(f"{right}.block"))


def _crossings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for r in _rows(batches):
        yield _batch([(r["conv_id"], r["part"], r["block"], crossing([x[:1] for x in r["roles"]], r["faults"]))], "conv_id long, part int, block int, costs array<long>")


def _remaining(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """part, block, ends of blocks that come from the last to the first of each conversation."""
    last, ends = (), END_COSTS
    for r in _rows(batches):
        if last != (r["conv_id"],):
            last, ends = (r["conv_id"],), END_COSTS
        yield _batch([(r["part"], r["block"], ends)], "part int, block int, ends array<long>")
        ends = [min(min(r["costs"][4 * s + t] + ends[t] for t in range(4)), FAR) for s in range(4)]


def _ways(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The edits and the exit of a block for each of its entries."""
    for r in _rows(batches):
        found = [cheapest([x[:1] for x in r["roles"]], r["faults"], s, r["ends"]) for s in range(4)]
        yield _batch([(r["conv_id"], r["part"], r["block"], [f[1] for f in found], [f[2] for f in found])], "conv_id long, part int, block int, edits array<string>, exits array<int>")


def _chain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """part, block, entry, edits of blocks that come in order; the last of a conversation also gets what is inserted at the end."""
    schema, held, state = "part int, block int, entry int, edits string", None, START
    for r in _rows(batches):
        if held and held["conv_id"] != r["conv_id"]:
            yield _batch([(held["part"], held["block"], entry, held["edits"][entry] + ENDS[state])], schema)
            held, state = None, START
        if held:
            yield _batch([(held["part"], held["block"], entry, held["edits"][entry])], schema)
        held, entry, state = r, state, r["exits"][state]
    if held:
        yield _batch([(held["part"], held["block"], entry, held["edits"][entry] + ENDS[state])], schema)


def _alone(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edits of conversations of one block."""
    for batch in batches:
        for low in range(0, batch.num_rows, 64):
            part = batch.slice(low, 64)
            found = [cheapest([x[:1] for x in roles], faults) for roles, faults in zip(part.column("roles").to_pylist(), part.column("faults").to_pylist(), strict=True)]
            edits = pa.array([f[1] + ENDS[f[2]] for f in found])
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array([START] * part.num_rows, pa.int32()), edits], names=[*part.schema.names, "entry", "edits"])


_PLAN = "conv_id long, part int, block int, turns array<long>, roles array<string>, texts array<string>, faults array<int>"


def plan_repairs(rows: DataFrame, scratch: Scratch, block_rows: int = BLOCK_ROWS) -> tuple[DataFrame, DataFrame]:
    """Blocks (see _PLAN) with entry and edits: of conversations of one block, and of those of several."""
    named = rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"))
    order = [F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), F.col("role"), F.col("text")]
    spread = named.withColumn("row", F.monotonically_increasing_id())  # so that equal rows can be dealt to several partitions
    ordered = spread.repartitionByRange(*order, F.col("row")).sortWithinPartitions(*order, "row").drop("row")
    blocks = scratch.save(ordered.mapInArrow(lambda batches: _pack(batches, block_rows), _BLOCKS), "blocks")
    several = scratch.save(blocks.groupBy("conv_id").count().where("count > 1").select(F.col("conv_id").alias("long_id")), "several")
    is_long = F.col("conv_id").eqNullSafe(F.col("long_id"))
    short, long = blocks.join(bounded(several, 8), is_long, "left_anti"), blocks.join(bounded(several, 8), is_long, "left_semi")

    seen = long.select("conv_id", "part", "block", "faults", F.posexplode("keys").alias("at", "key")).where("get(faults, at) <> 3")
    first = Window.partitionBy("conv_id", "key").orderBy("part", "block", "at")  # one row of each partition at most
    later = seen.withColumn("turn", F.row_number().over(first)).where("turn > 1").groupBy("part", "block").agg(F.collect_set("at").alias("again"))
    known = long.alias("l").join(later.alias("r"), _same_block("l", "r"), "left").select("conv_id", "l.part", "l.block", "turns", "roles", "texts", "faults", F.coalesce("again", F.array().cast("array<int>")).alias("again"))
    told = F.transform("faults", lambda f, i: F.when((f != BLANK) & F.array_contains("again", i), AGAIN).otherwise(f))
    known = scratch.save(known.withColumn("faults", told).drop("again"), "long")

    keys = ["conv_id", "part", "block"]
    back = known.select(*keys, "roles", "faults").mapInArrow(_crossings, "conv_id long, part int, block int, costs array<long>")
    back = back.repartition("conv_id").sortWithinPartitions("conv_id", F.desc("part"), F.desc("block"))
    ends = scratch.save(back.mapInArrow(_remaining, "part int, block int, ends array<long>"), "ends")
    ways = known.alias("l").join(ends.alias("r"), _same_block("l", "r")).select("conv_id", "l.part", "l.block", "roles", "faults", "ends")
    ways = ways.mapInArrow(_ways, "conv_id long, part int, block int, edits array<string>, exits array<int>").repartition("conv_id").sortWithinPartitions(*keys)
    chain = scratch.save(ways.mapInArrow(_chain, "part int, block int, entry int, edits string"), "chain")
    planned = known.alias("l").join(chain.alias("r"), _same_block("l", "r")).select("conv_id", "l.part", "l.block", "turns", "roles", "texts", "faults", "entry", "edits")
    short = short.select("conv_id", "part", "block", "turns", "roles", "texts", "faults").mapInArrow(_alone, f"{_PLAN}, entry int, edits string")
    return short, planned


_SUMMARY = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
LEGAL = {"su", "ua", "au"}


class _Running:
    """What is told of a conversation, block by block."""

    def __init__(self, conv_id: int | None):
        self.conv_id, self.faults, self.illegal, self.cost, self.audit = conv_id, [0] * 4, 0, 0, []
        self.least = self.most = self.initial = None
        self.turns, self.text, self.lines = 0, hashlib.sha256(), 0

    def line(self, role: str, text: str) -> None:
        self.text.update(f"{chr(10) if self.lines else ''}{role}:{text}".encode())
        self.lines += 1

    def add(self, r: dict) -> None:
        for turn in r["turns"]:
            if turn is not None and turn != self.most:  # in order
                self.least = turn if self.least is None else self.least
                self.most, self.turns = turn, self.turns + 1
        for role in r["roles"]:
            self.illegal += self.initial is not None and self.initial + role[:1] not in LEGAL
            self.initial = role[:1]
        i = 0
        for edit in r["edits"]:
            self.cost += {"D": DELETE, "I": INSERT, "R": REROLE, "K": 0}[edit]
            if edit != "I":
                self.cost += TRUNCATED if edit != "D" and r["faults"][i] == CUT else 0
                i += 1
        for f in r["faults"]:
            self.faults[f] += 1
        for role, text in edited(r["roles"], r["texts"], r["edits"], r["entry"]):
            self.line(role, text)
        self.audit.append(r["edits"])

    def told(self) -> tuple:
        gaps = 0 if self.least is None else self.most - self.least + 1 - self.turns
        return (self.conv_id, gaps, self.faults[BLANK], self.faults[AGAIN], self.faults[CUT], self.illegal, self.cost, "".join(self.audit), self.text.hexdigest())


def _summaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held, out = None, []
    for r in _rows(batches):
        if held is None or held.conv_id != r["conv_id"]:
            out += [held.told()] if held else []
            held = _Running(r["conv_id"])
        held.add(r)
        if len(out) >= 256:
            yield _batch(out, _SUMMARY)
            out = []
    out += [held.told()] if held else []
    if out:
        yield _batch(out, _SUMMARY)


def _turns(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for r in _rows(batches):
        out = [(r["conv_id"], r["part"], r["block"], k, role, text) for k, (role, text) in enumerate(edited(r["roles"], r["texts"], r["edits"], r["entry"]))]
        if out:
            yield _batch(out, "conv_id long, part int, block int, at int, role string, text string")


def repair(rows: DataFrame, block_rows: int = BLOCK_ROWS) -> tuple[DataFrame, DataFrame]:
    """Two tables about conversations (conv_id, turn, role, text).

    The first has a row for each conversation: gaps between turns, rows by fault, adjacent roles that may not follow each other, the least
    cost, its audit (K keep, R give another role, D delete, I insert; ASCII-least of the cheapest) and the SHA-256 of what
    comes out. The second has the repaired rows: conv_id, part, block, at (their order), role, text.

    A null role or text counts as one space, a null turn stands first and leaves the gaps alone, rows of a null conv_id are one
    conversation. Rows of one turn are ordered by role and text, equal rows are duplicates, a role is judged by its first
    letter (an empty one fits nowhere). An empty table gives empty results; other columns are not looked at.
    """
    scratch = Scratch(rows.sparkSession, "conversations")
    short, long = plan_repairs(rows, scratch, block_rows)
    plans = scratch.save(long, "plans")
    in_order = plans.repartition("conv_id").sortWithinPartitions("conv_id", "part", "block")
    told = short.mapInArrow(_summaries, _SUMMARY).unionByName(in_order.mapInArrow(_summaries, _SUMMARY))
    turns = short.unionByName(plans).mapInArrow(_turns, "conv_id long, part int, block int, at int, role string, text string")
    return told, turns


def damage(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, text with planted faults: a hash of conversation and turn drops, empties, cuts, repeats or renames a row."""
    role, text = F.coalesce("role", F.lit(" ")), F.coalesce("text", F.lit(" "))
    name = F.concat(F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")), F.lit(":"), F.coalesce(F.col("turn").cast("string"), F.lit(" ")))
    slot = F.crc32(name.cast("binary")) % 20
    hurt = rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), slot.alias("slot")).where("slot <> 0")
    hurt = hurt.withColumns(
        {
            "text": F.when(F.col("slot") == 1, "").when(F.col("slot") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text")),
            "role": F.when(F.col("slot") == 4, "user").otherwise(F.col("role")),
            "copy": F.explode(F.when(F.col("slot") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))),
        }
    )
    return hurt.select("conv_id", "turn", "role", "text")


def repair_damaged(rows: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """The summary of every conversation of rows after damage; one that lost all its rows has zeros and the hash of nothing."""
    told, _ = repair(damage(rows), block_rows)
    all_ids = rows.select(F.col("conv_id").cast("long").alias("id")).distinct()
    out = all_ids.join(told, F.col("id").eqNullSafe(F.col("conv_id")), "left")
    numbers = [F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return out.select(F.col("id").alias("conv_id"), *numbers, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))
