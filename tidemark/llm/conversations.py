"""Repair of the structure of conversations by cheapest edits.

The repaired roles' initials have to read ``(s?(ua)+)?``.  A turn is kept (K,
0), gets another role (R, 1) or is deleted (D, 2); an empty turn can be put in
anywhere (I, 5); a turn that is cut off and not deleted costs 5 more.  Backward
over the turns, the least cost to go is worked out for every state of the
grammar; forward, the ASCII-least edit is taken among those that are tight
against these costs, which gives the least string of the cheapest edits.

Conversations are dealt by ranges of (conversation, turn), so a long one spans
many blocks.  The costs of a block are a matrix from its first state to its
last, and the walk through it a map of states: both compose, so the blocks of
one conversation are joined by a row each.  Texts don't move before the edits
are known.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, BooleanType, DataType, DoubleType, IntegerType, LongType, StringType, StructField, StructType

from tidemark.llm.scratch import written

#: What edits cost, white space, the ends of a whole text.
REROLE, DELETE, INSERT, CUT_OFF = 1, 2, 5, 5
BLANKS = " \t\n\x0b\f\r"
ENDS = (".", "!", "?")
#: States: nothing yet, after s, after u, after a. The first and the last may end.
FIRST, SYSTEM, USER, ASSISTANT = range(4)
STATES = range(4)
#: The state after a turn that is put in or gets the role that fits: u, but a after u.
FITTING = (USER, USER, ASSISTANT, USER)
NAMES = {USER: "user", ASSISTANT: "assistant"}
INITIALS = {(FIRST, "s"): SYSTEM, (FIRST, "u"): USER, (SYSTEM, "u"): USER, (ASSISTANT, "u"): USER, (USER, "a"): ASSISTANT}
LEGAL = ("su", "ua", "au")
#: Faults of a row.
WHOLE, OPEN, LATER, BLANK = range(4)
#: Distinct turns of a block.
BLOCK_ROWS = 1 << 17

Costs = tuple[float, ...]
NONE = float("inf")


def _closed(costs: Iterable[float]) -> Costs:
    """With turns put in first: three at most, as then a state comes again."""
    out = list(costs)
    for _ in range(3):
        out = [min(out[q], INSERT + out[FITTING[q]]) for q in STATES]
    return tuple(out)


#: The cost to go after the last turn.
END: Costs = _closed((0, NONE, NONE, 0))


def _taken(initial: str, fault: int, state: int) -> list[tuple[str, float, int]]:
    """(edit, cost, next state) of a turn in a state, ASCII-least edit first; deletion is the only one of a blank or repeated turn."""
    edits = [("D", DELETE, state)]
    if fault in (WHOLE, OPEN):
        more = CUT_OFF if fault == OPEN else 0
        if (state, initial) in INITIALS:
            edits.append(("K", more, INITIALS[state, initial]))
        edits.append(("R", REROLE + more, FITTING[state]))
    return edits


@lru_cache(1 << 16)
def _costs(initial: str, fault: int, after: Costs) -> Costs:
    return _closed(min(cost + after[to] for _, cost, to in _taken(initial, fault, q)) for q in STATES)


def cost_before(initial: str, fault: int, after: Costs) -> Costs:
    """The costs to go before a turn, from those after it."""
    least = min(after)
    return tuple(least + c for c in _costs(initial, fault, tuple(c - least for c in after)))


@lru_cache(1 << 16)
def _choice(initial: str, fault: int, after: Costs, state: int) -> tuple[str, int, float]:
    costs = _costs(initial, fault, after)
    edits, spent = "", 0.0
    while True:
        options = [(e, c, to, after[to]) for e, c, to in _taken(initial, fault, state)] + [("I", INSERT, FITTING[state], costs[FITTING[state]])]
        edit, cost, to, _ = min(o for o in options if o[1] + o[3] == costs[state])
        edits, spent, state = edits + edit, spent + cost, to
        if edit != "I":
            return edits, state, spent


def choice(initial: str, fault: int, after: Costs, state: int) -> tuple[str, int, float]:
    """(edits, next state, cost): turns put in before a turn, and what becomes of it."""
    least = min(after)
    return _choice(initial, fault, tuple(c - least for c in after), state)


def closing(state: int) -> tuple[str, int, float]:
    """The turns to put in after the last one."""
    edits = ""
    while END[state]:
        edits, state = edits + "I", FITTING[state]
    return edits, state, float(INSERT * len(edits))


def _same(a: Column, b: Column) -> Column:
    return a.eqNullSafe(b)


def _faults(text: Column) -> dict[str, Column]:
    bare = F.rtrim(text, F.lit(BLANKS))
    return {"blank": bare == "", "open": ~F.substring(bare, -1, 1).isin(*ENDS)}


def distinct_turns(rows: DataFrame, conv: str, turn: str, role: str, text: str, copies: str | None) -> tuple[DataFrame, DataFrame]:
    """(conv, turn, role, digest, text) and (conv, placed, turn, role, digest, n, fault): equal rows of a conversation and turn are one with their number."""
    space = lambda c: F.coalesce(F.col(c), F.lit(" "))
    plain = rows.select(
        F.col(conv).alias("conv"), F.col(turn).cast("long").alias("turn"), space(role).alias("role"), space(text).alias("text"),
        (F.col(copies) if copies else F.lit(1)).cast("long").alias("n"),
    )
    runs = plain.groupBy("conv", "turn", "role", "text").agg(F.sum("n").alias("n"))
    runs = written(runs.select("conv", F.col("turn").isNotNull().alias("placed"), "turn", "role", F.unhex(F.sha2("text", 256)).alias("digest"), "text", "n"), "turns")
    place = F.struct("placed", "turn")
    marks = _faults(F.col("text"))
    light = runs.select(*[c for c in runs.columns if c != "text"], marks["blank"].alias("blank"), marks["open"].alias("open"))
    first = written(light.filter("not blank").groupBy("conv", "role", "digest").agg(F.min(place).alias("first")), "first")
    f = first.select(F.col("conv").alias("c"), F.col("role").alias("r"), F.col("digest").alias("d"), "first")
    joined = light.join(f, _same(F.col("conv"), F.col("c")) & (F.col("role") == F.col("r")) & (F.col("digest") == F.col("d")), "left")
    fault = F.when(F.col("blank"), BLANK).when(~_same(F.col("first"), place), LATER).when(F.col("open"), OPEN).otherwise(WHOLE)
    return runs.select("conv", "turn", "role", "digest", "text"), joined.select("conv", "placed", "turn", "role", "digest", "n", fault.alias("fault"))


def _conversations(block: pa.Table) -> Iterator[tuple[int, int]]:
    """(first, end) of the rows of each conversation of a sorted block."""
    keys, at = block.column("conv").to_pylist(), 0
    for i in range(1, len(keys) + 1):
        if i == len(keys) or keys[i] != keys[at]:
            yield at, i
            at = i


def _sorted(block: pa.Table) -> pa.Table:
    return block.sort_by([(c, "ascending") for c in ("conv", "placed", "turn", "role", "digest")])


def _steps(block: pa.Table) -> list[tuple[str, int, int]]:
    """(initial, fault, deleted): each run of equal rows as its first row and how many have to go after it, or instead of it."""
    out = []
    for role, fault, n in zip(block.column("role").to_pylist(), block.column("fault").to_pylist(), block.column("n").to_pylist()):
        out.append((role[:1], fault, n - 1 if fault in (WHOLE, OPEN) else n))
    return out


def _backward(steps: list[tuple[str, int, int]], after: Costs) -> list[Costs]:
    """The costs to go before all steps, and after each.  As costs to go are closed, a deletion only adds to them."""
    out = [after]
    for initial, fault, deleted in reversed(steps):
        after = tuple(DELETE * deleted + c for c in after)
        if fault in (WHOLE, OPEN):
            after = cost_before(initial, fault, after)
        out.append(after)
    return out[::-1]


def _forward(steps: list[tuple[str, int, int]], after: Costs, state: int) -> Iterator[tuple[str, int, float]]:
    """(edits, state, cost) of each step on the cheapest, ASCII-least way.  What has to go is tight as a deletion, and no edit is less."""
    for (initial, fault, deleted), to_go in zip(steps, _backward(steps, after)[1:]):
        edits, cost = "", 0.0
        if fault in (WHOLE, OPEN):
            edits, state, cost = choice(initial, fault, tuple(DELETE * deleted + c for c in to_go), state)
        yield edits + "D" * deleted, state, cost + DELETE * deleted


def block_summaries(block: pa.Table) -> pa.Table:
    """(conv, block, illegal, first, last, costs) of each conversation in a block: the pairs of roles inside it that can't follow each other, and its matrix of costs."""
    block = _sorted(block)
    roles, times, found = block.column("role").to_pylist(), block.column("n").to_pylist(), []
    for a, b in _conversations(block):
        steps = _steps(block.slice(a, b - a))
        illegal = sum(n - 1 for n in times[a:b]) + sum(roles[i][:1] + roles[i + 1][:1] not in LEGAL for i in range(a, b - 1))
        columns = [_backward(steps, _closed(0.0 if q == end else NONE for q in STATES))[0] for end in STATES]
        found.append((a, illegal, roles[a][:1], roles[b - 1][:1], [columns[end][q] for q in STATES for end in STATES]))
    at, illegal, first, last, costs = zip(*found)
    return _keyed(block, at, illegal=pa.array(illegal, pa.int64()), first=pa.array(first), last=pa.array(last), costs=pa.array(costs, pa.list_(pa.float64())))


def _keyed(block: pa.Table, at: Iterable[int], **columns: pa.Array) -> pa.Table:
    """conv and block of some rows, and further columns."""
    keys = block.select(["conv", "block"]).take(pa.array(at, pa.int64()))
    return pa.table([*keys.columns, *columns.values()], ["conv", "block", *columns])


def costs_to_go(parts: pa.Table) -> pa.Table:
    """(conv, block, after, odd, final) of the blocks of one conversation: the costs to go after each, whether its first pair, across the border, is illegal, whether it is the last."""
    parts = parts.sort_by("block")
    costs, first, last = (parts.column(c).to_pylist() for c in ("costs", "first", "last"))
    after, out = END, []
    for matrix in reversed(costs):
        out.append(list(after))
        after = tuple(min(matrix[4 * q + end] + after[end] for end in STATES) for q in STATES)
    odd = [0] + [int(a + b not in LEGAL) for a, b in zip(last, first[1:])]
    final = [i == len(out) - 1 for i in range(len(out))]
    return _keyed(parts, range(len(out)), after=pa.array(out[::-1], pa.list_(pa.float64())), odd=pa.array(odd, pa.int64()), final=pa.array(final))


def _placed(block: pa.Table, places: pa.Table) -> Iterator[tuple[int, list[tuple[str, int, int]], dict, pa.Table]]:
    """Of a sorted block and its places: first row, steps, place and rows of each conversation that has one."""
    at = {p["conv"]: p for p in places.to_pylist()}
    keys = block.column("conv").to_pylist()
    for a, b in _conversations(block):
        if keys[a] in at:
            yield a, _steps(block.slice(a, b - a)), at[keys[a]], block.slice(a, b - a)


def ways_through(block: pa.Table, places: pa.Table) -> pa.Table:
    """(conv, block, ends): the state in which each state leaves the block."""
    block, found = _sorted(block), []
    for a, steps, place, _ in _placed(block, places):
        ends = []
        for state in STATES:
            for _, state, _ in _forward(steps, tuple(place["after"]), state):
                pass
            ends.append(state)
        found.append((a, ends))
    return _keyed(block, [a for a, _ in found], ends=pa.array([e for _, e in found], pa.list_(pa.int32())))


def first_states(parts: pa.Table) -> pa.Table:
    """(conv, block, state) of the blocks of one conversation: the state in which the way enters each."""
    parts, state, out = parts.sort_by("block"), FIRST, []
    for ends in parts.column("ends").to_pylist():
        out.append(state)
        state = ends[state]
    return _keyed(parts, range(len(out)), state=pa.array(out, pa.int32()))


def edited(block: pa.Table, places: pa.Table) -> pa.Table:
    """(conv, block, audit, cost, turns): the edits of each conversation in a block and the turns that they leave."""
    block, found = _sorted(block), []
    for a, steps, place, rows in _placed(block, places):
        audit, total, turns, state = [], 0.0, [], place["state"]
        source = zip(rows.column("turn").to_pylist(), rows.column("role").to_pylist(), rows.column("digest").to_pylist())
        was = state
        for (edits, state, cost), (turn, role, digest) in zip(_forward(steps, tuple(place["after"]), place["state"]), source):
            audit.append(edits)
            total += cost
            for edit in edits.rstrip("D"):
                was = INITIALS[was, role[:1]] if edit == "K" else FITTING[was]
                turns.append({"role": role if edit == "K" else NAMES[was], "turn": turn if edit != "I" else None, "was": role if edit != "I" else None, "digest": digest if edit != "I" else None})
        if place["final"]:
            edits, _, cost = closing(state)
            audit.append(edits)
            total += cost
            for _ in edits:
                was = FITTING[was]
                turns.append({"role": NAMES[was], "turn": None, "was": None, "digest": None})
        found.append((a, "".join(audit), int(total), turns))
    at, audits, totals, turns = zip(*found) if found else ((), (), (), ())
    kind = pa.list_(pa.struct([("role", pa.string()), ("turn", pa.int64()), ("was", pa.string()), ("digest", pa.binary())]))
    return _keyed(block, at, audit=pa.array(audits, pa.string()), cost=pa.array(totals, pa.int64()), turns=pa.array(turns, kind))


def _keys(rows: DataFrame, **columns: DataType) -> StructType:
    return StructType([rows.schema["conv"], StructField("block", IntegerType()), *(StructField(k, v) for k, v in columns.items())])


def cheapest_edits(turns: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(conv, block, illegal, audit, cost, turns): the edits of every block, from the rows that :func:`distinct_turns` gives."""
    many = max(1, -(-turns.count() // block_rows))
    order = [F.col(c).asc_nulls_first() for c in ("conv", "placed", "turn", "role", "digest")]
    blocks = written(turns.repartitionByRange(many, *order).withColumn("block", F.spark_partition_id()), "blocks")
    kind = _keys(blocks, illegal=LongType(), first=StringType(), last=StringType(), costs=ArrayType(DoubleType()))
    parts = written(blocks.groupBy("block").applyInArrow(block_summaries, kind), "parts")
    costs = ArrayType(DoubleType())
    longer = parts.groupBy("conv").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select(F.col("conv").alias("of"))
    split = parts.join(longer, _same(F.col("conv"), F.col("of")), "left_semi")
    after = written(split.groupBy("conv").applyInArrow(costs_to_go, _keys(blocks, after=costs, odd=LongType(), final=BooleanType())), "after")
    crossing = blocks.join(longer, _same(F.col("conv"), F.col("of")), "left_semi")
    ends = crossing.groupBy("block").cogroup(after.groupBy("block")).applyInArrow(ways_through, _keys(blocks, ends=ArrayType(IntegerType())))
    state = written(ends, "ends").groupBy("conv").applyInArrow(first_states, _keys(blocks, state=IntegerType()))
    on = lambda left, right: _same(left["conv"], right["conv"]) & (left["block"] == right["block"])
    entry = written(after.alias("x").join(state.alias("y"), on(after, state)).select("x.*", "y.state"), "entry")
    whole = F.array(*[F.lit(float(c)) for c in END])
    places = parts.alias("p").join(entry.alias("e"), _same(F.col("p.conv"), F.col("e.conv")) & (F.col("p.block") == F.col("e.block")), "left").select(
        "p.conv", "p.block", F.coalesce("e.after", whole).alias("after"), F.coalesce("e.final", F.lit(True)).alias("final"),
        F.coalesce("e.state", F.lit(FIRST)).alias("state"), (F.col("p.illegal") + F.coalesce("e.odd", F.lit(0))).alias("illegal"),
    )
    places = written(places, "places")
    left = StructType([StructField("role", StringType()), StructField("turn", LongType()), StructField("was", StringType()), StructField("digest", BinaryType())])
    edits = blocks.groupBy("block").cogroup(places.groupBy("block")).applyInArrow(edited, _keys(blocks, audit=StringType(), cost=LongType(), turns=ArrayType(left)))
    edits = written(edits, "edits")
    e, p = edits.alias("e"), places.select(F.col("conv").alias("pc"), F.col("block").alias("pb"), "illegal")
    return e.join(p, _same(F.col("conv"), F.col("pc")) & (F.col("block") == F.col("pb"))).select("conv", "block", "illegal", "audit", "cost", "turns")


def repair(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", copies: str | None = None, block_rows: int = BLOCK_ROWS) -> tuple[DataFrame, DataFrame]:
    """What is wrong with each conversation and its cheapest repair, and the repaired turns.

    Turns are ordered by ``turn`` (null first); at one turn by role, then by the
    SHA-256 of the text, so repeated rows lie together.  Null roles and texts
    are one space; a role's initial is its first character, so an empty one has
    none and can't be kept.  Null keys are one conversation.  ``copies`` names a
    column with how often a row is there.  Other columns are not read; without
    rows both tables are empty.

    Returns (conv, gaps, blank, duplicate, truncated, illegal, cost, audit), and
    (conv, block, place, role, text) whose order is that of block and place.
    """
    texts, turns = distinct_turns(rows, conv, turn, role, text, copies)
    turns = written(turns, "marked")
    edits = written(cheapest_edits(turns, block_rows), "edits")
    first = F.col("fault").isin(WHOLE, OPEN).cast("long")
    missing = F.max("turn") - F.min("turn") + 1 - F.countDistinct("turn")
    counts = turns.groupBy("conv").agg(
        F.coalesce(missing, F.lit(0)).alias("gaps"),
        F.sum(F.when(F.col("fault") == BLANK, F.col("n")).otherwise(0)).alias("blank"),
        F.sum(F.when(F.col("fault") != BLANK, F.col("n") - first).otherwise(0)).alias("duplicate"),
        F.sum((F.col("fault") == OPEN).cast("long")).alias("truncated"),
    )
    pieces = F.array_sort(F.collect_list(F.struct("block", "audit")))
    whole = edits.groupBy("conv").agg(F.sum("illegal").alias("illegal"), F.sum("cost").alias("cost"), F.array_join(pieces["audit"], "").alias("audit"))
    c, w = counts.select(F.col("conv").alias("of"), "gaps", "blank", "duplicate", "truncated"), whole
    report = w.join(c, _same(F.col("conv"), F.col("of"))).select("conv", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit")
    made = edits.select("conv", "block", F.posexplode("turns").alias("place", "new"))
    t = texts.select(F.col("conv").alias("tc"), F.col("turn").alias("tt"), F.col("role").alias("tr"), F.col("digest").alias("td"), "text")
    found = made.join(t, (F.col("new.digest") == F.col("td")) & (F.col("new.was") == F.col("tr")) & _same(F.col("conv"), F.col("tc")) & _same(F.col("new.turn"), F.col("tt")), "left")
    return report, found.select("conv", "block", "place", F.col("new.role").alias("role"), F.coalesce("text", F.lit("")).alias("text"))


def _hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of each conversation's lines, joined by newlines, as they stream by in order."""
    state, key, last = None, None, None
    for batch in batches:
        keys = []
        done: list[str] = []
        rows = zip(batch.column("conv").to_pylist(), batch.column("role").to_pylist(), batch.column("text").to_pylist())
        for i, (conv, role, text) in enumerate(rows):
            if state is None or conv != key:
                if state is not None:
                    keys.append(last)
                    done.append(state.hexdigest())
                state, key, last = hashlib.sha256(), conv, batch.column("conv").slice(i, 1)
            else:
                state.update(b"\n")
            state.update(f"{role}:{text}".encode())
        if done:
            yield pa.RecordBatch.from_arrays([pa.concat_arrays(keys), pa.array(done)], ["conv", "sha256"])
    if state is not None:
        yield pa.RecordBatch.from_arrays([last, pa.array([state.hexdigest()])], ["conv", "sha256"])


def conversation_hashes(turns: DataFrame) -> DataFrame:
    """(conv, sha256) of the ``role:text`` lines of :func:`repair`'s turns.

    A hash goes over its lines one after the other, so the kept turns of one
    conversation stream through one task, which holds a batch of them.
    """
    ordered = turns.repartition(F.col("conv")).sortWithinPartitions("conv", "block", "place").select("conv", "role", "text")
    return ordered.mapInArrow(_hashes, StructType([turns.schema["conv"], StructField("sha256", StringType())]))


def damaged(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv, turn, role, text, copies): every fault a row can have, dealt by the crc32 of ``conv:turn``; nulls are one space there and as role and text."""
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(space(conv), F.lit(":"), space(turn)).cast("binary")) % 20
    plain = rows.select(F.col(conv).alias("conv"), F.col(turn).alias("turn"), space(role).alias("role"), space(text).alias("text"), kind.alias("kind")).filter("kind != 0")
    hurt = F.when(F.col("kind") == 1, F.lit("")).when(F.col("kind") == 2, F.translate("text", "".join(ENDS), "")).otherwise(F.col("text"))
    return plain.select("conv", "turn", F.when(F.col("kind") == 4, F.lit("user")).otherwise(F.col("role")).alias("role"), hurt.alias("text"), F.when(F.col("kind") == 3, 2).otherwise(1).alias("copies"))


def repaired_conversations(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", block_rows: int = BLOCK_ROWS) -> DataFrame:
    """One row per key of ``rows``: its report after damage and the hash of its repair.

    A conversation without rows after damage has zeros, no audit and the hash of
    nothing.  Null keys are one conversation; the rest is as in :func:`repair`.
    """
    report, turns = repair(damaged(rows, conv, turn, role, text), "conv", "turn", "role", "text", "copies", block_rows)
    hashes = conversation_hashes(turns).select(F.col("conv").alias("h_conv"), "sha256")
    every = rows.select(F.col(conv).alias("key")).distinct()
    out = every.join(report, _same(F.col("key"), F.col("conv")), "left").join(hashes, _same(F.col("key"), F.col("h_conv")), "left")
    count = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
    return out.select(
        F.col("key").alias(conv), *[count(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")],
        F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("sha256", F.lit(hashlib.sha256().hexdigest())).alias("repaired_sha256"),
    )
