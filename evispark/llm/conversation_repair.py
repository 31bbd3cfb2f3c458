"""Conversation structure repair: the cheapest edits that make a conversation's roles follow a grammar.

Three weighted machines are composed: an acceptor of the conversation's rows, a transducer of edits and an acceptor of the
role grammar ``(s?(ua)+)?``.  A row matters by the initial of its role and its fault only, so the arcs of edits and grammar
are composed when such a row is first met and kept.  A shortest path over (cost, edit string), compared in that order, is
found row by row: insertions stand before the row they precede, so no two different strings up to a row are a prefix of
each other, and the order of strings is kept as a rank instead of the strings.

Conversations may be of any length.  Rows are range-sorted by conversation, turn, role and text, so that one conversation
spans as many tasks as it needs, and cut into blocks of bounded rows and bytes.  A block that holds a whole conversation is
settled where it stands.  Of others the best path between each pair of grammar states is kept; paths over blocks are chosen
with four states for each block, and the chosen ones applied to the blocks where those stand.  Only the digest of a
conversation's text is taken in one task, which reads block after block, as a hash of one string has to.

Edits, initials in the edit string: Keep (cost 0), Rerole to user or assistant (1), Delete (2), Insert an empty message
(5).  A row that is not deleted although truncated costs 5 more.  Blank rows and duplicates must be deleted.

Results: null roles and texts count as one space; such a text is blank.  Rows are taken by turn (nulls first), then role,
then text, and equal rows one after another.  A row repeated n times is one row and n - 1 duplicates.  A null conv_id is a
conversation of its own.  ``times`` says how often a row stands there; a row of 0 times only names its conversation, whose
result is then zeros, no edits and no messages.  An empty table gives no rows.  Texts are never cut, however long.  Extra
columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cache

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType, _parse_datatype_string

from .common import give_back, join_facts, materialize

#: Role grammar: state -> {initial: next state}; 0 nothing yet, 1 after system, 2 after user, 3 after assistant.
GRAMMAR = {0: {"s": 1, "u": 2}, 1: {"u": 2}, 2: {"a": 3}, 3: {"u": 2}}
FINAL = (0, 3)
STATES = len(GRAMMAR)
NAMES = {"u": "user", "a": "assistant"}
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5
#: Row and text bytes of a block.
BLOCK_ROWS, BLOCK_BYTES = 1024, 256 << 10
INITIALS = "sua-"
#: Pairs of initials that may follow each other.
LEGAL = {"su", "ua", "au"}
SPACES = " \t\n\v\f\r"
CLEAN, BLANK, DUPLICATE, CUT = range(4)


@cache
def insertions(state: int) -> list[tuple[int, int, str]]:
    """(state, cost, edits) reached from a state by inserting messages; a state is reached by its fewest insertions."""
    found, last = {state: (0, "")}, [state]
    while last:
        after = []
        for i in last:
            for initial, j in GRAMMAR[i].items():
                if initial in NAMES and j not in found:
                    found[j] = (found[i][0] + INSERT, found[i][1] + "I")
                    after.append(j)
        last = after
    return [(j, *how) for j, how in found.items()]


@cache
def arcs(initial: str, fault: int) -> list[list[tuple[int, int, str]]]:
    """For each state after a row the (state before, cost, edits) of the cheapest way there."""
    best: dict[tuple[int, int], tuple[int, str]] = {}
    extra = TRUNCATED if fault == CUT else 0
    for i in GRAMMAR:
        for k, cost, edits in insertions(i):
            ways = [(k, cost + DELETE, edits + "D")]
            if fault in (CLEAN, CUT):
                if initial in GRAMMAR[k]:
                    ways.append((GRAMMAR[k][initial], cost + KEEP + extra, edits + "K"))
                ways += [(j, cost + REROLE + extra, edits + "R") for name, j in GRAMMAR[k].items() if name in NAMES]
            for j, *how in ways:
                best[i, j] = min(best.get((i, j), (1 << 60, "")), tuple(how))
    return [[(i, *best[i, j]) for i in GRAMMAR if (i, j) in best] for j in GRAMMAR]


def step(costs: list, ranks: list, ways: list[list[tuple[int, int, str]]], more: int = 0) -> tuple[list, list, list]:
    """(costs, ranks, ways back) after a row that ``more`` deleted copies follow; a cost of None is no path."""
    found, back = [], []
    for j in range(STATES):
        best = None
        for i, cost, edits in ways[j]:
            if costs[i] is not None:
                way = (costs[i] + cost, ranks[i], edits, i)
                if best is None or way < best:
                    best = way
        found.append(best)
        back.append(best and (best[3], best[2]))
    order = sorted({w[1:3] for w in found if w})
    place = {w: n for n, w in enumerate(order)}
    return [w and w[0] + DELETE * more for w in found], [w and place[w[1:3]] for w in found], back


def ending(costs: list, ranks: list) -> tuple[int, int, str]:
    """(cost, state, insertions) of the best way from the states after the last row to the end of a conversation."""
    ways = [(costs[i] + cost, ranks[i], edits, i) for i in range(STATES) if costs[i] is not None for j, cost, edits in insertions(i) if j in FINAL]
    cost, _, edits, i = min(ways)
    return cost, i, edits


def paths(rows: list[tuple[str, int, int]], start: int) -> tuple[list, list, list[str | None]]:
    """(costs, ranks, edits) over the states after rows (initial, fault, times) from a state."""
    costs, ranks = [None] * STATES, [None] * STATES
    costs[start], ranks[start] = 0, 0
    trail = []
    for initial, fault, times in rows:
        costs, ranks, back = step(costs, ranks, arcs(initial, fault), times - 1)
        trail.append(back)
    edits: list[str | None] = []
    for j in range(STATES):
        if costs[j] is None:
            edits.append(None)
            continue
        out, at = [], j
        for back, (_, _, times) in zip(reversed(trail), reversed(rows), strict=True):
            at, label = back[at]
            out.append(label + "D" * (times - 1))
        edits.append("".join(reversed(out)))
    return costs, ranks, edits


def applied(edits: str, start: int, roles: list[str], texts: list[str | None], times: list[int]) -> tuple[list[str], list[str]]:
    """(roles, texts) of the messages that edits leave of rows."""
    out_roles, out_texts = [], []
    state, row, left = start, 0, times[0] if times else 0
    for edit in edits:
        if edit == "I" or edit == "R":
            initial = next(x for x in GRAMMAR[state] if x in NAMES)
            out_roles.append(NAMES[initial])
            out_texts.append("" if edit == "I" else texts[row])
            state = GRAMMAR[state][initial]
        elif edit == "K":
            out_roles.append(roles[row])
            out_texts.append(texts[row])
            state = GRAMMAR[state][roles[row][:1]]
        if edit != "I":
            left -= 1
            if not left:
                row += 1
                left = times[row] if row < len(times) else 0
    return out_roles, out_texts


COUNTS = ["gaps", "blank", "duplicate", "truncated", "illegal"]


@dataclass
class Tally:
    """Counts over consecutive rows; two of neighbouring stretches add up."""

    low: int | None = None
    high: int | None = None
    distinct: int = 0
    first: str | None = None
    last: str | None = None
    blank: int = 0
    duplicate: int = 0
    truncated: int = 0
    illegal: int = 0

    def add(self, other: Tally) -> None:
        if other.low is not None:
            self.distinct += other.distinct - (self.high == other.low)
            self.low, self.high = other.low if self.low is None else self.low, other.high
        if other.first is not None:
            self.illegal += self.last is not None and self.last + other.first not in LEGAL
            self.first, self.last = self.first or other.first, other.last
        for name in ("blank", "duplicate", "truncated", "illegal"):
            setattr(self, name, getattr(self, name) + getattr(other, name))

    def row(self, turn: int | None, initial: str, fault: int, times: int) -> None:
        one = Tally(turn, turn, int(turn is not None), initial, initial)
        one.illegal = (times - 1) * (initial * 2 not in LEGAL)
        one.blank = times if fault == BLANK else 0
        one.duplicate = times if fault == DUPLICATE else 0 if fault == BLANK else times - 1
        one.truncated = int(fault == CUT)
        self.add(one)

    def counts(self) -> dict[str, int]:
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.distinct
        return {"gaps": gaps} | {c: getattr(self, c) for c in COUNTS[1:]}


@dataclass
class Block:
    conv: object
    sure: bool  # no row of its conversation stands before it
    tally: Tally = field(default_factory=Tally)
    rows: list = field(default_factory=list)
    roles: list = field(default_factory=list)
    texts: list = field(default_factory=list)
    size: int = 0


TALLY = "low long, high long, distinct long, first string, last string, blank long, duplicate long, truncated long, illegal long"
#: What a repaired block holds: the edits of its rows and the messages that they leave; the last block of a conversation has its totals.
REPAIRED = "edits string, roles array<string>, texts array<string>, cost long, " + ", ".join(f"{c} long" for c in COUNTS)


def _arrow(schema: StructType) -> pa.Schema:
    return to_arrow_schema(schema)


def _batches(rows: Iterator[dict], schema: pa.Schema, weight: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Rows in batches of bounded text."""
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += 200 + sum(len(x or "") for x in row.get("texts") or ()) + sum(len(x or "") for x in row.get("ways") or ())
        if size >= weight or len(held) >= 4096:
            yield pa.RecordBatch.from_pylist(held, schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_pylist(held, schema)
    give_back()


def judged(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, initial, fault and times of the distinct rows; text is null where it must be deleted."""
    blank_text = F.coalesce(F.col("text").cast("string"), F.lit(" "))
    blank_role = F.coalesce(F.col("role").cast("string"), F.lit(" "))
    times = F.col("times").cast("long") if "times" in rows.columns else F.lit(1).cast("long")
    there = times > 0
    flat = rows.select("conv_id", F.when(there, F.col("turn").cast("long")).alias("turn"), F.when(there, blank_role).alias("role"), F.when(there, blank_text).alias("text"), times.alias("times"))
    distinct = flat.groupBy("conv_id", "turn", "role", "text").agg(F.sum("times").alias("times"))
    keyed = materialize(distinct.withColumn("key", F.unhex(F.sha2(F.to_json(F.struct("conv_id", "role", "text")), 256))))
    # The first turn of a text: null comes first.
    place = F.struct(F.col("turn").isNotNull().alias("known"), F.col("turn").alias("turn"))
    facts = materialize(keyed.groupBy("key").agg(F.min(place).alias("first"), F.count("*").alias("n")))
    # Given as a column: literals in SQL text know no \x escapes.
    rest = F.rtrim(F.col("text"), F.lit(SPACES))
    fault = F.when(rest == "", BLANK).when(place > F.col("first"), DUPLICATE).when(~F.right(rest, F.lit(1)).isin(".", "!", "?"), CUT).otherwise(CLEAN)
    initial = F.substring("role", 1, 1)
    known = F.when(initial.isin(*"sua"), initial).when(F.col("role").isNotNull(), INITIALS[3])
    marked = join_facts(keyed, facts, "key", keyed.count()).withColumn("fault", fault)
    kept = F.when(F.col("fault").isin(CLEAN, CUT), F.col("text"))
    return marked.select("conv_id", "turn", "role", "text", known.alias("initial"), "fault", kept.alias("kept"), "times")


def blocks(rows: DataFrame, block_rows: int = BLOCK_ROWS, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Blocks of sorted rows: settled where they hold a whole conversation, else with the best ways between states."""
    spark = rows.sparkSession
    order = ["conv_id", "turn", "role", "text"]
    # Sampled for its ranges, then sorted: written first, so that nothing before it runs twice.
    marked = materialize(judged(rows))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    stand = marked.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    kind = rows.schema["conv_id"].dataType.simpleString()
    schema = _parse_datatype_string(f"conv_id {kind}, part int, seq long, whole boolean, tally struct<{TALLY.replace(' ', ':').replace(',:', ', ')}>, prices array<long>, ways array<string>, times array<long>, " + REPAIRED)
    arrow = _arrow(schema)

    def close(b: Block, part: int, seq: int, whole: bool) -> dict:
        out = {"conv_id": b.conv, "part": part, "seq": seq, "whole": whole}
        if whole:
            costs, ranks, edits = paths(b.rows, 0)
            cost, at, tail = ending(costs, ranks)
            path = edits[at] + tail
            roles, texts = applied(path, 0, b.roles, b.texts, [r[2] for r in b.rows])
            return out | {"edits": path, "roles": roles, "texts": texts, "cost": cost} | b.tally.counts()
        prices, ways = [], []
        for start in range(STATES):
            if start and b.sure:
                costs, edits = [None] * STATES, [None] * STATES
            else:
                costs, _, edits = paths(b.rows, start)
            prices += costs
            ways += edits
        return out | {"tally": vars(b.tally), "prices": prices, "ways": ways, "times": [r[2] for r in b.rows], "roles": b.roles, "texts": b.texts}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()

        def found() -> Iterator[dict]:
            block, seq = None, 0
            # A block is followed by another of its conversation, by one of another, or by the next task's rows.
            for batch in batches:
                for conv, turn, role, initial, fault, kept, times in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "turn", "role", "initial", "fault", "kept", "times")), strict=True):
                    if block is None:
                        block = Block(conv, False)
                    elif conv != block.conv:
                        yield close(block, part, seq, block.sure)
                        block, seq = Block(conv, True), seq + 1
                    elif len(block.rows) >= block_rows or block.size >= block_bytes:
                        yield close(block, part, seq, False)
                        block, seq = Block(conv, False), seq + 1
                    if times:
                        block.tally.row(turn, initial, fault, times)
                        block.rows.append((initial, fault, times))
                        block.roles.append(role)
                        block.texts.append(kept)
                        block.size += len(kept or "")
            if block is not None:
                yield close(block, part, seq, False)

        yield from _batches(found(), arrow)

    return materialize(stand.mapInArrow(run, schema))


def _choices(open_blocks: DataFrame) -> DataFrame:
    """part, seq, start, end, tail, with totals in the last block: the path over the blocks of each conversation."""
    kind = open_blocks.schema["conv_id"].dataType.simpleString()
    fields = f"conv_id {kind}, part int, seq long, start int, stop int, tail string, cost long, " + ", ".join(f"{c} long" for c in COUNTS)
    schema = _parse_datatype_string(fields)
    arrow = _arrow(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def settle(conv: object, places: list, trail: list, costs: list, ranks: list, tally: Tally) -> Iterator[dict]:
            cost, at, tail = ending(costs, ranks)
            chain = []
            for back in reversed(trail):
                chain.append((back[at], at))
                at = back[at]
            for n, ((part, seq), (start, stop)) in enumerate(zip(places, reversed(chain), strict=True), 1):
                row = {"conv_id": conv, "part": part, "seq": seq, "start": start, "stop": stop, "tail": ""}
                yield row | ({"tail": tail, "cost": cost} | tally.counts() if n == len(places) else {})

        def found() -> Iterator[dict]:
            state = None
            for batch in batches:
                for r in batch.to_pylist():
                    if state is None or state[0] != r["conv_id"]:
                        if state:
                            yield from settle(*state)
                        state = [r["conv_id"], [], [], [0, None, None, None], [0, None, None, None], Tally()]
                    _, places, trail, costs, ranks, tally = state
                    ways = [[(i, r["prices"][i * STATES + j], r["ways"][i * STATES + j]) for i in range(STATES) if r["prices"][i * STATES + j] is not None] for j in range(STATES)]
                    state[3], state[4], back = step(costs, ranks, ways)
                    places.append((r["part"], r["seq"]))
                    trail.append([b and b[0] for b in back])
                    tally.add(Tally(**r["tally"]))
            if state:
                yield from settle(*state)

        yield from _batches(found(), arrow)

    small = open_blocks.select("conv_id", "part", "seq", "tally", "prices", "ways")
    return small.repartition("conv_id").sortWithinPartitions("conv_id", "part", "seq").mapInArrow(run, schema)


def repair(rows: DataFrame, block_rows: int = BLOCK_ROWS, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Repaired conversations in blocks: conv_id, part, seq (their order), edits, roles, texts, and in a conversation's last
    block cost, gaps, blank, duplicate, truncated and illegal of all its rows.

    ``rows`` has conv_id, turn, role, text and, if need be, times.
    """
    found = blocks(rows, block_rows, block_bytes)
    columns = ["conv_id", "part", "seq", "edits", "roles", "texts", "cost", *COUNTS]
    settled = found.filter("whole").select(*columns)
    rest = found.filter("NOT whole")
    chosen = _choices(rest).drop("conv_id")
    pieces = rest.drop("cost", "edits", *COUNTS).join(chosen, ["part", "seq"])
    schema = _parse_datatype_string(f"conv_id {rows.schema['conv_id'].dataType.simpleString()}, part int, seq long, " + REPAIRED)
    arrow = _arrow(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def found() -> Iterator[dict]:
            for batch in batches:
                for r in batch.to_pylist():
                    edits = r["ways"][r["start"] * STATES + r["stop"]] + r["tail"]
                    roles, texts = applied(edits, r["start"], r["roles"], r["texts"], r["times"])
                    yield {c: r[c] for c in ("conv_id", "part", "seq", "cost", *COUNTS)} | {"edits": edits, "roles": roles, "texts": texts}

        yield from _batches(found(), arrow)

    return settled.unionByName(pieces.mapInArrow(run, schema))


def messages(repaired: DataFrame) -> DataFrame:
    """conv_id, position within the conversation's block, role and text of each message that the repair leaves."""
    pairs = F.arrays_zip(F.col("roles").alias("role"), F.col("texts").alias("text"))
    return repaired.select("conv_id", "part", "seq", F.posexplode(pairs).alias("pos", "m")).select("conv_id", "part", "seq", "pos", F.col("m.role").alias("role"), F.col("m.text").alias("text"))


def digests(repaired: DataFrame) -> DataFrame:
    """conv_id, counts, cost, audit (all edits in order) and repaired_sha256 (``role:text`` lines) of each conversation."""
    schema = _parse_datatype_string(f"conv_id {repaired.schema['conv_id'].dataType.simpleString()}, {', '.join(f'{c} long' for c in COUNTS)}, cost long, audit string, repaired_sha256 string")
    arrow = _arrow(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def found() -> Iterator[dict]:
            sha, audit, lines = hashlib.sha256(), [], 0
            for batch in batches:
                for r in batch.to_pylist():
                    for role, text in zip(r["roles"], r["texts"], strict=True):
                        sha.update((("\n" if lines else "") + f"{role}:{text}").encode("utf-8", "surrogatepass"))
                        lines += 1
                    audit.append(r["edits"])
                    if r["cost"] is not None:  # the conversation's last block
                        yield {c: r[c] for c in ("conv_id", "cost", *COUNTS)} | {"audit": "".join(audit), "repaired_sha256": sha.hexdigest()}
                        sha, audit, lines = hashlib.sha256(), [], 0

        yield from _batches(found(), arrow)

    return repaired.repartition("conv_id").sortWithinPartitions("conv_id", "part", "seq").mapInArrow(run, schema)


def damaged(conversations: DataFrame) -> DataFrame:
    """Conversations with faults, by the checksum of ``conv_id:turn`` modulo 20: 0 drops a row (times 0), 1 empties its text,
    2 removes its stops, 3 doubles it, 4 makes it the user's."""

    def spaced(name: str) -> F.Column:
        return F.coalesce(F.col(name).cast("string"), F.lit(" "))

    kind = F.crc32(F.concat(spaced("conv_id"), F.lit(":"), spaced("turn"))) % 20
    text = F.when(kind == 1, "").when(kind == 2, F.translate(spaced("text"), ".!?", "")).otherwise(spaced("text"))
    role = F.when(kind == 4, "user").otherwise(spaced("role"))
    times = F.when(kind == 0, 0).when(kind == 3, 2).otherwise(1)
    return conversations.select("conv_id", "turn", role.alias("role"), text.alias("text"), times.alias("times"))
