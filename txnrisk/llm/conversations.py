"""Conversation structure repair by Four-Russians block tables.

A conversation should alternate: initials of the roles in order of turn match ``(s?(ua)+)?``. The cheapest edits
to get there (keep 0, rerole 2, delete 3, insert 2, one more for a truncated row that stays; blank and
duplicate rows must go) are a walk over four states: nothing yet, after the system row, after a user row, after an
assistant row. The costs-to-go of these states differ by a few units at most, so normalised by
their minimum they take few values; a table gives for each of these vectors and *every* block of
``width`` row symbols the vector before the block and what its minimum grew by. Conversations are
processed from the last row to the first, a block per lookup. Blocks are then expanded in the opposite
direction: from the first row on, each step takes the ASCII-least edit that keeps to the least cost, so
of all cheapest edit sequences the ASCII-least comes out.

Rows become one-byte symbols by Spark: equal rows are counted before they are sorted, the sorted table is
cut by range, so a conversation of any length is spread over tasks, and what one task holds of a
conversation is one byte a row (as the audit itself). The texts go through the cluster once more, merged
with the audits in sorted order, and are hashed as they stream by.

Rows are ordered by turn (nulls first), then role, then the SHA-256 of the text. A null role or text is one space; a null
conv_id is a conversation of its own. Rows repeated in the table are duplicates of each other. An empty table gives no
rows. Other columns are dropped.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from txnrisk.llm.common import release
from txnrisk.sources.scratch import materialise

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 2, 3, 2, 1
START, SYSTEM, USER, ASSISTANT = range(4)
#: Symbols: 4 * fault + initial.
INITIALS = "sua"  # any other: 3
CLEAN, CUT, BLANK, DUPLICATE = range(4)
SYMBOLS = 16
#: Rows of a block.
WIDTH = 3

#: The state after a row or an inserted row of role user / assistant, by the state before; None: not allowed.
_NEXT = {"s": (SYSTEM, None, None, None), "u": (USER, USER, None, USER), "a": (None, None, ASSISTANT, None)}
_SPACE = " \t\n\x0b\x0c\r"


# -- the automaton ---------------------------------------------------------------------------------


def _filled(state: int) -> int:
    """The state after a user or assistant row that fits behind ``state``."""
    return ASSISTANT if state == USER else USER


def _steps(state: int, symbol: int) -> list[tuple[str, int, int]]:
    """(edit, cost, state after) of a row, in ASCII order of the edits."""
    fault, initial = divmod(symbol, 4)
    steps = [("D", DELETE, state)]
    if fault in (CLEAN, CUT):
        extra = TRUNCATED if fault == CUT else 0
        if initial < 3 and _NEXT[INITIALS[initial]][state] is not None:
            steps.append(("K", KEEP + extra, _NEXT[INITIALS[initial]][state]))
        steps.append(("R", REROLE + extra, _filled(state)))
    return steps


def _with_inserts(costs: list[int]) -> list[int]:
    """Costs-to-go that may begin with inserted rows; two in a row suffice."""
    for _ in range(2):
        costs = [min(costs[q], INSERT + costs[_filled(q)]) for q in range(4)]
    return costs


END = tuple(_with_inserts([0, 10**6, 10**6, 0]))


def before(costs: tuple[int, ...], symbol: int) -> list[int]:
    """Costs-to-go before a row from those behind it."""
    return _with_inserts([min(cost + costs[to] for _, cost, to in _steps(q, symbol)) for q in range(4)])


@functools.lru_cache(maxsize=4)
def tables(width: int = WIDTH) -> tuple[list[tuple[int, ...]], np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Normalised vectors; (vector, symbol) -> vector, growth; (vector, block) -> vector, growth. The block
    number holds the first row's symbol in its highest digit."""
    vectors = [tuple(c - min(END) for c in END)]
    number = {vectors[0]: 0}
    to, grow = [], []
    for vector in vectors:  # grows while it is read
        ids, adds = [], []
        for symbol in range(SYMBOLS):
            costs = before(vector, symbol)
            least = min(costs)
            normal = tuple(c - least for c in costs)
            if normal not in number:
                number[normal] = len(vectors)
                vectors.append(normal)
            ids.append(number[normal])
            adds.append(least)
        to.append(ids)
        grow.append(adds)
    one_to, one_grow = np.array(to, np.int32), np.array(grow, np.int32)
    block_to, block_grow = one_to, one_grow
    for _ in range(width - 1):  # one more row in front of every block
        rows = len(vectors)
        longer_to = one_to[block_to].transpose(0, 2, 1).reshape(rows, -1)
        longer_grow = (block_grow[:, :, None] + one_grow[block_to]).transpose(0, 2, 1).reshape(rows, -1)
        block_to, block_grow = longer_to, longer_grow
    return vectors, one_to, one_grow, block_to, block_grow


@functools.lru_cache(maxsize=1)
def _moves() -> list[list[list[tuple[str, int, int]]]]:
    return [[_steps(state, symbol) for symbol in range(SYMBOLS)] for state in range(4)]


def audit(symbols: bytes, width: int = WIDTH) -> tuple[int, str]:
    """Least cost, and the ASCII-least of the cheapest edit sequences."""
    vectors, one_to, one_grow, block_to, block_grow = tables(width)
    moves = _moves()
    n = len(symbols)
    head = n % width  # the rows in front of the whole blocks
    values = np.frombuffer(symbols, np.uint8)
    digits = SYMBOLS ** np.arange(width - 1, -1, -1)
    blocks = values[head:].reshape(-1, width).astype(np.int64) @ digits
    behind = np.zeros(len(blocks) + 1, np.int32)  # vector behind each block
    vector, cost = 0, min(END)
    for i in range(len(blocks) - 1, -1, -1):
        behind[i + 1] = vector
        cost += int(block_grow[vector, blocks[i]])
        vector = int(block_to[vector, blocks[i]])
    behind[0] = vector

    edits: list[str] = []
    state = START

    def expand(rows: bytes, last: int) -> None:
        nonlocal state
        ids, gains = [last], []
        for symbol in reversed(rows):
            gains.append(int(one_grow[ids[-1], symbol]))
            ids.append(int(one_to[ids[-1], symbol]))
        for i, symbol in enumerate(rows):
            here, there, gain = vectors[ids[len(rows) - i]], vectors[ids[len(rows) - i - 1]], gains[len(rows) - i - 1]
            while True:
                least = here[state] + gain
                options = [(edit, to, False) for edit, price, to in moves[state][symbol] if price + there[to] == least]
                if INSERT + here[_filled(state)] + gain == least:
                    options.append(("I", _filled(state), True))
                edit, state, again = min(options)
                edits.append(edit)
                if not again:
                    break

    if head:
        ahead = vector
        for symbol in reversed(symbols[:head]):
            cost += int(one_grow[ahead, symbol])
            ahead = int(one_to[ahead, symbol])
        total = cost + vectors[ahead][START]
        expand(symbols[:head], vector)
    else:
        total = cost + vectors[vector][START]
    for i in range(len(blocks)):
        at = head + i * width
        expand(symbols[at : at + width], int(behind[i + 1]))
    edits += "I" * (END[state] // INSERT)
    return total, "".join(edits)


# -- rows and their symbols ------------------------------------------------------------------------


def _blankable(name: str) -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(" "))


def damaged(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text) after the damage that crc32 of ``conv_id:turn`` decides."""
    key = F.concat(_blankable("conv_id"), F.lit(":"), _blankable("turn"))
    rows = conversations.select("conv_id", F.col("turn").cast("bigint").alias("turn"), _blankable("role").alias("role"), _blankable("text").alias("text"), (F.crc32(key) % 20).alias("_harm"))
    rows = rows.filter("_harm <> 0")
    text = F.when(F.col("_harm") == 1, "").when(F.col("_harm") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("_harm") == 4, "user").otherwise(F.col("role"))
    copies = F.when(F.col("_harm") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    rows = rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(copies).alias("_copy"))
    return rows.drop("_copy")


def _ordered_keys(rows: DataFrame) -> DataFrame:
    """``rows`` with the order of a conversation: known, turn, role, digest."""
    return rows.withColumn("known", F.col("turn").isNotNull()).withColumn("digest", F.unhex(F.sha2(F.col("text"), 256)))


def cells(rows: DataFrame) -> DataFrame:
    """(conv_id, known, turn, role, digest, times, symbol, first): equal rows once, with how often they come, the
    symbol they have as first of their role and text, and whether one of them is this first."""
    keyed = _ordered_keys(rows)
    kept = F.rtrim("text", F.lit(_SPACE))
    fault = F.when(kept == "", BLANK).when(~F.substring(kept, -1, 1).isin(".", "!", "?"), CUT).otherwise(CLEAN)
    initial = F.lit(3)
    for i, letter in enumerate(INITIALS):
        initial = F.when(F.substring("role", 1, 1) == letter, i).otherwise(initial)
    keyed = keyed.withColumn("symbol", (fault * 4 + initial).cast("int"))
    names = ["conv_id", "known", "turn", "role", "digest"]
    grouped = keyed.groupBy(*names).agg(F.count(F.lit(1)).alias("times"), F.first("symbol").alias("symbol"))
    firsts = grouped.groupBy("conv_id", "role", "digest").agg(F.min(F.struct("known", "turn")).alias("at"))
    marks = firsts.select("conv_id", F.col("at.known").alias("known"), F.col("at.turn").alias("turn"), "role", "digest", F.lit(0).cast("bigint").alias("times"), F.lit(None).cast("int").alias("symbol"), F.lit(1).alias("first"))
    both = grouped.withColumn("first", F.lit(0)).unionByName(marks)
    return both.groupBy(*names).agg(F.max("times").alias("times"), F.max("symbol").alias("symbol"), F.max("first").alias("first"))


_RUN = "conv_id {id}, part int, no int, symbols binary, turns bigint, least bigint, most bigint, first_turn bigint, last_turn bigint"


def symbol_runs(table: DataFrame, part_rows: int = 1 << 16) -> DataFrame:
    """(conv_id, part, no, symbols, turns, ...): the symbols of a conversation in pieces of a sorted range."""
    id_type = table.schema["conv_id"].dataType.simpleString()
    ordered = table.repartitionByRange("conv_id", "known", "turn", "role", "digest")
    ordered = ordered.sortWithinPartitions("conv_id", "known", "turn", "role", "digest")
    rows = ordered.select("conv_id", "turn", "times", "symbol", "first", F.spark_partition_id().alias("part"))
    schema = _RUN.format(id=id_type)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        conv, open_, no, part = None, False, 0, 0
        symbols, turns, least, most, first_turn, last_turn = bytearray(), 0, None, None, None, None
        id_arrow = None

        def close() -> None:
            nonlocal no, symbols, turns, least, most
            if symbols:
                out.append((conv, part, no, bytes(symbols), turns, least, most, first_turn, last_turn))
            no += 1
            symbols, turns, least, most = bytearray(), 0, None, None

        def emitted() -> pa.RecordBatch:
            types = [id_arrow, pa.int32(), pa.int32(), pa.binary(), *[pa.int64()] * 5]
            columns = list(zip(*out, strict=True)) if out else [[]] * 9
            names = [f.split()[0] for f in schema.split(", ")]
            batch = pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, types, strict=True)], names=names)
            out.clear()
            return batch

        for batch in batches:
            id_arrow = batch.schema.field(0).type
            for conv_id, turn, times, symbol, first, at in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if not open_ or conv_id != conv:
                    if open_:
                        close()
                    conv, open_, no, part, first_turn, last_turn = conv_id, True, 0, at, turn, None
                elif len(symbols) >= part_rows:
                    close()
                    first_turn, last_turn = turn, None
                fault, initial = divmod(symbol, 4)
                again = symbol if fault == BLANK else DUPLICATE * 4 + initial
                if first:
                    symbols.append(symbol)
                    times -= 1
                if turn is not None and turn != last_turn:
                    turns += 1
                    least = turn if least is None else least
                    most, last_turn = turn, turn
                while times > 0:
                    some = min(times, max(1, part_rows - len(symbols)))
                    symbols += bytes([again]) * some
                    times -= some
                    if times:
                        close()
                        first_turn, turns, least, most = turn, int(turn is not None), turn, turn
            if len(out) > 10_000:
                yield emitted()
        if open_:
            close()
            yield emitted()
        release()

    return rows.mapInArrow(run, schema)


# -- conversations ---------------------------------------------------------------------------------

_REPORT = "gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, audit string, symbols binary"


def repaired(runs: DataFrame, width: int = WIDTH) -> DataFrame:
    """One row per conversation that has rows: its faults, cost, audit and symbols."""
    parts = runs.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct(*runs.columns[1:]))).alias("parts"))
    id_field = f"conv_id {runs.schema['conv_id'].dataType.simpleString()}"
    legal = np.zeros((4, 4), bool)
    for a, b in ("su", "ua", "au"):
        legal[INITIALS.index(a), INITIALS.index(b)] = True

    def report(pieces: list[dict]) -> tuple:
        symbols = b"".join(p["symbols"] for p in pieces)
        turns = sum(p["turns"] for p in pieces)
        for a, b in zip(pieces, pieces[1:], strict=False):  # a turn over the border of two pieces
            turns -= a["last_turn"] is not None and a["last_turn"] == b["first_turn"]
        least = next((p["least"] for p in pieces if p["least"] is not None), None)
        most = next((p["most"] for p in reversed(pieces) if p["most"] is not None), None)
        gaps = 0 if least is None else most - least + 1 - turns
        values = np.frombuffer(symbols, np.uint8)
        faults = np.bincount(values >> 2, minlength=4)
        initials = values & 3
        illegal = int((~legal[initials[:-1], initials[1:]]).sum())
        cost, edits = audit(symbols, width)
        return gaps, int(faults[BLANK]), int(faults[DUPLICATE]), int(faults[CUT]), illegal, cost, edits, symbols

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                piece = batch.slice(at, 1000)
                rows = [report(p) for p in piece.column(1).to_pylist()]
                types = [*[pa.int64()] * 6, pa.string(), pa.binary()]
                columns = [pa.array(list(c), t) for c, t in zip(zip(*rows, strict=True), types, strict=True)]
                names = ["conv_id", *[f.split()[0] for f in _REPORT.split(", ")]]
                yield pa.RecordBatch.from_arrays([piece.column(0), *columns], names=names)

    return parts.mapInArrow(run, f"{id_field}, {_REPORT}")


def _merged(rows: DataFrame, reports: DataFrame) -> DataFrame:
    """Rows of a conversation in order, its audit in front, in streams that hold one row at a time."""
    keyed = _ordered_keys(rows).select("conv_id", F.lit(1).alias("side"), "known", "turn", "role", "digest", "text", F.lit(None).cast("string").alias("audit"))
    heads = reports.select("conv_id", F.lit(0).alias("side"), F.lit(False).alias("known"), F.lit(None).cast("bigint").alias("turn"), F.lit("").alias("role"), F.lit(b"").alias("digest"), F.lit("").alias("text"), "audit")
    return keyed.unionByName(heads).repartition("conv_id").sortWithinPartitions("conv_id", "side", "known", "turn", "role", "digest").select("conv_id", "side", "role", "text", "audit")


class _Repair:
    """Follows an audit over the rows of a conversation and gives the rows of the repaired one."""

    def __init__(self, edits: str):
        self._edits, self._at, self._state = edits, 0, START

    def _fill(self) -> str:
        self._state = _filled(self._state)
        return "assistant" if self._state == ASSISTANT else "user"

    def inserted(self) -> Iterator[tuple[str, str]]:
        while self._at < len(self._edits) and self._edits[self._at] == "I":
            self._at += 1
            yield self._fill(), ""

    def row(self, role: str, text: str) -> Iterator[tuple[str, str]]:
        yield from self.inserted()
        edit = self._edits[self._at]
        self._at += 1
        if edit == "K":
            self._state = _NEXT[role[0]][self._state]
            yield role, text
        elif edit == "R":
            yield self._fill(), text


def repaired_rows(rows: DataFrame, reports: DataFrame) -> DataFrame:
    """(conv_id, position, role, text): the repaired conversations."""
    id_field = f"conv_id {rows.schema['conv_id'].dataType.simpleString()}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        repair, conv, position = None, None, 0
        for batch in batches:
            out: list[tuple] = []

            def put(found: Iterator[tuple[str, str]]) -> None:
                nonlocal position
                for role, text in found:
                    out.append((conv, position, role, text))  # noqa: B023
                    position += 1

            for conv_id, side, role, text, edits in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if side == 0:
                    if repair is not None:
                        put(repair.inserted())
                    repair, conv, position = _Repair(edits), conv_id, 0
                else:
                    put(repair.row(role, text))
            types = [batch.schema.field(0).type, pa.int64(), pa.string(), pa.string()]
            yield _batch(out, types, ["conv_id", "position", "role", "text"])
            last_type = types
        if repair is not None:
            out = [(conv, position + i, role, text) for i, (role, text) in enumerate(repair.inserted())]
            yield _batch(out, last_type, ["conv_id", "position", "role", "text"])

    return _merged(rows, reports).mapInArrow(run, f"{id_field}, position bigint, role string, text string")


def _batch(rows: list[tuple], types: list[pa.DataType], names: list[str]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [[]] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, types, strict=True)], names=names)


def digests(rows: DataFrame, reports: DataFrame) -> DataFrame:
    """(conv_id, repaired_sha256): SHA-256 of the repaired ``role:text`` lines."""
    id_field = f"conv_id {rows.schema['conv_id'].dataType.simpleString()}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        repair, conv, sha, lines, id_type = None, None, hashlib.sha256(), 0, None
        done: list[tuple] = []

        def put(found: Iterator[tuple[str, str]]) -> None:
            nonlocal lines
            for role, text in found:
                sha.update((b"\n" if lines else b"") + f"{role}:{text}".encode())
                lines += 1

        for batch in batches:
            id_type = batch.schema.field(0).type
            for conv_id, side, role, text, edits in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if side == 0:
                    if repair is not None:
                        put(repair.inserted())
                        done.append((conv, sha.hexdigest()))
                    repair, conv, sha, lines = _Repair(edits), conv_id, hashlib.sha256(), 0
                else:
                    put(repair.row(role, text))
            yield _batch(done, [id_type, pa.string()], ["conv_id", "repaired_sha256"])
            done = []
        if repair is not None:
            put(repair.inserted())
            yield _batch([(conv, sha.hexdigest())], [id_type, pa.string()], ["conv_id", "repaired_sha256"])
        release()

    return _merged(rows, reports).mapInArrow(run, f"{id_field}, repaired_sha256 string")


COUNTS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]


def repair_report(conversations: DataFrame, part_rows: int = 1 << 16, width: int = WIDTH) -> DataFrame:
    """Faults, cost, audit and digest of every conversation, those without rows after the damage included."""
    rows = damaged(conversations)
    reports = materialise(repaired(symbol_runs(cells(rows), part_rows), width).drop("symbols"), "audits")
    hashed = digests(rows, reports)
    names = [*COUNTS, "audit", "repaired_sha256"]
    empty = hashlib.sha256().hexdigest()
    every = conversations.select("conv_id", *[F.lit(None).cast("bigint").alias(c) for c in COUNTS], F.lit(None).cast("string").alias("audit"), F.lit(None).cast("string").alias("repaired_sha256"))
    counted = reports.select("conv_id", *COUNTS, "audit", F.lit(None).cast("string").alias("repaired_sha256"))
    digested = hashed.select("conv_id", *[F.lit(None).cast("bigint").alias(c) for c in COUNTS], F.lit(None).cast("string").alias("audit"), "repaired_sha256")
    together = every.unionByName(counted).unionByName(digested).groupBy("conv_id").agg(*[F.max(c).alias(c) for c in names])
    zeros = {**dict.fromkeys(COUNTS, 0), "audit": "", "repaired_sha256": empty}
    return together.fillna(zeros)
