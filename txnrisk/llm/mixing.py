"""Mixing sources to target weights by Pfair scheduling.

Each source's documents, in a hashed order, are cut into blocks of ``block_docs``. Block i (from 1) of a source
with weight w has the release time floor((i - 1) / w) and the deadline ceil(i / w), in slots
of one block. Earliest deadline first among the released blocks meets every deadline, so at any time
a source has had its share of the slots to within one block, until it runs out.

Weights are whole multiples of 2^-48 with sum 1, about the precision of the numbers they come from: against the
target weights a source drifts by less than a millionth of a block in 10^8 slots. A caller that gives ``period`` asks for
multiples of 1 / ``period`` instead.
One task walks over the blocks (one row per ``block_docs`` documents) and holds one entry per stream; it reads
one row per stream. A source that has run out leaves its slots empty; the others keep their windows.
Every document comes exactly once.

Target weights are given by source, or by default the square root of the source's size. By default every source is
a stream of its own; with given weights the sources not named form one stream together, and null sources always do.
Repeated rows are all kept; a null doc_id is ordered like an id.
An empty table gives an empty one; existing columns keep their names, whatever these are.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from fractions import Fraction

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from txnrisk.sources.scratch import materialise

#: The stream of all sources that have none of their own.
REST = "\x00rest"
#: Weights are whole multiples of 1 / WHOLE: numbers as 0.1 and 0.9 add up to exactly 1.
WHOLE = 1 << 48
#: Blocks that the walk hands on at a time.
BATCH = 1 << 14


def rounded_weights(weights: dict[str, float], period: int) -> dict[str, int]:
    """Slots of each stream per period: largest remainders, one at least."""
    if not weights:
        return {}
    if len(weights) > period or min(weights.values()) < 0 or sum(weights.values()) <= 0:
        raise ValueError("weights must not be negative, and there must be no more streams than slots in a period")
    total = sum(weights.values())
    exact = {s: w / total * period for s, w in weights.items()}
    slots = {s: max(1, math.floor(x)) for s, x in exact.items()}
    order = sorted(weights, key=lambda s: (slots[s] - exact[s], s))
    i = 0
    while (left := period - sum(slots.values())) != 0:
        s = order[i % len(order)] if left > 0 else max(slots, key=lambda s: (slots[s] - exact[s], slots[s], s))
        if left > 0 or slots[s] > 1:
            slots[s] += 1 if left > 0 else -1
        i += 1
    return slots


def pattern(slots: dict[str, int]) -> list[tuple[str, int, int]]:
    """(stream, block of the period, slot) of one period, earliest deadline first."""
    period = sum(slots.values())
    weight = {s: Fraction(q, period) for s, q in slots.items()}
    waiting = [(0, s, 1) for s in sorted(slots)]  # release time, stream, block
    ready: list[tuple[int, str, int]] = []
    out = []
    for slot in range(period):
        while waiting and waiting[0][0] <= slot:
            _, s, i = heapq.heappop(waiting)
            heapq.heappush(ready, (math.ceil(i / weight[s]), s, i))
        deadline, s, i = heapq.heappop(ready)
        if deadline <= slot:
            raise AssertionError("a deadline was missed")
        out.append((s, i - 1, slot))
        if i < slots[s]:
            heapq.heappush(waiting, (math.floor(i / weight[s]), s, i + 1))
    return out


def streams(docs: DataFrame, weights: dict[str, float] | None) -> DataFrame:
    """(stream, n, weight) of every stream that has rows: its rows and target weight, weights in any unit."""
    source = F.col("source").cast("string")
    if weights is not None:
        weights = {s: w for s, w in weights.items() if w > 0 and s != REST}
        source = F.when(source.isin(list(weights)), source)
    counts = docs.groupBy(F.coalesce(source, F.lit(REST)).alias("stream")).agg(F.count(F.lit(1)).alias("n"))
    counts = materialise(counts, "sources")
    if weights is None:
        return counts.withColumn("weight", F.sqrt("n"))
    total, listed = counts.agg(F.sum("n"), F.sum(F.when(F.col("stream") != REST, F.col("n")))).first()
    total, listed = total or 0, listed or 0
    share = sum(weights.values()) if weights else 1.0
    given = [(s, float(w)) for s, w in weights.items()]
    if total > listed:
        given.append((REST, float(share * (total - listed) / max(1, listed))))
    # a named source without rows keeps its share of the slots
    named = docs.sparkSession.createDataFrame(given, "stream string, weight double")
    return named.join(counts, "stream", "left").select("stream", F.coalesce("n", F.lit(0)).alias("n"), "weight")


def walk(table: list[tuple[str, int, float]], whole: int = WHOLE) -> Iterator[tuple[str, int, int]]:
    """(stream, block, slot) of all blocks, given (stream, blocks, weight): earliest deadline first.

    Slots of streams that have run out stay empty; where nothing is released the walk goes on to the next release.
    """
    unit = rounded_weights({s: w for s, _, w in table}, whole)
    blocks = {s: n for s, n, _ in table}
    waiting = [(0, s, 1) for s in sorted(blocks) if blocks[s]]  # release time, stream, block
    ready: list[tuple[int, str, int]] = []
    slot = 0
    while waiting or ready:
        if not ready:
            slot = max(slot, waiting[0][0])
        while waiting and waiting[0][0] <= slot:
            _, s, i = heapq.heappop(waiting)
            heapq.heappush(ready, (-(-i * whole // unit[s]), s, i))
        deadline, s, i = heapq.heappop(ready)
        if deadline <= slot:
            raise AssertionError("a deadline was missed")
        yield s, i - 1, slot
        if i < blocks[s]:
            heapq.heappush(waiting, (i * whole // unit[s], s, i + 1))
        slot += 1


def placed(sizes: DataFrame, block_docs: int, whole: int = WHOLE) -> DataFrame:
    """(stream, block, slot) of all blocks of the streams (stream, n, weight)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = [(r["stream"], -(-r["n"] // block_docs), r["weight"]) for b in batches for r in b.to_pylist()]
        if not table:
            return
        held: list[tuple[str, int, int]] = []
        names = ["stream", "block", "slot"]
        for row in walk(table, whole):
            held.append(row)
            if len(held) == BATCH:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*held)], names=names)
                held = []
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*held)], names=names)

    return sizes.coalesce(1).mapInArrow(run, "stream string, block bigint, slot bigint")


def _key():
    """Names a row by its doc_id and text; also the hashed order inside a source."""
    return F.xxhash64("doc_id", "text")


def scheduled(docs: DataFrame, weights: dict[str, float] | None = None, block_docs: int = 16, period: int | None = None) -> DataFrame:
    """(doc_id, key, stream, block, slot): the slot of every row of ``docs``; key is a hash of doc_id and text."""
    sizes = streams(docs, weights)
    plan = materialise(placed(sizes, block_docs, period or WHOLE), "plan")
    source = F.col("source").cast("string")
    if weights is not None:
        source = F.when(source.isin([s for s, w in weights.items() if w > 0 and s != REST]), source)
    rows = docs.select("doc_id", _key().alias("key"), F.coalesce(source, F.lit(REST)).alias("stream"))
    keys = ["stream", "key", "doc_id"]
    seq = F.monotonically_increasing_id()
    ordered = rows.repartitionByRange(*keys).sortWithinPartitions(*keys)
    ordered = materialise(ordered.withColumn("_part", F.shiftright(seq, 33)).withColumn("_at", seq.bitwiseAND((1 << 33) - 1)), "ordered")
    # rows of the stream before each part: one row per stream and part
    parts = ordered.groupBy("stream", "_part").agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_n"))
    before = F.coalesce(F.sum("_n").over(W.partitionBy("stream").orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    parts = parts.select("stream", "_part", (before - F.col("_first")).alias("_shift"))
    numbered = ordered.join(parts, ["stream", "_part"]).withColumn("block", F.floor((F.col("_at") + F.col("_shift")) / block_docs))
    return numbered.join(plan, ["stream", "block"]).select("doc_id", "key", "stream", "block", "slot")


def mixed(docs: DataFrame, weights: dict[str, float] | None = None, block_docs: int = 16, period: int | None = None) -> DataFrame:
    """``docs`` in the order of the schedule: partitions follow each other, rows inside them are sorted.
    Rows that repeat doc_id and text stand together, in the first of their slots."""
    places = scheduled(docs, weights, block_docs, period).groupBy("key").agg(F.min("slot").alias("_slot"))
    keyed = docs.select(F.struct("*").alias("_row"), _key().alias("_key"))
    keys = ["_slot", "_key"]
    joined = keyed.join(places, keyed["_key"] == places["key"])
    return joined.repartitionByRange(*keys).sortWithinPartitions(*keys).select("_row.*")


def file_order() -> list:
    """Order columns of a table as it was written: by part file, then by row."""
    name = F.col("_metadata.file_name")
    part = F.regexp_extract(name, r"^part-(\d+)", 1).cast("bigint")
    split = F.regexp_extract(name, r"-c(\d+)\.", 1).cast("bigint")
    return [part, split, F.col("_metadata.row_index")]
