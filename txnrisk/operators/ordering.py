"""Total order over a table, and running aggregates along it that no hot key can break.

``ordered_table`` range-partitions a table on its order columns, sorts inside
the partitions and stamps each row with ``seq``. ``seq`` grows along the total
order; its upper bits number the *block* (one range partition), its lower 33
bits the row inside the block. Blocks hold about equally many rows whatever the
key distribution, so a running aggregate becomes

    aggregate of the whole blocks before + aggregate of the rows before in the block

and no task ever holds more than one block of one key.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from txnrisk.sources.scratch import materialise

SEQ = "seq"
_ROW_BITS = 33
TASK_ROWS = 200_000  # rows that a task should sort at once: a row of the log is four events in the sweep of look-backs

_FN = {"sum": F.sum, "max": F.max, "min": F.min}

Bases = dict[str, tuple[str, Column]]


def block_of(seq: str = SEQ) -> Column:
    return F.shiftright(F.col(seq), _ROW_BITS)


def row_in_block(seq: str = SEQ) -> Column:
    return F.col(seq).bitwiseAND(F.lit((1 << _ROW_BITS) - 1))


def task_parts(spark: SparkSession, rows: int) -> int | None:
    """Partitions that leave a task ``TASK_ROWS`` of ``rows`` rows, or None if the session makes as many anyway. However
    many it asks for, adaptive execution may draw them together until there is one for each core."""
    parts = -(-rows // TASK_ROWS)
    made = min(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    return parts if parts > made else None


def by_key(df: DataFrame, parts: int | None, key: str) -> DataFrame:
    """``df`` shuffled on ``key``, into ``parts`` partitions if a number is given."""
    return df.repartition(parts, key) if parts else df.repartition(key)


def ordered_table(df: DataFrame, *order: str, seq: str = SEQ, blocks: int | None = None) -> DataFrame:
    """Sort ``df`` on ``order`` into blocks and write it once with its ``seq`` column.

    The written table pins the block limits: Spark samples them anew on every
    execution, and readers must agree on them. Without ``blocks`` the session's
    shuffle setting and adaptive execution choose their number.
    """
    ranged = df.repartitionByRange(blocks, *order) if blocks else df.repartitionByRange(*order)
    stamped = ranged.sortWithinPartitions(*order).withColumn(seq, F.monotonically_increasing_id())
    return materialise(stamped, "ordered")


def _combine(kind: str, a: Column, b: Column) -> Column:
    if kind == "sum":
        return F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0))
    return F.greatest(a, b) if kind == "max" else F.least(a, b)


def blockwise(
    df: DataFrame, keys: Sequence[str], before: Bases, seq: str = SEQ, after: Bases | None = None, parts: int | None = None
) -> DataFrame:
    """Add, per row, aggregates over the rows of the same key that lie strictly before
    it in ``seq`` order, and those of ``after`` over the rows strictly behind it.

    Whole blocks are aggregated first (``groupBy`` combines on the map side) and
    summed up along the blocks; that table has at most one row per key and
    block. Rows are windowed inside (key, block) only, and the join back reuses that
    partitioning, into ``parts`` partitions if a number is given. Keys must not be null.
    """
    sides = [(before, (W.unboundedPreceding, -1)), (after or {}, (1, W.unboundedFollowing))]
    every = [(name, kind, expr, frame) for bases, frame in sides for name, (kind, expr) in bases.items()]
    rows = df.withColumn("_block", block_of(seq))
    partial = rows.groupBy(*keys, "_block").agg(
        *[_FN[kind](expr).alias(f"_part_{name}") for name, kind, expr, _ in every]
    )
    along = W.partitionBy(*keys).orderBy("_block")
    carried = partial.select(
        *[F.col(k).alias(f"_key_{k}") for k in keys],
        F.col("_block").alias("_key_block"),
        *[
            _FN[kind](f"_part_{name}").over(along.rowsBetween(*frame)).alias(f"_carry_{name}")
            for name, kind, _, frame in every
        ],
    )
    inside = W.partitionBy(*keys, "_block").orderBy(seq)
    if parts:
        rows = rows.repartition(parts, *keys, "_block")
    rows = rows.select(
        "*",
        *[_FN[kind](expr).over(inside.rowsBetween(*frame)).alias(f"_in_{name}") for name, kind, expr, frame in every],
    )
    if not keys:
        carried = F.broadcast(carried)  # one row per block
    match = F.col("_block") == F.col("_key_block")
    for k in keys:
        match = match & (F.col(k) == F.col(f"_key_{k}"))
    joined = rows.join(carried, match, "left")
    return joined.select(
        *df.columns,
        *[_combine(kind, F.col(f"_carry_{name}"), F.col(f"_in_{name}")).alias(name) for name, kind, _, _ in every],
    )


def _block_offsets(df: DataFrame, seq: str) -> DataFrame | None:
    """(_block, _offset): rows in the blocks before, if ``df`` holds every row of its blocks, else None.
    One small row per block passes the driver."""
    size = (F.max(row_in_block(seq)) + 1).alias("size")
    found = df.groupBy(block_of(seq).alias("block")).agg(F.count(F.lit(1)).alias("n"), size).orderBy("block").collect()
    offsets, before = [], 0
    for r in found:
        if r["n"] != r["size"]:
            return None
        offsets.append((r["block"], before))
        before += r["n"]
    return df.sparkSession.createDataFrame(offsets, "_block bigint, _offset bigint")


def with_row_index(df: DataFrame, seq: str = SEQ, name: str = "row_index") -> DataFrame:
    """Zero-based position of every row in the total order.

    In a whole ordered table it is the offset of the row's block plus the row's place in it, which ``seq`` holds: no row
    moves. Where rows have been filtered out, positions are counted along the blocks.
    """
    offsets = _block_offsets(df, seq)
    if offsets is None:
        return blockwise(df, [], {name: ("sum", F.lit(1).cast("bigint"))}, seq)
    placed = df.withColumn("_block", block_of(seq)).join(F.broadcast(offsets), "_block")
    return placed.select(*df.columns, (F.col("_offset") + row_in_block(seq)).alias(name))


def value_counts_running(df: DataFrame, value: str, sums: dict[str, Column]) -> DataFrame:
    """One row per distinct value with its ``sums`` and ``before_<name>``, the total
    over all smaller values. Pre-aggregated, so frequent values cost nothing."""
    grouped = df.groupBy(value).agg(*[F.sum(expr).alias(name) for name, expr in sums.items()])
    table = ordered_table(grouped, value, seq="_vseq")
    bases = {f"before_{name}": ("sum", F.col(name)) for name in sums}
    return blockwise(table, [], bases, "_vseq").drop("_vseq")


def _spread_parts(df: DataFrame, parts: int) -> Column:
    """A part of each row that depends on the row alone: its block, or a hash of its plain columns."""
    if SEQ in df.columns:
        return block_of()
    plain = [F.col(f"`{f.name}`") for f in df.schema if isinstance(f.dataType, T.AtomicType)]
    return F.pmod(F.xxhash64(*plain), F.lit(parts))


def spread_join(df: DataFrame, table: DataFrame, key: str, how: str = "left", parts: int = 64) -> DataFrame:
    """Join ``df`` with ``table`` (one row per key) so that no key of ``df`` lands in one task, however frequent.

    The distinct (key, part) pairs of ``df`` are joined first: as many as a key has parts. The rows then meet
    their pair by key and part. ``how`` is left, left_semi or left_anti. A null key meets nothing.
    """
    rows = df.withColumn("_part", _spread_parts(df, parts))
    pairs = rows.select(F.col(key).alias("_pair_key"), F.col("_part").alias("_pair_part")).distinct()
    found = pairs.join(table.withColumnRenamed(key, "_table_key"), F.col("_pair_key") == F.col("_table_key")).drop("_table_key")
    on = (F.col(key) == F.col("_pair_key")) & (F.col("_part") == F.col("_pair_part"))
    joined = rows.join(found, on, how)
    added = [c for c in table.columns if c != key] if how == "left" else []
    return joined.select(*df.columns, *added)
