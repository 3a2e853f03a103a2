"""SimHash near-duplicates by deletion-variant signatures.

A text's fingerprint has 64 bits: a bit is 1 if it is set in more than half of the hashes
of the text's word shingles. Two fingerprints link at ``distance`` or fewer differing bits. Cut
into ``distance // 2 + 1`` segments, two linked fingerprints differ by at most one bit in one of
them; so each fingerprint is indexed under every segment with every single bit of it as a
wildcard, equal signatures meet in one bucket, and all 64 bits are verified there.

A bucket gives the edges of a spanning forest of its links, never all its pairs: found by
breadth-first search over the members not yet reached, in a few steps where copies are
dense. Long buckets are first cut by the rest of the bits (pieces of which one must be equal); those beyond
``bucket_rows`` are dealt in pairs of blocks to further tasks. Nothing is left out.

Null and empty texts have no shingles and the fingerprint 0, linked like any other; texts with
fewer words than a shingle have one. Repeated rows stay rows. A null doc_id is a row without
influence on the component ids; an empty table gives no rows. Other columns are dropped.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from txnrisk.llm.common import slices, utf8
from txnrisk.llm.components import components
from txnrisk.sources.scratch import materialise

BITS = 64
_BYTE_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.float32)
_LANES = np.arange(8, dtype=np.int64) * 256


def fingerprint(text: bytes, shingle: int = 4, seed: int = 42) -> int:
    from xxhash import xxh64_intdigest

    words = text.lower().split()  # of bytes: A-Z only, and exactly the ASCII white space
    if not words:
        return 0
    joined = b" ".join(words)
    stops = np.cumsum([len(w) + 1 for w in words]) - 1
    n = max(1, len(words) - shingle + 1)
    starts = np.concatenate([[0], stops[:-1] + 1])[:n].tolist()
    stops = stops[-n:].tolist() if len(words) > shingle else [len(joined)]
    hashes = np.array([xxh64_intdigest(joined[a:b], seed) for a, b in zip(starts, stops, strict=True)], np.uint64)
    lanes = hashes.view(np.uint8).reshape(-1, 8) + _LANES
    counts = np.bincount(lanes.ravel(), minlength=2048).reshape(8, 256).astype(np.float64) @ _BYTE_BITS
    bits = (2 * counts.ravel() > len(hashes)).astype(np.uint8)
    return int(np.packbits(bits, bitorder="little").view(np.uint64)[0])


def with_fingerprints(docs: DataFrame, shingle: int = 4, seed: int = 42) -> DataFrame:
    """(doc_id, fp): the fingerprint of every text as a signed long."""
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), utf8("text").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in slices(batches, "text"):
            fps = np.array([fingerprint(t, shingle, seed) for t in texts], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps)], names=["doc_id", "fp"])

    return rows.mapInArrow(run, "doc_id bigint, fp bigint")


def segments(distance: int) -> list[tuple[int, int]]:
    """(first bit, bits) of each segment."""
    n = distance // 2 + 1
    cuts = [round(i * BITS / n) for i in range(n + 1)]
    return [(a, b - a) for a, b in zip(cuts, cuts[1:], strict=False)]


def _mixed(x: np.ndarray) -> np.ndarray:
    """A one-to-one scramble of 64 bits, so that signatures spread evenly over partitions."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def signatures(fps: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """(signature, fingerprint) of all one-wildcard segment variants."""
    out = []
    for first, bits in segments(distance):
        segment = (fps >> np.uint64(first)) & np.uint64((1 << bits) - 1)
        for at in range(bits):
            masked = segment & ~np.uint64(1 << at)
            out.append(_mixed(masked | np.uint64((first + at) << 44)) if bits <= 44 else _mixed(masked ^ np.uint64(first + at + 1)))
    return np.concatenate(out), np.tile(fps, len(out))


def _forest(fps: np.ndarray, distance: int) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Edges (child, parent) of a spanning forest of the links among distinct ``fps``."""
    children, parents, rest = [], [], fps
    while len(rest) > 1:
        queue, rest = [rest[:1]], rest[1:]
        while queue and len(rest):
            for node in queue.pop():
                near = np.bitwise_count(rest ^ node) <= distance
                if near.any():
                    found = rest[near]
                    children.append(found)
                    parents.append(np.full(len(found), node))
                    queue.append(found)
                    rest = rest[~near]
                if not len(rest):
                    break
    return children, parents


def _forest_cut(fps: np.ndarray, distance: int) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """As ``_forest``, by way of pieces of bits of which a linked pair shares at least one."""
    n = distance + 1
    cuts = [i * BITS // n for i in range(n + 1)]
    children, parents = [], []
    for a, b in zip(cuts, cuts[1:], strict=False):
        piece = (fps >> np.uint64(a)) & np.uint64((1 << (b - a)) - 1)
        order = np.argsort(piece, kind="stable")
        edges = np.flatnonzero(np.diff(piece[order])) + 1
        for part in np.split(fps[order], edges):
            if len(part) > 1:
                c, p = _forest(part, distance)
                children += c
                parents += p
    return children, parents


def links_of_sorted(keys: np.ndarray, fps: np.ndarray, distance: int, short: int = 16) -> tuple[np.ndarray, np.ndarray]:
    """Links (u, v) that keep each bucket's connections; ``keys`` are sorted, buckets whole."""
    if len(keys) < 2:
        return fps[:0], fps[:0]
    edges = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1], [True]]))
    sizes = np.diff(edges)
    us, vs = [], []
    few = np.repeat(sizes <= short, sizes)
    for lag in range(1, min(short, int(sizes.max()))):
        both = few[lag:] & (keys[lag:] == keys[:-lag])
        at = np.flatnonzero(both)
        at = at[np.bitwise_count(fps[at] ^ fps[at + lag]) <= distance]
        us.append(fps[at])
        vs.append(fps[at + lag])
    for i in np.flatnonzero(sizes > short):
        bucket = np.unique(fps[edges[i] : edges[i + 1]])
        c, p = (_forest_cut if len(bucket) > 2048 else _forest)(bucket, distance)
        us += c
        vs += p
    if not us:
        return fps[:0], fps[:0]
    u, v = np.concatenate(us), np.concatenate(vs)
    u, v = np.maximum(u, v), np.minimum(u, v)
    keep = np.unique(np.stack([u, v], axis=1)[u != v], axis=0)
    return keep[:, 0], keep[:, 1]


_LINKS = "u bigint, v bigint, key bigint"


def _links(u: np.ndarray, v: np.ndarray, key: np.ndarray | None = None) -> pa.RecordBatch:
    """Links, or with ``key`` members of a bucket that is left to further tasks."""
    return pa.RecordBatch.from_arrays(
        [pa.array(u.view(np.int64)), pa.array(v.view(np.int64)), pa.array(key.view(np.int64)) if key is not None else pa.nulls(len(u), pa.int64())],
        names=["u", "v", "key"],
    )


def links(fps: DataFrame, distance: int = 4, bucket_rows: int = 100_000) -> DataFrame:
    """(u, v): links among the distinct fingerprints ``fps`` (fp) that connect whatever all links
    connect."""

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            for i in range(0, len(values), 4096):
                keys, members = signatures(values[i : i + 4096], distance)
                yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(members.view(np.int64))], names=["key", "fp"])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, members = np.zeros(0, np.uint64), np.zeros(0, np.uint64)
        giving = None  # the key of a bucket that is too long for this task
        for batch in batches:
            k, f = (batch.column(i).to_numpy(zero_copy_only=False).view(np.uint64) for i in (0, 1))
            if giving is not None:
                same = k == giving
                if same.any():
                    yield _links(f[same], f[same], k[same])
                    k, f = k[~same], f[~same]
                if not len(k):
                    continue
                giving = None
            keys, members = np.concatenate([keys, k]), np.concatenate([members, f])
            first = np.searchsorted(keys.view(np.int64), keys.view(np.int64)[-1])
            if len(keys) - first > bucket_rows:
                giving = keys[-1]
                yield _links(members[first:], members[first:], keys[first:])
                yield from _found(keys[:first], members[:first])
                keys, members = keys[:0], members[:0]
            elif first > 200_000:
                yield from _found(keys[:first], members[:first])
                keys, members = keys[first:], members[first:]
        yield from _found(keys, members)

    def _found(keys: np.ndarray, members: np.ndarray) -> Iterator[pa.RecordBatch]:
        u, v = links_of_sorted(keys, members, distance)
        if len(u):
            yield _links(u, v)

    def pair(block: pd.DataFrame) -> pd.DataFrame:
        c, p = _forest_cut(np.unique(block["fp"].to_numpy().view(np.uint64)), distance)
        if not c:
            return pd.DataFrame({"u": [], "v": []})
        return pd.DataFrame({"u": np.concatenate(c).view(np.int64), "v": np.concatenate(p).view(np.int64)})

    signed = fps.select("fp").mapInArrow(index, "key bigint, fp bigint")
    met = materialise(signed.repartition("key").sortWithinPartitions("key").mapInArrow(meet, _LINKS), "links")
    found = met.filter("key is null").select("u", "v")
    left = met.filter("key is not null").select("key", F.col("u").alias("fp"))
    blocks = left.groupBy("key").agg(F.ceil(F.count(F.lit(1)) / bucket_rows).cast("int").alias("blocks"))
    own = left.join(blocks, "key").withColumn("own", F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int"))
    paired = own.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(
        "key", F.least("own", "other").alias("a"), F.greatest("own", "other").alias("b"), "fp"
    )
    more = paired.groupBy("key", "a", "b").applyInPandas(pair, "u bigint, v bigint")
    return found.unionAll(more).distinct()


def near_duplicates(docs: DataFrame, distance: int = 4, shingle: int = 4, seed: int = 42) -> DataFrame:
    """(doc_id, fp, component_id): component_id is the smallest doc_id that links reach."""
    prints = materialise(with_fingerprints(docs, shingle, seed), "fingerprints")
    least = materialise(prints.groupBy("fp").agg(F.min("doc_id").alias("node")), "nodes")
    found = links(least, distance)
    node_u = least.select(F.col("fp").alias("u"), F.col("node").alias("node_u"))
    node_v = least.select(F.col("fp").alias("v"), F.col("node").alias("node_v"))
    edges = found.join(node_u, "u").join(node_v, "v").select(F.col("node_u").alias("u"), F.col("node_v").alias("v"))
    reached = components(edges)
    classes = least.join(reached, "node", "left").select("fp", F.coalesce("component", "node").alias("component_id"))
    return prints.join(classes, "fp").select("doc_id", "fp", "component_id")


def hexadecimal(fp: str = "fp"):
    """16 lowercase hex digits of a signed long."""
    return F.lower(F.lpad(F.hex(F.col(fp)), 16, "0"))


def keep_one(docs: DataFrame, broadcast_ids: int = 1_000_000, **how) -> DataFrame:
    """One document of each group: the one with the smallest doc_id. Documents without doc_id stay; of rows that
    repeat doc_id and text one stays, rows that share a doc_id with different texts all do.

    The ids that go, and those that repeat, are the table joined with the texts: up to ``broadcast_ids`` of them
    (16 bytes each) are broadcast, so that no text is shuffled; more are joined by a shuffle, with the same result."""
    found = near_duplicates(docs, **how).filter("doc_id is not null")
    stays = F.sum(F.when(F.col("doc_id") == F.col("component_id"), 1).otherwise(0))
    ids = found.groupBy(F.col("doc_id").alias("_marked")).agg(stays.alias("_n"))
    marked = materialise(ids.filter("_n <> 1"), "marked")
    several = marked.filter("_n > 1")

    def sized(ids: DataFrame) -> DataFrame:
        return F.broadcast(ids) if ids.count() <= broadcast_ids else ids

    rows = docs.select(F.struct("*").alias("_row")).withColumn("_id", F.col("_row.doc_id").cast("bigint"))
    # a doc_id that is no number has no id either
    kept = rows.filter("_id is not null").join(sized(marked.select("_marked")), F.col("_id") == F.col("_marked"), "left_anti")
    kept = kept.select("_row.*").unionAll(rows.filter("_id is null").select("_row.*"))
    if several.isEmpty():
        return kept
    repeated = rows.join(sized(several.select("_marked")), F.col("_id") == F.col("_marked")).withColumn("_text", F.col("_row.text"))
    return kept.unionAll(repeated.dropDuplicates(["_id", "_text"]).select("_row.*"))
