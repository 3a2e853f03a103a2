"""Language-model scores from an Elias-Fano n-gram trie that lies in memory-mapped files.

Level 1 has the distinct words, as ascending 64-bit hashes in Elias-Fano form with their exact counts and, for each
as a context, the share of mass that it leaves to lower orders. A word's rank is its place in the level. Level 2
has the words seen after each context: monotone pointers delimit a context's run, in which the following words' ranks
ascend; context and rank together make one monotone sequence, and a word is found by successor search
relative to its context. Probabilities are quantised to 16 bits.

    P(w | u) = max(c(u w) - D, 0) / c(u) + D * distinct(u) / c(u) * P(w),    P(w) = (c(w) + a) / (N + a (V + 1))

Counting: tasks reduce their texts to distinct words, or pairs of ranks, and hand on sorted runs, packed, by
shard; a shard's runs are merged by one task, which writes its part of the level. Words are dealt to shards by
hash; pairs by the context's shard and also by ``PARTS`` classes of the following word, which splits frequent
contexts. Scoring tasks map the files; no task, and not the driver, ever holds a level.

The files lie in the shared folder. Each appears when complete, and a repeated task writes it again. Words are the runs
between ASCII white space with A-Z in lower case; every text ends with an end token, which is also the context of its
first word. Words whose 64-bit hashes are equal count as one. Null and empty texts have the end token only;
without training rows everything is unknown. Repeated rows count and score each; an empty table gives no rows.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from txnrisk.llm.common import AtomicFile, fresh_folder, opened, slices, spread, utf8
from txnrisk.llm.eliasfano import EliasFano
from txnrisk.sources.scratch import materialise

PARTS = 4
SMOOTH, DISCOUNT = 0.1, 0.75
SLICE = 8 << 20
#: Entries that a counting task holds before it hands them on.
HELD = 2_000_000
#: Quantisation: log10 probabilities in steps of 1 / STEPS, down to -65534 / STEPS.
STEPS = 4096

RUNS = "shard int, part int, data binary"


# ------------------------------------------------------------------ files
def save(path: str, meta: dict, arrays: dict[str, np.ndarray]) -> None:
    out = AtomicFile(path)
    places, at = {}, 0
    for name, x in arrays.items():
        x = np.ascontiguousarray(x)
        places[name] = (x.dtype.str, len(x), at)
        pad = -x.nbytes % 64
        at += x.nbytes + pad
        out.write(x.tobytes() + b"\0" * pad)
    tail = json.dumps({"meta": meta, "arrays": places}).encode()
    out.write(tail + len(tail).to_bytes(8, "little"))
    out.commit()


def load(path: str) -> tuple[dict, dict[str, np.ndarray]]:
    """Arrays of a saved file: mapped where the file is on a mounted file system, else read."""
    fs, inner = opened(path)
    if type(fs).__name__ == "LocalFileSystem":
        raw = np.asarray(np.memmap(inner, np.uint8, "r"))  # plain arrays: a memmap costs time at every index
    else:
        with fs.open_input_file(inner) as source:
            raw = np.frombuffer(source.read(), np.uint8)
    n = int.from_bytes(raw[-8:].tobytes(), "little")
    tail = json.loads(raw[-8 - n : -8].tobytes())
    arrays = {k: raw[at : at + length * np.dtype(kind).itemsize].view(kind) for k, (kind, length, at) in tail["arrays"].items()}
    return tail["meta"], arrays


def _sequence(prefix: str, ef: EliasFano) -> tuple[dict, dict]:
    return {f"{prefix}_n": ef.n, f"{prefix}_bits": ef.bits}, {f"{prefix}_{f}": getattr(ef, f) for f in EliasFano.FIELDS}


def _restored(prefix: str, meta: dict, arrays: dict) -> EliasFano:
    return EliasFano(meta[f"{prefix}_n"], meta[f"{prefix}_bits"], *[arrays[f"{prefix}_{f}"] for f in EliasFano.FIELDS])


def quantised(p: np.ndarray) -> np.ndarray:
    return np.clip(np.round(-np.log10(np.maximum(p, 1e-300)) * STEPS), 0, 65535).astype(np.uint16)


def dequantised(q: np.ndarray) -> np.ndarray:
    return np.where(q == 65535, 0.0, 10.0 ** (-q.astype(np.float64) / STEPS))


# ------------------------------------------------------------------ words
def hashes(words: list[bytes]) -> np.ndarray:
    from xxhash import xxh64_intdigest

    return np.fromiter(map(xxh64_intdigest, words), np.uint64, len(words))


def cut(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place of each token among the distinct ones, hashes of these, tokens per text)."""
    tokens = [t.lower().split() for t in texts]
    for t in tokens:
        t.append(b"")  # the end token
    counts = np.array([len(t) for t in tokens], np.int64)
    flat = np.empty(counts.sum(), object)
    flat[:] = list(chain.from_iterable(tokens))
    codes, distinct = pd.factorize(flat)
    return codes, hashes(distinct), counts


def summed(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys ascending with their summed counts."""
    key, count = np.concatenate(keys), np.concatenate(counts)
    order = np.argsort(key, kind="stable")
    key, count = key[order], count[order]
    heads = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
    return key[heads], np.add.reduceat(count, heads) if len(heads) else count


def pack_run(keys: np.ndarray, counts: np.ndarray) -> bytes:
    """A sorted run as byte planes of its differences, compressed."""
    import zstandard

    planes = np.diff(keys, prepend=np.uint64(0)).view(np.uint8).reshape(-1, 8).T
    data = len(keys).to_bytes(8, "little") + planes.tobytes() + counts.astype("<u8").view(np.uint8).reshape(-1, 8).T.tobytes()
    return zstandard.ZstdCompressor(level=1).compress(data)


def unpack_run(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    import zstandard

    raw = zstandard.ZstdDecompressor().decompress(data)
    n = int.from_bytes(raw[:8], "little")
    planes = np.frombuffer(raw, np.uint8, offset=8).reshape(2, 8, n)
    keys, counts = (np.ascontiguousarray(p.T).view(np.uint64).ravel() for p in planes)
    return np.cumsum(keys, dtype=np.uint64), counts.astype(np.int64)


class Runs:
    """Collects keys and counts, and hands them on as packed runs by shard and part."""

    def __init__(self, cell):
        self.cell = cell  # keys -> shard and part of each
        self.keys: list[np.ndarray] = []
        self.counts: list[np.ndarray] = []
        self.held = 0

    def add(self, keys: np.ndarray, counts: np.ndarray) -> Iterator[pa.RecordBatch]:
        self.keys.append(keys)
        self.counts.append(counts)
        self.held += len(keys)
        if self.held > HELD:
            key, count = summed(self.keys, self.counts)
            self.keys, self.counts, self.held = [key], [count], len(key)
            if len(key) > HELD // 2:
                yield from self.flush()

    def flush(self) -> Iterator[pa.RecordBatch]:
        if not self.keys:
            return
        key, count = summed(self.keys, self.counts)
        self.keys, self.counts, self.held = [], [], 0
        shard, part = self.cell(key)
        cell = shard * PARTS + part
        order = np.argsort(cell, kind="stable")
        edges = np.flatnonzero(np.diff(cell[order])) + 1
        for at in np.split(order, edges):
            if len(at):
                yield pa.RecordBatch.from_pydict(
                    {"shard": pa.array([shard[at[0]]], pa.int32()), "part": pa.array([part[at[0]]], pa.int32()), "data": [pack_run(key[at], count[at])]}
                )


# ------------------------------------------------------------------ the model
class Model:
    """The levels' files, opened when first used."""

    def __init__(self, folder: str, bits: int, sizes: list[int], total: int):
        self.folder, self.bits, self.sizes, self.total = folder, bits, sizes, total
        self.base = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
        self.distinct = int(self.base[-1])
        self.files: dict[str, tuple[dict, dict]] = {}

    def __getstate__(self):
        return {**self.__dict__, "files": {}}

    def file(self, name: str) -> tuple[dict, dict]:
        if name not in self.files:
            self.files[name] = load(f"{self.folder}/{name}")
        return self.files[name]

    def shard_of(self, hash_: np.ndarray) -> np.ndarray:
        return (hash_ >> np.uint64(64 - self.bits)).astype(np.int64) if self.bits else np.zeros(len(hash_), np.int64)

    def ranks(self, hash_: np.ndarray) -> np.ndarray:
        """Rank of each word, or -1."""
        out = np.full(len(hash_), -1, np.int64)
        shard = self.shard_of(hash_)
        rest = hash_ & np.uint64((1 << (64 - self.bits)) - 1)
        for s in np.unique(shard):
            if self.sizes[s]:
                at = np.flatnonzero(shard == s)
                found = _restored("words", *self.file(f"words-{s}")).find(rest[at])
                out[at] = np.where(found >= 0, found + self.base[s], -1)
        return out

    def _per_word(self, ranks: np.ndarray, file: str, array: str) -> np.ndarray:
        out = np.zeros(len(ranks), np.int64)
        shard = np.searchsorted(self.base, ranks, side="right") - 1
        for s in np.unique(shard[ranks >= 0]):
            at = np.flatnonzero((shard == s) & (ranks >= 0))
            out[at] = self.file(f"{file}-{s}")[1][array][ranks[at] - self.base[s]]
        return out

    def counts(self, ranks: np.ndarray) -> np.ndarray:
        return self._per_word(ranks, "words", "count")

    def left_over(self, ranks: np.ndarray) -> np.ndarray:
        """Share of mass that each context leaves to the words' own probabilities."""
        out = dequantised(self._per_word(ranks, "left", "q").astype(np.uint16))
        return np.where(ranks >= 0, out, 1.0)

    def base_p(self, counts: np.ndarray) -> np.ndarray:
        return (counts + SMOOTH) / (self.total + SMOOTH * (self.distinct + 1))

    def following(self, context: np.ndarray, word: np.ndarray) -> np.ndarray:
        """Discounted share of each word among those after its context; 0 if never seen."""
        out = np.zeros(len(context))
        seen = np.flatnonzero((context >= 0) & (word >= 0))
        shard = np.searchsorted(self.base, context[seen], side="right") - 1
        cell = shard * PARTS + word[seen] % PARTS
        order = np.argsort(cell, kind="stable")
        for at in np.split(order, np.flatnonzero(np.diff(cell[order])) + 1):
            if not len(at):
                continue
            s, part = divmod(int(cell[at[0]]), PARTS)
            pairs = self.file(f"pairs-{s}-{part}")
            if not pairs[0]["pairs_n"]:
                continue
            i = seen[at]
            local = context[i] - self.base[s]
            pointers = _restored("pointers", *pairs)
            # pairs come by context: each is looked up once
            heads = np.concatenate([[True], local[1:] != local[:-1]])
            once, nth = local[heads], np.cumsum(heads) - 1
            first, last = (pointers.access(x).astype(np.int64)[nth] for x in (once, once + 1))
            key = local.astype(np.uint64) * np.uint64(self.distinct) + word[i].astype(np.uint64)
            found = _restored("pairs", *pairs).find(key, first, last)
            hit = found >= 0
            out[i[hit]] = dequantised(pairs[1]["q"][found[hit]])
        return out


def train(docs: DataFrame, where: Column | None = None, folder: str | None = None) -> Model:
    """A model of the rows of ``docs`` (text) with ``where``."""
    spark = docs.sparkSession
    folder = folder or fresh_folder(spark, "lm")
    rows = (docs.filter(where) if where is not None else docs).select(utf8("text").alias("text"))
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    bits = max(0, (tasks // PARTS).bit_length() - 1)
    model = _words(spark, rows, folder, bits)
    _pairs(spark, rows, model)
    return model


def _words(spark: SparkSession, rows: DataFrame, folder: str, bits: int) -> Model:
    shards = 1 << bits

    def cell(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        shard = (keys >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(keys), np.int64)
        return shard, np.zeros(len(keys), np.int64)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs = Runs(cell)
        for _, texts in slices(batches, "text", SLICE):
            codes, distinct, _ = cut(texts)
            yield from runs.add(distinct, np.bincount(codes, minlength=len(distinct)).astype(np.int64))
        yield from runs.flush()

    def merge(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        s = int(key[0])
        keys, counts = summed(*map(list, zip(*map(unpack_run, group["data"]), strict=True)))
        meta, arrays = _sequence("words", EliasFano.of(keys & np.uint64((1 << (64 - bits)) - 1), 1 << (64 - bits)))
        narrow = np.uint32 if counts.max(initial=0) < 1 << 32 else np.uint64
        save(f"{folder}/words-{s}", meta, arrays | {"count": counts.astype(narrow)})
        return pd.DataFrame({"shard": [s], "n": [len(keys)], "total": [int(counts.sum())]})

    runs = rows.mapInArrow(count, RUNS)
    made = materialise(runs.groupBy("shard").applyInPandas(merge, "shard int, n bigint, total bigint"), "words")
    sizes, total = [0] * shards, 0
    for r in made.collect():  # one row per shard
        sizes[r["shard"]] = r["n"]
        total += r["total"]
    return Model(folder, bits, sizes, total)


def _pairs(spark: SparkSession, rows: DataFrame, model: Model) -> None:
    def cell(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        context, word = (keys >> np.uint64(32)).astype(np.int64), (keys & np.uint64(0xFFFFFFFF)).astype(np.int64)
        return np.searchsorted(model.base, context, side="right") - 1, word % PARTS

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs = Runs(cell)
        for _, texts in slices(batches, "text", SLICE):
            codes, distinct, counts = cut(texts)
            ranks = model.ranks(distinct).astype(np.uint64)[codes]
            ends = np.cumsum(counts) - 1
            context = np.empty_like(ranks)
            context[1:] = ranks[:-1]
            context[np.concatenate([[0], ends[:-1] + 1])] = ranks[ends[0]]  # a text begins after an end
            keys, times = np.unique((context << np.uint64(32)) | ranks, return_counts=True)
            yield from runs.add(keys, times)
        yield from runs.flush()

    def merge(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        s, part = map(int, key)
        keys, counts = summed(*map(list, zip(*map(unpack_run, (d for d in group["data"] if d is not None)), strict=True))) if group["data"].notna().any() else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
        local = (keys >> np.uint64(32)).astype(np.int64) - model.base[s]
        seen = model.file(f"words-{s}")[1]["count"] if model.sizes[s] else np.zeros(0, np.uint32)
        values = local.astype(np.uint64) * np.uint64(model.distinct) + (keys & np.uint64(0xFFFFFFFF))
        pairs = _sequence("pairs", EliasFano.of(values, max(1, model.sizes[s] * model.distinct)))
        successors = np.bincount(local, minlength=model.sizes[s]).astype(np.int64)
        pointers = _sequence("pointers", EliasFano.of(np.concatenate([[0], np.cumsum(successors)]), len(keys) + 1))
        share = (counts - DISCOUNT) / np.maximum(1, seen[local].astype(np.int64))
        save(f"{model.folder}/pairs-{s}-{part}", pairs[0] | pointers[0], pairs[1] | pointers[1] | {"q": quantised(share)})
        return pd.DataFrame({"shard": [s], "part": [part], "n": [len(keys)]})

    def leave(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for s in batch.column(0).to_pylist():
                if model.sizes[s]:
                    successors = np.zeros(model.sizes[s], np.int64)
                    for part in range(PARTS):
                        pointers = _restored("pointers", *model.file(f"pairs-{s}-{part}"))
                        for a in range(0, model.sizes[s], 1 << 18):
                            at = np.arange(a, min(a + (1 << 18), model.sizes[s]) + 1)
                            successors[at[:-1]] += np.diff(pointers.access(at).astype(np.int64))
                    seen = model.file(f"words-{s}")[1]["count"].astype(np.int64)
                    share = np.where(successors > 0, DISCOUNT * successors / np.maximum(1, seen), 1.0)
                    save(f"{model.folder}/left-{s}", {}, {"q": quantised(share)})
            yield pa.RecordBatch.from_pydict({"shard": batch.column(0)})

    shards = spark.range(len(model.sizes)).select(F.col("id").cast("int").alias("shard"))
    every = shards.select("shard", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))).alias("part"), F.lit(None).cast("binary").alias("data"))
    runs = rows.mapInArrow(count, RUNS).unionAll(every)  # so that a part without pairs has its file as well
    materialise(runs.groupBy("shard", "part").applyInPandas(merge, "shard int, part int, n bigint"), "pairs")
    materialise(spread(shards, "shard").mapInArrow(leave, "shard int"), "left")


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, n_tokens, n_known, train_tokens, base_score, score) of every text."""
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), utf8("text").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in slices(batches, "text", SLICE):
            codes, distinct, counts = cut(texts)
            ranks = model.ranks(distinct)
            seen = model.counts(ranks)
            p = model.base_p(seen)
            text = np.repeat(np.arange(len(texts)), counts)
            base = np.bincount(text, np.log10(p)[codes], len(texts))
            known = np.bincount(text, (seen > 0)[codes], len(texts))
            ends = np.cumsum(counts) - 1
            before = np.empty_like(codes)
            before[1:] = codes[:-1]
            before[np.concatenate([[0], ends[:-1] + 1])] = codes[ends[0]]
            pair, back = np.unique(before.astype(np.int64) << 32 | codes, return_inverse=True)
            context, word = pair >> 32, pair & 0xFFFFFFFF
            follow = model.following(ranks[context], ranks[word])
            logs = np.log10(follow + model.left_over(ranks)[context] * p[word])
            score = np.bincount(text, logs[back.ravel()], len(texts))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(counts, pa.int64()), pa.array(known.astype(np.int64)),
                 pa.array(np.full(len(texts), model.total, np.int64)), pa.array(base), pa.array(score)],
                names=["doc_id", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
            )

    return rows.mapInArrow(run, "doc_id bigint, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double")
