"""Token output: texts to ids with a public tokenizer, written as shards of patched
frame-of-reference blocks, and read back.

Texts are range-partitioned on the order columns and sorted inside the partitions; each
partition becomes one shard, so shards follow each other in the total order and a document's
position is *ids of the shards before* plus *ids before it in its shard*. A shard appears only when
it is complete; a repeated task writes the same bytes again under the same name.

Null texts have no ids but the end id. A null doc_id counts as -1 in the files and is sorted first. Repeated
rows are all kept, in the order of their texts. An empty table gives no shards and no rows.
"""

from __future__ import annotations

import gc
import re
import zlib
from collections.abc import Iterator
from contextlib import contextmanager
from itertools import chain, compress, repeat

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from txnrisk.llm import pfor
from txnrisk.llm.common import AtomicFile, fresh_folder, keep_only, kept, opened, release, slices, spread, utf8
from txnrisk.sources.scratch import materialise

MANIFEST = "shard int, path string, n_docs bigint, n_ids bigint"
READ = "doc_id bigint, shard int, nth int, offset bigint, n_tokens bigint, ids_crc32 bigint"
#: Distinct chunks of text whose ids a task remembers.
REMEMBERED = 300_000
#: Plain words that go through the tokenizer together: it needs some 200 bytes a letter for them.
TOGETHER = 8192
#: Bytes of text that a task cuts into chunks at a time.
SLICE = 2 << 20


def _tokenizer(path: str):
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs one task per core
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


@contextmanager
def _uncollected() -> Iterator[None]:
    """No garbage collection: millions of small objects without cycles would be walked again and again."""
    enabled = gc.isenabled()
    gc.disable()
    try:
        yield
    finally:
        if enabled:
            gc.enable()


class Encoder:
    """Ids of texts under a tokenizer whose words never reach across ASCII white space, that
    ignores case and white space, and that ends each word with a piece ``...</w>``. Plain letters are a-z and the small
    letters of Latin-1.

    Texts are cut at ASCII white space, where the tokenizer cuts them anyway, and each distinct
    chunk is encoded once. Letters before ASCII punctuation are a word of their own: such plain
    words go through the tokenizer together, told apart by their last piece, and all other
    chunks one by one. A full encoder forgets all but the chunks that were used most often.
    """

    #: The plain word and the punctuation of each chunk of a joined list, nothing where a chunk isn't of this form.
    PARTS = re.compile(rb"((?:[a-z]|\xc3[\x9f-\xb6\xb8-\xbf])++)([.,!$%&*#|]*+)(?!\S)|\S+")

    def __init__(self, path: str, remember: int = REMEMBERED):
        self.tokenizer = _tokenizer(path)
        self.remember = remember
        vocab = self.tokenizer.get_vocab(with_added_tokens=True)
        self.ends = np.zeros(max(vocab.values()) + 1, bool)
        self.ends[[i for token, i in vocab.items() if token.endswith("</w>")]] = True
        self.known: dict[bytes, int] = {}
        self.starts = np.zeros(1, np.int64)  # of the known chunks in flat, and its end
        self.flat = np.zeros(0, np.uint32)
        self.uses = np.zeros(0, np.int32)  # calls that met a known chunk, halved whenever some are forgotten

    def _forget(self) -> None:
        """Keep the chunks of the most calls, of two at least, at most half as many as are remembered."""
        most = np.bincount(np.minimum(self.uses, 1 << 16), minlength=3)[::-1].cumsum()[::-1]  # chunks by least uses
        least = 2 + int(np.count_nonzero(most[2:] > self.remember // 2))
        kept = np.flatnonzero(self.uses >= least)
        names = list(self.known)
        flat, lengths = self._gather(kept)
        self.known = dict(zip(map(names.__getitem__, kept.tolist()), range(len(kept))))
        self.starts = np.concatenate([[0], np.cumsum(lengths)])
        self.flat, self.uses = flat, self.uses[kept] // 2

    def _keep(self, names: list[bytes], ids: np.ndarray, lengths: np.ndarray) -> None:
        first = len(self.known)
        self.known.update(zip(names, range(first, first + len(names)), strict=True))
        self.starts = np.concatenate([self.starts, self.starts[-1] + np.cumsum(lengths)])
        self.flat = np.concatenate([self.flat, ids])
        self.uses = np.concatenate([self.uses, np.zeros(len(names), np.int32)])

    def _used(self, place: np.ndarray) -> None:
        met = np.zeros(len(self.uses), bool)
        met[place] = True
        self.uses += met

    def _places(self, chunks: list[bytes]) -> tuple[np.ndarray, list[bytes]]:
        """The number of each chunk, -1 if it isn't known, and these chunks."""
        place = np.fromiter(map(self.known.get, chunks, repeat(-1)), np.int64, len(chunks))
        return place, list(dict.fromkeys(compress(chunks, (place < 0).tolist())))

    def _learn(self, chunks: list[bytes]) -> None:
        """Chunks that aren't known yet."""
        known, words, tailed, other = self.known, set(), [], []
        for chunk, (word, tail) in zip(chunks, self.PARTS.findall(b" ".join(chunks)), strict=True):
            if not word:
                other.append(chunk)
                continue
            if word not in known:
                words.add(word)
            if tail:
                tailed.append((chunk, word, tail))
        other += {tail for _, _, tail in tailed if tail not in known}
        plain, found = list(words), []
        for at in range(0, len(plain), TOGETHER):
            text = b" ".join(plain[at : at + TOGETHER]).decode()
            found.append(np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.uint32))
        if plain:
            ids = np.concatenate(found)
            stops = np.flatnonzero(self.ends[ids]) + 1
            if len(stops) != len(plain):
                raise ValueError("this tokenizer doesn't encode plain words one by one")
            self._keep(plain, ids, np.diff(stops, prepend=0))
        if other := list(dict.fromkeys(other)):
            found = [e.ids for e in self.tokenizer.encode_batch_fast([c.decode("utf-8", "replace") for c in other], add_special_tokens=False)]
            self._keep(other, np.fromiter(chain.from_iterable(found), np.uint32), np.array([len(f) for f in found], np.int64))
        if tailed:
            place = np.array([(known[word], known[tail]) for _, word, tail in tailed]).ravel()
            self._used(place)
            ids, lengths = self._gather(place)
            self._keep([chunk for chunk, _, _ in tailed], ids, lengths.reshape(-1, 2).sum(axis=1))

    def _gather(self, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        starts = self.starts[place]
        lengths = self.starts[place + 1] - starts
        stops = np.cumsum(lengths)
        return self.flat[np.repeat(starts - stops + lengths, lengths) + np.arange(stops[-1] if len(stops) else 0)], lengths

    @_uncollected()
    def encode(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """All ids one after the other, and the number of ids of each text."""
        cut = [(t if b"<|" in t else t.lower()).split() for t in texts]
        counts = np.array([len(c) for c in cut], np.int64)
        chunks = list(chain.from_iterable(cut))
        del cut
        place, new = self._places(chunks)
        if len(self.known) + len(new) > self.remember:
            self._forget()
            place, new = self._places(chunks)
        if new:
            self._learn(new)
            missing = place < 0
            found = map(self.known.__getitem__, compress(chunks, missing.tolist()))
            place[missing] = np.fromiter(found, np.int64, np.count_nonzero(missing))
        del chunks, new
        self._used(place)
        ids, lengths = self._gather(place)
        total = np.concatenate([[0], np.cumsum(lengths)])
        return ids, np.diff(total[np.concatenate([[0], np.cumsum(counts)])])


@kept
def _encoder(path: str) -> Encoder:
    """A worker's encoder; what it has learnt serves its next tasks."""
    return Encoder(path)


def with_end(ids: np.ndarray, lengths: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
    """Append ``end`` to every document."""
    after = lengths + 1
    out = np.empty(after.sum(), np.uint32)
    ends = np.cumsum(after) - 1
    plain = np.ones(len(out), bool)
    plain[ends] = False
    out[plain] = ids
    out[ends] = end
    return out, after


def write_shards(
    docs: DataFrame, tokenizer: str, order: list[Column] | None = None, end: int = 2, folder: str | None = None
) -> DataFrame:
    """Encode ``docs`` (doc_id, text) and write the shards in ascending ``order`` (doc_id if not given), then
    text; returns the manifest, one row per shard."""
    folder = folder or fresh_folder(docs.sparkSession, "tokens")
    order = order or [F.col("doc_id")]
    keys = [f"_order{i}" for i in range(len(order))]
    rows = docs.select(
        F.coalesce(F.col("doc_id").cast("bigint"), F.lit(-1)).alias("doc_id"),
        utf8("text").alias("text"),
        *[c.alias(k) for c, k in zip(order, keys, strict=True)],
    )
    ranged = rows.repartitionByRange(keys[0]).sortWithinPartitions(*keys, "text").select("doc_id", "text")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep_only(_encoder)
        shard = TaskContext.get().partitionId()
        name = f"{folder}/part-{shard:06d}.pfor"
        encode, out, writer = _encoder(tokenizer), None, None
        for batch, texts in slices(batches, "text", SLICE):
            if writer is None:
                out = AtomicFile(name)
                writer = pfor.ShardWriter(out)
            ids, lengths = with_end(*encode.encode(texts), end)
            writer.add(batch.column(0).to_numpy(zero_copy_only=False), lengths, ids)
        if writer is not None:
            n_docs, n_ids = writer.close()
            out.commit()
            del writer, ids, lengths, texts, batch
            release()
            yield pa.RecordBatch.from_pydict(
                {"shard": pa.array([shard], pa.int32()), "path": [name], "n_docs": [n_docs], "n_ids": [n_ids]}
            )

    return materialise(ranged.mapInArrow(write, MANIFEST), "manifest")


def read_shards(manifest: DataFrame) -> DataFrame:
    """One row per document from the files: its shard, place, length, and crc32 of its ids."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard, path in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                fs, inner = opened(path)
                with fs.open_input_file(inner) as source:
                    reader = pfor.ShardReader(source)
                    yield _digests(reader, shard)

    return spread(manifest.select("shard", "path"), "shard").mapInArrow(read, READ)


def _digests(reader: pfor.ShardReader, shard: int) -> pa.RecordBatch:
    lengths = reader.lengths
    ends = np.cumsum(lengths)
    crcs = np.zeros(len(lengths), np.int64)
    doc = seen = 0
    for ids in reader.runs():
        data = memoryview(ids.astype("<u4").tobytes())
        first = seen
        seen += len(ids)
        while doc < len(ends) and ends[doc] - lengths[doc] < seen:
            at, stop = max(ends[doc] - lengths[doc], first), min(ends[doc], seen)
            crcs[doc] = zlib.crc32(data[4 * (at - first) : 4 * (stop - first)], int(crcs[doc]))
            if ends[doc] > seen:
                break
            doc += 1
    return pa.RecordBatch.from_pydict(
        {
            "doc_id": pa.array(reader.docs, pa.int64()),
            "shard": pa.array(np.full(len(ends), shard, np.int32)),
            "nth": pa.array(np.arange(len(ends), dtype=np.int32)),
            "offset": pa.array(ends - lengths),
            "n_tokens": pa.array(lengths),
            "ids_crc32": pa.array(crcs),
        }
    )


def positions(manifest: DataFrame) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, ids_crc32 and the place in the files."""
    before = W.orderBy("shard").rowsBetween(W.unboundedPreceding, -1)
    bases = manifest.select("shard", F.coalesce(F.sum("n_ids").over(before), F.lit(0)).alias("base"))  # one row per shard
    read = read_shards(manifest).join(F.broadcast(bases), "shard")
    return read.select("doc_id", (F.col("base") + F.col("offset")).alias("start"), "n_tokens", "ids_crc32", "shard", "nth")


def tokenized(docs: DataFrame, tokenizer: str, order: list[Column] | None = None) -> DataFrame:
    """Write ``docs`` as token shards and return every document's digest as read back from them."""
    return positions(write_shards(docs, tokenizer, order))
