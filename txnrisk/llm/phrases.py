"""Phrase collocations from count streams in prefix and suffix order.

Texts are cut into pieces and words; every position gives the *window* of the words from there to
``longest`` words on. Windows sorted as strings are the count stream in prefix order: all occurrences of
a phrase are one run of rows that begin with it, so one pass with a stack of open
phrases counts phrases of every length, and no table of phrases is held. The sorted stream is cut by range, not by key; a
phrase that reaches over a cut is given in parts, which are added up.

The phrases that are frequent enough are then read twice, sorted in prefix order (by words)
and in suffix order (by words from the last). In prefix order the first words of a phrase are open
when it comes and its extensions by a word follow it; in suffix order the same holds for its last
words. The two streams are merge-joined on the phrase: left, right and extension counts, without a hash table.

A phrase can't be frequent unless every two words in it are, so windows end where a pair is rare. Pairs are first counted
by a 64-bit hash, and the hashes of frequent ones set bits in a bit set of ``bits`` bits (a fixed size, whatever the
corpus); pairs that share a hash or a bit with a frequent one only make windows longer than needed, never a result
different.

Null and empty texts have no words; a null lang counts as ``und``. Repeated rows count each. An empty
table gives no rows. Other columns aren't read. Ties of the score go by count, then by the phrase's bytes.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from txnrisk.llm.common import release, slices, utf8
from txnrisk.sources.scratch import materialise

BREAK = b"."  # a separator itself, so never a word
_PIECES = bytes.maketrans(b".,;:!?\n\x0b\x0c\r", b"\n" * 10)
_SEED = 42
_SEGMENT = 1 << 15

#: Distinct keys that a task adds up before it hands them on, and words that it works on at a time.
HELD = 400_000


def tokens(text: bytes) -> list[bytes]:
    """Words in order, with ``BREAK`` between pieces."""
    return text.lower().translate(_PIECES).replace(b"\n", b" . ").split()


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), utf8("text").alias("text"))


def _batch(held: dict[str, Counter]) -> pa.RecordBatch:
    langs = [lang for lang, counts in held.items() for _ in range(len(counts))]
    keys = [k for counts in held.values() for k in counts]
    sums = [n for counts in held.values() for n in counts.values()]
    return pa.RecordBatch.from_arrays(
        [pa.array(langs, pa.string()), pa.array(keys, pa.binary()), pa.array(sums, pa.int64())], names=["lang", "phrase", "n"]
    )


class _Hashes(dict):
    """word -> 64-bit hash that the lang is part of; remembers a bounded number of words."""

    def __init__(self, lang: str):
        super().__init__()
        self._head = lang.encode() + b"\0"

    def __missing__(self, word: bytes) -> int:
        from xxhash import xxh64_intdigest

        if len(self) > HELD:
            self.clear()
        value = self[word] = 0 if word == BREAK else xxh64_intdigest(self._head + word, _SEED) | 1
        return value


def _pairs(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The hash of every word with the next one, and whether there is one."""
    a, b = hashes[:-1], hashes[1:]
    mixed = (a * np.uint64(0x9E3779B97F4A7C15)) ^ (b * np.uint64(0xC2B2AE3D27D4EB4F) + (a >> np.uint64(29)))
    mixed = (mixed ^ (mixed >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return mixed ^ (mixed >> np.uint64(32)), (a != 0) & (b != 0)


def _by_lang(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, list[bytes], np.ndarray]]:
    """(lang, words with ``BREAK`` between pieces and texts, their hashes) in parts of a bounded size."""
    hashes: dict[str, _Hashes] = {}
    for batch, texts in slices(batches, "text", 4 << 20):
        parts: dict[str, list[bytes]] = defaultdict(lambda: [BREAK])
        for lang, text in zip(batch.column(0).to_pylist(), texts, strict=True):
            parts[lang] += tokens(text)
            parts[lang].append(BREAK)
        for lang, words in parts.items():
            if lang not in hashes:
                hashes.clear()  # one lang's words at a time, if langs come in turn
                hashes[lang] = _Hashes(lang)
            yield lang, words, np.array(list(map(hashes[lang].__getitem__, words)), np.uint64)


def pair_counts(docs: DataFrame) -> DataFrame:
    """(h, n): occurrences of every pair of words, by its hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def emitted() -> pa.RecordBatch:
            h, n = np.unique(np.concatenate(held), return_counts=True) if held else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(n.astype(np.int64))], names=["h", "n"])

        for _, _, hashes in _by_lang(batches):
            pairs, there = _pairs(hashes)
            held.append(pairs[there])
            if sum(map(len, held)) > 10 * HELD:
                yield emitted()
        yield emitted()
        release()

    return _texts(docs).mapInArrow(run, "h bigint, n bigint").groupBy("h").agg(F.sum("n").alias("n"))


def bit_set(pairs: DataFrame, bits: int) -> list[tuple[int, bytes]]:
    """The bits that the hashes h set, in segments; at most ``bits`` / 8 bytes in all."""
    bit = F.shiftrightunsigned("h", 64 - (bits.bit_length() - 1))
    rows = pairs.select(bit.alias("bit")).select(
        F.floor(F.col("bit") / _SEGMENT).cast("int").alias("segment"), (F.col("bit") % _SEGMENT).cast("int").alias("at")
    )
    found = rows.groupBy("segment").agg(F.collect_set("at").alias("at")).toLocalIterator()
    out = []
    for segment, at in found:
        flags = np.zeros(_SEGMENT, np.uint8)
        flags[at] = 1
        out.append((segment, np.packbits(flags, bitorder="little").tobytes()))
    return out


def windows(docs: DataFrame, segments: list[tuple[int, bytes]], bits: int, longest: int) -> DataFrame:
    """(lang, phrase, n): the window of every word, each of its words closed by a space."""
    shift = np.uint64(64 - (bits.bit_length() - 1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flags = np.zeros(max(bits, _SEGMENT) // 8, np.uint8)
        for segment, data in segments:
            flags[segment * len(data) : (segment + 1) * len(data)] = np.frombuffer(data, np.uint8)
        held: dict[str, Counter] = defaultdict(Counter)
        for lang, words, hashes in _by_lang(batches):
            pairs, there = _pairs(hashes)
            bit = pairs >> shift
            there &= (flags[bit >> np.uint64(3)] >> (bit & np.uint64(7)).astype(np.uint8)) & 1 == 1
            starts = np.flatnonzero(hashes)
            ends = np.flatnonzero(~there)  # the last word of a run of frequent pairs
            stops = np.minimum(starts + longest, ends[np.searchsorted(ends, starts)] + 1)
            offsets = np.concatenate([[0], np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)])
            joined = b" ".join(words) + b" "
            held[lang].update([joined[a:b] for a, b in zip(offsets[starts].tolist(), offsets[stops].tolist(), strict=True)])
            if sum(map(len, held.values())) > HELD:
                yield _batch(held)
                held.clear()
        yield _batch(held)
        held.clear()
        release()

    return _texts(docs).mapInArrow(run, "lang string, phrase binary, n bigint")


def _path_counts(least: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Counts of all phrases from windows in prefix order. Those that may go on in the part before or
    after come whatever their count."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_lang, path, sums, first = None, [], [], True
        out: tuple[list, list, list, list] = ([], [], [], [])

        def close(depth: int, always: bool) -> None:
            for size in range(len(path), depth, -1):
                n = sums[size - 1]
                if always or n >= least:
                    for column, value in zip(out, (open_lang, b" ".join(path[:size]), size, n), strict=True):
                        column.append(value)
                if size > 1:
                    sums[size - 2] += n
            del path[depth:], sums[depth:]

        edge, last = 0, None  # words of the open path that began with the part itself; the window before
        for batch in batches:
            langs, phrases, counts = (batch.column(i).to_pylist() for i in range(3))
            for lang, phrase, n in zip(langs, phrases, counts, strict=True):
                if phrase == last and lang == open_lang:  # the same window from another part of the corpus
                    sums[-1] += n
                    continue
                last = phrase
                words = phrase.split(b" ")
                words.pop()
                depth = 0
                if lang == open_lang:
                    for a, b in zip(path, words, strict=False):
                        if a != b:
                            break
                        depth += 1
                if depth < len(path):
                    if edge > depth:
                        close(max(edge, depth), False)
                        close(depth, True)
                        edge = depth
                    else:
                        close(depth, False)
                open_lang = lang
                path += words[depth:]
                sums += [0] * (len(words) - depth)
                sums[-1] += n
                if first:
                    first, edge = False, len(path)
            if len(out[0]) > 50_000:
                yield _counts_batch(out)
                out = ([], [], [], [])
        close(0, True)
        yield _counts_batch(out)
        release()

    return run


def _counts_batch(out: tuple[list, list, list, list]) -> pa.RecordBatch:
    types = (pa.string(), pa.binary(), pa.int32(), pa.int64())
    return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out, types, strict=True)], names=["lang", "phrase", "words", "f"])


def phrase_counts(docs: DataFrame, least: int = 100, longest: int = 5, bits: int = 1 << 27) -> tuple[DataFrame, DataFrame]:
    """(lang, phrase, words, f) of phrases of one to ``longest`` words with ``f >= least``, and (lang, n)."""
    pairs = bit_set(pair_counts(docs).filter(F.col("n") >= least), bits)
    found = materialise(windows(docs, pairs, bits, longest), "windows")
    ranged = found.repartitionByRange("lang", "phrase").sortWithinPartitions("lang", "phrase")
    parts = ranged.mapInArrow(_path_counts(least), "lang string, phrase binary, words int, f bigint")
    counts = parts.groupBy("lang", "phrase", "words").agg(F.sum("f").alias("f")).filter(F.col("f") >= least)
    totals = found.groupBy("lang").agg(F.sum("n").alias("n"))  # every word begins one window
    return materialise(counts.withColumn("phrase", F.col("phrase").cast("string")), "phrases"), totals


def _lockstep(side: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Per phrase of a sorted stream (lang, path, phrase, f), its first words before it, the counts of
    these first words by length, and the largest count among its extensions by one word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_lang, stack = None, []  # of [words, phrase, f, largest extension]
        rows: list[tuple] = []

        def close(depth: int) -> None:
            while len(stack) > depth:
                _, phrase, f, extension = stack.pop()
                rows.append((open_lang, phrase, f, [entry[2] for entry in stack], extension))

        for batch in batches:
            langs, paths, phrases, counts = (batch.column(i).to_pylist() for i in range(4))
            for lang, path, phrase, f in zip(langs, paths, phrases, counts, strict=True):
                while stack and not (lang == open_lang and path.startswith(stack[-1][0])):
                    close(len(stack) - 1)
                open_lang = lang
                if stack:
                    stack[-1][3] = max(stack[-1][3], f)
                stack.append([path, phrase, f, 0])
            if len(rows) > 20_000:
                yield _sides(rows, side)
                rows.clear()
        close(0)
        yield _sides(rows, side)

    return run


def _sides(rows: list[tuple], side: str) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [[]] * 5
    types = (pa.string(), pa.string(), pa.int64(), pa.list_(pa.int64()), pa.int64())
    names = ["lang", "phrase", "f", side, f"{side}_extension"]
    return pa.RecordBatch.from_arrays([pa.array(list(v), t) for v, t in zip(columns, types, strict=True)], names=names)


def _stream(counts: DataFrame, side: str) -> DataFrame:
    """The counts in prefix order (``heads``) or suffix order (``tails``), read in one pass."""
    words = F.split(F.col("phrase"), " ")
    path = words if side == "heads" else F.reverse(words)
    keyed = counts.select("lang", F.concat(F.array_join(path, " "), F.lit(" ")).alias("path"), "phrase", "f", path[0].alias("_first"))
    ordered = keyed.repartition("lang", "_first").sortWithinPartitions("lang", "path").drop("_first")
    return ordered.mapInArrow(_lockstep(side), f"lang string, phrase string, f bigint, {side} array<bigint>, {side}_extension bigint")


def lowest_cut(a: int, n: int, heads: list[int], tails: list[int]) -> tuple[int, int, int]:
    """(score, l, r) of the cut with the lowest score, the first of equal ones; in whole numbers."""
    scored = [(1000 * a * n // (left * right), left, right) for left, right in zip(heads, reversed(tails), strict=True)]
    return min(scored, key=lambda cut: cut[0])


def scored(counts: DataFrame, totals: DataFrame, share: int = 100) -> DataFrame:
    """(lang, phrase, a, l, r, n, score) of the phrases of two words or more that aren't part of a longer
    one with ``share`` per cent of their count. A longer phrase is never more frequent than the
    extension by one word between, so the extensions by one word decide."""
    heads, tails = _stream(counts, "heads"), _stream(counts, "tails").drop("f")
    kept = heads.filter(F.size("heads") > 0).hint("merge").join(tails, ["lang", "phrase"])
    kept = kept.filter(100 * F.greatest("heads_extension", "tails_extension") < share * F.col("f"))
    rows = kept.select("lang", "phrase", F.col("f").alias("a"), "heads", "tails").join(totals, "lang")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, heads, tails, n = (batch.column(i).to_pylist() for i in (2, 3, 4, 5))
            cuts = [lowest_cut(*row) for row in zip(a, n, heads, tails, strict=True)]
            score, left, right = (pa.array([cut[i] for cut in cuts], pa.int64()) for i in range(3))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), batch.column(2), left, right, batch.column(5), score],
                names=["lang", "phrase", "a", "l", "r", "n", "score"],
            )

    return rows.mapInArrow(run, "lang string, phrase string, a bigint, l bigint, r bigint, n bigint, score bigint")


def collocations(
    docs: DataFrame, least: int = 100, longest: int = 5, share: int = 100, top: int = 2000, bits: int = 1 << 27
) -> DataFrame:
    """The ``top`` phrases of every lang, with rank, parts and score."""
    counts, totals = phrase_counts(docs, least, longest, bits)
    order = W.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = scored(counts, totals, share).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)
    return ranked.select("lang", F.col("rank").cast("bigint").alias("rank"), "phrase", "a", "l", "r", "n", "score")
