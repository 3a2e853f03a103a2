"""Benchmark decontamination with a generalised suffix automaton.

Test items and texts are normalised to words: A-Z in lower case, runs of ASCII letters and digits and of all
characters beyond ASCII. One automaton recognises every run of words of every item; a text's words are
streamed through it, which gives at each word the length of the longest match that ends
there. A match of ``window`` words is an occurrence of a window of an item; an item with fewer words
occurs as a whole. Words inside occurrences are hit.

The automaton is built from blocks of items of at most ``block_words`` words, each block with
its own pass over the texts inside the same stage, so no task holds more than the blocks need and
the items may be many. Null and empty texts have no words; items without words never occur;
items that repeat an item_id count once. Rows of texts are kept as they are, repeated ones too; with an empty
item table nothing is hit.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from txnrisk.llm.common import slices, utf8

#: The contract's words, after A-Z are in lower case.
WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
WINDOW = 13


def words_of(text: bytes) -> list[bytes]:
    return WORD.findall(text.lower())


class Automaton:
    """Suffix automaton of several word sequences, each state with the items it stands for."""

    def __init__(self, items: list[tuple[int, list[bytes]]], window: int = WINDOW):
        self.window = window
        self.vocab: dict[bytes, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        self.items: list[set[int]] = [set()]
        short: list[tuple[int, list[int]]] = []
        for item, words in items:
            ids = [self.vocab.setdefault(w, len(self.vocab)) for w in words]
            last = 0
            for c in ids:
                last = self._extend(last, c)
            if ids and len(ids) < window:
                short.append((item, ids))
            elif ids:
                state = 0
                for c in ids:  # every prefix; the links carry the item to all its parts
                    state = self.next[state][c]
                    self.items[state].add(item)
        for state in sorted(range(1, len(self.next)), key=self.length.__getitem__, reverse=True):
            if self.link[state] > 0:
                self.items[self.link[state]] |= self.items[state]
        whole: dict[int, dict[int, set[int]]] = {}
        for item, ids in short:
            state = 0
            for c in ids:
                state = self.next[state][c]
            whole.setdefault(state, {}).setdefault(len(ids), set()).add(item)
        #: of each state the short items that its words end with, as (words, items)
        self.short: list[list[tuple[int, frozenset[int]]]] = [[] for _ in self.next]
        for state in sorted(range(1, len(self.next)), key=self.length.__getitem__):
            own = [(n, frozenset(found)) for n, found in whole.get(state, {}).items()]
            self.short[state] = own + self.short[self.link[state]]
        self.shortest = min((n for s in self.short for n, _ in s), default=window)

    def _extend(self, last: int, c: int) -> int:
        following, link, length = self.next, self.link, self.length
        if c in following[last]:
            q = following[last][c]
            return q if length[q] == length[last] + 1 else self._split(last, q, c)
        state = self._state(length[last] + 1, {})
        p = last
        while p != -1 and c not in following[p]:
            following[p][c] = state
            p = link[p]
        if p == -1:
            link[state] = 0
        else:
            q = following[p][c]
            link[state] = q if length[q] == length[p] + 1 else self._split(p, q, c)
        return state

    def _state(self, length: int, following: dict[int, int]) -> int:
        self.next.append(following)
        self.length.append(length)
        self.link.append(0)
        self.items.append(set())
        return len(self.next) - 1

    def _split(self, p: int, q: int, c: int) -> int:
        copy = self._state(self.length[p] + 1, dict(self.next[q]))
        self.items[copy] = set(self.items[q])
        self.link[copy], self.link[q] = self.link[q], copy
        while p != -1 and self.next[p].get(c) == q:
            self.next[p][c] = copy
            p = self.link[p]
        return copy

    def occurrences(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[int]]:
        """Spans [first, last) of the words inside occurrences, and the items that occur."""
        following, link, length, short = self.next, self.link, self.length, self.short
        window, shortest = self.window, self.shortest
        known = list(map(self.vocab.get, words))
        spans: list[tuple[int, int]] = []
        found: set[int] = set()
        state = n = 0
        for i, c in enumerate(known):
            if c is None:
                state = n = 0
                continue
            step = following[state].get(c)
            while step is None and state:
                state = link[state]
                n = length[state]
                step = following[state].get(c)
            if step is None:
                continue
            state, n = step, n + 1
            if n < shortest:
                continue
            first = i + 1
            if n >= window:
                at = state
                while length[link[at]] >= window:
                    at = link[at]
                found |= self.items[at]
                first = i + 1 - window
            for size, items in short[state]:
                if size <= n:
                    found |= items
                    first = min(first, i + 1 - size)
            if first <= i:
                if spans and first <= spans[-1][1]:
                    a = min(first, spans[-1][0])
                    spans[-1] = (a, i + 1)
                    while len(spans) > 1 and spans[-2][1] >= a:
                        spans[-2:] = [(min(spans[-2][0], a), i + 1)]
                else:
                    spans.append((first, i + 1))
        return spans, found


def blocks_of(items: DataFrame, block_words: int) -> list[list[tuple[int, bytes]]]:
    """Items (item_id, text) in blocks of a bounded number of words."""
    blocks: list[list[tuple[int, bytes]]] = []
    size = block_words
    rows = items.select(F.col("item_id").cast("bigint").alias("item_id"), utf8("text").alias("text"))
    for row in rows.filter("item_id is not null").orderBy("item_id", "text").toLocalIterator():
        text = bytes(row["text"])
        n = len(words_of(text))
        if size + n > block_words:
            blocks.append([])
            size = 0
        blocks[-1].append((row["item_id"], text))
        size += n
    return blocks


SPANS = "n_words int, first array<int>, last array<int>, items array<bigint>"


def spans(docs: DataFrame, items: DataFrame, window: int = WINDOW, block_words: int = 200_000) -> DataFrame:
    """(doc_id, _text, n_words, first, last, items): each text's hit spans of words, not yet merged over
    blocks, and the items that occur."""
    spark = docs.sparkSession
    rows = docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"), utf8("text").alias("text"), F.lit(0).alias("n_words"),
        F.expr("array()").cast("array<int>").alias("first"), F.expr("array()").cast("array<int>").alias("last"),
        F.expr("array()").cast("array<bigint>").alias("items"),
    )
    for block in blocks_of(items, block_words) or [[]]:
        sent = spark.sparkContext.broadcast(block)  # at most block_words words

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            automaton = Automaton([(item, words_of(text)) for item, text in sent.value], window)
            for batch, texts in slices(batches, "text"):
                counts, first, last, items = [], [], [], []
                a, b, c = (batch.column(i).to_pylist() for i in (3, 4, 5))
                for i, text in enumerate(texts):
                    words = words_of(text)
                    hits, found = automaton.occurrences(words)
                    counts.append(len(words))
                    first.append(a[i] + [x for x, _ in hits])
                    last.append(b[i] + [x for _, x in hits])
                    items.append(sorted({*c[i], *found}))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), batch.column(1), pa.array(counts, pa.int32()), pa.array(first, pa.list_(pa.int32())),
                     pa.array(last, pa.list_(pa.int32())), pa.array(items, pa.list_(pa.int64()))],
                    names=["doc_id", "text", "n_words", "first", "last", "items"],
                )

        rows = rows.mapInArrow(run, f"doc_id bigint, text binary, {SPANS}")
    return rows


def _hit(first: list[int], last: list[int]) -> int:
    """Words inside the union of spans."""
    total = end = 0
    for a, b in sorted(zip(first, last, strict=True)):
        total += max(0, b - max(a, end))
        end = max(end, b)
    return total


def digests(found: DataFrame) -> DataFrame:
    """Per text: words, hit words, items, their digest and the verdict."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            docs, words, first, last, items = (batch.column(i).to_pylist() for i in range(5))
            hit = [_hit(a, b) if a else 0 for a, b in zip(first, last, strict=True)]
            names = [",".join(sorted(map(str, i))) for i in items]
            yield pa.RecordBatch.from_arrays(
                [pa.array(docs, pa.int64()), pa.array(words, pa.int64()), pa.array(hit, pa.int64()),
                 pa.array([len(i) for i in items], pa.int64()),
                 pa.array([hashlib.sha256(x.encode()).hexdigest() for x in names], pa.string())],
                names=["doc_id", "n_words", "n_hit", "n_items", "items_sha256"],
            )

    rows = found.select("doc_id", "n_words", "first", "last", "items")
    out = rows.mapInArrow(run, "doc_id bigint, n_words bigint, n_hit bigint, n_items bigint, items_sha256 string")
    return out.withColumn("contaminated", F.expr("n_hit > 0 and 20 * n_hit >= n_words"))


def contamination(docs: DataFrame, items: DataFrame, window: int = WINDOW, block_words: int = 200_000) -> DataFrame:
    return digests(spans(docs, items, window, block_words))


def cleaned(docs: DataFrame, items: DataFrame, coverage: float = 0.05, window: int = WINDOW, block_words: int = 200_000) -> DataFrame:
    """``docs`` without the texts of which ``coverage`` or more of the words are hit, and with the hit spans
    cut out of all others; every other column stays as it is (n_chars is counted anew where a
    text was cut)."""
    keys = [c for c in docs.columns if c != "text"]
    packed = docs.select(F.struct(*keys).alias("row"), F.col("text").isNull().alias("absent"), F.col("text"), F.lit(0).cast("bigint").alias("doc_id"))
    schema = packed.select("row").schema["row"].dataType.simpleString()

    hits = F.expr("array()").cast("array<int>")
    rows = packed.select("row", "absent", utf8("text").alias("text"), F.lit(0).alias("n_words"), hits.alias("first"), hits.alias("last"))
    for block in blocks_of(items, block_words):
        sent = docs.sparkSession.sparkContext.broadcast(block)  # at most block_words words

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            automaton = Automaton([(item, words_of(text)) for item, text in sent.value], window)
            for batch, texts in slices(batches, "text"):
                counts, first, last = [], batch.column(4).to_pylist(), batch.column(5).to_pylist()
                for i, text in enumerate(texts):
                    words = words_of(text)
                    found = automaton.occurrences(words)[0]
                    counts.append(len(words))
                    first[i] += [a for a, _ in found]
                    last[i] += [b for _, b in found]
                yield pa.RecordBatch.from_arrays(
                    [*batch.columns[:3], pa.array(counts, pa.int32()), pa.array(first, pa.list_(pa.int32())), pa.array(last, pa.list_(pa.int32()))],
                    names=["row", "absent", "text", "n_words", "first", "last"],
                )

        rows = rows.mapInArrow(run, f"row {schema}, absent boolean, text binary, n_words int, first array<int>, last array<int>")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in slices(batches, "text"):
            keep, out = [], []
            for i, (text, words, first, last) in enumerate(zip(texts, *(batch.column(c).to_pylist() for c in (3, 4, 5)), strict=True)):
                n = _hit(first, last)
                if n and n / words >= coverage:  # the quotient, so that a share of exactly ``coverage`` counts
                    continue
                keep.append(i)
                out.append(without(text, sorted(zip(first, last, strict=True))) if n else text)
            picked = batch.take(pa.array(keep, pa.int64()))
            yield pa.RecordBatch.from_arrays([picked.column(0), picked.column(1), pa.array(out, pa.binary())], names=["row", "absent", "text"])

    kept = rows.mapInArrow(cut, f"row {schema}, absent boolean, text binary")
    text = F.when(~F.col("absent"), F.decode(F.col("text"), "UTF-8"))
    columns = [text.alias(c) if c == "text" else F.col("row")[c].alias(c) for c in docs.columns]
    if "n_chars" in docs.columns:
        at = docs.columns.index("n_chars")
        kind = docs.schema["n_chars"].dataType
        columns[at] = F.when(F.col("absent"), F.col("row")["n_chars"]).otherwise(F.char_length(text)).cast(kind).alias("n_chars")
    return kept.select(*columns)


def without(text: bytes, hits: list[tuple[int, int]]) -> bytes:
    """``text`` without the bytes from the first to the last word of each span."""
    places = [m.span() for m in WORD.finditer(text.lower())]
    out, at = [], 0
    for first, last in hits:
        a, b = places[first][0], places[last - 1][1]
        if a > at:
            out.append(text[at:a])
        at = max(at, b)
    return b"".join([*out, text[at:]])
