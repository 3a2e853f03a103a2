"""Language identification with unigram pieces, summed over all segmentations.

The vocabulary is fixed and public: the letter pieces of a sentencepiece model, in lower case. A word (a run
of letters, at most ``LONGEST`` of them; longer runs are cut) has the probability

    P(word | language) = sum over all segmentations of the product of its pieces' probabilities,

by the forward algorithm. A language's piece probabilities are the pieces' expected counts
over all segmentations of its training words (forward-backward under equal probabilities),
smoothed. A text's score is the posterior of its best language under equal priors.

Words repeat, so a slice of texts is reduced to its distinct words, and the recursions run
over some thousands of these at once. The model has at most vocabulary x languages numbers.

Null texts and texts without a letter are ``und`` with score 0; a tie goes to the first language by
name. Rows without lang aren't learned from; without training rows every text is ``und``.
Repeated rows are scored each; an empty table gives no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from txnrisk.llm.common import SLICE_BYTES, keep_only, kept, slices, utf8

LETTERS = re.compile(r"[^\W\d_]+")
LONGEST = 32
START = "▁"
UNKNOWN = "und"
#: Distinct words of one lattice, for up to four languages; the sums of more languages need more room for each word.
WORDS = 8192
#: Bytes of text at a time.
SLICE = SLICE_BYTES // 2
#: Pseudo-count of every piece, and the least probability of one.
SMOOTH, FLOOR = 0.05, 1e-8


class Pieces:
    """The vocabulary as a trie in a hash table that is looked up for whole arrays."""

    def __init__(self, model: str):
        from sentencepiece import SentencePieceProcessor

        sp = SentencePieceProcessor(model_file=model)
        names = (sp.id_to_piece(i) for i in range(len(sp)) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i)))
        lower = (p.lower() for p in names)
        self.names = sorted({p for p in lower if p == START or LETTERS.fullmatch(p.removeprefix(START))})
        self.unknown = len(self.names)  # one more piece: a letter that is no piece of its own
        nodes: dict[tuple[int, int], int] = {}
        piece = [-1]
        for i, name in enumerate(self.names):
            node = 0
            for char in name:
                key = (node, ord(char))
                if key not in nodes:
                    nodes[key] = len(piece)
                    piece.append(-1)
                node = nodes[key]
            piece[node] = i
        self.piece = np.array(piece, np.int64)
        self.deepest = max(map(len, self.names))
        self.bits = max(4, int(4 * len(nodes)).bit_length())
        self.keys = np.full(1 << self.bits, -1, np.int64)
        self.to = np.zeros(1 << self.bits, np.int64)
        keys = np.array([(n << 21) | c for n, c in nodes], np.int64)
        for key, slot, node in zip(keys.tolist(), self._slot(keys).tolist(), nodes.values(), strict=True):
            while self.keys[slot] >= 0:
                slot = (slot + 1) & ((1 << self.bits) - 1)
            self.keys[slot], self.to[slot] = key, node

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def step(self, nodes: np.ndarray, chars: np.ndarray) -> np.ndarray:
        """The child of each node, or -1."""
        keys = (nodes << 21) | chars
        slot = self._slot(keys)
        out = np.full(len(keys), -1, np.int64)
        open_ = np.arange(len(keys))
        while len(open_):
            held = self.keys[slot[open_]]
            hit = held == keys[open_]
            out[open_[hit]] = self.to[slot[open_[hit]]]
            open_ = open_[~hit & (held >= 0)]
            slot[open_] = (slot[open_] + 1) & ((1 << self.bits) - 1)
        return out


@kept
def pieces(model: str) -> Pieces:
    return Pieces(model)


class Lattice:
    """All segmentations of a list of words at once: ``start``, ``end`` (places between
    letters, over all words) and ``piece`` of each possible step, ordered by its end."""

    def __init__(self, vocab: Pieces, words: list[str]):
        text = START + START.join(words) if words else ""
        chars = np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.int64)
        sizes = np.fromiter(map(len, words), np.int64, len(words)) + 1
        self.first = np.concatenate([[0], np.cumsum(sizes)])
        offset = np.arange(len(chars)) - np.repeat(self.first[:-1], sizes)  # inside the word
        room = np.repeat(sizes, sizes) - offset
        word = np.repeat(np.arange(len(words)), sizes)
        starts, ends, ids = [], [], []
        at, node = np.arange(len(chars)), np.zeros(len(chars), np.int64)
        for n in range(1, vocab.deepest + 1):
            node = vocab.step(node, chars[at + n - 1])
            alive = node >= 0
            piece = np.where(alive, vocab.piece[node], -1)
            if n == 1:
                piece = np.where(piece < 0, vocab.unknown, piece)
            hit = piece >= 0
            starts.append(at[hit])
            ends.append(at[hit] + n)
            ids.append(piece[hit])
            alive &= room[at] > n
            at, node = at[alive], node[alive]
            if not len(at):
                break
        start, end, piece = map(np.concatenate, (starts, ends, ids))
        # places: one more per word than letters
        self.word = word[start]
        self.start, self.end, self.piece = start + self.word, end + self.word, piece
        depth = offset[end - 1] + 1
        order = np.lexsort((self.end, depth))
        self.start, self.end, self.piece, self.word = (x[order] for x in (self.start, self.end, self.piece, self.word))
        self.by_depth = np.searchsorted(depth[order], np.arange(1, int(depth.max(initial=0)) + 2))
        self.origin = self.first[:-1] + np.arange(len(words))
        self.final = self.first[1:] + np.arange(len(words))
        self.places = len(chars) + len(words)

    def forward(self, p: np.ndarray) -> np.ndarray:
        """Sums over segmentations up to every place, for each row of p (languages x pieces)."""
        out = np.zeros((self.places, p.shape[0]))
        out[self.origin] = 1
        weight = np.ascontiguousarray(p.T)
        for a, b in zip(self.by_depth, self.by_depth[1:], strict=False):
            if a < b:
                end = self.end[a:b]
                heads = np.flatnonzero(np.concatenate([[True], end[1:] != end[:-1]]))
                out[end[heads]] = np.add.reduceat(out[self.start[a:b]] * weight[self.piece[a:b]], heads, axis=0)
        return out

    def totals(self, p: np.ndarray) -> np.ndarray:
        return self.forward(p)[self.final]

    def expected(self, p: np.ndarray) -> np.ndarray:
        """Probability of each step over all segmentations of its word, under one distribution."""
        ahead = self.forward(p[None, :])[:, 0]
        behind = np.zeros(self.places)
        behind[self.final] = 1
        for a, b in zip(self.by_depth[-2::-1], self.by_depth[:0:-1], strict=False):
            if a < b:  # ends of this depth are complete: their steps onward end deeper
                np.add.at(behind, self.start[a:b], behind[self.end[a:b]] * p[self.piece[a:b]])
        return ahead[self.start] * p[self.piece] * behind[self.end] / ahead[self.final][self.word]


def distinct_words(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, list[str], np.ndarray]:
    """Chunks of all texts as codes, chunks per text, the distinct chunks' words, and the chunk of each
    of these words."""
    cut = [t.decode("utf-8", "replace").lower().split() for t in texts]
    counts = np.array([len(c) for c in cut], np.int64)
    flat = np.empty(counts.sum(), object)
    flat[:] = list(chain.from_iterable(cut))
    codes, distinct = pd.factorize(flat)
    words: list[str] = []
    owner: list[int] = []
    for i, chunk in enumerate(distinct):
        for run in (chunk,) if chunk.isalpha() else LETTERS.findall(chunk):
            for at in range(0, len(run), LONGEST):
                words.append(run[at : at + LONGEST])
                owner.append(i)
    return codes, counts, words, np.array(owner, np.int64)


def fit(docs: DataFrame, model: str, where: Column | None = None) -> tuple[list[str], np.ndarray]:
    """Languages and their log piece probabilities, from the rows of ``docs`` (text, lang) with ``where``."""
    rows = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull())
    if where is not None:
        rows = rows.filter(where)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep_only(pieces)
        vocab = pieces(model)
        n = vocab.unknown + 1
        even = np.full(n, 1 / n)
        found: dict[str, np.ndarray] = {}
        for batch, texts in slices(batches, "text", SLICE):
            langs = np.repeat(np.array(batch.column(1).to_pylist(), object), 1)
            codes, counts, words, owner = distinct_words(texts)
            if not words:
                continue
            of_chunk = np.repeat(langs, counts)
            chunks = int(codes.max()) + 1
            times = {lang: np.bincount(codes[of_chunk == lang], minlength=chunks)[owner] for lang in set(langs)}
            for a in range(0, len(words), WORDS):
                lattice = Lattice(vocab, words[a : a + WORDS])
                share = lattice.expected(even)
                for lang, of_word in times.items():
                    sums = np.bincount(lattice.piece, share * of_word[a : a + WORDS][lattice.word], n)
                    found[lang] = found.get(lang, 0) + sums
        for lang, sums in found.items():
            at = np.flatnonzero(sums)
            yield pa.RecordBatch.from_pydict({"lang": [lang] * len(at), "piece": pa.array(at, pa.int32()), "n": sums[at]})

    sums = rows.select(utf8("text").alias("text"), "lang").mapInArrow(count, "lang string, piece int, n double")
    # at most languages x vocabulary rows
    table = sums.groupBy("lang", "piece").agg(F.sum("n").alias("n")).toPandas().sort_values(["lang", "piece"])
    langs = sorted(table["lang"].unique())
    n = pieces(model).unknown + 1
    out = np.full((len(langs), n), SMOOTH)
    out[np.searchsorted(langs, table["lang"]), table["piece"]] += table["n"]
    return langs, np.maximum(out / out.sum(axis=1, keepdims=True), FLOOR)


def _judged(docs: DataFrame, model: str, langs: list[str], probabilities: np.ndarray, keep: list[str]) -> DataFrame:
    """(row, lang_pred, score) with the columns ``keep`` in row."""
    row = F.struct(*[F.col(c) for c in keep]).alias("row")
    rows = docs.select(row, utf8("text").alias("_text"))
    schema = rows.select("row").schema["row"].dataType.simpleString()
    sent = docs.sparkSession.sparkContext.broadcast(probabilities)  # languages x vocabulary

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep_only(pieces)
        vocab, p = pieces(model), sent.value
        step = max(1, WORDS * 4 // max(4, len(langs)))
        for batch, texts in slices(batches, "_text", SLICE):
            codes, counts, words, owner = distinct_words(texts)
            n = len(texts)
            sums, letters = np.zeros((n, len(langs))), np.zeros(n)
            if words and langs:
                logs = np.log(np.concatenate([Lattice(vocab, words[a : a + step]).totals(p) for a in range(0, len(words), step)]))
                chunks = int(codes.max()) + 1
                text = np.repeat(np.arange(n), counts)
                letters = np.bincount(text, np.bincount(owner, minlength=chunks)[codes], n)
                for i in range(len(langs)):
                    sums[:, i] = np.bincount(text, np.bincount(owner, logs[:, i], chunks)[codes], n)
            if langs:
                best = sums.argmax(axis=1)
                top = 1 / np.exp(sums - sums.max(axis=1, keepdims=True)).sum(axis=1)
                names = [langs[b] if k else UNKNOWN for b, k in zip(best, letters, strict=True)]
                top = np.where(letters > 0, top, 0.0)
            else:
                names, top = [UNKNOWN] * n, np.zeros(n)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(names, pa.string()), pa.array(top)], names=["row", "lang_pred", "score"])

    return rows.mapInArrow(score, f"row {schema}, lang_pred string, score double")


def predict(docs: DataFrame, model: str, langs: list[str], probabilities: np.ndarray, keep: list[str]) -> DataFrame:
    """The columns ``keep`` of ``docs``, lang_pred and score."""
    out = _judged(docs, model, langs, probabilities, keep)
    return out.select(*[F.col("row")[c].alias(c) for c in keep], "lang_pred", "score")


def certain(docs: DataFrame, model: str, langs: list[str], probabilities: np.ndarray, least: float) -> DataFrame:
    """The rows of ``docs`` in a language whose posterior is ``least`` or more."""
    out = _judged(docs, model, langs, probabilities, docs.columns)
    kept = out.filter((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= least))
    return kept.select(*[F.col("row")[c].alias(c) for c in docs.columns])
