"""Toxicity by a weighted finite-state grammar over the words of a clause.

Words have a class: insult, threat, intent, target, negation, report, or none. Five transducers read the
classes of a clause in a row, each rewriting what the one before gave: repeated insults, threats with an intent before
them, words with a target near, words in the scope of a negation, words behind a verb of report. ``compose``
makes one transducer of all five, so a clause is read once, and each insult or threat comes out with the marks of its
pattern. What counts is therefore the matched clause ("you are not an idiot" isn't "you idiot"), and how
much each pattern counts is learned.

Insults are word stems with a weight, the log-odds of documents with the stem among toxic and other ones: a
few fixed public words of four languages, and stems of the labelled texts (a stem that is frequent in
toxic documents and almost never elsewhere). Pattern weights come from a logistic fit on the same rows.
Both use at most ``sample`` labelled rows of each label, those with the smallest hashes of doc_id; labels
of repeated doc_ids count as toxic if one of them says so. Every text is scored.

Null and empty texts match nothing and get the score of the bare intercept. Documents without doc_id are scored but not
learned from. Without toxic labels, or without others, the fixed words and default weights are used. Repeated rows are
scored each; an empty table gives no rows; other columns aren't read.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from txnrisk.llm.common import release, remainder, slices, utf8
from txnrisk.sources.scratch import materialise

# Common words of English, German, French and Spanish.
INSULTS = (
    "idiot moron stupid loser scum trash worthless pathetic disgusting clown fool jerk dummkopf trottel abschaum versager "
    "wertlos widerlich imbécile crétin abruti minable ordure pathétique idiota imbécil estúpid basura patétic asqueros payaso"
).split()
THREATS = "kill hurt destroy punch stab töte töten schlage vernichte tuer tuerai frapper frapperai matar mataré golpear".split()
INTENTS = "will gonna shall going werde wirst vais allons voy vamos".split()
TARGETS = "you your yours du dich dir ihr euch deine tu te toi vous ton votre tú usted ustedes ti vosotros".split()
NEGATIONS = "not never no don't isn't nicht kein keine nie ne pas jamais aucun nunca jamás ningún sin".split()
REPORTS = "said says called calls wrote quoted sagte sagt nannte schrieb dit disait appelle écrit dijo dice llamó escribió".split()

WORD, INSULT, THREAT, INTENT, TARGET, NEGATION, REPORT = CLASSES = ("word", "insult", "threat", "intent", "target", "negation", "report")
_CLAUSES = re.compile(r"[.!?;:\n\r]+")
_WORDS = re.compile(r"[^\W\d_]+(?:'[^\W\d_]+)?")
SHORTEST, LONGEST = 3, 10
#: The weight of a fixed insult that no label speaks of.
SEED_WEIGHT = 4.0

Arcs = dict[tuple[int, str], tuple[int, str]]


# -- the grammar -----------------------------------------------------------------------------------


def _marked(symbol: str, mark: str) -> str:
    kind, _, marks = symbol.partition(":")
    return f"{kind}:{''.join(sorted({*marks, mark}))}"


def _hit(symbol: str) -> bool:
    return symbol.split(":")[0] in (INSULT, THREAT)


class Transducer:
    """A deterministic transducer over symbols; what has no arc is handed on and steps ``fade``."""

    def __init__(self, step):
        self.step = step  # (state, symbol) -> (state, symbol)


def repeated() -> Transducer:
    """Marks ``m`` on every insult of a clause but the first."""

    def step(state: int, symbol: str) -> tuple[int, str]:
        if symbol.split(":")[0] != INSULT:
            return state, symbol
        return 1, _marked(symbol, "m") if state else symbol

    return Transducer(step)


def scope(opens: str, mark: str, reach: int | None, kinds: tuple[str, ...] = (INSULT, THREAT)) -> Transducer:
    """Marks hits of ``kinds`` at most ``reach`` words behind a word of class ``opens``; None: up to the clause's end."""

    def step(state: int, symbol: str) -> tuple[int, str]:
        if symbol == opens:
            return (1 if reach is None else reach), symbol
        out = _marked(symbol, mark) if state and symbol.split(":")[0] in kinds else symbol
        return (state if reach is None else max(0, state - 1)), out

    return Transducer(step)


def compose(first: Transducer, then: Transducer) -> Transducer:
    """The transducer that hands the output of ``first`` to ``then``; states are pairs."""

    def step(state: tuple, symbol: str) -> tuple[tuple, str]:
        a, b = state or (0, 0)
        a, middle = first.step(a, symbol)
        b, out = then.step(b, middle)
        return (a, b), out

    return Transducer(step)


def grammar() -> Transducer:
    """Insult, threat, target, negation and reported speech in one."""
    chain = repeated()
    for part in (
        scope(INTENT, "i", 3, (THREAT,)),
        scope(TARGET, "a", 4),
        scope(NEGATION, "n", 3),
        scope(REPORT, "r", None),
    ):
        chain = compose(chain, part)
    return chain


def compiled(machine: Transducer) -> tuple[list[list[int]], list[list[str]]]:
    """Tables [state][class] of the reachable states: the next state, and the symbol that comes out."""
    states, to, out = [0], [], []
    number = {0: 0}
    for state in states:  # grows while it is read
        to.append([])
        out.append([])
        for symbol in CLASSES:
            after, given = machine.step(state, symbol)
            if after not in number:
                number[after] = len(states)
                states.append(after)
            to[-1].append(number[after])
            out[-1].append(given if _hit(given) else "")
    return to, out


# -- clauses and figures ---------------------------------------------------------------------------

#: Weight of all insults, of those with a mark, of threats, of the best clause; matched clauses.
FIGURES = ["insult", *[f"insult:{m}" for m in "amnr"], "threat", *[f"threat:{m}" for m in "ainr"], "plain", "best", "matched"]


class Lexicon(dict):
    """word -> (class number, weight); remembers a bounded number of words."""

    def __init__(self, stems: dict[str, float], held: int = 300_000):
        super().__init__()
        self._stems, self._held = stems, held
        self._fixed = {}
        for number, words in ((6, REPORTS), (5, NEGATIONS), (4, TARGETS), (3, INTENTS), (2, THREATS)):
            self._fixed.update(dict.fromkeys(words, (number, SEED_WEIGHT if number == 2 else 0.0)))
        self._sizes = sorted({len(s) for s in stems}, reverse=True)

    def __missing__(self, word: str) -> tuple[int, float] | None:
        found = self._fixed.get(word)
        for size in self._sizes:
            weight = self._stems.get(word[:size]) if size <= len(word) else None
            if weight is not None:
                found = (1, weight)
                break
        if len(self) > self._held:
            self.clear()
        self[word] = found
        return found


class Reader:
    """Figures of a text."""

    def __init__(self, stems: dict[str, float]):
        self._lexicon = Lexicon(stems)
        self._to, self._out = compiled(grammar())
        self._where = {name: i for i, name in enumerate(FIGURES)}

    def clauses(self, text: str) -> Iterator[tuple[str, list[tuple[str, float]]]]:
        """Matched clauses with their patterns and weights."""
        lookup = self._lexicon.__getitem__
        for clause in _CLAUSES.split(text):
            classes = list(map(lookup, _WORDS.findall(clause)))
            if not any(classes):
                continue
            state, hits = 0, []
            for entry in classes:
                number, weight = entry or (0, 0.0)
                given = self._out[state][number]
                state = self._to[state][number]
                if given:
                    hits.append((given, weight))
            if hits:
                yield clause, hits

    def figures(self, text: str) -> np.ndarray:
        total = np.zeros(len(FIGURES))
        best = 0.0
        for _, hits in self.clauses(text.lower()):
            score = 0.0
            for pattern, weight in hits:
                kind, _, marks = pattern.partition(":")
                total[self._where[kind]] += weight
                for mark in marks:
                    total[self._where[f"{kind}:{mark}"]] += weight
                if not marks.strip("am"):
                    total[self._where["plain"]] += weight
                score += weight / (2 if "n" in marks or "r" in marks else 1)
            best = max(best, score)
            total[self._where["matched"]] += 1
        total[self._where["best"]] = best
        return np.log1p(total)


# -- learning --------------------------------------------------------------------------------------


def stems_of(text: str) -> set[str]:
    """Beginnings of the words of a text."""
    words = set(_WORDS.findall(text.lower()))
    return {w[:n] for w in words for n in range(SHORTEST, min(len(w), LONGEST) + 1)}


def labelled(docs: DataFrame, labels: DataFrame, where: Column, sample: int) -> DataFrame:
    """(text, toxic): the different texts of at most ``sample`` rows of each label with ``where``. The chosen ids, at most
    twice ``sample``, are broadcast."""
    rated = labels.filter(where & F.col("toxic").isNotNull() & F.col("doc_id").isNotNull())
    rated = rated.groupBy(F.col("doc_id").cast("bigint").alias("doc_id")).agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    chosen = rated.filter("toxic = 1").orderBy(*order).limit(sample).unionByName(rated.filter("toxic = 0").orderBy(*order).limit(sample))
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), utf8("text").alias("text")).join(F.broadcast(chosen), "doc_id")
    return rows.groupBy(F.sha2("text", 256).alias("digest")).agg(F.first("text").alias("text"), F.max("toxic").alias("toxic")).drop("digest")


def stem_counts(rows: DataFrame) -> DataFrame:
    """(stem, toxic, others): documents with each stem."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple[Counter, Counter] = (Counter(), Counter())

        def emitted() -> pa.RecordBatch:
            names = list(held[0].keys() | held[1].keys())
            columns = [pa.array(names, pa.string()), *[pa.array([held[i][s] for s in names], pa.int64()) for i in (1, 0)]]
            for counts in held:
                counts.clear()
            return pa.RecordBatch.from_arrays(columns, names=["stem", "toxic", "others"])

        for batch, texts in slices(batches, "text", 1 << 20):
            for text, toxic in zip(texts, batch.column(1).to_pylist(), strict=True):
                held[1 if toxic else 0].update(stems_of(text.decode("utf-8", "replace")))
            if len(held[0]) + len(held[1]) > 500_000:
                yield emitted()
        yield emitted()
        release()

    return rows.mapInArrow(run, "stem string, toxic bigint, others bigint").groupBy("stem").agg(F.sum("toxic").alias("toxic"), F.sum("others").alias("others"))


def chosen_stems(counts: list[tuple[str, int, int]], least_weight: float, toxic: int, others: int) -> dict[str, float]:
    """The shortest stems that tell, each made longer while it loses nothing, with their weights."""
    weight = {s: float(np.log((p + 0.5) / (toxic + 1)) - np.log((q + 0.5) / (others + 1))) for s, p, q in counts}
    seen = {s: p for s, p, _ in counts}
    children: dict[str, list[str]] = {}
    for stem in weight:
        children.setdefault(stem[:-1], []).append(stem)
    out: dict[str, float] = {}
    for stem in sorted(weight, key=lambda s: (len(s), s)):
        if weight[stem] < least_weight or any(stem[:n] in out for n in range(SHORTEST, len(stem))):
            continue
        if any(seen[c] >= 0.95 * seen[stem] and weight[c] >= least_weight for c in children.get(stem, ())):
            continue  # the longer one says the same and is safer
        out[stem] = weight[stem]
    return out


def fit_logistic(x: np.ndarray, y: np.ndarray, penalty: float = 1.0, steps: int = 50) -> np.ndarray:
    """Weights and intercept of the penalised logistic likelihood, by Newton steps."""
    x = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(x.shape[1])
    ridge = np.full(len(w), penalty)
    ridge[-1] = 1e-6
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(ridge), x.T @ (y - p) - ridge * w)
        w = w + step
        if np.abs(step).max() < 1e-9:
            break
    return w


def default_weights() -> np.ndarray:
    w = np.zeros(len(FIGURES) + 1)
    for name, value in (("best", 2.0), ("plain", 0.5), ("threat:i", 0.5), ("insult:n", -0.5), ("insult:r", -0.5)):
        w[FIGURES.index(name)] = value
    w[-1] = -2.5
    return w


def with_figures(docs: DataFrame, stems: dict[str, float], keep: list[str]) -> DataFrame:
    """Columns ``keep`` and x, the figures of every text."""
    rows = docs.select(*keep, utf8("text").alias("text"))
    schema = rows.drop("text").schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(stems)
        for batch, texts in slices(batches, "text", 1 << 20):
            x = [reader.figures(t.decode("utf-8", "replace")) for t in texts]
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * len(FIGURES), pa.int32()), pa.array(np.concatenate(x)))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], lists], names=[*keep, "x"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema)
    return rows.mapInArrow(run, f"{fields}, x array<double>")


def fit(docs: DataFrame, labels: DataFrame, where: Column, sample: int = 20_000, least: int = 4, least_weight: float = 3.0, most_stems: int = 5_000) -> tuple[dict[str, float], np.ndarray]:
    """Insult stems with their weights (at most ``most_stems``, the most telling), and the weights of the figures."""
    rows = materialise(labelled(docs, labels, where, sample), "labelled")
    sizes = {bool(t): n for t, n in rows.groupBy("toxic").count().collect()}
    seeds = dict.fromkeys(INSULTS, SEED_WEIGHT)
    if not sizes.get(True) or not sizes.get(False):
        return seeds, default_weights()
    toxic, others = sizes[True], sizes[False]
    ratio = (F.col("toxic") + 0.5) * (others + 1) / ((F.col("others") + 0.5) * (toxic + 1))
    counts = materialise(stem_counts(rows), "stems")
    telling = counts.filter((F.col("toxic") >= least) & (ratio >= float(np.exp(least_weight))))
    telling = telling.orderBy(F.desc(ratio), "stem").limit(most_stems)
    stems = chosen_stems([tuple(r) for r in telling.collect()], least_weight, toxic, others)
    known = {s: (p, q) for s, p, q in counts.filter(F.col("stem").isin([s[:LONGEST] for s in INSULTS])).collect()}
    for word in INSULTS:
        p, q = known.get(word[:LONGEST], (0, 0))
        if not any(word[:n] in stems for n in range(SHORTEST, len(word) + 1)) and p + q < 10:
            stems[word] = SEED_WEIGHT  # too rare in the labelled texts to be judged by them
    found = with_figures(rows, stems, ["toxic"]).toPandas()
    return stems, fit_logistic(np.stack(found["x"].to_list()), found["toxic"].to_numpy(np.float64))


def score(weights: np.ndarray) -> Column:
    """The probability of toxicity from column x."""
    total = F.lit(float(weights[-1]))
    for i, w in enumerate(weights[:-1]):
        total = total + F.col("x")[i] * float(w)
    return 1 / (1 + F.exp(-total))


def scores(docs: DataFrame, labels: DataFrame, folds: int = 3, held_out: int = 1, sample: int = 20_000) -> DataFrame:
    """(doc_id, held_out, score): the fold ``held_out`` of crc32(doc_id) isn't learned from."""
    stems, weights = fit(docs, labels, remainder(folds) != held_out, sample)
    found = with_figures(docs, stems, ["doc_id"])
    return found.select("doc_id", (remainder(folds) == held_out).alias("held_out"), score(weights).alias("score"))


def matched_clauses(docs: DataFrame, stems: dict[str, float]) -> DataFrame:
    """(doc_id, clause, pattern, weight): every insult or threat with the marks of its clause."""
    rows = docs.select("doc_id", utf8("text").alias("text"))
    id_type = rows.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(stems)
        for batch, texts in slices(batches, "text", 1 << 20):
            at, out = [], []
            for i, text in enumerate(texts):
                for clause, hits in reader.clauses(text.decode("utf-8", "replace").lower()):
                    at += [i] * len(hits)
                    out += [(clause.strip(), pattern, weight) for pattern, weight in hits]
            columns = list(zip(*out, strict=True)) if out else [[]] * 3
            ids = batch.column(0).take(pa.array(at, pa.int64()))
            arrays = [pa.array(list(c), t) for c, t in zip(columns, (pa.string(), pa.string(), pa.float64()), strict=True)]
            yield pa.RecordBatch.from_arrays([ids, *arrays], names=["doc_id", "clause", "pattern", "weight"])

    return rows.mapInArrow(run, f"doc_id {id_type}, clause string, pattern string, weight double")
