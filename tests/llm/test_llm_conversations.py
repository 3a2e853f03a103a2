"""Conversation repair, toxicity grammar and collocations against brute force."""

import hashlib
import itertools
import os
import random
import zlib
from collections import Counter, defaultdict

import duckdb
import pytest

from txnrisk.llm import conversations, phrases, toxicity
from txnrisk.llm.common import remainder
from txnrisk.llm.queries import ORACLES

CONV = "conv_id bigint, turn bigint, role string, text string, known boolean, digest string, side int, audit string, times int"


def in_sql(name, **tables):
    con = duckdb.connect()
    for table, df in tables.items():
        con.register(table, df.toArrow())
    return con.sql(ORACLES[name]).df()


# -- op11 -------------------------------------------------------------------------------------------


def cheapest(symbols):
    """(cost, audit) by plain dynamic programming from the first row on, strings compared as they are."""
    costs = {0: (0, "")}

    def inserted(best):
        for _ in range(3):
            for q, (cost, edits) in list(best.items()):
                to = 3 if q == 2 else 2
                best[to] = min(best.get(to, (10**9, "")), (cost + 2, edits + "I"))
        return best

    costs = inserted(costs)
    for symbol in symbols:
        fault, initial = divmod(symbol, 4)
        after = {}

        def offer(q, way, after=after):
            after[q] = min(after.get(q, (10**9, "")), way)

        for q, (cost, edits) in costs.items():
            offer(q, (cost + 3, edits + "D"))
            if fault > 1:
                continue
            to = {"s": {0: 1}, "u": {0: 2, 1: 2, 3: 2}, "a": {2: 3}, "?": {}}["sua?"[initial]].get(q)
            if to is not None:
                offer(to, (cost + fault, edits + "K"))
            offer(3 if q == 2 else 2, (cost + 2 + fault, edits + "R"))
        costs = inserted(after)
    return min(costs.get(q, (10**9, "")) for q in (0, 3))


@pytest.mark.parametrize("width", [1, 2, 3])
def test_audit_is_the_least_of_the_cheapest(width):
    for size in range(3):
        for symbols in itertools.product(range(16), repeat=size):
            assert conversations.audit(bytes(symbols), width) == cheapest(symbols)
    rng = random.Random(width)
    for _ in range(1500):
        symbols = bytes(rng.choice([0, 1, 2, 3, 5, 6, 9, 13]) for _ in range(rng.randrange(1, 14)))
        assert conversations.audit(symbols, width) == cheapest(symbols)


def replay(rows):
    """The report of one table, row by row."""
    by = defaultdict(list)
    for conv, turn, role, text in rows:
        role, text = (" " if v is None else v for v in (role, text))
        harm = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        by[conv]
        if harm == 0:
            continue
        if harm == 1:
            text = ""
        if harm == 2:
            text = text.translate({ord(c): None for c in ".!?"})
        if harm == 4:
            role = "user"
        by[conv] += [(turn, role, text)] * (2 if harm == 3 else 1)
    out = {}
    for conv, found in by.items():
        found.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), hashlib.sha256(r[2].encode()).digest()))
        seen, symbols, counts = set(), [], Counter()
        for _, role, text in found:
            kept = text.rstrip(" \t\n\v\f\r")
            fault = 2 if not kept else 3 if (role, text) in seen else 0 if kept[-1] in ".!?" else 1
            seen.add((role, text))
            counts[fault] += 1
            symbols.append(4 * fault + {"s": 0, "u": 1, "a": 2}.get(role[:1], 3))
        cost, audit = cheapest(symbols)
        turns = {t for t, _, _ in found if t is not None}
        lines, at = [], 0
        for edit in audit:
            if edit == "I":
                role, text = None, ""
            else:
                _, role, text = found[at]
                at += 1
            if edit != "D":
                lines.append((role if edit == "K" else ("assistant" if lines and lines[-1][0][0] == "u" else "user"), text))
        illegal = sum((a[1][:1] + b[1][:1]) not in ("su", "ua", "au") for a, b in itertools.pairwise(found))
        digest = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in lines).encode()).hexdigest()
        out[conv] = (max(turns) - min(turns) + 1 - len(turns) if turns else 0, counts[2], counts[3], counts[1], illegal, cost, audit, digest)
    return out


NAMES = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


@pytest.fixture(scope="module")
def talk(spark):
    rng = random.Random(5)
    roles = ["user", "assistant", "system", "tool", None, "", "User", "usher"]
    texts = ["Hello.", "Hello.", "no end", "", None, " \t", "Fine!\n ", "long " * 5000 + ".", "Ünï?", "a.b", "\x1c."]
    rows = [(c, rng.choice([None, t, t, t // 2]), rng.choice(roles[:2] + roles), rng.choice(texts)) for c in [*range(60), None] for t in range(rng.randrange(9))]
    rows += [(100, t, "user" if t % 2 == 0 else "assistant", f"Row {t % 90}.") for t in range(400)]  # one that holds a third
    rows += [(101, 1, "user", "Same.")] * 50 + [(102, None, None, None)] * 2
    rows += [(c, t, r, "x.") for c in range(200, 230) for t, r in enumerate(["user", "assistant"])]
    return rows, spark.createDataFrame([(*r, True, "d", 0, "a", 9) for r in rows], CONV)


@pytest.mark.parametrize("part_rows", [7, 1 << 16])
def test_repair_report(talk, part_rows):
    rows, df = talk
    got = {r["conv_id"]: tuple(r[n] for n in NAMES) for r in conversations.repair_report(df, part_rows).collect()}
    assert got == replay(rows)


def test_repair_report_in_sql(talk, spark):
    rows = [r for r in talk[0] if r[3] is None or "\x1c" not in r[3]]
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
    want = in_sql("op11_conversation_repair", conversations=df).sort_values("conv_id", na_position="first")
    got = conversations.repair_report(df).toPandas().sort_values("conv_id", na_position="first")
    for name in NAMES:
        assert got[name].tolist() == want[name].tolist(), name


def test_repaired_rows_alternate(talk):
    rows, df = talk
    damaged = conversations.damaged(df)
    reports = conversations.repaired(conversations.symbol_runs(conversations.cells(damaged))).cache()
    found = defaultdict(list)
    for r in conversations.repaired_rows(damaged, reports).orderBy("conv_id", "position").collect():
        found[r.conv_id].append(f"{r.role}:{r.text}")
    digests = {c: v[-1] for c, v in replay(rows).items()}
    assert found
    for conv, lines in found.items():
        assert hashlib.sha256("\n".join(lines).encode()).hexdigest() == digests[conv]


def test_repair_of_empty_table(talk):
    assert conversations.repair_report(talk[1].limit(0)).count() == 0


# -- op13 -------------------------------------------------------------------------------------------

DOCS = "doc_id bigint, text string, lang string, n bigint, word string, phrase string, path string"


def brute(rows, least, top=2000):
    f, total = Counter(), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        piece = []
        for word in [*phrases.tokens((text or "").encode()), phrases.BREAK]:
            if word != phrases.BREAK:
                piece.append(word)
                continue
            total[lang] += len(piece)
            for size in range(1, 6):
                for i in range(len(piece) - size + 1):
                    f[(lang, tuple(piece[i : i + size]))] += 1
            piece = []
    many = {k: n for k, n in f.items() if n >= least and len(k[1]) > 1}
    out = []
    for (lang, words), a in many.items():
        inside = any(
            x == lang and len(longer) > len(words) and n >= a and any(longer[i : i + len(words)] == words for i in range(len(longer)))
            for (x, longer), n in many.items()
        )
        if not inside:
            cuts = [(1000 * a * total[lang] // (f[(lang, words[:k])] * f[(lang, words[k:])]), k) for k in range(1, len(words))]
            score, k = min(cuts)
            out.append((lang, -score, -a, b" ".join(words), f[(lang, words[:k])], f[(lang, words[k:])], total[lang]))
    out.sort()
    ranked = [(r[0], i + 1, r[3].decode(), -r[2], r[4], r[5], r[6], -r[1]) for _, g in itertools.groupby(out, key=lambda r: r[0]) for i, r in enumerate(g)]
    return [r for r in ranked if r[1] <= top]


@pytest.fixture(scope="module")
def corpus(spark):
    rng = random.Random(3)
    words = ["a", "b", "c", "The", "the", "x\x01y", "x", "\x02", "é", "É", "zz", "q.", "r,s", "t\nu", "v\x0bw"]
    rows = [(" ".join(rng.choice(words) for _ in range(rng.randrange(40))), rng.choice(["en", "de", None, "und"])) for _ in range(300)]
    rows += [("hot line of five words", "en")] * 60 + [(None, "en"), ("", None), (" . ; ", "fr"), ("only " * 3000, "fr"), ("once", "es")]
    return rows, spark.createDataFrame([(i, *r, 1, "w", "p", "q") for i, r in enumerate(rows)], DOCS)


@pytest.mark.parametrize("least", [3, 25])
def test_collocations(corpus, least, spark, monkeypatch):
    rows, df = corpus
    got = phrases.collocations(df.repartition(5), least=least, bits=1 << 15).collect()
    assert sorted(map(tuple, got)) == sorted(brute(rows, least))
    got = phrases.collocations(df, least=least, top=5).collect()
    assert sorted(map(tuple, got)) == sorted(brute(rows, least, 5))


def test_collocations_in_sql(spark):
    rng = random.Random(4)
    rows = [(i, " ".join(rng.choice("a b c d. e".split()) for _ in range(60)), rng.choice(["en", None])) for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    want = in_sql("op13_phrases", documents=df)
    got = phrases.collocations(df).toPandas()
    assert len(got) > 50
    assert sorted(got.itertuples(index=False, name=None)) == sorted(want[got.columns].itertuples(index=False, name=None))


def test_collocations_of_empty_table(corpus):
    assert phrases.collocations(corpus[1].limit(0)).count() == 0


def test_scores_pass_64_bits():
    assert phrases.lowest_cut(10**12, 10**13, [10**12], [10**12]) == (1000 * 10**13 // 10**12, 10**12, 10**12)
    assert phrases.lowest_cut(100, 10**6, [200, 100], [100, 200]) == (1000 * 100 * 10**6 // 40000, 200, 200)


# -- op12 -------------------------------------------------------------------------------------------


def patterns(text, stems=None):
    reader = toxicity.Reader(stems or dict.fromkeys(toxicity.INSULTS, 4.0))
    return [[p for p, _ in hits] for _, hits in reader.clauses(text.lower())]


def test_grammar():
    assert patterns("You idiot. A fine day.") == [["insult:a"]]
    assert patterns("He is not an idiot") == [["insult:n"]]
    assert patterns("She said the plan is stupid; it is stupid") == [["insult:r"], ["insult"]]
    assert patterns("stupid stupid moron") == [["insult", "insult:m", "insult:m"]]
    assert patterns("I will kill you") == [["threat:i"]]
    assert patterns("we never kill time") == [["threat:n"]]
    assert patterns("you said you will not hurt him") == [["threat:ainr"]]
    assert patterns("") == patterns("a clean clause. and one more") == []


def test_composition_equals_the_cascade():
    """The composed tables give what the five transducers give one after the other."""
    to, out = toxicity.compiled(toxicity.grammar())
    chain = [toxicity.repeated(), toxicity.scope("intent", "i", 3, ("threat",)), toxicity.scope("target", "a", 4), toxicity.scope("negation", "n", 3), toxicity.scope("report", "r", None)]
    rng = random.Random(1)
    for _ in range(300):
        state, states = 0, [0] * 5
        for _ in range(12):
            symbol = rng.randrange(7)
            given = toxicity.CLASSES[symbol]
            for i, machine in enumerate(chain):
                states[i], given = machine.step(states[i], given)
            assert out[state][symbol] == (given if given.split(":")[0] in ("insult", "threat") else "")
            state = to[state][symbol]


def test_stems_are_chosen_short_and_safe():
    counts = [("idi", 90, 400), ("idio", 90, 2), ("idiot", 89, 0), ("idiots", 20, 0), ("xyz", 50, 0), ("xyza", 20, 0)]
    assert set(toxicity.chosen_stems(counts, 3.0, 100, 1000)) == {"idiot", "xyz"}


def test_toxicity_edges(spark):
    schema = "doc_id bigint, text string, lang string, toxic int, x array<double>, stem string, score double, held_out int"
    plain, rude = "the weather was calm and the river was low", "the weather was calm, you gorple fool"
    rows = [(i, f"{plain} {i}" if i % 3 else f"{rude} {i}", "en", 0, None, "s", 0.0, 1) for i in range(120)]
    rows += [(200, None, None, 0, None, "s", 0.0, 1), (201, "", "en", 0, None, "s", 0.0, 1), (None, rude, "en", 0, None, "s", 0.0, 1), (None, None, None, 0, None, None, None, None)]
    rows += [(202, "calm " * 200_000 + "gorple", "en", 0, None, "s", 0.0, 1), (3, rude, "en", 0, None, "s", 0.0, 1)]
    docs = spark.createDataFrame(rows, schema)
    marks = [(i, int(i % 3 == 0), "t") for i in range(120)] + [(1, None, "t"), (None, 1, "t"), (3, 0, "t")]
    labels = spark.createDataFrame(marks, "doc_id bigint, toxic int, text string")
    got = toxicity.scores(docs, labels).collect()
    assert len(got) == len(rows)
    by = defaultdict(list)
    for r in got:
        assert 0 <= r.score <= 1
        assert r.held_out == (zlib.crc32(("" if r.doc_id is None else str(r.doc_id)).encode()) % 3 == 1)
        by[r.doc_id].append(r.score)
    assert by[200] == by[201] and by[200][0] < 0.5
    assert min(by[i][0] for i in range(0, 120, 3)) > 0.7 > 0.3 > max(by[i][0] for i in range(1, 120, 3))
    assert by[202][0] > 5 * by[201][0]  # its only match is the last of 200,000 words
    assert toxicity.scores(docs.limit(0), labels).count() == 0
    unlabelled = toxicity.scores(docs, labels.limit(0)).collect()
    assert max(r.score for r in unlabelled if r.doc_id == 0) > max(r.score for r in unlabelled if r.doc_id == 1)
    found = toxicity.matched_clauses(docs, {"gorple": 3.0}).collect()
    assert {(r.pattern, r.clause) for r in found if r.doc_id == 0} == {("insult:a", "the weather was calm, you gorple fool 0")}


def test_toxicity_held_out(spark):
    """Documents that weren't learned from are told apart."""
    folder = "/root/testdata/sf0.1"
    if not os.path.exists(folder):
        pytest.skip("no tables")
    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    found = toxicity.scores(docs, labels).join(labels, "doc_id").filter(remainder(3) == 1).select("score", "toxic").collect()
    caught = [r.score >= 0.7 for r in found if r.toxic == 1]
    wrong = [r.score >= 0.7 for r in found if r.toxic == 0]
    assert sum(caught) / len(caught) > 0.85
    assert sum(wrong) / len(wrong) < 0.01
