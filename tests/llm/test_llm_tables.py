"""The operators on whole tables: nulls in every column, empty and very long texts, repeated rows, empty tables, and
extra columns with names that the operators use themselves."""

import collections
import math
import zlib

import numpy as np
import pandas as pd
import public_tokenizers
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from txnrisk.llm import components, decontaminate, extract, langid, lm, mixing, quality, simhash, tokens, topk, warc
from txnrisk.llm.common import remainder
from txnrisk.llm.queries import ORACLES, QUERIES

WORDS = public_tokenizers.path("word_bpe_49k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")
CLASH = "_row string, key string, fp bigint, score double, _text string, _id string, component_id string, `row` string, _slot int"
DOCS = f"doc_id bigint, text string, lang string, source string, n_chars bigint, {CLASH}"
LONG = "the quick brown fox jumps over the lazy dog " * 40_000


def doc(i, text, lang="en", source="a"):
    return (i, text, lang, source, None if text is None else len(text), "r", None, 1, 0.5, "t", "i", "c", "w", 3)


@pytest.fixture(scope="module")
def docs(spark):
    plain = "It was the best of times, it was the worst of times, it was the age of wisdom and of foolishness"
    rows = [
        doc(1, plain), doc(2, plain), doc(2, plain), doc(3, None), doc(4, ""), doc(5, " \n\t "), doc(6, "123 456 !!"),
        doc(7, LONG), doc(8, "une phrase en français pour voir si cela marche bien", "fr", "b"), doc(9, "word", None, None),
        doc(None, "a text without an id, in english", "en", None), doc(10, "Ein deutscher Satz über die Straße und den Fluß", "de", "b"),
        doc(11, plain.replace("wisdom", "reason"), "en", "c"), doc(None, None, None, None), doc(12, "\x1c\x85 é <|endoftext|> Ünï", "en", "c"),
    ]
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def test_tokens(docs, empty):
    got = tokens.tokenized(docs, WORDS).toPandas().sort_values(["shard", "nth"])
    rows = sorted(((-1 if r.doc_id is None else r.doc_id, r.text or "") for r in docs.collect()))
    library = tokens.Encoder(WORDS).tokenizer
    start = 0
    for (i, text), r in zip(rows, got.itertuples(), strict=True):
        ids = [*library.encode(text, add_special_tokens=False).ids, 2]
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32) == (i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    assert tokens.tokenized(empty, WORDS).count() == 0


def test_mixing(docs, empty):
    placed = mixing.scheduled(docs, block_docs=2, period=16)
    assert placed.count() == docs.count()
    mixed = mixing.mixed(docs, block_docs=2, period=16)
    assert mixed.columns == docs.columns
    key = lambda r: tuple(map(str, r))
    assert sorted(map(key, mixed.collect())) == sorted(map(key, docs.collect()))
    given = mixing.scheduled(docs, {"a": 3.0, "b": 1.0}, block_docs=1, period=16)
    assert {r.stream for r in given.select("stream").distinct().collect()} == {"a", "b", mixing.REST}
    assert mixing.scheduled(empty).count() == 0 and mixing.mixed(empty).columns == docs.columns


def test_mixing_deviation(spark):
    """A third of all rows in one source: while all sources last, each has its share to within a block."""
    rows = [doc(i, f"text {i}", "en", "hot" if i % 3 == 0 else f"s{i % 7}") for i in range(3000)]
    weights = {"hot": 0.25, **{f"s{i}": 0.75 / 7 for i in range(7)}}
    placed = mixing.scheduled(spark.createDataFrame(rows, DOCS), weights, block_docs=4, period=1024).toPandas()
    assert placed.groupby("slot").size().max() <= 4 and placed["slot"].nunique() == placed.groupby(["stream", "block"]).ngroups
    blocks = placed.groupby(["stream", "block"])["slot"].first().reset_index()
    last = blocks.groupby("stream")["slot"].max().min()  # until the first source runs out
    slots = mixing.rounded_weights(weights, 1024)
    for slot in range(int(last)):
        done = blocks[blocks["slot"] <= slot].groupby("stream").size()
        for s, q in slots.items():
            assert abs(done.get(s, 0) - q / 1024 * (slot + 1)) < 1


def test_simhash(docs, empty, spark):
    got = simhash.near_duplicates(docs).toPandas()
    rows = [(r.doc_id, simhash.fingerprint((r.text or "").encode())) for r in docs.collect()]
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    assert collections.Counter((None if pd.isna(a) else int(a), b) for a, b in zip(got.doc_id, got.fp, strict=True)) == collections.Counter((a, signed(b)) for a, b in rows)
    by = {int(a): int(c) for a, c in zip(got.doc_id, got.component_id, strict=True) if not pd.isna(a)}
    assert by[2] == 1 and by[3] == by[4] == by[5] == 3 and by[8] == 8
    kept = [r.doc_id for r in simhash.keep_one(docs).select("doc_id").collect()]
    assert sorted(x for x in kept if x is not None) == sorted({c for i, c in by.items()}) and kept.count(None) == 2
    shuffled = simhash.keep_one(docs, broadcast_ids=0)
    assert sorted(map(repr, shuffled.collect())) == sorted(map(repr, simhash.keep_one(docs).collect()))
    assert simhash.near_duplicates(empty).count() == 0 and simhash.keep_one(empty).columns == docs.columns


def test_long_buckets_are_dealt_in_pairs_of_blocks(spark):
    rng = np.random.default_rng(1)
    centre = int(rng.integers(0, 2**62))
    fps = np.unique([centre ^ (1 << int(a)) ^ (1 << int(b)) for a, b in rng.integers(0, 64, (400, 2))] + [int(x) for x in rng.integers(0, 2**62, 300)])
    frame = spark.createDataFrame([(int(x),) for x in fps.astype(np.uint64).view(np.int64)], "fp bigint")
    found = {}
    for limit in (100_000, 7):
        links = simhash.links(frame, 4, bucket_rows=limit)
        found[limit] = {(r.node, r.component) for r in components.components(links).collect()}
    assert found[7] == found[100_000] and found[7]


def test_components(spark):
    rng = np.random.default_rng(2)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 300, (200, 2))] + [(i, i + 1) for i in range(1000, 1200)] + [(5000, i) for i in range(5001, 5400)]
    frame = spark.createDataFrame([*edges, (None, 3), (7, 7)], "u bigint, v bigint")
    parent = {x: x for e in edges for x in e}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    got = {r.node: r.component for r in components.components(frame).collect()}
    assert got == {x: find(x) for x in parent if any(x in e and e[0] != e[1] for e in edges)}


def test_quality(docs, empty, spark):
    labels = spark.createDataFrame([(1, 1, None, "x"), (2, 1, 0, "x"), (2, 0, 0, "x"), (7, 0, 0, "x"), (None, 1, 0, "x"), (8, None, 1, "x"), (99, 1, 0, "x")], "doc_id bigint, quality int, toxic int, score string")
    got = quality.scores(docs, labels).toPandas()
    assert len(got) == docs.count() and got["score"].between(0, 1).all() and got["held_out"].dtype == bool
    none = labels.limit(0)
    assert quality.scores(docs, none).select("score").distinct().count() == 1
    assert quality.scores(empty, labels).count() == 0


def test_language(docs, empty):
    langs, p = langid.fit(docs, PIECES, F.lit(True))
    assert langs == ["de", "en", "fr"] and np.allclose(p.sum(axis=1), 1, atol=1e-3)
    got = langid.predict(docs, PIECES, langs, p, docs.columns)
    assert got.columns == [*docs.columns, "lang_pred", "score"]
    rows = langid.predict(docs.drop("score"), PIECES, langs, p, ["doc_id", "text"]).collect()
    for r in rows:
        if not any(c.isalpha() for c in r.text or ""):
            assert (r.lang_pred, r.score) == ("und", 0.0)
    by = {r.doc_id: r.lang_pred for r in rows}
    assert (by[8], by[10], by[1], by[7]) == ("fr", "de", "en", "en")
    nothing = langid.fit(empty, PIECES)
    assert nothing[0] == [] and {r.lang_pred for r in langid.predict(docs, PIECES, *nothing, ["doc_id"]).collect()} == {"und"}
    assert langid.predict(empty, PIECES, langs, p, ["doc_id"]).count() == 0


def test_decontamination(docs, empty, spark):
    items = spark.createDataFrame([(1, "the worst of times"), (10, "It was the best of times, it was the worst of times, it was the"), (2, None), (None, "word"), (3, "!!"), (4, "nowhere to be found"), (1, "the worst of times")], "item_id bigint, text string")
    for block in (200_000, 3):
        got = {r.doc_id: r for r in decontaminate.contamination(docs, items, block_words=block).collect()}
        assert (got[1].n_hit, got[1].n_items, got[1].contaminated, got[1].n_words) == (15, 2, True, 21)
        import hashlib

        assert got[1].items_sha256 == hashlib.sha256(b"1,10").hexdigest() and got[3].items_sha256 == hashlib.sha256(b"").hexdigest()
        assert (got[3].n_words, got[9].n_hit) == (0, 0)
    clean = decontaminate.cleaned(docs, items, coverage=0.9)
    assert clean.columns == docs.columns and clean.count() == docs.count()
    text = {r.doc_id: (r.text, r.n_chars) for r in clean.collect()}
    assert "worst" not in text[1][0] and text[1][1] == len(text[1][0]) and text[3][0] is None
    assert {r.doc_id for r in decontaminate.cleaned(docs, items).collect()}.isdisjoint({1, 2, 11})
    small = decontaminate.cleaned(docs, items, coverage=0.9, block_words=3)  # one pass a block
    assert {r.doc_id: (r.text, r.n_chars) for r in small.collect()} == text
    edge = spark.createDataFrame([(1, "a b c d e f g " + "x " * 133), (2, "a b c d e f g " + "x " * 134)], "doc_id bigint, text string")
    seven = spark.createDataFrame([(1, "a b c d e f g")], "item_id bigint, text string")
    assert [r.doc_id for r in decontaminate.cleaned(edge, seven).collect()] == [2]  # exactly a twentieth goes
    assert decontaminate.contamination(docs, items.limit(0)).filter("n_hit > 0").count() == 0
    assert decontaminate.contamination(empty, items).count() == decontaminate.cleaned(empty, items).count() == 0


def test_language_model(docs, empty):
    rows = [((r.text or "").encode().lower().split() + [b""], zlib.crc32(b"" if r.doc_id is None else str(r.doc_id).encode()) % 10 != 0) for r in docs.collect()]
    seen, pairs = collections.Counter(), collections.Counter()
    for words, used in rows:
        if used:
            seen.update(words)
            pairs.update(zip([b"", *words], words, strict=False))
    n, after = sum(seen.values()), collections.Counter(u for u, _ in pairs)
    p1 = lambda w: (seen[w] + 0.1) / (n + 0.1 * (len(seen) + 1))
    want = collections.Counter()
    for words, _ in rows:
        base = sum(math.log10(p1(w)) for w in words)
        score = sum(math.log10((max(pairs[u, w] - 0.75, 0) / seen[u] + 0.75 * after[u] / seen[u] if seen[u] else 0) and (max(pairs[u, w] - 0.75, 0) / seen[u] + 0.75 * after[u] / seen[u] * p1(w)) or p1(w)) for u, w in zip([b"", *words], words, strict=False))
        want[len(words), sum(w in seen for w in words), round(base, 5)] += 1
        want["score"] += score
    got = lm.scored(docs, lm.train(docs, remainder(10) != 0)).collect()
    tally = collections.Counter((r.n_tokens, r.n_known, round(r.base_score, 5)) for r in got)
    assert tally == collections.Counter({k: v for k, v in want.items() if k != "score"}) and {r.train_tokens for r in got} == {n}
    assert sum(r.score for r in got) == pytest.approx(want["score"], rel=1e-3)
    nothing = lm.train(empty)
    assert {r.n_known for r in lm.scored(docs, nothing).collect()} == {0} and lm.scored(empty, nothing).count() == 0


PAGES = "page_id bigint, url string, html string, _page string, kind string, offset int"


def test_pages(spark):
    html = "<article><p>Text é of a page.</p></article>"
    rows = [(1, "u", html), (2, None, html), (2, None, html), (3, "u", None), (4, "u\r\nX", ""), (None, "u", html), (5, "u", "other"), (6, "u", "<p>" + "word " * 400_000)]
    pages = spark.createDataFrame([(*r, "x", "y", 1) for r in rows], PAGES)
    read = warc.read_archives(warc.write_archives(pages), payloads=True).collect()
    assert {r.kind for r in read} == {"record"}
    got = sorted(((r.page_id or 0, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in read), key=str)
    last = {}
    for i, _, h in rows:
        last[h or ""] = max(last.get(h or "", 0), i or 0)
    want = []
    for i, _, h in rows:
        data, original = (h or "").encode(), last[h or ""]
        again = i is not None and i != original
        want.append((i or 0, len(data), warc.digest(data), "revisit" if again else "response", original if again else None))
    assert got == sorted(want, key=str)
    assert {bytes(r.payload).decode() for r in read if r.record_type == "response"} == {h or "" for _, _, h in rows}
    small = warc.read_archives(warc.write_archives(pages, revisit_bytes=10_000)).filter("record_type = 'revisit'")
    assert small.count() == 0
    texts = {r.page_id: (r.text, r.n_chars) for r in extract.extracted(pages).collect()}
    assert texts[1] == ("Text é of a page.", 17) and texts[3] == texts[4] == ("", 0) and texts[6][1] == 5 * 400_000 - 1
    none = pages.limit(0)
    assert warc.read_archives(warc.write_archives(none)).count() == extract.extracted(none).count() == 0


def test_top_k(spark):
    rng = np.random.default_rng(4)
    base = rng.normal(size=(40, 64)).tolist()
    rows = [(i, base[0] if i % 3 == 0 else base[i % 40], 0, "c", 1) for i in range(300)]
    rows += [(300, None, 0, "c", 1), (None, base[1], 0, "c", 1), (301, [float("nan")] * 64, 0, "c", 1), (302, [], 0, "c", 1), (303, [None, 1.0], 0, "c", 1)]
    frame = topk.sign_codes(spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label int, id string, `rank` int"))
    codes = {r.vec_id: r.code for r in frame.filter("vec_id is not null and code is not null").collect()}
    assert 300 not in codes and codes[301] == codes[302] == 0 and codes[303] == 2
    items = frame.select(F.col("vec_id").alias("id"), "code")
    got = collections.defaultdict(list)
    for r in topk.nearest(items, items.filter("id % 20 = 0"), k=10, block_codes=16, block_queries=4).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.distance, r.id))
    mask = (1 << 64) - 1
    for q in got:
        assert got[q] == sorted((((codes[q] ^ c) & mask).bit_count(), i) for i, c in codes.items())[:10]
    assert set(got) == {i for i in codes if i % 20 == 0}
    assert topk.nearest(items.limit(0), items.limit(0)).count() == 0


def test_pipeline_stages(docs, empty, spark, tmp_path):
    items = spark.createDataFrame([(1, "the worst of times")], "item_id bigint, text string")
    items.write.parquet(f"{tmp_path}/benchmark.parquet")
    for table in (docs, empty):
        rows = table
        for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
            stage(spark, rows, str(tmp_path)).write.parquet(f"{tmp_path}/{table.count()}-{name}")
            rows = spark.read.parquet(f"{tmp_path}/{table.count()}-{name}")
            if i < 4:
                assert rows.columns == docs.columns
        before = spark.read.parquet(f"{tmp_path}/{table.count()}-mix")
        assert rows.count() == before.count()


def test_mixing_keeps_to_the_unrounded_weights(spark):
    """Square roots of the sizes, to within a block at every slot until a source runs out; a tiny source is a stream."""
    sizes = {"a": 700, "b": 310, "c": 90, "d": 1}
    rows = [doc(i, f"text {i}", "en", s) for i, s in enumerate(s for s, n in sizes.items() for _ in range(n))]
    placed = mixing.scheduled(spark.createDataFrame(rows, DOCS), block_docs=1).toPandas()
    assert placed.groupby("stream").size().to_dict() == sizes and placed["slot"].nunique() == len(placed)
    total = sum(n**0.5 for n in sizes.values())
    last = placed.groupby("stream")["slot"].max()
    streams = {s: sorted(placed.loc[placed["stream"] == s, "slot"]) for s in sizes}
    for s, slots in streams.items():
        w = sizes[s] ** 0.5 / total
        for slot in range(int(last[s])):
            assert abs(np.searchsorted(slots, slot, side="right") - w * (slot + 1)) < 1
        order = placed[placed["stream"] == s].sort_values("slot")
        assert list(order["block"]) == list(range(sizes[s]))


def test_pipeline_keeps_the_order_of_the_mix(spark, tmp_path):
    rows = [doc(i, f"one two three number {i} and {i * i} then {i % 11}", "en", f"s{i % 3}") for i in range(500)]
    mixed = mixing.mixed(spark.createDataFrame(rows, DOCS), {"s0": 2.0, "s1": 1.0, "s2": 1.0}, block_docs=8, period=16)
    mixed.write.parquet(f"{tmp_path}/mixed")
    stored = spark.read.parquet(f"{tmp_path}/mixed")
    order = [r.doc_id for r in stored.orderBy(*mixing.file_order()).collect()]
    got = corpus_pipeline.token_shards(spark, stored, str(tmp_path)).orderBy("start").collect()
    assert [r.doc_id for r in got] == order
    assert [i % 3 for i in order[:32]].count(0) == 16


def test_all_queries_are_registered():
    assert sorted(int(q[2:].split("_")[0]) for q in QUERIES) == list(range(1, 14))
    assert set(ORACLES) <= set(QUERIES)
