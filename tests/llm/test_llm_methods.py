"""The cores of the corpus operators against plain versions of the same definitions."""

import base64
import hashlib
import io
import itertools
import math
import random
import re

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from txnrisk.llm import decontaminate, extract, langid, lm, mixing, pfor, quality, simhash, tokens, topk, warc
from txnrisk.llm.eliasfano import EliasFano


# ------------------------------------------------------------------ token ids
@settings(deadline=None, max_examples=60)
@given(st.lists(st.integers(0, 2**32 - 1) | st.integers(0, 300), max_size=700), st.sampled_from([50, 90, 100]))
def test_pfor_round_trip(ids, percentile):
    ids = np.array(ids, np.uint32)
    data, offsets = pfor.encode(ids, percentile)
    assert (pfor.decode(data, offsets) == ids).all()


class Source(io.BytesIO):
    def size(self):
        return len(self.getbuffer())

    def read_at(self, n, at):
        return bytes(self.getbuffer()[at : at + n])


def test_shard_is_read_from_any_place():
    rng = np.random.default_rng(0)
    docs = [rng.zipf(1.4, n).clip(0, 2**32 - 1).astype(np.uint32) for n in (0, 1, 127, 128, 129, 5000, 3)]
    out = io.BytesIO()
    writer = pfor.ShardWriter(out, flush=300)
    for i, ids in enumerate(docs):
        writer.add(np.array([i]), np.array([len(ids)]), ids)
    assert writer.close() == (len(docs), sum(map(len, docs)))
    reader, flat = pfor.ShardReader(Source(out.getvalue())), np.concatenate(docs)
    assert (np.concatenate(list(reader.runs(3))) == flat).all()
    for a, b in ((0, 0), (0, 1), (127, 129), (500, 5100), (5387, 5388)):
        assert (reader.ids(a, b) == flat[a:b]).all()
    with pytest.raises(ValueError):
        pfor.ShardReader(Source(out.getvalue()[:-1]))


ODD_TEXTS = [
    "", "   ", "a<|endoftext|>b <|ENDOFTEXT|> X", "It's we'LL don't. Été É! 3.14,x 'S", "a b\x1cc\x85d ﬁ İstanbul ΣΑΣ. é.",
    "x.!?.y a,b,, ,a 漢字テスト. 'tis", "don't!", "ab́ cd.́ ef,̈", "  a. b", "WORD " * 3000, "THE!! THE!!", "\U0001f600a. 1a2b",
]


def test_encoder_equals_the_library():
    encode = tokens.Encoder(public_tokenizers.path("word_bpe_49k.json"), remember=50)
    for texts in (ODD_TEXTS, ODD_TEXTS[::-1], [" ".join(ODD_TEXTS)]):
        ids, lengths = encode.encode([t.encode() for t in texts])
        want = [e.ids for e in encode.tokenizer.encode_batch(texts, add_special_tokens=False)]
        assert lengths.tolist() == [len(w) for w in want]
        assert ids.tolist() == list(itertools.chain.from_iterable(want))


def test_a_full_encoder_keeps_the_chunks_that_most_calls_met():
    encode = tokens.Encoder(public_tokenizers.path("word_bpe_49k.json"), remember=120)
    common, emptied = b"the river, runs to the sea.", 0
    for i in range(40):
        rare = b" ".join(bytes([97 + i % 26, 97 + i // 26, 97 + j]) for j in range(20))
        before = len(encode.known)
        ids, lengths = encode.encode([rare if i % 3 else common + b" " + rare])
        want = encode.tokenizer.encode((rare if i % 3 else common + b" " + rare).decode(), add_special_tokens=False).ids
        assert ids.tolist() == want and lengths.tolist() == [len(want)]
        emptied += i % 3 > 0 and len(encode.known) < before
        assert len(encode.known) <= 120 + 30
        assert set(common.split()) <= set(encode.known)
    assert emptied


def test_the_tokenizer_gets_bounded_texts(monkeypatch):
    monkeypatch.setattr(tokens, "TOGETHER", 100)
    encode = tokens.Encoder(public_tokenizers.path("word_bpe_49k.json"))
    text = " ".join(f"w{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}{chr(97 + i // 676)}" for i in range(2000))
    sizes = []

    class Counting:
        def encode_batch_fast(self, texts, **options):
            sizes.extend(len(t.split()) for t in texts)
            return library.encode_batch_fast(texts, **options)

    library, encode.tokenizer = encode.tokenizer, Counting()
    ids, lengths = encode.encode([text.encode()])
    assert ids.tolist() == library.encode(text, add_special_tokens=False).ids and lengths.tolist() == [len(ids)]
    assert sum(sizes) == 2000 and max(sizes) == 100


# ------------------------------------------------------------------ mixing
@pytest.mark.parametrize("seed", range(8))
def test_pfair_deviation_is_less_than_a_block(seed):
    rng = random.Random(seed)
    period = 97 + 20 * seed
    slots = mixing.rounded_weights({f"s{i}": rng.random() ** 3 + 1e-6 for i in range(rng.randrange(1, 20))}, period)
    assert sum(slots.values()) == period and min(slots.values()) >= 1
    plan = mixing.pattern(slots)
    done = dict.fromkeys(slots, 0)
    for stream, turn, slot in plan:
        assert turn == done[stream]
        done[stream] += 1
        for s, q in slots.items():  # exact arithmetic in slots / period
            assert abs(done[s] * period - q * (slot + 1)) < period
    assert done == slots


# ------------------------------------------------------------------ near-duplicates
def plain_fingerprint(text):
    from xxhash import xxh64_intdigest

    words = re.findall(rb"[^\x20\x09-\x0D]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), text.encode()))
    if not words:
        return 0
    hashes = [xxh64_intdigest(b" ".join(words[i : i + 4]), 42) for i in range(max(1, len(words) - 3))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


@pytest.mark.parametrize("text", ["", " \n", "One", "a b c", "a b c d", "A b C d e", "x " * 500, "Été\x1cÀ b\x0bc d e f", "a\xa0b c d e f g"])
def test_fingerprint(text):
    assert simhash.fingerprint(text.encode()) == plain_fingerprint(text)


def grouped(nodes, edges):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        parent[find(a)] = find(b)
    return {frozenset(m for m in nodes if find(m) == find(n)) for n in nodes}


@pytest.mark.parametrize("short", [2, 16])
def test_bucket_links_connect_what_all_links_connect(short):
    rng = np.random.default_rng(3)
    centres = rng.integers(0, 2**63, 12, dtype=np.uint64)
    fps = [int(c) for c in centres]
    for c in centres.tolist():
        for _ in range(25):
            fps.append(c ^ sum(1 << int(b) for b in rng.choice(64, rng.integers(0, 6), replace=False)))
    fps = np.unique(np.array(fps, np.uint64))
    keys, members = simhash.signatures(fps, 4)
    order = np.argsort(keys.view(np.int64), kind="stable")
    u, v = simhash.links_of_sorted(keys[order], members[order], 4, short)
    near = np.bitwise_count(fps[:, None] ^ fps[None, :]) <= 4
    assert (np.bitwise_count(u ^ v) <= 4).all()
    want = grouped(fps.tolist(), [(int(fps[a]), int(fps[b])) for a, b in zip(*np.nonzero(near), strict=True)])
    assert grouped(fps.tolist(), zip(u.tolist(), v.tolist(), strict=True)) == want
    c, p = simhash._forest_cut(fps, 4)
    assert grouped(fps.tolist(), zip(np.concatenate(c).tolist(), np.concatenate(p).tolist(), strict=True)) == want


# ------------------------------------------------------------------ decontamination
@pytest.mark.parametrize("seed", range(40))
def test_automaton_against_brute_force(seed):
    rng = random.Random(seed)
    window, letters = rng.choice([2, 3, 4]), [b"a", b"b", b"c", b"d"][: rng.choice([2, 3, 4])]
    items = [(i, [rng.choice(letters) for _ in range(rng.randrange(0, 8))]) for i in range(rng.randrange(1, 6))]
    automaton = decontaminate.Automaton(items, window)
    for _ in range(15):
        words = [rng.choice([*letters, b"z"]) for _ in range(rng.randrange(0, 30))]
        hit, occurring = [False] * len(words), set()
        for item, w in items:
            for x in [w[j : j + window] for j in range(len(w) - window + 1)] if len(w) >= window else [w] if w else []:
                for at in range(len(words) - len(x) + 1):
                    if words[at : at + len(x)] == x:
                        occurring.add(item)
                        hit[at : at + len(x)] = [True] * len(x)
        spans, found = automaton.occurrences(words)
        assert found == occurring
        assert [any(a <= i < b for a, b in spans) for i in range(len(words))] == hit


def test_spans_are_cut_out_of_the_text():
    assert decontaminate.without(b"One, two three. Four!", [(1, 3)]) == b"One, . Four!"
    assert decontaminate.words_of("It's Été—3x".encode()) == ["it".encode(), b"s", "Été—3x".lower().replace("é", "É", 1).encode()]


# ------------------------------------------------------------------ language
class Toy:
    """A vocabulary of given pieces, without a model file."""

    def __new__(cls, names):
        vocab = object.__new__(langid.Pieces)

        class Fake:
            def __init__(self, **_):
                pass

            __len__ = lambda self: len(names)
            id_to_piece = lambda self, i: names[i]
            is_control = is_unknown = is_byte = lambda self, i: False

        import sentencepiece

        kept, sentencepiece.SentencePieceProcessor = sentencepiece.SentencePieceProcessor, Fake
        try:
            vocab.__init__("toy")
        finally:
            sentencepiece.SentencePieceProcessor = kept
        return vocab


def segmentations(word, names):
    if not word:
        yield []
    for n in range(1, len(word) + 1):
        piece = word[:n]
        if piece in names or n == 1:
            for rest in segmentations(word[n:], names):
                yield [piece, *rest]


def test_forward_sums_all_segmentations():
    vocab = Toy(["▁", "▁a", "a", "ab", "b", "ba", "▁ab", "bab"])
    names = {n: i for i, n in enumerate(vocab.names)}
    rng = np.random.default_rng(0)
    p = rng.random((3, len(names) + 1))
    words = ["a", "ab", "abab", "bab", "xaby", "b"]
    lattice = langid.Lattice(vocab, words)
    weight = lambda row, pieces: math.prod(row[names.get(x, vocab.unknown)] for x in pieces)
    for i, word in enumerate(words):
        every = list(segmentations("▁" + word, names))
        for lang in range(3):
            assert lattice.totals(p)[i, lang] == pytest.approx(sum(weight(p[lang], s) for s in every))
        share = lattice.expected(p[0])
        counts = np.bincount(lattice.piece[lattice.word == i], share[lattice.word == i], len(names) + 1)
        total = sum(weight(p[0], s) for s in every)
        want = np.zeros(len(names) + 1)
        for s in every:
            for x in s:
                want[names.get(x, vocab.unknown)] += weight(p[0], s) / total
        assert counts == pytest.approx(want)


# ------------------------------------------------------------------ quality
def test_non_negative_risk_separates_without_negatives():
    rng = np.random.default_rng(0)
    good, bad = rng.normal(1, 0.5, (3000, 4)), rng.normal(-1, 0.5, (3000, 4))
    unlabelled = np.concatenate([good[1500:], bad[:500]])
    w, b = quality.fit_risk(good[:1500], unlabelled, prior=0.75)
    score = lambda x: 1 / (1 + np.exp(-(x @ w + b)))
    assert (score(good) > 0.5).mean() > 0.97 and (score(bad) < 0.5).mean() > 0.97


def test_figures_are_finite():
    for text in (b"", b" ", b"\n", b"A", b"!" * 100_000, "é".encode() * 50, b"\xff\xfe", b"a a a a"):
        assert np.isfinite(quality.figures(text)).all()


# ------------------------------------------------------------------ HTML
@pytest.mark.parametrize(
    "html,text",
    [
        ("", ""),
        ("<p>", ""),
        ("plain &amp; simple", "plain & simple"),
        ("<body><nav><a href=x>a menu</a></nav><article><h1>T</h1><p><b>One<br><p>Two  &eacute;\n three</article><footer>f</footer>", "T\n\nOne\n\nTwo é three"),
        ("<article><p>Long enough text here.</p><div class='comments'><p>First!</p></div><form><p>Mail</p></form></article>", "Long enough text here."),
        ("<script>var t='</p><p>no';</script><div><p>Yes, it is.</p><p>And more of it.</p></div><!-- <p>no</p> -->", "Yes, it is.\n\nAnd more of it."),
        ("<div id=sidebar><p>Links of all kinds stand here</p></div><div><p>A story.</p><p>Its end.</p></div>", "A story.\n\nIts end."),
        ("<article><p>Cut off in a tag <a href=", "Cut off in a tag"),
        ("<article><p>a < b & c</p><p title='>'>d</p></article>", "a < b & c\n\nd"),
        ("<ul><li>one<li>two</ul>", "one\n\ntwo"),
    ],
)
def test_main_text(html, text):
    assert extract.main_text(html) == text


def _paragraphs(length, count):
    return [" ".join(["word"] * (length // 5))] * count


def _html(paragraphs):
    return "".join(f"<p>{p}</p>" for p in paragraphs)


LONG_PART, SMALL_PART = _paragraphs(300, 20), _paragraphs(500, 2)


@pytest.mark.parametrize(
    "html,want",
    [
        (f"<div class=post><div>{_html(LONG_PART)}</div><div>{_html(SMALL_PART)}</div></div>", LONG_PART + SMALL_PART),
        (
            f"<div class=post><h2>A heading</h2><p>An introduction.</p><div>{_html(LONG_PART)}</div></div><div><a href=x>a link</a></div>",
            ["A heading", "An introduction.", *LONG_PART],
        ),
        (f"<div title='read class=\"ad\" here'>{_html(LONG_PART)}</div><div>{_html(SMALL_PART)}</div>", LONG_PART + SMALL_PART),
        (f"<div title='see id=sidebar and hidden text'>{_html(LONG_PART)}</div>", LONG_PART),
        (f"<div data-x=1 class=sidebar>{_html(SMALL_PART)}</div><div>{_html(LONG_PART)}</div>", LONG_PART),
        (f"<div>{_html(LONG_PART)}</div><div hidden>{_html(SMALL_PART)}</div>", LONG_PART),
    ],
)
def test_main_text_without_article(html, want):
    assert extract.main_text(f"<body>{html}</body>") == "\n\n".join(want)


def test_hostile_html_ends():
    for html in ("<p>" * 30_000, "<div>" * 30_000 + "x", "<a '" * 20_000, "</p>" * 50_000, "<" * 50_000, "<!--" * 20_000):
        assert isinstance(extract.main_text(html), str)


# ------------------------------------------------------------------ WARC
def archive(payloads, compressed=True):
    data = [warc.record(i, f"http://x/{i}", p, None) for i, p in enumerate(payloads)]
    return [warc.member(d, 4) if compressed else d for d in data]


def read(data, window=64):
    return list(warc.salvage(Source(data), window=window))


@pytest.mark.parametrize("compressed", [True, False])
def test_round_trip(compressed):
    payloads = [b"", b"x" * 10_000, "é\r\n\r\nWARC/1.1\r\n".encode(), bytes(range(256)) * 20]
    parts = archive(payloads, compressed)
    found = read(b"".join(parts))
    assert [f[2].payload for f in found] == payloads
    assert [(f[0], f[1]) for f in found] == [(sum(map(len, parts[:i])), len(parts[i])) for i in range(4)]


@pytest.mark.parametrize("compressed", [True, False])
def test_salvage_recovers_later_records(compressed):
    rng = random.Random(5)
    payloads = [bytes(rng.randrange(256) for _ in range(rng.randrange(1, 900))) for _ in range(12)]
    parts = archive(payloads, compressed)
    broken = bytearray(parts[3])
    broken[len(broken) * 2 // 3] ^= 0xFF
    data = b"".join([b"junk", *parts[:3], bytes(broken), *parts[4:7], b"\x1f\x8b\x08junk WARC/1.1\r\n", *parts[7:], parts[0][:-9]])
    found = read(data)
    assert [f[2].payload for f in found if f[2]] == payloads[:3] + payloads[4:]
    assert sum(f[1] for f in found) == len(data) and all(f[3] for f in found if f[2] is None)
    at = 0
    for offset, length, _, _ in found:  # records and gaps cover every byte once
        assert offset == at
        at += length
    assert [f[1] for f in found if f[2] is None][0] == 4


def test_a_window_is_read_once_for_all_its_records():
    data = b"".join(archive([b"x" * 50 * i for i in range(60)]))
    asked = []

    class Counting(Source):
        def read_at(self, n, offset):
            asked.append(n)
            return super().read_at(n, offset)

    found = list(warc.salvage(Counting(data), window=len(data) // 4))
    assert len(found) == 60 and all(f[2] for f in found)
    assert sum(asked) <= 2 * len(data)


@pytest.mark.parametrize("window", [11, 64, 1 << 12])
def test_long_records_and_gaps_in_any_window(window):
    payloads = [random.Random(i).randbytes(30_000 * (i % 3)) for i in range(5)]
    parts = archive(payloads)
    found = read(b"".join([*parts[:2], b"WARC/1.1", parts[2], b"\x1f\x8b", *parts[3:]]), window)
    assert [f[2].payload for f in found if f[2]] == payloads
    assert [f[1] for f in found if f[2] is None] == [8, 2]


def test_digest_is_bare_base32():
    assert warc.digest(b"a") == base64.b32encode(hashlib.sha1(b"a").digest()).decode()


# ------------------------------------------------------------------ Elias-Fano, language model
@settings(deadline=None, max_examples=80)
@given(st.lists(st.integers(0, 2**64 - 1) | st.integers(0, 1000), max_size=300), st.lists(st.integers(0, 2**64 - 1) | st.integers(0, 1100), max_size=40))
def test_elias_fano(values, asked):
    values = np.sort(np.array(values, np.uint64))
    ef = EliasFano.of(values, 2**64)
    asked = np.concatenate([values, np.array(asked, np.uint64)])
    assert (ef.access(np.arange(len(values))) == values).all()
    assert (ef.successor(asked) == np.searchsorted(values, asked)).all()
    assert ((ef.find(asked) >= 0) == np.isin(asked, values)).all()


def test_runs_and_quantisation():
    keys = np.unique(np.random.default_rng(0).integers(0, 2**64, 5000, dtype=np.uint64))
    counts = np.arange(len(keys)) + 1
    k, c = lm.unpack_run(lm.pack_run(keys, counts))
    assert (k == keys).all() and (c == counts).all()
    p = np.array([1.0, 0.5, 1e-9])
    assert np.abs(np.log10(lm.dequantised(lm.quantised(p))) - np.log10(p)).max() < 2 / lm.STEPS
    assert lm.dequantised(lm.quantised(np.array([0.0])))[0] == 0


# ------------------------------------------------------------------ top-k
@pytest.mark.parametrize("n,k", [(1, 3), (40, 10), (3000, 7)])
def test_index_is_exact(n, k):
    rng = np.random.default_rng(n)
    codes = np.unique(rng.integers(0, 2**64, n, dtype=np.uint64) & np.uint64(rng.integers(1, 2**63) | 0xFFFF))
    rng.shuffle(codes)
    queries = np.concatenate([codes[:5], rng.integers(0, 2**64, 20, dtype=np.uint64)])
    q, at, distance = topk.Index(codes).search(queries, k)
    every = np.bitwise_count(queries[:, None] ^ codes[None, :]).astype(int)
    k = min(k, len(codes))
    for i in range(len(queries)):
        order = np.lexsort((np.arange(len(codes)), every[i]))[:k]
        assert at[q == i].tolist() == order.tolist() and distance[q == i].tolist() == every[i][order].tolist()


def test_a_context_is_looked_up_once_for_all_its_pairs(monkeypatch, tmp_path):
    from txnrisk.llm import eliasfano, lm

    n = 40
    model = lm.Model(str(tmp_path), 0, [n], 1000)
    asked, access = [], eliasfano.EliasFano.access
    for part in range(lm.PARTS):
        keys = np.array([c * n + w for c in range(n) for w in range(part, n, lm.PARTS)], np.uint64)
        pairs = lm._sequence("pairs", eliasfano.EliasFano.of(keys, n * n))
        pointers = lm._sequence("pointers", eliasfano.EliasFano.of(np.arange(n + 1) * (n // lm.PARTS), len(keys) + 1))
        share = (keys % 7 + 1) / 10
        lm.save(f"{tmp_path}/pairs-0-{part}", pairs[0] | pointers[0], pairs[1] | pointers[1] | {"q": lm.quantised(share)})

    def counting(self, i):
        asked.append(len(i))
        return access(self, i)

    monkeypatch.setattr(eliasfano.EliasFano, "access", counting)
    context, word = (x.ravel() for x in np.meshgrid(np.arange(n), np.arange(n), indexing="ij"))
    found = model.following(context, word)
    assert np.allclose(found, ((context * n + word) % 7 + 1) / 10, rtol=1e-3)
    # two pointers a context and part, one value a pair
    assert sum(asked) == 2 * n * lm.PARTS + n * n
