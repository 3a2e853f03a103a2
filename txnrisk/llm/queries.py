"""The registered queries of the corpus operators: thin, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from txnrisk.llm import (
    conversations,
    decontaminate,
    extract,
    langid,
    lm,
    mixing,
    phrases,
    quality,
    simhash,
    tokens,
    topk,
    toxicity,
    warc,
)
from txnrisk.llm.common import remainder

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}

WORD_TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
PIECE_MODEL = public_tokenizers.path("piece_bpe_32k.model")


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query
def op1_token_output(spark, sf_dir):
    return tokens.tokenized(_table(spark, sf_dir, "documents"), WORD_TOKENIZER)


@query
def op3_simhash(spark, sf_dir):
    found = simhash.near_duplicates(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash.hexadecimal().alias("fingerprint"), "component_id")


@query
def op4_quality(spark, sf_dir):
    scored = quality.scores(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))
    return scored.withColumn("predicted", (F.col("score") >= 0.3).cast("int"))


@query
def op7_language_id(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents")
    langs, probabilities = langid.fit(docs, PIECE_MODEL, remainder(5) != 0)
    found = langid.predict(docs, PIECE_MODEL, langs, probabilities, ["doc_id"])
    return found.select("doc_id", (remainder(5) == 0).alias("held_out"), "lang_pred", "score")


@query
def op8_decontaminate(spark, sf_dir):
    return decontaminate.contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


@query
def op2_mixing(spark, sf_dir):
    return mixing.scheduled(_table(spark, sf_dir, "documents")).select("doc_id", "stream", "block", "slot")


@query
def op6_warc(spark, sf_dir):
    archives = warc.write_archives(_table(spark, sf_dir, "pages"))
    read = warc.read_archives(archives).filter("kind = 'record'")
    return read.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLES: dict[str, str] = {}


@query
def op5_html_text(spark, sf_dir):
    return extract.extracted(_table(spark, sf_dir, "pages"))


@query
def op10_topk(spark, sf_dir):
    rows = topk.sign_codes(_table(spark, sf_dir, "embeddings")).select(F.col("vec_id").alias("id"), "code")
    return topk.nearest(rows, rows.filter("id % 20 = 0"), k=10)


ORACLES["op10_topk"] = """
WITH codes AS (
  SELECT vec_id AS id, list_transform(embedding, lambda x: CASE WHEN x > 0 THEN 1 ELSE 0 END) AS bits
  FROM embeddings WHERE embedding IS NOT NULL
), pairs AS (
  SELECT q.id AS query_id, r.id,
    list_sum(list_transform(list_zip(q.bits, r.bits), lambda p: CASE WHEN p[1] <> p[2] THEN 1 ELSE 0 END)) AS distance
  FROM codes q CROSS JOIN codes r WHERE q.id % 20 = 0
)
SELECT query_id, rank, id, CAST(distance AS INTEGER) AS distance FROM (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY distance, id) AS INTEGER) AS rank FROM pairs)
WHERE rank <= 10
"""

ORACLES["op8_decontaminate"] = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), windows AS (
  SELECT DISTINCT item_id, size, list_aggregate(w[i:i + size - 1], 'string_agg', ' ') AS gram FROM (
    SELECT item_id, w, least(13, len(w)) AS size, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS i FROM b WHERE len(w) > 0)
), grams AS (
  SELECT doc_id, size, i, list_aggregate(w[i:i + size - 1], 'string_agg', ' ') AS gram FROM (
    SELECT doc_id, w, size, unnest(range(1, len(w) - size + 2)) AS i
    FROM d CROSS JOIN (SELECT DISTINCT size FROM windows) WHERE len(w) >= size)
), hits AS (
  SELECT g.doc_id, g.i, g.size, x.item_id FROM grams g JOIN windows x ON g.size = x.size AND g.gram = x.gram
), words AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + size)) AS p FROM hits) GROUP BY doc_id
), items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS names FROM (
    SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hits) GROUP BY doc_id
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
  CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(names, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)
"""

ORACLES["op6_warc"] = """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS hex FROM pages
), f AS (
  SELECT page_id, CAST(strlen(html) AS BIGINT) AS payload_bytes, hex, max(page_id) OVER (PARTITION BY hex) AS last FROM p
), g AS (
  SELECT *, list_transform(range(8), lambda i: CAST('0x' || hex[5 * i + 1:5 * i + 5] AS BIGINT)) AS parts FROM f
)
SELECT page_id, payload_bytes,
  list_aggregate(list_transform(range(32), lambda i:
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'[CAST((parts[i // 4 + 1] >> (15 - 5 * (i % 4))) & 31 AS INTEGER) + 1]), 'string_agg', '') AS payload_digest,
  CASE WHEN page_id = last THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> last THEN last END AS refers_to
FROM g
"""


@query
def op9_lm_score(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents")
    model = lm.train(docs, remainder(10) != 0)
    found = lm.scored(docs, model)
    return found.select("doc_id", (remainder(10) == 0).alias("held_out"), *found.columns[1:])


@query
def op11_conversation_repair(spark, sf_dir):
    return conversations.repair_report(_table(spark, sf_dir, "conversations"))


def _paid(walk: str, cost: str, edit: str) -> str:
    """A walk of the SQL check, six digits of cost and then the edits, with one more edit."""
    return f"lpad((left({walk}, 6)::INT + {cost})::VARCHAR, 6, '0') || substr({walk}, 7) || '{edit}'"


_BEFORE_USER = "least(q0, q1, q3)"
_STAYS = "fault IN ('k', 't')"
_B2 = f"least({_paid('q2', '3', 'D')}, CASE WHEN {_STAYS} AND role ^@ 'u' THEN {_paid(_BEFORE_USER, 'late', 'K')} END, CASE WHEN {_STAYS} THEN {_paid(_BEFORE_USER, '2 + late', 'R')} END)"
_B3 = f"least({_paid('q3', '3', 'D')}, CASE WHEN {_STAYS} AND role ^@ 'a' THEN {_paid('q2', 'late', 'K')} END, CASE WHEN {_STAYS} THEN {_paid('q2', '2 + late', 'R')} END)"

# Forward over the rows: the cheapest and then ASCII-least walk into each of the four states, insertions last.
ORACLES["op11_conversation_repair"] = rf"""
WITH RECURSIVE bits AS (
  SELECT i, 0 AS k, i::BIGINT AS v FROM range(256) t(i)
  UNION ALL SELECT i, k + 1, CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END FROM bits WHERE k < 8
), crc AS (
  SELECT list(v ORDER BY i) AS t FROM bits WHERE k = 8
), hashed AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, xor(list_reduce(
    list_prepend(4294967295::BIGINT, list_transform(string_split(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '), ''),
      lambda x: ord(x)::BIGINT)), lambda c, x: xor(t[(xor(c, x) & 255) + 1], c >> 8)), 4294967295) % 20 AS harm
  FROM conversations, crc
), damaged AS (
  SELECT conv_id, turn, CASE WHEN harm = 4 THEN 'user' ELSE role END AS role,
    CASE harm WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
  FROM (SELECT *, unnest(range(CASE WHEN harm = 3 THEN 2 ELSE 1 END)) FROM hashed WHERE harm <> 0)
), numbered AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text)) AS pos,
    rtrim(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS kept FROM damaged
), faults AS (
  SELECT *, CASE WHEN kept = '' THEN 'b' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY pos) > 1 THEN 'd' WHEN right(kept, 1) NOT IN ('.', '!', '?') THEN 't' ELSE 'k' END AS fault,
    lag(role) OVER (PARTITION BY conv_id ORDER BY pos) AS prior FROM numbered
), counted AS (
  SELECT conv_id, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
    count(*) FILTER (fault = 'b') AS blank, count(*) FILTER (fault = 'd') AS duplicate, count(*) FILTER (fault = 't') AS truncated,
    count(*) FILTER (pos > 1 AND (left(prior, 1) || left(role, 1)) NOT IN ('su', 'ua', 'au')) AS illegal
  FROM faults GROUP BY conv_id
), walk AS (
  SELECT conv_id, 0::BIGINT AS pos, '000000' AS q0, NULL::VARCHAR AS q1, '000002I' AS q2, '000004II' AS q3 FROM counted
  UNION ALL
  SELECT conv_id, pos, b0, b1, least(b2, {_paid("b0", "2", "I")}, {_paid("b1", "2", "I")}, {_paid("b3", "2", "I")}),
    least(b3, {_paid("b2", "2", "I")}, {_paid("b0", "4", "II")}, {_paid("b1", "4", "II")})
  FROM (
    SELECT f.conv_id, f.pos, {_paid("q0", "3", "D")} AS b0,
      least({_paid("q1", "3", "D")}, CASE WHEN {_STAYS} AND role ^@ 's' THEN {_paid("q0", "late", "K")} END) AS b1, {_B2} AS b2, {_B3} AS b3
    FROM walk JOIN (SELECT *, (fault = 't')::INT AS late FROM faults) f ON f.conv_id IS NOT DISTINCT FROM walk.conv_id AND f.pos = walk.pos + 1)
), ended AS (
  SELECT c.*, left(least(q0, q3), 6)::BIGINT AS cost, substr(least(q0, q3), 7) AS audit
  FROM counted c JOIN walk w ON w.conv_id IS NOT DISTINCT FROM c.conv_id AND w.pos = c.n
), edits AS (
  SELECT conv_id, edit, place, count(*) FILTER (edit <> 'I') OVER (PARTITION BY conv_id ORDER BY place) AS pos FROM (
    SELECT conv_id, unnest(string_split(audit, '')) AS edit, generate_subscripts(string_split(audit, ''), 1) AS place FROM ended WHERE audit <> '')
), kept_rows AS (
  SELECT e.conv_id, place, edit, role, CASE WHEN edit = 'I' THEN '' ELSE text END AS text,
    row_number() OVER (PARTITION BY e.conv_id ORDER BY place) AS j, first(edit = 'K' AND role ^@ 's') OVER (PARTITION BY e.conv_id ORDER BY place) AS system
  FROM edits e LEFT JOIN faults f ON f.conv_id IS NOT DISTINCT FROM e.conv_id AND f.pos = e.pos WHERE edit <> 'D'
), texts AS (
  SELECT conv_id, sha256(string_agg(CASE WHEN edit = 'K' THEN role WHEN (j - system::INT) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || text,
    chr(10) ORDER BY place)) AS hash FROM kept_rows GROUP BY conv_id
)
SELECT a.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
  coalesce(illegal, 0) AS illegal, coalesce(cost, 0) AS cost, coalesce(audit, '') AS audit, coalesce(hash, sha256('')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) a
LEFT JOIN ended e ON e.conv_id IS NOT DISTINCT FROM a.conv_id LEFT JOIN texts t ON t.conv_id IS NOT DISTINCT FROM a.conv_id
"""


@query
def op12_toxicity(spark, sf_dir):
    scored = toxicity.scores(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))
    return scored.withColumn("predicted", (F.col("score") >= 0.7).cast("int"))


@query
def op13_phrases(spark, sf_dir):
    return phrases.collocations(_table(spark, sf_dir, "documents"))


ORACLES["op13_phrases"] = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents
), lists AS (
  SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces
), grams AS (
  SELECT lang, size, unnest(list_transform(range(1, len(w) - size + 2), lambda i: array_to_string(w[i:i + size - 1], ' '))) AS phrase
  FROM lists, (SELECT unnest([1, 2, 3, 4, 5]) AS size) WHERE len(w) >= size
), f AS (
  SELECT lang, size, phrase, count(*) AS n FROM grams GROUP BY ALL
), totals AS (
  SELECT lang, sum(n)::BIGINT AS n FROM f WHERE size = 1 GROUP BY lang
), candidates AS (
  SELECT lang, size, phrase, n AS a, string_split(phrase, ' ') AS w FROM f WHERE size > 1 AND n >= 100
), parts AS (
  SELECT lang, a AS longer, unnest(flatten(list_transform(range(2, size), lambda m:
    list_transform(range(1, size - m + 2), lambda i: array_to_string(w[i:i + m - 1], ' '))))) AS phrase
  FROM candidates WHERE size > 2
), kept AS (
  SELECT c.* FROM candidates c LEFT JOIN (SELECT lang, phrase, max(longer) AS longer FROM parts GROUP BY ALL) p USING (lang, phrase)
  WHERE longer IS NULL OR 100 * longer < 100 * a
), cuts AS (
  SELECT k.lang, k.phrase, k.a, t.n, i, x.n AS l, y.n AS r, 1000::HUGEINT * a * t.n // (x.n::HUGEINT * y.n) AS score
  FROM (SELECT *, unnest(range(1, size)) AS i FROM kept) k JOIN totals t USING (lang)
  JOIN f x ON x.lang = k.lang AND x.phrase = array_to_string(w[1:i], ' ')
  JOIN f y ON y.lang = k.lang AND y.phrase = array_to_string(w[i + 1:], ' ')
), lowest AS (
  SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, i) = 1
)
SELECT lang, rank, phrase, a, l, r, n, score::BIGINT AS score FROM (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank FROM lowest) WHERE rank <= 2000
"""
