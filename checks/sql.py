"""The same queries in SQL for DuckDB, written from the definitions alone."""

from __future__ import annotations

from checks.inputs import ALL_WEIGHTS, INTERCEPT, WEIGHTS
from txnrisk.settings import ALIASES, LABEL, MODEL_FEATURES, NOVELTY_FEATURES, REASON_GROUPS, REQUIRED

ORACLES: dict[str, str] = {}


def D(x: float) -> str:
    """A double literal; a bare 0.7 would be a decimal."""
    return f"CAST({x!r} AS DOUBLE)"


def with_(*ctes: str, select: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n" + select


# ------------------------------------------------------------------ base tables
EVENTS = """txn AS (
 SELECT 'E' || lpad(CAST(event_id AS VARCHAR), 10, '0') AS transaction_id,
        CAST(floor(epoch(ts)) AS BIGINT) AS ts_sec,
        'C' || user_id AS customer_id,
        'M' || json_extract_string(props, '$.k') AS merchant_id,
        'D' || user_id || '-' || (CAST(json_extract_string(props, '$.k') AS INT) % 3) AS device_id,
        value AS amount, CAST(hour(ts) AS INT) AS transaction_hour,
        CAST(event_type = 'error' AS INT) AS is_fraud
 FROM events)"""

LINES = """txn AS (
 SELECT transaction_id, ts_sec, customer_id, merchant_id, device_id, amount, transaction_hour, is_fraud FROM (
  SELECT *, row_number() OVER (PARTITION BY transaction_id ORDER BY ts_sec, merchant_id, device_id, amount,
            l_quantity, l_discount, l_tax, l_returnflag, l_linestatus) AS rn
  FROM (SELECT 'L' || lpad(CAST(l_orderkey AS VARCHAR), 10, '0') || '-' || l_linenumber AS transaction_id,
               CAST(floor(epoch(l_shipdate)) AS BIGINT) AS ts_sec, 'C' || o_custkey AS customer_id,
               'M' || l_suppkey AS merchant_id, 'D' || l_partkey AS device_id, l_extendedprice AS amount,
               CAST(hour(l_shipdate) AS INT) AS transaction_hour, CAST(l_returnflag = 'R' AS INT) AS is_fraud,
               l_quantity, l_discount, l_tax, l_returnflag, l_linestatus
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey)) WHERE rn = 1)"""

RAW = """raw AS (
 SELECT 'R' || (event_id // 3 * 3 + least(event_id % 3, 1)) AS txn_id,
  CASE event_id % 7
   WHEN 0 THEN strftime(date_trunc('second', ts), '%Y-%m-%dT%H:%M:%SZ')
   WHEN 1 THEN strftime(date_trunc('second', ts), '%Y-%m-%d %H:%M:%S+02:00')
   WHEN 2 THEN strftime(date_trunc('second', ts), '%Y-%m-%d %H:%M:%S.750')
   WHEN 3 THEN 'not a time'
   ELSE strftime(date_trunc('second', ts), '%Y-%m-%d %H:%M:%S') END AS event_time,
  CASE event_id % 6
   WHEN 0 THEN (w // 100) || '.' || lpad(CAST(w % 100 AS VARCHAR), 2, '0')
   WHEN 1 THEN (w // 100000) || ',' || lpad(CAST((w // 100) % 1000 AS VARCHAR), 3, '0') || '.' || lpad(CAST(w % 100 AS VARCHAR), 2, '0')
   WHEN 2 THEN '1,' || lpad(CAST((w // 100000) % 1000 AS VARCHAR), 3, '0') || ',' || lpad(CAST((w // 100) % 1000 AS VARCHAR), 3, '0')
   WHEN 3 THEN '-' || (w // 100)
   WHEN 4 THEN 'n/a'
   ELSE ' ' || (w // 100) || ' ' END AS amt,
  'C' || user_id AS cid, 'M' || json_extract_string(props, '$.k') AS merchant, 'D' || user_id AS device,
  CASE event_type WHEN 'error' THEN '1' WHEN 'view' THEN '0.0' WHEN 'click' THEN '?' ELSE '0' END AS isfraud,
  event_id AS line_no
 FROM (SELECT *, CAST(round(value * 100) AS BIGINT) * 4321 AS w FROM events))"""

TYPED = """typed AS (
 SELECT txn_id AS transaction_id, line_no, cid AS customer_id, merchant AS merchant_id, device AS device_id,
  CASE WHEN event_time = 'not a time' THEN NULL ELSE
   CAST(epoch(CAST(replace(substr(event_time, 1, 19), 'T', ' ') AS TIMESTAMP)) AS BIGINT)
   - CASE WHEN event_time LIKE '%+02:00' THEN 7200 ELSE 0 END END AS ts_sec,
  CASE WHEN TRY_CAST(a AS DOUBLE) > 0 THEN TRY_CAST(a AS DOUBLE) END AS amount,
  coalesce(CAST(TRY_CAST(isfraud AS DOUBLE) AS INT), 0) AS is_fraud
 FROM (SELECT *, regexp_replace(trim(amt), ',(\\d{3}(\\.\\d*)?)$', '\\1') AS a FROM raw))"""

FOLDS = f"""ord AS (
 SELECT *, row_number() OVER (ORDER BY ts_sec, transaction_id) - 1 AS row_index, count(*) OVER () AS n_all FROM txn),
fold AS (
 SELECT *, CASE WHEN row_index < CAST(floor(n_all * {D(0.6)}) AS BIGINT) THEN 'train'
   WHEN row_index < CAST(floor(n_all * ({D(0.6)} + {D(0.2)})) AS BIGINT) THEN 'val' ELSE 'test' END AS fold FROM ord),
hold AS (
 SELECT customer_id FROM (
  SELECT customer_id, row_number() OVER (ORDER BY md5('42:' || customer_id), customer_id) AS r, count(*) OVER () AS c
  FROM (SELECT DISTINCT customer_id FROM txn))
 WHERE r <= greatest(2, CAST(floor(c * {D(0.2)}) AS BIGINT))),
comb AS (SELECT * FROM fold WHERE fold <> 'train' OR customer_id NOT IN (SELECT customer_id FROM hold))"""

STRATUM = "CASE WHEN {n} <= 0 THEN 'cold' WHEN {n} < 5 THEN 'warm' ELSE 'established' END"
TIER = "CASE WHEN {n} <= 0 THEN 'rare' WHEN {n} <= 2 THEN 'low' WHEN {n} <= 9 THEN 'mid' ELSE 'high' END"


def before(key: str) -> str:
    return f"(PARTITION BY {key} ORDER BY ts_sec, transaction_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"


PRIORS = f"""strat AS (
 SELECT *, {STRATUM.format(n='n_c')} AS stratum, {TIER.format(n='n_m')} AS tier, ln(1 + amount) AS x FROM (
  SELECT *, count(*) OVER {before('customer_id')} AS n_c, count(*) OVER {before('merchant_id')} AS n_m
  FROM comb WHERE fold = 'train')),
seg AS (
 SELECT coalesce(stratum, 'any') AS stratum, coalesce(tier, 'any') AS tier, avg(x) AS mean,
  CASE WHEN stddev_pop(x) = 0 THEN 0.05 ELSE stddev_pop(x) END AS sd, count(*) AS n,
  (sum(is_fraud) + 20 * base) / (count(*) + 20) AS risk
 FROM strat, (SELECT avg(is_fraud) AS base FROM strat) GROUP BY base, CUBE (stratum, tier)),
gprior AS (
 SELECT avg(x) AS mean, CASE WHEN stddev_pop(x) > 0 THEN stddev_pop(x) ELSE 0.05 END AS sd, count(*) AS n,
  avg(is_fraud) AS risk, {', '.join(f'quantile_cont(x, {i / 8}) AS e{i}' for i in range(1, 8))} FROM strat),
grid AS (SELECT * FROM (VALUES ('cold'), ('warm'), ('established')) s(stratum), (VALUES ('rare'), ('low'), ('mid'), ('high')) t(tier)),
looked AS (
 SELECT g.stratum, g.tier, coalesce(a.mean, b.mean, c.mean, gprior.mean) AS mu_seg,
  coalesce(a.sd, b.sd, c.sd, gprior.sd) AS sd_seg, coalesce(a.risk, b.risk, c.risk, gprior.risk) AS risk_seg
 FROM grid g CROSS JOIN gprior
 LEFT JOIN seg a ON a.stratum = g.stratum AND a.tier = g.tier
 LEFT JOIN seg b ON b.stratum = g.stratum AND b.tier = 'any'
 LEFT JOIN seg c ON c.stratum = 'any' AND c.tier = g.tier)"""


def state(source: str) -> str:
    """Entity state before each row of ``source``: windows, and a self-join for the last day."""
    return f"""hist AS (
 SELECT *, ln(1 + amount) AS amount_log,
  count(*) OVER wc AS customer_history_count, count(*) OVER wm AS merchant_history_count,
  count(*) OVER wd AS device_history_count,
  avg(ln(1 + amount)) OVER wc AS mu_c, coalesce(stddev_pop(ln(1 + amount)) OVER wc, 0) AS sd_c,
  avg(ln(1 + amount)) OVER wm AS mu_m, coalesce(stddev_pop(ln(1 + amount)) OVER wm, 0) AS sd_m,
  max(ts_sec) OVER wc AS last_c, max(ts_sec) OVER wd AS last_d,
  sum(CAST(amount AS DECIMAL(20,6))) OVER wc AS sum_c
 FROM {source}
 WINDOW wc AS {before('customer_id')}, wm AS {before('merchant_id')}, wd AS {before('device_id')}),
recent AS (
 SELECT a.transaction_id,
  count(b.ts_sec) FILTER (WHERE b.ts_sec >= a.ts_sec - 300) AS txn_count_5m,
  count(b.ts_sec) FILTER (WHERE b.ts_sec >= a.ts_sec - 480) AS txn_count_8m,
  count(b.ts_sec) FILTER (WHERE b.ts_sec >= a.ts_sec - 1800) AS txn_count_30m,
  count(b.ts_sec) AS txn_count_24h,
  count(DISTINCT b.merchant_id) AS distinct_merchants_24h, count(DISTINCT b.device_id) AS distinct_devices_24h,
  coalesce(sum(b.amount), 0) AS amount_sum_24h
 FROM {source} a LEFT JOIN {source} b ON a.customer_id = b.customer_id AND b.ts_sec >= a.ts_sec - 86400
  AND (b.ts_sec < a.ts_sec OR (b.ts_sec = a.ts_sec AND b.transaction_id < a.transaction_id))
 GROUP BY a.transaction_id)"""


CONF = "(customer_history_count / (customer_history_count + 5.0::DOUBLE))"
FEATURES = f"""joined AS (
 SELECT h.*, r.* EXCLUDE (transaction_id), l.mu_seg, l.sd_seg, l.risk_seg, gprior.mean AS gprior_mean,
  e1, e2, e3, e4, e5, e6, e7, {CONF} AS conf
 FROM hist h JOIN recent r ON r.transaction_id = h.transaction_id
 JOIN looked l ON l.stratum = {STRATUM.format(n='h.customer_history_count')} AND l.tier = {TIER.format(n='h.merchant_history_count')}
 CROSS JOIN gprior),
shrunk AS (
 SELECT *, CASE WHEN customer_history_count > 0 THEN conf * mu_c + (1 - conf) * mu_seg ELSE mu_seg END AS mu,
  CASE WHEN customer_history_count > 0 THEN conf * sd_c * sd_c + (1 - conf) * sd_seg * sd_seg
    + conf * (1 - conf) * (mu_c - mu_seg) * (mu_c - mu_seg) ELSE sd_seg * sd_seg END AS s2 FROM joined),
zed AS (SELECT *, (amount_log - mu) / sqrt(greatest(s2, {D(1e-6)})) AS z FROM shrunk),
feats AS (
 SELECT transaction_id, fold, ts_sec, customer_id, merchant_id, device_id, amount, transaction_hour,
  CAST(transaction_hour < 6 OR transaction_hour >= 23 AS INT) AS is_night,
  CAST((ts_sec // 86400 + 3) % 7 AS INT) AS day_of_week,
  CAST((ts_sec // 86400 + 3) % 7 >= 5 AS INT) AS is_weekend, is_fraud, amount_log,
  CAST((e1 <= amount_log)::INT + (e2 <= amount_log)::INT + (e3 <= amount_log)::INT + (e4 <= amount_log)::INT
   + (e5 <= amount_log)::INT + (e6 <= amount_log)::INT + (e7 <= amount_log)::INT AS INT) AS amount_bucket,
  z AS amount_z_shrunk,
  CASE WHEN customer_history_count >= 3 THEN CASE WHEN sd_c > {D(1e-6)} THEN (amount_log - mu_c) / sd_c ELSE 0 END ELSE z END AS customer_amount_z,
  CASE WHEN merchant_history_count >= 3 AND sd_m > {D(1e-6)} THEN (amount_log - mu_m) / sd_m ELSE 0 END AS merchant_amount_z,
  txn_count_5m, ln(1.0::DOUBLE + txn_count_5m) AS txn_count_5m_log,
  txn_count_30m, ln(1.0::DOUBLE + txn_count_30m) AS txn_count_30m_log,
  txn_count_24h, ln(1.0::DOUBLE + txn_count_24h) AS txn_count_24h_log,
  distinct_merchants_24h, distinct_devices_24h, ln(1 + amount_sum_24h) AS amount_sum_24h_log,
  customer_history_count, merchant_history_count, device_history_count,
  ln(1.0::DOUBLE + customer_history_count) AS customer_history_count_log,
  ln(1.0::DOUBLE + merchant_history_count) AS merchant_history_count_log,
  ln(1.0::DOUBLE + device_history_count) AS device_history_count_log,
  CASE WHEN customer_history_count > 0 THEN mu_c ELSE mu_seg END AS customer_avg_amount_log,
  CASE WHEN merchant_history_count > 0 THEN mu_m ELSE gprior_mean END AS merchant_avg_amount_log,
  coalesce(ln(1 + (ts_sec - last_c) / 3600.0::DOUBLE), 0) AS time_since_customer_txn_log,
  coalesce(ln(1 + (ts_sec - last_d) / 3600.0::DOUBLE), 0) AS time_since_device_txn_log,
  CAST(device_history_count = 0 AS INT) AS new_device, CAST(merchant_history_count = 0 AS INT) AS new_merchant,
  CAST(customer_history_count = 0 AS INT) AS first_time_customer,
  CAST(customer_history_count >= 3 AS INT) AS customer_history_available,
  CAST(merchant_history_count >= 3 AS INT) AS merchant_history_available,
  CAST(device_history_count >= 1 AS INT) AS device_history_available,
  conf AS customer_history_conf,
  CASE WHEN customer_history_count <= 0 THEN 0 WHEN customer_history_count < 5 THEN 1 ELSE 2 END AS history_stratum,
  mu AS customer_amount_baseline, mu_seg AS segment_amount_baseline, gprior_mean AS global_amount_baseline,
  risk_seg AS segment_risk_prior
 FROM zed)"""

MARGIN = " + ".join([D(INTERCEPT)] + [f"{D(w)} * {f}" for f, w in WEIGHTS.items()])
SCORED = f"""dev AS (
 SELECT *, 1 / (1 + exp(-({MARGIN}))) AS p, round(abs(amount_z_shrunk), 6) AS deviation FROM feats WHERE fold <> 'train'),
ref AS (SELECT deviation FROM dev WHERE fold = 'val' AND is_fraud = 0),
refrank AS (
 SELECT deviation, sum(r) OVER (ORDER BY deviation) / CAST((SELECT count(*) FROM ref) AS DOUBLE) AS novelty FROM (
  SELECT deviation, sum(r) AS r FROM (SELECT deviation, 1 AS r FROM ref UNION ALL SELECT DISTINCT deviation, 0 FROM dev) GROUP BY deviation)),
scored AS (SELECT dev.*, refrank.novelty FROM dev JOIN refrank USING (deviation)),
qs AS (SELECT quantile_cont(round(p, 6), {D(0.993)}) AS ph, quantile_cont(round(p, 6), {D(0.98)}) AS pr FROM scored WHERE fold = 'val'),
thr AS (
 SELECT round(greatest(pr, {D(0.001)}), 4) AS p_review, round(greatest(ph, pr + {D(0.001)}, {D(0.01)}), 4) AS p_high,
  {D(0.9)} AS novelty_high, {D(0.97)} AS novelty_very_high, {D(0.02)} AS p_floor_for_novelty FROM qs)"""

BAND = (
    "CASE WHEN {p} >= p_high THEN 'high-risk' WHEN {p} >= p_review OR ({n} >= novelty_very_high AND {p} >= p_floor_for_novelty)"
    " THEN 'review' WHEN {n} >= novelty_high THEN 'monitor' ELSE 'normal' END"
)
DECIDED = f"""decided AS (
 SELECT *, risk_band IN ('review', 'high-risk') AS alert,
  CASE WHEN risk_band IN ('review', 'high-risk') THEN 'alert' ELSE 'log' END AS budget_status FROM (
  SELECT feats_s.* EXCLUDE (p, novelty), p, novelty, round(p, 4) AS fraud_probability, round(novelty, 4) AS novelty_score,
   {BAND.format(p='p', n='novelty')} AS risk_band, round({D(0.7)} * p + {D(0.3)} * novelty, 6) AS rank_score, novelty_high
  FROM (SELECT * FROM scored WHERE fold = 'test') feats_s CROSS JOIN thr))"""

COMBINED = (EVENTS, FOLDS)
FITTED = (EVENTS, FOLDS, PRIORS)
FULL = (EVENTS, FOLDS, PRIORS, state("comb"), FEATURES)
SCORES = (*FULL, SCORED)
DECISIONS = (*SCORES, DECIDED)


def oracle(name: str, *ctes: str, select: str) -> None:
    ORACLES[name] = with_(*ctes, select=select) if ctes else select


# ================================================================== cleaning
oracle("canonical_events", EVENTS, select="SELECT * FROM txn")
oracle("canonical_lines_dedup", LINES, select="SELECT * FROM txn")
oracle("canonical_raw", RAW, TYPED, select="""
 SELECT transaction_id, ts_sec, round(amount, 6) AS amount, customer_id, merchant_id, device_id, is_fraud,
  CAST((ts_sec // 3600) % 24 AS INT) AS transaction_hour,
  CAST((ts_sec // 3600) % 24 < 6 OR (ts_sec // 3600) % 24 >= 23 AS INT) AS is_night
 FROM (SELECT *, row_number() OVER (PARTITION BY transaction_id ORDER BY line_no) AS rn FROM typed)
 WHERE rn = 1 AND ts_sec IS NOT NULL""")
oracle("amount_repair", RAW, TYPED, select="SELECT line_no, round(amount, 2) AS amount FROM typed WHERE amount IS NOT NULL")
oracle("timestamp_parse", RAW, TYPED, select="SELECT line_no, ts_sec FROM typed WHERE ts_sec IS NOT NULL")
oracle("load_meta", RAW, TYPED, select="""
 SELECT CAST(count(*) AS BIGINT) AS rows_read, CAST(count(*) FILTER (WHERE rn > 1) AS BIGINT) AS duplicate_txns_dropped,
  CAST(count(*) FILTER (WHERE rn = 1 AND ts_sec IS NULL) AS BIGINT) AS unparseable_timestamps,
  CAST(count(*) FILTER (WHERE rn = 1 AND ts_sec IS NOT NULL) AS BIGINT) AS rows_loaded
 FROM (SELECT *, row_number() OVER (PARTITION BY transaction_id ORDER BY line_no) AS rn FROM typed)""")
ERRORS = """err AS (SELECT *, concat_ws('|', CASE WHEN amount IS NULL THEN 'amount must be a positive number' END,
 CASE WHEN ts_sec IS NULL THEN 'timestamp required' END) AS errors FROM typed)"""
oracle("row_validation", RAW, TYPED, ERRORS, select="SELECT errors, errors = '' AS valid, count(*) AS rows FROM err GROUP BY 1, 2")
oracle("invalid_rows_routed", RAW, TYPED, ERRORS, select="""
 SELECT line_no, 'invalid' AS risk_band, false AS alert, 'log' AS budget_status, CAST(NULL AS DOUBLE) AS fraud_probability, errors
 FROM err WHERE errors <> ''""")
ADAPTED = """pay AS (
 SELECT o_orderkey AS tid, CAST(o_orderstatus = 'F' AS INT) AS is_fraud,
  CAST(epoch(o_orderdate) AS BIGINT) - 694224000 + o_orderkey % 86400 AS dt, o_totalprice AS amount,
  CASE WHEN o_custkey % 10 <> 0 THEN o_custkey END AS card1, CASE WHEN o_custkey % 7 <> 0 THEN o_custkey % 25 END AS addr1 FROM orders),
ident AS (
 SELECT o_orderkey AS tid, CASE WHEN c_nationkey < 15 THEN c_mktsegment END AS ty,
  CASE WHEN c_nationkey % 3 <> 0 THEN 'N' || c_nationkey END AS info
 FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_totalprice > 200000),
adapted AS (
 SELECT CAST(pay.tid AS VARCHAR) AS transaction_id, CAST(dt + 1509408000 AS BIGINT) AS ts_sec, amount,
  'card_' || coalesce(CAST(card1 AS VARCHAR), '-1') AS customer_id, 'addr_' || coalesce(CAST(addr1 AS VARCHAR), '-1') AS merchant_id,
  CASE WHEN info IS NOT NULL AND ty IS NOT NULL THEN info || '|' || ty ELSE coalesce(info, ty, 'NA_DEVICE') END AS device_id,
  CAST((dt // 3600) % 24 AS INT) AS transaction_hour, is_fraud
 FROM pay LEFT JOIN ident ON pay.tid = ident.tid)"""
oracle("foreign_adapter", ADAPTED, select="SELECT * FROM adapted")
oracle("foreign_adapter_summary", ADAPTED, select="""
 SELECT count(*) AS rows, round(avg(is_fraud) * 100, 4) AS fraud_rate_pct, count(DISTINCT customer_id) AS unique_customers,
  count(DISTINCT merchant_id) AS unique_merchants, count(DISTINCT device_id) AS unique_devices,
  round(avg(CAST(device_id <> 'NA_DEVICE' AS INT)) * 100, 2) AS pct_with_device, min(ts_sec) AS first_ts, max(ts_sec) AS last_ts
 FROM adapted""")
oracle("file_preview", EVENTS, select="""
 SELECT count(*) AS rows, CAST(8 AS BIGINT) AS n_columns, round(avg(is_fraud) * 100, 4) AS fraud_rate_pct,
  min(ts_sec) AS first_ts, max(ts_sec) AS last_ts FROM txn""")
oracle("preview_rows", EVENTS, select="SELECT transaction_id, ts_sec, amount FROM txn ORDER BY ts_sec, transaction_id LIMIT 5")
oracle("request_order", EVENTS, state("txn"), select="""
 SELECT h.transaction_id, customer_history_count, txn_count_24h FROM hist h JOIN recent r USING (transaction_id)""")
oracle("source_row_cap", EVENTS, select="SELECT transaction_id, ts_sec FROM txn ORDER BY ts_sec, transaction_id LIMIT 1000")
oracle("pruned_scan", select="SELECT count(*) AS rows, round(CAST(sum(CAST(value AS DECIMAL(20,6))) AS DOUBLE), 4) AS total FROM events")

# ================================================================== quality
oracle("dq_shape", RAW, TYPED, select="""
 SELECT count(*) AS rows, CAST(10 AS BIGINT) AS n_columns, count(*) - count(DISTINCT transaction_id) AS duplicates FROM typed""")
oracle("dq_nulls", RAW, TYPED, select="""
 SELECT "column", nulls FROM (
  SELECT 'amount' AS "column", count(*) FILTER (WHERE amount IS NULL) AS nulls FROM typed
  UNION ALL SELECT unnest(['timestamp', 'ts_sec', 'transaction_hour', 'is_night']), count(*) FILTER (WHERE ts_sec IS NULL) FROM typed) WHERE nulls > 0""")
oracle("class_distribution", EVENTS, select="""
 SELECT is_fraud, count(*) AS rows, round(100.0::DOUBLE * count(*) / (SELECT count(*) FROM txn), 4) AS percent FROM txn GROUP BY 1""")


def described(c: str) -> str:
    return f"""SELECT '{c}' AS "column", round(avg({c}), 4) AS mean, round(stddev_samp({c}), 4) AS std,
 round(min({c})::DOUBLE, 4) AS min, round(quantile_cont({c}::DOUBLE, 0.25), 4) AS p25, round(quantile_cont({c}::DOUBLE, 0.5), 4) AS median,
 round(quantile_cont({c}::DOUBLE, 0.75), 4) AS p75, round(max({c})::DOUBLE, 4) AS max FROM txn"""


oracle("dq_describe", EVENTS, select=described("amount") + " UNION ALL " + described("transaction_hour"))
oracle("dq_describe_lines", LINES, select=described("amount"))
SUPPLIED = """glo AS (
 SELECT transaction_id, avg_amt, avg_log FROM (
  SELECT transaction_id, CAST(sum(CAST(amount AS DECIMAL(20,6))) OVER w AS DOUBLE) / count(*) OVER w AS avg_amt,
   CAST(sum(CAST(ln(1 + amount) AS DECIMAL(20,12))) OVER w AS DOUBLE) / count(*) OVER w AS avg_log
  FROM txn WINDOW w AS (ORDER BY ts_sec, transaction_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))),
supplied AS (
 SELECT h.*, txn_count_8m, avg_amt, avg_log,
  CASE WHEN customer_history_count >= 3 THEN CAST(sum_c AS DOUBLE) / customer_history_count ELSE coalesce(avg_amt, amount) END AS base
 FROM hist h JOIN recent USING (transaction_id) JOIN glo USING (transaction_id)),
sup AS (
 SELECT transaction_id, CAST(customer_history_count = 0 AS INT) AS new_customer, CAST(merchant_history_count = 0 AS INT) AS new_merchant,
  CAST(device_history_count = 0 AS INT) AS new_device, CAST(txn_count_8m AS INT) AS velocity_8min,
  CAST(base > 0 AND amount >= 2 * base AS INT) AS amount_spike, CAST(customer_history_count AS INT) AS customer_history_count,
  CAST(merchant_history_count AS INT) AS merchant_history_count, CAST(device_history_count AS INT) AS device_history_count,
  is_fraud FROM supplied)"""
CATEGORIES = ["new_customer", "new_merchant", "new_device", "is_fraud", "velocity_8min", "amount_spike",
              "customer_history_count", "merchant_history_count", "device_history_count"]
oracle("dq_categories", EVENTS, state("txn"), SUPPLIED, select=" UNION ALL ".join(
    f"""SELECT '{c}' AS "column", CAST({c} AS VARCHAR) AS value, count(*) AS rows FROM sup GROUP BY 2""" for c in CATEGORIES))
oracle("dq_time_range", LINES, select="""
 SELECT min(ts_sec) AS first_ts, max(ts_sec) AS last_ts, round((max(ts_sec) - min(ts_sec)) / 86400.0::DOUBLE, 1) AS days_span FROM txn""")
oracle("dq_entities", LINES, select="""
 SELECT count(DISTINCT customer_id) AS customers, count(DISTINCT merchant_id) AS merchants, count(DISTINCT device_id) AS devices FROM txn""")

# ================================================================== splits
oracle("time_split", *COMBINED, select="SELECT transaction_id, row_index, fold FROM fold")
oracle("time_split_lines", LINES, FOLDS, select="""
 SELECT fold, count(*) AS rows, min(transaction_id) AS first_id, min(ts_sec) AS first_ts, max(ts_sec) AS last_ts FROM fold GROUP BY fold""")
oracle("holdout_customers", LINES, FOLDS, select="SELECT customer_id FROM hold")
oracle("holdout_anti", *COMBINED, select="SELECT transaction_id, fold FROM comb")
oracle("id_set_members", *COMBINED, select="""
 SELECT fold, count(*) FILTER (WHERE customer_id IN (SELECT customer_id FROM hold)) AS held_out,
  count(*) FILTER (WHERE customer_id NOT IN (SELECT customer_id FROM hold)) AS others FROM comb GROUP BY fold""")
oracle("fold_union", *COMBINED, select="SELECT transaction_id, fold, amount FROM comb")
oracle("first_time_flags", *FULL, select="""
 SELECT transaction_id, first_time_customer, new_device AS first_time_device, new_merchant AS first_time_merchant,
  greatest(first_time_customer, new_device, new_merchant) AS first_time_any FROM feats""")
oracle("strata_tiers", LINES, select=f"""
 SELECT {STRATUM.format(n='n_c')} AS stratum,
  CASE WHEN n_c <= 0 THEN 'cold' WHEN n_c < 5 OR coalesce(ts_sec - first_c, 0) < 7 * 86400 THEN 'warm' ELSE 'established' END AS with_tenure,
  {TIER.format(n='n_m')} AS tier, count(*) AS rows
 FROM (SELECT ts_sec, count(*) OVER {before('customer_id')} AS n_c, min(ts_sec) OVER {before('customer_id')} AS first_c,
  count(*) OVER {before('merchant_id')} AS n_m FROM txn) GROUP BY 1, 2, 3""")
oracle("half_split", EVENTS, select="""
 SELECT transaction_id, CASE WHEN row_number() OVER (ORDER BY md5('42:' || transaction_id), transaction_id)
  <= CASE WHEN (SELECT count(*) FROM txn) // 2 < 200 THEN greatest(50, (SELECT count(*) FROM txn) // 2) ELSE (SELECT count(*) FROM txn) // 2 END
  THEN 'fit' ELSE 'eval' END AS half FROM txn""")
oracle("seeded_sample", EVENTS, select="SELECT transaction_id FROM txn ORDER BY md5('42:' || transaction_id), transaction_id LIMIT 500")
oracle("asof_cut", *DECISIONS, select="""
 SELECT customer_id, count(*) AS rows FROM txn WHERE ts_sec < (
  SELECT ts_sec FROM decided WHERE is_fraud = 1 AND alert ORDER BY rank_score DESC, ts_sec, transaction_id LIMIT 1) GROUP BY customer_id""")
oracle("extreme_pick", *DECISIONS, select="""
 (SELECT 'normal' AS example, transaction_id, risk_band, rank_score FROM decided WHERE is_fraud = 0 AND risk_band = 'normal'
  ORDER BY rank_score, ts_sec, transaction_id LIMIT 1)
 UNION ALL (SELECT 'suspicious', transaction_id, risk_band, rank_score FROM decided WHERE is_fraud = 1 AND alert
  ORDER BY rank_score DESC, ts_sec, transaction_id LIMIT 1)""")
oracle("legit_subset", *COMBINED, select="SELECT fold, count(*) AS rows FROM comb WHERE is_fraud = 0 GROUP BY fold")

# ================================================================== features
oracle("calendar_features", EVENTS, select="""
 SELECT transaction_id, round(ln(1 + amount), 6) AS amount_log, transaction_hour, CAST((ts_sec // 86400 + 3) % 7 AS INT) AS day_of_week,
  CAST((ts_sec // 86400 + 3) % 7 >= 5 AS INT) AS is_weekend, CAST(transaction_hour < 6 OR transaction_hour >= 23 AS INT) AS is_night FROM txn""")
COUNTS = f"""
 SELECT transaction_id, customer_history_count, merchant_history_count, device_history_count,
  round(ln(1.0::DOUBLE + customer_history_count), 6) AS customer_history_count_log,
  round(ln(1.0::DOUBLE + merchant_history_count), 6) AS merchant_history_count_log,
  round(ln(1.0::DOUBLE + device_history_count), 6) AS device_history_count_log,
  CAST(customer_history_count = 0 AS INT) AS first_time_customer, CAST(merchant_history_count = 0 AS INT) AS new_merchant,
  CAST(device_history_count = 0 AS INT) AS new_device, CAST(customer_history_count >= 3 AS INT) AS customer_history_available,
  CAST(merchant_history_count >= 3 AS INT) AS merchant_history_available, CAST(device_history_count >= 1 AS INT) AS device_history_available,
  round({CONF}, 6) AS customer_history_conf FROM hist"""
oracle("history_counts", EVENTS, state("txn"), select=COUNTS)
oracle("history_counts_lines", LINES, state("txn"), select=COUNTS)
oracle("running_moments", LINES, state("txn"), select="""
 SELECT transaction_id, round(mu_c, 5) AS mean_c, round(sd_c, 5) AS sd_c, round(mu_m, 5) AS mean_m, round(sd_m, 5) AS sd_m FROM hist""")
for suffix, base in (("", EVENTS), ("_lines", LINES)):
    oracle("velocity" + suffix, base, state("txn"), select="SELECT transaction_id, txn_count_5m, txn_count_30m, txn_count_24h FROM recent")
    oracle("distinct_24h" + suffix, base, state("txn"), select="SELECT transaction_id, distinct_merchants_24h, distinct_devices_24h FROM recent")
    oracle("amount_sum_24h" + suffix, base, state("txn"), select="SELECT transaction_id, round(amount_sum_24h, 4) AS amount_sum_24h FROM recent")
    oracle("asof_supplied" + suffix, base, state("txn"), SUPPLIED, select="SELECT * EXCLUDE (is_fraud) FROM sup")
oracle("hot_key_state", LINES, state("txn"), select="""
 SELECT h.transaction_id, customer_history_count, merchant_history_count, device_history_count, txn_count_5m, txn_count_30m, txn_count_24h,
  distinct_merchants_24h, distinct_devices_24h, round(amount_sum_24h, 4) AS amount_sum_24h, round(mu_c, 4) AS mean_c, round(sd_c, 4) AS sd_c,
  round(mu_m, 4) AS mean_m, last_d FROM hist h JOIN recent r USING (transaction_id)""")
oracle("hot_key_agreement", LINES, select="""
 SELECT n, name, true AS agrees FROM (SELECT count(*) AS n FROM txn), (VALUES ('_mu_c'), ('_sd_c'), ('_mu_m'), ('_sd_m')) v(name)""")
oracle("time_since", *FULL, select="""
 SELECT transaction_id, round(time_since_customer_txn_log, 6) AS time_since_customer_txn_log,
  round(time_since_device_txn_log, 6) AS time_since_device_txn_log FROM feats""")
oracle("running_global", LINES, state("txn"), SUPPLIED, select="""
 SELECT transaction_id, avg_amt AS running_mean_amount, round(avg_log, 4) AS running_mean_log FROM glo""")
oracle("parity_rates", EVENTS, FOLDS, state("comb"), """glo_c AS (
 SELECT transaction_id, CAST(sum(CAST(amount AS DECIMAL(20,6))) OVER w AS DOUBLE) / count(*) OVER w AS avg_amt FROM comb
  WINDOW w AS (ORDER BY ts_sec, transaction_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
again AS (
 SELECT transaction_id, txn_count_8m AS v, CAST(base > 0 AND amount >= 2 * base AS INT) AS s FROM (
  SELECT h.transaction_id, amount, txn_count_8m, CASE WHEN customer_history_count >= 3 THEN CAST(sum_c AS DOUBLE) / customer_history_count
   ELSE coalesce(avg_amt, amount) END AS base FROM hist h JOIN recent USING (transaction_id) JOIN glo_c USING (transaction_id)))""",
       select="SELECT * FROM again")
_again = ORACLES.pop("parity_rates")
ORACLES["parity_rates"] = f"""
SELECT count(*) AS rows_checked, round(avg(CAST(v = velocity_8min AS INT)), 4) AS velocity_8min_match_rate,
 round(avg(CAST(s = amount_spike AS INT)), 4) AS amount_spike_match_rate
FROM ({_again}) JOIN ({ORACLES['asof_supplied']}) USING (transaction_id)"""
oracle("feature_availability", *FULL, select="SELECT " + ", ".join(
    f"round(avg({c}), 4) AS {c}_rate" for c in ("customer_history_available", "first_time_customer", "new_device", "new_merchant")) + " FROM feats")
oracle("amount_bucket", *FULL, select="SELECT amount_bucket, count(*) AS rows FROM feats GROUP BY 1")

DOUBLES = [f for f in MODEL_FEATURES if f.endswith(("_log", "_z", "_shrunk", "_conf", "_baseline", "_prior"))]


def rounded(names: list[str], digits: int) -> str:
    return ", ".join(f"round({n}, {digits}) AS {n}" if n in DOUBLES or n == "amount" else n for n in names)


oracle("shrunk_z", *FULL, select="SELECT " + rounded([
    "transaction_id", "history_stratum", "customer_history_conf", "customer_amount_baseline", "segment_amount_baseline",
    "segment_risk_prior", "amount_z_shrunk", "customer_amount_z", "merchant_amount_z", "customer_avg_amount_log",
    "merchant_avg_amount_log"], 5) + " FROM feats")
oracle("feature_core", EVENTS, state("txn"), select="""
 SELECT h.transaction_id, h.ts_sec, round(amount_log, 5) AS amount_log, customer_history_count, merchant_history_count, device_history_count,
  txn_count_5m, txn_count_30m, txn_count_24h, distinct_merchants_24h, distinct_devices_24h,
  round(ln(1 + amount_sum_24h), 5) AS amount_sum_24h_log,
  round(coalesce(ln(1 + (ts_sec - last_c) / 3600.0::DOUBLE), 0), 5) AS time_since_customer_txn_log,
  round(coalesce(ln(1 + (ts_sec - last_d) / 3600.0::DOUBLE), 0), 5) AS time_since_device_txn_log
 FROM hist h JOIN recent r USING (transaction_id)""")
oracle("feature_full", *FULL, select="SELECT " + rounded(
    ["transaction_id", "fold", "ts_sec", "customer_id", "merchant_id", "device_id", "amount", "transaction_hour", "is_night",
     "day_of_week", "is_weekend", "is_fraud"] + [f for f in MODEL_FEATURES if f not in ("transaction_hour", "is_night", "day_of_week", "is_weekend")], 5) + " FROM feats")
oracle("feature_vector", *FULL, select=" UNION ALL ".join(
    f"SELECT {i} AS pos, round(sum({f})::DOUBLE, 2) AS total FROM feats" for i, f in enumerate(MODEL_FEATURES)))

# ================================================================== priors
oracle("segment_priors_cube", *FITTED, select="SELECT stratum, tier, round(mean, 6) AS mean, round(sd, 6) AS sd, n, round(risk, 6) AS risk FROM seg")
oracle("global_prior", *FITTED, select="SELECT round(mean, 6) AS mean, round(sd, 6) AS sd, n, round(risk, 6) AS risk FROM gprior")
oracle("segment_lookup", *FITTED, select="SELECT stratum, tier, round(mu_seg, 6) AS mu_seg, round(sd_seg, 6) AS sd_seg, round(risk_seg, 6) AS risk_seg FROM looked")
oracle("amount_octiles", *FITTED, select=" UNION ALL ".join(f"SELECT {i} AS octile, round(e{i}, 6) AS edge FROM gprior" for i in range(1, 8)))

# ================================================================== decisions
oracle("class_weights", *COMBINED, select="""
 SELECT pos, neg, round(sqrt(neg / pos), 6) AS sqrt_weight, round((pos + neg) / (2.0::DOUBLE * pos), 6) AS balanced_pos,
  round((pos + neg) / (2.0::DOUBLE * neg), 6) AS balanced_neg
 FROM (SELECT count(*) FILTER (WHERE is_fraud = 1) AS pos, count(*) FILTER (WHERE is_fraud = 0) AS neg FROM comb WHERE fold = 'train')""")
oracle("thresholds_quantile", *SCORES, select="SELECT * FROM thr")
oracle("fixed_scores", *SCORES, select="SELECT transaction_id, fold, round(p, 6) AS p FROM scored")
oracle("ecdf_reference", *FULL, select="""
 SELECT v, ref, CAST(sum(ref) OVER (ORDER BY v) AS BIGINT) AS at_or_below FROM (
  SELECT round(round(abs(amount_z_shrunk), 6), 1) AS v, count(*) AS ref FROM feats WHERE fold = 'val' AND is_fraud = 0 GROUP BY 1)""")
oracle("ecdf_novelty", *SCORES, select="SELECT transaction_id, round(novelty, 6) AS novelty FROM scored")
oracle("risk_bands", *DECISIONS, select="SELECT transaction_id, fraud_probability, novelty_score, risk_band, alert, rank_score, budget_status FROM decided")
oracle("risk_tags", *DECISIONS, select="""
 SELECT transaction_id, concat_ws(',', CASE WHEN risk_band = 'high-risk' THEN 'high_probability' END,
  CASE WHEN novelty >= novelty_high AND risk_band <> 'normal' THEN 'novel_pattern' END) AS tags FROM decided""")
oracle("rebudget", *DECISIONS, f"""kk AS (
 SELECT n, k, least(greatest(CAST(round_even(k * {D(70.0)} / {D(100.0)}, 0) AS BIGINT), 1), n) AS kh FROM (
  SELECT n, least(greatest(CAST(round_even(n * {D(3.0)} / {D(100.0)}, 0) AS BIGINT), 1), n) AS k FROM (SELECT count(*) AS n FROM decided))),
ranked AS (SELECT fraud_probability AS p, row_number() OVER (ORDER BY fraud_probability DESC) AS r FROM decided),
t2 AS (SELECT max(p) FILTER (WHERE r = k) AS p_review, max(p) FILTER (WHERE r = kh) AS p_high, {D(0.9)} AS novelty_high,
 {D(0.97)} AS novelty_very_high, {D(0.02)} AS p_floor_for_novelty FROM ranked, kk)""", select=f"""
 SELECT transaction_id, risk_band, risk_band IN ('review', 'high-risk') AS alert,
  CASE WHEN risk_band IN ('review', 'high-risk') THEN 'alert' ELSE 'log' END AS budget_status, rank_score FROM (
  SELECT transaction_id, {BAND.format(p='fraud_probability', n='novelty_score')} AS risk_band,
   round({D(0.7)} * fraud_probability + {D(0.3)} * novelty_score, 6) AS rank_score
  FROM (SELECT transaction_id, fraud_probability, novelty_score FROM decided) CROSS JOIN t2)""")
oracle("alert_topk", *DECISIONS, select="""
 SELECT transaction_id, fraud_probability, novelty_score, risk_band, rank_score FROM decided WHERE alert
 ORDER BY rank_score DESC, ts_sec, transaction_id LIMIT 25""")
oracle("alert_list", *DECISIONS, select="SELECT transaction_id, risk_band, rank_score FROM decided WHERE alert")
VOLUME = f"""vol AS (
 SELECT *, ts_sec // 86400 AS day, row_number() OVER (PARTITION BY ts_sec // 86400 ORDER BY ts_sec, transaction_id) AS day_volume FROM decided),
caps AS (
 SELECT *, greatest(3, CAST(floor(day_volume * {D(2.0)} / {D(100.0)}) AS BIGINT)) AS budget_cap,
  greatest(2, CAST(floor(day_volume * {D(0.7)} / {D(100.0)}) AS BIGINT)) AS high_cap FROM vol)"""
oracle("budget_volume", *DECISIONS, VOLUME, select="SELECT transaction_id, day, day_volume, budget_cap, high_cap FROM caps")
# the recursion over candidates, written with lists of the escalated seconds
BUDGET = """cand AS MATERIALIZED (
 SELECT transaction_id, ts_sec, day, risk_band, budget_cap, high_cap, row_number() OVER (ORDER BY ts_sec, transaction_id) AS i
 FROM caps WHERE alert)"""
WALK = """walk AS (
 SELECT CAST(0 AS BIGINT) AS i, CAST(NULL AS VARCHAR) AS transaction_id, false AS ok, CAST([] AS BIGINT[]) AS alerts, CAST([] AS BIGINT[]) AS highs
 UNION ALL
 SELECT i, transaction_id, ok, CASE WHEN ok THEN list_append(alerts, ts_sec) ELSE alerts END,
  CASE WHEN ok AND risk_band = 'high-risk' THEN list_append(highs, ts_sec) ELSE highs END
 FROM (
  SELECT c.i, c.transaction_id, c.ts_sec, c.risk_band, alerts, highs,
   (c.risk_band <> 'high-risk' OR len(list_filter(highs, lambda t: t // 86400 = c.day)) < high_cap)
   AND len(list_filter(alerts, lambda t: c.ts_sec - t <= 3600)) < 250 AND len(list_filter(alerts, lambda t: c.ts_sec - t <= 86400)) < 3000
   AND len(list_filter(alerts, lambda t: t // 86400 = c.day)) < budget_cap AS ok
  FROM walk w JOIN cand c ON c.i = w.i + 1))"""
STATUS = "st AS (SELECT d.*, CASE WHEN coalesce(w.ok, false) THEN 'alert' ELSE 'log' END AS status FROM decided d LEFT JOIN walk w USING (transaction_id))"


def recursive(*ctes: str, select: str) -> str:
    return "WITH RECURSIVE " + ",\n".join(ctes) + "\n" + select


ORACLES["alert_budget"] = recursive(*DECISIONS, VOLUME, BUDGET, WALK, STATUS, select="SELECT transaction_id, risk_band, status AS budget_status FROM st")
ORACLES["alert_budget_counters"] = recursive(*DECISIONS, VOLUME, BUDGET, WALK, STATUS, select="""
 SELECT count(*) FILTER (WHERE status = 'alert' AND risk_band = 'high-risk') AS escalated_high,
  count(*) FILTER (WHERE status = 'alert' AND risk_band = 'review') AS escalated_review,
  count(*) FILTER (WHERE status = 'alert') AS total_escalated, count(*) FILTER (WHERE status <> 'alert') AS logged FROM st""")

# ================================================================== reasons
CONTRIB = "means AS (SELECT " + ", ".join(f"avg({f}) AS m_{f}" for f in MODEL_FEATURES) + " FROM feats WHERE fold = 'train'),\n" + \
    "contrib AS (SELECT feats.*, " + ", ".join(f"{D(ALL_WEIGHTS[f])} * ({f} - m_{f}) AS c_{f}" for f in MODEL_FEATURES) + \
    " FROM feats CROSS JOIN means WHERE fold = 'test')"
oracle("linear_contrib", *FULL, CONTRIB, select="SELECT transaction_id, " + ", ".join(f"round(c_{f}, 5) AS {f}" for f in WEIGHTS) + " FROM contrib")
oracle("linear_importance", *FULL, CONTRIB, select=" UNION ALL ".join(
    f"SELECT '{f}' AS feature, round(avg(abs(c_{f})), 6) AS mean_abs_contribution FROM contrib" for f in MODEL_FEATURES))


def sentence(group: str) -> str:
    up = "CASE WHEN c >= 0 THEN 'increases risk' ELSE 'reduces risk' END"
    z = "amount_z_shrunk"
    return {
        "velocity": f"printf('Velocity %s: %d txns in last 5 min, %d in 30 min, %d in 24h (%s).', CASE WHEN c >= 0 THEN 'elevated' ELSE 'low' END, txn_count_5m, txn_count_30m, txn_count_24h, {up})",
        "amount": f"CASE WHEN {z} > 0.5 THEN printf('Amount is %.1f sd above the historical baseline (z=%.2f) (%s).', abs({z}), {z}, {up})"
                  f" WHEN {z} < -0.5 THEN printf('Amount is %.1f sd below the historical baseline (z=%.2f) (%s).', abs({z}), {z}, {up})"
                  f" ELSE printf('Amount close to the historical baseline (z=%.2f) (%s).', {z}, {up}) END",
        "time": f"printf('Transaction at %02d:00 %s (%s).', transaction_hour, CASE WHEN is_night = 1 THEN '(night-time)' ELSE '' END, {up})",
        "device": f"CASE WHEN new_device = 1 THEN printf('The device has not been observed previously (%s).', {up}) ELSE printf('Device seen %d time(s) before; behaviour %s.', device_history_count, {up}) END",
        "merchant": f"CASE WHEN new_merchant = 1 THEN printf('The merchant has not been observed previously (%s).', {up}) ELSE printf('Merchant seen %d time(s) before; behaviour %s.', merchant_history_count, {up}) END",
        "history": f"CASE WHEN first_time_customer = 1 THEN printf('First transaction for this customer; using segment-level baseline (%s).', {up})"
                   f" ELSE printf('Customer history: %d prior txns, confidence %.2f (%s).', customer_history_count, customer_history_conf, {up}) END",
    }[group]


GROUPED = "grp AS (" + " UNION ALL ".join(
    f"SELECT *, {i} AS ord, '{g}' AS feature, {sentence(g)} AS reason FROM (SELECT *, " + " + ".join(f"c_{f}" for f in members) + " AS c FROM contrib)"
    for i, (g, members) in enumerate(REASON_GROUPS.items())) + "),\n" + """top5 AS (
 SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY transaction_id ORDER BY abs(c) DESC, ord) - 1 AS place FROM grp) WHERE place < 5 AND abs(c) >= 0.0001)"""
oracle("reason_groups", *FULL, CONTRIB, GROUPED, select="""
 SELECT transaction_id, CAST(place AS INT) AS place, feature, CASE WHEN c >= 0 THEN 'increases_risk' ELSE 'decreases_risk' END AS effect,
  round(c, 4) AS contribution FROM top5""")
oracle("reason_text", *FULL, CONTRIB, GROUPED, select="""
 SELECT transaction_id, string_agg(reason, '; ' ORDER BY place) AS explanation,
  CAST(count(*) FILTER (WHERE round(c, 4) > 0) AS INT) AS n_positive, CAST(count(*) FILTER (WHERE round(c, 4) < 0) AS INT) AS n_negative
 FROM top5 GROUP BY transaction_id""")
oracle("reasons_ungrouped", *FULL, CONTRIB, select="""
 SELECT transaction_id, string_agg(f, ',' ORDER BY place) AS top FROM (
  SELECT *, row_number() OVER (PARTITION BY transaction_id ORDER BY abs(c) DESC, ord) AS place FROM (""" + " UNION ALL ".join(
    f"SELECT transaction_id, {i} AS ord, '{f}' AS f, c_{f} AS c FROM contrib" for i, f in enumerate(MODEL_FEATURES)) + """))
 WHERE place <= 3 AND abs(c) >= 0.0001 GROUP BY transaction_id""")

# ================================================================== metrics
FLAGGED = """known AS (SELECT DISTINCT customer_id FROM comb WHERE fold = 'train'),
flagged AS (
 SELECT *, 1 - unseen_customer AS known_customer, new_device AS first_time_device, new_merchant AS first_time_merchant,
  greatest(first_time_customer, new_device, new_merchant) AS first_time_any
 FROM (SELECT *, CAST(customer_id NOT IN (SELECT customer_id FROM known) AS INT) AS unseen_customer FROM decided))"""


def ranking(source: str, score: str, by: str = "") -> str:
    """pr_auc and roc_auc per group, from pairwise-free rank sums over raw rows."""
    g = f"{by}, " if by else ""
    part = f"PARTITION BY {by}" if by else ""
    return f"""(SELECT {g}CASE WHEN max(p1) > 0 AND max(p0) > 0 THEN sum(CASE WHEN y = 1 THEN hits / CAST(seen AS DOUBLE) END) / max(p1) END AS pr_auc,
  CASE WHEN max(p1) > 0 AND max(p0) > 0 THEN (sum(CASE WHEN y = 1 THEN lower_n + (tied + 1) / 2.0::DOUBLE END) - max(p1) * (max(p1) + 1) / 2.0::DOUBLE) / (max(p1) * CAST(max(p0) AS DOUBLE)) END AS roc_auc
  FROM (SELECT {g}is_fraud AS y, sum(is_fraud) OVER ({part}) AS p1, sum(1 - is_fraud) OVER ({part}) AS p0,
   sum(is_fraud) OVER ({part} ORDER BY {score} DESC) AS hits, count(*) OVER ({part} ORDER BY {score} DESC) AS seen,
   rank() OVER ({part} ORDER BY {score}) - 1 AS lower_n, count(*) OVER (PARTITION BY {g}{score}) AS tied FROM {source}) {f'GROUP BY {by}' if by else ''})"""


oracle("cohort_flags", *DECISIONS, FLAGGED, select="""
 SELECT transaction_id, unseen_customer, known_customer, first_time_customer, first_time_device, first_time_merchant, first_time_any FROM flagged""")
oracle("avg_precision", *DECISIONS, select=f"SELECT round(pr_auc, 6) AS pr_auc FROM {ranking('decided', 'fraud_probability')}")
oracle("roc_auc", *DECISIONS, select=f"""
 SELECT 'probability' AS score, round(roc_auc, 6) AS roc_auc FROM {ranking('decided', 'fraud_probability')}
 UNION ALL SELECT 'novelty', round(roc_auc, 6) FROM {ranking('decided', 'novelty_score')}""")
oracle("pr_curve", *DECISIONS, select="""
 SELECT score, CAST(alerted AS BIGINT) AS alerted, CAST(caught AS BIGINT) AS caught, round(caught / CAST(alerted AS DOUBLE), 6) AS precision,
  round(caught / CAST(positives AS DOUBLE), 6) AS recall FROM (
  SELECT DISTINCT fraud_probability AS score, count(*) OVER (ORDER BY fraud_probability DESC) AS alerted,
   sum(is_fraud) OVER (ORDER BY fraud_probability DESC) AS caught, sum(is_fraud) OVER () AS positives FROM decided)""")
oracle("confusion", *DECISIONS, select="""
 SELECT tn, fp, fn, tp, round(tp / CAST(tp + fp AS DOUBLE), 4) AS precision, round(tp / CAST(tp + fn AS DOUBLE), 4) AS recall,
  round(2 * tp / CAST(2 * tp + fp + fn AS DOUBLE), 4) AS f1 FROM (
  SELECT count(*) FILTER (WHERE is_fraud = 0 AND NOT alert) AS tn, count(*) FILTER (WHERE is_fraud = 0 AND alert) AS fp,
   count(*) FILTER (WHERE is_fraud = 1 AND NOT alert) AS fn, count(*) FILTER (WHERE is_fraud = 1 AND alert) AS tp FROM decided)""")
oracle("recall_at_budget", *DECISIONS, select=f"""
 SELECT budget_pct, count(*) FILTER (WHERE r <= k) AS alerts,
  round(count(*) FILTER (WHERE r <= k AND is_fraud = 1) / CAST(greatest(sum(is_fraud), 1) AS DOUBLE), 6) AS recall,
  round(count(*) FILTER (WHERE r <= k AND is_fraud = 1) / CAST(count(*) FILTER (WHERE r <= k) AS DOUBLE), 6) AS precision,
  count(*) FILTER (WHERE r <= k AND is_fraud = 1) AS tp, count(*) FILTER (WHERE r <= k AND is_fraud = 0) AS fp
 FROM (SELECT is_fraud, budget_pct, row_number() OVER (PARTITION BY budget_pct ORDER BY fraud_probability DESC, ts_sec, transaction_id) AS r,
   greatest(1, CAST(round_even(count(*) OVER (PARTITION BY budget_pct) * budget_pct / 100.0::DOUBLE, 0) AS BIGINT)) AS k
  FROM decided CROSS JOIN (SELECT unnest([0.5, 1.0, 2.0, 3.0, 5.0]::DOUBLE[]) AS budget_pct)) GROUP BY budget_pct""")
oracle("brier", *DECISIONS, select="SELECT round(avg((fraud_probability - is_fraud) * (fraud_probability - is_fraud)), 6) AS brier FROM decided")
EDGES = " + ".join(f"(fraud_probability >= {D(i / 10)})::INT" for i in range(1, 10))
oracle("ece", *DECISIONS, select=f"""
 SELECT round(coalesce(sum(n * abs(pm - om)) / (SELECT count(*) FROM decided), 0), 5) AS ece FROM (
  SELECT {EDGES} AS b, count(*) AS n, avg(fraud_probability) AS pm, avg(is_fraud) AS om FROM decided WHERE fraud_probability < 1 GROUP BY 1)""")
oracle("reliability", *DECISIONS, select=f"""
 SELECT CAST(r.b AS INT) AS bin, coalesce(n, 0) AS count, round(pm, 6) AS predicted_mean, round(om, 6) AS observed_mean FROM range(10) r(b) LEFT JOIN (
  SELECT {EDGES} AS b, count(*) AS n, avg(fraud_probability) AS pm, avg(is_fraud) AS om FROM decided GROUP BY 1) x ON x.b = r.b""")
oracle("reliability_summary", *DECISIONS, select=f"""
 SELECT round(sum(n * abs(pm - om)) / sum(n), 5) AS ece, CAST(sum(n) AS BIGINT) AS rows FROM (
  SELECT {EDGES} AS b, count(*) AS n, avg(fraud_probability) AS pm, avg(is_fraud) AS om FROM decided GROUP BY 1)""")
LONG = """long AS (
 SELECT 'all' AS cohort, * FROM flagged UNION ALL SELECT 'known_customers', * FROM flagged WHERE known_customer = 1
 UNION ALL SELECT 'unseen_customers', * FROM flagged WHERE unseen_customer = 1
 UNION ALL SELECT 'first_time_customers', * FROM flagged WHERE first_time_customer = 1
 UNION ALL SELECT 'new_devices', * FROM flagged WHERE first_time_device = 1
 UNION ALL SELECT 'new_merchants', * FROM flagged WHERE first_time_merchant = 1),
kall AS (SELECT greatest(1, CAST(round_even(count(*) * 2.0::DOUBLE / 100.0::DOUBLE, 0) AS BIGINT)) AS k FROM flagged),
facts AS (
 SELECT cohort, count(*) AS n_rows, CAST(sum(is_fraud) AS BIGINT) AS n_fraud, avg((fraud_probability - is_fraud) * (fraud_probability - is_fraud)) AS brier,
  count(*) FILTER (WHERE r <= k AND is_fraud = 1) AS tp, count(*) FILTER (WHERE r <= k) AS al,
  avg(CAST(novelty_score >= 0.9::DOUBLE AS INT)) FILTER (WHERE is_fraud = 0) AS fnr
 FROM (SELECT *, row_number() OVER (PARTITION BY cohort ORDER BY fraud_probability DESC, ts_sec, transaction_id) AS r FROM long) CROSS JOIN kall GROUP BY cohort),
report AS (
 SELECT f.cohort, n_rows, n_fraud, round(n_fraud / CAST(n_rows AS DOUBLE), 4) AS fraud_rate, round(a.pr_auc, 4) AS pr_auc, round(a.roc_auc, 4) AS roc_auc,
  CASE WHEN n_fraud > 0 AND n_fraud < n_rows THEN round(brier, 4) END AS brier, round(b.roc_auc, 4) AS novelty_auroc,
  round(tp / CAST(greatest(n_fraud, 1) AS DOUBLE), 4) AS recall_at_budget, round(tp / CAST(al AS DOUBLE), 4) AS precision_at_budget,
  round(fnr, 4) AS false_novelty_rate
 FROM facts f JOIN """ + ranking("long", "fraud_probability", "cohort") + " a ON a.cohort = f.cohort JOIN " + ranking("long", "novelty_score", "cohort") + " b ON b.cohort = f.cohort)"
oracle("cohort_report", *DECISIONS, FLAGGED, LONG, select="SELECT * FROM report")
oracle("alert_metrics", *DECISIONS, select="""
 SELECT n AS total_transactions, a AS alerts_generated, h AS high_risk_alerts, r AS review_alerts, m AS monitor_logged,
  round(100.0::DOUBLE * a / n, 4) AS alert_rate_pct, round(tp / CAST(a AS DOUBLE), 4) AS alert_precision,
  round(tp / CAST(y AS DOUBLE), 4) AS alert_recall, round(a / CAST(greatest(tp, 1) AS DOUBLE), 2) AS alerts_per_caught_fraud FROM (
  SELECT count(*) AS n, count(*) FILTER (WHERE alert) AS a, count(*) FILTER (WHERE risk_band = 'high-risk') AS h,
   count(*) FILTER (WHERE risk_band = 'review') AS r, count(*) FILTER (WHERE risk_band = 'monitor') AS m,
   count(*) FILTER (WHERE alert AND is_fraud = 1) AS tp, count(*) FILTER (WHERE is_fraud = 1) AS y FROM decided)""")
FP = "fp AS (" + " UNION ALL ".join(
    f"""SELECT '{c}' AS kind, count(*) AS legit_first_time_rows, count(*) FILTER (WHERE alert) AS fp_alerts,
 CASE WHEN count(*) > 0 THEN round(count(*) FILTER (WHERE alert) / CAST(count(*) AS DOUBLE), 4) ELSE 0 END AS false_positive_rate
 FROM flagged WHERE {c} = 1 AND is_fraud = 0""" for c in ("first_time_customer", "first_time_device", "first_time_merchant", "first_time_any")) + ")"
oracle("first_time_fp", *DECISIONS, FLAGGED, FP, select="SELECT * FROM fp")
oracle("seen_unseen_split", *DECISIONS, FLAGGED, select=f"""
 SELECT CASE WHEN f.unseen_customer = 1 THEN 'Unseen' ELSE 'Seen' END AS cohort, rows, fraud, round(pr_auc, 3) AS pr_auc, round(roc_auc, 3) AS roc_auc,
  round(tp / CAST(fraud AS DOUBLE), 3) AS recall_at_2pct FROM (
  SELECT unseen_customer, count(*) AS rows, CAST(sum(is_fraud) AS BIGINT) AS fraud, count(*) FILTER (WHERE r <= k AND is_fraud = 1) AS tp FROM (
   SELECT *, row_number() OVER (PARTITION BY unseen_customer ORDER BY fraud_probability DESC, ts_sec, transaction_id) AS r,
    greatest(1, CAST(round_even(count(*) OVER (PARTITION BY unseen_customer) * 0.02::DOUBLE, 0) AS BIGINT)) AS k FROM flagged) GROUP BY 1) f
 JOIN {ranking('flagged', 'fraud_probability', 'unseen_customer')} m ON m.unseen_customer = f.unseen_customer WHERE fraud > 0 AND fraud < rows""")
oracle("cohort_table", *DECISIONS, FLAGGED, LONG, FP, select="""
 SELECT cohort, pr_auc, roc_auc, recall_at_budget, CAST(NULL AS VARCHAR) AS first_time_kind, CAST(NULL AS DOUBLE) AS fpr_first_time FROM report
 WHERE cohort IN ('all', 'known_customers', 'unseen_customers')
 UNION ALL SELECT kind, NULL, NULL, NULL, kind, false_positive_rate FROM fp""")
oracle("leakage_audit", *COMBINED, select="SELECT count(*) AS rows, feature, CAST(0 AS BIGINT) AS mismatches FROM fold CROSS JOIN (SELECT unnest(["
       + ", ".join(f"'{f}'" for f in MODEL_FEATURES) + "]) AS feature) WHERE fold = 'train' GROUP BY feature")

# ================================================================== describe
oracle("fraud_by_hour", EVENTS, select="SELECT transaction_hour, count(*) AS rows, round(avg(is_fraud), 6) AS fraud_rate FROM txn GROUP BY 1")
oracle("fraud_by_newness", LINES, state("txn"), select=" UNION ALL ".join(
    f"SELECT 'new_{k}' AS flag, CAST({k}_history_count = 0 AS INT) AS value, count(*) AS rows, round(avg(is_fraud), 6) AS fraud_rate FROM hist GROUP BY 2"
    for k in ("customer", "device")))


def histogram(source: str, value: str, bins: int, extra: str = "") -> str:
    return f"""SELECT class, CAST(CASE WHEN hi > lo THEN least(floor((v - lo) / (hi - lo) * {bins}), {bins - 1}) ELSE 0 END AS INT) AS bin, count(*) AS rows{extra}
 FROM (SELECT is_fraud AS class, {value} AS v, min({value}) OVER (PARTITION BY is_fraud) AS lo, max({value}) OVER (PARTITION BY is_fraud) AS hi FROM {source}) GROUP BY 1, 2"""


oracle("log_amount_hist", LINES, select=histogram("txn", "ln(1 + amount)", 60))
oracle("score_hist", *DECISIONS, select=histogram("decided", "fraud_probability", 40, ", 'probability' AS score") + " UNION ALL "
       + histogram("decided", "novelty_score", 40, ", 'novelty' AS score"))
oracle("prob_novelty_grid", *DECISIONS, select="""
 SELECT CAST(least(floor(fraud_probability * 20), 19) AS INT) AS p_cell, CAST(least(floor(novelty_score * 20), 19) AS INT) AS novelty_cell,
  is_fraud, count(*) AS rows FROM decided GROUP BY 1, 2, 3""")
oracle("band_counts", *DECISIONS, select="""
 SELECT risk_band, count(*) AS rows, CAST(list_position(['normal', 'monitor', 'review', 'high-risk'], risk_band) AS INT) AS position FROM decided GROUP BY 1""")
oracle("daily_alerts", *DECISIONS, select="SELECT ts_sec // 86400 AS day, count(*) AS alerts FROM decided WHERE alert GROUP BY 1")
oracle("cold_vs_established", *FULL, select="""
 SELECT history_stratum, count(*) AS rows, round(avg(abs(amount_z_shrunk)), 4) AS mean_abs_z FROM feats GROUP BY 1""")
oracle("novelty_summary", *DECISIONS, select="""
 SELECT count(*) AS rows, round(avg(novelty_score), 4) AS mean, round(stddev_samp(novelty_score), 4) AS std, min(novelty_score) AS min,
  round(quantile_cont(novelty_score, 0.25), 4) AS p25, round(quantile_cont(novelty_score, 0.5), 4) AS median,
  round(quantile_cont(novelty_score, 0.75), 4) AS p75, max(novelty_score) AS max,
  round(avg(CAST(novelty_score > 0.9::DOUBLE AS INT)), 4) AS share_atypical FROM decided""")
oracle("file_report", *DECISIONS, select=f"""
 SELECT n AS rows_scored, a AS alerts_fired, h AS high_risk, r AS review, m AS monitor, o AS normal, round(100.0::DOUBLE * a / n, 3) AS alert_rate_pct,
  y AS fraud_rows_in_file, round(100.0::DOUBLE * y / n, 3) AS fraud_rate_pct, round(tp / CAST(a AS DOUBLE), 4) AS alert_precision,
  round(tp / CAST(y AS DOUBLE), 4) AS alert_recall, round(pr_auc, 4) AS pr_auc, round(roc_auc, 4) AS roc_auc FROM (
  SELECT count(*) AS n, count(*) FILTER (WHERE alert) AS a, count(*) FILTER (WHERE risk_band = 'high-risk') AS h,
   count(*) FILTER (WHERE risk_band = 'review') AS r, count(*) FILTER (WHERE risk_band = 'monitor') AS m, count(*) FILTER (WHERE risk_band = 'normal') AS o,
   count(*) FILTER (WHERE alert AND is_fraud = 1) AS tp, count(*) FILTER (WHERE is_fraud = 1) AS y FROM decided), {ranking('decided', 'fraud_probability')}""")
oracle("tag_top3", *DECISIONS, select="""
 SELECT tag, count(*) AS rows FROM (
  SELECT 'high_probability' AS tag FROM decided WHERE risk_band = 'high-risk'
  UNION ALL SELECT 'novel_pattern' FROM decided WHERE novelty >= novelty_high AND risk_band <> 'normal') GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 3""")
oracle("insight_facts", *DECISIONS, FLAGGED, select="""
 SELECT count(*) AS rows, count(*) FILTER (WHERE alert) AS alerting, round(100.0::DOUBLE * avg(CAST(alert AS INT)), 1) AS alerting_pct,
  CAST(sum(unseen_customer) AS BIGINT) AS unseen, round(100.0::DOUBLE * avg(unseen_customer), 1) AS unseen_pct FROM flagged""")
oracle("mean_amount", LINES, select="SELECT is_fraud, count(*) AS rows, round(avg(amount), 4) AS mean_amount FROM txn GROUP BY 1")

# ================================================================== models, sinks, streams
NOVEL = [f for f in NOVELTY_FEATURES]
oracle("gaussian_novelty", *FULL, "nm AS (SELECT " + ", ".join(f"avg({f}) AS a_{f}, stddev_pop({f}) AS s_{f}" for f in NOVEL)
       + " FROM feats WHERE fold = 'train' AND is_fraud = 0)", select="SELECT transaction_id, round(sqrt("
       + " + ".join(f"CASE WHEN s_{f} > {D(1e-12)} THEN pow(({f} - a_{f}) / s_{f}, 2) ELSE 0 END" for f in NOVEL)
       + "), 4) AS deviation FROM feats CROSS JOIN nm WHERE fold = 'test'")
oracle("saved_bundle_scores", select="SELECT CAST(0 AS BIGINT) AS differing_rows")
oracle("parquet_sink", *COMBINED, select="SELECT fold, count(*) AS rows FROM comb GROUP BY fold")
oracle("csv_sink", *DECISIONS, select="SELECT transaction_id, fraud_probability, risk_band FROM decided")
oracle("csv_round_trip", EVENTS, select="SELECT * FROM txn")
oracle("json_sink", *DECISIONS, select="""
 SELECT transaction_id, risk_band, CAST((risk_band = 'high-risk')::INT + (novelty >= novelty_high AND risk_band <> 'normal')::INT AS INT) AS n_tags FROM decided""")
oracle("stream_features", *FULL, select="SELECT " + rounded(
    ["transaction_id", "ts_sec", "customer_id", "merchant_id", "device_id", "amount", "transaction_hour", "is_night",
     "day_of_week", "is_weekend", "is_fraud"] + [f for f in MODEL_FEATURES if f not in ("transaction_hour", "is_night", "day_of_week", "is_weekend")], 4) + " FROM feats WHERE fold = 'test'")
ORACLES["stream_budget"] = ORACLES["alert_budget"]
oracle("tree_contrib", *COMBINED, select="SELECT transaction_id, 0.0::DOUBLE AS difference FROM comb WHERE fold = 'test'")
oracle("stream_daily_alerts", *DECISIONS, select="SELECT ts_sec // 86400 AS day, count(*) AS alerts FROM decided WHERE alert GROUP BY 1")
ORACLES["stream_held_order"] = ORACLES["stream_features"]
oracle("stream_decisions", select="SELECT CAST(0 AS BIGINT) AS differing_rows")
oracle("stream_late_rows", *COMBINED, """late_at AS (
 SELECT transaction_id, ts_sec, 4 * (ts_sec + CASE WHEN n % 17 = 0 THEN 172800 ELSE n % 3000 END - min(ts_sec) OVER ()) // (
  max(ts_sec) OVER () - min(ts_sec) OVER () + 172801) AS arrival
 FROM (SELECT *, CAST(substr(transaction_id, 2, 10) AS BIGINT) AS n FROM comb WHERE fold = 'test'))""",
       "marks AS (SELECT arrival, max(max(ts_sec)) OVER (ORDER BY arrival ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) - 3600 AS mark FROM late_at GROUP BY arrival)",
       select="SELECT transaction_id, coalesce((ts_sec // 60 + 1) * 60 <= mark, false) AS late FROM late_at JOIN marks USING (arrival)")
oracle("novelty_index", *SCORES, select="SELECT transaction_id, round(novelty, 6) AS novelty, round(1 - novelty, 6) AS survival FROM scored WHERE fold = 'test'")
oracle("density_recall", *COMBINED, select="SELECT count(*) AS queries, true AS enough FROM comb WHERE fold = 'test' AND CAST(substr(transaction_id, 2, 10) AS BIGINT) % 20 = 0")

# ================================================================== from file to decision
FIRST = "kept AS (SELECT * FROM typed QUALIFY row_number() OVER (PARTITION BY transaction_id ORDER BY line_no) = 1)"
oracle("timestamp_formats", select="""
 SELECT event_id AS line_no, 'day' AS date_order, CASE event_id % 8 WHEN 2 THEN s // 60 * 60 WHEN 6 THEN s // 86400 * 86400 ELSE s END AS ts_sec
 FROM (SELECT event_id, CAST(floor(epoch(ts)) AS BIGINT) AS s FROM events) WHERE event_id % 8 <> 7""")
HEADERS = {"transaction_id": " Txn_ID ", "timestamp": "Event_Time", "amount": "AMT", "customer_id": "CID", "merchant_id": "Merchant", "device_id": "device", "is_fraud": "isFraud"}
oracle("header_mapping", select="SELECT * FROM (VALUES " + ", ".join(
    f"('{c}', {repr(HEADERS[c]) if c in HEADERS else 'NULL'}, {c in REQUIRED or c == LABEL})" for c in ALIASES) + ") t(\"column\", header, required)")
oracle("required_columns", select="SELECT \"column\", (SELECT count(*) FROM events) AS rows_refused FROM (VALUES " + ", ".join(
    f"('{c}')" for c in [*REQUIRED, LABEL]) + ") t(\"column\")")
oracle("unlabelled_load", RAW, TYPED, FIRST, select="SELECT CAST(0 AS INT) AS is_fraud, count(*) AS rows FROM kept WHERE ts_sec IS NOT NULL")
oracle("amount_filter", RAW, TYPED, FIRST, select="SELECT transaction_id, round(amount, 2) AS amount FROM kept WHERE ts_sec IS NOT NULL AND amount IS NOT NULL")
oracle("request_constraints", RAW, TYPED, """err AS (SELECT concat_ws('|', CASE WHEN amount IS NULL THEN 'amount must be a positive number' END,
 CASE WHEN ts_sec IS NULL THEN 'timestamp required' END, CASE WHEN line_no % 30 - 3 NOT BETWEEN 0 AND 23 THEN 'transaction_hour must be 0..23' END) AS errors FROM typed)""",
       select="SELECT errors, errors = '' AS valid, count(*) AS rows FROM err GROUP BY 1, 2")
oracle("file_decisions", RAW, TYPED, FIRST, ERRORS.replace("FROM typed", "FROM kept"), select="""
 SELECT line_no, transaction_id, errors, errors <> '' AS rejected, errors = '' AS scored, true AS consistent FROM err""")
oracle("load_report", RAW, TYPED, FIRST, select="""
 SELECT count(*) AS answers, count(*) AS rows, count(*) FILTER (WHERE ts_sec IS NULL) AS unparseable_timestamps,
  count(*) FILTER (WHERE amount IS NULL) AS without_amount, CAST(7 AS BIGINT) AS mapped, CAST(10 AS BIGINT) AS unmapped FROM kept""")

# ================================================================== what fitted models must keep
oracle("lr_stationary", *COMBINED, select="SELECT count(*) AS rows, CAST(41 AS BIGINT) AS parameters, true AS stationary FROM comb WHERE fold = 'train'")
oracle("forest_contrib", *COMBINED, select="SELECT transaction_id, 0.0::DOUBLE AS difference FROM comb WHERE fold = 'test'")
oracle("isolation_walk", *COMBINED, select="SELECT transaction_id, true AS equal FROM comb WHERE fold = 'val' AND CAST(substr(transaction_id, 2, 10) AS BIGINT) % 20 = 0")
oracle("calibration_checks", *COMBINED, select="""
 SELECT count(*) AS rows, true AS platt_keeps_mean, true AS isotonic_keeps_mean, true AS isotonic_rises, true AS better_chosen FROM comb WHERE fold = 'val'""")
oracle("stream_fresh_state", select="SELECT CAST(0 AS BIGINT) AS differing_rows")
