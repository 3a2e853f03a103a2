import pytest
from pyspark.sql import functions as F

from txnrisk.functions import columns as C
from txnrisk.operators import canonical
from txnrisk.operators.ordering import ordered_table
from txnrisk.sources import adapters, readers


def test_headers_are_matched_without_case_or_blanks():
    m = canonical.map_schema([" TXN_ID ", "Event_Time", "AMT", "cid", "Merchant", "DID", "isFraud", "other"])
    assert m.mapping["transaction_id"] == " TXN_ID " and m.mapping["is_fraud"] == "isFraud"
    assert m.missing == [] and "velocity_8min" in m.unmapped


def test_missing_columns_are_named():
    m = canonical.map_schema(["id", "time"], require_label=True)
    with pytest.raises(ValueError, match="amount, customer_id, merchant_id, device_id, is_fraud"):
        canonical.require_columns(m)
    assert "is_fraud" not in canonical.map_schema(["id", "time"], require_label=False).missing


@pytest.mark.parametrize(
    "text,want",
    [("1,234.50", 1234.5), ("1,234,567", None), ("12,34", None), (" 12 ", 12.0), ("-3", None), ("0", None),
     ("nan", None), ("abc", None), (None, None), ("1,000", 1000.0), ("1e3", 1000.0)],
)
def test_amount_repair(spark, text, want):
    df = spark.createDataFrame([(text,)], "a string")
    assert df.select(C.repaired_amount(F.col("a"))).first()[0] == want


@pytest.mark.parametrize(
    "text,want",
    [("2024-05-01 10:30:00", 1714559400), ("2024-05-01T10:30:00Z", 1714559400), ("2024-05-01 12:30:00+02:00", 1714559400),
     ("2024-05-01 10:30:00.900", 1714559400), ("2024-03-10 02:30:00", 1710037800), ("2024-05-01", 1714521600),
     ("1969-12-31 23:59:59.5", -1), ("nonsense", None), ("", None), (None, None)],
)
def test_timestamps_are_utc_in_any_session_zone(spark, text, want):
    df = spark.createDataFrame([(text,)], "t string")
    assert df.select(C.parsed_epoch(F.col("t"))).first()[0] == want


def test_wall_clock_round_trip(spark):
    seconds = [1710037800, 1730601000, -1, 0, 1714559400]  # the first two lie in clock changes
    df = spark.createDataFrame([(s,) for s in seconds], "s bigint").withColumn("wall", C.utc_wall(F.col("s")))
    assert [r[0] for r in df.select(C.epoch_seconds(F.col("wall"))).collect()] == seconds
    assert df.select(F.col("wall").cast("string")).first()[0] == "2024-03-10 02:30:00"


def test_csv_load(spark, tmp_path):
    (tmp_path / "a.csv").write_text(
        "TXN_ID,event_time,amt,cid,mid,did,label,extra\n"
        "b,2024-05-01 23:10:00,\"1,000.5\",C1,M1,D1,1,x\n"
        "a,2024-05-01 10:30:00,5,C1,M1,D1,0,x\n"
        "b,2024-05-01 11:00:00,7,C9,M9,D9,0,second copy\n"
        "c,never,7,C1,M1,D1,0,x\n"
        "d,2024-05-02 01:00:00,-1,C1,M1,D1,oops,x\n"
    )
    path = str(tmp_path / "a.csv")
    rows = {r.transaction_id: r for r in readers.read_transactions(spark, path).collect()}
    assert set(rows) == {"a", "b", "d"}
    assert rows["b"].amount == 1000.5 and rows["b"].customer_id == "C1" and rows["b"].is_night == 1
    assert rows["a"].transaction_hour == 10 and rows["a"].is_night == 0
    assert rows["d"].amount is None and rows["d"].is_fraud == 0 and rows["d"].is_night == 1
    assert canonical.with_amount(readers.read_transactions(spark, path)).count() == 2
    meta = canonical.load_metadata(readers.read_csv_text(spark, path)).first()
    assert tuple(meta) == (5, 1, 1, 3)


def test_missing_file_is_an_error(spark):
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        readers.read_transactions(spark, "/nowhere/at/all.csv")


def test_absent_label_counts_as_legitimate(spark):
    df = spark.createDataFrame([("a", "2024-05-01 10:30:00", "5", "C", "M", "D")], "id string, time string, amt string, cid string, mid string, did string")
    assert canonical.canonicalise(df, require_label=False).first().is_fraud == 0


def test_validation(spark):
    rows = [(5.0, 1, "C", "M", "D", 10), (-5.0, 1, "C", "M", "D", 10), (float("nan"), None, "", None, "D", 30), (None, 1, "C", "M", "D", None)]
    df = spark.createDataFrame(rows, "amount double, ts_sec bigint, customer_id string, merchant_id string, device_id string, transaction_hour int")
    got = [(r.valid, list(r.errors)) for r in canonical.validated(df, request=True).collect()]
    assert got[0] == (True, [])
    assert got[1] == (False, ["amount must be a positive number"])
    assert got[2][1] == ["amount must be a positive number", "timestamp required", "customer_id required",
                         "merchant_id required", "transaction_hour must be 0..23"]
    good, bad = canonical.split_valid(df)
    assert good.count() == 1
    assert {r.risk_band for r in bad.collect()} == {"invalid"} and not any(r.alert for r in bad.collect())


TIMES = {
    "05/01/2024 10:30": ("2024-05-01 10:30:00", "2024-01-05 10:30:00"), "5.1.2024": ("2024-05-01 00:00:00", "2024-01-05 00:00:00"),
    "25/12/2024 23:59:59": ("2024-12-25 23:59:59",) * 2, "12-25-2024 1:02:03.9": ("2024-12-25 01:02:03",) * 2, "2024/2/9T07:08": ("2024-02-09 07:08:00",) * 2,
    "9 Feb 2024 07:08:09": ("2024-02-09 07:08:09",) * 2, "February 9, 2024 12:30 AM": ("2024-02-09 00:30:00",) * 2, "Feb 9, 2024 1:30:05 pm": ("2024-02-09 13:30:05",) * 2,
    "07/07/2024 12:00 PM": ("2024-07-07 12:00:00",) * 2, "01/02/2024 13:00 PM": (None, None), "31/31/2024": (None, None), "9 Foo 2024": (None, None),
    "2024-02-09 07:08:09": ("2024-02-09 07:08:09",) * 2, "02/09/2024 10:00:00+02:00": ("2024-02-09 08:00:00", "2024-09-02 08:00:00"),
}


@pytest.mark.parametrize("order", [C.MONTH_FIRST, C.DAY_FIRST, C.MIXED])
def test_time_formats(spark, order):
    import datetime as dt

    df = spark.createDataFrame([(t,) for t in TIMES], "t string")
    got = {r.t: r.s for r in df.select("t", C.parsed_epoch(F.col("t"), order).alias("s")).collect()}
    for text, (month, day) in TIMES.items():
        want = day if order == C.DAY_FIRST else month
        if order == C.MIXED and month != day:
            want = None
        epoch = None if want is None else int(dt.datetime.fromisoformat(want + "+00:00").timestamp())
        assert got[text] == epoch, text


def test_date_order_is_decided_over_the_column(spark):
    def order(*texts):
        return canonical.date_order(spark.createDataFrame([(t,) for t in texts], "timestamp string"))

    assert order("05/01/2024", "13/01/2024", "x", None) == C.DAY_FIRST
    assert order("05/01/2024", "01/13/2024 10:00") == C.MONTH_FIRST
    assert order("01/13/2024", "13/01/2024") == C.MIXED
    assert order("2024-01-13", "05/05/2024") == C.MONTH_FIRST
    raw = [("a", "05/01/2024 10:30", "5", "C", "M", "D"), ("b", "25/01/2024", "5", "C", "M", "D"), ("b", "26/01/2024", "5", "C", "M", "D")]
    df = spark.createDataFrame(raw, "id string, time string, amt string, cid string, mid string, did string")
    rows = {r.transaction_id: str(r.timestamp) for r in canonical.canonicalise(df, require_label=False).collect()}
    assert rows == {"a": "2024-01-05 10:30:00", "b": "2024-01-25 00:00:00"}  # of two copies without an order the least stays


def test_file_to_decisions(spark):
    from txnrisk.plans import scoring

    raw = [(1, "a", "2024-05-01 10:00:00", "5", "C"), (2, "b", "no time", "5", "C"), (3, "c", "2024-05-01 09:00:00", "-1", "C"),
           (4, "a", "2024-05-01 11:00:00", "5", "C"), (5, "d", "2024-05-01 08:00:00", "7", "C"), (6, None, "2024-05-01 08:30:00", "7", "C"), (7, "e", "2024-05-01 08:00:00", "7", None)]
    df = spark.createDataFrame(raw, "line int, id string, time string, amt string, cid string").selectExpr("*", "'M' as mid", "'D' as did")

    def score(log):
        n = F.lit(0.25)
        return log.rows.select("transaction_id", F.lit("normal").alias("risk_band"), F.lit(False).alias("alert"), F.lit("log").alias("budget_status"),
                               n.alias("fraud_probability"), n.alias("novelty_score"), n.alias("rank_score"))

    found, report = scoring.file_decisions(df, score, "line")
    got = [(r.line, r.transaction_id, r.risk_band, list(r.errors)) for r in found.collect()]
    assert got == [
        (1, "a", "normal", []), (2, "b", "invalid", ["timestamp required"]), (3, "c", "invalid", ["amount must be a positive number"]),
        (5, "d", "normal", []), (6, None, "normal", []), (7, "e", "invalid", ["customer_id required"]),
    ]
    assert report.counts == {"rows": 6, "unparseable_timestamps": 1, "without_amount": 1}
    assert report.mapping.mapping["amount"] == "amt" and "velocity_8min" in report.mapping.unmapped


def test_keep_first_takes_the_stated_order(spark):
    df = spark.createDataFrame([("a", 3, "z"), ("a", 1, "y"), ("b", 2, "x"), ("a", 2, None)], "id string, o int, v string")
    assert sorted(tuple(r) for r in canonical.keep_first(df, "id", ["o"]).collect()) == [("a", 1, "y"), ("b", 2, "x")]


def test_first_rows(spark):
    table = ordered_table(spark.range(100).withColumnRenamed("id", "x"), "x", blocks=5)
    assert sorted(r.x for r in readers.first_rows(table, 37).collect()) == list(range(37))


def test_adapter_without_identity(spark):
    pay = spark.createDataFrame(
        [(1, 0, 3600 * 25, 9.5, 7, None), (2, None, 0, 1.0, None, 3)],
        "TransactionID int, isFraud int, TransactionDT int, TransactionAmt double, card1 int, addr1 int",
    )
    got = {r.transaction_id: r for r in adapters.adapt_payments(pay, None).collect()}
    assert got["1"].transaction_hour == 1 and got["1"].customer_id == "card_7" and got["1"].merchant_id == "addr_-1"
    assert got["2"].customer_id == "card_-1" and got["2"].device_id == "NA_DEVICE" and got["2"].is_fraud == 0


def test_adapter_device_forms(spark):
    pay = spark.createDataFrame([(i, 0, 0, 1.0, 1, 1) for i in range(4)], "TransactionID int, isFraud int, TransactionDT int, TransactionAmt double, card1 int, addr1 int")
    ident = spark.createDataFrame([(0, "mobile", "X1"), (1, None, "X1"), (2, "mobile", None)], "TransactionID int, DeviceType string, DeviceInfo string")
    got = {r.transaction_id: r.device_id for r in adapters.adapt_payments(pay, ident).collect()}
    assert got == {"0": "X1|mobile", "1": "X1", "2": "mobile", "3": "NA_DEVICE"}
