import os
import random
import sys

import pytest
from pyspark.sql import SparkSession

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = ROOT + os.pathsep + os.environ.get("PYTHONPATH", "")


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[8]").appName("tests")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        # an odd zone on purpose: no result may depend on it
        .config("spark.sql.session.timeZone", "America/New_York")
        .config(
            "spark.sql.streaming.stateStore.providerClass",
            "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
        )
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


SCHEMA = (
    "transaction_id string, ts_sec bigint, customer_id string, merchant_id string, device_id string, "
    "amount double, transaction_hour int, is_fraud int"
)


def make_rows(n: int, seed: int = 7, span: int = 3 * 86_400, hot: float = 0.35) -> list[tuple]:
    """Random transactions: one customer and one merchant hold a third of all rows, and
    many rows share a second."""
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        ts = 1_700_000_000 + rng.choice([rng.randrange(span), 600 * rng.randrange(span // 600), 86_400])
        customer = "C0" if rng.random() < hot else f"C{rng.randrange(1, 12)}"
        merchant = "M0" if rng.random() < hot else f"M{rng.randrange(1, 9)}"
        device = f"D{customer[1:]}-{rng.randrange(3)}"
        amount = round(rng.expovariate(0.02) + 0.01, 2)
        rows.append((f"T{i:06d}", ts, customer, merchant, device, amount, ts // 3600 % 24, int(rng.random() < 0.2)))
    return rows


def in_order(rows):
    return sorted(rows, key=lambda r: (r[1], r[0]))
