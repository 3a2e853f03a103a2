"""Alert budget over micro-batches.

The controller is one sequence for all rows, so it is not kept as keyed state:
that would send every row through one task. Each micro-batch is reduced with the
batch operators (volumes from block counts, candidates from bounded cells) and only
the candidates are folded, starting from the state the last batch left.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from txnrisk.operators.budget import BudgetState, apply_budget
from txnrisk.operators.ordering import ordered_table
from txnrisk.settings import DAY, DEFAULTS, AlertBudget


class StreamingBudget:
    """``foreachBatch`` target. Results and state are written under the batch number, so
    a repeated batch overwrites its own output and starts from the same state."""

    def __init__(self, path: str, budget: AlertBudget = DEFAULTS.budget):
        self.path, self.budget = path.rstrip("/"), budget

    def _state_path(self, batch: int) -> str:
        return f"{self.path}/state/batch={batch}"

    def _load(self, spark, batch: int) -> BudgetState:
        if batch <= 0:
            return BudgetState()
        row = spark.read.text(self._state_path(batch - 1)).first()
        values = json.loads(row[0])
        return BudgetState({int(k): v for k, v in values["volumes"].items()}, [tuple(a) for a in values["alerts"]])

    def __call__(self, decisions: DataFrame, batch: int) -> None:
        spark = decisions.sparkSession
        state = self._load(spark, batch)
        ordered = ordered_table(decisions, "ts_sec", "transaction_id")
        result = apply_budget(ordered, self.budget, state)
        out = f"{self.path}/decisions/batch={batch}"
        result.drop("seq").write.mode("overwrite").parquet(out)
        after = self._advance(spark.read.parquet(out), state)
        text = json.dumps({"volumes": after.volumes, "alerts": after.alerts})
        spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(self._state_path(batch))

    def _advance(self, decided: DataFrame, state: BudgetState) -> BudgetState:
        day = F.floor(F.col("ts_sec") / DAY).cast("bigint").alias("day")
        volumes = dict(state.volumes)
        for d, n in decided.groupBy(day).agg(F.count(F.lit(1))).collect():  # one row per day
            volumes[d] = volumes.get(d, 0) + n
        end = max([d for d in volumes], default=0)
        alerts = decided.filter(F.col("budget_status") == "alert")
        last = alerts.agg(F.max("ts_sec")).first()[0]
        if last is None:
            return BudgetState({d: n for d, n in volumes.items() if d >= end - 1}, state.alerts)
        # at most max_per_day alerts lie inside a rolling day
        fresh = alerts.filter(F.col("ts_sec") >= last - DAY).orderBy("ts_sec", "transaction_id")
        new = [(r.ts_sec, r.risk_band == "high-risk") for r in fresh.select("ts_sec", "risk_band").collect()]
        kept = [a for a in state.alerts if a[0] >= last - DAY]
        return BudgetState({d: n for d, n in volumes.items() if d >= end - 1}, sorted(kept + new))
