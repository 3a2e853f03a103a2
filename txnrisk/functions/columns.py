"""Column expressions shared by the operators. All of them stay inside code generation."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from txnrisk.settings import BANDS, DAY, AlertBudget, Thresholds

# ---- fixed values: text patterns of the cleaning rules
THOUSANDS_COMMA = r",(?=\d{3}(?:\.\d*)?$)"
ZONE_SUFFIX = r"(?i)(?:Z|UTC|[+-]\d{2}:?\d{2})$"
EPOCH_NTZ = "timestamp_ntz'1970-01-01 00:00:00'"
MONTHS = ["jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec"]
# dates that aren't ISO text: 05/01/2024 (also with . or -), 2024/1/5, 5 Jan 2024 and Jan 5, 2024, each with or without a clock
_MARK, _CLOCK, _OVER_12 = r"[/.-]", r"(?:[T ,]+(.*))?$", r"(1[3-9]|[23]\d)"
NUMBER_DATE = rf"^(\d{{1,2}}){_MARK}(\d{{1,2}}){_MARK}(\d{{4}}){_CLOCK}"
FIRST_OVER_12 = rf"^{_OVER_12}{_MARK}(\d{{1,2}}){_MARK}(\d{{4}}){_CLOCK}"
SECOND_OVER_12 = rf"^(\d{{1,2}}){_MARK}{_OVER_12}{_MARK}(\d{{4}}){_CLOCK}"
EQUAL_NUMBERS = rf"^(\d{{1,2}}){_MARK}(\1){_MARK}(\d{{4}}){_CLOCK}"
YEAR_DATE = rf"^(\d{{4}})[/.](\d{{1,2}})[/.](\d{{1,2}}){_CLOCK}"
DAY_NAME_DATE = rf"^(\d{{1,2}})[ -]([A-Za-z]{{3}})[a-z]*[ ,-]+(\d{{4}}){_CLOCK}"
NAME_DAY_DATE = rf"^([A-Za-z]{{3}})[a-z]* +(\d{{1,2}})[ ,]+(\d{{4}}){_CLOCK}"
NAMED_MONTH = r"^\d{4}-[A-Za-z]{3}-"
HALF_DAY = r"(?i) *[AP]M$"
DAY_FIRST, MONTH_FIRST, MIXED = "day", "month", "mixed"


# ------------------------------------------------------------------ cleaning
def repaired_amount(text: Column) -> Column:
    """Amount text to a positive double; anything else becomes null. Only a comma
    directly before the last three digits is taken as a thousands mark."""
    number = F.regexp_replace(F.trim(text.cast("string")), THOUSANDS_COMMA, "").try_cast("double")
    return F.when((number > 0) & ~F.isnan(number), number)


def coerced_label(text: Column) -> Column:
    number = text.try_cast("double")
    return F.coalesce(F.when(~F.isnan(number), number).try_cast("int"), F.lit(0))


def epoch_seconds(wall: Column) -> Column:
    """Whole seconds since 1970 (floor) of a zone-free timestamp, whatever the session
    zone. Built from date and clock parts: differences of timestamps would pass through
    the session zone and move the hour that a daylight-saving change skips."""
    clock = F.hour(wall) * 3600 + F.minute(wall) * 60 + F.second(wall)
    return F.unix_date(wall.cast("date")).cast("bigint") * DAY + clock


def iso_text(text: Column, order: str = MONTH_FIRST) -> Column:
    """Dates of the stated forms as ISO text. ``order`` says what the first of two numbers is where both may be a
    month; with ``MIXED`` such dates aren't read."""
    t = F.regexp_replace(F.trim(text), SECOND_OVER_12, "$3-$1-$2 $4")
    t = F.regexp_replace(t, FIRST_OVER_12, "$3-$2-$1 $4")
    either = EQUAL_NUMBERS if order == MIXED else NUMBER_DATE
    t = F.regexp_replace(t, either, "$3-$2-$1 $4" if order == DAY_FIRST else "$3-$1-$2 $4")
    t = F.regexp_replace(t, YEAR_DATE, "$1-$2-$3 $4")
    t = F.regexp_replace(F.regexp_replace(t, DAY_NAME_DATE, "$3-$2-$1 $4"), NAME_DAY_DATE, "$3-$1-$2 $4")
    month = F.array_position(F.array(*[F.lit(m) for m in MONTHS]), F.lower(F.substring(t, 6, 3)))
    numbered = F.concat(F.substring(t, 1, 5), month.cast("string"), F.substring(t, 9, 100))
    return F.when(t.rlike(NAMED_MONTH), numbered).otherwise(t)


def date_order_counts(text: Column) -> list[Column]:
    """Aggregates day_first, month_first, either: dates of two numbers by the readings that they allow."""
    t = F.trim(text)
    first, second = (F.regexp_extract(t, NUMBER_DATE, i).try_cast("int") for i in (1, 2))
    return [
        F.count_if((first > 12) & (second <= 12)).alias("day_first"),
        F.count_if((second > 12) & (first <= 12)).alias("month_first"),
        F.count_if((first <= 12) & (second <= 12) & (first != second)).alias("either"),
    ]


def _bound(value: Column, f: Callable[[Column], Column]) -> Column:
    """``f(value)`` with ``value`` computed once, however often ``f`` uses it."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def _wall_epoch(t: Column) -> Column:
    """Epoch seconds of zone-free ISO text whose clock may have twelve hours."""
    late = F.upper(F.regexp_extract(t, HALF_DAY, 0)).contains("P")
    half = t.rlike(HALF_DAY)

    def shifted(wall: Column) -> Column:
        hour = F.pmod(F.floor(wall / 3600), F.lit(24))
        shift = F.when(hour > 12, None).when(late & (hour < 12), 43_200).when(~late & (hour == 12), -43_200).otherwise(0)
        return wall + F.when(half, shift).otherwise(0)

    return _bound(_bound(F.trim(F.regexp_replace(t, HALF_DAY, "")).try_cast("timestamp_ntz"), epoch_seconds), shifted)


def parsed_epoch(text: Column, order: str = MONTH_FIRST) -> Column:
    """Epoch seconds (floor) of timestamp text. Text without a zone is read as UTC."""
    def epoch(t: Column) -> Column:
        zoned = F.floor(F.unix_micros(t.try_cast("timestamp")) / F.lit(1_000_000)).cast("bigint")
        return F.when(t.rlike(ZONE_SUFFIX), zoned).otherwise(_wall_epoch(t))

    return _bound(iso_text(text, order), epoch)


def utc_wall(ts_sec: Column) -> Column:
    return F.timestamp_add("SECOND", ts_sec, F.expr(EPOCH_NTZ))


def hour_of(ts_sec: Column) -> Column:
    return F.pmod(F.floor(ts_sec / 3600), F.lit(24)).cast("int")


def night_flag(hour: Column) -> Column:
    return ((hour < 6) | (hour >= 23)).cast("int")


def exact(amount: Column) -> Column:
    """Decimal form of an amount: sums of it do not depend on the order of addition,
    and taking a row out of a running sum leaves no residue."""
    return amount.cast("decimal(20,6)")


# ------------------------------------------------------------------ calendar
def day_of_week(ts_sec: Column) -> Column:
    return F.pmod(F.floor(ts_sec / DAY) + 3, F.lit(7)).cast("int")


def weekend_flag(day: Column) -> Column:
    return (day >= 5).cast("int")


def day_number(ts_sec: Column) -> Column:
    return F.floor(ts_sec / DAY).cast("bigint")


# ------------------------------------------------------------------ strata
def stratum(n_prior: Column) -> Column:
    return F.when(n_prior <= 0, "cold").when(n_prior < 5, "warm").otherwise("established")


def stratum_code(n_prior: Column) -> Column:
    return F.when(n_prior <= 0, 0).when(n_prior < 5, 1).otherwise(2)


def stratum_with_tenure(n_prior: Column, tenure_days: Column) -> Column:
    return (
        F.when(n_prior <= 0, "cold")
        .when((n_prior < 5) | (tenure_days < 7), "warm")
        .otherwise("established")
    )


def merchant_tier(n_prior: Column) -> Column:
    return F.when(n_prior <= 0, "rare").when(n_prior <= 2, "low").when(n_prior <= 9, "mid").otherwise("high")


def bucket_of(value: Column, edges: list[float]) -> Column:
    """Number of edges at or below ``value``; 0 without edges."""
    if not edges:
        return F.lit(0)
    return F.size(F.filter(F.array(*[F.lit(float(e)) for e in edges]), lambda e: e <= value))


# ------------------------------------------------------------------ decisions
def clipped(x: Column) -> Column:
    return F.least(F.greatest(x, F.lit(0.0)), F.lit(1.0))


def risk_band(p: Column, novelty: Column, t: Thresholds) -> Column:
    by_novelty = (novelty >= t.novelty_very_high) & (p >= t.p_floor_for_novelty)
    return (
        F.when(p >= t.p_high, "high-risk")
        .when((p >= t.p_review) | by_novelty, "review")
        .when(novelty >= t.novelty_high, "monitor")
        .otherwise("normal")
    )


def is_alert(band: Column) -> Column:
    return band.isin("review", "high-risk")


def rank_score(p: Column, novelty: Column) -> Column:
    return F.lit(0.7) * p + F.lit(0.3) * novelty


def risk_tags(band: Column, novelty: Column, t: Thresholds) -> Column:
    return F.array_compact(
        F.array(
            F.when(band == "high-risk", "high_probability"),
            F.when((novelty >= t.novelty_high) & (band != "normal"), "novel_pattern"),
        )
    )


def band_position(band: Column) -> Column:
    return F.array_position(F.array(*[F.lit(b) for b in BANDS]), band).cast("int")


def volume_caps(volume: Column, budget: AlertBudget) -> tuple[Column, Column]:
    """Today's total and high-risk alert caps after ``volume`` rows of the day."""
    total = F.greatest(F.lit(3), F.floor(volume * F.lit(float(budget.budget_pct)) / F.lit(100.0)))
    high = F.greatest(F.lit(2), F.floor(volume * F.lit(float(budget.high_risk_pct)) / F.lit(100.0)))
    return total.cast("bigint"), high.cast("bigint")


# ------------------------------------------------------------------ seeded order
def seeded_hash(id_col: Column, seed: int) -> Column:
    """Reproducible pseudo-random order key of a row, the same on any engine with md5."""
    return F.md5(F.concat(F.lit(f"{seed}:"), id_col.cast("string")))
