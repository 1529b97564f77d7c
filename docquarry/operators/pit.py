"""Point-in-time reads on an exchange calendar."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import TimestampType

#: Closures outside the rules, and the rule set's first years.
ONE_OFF = frozenset(dt.date.fromisoformat(x) for x in "1994-04-27 2001-09-11 2001-09-12 2001-09-13 2001-09-14 2004-06-11 2007-01-02 2012-10-29 2012-10-30 2018-12-05 2025-01-09".split())
FIRST_YEAR, LAST_YEAR, MLK_FROM, JUNETEENTH_FROM = 1990, 2030, 1998, 2022


def _easter(y: int) -> dt.date:
    a, b, c = y % 19, y // 100, y % 100
    h = (19 * a + b - b // 4 - (b - (b + 8) // 25 + 1) // 3 + 15) % 30
    k = (32 + 2 * (b % 4) + 2 * (c // 4) - h - c % 4) % 7
    m = (a + 11 * h + 22 * k) // 451
    n = h + k - 7 * m + 114
    return dt.date(y, n // 31, n % 31 + 1)


def _nth(y: int, m: int, weekday: int, n: int) -> dt.date:
    """The ``n``-th such weekday of a month; the last one for -1."""
    if n > 0:
        d = dt.date(y, m, 1)
        return d + dt.timedelta((weekday - d.weekday()) % 7 + 7 * (n - 1))
    d = dt.date(y + m // 12, m % 12 + 1, 1) - dt.timedelta(1)
    return d - dt.timedelta((d.weekday() - weekday) % 7)


def _observed(d: dt.date, saturday: bool = True) -> dt.date | None:
    if d.weekday() == 5:
        return d - dt.timedelta(1) if saturday else None
    return d + dt.timedelta(1) if d.weekday() == 6 else d


def holidays(y: int) -> set[dt.date]:
    found = {_observed(dt.date(y, 1, 1), False), _nth(y, 2, 0, 3), _easter(y) - dt.timedelta(2), _nth(y, 5, 0, -1), _observed(dt.date(y, 7, 4)), _nth(y, 9, 0, 1), _nth(y, 11, 3, 4), _observed(dt.date(y, 12, 25))}
    if y >= MLK_FROM:
        found.add(_nth(y, 1, 0, 3))
    if y >= JUNETEENTH_FROM:
        found.add(_observed(dt.date(y, 6, 19)))
    return {d for d in found if d} | {d for d in ONE_OFF if d.year == y}


def early_close(d: dt.date) -> bool:
    """Day after Thanksgiving, Christmas Eve, and the day before Independence Day where both are weekdays."""
    return d == _nth(d.year, 11, 3, 4) + dt.timedelta(1) or (d.month, d.day) == (12, 24) or ((d.month, d.day) == (7, 3) and dt.date(d.year, 7, 4).weekday() not in (5, 6, 0))


def calendar_rows(first: int = FIRST_YEAR, last: int = LAST_YEAR) -> list[tuple[dt.date, dt.date, int]]:
    """(date, next session strictly after it, its closing hour in New York) for every date but the last session on."""
    closed = set().union(*[holidays(y) for y in range(first, last + 1)])
    day, out, nxt = dt.date(last, 12, 31), [], None
    while day >= dt.date(first, 1, 1):
        if nxt:
            out.append((day, nxt, 13 if early_close(nxt) else 16))
        if day.weekday() < 5 and day not in closed:
            nxt = day
        day -= dt.timedelta(1)
    return out[::-1]


def calendar(spark: SparkSession, first: int = FIRST_YEAR, last: int = LAST_YEAR) -> DataFrame:
    """A dimension of one row a date (bounded by the years): et_date, session, closes_at."""
    rows = spark.createDataFrame(calendar_rows(first, last), "et_date date, session date, hour int")
    local = F.make_timestamp_ntz(F.year("session"), F.month("session"), F.dayofmonth("session"), F.col("hour"), F.lit(0), F.lit(0))
    return rows.select("et_date", "session", F.convert_timezone(F.lit("America/New_York"), F.lit("UTC"), local).cast("timestamp").alias("closes_at"))


def require_aware(df: DataFrame, column: str) -> None:
    """Naive timestamps are refused; cast them at the boundary."""
    if not isinstance(df.schema[column].dataType, TimestampType):
        raise TypeError(f"{column} must be a timestamp with time zone")


def with_cutoff(events: DataFrame, at: str = "event_datetime", out: str = "as_of_ts") -> DataFrame:
    """Adds the close of the first session strictly after the event's New York date. Out of the calendar or null: an error."""
    require_aware(events, at)
    cal = calendar(events.sparkSession).select(F.col("et_date").alias("__d"), F.col("closes_at").alias("__c"))
    dated = events.withColumn("__d", F.to_date(F.from_utc_timestamp(at, "America/New_York")))
    joined = dated.join(F.broadcast(cal), "__d", "left")
    return joined.withColumn(out, F.coalesce("__c", F.raise_error(F.lit("event_datetime is null or outside the calendar")).cast("timestamp"))).drop("__d", "__c")


def materialize_features(events: DataFrame, columns: list[str]) -> DataFrame:
    """Checks the column set and stamps ``as_of_ts``."""
    missing, extra = sorted(set(columns) - set(events.columns)), sorted(set(events.columns) - set(columns))
    if missing or extra:
        raise ValueError(f"missing {missing}, unexpected {extra}")
    return with_cutoff(events).select(*columns, "as_of_ts")


def _cuts(sides: DataFrame, rows_per_range: int) -> list[int]:
    """Times (microseconds) that cut the rows of (micros) into about equal ranges, at most 64, of ``rows_per_range`` rows at least."""
    shares = [i / 64 for i in range(1, 64)]
    n, marks = sides.agg(F.count("*"), F.percentile_approx("micros", F.array(*map(F.lit, shares)), F.lit(1000))).first()
    ranges = min(64, n // rows_per_range)
    return sorted({marks[round(64 * i / ranges) - 1] for i in range(1, ranges)}) if marks and ranges > 1 else []


def as_of(spine: DataFrame, features: DataFrame, entity: str, at: str, columns: list[str], ttl_days: int = 0, tie: str = "event_datetime", rows_per_range: int = 1_000_000) -> DataFrame:
    """Each spine row with the latest feature row of ``as_of_ts`` <= its time (ties: the latest ``tie``), or nulls.

    Union and forward fill inside (entity, range of time): one shuffle, no fan-out with the number of versions, and an entity that holds
    most of the rows is split like any other. What an entity knew at the end of a range is carried on by a second pass over one row an
    entity and range. ``ttl_days``: features older than that are nulled; 0 is no bound. Null times know nothing; null entities are one."""
    f = features.select(entity, F.col("as_of_ts").alias("__t"), F.lit(0).alias("__side"), F.col(tie).alias("__tie"), F.struct(F.col("as_of_ts"), *columns).alias("__f"), F.lit(None).cast(spine.schema.simpleString()).alias("__s"))
    s = spine.select(entity, F.col(at).alias("__t"), F.lit(1).alias("__side"), F.lit(None).cast(f.schema["__tie"].dataType).alias("__tie"), F.lit(None).cast(f.schema["__f"].dataType).alias("__f"), F.struct(*spine.columns).alias("__s"))
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp")).alias("micros")
    cuts = _cuts(features.select(micros("as_of_ts")).unionByName(spine.select(micros(at))), rows_per_range)
    place = sum((F.coalesce(F.unix_micros(F.col("__t").cast("timestamp")) >= c, F.lit(False)).cast("int") for c in cuts), F.lit(0))
    rows = f.unionByName(s).withColumn("__range", place)
    w = Window.partitionBy(entity, "__range").orderBy("__t", "__side", "__tie").rowsBetween(Window.unboundedPreceding, 0)
    got = rows.withColumn("__last", F.last("__f", ignorenulls=True).over(w)).where("__side = 1")
    if cuts:
        known = rows.groupBy(entity, "__range").agg(F.max(F.when(F.col("__side") == 0, F.struct("__t", "__tie", "__f")))["__f"].alias("__f"))
        before = Window.partitionBy(entity).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
        carried = known.select(F.col(entity).alias("__of"), F.col("__range").alias("__r"), F.last("__f", ignorenulls=True).over(before).alias("__carried"))
        got = got.join(carried, F.col(entity).eqNullSafe(F.col("__of")) & (F.col("__range") == F.col("__r")), "left")
        got = got.withColumn("__last", F.when(F.col("__t").isNotNull(), F.coalesce("__last", "__carried")))
    fresh = F.lit(True) if not ttl_days else F.col("__last.as_of_ts") >= F.col("__t") - F.expr(f"interval {int(ttl_days)} days")
    return got.select("__s.*", *[F.when(fresh, F.col(f"__last.{c}")).alias(c) for c in ["as_of_ts", *columns]])


def online_latest(features: DataFrame, entity: str, start: str, end: str) -> DataFrame:
    """The latest row of each entity with ``as_of_ts`` in [start, end]."""
    inside = features.where(F.col("as_of_ts").between(F.lit(start).cast("timestamp"), F.lit(end).cast("timestamp")))
    w = Window.partitionBy(entity).orderBy(F.col("as_of_ts").desc(), F.col("event_datetime").desc(), F.col("event_id").desc())
    return inside.withColumn("__r", F.row_number().over(w)).where("__r = 1").drop("__r")
