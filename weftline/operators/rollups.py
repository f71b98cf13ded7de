"""Operations reports: weekly figures, access audits by grouping sets, retention, calendars."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from ..functions.times import iso_week, week_start


def weekly(df: DataFrame, at: str, keys: Sequence[str], **figures: Column) -> DataFrame:
    """Figures per ISO week and key."""
    return df.groupBy(iso_week(F.col(at)).alias("week"), *keys).agg(*(v.alias(k) for k, v in figures.items()))


def with_empty_weeks(df: DataFrame, at: str, first: str, last: str, **figures: Column) -> DataFrame:
    """Figures for every week from ``first`` to ``last`` (dates), null where a week has no rows. The calendar has a row a week."""
    spark = df.sparkSession
    weeks = spark.range(1).select(F.explode(F.sequence(week_start(F.lit(first).cast("timestamp")), week_start(F.lit(last).cast("timestamp")), F.expr("interval 7 days"))).alias("start"))
    rows = df.groupBy(week_start(F.col(at)).alias("start")).agg(*(v.alias(k) for k, v in figures.items()))
    return weeks.join(rows, "start", "left").select(iso_week(F.col("start")).alias("week"), *figures)


def audit(df: DataFrame, dimensions: Sequence[str], **figures: Column) -> DataFrame:
    """Figures by each dimension alone and over all; ``dimension`` says which, ``member`` its value. Rows expand once a dimension and meet pre-aggregated."""
    kinds = [F.struct(F.lit(d).alias("dimension"), F.col(d).cast("string").alias("member")) for d in dimensions]
    rows = df.withColumn("_k", F.explode(F.array(*kinds, F.struct(F.lit("all").alias("dimension"), F.lit(None).cast("string").alias("member")))))
    return rows.groupBy("_k.dimension", "_k.member").agg(*(v.alias(k) for k, v in figures.items()))


def latest(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The last row of each key; a max of structs, so nothing is sorted and partial maxima shrink the shuffle."""
    rest = [c for c in df.columns if c not in keys and c not in order]
    return df.groupBy(*keys).agg(F.max(F.struct(*order, *rest)).alias("m")).select(*keys, *(F.col(f"m.{c}").alias(c) for c in (*order, *rest)))


def retention(df: DataFrame, finished: str, decision: str, until: str, today: Column, days: int, warn: int) -> DataFrame:
    """``status`` of each row: a decision to delete or keep stands; otherwise it is due ``days`` after it was finished, soon ``warn`` days before."""
    due = F.coalesce(F.col(until), F.date_add(F.col(finished).cast("date"), days))
    status = F.when(F.col(decision) == "delete", "delete").when(F.col(decision) == "keep", "kept").when(F.col(finished).isNull(), "open").when(due < today, "overdue").when(due <= F.date_add(today, warn), "soon").otherwise("ok")
    return df.withColumn("due", due).withColumn("status", status)


def scored(df: DataFrame, keys: Sequence[str], terms: dict[str, tuple[Column, float]], per: Column | None = None) -> DataFrame:
    """Weighted sum of terms per key, each summed over the key's rows; divided by ``per`` if given."""
    sums = df.groupBy(*keys).agg(*(F.sum(c).alias(k) for k, (c, _) in terms.items()), *([F.max(per).alias("_per")] if per is not None else []))
    total = sum((F.col(k) * w for k, (_, w) in terms.items()), F.lit(0.0))
    out = sums.withColumn("score", total / F.nullif(F.col("_per"), F.lit(0)) if per is not None else total)
    return out.drop("_per")


def coarse_to_fine(df: DataFrame, levels: Sequence[Sequence[str]], hit: Column, weight: float) -> DataFrame:
    """Rates of the finest cells, each level drawn towards the level above as if ``weight`` more rows had its rate."""
    fine = list(levels[-1])
    cells = df.groupBy(*fine).agg(F.count("*").alias("n"), F.sum(hit.cast("int")).alias("hits"))
    rows = cells
    for i, level in enumerate(levels):
        own = W.Window.partitionBy(*level) if level else W.Window.partitionBy(F.lit(0))
        n, h = F.sum("n").over(own), F.sum("hits").over(own)
        rows = rows.withColumn("rate", h / n if i == 0 else (h + weight * F.col("rate")) / (n + weight))
    return rows
