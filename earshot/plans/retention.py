"""Cohorts, retention and churn trend."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from earshot.functions.numbers import round_half_up, round_signed
from earshot.functions.times import week_start
from earshot.operators.joins import attach
from earshot.operators.trends import first_in_group


def first_weeks(plays: DataFrame, entity: str = "track_uri") -> DataFrame:
    return plays.groupBy(entity).agg(week_start(F.min("timestamp")).alias("cohort_week"))


def with_cohort(plays: DataFrame, entity: str = "track_uri") -> DataFrame:
    """Plays with the week their entity was first seen."""
    return attach(plays, first_weeks(plays, entity), [entity], "first_weeks", how="inner")


def cohort_retention(plays: DataFrame, entity: str = "track_uri", max_offset: int = 8) -> DataFrame:
    """Active entities per cohort and week offset, as a share of the cohort's first row.

    Events are reduced to distinct (entity, week) before their only shuffle, by hash aggregates. An entity's weeks
    are then few (calendar-bounded): their smallest is its cohort, so events are not joined to anything.
    """
    active = plays.select(entity, week_start(F.col("timestamp")).alias("week")).distinct()
    weeks = active.groupBy(entity).agg(F.collect_list("week").alias("weeks"))
    active = weeks.select(F.array_min("weeks").alias("cohort_week"), F.explode("weeks").alias("week"))
    offset = (F.datediff("week", "cohort_week") / 7).cast("bigint")
    table = (
        active.withColumn("weeks_since_first", offset)
        .where(F.col("weeks_since_first") <= max_offset)
        .groupBy("cohort_week", "weeks_since_first")
        .agg(F.count("*").alias("active_users"))
    )
    based = first_in_group(table, "active_users", ["cohort_week"], "weeks_since_first", "base")
    return based.select(
        "cohort_week", "weeks_since_first", "active_users",
        round_half_up(F.col("active_users") * 1e2 / F.col("base"), 1).alias("retention_rate"),
    ).orderBy("cohort_week", "weeks_since_first")


def daily_retention(daily: DataFrame) -> DataFrame:
    """Active days over the days of the span."""
    return daily.agg(
        (F.datediff(F.max("date"), F.min("date")) + 1).alias("total_days"), F.count("*").alias("active_days")
    ).withColumn("retention_rate", round_half_up(F.col("active_days") / F.col("total_days"), 4))


def churn_trend(daily: DataFrame, value: str = "daily_plays") -> DataFrame:
    """Mean of the last seven active days against the seven before; a short log has no trend."""
    back = F.row_number().over(Window.orderBy(F.desc("date")))
    row = daily.withColumn("_back", back).agg(
        F.count("*").alias("days"),
        F.avg(F.when(F.col("_back") <= 7, F.col(value))).alias("recent"),
        F.avg(F.when(F.col("_back").between(8, 14), F.col(value))).alias("before"),
    )
    before = F.when(F.col("days") >= 14, F.col("before")).otherwise(F.col("recent"))
    trend = F.when(F.col("previous_avg") > 0, (F.col("recent") - F.col("previous_avg")) / F.col("previous_avg")).otherwise(0.0)
    risk = F.when(F.col("_trend") < -0.2, "High").when(F.col("_trend") < -0.1, "Medium").otherwise("Low")
    return row.withColumn("previous_avg", before).withColumn("_trend", trend).select(
        round_half_up(F.col("recent"), 4).alias("recent_avg"),
        round_half_up(F.col("previous_avg"), 4).alias("previous_avg"),
        round_signed(F.col("_trend"), 4).alias("trend"),
        risk.alias("churn_risk"),
    )
