"""KPI tables: one aggregate row turned into (metric, value) rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from earshot import constants as K
from earshot.functions.numbers import exact_mean, flag, round_half_up
from earshot.functions.texts import grouped_text, one_decimal_text, percent_text, whole_text
from earshot.operators.joins import one_row
from earshot.operators.quality import unpivot_row
from earshot.operators.trends import peaks
from earshot.plans import measures as m
from earshot.plans.platforms import platform_engagement


def _beside(first: DataFrame, *others: DataFrame) -> DataFrame:
    """One-row tables side by side."""
    for other in others:
        values = one_row(other)
        first = first.withColumns({c: values[c] for c in other.columns})
    return first


def _totals(plays: DataFrame) -> DataFrame:
    share = {p: F.avg(flag(F.col("platform") == p)) for p in ("web player", "iOS", "android")}
    return plays.agg(
        m.plays().alias("n"),
        F.countDistinct("track_uri").alias("tracks"),
        F.countDistinct("artist_name").alias("artists"),
        F.countDistinct("date").alias("days"),
        (F.sum("ms_played") / 3.6e6).alias("hours"),
        F.avg(flag(F.col("is_skip"))).alias("skip"),
        exact_mean(F.col("percent_played")).alias("pct"),
        share["web player"].alias("web"),
        share["iOS"].alias("ios"),
        share["android"].alias("android"),
    )


def _one_decimal(x: Column) -> Column:
    return one_decimal_text(round_half_up(x, 1))


def _percent(x: Column) -> Column:
    return percent_text(round_half_up(x * 1e2, 1))


def kpi_table(plays: DataFrame) -> DataFrame:
    """The six executive rows."""
    values = {
        "Total Streams": whole_text(F.col("n")),
        "Content Catalog": F.concat(
            whole_text(F.col("tracks")), F.lit(" tracks, "), whole_text(F.col("artists")), F.lit(" artists")
        ),
        "Total Listening Hours": F.concat(whole_text(round_half_up(F.col("hours"))), F.lit(" hours")),
        "Skip Rate": _percent(F.col("skip")),
        "Completion Rate": percent_text(round_half_up(F.col("pct"), 1)),
        "Daily Avg Streams": whole_text(round_half_up(F.col("n") / F.col("days"))),
    }
    return unpivot_row(_totals(plays), values, "metric", "value")


def _grouped_one_decimal(x: Column) -> Column:
    tenths = F.floor(x * 10.0 + 0.5).cast("bigint")
    return F.concat(grouped_text(F.floor(tenths / 10)), F.lit("."), (tenths % 10).cast("string"))


def eda_kpis(plays: DataFrame, stats: DataFrame) -> DataFrame:
    """The eleven rows of the exploratory report; ``stats`` is the session table."""
    per_session = stats.agg(
        F.count("*").alias("sessions"),
        (F.count("*") / F.countDistinct(F.to_date("session_start"))).alias("per_day"),
        F.avg("session_duration_minutes").alias("length"),
        F.avg("tracks_count").alias("size"),
    )
    shares = F.concat(
        F.lit("Web: "), _percent(F.col("web")), F.lit(", iOS: "), _percent(F.col("ios")),
        F.lit(", Android: "), _percent(F.col("android")),
    )
    values = {
        "Total Listening Hours": _grouped_one_decimal(F.col("hours")),
        "Total Tracks Played": grouped_text(F.col("n")),
        "Unique Tracks": grouped_text(F.col("tracks")),
        "Unique Artists": grouped_text(F.col("artists")),
        "Total Sessions": grouped_text(F.col("sessions")),
        "Avg Daily Sessions": _one_decimal(F.col("per_day")),
        "Avg Session Length (min)": _one_decimal(F.col("length")),
        "Avg Tracks per Session": _one_decimal(F.col("size")),
        "Overall Skip Rate": _percent(F.col("skip")),
        "Avg Percent Played": percent_text(round_half_up(F.col("pct"), 1)),
        "Platform Distribution": shares,
    }
    return unpivot_row(_beside(_totals(plays), per_session), values, "metric", "value")


def executive_summary(plays: DataFrame, scored: DataFrame) -> DataFrame:
    """The ten rows for management; ``scored`` is the session table with its score classes."""
    per_session = scored.agg(
        F.avg("session_duration_minutes").alias("length"),
        (F.count_if(F.col("quality_category") == "High") * 1e2 / F.count("quality_category")).alias("high"),
    )
    peak = peaks(plays.groupBy("hour_of_day").agg(m.plays().alias("n")), "hour_of_day", "n").select("peak_key")
    best = platform_engagement(plays).where(F.col("rank") == 1).select(F.col("platform").alias("best"))
    values = {
        "Total Streaming Events": grouped_text(F.col("n")),
        "Total Content Hours": grouped_text(round_half_up(F.col("hours"))),
        "Revenue Proxy ($)": F.concat(F.lit("$"), grouped_text(round_half_up(F.col("hours") * K.REVENUE_PER_HOUR))),
        "Platform Market Share": F.concat(F.lit("Web: "), whole_text(round_half_up(F.col("web") * 1e2)), F.lit("%")),
        "Average Session Length": F.concat(_one_decimal(F.col("length")), F.lit(" min")),
        "Overall Skip Rate": _percent(F.col("skip")),
        "Peak Usage Hour": F.concat("peak_key", F.lit(":00")),
        "Top Platform (Engagement)": F.col("best"),
        "High Quality Sessions": percent_text(round_half_up(F.col("high"), 1)),
        "Content Catalog": F.concat(grouped_text(F.col("tracks")), F.lit(" tracks")),
    }
    return unpivot_row(_beside(_totals(plays), per_session, peak, best), values, "metric", "value")


def insights(plays: DataFrame, scored: DataFrame, retention: DataFrame, churn: DataFrame) -> DataFrame:
    """Recommendation rules as (rule, fired, value) rows."""
    skip = flag(F.col("is_skip"))
    totals = plays.agg(
        F.avg(skip).alias("skip"),
        F.avg(F.when(F.col("shuffle"), skip)).alias("shuffled"),
        F.avg(F.when(~F.col("shuffle"), skip)).alias("in_order"),
    )
    worst_time = peaks(plays.groupBy("time_of_day").agg(m.skip_rate3().alias("r")), "time_of_day", "r").select(
        F.lower("peak_key").alias("worst_time")
    )
    worst_platform = peaks(plays.groupBy("platform").agg(m.skip_rate3().alias("r")), "platform", "r").select(
        F.col("peak_key").alias("worst_platform")
    )
    by_hour = peaks(plays.groupBy("hour_of_day").agg(m.plays().alias("n")), "hour_of_day", "n").select(
        F.col("peak_key").alias("peak_hour"), F.col("low_key").alias("low_hour"), F.col("ratio").alias("peak_ratio")
    )
    ranked = platform_engagement(plays)
    engagement = ranked.agg(
        F.min_by("platform", "rank").alias("best_platform"), F.max_by("platform", "rank").alias("least_engaging")
    )
    quality = scored.agg(
        exact_mean(F.col("session_quality_score")).alias("score"),
        (F.avg(flag(F.col("session_quality_score") < 33)) * 1e2).alias("low_pct"),
        F.avg("session_duration_minutes").alias("length"),
    )
    row = _beside(totals, worst_time, worst_platform, by_hour, engagement, quality,
                   retention.select("retention_rate"), churn.select("trend"))

    def decimal(x: Column, digits: int = 4) -> Column:
        return x.cast(f"decimal(20,{digits})").cast("string")

    half_up = lambda x: decimal(round_half_up(x, 4))
    always = F.lit(True)
    off_peak_end = F.pmod(F.col("low_hour").cast("int") + 2, F.lit(24)).cast("string")
    rules = {
        "invest in platform": (always, F.col("best_platform")),
        "optimise platform": (always, F.col("least_engaging")),
        "improve shuffle": (F.col("shuffled") > F.col("in_order"), half_up(F.col("shuffled"))),
        "focus on part of day": (always, F.col("worst_time")),
        "average session score": (always, half_up(F.col("score"))),
        "low quality sessions pct": (always, half_up(F.col("low_pct"))),
        "scale for peak hour": (always, F.concat("peak_hour", F.lit(":00"))),
        "peak to low ratio": (always, half_up(F.col("peak_ratio"))),
        "off-peak promotion": (always, F.concat("low_hour", F.lit(":00-"), off_peak_end, F.lit(":00"))),
        "target skip rate": (always, half_up(F.col("skip") * 0.9)),
        "target session minutes": (always, half_up(F.col("length") * 1.15)),
        "re-engage": (F.col("trend") < -0.1, decimal(F.col("trend"))),
        "improve daily retention": (F.col("retention_rate") < 0.7, half_up(F.col("retention_rate"))),
        "highest skip platform": (always, F.col("worst_platform")),
    }
    rows = [F.struct(F.lit(n).alias("rule"), fired.alias("fired"), v.alias("value")) for n, (fired, v) in rules.items()]
    return row.select(F.inline(F.array(*rows)))


def final_summary(best: DataFrame, clustering: DataFrame, retention: DataFrame, churn: DataFrame) -> DataFrame:
    """Best model, segments, retention and trend as (metric, value) rows, from four one-row tables."""
    row = _beside(best, clustering, retention, churn)
    decimal = lambda x: x.cast("decimal(20,4)").cast("string")
    values = {
        "Best Model": F.col("name"),
        "Best Model AUC": decimal(F.col("auc")),
        "User Segments": F.col("optimal_k").cast("string"),
        "Retention Rate": decimal(F.col("retention_rate")),
        "Activity Trend": decimal(F.col("trend")),
        "Churn Risk": F.col("churn_risk"),
    }
    return unpivot_row(row, values, "metric", "value")
