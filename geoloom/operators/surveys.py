"""Competing measurements: order of surveys, choice per building, decisions about heights."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# Fixed values of the preference rules.
FILLED_RETURNS, DETAIL_GAIN, FAR_GAIN, LEAST_CELL_M, SLACK_DAYS = 4.0, 1.25, 2.0, 0.25, 2
CONTRADICTIONS = ("source_height_conflict", "footprint_roof_mismatch", "roof_extends_outside_footprint", "observed_ground_in_footprint", "predates_building", "mixed_capture_epochs")


def order_keys() -> list[Column]:
    """Newest first, then nearly full coverage, density, classification, coverage, reading cost of the format, publisher, URL."""
    density = F.col("density")
    return [
        F.coalesce(F.col("day"), F.lit(0)).desc(), F.when(F.col("coverage") < 0.98, 1).otherwise(0), F.coalesce(density / (1 + density), F.lit(0.0)).desc(),
        F.coalesce(F.col("class_quality"), F.lit(0.0)).desc(), F.col("coverage").desc(), F.when(F.col("format") == "EPT", 0).when(F.col("format").isin("COPC", "I3S"), 1).otherwise(2),
        F.when(F.col("authoritative"), 0).otherwise(1), F.col("url"),
    ]


def ranked(surveys: DataFrame, group: str) -> DataFrame:
    return surveys.withColumn("rank", F.row_number().over(Window.partitionBy(group).orderBy(*order_keys())).cast("bigint"))


def preferred(surveys: DataFrame, group: str, preference: str = "balanced", cell_m: float = 1.0, years: int = 7) -> DataFrame:
    """Surveys of each group with `place`: in rank order, each moved up past newer ones that it beats.

    An older survey beats a newer one if it fills cells that much finer, within some years. That isn't transitive, so it is
    no sort: one pass a group, in which a survey stops below the first that it doesn't beat. Groups are areas, with tens of
    surveys."""
    compared = LEAST_CELL_M if preference == "detail" else cell_m

    def beats(old: pd.Series, new: pd.Series) -> bool:
        if preference == "newest" or not old.day or not new.day or pd.isna(old.day) or pd.isna(new.day) or old.day >= new.day or not old.density > 0 or not new.density > 0:
            return False
        gain = max(compared, (FILLED_RETURNS / new.density) ** 0.5) / max(compared, (FILLED_RETURNS / old.density) ** 0.5)
        age = new.day - old.day
        near = lambda n: age <= n * 365.25 + SLACK_DAYS
        return gain >= DETAIL_GAIN if preference == "detail" else (gain >= DETAIL_GAIN and near(years)) or (gain >= FAR_GAIN and near(2 * years))

    def bubbled(pdf: pd.DataFrame) -> pd.DataFrame:
        rows: list = []
        for row in pdf.sort_values("rank").itertuples(index=False):
            at = len(rows)
            while at and beats(row, rows[at - 1]):
                at -= 1
            rows.insert(at, row)
        out = pd.DataFrame(rows, columns=pdf.columns)
        return out.assign(place=range(1, len(out) + 1))

    table = ranked(surveys, group)
    return table.groupBy(group).applyInPandas(bubbled, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in table.schema.fields) + ", place bigint")


def quality(coverage: Column, explained: Column, density: Column) -> Column:
    unit = lambda c: F.greatest(F.lit(0.0), F.least(F.lit(1.0), c))
    support = F.least(F.lit(1.0), F.log2(1 + F.greatest(F.lit(0.0), density)) / F.log2(F.lit(5.0)))
    return 0.6 * unit(coverage) + 0.25 * unit(F.coalesce(explained, coverage)) + 0.15 * support


def scored(records: DataFrame, building: str) -> DataFrame:
    """records with score: quality, and for a known year up to 0.12 more the nearer it is to the building's newest. Scores
    are rounded to nine digits, so that equal ones tie on any machine."""
    newest = F.max("year").over(Window.partitionBy(building))
    bonus = F.when(F.col("year") > 0, 0.12 - 0.015 * F.least(F.lit(8), newest - F.col("year")))
    return records.withColumn("score", F.round(F.col("quality") + F.coalesce(bonus, F.lit(0.0)), 9))


def best_record(records: DataFrame, building: str) -> DataFrame:
    """The first record of each building by score, quality, class share, then source and URL."""
    order = [F.col("score").desc(), F.col("quality").desc(), F.col("class_share").desc(), "source", "url"]
    return scored(records, building).withColumn("__n", F.row_number().over(Window.partitionBy(building).orderBy(*order))).where("__n = 1").drop("__n")


def vetoed(best: DataFrame, observations: DataFrame, building: str) -> DataFrame:
    """best without buildings that an observation of the same or a newer year (or of an unknown one) contradicts."""
    against = observations.where(F.col("reason").isin(*CONTRADICTIONS)).select(F.col(building), F.col("year").alias("__year"))
    return best.join(against, (best[building] == against[building]) & (F.coalesce(against["__year"] >= best["year"], F.lit(True))), "left_anti")


def height_conflict(a: Column, b: Column) -> Column:
    low, high = F.least(a, b), F.greatest(a, b)
    return (low > 0) & (high - low > 20) & (low < high * 0.65)


def height_decision() -> Column:
    """What to do about a measured height, from height, floors (0: unknown), derived, observed, strong and corroborated."""
    height, floors, observed = F.col("height"), F.col("floors"), F.col("observed")
    conflict = (height > 0) & height_conflict(height, observed)
    off = lambda h: (floors > 0) & ((h < floors * 2 - 10) | (h > floors * 5 + 15))
    wrong, derived = off(height), F.col("derived")
    return (
        F.when((height > 0) & ~derived & ~conflict, "measured_height")
        .when(off(observed), "source_height_conflict")
        .when(conflict & ~(derived | wrong), "source_height_conflict")
        .when(conflict & (F.col("strong") | (derived & (F.col("corroborated") | wrong))), "corrected_estimated_height")
        .when(conflict, "weak_height_correction")
        .otherwise("measured_height")
    )


def capture_epoch(returns: DataFrame, building: str) -> DataFrame:
    """Per building the one significant capture year, or why there is none: years with at least max(20, a tenth) of the
    returns are significant; under nine tenths known, or not exactly one of them, is `mixed_capture_epochs`."""
    by_year = returns.groupBy(building, "year").agg(F.count("*").alias("n"))
    total = F.sum("n").over(Window.partitionBy(building))
    marked = by_year.withColumns({"total": total, "significant": (F.col("year") > 0) & (F.col("n") >= F.greatest(F.lit(20.0), 0.1 * total))})
    out = marked.groupBy(building).agg(
        F.max("total").alias("total"), F.sum(F.when(F.col("year") > 0, F.col("n")).otherwise(0)).alias("known"), F.count_if("significant").alias("epochs"), F.max(F.when(F.col("significant"), F.col("year"))).alias("epoch")
    )
    single = (F.col("known") >= 0.9 * F.col("total")) & (F.col("epochs") == 1)
    return out.select(building, "total", "known", "epochs", F.when(single, F.col("epoch")).alias("year"), F.when(~single, "mixed_capture_epochs").alias("reason"))


def cover_tier(surveys: DataFrame, group: str, slack: float = 0.05) -> DataFrame:
    """tier 0 for surveys within slack of their group's best coverage, else 1."""
    best = F.max("coverage").over(Window.partitionBy(group))
    return surveys.withColumn("tier", F.when(F.col("coverage") >= best - slack, 0).otherwise(1))
