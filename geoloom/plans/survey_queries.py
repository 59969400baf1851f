"""Queries over competing measurements."""

from __future__ import annotations

from pyspark.sql import functions as F

from geoloom.operators import surveys
from geoloom.plans.catalogue import query
from geoloom.plans.views import view, with_views

_ORDER = "day DESC, CASE WHEN coverage < 0.98 THEN 1 ELSE 0 END, density / (1 + density) DESC, class_quality DESC, coverage DESC, CASE format WHEN 'EPT' THEN 0 WHEN 'COPC' THEN 1 WHEN 'I3S' THEN 1 ELSE 2 END, CASE WHEN authoritative THEN 0 ELSE 1 END, url"


@query(with_views("surveys", f"SELECT area, survey, ROW_NUMBER() OVER (PARTITION BY area ORDER BY {_ORDER}) AS rank FROM surveys"))
def survey_rank(spark, sf_dir):
    return surveys.ranked(view(spark, sf_dir, "surveys"), "area").select("area", "survey", "rank")


@query(with_views("surveys", f"SELECT area, survey FROM surveys QUALIFY ROW_NUMBER() OVER (PARTITION BY area ORDER BY {_ORDER}) = 1"))
def survey_top1(spark, sf_dir):
    return surveys.ranked(view(spark, sf_dir, "surveys"), "area").where("rank = 1").select("area", "survey")


@query()
def survey_beats(spark, sf_dir):
    return surveys.preferred(view(spark, sf_dir, "surveys"), "area").select("area", "survey", "rank", "place")


@query(with_views("surveys", "SELECT area, survey, CASE WHEN coverage >= MAX(coverage) OVER (PARTITION BY area) - 0.05::DOUBLE THEN 0 ELSE 1 END AS tier FROM surveys"))
def cover_tier(spark, sf_dir):
    return surveys.cover_tier(view(spark, sf_dir, "surveys"), "area").select("area", "survey", "tier")


_QUALITY = "0.6::DOUBLE * greatest(0, least(1, coverage)) + 0.25::DOUBLE * greatest(0, least(1, explained)) + 0.15::DOUBLE * least(1, log2(1 + greatest(0, density)) / log2(5))"


def _records(spark, sf_dir):
    return view(spark, sf_dir, "records").withColumn("quality", F.round(surveys.quality(F.col("coverage"), F.col("explained"), F.col("density")), 9))


@query(with_views("records", f"""SELECT building, source, url, year, round(score, 6) AS score FROM (SELECT *, quality + 0.12::DOUBLE - 0.015::DOUBLE * least(8, MAX(year) OVER (PARTITION BY building) - year) AS score FROM (SELECT *, round({_QUALITY}, 9) AS quality FROM records))
QUALIFY ROW_NUMBER() OVER (PARTITION BY building ORDER BY round(score, 9) DESC, quality DESC, class_share DESC, source, url) = 1"""))
def measurement_top1(spark, sf_dir):
    best = surveys.best_record(_records(spark, sf_dir), "building")
    return best.select("building", "source", "url", "year", F.round("score", 6).alias("score"))


@query(with_views("points", """SELECT part, total, known::BIGINT AS known, epochs, CASE WHEN known >= 0.9 * total AND epochs = 1 THEN epoch END AS year, CASE WHEN NOT (known >= 0.9 * total AND epochs = 1) THEN 'mixed_capture_epochs' END AS reason FROM (
  SELECT part, MAX(total)::BIGINT AS total, SUM(CASE WHEN year > 0 THEN n ELSE 0 END) AS known, COUNT(*) FILTER (s) AS epochs, MAX(year) FILTER (s) AS epoch FROM (
    SELECT *, year > 0 AND n >= greatest(20, 0.1 * total) AS s FROM (SELECT part, year, n, SUM(n) OVER (PARTITION BY part) AS total FROM (SELECT part, year, COUNT(*) AS n FROM points GROUP BY part, year))) GROUP BY part)"""))
def epoch_rule(spark, sf_dir):
    return surveys.capture_epoch(view(spark, sf_dir, "points"), "part")


_DECIDE = "(SELECT l_orderkey AS id, l_linenumber AS line, CASE WHEN l_suppkey % 4 = 0 THEN 0 ELSE l_quantity * 3 END AS height, CASE WHEN l_suppkey % 3 = 0 THEN 0 ELSE (l_partkey % 40)::DOUBLE END AS floors, (l_extendedprice / 700)::DOUBLE AS observed, l_returnflag = 'A' AS derived, l_linestatus = 'O' AS strong, l_partkey % 2 = 0 AS corroborated FROM lineitem)"


@query(f"""SELECT decision, COUNT(*) AS n, SUM(id)::BIGINT AS ids FROM (SELECT id, CASE WHEN height > 0 AND NOT derived AND NOT conflict THEN 'measured_height' WHEN off THEN 'source_height_conflict' WHEN conflict AND NOT (derived OR wrong) THEN 'source_height_conflict'
  WHEN conflict AND (strong OR (derived AND (corroborated OR wrong))) THEN 'corrected_estimated_height' WHEN conflict THEN 'weak_height_correction' ELSE 'measured_height' END AS decision FROM (
  SELECT *, height > 0 AND least(height, observed) > 0 AND abs(height - observed) > 20 AND least(height, observed) < greatest(height, observed) * 0.65::DOUBLE AS conflict, floors > 0 AND (observed < floors * 2 - 10 OR observed > floors * 5 + 15) AS off,
    floors > 0 AND (height < floors * 2 - 10 OR height > floors * 5 + 15) AS wrong FROM {_DECIDE})) GROUP BY decision""")
def height_decision(spark, sf_dir):
    rows = view(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("id"), F.when(F.col("l_suppkey") % 4 == 0, 0.0).otherwise(F.col("l_quantity") * 3).alias("height"), F.when(F.col("l_suppkey") % 3 == 0, 0.0).otherwise((F.col("l_partkey") % 40).cast("double")).alias("floors"),
        (F.col("l_extendedprice") / 700).alias("observed"), (F.col("l_returnflag") == "A").alias("derived"), (F.col("l_linestatus") == "O").alias("strong"), (F.col("l_partkey") % 2 == 0).alias("corroborated"),
    )
    return rows.groupBy(surveys.height_decision().alias("decision")).agg(F.count("*").alias("n"), F.sum("id").alias("ids"))
