"""Map features, returns, tracks and surveys derived from the star-schema tables by SQL that Spark and DuckDB both read.

Each derived table is a SELECT over base tables; a query names those that it uses. Positions come from integer keys, so
both engines derive the same numbers."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from geoloom.sources.tables import read

BASE = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages")

VIEWS = {
    "points": """
SELECT CAST((l_partkey * 37) % 200 AS DOUBLE) + CAST(l_linenumber AS DOUBLE) / 8 AS x, CAST((l_orderkey * 91) % 200 AS DOUBLE) + CAST(l_linenumber AS DOUBLE) / 8 AS y, l_quantity AS z,
       CASE WHEN l_suppkey % 11 = 0 THEN 9 WHEN l_suppkey % 11 = 1 THEN 5 WHEN l_returnflag = 'A' THEN 2 WHEN l_returnflag = 'R' THEN 6 ELSE 1 END AS cls,
       l_linestatus = 'O' AS single, l_partkey AS part, CAST(2000 + l_suppkey % 4 * 5 AS INT) AS year
FROM lineitem""",
    "cells": """
SELECT CAST(FLOOR(y + CAST(0.5 AS DOUBLE)) AS BIGINT) AS row, CAST(FLOOR(x + CAST(0.5 AS DOUBLE)) AS BIGINT) AS col, z, cls, single, (cls IN (3, 4, 5) OR (cls = 1 AND NOT single)) AS plant FROM points""",
    "grid": """
SELECT CAST((l_orderkey * 91) % 60 AS BIGINT) AS row, CAST((l_partkey * 37) % 60 AS BIGINT) AS col, AVG(l_quantity) AS v, COUNT(*) AS n FROM lineitem GROUP BY 1, 2 HAVING SUM(l_discount) >= COUNT(*) * CAST(0.05 AS DOUBLE)""",
    "mask": """SELECT row, col FROM grid WHERE v < 25.5""",
    "footprints": """
SELECT p_partkey AS id, CAST((p_partkey * 37) % 1000 AS DOUBLE) AS x0, CAST((p_partkey * 53) % 1000 AS DOUBLE) AS y0, CAST((p_partkey * 37) % 1000 + 3 + p_size % 10 AS DOUBLE) AS x1,
       CAST((p_partkey * 53) % 1000 + 3 + p_size % 7 AS DOUBLE) AS y1, LOWER(p_type) AS class, CASE WHEN p_partkey % 4 = 0 THEN NULL ELSE CAST(p_size AS DOUBLE) * 3 END AS height,
       CASE WHEN p_partkey % 3 = 0 THEN NULL ELSE CAST(p_size AS DOUBLE) END AS floors, CASE WHEN p_partkey % 5 = 0 THEN NULL ELSE p_name END AS name, p_partkey % 2 = 0 AS has_parts
FROM part""",
    "parts_of": """
SELECT l_orderkey * 10 + l_linenumber AS id, (l_partkey * 7) % 2600 AS building_id, l_returnflag = 'R' AS is_underground, l_quantity > 30 AS useful FROM lineitem""",
    "tracks": """
SELECT user_id AS track, CAST(ROW_NUMBER() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS BIGINT) AS seq, CAST((event_id * 37) % 1000 AS DOUBLE) + value AS x, CAST((event_id * 53) % 700 AS DOUBLE) AS y FROM events""",
    "segments": """
SELECT o_orderkey AS id, CASE o_orderpriority WHEN '1-URGENT' THEN 'motorway' WHEN '2-HIGH' THEN 'primary' WHEN '5-LOW' THEN 'footway' ELSE 'lane' END AS class FROM orders""",
    "rules": """
SELECT l_orderkey AS id, CAST(l_linenumber * 1000000 + l_partkey AS BIGINT) AS place, CASE l_returnflag WHEN 'A' THEN 'width' WHEN 'R' THEN 'level' ELSE 'flag' END AS kind,
       CAST(CAST(l_quantity AS INT) % 9 AS DOUBLE) AS value, CASE WHEN l_suppkey % 13 = 0 THEN NULL ELSE CAST(l_partkey % 8 AS DOUBLE) / 16 END AS a, CAST(l_partkey % 8 + l_linenumber * 2 - 1 AS DOUBLE) / 16 AS b
FROM lineitem""",
    "surveys": """
SELECT n_nationkey AS area, s_suppkey AS survey, CASE WHEN s_suppkey % 9 = 0 THEN 0 ELSE 15000 + (s_suppkey * 97) % 4000 END AS day, CAST((s_suppkey * 31) % 101 AS DOUBLE) / 100 AS coverage,
       CAST((s_suppkey * 17) % 23 + 1 AS DOUBLE) / 2 AS density, CAST(s_suppkey % 4 AS DOUBLE) / 4 AS class_quality, CASE s_suppkey % 4 WHEN 0 THEN 'EPT' WHEN 1 THEN 'COPC' WHEN 2 THEN 'I3S' ELSE 'LAZ' END AS format,
       s_suppkey % 3 = 0 AS authoritative, s_name AS url
FROM supplier JOIN nation ON s_nationkey % 5 = n_nationkey % 5""",
    "records": """
SELECT l_partkey AS building, l_tax AS coverage, l_discount AS explained, l_quantity / 10 AS density, CAST(2010 + l_suppkey % 12 AS INT) AS year, CAST(l_linenumber AS DOUBLE) / 7 AS class_share, l_suppkey AS source, l_orderkey AS url FROM lineitem""",
    "lines": """
SELECT o_orderkey AS id, CAST(o_custkey % 5 AS INT) AS rank, CAST((o_orderkey * 37) % 2000 AS DOUBLE) AS ax, CAST((o_orderkey * 53) % 2000 AS DOUBLE) AS ay,
       CAST((o_orderkey * 37) % 2000 + CASE WHEN o_orderkey % 2 = 0 THEN 12 ELSE 0 END AS DOUBLE) AS bx, CAST((o_orderkey * 53) % 2000 + CASE WHEN o_orderkey % 2 = 0 THEN 0 ELSE 12 END AS DOUBLE) AS by_
FROM orders""",
    "edges": """
SELECT o_orderkey AS id, o_custkey AS a, (o_custkey * 7 + o_orderkey) % 1500 AS b, CAST(1 + o_orderkey % 9 AS DOUBLE) AS cost FROM orders""",
    "links": """SELECT o_orderkey AS a, o_custkey + 1000000000 AS b FROM orders""",
    "ends": """
SELECT o_orderkey AS id, o_custkey % 97 AS seam, o_orderkey % 6 AS kind, CASE WHEN o_orderstatus = 'F' THEN -1 ELSE 1 END AS side, CAST((o_orderkey * 137) % 40960 AS DOUBLE) / 10 AS along FROM orders""",
    "picks": """SELECT c_nationkey AS owner, CAST((c_custkey * 37) % 2000 AS DOUBLE) AS x, CAST((c_custkey * 53) % 2000 AS DOUBLE) AS y FROM customer""",
    "tiles": """
SELECT o_orderkey AS id, CAST((o_orderkey * 41) % 1000 AS DOUBLE) AS x0, CAST((o_orderkey * 67) % 1000 AS DOUBLE) AS y0, CAST((o_orderkey * 41) % 1000 + 3 AS DOUBLE) AS x1, CAST((o_orderkey * 67) % 1000 + 2 AS DOUBLE) AS y1 FROM orders""",
    "places": """
SELECT c_custkey AS id, CAST((c_custkey * 37) % 3600 AS DOUBLE) / 10 - 180 AS lon, CAST((c_custkey * 53) % 1600 AS DOUBLE) / 10 - 80 AS lat FROM customer""",
    "names": """
SELECT o_orderkey AS id, CASE o_orderkey % 6 WHEN 0 THEN CAST(o_custkey % 30 AS STRING) || ' m' WHEN 1 THEN ' ' || CAST(o_custkey % 30 AS STRING) || '.5' WHEN 2 THEN CAST(o_custkey % 30 AS STRING) || ' ft' WHEN 3 THEN 'wide' WHEN 4 THEN CAST(o_custkey % 30 AS STRING) || 'feet' END AS width,
       CASE o_orderkey % 3 WHEN 0 THEN 'Region_' || CAST(o_custkey % 9 AS STRING) || '_B' || lpad(CAST(o_custkey % 30 AS STRING), 2, '0') WHEN 1 THEN 'Region_G20' ELSE 'Plain2019' END AS unit,
       CASE WHEN o_orderkey % 7 = 0 THEN 'undated' ELSE CAST(o_orderdate AS STRING) END AS day, 2015 + o_orderkey % 3 AS flown_in,
       CASE o_orderkey % 4 WHEN 0 THEN 'survey_utm10_' || CAST(20150105 + o_custkey % 3 * 10000 AS STRING) || '_' || CAST(20150219 + o_custkey % 3 * 10000 AS STRING) || '.laz' WHEN 1 THEN 'survey_' || CAST(20150310 + o_custkey % 3 * 10000 AS STRING) || '.laz' WHEN 2 THEN 'survey.laz' ELSE 'survey_20150105_20160107.laz' END AS file,
       CASE o_orderkey % 3 WHEN 0 THEN '2021_NorthRiver_LiDAR' WHEN 1 THEN 'EastBay_lidar' ELSE 'lidar_Old_TownA' END AS project,
       CASE o_orderkey % 5 WHEN 0 THEN CAST(o_custkey % 300 AS STRING) WHEN 1 THEN 'Thu, 26 Nov 2026 10:' || lpad(CAST(o_custkey % 60 AS STRING), 2, '0') || ':07 GMT' WHEN 2 THEN 'soon' WHEN 3 THEN '' END AS wait,
       CASE o_orderkey % 9 WHEN 0 THEN 'b:' WHEN 1 THEN 'r:' WHEN 2 THEN 'w:' WHEN 3 THEN 't:' WHEN 4 THEN 'k:' WHEN 5 THEN 's:' WHEN 6 THEN 'rt:' WHEN 7 THEN 'x:' ELSE 'n' END || CAST(o_custkey AS STRING) || CASE WHEN o_custkey % 4 = 0 THEN '/wall/2' ELSE '' END AS key
FROM orders""",
    "index_rows": """
SELECT CASE s_suppkey % 4 WHEN 0 THEN 'folder:' WHEN 1 THEN 'http:' ELSE 'https:' END || '//files.example/theme=' || CASE WHEN s_suppkey % 3 = 0 THEN 'buildings' ELSE 'base' END || CASE WHEN s_suppkey % 10 = 3 THEN '/part-' ELSE '/type=land/part-' END || CAST(s_suppkey AS STRING) || '.parquet' AS href,
       s_suppkey * 1000 - 5000 AS size, CASE WHEN s_suppkey % 11 <> 0 THEN CAST(s_suppkey % 300 AS DOUBLE) - 180 END AS xmin, CAST(s_suppkey % 100 AS DOUBLE) - 50 AS ymin, CAST(s_suppkey % 300 AS DOUBLE) - 179 AS xmax, CAST(s_suppkey % 100 AS DOUBLE) - 49 AS ymax, CASE WHEN s_suppkey % 6 <> 0 THEN s_suppkey END AS num_rows FROM supplier""",
    "intervals": """
SELECT l_orderkey AS key, CAST(l_partkey % 50 AS DOUBLE) / 64 AS a, CAST(l_partkey % 50 + 1 + l_linenumber AS DOUBLE) / 64 AS b FROM lineitem""",
}


def needed(names: list[str]) -> list[str]:
    """The derived tables behind names, in an order in which each comes after those it uses."""
    out: list[str] = []
    for name in names:
        if name in VIEWS and name not in out:
            used = [v for v in VIEWS if v != name and re.search(rf"(FROM|JOIN) {v}\b", VIEWS[name])]
            out += [v for v in needed(used) if v not in out] + [name]
    return out


def view(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A derived or base table as a DataFrame."""
    if name in BASE:
        return read(spark, folder, name)
    sql = VIEWS[name]
    used = {t: view(spark, folder, t) for t in dict.fromkeys(re.findall(r"(?:FROM|JOIN) (\w+)\b", sql)) if t in VIEWS or t in BASE}
    return spark.sql(re.sub(r"(FROM|JOIN) (\w+)\b", lambda m: f"{m[1]} {{{m[2]}}}" if m[2] in used else m[0], sql), **used)


def with_views(names: str, sql: str) -> str:
    """DuckDB SQL in which the named derived tables stand before the query."""
    parts = [f"{v} AS ({VIEWS[v].strip()})" for v in needed(names.split())]
    return f"WITH RECURSIVE {', '.join(parts)} {sql.strip()}" if not sql.lstrip().startswith(",") else f"WITH RECURSIVE {', '.join(parts)}{sql.strip()}"
