"""Queries over rules of texts, and over files of a release index."""

from __future__ import annotations

from pyspark.sql import functions as F

from geoloom.functions import texts
from geoloom.operators import features
from geoloom.plans.catalogue import query
from geoloom.plans.views import view, with_views


@query(with_views("names", """ SELECT id, CASE WHEN regexp_full_match(trim(width), '[0-9]+([.][0-9]+)?\\s*m?') AND m > 0 THEN m WHEN regexp_full_match(trim(width), '[0-9]+([.][0-9]+)?\\s*(ft|feet)') AND m > 0 THEN m * 0.3048::DOUBLE END AS width_m
FROM (SELECT id, width, TRY_CAST(regexp_extract(trim(width), '^[0-9.]+') AS DOUBLE) AS m FROM names)"""))
def tagged_widths(spark, sf_dir):
    return view(spark, sf_dir, "names").select("id", texts.tagged_width(F.col("width")).alias("width_m"))


@query(with_views("names", """ SELECT id, CASE WHEN unit[-4] = '_' AND unit[-3] BETWEEN 'A' AND 'F' THEN 2000 + CAST(right(unit, 2) AS INT) END AS year, CASE WHEN day LIKE '____-__-__%' THEN left(day, 10) END AS day,
CASE WHEN TRY_CAST(right(replace(file, '.laz', ''), 8) AS INT) IS NULL THEN own || '-01-01' WHEN first // 10000 = own::INT THEN left(first::VARCHAR, 4) || '-' || substr(first::VARCHAR, 5, 2) || '-' || right(first::VARCHAR, 2) WHEN last // 10000 = own::INT THEN left(last::VARCHAR, 4) || '-' || substr(last::VARCHAR, 5, 2) || '-' || right(last::VARCHAR, 2) ELSE own || '-01-01' END AS start,
CASE WHEN TRY_CAST(right(replace(file, '.laz', ''), 8) AS INT) IS NULL THEN own || '-12-31' WHEN first // 10000 = own::INT OR last // 10000 = own::INT THEN left(last::VARCHAR, 4) || '-' || substr(last::VARCHAR, 5, 2) || '-' || right(last::VARCHAR, 2) ELSE own || '-12-31' END AS end_
FROM (SELECT *, flown_in::VARCHAR AS own, TRY_CAST(right(replace(file, '.laz', ''), 8) AS INT) AS last, coalesce(TRY_CAST(CASE WHEN substr(file, length(file) - 21, 1) = '_' THEN substr(file, length(file) - 20, 8) END AS INT), TRY_CAST(right(replace(file, '.laz', ''), 8) AS INT)) AS first FROM names)"""))
def dates_in_names(spark, sf_dir):
    told = view(spark, sf_dir, "names").withColumn("flown", texts.flown(F.col("file"), F.col("flown_in")))
    return told.select("id", texts.work_unit_year(F.col("unit")).alias("year"), texts.iso_date(F.col("day")).alias("day"), F.col("flown.start").alias("start"), F.col("flown.end").alias("end_"))


@query(with_views("names", """ SELECT id, trim(regexp_replace(replace(CASE WHEN lower(project) LIKE '%\\_lidar' ESCAPE '\\' THEN left(project, length(project) - 6) ELSE project END, '_', ' '), '([a-z])([A-Z])', '\\1 \\2', 'g')) AS name FROM names"""))
def project_names(spark, sf_dir):
    return view(spark, sf_dir, "names").select("id", texts.spaced_name(F.col("project")).alias("name"))


@query(with_views("names", """ SELECT id, CASE WHEN wait LIKE '%GMT' THEN greatest(0, epoch_ms(strptime(wait, '%a, %d %b %Y %H:%M:%S GMT')) - epoch_ms(TIMESTAMP '2026-11-26 10:30:00'))::DOUBLE WHEN wait = '' THEN NULL ELSE greatest(0, TRY_CAST(wait AS DOUBLE) * 1000) + CASE WHEN TRY_CAST(wait AS DOUBLE) IS NOT NULL THEN 0 END END AS ms FROM names"""))
def retry_waits(spark, sf_dir):
    now = F.try_to_timestamp(F.lit("2026-11-26 10:30:00"))
    return view(spark, sf_dir, "names").select("id", texts.wait_ms(F.col("wait"), now).alias("ms"))


@query(with_views("names", """ SELECT id, CASE split_part(key, ':', 1) WHEN 'b' THEN 'building' WHEN 'r' THEN 'road' WHEN 'w' THEN 'water' WHEN 't' THEN 'tree' WHEN 'k' THEN 'rock' WHEN 's' THEN 'shape' WHEN 'rt' THEN 'route' END AS kind, split_part(key, '/', 1) AS object, CASE WHEN id % 2 = 0 THEN key || '/roof' ELSE key END AS part FROM names"""))
def object_keys(spark, sf_dir):
    key, part = F.col("key"), F.when(F.col("id") % 2 == 0, "roof").otherwise("")
    return view(spark, sf_dir, "names").select("id", texts.object_kind(key).alias("kind"), texts.whole_object(key).alias("object"), texts.part_of(key, part).alias("part"))


@query("""SELECT p_partkey AS id, CASE WHEN r <= 0.1 THEN 32 ELSE (SELECT MIN(k) FROM range(32, 193, 4) s(k) WHERE k >= least(192, ceil(pi() / acos(1 - 0.1::DOUBLE / r)))) END::BIGINT AS segments FROM (SELECT p_partkey, (p_partkey % 4000)::DOUBLE / 16 AS r FROM part)""")
def circles(spark, sf_dir):
    return view(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), texts.circle_segments((F.col("p_partkey") % 4000).cast("double") / 16).alias("segments"))


@query("SELECT l_orderkey AS a, l_linenumber AS b, printf('%.6f', (l_orderkey % 4001 - 2000)::DOUBLE / 128 + l_linenumber) AS text FROM lineitem")
def six_decimals(spark, sf_dir):
    v = (F.col("l_orderkey") % 4001 - 2000).cast("double") / 128 + F.col("l_linenumber")
    return view(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("a"), F.col("l_linenumber").alias("b"), texts.six_decimals(v).alias("text"))


@query(with_views("index_rows", """ SELECT split_part(split_part(href, '/theme=', 2), '/', 1) AS theme, split_part(split_part(href, '/type=', 2), '/', 1) AS type, href, CASE WHEN size > 0 THEN size ELSE 0 END AS size, xmin, ymin, xmax, ymax, coalesce(num_rows, 0) AS num_rows
FROM index_rows WHERE href LIKE 'https://%/theme=%/type=%/%' AND xmin IS NOT NULL"""))
def release_files(spark, sf_dir):
    return features.release_files(view(spark, sf_dir, "index_rows"))
