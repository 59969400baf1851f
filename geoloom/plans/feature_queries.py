"""Queries over map features."""

from __future__ import annotations

from pyspark.sql import functions as F

from geoloom.functions import scalar
from geoloom.operators import cells as spatial
from geoloom.operators import features, polygons
from geoloom.plans.catalogue import query
from geoloom.plans.views import view, with_views
from geoloom.sinks import drawings
from geoloom.sources.tables import read

_BOUNDS = features.Bounds(100, 100, 400, 350)
_IN = "x0 < 400 AND x1 > 100 AND y0 < 350 AND y1 > 100"


@query(with_views("footprints", f"SELECT id, class, x0, y0, x1, y1 FROM footprints WHERE {_IN}"))
def bbox_scan(spark, sf_dir):
    return features.scan(view(spark, sf_dir, "footprints"), _BOUNDS, ["x0", "y0"]).select("id", "class", "x0", "y0", "x1", "y1")


@query(with_views("points", "SELECT part, MIN(z) AS z, arg_min(x, z * 1000000 + x * 1000 + y) AS x FROM points WHERE x > 20 AND x < 90 AND y > 10 AND y < 140 GROUP BY part"))
def scan_first_wins(spark, sf_dir):
    rows = view(spark, sf_dir, "points").withColumn("id", F.col("part")).withColumn("bbox", F.struct(F.col("x").alias("xmin"), F.col("x").alias("xmax"), F.col("y").alias("ymin"), F.col("y").alias("ymax")))
    # the SQL's own order: by z, but not by x before y, as a y may weigh more than a step of x
    first = F.col("z") * 1000000 + F.col("x") * 1000 + F.col("y")
    found = features.scan(rows, features.Bounds(20, 10, 90, 140), [first, "x"], box="bbox")
    return found.select("part", "z", "x")


_KINDS = "['building', 'segment', 'water', 'land', 'land_use', 'land_cover', 'infrastructure']"
_CLASSES = "['wood', 'footway', 'swimming_pool', 'Tree', 'park ', 'pier', 'primary', 'scree', 'plaza']"
_SUBS = "['road', 'rail', 'forest', 'grass', 'dam', '']"
_FEATURES_SQL = f"(SELECT p_partkey AS id, {_KINDS}[(p_partkey % 7)::INT + 1] AS kind, {_CLASSES}[(p_partkey % 9)::INT + 1] AS class, {_SUBS}[(p_partkey // 5 % 6)::INT + 1] AS subtype, p_partkey % 4 = 1 AS is_underground, (p_size % 40)::DOUBLE AS side FROM part)"


def _features(spark, sf_dir):
    pick = lambda values, k: F.element_at(F.array(*map(F.lit, values)), (k + 1).cast("int"))
    k = F.col("p_partkey")
    kinds = ["building", "segment", "water", "land", "land_use", "land_cover", "infrastructure"]
    classes = ["wood", "footway", "swimming_pool", "Tree", "park ", "pier", "primary", "scree", "plaza"]
    return read(spark, sf_dir, "part").select(
        k.alias("id"), pick(kinds, k % 7).alias("kind"), pick(classes, k % 9).alias("class"), pick(["road", "rail", "forest", "grass", "dam", ""], F.floor(k / 5) % 6).alias("subtype"),
        (k % 4 == 1).alias("is_underground"), F.lit(0.0).alias("x0"), F.lit(0.0).alias("y0"), (F.col("p_size") % 40).cast("double").alias("x1"), (F.col("p_size") % 40).cast("double").alias("y1"),
    )


_CATEGORY = """CASE kind WHEN 'land' THEN coalesce(l[c], l[s]) WHEN 'land_use' THEN coalesce(u[c], u[s]) WHEN 'land_cover' THEN coalesce(v[s], v[c]) END"""
_MAPS = ", ".join(f"MAP {{{', '.join(f"'{k}': '{v}'" for k, v in m.items())}}} AS {n}" for n, m in (("l", features.LAND), ("u", features.LAND_USE), ("v", features.LAND_COVER)))
_CATEGORIZED = f"(SELECT *, {_CATEGORY} AS category FROM (SELECT *, lower(trim(class)) AS c, lower(trim(subtype)) AS s, {_MAPS} FROM {_FEATURES_SQL}))"


@query(f"SELECT id, category FROM {_CATEGORIZED}")
def classify_surface(spark, sf_dir):
    f = _features(spark, sf_dir)
    return f.select("id", features.surface_category(F.col("kind"), F.col("class"), F.col("subtype")).alias("category"))


_DECK = "('pier', 'breakwater', 'quay', 'dam', 'weir', 'boardwalk', 'groyne')"


@query(f"""SELECT id, kind FROM {_CATEGORIZED} WHERE CASE kind WHEN 'building' THEN NOT is_underground
  WHEN 'segment' THEN CASE WHEN s = 'rail' THEN true WHEN s <> 'road' THEN false ELSE c NOT IN ('footway', 'sidewalk', 'crosswalk', 'steps', 'path', 'track', 'cycleway', 'bridleway') END
  WHEN 'water' THEN c <> 'swimming_pool' WHEN 'land' THEN CASE WHEN c = 'tree' OR s = 'tree' OR c IN {_DECK} OR s IN {_DECK} THEN true ELSE category IS NOT NULL AND side * side / 100 <= 8 END
  WHEN 'land_use' THEN c IN {_DECK} OR s IN {_DECK} OR (category IS NOT NULL AND side * side / 100 <= 8) WHEN 'land_cover' THEN category IS NOT NULL ELSE c IN {_DECK} OR s IN {_DECK} END""")
def row_filter(spark, sf_dir):
    return _features(spark, sf_dir).where(features.wanted_rows(features.Need(), features.Bounds(0, 0, 10, 10))).select("id", "kind")


_TAGGED = "(SELECT c_custkey AS id, ['water', 'wood'][(c_custkey % 2)::INT + 1] AS natural_, ['pond', 'lake', ''][(c_custkey % 3)::INT + 1] AS water, ['', 'river'][(c_custkey % 11 = 0)::INT + 1] AS waterway, ['', 'fountain'][(c_custkey % 7 = 0)::INT + 1] AS amenity, ['basin', 'river', 'other', 'Pond '][(c_custkey % 4)::INT + 1] AS class FROM customer)"


@query(f"""SELECT id, CASE WHEN waterway IN ('river', 'stream', 'canal', 'drain', 'ditch') OR (water <> '' AND water NOT IN ('pond', 'basin')) THEN NULL WHEN amenity = 'fountain' THEN 'fountain'
  WHEN natural_ = 'water' AND water IN ('pond', 'basin') THEN water WHEN lower(trim(class)) IN ('river', 'lake') THEN NULL WHEN lower(trim(class)) IN ('pond', 'fountain', 'basin') THEN lower(trim(class)) END AS basin FROM {_TAGGED}""")
def water_kind(spark, sf_dir):
    k = F.col("c_custkey")
    pick = lambda values, at: F.element_at(F.array(*map(F.lit, values)), at.cast("int") + 1)
    tags = F.create_map(F.lit("natural"), pick(["water", "wood"], k % 2), F.lit("water"), pick(["pond", "lake", ""], k % 3), F.lit("waterway"), pick(["", "river"], k % 11 == 0), F.lit("amenity"), pick(["", "fountain"], k % 7 == 0))
    return read(spark, sf_dir, "customer").select(k.alias("id"), features.basin_kind(tags, pick(["basin", "river", "other", "Pond "], k % 4), F.lit("")).alias("basin"))


@query("SELECT c_custkey AS id, coalesce(NULLIF(lower(trim(CASE WHEN c_custkey % 3 = 0 THEN c_mktsegment END)), ''), CASE WHEN c_custkey % 2 = 0 THEN 'yes' ELSE 'no' END) AS building, (2 + (c_custkey % 3 = 0)::INT - (c_custkey % 3 = 0)::INT)::INT AS n FROM customer")
def tag_merge(spark, sf_dir):
    k = F.col("c_custkey")
    own = F.create_map(F.lit(" Building"), F.when(k % 2 == 0, "YES ").otherwise(" no"), F.lit("name"), F.col("c_name"))
    more = F.when(k % 3 == 0, F.create_map(F.lit("building "), F.col("c_mktsegment")))
    tags = features.merged_tags(own, more)
    return read(spark, sf_dir, "customer").select(k.alias("id"), F.element_at(tags, "building").alias("building"), F.size(tags).alias("n"))


_LENGTH_TEXT = "CASE o_orderkey % 7 WHEN 0 THEN (o_custkey / 10.0::DOUBLE)::VARCHAR WHEN 1 THEN ' ' || o_custkey || ' m ' WHEN 2 THEN o_custkey || ' ft' WHEN 3 THEN (o_custkey % 9) || '''' || (o_custkey % 12) || '\"' WHEN 4 THEN o_custkey || '''' WHEN 5 THEN o_orderpriority ELSE '' END"


@query(rf"""SELECT id, round(CASE WHEN regexp_full_match(t, '[+-]?(\d+\.?\d*|\.\d+)\s*m?') THEN try_cast(regexp_extract(t, '^([+-]?(?:\d+\.?\d*|\.\d+))', 1) AS DOUBLE)
  WHEN regexp_full_match(t, '[+-]?(\d+\.?\d*|\.\d+)\s*(ft|feet|'')') THEN try_cast(regexp_extract(t, '^([+-]?(?:\d+\.?\d*|\.\d+))', 1) AS DOUBLE) * 0.3048
  WHEN regexp_full_match(t, '\d+''\s*\d+"') THEN try_cast(regexp_extract(t, '^(\d+)''', 1) AS DOUBLE) * 0.3048 + try_cast(regexp_extract(t, '(\d+)"$', 1) AS DOUBLE) * 0.0254 END, 6) AS metres
FROM (SELECT o_orderkey AS id, trim({_LENGTH_TEXT}) AS t FROM orders)""")
def length_parse(spark, sf_dir):
    k, c = F.col("o_orderkey") % 7, F.col("o_custkey")
    text = (
        F.when(k == 0, (c / 10.0).cast("string")).when(k == 1, F.concat(F.lit(" "), c, F.lit(" m "))).when(k == 2, F.concat(c, F.lit(" ft")))
        .when(k == 3, F.concat(c % 9, F.lit("'"), c % 12, F.lit('"'))).when(k == 4, F.concat(c, F.lit("'"))).when(k == 5, F.col("o_orderpriority")).otherwise("")
    )
    return read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.round(scalar.length_metres(text), 6).alias("metres"))


@query(r"SELECT page_id AS id, try_cast(NULLIF(regexp_extract(url || ' ' || (1890 + page_id), '(?:^|\D)((?:19|20)\d{2})(?:\D|$)', 1), '') AS INT) AS year FROM pages")
def year_parse(spark, sf_dir):
    text = F.concat("url", F.lit(" "), 1890 + F.col("page_id"))
    return read(spark, sf_dir, "pages").select(F.col("page_id").alias("id"), scalar.year_in(text).alias("year"))


_PROFILED = """(SELECT p_partkey AS id, lower(p_type) AS class, CASE WHEN p_partkey % 4 < 2 THEN NULL ELSE p_retailprice - 300 END AS height, CASE WHEN p_partkey % 3 = 0 THEN NULL ELSE (p_size * 5)::DOUBLE END AS num_floors,
  CASE WHEN p_partkey % 5 = 0 THEN (p_size * 2)::DOUBLE END AS min_height, CASE WHEN p_partkey % 7 = 0 THEN (p_size - 3)::DOUBLE END AS min_floor, ['house', 'church', 'odd'][(p_partkey % 3)::INT + 1] AS sub, (1 + p_size % 12)::DOUBLE AS width_m,
  ['flat', 'gabled', 'pyramid', 'dome'][(p_partkey % 4)::INT + 1] AS roof_kind, CASE WHEN p_partkey % 6 = 0 THEN (p_size % 20)::DOUBLE END AS roof_height FROM part)"""
_PROFILE_SQL = f"""(SELECT *, coalesce(h, f * 3.5, d, 8.0) AS top_m, coalesce(mh, mf * 3.5, 0.0) AS bottom_m, (h IS NOT NULL) AS by_h, (f IS NOT NULL) AS by_f, (d IS NOT NULL) AS by_d FROM (SELECT *, CASE WHEN height > 0 AND height <= 1000 THEN height END AS h,
  CASE WHEN num_floors > 0 AND num_floors <= 200 THEN num_floors END AS f, CASE sub WHEN 'house' THEN 7.0 WHEN 'church' THEN 20.0 END AS d, CASE WHEN min_height <= 1000 THEN min_height END AS mh, CASE WHEN min_floor >= 0 AND min_floor <= 200 THEN min_floor END AS mf FROM {_PROFILED}))"""


def _profiled(spark, sf_dir):
    k, size = F.col("p_partkey"), F.col("p_size")
    pick = lambda values, at: F.element_at(F.array(*map(F.lit, values)), at.cast("int") + 1)
    rows = read(spark, sf_dir, "part").select(
        k.alias("id"), F.lower("p_type").alias("class"), F.when(k % 4 >= 2, F.col("p_retailprice") - 300).alias("height"), F.when(k % 3 != 0, (size * 5).cast("double")).alias("num_floors"),
        F.when(k % 5 == 0, (size * 2).cast("double")).alias("min_height"), F.when(k % 7 == 0, (size - 3).cast("double")).alias("min_floor"), pick(["house", "church", "odd"], k % 3).alias("subtype"),
        (1 + size % 12).cast("double").alias("width_m"), pick(["flat", "gabled", "pyramid", "dome"], k % 4).alias("roof_kind"), F.when(k % 6 == 0, (size % 20).cast("double")).alias("roof_height"),
    )
    return rows.withColumns(features.vertical_profile())


@query(f"""SELECT id, top_m::DOUBLE AS top_m, bottom_m::DOUBLE AS bottom_m, CASE WHEN by_h THEN 'height' WHEN by_f THEN 'num_floors' WHEN by_d THEN 'class_default' ELSE 'default' END || CASE WHEN top_m <= bottom_m THEN '+invalid_interval' ELSE '' END AS height_source,
  coalesce(height > 1000, false) OR coalesce(num_floors > 200, false) OR coalesce(min_height > 1000, false) OR coalesce(min_floor > 200, false) AS implausible FROM {_PROFILE_SQL}""")
def height_profile(spark, sf_dir):
    return _profiled(spark, sf_dir).select("id", "top_m", "bottom_m", "height_source", "implausible")


@query(f"""SELECT id, round(CASE WHEN flat THEN top_m ELSE wall END, 6) AS wall_top_m, round(CASE WHEN flat THEN top_m ELSE peak END, 6) AS roof_top_m FROM (SELECT *, roof_kind = 'flat' OR peak - wall <= 1e-6 AS flat FROM (
  SELECT *, CASE WHEN on_top THEN top_m ELSE greatest(top_m - r, bottom_m + 0.3 * (top_m - bottom_m)) END AS wall, CASE WHEN on_top THEN top_m + r ELSE top_m END AS peak FROM (
  SELECT *, coalesce(CASE WHEN roof_height > 0 AND CASE WHEN on_top THEN top_m + roof_height ELSE roof_height END <= 1000 THEN roof_height END, CASE WHEN roof_kind IN ('pyramid', 'dome') THEN greatest(0.5 * width_m, 0.5) ELSE greatest(least(3.0, 0.6 * width_m), 0.5) END)::DOUBLE AS r
  FROM (SELECT id, roof_kind, roof_height, width_m, top_m::DOUBLE AS top_m, bottom_m::DOUBLE AS bottom_m, (NOT by_h AND by_f AND top_m > bottom_m) AS on_top FROM {_PROFILE_SQL}))))""")
def roof_extent(spark, sf_dir):
    rows = _profiled(spark, sf_dir).withColumns(features.roof_extent())
    return rows.select("id", F.round("wall_top_m", 6).alias("wall_top_m"), F.round("roof_top_m", 6).alias("roof_top_m"))


_SELECT = "u AS (SELECT DISTINCT building_id FROM parts_of WHERE NOT is_underground AND useful), r AS (SELECT id FROM footprints WHERE has_parts AND id IN (SELECT building_id FROM u))"


@query(with_views("footprints parts_of", f", {_SELECT} SELECT 'building' AS kind, id FROM footprints WHERE id NOT IN (SELECT id FROM r) UNION ALL SELECT 'part', id FROM parts_of p WHERE NOT is_underground AND (building_id IN (SELECT id FROM r) OR (useful AND building_id NOT IN (SELECT id FROM footprints)))"))
def part_selection(spark, sf_dir):
    kept, parts = features.select_geometry(view(spark, sf_dir, "footprints"), view(spark, sf_dir, "parts_of"))
    return kept.select(F.lit("building").alias("kind"), "id").unionByName(parts.select(F.lit("part").alias("kind"), "id"))


_PAIR = "greatest(least(a.x1, b.x1) - greatest(a.x0, b.x0), 0) * greatest(least(a.y1, b.y1) - greatest(a.y0, b.y0), 0) / least((a.x1 - a.x0) * (a.y1 - a.y0), (b.x1 - b.x0) * (b.y1 - b.y0))"
_RANK = "({s}.height IS NOT NULL)::INT * 4 + ({s}.floors IS NOT NULL)::INT * 2 + ({s}.name IS NOT NULL)::INT"


@query(with_views("footprints", f"SELECT a.id AS a_id, b.id AS b_id, round({_PAIR}, 6) AS share, CASE WHEN {_RANK.format(s='a')} < {_RANK.format(s='b')} THEN a.id ELSE b.id END AS drop_id FROM footprints a JOIN footprints b ON a.id < b.id AND a.x0 < b.x1 AND a.x1 > b.x0 AND a.y0 < b.y1 AND a.y1 > b.y0 WHERE {_PAIR} >= 0.7"))
def duplicate_pairs(spark, sf_dir):
    return features.duplicate_pairs(view(spark, sf_dir, "footprints").drop("has_parts", "class"), digits=6)


@query()
def duplicate_outlines(spark, sf_dir):
    return features.drop_duplicate_boxes(view(spark, sf_dir, "footprints"))


@query(with_views("footprints", "SELECT a.id AS a, b.id AS b FROM footprints a JOIN footprints b ON a.x0 < b.x1 AND a.x1 > b.x0 AND a.y0 < b.y1 AND a.y1 > b.y0 AND a.id < b.id"))
def spatial_join_box(spark, sf_dir):
    boxes = view(spark, sf_dir, "footprints").select("id", "x0", "y0", "x1", "y1")
    return spatial.overlap_join(boxes, boxes, 16.0).where("a_id < b_id").select(F.col("a_id").alias("a"), F.col("b_id").alias("b"))


@query(with_views("footprints", "SELECT a.id AS id, COUNT(*) AS neighbours FROM footprints a JOIN footprints b ON a.x0 - 30 < b.x1 AND a.x1 + 30 > b.x0 AND a.y0 - 30 < b.y1 AND a.y1 + 30 > b.y0 AND a.id <> b.id GROUP BY a.id"))
def neighbours_30m(spark, sf_dir):
    boxes = view(spark, sf_dir, "footprints").select("id", "x0", "y0", "x1", "y1")
    return spatial.overlap_counts(boxes, 60.0, 30.0).withColumnRenamed("others", "neighbours")


@query(with_views("footprints points", "SELECT id, COUNT(*) AS n, ROUND(AVG(z), 4) AS ground FROM footprints JOIN points ON cls = 2 AND x BETWEEN x0 - 5 AND x1 + 5 AND y BETWEEN y0 - 5 AND y1 + 5 AND NOT (x BETWEEN x0 AND x1 AND y BETWEEN y0 AND y1) GROUP BY id"))
def ring_points(spark, sf_dir):
    boxes = view(spark, sf_dir, "footprints").select("id", "x0", "y0", "x1", "y1")
    near = spatial.points_in_boxes(view(spark, sf_dir, "points").where("cls = 2"), boxes, 16.0, 5.0)
    ring = near.where(~(F.col("x").between(F.col("x0"), F.col("x1")) & F.col("y").between(F.col("y0"), F.col("y1"))))
    return ring.groupBy("id").agg(F.count("*").alias("n"), F.round(F.avg("z"), 4).alias("ground"))


@query(with_views("places", "SELECT id, ROUND((lon + 180) / 360 * 1024, 6) AS tx, ROUND((1 - ln(tan(radians(lat)) + 1 / cos(radians(lat))) / pi()) / 2 * 1024, 6) AS ty FROM places"))
def tile_index(spark, sf_dir):
    tx, ty = scalar.tile_fraction(F.col("lon"), F.col("lat"), 10)
    return view(spark, sf_dir, "places").select("id", F.round(tx, 6).alias("tx"), F.round(ty, 6).alias("ty"))


@query(with_views("places", """SELECT id, ROUND((x - x0) * -sin(radians(7.5)) + (y - y0) * cos(radians(7.5)), 3) AS east,
  ROUND((x - x0) * (-sin(radians(46.2)) * cos(radians(7.5))) + (y - y0) * (-sin(radians(46.2)) * sin(radians(7.5))) + (z - z0) * cos(radians(46.2)), 3) AS north
  FROM (SELECT id, n * cos(radians(lat)) * cos(radians(lon)) AS x, n * cos(radians(lat)) * sin(radians(lon)) AS y, n * (1 - 6.69437999014e-3) * sin(radians(lat)) AS z, m * cos(radians(46.2)) * cos(radians(7.5)) AS x0,
    m * cos(radians(46.2)) * sin(radians(7.5)) AS y0, m * (1 - 6.69437999014e-3) * sin(radians(46.2)) AS z0
    FROM (SELECT *, 6378137.0 / sqrt(1 - 6.69437999014e-3 * pow(sin(radians(lat)), 2)) AS n, 6378137.0 / sqrt(1 - 6.69437999014e-3 * pow(sin(radians(46.2)), 2)) AS m FROM places))"""))
def enu_project(spark, sf_dir):
    east, north = scalar.local_frame(F.col("lon"), F.col("lat"), 7.5, 46.2)
    return view(spark, sf_dir, "places").select("id", F.round(east, 3).alias("east"), F.round(north, 3).alias("north"))


@query()
def tree_jitter(spark, sf_dir):
    seed = F.crc32(F.concat(F.lit("tree:"), F.col("p_partkey").cast("string")).cast("binary")) / 4294967296.0
    return read(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.round(seed * 2 - 1, 9).alias("jitter"))


_RING = "[{'x': x0, 'y': y0}, {'x': x1, 'y': y0 + id % 3}, {'x': x1 + 1, 'y': y1}, {'x': x0, 'y': y1 + 2}]"


def _rings(spark, sf_dir):
    point = lambda x, y: F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))
    c = F.col
    return view(spark, sf_dir, "footprints").select("id", F.array(point(c("x0"), c("y0")), point(c("x1"), c("y0") + c("id") % 3), point(c("x1") + 1, c("y1")), point(c("x0"), c("y1") + 2)).alias("ring"))


@query(with_views("footprints", """, p AS (SELECT id, x0 AS ax, y0 AS ay, x1 AS bx, y0 + id % 3 AS by_, x1 + 1 AS cx, y1 AS cy, x0 AS dx, y1 + 2 AS dy FROM footprints)
SELECT id, round((ax * by_ - bx * ay + bx * cy - cx * by_ + cx * dy - dx * cy + dx * ay - ax * dy) / 2, 6) AS area,
  round(sqrt(pow(bx - ax, 2) + pow(by_ - ay, 2)) + sqrt(pow(cx - bx, 2) + pow(cy - by_, 2)) + sqrt(pow(dx - cx, 2) + pow(dy - cy, 2)) + sqrt(pow(ax - dx, 2) + pow(ay - dy, 2)), 6) AS perimeter FROM p"""))
def ring_measures(spark, sf_dir):
    return _rings(spark, sf_dir).select("id", F.round(polygons.signed_area(F.col("ring")), 6).alias("area"), F.round(polygons.perimeter(F.col("ring")), 6).alias("perimeter"))


@query(with_views("footprints", """, c AS (SELECT DISTINCT id % 2 AS kind, r AS row, k AS col FROM (SELECT id, x0, x1, y0, y1, unnest(range(y0::BIGINT, y1::BIGINT)) AS r FROM footprints), LATERAL (SELECT unnest(range(x0::BIGINT, x1::BIGINT)) AS k))
SELECT (SELECT COUNT(*) FROM (SELECT DISTINCT row, col FROM c)) AS together, (SELECT COUNT(*) FROM c a JOIN c b ON a.row = b.row AND a.col = b.col AND a.kind = 0 AND b.kind = 1) AS both, (SELECT COUNT(*) FROM c a WHERE kind = 0 AND NOT EXISTS (SELECT 1 FROM c b WHERE b.kind = 1 AND b.row = a.row AND b.col = a.col)) AS first_only"""))
def mask_overlay(spark, sf_dir):
    point = lambda x, y: F.struct(F.col(x).alias("x"), F.col(y).alias("y"))
    boxes = view(spark, sf_dir, "footprints").select("id", F.array(point("x0", "y0"), point("x1", "y0"), point("x1", "y1"), point("x0", "y1")).alias("ring"))
    cells = polygons.to_mask(boxes).select((F.col("id") % 2).alias("kind"), "row", "col").distinct()
    kinds = cells.groupBy("row", "col").agg(F.bool_or(F.col("kind") == 0).alias("a"), F.bool_or(F.col("kind") == 1).alias("b"))
    return kinds.agg(F.count("*").alias("together"), F.count_if(F.expr("a and b")).alias("both"), F.count_if(F.expr("a and not b")).alias("first_only"))


@query(with_views("footprints", """, p AS (SELECT id, x0 AS ax, y0 AS ay, x1 AS bx, y0 + id % 3 AS by_, x1 + 1 AS cx, y1 AS cy, x0 AS dx, y1 + 2 AS dy FROM footprints),
e AS (SELECT id, ax AS x, ay AS y, bx AS u, by_ AS v FROM p UNION ALL SELECT id, bx, by_, cx, cy FROM p UNION ALL SELECT id, cx, cy, dx, dy FROM p UNION ALL SELECT id, dx, dy, ax, ay FROM p),
r AS (SELECT *, unnest(range(floor(least(y, v) / 2)::BIGINT - 1, ceil(greatest(y, v) / 2)::BIGINT + 1)) AS row FROM e)
SELECT id, row, round(x + (row * 2 + 1 - y) / (v - y) * (u - x), 6) AS x FROM r WHERE row * 2 + 1 >= least(y, v) AND row * 2 + 1 < greatest(y, v)"""))
def row_crossings(spark, sf_dir):
    return polygons.row_crossings(_rings(spark, sf_dir), 1.0, 2.0).select("id", "row", F.round("x", 6).alias("x"))


@query(with_views("footprints", """ SELECT id, 3 + CASE WHEN id % 3 = 0 THEN 0 ELSE 1 END + CASE WHEN id % 2 = 0 THEN 1 ELSE 0 END AS n FROM footprints"""))
def tidy_rings(spark, sf_dir):
    ring = F.concat(F.slice("ring", 1, 3), F.when(F.col("id") % 3 == 0, F.slice("ring", 3, 1)).otherwise(F.slice("ring", 4, 1)), F.when(F.col("id") % 2 == 0, F.array(F.struct((F.col("ring")[0]["x"] - 3).alias("x"), F.col("ring")[0]["y"].alias("y")), F.col("ring")[0])).otherwise(F.slice("ring", 1, 1)))
    return _rings(spark, sf_dir).select("id", F.size(polygons.tidy_ring(ring)).cast("bigint").alias("n"))


@query()
def least_rectangles(spark, sf_dir):
    corners = _rings(spark, sf_dir).select("id", polygons.least_rectangle(F.col("ring")).alias("r"))
    return corners.select("id", F.round(polygons.signed_area(F.col("r")), 4).alias("area"))


@query()
def clip_rings(spark, sf_dir):
    cut = _rings(spark, sf_dir).select("id", polygons.clip_to_box(F.col("ring"), (100.0, 100.0, 600.0, 500.0)).alias("r"))
    return cut.where(F.size("r") > 2).select("id", F.round(polygons.signed_area(F.col("r")), 4).alias("area"))


@query()
def svg_sheets(spark, sf_dir):
    own = _rings(spark, sf_dir).select((F.col("id") % 4).alias("sheet"), F.concat(F.lit("layer "), F.col("id") % 3).alias("layer"), F.col("id").alias("place"), F.lit("#222222").alias("colour"), F.lit(0.35).alias("stroke"), F.col("ring").alias("points"), F.lit(True).alias("closed"))
    return drawings.documents(own, 1000, 1000)
