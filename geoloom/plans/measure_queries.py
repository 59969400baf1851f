"""Queries over measured ground and roofs, and over keys."""

from __future__ import annotations

from pyspark.sql import functions as F

from geoloom.functions import keys
from geoloom.operators import measure, raster
from geoloom.plans.catalogue import query
from geoloom.plans.views import view, with_views


@query(with_views("points", "SELECT cls, floor(x / 4)::BIGINT AS cx, floor(y / 4)::BIGINT AS cy, quantile_cont(x, 0.5) AS x, quantile_cont(y, 0.5) AS y, quantile_cont(z, 0.5) AS z, COUNT(*) AS n FROM points GROUP BY ALL HAVING COUNT(*) >= 3"))
def cell_medians(spark, sf_dir):
    return measure.cell_medians(view(spark, sf_dir, "points"), "cls", 4.0, 3)


@query(with_views("cells", "SELECT row, col, len(l[1:24])::INT AS n, list_sum(l[1:24]) AS total, l[1] AS top FROM (SELECT row, col, list_sort(list(z), 'DESC') AS l FROM cells GROUP BY row, col)"))
def top_returns(spark, sf_dir):
    kept = measure.highest(raster.to_grid(view(spark, sf_dir, "points"), 0.0, 0.0, 1.0), ["row", "col"])
    return kept.select("row", "col", F.size("z").alias("n"), F.aggregate("z", F.lit(0.0), lambda a, v: a + v).alias("total"), F.col("z")[0].alias("top"))


def _blocks(spark, sf_dir):
    return view(spark, sf_dir, "points").withColumn("block", F.floor(F.col("x") / 25).cast("bigint") * 100 + F.floor(F.col("y") / 25).cast("bigint"))


@query(with_views("points", """SELECT block, n, round(a, 4) AS a, round(b, 4) AS b, round(mz - a * mx - b * my, 2) AS c FROM (SELECT *, (xz * yy - yz * xy) / (xx * yy - xy * xy) AS a, (yz * xx - xz * xy) / (xx * yy - xy * xy) AS b FROM (
  SELECT floor(x / 25)::BIGINT * 100 + floor(y / 25)::BIGINT AS block, COUNT(*) AS n, AVG(x) AS mx, AVG(y) AS my, AVG(z) AS mz, covar_pop(x, x) AS xx, covar_pop(x, y) AS xy, covar_pop(y, y) AS yy, covar_pop(x, z) AS xz, covar_pop(y, z) AS yz FROM points GROUP BY 1) WHERE xx * yy - xy * xy > 1e-9 * (1 + xx * yy))"""))
def plane_fit(spark, sf_dir):
    fitted = measure.planes(_blocks(spark, sf_dir), "block")
    return fitted.select("block", "n", F.round("a", 4).alias("a"), F.round("b", 4).alias("b"), F.round("c", 2).alias("c"))


@query()
def ground_planes(spark, sf_dir):
    return measure.ground_planes(_blocks(spark, sf_dir), "block").select("block", "n", F.round("a", 4).alias("a"), F.round("b", 4).alias("b"), F.round("rms", 4).alias("rms"))


@query("SELECT l_suppkey AS part, MIN(h) AS level FROM (SELECT *, SUM(a) OVER (PARTITION BY l_suppkey ORDER BY h) AS below, SUM(a) OVER (PARTITION BY l_suppkey) AS total FROM (SELECT l_suppkey, l_quantity AS h, SUM(l_linenumber) AS a FROM lineitem GROUP BY ALL)) WHERE below >= 0.9 * total - 1e-9 GROUP BY l_suppkey")
def regional_top(spark, sf_dir):
    return measure.weighted_level(view(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("part"), "l_quantity", "l_linenumber"), "part", "l_quantity", "l_linenumber")


_ROOFS = "c AS (SELECT (row // 15)::BIGINT AS b, row AS cy, col AS cx, round(v / 25) * 25 AS z FROM grid)"


@query(with_views("grid", f""", {_ROOFS}, l AS (SELECT c.b, c.cx AS ax, c.cy AS ay, d.cx AS bx, d.cy AS by_, abs(c.z - d.z) < 3 AS j FROM c JOIN c d ON c.b = d.b AND ((d.cx = c.cx + 1 AND d.cy = c.cy) OR (d.cx = c.cx AND d.cy = c.cy + 1))),
e AS (SELECT ax * 1000 + ay AS a, bx * 1000 + by_ AS b FROM l WHERE j UNION ALL SELECT bx * 1000 + by_, ax * 1000 + ay FROM l WHERE j UNION ALL SELECT cx * 1000 + cy, cx * 1000 + cy FROM c),
w(node, root) AS (SELECT a, a FROM e UNION SELECT e.b, w.root FROM w JOIN e ON e.a = w.node),
p AS (SELECT c.b, r.root, COUNT(*) AS n, quantile_cont(z, 0.95) AS top FROM c JOIN (SELECT node, MIN(root) AS root FROM w GROUP BY node) r ON r.node = cx * 1000 + cy GROUP BY c.b, r.root),
a AS (SELECT b, COUNT(*) AS cells FROM c GROUP BY b), k AS (SELECT b, AVG(j::INT) AS coherent FROM l GROUP BY b),
t AS (SELECT p.b, SUM(n) / MAX(cells) AS explained, MAX(top) FILTER (n >= 0.02 * cells) AS top FROM p JOIN a USING (b) WHERE n >= 4 GROUP BY p.b)
SELECT a.b, CASE WHEN top IS NOT NULL AND explained >= 0.85 THEN top END AS height, round(CASE WHEN top IS NOT NULL AND explained >= 0.85 THEN least(explained, coalesce(coherent, 0)) END, 9) AS confidence FROM a LEFT JOIN k USING (b) LEFT JOIN t USING (b)"""))
def supported_height(spark, sf_dir):
    cells = view(spark, sf_dir, "grid").select(F.floor(F.col("row") / 15).cast("bigint").alias("b"), F.col("row").alias("cy"), F.col("col").alias("cx"), (F.round(F.col("v") / 25) * 25).alias("z"), F.lit(0.9).alias("classified"))
    return measure.supported_heights(cells, "b", 3.0).withColumn("confidence", F.round("confidence", 9))


_SURVEYED = "(SELECT s_suppkey AS survey, s_suppkey * 37 % 100 AS place, (s_suppkey * 13 % 50)::DOUBLE AS x0, (s_suppkey * 29 % 50)::DOUBLE AS y0, (s_suppkey * 13 % 50 + 12)::DOUBLE AS x1, (s_suppkey * 29 % 50 + 9)::DOUBLE AS y1 FROM supplier)"


@query(with_views("grid", f"SELECT row, col, arg_min(survey, place * 1000 + survey) AS survey FROM grid JOIN {_SURVEYED} ON col + 0.5 BETWEEN x0 AND x1 AND row + 0.5 BETWEEN y0 AND y1 GROUP BY row, col"))
def survey_claims(spark, sf_dir):
    s, at = F.col("s_suppkey"), lambda k, more=0: (F.col("s_suppkey") * k % 50 + more).cast("double")
    surveys = view(spark, sf_dir, "supplier").select(s.alias("survey"), (s * 37 % 100).alias("place"), at(13).alias("x0"), at(29).alias("y0"), at(13, 12).alias("x1"), at(29, 9).alias("y1"))
    return measure.claims(view(spark, sf_dir, "grid"), surveys)


@query(with_views("lines picks", """, s AS (SELECT id AS line, k, ax + (bx - ax) * k / 6 AS x, ay + (by_ - ay) * k / 6 AS y FROM lines, (SELECT unnest(range(7)) AS k)),
v AS (SELECT line, k, arg_min(owner, (d, owner)) AS owner FROM (SELECT line, k, owner, pow(s.x - p.x, 2) + pow(s.y - p.y, 2) AS d FROM s, picks p WHERE s.x BETWEEN p.x - 25 AND p.x + 25 AND s.y BETWEEN p.y - 25 AND p.y + 25 AND pow(s.x - p.x, 2) + pow(s.y - p.y, 2) <= 625) GROUP BY line, k), c AS (SELECT line, owner, COUNT(*) AS votes FROM v GROUP BY line, owner)
SELECT line, owner, votes FROM c WHERE votes >= 0.7 * 7 QUALIFY ROW_NUMBER() OVER (PARTITION BY line ORDER BY votes DESC, owner) = 1"""))
def picked_lines(spark, sf_dir):
    on = lambda a, b: F.col(a) + (F.col(b) - F.col(a)) * F.col("k") / 6
    sampled = view(spark, sf_dir, "lines").withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(6))))
    samples = sampled.select(F.col("id").alias("line"), "k", on("ax", "bx").alias("x"), on("ay", "by_").alias("y"))
    return measure.picked(samples, view(spark, sf_dir, "picks"), 25.0)


@query(with_views("footprints tiles", "SELECT a.id FROM footprints a WHERE coalesce((SELECT SUM((least(a.x1, b.x1) - greatest(a.x0, b.x0)) * (least(a.y1, b.y1) - greatest(a.y0, b.y0))) FROM tiles b WHERE a.x0 < b.x1 AND a.x1 > b.x0 AND a.y0 < b.y1 AND a.y1 > b.y0), 0) <= 0.25 * (a.x1 - a.x0) * (a.y1 - a.y0)"))
def not_in_tiles(spark, sf_dir):
    boxes = view(spark, sf_dir, "footprints").select("id", "x0", "y0", "x1", "y1")
    return measure.not_covered(boxes, view(spark, sf_dir, "tiles")).select("id")


@query(with_views("grid", """, v AS (SELECT row, col, CASE WHEN (row * 7 + col * 3) % 41 = 0 THEN -32768.0 ELSE v * 3 - 90 END::DOUBLE AS v FROM grid)
SELECT row, col FROM v t WHERE t.v < 0 AND (t.v = -32768 OR (SELECT MAX(q.v - 5.0 * sqrt(pow(q.row - t.row, 2) + pow(q.col - t.col, 2))) FROM v q WHERE q.v <> -32768 AND abs(q.row - t.row) <= 3 AND abs(q.col - t.col) <= 3 AND (q.row <> t.row OR q.col <> t.col)) - t.v > 20)"""))
def elevation_pits(spark, sf_dir):
    hole = (F.col("row") * 7 + F.col("col") * 3) % 41 == 0
    pixels = view(spark, sf_dir, "grid").select("row", "col", F.when(hole, -32768.0).otherwise(F.col("v") * 3 - 90).alias("v"))
    return measure.pits(pixels, 5.0)


@query()
def tree_spacing(spark, sf_dir):
    boxes = view(spark, sf_dir, "footprints").select("id", F.col("x0").alias("x"), F.col("y0").alias("y"))
    return measure.spaced(boxes, ["id"], 8.0)


@query(with_views("grid", "SELECT row // 10 AS model, round(SUM(det) / 6, 4) AS volume FROM (SELECT a.row, unnest([a.col * ((b.row) * d.v - b.v * d.row) - a.row * (b.col * d.v - b.v * d.col) + a.v * (b.col * d.row - b.row * d.col), a.col * (d.row * c.v - d.v * c.row) - a.row * (d.col * c.v - d.v * c.col) + a.v * (d.col * c.row - d.row * c.col)]) AS det FROM grid a JOIN grid b ON b.row = a.row AND b.col = a.col + 1 JOIN grid c ON c.row = a.row + 1 AND c.col = a.col JOIN grid d ON d.row = a.row + 1 AND d.col = a.col + 1) GROUP BY 1"))
def mesh_volume(spark, sf_dir):
    faces = raster.triangles(view(spark, sf_dir, "grid"), "v").withColumn("model", F.floor(F.col("row") / 10).cast("bigint"))
    return measure.signed_volume(faces, "model").select("model", F.round("volume", 4).alias("volume"))


@query("SELECT id, CASE WHEN lo <= 0 AND hi >= 1 THEN seg ELSE seg || '@' || CASE WHEN lo = 0 THEN '0' ELSE lo::VARCHAR END || '-' || CASE WHEN hi = 1 THEN '1' ELSE hi::VARCHAR END END AS key, lo AS low, hi AS high FROM (SELECT o_orderkey AS id, 'r:' || o_custkey AS seg, (o_orderkey % 4)::DOUBLE / 8 AS lo, (o_orderkey % 4 + 5)::DOUBLE / 8 AS hi FROM orders)")
def road_keys(spark, sf_dir):
    o = F.col("o_orderkey")
    key = keys.road_key(F.concat(F.lit("r:"), F.col("o_custkey")), (o % 4) / 8.0, (o % 4 + 5) / 8.0)
    keyed = view(spark, sf_dir, "orders").select(o.alias("id"), key.alias("key"))
    back = keys.parsed_road_key(F.col("key"))
    return keyed.select("id", "key", back["low"].alias("low"), back["high"].alias("high"))


@query("SELECT arg_max(name, (d, n)) AS latest FROM (SELECT strftime(o_orderdate, '%Y-%m-%d') || '.' || (o_custkey % 13) AS name, strftime(o_orderdate, '%Y-%m-%d') AS d, o_custkey % 13 AS n FROM orders)")
def latest_release(spark, sf_dir):
    names = view(spark, sf_dir, "orders").select(F.concat(F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit("."), F.col("o_custkey") % 13).alias("name"))
    return keys.latest_release(names.union(names.select(F.lit("drafts"))), "name")


@query("SELECT id, CASE WHEN good THEN w END AS west, CASE WHEN good THEN e END AS east FROM (SELECT *, abs(w) <= 180 AND abs(e) <= 180 AND e > w AND id % 3 < 2 AS good FROM (SELECT c_custkey AS id, (c_custkey % 400 - 200)::DOUBLE AS w, (c_custkey % 300 - 100)::DOUBLE AS e FROM customer))")
def bounds_text(spark, sf_dir):
    k = F.col("c_custkey")
    w, e = k % 400 - 200, k % 300 - 100
    text = F.when(k % 3 == 0, F.concat_ws(", ", w, F.lit("10"), e, F.lit("20.5"))).when(k % 3 == 1, F.concat(F.lit("bbox=["), w, F.lit(" ; 10 ;"), e, F.lit(";20]"))).otherwise(F.concat_ws(" ", w, e))
    box = keys.bounds_in(text)
    return view(spark, sf_dir, "customer").select(k.alias("id"), box["west"].alias("west"), box["east"].alias("east"))


@query("SELECT o_orderkey AS id, o_orderkey % 2 = 0 AND o_custkey % 3 < 2 AS estimated FROM orders")
def estimated_heights(spark, sf_dir):
    o, c = F.col("o_orderkey"), F.col("o_custkey")
    source = lambda p, d: F.struct(p.alias("property"), d.alias("dataset"))
    height = F.when(o % 2 == 0, "/properties/height").otherwise("")
    data = F.element_at(F.array(F.lit("USGS Lidar"), F.lit("Microsoft ML Buildings"), F.lit("a map")), (c % 3 + 1).cast("int"))
    return view(spark, sf_dir, "orders").select(o.alias("id"), keys.estimated_height(F.array(source(height, data), source(F.lit("/x"), F.lit("a map")))).alias("estimated"))
