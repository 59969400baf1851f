"""Queries over gridded returns."""

from __future__ import annotations

from pyspark.sql import functions as F

from geoloom.functions.scalar import triangle_height
from geoloom.operators import cells as spatial
from geoloom.operators import edits, raster
from geoloom.plans.catalogue import query
from geoloom.plans.views import view, with_views
from geoloom.streaming import surface as streaming

_LAYERS = """
SELECT row, col, ROUND(AVG(CASE WHEN cls IN (2, 8, 20) THEN z END), 4) AS ground, ROUND(AVG(CASE WHEN cls = 9 THEN z END), 4) AS water_z, COUNT(*) AS n_returns, COUNT(*) FILTER (plant) AS n_vegetation,
  COUNT(*) FILTER (cls IN (2, 8, 20)) AS n_ground, COUNT(*) FILTER (cls = 9) AS n_water, COUNT(*) FILTER (cls = 6) AS n_building,
  COALESCE(list_sort(list(z), 'DESC')[2], MAX(z)) AS top, COALESCE(list_sort(list(z) FILTER (NOT plant), 'DESC')[2], MAX(z) FILTER (NOT plant)) AS solid
FROM cells GROUP BY row, col"""


@query(with_views("cells", _LAYERS))
def grid_surface(spark, sf_dir):
    layers = raster.surface_layers(view(spark, sf_dir, "points"))
    return layers.withColumns({"ground": F.round("ground", 4), "water_z": F.round("water_z", 4)})


@query(with_views("cells", """
SELECT layer::BIGINT AS layer, COUNT(*) AS cells, SUM(n)::BIGINT AS returns FROM (
  SELECT row, col, layer, COUNT(*) AS n FROM (
    SELECT row, col, SUM(CASE WHEN up - z >= 8 THEN 1 ELSE 0 END) OVER (PARTITION BY row, col ORDER BY z DESC ROWS UNBOUNDED PRECEDING) AS layer
    FROM (SELECT row, col, z, LAG(z) OVER (PARTITION BY row, col ORDER BY z DESC) AS up FROM cells)) GROUP BY row, col, layer) GROUP BY layer"""))
def grid_floating(spark, sf_dir):
    layers = raster.gap_layers(raster.to_grid(view(spark, sf_dir, "points"), 0.0, 0.0, 1.0), 8.0)
    return layers.groupBy("layer").agg(F.count("*").alias("cells"), F.sum("n").alias("returns"))


@query(with_views("points", ", s AS (SELECT unnest([1.0::DOUBLE, 1.05, 1.25, 2.0, 4.0]) AS size) SELECT size, n, cells, ROUND(1 - n / cells, 6) AS empty FROM (SELECT size, COUNT(*) AS n, (ceil(200 / size) * ceil(200 / size))::BIGINT AS cells FROM (SELECT DISTINCT size, floor(x / size) AS c, floor(y / size) AS r FROM points, s) GROUP BY size)"))
def occupied_cell(spark, sf_dir):
    return raster.occupancy(view(spark, sf_dir, "points"), 200.0, 200.0, [1.0, 1.05, 1.25, 2.0, 4.0]).withColumn("empty", F.round("empty", 6))


@query(with_views("grid", "SELECT a.row, a.col, ROUND(AVG(b.n), 4) AS mean FROM grid a JOIN grid b ON abs(a.row - b.row) <= 1 AND abs(a.col - b.col) <= 1 GROUP BY a.row, a.col"))
def box_mean(spark, sf_dir):
    return raster.box_mean(view(spark, sf_dir, "grid"), "n").withColumn("mean", F.round("mean", 4))


@query(with_views("grid", ", f AS (SELECT r AS row, c AS col, COALESCE(v, 0) AS v FROM (SELECT unnest(range(60)) AS r), (SELECT unnest(range(60)) AS c) LEFT JOIN grid ON row = r AND col = c) SELECT a.row, a.col, MAX(b.v) AS stat FROM f a JOIN f b ON abs(a.row - b.row) <= 2 AND abs(a.col - b.col) <= 2 GROUP BY a.row, a.col"))
def slide_max(spark, sf_dir):
    every = spark.range(60).withColumnRenamed("id", "row").crossJoin(spark.range(60).withColumnRenamed("id", "col"))
    full = every.join(view(spark, sf_dir, "grid"), ["row", "col"], "left").select("row", "col", F.coalesce("v", F.lit(0.0)).alias("v"))
    return raster.window_extreme(full, "v", 2)


@query(with_views("mask", "SELECT DISTINCT m.row + r.i AS row, m.col + c.i AS col FROM mask m, (SELECT unnest([-1, 0, 1]) AS i) r, (SELECT unnest([-1, 0, 1]) AS i) c"))
def dilate(spark, sf_dir):
    return raster.dilate(view(spark, sf_dir, "mask"))


@query(with_views("mask", "SELECT a.row, a.col FROM mask a JOIN mask b ON abs(a.row - b.row) <= 1 AND abs(a.col - b.col) <= 1 GROUP BY a.row, a.col HAVING COUNT(*) = 9"))
def erode(spark, sf_dir):
    return raster.erode(view(spark, sf_dir, "mask"))


@query(with_views("grid", """
SELECT row, col, CASE WHEN spike THEN (l[4] + l[5]) / 2 ELSE v END AS v, spike FROM (
  SELECT row, col, v, l, coalesce(len(l) = 8 AND (v > l[8] + 1 OR v < l[1] - 1), false) AS spike FROM (
    SELECT a.row, a.col, a.v, list_sort(list(b.v) FILTER (b.row <> a.row OR b.col <> a.col)) AS l FROM grid a JOIN grid b ON abs(a.row - b.row) <= 1 AND abs(a.col - b.col) <= 1 GROUP BY a.row, a.col, a.v))"""))
def despike(spark, sf_dir):
    return raster.despike(view(spark, sf_dir, "grid"), "v").withColumn("spike", F.coalesce("spike", F.lit(False)))




@query(with_views("grid", ", w AS (SELECT r AS row, c AS col FROM (SELECT unnest(range(60)) AS r), (SELECT unnest(range(60)) AS c)), h0 AS (SELECT row, col, v FROM grid)" + "".join(
    f", h{k} AS (SELECT row, col, v FROM h{k - 1} UNION ALL SELECT w.row, w.col, CASE WHEN MAX(h.v) - MIN(h.v) > 2 THEN MIN(h.v) ELSE quantile_cont(h.v, 0.5) END AS v FROM w JOIN h{k - 1} h ON abs(w.row - h.row) <= 1 AND abs(w.col - h.col) <= 1 WHERE NOT EXISTS (SELECT 1 FROM h{k - 1} o WHERE o.row = w.row AND o.col = w.col) GROUP BY w.row, w.col)"
    for k in (1, 2, 3)) + " SELECT row, col, v FROM h3"))
def void_fill(spark, sf_dir):
    every = spark.range(60).withColumnRenamed("id", "row").crossJoin(spark.range(60).withColumnRenamed("id", "col"))
    return raster.fill_voids(view(spark, sf_dir, "grid"), "v", every, rounds=3).select("row", "col", "v")


@query(with_views("mask", """, reach AS (
  SELECT row, col, row * 60 + col AS label FROM mask UNION
  SELECT m.row, m.col, r.label FROM reach r JOIN mask m ON abs(m.row - r.row) + abs(m.col - r.col) = 1 WHERE r.label < m.row * 60 + m.col)
SELECT row, col, MIN(label)::BIGINT AS label FROM reach GROUP BY row, col"""))
def components(spark, sf_dir):
    return raster.label(view(spark, sf_dir, "mask"), 60)


@query(with_views("points", "SELECT part, l[floor(len(l) * 0.1)::INT + 1] AS low_tenth, l[floor(len(l) * 0.5)::INT + 1] AS middle, len(l)::BIGINT AS n FROM (SELECT part, list_sort(list(z)) AS l FROM points GROUP BY part)"))
def water_level(spark, sf_dir):
    return raster.water_level(view(spark, sf_dir, "points"), "part", "z")


@query(with_views("points footprints", "SELECT id, l[floor((len(l) - 1) * 0.25)::INT + 1] AS level FROM (SELECT f.id, list_sort(list(z)) AS l FROM points p JOIN footprints f ON x BETWEEN x0 AND x1 AND y BETWEEN y0 AND y1 GROUP BY f.id)"))
def zonal_stats(spark, sf_dir):
    inside = spatial.points_in_boxes(view(spark, sf_dir, "points"), view(spark, sf_dir, "footprints").select("id", "x0", "y0", "x1", "y1"), 16.0)
    return raster.zonal_order(inside, "id", "z", 0.25)


@query(with_views("cells", ", g AS (SELECT row, col, COUNT(*) AS n, COUNT(*) FILTER (plant) AS v FROM cells GROUP BY row, col) SELECT a.row, a.col, SUM(b.v)::BIGINT AS v, SUM(b.n)::BIGINT AS n FROM g a JOIN g b ON abs(a.row - b.row) <= 2 AND abs(a.col - b.col) <= 2 GROUP BY a.row, a.col HAVING SUM(b.v) >= 0.3 * SUM(b.n)"))
def canopy_mask(spark, sf_dir):
    return raster.canopy(raster.surface_layers(view(spark, sf_dir, "points")).select("row", "col", "n_vegetation", "n_returns"))


@query(with_views("grid", ", f AS (SELECT r AS row, c AS col, COALESCE(v, 0) AS v FROM (SELECT unnest(range(60)) AS r), (SELECT unnest(range(60)) AS c) LEFT JOIN grid ON row = r AND col = c), m AS (SELECT row, col, CASE WHEN col IN (0, 59) THEN v ELSE list_sort([LAG(v) OVER w, v, LEAD(v) OVER w])[2] END AS m FROM f WINDOW w AS (PARTITION BY row ORDER BY col)) SELECT row, col, CASE WHEN row IN (0, 59) THEN m ELSE list_sort([LAG(m) OVER w, m, LEAD(m) OVER w])[2] END AS median FROM m WINDOW w AS (PARTITION BY col ORDER BY row)"))
def straighten(spark, sf_dir):
    every = spark.range(60).withColumnRenamed("id", "row").crossJoin(spark.range(60).withColumnRenamed("id", "col"))
    full = every.join(view(spark, sf_dir, "grid"), ["row", "col"], "left").select("row", "col", F.coalesce("v", F.lit(0.0)).alias("v"))
    return raster.median_of_three(full, "v").select("row", "col", "median")


@query(with_views("grid points", "SELECT p.x, p.y, ROUND(CASE WHEN tx >= ty THEN a.v + (b.v - a.v) * tx + (d.v - b.v) * ty ELSE a.v + (d.v - c.v) * tx + (c.v - a.v) * ty END, 6) AS h FROM (SELECT DISTINCT x, y, floor(x)::BIGINT AS col, floor(y)::BIGINT AS row, x - floor(x) AS tx, y - floor(y) AS ty FROM points) p JOIN grid a ON a.row = p.row AND a.col = p.col JOIN grid b ON b.row = p.row AND b.col = p.col + 1 JOIN grid c ON c.row = p.row + 1 AND c.col = p.col JOIN grid d ON d.row = p.row + 1 AND d.col = p.col + 1"))
def height_sample(spark, sf_dir):
    grid = view(spark, sf_dir, "grid")
    corners = raster.triangles(grid, "v").where("half = 0").select("row", "col", F.col("corners")[0]["z"].alias("v00"), F.col("corners")[1]["z"].alias("v10"), F.col("corners")[2]["z"].alias("v11"))
    fourth = grid.select((F.col("row") - 1).alias("row"), "col", F.col("v").alias("v01"))
    at = view(spark, sf_dir, "points").select("x", "y").distinct().withColumns({"row": F.floor("y").cast("bigint"), "col": F.floor("x").cast("bigint")})
    found = at.join(corners, ["row", "col"]).join(fourth, ["row", "col"])
    h = triangle_height(*(F.col(c) for c in ("v00", "v10", "v01", "v11")), F.col("x") - F.floor("x"), F.col("y") - F.floor("y"))
    return found.select("x", "y", F.round(h, 6).alias("h"))


@query(with_views("grid", "SELECT COUNT(*)::BIGINT AS triangles, ROUND(SUM(z), 4) AS z FROM (SELECT unnest([a.v + b.v + d.v, a.v + d.v + c.v]) AS z FROM grid a JOIN grid b ON b.row = a.row AND b.col = a.col + 1 JOIN grid c ON c.row = a.row + 1 AND c.col = a.col JOIN grid d ON d.row = a.row + 1 AND d.col = a.col + 1)"))
def surface_mesh(spark, sf_dir):
    z = F.expr("aggregate(corners, 0D, (a, p) -> a + p.z)")
    return raster.triangles(view(spark, sf_dir, "grid"), "v").agg(F.count("*").alias("triangles"), F.round(F.sum(z), 4).alias("z"))


_CLAIMS = ", c AS (SELECT r::BIGINT AS row, k::BIGINT AS col, id AS owner, id % 5 AS priority FROM (SELECT id, unnest(range(y0::BIGINT, y1::BIGINT)) AS r, x0, x1 FROM footprints), LATERAL (SELECT unnest(range(x0::BIGINT, x1::BIGINT)) AS k))"


@query(with_views("footprints", _CLAIMS + " SELECT row, col, arg_min(owner, priority * 1000000000 + owner) AS owner FROM c GROUP BY row, col"))
def land_priority(spark, sf_dir):
    side = lambda lo, hi: F.explode(F.sequence(F.col(lo).cast("bigint"), F.col(hi).cast("bigint") - 1))
    claims = view(spark, sf_dir, "footprints").select(F.col("id").alias("owner"), (F.col("id") % 5).alias("priority"), "x0", "x1", side("y0", "y1").alias("row")).withColumn("col", side("x0", "x1"))
    return edits.owned_cells(claims, "priority", "owner").select("row", "col", "owner")


@query(with_views("cells", "SELECT row, col, COUNT(*) AS n_returns, MAX(z) AS top FROM cells GROUP BY row, col"))
def stream_surface(spark, sf_dir):
    return streaming.replayed(view(spark, sf_dir, "points"))


@query(with_views("grid", """, p AS (SELECT id, greatest(0, least(59, x)) AS x, greatest(0, least(59, y)) AS y FROM (SELECT c_custkey AS id, (c_custkey * 37 % 640)::DOUBLE / 10 - 2 AS x, (c_custkey * 53 % 640)::DOUBLE / 10 - 2 AS y FROM customer)),
k AS (SELECT id, CAST(floor(y) AS BIGINT) + dr AS row, CAST(floor(x) AS BIGINT) + dc AS col, abs(1 - dr - (y - floor(y))) * abs(1 - dc - (x - floor(x))) AS w FROM p, (SELECT unnest([0, 0, 1, 1]) AS dr, unnest([0, 1, 0, 1]) AS dc))
SELECT id, round(CASE WHEN COUNT(v) = COUNT(*) THEN SUM(w * v) END, 6) AS v FROM k LEFT JOIN grid USING (row, col) WHERE w > 0 GROUP BY id"""))
def bilinear_samples(spark, sf_dir):
    at = lambda by, name: ((F.col("c_custkey") * by % 640).cast("double") / 10 - 2).alias(name)
    points = view(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), at(37, "x"), at(53, "y"))
    return raster.bilinear_samples(view(spark, sf_dir, "grid"), points, 60, 60).select("id", F.round("v", 6).alias("v"))
