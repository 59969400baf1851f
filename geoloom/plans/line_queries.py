"""Queries over lines, tracks, networks and edits."""

from __future__ import annotations

from pyspark.sql import functions as F

from geoloom.functions import codecs
from geoloom.operators import edits, graph, lines
from geoloom.plans.catalogue import query
from geoloom.plans.views import view, with_views

_STEP = "coalesce(sqrt(pow(x - px, 2) + pow(y - py, 2)), 0)"
_STEPS = f"s AS (SELECT *, {_STEP} AS step FROM (SELECT *, LAG(x) OVER w AS px, LAG(y) OVER w AS py FROM tracks WINDOW w AS (PARTITION BY track ORDER BY seq))), g AS (SELECT *, SUM(step) OVER (PARTITION BY track ORDER BY seq ROWS UNBOUNDED PRECEDING) AS along, SUM(step) OVER (PARTITION BY track) AS total FROM s)"


@query(with_views("tracks", f", {_STEPS} SELECT track, seq, round(along, 4) AS along, round(along / total, 9) AS at FROM g"))
def track_length(spark, sf_dir):
    at = lines.shares(view(spark, sf_dir, "tracks"), "track")
    return at.select("track", "seq", F.round("along", 4).alias("along"), F.round("at", 9).alias("at"))


@query(with_views("tracks", f", {_STEPS}, h AS (SELECT *, along / total AS pos, (along - step) / total AS prior FROM g) SELECT track, seq, round(px + (x - px) * a, 4) AS x0, round(py + (y - py) * a, 4) AS y0, round(px + (x - px) * b, 4) AS x1, round(py + (y - py) * b, 4) AS y1 FROM (SELECT *, (greatest(0.25, prior) - prior) / (pos - prior) AS a, (least(0.75, pos) - prior) / (pos - prior) AS b FROM h WHERE px IS NOT NULL AND pos > prior AND pos > 0.25 AND prior < 0.75)"))
def slice_line(spark, sf_dir):
    part = lines.sliced(view(spark, sf_dir, "tracks"), "track", F.lit(0.25), F.lit(0.75))
    return part.select("track", "seq", *(F.round(c, 4).alias(c) for c in ("x0", "y0", "x1", "y1")))


_RULED = """r AS (SELECT id, place, kind, value, CASE WHEN a IS NOT NULL AND b > a THEN greatest(a, 0) ELSE 0 END AS a, CASE WHEN a IS NOT NULL AND b > a THEN least(b, 1) ELSE 1 END AS b FROM rules),
c AS (SELECT DISTINCT id, t FROM (SELECT id, 0.0::DOUBLE AS t FROM segments UNION ALL SELECT id, 1.0 FROM segments UNION ALL SELECT r.id, a FROM r JOIN segments USING (id) UNION ALL SELECT r.id, b FROM r JOIN segments USING (id))),
p AS (SELECT id, t AS t0, LEAD(t) OVER (PARTITION BY id ORDER BY t) AS t1 FROM c), q AS (SELECT p.*, class, (t0 + t1) / 2 AS mid FROM p JOIN segments USING (id) WHERE t1 IS NOT NULL)"""


@query(with_views("segments rules", f""", {_RULED} SELECT q.id, q.class, t0, t1, coalesce(CASE WHEN w > 0 THEN w END, CASE q.class WHEN 'motorway' THEN 14 WHEN 'primary' THEN 11 WHEN 'footway' THEN 2 ELSE 5 END)::DOUBLE AS width_m, coalesce(l, 0)::BIGINT AS level, coalesce(f, 0)::BIGINT AS flag_sum FROM q LEFT JOIN (
  SELECT id, t0, arg_min(value, (place, a, b, value)) FILTER (kind = 'width') AS w, arg_min(value, (place, a, b, value)) FILTER (kind = 'level') AS l, SUM(DISTINCT value::BIGINT) FILTER (kind = 'flag') AS f
  FROM (SELECT id, t0, mid, unnest(held, recursive := true) FROM (SELECT q.id, t0, mid, held FROM q JOIN (SELECT id, list(struct_pack(place := place, kind := kind, value := value, a := a, b := b)) AS held FROM r GROUP BY id) h ON h.id = q.id)) WHERE a <= mid AND mid <= b GROUP BY id, t0) USING (id, t0)"""))
def rule_split(spark, sf_dir):
    pieces = lines.split_by_rules(view(spark, sf_dir, "segments"), view(spark, sf_dir, "rules"))
    return pieces.select("id", "class", "t0", "t1", "width_m", "level", F.expr("aggregate(flags, 0L, (a, v) -> a + v)").alias("flag_sum"))


@query(with_views("tracks", """, m AS (SELECT * FROM (SELECT *, LAG(x) OVER w AS px, LAG(y) OVER w AS py FROM tracks WHERE NOT (x = 0 AND y = 0) WINDOW w AS (PARTITION BY track ORDER BY seq)) WHERE px IS NULL OR px <> x OR py <> y)
SELECT track, piece, COUNT(*) AS n, MIN(seq) AS first FROM (SELECT track, seq, SUM(CASE WHEN sqrt(pow(x - px, 2) + pow(y - py, 2)) > 500 THEN 1 ELSE 0 END) OVER (PARTITION BY track ORDER BY seq ROWS UNBOUNDED PRECEDING)::BIGINT AS piece FROM m) GROUP BY track, piece"""))
def track_pieces(spark, sf_dir):
    pieces = lines.sessions(view(spark, sf_dir, "tracks"), "track", lines.flat_step(), lines.TRACK_JOIN_M)
    return pieces.groupBy("track", "piece").agg(F.count("*").alias("n"), F.min("seq").alias("first"))


@query(with_views("tracks", f", {_STEPS} SELECT track, seq::DOUBLE AS seq, round(x, 4) AS x, round(y, 4) AS y FROM g WHERE along >= 1500 UNION ALL SELECT track, seq - 0.5::DOUBLE, round(px + (x - px) * t, 4), round(py + (y - py) * t, 4) FROM (SELECT *, (1500 - (along - step)) / step AS t FROM g WHERE along >= 1500 AND along - step < 1500 AND px IS NOT NULL AND step > 0) WHERE t < 1"))
def track_trim(spark, sf_dir):
    cut = lines.trimmed(view(spark, sf_dir, "tracks"), "track", lines.flat_step(), 1500.0)
    return cut.select("track", "seq", F.round("x", 4).alias("x"), F.round("y", 4).alias("y"))


@query(with_views("tracks", f", {_STEPS}, k AS (SELECT unnest(range(500)) AS k) SELECT track, round(AVG(CASE WHEN px + (x - px) * t BETWEEN 200 AND 800 AND py + (y - py) * t BETWEEN 100 AND 600 THEN 0 ELSE 1 END), 6) AS outside FROM (SELECT *, ((k + 0.5) / 500 * total - (along - step)) / step AS t FROM g, k WHERE step > 0 AND total > 0 AND (k + 0.5) / 500 * total >= along - step AND (k + 0.5) / 500 * total < along) GROUP BY track"))
def share_outside(spark, sf_dir):
    return lines.share_outside(view(spark, sf_dir, "tracks"), "track", (200, 100, 800, 600), 500).withColumn("outside", F.round("outside", 6))


@query(with_views("ends", """, p AS (SELECT a.seam, a.kind, a.id AS a, b.id AS b, abs(a.along - b.along) AS gap, (a.along + b.along) / 2 AS along FROM ends a JOIN ends b ON a.seam = b.seam AND a.kind = b.kind AND a.side < 0 AND b.side > 0 AND abs(a.along - b.along) <= 20)
SELECT seam, kind, a, b, round(gap, 6) AS gap, round(along, 6) AS along FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY a ORDER BY gap, b) AS na, ROW_NUMBER() OVER (PARTITION BY b ORDER BY gap, a) AS nb FROM p) WHERE na = 1 AND nb = 1"""))
def seam_join(spark, sf_dir):
    ends = view(spark, sf_dir, "ends").withColumnRenamed("id", "end")
    return lines.seam_pairs(ends, 20.0).select("seam", "kind", "a", "b", F.round("gap", 6).alias("gap"), F.round("along", 6).alias("along"))


@query(with_views("tracks", f""", {_STEPS} SELECT track, seq, k, n, round(CASE WHEN px IS NULL THEN x ELSE px + (x - px) * k / n END, 6) AS x, round(CASE WHEN py IS NULL THEN y ELSE py + (y - py) * k / n END, 6) AS y
FROM (SELECT *, unnest(range(1, n + 1)) AS k FROM (SELECT *, greatest(1, ceil(step / 150))::BIGINT AS n FROM g))"""))
def densify_line(spark, sf_dir):
    return lines.densified(view(spark, sf_dir, "tracks"), "track", 150.0).select("track", "seq", "k", "n", F.round("x", 6).alias("x"), F.round("y", 6).alias("y"))


@query(with_views("tracks", f""", {_STEPS}, h AS (SELECT *, LAG(along) OVER (PARTITION BY track ORDER BY seq) AS prior FROM g), n AS (SELECT track, MAX(along) AS total, greatest(1, ceil(MAX(along) / 100))::BIGINT AS n FROM g GROUP BY track HAVING MAX(along) > 0), k AS (SELECT *, CASE WHEN k = n THEN total ELSE total * k / n END AS s FROM (SELECT *, unnest(range(n + 1)) AS k FROM n))
SELECT k.track, k, round(s, 4) AS s, round(px + (x - px) * (s - prior) / (h.along - prior), 3) AS x, round(py + (y - py) * (s - prior) / (h.along - prior), 3) AS y FROM k JOIN (SELECT k.track AS t, k.k AS kk, MIN(h.along) AS along FROM k JOIN h ON h.track = k.track AND h.along >= k.s AND h.along > h.prior GROUP BY ALL) f ON f.t = k.track AND f.kk = k.k JOIN h ON h.track = k.track AND h.along = f.along AND h.along > h.prior"""))
def track_samples(spark, sf_dir):
    return lines.samples_along(view(spark, sf_dir, "tracks"), "track", 100.0).select("track", "k", F.round("s", 4).alias("s"), F.round("x", 3).alias("x"), F.round("y", 3).alias("y"))


@query(with_views("lines", """, m AS (SELECT (ax + bx) / 2 AS x, (ay + by_) / 2 AS y, sqrt(pow(bx - ax, 2) + pow(by_ - ay, 2)) AS len FROM lines), o AS (SELECT *, pow(bx - ax, 2) + pow(by_ - ay, 2) AS l2 FROM lines WHERE rank <= 1)
SELECT round(coalesce(SUM(len) FILTER (EXISTS (SELECT 1 FROM o WHERE m.x BETWEEN ax - 4 AND bx + 4 AND m.y BETWEEN ay - 4 AND by_ + 4 AND sqrt(pow(m.x - ax - greatest(0, least(1, ((m.x - ax) * (bx - ax) + (m.y - ay) * (by_ - ay)) / l2)) * (bx - ax), 2) + pow(m.y - ay - greatest(0, least(1, ((m.x - ax) * (bx - ax) + (m.y - ay) * (by_ - ay)) / l2)) * (by_ - ay), 2)) <= 4)) / SUM(len), 0), 9) AS covered FROM m"""))
def line_coverage(spark, sf_dir):
    own = view(spark, sf_dir, "lines").withColumnRenamed("by_", "by")
    return lines.coverage(own, own.where("rank <= 1"), 4.0).select(F.round("covered", 9).alias("covered"))


@query("SELECT l_suppkey AS model, MIN(l_partkey) AS least_x, MIN(l_quantity) AS least_y, MIN(l_tax) AS least_z, MAX(l_partkey) AS most_x, MAX(l_quantity) AS most_y, MAX(l_tax) AS most_z FROM lineitem GROUP BY 1")
def part_bounds(spark, sf_dir):
    corners = view(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("model"), F.col("l_partkey").alias("x"), F.col("l_quantity").alias("y"), F.col("l_tax").alias("z"))
    return edits.part_bounds(corners, "model")


@query("""SELECT area, survey, ROW_NUMBER() OVER (PARTITION BY area ORDER BY CASE WHEN place = won THEN 0 ELSE 1 END, place) AS place FROM (SELECT *, MIN(CASE WHEN survey % 5 = 2 THEN place END) OVER (PARTITION BY area) AS won FROM (SELECT s_nationkey AS area, s_suppkey AS survey, ROW_NUMBER() OVER (PARTITION BY s_nationkey ORDER BY s_acctbal DESC, s_suppkey) AS place FROM supplier))""")
def chosen_first(spark, sf_dir):
    own = spark.sql("SELECT s_nationkey AS area, s_suppkey AS survey, CAST(ROW_NUMBER() OVER (PARTITION BY s_nationkey ORDER BY s_acctbal DESC, s_suppkey) AS BIGINT) AS place FROM {s}", s=view(spark, sf_dir, "supplier"))
    return edits.chosen_first(own, "area", F.col("survey") % 5 == 2).select("area", "survey", "place")


_NEAR = "(SELECT part, MIN(x) AS x, MIN(y) AS y FROM points GROUP BY part)"


@query(with_views("points lines", f""", d AS (SELECT p.part AS point, l.id AS segment, greatest(0, least(1, ((p.x - ax) * (bx - ax) + (p.y - ay) * (by_ - ay)) / (pow(bx - ax, 2) + pow(by_ - ay, 2)))) AS t, p.x, p.y, ax, ay, bx, by_ FROM {_NEAR} p, lines l),
e AS (SELECT point, segment, t, sqrt(pow(x - ax - t * (bx - ax), 2) + pow(y - ay - t * (by_ - ay), 2)) AS distance FROM d)
SELECT point, segment, round(distance, 6) AS distance, round(t, 6) AS t, rank FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY point ORDER BY distance, segment) AS rank FROM e WHERE distance <= 12) WHERE rank <= 8"""))
def nearest_k(spark, sf_dir):
    points = view(spark, sf_dir, "points").groupBy(F.col("part").alias("point")).agg(F.min("x").alias("x"), F.min("y").alias("y"))
    segments = view(spark, sf_dir, "lines").select(F.col("id").alias("segment"), "ax", "ay", "bx", F.col("by_").alias("by"))
    return lines.nearest_segments(points, segments, 12.0).withColumns({"distance": F.round("distance", 6), "t": F.round("t", 6)})


@query(with_views("lines", """, s AS (SELECT id, rank, ax, ay, bx, by_, k, n, ax + (bx - ax) * k / n AS x, ay + (by_ - ay) * k / n AS y, sqrt(pow(bx - ax, 2) + pow(by_ - ay, 2)) AS len FROM (SELECT *, 6 AS n FROM lines), (SELECT unnest(range(7)) AS k)),
o AS (SELECT *, sqrt(pow(bx - ax, 2) + pow(by_ - ay, 2)) AS len FROM lines),
h AS (SELECT DISTINCT s.id, s.k FROM s JOIN o ON o.rank < s.rank AND s.x BETWEEN o.ax - 3 AND o.bx + 3 AND s.y BETWEEN o.ay - 3 AND o.by_ + 3 AND abs((s.bx - s.ax) * (o.bx - o.ax) + (s.by_ - s.ay) * (o.by_ - o.ay)) / (s.len * o.len) >= cos(radians(28)) AND pow(s.x - o.ax - greatest(0, least(1, ((s.x - o.ax) * (o.bx - o.ax) + (s.y - o.ay) * (o.by_ - o.ay)) / (o.len * o.len))) * (o.bx - o.ax), 2) + pow(s.y - o.ay - greatest(0, least(1, ((s.x - o.ax) * (o.bx - o.ax) + (s.y - o.ay) * (o.by_ - o.ay)) / (o.len * o.len))) * (o.by_ - o.ay), 2) <= 9)
SELECT s.id, COUNT(*) AS samples, round(COUNT(h.k) / COUNT(*), 6) AS shadowed FROM s LEFT JOIN h ON h.id = s.id AND h.k = s.k GROUP BY s.id"""))
def line_shadow_share(spark, sf_dir):
    own = view(spark, sf_dir, "lines").withColumnRenamed("by_", "by")
    return graph.shadowed_share(own, 3.0, 2.0).withColumn("shadowed", F.round("shadowed", 6))


@query()
def culled_lines(spark, sf_dir):
    # squares side by side, so that the extent grows with the table and not the density
    east = F.floor(F.col("id") / 8000) * 3000
    own = view(spark, sf_dir, "lines").withColumnRenamed("by_", "by")
    return graph.culled(own.withColumns({"ax": F.col("ax") + east, "bx": F.col("bx") + east}), 3.0, 2.0)


@query(with_views("tracks", f""", v AS (SELECT track, seq, floor(x / 20) * 20 AS x, floor(y / 20) * 20 AS y FROM tracks), b AS (SELECT *, LAG(x) OVER w AS px, LAG(y) OVER w AS py FROM v WINDOW w AS (PARTITION BY track ORDER BY seq)), g AS (SELECT *, SUM({_STEP}) OVER (PARTITION BY track ORDER BY seq ROWS UNBOUNDED PRECEDING) AS along FROM b),
p AS (SELECT track, seq, x, y, along / MAX(along) OVER (PARTITION BY track) AS pos, COUNT(*) OVER (PARTITION BY track) AS n, ROW_NUMBER() OVER (PARTITION BY track ORDER BY seq) AS i FROM g),
i AS (SELECT * FROM p WHERE i > 1 AND i < n AND EXISTS (SELECT 1 FROM v WHERE v.track <> p.track AND abs(v.x - p.x) <= 20 AND abs(v.y - p.y) <= 20)),
r AS (SELECT track, pos, SUM(new) OVER (PARTITION BY track ORDER BY pos ROWS UNBOUNDED PRECEDING) AS run FROM (SELECT track, pos, CASE WHEN pos - LAG(pos) OVER (PARTITION BY track ORDER BY pos) >= 0.01 THEN 1 ELSE 0 END AS new FROM i))
SELECT track, round(AVG(pos), 6) AS "at" FROM r GROUP BY track, run HAVING AVG(pos) > 0.01 AND AVG(pos) < 0.99"""))
def vertex_junctions(spark, sf_dir):
    at = lambda c: (F.floor(F.col(c) / 20) * 20).cast("double").alias(c)
    own = view(spark, sf_dir, "tracks").select("track", "seq", at("x"), at("y"))
    return lines.junctions(own, "track", 20.0, 0.01).withColumn("at", F.round("at", 6))


_JOINED = """m AS (SELECT *, CASE WHEN a > MAX(b) OVER (PARTITION BY key ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 1e-9 THEN 1 ELSE 0 END AS new FROM {t}),
j AS (SELECT key, MIN(a) AS a, MAX(b) AS b FROM (SELECT *, SUM(new) OVER (PARTITION BY key ORDER BY a, b ROWS UNBOUNDED PRECEDING) AS run FROM m) GROUP BY key, run)"""


@query(with_views("intervals", f", {_JOINED.format(t='intervals')} SELECT key, a, b FROM j"))
def interval_union(spark, sf_dir):
    return lines.joined_intervals(view(spark, sf_dir, "intervals"), "key")


_BARS = "(SELECT key, k / 8.0::DOUBLE + 0.01::DOUBLE AS a, k / 8.0::DOUBLE + 0.06::DOUBLE AS b FROM (SELECT DISTINCT key FROM intervals), (SELECT unnest(range(8)) AS k))"


@query(with_views("intervals", f""", {_JOINED.format(t='intervals')}, g AS (SELECT * FROM {_BARS}), e AS (SELECT key, a, b, unnest(list_prepend(a, l)) AS lo, unnest(list_append(k, b)) AS hi FROM (SELECT j.key, j.a, j.b, coalesce(list(g.b ORDER BY g.a) FILTER (g.a IS NOT NULL), []) AS l, coalesce(list(g.a ORDER BY g.a) FILTER (g.a IS NOT NULL), []) AS k FROM j LEFT JOIN g ON g.key = j.key AND g.b > j.a AND g.a < j.b GROUP BY j.key, j.a, j.b))
SELECT key, round(lo, 9) AS a, round(hi, 9) AS b FROM e WHERE hi - lo > 1e-9"""))
def interval_minus(spark, sf_dir):
    own = lines.joined_intervals(view(spark, sf_dir, "intervals"), "key")
    bars = own.select("key").distinct().crossJoin(spark.range(8)).select("key", (F.col("id") / 8.0 + 0.01).alias("a"), (F.col("id") / 8.0 + 0.06).alias("b"))
    return lines.less_intervals(own, bars, "key").select("key", F.round("a", 9).alias("a"), F.round("b", 9).alias("b"))


_EDITS = "SELECT l_orderkey AS id, CAST(l_partkey % 8 AS DOUBLE) / 16 AS lo, CAST(l_partkey % 8 + 2 + l_linenumber AS DOUBLE) / 16 AS hi, CASE WHEN l_returnflag = 'A' THEN l_quantity END AS width, CASE WHEN l_returnflag <> 'A' THEN l_suppkey END AS colour FROM lineitem"


@query(f"""WITH e AS (SELECT id, lo, hi, MAX(width) AS width, MAX(colour) AS colour FROM ({_EDITS}) GROUP BY id, lo, hi), p AS (SELECT o_orderkey AS id, k / 8.0::DOUBLE AS t0, (k + 1) / 8.0::DOUBLE AS t1 FROM orders, (SELECT unnest(range(8)) AS k))
SELECT p.id, t0, t1, arg_min(width, (hi - lo, -lo)) FILTER (width IS NOT NULL) AS width, arg_min(colour, (hi - lo, -lo)) FILTER (colour IS NOT NULL) AS colour FROM p LEFT JOIN e ON e.id = p.id AND lo <= t0 + 1e-9 AND hi >= t1 - 1e-9 GROUP BY p.id, t0, t1""")
def edit_override(spark, sf_dir):
    told = spark.sql(_EDITS.replace("FROM lineitem", "FROM {lineitem}"), lineitem=view(spark, sf_dir, "lineitem")).groupBy("id", "lo", "hi").agg(F.max("width").alias("width"), F.max("colour").alias("colour"))
    eighth = F.explode(F.sequence(F.lit(0), F.lit(7)))
    pieces = view(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), eighth.alias("k")).select("id", (F.col("k") / 8.0).alias("t0"), ((F.col("k") + 1) / 8.0).alias("t1"))
    return edits.overriding(pieces, told, ["width", "colour"])


@query("""SELECT coalesce(a.c_custkey, b.key) AS key, coalesce(b.v, a.v) AS value, CASE WHEN b.v IS NULL THEN 'kept' WHEN a.v IS NULL THEN 'added' WHEN a.v = b.v THEN 'same' ELSE 'replaced' END AS change
FROM (SELECT c_custkey, c_custkey % 7 AS v FROM customer) a FULL JOIN (SELECT o_custkey + 200 AS key, MAX(o_orderkey) % 5 AS v FROM orders GROUP BY 1) b ON a.c_custkey = b.key""")
def edits_merge(spark, sf_dir):
    base = view(spark, sf_dir, "customer").select(F.col("c_custkey").alias("key"), (F.col("c_custkey") % 7).alias("value"))
    extra = view(spark, sf_dir, "orders").groupBy((F.col("o_custkey") + 200).alias("key")).agg((F.max("o_orderkey") % 5).alias("value"))
    return edits.merged(base, extra)


@query("SELECT cache, key FROM (SELECT o_custkey % 20 AS cache, o_orderkey AS key, SUM(o_orderkey % 100 + 1) OVER (PARTITION BY o_custkey % 20) - coalesce(SUM(o_orderkey % 100 + 1) OVER (PARTITION BY o_custkey % 20 ORDER BY o_orderdate, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS remaining FROM orders) WHERE remaining > 5000")
def lru_evict(spark, sf_dir):
    entries = view(spark, sf_dir, "orders").select((F.col("o_custkey") % 20).alias("cache"), F.col("o_orderkey").alias("key"), (F.col("o_orderkey") % 100 + 1).alias("size"), F.col("o_orderdate").alias("used"))
    return edits.evicted(entries, "cache", 5000).select("cache", "key")


@query("""SELECT id, row, col, round(w * (col - 1) / columns, 6) AS west, round(h - h * row / rows, 6) AS south, round(w * col / columns, 6) AS east, round(h - h * (row - 1) / rows, 6) AS north FROM (
  SELECT *, unnest(range(1, columns + 1)) AS col FROM (SELECT *, unnest(range(1, rows + 1)) AS row FROM (SELECT *, greatest(1, ceil(w / 210 - 1e-9))::BIGINT AS columns, greatest(1, ceil(h / 210 - 1e-9))::BIGINT AS rows FROM (SELECT p_partkey AS id, (p_size * 21)::DOUBLE AS w, p_retailprice::DOUBLE AS h FROM part WHERE p_size > 0))))""")
def section_grid(spark, sf_dir):
    models = view(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.lit(0.0).alias("x0"), F.lit(0.0).alias("y0"), (F.col("p_size") * 21).cast("double").alias("x1"), F.col("p_retailprice").alias("y1"))
    return edits.sections(models).select("id", "row", "col", *(F.round(c, 6).alias(c) for c in ("west", "south", "east", "north")))


@query("SELECT model, colour, ROW_NUMBER() OVER (PARTITION BY model ORDER BY first, colour) AS number FROM (SELECT l_suppkey AS model, l_partkey % 16 AS colour, MIN(l_orderkey * 10 + l_linenumber) AS first FROM lineitem GROUP BY ALL)")
def filament_order(spark, sf_dir):
    parts = view(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("model"), (F.col("l_partkey") % 16).alias("colour"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("at"))
    return edits.numbered_by_first_use(parts, "model", "colour", "at")


@query("""WITH t AS (SELECT l_suppkey AS model, l_orderkey % 40 AS a, l_partkey % 40 AS b, (l_orderkey + l_linenumber) % 40 AS c FROM lineitem),
u AS (SELECT model, least(a, b) AS u, greatest(a, b) AS v FROM t UNION ALL SELECT model, least(b, c), greatest(b, c) FROM t UNION ALL SELECT model, least(c, a), greatest(c, a) FROM t)
SELECT model, COUNT(*) AS edges, COUNT(*) FILTER (n = 1) AS open, COUNT(*) FILTER (n > 2) AS shared FROM (SELECT model, u, v, COUNT(*) AS n FROM u GROUP BY ALL) GROUP BY model""")
def edge_manifold(spark, sf_dir):
    o, p, n = F.col("l_orderkey"), F.col("l_partkey"), F.col("l_linenumber")
    faces = view(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("model"), (o % 40).alias("a"), (p % 40).alias("b"), ((o + n) % 40).alias("c"))
    return edits.edge_report(faces, "model")


@query(with_views("edges", """, b AS (SELECT a, b, MIN(cost) AS cost FROM (SELECT a, b, cost FROM edges UNION ALL SELECT b, a, cost FROM edges) GROUP BY a, b), w AS (SELECT k AS source, k AS node, 0.0::DOUBLE AS cost, 0 AS hops FROM (SELECT unnest([1, 50, 120]::BIGINT[]) AS k)
  UNION SELECT w.source, b.b, w.cost + b.cost, hops + 1 FROM w JOIN b ON b.a = w.node WHERE hops < 4) SELECT source, node, MIN(cost) AS cost FROM w GROUP BY source, node"""))
def bounded_route(spark, sf_dir):
    sources = spark.createDataFrame([(1,), (50,), (120,)], "node bigint")
    return graph.routes_within(view(spark, sf_dir, "edges"), sources, 4)


@query(with_views("links", ", u AS (SELECT a, b FROM links UNION SELECT b, a FROM links), r AS (SELECT a AS node, a AS root FROM u UNION SELECT u.b, r.root FROM r JOIN u ON u.a = r.node WHERE r.root < u.b) SELECT node, MIN(root) AS root FROM r GROUP BY node"))
def graph_components(spark, sf_dir):
    return graph.components(view(spark, sf_dir, "links"))


@query()
def prune_stubs(spark, sf_dir):
    edges = view(spark, sf_dir, "edges").where("a <> b").withColumnRenamed("cost", "length")
    return graph.pruned(edges, 8.0).select("id", "a", "b")


@query()
def weld_lines(spark, sf_dir):
    edges = view(spark, sf_dir, "edges").where("a <> b").select("id", (F.col("id") % 7).alias("kind"), "a", "b")
    return graph.welded(edges)


@query()
def simplify_line(spark, sf_dir):
    return graph.simplified(view(spark, sf_dir, "tracks"), "track", 80.0)


@query()
def plotting_order(spark, sf_dir):
    own = view(spark, sf_dir, "lines").select(F.floor(F.col("id") / 500).alias("sheet"), "id", F.col("ax").alias("x0"), F.col("ay").alias("y0"), F.col("bx").alias("x1"), F.col("by_").alias("y1"))
    return graph.plotting_order(own, "sheet")


@query()
def polyline_codec(spark, sf_dir):
    points = F.sort_array(F.collect_list(F.struct("seq", (F.col("x") / 100).alias("x"), (F.col("y") / 100).alias("y"))))
    tracks = view(spark, sf_dir, "tracks").groupBy("track").agg(F.transform(points, lambda p: F.struct(p["x"].alias("x"), p["y"].alias("y"))).alias("p"))
    coded = tracks.select("track", codecs.encode_polyline("p").alias("text"))
    return coded.select("track", "text", F.size(codecs.decode_polyline("text")).cast("bigint").alias("n"))


@query()
def snap_tracks(spark, sf_dir):
    places = view(spark, sf_dir, "tracks").withColumn("x", F.col("x") % 500).withColumn("y", F.col("y") % 500)
    step = lines.measured(places, "track", lines.flat_step()).select("track", "seq", (F.round(F.col("x") / 10) * 10 + F.col("seq") % 7).alias("x"), F.col("y"))
    streets = spark.range(0, 2 * 6 * 5).select(F.col("id").alias("edge"), (F.col("id") % 2).alias("d"), (F.floor(F.col("id") / 2) % 6 * 100).cast("double").alias("lane"), (F.floor(F.col("id") / 12) * 100).cast("double").alias("at"))
    node = lambda x, y: (x * 10 + y).cast("bigint")
    segments = streets.select("edge", *(F.when(F.col("d") == 0, F.col(p)).otherwise(F.col(q)).alias(c) for c, p, q in (("ax", "at", "lane"), ("ay", "lane", "at"))), F.when(F.col("d") == 0, F.col("at") + 100).otherwise(F.col("lane")).alias("bx"), F.when(F.col("d") == 0, F.col("lane")).otherwise(F.col("at") + 100).alias("by"))
    samples = step.select("track", "seq", "x", "y")
    key = F.col("track") * 10_000_000 + F.col("seq")
    near = lines.nearest_segments(samples.select(key.alias("point"), "x", "y"), segments.withColumnRenamed("edge", "segment"), graph.RADIUS_M)
    candidates = near.select(F.floor(F.col("point") / 10_000_000).alias("track"), (F.col("point") % 10_000_000).alias("seq"), F.col("segment").alias("edge"), "t", "distance")
    roads = segments.select("edge", node(F.col("ax") / 100, F.col("ay") / 100).alias("a"), node(F.col("bx") / 100, F.col("by") / 100).alias("b"), F.lit(100.0).alias("length"))
    return graph.matched(samples, candidates, graph.roads_near(samples, segments, "track").join(roads, "edge"), "track")
