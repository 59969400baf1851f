"""Lines and recorded tracks as ordered vertex rows: lengths, slices, rules along a line, trims, seams, shadows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from geoloom.operators.cells import cell

#: Positions nearer than this are one.
SAME_POSITION = 1e-9
TRACK_JOIN_M, LINE_JOIN_M = 500.0, 1.0
# Metres between kerbs by road class.
ROAD_WIDTH_M = {
    "motorway": 14, "trunk": 12, "primary": 11, "secondary": 9.5, "tertiary": 8, "residential": 6.5, "living_street": 5.5, "unclassified": 6, "service": 4.5, "pedestrian": 4,
    "footway": 2, "sidewalk": 2, "crosswalk": 2.5, "steps": 1.6, "path": 1.5, "track": 3, "cycleway": 2, "bridleway": 2, "driveway": 3, "parking_aisle": 3.5, "alley": 3.5,
    "unknown": 5, "raceway": 14,
}
OTHER_ROAD_WIDTH_M = 5.0


def measured(vertices: DataFrame, line: str, step: Column) -> DataFrame:
    """vertices (line, seq, x, y) with the previous vertex (px, py), step (its length from there) and along (up to here).

    step: the distance from (px, py) to (x, y). A first vertex has null px and a step of 0."""
    order = Window.partitionBy(line).orderBy("seq")
    before = vertices.withColumns({"px": F.lag("x").over(order), "py": F.lag("y").over(order)})
    return before.withColumn("step", F.coalesce(step, F.lit(0.0))).withColumn("along", F.sum("step").over(order.rowsBetween(Window.unboundedPreceding, 0)))


def flat_step() -> Column:
    return F.sqrt((F.col("x") - F.col("px")) ** 2 + (F.col("y") - F.col("py")) ** 2)


def shares(vertices: DataFrame, line: str) -> DataFrame:
    """Each vertex's place along its line, 0 to 1; 0 on a line without length."""
    total = F.max("along").over(Window.partitionBy(line))
    return measured(vertices, line, flat_step()).withColumn("at", F.when(total > 0, F.col("along") / total).otherwise(0.0))


def sliced(vertices: DataFrame, line: str, low: Column, high: Column) -> DataFrame:
    """The part of each line between the shares low and high: the steps that meet it, cut at its ends (x0 y0 x1 y1)."""
    steps = shares(vertices, line).withColumn("before", F.lag("at").over(Window.partitionBy(line).orderBy("seq"))).where("px is not null and at > before")
    part = lambda at: (at - F.col("before")) / (F.col("at") - F.col("before"))
    a, b = part(F.greatest(low, F.col("before"))), part(F.least(high, F.col("at")))
    on = lambda v, t: F.col(f"p{v}") + (F.col(v) - F.col(f"p{v}")) * t
    return steps.where((F.col("at") > low) & (F.col("before") < high)).select(line, "seq", on("x", a).alias("x0"), on("y", a).alias("y0"), on("x", b).alias("x1"), on("y", b).alias("y1"))


def split_by_rules(segments: DataFrame, rules: DataFrame) -> DataFrame:
    """Pieces of segments (id, class) between all ends of their rules, with the width, level and flags that hold there.

    rules: id, place (their order), kind (width, level or flag), value, a, b. Missing ends are 0 and 1, and so are ends out
    of order; others are clamped. At a piece's middle the first width and level that cover it hold, and all flags."""
    good = F.col("a").isNotNull() & F.col("b").isNotNull() & (F.col("b") > F.col("a"))
    scoped = rules.withColumns({"a": F.when(good, F.greatest(F.col("a"), F.lit(0.0))).otherwise(0.0), "b": F.when(good, F.least(F.col("b"), F.lit(1.0))).otherwise(1.0)})
    held = scoped.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("place", "kind", "value", "a", "b"))).alias("rules"))
    joined = segments.join(held, "id", "left")
    none = F.expr("cast(array() as array<struct<place:bigint,kind:string,value:double,a:double,b:double>>)")
    with_rules = joined.withColumn("rules", F.coalesce("rules", none))
    cuts = F.expr("array_sort(array_distinct(concat(array(0D, 1D), transform(rules, r -> r.a), transform(rules, r -> r.b))))")
    apart = F.expr(f"filter(cuts, (v, i) -> i = 0 or v - cuts[i - 1] > {SAME_POSITION})")
    pieces = with_rules.withColumn("cuts", cuts).withColumn("cuts", apart).withColumn("piece", F.explode(F.expr("transform(sequence(0, size(cuts) - 2), i -> struct(i, cuts[i] as t0, cuts[i + 1] as t1))")))
    mid = pieces.select("*", F.col("piece.t0").alias("t0"), F.col("piece.t1").alias("t1"), ((F.col("piece.t0") + F.col("piece.t1")) / 2).alias("mid"))
    covering = F.expr(f"filter(rules, r -> r.a - {SAME_POSITION} <= mid and mid <= r.b + {SAME_POSITION})")
    first = lambda kind: F.expr(f"try_element_at(filter(covering, r -> r.kind = '{kind}'), 1).value")
    from geoloom.operators.features import mapped

    default = F.coalesce(mapped({k: float(v) for k, v in ROAD_WIDTH_M.items()}, F.col("class")), F.lit(OTHER_ROAD_WIDTH_M))
    width = F.coalesce(F.when(first("width") > 0, first("width")), default)
    flags = F.expr("array_sort(array_distinct(transform(filter(covering, r -> r.kind = 'flag'), r -> cast(r.value as bigint))))")
    level = F.coalesce(first("level").cast("bigint"), F.lit(0))
    return mid.withColumn("covering", covering).select("id", "class", "t0", "t1", width.alias("width_m"), level.alias("level"), flags.alias("flags"))


def sessions(vertices: DataFrame, line: str, step: Column, gap: float) -> DataFrame:
    """vertices without exact repeats, and the piece of the line they are in: a new one begins after a step over gap."""
    order = Window.partitionBy(line).orderBy("seq")
    real = vertices.where("x is not null and y is not null and not (x = 0 and y = 0)")
    moved = real.withColumns({"px": F.lag("x").over(order), "py": F.lag("y").over(order)}).where("px is null or px <> x or py <> y")
    started = moved.withColumn("new", F.coalesce((step > gap).cast("int"), F.lit(0)))
    return started.withColumn("piece", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)).cast("bigint")).drop("new")


def trimmed(vertices: DataFrame, line: str, step: Column, metres: float) -> DataFrame:
    """Lines without their first metres: the vertices past the cut, and the cut itself as the first. Shorter lines go."""
    track = measured(vertices, line, step)
    past = track.where(F.col("along") >= metres)
    crossing = (F.col("along") - F.col("step") < metres) & F.col("px").isNotNull() & (F.col("step") > 0)
    share = (metres - (F.col("along") - F.col("step"))) / F.col("step")
    at = past.where(crossing & (share < 1)).select(line, (F.col("seq") - 0.5).alias("seq"), (F.col("px") + (F.col("x") - F.col("px")) * share).alias("x"), (F.col("py") + (F.col("y") - F.col("py")) * share).alias("y"))
    return past.select(line, F.col("seq").cast("double").alias("seq"), "x", "y").unionByName(at)


def share_outside(vertices: DataFrame, line: str, box: tuple[float, float, float, float], samples: int = 2000) -> DataFrame:
    """Share of each line's length outside a box, from the middles of as many equal steps along it; a line without length goes by its vertices."""
    x0, y0, x1, y1 = box
    track = measured(vertices, line, flat_step())
    total = F.max("along").over(Window.partitionBy(line))
    out = lambda x, y: (~(x.between(x0, x1) & y.between(y0, y1))).cast("double")
    steps = track.withColumn("total", total)
    first = F.ceil((F.col("along") - F.col("step")) / F.col("total") * samples - 0.5)
    last = F.ceil(F.col("along") / F.col("total") * samples - 0.5) - 1
    sampled = steps.where("step > 0").withColumns({"f": first, "l": F.least(last, F.lit(samples - 1))}).where("l >= f").withColumn("k", F.explode(F.sequence("f", "l")))
    t = ((F.col("k") + 0.5) / samples * F.col("total") - (F.col("along") - F.col("step"))) / F.col("step")
    placed = sampled.select(line, out(F.col("px") + (F.col("x") - F.col("px")) * t, F.col("py") + (F.col("y") - F.col("py")) * t).alias("o"))
    still = steps.where("total = 0").select(line, out(F.col("x"), F.col("y")).alias("o"))
    return placed.unionByName(still).groupBy(line).agg(F.avg("o").alias("outside"))


def junctions(vertices: DataFrame, line: str, same: float, gap: float) -> DataFrame:
    """Places along each line where an inner vertex lies by another line's: runs nearer than gap become their mean, those within gap of an end go.

    Vertices are equal within 3 x 3 cells of `same`: each is sent to the nine around it once, and joined by cell."""
    placed = shares(vertices, line).withColumns({"cx": F.round(F.col("x") / same).cast("bigint"), "cy": F.round(F.col("y") / same).cast("bigint")})
    ends = placed.withColumns({"n": F.count("*").over(Window.partitionBy(line)), "i": F.row_number().over(Window.partitionBy(line).orderBy("seq"))})
    around = F.explode(F.array(*(F.struct(F.lit(x).alias("x"), F.lit(y).alias("y")) for x in (-1, 0, 1) for y in (-1, 0, 1))))
    sent = placed.select(F.col(line).alias("other"), "cx", "cy").distinct().withColumn("d", around).select("other", (F.col("cx") + F.col("d.x")).alias("cx"), (F.col("cy") + F.col("d.y")).alias("cy")).distinct()
    # two other lines at most tell whether there is one besides the line itself
    owners = sent.groupBy("cx", "cy").agg(F.min("other").alias("low"), F.max("other").alias("high"))
    inner = ends.where("i > 1 and i < n").join(owners, ["cx", "cy"]).where((F.col("low") != F.col(line)) | (F.col("high") != F.col(line)))
    order = Window.partitionBy(line).orderBy("at")
    runs = inner.withColumn("new", F.coalesce((F.col("at") - F.lag("at").over(order) >= gap).cast("int"), F.lit(0)))
    runs = runs.withColumn("run", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    middles = runs.groupBy(line, "run").agg(F.avg("at").alias("at"))
    return middles.where((F.col("at") > gap) & (F.col("at") < 1 - gap)).select(line, "at")


def seam_pairs(ends: DataFrame, tolerance: float = 2.0) -> DataFrame:
    """Ends (end, seam, kind, side, along) that are each other's nearest across a seam, within tolerance, and where they meet.

    Equality on seam, kind and a bucket of `along`, both neighbouring buckets sent once, instead of a range join."""
    left, right = ends.where("side < 0"), ends.where("side > 0")
    bucket = cell(F.col("along"), tolerance)
    near = right.select("seam", "kind", F.col("end").alias("b"), F.col("along").alias("along_b"), F.explode(F.array(bucket - 1, bucket, bucket + 1)).alias("bucket"))
    pairs = left.select("seam", "kind", F.col("end").alias("a"), F.col("along").alias("along_a"), bucket.alias("bucket")).join(near, ["seam", "kind", "bucket"])
    pairs = pairs.withColumn("gap", F.abs(F.col("along_a") - F.col("along_b"))).where(F.col("gap") <= tolerance)
    first = lambda side, other: F.row_number().over(Window.partitionBy(side).orderBy("gap", other))
    best = pairs.withColumns({"na": first("a", "b"), "nb": first("b", "a")}).where("na = 1 and nb = 1")
    return best.select("seam", "kind", "a", "b", "gap", ((F.col("along_a") + F.col("along_b")) / 2).alias("along"))


def nearest_segments(points: DataFrame, segments: DataFrame, radius: float, k: int = 8) -> DataFrame:
    """Per point (point, x, y) the k nearest segments (segment, ax, ay, bx, by) within radius: distance and place (t) on them."""
    box = segments.withColumns({"x0": F.least("ax", "bx"), "x1": F.greatest("ax", "bx"), "y0": F.least("ay", "by"), "y1": F.greatest("ay", "by")})
    from geoloom.operators.cells import points_in_boxes

    met = points_in_boxes(points, box, 2 * radius, radius)
    dx, dy = F.col("bx") - F.col("ax"), F.col("by") - F.col("ay")
    length2 = dx * dx + dy * dy
    t = F.when(length2 > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), ((F.col("x") - F.col("ax")) * dx + (F.col("y") - F.col("ay")) * dy) / length2))).otherwise(0.0)
    at = met.withColumn("t", t)
    far = F.sqrt((F.col("x") - F.col("ax") - F.col("t") * (F.col("bx") - F.col("ax"))) ** 2 + (F.col("y") - F.col("ay") - F.col("t") * (F.col("by") - F.col("ay"))) ** 2)
    close = at.withColumn("distance", far).where(F.col("distance") <= radius)
    ranked = close.withColumn("rank", F.row_number().over(Window.partitionBy("point").orderBy("distance", "segment")).cast("bigint"))
    return ranked.where(F.col("rank") <= k).select("point", "segment", "distance", "t", "rank")


def joined_intervals(intervals: DataFrame, key: str) -> DataFrame:
    """Union of the intervals (a, b) of each key: those that touch or overlap become one."""
    order = Window.partitionBy(key).orderBy("a", "b")
    reach = F.max("b").over(order.rowsBetween(Window.unboundedPreceding, -1))
    marked = intervals.withColumn("new", F.coalesce((F.col("a") > reach + SAME_POSITION).cast("int"), F.lit(0)))
    runs = marked.withColumn("run", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return runs.groupBy(key, "run").agg(F.min("a").alias("a"), F.max("b").alias("b")).select(key, "a", "b")


def less_intervals(joined: DataFrame, minus: DataFrame, key: str) -> DataFrame:
    """joined intervals less those of minus (joined too): the rests between, but for specks."""
    taken = minus.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("a", "b"))).alias("gone"))
    held = joined.join(taken, key, "left").withColumn("gone", F.expr("filter(coalesce(gone, cast(array() as array<struct<a:double,b:double>>)), g -> g.b > a and g.a < b)"))
    rests = F.expr("transform(sequence(0, size(gone)), i -> struct(if(i = 0, a, gone[i - 1].b) as a, if(i = size(gone), b, gone[i].a) as b))")
    return held.select(key, F.explode(rests).alias("r")).select(key, "r.a", "r.b").where(F.col("b") - F.col("a") > SAME_POSITION)


def densified(vertices: DataFrame, line: str, spacing: float) -> DataFrame:
    """The vertices of each line, and as many more at equal steps between two as leave none further apart than spacing: line, seq
    (of the vertex that a step leads to), k and n (the k-th of its n steps), x, y. A first vertex is a step of its own."""
    steps = measured(vertices, line, flat_step())
    n = F.greatest(F.lit(1), F.ceil(F.col("step") / spacing)).cast("bigint")
    parts = steps.withColumn("n", n).withColumn("k", F.explode(F.sequence(F.lit(1).cast("bigint"), "n")))
    at = lambda v: F.when(F.col(f"p{v}").isNull(), F.col(v)).otherwise(F.col(f"p{v}") + (F.col(v) - F.col(f"p{v}")) * F.col("k") / F.col("n")).alias(v)
    return parts.select(line, "seq", "k", "n", at("x"), at("y"))


def samples_along(vertices: DataFrame, line: str, spacing: float) -> DataFrame:
    """Places at equal steps of about spacing, at most, along each line from its start to its end: line, k, s (metres), x, y.

    Each step of a line tells the samples that lie on it, so no line is held whole by a row."""
    track = measured(vertices, line, flat_step()).withColumn("total", F.max("along").over(Window.partitionBy(line)))
    count = F.greatest(F.lit(1), F.ceil(F.col("total") / spacing)).cast("bigint")
    s = F.when(F.col("k") == F.col("count"), F.col("total")).otherwise(F.col("total") * F.col("k") / F.col("count"))
    before = F.col("along") - F.col("step")
    # a sample at a vertex is the end of the step before; one of slack on both sides, as the exact test decides
    low, high = F.floor(before / F.col("total") * F.col("count")) - 1, F.ceil(F.col("along") / F.col("total") * F.col("count")) + 1
    on = track.withColumns({"count": count, "prior": F.lag("along").over(Window.partitionBy(line).orderBy("seq"))}).where("total > 0 and along > prior")
    bounded = F.sequence(F.greatest(F.lit(0).cast("bigint"), low), F.least(F.col("count"), high))
    found = on.withColumn("k", F.explode(bounded)).withColumn("s", s).where(((F.col("s") > F.col("prior")) | (F.col("k") == 0) & (F.col("prior") == 0)) & (F.col("s") <= F.col("along")))
    t = (F.col("s") - F.col("prior")) / (F.col("along") - F.col("prior"))
    return found.select(line, "k", "s", *((F.col(f"p{v}") + (F.col(v) - F.col(f"p{v}")) * t).alias(v) for v in "xy"))


def coverage(original: DataFrame, final: DataFrame, tolerance: float) -> DataFrame:
    """One row: the share of the length of original segments whose middle lies within tolerance of a final one (ax, ay, bx, by);
    0 without any. Middles meet segments by cell."""
    length = F.sqrt((F.col("bx") - F.col("ax")) ** 2 + (F.col("by") - F.col("ay")) ** 2)
    middles = original.select(length.alias("length"), ((F.col("ax") + F.col("bx")) / 2).alias("x"), ((F.col("ay") + F.col("by")) / 2).alias("y"))
    # places that many segments have in common are looked up once
    places = middles.groupBy("x", "y").agg(F.sum("length").alias("length"))
    kept = final.select(F.lit(0).alias("segment"), "ax", "ay", "bx", "by").distinct()
    near = nearest_segments(places.withColumn("point", F.struct("x", "y")).drop("length"), kept, tolerance, 1).select(F.col("point.x").alias("x"), F.col("point.y").alias("y"), F.lit(True).alias("near"))
    told = places.join(near, ["x", "y"], "left")
    return told.agg(F.coalesce(F.sum(F.when(F.col("near"), F.col("length"))) / F.nullif(F.sum("length"), F.lit(0.0)), F.lit(0.0)).alias("covered"))
