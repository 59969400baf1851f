"""Measurement of ground and roofs from returns: cell medians, planes, supported heights, weighted levels, claims, repairs."""

from __future__ import annotations

import math
from collections import defaultdict

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from geoloom.operators.cells import with_halo

#: Returns of a cell that are kept for its layers.
TOP_RETURNS = 24
# A pit is this much under what a slope of one allows from the pixels around; a void has this value.
PIT_REACH, PIT_MARGIN_M, VOID_M = 3, 20.0, -32768.0


def cell_medians(points: DataFrame, group: str, cell_m: float = 4.0, least: int = 1) -> DataFrame:
    """Per group and cell the medians (interpolated) of x, y and z, of cells with at least that many points."""
    placed = points.withColumns({"cx": F.floor(F.col("x") / cell_m).cast("bigint"), "cy": F.floor(F.col("y") / cell_m).cast("bigint")})
    out = placed.groupBy(group, "cx", "cy").agg(*(F.percentile(c, 0.5).alias(c) for c in ("x", "y", "z")), F.count("*").alias("n"))
    return out.where(F.col("n") >= least)


def highest(points: DataFrame, keys: list[str], k: int = TOP_RETURNS) -> DataFrame:
    """Per key the k highest z, descending. Each task keeps k a key before the shuffle, so no key is ever held whole."""
    ranked = points.withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy(F.col("z").desc()))).where(F.col("__n") <= k)
    return ranked.groupBy(*keys).agg(F.sort_array(F.collect_list("z"), asc=False).alias("z"))


def planes(points: DataFrame, group: str) -> DataFrame:
    """Per group the least-squares plane z = a * x + b * y + c: sums of products, centred, and Cramer's rule. No plane, no row."""
    s = points.groupBy(group).agg(F.count("*").alias("n"), *(F.avg(c).alias(f"m{c}") for c in "xyz"), *(F.covar_pop(p, q).alias(f"{p}{q}") for p, q in ("xx", "xy", "yy", "xz", "yz")))
    det = F.col("xx") * F.col("yy") - F.col("xy") * F.col("xy")
    told = s.withColumn("det", det).where(F.col("det") > 1e-9 * (1 + F.col("xx") * F.col("yy")))
    a = (F.col("xz") * F.col("yy") - F.col("yz") * F.col("xy")) / F.col("det")
    b = (F.col("yz") * F.col("xx") - F.col("xz") * F.col("xy")) / F.col("det")
    return told.withColumns({"a": a, "b": b}).withColumn("c", F.col("mz") - F.col("a") * F.col("mx") - F.col("b") * F.col("my")).select(group, "n", "a", "b", "c")


def ground_planes(points: DataFrame, group: str, rounds: int = 3) -> DataFrame:
    """Planes fitted again to the points within max(0.5, 3 * median residual) of the last, and the root mean square residual."""
    from geoloom.sources.tables import cut

    kept = points.select(group, "x", "y", "z")
    far = F.abs(F.col("z") - F.col("a") * F.col("x") - F.col("b") * F.col("y") - F.col("c"))
    for _ in range(rounds - 1):
        off = cut(kept.join(planes(kept, group).drop("n"), group).withColumn("r", far))
        limit = off.groupBy(group).agg(F.greatest(F.lit(0.5), 3 * F.percentile("r", 0.5)).alias("limit"))
        kept = off.join(limit, group).where(F.col("r") < F.col("limit")).select(group, "x", "y", "z")
    last = planes(kept, group)
    rms = kept.join(last.drop("n"), group).groupBy(group).agg(F.sqrt(F.avg(far * far)).alias("rms"))
    return last.join(rms, group)


def weighted_level(parts: DataFrame, group: str, height: str, area: str, share: float = 0.9) -> DataFrame:
    """Per group the lowest height at and under which at least that share of the area lies."""
    w = Window.partitionBy(group).orderBy(height)
    told = parts.groupBy(group, height).agg(F.sum(area).alias("__a")).withColumns({"__below": F.sum("__a").over(w), "__all": F.sum("__a").over(Window.partitionBy(group))})
    return told.where(F.col("__below") >= share * F.col("__all") - 1e-9).groupBy(group).agg(F.min(height).alias("level"))


#: Metres of height that part patches; square metres and cells of a patch; shares of a roof that a patch, all
#: patches, classified returns and joined sides must have; the percentile that is a patch's height.
PATCH_STEP, PATCH_M2, PATCH_CELLS, MAJOR, EXPLAINED, CLASSIFIED, COHERENT, PATCH_TOP = 3.0, 36, 4, 0.02, 0.85, 0.7, 0.8, 0.95


def supported_heights(cells: DataFrame, building: str, cell_m: float) -> DataFrame:
    """Per building (cells cx, cy, z; classified: the share of roof returns by class) the height and confidence that its roof
    supports, null where it supports none.

    Sides of cells that differ by less than PATCH_STEP are links; their connected components are patches, of which those count
    that have PATCH_M2 and PATCH_CELLS. Components go round by round over all buildings, so no roof is held by a task; the
    percentile of a patch is an aggregate."""
    from geoloom.operators.graph import components

    least = max(PATCH_CELLS, math.ceil(PATCH_M2 / cell_m**2))
    at = cells.select(building, "cx", "cy", "z", "classified", F.struct(building, "cx", "cy").alias("cell"))
    beside = F.explode(F.array(F.struct((F.col("cx") + 1).alias("cx"), F.col("cy").alias("cy")), F.struct(F.col("cx").alias("cx"), (F.col("cy") + 1).alias("cy")))).alias("n")
    asked = at.select(building, F.col("cell").alias("__from"), F.col("z").alias("__z"), beside).select(building, "__from", "__z", "n.cx", "n.cy")
    sides = asked.join(at.select(building, "cx", "cy", F.col("cell").alias("__to"), "z"), [building, "cx", "cy"]).select(building, "__from", "__to", (F.abs(F.col("z") - F.col("__z")) < PATCH_STEP).alias("joined"))
    patch = components(sides.where("joined").select(F.col("__from").alias("a"), F.col("__to").alias("b"))).select(F.col("node").alias("cell"), F.col("root").alias("patch"))
    held = at.join(patch, "cell", "left").withColumn("patch", F.coalesce("patch", "cell"))
    patches = held.groupBy(building, "patch").agg(F.count("*").alias("n"), F.percentile("z", F.lit(PATCH_TOP)).alias("top"))
    roofs = at.groupBy(building).agg(F.count("*").alias("all"), F.first("classified").alias("classified"))
    whole = roofs.join(sides.groupBy(building).agg(F.avg(F.col("joined").cast("int")).alias("coherent")), building, "left").na.fill(0.0, ["coherent"])
    counted = patches.where(F.col("n") >= least).join(whole.select(building, "all"), building)
    told = counted.groupBy(building).agg(F.sum("n").alias("in_patches"), F.max(F.when(F.col("n") >= MAJOR * F.col("all"), F.col("top"))).alias("top"))
    rows = whole.join(told, building, "left").withColumn("explained", F.coalesce(F.col("in_patches") / F.col("all"), F.lit(0.0)))
    good = F.col("top").isNotNull() & (F.col("explained") >= EXPLAINED) & ((F.col("classified") >= CLASSIFIED) | (F.col("coherent") >= COHERENT))
    return rows.select(building, F.when(good, F.col("top")).alias("height"), F.when(good, F.least("explained", "coherent")).alias("confidence"))


def claims(cells: DataFrame, surveys: DataFrame) -> DataFrame:
    """(row, col, survey): of the surveys (survey, place, x0, y0, x1, y1) over each cell's centre the one of the first place."""
    from geoloom.operators.cells import points_in_boxes

    centres = cells.select("row", "col", (F.col("col") + 0.5).alias("x"), (F.col("row") + 0.5).alias("y"))
    met = points_in_boxes(centres, surveys, 64.0)
    return met.groupBy("row", "col").agg(F.min_by("survey", F.struct("place", "survey")).alias("survey"))


def picked(samples: DataFrame, picks: DataFrame, tolerance: float, share: float = 0.7) -> DataFrame:
    """(line, owner): samples (line, k, x, y) vote for the owner of the nearest pick (x, y) in tolerance; the winner has at least that share.

    Samples and picks on one place are joined once; of picks on one place the lowest owner's is told."""
    from geoloom.operators.cells import points_in_boxes

    first = picks.groupBy("x", "y").agg(F.min("owner").alias("owner"))
    boxes = first.select("owner", F.col("x").alias("px"), F.col("y").alias("py"), *(F.col(c).alias(f"{c}{i}") for c in "xy" for i in (0, 1)))
    far2 = (F.col("x") - F.col("px")) ** 2 + (F.col("y") - F.col("py")) ** 2
    near = points_in_boxes(samples.select("x", "y").distinct(), boxes, 4 * tolerance, tolerance).withColumn("d", far2).where(F.col("d") <= tolerance**2)
    owners = near.groupBy("x", "y").agg(F.min(F.struct("d", "owner"))["owner"].alias("owner"))
    votes = samples.select("line", "x", "y").join(owners, ["x", "y"], "left").groupBy("line", "owner").agg(F.count("*").alias("votes"))
    told = F.when(F.col("owner").isNotNull(), F.struct("votes", (-F.col("owner")).alias("first")))
    best = votes.groupBy("line").agg(F.max(told).alias("b"), F.sum("votes").alias("n"))
    return best.where(F.col("b.votes") >= share * F.col("n")).select("line", (-F.col("b.first")).alias("owner"), F.col("b.votes").alias("votes"))


def not_covered(boxes: DataFrame, others: DataFrame, most: float = 0.25, size: float = 16.0) -> DataFrame:
    """Boxes (id, x0, y0, x1, y1) of whose area others cover at most that share, overlaps summed."""
    from geoloom.operators.cells import overlap_join

    side = lambda lo, hi: F.least(F.col(f"a_{hi}"), F.col(f"b_{hi}")) - F.greatest(F.col(f"a_{lo}"), F.col(f"b_{lo}"))
    met = overlap_join(boxes, others, size).groupBy("a_id").agg(F.sum(side("x0", "x1") * side("y0", "y1")).alias("covered"), F.first("a_x0").alias("x0"), F.first("a_x1").alias("x1"), F.first("a_y0").alias("y0"), F.first("a_y1").alias("y1"))
    gone = met.where(F.col("covered") > most * (F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0"))).select(F.col("a_id").alias("id"))
    return boxes.join(gone, "id", "left_anti")


def pits(pixels: DataFrame, pixel_m: float) -> DataFrame:
    """Pixels (row, col, v) under sea level that are voids, or too deep under a slope of one from some pixel within three."""
    around = with_halo(pixels.where(F.col("v") != VOID_M), PIT_REACH, ["v"]).where("dr <> 0 or dc <> 0")
    drop = F.sqrt((F.col("dr") * F.col("dr") + F.col("dc") * F.col("dc")).cast("double")) * pixel_m
    allowed = around.groupBy("row", "col").agg(F.max(F.col("v") - drop).alias("allowed"))
    low = pixels.where("v < 0").join(allowed, ["row", "col"], "left")
    return low.where((F.col("v") == VOID_M) | (F.col("allowed") - F.col("v") > PIT_MARGIN_M)).select("row", "col")


def spaced(points: DataFrame, order: list[str], radius: float) -> DataFrame:
    """Points (id, x, y) taken in order, without those within radius of one taken before.

    The outcome hangs on the order; only points within reach of each other bear on it, so each connected group is gone
    through by itself. Of points on one place only the first can be taken: what keeps it out keeps the others out too."""
    from geoloom.operators.cells import overlap_join
    from geoloom.operators.graph import components

    if radius <= 0:
        return points
    finite = F.coalesce((F.abs("x") < float("inf")) & (F.abs("y") < float("inf")), F.lit(False))
    row = F.struct(F.struct(*order, "id").alias("__o"), F.struct(*points.columns).alias("__p"))
    heads = points.where(finite).groupBy("x", "y").agg(F.min_by(row, row["__o"]).alias("__r")).select("__r.__p.*", "__r.__o")
    first = heads.drop("__o")
    boxes = first.select("id", *(F.col(c).alias(f"{c}{i}") for c in "xy" for i in (0, 1)), "x", "y")
    near = overlap_join(boxes, boxes, 2 * radius, radius).where("a_id < b_id").where((F.col("a_x") - F.col("b_x")) ** 2 + (F.col("a_y") - F.col("b_y")) ** 2 < radius**2).select(F.col("a_id").alias("a"), F.col("b_id").alias("b"))
    root = components(near)
    own_root = root.select(F.col("node").alias("id"), F.col("root").alias("spot"))
    numbered = heads.join(own_root, "id").withColumn("n", F.row_number().over(Window.partitionBy("spot").orderBy("__o"))).select("spot", "id", "n")
    links = near.join(root.select(F.col("node").alias("a"), F.col("root").alias("spot")), "a").select("spot", "a", "b")

    def take(own: pd.DataFrame, pairs: pd.DataFrame) -> pd.DataFrame:
        by = defaultdict(list)
        for a, b in pairs[["a", "b"]].itertuples(index=False):
            by[a].append(b)
            by[b].append(a)
        taken: set = set()
        for i in own.sort_values("n").id:
            if not taken.intersection(by[i]):
                taken.add(i)
        return pd.DataFrame({"id": pd.Series(sorted(taken), dtype="int64")})

    crowded = numbered.groupBy("spot").cogroup(links.groupBy("spot")).applyInPandas(take, "id bigint")
    alone = first.join(root.select(F.col("node").alias("id")), "id", "left_anti")
    return points.where(~finite).unionByName(alone).unionByName(first.join(crowded, "id", "left_semi"))


def signed_volume(triangles: DataFrame, model: str) -> DataFrame:
    """Volume enclosed by each model's triangles (corners of x, y, z): a sum of determinants, positive for outward faces."""
    c = lambda i, k: F.col("corners")[i][k]
    det = (
        c(0, "x") * (c(1, "y") * c(2, "z") - c(1, "z") * c(2, "y")) - c(0, "y") * (c(1, "x") * c(2, "z") - c(1, "z") * c(2, "x")) + c(0, "z") * (c(1, "x") * c(2, "y") - c(1, "y") * c(2, "x"))
    )
    return triangles.groupBy(model).agg((F.sum(det) / 6).alias("volume"))


def advantage(new_year: Column, year: Column, new_density: Column, density: Column) -> Column:
    """newer: at least five years; denser: at least twice and two returns a square metre more; else null."""
    return F.when(new_year - year >= 5, "newer").when((new_density >= 2 * density) & (new_density - density >= 2), "denser")
