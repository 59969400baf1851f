"""Keyed edits, caches, sections and tallies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def overriding(pieces: DataFrame, edits: DataFrame, fields: list[str], slack: float = 1e-9) -> DataFrame:
    """pieces (id, t0, t1) with each field from the narrowest edit (id, lo, hi, fields) that holds all of the piece and sets it."""
    width = F.struct((F.col("hi") - F.col("lo")).alias("w"), (-F.col("lo")).alias("l"))
    told = edits.withColumnRenamed("id", "__id")
    holds = (F.col("__id") == F.col("id")) & (F.col("lo") <= F.col("t0") + slack) & (F.col("hi") >= F.col("t1") - slack)
    joined = pieces.join(told, holds, "left")
    return joined.groupBy("id", "t0", "t1").agg(*(F.min_by(f, F.when(F.col(f).isNotNull(), width)).alias(f) for f in fields))


def merged(base: DataFrame, extra: DataFrame) -> DataFrame:
    """Edits (key, value) of both, those of extra where both have one; change: added, replaced, same or kept."""
    b, e = base.select("key", F.col("value").alias("old")), extra.select("key", F.col("value").alias("new"))
    both = b.join(e, "key", "full")
    change = F.when(F.col("new").isNull(), "kept").when(F.col("old").isNull(), "added").when(F.col("old") == F.col("new"), "same").otherwise("replaced")
    return both.select("key", F.coalesce("new", "old").alias("value"), change.alias("change"))


def evicted(entries: DataFrame, cache: str, target: float) -> DataFrame:
    """Entries (key, size, used) that go, least lately used first, until each cache is within target."""
    oldest = Window.partitionBy(cache).orderBy("used", "key")
    total = F.sum("size").over(Window.partitionBy(cache))
    before = F.coalesce(F.sum("size").over(oldest.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return entries.withColumn("left", total - before).where(F.col("left") > target).drop("left")


def sections(models: DataFrame, most_width: float = 210.0, most_height: float = 210.0) -> DataFrame:
    """Equal sections of each model (id, x0, y0, x1, y1), rows from the north and columns from the west, counted from 1."""
    n = lambda lo, hi, most: F.greatest(F.lit(1), F.ceil((F.col(hi) - F.col(lo)) / most - 1e-9)).cast("bigint")
    counted = models.where("x1 > x0 and y1 > y0").withColumns({"columns": n("x0", "x1", most_width), "rows": n("y0", "y1", most_height)})
    cells = counted.withColumn("row", F.explode(F.sequence(F.lit(1).cast("bigint"), "rows"))).withColumn("col", F.explode(F.sequence(F.lit(1).cast("bigint"), "columns")))
    x = lambda k: F.col("x0") + (F.col("x1") - F.col("x0")) * k / F.col("columns")
    y = lambda k: F.col("y1") - (F.col("y1") - F.col("y0")) * k / F.col("rows")
    return cells.select("id", "row", "col", x(F.col("col") - 1).alias("west"), y(F.col("row")).alias("south"), x(F.col("col")).alias("east"), y(F.col("row") - 1).alias("north"))


def numbered_by_first_use(parts: DataFrame, model: str, colour: str, order: str) -> DataFrame:
    """Each model's distinct colours, numbered in the order of their first part."""
    first = parts.groupBy(model, colour).agg(F.min(order).alias("first"))
    return first.select(model, colour, F.row_number().over(Window.partitionBy(model).orderBy("first", colour)).cast("bigint").alias("number"))


def edge_report(triangles: DataFrame, model: str) -> DataFrame:
    """Per model (triangles a, b, c): edges, how many are open (one face) and how many have more than two."""
    sides = F.explode(F.array(*(F.struct(F.least(p, q).alias("u"), F.greatest(p, q).alias("v")) for p, q in (("a", "b"), ("b", "c"), ("c", "a")))))
    uses = triangles.select(model, sides.alias("e")).groupBy(model, "e.u", "e.v").agg(F.count("*").alias("n"))
    return uses.groupBy(model).agg(F.count("*").alias("edges"), F.count_if(F.col("n") == 1).alias("open"), F.count_if(F.col("n") > 2).alias("shared"))


def owned_cells(claims: DataFrame, priority: str, owner: str) -> DataFrame:
    """Of each cell's claims (row, col, owner, priority) the one of the lowest priority value; of equal ones the lowest owner."""
    return claims.groupBy("row", "col").agg(F.min(F.struct(priority, owner)).alias("o")).select("row", "col", f"o.{owner}")


def part_bounds(vertices: DataFrame, model: str) -> DataFrame:
    """The box around the vertices (x, y, z) of each model."""
    return vertices.groupBy(model).agg(*(f(v).alias(f"{name}_{v}") for name, f in (("least", F.min), ("most", F.max)) for v in "xyz"))


def chosen_first(ranked: DataFrame, group: str, chosen: Column) -> DataFrame:
    """ranked (group, place) with new places: the first row of each group that is chosen comes first, others keep their order."""
    own = Window.partitionBy(group)
    first = F.min(F.when(chosen, F.col("place"))).over(own)
    return ranked.withColumn("__c", first).withColumn("place", F.when(F.col("place") == F.col("__c"), F.min("place").over(own)).when(F.col("place") < F.col("__c"), F.lead("place").over(own.orderBy("place"))).otherwise(F.col("place"))).drop("__c")
