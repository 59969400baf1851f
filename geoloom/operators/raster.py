"""Gridded surfaces: returns to cells, neighbourhood filters, components. A grid is a table keyed (row, col)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from geoloom.operators.cells import with_halo

#: Counts of a cell stop here.
MOST_RETURNS = 65_535
GROUND, WATER, BUILDING, VEGETATION = (2, 8, 20), (9,), (6,), (3, 4, 5)


def is_vegetation(cls: Column, single: Column) -> Column:
    """Plants by class, and unclassified returns of pulses that returned more than once."""
    return cls.isin(*VEGETATION) | ((cls == 1) & ~single)


def to_grid(points: DataFrame, x0: float, y0: float, dx: float, dy: float | None = None) -> DataFrame:
    """points with the cell (row, col) whose centre is nearest."""
    at = lambda v, low, step: F.floor((F.col(v) - low) / step + 0.5).cast("bigint")
    return points.withColumns({"row": at("y", y0, dy or dx), "col": at("x", x0, dx)})


def second_highest(points: DataFrame, name: str) -> DataFrame:
    """Per cell the second highest z, or the only one. Spark cuts each task's rows to two a cell before the shuffle."""
    ranked = points.withColumn("__n", F.row_number().over(Window.partitionBy("row", "col").orderBy(F.col("z").desc()))).where("__n <= 2")
    return ranked.groupBy("row", "col").agg(F.min("z").alias(name))


def surface_layers(points: DataFrame, x0: float = 0.0, y0: float = 0.0, dx: float = 1.0) -> DataFrame:
    """Returns (x, y, z, cls, single) to layers per cell: top, solid (without plants), ground, water_z, and counts by kind.

    Rows with a null place or height are dropped. Layers without returns are null."""
    cells = to_grid(points.where("x is not null and y is not null and z is not null"), x0, y0, dx)
    plant = is_vegetation(F.col("cls"), F.col("single"))
    kind = lambda codes: F.col("cls").isin(*codes)
    capped = lambda test: F.least(F.count_if(test), F.lit(MOST_RETURNS)).cast("bigint")
    counts = cells.groupBy("row", "col").agg(
        F.avg(F.when(kind(GROUND), F.col("z"))).alias("ground"), F.avg(F.when(kind(WATER), F.col("z"))).alias("water_z"), capped(F.lit(True)).alias("n_returns"),
        capped(plant).alias("n_vegetation"), capped(kind(GROUND)).alias("n_ground"), capped(kind(WATER)).alias("n_water"), capped(kind(BUILDING)).alias("n_building"),
    )
    return counts.join(second_highest(cells, "top"), ["row", "col"]).join(second_highest(cells.where(~plant), "solid"), ["row", "col"], "left")


def gap_layers(points: DataFrame, gap: float = 30.0) -> DataFrame:
    """Returns of gridded points in layers per cell: a new one begins where heights, from the top, leave a gap. Per layer: count, low and high."""
    falling = Window.partitionBy("row", "col").orderBy(F.col("z").desc())
    stepped = points.withColumn("__new", (F.lag("z").over(falling) - F.col("z") >= gap).cast("int"))
    layered = stepped.withColumn("layer", F.sum(F.coalesce("__new", F.lit(0))).over(falling.rowsBetween(Window.unboundedPreceding, 0)).cast("bigint"))
    return layered.groupBy("row", "col", "layer").agg(F.count("*").alias("n"), F.min("z").alias("low"), F.max("z").alias("high"))


def occupancy(points: DataFrame, width: float, height: float, steps: list[float]) -> DataFrame:
    """Share of empty cells of a width by height area for each candidate cell size; all sizes in one pass over the points."""
    sizes = F.explode(F.array(*map(F.lit, steps)))
    at = points.withColumn("size", sizes).select("size", F.floor(F.col("x") / F.col("size")).alias("c"), F.floor(F.col("y") / F.col("size")).alias("r"))
    full = at.distinct().groupBy("size").agg(F.count("*").alias("n"))
    cells = F.ceil(F.lit(width) / F.col("size")) * F.ceil(F.lit(height) / F.col("size"))
    return full.select("size", "n", cells.cast("bigint").alias("cells"), (1 - F.col("n") / cells).alias("empty"))


def window_extreme(grid: DataFrame, value: str, radius: int, highest: bool = True) -> DataFrame:
    """Per cell of a grid without holes the highest or lowest of value in a (2 radius + 1) square, cut off at edges.

    Two passes of one-dimensional windows, along rows and then columns: no cell is multiplied, whatever the radius."""
    along = lambda a, b: Window.partitionBy(a).orderBy(b).rangeBetween(-radius, radius)
    pick = F.max if highest else F.min
    rows = grid.withColumn("__s", pick(value).over(along("row", "col")))
    return rows.select("row", "col", pick("__s").over(along("col", "row")).alias("stat"))


def neighbourhood(grid: DataFrame, value: str, radius: int = 1) -> DataFrame:
    """Per cell that has a neighbour or itself in grid: own value (null for none), and the neighbours' as a sorted array."""
    own = (F.col("dr") == 0) & (F.col("dc") == 0)
    return with_halo(grid.where(F.col(value).isNotNull()), radius, [value]).groupBy("row", "col").agg(
        F.max(F.when(own, F.col(value))).alias("own"), F.sort_array(F.collect_list(F.when(~own, F.col(value)))).alias("around")
    )


def box_mean(grid: DataFrame, value: str, radius: int = 1) -> DataFrame:
    """Mean over the square around each cell of grid, of the cells there are."""
    sums = with_halo(grid, radius, [value]).groupBy("row", "col").agg(F.avg(value).alias("mean"))
    return sums.join(grid.select("row", "col"), ["row", "col"], "left_semi")


def dilate(mask: DataFrame, radius: int = 1) -> DataFrame:
    """Cells within radius of a cell of mask."""
    return with_halo(mask, radius, []).select("row", "col").distinct()


def erode(mask: DataFrame, radius: int = 1) -> DataFrame:
    """Cells of mask whose whole square is in mask."""
    return with_halo(mask, radius, []).groupBy("row", "col").agg(F.count("*").alias("n")).where(F.col("n") == (2 * radius + 1) ** 2).select("row", "col")


def despike(grid: DataFrame, value: str, threshold: float = 1.0) -> DataFrame:
    """Cells with all eight neighbours, over or under them all by more than threshold, get the mean of the middle two."""
    eight = neighbourhood(grid, value).where("own is not null")
    spike = (F.size("around") == 8) & ((F.col("own") > F.element_at("around", 8) + threshold) | (F.col("own") < F.element_at("around", 1) - threshold))
    return eight.select("row", "col", F.when(spike, (F.element_at("around", 4) + F.element_at("around", 5)) / 2).otherwise(F.col("own")).alias(value), spike.alias("spike"))


def fill_voids(grid: DataFrame, value: str, wanted: DataFrame, step: float = 2.0, rounds: int = 12) -> DataFrame:
    """Cells of wanted that grid lacks, filled ring by ring: the lowest of the neighbours where they differ by more than
    step, else their median. A round reads the grid before it. The lineage is cut after each."""
    from geoloom.sources.tables import cut

    have = grid.select("row", "col", F.col(value).alias("v"), F.lit(0).alias("ring"))
    for ring in range(1, rounds + 1):
        around = neighbourhood(have.select("row", "col", "v"), "v").where("own is null").join(wanted.select("row", "col"), ["row", "col"], "left_semi")
        low, high = F.element_at("around", 1), F.element_at("around", -1)
        n = F.size("around")
        median = (F.element_at("around", F.floor((n + 1) / 2).cast("int")) + F.element_at("around", F.floor(n / 2).cast("int") + 1)) / 2
        new = cut(around.select("row", "col", F.when(high - low > step, low).otherwise(median).alias("v"), F.lit(ring).alias("ring")))
        if new.isEmpty():
            break
        have = have.unionByName(new)
    return have.select("row", "col", F.col("v").alias(value), "ring")


def label(mask: DataFrame, columns: int) -> DataFrame:
    """4-connected components of mask (row, col): each cell with the smallest row * columns + col of its component.

    Cells take the least label around them, then the label that this label's own cell has, until none changes."""
    from geoloom.sources.tables import cut

    index = F.col("row") * columns + F.col("col")
    labels = cut(mask.select("row", "col", index.alias("id"), index.alias("label")))
    while True:
        sides = F.explode(F.array(*(F.struct(F.lit(r).alias("r"), F.lit(c).alias("c")) for r, c in ((0, 0), (0, 1), (1, 0), (0, -1), (-1, 0)))))
        sent = labels.withColumn("s", sides).select((F.col("row") + F.col("s.r")).alias("row"), (F.col("col") + F.col("s.c")).alias("col"), F.col("label").alias("l"))
        least = sent.groupBy("row", "col").agg(F.min("l").alias("l"))
        stepped = labels.join(least, ["row", "col"])
        jump = stepped.select(F.col("id").alias("l"), F.col("l").alias("further"))
        new = cut(stepped.join(jump, "l", "left").select("row", "col", "id", F.least("l", F.coalesce("further", "l")).alias("label"), F.col("label").alias("old")))
        changed = not new.where("label <> old").isEmpty()
        labels = new.drop("old")
        if not changed:
            return labels.select("row", "col", "label")


def water_level(cells: DataFrame, group: str, value: str) -> DataFrame:
    """Per group the lower tenth (the element at floor(0.1 n), from 0) and the upper median (at floor(n / 2)) of value."""
    ordered = cells.groupBy(group).agg(F.sort_array(F.collect_list(value)).alias("v"))
    at = lambda share: F.element_at("v", F.floor(F.size("v") * share).cast("int") + 1)
    return ordered.select(group, at(0.1).alias("low_tenth"), at(0.5).alias("middle"), F.size("v").cast("bigint").alias("n"))


def zonal_order(samples: DataFrame, zone: str, value: str, share: float) -> DataFrame:
    """Per zone the order statistic at floor(share * (n - 1)), from 0: not interpolated."""
    ordered = samples.groupBy(zone).agg(F.sort_array(F.collect_list(value)).alias("v"))
    return ordered.select(zone, F.element_at("v", F.floor((F.size("v") - 1) * share).cast("int") + 1).alias("level"))


def canopy(layers: DataFrame, share: float = 0.3) -> DataFrame:
    """Cells whose 5 x 5 square has at least that share of plant returns among all."""
    sums = with_halo(layers, 2, ["n_vegetation", "n_returns"]).groupBy("row", "col").agg(F.sum("n_vegetation").alias("v"), F.sum("n_returns").alias("n"))
    return sums.where(F.col("v") >= share * F.col("n")).join(layers.select("row", "col"), ["row", "col"], "left_semi")


def median_of_three(grid: DataFrame, value: str) -> DataFrame:
    """Median of three along rows, then along columns of that; ends of runs keep their value."""
    def pass_(df: DataFrame, along: str, across: str, name: str, out: str) -> DataFrame:
        w = Window.partitionBy(across).orderBy(along)
        three = F.array(F.lag(name).over(w), F.col(name), F.lead(name).over(w))
        near = (F.lag(along).over(w) == F.col(along) - 1) & (F.lead(along).over(w) == F.col(along) + 1)
        return df.withColumn(out, F.when(near, F.element_at(F.sort_array(three), 2)).otherwise(F.col(name)))

    return pass_(pass_(grid, "col", "row", value, "__m"), "row", "col", "__m", "median").drop("__m")


def triangles(grid: DataFrame, value: str) -> DataFrame:
    """Two triangles (corner indexes by row and col, heights) for each square of four cells with values."""
    corner = lambda r, c, n: grid.select((F.col("row") - r).alias("row"), (F.col("col") - c).alias("col"), F.col(value).alias(n))
    squares = corner(0, 0, "v00")
    for r, c, n in ((0, 1, "v10"), (1, 0, "v01"), (1, 1, "v11")):
        squares = squares.join(corner(r, c, n), ["row", "col"])
    point = lambda r, c, n: F.struct((F.col("col") + c).cast("double").alias("x"), (F.col("row") + r).cast("double").alias("y"), F.col(n).alias("z"))
    two = F.array(F.array(point(0, 0, "v00"), point(0, 1, "v10"), point(1, 1, "v11")), F.array(point(0, 0, "v00"), point(1, 1, "v11"), point(1, 0, "v01")))
    return squares.select("row", "col", F.posexplode(two).alias("half", "corners"))


def bilinear_samples(grid: DataFrame, points: DataFrame, rows: int, columns: int) -> DataFrame:
    """Per point (id, x, y in cells) the value between the four cells (row, col, v) around it, places past the edge taken at it;
    null where one of those cells is missing. Points are sent to their cells, so the grid is shuffled once and never held whole."""
    held = lambda v, most: F.greatest(F.lit(0.0), F.least(F.lit(float(most - 1)), v))
    at = points.select("id", held(F.col("x"), columns).alias("x"), held(F.col("y"), rows).alias("y"))
    low = at.withColumns({"c": F.floor("x").cast("bigint"), "r": F.floor("y").cast("bigint")}).withColumns({"fx": F.col("x") - F.col("c"), "fy": F.col("y") - F.col("r")})
    corner = lambda dr, dc: F.struct((F.col("r") + dr).alias("row"), (F.col("c") + dc).alias("col"), ((F.col("fy") if dr else 1 - F.col("fy")) * (F.col("fx") if dc else 1 - F.col("fx"))).alias("w"))
    sent = low.select("id", F.explode(F.array(*(corner(r, c) for r in (0, 1) for c in (0, 1)))).alias("k")).select("id", "k.*").where("w > 0")
    met = sent.join(grid.select("row", "col", "v"), ["row", "col"], "left")
    return met.groupBy("id").agg(F.when(F.count("v") == F.count("*"), F.sum(F.col("w") * F.col("v"))).alias("v"))
