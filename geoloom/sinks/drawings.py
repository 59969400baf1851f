"""SVG documents from line work, written by Spark's own text functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def number(v: Column) -> Column:
    """Three decimals at most, without trailing zeros or a minus before zero."""
    text = F.regexp_replace(F.format_string("%.3f", v), r"\.?0+$", "")
    return F.when(text == "-0", "0").otherwise(text)


def escaped(text: Column) -> Column:
    for raw, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        text = F.replace(text, F.lit(raw), F.lit(entity))
    return text


def path_data(points: Column, closed: Column | bool = False) -> Column:
    """The d attribute of a path through points (x, y)."""
    steps = F.transform(points, lambda p, i: F.concat(F.when(i == 0, "M").otherwise("L"), number(p["x"]), F.lit(" "), number(p["y"])))
    return F.concat(F.array_join(steps, ""), F.when(closed if isinstance(closed, Column) else F.lit(closed), "Z").otherwise(""))


def documents(paths: DataFrame, width: float, height: float) -> DataFrame:
    """(sheet, svg) of paths (sheet, layer, place, colour, stroke, points, closed): a group for each layer, paths by place."""
    element = F.concat(F.lit('<path d="'), path_data(F.col("points"), F.col("closed")), F.lit('"/>'))
    layers = paths.withColumn("e", element).groupBy("sheet", "layer").agg(F.first("colour").alias("colour"), F.first("stroke").alias("stroke"), F.sort_array(F.collect_list(F.struct("place", "e"))).alias("e"))
    group = F.concat(F.lit('<g id="'), escaped(F.col("layer")), F.lit('" fill="none" stroke="'), escaped(F.col("colour")), F.lit('" stroke-width="'), number(F.col("stroke")), F.lit('">'), F.array_join(F.col("e.e"), ""), F.lit("</g>"))
    head = f'<svg xmlns="http://www.w3.org/2000/svg" width="{width:g}mm" height="{height:g}mm" viewBox="0 0 {width:g} {height:g}">'
    sheets = layers.withColumn("g", group).groupBy("sheet").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("layer", "g"))), lambda x: x["g"]), "").alias("body"))
    return sheets.select("sheet", F.concat(F.lit(head), "body", F.lit("</svg>")).alias("svg"))
