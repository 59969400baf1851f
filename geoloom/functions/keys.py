"""Keys and settings as text: road ranges, releases, bounds, kinds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed values of the text formats: a road's prefix, what parts its range, digits of a place, characters read as a minus.
PREFIX, AT, TO, DIGITS = "r:", "@", "-", 5
MINUSES = "\u2212\u2013\ufe63\uff0d"


def rounded_place(at: Column) -> Column:
    """A share of a segment as keys hold it: between 0 and 1, to DIGITS digits, halves up."""
    steps = F.floor(at * 10**DIGITS + 0.5)
    return F.when(steps <= 0, 0.0).when(steps >= 10**DIGITS, 1.0).otherwise(steps / 10**DIGITS)


def place_text(at: Column) -> Column:
    """The shortest decimal that reads as the rounded place."""
    return F.regexp_replace(F.format_string(f"%.{DIGITS}f", rounded_place(at)), r"\.?0+$", "")


def road_key(segment: Column, low: Column, high: Column) -> Column:
    """The key of a part of a segment; of all of it, the segment's own."""
    part = F.concat(segment, F.lit(AT), F.concat_ws(TO, place_text(low), place_text(high)))
    return F.when((rounded_place(low) > 0) | (rounded_place(high) < 1), part).otherwise(segment)


def parsed_road_key(key: Column) -> Column:
    """What road_key wrote, as struct(segment, low, high). Null for what isn't a road's key or spans nothing once rounded."""
    halves = F.split(key, AT)
    ends = F.split(F.try_element_at(halves, F.lit(2)), TO)
    number = lambda k: F.when(F.try_element_at(ends, F.lit(k)).rlike(r"^(\d+|\d*\.\d+)$"), F.try_element_at(ends, F.lit(k)).try_cast("double"))
    spans = (F.size(ends) == 2) & (number(2) <= 1) & (rounded_place(number(1)) < rounded_place(number(2)))
    told = F.when(F.size(halves) == 1, F.struct(key.alias("segment"), F.lit(0.0).alias("low"), F.lit(1.0).alias("high")))
    told = told.when((F.size(halves) == 2) & spans, F.struct(halves[0].alias("segment"), number(1).alias("low"), number(2).alias("high")))
    return F.when(key.startswith(PREFIX), told)


def latest_release(names: DataFrame, name: str) -> DataFrame:
    """The newest of names like 2026-09-23.1: by date, then by the number after it. Other names don't count."""
    good = names.where(F.col(name).rlike(r"^\d{4}-\d{2}-\d{2}\.\d+$"))
    return good.agg(F.max_by(name, F.struct(F.substring(name, 1, 10), F.substring_index(name, ".", -1).cast("int"))).alias("latest"))


def _numbers(text: Column) -> Column:
    """The numbers of a text in order, null for what isn't one: any run of other characters parts them."""
    plain = F.translate(text, MINUSES, "-" * len(MINUSES))
    return F.transform(F.filter(F.split(plain, r"[^0-9A-Za-z.+-]+"), lambda t: t != ""), lambda t: t.try_cast("double"))


def bounds_in(text: Column) -> Column:
    """struct(west, south, east, north) of a text that holds these four degrees, after a name and = or not; null unless they
    bound an area on the globe."""
    degrees = _numbers(F.substring_index(text, "=", -1))
    west, south, east, north = (F.try_element_at(degrees, F.lit(k)) for k in (1, 2, 3, 4))
    on_globe = (west >= -180) & (east <= 180) & (south >= -90) & (north <= 90)
    return F.when((F.size(degrees) == 4) & on_globe & (west < east) & (south < north), F.struct(west.alias("west"), south.alias("south"), east.alias("east"), north.alias("north")))


def place_in(text: Column) -> Column:
    """struct(lon, lat) of a text that holds a latitude and a longitude and nothing else; null out of range."""
    degrees = _numbers(text)
    lat, lon = F.try_element_at(degrees, F.lit(1)), F.try_element_at(degrees, F.lit(2))
    return F.when((F.size(degrees) == 2) & lat.between(-90, 90) & lon.between(-180, 180), F.struct(lon.alias("lon"), lat.alias("lat")))


def estimated_height(sources: Column) -> Column:
    """Whether all sources (property, dataset) of a height are estimates by machines or earlier surveys; false without any."""
    of_height = F.filter(F.coalesce(sources, F.expr("cast(array() as array<struct<property:string,dataset:string>>)")), lambda s: s["property"] == "/properties/height")
    return (F.size(of_height) > 0) & F.forall(of_height, lambda s: F.coalesce(s["dataset"].isin("Microsoft ML Buildings", "USGS Lidar"), F.lit(False)))
