"""Rules over texts: widths, dates and years in names, keys of objects, waiting times, numbers as files write them. Nulls give null."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from geoloom.functions.scalar import FOOT_M

# What the prefix of an object's key stands for.
KINDS = {"b": "building", "r": "road", "w": "water", "t": "tree", "k": "rock", "s": "shape", "rt": "route"}

#: Segments of a circle at least and at most, and how far a chord may lie from its arc, in millimetres.
LEAST_SEGMENTS, MOST_SEGMENTS, CHORD_MM = 32, 192, 0.1


def _found(text: Column, pattern: str, group: int = 1) -> Column:
    return F.nullif(F.regexp_extract(text, pattern, group), F.lit(""))


def tagged_width(text: Column) -> Column:
    """Metres of a width tag such as `7`, `7.5 m`, `24 ft` or `24 feet`; null for other texts and widths that aren't positive."""
    form = r"^(\d+(?:\.\d+)?)\s*(m|ft|feet)?$"
    t = F.trim(text)
    metres = _found(t, form).try_cast("double") * F.when(F.regexp_extract(t, form, 2).isin("ft", "feet"), FOOT_M).otherwise(1.0)
    return F.when(metres > 0, metres)


def work_unit_year(name: Column) -> Column:
    """The year of a survey's name that ends in a letter A to F and two digits, such as `_B23`."""
    return _found(name, r"_[A-F](\d\d)$").try_cast("int") + 2000


def iso_date(text: Column) -> Column:
    """The date YYYY-MM-DD that a text begins with, as text."""
    return _found(F.trim(text), r"^(\d{4}-\d\d-\d\d)")


def flown(file: Column, year: Column) -> Column:
    """struct(start, end) of the flights behind a file of a survey of that year, as ISO dates: of the one or two dates at the end
    of its name if the first is of that year, else the whole year."""
    dates = F.regexp_extract(F.lower(file), r"_(\d{8}(?:_\d{8})?)\.laz$", 1)
    own = dates.startswith(year.cast("string"))
    # of two dates the second counts in the year of the first; if that is another, the last alone may be of this year
    last = F.right(dates, F.lit(8))
    used = F.when(own, dates).when(last.startswith(year.cast("string")), last)
    iso = lambda d: F.concat_ws("-", F.substring(d, 1, 4), F.substring(d, 5, 2), F.substring(d, 7, 2))
    told = F.struct(iso(F.left(used, F.lit(8))).alias("start"), iso(F.right(used, F.lit(8))).alias("end"))
    whole = F.struct(F.concat(year.cast("string"), F.lit("-01-01")).alias("start"), F.concat(year.cast("string"), F.lit("-12-31")).alias("end"))
    return F.when(used.isNotNull(), told).otherwise(whole)


def spaced_name(project: Column) -> Column:
    """A project's name in words: underscores and changes from small to capital letters part them, a last `_LiDAR` goes."""
    words = F.translate(F.regexp_replace(project, "(?i)_lidar$", ""), "_", " ")
    return F.trim(F.regexp_replace(words, "(?<=[a-z])(?=[A-Z])", " "))


def wait_ms(value: Column, now: Column) -> Column:
    """Milliseconds to wait from now (a timestamp) on, of a text with seconds or an HTTP date; 0 if past, null for other texts."""
    seconds = value.try_cast("double")
    until = F.try_to_timestamp(F.regexp_extract(value, r"^\w{3}, (\d\d \w{3} \d{4} \d\d:\d\d:\d\d) GMT$", 1), F.lit("dd MMM yyyy HH:mm:ss"))
    ms = F.coalesce(seconds * 1000, (F.unix_millis(until) - F.unix_millis(now)).cast("double"))
    return F.when(F.trim(value) != "", F.greatest(F.lit(0.0), ms) + F.when(ms.isNotNull(), 0.0))


def object_kind(key: Column) -> Column:
    """What kind of object a key names by its prefix; null for an unknown one."""
    table = F.create_map(*(F.lit(x) for kv in KINDS.items() for x in kv))
    return F.when(key.contains(":"), F.try_element_at(table, F.substring_index(key, ":", 1)))


def whole_object(key: Column) -> Column:
    """The key of the object that a part's key, such as `b:1/roof`, belongs to."""
    return F.substring_index(key, "/", 1)


def part_of(key: Column, part: Column) -> Column:
    """The key of a part of an object; the object's own for an empty part."""
    return F.when(part == "", key).otherwise(F.concat_ws("/", key, part))


def circle_segments(radius_mm: Column, chord_mm: float = CHORD_MM) -> Column:
    """Segments of a circle on the model whose chords keep to the arc: a multiple of four within the bounds."""
    fine = F.ceil(F.lit(3.141592653589793) / F.acos(1 - chord_mm / radius_mm))
    bounded = F.greatest(F.lit(LEAST_SEGMENTS), F.least(F.lit(MOST_SEGMENTS), fine))
    return F.when(radius_mm <= chord_mm, F.lit(LEAST_SEGMENTS)).otherwise(F.ceil(bounded / 4) * 4).cast("bigint")


def six_decimals(v: Column) -> Column:
    """A number under 1e9 or so with six decimals, halves to even; a negative zero keeps its sign. Null unless finite."""
    steps = F.rint(F.abs(v) * 1e6).cast("bigint")
    sign = F.when(v.cast("string").startswith("-"), "-").otherwise("")
    text = F.concat(sign, F.floor(steps / 1_000_000).cast("string"), F.lit("."), F.lpad((steps % 1_000_000).cast("string"), 6, "0"))
    return F.when(F.abs(v) < float("inf"), text)
