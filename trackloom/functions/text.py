"""Further scalar columns: angles and vectors, positions and times as text, report text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from trackloom.functions.scalar import min_angle_diff

#: What stands for a character in LaTeX; fixed values.
LATEX = {"\\": "\\textbackslash", "%": "\\%", "$": "\\$", "{": "\\{", "_": "\\_", "#": "\\#", "&": "\\&", "}": "\\}", "^": "\\^", "<": "\\textless", ">": "\\textgreater"}


def padded(number: Column, width: int, fill: str = "0") -> Column:
    """A whole number filled on the left; longer ones stay whole."""
    text = number.cast("string")
    return F.lpad(text, F.greatest(F.length(text), F.lit(width)), F.lit(fill))


def fixed_text(number: Column, digits: int) -> Column:
    """With so many digits after the point, never in scientific notation."""
    return F.format_string(f"%.{digits}f", number.cast("double"))


def ends_with(text: Column, ending: str) -> Column:
    return text.endswith(ending)


def joined(values: Column, separator: str = ";") -> Column:
    """An array as one text; nulls are left out."""
    return F.array_join(values.cast("array<string>"), separator)


def version_order(a: Column, b: Column) -> Column:
    """0 for equal versions, -1 if the first is newer and 1 if it is older; missing parts count as 0."""
    parts = lambda v: F.transform(F.split(v, "[.]"), lambda p: p.cast("int"))
    n = F.greatest(F.size(parts(a)), F.size(parts(b)))
    same_length = lambda v: F.concat(parts(v), F.array_repeat(F.lit(0), n - F.size(parts(v))))
    x, y = same_length(a), same_length(b)
    return F.when(x == y, 0).when(x > y, -1).when(x < y, 1)


def latex_text(text: Column) -> Column:
    """Each character that LaTeX reads as a command in its escaped form; the text is read once, so that nothing is escaped twice."""
    table = F.create_map(*(F.lit(x) for pair in LATEX.items() for x in pair))
    return F.array_join(F.transform(F.split(text, ""), lambda c: F.coalesce(F.element_at(table, c), c)), "")


def rebase_angle(angle: Column, base: Column) -> Column:
    """Degrees from base, in [-180, 180)."""
    return min_angle_diff(base, angle)


def bearing_of(east: Column, north: Column) -> Column:
    """Degrees clockwise from north, in (-180, 180]."""
    return F.degrees(F.atan2(east, north))


def speed_and_bearing(east: Column, north: Column) -> tuple[Column, Column]:
    """The inverse of bearing_vector; without speed there is no bearing."""
    speed = F.hypot(east, north)
    return speed, F.when(speed > 0, bearing_of(east, north))


def interpolated_bearing(east: Column, north: Column, first: Column, last: Column, share: Column) -> Column:
    """The bearing at a share of the way (east, north) between two bearings, in [-180, 180).

    Bearings on either side of the way turn through its direction, others along the smaller turn
    (decision Q11). A way shorter than a millionth keeps the first bearing.
    """
    zero = F.lit(0.0)
    way = bearing_of(east, north)
    a, b = rebase_angle(first, way), rebase_angle(last, way)
    through = rebase_angle(a + (b - a) * share, -way)
    turned = rebase_angle(first + min_angle_diff(first, last) * share, zero)
    return F.when(F.hypot(east, north) < 1e-6, first).when((a >= 0) != (b >= 0), through).otherwise(turned)


def nearest_power_of_10(value: Column) -> Column:
    """With the sign of value, by the rounded logarithm; 0 for 0."""
    power = F.pow(F.lit(10.0), F.round(F.log10(F.abs(value))))
    return F.when(value == 0, 0.0).otherwise(F.signum(value) * power)


def n_decimals(value: Column, most: int = 9) -> Column:
    """Digits after the point that a number needs, up to most."""
    return F.length(F.regexp_extract(fixed_text(value, most), r"[.]([0-9]*?)0*$", 1))


def degrees_of(text: Column) -> Column:
    """Positions as DDMMSS.ssssN or DDDMMSS.ssssE with any number of decimals: degrees, south and west negative; else null."""
    found = lambda i: F.regexp_extract(F.upper(F.trim(text)), r"^([0-9]{2,3})([0-9]{2})([0-9]{2}(?:[.][0-9]*)?)([NSEW])$", i)
    size = found(1).try_cast("double") + found(2).try_cast("double") / 60 + found(3).try_cast("double") / 3600
    wide = F.length(found(1)) == F.when(found(4).isin("N", "S"), 2).otherwise(3)
    limit = F.when(found(4).isin("N", "S"), 90.0).otherwise(180.0)
    return F.when(wide & (found(2).try_cast("int") < 60) & (found(3).try_cast("double") < 60) & (size <= limit), F.when(found(4).isin("S", "W"), -size).otherwise(size))


def date_text(micros: Column) -> Column:
    """YYYY-MM-DD of microseconds since 1970."""
    return F.date_add(F.lit("1970-01-01").cast("date"), F.floor(micros / 86_400_000_000).cast("int")).cast("string")


def day_time_text(micros: Column) -> Column:
    """HH:MM:SS.mmm of microseconds since 1970."""
    ms = F.floor(F.pmod(micros, F.lit(86_400_000_000)) / 1000).cast("long")
    part = lambda low, n: F.pmod(F.floor(ms / low), F.lit(n)).cast("long")
    return F.format_string("%02d:%02d:%02d.%03d", part(3_600_000, 24), part(60_000, 60), part(1000, 60), part(1, 1000))


def split_source_id(number: Column) -> tuple[Column, Column]:
    """Area and source code of a packed source number; the inverse of source_id below 255."""
    return F.floor(number / 255).cast("long"), F.pmod(number, F.lit(255)).cast("long")


def split_record_number(number: Column) -> tuple[Column, Column]:
    """Counter and content of a packed record number."""
    return F.shiftright(number, 8), number.bitwiseAND(255)
