"""Scalar functions on columns: numbers, timestamps, positions, display."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: FIT stores degrees as 32-bit fractions of a half turn.
SEMICIRCLE = 180.0 / 2**31
SECONDS = "decimal(38,18)"
#: Upper bounds of the speed colours in m/s. Fixed values of the display.
SPEED_BINS = (1.5, 2.5, 3.5, 4.5)


def number_code(text: Column) -> Column:
    """Null where a text is null or a finite number that a double can hold, else the code of what is wrong."""
    value = text.try_cast("double")
    digits = F.regexp_replace(F.lower(text), "e.*$", "").rlike("[1-9]")
    named = F.lower(F.trim(text)).isin("nan", "inf", "+inf", "-inf", "infinity", "+infinity", "-infinity")
    return (
        F.when(text.isNull(), None)
        .when(named, "NONFINITE_NUMERIC_VALUE")
        .when(value.isNull() | text.rlike("[dDfF]\\s*$"), "INVALID_NUMERIC_VALUE")
        .when(F.isnan(value) | (F.abs(value) == float("inf")), "NONFINITE_NUMERIC_VALUE")
        .when((value == 0) & digits, "NUMERIC_PRECISION_UNREPRESENTABLE")
    )


def finite(value: Column) -> Column:
    return value.isNotNull() & ~F.isnan(value) & (F.abs(value) != float("inf"))


def canonical_number(value: Column) -> Column:
    """Finite and not the negative zero, which would be another text for the same number."""
    return finite(value) & ~value.cast("string").isin("-0.0", "-0")


def in_domain(lon: Column, lat: Column) -> Column:
    return finite(lon) & finite(lat) & lon.between(-180, 180) & lat.between(-90, 90)


def semicircles(value: Column) -> Column:
    return value * F.lit(SEMICIRCLE)


def utc_seconds(text: Column) -> Column:
    """Seconds since 1970 of ``YYYY-MM-DDThh:mm:ss[.digits]Z`` as DECIMAL(38,18); null if it isn't one, or a leap second.

    Digits after the 18th are not held; ``utc_is_exact`` tells.
    """
    whole = F.regexp_extract(text, r"^(\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2})(\.\d+)?Z$", 1)
    part = F.regexp_extract(text, r"^(\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2})(\.\d+)?Z$", 2)
    at = F.try_to_timestamp(F.when(whole != "", F.concat(F.replace(whole, F.lit("T"), F.lit(" ")), F.lit("+00:00"))), F.lit("yyyy-MM-dd HH:mm:ssXXX"))
    digits = F.rpad(F.substring(part, 2, 18), 18, "0")
    return F.unix_seconds(at).cast(SECONDS) + F.when(part == "", F.lit(0).cast(SECONDS)).otherwise(F.concat(F.lit("0."), digits).cast(SECONDS))


def utc_is_exact(text: Column) -> Column:
    return ~text.rlike(r"\.\d{18}\d*[1-9]\d*Z$")


def utc_text(micros: Column) -> Column:
    """Microseconds since 1970 as UTC text."""
    return F.concat(F.date_format(F.timestamp_micros(micros), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.lit("Z"))


def interpolate(a: Column, b: Column, fraction: Column) -> Column:
    """The coordinate at a fraction of an edge; a itself at 0."""
    return F.when(fraction == 0, a).otherwise(a + fraction * (b - a))


def dominant_fraction(x0: Column, y0: Column, x1: Column, y1: Column, x: Column, y: Column) -> Column:
    """Where a point of an edge lies on it, read on the axis of the larger extent (the first on ties)."""
    return F.when(F.abs(x1 - x0) >= F.abs(y1 - y0), (x - x0) / F.nullif(x1 - x0, F.lit(0.0))).otherwise((y - y0) / F.nullif(y1 - y0, F.lit(0.0)))


def ulp(x: Column) -> Column:
    """The distance from |x| to the next double, for normal numbers."""
    return F.when(x == 0, F.lit(2.0**-1074)).otherwise(F.pow(F.lit(2.0), F.floor(F.log2(F.abs(x))) - 52))


def position(part: Column | str, observation: Column | str, fraction: Column | str) -> Column:
    """A place on a track; structs compare in its order. Fraction 1 is the next observation."""
    f = F.col(fraction) if isinstance(fraction, str) else fraction
    o = F.col(observation) if isinstance(observation, str) else observation
    p = F.col(part) if isinstance(part, str) else part
    return F.struct(p.alias("part_index"), F.when(f == 1, o + 1).otherwise(o).alias("observation_index"), F.when(f == 1, F.lit(0.0)).otherwise(f + 0.0).alias("fraction_to_next"))


def pace_text(speed: Column) -> Column:
    """Minutes and seconds for a kilometre, m:ss."""
    seconds = F.round(1000 / F.nullif(speed, F.lit(0.0))).cast("long")
    return F.concat(F.floor(seconds / 60).cast("string"), F.lit(":"), F.lpad((seconds % 60).cast("string"), 2, "0"))


def speed_bin(speed: Column) -> Column:
    """0 to 4 by the display's bounds."""
    out = F.when(speed < SPEED_BINS[0], 0)
    for k, bound in enumerate(SPEED_BINS[1:], 1):
        out = out.when(speed < bound, k)
    return F.when(speed.isNull(), None).otherwise(out.otherwise(len(SPEED_BINS))).cast("int")


def screen_point(x: Column, y: Column, box: Column, width: int = 940, height: int = 640) -> Column:
    """A coordinate in a drawing of that size that shows ``box`` (min_x, min_y, max_x, max_y); north is up."""
    wide = F.greatest(box["max_x"] - box["min_x"], F.lit(1e-12))
    high = F.greatest(box["max_y"] - box["min_y"], F.lit(1e-12))
    scale = F.least(width / wide, height / high)  # one for both axes, the drawing in the middle
    left, top = (width - (box["max_x"] - box["min_x"]) * scale) / 2, (height - (box["max_y"] - box["min_y"]) * scale) / 2
    return F.struct((left + (x - box["min_x"]) * scale).alias("x"), (top + (box["max_y"] - y) * scale).alias("y"))


def escape_html(text: Column) -> Column:
    out = F.replace(text, F.lit("&"), F.lit("&amp;"))
    for char, name in (("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        out = F.replace(out, F.lit(char), F.lit(name))
    return out


def escape_json(text: Column) -> Column:
    """JSON that may stand inside a script element."""
    out = text
    for char in "<>&":
        out = F.replace(out, F.lit(char), F.lit(f"\\u{ord(char):04x}"))
    return out


def is_sha256(text: Column) -> Column:
    return text.rlike("^[0-9a-f]{64}$")


def code_of(issue: Column) -> Column:
    """The code before the first colon."""
    return F.split_part(issue, F.lit(":"), F.lit(1))


def json_path(parts: Column) -> Column:
    """``$[0]["x"]`` of an array of names and indices as text."""
    shown = F.transform(parts, lambda p: F.when(p.rlike("^[0-9]+$"), F.concat(F.lit("["), p, F.lit("]"))).otherwise(F.concat(F.lit('["'), p, F.lit('"]'))))
    return F.concat(F.lit("$"), F.array_join(shown, ""))
