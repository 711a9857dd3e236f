"""Scalar column functions: sizes, names, numbers, text codecs and type inference."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Units of sizes, and prefixes of powers of a thousand from -8 to 8.
UNITS = ("B", "KB", "MB", "GB", "TB")
SI_PREFIXES = ("y", "z", "a", "f", "p", "n", "µ", "m", "", "k", "M", "G", "T", "P", "E", "Z", "Y")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with `value` computed once, however often the body names it."""
    return F.transform(F.array(value), body)[0]


def even(x: Column, digits: int) -> Column:
    """Rounded to `digits` places by the double moved by as many, its ties to even: 1.015, which lies below the tie, is 1.01."""
    return F.rint(x * 10.0**digits) / 10.0**digits


def fixed(x: Column, digits: int) -> Column:
    """Decimal text with `digits` places, exact ties to even."""
    return F.format_string(f"%.{digits}f", even(x, digits))


def format_size(size: Column) -> Column:
    """Bytes in the largest of B, KB, MB, GB, TB that is not above the size; sizes below 1 are 0 B."""
    size = size.cast("double")
    out = F.when(size <= 0, F.lit("0 B"))
    for k in range(1, len(UNITS)):
        out = out.when(size < 1024**k, F.concat(fixed(size / 1024 ** (k - 1), 2), F.lit(f" {UNITS[k - 1]}")))
    return out.otherwise(F.concat(fixed(size / 1024 ** (len(UNITS) - 1), 2), F.lit(f" {UNITS[-1]}")))


def extension(name: Column) -> Column:
    """Lower-case text after the last dot of a file name, empty without one."""
    return F.lower(F.regexp_extract(name, r"\.([^.]*)$", 1))


def valid(x: Column) -> Column:
    """The number, with NaN as null: statistics pass over both."""
    return F.when(~F.isnan(x), x)


def si_number(x: Column, digits: int = 3) -> Column:
    """Number to `digits` significant digits with an SI prefix from y to Y, trailing zeros kept; 9996 is 10.0k, as it rounds to more digits."""
    def shape(power: Column) -> tuple[Column, Column, Column]:
        group = F.least(F.greatest(F.floor(power / 3), F.lit(-8)), F.lit(8))
        return group, x / F.pow(F.lit(10.0), group * 3), F.greatest(F.lit(0), F.lit(digits - 1) - (power - group * 3)).cast("int")

    power = F.floor(F.log10(F.abs(x)))
    _, scaled, places = shape(power)
    carried = F.lit(False)
    for p in range(digits):
        carried = F.when(places == p, even(F.abs(scaled), p) >= 10 ** (digits - p)).otherwise(carried)
    group, scaled, places = shape(power + carried.cast("int"))
    text = F.lit(None).cast("string")
    for p in range(digits - 1, -1, -1):
        text = F.when(places == p, fixed(scaled, p)).otherwise(text)
    text = F.coalesce(text, fixed(scaled, 0))
    return F.when(x == 0, fixed(F.lit(0.0), digits - 1)).otherwise(F.concat(text, F.element_at(F.array(*map(F.lit, SI_PREFIXES)), (group + 9).cast("int"))))


def grouped_number(x: Column, digits: int = 2) -> Column:
    """Fixed-point text with commas between thousands."""
    return F.format_number(x, digits)


def is_date(t: Column) -> Column:
    """Whether a text is a calendar date (year, month or day), with or without a time of day (to minutes, seconds or thousandths) and a zone."""
    date, clock = F.split_part(t, F.lit("T"), F.lit(1)), F.when(t.contains("T"), F.substring_index(t, "T", -1)).otherwise(F.lit("00:00"))
    years = F.regexp_replace(date, "^[+-][0-9]{2}(?=[0-9]{4})", "")
    day = F.when(F.length(years) == 4, F.concat(years, F.lit("-01-01"))).when(F.length(years) == 7, F.concat(years, F.lit("-01"))).otherwise(years)
    calendar = (F.length(day) == 10) & F.try_to_timestamp(day, F.lit("yyyy-MM-dd")).isNotNull()
    zone = F.regexp_extract(clock, "(Z|[+-][0-9]{2}:[0-9]{2})$", 1)
    time = F.regexp_replace(clock, "(Z|[+-][0-9]{2}:[0-9]{2})$", "")
    shape = F.when(F.length(time) == 5, "HH:mm").when(F.length(time) == 8, "HH:mm:ss").when(F.length(time) == 12, "HH:mm:ss.SSS")
    known = shape.isNotNull() & F.coalesce(*(F.when(shape == s, F.try_to_timestamp(time, F.lit(s))) for s in ("HH:mm", "HH:mm:ss", "HH:mm:ss.SSS"))).isNotNull()
    return F.coalesce(calendar & known & ((zone == "") | t.contains("T")), F.lit(False))


def auto_type(text: Column) -> Column:
    """Name of the type that a trimmed text stands for: null, boolean, nan, number, date or string."""
    t = F.trim(text)
    number = t.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$") | t.rlike(r"^0[xX][0-9a-fA-F]+$") | t.isin("Infinity", "-Infinity", "+Infinity")
    return F.when(text.isNull() | (t == ""), "null").when(t.isin("true", "false"), "boolean").when(t == "NaN", "nan").when(number, "number").when(t.rlike("^[+-]?[0-9]{4}") & is_date(t), "date").otherwise("string")


def auto_value(text: Column) -> Column:
    """kind, flag, number, at: the type that auto_type names and the value, in the field of its type; text stays where it is.

    NaN is a number here. A date without a time of day is midnight in UTC, one with a time but no zone is in the session's zone.
    """
    def read(t: Column, kind: Column) -> Column:
        hexadecimal = F.conv(F.substring(t, F.lit(3), F.length(t)), 16, 10).cast("double")
        infinite = F.when(t.startswith("-"), float("-inf")).otherwise(float("inf"))
        plain = F.when(t.rlike("^0[xX]"), hexadecimal).when(t.endswith("Infinity"), infinite).otherwise(t.try_cast("double"))
        number = F.when(kind == "nan", float("nan")).when(kind == "number", plain)
        day = F.when(F.length(t) == 4, F.concat(t, F.lit("-01-01"))).when(F.length(t) == 7, F.concat(t, F.lit("-01"))).otherwise(t)
        at = F.try_to_timestamp(F.when(t.contains("T"), F.regexp_replace(t, "T([0-9]{2}:[0-9]{2})(?=$|[Z+-])", "T$1:00")).otherwise(F.concat(day, F.lit("T00:00:00Z"))))
        return F.struct(kind.alias("kind"), F.when(kind == "boolean", t == "true").alias("flag"), number.alias("number"), F.when(kind == "date", at).alias("at"))

    return let(F.trim(text), lambda t: let(auto_type(text), lambda kind: read(t, kind)))


def url_encode(text: Column) -> Column:
    """Percent encoding of all but letters, digits and - _ . ! ~ * ' ( )."""
    out = F.url_encode(text)
    for a, b in (("+", "%20"), ("%21", "!"), ("%27", "'"), ("%28", "("), ("%29", ")"), ("%7E", "~")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def url_decode(text: Column) -> Column:
    """The inverse of url_encode; a plus sign stays one, and null for broken percent codes."""
    return F.try_url_decode(F.replace(text, F.lit("+"), F.lit("%2B")))


def xml_escape(text: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ("'", "&apos;"), ('"', "&quot;")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def xml_unescape(text: Column) -> Column:
    for a, b in (("&lt;", "<"), ("&gt;", ">"), ("&apos;", "'"), ("&quot;", '"'), ("&amp;", "&")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def percent(used: Column, total: Column, digits: int = 1) -> Column:
    """100 * used / total, rounded half to even, and 0 where the total is 0."""
    return F.when(total == 0, F.lit(0.0)).otherwise(F.bround(100 * used / total, digits))
