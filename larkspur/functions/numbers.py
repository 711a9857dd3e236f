"""Numbers as text after a short specification, and the digits that a step between numbers asks for."""

from __future__ import annotations

from dataclasses import dataclass, replace
from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F

from larkspur.functions.formatting import SI_PREFIXES, let

MINUS = "−"
#: Digits that a double holds exactly; numbers are written with more by the JVM's own formatter.
EXACT = 15
#: Types, and what each counts its digits as (decimals or significant digits; none for whole numbers and texts).
DECIMALS, SIGNIFICANT, WHOLE = "ef%", "grps", "bodxX"


@dataclass(frozen=True)
class Spec:
    """A specification in its parts; digits is None where none are named."""

    fill: str = " "
    align: str = ">"
    sign: str = "-"
    symbol: str = ""
    zero: bool = False
    width: int | None = None
    comma: bool = False
    digits: int | None = None
    trim: bool = False
    type: str = ""


class _Scanner:
    def __init__(self, text: str) -> None:
        self.text, self.at = text, 0

    def one_of(self, letters: str) -> str:
        """The next character if it is one of `letters`, else nothing."""
        found = self.text[self.at : self.at + 1]
        if not found or found not in letters:
            return ""
        self.at += 1
        return found

    def number(self) -> int | None:
        start = self.at
        while self.one_of("0123456789"):
            pass
        return int(self.text[start : self.at]) if self.at > start else None


def parse_spec(text: str) -> Spec:
    """The parts of a specification, read from left to right: fill and align, sign, symbol, 0, width, comma, . and digits, ~, type."""
    scan, aligns = _Scanner(text), "<>=^"
    fill, align = " ", ""
    if len(text) > 1 and text[1] in aligns:
        fill, align, scan.at = text[0], text[1], 2
    else:
        align = scan.one_of(aligns)
    sign, symbol, zero = scan.one_of("+-( "), scan.one_of("$#"), bool(scan.one_of("0"))
    width, comma = scan.number(), bool(scan.one_of(","))
    digits = None
    if scan.one_of("."):
        digits = scan.number()
        if digits is None:
            raise ValueError(f"number format {text!r}: no digits after the point")
    trim, kind = bool(scan.one_of("~")), text[scan.at :]
    if len(kind) > 1 or kind and not (kind.isascii() and kind.isalpha() or kind == "%"):
        raise ValueError(f"number format {text!r}: {kind!r} is left over")
    return Spec(fill, align or ">", sign or "-", symbol, zero, width, comma, digits, trim, kind)


def _settled(spec: Spec) -> Spec:
    """With what the types imply: n is g with commas; no type, or an unknown one, is g without zeros at the end; leading zeros stand after the sign."""
    if spec.type == "n":
        spec = replace(spec, comma=True, type="g")
    elif spec.type not in DECIMALS + SIGNIFICANT + WHOLE + "c" or not spec.type:
        spec = replace(spec, digits=12 if spec.digits is None else spec.digits, trim=True, type="g")
    if spec.zero or (spec.fill, spec.align) == ("0", "="):
        spec = replace(spec, zero=True, fill="0", align="=")
    least, most = (1, 21) if spec.type in SIGNIFICANT else (0, 20)
    return replace(spec, digits=min(most, max(least, 6 if spec.digits is None else spec.digits)))


def _halves(v: Column) -> tuple[Column, Column]:
    t = v * 134217729.0
    return t - (t - v), v - (t - (t - v))


def _product(x: Column, c: Column) -> tuple[Column, Column]:
    """x * c rounded, and the rounding error (each factor is cut into halves of 26 bits)."""
    (xh, xl), (ch, cl), p = _halves(x), _halves(c), x * c
    return p, ((xh * ch - p) + xh * cl + xl * ch) + xl * cl


def _rounded(p: Column, error: Column) -> Column:
    """p + error to whole numbers, ties upwards; the error decides where p lies on a tie."""
    rest = p - F.floor(p)
    return (F.floor(p) + F.when((rest > 0.5) | (rest == 0.5) & (error >= 0), 1).otherwise(0)).cast("long")


def _fixed(x: Column, digits: int) -> Column:
    """Decimals of a number that is not negative, rounded by the exact value of the double, ties upwards."""
    c = 10.0**digits

    def text(n: Column) -> Column:
        whole = ((n - n % int(c)) / c).cast("long").cast("string")
        return F.concat(whole, F.lit("."), F.lpad((n % int(c)).cast("string"), digits, "0")) if digits else n.cast("string")

    exact = lambda v: let(F.struct(*(y.alias(k) for y, k in zip(_product(v, F.lit(c)), "pe"))), lambda s: let(_rounded(s["p"], s["e"]), text))
    return let(x, lambda v: F.when(v * c < float(1 << 52), exact(v)).otherwise(F.format_string(f"%.{digits}f", v)))


def _power(n: Column) -> Column:
    return F.pow(F.lit(10.0), n.cast("double"))


def significant(x: Column, digits: int) -> Column:
    """(digits, power) of a number that is not negative: its first `digits` digits as text, and the power of ten of the first; by the exact value, ties upwards."""
    pair = lambda text, power: F.struct(text.cast("string").alias("digits"), power.cast("int").alias("power"))
    written = lambda v: let(F.format_string(f"%.{digits - 1}e", v), lambda t: pair(F.replace(F.substring_index(t, "e", 1), F.lit(".")), F.substring_index(t, "e", -1)))

    def exact(v: Column) -> Column:
        def at(power: Column) -> Column:
            up = F.lit(digits - 1) - power
            # Below the first digits the number is divided; the remainder of the division is exact.
            divided = lambda c: let(v / c, lambda q: let(F.struct(*(y.alias(k) for y, k in zip(_product(q, c), "pe"))), lambda s: _rounded(q, (v - s["p"]) - s["e"])))
            times = lambda c: let(F.struct(*(y.alias(k) for y, k in zip(_product(v, c), "pe"))), lambda s: _rounded(s["p"], s["e"]))
            n = F.when(up >= 0, let(_power(up), times)).otherwise(let(_power(-up), divided))
            carried = lambda m: m >= 10**digits
            whole = let(n, lambda m: pair(F.when(carried(m), m / 10).otherwise(m).cast("long"), power + carried(m).cast("int")))
            # Very small and very large numbers are past the powers that a double holds.
            return F.when(F.abs(up) > 22, written(v)).otherwise(whole)

        guess = F.floor(F.log10(v)).cast("int")
        return let(guess, lambda g: let(F.when(v < _power(g), g - 1).when(v >= _power(g + 1), g + 1).otherwise(g), at))

    zero = pair(F.lit("0" * digits), F.lit(0))
    return let(x, lambda v: F.when(v == 0, zero).otherwise(written(v) if digits > EXACT else exact(v)))


def _placed(digits: Column, n: int, whole: Column) -> Column:
    """n digits with the point after the first `whole` of them; zeros fill what lies between."""
    split = lambda w: F.concat(F.substring(digits, F.lit(1), w), F.lit("."), F.substring(digits, w + 1, F.lit(n)))
    return let(whole, lambda w: F.when(w <= 0, F.concat(F.lit("0."), F.repeat(F.lit("0"), -w), digits)).when(w >= n, F.rpad(digits, w, F.lit("0"))).otherwise(split(w)))


def _scientific(s: Column, n: int) -> Column:
    head = F.substring(s["digits"], 1, 1)
    lead = F.concat(head, F.lit("."), F.substring(s["digits"], F.lit(2), F.lit(n))) if n > 1 else head
    return F.concat(lead, F.when(s["power"] < 0, F.lit("e-")).otherwise("e+"), F.abs(s["power"]).cast("string"))


def _general(s: Column, n: int) -> Column:
    """n significant digits, in scientific form below 1e-6 and where the digits don't reach the point."""
    return F.when((s["power"] < -6) | (s["power"] >= n), _scientific(s, n)).otherwise(_placed(s["digits"], n, s["power"] + 1))


def _prefix_step(s: Column) -> Column:
    return F.greatest(F.lit(-8), F.least(F.lit(8), F.floor(s["power"] / 3))).cast("int")


def _prefixed(x: Column, n: int) -> Column:
    """(text, after): n significant digits under an SI prefix, and the prefix. What is below the least prefix has the decimals that are left."""
    text = lambda s: F.when(s["power"] < -24, _fixed(x * 1e24, n - 1)).otherwise(_placed(s["digits"], n, s["power"] - _prefix_step(s) * 3 + 1))
    return let(significant(x, n), lambda s: F.struct(text(s).alias("text"), F.element_at(F.array(*map(F.lit, SI_PREFIXES)), _prefix_step(s) + 9).alias("after")))


def _trimmed(text: Column) -> Column:
    """Without zeros at the end of the decimals."""
    return F.regexp_replace(text, r"^([^.]*)(?:(\.[0-9]*?[1-9])0*|\.0*)(?![0-9])", "$1$2")


def _magnitude(x: Column, kind: str, digits: int) -> Column:
    """(text, after) of a number that is not negative: after is a prefix of thousands or a percent sign."""
    pair = lambda text, after="": F.struct(text.alias("text"), F.lit(after).alias("after"))
    if kind in WHOLE:
        def written(n: Column) -> Column:
            large = F.when(x < float(1 << 62), n.cast("string")).otherwise(F.format_string("%.0f", x))
            return {"b": F.bin(n), "o": F.conv(n.cast("string"), 10, 8), "x": F.lower(F.hex(n)), "X": F.hex(n), "d": large}[kind]

        return pair(let((F.floor(x) + F.when(x - F.floor(x) >= 0.5, 1).otherwise(0)).cast("long"), written))
    if kind == "e":
        return pair(let(significant(x, digits + 1), lambda s: _scientific(s, digits + 1)))
    if kind == "s":
        return _prefixed(x, digits)
    if kind == "g":
        return pair(let(significant(x, digits), lambda s: _general(s, digits)))
    if kind in "rp":
        return pair(let(significant(x * 100 if kind == "p" else x, digits), lambda s: _placed(s["digits"], digits, s["power"] + 1)), "%" if kind == "p" else "")
    return pair(_fixed(x * 100 if kind == "%" else x, digits), "%" if kind == "%" else "")


def _grouped(digits: Column) -> Column:
    return F.regexp_replace(digits, "(?<=[0-9])(?=(?:[0-9]{3})+$)", ",")


def format_number(x: Column, spec: str | Spec) -> Column:
    """Text of a number after a specification such as "+,.2f"; types % b c d e f g n o p r s x X, or none. The minus sign is U+2212.

    NaN is NaN, an infinite number Infinity, null null. Digits beyond the 15th are those of the JVM's formatter.
    """
    s = _settled(parse_spec(spec) if isinstance(spec, str) else spec)
    if s.type == "c":  # the number as it is, without sign, commas or digits of its own
        text = F.when(x.cast("double") == F.floor(x.cast("double")), x.cast("long").cast("string")).otherwise(x.cast("string"))
        return _padded(F.lit("$" if s.symbol == "$" else ""), F.lit(""), text, replace(s, comma=False))
    def dressed(y: Column) -> Column:
        odd = F.isnan(y) | (F.abs(y) == float("inf"))
        return let(_magnitude(F.when(odd, 0.0).otherwise(F.abs(y)), s.type, s.digits), lambda m: parts(y, odd, m))

    def parts(y: Column, odd: Column, m: Column) -> Column:
        text = F.when(F.isnan(y), "NaN").when(odd, "Infinity").otherwise(_trimmed(m["text"]) if s.trim else m["text"])
        return let(text, lambda t: let(_negative(y, odd, t, s), lambda n: joined(t, F.when(odd & F.lit(s.type == "s"), "").otherwise(m["after"]), n)))

    def joined(text: Column, after: Column, negative: Column) -> Column:
        base = "$" if s.symbol == "$" else "0" + s.type.lower() if s.symbol == "#" and s.type in "boxX" else ""
        lead = F.concat(F.when(negative, "(" if s.sign == "(" else MINUS).otherwise({"+": "+", " ": " "}.get(s.sign, "")), F.lit(base))
        after = F.concat(after, F.when(negative, ")").otherwise("")) if s.sign == "(" else after
        # Commas and leading zeros are for the digits before the point alone.
        head = text if s.type in "boxX" else F.regexp_extract(text, "^[0-9]*", 0)
        return let(F.struct(lead.alias("lead"), head.alias("head")), lambda p: let(F.concat(F.substring(text, F.length(p["head"]) + 1, F.length(text)), after), lambda tail: _padded(p["lead"], tail, p["head"], s)))

    return let(x.cast("double"), lambda y: F.when(y.isNotNull(), dressed(y)))


def _negative(y: Column, odd: Column, text: Column, s: Spec) -> Column:
    """Whether a minus is shown: what rounds to zero has none, but where a plus is asked for."""
    return (y < 0) & ~F.isnan(y) & (F.lit(s.sign == "+") | odd | text.rlike("[1-9a-fA-F]" if s.type in "xX" else "^[0.]*[1-9]"))


def _padded(lead: Column, tail: Column, head: Column, s: Spec) -> Column:
    """lead, head and tail on s.width characters; commas among zeros before the head keep to the width, but for one more zero in place of a comma."""
    if s.comma and not s.zero:
        return let(_grouped(head), lambda h: _filled(lead, tail, h, s))
    return _filled(lead, tail, head, s)


def _filled(lead: Column, tail: Column, head: Column, s: Spec) -> Column:
    if s.width is None:
        return F.concat(lead, _grouped(head) if s.comma and s.zero else head, tail)
    pad = lambda n: F.repeat(F.lit(s.fill), n.cast("int"))

    def zeros(gap: Column) -> Column:
        room = F.greatest(F.lit(0), s.width - F.length(tail))
        cut = F.right(_grouped(F.concat(pad(gap), head)), F.when(room % 4 == 0, room + 1).otherwise(room))
        return F.concat(lead, F.when(gap > 0, cut).otherwise(_grouped(head)), tail)

    def spaced(gap: Column) -> Column:
        left = F.floor(gap / 2).cast("int")
        return {">": F.concat(pad(gap), lead, head, tail), "<": F.concat(lead, head, tail, pad(gap)), "=": F.concat(lead, pad(gap), head, tail), "^": F.concat(pad(left), lead, head, tail, pad(gap - left))}[s.align]

    gap = F.greatest(F.lit(0), s.width - F.length(lead) - F.length(head) - F.length(tail)).cast("int")
    return let(gap, zeros if s.comma and s.zero else spaced)


def format_prefix(x: Column, spec: str | Spec, value: float) -> Column:
    """Text of a number in the SI prefix that suits `value`, its digits those of type f."""
    s = replace(parse_spec(spec) if isinstance(spec, str) else spec, type="f")
    step = _thousands(value)
    scaled = x * 10.0 ** (-3 * step) if step <= 0 else x / 10.0 ** (3 * step)
    return F.concat(format_number(scaled, s), F.lit(SI_PREFIXES[step + 8]))


def _place(x: float) -> int:
    """The power of ten of a number's first digit."""
    return Decimal(repr(float(x))).adjusted() if x else 0


def _thousands(value: float) -> int:
    """The SI step of a number, within the prefixes that there are."""
    return sorted((-8, _place(value) // 3, 8))[1]


def _decimals(step: float, unit: int = 0) -> int:
    """Places of a step's first digit after the point, where the point stands at the power `unit`."""
    place = _place(step)
    return len(range(place, unit))


def precision_fixed(step: float) -> int:
    """Decimals that tell multiples of a step apart."""
    return _decimals(step)


def precision_round(step: float, most: float) -> int:
    """Significant digits that do so up to a largest value: the places from the first digit of what lies below it to that of the step."""
    return max(1, len(range(_place(step), _place(abs(most) - abs(step)) + 1)))


def precision_prefix(step: float, value: float) -> int:
    """Decimals that do so when all are written with the SI prefix of a value."""
    return _decimals(step, 3 * _thousands(value))


def tick_format(x: Column, step: float, extent: float, spec: str = ",f") -> Column:
    """Text of ticks `step` apart up to `extent` in absolute value: as many digits as tell them apart, unless the specification names some."""
    s = parse_spec(spec)
    if s.digits is not None and s.type != "s":
        return format_number(x, s)
    if s.type == "s":
        return format_prefix(x, s if s.digits is not None else replace(s, digits=precision_prefix(step, extent)), extent)
    if s.type in ("", "e", "g", "p", "r"):
        s = replace(s, digits=precision_round(step, extent) - (s.type == "e"))
    elif s.type in "f%":
        s = replace(s, digits=max(0, precision_fixed(step) - 2 * (s.type == "%")))
    return format_number(x, s)
