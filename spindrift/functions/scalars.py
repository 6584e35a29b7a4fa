"""Scalar functions as column expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: words that stand for true and false
TRUE_WORDS = ("1", "true", "yes", "y", "on")
FALSE_WORDS = ("0", "false", "no", "n", "off")
# fixed values: words that name an attribute type, and hints within other words
TYPE_WORDS = {
    "categorical": ("categorical", "nominal", "class", "classes", "discrete", "category", "categories"),
    "ordinal": ("ordinal", "ordered", "ranked", "rank", "ranking"),
    "continuous": ("continuous", "numeric", "number", "scalar", "real"),
}
TYPE_HINTS = {"categorical": ("categor",), "ordinal": ("ordin", "rank"), "continuous": ("contin", "numeric", "scalar")}
# fixed values: prompts for much and little of something
MUCH = ("an image with very strong presence of ", "an image with high presence of ", "an image with a lot of ")
LITTLE = ("an image with very weak presence of ", "an image with low presence of ", "an image with very little ")


def rounded(x: Column, digits: int) -> Column:
    """x to so many digits, as SQL engines in doubles have it: a half of the scaled double goes away from zero, and what is rounded to
    nothing keeps its sign (-0.0). F.round works on the decimal digits instead, and has no negative zero."""
    scale = F.lit(10.0**digits)
    r = F.signum(x) * (F.round(F.abs(x) * scale, 0) / scale)
    return F.when(F.abs(x) < F.lit(1e300 / 10.0**digits), r).otherwise(x)


def slugify(s: Column, sep: str = "-", default: str = "axis") -> Column:
    """F1."""
    x = F.regexp_replace(F.lower(F.trim(s)), "[^a-z0-9]+", sep)
    x = F.regexp_replace(x, f"^{sep}+|{sep}+$", "")
    return F.coalesce(F.nullif(x, F.lit("")), F.lit(default))


def collapse_space(s: Column) -> Column:
    """F2."""
    return F.trim(F.regexp_replace(s, r"\s+", " "))


def humanise(s: Column) -> Column:
    """F2: underscores and hyphens to blanks, spaces collapsed, first letter in upper case."""
    x = collapse_space(F.regexp_replace(s, "[_-]+", " "))
    return F.concat(F.upper(F.substring(x, 1, 1)), F.substring(x, F.lit(2), F.length(x)))


def session_name(s: Column, default: str = "session") -> Column:
    """slashes and signs that names don't have to blanks, blanks to one underscore, ends stripped, 80 characters at most."""
    x = F.regexp_replace(F.regexp_replace(s, r"[\\/]+", " "), r"[^A-Za-z0-9._ -]+", " ")
    x = F.regexp_replace(F.trim(x), r"\s+", "_")
    x = F.regexp_replace(x, r"^[._\- ]+|[._\- ]+$", "")
    return F.coalesce(F.nullif(F.substring(x, 1, 80), F.lit("")), F.lit(default))


def basename(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def stem(name: Column) -> Column:
    """A name without its last extension; a leading dot is no extension."""
    return F.regexp_replace(name, r"(?<=.)\.[^.]*$", "")


def attribute_type(s: Column) -> Column:
    """known words first, then words that hold a hint, else empty."""
    x = F.lower(F.trim(F.coalesce(s, F.lit(""))))
    out = F.lit("")
    for kind, hints in reversed(TYPE_HINTS.items()):
        for h in hints:
            out = F.when(x.contains(h), kind).otherwise(out)
    for kind, words in TYPE_WORDS.items():
        out = F.when(x.isin(*words), kind).otherwise(out)
    return out


def parse_bool(s: Column) -> Column:
    """F7."""
    x = F.lower(F.trim(s))
    return F.when(x.isin(*TRUE_WORDS), F.lit(True)).when(x.isin(*FALSE_WORDS), F.lit(False))


def parse_number(s: Column) -> Column:
    """F8: a finite number or null."""
    x = F.trim(s).try_cast("double")
    return F.when(x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))), x)


def trim_number(x: Column, digits: int = 3) -> Column:
    """a whole number within 1e-6 without point, else fixed digits without trailing zeros or point."""
    v = x.cast("double")
    s = F.format_string(f"%.{digits}f", v)
    s = F.regexp_replace(F.regexp_replace(s, r"(\.[0-9]*?)0+$", "$1"), r"\.$", "")
    return F.when(F.abs(v - F.rint(v)) < 1e-6, F.rint(v).cast("long").cast("string")).otherwise(s)


def axis_number(x: Column) -> Column:
    """fewer digits for larger magnitudes."""
    v = x.cast("double")
    a = F.abs(v)
    small = F.regexp_replace(F.regexp_replace(F.format_string("%.3f", v), "0+$", ""), r"\.$", "")
    return F.when(a >= 100, F.format_string("%.0f", v)).when(a >= 10, F.format_string("%.1f", v)).when(a >= 1, F.format_string("%.2f", v)).otherwise(small)


def clamp(x: Column, lo: float = 0.0, hi: float = 1.0) -> Column:
    return F.least(F.greatest(x, F.lit(lo)), F.lit(hi))


def sigmoid(x: Column) -> Column:
    """F10, without overflow."""
    e = F.exp(-F.abs(x))
    return F.when(x >= 0, 1 / (1 + e)).otherwise(e / (1 + e))


def log10_or_null(x: Column) -> Column:
    return F.when(x > 0, F.log10(x))


def logaddexp(a: Column, b: Column) -> Column:
    return F.greatest(a, b) + F.log1p(F.exp(-F.abs(a - b)))


def softmax(a: Column) -> Column:
    """of an array, shifted by its largest value."""
    e = F.transform(a, lambda x: F.exp(x - F.array_max(a)))
    return F.transform(e, lambda x: x / F.aggregate(e, F.lit(0.0), lambda s, y: s + y))


def bin_by_edges(x: Column, edges: Sequence[float]) -> Column:
    """how many edges are not above x (the right-hand bin at an edge)."""
    return sum((F.when(x >= F.lit(float(e)), 1).otherwise(0) for e in edges), F.lit(0)).cast("int")


def bin_label(x: Column, edges: Sequence[float]) -> Column:
    return F.concat(F.lit("bin_"), F.lpad(bin_by_edges(x, edges).cast("string"), 2, "0"))


def age_decade(x: Column) -> Column:
    """37 is 030s."""
    return F.concat(F.lpad((F.floor(x / 10) * 10).cast("string"), 3, "0"), F.lit("s"))


def floor_class(x: Column, classes: int) -> Column:
    return F.least(F.greatest(F.floor(clamp(x) * classes), F.lit(0)), F.lit(classes - 1)).cast("int")


def fixed_norm(x: Column, lo: float, hi: float) -> Column:
    """F12."""
    if not hi > lo:
        raise ValueError("bounds must rise")
    return clamp((x - F.lit(float(lo))) / F.lit(float(hi - lo)))


def unit_hash(s: Column) -> Column:
    """the first 8 bytes of the MD5 over 2**64 - 1."""
    big = F.conv(F.substring(F.md5(s), 1, 16), 16, 10).cast("decimal(20,0)").cast("double")
    return big / F.lit(float(2**64 - 1))


def stable_seed(*parts: Column) -> Column:
    """CRC-32 of the parts joined by a double bar."""
    return F.crc32(F.concat_ws("||", *[p.cast("string") for p in parts]))


def percent_segment(p: Column) -> Column:
    """decile 1..10 of a percentage, 100 in the last."""
    return F.least(F.floor(p / 10) + 1, F.lit(10)).cast("int")


def decile_centre(i: Column) -> Column:
    return i * 10 + 5


def resample(a: Column, n: int) -> Column:
    """F16: n elements of an array at even steps, both ends included."""
    last = F.size(a) - 1
    at = [F.lit(0)] if n == 1 else [F.round(last * F.lit(i / (n - 1))).cast("int") for i in range(n)]
    return F.when(F.size(a) == 0, F.slice(a, 1, 0)).otherwise(F.array(*[F.get(a, i) for i in at]))


def ordered_union(a: Column, b: Column) -> Column:
    """The elements of both in order of first use."""
    return F.array_distinct(F.concat(a, b))


def merge_maps(a: Column, b: Column) -> Column:
    """b's entries win."""
    return F.map_concat(F.map_filter(a, lambda k, v: ~F.map_contains_key(b, k)), b)


def presence_prompts(name: Column, stems: Sequence[str] = MUCH) -> Column:
    """one prompt for each stem; none for a blank name."""
    n = collapse_space(name)
    return F.when(n == "", F.slice(F.array(n), 1, 0)).otherwise(F.array(*[F.concat(F.lit(s), n) for s in stems]))


def prompt_ladder(name: Column, words: Sequence[str] = ("no", "a little", "some", "much", "extreme")) -> Column:
    return F.array(*[F.concat(F.lit(f"{w} "), collapse_space(name)) for w in words])


def retry_wait(message: Column, default: float) -> Column:
    """The seconds that a message asks to wait, at least one; else the default."""
    said = F.regexp_extract(message, r"(?i)retry in\s+([0-9]+(?:\.[0-9]+)?)s", 1).try_cast("double")
    return F.when(said.isNotNull(), F.greatest(F.lit(1.0), said)).otherwise(F.lit(float(default)))
