"""Scalars of dynamic type as struct<t, v>: t is s, n, b or z (an explicit null), v the value as text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SCALAR = "struct<t:string,v:string>"
SCALARS = f"map<string,{SCALAR}>"
# The patterns of redaction.
EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"
PHONE = r"\+?\d[\d\s().-]{7,}\d"


def number_text(x: Column) -> Column:
    """A number as text, integral values without a point (20 rather than 20.0)."""
    d = x.cast("double")
    whole = (d == F.floor(d)) & (F.abs(d) < 1e15)
    return F.when(whole, d.cast("decimal(20,0)").cast("string")).otherwise(d.cast("string"))


def scalar(kind: str, value: Column) -> Column:
    return F.when(value.isNull(), F.struct(F.lit("z").alias("t"), F.lit(None).cast("string").alias("v"))).otherwise(F.struct(F.lit(kind).alias("t"), value.cast("string").alias("v")))


def text(value: Column) -> Column:
    return scalar("s", value)


def number(value: Column) -> Column:
    return scalar("n", number_text(value))


def boolean(value: Column) -> Column:
    return scalar("b", value)


def literal(value) -> Column:
    """A Python scalar as a scalar column."""
    if value is None:
        return scalar("z", F.lit(None).cast("string"))
    if isinstance(value, bool):
        return boolean(F.lit(value))
    if isinstance(value, (int, float)):
        return number(F.lit(float(value)))
    return text(F.lit(str(value)))


def is_categorical(s: Column) -> Column:
    """May the scalar be the value of a condition? Booleans, integers, and short strings that are no surrogate."""
    t, v = s["t"], s["v"]
    short = (F.char_length(v) <= 40) & ~v.rlike(r"(^|#)[0-9a-f]{12,}$")
    d = v.cast("double")
    return F.coalesce(F.when(t == "b", F.lit(True)).when(t == "n", d == F.floor(d)).when(t == "s", short).otherwise(F.lit(False)), F.lit(False))


def token(corpus: str | Column, slot: str | Column, value: Column) -> Column:
    """A surrogate that keeps equality within a corpus and slot: slot#12 hex digits."""
    c = F.lit(corpus) if isinstance(corpus, str) else corpus
    s = F.lit(slot) if isinstance(slot, str) else slot
    return F.concat(s, F.lit("#"), F.substring(F.sha2(F.concat(c, F.char(F.lit(0)), s, F.char(F.lit(0)), value).cast("binary"), 256), 1, 12))


def hashed(value: Column) -> Column:
    return F.concat(F.lit("h#"), F.substring(F.sha2(value.cast("binary"), 256), 1, 24))


def replace_matches(value: Column, pattern: str, surrogate) -> Column:
    """Every match of ``pattern`` replaced by ``surrogate(match)``, without a UDF."""
    rest = F.split(value, pattern, -1)
    found = F.transform(F.regexp_extract_all(value, F.lit(pattern), F.lit(0)), lambda m: surrogate(m))
    return F.array_join(F.zip_with(rest, found, lambda a, b: F.concat(a, F.coalesce(b, F.lit("")))), "")


def digits(least: int = 6) -> str:
    return rf"\d{{{least},}}"


def emit(p: Column, assert_at: float, refute_at: float) -> Column:
    """True from ``assert_at`` on, false up to ``refute_at``, null between."""
    return F.when(p >= assert_at, True).when(p <= refute_at, False)


def percent(x: Column) -> Column:
    return F.format_string("%.1f%%", x * 100)


def label_of(type_id: Column) -> Column:
    """A type's label where none is declared: without its prefix, dashes and underscores as spaces."""
    return F.regexp_replace(F.regexp_replace(type_id, r"^[a-z]+:", ""), r"[_-]+", " ")
