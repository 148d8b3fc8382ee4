"""Pinned text rendering, row digests, log positions and small parsers, all as
Catalyst column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

SEPARATOR, NULL = "\x1f", "\\N"


def rendered(column: Column, kind: T.DataType, scale: int = 6) -> Column:
    """A value's text, the same whatever the session's settings.

    Doubles go through a fixed decimal scale, timestamps through one pattern and
    booleans through one letter, so that a digest depends on the value alone."""
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        exact = F.when(F.isnan(column), F.lit("NaN")).when(F.abs(column) == float("inf"), F.when(column > 0, "Infinity").otherwise("-Infinity"))
        return exact.otherwise(column.cast(f"decimal(30,{scale})").cast("string"))
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        return F.date_format(column, "yyyy-MM-dd HH:mm:ss.SSSSSS")
    if isinstance(kind, T.BooleanType):
        return F.when(column, F.lit("t")).otherwise(F.when(~column, F.lit("f")))
    if isinstance(kind, T.BinaryType):
        return F.lower(F.hex(column))
    if isinstance(kind, (T.ArrayType, T.StructType, T.MapType)):
        return F.to_json(column)
    return column.cast("string")


def escaped(text: Column) -> Column:
    """No separator and no null token survives inside a value: empty, null and the
    token's own text stay three different things."""
    out = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    return F.coalesce(F.replace(out, F.lit(SEPARATOR), F.lit("\\x1f")), F.lit(NULL))


def row_text(df_schema: T.StructType, columns: list[str], prefix: str = "") -> Column:
    parts = [escaped(rendered(F.col(prefix + c), df_schema[c].dataType)) for c in columns]
    return F.concat_ws(SEPARATOR, *parts)


def row_digest(df_schema: T.StructType, columns: list[str], prefix: str = "") -> Column:
    """MD5 of the rendered row (128 bits, equal in every engine)."""
    return F.md5(row_text(df_schema, columns, prefix))


def key_identity(columns: list[str]) -> Column:
    """The key as a JSON array of texts."""
    return F.to_json(F.array(*[F.col(c).cast("string") for c in columns]))


def lsn_parse(text: Column) -> Column:
    """``X/Y`` in hexadecimal as an exact number (unsigned 64 bits)."""
    wide = "decimal(20,0)"
    high, low = F.split_part(text, F.lit("/"), F.lit(1)), F.split_part(text, F.lit("/"), F.lit(2))
    return (F.conv(high, 16, 10).cast(wide) * F.lit(4294967296).cast(wide) + F.conv(low, 16, 10).cast(wide)).cast(wide)


def lsn_format(value: Column) -> Column:
    value = value.cast("decimal(20,0)")
    high, low = F.floor(value / F.lit(4294967296)).cast("bigint"), (value % F.lit(4294967296)).cast("bigint")
    return F.concat(F.hex(high), F.lit("/"), F.hex(low))


def lsn_lag(ahead: Column, behind: Column) -> Column:
    """Bytes between two positions, never negative."""
    return F.greatest(ahead - behind, F.lit(0))


def canonical_locale(text: Column) -> Column:
    """Lower case, ``POSIX`` as ``C``, code-set punctuation dropped, modifier kept."""
    value = F.lower(F.trim(text))
    base, modifier = F.regexp_extract(value, "^([^@]*)", 1), F.regexp_extract(value, "(@.*)$", 1)
    name, codeset = F.regexp_extract(base, r"^([^.]*)", 1), F.regexp_extract(base, r"\.(.*)$", 1)
    name = F.when(name == "posix", "c").otherwise(name)
    return F.when(codeset == "", F.concat(name, modifier)).otherwise(
        F.concat(name, F.lit("."), F.regexp_replace(codeset, "[-_]", ""), modifier))


def parse_bytes(text: Column) -> Column:
    """A size with an optional unit as bytes; null where it is none."""
    value = F.trim(text)
    number = F.regexp_extract(value, r"^(-?\d+)\s*[A-Za-z ]*$", 1)
    unit = F.lower(F.trim(F.regexp_extract(value, r"^-?\d+\s*([A-Za-z ]*)$", 1)))
    factor = (
        F.when(unit.isin("", "b"), 0).when(unit == "kb", 10).when(unit == "mb", 20).when(unit == "gb", 30).when(unit == "tb", 40))
    return F.when(number != "", number.cast("bigint") * F.pow(F.lit(2.0), factor).cast("bigint"))


def format_bytes(value: Column) -> Column:
    """In the largest unit that divides the size exactly."""
    out = F.concat(value.cast("string"), F.lit("B"))
    for suffix, size in (("kB", 1 << 10), ("MB", 1 << 20), ("GB", 1 << 30)):
        out = F.when((value >= size) & (value % size == 0), F.concat((value / size).cast("bigint").cast("string"), F.lit(suffix))).otherwise(out)
    return out


def parse_seconds(text: Column) -> Column:
    """A duration with an optional unit in seconds; null where it is none."""
    value = F.trim(text)
    number = F.regexp_extract(value, r"^(-?[\d.]+)\s*[a-zA-Z]*$", 1)
    unit = F.lower(F.regexp_extract(value, r"^-?[\d.]+\s*([a-zA-Z]*)$", 1))
    factor = (
        F.when(unit.isin("", "s"), 1.0).when(unit == "us", 1e-6).when(unit == "ms", 1e-3)
        .when(unit == "min", 60.0).when(unit == "h", 3600.0).when(unit == "d", 86400.0))
    return F.when(number != "", number.cast("double") * factor)


def format_seconds(value: Column) -> Column:
    whole = value.cast("bigint")
    out = F.concat(whole.cast("string"), F.lit("s"))
    for suffix, size in (("min", 60), ("h", 3600), ("d", 86400)):
        out = F.when((whole >= size) & (whole % size == 0), F.concat((whole / size).cast("bigint").cast("string"), F.lit(suffix))).otherwise(out)
    return F.when(whole.cast("double") != value, F.concat((value * 1000).cast("bigint").cast("string"), F.lit("ms"))).otherwise(out)


def compact_count(value: Column) -> Column:
    return (
        F.when(value >= 1_000_000_000, F.concat(F.format_string("%.1f", value / 1e9), F.lit("B")))
        .when(value >= 1_000_000, F.concat(F.format_string("%.1f", value / 1e6), F.lit("M")))
        .when(value >= 10_000, F.concat(F.format_string("%.0f", value / 1e3), F.lit("k")))
        .otherwise(value.cast("string")))


def quote_identifier(text: Column) -> Column:
    return F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))


def quote_literal(text: Column) -> Column:
    return F.concat(F.lit("'"), F.replace(text, F.lit("'"), F.lit("''")), F.lit("'"))


def copy_text(text: Column) -> Column:
    r"""A value in tab-separated bulk-load text: ``\N`` for null, controls escaped."""
    out = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    for raw, short in (("\t", "\\t"), ("\n", "\\n"), ("\r", "\\r"), ("\b", "\\b"), ("\f", "\\f"), ("\v", "\\v")):
        out = F.replace(out, F.lit(raw), F.lit(short))
    return F.coalesce(out, F.lit(NULL))


def array_literal(values: Column) -> Column:
    r"""A text array as ``{"a",NULL}`` with backslash escapes."""
    def one(x: Column) -> Column:
        safe = F.replace(F.replace(x, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
        return F.coalesce(F.concat(F.lit('"'), safe, F.lit('"')), F.lit("NULL"))

    return F.concat(F.lit("{"), F.array_join(F.transform(values, one), ","), F.lit("}"))


def normal_definition(text: Column) -> Column:
    """White space folded, a trailing NOT VALID dropped."""
    return F.regexp_replace(F.trim(F.regexp_replace(text, r"\s+", " ")), r"(?i) NOT VALID$", "")


def tool_major(text: Column) -> Column:
    """Major version of a tool's version line; null where there is none."""
    found = F.regexp_extract(text, r"\) (\d+)", 1)
    return F.when(found != "", found.cast("int"))


def failure_signature(sqlstate: Column, message: Column) -> Column:
    return F.when(F.coalesce(sqlstate, F.lit("")) != "", sqlstate).otherwise(F.sha2(message, 256))


def connection_lost(sqlstate: Column) -> Column:
    """Whether an error is of the connection, so that trying again may help."""
    state = F.coalesce(sqlstate, F.lit(""))
    return state.startswith("08") | state.isin("57P01", "57P02", "57P03")


def headroom(current: Column, low: Column, high: Column, increment: Column) -> Column:
    """Values a sequence can still hand out; exact over the whole 64-bit range."""
    wide = lambda c: c.cast("decimal(20,0)")
    up = F.greatest(wide(high) - wide(current), F.lit(0))
    down = F.greatest(wide(current) - wide(low), F.lit(0))
    return F.when(increment < 0, down).otherwise(up).cast("decimal(20,0)")
