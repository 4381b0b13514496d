"""Canonical JSON of nested columns: keys in order, one space after a comma and a colon, other characters than ASCII as they are.

Two structs whose fields come in another order have one text, and so one hash."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

_SHORT = {"\b": "\\b", "\t": "\\t", "\n": "\\n", "\f": "\\f", "\r": "\\r"}


def _text(s: Column) -> Column:
    plain = F.replace(F.replace(s, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
    marked = plain
    for code in range(32):
        marked = F.replace(marked, F.lit(chr(code)), F.lit(_SHORT.get(chr(code), f"\\u{code:04x}")))
    return F.concat(F.lit('"'), F.when(s.rlike(r"[\x00-\x1F]"), marked).otherwise(plain), F.lit('"'))


def _number(x: Column) -> Column:
    """A double with its shortest digits: plain from 0.0001 to below 1e16, else with a signed exponent of two digits."""
    s = F.abs(x).cast("string")
    e = F.split_part(s, F.lit("E"), F.lit(2)).try_cast("int")
    mantissa = F.regexp_replace(F.split_part(s, F.lit("E"), F.lit(1)), r"\.0$", "")
    digits = F.replace(mantissa, F.lit("."), F.lit(""))
    whole = F.rpad(F.substring(digits, F.lit(1), e + 1), e + 1, F.lit("0"))
    rest = F.substring(digits, e + 2, F.lit(400))
    plain = F.concat(whole, F.lit("."), F.when(rest == "", "0").otherwise(rest))
    small = F.concat(F.lit("0."), F.repeat(F.lit("0"), -e - 1), digits)
    power = F.concat(mantissa, F.when(e < 0, "e-").otherwise("e+"), F.lpad(F.abs(e).cast("string"), F.greatest(F.lit(2), F.length(F.abs(e).cast("string"))), F.lit("0")))
    size = F.when(e.isNull(), s).when(e.between(0, 15), plain).when(e.between(-4, -1), small).otherwise(power)
    special = F.when(F.isnan(x), "NaN").when(x == float("inf"), "Infinity").when(x == float("-inf"), "-Infinity")
    return F.coalesce(special, F.concat(F.when((x < 0) | ((x == 0) & F.startswith(x.cast("string"), F.lit("-"))), "-").otherwise(""), size))


def canonical_json(value: Column, kind: T.DataType, leave_out: tuple[str, ...] = ()) -> Column:
    """The canonical JSON of a column of the given type. leave_out: fields of the outermost struct that aren't written."""
    if isinstance(kind, T.StructType):
        parts = [F.concat(_text(F.lit(f.name)), F.lit(": "), canonical_json(value[f.name], f.dataType)) for f in sorted(kind.fields, key=lambda f: f.name) if f.name not in leave_out]
        out = F.concat(F.lit("{"), F.concat_ws(", ", *parts), F.lit("}"))
    elif isinstance(kind, T.ArrayType):
        out = F.concat(F.lit("["), F.array_join(F.transform(value, lambda x: canonical_json(x, kind.elementType)), ", "), F.lit("]"))
    elif isinstance(kind, T.MapType) and isinstance(kind.keyType, T.StringType):
        entries = F.sort_array(F.transform(F.map_entries(value), lambda e: F.struct(e["key"].alias("k"), canonical_json(e["value"], kind.valueType).alias("v"))))
        out = F.concat(F.lit("{"), F.array_join(F.transform(entries, lambda e: F.concat(_text(e["k"]), F.lit(": "), e["v"])), ", "), F.lit("}"))
    elif isinstance(kind, T.StringType):
        out = _text(value)
    elif isinstance(kind, T.BooleanType):
        out = F.when(value, "true").otherwise("false")
    elif isinstance(kind, (T.DoubleType, T.FloatType)):
        out = _number(value.cast("double"))
    elif isinstance(kind, T.IntegralType):
        out = value.cast("string")
    else:
        raise TypeError(f"no canonical JSON for {kind.simpleString()}")
    return F.when(value.isNull(), "null").otherwise(out)


def canonical_hash(value: Column, kind: T.DataType, leave_out: tuple[str, ...] = ()) -> Column:
    """Lower-case hex SHA-256 of the canonical JSON."""
    return F.sha2(canonical_json(value, kind, leave_out), 256)
