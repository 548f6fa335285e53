"""Map keys and identifiers built from or parsed into parts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def map_key(area: Column, x: Column, z: Column) -> Column:
    """mAA_XX_ZZ; null if a part is null."""
    return F.when(area.isNotNull() & x.isNotNull() & z.isNotNull(), F.format_string("m%02d_%02d_%02d", area.cast("int"), x.cast("int"), z.cast("int")))


def short_key(key: Column) -> Column:
    """The first three parts of a map key."""
    return F.substring_index(key, "_", 3)


def _two_digits(number: Column) -> Column:
    """The number in decimal with two digits at least; lpad() alone would cut longer ones."""
    text = number.cast("string")
    return F.when(F.length(text) < 2, F.lpad(text, 2, "0")).otherwise(text)


def bytes_key(parts: Column) -> tuple[Column, Column]:
    """(key, wildcard) of an array of bytes: 255 is a wildcard and written as 00; null out of range."""
    ok = F.forall(parts, lambda b: b.between(0, 255)) & (F.size(parts) == 4)
    text = F.array_join(F.transform(parts, lambda b: _two_digits(F.when(b == 255, 0).otherwise(b))), "_")
    return F.when(ok, F.concat(F.lit("m"), text)), F.when(ok, F.array_contains(parts, 255))


def packed_key(v: Column) -> Column:
    """Three decimal bytes and a hexadecimal one from a packed 32-bit number."""
    byte = lambda n: F.shiftright(v.cast("bigint"), n).bitwiseAND(F.lit(255))
    return F.concat(F.lit("m"), F.concat_ws("_", *[_two_digits(byte(n)) for n in (24, 16, 8)], F.lpad(F.hex(byte(0)), 2, "0")))


def digits_key(v: Column, pad: bool = False) -> Column:
    """mAA_BB_CC_DD from an 8-digit number; other lengths give null, or are padded with zeros."""
    text = F.lpad(v.cast("string"), 8, "0") if pad else v.cast("string")
    return F.when((F.length(text) == 8) & text.rlike("^[0-9]+$"), F.concat(F.lit("m"), F.concat_ws("_", *[F.substring(text, i, 2) for i in (1, 3, 5, 7)])))


def model_name(model_id: Column) -> Column:
    return F.format_string("h%06d", model_id.cast("int"))


def model_id(name: Column) -> Column:
    return F.coalesce(
        F.when(name.rlike("(?i)^h[0-9]+$"), F.regexp_extract(name, "([0-9]+)", 1)),
        F.when(name.rlike(r"(?i)[0-9]{6}\.hkx$"), F.regexp_extract(name, r"([0-9]{6})\.hkx", 1))).try_cast("int")


def under(key: Column, prefix) -> Column:
    """The key is the prefix or below it; m10_0 is not above m10_00."""
    p = F.lit(prefix) if isinstance(prefix, str) else prefix
    return (key == p) | key.startswith(F.concat(p, F.lit("_")))


def position(x: Column, y: Column, z: Column) -> Column:
    """[x, y, z] as doubles; null unless all are finite numbers."""
    axes = [a.try_cast("double") for a in (x, y, z)]
    ok = F.lit(True)
    for a in axes:
        ok = ok & a.isNotNull() & ~F.isnan(a) & (F.abs(a) < F.lit(float("inf")))
    return F.when(ok, F.array(*axes))


def clamp_limit(value, missing: int = 100, wrong: int = 100, most: int = 1000) -> int:
    """The caller's limit between 1 and most; wrong if it is no whole number, missing if it is None."""
    if value is None or value == "":
        return missing
    try:
        return min(max(int(value), 1), most)
    except (TypeError, ValueError):
        return wrong


def arguments_map(args: Column) -> Column:
    """name -> value of an array of (name, value) structs; of repeated names the last counts."""
    later = lambda i: F.transform(F.slice(args, i + 2, F.size(args)), lambda y: y["name"])
    last = F.filter(args, lambda x, i: x["name"].isNotNull() & ~F.coalesce(F.array_contains(later(i), x["name"]), F.lit(False)))
    return F.map_from_entries(F.transform(last, lambda x: F.struct(x["name"], x["value"])))


def first_argument(args: Column, *names: str) -> Column:
    """The value of the first of the alternative names that the map of arguments holds."""
    return F.coalesce(*[F.get(F.map_values(F.map_filter(args, _is_key(n))), F.lit(0)) for n in names])


def _is_key(name: str):
    return lambda k, v: k == name


def synthetic_id(family: str, *parts: Column) -> Column:
    """family:part:part...; null if a part is null."""
    return F.concat(F.lit(family), *[x for p in parts for x in (F.lit(":"), p.cast("string"))])


def natural_key(text: Column) -> Column:
    """Sorts by the first number in the text, then by the text: area 2 before area 10, texts without a number last."""
    number = F.regexp_extract(text, "([0-9]+)", 1).try_cast("bigint")
    return F.struct(number.isNull().alias("none"), number.alias("number"), text.alias("text"))
