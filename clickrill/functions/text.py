"""Scalar functions on strings and numbers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schema import UNKNOWN


def is_blank(x: Column) -> Column:
    return F.coalesce(F.trim(x) == "", F.lit(True))


def or_unknown(x: Column) -> Column:
    return F.coalesce(x, F.lit(UNKNOWN))


def as_int32(x: Column) -> Column:
    """A decimal number of 32 bits, or null; no spaces, a sign is allowed."""
    return F.when(x.rlike(r"^[+-]?[0-9]+$"), x.try_cast("int"))


def json_param(params: Column, name: str) -> Column:
    return F.get_json_object(params, f"$.{name}")


def round_half_up(x: Column, scale: int = 2) -> Column:
    """x rounded half up by its exact binary value, scale up to 8 digits. The part of x * 10**scale that the product's
    rounding takes away is recovered exactly and settles ties."""
    unit = float(10**scale)
    a = F.abs(x)
    product, split = a * unit, a * 134217729.0
    high = split - (split - a)
    lost = (high * unit - product) + (a - high) * unit
    whole = F.floor(product).cast("double")
    up = (product - whole > 0.5) | ((product - whole == 0.5) & (lost >= 0))
    return F.when(x < 0, F.lit(-1.0)).otherwise(F.lit(1.0)) * (whole + up.cast("double")) / unit


def packed_get(packed: Column, name: str, delimiter: str = "|") -> Column:
    """The value of `name` in `k=v|k=v`: the first field that is exactly name=value; null if there is none."""
    fields = F.split(packed, F.lit("\\Q" + delimiter + "\\E"))
    pairs = F.transform(fields, lambda f: F.split(f, "="))
    found = F.filter(pairs, lambda p: (_parts(p) == 2) & (p[0] == name))
    return F.get(F.get(found, F.lit(0)), F.lit(1))


def packed_set(packed: Column, name: str, value: Column, delimiter: str = "|") -> Column:
    """`k=v|k=v` with the value of every field named `name` replaced; nothing is appended."""
    fields = F.split(packed, F.lit("\\Q" + delimiter + "\\E"))
    new = F.concat(F.lit(f"{name}="), value)
    return F.array_join(F.transform(fields, lambda f: F.when((_parts(F.split(f, "=")) == 2) & (F.split(f, "=")[0] == name), new).otherwise(f)), "|")


def _parts(p: Column) -> Column:
    """How many parts a split has without the empty ones at its end."""
    return F.length(F.rtrim(F.array_join(F.transform(p, lambda x: F.when(x == "", " ").otherwise("x")), "")))


def city_count(city: Column, n: Column) -> Column:
    """city:n, with a null city as the word null."""
    return F.concat(F.coalesce(city, F.lit("null")), F.lit(":"), n.cast("string"))


def group_concat(x: Column, distinct: bool = False, separator: str = ",") -> Column:
    """An aggregate: non-null values in their order, joined."""
    values = F.collect_set(x) if distinct else F.collect_list(x)
    return F.array_join(F.sort_array(values), separator)
