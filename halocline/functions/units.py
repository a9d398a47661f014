"""Units: a table of symbols, and series whose unit stands in the column's metadata."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Symbol: (dimension, factor to the dimension's base unit, offset).
UNITS = {
    "m": ("length", 1.0, 0.0), "km": ("length", 1000.0, 0.0), "cm": ("length", 0.01, 0.0), "s": ("time", 1.0, 0.0), "h": ("time", 3600.0, 0.0), "d": ("time", 86400.0, 0.0),
    "m/s": ("speed", 1.0, 0.0), "cm/s": ("speed", 0.01, 0.0), "km/h": ("speed", 1 / 3.6, 0.0), "K": ("temperature", 1.0, 0.0), "degC": ("temperature", 1.0, 273.15),
    "dbar": ("pressure", 1e4, 0.0), "Pa": ("pressure", 1.0, 0.0), "1": ("none", 1.0, 0.0),
}
#: Spellings of unit attributes; what isn't listed is never guessed.
SPELLINGS = {"m s-1": "m/s", "m.s-1": "m/s", "meter second-1": "m/s", "cm s-1": "cm/s", "degrees_C": "degC", "degree_Celsius": "degC", "celsius": "degC", "kelvin": "K", "meters": "m", "metres": "m", "decibar": "dbar", "seconds": "s", "hours": "h"}


def lookup(spelling: str | None, fallback: str) -> str:
    name = (spelling or "").strip()
    return name if name in UNITS else SPELLINGS.get(name, fallback)


def unit_of(df: DataFrame, column: str) -> str | None:
    return df.schema[column].metadata.get("unit")


def with_unit(df: DataFrame, column: str, unit: str) -> DataFrame:
    if unit not in UNITS:
        raise ValueError(f"unknown unit {unit}")
    return df.withMetadata(column, df.schema[column].metadata | {"unit": unit})


def strip_units(df: DataFrame, column: str) -> DataFrame:
    return df.withMetadata(column, {k: v for k, v in df.schema[column].metadata.items() if k != "unit"})


def _scale(source: str, target: str) -> tuple[float, float]:
    (kind, a, b), (other, c, d) = UNITS[source], UNITS[target]
    if kind != other:
        raise ValueError(f"{source} and {target} have different dimensions")
    return a / c, (b - d) / c


def convert(df: DataFrame, column: str, unit: str) -> DataFrame:
    """column in another unit of its dimension."""
    factor, offset = _scale(unit_of(df, column), unit)
    return with_unit(df.withColumn(column, F.col(column) * factor + offset), column, unit)


def scale_to(df: DataFrame, column: str, like: DataFrame, other: str) -> DataFrame:
    return convert(df, column, unit_of(like, other))


def scaled(df: DataFrame, column: str, by: float) -> DataFrame:
    """column times a number; its unit stays."""
    unit = unit_of(df, column)
    out = df.withColumn(column, F.col(column) * by)
    return with_unit(out, column, unit) if unit else out


def combine(a: DataFrame, b: DataFrame, keys: list[str], column: str, sign: int = 1) -> DataFrame:
    """a + sign * b by key and time, in a's unit. Rows that one side alone has make the row's value raise when it is read."""
    unit = unit_of(a, column)
    b = convert(b, column, unit) if unit else b
    both = F.when(F.col("in_a__") & F.col("in_b__"), F.col("a__") + sign * F.col("b__")).otherwise(F.raise_error(F.lit("the series have different times")).cast("double"))
    joined = a.select(*keys, F.col(column).alias("a__"), F.lit(True).alias("in_a__")).join(b.select(*keys, F.col(column).alias("b__"), F.lit(True).alias("in_b__")), keys, "full").fillna(False, ["in_a__", "in_b__"])
    out = joined.select(*keys, both.alias(column))
    return with_unit(out, column, unit) if unit else out
