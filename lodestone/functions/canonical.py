"""Values as canonical text, so that results of different types can be compared."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T

#: Doubles from here on have no fraction; their digits come from a decimal.
_WHOLE = 1e18


def canonical(column: Column, kind: T.DataType) -> Column:
    """Canonical text of a value: whole numbers without fraction, others in their shortest form without exponent,
    booleans in lower case. Null stays null, so it only equals null."""
    if isinstance(kind, (T.FloatType, T.DoubleType)):
        x = column.cast("double") + F.lit(0.0)  # -0.0 becomes 0.0
        text = x.cast("string")
        stripped = lambda d: F.regexp_replace(F.regexp_replace(d.cast("string"), "0+$", ""), "\\.$", "")
        tiny, large = x.try_cast("decimal(38,37)"), x.try_cast("decimal(38,17)")
        return (
            F.when(F.isnan(x) | (F.abs(x) == float("inf")), text)
            .when(F.abs(x) >= _WHOLE, F.format_string("%.0f", x))
            .when(x == F.floor(x), x.try_cast("long").cast("string"))
            .when(~text.contains("E"), text)
            .when(F.abs(x) >= 1, stripped(large))
            .when(tiny != 0, stripped(tiny))
            .otherwise(text)  # below 1e-37: as it is
        )
    if isinstance(kind, T.DecimalType):
        text = column.cast("string")
        return F.when(text.contains("."), F.regexp_replace(F.regexp_replace(text, "0+$", ""), "\\.$", "")).otherwise(text)
    if isinstance(kind, T.BinaryType):
        return column.cast("string")
    if isinstance(kind, (T.ArrayType, T.MapType, T.StructType)):
        return F.to_json(column)
    return column.cast("string")


def canonical_frame(df: DataFrame, names: list[str] | None = None) -> DataFrame:
    """df with every column as canonical text, named c0, c1, ... or as given."""
    numbered = df.toDF(*[f"c{i}" for i in range(len(df.columns))])
    return numbered.select(*[canonical(F.col(f"c{i}"), f.dataType).alias(names[i] if names else f"c{i}") for i, f in enumerate(df.schema.fields)])


def normalized(text: Column) -> Column:
    """Looser text: trimmed; times without zone and fraction; other values without one closing percent sign."""
    t = F.trim(text)
    time_like = t.contains("-") & (t.contains(":") | t.contains("UTC") | t.contains("+0000"))
    time = F.regexp_replace(F.regexp_replace(F.regexp_replace(t, r" \+.*$", ""), " UTC.*$", ""), r"\.[0-9][^.]*$", "")
    return F.when(time_like, time).otherwise(F.regexp_replace(t, "%$", ""))


def loosely_equal(a: Column, b: Column) -> Column:
    """Equal after trimming, or as numbers by their leading digits; null equals null."""
    x, y = F.trim(a), F.trim(b)
    number = r"^\s*([+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?)"
    p, q = _try_double(F.regexp_extract(x, number, 1)), _try_double(F.regexp_extract(y, number, 1))
    return x.eqNullSafe(y) | F.coalesce(p == q, F.lit(False))


def _try_double(text: Column) -> Column:
    return F.when(text != "", text).try_cast("double")
