"""Values whose type changes from row to row, as a dynamically typed database stores them.

A column of such values is a VARIANT. Its values compare by storage class first (numbers, then texts, then blobs) and within a
class by value; numbers compare exactly, whole or not. Everything is a column expression, so it stays in the JVM; the same
expressions are temporary SQL functions for rewritten statements.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

#: Affinities: those of columns (blob, that of a column without a type, leaves values as they are), and none, that of literals
#: and other expressions.
NUMERIC, TEXT, BLOB, NONE = "numeric", "text", "blob", "none"

#: Text that is a number as a whole, and one without a fraction or exponent. Blanks around it do not count.
NUMBER = r"^\s*[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?\s*$"
WHOLE = r"^\s*[+-]?[0-9]+\s*$"

_CLASS = "schema_of_variant(v)"


def _sql(text: str) -> str:
    return " ".join(text.replace("{class}", _CLASS).split())


#: Temporary SQL functions: signature and body.
FUNCTIONS = {
    # a double and what a whole number is more than it: exact where doubles are not
    "storage_key(v VARIANT) RETURNS STRUCT<kind: INT, number: DOUBLE, more: BIGINT, bytes: BINARY>": _sql("""
        CASE WHEN v IS NULL OR is_variant_null(v) THEN NULL
        WHEN {class} = 'BIGINT' THEN named_struct('kind', 1, 'number', cast(try_variant_get(v, '$', 'bigint') AS DOUBLE),
          'more', cast(cast(try_variant_get(v, '$', 'bigint') AS DECIMAL(38, 0)) - cast(cast(try_variant_get(v, '$', 'bigint') AS DOUBLE) AS DECIMAL(38, 0)) AS BIGINT), 'bytes', X'')
        WHEN {class} RLIKE '^(DOUBLE|FLOAT|DECIMAL)' THEN if(isnan(try_variant_get(v, '$', 'double')), NULL, named_struct('kind', 1, 'number', try_variant_get(v, '$', 'double') + 0.0D, 'more', 0L, 'bytes', X''))
        WHEN {class} = 'BOOLEAN' THEN named_struct('kind', 1, 'number', if(try_variant_get(v, '$', 'boolean'), 1.0D, 0.0D), 'more', 0L, 'bytes', X'')
        WHEN {class} = 'BINARY' THEN named_struct('kind', 3, 'number', 0.0D, 'more', 0L, 'bytes', try_variant_get(v, '$', 'binary'))
        ELSE named_struct('kind', 2, 'number', 0.0D, 'more', 0L, 'bytes', cast(try_variant_get(v, '$', 'string') AS BINARY)) END"""),
    "storage_class(v VARIANT) RETURNS STRING": _sql("""
        CASE WHEN v IS NULL OR is_variant_null(v) THEN 'null' WHEN {class} IN ('BIGINT', 'BOOLEAN') THEN 'integer'
        WHEN {class} RLIKE '^(DOUBLE|FLOAT|DECIMAL)' THEN if(isnan(try_variant_get(v, '$', 'double')), 'null', 'real') WHEN {class} = 'BINARY' THEN 'blob' ELSE 'text' END"""),
    # what a column of this affinity would hold
    "numeric_storage(v VARIANT) RETURNS VARIANT": _sql(f"""
        CASE WHEN {{class}} <> 'STRING' THEN v
        WHEN try_variant_get(v, '$', 'string') RLIKE '{WHOLE.replace(chr(92), chr(92) * 2)}' AND try_cast(trim(try_variant_get(v, '$', 'string')) AS BIGINT) IS NOT NULL
          THEN cast(try_cast(trim(try_variant_get(v, '$', 'string')) AS BIGINT) AS VARIANT)
        WHEN try_variant_get(v, '$', 'string') RLIKE '{NUMBER.replace(chr(92), chr(92) * 2)}' THEN cast(try_cast(trim(try_variant_get(v, '$', 'string')) AS DOUBLE) AS VARIANT) ELSE v END"""),
    "real_text(x DOUBLE) RETURNS STRING": _sql("""
        CASE WHEN x = floor(x) AND abs(x) < 1e15D THEN concat(cast(cast(x AS BIGINT) AS STRING), '.0')
        WHEN cast(x AS STRING) LIKE '%E-_' THEN replace(cast(x AS STRING), 'E-', 'e-0') WHEN cast(x AS STRING) LIKE '%E-%' THEN replace(cast(x AS STRING), 'E-', 'e-')
        WHEN cast(x AS STRING) LIKE '%E_' THEN replace(cast(x AS STRING), 'E', 'e+0') WHEN cast(x AS STRING) LIKE '%E%' THEN replace(cast(x AS STRING), 'E', 'e+') ELSE cast(x AS STRING) END"""),
    "storage_text(v VARIANT) RETURNS STRING": _sql("""
        CASE WHEN {class} RLIKE '^(DOUBLE|FLOAT|DECIMAL)' THEN real_text(try_variant_get(v, '$', 'double'))
        WHEN {class} = 'BOOLEAN' THEN if(try_variant_get(v, '$', 'boolean'), '1', '0') ELSE try_variant_get(v, '$', 'string') END"""),
    "text_storage(v VARIANT) RETURNS VARIANT": _sql("CASE WHEN {class} IN ('VOID', 'BINARY') THEN v ELSE cast(storage_text(v) AS VARIANT) END"),
    # the number that a text begins with, 0 without one
    "storage_number(v VARIANT) RETURNS DOUBLE": _sql(r"""
        CASE WHEN v IS NULL OR is_variant_null(v) THEN NULL WHEN {class} IN ('STRING', 'BINARY')
          THEN coalesce(try_cast(nullif(regexp_extract(try_variant_get(v, '$', 'string'), '^\\s*([+-]?(?:[0-9]+\\.?[0-9]*|\\.[0-9]+)(?:[eE][+-]?[0-9]+)?)', 1), '') AS DOUBLE), 0.0D)
        WHEN {class} = 'BOOLEAN' THEN if(try_variant_get(v, '$', 'boolean'), 1.0D, 0.0D) ELSE try_variant_get(v, '$', 'double') END"""),
}


def key_of(expression: str) -> str:
    """The SQL of storage_key() of an expression, without the function."""
    body = next(b for s, b in FUNCTIONS.items() if s.startswith("storage_key("))
    return "(" + re.sub(r"\bv\b", lambda _: f"({expression})", body) + ")"


def install(spark: SparkSession) -> None:
    for signature, body in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {signature} RETURN {body}")


def _call(name: str, v: Column) -> Column:
    return F.call_function(name, v)


def stored(value: Column, affinity: str = BLOB) -> Column:
    """A value of any simple type as a column of this affinity stores it."""
    v = value.cast("variant")
    return {NUMERIC: lambda: _call("numeric_storage", v), TEXT: lambda: _call("text_storage", v)}.get(affinity, lambda: v)()


def storage_class(v: Column) -> Column:
    """null, integer, real, text or blob."""
    return _call("storage_class", v)


def storage_key(v: Column) -> Column:
    """What a value sorts and compares by; null for null, so ascending order has nulls first as usual."""
    return _call("storage_key", v)


def _with_affinities(a: Column, b: Column, affinity_a: str, affinity_b: str) -> tuple[Column, Column]:
    if NUMERIC in (affinity_a, affinity_b):  # applies to the side that has none of its own, or text's
        return (a if affinity_a == NUMERIC else _call("numeric_storage", a)), (b if affinity_b == NUMERIC else _call("numeric_storage", b))
    if TEXT in (affinity_a, affinity_b) and NONE in (affinity_a, affinity_b):
        return (a if affinity_a == TEXT else _call("text_storage", a)), (b if affinity_b == TEXT else _call("text_storage", b))
    return a, b


def compared(a: Column, op: str, b: Column, affinity_a: str = BLOB, affinity_b: str = BLOB) -> Column:
    """a op b of two variants, for = <> < <= > >=; null if either is. The sides' affinities are those of their columns; literals and
    expressions have none."""
    a, b = (storage_key(x) for x in _with_affinities(a, b, affinity_a, affinity_b))
    return {"=": a == b, "<>": a != b, "<": a < b, "<=": a <= b, ">": a > b, ">=": a >= b}[op]


def least_of(v: Column) -> Column:
    """The least value of a group; nulls do not count. Of equal ones (1 and 1.0) some one."""
    return F.min_by(v, storage_key(v))


def greatest_of(v: Column) -> Column:
    return F.max_by(v, storage_key(v))


def sum_of(v: Column) -> Column:
    """The sum of a group: whole if all its values are whole numbers or texts of such, else real; other texts count as the number
    they begin with. Null without values."""
    v = _call("numeric_storage", v)
    whole = F.count_if(~storage_class(v).isin("integer", "null")) == 0
    total = F.sum(F.when(storage_class(v) == "integer", F.try_variant_get(v, "$", "bigint")))
    return F.when(whole, total.cast("variant")).otherwise(F.sum(_call("storage_number", v)).cast("variant"))


def ordered(df: DataFrame, *columns: str, descending: tuple[str, ...] = ()) -> DataFrame:
    """df in the order of its variant columns."""
    keys = {c: f"_key{i}" for i, c in enumerate(columns)}
    df = df.withColumns({k: storage_key(F.col(c)) for c, k in keys.items()})
    return df.orderBy(*[F.col(k).desc() if c in descending else F.col(k).asc() for c, k in keys.items()]).drop(*keys.values())


def counted(df: DataFrame, column: str, n: str = "n") -> DataFrame:
    """(column, n): the distinct values of a variant column by comparison, so 1 and 1.0 are one, each with how often it occurs."""
    groups = df.groupBy(storage_key(F.col(column)).alias("_key")).agg(F.any_value(column).alias(column), F.count(F.lit(1)).alias(n))
    return groups.select(column, n)


def joined(left: DataFrame, right: DataFrame, a: str, b: str, affinity_a: str = BLOB, affinity_b: str = BLOB, how: str = "inner") -> DataFrame:
    """An equi join of two variant columns, by hash or sort of their keys."""
    x, y = _with_affinities(F.col(a), F.col(b), affinity_a, affinity_b)
    left, right = left.withColumn("_left", storage_key(x)), right.withColumn("_right", storage_key(y))
    return left.join(right, F.col("_left") == F.col("_right"), how).drop("_left", "_right")


def plain(v: Column) -> Column:
    """(class, text) of a value, for comparison with what the database itself shows."""
    return F.struct(storage_class(v).alias("class"), _call("storage_text", v).alias("text"))


def is_variant(kind: T.DataType | None) -> bool:
    return isinstance(kind, T.VariantType)
