"""Keys that nobody declared: unique columns, and inclusion dependencies between columns and unique ones.

Files declare no foreign keys, so the graph, the orphans and the linking have nothing to work on. Here candidates come from one
aggregation over each table. Pairs of columns stay in question only while their ranges and counts allow an inclusion. The
sets of values of the rest are bitmaps: exact ones for whole numbers that lie densely enough, else Bloom filters of one hash,
whose survivors are checked by one join each. Only facts about columns and pairs reach the driver, as many as the schema has.
"""

from __future__ import annotations

import math
import os.path
from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F, types as T

from ..sources.catalog import Catalog
from ..sources.ddl import ForeignKey
from .profile import ticked

#: A column of whole numbers has an exact bitmap if its range has at most so many places for each of its values.
PLACES_A_VALUE = 64
#: Places of a Bloom filter.
FILTER_BITS = 26
#: Slack of approximate distinct counts, whose standard error is 5 %: pairs and keys are given up only beyond it.
SLACK = 1.3
#: Names that many tables use for their own key, and which say nothing about another table's.
GENERIC = ("id", "key", "code", "name")

INCLUSION = "table_name string, column_name string, referenced_table string, referenced_column string, distinct_count long, missing_count long, covered_count long, coverage double"


@dataclass
class Fact:
    """What one pass tells of a column: whole is whether its values are whole numbers (else texts)."""

    table: str
    column: str
    whole: bool
    rows: int
    filled: int
    distinct: int
    low: object
    high: object

    @property
    def dense(self) -> bool:
        return self.whole and self.high - self.low < PLACES_A_VALUE * max(1, self.distinct)


def column_facts(catalog: Catalog) -> list[Fact]:
    """Facts of all columns of whole numbers or texts, empty ones left out; one aggregation for each table."""
    found = []
    for table, df in sorted(catalog.frames.items()):
        kinds = {f.name: f.dataType for f in df.schema.fields if isinstance(f.dataType, (T.IntegralType, T.StringType))}
        if not kinds:
            continue
        sums = [F.count(F.lit(1)).alias("rows")]
        for i, name in enumerate(kinds):
            x = ticked(name)
            sums += [F.count(x).alias(f"filled{i}"), F.approx_count_distinct(x).alias(f"distinct{i}"), F.min(x).alias(f"low{i}"), F.max(x).alias(f"high{i}")]
        one = df.agg(*sums).first()
        for i, (name, kind) in enumerate(kinds.items()):
            if one[f"filled{i}"]:
                found.append(Fact(table, name, isinstance(kind, T.IntegralType), one["rows"], *(one[f"{k}{i}"] for k in ("filled", "distinct", "low", "high"))))
    return found


def unique_columns(catalog: Catalog, facts: list[Fact]) -> list[Fact]:
    """Columns without nulls and repeated values. Approximate counts rule most others out; the rest are grouped, texts by digest.
    Their distinct counts are exact afterwards."""
    found = []
    for f in facts:
        if f.filled == f.rows and f.distinct * SLACK >= f.rows:
            x = ticked(f.column)
            key = x if f.whole else F.md5(x.cast("binary"))
            if catalog.frames[f.table].groupBy(key.alias("k")).agg(F.count(F.lit(1)).alias("n")).filter("n > 1").isEmpty():
                f.distinct = f.rows
                found.append(f)
    return found


def candidate_pairs(facts: list[Fact], keys: list[Fact]) -> list[tuple[Fact, Fact]]:
    """(column, key) whose kinds, ranges and counts do not rule out that all of the column's values are the key's."""
    return [
        (c, k) for c in facts for k in keys
        if (c.table, c.column) != (k.table, k.column) and c.whole == k.whole and k.low <= c.low and c.high <= k.high and c.distinct <= SLACK * k.distinct
    ]


def _bitmaps(catalog: Catalog, columns: list[Fact], exact: bool) -> DataFrame | None:
    """(id, bucket, bits) of the sets of values of columns, by their places in the list: 32,768 places a row."""
    out = None
    for i, f in enumerate(columns):  # each column alone: those of few values are put together without sorting
        x = ticked(f.column)
        place = x.cast("long") if exact else F.shiftrightunsigned(F.xxhash64(x.cast("string")), 64 - FILTER_BITS)
        rows = catalog.frames[f.table].filter(x.isNotNull()).select(F.lit(i).alias("id"), place.alias("v"))
        part = rows.groupBy("id", F.expr("bitmap_bucket_number(v)").alias("bucket")).agg(F.expr("bitmap_construct_agg(bitmap_bit_position(v))").alias("bits"))
        out = part if out is None else out.union(part)
    return out


def _overlaps(catalog: Catalog, pairs: list[tuple[Fact, Fact]], exact: bool) -> dict[int, tuple[int, int]]:
    """For the place of each pair: how many places of the column's bitmap there are, and how many of them the key's lacks."""
    columns = list({(f.table, f.column): f for pair in pairs for f in pair}.values())
    at = {(f.table, f.column): i for i, f in enumerate(columns)}
    sides = [(n, at[f.table, f.column], side == 1) for n, pair in enumerate(pairs) for side, f in enumerate(pair)]
    if not sides:
        return {}
    wanted = catalog.spark.createDataFrame(sides, "pair int, id int, is_key boolean")  # two rows for each pair of columns
    met = _bitmaps(catalog, columns, exact).join(F.broadcast(wanted), "id")
    own = lambda is_key: F.max(F.when(F.col("is_key") == F.lit(is_key), F.expr("bitmap_count(bits)")))
    by_bucket = met.groupBy("pair", "bucket").agg(F.expr("bitmap_count(bitmap_or_agg(bits))").alias("both"), own(True).alias("of_key"), own(False).alias("of_column"))
    sums = by_bucket.groupBy("pair").agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("both", "of_key", "of_column")])
    return {r["pair"]: (r["of_column"], r["both"] - r["of_key"]) for r in sums.collect()}  # a row for each pair of columns


def _joined(catalog: Catalog, column: Fact, key: Fact) -> tuple[int, int]:
    """(distinct values of the column, those that the key lacks), by one join."""
    values = catalog.frames[column.table].select(ticked(column.column).alias("v")).filter("v IS NOT NULL").distinct()
    keys = catalog.frames[key.table].select(ticked(key.column).alias("k"))
    one = values.join(keys, F.col("v") == F.col("k"), "left").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("k").isNull()).alias("missing")).first()
    return one["n"], one["missing"]


def inclusions(catalog: Catalog, most_missing: float = 0.0) -> DataFrame:
    """The inclusion dependencies between the catalog's columns and its unique columns.

    distinct_count: values of the column; missing_count: those that the key lacks, at most the share most_missing of them;
    covered_count and coverage: the key's values that the column uses, and their share. With most_missing above 0, the ranges
    may differ, so more pairs are compared. Null values take no part, empty columns neither.
    """
    facts = column_facts(catalog)
    keys = unique_columns(catalog, facts)
    if most_missing > 0:
        pairs = [(c, k) for c in facts for k in keys if (c.table, c.column) != (k.table, k.column) and c.whole == k.whole and c.distinct * (1 - most_missing) <= SLACK * k.distinct]
    else:
        pairs = candidate_pairs(facts, keys)
    known = {(k.table, k.column): k.rows for k in keys}
    rows = []
    few = [p for p in pairs if p[0].dense and p[1].dense]
    rest = [p for p in pairs if not (p[0].dense and p[1].dense)]
    found = [(few[n], *v) for n, v in _overlaps(catalog, few, True).items()]
    for n, (places, missing) in _overlaps(catalog, rest, False).items():
        if missing <= most_missing * places + (math.sqrt(places) if most_missing else 0):  # values that share a place count once there
            found.append((rest[n], *_joined(catalog, *rest[n])))
    for (c, k), distinct, missing in found:
        if missing <= most_missing * distinct:
            covered = distinct - missing
            rows.append((c.table, c.column, k.table, k.column, distinct, missing, covered, covered / known[k.table, k.column]))
    return catalog.spark.createDataFrame(sorted(rows), INCLUSION)


def stems(catalog: Catalog, table: str) -> dict[str, str]:
    """The columns' names in lower case, without a prefix up to an underscore that all of the table's columns share."""
    names = catalog.frames[table].columns
    prefix = os.path.commonprefix([n.lower() for n in names]) if len(names) > 1 else ""
    prefix = prefix[: prefix.rfind("_") + 1]
    return {n: n.lower()[len(prefix) :] for n in names}


def singular(name: str) -> str:
    return name[:-3] + "y" if name.endswith("ies") else name[:-1] if name.endswith("s") and not name.endswith("ss") else name


def named_alike(catalog: Catalog, table: str, column: str, key_table: str, key: str) -> bool:
    """Whether a column's name says that it refers to the key: it is the key's own name, or that behind the key's table."""
    own, other = stems(catalog, table)[column], stems(catalog, key_table)[key]
    target = key_table.lower()
    of_table = {f"{t}{gap}{other}" for t in (target, singular(target)) for gap in ("_", "")}
    return own in of_table or own == other and table != key_table and own not in GENERIC


def inferred_coverage(catalog: Catalog, most_missing: float = 0.0) -> list[tuple[str, ForeignKey, float]]:
    """(table, foreign key, coverage) for the inclusions whose names agree: for each column the key that it covers most, ties to the
    first in the alphabet. Of two tables that include each other, the one later in the alphabet refers to the other."""
    best: dict[tuple[str, str], tuple[float, str, str]] = {}
    rows = [tuple(r)[:4] + (r["coverage"],) for r in inclusions(catalog, most_missing).collect()]  # as many as pairs of columns
    pairs = {r[:4] for r in rows}
    for table, column, key_table, key, coverage in rows:
        mutual = (key_table, key, table, column) in pairs and (table, column) < (key_table, key)
        if not mutual and named_alike(catalog, table, column, key_table, key):
            best[table, column] = min(best.get((table, column), (0.0, "~", "")), (-coverage, key_table, key))
    return [(t, ForeignKey(c, key_table, key), -covered) for (t, c), (covered, key_table, key) in sorted(best.items())]


def inferred_keys(catalog: Catalog, most_missing: float = 0.0) -> list[tuple[str, ForeignKey]]:
    """(table, foreign key) of inferred_coverage()."""
    return [(t, fk) for t, fk, _ in inferred_coverage(catalog, most_missing)]


def with_inferred_keys(catalog: Catalog, most_missing: float = 0.0) -> Catalog:
    """A catalog with the unique columns that are referred to as primary keys, where none is declared, and the inferred foreign
    keys beside the declared ones: so the graph, the paths, the linking and the orphan check work on plain files."""
    out = Catalog(catalog.spark, name=catalog.name)
    inferred = inferred_keys(catalog, most_missing)
    referred = {fk.referenced_table: fk.referenced_column for _, fk in inferred}
    for table, df in catalog.frames.items():
        declared = catalog.tables[table]
        out.tables[table] = declared
        key = declared.primary_key or ([referred[table]] if table in referred else [])
        out.add(table, df, key, [fk for t, fk in inferred if t == table])
    return out
