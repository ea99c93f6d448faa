"""Undeclared keys against sets of values, and what works on plain files with them."""

import random

import pytest

from lodestone.operators import graph, keys, profile
from lodestone.plans import registry
from lodestone.sources.catalog import KEYS, Catalog

SF = "/root/testdata/sf0.001"


def catalog_of(spark, tables):
    catalog = Catalog(spark)
    for name, (schema, rows) in tables.items():
        catalog.add(name, spark.createDataFrame(rows, schema))
    return catalog


@pytest.fixture(scope="module")
def shop(spark):
    """Dense, sparse and text keys, nulls, orphans, an empty column, repeated values, names of both conventions."""
    rng = random.Random(3)
    wide = [rng.randrange(-(2**62), 2**62) for _ in range(60)]
    codes = [f"code {i}é" for i in range(40)]
    return {
        "customers": ("id long, wide long, code string, twice int", [(i - 20, wide[i], codes[i % 40] if i < 40 else f"x{i}", i // 2) for i in range(60)]),
        "sales": ("id int, customer_id int, wide long, code string, empty string, orphan short", [(i, None if i % 9 == 0 else i % 50 - 20, wide[i % 30], codes[i % 25], None, i % 300 - 20) for i in range(900)]),
        "marks": ("of_code string, n int", [(codes[0], 5), (None, None), ("unknown", 7)]),
        "none": ("id long", []),
    }


def brute(tables, most_missing=0.0):
    columns = {}
    for t, (schema, rows) in tables.items():
        for i, c in enumerate(schema.split(", ")):
            name, kind = c.split()
            columns[t, name] = kind == "string", [r[i] for r in rows]
    found = []
    for a, (text, values) in columns.items():
        own = {v for v in values if v is not None}
        for b, (other, of_key) in columns.items():
            if own and of_key and a != b and text == other and None not in of_key and len(set(of_key)) == len(of_key):
                missing = len(own - set(of_key))
                if missing <= most_missing * len(own):
                    found.append((*a, *b, len(own), missing, len(own) - missing, (len(own) - missing) / len(of_key)))
    return sorted(found)


@pytest.mark.parametrize("most_missing", [0.0, 0.2, 0.9])
def test_inclusions_equal_sets(spark, shop, most_missing):
    assert [tuple(r) for r in keys.inclusions(catalog_of(spark, shop), most_missing).collect()] == brute(shop, most_missing)


def test_sparse_numbers_go_through_the_filter(spark, shop):
    facts = {(f.table, f.column): f for f in keys.column_facts(catalog_of(spark, shop))}
    assert not facts["customers", "wide"].dense and facts["customers", "id"].dense and ("sales", "empty") not in facts


def test_filter_with_few_places_loses_nothing(spark, shop, monkeypatch):
    monkeypatch.setattr(keys, "FILTER_BITS", 3)
    monkeypatch.setattr(keys, "PLACES_A_VALUE", 0)
    assert [tuple(r) for r in keys.inclusions(catalog_of(spark, shop)).collect()] == brute(shop)


def test_inferred_names(spark, shop):
    got = {(t, fk.column): (fk.referenced_table, fk.referenced_column) for t, fk in keys.inferred_keys(catalog_of(spark, shop))}
    assert got["sales", "customer_id"] == ("customers", "id") and got["sales", "wide"] == ("customers", "wide")
    assert ("sales", "id") not in got and ("sales", "orphan") not in got
    assert keys.singular("categories") == "category" and keys.singular("class") == "class" and keys.singular("orders") == "order"


def test_all_declared_keys_are_found(spark):
    catalog = Catalog.of_parquet(spark, SF, tuple(KEYS), keys={})
    assert catalog.foreign_keys() == []
    whole = keys.with_inferred_keys(catalog)
    declared = Catalog.of_parquet(spark, SF, tuple(KEYS))
    assert set(declared.foreign_keys()) <= set(whole.foreign_keys())
    assert graph.join_path(whole, "lineitem", "region").tables == graph.join_path(declared, "lineitem", "region").tables
    assert graph.with_linked_tables(whole, ["orders"]) == graph.with_linked_tables(declared, ["orders"])
    assert all(r["orphan_count"] == 0 for r in profile.orphan_counts(whole).collect())
    assert whole.tables["customer"].primary_key == ["c_custkey"]


def test_no_tables(spark):
    assert keys.inclusions(Catalog(spark)).count() == 0 and keys.inferred_keys(catalog_of(spark, {"none": ("id long", [])})) == []


def test_the_coverage_of_inferred_keys_takes_one_search(spark, shop, monkeypatch):
    catalog, searches, search = catalog_of(spark, shop), [], keys.inclusions
    of = {tuple(r)[:4]: r["coverage"] for r in search(catalog).collect()}
    for t, fk, covered in keys.inferred_coverage(catalog):
        assert covered == of[t, fk.column, fk.referenced_table, fk.referenced_column]
    monkeypatch.setattr(keys, "inclusions", lambda *a: searches.append(a) or search(*a))
    assert registry.QUERIES["inferred_foreign_keys"](spark, SF).count() > 0 and len(searches) == 1
