from lodestone.operators import graph
from lodestone.sources.catalog import TPCH, Catalog
from lodestone.sources.ddl import Column, ForeignKey, TableDef

SF = "/root/testdata/sf0.001"


def small(spark):
    """a -> b -> c, d alone, e -> a and e -> c."""
    catalog = Catalog(spark)
    for name, fks in (("a", [("b_id", "b")]), ("b", [("c_id", "c")]), ("c", []), ("d", []), ("e", [("a_id", "a"), ("c_id", "c")])):
        columns = [Column("id", "INT", primary_key=True), *[Column(k, "INT") for k, _ in fks]]
        catalog.tables[name] = TableDef(name, columns, ["id"], [ForeignKey(k, t, "id") for k, t in fks])
    return catalog


def test_paths(spark):
    catalog = small(spark)
    assert graph.shortest_path(catalog, "a", "a") == ["a"]
    assert graph.shortest_path(catalog, "a", "c") == ["a", "b", "c"]
    assert graph.shortest_path(catalog, "a", "d") is None and graph.join_path(catalog, "a", "d") is None
    path = graph.join_path(catalog, "a", "c")
    assert path.clauses == ["a.b_id = b.id", "b.c_id = c.id"] and "through b" in path.description
    assert path.reversed().tables == ["c", "b", "a"] and graph.join_path(catalog, "a", "b").description.startswith("Direct join")
    assert ("a", "d") not in graph.all_join_paths(catalog)


def test_path_in_sql_equals_search(spark):
    catalog = Catalog.of_parquet(spark, SF, TPCH)
    edges = graph.fk_edges(catalog)
    assert graph.shortest_path_of(edges, "orders", "region").first()["path"].split(">") == graph.shortest_path(catalog, "orders", "region")
    assert graph.shortest_path_of(edges, "orders", "nothing").count() == 0


def test_linked_tables(spark):
    catalog = small(spark)
    assert graph.with_linked_tables(catalog, ["a"]) == ["a", "b"]
    assert graph.with_linked_tables(catalog, ["a", "c"]) == ["a", "b", "c", "e"]
    got = {r["table_name"]: r["reason"] for r in graph.linked_tables_df(catalog, ["a", "c"]).collect()}
    assert got == {"a": "selected", "c": "selected", "b": "referenced", "e": "bridge"}
    assert graph.safe_selection(catalog, ["a"]) == ["a", "b", "c", "d", "e"] and graph.safe_selection(catalog, ["a", "b", "c"]) == ["a", "b", "c"]


def test_semantics(spark):
    got = {(r["table_name"], r["column_name"]): r["semantic"] for r in graph.field_semantics(small(spark)).collect()}
    assert got["a", "id"] == "primary_key" and got["a", "b_id"] == "foreign_key"


def test_link_output(spark):
    catalog = small(spark)
    assert graph.parse_link_output("x\nTABLES: a, b\nmore\nCONTEXT: why\nso") == (["a", "b"], "why\nso")
    assert graph.parse_link_output("a, b\nrest") == (["a", "b"], "")
    assert graph.resolve_selection(catalog, ["`A`", "zz", "b", "a"]) == ["a", "b"]
    assert graph.resolve_selection(catalog, ["all"]) == ["a", "b", "c", "d", "e"] and graph.resolve_selection(catalog, ["None"]) == []
