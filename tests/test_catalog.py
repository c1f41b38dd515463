"""Every registered query that has SQL gives the rows of DuckDB on the smallest tables."""

import ast
import glob
import math
import os

import duckdb
import pytest

from factweave.plans import catalog, grounding, substrate, verification

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for path in glob.glob(f"{DATA}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


@pytest.fixture(scope="module", autouse=True)
def worked_out_once():
    """Closures, lookup tables and the walk are the same in all queries that use them: each is worked out once here."""
    before = []

    def once(name, *modules):
        plain, held = getattr(modules[0], name), {}

        def memo(spark, *rest, **named):
            key = (*rest, *named.items())
            if key not in held:
                held[key] = plain(spark, *rest, **named)
            return held[key]

        for module in modules:
            before.append((module, name, getattr(module, name)))
            setattr(module, name, memo)

    once("paths", grounding, verification, substrate)
    once("walked", verification)
    once("_nodes", verification)
    once("literals", verification)
    yield
    for module, name, plain in before:
        setattr(module, name, plain)


def cell(x):
    if x is None or (isinstance(x, float) and math.isnan(x)):
        return None
    return round(float(x), 6) if isinstance(x, (int, float)) and not isinstance(x, bool) else x


def rows(names, found):
    order = sorted(range(len(names)), key=names.__getitem__)
    return sorted(([cell(r[i]) for i in order] for r in found), key=lambda r: [(x is not None, str(x)) for x in r])


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_query_gives_the_rows_of_its_sql(spark, db, name):
    df = catalog.QUERIES[name](spark, DATA)
    got = db.execute(catalog.SQL[name])
    names = [c[0] for c in got.description]
    assert sorted(df.columns) == sorted(names)
    assert rows(df.columns, df.collect()) == rows(names, got.fetchall())


def test_every_query_is_named_once():
    assert set(catalog.SQL) <= set(catalog.QUERIES)


@pytest.mark.parametrize("path", sorted(glob.glob(f"{os.path.dirname(catalog.__file__)}/*.py")))
def test_no_name_stands_for_two_views_or_queries(path):
    """The second of two equal keys would silently take the place of the first."""
    with open(path) as file:
        tree = ast.parse(file.read())
    for node in ast.walk(tree):
        keys = [k.value for k in node.keys if isinstance(k, ast.Constant)] if isinstance(node, ast.Dict) else []
        assert len(keys) == len(set(keys)), sorted({k for k in keys if keys.count(k) > 1})
