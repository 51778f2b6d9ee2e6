import ast
from pathlib import Path

import pytest

import __spark_entry__ as entry

ROOT = Path(__file__).parent.parent
DATA = Path("/root/testdata/sf0.001")


def test_core_does_not_use_the_text_package():
    for p in (ROOT / "tessera").rglob("*.py"):
        if p.parent.name == "llm":
            continue
        for node in ast.walk(ast.parse(p.read_text())):
            names = [a.name for a in node.names] if isinstance(node, ast.Import) else [node.module or ""] if isinstance(node, ast.ImportFrom) else []
            assert not any(n.startswith("tessera.llm") for n in names), p


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries()) and len(entry.queries()) >= 70


@pytest.mark.skipif(not DATA.exists(), reason="needs the test tables")
def test_flagship(spark):
    from tessera.plans import registry

    assert registry.flagship(spark, str(DATA)).count() >= 0


@pytest.mark.skipif(not DATA.exists(), reason="needs the test tables")
def test_filters_and_columns_reach_the_scan(spark):
    from pyspark.sql import functions as F

    from tessera.operators import relations as R
    from tessera.runtime import load

    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")
    df = R.filter_symbols(load(spark, str(DATA), "symbols"), ["class"], "/work", "python").select("id")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "StringStartsWith(file_path,/work/)" in plan and "EqualTo(language,python)" in plan and "docstring" not in plan
    plan = load(spark, str(DATA), "edges").groupBy("edge_type").agg(F.count("*"))._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<edge_type:string>" in plan
