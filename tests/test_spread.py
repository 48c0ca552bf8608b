"""Rows of a file with one row group are worked on by many tasks; patches are numbered with one sort."""

import pytest
from pyspark.sql import functions as F

from findinglake.catalog import code, growth, inputs, texts
from findinglake.sources import patches as pt
from findinglake.sources.tables import LEAST, SPREAD, spread

TABLES = {
    "documents": ("doc_id long, text string, source string", [(k, f"text {k}", "s") for k in range(40)]),
    "pages": ("page_id long, url string, html string", [(k, "u", "<p>") for k in range(40)]),
    "part": ("p_partkey long, p_name string", [(k, "n") for k in range(1, 40)]),
    "customer": ("c_custkey long", [(k,) for k in range(40)]),
    "orders": ("o_orderkey long, o_custkey long", [(k, k % 7) for k in range(40)]),
}


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("tables"))
    for name, (schema, rows) in TABLES.items():
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{folder}/{name}.parquet")
    return folder


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_rows_are_dealt_out_without_being_asked(spark):
    assert spark.conf.get(SPREAD, None) is None
    dealt = spread(spark.range(500).coalesce(1))
    assert dealt.rdd.getNumPartitions() >= LEAST
    assert sorted(r.id for r in dealt.collect()) == list(range(500))


@pytest.mark.parametrize("query", [
    code.dependency_findings, code.scan_long_files_capped, code.scan_changed_lines, code.scan_long_files, code.scan_pages,
    texts.scrub_documents, inputs.patch_lines, inputs.split_diffs, growth._manifests,
], ids=lambda q: q.__name__)
def test_work_on_rows_is_spread(spark, tables, query):
    assert "RoundRobinPartitioning" in plan(query(spark, tables))


def test_patches_are_numbered_with_one_sort(spark):
    rows = [
        (1, "before\n@@ -3,2 +5,3 @@ f\n a\n-b\n+c\n\\ No newline\n+d\n@@@ odd\n@@ -40 +50 @@\n+@@ -1 +1 @@\n e\n"), (2, "no header\n+x"),
        (3, "@@ -1 +1 @@\n@@ -99999999999 +7 @@\n-a\n+b"), (4, None), (5, ""),
    ]
    patches = spark.createDataFrame(rows, "id long, patch string")
    numbered = pt.numbered_lines(patches, ["id"])
    assert plan(numbered).count("Sort [") == 1
    walked = patches.select("id", F.explode(pt.parsed_lines(F.col("patch"))).alias("l")).select("id", "l.*")
    assert sorted(map(str, numbered.collect())) == sorted(map(str, walked.select(numbered.columns).collect()))
    assert numbered.count() == 10
