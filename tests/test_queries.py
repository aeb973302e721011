import duckdb
import pytest
from oracle import SF, compare
from pyspark.sql import functions as F

import __spark_entry__
from trajlake.plans import branches, helpers, lowering, sinks
from trajlake.plans.oracle import HELPERS, ORACLE_SQL, SINKS
from trajlake.plans.queries import QUERIES
from trajlake.sources import io

MORE = {**branches.QUERIES, **helpers.QUERIES, **lowering.QUERIES, **sinks.QUERIES}
MORE_SQL = {**branches.ORACLE_SQL, **HELPERS, **lowering.ORACLE_SQL, **SINKS}


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql(spark, name):
    compare(spark, QUERIES[name], ORACLE_SQL[name])


@pytest.mark.parametrize("name", sorted(MORE))
def test_more_queries_equal_sql(spark, name):
    compare(spark, MORE[name], MORE_SQL[name])


def test_alignment_in_single_precision(spark, tmp_path):
    """0.18 times 100 is 18 as floats are multiplied, less than 18 as doubles are."""
    duckdb.sql(f"COPY (SELECT 1::BIGINT AS vec_id, [0.18, -0.07, 0.29]::FLOAT[] AS embedding, 1 AS label UNION ALL SELECT 2, list_resize([0.18]::FLOAT[], 70, 0.18), 2) TO '{tmp_path}/embeddings.parquet'")
    query = QUERIES["align_pad_truncate"]
    assert query(spark, str(tmp_path)).where("vec_id = 1").first()["aligned"].startswith("18,")
    compare(spark, query, ORACLE_SQL["align_pad_truncate"], str(tmp_path))


def test_first_messages_are_the_tables_own(spark):
    """Texts of all conversations are hashed whole, none is put in their place."""
    own = spark.read.parquet(f"{SF}/conversations.parquet").where("role = 'user'").groupBy("conv_id").agg(F.sha2(F.min_by("text", "turn"), 256).alias("h"))
    want = {r["conv_id"]: r["h"] for r in own.collect()}
    got = {r["conv_id"]: r["user_hash"] for r in helpers.first_messages(spark, SF).collect()}
    assert {k: h for k, h in got.items() if h is not None} == want


def test_parts_of_records_follow_the_rows(spark, monkeypatch):
    """A task's share of records and buckets stays the same as tables grow."""
    monkeypatch.setattr(sinks, "ROWS", 500)
    n = spark.read.parquet(f"{SF}/lineitem.parquet").count() // 500 + 1
    assert sinks._records(spark, SF).rdd.getNumPartitions() == n > 8
    plan = sinks.queue_scores(spark, SF)._jdf.queryExecution().toString()
    assert f"{n} out of {n}" in plan and "Exchange" not in plan
    for name in ("queue_scores", "queue_records"):
        compare(spark, sinks.QUERIES[name], SINKS[name])


def test_stream_of_branches_reads_files_of_one_size(spark, monkeypatch):
    """The log's halves lie in files whose number follows the rows, a half a trigger."""
    folders, scratch = [], branches.scratch
    monkeypatch.setattr(branches, "ROWS", 5)
    monkeypatch.setattr(branches, "scratch", lambda s: folders.append(scratch(s)) or folders[-1])
    compare(spark, branches.chain_branches_stream, MORE_SQL["chain_branches_stream"])
    assert len(spark.read.parquet(f"{folders[0]}/log").inputFiles()) > 4


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(QUERIES) <= set(__spark_entry__.queries())
    assert SF.startswith("/root/testdata")


def test_transcripts_are_listed_by_few_tasks(spark, tmp_path):
    """Not by one for each folder."""
    for i in range(60):
        (tmp_path / f"conv_id={i}").mkdir()
        (tmp_path / f"conv_id={i}" / "a.json").write_text('[{"role":"user","content":"x"}]')
    sc = spark.sparkContext
    sc.setJobGroup("listing", "listing")
    found = io.read_transcripts(spark, str(tmp_path))
    told = sc.statusTracker()
    stages = [told.getStageInfo(s) for j in told.getJobIdsForGroup("listing") for s in told.getJobInfo(j).stageIds]
    sc.setLocalProperty("spark.jobGroup.id", None)
    assert stages and all(s.numTasks <= 4 * sc.defaultParallelism for s in stages)
    assert found.count() == 60
