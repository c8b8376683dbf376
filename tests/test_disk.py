"""What jobs leave on disk, and what they send."""

import time
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from sheaf.operators import grams, resume, summary, tiles, vectors
from sheaf.session import materialise
from sheaf.sources import config


def _shuffle_files(spark) -> set[str]:
    files = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    names = [files.apply(i).getName() for i in range(files.size())]
    return {n for n in names if n.startswith("shuffle_")}


def test_materialise_leaves_no_shuffle_files(spark):
    before = _shuffle_files(spark)
    table = materialise(spark.range(100_000).repartition(7, "id"), "numbers")
    for _ in range(100):
        if not _shuffle_files(spark) - before:
            break
        time.sleep(0.1)
    assert not _shuffle_files(spark) - before
    assert table.count() == 100_000
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    assert spark.conf.get(key, None) in (None, "false")


def test_hits_count_each_listing(spark):
    lists = [[0, 1, 2], [2], [(3 << 33) + 70_000, 2], [0, (1 << 15) - 1, 1 << 15], []]
    rows = spark.createDataFrame([(x,) for x in lists], "sids array<long>")
    got = {r.sid: r.hits for r in summary._hits(rows).collect()}
    assert got == {0: 2, 1: 1, 2: 3, (1 << 15) - 1: 1, 1 << 15: 1, (3 << 33) + 70_000: 1}


def test_a_cluster_lies_in_few_ranges(spark):
    rows = materialise(spark.range(4000).select((F.col("id") % 8).alias("cluster_id"), F.col("id").alias("doc_pos")), "rows")
    dealt = summary._by_cluster(rows, "doc_pos").withColumn("part", F.spark_partition_id())
    spots = dealt.groupBy("cluster_id").agg(F.countDistinct("part").alias("n")).agg(F.sum("n")).first()[0]
    assert spots <= 2 * 8  # as many as there are ranges, and one more for each border


def test_tiles_copy_no_chunk(spark):
    rows = [(i, {k: 0.5 for k in range(i % 5, i % 5 + 4)}) for i in range(60)]
    leaves = spark.createDataFrame(rows, "leaf long, vec map<long,double>")
    pairs = tiles.similar_pairs(leaves, 0.5, chunk_rows=7)
    assert "Exchange" not in pairs._jdf.queryExecution().executedPlan().toString()
    want = {(a, b) for a in range(60) for b in range(a + 1, 60) if abs(a % 5 - b % 5) <= 2}
    assert {(r.a, r.b) for r in pairs.collect()} == want


def _leaves(spark):
    docs = [(i, 1 + i % 3, ["common", f"own{i}", "two" if i < 2 else f"other{i}", "common"]) for i in range(60)]
    return docs, spark.createDataFrame(docs, "doc_pos bigint, copies bigint, tokens array<string>")


def test_only_terms_that_come_again_are_sent(spark, monkeypatch):
    monkeypatch.setattr(grams, "SLICE_TOKENS", 16)
    docs, leaves = _leaves(spark)
    blocked, n_docs = vectors._in_blocks(leaves)
    packed = vectors._packed(blocked)
    assert packed.count() > 10
    marks = sum(int(np.unpackbits(np.frombuffer(r.bits, np.uint8)).sum()) for r in vectors._repeated(packed, 5).collect())
    assert 2 * 1 < marks <= packed.count() + 4  # "common" once per block, "two" and "common two" once or twice
    counted = vectors._counted(packed, n_docs, 1.0)
    assert counted.selectExpr("sum(size(df))").first()[0] <= marks


def test_counts_over_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(grams, "SLICE_TOKENS", 16)
    monkeypatch.setattr(vectors, "BUCKET_TERMS", 8)
    docs, leaves = _leaves(spark)
    df, rows = Counter(), Counter()
    for _, copies, t in docs:
        for g in {" ".join(t[i : i + n]) for n in (1, 2, 3) for i in range(len(t) - n + 1)}:
            df[g] += copies
            rows[g] += 1
    found = vectors.shared_terms(*vectors._in_blocks(leaves), 1.0).collect()
    assert {(r.term, r.df, r.rows) for r in found} == {(g, df[g], n) for g, n in rows.items() if n > 1}
    assert sum(len(r.slots) for r in found) == sum(n for n in rows.values() if n > 1)


SECTIONS = (resume.Section("header"), resume.Section("user", "USER", "END", "Tailor.", "TEXT"), resume.Section("rest", "REST", None, "Tailor.", "REST"), resume.Section("end", "END"))


def _said(spark, ids):
    docs = spark.createDataFrame([(i, f"me {i}\n# USER\nu{i}\n# END\ne{i}\n# REST\nr{i}") for i in ids], "resume_id string, body string")
    jobs = spark.createDataFrame([(j, f"job {j}") for j in range(5)], "job_id long, job_description string")
    pairs = docs.select("resume_id").distinct().crossJoin(jobs.select("job_id"))
    prompts = materialise(resume.prompt_rows(docs, jobs, pairs, SECTIONS), "prompts")
    some = prompts.where("NOT (job_id = 3 AND section = 'rest')").select("prompt_id", F.when(F.col("job_id") != 2, F.lower("prompt")).alias("response"))
    twice = some.unionByName(some.where("job_id = 1")).unionByName(spark.createDataFrame([("x/9/user", "nobody asked")], "prompt_id string, response string"))
    return docs, prompts, twice


def test_responses_go_to_their_pair(spark, monkeypatch):
    """The same résumés as by a join on the prompt's id, with responses that are missing, null, given twice or not asked for."""
    for ids, plain in ((["a", "b", "b"], True), (["a", "a/1", "c"], False)):
        docs, prompts, responses = _said(spark, ids)
        asked = prompts.select("prompt_id", "resume_id", "job_id", "ord")
        want = sorted(map(tuple, resume._assembled_by_prompt(docs, asked, responses, SECTIONS).collect()))
        other = "_assembled_by_prompt" if plain else "_assembled_by_pair"
        with monkeypatch.context() as m:
            m.setattr(resume, other, None)
            got = resume.assemble(docs, prompts, responses, SECTIONS)
        assert sorted(map(tuple, got.collect())) == want and len(want) == 5 * len(set(ids))
        if plain:  # put together already, a part after the other
            assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString()


def test_small_files_share_tasks(spark, tmp_path):
    rows = spark.range(40).select(F.concat(F.lit("r"), "id").alias("resume_id"), F.concat(F.lit("body "), "id").alias("body"))
    config.save_texts(rows, str(tmp_path / "cv"), "resume_id")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4m")  # as one file counts at least
    try:
        found = config.resumes(spark, str(tmp_path / "cv"))
        assert found.rdd.getNumPartitions() <= int(spark.conf.get("spark.sql.shuffle.partitions"))
        assert {r.body.strip() for r in found.collect()} == {f"body {i}" for i in range(40)}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert spark.conf.get("spark.sql.sources.parallelPartitionDiscovery.parallelism") == "10000"
