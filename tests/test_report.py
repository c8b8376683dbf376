import datetime as dt

import pytest
from pyspark.sql import functions as F

from sheaf.operators import report, resume, summary
from sheaf.plans import pipeline
from sheaf.plans.queries import QUERIES
from sheaf.sources import clusters as saved
from sheaf.sources import config


def at(text):
    return F.lit(text).cast("timestamp")


def test_freshness(spark):
    now = at("2024-03-01 12:00:00")
    times = ["2024-01-31 12:00:00", "2024-01-31 11:59:59", "2025-01-01 00:00:00", None]
    df = spark.createDataFrame([(t,) for t in times], "t string").withColumn("t", F.to_timestamp("t"))
    assert [r.o for r in df.select(report.is_fresh(F.col("t"), now).alias("o")).collect()] == [True, False, True, False]


def test_due_outputs(spark):
    heads = spark.createDataFrame([("clusters", "2024-02-28"), ("clusters", "2023-01-01"), ("report", "2023-12-01")], "output string, g string")
    heads = heads.select("output", F.to_timestamp("g").alias("generated_at"))
    outs = spark.createDataFrame([("clusters",), ("report",), ("never",)], "output string")
    now = at("2024-03-01")
    assert {r.output for r in report.due_outputs(heads, outs, now).collect()} == {"report", "never"}
    assert report.due_outputs(heads, outs, now, force=True).count() == 3


def test_lines(spark):
    df = spark.createDataFrame([(1, [f"k{i}" for i in range(25)], [f"s{i}" for i in range(21)]), (2, [], [])], "cluster_id int, keywords array<string>, keyword_sentences array<string>")
    lines = {r.cluster_id: r.o for r in df.select("cluster_id", report.keyword_line(F.col("keywords")).alias("o")).collect()}
    assert lines == {1: ", ".join(f"k{i}" for i in range(24)), 2: "No keywords available."}
    rows = report.sentence_lines(df).orderBy("cluster_id", "line_no").collect()
    assert [r.line for r in rows[:20]] == [f"{i + 1}. s{i}" for i in range(20)]
    assert [tuple(r) for r in rows[20:]] == [(2, 1, "No keyword-matching sentences available.")]


def test_opportunity_lines(spark):
    ids = spark.createDataFrame([(1,), (2,)], "cluster_id int")
    rows = [(1, 5, (None, None, "", None))]
    members = spark.createDataFrame(rows, "cluster_id int, doc_pos int, opportunity struct<id: string, designation: string, company_name: string, url: string>")
    got = sorted(tuple(r)[2:] for r in report.opportunity_lines(ids, members).collect())
    assert got == [("No opportunities attached.", "n/a", "n/a"), ("None", "Unknown company", "n/a")]


def test_display_time(spark):
    values = ["2024-01-02T03:04:05+00:00", "2024-01-02T03:04:05", "soon", "", None, "2024-01-02T10:00:00+05:30", "2024", "2024-01", "12:30", "20240101"]
    values += ["2024-13-01", "2024-01-02 03", "2024-01-02T03:04:05.123456Z", "2024-01-02T0304-0800", "2024-01-02T03:04:05 and more"]
    df = spark.createDataFrame([(v,) for v in values], "t string")
    got = [r.o for r in df.select(report.display_time(F.col("t")).alias("o")).collect()]
    expected = ["2024-01-02 03:04:05 UTC", "2024-01-02 03:04:05 ", "soon", "Unknown", "Unknown", "2024-01-02 10:00:00 UTC+05:30", "2024", "2024-01", "12:30", "2024-01-01 00:00:00 "]
    assert got == expected + ["2024-13-01", "2024-01-02 03:00:00 ", "2024-01-02 03:04:05 UTC", "2024-01-02 03:04:00 UTC-08:00", "2024-01-02T03:04:05 and more"]


DOCS = [
    "Kafka streams power alpha systems. Kafka streams again, nothing else here.",
    "Kafka streams power beta systems.",
    "Kafka streams power alpha systems.",
    "Painting flowers with watercolor brushes. Painting walls.",
    "Painting flowers with watercolor pencils.",
    "Painting flowers on watercolor paper.",
    " ",
]


def docs(spark):
    rows = [(i, f"id{i}", f"title{i}", "acme", f"u{i}", t) for i, t in enumerate(DOCS)]
    return spark.createDataFrame(rows, "doc_pos bigint, id string, designation string, company_name string, source_url string, job_description string")


def plain_keywords(token_lists):
    """Ranked terms of one cluster, counted with plain dictionaries."""
    tf, df, first = {}, {}, {}
    for d, toks in enumerate(token_lists):
        seen = set()
        for n in (1, 2, 3):
            for i in range(len(toks) - n + 1):
                t = " ".join(toks[i : i + n])
                tf[t] = tf.get(t, 0) + 1
                first.setdefault(t, (d, n, i))
                seen.add(t)
        for t in seen:
            df[t] = df.get(t, 0) + 1
    score = {t: round(tf[t] * (1 + 0.2 * t.count(" ")) + 0.15 * df[t], 9) for t in tf}
    return sorted(tf, key=lambda t: (-score[t], -tf[t], -df[t], -len(t), first[t]))


def test_cluster_run(spark, tmp_path):
    result = pipeline.cluster(docs(spark), F.lit("2024-01-02T00:00:00+00:00"), ["nothing", "watercolor paper"], 2, chunk_rows=2)
    head = result["header"].first()
    assert head.discovered_k == 2 and head.min_cluster_size == 2 and head.explicit_stopwords == ["nothing", "watercolor paper"]
    table = result["clusters"].orderBy(*summary.report_order()).collect()
    assert [(r.cluster_id, r.total_opportunities) for r in table] == [(0, 3), (3, 3)]
    assert table[0].keyword_sentences[0].startswith("Kafka streams")
    words = [r.term for r in result["keywords"].where("cluster_id = 0").orderBy("rank").collect()]
    tokens = [["kafka", "streams", "power", "alpha", "systems", "kafka", "streams", "else"],
              ["kafka", "streams", "power", "beta", "systems"],
              ["kafka", "streams", "power", "alpha", "systems"]]
    assert words == plain_keywords(tokens)
    assert not {"nothing", "watercolor paper"} & {r.term for r in result["keywords"].collect()}
    nested = summary.nested_records(result["clusters"], result["keywords"], result["opportunities"]).where("cluster_id = 3").first()
    assert [o.url for o in nested.opportunities] == ["u3", "u4", "u5"] and nested.keywords

    path = str(tmp_path / "out")
    with pytest.raises(FileNotFoundError):
        saved.read_clusters(spark, path)
    for _ in range(2):
        saved.save_clusters(result, path, "20240102")
    saved.save_clusters(result, path, "20240103")
    again = saved.read_clusters(spark, path)
    assert again["clusters"].count() == 2
    assert saved.read_clusters(spark, path, "20240102")["clusters"].count() == 2
    with pytest.raises(FileNotFoundError):
        saved.read_clusters(spark, path, "20240104")
    (tmp_path / "out" / "run-000000000009").mkdir()  # a run that never finished
    assert saved.read_clusters(spark, path)["clusters"].count() == 2
    assert saved.last_generated_at(again["header"]) == dt.datetime(2024, 1, 2)


def test_import_clusters(spark, tmp_path):
    (tmp_path / "clusters.json").write_text(
        '{"generated_at": "2024-01-02", "discovered_k": 1, "clusters": [{"cluster_id": 3, "total_opportunities": 2, "keywords": ["a", "b"], '
        '"keyword_sentences": ["s"], "opportunities": [{"id": "x", "designation": null, "company_name": "C", "url": "u"}]}]}'
    )
    got = saved.import_clusters(spark, str(tmp_path / "clusters.json"))
    assert [tuple(r) for r in got["keywords"].collect()] == [(3, 1, "a"), (3, 2, "b")]
    assert got["header"].first().discovered_k == 1 and got["clusters"].first().keyword_sentences == ["s"]
    assert got["opportunities"].first().opportunity.id == "x"


def test_last_generated_at(spark):
    df = spark.createDataFrame([("2024-01-01T05:00:00+02:00",), ("junk",), (None,)], "generated_at string")
    assert saved.last_generated_at(df) == dt.datetime(2024, 1, 1, 3)
    assert saved.last_generated_at(df.where("generated_at = 'junk'")) is None


def test_config_sources(spark, tmp_path):
    (tmp_path / "sel.json").write_text('{"a.com": {"card": "div", "jd": ["x", "y"], "requires_login": true}}')
    got = {r.field: r.selectors for r in config.selectors(spark, str(tmp_path / "sel.json")).collect()}
    assert got == {"card": ["div"], "jd": ["x", "y"], "requires_login": ["true"]}
    (tmp_path / "stop.txt").write_text("Use  Case\n\nwork\nWork \n")
    assert {r.term for r in config.stopwords(spark, str(tmp_path / "stop.txt")).collect()} == {"use case", "work"}
    (tmp_path / "meta.json").write_text('{"last_updated": "2024", "header": {"status": "Failed", "last_updated": "2024-01-01T00:00:00Z", "filename": "h.md"}, "notes": {}, "done": false}')
    rows = {r.section: tuple(r)[1:] for r in config.section_status(spark, str(tmp_path / "meta.json")).collect()}
    assert rows == {"header": ("Failed", dt.datetime(2024, 1, 1), "h.md"), "notes": ("Not Started", None, None)}
    (tmp_path / "cv.md").write_text("Me\n# EDUCATION\nSchool")
    assert config.resumes(spark, str(tmp_path / "cv.md")).first().body.startswith("Me\n")


def test_files_are_written_by_many_tasks(spark, tmp_path):
    """A few bytes each, but a file each: they are dealt out, and names of folders are not taken for values."""
    rows = spark.range(40).select(F.concat(F.lit("r-"), "id").alias("resume_id"), F.concat(F.lit("body "), "id").alias("body")).groupBy("resume_id").agg(F.max("body").alias("body"))
    path = tmp_path / "cv"
    config.save_texts(rows, str(path), "resume_id")
    files = [f for f in path.rglob("*.txt") if f.name.startswith("part-")]
    assert len(files) == 40 and len({f.name.split("-")[1] for f in files}) > 4
    found = config.resumes(spark, str(path))
    assert {(r.resume_id.split("resume_id=")[1].split("/")[0], r.body) for r in found.collect()} == {(f"r-{i}", f"body {i}\n") for i in range(40)}
    assert found.columns == ["resume_id", "body", "source_modified"]


RESUME = "Jane Doe\njane@x\n\n# Resume Summary\nGood.\n\n# CAREER HIGHLIGHTS\n- did\n# CORE COMPETENCIES\nSQL\n# WORK EXPERIENCE\nX Inc\n# EDUCATION\nMIT\n"


def test_sections(spark):
    df = spark.createDataFrame([("r", RESUME), ("bare", "no headers")], "resume_id string, body string")
    got = {(r.resume_id, r.section): r.body for r in resume.section_rows(df).collect()}
    assert got["r", "header"] == "Jane Doe\njane@x"
    assert got["r", "summary"] == "# Resume Summary\nGood."
    assert got["r", "competencies"].startswith("# CORE COMPETENCIES\nSQL\n# WORK EXPERIENCE")  # next header is missing
    assert got["r", "awards"] == "" and got["r", "education"] == "# EDUCATION\nMIT"
    assert got["bare", "header"] == "no headers" and got["bare", "summary"] == ""


def test_prompts_and_assembly(spark):
    df = spark.createDataFrame([("r", RESUME)], "resume_id string, body string")
    jobs = spark.createDataFrame([(1, "Build things"), (2, ""), (3, None)], "job_id bigint, job_description string")
    prompts = resume.prompt_rows(df, jobs)
    rows = {r.section: r for r in prompts.collect()}
    assert set(rows) == {"summary", "highlights", "competencies", "experience"}
    assert rows["summary"].prompt.endswith("ORIGINAL SUMMARY:\n# Resume Summary\nGood.\n\nJOB DESCRIPTION:\nBuild things")
    answers = prompts.select("prompt_id", F.concat(F.lit("new "), "section").alias("response"))
    text = resume.assemble(df, prompts, answers).first().resume
    assert text == "\n\n".join(
        [
            "Jane Doe\njane@x",
            "# Resume Summary\nnew summary",
            "# CAREER HIGHLIGHTS\nnew highlights",
            "# CORE COMPETENCIES\nnew competencies",
            "# WORK EXPERIENCE\nnew experience",
            "# EDUCATION\nMIT",
        ]
    )
    two = df.unionByName(df.withColumn("resume_id", F.lit("q")))
    with pytest.raises(ValueError):
        resume.prompt_rows(two, jobs)
    pairs = spark.createDataFrame([("q", 1)], "resume_id string, job_id bigint")
    assert {r.resume_id for r in resume.prompt_rows(two, jobs, pairs).collect()} == {"q"}
    assert "RESUME TEXT:\nJane Doe" in resume.header_prompts(df).first().prompt


def test_prompts_are_built_once(spark, tmp_path, monkeypatch):
    """Prompts hold a description several times over; assembly and digests read them where they were written."""
    turns = [(c, t, "user", f"text {c} {t}") for c in range(2) for t in range(8)]
    spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    docs = [(i, f"a description {i}", "en", "source-1", 13) for i in range(3)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(0, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    given, assemble = [], resume.assemble

    def seen(resumes, prompts, responses, *more):
        given.extend([*prompts.inputFiles(), *responses.inputFiles()])
        return assemble(resumes, prompts, responses, *more)

    monkeypatch.setattr(resume, "assemble", seen)
    for name in ("resume_every_job", "resume_pairs"):
        out = QUERIES[name](spark, str(tmp_path)).collect()
        assert sorted({r.job_id for r in out}) == [0, 1, 2] and len(out) == 12
    assert given and all("/prompts-" in f for f in given)


def test_section_status(spark):
    rows = [
        ("a", "Completed", "2024-01-05 01:00:00", "2024-01-05 23:00:00"),
        ("b", "Completed", "2024-01-04 23:00:00", "2024-01-05 00:00:00"),
        ("c", "Failed", "2024-01-06 00:00:00", "2024-01-05 00:00:00"),
    ]
    df = spark.createDataFrame(rows, "section string, status string, u string, m string").select(
        "section", "status", F.to_timestamp("u").alias("last_updated"), F.to_timestamp("m").alias("source_modified")
    )
    assert {r.section for r in resume.stale_sections(df).collect()} == {"b", "c"}
    started = resume.mark_in_progress(df, at("2024-02-01"))
    got = spark.createDataFrame([("a", "text"), ("b", " \n")], "section string, response string")
    new = resume.apply_responses(started, got, ["section"], at("2024-02-02"))
    assert {r.section: (r.status, r.content) for r in new.collect()} == {
        "a": ("Completed", "text"),
        "b": ("Failed", None),
        "c": ("In Progress", None),
    }
    assert [r.section for r in resume.failed_sections(new).collect()] == ["b"]
    assert tuple(resume.build_succeeded(new).first()) == (1, False)


def test_nested_parts_hold_what_whole_records_hold(spark):
    clusters = spark.createDataFrame([(1, 5, ["s"], 0), (2, 1, [], 7), (3, 0, [], None)], "cluster_id long, total_opportunities long, keyword_sentences array<string>, first_doc long")
    keywords = spark.createDataFrame([(1, r, f"t{r}") for r in range(1, 8)] + [(2, 1, "u")], "cluster_id long, rank long, term string")
    members = spark.createDataFrame([(1, i, (str(i),)) for i in range(5)] + [(2, 7, ("7",))], "cluster_id long, doc_pos long, opportunity struct<id:string>")
    whole = {r.cluster_id: r for r in summary.nested_records(clusters, keywords, members).collect()}
    parts = sorted(summary.nested_parts(clusters, keywords, members, 3).collect(), key=lambda r: (r.cluster_id, r.part))
    assert [(r.cluster_id, r.part, len(r.keywords), len(r.opportunities)) for r in parts] == [(1, 0, 3, 3), (1, 1, 3, 2), (1, 2, 1, 0), (2, 0, 1, 1), (3, 0, 0, 0)]
    for c, record in whole.items():
        own = [r for r in parts if r.cluster_id == c]
        assert sum((r.keywords for r in own), []) == record.keywords
        assert sum((r.opportunities for r in own), []) == (record.opportunities or [])
        assert sum((r.keyword_sentences for r in own), []) == record.keyword_sentences
