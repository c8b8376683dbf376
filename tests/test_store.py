import datetime as dt
import json
import random

import pytest
from pyspark.sql import functions as F

from sheaf.operators import backfill, store, tracker
from sheaf.plans import pipeline
from sheaf.session import materialise
from sheaf.sources import records
from sheaf.streaming import status

FIELDS = [f.name for f in records.OPPORTUNITY]
T0 = dt.datetime(2024, 1, 1)


def record(url, **values):
    base = dict.fromkeys(FIELDS)
    base.update(id=f"id-{url}", source_url=url, date_posted=T0, applied=False, **values)
    return base


def frame(spark, rows, extra=""):
    schema = records.OPPORTUNITY.simpleString()[len("struct<") : -1].replace(":", " ")
    names = FIELDS + ([extra.split()[0]] if extra else [])
    return spark.createDataFrame([tuple(r.get(n) for n in names) for r in rows], schema + (f", {extra}" if extra else ""))


def as_rows(df):
    return {r.source_url: {n: r[n] for n in FIELDS} for r in df.collect()}


def stored(spark, *rows):
    return store.with_key(frame(spark, rows))


def batch(spark, *rows):
    return frame(spark, [r | {"pos": i} for i, r in enumerate(rows)], "pos bigint")


MERGES = [
    # field, stored, arriving, result
    ("designation", None, "Lead", "Lead"),
    ("designation", " \t", "Lead", "Lead"),
    ("designation", "Head", "Lead", "Head"),
    ("designation", "Head", None, "Head"),
    ("designation", "", " ", ""),
    ("location", "x", "", "x"),
    ("relevant", None, True, True),
    ("relevant", True, False, False),
    ("relevant", True, None, True),
    ("applied", True, False, False),
    ("resume_version_used", "v1", "v2", "v2"),
    ("resume_version_used", "v1", None, "v1"),
    ("resume_version_used", "v1", "", ""),
    ("applied_date", T0, None, T0),
]


def test_merge_rules(spark):
    old = [record(f"u{i}") | {f: a} for i, (f, a, _, _) in enumerate(MERGES)]
    new = [record(f"u{i}") | {f: b} for i, (f, _, b, _) in enumerate(MERGES)]
    got = as_rows(store.upsert(stored(spark, *old), batch(spark, *new)))
    assert [(i, f, got[f"u{i}"][f]) for i, (f, *_) in enumerate(MERGES)] == [(i, f, r) for i, (f, _, _, r) in enumerate(MERGES)]


def test_upsert_of_a_batch_is_one_by_one(spark):
    rng = random.Random(3)
    pick = lambda *v: rng.choice(v)

    def some(i):
        return record(
            pick("u1", "u2", "u3", " ", "", None),
            designation=pick(None, "", " \t", "Lead", "Head"),
            location=pick(None, "x", "y"),
            relevant=pick(None, True, False),
            applied_date=pick(None, T0 + dt.timedelta(days=i)),
            resume_version_used=pick(None, "", "v1"),
        ) | {"id": f"id{i}", "applied": pick(True, False)}

    existing = materialise(store.upsert(stored(spark, record("u1")), batch(spark, *[some(i) for i in range(3)])), "test")
    rows = [some(i) for i in range(10, 22)]
    whole = as_rows(store.upsert(existing, batch(spark, *rows)))
    single = existing
    for r in rows:
        single = materialise(store.upsert(single, batch(spark, r)), "test")
    assert as_rows(single) == whole
    assert as_rows(store.upsert(single, batch(spark, *rows))) == whole
    assert set(whole) <= {"u1", "u2", "u3", " "}


def test_unapply_keeps_the_date_and_rescrape_resets(spark):
    old = stored(spark, record("u", applied_date=T0) | {"applied": True})
    row = store.upsert(old, batch(spark, record("u"))).first()
    assert row.applied is False and row.applied_date == T0


def test_defaults_and_equality(spark):
    df = frame(spark, [record("u") | {"id": None, "date_posted": None, "applied": None}])
    row = store.with_defaults(df, F.lit("2024-05-01").cast("timestamp")).first()
    assert row.id and row.date_posted == dt.datetime(2024, 5, 1) and row.applied is False
    pair = spark.createDataFrame([(None, None), ("a", None), ("a", "a")], "a string, b string")
    assert [r.o for r in pair.select(store.same_record(F.col("a"), F.col("b")).alias("o")).collect()] == [True, False, True]


def test_json_import(spark, tmp_path):
    good = {"designation": "Lead", "date_posted": "2024-01-01T00:00:00+00:00", "relevant": None, "applied": True, "source_url": "u"}
    path = tmp_path / "o.json"
    path.write_text(json.dumps({"a": good, "b": 3, "c": {"date_posted": "never"}, "d": {"applied": "perhaps"}}, indent=4))
    rows, rejects = records.import_json(spark, str(path))
    row = rows.first()
    assert rows.count() == 1 and (row.designation, row.date_posted, row.applied) == ("Lead", T0, True) and row.id
    assert {r.key for r in rejects.collect()} == {"c", "d"}
    (tmp_path / "list.json").write_text("[1, 2]")
    assert records.import_json(spark, str(tmp_path / "list.json"))[0].count() == 0
    assert records.import_json(spark, str(tmp_path / "none.json"))[0].count() == 0


def test_snapshots(spark, tmp_path):
    table = records.SnapshotStore(spark, str(tmp_path / "store"))
    assert table.read().count() == 0
    table.write(frame(spark, [record("a")]), "t1")
    table.write(table.read().unionByName(frame(spark, [record("b")])))
    assert table.read().count() == 2 and table.has("t1") and not table.has("t2")
    assert table.write(frame(spark, []), "t1").endswith("snapshot-000000000001-t1")  # the same input again: skipped
    assert table.read().count() == 2
    (tmp_path / "store" / "snapshot-000000000009").mkdir()  # a write that never finished
    assert table.read().count() == 2
    table.expire(1)
    assert table.read().count() == 2 and not table.has("t1")


def test_tracker(spark):
    rows = [
        record("a", designation="A", company_name="C", relevant=None) | {"doc_pos": 0},
        record("b", designation="B", company_name="C", relevant=True) | {"doc_pos": 1, "applied": True},
        record("c", designation="C", company_name="", relevant=True) | {"doc_pos": 2},
        record("d", designation=" ", company_name="C", relevant=True) | {"doc_pos": 3},
        record("e", designation="E", company_name="C", relevant=False) | {"doc_pos": 4, "date_posted": T0 + dt.timedelta(1)},
    ]
    df = frame(spark, rows, "doc_pos bigint")
    assert tuple(tracker.counts(df).first()) == (5, 1, 4)
    assert [r.doc_pos for r in tracker.sorted_rows(df).collect()] == [2, 3, 1, 4, 0]
    assert {r.doc_pos for r in tracker.view(df).collect()} == {0, 1, 3, 4}


def test_stream_equals_batch_for_any_batching(spark, tmp_path):
    rng = random.Random(5)
    events = [
        (i, T0 + dt.timedelta(seconds=rng.randrange(50)), f"k{rng.randrange(4)}", rng.choice([None, True, False]), rng.choice([None, True, False]))
        for i in range(60)
    ]
    schema = "event_id bigint, ts timestamp, key string, relevant boolean, applied boolean"
    whole = spark.createDataFrame(events, schema)

    def ups(df):
        return status.updates(df, F.col("key"), F.col("relevant"), F.col("applied"))

    expected = sorted(map(tuple, status.fold_updates(ups(whole)).collect()))
    source = tmp_path / "in"
    log = status.ChangeLog(spark, str(tmp_path / "log"))
    assert log.read().count() == 0
    rng.shuffle(events)
    for k in range(0, 60, 17):
        spark.createDataFrame(events[k : k + 17], schema).coalesce(1).write.mode("append").parquet(str(source))
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(source))
        status.start(ups(stream), log, str(tmp_path / "cp")).awaitTermination()
    assert sorted(map(tuple, status.fold_updates(log.read()).collect())) == expected
    log.append(ups(whole), 0)  # a repeated batch
    assert sorted(map(tuple, status.fold_updates(log.read()).collect())) == expected

    table = records.SnapshotStore(spark, str(tmp_path / "store"))
    table.write(frame(spark, [record("u") | {"source_hash": "k0"}, record("v") | {"source_hash": "zz"}]))
    by_hash = lambda df: {r.source_hash: r.asDict() for r in df.collect()}
    once = by_hash(status.live(table, log))
    assert status.compact(table, log) and log.batches() == []
    assert status.compact(table, log) is None
    assert by_hash(table.read()) == by_hash(status.live(table, log)) == once
    by_key = {r[0]: r for r in expected}
    assert once["k0"]["applied"] == by_key["k0"][2] and once["zz"]["applied"] is False


def test_folded_clicks_do_not_come_back(spark, tmp_path):
    table, log = records.SnapshotStore(spark, str(tmp_path / "store")), status.ChangeLog(spark, str(tmp_path / "log"))
    table.write(stored(spark, record("u")))
    key = table.read().first().source_hash
    events = spark.createDataFrame([(1, T0, key, True)], "event_id bigint, ts timestamp, key string, applied boolean")
    log.append(status.updates(events, F.col("key"), F.lit(None).cast("boolean"), F.col("applied")), 0)
    assert status.live(table, log).first().applied is True
    kept = materialise(log.read(), "test")
    status.compact(table, log)
    log.append(kept, 0)  # as if the run had died before it trimmed the log
    table.write(store.upsert(table.read(), batch(spark, record("u"))))
    assert status.live(table, log).first().applied is False
    table.expire(1)  # the snapshot that names the fold stays
    assert status.live(table, log).first().applied is False
    log.append(kept, 1)  # a later click counts
    assert status.live(table, log).first().applied is True
    assert status.compact(table, log) and log.batches() == []


def test_backfill(spark, tmp_path):
    long_text = "word " * 30
    pages = [
        (1, "https://www.x.com/1", f"<article>short</article><main>{long_text}</main>"),
        (2, "https://x.com/2", "<main>short</main>"),
    ]
    captured = spark.createDataFrame(pages, "page_id bigint, url string, html string")
    table = records.SnapshotStore(spark, str(tmp_path / "store"))
    rows = [record("https://www.x.com/1", job_description=" "), record("https://y.com/3"), record("https://x.com/4", job_description="has")]
    table.write(store.with_key(frame(spark, rows)))
    stats = pipeline.backfill_descriptions(table, captured, "x.com", ["article", "main"])
    assert stats == {"total": 3, "eligible": 1, "updated": 1, "skipped": 0, "failed": 0}
    texts = {r.source_url: r.job_description for r in table.read().collect()}
    assert texts["https://www.x.com/1"] == long_text.strip() and texts["https://y.com/3"] is None
    table.write(table.read().unionByName(store.with_key(frame(spark, [record("https://x.com/2")]))))
    with pytest.raises(RuntimeError, match="updated 0 of 1"):
        pipeline.backfill_descriptions(table, captured, "x.com", ["article", "main"])


def test_unsaved(spark):
    wanted = spark.createDataFrame([("a",), ("b",)], "source_url string")
    saved = spark.createDataFrame([("a", "text"), ("b", " ")], "source_url string, job_description string")
    assert [r.source_url for r in backfill.unsaved(wanted, saved).collect()] == ["b"]


def test_collect(spark, tmp_path):
    table = records.SnapshotStore(spark, str(tmp_path / "store"))
    sources = spark.createDataFrame([("https://a.com",), ("https://b.com",)], "source string")
    conf = spark.createDataFrame([("a.com", "card", ["div"])], "domain string, field string, selectors array<string>")
    rows = [
        ("https://a.com", 1, 0, "k", ["Lead", "Acme", "Rome"], "Posted on May 1, 2026", "https://a.com/?currentJobId=5"),
        ("https://a.com", 1, 1, "k", ["Again", "Acme", "Rome"], "", "https://a.com/?currentJobId=6"),
        ("https://a.com", 1, 2, "n", ["Privacy", "Acme", "Rome"], "", "https://a.com/?currentJobId=7"),
        ("https://b.com", 1, 0, "k", ["Other", "Acme", "Rome"], "", "https://b.com/?currentJobId=8"),
    ]
    captured = spark.createDataFrame(
        rows, "source string, page_num int, pos int, key string, texts array<string>, date_text string, page_url string"
    )
    now = F.lit("2030-01-01").cast("timestamp")
    pipeline.collect(table, sources, conf, captured, now)
    got = table.read().collect()
    assert [(r.designation, r.source_url, r.date_posted, r.applied) for r in got] == [
        ("Lead", "https://www.linkedin.com/jobs/view/5/", dt.datetime(2026, 5, 1), False)
    ]
    with pytest.raises(RuntimeError, match="a.com"):
        pipeline.collect(table, sources, conf, captured.where("source like '%b.com'"), now)
    assert table.read().count() == 1


def test_collect_folds_clicks_first_and_reads_pages(spark, tmp_path):
    table, log = records.SnapshotStore(spark, str(tmp_path / "store")), status.ChangeLog(spark, str(tmp_path / "log"))
    card = "<li componentkey='{k}'><p>{t}</p><p>Acme</p><p>Rome</p><span>Posted on May 1, 2026</span></li>"
    html = "<ul>" + card.format(k="a", t="Lead") + card.format(k="a", t="Again") + card.format(k="b", t="Head") + "</ul>"
    pages = spark.createDataFrame(
        [(1, "https://a.com", 1, "https://a.com/?currentJobId=5", html), (2, "https://b.com", 1, "https://b.com/?currentJobId=6", html)],
        "page_id bigint, source string, page_num int, page_url string, html string",
    )
    conf = spark.createDataFrame([("a.com", "container", ["ul"])], "domain string, field string, selectors array<string>")
    now = F.lit("2030-01-01").cast("timestamp")
    pipeline.collect_pages(table, pages, conf, now, "li")
    assert [(r.designation, r.company_name, r.date_posted) for r in table.read().collect()] == [("Lead", "Acme", dt.datetime(2026, 5, 1))]
    with pytest.raises(ValueError):
        pipeline.collect_pages(table, pages, conf.limit(0), now, "li")


def test_one_json_object_is_read_by_several_tasks(spark, tmp_path):
    texts = ["plain", 'a "quoted" } {', "[[{{", "}}]]", "back\\slash\\", 'end\\"', "", "line\nbreak }", "ü·}"]
    data = {}
    for i in range(600):
        data[f'k{i}"}}' if i % 7 == 0 else f"k{i}"] = {"id": str(i), "text": texts[i % len(texts)] * (i % 5), "more": [{"a": {"b": [texts[i % len(texts)], i]}}, []]}
        if i % 50 == 0:
            data[f"n{i}"] = [i, "flat", "}{"][i // 50 % 3]
    (tmp_path / "a.json").write_text(json.dumps(data) + "\n", encoding="utf-8")
    (tmp_path / "b.json").write_text("\n" + json.dumps(data, indent=2, ensure_ascii=False), encoding="utf-8")
    (tmp_path / "c.json").write_text("[" + json.dumps(data) + "]")
    (tmp_path / "d.json").write_text("{}")
    (tmp_path / "e.json").write_text("")
    (tmp_path / "f.json").write_text('{"x": {"id": "1"}, "y": {"id": "2", "te')
    want = {k: v for k, v in data.items()}
    held = {c: spark.conf.get(c) for c in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        for size in ("1500", "128MB"):
            for c in held:
                spark.conf.set(c, size)
            assert (spark.read.text(str(tmp_path / "a.json")).rdd.getNumPartitions() > 20) == (size == "1500")
            for name in "ab":
                rows = records.keyed_values(spark, str(tmp_path / f"{name}.json")).collect()
                assert len(rows) == len(want)
                assert {r.key: r.value if isinstance(want[r.key], str) else json.loads(r.value) for r in rows} == want
            for name in "cde":
                assert records.keyed_values(spark, str(tmp_path / f"{name}.json")).collect() == []
            assert [tuple(r) for r in records.keyed_values(spark, str(tmp_path / "f.json")).collect()] == [("x", '{"id":"1"}')]
    finally:
        for c, v in held.items():
            spark.conf.set(c, v)
