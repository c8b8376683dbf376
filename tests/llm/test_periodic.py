"""Periodic runs against a search of every start and period."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from sheaf.llm import periodic
from sheaf.llm.queries import QUERIES

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain_runs(w, least=6, exponent=4):
    """Every start and period tried; (start, length, period) by start and period."""
    out = []
    for s in range(len(w)):
        for q in range(1, (len(w) - s) // exponent + 1):
            if s and w[s - 1] == w[s - 1 + q]:
                continue
            end = s + q
            while end < len(w) and w[end] == w[end - q]:
                end += 1
            whole = w[s:end]
            if len(whole) >= max(least, exponent * q) and not any(whole[p:] == whole[:-p] for p in range(1, q)):
                out.append((s, len(whole), q))
    return out


def plain_collapsed(w, runs):
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    return " ".join(x for i, x in enumerate(w) if i not in gone)


def random_words(rnd):
    w = [rnd.randrange(rnd.choice([1, 2, 3, 9])) for _ in range(rnd.randint(0, 40))]
    if rnd.random() < 0.6:
        p = rnd.randint(1, 6)
        part = [rnd.randrange(3) for _ in range(p)]
        w = w[: len(w) // 2] + (part * 12)[: rnd.randint(3 * p, 8 * p)] + w[len(w) // 2 :]
    return w * 2 if rnd.random() < 0.2 else w


def test_runs_of_random_texts():
    rnd = random.Random(5)
    for _ in range(1500):
        docs = [random_words(rnd) for _ in range(rnd.randint(1, 4))]
        words, ends = np.array(sum(docs, []), np.int64), np.cumsum([len(d) for d in docs])
        if len(words):
            start, length, period = (x.tolist() for x in periodic.find_runs(words, ends))
            begins = [0, *ends.tolist()]
            wanted = [(s + b, n, q) for d, b in zip(docs, begins) for s, n, q in plain_runs(d)]
            assert list(zip(start, length, period)) == sorted(wanted, key=lambda r: (r[0], r[2]))


def test_other_constraints():
    rnd = random.Random(6)
    for least, exponent in [(9, 4), (8, 5), (20, 6), (2, 2), (7, 3)]:
        for _ in range(200):
            w = random_words(rnd)
            if w:
                found = periodic.find_runs(np.array(w), np.array([len(w)]), least, exponent)
                assert list(zip(*(x.tolist() for x in found))) == plain_runs(w, least, exponent)
    with pytest.raises(ValueError):
        periodic.find_runs(np.arange(9), np.array([9]), 6, 1)


def test_long_texts():
    for w, runs in [([1] * 300_000, [(0, 300_000, 1)]), (list(range(1000)) * 300, [(0, 300_000, 1000)]), (list(range(300_000)), [])]:
        found = periodic.find_runs(np.array(w), np.array([len(w)]))
        assert list(zip(*(x.tolist() for x in found))) == runs


def test_texts_of_any_kind(spark):
    texts = [None, "", " \t\n ", "a", "no repeats in this one", "x y " * 9, "a b\vc\fd " * 5 + "end", "ja " * 50_000, "a " * 6 + "b " * 6, "a " * 5, "A a " * 4]
    rows = [(i, t, "same") for i, t in enumerate(texts + texts[6:8])]  # rows that repeat others
    df = spark.createDataFrame(rows, "n_words long, text string, runs string")  # names that clash with those of the result
    found = df.select(F.col("n_words").alias("id"), "text", periodic.scan(spark, F.col("text")).alias("f")).collect()
    assert len(found) == len(rows)
    for r in found:
        w = WORD.findall(r.text or "")
        runs = plain_runs(w) if len(w) < 1000 else [(0, len(w), 1)]
        assert [(x.start, x.length, x.period) for x in r.f.runs] == runs, r.id
        assert (r.f.n_words, r.f.collapsed) == (len(w), plain_collapsed(w, runs))
    assert df.limit(0).select(periodic.scan(spark, F.col("text"))).count() == 0


def test_registered_query(spark):
    folder = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    found = QUERIES["op13_periodic_runs"](spark, folder).collect()
    assert {r.doc_id for r in found} == texts.keys() and len(found) == len(texts)
    seen = 0
    for r in found:
        w = WORD.findall(texts[r.doc_id])
        h = zlib.crc32(str(r.doc_id).encode())
        g, n = h // 10, len(w)
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
        runs = plain_runs(w) if n < 400 else list(zip(*(x.tolist() for x in periodic.find_runs(np.unique(w, return_inverse=True)[1], np.array([n])))))
        best = max(runs, key=lambda x: (x[1], -x[0], -x[2]), default=(None, None, None))
        assert (r.n_runs, r.start, r.length, r.period) == (len(runs), *best)
        assert r.exponent_milli == (1000 * best[1] // best[2] if runs else None)
        assert r.runs_sha256 == hashlib.sha256("".join(f"{s},{m},{q}\n" for s, m, q in runs).encode()).hexdigest()
        assert r.collapsed_sha256 == hashlib.sha256(plain_collapsed(w, runs).encode()).hexdigest()
        seen += len(runs)
    assert seen > 5
