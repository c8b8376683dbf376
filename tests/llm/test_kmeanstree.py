"""Nearest vectors by the k-means tree against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from sheaf.llm import kmeanstree
from sheaf.llm.queries import QUERIES

SCHEMA = "vec_id long, embedding array<float>"


def plain(rows, asking, neighbours=20):
    """(query, rank) -> (vec_id, score), all compared with all."""
    sound = {(i, tuple(map(float, v))) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)}
    out = {}
    for q, v in sound:
        if asking(q):
            near = sorted((-float((np.array(v) * np.array(w)).sum()), i) for i, w in sound if i != q and len(w) == len(v))
            for rank, (away, i) in enumerate(near[:neighbours], 1):
                out[q, rank] = (i, -away)
    return out


def found(df):
    rows = df.collect()
    out = {(r.query_id, r["rank"]): (r.vec_id, r.score) for r in rows}
    assert len(out) == len(rows)
    return out


def clustered(rng, n, length, centres):
    middle = rng.normal(size=(centres, length))
    return (middle[rng.integers(centres, size=n)] + 0.4 * rng.normal(size=(n, length))).astype(np.float32)


@pytest.mark.parametrize("block", [None, 16])
def test_full_recall_is_brute_force(spark, block):
    rng = np.random.default_rng(4)
    rows = [(i, v.tolist()) for i, v in enumerate(clustered(rng, 400, 6, 12))]
    rows += [(1000 + i, rows[7][1]) for i in range(60)]  # one vector many times, in queries and answers
    rows += [(2000 + i, rng.integers(-2, 3, 6).astype(float).tolist()) for i in range(80)]  # equal scores
    rows += [(3000 + i, rng.normal(size=3).tolist()) for i in range(9)]  # another length, fewer than asked for
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    rows = [(r.vec_id, r.embedding) for r in df.collect()]
    got = found(kmeanstree.nearest(df, F.col("vec_id") % 20 == 0, recall=1.0, block=block))
    wanted = plain(rows, lambda i: i % 20 == 0)
    missed = [k for k in wanted if got.get(k, (None, 0))[0] != wanted[k][0]]
    assert got.keys() == wanted.keys() and len(missed) <= 0.01 * len(wanted)  # calibrated on the queries themselves: all of them
    assert all(got[k][1] == wanted[k][1] for k in wanted if k not in missed)


def test_recall_and_calibration(spark):
    rng = np.random.default_rng(5)
    rows = [(i, v.tolist()) for i, v in enumerate(clustered(rng, 6000, 16, 40))]
    df = spark.createDataFrame(rows, SCHEMA)
    got = found(kmeanstree.nearest(df, F.col("vec_id") % 20 == 0))
    vectors = np.array([r[1] for r in rows])
    share = []
    for q in range(0, 6000, 20):
        scores = vectors @ vectors[q]
        scores[q] = -np.inf
        best = set(np.argsort(-scores)[:20].tolist())
        share.append(len(best & {got[q, k][0] for k in range(1, 21)}) / 20)
    assert 0.93 <= np.mean(share)
    tree = kmeanstree.fit(vectors, float(np.sqrt((vectors**2).sum(1).max())))
    leaf = tree.assign(kmeanstree._raised(vectors, tree.reach))
    assert sorted(tree.visits(np.append(vectors[0], 0.0), tree.leaves)) == list(range(tree.leaves)) == sorted(set(leaf.tolist()) | set(range(tree.leaves)))
    truth = [leaf[np.argsort(-(vectors @ v))[:20]] for v in vectors[:50]]
    few, many = (kmeanstree.calibrated(tree, vectors[:50], truth, goal) for goal in (0.6, 0.97))
    assert 1 <= few < many < tree.leaves / 2  # widened, but far from a full scan
    for goal, m in ((0.6, few), (0.97, many)):
        met = lambda m: np.mean([x in tree.visits(np.append(v, 0.0), m) for v, t in zip(vectors[:50], truth) for x in t])  # noqa: E731, B023
        assert met(m) >= goal > met(m - 1)


def test_edges(spark):
    bad = [(0, None), (20, []), (40, [0.0, 0.0]), (60, [1.0, None]), (80, [float("nan"), 1.0]), (100, [float("inf"), 1.0]), (None, [1.0, 1.0])]
    good = [(120, [1.0, 0.0]), (121, [0.5, 0.5]), (121, [2.0, 0.0]), (122, [1e-30, 0.0]), (123, [-3e30, 1.0]), (140, [1.0, 0.0]), (140, [1.0, 0.0])]
    df = spark.createDataFrame([(*r, 0.5, "x") for r in bad + good], SCHEMA + ", score double, first string")
    rows = [(r.vec_id, r.embedding) for r in df.collect()]
    assert found(kmeanstree.nearest(df, F.col("vec_id") % 20 == 0)) == plain(rows, lambda i: i % 20 == 0)
    assert kmeanstree.nearest(df.limit(0), F.col("vec_id") % 20 == 0).count() == 0
    assert kmeanstree.nearest(df.where("vec_id = 121"), F.col("vec_id") % 20 == 0).count() == 0  # nobody asks
    assert kmeanstree.nearest(df.where("vec_id = 120"), F.col("vec_id") % 20 == 0).count() == 0  # nobody else is there


def test_registered_query(spark):
    folder = "/root/testdata/sf0.01"
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{folder}/embeddings.parquet").collect()]
    got, wanted = found(QUERIES["op11_kmeans_tree"](spark, folder)), plain(rows, lambda i: i % 20 == 0)
    assert got.keys() == wanted.keys()
    queries = {q for q, _ in wanted}
    hit = [len({got[q, k][0] for k in range(1, 21)} & {wanted[q, k][0] for k in range(1, 21)}) for q in queries]
    assert sum(hit) >= 0.9 * 20 * len(queries)
