"""SimHash, vector joins and components against brute force."""

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from sheaf.llm import gridjoin, simhash
from sheaf.llm.components import connected


def reach(n, links):
    root = list(range(n))

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = top(a), top(b)
        root[max(a, b)] = min(a, b)
    return [top(i) for i in range(n)]


def plain_print(text):
    words = [w for w in "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").replace("\t", " ").replace("\n", " ").split(" ") if w]
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    h = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) if h else 0


def test_fingerprints(spark):
    texts = ["The quick BROWN fox\tjumps\n over", "one", "one two", None, "", " \n ", "Äpfel ÄPFEL x a b", "a b c " * 30000]
    for t in texts[:-1]:
        assert simhash.fingerprint((t or "").encode()) == plain_print(t)
    joined = spark.createDataFrame([(" ".join(t.lower().split()[:3]),) for t in texts if t and len(t.split()) >= 3], "s string")
    assert [r[0] & (2**64 - 1) for r in joined.select(F.xxhash64("s")).collect()] == [xxhash.xxh64_intdigest(r.s, 42) for r in joined.collect()]
    assert simhash.fingerprint(texts[-1].encode()) == plain_print("a b c a b")  # the same three shingles


@pytest.mark.parametrize("node_rows", [4096, 8])
def test_trie_join_finds_all_links(spark, node_rows):
    rng = np.random.default_rng(4)
    base = rng.integers(0, 2**63, 60, dtype=np.uint64)
    prints = set(map(int, base))
    for b in base[:12]:  # families, one of them crowded
        for _ in range(60 if b == base[0] else 6):
            x = int(b)
            for bit in rng.integers(0, 64, rng.integers(1, 4)):
                x ^= 1 << int(bit)
            prints.add(x)
    prints = sorted(x - 2**64 if x >= 2**63 else x for x in prints)
    arr = np.array(prints, np.int64).view(np.uint64)
    links = [(i, j) for i in range(len(arr)) for j in np.flatnonzero(np.bitwise_count(arr[i] ^ arr) <= 2) if i < j]
    df = spark.createDataFrame([(x,) for x in prints], "fp long")
    found = {r.node: r.root for r in connected(simhash.trie_links(df, 2, node_rows)).collect()}
    at = {x: i for i, x in enumerate(prints)}
    got = [at[found.get(x, x)] for x in prints]
    assert got == reach(len(prints), links)


def test_near_duplicates_edges(spark):
    rows = [(5, "a b c d"), (3, "A b C d"), (9, None), (8, ""), (7, "x y z w"), (7, "x y z w"), (None, "a b c d"), (None, "only here without id")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"fp": F.lit("x"), "root": F.lit(0), "node": F.lit(1)})
    out = simhash.near_duplicates(df)
    got = sorted(((r.doc_id, r.component_id) for r in out.collect()), key=str)
    assert got == sorted([(None, None), (None, 3), (3, 3), (5, 3), (7, 7), (7, 7), (8, 8), (9, 8)], key=str)
    kept = simhash.keep_first(df, simhash.classes(df))
    assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=str) == sorted([(3, "A b C d"), (7, "x y z w"), (8, ""), (None, "only here without id")], key=str)
    assert kept.columns == df.columns
    assert simhash.near_duplicates(df.limit(0)).collect() == []


def test_one_row_of_each_group_stays_whatever_its_id(spark):
    near = "one two three four five six seven eight nine ten eleven twelve"
    rows = [(1, near), (1, "quite another text of its own"), (1, "and a third one that nobody repeats"), (2, "quite another text of its own"), (None, near), (None, "alone"), (None, "alone"), (4, None), (4, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"__x": F.lit(1), "root": F.lit("r"), "k": F.lit(None).cast("string"), "text_hash": F.lit(0)})
    got = sorted(((r.doc_id, r.text or "") for r in simhash.keep_first(df, simhash.classes(df)).collect()), key=str)
    assert got == sorted([(1, near), (1, "quite another text of its own"), (1, "and a third one that nobody repeats"), (None, "alone"), (4, "")], key=str)
    assert simhash.keep_first(df.limit(0), simhash.classes(df.limit(0))).collect() == []


def test_connected(spark):
    rng = np.random.default_rng(1)
    links = [(int(a), int(b)) for a, b in rng.integers(0, 300, (250, 2))] + [(i, i + 1) for i in range(300, 380)]  # and a long chain
    root = reach(400, links)
    got = {r.node: r.root for r in connected(spark.createDataFrame([*links, (1, None)], "a long, b long")).collect()}
    assert all(got[i] == root[i] for link in links for i in link if i in got)
    assert {i for a, b in links if a != b for i in (a, b)} == set(got)
    assert connected(spark.createDataFrame([], "a long, b long")).collect() == []


@pytest.mark.parametrize("spread", [0.05, 0.3])
def test_vectors_against_all_pairs(spark, spread):
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(25, 12))
    rows = [(i, [float(np.float32(x)) for x in centres[i % 25] + rng.normal(size=12) * spread]) for i in range(400)]
    rows += [(1000 + i, rows[3][1]) for i in range(40)]
    v = np.array([r[1] for r in rows])
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    near = u @ u.T >= 0.9
    np.fill_diagonal(near, False)
    root = reach(len(rows), np.argwhere(np.triu(near)))
    out = {r.vec_id: r for r in gridjoin.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), block=32).collect()}
    assert all(out[r[0]].n_links == near[i].sum() and out[r[0]].component_id == rows[root[i]][0] for i, r in enumerate(rows))


def test_vectors_edges(spark):
    bad = [(1, None), (2, []), (3, [0.0, 0.0]), (4, [float("nan"), 1.0]), (5, [1.0, None]), (6, [float("inf"), 1.0])]
    rows = [*bad, (7, [1.0, 1.0]), (8, [2.0, 2.0]), (8, [2.0, 2.0]), (9, [1.0, 1.0, 1.0]), (None, [3.0, 3.0]), (10, [-1.0, -1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumns({"vector": F.lit(1), "node": F.lit(2), "n": F.lit(3), "label": F.lit(None).cast("int")})
    out = gridjoin.near_vectors(df).collect()
    got = {(r.vec_id, r.n_links, r.component_id, r.kept) for r in out}
    assert len(out) == len(rows)
    assert {(i, 0, i, True) for i, _ in bad} <= got
    assert {(7, 3, 7, True), (8, 3, 7, False), (None, 3, 7, False), (9, 0, 9, True), (10, 0, 10, True)} <= got
    assert gridjoin.near_vectors(df.limit(0)).collect() == []
    assert len(gridjoin.near_vectors(df.where("vec_id < 7")).collect()) == 6
