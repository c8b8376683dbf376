"""Conversation trie against a plain trie; its queue against a sort; running hashes against plain ones."""

import hashlib
import random
import re
import zlib

import duckdb
import pytest
from pyspark.sql import functions as F

from sheaf.llm import ordered, prefixtrie
from sheaf.llm.oracle import ORACLE
from sheaf.llm.queries import QUERIES

COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def plain_trie(convs):
    """Rows of the trie of ``{conv_id: [(role, text), ...]}``."""
    members = {}
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(c)
    out = []
    for path, ids in members.items():
        below = [p for p in members if p[: len(path)] == path]
        parents = {p[:-1] for p in members if p}
        own = lambda p: (len(members[p]) - 1) * (len(re.findall(r"[^\x20\x09-\x0D]+", p[-1][1])) if p else 0)
        ends = ",".join(str(c) for c in sorted(ids) if len(convs[c]) == len(path))
        out.append(
            (
                min(ids),
                len(path),
                min(members[path[:-1]]) if path else None,
                len(ids),
                sum(len(p) == len(path) + 1 for p in below),
                sum(p not in parents for p in below),
                sum(map(own, below)),
                hashlib.sha256(ends.encode()).hexdigest(),
            )
        )
    return sorted(out, key=str)


def rows_of(df):
    return sorted((tuple(r[c] for c in COLUMNS) for r in df.collect()), key=str)


def ordered_turns(rows):
    out = {}
    for c, turn, role, text in rows:
        if c is not None:
            out.setdefault(c, []).append((turn, role or "", text or ""))
    return {c: [t[1:] for t in sorted(ts, key=lambda t: (t[0] is not None, t[0] or 0))] for c, ts in out.items()}


def table(spark, rows):
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")


def random_rows(rnd, convs, deep):
    rows = []
    for c in range(convs):
        length = deep if c % 17 == 3 else rnd.randint(1, 6)
        shared = rnd.random() < 0.4
        rows += [(c, t, "user" if t % 2 else None, "same opening" if shared and t < 3 else f"say {rnd.randint(0, 1)} {'x ' * (t % 3)}") for t in range(length)]
    rnd.shuffle(rows)
    return rows


@pytest.mark.parametrize("shard_rows,band,queue_rows", [(None, 256, 100_000), (1, 1, 2), (3, 4, 5), (20, 3, 4), (10**6, 256, 3)])
def test_any_dealing_gives_the_plain_trie(spark, shard_rows, band, queue_rows):
    rows = random_rows(random.Random(7), 60, 40)
    found = prefixtrie.trie(table(spark, rows), shard_rows=shard_rows, band=band, queue_rows=queue_rows)
    assert rows_of(found) == plain_trie(ordered_turns(rows))


def test_edges(spark):
    rows = [(5, None, "user", "first"), (5, 1, "user", None), (5, 2, None, ""), (-3, 0, "user", "first"), (-3, 1, "user", ""), (None, 0, "user", "lost"), (9, 0, "user", "w " * 20_000), (2**62, 7, "a", "bc"), (8, 7, "ab", "c")]
    df = table(spark, rows).withColumns({"n": F.lit(1), "part": F.lit("x"), "hi": F.lit(None)})  # names used inside
    assert rows_of(prefixtrie.trie(df)) == plain_trie(ordered_turns(rows))
    assert prefixtrie.trie(df.limit(0)).count() == 0
    again = table(spark, [(1, 0, "u", "a"), (1, 0, "u", "a"), (2, 0, "u", "a")])  # a repeated row is a turn of its own
    assert rows_of(prefixtrie.trie(again)) == plain_trie({1: [("u", "a")] * 2, 2: [("u", "a")]})


def test_queue_spills_in_order():
    rnd = random.Random(3)
    queue, plain = prefixtrie.SpillingQueue(8), []
    for _ in range(5000):
        if plain and rnd.random() < 0.45:
            assert queue.head() == min(plain)
            plain.remove(queue.pop())
        else:
            plain.append((rnd.randrange(50), rnd.random()))
            queue.push(plain[-1])
    assert queue.runs
    assert [queue.pop() for _ in range(len(plain))] == sorted(plain)
    assert queue.head() is None


def test_running_over_many_ranges(spark):
    rnd = random.Random(2)
    rows = [(g, i, rnd.randrange(-(2**63), 2**63)) for g, size in [(1, 3000), (2, 1), (-5, 40), (7, 900)] for i in range(size)]
    rnd.shuffle(rows)
    df = spark.createDataFrame(rows, "g long, at long, x long").repartition(11)
    found = ordered.running(df, "g", ["at"], ("x",)).collect()
    assert len(found) == len(rows) and all(r.n == r["at"] for r in found)
    sums = {}
    for r in sorted(found, key=lambda r: (r.g, r["at"])):
        before = sums.get(r.g, 0)
        sums[r.g] = (before + r.x * pow(ordered.BASES[0], r.n, 2**64)) % 2**64
        assert (r.to_x % 2**64, r.at_x % 2**64) == (before, sums[r.g])


def test_registered_query(spark):
    folder = "/root/testdata/sf0.001"
    turns = ordered_turns([tuple(r) for r in spark.read.parquet(f"{folder}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()])
    rebuilt = {}
    for c, own in turns.items():
        h = zlib.crc32(str(c).encode()) % 4
        rebuilt[c] = turns.get(c - c % 20, [])[:h] + own[h:]
    assert rows_of(QUERIES["op12_prefix_trie"](spark, folder)) == plain_trie(rebuilt)


def test_query_equals_sql(spark):
    folder = "/root/testdata/sf0.01"
    duck = duckdb.connect()
    duck.sql(f"CREATE VIEW conversations AS SELECT * FROM '{folder}/conversations.parquet'")
    wanted = duck.sql(f"SELECT {', '.join(COLUMNS)} FROM ({ORACLE['op12_prefix_trie']})").fetchall()
    assert rows_of(QUERIES["op12_prefix_trie"](spark, folder)) == sorted(wanted, key=str)
