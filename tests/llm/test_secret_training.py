"""What the secret scan learns from."""

import numpy as np
from pyspark.sql import functions as F

from sheaf.llm import secretscan


def test_every_text_teaches(spark):
    """Words, paths and findings of more texts than a sample would hold."""
    rows = [(f"token = {i:032x} and ordinary words number{chr(97 + i % 26)} {'zebrafish' if i == 777 else 'horse'} stand here", f"top{i}/x") for i in range(900)]
    model = secretscan.train(spark.createDataFrame(rows, "text string, source string"))
    assert "zebrafish" in model.known.words and len(model.known.rates) >= 890
    assert model.known.pairs["ze"] > -9.0


def test_late_findings_teach(spark):
    """The fifth finding of a text and later ones count."""
    text = " ".join(f"password: wordsalone{chr(97 + i)}" for i in range(9))
    model = secretscan.train(spark.createDataFrame([(text, "p")], "text string, source string"))
    one = secretscan.train(spark.createDataFrame([(text.split(" password", 1)[0], "p")], "text string, source string"))
    share = lambda m: m.known.rates[secretscan.slot("p")]
    assert model.known.words >= {f"wordsalone{chr(97 + i)}" for i in range(9)}
    assert model.forest.trees and one.forest.trees and share(model) != share(one)


def test_forest_is_the_same_however_rows_lie(spark):
    rng = np.random.default_rng(1)
    x = rng.integers(0, 9, (3000, len(secretscan.FEATURES))).astype(float)
    y = (x[:, 3] + x[:, 7] > 8).astype(int)
    rows = spark.createDataFrame([(i, int(t), v.tolist()) for i, (t, v) in enumerate(zip(y, x, strict=True))], "key long, y int, x array<double>")
    a, b = (secretscan.grow_all(rows.repartition(n, F.xxhash64("key"))) for n in (1, 7))
    assert all((u == v).all() for s, t in zip(a.trees, b.trees, strict=True) for u, v in zip(s, t, strict=True))
    assert ((a.score(x) >= 0.5) == y).mean() > 0.9
    assert ((secretscan.grow(x, y).score(x) >= 0.5) == y).mean() > 0.9
