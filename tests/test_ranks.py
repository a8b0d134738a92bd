"""Order statistics against sorted lists, and texts a few edits apart against all pairs."""

from __future__ import annotations

import math
import random

import pytest
from pyspark.sql import functions as F

from sievework.operators import ranks
from sievework.operators import validators as V
from sievework.operators.typos import close_pairs


def columns() -> dict[str, list[float]]:
    r = random.Random(1)
    return {
        "even": [float(k) for k in range(5000)],
        "equal": [7.0] * 50,
        "one": [3.5],
        "far": [r.random() for _ in range(3000)] + [1e300, -1e300],
        "scales": [r.choice([-1, 1]) * 10.0 ** r.randint(-300, 300) for _ in range(400)],
        "ends": [math.inf, -math.inf, math.nan, 1.0, 2.0, math.inf],
        "tiny": [5e-324, 0.0, 1e-323, -5e-324],
        "widest": [1.7e308, -1.7e308, 0.0, 1.0],
        "few": [r.choice([1.0, 2.0, 1e9]) for _ in range(999)],
    }


@pytest.mark.parametrize("buckets", [4096, 2])
def test_ranks_of_all_columns_at_once(spark, monkeypatch, buckets):
    given = columns()
    if buckets < 4096:
        given = {c: v for c, v in given.items() if c in ("equal", "one", "ends", "few")}
    monkeypatch.setattr(ranks, "BUCKETS", buckets)
    df = spark.createDataFrame([(c, x) for c, v in given.items() for x in [*v, None]], "column string, v double").groupBy("column", "v").agg(F.count("*").alias("n")).repartition(5)
    found = ranks.order_statistics(df.cache())
    order = lambda x: (math.isnan(x), x)
    for c, v in given.items():
        expected = [sorted(v, key=order)[ranks.nearest(s, len(v))] for s in ranks.QUARTERS]
        assert [repr(x) for x in found[c]] == [repr(x) for x in expected], c
    assert ranks.order_statistics(df.filter("column = 'few'"), {"few": [0, 998, 500]})["few"] == [sorted(given["few"])[k] for k in (0, 998, 500)]


def test_no_numbers(spark):
    df = spark.createDataFrame([(1, None)], "id int, x double")
    assert ranks.quartiles(df, "x") is None
    r = V.iqr_outliers(df, "x").first()
    assert (r.q1, r.n, r.occurrences) == (None, 0, 0)


def edits(a: str, b: str) -> int:
    last = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
        last = row
    return last[-1]


def near_texts() -> tuple[list[str], list[str]]:
    r = random.Random(6)
    base = ["".join(r.choice("abcé ") for _ in range(n)) for n in (0, 1, 3, 4, 5, 8, 20, 38, 39, 40, 41, 42, 43, 60, 90)] + ["same start of a long text, over and over again " + x for x in ("one", "two")]

    def changed(t: str) -> str:
        for _ in range(r.randint(0, 4)):
            k = r.randint(0, len(t))
            t = r.choice([t[:k] + "x" + t[k:], t[:k] + t[k + 1 :], t[:k] + "y" + t[k + 1 :]])
        return t

    return [changed(t) for t in base for _ in range(6)], base + [changed(t) for t in base]


def test_close_pairs(spark):
    left, right = near_texts()
    a = spark.createDataFrame([("c", t) for t in set(left)] + [("d", "abcd")], "column string, text string")
    b = spark.createDataFrame([("c", t) for t in set(right)] + [("e", "abcd")], "column string, text string")
    found = {(r.text, r.other): r.edits for r in close_pairs(a, b.withColumnRenamed("text", "other")).collect()}
    assert found == {(x, y): e for x in left for y in right if (e := edits(x, y)) <= 2}
    assert len(found) > 50
