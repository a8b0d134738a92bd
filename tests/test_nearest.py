"""Nearest names by tries against distances to every name."""

from __future__ import annotations

import random
import time

import pytest
from pyspark.sql import functions as F

from sievework.operators import nearest
from tests.test_ranks import edits


def some_names(n: int) -> list[str]:
    r = random.Random(12)
    part = lambda k: "".join(r.choice("aeioubcdl") for _ in range(k))
    return sorted({f"{r.choice(['Unnamed', 'Un', 'Baco', part(5).title()])} {part(r.randint(0, 6))}".strip() for _ in range(n)} | {"", "a", "É", "é", "UN", "un"})


def some_texts(names: list[str], n: int) -> list[str]:
    r = random.Random(13)
    out = ["", "zzzzzzzzzz", "é", "x" * 400]
    for _ in range(n):
        t = r.choice(names).lower()
        for _ in range(r.randint(0, 4)):
            k = r.randint(0, len(t))
            t = r.choice([t[:k] + "q" + t[k:], t[:k] + t[k + 1 :], t[:k] + "w" + t[k + 1 :]])
        out.append(t)
    return out


def plain(text: str, names: list[str], most: int):
    lower = {}
    for n in names:
        lower[n.lower()] = min(lower.get(n.lower(), n), n)
    found = [(e, n) for k, n in lower.items() if (e := edits(text, k)) <= most]
    return min(found) if found else None


@pytest.mark.parametrize("most", [1, 2, 3])
def test_walks_find_the_nearest(most):
    names = some_names(150)
    trie = nearest.build(sorted((k, min(n for n in names if n.lower() == k)) for k in {n.lower() for n in names}))
    for text in some_texts(names, 60):
        assert nearest.nearest_in(trie, text, most) == plain(text, names, most), text


def test_blocks_of_names(spark, monkeypatch):
    """Blocks of 20 names: beginnings with more names than that spread over several."""
    monkeypatch.setattr(nearest, "BLOCK", 20)
    names, texts = some_names(150), some_texts(some_names(150), 50)
    dictionary = spark.createDataFrame([(n, 1) for n in names] + [(None, 1)], "name string, block int")
    asked = spark.createDataFrame([(t, 2) for t in texts + texts] + [(None, 2)], "key string, kind int")
    found = {r.key: (r.edits, r.name) for r in nearest.nearest_names(asked, dictionary, 2).collect()}
    assert found == {t: p for t in texts if (p := plain(t, names, 2))}
    assert nearest.nearest_names(asked, dictionary.limit(0), 2).isEmpty()
    assert nearest.nearest_names(asked.limit(0), dictionary, 2).isEmpty()


def test_two_million_names(spark):
    """Names that Spark makes from numbers, and texts one edit from some of them."""
    code = lambda c: F.translate(c.cast("string"), "0123456789", "aeioubcdlm")
    dictionary = spark.range(2_000_000).select(F.concat(F.lit("Genus "), code(F.col("id") % 1000), F.lit(" species "), code(F.col("id") * 7919)).alias("name"))
    own = dictionary.filter(F.xxhash64("name") % 100_000 == 0)
    asked = own.select("name", F.lower(F.regexp_replace("name", "species", "spezies")).alias("key"))
    start = time.time()
    found = asked.join(nearest.nearest_names(asked, dictionary, 2), "key").toDF("key", "own", "name", "edits").collect()
    assert len(found) == asked.count() > 5
    assert all(r.edits == 1 and r.name == r.own for r in found)
    assert time.time() - start < 300
