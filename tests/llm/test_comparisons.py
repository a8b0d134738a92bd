"""What decides about repeats and links: bytes, words and wide names, not names that can meet."""

from __future__ import annotations

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sievework.llm import jaccard, recompression, repeats, shared, suffixes
from tests.llm import brute
from tests.llm.test_operators import frame, rows, same


def thue_morse(n: int) -> str:
    return "".join("ab"[bin(k).count("1") % 2] for k in range(n))


def test_words_with_equal_polynomials(spark):
    """Words of 1,024 letters whose polynomials modulo a power of two are equal are different words and bytes."""
    one = thue_morse(1024)
    two = one.translate(str.maketrans("ab", "ba"))
    words = " ".join(f"w{k}" for k in range(49))
    docs = [(1, f"{words} {one}"), (2, f"{words} {two}"), (3, one), (4, two), (5, f"{words} {one}")]
    df = frame(spark, docs)
    same(rows(jaccard.near_duplicates(df), "doc_id", "n_shingles", "component_id"), brute.op3(docs))
    same(rows(recompression.dedup_words(df), "doc_id", "n_words", "n_removed", "kept_sha256"), brute.op4(docs))
    same(rows(suffixes.dedup_bytes(df), "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"), brute.op1(docs))


def plain_later(texts: list[list], owner: list[int], length: int) -> list[bool]:
    least: dict = {}
    windows = [(o, tuple(t[k : k + length])) for t, o in zip(texts, owner, strict=True) for k in range(len(t) - length + 1)]
    for o, w in windows:
        least[w] = min(o, least.get(w, o))
    return [o > least[w] for o, w in windows]


@pytest.mark.parametrize("seed", range(4))
def test_suffixes_of_a_bucket(seed):
    """Suffixes whose ends are equal and whose middles are not, repeats at all shifts, and long ties."""
    r = random.Random(seed)
    ends = [bytes(r.choice(b"ab") for _ in range(13)) for _ in range(2)]
    middles = [bytes(r.choice(b"ab") for _ in range(24)) for _ in range(3)]
    texts = [bytes(r.choice(b"xy") for _ in range(r.randint(0, 20))) + r.choice(ends) + r.choice(middles) + r.choice(ends) + b"a" * r.randint(0, 90) for _ in range(60)]
    owner = [r.randint(1, 20) for _ in texts]
    bounds = np.cumsum([0, *map(len, texts)])
    found = suffixes.Bytes().later(np.frombuffer(b"".join(texts), dtype=np.uint8), bounds, np.array(owner))
    assert found.tolist() == plain_later([list(t) for t in texts], owner, 50)
    # without the ranks of the sample, ties of the ends would be taken for equal
    sampled = suffixes.Bytes._ranks
    suffixes.Bytes._ranks = staticmethod(lambda read, limits: np.ones(int(limits[-1]), dtype=np.uint32))
    try:
        assert suffixes.Bytes().later(np.frombuffer(b"".join(texts), dtype=np.uint8), bounds, np.array(owner)).tolist() != found.tolist()
    finally:
        suffixes.Bytes._ranks = staticmethod(sampled)


@pytest.mark.parametrize("seed", range(3))
def test_words_of_a_bucket(seed):
    r = random.Random(seed)
    texts = [[r.choice(["a", "b", "ab", "é"]) if r.random() < 0.02 else "a" for _ in range(r.randint(50, 90))] for _ in range(40)]
    owner = [r.randint(1, 9) for _ in texts]
    data = [" ".join([*t, ""]).encode() for t in texts]
    found = recompression.Words().later(np.frombuffer(b"".join(data), dtype=np.uint8), np.cumsum([0, *map(len, data)]), np.array(owner))
    assert found.tolist() == plain_later(texts, owner, 50)


def test_equal_names_of_different_stretches():
    data = np.frombuffer(b"abcabdabcabc", dtype=np.uint8)
    of, first = repeats.classes(np.array([7, 7, 7, 7], dtype=np.uint64), data, np.arange(0, 12, 3), np.full(4, 3))
    assert first.tolist() == [0, 1] and of.tolist() == [0, 1, 0, 0]


@pytest.mark.parametrize("unit", [suffixes.Bytes(), recompression.Words()])
def test_parts_of_long_texts(unit):
    """A long text in parts has the runs of the whole text, cut where a part begins."""
    r = random.Random(2)
    column = pa.array([" ".join(r.choice(["it", "was", "the", "best", "of", "times"]) for _ in range(900)), "short", ""])

    def named(most: int) -> list[tuple]:
        found = []
        for p in repeats.parts(column, unit, most):
            for start, size, name, owner in zip(p.start.tolist(), p.size.tolist(), p.names.tolist(), p.owner.tolist(), strict=True):
                found += [(p.first + owner, p.base + start - int(p.bounds[owner]) + k, name) for k in range(size)]
        return found

    assert len(list(repeats.parts(column, unit, 300))) > 5
    assert named(300) == named(1 << 20)


def test_rows_that_are_dealt_again_come_in_order(spark, monkeypatch):
    """A task that runs again after its executor was lost must deal the loads that it dealt before."""
    monkeypatch.setattr(shared, "BITMAP_BITS", 64)  # so few bits that every row is joined
    marked = spark.range(3000).select(F.md5(F.col("id").cast("string")).alias("mark"), "id")
    kept = shared.without(marked.repartition(5), marked.filter("id % 3 = 0"), "mark")
    found = kept.select("id", "mark", F.spark_partition_id().alias("p"), F.monotonically_increasing_id().alias("place")).collect()
    assert sorted(r.id for r in found) == [k for k in range(3000) if k % 3]
    by_place = [(r.p, r.mark) for r in sorted(found, key=lambda r: r.place)]
    assert by_place == sorted(by_place)
