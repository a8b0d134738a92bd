"""Sharding against a plain descent of the tree, and what a change of weights moves."""

from __future__ import annotations

import hashlib
import math
import zlib
from collections import Counter

from pyspark.sql import functions as F

from sievework.llm import sharding
from sievework.llm.sharding import EIGHT, NINTH, Shard
from tests.llm.test_operators import frame, odd_documents


def plain_shard(key, shards) -> int:
    """One level after another, each weight added up anew."""
    key, left = "" if key is None else str(key), list(shards)
    for path in (lambda s: f"{s.since}/{s.region}", lambda s: f"{s.since}/{s.region}/{s.rack}", lambda s: f"{s.since}/{s.region}/{s.rack}/{s.shard}"):
        weights = Counter()
        for s in left:
            weights[path(s)] += s.weight
        u = lambda p: (int(hashlib.md5(f"{key}/{p}".encode()).hexdigest()[:13], 16) + 0.5) / 16**13
        won = min(weights, key=lambda p: (-math.log(u(p)) / weights[p], p))
        left = [s for s in left if path(s) == won]
    return left[0].shard


def placed(spark, n, shards) -> list[int]:
    return [r.shard for r in sharding.assigned(spark.range(n).withColumnRenamed("id", "doc_id"), shards).orderBy("doc_id").collect()]


def test_query_on_odd_rows(spark, tmp_path):
    docs = [*odd_documents(), (5, None), (5, "other")]
    path = str(tmp_path)
    frame(spark, docs).withColumn("size", F.lit("x")).write.parquet(f"{path}/documents.parquet")
    found = sharding.op13_sharding(spark, path).collect()
    grown = [*EIGHT, NINTH]
    expected = sorted(((d, len((t or "").encode()) + 1, zlib.crc32((t or "").encode()), plain_shard(d, EIGHT), plain_shard(d, grown)) for d, t in docs), key=repr)
    assert sorted(((r.doc_id, r["size"], r.text_crc32, r.shard, r.grown_shard) for r in found), key=repr) == expected
    for shard in range(8):
        assert sorted(r.slot for r in found if r.shard == shard) == list(range(sum(r.shard == shard for r in found)))
    assert sharding.op13_sharding(spark, path).filter("false").count() == 0


def test_empty_table(spark, tmp_path):
    frame(spark, []).write.parquet(f"{tmp_path}/documents.parquet")
    assert sharding.op13_sharding(spark, str(tmp_path)).count() == 0


def test_a_new_shard_takes_rows_only_into_itself(spark):
    old = placed(spark, 20_000, EIGHT)
    for where in (NINTH, Shard("r0", "k0", 8, since=1), Shard("r9", "k9", 8, 3.0, since=1)):
        new = placed(spark, 20_000, [*EIGHT, where])
        assert all(b in (a, 8) for a, b in zip(old, new, strict=True))
        share = where.weight / (8 + where.weight)
        assert abs(new.count(8) / 20_000 - share) < 0.01


def test_changed_weights_move_rows_within_their_subtrees(spark):
    old = placed(spark, 20_000, EIGHT)
    # One rack gains what its neighbour loses: the other region keeps every row.
    new = placed(spark, 20_000, [s._replace(weight={"k0": 1.5, "k1": 0.5}[s.rack]) if s.region == "r0" else s for s in EIGHT])
    assert all(a == b for a, b in zip(old, new, strict=True) if a >= 4 or b >= 4)
    assert {(a // 2, b // 2) for a, b in zip(old, new, strict=True) if a != b} == {(1, 0)}
    # A shard that goes gives up its rows; no others leave its region.
    new = placed(spark, 20_000, EIGHT[:-1])
    assert all(a >= 4 or a == b for a, b in zip(old, new, strict=True))
    assert 7 not in new


def test_shares_follow_weights(spark):
    shards = [Shard("a", "x", 0, 1.0), Shard("a", "y", 1, 2.0), Shard("b", "x", 2, 4.0), Shard("b", "x", 3, 0.0), Shard("b", "z", 4, 1.0)]
    found = Counter(placed(spark, 40_000, shards))
    assert 3 not in found
    for s in shards:
        assert abs(found[s.shard] / 40_000 - s.weight / 8) < 0.01


def test_written_shards_hold_every_row(spark, tmp_path):
    docs = odd_documents()
    sharding.write_shards(frame(spark, docs), EIGHT, f"{tmp_path}/out")
    found = spark.read.parquet(f"{tmp_path}/out")
    assert sorted(((r.doc_id, r.text, r.shard_folder) for r in found.collect()), key=repr) == sorted(((d, t, plain_shard(d, EIGHT)) for d, t in docs), key=repr)
