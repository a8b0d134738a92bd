"""The trie of conversations against a plain version that keeps every prefix."""

from __future__ import annotations

import random

import pytest

from sievework.llm import conversations
from sievework.llm.conversations import Item, Losers, common
from tests.llm import brute

COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def odd_conversations() -> list[tuple]:
    r = random.Random(4)
    text = lambda: r.choice(["", "a", "é" * 3, "longer text"])
    rows = [(c, t, r.choice(["user", "assistant", None]), text()) for c in range(60) for t in range(r.choice([1, 2, 3, 5, 12]))]
    rows += [(c, t, "user", "same") for c in range(100, 160) for t in range(3)]  # many equal conversations
    rows += [(-7, 0, "user", "x"), (-5, 0, "user", "x"), (-5, 1, "user", "y"), (-3, 0, None, None), (0, 0, "user", "z")]
    rows += [(200, None, "user", "first"), (200, 1, "user", "later"), (200, 1, "user", "tie"), (200, 1, "user", "tie"), (None, 0, "user", "nobody"), (None, None, None, None)]
    rows += [(300, t, "user", "x" * (t % 7)) for t in range(400)] + [(301, 0, "user", "L" * 200_000), (302, 0, "us", "er"), (303, 0, "user", "")]
    r.shuffle(rows)
    return rows


def check(spark, rows) -> None:
    df = spark.createDataFrame([(*r, 1, "n", b"k") for r in rows], "conv_id long, turn long, role string, text string, base int, name string, key binary").repartition(3)
    found = sorted((tuple(r) for r in conversations.prefix_trie(df).select(COLUMNS).collect()), key=repr)
    assert found == sorted(brute.op12(rows), key=repr)


@pytest.mark.parametrize("run_turns", [1 << 16, 7])
def test_odd_rows(spark, monkeypatch, run_turns):
    monkeypatch.setattr(conversations, "RUN_TURNS", run_turns)
    monkeypatch.setattr(conversations, "RANGE_TURNS", 60)
    monkeypatch.setattr(conversations, "CHUNK", 3)
    monkeypatch.setattr(conversations, "BATCH", 5)
    check(spark, odd_conversations())


def test_empty_table_and_single_rows(spark):
    check(spark, [])
    check(spark, [(None, 1, "user", "x")])
    check(spark, [(3, 1, "user", "x")])


def test_losers_merge_runs_with_their_lcps():
    r = random.Random(2)
    items = [Item(k, [bytes([r.randint(0, 2)]) for _ in range(r.randint(0, 6))], []) for k in range(300)]
    order = lambda i: (i.names, i.conv_id)
    for n in (1, 2, 3, 7, 8, 40):
        runs = [sorted(items[k::n], key=order) for k in range(n)]
        given = [[(common(run[k - 1].names, run[k].names) if k else 0, run[k]) for k in range(len(run))] for run in runs]
        merged = list(Losers(given))
        assert [i for _, i in merged] == sorted(items, key=order)
        assert [p for p, _ in merged[1:]] == [common(a.names, b.names) for (_, a), (_, b) in zip(merged, merged[1:], strict=False)]


def test_losers_compare_no_shared_turn_again(monkeypatch):
    """Items of one long prefix: after the first matches, no comparison starts before its end."""
    prefix = [b"p"] * 50
    runs = [[(50 if k else 0, Item(10 * k + n, [*prefix, bytes([k]), bytes([n])], [])) for k in range(20)] for n in range(8)]
    starts = []
    plain = conversations.common
    monkeypatch.setattr(conversations, "common", lambda a, b, start=0: (starts.append(start), plain(a, b, start))[1])
    assert len(list(Losers(runs))) == 160
    assert sum(s < 50 for s in starts) <= 8
