"""Entities that use up the surrogates of their format all get one, and none that another has."""

from __future__ import annotations

from sievework.llm import pii
from tests.llm.test_operators import frame


def test_a_country_code_without_free_numbers(spark):
    """All 1,000 numbers of a code and three digits are entities, so no surrogate of their format is free."""
    docs = [(k, f"call +358{k:03}") for k in range(1000)]
    found = pii.replace_entities(frame(spark, docs), b"key").collect()
    assert sorted(r.doc_id for r in found) == list(range(1000))
    new = [pii.normal("phone", r.text.removeprefix("call ")) for r in found]
    old = {f"+358{k:03}" for k in range(1000)}
    assert len(set(new)) == 1000 and not old & set(new)
    assert all(n.startswith("+") and n[1:].isdigit() for n in new)


def test_many_short_names(spark):
    docs = [(k, f"Mr {a}{b}{c} was here") for k, (a, b, c) in enumerate((a, b, c) for a in "BDFGKL" for b in "aeio" for c in "nrsk")]
    found = pii.replace_entities(frame(spark, docs), b"key").collect()
    names = {r.text.split(" ")[1] for r in found}
    assert len(names) == len(docs) and not names & {t.split(" ")[1] for _, t in docs}


def test_the_last_attempt_is_always_free():
    for kind, entity in (("card", "4539148803436467"), ("ip", "8.8.8.8"), ("phone", "+358123"), ("name", "m:lee"), ("email", "a@b.org")):
        a, b = (pii.surrogate(kind, entity, b"key", k) for k in (pii.LAST, pii.LAST + 1))
        assert a != b and a == pii.surrogate(kind, entity, b"key", pii.LAST)
        assert pii.render(kind, entity, a) == a


def test_numbers_grow():
    sizes = [len(pii.surrogate("phone", "+358123", b"key", k)) for k in (0, pii.WIDEST, pii.WIDEST + 4)]
    assert sizes == [7, 7, 9]
    assert pii.render("phone", "+358 123", "+12345678") == "+123 45678"
