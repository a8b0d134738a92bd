"""Entities of sentences labelled by hand, and what replaces them."""

from __future__ import annotations

import re

import pytest

from sievework.llm import pii
from tests.llm.test_operators import frame

#: Text with entities in brackets, as [kind|entity number|value]: equal numbers are one person, account and so on.
LABELLED = [
    "Dear [name|1|John Smith], Mr [name|1|Smith] of John Street called. [name|1|Smith]'s wife, Mrs [name|2|Eva Jones], saw [name|1|John].",
    "Dr. [name|1|Kowalski] met Prof [name|2|Lee] and Dr. [name|1|Kowalski] again.",
    "Yesterday [name|1|Maria O. Garcia-Lopez] wrote; [name|1|Garcia-Lopez] is well.",
    "My name is [name|1|Xiu Zhang]. Signed by [name|1|Xiu Zhang]",
    "Sr. [name|1|José Núñez] y Frau [name|2|Ursula Weiß]; Mr [name|3|Иван Петров].",
    "[name|1|Peter Young] and Young people; young and old. John Street, Victoria Park, Charles University are places.",
    "Write to [email|1|a.b@corp.example.org] or [email|1|A.B@CORP.EXAMPLE.ORG], not [email|2|c@d.co.uk].",
    "IBAN [iban|1|DE89 3704 0044 0532 0130 00] IS [iban|1|DE89370400440532013000], [iban|2|GB82WEST12345698765432]; DE88370400440532013000 is wrong.",
    "SSN [ssn|1|123-45-6789], [ssn|2|219-09-9999]; 000-12-3456, 666-12-3456, 123-00-4567 and 1123-45-6789 are none.",
    "[ipv6|1|2001:DB8:0:0:8:800:200C:417A] is [ipv6|1|2001:db8::8:800:200c:417a]; [ipv6|2|fe80::1]; std::vector, a::b, 12:30:45 are not. [ip|3|192.168.1.20].",
    "Call [phone|1|+1 202-555-0147] or [phone|1|+12025550147]; pay with [card|2|4539 1488 0343 6467].",
    "Plain prose about the Black Sea, Monday Morning and The River. No one is named here; 10:20, 3-4-5 and A::B too.",
    "",
]
MARK = re.compile(r"\[(\w+)\|(\d)\|([^]]*)\]")


def plain(labelled: str) -> tuple[str, list[tuple]]:
    """The text without brackets, and its entities: start, end, kind, number."""
    text, spans, at = "", [], 0
    for m in MARK.finditer(labelled):
        text += labelled[at : m.start()]
        spans.append((len(text), len(text) + len(m[3]), m[1], m[2]))
        text, at = text + m[3], m.end()
    return text + labelled[at:], spans


@pytest.mark.parametrize("labelled", LABELLED)
def test_spans_and_coreference(labelled):
    text, spans = plain(labelled)
    found = pii.entities(text, pii._compiled())
    assert [f[:3] for f in found] == [s[:3] for s in spans]
    pairs = {((f[2], f[3]), (s[2], s[3])) for f, s in zip(found, spans, strict=True)}
    assert len(pairs) == len({a for a, _ in pairs}) == len({b for _, b in pairs})


def test_replacement(spark):
    """Outside of entities nothing changes; one entity has one surrogate in all texts, and parts of names follow the whole."""
    texts = [plain(x)[0] for x in LABELLED]
    found = {r.doc_id: r for r in pii.replace_entities(frame(spark, list(enumerate(texts)) + [(100, None)]), b"key").collect()}
    assert found[100].text == ""
    given: dict = {}
    for k, labelled in enumerate(LABELLED):
        text, spans = plain(labelled)
        gaps, at = [], 0
        for a, b, _, _ in spans:
            gaps.append(text[at:a])
            at = b
        m = re.fullmatch("(.+)".join(map(re.escape, [*gaps, text[at:]])), found[k].text)
        assert m, found[k].text
        known = pii.entities(text, pii._compiled())
        for new, (a, b, kind, _), (_, _, _, entity) in zip(m.groups(), spans, known, strict=True):
            assert new != text[a:b]
            given.setdefault((kind, entity), []).append((text[a:b], new))
        assert [sum(s[2] == kind for s in spans) for kind in pii.KINDS] == [found[k][f"n_{kind}"] for kind in pii.KINDS]
    smith = dict(given["name", "m:john smith"])
    assert smith["John Smith"] == f"{smith['John']} {smith['Smith']}"
    new_names = [x[0][1] for (kind, _), x in given.items() if kind == "name"]
    assert len(set(new_names)) == len(new_names)
    for (kind, _), pairs in given.items():
        if kind != "name":
            assert len({pii.normal(kind, new) for _, new in pairs}) == 1
            assert all([c.isdigit() for c in old] == [c.isdigit() for c in new] for old, new in pairs if kind in ("iban", "ssn", "card", "phone"))
    assert all(pii.mod97(new.replace(" ", "")) == 1 for (kind, _), pairs in given.items() if kind == "iban" for _, new in pairs)


@pytest.mark.parametrize(("kind", "entity"), [("iban", "DE89370400440532013000"), ("ssn", "123456789"), ("ipv6", "fe80::1")])
def test_surrogates_are_of_their_kind(kind, entity):
    patterns = pii._compiled()
    for attempt in range(pii.WIDEST + 5):
        new = pii.surrogate(kind, entity, b"key", attempt)
        shown = pii.render(kind, "123-45-6789" if kind == "ssn" else entity, new)
        assert pii.normal(kind, shown) == new
        assert pii.entities(shown, patterns) == [(0, len(shown), kind, new)]


def test_long_text_with_many_names():
    """Work grows with the text: 20,000 mentions of 2,000 persons, each told apart."""
    import itertools

    family = ["".join(x).capitalize() for x in itertools.islice(itertools.product("bdfgk", "aeiou", "lmnrs", "aeiou", "bdfgk"), 2000)]
    text = " . ".join(f"John {f} . " + f"{f} . " * 9 for f in family)
    found = pii.entities(text, pii._compiled())
    assert len(found) == 20_000 and len({f[3] for f in found}) == 2000
