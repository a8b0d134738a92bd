"""A part of a name finds its whole name however many other names of that part stand between."""

from __future__ import annotations

import pytest

from sievework.llm import pii


@pytest.mark.parametrize("between", [3, 8, 40])
def test_part_reaches_past_other_names(between):
    others = "John Smith wrote. " * between
    for text in (f"Mary Smith came. {others}Then Mrs Smith left.", f"Then Mrs Smith left. {others}Mary Smith came."):
        spans = pii.entities(text, pii._compiled())
        found = next(e for start, end, _, e in spans if text[start:end] == "Smith")
        assert found == "f:mary smith"


def test_nearest_before_wins_else_first_after():
    text = "Anna Smith, Mary Smith. Mrs Smith. Julia Smith."
    assert [e for start, end, _, e in pii.entities(text, pii._compiled()) if text[start:end] == "Smith"] == ["f:mary smith"]
    text = "Mrs Smith. Julia Smith, Anna Smith."
    assert [e for start, end, _, e in pii.entities(text, pii._compiled()) if text[start:end] == "Smith"] == ["f:julia smith"]
