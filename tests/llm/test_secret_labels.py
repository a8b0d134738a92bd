"""Recall and precision of the spans that the models of characters add, on planted strings labelled by how they were made."""

from __future__ import annotations

import random
import string

from sievework.llm import secrets
from tests.llm.test_operators import frame, small_documents


def test_recall_and_precision(spark, sf_dir):
    r = random.Random(11)
    prose = [t for _, t in small_documents(sf_dir) if t][:300]
    ordinary = [a + b + c for a in ("get", "set", "update", "find") for b in ("Account", "Customer", "Document", "Partition") for c in ("Identifier", "Description", "ByNumber", "FromRequest")]
    docs, planted, plain = [], {}, {}
    for k, text in enumerate(prose):
        words = text.split(" ")
        at = r.randrange(len(words) + 1)
        if k % 2:
            word = planted[k] = "".join(r.choice(string.ascii_letters + string.digits) for _ in range(r.randint(28, 44)))
        else:
            word = plain[k] = ordinary[k // 2 % len(ordinary)]
        docs.append((k, " ".join([*words[:at], word, *words[at:]])))
    by_id = dict(docs)
    caught, hit = set(), set()
    for row in secrets.scan(frame(spark, docs)).select("doc_id", "markov").collect():
        for s in row.markov:
            said = by_id[row.doc_id][s.start : s.end]
            if row.doc_id in planted and said in planted[row.doc_id]:
                caught.add(row.doc_id)
            if row.doc_id in plain and said in plain[row.doc_id]:
                hit.add(row.doc_id)
    print("recall", len(caught) / len(planted), "ordinary flagged", len(hit) / len(plain))
    assert len(caught) >= 0.9 * len(planted)
    assert len(hit) <= 0.02 * len(plain)
