"""Plain versions of the corpus operators, one document at a time, for tests."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import defaultdict
from itertools import combinations

import numpy as np

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def sha(data: bytes | str) -> str:
    return hashlib.sha256(data.encode() if isinstance(data, str) else data).hexdigest()


def roots(nodes, pairs) -> dict:
    """Of each node the smallest one that pairs connect it with."""
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def covered(units: dict, length: int) -> dict:
    """Of each (row, id, units) the units in windows that also start in a document with a smaller id."""
    least: dict = {}
    for (_, doc_id), u in units.items():
        if doc_id is not None:
            for i in range(len(u) - length + 1):
                w = u[i : i + length]
                least[w] = min(least.get(w, doc_id), doc_id)
    out = {}
    for (row, doc_id), u in units.items():
        gone = np.zeros(len(u), dtype=bool)
        if doc_id is not None:
            for i in range(len(u) - length + 1):
                if least[u[i : i + length]] < doc_id:
                    gone[i : i + length] = True
        out[row, doc_id] = gone
    return out


def numbered(docs) -> dict:
    return {(k, doc_id): text or "" for k, (doc_id, text) in enumerate(docs)}


def op1(docs) -> list[tuple]:
    data = {k: t.encode() for k, t in numbered(docs).items()}
    out = []
    for (k, doc_id), gone in covered(data, 50).items():
        kept = np.frombuffer(data[k, doc_id], dtype=np.uint8)[~gone].tobytes()
        spans = int((gone & ~np.concatenate([[False], gone[:-1]])).sum()) if len(gone) else 0
        out.append((doc_id, len(gone), int(gone.sum()), spans, sha(kept)))
    return out


def op1_texts(docs) -> dict:
    """Texts without the characters all of whose bytes are covered."""
    out = {}
    for (k, doc_id), gone in covered({k: t.encode() for k, t in numbered(docs).items()}, 50).items():
        text, at, kept = docs[k][1] or "", 0, []
        for c in text:
            n = len(c.encode())
            if not gone[at : at + n].all():
                kept.append(c)
            at += n
        out[doc_id] = "".join(kept)
    return out


def op2(docs) -> list[tuple]:
    out = []
    for doc_id, text in docs:
        data = (text or "").encode()
        padded = data + bytes(-len(data) % 64 if data else 64)
        out.append((doc_id, len(data), len(padded), sha(padded), zlib.crc32(padded[-64:])))
    return out


def shingle_sets(docs) -> list[set]:
    out = []
    for _, text in docs:
        words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        out.append({tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set())
    return out


def op3(docs) -> list[tuple]:
    sets = shingle_sets(docs)
    rows = defaultdict(list)
    for k, s in enumerate(sets):
        for g in s:
            rows[g].append(k)
    pairs = {p for ks in rows.values() for p in combinations(ks, 2)}
    linked = [(docs[a][0], docs[b][0]) for a, b in pairs if docs[a][0] is not None and docs[b][0] is not None and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    root = roots({d for d, _ in docs if d is not None}, linked)
    return [(d, len(s), root.get(d)) for (d, _), s in zip(docs, sets, strict=True)]


def op4(docs) -> list[tuple]:
    words = {k: tuple(WORD.findall(t)) for k, t in numbered(docs).items()}
    out = []
    for (k, doc_id), gone in covered(words, 50).items():
        kept = " ".join(w for w, g in zip(words[k, doc_id], gone, strict=True) if not g)
        out.append((doc_id, len(gone), int(gone.sum()), sha(kept)))
    return out


ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
# (?i) also equates a few letters beyond ASCII, which the second group must not have
VALUE = re.compile(r"[A-Za-z0-9+/_.=-]+")


def base_spans(text: str) -> list[tuple[int, int, int]]:
    out = []
    for m in ASSIGN.finditer(text):
        if len(m[2]) >= 12 and VALUE.fullmatch(m[2]):
            out.append((m.start(), 0, m.end()))
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 18]
    out += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 16]
    return sorted(out)


def op5(docs) -> list[tuple]:
    out = []
    for doc_id, text in docs:
        spans = base_spans(text or "")
        n = [sum(k == kind for _, k, _ in spans) for kind in range(3)]
        out.append((doc_id, *n, sha(",".join(f"{('assign', 'access', 'hex')[k]}:{a}:{b}" for a, k, b in spans))))
    return out


def op6(vectors, cosine: float = 0.9) -> list[tuple]:
    good, unit = [], []
    for vec_id, v in vectors:
        if v is not None and len(v) and None not in v and np.isfinite(v).all() and np.any(v):
            x = np.array(v, dtype=np.float64)
            x /= np.abs(x).max()  # so that no square is out of range
            good.append(vec_id)
            unit.append(x / np.linalg.norm(x))
    links, pairs = dict.fromkeys((v for v, _ in vectors), 0), []
    if good:
        x = np.array(unit)
        linked = x @ x.T >= cosine
        for a, b in zip(*np.nonzero(linked), strict=True):
            if a != b:
                links[good[a]] += 1
                pairs.append((good[a], good[b]))
    root = roots(links, pairs)
    return [(v, links[v], root[v], root[v] == v) for v, _ in vectors]


def op9(docs, path: str) -> list[tuple]:
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(path)
    model.no_padding()
    model.no_truncation()
    out = []
    for doc_id, text in docs:
        ids = model.encode(text or "", add_special_tokens=False).ids
        out.append((doc_id, len(ids), sha(",".join(map(str, ids))), sha(model.decode(ids, skip_special_tokens=False))))
    return out


def op10_pieces(docs, path: str, most: int = 4096) -> list[tuple]:
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(path)
    model.no_padding()
    model.no_truncation()
    out = []
    for doc_id, text in docs:
        ids = np.array([*model.encode(text or "", add_special_tokens=False).ids, 1], dtype="<u4")
        out += [(doc_id, k, at, len(ids[at : at + most]), zlib.crc32(ids[at : at + most].tobytes())) for k, at in enumerate(range(0, len(ids), most))]
    return out


def sound_packing(rows, most: int = 4096) -> int:
    """The number of sequences (rows of sequence_id, offset, length), each gapless from 0 and at most `most` long."""
    bins = defaultdict(list)
    for sequence, offset, length in rows:
        bins[sequence].append((offset, length))
    for pieces in bins.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= most
    return len(bins)


def op12(rows) -> list[tuple]:
    """conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256 of every node, by whole prefixes."""
    own: dict = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            own[conv].append((turn is not None, turn or 0, hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).digest(), role, text))
    own = {c: [t[3:] for t in sorted(turns, key=lambda t: t[:3])] for c, turns in own.items()}
    whole = {}
    for c, turns in own.items():
        base, h = c - (abs(c) % 5) * (1 if c > 0 else -1), zlib.crc32(str(c).encode()) % 9
        whole[c] = tuple(own.get(base, [])[:h] + turns[h:])
    members, ends, children = defaultdict(set), defaultdict(list), defaultdict(set)
    for c, turns in sorted(whole.items()):
        ends[turns].append(c)
        for d in range(len(turns) + 1):
            members[turns[:d]].add(c)
            if d:
                children[turns[: d - 1]].add(turns[:d])
    leaves, saved = defaultdict(int), defaultdict(int)
    for node in members:
        for d in range(len(node) + 1):
            leaves[node[:d]] += not children[node]
            saved[node[:d]] += (len(members[node]) - 1) * len(node[-1][1].encode()) if node else 0
    return [(min(m), len(n), min(members[n[:-1]]) if n else None, len(m), len(children[n]), leaves[n], saved[n], sha(",".join(map(str, ends[n])))) for n, m in members.items()]


def op11(rows) -> list[tuple]:
    """lang, source, part, item, value, rank, with a sum over all kept terms for every pair."""
    term = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
    counts: dict = defaultdict(lambda: defaultdict(lambda: defaultdict(int)))
    docs: dict = defaultdict(lambda: defaultdict(int))
    for lang, source, text in rows:
        lang, source = lang or "", source or ""
        found = term.findall((text or "").translate({k: k + 32 for k in range(65, 91)}))
        counts[lang][source]
        for t in found:
            counts[lang][source][t] += 1
        for t in set(found):
            docs[lang][t] += 1
    out = []
    for lang, groups in counts.items():
        kept = [t for t, n in docs[lang].items() if n >= 10]
        whole = {t: sum(g[t] for g in groups.values() if t in g) for t in kept}

        def p(group, kept=kept) -> dict:
            n = sum(group.get(t, 0) for t in kept)
            return {t: 1 + 10**9 * (group.get(t, 0) + 2) // (n + 2 * len(kept)) for t in kept}

        f = lambda x, y: (x - y) ** 2 // (x + y)
        q = p(whole)
        ps = {s: p(g) for s, g in groups.items()}
        for s, g in groups.items():
            pairs = [(-sum(f(ps[s][t], ps[o][t]) for t in kept), o.encode()) for o in groups if o != s]
            terms = [(-f(ps[s][t], q[t]), t.encode()) for t in kept if g.get(t, 0) > 0 and ps[s][t] > q[t]]
            out += [(lang, s, "pair", o.decode(), -v, k + 1) for k, (v, o) in enumerate(sorted(pairs))]
            out += [(lang, s, "term", t.decode(), -v, k + 1) for k, (v, t) in enumerate(sorted(terms)[:10])]
    return out
