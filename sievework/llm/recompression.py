"""Substring dedup of words by recompression.

Each round names maximal runs of one symbol, then pairs of a left and a right symbol (a symbol's side is a bit of
its name).  Names are fingerprints of what they stand for, so that every task gives the same run or pair the same
name without asking, and equal passages get equal symbols inside.  Near a passage's ends symbols depend on what
stands outside it; a symbol is interior to a window if the words that it depends on lie in the window.  A window's
anchor is its leftmost interior symbol of the highest round that has one.  Equal windows have equal anchors; anchors
that documents share reveal repeats (see repeats).  They are verified in the bucket of their anchor, where words and
pairs of symbols get exact names in rounds: whole numbers that stand for one word, or one pair, and no other.  Two
windows are equal if and only if the names of their first and last 32 words are.

Defined cases: a null text has no words; a null id neither loses words nor makes others lose any; rows with one id
never count as earlier than each other; equal rows give equal results; texts below 50 words are kept whole; a very
long text is worked on in parts; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from sievework.llm import hashing as H
from sievework.llm.repeats import keyed, least_of, removed, repeat_intervals, starts_of
from sievework.llm.shared import split_by

LENGTH, ROUNDS = 50, 7
_RUN, _PAIR, _ROUND = H.U64(0xD6E8FEB86659FD93), H.U64(0xA0761D6478BD642F), H.U64(0xE7037ED1A0B428DB)


class Symbols:
    """Symbols of one round: name, text, words from start to end, and the words from low to high that they depend on.
    A symbol that depends on where its text begins or ends has low or high outside of the text."""

    def __init__(self, name: np.ndarray, owner: np.ndarray, start: np.ndarray, end: np.ndarray, low: np.ndarray, high: np.ndarray) -> None:
        self.name, self.owner, self.start, self.end, self.low, self.high = name, owner, start, end, low, high

    def runs(self, words: np.ndarray, bounds: np.ndarray) -> "Symbols":
        """Maximal runs of one symbol, named by the symbol and their length."""
        n = len(self.name)
        new = np.ones(n, dtype=bool)
        new[1:] = (self.name[1:] != self.name[:-1]) | (self.owner[1:] != self.owner[:-1])
        first = np.flatnonzero(new)
        last = np.concatenate([first[1:], [n]]) - 1
        size = (last - first + 1).astype(np.uint64)
        name = np.where(size == 1, self.name[first], H.mix(self.name[first] * _RUN + size))
        owner, start, end = self.owner[first], self.start[first], self.end[last]
        low, high = self.low[first].copy(), self.high[last].copy()
        # the neighbours must be known to be other symbols: the word next to the run tells, unless it fits
        begin, stop = bounds[owner], bounds[owner + 1]
        left, right = start > begin, end < stop
        fits = left.copy()
        fits[left] = words[start[left] - 1] == words[end[left] - 1]
        low = np.where(~left, begin - 1, np.minimum(low, np.where(fits, self.low[np.maximum(first - 1, 0)], start - 1)))
        fits = right.copy()
        fits[right] = words[end[right]] == words[start[right]]
        high = np.where(~right, stop + 1, np.maximum(high, np.where(fits, self.high[np.minimum(last + 1, n - 1)], end + 1)))
        return Symbols(name, owner, start, end, low, high)

    def pairs(self, number: int, bounds: np.ndarray) -> "Symbols":
        """Pairs of a left symbol and the right one after it, named by both."""
        n = len(self.name)
        is_left = (H.mix(self.name ^ (H.mix(np.array([number], dtype=np.uint64) * _ROUND))) & H.U64(1)) == 1
        follows = np.zeros(n, dtype=bool)  # the next symbol is in the same text
        follows[:-1] = self.owner[1:] == self.owner[:-1]
        paired = np.zeros(n, dtype=bool)
        paired[:-1] = is_left[:-1] & ~is_left[1:] & follows[:-1]
        second = np.zeros(n, dtype=bool)
        second[1:] = paired[:-1]
        name, end, low, high = self.name.copy(), self.end.copy(), self.low.copy(), self.high.copy()
        at = np.flatnonzero(paired)
        name[at] = H.mix(self.name[at] * _PAIR + H.mix(self.name[at + 1] + _ROUND))
        end[at], high[at] = self.end[at + 1], self.high[at + 1]
        # a symbol that stays alone depends on the one that it could have been paired with
        alone = np.flatnonzero(is_left & ~paired)
        after = np.minimum(alone + 1, n - 1)
        high[alone] = np.maximum(high[alone], np.where(follows[alone], self.high[after], bounds[self.owner[alone] + 1] + 1))
        alone = np.flatnonzero(~is_left & ~second)
        before = np.maximum(alone - 1, 0)
        inside = np.where(alone > 0, follows[before], False)
        low[alone] = np.minimum(low[alone], np.where(inside, self.low[before], bounds[self.owner[alone]] - 1))
        keep = ~second
        return Symbols(name[keep], self.owner[keep], self.start[keep], end[keep], low[keep], high[keep])


class Words:
    length = LENGTH

    def canonical(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Each word with a space after it."""
        texts = [b" ".join([*t.encode().split(), b""]) for t in column.to_pylist()]
        return np.frombuffer(b"".join(texts), dtype=np.uint8), np.cumsum([0, *map(len, texts)])

    def units(self, data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.concatenate([[0], np.flatnonzero(data == 32) + 1])
        return at, np.searchsorted(at, bounds)

    def anchors(self, data: np.ndarray, at: np.ndarray, bounds: np.ndarray, windows: np.ndarray) -> np.ndarray:
        words, place = H.word_prints(data, at[:-1], at[1:]), np.arange(len(at) - 1)
        levels = [Symbols(words, H.row_of(bounds), place, place + 1, place, place + 1)]
        for number in range(1, ROUNDS + 1 if len(windows) else 1):
            levels.append(levels[-1].runs(words, bounds).pairs(number, bounds))
        names, open_ = np.zeros(len(windows), dtype=H.U64), np.arange(len(windows))
        for number in range(len(levels) - 1, -1, -1):
            if not len(open_):
                break
            s, w = levels[number], windows[open_]
            k = np.minimum(np.searchsorted(s.low, w), len(s.low) - 1)  # the leftmost symbol that depends on nothing before the window
            fits = (s.low[k] >= w) & (s.high[k] <= w + LENGTH)
            names[open_[fits]] = H.mix(s.name[k[fits]] + H.mix(np.array([number], dtype=np.uint64) * _ROUND))
            open_ = open_[~fits]
        return names

    def later(self, data: np.ndarray, bounds: np.ndarray, owner: np.ndarray) -> np.ndarray:
        names, words = pd.factorize(np.array(data.tobytes().split(b" ")[:-1], dtype=object))
        at = np.searchsorted(np.concatenate([[0], np.flatnonzero(data == 32) + 1]), bounds)
        number, width = len(words), 1
        while 2 * width < LENGTH:  # names of twice as many words
            pair = names[:-width] * number + names[width:]
            order = np.argsort(pair)
            new = np.concatenate([[True], pair[order][1:] != pair[order][:-1]])
            names = np.empty_like(pair)
            names[order] = np.cumsum(new) - 1
            number, width = int(new.sum()), 2 * width
        windows = starts_of(at, LENGTH)
        owner = np.repeat(owner, np.diff(at) - LENGTH + 1)
        pair = names[windows] * number + names[windows + LENGTH - width]
        order = np.argsort(pair)
        least, _ = least_of(order, np.concatenate([[True], pair[order][1:] != pair[order][:-1]]), owner)
        return owner > least


def dedup_words(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep_text: bool = True) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 and, with keep_text, text: the kept words joined by one space."""
    own = keyed(docs, id_col, text_col)
    found = repeat_intervals(own, Words())
    touched, untouched = split_by(own, found, "mark")
    schema = "doc_id long, n_words long, n_removed long, kept_sha256 string" + ", text string" * keep_text

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = [batch.column(c).to_pylist() if c in batch.schema.names else [None] * batch.num_rows for c in ("starts", "ends")]
            rows: list[tuple] = []
            for text, starts, ends in zip(batch.column("text").to_pylist(), *lists, strict=True):
                words = text.encode().split()
                n, gone = len(words), removed(starts, ends, len(words), LENGTH)
                for a, b in reversed(gone):
                    del words[a:b]
                kept = b" ".join(words)
                rows.append((n, n - len(words), hashlib.sha256(kept).hexdigest(), *([kept.decode()] if keep_text else [])))
            if rows:
                out = [pa.array(c, type=t) for c, t in zip(zip(*rows, strict=True), [pa.int64(), pa.int64(), pa.string(), pa.string()], strict=False)]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *out], names=["doc_id", "n_words", "n_removed", "kept_sha256", *["text"] * keep_text])

    joined = touched.join(found, "mark", "left").select("doc_id", "text", "starts", "ends")
    return joined.mapInArrow(apply, schema).unionByName(untouched.select("doc_id", "text").mapInArrow(apply, schema))


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_words(spark.read.parquet(f"{sf_dir}/documents.parquet"), keep_text=False)
