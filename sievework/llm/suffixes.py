"""Suffix-array dedup of bytes: blockwise construction with a difference cover.

Suffixes are compared to a depth of 50 bytes, which is all that removal needs.  Suffixes that cannot have an equal go
first: a suffix belongs to the least named of the blocks of BLOCK bytes in its first 50, and only those whose block
occurs in several documents stay.  They are dealt over buckets by that block, and one bucket is sorted at a time.

Within a bucket the sample holds the suffixes at places p with p mod 13 in a perfect difference set: any two places i
and j have a shift below 13 that takes both into the sample.  The sample is ranked first, by the 38 bytes from p on.
Then the bucket's suffixes are sorted by their ends, the bytes 0-12 and 37-49; what is tied is settled by the ranks at
the shift of the pair, which hold the bytes between.  Every comparison is of the bytes themselves, and no suffix is
read further than its ends, however long the ties are.

Defined cases: a null text is empty; a null id neither loses bytes nor makes others lose any; rows with one id never
count as earlier than each other; equal rows give equal results; texts below 50 bytes are kept whole; a very long text
is worked on in parts; an empty table gives no rows; other columns are ignored, but for those carried.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from sievework.llm import hashing as H
from sievework.llm.names import ranges
from sievework.llm.repeats import keyed, least_of, removed, repeat_intervals
from sievework.llm.shared import split_by, text_bytes

LENGTH, BLOCK = 50, 32
# A perfect difference set, in which every remainder but 0 is the difference of exactly one pair.
PERIOD, COVER = 13, [0, 1, 3, 9]
DEPTH = LENGTH - PERIOD + 1


def changes(order: np.ndarray, *keys: np.ndarray) -> np.ndarray:
    """Where in the order any key differs from the one before."""
    new = np.zeros(len(order), dtype=bool)
    new[:1] = True
    for key in keys:
        new[1:] |= key[order[1:]] != key[order[:-1]]
    return new


class Bytes:
    length = LENGTH

    def canonical(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        return text_bytes(column)

    def units(self, data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return np.arange(len(data) + 1), bounds

    def anchors(self, data: np.ndarray, at: np.ndarray, bounds: np.ndarray, windows: np.ndarray) -> np.ndarray:
        """The least name of the blocks of each window."""
        if len(data) < LENGTH:
            return np.zeros(0, dtype=H.U64)
        least = H.fingerprints(H.prefix(H.byte_values()[data]), np.arange(len(data) - BLOCK + 1), BLOCK)
        span, width = LENGTH - BLOCK + 1, 1
        while width < span:
            step = min(width, span - width)
            least = np.minimum(least[:-step], least[step:])
            width += step
        return H.mix(least[windows])

    def later(self, data: np.ndarray, bounds: np.ndarray, owner: np.ndarray) -> np.ndarray:
        words = np.ndarray(max(0, len(data) - 7), dtype=">u8", buffer=np.ascontiguousarray(data), strides=(1,))

        def read(places: np.ndarray) -> np.ndarray:
            return words[places].astype(H.U64)

        windows = ranges(bounds[:-1], np.diff(bounds) - LENGTH + 1)
        owner = np.repeat(owner, np.diff(bounds) - LENGTH + 1)
        # the suffixes by their ends
        ends = [read(windows + k) for k in (42, 37, 5, 0)]
        order = np.lexsort(ends)
        new = changes(order, *ends)
        _, many = least_of(order, new, owner)
        tie = np.empty(len(order), dtype=np.int64)
        tie[order] = np.cumsum(new)
        open_ = np.flatnonzero(many)
        later = np.zeros(len(windows), dtype=bool)
        if not len(open_):
            return later
        tie, windows, own = tie[open_], windows[open_], owner[open_]
        rank = self._ranks(read, bounds)
        # the places of each tied suffix in the sample: two of a tie are equal if and only if they share a shift and a rank
        shifts = np.array([[(c - r) % PERIOD for c in COVER] for r in range(PERIOD)])[windows % PERIOD].T
        keys = (((tie * PERIOD + shifts).astype(H.U64) << H.U64(32)) | rank[windows + shifts]).reshape(-1)
        order = np.argsort(keys)
        low, _ = least_of(order, changes(order, keys), np.tile(own, len(COVER)))
        later[open_] = own > low.reshape(len(COVER), -1).min(axis=0)
        return later

    @staticmethod
    def _ranks(read: Callable[[np.ndarray], np.ndarray], bounds: np.ndarray) -> np.ndarray:
        """The rank of each sampled suffix by its first DEPTH bytes, by place."""
        rank = np.zeros(int(bounds[-1]), dtype=np.uint32)
        inside = ranges(bounds[:-1], np.diff(bounds) - DEPTH + 1)
        sample = inside[np.isin(np.arange(PERIOD), COVER)[inside % PERIOD]]
        keys = [read(sample + k) for k in (30, 24, 16, 8, 0)]
        order = np.lexsort(keys)
        rank[sample[order]] = np.cumsum(changes(order, *keys))
        return rank


def dedup_bytes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep_text: bool = True, carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and, with keep_text, text: the characters of which a byte is kept;
    also the columns named in carry as they are."""
    own = keyed(docs, id_col, text_col, *carry)
    found = repeat_intervals(own, Bytes())
    touched, untouched = split_by(own, found, "mark")
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", text string" * keep_text + "".join(f", `{c}` {t}" for c, t in docs.dtypes if c in carry)
    ordered = [c for c in docs.columns if c in carry]

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = [batch.column(c).to_pylist() if c in batch.schema.names else [None] * batch.num_rows for c in ("starts", "ends")]
            rows: list[tuple] = []
            for text, starts, ends in zip(batch.column("text").to_pylist(), *lists, strict=True):
                data = text.encode()
                gone = removed(starts, ends, len(data), LENGTH)
                digest, at = hashlib.sha256(), 0
                for a, b in [*gone, (len(data), len(data))]:
                    digest.update(memoryview(data)[at:a])
                    at = b
                rows.append((len(data), sum(b - a for a, b in gone), len(gone), digest.hexdigest(), *([_characters(data, gone) if gone else text] if keep_text else [])))
            kinds = [pa.int64()] * 3 + [pa.string()] * 2
            out = [pa.array(c, type=t) for c, t in zip(zip(*rows, strict=True), kinds, strict=False)]
            if rows:
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *out, *[batch.column(c) for c in ordered]], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", *["text"] * keep_text, *ordered])

    joined = touched.join(found, "mark", "left").select("doc_id", "text", "starts", "ends", *carry)
    return joined.mapInArrow(apply, schema).unionByName(untouched.select("doc_id", "text", *carry).mapInArrow(apply, schema))


def _characters(data: bytes, gone: list[tuple[int, int]]) -> str:
    """The text without the characters all of whose bytes are gone."""
    kept, at = [], 0
    for a, b in gone:
        while a < b and data[a] & 0xC0 == 0x80:
            a += 1
        while b > a and b < len(data) and data[b] & 0xC0 == 0x80:
            b -= 1
        kept.append(data[at:a])
        at = max(a, b)
    return b"".join([*kept, data[at:]]).decode()


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_bytes(spark.read.parquet(f"{sf_dir}/documents.parquet"), keep_text=False)
