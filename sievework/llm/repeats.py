"""Repeats of a fixed length across documents: found by anchors, settled by comparing what the texts hold.

A window is `length` consecutive units (bytes or words) of one document.  A kind of unit names an anchor for each
window, from the window alone, so that equal windows have equal anchors.  Consecutive windows of one anchor are a run.

1. Names of runs are dealt over buckets (see names); a bucket tells which names several documents have.
2. The bytes of a run with a shared name are a segment.  Segments are dealt over buckets by the run's name, so that
   equal windows meet.  Of equal segments a load sends one, with its least document.
3. Each bucket compares its windows by their bytes or words (Unit.later) and tells which start in a document with a
   smaller id too.
4. The answers return to the loads, and windows of a document are merged into intervals.

Names choose what is compared; no name decides.  A load is what a task gathers until it holds about LOAD_BYTES; rows
go from loads to buckets and back, so their number follows the tasks and not the documents.  A long text is worked on
in parts that overlap by a window.  Whole copies of a text are settled before step 1.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievework.llm.hashing import U64, byte_values, fingerprints, prefix
from sievework.llm.names import PACKED, Told, bucket_of, by_bucket, by_load, cuts, field, load_key, packed, ranges, told_names
from sievework.llm.shared import SLICE_BYTES, partitions, split_by, staged, text_bytes, without

#: Bytes of distinct segments in a load, and windows that a bucket compares at once.
LOAD_BYTES, WINDOWS = 12 << 20, 1 << 19
#: A name that no column of documents has.
MARK = "__sievework_mark"


class Unit(Protocol):
    length: int

    def canonical(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The bytes of all texts one after another, and the bounds of each."""

    def units(self, data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where each unit begins in data (and where the last ends), and the bounds of each text in units."""

    def anchors(self, data: np.ndarray, at: np.ndarray, bounds: np.ndarray, windows: np.ndarray) -> np.ndarray:
        """A 64-bit name for each window."""

    def later(self, data: np.ndarray, bounds: np.ndarray, owner: np.ndarray) -> np.ndarray:
        """Of each window of each segment, whether an equal one has a smaller owner."""


def starts_of(bounds: np.ndarray, length: int) -> np.ndarray:
    """Starts of all windows: within one text each."""
    return ranges(bounds[:-1], np.maximum(np.diff(bounds) - length + 1, 0))


def least_of(order: np.ndarray, new: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each entry the least owner of its group, and whether the group has more than one; new marks where groups
    begin in the order."""
    first = np.flatnonzero(new)
    low, high = np.minimum.reduceat(owner[order], first), np.maximum.reduceat(owner[order], first)
    least, many = np.empty_like(owner), np.empty(len(owner), dtype=bool)
    group = np.cumsum(new) - 1
    least[order], many[order] = low[group], (low != high)[group]
    return least, many


class Part:
    """Texts (or a part of a long one) worked on at once: rows of the batch from `first` on, and the place of the
    first unit in its text."""

    def __init__(self, unit: Unit, first: int, data: np.ndarray, at: np.ndarray, bounds: np.ndarray, base: int) -> None:
        self.first, self.data, self.at, self.bounds, self.base = first, data, at, bounds, base
        windows = starts_of(bounds, unit.length)
        names = unit.anchors(data, at, bounds, windows)
        new = np.ones(len(windows), dtype=bool)
        new[1:] = (windows[1:] != windows[:-1] + 1) | (names[1:] != names[:-1])
        head = np.flatnonzero(new)
        self.start, self.names, self.size = windows[head], names[head], np.diff(np.append(head, len(windows)))
        self.owner = np.searchsorted(bounds, self.start, side="right") - 1


def parts(column: pa.Array, unit: Unit, most: int = SLICE_BYTES) -> Iterator[Part]:
    data, bounds = unit.canonical(column)
    first = 0
    while first < len(column):
        last = max(first + 1, int(np.searchsorted(bounds, bounds[first] + most, side="right")) - 1)
        own, limits = data[bounds[first] : bounds[last]], bounds[first : last + 1] - bounds[first]
        at, in_units = unit.units(own, limits)
        n = len(at) - 1
        cut = np.unique(np.append(np.searchsorted(at, np.arange(0, len(own), most)), n)) if last == first + 1 and len(own) > 2 * most else np.array([0, n])
        for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
            end = min(n, b + unit.length - 1)
            inside = in_units if len(cut) == 2 else np.array([0, end - a])
            yield Part(unit, first, own[at[a] : at[end]], at[a : end + 1] - at[a], inside, a)
        first = last


def shared_runs(docs: DataFrame, unit: Unit, buckets: int) -> DataFrame:
    """mark and bits: of the documents that share anchors, which of their runs have a shared name."""

    def names_of(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        for part in parts(batch.column("text"), unit):
            counts = np.bincount(part.owner, minlength=len(part.bounds) - 1)
            yield part.first, part.names, counts, counts

    def finish(told: Told) -> pa.RecordBatch:
        shared, ends = told.times > 1, np.cumsum(told.counts)
        before = np.concatenate([[0], np.cumsum(shared)])
        some = np.flatnonzero(before[ends] > before[ends - told.counts]).tolist()
        bits = [np.packbits(shared[ends[k] - told.counts[k] : ends[k]]).tobytes() for k in some]
        return pa.RecordBatch.from_arrays([pa.array([told.marks[k] for k in some], type=pa.binary()), pa.array(bits, type=pa.binary())], names=["mark", "bits"])

    return told_names(docs, names_of, buckets, finish, "mark binary, bits binary")


def classes(prints: np.ndarray, data: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The class of each stretch of data and the first stretch of each class; stretches of a class are equal byte by byte."""
    order = np.lexsort((size, prints))
    new = np.ones(len(order), dtype=bool)
    new[1:] = (prints[order[1:]] != prints[order[:-1]]) | (size[order[1:]] != size[order[:-1]])
    rep = np.empty_like(order)
    rep[order] = order[np.flatnonzero(new)][np.cumsum(new) - 1]
    other = np.flatnonzero(rep != np.arange(len(rep)))
    step = 0
    while step < len(other):  # about 2 MB at once
        some = other[step : step + max(1, int(np.searchsorted(np.cumsum(size[other[step : step + (1 << 16)]]), 2 << 20)))]
        step += len(some)
        differ = data[ranges(start[some], size[some])] != data[ranges(start[rep[some]], size[some])]
        wrong = some[np.logical_or.reduceat(differ, np.cumsum(size[some]) - size[some])]
        rep[wrong] = wrong  # equal names of different stretches: each stands for itself
    first, of = np.unique(rep, return_inverse=True)
    return of, first


class _Segments:
    """A task's load: texts, distinct segments and where each segment stands."""

    def __init__(self, number: int) -> None:
        self.number, self.bytes = number, 0
        self.marks: list[bytes] = []
        self.ids: list[int] = []
        self.kept: list[tuple] = []  # of distinct segments of a part: bytes, print, name, size, windows
        self.all: list[tuple] = []  # of all segments: number among the distinct, text, place
        self.distinct = 0

    def add(self, part: Part, shared: np.ndarray, length: int, marks: list[bytes], ids: np.ndarray) -> None:
        if not shared.any():
            return
        start, windows = part.start[shared], part.size[shared]
        a, size = part.at[start], part.at[start + windows + length - 1] - part.at[start]
        prints = fingerprints(prefix(byte_values()[part.data]), a, a + size)
        of, first = classes(prints, part.data, a, size)
        self.kept.append((part.data[ranges(a[first], size[first])], prints[first], part.names[shared][first], size[first], windows[first]))
        self.all.append((self.distinct + of, len(self.marks) + part.owner[shared], part.base + start - part.bounds[part.owner[shared]]))
        self.marks += marks
        self.ids += ids.tolist()
        self.distinct += len(first)
        self.bytes += len(self.kept[-1][0])

    def rows(self, buckets: int) -> Iterator[pa.RecordBatch]:
        data, prints, names, size, windows = map(np.concatenate, zip(*self.kept, strict=True))
        number, text, place = map(np.concatenate, zip(*self.all, strict=True))
        start = np.cumsum(size) - size
        of, first = classes(prints, data, start, size)
        bucket = bucket_of(names[first], buckets)
        sort = np.argsort(bucket, kind="stable")
        rank = np.empty(len(sort), dtype=np.int64)
        rank[sort] = np.arange(len(sort))
        first, bucket, kind = first[sort], bucket[sort], rank[of[number]]
        ids = np.array(self.ids)[text]
        least = np.full(len(first), np.iinfo(np.int64).max)
        np.minimum.at(least, kind, ids)
        key, sizes = load_key(self.number, self.marks), []
        for b, at, end in cuts(bucket):
            own = first[at:end]
            sizes.append((b, int(windows[own].sum())))
            yield packed(key, b, [data[ranges(start[own], size[own])], size[own].astype(np.uint32), windows[own].astype(np.uint32), least[at:end], (names[own] & U64(255)).astype(np.uint8)])
        yield packed(key, key % buckets, [text.astype(np.uint32), place, kind.astype(np.uint32), ids == least[kind], windows[first].astype(np.uint32), np.array(sizes, dtype=np.int64)], self.marks)


def repeated_windows(docs: DataFrame, unit: Unit, buckets: int) -> DataFrame:
    """mark, starts, ends: intervals in units covered by windows that start in a document with a smaller id too.
    docs has doc_id, mark, text and bits.  A document may have several rows; their intervals may touch."""

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        load = _Segments(0)
        for batch in batches:
            marks, ids = batch.column("mark").to_pylist(), batch.column("doc_id").to_numpy()
            bits = [np.unpackbits(np.frombuffer(b, dtype=np.uint8)).astype(bool) for b in batch.column("bits").to_pylist()]
            read = 0  # runs of a long text that went before
            for part in parts(batch.column("text"), unit):
                n = len(part.bounds) - 1
                counts = np.bincount(part.owner, minlength=n)
                read = read if part.base else 0
                shared = np.concatenate([bits[part.first + k][read : read + c] for k, c in enumerate(counts.tolist())])
                read += int(counts[0])
                rows = slice(part.first, part.first + n)
                load.add(part, shared, unit.length, marks[rows], ids[rows])
                if load.bytes > LOAD_BYTES:
                    yield from load.rows(buckets)
                    load = _Segments(load.number + 1)
        if load.bytes:
            yield from load.rows(buckets)

    def answer(rows: list[dict]) -> list[np.ndarray]:
        data = np.concatenate([field(r, "a", np.uint8) for r in rows])
        size, windows = (np.concatenate([field(r, f, np.uint32) for r in rows]).astype(np.int64) for f in "bc")
        ids, name = (np.concatenate([field(r, f, t) for r in rows]) for f, t in (("d", np.int64), ("e", np.uint8)))
        start, place = np.cumsum(size) - size, np.cumsum(windows) - windows
        later = np.zeros(int(windows.sum()), dtype=bool)
        # runs of one name are compared together, and of several names as many as WINDOWS allows
        group = (np.cumsum(np.bincount(name, weights=windows, minlength=256)) // WINDOWS).astype(np.int64)[name]
        for g in np.unique(group):
            some = np.flatnonzero(group == g)
            bounds = np.concatenate([[0], np.cumsum(size[some])])
            later[ranges(place[some], windows[some])] = unit.later(data[ranges(start[some], size[some])], bounds, ids[some])
        ends = np.cumsum([int(field(r, "c", np.uint32).sum(dtype=np.int64)) for r in rows])
        return [np.packbits(x) for x in np.split(later, ends[:-1])]

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return by_bucket(batches, answer)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row, answers in by_load(batches, "f"):
            text, place, kind, windows = (field(row, f, t).astype(np.int64) for f, t in (("a", np.uint32), ("b", np.int64), ("c", np.uint32), ("e", np.uint32)))
            flags = np.concatenate([np.unpackbits(np.frombuffer(a, dtype=np.uint8))[:n] for n, a in answers]).astype(bool)
            size, first = windows[kind], np.cumsum(windows) - windows
            # of a class's least document the windows that the bucket told, of others all
            step = ranges(np.zeros(len(size), dtype=np.int64), size)
            gone = ~np.repeat(field(row, "d", bool), size) | flags[np.repeat(first[kind], size) + step]
            keys = np.repeat((text << 40) + place, size) + step
            yield _intervals(np.unique(keys[gone]), row["marks"], unit.length)

    dealt = docs.mapInArrow(deal, PACKED).repartitionById(buckets, "bucket")
    return dealt.mapInArrow(settle, PACKED).repartition(buckets, "key").mapInArrow(merge, "mark binary, starts array<long>, ends array<long>")


def _intervals(keys: np.ndarray, marks: list[bytes], length: int) -> pa.RecordBatch:
    """Merged intervals of the windows whose text << 40 | place is in keys (in order)."""
    text, place = keys >> 40, keys & ((1 << 40) - 1)
    new = np.ones(len(keys), dtype=bool)
    new[1:] = (text[1:] != text[:-1]) | (place[1:] > place[:-1] + length)
    head = np.flatnonzero(new)
    last = np.append(head[1:], len(keys))[: len(head)] - 1
    own, first = np.unique(text[head], return_index=True)
    limits = pa.array(np.append(first, len(head)), type=pa.int32())
    lists = [pa.ListArray.from_arrays(limits, pa.array(x)) for x in (place[head], place[last] + length)]
    return pa.RecordBatch.from_arrays([pa.array([marks[k] for k in own.tolist()], type=pa.binary()), *lists], names=["mark", "starts", "ends"])


def keyed(docs: DataFrame, id_col: str, text_col: str, *more: str) -> DataFrame:
    """doc_id, text (null: empty), mark and further columns.  mark is a digest of id and text: rows equal in both are treated alike."""
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"), *more)  # a column of `more` may have any name but these
    return own.withColumn("mark", mark_of("doc_id", "text"))


def mark_of(doc_id: str | Column, text: str | Column) -> Column:
    """SHA-256 of an id (null or a long) and a text, as 32 bytes."""
    return F.unhex(F.sha2(F.concat(F.coalesce(F.col(doc_id).cast("string") if isinstance(doc_id, str) else doc_id.cast("string"), F.lit("")), F.lit("\n"), text), 256))


def repeat_intervals(docs: DataFrame, unit: Unit) -> DataFrame:
    """mark, starts, ends (staged) of the documents (from keyed) that have units in a window which also starts in a
    document with a smaller id; intervals may overlap."""
    buckets = partitions(docs.sparkSession)
    known = docs.filter("doc_id is not null").select("doc_id", "mark", "text")
    # whole copies: all but those of the smallest id are settled here
    prints = known.select("doc_id", "mark", F.unhex(F.sha2("text", 256)).alias("print"))
    first = staged(prints.groupBy("print").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).filter("first < last"), "firsts")
    copies = staged(prints.join(first, "print").filter("doc_id > first").select("mark"), "copies")
    firsts = without(known, copies, "mark")
    told = staged(shared_runs(firsts, unit, buckets).dropDuplicates(["mark"]), "told")
    touched, _ = split_by(firsts, told, "mark")
    # in the order of marks, so that a task that runs again deals the same loads
    marked = touched.join(told, "mark").select("doc_id", "mark", "text", "bits").sortWithinPartitions("mark")
    found = staged(repeated_windows(marked, unit, buckets), "found")
    whole = copies.select("mark", F.array(F.lit(0).cast("long")).alias("starts"), F.array(F.lit(1 << 40)).alias("ends"))
    joined = found.unionByName(whole).groupBy("mark")
    return staged(joined.agg(F.collect_set(F.struct("starts", "ends")).alias("p")).select("mark", F.flatten("p.starts").alias("starts"), F.flatten("p.ends").alias("ends")), "intervals")


def removed(starts: list[int] | None, ends: list[int] | None, size: int, length: int) -> list[tuple[int, int]]:
    """Maximal removed runs of a text of `size` units; a text without a window loses nothing."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(zip(starts or [], ends or [], strict=True)) if size >= length else []:
        b = min(b, size)
        if out and a <= out[-1][1]:
            out[-1] = out[-1][0], max(b, out[-1][1])
        else:
            out.append((a, b))
    return out
