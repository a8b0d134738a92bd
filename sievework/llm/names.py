"""Questions of tasks to buckets and the answers: which names do texts share, and how often.

A task gathers the names of its texts to a load, deals the distinct ones over buckets, and each bucket answers the
load.  Loads and answers are packed rows (arrays of many entries as one binary), so that their number follows tasks
times buckets, as the blocks of a shuffle do, and not documents.  The load itself travels as a local row to the
task that puts the answers together.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from sievework.llm.hashing import U64

#: Names that a task gathers before it deals them.
LOAD_NAMES = 3 << 18
FIELDS = "abcdef"
PACKED = "key long, bucket int, local boolean, marks array<binary>, " + ", ".join(f"{f} binary" for f in FIELDS)
_PACKED = pa.schema([("key", pa.int64()), ("bucket", pa.int32()), ("local", pa.bool_()), ("marks", pa.list_(pa.binary())), *((f, pa.binary()) for f in FIELDS)])


def packed(key: int, bucket: int, fields: list[np.ndarray], marks: list[bytes] | None = None) -> pa.RecordBatch:
    """One row; it is local if it has marks."""
    data = [pa.array([f.tobytes()], type=pa.binary()) for f in fields] + [pa.nulls(1, pa.binary())] * (len(FIELDS) - len(fields))
    return pa.RecordBatch.from_arrays([pa.array([key]), pa.array([bucket], type=pa.int32()), pa.array([marks is not None]), pa.array([marks], type=pa.list_(pa.binary())), *data], schema=_PACKED)


def field(row: dict, name: str, kind: type) -> np.ndarray:
    return np.frombuffer(row[name], dtype=kind)


def by_bucket(batches: Iterator[pa.RecordBatch], answer: Callable[[list[dict]], list[np.ndarray]]) -> Iterator[pa.RecordBatch]:
    """Pass local rows on, and answer each row of a bucket when all of them are there."""
    held: dict[int, list[dict]] = {}
    for batch in batches:
        for k in range(batch.num_rows):
            row = batch.slice(k, 1)
            if row.column("local")[0].as_py():
                yield row.cast(_PACKED)
            else:
                held.setdefault(row.column("bucket")[0].as_py(), []).append(row.to_pylist()[0])
    for bucket in list(held):
        rows = held.pop(bucket)
        for row, told in zip(rows, answer(rows), strict=True):
            yield packed(row["key"], bucket, [told])


def by_load(batches: Iterator[pa.RecordBatch], sizes: str) -> Iterator[tuple[dict, list[tuple[int, bytes]]]]:
    """Each load's local row with the size and the bytes of the answers in the order of buckets.  The field `sizes` of the local row
    has pairs of bucket and size."""
    local: dict[int, dict] = {}
    told: dict[int, dict[int, bytes]] = {}
    for batch in batches:
        for row in batch.to_pylist():
            if row["local"]:
                local[row["key"]] = row
            else:
                told.setdefault(row["key"], {})[row["bucket"]] = row["a"]
    if told.keys() - local.keys():
        raise RuntimeError("answers without their load: a task that ran again dealt its texts in another way")
    for key in list(local):
        row, answers = local.pop(key), told.pop(key, {})
        pairs = field(row, sizes, np.int64).reshape(-1, 2).tolist()
        if len(pairs) != len(answers):
            raise RuntimeError("a load without all its answers: a task that ran again dealt its texts in another way")
        yield row, [(n, answers[b]) for b, n in pairs]


def load_key(number: int, marks: list[bytes]) -> int:
    """The key of a task's load: task, number, and a sum of its marks, so that another load never has it."""
    return (TaskContext.get().partitionId() & 0xFFFFFF) << 39 | (number & 0x7FFF) << 24 | zlib.crc32(b"".join(marks)) & 0xFFFFFF


def bucket_of(names: np.ndarray, buckets: int) -> np.ndarray:
    return ((names >> U64(40)) % U64(buckets)).astype(np.int64)


def ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """start, start + 1, ... of each range, one after another."""
    return np.repeat(starts - (np.cumsum(sizes) - sizes), sizes) + np.arange(int(sizes.sum()))


def cuts(sorted_buckets: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """bucket, start and end of each bucket in sorted buckets."""
    if len(sorted_buckets):
        head = np.flatnonzero(np.concatenate([[True], sorted_buckets[1:] != sorted_buckets[:-1]]))
        yield from zip(sorted_buckets[head].tolist(), head.tolist(), [*head[1:].tolist(), len(sorted_buckets)], strict=True)


class Told:
    """A load with its answers: marks and ids of texts, entries of each text, and by entry its name and how many texts have
    it (each load counts up to 255, the sum goes up to 255; 1 is certain)."""

    def __init__(self, row: dict, answers: list[tuple[int, bytes]]) -> None:
        self.marks, self.counts, self.ids = row["marks"], field(row, "a", np.uint32).astype(np.int64), field(row, "e", np.int64)
        self.totals, rank = field(row, "f", np.int64), field(row, "b", np.uint32)
        times = np.frombuffer(b"".join(a for _, a in answers), dtype=np.uint8)
        self.times = times[rank]
        self.names = field(row, "d", U64)[rank] if row["d"] else None


def told_names(docs: DataFrame, names_of: Callable[[pa.RecordBatch], Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]], buckets: int, finish: Callable[[Told], pa.RecordBatch], schema: str, keep_names: bool = False) -> DataFrame:
    """finish() of every load of docs (doc_id, mark, text).  names_of yields, of a part of a
    batch at a time, its first row, the names, text by text, the number of them in each row, and another
    number for each row, which Told has as totals."""

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, held = 0, []

        def load() -> Iterator[pa.RecordBatch]:
            names, counts, totals = (np.concatenate([h[k] for h in held]) for k in (0, 1, 4))
            of_text = np.concatenate([h[2] for h in held])
            ids = np.repeat(of_text, counts)
            marks = [m for h in held for m in h[3]]
            order = np.argsort(names)
            head = np.flatnonzero(np.append(True, names[order][1:] != names[order][:-1])[: len(names)])
            owner = ids[order]
            times = np.where(np.minimum.reduceat(owner, head) == np.maximum.reduceat(owner, head), 1, np.diff(np.append(head, len(names))))
            distinct = names[order][head]
            bucket = bucket_of(distinct, buckets)
            sort = np.argsort(bucket, kind="stable")
            place = np.empty(len(sort), dtype=np.uint32)
            place[sort] = np.arange(len(sort))
            rank = np.empty(len(names), dtype=np.uint32)
            rank[order] = np.repeat(place, np.diff(np.append(head, len(names))))
            distinct, times, bucket = distinct[sort], np.minimum(times, 255).astype(np.uint8)[sort], bucket[sort]
            key, sizes = load_key(number, marks), []
            for b, at, end in cuts(bucket):
                sizes.append((b, end - at))
                yield packed(key, b, [distinct[at:end].astype(np.uint32), times[at:end]])
            yield packed(key, key % buckets, [counts.astype(np.uint32), rank, np.array(sizes, dtype=np.int64), distinct if keep_names else np.zeros(0), of_text, totals], marks)

        size = 0
        for batch in batches:
            before = -1
            for first, names, counts, totals in names_of(batch):
                if first == before:  # another part of the same text
                    held[-1] = np.concatenate([held[-1][0], names]), held[-1][1] + counts, *held[-1][2:4], held[-1][4] + totals
                else:
                    if size > LOAD_NAMES:
                        yield from load()
                        number, size = number + 1, 0
                        held.clear()
                    own = batch.slice(first, len(counts))
                    held.append((names, counts, own.column("doc_id").to_numpy(), own.column("mark").to_pylist(), totals))
                size, before = size + len(names), first
        if held:
            yield from load()

    def answer(rows: list[dict]) -> list[np.ndarray]:
        names, times = (np.concatenate([field(r, f, t) for r in rows]) for f, t in (("a", np.uint32), ("b", np.uint8)))
        order = np.argsort(names)
        head = np.flatnonzero(np.concatenate([[True], names[order][1:] != names[order][:-1]]))
        total = np.minimum(np.add.reduceat(times[order], head, dtype=np.int64), 255).astype(np.uint8)
        all_ = np.empty(len(names), dtype=np.uint8)
        all_[order] = np.repeat(total, np.diff(np.append(head, len(names))))
        return np.split(all_, np.cumsum([len(r["b"]) for r in rows])[:-1])

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return by_bucket(batches, answer)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row, answers in by_load(batches, "c"):
            yield finish(Told(row, answers))

    dealt = docs.mapInArrow(deal, PACKED).repartitionById(buckets, "bucket")
    return dealt.mapInArrow(settle, PACKED).repartition(buckets, "key").mapInArrow(merge, schema)
