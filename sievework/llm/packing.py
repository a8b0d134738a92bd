"""Best-fit packing of token sequences, with bounds that certify each partition's bin count.

Documents become token ids; longer ones than a sequence are cut.  Pieces are dealt over partitions of bounded size,
and each packs its own by best-fit decreasing.  A dual-feasible function f has sum f(x) <= 1 over any set of sizes
that fits a bin, so the sum over all sizes is a lower bound of the bins.  A partition that meets its bound is proven
optimal and closes all bins but its emptiest; one with a gap puts all its unfilled bins back.  What was put back is
dealt out anew over partitions of bounded size and packed again, until the bins stop falling or EXCHANGES rounds are
over.  Then every partition closes all bins but its emptiest, as no two bins of a partition fit together; these last
bins meet again in as many partitions of bounded size as they fill, until these grow no fewer.

Defined cases: a null or empty text is the end token alone; a piece of full length fills a sequence by itself; equal
rows are separate pieces; pieces that tie in length are placed in the order they come; an empty table gives no rows; a
null id is packed as any other; texts of any length are cut into pieces, one task holding the ids of one text; other
columns are ignored.
"""

from __future__ import annotations

import functools
import json
import struct
import unicodedata
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievework.llm.bpe import byte_letters
from sievework.llm.shared import staged, text_slices

SEQUENCE, END_ID = 4096, 1
#: Pieces a partition packs at once.
GROUP_ROWS = 100_000
#: Rounds in which partitions with a gap put back their unfilled bins.
EXCHANGES = 8
#: Chunks after which a worker's store of ids is set aside; it is looked up, and the one set aside before it is left.
CACHE_CHUNKS = 200_000


class ChunkIds:
    """Ids of texts from a vocabulary in lower case whose words never cross white space: each distinct chunk is
    encoded once.  A chunk of letters, perhaps with closing punctuation, is one word for the vocabulary's model, which
    then needs neither normalizing nor splitting; all other chunks take the whole way."""

    CLOSING = b".,!?;:"

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.whole = Tokenizer.from_file(path)
        self.whole.no_padding()
        self.whole.no_truncation()
        self.word = Tokenizer.from_str(json.dumps(spec | {"normalizer": None, "pre_tokenizer": None, "added_tokens": [], "padding": None, "truncation": None}))
        self.letters = {b: c for c, b in byte_letters().items()}
        self.known: dict[bytes, bytes] = {}
        self.before: dict[bytes, bytes] = {}
        self.tails: dict[bytes, bytes] = {b"": b""}

    def learn(self, chunks: list[bytes]) -> None:
        tokenize, known, rest = self.word.model.tokenize, self.known, []
        for c in chunks:
            core = c.rstrip(self.CLOSING)
            text, tail = core.decode(), c[len(core) :]
            if not (text.isalpha() and text.lower() == text and unicodedata.is_normalized("NFC", text)):
                rest.append(c)
                continue
            if tail not in self.tails:
                self.tails[tail] = _little(self.whole.encode(tail.decode(), add_special_tokens=False).ids)
            known[c] = _little([t.id for t in tokenize(core.decode("latin-1").translate(self.letters))]) + self.tails[tail]
        for c, e in zip(rest, self.whole.encode_batch_fast([c.decode() for c in rest], add_special_tokens=False), strict=True):
            known[c] = _little(e.ids)

    def ids(self, texts: list[bytes]) -> list[bytes]:
        """Little-endian 32-bit ids of each text, with the end token."""
        if len(self.known) > CACHE_CHUNKS:
            # what was of use since the store was last full stays
            self.before, self.known = self.known, {}
            self.tails = {b"": b""}
        known, before = self.known, self.before
        # the vocabulary has no capitals, but special tokens are told apart before that
        chunks = [(t if b"<|" in t else t.lower()).split() for t in texts]
        new = {c for own in chunks for c in own if c not in known}
        old = [c for c in new if c in before]
        known.update(zip(old, map(before.__getitem__, old), strict=True))
        self.learn(list(new.difference(old)))
        end = _little([END_ID])
        return [b"".join([known[c] for c in own]) + end for own in chunks]


def _little(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


@functools.lru_cache(maxsize=2)
def chunk_ids(path: str) -> ChunkIds:
    return ChunkIds(path)


def token_pieces(docs: DataFrame, path: str, most: int = SEQUENCE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, piece, start, length and ids_crc32 of every piece of at most `most` ids."""
    kinds = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = chunk_ids(path)
        for batch in text_slices(batches):
            rows = []
            for doc_id, ids in zip(batch.column("doc_id").to_pylist(), model.ids([(t or "").encode() for t in batch.column("text").to_pylist()]), strict=True):
                n = len(ids) // 4
                rows += [(doc_id, k, at, min(most, n - at), zlib.crc32(ids[4 * at : 4 * (at + most)])) for k, at in enumerate(range(0, n, most))]
            yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*rows, strict=True), kinds, strict=True)], schema=kinds)

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(task, "doc_id long, piece int, start long, length long, ids_crc32 long")


def bin_bound(sizes: np.ndarray, capacity: int) -> int:
    """The best lower bound of the bins from three families of dual-feasible functions, in whole numbers."""
    if not len(sizes):
        return 0
    x = np.asarray(sizes, dtype=np.int64)
    best = -(-int(x.sum()) // capacity)
    values, counts = np.unique(x, return_counts=True)
    for k in range(1, 17):  # rounding: (k+1)x, where not whole, goes down to a multiple of 1/k
        scaled = (k + 1) * values
        whole = scaled % capacity == 0
        f = np.where(whole, k * values, (scaled // capacity) * capacity)  # k * capacity times the value of the function
        best = max(best, -(-int((f * counts).sum()) // (k * capacity)))
    # thresholds: sizes above capacity - e count as whole bins, those below e as nothing
    total = np.concatenate([[0], np.cumsum(values * counts)])
    number = np.concatenate([[0], np.cumsum(counts)])
    e = values[values <= capacity // 2]
    low, high = np.searchsorted(values, e, side="left"), np.searchsorted(values, capacity - e, side="right")
    if len(e):
        best = max(best, int((-(-(total[high] - total[low]) // capacity) + number[-1] - number[high]).max()))
    return best


def best_fit_decreasing(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each piece its bin and place there, and the room left in each bin.  The tightest bin is found in a bit set of rooms."""
    bins, offsets = np.empty(len(sizes), dtype=np.int64), np.empty(len(sizes), dtype=np.int64)
    by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    room: list[int] = []
    there = 0  # bit r: a bin with room r
    for i in np.argsort(-sizes, kind="stable").tolist():
        size = int(sizes[i])
        fit = there >> size
        if fit:
            r = size + (fit & -fit).bit_length() - 1
            b = by_room[r].pop()
            if not by_room[r]:
                there ^= 1 << r
        else:
            r, b = capacity, len(room)
            room.append(capacity)
        bins[i], offsets[i] = b, capacity - r
        room[b] = r - size
        if room[b]:
            by_room[room[b]].append(b)
            there |= 1 << room[b]
    return bins, offsets, np.array(room, dtype=np.int64)


def pack(pieces: DataFrame, capacity: int = SEQUENCE, group_rows: int = GROUP_ROWS) -> DataFrame:
    """pieces (staged, with a length of at most capacity) and sequence_id, offset."""
    columns = pieces.columns
    # again: 0 for a bin that is done, 1 for one that may be exchanged, 2 for the emptiest of its partition
    schema = ", ".join(f"{n} {t}" for n, t in pieces.dtypes) + ", sequence_id long, offset long, again int"

    def packer(level: int):
        def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held = [b for b in batches if b.num_rows]
            if not held:
                return
            table = pa.Table.from_batches(held).combine_chunks()
            sizes = table["length"].to_numpy()
            bins, offsets, room = best_fit_decreasing(sizes, capacity)
            again = np.zeros(len(room), dtype=np.int32)
            if len(room) > bin_bound(sizes, capacity):
                again[room > 0] = 1
            if room.max() > 0:
                again[room.argmax()] = 2
            group = (level << 56) | (TaskContext.get().partitionId() << 28)
            table = table.append_column("sequence_id", pa.array(group + bins)).append_column("offset", pa.array(offsets)).append_column("again", pa.array(again[bins]))
            yield from table.to_batches()

        return task

    def packed_in(left: DataFrame, groups: int, level: int) -> DataFrame:
        # dealt in turn, so that equal pieces meet no more than others
        own = left.select(*columns)
        dealt = own.repartition(groups) if groups > 1 else own.coalesce(1)
        return staged(dealt.mapInArrow(packer(level), schema), "packed")

    def both(done: DataFrame | None, part: DataFrame) -> DataFrame:
        return part.drop("again") if done is None else done.unionByName(part.drop("again"))

    done, left, size, before, level = None, pieces, pieces.count(), None, 0
    while True:
        groups = max(1, -(-size // group_rows))
        packed = packed_in(left, groups, level)
        level += 1
        if groups == 1:
            return both(done, packed)
        start, open_bin = F.col("offset") == 0, F.col("again") > 0  # every bin has one piece at its start
        size, bins, put_back = packed.agg(F.count_if(open_bin), F.count_if(start), F.count_if(open_bin & start)).first()
        if before is not None and bins >= before:
            break  # the packing of the round before stays
        done, left, before = both(done, packed.filter(~open_bin)), packed.filter(open_bin), put_back
        if level == EXCHANGES:
            break
    while True:
        done, left = both(done, left.filter("again < 2")), left.filter("again = 2")
        before, groups = groups, max(1, -(-left.count() // group_rows))
        if groups >= before:
            return both(done, left)
        left = packed_in(left, groups, level)
        level += 1


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    pieces = token_pieces(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("word_bpe_49k.json"))
    return pack(staged(pieces, "pieces"))
