"""BPE encoding and decoding by prefix-sharing trie traversal.

A task cuts its texts into words, inserts the distinct new ones into a trie and walks it depth first.  The state of
a node is the last token of the encoding of its prefix, so prefixes that words share are worked out once.  A
token may follow another if merging their bytes together leaves the two as they are; of the tokens that end a prefix
exactly one may follow the state of the node where it begins.

Defined cases: null text is empty and has no tokens; special-token strings in a text become the special token, as
the library does by default; a very long word is one path of the trie; rows are independent, so repeated rows give
repeated results and an empty table an empty one; other columns are ignored.
"""

from __future__ import annotations

import functools
import hashlib
import json
from collections.abc import Iterable, Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievework.llm.shared import text_slices

# Fixed value: the byte-level word pattern of the vocabulary.
WORD = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Words whose encodings a worker keeps; beyond it the store is emptied.
CACHE_WORDS = 500_000
NEVER = 1 << 60


def byte_letters() -> dict[str, int]:
    """The letters that a byte-level vocabulary writes for bytes: printable ones stand for themselves, others follow 255."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(others)}


class ByteBpe:
    """Encoder and decoder for a byte-level BPE vocabulary file."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters = byte_letters()
        raw = lambda s: bytes(letters[c] for c in s)
        self.ids = {raw(t): i for t, i in spec["model"]["vocab"].items()}
        self.bytes_of = {i: t for t, i in self.ids.items()}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.rank: dict[tuple[int, int], int] = {}
        self.parts: dict[int, tuple[int, int, int]] = {}  # token: left, right, rank
        for rank, (a, b) in enumerate(spec["model"]["merges"]):
            left, right = self.ids[raw(a)], self.ids[raw(b)]
            self.rank[left, right] = rank
            self.parts.setdefault(self.ids[raw(a) + raw(b)], (left, right, rank))
        self.apart = functools.lru_cache(maxsize=1 << 17)(self._apart)
        self.usable = dict(self.ids)
        for token, (left, right, rank) in self.parts.items():
            # a token that merging its own bytes never gives can't be in an encoding
            if not self._apart(left, right, rank):
                self.usable.pop(self.bytes_of[token], None)
        self.longest = max(map(len, self.usable))
        self.words: dict[str, tuple[str, bytes]] = {}
        self.find = regex.compile(WORD).findall
        self.cut = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")").split if self.special else None

    def _edge(self, token: int, last: bool) -> list[tuple[int, int]]:
        """The symbols that stand at a token's last (or first) place while it is merged, with the rank at which each goes."""
        edge, gone = [(token, NEVER)], NEVER
        while (made := self.parts.get(token)) is not None:
            token, gone = (made[1] if last else made[0]), made[2]
            edge.append((token, gone))
        return edge

    def _apart(self, a: int, b: int, limit: int = NEVER) -> bool:
        """Whether merging the bytes of a and b together, by ranks below limit, leaves a and b.  No pair of symbols
        across the boundary may be merged before both are gone; of equal ranks the left one goes first."""
        right = self._edge(b, last=False)
        for x, x_gone in self._edge(a, last=True):
            for y, y_gone in right:
                r = self.rank.get((x, y), NEVER)
                if r < limit and r < x_gone and r <= y_gone:
                    return False
        return True

    def learn(self, words: Iterable[str]) -> None:
        """Encode words by a walk over their trie: in byte order, each word goes on from what it shares with the one before."""
        tokens, longest, apart, bytes_of = self.usable, self.longest, self.apart, self.bytes_of
        before, states = b"", [-1]
        for word in sorted(w.encode() for w in words):
            shared = 0
            for x, y in zip(before, word, strict=False):
                if x != y:
                    break
                shared += 1
            del states[shared + 1 :]
            for end in range(shared + 1, len(word) + 1):
                for start in range(max(0, end - longest), end):
                    token = tokens.get(word[start:end])
                    if token is not None and (start == 0 or apart(states[start], token)):
                        states.append(token)
                        break
            at, taken = len(word), []
            while at:
                taken.append(states[at])
                at -= len(bytes_of[states[at]])
            taken.reverse()
            self.words[word.decode()] = ",".join(map(str, taken)), b"".join(bytes_of[t] for t in taken)
            before = word

    def split(self, text: str) -> Iterator[list[str]]:
        """Runs of words; a run that is one special token stands alone."""
        if self.cut is None or not any(s in text for s in self.special):
            yield self.find(text)
            return
        for piece in self.cut(text):
            if piece in self.special:
                yield [piece]
            elif piece:
                yield self.find(piece)

    def digest(self, texts: list[str]) -> list[tuple[int, str, bytes]]:
        """Of each text: number of tokens, ids joined by commas, decoded bytes."""
        runs = [list(self.split(t)) for t in texts]
        if len(self.words) > CACHE_WORDS:
            self.words.clear()
        for s, i in self.special.items():
            self.words[s] = str(i), s.encode()
        known = self.words
        self.learn({w for run in runs for words in run for w in words if w not in known})
        out = []
        for run in runs:
            found = [known[w] for words in run for w in words]
            ids, decoded = zip(*found, strict=True) if found else ((), ())
            ids = ",".join(ids)
            out.append((ids.count(",") + 1 if ids else 0, ids, b"".join(decoded)))
        return out


@functools.lru_cache(maxsize=2)
def encoder(path: str) -> ByteBpe:
    """One encoder a worker process and vocabulary."""
    return ByteBpe(path)


def encode_column(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = True) -> DataFrame:
    """doc_id, n_tokens, ids (comma-joined; left out without keep_ids), ids_sha256, decoded_sha256 of every row."""
    kinds = [("doc_id", pa.int64()), ("n_tokens", pa.int64()), *([("ids", pa.string())] * keep_ids), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())]

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = encoder(path)
        for batch in text_slices(batches):
            columns: dict[str, list] = {n: [] for n, _ in kinds}
            columns["doc_id"] = batch.column("doc_id").to_pylist()
            for n, ids, decoded in model.digest([t or "" for t in batch.column("text").to_pylist()]):
                columns["n_tokens"].append(n)
                if keep_ids:
                    columns["ids"].append(ids)
                columns["ids_sha256"].append(hashlib.sha256(ids.encode()).hexdigest())
                # decoding gives text, so bytes that are not UTF-8 become replacement characters
                columns["decoded_sha256"].append(hashlib.sha256(decoded.decode("utf-8", "replace").encode()).hexdigest())
            yield pa.RecordBatch.from_pydict(columns, schema=pa.schema(kinds))

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(task, ", ".join(f"{n} {'long' if t == pa.int64() else 'string'}" for n, t in kinds))


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return encode_column(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("byte_bpe_50k.json"), keep_ids=False)
