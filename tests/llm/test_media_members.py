"""Media members: the stored form and features by hand, retries of one member, and a damaged member among whole ones."""

from __future__ import annotations

import hashlib
import os
import struct
import zipfile

from pyarrow import fs

from sievework.llm import media
from tests.llm.test_operators import frame, odd_documents


def plain(text: str | None) -> tuple:
    """media_bytes, media_sha256 and feature, written out."""
    raw = (text or "").encode()
    raw += bytes(64 - len(raw) % 64 if len(raw) % 64 or not raw else 0)
    wav = b"RIFF" + struct.pack("<I", 36 + len(raw)) + b"WAVEfmt " + struct.pack("<IHHIIHH", 16, 1, 1, 8000, 8000, 1, 8) + b"data" + struct.pack("<I", len(raw)) + raw
    x = [b - 128 for b in raw]
    crossings = sum((a >= 0) != (b >= 0) for a, b in zip(x, x[1:], strict=False))
    bins = [sum(b // 32 == k for b in raw) for k in range(8)]
    return len(wav), hashlib.sha256(wav).hexdigest(), f"sum={sum(x)};energy={sum(v * v for v in x)};crossings={crossings};bins={'/'.join(map(str, bins))}"


def test_stored_form_and_features(spark, tmp_path):
    docs = odd_documents()
    folder = media.write_archives(frame(spark, docs), f"file://{tmp_path}/media")
    found = media.media_features(media.read_archives(spark, folder, rangeBytes="3000")).collect()
    expected = [(d, *plain(t)) for d, t in docs]
    assert sorted(((r.doc_id, r.media_bytes, r.media_sha256, r.feature) for r in found), key=repr) == sorted(expected, key=repr)


class Flaky:
    """A filesystem whose first reads fail."""

    def __init__(self, failures: int) -> None:
        self.failures, self.opened = failures, 0

    def open_input_file(self, name: str):
        self.opened += 1
        if self.opened <= self.failures:
            raise OSError("lost")
        return fs.LocalFileSystem().open_input_file(name)


def test_a_member_is_retried(spark, tmp_path):
    folder = media.write_archives(frame(spark, [(1, "one"), (2, "two")]).coalesce(1), f"file://{tmp_path}/media")
    (name,) = os.listdir(f"{tmp_path}/media/archives")
    path = f"{tmp_path}/media/archives/{name}"
    info = zipfile.ZipFile(path).infolist()[1]
    for failures, attempts in ((0, 1), (2, 3), (3, 3)):
        reader, flaky = media.MediaReader({"path": folder, "attempts": str(attempts), "onError": "null"}), Flaky(failures)
        got, error = reader.member(flaky, path, info, [])
        assert flaky.opened == min(failures + 1, attempts)
        if failures < attempts:
            assert error is None and media.from_wav(got)[:3] in (b"one", b"two")
        else:
            assert got is None and "lost" in error


def test_a_damaged_member_among_whole_ones(spark, tmp_path):
    docs = [(k, f"text {k} " * 50) for k in range(20)]
    folder = media.write_archives(frame(spark, docs).coalesce(1), f"file://{tmp_path}/media")
    (name,) = os.listdir(f"{tmp_path}/media/archives")
    path = f"{tmp_path}/media/archives/{name}"
    info = zipfile.ZipFile(path).infolist()[7]
    with open(path, "r+b") as f:
        f.seek(info.header_offset + 30 + len(info.filename) + 8)
        f.write(b"\xff" * 12)
    found = media.read_archives(spark, folder, rangeBytes="500", onError="null").collect()
    bad = [r for r in found if r.media is None]
    assert len(found) == 20 and len(bad) == 1 and bad[0].error and bad[0].offset == info.header_offset
    assert {r.doc_id for r in found} == set(range(20))
    good = {r.doc_id: media.from_wav(r.media)[: r.n_bytes].decode() for r in found if r.media is not None}
    assert all(good[k] == t for k, t in docs if k in good)
    features = media.media_features(media.read_archives(spark, folder, onError="null")).filter("payload_sha256 is null").collect()
    assert len(features) == 1 and features[0].doc_id == bad[0].doc_id
