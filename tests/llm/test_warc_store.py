import base64
import hashlib
import io
import random

import pytest
from helpers import clashing

from siftline.llm import warc_store
from siftline.llm.storage import Scratch

SCHEMA = "page_id long, url string, html string"


def digest(text):
    return base64.b32encode(hashlib.sha1((text or "").encode()).digest()).decode()


def rows(seed=1):
    rng = random.Random(seed)
    out = [(i, f"http://h{i}.org/a b\r\nx: y", rng.choice(["", "é" * 10, "<p>\r\n\r\nWARC/1.1\r\n" * 3, str(i), str(i // 3), "same"])) for i in range(200)]
    return out + [(500, None, None), (501, "u", "big " * 400_000), (None, "n", "same"), (None, "n", "alone"), (700, "twice", "t"), (700, "twice", "t")]


def expected(data, least=0):
    top = {}
    for i, _, t in data:
        t = t or ""
        if i is not None:
            top[t] = max(top.get(t, i), i)
    out = []
    for i, _, t in data:
        t = t or ""
        size = len(t.encode())
        revisit = size >= least and t in top and top[t] != i
        out.append((i, size, digest(t), "revisit" if revisit else "response", top[t] if revisit else None))
    return sorted(out, key=str)


@pytest.mark.parametrize("least", [0, 5])
def test_round_trip(spark, least):
    df = clashing(spark.createDataFrame(rows(), SCHEMA)).repartition(3)
    assert sorted((tuple(r) for r in warc_store.round_trip(df, min_bytes=least).collect()), key=str) == expected(rows(), least)


def test_chunks_carry_digests(spark):
    df = spark.createDataFrame(rows(), SCHEMA)
    scratch = Scratch(spark, "test")
    manifest = warc_store.write_archives(df, scratch.path("a"), scratch, "page_id", "url", "html", archive_bytes=100_000)
    assert manifest.count() > 1
    chunks = warc_store.read_archives(manifest, chunk_bytes=1000, flush_bytes=5000).where("id = 501").orderBy("chunk_no").collect()
    whole = "big " * 400_000
    assert b"".join(c.payload for c in chunks).decode() == whole and max(len(c.payload) for c in chunks) == 1000
    assert [c.last for c in chunks] == [False] * (len(chunks) - 1) + [True]
    for c in (chunks[0], chunks[7], chunks[-1]):
        assert c.digest_so_far == digest(whole[: c.bytes_so_far])
    assert all(c.url == "u" for c in chunks)


def test_archives_are_checked():
    import zlib

    def archive(payload, told):
        member = zlib.compressobj(1, zlib.DEFLATED, 31)
        return member.compress(warc_store.record_head(1, "u", len(payload), told, None, "d") + payload + b"\r\n\r\n") + member.flush()

    good = archive(b"abc", digest("abc"))
    assert [r[-1] for r in warc_store.read_records(io.BytesIO(good + good), 2)] == [b"ab", b"c"] * 2
    with pytest.raises(ValueError, match="digest"):
        list(warc_store.read_records(io.BytesIO(archive(b"abd", digest("abc"))), 2))
    with pytest.raises(EOFError):
        list(warc_store.read_records(io.BytesIO(good[:-12]), 2))


def test_empty(spark):
    assert warc_store.round_trip(spark.createDataFrame([], SCHEMA)).count() == 0


def test_records_of_equal_or_null_ids_stay_apart(spark, tmp_path):
    rows = [(None, "u", "first"), (None, "u", "second"), (7, "u", "third"), (7, "u", "fourth one"), (-3, "u", "x")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    scratch = warc_store.Scratch(spark, "warc-test")
    chunks = warc_store.read_archives(warc_store.write_archives(pages, scratch.path("a"), scratch, "page_id", "url", "html"), chunk_bytes=3).collect()
    whole = {}
    for r in sorted(chunks, key=lambda r: r.chunk_no):
        whole.setdefault((r.archive, r.record_no, r.id), []).append(bytes(r.payload))
    assert sorted((b"".join(v).decode(), k[2]) for k, v in whole.items()) == sorted((t, i) for i, _, t in rows)
    back = sorted((r.page_id is None, r.page_id or 0, r.payload_bytes) for r in warc_store.round_trip(pages).collect())
    assert back == sorted((i is None, i or 0, len(t)) for i, _, t in rows)


def test_a_folder_without_scheme(spark, tmp_path, monkeypatch):
    from siftline.llm import storage

    get = type(spark.conf).get
    monkeypatch.setattr(type(spark.conf), "get", lambda self, name, *more: str(tmp_path) if name == "spark.checkpoint.dir" else get(self, name, *more))
    assert storage.shared_root(spark) == f"file://{tmp_path}"
    assert warc_store.round_trip(spark.createDataFrame([(1, "u", "abc")], "page_id long, url string, html string")).first().payload_bytes == 3
