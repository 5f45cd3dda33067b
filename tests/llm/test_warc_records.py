"""Archives and token records: exact round trips."""

import hashlib
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from gridlapse.llm import records, warc
from tests.llm.frames import documents, odd_rows, prose

PATH = public_tokenizers.path("word_bpe_49k.json")


def test_archives_resolve_revisits(spark):
    body, small = "<p>" + "x" * 200 + "é</p>", "<p>small</p>"
    rows = [(3, "u3", body), (1, "u1", body), (2, None, body), (4, "u\r\n4", small), (5, "u5", small), (6, "u6", None), (7, "u7", ""), (None, "n", body), (1, "u1", body), (8, "u8", "y" * 100), (9, "u9", "y" * 100), (10, "a", "z" * 99), (11, "b", "z" * 99)]
    pages = spark.createDataFrame([(*r, 1, "x") for r in rows], "page_id long, url string, html string, payload_bytes int, first_id string")
    manifest = warc.archive(pages)
    got = sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to, r.verified) for r in warc.read_archives(manifest).collect()), key=str)
    want = []
    for page, _, html in rows:
        data = (html or "").encode()
        same = [p for p, _, h in rows if h == html and p is not None]
        first = min(same) if same and len(data) >= 100 else page
        revisit = first != page
        want.append((page, len(data), hashlib.sha256(data).hexdigest(), "revisit" if revisit else "response", first if revisit else None, True))
    assert got == sorted(want, key=str)
    assert manifest.agg({"records": "sum"}).first()[0] == len(rows)


def test_archives_of_nothing(spark):
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    assert warc.read_archives(warc.archive(pages)).count() == 0


def test_damaged_archive_is_refused():
    good = warc.record(1, "u", b"abc", 3, "d", "response", None)
    fields, block = warc.parse(good)
    assert block.endswith(b"abc") and fields["warc-type"] == "response"
    with pytest.raises(ValueError):
        warc.parse(good[:-3])


def test_records_round_trip(spark):
    rows = odd_rows() + [(9, "<|endoftext|> as text"), (10, "don't WE'LL 'S ''s x1 22"), (11, "ΟΔΟΣ İstanbul ﬁ á")]
    docs = documents(spark, rows)
    manifest = records.write_records(docs, PATH, end_id=2, files=3)
    got = [tuple(r) for r in records.read_records(manifest).collect()]
    got.sort(key=lambda r: r[1])
    reference, start, want = Tokenizer.from_file(PATH), 0, []
    for doc_id, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")):
        ids = np.array(reference.encode(text or "", add_special_tokens=False).ids + [2], dtype="<u4")
        want.append((doc_id, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    assert got == want
    index = records.record_index(manifest)
    assert index.count() == len(rows)
    shuffled = [(r.doc_id, len(r.ids)) for r in records.read_shuffled(manifest, 1, 2).collect()]
    assert sorted(shuffled, key=str) == sorted(((w[0], w[2]) for w in want), key=str)
    assert shuffled == [(r.doc_id, len(r.ids)) for r in records.read_shuffled(manifest, 1, 2).collect()]
    assert shuffled != [(r.doc_id, len(r.ids)) for r in records.read_shuffled(manifest, 5, 2).collect()]


def test_a_repeated_id_fills_many_files(spark):
    rows = [(5, prose(1, 20))] * 3000 + [(None, "")] * 500 + [(i, prose(i, 5)) for i in range(200)]
    manifest = records.write_records(documents(spark, rows).repartition(6), public_tokenizers.path("word_bpe_49k.json"), end_id=2, files=8)
    sizes = [r.records for r in manifest.collect()]
    assert sum(sizes) == len(rows) and max(sizes) < 1500
    starts = [(r.start, r.n_tokens) for r in records.read_records(manifest).orderBy("start").collect()]
    assert all(a + n == b for (a, n), (b, _) in zip(starts, starts[1:]))


def test_records_of_nothing(spark):
    manifest = records.write_records(documents(spark, []), PATH, end_id=2)
    assert records.read_records(manifest).count() == 0


def test_frames_detect_damage():
    framed = records.frame(b"payload")
    assert records.unframe(framed) == b"payload"
    for at in range(len(framed)):
        broken = bytearray(framed)
        broken[at] ^= 1
        with pytest.raises(ValueError):
            records.unframe(bytes(broken))
    with pytest.raises(ValueError):
        records.unframe(framed[:10])


@pytest.mark.parametrize("remembered", [40, 300_000])
def test_encoder_equals_the_tokenizer(remembered):
    reference = Tokenizer.from_file(PATH)
    coder = records.WordEncoder(reference, remembered)
    assert coder.known
    import random

    some = random.Random(3)
    letters = "aZ9 .'sStTàÀß-_|<>\n\t ́éΩ中١\x7f\x1f"
    texts = ["".join(some.choices(letters, k=some.randint(0, 15))) for _ in range(3000)] + [prose(1, 500), "<|startoftext|>x", ""]
    for text in texts:
        assert coder.encode(text).tolist() == reference.encode(text, add_special_tokens=False).ids, repr(text)
