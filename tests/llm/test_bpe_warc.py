"""BPE against the library, WARC archives as exact round trips."""

import hashlib

import pytest
import zstandard
from assayer.llm import bpe, warc
from assayer.llm.queries import tokenizer_path

TEXTS = [
    "", None, "  ", "Hello World's foo<|endoftext|>bar <|startoftext|>", "aaaaaaa aaaa ababab", "é́ é ́x   a b \x85", "İSTANBUL ΣΑΣ ΟΔΟΣ ǅ",
    "x\x1cy \x00\x1f a b", "日本語123 ٣٤ 🙂🙂 ½", "<|endoftext|><|endoftext|>a<|x", "it'll we've'd I'M", "a" * 5001, "word, Words; " * 20_000, "aaaaaaa aaaa ababab",
]


def test_encode_and_decode_match_library(spark):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer_path())
    docs = spark.createDataFrame([(i, x, "id") for i, x in enumerate(TEXTS)] + [(None, "null id", "n")], "doc_id long, text string, id string")
    got = {r.id: (r.ids, r.decoded) for r in bpe.encode_documents(docs, tokenizer_path()).collect()}
    hashed = {r.id: r for r in bpe.digest_documents(docs, tokenizer_path()).collect()}
    assert len(got) == len(TEXTS) + 1
    for i, x in enumerate(TEXTS):
        e = t.encode(x or "", add_special_tokens=False)
        assert got[i] == (" ".join(map(str, e.ids)), t.decode(e.ids, skip_special_tokens=False))
        assert hashed[i].n_tokens == len(e.ids)
        assert hashed[i].ids_sha256 == hashlib.sha256(got[i][0].encode()).hexdigest()
    assert bpe.digest_documents(docs.where("1=0"), tokenizer_path()).count() == 0


def test_equal_symbol_runs_and_small_caches():
    from tokenizers import Tokenizer

    t, m = Tokenizer.from_file(tokenizer_path()), bpe.PairIndexBpe(tokenizer_path(), limit=3)
    words = [c * n for c in "aeo0!z" for n in range(1, 40)]
    for w, (ids, _) in zip(words, m.encode([w.encode() for w in words], step=16)):
        assert ids == " ".join(map(str, t.encode(w, add_special_tokens=False).ids))


@pytest.fixture(scope="module")
def pages(spark):
    long = "<p>" + "x" * 200 + "</p>"
    rows = [(i, f"http://h/{i}?a=b c\r\nX: y", long + str(i % 7), "t") for i in range(60)]
    rows += [(100, None, None, None), (101, "u", "", None), (102, "u", "short", None), (103, "u", "short", None), (104, "é", "ß" * 50, None), (105, "é", "ß" * 50, None), (106, "u", "y" * 2_000_000 + "\r\n\r\nWARC/1.1", None), (None, "u", long + "0", None), (107, "u", "ß" * 49, None), (108, "u", "ß" * 49, None)]
    return spark.createDataFrame(rows, "page_id long, url string, html string, payload string").repartition(3)


def test_round_trip(spark, pages):
    got = warc.round_trip(pages).collect()
    rows = pages.collect()
    assert sorted(str(g.page_id) for g in got) == sorted(str(r.page_id) for r in rows)
    mine = {g.page_id: g for g in got}
    for r in rows:
        body = (r.html or "").encode()
        same = [x.page_id for x in rows if (x.html or "") == (r.html or "") and x.page_id is not None]
        first = min(same) if len(body) >= 100 else r.page_id
        g = mine[r.page_id]
        assert (g.payload_bytes, g.payload_digest) == (len(body), hashlib.sha256(body).hexdigest())
        assert (g.record_type, g.refers_to) == (("response", None) if first == r.page_id else ("revisit", first))
        assert bytes(g.payload or b"") == (body if g.record_type == "response" else b"")


def test_revisits_agree_with_their_responses(spark, pages):
    got = warc.round_trip(pages).cache()
    assert got.where("record_type = 'revisit'").count() > 0 and warc.broken_revisits(got).count() == 0
    first = got.where("refers_to IS NOT NULL").first().refers_to
    lost = got.where(f"NOT (page_id <=> {first})")
    assert {r.refers_to for r in warc.broken_revisits(lost).collect()} == {first}


def test_records_of_unknown_length_are_read():
    payload = b"z" * 5_000_000
    body = warc.record_bytes(1, "u", "response", None, len(payload), hashlib.sha256(payload).hexdigest(), payload)
    frame = zstandard.ZstdCompressor(write_content_size=False).compress(body)
    assert [r["payload"] for r in warc.read_records(frame)] == [payload]


def test_empty_table(spark, pages):
    assert warc.round_trip(pages.where("1=0")).count() == 0


def test_reader_validates():
    digest = hashlib.sha256(b"abc").hexdigest()
    good = warc.record_bytes(1, "u", "response", None, 3, digest, b"abc")
    data = warc.archive_bytes([good] * 3)
    assert [r["page_id"] for r in warc.read_records(data)] == ["1"] * 3
    for bad in (good[:-1], good.replace(b"Content-Length: 3", b"Content-Length: 4"), good.replace(b"abc", b"abd"), good.replace(b"WARC/1.1", b"HTTP/1.1"), good.replace(b"response", b"metadata"), b""):
        broken = warc.archive_bytes([good, bad, good])
        with pytest.raises(warc.ArchiveError):
            list(warc.read_records(broken))
        assert ["error" in r for r in warc.read_records(broken, strict=False)] == [False, True, False]
    for cut in (5, 20, len(data) - 1, len(data) - 40):
        with pytest.raises(warc.ArchiveError):
            list(warc.read_records(data[:cut]))


def test_damaged_archives_are_rows(spark):
    """Each kind of damage: cut short, bytes behind, a broken frame, no dictionary, an id that is no number."""
    import struct

    good = [warc.record_bytes(i, f"http://x/{i}", "response", None, len(b), hashlib.sha256(b).hexdigest(), b) for i, b in enumerate([b"a" * 300, b"b" * 50_000, b""])]
    whole = warc.archive_bytes(good)
    start = 8 + struct.unpack_from("<II", whole)[1]
    first = warc.frame_end(memoryview(whole), start)
    broken = bytearray(whole)
    broken[first - 6] ^= 255
    odd = warc.archive_bytes([warc.record_bytes("ten", None, "response", None, 1, hashlib.sha256(b"x").hexdigest(), b"x"), good[0]])
    cases = {"cut": (whole[:-3], 2, 1), "behind": (whole + b"more", 3, 1), "frame": (bytes(broken), 2, 1), "no-frames": (b"\x00" * 40, 0, 1), "dictionary": (whole[: start - 9], 0, 1), "garbled": (whole[:20] + b"\xff" * 40, 0, 1), "empty": (b"", 0, 0), "odd": (odd, 1, 1), "whole": (whole, 3, 0)}
    files = spark.createDataFrame([(f"/f/{n}", bytearray(data)) for n, (data, _, _) in cases.items()], "path string, content binary")
    found = warc.read_archives(files, "bigint", strict=False).collect()
    for name, (data, records, errors) in cases.items():
        mine = [r for r in found if r.archive == name]
        assert (sum(r.error is None for r in mine), sum(r.error is not None for r in mine)) == (records, errors), name
        if errors:
            with pytest.raises(Exception):
                warc.read_archives(files.where(f"path = '/f/{name}'"), "bigint").collect()


def test_a_revisit_needs_its_response(spark):
    heads = spark.createDataFrame([(1, 100, "d", "response", None), (2, 100, "d", "revisit", 1), (3, 99, "d", "revisit", 1), (4, 100, "d", "revisit", 9)], "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")
    assert warc.with_checked_revisits(heads.where("page_id < 3")).count() == 2
    for bad in (3, 4):
        with pytest.raises(Exception, match="revisit without its response"):
            warc.with_checked_revisits(heads.where(f"page_id < 3 OR page_id = {bad}")).collect()


def test_other_files_are_refused(tmp_path):
    import json

    spec = json.load(open(tokenizer_path(), encoding="utf-8"))
    bpe.check_file(spec, "as it is")
    changes = {"decoder": {"type": "ByteLevel"}, "normalizer": {"type": "NFC"}, "pre_tokenizer": {"type": "Whitespace"}, "added_tokens": [{"id": 0, "content": "[X]"}], "model": {**spec["model"], "unk_token": "?"}}
    for name, value in changes.items():
        with pytest.raises(ValueError, match="can't be encoded"):
            bpe.check_file({**spec, name: value}, name)
