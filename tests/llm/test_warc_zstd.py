from __future__ import annotations

import hashlib
import struct

import pytest
import zstandard

from ledgerpitch.llm import warc_zstd as wz


def record(n: int) -> bytes:
    block = f"<p>{n} {'text ' * 40}</p>".encode()
    head = {
        "WARC-Type": "response", "WARC-Record-ID": f"<urn:uuid:{n}>", "WARC-Date": "2024-01-01T00:00:00Z",
        "WARC-Page-ID": str(n), "WARC-Target-URI": "x", "WARC-Payload-Digest": f"sha256:{hashlib.sha256(block).hexdigest()}",
    }
    return wz.write_record(head, block)


def test_archives_of_any_size_come_back():
    for n in (1, 3, 40, 700):
        frames = list(wz.pack_frames(record(k) for k in range(n)))
        assert len(frames) == n + 1
        data = wz.SEPARATOR.encode().join(frames) + wz.SEPARATOR.encode()
        assert [r.headers["warc-page-id"] for r in wz.read_archive(data)] == [str(k) for k in range(n)]
        with_dictionary = zstandard.ZstdCompressionDict(frames[0][8:]) if len(frames[0]) > 8 else None
        if with_dictionary:
            plain = zstandard.ZstdDecompressor(dict_data=with_dictionary).decompress(frames[1])
            assert plain == record(0)
    assert list(wz.pack_frames(iter([]))) == []


def test_damage_is_found():
    frames = list(wz.pack_frames(record(k) for k in range(30)))
    data = b"".join(frames)
    with pytest.raises(wz.ArchiveError):
        list(wz.read_archive(data[len(frames[0]) :]))
    with pytest.raises(wz.ArchiveError):
        list(wz.read_archive(data[:-3]))
    with pytest.raises(wz.ArchiveError):
        list(wz.read_archive(data + b"junk-junk"))
    broken = bytearray(data)
    broken[len(frames[0]) + len(frames[1]) // 2] ^= 0x55
    with pytest.raises((wz.ArchiveError, zstandard.ZstdError)):
        list(wz.read_archive(bytes(broken)))
    assert list(wz.read_archive(struct.pack("<II", wz.DICTIONARY_MAGIC, 0))) == []


@pytest.mark.parametrize(
    ("old", "new"),
    [(b"Content-Length: ", b"Content-Length: 1"), (b"WARC/1.1", b"WARC/9.9"), (b"WARC-Date: ", b"WARC Date: "),
     (b"sha256:", b"sha256:0"), (b"WARC-Type: response\r\n", b"")],
)
def test_bad_records_are_refused(old, new):
    with pytest.raises(wz.ArchiveError):
        wz.parse_record(record(1).replace(old, new, 1))


def run(spark, rows, folder):
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, digest string, key string")
    wz.write_archives(pages, folder)
    return sorted(map(tuple, wz.page_records(wz.read_archives(spark, folder)).collect()), key=str)


def test_pages_against_brute_force(spark, tmp_path):
    big, small = "é" * 60, "a" * 99
    rows = [(9, "http://a/ b\r\nc", big), (4, "u", big), (5, None, big), (4, "u", big), (7, "u", small), (8, "u", small),
            (1, "u", None), (2, "u", ""), (None, "u", big), (None, None, "z" * 200), (None, "v", "z" * 200),
            (11, "u", "<html>" + "long " * 300_000)]
    want = []
    for page, _, html in rows:
        payload = (html or "").encode()
        same = [p for p, _, h in rows if (h or "") == (html or "") and p is not None]
        first = min(same) if same and len(payload) >= 100 else None
        revisit = first is not None and page != first
        want.append((page, len(payload), hashlib.sha256(payload).hexdigest(), "revisit" if revisit else "response", first if revisit else None))
    assert run(spark, [(*r, "d", "k") for r in rows], str(tmp_path / "a")) == sorted(want, key=str)


def test_an_empty_table_has_no_records(spark, tmp_path):
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    wz.write_archives(pages, str(tmp_path / "e"))
    assert wz.read_archives(spark, str(tmp_path / "e")).count() == 0


def test_urls_are_kept_on_one_line(spark, tmp_path):
    pages = spark.createDataFrame([(1, "http://a/b c\né", "x")], "page_id long, url string, html string")
    wz.write_archives(pages, str(tmp_path / "u"))
    assert wz.read_archives(spark, str(tmp_path / "u")).first()["url"] == "http://a/b%20c%0A%C3%A9"
