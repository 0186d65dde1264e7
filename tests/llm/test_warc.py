"""WARC archives: round trips, records that break a rule, archives of other writers."""

import hashlib

import duckdb
import pytest
import zstandard

from ringweave.llm import warc

LONG, OTHER = "<p>équal payload</p>" * 9, "<b>another payload</b>\r\n\r\n" * 8
PAGES = [
    (5, "http://a/5", LONG), (3, None, LONG), (9, "http://a/9?x=ä b\r\nX: y", LONG), (3, "http://a/3", LONG), (None, "http://n", LONG), (None, "http://n2", OTHER), (None, None, OTHER),
    (1, "http://b/1", "short"), (2, "http://b/2", "short"), (4, "", ""), (6, "http://c", None), (7, "http://d", "x" * 99), (8, "http://e", "x" * 99), (10, "http://f", "y" * 100), (11, "http://g", "y" * 100),
    (12, "http://h", "\x00\x01 nul " * 40), (13, "http://i", "long text " * 300_000), (-1, "http://j", "z" * 500),
]
KIND = "page_id long, url string, html string, digest string, first long, error string"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    out = tmp_path_factory.mktemp("pages")
    many = PAGES + [(100 + k, f"http://m/{k}", f"<html><head><title>page {k}</title></head><body><p>{'common words of all pages ' * (k % 7)}{k * k}</p></body></html>") for k in range(400)]
    spark.createDataFrame([(*p, "x", 1, "y") for p in many], KIND).repartition(4).write.parquet(f"file://{out}/pages.parquet")
    return out


def test_query_against_sql(spark, folder):
    got = [tuple(r) for r in warc.query(spark, f"file://{folder}").select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()]
    want = duckdb.sql(f"WITH pages AS (SELECT * FROM '{folder}/pages.parquet/*.parquet') SELECT * FROM ({warc.SQL})").fetchall()
    order = lambda r: tuple(map(str, r))
    assert sorted(got, key=order) == sorted(want, key=order)
    by = {r[0]: r for r in got if r[0] is not None}
    assert by[3][3:] == ("response", None) and by[5][3:] == by[9][3:] == ("revisit", 3) and by[8][3:] == by[2][3:] == ("response", None) and by[11][3:] == ("revisit", 10)
    assert sorted(r[3] for r in got if r[0] is None) == ["response", "response", "revisit"]


def test_archives(spark, folder, tmp_path):
    """Frames are what the format asks for, and the payloads come back."""
    pages = spark.read.parquet(f"file://{folder}/pages.parquet")
    warc.write(pages, f"file://{tmp_path}/a")
    for k, path in enumerate(sorted((tmp_path / "a").glob("part-*"))):
        data = path.read_bytes()
        assert data[:4] == b"\x5d\x2a\x4d\x18"
        trained = data[8 : 8 + int.from_bytes(data[4:8], "little")]
        opener = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(trained))
        at = 0
        while at < len(data):
            end = warc.frame_end(data, at)
            if data[at : at + 4] == b"\x28\xb5\x2f\xfd":
                one = opener.decompress(data[at:end])
                assert one.startswith(b"WARC/1.1\r\n") and one.endswith(b"\r\n\r\n") and one.count(b"WARC-Record-ID") == 1
            else:
                assert not at or data[at:end] == warc.EMPTY.encode()
            at = end
    found = warc.read(spark, f"file://{tmp_path}/a").collect()
    assert len(found) == len(PAGES) + 400 and all(r.error is None for r in found)
    by = {r.page_id: r for r in found if r.page_id and r.record_type == "response"}
    for page, url, html in PAGES:
        if page is not None and str(page) in by and page not in (3,):
            r = by[str(page)]
            assert bytes(r.payload).decode() == (html or "") and r.payload_bytes == len((html or "").encode())
            if url and "\r" not in url:
                assert r.url == url
    assert next(r for r in found if r.page_id == "9").url == "http://a/9?x=ä%20b%0D%0AX:%20y"
    assert {r.payload for r in found if r.record_type == "revisit"} == {None}


def test_joined_without_broadcast(spark, folder):
    pages = spark.read.parquet(f"file://{folder}/pages.parquet")
    again = warc.repeated(pages)
    rows = lambda **k: sorted(map(str, warc.classified(pages, again, **k).collect()))
    assert rows(broadcast=0) == rows()


def test_ids_of_text_and_empty_tables(spark, tmp_path):
    rows = [("a:b>", "u", LONG), ("", "v", LONG), (None, "w", LONG), ("=x", "v", "short")]
    warc.write(spark.createDataFrame(rows, "name string, at string, body string"), f"file://{tmp_path}/a", id_col="name", url_col="at", text_col="body")
    found = {(r.page_id, r.record_type, r.refers_to) for r in warc.read(spark, f"file://{tmp_path}/a").collect()}
    assert found == {("a:b>", "revisit", ""), ("", "response", None), (None, "revisit", ""), ("=x", "response", None)}
    spark.createDataFrame([], "page_id long, url string, html string").write.parquet(f"file://{tmp_path}/e/pages.parquet")
    assert warc.query(spark, f"file://{tmp_path}/e").count() == 0


def good(page="1", html=LONG):
    return warc.record(page, "http://a", html, hashlib.sha256(html.encode()).hexdigest(), None)


def packed(*texts, level=3):
    return b"".join(zstandard.ZstdCompressor(level=level, write_checksum=True).compress(t) for t in texts)


@pytest.mark.parametrize(
    "change",
    [
        lambda r: r.replace(b"WARC/1.1", b"WARC/7"),
        lambda r: r.replace(b"WARC-Date: ", b"Date: "),
        lambda r: r.replace(b"WARC-Record-ID: ", b"X: "),
        lambda r: r.replace(b"qual payload", b"qual PAYLOAD", 1),
        lambda r: r.replace(b"</p>", b"", 1),
        lambda r: r[:-2],
        lambda r: r + r,
        lambda r: r.replace(b"Content-Type: text/html; charset=utf-8\r\nContent-Length", b"Content-Type: text/html; charset=utf-8\r\nContent-Lengxx"),
        lambda r: b"",
    ],
)
def test_broken_records(change):
    """A broken record is told, those around it are read."""
    rows = [*warc.records(packed(good("1"), change(good("2")), good("3")))]
    assert [r.get("page_id") for r in rows] == ["1", None, "3"] and "error" in rows[1] and "error" not in rows[0] | rows[2]


def test_broken_frames():
    one = packed(good("1"))
    for bad in (one[: len(one) // 2], b"nonsense", one[:5], b"\x50\x2a\x4d\x18\xff\xff\xff\xff"):
        rows = [*warc.records(one + bad)]
        assert rows[0]["page_id"] == "1" and "error" in rows[1] and len(rows) == 2
    spoilt = bytearray(one)
    spoilt[-1] ^= 1  # the checksum
    rows = [*warc.records(bytes(spoilt) + one)]
    assert "error" in rows[0] and rows[1]["page_id"] == "1"


def test_archives_of_others():
    """No dictionary, a compressed dictionary, other records, other digests, streams without a content size, incompressible and constant blocks."""
    import base64
    import os

    trained = zstandard.train_dictionary(4096, [good(str(k), f"page {k} " * 30 + LONG) for k in range(300)])
    inside = zstandard.ZstdCompressor(dict_data=trained).compress(good("4"))
    for content in (trained.as_bytes(), zstandard.ZstdCompressor().compress(trained.as_bytes())):
        data = b"\x5d\x2a\x4d\x18" + len(content).to_bytes(4, "little") + content + inside
        assert [r["page_id"] for r in warc.records(data)] == ["4"]
    info = b"WARC/1.0\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: <urn:uuid:1>\r\nWARC-Date: 2020-01-01T00:00:00Z\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"
    body = b"HTTP/1.1 200 OK\r\nContent-Length: 5\r\n\r\nhello"
    sha1 = base64.b32encode(hashlib.sha1(b"hello").digest())
    answer = b"WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:uuid:2>\r\nWARC-Date: x\r\nWARC-Payload-Digest: sha1:%s\r\nContent-Length: %d\r\n\r\n%s\r\n\r\n" % (sha1, len(body), body)
    stream = zstandard.ZstdCompressor().compressobj()
    rows = [*warc.records(stream.compress(info) + stream.flush() + packed(answer))]
    assert [(r["record_type"], r["page_id"], bytes(r["payload"])) for r in rows] == [("warcinfo", "<urn:uuid:1>", b"abc"), ("response", "<urn:uuid:2>", b"hello")]
    rows = [*warc.records(packed(answer.replace(b"hello", b"jello")))]
    assert "error" in rows[0]
    for html in (os.urandom(300_000).hex(), "\x00" * 1_000_000):
        assert [r["payload"].decode() == html for r in warc.records(packed(good("7", html), level=1))] == [True]
