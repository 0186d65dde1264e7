"""WARC archives with one Zstandard frame for each record: written from a table of pages, read back and checked.

An archive starts with a skippable frame that holds a dictionary, trained on a
bounded sample of the pages (SAMPLE different pages at most, PART characters of
each; pages are chosen by hash). Each record then is a frame of its own. Spark's text writer
writes the frames as they are; its line separator is an empty skippable frame,
which readers pass over, so files are committed as any Spark output is. A
partition's pages are one archive.

`read` takes any archives: it finds frames by their block headers, loads the
dictionary (plain or compressed) of each archive's first frame, decodes one
frame at a time and checks version line, mandatory fields, Content-Length, the
end of the record and, for responses, length and digest of the payload. A
record that fails has its `error` and no other value; after a frame that is cut
off the archive can't be read on, which is one such row. Archives are read
whole, a task each, so they should have some hundred MB at most.

Defined results: a null text is an empty payload; equal payloads of LEAST bytes
or more are revisits of the smallest page id (null ids come last; rows that
share the smallest id are responses, all of them); a null url has no
WARC-Target-URI; ids of any type, which `read` returns as text; other columns
are neither read nor written.
"""

from __future__ import annotations

import base64
import hashlib
import re
from urllib.parse import quote_from_bytes, unquote

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, functions as F

from .common import forget, shared_dir, stored

LEAST = 100
SAMPLE, PART, DICTIONARY = 1000, 16_384, 65_536
BROADCAST = 1 << 20  # digests of repeated payloads that are broadcast at most
LEVEL, FLUSH = 6, 1 << 22
# Formats of Zstandard frames and WARC fields.
FRAME, NAMED, SKIPPED = 0xFD2FB528, 0x184D2A5D, 0x184D2A50
EMPTY = "P*M\x18\x00\x00\x00\x00"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "1970-01-01T00:00:00Z"
FIELDS = ("warc-type", "warc-record-id", "warc-date", "content-length")
ROW = "archive string, page_id string, payload binary, payload_bytes long, payload_digest string, record_type string, refers_to string, url string, error string"


def dictionary(pages: DataFrame, text_col="html") -> bytes:
    """A dictionary for pages like these; empty where there are too few to learn one. Only pages with a small hash, about twice as many as are taken, are compared, so tasks send few."""
    part = pages.select(F.substring(F.coalesce(text_col, F.lit("")), 1, PART).alias("part")).withColumn("hash", F.xxhash64("part"))
    share = min(1.0, 2 * SAMPLE / max(1, pages.count()))
    few = part.filter(F.pmod("hash", F.lit(1 << 20)) <= share * (1 << 20)).distinct()
    samples = [r.part.encode() for r in few.orderBy("hash", "part").limit(SAMPLE).collect() if r.part]
    try:
        return zstandard.train_dictionary(DICTIONARY, samples).as_bytes()
    except zstandard.ZstdError:
        return b""


def repeated(pages: DataFrame, *, id_col="page_id", text_col="html", least: int = LEAST) -> DataFrame:
    """Stored: digest, first (smallest page id) of payloads that occur more than once."""
    html = F.coalesce(F.col(text_col), F.lit(""))
    long = pages.filter(F.octet_length(html) >= least).select(F.sha2(html, 256).alias("digest"), F.col(id_col).alias("own"))
    return stored(long.groupBy("digest").agg(F.min("own").alias("first"), F.count("*").alias("n")).filter("n > 1").select("digest", "first"), "warc-repeated")


def classified(pages: DataFrame, again: DataFrame, *, id_col="page_id", url_col="url", text_col="html", broadcast: int = BROADCAST) -> DataFrame:
    """page_id, url, html, digest, refers_to: null for responses, else the page whose payload a record repeats."""
    html = F.coalesce(F.col(text_col), F.lit(""))
    rows = pages.select(F.col(id_col).cast("string").alias("page_id"), F.col(id_col).alias("own"), F.col(url_col).alias("url"), html.alias("html"), F.sha2(html, 256).alias("digest"))
    known = again.hint("broadcast" if again.count() <= broadcast else "merge")
    refers = F.when(~F.col("first").eqNullSafe(F.col("own")), F.col("first").cast("string"))
    return rows.join(known, "digest", "left").select("page_id", "url", "html", "digest", refers.alias("refers_to"))


def _id(page: str | None, digest: str) -> bytes:
    """A record's URN; a null page has none of the sign before it."""
    return b"<urn:x-page:%s:%s>" % (b"" if page is None else b"=" + quote_from_bytes(page.encode(), safe="").encode(), digest.encode())


def record(page: str | None, url: str | None, html: str, digest: str, refers_to: str | None) -> bytes:
    payload = html.encode()
    head = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    fields = [b"WARC/1.1", b"WARC-Type: " + (b"revisit" if refers_to is not None else b"response"), b"WARC-Record-ID: " + _id(page, digest), b"WARC-Date: " + DATE.encode()]
    if url is not None:
        fields.append(b"WARC-Target-URI: " + re.sub(rb"[\x00-\x20\x7f]", lambda m: b"%%%02X" % m[0][0], url.encode()))
    if refers_to is not None:
        fields += [b"WARC-Refers-To: " + _id(refers_to, digest), b"WARC-Profile: " + PROFILE.encode()]
    block = head if refers_to is not None else head + payload
    fields += [b"WARC-Payload-Digest: sha256:" + digest.encode(), b"Content-Type: application/http;msgtype=response", b"Content-Length: %d" % len(block)]
    return b"\r\n".join(fields) + b"\r\n\r\n" + block + b"\r\n\r\n"


def _writer(trained: bytes):
    def frames(batches):
        known = {"dict_data": zstandard.ZstdCompressionDict(trained)} if trained else {}
        packer, out, size, begun = zstandard.ZstdCompressor(level=LEVEL, write_checksum=True, **known), [], 0, not trained
        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "html", "digest", "refers_to"))):
                if not begun:
                    out.append(NAMED.to_bytes(4, "little") + len(trained).to_bytes(4, "little") + trained)
                    begun = True
                out.append(packer.compress(record(*row)))
                size += len(out[-1])
                if size >= FLUSH:
                    yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["frame"])
                    out, size = [], 0
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["frame"])

    return frames


def write(pages: DataFrame, path: str, *, id_col="page_id", url_col="url", text_col="html", least: int = LEAST, trained: bytes | None = None) -> None:
    """A record for each row of `pages`, in archives under `path`."""
    trained = dictionary(pages, text_col) if trained is None else trained
    again = repeated(pages, id_col=id_col, text_col=text_col, least=least)
    records = classified(pages, again, id_col=id_col, url_col=url_col, text_col=text_col)
    # Spark's text writer writes a string's bytes as they are
    records.mapInArrow(_writer(trained), "frame binary").select(F.col("frame").cast("string")).write.option("lineSep", EMPTY).text(path)
    forget(again)


def frame_end(data, at: int) -> int:
    """Where the frame at `at` ends; ValueError if it is none, or cut off."""
    magic = int.from_bytes(data[at : at + 4], "little")
    if magic & 0xFFFFFFF0 == SKIPPED:
        end = at + 8 + int.from_bytes(data[at + 4 : at + 8], "little")
    elif magic == FRAME and at + 4 < len(data):
        flags = data[at + 4]
        single = flags >> 5 & 1
        content = (1 if single else 0, 2, 4, 8)[flags >> 6]
        end, last = at + 5 + (not single) + (0, 1, 2, 4)[flags & 3] + content, False
        while not last and end + 3 <= len(data):
            block = int.from_bytes(data[end : end + 3], "little")
            last, kind = block & 1, block >> 1 & 3
            end += 3 + (1 if kind == 1 else block >> 3)
        end += 4 * (flags >> 2 & 1)
        if not last:
            raise ValueError("a frame is cut off")
    else:
        raise ValueError("no Zstandard frame")
    if end > len(data):
        raise ValueError("a frame is cut off")
    return end


def _fields(head: bytes) -> dict:
    out = {}
    for line in head.split(b"\r\n")[1:]:
        name, colon, value = line.partition(b":")
        if not colon:
            raise ValueError("a header line without a colon")
        out[name.strip().lower().decode()] = value.strip().decode()
    return out


def _page(urn: str) -> str | None:
    found = re.fullmatch(r"<urn:x-page:(=?)([^:]*):[0-9a-f]*>", urn)
    if not found:
        return urn
    return unquote(found[2]) if found[1] else None


def agrees(digest: str, payload: bytes) -> bool:
    """Whether a digest, `sha256:` or `sha1:` in hex or base32, is the payload's; one by another method, or none, isn't held against it."""
    method, _, value = digest.partition(":")
    if method not in ("sha256", "sha1"):
        return True
    found = hashlib.new(method, payload)
    return value in (found.hexdigest(), base64.b32encode(found.digest()).decode(), base64.b32encode(found.digest()).decode().rstrip("="))


def parsed(data: bytes) -> dict:
    """What a record says, checked; ValueError where it breaks a rule."""
    head, there, rest = data.partition(b"\r\n\r\n")
    if not there or not re.match(rb"WARC/1\.[01]\r\n", head):
        raise ValueError("no WARC header")
    own = _fields(head)
    if lacks := [k for k in FIELDS if k not in own]:
        raise ValueError(f"no {lacks[0]}")
    size = own["content-length"]
    if not size.isdecimal() or int(size) != len(rest) - 4 or rest[-4:] != b"\r\n\r\n":
        raise ValueError("Content-Length isn't the block's length")
    kind, block, digest = own["warc-type"], rest[:-4], own.get("warc-payload-digest", "")
    out = {"page_id": _page(own["warc-record-id"]), "record_type": kind, "url": own.get("warc-target-uri")}
    if kind not in ("response", "revisit"):
        return out | {"payload": block, "payload_bytes": len(block), "payload_digest": hashlib.sha256(block).hexdigest()}
    http, there, payload = block.partition(b"\r\n\r\n")
    length = _fields(http).get("content-length", "") if there and http.startswith(b"HTTP/") else ""
    if not length.isdecimal():
        raise ValueError("no HTTP header with the payload's length")
    if kind == "response":
        if int(length) != len(payload) or not agrees(digest, payload):
            raise ValueError("length or digest isn't the payload's")
        return out | {"payload": payload, "payload_bytes": len(payload), "payload_digest": hashlib.sha256(payload).hexdigest()}
    if payload or "warc-refers-to" not in own or own.get("warc-profile") != PROFILE:
        raise ValueError("a revisit with a payload, without profile or reference")
    return out | {"payload_bytes": int(length), "payload_digest": digest.removeprefix("sha256:"), "refers_to": _page(own["warc-refers-to"])}


def records(data: bytes):
    """The records of an archive, in order, each with what is wrong with it."""
    at, opener = 0, zstandard.ZstdDecompressor()
    while at < len(data):
        try:
            end = frame_end(data, at)
        except ValueError as wrong:
            yield {"error": f"at byte {at}: {wrong}"}
            return
        frame = data[at:end]
        magic = int.from_bytes(frame[:4], "little")
        try:
            if magic == FRAME:
                yield parsed(opener.decompressobj().decompress(frame))
            elif magic == NAMED and not at:
                trained = frame[8:]
                if int.from_bytes(trained[:4], "little") == FRAME:
                    trained = opener.decompressobj().decompress(trained)
                opener = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(trained))
        except (ValueError, zstandard.ZstdError) as wrong:
            yield {"error": f"at byte {at}: {wrong}"}
        at = end


def _reader(payloads: bool):
    kinds = [pa.string(), pa.string(), pa.binary(), pa.int64(), *[pa.string()] * 5]
    names = [x.split()[0] for x in ROW.split(", ")]

    def rows(batches):
        for batch in batches:
            for archive, data in zip(batch.column("path"), batch.column("content")):
                out, size = [], 0
                for found in records(data.as_py()):
                    size += len(found.get("payload") or b"") + 500
                    out.append(found | ({} if payloads else {"payload": None}) | {"archive": archive.as_py()})
                    if size >= FLUSH:
                        yield pa.RecordBatch.from_arrays([pa.array([x.get(c) for x in out], kind) for c, kind in zip(names, kinds)], names)
                        out, size = [], 0
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array([x.get(c) for x in out], kind) for c, kind in zip(names, kinds)], names)

    return rows


def read(spark, path: str, *, payloads: bool = True) -> DataFrame:
    """The records of all archives under `path`: ROW. Without `payloads` these are checked, but not returned."""
    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(_reader(payloads), ROW)


def query(spark, sf_dir: str) -> DataFrame:
    import uuid

    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    path = f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    write(pages, path)
    found, kind = read(spark, path, payloads=False), pages.schema["page_id"].dataType
    page = F.when(F.col("error").isNotNull(), F.raise_error(F.col("error"))).otherwise(F.col("page_id"))
    return found.select(page.cast(kind).alias("page_id"), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast(kind).alias("refers_to"))


SQL = """
WITH p AS (SELECT page_id, strlen(coalesce(html, ''))::BIGINT AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
f AS (SELECT payload_digest, min(page_id) AS first FROM p WHERE payload_bytes >= 100 GROUP BY payload_digest)
SELECT page_id, payload_bytes, p.payload_digest, CASE WHEN page_id IS DISTINCT FROM coalesce(first, page_id) THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN page_id IS DISTINCT FROM coalesce(first, page_id) THEN first END AS refers_to
FROM p LEFT JOIN f ON p.payload_digest = f.payload_digest
"""
