"""Zstandard WARC archives: a writer and a reader.

An archive begins with a skippable frame (magic number 0x184D2A5D) that holds its dictionary, itself a
compressed frame or plain; then each record is one frame, compressed with the dictionary. The reader loads the
dictionary, decodes frame by frame, and checks the version line, the required headers, the content length, the
closing bytes and the payload digest of each record; what is wrong with a record is reported in its row.

write_archives() makes archives of bounded size as rows (archive, content); read_archives() takes such rows,
or those of Spark's binaryFile source, so archives can live in any store that Spark reads. Of records with
equal payloads from MIN_REVISIT bytes on, the one with the smallest id is a response, others are revisits with
its id and the digest. Only digests and ids are shuffled for that, minima pre-aggregated.

Defined cases: null html is an empty payload; null url is `about:blank`, and characters that would break a
header line are percent-encoded; payloads of any length are whole; one id may have several payloads, which are
judged each by its own; rows that repeat an id and its payload are equal records, all of the kind that the id has
for this payload; a null id stands after all others (with equal payloads that have no other id, each is a
response); an empty table gives no archive and an empty table; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
import struct

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_limits, settle

MAGIC_SKIP, MAGIC_FRAME = 0x184D2A5D, 0xFD2FB528
MIN_REVISIT = 100
#: An archive holds about this many bytes before compression; its dictionary is trained on at most SAMPLES payloads of it, SAMPLE bytes of each.
ARCHIVE, SAMPLES, SAMPLE, DICTIONARY = 8 << 20, 200, 8192, 16 << 10
DATE = "2000-01-01T00:00:00Z"
REQUIRED = ("WARC-Type", "WARC-Record-ID", "WARC-Date", "Content-Length")
END = b"\r\n\r\n"


def _id(n: int | None) -> str:
    return f"<urn:hearthlog:page:{'' if n is None else n}>"


def _url(url: str | None) -> str:
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url) if url else "about:blank"


def record(page: int | None, url: str | None, payload: bytes, digest: str, refers: int | None) -> bytes:
    """A response, or a revisit without its payload."""
    kind = "response" if refers is None else "revisit"
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    if refers is None:
        block += payload
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {_id(page)}", f"WARC-Date: {DATE}", f"WARC-Target-URI: {_url(url)}", f"WARC-Payload-Digest: sha256:{digest}", "Content-Type: application/http; msgtype=response"]
    if refers is not None:
        head += [f"WARC-Refers-To: {_id(refers)}", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    else:
        head.append(f"WARC-Block-Digest: sha256:{hashlib.sha256(block).hexdigest()}")
    head.append(f"Content-Length: {len(block)}")
    return "\r\n".join(head).encode() + END + block + END


def archive(records: list[bytes]) -> bytes:
    import zstandard

    samples = [r[:SAMPLE] for r in records[:: max(1, len(records) // SAMPLES)]][:SAMPLES]
    try:
        words = zstandard.train_dictionary(min(DICTIONARY, sum(map(len, samples)) // 8 + 256), samples).as_bytes()
    except zstandard.ZstdError:  # too few or too small samples for a trained one: plain content
        words = samples[0][:DICTIONARY]
    packed = zstandard.ZstdCompressor(level=3).compress(words)
    press = zstandard.ZstdCompressor(level=3, dict_data=zstandard.ZstdCompressionDict(words), write_checksum=True)
    return struct.pack("<II", MAGIC_SKIP, len(packed)) + packed + b"".join(press.compress(r) for r in records)


def frames(content: bytes):
    """Each record's bytes; stops with an error message at bytes that are no frame."""
    import zstandard

    words, at = None, 0
    if content[:4] == struct.pack("<I", MAGIC_SKIP):
        (n,) = struct.unpack_from("<I", content, 4)
        raw, at = content[8 : 8 + n], 8 + n
        if len(raw) < n:
            yield None, "dictionary is cut off"
            return
        words = zstandard.ZstdDecompressor().decompress(raw) if raw[:4] == struct.pack("<I", MAGIC_FRAME) else raw
    reader = zstandard.ZstdDecompressor(**({"dict_data": zstandard.ZstdCompressionDict(words)} if words else {}))
    view = memoryview(content)
    number = lambda k: struct.unpack("<I", view[k : k + 4].tobytes().ljust(4, b"\0"))[0]
    while at < len(content):
        if 0x184D2A50 <= number(at) <= 0x184D2A5F:
            at += 8 + number(at + 4)
            continue
        # a frame is given in growing steps, so that what lies behind it is looked at once, not once a record
        one, data, fed, step = reader.decompressobj(), [], at, 1 << 12
        try:
            while not one.eof and fed < len(content):
                data.append(one.decompress(view[fed : fed + step]))
                fed, step = min(len(content), fed + step), min(2 * step, 1 << 20)
        except zstandard.ZstdError as e:
            yield None, f"frame at {at}: {e}"
            return
        if not one.eof:
            yield None, f"frame at {at} is cut off"
            return
        at = fed - len(one.unused_data)
        yield b"".join(data), ""


def parse(data: bytes) -> dict:
    """A record's fields; `error` is empty where it is valid."""
    out = {"record_type": None, "page_id": None, "url": None, "refers_to": None, "payload": None, "payload_bytes": None, "payload_digest": None, "error": ""}
    head, gap, rest = data.partition(END)
    lines = head.split(b"\r\n")
    if not gap or not re.fullmatch(rb"WARC/1\.[01]", lines[0]):
        return out | {"error": "no WARC version line"}
    fields = {}
    for line in lines[1:]:
        name, colon, value = line.decode("utf-8", "replace").partition(":")
        if not colon or not name.strip():
            return out | {"error": f"header line without a name: {line[:40]!r}"}
        fields.setdefault(name.strip().lower(), value.strip())
    missing = [n for n in REQUIRED if n.lower() not in fields]
    if missing:
        return out | {"error": f"without {', '.join(missing)}"}
    number = lambda v: int(m[1]) if (m := re.fullmatch(r"<urn:hearthlog:page:(-?\d+)>", v or "")) else None
    out |= {"record_type": fields["warc-type"], "page_id": number(fields["warc-record-id"]), "url": fields.get("warc-target-uri"), "refers_to": number(fields.get("warc-refers-to"))}
    if not fields["content-length"].isdigit():
        return out | {"error": "content length is no number"}
    n = int(fields["content-length"])
    if len(rest) != n + 4 or rest[n:] != END:
        return out | {"error": f"content length {n}, {len(rest) - 4} found"}
    block = rest[:n]
    if (want := fields.get("warc-block-digest")) and want != f"sha256:{hashlib.sha256(block).hexdigest()}":
        return out | {"error": "block digest differs"}
    http, gap, payload = block.partition(END)
    m = re.search(rb"(?im)^content-length:\s*(\d+)\s*$", http)
    said = fields.get("warc-payload-digest", "").removeprefix("sha256:")
    if out["record_type"] == "revisit":
        return out | {"payload_bytes": int(m[1]) if m else None, "payload_digest": said}
    if m and int(m[1]) != len(payload):
        return out | {"error": f"payload length {int(m[1])}, {len(payload)} found"}
    found = hashlib.sha256(payload).hexdigest()
    return out | {"payload": payload, "payload_bytes": len(payload), "payload_digest": found, "error": "" if said in ("", found) else "payload digest differs"}


def write_archives(pages: DataFrame) -> DataFrame:
    """(archive, content): the archives of pages (page_id, url, html)."""
    spark = pages.sparkSession
    arrow_limits(spark)
    body = F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary")
    ids = settle(pages.select("page_id", F.length(body).cast("long").alias("size"), F.sha2(body, 256).alias("digest")), "digests")
    first = ids.filter(F.col("size") >= MIN_REVISIT).groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).filter("n > 1").drop("n")
    later = ids.filter(F.col("size") >= MIN_REVISIT).join(first, "digest").filter("first is not null and not (page_id <=> first)")
    later = settle(later.select(F.col("page_id").alias("l_id"), F.col("digest").alias("l_digest"), "first").distinct(), "revisits")
    rows = pages.select("page_id", F.col("url").cast("string").alias("url"), body.alias("body"), F.sha2(body, 256).alias("digest"))
    rows = rows.join(later, F.col("page_id").eqNullSafe(F.col("l_id")) & (F.col("digest") == F.col("l_digest")), "left").select("page_id", "url", "body", "digest", "first")

    def run(batches):
        def put(records):
            content = archive(records)
            return pa.RecordBatch.from_pydict({"archive": [hashlib.sha256(content).hexdigest()[:32]], "content": [content]}, schema=pa.schema([("archive", pa.string()), ("content", pa.binary())]))

        records, size = [], 0
        for b in batches:
            for page, url, payload, digest, refers in zip(*(b.column(c).to_pylist() for c in ("page_id", "url", "body", "digest", "first"))):
                records.append(record(page, url, payload, digest, refers))
                size += len(records[-1])
                if size >= ARCHIVE:
                    yield put(records)
                    records, size = [], 0
        if records:
            yield put(records)

    return rows.mapInArrow(run, "archive string, content binary")


def read_archives(archives: DataFrame) -> DataFrame:
    """The records of archives (content binary): record_type, page_id, url, refers_to, payload, payload_bytes, payload_digest, error."""
    names = ["record_type", "page_id", "url", "refers_to", "payload", "payload_bytes", "payload_digest", "error"]
    kinds = [pa.string(), pa.int64(), pa.string(), pa.int64(), pa.binary(), pa.int64(), pa.string(), pa.string()]
    schema = pa.schema(list(zip(names, kinds)))

    def run(batches):
        for b in batches:
            for content in b.column("content"):
                rows, size = [], 0
                for data, error in frames(content.as_py() or b""):
                    rows.append(parse(data) if data is not None else dict.fromkeys(names) | {"error": error})
                    size += len(data or b"")
                    if size > 1 << 22:
                        yield pa.RecordBatch.from_pylist(rows, schema=schema)
                        rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema=schema)

    return archives.select("content").mapInArrow(run, "record_type string, page_id long, url string, refers_to long, payload binary, payload_bytes long, payload_digest string, error string")


def round_trip(pages: DataFrame) -> DataFrame:
    """pages written as archives and read back: page_id, payload_bytes, payload_digest, record_type, refers_to.

    A revisit's length is that of the response that it refers to, as decoded: the one of that id with its digest.
    """
    made = settle(write_archives(pages), "archives")
    found = settle(read_archives(made).drop("payload", "url"), "records")
    source = found.filter("record_type = 'response'").select(F.col("page_id").alias("r_id"), F.col("payload_bytes").alias("r_bytes"), F.col("payload_digest").alias("r_digest")).dropDuplicates(["r_id", "r_digest"])
    asked = found.filter("refers_to is not null").select(F.col("refers_to").alias("r_id"), F.col("payload_digest").alias("r_digest")).distinct()
    x = found.join(source.join(asked, ["r_id", "r_digest"], "left_semi"), (F.col("refers_to") == F.col("r_id")) & (F.col("payload_digest") == F.col("r_digest")), "left")
    error = F.when((F.col("record_type") == "revisit") & F.col("r_id").isNull(), "its response is not there").otherwise(F.col("error"))
    return x.select("page_id", F.coalesce("r_bytes", "payload_bytes").alias("payload_bytes"), "payload_digest", "record_type", "refers_to", error.alias("error"))
