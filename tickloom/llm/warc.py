"""Web archives: a record for each page, compressed one by one with a dictionary made from the archive's own records.

An archive is a file of frames (``.warc.zst``): first a skippable frame that holds the dictionary, then a
Zstandard frame for each WARC 1.1 record. Its records are gathered up to a bound, the dictionary is trained on
all of them, and they are written; so each archive can be read alone, and each record too, from its place in
the index. Archives of too few records to train on have no dictionary frame, which the format allows.

A page whose payload another page has is a revisit: of pages with equal payloads of at least ``LEAST`` bytes
the one with the smallest id is the response. Digests decide, counted by Spark; bodies move only if more payloads
repeat than can be sent to all tasks.

Executors may be lost: an archive's name is new for every attempt, and the index, a table that Spark
commits, says which archives count; readers go by it, and ``vacuum`` deletes what failed attempts left.

Defined cases: a null or empty html is a payload of no bytes; a null url is a record without a target; line breaks,
blanks and other control characters of a url are percent-encoded, so they can't end a header; a null id stands after all others when
the response is chosen, and its record carries none; pages that repeat both payload and smallest id are all
responses; a page larger than an archive's bound is an archive with its neighbours before it; no pages give no archives; other columns are
not read.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SMALL, materialize, scratch, table

#: Payloads under so many bytes are never revisits.
LEAST = 100
#: Bytes of records gathered for one archive.
ARCHIVE = 16 << 20
#: Bytes of a dictionary, and of what it is trained on at least.
DICTIONARY, TRAINABLE = 64 << 10, 1 << 16
#: Fixed values of the format: the skippable frame's mark, and the profile of a revisit.
SKIPPABLE = 0x184D2A5D
SAME_PAYLOAD = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

INDEX = "page_id long, archive string, at long, length long, record_type string, payload_digest string"
RECORD = "archive string, at long, record_id string, record_type string, page_id long, target string, date string, payload_digest string, payload_bytes long, refers_to long, refers_to_id string, payload binary"


# ---- one record


def record_id(digest: str, page_id: int | None) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{digest}/{page_id}')}>"


def safe_target(url: str) -> str:
    return "".join(c if c > " " and c != "\x7f" else f"%{ord(c):02X}" for c in url)


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, first: int | None, revisit: bool, date: str) -> bytes:
    """A response with its payload, or a revisit with the headers of the answer alone."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {record_id(digest, page_id)}", f"WARC-Date: {date}"]
    if url is not None:
        head.append(f"WARC-Target-URI: {safe_target(url)}")
    if page_id is not None:
        head.append(f"Page-Number: {page_id}")
    head.append(f"WARC-Payload-Digest: sha256:{digest}")
    if revisit:
        head += [f"WARC-Profile: {SAME_PAYLOAD}", f"WARC-Refers-To: {record_id(digest, first)}", f"Refers-To-Page-Number: {first}"]
    head += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _fields(head: bytes) -> dict[str, str]:
    lines = head.decode().split("\r\n")
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:] if x)}


def parse(data: bytes) -> dict:
    """The fields of ``RECORD`` from one record; a payload that doesn't have its digest is refused."""
    head, _, rest = data.partition(b"\r\n\r\n")
    f = _fields(head)
    if not head.startswith(b"WARC/1.") or len(rest) != int(f["content-length"]) + 4 or not rest.endswith(b"\r\n\r\n"):
        raise ValueError(f"no whole record: {head[:80]!r}")
    http, _, payload = rest[:-4].partition(b"\r\n\r\n")
    n = int(_fields(http)["content-length"])
    kind, digest = f["warc-type"], f["warc-payload-digest"].removeprefix("sha256:")
    if kind == "response" and (len(payload) != n or hashlib.sha256(payload).hexdigest() != digest):
        raise ValueError(f"record {f['warc-record-id']}: the payload isn't that of its digest")
    number = lambda k: int(f[k]) if k in f else None
    return {
        "record_id": f["warc-record-id"], "record_type": kind, "page_id": number("page-number"), "target": f.get("warc-target-uri"), "date": f["warc-date"], "payload_digest": digest, "payload_bytes": n,
        "refers_to": number("refers-to-page-number"), "refers_to_id": f.get("warc-refers-to"), "payload": payload if kind == "response" else None,
    }


# ---- one archive


def train(records: list[bytes]) -> bytes:
    """A dictionary from all records of an archive; none if they are too few or too small."""
    if len(records) < 8 or sum(map(len, records)) < TRAINABLE:
        return b""
    try:
        size = min(DICTIONARY, sum(map(len, records)) // 16)
        return zstandard.train_dictionary(size, records, d=8, k=256, steps=1, f=18, accel=4).as_bytes()
    except zstandard.ZstdError:  # records with nothing in common
        return b""


def frames(records: list[bytes], level: int = 3) -> tuple[bytes, list[bytes]]:
    """The leading frame with the dictionary (empty without one), and a frame for each record."""
    words = train(records)
    lead = struct.pack("<II", SKIPPABLE, len(words)) + words if words else b""
    known = zstandard.ZstdCompressionDict(words) if words else None
    squeeze = zstandard.ZstdCompressor(level=level, dict_data=known, write_content_size=True, write_checksum=True)
    return lead, [squeeze.compress(r) for r in records]


def dictionary(file) -> zstandard.ZstdCompressionDict | None:
    """The dictionary in front of an open archive, which is then at its first record."""
    mark = file.read(8)
    if len(mark) == 8:
        kind, size = struct.unpack("<II", mark)
        if kind == SKIPPABLE:
            return zstandard.ZstdCompressionDict(file.read(size))
    file.seek(0)
    return None


def read_frames(file, piece: int = 1 << 20) -> Iterator[tuple[int, bytes]]:
    """(place, record) of each record of an open archive, one in memory at a time."""
    words = dictionary(file)
    expand = zstandard.ZstdDecompressor(dict_data=words) if words else zstandard.ZstdDecompressor()
    at, held = file.tell(), b""
    while held or (held := file.read(piece)):
        one, parts, used = expand.decompressobj(), [], 0
        while True:
            parts.append(one.decompress(held))
            used += len(held) - len(one.unused_data)
            if one.eof:
                held = one.unused_data
                break
            held = file.read(piece)
            if not held:
                raise ValueError("the archive ends within a record")
        yield at, b"".join(parts)
        at += used


# ---- jobs


def _store(path: str) -> tuple[pafs.FileSystem, str]:
    """File system and folder of a path, as any executor can open them."""
    return pafs.FileSystem.from_uri("file:///" + path[6:] if path.startswith("file:/") and not path.startswith("file://") else path)


def revisits(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, url, html, digest, first, revisit): first is the id of the response among pages with an equal payload."""
    html = F.coalesce(F.col(f"`{html_col}`"), F.lit(""))
    whole = pages.select(F.col(f"`{id_col}`").cast("long").alias("page_id"), F.col(f"`{url_col}`").alias("url"), html.alias("html"), F.sha2(html, 256).alias("digest"))
    counted = whole.where(F.octet_length("html") >= LEAST).groupBy("digest").agg(F.count("*").alias("n"), F.min("page_id").alias("first")).where("n > 1 and first is not null")
    repeated = materialize(counted, "repeated-payloads")
    if repeated.limit(SMALL + 1).count() <= SMALL:
        found = whole.join(F.broadcast(repeated.drop("n")), "digest", "left")
    else:
        # payloads that more than a thousandth of all pages have are fewer than a thousand: to all tasks; the rest meets
        # in a shuffle, where payloads too short to be revisits get keys of their own
        total = pages.count()
        hot = F.broadcast(repeated.where(F.col("n") * 1000 > total).drop("n"))
        rest = repeated.where(F.col("n") * 1000 <= total).select(F.col("digest").alias("key"), "first")
        key = F.when(F.octet_length("html") >= LEAST, F.col("digest")).otherwise(F.concat(F.lit("-"), F.monotonically_increasing_id()))
        cold = whole.join(hot.select("digest"), "digest", "left_anti").withColumn("key", key).join(rest, "key", "left").drop("key")
        found = whole.join(hot, "digest").unionByName(cold.select("digest", "page_id", "url", "html", "first"))
    again = (F.octet_length("html") >= LEAST) & F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    return found.select("page_id", "url", F.encode("html", "UTF-8").alias("html"), "digest", "first", again.alias("revisit"))


def write_archives(pages: DataFrame, path: str, date: str = "1970-01-01T00:00:00Z", id_col: str = "page_id", url_col: str = "url", html_col: str = "html", archive: int = ARCHIVE) -> DataFrame:
    """Write archives and their index (``INDEX``) into a shared folder; returns the index."""
    spark = pages.sparkSession
    names = [x.split()[0] for x in INDEX.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]):
        store, folder = _store(path)
        store.create_dir(f"{folder}/archives")
        records, rows, size = [], [], 0

        def close():
            lead, compressed = frames(records)
            name = f"{uuid.uuid4().hex}.warc.zst"  # never the name of another attempt
            at, places = len(lead), []
            with store.open_output_stream(f"{folder}/archives/{name}", compression=None) as out:
                out.write(lead)
                for frame in compressed:
                    out.write(frame)
                    places.append((at, len(frame)))
                    at += len(frame)
            columns = zip(*((page, name, a, n, "revisit" if again else "response", digest) for (page, digest, again), (a, n) in zip(rows, places)))
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)

        for batch in batches:
            for i in range(batch.num_rows):
                page, url, html, digest, first, again = (c[i].as_py() for c in batch.columns)
                records.append(record(page, url, html, digest, first, again, date))
                rows.append((page, digest, again))
                size += len(records[-1])
                if size >= archive:
                    yield close()
                    records, rows, size = [], [], 0
        if records:
            yield close()

    found = revisits(pages, id_col, url_col, html_col)
    found.mapInArrow(run, INDEX).write.option("compression", "zstd").parquet(f"{path}/index")
    return read_index(spark, path)


def read_index(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(INDEX).parquet(f"{path}/index")


def vacuum(spark: SparkSession, path: str) -> int:
    """Delete archives that the index doesn't name, as failed attempts leave them; returns how many. Not while a writer runs."""
    store, folder = _store(path)
    there = spark.createDataFrame([(f.base_name,) for f in store.get_file_info(pafs.FileSelector(f"{folder}/archives", allow_not_found=True))], "archive string")
    lost = [r.archive for r in there.join(read_index(spark, path).select("archive").distinct(), "archive", "left_anti").collect()]
    for name in lost:
        store.delete_file(f"{folder}/archives/{name}")
    return len(lost)


def _rows(found: list[dict]) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}
    fields = [x.split() for x in RECORD.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([r[c] for r in found], kinds[k]) for c, k in fields], names=[c for c, _ in fields])


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """All records (``RECORD``) of the archives in the index, each archive read in one go by a task."""

    def run(batches: Iterator[pa.RecordBatch]):
        store, folder = _store(path)
        for batch in batches:
            for name in batch.column(0).to_pylist():
                found, size = [], 0
                with store.open_input_file(f"{folder}/archives/{name}") as file:
                    for at, data in read_frames(file):
                        found.append({"archive": name, "at": at} | parse(data))
                        size += len(data)
                        if size >= 1 << 22:
                            yield _rows(found)
                            found, size = [], 0
                if found:
                    yield _rows(found)

    archives = read_index(spark, path).groupBy("archive").agg(F.max("at").alias("at"))
    return archives.select("archive").mapInArrow(run, RECORD)


def fetch(wanted: DataFrame, path: str) -> DataFrame:
    """Records of some rows of the index, each read alone from its place; a dictionary is read once for each archive and task."""

    def run(batches: Iterator[pa.RecordBatch]):
        store, folder = _store(path)
        name, file, expand = None, None, None
        for batch in batches:
            for one, at, length in zip(*(batch.column(i).to_pylist() for i in range(3))):
                if one != name:
                    if file:
                        file.close()
                    name, file = one, store.open_input_file(f"{folder}/archives/{one}")
                    words = dictionary(file)
                    expand = zstandard.ZstdDecompressor(dict_data=words) if words else zstandard.ZstdDecompressor()
                file.seek(at)
                yield _rows([{"archive": one, "at": at} | parse(expand.decompress(file.read(length)))])
        if file:
            file.close()

    return wanted.select("archive", "at", "length").repartition("archive").sortWithinPartitions("archive", "at").mapInArrow(run, RECORD)


def resolve(records: DataFrame) -> DataFrame:
    """``records`` with the payload of each revisit, from the response that it refers to."""
    whole = records.where("record_type = 'response'").select(F.col("record_id").alias("__id"), F.col("payload").alias("__payload"))
    again = records.where("record_type = 'revisit'").join(whole.dropDuplicates(["__id"]), F.col("refers_to_id") == F.col("__id"), "left")
    return records.where("record_type = 'response'").unionByName(again.withColumn("payload", F.col("__payload")).drop("__id", "__payload"))


def op11_warc_archives(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, "warc")
    write_archives(table(spark, sf_dir, "pages"), path)
    return read_archives(spark, path).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


SQL = """WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
 f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first FROM p)
 SELECT page_id, payload_bytes, payload_digest, CASE WHEN payload_bytes >= 100 AND first IS NOT NULL AND page_id IS DISTINCT FROM first THEN 'revisit' ELSE 'response' END AS record_type,
 CASE WHEN payload_bytes >= 100 AND page_id IS DISTINCT FROM first THEN first END AS refers_to FROM f"""

QUERIES = {"op11_warc_archives": op11_warc_archives}
ORACLE: dict[str, str] = {"op11_warc_archives": SQL}
