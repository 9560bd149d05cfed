"""WARC archives: a writer with revisit records, and a splittable reader.

Archives are gzip files with one member for each record.  The reader's tasks are
byte ranges: a task searches its range for the gzip magic, takes a candidate as a
member if its start decodes to a WARC header and the bytes after it are again a
member or the end of the file, and then reads member after member; it owns the
records that start inside its range, wherever they end.  So archives of any size
are read in parallel without an index.

Files are reached through ``pyarrow.fs`` by URI, so the folder must be one that all
executors see.  A file is written under a name of its own attempt and then renamed,
so retried and speculative tasks leave one whole copy; the manifest holds the files
of successful attempts.  Equal payloads of at least ``least_bytes`` are stored once:
the record with the smallest page_id is the response, others revisit it.  Payloads
that can't repeat are written where they are read; only those whose digest passes a
sieve of repeated digests meet their response's page_id in a join.

Defined results: a null html is an empty payload; rows with equal payload and the
same smallest page_id are all responses; a null page_id is kept as null and never
referred to; page_ids may be of any type that Spark casts to text and back, or binary,
and come back as they were, as urls do; a very long page is one record, held in memory
by itself; an empty table gives no archive and
no rows.  Columns other than page_id, url and html are left out.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote, unquote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rowtide.llm.common import cut, sieve

MAGIC = b"\x1f\x8b\x08"
DATE = "2024-01-01T00:00:00Z"
CHUNK = 1 << 20
PAGE = "page_id {id}, payload_bytes long, payload_digest string, record_type string, refers_to {id}, url string, html string"


# --- records -------------------------------------------------------------------


def record_id(page_id: str | None, url: str | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id}/{digest}/{url}')}>"


def record(page_id: str | None, url: str | None, payload: bytes, digest: str, refers_to: str | None, first_url: str | None = None) -> bytes:
    """One gzip member with a response, or with a revisit of ``refers_to`` at ``first_url``; ids and the url are kept quoted as well."""
    revisit = refers_to is not None
    quoted = lambda x: quote(str(x), safe="") if x is not None else None
    address = lambda x: quote(x, safe=":/?#[]@!$&'()*+,;=%~") if x is not None else None
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if revisit else http + payload
    head = {
        "WARC-Type": "revisit" if revisit else "response",
        "WARC-Record-ID": record_id(page_id, url, digest),
        "WARC-Date": DATE,
        "WARC-Target-URI": address(url),
        "WARC-Payload-Digest": f"sha256:{digest}",
        "Content-Type": "application/http; msgtype=response",
        "X-Page-Id": quoted(page_id),
        "X-Payload-Length": len(payload),
        "X-Target-Quoted": quoted(url),
        "WARC-Profile": "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest" if revisit else None,
        "WARC-Refers-To": record_id(refers_to, first_url, digest) if revisit else None,
        "WARC-Refers-To-Target-URI": address(first_url) if revisit else None,
        "WARC-Refers-To-Date": DATE if revisit else None,
        "X-Refers-To-Page-Id": quoted(refers_to),
        "Content-Length": len(block),
    }
    lines = "".join(f"{k}: {v}\r\n" for k, v in head.items() if v is not None)
    pack = zlib.compressobj(6, zlib.DEFLATED, 31)
    return pack.compress(f"WARC/1.1\r\n{lines}\r\n".encode() + block + b"\r\n\r\n") + pack.flush()


def parse(data: bytes) -> tuple[dict[str, str], bytes]:
    """Headers and block of a decoded record."""
    head, _, rest = data.partition(b"\r\n\r\n")
    first, *lines = head.split(b"\r\n")
    if not first.startswith(b"WARC/1."):
        raise ValueError("no WARC record")
    fields = {k.strip().decode().lower(): v.strip().decode() for k, _, v in (x.partition(b":") for x in lines)}
    return fields, rest[: int(fields["content-length"])]


# --- writing -------------------------------------------------------------------


def open_folder(uri: str) -> tuple[fs.FileSystem, str]:
    system, path = fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")
    system.create_dir(path, recursive=True)
    return system, path


def id_text(column: str, kind: str) -> Column:
    return F.base64(column) if kind == "binary" else F.col(column).cast("string")


def id_of(column: str, kind: str) -> Column:
    return F.unbase64(column) if kind == "binary" else F.col(column).cast(kind)


def with_references(pages: DataFrame, least_bytes: int = 100) -> DataFrame:
    """page_id, url, html, digest and, for repeated payloads, the page that holds the response, and its url."""
    rows = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html")).withColumn("digest", F.sha2("html", 256))
    large = F.octet_length("html") >= least_bytes
    first = rows.where(large & F.col("page_id").isNotNull()).groupBy("digest").agg(F.min(F.struct("page_id", "url")).alias("first"), F.count("*").alias("n"))
    # Written before the join, so that Spark can split the join of a hot digest.
    first = cut(first.where("n > 1").select("digest", F.col("first.page_id").alias("first"), F.col("first.url").alias("first_url")))
    repeated = sieve(first, "digest")
    marked = rows.withColumn("repeats", large & repeated(F.col("digest")))
    joined = marked.where("repeats").join(first, "digest", "left")
    refers = F.when(~F.col("page_id").eqNullSafe(F.col("first")), F.col("first"))
    found = joined.select("page_id", "url", "html", "digest", refers.alias("refers_to"), "first_url")
    alone = marked.where(~F.col("repeats")).select("page_id", "url", "html", "digest", F.lit(None).cast(dict(pages.dtypes)["page_id"]).alias("refers_to"), F.lit(None).cast("string").alias("first_url"))
    return alone.union(found)


def write_archives(pages: DataFrame, folder: str, least_bytes: int = 100) -> DataFrame:
    """Writes the archives and returns their manifest (path, bytes), itself written to the shared folder."""
    kind = dict(pages.dtypes)["page_id"]
    names = [id_text(c, kind).alias(c) for c in ("page_id", "refers_to")]
    rows = with_references(pages, least_bytes).select(names[0], "url", "html", "digest", names[1], "first_url")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task = TaskContext.get()
        system, top = open_folder(folder)
        last = f"{top}/part-{task.partitionId():06d}-{task.taskAttemptId()}.warc.gz"
        out, size = None, 0
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256).to_pydict()
                for p, u, h, d, r, f in zip(*[part[c] for c in ("page_id", "url", "html", "digest", "refers_to", "first_url")]):
                    out = out or system.open_output_stream(f"{last}.open")
                    data = record(p, u, h.encode(), d, r, f)
                    out.write(data)
                    size += len(data)
        if out:
            out.close()
            system.move(f"{last}.open", last)
            yield pa.RecordBatch.from_arrays([pa.array([last]), pa.array([size], pa.int64())], ["path", "bytes"])

    return cut(rows.mapInArrow(run, "path string, bytes long"))


# --- reading -------------------------------------------------------------------


class Window:
    """Buffered bytes of a file from some offset on."""

    def __init__(self, file, size: int, at: int):
        self.file, self.size, self.at, self.data = file, size, at, b""

    def get(self, start: int, n: int) -> bytes:
        """Up to ``n`` bytes at ``start``, fewer only at the end of the file."""
        if start < self.at or start + n > self.at + len(self.data):
            self.file.seek(start)
            self.at, self.data = start, self.file.read(min(max(n, CHUNK), self.size - start)) if start < self.size else b""
        return self.data[start - self.at : start - self.at + n]


def member(window: Window, at: int) -> tuple[bytes, int] | None:
    """Content and end of the gzip member at ``at``; None if there is no WARC record."""
    unpack, out, place = zlib.decompressobj(31), [], at
    try:
        while not unpack.eof:
            data = window.get(place, CHUNK // 4)
            if not data:
                return None
            out.append(unpack.decompress(data))
            if len(out) == 1 and not b"WARC/1.".startswith(out[0][:7]) and not out[0].startswith(b"WARC/1."):
                return None
            place += len(data) - len(unpack.unused_data)
    except zlib.error:
        return None
    whole = b"".join(out)
    return (whole, place) if whole.startswith(b"WARC/1.") else None


def starts_member(window: Window, at: int) -> bool:
    """True if a WARC header can be decoded at ``at``, or the file ends there."""
    if at >= window.size:
        return True
    try:
        return zlib.decompressobj(31).decompress(window.get(at, 4096), 64).startswith(b"WARC/1.")
    except zlib.error:
        return False


def read_range(file, size: int, start: int, end: int) -> Iterator[bytes]:
    """Decoded records that start in [start, end)."""
    window, at = Window(file, size, start), start
    found = None
    while at < min(end, size) and found is None:
        data = window.get(at, CHUNK)
        k = data.find(MAGIC)
        if k < 0:
            at += max(1, len(data) - len(MAGIC) + 1)
            continue
        at += k
        if at >= end:
            return
        got = member(window, at)
        if got and starts_member(window, got[1]):
            found = got
        else:
            at += 1
    while found:
        yield found[0]
        at = found[1]
        if at >= min(end, size):
            return
        found = member(window, at)
        if found is None:
            raise ValueError(f"no record at byte {at}")


def read_archives(manifest: DataFrame, folder: str, split_bytes: int = 8 << 20, id_type: str = "bigint", most_tasks: int = 50_000) -> DataFrame:
    """The records of the archives in ``manifest``; see PAGE.  A revisit has its payload's size and digest, and no html.

    Every range of ``split_bytes`` is a row of a table, and a task's work up to ``most_tasks`` of them.
    """
    starts = F.sequence(F.lit(0).cast("long"), F.col("bytes") - 1, F.lit(split_bytes).cast("long"))
    ranges = manifest.where("bytes > 0").select("path", F.col("bytes").alias("size"), F.explode(starts).alias("low"))
    ranges = ranges.withColumn("high", F.least(F.col("low") + split_bytes, "size"))
    tasks = ranges.repartition(max(1, min(most_tasks, ranges.count())))
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, _ = open_folder(folder)
        for batch in batches:
            for r in batch.to_pylist():
                rows, total = [], 0
                with system.open_input_file(r["path"]) as file:
                    for data in read_range(file, r["size"], r["low"], r["high"]):
                        rows.append(page(data))
                        total += len(data)
                        if total > 8 << 20:
                            yield table(rows)
                            rows, total = [], 0
                if rows:
                    yield table(rows)

    def table(rows: list[tuple]) -> pa.RecordBatch:
        types = (pa.string(), pa.int64(), *[pa.string()] * 5)
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], [x.split()[0] for x in PAGE.split(",")])

    found = tasks.mapInArrow(run, PAGE.format(id="string"))
    return found.withColumns({c: id_of(c, id_type) for c in ("page_id", "refers_to")})


def page(data: bytes) -> tuple:
    fields, block = parse(data)
    payload = block.partition(b"\r\n\r\n")[2]
    revisit = fields["warc-type"] == "revisit"
    digest = fields["warc-payload-digest"].removeprefix("sha256:")
    if not revisit and hashlib.sha256(payload).hexdigest() != digest:
        raise ValueError("payload and digest differ")
    ids = [unquote(fields[k]) if k in fields else None for k in ("x-page-id", "x-refers-to-page-id")]
    url = unquote(fields["x-target-quoted"]) if "x-target-quoted" in fields else None
    size = int(fields["x-payload-length"]) if revisit else len(payload)
    return ids[0], size, digest, fields["warc-type"], ids[1], url, None if revisit else payload.decode()
