"""WARC archives: writing with revisits of equal payloads, and reading back by boundary-chain verification."""

from __future__ import annotations

import hashlib
import re
import uuid
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.session import durable, work_folder

# The first line of a record, and the profile of a revisit.
MAGIC = b"WARC/1.1\r\n"
IDENTICAL = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2024-01-01T00:00:00Z"

#: At most so many groups of equal payloads are broadcast (digest, length and id: under 64 MB).
BROADCAST_GROUPS = 500_000
#: So much is read for a header at first, and sixteen times as much in each further step.
HEADER_BYTES = 4096

MANIFEST = "path string, bytes long, records long"
RECORDS = "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, path string, offset long"


# ---------------------------------------------------------------- writing


def _record(page_id: int | None, url: str | None, html: bytes, digest: str, original: int | None) -> bytes:
    """One record with its two closing line ends; a revisit has the HTTP header as its block, a response also the payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(html)}\r\n\r\n".encode()
    block = http + (b"" if original is not None else html)
    name = "" if page_id is None else page_id
    head = [
        f"WARC-Type: {'response' if original is None else 'revisit'}",
        f"WARC-Record-ID: <urn:page:{name}>",
        f"WARC-Date: {DATE}",
        f"WARC-Payload-Digest: sha1:{digest}",
        "Content-Type: application/http;msgtype=response",
    ]
    if url is not None:  # characters that would end the line are escaped, as a URI asks for
        head.append("WARC-Target-URI: " + re.sub(r"[\x00-\x20\x7f]", lambda m: quote(m[0]), url))
    if original is not None:
        head += [f"WARC-Profile: {IDENTICAL}", f"WARC-Refers-To: <urn:page:{original}>"]
    head.append(f"Content-Length: {len(block)}")
    return MAGIC + "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _with_originals(pages: DataFrame, least_bytes: int) -> DataFrame:
    """Pages with the digest of their payload and, for those that repeat another's, the id of the response."""
    payload = F.coalesce(F.col("html").cast("binary"), F.lit(b"").cast("binary"))
    page = pages.select(
        F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), payload.alias("payload")
    ).withColumn("digest", F.sha1("payload"))
    sizes = page.select("page_id", "digest", F.octet_length("payload").alias("bytes"))
    groups = (
        sizes.where(F.col("bytes") >= least_bytes)
        .groupBy("digest", "bytes")
        .agg(F.max("page_id").alias("original"), F.count("*").alias("n"))
        .where("n > 1")
        .select("digest", "bytes", "original")
    )
    groups = durable(groups, "equal-payloads")
    if groups.limit(BROADCAST_GROUPS + 1).count() <= BROADCAST_GROUPS:
        groups = F.broadcast(groups)
    page = page.withColumn("bytes", F.octet_length("payload")).join(groups, ["digest", "bytes"], "left")
    revisit = F.when(~F.col("original").eqNullSafe(F.col("page_id")), F.col("original"))
    return page.select("page_id", "url", "payload", "digest", revisit.alias("original"))


def write_archives(pages: DataFrame, folder: str | None = None, least_bytes: int = 1000, archive_bytes: int = 1 << 30) -> DataFrame:
    """Write a record for each row of ``pages`` (page_id, url, html) and return the manifest ``(path, bytes, records)``.

    The payload is the html in UTF-8, null as empty. Of equal payloads of at least ``least_bytes`` bytes the one
    with the largest id is a response, the others are revisits of it; shorter ones are all responses. Rows that
    share payload and largest id are all responses, a null id is never the largest unless all are null (then all are responses). Each task
    writes files of about ``archive_bytes`` in the shared folder under names of its own, and only those of the attempt that succeeded
    are in the manifest, so a lost executor or a second attempt leaves no half archive behind in it. No rows give no files.
    """
    spark = pages.sparkSession
    folder = folder or work_folder(spark, "warc")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(folder if "://" in folder or folder.startswith("file:") else f"file://{folder}")
        store.create_dir(root, recursive=True)
        out, done, size, count = None, [], 0, 0
        stem = f"{TaskContext.get().partitionId():05d}-{uuid.uuid4().hex}"
        for batch in batches:
            for page_id, url, payload, digest, original in zip(*(c for c in batch.columns)):
                record = _record(page_id.as_py(), url.as_py(), payload.as_py(), digest.as_py(), original.as_py())
                if out is not None and size + len(record) > archive_bytes:
                    out.close()
                    done[-1] |= {"bytes": size, "records": count}
                    out = None
                if out is None:
                    name = f"{stem}-{len(done)}.warc"
                    out, size, count = store.open_output_stream(f"{root}/{name}"), 0, 0
                    done.append({"path": f"{folder}/{name}"})
                out.write(record)
                size, count = size + len(record), count + 1
        if out is not None:
            out.close()
            done[-1] |= {"bytes": size, "records": count}
        schema = pa.schema([("path", pa.string()), ("bytes", pa.int64()), ("records", pa.int64())])
        yield pa.RecordBatch.from_pylist(done, schema)

    return durable(_with_originals(pages, least_bytes).mapInArrow(run, MANIFEST), "warc-manifest")


# ---------------------------------------------------------------- reading


#: A length that a record can have; other digits, signs and longer numbers stand in no record of an archive.
_LENGTH = re.compile("[0-9]{1,18}")


class _Window:
    """Ranged reads of one archive, some bytes ahead at a time."""

    def __init__(self, path: str, size: int, ahead: int = 1 << 22):
        store, name = fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")
        self.file, self.size, self.ahead, self.start, self.data = store.open_input_file(name), size, ahead, 0, b""

    def read(self, start: int, length: int) -> bytes:
        stop = min(start + length, self.size)
        if start < self.start or stop > self.start + len(self.data):
            self.start = start
            self.data = self.file.read_at(min(max(stop - start, self.ahead), self.size - start), start) if start < self.size else b""
        return self.data[start - self.start : max(stop - self.start, 0)]

    def close(self) -> None:
        self.file.close()


def _header(window: _Window, offset: int) -> tuple[dict[str, str], int] | None:
    """The fields of the record at an offset and where its block begins; ``None`` if there is no well-formed header.

    A header has no largest length: it is read in growing ranges up to its blank line, a line that is no field or the end of the file.
    """
    fields, done, length = {}, len(MAGIC), HEADER_BYTES
    while True:
        text = window.read(offset, length)
        if not text.startswith(MAGIC):
            return None
        while (stop := text.find(b"\r\n", done)) > done:
            key, colon, value = text[done:stop].partition(b":")
            if not colon:
                return None
            fields[key.decode("utf-8", "replace").strip().lower()] = value.decode("utf-8", "replace").strip()
            done = stop + 2
        if stop == done:
            return (fields, offset + done + 2) if _LENGTH.fullmatch(fields.get("content-length", "")) else None
        if offset + length >= window.size:
            return None
        length *= 16


def _successor(window: _Window, offset: int) -> int | None:
    """Where the record after the one at this offset begins, if what stands there looks like a record."""
    found = _header(window, offset)
    if found is None:
        return None
    end = found[1] + int(found[0]["content-length"]) + 4
    return end if end <= window.size else None


def _blocks(manifest: DataFrame, block_bytes: int) -> DataFrame:
    """``(path, bytes, start, stop)``: the archives cut into ranges, one for each task or few."""
    starts = F.sequence(F.lit(0).cast("long"), F.col("bytes") - 1, F.lit(block_bytes).cast("long"))
    cut = manifest.where("bytes > 0").select("path", "bytes", F.explode(starts).alias("start"))
    return cut.withColumn("stop", F.least(F.col("start") + block_bytes, F.col("bytes")))


def _tasks(manifest: DataFrame, block_bytes: int) -> int:
    """As many tasks as there are blocks, up to a number that a job bears: rows are few bytes here, but much work each."""
    blocks = manifest.agg(F.sum(F.ceil(F.col("bytes") / block_bytes))).first()[0]
    return max(1, min(int(blocks or 0), 20_000))


def _candidates(blocks: DataFrame) -> DataFrame:
    """``(path, offset, exit)`` for each place in a block that reads like a record.

    ``exit`` is where the chain of records from there leaves the block, found by following successors within the block; null if it breaks
    before. Places of records that are not whole are left out.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                window = _Window(row["path"], row["bytes"])
                text = window.read(row["start"], row["stop"] - row["start"] + len(MAGIC) - 1)
                places, at = [], text.find(MAGIC)
                while at >= 0:
                    places.append(row["start"] + at)
                    at = text.find(MAGIC, at + 1)
                exits: dict[int, int | None] = {}
                for place in reversed(places):
                    after = _successor(window, place)
                    if after is not None:
                        exits[place] = exits.get(after) if after < row["stop"] else after
                window.close()
                kept = list(exits.items())
                yield pa.RecordBatch.from_arrays(
                    [pa.array([row["path"]] * len(kept), pa.string()), pa.array([p for p, _ in kept], pa.int64()), pa.array([e for _, e in kept], pa.int64())],
                    ["path", "offset", "exit"],
                )

    return blocks.mapInArrow(run, "path string, offset long, exit long")


def _entries(candidates: DataFrame) -> DataFrame:
    """``(path, offset)`` of the candidates at which the chain from the start of a file enters a block.

    Pointer jumping: each round adds to the reached places those that they point to and doubles the length of all pointers, so a file of
    n blocks takes about log2(n) rounds.
    """
    reached = durable(candidates.where("offset = 0").select("path", "offset"), "reached")
    jumps, count = durable(candidates, "jumps"), reached.count()
    while True:
        ahead = reached.join(jumps.where("exit IS NOT NULL"), ["path", "offset"]).select("path", F.col("exit").alias("offset"))
        more = durable(reached.union(ahead).distinct(), "reached")
        now = more.count()
        if now == count:
            # the ends of the files are reached as well, but no record stands there
            return more.join(candidates, ["path", "offset"], "left_semi")
        reached, count = more, now
        onward = jumps.select("path", F.col("offset").alias("exit"), F.col("exit").alias("further"))
        jumps = durable(
            jumps.join(onward, ["path", "exit"], "left").select("path", "offset", F.coalesce("further", "exit").alias("exit")), "jumps"
        )


def _number(name: str | None) -> int | None:
    found = re.fullmatch(r"<urn:page:(-?\d+)>", name or "")
    return int(found[1]) if found else None


def _parsed(window: _Window, offset: int, path: str) -> tuple[dict, int] | None:
    """The row of the record at this offset, and where the next begins; ``None`` if it is not whole. Lengths and digests of responses are taken from their bytes."""
    found = _header(window, offset)
    if found is None:
        return None
    fields, start = found
    length = int(fields["content-length"])
    if start + length + 4 > window.size:
        return None
    block = window.read(start, length)
    head, _, payload = block.partition(b"\r\n\r\n")
    row = {
        "page_id": _number(fields.get("warc-record-id")),
        "url": fields.get("warc-target-uri"),
        "record_type": fields.get("warc-type"),
        "refers_to": _number(fields.get("warc-refers-to")),
        "payload_bytes": len(payload),
        "payload_digest": hashlib.sha1(payload).hexdigest(),
        "path": path,
        "offset": offset,
    }
    if row["record_type"] == "revisit":
        told = re.search(rb"(?im)^content-length:\s*(\d+)", head)
        row["payload_bytes"] = int(told[1]) if told else None
        row["payload_digest"] = fields.get("warc-payload-digest", "").removeprefix("sha1:")
    return row, start + length + 4


def read_archives(manifest: DataFrame, block_bytes: int = 1 << 23) -> DataFrame:
    """The records of the archives of a manifest ``(path, bytes, ...)``, as rows of ``RECORDS``.

    Archives have no index, and the first line of a record may also stand in a payload. So tasks look for that line in
    blocks of ``block_bytes``, emit each place with the place where its chain of successors leaves the block, and pointer
    jumping from the start of each file tells at which places the true chain enters the blocks. Then each block's
    records are read from its entry on. A place inside a payload is never reached. A chain that is broken (truncated file) ends there.
    Empty archives and an empty manifest give no rows.
    """
    blocks = _blocks(manifest, block_bytes)
    tasks = _tasks(manifest, block_bytes)
    candidates = durable(_candidates(blocks.repartition(tasks)), "record-places")
    entries = _entries(candidates)
    start = F.floor(F.col("offset") / block_bytes) * block_bytes
    entered = blocks.join(entries.withColumn("start", start.cast("long")), ["path", "start"]).select("path", "bytes", "offset", "stop")
    schema = pa.schema(
        [("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())]
        + [("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("path", pa.string()), ("offset", pa.int64())]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                window, at, rows = _Window(row["path"], row["bytes"]), row["offset"], []
                while at is not None and at < row["stop"]:
                    found = _parsed(window, at, row["path"])
                    at = found[1] if found else None
                    if found:
                        rows.append(found[0])
                window.close()
                yield pa.RecordBatch.from_pylist(rows, schema)

    return entered.repartition(tasks).mapInArrow(run, RECORDS)
