"""WARC archives with revisit records for payloads already stored.

``write_archive`` writes response records through Spark's text writer (so archives go wherever Spark can
write): the line separator is the blank line pair that ends a WARC record, and files are gzip-compressed.  Records
are written by classes of size, the larger the fewer to a file, so that a file holds at most some 64 MB (or one
record).

``deduplicate`` rewrites archives: headers alone are shuffled, by payload digest; the record with the
smallest page id keeps its payload and the others become revisit records that refer to it.  What is sent back
to an archive file are its path and the notes on its revisits, sorted by record, which the rewriting task
walks through beside the records as it unpacks the file.  Tasks open archives themselves, as streams, so that neither
payloads are shuffled nor a whole file is held in memory.  Where a folder's scheme is one that only Spark opens,
files are read by Spark and go along with their notes instead.  A digest that a third of all records share is met
by partial aggregation and a splittable join.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from neume.llm.common import table
from neume.storage import drop, fresh_path, materialize, remove

LEAST_PAYLOAD = 100  # bytes; shorter payloads are always stored
#: Records of up to so many bytes are written so many to a file; larger ones each to its own.
FILES = ((16 << 10, 4000), (256 << 10, 250), (4 << 20, 16))
TASK_BYTES = 64 << 20  # compressed bytes of archives that a rewriting task takes
DATE = "2025-01-01T00:00:00Z"
_END = "\r\n\r\n"
_HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

HEADERS = "file string, record long, page_id long, url string, date string, record_id string, record_type string, payload_digest string, payload_bytes long, refers_to long, block_bytes long"


def _record_id(*parts: Column) -> Column:
    """A urn:uuid made from the parts, so that a task run twice writes the same record."""
    h = F.md5(F.concat_ws("\n", *(F.coalesce(p.cast("string"), F.lit("")) for p in parts)))
    return F.concat(F.lit("<urn:uuid:"), F.substring(h, 1, 8), F.lit("-"), F.substring(h, 9, 4), F.lit("-"), F.substring(h, 13, 4), F.lit("-"), F.substring(h, 17, 4), F.lit("-"), F.substring(h, 21, 12), F.lit(">"))


def write_archive(pages: DataFrame, path: str, date: str = DATE) -> None:
    """One response record per row of ``pages`` (page_id, url, html), written under ``path``.

    Null html is an empty payload; line ends inside an url are percent-encoded; a null url or page_id has
    no header.  Rows that repeat are records of their own, with ids of their own.  No rows: an archive without
    records.  Other columns aren't read.
    """
    html = F.coalesce(F.col("html").cast("string"), F.lit(""))
    url = F.regexp_replace(F.regexp_replace(F.col("url").cast("string"), "\r", "%0D"), "\n", "%0A")
    block = F.concat(F.lit(_HTTP), html)
    digest = F.sha2(html.cast("binary"), 256)
    head = F.concat_ws(
        "\r\n",
        F.lit("WARC/1.1"),
        F.lit("WARC-Type: response"),
        F.concat(F.lit("WARC-Record-ID: "), _record_id(F.lit("response"), F.monotonically_increasing_id(), F.col("page_id"), url, digest)),
        F.lit(f"WARC-Date: {date}"),
        F.concat(F.lit("WARC-Target-URI: "), url),
        F.concat(F.lit("X-Page-ID: "), F.col("page_id").cast("string")),
        F.concat(F.lit("WARC-Payload-Digest: sha256:"), digest),
        F.lit("Content-Type: application/http;msgtype=response"),
        F.concat(F.lit("Content-Length: "), F.octet_length(block).cast("string")),
    )
    records = pages.select(F.concat(head, F.lit(_END), block).alias("value"), _file_class(F.octet_length(html)).alias("class"))
    found = [r["class"] for r in records.select("class").distinct().collect()]  # four at most
    for k in found or [0]:
        _write(records.where(F.col("class") == k).select("value"), path, k)


def _file_class(size: Column) -> Column:
    return F.lit(0) + sum(((size > most).cast("int") for most, _ in FILES), F.lit(0))


def _write(records: DataFrame, path: str, file_class: int) -> None:
    """Text as it is, one record a line, into a folder of the class."""
    most = FILES[file_class][1] if file_class < len(FILES) else 1
    writer = records.write.option("lineSep", _END).option("compression", "gzip").option("zlib.compress.level", "BEST_SPEED").option("maxRecordsPerFile", most)
    writer.text(f"{path}/size-{file_class}")


def _uri(path: str) -> str:
    """A path as Spark writes it, as a uri with an authority."""
    if path.startswith("file:/") and not path.startswith("file://"):
        return "file://" + path.removeprefix("file:")
    return path if "://" in path else f"file://{path}"


def _opened(path: str) -> Iterator[bytes]:
    """The bytes of a file, a piece at a time, opened in the task."""
    system, name = fs.FileSystem.from_uri(_uri(path))
    with system.open_input_stream(name, compression=None) as stream:
        while piece := stream.read(1 << 18):
            yield piece


def _tasks_can_open(path: str) -> bool:
    """Whether the folder's scheme is one that Python tasks open themselves."""
    try:
        system, name = fs.FileSystem.from_uri(_uri(path))
        return system.get_file_info(name).type == fs.FileType.Directory
    except (pa.ArrowException, OSError):
        return False


def _files(spark: SparkSession, path: str) -> DataFrame:
    """(file, bytes, content) of the archives under ``path``; content is null where tasks can open them."""
    content = F.lit(None).cast("binary") if _tasks_can_open(path) else F.col("content")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select(F.col("path").alias("file"), F.col("length").alias("bytes"), content.alias("content"))


class _Reader:
    """Bytes of a gzip file, unpacked as they are asked for."""

    def __init__(self, pieces: Iterator[bytes]) -> None:
        self.unpack, self.pieces, self.rest, self.have = zlib.decompressobj(31), pieces, b"", bytearray()

    def until(self, mark: bytes) -> bytes | None:
        start = 0
        while (at := self.have.find(mark, start)) < 0:
            start = max(0, len(self.have) - len(mark))
            if not self._grow():
                return None
        out = bytes(self.have[:at])
        del self.have[: at + len(mark)]
        return out

    def take(self, n: int) -> bytes:
        while len(self.have) < n and self._grow():
            pass
        out = bytes(self.have[:n])
        del self.have[:n]
        return out

    def _grow(self) -> bool:
        before = len(self.have)
        while len(self.have) == before:
            self.rest = self.rest or next(self.pieces, b"")
            if not self.rest:
                return False
            self.have += self.unpack.decompress(self.rest)
            self.rest = self.unpack.unused_data
            if self.unpack.eof:  # a file may be a chain of gzip members
                self.unpack = zlib.decompressobj(31)
        return True


_NAMES = ("WARC-Type", "WARC-Record-ID", "WARC-Date", "WARC-Target-URI", "WARC-Payload-Digest", "Content-Length", "Content-Type", "X-Page-ID", "X-Payload-Length", "X-Refers-To-Page-ID")
_KNOWN = {n.lower(): n for n in _NAMES}


def records(pieces: Iterator[bytes]) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, block) of every record of an archive file, one at a time; names of headers in any case."""
    reader = _Reader(pieces)
    while (head := reader.until(b"\r\n\r\n")) is not None:
        lines = head.decode("utf-8", "surrogateescape").lstrip("\r\n").split("\r\n")
        pairs = (line.partition(":") for line in lines[1:] if ":" in line)
        fields = {_KNOWN.get(name.strip().lower(), name.strip()): value.strip(" \t") for name, _, value in pairs}
        block = reader.take(int(fields.get("Content-Length", 0)))
        reader.take(4)
        yield fields, block


def _payload(block: bytes) -> bytes:
    return block.partition(b"\r\n\r\n")[2]


def _number(text: str | None) -> int | None:
    return int(text) if text else None


def _digest(header: str | None) -> str | None:
    """A digest header's value, without its label where that is sha256."""
    return header.removeprefix("sha256:") if header else None


def read_headers(spark: SparkSession, path: str) -> DataFrame:
    """One row per record: the file and number it stands at, its headers, and its payload's digest and size.

    Digests and sizes of response records are computed from the payload as read; those of other records
    are what their headers say, null where those are silent (archives of other writers).  Headers that a record
    lacks are null.  An archive without records gives no rows.
    """

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for file, content in zip(batch.file, batch.content, strict=True):
                rows = []
                for k, (h, block) in enumerate(records(_opened(file) if content is None else iter([content]))):
                    if h.get("WARC-Type") == "response":
                        payload = _payload(block)
                        digest, size = hashlib.sha256(payload).hexdigest(), len(payload)
                    else:
                        digest, size = _digest(h.get("WARC-Payload-Digest")), _number(h.get("X-Payload-Length"))
                    rows.append((file, k, _number(h.get("X-Page-ID")), h.get("WARC-Target-URI"), h.get("WARC-Date"), h.get("WARC-Record-ID"), h.get("WARC-Type"), digest, size, _number(h.get("X-Refers-To-Page-ID")), len(block)))
                    if len(rows) >= 5000:
                        yield _frame(rows)
                        rows = []
                yield _frame(rows)

    return _files(spark, path).select("file", "content").mapInPandas(parse, HEADERS)


def _frame(rows: list[tuple]) -> pd.DataFrame:
    names = [part.split()[0] for part in HEADERS.split(", ")]
    out = pd.DataFrame(rows, columns=names, dtype=object)
    return out.astype({"page_id": "Int64", "refers_to": "Int64", "payload_bytes": "Int64"})


def deduplicate(spark: SparkSession, source: str, target: str, least: int = LEAST_PAYLOAD, date: str = DATE) -> None:
    """Rewrite the archives under ``source`` to ``target``, with one stored payload per digest.

    Payloads shorter than ``least`` bytes stay.  Of equal page ids (records that repeat) the first in file
    order stays; records without page id come after those with one.
    """
    heads = materialize(read_headers(spark, source), "warc-headers")
    able = heads.where((F.col("record_type") == "response") & (F.col("payload_bytes") >= least))
    rank = F.struct(F.col("page_id").isNull().alias("none"), "page_id", "file", "record", "record_id", "url", "date")
    first = able.groupBy("payload_digest").agg(F.min(rank).alias("o"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    copies = able.join(first, "payload_digest").where((F.col("file") != F.col("o.file")) | (F.col("record") != F.col("o.record")))
    notes = copies.select("file", "record", F.col("o.page_id").cast("string").alias("refers_to"), F.col("o.record_id").alias("refers_id"), F.col("o.url").alias("refers_uri"), F.col("o.date").alias("refers_date"))

    def rewrite(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = (row for batch in batches for row in batch.astype(object).itertuples(index=False))
        row, out, size = next(rows, None), [], 0
        while row is not None:  # a file's own row, then its notes by record
            archive = _opened(row.file) if row.content is None else iter([row.content])
            row = next(rows, None)
            for k, (h, block) in enumerate(records(archive)):
                note = row if row is not None and row.record == k else None
                if note is not None:
                    row = next(rows, None)
                out.append(_fresh(h, block, note, date))
                size += len(out[-1])
                if size > 1 << 22:
                    yield pd.DataFrame({"value": out})
                    out, size = [], 0
        yield pd.DataFrame({"value": pd.Series(out, dtype=object)})

    files = _files(spark, source)
    classes = heads.groupBy("file").agg(_file_class(F.max("block_bytes")).alias("class"))
    sized = materialize(files.select("file", "bytes").join(classes, "file"), "warc-files")
    fields = "record long, refers_to string, refers_id string, refers_uri string, refers_date string"
    blank = {f.split()[0]: F.lit(None).cast(f.split()[1]) for f in fields.split(", ")}
    found = sized.groupBy("class").agg(F.sum("bytes").alias("bytes")).collect()  # four rows at most
    for r in found:
        own = sized.where(F.col("class") == r["class"]).select("file")
        heading = files.join(own, "file", "left_semi").select("file", "content").withColumns(blank | {"record": F.lit(-1).cast("long")})
        both = heading.unionByName(notes.join(own, "file", "left_semi"), allowMissingColumns=True)
        tasks = max(-(-r["bytes"] // TASK_BYTES), min(own.count(), 2 * spark.sparkContext.defaultParallelism))
        placed = both.repartition(tasks, "file").sortWithinPartitions("file", "record")
        _write(placed.mapInPandas(rewrite, "value binary").select(F.col("value").cast("string")), target, r["class"])
    if not found:
        _write(spark.createDataFrame([], "value string"), target, 0)
    drop(heads, sized)


def _fresh(h: dict[str, str], block: bytes, note: tuple | None, date: str) -> bytes:
    """A record with new headers: a revisit of what the note names, or the record as it was."""
    kept = {k: h[k] for k in ("WARC-Target-URI", "X-Page-ID") if k in h}
    own = _derived(h.get("WARC-Record-ID", ""), "kept" if note is None else "revisit")
    if note is None:
        lines = {"WARC-Type": h.get("WARC-Type", "unknown"), "WARC-Record-ID": own} | {k: h[k] for k in ("WARC-Date",) if k in h} | kept
        lines |= {k: v for k, v in h.items() if k not in lines and k != "Content-Length"}
    else:
        payload = _payload(block)
        block = block[: len(block) - len(payload)]
        lines = {"WARC-Type": "revisit", "WARC-Record-ID": own, "WARC-Date": date} | kept
        lines |= {"WARC-Profile": _PROFILE, "WARC-Refers-To": _derived(note.refers_id or "", "kept")}
        told = {"WARC-Refers-To-Target-URI": note.refers_uri, "WARC-Refers-To-Date": note.refers_date, "X-Refers-To-Page-ID": note.refers_to}
        lines |= {k: v for k, v in told.items() if v is not None} | {"X-Payload-Length": str(len(payload))}
        lines |= {"WARC-Payload-Digest": f"sha256:{hashlib.sha256(payload).hexdigest()}", "Content-Type": "application/http;msgtype=response"}
    head = "\r\n".join(["WARC/1.1", *(f"{k}: {v}" for k, v in lines.items()), f"Content-Length: {len(block)}"])
    return (head + _END).encode("utf-8", "surrogateescape") + block


def _derived(record_id: str, role: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, record_id.encode("utf-8", "replace").decode() + role)}>"


def op4_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Archive ``pages``, resolve revisits into new archives, and read those back."""
    path = fresh_path(spark, "warc")
    write_archive(table(spark, sf_dir, "pages"), f"{path}/source")
    deduplicate(spark, f"{path}/source", f"{path}/deduplicated")
    remove(spark, f"{path}/source")
    return read_headers(spark, f"{path}/deduplicated").select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


QUERIES = {"op4_warc_revisits": op4_warc_revisits}

ORACLE = {
    "op4_warc_revisits": """
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
o AS (SELECT payload_digest, min(page_id) AS origin FROM p WHERE payload_bytes >= 100 GROUP BY payload_digest)
SELECT page_id, payload_bytes, p.payload_digest, CASE WHEN origin IS NULL OR origin = page_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN origin <> page_id THEN origin END AS refers_to
FROM p LEFT JOIN o ON p.payload_digest = o.payload_digest
"""
}
