"""WARC archives with a Zstandard dictionary.

Every task writes archives of its own.  The dictionary is trained on the first records of an archive (at most
`SAMPLE_BYTES`), stands in a skippable frame at the head of the file, and every record is one frame compressed
with it, so that a record can be read alone.  Equal payloads are archived once: that of the largest page_id is
a response, the others are revisits that refer to it.

Archives go to the shared folder, through the file system that its URI names.  A file gets its final name
when it is whole; a task that is run again writes under another name, and only the names that a finished task
returned are read.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
import zstandard as zstd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.store import new_path, staged

DICT_MAGIC = 0x184D2A5D  # fixed value: the skippable frame that holds a dictionary
SAMPLE_BYTES, DICT_BYTES, ROLL_BYTES = 2 << 20, 64 << 10, 256 << 20
_DATE = "2024-01-01T00:00:00Z"


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool, digest: str) -> bytes:
    """One uncompressed WARC record; a revisit keeps the HTTP head and leaves the payload out."""
    ident = lambda x: f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_OID, str(x))}>"
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    clean = (url or "urn:none").replace("\r", "%0D").replace("\n", "%0A")
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {ident(page_id)}", f"WARC-Date: {_DATE}", f"WARC-Target-URI: {clean}", f"WARC-Payload-Digest: sha1:{digest}"]
    if revisit:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {ident(refers_to)}", f"Refers-To-Page: {refers_to}"]
    if page_id is not None:
        head.append(f"Page-ID: {page_id}")
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _dictionary(samples: list[bytes]) -> zstd.ZstdCompressionDict:
    """Trained where there are samples enough, else the samples themselves."""
    try:
        return zstd.train_dictionary(min(DICT_BYTES, max(1024, sum(map(len, samples)) // 8)), samples, k=256, d=8)
    except zstd.ZstdError:
        return zstd.ZstdCompressionDict(b"".join(samples)[: DICT_BYTES], dict_type=zstd.DICT_TYPE_RAWCONTENT)


class Writer:
    """Archives under a folder; `paths` are those that are whole."""

    def __init__(self, folder: str, level: int = 6) -> None:
        self.fs, self.root = pafs.FileSystem.from_uri(folder)
        self.folder, self.level, self.paths = folder, level, []
        self.waiting, self.size, self.file = [], 0, None

    def add(self, data: bytes) -> None:
        if self.file is None:
            self.waiting.append(data)
            self.size += len(data)
            if self.size >= SAMPLE_BYTES:
                self._open()
        else:
            self._put(data)

    def _open(self) -> None:
        book = _dictionary(self.waiting)
        self.coder = zstd.ZstdCompressor(level=self.level, dict_data=book, write_checksum=True)
        self.name, self.written = f"{uuid.uuid4().hex}.warc.zst", 0
        self.file = self.fs.open_output_stream(f"{self.root}/.{self.name}")
        raw = book.as_bytes()
        self.file.write(DICT_MAGIC.to_bytes(4, "little") + len(raw).to_bytes(4, "little") + raw)
        waiting, self.waiting, self.size = self.waiting, [], 0
        for data in waiting:
            self._put(data)

    def _put(self, data: bytes) -> None:
        frame = self.coder.compress(data)
        self.file.write(frame)
        self.written += len(frame)
        if self.written >= ROLL_BYTES:
            self.close()

    def close(self) -> None:
        if self.waiting:
            self._open()
        if self.file is not None:
            self.file.close()
            self.fs.move(f"{self.root}/.{self.name}", f"{self.root}/{self.name}")
            self.paths.append(f"{self.folder}/{self.name}")
            self.file = None


def read_records(stream) -> Iterator[tuple[dict[str, str], bytes]]:
    """(WARC header, block) of each record of an archive, one frame at a time."""
    head = stream.read(8)
    if int.from_bytes(head[:4], "little") != DICT_MAGIC:
        raise ValueError("the archive has no dictionary frame")
    raw = stream.read(int.from_bytes(head[4:], "little"))
    kind = zstd.DICT_TYPE_FULLDICT if raw[:4] == b"\x37\xa4\x30\xec" else zstd.DICT_TYPE_RAWCONTENT
    context = zstd.ZstdDecompressor(dict_data=zstd.ZstdCompressionDict(raw, dict_type=kind))
    pending, out, unit = b"", [], None
    while True:
        if not pending:
            pending = stream.read(1 << 20)
            if not pending:
                break
        unit = unit or context.decompressobj()
        out.append(unit.decompress(pending))
        pending = unit.unused_data if unit.eof else b""
        if unit.eof:
            head, _, rest = b"".join(out).partition(b"\r\n\r\n")
            fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
            yield fields, rest[: int(fields["Content-Length"])]
            out, unit = [], None
    if unit is not None:
        raise ValueError("the archive ends within a record")


def write(pages: DataFrame, folder: str, min_bytes: int = 0) -> DataFrame:
    """Archive every row of pages(page_id, url, html) under `folder`; returns the staged list of (path).

    A null html is an empty payload; rows that tie for the largest page_id are all responses; a group in which
    all ids are null has no revisits.
    """
    body = F.coalesce(pages["html"].cast("string"), F.lit(""))
    rows = pages.select(pages["page_id"].cast("long").alias("page_id"), pages["url"].cast("string").alias("url"), body.alias("html"), F.sha1(body.cast("binary")).alias("sha"))
    first = rows.groupBy("sha").agg(F.max("page_id").alias("refers_to"))
    again = F.col("refers_to").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("refers_to")) & (F.octet_length("html") >= min_bytes)
    planned = rows.join(first, "sha").select("page_id", "url", "html", "refers_to", again.alias("again"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        writer = Writer(folder)
        for batch in batches:
            for i in range(batch.num_rows):
                page_id, url, html, refers_to, again = (column[i].as_py() for column in batch.columns)
                payload = html.encode()
                writer.add(record(page_id, url, payload, refers_to if again else None, again, payload_digest(payload)))
        writer.close()
        yield pa.RecordBatch.from_arrays([pa.array(writer.paths, pa.string())], ["path"])

    fs, root = pafs.FileSystem.from_uri(folder)
    fs.create_dir(root, recursive=True)
    return staged(planned.mapInArrow(run, "path string"), "archives")


def read(paths: DataFrame) -> DataFrame:
    """What the archives hold: page_id, payload_bytes, payload_digest, record_type, refers_to, url; payloads are checked against their digests."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url"]
        types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string()]
        for batch in batches:
            for path in batch.column("path").to_pylist():
                fs, name = pafs.FileSystem.from_uri(path)
                rows: list[tuple] = []
                with fs.open_input_stream(name) as stream:
                    for head, block in read_records(stream):
                        http, _, payload = block.partition(b"\r\n\r\n")
                        size = int(dict(x.split(b": ", 1) for x in http.split(b"\r\n")[1:])[b"Content-Length"])
                        kind, digest = head["WARC-Type"], head["WARC-Payload-Digest"].removeprefix("sha1:")
                        if kind == "response" and (len(payload) != size or payload_digest(payload) != digest):
                            raise ValueError(f"a payload in {path} differs from its digest")
                        page, refers = head.get("Page-ID"), head.get("Refers-To-Page")
                        rows.append((page and int(page), size, digest, kind, refers and int(refers), head["WARC-Target-URI"]))
                        if len(rows) == 4096:
                            yield _rows(rows, names, types)
                            rows = []
                yield _rows(rows, names, types)

    spread = paths.repartition(max(1, min(paths.count(), 4096)), F.xxhash64("path"))
    return spread.mapInArrow(run, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string")


def _rows(rows: list[tuple], names: list[str], types: list[pa.DataType]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [()] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)


def archive(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """Write all pages to archives in the shared folder and read them back.

    Repeated rows are repeated; other columns are ignored; an empty table gives no archive and no rows.
    """
    folder = new_path(pages.sparkSession, "warc")
    folder = folder if "://" in folder or folder.startswith("file:") else f"file://{folder}"
    folder = folder.replace("file:/", "file:///", 1) if folder.startswith("file:/") and not folder.startswith("file://") else folder
    return read(write(pages, folder, min_bytes)).drop("url")
