"""WARC archives: writer with revisit records, and a sequential reader.

Writer: payload digests and response/revisit roles are worked out with
DataFrame operations; each task then appends its records, one gzip member per
record, to archives of bounded size in a shared folder and returns a manifest
row per finished archive.  A file's name carries a fresh id, so a task that
runs twice (lost executor, speculation) never touches another attempt's file;
only the files named in the written manifest are read.

Reader: each task streams archives in small pieces through an incremental zlib
decompressor, one member at a time.  A record's block is framed by its
Content-Length, the rest of the member must be the two line ends, and block
and payload digests are verified while the bytes pass.

Defined cases: null payload counts as empty; a null page_id is left out of
the headers and read back as null (it sorts after every other id); of
repeated rows with the smallest page_id of a payload each is a response; an
empty table gives no archives and an empty result; other columns are ignored
(``url`` is the target URI when it is there, null and odd characters escaped).
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from complexa.llm.common import work_table
from complexa.session import qualified, scratch_path

#: Payloads below this size are always written whole.
REVISIT_MIN_BYTES = 100
#: An archive is closed when it has this many (compressed) bytes.
ARCHIVE_BYTES = 32 << 20
PIECE = 64 << 10
_REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


class WarcError(ValueError):
    """An archive that breaks the format or fails a digest."""


# ------------------------------------------------------------------ writing
def plan_records(pages: DataFrame, payload: str = "html") -> DataFrame:
    """page_id, url, payload, payload_digest, record_type, refers_to for every row.

    Only digests are grouped; a payload moves once, to meet its record's role.
    """
    url = F.col("url").cast("string") if "url" in pages.columns else F.lit(None).cast("string")
    rows = pages.select(F.col("page_id").cast("long"), url.alias("url"),
                        F.encode(F.coalesce(F.col(payload).cast("string"), F.lit("")), "UTF-8").alias("payload"))
    rows = rows.select("*", F.sha2("payload", 256).alias("payload_digest"), F.octet_length("payload").alias("size"))
    large = F.col("size") >= REVISIT_MIN_BYTES
    order = F.struct(F.col("page_id").isNull().alias("z"), F.col("page_id").alias("p"))
    first = (rows.filter(large).groupBy("payload_digest").agg(F.min(order).alias("first"), F.count(F.lit(1)).alias("n"))
             .filter("n > 1").select("payload_digest", "first"))
    joined = rows.join(first, "payload_digest", "left")
    leads = F.col("first").isNull() | (order == F.col("first"))
    return joined.select("page_id", "url", "payload", "payload_digest", F.when(leads, "response").otherwise("revisit").alias("record_type"),
                         F.when(~leads, F.col("first.p")).alias("refers_to"))


def record_bytes(page_id: int | None, url: str | None, payload: bytes, digest: str, kind: str, refers_to: int | None) -> bytes:
    """One WARC record (uncompressed).  A revisit has the HTTP header only, with the full payload's length."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + payload if kind == "response" else http
    fields = [("WARC-Type", kind), ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid4()}>"), ("WARC-Date", "1970-01-01T00:00:00Z"),
              ("WARC-Target-URI", quote(url or "", safe="%/:=&?~#+!$,;'@()*[]")),
              ("WARC-Payload-Digest", f"sha256:{digest}"), ("WARC-Block-Digest", f"sha256:{hashlib.sha256(block).hexdigest()}")]
    if kind == "revisit":
        fields.append(("WARC-Profile", _REVISIT))
        if refers_to is not None:
            fields.append(("WARC-Refers-To-Page", str(refers_to)))
    if page_id is not None:
        fields.append(("WARC-Page-Id", str(page_id)))
    fields += [("Content-Type", "application/http;msgtype=response"), ("Content-Length", str(len(block)))]
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields) + "\r\n"
    return head.encode() + block + b"\r\n\r\n"


def gzip_member(data: bytes) -> bytes:
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


def write_archives(records: DataFrame, folder: str) -> DataFrame:
    """Write ``records`` (from ``plan_records``) to archives in ``folder``; the written manifest (path, n_records, n_bytes)."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = pafs.FileSystem.from_uri(folder)
        out = path = None
        count = size = 0

        def close():
            out.close()
            return pa.RecordBatch.from_pydict({"path": [path], "n_records": [count], "n_bytes": [size]})

        for batch in batches:
            for i in range(batch.num_rows):
                r = {k: batch.column(j)[i].as_py() for j, k in enumerate(batch.schema.names)}
                if out is None:
                    store.create_dir(base, recursive=True)
                    path, count, size = f"{base}/{uuid.uuid4().hex}.warc.gz", 0, 0
                    out = store.open_output_stream(path, compression=None)
                member = gzip_member(record_bytes(r["page_id"], r["url"], r["payload"], r["payload_digest"],
                                                  r["record_type"], r["refers_to"]))
                out.write(member)
                count, size = count + 1, size + len(member)
                if size >= ARCHIVE_BYTES:
                    yield close()
                    out = None
        if out is not None:
            yield close()

    return work_table(records.mapInArrow(write, "path string, n_records long, n_bytes long"), "warc-manifest")


# ------------------------------------------------------------------ reading
class _Members:
    """Byte source over the gzip members of a stream; holds one piece at a time."""

    def __init__(self, stream):
        self.stream, self.raw, self.z, self.ready, self.ended = stream, b"", None, b"", False

    def next_member(self) -> bool:
        self.raw = self.raw or self.stream.read(PIECE)
        if not self.raw:
            return False
        self.z, self.ready, self.ended = zlib.decompressobj(31), b"", False
        return True

    def more(self) -> bool:
        """Decompress another piece of the member into ``ready``; False at its end."""
        while not self.ended:
            if not self.raw and not self.z.unconsumed_tail:
                self.raw = self.stream.read(PIECE)
                if not self.raw:
                    raise WarcError("the archive ends inside a gzip member")
            try:
                got = self.z.decompress(self.z.unconsumed_tail or self.raw, PIECE)
            except zlib.error as e:
                raise WarcError(f"bad gzip member: {e}") from e
            self.raw = b""
            if self.z.eof:
                self.ended, self.raw = True, self.z.unused_data
            if got:
                self.ready += got
                return True
        return False

    def until(self, mark: bytes) -> bytes:
        """All up to the mark, however long a header is; it must stand in the member."""
        seen = 0
        while (at := self.ready.find(mark, seen)) < 0:
            seen = max(0, len(self.ready) - len(mark) + 1)
            if not self.more():
                raise WarcError("a header has no end")
        got, self.ready = self.ready[:at], self.ready[at + len(mark):]
        return got

    def take(self, n: int) -> Iterator[bytes]:
        while n:
            if not self.ready and not self.more():
                raise WarcError("a record is shorter than its Content-Length")
            got, self.ready = self.ready[:n], self.ready[n:]
            n -= len(got)
            yield got


def read_records(stream) -> Iterator[dict]:
    """Records of an archive, in order: headers, payload_bytes, payload_digest, payload (None for a revisit)."""
    members = _Members(stream)
    while members.next_member():
        head = members.until(b"\r\n\r\n").decode("utf-8").split("\r\n")
        if not head[0].startswith("WARC/"):
            raise WarcError("no WARC version line")
        fields = {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in head[1:])}
        length, block, payload = int(fields["content-length"]), hashlib.sha256(), hashlib.sha256()
        http, body, seen = b"", [], False
        for piece in members.take(length):
            block.update(piece)
            if not seen:
                http += piece
                top, mark, piece = http.partition(b"\r\n\r\n")
                if not mark:
                    continue
                seen, http = True, top
            payload.update(piece)
            body.append(piece)
        if b"".join(members.take(4)) != b"\r\n\r\n" or members.ready or members.more():
            raise WarcError("a record does not end with its member")
        if not seen:
            raise WarcError("no HTTP header in the block")
        stated = int(next(v for k, _, v in (x.partition(b":") for x in http.split(b"\r\n")) if k.lower() == b"content-length"))
        want, data = fields["warc-payload-digest"].removeprefix("sha256:"), b"".join(body)
        if "sha256:" + block.hexdigest() != fields["warc-block-digest"]:
            raise WarcError("block digest differs")
        whole = fields["warc-type"] == "response"
        if whole and (payload.hexdigest() != want or len(data) != stated) or not whole and data:
            raise WarcError("payload differs from its digest or length")
        yield {"fields": fields, "payload_bytes": stated, "payload_digest": want, "payload": data if whole else None}


def read_archives(manifest: DataFrame, folder: str) -> DataFrame:
    """One row per record of the archives named in ``manifest``; payload is null for revisits."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, _ = pafs.FileSystem.from_uri(folder)
        number = lambda x: None if x is None else int(x)
        for batch in batches:
            for path, n in zip(batch.column("path").to_pylist(), batch.column("n_records").to_pylist(), strict=True):
                rows, held, count = [], 0, 0
                with store.open_input_stream(path, compression=None) as stream:
                    for r in read_records(stream):
                        f, count = r["fields"], count + 1
                        rows.append((number(f.get("warc-page-id")), r["payload_bytes"], r["payload_digest"], f["warc-type"],
                                     number(f.get("warc-refers-to-page")), f.get("warc-target-uri"), r["payload"]))
                        held += len(r["payload"] or b"")
                        if held > 4 << 20 or len(rows) >= 2000:
                            yield _batch(rows)
                            rows, held = [], 0
                if count != n:
                    raise WarcError(f"{path}: {count} records, the manifest has {n}")
                if rows:
                    yield _batch(rows)

    return manifest.select("path", "n_records").repartition("path").mapInArrow(read, _READ)


_READ = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, target_uri string, payload binary"


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.binary()]
    names = [x.split()[0] for x in _READ.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)


def warc_round_trip(spark: SparkSession, pages: DataFrame, folder: str | None = None) -> DataFrame:
    """Write ``pages`` to archives and read them back (with a verified digest for every whole payload)."""
    folder = folder or scratch_path(spark, f"warc-{uuid.uuid4().hex}")
    folder = qualified(spark, folder)
    return read_archives(write_archives(plan_records(pages), folder), folder)
