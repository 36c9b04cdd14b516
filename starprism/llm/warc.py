"""WARC archives: a writer with identical-payload revisits and a reader that salvages what follows damage."""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from starprism.llm.common import batches, materialize, new_path, parts_of
from starprism.llm.files import open_file, write_file

_MEMBER = b"\x1f\x8b\x08"
_VERSION = re.compile(rb"WARC/\d\.\d\r?\n")
_HEAD_END = re.compile(rb"\r\n\r\n")
_BEGINNING = re.compile(rb"\x1f\x8b\x08|WARC/\d\.\d\r?\n")  # of a member, or of a plain record
SALTS = 16
_REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def sha1_base32(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def _record_id(page_id: int | None) -> str:
    return f"<urn:x-page:{'' if page_id is None else page_id}>"


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None = None, date: str = "1970-01-01T00:00:00Z") -> bytes:
    """One WARC/1.1 record. A revisit holds the HTTP head alone, which states the full payload's length."""
    revisit = refers_to is not None
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = head if revisit else head + payload
    uri = "".join(c if 0x21 <= ord(c) < 0x7F else "".join(f"%{b:02X}" for b in c.encode("utf-8", "surrogatepass")) for c in url or f"urn:x-page:{page_id}")
    fields = [("WARC-Type", "revisit" if revisit else "response"), ("WARC-Record-ID", _record_id(page_id)), ("WARC-Date", date), ("WARC-Target-URI", uri), ("WARC-Payload-Digest", "sha1:" + sha1_base32(payload)), ("WARC-Block-Digest", "sha1:" + sha1_base32(block))]
    if revisit:
        fields += [("WARC-Profile", _REVISIT), ("WARC-Refers-To", _record_id(refers_to))]
    fields += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields).encode() + b"\r\n" + block + b"\r\n\r\n"


Record = tuple[dict[str, str], bytes]
Gap = tuple[int, int, str]
#: A record's header and block may have so many bytes; of longer ones a length is taken for damage.
LONGEST_HEADER, LONGEST_BLOCK = 1 << 20, 1 << 30


class Window:
    """The bytes of a source from a moving place on. ``more`` gives the next bytes, empty at the end; what lies before
    the place is let go in large steps, so reading takes time in proportion to the bytes however many records there are."""

    def __init__(self, more: Callable[[], bytes]):
        self.more, self.data, self.low, self.at, self.ended = more, bytearray(), 0, 0, False  # ``low``: the source's place of data[0]

    def fill(self, n: int) -> bool:
        """Makes ``n`` bytes from the place on available; False if the source ends before."""
        while len(self.data) - (self.at - self.low) < n and not self.ended:
            piece = self.more()
            if piece:
                self.data += piece
            else:
                self.ended = True
        return len(self.data) - (self.at - self.low) >= n

    def move(self, at: int) -> None:
        self.at = at
        if at - self.low > max(1 << 20, len(self.data) // 2):
            del self.data[: at - self.low]
            self.low = at

    def peek(self, n: int, skip: int = 0) -> bytes:
        self.fill(skip + n)
        a = self.at - self.low + skip
        return bytes(self.data[a : a + n])

    def find(self, what: re.Pattern, skip: int = 0, longest: int = 16, until: int | None = None) -> int | None:
        """How far after the place a match of at most ``longest`` bytes begins, from ``skip`` on; None if there is none."""
        while True:
            self.fill(skip + (1 << 16))
            if found := what.search(self.data, self.at - self.low + skip):
                return found.start() - (self.at - self.low)
            held = len(self.data) - (self.at - self.low)
            if self.ended or (until is not None and held >= until):
                return None
            skip = max(skip, held - longest)
            self.fill(held + 1)


def _record_at(w: Window) -> tuple[Record, int]:
    """The record at the window's place, and how long it is; ValueError if a check fails."""
    if not _VERSION.match(w.peek(16)):
        raise ValueError("no version line")
    end = w.find(_HEAD_END, 0, 4, LONGEST_HEADER)
    if end is None:
        raise ValueError("header without end")
    headers = {}
    for line in w.peek(end).split(b"\r\n")[1:]:
        name, colon, value = line.partition(b":")
        if not colon:
            raise ValueError("header line without name")
        headers[name.decode("latin-1").strip().lower()] = value.decode("utf-8", "replace").strip()
    if not headers.get("content-length", "").isdigit() or not headers.get("warc-type") or not headers.get("warc-record-id"):
        raise ValueError("no length, type or id")
    start, n = end + 4, int(headers["content-length"])
    if n > LONGEST_BLOCK:
        raise ValueError("block is longer than a reader holds")
    if not w.fill(start + n + 4) or w.peek(4, start + n) != b"\r\n\r\n":
        raise ValueError("block does not end where its length says")
    block = w.peek(n, start)
    digest = headers.get("warc-block-digest", "")
    if digest.startswith("sha1:") and digest[5:] != sha1_base32(block):
        raise ValueError("block digest differs")
    return (headers, block), start + n + 4


def salvage_plain(w: Window) -> Iterator[Record | Gap]:
    """Reads uncompressed records. After a failed check the next version line is searched for, from the byte after the
    failed record's start, and the bytes between are quarantined; a version line that begins no valid record fails in turn."""
    lost: list | None = None  # the gap that goes on
    while w.fill(1):
        try:
            found, n = _record_at(w)
        except ValueError as e:
            to = w.find(_VERSION, 1)
            at = w.at
            w.move(at + (to if to is not None else w_rest(w)))
            lost = [at if lost is None else lost[0], w.at, str(e) if lost is None else lost[2]]
            continue
        if lost:
            yield tuple(lost)
            lost = None
        yield found
        w.move(w.at + n)
    if lost:
        yield tuple(lost)


def w_rest(w: Window) -> int:
    """How many bytes are left, reading them all, piece by piece."""
    n = 0
    while w.fill(1):
        held = len(w.data) - (w.at - w.low)
        n += held
        w.move(w.at + held)
    w.move(w.at - n)
    return n


class _Member:
    """Inflates the gzip member at a window's place in bounded steps; tells where it ended and whether it is whole. Of a
    long member the window lets go what was inflated, so no member is held whole."""

    def __init__(self, w: Window):
        self.w, self.gz, self.piece, self.read, self.error = w, zlib.decompressobj(31), 4096, 0, ""

    def more(self) -> bytes:
        while not self.gz.eof and not self.error:
            tail = self.gz.unconsumed_tail
            data = tail or self.w.peek(self.piece, self.read)
            if not data:
                self.error = "gzip: member is cut"
                break
            if not tail:
                self.read += len(data)
                self.piece = min(2 * self.piece, 1 << 16)
                if self.read > 32 << 20:
                    self.w.move(self.w.at + self.read)
                    self.read = 0
            try:
                plain = self.gz.decompress(data, 1 << 18)
            except zlib.error as e:
                self.error = f"gzip: {e}"
                break
            if plain:
                return plain
        return b""

    @property
    def end(self) -> int:
        """The place after the member, once it has ended."""
        return self.w.at + self.read - len(self.gz.unused_data)


def _begins_member(w: Window, skip: int) -> bool:
    """Whether a gzip member that begins with a version line stands so far after the place (its first bytes inflate to one)."""
    try:
        return _VERSION.match(zlib.decompressobj(31).decompress(w.peek(4096, skip), 64)) is not None
    except zlib.error:
        return False


def salvage_members(w: Window) -> Iterator[Record | Gap]:
    """Reads gzip members one after another. Of a member that is cut or fails a check, the records that inflate whole and
    pass their own checks are kept; the rest is quarantined up to the next place where a member of records or a plain
    version line begins, from which reading goes on. Gaps are places of the file."""
    lost: list | None = None  # the gap that goes on

    def closed() -> Iterator[Gap]:
        nonlocal lost
        if lost:
            yield tuple(lost)
        lost = None

    while w.fill(1):
        at, reason = w.at, ""
        if _VERSION.match(w.peek(16)):
            try:
                found, n = _record_at(w)
                yield from closed()
                yield found
                w.move(at + n)
            except ValueError as e:
                reason = str(e)
        elif w.peek(3) == _MEMBER:
            member, kept, inner = _Member(w), 0, []
            for x in salvage_plain(Window(member.more)):
                if len(x) == 3:
                    inner.append(x)
                    continue
                if not kept:
                    yield from closed()
                kept += 1
                yield x
            while member.more():
                pass
            if member.error:
                reason = f"{member.error} ({kept} records of the member kept)" if kept else member.error
            else:
                w.move(member.end)
                for a, b, why in inner if not lost else []:
                    yield at, w.at, f"{why} (bytes {a} to {b} of the member)"
        else:
            reason = "no gzip member"
        if reason:
            skip = 1
            while (to := w.find(_BEGINNING, skip)) is not None and w.peek(3, to) == _MEMBER and not _begins_member(w, to):
                skip = to + 1
            to = w.at + (to if to is not None else w_rest(w))
            lost = [at if lost is None else lost[0], to, reason if lost is None else lost[2]]
            w.move(to)
    yield from closed()


def salvage_stream(more: Callable[[], bytes]) -> Iterator[Record | Gap]:
    """Records and quarantined gaps of an archive, in order, while it is read; gzipped by members, in one member, or plain."""
    w = Window(more)
    first = w.find(_BEGINNING)
    if first is None or (w.peek(3, first) != _MEMBER and w.peek(3) != _MEMBER):
        return salvage_plain(w)
    return salvage_members(w)


@dataclass
class Salvage:
    """What a reader found: records as (headers, block), and quarantined byte gaps as (start, end, reason)."""

    records: list[Record] = field(default_factory=list)
    gaps: list[Gap] = field(default_factory=list)


def salvage(data: bytes) -> Salvage:
    """``salvage_stream`` over bytes at hand."""
    out, pieces = Salvage(), iter([data[a : a + (1 << 16)] for a in range(0, len(data), 1 << 16)])
    for x in salvage_stream(lambda: next(pieces, b"")):
        (out.records if len(x) == 2 else out.gaps).append(x)
    return out


def write_archives(pages: DataFrame, folder: str, least_bytes: int = 0, archive_bytes: int = 8 << 20, level: int = 6) -> DataFrame:
    """Writes a record per page into gzipped archives of about ``archive_bytes`` of blocks; returns name and n_records.

    Of pages with equal payloads of at least ``least_bytes`` bytes, that with the smallest page_id is a response and the
    others revisit it. Null html is an empty payload. A null page_id never is the response of others unless no other id
    has the payload (then all such pages are responses); repeated rows of the smallest id are each a response.
    """
    payload = F.coalesce(F.encode(F.col("html").cast("string"), "UTF-8"), F.lit(b""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), payload.alias("payload")).withColumn("digest", F.unhex(F.sha1("payload")))
    firsts = rows.where(F.length("payload") >= least_bytes).groupBy("digest").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n")).where(F.col("n") > 1).select("digest", "first")
    # a payload that many pages have is dealt to SALTS places, and the one row that names its response copied to each
    dealt = rows.withColumn("salt", F.pmod(F.xxhash64("page_id", "url"), F.lit(SALTS)).cast("int"))
    marked = dealt.join(firsts.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))), ["digest", "salt"], "left").select("page_id", "url", "payload", F.when(F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first")), F.col("first")).alias("refers_to"))

    def archived(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, shard, members, held = TaskContext.get().partitionId(), 0, [], 0

        def close() -> pa.RecordBatch:
            name = f"part-{part:06d}-{shard:05d}.warc.gz"
            write_file(f"{folder}/{name}", b"".join(members))
            return pa.RecordBatch.from_pydict({"name": [name], "n_records": pa.array([len(members)], pa.int64())})

        for batch in parts_of(found, 500):
            for page_id, url, data, refers_to in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                gz = zlib.compressobj(level, zlib.DEFLATED, 31)
                members.append(gz.compress(record(page_id, url, data, refers_to)) + gz.flush())
                held += len(data)
                if held >= archive_bytes:
                    yield close()
                    shard, members, held = shard + 1, [], 0
        if members:
            yield close()

    batches(pages.sparkSession)
    return materialize(marked.mapInArrow(archived, "name string, n_records long"), "archives")


def _page(text: str | None) -> int | None:
    found = re.search(r"urn:x-page:(-?\d+)", text or "")
    return int(found[1]) if found else None


_FIELDS = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary, name string, gap_start long, gap_end long, reason string"


def _row(headers: dict[str, str], block: bytes, payloads: bool) -> tuple | None:
    kind = headers.get("warc-type", "")
    if kind not in ("response", "revisit"):
        return None
    head, _, payload = block.partition(b"\r\n\r\n")
    if kind == "response":
        return _page(headers.get("warc-record-id")), len(payload), sha1_base32(payload), kind, None, payload if payloads else None
    size = re.search(rb"(?i)\ncontent-length:\s*(\d+)", head)
    return _page(headers.get("warc-record-id")), int(size[1]) if size else None, headers.get("warc-payload-digest", "").removeprefix("sha1:"), kind, _page(headers.get("warc-refers-to")), None


def read_archives(spark: SparkSession, folder: str, payloads: bool = False) -> DataFrame:
    """Records and quarantined gaps of all archives of a folder, in one pass: page_id, payload_bytes, payload_digest,
    record_type, refers_to, with ``payloads`` the payload (null for revisits); and for a gap alone name, gap_start, gap_end
    and reason. Executors open the files themselves and read them in pieces, so an archive may be of any size."""
    types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary(), pa.string(), pa.int64(), pa.int64(), pa.string()]
    names = [x.split()[0] for x in _FIELDS.split(", ")]

    def read(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)
        for batch in found:
            for path in batch.column(0).to_pylist():
                rows, held = [], 0
                with open_file(path) as source:
                    for x in salvage_stream(lambda: source.read(1 << 20)):  # noqa: B023
                        if len(x) == 3:
                            rows.append((*[None] * 6, path.rpartition("/")[2], *x))
                        elif (row := _row(*x, payloads)) is not None:
                            rows.append((*row, *[None] * 4))
                            held += len(row[5] or b"")
                        if len(rows) >= 2000 or held > 4 << 20:
                            yield made(rows)
                            rows, held = [], 0
                if rows:
                    yield made(rows)

    batches(spark)
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc*").load(folder).select("path", "length")  # not the content
    return files.select("path").repartition(max(1, spark.sparkContext.defaultParallelism), "path").mapInArrow(read, _FIELDS)


def write_and_read(pages: DataFrame, folder: str) -> DataFrame:
    """Writes the pages' archives, and reads them back into a written table of records and gaps (``read_archives``)."""
    spark = pages.sparkSession
    if not write_archives(pages, folder).take(1):
        return spark.createDataFrame([], _FIELDS)
    return materialize(read_archives(spark, folder), "salvaged")


def op2(pages: DataFrame) -> DataFrame:
    """Writes a record per page, then reads the archives back: a row per page. An empty table writes no archive.

    Null html is an empty payload and is written like any other; null ids keep their rows; repeated rows of a payload's
    smallest id are each a response. Other columns than page_id, url and html, whatever their names, play no part. The
    gaps that the reader quarantined stand in the written table ``write_and_read`` returns, as rows with a reason; here
    only records are asked for.
    """
    found = write_and_read(pages, new_path(pages.sparkSession, "warc"))
    return found.where("reason IS NULL").select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLE = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages), f AS (SELECT h, min(page_id) AS first FROM p GROUP BY h),
d AS (SELECT page_id, h, sha1(h) || '0' AS x FROM p)
SELECT d.page_id, CAST(octet_length(encode(d.h)) AS BIGINT) AS payload_bytes,
array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + CAST(((16 * (strpos('0123456789abcdef', substr(d.x, 5 * i // 4 + 1, 1)) - 1) + strpos('0123456789abcdef', substr(d.x, 5 * i // 4 + 2, 1)) - 1) >> (3 - 5 * i % 4)) & 31 AS BIGINT), 1)), '') AS payload_digest,
CASE WHEN f.first <> d.page_id THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN f.first <> d.page_id THEN f.first END AS refers_to
FROM d JOIN f USING (h)
"""
