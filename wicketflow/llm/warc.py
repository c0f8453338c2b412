"""WARC archives: writing them, and reading them back with segment reassembly.

Writing: each page becomes a response record, or a revisit record where another page with the same payload is the
response. Record ids hold the page id and the payload's digest, and a running number where a row repeats both, so that
no two records share one. A response's block is an HTTP message in chunked transfer framing; a block above segment_bytes is cut into a first record and
continuation records (WARC 1.1, section 7). Spark's text writer writes the files.

Reading: Spark's text reader streams the files and cuts them at ``CR LF CR LF WARC/1.``; pieces are joined again until
Content-Length is met, so payloads may contain that mark. A file has to be read from its first byte for that: archives that
aren't compressed and are longer than a split of the reader are refused. Segments are grouped by the id of their origin, ordered by segment
number, checked for gaps and against the total length, and the chunked framing of the whole block is decoded.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wicketflow.llm.common import python_ready, small_side, staged, utf8

#: What a written record's id holds: the page id and the payload's digest.
RECORD_ID = r"^<urn:page:([^:]*):([0-9a-f]{40})(?::\d+)?>$"

#: Payloads under so many bytes are always written in full.
REVISIT_BYTES = 1000
SEGMENT_BYTES, CHUNK_BYTES = 16 << 10, 4 << 10
END = b"\r\n\r\n"
MARK = "\r\n\r\nWARC/1."


class WarcError(ValueError):
    """A record, its segments or its framing don't fit together."""


def chunked(payload: bytes, size: int = CHUNK_BYTES) -> bytes:
    """payload in chunked transfer framing."""
    parts = []
    for i in range(0, len(payload), size):
        part = payload[i : i + size]
        parts += [b"%x\r\n" % len(part), part, b"\r\n"]
    return b"".join([*parts, b"0\r\n\r\n"])


def unchunked(body: bytes) -> bytes:
    """The payload of a body in chunked transfer framing; chunk extensions and trailers are passed over."""
    out, at = [], 0
    while True:
        end = body.find(b"\r\n", at)
        try:
            size = int(body[at : max(end, at)].split(b";")[0].strip(), 16)
        except ValueError as e:
            raise WarcError(f"no chunk size at {at}") from e
        if size == 0:
            return b"".join(out)
        at = end + 2
        if size < 0 or body[at + size : at + size + 2] != b"\r\n":
            raise WarcError(f"chunk at {at} isn't {size} bytes long")
        out.append(body[at : at + size])
        at += size + 2


def payload_of(block: bytes) -> bytes:
    """The payload of an HTTP message."""
    head, mark, body = block.partition(END)
    if not mark:
        raise WarcError("no end of the HTTP header")
    return unchunked(body) if re.search(rb"^transfer-encoding:\s*chunked\s*$", head, re.I | re.M) else body


def _record(kind: str, headers: dict[str, str], block: bytes) -> bytes:
    head = "".join(f"{k}: {v}\r\n" for k, v in {"WARC-Type": kind, **headers, "Content-Length": str(len(block))}.items())
    return b"WARC/1.1\r\n" + head.encode("utf-8") + b"\r\n" + block


def response_records(record_id: str, headers: dict[str, str], payload: bytes, segment: int, chunk: int) -> Iterator[bytes]:
    """A response record, cut into segments if its block is longer than segment bytes."""
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n" + chunked(payload, chunk)
    if len(block) <= segment:
        yield _record("response", {"WARC-Record-ID": record_id, **headers}, block)
        return
    parts = [block[i : i + segment] for i in range(0, len(block), segment)]
    yield _record("response", {"WARC-Record-ID": record_id, "WARC-Segment-Number": "1", **headers}, parts[0])
    for n, part in enumerate(parts[1:], 2):
        own = {"WARC-Record-ID": f"{record_id[:-1]}/{n}>", "WARC-Segment-Origin-ID": record_id, "WARC-Segment-Number": str(n)}
        own |= {k: v for k, v in headers.items() if k in ("WARC-Date", "WARC-Target-URI")}
        yield _record("continuation", own | ({"WARC-Segment-Total-Length": str(len(block))} if n == len(parts) else {}), part)


def write_archives(
    pages: DataFrame,
    path: str,
    *,
    page_id: str = "page_id",
    url: str = "url",
    html: str = "html",
    date: str = "2024-01-01T00:00:00Z",
    segment_bytes: int = SEGMENT_BYTES,
    chunk_bytes: int = CHUNK_BYTES,
) -> None:
    """Writes a record for each row of pages as gzip files under path.

    Of rows with equal payloads of REVISIT_BYTES or more, the one with the largest id is the response and the others
    revisit it; rows that repeat that id with that payload are all responses, of which revisits name the first. Rows that
    repeat an id with other payloads are records of their own. A null html is an empty payload; a null id or url is written
    as ``null`` and an empty URI. Other columns are not read. A payload's revisits are decided on ids and digests alone; a
    hot payload is a skewed join key, which Spark splits. A task writes one file.
    """
    python_ready(pages.sparkSession)
    body = utf8(F.col(f"`{html}`"))
    rows = pages.select(
        F.coalesce(F.url_encode(F.col(f"`{page_id}`").cast("string")), F.lit("null")).alias("id"),
        F.col(f"`{page_id}`").alias("order"),
        F.regexp_replace(F.coalesce(F.col(f"`{url}`"), F.lit("")), r"\s", "%20").alias("url"),
        body.alias("payload"),
        F.sha1(body).alias("digest"),
        F.monotonically_increasing_id().alias("row"),
    )
    long = F.length("payload") >= REVISIT_BYTES
    # one row for each id and payload, then those that payloads or rows repeat
    each = staged(rows.groupBy("digest", "id").agg(F.first("order").alias("order"), F.min("row").alias("first"), F.count("*").alias("n"), F.max(long).alias("long")), "payloads")
    winners = each.where("long").groupBy("digest").agg(F.max(F.struct("order", "id")).alias("w"), F.count("*").alias("ids")).where("ids > 1")
    winners = winners.select("digest", F.col("w.id").alias("winner"))
    repeats = each.where("n > 1").select(F.col("digest").alias("digest_"), F.col("id").alias("id_"), "first")
    decided = rows.join(small_side(winners, "winners"), "digest", "left")
    decided = decided.join(small_side(repeats, "repeats"), (F.col("digest") == F.col("digest_")) & (F.col("id") == F.col("id_")), "left")
    refers = F.when(long & (F.col("id") != F.col("winner")), F.concat(F.lit("<urn:page:"), "winner", F.lit(":"), "digest", F.lit(">")))
    number = F.when(F.col("row") != F.col("first"), F.concat(F.lit(":"), F.col("row").cast("string"))).otherwise("")
    record_id = F.concat(F.lit("<urn:page:"), "id", F.lit(":"), "digest", number, F.lit(">"))
    decided = decided.select(record_id.alias("record_id"), "url", "digest", refers.alias("refers"), F.when(refers.isNull(), F.col("payload")).alias("payload"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for own, uri, digest, refers, payload in zip(*(c.to_pylist() for c in batch.columns)):
                common = {"WARC-Date": date, "WARC-Target-URI": uri, "Content-Type": "application/http; msgtype=response", "WARC-Payload-Digest": f"sha1:{digest}"}
                if refers is None:
                    out.extend(response_records(own, common, payload, segment_bytes, chunk_bytes))
                else:
                    profile = {"WARC-Profile": "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", "WARC-Refers-To": refers}
                    out.append(_record("revisit", {"WARC-Record-ID": own, **common, **profile}, b"HTTP/1.1 200 OK\r\n\r\n"))
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["record"])

    records = decided.mapInArrow(run, "record binary")
    records.select(F.col("record").cast("string").alias("value")).write.option("lineSep", "\r\n\r\n").option("compression", "gzip").text(path)


def _stitched(pieces: Iterator[bytes]) -> Iterator[tuple[dict[str, str], bytes]]:
    """Records (headers, block) from the pieces between marks, in the order of the file.

    A block that is longer or, at the file's end, shorter than its Content-Length raises WarcError.
    """
    mark = MARK.encode()
    held: list[bytes] = []  # the pieces of the record so far
    headers, size, have = None, 0, 0
    for piece in pieces:
        todo: bytes | None = piece
        while todo is not None:
            held.append(mark + todo if held else todo.removeprefix(b"WARC/1."))
            todo = None
            if headers is None:
                head, end, block = b"".join(held).partition(END)
                if not end:
                    break
                headers = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in head.decode("utf-8", "replace").split("\r\n")[1:])}
                held, have = [block], len(block)
                try:
                    size = int(headers.get("content-length", ""))
                except ValueError as e:
                    raise WarcError(f"no Content-Length in {headers}") from e
            else:
                have += len(held[-1])
            if have >= size:
                block = b"".join(held)
                rest = block[size:]
                if rest.startswith(mark):  # the text reader has overlooked a mark at the end of its buffer
                    todo = rest[len(mark) :]
                elif rest.strip():
                    raise WarcError(f"{headers.get('warc-record-id')} is longer than its Content-Length of {size}")
                yield headers, block[:size]
                held, headers = [], None
    if headers is not None or any(x.strip() for x in held):
        raise WarcError("the last record is shorter than its Content-Length")


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """(record_id, record_type, target_uri, payload_digest, refers_to, payload) of each response and revisit under path.

    Segments are joined and framing is decoded; a gap, a wrong length or broken framing fails the job with WarcError, and
    so does a file without compression that Spark would read in several splits (compress it, or raise
    spark.sql.files.maxPartitionBytes). A revisit's payload is null. Other record types are passed over. Each file is read
    by one task as a stream: memory follows the longest record.
    """
    python_ready(spark)
    text = spark.read.option("lineSep", MARK).text(path)
    pieces = text.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("at"), F.col("value").cast("binary").alias("piece"))

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def runs() -> Iterator[tuple[str, bytes]]:
            for batch in batches:
                if any(batch.column(1).to_pylist()):
                    raise WarcError(f"{batch.column(0)[0]} isn't compressed and is longer than a split")
                yield from zip(batch.column(0).to_pylist(), batch.column(2).to_pylist())

        rows: list[tuple] = []
        source, own = None, []

        def flush(last: bool) -> Iterator[pa.RecordBatch]:
            if rows and (last or sum(len(r[-1] or b"") for r in rows) > 4 << 20 or len(rows) >= 1000):
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), _TYPES)], names=_NAMES)
                rows.clear()

        def one_file(first: bytes) -> Iterator[bytes]:
            nonlocal source, own
            yield first
            for file, piece in stream:
                if file != source:
                    source, own = file, [piece]
                    return
                yield piece
            own = []

        stream = runs()
        if (start := next(stream, None)) is not None:
            source, own = start[0], [start[1]]
        while own:
            for headers, block in _stitched(one_file(own.pop())):
                if headers.get("warc-type") in ("response", "revisit", "continuation"):
                    rows.append(_row(headers, block))
                yield from flush(False)
        yield from flush(True)

    records = pieces.mapInArrow(parse, _SCHEMA)
    whole = records.where("segment is null")
    origin = F.coalesce("origin", "record_id")
    segments = F.sort_array(F.collect_list(F.struct("segment", "total", "block")))
    first = F.first(F.when(F.col("segment") == 1, F.struct("record_type", "target_uri", "payload_digest", "refers_to")), ignorenulls=True)
    grouped = records.where("segment is not null").groupBy(origin.alias("record_id")).agg(first.alias("head"), segments.alias("segments"))

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            k = batch.schema.get_field_index("segments")
            blocks = [reassembled(x) for x in batch.column(k).to_pylist()]
            keep = [c for i, c in enumerate(batch.columns) if i != k]
            yield pa.RecordBatch.from_arrays([*keep, pa.array(blocks, pa.binary())], names=[*(n for n in batch.schema.names if n != "segments"), "block"])

    names = ["record_id", "record_type", "target_uri", "payload_digest", "refers_to"]
    flat = grouped.select("record_id", *[F.col(f"head.{n}").alias(n) for n in names[1:]], "segments")
    joined = flat.mapInArrow(join, ", ".join(f"{n} string" for n in names) + ", block binary")

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            blocks = [None if kind == "revisit" else payload_of(b) for kind, b in zip(batch.column(1).to_pylist(), batch.column(5).to_pylist())]
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(blocks, pa.binary())], names=[*names, "payload"])

    schema = ", ".join(f"{n} string" for n in names) + ", payload binary"
    return whole.select(*names, "block").unionByName(joined).mapInArrow(decode, schema)


_NAMES = ["record_id", "record_type", "target_uri", "payload_digest", "refers_to", "origin", "segment", "total", "block"]
_TYPES = [pa.string()] * 6 + [pa.int32(), pa.int64(), pa.binary()]
_SCHEMA = "record_id string, record_type string, target_uri string, payload_digest string, refers_to string, origin string, segment int, total long, block binary"


def _row(headers: dict[str, str], block: bytes) -> tuple:
    number, total = headers.get("warc-segment-number"), headers.get("warc-segment-total-length")
    names = ("warc-record-id", "warc-type", "warc-target-uri", "warc-payload-digest", "warc-refers-to", "warc-segment-origin-id")
    return *map(headers.get, names), int(number) if number else None, int(total) if total else None, block


def reassembled(segments: list[dict]) -> bytes:
    """The block of a record from its segments (segment, total, block) in order."""
    if [s["segment"] for s in segments] != list(range(1, len(segments) + 1)):
        raise WarcError(f"segments {[s['segment'] for s in segments]}")
    block = b"".join(s["block"] for s in segments)
    if segments[-1]["total"] != len(block):
        raise WarcError(f"total length {segments[-1]['total']}, found {len(block)}")
    return block


def resolved(records: DataFrame) -> DataFrame:
    """records with payload_bytes and sha1, a revisit's being those of the response that it refers to (null: not there)."""
    first = F.regexp_replace("record_id", r"^(<urn:page:[^:]*:[0-9a-f]{40}):\d+>$", "$1>")
    sized = records.select("record_id", "record_type", "refers_to", "payload_digest", F.length("payload").cast("long").alias("n"), F.when(F.col("payload").isNotNull(), F.sha1("payload")).alias("sha1"))
    sized = staged(sized, "sized")
    rows = sized.where("record_type = 'response'")
    # only revisits are joined, and with a table of their responses, so that a hot one is split like any skewed key
    known = rows.groupBy(first.alias("refers_to")).agg(F.max(F.struct("n", "sha1")).alias("known"))
    revisits = sized.where("record_type = 'revisit'").join(staged(known, "responses"), "refers_to", "left").withColumn("n", F.col("known.n")).withColumn("sha1", F.col("known.sha1"))
    return rows.unionByName(revisits.drop("known")).select("record_id", "record_type", "refers_to", "payload_digest", F.col("n").alias("payload_bytes"), "sha1")
