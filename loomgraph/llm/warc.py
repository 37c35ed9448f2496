"""WARC archives: writing with revisits, segmented records and chunked transfer framing, and reading back.

Writing.  Payloads are compared by SHA-256; of equal ones (of ``min_revisit`` bytes at least) the row with the
largest id is written as response, the others as revisits that refer to it.  A block longer than ``segment`` bytes
is cut into a first record and continuation records.  Tasks stream records into archives of about ``roll`` bytes,
one gzip member per record, under a name of the attempt, and rename them once complete, so a repeated task leaves
whole files.

Reading.  Tasks stream archives record by record, once.  A record is decoded where it is read, also a segmented one whose
segments an archive holds in order up to its end; of that, what was decoded and a hash of each segment are shuffled, to meet segments of
the same record elsewhere.  Other segments are shuffled themselves: they are grouped by the record they continue, ordered by
number, checked to be complete and of the stated total length, joined, and then decoded.  Chunked framing is removed and
the payload digest checked.

Defined results: null payload counts as empty; repeated or null ids are records of their own; a record with missing
or contradicting segments, bad framing or a wrong digest is returned with null payload and its ``error``; an archive that
is cut off, not compressed as it says or holds what is no record (lengths and numbers are digits only) gives the records before that and a row with an ``error``
alone, as does one that is not there; an empty table gives no archives and no records.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import RID, cut, filesystem, keyed, publish, scratch_path

CRLF = b"\r\n"
READ = "record_id string, record_type string, target_uri string, refers_to string, payload binary, payload_bytes bigint, payload_digest string, error string"
_READ_NAMES = [x.split()[0] for x in READ.split(", ")]
#: Loose segments have a number and a block; a record joined where it was read has neither, but READ columns and seals.
_SEGMENT = "origin string, number int, total bigint, head string, block binary, seals binary"


def digest(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def chunked(data: bytes, size: int = 8192) -> bytes:
    out = [b"%x\r\n%b\r\n" % (len(data[k : k + size]), data[k : k + size]) for k in range(0, len(data), size)]
    return b"".join(out) + b"0\r\n\r\n"


def number_of(text: bytes | str, base: int = 10) -> int:
    """A number of a header or chunk: digits only, where int() also takes signs, blanks and underscores."""
    if isinstance(text, bytes):
        text = text.decode("latin-1")
    if not re.fullmatch("[0-9a-fA-F]{1,15}" if base == 16 else "[0-9]{1,18}", text):
        raise ValueError(f"not a number: {text[:40]!r}")
    return int(text, base)


def unchunked(data: bytes) -> bytes:
    out, at = [], 0
    while True:
        end = data.index(CRLF, at)
        n = number_of(data[at:end].split(b";")[0].strip(b" \t"), 16)
        at = end + 2
        if n == 0:
            return b"".join(out)
        if len(data) < at + n + 2 or data[at + n : at + n + 2] != CRLF:
            raise ValueError("bad chunk")
        out.append(data[at : at + n])
        at += n + 2


def record(headers: list[tuple[str, str]], block: bytes) -> bytes:
    head = "".join(f"{k}: {v}\r\n" for k, v in [*headers, ("Content-Length", str(len(block)))])
    return b"WARC/1.1\r\n" + head.encode() + CRLF + block + CRLF + CRLF


def records_of(key: str, url: str | None, payload: bytes, sha1: str, refers: str | None, segment: int, date: str):
    """The records of one page."""
    common = [("WARC-Record-ID", f"<urn:page:{key}>"), ("WARC-Date", date), ("WARC-Target-URI", (url or "urn:none").replace("\r", "").replace("\n", "")), ("WARC-Payload-Digest", f"sha1:{sha1}"), ("Content-Type", "application/http; msgtype=response")]
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
    if refers is not None:
        more = [("WARC-Type", "revisit"), ("WARC-Refers-To", f"<urn:page:{refers}>"), ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")]
        yield record(more + common, http + b"Content-Length: %d\r\n\r\n" % len(payload))
        return
    block = http + b"Transfer-Encoding: chunked\r\n\r\n" + chunked(payload)
    parts = [block[k : k + segment] for k in range(0, len(block), segment)]
    first = [("WARC-Segment-Number", "1")] if len(parts) > 1 else []
    yield record([("WARC-Type", "response"), *common, *first], parts[0])
    for number, part in enumerate(parts[1:], 2):
        last = [("WARC-Segment-Total-Length", str(len(block)))] if number == len(parts) else []
        yield record([("WARC-Type", "continuation"), ("WARC-Record-ID", f"<urn:page:{key}:segment:{number}>"), ("WARC-Date", date), ("WARC-Segment-Origin-ID", f"<urn:page:{key}>"), ("WARC-Segment-Number", str(number)), *last], part)


def write_warc(pages: DataFrame, directory: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", segment: int = 32_768, roll: int = 64 << 20, min_revisit: int = 0, date: str = "2024-01-01T00:00:00Z") -> tuple[DataFrame, DataFrame]:
    """Archives in ``directory``, and ((path, records, bytes) of the archives, (key, id) of the records' names)."""
    rows, _ = keyed(pages.select(id_col, url_col, payload_col), id_col, payload_col)
    rows = rows.select(F.col(RID).alias("key"), F.col(id_col).alias("id"), F.col(url_col).cast("string").alias("url"), F.coalesce(F.col(payload_col).cast("binary"), F.lit(b"")).alias("payload"))
    same = F.sha2("payload", 256)
    groups = rows.filter(F.octet_length("payload") >= min_revisit).groupBy(same.alias("same")).agg(F.max("key").alias("kept"), F.count(F.lit(1)).alias("n")).filter("n > 1").select("same", "kept")
    told = rows.withColumn("same", same).join(cut(groups), "same", "left").select("key", "url", "payload", F.when((F.col("kept") != F.col("key")) & (F.octet_length("payload") >= min_revisit), F.col("kept")).alias("refers"))

    def write(batches):
        context = TaskContext.get()
        fs, root = filesystem(directory)
        fs.create_dir(root, recursive=True)
        paths, counts, sizes = [], [], []
        out, temp, n, size = None, "", 0, 0

        def close():
            out.close()
            final = f"{root}/part-{context.partitionId():05d}-{len(paths):05d}.warc.gz"
            publish(fs, temp, final)
            paths.append(final)
            counts.append(n)
            sizes.append(size)

        for b in batches:
            for i in range(b.num_rows):
                key, url, payload, refers = (b.column(k)[i].as_py() for k in range(4))
                if out is None:
                    temp, n, size = f"{root}/.attempt-{context.taskAttemptId()}-{len(paths)}", 0, 0
                    out = fs.open_output_stream(temp)
                for r in records_of(str(key), url, payload, digest(payload), None if refers is None else str(refers), segment, date):
                    z = zlib.compressobj(6, zlib.DEFLATED, 31)
                    data = z.compress(r) + z.flush()
                    out.write(data)
                    n, size = n + 1, size + len(data)
                if size >= roll:
                    close()
                    out = None
        if out is not None:
            close()
        yield pa.record_batch({"path": pa.array(paths, pa.string()), "records": pa.array(counts, pa.int64()), "bytes": pa.array(sizes, pa.int64())})

    files = cut(told.mapInArrow(write, "path string, records bigint, bytes bigint"))
    return files, rows.select(F.concat(F.lit("<urn:page:"), F.col("key").cast("string"), F.lit(">")).alias("record_id"), "id")


def bytes_of(stream, block: int = 1 << 15):
    """Decompressed pieces of an archive, which may be plain or of one or more gzip members."""
    z, first = None, True
    while data := stream.read(block):
        if first:
            z = zlib.decompressobj(31) if data[:2] == b"\x1f\x8b" else None
            plain, first = z is None, False
        if plain:
            yield data
            continue
        while data:
            yield z.decompress(data)
            data = z.unused_data
            if z.eof:
                z = zlib.decompressobj(31)
            elif not data:
                break


def parse(stream):
    """(headers with lower-case names, block) of each record; holds one record at a time."""
    buffer, pieces = bytearray(), bytes_of(stream)

    def fill(n: int) -> bool:
        while len(buffer) < n:
            p = next(pieces, None)
            if p is None:
                return False
            buffer.extend(p)
        return True

    while True:
        skip = 0
        while skip < len(buffer) or fill(skip + 1):  # line ends between records
            if buffer[skip] not in CRLF:
                break
            skip += 1
        else:
            return
        del buffer[:skip]
        while (end := buffer.find(b"\r\n\r\n")) < 0:
            if not fill(len(buffer) + 1):
                raise ValueError("archive ends within a record")
        lines = bytes(buffer[:end]).decode("utf-8", "replace").split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"not a WARC record: {lines[0][:40]!r}")
        headers = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
        if "content-length" not in headers:
            raise ValueError("record without a length")
        n = number_of(headers["content-length"])
        del buffer[: end + 4]
        if not fill(n):
            raise ValueError("archive ends within a record")
        block = bytes(buffer[:n])
        del buffer[:n]
        yield headers, block


def decoded(headers: dict[str, str], block: bytes) -> tuple:
    """A READ row from the headers and the whole block of a response or revisit."""
    kind, error, payload, size = headers.get("warc-type"), None, None, None
    told = headers.get("warc-payload-digest", "").removeprefix("sha1:") or None
    try:
        head, gap, body = block.partition(b"\r\n\r\n")
        if not gap:
            raise ValueError("no HTTP header")
        http = {k.strip().lower(): v.strip() for k, _, v in (x.partition(b":") for x in head.split(CRLF)[1:])}
        if kind == "revisit":
            size = number_of(http.get(b"content-length", b"0"))
        else:
            payload = unchunked(body) if http.get(b"transfer-encoding", b"").lower() == b"chunked" else body
            size, found = len(payload), digest(payload)
            if told not in (None, found):
                payload, size, error = None, None, "payload digest differs"
            told = found
    except ValueError as e:
        error = str(e)
    return headers.get("warc-record-id"), kind, headers.get("warc-target-uri"), headers.get("warc-refers-to"), payload, size, told, error


def reassembled(segments: list[tuple[int, int | None, str | None, bytes]], origin: str) -> tuple:
    """A READ row from the segments (number, total length, first record's headers, block) of one record."""
    by: dict[int, tuple] = {}
    head, error = {"warc-record-id": origin}, None
    for number, total, text, block in segments:
        if by.setdefault(number, (total, text, block)) != (total, text, block):
            error = "contradicting segments"
    if 1 in by and by[1][1]:
        head = dict(x.split(": ", 1) for x in by[1][1].split("\n"))
    totals = [t for t, _, _ in by.values() if t is not None]
    if error is None and (sorted(by) != list(range(1, len(by) + 1)) or len(totals) != 1 or by[max(by)][0] is None):
        error = "missing segments"
    whole = b"".join(by[k][2] for k in sorted(by))
    if error is None and len(whole) != totals[0]:
        error = "total length differs"
    if error:
        return origin, head.get("warc-type"), head.get("warc-target-uri"), head.get("warc-refers-to"), None, None, None, error
    return decoded(head, whole)


def seal(total: int | None, text: str | None, block: bytes) -> bytes:
    """Hash of what two segments of one number must have in common."""
    return hashlib.sha256(repr((total, text)).encode() + b"\0" + block).digest()


def agreed(whole: list[tuple[tuple, bytes]], loose: list[tuple[int, int | None, str | None, bytes]], origin: str) -> tuple:
    """A READ row from READ rows and seals of one record, at least one, each joined where it was read, and loose segments of it.

    The same as reassembled() gives for all their segments.
    """
    row, seals = whole[0]
    told = {k // 32 + 1: seals[k : k + 32] for k in range(0, len(seals), 32)}
    error = "missing segments" if any(number not in told for number, *_ in loose) else None
    among: dict[int, tuple] = {}
    for number, *rest in loose:
        if among.setdefault(number, tuple(rest)) != tuple(rest) or number in told and seal(*rest) != told[number]:
            error = "contradicting segments"
    if any(other != seals for _, other in whole):
        error = "contradicting segments"
    return (origin, *row[1:4], None, None, None, error) if error else row


def read_warc(files: DataFrame, path_col: str = "path", with_payload: bool = True) -> DataFrame:
    """Responses and revisits of the archives (paths as filesystem() takes them); see READ.

    What a task has read is kept in the shared folder, so archives are read once; without payloads only loose segments take room.
    """
    names = files.select(F.col(path_col).alias("path")).repartition(files.sparkSession.sparkContext.defaultParallelism, "path")
    kinds = [pa.string()] * 4 + [pa.binary(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.int32(), pa.int64(), pa.string(), pa.binary(), pa.binary()]
    columns = [*_READ_NAMES, *(x.split()[0] for x in _SEGMENT.split(", "))]
    none = (None,) * 6

    def shown(row: tuple) -> tuple:
        return row if with_payload else (*row[:4], None, *row[5:])

    def rows_of(path: str):
        fs, at = filesystem(path)
        if fs.get_file_info(at).type != pafs.FileType.File:
            yield (None,) * 7 + (f"{path}: no such archive",) + none, 0
            return
        held, of = [], None  # segments 1, 2, .. of a record that has not ended

        def loose():
            for segment in held:
                yield (None,) * 8 + (of, *segment, None), len(segment[-1])
            held.clear()

        with fs.open_input_stream(at, compression=None) as stream:
            try:
                for headers, block in parse(stream):
                    if "warc-segment-number" in headers:
                        number, total = number_of(headers["warc-segment-number"]), headers.get("warc-segment-total-length")
                        if number >= 2**31:
                            raise ValueError("segment number out of range")
                        origin = headers.get("warc-segment-origin-id") or headers.get("warc-record-id")
                        head = "\n".join(f"{k}: {v}" for k, v in headers.items()) if number == 1 else None
                        segment = (number, total and number_of(total), head, block)
                        if origin != of or number != len(held) + 1:
                            yield from loose()
                            of = origin
                        held.append(segment)
                        if origin is None or number != len(held):
                            yield from loose()
                        elif segment[1] is not None and segment[1] == sum(len(x[3]) for x in held):
                            row = shown(reassembled(held, origin))
                            seals = b"".join([seal(*x[1:]) for x in held])
                            held.clear()
                            yield row + (origin, None, None, None, None, seals), len(row[4] or b"") + len(seals)
                        elif segment[1] is not None:
                            yield from loose()
                    elif headers.get("warc-type") in ("response", "revisit", "resource"):
                        yield shown(decoded(headers, block)) + none, len(block)
                yield from loose()
            except (ValueError, zlib.error) as e:
                yield from loose()
                yield (None,) * 7 + (f"{path}: {e}",) + none, 0

    def read(batches):
        rows, size = [], 0
        for b in batches:
            for path in b.column(0).to_pylist():
                for row, more in rows_of(path):
                    rows.append(row)
                    size += more
                    if size > 8 << 20 or len(rows) >= 5_000:
                        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names=columns)
                        rows, size = [], 0
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names=columns)

    def table(rows):
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds[:8])], names=_READ_NAMES)

    def join(batches):
        """Segments come in order of origin: one record's are held at a time, and a bounded run of results."""
        here, whole, held, rows, size = None, [], [], [], 0

        def ended():
            return agreed(whole, held, here) if whole else shown(reassembled(held, here))

        for b in batches:
            for *row, origin, number, total, head, block, seals in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if (whole or held) and origin != here:
                    rows.append(ended())
                    size += sum(len(x[3]) for x in held) + sum(len(x[4] or b"") for x, _ in whole)
                    whole, held = [], []
                    if size > 8 << 20 or len(rows) >= 5_000:
                        yield table(rows)
                        rows, size = [], 0
                here = origin
                if seals is None:
                    held.append((number, total, head, block))
                else:
                    whole.append((tuple(row), seals))
        if whole or held:
            rows.append(ended())
        yield table(rows)

    kept = scratch_path(files.sparkSession, "warc-records")
    names.mapInArrow(read, f"{READ}, {_SEGMENT}").write.option("compression", "zstd").parquet(kept)
    found = files.sparkSession.read.schema(f"{READ}, {_SEGMENT}").parquet(kept)
    segments = found.filter("origin IS NOT NULL").repartition("origin").sortWithinPartitions("origin", "number")
    return found.filter("origin IS NULL").select(*_READ_NAMES).union(segments.mapInArrow(join, READ))
