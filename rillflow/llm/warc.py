"""WARC archives: written by Spark's text sink, read back in parallel with verified record boundaries.

Writing: one record per page. Of equal payloads of at least SHORTEST bytes, the pages of largest
page_id are responses and the others revisits that refer to it; shorter payloads are always responses.
Null html is the empty payload; a null url has no target; control characters and spaces in urls are
escaped; a null page_id is carried, and counts as smaller than any other. Rows of equal page_id and
payload are all responses. Urls and payloads of any length are written and read whole; an empty table
writes no record. Only page_id, url and html are read, whatever other columns there are.

Reading: files are cut into blocks. A task finds every record magic of its block, also those inside
payloads, takes each for a record, and emits the candidate with the offset at which its chain of
successors leaves the block. Pointer jumping from offset 0 of each file then keeps the candidates that
true chains enter blocks by, doubling the distance each round, and each block is read from its entry.
Memory is one block and one record. A file whose chain breaks yields the records before the break; an
empty file yields none.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import broadcast_if, drop_written, filesystem, fresh_path, join_known, written

SHORTEST = 1000
BLOCK, AHEAD = 4 << 20, 64 << 10  # bytes; AHEAD is read beyond a block at first, and more where a header goes on
MOST_GROUPS = 500_000
MAGIC = b"WARC/1."
NEWLINE, END, BLANK = "\r\n", "\r\n\r\n", b"\r\n\r\n"
LENGTH = re.compile(rb"\r\nContent-Length:[ \t]*(\d{1,18})[ \t]*\r\n", re.I)
PAGE = re.compile(r"<urn:x-page:(-?\d+)>")


def write(pages: DataFrame, folder: str, date: str = "1970-01-01T00:00:00Z") -> str:
    """Writes pages (page_id, url, html) as WARC files into a new folder; returns the folder."""
    html = F.coalesce(F.col("html").cast("string"), F.lit(""))
    page = F.col("page_id").cast("long")
    rows = pages.select(
        page.alias("page_id"), F.col("url").cast("string").alias("url"), html.alias("html"), F.octet_length(html).alias("n"),
        F.sha1(html.cast("binary")).alias("digest")
    )
    equal = rows.where(F.col("n") >= SHORTEST).groupBy("digest").agg(F.max("page_id").alias("first"), F.count(F.lit(1)).alias("m")).where("m > 1 AND first IS NOT NULL").select(F.col("digest").alias("_d"), "first")
    rows = join_known(rows, written(equal.withColumnRenamed("_d", "digest"), "payloads"), ["digest"], MOST_GROUPS, "left")
    rows = rows.withColumn("first", F.when(F.col("n") >= SHORTEST, F.col("first")))
    again = F.col("first").isNotNull() & (F.col("page_id").isNull() | (F.col("page_id") < F.col("first")))
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit(NEWLINE))
    urn = lambda c: F.concat(F.lit("<urn:x-page:"), F.coalesce(c.cast("string"), F.lit("null")), F.lit(">"))
    url = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.regexp_replace("url", "\r", "%0D"), "\n", "%0A"), " ", "%20"), r"[\x00-\x1F\x7F]", "%00")
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("n").cast("string"), F.lit(END))
    block = F.when(again, http).otherwise(F.concat(http, F.col("html")))
    record = F.concat(
        F.lit("WARC/1.1\r\n"), F.when(again, line("WARC-Type", F.lit("revisit"))).otherwise(line("WARC-Type", F.lit("response"))), line("WARC-Record-ID", urn(F.col("page_id"))), line("WARC-Date", F.lit(date)),
        F.coalesce(line("WARC-Target-URI", url), F.lit("")), line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))), line("X-Payload-Length", F.col("n").cast("string")),
        F.when(
            again,
            F.concat(line("WARC-Profile", F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")), line("WARC-Refers-To", urn(F.col("first"))))
        ).otherwise(""),
        line("Content-Type", F.lit("application/http; msgtype=response")), line("Content-Length", F.octet_length("_block").cast("string")), F.lit(NEWLINE), F.col("_block"),
    )
    rows.withColumn("_block", block).select(record.alias("value")).write.option("lineSep", END).text(folder)
    return folder


def with_header(f, data: bytes, start: int, at: int, size: int) -> bytes:
    """data, read from f at start, and what follows it until the header at `at` is whole or the file ends."""
    seen = at
    while data.find(BLANK, seen) < 0 and start + len(data) < size:
        seen = max(at, len(data) - len(BLANK) + 1)
        data += f.read_at(min(max(AHEAD, len(data) - at), size - start - len(data)), start + len(data))
    return data


def headers(data: bytes, at: int, upto: int):
    """(offset, end of the header, length of the block) of each magic from `at` to before upto that has a whole header.

    What is found once serves all magics before it, so that many magics in one long stretch take no longer.
    """
    end, found = -1, None
    while 0 <= (at := data.find(MAGIC, at)) < upto:
        new = end < at
        if new and (end := data.find(BLANK, at)) < 0:
            return
        if new or found and found.start() < at:
            found = LENGTH.search(data, at, end + 2)
        if found:
            yield at, end + len(BLANK), int(found[1])
        at += 1


def _whole_uri(path: str) -> str:
    return re.sub(r"^file:/(?!/)", "file:///", path)


def candidates(files: DataFrame, block: int = BLOCK) -> DataFrame:
    """(file, path, off, leave, size): every magic of files (path, length), and where its chain leaves its block (null: it breaks)."""

    def task(batches):
        for batch in batches:
            for path, size, start in zip(*(batch.column(i).to_pylist() for i in range(3))):
                end = min(start + block, size)
                fs, name = filesystem(_whole_uri(path))
                with fs.open_input_file(name) as f:
                    data = f.read_at(min(end + AHEAD, size) - start, start)
                    if (last := data.rfind(MAGIC, 0, end - start + len(MAGIC) - 1)) >= 0:
                        data = with_header(f, data, start, last, size)
                nexts = {at: head + length + len(END) for at, head, length in headers(data, 0, end - start)}
                leave: dict[int, int | None] = {}
                for off in reversed(nexts):  # successors lie behind, so theirs are known
                    to = nexts[off]
                    leave[off] = (start + to if start + to <= size else None) if to >= end - start else leave.get(to)
                offs = sorted(leave)
                yield pa.RecordBatch.from_pydict({"path": pa.array([path] * len(offs), pa.string()), "off": pa.array([start + o for o in offs], pa.int64()), "leave": pa.array([leave[o] for o in offs], pa.int64()), "size": pa.array([size] * len(offs), pa.int64())})

    starts = files.where("length > 0").select("path", "length", F.explode(F.sequence(F.lit(0).cast("long"), F.col("length") - 1, F.lit(block).cast("long"))).alias("start"))
    found = starts.repartition("path", "start").mapInArrow(task, "path string, off long, leave long, size long")
    return found.select(F.xxhash64("path").alias("file"), "*")


def entries(found: DataFrame) -> DataFrame:
    """(file, path, off, size) of the candidates by which the chains from offset 0 enter the blocks: pointer jumping."""
    ends = found.where("leave IS NOT NULL AND leave < size").select("file", F.col("leave").alias("off")).distinct()
    doors = written(found.join(ends, ["file", "off"], "left_semi").unionByName(found.where("off = 0")).distinct(), "doors")
    known = doors.select("file", "off")
    jump = doors.where("leave IS NOT NULL AND leave < size").select("file", "off", F.col("leave").alias("to")).join(known.withColumnRenamed("off", "to"), ["file", "to"], "left_semi").select("file", "off", "to")
    jump = written(jump, "jump")
    reached = written(known.where("off = 0").distinct(), "reached")
    while not jump.isEmpty():
        further = reached.join(jump, ["file", "off"]).select("file", F.col("to").alias("off"))
        old, reached = reached, written(reached.unionByName(further).distinct(), "reached")
        second = jump.select("file", F.col("off").alias("to"), F.col("to").alias("beyond"))
        older, jump = jump, written(jump.join(second, ["file", "to"]).select("file", "off", F.col("beyond").alias("to")), "jump")
        drop_written(old)
        drop_written(older)
    return doors.select("file", "path", "off", "size").join(reached, ["file", "off"]).distinct()


def read(spark: SparkSession, folder: str, block: int = BLOCK, payloads: bool = True) -> DataFrame:
    """The records of all files in folder: page_id, type, uri, refers_to, payload_bytes, payload_digest, payload, intact.

    payload is the HTTP body of a response (null without `payloads`, and for revisits); length and
    digest of a response are taken from it, of a revisit from its header. intact: header and body agree.
    """
    files = spark.read.format("binaryFile").load(folder).select("path", "length")

    def task(batches):
        for batch in batches:
            for path, start, size in zip(*(batch.column(i).to_pylist() for i in range(3))):
                fs, name = filesystem(_whole_uri(path))
                with fs.open_input_file(name) as f:
                    end = min((start // block + 1) * block, size)
                    data, at, out = f.read_at(min(end + AHEAD, size) - start, start), 0, []
                    while start + at < end and data.startswith(MAGIC, at):
                        data = with_header(f, data, start, at, size)
                        if not (found := next(headers(data, at, at + 1), None)):
                            break
                        _, head, length = found
                        stop = head + length
                        if start + stop + len(END) > size:
                            break
                        body = data[head:stop] if stop <= len(data) else data[head:] + f.read_at(stop - len(data), start + len(data))
                        out.append(_record(data[at:head], body, payloads))
                        at = stop + len(END)
                if out:
                    columns = list(zip(*out))
                    kinds = (pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.binary(), pa.bool_())
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(c, k) for c, k in zip(columns, kinds)],
                        ["page_id", "type", "uri", "refers_to", "payload_bytes", "payload_digest", "payload", "intact"]
                    )

    doors = entries(written(candidates(files, block), "candidates")).select("path", "off", "size").repartition("path", "off")
    return doors.mapInArrow(task, "page_id long, type string, uri string, refers_to long, payload_bytes long, payload_digest string, payload binary, intact boolean")


def _record(header: bytes, body: bytes, payloads: bool) -> tuple:
    lines = header.decode("utf-8", "replace").split(NEWLINE)[1:]
    fields = {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in lines if x)}
    kind = fields.get("warc-type")
    page = lambda name: int(m[1]) if (m := PAGE.fullmatch(fields.get(name, ""))) else None
    told = (int(fields["x-payload-length"]) if fields.get("x-payload-length", "").isdigit() else None, fields.get("warc-payload-digest", "").removeprefix("sha1:").lower() or None)
    payload, n, digest, intact = None, *told, True
    if kind != "revisit":
        payload = body.partition(b"\r\n\r\n")[2] if "msgtype=response" in fields.get("content-type", "") else body
        n, digest = len(payload), hashlib.sha1(payload).hexdigest()
        intact = all(t is None or t == x for t, x in zip(told, (n, digest)))
    return page("warc-record-id"), kind, fields.get("warc-target-uri"), page("warc-refers-to"), n, digest, payload if payloads else None, intact


def round_trip(pages: DataFrame) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) of pages, from archives written and read back."""
    folder = write(pages, fresh_path(pages.sparkSession, "warc"))
    back = read(pages.sparkSession, folder, payloads=False)
    return back.select("page_id", "payload_bytes", "payload_digest", F.col("type").alias("record_type"), "refers_to", "intact")
