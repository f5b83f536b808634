"""WARC archives of pages and the global history of their captures.

1. `write_archives`: a record for each page, composed of column functions and
   written by Spark's text writer; the blank line that ends a record is the line
   separator. Each task sorts its records by URL key, time and id first, so each
   file is a run of captures in order. No page is shuffled for it. Of pages with
   equal payloads of at least MIN_REVISIT bytes the one with the smallest id is
   written as response, the others as revisits that refer to it.
2. `read_archives`: records parsed file by file from a stream; a response whose
   payload does not match its length or digest, or a cut file, stops the read.
3. `capture_index`: the records' entries are dealt by ranges of (URL key, time,
   id); in each range a loser tree merges the pieces of the runs, so that a step
   costs one comparison a level. `place` numbers all captures from 0.

A range is held in memory, about RANGE_ROWS entries; ids and file places are part
of the ranges' keys, so a page captured very often makes several ranges.

Cases: a null html is an empty payload. Rows without id are responses and are not
referred to; all rows that share the smallest id of a payload are responses. A
null URL is left out (key empty); control characters and blanks of a URL are
percent-encoded. A null time is 1970-01-01. An empty table gives no records.
Columns besides page_id, url, html and captured are ignored.
"""

from __future__ import annotations

import gzip
from collections.abc import Iterator, Sequence
from hashlib import sha256
from io import BytesIO
from typing import BinaryIO

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from orderlens.llm.order import numbered
from orderlens.llm.store import saved

MIN_REVISIT = 100
RECORDS_PER_FILE = 5_000
RANGE_ROWS = 50_000
_END = "\r\n"
_URL = r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)([^#]*)"
_RECORD = (
    "archive string, offset long, page_id long, record_type string, refers_to long, url string, date string, "
    "payload_bytes long, payload_digest string, payload binary"
)


def url_key(url: Column) -> Column:
    """The host's labels from the last to the first, `)`, path and query; scheme, www, default port and fragment go."""
    host = F.lower(F.regexp_extract(url, _URL, 1))
    host = F.regexp_replace(F.regexp_replace(host, r"^www[0-9]*\.", ""), r":(80|443)$", "")
    labels = F.array_join(F.reverse(F.split(host, r"\.")), ",")
    rest = F.regexp_replace(F.regexp_extract(url, _URL, 2), "/$", "")
    return F.when(url.rlike(_URL), F.concat(labels, F.lit(")"), rest)).otherwise(F.coalesce(url, F.lit("")))


def _target(url: Column) -> Column:
    for sign in "\r\n\t ":
        url = F.replace(url, F.lit(sign), F.lit(f"%{ord(sign):02X}"))
    return url


def revisits(payloads: DataFrame) -> DataFrame:
    """(page_id, digest, refers_to) of the rows of (page_id, digest, size) that repeat the payload of a smaller id."""
    some = payloads.where((F.col("size") >= MIN_REVISIT) & F.col("page_id").isNotNull()).select("page_id", "digest")
    held = some.groupBy("digest").agg(F.min("page_id").alias("refers_to"), F.max("page_id").alias("last"))
    held = held.where("refers_to < last").drop("last")
    return some.join(held, "digest").where("page_id > refers_to").distinct()


def _records(pages: DataFrame) -> DataFrame:
    """(url_key, date, page_id, value): the text of every record, without the blank line behind it."""
    plain = pages.select(
        F.col("page_id").cast("long").alias("page_id"),
        _target(F.col("url").cast("string")).alias("url"),
        F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"),
        F.coalesce(F.date_format(F.col("captured").cast("timestamp_ntz"), "yyyy-MM-dd'T'HH:mm:ss"), F.lit("1970-01-01T00:00:00")).alias("date"),
    )
    hashed = plain.withColumn("digest", F.sha2(F.col("html").cast("binary"), 256)).withColumn("size", F.octet_length("html"))
    again = saved(revisits(saved(hashed.select("page_id", "digest", "size"), "payloads")), "revisits")
    rows = hashed.join(again, ["page_id", "digest"], "left")
    first = F.col("refers_to").isNull()
    http = F.concat(
        F.lit(f"HTTP/1.1 200 OK{_END}Content-Type: text/html; charset=utf-8{_END}Content-Length: "), F.col("size"), F.lit(_END * 2)
    )
    block = F.when(first, F.concat("http", "html")).otherwise(F.col("http"))
    head = F.concat_ws(
        _END,
        F.lit("WARC/1.1"),
        F.concat(F.lit("WARC-Type: "), F.when(first, F.lit("response")).otherwise(F.lit("revisit"))),
        F.concat(F.lit("WARC-Record-ID: <urn:page:"), F.coalesce(F.col("page_id").cast("string"), F.lit("")), F.lit(">")),
        F.concat(F.lit("WARC-Date: "), F.col("date"), F.lit("Z")),
        F.concat(F.lit("WARC-Target-URI: "), F.col("url")),
        F.concat(F.lit("WARC-Payload-Digest: sha256:"), F.col("digest")),
        F.when(~first, F.lit("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")),
        F.concat(F.lit("WARC-Refers-To: <urn:page:"), F.col("refers_to"), F.lit(">")),
        F.lit("Content-Type: application/http; msgtype=response"),
        F.concat(F.lit("Content-Length: "), F.octet_length("block")),
    )
    rows = rows.withColumn("http", http).withColumn("block", block)
    return rows.select(url_key(F.col("url")).alias("url_key"), "date", "page_id", F.concat(head, F.lit(_END * 2), "block").alias("value"))


def write_archives(pages: DataFrame, path: str) -> None:
    """Archives of `pages` (page_id, url, html, captured) below `path`, each a run in order of URL key, time and id."""
    runs = _records(pages).sortWithinPartitions("url_key", "date", "page_id").select("value")
    runs.write.option("lineSep", _END * 2).option("compression", "gzip").option("maxRecordsPerFile", RECORDS_PER_FILE).text(path)


def records(stream: BinaryIO) -> Iterator[tuple[int, dict[str, str], bytes]]:
    """(offset, header fields by lower-case name, block) of each record of an uncompressed archive."""
    while True:
        offset, line = stream.tell(), stream.readline()
        if not line:
            return
        if line == b"\r\n":
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"no record at {offset}")
        fields = {}
        while (line := stream.readline()) != b"\r\n":
            if not line:
                raise ValueError(f"record at {offset} is cut")
            name, _, value = line.decode().removesuffix(_END).partition(": ")
            fields[name.lower()] = value
        block = stream.read(int(fields["content-length"]))
        if len(block) != int(fields["content-length"]):
            raise ValueError(f"record at {offset} is cut")
        yield offset, fields, block


def _page(uri: str | None) -> int | None:
    number = (uri or "").removeprefix("<urn:page:").removesuffix(">")
    return int(number) if number else None


def _entry(fields: dict[str, str], block: bytes) -> tuple[int, str, bytes]:
    """Length, digest and bytes of the payload; of a revisit as its header states them."""
    head, _, payload = block.partition(b"\r\n\r\n")
    lengths = [line[15:] for line in head.split(b"\r\n") if line.lower().startswith(b"content-length:")]
    size, digest = int(lengths[0]), fields["warc-payload-digest"].removeprefix("sha256:")
    if fields["warc-type"] == "response" and (len(payload) != size or sha256(payload).hexdigest() != digest):
        raise ValueError(f"payload of {fields['warc-record-id']} does not match its length and digest")
    return size, digest, payload


def _parsed(payloads: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema(
            [("archive", pa.string()), ("offset", pa.int64()), ("page_id", pa.int64()), ("record_type", pa.string())]
            + [("refers_to", pa.int64()), ("url", pa.string()), ("date", pa.string()), ("payload_bytes", pa.int64())]
            + [("payload_digest", pa.string()), ("payload", pa.binary())]
        )
        for batch in batches:
            for path, content in zip(batch.column(0), batch.column(1)):
                rows, held = [], 0
                for offset, fields, block in records(gzip.GzipFile(fileobj=BytesIO(content.as_py()))):
                    size, digest, payload = _entry(fields, block)
                    kind = fields["warc-type"]
                    kept = payload if payloads and kind == "response" else None
                    who, where = _page(fields["warc-record-id"]), _page(fields.get("warc-refers-to"))
                    rows.append((path.as_py(), offset, who, kind, where, fields.get("warc-target-uri"), fields["warc-date"], size, digest, kept))
                    held += len(kept or b"")
                    if len(rows) == 2_000 or held > 1 << 24:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)], schema=schema)
                        rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)], schema=schema)

    return run


def read_archives(spark: SparkSession, path: str, payloads: bool = False) -> DataFrame:
    """A row for each record of the archives below `path`; with `payloads`, the responses' own bytes too."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInArrow(_parsed(payloads), _RECORD)


def restored(spark: SparkSession, path: str) -> DataFrame:
    """(page_id, payload) of every record with an id; revisits get the payload of the response they refer to."""
    read = read_archives(spark, path, payloads=True)
    own = read.where("record_type = 'response' and page_id is not null").select("page_id", "payload", "payload_digest")
    first = own.select(F.col("page_id").alias("refers_to"), "payload", "payload_digest").dropDuplicates(["refers_to", "payload_digest"])
    again = read.where("record_type = 'revisit'").select("page_id", "refers_to", "payload_digest")
    return own.select("page_id", "payload").unionByName(again.join(first, ["refers_to", "payload_digest"]).select("page_id", "payload"))


def merged(runs: Sequence[Sequence]) -> Iterator[tuple[int, int]]:
    """(run, place in it) of all elements of sorted runs in order, by a loser tree; equal ones by run.

    Inner node i of the tree keeps the run that lost there; node 0 has the winner.
    A run that is used up loses against all.
    """
    k = len(runs)
    at = [0] * k
    losers = [-1] * max(k, 1)

    def ahead(a: int, b: int) -> bool:
        if at[a] == len(runs[a]) or at[b] == len(runs[b]):
            return at[b] == len(runs[b])
        x, y = runs[a][at[a]], runs[b][at[b]]
        return x < y or (x == y and a < b)

    def play(run: int) -> None:
        node = (run + k) // 2
        while node:
            if losers[node] < 0:  # the first to come waits for the other side
                losers[node] = run
                return
            if ahead(losers[node], run):
                losers[node], run = run, losers[node]
            node //= 2
        losers[0] = run

    for run in range(k):
        play(run)
    for _ in range(sum(map(len, runs))):
        run = losers[0]
        yield run, at[run]
        at[run] += 1
        play(run)


def _merged_range(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held = [batch for batch in batches if batch.num_rows]
    if not held:
        return
    rows = pa.Table.from_batches(held)
    ids = [(i is not None, i or 0) for i in rows["page_id"].to_pylist()]
    keys = list(zip(rows["url_key"].to_pylist(), rows["date"].to_pylist(), ids))
    archives = rows["archive"].to_pylist()
    starts = [k for k in range(len(keys)) if not k or archives[k] != archives[k - 1]]
    runs = [list(range(lo, hi)) for lo, hi in zip(starts, [*starts[1:], len(keys)])]
    for run in runs:
        run.sort(key=keys.__getitem__)  # in order already, unless another writer made the archive
    order = [runs[run][place] for run, place in merged([[keys[k] for k in run] for run in runs])]
    yield from rows.take(pa.array(order, pa.int64())).to_batches(10_000)


def capture_index(entries: DataFrame) -> DataFrame:
    """`entries` (as read_archives gives them, without payload) with url_key and place, their number in global order."""
    keyed = saved(entries.drop("payload").withColumn("url_key", url_key(F.col("url"))), "capture-runs")
    ranges = max(1, -(-keyed.count() // RANGE_ROWS))
    dealt = keyed.repartitionByRange(ranges, "url_key", "date", "page_id", "archive", "offset")
    in_order = dealt.sortWithinPartitions("archive", "offset").mapInArrow(_merged_range, keyed.schema)
    out = numbered(in_order.withColumn("__all", F.lit(0)), "__all", "captures")
    return out.withColumnRenamed("position", "place").drop("__all", "n")
