"""WARC archives: writing, reading back, and a global capture index merged from sorted runs.

Writing uses Spark's own text writer (a record ends in two line breaks, which is its line separator), so archives lie
in any store that Spark reaches. They are not compressed: offset and length of a record in the index are those in the
file, so a reader can seek to it. Files hold about ``RUN_BYTES`` of payload, so payloads of a size class share a file
and a very large one has its own. A payload that several captures share is stored once: the capture with the largest
id is the response, the others are revisits that keep its HTTP headers and refer to it.

Reading yields one index run per archive file, sorted by URL key, time and id. The runs are cut into ranges of that
key and each range is merged by a loser tree over its k runs, so the partitions of the result, in order, are the global
capture history. The ranges split a very common URL too, as time and id are part of the key.

Cases: a null payload is empty; a null URL is empty; repeated rows are repeated records; of several captures with the
largest id and the same payload each is a response; a null id is written as ``null`` and read back as null; a payload
may be as long as a string of Spark can be (2 GB, the record with it); an empty table gives an archive without records
and an empty index; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from brambling.llm.storage import written

BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Payload bytes of a file, the classes of payloads (bytes, from below) that share files, and index rows that a task merges.
RUN_BYTES, CLASSES, RANGE_ROWS = 64 << 20, (0, 16 << 10, 256 << 10, 4 << 20, 64 << 20), 100_000
INDEX = "url_key string, time string, page_id long, record_type string, refers_to long, payload_digest string, payload_bytes long, url string, run string, offset long, length long"


def base32_of_hex(digest: Column) -> Column:
    """Base32 of a hexadecimal SHA-1: five hexadecimal digits are four characters."""
    five = lambda k: F.conv(F.substr(digest, F.floor(k / 4).cast("int") * 5 + 1, F.lit(5)), 16, 10).cast("long")
    place = lambda k: (F.floor(five(k) / F.pow(F.lit(2.0), 15 - 5 * (k % 4))) % 32).cast("int") + 1
    return F.array_join(F.transform(F.sequence(F.lit(0), F.lit(31)), lambda k: F.substr(F.lit(BASE32), place(k), F.lit(1))), "")


def write_archive(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", time_col: str | None = None, least_bytes: int = 0) -> None:
    """Writes ``pages`` as WARC files. Equal payloads of ``least_bytes`` or more become revisits of one response.

    Without ``time_col`` (a timestamp) the id counts as seconds, so ids give the order of captures.
    """
    payload = F.coalesce(F.col(payload_col).cast("string"), F.lit(""))
    when = F.col(time_col).cast("timestamp") if time_col else F.timestamp_seconds(F.pmod(F.coalesce(F.col(id_col).cast("long"), F.lit(0)), F.lit(4_000_000_000)))
    rows = pages.select(
        F.col(id_col).cast("long").alias("id"),
        F.regexp_replace(F.coalesce(F.col(url_col).cast("string"), F.lit("")), "[\r\n]", " ").alias("url"),
        F.date_format(when, "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("time"),
        F.octet_length(payload).alias("n"),
        F.sha1(F.encode(payload, "UTF-8")).alias("sha1"),
        payload.alias("payload"),
    )
    shared = written(rows.filter(F.col("n") >= least_bytes).groupBy("sha1").agg(F.max("id").alias("first"), F.count(F.lit(1)).alias("copies")).filter("copies > 1").drop("copies"), "shared-payloads")
    largest = rows.agg(F.max("n")).first()[0] or 0
    for low, high in zip(CLASSES, [*CLASSES[1:], None]):
        if low and low > largest:
            break
        mine = rows.filter((F.col("n") >= low) & (F.lit(True) if high is None else F.col("n") < high)).join(shared, "sha1", "left")
        records = max(1, RUN_BYTES // high) if high else 1
        _records(mine, least_bytes).write.mode("append").option("lineSep", "\r\n\r\n").option("compression", "none").option("maxRecordsPerFile", records).text(folder)


def _records(rows: DataFrame, least_bytes: int) -> DataFrame:
    """The rows as records of an archive."""
    again = (F.col("n") >= least_bytes) & F.col("first").isNotNull() & ~F.col("id").eqNullSafe(F.col("first"))
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("n").cast("string"), F.lit("\r\n\r\n"))
    name = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(c.cast("string"), F.lit("null")), F.lit(">\r\n"))
    record = F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: "), F.when(again, "revisit").otherwise("response"),
        F.lit("\r\nWARC-Record-ID: "), name(F.col("id")),
        F.lit("WARC-Date: "), F.coalesce("time", F.lit("")),
        F.lit("\r\nWARC-Target-URI: "), F.col("url"),
        F.lit("\r\nWARC-Payload-Digest: sha1:"), base32_of_hex(F.col("sha1")),
        F.when(again, F.concat(F.lit(f"\r\nWARC-Profile: {PROFILE}\r\nWARC-Refers-To: "), name(F.col("first")))).otherwise("\r\n"),
        F.lit("Content-Type: application/http; msgtype=response\r\nContent-Length: "),
        (F.octet_length(http) + F.when(again, 0).otherwise(F.col("n"))).cast("string"),
        F.lit("\r\n\r\n"), http, F.when(again, "").otherwise(F.col("payload")),
    )
    return rows.select(record.alias("value"))


def url_key(url: str) -> str:
    """The sort-friendly form of a URL: host labels reversed, then the path; no scheme, www or fragment."""
    m = re.match(r"(?:[a-z][a-z0-9+.-]*://)?(?:[^/@]*@)?([^/:?#]*)(?::\d+)?([^#]*)", url.strip().lower())
    host = re.sub(r"^www\d*\.", "", m[1])
    return ",".join(reversed(host.split("."))) + ")" + (m[2] or "/")


def parse_records(data: bytes) -> Iterator[tuple[dict[str, str], bytes, int, int]]:
    """(headers with lower-case names, block, offset, length) of each record."""
    at = 0
    while at < len(data):
        end = data.index(b"\r\n\r\n", at)
        lines = data[at:end].decode().split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"no WARC record at byte {at}")
        head = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
        body = end + 4
        stop = body + int(head["content-length"])
        yield head, data[body:stop], at, stop + 4 - at
        at = stop + 4


def _number(urn: str | None) -> int | None:
    found = re.fullmatch(r"<urn:page:(-?\d+)>", urn or "")
    return int(found[1]) if found else None


def _capture(head: dict[str, str], block: bytes, run: str, at: int, length: int) -> tuple:
    http, _, payload = block.partition(b"\r\n\r\n")
    n = int(re.search(rb"(?im)^content-length:\s*(\d+)", http)[1])
    digest = head["warc-payload-digest"].removeprefix("sha1:")
    if head["warc-type"] == "response":
        if len(payload) != n or base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest:
            raise ValueError(f"payload of {head['warc-record-id']} in {run} does not fit its digest")
    url = head["warc-target-uri"]
    return (url_key(url), head["warc-date"], _number(head["warc-record-id"]), head["warc-type"], _number(head.get("warc-refers-to")), digest, n, url, run, at, length)


def order(row: tuple) -> tuple:
    return (row[0], row[1], row[2] is not None, row[2] or 0)


def read_runs(spark: SparkSession, folder: str) -> DataFrame:
    """The index of each archive file, as a run sorted by URL key, time and id. Payloads of responses are checked."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column(0), batch.column(1)):
                data = content.as_py()
                yield _table(sorted((_capture(h, b, path.as_py(), at, n) for h, b, at, n in parse_records(data)), key=order))

    return spark.read.format("binaryFile").load(folder).select("path", "content").mapInArrow(run, INDEX)


def read_record(data: bytes) -> tuple[dict[str, str], bytes]:
    """Headers and block of the one record in ``data``: the bytes of its file from ``offset`` on, ``length`` of them."""
    head, block, _, _ = next(parse_records(data))
    return head, block


def _table(rows: list[tuple]) -> pa.RecordBatch:
    kinds = {"string": pa.string(), "long": pa.int64()}
    fields = [f.split(" ") for f in INDEX.split(", ")]
    columns = list(zip(*rows)) if rows else [[]] * len(fields)
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[k]) for c, (_, k) in zip(columns, fields)], names=[n for n, _ in fields])


class LoserTree:
    """Merges k sorted iterators: each inner node keeps the loser of its match, so the next row costs one path of matches."""

    def __init__(self, runs: Iterable[Iterable[tuple]], key=order):
        self.runs = [iter(r) for r in runs]
        self.key, self.k = key, len(self.runs)
        self.heads = [next(r, None) for r in self.runs]
        self.losers = [-1] * max(1, self.k)
        self.best = self._play(1) if self.k else -1

    def _beats(self, a: int, b: int) -> bool:
        x, y = self.heads[a], self.heads[b]
        return y is None or (x is not None and (self.key(x), a) < (self.key(y), b))

    def _play(self, node: int) -> int:
        if node >= self.k:
            return node - self.k
        left, right = self._play(2 * node), self._play(2 * node + 1)
        win, lose = (left, right) if self._beats(left, right) else (right, left)
        self.losers[node] = lose
        return win

    def __iter__(self) -> Iterator[tuple]:
        while self.k and (row := self.heads[self.best]) is not None:
            yield row
            win = self.best
            self.heads[win] = next(self.runs[win], None)
            node = (win + self.k) // 2
            while node >= 1:
                if self._beats(self.losers[node], win):
                    win, self.losers[node] = self.losers[node], win
                node //= 2
            self.best = win


def merge_runs(runs: DataFrame) -> DataFrame:
    """The runs as one index: partition after partition it is in the order of URL key, time and id."""
    runs = written(runs, "capture-runs")
    n = 1 + runs.count() // RANGE_ROWS
    ranged = runs.repartitionByRange(n, "url_key", "time", "page_id", "run", "offset").sortWithinPartitions("run", "url_key", "time", "page_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[tuple]] = {}
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                held.setdefault(row[8], []).append(row)
        out: list[tuple] = []
        for row in LoserTree(held.values()):
            out.append(row)
            if len(out) == 10_000:
                yield _table(out)
                out = []
        yield _table(out)

    return ranged.mapInArrow(run, INDEX)


def capture_history(spark: SparkSession, folder: str) -> DataFrame:
    return merge_runs(read_runs(spark, folder))
