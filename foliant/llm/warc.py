"""WARC archives: writing and reading records, and an index merged from sorted runs.

Each archive file read gives one run: its captures sorted by URL key and time. Runs are dealt by ranges of
(URL key, time, page), which also splits the history of a URL that many captures share, and a tournament of losers
merges the runs' slices of a range. Within a range Spark sorts each slice (on disk where it must), and the merge moves
row numbers of Arrow columns, not rows. Ranges in order make the whole index.

Archives are written and read by Spark alone, so they can lie in any store it knows. They are uncompressed: an index
entry's offset and length find a record by a range read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.llm.common import drop_at_exit, new_path, partitions, stored, table, tidy

#: Payloads of fewer bytes are always written whole.
LEAST_REVISIT = 100
#: An archive file is read as one value, so it has to stay small: about so many bytes and records at most, one record at
#: least. Payloads of like size, by powers of SIZE_STEP, share a file.
FILE_BYTES, FILE_RECORDS, SIZE_STEP = 64 << 20, 2000, 16
#: Index entries of a merged range, about.
RANGE_ROWS = 100_000
#: Seconds over which captures without a date are spread.
DATES = 1 << 30
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_END = "\r\n"


def url_key(url: str | None) -> str:
    """A sortable key: the host's labels reversed, without www., default ports, credentials and fragment; lower case."""
    parts = re.match(r"(?i)([a-z][a-z0-9+.-]*)://([^/?#]*)([^#]*)", url or "")
    if not parts:
        return (url or "").split("#")[0].lower()
    scheme, host, rest = parts.groups()
    host = host.rpartition("@")[2].lower()
    name, colon, port = host.partition(":")
    name = re.sub(r"^www\d*\.", "", name)
    if port in ("", {"http": "80", "https": "443"}.get(scheme.lower())):
        colon = port = ""
    return f"{','.join(reversed(name.split('.')))}{colon}{port}){(rest or '/').lower()}"


def with_revisits(pages: DataFrame, least: int = LEAST_REVISIT) -> DataFrame:
    """Adds payload, payload_bytes, payload_digest, record_type and refers_to to pages (page_id, url, html).

    Of equal payloads of `least` bytes or more, the one with the smallest page_id is a response and others revisit it.
    A null html is an empty payload. Rows that repeat the smallest page_id are responses each; a null page_id is never
    the smallest, and a group of null ids alone has only responses.
    """
    known = pages.select("page_id", "url", F.encode(F.coalesce("html", F.lit("")), "UTF-8").alias("payload"))
    known = known.withColumns({"payload_bytes": F.octet_length("payload").cast("long"), "payload_digest": F.sha2("payload", 256)})
    firsts = stored(
        known.where(F.col("payload_bytes") >= least).groupBy("payload_digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n"))
        .where("n > 1 AND first IS NOT NULL").select("payload_digest", "first"),
        "first-captures",
    )  # only payloads that occur twice: Spark broadcasts the table if it is small, and splits hot keys otherwise
    revisit = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    return known.join(firsts, "payload_digest", "left").select(
        "page_id", "url", "payload", "payload_bytes", "payload_digest",
        F.when(revisit, "revisit").otherwise("response").alias("record_type"), F.when(revisit, F.col("first")).alias("refers_to"),
    )


def utc_text(instant: Column) -> Column:
    """An instant as WARC writes it, in UTC whatever the session's time zone."""
    clock = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz") + F.make_dt_interval(secs=F.unix_seconds(instant).cast("decimal(18,6)"))
    return F.concat(F.replace(clock.cast("string"), F.lit(" "), F.lit("T")), F.lit("Z"))


def record_uri(page_id: Column) -> Column:
    return F.concat(F.lit("<urn:page:"), F.coalesce(page_id.cast("string"), F.lit("none")), F.lit(">"))


def record_text(date: Column) -> Column:
    """A record without the two line ends that close it."""
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{_END}Content-Type: text/html; charset=utf-8{_END}Content-Length: "), F.col("payload_bytes").cast("string"), F.lit(_END * 2))
    revisit = F.col("record_type") == "revisit"
    length = F.octet_length(http) + F.when(revisit, F.lit(0)).otherwise(F.col("payload_bytes"))
    uri = F.regexp_replace("url", r"[\x00-\x20\x7F]", "%20")
    return F.concat(
        F.lit(f"WARC/1.1{_END}WARC-Type: "), F.col("record_type"), F.lit(f"{_END}WARC-Record-ID: "), record_uri(F.col("page_id")),
        F.lit(f"{_END}WARC-Date: "), utc_text(date),
        F.coalesce(F.concat(F.lit(f"{_END}WARC-Target-URI: "), uri), F.lit("")),
        F.lit(f"{_END}WARC-Payload-Digest: sha256:"), F.col("payload_digest"),
        F.when(revisit, F.concat(F.lit(f"{_END}WARC-Profile: {PROFILE}{_END}WARC-Refers-To: "), record_uri(F.col("refers_to")))).otherwise(""),
        F.lit(f"{_END}Content-Type: application/http; msgtype=response{_END}Content-Length: "), length.cast("string"), F.lit(_END * 2),
        http, F.when(revisit, "").otherwise(F.col("payload").cast("string")),
    )


def write_archives(records: DataFrame, path: str, date: Column | None = None) -> None:
    """One WARC file or more for each partition. Without a date, a capture's is the second of its page_id, of DATES seconds
    from 2024 on: ids may be any numbers, so dates come round again after 34 years.

    A file holds payloads of like size, so each level of sizes is written apart; of a page only the level that it belongs to
    works out more than its size."""
    when = F.timestamp_seconds(F.pmod(F.coalesce(F.col("page_id"), F.lit(0)), F.lit(DATES)) + 1_704_067_200) if date is None else date
    level = F.greatest(F.lit(0), F.ceil(F.log(float(SIZE_STEP), F.greatest(F.col("payload_bytes"), F.lit(1)) * FILE_RECORDS / FILE_BYTES))).cast("int")
    records = records.withColumn("_level", level)
    for k in sorted(r["_level"] for r in records.select("_level").distinct().collect()) or [0]:  # a handful: sizes are under 2 GB
        rows = max(1, FILE_RECORDS // SIZE_STEP**k)
        # a record ends with two line ends, which is what the writer puts after each row
        records.where(F.col("_level") == k).select(record_text(when)).write.mode("append").option("lineSep", _END * 2).option("maxRecordsPerFile", rows).text(path)


def parse_archive(content: bytes) -> Iterator[tuple[int, int, dict[str, str], memoryview]]:
    """Offset, length, headers and block of each record."""
    at, view = 0, memoryview(content)
    while at < len(content):
        end = content.find(b"\r\n\r\n", at)
        if not content.startswith(b"WARC/1.", at) or end < 0:
            raise ValueError(f"no WARC record at byte {at}")
        lines = content[at:end].decode("utf-8", "replace").split(_END)[1:]
        headers = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
        start, size = end + 4, int(headers["content-length"])
        if content[start + size : start + size + 4] != b"\r\n\r\n":
            raise ValueError(f"the record at byte {at} does not end where it says")
        yield at, start + size + 4 - at, headers, view[start : start + size]
        at = start + size + 4


_INDEX = "url_key string, ts string, page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, file string, offset long, length long"
_NAMES = [x.split()[0] for x in _INDEX.split(", ")]
_KEY = ("url_key", "ts", "page_id")


def page_of(uri: str | None) -> int | None:
    name = (uri or "").strip("<>").rpartition(":")[2]
    return None if name in ("", "none") else int(name)


def captures(path: str, content: bytes) -> list[tuple]:
    """The index entries of an archive, a sorted run. Digests are taken from the payloads and held against headers."""
    out = []
    for offset, length, headers, block in parse_archive(content):
        body = bytes(block)
        head, _, payload = body.partition(b"\r\n\r\n")
        declared = int(re.search(rb"(?i)content-length:\s*(\d+)", head)[1])
        digest = headers["warc-payload-digest"].rpartition(":")[2]
        kind = headers["warc-type"]
        if kind == "response" and (hashlib.sha256(payload).hexdigest() != digest or len(payload) != declared):
            raise ValueError(f"the payload at byte {offset} of {path} does not match its digest")
        url = headers.get("warc-target-uri")
        out.append((url_key(url), headers["warc-date"], page_of(headers["warc-record-id"]), url, declared, digest, kind, page_of(headers.get("warc-refers-to")), path, offset, length))
    return sorted(out, key=lambda row: order_key((row[0], row[1], row[2], row[8], row[9])))


def order_key(row: tuple) -> tuple:
    """row: URL key, time, page, file, offset. A null page comes first."""
    return row[0], row[1], row[2] is not None, row[2] or 0, row[3], row[4]


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """Index entries of all archives in a folder; those of one file are a sorted run."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(len(batch)):
                rows = captures(batch.column(0)[k].as_py(), batch.column(1)[k].as_py())
                columns = list(zip(*rows)) if rows else [[]] * len(_NAMES)
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64() if f"{n} long" in _INDEX else pa.string()) for n, c in zip(_NAMES, columns)], names=_NAMES)

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(tidy(run), _INDEX)


class LoserTree:
    """Merges sorted sequences: each inner node keeps the loser of its match, the root the winner."""

    def __init__(self, runs: list, key: Callable):
        self.runs, self.key = [iter(r) for r in runs], key
        self.k = max(1, len(runs))
        self.heads = [self._next(i) for i in range(len(runs))] or [None]
        self.tree = [-1] * self.k
        for i in range(self.k):
            self._play(i)

    def _next(self, i: int):
        row = next(self.runs[i], None)
        return None if row is None else (self.key(row), row)

    def _less(self, a: int, b: int) -> bool:
        x, y = self.heads[a], self.heads[b]
        if x is None or y is None:
            return y is None and (x is not None or a < b)
        return (x[0], a) < (y[0], b)

    def _play(self, winner: int) -> None:
        node = (winner + self.k) // 2
        while node:
            if self.tree[node] < 0:  # the first to come waits for its match
                self.tree[node] = winner
                return
            if self._less(self.tree[node], winner):
                winner, self.tree[node] = self.tree[node], winner
            node //= 2
        self.tree[0] = winner

    def __iter__(self) -> Iterator:
        while self.heads[winner := self.tree[0]] is not None:
            yield self.heads[winner][1]
            self.heads[winner] = self._next(winner)
            self._play(winner)


def text_at(column: pa.StringArray) -> Callable[[int], bytes]:
    """The UTF-8 bytes of a row, which sort as the text does."""
    _, ends, data = column.buffers()
    ends, data = np.frombuffer(ends, np.int32)[column.offset :], memoryview(data or b"")
    return lambda i: bytes(data[ends[i] : ends[i + 1]])


def merge_index(runs: DataFrame) -> DataFrame:
    """The index in global order by URL key, time and page: range after range, each merged from its runs."""
    runs = stored(runs, "capture-runs")
    ranges = max(partitions(runs.sparkSession), -(-runs.count() // RANGE_ROWS))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = list(batches)
        if not sum(map(len, held)):
            return
        rows = pa.Table.from_batches(held).combine_chunks()
        file = rows.column("file").dictionary_encode().combine_chunks().indices.to_numpy()
        cuts = [0, *(np.nonzero(np.diff(file))[0] + 1).tolist(), len(file)]  # the slices of the runs, one after the other
        url, ts, name = (text_at(rows.column(c).chunk(0)) for c in ("url_key", "ts", "file"))
        page, known = rows.column("page_id").fill_null(0).to_numpy(), rows.column("page_id").is_valid().to_numpy()
        offset = rows.column("offset").to_numpy()
        # a key is made when a row becomes the head of its run
        merged = iter(LoserTree([range(a, b) for a, b in zip(cuts, cuts[1:])], lambda i: (url(i), ts(i), bool(known[i]), int(page[i]), name(i), int(offset[i]))))
        while some := list(islice(merged, 10_000)):
            yield from rows.take(pa.array(some)).to_batches()

    return runs.repartitionByRange(ranges, *_KEY).sortWithinPartitions("file", *_KEY, "offset").mapInArrow(tidy(run), _INDEX)


def archive_pages(pages: DataFrame, path: str | None = None) -> DataFrame:
    """Writes pages (page_id, url, html) as WARC archives, reads them back, and returns the merged index.

    Null urls have no target and the empty key; null and repeated page_id keep a record each. An empty table gives an
    empty index.
    """
    spark = pages.sparkSession
    archives = path or new_path(spark, "warc")
    write_archives(with_revisits(pages), archives)
    if path is None:
        drop_at_exit(spark, archives)
    return merge_index(read_archives(spark, archives))


def op4_warc_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = archive_pages(table(spark, sf_dir, "pages"))
    return index.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url_key", "ts")


OP4_SQL = r"""
WITH p AS (
  SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest, url FROM pages
), f AS (
  SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first FROM p
)
SELECT page_id, payload_bytes::BIGINT AS payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 100 AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 100 AND page_id <> first THEN first END AS refers_to,
       array_to_string(list_reverse(string_split(regexp_replace(lower(regexp_extract(url, '://([^/?#]*)', 1)), '^www\d*\.', ''), '.')), ',') || ')'
         || lower(regexp_extract(url, '://[^/?#]*([^#]*)', 1)) AS url_key,
       strftime(make_timestamp(((page_id % 1073741824 + 1073741824) % 1073741824 + 1704067200) * 1000000), '%Y-%m-%dT%H:%M:%SZ') AS ts
FROM f
"""
