"""WARC archives and the external merge of their index.

Captures are written to archives of one gzip member a record, an archive a task. Each archive has its index run: a
line a record, sorted by URL key and timestamp. The runs are merged k ways by a loser tree: the key space is cut into
ranges of about RANGE_LINES lines, every range takes its slice of each run in the run's own order (Spark's sort by run
and place in it spills to disk), and a loser tree merges the slices as iterators, so the history of all captures is
ordered globally and no task holds more than a range, as Arrow columns. Ranges are cut by URL key, timestamp, page and
place, so a URL that a third of the captures share spans several. ``placed`` numbers the lines of the whole history.

Of captures with equal payloads (by length and SHA-1, of at least ``least_bytes``) the one with the largest page_id
is a response, the others are revisits that refer to it. The largest page_id of each payload is found by partial
maxima on the map side and comes back by a join on the digest, which Spark splits where one payload is very common.

An attempt of a task writes an archive of its own name, by one rename after it is complete, and only the runs of
committed attempts are read, so an archive that a lost executor left behind is not part of the result.

Defined cases: null html is the empty payload; a null url has the empty key and no target URI; equal page_ids of one
payload: one of the rows is the response (the smallest by url, then any of equal rows), the others refer to it; a null
page_id is smaller than all others; captures without a time are dated by their page_id, of which 31 bits count; an
empty table writes no archive and gives no row; extra columns are ignored, whatever their names.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterable, Iterator
from datetime import UTC, datetime
from urllib.parse import urlsplit

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.llm.common import materialize, scratch, shared_path, table

#: A capture of page n that has no time of its own is dated n seconds after this, by the last 31 bits of n.
EPOCH = datetime(2024, 1, 1, tzinfo=UTC)
#: Index lines that a task merges, about.
RANGE_LINES = 100_000
LINE = pa.schema([("urlkey", pa.string()), ("ts", pa.string()), ("page_id", pa.int64()), ("file", pa.string()), ("offset", pa.int64()), ("length", pa.int64())])
#: ``at`` is a line's place in its run; ``part`` and ``nth`` are its range and its place there.
RUN = "urlkey string, ts string, page_id long, file string, offset long, length long, at long"
HISTORY = "urlkey string, ts string, page_id long, file string, offset long, length long, part int, nth long"
RECORD = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, ts string, file string, offset long"
_NAMED = re.compile(r"^([a-zA-Z][a-zA-Z0-9+.-]*):")


def url_key(url: str | None) -> str:
    """The sort-friendly form: host labels reversed, without a leading www, then path and query in lower case; no scheme, port 80 or 443, nor fragment."""
    if not url:
        return ""
    try:
        u = urlsplit(url if _NAMED.match(url) else f"http://{url}")
        host, port = (u.hostname or "").lower(), u.port
    except ValueError:
        return url.lower()
    host = re.sub(r"^www\d*\.", "", host)
    key = ",".join(reversed(host.split("."))) + (f":{port}" if port and port not in (80, 443) else "")
    return f"{key}){u.path.lower() or '/'}" + (f"?{'&'.join(sorted(u.query.lower().split('&')))}" if u.query else "")


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(kind: str, page_id: int | None, url: str | None, ts: str, payload: bytes, refers_to: int | None) -> bytes:
    """One record: a response with the payload, or a revisit without."""
    head = [
        "WARC/1.1",
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: <urn:page:{page_id}>",
        f"WARC-Date: {ts[:4]}-{ts[4:6]}-{ts[6:8]}T{ts[8:10]}:{ts[10:12]}:{ts[12:]}Z",
        f"WARC-Payload-Digest: sha1:{digest(payload)}",
        f"X-Payload-Length: {len(payload)}",
        "Content-Type: text/html; charset=utf-8",
    ]
    if url:
        head.append("WARC-Target-URI: " + re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url))
    if kind == "revisit":
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers_to}>"]
        payload = b""
    head.append(f"Content-Length: {len(payload)}")
    return "\r\n".join(head).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + payload + b"\r\n\r\n"


def parse(raw: bytes) -> tuple[dict[str, str], bytes]:
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "surrogatepass").split("\r\n")
    fields = dict(line.split(": ", 1) for line in lines[1:])
    return fields, rest[: int(fields["Content-Length"])]


def _page(uri: str | None) -> int | None:
    found = re.fullmatch(r"<urn:page:(-?\d+)>", uri or "")
    return int(found[1]) if found else None


def _filesystem(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri if "://" in uri else uri.replace("file:", "file://", 1))


def _write(folder: str):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        fs, base = _filesystem(folder)
        attempt = uuid.uuid4().hex
        name, temp, out, at, run = f"part-{TaskContext.get().partitionId():09d}-{attempt[:12]}.warc.gz", f"{base}/.{attempt}", None, 0, []
        for batch in batches:
            for page, url, html, ts, revisit, to in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if out is None:
                    fs.create_dir(base, recursive=True)
                    out = fs.open_output_stream(temp)
                member = gzip.compress(record("revisit" if revisit else "response", page, url, ts, (html or "").encode("utf-8", "surrogatepass"), to), 5, mtime=0)
                out.write(member)
                run.append((url_key(url), ts, page, f"{folder}/{name}", at, len(member)))
                at += len(member)
        if out is not None:
            out.close()
            fs.move(temp, f"{base}/{name}")
            run.sort(key=_order)
            for k in range(0, len(run), 10_000):
                lines = _batch(run[k : k + 10_000], LINE)
                yield pa.RecordBatch.from_arrays([*lines.columns, pa.array(range(k, k + lines.num_rows), pa.int64())], [*LINE.names, "at"])

    return write


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


def _order(line: tuple) -> tuple:
    key, ts, page, file, offset, _ = line
    return key.encode("utf-8", "surrogatepass"), ts, page is not None, page or 0, file, offset


class LoserTree:
    """Merges sorted runs, given as iterables: each inner node keeps the loser of its match, so a step replays one path from leaf to root."""

    def __init__(self, runs: list[Iterable[tuple]]):
        self.runs, self.k = [iter(r) for r in runs], len(runs)
        self.lines: list[tuple | None] = [None] * self.k
        self.heads: list[tuple | None] = [None] * self.k
        self.losers = [-1] * max(self.k, 1)
        for r in range(self.k):
            self._advance(r)
        for r in range(self.k):
            self._replay(r)

    def _advance(self, run: int) -> None:
        line = self.lines[run] = next(self.runs[run], None)
        self.heads[run] = None if line is None else _order(line)

    def _beats(self, a: int, b: int) -> bool:
        """Whether run a goes before run b. An ended run comes last; of equal heads the earlier run goes first."""
        x, y = self.heads[a], self.heads[b]
        return y is None and (x is not None or a < b) if x is None or y is None else (x, a) < (y, b)

    def _replay(self, winner: int) -> None:
        node = (winner + self.k) // 2
        while node > 0:
            other = self.losers[node]
            if other < 0:  # the first to come here waits for its opponent
                self.losers[node] = winner
                return
            if self._beats(other, winner):
                self.losers[node], winner = winner, other
            node //= 2
        self.losers[0] = winner

    def __iter__(self) -> Iterator[tuple]:
        while self.k and self.heads[w := self.losers[0]] is not None:
            yield self.lines[w]
            self._advance(w)
            self._replay(w)


def _lines(parts: list[pa.RecordBatch]) -> Iterator[tuple]:
    for part in parts:
        for at in range(0, part.num_rows, 1_000):
            yield from zip(*(c.to_pylist() for c in part.slice(at, 1_000).select(LINE.names).columns), strict=True)


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Lines come run after run, each run in its order."""
    from pyspark import TaskContext

    slices: dict[str, list[pa.RecordBatch]] = {}
    for b in batches:
        files, start = b.column(b.schema.get_field_index("file")).to_pylist(), 0
        for k in range(1, len(files) + 1):
            if k == len(files) or files[k] != files[start]:
                slices.setdefault(files[start], []).append(b.slice(start, k - start))
                start = k
    part, n, out = TaskContext.get().partitionId(), 0, []

    def made() -> pa.RecordBatch:
        lines = _batch(out, LINE)
        return pa.RecordBatch.from_arrays([*lines.columns, pa.array([part] * len(out), pa.int32()), pa.array(range(n - len(out), n), pa.int64())], [*LINE.names, "part", "nth"])

    for line in LoserTree([_lines(p) for p in slices.values()]):
        out.append(line)
        n += 1
        if len(out) == 10_000:
            yield made()
            out = []
    if out:
        yield made()


def merge_runs(runs: DataFrame) -> DataFrame:
    """The global history: partition by partition in order of URL key, timestamp and page, and so inside each."""
    ranges = max(int(runs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-runs.count() // RANGE_LINES))
    ranged = runs.repartitionByRange(ranges, "urlkey", "ts", F.col("page_id").asc_nulls_first(), "file", "offset")
    return ranged.sortWithinPartitions("file", "at").mapInArrow(_merge, HISTORY)


def placed(history: DataFrame) -> DataFrame:
    """``history`` with the place of each line in the whole, from 0 on. Ranges, a row each, are all that is counted in one task."""
    merged = materialize(history, "warc-history")
    before = F.coalesce(F.sum("n").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    ranges = merged.groupBy("part").agg(F.count("*").alias("n")).select("part", before.alias("before"))
    return merged.join(ranges, "part").select(*LINE.names, (F.col("before") + F.col("nth")).alias("place"))


def _digested(pages: DataFrame, time: str | None) -> DataFrame:
    """(page_id, url, html, ts, sha, bytes). ``time`` names a column with the time of each capture."""
    body = F.encode(F.coalesce("html", F.lit("")), "UTF-8")
    own = F.timestamp_seconds(F.lit(int(EPOCH.timestamp())) + F.pmod(F.coalesce(F.col("page_id").cast("long"), F.lit(0)), F.lit(1 << 31)))
    stamp = own if time is None else F.coalesce(F.col(time).try_cast("timestamp"), own)
    return pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html", F.date_format(stamp, "yyyyMMddHHmmss").alias("ts"), F.sha1(body).alias("sha"), F.length(body).alias("bytes"))


def _groups(rows: DataFrame, least_bytes: int) -> DataFrame:
    """(sha, bytes, top_id, n_top): the payloads of several rows, their largest page_id, and how many rows have it."""
    by_page = rows.groupBy("sha", "bytes", "page_id").agg(F.count("*").alias("n"))
    top = F.max(F.struct(F.col("page_id").isNotNull().alias("known"), "page_id", "n"))
    groups = by_page.groupBy("sha", "bytes").agg(top.alias("top"), F.sum("n").alias("n")).where(f"n > 1 AND bytes >= {least_bytes}")
    return materialize(groups.select("sha", "bytes", F.col("top.page_id").alias("top_id"), F.col("top.n").alias("n_top")), "warc-groups")


def classified(pages: DataFrame, least_bytes: int = 0, time: str | None = None) -> DataFrame:
    """(page_id, url, html, ts, revisit, refers_to)."""
    rows = _digested(pages, time)
    groups = _groups(rows, least_bytes)
    # Most payloads occur once, so the groups are few; which side is hashed, broadcast or split is left to Spark.
    rows = rows.join(groups, ["sha", "bytes"], "left")
    revisit = F.col("n_top").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("top_id"))
    shown = ["page_id", "url", "html", "ts", "revisit", F.when(F.col("revisit"), F.col("top_id")).alias("refers_to")]
    if groups.where("n_top > 1").isEmpty():
        return rows.withColumn("revisit", revisit).select(*shown)
    # Rows that repeat the largest page_id of their payload: the first by url is the response.
    is_tied = F.coalesce(F.col("n_top") > 1, F.lit(False)) & F.col("page_id").eqNullSafe(F.col("top_id"))
    tied = materialize(rows.where(is_tied).withColumn("_row", F.monotonically_increasing_id()), "warc-tied")
    first = tied.groupBy("sha", "bytes").agg(F.min(F.struct("url", "_row"))["_row"].alias("_first"))
    tied = tied.join(first, ["sha", "bytes"]).withColumn("revisit", F.col("_row") != F.col("_first"))
    return rows.where(~is_tied).withColumn("revisit", revisit).select(*shown).unionByName(tied.select(*shown))


def write(pages: DataFrame, folder: str | None = None, least_bytes: int = 0, time: str | None = None) -> DataFrame:
    """Write the archives; returns the runs (urlkey, ts, page_id, file, offset, length, at), sorted within each archive."""
    spark = pages.sparkSession
    folder = folder or shared_path(spark, "warc")
    with scratch(spark) as work:
        return work.keep(materialize(classified(pages, least_bytes, time).mapInArrow(_write(folder), RUN), "warc-runs"))


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Reads the archives from end to end, member by member."""
    for b in batches:
        for name in b.column(0).to_pylist():
            fs, path = _filesystem(name)
            with fs.open_input_stream(path, compression=None) as f:
                inflate, raw, at, used, out = zlib.decompressobj(31), [], 0, 0, []
                while True:
                    data = f.read(1 << 20)
                    if not data:
                        break
                    while data:
                        raw.append(inflate.decompress(data))
                        if not inflate.eof:
                            used += len(data)
                            break
                        used += len(data) - len(inflate.unused_data)
                        fields, payload = parse(b"".join(raw))
                        response = fields["WARC-Type"] == "response"
                        sha = fields["WARC-Payload-Digest"].partition(":")[2]
                        if response and digest(payload) != sha:
                            raise ValueError(f"{name}: a payload at {at} does not match its digest")
                        size = len(payload) if response else int(fields["X-Payload-Length"])
                        to = None if response else _page(fields["WARC-Refers-To"])
                        out.append((_page(fields["WARC-Record-ID"]), size, sha, fields["WARC-Type"], to, re.sub("[^0-9]", "", fields["WARC-Date"]), name, at))
                        at, raw, data, inflate = used, [], inflate.unused_data, zlib.decompressobj(31)
                        if len(out) >= 5_000:
                            yield _batch(out, _RECORD)
                            out = []
            if raw and any(raw):
                raise ValueError(f"{name} breaks off inside a record")
            if out:
                yield _batch(out, _RECORD)


_RECORD = pa.schema([(c.split()[0], pa.int64() if c.endswith("long") else pa.string()) for c in RECORD.split(", ")])


def read(files: DataFrame) -> DataFrame:
    """A row a record of the archives named in ``files`` (file); a task an archive, however small the list is."""
    return files.select("file").repartition(max(1, files.count())).mapInArrow(_read, RECORD)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every record read back from the archives, with its key and its place in the merged history."""
    runs = write(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    history = placed(merge_runs(runs)).select("file", "offset", "urlkey", "place")
    records = read(materialize(runs.select("file").distinct(), "warc-files"))
    # Both sides have a row a record, so neither is broadcast.
    got = history.hint("merge").join(records.hint("merge"), ["file", "offset"])
    return got.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "ts", "urlkey", "place")


#: The hex SHA-1 is cut into 5 digits, which are 4 characters of base 32.
_B32 = " || ".join(
    f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((('0x' || substr(sha, {5 * k + 1}, 5))::BIGINT >> {5 * (3 - j)}) & 31)::BIGINT, 1)" for k in range(8) for j in range(4)
)
SQL = rf"""
WITH p AS (SELECT page_id, sha1(coalesce(html, '')) AS sha, strlen(coalesce(html, ''))::BIGINT AS payload_bytes, regexp_replace(coalesce(url, ''), '^[a-zA-Z][a-zA-Z0-9+.-]*://', '') AS u FROM pages
), q AS (SELECT *, regexp_replace(lower(regexp_replace(regexp_extract(u, '^([^/?#]*)', 1), '^.*@|:[0-9]*$', '', 'g')), '^www[0-9]*\.', '') AS host, regexp_extract(u, '^[^/?#]*:([0-9]+)', 1) AS port,
  lower(regexp_extract(u, '^[^/?#]*([^?#]*)', 1)) AS path, lower(regexp_extract(u, '^[^?#]*\?([^#]*)', 1)) AS asked FROM p
), k AS (SELECT *, CASE WHEN u = '' THEN '' ELSE array_to_string(list_reverse(string_split(host, '.')), ',') || CASE WHEN port IN ('', '80', '443') THEN '' ELSE ':' || port END || ')' || CASE WHEN path = '' THEN '/' ELSE path END
  || CASE WHEN asked = '' THEN '' ELSE '?' || array_to_string(list_sort(string_split(asked, '&')), '&') END END AS urlkey,
  strftime(TIMESTAMP '2024-01-01' + to_seconds((page_id % 2147483648 + 2147483648) % 2147483648), '%Y%m%d%H%M%S') AS ts FROM q
), g AS (SELECT *, max(page_id) OVER (PARTITION BY sha, payload_bytes) AS top FROM k)
SELECT page_id, payload_bytes, {_B32} AS payload_digest, CASE WHEN page_id = top THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> top THEN top END AS refers_to,
  ts, urlkey, row_number() OVER (ORDER BY urlkey, ts, page_id) - 1 AS place FROM g
"""
