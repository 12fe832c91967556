"""WARC archives and a capture index merged from sorted runs by loser trees.

Writing. Every page is one record: response, or, if an equal payload of at least
``MIN_REVISIT`` bytes has a smaller page id, revisit of that page. Payload digests are found by Spark
functions; the smallest page id of a digest comes from a grouped minimum. Each task
writes gzip members to archives of a bounded size in the shared folder, under names of its own; the manifest lists
the archives of the attempts that counted, so what a lost or repeated attempt leaves is never read.

Reading. Archives of the manifest are inflated member by member from a stream, and their headers and payload parsed.

Index. Each archive's captures are sorted by (URL key, time, page id) where they are read, and these runs are written to the
shared folder. Captures are exchanged by ranges of that whole key, about ``RANGE`` captures each, so that one URL may span
many ranges; in a range the parts of the runs, which are in order already, are merged by a loser tree, which replays one
leaf-to-root path a capture. Counts of the ranges (one number each) place every capture globally.

Defined results. A null html is an empty payload, a null url an empty target; an address of any form, malformed ones
too, has a key; a null
page id stands after all others, and is written as such; repeated rows are records of
their own, and the copy of the smallest page id is a response in each of its rows; an empty table gives an empty
result. Other columns play no part.
"""

from __future__ import annotations

import gzip
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from itertools import islice

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import grouped_tables, settle, shared_folder

MIN_REVISIT = 100
ARCHIVE_BYTES = 8_000_000
#: Capture times, which pages lack: one second a page from this moment on.
FIRST_TIME = "2024-01-01T00:00:00Z"
NULL_ID = 2**63 - 1
RANGE = 50_000
_LEVEL = 4
#: Bytes of an archive that are read at once.
_CHUNK = 1 << 20
_SCHEME = re.compile(r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//")
_HOST = re.compile(r"[^/?]*")


def url_key(url: str) -> str:
    """Sort key of any string: host labels reversed, lower case, without www, user, port or scheme, then path and sorted query; the fragment goes.

    The parts are cut by their marks alone, so a malformed address has a key too.
    """
    rest = _SCHEME.sub("", url).partition("#")[0]
    host = _HOST.match(rest)[0]
    path, _, query = rest[len(host) :].partition("?")
    name = re.sub(r"^www\d*\.", "", host.rpartition("@")[2].partition(":")[0].lower())
    return ",".join(reversed(name.split("."))) + ")" + (path or "/").lower() + ("?" + "&".join(sorted(query.lower().split("&"))) if query else "")


def plan_records(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page (long), url, payload (binary), digest, refers_to of every row."""
    payload = F.coalesce(F.col(html_col).cast("string"), F.lit("")).cast("binary")
    rows = pages.select(F.col(id_col).cast("long").alias("page"), F.coalesce(F.col(url_col).cast("string"), F.lit("")).alias("url"), payload.alias("payload"))
    rows = rows.withColumn("digest", F.sha2("payload", 256))
    order = F.coalesce("page", F.lit(NULL_ID))
    firsts = rows.filter(F.octet_length("payload") >= MIN_REVISIT).groupBy("digest").agg(F.min(order).alias("first"), F.count("*").alias("n")).filter("n > 1").drop("n")
    # only digests that occur again are joined, so that payloads stay where they were read if these are few
    joined = rows.join(firsts, "digest", "left")
    return joined.select("page", "url", "payload", "digest", F.when(F.col("first") < order, F.col("first")).alias("refers_to"))


def _time(page: int | None) -> str:
    import datetime as dt

    begin = dt.datetime(2024, 1, 1)
    return (begin + dt.timedelta(seconds=(page or 0) % 10**9)).strftime("%Y-%m-%dT%H:%M:%SZ")


def record_bytes(page: int | None, url: str, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One WARC/1.1 record. A revisit has no block; its headers name the response."""
    # carriage returns and line feeds cannot stand in a header
    target = re.sub(r"[\r\n]", lambda m: "%0D" if m[0] == "\r" else "%0A", url)
    name = "null" if page is None else str(page)
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: <urn:page:{name}>",
        f"WARC-Date: {_time(page)}",
        f"WARC-Target-URI: {target}",
        f"WARC-Payload-Digest: sha256:{digest}",
        f"X-Payload-Length: {len(payload)}",
        "Content-Type: text/html; charset=utf-8",
    ]
    block = payload if refers_to is None else b""
    if refers_to is not None:
        head += [f"WARC-Refers-To: <urn:page:{refers_to}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    head.append(f"Content-Length: {len(block)}")
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_record(raw: bytes) -> dict:
    """Headers, in lower case, and block of one record; raises ValueError if it is cut short."""
    head, mark, rest = raw.partition(b"\r\n\r\n")
    if not mark or not head.startswith(b"WARC/"):
        raise ValueError("no WARC record")
    fields = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in head.decode().split("\r\n")[1:])
    fields = {k.lower(): v for k, v in fields.items()}
    n = int(fields["content-length"])
    if rest[n:] != b"\r\n\r\n":
        raise ValueError("a record is cut short or too long")
    return {"fields": fields, "block": rest[:n]}


def members(stream) -> Iterator[tuple[int, int, bytes]]:
    """(offset, length, content) of all gzip members of an archive, read from a stream."""
    at, waiting = 0, stream.read(_CHUNK)
    while waiting:
        inflater, parts, size = zlib.decompressobj(31), [], 0
        while not inflater.eof:
            if not waiting:
                raise ValueError("an archive is cut short")
            parts.append(inflater.decompress(waiting))
            size += len(waiting) - len(inflater.unused_data)
            waiting = inflater.unused_data or (b"" if inflater.eof else stream.read(_CHUNK))
        yield at, size, b"".join(parts)
        at += size
        waiting = waiting or stream.read(_CHUNK)


def _qualified(spark, folder: str) -> str:
    """The folder's full address, as Spark's default file system reads it."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    name = path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toString()
    return re.sub(r"^file:/+", "file:///", name)


def write_archives(records: DataFrame, folder: str, most: int = ARCHIVE_BYTES) -> DataFrame:
    """Write all records (page, url, payload, digest, refers_to) as *.warc.gz below folder; the manifest (file, n) of the archives."""
    place = _qualified(records.sparkSession, folder)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, base = fs.FileSystem.from_uri(place)
        store.create_dir(base, recursive=True)
        waiting, size = [], 0

        def flush() -> pa.RecordBatch:
            name = f"{uuid.uuid4().hex}.warc.gz"
            with store.open_output_stream(f"{base}/{name}", compression=None) as out:
                for w in waiting:
                    out.write(w)
            done = pa.RecordBatch.from_arrays([pa.array([name]), pa.array([len(waiting)], pa.int64())], ["file", "n"])
            waiting.clear()
            return done

        for batch in batches:
            for page, url, payload, digest, refers_to in zip(*(batch.column(c) for c in ("page", "url", "payload", "digest", "refers_to")), strict=True):
                member = gzip.compress(record_bytes(page.as_py(), url.as_py(), payload.as_py(), digest.as_py(), refers_to.as_py()), _LEVEL, mtime=0)
                waiting.append(member)
                size += len(member)
                if size >= most:
                    yield flush()
                    size = 0
        if waiting:
            yield flush()

    return settle(records.mapInArrow(run, "file string, n long"))


_READ = "archive string, offset long, length long, page long, url string, time string, payload_bytes long, payload_digest string, record_type string, refers_to long, intact boolean"


def read_archives(manifest: DataFrame, folder: str, payload: bool = False) -> DataFrame:
    """All records of the manifest's archives; intact: a response's payload has the stated length and digest.

    A response's length and digest are taken from the payload that was read, a revisit's from its headers.
    """
    place = _qualified(manifest.sparkSession, folder)
    names = [c.split()[0] for c in _READ.split(", ")] + (["payload"] if payload else [])
    kinds = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.bool_()] + ([pa.binary()] if payload else [])

    def page_of(uri: str) -> int | None:
        name = uri.strip("<>").rpartition(":")[2]
        return None if name == "null" else int(name)

    def rows_of_archive(store, base: str, file: str) -> Iterator[tuple]:
        with store.open_input_stream(f"{base}/{file}", compression=None) as stream:
            for offset, length, raw in members(stream):
                r = parse_record(raw)
                f, block = r["fields"], r["block"]
                stated = (int(f["x-payload-length"]), f["warc-payload-digest"].partition(":")[2])
                read = (len(block), hashlib.sha256(block).hexdigest()) if f["warc-type"] == "response" else stated
                refers = f.get("warc-refers-to")
                yield (file, offset, length, page_of(f["warc-record-id"]), f["warc-target-uri"], f["warc-date"], *read, f["warc-type"], page_of(refers) if refers else None, read == stated, *([block] if payload else []))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, base = fs.FileSystem.from_uri(place)
        for batch in batches:
            for file in batch.column(0).to_pylist():
                rows = rows_of_archive(store, base, file)
                while part := list(islice(rows, 500)):
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*part, strict=True), kinds, strict=True)], names)

    # an archive is a bounded piece of work: the list of them, not their bytes, is dealt to the tasks
    archives = manifest.count()
    slots = int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return manifest.select("file").repartition(max(1, min(archives, max(slots, archives // 8)))).mapInArrow(run, _READ + (", payload binary" if payload else ""))


class LoserTree:
    """k-way merge of sorted iterators: inner nodes hold losers, each step replays one path."""

    def __init__(self, runs: list[Iterator[tuple]]):
        self.runs, self.k = runs, len(runs)
        self.heads = [next(r, None) for r in runs]
        self.tree = [-1] * max(1, self.k)
        for leaf in range(self.k):
            self._replay(leaf)

    def _beats(self, a: int, b: int) -> bool:
        x, y = self.heads[a], self.heads[b]
        return y is None or x is not None and (x, a) < (y, b)

    def _replay(self, leaf: int) -> None:
        winner, node = leaf, (leaf + self.k) // 2
        while node:
            if self.tree[node] < 0:
                self.tree[node] = winner
                return
            if self._beats(self.tree[node], winner):
                self.tree[node], winner = winner, self.tree[node]
            node //= 2
        self.tree[0] = winner

    def __iter__(self) -> Iterator[tuple]:
        while self.k and (head := self.heads[w := self.tree[0]]) is not None:
            yield head
            self.heads[w] = next(self.runs[w], None)
            self._replay(w)


#: The order of captures. Rows that are equal in it are equal in all but their place in the archives.
ORDER = ("url_key", "time", "_page", "payload_digest", "record_type", "archive", "offset")


def index_runs(captures: DataFrame) -> DataFrame:
    """captures with url_key, _page and _seq, the place in the archive's run, sorted where an archive's captures lie together; written to the shared folder."""
    schema = T.StructType([*captures.schema, T.StructField("url_key", T.StringType()), T.StructField("_page", T.LongType()), T.StructField("_seq", T.IntegerType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, group in grouped_tables(batches, ("archive",)):
            group = group.append_column("url_key", pa.array([url_key(u or "") for u in group.column("url").to_pylist()], pa.string()))
            group = group.append_column("_page", group.column("page").fill_null(NULL_ID))
            group = group.sort_by([(c, "ascending") for c in ORDER])
            yield from group.append_column("_seq", pa.array(range(group.num_rows), pa.int32())).combine_chunks().to_batches(max_chunksize=10_000)

    return settle(captures.mapInArrow(run, schema))


def merge_index(captures: DataFrame, per_range: int = RANGE) -> DataFrame:
    """captures with url_key, history_rank (place in the order of url key, time, page id) by external merge of the archives' runs."""
    spark = captures.sparkSession
    runs = index_runs(captures)
    ranges = max(1, -(-runs.count() // per_range), int(spark.conf.get("spark.sql.shuffle.partitions")))
    dealt = runs.repartitionByRange(ranges, *ORDER)
    schema = T.StructType([*(f for f in runs.schema if f.name not in ("_page", "_seq")), T.StructField("_range", T.IntegerType()), T.StructField("_local", T.LongType())])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [b for b in batches if b.num_rows]
        if not parts:
            return
        table = pa.Table.from_batches(parts)
        # a run's part comes in pieces, each in order; the sequence numbers put the pieces behind each other
        table = table.sort_by([("archive", "ascending"), ("_seq", "ascending")])
        keys = list(zip(*(table.column(c).to_pylist() for c in ORDER), range(table.num_rows), strict=True))
        archive = table.column("archive").to_pylist()
        starts = [0, *(i for i in range(1, len(archive)) if archive[i] != archive[i - 1]), len(archive)]
        order = [k[-1] for k in LoserTree([iter(keys[a:b]) for a, b in zip(starts[:-1], starts[1:], strict=True)])]
        number = TaskContext.get().partitionId()
        out = table.drop_columns(["_page", "_seq"]).take(pa.array(order))
        out = out.append_column("_range", pa.array([number] * len(order), pa.int32())).append_column("_local", pa.array(range(len(order)), pa.int64()))
        yield from out.to_batches(max_chunksize=10_000)

    merged = settle(dealt.mapInArrow(merge, schema))
    before, offsets = 0, []
    for row in sorted(merged.groupBy("_range").count().collect()):
        offsets.append((row[0], before))
        before += row[1]
    starts = spark.createDataFrame(offsets or [(-1, 0)], "_range int, _before long")
    placed = merged.join(F.broadcast(starts), "_range").withColumn("history_rank", F.col("_before") + F.col("_local"))
    return placed.select(*captures.columns, "url_key", "history_rank")


def merge_runs(runs: list[list[tuple]]) -> list[tuple]:
    """All rows of sorted runs in order (the loser tree alone)."""
    return list(LoserTree([iter(r) for r in runs]))


def archive_pages(pages: DataFrame, folder: str | None = None, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Write all pages, read the archives back, and merge their capture index."""
    spark = pages.sparkSession
    folder = folder or f"{shared_folder(spark).rstrip('/')}/warc-{uuid.uuid4().hex}"
    manifest = write_archives(plan_records(pages, id_col, url_col, html_col), folder)
    return merge_index(read_archives(manifest, folder))
