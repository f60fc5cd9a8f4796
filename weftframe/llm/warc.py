"""WARC files: writing them from a table, and reading them in splits with boundary-chain verification.

A split may begin anywhere, and a payload may hold what looks like a record. So each task lists every place in its split where a record
might begin, with the offset of the record that would follow; links within the split are followed at once, which leaves a link
from each candidate to the first candidate offset beyond the split. Pointer jumping from the start of each file (every round doubles the
reach, so rounds grow with the logarithm of the splits in a file) retains the offsets at which splits are really entered, and
each entered split is then read along its chain. Only offsets are shuffled.

Defined results: an empty file has no records; where a chain meets something that is not a record (a damaged file) it ends, and later
records of that file are unreachable and left out; damaged() lists those places. A header may have any length. A null page_id, url or html is written and read back as null, an empty html as
empty. Repeated rows are records of their own; extra columns are not written.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from hashlib import md5
from urllib.parse import quote, unquote
from uuid import UUID, uuid4

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _shared

MAGIC = re.compile(rb"WARC/1\.[01]\r\n")
LENGTH = re.compile(rb"(?:^|\r\n)content-length:[ \t]*(\d+)[ \t]*(?:\r\n|$)", re.IGNORECASE)
MOST_TASKS = 50_000


def record(page_id: int | None, url: str | None, html: str | None) -> bytes:
    """One resource record."""
    body = (html or "").encode("utf-8", "surrogatepass")
    lines = ["WARC/1.0", "WARC-Type: resource", f"WARC-Record-ID: <urn:uuid:{UUID(bytes=md5(repr((page_id, url)).encode()).digest())}>", "WARC-Date: 2024-01-01T00:00:00Z"]
    if url is not None:
        lines.append(f"WARC-Target-URI: {url}" if url == url.strip() and url.isprintable() else f"X-Quoted-URI: {quote(url)}")
    if page_id is not None:
        lines.append(f"X-Page-ID: {page_id}")
    if html is None:
        lines.append("X-No-Content: true")
    lines += ["Content-Type: text/html; charset=utf-8", f"Content-Length: {len(body)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


def write_warc(pages: DataFrame, folder: str) -> None:
    """One file a task in folder, each put in place in one step under the task's number, so that a task that runs again replaces its file."""
    fs, path = pafs.FileSystem.from_uri(folder)
    fs.create_dir(path, recursive=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, path = pafs.FileSystem.from_uri(folder)
        name = f"part-{TaskContext.get().partitionId():06d}.warc"
        draft = f"{path}/.{name}.{uuid4().hex}"
        rows = 0
        with fs.open_output_stream(draft) as out:
            for batch in batches:
                for at in range(0, batch.num_rows, 512):
                    part = batch.slice(at, 512)
                    out.write(b"".join(record(*r) for r in zip(*(c.to_pylist() for c in part.columns), strict=True)))
                rows += batch.num_rows
        fs.move(draft, f"{path}/{name}")
        yield pa.RecordBatch.from_pydict({"rows": pa.array([rows], pa.int64())})

    pages.select(F.col("page_id").cast("bigint"), "url", "html").mapInArrow(run, "rows bigint").agg(F.sum("rows")).collect()


class Window:
    """A file's bytes from lo on, read further as asked."""

    def __init__(self, folder: str, path: str, size: int, lo: int, hi: int):
        self.file = pafs.FileSystem.from_uri(folder)[0].open_input_file(path)
        self.size, self.lo = size, lo
        self.blank = (0, -1)  # no header ends between these two places but at the second
        self.bytes = bytes(self.file.read_at(min(hi, size) - lo, lo))

    def upto(self, end: int) -> None:
        """At least to end, if the file goes as far."""
        have = self.lo + len(self.bytes)
        if have < min(end, self.size):
            self.bytes += self.file.read_at(min(max(end, have + (64 << 10)), self.size) - have, have)

    def header(self, at: int) -> tuple[int, int] | None:
        """(first byte of the content, its length) of a record at `at`; None if there can't be one."""
        self.upto(at + 10)
        if not MAGIC.match(self.bytes, at - self.lo):
            return None
        end = self.header_end(at)
        if end < 0:
            return None
        found = LENGTH.search(self.bytes, at - self.lo + 8, end - self.lo)
        return (end + 4, int(found[1])) if found else None

    def header_end(self, at: int) -> int:
        """The first empty line from `at` on, read as far as it takes; -1 if the file has none. Many candidates before one empty line cost one search."""
        begin, end = self.blank
        if begin <= at <= end:
            return end
        if end < 0 < begin <= at:  # none from begin on
            return -1
        seek = at
        while (found := self.bytes.find(b"\r\n\r\n", seek - self.lo)) < 0:
            have = self.lo + len(self.bytes)
            if have >= self.size:
                self.blank = (max(at, 1), -1)
                return -1
            seek = max(at, have - 3)
            self.upto(have + max(16 << 10, have - at))  # twice as far each time
        self.blank = (at, self.lo + found)
        return self.lo + found

    def close(self) -> None:
        self.file.close()


def split_links(view: Window, lo: int, hi: int) -> dict[int, int]:
    """For each candidate in [lo, hi) where the chain from it leaves the split; -1 where it breaks before."""
    view.upto(hi + 9)  # a record that begins in the last bytes
    after: dict[int, int] = {}
    at, found = 0, []
    for m in MAGIC.finditer(view.bytes[: hi - lo + 9]):
        at = lo + m.start()
        if at < hi and (head := view.header(at)):
            found.append((at, head[0] + head[1] + 4))
    for at, then in reversed(found):
        after[at] = then if then >= hi else after.get(then, -1)
    return after


def splits(spark: SparkSession, folder: str, split_bytes: int) -> tuple[DataFrame, int]:
    """(path, size, lo) of every split, a task for each as far as MOST_TASKS goes; and the number of tasks."""
    fs, path = pafs.FileSystem.from_uri(folder)
    files = [(f.path, f.size) for f in fs.get_file_info(pafs.FileSelector(path, recursive=True)) if f.is_file and f.size and not f.base_name.startswith(".")]
    table = spark.createDataFrame(files, "path string, size bigint")
    tasks = max(1, min(MOST_TASKS, sum(-(-size // split_bytes) for _, size in files)))  # a row stands for split_bytes of work: partitions must not be merged by their own size
    return table.select("path", "size", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("size") - 1, F.lit(split_bytes))).alias("lo")).repartition(tasks), tasks


def chains(spark: SparkSession, folder: str, split_bytes: int) -> tuple[DataFrame, int]:
    """(path, size, at, then) of the candidates at which splits are really entered; and the number of tasks."""
    parts, tasks = splits(spark, folder, split_bytes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, size, lo in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                hi = min(size, lo + split_bytes)
                view = Window(folder, path, size, lo, hi)
                links = split_links(view, lo, hi)
                view.close()
                yield pa.RecordBatch.from_pydict({"path": pa.array([path] * len(links), pa.string()), "size": pa.array([size] * len(links), pa.int64()), "at": pa.array(links.keys(), pa.int64()), "then": pa.array(links.values(), pa.int64())})

    links = _shared.stash(parts.mapInArrow(run, "path string, size bigint, at bigint, then bigint"), "warc-links")
    reach = links.where("at = 0").select("path", "at")
    # candidates that no candidate of another split leads to can't be entered
    jump = links.where("then > 0 and then < size").join(links.where("then > 0").select("path", F.col("then").alias("at")).distinct().union(reach), ["path", "at"], "left_semi").select("path", "at", "then")
    size = -1
    while True:
        reach = _shared.stash(reach.distinct(), "warc-reach")
        if (now := reach.count()) == size:
            break
        size = now
        jump = _shared.stash(jump, "warc-jump")
        reach = reach.union(reach.join(jump, ["path", "at"]).select("path", F.col("then").alias("at")))
        jump = jump.alias("a").join(jump.alias("b"), F.expr("a.path = b.path and a.then = b.at")).selectExpr("a.path", "a.at", "b.then")
    return reach.join(links, ["path", "at"]).select("path", "size", "at", "then"), tasks


def entries(spark: SparkSession, folder: str, split_bytes: int) -> DataFrame:
    """(path, size, lo, entry): where each split that records begin in is really entered; in as many tasks as splits() has."""
    found, tasks = chains(spark, folder, split_bytes)
    return found.select("path", "size", (F.floor(F.col("at") / split_bytes) * split_bytes).alias("lo"), F.col("at").alias("entry")).repartition(tasks)


def damaged(spark: SparkSession, folder: str, split_bytes: int = 32 << 20) -> DataFrame:
    """(path, size, entry): files whose chain doesn't end with the file, and the last place at which it entered a split; records are read from there to the damage.

    Files that don't begin with a record are not listed: they are no WARC files.
    """
    found, _ = chains(spark, folder, split_bytes)
    last = found.groupBy("path", "size").agg(F.max_by(F.struct("at", "then"), "at").alias("x"))
    return last.where("x.then != size").select("path", "size", F.col("x.at").alias("entry"))




RECORD = "path string, offset bigint, headers map<string,string>, content binary"


def read_warc(spark: SparkSession, folder: str, split_bytes: int = 32 << 20) -> DataFrame:
    """(path, offset, headers, content) of each record that a chain from its file's start reaches; header names in lower case."""
    kinds = [pa.string(), pa.int64(), pa.map_(pa.string(), pa.string()), pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, size, lo, at in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                hi = min(size, lo + split_bytes)
                view = Window(folder, path, size, at, hi)
                rows, held = [], 0
                while at < hi and (head := view.header(at)):
                    begin, length = head
                    view.upto(begin + length)
                    lines = view.bytes[at - view.lo : begin - view.lo - 4].decode("utf-8", "replace").split("\r\n")[1:]
                    headers = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
                    rows.append((path, at, list(headers.items()), view.bytes[begin - view.lo : begin - view.lo + length]))
                    held += length
                    at = begin + length + 4
                    if held > 4 << 20:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], ["path", "offset", "headers", "content"])
                        rows, held = [], 0
                view.close()
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], ["path", "offset", "headers", "content"])

    return entries(spark, folder, split_bytes).mapInArrow(run, RECORD)


def pages_of(records: DataFrame) -> DataFrame:
    """page_id, url and html of records that write_warc wrote."""
    header = lambda name: F.col("headers")[name]
    plain = F.coalesce(header("warc-target-uri"), F.when(header("x-quoted-uri").isNotNull(), F.url_decode(F.replace(header("x-quoted-uri"), F.lit("+"), F.lit("%2B")))))
    return records.select(header("x-page-id").cast("bigint").alias("page_id"), plain.alias("url"), F.when(header("x-no-content").isNull(), F.col("content").cast("string")).alias("html"))


def op1_warc(spark, sf_dir: str) -> DataFrame:
    """Writes all pages as WARC files in the shared folder and reads them back."""
    folder = _shared.scratch_path(spark, "warc")
    write_warc(spark.read.parquet(f"{sf_dir}/pages.parquet"), folder)
    return pages_of(read_warc(spark, folder))


OP1_SQL = "SELECT page_id, url, html FROM pages"
