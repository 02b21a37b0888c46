"""Web archives: records written, read back, and indexed in order of URL key and time.

Pages of equal payload are one response and revisits of it. Executors write gzipped WARC files to
the shared folder. Reading an archive gives a run of captures, sorted, written as an Arrow file of
batches, with the first key of each batch beside it. Runs merge through loser trees, FAN_IN at a
time, pass after pass until MOST_RUNS or fewer are left. For the global order, splitters drawn from
the runs cut the key space into ranges, and each range is merged from the batches of those runs
that reach into it.
"""

from __future__ import annotations

import hashlib
import json
import zlib
from bisect import bisect_right
from collections.abc import Iterator
from datetime import UTC, datetime, timedelta
from itertools import groupby, islice
from urllib.parse import quote, urlsplit

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chunkspark.llm.files import create, open_random, open_system, task_file
from chunkspark.llm.shared import hashed_side, lookup_join, materialise, new_folder, spread

#: Payloads below this many bytes are always stored whole.
LEAST_SHARED = 100
#: Bytes of payload, and records, after which a task begins a new archive.
ROLL_AT, ROLL_RECORDS = 256 << 20, 50_000
#: Runs that one loser tree merges, captures in a batch of a run, and captures of a merged range.
FAN_IN, BATCH, RANGE = 64, 2048, 100_000
#: Runs that the last merge, of ranges, reads at most.
MOST_RUNS = 256
#: Pages carry no time; the capture of page p is this many seconds after EPOCH: p.
EPOCH = datetime(2000, 1, 1, tzinfo=UTC)
END = b"\r\n"

CAPTURE = pa.schema([
    ("url_key", pa.string()), ("capture_time", pa.string()), ("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()),
    ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("refers_to", pa.int64()), ("warc_file", pa.string()), ("warc_offset", pa.int64()), ("warc_length", pa.int64()),
])
CAPTURE_SQL = "url_key string, capture_time string, page_id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long, warc_file string, warc_offset long, warc_length long"
KEY = ("url_key", "capture_time", "page_id", "warc_file", "warc_offset")


def url_key(url: str) -> str:
    """Sort key of a URL: reversed host, port, path and query in lower case, without scheme or fragment."""
    try:
        parts = urlsplit(url if "//" in url else f"//{url}")
        host, port = (parts.hostname or ""), parts.port
    except ValueError:
        return url.lower()
    host = ",".join(reversed(host.removeprefix("www.").split(".")))
    return f"{host}{f':{port}' if port else ''}){parts.path or '/'}{f'?{parts.query}' if parts.query else ''}".lower()


def page_uri(page_id: int | None) -> str:
    return "<urn:page:none>" if page_id is None else f"<urn:page:{page_id}>"


def page_of(uri: str) -> int | None:
    name = uri.strip("<>").rpartition(":")[2]
    return None if name == "none" else int(name)


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """A WARC record; a revisit (`refers_to` given) has the HTTP header alone."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    try:
        when = EPOCH + timedelta(seconds=page_id or 0)
    except OverflowError:
        when = EPOCH
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {page_uri(page_id)}", f"WARC-Date: {when:%Y-%m-%dT%H:%M:%SZ}"]
    if url is not None:
        head.append(f"WARC-Target-URI: {quote(url, safe=''.join(map(chr, range(0x21, 0x7F))))}")
    head.append(f"WARC-Payload-Digest: sha256:{digest}")
    if refers_to is not None:
        head += [f"WARC-Refers-To: {page_uri(refers_to)}", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + END + END + block + END + END


def _zipped(data: bytes) -> bytes:
    z = zlib.compressobj(1, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


def _write(folder: str, roll_at: int, roll_records: int):
    def run(batches):
        out, name, size, n, part = None, None, 0, 0, 0
        for batch in batches:
            done = []
            col = [c.to_pylist() for c in batch.columns[:2]]
            text, digests, refers = batch.column(2), batch.column(3).to_pylist(), batch.column(4).to_pylist()
            for page_id, url, html, digest, ref in zip(*col, text, digests, refers, strict=True):
                if out is None:
                    name, size, n, part = f"{task_file(folder, 'pages')}-{part}.warc.gz", 0, 0, part + 1
                    out = create(name)
                payload = (html.as_py() or "").encode()
                out.write(_zipped(record(page_id, url, payload, digest, ref)))
                size += len(payload)
                n += 1
                if size >= roll_at or n >= roll_records:
                    out.close()
                    out = None
                    done.append(name)
            yield pa.RecordBatch.from_arrays([pa.array(done, pa.string())], names=["file"])
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_arrays([pa.array([name])], names=["file"])

    return run


def write_archives(pages: DataFrame, folder: str, page_id: str = "page_id", url: str = "url", html: str = "html", roll_at: int = ROLL_AT, roll_records: int = ROLL_RECORDS) -> DataFrame:
    """Write a record per row of `pages` to archives in `folder`; returns their names (column file).

    Of equal payloads of LEAST_SHARED bytes or more the row with the smallest id is the response
    and the others, of larger or no id, revisit it. Null html is an empty payload.
    """
    payload = F.coalesce(F.col(html), F.lit("")).cast("binary")
    rows = pages.select(F.col(page_id).cast("long").alias("page_id"), F.col(url).alias("url"), F.coalesce(F.col(html), F.lit("")).alias("html"), F.sha2(payload, 256).alias("digest"))
    name = F.coalesce(F.col("page_id").cast("string"), F.lit("none")).alias("name")
    slim = materialise(rows.select("page_id", name, "digest", F.octet_length("html").alias("n_bytes")), "payloads")
    slim = slim.filter(f"n_bytes >= {LEAST_SHARED}")
    groups = slim.groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n"))  # every digest, so that hot ones are known
    found = lookup_join(slim, materialise(groups, "payload_groups"), ["digest"], "n", slim.count(), F.col("page_id"))
    revisits = materialise(found.filter("first is not null and not first <=> page_id").select("name", "digest", F.col("first").alias("refers_to")).distinct(), "revisits")
    marked = rows.withColumn("name", name).join(hashed_side(revisits, revisits.count()), ["name", "digest"], "left")
    return materialise(marked.select("page_id", "url", "html", "digest", "refers_to").mapInArrow(_write(folder, roll_at, roll_records), "file string"), "archives")


def read_records(stream) -> Iterator[tuple[int, int, dict[str, str], bytes]]:
    """(offset, length, header, block) of each gzip member of an archive, in constant memory."""
    held, at = b"", 0
    while True:
        z, parts, used = zlib.decompressobj(31), [], 0
        while not z.eof:
            if not held and not (held := stream.read(1 << 20)):
                if used:
                    raise ValueError(f"the archive ends within the record at {at}")
                return
            parts.append(z.decompress(held))
            used += len(held) - len(z.unused_data)
            held = z.unused_data
        data = b"".join(parts)
        head, _, rest = data.partition(END + END)
        lines = head.decode().split("\r\n")
        header = dict(x.split(": ", 1) for x in lines[1:])
        yield at, used, header, rest[: int(header["Content-Length"])]
        at += used


def capture(name: str, offset: int, length: int, header: dict[str, str], block: bytes) -> tuple:
    """A row of CAPTURE. A response's digest is that of the payload as read."""
    http, _, payload = block.partition(END + END)
    url, kind = header.get("WARC-Target-URI"), header["WARC-Type"]
    said = header["WARC-Payload-Digest"].removeprefix("sha256:")
    if kind == "response":
        size, digest, ref = len(payload), hashlib.sha256(payload).hexdigest(), None
        if digest != said:
            raise ValueError(f"{name}: the payload at {offset} is damaged")
    else:
        size = next(int(x.split(b": ")[1]) for x in http.split(END) if x.startswith(b"Content-Length: "))
        digest, ref = said, page_of(header["WARC-Refers-To"])
    return (url_key(url or ""), header["WARC-Date"], page_of(header["WARC-Record-ID"]), url, kind, size, digest, ref, name, offset, length)


def _order(row: tuple) -> tuple:
    """Sort key of a capture: URL key, time, page (none first), place."""
    return (row[0], row[1], -(2**63) if row[2] is None else row[2], row[8], row[9])


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else [[] for _ in CAPTURE]
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, CAPTURE, strict=True)], schema=CAPTURE)


def _write_run(name: str, rows: Iterator[tuple]) -> int:
    """Write captures in order as a run; returns their number."""
    n, firsts = 0, []
    with create(name) as out, pa.ipc.new_file(out, CAPTURE) as writer:
        while some := list(islice(rows, BATCH)):
            firsts.append(_order(some[0]))
            writer.write_batch(_batch(some))
            n += len(some)
    with create(f"{name}.keys") as out:
        out.write(json.dumps(firsts).encode())
    return n


def _runs(folder: str):
    """Read archives; each gives a sorted run. Yields the run's name, size and some of its keys."""
    def run(batches):
        for batch in batches:
            for name in batch.column(0).to_pylist():
                system, path = open_system(name)
                with system.open_input_stream(path) as stream:
                    rows = sorted((capture(name, *r) for r in read_records(stream)), key=_order)
                run_name = task_file(folder, "run") + "-" + hashlib.md5(name.encode()).hexdigest()[:12]
                _write_run(run_name, iter(rows))
                sample = [_order(r)[:3] for r in rows[:: max(1, len(rows) // 64)]]
                m = len(sample)
                yield pa.RecordBatch.from_arrays([pa.array([run_name] * m, pa.string()), pa.array([len(rows)] * m, pa.int64()), *(pa.array([s[k] for s in sample], t) for k, t in enumerate((pa.string(), pa.string(), pa.int64())))], names=["run", "n", "url_key", "capture_time", "page_id"])

    return run


def _merge_groups(folder: str, bounds):
    """Of rows part, group and run, sorted: one run of each group, with its part and size. `bounds` are where parts begin."""
    def run(batches):
        cuts = bounds.value
        rows = ((p, g, r) for batch in batches for p, g, r in zip(*(c.to_pylist() for c in batch.columns), strict=True))
        for (part, group), own in groupby(rows, key=lambda x: x[:2]):
            name = f"{task_file(folder, 'merged')}-{part}-{group}"
            n = _write_run(name, merged([r for _, _, r in own], cuts[part - 1] if part else None, cuts[part] if part < len(cuts) else None))
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([name]), pa.array([n], pa.int64())], names=["part", "run", "n"])

    return run


def run_slice(name: str, low: tuple | None, high: tuple | None) -> Iterator[tuple]:
    """Captures of a sorted run with low <= key < high, read batch by batch."""
    with open_random(f"{name}.keys") as f:
        firsts = [tuple(x) for x in json.loads(f.read())]
    if not firsts or (high is not None and firsts[0][:3] >= high):
        return
    with open_random(name) as f:
        reader = pa.ipc.open_file(f)
        for i, first in enumerate(firsts):
            if high is not None and first[:3] >= high:
                return
            if low is not None and i + 1 < len(firsts) and firsts[i + 1][:3] < low:
                continue
            for row in zip(*(c.to_pylist() for c in reader.get_batch(i).columns), strict=True):
                key = _order(row)[:3]
                if (low is None or key >= low) and (high is None or key < high):
                    yield row


class LoserTree:
    """Merges sorted iterators. Inner nodes hold the loser of their match; a step replays one path."""

    def __init__(self, sources: list[Iterator[tuple]], key=_order):
        self.sources, self.key = sources, key
        self.n = max(1, len(sources))
        self.heads = [self._next(i) for i in range(len(sources))] or [None]
        self.losers = [-1] * self.n
        for i in range(self.n):
            self._replay(i)

    def _next(self, i: int):
        row = next(self.sources[i], None)
        return None if row is None else (self.key(row), i, row)

    def _replay(self, i: int) -> None:
        """Let leaf i play up to the root; an empty node ends its way while the tree is being built."""
        node = (i + self.n) // 2
        while node:
            other = self.losers[node]
            if other < 0:
                self.losers[node] = i
                return
            if self._beats(other, i):
                self.losers[node], i = i, other
            node //= 2
        self.losers[0] = i

    def _beats(self, a: int, b: int) -> bool:
        x, y = self.heads[a], self.heads[b]
        return x is not None and (y is None or x[:2] < y[:2])

    def __iter__(self) -> Iterator[tuple]:
        while (head := self.heads[self.losers[0]]) is not None:
            i = self.losers[0]
            yield head[2]
            self.heads[i] = self._next(i)
            self._replay(i)


def merged(runs: list[str], low: tuple | None, high: tuple | None) -> Iterator[tuple]:
    """Captures of all runs in a range, in order; trees of FAN_IN runs feed one above them."""
    trees = [iter(LoserTree([run_slice(r, low, high) for r in runs[i : i + FAN_IN]])) for i in range(0, len(runs), FAN_IN)]
    return trees[0] if len(trees) == 1 else iter(LoserTree(trees))


def _ranges(runs, bounds):
    """Captures of ranges by number. `runs` has the ranges at which parts begin, but for the first, and each part's runs."""
    def run(batches):
        (parts, names), cuts = runs.value, bounds.value
        for batch in batches:
            for i in batch.column(0).to_pylist():
                rows: list[tuple] = []
                own = names.get(bisect_right(parts, i), [])
                for row in merged(own, cuts[i - 1] if i else None, cuts[i] if i < len(cuts) else None):
                    rows.append(row)
                    if len(rows) == BATCH:
                        yield _batch(rows)
                        rows = []
                if rows:
                    yield _batch(rows)

    return run


def read_archives(archives: DataFrame, folder: str, per_range: int = RANGE, most_runs: int = MOST_RUNS) -> DataFrame:
    """Captures of the archives named in `archives` (column file), see CAPTURE, globally ordered.

    Partitions are ranges of keys in order, and sorted. Passes merge within parts of the keys, at least
    `most_runs` groups of runs in each, so that none has fewer tasks than the cluster has cores. The
    driver sees the names of the last `most_runs` runs of each part and one splitter per range.
    """
    spark = archives.sparkSession
    sample = spread(archives.select("file"), "file").mapInArrow(_runs(folder), "run string, n long, url_key string, capture_time string, page_id long")
    sample = materialise(sample, "run_keys")
    runs = materialise(sample.select("run", "n").distinct(), "runs")  # one per archive that has records
    n_runs, total = runs.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    n = max(1, -(-total // per_range))
    cuts: list[tuple] = []
    if n > 1:
        by = ["url_key", "capture_time", "page_id"]
        dealt = sample.select(by).repartitionByRange(n, *by).groupBy(F.spark_partition_id().alias("p")).agg(F.min(F.struct(*by)).alias("k"))
        cuts = sorted({tuple(r["k"]) for r in dealt.collect()})[1:]
    # a pass has a task for each part of the keys and group of runs, no fewer than the cluster's cores if ranges are as many
    n_parts = min(len(cuts) + 1, max(1, -(-spark.sparkContext.defaultParallelism // most_runs))) if n_runs > most_runs else 1
    starts = [i * (len(cuts) + 1) // n_parts for i in range(1, n_parts)]  # parts begin at these ranges
    part_cuts = spark.sparkContext.broadcast([cuts[i - 1] for i in starts])
    runs = runs.select(F.explode(F.sequence(F.lit(0), F.lit(n_parts - 1))).alias("part"), "run", "n")
    while n_runs > most_runs:
        groups = max(-(-n_runs // FAN_IN), most_runs)
        dealt = runs.select("part", F.pmod(F.xxhash64("run"), F.lit(groups)).alias("group"), "run")
        dealt = dealt.repartition(groups * n_parts, "part", "group").sortWithinPartitions("part", "group", "run")
        runs = materialise(dealt.mapInArrow(_merge_groups(folder, part_cuts), "part int, run string, n long"), "runs")
        n_runs = groups
    own: dict[int, list[str]] = {}
    for r in runs.select("part", "run").collect():  # `most_runs` of each part at most
        own.setdefault(r["part"], []).append(r["run"])
    names = spark.sparkContext.broadcast((starts, {part: sorted(own[part]) for part in own}))
    bounds = spark.sparkContext.broadcast(cuts)
    return spark.range(0, len(cuts) + 1, 1, len(cuts) + 1).mapInArrow(_ranges(names, bounds), CAPTURE_SQL)


def archive_pages(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """Write `pages` to archives, read them back: one capture per page, ordered by URL key and time.

    Pages of one URL are its history in order of time, then id. Null URLs sort as empty ones.
    Repeated rows are records of their own: under one id all are the response. A page without an
    id is a revisit of any page with one. An empty table gives no rows.
    """
    folder = new_folder(pages.sparkSession, "archives")
    archives = write_archives(pages, folder, page_id, url, html)
    return read_archives(archives, folder)
