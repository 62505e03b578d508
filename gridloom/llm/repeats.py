"""Repeated windows over a whole corpus, exactly, with an exchange of a few samples instead of all windows.

A sequence (the words or the bytes of a text) has windows of `width` units. Each window picks one sampled position
from its own content alone, so equal windows pick the same position relative to their start; a position's windows are
consecutive and form a chunk. What is exchanged are chunks (about one for each dozen words, or for 67 bytes):

1. `key` names the units around a chunk's position. A key that one document alone has (or that occurs once) holds no
   repeat; its chunks go.
2. `name` names all units of a chunk. Equal names settle all windows of the chunks at once. Where a text repeats itself
   with a period, each window is a chunk of its own; chunks of one name that lie a step p apart r times are one row.
3. Where chunks with different names share a key (a repeat begins or ends inside), one chunk of each name gives its
   windows, by a 96-bit name each. Their distinct names are exchanged in packed, sorted runs by range of names, and a
   bit for each comes back.
All groupings are sums or minima with map-side combining, joins are ones that Spark can split, so that a passage that
a third of the documents share stays spread. Texts are never exchanged: what a task needs of the results for its rows
is written by input partition to the shared folder and read by that partition's task in the next pass over the texts.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridloom.llm.arrowtext import U, Rolling, mixed, signed, slices, tidy
from gridloom.llm.session import removed, scratch, ship, tasks, written

CHUNKS = "key long, name1 long, name2 long, doc long, row long, s int, n int, p int, r int"
#: A document without an id comes after all others.
LAST = (1 << 63) - 1
HIGH = U(0xFFFFFFFFFFFFFFFF)


@dataclass
class Units:
    """The units of some texts: two hashes of each, the first unit of each text, and where units may be sampled.

    key: the name of the units around each position; sampled: which positions may be picked; a window that starts at i
    picks among positions i + low .. i + high.
    """

    hashes: tuple[np.ndarray, np.ndarray]
    bound: np.ndarray
    key: np.ndarray
    sampled: np.ndarray
    low: int
    high: int


def sliding_minimum(v: np.ndarray, width: int) -> np.ndarray:
    """min(v[i : i + width]) for each i, by blocks: suffix minima of one block and prefix minima of the next."""
    n = len(v)
    if n < width:
        return v[:0]
    blocks = -(-n // width)
    pad = np.full(blocks * width, HIGH, U)
    pad[:n] = v
    grid = pad.reshape(blocks, width)
    ahead = np.minimum.accumulate(grid, 1).ravel()
    behind = np.minimum.accumulate(grid[:, ::-1], 1)[:, ::-1].ravel()
    return np.minimum(behind[: n - width + 1], ahead[width - 1 : n])


def starts(bound: np.ndarray, width: int) -> np.ndarray:
    """Whether a window starts at each unit and ends in the same text."""
    n = int(bound[-1])
    size = np.diff(bound)
    left = np.repeat(bound[1:], size) - np.arange(n)
    return left >= width


def chunks(u: Units, width: int) -> tuple[np.ndarray, ...]:
    """(text, position, first window, last window) of each chunk."""
    n = int(u.bound[-1])
    if n < width:
        return (np.zeros(0, np.int64),) * 4
    mark = U(0xFFFFFFFF)  # equal names: the first of them; alike in every slice
    v = np.where(u.sampled, (mixed(u.key) & ~mark) | np.arange(n, dtype=U), HIGH)
    at = np.flatnonzero(starts(u.bound, width))
    if not len(at):
        return (np.zeros(0, np.int64),) * 4
    least = sliding_minimum(v, u.high - u.low + 1)[at + u.low]
    position = (least & mark).astype(np.int64)
    new = np.flatnonzero(np.concatenate([[True], (position[1:] != position[:-1]) | (at[1:] != at[:-1] + 1)]))
    end = np.append(new[1:], len(at)) - 1
    text = np.searchsorted(u.bound, at[new], "right") - 1
    return text, position[new], at[new], at[end]


def steps(text: np.ndarray, names: list[np.ndarray], s: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first chunk, step, how many) of runs of chunks of one text with equal names and starts a constant step apart."""
    n = len(s)
    order = np.lexsort((s, names[1], names[0], text))
    t, a, b, at = text[order], names[0][order], names[1][order], s[order]
    same, d = np.zeros(n, bool), np.zeros(n, np.int64)
    same[1:] = (t[1:] == t[:-1]) & (a[1:] == a[:-1]) & (b[1:] == b[:-1])
    d[1:] = at[1:] - at[:-1]
    change = np.zeros(n, bool)  # the step differs from the one before
    change[1:] = same[1:] & same[:-1] & (d[1:] != d[:-1])
    place = np.arange(n)
    since = place - np.maximum.accumulate(np.where(change, 0, place))
    first = np.flatnonzero(~same | (change & (since % 2 == 1)))  # after a new run's first chunk the second sets its step
    many = np.diff(np.append(first, n))
    return order[first], np.where(many > 1, d[np.minimum(first + 1, n - 1)], 0), many


def _chunk_rows(parse: Callable, width: int, slice_bytes: int):
    names = [x.split()[0] for x in CHUNKS.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = TaskContext.get().partitionId() << 32
        for batch in batches:
            for part in slices(batch, limit=slice_bytes):
                u: Units = parse(part.column("text"))
                text, p, s, e = chunks(u, width)
                if len(s):
                    name = [Rolling(h, k).span(s, e + width) for k, h in enumerate(u.hashes)]
                    with np.errstate(over="ignore"):
                        name[0] = mixed(name[0] ^ (p - s).astype(U))
                    one, step, many = steps(text, name, s)
                    text, p, s, e = (x[one] for x in (text, p, s, e))
                    doc = np.asarray(part.column("doc_id").fill_null(LAST))[text]
                    out = [signed(u.key[p]), signed(name[0][one]), signed(name[1][one]), doc, row + text, *(x.astype(np.int32) for x in (s - u.bound[text], e - s + 1, step, many))]
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in out], names)
                row += part.num_rows

    return run


class Open:
    """The windows of the runs of starts that a side file lists, of one slice, by distinct name in sorted order."""

    def __init__(self, part: pa.RecordBatch, got: dict, first: int, parse: Callable, width: int):
        some = sorted(got)
        rows = part.take(pa.array(some))
        u: Units = parse(rows.column("text"))
        at, row = [], []
        for k, i in enumerate(some):
            begin, end, _ = got[i]
            a = np.flatnonzero(covered(begin, end, int(u.bound[k + 1] - u.bound[k]))) + u.bound[k]
            at.append(a)
            row.append(np.full(len(a), k))
        at, row = np.concatenate(at), np.concatenate(row)
        name = [Rolling(h, k).span(at, at + width) for k, h in enumerate(u.hashes)]
        name[1] >>= U(32)
        order = np.lexsort((name[1], name[0]))
        self.one, self.two = name[0][order], name[1][order]
        new = np.ones(len(order), bool)
        new[1:] = (self.one[1:] != self.one[:-1]) | (self.two[1:] != self.two[:-1])
        self.cut = np.flatnonzero(new)
        self.group = np.cumsum(new) - 1
        self.size = np.diff(np.append(self.cut, len(order)))
        self.doc = np.asarray(rows.column("doc_id").fill_null(LAST))[row[order]]
        self.low = np.minimum.reduceat(self.doc, self.cut) if len(order) else self.doc
        self.row = first + np.array(some)[row[order]]
        self.start = (at - u.bound[row])[order]

    def packed(self, buckets: int) -> Iterator[tuple[int, bytes]]:
        """(range of names, distinct names with the least document and whether there are several)."""
        one, two = self.one[self.cut], self.two[self.cut]
        bucket = ((one >> U(32)) * U(buckets) >> U(32)).astype(np.int64)
        edge = np.flatnonzero(np.diff(bucket, prepend=-1)).tolist()
        for a, b in zip(edge, [*edge[1:], len(one)], strict=False):
            yield int(bucket[a]), one[a:b].astype("<u8").tobytes() + two[a:b].astype("<u4").tobytes() + self.low[a:b].astype("<i8").tobytes() + (self.size[a:b] > 1).astype("u1").tobytes()


def _window_names(parse: Callable, width: int, slice_bytes: int, side: str, buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        listed, part_id = Side(side), TaskContext.get().partitionId()
        for batch in batches:
            for part in slices(batch, limit=slice_bytes):
                if got := listed.rows(part):
                    rows = list(Open(part, got, listed.first, parse, width).packed(buckets))
                    n = len(rows)
                    yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([part_id] * n, pa.int64()), pa.array([listed.first] * n, pa.int64()), pa.array([r[1] for r in rows], pa.binary())], ["bucket", "part", "first", "packed"])

    return run


def _decided(others: bool):
    """Packed names of a range together: a bit for each, whether it also starts elsewhere (in a smaller document)."""

    def decide(held: list[tuple[int, int, bytes]], bucket: int) -> pa.RecordBatch:
        size = [len(x[2]) // 21 for x in held]
        field = lambda kind, at, width: np.concatenate([np.frombuffer(x[2], kind, n, at * n) for x, n in zip(held, size, strict=True)])
        one, two, low, many = field("<u8", 0, 8), field("<u4", 8, 4), field("<i8", 12, 8), field("u1", 20, 1)
        order = np.lexsort((two, one))
        a, b = one[order], two[order]
        new = np.ones(len(order), bool)
        new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
        cut, group = np.flatnonzero(new), np.cumsum(new) - 1
        if others:
            bit = np.minimum.reduceat(low[order], cut)[group] < low[order]
        else:
            bit = np.add.reduceat(1 + many[order].astype(np.int64), cut)[group] > 1
        back = np.empty(len(order), bool)
        back[order] = bit
        ends = np.cumsum([0, *size]).tolist()
        bits = [np.packbits(back[x:y]).tobytes() for x, y in zip(ends, ends[1:], strict=False)]
        return pa.RecordBatch.from_arrays([pa.array([x[0] for x in held], pa.int64()), pa.array([x[1] for x in held], pa.int64()), pa.array([bucket] * len(held), pa.int32()), pa.array(size, pa.int32()), pa.array(bits, pa.binary())], ["part", "first", "bucket", "n", "bits"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int, int, bytes]] = []
        now = None
        for batch in batches:
            for bucket, *rest in zip(*(batch.column(c).to_pylist() for c in ("bucket", "part", "first", "packed")), strict=True):
                if bucket != now and held:
                    yield decide(held, now)
                    held = []
                now = bucket
                held.append(tuple(rest))
        if held:
            yield decide(held, now)

    return run


def _hits(parse: Callable, width: int, slice_bytes: int, side: str, bits: str, others: bool):
    """Rows (row, s, n, doc): the runs of starts of the windows that were decided to count."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        listed = Side(side)
        table = beside(bits)
        known = {}
        for t in table:
            for first, bucket, n, x in zip(*(t.column(c).to_pylist() for c in ("first", "bucket", "n", "bits")), strict=True):
                known.setdefault(first, []).append((bucket, n, x))
        for batch in batches:
            for part in slices(batch, limit=slice_bytes):
                if not (got := listed.rows(part)):
                    continue
                w = Open(part, got, listed.first, parse, width)
                told = sorted(known.get(listed.first, []))
                bit = np.concatenate([np.unpackbits(np.frombuffer(x, np.uint8), count=n) for _, n, x in told]).astype(bool)
                if len(bit) != len(w.cut):
                    raise RuntimeError("the input's rows came in other batches in this pass; write it to a table first")
                if others:
                    hit = bit[w.group] | (w.doc > w.low[w.group])
                else:
                    hit = bit[w.group]
                order = np.lexsort((w.start[hit], w.row[hit]))
                row, s, doc = (x[hit][order] for x in (w.row, w.start, w.doc))
                cut = np.flatnonzero(np.concatenate([np.ones(min(1, len(s)), bool), (s[1:] != s[:-1] + 1) | (row[1:] != row[:-1])]))
                n = np.diff(np.append(cut, len(s)))
                yield pa.RecordBatch.from_arrays([pa.array(row[cut]), pa.array(s[cut].astype(np.int32)), pa.array(n.astype(np.int32)), pa.array(doc[cut])], ["row", "s", "n", "doc"])

    return run


def covered(begin: np.ndarray, end: np.ndarray, n: int) -> np.ndarray:
    """Which of n units lie in one of the spans begin..end (end not included)."""
    change = np.zeros(n + 1, np.int64)
    np.add.at(change, begin, 1)
    np.add.at(change, np.minimum(end, n), -1)
    return np.cumsum(change[:-1]) > 0


def opened(path: str) -> tuple[pafs.FileSystem, str]:
    """Arrow's file system for a path as Spark spells it."""
    if ":/" not in path:
        return pafs.LocalFileSystem(), path
    scheme, _, rest = path.partition(":")
    if scheme == "dbfs":
        return pafs.LocalFileSystem(), "/dbfs/" + rest.lstrip("/")
    return pafs.FileSystem.from_uri({"s3a": "s3", "s3n": "s3", "abfss": "abfs"}.get(scheme, scheme) + ":" + rest)


def beside(path: str, part: int | None = None) -> list[pa.Table]:
    """What was written below path for an input partition, this task's if none is named."""
    fs, root = opened(path)
    part = TaskContext.get().partitionId() if part is None else part
    found = fs.get_file_info(pafs.FileSelector(f"{root}/part={part}", allow_not_found=True))
    return [pq.read_table(f.path, filesystem=fs, partitioning=None) for f in found if f.base_name.endswith(".parquet")]


class Side:
    """What the side files say of this task's input partition; rows must come in the order of the first pass."""

    def __init__(self, path: str):
        part = TaskContext.get().partitionId()
        self.first, self.doc = part << 32, None
        tables = beside(path)
        read = lambda c: np.concatenate([np.asarray(t.column(c)) for t in tables]).astype(np.int64) if tables else np.zeros(0, np.int64)
        self.row, self.s, self.n, self.doc = (read(c) for c in ("row", "s", "n", "doc"))
        stepped = tables and "r" in tables[0].column_names
        self.p, self.r = (read("p"), read("r")) if stepped else (np.zeros(len(self.row), np.int64), np.ones(len(self.row), np.int64))
        order = np.argsort(self.row, kind="stable")
        self.row, self.s, self.n, self.doc, self.p, self.r = (x[order] for x in (self.row, self.s, self.n, self.doc, self.p, self.r))
        self.next = self.first

    def rows(self, part: pa.RecordBatch) -> dict[int, tuple[np.ndarray, np.ndarray, int]]:
        """By row of this slice of the input: begins, ends and number of spans."""
        self.first = self.next
        self.next += part.num_rows
        a, b = np.searchsorted(self.row, [self.first, self.next])
        if a == b:
            return {}
        cut = np.flatnonzero(np.diff(self.row[a:b], prepend=-1)) + a
        doc = np.asarray(part.column("doc_id").fill_null(LAST))
        out = {}
        for x, y in zip(cut.tolist(), [*cut[1:].tolist(), int(b)], strict=True):
            i = int(self.row[x]) - self.first
            if doc[i] != self.doc[x]:
                raise RuntimeError("the input's rows came in another order in this pass; write it to a table first")
            s, n, p, r = self.s[x:y], self.n[x:y], self.p[x:y], self.r[x:y]
            if (r > 1).any():
                k = np.arange(int(r.sum())) - np.repeat(np.cumsum(r) - r, r)
                s, n = np.repeat(s, r) + np.repeat(p, r) * k, np.repeat(n, r)
            out[i] = (s, s + n, y - x)
        return out


def _to_side(rows: DataFrame, name: str) -> str:
    """Write (row, s, n, doc), and p and r if they are there, by input partition."""
    path = scratch(rows.sparkSession, name)
    rows.select(F.shiftright("row", 32).alias("part"), "row", "s", "n", "doc", *(c for c in ("p", "r") if c in rows.columns)).repartition(tasks(rows.sparkSession), "part").sortWithinPartitions("part").write.partitionBy("part").parquet(path)
    return path


def plain(docs: DataFrame) -> bool:
    """Whether docs only selects from a scan of files, by the nodes of its plan."""
    todo = [docs._jdf.queryExecution().optimizedPlan()]
    while todo:
        node = todo.pop()
        if node.getClass().getSimpleName() not in ("Project", "Filter", "LogicalRelation") or not node.deterministic():
            return False
        if not node.children().size() and node.relation().getClass().getSimpleName() != "HadoopFsRelation":
            return False
        todo += [node.children().apply(i) for i in range(node.children().size())]
    return True


def stable(docs: DataFrame, carry: list[str]) -> DataFrame:
    """doc_id, text and the columns to carry, in an order that repeated scans keep: a scan of files, else written first.

    Spark cuts files into partitions by the number of cores that it sees when it plans a scan, unless
    spark.sql.files.minPartitionNum is set; so it is set here, and executors that come or go between two passes don't
    change the partitions.
    """
    conf = docs.sparkSession.conf
    if conf.get("spark.sql.files.minPartitionNum", None) is None:
        conf.set("spark.sql.files.minPartitionNum", str(docs.sparkSession.sparkContext.defaultParallelism))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), *carry)
    return rows if plain(rows) else written(rows, "input")


def repeated(docs: DataFrame, parse: Callable, width: int, others: bool, finish: Callable, schema: str, slice_bytes: int, carry: tuple[str, ...] = ()) -> DataFrame:
    """Find the repeated windows of every text and give each text and its spans to `finish`.

    others: a window counts if it also starts in a document with a smaller id; else if it also starts anywhere else.
    finish(text, begins, ends) gets the spans of units that repeated windows start at, and returns the row's values.
    `carry` names columns that go along unchanged.
    """
    spark = docs.sparkSession
    ship(spark)
    docs = stable(docs, list(carry))
    texts = docs.select("doc_id", "text")
    place = scratch(spark, "chunks")
    found = written(texts.mapInArrow(tidy(_chunk_rows(parse, width, slice_bytes)), CHUNKS), "chunks", place)

    # 1. keys that can hold repeats; `many`: chunks of different names share the key
    by_key = [F.min("name1").alias("a"), F.max("name1").alias("b"), F.min("name2").alias("c"), F.max("name2").alias("d")]
    if others:
        live = found.groupBy("key").agg(F.min("doc").alias("low"), F.max("doc").alias("high"), *by_key).where("low < high")
    else:
        live = found.groupBy("key").agg(F.sum("r").alias("times"), *by_key).where("times > 1")
    made: list[str] = []

    def kept(df: DataFrame, name: str) -> DataFrame:
        made.append(scratch(spark, name))
        return written(df, name, made[-1])

    live = kept(live.select("key", ((F.col("a") != F.col("b")) | (F.col("c") != F.col("d"))).alias("many")), "keys")
    left = kept(found.join(live, "key"), "live")
    removed(spark, place)

    # 2. chunks of equal names
    place = F.struct("row", "s")
    if others:
        same = left.groupBy("key", "name1", "name2").agg(F.min("doc").alias("least"))
        met = left.join(kept(same, "names"), ["key", "name1", "name2"])
        settled, gives = F.col("doc") > F.col("least"), F.col("many") & (F.col("doc") == F.col("least"))
    else:
        same = left.groupBy("key", "name1", "name2").agg(F.min(place).alias("least"), F.sum("r").alias("times"))
        met = left.join(kept(same, "names"), ["key", "name1", "name2"])
        settled, gives = F.col("times") > 1, F.col("many") & ((F.col("times") == 1) | (place == F.col("least")))
    met = kept(met.select("row", "s", "n", "doc", "p", "r", settled.alias("settled"), gives.alias("gives")), "settled")

    # 3. windows of what is left
    side = _to_side(met.where("gives"), "open")
    n, buckets = tasks(spark), 4 * tasks(spark)
    names = texts.mapInArrow(tidy(_window_names(parse, width, slice_bytes, side, buckets)), "bucket int, part long, first long, packed binary")
    names = names.repartitionById(n, F.col("bucket") % n).sortWithinPartitions("bucket")
    bits = scratch(spark, "bits")
    made += [side, bits]
    names.mapInArrow(tidy(_decided(others)), "part long, first long, bucket int, n int, bits binary").repartition(n, "part").write.partitionBy("part").parquet(bits)
    hits = texts.mapInArrow(tidy(_hits(parse, width, slice_bytes, side, bits, others)), "row long, s int, n int, doc long")
    hits = kept(hits, "hits")  # by itself: in a union its tasks would have other numbers than the scan's
    spans = met.where("settled").select("row", "s", "n", "doc", "p", "r").unionByName(hits.select("*", F.lit(0).alias("p"), F.lit(1).alias("r")))
    side = _to_side(spans, "spans")
    for path in made:
        removed(spark, path)

    names = [x.split()[0] for x in schema.split(", ")]
    if clash := {*names, "doc_id", "text"} & set(carry):
        raise ValueError(f"carried columns are called like others: {sorted(clash)}")
    kinds = [{"long": pa.int64(), "string": pa.string()}[x.split()[1]] for x in schema.split(", ")]
    fields = T.StructType([docs.schema["doc_id"], *(docs.schema[c] for c in carry), *T._parse_datatype_string(schema).fields])
    none = np.zeros(0, np.int64)

    def last(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        listed = Side(side)
        for batch in batches:
            for part in slices(batch, limit=slice_bytes):
                got = listed.rows(part)
                rows = []
                for i in range(part.num_rows):
                    begin, end, _ = got.get(i, (none, none, 0))
                    rows.append(finish(part.column("text")[i].as_buffer().to_pybytes(), begin, end))
                whole = [part.column(c) for c in ("doc_id", *carry)] + [pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)]
                yield pa.RecordBatch.from_arrays(whole, ["doc_id", *carry, *names])

    return docs.mapInArrow(tidy(last), fields)


def without(docs: DataFrame, drops: DataFrame) -> DataFrame:
    """docs (a scan of files, as stable() tells) without the rows whose place in the input drops lists (row, doc)."""
    side = _to_side(drops.select("row", F.lit(0).alias("s"), F.lit(1).alias("n"), "doc"), "drops")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        listed = Side(side)
        for batch in batches:
            keep = np.ones(batch.num_rows, bool)
            keep[list(listed.rows(batch))] = False
            yield batch.filter(pa.array(keep))

    return docs.mapInArrow(tidy(run), docs.schema)


def sha256(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()
