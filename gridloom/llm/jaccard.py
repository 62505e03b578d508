"""Exact near-duplicate groups by n-gram Jaccard similarity, with PartEnum signatures.

Sets are cut into size bands so that similar sets lie in one band or in two that follow each other. For a band pair,
similar sets differ in at most k features. The feature domain is partitioned by hash: into more than k parts, of which
one that isn't empty must be equal in both sets; small sets take groups of three parts and enumerate the subsets of
two, since some group has at most one difference. A signature names the features of a set in a part (or subset), so
similar sets share one. A set with too few parts that aren't empty takes finer partitions as well.

A difference spoils one part, so a set shares not one but at least `need` signatures with each set like it: as many as
it has, less those that its own greatest number of differences (a third of its size at 75 %) can spoil.

1. Equal sets are one class, and its document with the smallest id stands for it.
2. How many rows have a signature is counted from sorted runs of 4-byte keys, packed by task and key range, which is a
   fraction of a row for each signature. Only sets with `need` signatures in one band pair that more rows have than the
   set has copies go on, with their whole names.
3. Of a set's L signatures that others have, the L - need + 1 rarest stay (two similar sets share one of these, since
   the order is the same for all). Families are the components of sets over what stays.
4. A family's sets meet in blocks of bounded size: a block, most often a whole family, is searched breadth first from
   set to set over an inverted list of its shingles, with exact counts, among sets that aren't reached yet. Only the
   component of each set leaves the task.
5. Families of several blocks: one set of each component, then each set outside the family's largest component, is
   counted exactly against the other blocks with sets of its sizes. What leaves the task are pairs of components.
No sketch or estimate decides anything, and no pairs of documents are exchanged. Components of components, by
large-star and small-star rounds.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm.arrowtext import ROWS, U, Rolling, Words, lowered, mixed, signed, slices, tidy
from gridloom.llm.repeats import LAST, Side, beside, stable, without
from gridloom.llm.session import removed, scratch, ship, tasks, written

#: Below so many differences, groups of three parts and subsets of two.
SMALL = 16
#: Names of a block: 1 MB.
BLOCK = 1 << 17


def shingles(col: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(64-bit hash, row) of each shingle of a text column; a text of fewer words has one."""
    w = Words(lowered(col))
    n = len(w.start)
    roll = Rolling(w.hashes()[0])
    at = np.flatnonzero(w.row[: n - width + 1] == w.row[width - 1 :]) if n >= width else np.zeros(0, np.int64)
    size = np.diff(w.bound)
    few = np.flatnonzero((size > 0) & (size < width))
    return np.concatenate([roll.span(at, at + width), roll.span(w.bound[few], w.bound[few + 1])]), np.concatenate([w.row[at], few])


def changes(x: np.ndarray) -> np.ndarray:
    """Where a value differs from the one before; the first does."""
    new = np.ones(len(x), bool)
    new[1:] = x[1:] != x[:-1]
    return new


class Sets:
    """Distinct shingles of the rows of a text column by their 64-bit names, sorted by row and name; bound: of each row."""

    def __init__(self, col: pa.Array, width: int):
        h, row = shingles(col, width)
        # in most cases the row and the first bits of the name in one number give the order
        high = 64 - (ROWS - 1).bit_length()
        key = (row.astype(U) << U(high)) | (h >> U(64 - high))
        order = np.argsort(key)
        if len(col) > ROWS or ((key[order[1:]] == key[order[:-1]]) & (h[order[1:]] != h[order[:-1]])).any():
            order = np.lexsort((h, row))
        h = h[order]
        row = row[order]
        keep = changes(h) | changes(row)
        self.h, self.row = h[keep], row[keep]
        self.bound = np.searchsorted(self.row, np.arange(len(col) + 1))
        self.size = np.diff(self.bound)

    def sums(self, v: np.ndarray) -> np.ndarray:
        total = np.concatenate([np.zeros(1, U), np.cumsum(v, dtype=U)])
        return total[self.bound[1:]] - total[self.bound[:-1]]

    def names(self) -> list[np.ndarray]:
        """The sorted names of each row."""
        bound = self.bound.tolist()
        return [self.h[a:b] for a, b in zip(bound, bound[1:], strict=False)]


@lru_cache(4)
def bands(percent: int, most: int) -> tuple[np.ndarray, np.ndarray]:
    """(first size of each band, differences allowed between a set of the band and one of it or the next)."""
    first, k = [1], []
    while first[-1] <= most:
        last = first[-1] * 100 // percent
        k.append((100 - percent) * (last + last * 100 // percent) // (100 + percent))
        first.append(last + 1)
    return np.array(first), np.array([*k, 0])


def signatures(s: Sets, percent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(signature, row, group, need) of the sets. Signatures of a row and group come of one partition; similar sets
    share at least `need` signatures of some group, both by the need of the one and by that of the other."""
    out: list[tuple[np.ndarray, ...]] = []
    if not s.size.any():
        return np.zeros(0, U), *(np.zeros(0, np.int64),) * 3
    first, allowed = bands(percent, 1 << int(s.size.max()).bit_length())
    band = np.searchsorted(first, s.size, "right") - 1
    differ = (100 - percent) * (s.size + s.size * 100 // percent) // (100 + percent)
    with np.errstate(over="ignore"):
        value = mixed(s.h * U(0x9FB21C651E98DF25) + U(1))
        place = mixed(s.h ^ U(0x2545F4914F6CDD1D)) >> U(32)
        for back in (0, 1):
            pair = band - back  # the pair of bands
            use = (s.size > 0) & (pair >= 0)
            k = np.where(use, allowed[np.maximum(pair, 0)], 0)
            spoilt = np.minimum(differ, k)
            for level in range(40):
                if not use.any():
                    break
                small = k < SMALL
                threes = (k + 2) // 2
                parts = np.where(use, np.where(small, 3 * threes, (k + 1 + k // 3) << level), 0)
                base = np.concatenate([[0], np.cumsum(parts)])
                mine = use[s.row]
                r = s.row[mine]
                cell = base[r] + ((place[mine] * parts[r].astype(U)) >> U(32)).astype(np.int64)
                acc = np.zeros(base[-1], U)
                np.add.at(acc, cell, value[mine])
                filled = np.bincount(cell, minlength=base[-1]) > 0
                owner = np.repeat(np.arange(len(parts)), parts)
                index = (np.arange(base[-1]) - base[owner]).astype(U)
                salt = mixed(index + (pair[owner].astype(U) << U(32)) + (U(level) << U(56)) + (U(1) << U(63)))
                tiny = small[owner]
                threefold = acc[tiny].reshape(-1, 3)
                # the first difference of a group of three spoils two subsets, the second the last
                need = 3 * threes - np.where(spoilt <= threes, 2 * spoilt, threes + spoilt)
                out.append((mixed((threefold.sum(1, dtype=U)[:, None] - threefold).ravel() ^ salt[tiny]), owner[tiny], np.full(int(tiny.sum()), back), np.maximum(need, 1)[owner[tiny]]))
                big = filled & ~tiny
                count = np.bincount(owner[big], minlength=len(parts))
                out.append((mixed(acc[big] ^ salt[big]), owner[big], np.full(int(big.sum()), back + 2 * level + 2), np.maximum(count - spoilt, 1)[owner[big]]))
                use = use & ~small & (count <= k)
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


class Index:
    """An inverted list of the shingles of some sets, for counts of what a set has in common with each."""

    def __init__(self, names: list[np.ndarray], who: np.ndarray):
        """who: which sets to list."""
        flat = np.concatenate([names[i] for i in who.tolist()]) if len(who) else np.zeros(0, U)
        row = np.repeat(np.arange(len(who)), [len(names[i]) for i in who.tolist()])
        order = np.argsort(flat, kind="stable")
        flat, self.row, self.who = flat[order], row[order], who
        first = np.flatnonzero(changes(flat))
        self.name, self.first = flat[first], np.append(first, len(flat))

    def common(self, a: np.ndarray) -> np.ndarray:
        """For each listed set, the names it has in common with the sorted names a."""
        if not len(self.name):
            return np.zeros(len(self.who), np.int64)
        at = np.searchsorted(self.name, a)
        at = at[self.name[np.minimum(at, len(self.name) - 1)] == a]
        size = self.first[at + 1] - self.first[at]
        ends = np.cumsum(size)
        spot = np.arange(ends[-1] if len(ends) else 0) + np.repeat(self.first[at] - (ends - size), size)
        return np.bincount(self.row[spot], minlength=len(self.who))


def alike(common: np.ndarray, n: int, m: np.ndarray, percent: int) -> np.ndarray:
    return (common > 0) & (100 * common >= percent * (n + m - common))


def reached(names: list[np.ndarray], percent: int) -> np.ndarray:
    """For each set, the first of the sets that it reaches over links."""
    n = np.fromiter(map(len, names), np.int64, len(names))
    label = np.full(len(names), -1)
    index, left = None, len(names)
    for seed in range(len(names)):
        if label[seed] >= 0:
            continue
        label[seed] = seed
        left -= 1
        queue = [seed]
        while queue and left:
            a = queue.pop()
            if index is None or 2 * left < len(index.who):
                index = Index(names, np.flatnonzero(label < 0))
            ok = alike(index.common(names[a]), int(n[a]), n[index.who], percent) & (label[index.who] < 0)
            new = index.who[ok]
            label[new] = seed
            left -= len(new)
            queue += new.tolist()
    return label


#: A count of rows that stands for itself and all above.
MANY = 0xFFFF


class Keys:
    """The signature keys of this task's input partition that several rows have, and how many."""

    def __init__(self, path: str):
        keys, times = [np.zeros(0, U)], [np.zeros(0, np.int64)]
        for t in beside(path):
            for bucket, k, n in zip(*(t.column(c).to_pylist() for c in ("bucket", "keys", "times")), strict=True):
                keys.append((U(bucket) << U(32)) | np.frombuffer(k, "<u4").astype(U))
                times.append(np.frombuffer(n, "<u2").astype(np.int64))
        whole = np.concatenate(keys)
        order = np.argsort(whole)
        self.keys, self.times = whole[order], np.concatenate(times)[order]

    def count(self, v: np.ndarray) -> np.ndarray:
        """How many rows have each key, MANY at most; 0 for keys of one row."""
        if not len(self.keys):
            return np.zeros(len(v), np.int64)
        at = np.minimum(np.searchsorted(self.keys, v), len(self.keys) - 1)
        return np.where(self.keys[at] == v, self.times[at], 0)


def short(sig: np.ndarray, buckets: int) -> np.ndarray:
    """Range and 4-byte key of a signature in one number."""
    return (((sig >> U(40)) * U(buckets) >> U(24)) << U(32)) | (sig & U(0xFFFFFFFF))


def by_key(batches: Iterator[pa.RecordBatch], keys: int, wanted: list[str]) -> Iterator[tuple[tuple, list[list]]]:
    """Sorted rows, a group of equal first `keys` columns at a time: (key, rows of the wanted columns)."""
    now, held = None, []
    for batch in batches:
        for row in zip(*(batch.column(c).to_pylist() for c in [*batch.schema.names[:keys], *wanted]), strict=True):
            if row[:keys] != now:
                if held:
                    yield now, held
                now, held = row[:keys], []
            held.append(row[keys:])
    if held:
        yield now, held


class Join:
    """The steps over one input; width, percent: words of a shingle, and the least similarity in percent."""

    #: How the sets of a block are searched.
    search = staticmethod(reached)

    def __init__(self, docs: DataFrame, width: int, percent: int, slice_bytes: int, block: int):
        self.spark = docs.sparkSession
        ship(self.spark)
        self.docs = stable(docs, []).select("doc_id", "text")
        self.width, self.percent, self.slice_bytes, self.block = width, percent, slice_bytes, block
        self.n = tasks(self.spark)
        self.buckets = 4 * self.n
        self.made: list[str] = []

    def written(self, df: DataFrame, name: str) -> DataFrame:
        self.made.append(scratch(self.spark, name))
        return written(df, name, self.made[-1])

    def cleared(self, since: int = 0) -> None:
        """Delete the tables made since then."""
        for path in self.made[since:]:
            removed(self.spark, path)
        del self.made[since:]

    def first_pass(self) -> DataFrame:
        """A row for each input row (row, doc, n, g1, g2), and the packed signature keys (part, bucket, keys, more); more:
        places and counts of keys that occur more than once."""
        width, percent, slice_bytes, buckets = self.width, self.percent, self.slice_bytes, self.buckets
        names = ["row", "doc", "n", "g1", "g2", "part", "bucket", "keys", "more"]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            part_id = TaskContext.get().partitionId()
            row = part_id << 32
            for batch in batches:
                for part in slices(batch, limit=slice_bytes):
                    s = Sets(part.column("text"), width)
                    with np.errstate(over="ignore"):
                        g = [signed(s.sums(mixed(s.h ^ x))) for x in (U(0xA0761D6478BD642F), U(0xE7037ED1A0B428DB))]
                    n = part.num_rows
                    yield pa.RecordBatch.from_arrays([pa.array(np.arange(row, row + n)), part.column("doc_id").fill_null(LAST), pa.array(s.size), pa.array(g[0]), pa.array(g[1]), pa.nulls(n, pa.int64()), pa.nulls(n, pa.int32()), pa.nulls(n, pa.binary()), pa.nulls(n, pa.binary())], names)
                    row += n
                    key = np.sort(short(signatures(s, percent)[0], buckets))
                    first = np.flatnonzero(changes(key))
                    key, times = key[first], np.diff(np.append(first, len(key))).astype("<u4")
                    bucket = (key >> U(32)).astype(np.int64)
                    cut = np.flatnonzero(np.diff(bucket, prepend=-1))
                    low = (key & U(0xFFFFFFFF)).astype("<u4")
                    keys, more = [], []
                    for a, b in zip(cut.tolist(), [*cut[1:].tolist(), len(key)], strict=False):
                        keys.append(low[a:b].tobytes())
                        at = np.flatnonzero(times[a:b] > 1)
                        more.append(at.astype("<u4").tobytes() + times[a:b][at].tobytes())
                    none = pa.nulls(len(cut), pa.int64())
                    yield pa.RecordBatch.from_arrays([none] * 5 + [pa.array([part_id] * len(cut), pa.int64()), pa.array(bucket[cut].astype(np.int32)), pa.array(keys, pa.binary()), pa.array(more, pa.binary())], names)

        return self.written(self.docs.mapInArrow(tidy(run), "row long, doc long, n long, g1 long, g2 long, part long, bucket int, keys binary, more binary"), "sets")

    def beside(self, rows: DataFrame, name: str, *columns: str) -> str:
        self.made.append(scratch(self.spark, name))
        rows.repartition(self.n, "part").select("part", *columns).write.partitionBy("part").parquet(self.made[-1])
        return self.made[-1]

    def shared_keys(self, rows: DataFrame) -> str:
        """Keys that several rows have, and how many, by input partition."""

        def live(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for (bucket,), held in by_key(batches, 1, ["part", "keys", "more"]):
                keys = [np.frombuffer(k, "<u4") for _, k, _ in held]
                times = [np.ones(len(k), np.int64) for k in keys]
                for x, (_, _, more) in zip(times, held, strict=True):
                    at, n = np.frombuffer(more, "<u4").reshape(2, -1)
                    x[at] = n
                whole = np.concatenate(keys)
                order = np.argsort(whole)
                new = changes(whole[order])
                total = np.add.reduceat(np.concatenate(times)[order], np.flatnonzero(new)) if len(whole) else np.zeros(0, np.int64)
                count = np.empty(len(whole), np.int64)
                count[order] = total[np.cumsum(new) - 1]
                count = np.minimum(count, MANY)
                ends = np.cumsum([0, *map(len, keys)]).tolist()
                found = [(p, k[n > 1], n[n > 1]) for (p, _, _), k, n in zip(held, keys, [count[a:b] for a, b in zip(ends, ends[1:], strict=False)], strict=True) if n.max(initial=0) > 1]
                yield pa.RecordBatch.from_arrays([pa.array([p for p, _, _ in found], pa.int64()), pa.array([bucket] * len(found), pa.int32()), pa.array([k.tobytes() for _, k, _ in found], pa.binary()), pa.array([n.astype("<u2").tobytes() for _, _, n in found], pa.binary())], ["part", "bucket", "keys", "times"])

        rows = rows.select("bucket", "part", "keys", "more").repartitionById(self.n, F.col("bucket") % self.n).sortWithinPartitions("bucket")
        return self.beside(rows.mapInArrow(tidy(live), "part long, bucket int, keys binary, times binary"), "keys", "bucket", "keys", "times")

    def candidates(self, firsts: str, keys: str) -> DataFrame:
        """Of sets with enough signatures that others have: a row (sig, row) for each of the rarest and the first set of
        the slice that has it, a row (row, lead) for another set of the slice and that first one, and a row for each set
        (row, n, names)."""
        width, percent, slice_bytes, buckets = self.width, self.percent, self.slice_bytes, self.buckets
        names = ["sig", "row", "lead", "n", "names"]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            listed, live = Side(firsts), Keys(keys)
            for batch in batches:
                for part in slices(batch, limit=slice_bytes):
                    if not (listing := listed.rows(part)):
                        continue
                    got = sorted(listing)
                    copies = np.array([int((end - begin)[0]) for begin, end, _ in map(listing.get, got)])
                    text = part.column("text").take(pa.array(got))
                    sig, row, grp, need = signatures(Sets(text, width), percent)
                    times = live.count(short(sig, buckets))
                    keep = (times > copies[row]) | (times == MANY)
                    sig, row, need, times, group = sig[keep], row[keep], need[keep], times[keep], (row * 128 + grp)[keep]
                    order = np.lexsort((sig, times, group))
                    sig, row, need, group = sig[order], row[order], need[order], group[order]
                    first = np.flatnonzero(changes(group))
                    size = np.diff(np.append(first, len(group)))
                    rank = np.arange(len(group)) - np.repeat(first, size)
                    keep = rank <= np.repeat(size, size) - need  # none where there are fewer than needed
                    sig, row = sig[keep], row[keep]
                    if not len(sig):
                        continue
                    ids = np.array(got) + listed.first
                    none = lambda n, kind=pa.int64(): pa.nulls(n, kind)
                    order = np.lexsort((row, sig))
                    sig, row = sig[order], row[order]
                    new = changes(sig)
                    lead = row[np.flatnonzero(new)[np.cumsum(new) - 1]]
                    n = int(new.sum())
                    yield pa.RecordBatch.from_arrays([pa.array(signed(sig[new])), pa.array(ids[row[new]]), none(n), none(n), none(n, pa.binary())], names)
                    near = np.unique(np.stack([row, lead])[:, row != lead], axis=1)
                    n = near.shape[1]
                    yield pa.RecordBatch.from_arrays([none(n), pa.array(ids[near[0]]), pa.array(ids[near[1]]), none(n), none(n, pa.binary())], names)
                    have = np.unique(row)
                    sets = Sets(text.take(pa.array(have)), width).names()
                    n = len(have)
                    yield pa.RecordBatch.from_arrays([none(n), pa.array(ids[have]), none(n), pa.array([len(x) for x in sets], pa.int64()), pa.array([x.astype("<u8").tobytes() for x in sets], pa.binary())], names)

        return self.written(self.docs.mapInArrow(tidy(run), "sig long, row long, lead long, n long, names binary"), "candidates")

    def families(self, live: DataFrame, near: DataFrame) -> DataFrame:
        """(row, family): sets that can be similar are in one family; sets alone in theirs are left out. live: (sig, row),
        a set for all of a slice; near: (a, b) within a slice."""
        lead = live.groupBy("sig").agg(F.min("row").alias("b"), F.count("*").alias("times")).where("times > 1")
        edges = live.join(lead.select("sig", "b"), "sig").select(F.col("row").alias("a"), "b")
        return rooted(self.components(edges.unionByName(near))).select(F.col("a").alias("row"), F.col("b").alias("family"))

    def blocks(self, family: DataFrame, sets: DataFrame) -> DataFrame:
        """(family, band, block, row): where each set meets the others; band is -1 where a family is one block."""
        ratio = math.log(100 / self.percent) * 1.0001  # so that similar sets are at most one band apart
        rows = self.written(family.join(sets.select("row", "n"), "row").withColumn("band", F.floor(F.log("n") / ratio).cast("int")), "members")
        total = rows.groupBy("family").agg(F.sum("n").alias("total"))
        parts = rows.groupBy("family", "band").agg(F.ceil(F.sum("n") / self.block).alias("parts"))
        rows = rows.join(total, "family").join(parts, ["family", "band"])
        one = F.col("total") <= self.block
        block = F.when(one, F.lit(0)).otherwise(F.pmod(F.xxhash64("row"), "parts")).cast("int")
        return self.written(rows.select("family", F.when(one, F.lit(-1)).otherwise(F.col("band")).alias("band"), block.alias("block"), "row", F.col("parts").cast("int").alias("parts")), "blocks")

    def met(self, rows: DataFrame, sets: DataFrame, work: Callable, wanted: list[str], schema: str) -> DataFrame:
        """Rows (family, band, block, ...) with their sets, a block together. What is to be done with a set is written by
        its input partition and read where the set is read, so that sets are exchanged once, to their blocks."""
        key = ["family", "band", "block"]
        listed = [*key, *(c for c in wanted if c != "names")]
        side = self.beside(rows.withColumn("part", F.shiftright("row", 32)), "places", *listed)

        def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            known: dict[int, pa.Table | None] = {}
            for batch in batches:
                for p in np.unique(np.asarray(batch.column("row")) >> 32).tolist():
                    if p not in known:
                        if len(known) > 4:
                            known.clear()
                        got = beside(side, p)
                        known[p] = pa.concat_tables(got).combine_chunks() if got else None
                    if known[p] is not None:
                        own = pa.Table.from_batches([batch.select(["row", "names"])]).join(known[p], "row", join_type="inner")
                        yield from own.select([*listed, "names"]).to_batches()

        kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
        rows = sets.select("row", "names").mapInArrow(tidy(placed), ", ".join(f"{c} {kinds[c]}" for c in listed) + ", names binary").select(*key, *wanted)
        order = [c for c in wanted if c in ("kind", "row")]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            columns = [x.split()[0] for x in schema.split(", ")]
            held: list[tuple] = []
            for k, group in by_key(batches, 3, wanted):
                held += work(k, group)
                if len(held) > 10_000:
                    yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*held, strict=True)], columns)
                    held = []
            if held:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*held, strict=True)], columns)

        return rows.repartition(self.n, *key).sortWithinPartitions(*key, *order).mapInArrow(tidy(run), schema)

    def inside(self, blocks: DataFrame, sets: DataFrame) -> DataFrame:
        """(row, label): the smallest row of its block that each set reaches over links in the block."""
        percent, search = self.percent, self.search

        def work(key: tuple, group: list) -> list[tuple]:
            names = [np.frombuffer(x, "<u8") for _, x in group]
            return [(row, group[k][0]) for (row, _), k in zip(group, search(names, percent).tolist(), strict=True)]

        return self.written(self.met(blocks, sets, work, ["row", "names"], "row long, label long"), "inside")

    def across(self, search: DataFrame, members: DataFrame, sets: DataFrame) -> DataFrame:
        """(a, b): labels of a searching set and of a member that is similar, in another block and with another label."""
        percent = self.percent
        there = members.select("family", F.col("band").alias("to"), F.col("parts")).distinct()
        sent = search.withColumn("to", F.explode(F.array(F.col("band") - 1, F.col("band"), F.col("band") + 1))).drop("parts").join(there, ["family", "to"])
        sent = sent.withColumn("at", F.explode(F.expr("sequence(0, parts - 1)"))).where("not (to = band and at = block)")
        sent = sent.select("family", F.col("to").alias("band"), F.col("at").alias("block"), "row", "label", F.lit(1).alias("kind"))
        rows = members.select("family", "band", "block", "row", "label", F.lit(0).alias("kind")).unionByName(sent)

        def work(key: tuple, group: list) -> list[tuple]:
            names = [np.frombuffer(x, "<u8") for *_, x in group]
            n = sum(kind == 0 for kind, *_ in group)
            label = np.array([x[2] for x in group[:n]])
            size = np.fromiter(map(len, names[:n]), np.int64, n)
            index = Index(names, np.arange(n))
            out = set()
            for (_, _, own, _), x in zip(group[n:], names[n:], strict=True):
                ok = alike(index.common(x), len(x), size, percent) & (label != own)
                out.update((own, b) for b in np.unique(label[ok]).tolist())
            return list(out)

        return self.met(rows, sets, work, ["kind", "row", "label", "names"], "a long, b long").distinct()

    def linked(self, family: DataFrame, sets: DataFrame) -> DataFrame:
        """(a, b): b is the smallest row that set a, which isn't it, reaches over links."""
        blocks = self.blocks(family, sets)
        label = self.inside(blocks, sets)
        out = label.where("row <> label").select(F.col("row").alias("a"), F.col("label").alias("b"))
        large = blocks.where("band >= 0")
        if large.isEmpty():
            return out
        rows = self.written(large.join(label, "row"), "large")
        links = self.across(rows.where("row = label"), rows, sets)
        more = self.components(links)
        rows = self.written(rows.join(rooted(more).select(F.col("a").alias("label"), F.col("b").alias("new")), "label", "left").withColumn("label", F.coalesce("new", "label")).drop("new"), "large")
        most = rows.groupBy("family", "label").agg(F.count("*").alias("times")).groupBy("family").agg(F.max(F.struct("times", "label")).label.alias("most"))
        links = self.across(rows.join(most, "family").where("label <> most").drop("most"), rows, sets)
        return self.components(out.unionByName(more).unionByName(links))

    def components(self, edges: DataFrame) -> DataFrame:
        return components(edges, self.written)


def stars(edges: DataFrame) -> bool:
    """Whether every a has one b, and no b is an a."""
    n = edges.agg(F.count("*").alias("n"), F.countDistinct("a").alias("a")).first()
    return n.n == n.a and edges.join(edges.select(F.col("b").alias("a")), "a", "left_semi").isEmpty()


def components(edges: DataFrame, written: Callable = written) -> DataFrame:
    """(a, b): b is the smallest node that a, which isn't it, reaches over the undirected edges (a, b)."""
    now = written(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    while not stars(now):
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = written(both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m")), "least")
        large = written(both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct(), "large")
        least = written(large.groupBy("a").agg(F.min("b").alias("m")), "least")
        small = large.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
        now = written(small.where("a <> b").distinct(), "edges")
    return now


def rooted(label: DataFrame) -> DataFrame:
    """(a, b) with the smallest nodes too, as their own."""
    return label.unionByName(label.select(F.col("b").alias("a"), "b").distinct())


def first_of_groups(docs: DataFrame, width: int = 5, percent: int = 75) -> DataFrame:
    """The rows of docs, without those that link to a row with a smaller doc_id, directly or not; of rows of one id the
    first in the input stays. See groups()."""
    docs = stable(docs, [c for c in docs.columns if c not in ("doc_id", "text")])
    rows, made = _grouped(docs, width, percent, 4 << 20, BLOCK)
    drops = rows.where("row <> first").select("row", F.coalesce("doc_id", F.lit(LAST)).alias("doc"))
    out = without(docs, drops)
    for path in made:
        removed(docs.sparkSession, path)
    return out


def groups(docs: DataFrame, width: int = 5, percent: int = 75, slice_bytes: int = 4 << 20, block: int = BLOCK) -> DataFrame:
    """Every row's doc_id, n_shingles, component_id, row (its place in the input), and first (the row that stands for
    its component: the first with the smallest doc_id).

    A text's set: its distinct shingles of `width` words, ASCII letters in lower case; with fewer words, all of them as
    one. Two rows link if 100 * intersection >= percent * union; rows without words link with nothing. component_id is
    the smallest doc_id that a row reaches over links. A null doc_id comes after all others, and is its own component
    unless it links. Repeated rows keep a row each. An empty table gives no rows. A very long text is one slice of its
    own. Other columns are ignored, whatever their names. `block`: names that sets in a block have together.
    """
    return _grouped(docs, width, percent, slice_bytes, block)[0]


def _grouped(docs: DataFrame, width: int, percent: int, slice_bytes: int, block: int) -> tuple[DataFrame, list[str]]:
    """The rows of groups(), and the tables that they are read from."""
    j = Join(docs, width, percent, slice_bytes, block)
    last = [scratch(j.spark, "rows"), scratch(j.spark, "classes")]
    first = j.first_pass()
    rows = written(first.where("row is not null").select("row", "doc", "n", "g1", "g2"), "rows", last[0])
    keys = j.shared_keys(first.where("row is null"))
    removed(j.spark, j.made.pop(0))
    key = ["n", "g1", "g2"]
    classes = j.written(rows.where("n > 0").groupBy(*key).agg(F.min(F.struct("doc", "row")).alias("f"), F.count("*").alias("copies")).select(*key, F.col("f.doc").alias("doc"), F.col("f.row").alias("row"), "copies"), "classes")
    firsts = j.beside(classes.select(F.shiftright("row", 32).alias("part"), "row", F.lit(0).alias("s"), F.col("copies").alias("n"), "doc"), "firsts", "row", "s", "n", "doc")
    found = j.candidates(firsts, keys)
    sets, live = found.where("n is not null").select("row", "n", "names"), found.where("sig is not null").select("sig", "row")
    near = found.where("lead is not null").select(F.col("row").alias("a"), F.col("lead").alias("b"))
    label = j.linked(j.families(live, near), sets)

    own = F.struct("doc", "row")
    met = j.written(rooted(label).join(classes.select(F.col("row").alias("a"), own.alias("f")), "a"), "members")
    met = met.join(met.groupBy("b").agg(F.min("f").alias("least")), "b").select(F.col("a").alias("row"), "least")
    classes = classes.join(met, "row", "left").withColumn("least", F.coalesce("least", own))
    classes = written(classes.select(*key, F.col("least.doc").alias("component"), F.col("least.row").alias("first")), "classes", last[1])
    j.cleared()
    out = rows.join(classes, key, "left")
    null = lambda c: F.when(c != LAST, c)
    out = out.select(null(F.col("doc")).alias("doc_id"), F.col("n").alias("n_shingles"), null(F.coalesce("component", "doc")).alias("component_id"), "row", F.coalesce("first", "row").alias("first"))
    return out, last
