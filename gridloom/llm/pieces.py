"""SentencePiece encoding and decoding over a relational lattice.

Texts are cut where no piece can span: before a character whose pair with the one before occurs in no piece. What lies
between are units; a unit is encoded once however often it occurs.
1. Each task emits the distinct units of its texts, an epoch (as many units as a worker should hold) at a time.
2. Distinct units are exploded into substrings of bounded length, equi-joined to the piece table (of the vocabulary's
   size, so it is broadcast), and the edges that are found are grouped by unit again, without another exchange.
3. A higher-order aggregate folds each unit's lattice: for a unigram model by Viterbi (the best sum of scores over
   the edges that end at each place); for a BPE model, whose results are not those of the best sum, by merges (the
   adjacent pair with the best edge joins, the leftmost of equal ones, until none is left). Merges need one pass over the
   edges by rank, with the boundaries as the bits of a number, unless a merge makes one possible that comes before it:
   that is seen, and the unit is folded step by step.
4. A unit's boundaries and its longer pieces go beside its input partition, and a second pass over the texts puts them
   in order. Texts and ids are never exchanged.
Units of one character, and units longer than a number's bits allow (46 characters for 32,000 pieces), are encoded by
the same rule in the worker that reads them.
"""

from __future__ import annotations

import hashlib
import heapq
import math
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.llm.arrowtext import raw, slices, tidy
from gridloom.llm.repeats import beside, stable
from gridloom.llm.session import removed, scratch, ship, tasks, written

SPACE = "▁"
#: Units of an epoch.
EPOCH = 400_000
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class Pieces:
    """The piece table of a model file, and the rule to encode a unit."""

    def __init__(self, path: str):
        from sentencepiece import sentencepiece_model_pb2 as pb

        m = pb.ModelProto()
        with open(path, "rb") as f:
            m.ParseFromString(f.read())
        n = m.normalizer_spec
        if n.precompiled_charsmap or n.remove_extra_whitespaces or not n.escape_whitespaces or m.trainer_spec.treat_whitespace_as_suffix or m.trainer_spec.model_type not in (UNIGRAM, BPE):
            raise ValueError(f"{path}: only unigram and BPE models that leave texts as they are")
        self.kind = m.trainer_spec.model_type
        self.prefix = n.add_dummy_prefix
        self.text = [p.piece for p in m.pieces]
        self.type = [p.type for p in m.pieces]
        self.unknown = self.type.index(UNKNOWN)
        self.byte = {int(p.piece[3:5], 16): i for i, p in enumerate(m.pieces) if p.type == BYTE}
        normal = [i for i, t in enumerate(self.type) if t == NORMAL]
        self.id = {self.text[i]: i for i in normal}
        self.score = {self.text[i]: m.pieces[i].score for i in normal}
        order = sorted(normal, key=lambda i: (-m.pieces[i].score, i))
        self.rank = {self.text[i]: r for r, i in enumerate(order)}
        self.by_rank = np.array(order, np.int64)
        #: Bits of boundaries in an edge's number, whose other bits are its rank (from minus half) and whether it may be late.
        self.half = 1 << (len(order).bit_length() - 1)
        self.places = 62 - len(order).bit_length()
        self.long = self.places - 1
        self.longest = max(len(self.text[i]) for i in normal)
        self.worst = min(self.score.values()) - 10.0
        chars = sorted({c for i in normal if len(self.text[i]) > 1 for c in self.text[i]})
        self.index = np.zeros(0x110000, np.uint16)
        self.index[[ord(c) for c in chars]] = np.arange(1, len(chars) + 1)
        self.joins = np.zeros((len(chars) + 1,) * 2, bool)
        at = {c: k + 1 for k, c in enumerate(chars)}
        for i in normal:
            t = self.text[i]
            for a, b in zip(t, t[1:], strict=False):
                self.joins[at[a], at[b]] = True

        self.width, self.apart = len(chars) + 1, ~self.joins.ravel()

    def late(self, t: str) -> bool:
        """Whether a merge to t can become possible after its rank: one of two parts has a higher rank."""
        r = self.rank[t]
        return any(max(self.rank.get(x, -1), self.rank.get(y, -1)) > r for x, y in ((t[:k], t[k:]) for k in range(1, len(t))) if (len(x) == 1 or x in self.rank) and (len(y) == 1 or y in self.rank))

    def spelled(self, c: str) -> list[int]:
        """The ids of a character that no edge covers."""
        return [self.byte[b] for b in c.encode()] if self.byte else [self.unknown]

    def encoded(self, unit: str) -> list[int]:
        """The ids of one unit: merges by rank from a heap, or Viterbi."""
        return self._merged(unit) if self.kind == BPE else self._best(unit)

    def _merged(self, unit: str) -> list[int]:
        n = len(unit)
        end, back = list(range(1, n + 1)), list(range(-1, n - 1))
        alive = [True] * n
        heap: list[tuple[int, int, int, int]] = []

        def offer(a: int) -> None:
            if a >= 0 and end[a] < n:
                b = end[a]
                r = self.rank.get(unit[a : end[b]])
                if r is not None:
                    heapq.heappush(heap, (r, a, b, end[b]))

        for a in range(n):
            offer(a)
        while heap:
            _, a, b, stop = heapq.heappop(heap)
            if not (alive[a] and alive[b]) or end[a] != b or end[b] != stop:
                continue
            alive[b] = False
            end[a] = stop
            if stop < n:
                back[stop] = a
            offer(a)
            offer(back[a])
        out, a = [], 0
        while a < n:
            t = unit[a : end[a]]
            out += [self.id[t]] if t in self.id else self.spelled(t)
            a = end[a]
        return out

    def _best(self, unit: str) -> list[int]:
        n = len(unit)
        best, back = [0.0] + [-math.inf] * n, [0] * (n + 1)
        for e in range(1, n + 1):
            for s in range(max(0, e - self.longest), e):
                x = self.score.get(unit[s:e], self.worst if s == e - 1 else None)
                if x is not None and best[s] + x > best[e]:
                    best[e], back[e] = best[s] + x, s
        out, e = [], n
        while e:
            t = unit[back[e] : e]
            out = ([self.id[t]] if t in self.id else self.spelled(t)) + out
            e = back[e]
        return out

    def decoded(self, ids) -> str:
        out = bytearray()
        for i in ids:
            t = self.type[i]
            if t == BYTE:
                out.append(int(self.text[i][3:5], 16))
            elif t in (NORMAL, USER):
                out += self.text[i].encode()
        text = out.decode("utf-8", "replace").replace(SPACE, " ")
        return text[1:] if self.prefix and text.startswith(" ") else text


@lru_cache(2)
def load(path: str) -> Pieces:
    return Pieces(path)


class Cut:
    """The units of the rows of a text column: bound by row, an index for each, and the distinct ones."""

    def __init__(self, col: pa.Array, pieces: Pieces):
        data, off = raw(col)
        whole = data.tobytes()
        head = SPACE if pieces.prefix else ""
        texts = [whole[a:b].decode() for a, b in zip(off.tolist(), off[1:].tolist(), strict=False)]
        texts = [head + t.replace(" ", SPACE) if t else "" for t in texts]
        size = np.fromiter(map(len, texts), np.int64, len(texts))
        first = np.concatenate([[0], np.cumsum(size)])
        joined = "".join(texts)
        k = pieces.index[np.frombuffer(joined.encode("utf-32-le"), np.uint32)]
        cut = np.ones(len(k), bool)
        if len(k):
            np.take(pieces.apart, k[:-1].astype(np.int32) * np.int32(pieces.width) + k[1:], out=cut[1:])
        cut[first[:-1][size > 0]] = True
        start = np.flatnonzero(cut)
        packed = np.frombuffer(joined.encode(), np.uint8)
        place = np.flatnonzero((packed & 0xC0) != 0x80)  # the first byte of each character
        o = np.append(place[start], len(packed)).astype(np.int32)
        e = pa.StringArray.from_buffers(len(start), pa.py_buffer(o), pa.py_buffer(packed)).dictionary_encode()
        self.index = e.indices.to_numpy(zero_copy_only=False)
        self.units = e.dictionary
        self.bound = np.searchsorted(start, first)
        self.chars = np.asarray(pc.utf8_length(self.units))


class Epochs:
    """Numbers for the distinct units of a task's slices, from 0 in each epoch; alike in every pass."""

    def __init__(self):
        self.number = 0
        self.known: dict[str, int] = {}

    def places(self, units: list[str]) -> np.ndarray:
        known = self.known
        return np.fromiter((known.setdefault(u, len(known)) for u in units), np.int64, len(units))

    def full(self) -> bool:
        return len(self.known) >= EPOCH

    def next(self) -> None:
        self.number += 1
        self.known = {}


def _units(path: str, slice_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces, part_id, epochs = load(path), TaskContext.get().partitionId(), Epochs()

        def new(first: int) -> pa.RecordBatch:
            units = list(epochs.known)[first:]
            n = len(units)
            return pa.RecordBatch.from_arrays([pa.array([part_id] * n, pa.int64()), pa.array([epochs.number] * n, pa.int32()), pa.array(np.arange(first, first + n, dtype=np.int32)), pa.array(units, pa.string())], ["part", "epoch", "at", "unit"])

        for batch in batches:
            for part in slices(batch, limit=slice_bytes):
                cut = Cut(part.column("text"), pieces)
                first = len(epochs.known)
                epochs.places(cut.units.filter(pa.array((cut.chars > 1) & (cut.chars <= pieces.long))).to_pylist())
                yield new(first)
                if epochs.full():
                    epochs.next()

    return run


def piece_table(spark: SparkSession, pieces: Pieces) -> DataFrame:
    """(piece, rank, score, late) of the pieces that stand for text."""
    rows = [(t, pieces.rank[t], float(pieces.score[t]), pieces.kind == BPE and pieces.late(t)) for t in pieces.id]
    return spark.createDataFrame(rows, "piece string, rank long, score double, late boolean")


def lattice(units: DataFrame, table: DataFrame, pieces: Pieces) -> DataFrame:
    """(unit, n, edges) of the distinct units with any edge. For a BPE model the edges of two characters and more as
    numbers in order of rank and place: the low bits are the boundaries from the first to the last. For a unigram model a
    map from 64 * start + length to (score, rank)."""
    least = 2 if pieces.kind == BPE else 1
    spots = units.select("unit", F.length("unit").alias("n")).select("unit", "n", F.explode(F.expr(f"sequence(0, n - {least})")).alias("s"))
    spots = spots.select("unit", "n", "s", F.explode(F.expr(f"sequence({least}, least({pieces.longest}, n - s))")).alias("l"))
    edges = spots.withColumn("piece", F.expr("substring(unit, s + 1, l)")).join(F.broadcast(table), "piece")
    if pieces.kind == BPE:
        key = F.expr(f"shiftleft(rank - {pieces.half}L, {pieces.places + 1}) + if(late, {1 << pieces.places}L, 0L) + shiftleft(2L, s + l) - shiftleft(1L, s)")
        return edges.groupBy("unit").agg(F.sort_array(F.collect_list(key)).alias("edges")).select("unit", F.length("unit").alias("n"), "edges")
    entry = F.struct((F.col("s") * 64 + F.col("l")).alias("key"), F.struct("score", "rank").alias("value"))
    return edges.groupBy("unit", "n").agg(F.map_from_entries(F.collect_list(entry)).alias("edges"))


ALL = "(shiftleft(2L, n) - 1L)"


def inner(k: str, places: int) -> str:
    """The boundaries inside an edge."""
    span = f"({k} & {(1 << places) - 1}L)"
    return f"(shiftleft({span}, 1) & shiftright({span}, 1))"


def joins(m: str, k: str, places: int) -> str:
    """Whether an edge joins two neighbours of the boundaries in m: three of its places are there, one of them inside."""
    return f"if(bit_count({m} & {k}) = 3, bit_count({m} & {inner(k, places)}) = 1, false)"


def merges(places: int) -> str:
    """The boundaries after one pass by rank; 0 if a merge became possible after its turn."""
    seen = f"exists(late, f -> f < k AND {joins('x', 'f', places)})"
    joined = f"m & ~{inner('k', places)}"
    return f"aggregate(edges, {ALL}, (m, k) -> if({joins('m', 'k', places)}, if(size(late) = 0, {joined}, element_at(transform(array({joined}), x -> if({seen}, 0L, x)), 1)), m))"


def steps(places: int) -> str:
    """Step by step: the first edge by rank that joins two neighbours."""
    return f"aggregate(sequence(2, n), {ALL}, (m, t) -> element_at(transform(array(try_element_at(filter(edges, k -> {joins('m', 'k', places)}), 1)), f -> if(f is null, m, m & ~{inner('f', places)})), 1))"


def longer(places: int, half: int) -> str:
    """The ranks of the pieces of two characters and more, by place."""
    last = f"bit_count(mask & k) = 2 AND (mask & {inner('k', places)}) = 0"
    return f"transform(sort_array(transform(filter(edges, k -> {last}), k -> named_struct('at', k & {(1 << places) - 1}L, 'rank', cast(shiftright(k, {places + 1}) + {half}L AS int)))), x -> x.rank)"


#: For each place, the best score there and the start (the earliest, negated) of its last edge; then the boundaries.
VITERBI = """
aggregate(sequence(1, n), array(struct(cast(0 as double) as score, 0 as back)), (a, e) -> concat(a, array(
  array_max(transform(sequence(greatest(0, e - {longest}), e - 1), s -> if(try_element_at(edges, s * 64 + e - s) is null and s < e - 1, null,
    struct(a[s].score + coalesce(try_element_at(edges, s * 64 + e - s).score, {worst}) as score, -s as back)))))))
"""
BACK = "aggregate(sequence(1, n), array(n), (b, t) -> if(b[0] = 0, b, concat(array(-path[b[0]].back), b)))"


def folded(lattices: DataFrame, pieces: Pieces) -> DataFrame:
    """(unit, mask, ranks): boundaries as bits, and the ranks of the pieces of two characters and more, by place."""
    if pieces.kind == BPE:
        late = F.expr(f"filter(edges, k -> (k & {1 << pieces.places}L) <> 0)")
        rows = lattices.withColumn("late", late).withColumn("once", F.expr(merges(pieces.places)))
        rows = rows.withColumn("mask", F.when(F.col("once") > 0, F.col("once")).otherwise(F.expr(steps(pieces.places))))
        return rows.select("unit", "mask", F.expr(longer(pieces.places, pieces.half)).alias("ranks"))
    rows = lattices.withColumn("path", F.expr(VITERBI.format(longest=pieces.longest, worst=repr(pieces.worst)))).withColumn("bounds", F.expr(BACK))
    ranks = "filter(transform(sequence(0, size(bounds) - 2), i -> if(bounds[i + 1] - bounds[i] > 1, cast(try_element_at(edges, bounds[i] * 64 + bounds[i + 1] - bounds[i]).rank AS int), null)), r -> r is not null)"
    return rows.select("unit", F.expr("aggregate(bounds, 0L, (m, b) -> m | shiftleft(1L, b))").alias("mask"), F.expr(ranks).alias("ranks"))


class Found:
    """What the side files say of the units of this task's input partition."""

    def __init__(self, side: str):
        tables = beside(side)
        if not tables:
            self.epoch = self.at = self.mask = self.flat = np.zeros(0, np.int64)
            self.bound = np.zeros(1, np.int64)
            return
        epoch, at = (np.concatenate([np.asarray(t.column(c)) for t in tables]).astype(np.int64) for c in ("epoch", "at"))
        mask = np.concatenate([np.asarray(t.column("mask")) for t in tables])
        lists = pa.chunked_array([c for t in tables for c in t.column("ranks").chunks]).combine_chunks()
        size, flat = np.asarray(pc.list_value_length(lists)).astype(np.int64), np.asarray(lists.flatten())
        order = np.lexsort((at, epoch))
        first = np.concatenate([[0], np.cumsum(size)])
        self.epoch, self.at, self.mask = epoch[order], at[order], mask[order]
        self.bound = np.concatenate([[0], np.cumsum(size[order])])
        self.flat = flat[np.arange(self.bound[-1]) + np.repeat(first[order] - self.bound[:-1], size[order])].astype(np.int64)

    def of(self, epoch: int, places: np.ndarray) -> np.ndarray:
        """The row of each place of an epoch, or -1."""
        a, b = np.searchsorted(self.epoch, [epoch, epoch + 1])
        if a == b:
            return np.full(len(places), -1)
        i = np.minimum(a + np.searchsorted(self.at[a:b], places), b - 1)
        return np.where(self.at[i] == places, i, -1)


def gathered(flat: np.ndarray, first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """flat[first : first + size] of each, one after the other."""
    ends = np.cumsum(size)
    return flat[np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(first - (ends - size), size)]


def _ids(cut: Cut, row: np.ndarray, found: Found, pieces: Pieces) -> tuple[np.ndarray, np.ndarray]:
    """(ids of all distinct units, bounds by unit); row: of each unit in found, or -1."""
    size = cut.chars.astype(np.int64)
    whole = (size > pieces.long).nonzero()[0]
    mask = np.full(len(size), -1, np.int64)
    mask[row >= 0] = found.mask[row[row >= 0]]
    mask[whole] = 1
    c = np.frombuffer("".join(cut.units.to_pylist()).encode("utf-32-le"), np.uint32)
    first = np.cumsum(size) - size
    place = np.arange(len(c)) - np.repeat(first, size)
    begin = (np.repeat(mask, size) >> np.minimum(place, 63)) & 1 == 1
    if len(whole):
        begin[np.repeat(size > pieces.long, size) & (place > 0)] = False
    start = np.flatnonzero(begin)
    owner = np.repeat(np.arange(len(size)), size)[start]
    width = np.diff(np.append(start, len(c)))
    # spellings: all ids, then those of characters without a piece, then of long units
    table: list[int] = list(range(len(pieces.text)))
    at, n = np.zeros(len(start), np.int64), np.ones(len(start), np.int64)
    longer = (width > 1) & (size[owner] <= pieces.long)
    have = row[row >= 0]
    ranks = gathered(found.flat, found.bound[have], found.bound[have + 1] - found.bound[have])
    if len(ranks) != int(longer.sum()):
        raise RuntimeError("the input's rows came in other slices in this pass; write it to a table first")
    at[longer] = pieces.by_rank[ranks]
    one = width == 1
    points, of = np.unique(c[start[one]], return_inverse=True)
    spot, many = np.zeros(len(points), np.int64), np.ones(len(points), np.int64)
    for i, p in enumerate(points.tolist()):
        x = pieces.id.get(chr(p))
        if x is not None:
            spot[i] = x
        else:
            ids = pieces.spelled(chr(p))
            spot[i], many[i] = len(table), len(ids)
            table += ids
    at[one], n[one] = spot[of], many[of]
    head = np.flatnonzero((size[owner] > pieces.long) & (width > 1))
    for i in head.tolist():
        ids = pieces.encoded(cut.units[int(owner[i])].as_py())
        at[i], n[i] = len(table), len(ids)
        table += ids
    flat = gathered(np.array(table, np.int64), at, n)
    per = np.bincount(owner, n, len(size)).astype(np.int64)
    return flat.astype("<u4"), np.concatenate([[0], np.cumsum(per)])


def _ordered(path: str, side: str, slice_bytes: int, texts: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces, epochs, found = load(path), Epochs(), Found(side)
        spell = _spelling(path)
        for batch in batches:
            for part in slices(batch, limit=slice_bytes):
                cut = Cut(part.column("text"), pieces)
                some = (cut.chars > 1) & (cut.chars <= pieces.long)
                row = np.full(len(cut.units), -1)
                row[some] = found.of(epochs.number, epochs.places(cut.units.filter(pa.array(some)).to_pylist()))
                if epochs.full():
                    epochs.next()
                flat, base = _ids(cut, row, found, pieces)
                count = np.diff(base)[cut.index]
                ids = gathered(flat, base[cut.index], count)
                bound = np.concatenate([[0], np.cumsum(count)])[cut.bound]
                # decode: the bytes of each id, put together, some rows at a time
                rows = []
                for lo in range(0, part.num_rows, 256):
                    hi = min(lo + 256, part.num_rows)
                    own = ids[bound[lo] : bound[hi]]
                    data = gathered(spell[0], spell[2][own], spell[1][own])
                    stop = np.concatenate([[0], np.cumsum(spell[1][own])])
                    for r in range(lo, hi):
                        x, y = int(bound[r]), int(bound[r + 1])
                        text = data[stop[x - bound[lo]] : stop[y - bound[lo]]].tobytes()
                        text = text[1:] if pieces.prefix and text[:1] == b" " else text
                        rows.append((y - x, zlib.crc32(ids[x:y]), hashlib.sha256(text).hexdigest(), ids[x:y].tolist() if texts else None, text.decode("utf-8", "replace") if texts else None))
                out = [part.column("doc_id"), pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.string())]
                names = ["doc_id", "n_pieces", "ids_crc32", "decoded_sha256"]
                if texts:
                    out += [pa.array([r[3] for r in rows], pa.list_(pa.int32())), pa.array([r[4] for r in rows], pa.string())]
                    names += ["ids", "decoded"]
                yield pa.RecordBatch.from_arrays(out, names)

    return run


@lru_cache(2)
def _spelling(path: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bytes of all pieces, length and place of each id's)."""
    p = load(path)
    text = [bytes([int(t[3:5], 16)]) if k == BYTE else t.replace(SPACE, " ").encode() if k in (NORMAL, USER) else b"" for t, k in zip(p.text, p.type, strict=True)]
    size = np.array([len(t) for t in text])
    return np.frombuffer(b"".join(text), np.uint8), size, np.concatenate([[0], np.cumsum(size)[:-1]])


def encoded(docs: DataFrame, model: str | None = None, texts: bool = False, slice_bytes: int = 3 << 20) -> DataFrame:
    """doc_id, n_pieces, ids_crc32 (of the ids as little-endian 32-bit numbers) and decoded_sha256 of every row; with
    texts also the ids and the decoded text.

    Ids are those of the model's library without begin and end. Decoding gives the text back (U+2581 comes back as a
    space). A null or empty text has no pieces. Repeated rows keep a row each; an empty table gives no rows; other columns
    are ignored, whatever their names; a very long text is a slice of its own.
    """
    spark = docs.sparkSession
    ship(spark)
    path = model or default_path()
    pieces = load(path)
    docs = stable(docs, []).select("doc_id", "text")
    place = scratch(spark, "units")
    rows = written(docs.mapInArrow(tidy(_units(path, slice_bytes)), "part long, epoch int, at int, unit string"), "units", place)
    found = folded(lattice(rows.select("unit").distinct(), piece_table(spark, pieces), pieces), pieces)
    side = scratch(spark, "pieces")
    rows.join(found, "unit").select("part", "epoch", "at", "mask", "ranks").repartition(tasks(spark), "part").write.partitionBy("part").option("compression", "zstd").parquet(side)
    removed(spark, place)
    schema = "doc_id long, n_pieces long, ids_crc32 long, decoded_sha256 string" + (", ids array<int>, decoded string" if texts else "")
    return docs.mapInArrow(tidy(_ordered(path, side, slice_bytes, texts)), schema)
