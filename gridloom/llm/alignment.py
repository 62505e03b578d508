"""Alignment of the tokens of two tokenizers over the same bytes: groups, links, and how usual each link is.

1. Texts are cut where a pre-token of tokenizer A begins and no piece of tokenizer B can span: before a space as a rule.
   Tokens of both end there, so what lies between, a chunk, is aligned by itself, once for a slice however often it
   occurs.
2. A transducer reads the two token sequences of a chunk. Its state is the side that leads and the bytes of that side's
   last token which the other side hasn't matched yet; the lagging side's next token overlaps that token alone, which is
   a link, and what dangles then is the next state. Transitions depend on the residual and the token alone and are
   memoised. An empty residual closes a group.
3. A row for each slice holds what its documents have, and their links as numbers: each document's chunks, each chunk's
   links, each link's pair of ids. Links are counted by pair in each task (pairs are bounded by the two vocabularies),
   and summed over all.
4. Each input partition gets the counts of its own pairs in a side file, with whether a count is the highest of its B id;
   the slices are read again, and counts summed by document. Texts are read and tokenised once.
Texts and tokens are never exchanged.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm import bytebpe, pieces
from gridloom.llm.arrowtext import raw, slices, tidy
from gridloom.llm.repeats import beside
from gridloom.llm.session import id_and_text, removed, scratch, ship, tasks, written

#: Transitions and chunks that a worker keeps; beyond that it forgets and starts again. Longer chunks aren't kept.
KEPT, LONGEST = 100_000, 200
#: Pairs that a task counts before it hands them on.
PAIRS = 1 << 20
#: Between the pre-tokens of a chunk; no UTF-8 text has it.
MARK = b"\xff"


class Transducer:
    """Aligns two sequences of ids; spell: the bytes of each id, of A and of B."""

    def __init__(self, spell: tuple[list[bytes], list[bytes]]):
        self.spell = spell
        self.known: dict[tuple[int, bytes, int], tuple[int, bytes] | None] = {}

    def after(self, lead: int, residual: bytes, token: int) -> tuple[int, bytes] | None:
        """(leading side, residual) once the lagging side's token is read; None if the bytes differ."""
        t = self.spell[1 - lead][token]
        n = min(len(t), len(residual))
        if t[:n] != residual[:n]:
            return None
        return (1 - lead, t[n:]) if len(t) > len(residual) else (lead, residual[n:])

    def groups(self, a: list[int], b: list[int]) -> tuple[list[tuple[list[int], list[int]]], list[tuple[int, int]]] | None:
        """(groups, links) of two sequences that spell the same bytes, else None."""
        known, first, out, links = self.known, self.spell[0], [], []
        ids, at, size = (a, b), [0, 0], (len(a), len(b))
        while at[0] < size[0] and at[1] < size[1]:
            lead, last = 0, a[at[0]]
            residual = first[last]
            group = ([last], [])
            at[0] += 1
            while residual:
                lag = 1 - lead
                i = at[lag]
                if i == size[lag]:
                    return None
                token = ids[lag][i]
                at[lag] = i + 1
                group[lag].append(token)
                links.append((last, token) if lag else (token, last))
                key = (lead, residual, token)
                got = known.get(key, 0)
                if got == 0:
                    got = self.after(lead, residual, token)
                    if len(known) >= KEPT:
                        known.clear()
                    known[key] = got
                if got is None:
                    return None
                if got[0] != lead:
                    last = token
                lead, residual = got
            out.append(group)
        return (out, links) if at == [*size] else None


class Tokenizers:
    """A: a byte-level BPE file. B: a piece model, without the space it puts before a text (the texts here have it)."""

    def __init__(self, first: str, second: str):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2 as pb

        self.a, self.b = bytebpe.load(first), pieces.load(second)
        if not self.b.prefix:
            raise ValueError(f"{second}: only models that put a space before a text")
        m = pb.ModelProto()
        with open(second, "rb") as f:
            m.ParseFromString(f.read())
        m.normalizer_spec.add_dummy_prefix = False
        self.model = sentencepiece.SentencePieceProcessor(model_proto=m.SerializeToString())
        data, size, at = pieces._spelling(second)
        whole = data.tobytes()
        spelled = {i: t for t, i in self.a.ranks.items()}
        self.align = Transducer(([spelled.get(i, b"") for i in range(max(spelled) + 1)], [whole[p : p + n] for p, n in zip(at.tolist(), size.tolist(), strict=True)]))
        self.names = [str(i) for i in range(max(map(len, self.align.spell)))]
        self.chunks: dict[bytes, tuple | None] = {}

    def tokens(self, chunks: list[bytes]) -> Iterator[tuple[list[int], list[int]]]:
        """(ids of A, ids of B) of each chunk."""
        second = self.model.encode([c.replace(MARK, b"").decode() for c in chunks], num_threads=1)
        for c, b in zip(chunks, second, strict=True):
            yield [i for t in c.split(MARK) for i in self.a.ids(t)], b

    def aligned(self, chunks: list[bytes]) -> list[tuple[int, int, int, list[int], bytes] | None]:
        """(tokens of A, of B, groups, links as 2**32 * a + b, groups as text) of each chunk, None where the bytes differ."""
        known, name = self.chunks, self.names
        new = [c for c in chunks if c not in known]
        fresh = {}
        for c, (a, b) in zip(new, self.tokens(new), strict=True):
            got = self.align.groups(a, b)
            if got is not None:
                text = ";".join([",".join([name[i] for i in x]) + "|" + ",".join([name[i] for i in y]) for x, y in got[0]])
                got = (len(a), len(b), len(got[0]), [x << 32 | y for x, y in got[1]], text.encode())
            fresh[c] = got
        out = [fresh[c] if c in fresh else known[c] for c in chunks]
        if len(known) + len(fresh) > KEPT:
            known.clear()
        for c, got in fresh.items():
            if len(c) <= LONGEST and len(known) < KEPT:
                known[c] = got
        return out


@lru_cache(1)
def load(first: str, second: str) -> Tokenizers:
    return Tokenizers(first, second)


class Aligned:
    """The chunks of a slice: rows, an index for each, and what the distinct ones are."""

    def __init__(self, col: pa.Array, t: Tokenizers):
        data, off = raw(col)
        full = np.diff(off) > 0
        data = np.insert(data, off[:-1][full], 0x20)
        off = off + np.concatenate([[0], np.cumsum(full)])
        pre = bytebpe.PreTokens(data, off, (), keep=True)
        c, where = pre.points, pre.where
        if not len(c):
            self.index, self.bound, self.found = np.zeros(0, np.int64), pre.bound, []
        else:
            k = t.b.index[np.where(c == 0x20, ord(pieces.SPACE), c)]
            cut = np.ones(len(c), bool)
            np.take(t.b.apart, k[:-1].astype(np.int32) * np.int32(t.b.width) + k[1:], out=cut[1:])
            cut[np.searchsorted(where[:-1], off[:-1][full])] = True
            both = cut[pre.marks]
            start, inner = pre.start[both], pre.start[~both]
            marked = np.insert(data, inner, MARK[0])
            o = np.append(start + np.searchsorted(inner, start), len(marked)).astype(np.int32)
            e = pa.BinaryArray.from_buffers(pa.binary(), len(start), [None, pa.py_buffer(o), pa.py_buffer(marked)]).dictionary_encode()
            self.index, self.bound = e.indices.to_numpy(zero_copy_only=False), np.searchsorted(start, off)
            self.found = t.aligned(e.dictionary.to_pylist())
        wrong = np.fromiter((x is None for x in self.found), bool, len(self.found))
        row = np.repeat(np.arange(len(col)), np.diff(self.bound))
        self.sound = np.ones(len(col), bool)
        self.sound[row[wrong[self.index]]] = False
        self.times = np.bincount(self.index[self.sound[row]], minlength=len(self.found))
        links = [x[3] if x else [] for x in self.found]
        self.size = np.fromiter(map(len, links), np.int64, len(links))
        self.links = np.fromiter((i for x in links for i in x), np.int64, int(self.size.sum()))

    def by_row(self, values: np.ndarray) -> np.ndarray:
        """Sums by row of a value of each distinct chunk; 0 for rows whose bytes differ."""
        total = np.concatenate([[0], np.cumsum(values[self.index], dtype=np.int64)])
        return np.where(self.sound, total[self.bound[1:]] - total[self.bound[:-1]], 0)


def summed(pairs: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(pairs)
    pairs, n = pairs[order], n[order]
    first = np.flatnonzero(np.diff(pairs, prepend=-1))
    return pairs[first], np.add.reduceat(n, first) if len(first) else n[:0]


#: Numbers of a slice, packed: which documents count, the chunks of each, which distinct one each is; the links of each
#: distinct chunk, which pair each is; the pairs.
PACKED = ["sound", "bound", "chunks", "sizes", "links", "pairs"]
SLICES = "part long, pair long, n long, docs array<struct<doc_id: long, n_a: long, n_b: long, n_groups: long, n_links: long, groups_sha256: string, groups: string>>, " + ", ".join(f"{c} binary" for c in PACKED)
DOC = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "groups"]


def least(x: np.ndarray) -> bytes:
    """Whole numbers in as few bytes each as the largest needs, after one that says how many."""
    width = next(w for w in (1, 2, 4, 8) if x.max(initial=0) < 1 << (8 * w - (w == 8)))
    return bytes([width]) + x.astype(f"<u{width}").tobytes()


def numbers(data: bytes) -> np.ndarray:
    return np.frombuffer(data, f"<u{data[0]}", offset=1).astype(np.int64)


def _aligned(paths: tuple[str, str], slice_bytes: int, texts: bool):
    """A row for each slice, and at the end of a task (part, pair, n): how many links of its input partition have each pair."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t, part_id = load(*paths), TaskContext.get().partitionId()
        pairs, n = np.zeros(0, np.int64), np.zeros(0, np.int64)
        kinds = pa.schema([("part", pa.int64()), ("pair", pa.int64()), ("n", pa.int64()), ("docs", pa.list_(pa.struct([(c, pa.string() if c.startswith("groups") else pa.int64()) for c in DOC]))), *((c, pa.binary()) for c in PACKED)])

        def out() -> pa.RecordBatch:
            k = len(pairs)
            return pa.RecordBatch.from_arrays([pa.array([part_id] * k, pa.int64()), pa.array(pairs), pa.array(n), *(pa.nulls(k, f.type) for f in list(kinds)[3:])], schema=kinds)

        for batch in batches:
            for part in slices(batch, limit=slice_bytes):
                s = Aligned(part.column("text"), t)
                by_chunk = [np.array([x[i] if x else 0 for x in s.found], np.int64) for i in range(3)] + [s.size]
                spelled = [x[4] if x else b"" for x in s.found]
                index, ends = s.index.tolist(), s.bound.tolist()
                whole = [b";".join(map(spelled.__getitem__, index[a:b])) if ok else b"" for a, b, ok in zip(ends, ends[1:], s.sound.tolist(), strict=False)]
                docs = [part.column("doc_id"), *(pa.array(s.by_row(v)) for v in by_chunk), pa.array([hashlib.sha256(x).hexdigest() if x else "" for x in whole], pa.string())]
                docs.append(pa.array([x.decode() for x in whole], pa.string()) if texts else pa.nulls(part.num_rows, pa.string()))
                own, place = np.unique(s.links, return_inverse=True)
                row = [least(x) for x in (s.sound, s.bound, s.index, s.size, place, own)]
                listed = pa.ListArray.from_arrays(pa.array([0, part.num_rows], pa.int32()), pa.StructArray.from_arrays(docs, names=DOC))
                yield pa.RecordBatch.from_arrays([pa.array([part_id]), pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64()), listed, *(pa.array([x], pa.binary()) for x in row)], schema=kinds)
                times = np.bincount(place, np.repeat(s.times, s.size), len(own)).astype(np.int64)
                pairs, n = summed(np.concatenate([pairs, own[times > 0]]), np.concatenate([n, times[times > 0]]))
                if len(pairs) > PAIRS:
                    yield out()
                    pairs, n = pairs[:0], n[:0]
        yield out()

    return run


class Counts:
    """What the side files say of the pairs of an input partition."""

    def __init__(self, side: str, part: int):
        tables = beside(side, part)
        pair, n, best = (np.concatenate([np.asarray(t.column(c)) for t in tables]) if tables else np.zeros(0, np.int64) for c in ("pair", "total", "best"))
        order = np.argsort(pair)
        self.pair, self.n, self.best = pair[order], n[order], best[order].astype(np.int64)

    def of(self, pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(count, whether it is the highest of its B id) of each pair; 0 for pairs of texts that don't count."""
        if not len(self.pair):
            return np.zeros(len(pairs), np.int64), np.zeros(len(pairs), np.int64)
        at = np.minimum(np.searchsorted(self.pair, pairs), len(self.pair) - 1)
        known = self.pair[at] == pairs
        return np.where(known, self.n[at], 0), np.where(known, self.best[at], 0)


def differences(total: np.ndarray, bound: np.ndarray) -> np.ndarray:
    """Sums between bounds."""
    run = np.concatenate([[0], np.cumsum(total)])
    return run[bound[1:]] - run[bound[:-1]]


def _counted(side: str):
    """Slices to documents with the sums of their links' counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, counts = None, None
        for batch in batches:
            for i in range(batch.num_rows):
                part = batch.column("part")[i].as_py()
                if part != now:
                    now, counts = part, Counts(side, part)
                sound, bound, index, size, place, own = (numbers(batch.column(c)[i].as_buffer().to_pybytes()) for c in PACKED)
                ends = np.concatenate([[0], np.cumsum(size)])
                count, best = (np.where(sound > 0, differences(differences(v[place], ends)[index], bound), 0) for v in counts.of(own))
                docs = batch.column("docs")[i].values
                whole = {c: docs.field(c) for c in DOC} | {"n_best": pa.array(best), "count_sum": pa.array(count)}
                yield pa.RecordBatch.from_pydict({c: whole[c] for c in OUT})

    return run


OUT = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256", "groups"]


def link_counts(rows: DataFrame) -> DataFrame:
    """(pair, total, best) over all partitions; best: no other pair of its B id has more links."""
    total = rows.groupBy("pair").agg(F.sum("n").alias("total")).withColumn("b", F.col("pair").bitwiseAND(0xFFFFFFFF))
    return total.join(total.groupBy("b").agg(F.max("total").alias("most")), "b").select("pair", "total", (F.col("total") == F.col("most")).alias("best"))


def aligned(docs: DataFrame, first: str | None = None, second: str | None = None, texts: bool = False, slice_bytes: int = 4 << 20) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 of every row; with texts also the groups,
    as `a1,a2|b1;a3|b2,b3` in ids.

    A space and the text are encoded by the byte-level BPE in `first` (A), the text by the piece model in `second` (B,
    which puts the space there); special strings are plain text. Where tokens of both end, groups end; tokens whose bytes
    overlap are linked. A pair's count is its links in all texts; n_best: links whose count no other A id has more of with
    their B id; count_sum: counts over links. Null and empty texts, and those whose bytes A or B doesn't give back (with a
    U+2581, say), have no tokens: zeros and ''. Repeated rows count each and keep a row each, as do rows of one or no
    doc_id; an empty table gives no rows; other columns are ignored, whatever their names; a very long text is a slice
    of its own.
    """
    spark = docs.sparkSession
    ship(spark)
    paths = (first or bytebpe.default_path(), second or pieces.default_path())
    docs = id_and_text(docs)
    places = [scratch(spark, x) for x in ("slices", "counts")]
    rows = written(docs.select("doc_id", "text").mapInArrow(tidy(_aligned(paths, slice_bytes, texts)), SLICES), "slices", places[0])
    pairs = rows.where("pair is not null").select("part", "pair", "n")
    counts = written(link_counts(pairs), "counts", places[1])
    side = scratch(spark, "links")
    pairs.select("part", "pair").distinct().join(counts, "pair").repartition(tasks(spark), "part").write.partitionBy("part").option("compression", "zstd").parquet(side)
    removed(spark, places[1])
    schema = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string, groups string"
    out = rows.where("pair is null").drop("pair", "n").mapInArrow(tidy(_counted(side)), schema)
    return out if texts else out.drop("groups")
