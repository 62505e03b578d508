"""Merkle fingerprints of documents.

A text is a tree: sections of paragraphs (lines) of short pieces. Pieces are cut after words whose hash says so, about
four words apart, at line ends, and after MOST words without a cut (words of more than WIDE bytes count as several), so
that a piece is bounded. Sections end at blank lines and after paragraphs whose digest says so. So cuts depend on the
text nearby alone, and an edit changes the nodes above it and few others. Every byte lies in one piece.

A leaf is the 128-bit hash of its piece; a paragraph's digest is a cryptographic hash of its leaves, a section's of its
paragraphs, the root's of the sections: equal roots mean equal texts, and walking down differing nodes locates edits.
The fingerprint is text: the root (32 hex digits), a colon, then the sections apart by "/"; a section is its digest,
"=", and its paragraphs apart by "."; a paragraph is its digest, "-", and its leaves. Digests of nodes below the root
are cut to 8 hex digits; after a leaf's stand its bytes (2 hex digits, 255 at most). Likeness weighs leaves by bytes.
"""

from __future__ import annotations

import hashlib
import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm.arrowtext import SPACE, U, Rolling, tidy
from gridloom.llm.session import id_and_text, ship, tasks

SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
#: A random 64-bit value for each byte.
BYTES = np.random.default_rng(20240607).integers(1, 1 << 63, 256, dtype=np.uint64)
#: One cut in so many words, one section end in so many paragraphs (powers of two).
PIECE, SECTION = 4, 8
#: Most words of a piece, and the bytes of a word from which it counts as several.
MOST, WIDE = 8, 16


def _node(children: bytes) -> bytes:
    return hashlib.blake2b(children, digest_size=16).digest()


class Tree:
    """Digests of 16 bytes: leaves (of the pieces, in order), paragraphs, sections, root; paragraph, section: the first
    leaf of each."""

    def __init__(self, data: bytes):
        d = np.frombuffer(data, np.uint8)
        space = SPACE[d]
        before = np.empty(len(d), bool)
        before[:1] = True
        before[1:] = space[:-1]
        start = np.flatnonzero(~space & before)  # of words
        after = np.empty(len(d), bool)
        after[-1:] = True
        after[:-1] = space[1:]
        end = np.flatnonzero(~space & after) + 1
        if not len(start):
            start, end = np.zeros(1, np.int64), np.array([len(d)])
        if (many := np.maximum(end - start - 1, 0) // WIDE).any():  # long words, in parts
            first = np.cumsum(many + 1) - many - 1
            part = np.arange(len(start) + int(many.sum())) - np.repeat(first, many + 1)
            start = np.repeat(start, many + 1) + WIDE * part
            end = np.minimum(start + WIDE, np.repeat(end, many + 1))
        word = Rolling(BYTES[d]).span(start, end)
        line = np.concatenate([[0], np.cumsum(d == 10)])[start]
        jump = np.diff(line)
        new = np.concatenate([[True], ((word[:-1] & U(PIECE - 1)) == 0) | (jump > 0)])
        since = np.arange(len(new)) - np.maximum.accumulate(np.where(new, np.arange(len(new)), 0))
        new |= since % MOST == 0
        at = start[new]
        at[0] = 0
        stop = np.append(at[1:], len(d))
        self.leaves = [xxhash.xxh3_128_digest(data[a:b]) for a, b in zip(at.tolist(), stop.tolist(), strict=True)]
        steps = np.concatenate([[2], jump])[new]
        self.paragraph = np.flatnonzero(steps > 0).tolist()
        self.paragraphs = [_node(b"".join(self.leaves[a:b])) for a, b in zip(self.paragraph, [*self.paragraph[1:], len(self.leaves)], strict=True)]
        jumps = steps[self.paragraph].tolist()
        self.section = [0] + [k for k in range(1, len(jumps)) if jumps[k] > 1 or self.paragraphs[k - 1][0] % SECTION == 0]  # the first paragraph of each
        self.sections = [_node(b"".join(self.paragraphs[a:b])) for a, b in zip(self.section, [*self.section[1:], len(jumps)], strict=True)]
        self.root = _node(b"".join(self.sections) + len(data).to_bytes(8, "little")).hex()
        self.bytes = np.minimum(stop - at, 255)
        self.short = np.sort((np.frombuffer(b"".join(self.leaves), ">u4")[::4].astype(np.int64) << 8) | self.bytes)

    def __str__(self) -> str:
        h = [f"{x[:4].hex()}{n:02x}" for x, n in zip(self.leaves, self.bytes.tolist(), strict=True)]
        p = [f"{x[:4].hex()}-{''.join(h[a:b])}" for x, a, b in zip(self.paragraphs, self.paragraph, [*self.paragraph[1:], len(h)], strict=True)]
        return f"{self.root}:" + "/".join(f"{x[:4].hex()}={'.'.join(p[a:b])}" for x, a, b in zip(self.sections, self.section, [*self.section[1:], len(p)], strict=True))


def _common(a: np.ndarray, b: np.ndarray) -> float:
    """Of two different texts: twice the bytes of the leaves that their sorted lists have in common, over the bytes of
    all; equal ones count as often as in both. The same leaves in another order stay below 1."""
    total = int((a & 255).sum() + (b & 255).sum())
    value = np.unique(a)
    times = [np.searchsorted(x, value, "right") - np.searchsorted(x, value) for x in (a, b)]
    same = int((np.minimum(*times) * (value & 255)).sum())
    return min(2 * same, total - 1) / total


def _sections(f: str) -> list[tuple[str, list[tuple[str, str]]]]:
    """(digest, [(digest, leaves) of each paragraph]) of each section of a fingerprint."""
    parted = (x.partition("=")[::2] for x in f.partition(":")[2].split("/"))
    return [(d, [p.partition("-")[::2] for p in rest.split(".")]) for d, rest in parted]


def likeness(a: str, b: str) -> float:
    """Of two fingerprints, 0 to 1: 1 for equal ones, else the share of bytes in leaves that both have."""
    if a == b:
        return 1.0
    return _common(*(np.sort(np.array([int(x[i : i + 10], 16) for _, s in _sections(f) for _, x in s for i in range(0, len(x), 10)])) for f in (a, b)))


def fingerprint(text: str | None) -> str:
    return str(Tree((text or "").encode()))


def differing(a: str, b: str) -> list[tuple[int, int]]:
    """(section, paragraph) of the branches of a that b doesn't have, from the root down: a node that b has too is left."""
    if a.partition(":")[0] == b.partition(":")[0]:
        return []
    there = _sections(b)
    sections, paragraphs = {d for d, _ in there}, {d for _, s in there for d, _ in s}
    return [(i, j) for i, (d, s) in enumerate(_sections(a)) if d not in sections for j, (p, _) in enumerate(s) if p not in paragraphs]


def _near(a: Tree, b: Tree) -> float:
    return 1.0 if a.root == b.root else _common(a.short, b.short)


def _edits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in order of (bucket, extra, doc_id): each with the next; an extra row is the first of the next bucket."""
    out: list[tuple] = []
    held = None  # bucket, doc_id, text, tree

    def row(now: tuple, text: str, tree: Tree) -> tuple:
        _, doc, t, own = now
        n = len(t)
        k = n // 4
        edited = (t[: n - k] + text[:k]).encode()
        other = Tree(edited)
        return doc, n, hashlib.sha256(edited).hexdigest(), str(own), str(other), _near(own, other), _near(own, tree)

    def flush() -> pa.RecordBatch:
        names = [x.split()[0] for x in SCHEMA.split(", ")]
        kinds = [{"long": pa.int64(), "string": pa.string(), "double": pa.float64()}[x.split()[1]] for x in SCHEMA.split(", ")]
        rb = pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], k) for i, k in enumerate(kinds)], names)
        out.clear()
        return rb

    for batch in batches:
        texts = batch.column("text")
        for i, (bucket, extra, doc) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("bucket", "extra", "doc_id")), strict=True)):
            text = texts[i].as_py()
            if extra and (held is None or held[0] != bucket):
                continue  # a second first row: the one before has been used
            tree = Tree(text.encode())
            if held is not None:
                out.append(row(held, text, tree))
            held = None if extra else (bucket, doc, text, tree)
            if len(out) >= 1000:
                yield flush()
    if out:
        yield flush()


def edit_fingerprints(docs: DataFrame) -> DataFrame:
    """Fingerprints of every text and of its edited text, and their likeness; see SCHEMA.

    The edited text has its last n_chars // 4 code points replaced by the first as many (or all) of the next
    document's, in order of doc_id, then the text's hash, then text; null ids come first; after the last comes the
    first, so that a single row is its own next. Null texts are empty. Repeated rows are documents of their own. An
    empty table gives no rows. Other columns are ignored, whatever their names. A very long text is a row like others.

    Texts are dealt once, by ranges of doc_id, and of the text's hash where an id has so many rows that several cuts
    fall on it; rows that are alike in both stay together. What the driver gathers is the first row's id and hash of
    each range.
    """
    spark = docs.sparkSession
    ship(spark)
    n = tasks(spark)
    key = F.coalesce("doc_id", F.lit(-(1 << 63)))
    rows = id_and_text(docs).withColumns({"key": key, "at": key.cast("double"), "hash": F.xxhash64("text")})
    times = Counter(rows.select("at").approxQuantile("at", [i / n for i in range(1, n)], 0.1 / n))
    cuts = sorted(times)
    base, table = 1, [(0, 0, None, 0)]  # range, its first bucket, an id with many rows, and how many buckets that gets
    for i, c in enumerate(cuts):
        m = times[c] if times[c] > 1 else 0
        table.append((i + 1, base, int(c) if m else None, m))
        base += m + 2 if m else 1
    rows = Bucketizer(splits=[-math.inf, *cuts, math.inf], inputCol="at", outputCol="range").transform(rows) if cuts else rows.withColumn("range", F.lit(0))
    rows = rows.withColumn("range", F.col("range").cast("int")).join(F.broadcast(spark.createDataFrame(table, "range int, base int, id long, m int")), "range")  # a row for each range
    share = F.shiftright(F.shiftrightunsigned("hash", 33) * F.col("m"), 31).cast("int")
    slot = F.when((F.col("m") == 0) | (F.col("key") < F.col("id")), 0).when(F.col("key") > F.col("id"), F.col("m") + 1).otherwise(1 + share)
    # in the order of the hash as a number without sign, so that shares follow each other
    rows = rows.select((F.col("base") + slot).alias("bucket"), "key", F.col("hash").bitwiseXOR(F.lit(-(1 << 63))).alias("hash"), "doc_id", "text")
    firsts = sorted((r.bucket, *r.first) for r in rows.groupBy("bucket").agg(F.min(F.struct("key", "hash")).alias("first")).collect())
    heads = [(key, h, firsts[i - 1][0]) for i, (_, key, h) in enumerate(firsts)]
    head = spark.createDataFrame(heads, "key long, hash long, previous int")
    rows = rows.join(F.broadcast(head), ["key", "hash"], "left")
    places = F.array_compact(F.array(F.struct("bucket", F.lit(False).alias("extra")), F.when(F.col("previous").isNotNull(), F.struct(F.col("previous").alias("bucket"), F.lit(True).alias("extra")))))
    rows = rows.select(F.explode(places).alias("place"), "key", "hash", "doc_id", "text").select("place.bucket", "place.extra", "key", "hash", "doc_id", "text")
    order = ["bucket", "extra", "key", "hash", "text"]
    return rows.repartitionById(n, F.col("bucket") % n).sortWithinPartitions(*order).drop("key", "hash").mapInArrow(tidy(_edits), SCHEMA)
