"""Near-duplicate groups by MinHash: banded minima find candidates, signatures and then whole sets confirm links.

1. A text's set is its distinct shingles; equal sets are one class, for which its first document stands. A signature
   holds the minima of `bands * rows` universal hashes a * x + b of the shingles' names. It leaves the task as one hash
   for each band of minima, packed.
2. Of each class the bands are dealt out; sets that share one are candidates. A pair at the threshold s shares none
   with a chance of (1 - s**rows)**bands, 6e-11 for a pair at 80 % with 46 bands of four. Families are the components
   of sets over shared bands, by large-star and small-star rounds.
3. Only sets with a partner send their names, once, to the block of their family. There signatures are compared first
   (they are made again from the names, so they aren't exchanged): a set that agrees with another in fewer minima than
   the threshold less six standard deviations isn't like it. What is left is counted on whole sets.
4. Links are the components' edges, again by alternating large-star and small-star.
Families of several blocks meet as in jaccard.py. No pairs of documents are exchanged, and no bucket is capped: a bucket
of a million copies of a text is one class, one of a million near copies has a row for each.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm.arrowtext import U, mixed, signed, slices, tidy
from gridloom.llm.jaccard import BLOCK, Index, Join, Sets, alike, rooted
from gridloom.llm.repeats import LAST, Side
from gridloom.llm.session import removed, scratch, written

#: Bands and minima of each.
BANDS, ROWS = 46, 4


@lru_cache(4)
def hashers(k: int) -> tuple[np.ndarray, np.ndarray]:
    """Odd multipliers and summands of k universal hashes, from a rule."""
    with np.errstate(over="ignore"):
        n = np.arange(1, 2 * k + 1, dtype=U) * U(0x9E3779B97F4A7C15)
        return mixed(n[:k]) | U(1), mixed(n[k:])


def minima(h: np.ndarray, bound: np.ndarray, k: int) -> np.ndarray:
    """The k minima (32 bits of each) of every set of names with any, by set; bound: of each set in h."""
    some = bound[:-1][np.diff(bound) > 0]
    out = np.empty((k, len(some)), np.uint32)
    if not len(some):
        return out.T
    x = h >> U(32)
    with np.errstate(over="ignore"):
        for i, (a, b) in enumerate(zip(*hashers(k), strict=True)):
            out[i] = np.minimum.reduceat(x * a + b, some) >> U(32)
    return out.T


def banded(sign: np.ndarray, bands: int) -> np.ndarray:
    """A 64-bit hash for each set and band of its minima."""
    n = len(sign)
    with np.errstate(over="ignore"):
        key = np.broadcast_to(mixed(np.arange(1, bands + 1, dtype=U)), (n, bands)).copy()
        for column in np.moveaxis(sign.reshape(n, bands, -1), 2, 0):
            key = mixed((key ^ column) * U(0x9FB21C651E98DF25))
    return key


def searched(bands: int, rows: int):
    """reached() of jaccard.py with signatures compared before sets are."""

    def run(names: list[np.ndarray], percent: int) -> np.ndarray:
        size = np.fromiter(map(len, names), np.int64, len(names))
        k, s = bands * rows, percent / 100
        sign = minima(np.concatenate(names), np.concatenate([[0], np.cumsum(size)]), k)
        least = k * s - 6 * (k * s * (1 - s)) ** 0.5
        label = np.full(len(names), -1)
        left = np.arange(len(names))
        for seed in range(len(names)):
            if label[seed] >= 0:
                continue
            label[seed] = seed
            queue = [seed]
            while queue and len(left):
                a = queue.pop()
                left = left[label[left] < 0]
                near = left[(sign[left] == sign[a]).sum(1) >= least] if len(left) else left
                for lo in range(0, len(near), 1024):
                    part = near[lo : lo + 1024]
                    new = part[alike(Index(names, part).common(names[a]), int(size[a]), size[part], percent)]
                    label[new] = seed
                    queue += new.tolist()
        return label

    return run


class MinHash(Join):
    def __init__(self, docs: DataFrame, width: int, percent: int, slice_bytes: int, block: int, bands: int, rows: int):
        super().__init__(docs, width, percent, slice_bytes, block)
        self.bands, self.rows = bands, rows
        self.search = searched(bands, rows)

    def signed_sets(self, path: str) -> DataFrame:
        """(row, doc, n, g1, g2, bands) of each input row; bands: their hashes, packed."""
        width, slice_bytes, bands, k = self.width, self.slice_bytes, self.bands, self.bands * self.rows

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            row = TaskContext.get().partitionId() << 32
            for batch in batches:
                for part in slices(batch, limit=slice_bytes):
                    s, n = Sets(part.column("text"), width), part.num_rows
                    with np.errstate(over="ignore"):
                        g = [pa.array(signed(s.sums(mixed(s.h ^ x)))) for x in (U(0xA0761D6478BD642F), U(0xE7037ED1A0B428DB))]
                    key = banded(minima(s.h, s.bound, k), bands).astype("<u8")
                    packed = np.full(n, None, object)
                    packed[s.size > 0] = [x.tobytes() for x in key]
                    yield pa.RecordBatch.from_arrays([pa.array(np.arange(row, row + n)), part.column("doc_id").fill_null(LAST), pa.array(s.size), *g, pa.array(packed, pa.binary())], ["row", "doc", "n", "g1", "g2", "bands"])
                    row += n

        return written(self.docs.mapInArrow(tidy(run), "row long, doc long, n long, g1 long, g2 long, bands binary"), "signatures", path)

    def shared_bands(self, classes: DataFrame) -> DataFrame:
        """(sig, row): the bands of each class."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                keys = [np.frombuffer(x, "<i8") for x in batch.column("bands").to_pylist()]
                if keys:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys)), pa.array(np.repeat(np.asarray(batch.column("row")), [len(x) for x in keys]))], ["sig", "row"])

        return classes.select("row", "bands").mapInArrow(tidy(run), "sig long, row long")

    def sets_of(self, firsts: str) -> DataFrame:
        """(row, n, names) of the rows that a side file lists."""
        width, slice_bytes = self.width, self.slice_bytes

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            listed = Side(firsts)
            for batch in batches:
                for part in slices(batch, limit=slice_bytes):
                    if got := sorted(listed.rows(part)):
                        names = Sets(part.column("text").take(pa.array(got)), width).names()
                        yield pa.RecordBatch.from_arrays([pa.array(np.array(got) + listed.first), pa.array([len(x) for x in names], pa.int64()), pa.array([x.astype("<u8").tobytes() for x in names], pa.binary())], ["row", "n", "names"])

        return self.written(self.docs.mapInArrow(tidy(run), "row long, n long, names binary"), "names")


def near_duplicates(docs: DataFrame, width: int = 2, percent: int = 80, bands: int = BANDS, rows: int = ROWS, slice_bytes: int = 4 << 20, block: int = BLOCK) -> DataFrame:
    """doc_id, n_shingles, component_id, kept (doc_id = component_id) of every row.

    A text's set: its distinct shingles of `width` words, ASCII letters in lower case; with fewer words, all of them as
    one. Rows link if 100 * intersection >= percent * union, counted on whole sets; rows without words link with nothing.
    component_id is the smallest doc_id that a row reaches over links. A null doc_id comes after all others: its row's
    component_id is null unless it links to one with an id, and kept is then null. Repeated rows and rows of one doc_id
    keep a row each. An empty table gives no rows. A very long text is a slice of its own. Other columns are ignored,
    whatever their names.
    """
    j = MinHash(docs, width, percent, slice_bytes, block, bands, rows)
    last = [scratch(j.spark, "signatures"), scratch(j.spark, "classes")]
    sets = j.signed_sets(last[0])
    key, own = ["n", "g1", "g2"], F.struct("doc", "row")
    least = sets.where("n > 0").groupBy(*key).agg(F.min(own).alias("f"))
    classes = j.written(least.select(*key, F.col("f.doc").alias("doc"), F.col("f.row").alias("row")), "classes")
    packed = sets.select("row", "bands").join(classes.select("row"), "row", "left_semi")
    family = j.written(j.families(j.shared_bands(packed), j.spark.createDataFrame([], "a long, b long")), "families")
    listed = family.join(classes, "row").select(F.shiftright("row", 32).alias("part"), "row", F.lit(0).alias("s"), F.lit(1).alias("n"), "doc")
    label = j.linked(family, j.sets_of(j.beside(listed, "listed", "row", "s", "n", "doc")))

    met = j.written(rooted(label).join(classes.select(F.col("row").alias("a"), own.alias("f")), "a"), "members")
    met = met.join(met.groupBy("b").agg(F.min("f").alias("least")), "b").select(F.col("a").alias("row"), "least")
    component = classes.join(met, "row", "left").select(*key, F.coalesce("least.doc", "doc").alias("component"))
    component = written(component, "classes", last[1])
    for path in j.made:
        removed(j.spark, path)
    out = sets.drop("bands").join(component, key, "left")
    null = lambda c: F.when(c != LAST, c)
    out = out.select(null(F.col("doc")).alias("doc_id"), F.col("n").alias("n_shingles"), null(F.coalesce("component", "doc")).alias("component_id"))
    return out.withColumn("kept", F.col("doc_id") == F.col("component_id"))
