"""Token counts of whole texts without materialising the ids of any text.

Three steps, two exchanges of compact rows, no exchange of texts:
1. Each task cuts its texts into pre-tokens, a block of documents at a time, and emits for each block and distinct
   pre-token the frequencies by document (a packed list). Pre-tokens that are one piece by themselves need no lookup
   and are summed at once.
2. Rows meet by pre-token and group of blocks, in order of both; the pieces of a pre-token are counted once, and count
   times frequency is summed by document into one packed list per block and task, of the documents that have any. A
   task holds the sums of one group of blocks at a time, and the lists grow with the pre-tokens.
3. The lists of a block are added up.
A frequent pre-token has one row per block however often it occurs; blocks beyond `group` input partitions go to
another task, so that no pre-token's rows grow without bound.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm import bytebpe
from gridloom.llm.arrowtext import ROWS, raw, slices, tidy
from gridloom.llm.session import id_and_text, ship, tasks



def _frequencies(path: str, block_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = bytebpe.load(path)
        block = TaskContext.get().partitionId() << 24
        for batch in batches:
            for part in slices(batch, limit=block_bytes):
                data, off = raw(part.column("text"))
                pre = bytebpe.PreTokens(data, off, tuple(bpe.special))
                idx, words = pre.encode() if len(pre.start) else (np.zeros(0, np.int64), pa.array([], pa.binary()))
                listed = words.to_pylist()
                special = {s.encode() for s in bpe.special}
                known = np.fromiter((w in bpe.ranks or w in special for w in listed), bool, len(listed))
                row = np.repeat(np.arange(part.num_rows), np.diff(pre.bound))
                one = known[idx]
                sums = np.bincount(row[one], minlength=part.num_rows).astype("<i4")
                key, n = np.unique(idx[~one].astype(np.int64) * ROWS + row[~one], return_counts=True)
                word, at = key // ROWS, (key % ROWS).astype("<u2")
                cut = np.flatnonzero(np.diff(word, prepend=-1))
                ends = [*cut[1:].tolist(), len(key)][: len(cut)]
                n = n.astype("<u4")
                small = np.maximum.reduceat(n, cut) < 256 if len(cut) else np.zeros(0, bool)
                little = n.astype("u1")
                lists = [at[a:b].tobytes() + (little if s else n)[a:b].tobytes() for a, b, s in zip(cut.tolist(), ends, small.tolist(), strict=True)]
                ids = np.asarray(part.column("doc_id").fill_null(0), "<i8")
                null = np.asarray(part.column("doc_id").is_null(), "u1")
                head = ids.tobytes() + null.tobytes() + np.diff(off).astype("<i8").tobytes() + sums.tobytes()
                yield pa.RecordBatch.from_arrays(
                    [pa.array([block] * (len(lists) + 1), pa.int64()), pa.array([None, *(listed[i] for i in word[cut].tolist())], pa.binary()), pa.array([4, *np.where(small, 1, 4).tolist()], pa.int32()), pa.array([head, *lists], pa.binary())],
                    ["block", "piece", "width", "packed"],
                )
                block += 1

    return run


#: What a packed list holds.
HEAD, DENSE, SPARSE = 0, 1, 2


def _summed(path: str):
    """Rows (salt, piece, block, width, packed) in order of salt and piece to (block, kind, packed): heads as they are,
    and sums by document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = bytebpe.load(path)
        sums: dict[int, np.ndarray] = {}
        now, last, pieces = None, None, 0

        def out(rows: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2] for r in rows], pa.binary())], ["block", "kind", "packed"])

        def flush() -> pa.RecordBatch:
            rows = []
            for block, got in sums.items():
                at = np.flatnonzero(got)
                if 6 * len(at) < 4 * len(got):
                    rows.append((block, SPARSE, at.astype("<u2").tobytes() + got[at].astype("<u4").tobytes()))
                else:
                    rows.append((block, DENSE, got.astype("<u4").tobytes()))
            sums.clear()
            return out(rows)

        for batch in batches:
            for salt, block, piece, width, packed in zip(*(batch.column(c).to_pylist() for c in ("salt", "block", "piece", "width", "packed")), strict=True):
                if piece is None:
                    yield out([(block, HEAD, packed)])
                    continue
                if salt != now:
                    if sums:
                        yield flush()
                    now, last = salt, None
                if piece != last:
                    last, pieces = piece, len(bpe.merged(piece))
                n = len(packed) // (2 + width)
                got = sums.get(block)
                if got is None:
                    got = sums[block] = np.zeros(256, np.int64)
                most = int.from_bytes(packed[2 * n - 2 : 2 * n], "little")
                if most >= len(got):
                    got = sums[block] = np.concatenate([got, np.zeros(most + 1, np.int64)])
                if n == 1:
                    got[most] += pieces * int.from_bytes(packed[2:], "little")
                else:
                    got[np.frombuffer(packed, "<u2", n)] += pieces * np.frombuffer(packed, f"<u{width}", n, 2 * n).astype(np.int64)
        if sums:
            yield flush()

    return run


def _blocks(limit: int):
    """Rows of a block together, the one with the documents first, to a row for each document."""

    def done(head: bytes, sums: np.ndarray) -> pa.RecordBatch:
        n = len(head) // 21
        ids, null = np.frombuffer(head, "<i8", n), np.frombuffer(head, "u1", n, 8 * n).astype(bool)
        size, own = np.frombuffer(head, "<i8", n, 9 * n), np.frombuffer(head, "<i4", n, 17 * n)
        total = own + sums[:n]
        return pa.RecordBatch.from_arrays([pa.array(ids, mask=null), pa.array(size), pa.array(total), pa.array(total > limit)], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, head, sums = None, b"", np.zeros(0, np.int64)
        for batch in batches:
            for block, kind, packed in zip(*(batch.column(c).to_pylist() for c in ("block", "kind", "packed")), strict=True):
                if kind == HEAD:
                    if now is not None:
                        yield done(head, sums)
                    now, head, sums = block, packed, np.zeros(len(packed) // 21, np.int64)
                elif kind == DENSE:
                    got = np.frombuffer(packed, "<u4")[: len(sums)]
                    sums[: len(got)] += got
                else:
                    n = len(packed) // 6
                    sums[np.frombuffer(packed, "<u2", n)] += np.frombuffer(packed, "<u4", n, 2 * n)
        if now is not None:
            yield done(head, sums)

    return run


def token_counts(docs: DataFrame, tokenizer: str | None = None, limit: int = 512, block_bytes: int = 10 << 20, group: int = 256) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit (n_tokens > limit) of every row; null text counts as empty.

    Repeated rows and null doc_ids each keep their own row; an empty table gives no rows; other columns are ignored,
    whatever their names; a very long text is a block of its own. `group`: input partitions whose rows of a pre-token meet in one task.
    """
    spark = docs.sparkSession
    ship(spark)
    path = tokenizer or bytebpe.default_path()
    rows = id_and_text(docs).mapInArrow(tidy(_frequencies(path, block_bytes)), "block long, piece binary, width int, packed binary")
    place = F.shiftright("block", 24)
    met = rows.withColumn("salt", F.when(F.col("piece").isNull(), F.col("block")).otherwise(F.floor(place / group)))
    met = met.repartition(tasks(spark), "piece", "salt").sortWithinPartitions("salt", "piece")
    sums = met.mapInArrow(tidy(_summed(path)), "block long, kind int, packed binary")
    back = sums.repartition(tasks(spark), "block").sortWithinPartitions("block", "kind")
    return back.mapInArrow(tidy(_blocks(limit)), "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
