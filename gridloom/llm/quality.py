"""Quality rules: measures of each text, and lines that too many documents of a host share.

1. A pass over the texts gives, for each row, a digest of the text and its distinct lines (normalised: ASCII lower
   case, white space collapsed) as 64-bit hashes.
2. For each host and line, the distinct documents are counted (equal texts are one document: copies are for
   deduplication to find). Lines in more than `line_limit` documents are removed, however many the host has: their
   hashes are written beside the rows that have them.
3. A second pass gives the base measures and the text without the removed lines. A document is rejected if it fails the
   base rules, or is depleted: it lost words, and what remains has fewer than `min_words` words or less than `min_left`
   of the words.
Lines of any length count, a text without newlines is one line. Only hashes are shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridloom.llm import repeats
from gridloom.llm.arrowtext import U, Rolling, Words, mixed, signed, slices, tidy
from gridloom.llm.session import removed, scratch, ship, written

#: Bytes of text that a worker takes at once.
SLICE = 3 << 20
SYMBOLS = np.zeros(256, bool)
SYMBOLS[list(b"#*$%&|<>")] = True
LINES = "row long, doc long, host string, digest long, lines array<long>"
VERDICT = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, n_line_words long, kept_text string, row long"


def repeated_words(words: Words, width: int = 5) -> np.ndarray:
    """By row, the words in windows of `width` words that occur twice or more in the row."""
    rows = len(words.bound) - 1
    n = len(words.start)
    if n < width:
        return np.zeros(rows, np.int64)
    roll = Rolling(words.hashes()[0])
    at = np.flatnonzero(words.row[: n - width + 1] == words.row[width - 1 :])
    with np.errstate(over="ignore"):
        key = mixed(roll.span(at, at + width) ^ (words.row[at].astype(U) * U(0xA0761D6478BD642F)))
    order = np.argsort(key, kind="stable")
    same = key[order][1:] == key[order][:-1]
    twice = np.zeros(len(at), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    change = np.zeros(n + 1, np.int64)
    np.add.at(change, at[twice], 1)
    np.add.at(change, at[twice] + width, -1)
    covered = np.concatenate([[0], np.cumsum(np.cumsum(change[:-1]) > 0)])
    return covered[words.bound[1:]] - covered[words.bound[:-1]]


def _by_row(flags: np.ndarray, off: np.ndarray) -> np.ndarray:
    total = np.zeros(len(flags) + 1, np.int32)
    np.cumsum(flags, out=total[1:])
    return (total[off[1:]] - total[off[:-1]]).astype(np.int64)


def _line(w: list[bytes]) -> int:
    h = xxhash.xxh3_64_intdigest(b" ".join(w).lower())
    return h - ((h >> 63) << 64)


def _lines(text: bytes) -> list[int]:
    """The distinct normalised lines."""
    return list({_line(w) for line in text.split(b"\n") if (w := line.split())})


def _left(text: bytes, shared: set[int]) -> tuple[int, int, bytes]:
    """(lines with a word that equal an earlier line, words of shared lines, the text without these lines)."""
    seen, again, gone, left = set(), 0, 0, []
    for line in text.split(b"\n"):
        w = line.split()
        if w and line in seen:
            again += 1
        elif w:
            seen.add(line)
        if w and shared and _line(w) in shared:
            gone += len(w)
        else:
            left.append(line)
    return again, gone, b"\n".join(left) if gone else text


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [x.split()[0] for x in LINES.split(", ")]
    row = TaskContext.get().partitionId() << 32
    for batch in batches:
        for part in slices(batch, limit=SLICE):
            n = part.num_rows
            texts = [t.as_buffer().to_pybytes() for t in part.column("text")]
            digest = np.fromiter((xxhash.xxh3_64_intdigest(t) for t in texts), U, n)
            lines = pa.array([_lines(t) for t in texts], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(row, row + n)), part.column("doc_id").fill_null(repeats.LAST), part.column("host"), pa.array(signed(digest)), lines], names)
            row += n


def _verdicts(side: str, carry: tuple[str, ...], min_words: int, min_left: float):
    names = ["doc_id", *carry, *(x.split()[0] for x in VERDICT.split(", "))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        listed = repeats.Side(side)
        for batch in batches:
            for part in slices(batch, limit=SLICE):
                shared = {i: set(lines.tolist()) for i, (lines, _, _) in listed.rows(part).items()}
                words = Words(part.column("text"))
                starts = (words.data & 0xC0) != 0x80  # of code points
                again, gone, left = zip(*(_left(t.as_buffer().to_pybytes(), shared.get(i, set())) for i, t in enumerate(part.column("text"))), strict=True)
                n, again, gone, twice = np.diff(words.bound), np.array(again), np.array(gone), repeated_words(words)
                base = (n < min_words) | (100 * twice > 20 * n)
                depleted = (gone > 0) & ((n - gone < min_words) | (n - gone < min_left * n))
                values = [n, _by_row(starts & words.solid, words.off), _by_row(SYMBOLS[words.data], words.off), again, twice, base, ~base & ~depleted, gone]
                text = pa.array(left, pa.binary()).cast(pa.string())
                row = listed.first + np.arange(part.num_rows)
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in ("doc_id", *carry)), *map(pa.array, values), text, pa.array(row)], names)

    return run


def judged(docs: DataFrame, host: str = "source", line_limit: int = 50, min_words: int = 10, min_left: float = 0.5, carry: tuple[str, ...] = ()) -> DataFrame:
    """Every row's doc_id, the carried columns, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    base_failed, kept, n_line_words (words of lines that too many documents of the host share), kept_text (the text
    without these lines) and row (its place in the input).

    A null text has no words and fails the base rules. Rows without a host are one host. Repeated rows are judged
    alike and keep a row each. An empty table gives no rows. Long texts and long lines are treated like any other.
    Carried columns may not be called like an output; the pipeline carries one struct.
    """
    spark = docs.sparkSession
    ship(spark)
    own = [host] if host in docs.columns and host not in ("doc_id", "text", *carry) else []
    given = F.coalesce(F.col(host).cast("string"), F.lit("")) if host in docs.columns else F.lit("")
    docs = repeats.stable(docs, [*own, *carry])
    place = scratch(spark, "quality")
    found = written(docs.select("doc_id", given.alias("host"), "text").mapInArrow(tidy(_hashed), LINES), "quality", place)
    lines = found.select("row", "doc", "host", "digest", F.explode("lines").alias("line"))
    shared = lines.select("host", "line", "digest").distinct().groupBy("host", "line").agg(F.count("*").alias("documents")).where(F.col("documents") > line_limit)
    few = scratch(spark, "shared-lines")
    shared = written(shared.select("host", "line"), "shared-lines", few)
    lost = lines.join(shared, ["host", "line"], "left_semi")
    side = repeats._to_side(lost.select("row", F.col("line").alias("s"), F.lit(0).alias("n"), "doc"), "lost-lines")
    removed(spark, place)
    removed(spark, few)
    fields = T.StructType([docs.schema["doc_id"], *(docs.schema[c] for c in carry), *T._parse_datatype_string(VERDICT).fields])
    return docs.select("doc_id", "text", *carry).mapInArrow(tidy(_verdicts(side, tuple(carry), min_words, min_left)), fields)
