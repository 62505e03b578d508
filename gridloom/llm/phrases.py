"""Phrases whose words go together, by Suffix-sigma: one exchange of truncated suffixes counts phrases of all lengths.

1. A pass counts words by language (a row for each distinct word of a slice). Words that make up more than one of
   2 * tasks parts of all are the hot ones; there are at most 2 * tasks of them, since their shares add up to one.
2. Each place of a text starts a suffix of `most` words at most, within its piece. A task counts the distinct ones of a
   slice and deals them out by language and first word, packed and sorted. Suffixes that start with a hot word are dealt
   out by their second word too, by the third if that one is hot, and so on.
3. A task sorts the suffixes of a language and bucket in descending order. The prefixes that a suffix doesn't share with
   the one before end there: their counts are those of the run of suffixes that have them, for all lengths in one pass.
   Only prefixes of hot words alone can be spread over buckets; these are added up.
4. Frequent phrases are few rows: parts are joined to candidates, longer phrases to the ones in them.
Words travel as 64-bit names. The counts of pass 1 have both names and words, so two words of one name are found, and
raise. Counts are long, products are decimals of 38 digits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridloom.llm.arrowtext import U, Words, lowered, mixed, signed, slices, tidy
from gridloom.llm.jaccard import by_key, changes
from gridloom.llm.session import removed, scratch, ship, tasks, written

#: Bytes that end a piece, and all that end a word.
BREAK = np.zeros(256, bool)
BREAK[[*b".,;:!?", 0x0A, 0x0B, 0x0C, 0x0D]] = True
APART = BREAK.copy()
APART[[0x20, 0x09]] = True
#: In place of a name where a piece has ended.
END = ~U(0)


class Spoken:
    """The words of a slice: rows, pieces, names, and what they are called."""

    def __init__(self, col: pa.Array):
        w = Words(lowered(col), APART)
        self.row, self.bound = w.row, w.bound
        self.index, self.words = w.encode() if len(w.start) else (np.zeros(0, np.int64), pa.array([], pa.binary()))
        self.names = np.fromiter((xxhash.xxh3_64_intdigest(x) for x in self.words.to_pylist()), U, len(self.words))
        self.names[self.names == END] = 0  # then as any other word of that name
        breaks = np.cumsum(BREAK[w.data])
        self.piece = breaks[w.start] if len(w.start) else np.zeros(0, np.int64)

    def of(self, rows: np.ndarray) -> np.ndarray:
        """The places of the words of some rows; rows: whether each is meant."""
        return np.flatnonzero(rows[self.row])


def languages(part: pa.RecordBatch) -> list[tuple[str, np.ndarray]]:
    """The languages of a slice, and which rows have each."""
    e = part.column("lang").dictionary_encode()
    index = e.indices.to_numpy(zero_copy_only=False)
    return [(x, index == k) for k, x in enumerate(e.dictionary.to_pylist())]


def _words(slice_bytes: int):
    """(lang, name, word, times) of the distinct words of each slice."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, limit=slice_bytes):
                s = Spoken(part.column("text"))
                for lang, rows in languages(part):
                    times = np.bincount(s.index[s.of(rows)], minlength=len(s.words))
                    some = np.flatnonzero(times)
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(some), pa.string()), pa.array(signed(s.names[some])), s.words.take(pa.array(some)).cast(pa.string()), pa.array(times[some])], ["lang", "name", "word", "times"])

    return run


def suffixes(names: np.ndarray, row: np.ndarray, piece: np.ndarray, most: int, end: int | np.uint64 = END) -> np.ndarray:
    """The names of the words from each place on, `most` of them at most, then `end`."""
    n = len(names)
    out = np.full((n, most), end, U)
    out[:, 0] = names
    for k in range(1, min(most, n)):
        same = (row[k:] == row[:-k]) & (piece[k:] == piece[:-k])
        out[:-k, k][same] = names[k:][same]
    return out


def sorted_suffixes(rows: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct suffixes in order of their names, and how many times each occurs."""
    order = np.lexsort(rows.T[::-1])
    rows, times = rows[order], times[order]
    first = np.flatnonzero(np.concatenate([[True], (rows[1:] != rows[:-1]).any(1)])) if len(rows) else np.zeros(0, np.int64)
    return rows[first], np.add.reduceat(times, first) if len(first) else times[:0]


def distinct_suffixes(s: Spoken, at: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """sorted_suffixes() of some words; where places of names in their order fit one number, by that number."""
    order = np.argsort(s.names)
    names, rank = np.append(s.names[order], END), np.empty(len(order), U)
    rank[order] = np.arange(len(order), dtype=U)
    bits = len(order).bit_length()
    rows = suffixes(rank[s.index[at]], s.row[at], s.piece[at], most, len(order))
    if most * bits > 64:
        return sorted_suffixes(names[rows], np.ones(len(at), np.int64))
    key = np.zeros(len(at), U)
    for column in rows.T:
        key = key << U(bits) | column
    key.sort()
    first = np.flatnonzero(changes(key))
    times, key, low = np.diff(np.append(first, len(key))), key[first], U((1 << bits) - 1)
    return np.stack([names[key >> U(bits * k) & low] for k in range(most - 1, -1, -1)], 1), times


def pack(rows: np.ndarray, times: np.ndarray) -> bytes:
    """Sorted suffixes: of each only the names from the first on that differs from the one before."""
    n, most = rows.shape
    new = np.ones((n, most), bool)
    new[1:] = np.logical_or.accumulate(rows[1:] != rows[:-1], 1)
    wide = times > 255
    shared = (most - new.sum(1)).astype("u1")
    live = new & (rows != END)
    ended = (new & ~live).sum(1).astype("u1")
    return np.array([n, int(wide.sum())], "<i8").tobytes() + rows[live].astype("<u8").tobytes() + times[wide].astype("<i8").tobytes() + np.where(wide, 0, times).astype("u1").tobytes() + (shared << 4 | ended).tobytes()


def unpack(data: bytes, most: int) -> tuple[np.ndarray, np.ndarray]:
    n, many = np.frombuffer(data, "<i8", 2).tolist()
    flags = np.frombuffer(data, "u1", n, len(data) - n)
    times = np.frombuffer(data, "u1", n, len(data) - 2 * n).astype(np.int64)
    shared, ended = (flags >> 4).astype(np.int64), (flags & 15).astype(np.int64)
    size = most - shared - ended
    at = 16 + 8 * int(size.sum())
    times[times == 0] = np.frombuffer(data, "<i8", many, at)
    flat = np.frombuffer(data, "<u8", int(size.sum()), 16)
    out = np.full((n, most), END, U)
    place = np.arange(most)
    out[(place >= shared[:, None]) & (place < (shared + size)[:, None])] = flat
    rows = np.arange(n)
    for k in range(most):  # a shared name is that of the last row that has its own
        out[:, k] = out[np.maximum.accumulate(np.where(shared <= k, rows, 0)), k]
    return out, times


def dealt(rows: np.ndarray, hot: np.ndarray, buckets: int) -> np.ndarray:
    """The bucket of each suffix: by its first word, and by the next as long as all before are hot."""
    with np.errstate(over="ignore"):
        key, more = np.zeros(len(rows), U), np.ones(len(rows), bool)
        for column in rows.T:
            key[more] = mixed(key[more] * U(0x9E3779B97F4A7C15) + column[more] + U(1))
            more &= np.isin(column, hot)
    return ((key >> U(32)) * U(buckets) >> U(32)).astype(np.int64)


def _suffixes(most: int, hot: dict[str, np.ndarray], buckets: int, slice_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, limit=slice_bytes):
                s = Spoken(part.column("text"))
                for lang, rows in languages(part):
                    at = s.of(rows)
                    if not len(at):
                        continue
                    found, times = distinct_suffixes(s, at, most)
                    bucket = dealt(found, hot.get(lang, np.zeros(0, U)), buckets)
                    order = np.argsort(bucket, kind="stable")
                    bucket, found, times = bucket[order], found[order], times[order]
                    cut = np.flatnonzero(np.diff(bucket, prepend=-1))
                    packed = [pack(found[a:b], times[a:b]) for a, b in zip(cut.tolist(), [*cut[1:].tolist(), len(bucket)], strict=True)]
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(cut), pa.string()), pa.array(bucket[cut].astype(np.int32)), pa.array(packed, pa.binary())], ["lang", "bucket", "packed"])

    return run


def prefixes(rows: np.ndarray, times: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(length, the first row of each prefix of that length, its count) of sorted suffixes."""
    upto = np.concatenate([[0], np.cumsum(times)])
    new = np.ones(len(rows), bool)
    for k in range(rows.shape[1]):
        differs = np.ones(len(rows), bool)
        differs[1:] = rows[1:, k] != rows[:-1, k]
        new = differs if not k else new | differs
        first = np.flatnonzero(new)
        count = np.diff(upto[np.append(first, len(rows))])
        live = rows[first, k] != END
        yield k + 1, first[live], count[live]


def _counted(most: int, least: int, hot: dict[str, np.ndarray]):
    """Rows (lang, bucket, packed), a bucket together, to (lang, phrase, size, times, part): phrases of `least`
    occurrences or more, and parts of counts of phrases that may be in other buckets as well."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (lang, _), group in by_key(batches, 2, ["packed"]):
            got = [unpack(x, most) for (x,) in group]
            rows, times = sorted_suffixes(np.concatenate([r for r, _ in got]), np.concatenate([t for _, t in got]))
            rows, times = rows[::-1], times[::-1]
            own = hot.get(lang, np.zeros(0, U))
            spread = np.ones(len(rows), bool)
            for k, first, count in prefixes(rows, times):
                spread &= np.isin(rows[:, k - 1], own)
                part = spread[first] & (k < most)
                keep = part | (count >= least)
                first, count, part = first[keep], count[keep], part[keep]
                n = len(first)
                flat = rows[first, :k].astype(">u8").tobytes()
                phrase = pa.BinaryArray.from_buffers(pa.binary(), n, [None, pa.py_buffer(np.arange(0, 8 * k * n + 1, 8 * k, dtype=np.int32)), pa.py_buffer(flat)])
                yield pa.RecordBatch.from_arrays([pa.array([lang] * n, pa.string()), phrase, pa.array([k] * n, pa.int32()), pa.array(count), pa.array(part)], ["lang", "phrase", "size", "times", "part"])

    return run


COUNTS = "lang string, phrase binary, size int, times long, part boolean"


class Mined:
    """The steps over one input."""

    def __init__(self, docs: DataFrame, longest: int, least: int, slice_bytes: int):
        self.spark = docs.sparkSession
        ship(self.spark)
        self.docs = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), F.coalesce("text", F.lit("")).alias("text"))
        self.longest, self.least, self.slice_bytes = longest, least, slice_bytes
        self.n = tasks(self.spark)
        self.made: list[str] = []

    def written(self, df: DataFrame, name: str) -> DataFrame:
        self.made.append(scratch(self.spark, name))
        return written(df, name, self.made[-1])

    def words(self) -> DataFrame:
        """(lang, name, word, times) of all words."""
        rows = self.docs.mapInArrow(tidy(_words(self.slice_bytes)), "lang string, name long, word string, times long")
        rows = rows.repartition(self.n, "name").groupBy("name", "lang", "word").agg(F.sum("times").alias("times"))
        words = self.written(rows, "words")
        if not words.groupBy("name", "lang").count().where("count > 1").isEmpty():
            raise RuntimeError("two words have the same 64-bit name")
        return words

    def hot(self, words: DataFrame) -> dict[str, np.ndarray]:
        """The names of words that make up more than one of 2 * tasks parts of all words; there are 2 * tasks at most."""
        total = words.agg(F.sum("times")).first()[0] or 0
        out: dict[str, list[int]] = {}
        for r in words.where(F.col("times") * (2 * self.n) > total).select("lang", "name").collect():
            out.setdefault(r.lang, []).append(r.name)
        return {k: np.array(v, np.int64).view(U) for k, v in out.items()}

    def counts(self, hot: dict[str, np.ndarray]) -> DataFrame:
        """(lang, phrase, size, times) of the phrases of up to `longest` words with `least` occurrences; a phrase is the
        names of its words."""
        rows = self.docs.mapInArrow(tidy(_suffixes(self.longest, hot, 4 * self.n, self.slice_bytes)), "lang string, bucket int, packed binary")
        rows = rows.repartition(self.n, "lang", "bucket").sortWithinPartitions("lang", "bucket")
        found = self.written(rows.mapInArrow(tidy(_counted(self.longest, self.least, hot)), COUNTS), "prefixes")
        spread = found.where("part").groupBy("lang", "phrase", "size").agg(F.sum("times").alias("times")).where(F.col("times") >= self.least)
        return self.written(found.where("not part").drop("part").unionByName(spread), "counts")

    def scored(self, counts: DataFrame, share: int) -> DataFrame:
        """(lang, phrase, size, a, l, r, score) of the candidates that no longer one drops."""
        part = lambda a, n: F.substring("phrase", a, n)
        known = counts.select("lang", "phrase", "times")
        cuts = counts.where("size > 1").withColumnRenamed("times", "a").withColumn("k", F.explode(F.expr("sequence(1, size - 1)")))
        cuts = cuts.withColumn("left", part(F.lit(1), 8 * F.col("k"))).withColumn("right", part(8 * F.col("k") + 1, 8 * (F.col("size") - F.col("k"))))
        for side in ("left", "right"):
            cuts = cuts.join(known.select("lang", F.col("phrase").alias(side), F.col("times").alias(side[0])), ["lang", side])
        a, l, r = (F.col(c).cast("decimal(14,0)") for c in ("a", "l", "r"))
        cuts = cuts.withColumns({"over": a * a * F.lit(1_000_000).cast("decimal(7,0)"), "under": l * r}).withColumn("score", F.expr("over div under"))
        best = cuts.groupBy("lang", "phrase", "size", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("x")).select("lang", "phrase", "size", "a", "x.l", "x.r", "x.score")
        longer = counts.where("size > 2").withColumn("phrase", F.explode(F.array(part(F.lit(1), 8 * (F.col("size") - 1)), part(F.lit(9), 8 * (F.col("size") - 1)))))
        longer = longer.groupBy("lang", "phrase").agg(F.max("times").alias("within"))
        out = best.join(longer, ["lang", "phrase"], "left")
        return self.written(out.where(F.col("within").isNull() | (100 * F.col("within") < share * F.col("a"))).drop("within"), "scored")

    def first(self, rows: DataFrame, top: int, *order: F.Column) -> DataFrame:
        """The first rows of each language, and those that tie with the last: of shares of the rows, of shares of what
        these leave, and of the rest, so that no task ranks more than about sqrt(tasks) * top rows of a language."""
        for shares in (self.n, max(1, round(self.n**0.5)), 1):
            salt = F.pmod(F.xxhash64("phrase"), F.lit(shares))
            rows = rows.withColumn("place", F.rank().over(Window.partitionBy("lang", salt).orderBy(*order))).where(F.col("place") <= top).drop("place")
        return rows


def collocations(docs: DataFrame, longest: int = 3, least: int = 10, share: int = 50, top: int = 2000, slice_bytes: int = 5 << 20) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the `top` phrases of each language whose words go together best.

    Texts in ASCII lower case are split at `.,;:!?` and line ends into pieces, these at spaces and tabs into words; all
    counts are by lang (null: `und`). n: all words. Candidates: phrases of 2 to `longest` words that occur a >= `least`
    times in pieces. Cut after its first k words a phrase has parts that occur l and r times, and the score
    floor(1000000 * a * a / (l * r)); its lowest counts, of equal ones that of the smallest k. A candidate goes if its words
    are in a longer one that occurs at least `share` % as often. The order is score and a descending, then phrase.
    Null and empty texts have no words; repeated rows count each; an empty table gives no rows; other columns are
    ignored, whatever their names, and so is doc_id; a very long text is a slice of its own. A word of several megabytes
    is a word like others.
    """
    if not 2 <= longest <= 15:
        raise ValueError("longest: 2 to 15 words")
    m = Mined(docs, longest, least, slice_bytes)
    words = m.words()
    hot = m.hot(words)
    rows = m.scored(m.counts(hot), share)
    rows = m.first(rows, top, F.desc("score"), F.desc("a"))
    # the phrases' words: each name of what is left, joined to its word
    named = rows.withColumn("names", F.expr("transform(sequence(0, size - 1), i -> substring(phrase, 8 * i + 1, 8))"))
    named = named.select("*", F.posexplode("names").alias("at", "one")).withColumn("name", F.expr("conv(hex(one), 16, -10)").cast("long"))
    named = named.join(words.where(F.col("times") >= least).select("lang", "name", "word"), ["lang", "name"])
    key = ["lang", "phrase", "a", "l", "r", "score"]
    spelled = named.groupBy(*key).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("at", "word"))), lambda x: x.word), " ").alias("text"))
    total = words.groupBy("lang").agg(F.sum("times").alias("n"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "text"))
    out = spelled.withColumn("rank", rank.cast("long")).where(F.col("rank") <= top).join(total, "lang")
    last = scratch(m.spark, "collocations")
    out = written(out.select("lang", "rank", F.col("text").alias("phrase"), "a", "l", "r", "n", "score"), "collocations", last)
    for path in m.made:
        removed(m.spark, path)
    return out
