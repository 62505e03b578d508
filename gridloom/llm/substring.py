"""Substring deduplication by recompression: words that a smaller document already has, in runs of 50 or more, go.

Recompression names the words of all texts alike, by hashes, in rounds: a round of runs, then rounds of pairs. In a
round of pairs, a bit of its name makes each symbol a left or a right one, and a left symbol joins a right one that
follows it; names depend on what they stand for alone, so they are global without any exchange. Lengths are bounded,
so whether a symbol begins at a word depends on the REACH words to either side: equal stretches have the same interior
symbols. The starts of the symbols of the last round, with their surroundings, are the samples that `repeats` groups
over the corpus; symbols that several documents share reveal long repeats, and names of whole windows verify them.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from gridloom.llm.arrowtext import Rolling, U, Words, mixed
from gridloom.llm.repeats import Units, covered, repeated, sha256

#: Most words of a symbol after each round of pairs; a run joins two words.
ROUNDS = (3, 5, 7, 8)
#: Words to either side that decide whether a symbol begins: 2 for runs, then the longest symbol before each round.
REACH = 2 + 2 + sum(ROUNDS[:-1])


def recompressed(name: np.ndarray, text: np.ndarray) -> np.ndarray:
    """The first words of the symbols after the last round; name: of each word; text: which text it is in."""
    start = np.arange(len(name))
    size = np.ones(len(name), np.int64)

    def joined(at: np.ndarray, salt: int) -> None:
        nonlocal name, start, size
        with np.errstate(over="ignore"):
            made = mixed(name[at] * U(0x9FB21C651E98DF25) ^ name[at + 1] + U(salt))
        name, size = name.copy(), size.copy()
        name[at] = made
        size[at] += size[at + 1]
        keep = np.ones(len(name), bool)
        keep[at + 1] = False
        name, start, size = name[keep], start[keep], size[keep]

    if len(name) > 1:
        same = (name[1:] == name[:-1]) & (text[start[1:]] == text[start[:-1]])
        pad = np.concatenate([[False], same, [False]])
        joined(np.flatnonzero(same & ~pad[:-2] & ~pad[2:]), 1)
    for k, most in enumerate(ROUNDS):
        if len(name) < 2:
            break
        right = (name >> U(5 + 7 * k)) & U(1) == 1
        pair = ~right[:-1] & right[1:] & (size[:-1] + size[1:] <= most) & (text[start[1:]] == text[start[:-1]])
        joined(np.flatnonzero(pair), 2 + k)
    return start


def word_units(width: int):
    def parse(col: pa.Array) -> Units:
        w = Words(col)
        h = w.hashes((0, 1))
        n = len(w.start)
        at = recompressed(h[0], w.row)
        at = at[(at - REACH >= w.bound[w.row[at]]) & (at + REACH <= w.bound[w.row[at] + 1])]
        key = np.zeros(n, U)
        key[at] = Rolling(h[0]).span(at - REACH, at + REACH)
        sampled = np.zeros(n, bool)
        sampled[at] = True
        return Units((h[0], h[1]), w.bound, key, sampled, REACH, width - REACH)

    return parse


def without_words(data: bytes, gone: np.ndarray) -> bytes:
    """The text without the words that are gone; white space stays after words that stay."""
    d = np.frombuffer(data, np.uint8)
    w = Words(pa.array([data], pa.binary()))
    stop = np.append(w.start[1:], len(d))
    keep = np.ones(len(d), bool)
    for a, b in zip(w.start[gone].tolist(), stop[gone].tolist(), strict=True):
        keep[a:b] = False
    return d[keep].tobytes()


def deduplicated(docs: DataFrame, width: int = 50, carry: tuple[str, ...] = (), slice_bytes: int = 5 << 20) -> DataFrame:
    """doc_id, the carried columns, n_words, n_removed, kept_sha256 (of the kept words joined by spaces) and kept_text
    (the text without the removed words) of every row.

    A word goes if one of the windows of `width` words over it also starts in a document with a smaller doc_id, judged
    on the input. Of rows with equal doc_ids none is the smaller; a null doc_id comes after all others. A null or empty
    text has no words. An empty table gives no rows. Long texts are treated like any other. Carried columns may not be
    called like an output; the pipeline carries one struct. width: at least 2 * REACH + ROUNDS[-1] - 1.
    """
    if width < 2 * REACH + ROUNDS[-1] - 1:
        raise ValueError(f"width must be at least {2 * REACH + ROUNDS[-1] - 1}")

    def finish(data: bytes, begin: np.ndarray, end: np.ndarray) -> tuple:
        words = data.split()
        if not len(begin):
            return len(words), 0, sha256(b" ".join(words)), data.decode()
        gone = covered(begin, end + width - 1, len(words))
        kept = [w for w, g in zip(words, gone.tolist(), strict=True) if not g]
        return len(words), int(gone.sum()), sha256(b" ".join(kept)), without_words(data, gone).decode()

    return repeated(docs, word_units(width), width, True, finish, "n_words long, n_removed long, kept_sha256 string, kept_text string", slice_bytes, carry)
