"""Repeated byte strings over a corpus: what a suffix array's adjacent prefixes of 200 bytes would show.

A difference cover samples suffixes so that any two equal strings have a sampled suffix at the same offset, then names
sampled prefixes and merges the others by them. A cover of period 133 samples 12 of 133 positions. Here a position is
sampled because it holds the least name of the 68-byte prefixes in some 200-byte string: equal strings still share
their sampled offset, which is all that naming and merging need, with 2 positions of 134. Names of sampled prefixes
that occur once drop out, longer names settle equal surroundings, and only the suffixes between differing surroundings
are merged by names of 200 bytes. See `repeats`.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from gridloom.llm.arrowtext import Rolling, U, raw
from gridloom.llm.repeats import Units, covered, repeated, sha256

#: A random 64-bit value for each byte, for each of two names.
BYTES = np.random.default_rng(424242).integers(1, 1 << 63, (2, 256), dtype=np.uint64)


def byte_units(width: int):
    block = width // 3 + 2

    def parse(col: pa.Array) -> Units:
        data, off = raw(col)
        h = (BYTES[0][data], BYTES[1][data])
        n = len(data)
        left = np.repeat(off[1:], np.diff(off)) - np.arange(n)
        sampled = left >= block
        key = np.zeros(n, U)
        if n >= block:
            at = np.arange(n - block + 1)
            key[: len(at)] = Rolling(h[0]).span(at, at + block)
        return Units(h, off, key, sampled, 0, width - block)

    return parse


def deduplicated_bytes(docs: DataFrame, width: int = 200, carry: tuple[str, ...] = (), slice_bytes: int = 2 << 20) -> DataFrame:
    """doc_id, the carried columns, n_bytes, n_removed, n_spans (maximal removed runs) and kept_sha256 of every row.

    A byte of the UTF-8 text goes if a string of `width` bytes over it also starts anywhere else, in the same text or
    another, judged on the input; strings lie within a text. Null text is empty; repeated rows repeat each other; an
    empty table gives no rows. Long texts are treated like any other. Carried columns may not be called like an output.
    """

    def finish(data: bytes, begin: np.ndarray, end: np.ndarray) -> tuple:
        if not len(begin):
            return len(data), 0, 0, sha256(data)
        gone = covered(begin, end + width - 1, len(data))
        runs = int(np.count_nonzero(gone[1:] & ~gone[:-1])) + int(gone[0])
        return len(data), int(gone.sum()), runs, sha256(np.frombuffer(data, np.uint8)[~gone].tobytes())

    return repeated(docs, byte_units(width), width, False, finish, "n_bytes long, n_removed long, n_spans long, kept_sha256 string", slice_bytes, carry)
