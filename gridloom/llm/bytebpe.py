"""Byte-level BPE read from a tokenizers JSON file: pre-tokens by array code, pieces once per distinct pre-token.

The pre-token rule is the one the byte-level pre-tokeniser applies:
's|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+
"""

from __future__ import annotations

import json
from functools import lru_cache

import numpy as np
import pyarrow as pa

L, N, O, S = 0, 1, 2, 3
#: Distinct pre-tokens whose ids a worker keeps; beyond that it forgets and starts again.
KEPT = 100_000


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@lru_cache(1)
def classes() -> np.ndarray:
    """The class of each code point: letter, number, other or white space."""
    import regex

    points = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    out = np.full(0x110000, O, np.uint8)
    for kind, rule in ((L, r"\p{L}+"), (N, r"\p{N}+"), (S, r"\p{White_Space}+")):
        for m in regex.finditer(rule, points):
            a, b = ord(points[m.start()]), ord(points[m.end() - 1])
            out[a : b + 1] = kind
    out[0xD800:0xE000] = O
    return out


def unbyte() -> dict[str, int]:
    """The printable characters that stand for bytes in byte-level vocabularies."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class ByteBpe:
    """Ids of pre-tokens. Merges are applied by rank, which needs merges in the order of the ids they make."""

    def __init__(self, path: str):
        import tiktoken

        spec = json.loads(open(path, encoding="utf-8").read())
        back = unbyte()
        vocab = spec["model"]["vocab"]
        special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        ranks = {bytes(back[c] for c in k): v for k, v in vocab.items() if k not in special}
        made = [vocab["".join(m if isinstance(m, list) else m.split(" "))] for m in spec["model"]["merges"]]
        if made != sorted(made) or spec["model"].get("ignore_merges") or spec["normalizer"]:
            raise ValueError(f"{path}: not a byte-level BPE whose merges are in id order")
        self.special = special
        self.ranks = ranks
        self._bpe = tiktoken.Encoding("own", pat_str=r"[\s\S]+", mergeable_ranks=ranks, special_tokens={})  # a text is one pre-token
        self._ids: dict[bytes, list[int]] = {}

    def merged(self, piece: bytes) -> list[int]:
        """The ids of a pre-token that isn't a special string."""
        return self._bpe.encode_ordinary(piece.decode())

    def ids(self, piece: bytes) -> list[int]:
        got = self._ids.get(piece)
        if got is None:
            one = self.ranks.get(piece)
            got = [one] if one is not None else [self.special[s]] if (s := piece.decode("utf-8", "replace")) in self.special else self.merged(piece)
            if len(self._ids) >= KEPT:
                self._ids.clear()
            self._ids[piece] = got
        return got


@lru_cache(2)
def load(path: str) -> ByteBpe:
    return ByteBpe(path)


class PreTokens:
    """Pre-tokens of the rows of a text column, whole rows; special strings in a text stand alone, as by default."""

    def __init__(self, data: np.ndarray, off: np.ndarray, special: tuple[str, ...], keep: bool = False):
        """data, off: UTF-8 bytes and row offsets; keep: keep the code points, where each begins, and which are marks."""
        text = data.tobytes().decode("utf-8")
        c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        n = len(c)
        self.rows = len(off) - 1
        self.data = data
        if not n:
            self.start, self.bound = np.zeros(0, np.int64), np.zeros(self.rows + 1, np.int64)
            self.points, self.where, self.marks = c, np.zeros(1, np.int64), np.zeros(0, np.int64)
            return
        where = np.zeros(n + 1, np.int64)
        if n == len(data):
            where = np.arange(n + 1)
            first = off
        else:
            width = np.ones(n, np.int8)
            for least in (0x80, 0x800, 0x10000):
                width += c >= least
            np.cumsum(width, out=where[1:])
            first = np.searchsorted(where, off)
        edge = np.zeros(n + 1, bool)
        edge[first] = True
        alone = []
        for s in special:
            at = text.find(s)
            while at >= 0:
                if not edge[at + 1 : at + len(s)].any():
                    alone.append((at, at + len(s)))
                    at = text.find(s, at + len(s))
                else:
                    at = text.find(s, at + 1)
        for a, b in alone:
            edge[a] = edge[b] = True
        k = classes()[c]
        begin = np.empty(n, bool)
        begin[0] = True
        begin[1:] = (k[1:] != k[:-1]) | edge[1:n]
        start = begin.copy()
        after = np.flatnonzero(begin[1:] & (k[1:] != S) & (k[:-1] == S) & ~edge[1:n]) + 1  # a run after white space
        start[after - 1] = True
        start[after[c[after - 1] == 0x20]] = False
        quote = np.flatnonzero((c[:-1] == 0x27) & start[:-1] & begin[1:] & (k[1:] == L) & ~edge[1:n]) if n > 1 else np.zeros(0, int)
        quote = quote[begin[quote]]
        if len(quote):
            pad = np.concatenate([c, np.zeros(3, np.uint32)])
            inside = np.concatenate([(k == L) & ~edge[:n] & ~begin, np.zeros(3, bool)])  # goes on with the same letters
            one, two = pad[quote + 1], pad[quote + 2]
            short = np.isin(one, [ord(x) for x in "stmd"])
            long = ~short & inside[quote + 2] & (((one == ord("r")) | (one == ord("v"))) & (two == ord("e")) | (one == ord("l")) & (two == ord("l")))
            for at, size in ((quote[short], 2), (quote[long], 3)):
                start[at + 1] = False
                more = at + size
                start[more[inside[more]]] = True
        for a, b in alone:
            start[a:b] = False
            start[a] = True
        marks = np.flatnonzero(start)
        self.start = where[marks]
        if keep:
            self.points, self.where, self.marks = c, where, marks
        self.bound = np.searchsorted(self.start, off)  # pre-tokens of row r: bound[r]..bound[r+1]

    def encode(self) -> tuple[np.ndarray, pa.Array]:
        """(index of each pre-token, dictionary of distinct ones as binary)."""
        o = np.empty(len(self.start) + 1, np.int32)
        o[:-1] = self.start
        o[-1] = len(self.data)
        e = pa.BinaryArray.from_buffers(pa.binary(), len(self.start), [None, pa.py_buffer(o), pa.py_buffer(np.ascontiguousarray(self.data))]).dictionary_encode()
        return e.indices.to_numpy(zero_copy_only=False), e.dictionary


def token_ids(data: np.ndarray, off: np.ndarray, bpe: ByteBpe) -> tuple[np.ndarray, np.ndarray]:
    """(ids of all rows, bounds by row)."""
    pre = PreTokens(data, off, tuple(bpe.special))
    if not len(pre.start):
        return np.zeros(0, np.uint32), np.zeros(pre.rows + 1, np.int64)
    idx, words = pre.encode()
    lists = [bpe.ids(w) for w in words.to_pylist()]
    size = np.fromiter(map(len, lists), np.int64, len(lists))
    flat = np.fromiter((i for x in lists for i in x), np.uint32, int(size.sum()))
    base = np.concatenate([[0], np.cumsum(size)])
    count = size[idx]
    ends = np.concatenate([[0], np.cumsum(count)])
    take = np.arange(ends[-1]) + np.repeat(base[idx] - ends[:-1], count)
    return flat[take], ends[pre.bound]
