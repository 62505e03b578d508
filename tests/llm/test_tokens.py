import random
import zlib
from collections import defaultdict

import numpy as np
import pytest

pytest.importorskip("public_tokenizers")
import public_tokenizers
from tokenizers import Tokenizer

from gridloom.llm import bytebpe
from gridloom.llm.packing import pack, packed
from gridloom.llm.tokencounts import token_counts

PATH = public_tokenizers.path("byte_bpe_50k.json")
TOK = Tokenizer.from_file(PATH)
ODD = ["", " ", "\n", "a  b", "it's we'll I'm 'tis don't 's's 'llama x'rex '' '", "<|endoftext|>", "a<|endoftext|> <|endoftext|>b", "café naïve 中文 \U0001f600\U0001f600 x", "  \n\n  x\t\ty\r\n", "1234 5,6 $7.8", "  x  y　", "a" * 5000, "word " * 4000, "\x1c\x1d a\x85b", "!'s 's ''s \n's", "<|endoftext|", "we've'd they'RE o'll", " 's", "'ré 'l'l"]


def texts(n=400, seed=1):
    r = random.Random(seed)
    parts = ["'s", "'", " ", "  ", "\n", "the", "Thé", "9", "12", ".", "!?", "ß", "\t", "'ll", "'re", "ll", "<|endoftext|>", "中", " ", "\U0001f600"]
    return ODD + ["".join(r.choice(parts) for _ in range(r.randint(0, 40))) for _ in range(n)]


def test_ids_equal_the_librarys():
    ts = texts()
    data = "".join(ts).encode()
    off = np.concatenate([[0], np.cumsum([len(t.encode()) for t in ts])])
    ids, bound = bytebpe.token_ids(np.frombuffer(data, np.uint8), off, bytebpe.load(PATH))
    for i, t in enumerate(ts):
        assert ids[bound[i] : bound[i + 1]].tolist() == TOK.encode(t, add_special_tokens=False).ids, repr(t)


def frame(spark, ts):
    return spark.createDataFrame([(i, t, "x", None) for i, t in enumerate(ts)], "doc_id long, text string, block string, piece int").repartition(3)


def test_counts(spark):
    ts = [*texts(60), None]
    df = frame(spark, ts)
    got = {r.doc_id: r for r in token_counts(df.unionByName(df.limit(0)), block_bytes=2000).collect()}
    assert len(got) == len(ts)
    for i, t in enumerate(ts):
        n = len(TOK.encode(t or "", add_special_tokens=False).ids)
        assert (got[i].n_bytes, got[i].n_tokens, got[i].over_limit) == (len((t or "").encode()), n, n > 512), repr(t)
    assert token_counts(df.limit(0)).collect() == []
    twice = spark.createDataFrame([(None, "a b"), (None, "a b")], "doc_id long, text string")
    assert [tuple(r) for r in token_counts(twice).collect()] == [(None, 3, 2, False)] * 2


def test_packing(spark):
    ts = [*texts(150), None]
    rows = packed(frame(spark, ts), block_bytes=30_000).collect()
    docs, seqs = defaultdict(list), defaultdict(list)
    for r in rows:
        docs[r.doc_id].append(r)
        seqs[r.sequence_id].append(r)
    for i, t in enumerate(ts):
        ids = np.array([*TOK.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        at = 0
        for r in sorted(docs[i], key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids) and r.length > 0
            assert r.ids_crc32 == zlib.crc32(ids[at : at + r.length].tobytes())
            at += r.length
        assert at == len(ids)
    for pieces in seqs.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 1024 and (at == 1024 or at & (at - 1) == 0)
    assert packed(frame(spark, ts).limit(0)).collect() == []


def plain_pack(sizes, capacity, linear=1.0, quadratic=1.0 / 1024):
    """The same packing with a look at every open sequence."""
    out, rest, sequence = [], [], 0
    for d, n in enumerate(sizes):
        for start in range(0, n - capacity + 1, capacity):
            out.append((d, start, capacity, sequence, 0))
            sequence += 1
        if n % capacity:
            rest.append((d, n - n % capacity, n % capacity))
    full, tail = divmod(sum(n for *_, n in rest), capacity)
    rooms = [capacity] * full + [1 << b for b in range(capacity.bit_length(), -1, -1) if tail >> b & 1]
    used, cost = [0] * len(rooms), [0.0] * len(rooms)
    for d, start, n in sorted(rest, key=lambda x: (-x[2], x[0])):
        while n:
            open_ = [s for s in range(len(rooms)) if used[s] < rooms[s]]
            s = min([s for s in open_ if rooms[s] - used[s] >= n] or open_, key=lambda s: (cost[s], s))
            k = min(n, rooms[s] - used[s])
            out.append((d, start, k, sequence + s, used[s]))
            used[s] += k
            cost[s] += linear * k + quadratic * k * k
            start, n = start + k, n - k
    return out


def test_pack_takes_the_cheapest_of_all_open_sequences():
    r = np.random.default_rng(8)
    for capacity in (16, 64):
        for _ in range(20):
            sizes = r.integers(1, 3 * capacity, r.integers(0, 60))
            assert pack(sizes, capacity) == plain_pack(sizes.tolist(), capacity)
    sizes = r.integers(1, 400, 600)
    cost = {}
    for _, _, n, s, _ in pack(sizes, 1024):
        cost[s] = cost.get(s, 0) + n + n * n / 1024
    whole = [cost[s] for s in range(int(sizes.sum()) // 1024)]
    assert max(whole) < 1.25 * min(whole)
