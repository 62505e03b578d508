import hashlib
import random
from collections import Counter

import pytest

pytest.importorskip("public_tokenizers")
import public_tokenizers
import sentencepiece
from tokenizers import Tokenizer

from gridloom.llm import bytebpe
from gridloom.llm.alignment import Transducer, aligned

from .data import corpus, frame


def spelled():
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    back = bytebpe.unbyte()
    of_a = lambda i: bytes(back[c] for c in t.id_to_token(i))

    def of_b(i):
        p = sp.id_to_piece(i)
        return bytes([int(p[3:5], 16)]) if sp.is_byte(i) else p.replace("▁", " ").encode()

    return t, sp, of_a, of_b


def brute(rows):
    t, sp, of_a, of_b = spelled()
    docs, counts = [], Counter()
    for i, text in rows:
        want = (" " + text).encode() if text else b""
        a = [(x, of_a(x)) for x in (t.encode(" " + text, add_special_tokens=False).ids if text else [])]
        b = [(x, of_b(x)) for x in (sp.encode(text) if text else [])]
        if b"".join(x for _, x in a) != want or b"".join(x for _, x in b) != want:
            a = b = []
        spans = []
        for tokens in (a, b):
            at, out = 0, []
            for x, s in tokens:
                out.append((x, at, at + len(s)))
                at += len(s)
            spans.append(out)
        links, j0 = [], 0
        for x, s, e in spans[0]:
            while j0 < len(spans[1]) and spans[1][j0][2] <= s:
                j0 += 1
            j = j0
            while j < len(spans[1]) and spans[1][j][1] < e:
                links.append((x, spans[1][j][0]))
                j += 1
        both = sorted({e for *_, e in spans[0]} & {e for *_, e in spans[1]})
        groups, low = [], 0
        for end in both:
            groups.append("|".join(",".join(str(x) for x, s, e in side if low <= s and e <= end) for side in spans))
            low = end
        docs.append((i, len(a), len(b), groups, links))
        counts.update(links)
    best = Counter()
    for (_, y), n in counts.items():
        best[y] = max(best[y], n)
    out = []
    for i, n_a, n_b, groups, links in docs:
        sha = hashlib.sha256(";".join(groups).encode()).hexdigest() if groups else ""
        out.append((i, n_a, n_b, len(groups), len(links), sum(counts[x] == best[x[1]] for x in links), sum(counts[x] for x in links), sha))
    return out


ODD = [None, "", " ", "  x", "a\n\nb \n c", "x \n", "don't we'll 'S", "naïve 北京大学 こんにちは 🙂🙂", "a▁b", "▁", "<|endoftext|> </s> <0x41> <unk>", "\x00 \x1c\x85", "1234567 8", "tab\t\tx", "…—“”", "é" * 70, "   ", "  x"]


def test_as_by_brute_force(spark):
    r = random.Random(2)
    bits = ["the", " of", "ing", "\n", "\n\n", " ", "  ", "é", "ß", "'s", ".", ", ", "2024", "北", "🙂", "#", "tion", "\t", " "]
    texts = [*ODD, *corpus(3, 30), *("".join(r.choice(bits) for _ in range(r.randint(1, 60))) for _ in range(60))]
    ids = [None if i in (3, 4) else i // 2 for i in range(len(texts))]
    got = [tuple(x) for x in aligned(frame(spark, texts, 4, ids), slice_bytes=3000).collect()]
    assert sorted(got, key=str) == sorted(brute(list(zip(ids, texts, strict=True))), key=str)


def test_groups_as_texts(spark):
    rows = {r.doc_id: r for r in aligned(frame(spark, ["alignment of tokens", "a▁b"]), texts=True).collect()}
    t, sp, of_a, of_b = spelled()
    assert rows[0].groups_sha256 == hashlib.sha256(rows[0].groups.encode()).hexdigest() and rows[1].groups == ""
    a = b = b""
    for g in rows[0].groups.split(";"):
        x, y = ([int(i) for i in side.split(",")] for side in g.split("|"))
        a, b = a + b"".join(map(of_a, x)), b + b"".join(map(of_b, y))
        assert a == b
    assert a == b" alignment of tokens"


def test_transducer():
    t = Transducer(([b"ab", b"cde", b"f"], [b"a", b"bc", b"def", b"de"]))
    assert t.groups([0, 1, 2], [0, 1, 2]) == ([([0, 1, 2], [0, 1, 2])], [(0, 0), (0, 1), (1, 1), (1, 2), (2, 2)])
    assert t.groups([0, 1], [0, 1, 3]) == ([([0, 1], [0, 1, 3])], [(0, 0), (0, 1), (1, 1), (1, 3)])
    assert t.groups([0, 2], [0, 1]) is None and t.groups([0], [0]) is None and t.groups([0], [0, 1, 3]) is None and t.groups([], []) == ([], [])
    again = len(t.known)
    assert t.groups([0, 1, 2], [0, 1, 2]) and len(t.known) == again


def test_empty_and_clashing_columns(spark):
    df = frame(spark, ["a b"])
    assert aligned(df.limit(0)).collect() == []
    clash = df.selectExpr("doc_id", "text", "1 AS pair", "2 AS part", "3 AS n_links")
    assert [r.n_links for r in aligned(clash).collect()] == [r.n_links for r in aligned(df).collect()]


def test_a_very_long_text(spark):
    r = random.Random(4)
    texts = [" ".join(f"w{r.randint(0, 9999)}" for _ in range(800_000)), "ab" * 50_000]
    got = {x.doc_id: x for x in aligned(frame(spark, texts)).collect()}
    t, sp, _, _ = spelled()
    for i, text in enumerate(texts):
        assert (got[i].n_a, got[i].n_b) == (len(t.encode(" " + text, add_special_tokens=False).ids), len(sp.encode(text)))
