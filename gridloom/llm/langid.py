"""Language identification: script ranges narrow the candidates, Viterbi over per-word scores labels spans.

The model is a table of character n-gram log-probabilities by language, learned on a bounded sample. A word's score
for a language is its log-likelihood relative to the best candidate, at least FLOOR; languages that don't use the
word's script get FLOOR. The labels of a text's words are the best path where each change of language costs SWITCH.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridloom.llm.arrowtext import Words, slices, tidy
from gridloom.llm.session import id_and_text, ship

#: First and last code point of letters of each script.
SCRIPTS = {
    "latin": [(0x41, 0x5A), (0x61, 0x7A), (0xAA, 0xAA), (0xBA, 0xBA), (0xC0, 0xD6), (0xD8, 0xF6), (0xF8, 0x2AF), (0x1E00, 0x1EFF)],
    "greek": [(0x370, 0x3FF), (0x1F00, 0x1FFF)],
    "cyrillic": [(0x400, 0x52F)],
    "armenian": [(0x531, 0x587)],
    "hebrew": [(0x5D0, 0x5EA)],
    "arabic": [(0x620, 0x6D3), (0x750, 0x77F)],
    "devanagari": [(0x904, 0x97F)],
    "bengali": [(0x980, 0x9FF)],
    "tamil": [(0xB80, 0xBFF)],
    "thai": [(0xE01, 0xE4E)],
    "georgian": [(0x10A0, 0x10FF)],
    "kana": [(0x3041, 0x30FF)],
    "han": [(0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0x20000, 0x2FFFF)],
    "hangul": [(0xAC00, 0xD7A3), (0x1100, 0x11FF)],
}
OTHER = len(SCRIPTS) + 1  # letters of scripts that aren't listed
BITS = 17
FLOOR = -6.0
SWITCH = 12.0
#: Rows that the model is learned on, by language.
SAMPLE = 1500


def scripts() -> np.ndarray:
    """The script of each code point, 0 where it is no letter."""
    import regex

    points = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    out = np.zeros(0x110000, np.uint8)
    for m in regex.finditer(r"\p{L}+", points):
        out[ord(points[m.start()]) : ord(points[m.end() - 1]) + 1] = OTHER
    for i, spans in enumerate(SCRIPTS.values(), 1):
        for a, b in spans:
            part = out[a : b + 1]
            part[part > 0] = i
    return out


_SCRIPT: list[np.ndarray] = []


def grams(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(n-gram buckets, the word of each, the script of each word: 0 without a letter)."""
    if not _SCRIPT:
        _SCRIPT.append(scripts())
    c = np.frombuffer("".join(f" {w.lower()} " for w in words).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    size = np.fromiter((len(w.lower()) + 2 for w in words), np.int64, len(words))
    word = np.repeat(np.arange(len(words)), size)
    script = _SCRIPT[0][c.astype(np.int64)]
    letter = script > 0
    c = np.where(letter, c, np.uint64(32))  # only letters count
    of = np.zeros(len(words), np.int64)
    np.maximum.at(of, word[letter], script[letter].astype(np.int64))
    found, owner = [], []
    with np.errstate(over="ignore"):
        for n in (1, 2, 3):
            if len(c) < n:
                continue
            h = np.full(len(c) - n + 1, n, np.uint64)
            solid = np.zeros(len(h), bool)
            for k in range(n):
                h = (h * np.uint64(0x9E3779B97F4A7C15)) ^ c[k : len(c) - n + 1 + k]
                solid |= letter[k : len(c) - n + 1 + k]
            h = (h * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(64 - BITS)
            keep = solid & (word[: len(h)] == word[n - 1 :])
            found.append(h[keep].astype(np.int64))
            owner.append(word[: len(h)][keep])
    return np.concatenate(found) if found else np.zeros(0, np.int64), np.concatenate(owner) if owner else np.zeros(0, np.int64), of


class Model:
    """languages; table: n-gram log-probabilities by language; uses: whether a language uses a script."""

    def __init__(self, texts: list[str], labels: list[str]):
        self.languages = sorted(set(labels))
        count = np.zeros((len(self.languages), 1 << BITS), np.float64)
        seen = np.zeros((len(self.languages), OTHER + 1), np.float64)
        for i, lang in enumerate(self.languages):
            own = pa.array([t for t, x in zip(texts, labels, strict=True) if x == lang], pa.large_string())
            idx, words = Words(own).encode()
            listed = [w.decode("utf-8", "replace") for w in words.to_pylist()]
            times = np.bincount(idx, minlength=len(listed))
            g, w, s = grams(listed)
            count[i] = np.bincount(g, times[w], 1 << BITS)
            seen[i] = np.bincount(s, times, OTHER + 1)
        if self.languages:
            self.table = np.log((count + 0.1) / (count.sum(1, keepdims=True) + 0.1 * (1 << BITS))).T.astype(np.float32).copy()
            self.uses = seen >= 0.01 * np.maximum(seen[:, 1:].sum(1, keepdims=True), 1)

    def scores(self, words: list[str]) -> np.ndarray:
        """Of distinct words by language: 0 for the best candidate, at least FLOOR; all 0 for words without letters."""
        g, w, s = grams(words)
        out = np.stack([np.bincount(w, self.table[g, i], len(words)) for i in range(len(self.languages))], 1)
        can = self.uses[:, s].T  # word x language
        can |= ~can.any(1, keepdims=True)
        out = np.where(can, out, -np.inf)
        out = np.maximum(out - out.max(1, keepdims=True), FLOOR)
        out[s == 0] = 0
        return out, s > 0


def viterbi(scores: np.ndarray, bound: np.ndarray, switch: float = SWITCH) -> np.ndarray:
    """The best path over the words of each text (words bound[r]..bound[r+1]), all texts a step at a time; ties go to
    staying, then to the first language."""
    n, k = scores.shape
    size = np.diff(bound)
    order = np.argsort(-size, kind="stable")
    first, size = bound[:-1][order], size[order]
    active = len(size) - np.searchsorted(size[::-1], np.arange(int(size[0]) if len(size) else 0), "right")  # texts with more words than t
    best, change = np.zeros(n, np.int32), np.zeros((n, k), bool)
    path = np.zeros(n, np.int32)
    if not n:
        return path
    m = int(active[0])
    v = scores[first[:m]].astype(np.float64)
    for t in range(1, len(active)):
        m = int(active[t])
        now, at = v[:m], first[:m] + t
        top = now.argmax(1)
        moved = (now[np.arange(m), top] - switch)[:, None]
        best[at] = top
        change[at] = moved > now
        v[:m] = np.maximum(now, moved) + scores[at]
    state = np.zeros(len(size), np.int32)
    state[: len(v)] = v.argmax(1)
    for t in range(len(active) - 1, -1, -1):
        m = int(active[t])
        at = first[:m] + t
        here = state[:m]
        path[at] = here
        state[:m] = np.where(change[at, here], best[at], here)
    return path


def paths(scores: np.ndarray, bound: np.ndarray, switch: float = SWITCH) -> np.ndarray:
    """viterbi(), with the recursion for those texts alone whose best path may change: where no run of words gains more
    than a switch over the text's best single language, and none at an end more than half, that language is the path."""
    rows = len(bound) - 1
    size = np.diff(bound)
    total = np.concatenate([np.zeros((1, scores.shape[1])), np.cumsum(scores, 0)])
    best = (total[bound[1:]] - total[bound[:-1]]).argmax(1)
    path = np.repeat(best, size).astype(np.int32)
    row = np.repeat(np.arange(rows), size)
    some = np.flatnonzero(size)
    mixed = np.zeros(rows, bool)
    for k in range(scores.shape[1]):
        gain = scores[:, k] - scores[np.arange(len(path)), path]
        run = np.concatenate([[0.0], np.cumsum(gain)])
        drop = 4.0 * (1 + np.abs(gain).sum()) * row  # so that a text's values lie below those of the texts before
        low = np.minimum.accumulate(run[:-1] - drop)
        over = (run[1:] - drop - low) > switch
        mixed[row[over]] = True
        if len(some):
            mixed[some] |= np.maximum.reduceat(run[1:], bound[some]) - run[bound[some]] > switch / 2
            mixed[some] |= run[bound[some + 1]] - np.minimum.reduceat(run[:-1], bound[some]) > switch / 2
    pick = np.flatnonzero(mixed)
    if len(pick):
        words = mixed[row]
        path[words] = viterbi(scores[words], np.concatenate([[0], np.cumsum(size[pick])]), switch)
    return path


def spans(text: str, model: Model, switch: float = SWITCH) -> list[tuple[int, int, str]]:
    """(first word, end word, language) of a text."""
    w = text.split()
    if not w or not model.languages:
        return []
    p = viterbi(model.scores(w)[0], np.array([0, len(w)]), switch)
    cut = [0, *(np.flatnonzero(np.diff(p)) + 1).tolist(), len(p)]
    return [(a, b, model.languages[p[a]]) for a, b in zip(cut, cut[1:], strict=False)]


def held_out(doc_id: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def learned(docs: DataFrame, sample: int = SAMPLE) -> Model:
    """A model from rows with text, lang and doc_id that aren't held out: about `sample` rows of each language, whatever
    languages there are. Each language's share is a row that is broadcast, where its part of the model has 2^17 values."""
    rows = docs.where(F.col("doc_id").isNotNull() & F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out())
    share = rows.groupBy("lang").agg((F.lit(sample) / F.count("*")).alias("share"))
    picked = rows.join(F.broadcast(share), "lang").where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_003)) < F.col("share") * 1_000_003)
    got = picked.select("text", "lang").toArrow().to_pydict()
    return Model(got["text"], got["lang"])


def _predicted(packed: bytes, switch: float, carry: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: Model = pickle.loads(packed)
        k = len(model.languages)
        for batch in batches:
            for part in slices(batch, limit=3 << 20):
                n = part.num_rows
                words = Words(part.column("text"))
                label, score, mixed = ["und"] * n, np.zeros(n), np.zeros(n, np.int64)
                if len(words.start) and k:
                    idx, listed = words.encode()
                    by_word, letters = model.scores([w.decode("utf-8", "replace") for w in listed.to_pylist()])
                    s, has = by_word[idx], letters[idx]
                    path = paths(s, words.bound, switch)
                    votes = np.bincount(words.row[has] * k + path[has], minlength=n * k).reshape(n, k)
                    any_letter = votes.sum(1) > 0
                    best = votes.argmax(1)
                    score = np.where(any_letter, votes.max(1) / np.maximum(votes.sum(1), 1), 0.0)
                    label = [model.languages[b] if a else "und" for a, b in zip(any_letter.tolist(), best.tolist(), strict=True)]
                    change = np.flatnonzero((path[1:] != path[:-1]) & (words.row[1:] == words.row[:-1]))
                    mixed = np.bincount(words.row[change], minlength=n) + any_letter
                out = [part.column(c) for c in carry] + [pa.array(label, pa.string()), pa.array(score), pa.array(mixed)]
                yield pa.RecordBatch.from_arrays(out, [*carry, "lang_pred", "score", "n_spans"])

    return run


def identified(docs: DataFrame, model: Model | None = None, switch: float = SWITCH) -> DataFrame:
    """doc_id, held_out, lang_pred, score (share of the words with letters on the label's spans), n_spans of every row.

    `und` with score 0 for null texts, texts without a letter, and when nothing could be learned. Ties between languages
    go to the first by name. Repeated rows keep a row each; a null doc_id isn't held out and isn't learned from; an empty
    table gives no rows; other columns are ignored, whatever their names; a very long text is a slice of its own. The
    model, a table of 2^17 values for each language, goes to the executors by broadcast.
    """
    return _labelled(docs, id_and_text(docs).withColumn("held_out", held_out()), ["doc_id", "held_out"], model, switch)


def recognised(docs: DataFrame, least: float = 0.4, model: Model | None = None, switch: float = SWITCH) -> DataFrame:
    """The rows, with all their columns, whose language is not `und` and holds at least that share of the words.

    Columns go by their place, so that extra ones may have any name."""
    place = ["text" if c == "text" else f"c{i}" for i, c in enumerate(docs.columns)]
    rows = docs.toDF(*place).withColumn("text", F.coalesce("text", F.lit("")))  # no null text is kept
    out = _labelled(docs, rows, place, model, switch).where((F.col("lang_pred") != "und") & (F.col("score") >= least))
    return out.select(*place).toDF(*docs.columns)


def _labelled(docs: DataFrame, rows: DataFrame, carry: list[str], model: Model | None, switch: float) -> DataFrame:
    ship(docs.sparkSession)
    packed = docs.sparkSession.sparkContext.broadcast(pickle.dumps(model or learned(docs)))
    schema = T.StructType([*(rows.schema[c] for c in carry), *T._parse_datatype_string("lang_pred string, score double, n_spans long").fields])
    return rows.mapInArrow(tidy(lambda it: _predicted(packed.value, switch, carry)(it)), schema)
