"""Toxicity behind disguises: noisy-channel restoring, then a lexical score.

*Language model.*  Letter trigrams are counted over the whole texts of all documents; tasks hand on
their sums by trigram, a table bounded by the alphabet.  Trigrams of the features that labelled
toxic text has learned are mixed in, so that a lattice that can spell one is read so.

*Channel.*  A candidate is a run of single characters set apart, a word with look-alike digits or
signs among its letters, or a word with a letter three times or more in a row.  It becomes a
lattice: each character may stand for itself or a letter it looks like, marks between single
characters vanish, and a run of a letter may shrink to two or one; of a longer run than
``STRETCH`` no more is read.  Candidates may have any length.  Viterbi decoding under the
trigram model picks the cheapest reading, which replaces the candidate.

*Score.*  Features are words and word beginnings.  Their document frequencies in toxic and other
labelled text give log odds; a logistic curve over the strongest and the number of such words
gives the score.  Fitting takes a bounded sample of labelled rows: the ``PER_CLASS`` rows of each
class that come first by a hash, texts of over ``LONGEST`` bytes aside; of near copies among them (by
bottom hashes of their shingles, one row against another) the first counts.  Whole texts are scored.

Null and empty texts have no words and get the score of none.  Repeated label rows count once.
Without toxic labelled rows nothing is learned and every score is the share of toxic rows.
"""

from __future__ import annotations

import math
import os.path
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .compress_quality import labelled_sample, logistic, sigmoid

PER_CLASS, LONGEST = 4_000, 16_384
#: Lengths of word beginnings, rows and share of toxic rows that a feature needs, odds it needs, features kept at most.
BEGINNINGS, LEAST_ROWS, LEAST_SHARE, LEAST_ODDS, FEATURES = (4, 5, 6), 3, 0.015, 20.0, 20_000
#: Shingles of so many words, of which a row's so many least hashes tell copies, if so many are those of one earlier row.
COPY_WORDS, COPY_HASHES, COPY_SHARED = 3, 24, 3
#: Share of the feature trigrams in the mixed language model.
MIX = 0.3

#: Letters that a character may stand for (fixed values of common usage).
LOOKS_LIKE = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "€": "e", "£": "l", "*": "aeiou", "#": "h",
}
#: Costs, in nats: a look-alike, an unread look-alike, a dropped repeat, a dropped mark.
SWAP, KEEP, SHRINK, DROP = 0.7, 9.0, 0.3, 0.2
#: The first repeat of a letter is dropped less readily: many words have double letters.
SHRINK_DOUBLE = 2.0

LETTER = r"[^\W\d_]"
_SIGN = r"[0-9@$!|+€£*#]"
APART = re.compile(rf"(?<![^\s])(?:{LETTER}|{_SIGN})(?:[ ._\-*]+(?:{LETTER}|{_SIGN})){{2,}}(?![^\s.,;:?!])")
AMONG = re.compile(rf"{LETTER}+{_SIGN}+{LETTER}(?:{LETTER}|{_SIGN})*|(?<![^\W_]){_SIGN}+{LETTER}(?:{LETTER}|{_SIGN})*|{LETTER}+{_SIGN}{{1,2}}(?![^\s.,;:?!])")
AGAIN = re.compile(rf"\w*?({LETTER})\1\1\w*", re.IGNORECASE)
WORDS = re.compile(rf"{LETTER}+")
#: Repeats of a character that the lattice keeps of a run; longer candidates' readings aren't cached; characters between commits.
STRETCH, LONGEST_CACHED, COMMIT = 4, 64, 64
RUN = re.compile(rf"(.)\1{{{STRETCH},}}", re.DOTALL)

#: Lower-case letters below U+0180 have a number from 1; all else is the word's edge, 0.
ALPHABET = [chr(c) for c in range(0x180) if chr(c).isalpha() and chr(c) == chr(c).lower()]
SIZE = 128
_NUMBER = {c: k + 1 for k, c in enumerate(ALPHABET[: SIZE - 1])}
_OF_CODE = np.zeros(0x110000, np.int64)
_OF_CODE[[ord(c) for c in _NUMBER]] = list(_NUMBER.values())


def _trigrams(texts: list[str]) -> np.ndarray:
    codes = _OF_CODE[np.frombuffer(("  " + "  ".join(texts).lower() + " ").encode("utf-32-le"), np.uint32)]
    at = (codes[:-2] * SIZE + codes[1:-1]) * SIZE + codes[2:]
    return np.bincount(at, minlength=SIZE**3)


def letter_trigrams(docs: DataFrame, text: str = "text") -> DataFrame:
    """(gram, n) over all texts; SIZE**3 rows at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(SIZE**3, np.int64)
        for batch in common.slices(batches, text, 1_000_000):
            total += _trigrams([t for t in batch.column(text).to_pylist() if t])
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"gram": pa.array(at.astype(np.int32)), "n": pa.array(total[at])})

    return docs.select(text).mapInArrow(run, "gram int, n long").groupBy("gram").agg(F.sum("n").alias("n"))


def _conditional(counts: np.ndarray) -> np.ndarray:
    """P(c | a b), smoothed by P(c | b)."""
    cube = counts.reshape(SIZE, SIZE, SIZE).astype(float)
    two = cube.sum(0) + 0.05
    two /= two.sum(1, keepdims=True)
    return (cube + 2.0 * two[None]) / (cube.sum(2, keepdims=True) + 2.0)


_CODES = np.zeros(0x110000, np.uint8)  # 1 letter, 2 sign, 4 mark between single characters, 8 white space
_CODES[0x3001:] = 1
_LOWER = np.arange(0x110000, dtype=np.uint32)
for _c in range(0x20000):
    if _c <= 0x3000:
        _CODES[_c] = (1 if re.fullmatch(LETTER, chr(_c)) else 0) + (4 if chr(_c) in " ._-*" else 0) + (8 if chr(_c).isspace() else 0)
    _LOWER[_c] = ord(chr(_c).lower()[0])
for _c in LOOKS_LIKE:
    _CODES[ord(_c)] |= 2


def _suspects(texts: list[str]) -> tuple[list[int], list[int], list[int]]:
    """The texts that can hold a candidate of each kind: all that do, and few others.

    APART wants a character that a mark follows; after the first marks another such character, unless a ``*``,
    which is both a mark and a character, is among them.
    """
    joined = "\n\n\n" + "\n\n\n".join(texts) + "\n\n\n"
    codes = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
    starts = np.cumsum([3, *[len(t) + 3 for t in texts]])[:-1]
    kind = _CODES[codes]
    letter, sign, mark, space = ((kind & b) > 0 for b in (1, 2, 4, 8))
    single = letter | sign
    first = np.flatnonzero(space[:-2] & single[1:-1] & mark[2:]) + 1
    ends = np.flatnonzero(~mark | sign)
    after = ends[np.searchsorted(ends, first + 1)]
    apart = first[(sign & mark)[after] | (single[after] & mark[np.minimum(after + 1, len(mark) - 1)])]
    among = np.flatnonzero((letter[:-1] & sign[1:]) | (sign[:-1] & letter[1:]))
    low = _LOWER[codes]
    again = np.flatnonzero(letter[:-2] & (low[:-2] == low[1:-1]) & (low[1:-1] == low[2:]))
    of = lambda at: np.unique(np.searchsorted(starts, at, "right") - 1).tolist()
    return of(apart), of(among), of(again)


@dataclass
class Model:
    cost: np.ndarray | None  # -log P of a trigram
    weights: dict[str, float]  # "word" or "beginning*" -> log odds
    beta: np.ndarray | None
    share: float
    readings: dict[str, str] = field(default_factory=dict)

    def decode(self, candidate: str) -> str:
        """The cheapest reading of a candidate, in lower case."""
        raw = candidate.lower()
        letters = re.sub(r"[ ._\-]+", "", raw) if APART.fullmatch(candidate) else raw
        states: dict[tuple[int, int], tuple[float, str]] = {(0, 0): (DROP * (len(raw) - len(letters)), "")}
        letters = RUN.sub(lambda m: m.group(1) * STRETCH, letters)
        run = 0
        done: list[str] = []
        for k, c in enumerate(letters):
            if k % COMMIT == COMMIT - 1:  # what all paths share, so that their texts stay short; one letter stays for shrinking
                agreed = os.path.commonprefix([out for _, out in states.values()])[:-1]
                done.append(agreed)
                states = {at: (cost, out[len(agreed) :]) for at, (cost, out) in states.items()}
            run = run + 1 if k and letters[k - 1] == c else 1
            own = _NUMBER.get(c, 0)
            ways = ([(c, own, 0.0 if c.isalpha() else KEEP)]) + [(x, _NUMBER[x], SWAP) for x in LOOKS_LIKE.get(c, "")]
            new: dict[tuple[int, int], tuple[float, str]] = {}
            shrink = SHRINK_DOUBLE if run == 2 and letters[k + 1 : k + 2] != c else SHRINK
            for (a, b), (cost, out) in states.items():
                if run > 1 and out and (out[-1] == c or out[-1] in LOOKS_LIKE.get(c, "")) and new.get((a, b), (math.inf,))[0] > cost + shrink:
                    new[a, b] = (cost + shrink, out)
                for x, n, channel in ways:
                    total = cost + channel + float(self.cost[a, b, n])
                    if new.get((b, n), (math.inf,))[0] > total:
                        new[b, n] = (total, out + x)
            states = new
        return "".join(done) + min((cost + float(self.cost[a, b, 0]), out) for (a, b), (cost, out) in states.items())[1]

    def _read(self, match: re.Match[str]) -> str:
        found = match.group()
        if len(found) > LONGEST_CACHED:
            return self.decode(found)
        if found not in self.readings:
            if len(self.readings) > 100_000:
                self.readings.clear()
            self.readings[found] = self.decode(found)
        return self.readings[found]

    def restore(self, texts: list[str]) -> list[str]:
        """The texts with their candidates replaced by their readings."""
        if self.cost is None:
            return texts
        out = list(texts)
        for kind, which in zip((APART, AMONG, AGAIN), _suspects(texts), strict=True):
            for i in which:
                out[i] = kind.sub(self._read, out[i])
        return out

    def weight(self, word: str) -> float:
        """The strongest evidence of a lower-case word or one of its beginnings."""
        best = self.weights.get(word, 0.0)
        for n in BEGINNINGS:
            if len(word) >= n:
                best = max(best, self.weights.get(word[:n] + "*", 0.0))
        return best

    def evidence(self, restored: list[str]) -> np.ndarray:
        """For each text 1, the strongest evidence, and the log of how many words have some."""
        heads = {f.rstrip("*")[: BEGINNINGS[0]] for f in self.weights}
        words = [WORDS.findall(t.lower()) for t in restored]
        hot = {w: x for w in set().union(*words) if w[: BEGINNINGS[0]] in heads and (x := self.weight(w)) > 0}
        out = np.zeros((len(words), 3))
        out[:, 0] = 1
        for row, ws in zip(out, words, strict=True):
            if hot and not hot.keys().isdisjoint(ws):
                found = [hot[w] for w in ws if w in hot]
                row[1:] = max(found) / 3, math.log1p(len(found))
        return out

    def score(self, restored: list[str]) -> np.ndarray:
        if self.beta is None:
            return np.full(len(restored), self.share)
        return sigmoid(self.evidence(restored) @ self.beta)


def copies(texts: list[str]) -> list[bool]:
    """Which texts share many of their least shingle hashes with one earlier text that isn't itself such a copy."""
    having: dict[int, list[int]] = {}
    out = []
    for i, t in enumerate(texts):
        words = WORDS.findall(t.lower())
        least = sorted({zlib.crc32(" ".join(words[k : k + COPY_WORDS]).encode()) for k in range(max(1, len(words) - COPY_WORDS + 1))})[:COPY_HASHES]
        shared = Counter(j for h in least for j in having.get(h, ()))
        out.append(bool(shared) and max(shared.values()) >= min(COPY_SHARED, len(least)))
        if not out[-1]:
            for h in least:
                having.setdefault(h, []).append(i)
    return out


def fit(docs: DataFrame, labels: DataFrame, *, modulus: int = 4, remainder: int = 2) -> Model:
    docs = common.only(docs, ("doc_id", "text"))
    rows, share = labelled_sample(docs, labels, "toxic", PER_CLASS, LONGEST, modulus, remainder)
    seen: tuple[Counter[str], Counter[str]] = (Counter(), Counter())
    total = [0, 0]
    turn = [0, 0]
    rest: list[tuple[str, int]] = []
    for (t, y), copy in zip(rows, copies([t for t, _ in rows]), strict=True):
        if copy:  # near copies would make any of their words a feature
            continue
        found = set(WORDS.findall(t.lower()))
        turn[y] += 1
        if turn[y] % 3 == 0:  # a third fits the curve
            rest.append((t, y))
            continue
        total[y] += 1
        seen[y].update(found | {w[:n] + "*" for w in found for n in BEGINNINGS if len(w) >= n})
    odds = {f: (n + 0.1) / (total[1] + 0.2) / ((seen[0][f] + 0.5) / (total[0] + 1)) for f, n in seen[1].items() if n >= LEAST_ROWS}
    best = sorted((-o, f) for f, o in odds.items() if o >= LEAST_ODDS and seen[1][f] >= LEAST_SHARE * total[1])[:FEATURES]
    weights = {f: math.log(-o) for o, f in best}
    if not weights or not total[0]:
        return Model(None, {}, None, share)
    corpus = np.zeros(SIZE**3, np.int64)
    grams = letter_trigrams(docs).collect()  # SIZE**3 rows at most
    corpus[[r["gram"] for r in grams]] = [r["n"] for r in grams]
    learned = np.zeros(SIZE**3, np.int64)
    for f in weights:
        code = [0, 0, *[_NUMBER.get(c, 0) for c in f.rstrip("*")], *([] if f.endswith("*") else [0])]
        for a, b, c in zip(code, code[1:], code[2:], strict=False):
            learned[(a * SIZE + b) * SIZE + c] += seen[1][f]
    model = Model(-np.log((1 - MIX) * _conditional(corpus) + MIX * _conditional(learned)), weights, None, share)
    model.cost = model.cost.astype(np.float32)
    y = np.array([y for _, y in rest], float)
    if not 0 < y.sum() < len(y):
        return Model(None, {}, None, share)
    weight = np.where(y == 1, share / y.sum(), (1 - share) / (len(y) - y.sum())) * len(y)
    model.beta = logistic(model.evidence(model.restore([t for t, _ in rest])), y, weight, ridge=0.1)
    model.readings.clear()
    return model


def score_toxicity(docs: DataFrame, model: Model, *, text: str = "text") -> DataFrame:
    """``docs`` with ``restored``, the text as it is read, and ``score``."""
    inner = common.Inner(docs, ("restored", "score"), text=text)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by SIZE and FEATURES

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.slices(batches, "text"):
            restored = shared.value.restore([t or "" for t in batch.column("text").to_pylist()])
            yield common.with_columns(batch, {"restored": pa.array(restored, pa.string()), "score": pa.array(shared.value.score(restored), pa.float64())})

    return inner.outer(inner.df.mapInArrow(run, common.schema_with(inner.df, "restored string, score double")), "restored", "score")
