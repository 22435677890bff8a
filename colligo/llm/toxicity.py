"""Toxicity by a subsequence string-kernel support vector machine on Nyström landmarks.

The kernel of two words sums, over their common subsequences of ORDER letters,
a decay for every position that the subsequence spans in either word, so gaps
and inserted characters lower it gently. Words lose everything but letters and
digits, are lower-cased, marked at their start, and runs of single letters are
put together. Landmark words give every word an explicit feature vector
(K_mm^-1/2 k_m), on which a linear machine with squared hinge loss is trained.

The machine is trained on labelled sentences, as a multi-instance machine: a
sentence of a document labelled 0 is a negative bag, all of whose words are
negative; a document labelled 1 is a positive bag of sentences. Words that occur
in many toxic sentences among different neighbours, and hardly elsewhere, are
its witnesses; they train as positive, as they are and with one letter inserted
at each place, and so does, in further rounds, the word
of each positive bag to which the machine of the round before gave the highest
value, if no negative bag has it. Landmarks are witnesses, spread until each is
near one, and the clean words most like them. A text's value is its highest
word's (so of its highest sentence), which a logistic curve, as steep
as it is among the training documents and even at half the machine's margin,
turns into a score between 0 and 1. Insults of several words
that each stand in clean sentences have no witness and are missed.

The machine is fitted on at most `labelled` documents (by a hash of the id) and
`sentences` sentences of either label, bounds that are parameters; every word of
every whole text is scored, with its kernel. The kernel is worked out over the
subsequences that landmarks have, not pair by pair.

Defined results: null and empty texts and texts without a word get the score of
the lowest value, not toxic; repeated rows get equal scores; without a label of
either class every score is the share of label 1 (0 if there is none); an empty
table gives an empty table; extra columns are ignored by `score` and kept by
`drop_toxic`. A document with several labels counts as toxic if one says so.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations
from math import comb

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colligo.llm.common import TEXT_ROWS, staged, text_or_empty, with_ids

ORDER, DECAY, POWER = 3, 0.7, 3
#: Landmarks at least.
LANDMARKS = 96
#: Letters of a word that the kernel sees at once; longer words are seen in overlapping windows.
SPAN = 24
#: Similarity that every witness has at least to one landmark; landmarks are added to the usual number until that holds.
COVER = 0.25
LABELLED, SENTENCES = 20_000, 8_000
#: Numbers of a table of subsequences that is worked on at once.
PART = 1 << 16
#: Words whose values a Python worker remembers.
WORDS_KEPT = 500_000
LOWEST = -3.0
#: Values beyond the machine's margin say no more to the curve.
MARGIN = 1.0
#: A letter of private use, for no word's own.
FOREIGN = "\ue000"
_DROP = re.compile(r"[\W_]+")


def words_of(text: str) -> list[str]:
    """Lower-cased words without signs; neighbouring single letters are one word."""
    out: list[str] = []
    run: list[str] = []
    for token in text.lower().split():
        word = token if token.isalnum() else _DROP.sub("", token)
        if len(word) == 1:
            run.append(word)
            continue
        if run:
            out.append("".join(run))
            run = []
        if word:
            out.append(word)
    if run:
        out.append("".join(run))
    return out


def sentences_of(text: str) -> list[str]:
    return [s for s in re.split(r"[.!?]+\s|\n", text) if s.strip()]


def windows(word: str) -> list[str]:
    """The word, or the overlapping windows of SPAN letters in which a longer one is seen."""
    if len(word) <= SPAN:
        return [word]
    return [word[at : at + SPAN] for at in range(0, len(word) - SPAN // 2, SPAN // 2)]


def disguised(word: str) -> list[str]:
    """The word with one foreign letter inserted, at each place inside it; as long as it still is one window."""
    return [f"{word[:i]}{FOREIGN}{word[i:]}" for i in range(1, len(word))] if len(word) < SPAN else []


def codes(words: list[str]) -> np.ndarray:
    """Letters as numbers, between a start and an end mark, 0 behind; words of at most SPAN letters."""
    size = np.array([len(w) for w in words], dtype=np.int64)
    out = np.zeros((len(words), int(size.max(initial=0)) + 2), dtype=np.int32)
    place = np.arange(out.shape[1])
    out[:, 0] = 1
    out[(place >= 1) & (place <= size[:, None])] = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), dtype=np.int32) + 3
    out[np.arange(len(words)), size + 1] = 2
    return out


def places(width: int) -> tuple[np.ndarray, np.ndarray]:
    """All choices of ORDER places out of width, and the decay of each for the stretch it spans."""
    found = np.array(list(combinations(range(width), ORDER)), dtype=np.int64).reshape(-1, ORDER)
    return found, (DECAY ** (found[:, -1] - found[:, 0] + 1.0)).astype(np.float32)


def grouped(words: list[str]) -> Iterator[tuple[list[int], np.ndarray]]:
    """Numbers and codes of words of the same length, a bounded number at a time."""
    by_size: dict[int, list[int]] = defaultdict(list)
    for i, w in enumerate(words):
        by_size[len(w)].append(i)
    for size, mine in by_size.items():
        step = max(1, PART // max(1, comb(size + 2, ORDER)))
        for at in range(0, len(mine), step):
            part = mine[at : at + step]
            yield part, codes([words[i] for i in part])


def own_kernel(c: np.ndarray) -> np.ndarray:
    """Every word's kernel with itself, by the usual recursion over prefixes; words of one length."""
    n, width = c.shape
    lam = np.float32(DECAY)
    tail = [np.ones((width + 1, n), dtype=np.float32)] + [np.zeros((width + 1, n), dtype=np.float32) for _ in range(ORDER - 1)]
    total = np.zeros(n, dtype=np.float32)
    for k in range(width):
        same = np.ascontiguousarray((c == c[:, k : k + 1]).T, dtype=np.float32) * (lam * lam)
        grown = []
        for i in range(1, ORDER):
            new = lam * tail[i]
            part = np.zeros(n, dtype=np.float32)
            for j in range(width):
                part = lam * part + same[j] * tail[i - 1][j]
                new[j + 1] += part
            grown.append(new)
        total += (same * tail[ORDER - 1][:-1]).sum(axis=0)
        tail[1:] = grown
    return total


class Kernel:
    """Kernels of words with given landmarks, by the subsequences that landmarks have."""

    def __init__(self, landmarks: list[str]) -> None:
        self.own = np.zeros(len(landmarks))
        coded = list(grouped(landmarks))
        self.letters = np.unique(np.concatenate([c.ravel() for _, c in coded]))  # all others have the number 0
        base = len(self.letters) + 1
        rows, columns, weights = [], [], []
        for part, c in coded:
            self.own[part] = own_kernel(c)
            keys, decays = self._keys(c)
            rows.append(keys.ravel())
            columns.append(np.repeat(part, keys.shape[1]))
            weights.append(np.tile(decays, len(part)))
        self.size = len(landmarks)
        # One entry for each subsequence of each landmark, by subsequence; most have one or two.
        pairs, place = np.unique(np.concatenate(rows) * self.size + np.concatenate(columns), return_inverse=True)
        self.entries = np.bincount(place, weights=np.concatenate(weights))
        self.owners = pairs % self.size
        self.first = np.searchsorted(pairs, np.arange(base**ORDER + 1, dtype=np.int64) * self.size).astype(np.int32)

    def _keys(self, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Keys of all subsequences of ORDER letters, one row a word, and the decay of each column."""
        at = np.minimum(np.searchsorted(self.letters, c), len(self.letters) - 1)
        number = np.where(self.letters[at] == c, at + 1, 0)
        found, decays = places(c.shape[1])
        keys = np.zeros((len(c), len(found)), dtype=np.int64)
        for k in range(ORDER):
            keys = keys * (len(self.letters) + 1) + number[:, found[:, k]]
        return keys, decays

    def raw(self, c: np.ndarray) -> np.ndarray:
        """Sums over common subsequences of their decays in both words."""
        keys, decays = self._keys(c)
        start, count = self.first[keys], self.first[keys + 1] - self.first[keys]
        word, column = np.nonzero(count)
        start, count = start[word, column], count[word, column]
        ends = np.cumsum(count, dtype=np.int64)
        entry = np.arange(ends[-1] if len(ends) else 0) + np.repeat(start - (ends - count), count)
        at = np.repeat(word * self.size, count) + self.owners[entry]
        found = np.bincount(at, weights=self.entries[entry] * np.repeat(decays[column], count), minlength=len(c) * self.size)
        return found.reshape(len(c), self.size).astype(np.float32)

    def similarity(self, words: list[str]) -> np.ndarray:
        """Normalised kernels to the power POWER (a kernel again, and a more local one); words of at most SPAN letters."""
        out = np.zeros((len(words), self.size), dtype=np.float32)
        norm = np.sqrt(np.maximum(self.own, 1e-12))
        for part, c in grouped(words):
            out[part] = (self.raw(c) / (np.sqrt(np.maximum(own_kernel(c), 1e-12))[:, None] * norm)) ** POWER
        return out


@dataclass(frozen=True)
class Model:
    landmarks: list[str]
    kernel: Kernel
    weights: np.ndarray  # on similarities, the Nyström map folded in
    bias: float
    slope: float = 1.0
    shift: float = 0.0

    def values(self, words: list[str]) -> np.ndarray:
        """The machine's value of every word; of a long word, its highest window's."""
        parts, owner = [], []
        for i, w in enumerate(words):
            seen = windows(w)
            parts += seen
            owner += [i] * len(seen)
        out = np.full(len(words), LOWEST)
        for at in range(0, len(parts), 16384):
            np.maximum.at(out, owner[at : at + 16384], self.kernel.similarity(parts[at : at + 16384]) @ self.weights + self.bias)
        return out

    def scores(self, values: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * np.minimum(values, MARGIN) + self.shift, -30, 30)))


def fit_machine(words: list[str], y: np.ndarray, kernel: Kernel, landmarks: list[str], cost: float = 10.0, steps: int = 60) -> tuple[np.ndarray, float]:
    """Weights on similarities and bias: squared hinge loss, both classes weighing the same, by Newton steps."""
    k = kernel.similarity(landmarks).astype(float)
    val, vec = np.linalg.eigh((k + k.T) / 2)
    root = vec @ np.diag(1 / np.sqrt(np.maximum(val, 1e-3))) @ vec.T
    x = np.c_[kernel.similarity(words).astype(float) @ root, np.ones(len(words))]
    s = np.where(y > 0, 1.0, -1.0)
    c = cost * np.where(y > 0, 1 / max(1, (y > 0).sum()), 1 / max(1, (y <= 0).sum())) * len(y) / 2
    w = np.zeros(x.shape[1])
    ridge = np.eye(x.shape[1])
    ridge[-1, -1] = 1e-6
    for _ in range(steps):
        active = s * (x @ w) < 1
        xa, ca = x[active], c[active]
        new = np.linalg.solve(ridge + xa.T @ (ca[:, None] * xa), xa.T @ (ca * s[active]))
        if np.allclose(new, w, atol=1e-9):
            break
        w = new
    return root @ w[:-1], float(w[-1])


def fit_logistic(v: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and shift of a lightly regularised logistic curve."""
    x, w = np.c_[v, np.ones(len(v))], np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ (p - y) + 0.05 * w
        h = (x.T * (p * (1 - p))) @ x + 0.05 * np.eye(2)
        w = w - np.linalg.solve(h, g)
    return float(w[0]), float(w[1])


def _spread(words: list[str], n: int, cover: float = 0.0) -> list[str]:
    """n words that are unlike each other, the first and then by distance, and more until every word is as near as cover to one."""
    if len(words) <= n:
        return words
    near = Kernel(words[:1]).similarity(words)[:, 0]
    picked = [0]
    while len(picked) < n or near.min() < cover:
        i = int(np.argmin(near))
        picked.append(i)
        near = np.maximum(near, Kernel([words[i]]).similarity(words)[:, 0])
    return [words[i] for i in picked]


def values_of(texts: list[str], model: Model, known: dict[str, float]) -> np.ndarray:
    """Highest word value of each text; known remembers words between calls."""
    if len(known) > WORDS_KEPT:
        known.clear()
    split = [words_of(t) for t in texts]
    new = list({w for ws in split for w in ws if w not in known})
    known.update(zip(new, model.values(new).tolist(), strict=True))
    return np.array([max(map(known.__getitem__, ws), default=LOWEST) for ws in split])


def highest_values(docs: DataFrame, model: Model, kept: str) -> DataFrame:
    """The kept columns (a schema of columns without nulls) and the highest word value of every text."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known: dict[str, float] = {}
        for whole in batches:
            for at in range(0, len(whole), 512):
                pdf = whole.iloc[at : at + 512]
                yield pdf.drop(columns="text").assign(value=values_of(pdf["text"].tolist(), model, known))

    return docs.mapInPandas(run, f"{kept}, value double")


def _word_counts(docs: DataFrame) -> DataFrame:
    """word, t and n: distinct texts of label 1 and documents of label 0 that hold it, s: distinct pairs of neighbours that it has in toxic sentences."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for whole in batches:
            for at in range(0, len(whole), 1024):
                pdf = whole.iloc[at : at + 1024]
                clean: Counter = Counter()
                rows = []
                for text, toxic in zip(pdf["text"], pdf["toxic"], strict=True):
                    if toxic:
                        d = zlib.crc32(text.encode())
                        for s in sentences_of(text):
                            ws = ["", *words_of(s), ""]
                            rows += [(x, d, zlib.crc32(f"{a} {b}".encode()), 0) for a, w, b in zip(ws, ws[1:], ws[2:], strict=False) for x in windows(w)]
                    else:
                        clean.update({x for w in words_of(text) for x in windows(w)})
                rows += [(w, None, None, c) for w, c in clean.items()]
                yield pd.DataFrame(rows, columns=["word", "d", "h", "n"]).astype({"d": "Int64", "h": "Int64"})

    made = docs.select("text", "toxic").mapInPandas(run, "word string, d long, h long, n long")
    return made.groupBy("word").agg(F.countDistinct("d").alias("t"), F.countDistinct("h").alias("s"), F.sum("n").alias("n"))


def _sentences(docs: DataFrame, most: int) -> list[tuple[int, bool, list[str]]]:
    """doc_id, label and distinct word windows of at most `most` sentences of each label, by a hash."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for whole in batches:
            # Few texts at a time: lists of words take many times the room of their text.
            for at in range(0, len(whole), 128):
                pdf = whole.iloc[at : at + 128]
                rows = [(d, bool(y), zlib.crc32(s.encode()), sorted({x for w in words_of(s) for x in windows(w)})) for d, y, t in zip(pdf["doc_id"], pdf["toxic"], pdf["text"], strict=True) for s in sentences_of(t)]
                yield pd.DataFrame(rows, columns=["doc_id", "toxic", "h", "words"])

    made = staged(docs.select("doc_id", "toxic", "text").mapInPandas(run, "doc_id long, toxic boolean, h long, words array<string>"), "sentences", TEXT_ROWS)
    found = []
    for label in (True, False):
        found += made.where(F.col("toxic") == label).orderBy("h", "doc_id").limit(most).collect()
    return [(r.doc_id, r.toxic, r.words) for r in found]


def train(docs: DataFrame, labels: DataFrame, labelled: int = LABELLED, sentences: int = SENTENCES, witnesses: int = 1500, least_z: float = 4.0, rounds: int = 2) -> Model | float:
    """Fit on documents with a label, both given as (doc_id, text) and (doc_id, toxic); a number, the share of label 1, if a class is missing.

    To the driver go at most 2 * `sentences` sentences, `witnesses` words and one value per training document.
    """
    chosen = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(labelled)
    chosen = staged(chosen, "labels")
    # At most `labelled` rows, so the broadcast is bounded.
    rows = staged(docs.join(F.broadcast(chosen), "doc_id").select("doc_id", "text", "toxic").where("text <> ''"), "labelled")
    ones, all_rows = rows.agg(F.sum("toxic"), F.count("*")).first()
    if not ones or ones == all_rows:
        return float(ones or 0) / max(1, all_rows)
    counts = staged(_word_counts(rows), "words", TEXT_ROWS)
    odds = float(ones) / (all_rows - ones)
    expected = (F.col("t") + F.col("n")) * (odds / (1 + odds))
    # Words that only copies of one text share have few distinct neighbours, however many the copies.
    z = (F.least("t", "s") - expected) / F.sqrt(expected + 1)
    best = counts.withColumn("z", z).where((F.col("t") >= 9 * odds * F.col("n")) & (F.col("s") >= 3) & (2 * F.col("s") >= F.col("t")))
    pos = [r.word for r in best.where(F.col("z") >= least_z).orderBy(F.desc("z"), "word").limit(witnesses).collect()]
    if not pos:
        pos = [r.word for r in best.orderBy(F.desc("z"), "word").limit(20).collect()]
    bags = _sentences(rows, sentences)
    seen = set(pos)
    neg = sorted({w for _, toxic, words in bags if not toxic for w in words} - seen) or [""]
    marks = pos[: LANDMARKS // 4]
    marks += _spread(pos[len(marks) :], LANDMARKS * 5 // 8 - len(marks), COVER)
    if not marks:
        return float(ones) / all_rows
    like = Kernel(marks).similarity(neg).max(axis=1)
    marks += [neg[i] for i in np.argsort(-like, kind="stable")[: LANDMARKS * 3 // 8]]
    kernel = Kernel(marks)
    positive: dict[int, list[str]] = defaultdict(list)
    for d, toxic, words in bags:
        if toxic:
            positive[d] += words
    clean = set(neg)
    for _ in range(rounds):
        hidden = [x for w in pos for x in disguised(w)]
        weights, bias = fit_machine(pos + hidden + neg, np.r_[np.ones(len(pos) + len(hidden)), np.zeros(len(neg))], kernel, marks)
        machine = Model(marks, kernel, weights, bias)
        known = dict(zip(all_, machine.values(all_).tolist(), strict=True)) if (all_ := sorted({w for ws in positive.values() for w in ws})) else {}
        tops = {max(ws, key=lambda w: (known[w], w)) for ws in positive.values() if ws}
        more = sorted(w for w in tops if known[w] > 0 and w not in seen and w not in clean)
        if not more:
            break
        pos, seen = pos + more, seen | set(more)
    fitted = highest_values(rows.select("toxic", "text"), machine, "toxic int").collect()
    slope, _ = fit_logistic(np.array([min(r.value, MARGIN) for r in fitted]), np.array([float(r.toxic) for r in fitted]))
    # Even odds stand at half the margin, wherever noise in the labels would move them.
    return Model(marks, kernel, weights, bias, max(slope, 1.0), -max(slope, 1.0) * MARGIN / 2)


def score(docs: DataFrame, model: Model | float, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and score of every row."""
    rows = with_ids(docs, id_col, text_col)
    given = F.when(~F.col("no_id"), F.col("doc_id")).alias("doc_id")
    if not isinstance(model, Model):
        return rows.select(given, F.lit(float(model)).alias("score"))
    curve = F.lit(1.0) / (1 + F.exp(-F.greatest(F.lit(-30.0), F.least(F.lit(30.0), F.lit(model.slope) * F.least("value", F.lit(MARGIN)) + F.lit(model.shift)))))
    return highest_values(rows, model, "doc_id long, no_id boolean").select(given, curve.alias("score"))


def drop_toxic(docs: DataFrame, model: Model | float, threshold: float = 0.5, text_col: str = "text") -> DataFrame:
    """The rows of docs whose text scores below the threshold, with all their columns."""
    if not isinstance(model, Model):
        return docs.where(F.lit(float(model) < threshold))

    @F.pandas_udf("double")
    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        known: dict[str, float] = {}
        for whole in batches:
            yield pd.Series(np.concatenate([model.scores(values_of(whole.iloc[at : at + 512].tolist(), model, known)) for at in range(0, len(whole), 512)]))

    # Only texts go to Python, and only scores come back.
    return docs.where(scored(text_or_empty(text_col)) < threshold)
