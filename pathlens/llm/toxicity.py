"""Toxicity scores of texts whose words may be disguised.

1. A character language model (trigram counts over words) is counted over all
   documents; it has a fixed alphabet, so its size does not follow the corpus.
2. A disguised span is a lattice: each sign may stand for some letters, runs for
   one or two, separators for nothing or for a word's edge. Spans are all blank-
   delimited tokens that mix letters with look-alikes, in any number and place;
   three or more single letters or look-alikes, a letter among them, apart by
   anything else; and words with a letter three times running or with two letters
   doubled (one doubled letter is taken as spelling). Viterbi finds the restoration with the best sum of channel and language
   model scores; plain words are their own best restoration and are not decoded.
3. The words of the text and of its restorations give grams (whole words, and
   their first 4 to 8 characters). A logistic model over those that labelled
   rows tell apart scores how often and how densely they occur. How many grams
   it uses, and where its cut lies, is found by cross-validation inside the
   learning rows; the penalty of its weights falls with their number.

The model learns from at most ``SAMPLE`` labelled rows, those with the least
hash of doc_id. Scoring reads the table once and shuffles nothing.

Defined cases: null and empty texts get the score of a text without grams; a
null doc_id is not held out and never learnt from; null labels are left out;
without labels of both classes every document gets the same score; an empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import lru_cache, partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import arrowkit, gam, quality, textkit

U = np.uint64
FOLDS, HELD = 4, 2
SAMPLE = 8_000
#: How many grams a model may use; cross-validation takes one of these.
GRAMS = (256, 1024, 4096)
PARTS = 3
RIDGE = 1.0
LEAST_ROWS = 5
CUT = 0.3
PREFIXES = (4, 5, 6, 7, 8)

#: The model's alphabet; 0 is the edge of a word, 1 any other letter.
ALPHABET = "abcdefghijklmnopqrstuvwxyzàáâäãåæçèéêëìíîïñòóôöõøùúûüýÿßœ"
SIZE = 64
#: What a sign may stand for.
LOOKALIKES = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "bg", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "€": "e", "£": "l", "¡": "i", "*": "aeiou", "#": "h", "%": "x", "&": "a",
}
#: Costs in natural logarithms: a sign read as a letter, a run shortened by a letter, a separator read, a character dropped.
COST_SIGN, COST_RUN, COST_GAP, COST_ODD = 0.7, 0.5, 0.2, 9.0
#: A sign dropped where it often stands beside a word, or elsewhere at the rim; a sign between letters as separator, or as a word's edge.
COST_RIM, COST_RIM_ODD, COST_BAR, COST_EDGE = 0.5, 2.0, 1.0, 3.0
BEFORE, AFTER, BARS = "(#@*¡+|&$£€", "!*|+%€$£", "|+"
#: A word's edge in a reading.
EDGE = " "
_BRACKETS = {"(": ")", "[": "]", "{": "}", "<": ">"}


@lru_cache(maxsize=1)
def letter_codes() -> np.ndarray:
    out = np.ones(0x110000, np.uint8)
    for i, c in enumerate(ALPHABET):
        out[ord(c)] = i + 2
    return out


def code(letter: str) -> int:
    return int(letter_codes()[ord(letter)])


def trigram_counts(texts: list[str]) -> np.ndarray:
    """Counts of (two letters before, letter) over all words, edges as 0."""
    total = np.zeros(SIZE**3, np.int64)
    for a, b in textkit.blocks(texts):
        words = textkit.Words(texts[a:b])
        if not len(words.begin):
            continue
        inside = textkit.word_table()[words.points]
        codes = np.where(inside, letter_codes()[words.points], 0).astype(np.int32)
        # a word needs two edges before it and one after; take words apart by their own places
        length = words.end - words.begin
        stream = np.zeros(int(length.sum()) + 3 * len(length), np.int32)
        at = np.cumsum(length + 3) - length - 1
        place = np.repeat(at - (np.cumsum(length) - length), length) + np.arange(length.sum())
        stream[place] = codes[np.repeat(words.begin - (np.cumsum(length) - length), length) + np.arange(length.sum())]
        triple = (stream[:-2] * SIZE + stream[1:-1]) * SIZE + stream[2:]
        total += np.bincount(triple, minlength=SIZE**3)
    total[0] = 0
    return total


def _count_rows(batches):
    total = np.zeros(SIZE**3, np.int64)
    for _, texts in arrowkit.pieces(batches, "text"):
        total += trigram_counts(texts)
    some = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], ["gram", "n"])


def language_model(counts: np.ndarray) -> np.ndarray:
    """Log probabilities [before, last, next], interpolated with bigrams and single letters."""
    c = counts.reshape(SIZE, SIZE, SIZE).astype(float)
    one = c.sum((0, 1)) + 0.5
    one /= one.sum()
    two = c.sum(0) + 20 * one
    two /= two.sum(1, keepdims=True)
    three = c + 20 * two[None]
    return np.log(three / three.sum(2, keepdims=True)).astype(np.float32)


def lattice(span: str) -> list[list[tuple[str, float]]]:
    """Readings (letters or EDGE, cost) of each run of equal characters of a span."""
    out = []
    for m in re.finditer(r"(.)\1*", span, re.S):
        c, n = m.group(1), len(m.group())
        readings: dict[str, float] = {}
        letters = [(c, 0.0)] if c.isalpha() else []
        letters += [(x, COST_SIGN + 0.3 * len(LOOKALIKES[c])) for x in LOOKALIKES.get(c, "")]
        for x, cost in letters:
            for times in (1, 2) if n > 1 else (1,):
                readings[x * times] = min(readings.get(x * times, 99.0), cost + COST_RUN * max(0, n - times))
        if not letters:
            readings[""], readings[EDGE] = (COST_ODD if c.isdigit() else COST_GAP * n), COST_GAP
        elif not c.isalpha():
            first, last = (not side or not (side.isalnum() or side in LOOKALIKES) for side in (span[m.start() - 1 : m.start()], span[m.end() : m.end() + 1]))
            readings[""] = COST_GAP * n if c == "*" else COST_BAR * n if c in BARS else COST_ODD
            if not c.isdigit():
                readings[EDGE] = COST_EDGE
                if first or last:
                    readings[""] = min(readings[""], COST_RIM if (first and c in BEFORE) or (last and c in AFTER) else COST_RIM_ODD)
        out.append(list(readings.items()))
    return out


def decode(span: str, lm: list[float]) -> list[str]:
    """The words of the restoration of a lower-case span with the least total cost."""
    states: dict[int, tuple[float, tuple | None]] = {0: (0.0, None)}
    for readings in lattice(span):
        step: dict[int, tuple[float, tuple | None]] = {}
        for letters, extra in readings:
            codes = [code(c) for c in letters] if letters != EDGE else None
            for state, (cost, said) in states.items():
                now = cost + extra
                if codes is None:
                    # an edge beside an edge is the same one
                    now -= lm[state * SIZE] if state else 0.0
                    state = 0
                else:
                    for k in codes:
                        now -= lm[state * SIZE + k]
                        state = state % SIZE * SIZE + k
                if (held := step.get(state)) is None or now < held[0]:
                    step[state] = (now, (said, letters) if letters else said)
        states = step
    said = min(((cost - (lm[state * SIZE] if state else 0.0), state, said) for state, (cost, said) in states.items()), key=lambda x: x[:2])[2]
    out = []
    while said is not None:
        said, letters = said
        out.append(letters)
    return "".join(reversed(out)).split()


def stripped(token: str) -> str:
    """A token without the brackets around it, and without underscores and signs that stand for nothing at its ends."""
    kept = lambda c: c.isalnum() or c in LOOKALIKES
    i, j = 0, len(token)
    while i < j:
        if j - i > 1 and _BRACKETS.get(token[i]) == token[j - 1]:
            i, j = i + 1, j - 1
        elif not kept(token[i]):
            i += 1
        elif not kept(token[j - 1]):
            j -= 1
        else:
            break
    return token[i:j]


def _decoded(span: str, lm_id: int) -> tuple[str, ...]:
    """Restored words of a span, but for those that stand there as they are."""
    span = stripped(span)
    plain = set(re.findall(r"[^\W_]+", span))
    return tuple(w for w in decode(span, _MODELS[lm_id]) if w not in plain)


#: For the spans that come again; long ones are not kept.
_restored = lru_cache(maxsize=100_000)(_decoded)
_MODELS: dict[int, list[float]] = {}


@lru_cache(maxsize=1)
def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Whether each code point is a letter, a look-alike, a blank."""
    sign, blank = np.zeros(0x110000, bool), np.zeros(0x110000, bool)
    sign[[ord(c) for c in LOOKALIKES]] = True
    blank[[i for i in range(0x110000) if chr(i).isspace()]] = True
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000), sign, blank


def disguised(words: textkit.Words) -> tuple[np.ndarray, np.ndarray]:
    """Begin and end, in the lowered block, of the spans to decode."""
    p = words.points
    if not len(p):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    letters, signs, blanks = _tables()
    letter, sign = letters[p], signs[p]
    starts = words.starts[:-1][words.starts[:-1] < len(p)]
    sums = lambda mask: np.concatenate(([0], np.cumsum(mask)))
    n_letters, n_signs, n_alnum = sums(letter), sums(sign), sums(letter | ((p >= 48) & (p <= 57)))
    # three or more units in a row that are one character, but for signs beside it
    begin, end = textkit.spans(letter | sign, starts)
    one = (end - begin == 1) | (n_alnum[end] - n_alnum[begin] == 1)
    text = np.searchsorted(words.starts, begin, side="right")
    new = np.ones(len(begin) + 1, bool)
    new[1:-1] = ~(one[1:] & one[:-1] & (text[1:] == text[:-1]))
    edges = np.flatnonzero(new)
    long = np.diff(edges) >= 3
    spaced_begin, spaced_end = begin[edges[:-1][long]], end[edges[1:][long] - 1]
    some = n_letters[spaced_end] > n_letters[spaced_begin]
    spaced_begin, spaced_end = spaced_begin[some], spaced_end[some]
    # tokens that mix letters and look-alikes, if not within such a row
    begin, end = textkit.spans(~blanks[p], starts)
    mixed = (n_letters[end] > n_letters[begin]) & (n_signs[end] > n_signs[begin])
    if len(spaced_begin):
        row = np.searchsorted(spaced_end, begin, side="right")
        at = np.minimum(row, len(spaced_begin) - 1)
        mixed &= ~((row < len(spaced_begin)) & (spaced_begin[at] < end))
    # words with a letter three times running, or two doubled ones, if not within such a token
    double = np.flatnonzero((p[:-1] == p[1:]) & letter[:-1])
    word = np.searchsorted(words.begin, double, side="right") - 1
    word = np.unique(word[1:][(word[1:] == word[:-1]) & (double[1:] < words.end[word[1:]])]) if len(double) > 1 else np.zeros(0, np.int64)
    token = np.searchsorted(begin, words.begin[word], side="right") - 1
    word = word[~mixed[token]]
    first = np.concatenate((spaced_begin, begin[mixed], words.begin[word]))
    order = np.argsort(first, kind="stable")
    return first[order], np.concatenate((spaced_end, end[mixed], words.end[word]))[order]


def block_restorations(words: textkit.Words, lm_id: int) -> list[list[str]]:
    """Per text of a block: restored words of its disguised spans, where they differ from what stands there."""
    said: list[list[str]] = [[] for _ in range(len(words))]
    begin, end = disguised(words)
    owner = np.searchsorted(words.starts, begin, side="right") - 1
    for i, a, b in zip(owner.tolist(), begin.tolist(), end.tolist()):
        said[i] += (_restored if b - a <= 64 else _decoded)(words.points[a:b].tobytes().decode("utf-32-le", "surrogatepass"), lm_id)
    return said


def restorations(text: str, lm_id: int) -> list[str]:
    """Restored words of the disguised spans of a text."""
    return block_restorations(textkit.Words([text]), lm_id)[0]


def _register(lm: np.ndarray) -> int:
    key = int(textkit.mix(np.array([lm.view(np.uint32).astype(U).sum()], U))[0] >> U(1))
    if key not in _MODELS:
        _MODELS.clear()
        _restored.cache_clear()
        _MODELS[key] = lm.ravel().tolist()
    return key


def gram_hits(texts: list[str], lm_id: int):
    """Per block of texts: (first text, number of texts, owner of each gram, gram, words per text)."""
    for a, b in textkit.blocks(texts):
        part = texts[a:b]
        words = textkit.Words(part)
        said = block_restorations(words, lm_id)
        extra = textkit.Words([" ".join(w) for w in said]) if any(said) else None
        owners, grams = [], []
        for w in filter(None, (words, extra)):
            owner = np.repeat(np.arange(b - a), np.diff(w.first))
            length = w.end - w.begin
            owners.append(owner)
            grams.append(w.hash)
            for n in PREFIXES:
                long = length >= n
                owners.append(owner[long])
                grams.append(textkit.span_hashes(w.points, w.begin[long], w.begin[long] + n) ^ U(n * 0x9E3779B1))
        yield a, b - a, np.concatenate(owners), np.concatenate(grams), np.diff(words.first)


def _gram_rows(batches, lm: np.ndarray):
    """Rows by gram with how many texts of each class have it."""
    lm_id = _register(lm)

    def out(keys, positive, negative):
        return pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(positive), pa.array(negative)], ["gram", "positive", "negative"])

    for batch, texts in arrowkit.pieces(batches, "text", 4_000_000):
        label = np.array(batch.column(1).to_pylist())
        for first, n, owner, gram, _ in gram_hits(texts, lm_id):
            _, once = np.unique(textkit.mix(gram ^ textkit.mix(owner.astype(U) + U(1))), return_index=True)
            keys, index = np.unique(gram[once], return_inverse=True)
            y = label[first + owner[once]]
            yield out(keys, np.bincount(index, y, len(keys)).astype(np.int64), np.bincount(index, 1 - y, len(keys)).astype(np.int64))


@dataclass
class Model:
    lm: np.ndarray
    grams: np.ndarray
    weights: np.ndarray
    intercept: float

    def design(self, texts: list[str]):
        """Rows, columns and values of the sparse features: log counts, then counts per word."""
        lm_id = _register(self.lm)
        rows, cols, values = [], [], []
        for first, n, owner, gram, words in gram_hits(texts, lm_id):
            hit = self._may(gram)
            owner, gram = owner[hit], gram[hit]
            at = np.minimum(np.searchsorted(self.grams, gram), max(len(self.grams) - 1, 0))
            real = self.grams[at] == gram if len(self.grams) else np.zeros(0, bool)
            pair, times = np.unique(owner[real] * (len(self.grams) + 1) + at[real], return_counts=True)
            o, g = pair // (len(self.grams) + 1), pair % (len(self.grams) + 1)
            rows += [first + o, first + o]
            cols += [g, g + len(self.grams)]
            values += [np.log1p(times), np.minimum(20.0 * times / np.maximum(words[o], 8), 3.0)]
        return (np.concatenate(rows) if rows else np.zeros(0, int), np.concatenate(cols) if cols else np.zeros(0, int), np.concatenate(values) if values else np.zeros(0))

    def _may(self, gram: np.ndarray) -> np.ndarray:
        if not hasattr(self, "_mask"):
            self._mask = np.zeros(1 << 20, bool)
            self._mask[(self.grams >> U(44)).astype(np.int64)] = True
        return self._mask[(gram >> U(44)).astype(np.int64)]

    def score(self, texts: list[str]) -> np.ndarray:
        rows, cols, values = self.design(texts)
        return gam.sigmoid(self.intercept + np.bincount(rows, values * self.weights[cols], len(texts)))

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k != "_mask"}


def _design_rows(batches, model: Model):
    for batch, texts in arrowkit.pieces(batches, "text"):
        rows, cols, values = model.design(texts)
        order = np.argsort(rows, kind="stable")
        cut = np.searchsorted(rows[order], np.arange(1, len(texts)))
        yield pa.RecordBatch.from_arrays([pa.array(np.split(cols[order], cut), pa.list_(pa.int64())), pa.array(np.split(values[order], cut), pa.list_(pa.float64())), batch.column(1)], ["cols", "vals", "label"])


def _logistic(rows, cols, values, y, width: int, steps: int = 400) -> tuple[np.ndarray, float]:
    """Weights and intercept by Adam on the whole sample; the penalty of a weight falls with the number of rows."""
    w, b = np.zeros(width), float(np.log((y.sum() + 1) / (len(y) - y.sum() + 1)))
    m, v, mb, vb = np.zeros(width), np.zeros(width), 0.0, 0.0
    for step in range(1, steps + 1):
        p = gam.sigmoid(b + np.bincount(rows, values * w[cols], len(y)))
        g = (np.bincount(cols, values * (p - y)[rows], width) + RIDGE * w) / len(y)
        gb = float((p - y).mean())
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        mb, vb = 0.9 * mb + 0.1 * gb, 0.99 * vb + 0.01 * gb * gb
        rate = 0.1 / (1 + step / 100)
        w -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
        b -= rate * (mb / (1 - 0.9**step)) / (np.sqrt(vb / (1 - 0.99**step)) + 1e-8)
    return w, b


def out_of_fold(rows, cols, values, y, width: int) -> np.ndarray:
    """The log odds of each learning row by a model that has not seen its part of the sample."""
    part = np.random.default_rng(0).integers(0, PARTS, len(y))
    out = np.zeros(len(y))
    for k in range(PARTS):
        seen = part != k
        place, mine = np.cumsum(seen) - 1, seen[rows]
        w, b = _logistic(place[rows[mine]], cols[mine], values[mine], y[seen], width, 150)
        out[~seen] = (b + np.bincount(rows, values * w[cols], len(y)))[~seen]
    return out


def separation(odds: np.ndarray, y: np.ndarray) -> float:
    """The chance that a row of label 1 lies above one of label 0 (area under the curve)."""
    order = np.argsort(odds, kind="stable")
    _, first, inverse, times = np.unique(odds[order], return_index=True, return_inverse=True, return_counts=True)
    rank = np.empty(len(y))
    rank[order] = (first + (times + 1) / 2)[inverse]
    n = y.sum()
    return float((rank[y == 1].sum() - n * (n + 1) / 2) / max(n * (len(y) - n), 1))


def calibration(odds: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """(slope, cut): what log odds have to be multiplied by to be right, and where the cut gives the best F1."""
    order = np.argsort(-odds, kind="stable")
    f1 = 2 * np.cumsum(y[order]) / (np.arange(1, len(y) + 1) + y.sum())
    at = int(np.argmax(f1))
    below = odds[order][at + 1] if at + 1 < len(y) else odds[order][at] - 1
    slope, shift = 1.0, 0.0
    for _ in range(100):
        p = gam.sigmoid(slope * odds + shift)
        g = np.array([((p - y) * odds).sum() + (slope - 1), (p - y).sum() + shift / 100])
        h = p * (1 - p)
        curve = np.array([[(h * odds * odds).sum() + 1, (h * odds).sum()], [(h * odds).sum(), h.sum() + 0.01]])
        slope, shift = np.array([slope, shift]) - np.linalg.solve(curve, g)
    return float(np.clip(slope, 0.5, 5)), float((odds[order][at] + below) / 2)


def train(documents: DataFrame, labels: DataFrame, most: int = SAMPLE) -> Model:
    counts = np.zeros(SIZE**3, np.int64)
    for row in documents.select("text").mapInArrow(_count_rows, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n")).toPandas().itertuples():
        counts[row.gram] = row.n
    lm = language_model(counts)
    learning = quality.learning_rows(documents, labels, "toxic", FOLDS, HELD, most)
    sums = learning.groupBy("label").count().toPandas()
    n = {int(k): int(c) for k, c in zip(sums["label"], sums["count"])}
    model = Model(lm, np.zeros(0, U), np.zeros(0), float(np.log((n.get(1, 0) + 1) / (n.get(0, 0) + 1))))
    if len(n) < 2:
        return model
    grams = learning.mapInArrow(partial(_gram_rows, lm=lm), "gram long, positive long, negative long").groupBy("gram").agg(F.sum("positive").alias("p"), F.sum("negative").alias("q")).where(F.col("p") + F.col("q") >= LEAST_ROWS)
    share_p, share_q = F.col("p") / n[1], F.col("q") / n[0]
    every = (F.col("p") + F.col("q")) / (n[0] + n[1])
    gain = F.abs(share_p - share_q) / F.sqrt(every * (1 - every) + F.lit(1e-9))
    best = grams.select("gram", gain.alias("gain")).orderBy(F.col("gain").desc(), "gram").limit(max(GRAMS)).toPandas()
    ranked = best["gram"].to_numpy(np.int64).view(U)
    by_value = np.argsort(ranked)
    model.grams, rank = ranked[by_value], by_value
    model.weights = np.zeros(2 * len(model.grams))
    design = learning.mapInArrow(partial(_design_rows, model=model), "cols array<long>, vals array<double>, label int")
    design = design.orderBy(F.xxhash64("cols", "vals"), "label").limit(most).toPandas()
    order = np.lexsort(([len(c) for c in design["cols"]], [float(np.sum(v)) for v in design["vals"]], design["label"]))
    design = design.iloc[order]
    y = design["label"].to_numpy(float)
    rows = np.repeat(np.arange(len(design)), [len(c) for c in design["cols"]])
    cols, values = np.concatenate(design["cols"].to_list()).astype(int), np.concatenate(design["vals"].to_list())
    # how many grams this many labels can bear is seen on rows that a model has not learnt from
    found = []
    for width in GRAMS:
        kept = np.flatnonzero(rank < width)
        place = np.full(2 * len(rank), -1)
        place[np.concatenate([kept, kept + len(rank)])] = np.arange(2 * len(kept))
        some = place[cols] >= 0
        part = rows[some], place[cols[some]], values[some], y, 2 * len(kept)
        odds = out_of_fold(*part)
        found.append((separation(odds, y), -width, odds, kept, part))
        if len(kept) == len(rank):
            break
    _, _, odds, kept, part = max(found, key=lambda x: x[:2])
    weights, intercept = _logistic(*part)
    slope, cut = calibration(odds, y)
    model.grams = model.grams[kept]
    model.weights, model.intercept = slope * weights, slope * (intercept - cut) + float(np.log(CUT / (1 - CUT)))
    used = (model.weights[: len(model.grams)] != 0) | (model.weights[len(model.grams) :] != 0)
    model.weights = np.concatenate([model.weights[: len(model.grams)][used], model.weights[len(model.grams) :][used]])
    model.grams = model.grams[used]
    return model


def _scores(batches, model: Model):
    for batch, texts in arrowkit.pieces(batches, "text"):
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.score(texts))], ["doc_id", "score"])


def report(documents: DataFrame, labels: DataFrame) -> DataFrame:
    model = train(documents, labels)
    scored = documents.select("doc_id", "text").mapInArrow(partial(_scores, model=model), "doc_id long, score double")
    return scored.select("doc_id", quality.held_out(F.col("doc_id"), FOLDS, HELD).alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted"))
