"""Quality scores by a generalised additive model over features of the text.

Features are counted over whole texts with numpy, in one pass over the table
and without a shuffle. The model learns from at most ``SAMPLE`` labelled rows
(those with the least hash of doc_id, so the choice is the same on every run);
the tables that it learns are a few kilobytes and travel with the scoring
function.

Defined cases: null and empty texts have all features zero and get that
place's score; a null doc_id is not held out and never learnt from; labels that
are null are left out, and rows that repeat a label count again; without labels
(or with one class only) every document gets the same score; an empty table
gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import arrowkit, gam, textkit
from .work import quoted, unused

U = np.uint64
FOLDS, HELD = 5, 0
SAMPLE = 12_000
CUT = 0.3
FEATURES = (
    "log_chars", "log_words", "word_length", "upper", "digit", "space", "symbol", "stop_mark", "comma", "exclaim",
    "lines", "line_length", "repeated_lines", "distinct_words", "doubled_words", "top_word", "short_words", "long_words", "repeated_pairs",
)


def _counts(points: np.ndarray, starts: np.ndarray, *chars: str) -> np.ndarray:
    hit = np.concatenate(([0], np.cumsum(np.isin(points, [ord(c) for c in chars]))))
    return hit[starts[1:]] - hit[starts[:-1]]


def _distinct(owner: np.ndarray, hashes: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Per owner: how many different hashes, and how often the commonest."""
    order = np.lexsort((hashes, owner))
    o, h = owner[order], hashes[order]
    new = np.ones(len(o), bool)
    new[1:] = (o[1:] != o[:-1]) | (h[1:] != h[:-1])
    firsts = np.flatnonzero(new)
    times = np.diff(np.append(firsts, len(o)))
    most = np.zeros(n)
    np.maximum.at(most, o[firsts], times)
    return np.bincount(o[firsts], minlength=n).astype(float), most


def features(texts: list[str]) -> np.ndarray:
    """One row of ``FEATURES`` per text."""
    out = np.zeros((len(texts), len(FEATURES)))
    for a, b in textkit.blocks(texts):
        out[a:b] = _block(texts[a:b])
    return out


def _block(texts: list[str]) -> np.ndarray:
    n = len(texts)
    points, starts = textkit.code_points(texts)
    words = textkit.Words(texts)
    owner = np.repeat(np.arange(n), np.diff(words.first))
    chars, count = np.maximum(np.diff(starts), 1), np.diff(words.first)
    some = np.maximum(count, 1)
    length = words.end - words.begin
    lengths = np.concatenate(([0], np.cumsum(length)))
    lower = np.concatenate(([0], np.cumsum(_changed(points))))
    inside = points != 10
    begin, end = textkit.spans(inside, starts[:-1][starts[:-1] < len(points)]) if len(points) else (np.zeros(0, int),) * 2
    line_owner = np.searchsorted(starts, begin, side="right") - 1
    lines = np.bincount(line_owner, minlength=n)
    line_kinds, _ = _distinct(line_owner, textkit.span_hashes(points, begin, end), n)
    distinct, top = _distinct(owner, words.hash, n)
    same = np.zeros(len(owner), bool)
    same[1:] = (words.hash[1:] == words.hash[:-1]) & (owner[1:] == owner[:-1])
    pairs = textkit.windows(words.hash, 2)
    whole = owner[1:] == owner[:-1] if len(owner) > 1 else np.zeros(0, bool)
    pair_kinds, _ = _distinct(owner[:-1][whole], pairs[whole], n) if len(pairs) else (np.zeros(n), None)
    pair_count = np.maximum(count - 1, 1)
    per = lambda mask: np.bincount(owner, mask, n) / some
    cols = [
        np.log1p(np.diff(starts)), np.log1p(count), (lengths[words.first[1:]] - lengths[words.first[:-1]]) / some,
        (lower[starts[1:]] - lower[starts[:-1]]) / chars, _counts(points, starts, *"0123456789") / chars, _counts(points, starts, " ", "\n", "\t") / chars,
        _counts(points, starts, *"$%&*#|@^~<>{}[]=+\\/_") / chars, _counts(points, starts, ".") / some, _counts(points, starts, ",", ";", ":") / some, _counts(points, starts, "!", "?") / some,
        np.log1p(lines), np.log1p(np.diff(starts) / np.maximum(lines, 1)), 1 - line_kinds / np.maximum(lines, 1),
        distinct / some, per(same), top / some, per(length <= 2), per(length >= 14), 1 - np.where(count > 1, pair_kinds / pair_count, 1),
    ]
    return np.stack(cols, axis=1)


def _changed(points: np.ndarray) -> np.ndarray:
    """Whether each code point is an upper-case letter."""
    return _upper()[points]


def _upper(held: list = []) -> np.ndarray:  # noqa: B006
    if not held:
        held.append(np.fromiter((chr(i).isupper() for i in range(0x110000)), bool, 0x110000))
    return held[0]


def held_out(doc_id: Column, folds: int, held: int) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds == held, F.lit(False))


def learning_rows(documents: DataFrame, labels: DataFrame, label: str, folds: int, held: int, most: int) -> DataFrame:
    """(text, label) of the documents of at most ``most`` labels outside the held-out part.

    The chosen ids are at most ``most`` rows of two numbers; that bounds what is broadcast.
    """
    usable = labels.where(F.col("doc_id").isNotNull() & F.col(label).isin(0, 1) & ~held_out(F.col("doc_id"), folds, held))
    chosen = usable.select("doc_id", F.col(label).cast("int").alias("label")).orderBy(F.xxhash64("doc_id"), "doc_id", "label").limit(most)
    return documents.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("text", "label")


def _feature_rows(batches):
    for batch, texts in arrowkit.pieces(batches, "text"):
        x = features(texts)
        yield pa.RecordBatch.from_arrays([pa.array(list(x), pa.list_(pa.float64())), batch.column(1)], ["x", "label"])


def train(documents: DataFrame, labels: DataFrame, most: int = SAMPLE) -> gam.Model:
    rows = learning_rows(documents, labels, "quality", FOLDS, HELD, most).mapInArrow(_feature_rows, "x array<double>, label int")
    # a doc_id may stand for several documents; at most ``most`` come to the driver
    rows = rows.orderBy(F.xxhash64("x"), "label").limit(most).toPandas()
    x = np.stack(rows["x"]) if len(rows) else np.zeros((0, len(FEATURES)))
    order = np.lexsort((*x.T, rows["label"])) if len(rows) else []
    return gam.fit(x[order], rows["label"].to_numpy(float)[order])


def _scores(batches, model: gam.Model, name: str):
    for batch, texts in arrowkit.pieces(batches, "text"):
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(model.score(features(texts)))], [*batch.schema.names, name])


def with_score(documents: DataFrame, model: gam.Model, name: str = "score") -> DataFrame:
    """``documents`` with a score; a column of its name is replaced."""
    rest = [f for f in documents.schema.fields if f.name != name]
    schema = T.StructType([*rest, T.StructField(name, T.DoubleType())])
    return documents.select(*(F.col(quoted(f.name)) for f in rest)).mapInArrow(partial(_scores, model=model, name=name), schema)


def report(documents: DataFrame, labels: DataFrame) -> DataFrame:
    scored = with_score(documents.select("doc_id", "text"), train(documents, labels))
    return scored.select("doc_id", held_out(F.col("doc_id"), FOLDS, HELD).alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted"))


def keep_good(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that are not rejected, columns as given."""
    (name,) = unused(documents, "quality_score")
    scored = with_score(documents, train(documents, labels), name)
    return scored.where(F.col(quoted(name)) >= CUT).select(*(F.col(quoted(c)) for c in documents.columns))
