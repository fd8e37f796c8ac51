"""Document fingerprints by threshold-scaled sketches, with DataFrame functions only.

A text is the set of hashes of its runs of five words (lower case letters,
digits and underscores). The sketch keeps every hash below the fraction
``1 / SCALE`` of the hash range, the same for every text, so that sketches can be
united, and the share of one text in another can be estimated however unequal
their lengths. ``least`` is the text's least hash, kept by itself: it tells apart
texts that have no hash below the fraction, and unites by the minimum.

The error of an estimate follows the number of hashes kept: a share of 0.6 over
n shingles is known to about 0.5 * sqrt(SCALE / n). The default suits texts of
some hundred words; for long texts give a larger ``scale``.

Likeness is the share of common hashes below the fraction (Jaccard). Where
neither text has any there, it is 1 if the least hashes agree and 0 if not, which
is right on the average. Containment is null if the first text has none there.

Defined cases: a null text is read as empty; fewer than five words make one
shingle; a text without words is one shingle of its string; equal doc_ids are
ordered by a hash of their text; null doc_ids come first; in a table of one row
the next document is that row; an empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pathlens.operators.ordering import bucketed, sort_key

from .work import text_of

WORDS = 5
SCALE = 2
WORD = r"[\p{L}\p{N}_]+"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def shingles(text: Column) -> Column:
    """Hashes of all runs of five words, with repeats."""
    hashes = F.transform(F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0)), lambda w: F.xxhash64(w))
    runs = lambda h: F.transform(F.sequence(F.lit(0), F.size(h) - WORDS), lambda i: F.xxhash64(*(F.get(h, i + k) for k in range(WORDS))))
    return let(hashes, lambda h: F.when(F.size(h) >= WORDS, runs(h)).when(F.size(h) > 0, F.array(F.xxhash64(h))).otherwise(F.array(F.xxhash64(text, F.lit(1)))))


def bound(scale: int = SCALE) -> Column:
    return F.lit(-(2**63) + 2**64 // scale - 1)


def sketch(text: Column, scale: int = SCALE) -> Column:
    """struct(least, hashes): the least hash, and all in the lowest 1 / scale of the range, in order."""
    kept = lambda all_hashes: F.struct(F.array_min(all_hashes).alias("least"), F.array_sort(F.array_distinct(F.filter(all_hashes, lambda x: x <= bound(scale)))).alias("hashes"))
    return let(shingles(text), kept)


def merge(a: Column, b: Column) -> Column:
    """The sketch of two texts' shingles together; both of one scale."""
    return F.struct(F.least(a["least"], b["least"]).alias("least"), F.array_sort(F.array_union(a["hashes"], b["hashes"])).alias("hashes"))


def counts(a: Column, b: Column) -> Column:
    """struct(both, first, second): how many hashes two sketches share, and have."""
    return F.struct(F.size(F.array_intersect(a["hashes"], b["hashes"])).alias("both"), F.size(a["hashes"]).alias("first"), F.size(b["hashes"]).alias("second"))


def likeness(a: Column, b: Column) -> Column:
    """The estimated Jaccard similarity."""
    some = lambda c: c["both"] / (c["first"] + c["second"] - c["both"]).cast("double")
    return let(counts(a, b), lambda c: F.when(c["first"] + c["second"] > 0, some(c)).otherwise((a["least"] == b["least"]).cast("double")))


def containment(a: Column, b: Column) -> Column:
    """The estimated share of the first text's shingles that the second has; null where the sketch can't tell."""
    return let(counts(a, b), lambda c: F.when(c["first"] > 0, c["both"] / c["first"].cast("double")))


def written(a: Column) -> Column:
    """A sketch as a string: the least hash and the others in 16 hexadecimal digits each."""
    return F.concat(F.lpad(F.hex(a["least"]), 16, "0"), F.array_join(F.transform(a["hashes"], lambda x: F.lpad(F.hex(x), 16, "0")), ""))


def with_next(documents: DataFrame, rows: int = 1024, scale: int = SCALE) -> DataFrame:
    """doc_id, text, sketch and the next document's (text, sketch), by doc_id; the first follows the last.

    Documents are ordered within buckets of neighbouring ids; a bucket's last
    document is followed by the first of the next bucket. Texts are exchanged
    once, and sketches are made where they are needed; there is one row per
    bucket in the list of first documents.
    """
    source = documents.select("doc_id", text_of(documents).alias("text"))
    tie = F.xxhash64("text")
    cut = bucketed(source, F.col("doc_id"), rows, tie).withColumn("at", sort_key(F.col("doc_id"), tie))
    own = F.struct("text", "sketch")
    line = Window.orderBy("__bucket")
    firsts = cut.groupBy("__bucket").agg(F.min("at").alias("at"))
    before = firsts.select(F.coalesce(F.lag("__bucket").over(line), F.max("__bucket").over(Window.partitionBy())).alias("before"), F.col("__bucket").alias("b"), F.col("at").alias("a"))
    # at most MOST_BUCKETS rows; a bucket's first key may stand in several rows, whose texts are equal
    heads = cut.join(F.broadcast(before), (F.col("__bucket") == F.col("b")) & (F.col("at") == F.col("a"))).groupBy(F.col("before").alias("__bucket")).agg(F.min("text").alias("text"))
    heads = heads.select("__bucket", F.struct("text", sketch(F.col("text"), scale).alias("sketch")).alias("first"))
    # the sketch is made after the exchange, so only texts are moved
    dealt = cut.repartition("__bucket").withColumn("sketch", sketch(F.col("text"), scale))
    ordered = dealt.withColumn("following", F.lead(own).over(Window.partitionBy("__bucket").orderBy("at")))
    return ordered.join(heads, "__bucket").select("doc_id", "text", "sketch", F.coalesce("following", "first").alias("next"))


def edit(text: Column, following: Column) -> Column:
    """The text with its last quarter replaced by the first of the next one."""
    quarter = F.floor(F.length(text) / 4).cast("int")
    return F.concat(F.substring(text, F.lit(1), F.length(text) - quarter), F.substring(following, F.lit(1), quarter))


def report(documents: DataFrame, scale: int = SCALE) -> DataFrame:
    """Fingerprints of every text and its edited text, and how alike they and the next one's are."""
    edited = with_next(documents, scale=scale).withColumn("edited", edit(F.col("text"), F.col("next.text")))
    both = edited.select("doc_id", F.length("text").cast("long").alias("n_chars"), "sketch", F.col("next.sketch").alias("next"), let(F.col("edited"), lambda e: F.struct(F.sha2(e.cast("binary"), 256).alias("sha"), sketch(e, scale).alias("sketch"))).alias("e"))
    return both.select(
        "doc_id", "n_chars", F.col("e.sha").alias("edited_sha256"),
        written(F.col("sketch")).alias("fingerprint"), written(F.col("e.sketch")).alias("edited_fingerprint"),
        likeness(F.col("sketch"), F.col("e.sketch")).alias("near_edited"), likeness(F.col("sketch"), F.col("next")).alias("near_next"),
        containment(F.col("sketch"), F.col("e.sketch")).alias("kept_in_edited"),
    )
