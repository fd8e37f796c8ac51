"""Repeated passages by sparse suffix arrays.

A passage of ``LENGTH`` words that stands in two texts, or (``within``) twice in
one text without overlap, is found as follows.

1. Sparse suffixes. Among any ``LENGTH`` words running, the run of ``GRAM``
   words with the least hash marks a suffix (a minimiser). The choice depends on
   the content only, so equal passages mark equal suffixes; about one word in
   twenty does. Suffixes whose first ``GRAM`` words stand nowhere else are left
   out, by a count with map-side combining.
2. Sorting. The suffixes are range-partitioned and sorted by their words, and
   each is compared with its neighbours, across the edges of partitions too. The
   longest prefix shared with a neighbour is the longest shared with any suffix:
   how far a match can reach to the right. Ties are dealt out by text and place,
   so a beginning that a third of all texts share fills many partitions. What
   stands before the suffixes, read backwards, is sorted and compared likewise:
   how far a match can reach to the left.
3. Extension. The match furthest to the right and the one furthest to the left
   may be with different texts, so the runs of ``LENGTH`` words within both
   reaches (each run belongs to one suffix) are confirmed by grouping equal
   ones. A run's class is named by its first occurrence, in order of (hash of
   text, place), and has the number of its occurrences.
4. Adjoining runs of a text merge into its repeated spans; adjoining runs whose
   first occurrences adjoin too are one passage.

Every passage of ``LENGTH`` words or more that two different texts share, or that
one text holds at two places which do not overlap, is found, whole, with no cap on
how many texts share it; all places of such a run are reported, and any two texts
that share a run have a passage with the same first occurrence there. Texts that
are equal as a whole are compared once; each of them is one repeated span if long
enough. Neighbours are compared word by word; grams and runs by 64-bit hashes.

Defined cases: null texts count as empty; texts of fewer than ``LENGTH`` words
have no spans; passages that repeat only inside one text are reported if
``within`` is set, as op9 does; a run that meets itself only in overlapping
places does not repeat; a word of more than ``LONG_WORD`` characters stands as a
digest of itself when sorted; rows that repeat a doc_id and its text are one
document; null doc_ids are kept; an empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import arrowkit, textkit
from .work import Work, text_of

U = np.uint64
LENGTH = 50
GRAM = 12
SPREAD = LENGTH - GRAM + 1
LONG_WORD = 40


def minimisers(words: textkit.Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start of a run of LENGTH words, place of its minimiser, hashes of all grams) of a block."""
    grams = textkit.windows(words.hash, GRAM)
    if len(words.hash) < LENGTH:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), grams
    owner = np.repeat(np.arange(len(words)), np.diff(words.first))
    starts = np.flatnonzero(owner[: len(owner) - LENGTH + 1] == owner[LENGTH - 1 :])
    places = np.lib.stride_tricks.sliding_window_view(grams, SPREAD).argmin(axis=1)[starts] + starts
    return starts, places, grams


def _suffixes(batches):
    for batch, texts in arrowkit.pieces(batches, "text"):
        counts, grams, places = [], [], []
        for a, b in textkit.blocks(texts):
            words = textkit.Words(texts[a:b])
            _, at, hashes = minimisers(words)
            at = np.unique(at)
            cut = np.searchsorted(at, words.first[1:-1])
            first = words.first[:-1]
            counts += np.diff(words.first).tolist()
            grams += np.split(hashes[at].view(np.int64), cut)
            places += [p - f for p, f in zip(np.split(at, cut), first)]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array(counts, pa.int64()), pa.array(grams, pa.list_(pa.int64())), pa.array([p.astype(np.int32) for p in places], pa.list_(pa.int32()))],
            ["doc_id", "text_key", "n_words", "grams", "places"],
        )


def said(word: str) -> str:
    return word if len(word) <= LONG_WORD else "=" + hashlib.blake2b(word.encode("utf-8", "surrogatepass"), digest_size=16).hexdigest()


def written_out(words: textkit.Words) -> tuple[str, np.ndarray]:
    """All words of a block with a blank before the first and after each, and where each starts there (and the end)."""
    length = words.end - words.begin
    if len(length) and int(length.max()) > LONG_WORD:
        text = words.points.tobytes().decode("utf-32-le", "surrogatepass")
        listed = [said(text[a:b]) for a, b in zip(words.begin.tolist(), words.end.tolist())]
        return " " + "".join(w + " " for w in listed), np.cumsum([1, *(len(w) + 1 for w in listed)])
    at = np.concatenate(([1], 1 + np.cumsum(length + 1)))
    out = np.full(int(at[-1]), 32, np.uint32)
    inside = np.arange(int(length.sum())) - np.repeat(np.cumsum(length) - length, length)
    out[np.repeat(at[:-1], length) + inside] = words.points[np.repeat(words.begin, length) + inside]
    return out.tobytes().decode("utf-32-le", "surrogatepass"), at


_CONTEXT = pa.schema([("text_key", pa.int64()), ("place", pa.int32()), ("onward", pa.string()), ("back", pa.string()), ("first", pa.int32()), ("runs", pa.list_(pa.int64()))])


def _contexts(batches):
    """Per wanted suffix: LENGTH words from it on, the words before it backwards (letter by letter), and the hashes of its runs.

    Every word ends with a blank, read backwards too, so that blanks count whole words.
    """
    for batch, texts in arrowkit.pieces(batches, "text"):
        keys = np.asarray(batch.column(batch.schema.get_field_index("text_key")))
        wanted = batch.column(batch.schema.get_field_index("places")).to_pylist()
        for a, b in textkit.blocks(texts):
            words = textkit.Words(texts[a:b])
            starts, at, _ = minimisers(words)
            if not len(starts):
                continue
            places = np.concatenate([np.sort(np.array(p, np.int64)) + f for p, f in zip(wanted[a:b], words.first[:-1].tolist())])
            owner = np.searchsorted(words.first, places, side="right") - 1
            # minimisers rise with the starts of their runs
            lo, hi = np.searchsorted(at, places), np.searchsorted(at, places, side="right")
            total = np.concatenate(([0], np.cumsum(hi - lo)))
            runs = textkit.windows(words.hash, LENGTH)[starts[np.repeat(lo - total[:-1], hi - lo) + np.arange(total[-1])]]
            text, begin = written_out(words)
            middle = begin[places].tolist()
            onward = [text[x:y] for x, y in zip(middle, begin[np.minimum(places + LENGTH, words.first[owner + 1])].tolist())]
            back = [text[x - 1 : y - 1][::-1] for x, y in zip(begin[np.maximum(places - SPREAD + 1, words.first[owner])].tolist(), middle)]
            columns = (keys[a + owner], places - words.first[owner], onward, back, starts[lo] - words.first[owner])
            arrays = [pa.array(c, f.type) for c, f in zip(columns, _CONTEXT)]
            yield pa.RecordBatch.from_arrays([*arrays, pa.ListArray.from_arrays(pa.array(total, pa.int32()), pa.array(runs.view(np.int64)))], schema=_CONTEXT)


def common_words(a: str, b: str) -> int:
    """How many whole words two lists of words begin with together."""
    low, high = 0, min(len(a), len(b))
    if a[:high] == b[:high]:
        return a.count(" ", 0, high)
    while high - low > 1:
        mid = (low + high) // 2
        if a[low:mid] == b[low:mid]:
            low = mid
        else:
            high = mid
    return a.count(" ", 0, low)


_REACH = pa.schema([("text_key", pa.int64()), ("place", pa.int32()), ("reach", pa.int32()), ("edge", pa.int32()), ("part", pa.int32()), ("words", pa.string())])


def _reach(batches):
    """Per row of a sorted partition the longest beginning shared with a neighbour (edge 0); then its first (1) and last (2) row."""
    from pyspark import TaskContext

    part = TaskContext.get().partitionId()
    held, before, first = None, 0, None
    for batch in batches:
        rows = []
        for row in zip(*(batch.column(i).to_pylist() for i in range(3))):
            if held is None:
                first = row
            else:
                shared = common_words(held[2], row[2])
                rows.append((held[0], held[1], max(before, shared), 0, part, None))
                before = shared
            held = row
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _REACH)], schema=_REACH)
    if held is not None:
        rows = [(*held[:2], before, 0, part, None), (*first[:2], 0, 1, part, first[2]), (*held[:2], 0, 2, part, held[2])]
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _REACH)], schema=_REACH)


def neighbours(contexts: DataFrame, column: str, work: Work) -> tuple[DataFrame, DataFrame]:
    """(text_key, place, reach): the longest beginning of ``column``, in words, that another row
    shares, once or twice per row with the greater to be taken; and the table it is read from."""
    spark = contexts.sparkSession
    order = ("words", "text_key", "place")
    ordered = contexts.select("text_key", "place", F.col(column).alias("words")).repartitionByRange(*order).sortWithinPartitions(*order)
    rows = work.save(ordered.mapInArrow(_reach, "text_key long, place int, reach int, edge int, part int, words string"), f"by-{column}")
    # two rows per partition come to the driver: where one ends and the next begins
    edges = rows.where("edge > 0").orderBy("part", "edge").collect()
    over = []
    for last, first in zip(edges[1::2], edges[2::2]):
        shared = common_words(last["words"], first["words"])
        over += [(last["text_key"], last["place"], shared), (first["text_key"], first["place"], shared)]
    kinds = "text_key long, place int, reach int"
    return rows.where("edge = 0").select("text_key", "place", "reach").unionByName(spark.createDataFrame(over, kinds)), rows


_PASSAGES = "array<struct<start:int,end:int,first_doc:bigint,first_start:int,places:bigint>>"
_SPAN = pa.struct([("start", pa.int32()), ("end", pa.int32())])
_PASSAGE = pa.struct([("start", pa.int32()), ("end", pa.int32()), ("first_doc", pa.int64()), ("first_start", pa.int32()), ("places", pa.int64())])


def _merged(batches):
    """Per text, of its repeated runs: spans of adjoining ones, and passages, whose first occurrences adjoin too."""
    for batch in batches:
        if not batch.num_rows:
            continue
        runs = batch.column(1)
        owner = np.repeat(np.arange(batch.num_rows), np.diff(np.asarray(runs.offsets)))
        *numbers, doc = runs.flatten().flatten()
        start, text, place, n = (np.asarray(x).astype(np.int64) for x in numbers)
        order = np.lexsort((start, owner))
        owner, start, text, place, n = (x[order] for x in (owner, start, text, place, n))
        other = owner[1:] != owner[:-1]

        def cut(new: np.ndarray) -> tuple[np.ndarray, pa.Array, pa.Array, pa.Array]:
            """First run, start, end and offsets by text of the ranges that begin at ``new``."""
            first = np.concatenate(([0], np.flatnonzero(new) + 1))
            last = np.append(first[1:] - 1, len(start) - 1)
            offsets = pa.array(np.searchsorted(owner[first], np.arange(batch.num_rows + 1)), pa.int32())
            return first, pa.array(start[first], pa.int32()), pa.array(start[last] + LENGTH, pa.int32()), offsets

        _, begin, end, offsets = cut(other | (np.diff(start) > LENGTH))
        spans = pa.ListArray.from_arrays(offsets, pa.StructArray.from_arrays([begin, end], fields=list(_SPAN)))
        first, begin, end, offsets = cut(other | (np.diff(start) != 1) | (np.diff(place) != 1) | (np.diff(text) != 0) | (np.diff(n) != 0))
        columns = [begin, end, doc.take(pa.array(order[first])), pa.array(place[first], pa.int32()), pa.array(n[first])]
        passages = pa.ListArray.from_arrays(offsets, pa.StructArray.from_arrays(columns, fields=list(_PASSAGE)))
        yield pa.RecordBatch.from_arrays([batch.column(0), spans, passages], ["text_key", "spans", "passages"])


def shared(rows: DataFrame, key: str, place: str | None = None, *more) -> DataFrame:
    """The values of ``key`` that occur with two texts, or LENGTH or more apart by ``place`` in one."""
    ends = [F.min("text_key").alias("__low"), F.max("text_key").alias("__high")]
    if place is None:
        kept = rows.groupBy(key).agg(*ends, *more).where("__low <> __high")
        return kept.drop("__low", "__high")
    # where there is one text only, the first and last place are its own
    ends += [F.min(place).alias("__first"), F.max(place).alias("__last")]
    return rows.groupBy(key).agg(*ends, *more).where(f"__low <> __high OR __last - __first >= {LENGTH}").drop("__low", "__high", "__first", "__last")


def repeats(documents: DataFrame, within: bool = False) -> DataFrame:
    """Per document with a repeated passage: doc_id, text_key, n_words, copies (documents of
    equal text), spans (word ranges, end exclusive), repeated_words, and passages (start, end,
    first_doc and first_start of the first occurrence, places: how often it occurs in different
    texts). Passages that repeat inside one text only count if ``within``."""
    spark = documents.sparkSession
    work = Work(spark, "suffixes")
    source = documents.select("doc_id", F.xxhash64(text_of(documents)).alias("text_key"), text_of(documents).alias("text"))
    docs = work.save(source.mapInArrow(_suffixes, "doc_id long, text_key long, n_words long, grams array<long>, places array<int>"), "suffixes")
    ids = work.save(docs.select("doc_id", "text_key", "n_words").distinct(), "ids")
    heads = ids.groupBy("text_key").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id")).getField("doc_id").alias("head"), F.count(F.lit(1)).alias("copies"))
    suffixes = docs.select("text_key", F.explode(F.arrays_zip("grams", "places")).alias("s")).select("text_key", F.col("s.grams").alias("gram"), F.col("s.places").alias("place"))
    # written tables on both sides, so that a gram of very many texts can be split at run time
    grams = work.save(shared(suffixes, "gram", "place" if within else None), "grams")
    places = suffixes.join(grams.hint("merge"), "gram").groupBy("text_key").agg(F.collect_set("place").alias("places"))
    named = lambda doc_id: (F.col(doc_id).isNull().alias("none"), F.coalesce(doc_id, F.lit(0)).alias("id"))
    wanted = places.join(heads.select("text_key", "head"), "text_key").select(*named("head"), "text_key", "places")
    # rows that repeat are combined on the map side; texts grow with the corpus, so neither side is ever broadcast
    once = source.select(*named("doc_id"), "text_key", "text").dropDuplicates(["none", "id", "text_key"])
    texts = once.join(wanted.hint("merge"), ["none", "id", "text_key"]).select("text_key", "text", "places")
    contexts = work.save(texts.mapInArrow(_contexts, "text_key long, place int, onward string, back string, first int, runs array<long>"), "contexts")
    work.drop(docs, grams)
    (onward, sorted_on), (back, sorted_back) = (neighbours(contexts, column, work) for column in ("onward", "back"))
    onward = onward.select("text_key", "place", F.col("reach").alias("onward"), F.lit(0).alias("back"))
    back = back.select("text_key", "place", F.lit(0).alias("onward"), F.col("reach").alias("back"))
    reaches = onward.unionByName(back).groupBy("text_key", "place").agg(F.max("onward").alias("onward"), F.max("back").alias("back")).where(f"onward + back >= {LENGTH}")
    runs = contexts.select("text_key", "place", "first", "runs").join(reaches.hint("merge"), ["text_key", "place"]).select("text_key", "place", "onward", "back", "first", F.posexplode("runs").alias("at", "run"))
    runs = runs.withColumn("start", F.col("first") + F.col("at")).where(f"place - start <= back AND start + {LENGTH} <= place + onward").select("run", "text_key", "start")
    runs = work.save(runs, "runs")
    work.drop(contexts, sorted_on, sorted_back)
    first = F.min(F.struct("text_key", "start")).alias("of")
    equal = shared(runs, "run", "start" if within else None, first, F.count(F.lit(1)).alias("places")).select("run", F.col("of.text_key").alias("of_text"), F.col("of.start").alias("of_start"), "places")
    # the first documents are named here, where no text stands more often than it has words
    equal = work.save(equal.join(heads.select(F.col("text_key").alias("of_text"), F.col("head").alias("first_doc")).hint("merge"), "of_text"), "equal")
    met = runs.join(equal.hint("merge"), "run").groupBy("text_key").agg(F.collect_list(F.struct("start", "of_text", "of_start", "places", "first_doc")).alias("runs"))
    found = work.save(met.mapInArrow(_merged, f"text_key long, spans array<struct<start:int,end:int>>, passages {_PASSAGES}"), "found")
    work.drop(runs, equal)
    whole = F.array(F.struct(F.lit(0).alias("start"), F.col("n_words").cast("int").alias("end")))
    placed = ids.join(heads.select("text_key", "copies"), "text_key").join(found, "text_key", "left")
    copied = (F.col("copies") > 1) & (F.col("n_words") >= LENGTH)
    spans = F.when(copied, whole).otherwise(F.col("spans"))
    out = placed.withColumn("spans", spans).where("spans IS NOT NULL")
    words = F.aggregate("spans", F.lit(0), lambda a, s: a + s["end"] - s["start"]).cast("long").alias("repeated_words")
    return out.select("doc_id", "text_key", "n_words", "copies", "spans", words, "passages")
