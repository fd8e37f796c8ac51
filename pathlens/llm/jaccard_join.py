"""N-gram Jaccard join by chosen paths.

Every text is a set of hashes of five words; the join links texts whose sets
have a Jaccard similarity of ``threshold`` or more.

1. Texts with equal sets collapse to one *class representative* (a count with
   map-side combining, so thousands of copies cost no more than one).
2. A set is embedded as ``COORDINATES`` minhash values, whose low bytes are its
   signature. In each run a tree is walked from a root: at a node every coordinate is kept with a small chance
   that depends on the path and the coordinate only, and sets with the same
   value there go to the same child. About ``BRANCH`` children are taken.
   Nodes of at most ``LIMIT`` sets are compared by brute force on signatures.
   Larger ones compare each set with one of them, the head. If half of them are
   near it, the node is a family and all of it is tied together; else it splits
   again, so that sets with no more than a common passage thin out; what is
   still crowded after ``DEPTH`` levels is tied together too. What is tied is
   only to be compared: nothing is lost, nor reported untested.
   Runs repeat until the target recall. Only edges of a spanning forest leave a
   node, never its pairs.
3. Connected components of these edges hold every link. Inside a component the
   sets themselves are compared, all with all, in parts of about ``BLOCK_SETS``
   sets and at most about ``BLOCK_BYTES`` of hashes; each pair meets in exactly
   one task, which adds to the counts of its two sets and emits a spanning
   forest of true links.
4. Components of the true links are the classes.

A pair at the threshold meets in no node with a chance below ``1 - recall``, and
its signatures differ by more than ``SLACK`` with a chance of about 3e-5; whatever
is reported has been verified on the whole sets.

Defined cases: a null text counts as empty; texts of fewer than five words have
one shingle of all their words; texts without a word agree only if equal as a
string; repeated rows are copies, and ties of doc_id are ordered by text and then
by all columns; a null doc_id keeps its row and can be in a
class, whose id is the least doc_id that is not null; an empty table gives an
empty result; other columns of the input are ignored here.
"""

from __future__ import annotations

import hashlib
import math
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import arrowkit, graph, textkit
from .work import Work, quoted, row_hash, text_of, unused

U = np.uint64
WORDS = 5
THRESHOLD = 0.8
COORDINATES = 128
BRANCH = 2.0
RECALL = 0.9999
LIMIT = 512
#: Levels after which the sets of a crowded node are tied as they are.
DEPTH = 3
#: The share of a crowded node's sets that have to be near its head for a family.
FAMILY = 0.5
BLOCK_SETS = 512
BLOCK_BYTES = 16_000_000
#: Signatures that agree this much less than the threshold are still tied (four standard errors).
SLACK = 4 * math.sqrt(THRESHOLD * (1 - THRESHOLD) / COORDINATES)

_A = textkit.mix(np.arange(1, COORDINATES + 1, dtype=U)) | U(1)
_B = textkit.mix(np.arange(1001, COORDINATES + 1001, dtype=U))


def runs_for(recall: float, threshold: float, branch: float = BRANCH) -> int:
    """Runs after which a pair at the threshold met in some leaf with chance ``recall``.

    All runs walk the same coordinates, of which the pair shares a binomial
    number. Given that, runs are independent, and in each the pair's common path
    dies out as a branching process with Poisson(branch * share) children.
    """
    shared = np.arange(COORDINATES + 1)
    ways = np.array([math.comb(COORDINATES, int(k)) for k in shared], float)
    chance = ways * threshold**shared * (1 - threshold) ** (COORDINATES - shared)
    dead = np.zeros(COORDINATES + 1)
    for _ in range(500):
        dead = np.exp(-branch * shared / COORDINATES * (1 - dead))
    runs = 1
    while float(chance @ dead**runs) > 1 - recall:
        runs += 1
    return runs


def signature(shingles: np.ndarray) -> np.ndarray:
    out = np.full(COORDINATES, 0xFFFFFFFF, np.uint32)
    for i in range(0, len(shingles), 2048):
        part = (shingles[i : i + 2048][None, :] * _A[:, None] + _B[:, None]) >> U(32)
        np.minimum(out, part.min(axis=1).astype(np.uint32), out=out)
    return out


def set_key(shingles: np.ndarray) -> bytes:
    return hashlib.blake2b(shingles.tobytes(), digest_size=16).digest()


def _sketch(batches):
    for batch, texts in arrowkit.pieces(batches, "text"):
        sets = list(textkit.shingle_sets(texts, WORDS))
        marks = [signature(s) for s in sets]
        yield pa.RecordBatch.from_arrays(
            [*batch.columns[:3], pa.array(map(set_key, sets), pa.binary()), pa.array(map(len, sets), pa.int64()), pa.array([s.tobytes() for s in marks], pa.binary()), pa.array([s.astype(np.uint8).tobytes() for s in marks], pa.binary())],
            ["doc_id", "text_key", "row_key", "set_key", "size", "signature", "low"],
        )


def _chance(branch: float) -> int:
    return int(branch / COORDINATES * 2**64)


def children(signatures: np.ndarray, paths: np.ndarray, branch: float = BRANCH) -> tuple[np.ndarray, np.ndarray]:
    """Rows and paths of the children of (signature, path) rows."""
    picks = textkit.mix(paths[:, None] ^ textkit.mix(np.arange(7001, 7001 + COORDINATES, dtype=U))[None, :])
    rows, coordinates = np.nonzero(picks < U(_chance(branch)))
    return rows, textkit.mix(picks[rows, coordinates] ^ textkit.mix(signatures[rows, coordinates].astype(U)))


def _split(batches, runs: int):
    """Rows of the next level: of every run's root where there is no path yet."""
    for whole in batches:
        for at in range(0, whole.num_rows, 2000):
            batch = whole.slice(at, 2000)
            keys = batch.column(0).to_pylist()
            signatures = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint32).reshape(len(keys), COORDINATES)
            if batch.num_columns > 2:
                rows, paths = children(signatures, np.asarray(batch.column(2).to_numpy(zero_copy_only=False)).view(U))
            else:
                found = [children(signatures, np.full(len(keys), textkit.mix(np.array([run + 1], U))[0])) for run in range(runs)]
                rows, paths = (np.concatenate(x) for x in zip(*found))
            yield pa.RecordBatch.from_arrays([pa.array([keys[i] for i in rows], pa.binary()), pa.array(paths.view(np.int64))], ["set_key", "path"])


def forest(n: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Roots (least row) of the components that the links make."""
    root = np.arange(n)
    while True:
        a, b = root[left], root[right]
        if np.array_equal(a, b):
            return root
        np.minimum.at(root, a, b)
        np.minimum.at(root, b, a)
        while not np.array_equal(root, root[root]):
            root = root[root]


def _edges(keys: list[bytes], root: np.ndarray) -> pa.RecordBatch:
    own = np.flatnonzero(root != np.arange(len(keys)))
    return pa.RecordBatch.from_arrays([pa.array([keys[root[i]] for i in own], pa.binary()), pa.array([keys[i] for i in own], pa.binary())], ["a", "b"])


def _compare_signatures(batches, threshold: float):
    """Forest edges of each node's sets whose signatures come near the threshold."""
    need = (threshold - SLACK) * COORDINATES
    out_a: list[bytes] = []
    out_b: list[bytes] = []
    for node in arrowkit.groups(batches, "path"):
        keys = node.column("set_key").to_pylist()
        low = np.frombuffer(b"".join(node.column("low").to_pylist()), np.uint8).reshape(len(keys), COORDINATES)
        left, right = [], []
        for i in range(len(keys) - 1):
            near = np.flatnonzero((low[i + 1 :] == low[i]).sum(axis=1) >= need) + i + 1
            left.append(np.full(len(near), i))
            right.append(near)
        if left and len(l := np.concatenate(left)):
            edges = _edges(keys, forest(len(keys), l, np.concatenate(right)))
            out_a += edges.column(0).to_pylist()
            out_b += edges.column(1).to_pylist()
        if len(out_a) > 20_000:
            yield pa.RecordBatch.from_arrays([pa.array(out_a, pa.binary()), pa.array(out_b, pa.binary())], ["a", "b"])
            out_a, out_b = [], []
    yield pa.RecordBatch.from_arrays([pa.array(out_a, pa.binary()), pa.array(out_b, pa.binary())], ["a", "b"])


def _shingles(batches):
    for batch, texts in arrowkit.pieces(batches, "text"):
        keys = batch.column(batch.schema.get_field_index("set_key"))
        copies = batch.column(batch.schema.get_field_index("copies"))
        root = batch.column(batch.schema.get_field_index("root"))
        part = batch.column(batch.schema.get_field_index("part"))
        parts = batch.column(batch.schema.get_field_index("parts"))
        sets = pa.array([s.tobytes() for s in textkit.shingle_sets(texts, WORDS)], pa.binary())
        yield pa.RecordBatch.from_arrays([keys, copies, root, part, parts, sets], ["set_key", "copies", "root", "part", "parts", "shingles"])


def intersections(rows: list[np.ndarray], others: list[np.ndarray], width: int = 4096) -> np.ndarray:
    """Sizes of the intersections of each of ``rows`` with each of ``others``."""
    every = np.concatenate([*rows, *others])
    _, code, times = np.unique(every, return_inverse=True, return_counts=True)
    order = np.cumsum(times > 1) - 1  # hashes of one set only meet nothing
    shared = times[code] > 1
    code = order[code]
    owner = np.repeat(np.arange(len(rows) + len(others)), [len(r) for r in (*rows, *others)])
    code, owner = code[shared], owner[shared]
    size = int(code.max()) + 1 if len(code) else 0
    total = np.zeros((len(rows), len(others)), np.float32)
    by = np.argsort(code, kind="stable")
    code, owner = code[by], owner[by]
    for at in range(0, size, width):
        lo, hi = np.searchsorted(code, (at, at + width))
        m = np.zeros((len(rows) + len(others), min(width, size - at)), np.float32)
        m[owner[lo:hi], code[lo:hi] - at] = 1
        total += m[: len(rows)] @ m[len(rows) :].T
    return np.rint(total).astype(np.int64)


def _verify(batches, threshold: float):
    """Counts of links and forest edges within a component, or between two of its parts."""
    schema = pa.schema([("set_key", pa.binary()), ("texts", pa.int64()), ("docs", pa.int64()), ("root_key", pa.binary())])
    for group in arrowkit.groups(batches, "task"):
        keys = group.column("set_key").to_pylist()
        sets = arrowkit.binary_rows(group.column("shingles"), U)
        copies = np.array(group.column("copies").to_pylist(), np.int64)
        part = np.array(group.column("part").to_pylist())
        first = np.flatnonzero(part == part.min())
        second = first if part.min() == part.max() else np.flatnonzero(part == part.max())
        sizes = np.array([len(s) for s in sets])
        common = intersections([sets[i] for i in first], [sets[i] for i in second])
        union = sizes[first][:, None] + sizes[second][None, :] - common
        linked = common >= threshold * union - 1e-9
        if second is first:
            np.fill_diagonal(linked, False)
        texts, docs = np.zeros(len(keys), np.int64), np.zeros(len(keys), np.int64)
        texts[first] += linked.sum(1)
        docs[first] += (linked * copies[second][None, :]).sum(1)
        if second is not first:
            texts[second] += linked.sum(0)
            docs[second] += (linked * copies[first][:, None]).sum(0)
        i, j = np.nonzero(linked)
        root = forest(len(keys), first[i], second[j])
        keep = np.flatnonzero(texts > 0)
        yield pa.RecordBatch.from_arrays([pa.array([keys[x] for x in keep], pa.binary()), pa.array(texts[keep]), pa.array(docs[keep]), pa.array([keys[root[x]] for x in keep], pa.binary())], schema=schema)


def _near_head(batches, threshold: float):
    """Whether each set of a crowded node is near the node's head by signature."""
    need = (threshold - SLACK) * COORDINATES
    for batch in batches:
        own, head = (np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint8).reshape(-1, COORDINATES) for i in (3, 4))
        yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array((own == head).sum(axis=1) >= need)], ["path", "set_key", "head", "near"])


def candidate_edges(sketches: DataFrame, work: Work, threshold: float, recall: float) -> DataFrame:
    """Edges that tie together all sets with a link, by chosen paths."""
    runs = runs_for(recall, threshold)
    rows, found, old = sketches, None, []
    low = sketches.select("set_key", "low")
    for depth in range(1, DEPTH + 1):
        paths = work.save(rows.drop("low").mapInArrow(partial(_split, runs=runs), "set_key binary, path long"), f"paths{depth}")
        work.drop(*old)
        sizes = paths.groupBy("path").agg(F.count(F.lit(1)).alias("n"), F.min("set_key").alias("head")).where("n > 1")
        sizes = work.save(sizes, f"nodes{depth}")
        # all three sides grow with the corpus, so none is ever broadcast
        small = paths.join(sizes.where(F.col("n") <= LIMIT).select("path").hint("merge"), "path").join(low.hint("merge"), "set_key").select("path", "set_key", "low")
        edges = small.repartition("path").sortWithinPartitions("path").mapInArrow(partial(_compare_signatures, threshold=threshold), "a binary, b binary")
        large = sizes.where(F.col("n") > LIMIT).join(low.select(F.col("set_key").alias("head"), F.col("low").alias("head_low")), "head")
        crowd = paths.join(large.hint("merge"), "path").join(low.hint("merge"), "set_key").select("path", "set_key", "head", "low", "head_low")
        crowd = work.save(crowd.mapInArrow(partial(_near_head, threshold=threshold), "path long, set_key binary, head binary, near boolean"), f"crowd{depth}")
        # a family is tied as it is; other nodes split again, as long as there are levels
        shares = crowd.groupBy("path").agg((F.avg(F.col("near").cast("int")) >= FAMILY).alias("family"))
        shares = work.save(shares, f"shares{depth}")
        tied = shares if depth == DEPTH else shares.where("family")
        ties = crowd.join(tied.select("path").hint("merge"), "path").where("head <> set_key").select(F.col("head").alias("a"), F.col("set_key").alias("b"))
        edges = work.save(edges.unionByName(ties).distinct(), f"near{depth}")
        found = edges if found is None else found.unionByName(edges)
        work.drop(paths, sizes)
        old = [crowd, shares]
        if depth == DEPTH or shares.where("NOT family").isEmpty():
            work.drop(*old)
            return found
        split = crowd.select("path", "set_key").join(shares.where("NOT family").select("path").hint("merge"), "path")
        rows = split.join(sketches, "set_key").select("set_key", "signature", "path")
    return found


def _classes(documents: DataFrame, threshold: float, recall: float) -> tuple[Work, DataFrame, DataFrame, DataFrame]:
    """The work folder and, written there: members (doc_id, text_key, row_key, set_key), sets with
    their class (set_key, copies, head, class_key, n_texts, docs), and links (a, b)."""
    spark = documents.sparkSession
    work = Work(spark, "jaccard")
    source = documents.select("doc_id", F.xxhash64(text_of(documents)).alias("text_key"), row_hash(documents).alias("row_key"), text_of(documents).alias("text"))
    kinds = "doc_id long, text_key long, row_key long, set_key binary, size long, signature binary, low binary"
    sketch = work.save(source.mapInArrow(_sketch, kinds), "sketch")
    members = work.save(sketch.select("doc_id", "text_key", "row_key", "set_key"), "members")
    order = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "text_key", "row_key")
    heads = work.save(sketch.groupBy("set_key").agg(F.min(order).alias("head"), F.count(F.lit(1)).alias("copies"), F.first("size").alias("size"), F.first("signature").alias("signature"), F.first("low").alias("low")), "heads")
    work.drop(sketch)
    near = candidate_edges(heads.select("set_key", "signature", "low"), work, threshold, recall)
    tied = graph.components(near, work)
    slim = work.save(heads.select("set_key", "copies", "head", "size"), "slim")
    work.drop(near, heads)
    # the parts of a component are bounded in sets and in bytes
    placed = tied.join(slim, tied["node"] == slim["set_key"]).drop("node")
    sizes = placed.groupBy("root").agg(F.greatest(F.ceil(F.count(F.lit(1)) / BLOCK_SETS), F.ceil(F.sum("size") * 8 / BLOCK_BYTES)).cast("int").alias("parts"))
    placed = placed.join(sizes, "root").select("set_key", "copies", "root", F.pmod(F.xxhash64("set_key"), F.col("parts")).cast("int").alias("part"), "parts", F.col("head.doc_id").alias("doc_id"), F.col("head.text_key").alias("text_key"), F.col("head.row_key").alias("row_key"))
    # the sets to compare grow with the corpus, so they are never broadcast
    same = source["doc_id"].eqNullSafe(placed["doc_id"]) & (source["text_key"] == placed["text_key"]) & (source["row_key"] == placed["row_key"])
    wanted = source.join(placed.hint("merge"), same).select("set_key", "copies", "root", "part", "parts", "text")
    sets = work.save(wanted.mapInArrow(_shingles, "set_key binary, copies long, root binary, part int, parts int, shingles binary").dropDuplicates(["set_key"]), "sets")
    # part i meets part j once, in task (min, max)
    tasks = sets.withColumn("other", F.explode(F.expr("sequence(0, parts - 1)"))).withColumn("task", F.concat_ws(":", F.hex("root"), F.least("part", "other"), F.greatest("part", "other"))).drop("root", "parts", "other")
    checked = tasks.repartition("task").sortWithinPartitions("task").mapInArrow(partial(_verify, threshold=threshold), "set_key binary, texts long, docs long, root_key binary")
    checked = work.save(checked, "checked")
    work.drop(tied, sets)
    links = checked.where("set_key <> root_key").select(F.col("root_key").alias("a"), F.col("set_key").alias("b"))
    counts = checked.groupBy("set_key").agg(F.sum("texts").alias("n_texts"), F.sum("docs").alias("docs"))
    classes = graph.components(links, work)
    per_set = slim.join(classes.select(F.col("node").alias("set_key"), F.col("root").alias("class_key")), "set_key", "left").join(counts, "set_key", "left")
    per_set = work.save(per_set.withColumn("class_key", F.coalesce("class_key", "set_key")), "classes")
    work.drop(classes, slim)
    return work, members, per_set, links


def join(documents: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL) -> tuple[DataFrame, DataFrame]:
    """(members, links).

    members: doc_id, text_key (hash of the text), set_key, copies, class_key,
    class_id, n_texts (linked representatives), n_links (linked documents,
    copies of its own text included), keeper (the first document of its class).
    links: a forest of verified links between representatives (a, b).
    """
    work, members, per_set, links = _classes(documents, threshold, recall)
    per_class = per_set.groupBy("class_key").agg(F.min("head").alias("first"))
    per_set = work.save(per_set.join(per_class, "class_key"), "firsts")
    out = members.join(per_set, "set_key").select(
        "doc_id", "text_key", "set_key", "copies", "class_key",
        F.col("first.doc_id").alias("class_id"),
        F.coalesce("n_texts", F.lit(0)).alias("n_texts"),
        (F.coalesce("docs", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
        (F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("text_key") == F.col("first.text_key")) & (F.col("row_key") == F.col("first.row_key"))).alias("keeper"),
    )
    return out, links


def keep_first(documents: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """One document of each class, all its columns; the first by doc_id, text and all columns.

    Rows that repeat whole are combined on the map side, and texts are exchanged once.
    """
    work, members, per_set, _ = _classes(documents, threshold, recall)
    first = per_set.groupBy("class_key").agg(F.min("head").alias("first"))
    kept = work.save(first.select(F.col("first.last").alias("k0"), F.coalesce("first.doc_id", F.lit(0)).alias("k1"), F.col("first.text_key").alias("k2"), F.col("first.row_key").alias("k3")), "kept")
    work.drop(members, per_set)
    keys = unused(documents, "k0", "k1", "k2", "k3")
    values = (F.col("doc_id").isNull(), F.coalesce(F.col("doc_id").cast("long"), F.lit(0).cast("long")), F.xxhash64(text_of(documents)), row_hash(documents))
    keyed = documents.withColumns(dict(zip(keys, values))).dropDuplicates(keys)
    return keyed.join(kept.toDF(*keys).hint("merge"), keys, "left_semi").select(*(F.col(quoted(c)) for c in documents.columns))
