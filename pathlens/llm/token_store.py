"""Token ids in a content-addressed store.

Texts become id streams, each with an end id. A rolling hash over the last
``WINDOW`` ids cuts a stream where its low bits are zero, so equal passages give
equal chunks wherever they stand. A store is a folder:

``objects/``   Parquet rows (chunk, width, ids): each unique chunk once; ``chunk``
               is the SHA-256 of its ids as little-endian unsigned 32-bit
               integers, ``ids`` the ids in ``width`` bytes each. Rows without
               ids are references left by further occurrences.
``recipes/``   rows in ascending doc_id order: row, number (0, 1, ...), doc_id, start,
               n_tokens, chunks (chunk, n in order), root (Merkle root of the chunks).
``manifest/``  Merkle nodes (level, node, hash): level 0 hashes the roots of
               ``FAN`` neighbouring documents, each further level ``FAN`` nodes
               of the one below, up to a single node.

A task keeps the ids only of the first occurrence of a chunk that it meets, so
what is shuffled by chunk are at most as many copies as there are tasks.
Further occurrences are spread by document.

Defined cases: null and empty texts have the end id only; rows that repeat a
doc_id are documents of their own, in an order by their content and their place
in the input; null doc_ids come first; an empty table gives an empty store
with an empty manifest; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import zlib
from functools import lru_cache, partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pathlens.operators.ordering import running_totals

from . import arrowkit, bpe, textkit
from .work import Work, text_of

U = np.uint64
END_ID = 2
WINDOW = 16
#: A cut needs this many zero bits: chunks of 2 ** 9 ids on the average beyond the least.
BITS = 9
LEAST, MOST = 128, 4096
FAN = 1024
LOCAL_CHUNKS = 400_000


def cuts(ids: np.ndarray) -> list[int]:
    """Ends of the chunks of one id stream."""
    n = len(ids)
    if n <= LEAST:
        return [n]
    rolled = textkit.windows(textkit.mix(ids.astype(U) + U(1)), WINDOW)
    ends = np.flatnonzero((rolled & U((1 << BITS) - 1)) == 0) + WINDOW
    out, last, at = [], 0, 0
    while last < n:
        at = int(np.searchsorted(ends, last + LEAST))
        end = min(int(ends[at]) if at < len(ends) else n, last + MOST, n)
        out.append(end)
        last = end
    return out


def merkle(hashes: list[bytes]) -> bytes:
    """Root of a binary Merkle tree; a last node without a partner moves up."""
    level = hashes
    while len(level) > 1:
        pairs = [hashlib.sha256(b"\x01" + level[i] + level[i + 1]).digest() for i in range(0, len(level) - 1, 2)]
        level = pairs + level[len(level) - len(level) % 2 :]
    return hashlib.sha256(b"\x00" + level[0]).digest()


_ENTRY = pa.schema([("doc_id", pa.int64()), ("row", pa.int64()), ("place", pa.int32()), ("chunk", pa.binary()), ("n", pa.int32()), ("width", pa.int32()), ("ids", pa.binary()), ("root", pa.binary())])


def _chunks(batches, tokenizer: str, end_id: int):
    encode = bpe.encoder(tokenizer)
    met: set[bytes] = set()
    for batch, texts in arrowkit.pieces(batches, "text"):
        columns: list[list] = [[] for _ in _ENTRY]
        for doc_id, row, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), encode.encode(texts)):
            ids = np.append(ids, np.uint32(end_id)).astype("<u4")
            first, names, at = 0, [], len(columns[0])
            for place, end in enumerate(cuts(ids)):
                part = ids[first:end]
                name = hashlib.sha256(part.tobytes()).digest()
                new = name not in met
                if new:
                    if len(met) >= LOCAL_CHUNKS:
                        met.clear()
                    met.add(name)
                width = 2 if part.max() < 65536 else 4
                for column, value in zip(columns, (doc_id, row, place, name, end - first, width, part.astype(f"<u{width}").tobytes() if new else None, None)):
                    column.append(value)
                names.append(name)
                first = end
            columns[7][at] = merkle(names)
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _ENTRY)], schema=_ENTRY)


def write(documents: DataFrame, path: str, tokenizer: str, end_id: int = END_ID) -> None:
    """Encodes ``documents`` (doc_id, text) and writes the store to ``path``."""
    spark = documents.sparkSession
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.monotonically_increasing_id().alias("row"), text_of(documents).alias("text"))
    kinds = "doc_id long, row long, place int, chunk binary, n int, width int, ids binary, root binary"
    entries = rows.mapInArrow(partial(_chunks, tokenizer=tokenizer, end_id=end_id), kinds)
    whose = Window.partitionBy("chunk", "apart").orderBy("row", "place")
    entries = entries.withColumn("apart", F.when(F.col("ids").isNull(), F.col("row"))).withColumn("ids", F.when((F.row_number().over(whose) == 1) & F.col("ids").isNotNull(), F.col("ids"))).drop("apart")
    entries.write.option("compression", "zstd").parquet(f"{path}/objects")
    entries = spark.read.parquet(f"{path}/objects").select("doc_id", "row", "place", "chunk", "n", "root")
    docs = entries.groupBy("doc_id", "row").agg(F.sort_array(F.collect_list(F.struct("place", "chunk", "n"))).alias("chunks"), F.max("root").alias("root"), F.sum(F.col("n").cast("long")).alias("n_tokens"))
    docs = docs.withColumn("chunks", F.transform("chunks", lambda c: F.struct(c["chunk"].alias("chunk"), c["n"].alias("n"))))
    work = Work(spark, "recipes")
    docs = work.save(docs, "unordered")
    # where each document starts: sums inside buckets of neighbouring ids, then over the buckets
    placed = running_totals(docs, F.col("doc_id"), F.xxhash64("root", "row"), {"start": F.col("n_tokens"), "number": F.lit(1)}, 4096)
    placed = placed.select("row", "number", "doc_id", "start", "n_tokens", "chunks", "root")
    placed.repartitionByRange(F.col("start")).sortWithinPartitions("start").write.option("compression", "zstd").parquet(f"{path}/recipes")
    work.drop(docs)
    manifest(spark, path)


def manifest(spark: SparkSession, path: str) -> None:
    """Writes the Merkle nodes over the documents' roots."""
    recipes = spark.read.parquet(f"{path}/recipes").select("number", "root")
    hashed = F.sha2(F.concat(F.lit("node"), F.concat_ws("", F.transform(F.sort_array(F.collect_list(F.struct("at", "hash"))), lambda x: x["hash"]))), 256)
    level = recipes.select(F.expr(f"number div {FAN}").alias("node"), F.col("number").alias("at"), F.hex("root").alias("hash")).groupBy("node").agg(hashed.alias("hash"))
    number = 0
    while True:
        level.select(F.lit(number).alias("level"), "node", "hash").write.mode("append").parquet(f"{path}/manifest")
        level = spark.read.parquet(f"{path}/manifest").where(F.col("level") == number).select("node", "hash")
        if len(level.take(2)) < 2:
            return
        level = level.select(F.expr(f"node div {FAN}").alias("up"), F.col("node").alias("at"), "hash").groupBy("up").agg(hashed.alias("hash")).withColumnRenamed("up", "node")
        number += 1


def _stored(batches):
    """Checks each stored chunk against its name and gives its CRC-32."""
    for batch in batches:
        names, sums, sizes = [], [], []
        for name, width, data in zip(*(batch.column(i).to_pylist() for i in range(3))):
            raw = np.frombuffer(data, f"<u{width}").astype("<u4").tobytes()
            if hashlib.sha256(raw).digest() != name:
                raise ValueError(f"chunk {name.hex()} is damaged")
            names.append(name)
            sums.append(zlib.crc32(raw))
            sizes.append(len(raw))
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.binary()), pa.array(sums, pa.int64()), pa.array(sizes, pa.int64())], ["chunk", "crc", "bytes"])


@lru_cache(maxsize=8192)
def _shift(n: int) -> np.ndarray:
    """What n zero bytes do to each bit of a CRC-32."""
    zeros = bytes(n)
    base = zlib.crc32(zeros, 0)
    return np.array([zlib.crc32(zeros, 1 << b) ^ base for b in range(32)], np.uint32)


def joined_crc(parts: list[list[tuple[int, int]]]) -> list[int]:
    """CRC-32 of each document from the (crc, bytes) of its chunks in order."""
    total = np.zeros(len(parts), np.uint32)
    for k in range(max(map(len, parts), default=0)):
        rows = np.array([i for i, p in enumerate(parts) if k < len(p)])
        table = np.stack([_shift(parts[i][k][1]) for i in rows])
        old, moved = total[rows], np.zeros(len(rows), np.uint32)
        for b in range(32):
            moved ^= np.where((old >> np.uint32(b)) & np.uint32(1), table[:, b], np.uint32(0))
        total[rows] = moved ^ np.array([parts[i][k][0] for i in rows], np.uint32)
    return total.tolist()


def _documents(batches):
    for whole in batches:
        for at in range(0, whole.num_rows, 1000):
            batch = whole.slice(at, 1000)
            lists = [sorted((c["place"], c["chunk"], c["n"], c["crc"], c["bytes"]) for c in x) for x in batch.column(4).to_pylist()]
            for chunks, root, n in zip(lists, batch.column(5).to_pylist(), batch.column(3).to_pylist()):
                if merkle([c[1] for c in chunks]) != root or sum(c[4] for c in chunks) != 4 * n:
                    raise ValueError("a recipe does not match its Merkle root")
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), batch.column(3), pa.array(joined_crc([[c[3:5] for c in x] for x in lists]), pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])


def digests(spark: SparkSession, path: str) -> DataFrame:
    """Per document of a store, read back and verified: doc_id, start, n_tokens, ids_crc32.

    Every stored chunk is read, compared with its name and summed once; a
    document's sum is put together from its chunks' sums.
    """
    chunks = spark.read.parquet(f"{path}/objects").where("ids IS NOT NULL").select("chunk", "width", "ids").mapInArrow(_stored, "chunk binary, crc long, bytes long")
    recipes = spark.read.parquet(f"{path}/recipes")
    listed = recipes.select("row", F.posexplode("chunks").alias("place", "c")).select("row", "place", F.col("c.chunk").alias("chunk"), F.col("c.n").alias("n"))
    found = listed.join(chunks, "chunk").groupBy("row").agg(F.collect_list(F.struct("place", "chunk", "n", "crc", "bytes")).alias("found"))
    whole = recipes.select("row", "doc_id", "start", "n_tokens", "root").join(found, "row").select("doc_id", "row", "start", "n_tokens", "found", "root")
    return whole.mapInArrow(_documents, "doc_id long, start long, n_tokens long, ids_crc32 long")


def read(spark: SparkSession, path: str) -> DataFrame:
    """Documents of a store as (doc_id, start, n_tokens, ids array)."""
    chunks = spark.read.parquet(f"{path}/objects").where("ids IS NOT NULL").select("chunk", F.col("width").alias("w"), F.col("ids").alias("data"))
    recipes = spark.read.parquet(f"{path}/recipes")
    listed = recipes.select("row", F.posexplode("chunks").alias("place", "c")).select("row", "place", F.col("c.chunk").alias("chunk"))
    found = listed.join(chunks, "chunk").groupBy("row").agg(F.sort_array(F.collect_list(F.struct("place", "w", "data"))).alias("parts"))

    def ids(batches):
        for batch in batches:
            lists = [np.concatenate([np.frombuffer(p["data"], f"<u{p['w']}").astype(np.int64) for p in x]) for x in batch.column(3).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array([x.tolist() for x in lists], pa.list_(pa.int64()))], ["doc_id", "start", "n_tokens", "ids"])

    return recipes.join(found, "row").select("doc_id", "start", "n_tokens", "parts").mapInArrow(ids, "doc_id long, start long, n_tokens long, ids array<long>")


def encode_and_read(documents: DataFrame, tokenizer: str) -> DataFrame:
    """Writes a store into the shared folder and returns its digests."""
    path = Work(documents.sparkSession, "tokens").path("store")
    write(documents, path, tokenizer)
    return digests(documents.sparkSession, path)
