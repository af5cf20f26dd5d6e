"""Exact deduplication by composable polynomial fingerprints.

A text is cut into chunks. Each chunk gets a polynomial hash for each of two primes, and the chunk
hashes of a text combine by length-shifted arithmetic, H(ab) = H(a) * B**len(b) + H(b), so that the
chunks of a huge text are hashed by different tasks. Texts with equal fingerprints are then compared
chunk by chunk: in each (fingerprint, chunk number) the smallest and the largest chunk must be the same.
A fingerprint whose texts differ is split by the texts' own SHA-256.

Texts are read twice: to be hashed, and, those of repeated fingerprints, to be compared; only the latter are shuffled. Groups of copies are never
gathered: their rows are counted, and their chunks compared, on the map side first.

Null texts count as empty; empty texts are equal to each other. Repeated rows count as copies; among
equal texts with the same largest id, one row stays; rows without an id come before all others. An empty table gives an empty result. Other
columns of the input are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import written

CHUNK = 1 << 16
#: Texts over this many bytes are dealt out chunk by chunk.
HUGE = 1 << 22
BASE = (911_382_323, 972_663_749)
PRIME = (2_147_483_647, 2_147_483_629)


@cache
def _powers(primes: tuple[int, int]) -> list[np.ndarray]:
    """B**(CHUNK-1) ... B**0 for each prime, by doubling."""
    out = []
    for base, prime in zip(BASE, primes, strict=True):
        p = np.ones(1, dtype=np.int64)
        while len(p) < CHUNK:
            p = np.concatenate([p, p * pow(base, len(p), prime) % prime])
        out.append(p[:CHUNK][::-1].copy())
    return out


def chunk_hashes(data: bytes, primes: tuple[int, int] = PRIME) -> tuple[int, int]:
    """The two hashes of at most CHUNK bytes. Bytes count from 1, so that leading zero bytes matter."""
    b = np.frombuffer(data, dtype=np.uint8).astype(np.int64) + 1
    # 2**16 products below 2**40 stay below 2**63
    return tuple(int(b @ p[CHUNK - len(b) :]) % q for p, q in zip(_powers(primes), primes, strict=True))


def combine(parts: list[tuple[int, int, int]], primes: tuple[int, int] = PRIME) -> tuple[int, int, int]:
    """Fingerprint of a concatenation from the (hash, hash, length) of its parts, in order."""
    h, n = [0, 0], 0
    for one, two, length in parts:
        h = [(x * pow(b, length, q) + y) % q for x, y, b, q in zip(h, (one, two), BASE, primes, strict=True)]
        n += length
    return h[0], h[1], n


def fingerprint(data: bytes, primes: tuple[int, int] = PRIME) -> tuple[int, int, int]:
    return combine([(*chunk_hashes(data[i : i + CHUNK], primes), min(CHUNK, len(data) - i)) for i in range(0, len(data), CHUNK)], primes)


def _hashing(primes: tuple[int, int]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [fingerprint(x.as_buffer().to_pybytes(), primes) for x in batch.column("data")]
            h1, h2, n = (np.array(x, dtype=np.int64) for x in zip(*found, strict=True)) if found else (np.zeros(0, np.int64),) * 3
            columns = [c for c in batch.schema.names if c != "data"]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in columns), pa.array(h1), pa.array(h2), pa.array(n)], names=[*columns, "h1", "h2", "n_bytes"])

    return run


def fingerprints(rows: DataFrame, primes: tuple[int, int] = PRIME, huge_bytes: int = HUGE) -> DataFrame:
    """doc_id, text_sha256, data (binary) -> doc_id, text_sha256, rid, h1, h2, n_bytes. Huge texts are hashed by chunk, in parallel."""
    named = rows.withColumn("rid", F.monotonically_increasing_id())
    out = "doc_id long, text_sha256 string, rid long, h1 long, h2 long, n_bytes long"
    whole = named.where(F.octet_length("data") <= huge_bytes).select("doc_id", "text_sha256", "rid", "data").mapInArrow(_hashing(primes), out)
    huge = named.where(F.octet_length("data") > huge_bytes)
    chunks = huge.select("doc_id", "text_sha256", "rid", F.posexplode(_cuts(F.col("data"))).alias("k", "data")).repartition("rid", "k")
    hashed = chunks.mapInArrow(_hashing(primes), "doc_id long, text_sha256 string, rid long, k int, h1 long, h2 long, n_bytes long")
    parts = hashed.groupBy("doc_id", "text_sha256", "rid").agg(F.sort_array(F.collect_list(F.struct("k", "h1", "h2", "n_bytes"))).alias("parts"))
    return whole.unionByName(parts.select("doc_id", "text_sha256", "rid", _combined(F.col("parts"), primes).alias("c")).select("doc_id", "text_sha256", "rid", "c.*"))


def _combined(parts, primes: tuple[int, int]):
    """combine() as a fold over the sorted chunk hashes of one text."""

    def power(n, base: int, prime: int):  # base**n by squaring; n <= CHUNK
        value = F.lit(1).cast("long")
        for bit in range(CHUNK.bit_length()):
            value = value * F.when(F.shiftrightunsigned(n, bit) % 2 == 1, F.lit(pow(base, 1 << bit, prime))).otherwise(F.lit(1)) % prime
        return value

    def step(acc, x):
        shifted = [((acc[h] * power(x["n_bytes"], b, q)) % q + x[h]) % q for h, b, q in zip(("h1", "h2"), BASE, primes, strict=True)]
        return F.struct(shifted[0].alias("h1"), shifted[1].alias("h2"), (acc["n_bytes"] + x["n_bytes"]).alias("n_bytes"))

    zero = F.lit(0).cast("long")
    return F.aggregate(parts, F.struct(zero.alias("h1"), zero.alias("h2"), zero.alias("n_bytes")), step)


def _cuts(data):
    n = F.greatest(F.ceil(F.octet_length(data) / CHUNK).cast("int"), F.lit(1))
    return F.transform(F.sequence(F.lit(0), n - 1), lambda k: F.substring(data, k * CHUNK + 1, F.lit(CHUNK)))


KEY = ["h1", "h2", "n_bytes"]


def _differing(rows: DataFrame, prints: DataFrame, groups: DataFrame) -> DataFrame:
    """Fingerprints that texts share which differ in some chunk. The smallest and largest chunk are found
    on the map side first, so a large group of copies sends two chunks from each task."""
    repeated = prints.join(groups.select(*KEY), KEY, "left_semi").select(F.col("doc_id").alias("id"), F.col("text_sha256").alias("sha"), *KEY).distinct()
    again = rows.join(repeated, rows["doc_id"].eqNullSafe(repeated["id"]) & (rows["text_sha256"] == repeated["sha"]))
    spread = again.select(*KEY, F.posexplode(_cuts(F.col("data"))).alias("k", "chunk")).groupBy(*KEY, "k").agg(F.min("chunk").alias("low"), F.max("chunk").alias("high"))
    return spread.where("low <> high").select(*KEY).distinct()


def _groups(prints: DataFrame, key: list[str]) -> DataFrame:
    """Groups of several rows: key, top (the row that stays), group_size. Written, so that the join of the rows with it can be split where a group is large."""
    found = prints.groupBy(*key).agg(F.max(F.struct("doc_id", "rid")).alias("top"), F.count("*").alias("group_size"))
    return written(found.where("group_size > 1"))


def exact_dedup(docs: DataFrame, primes: tuple[int, int] = PRIME, huge_bytes: int = HUGE) -> DataFrame:
    """One row per row of docs: doc_id, keep_id, group_size, kept, text_sha256."""
    data = F.coalesce(docs["text"], F.lit("")).cast("binary")
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), F.sha2(data, 256).alias("text_sha256"), data.alias("data"))
    prints = written(fingerprints(rows, primes, huge_bytes))  # written once, so that a row keeps its rid
    key, groups = KEY, _groups(prints, KEY)
    bad = written(_differing(rows, prints, groups))
    if not bad.isEmpty():  # different texts under one fingerprint are told apart by their digests
        bad = bad.withColumn("differs", F.lit(True))
        prints = prints.join(bad, KEY, "left").withColumn("part", F.when(F.col("differs"), F.col("text_sha256")).otherwise("")).drop("differs")
        key = [*KEY, "part"]
        groups = _groups(prints, key)
    top = F.coalesce("top", F.struct("doc_id", "rid"))
    return prints.join(groups, key, "left").select("doc_id", top["doc_id"].alias("keep_id"), F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"), (top["rid"] == F.col("rid")).alias("kept"), "text_sha256")


def without_copies(docs: DataFrame) -> DataFrame:
    """docs without the rows that exact_dedup drops, all columns. Of rows that share id and text, one stays."""
    found = exact_dedup(docs)
    # what is said of rows of one id and text: whether one of them stays, and how many there are
    said = found.groupBy(F.col("doc_id").alias("id"), F.col("text_sha256").alias("sha")).agg(F.max("kept").alias("stays"), F.count("*").alias("n"))
    said = written(said.where("NOT stays OR n > 1"))
    digest = F.sha2(F.coalesce(docs["text"], F.lit("")).cast("binary"), 256)
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), docs["doc_id"].cast("long").alias("doc"), digest.alias("digest"))
    here = F.col("doc").eqNullSafe(F.col("id")) & (F.col("digest") == F.col("sha"))
    left = rows.join(said, here, "left_anti")
    several = said.where("stays")
    if not several.isEmpty():  # of these rows only, one each
        left = left.unionByName(rows.join(several, here, "left_semi").dropDuplicates(["doc", "digest"]))
    return left.select("row.*")


def op5_exact_dedup(spark, sf_dir):
    return exact_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP5_SQL = """
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))
"""
