"""Token-id files with keyed access.

A file set is a folder of Parquet files whose rows are blocks, in ascending key
order by (shard, block): the raw ids of consecutive documents as one binary
value (16 bits an id where the vocabulary allows, else 32, little-endian), and an
index of the block. The index is a minimal perfect hash of the document keys; each slot holds a
fingerprint and the place of the key's first document among the block's starts.
Spark's committer writes the files, so a lost task leaves nothing behind, and
any store that Spark reaches will do.

Keys are cut into shards at quantiles, tokenization runs before the shuffle, and
a block is closed at ``BLOCK_IDS``, so memory is bounded by a block or by one
document. Defined results: null and empty texts hold the end id alone; repeated
keys lie side by side, ordered by their ids; null keys come first and are
reached by scans, not by key.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm import perfect_hash, tokenizing
from tidemark.llm import text as tx

BLOCK_IDS = 1 << 20
END_ID = 0
BLOCK = (
    "shard int, block int, first_key long, last_key long, n_docs long, n_ids long, width int, keys array<bigint>, starts binary, "
    "hash_bits binary, hash_levels binary, fingerprints binary, places binary, ids binary"
)


def id_width(vocabulary: str) -> int:
    """Bytes of an id: 2 where the whole vocabulary fits, else 4."""
    return 2 if tokenizing.encoder(vocabulary).library.get_vocab_size() <= 1 << 16 else 4


def encode(docs: DataFrame, vocabulary: str, width: int, end_id: int | None = END_ID, cuts: list[int] | None = None) -> DataFrame:
    """doc_id, ids (unsigned little-endian integers of ``width`` bytes), shard for each row of ``docs(doc_id, text)``.

    The shard is the number of ``cuts``, ascending keys, below the key; null keys are in the first one.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("ids", pa.binary()), ("shard", pa.int32())])
    edges = np.array(cuts or [], dtype=np.int64)
    end = b"" if end_id is None else int(end_id).to_bytes(4, "little")

    def narrow(ids: bytes) -> bytes:
        return ids if width == 4 else np.frombuffer(ids, dtype="<u4").astype("<u2").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one = tokenizing.encoder(vocabulary)
        for ids, texts in tx.rows(batches, "doc_id", "text"):
            keys = np.array([-(2**63) if k is None else k for k in ids], dtype=np.int64)
            yield tx.batch(schema, ids, [narrow(one.ids(t) + end) for t in texts], np.searchsorted(edges, keys, side="left").astype(np.int32))

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, ids binary, shard int")


def write(docs: DataFrame, path: str, vocabulary: str, block_ids: int = BLOCK_IDS) -> None:
    """Write the file set of ``docs(doc_id, text)`` to a new folder."""
    spark = docs.sparkSession
    shards = int(spark.conf.get("spark.sql.shuffle.partitions"))
    cuts = docs.select(F.expr(f"approx_percentile(doc_id, array({', '.join(str(i / shards) for i in range(1, shards + 1))}), {20 * shards})")).first()[0]
    cuts = sorted(set(cuts or []))[:-1]

    width = id_width(vocabulary)
    dealt = encode(docs, vocabulary, width, cuts=cuts)
    ordered = dealt.repartition(max(1, len(cuts) + 1), "shard").sortWithinPartitions("shard", F.asc_nulls_first("doc_id"), "ids")
    schema = _arrow(BLOCK, spark)

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int | None, bytes]] = []
        size, shard, number = 0, None, 0
        for shards_, keys, ids in tx.rows(batches, "shard", "doc_id", "ids"):
            for s, k, v in zip(shards_, keys, ids, strict=True):
                if held and (s != shard or size >= block_ids):
                    yield _block(schema, shard, number, held, width)
                    number = number + 1 if s == shard else 0
                    held, size = [], 0
                shard = s
                held.append((k, v))
                size += len(v) // width
        if held:
            yield _block(schema, shard, number, held, width)

    ordered.mapInArrow(blocks, BLOCK).write.parquet(path)


def _arrow(ddl: str, spark: SparkSession) -> pa.Schema:
    kinds = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary(), "array<bigint>": pa.list_(pa.int64())}
    return pa.schema([(name, kinds[kind]) for name, kind in (f.split(" ") for f in ddl.split(", "))])


def _block(schema: pa.Schema, shard: int, number: int, held: list[tuple[int | None, bytes]], width: int) -> pa.RecordBatch:
    ids = b"".join(v for _, v in held)
    keys = [k for k, _ in held]
    starts = np.concatenate(([0], np.cumsum([len(v) // width for _, v in held]))).astype("<i8")
    named = np.array([i for i, k in enumerate(keys) if k is not None and (i == 0 or keys[i - 1] != k)], dtype=np.int64)
    distinct = np.array([keys[i] for i in named], dtype=np.int64)
    bits, levels = perfect_hash.build(distinct)
    slot = perfect_hash.slots(distinct, bits, levels)
    prints, places = np.zeros(len(distinct), dtype="<u4"), np.zeros(len(distinct), dtype="<i8")
    prints[slot], places[slot] = perfect_hash.fingerprints(distinct), named
    row = (shard, number, keys[named[0]] if len(named) else None, keys[-1], len(held), len(ids) // width, width, keys, starts.tobytes(),
           np.packbits(bits).tobytes(), levels.astype("<i8").tobytes(), prints.tobytes(), places.tobytes(), ids)
    return tx.batch(schema, *([v] for v in row))


def _one_by_one(b: pa.RecordBatch) -> Iterator[dict]:
    for i in range(b.num_rows):
        yield b.slice(i, 1).to_pylist()[0]


class Block:
    """One block in memory."""

    def __init__(self, row: dict):
        self.keys, self.ids = row["keys"], np.frombuffer(row["ids"], dtype=f"<u{row['width']}")
        self.starts, self.levels = np.frombuffer(row["starts"], dtype="<i8"), np.frombuffer(row["hash_levels"], dtype="<i8")
        self.bits = np.unpackbits(np.frombuffer(row["hash_bits"], dtype=np.uint8))[: self.levels[-1]]
        self.prints, self.places = np.frombuffer(row["fingerprints"], dtype="<u4"), np.frombuffer(row["places"], dtype="<i8")

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Place of the first document of each key among the block's documents, -1 where it is not here."""
        if not len(self.prints):
            return np.full(len(keys), -1)
        slot = perfect_hash.slots(keys, self.bits, self.levels)
        here = (slot >= 0) & (self.prints[slot] == perfect_hash.fingerprints(keys))
        return np.where(here, self.places[slot], -1)

    def document(self, place: int) -> np.ndarray:
        return self.ids[self.starts[place] : self.starts[place + 1]].astype("<u4")


def scan(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document; each is reached through the index of its block."""
    stored = spark.read.parquet(path)
    order = Window.orderBy("shard", "block").rowsBetween(Window.unboundedPreceding, -1)
    bases = stored.select("shard", "block", "n_ids").withColumn("base", F.coalesce(F.sum("n_ids").over(order), F.lit(0)))
    schema = pa.schema([("shard", pa.int32()), ("block", pa.int32()), ("doc_id", pa.int64()), ("at", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in _one_by_one(b):
                one = Block(row)
                n = len(one.keys)
                place = np.arange(n)
                first = np.array([i for i, k in enumerate(one.keys) if k is not None and (i == 0 or one.keys[i - 1] != k)], dtype=np.int64)
                if len(first):
                    place[first] = one.find(np.array([one.keys[i] for i in first], dtype=np.int64))
                if (place < 0).any():
                    raise ValueError("the index does not hold a key of its block")
                crc = [zlib.crc32(one.document(p).tobytes()) for p in place]
                yield tx.batch(schema, [row["shard"]] * n, [row["block"]] * n, one.keys, one.starts[place], np.diff(one.starts)[place], crc)

    rows = stored.mapInArrow(read, "shard int, block int, doc_id long, at long, n_tokens long, ids_crc32 long")
    joined = rows.join(bases.select("shard", "block", "base"), ["shard", "block"])
    return joined.select("doc_id", (F.col("base") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")


def get(spark: SparkSession, path: str, keys: list[int]) -> DataFrame:
    """doc_id, ids of the named documents (all rows of a repeated key); only blocks whose key range holds one are read."""
    wanted = np.unique(np.array(keys, dtype=np.int64))
    if not len(wanted):
        return spark.createDataFrame([], "doc_id long, ids array<bigint>")
    stored = spark.read.parquet(path).filter((F.col("first_key") <= int(wanted[-1])) & (F.col("last_key") >= int(wanted[0])))
    schema = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int64()))])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in _one_by_one(b):
                near = wanted[(wanted >= row["first_key"]) & (wanted <= row["last_key"])]
                if not len(near):
                    continue
                one = Block(row)
                for key, place in zip(near.tolist(), one.find(near).tolist(), strict=True):
                    while 0 <= place < len(one.keys) and one.keys[place] == key:
                        yield tx.batch(schema, [key], [one.document(place).tolist()])
                        place += 1

    return stored.mapInArrow(read, "doc_id long, ids array<bigint>")
