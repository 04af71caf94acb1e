"""Operator 6: token ids in fixed-width bit packing.

The format is a Parquet dataset of blocks. A block holds whole documents: each id takes the minimum number of bits
that the vocabulary needs, least significant bit first, eight ids to ``width`` bytes. Its row has the shard and the
number of the block, the offset of its first id inside the shard, and id and length of each of its documents (the first
``nameless`` have a null id), so
that any id or document is found by two lookups and unpacked by itself with numpy.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import column, exact_ids, flagged, row_keys, work_dir, written
from .tokens import ChunkEncoder, of_worker, text_groups, tokenizer_path

#: A block is closed with the document that brings it to so many ids.
BLOCK_IDS = 1 << 16
#: A shard has about so many documents, or fewer where the session asks for more partitions.
PART_DOCS = 100_000
BLOCK_SCHEMA = "shard int, block int, first long, n_ids long, width int, nameless int, doc_ids array<long>, lengths array<long>, payload binary"


def pack_bits(ids: np.ndarray, width: int) -> bytes:
    """Ids below ``2**width`` in ``width`` bits each (1 to 32)."""
    n = -(-len(ids) // 8)
    lanes = np.zeros((n, 8), np.uint64)
    lanes.reshape(-1)[: len(ids)] = ids
    out = np.zeros((n, width), np.uint8)
    for k in range(8):
        byte, shift = divmod(k * width, 8)
        value = lanes[:, k] << np.uint64(shift)
        for b in range((shift + width + 7) // 8):
            out[:, byte + b] |= (value >> np.uint64(8 * b)).astype(np.uint8)
    return out.tobytes()


def unpack_bits(payload: bytes, width: int, n: int, start: int = 0) -> np.ndarray:
    """``n`` ids from number ``start`` on, as unsigned 32-bit integers; reads only the groups of eight that hold them."""
    group = start // 8
    end = -(-(start + n) // 8)
    raw = np.frombuffer(payload, np.uint8, (end - group) * width, group * width).reshape(-1, width)
    out = np.empty((end - group, 8), np.uint32)
    mask = np.uint64((1 << width) - 1)
    for k in range(8):
        byte, shift = divmod(k * width, 8)
        value = np.zeros(len(raw), np.uint64)
        for b in range((shift + width + 7) // 8):
            value |= raw[:, byte + b].astype(np.uint64) << np.uint64(8 * b)
        out[:, k] = (value >> np.uint64(shift)) & mask
    at = start - 8 * group
    return out.reshape(-1)[at : at + n]


def bits_for(vocab_size: int) -> int:
    """Fewest bits that hold every id of a vocabulary."""
    return max(1, (vocab_size - 1).bit_length())


def write_token_ids(docs: DataFrame, path: str, tokenizer: str = "byte_bpe_50k.json", *, id_col: str = "doc_id", text_col: str = "text", end_id: int | None = 2, block_ids: int = BLOCK_IDS, parts: int | None = None) -> None:
    """Encode every text and write the ids in ascending order of the documents' ids.

    A null text is empty: it has the end id alone, or nothing without one. Rows of null id come first; rows that
    share an id, or have none, are in an order of their places in the table, so that such rows spread over shards. A
    document is never split, so a block is as long as it must be.
    """
    spark = docs.sparkSession
    keyed = row_keys(docs, "__row")
    rows = keyed.select(column(keyed, id_col, "long").alias("id"), column(keyed, text_col, "string").alias("text"), F.xxhash64("__row").alias("h"))
    parts = parts or max(int(spark.conf.get("spark.sql.shuffle.partitions")), docs.count() // PART_DOCS)
    ranged = rows.repartitionByRange(parts, "id", "h").sortWithinPartitions("id", "h").select(*flagged(F.col("id"), "id"), "text", F.spark_partition_id().alias("shard"))

    def pack(batches):
        coder: ChunkEncoder = of_worker(("chunks", tokenizer), lambda: ChunkEncoder(tokenizer_path(tokenizer), keep_spaces=True))
        width = bits_for(max(coder.vocab_size, (end_id or 0) + 1))
        tail = b"" if end_id is None else np.asarray([end_id], "<u4").tobytes()
        block, first = 0, 0
        keys: list[int | None] = []
        lengths: list[int] = []
        data: list[bytes] = []
        held = 0

        def row() -> pd.DataFrame:
            ids = np.frombuffer(b"".join(data), "<u4")
            return pd.DataFrame({"shard": [shard], "block": [block], "first": [first], "n_ids": [held], "width": [width], "nameless": [keys.count(None)], "doc_ids": [[k or 0 for k in keys]], "lengths": [list(lengths)], "payload": [pack_bits(ids, width)]})

        shard = 0
        for batch in batches:
            shard = int(batch["shard"].iloc[0]) if len(batch) else shard
            ids_of = exact_ids(batch, "id")
            for some in text_groups(batch["text"]):
                texts = batch["text"].iloc[some].tolist()
                for key, ids in zip(ids_of.iloc[some].tolist(), coder.encode_many(texts), strict=True):
                    ids += tail
                    keys.append(None if key is pd.NA else key)
                    lengths.append(len(ids) // 4)
                    data.append(ids)
                    held += len(ids) // 4
                    if held >= block_ids:
                        yield row()
                        block, first, held, keys, lengths, data = block + 1, first + held, 0, [], [], []
        if keys:
            yield row()

    written(ranged.mapInPandas(pack, BLOCK_SCHEMA), path, compression="none")


def read_blocks(spark: SparkSession, path: str) -> DataFrame:
    """The blocks of a written dataset, with ``start``: the number of ids in all shards and blocks before.

    Only the shards' totals are put in order on the driver, one number for each shard.
    """
    blocks = spark.read.schema(BLOCK_SCHEMA).parquet(path)
    totals = sorted((r["shard"], r["n"]) for r in blocks.groupBy("shard").agg(F.sum("n_ids").alias("n")).collect())
    base, at = [], 0
    for shard, n in totals:
        base.append((shard, at))
        at += n
    bases = spark.createDataFrame(base, "shard int, base long")
    return blocks.join(F.broadcast(bases), "shard").withColumn("start", F.col("base") + F.col("first")).drop("base")


def _names(block) -> pd.Series:
    """The documents' ids; those without one come first."""
    names = pd.Series(np.asarray(block.doc_ids, np.int64), dtype="Int64")
    names[: block.nameless] = pd.NA
    return names


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """``doc_id, start, ids (binary: little-endian unsigned 32-bit)`` of every document of a written dataset."""

    def unpack(batches):
        for batch in batches:
            for r in batch.itertuples(index=False):
                ids = unpack_bits(r.payload, r.width, r.n_ids).astype("<u4").tobytes()
                ends = np.cumsum(np.asarray(r.lengths, np.int64))
                starts = ends - np.asarray(r.lengths, np.int64)
                yield pd.DataFrame({"doc_id": _names(r), "start": r.start + starts, "ids": [ids[4 * a : 4 * b] for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]})

    return read_blocks(spark, path).mapInPandas(unpack, "doc_id long, start long, ids binary")


def digest_documents(spark: SparkSession, path: str) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of every document, read from a written dataset."""

    def digest(batches):
        for batch in batches:
            for r in batch.itertuples(index=False):
                ids = memoryview(unpack_bits(r.payload, r.width, r.n_ids).astype("<u4").tobytes())
                lengths = np.asarray(r.lengths, np.int64)
                ends = np.cumsum(lengths)
                starts = ends - lengths
                crc = [zlib.crc32(ids[4 * a : 4 * b]) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
                yield pd.DataFrame({"doc_id": _names(r), "start": r.start + starts, "n_tokens": lengths, "ids_crc32": crc})

    return read_blocks(spark, path).mapInPandas(digest, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op6_binary_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ids of all ``documents``, written in the packed format and read back."""
    import uuid

    path = f"{work_dir(spark)}/token-ids-{uuid.uuid4().hex}"
    write_token_ids(spark.read.parquet(f"{sf_dir}/documents.parquet"), path)
    return digest_documents(spark, path)
