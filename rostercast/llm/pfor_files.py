"""Token-id files of patched frame-of-reference blocks.

Documents are put in ascending order of their id by a range partitioning (sorted
inside each partition; rows of one id by a hash of the text and their place in
the table, so that such an id may span partitions), encoded, and written as segments of whole documents.  A
segment is one binary image::

    magic, block length, tokens, documents
    per document: id, whether the id is set, number of ids
    per block (the index): start in the data, minimum, width, exceptions
    data: per block the packed differences, then the exceptions (place, value)

A block holds ``BLOCK`` ids.  Its minimum is subtracted; the width is the bit
length of the ``WIDTH_PERCENTILE``-th percentile of the differences; each
difference keeps its low ``width`` bits, and those that need more are stored
whole in the block's exception list.  The index of block starts lets a reader
decode any range of ids without touching the blocks before it.

Images are the rows of a Parquet table, so that Spark commits them task by task
and any store that Spark can reach will do.  Ids before a document are counted
from the segments' own totals: inside a partition while writing, between
partitions by a sum over one row for each partition.

Null texts count as empty, null ids come first, repeated rows are documents of
their own, and an empty table gives an empty result.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rostercast.llm.common import new_folder, partitions, table
from rostercast.llm.tokens import END_ID, vocabulary_path, word_ids

BLOCK = 128
WIDTH_PERCENTILE = 90
SEGMENT_IDS = 1 << 17  # a segment is closed once it holds so many ids
MAGIC = b"PFOR"
HEAD = struct.Struct("<4sHQI")
INDEX = np.dtype([("start", "<u8"), ("low", "<u4"), ("width", "u1"), ("odd", "u1")])
ODD = np.dtype([("at", "u1"), ("value", "<u4")])
DOCS = np.dtype([("id", "<i8"), ("known", "u1"), ("n", "<u4")])


def bit_length(x: np.ndarray) -> np.ndarray:
    return np.ceil(np.log2(x.astype(np.float64) + 1)).astype(np.uint8)


def packed(x: np.ndarray, width: int) -> np.ndarray:
    """The low ``width`` bits of each value of a row, high ones first; 8 values are ``width`` bytes."""
    v = np.ascontiguousarray((x & x.dtype.type((1 << width) - 1)).reshape(len(x), -1, 8).transpose(2, 0, 1))
    out = np.zeros((width, *v.shape[1:]), np.uint8)
    for j in range(width):
        for k in range(8 * j // width, (8 * j + 7) // width + 1):
            shift = (k + 1) * width - 8 * (j + 1)
            out[j] |= (v[k] >> shift if shift >= 0 else v[k] << -shift).astype(np.uint8)  # the low byte
    return out.transpose(1, 2, 0).reshape(len(x), -1)


def values_of(raw: np.ndarray, width: int, block: int) -> np.ndarray:
    """The values of packed rows: each lies in the five bytes from the one that holds its first bit."""
    bit = np.arange(block) * width
    padded = np.pad(raw, ((0, 0), (0, 4)))
    value = np.zeros((len(raw), block), np.uint64 if width > 24 else np.uint32)
    size = 5 if width > 24 else 4
    for i in range(size):
        value = (value << value.dtype.type(8)) | padded[:, (bit >> 3) + i]
    shift = (8 * size - width - (bit & 7)).astype(value.dtype)
    return (value >> shift) & value.dtype.type((1 << width) - 1)


def pack_image(doc_ids: list, lengths: list, ids: np.ndarray) -> bytes:
    """The image of documents ``doc_ids`` whose ids, one after another, are ``ids`` (unsigned 32 bit)."""
    n, blocks = len(ids), -(-len(ids) // BLOCK)
    docs = np.array([(i or 0, i is not None, k) for i, k in zip(doc_ids, lengths, strict=True)], DOCS)
    padded = np.concatenate([ids, np.repeat(ids[-1:], blocks * BLOCK - n)]).reshape(blocks, BLOCK)
    low = padded.min(axis=1, initial=0xFFFFFFFF)
    diff = padded - low[:, None]
    rank = -(-BLOCK * WIDTH_PERCENTILE // 100) - 1
    width = bit_length(np.partition(diff, rank, axis=1)[:, rank])
    odd = diff >= (np.uint64(1) << width.astype(np.uint64))[:, None]
    index = np.zeros(blocks, INDEX)
    index["low"], index["width"], index["odd"] = low, width, odd.sum(axis=1)
    sizes = width.astype(np.uint64) * (BLOCK // 8) + index["odd"].astype(np.uint64) * ODD.itemsize
    index["start"] = np.cumsum(sizes) - sizes
    data = np.zeros(int(sizes.sum()), np.uint8)
    for w in np.unique(width):
        own = np.flatnonzero(width == w)
        if w:
            data[index["start"][own].astype(np.int64)[:, None] + np.arange(int(w) * BLOCK // 8)] = packed(diff[own], int(w))
    for i in np.flatnonzero(index["odd"]).tolist():
        where = np.flatnonzero(odd[i])
        patch = np.zeros(len(where), ODD)
        patch["at"], patch["value"] = where, diff[i, where]
        at = int(index["start"][i]) + int(width[i]) * (BLOCK // 8)
        data[at : at + patch.nbytes] = patch.view(np.uint8)
    return HEAD.pack(MAGIC, BLOCK, n, len(docs)) + docs.tobytes() + index.tobytes() + data.tobytes()


def read_image(image: bytes, first: int = 0, last: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The documents of an image, and its ids from ``first`` to before ``last`` (all by default)."""
    magic, block, n, n_docs = HEAD.unpack_from(image)
    if magic != MAGIC:
        raise ValueError("not a token-id image")
    blocks = -(-n // block)
    docs = np.frombuffer(image, DOCS, n_docs, HEAD.size)
    index = np.frombuffer(image, INDEX, blocks, HEAD.size + docs.nbytes)
    data = np.frombuffer(image, np.uint8, offset=HEAD.size + docs.nbytes + index.nbytes)
    last = n if last is None else min(last, n)
    b0, b1 = first // block, -(-last // block)
    index = index[b0:b1]
    out = np.zeros((len(index), block), np.uint32)
    for w in np.unique(index["width"]):
        own = np.flatnonzero(index["width"] == w)
        if w:
            at = index["start"][own].astype(np.int64)[:, None] + np.arange(int(w) * block // 8)
            out[own] = values_of(data[at], int(w), block)
    for i in np.flatnonzero(index["odd"]).tolist():
        at = int(index["start"][i]) + int(index["width"][i]) * block // 8
        patch = data[at : at + int(index["odd"][i]) * ODD.itemsize].view(ODD)
        out[i, patch["at"]] = patch["value"]
    out += index["low"][:, None]
    return docs, out.reshape(-1)[first - b0 * block : max(last, first) - b0 * block]


SEGMENTS = "part int, segment int, before long, n_ids long, n_docs int, image binary"


def write_token_files(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text", vocabulary: str | None = None) -> None:
    """Encode every text of ``docs``, in ascending order of ``key``, into segments at ``path``."""
    where = vocabulary or vocabulary_path()

    def segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, part, end = word_ids(where), TaskContext.get().partitionId(), struct.pack("<I", END_ID)
        keys, counts, held, size, before, number = [], [], [], 0, 0, 0

        def close() -> pa.RecordBatch:
            image = pack_image(keys, counts, np.frombuffer(b"".join(held), "<u4"))
            return pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "segment": pa.array([number], pa.int32()),
                                               "before": [before], "n_ids": [size], "n_docs": pa.array([len(keys)], pa.int32()),
                                               "image": pa.array([image], pa.binary())})

        for batch in batches:
            for k, t in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = store.encode(t.as_py() or "")
                keys.append(k)
                counts.append(len(ids) // 4 + 1)
                held += (ids, end)
                size += counts[-1]
                if size >= SEGMENT_IDS:
                    yield close()
                    before, number = before + size, number + 1
                    keys, counts, held, size = [], [], [], 0
        if keys:
            yield close()

    n = partitions(docs.sparkSession)
    (docs.select(F.col(key).cast("long").alias("k"), F.col(text).alias("t"))
     .withColumns({"h": F.xxhash64("t"), "tie": F.monotonically_increasing_id()})
     .repartitionByRange(n, "k", "h", "tie").sortWithinPartitions("k", "h", "tie").select("k", "t")
     .mapInArrow(segments, SEGMENTS).write.parquet(path))


def read_token_files(spark: SparkSession, path: str, ids: bool = True) -> DataFrame:
    """``(doc_id, start, ids)`` of every document in the files; ids as little-endian unsigned 32-bit bytes.

    Without ``ids``, their number and the CRC-32 of these bytes instead: ``(doc_id, start, n_tokens, ids_crc32)``.
    """
    files = spark.read.schema(SEGMENTS).parquet(path)
    totals = files.groupBy("part").agg(F.sum("n_ids").alias("n"))  # one row for each partition written
    starts = totals.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("part_start"))

    def documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, before, image in zip(*(batch.column(i) for i in range(3)), strict=True):
                docs, values = read_image(image.as_py())
                ends = np.cumsum(docs["n"].astype(np.int64))
                starts = ends - docs["n"]
                raw = memoryview(values.astype("<u4").tobytes())
                own = [raw[4 * a : 4 * b] for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
                out = {"part": pa.array(np.full(len(docs), part.as_py(), np.int32)),
                       "doc_id": pa.array(docs["id"], mask=docs["known"] == 0), "start": pa.array(starts + before.as_py())}
                if ids:
                    out["ids"] = pa.array([bytes(x) for x in own], pa.binary())
                else:
                    out |= {"n_tokens": pa.array(ends - starts), "ids_crc32": pa.array([zlib.crc32(x) for x in own], pa.int64())}
                yield pa.RecordBatch.from_pydict(out)

    values = ["ids binary"] if ids else ["n_tokens long", "ids_crc32 long"]
    return (files.select("part", "before", "image")
            .mapInArrow(documents, ", ".join(["part int", "doc_id long", "start long", *values]))
            .join(F.broadcast(starts), "part")
            .select("doc_id", (F.col("start") + F.col("part_start")).alias("start"), *[v.split()[0] for v in values]))


def op8_pfor_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_folder(spark, "token-files")
    write_token_files(table(spark, sf_dir, "documents"), path)
    return read_token_files(spark, path, ids=False)
