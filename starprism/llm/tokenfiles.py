"""Token ids of whole documents in wavelet matrix files, and reading them back."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from starprism.llm.common import batches, id_and_text, materialize, new_path, texts_of
from starprism.llm.files import open_file, write_file
from starprism.llm.tokens import encoder, tokenizer_path
from starprism.llm.wavelet import WaveletMatrix

END_ID = 0


def _extra(ids: list, lengths: np.ndarray) -> bytes:
    """The shard's documents: how many; ids; which ids are null; numbers of tokens."""
    known = np.array([i is not None for i in ids], np.uint8)
    return np.int64(len(ids)).tobytes() + np.array([i or 0 for i in ids], "<i8").tobytes() + known.tobytes() + lengths.astype("<i8").tobytes()


def shard_documents(shard: WaveletMatrix) -> tuple[list, np.ndarray]:
    """A shard's doc_ids and numbers of tokens (with the end id)."""
    n = int(np.frombuffer(shard.extra, "<i8", 1)[0])
    ids, known = np.frombuffer(shard.extra, "<i8", n, 8), np.frombuffer(shard.extra, np.uint8, n, 8 + 8 * n)
    return [int(i) if k else None for i, k in zip(ids, known, strict=True)], np.frombuffer(shard.extra, "<i8", n, 8 + 9 * n)


def check_ends(shard: WaveletMatrix, lengths: np.ndarray) -> None:
    """Raises unless the matrix holds as many ids as the documents, and the end id at each document's last place, and no
    fewer end ids than documents, by access and rank."""
    ends = np.cumsum(lengths)
    if (int(ends[-1]) if len(ends) else 0) != shard.n or (shard.access_many(ends - 1) != END_ID).any() or shard.count(END_ID) < len(ends):
        raise ValueError("the shard's documents don't end where they should")


def write_token_files(docs: DataFrame, folder: str, path: str, shard_ids: int = 2_000_000, task_bytes: int | None = None) -> DataFrame:
    """Writes shards in ascending doc_id order; returns a row per shard: part, shard, name, n_docs, n_tokens.

    Documents are dealt by ranges of doc_id (and of the text's hash, so that repeated ids can be split) to tasks of
    about ``task_bytes`` of text (12 MB to 1 GB, so that even very large inputs make some ten thousand tasks); a task
    holds one shard at a time, which is closed after the document that brings it to ``shard_ids`` ids.
    """
    docs = id_and_text(docs).withColumn("h", F.xxhash64("text"))
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    task_bytes = task_bytes or min(1 << 30, max(12 << 20, size // 20_000))

    def shards(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, part, shard = encoder(path, spaces=True), TaskContext.get().partitionId(), 0
        ids, lengths, tokens, held = [], [], [], 0

        def close() -> pa.RecordBatch:
            name = f"part-{part:06d}-{shard:05d}.wvm"
            every = np.concatenate(tokens)
            write_file(f"{folder}/{name}", WaveletMatrix.build(every, _extra(ids, np.array(lengths))))
            return pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int64()), "shard": pa.array([shard], pa.int64()), "name": [name], "n_docs": pa.array([len(ids)], pa.int64()), "n_tokens": pa.array([len(every)], pa.int64())})

        for batch in found:
            flat, ends = coder.encode(texts_of(batch))
            flat = np.insert(flat.astype(np.uint32), ends[1:], END_ID)
            ends = ends + np.arange(len(ends))
            at, n = 0, len(ends) - 1
            keys = batch.column(0).to_pylist()
            while at < n:  # as many documents as still belong to the shard
                to = min(n, int(np.searchsorted(ends, ends[at] + shard_ids - held)))
                to = max(to, at + 1)
                ids += keys[at:to]
                lengths += np.diff(ends[at : to + 1]).tolist()
                tokens.append(flat[ends[at] : ends[to]])
                held += int(ends[to] - ends[at])
                at = to
                if held >= shard_ids:
                    yield close()
                    shard, ids, lengths, tokens, held = shard + 1, [], [], [], 0
        if ids:
            yield close()

    batches(docs.sparkSession)
    ordered = docs.repartitionByRange(max(1, -(-size // task_bytes)), "doc_id", "h").sortWithinPartitions("doc_id", "h").select("doc_id", "text")
    return materialize(ordered.mapInArrow(shards, "part long, shard long, name string, n_docs long, n_tokens long"), "shards")


def shard_starts(shards: DataFrame, together: int = 1000) -> DataFrame:
    """name and start (ids of all shards before it): sums within groups of parts, then over the groups."""
    grouped = shards.withColumn("g", F.floor(F.col("part") / together))
    within = Window.partitionBy("g").orderBy("part", "shard").rowsBetween(Window.unboundedPreceding, -1)
    before = Window.orderBy("g").rowsBetween(Window.unboundedPreceding, -1)
    totals = grouped.groupBy("g").agg(F.sum("n_tokens").alias("n")).select("g", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    return grouped.withColumn("inside", F.coalesce(F.sum("n_tokens").over(within), F.lit(0))).join(totals, "g").select("name", (F.col("base") + F.col("inside")).alias("start"))


def read_token_files(spark: SparkSession, folder: str, starts: DataFrame | None = None) -> DataFrame:
    """A row per document, from the files: doc_id, start (of its shard's first id, where ``starts`` gives that, on),
    n_tokens, ids_crc32. Files whose checksum fails raise. Only the list of files is joined with the starts."""

    def documents(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in found:
            for path, start in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                with open_file(path) as f:
                    shard = WaveletMatrix(f.read())
                ids, lengths = shard_documents(shard)
                check_ends(shard, lengths)
                view = memoryview(shard.decode().astype("<u4")).cast("B")
                ends = np.cumsum(lengths)
                crc = [zlib.crc32(view[4 * (e - n) : 4 * e]) for e, n in zip(ends.tolist(), lengths.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(ends - lengths + start, pa.int64()), pa.array(lengths, pa.int64()), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    batches(spark)
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.wvm").load(folder).select("path", F.element_at(F.split("path", "/"), -1).alias("name"))  # executors read one file at a time
    placed = files.join(starts.hint("merge"), "name").select("path", "start") if starts is not None else files.select("path", F.lit(0).cast("long").alias("start"))
    return placed.repartition(max(1, spark.sparkContext.defaultParallelism), "path").mapInArrow(documents, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op10(docs: DataFrame, path: str | None = None) -> DataFrame:
    """Encodes all documents into wavelet matrix files and reads them back; a row per document.

    A null text counts as empty (the end id alone). Null ids come first and repeated ids stay rows of their own. An
    empty table writes no file and gives no row.
    """
    spark = docs.sparkSession
    folder = new_path(spark, "wavelet")
    shards = write_token_files(docs, folder, path or tokenizer_path("byte_bpe_50k.json"))
    if not shards.take(1):
        return spark.createDataFrame([], "doc_id long, start long, n_tokens long, ids_crc32 long")
    return read_token_files(spark, folder, shard_starts(shards))
