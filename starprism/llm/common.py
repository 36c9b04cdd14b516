"""What the operators of this subpackage share: tables, the shared folder and Arrow batches."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_own_dir: list[str] = []
_shipped: set[str] = set()
_kept: dict[tuple, object] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where it is unset a local run, whose executors are
    this process, gets a folder of its own; a cluster raises, since its executors couldn't read one another's folders."""
    if found := spark.sparkContext.getConf().get("spark.checkpoint.dir"):
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not _own_dir:
        _own_dir.append("file://" + tempfile.mkdtemp(prefix="starprism-"))
    return _own_dir[0]


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"


def materialize(df: DataFrame, name: str, sort: list[str] | None = None) -> DataFrame:
    """Writes a table to the shared folder and reads it back: lineage is cut, and a lost executor loses nothing."""
    spark = df.sparkSession
    path = new_path(spark, name)
    (df.sortWithinPartitions(*sort) if sort else df).write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def checked(df: DataFrame, name: str, most: int = 2_000_000) -> DataFrame:
    """A table of a few numbers a row, written, and broadcast if it has at most ``most`` rows; a larger one is left to a
    shuffled join."""
    written = materialize(df, name)
    return F.broadcast(written) if written.count() <= most else written


def forget(df: DataFrame) -> None:
    """Deletes the files of a table that ``materialize`` wrote and that nothing reads any more."""
    spark = df.sparkSession
    jvm = spark.sparkContext._jvm
    for file in df.inputFiles()[:1]:
        folder = jvm.org.apache.hadoop.fs.Path(file).getParent()
        if folder.toString().split(":")[-1].lstrip("/").startswith(shared_dir(spark).split(":")[-1].lstrip("/")):
            folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ship(spark: SparkSession) -> None:
    """Gives this library's modules to the executors, once for an application, so that their Python finds them wherever it runs."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    root = Path(__file__).resolve().parents[1]
    archive = Path(tempfile.mkdtemp(prefix="starprism-")) / "starprism.zip"
    with zipfile.ZipFile(archive, "w") as z:
        for file in sorted(root.rglob("*.py")):
            z.write(file, f"{root.name}/{file.relative_to(root)}")
    context.addPyFile(str(archive))
    _shipped.add(context.applicationId)


def batches(spark: SparkSession) -> None:
    """Makes the library known to the executors and bounds the bytes of an Arrow batch, which long texts could swell. The
    byte bound is a setting of the session that stays, since plans read it when they run; a bound that was set stays."""
    ship(spark)
    if spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch", "1") in ("1", "1b"):  # not set
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(8 << 20))


def parts_of(found: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    """The batches cut to at most so many rows, whatever the session's setting."""
    for batch in found:
        for a in range(0, batch.num_rows, rows):
            yield batch.slice(a, rows)


def kept(key: tuple, make: Callable):
    """What this worker keeps for its later tasks, made on first use."""
    if key not in _kept:
        _kept[key] = make()
    return _kept[key]


def drop_kept() -> None:
    """Called by name: a nested function that is shipped by value would carry a copy of the dictionary."""
    _kept.clear()


def releasing(each: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], keeps: bool = False) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The function of batches, which at its end gives free memory back to the system: Python workers stay for later tasks
    and stages, and what the allocators keep for themselves would count against the executor all that time. One that
    doesn't use what the worker ``kept`` drops it first: it is left from another stage."""

    def run(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            if not keeps:
                drop_kept()
            yield from each(found)
        finally:
            pa.default_memory_pool().release_unused()
            if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # glibc's
                trim(0)

    return run


def free_name(df: DataFrame, name: str) -> str:
    """The name, with underscores until no column of the table has it (names differ in more than case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def with_row_id(docs: DataFrame, name: str) -> tuple[DataFrame, str]:
    """The documents with a long that tells every row apart, written to the shared folder so that each later reading sees
    the same number; and the column's name, which no column of the documents has."""
    own = free_name(docs, "row_id")
    return materialize(docs.withColumn(own, F.monotonically_increasing_id()), name), own


def row_id_and_text(docs: DataFrame, own: str) -> DataFrame:
    """rid, doc_id and text of documents that carry the row id ``own``."""
    return docs.select(F.col(own).alias("rid"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


_U = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer: every input bit reaches every output bit."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
        return x ^ (x >> _U(31))


def pair_keys(before: np.ndarray, word: np.ndarray) -> np.ndarray:
    """A hash of two hashes in their order."""
    with np.errstate(over="ignore"):
        return mix(before * _U(0x9E3779B97F4A7C15) + word)


def id_and_text(docs: DataFrame) -> DataFrame:
    """doc_id as long and the text; other columns, whatever their names, stay out of the way."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def remainder(doc_id, n: int):
    """crc32 of the id's decimal text, modulo n; null for a null id."""
    return F.crc32(doc_id.cast("string").cast("binary")) % n


def texts_of(batch: pa.RecordBatch, name: str = "text") -> pa.Array:
    """The text column with null as the empty text."""
    return batch.column(batch.schema.get_field_index(name)).cast(pa.string()).fill_null("")


def list_parts(lists: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """A list array's flat values and its offsets from 0."""
    offsets = lists.offsets.to_numpy()
    return lists.values.slice(offsets[0], offsets[-1] - offsets[0]), (offsets - offsets[0]).astype(np.int64)


def spread(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices of the concatenated ranges [start, start + length)."""
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    kind = np.int32 if total < 1 << 31 and (not len(starts) or starts.max() < 1 << 30) else np.int64
    out = np.repeat((starts - (ends - lengths)).astype(kind), lengths)
    out += np.arange(total, dtype=kind)
    return out


class WordCache:
    """Number per distinct word, given in order of arrival; emptied when it holds too many words or characters, so its memory is bounded."""

    def __init__(self, most_words: int = 400_000, most_chars: int = 12_000_000):
        self.most_words, self.most_chars = most_words, most_chars
        self.clear()

    def clear(self) -> None:
        self.at: dict[str, int] = {}
        self.chars = 0

    def full(self) -> bool:
        return len(self.at) > self.most_words or self.chars > self.most_chars

    def numbers(self, words: list[str]) -> tuple[np.ndarray, list[str]]:
        """Each word's number, and the words that are new, in the order of their numbers."""
        at, new = self.at, []
        for w in words:
            if w not in at:
                at[w] = len(at)
                new.append(w)
                self.chars += len(w)
        return np.fromiter((at[w] for w in words), np.int64, len(words)), new


class Rows:
    """Rows of a growing numpy array."""

    def __init__(self, width: tuple[int, ...], dtype):
        self.data, self.n = np.empty((1024, *width), dtype), 0

    def add(self, rows: np.ndarray) -> None:
        if self.n + len(rows) > len(self.data):
            grown = np.empty((max(2 * len(self.data), self.n + len(rows)), *self.data.shape[1:]), self.data.dtype)
            grown[: self.n] = self.data[: self.n]
            self.data = grown
        self.data[self.n : self.n + len(rows)] = rows
        self.n += len(rows)
