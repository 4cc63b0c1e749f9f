"""Pieces that the text operators share: tables, durable intermediates, words, hashes."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import tempfile
import uuid
import zlib
from collections.abc import Callable
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows up to which an id list is broadcast (8 bytes a row, so at most 16 MB); beyond, it is shuffled.
BROADCAST_ROWS = 2_000_000
#: Entries of a worker's word memo, after which it starts anew.
MEMO_WORDS = 400_000


#: How to clear what operators remember in this Python worker between tasks, by operator; and whose task ran last.
_HELD: dict[str, Callable[[], None]] = {}
_LAST = [""]


def hold(owner: str, clear: Callable[[], None]) -> None:
    """An operator remembers something in this worker; `clear` lets it go."""
    _HELD[owner] = clear


def release(owner: str = "") -> None:
    """At the start of a task: let go what other operators hold in this worker, and give the memory back that their tasks have freed. Workers outlive stages, so that in a pipeline each
    would otherwise keep what every stage before has remembered or needed for a while. Without a name an operator holds nothing itself."""
    if _LAST[0] == owner and not _HELD.keys() - {owner}:
        return
    _LAST[0] = owner
    for other in _HELD.keys() - {owner}:
        _HELD.pop(other)()
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # not every system has it
        ctypes.CDLL(None).malloc_trim(0)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Only a local session may do without one, and gets a temporary folder."""
    sc = spark.sparkContext
    path = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not path:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="factloom-"))
        path = sc.getCheckpointDir()
    return path.rstrip("/")


def intermediates(spark: SparkSession) -> str:
    """Where this application writes its intermediate tables."""
    return f"{shared_dir(spark)}/factloom/{spark.sparkContext.applicationId}"


def cleanup(spark: SparkSession) -> None:
    """Delete the intermediate tables of this application; to be called when no frame that came from them is needed any more."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(intermediates(spark))
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def durable(df: DataFrame, label: str) -> DataFrame:
    """Write df as Parquet into the shared folder and read it again: lineage is cut, and a lost executor costs nothing that was written."""
    spark = df.sparkSession
    path = f"{intermediates(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def parts_for(spark: SparkSession, rows: int, each: int = 250_000) -> int:
    """Partitions for so many rows: one for each `each` rows, up to spark.sql.shuffle.partitions."""
    return max(1, min(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // each)))


def gathered(df: DataFrame, parts: int, *keys: str) -> DataFrame:
    """df hashed by keys into so few partitions, for the joins and groups on these keys that follow. From spark.sql.shuffle.partitions
    on df stays as it is, so that large inputs keep partial aggregation and the skew handling of adaptive execution."""
    return df.repartition(parts, *keys) if parts < int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) else df


def keep_ids(df: DataFrame, ids: DataFrame, key: str, n_ids: int) -> DataFrame:
    """Rows of df whose key is in ids; ids are broadcast only when n_ids is at most BROADCAST_ROWS."""
    return df.join(F.broadcast(ids) if n_ids <= BROADCAST_ROWS else ids, key, "left_semi")


def texts_of(batch: pa.RecordBatch, column: str = "text") -> list[bytes]:
    """UTF-8 bytes of a text column; null counts as empty."""
    return [x or b"" for x in batch.column(batch.schema.get_field_index(column)).cast(pa.binary()).to_pylist()]


def column_of(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def split_column(df: DataFrame, mod: int) -> "F.Column":
    """crc32(doc_id as text) mod `mod`; a null doc_id counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), F.lit(mod))


def split_of(doc_ids: list, mod: int) -> np.ndarray:
    return np.array([zlib.crc32(b"" if i is None else str(i).encode()) % mod for i in doc_ids], np.int64)


class WordHashes(dict):
    """64-bit hash of a word, remembered; bounded."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= MEMO_WORDS:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


def hashed_words(docs: list[list[bytes]], memo: WordHashes) -> tuple[np.ndarray, np.ndarray]:
    """All words' hashes in one array, and where each document starts in it (with the end)."""
    starts = np.zeros(len(docs) + 1, np.int64)
    np.cumsum([len(d) for d in docs], out=starts[1:])
    return np.fromiter(map(memo.__getitem__, chain.from_iterable(docs)), np.uint64, int(starts[-1])), starts


_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit moves every output bit."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def rolling(h: np.ndarray, k: int, base: int) -> np.ndarray:
    """Polynomial hash of every k consecutive entries, mod 2**64."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out, b = h[:n].copy(), np.uint64(base)
    for j in range(1, k):
        out *= b
        out += h[j : j + n]
    return out
