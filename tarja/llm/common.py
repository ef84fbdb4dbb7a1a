"""What the operators share: inputs, shared scratch tables, Arrow grouping and hashing."""

from __future__ import annotations

import hashlib
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The end of a document id's range; a null id takes this value inside an operator and sorts first.
NULL_ID = -(2**63)
#: ASCII white space; words are the runs between.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text) and no other column; null ids become NULL_ID, null texts stay null."""
    return df.select(F.coalesce(F.col(f"`{id_col}`").cast("long"), F.lit(NULL_ID)).alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))


def null_id(column: str = "doc_id"):
    """The id as the caller knows it."""
    return F.when(F.col(column) != NULL_ID, F.col(column)).alias(column)


def shared_root(spark: SparkSession) -> str:
    """The folder that driver and executors share; one of our own only in local runs where none is configured."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        root = spark.conf.get("spark.tarja.scratch", None)
        if not root:
            root = "file://" + tempfile.mkdtemp(prefix="tarja-")
            spark.conf.set("spark.tarja.scratch", root)
    return root


def written(df: DataFrame, name: str) -> DataFrame:
    """Cuts lineage: the rows as a Parquet table in the shared folder, read again. The folder's owner clears it."""
    path = f"{shared_root(df.sparkSession)}/tarja/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Held(list):
    """Tables that are used more than once within an operator and small beside its input: kept by the executors, made again
    from the last written table where one is lost, and released at the end."""

    def __call__(self, df: DataFrame) -> DataFrame:
        self.append(df.persist())
        return df

    def release(self) -> None:
        while self:
            self.pop().unpersist()


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def groups(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[tuple[object, list[pa.RecordBatch]]]:
    """Consecutive rows with one key, over batch borders; the rows of one key are held at a time."""
    held: list[pa.RecordBatch] = []
    now = None
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = batch.column(batch.schema.get_field_index(key)).to_numpy(zero_copy_only=False)
        cuts = [0, *(np.flatnonzero(keys[1:] != keys[:-1]) + 1).tolist(), len(keys)]
        for a, b in zip(cuts, cuts[1:]):
            if held and keys[a] != now:
                yield now, held
                held = []
            now = keys[a]
            held.append(batch.slice(a, b - a))
    if held:
        yield now, held


def arrow_rows(schema: pa.Schema, most_bytes: int = 8 << 20) -> tuple[Callable, Callable]:
    """add(*row) and take(): collects rows; take(True) gives what is left, take() only once enough bytes are held."""
    rows: list[list] = [[] for _ in schema]
    size = [0]

    def add(*row):
        for column, value in zip(rows, row):
            column.append(value)
            if isinstance(value, (bytes, str)):
                size[0] += len(value)
        size[0] += 16

    def take(rest: bool = False):
        if rows[0] and (rest or size[0] >= most_bytes):
            out = pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(rows, schema)], schema=schema)
            for c in rows:
                c.clear()
            size[0] = 0
            return [out]
        return []

    return add, take


# ---- hashing -------------------------------------------------------------------------------------------------------
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A bijection of 64-bit words whose bits depend on all bits of x."""
    with np.errstate(over="ignore"):
        x = (x + np.uint64((0x9E3779B97F4A7C15 * (seed + 1)) & (2**64 - 1))).astype(np.uint64, copy=False)
        x ^= x >> np.uint64(30)
        x *= _M1
        x ^= x >> np.uint64(27)
        x *= _M2
        x ^= x >> np.uint64(31)
    return x


def pair(a: np.ndarray, b: np.ndarray, seed: int = 0) -> np.ndarray:
    """A name for each ordered pair."""
    with np.errstate(over="ignore"):
        return mix(a * np.uint64(0x9FB21C651E98DF25) + (b ^ (b >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93), seed)


_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def words_of(data: np.ndarray, ends: np.ndarray, space: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each word of the texts that stand one after another in data (uint8), and the words' text numbers.
    space: which bytes part words."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    solid = ~space[data]
    first = solid.copy()
    first[1:] &= ~solid[:-1]
    starts_of_texts = np.r_[0, ends[:-1]]
    starts_of_texts = starts_of_texts[starts_of_texts < len(data)]
    first[starts_of_texts] = solid[starts_of_texts]
    last = solid.copy()
    last[:-1] &= ~solid[1:]
    e = ends[(ends > 0)] - 1
    last[e] = solid[e]
    a, b = np.flatnonzero(first), np.flatnonzero(last) + 1
    return a, b, np.searchsorted(ends, a, side="right")


_KEEP = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)  # the lowest k bytes
_ODD = np.array([0x9FB21C651E98DF25, 0xD6E8FEB86659FD93], np.uint64)
_LONG = 256


def word_hashes(data: np.ndarray, a: np.ndarray, b: np.ndarray, lanes: int = 1) -> list[np.ndarray]:
    """`lanes` (1 or 2) independent 64-bit hashes of each word data[a:b]: its bytes, eight at a time, each folded in by a
    bijection of all 64 bits, so that no pattern in long words cancels out; words of over 256 bytes by a cryptographic hash."""
    if not len(a):
        return [np.zeros(0, np.uint64) for _ in range(lanes)]
    size = b - a
    eight = np.ndarray((len(data) + 1,), "<u8", np.r_[data, np.zeros(8, np.uint8)], strides=(1,))
    part = eight[a] & _KEEP[np.minimum(size, 8)]
    with np.errstate(over="ignore"):
        out = [mix(part * _ODD[k] + size.astype(np.uint64) * _ODD[1 - k], 5 + k) for k in range(lanes)]
        at, more = 8, np.flatnonzero(size > 8)
        while len(more) and at < _LONG:
            part = eight[a[more] + at] & _KEEP[np.minimum(size[more] - at, 8)]
            for k in range(lanes):
                out[k][more] = mix((out[k][more] ^ part) * _ODD[k], 5 + k)
            at += 8
            more = more[size[more] > at]
        for i in more.tolist():
            name = hashlib.blake2b(data[a[i] : b[i]].tobytes(), digest_size=16).digest()
            for k in range(lanes):
                out[k][i] = int.from_bytes(name[8 * k : 8 * k + 8], "little")
    return out


def texts_as_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string or binary column in one array, and each row's end; null is empty."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    column = column.cast(pa.large_binary()).fill_null(b"")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets[1:] - offsets[0]


def slices(batch: pa.RecordBatch, most: int = 4 << 20, column: str = "text") -> Iterator[pa.RecordBatch]:
    """The batch cut to about so many bytes of text (a longer text stands alone)."""
    lengths = np.diff(np.r_[0, texts_as_bytes(batch.column(batch.schema.get_field_index(column)))[1]])
    at = 0
    while at < batch.num_rows:
        n = max(1, int(np.searchsorted(np.cumsum(lengths[at:]), most, side="right")))
        yield batch.slice(at, n)
        at += n
