"""What the two passage operators share: blocks of documents that ask buckets about their keys.

A block is some megabytes of whole documents (one longer document stands alone). A block sends each bucket of a hash range
one payload of what it has there, once for equal things, so a passage in a third of all documents reaches a bucket once from
each block; the bucket answers each block. Blocks and answers meet again by block number. Nothing passes the driver.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarja.llm.common import arrow_rows, groups, partitions, texts_as_bytes, written

BLOCK_BYTES = 3 << 20
_BLOCK = pa.schema([("block", pa.int64()), ("docs", pa.binary()), ("ends", pa.binary()), ("data", pa.binary()), ("rest", pa.binary())])
_ASK = pa.schema([("bucket", pa.int32()), ("block", pa.int64()), ("payload", pa.binary())])
_ANSWER = pa.schema([("block", pa.int64()), ("bucket", pa.int32()), ("phase", pa.int32()), ("payload", pa.binary())])


def press(data: bytes) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(data)


def expand(data: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(data)


class Block:
    """rest: the rows' other columns, for the last step only."""

    def __init__(self, number: int, docs: bytes, ends: bytes, data: bytes, rest: bytes | None = None):
        self.number, self.docs, self.ends = number, np.frombuffer(docs, np.int64), np.frombuffer(ends, np.int64)
        self.data = np.frombuffer(expand(data), np.uint8)
        self.rest = list(zip(*pa.ipc.open_stream(expand(rest)).read_all().to_pydict().values())) if rest else [()] * len(self.docs)


def _stream(parts: list[pa.RecordBatch]) -> bytes | None:
    if not parts or not parts[0].num_columns:
        return None
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, parts[0].schema) as out:
        for p in parts:
            out.write_batch(p)
    return press(sink.getvalue().to_pybytes())


def blocks(docs: DataFrame, most: int = BLOCK_BYTES) -> DataFrame:
    """(doc_id, text, ...) as a written table of blocks of at most `most` bytes (or one text), which keeps their numbers whatever is run again."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number, ids, texts, size, rest = TaskContext.get().partitionId() << 32, [], [], 0, []
        add, take = arrow_rows(_BLOCK)

        def close():
            nonlocal number, size
            if ids:
                add(number, np.array(ids, np.int64).tobytes(), np.cumsum([len(t) for t in texts], dtype=np.int64).tobytes(), press(b"".join(texts)), _stream(rest))
                number, size = number + 1, 0
                ids.clear()
                texts.clear()
                rest.clear()

        for batch in batches:
            data, ends = texts_as_bytes(batch.column(1))
            other = batch.select(range(2, batch.num_columns))
            a = since = 0
            for k, (i, b) in enumerate(zip(batch.column(0).to_pylist(), ends.tolist())):
                if size + b - a > most:
                    rest.append(other.slice(since, k - since))
                    since = k
                    close()
                ids.append(i)
                texts.append(data[a:b].tobytes())
                size += b - a
                a = b
            rest.append(other.slice(since))
            yield from take()
        close()
        yield from take(True)

    return written(docs.mapInArrow(run, "block long, docs binary, ends binary, data binary, rest binary"), "blocks")


def bucket_bits(df: DataFrame) -> int:
    """Buckets (as a power of two) of which each partition gets some."""
    return max(4, (8 * partitions(df.sparkSession) - 1).bit_length())


def met(table: DataFrame, answers: DataFrame | None, work: Callable, out: str, schema: pa.Schema, rest: bool = False) -> DataFrame:
    """work(block, {phase: {bucket: payload}}) -> rows of `schema`, for each block with the answers to it and, if `rest`, its rows' other columns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        add, take = arrow_rows(schema)
        for _, parts in groups(batches, "block"):
            rows = [r for p in parts for r in p.to_pylist()]
            block = Block(rows[0]["block"], rows[0]["docs"], rows[0]["ends"], rows[0]["data"], rows[0]["rest"])
            told: dict[int, dict[int, bytes]] = {}
            for r in rows[1:]:
                told.setdefault(r["phase"], {})[r["bucket"]] = r["payload"]
            for row in work(block, told):
                add(*row)
                yield from take()
        yield from take(True)

    none = F.lit(None).cast("binary")
    rows = table.select("block", F.lit(-1).alias("bucket"), F.lit(-1).alias("phase"), none.alias("payload"), "docs", "ends", "data", *(["rest"] if rest else [none.alias("rest")]))
    if answers is not None:
        rows = rows.unionAll(answers.select("block", "bucket", "phase", "payload", none.alias("docs"), none.alias("ends"), none.alias("data"), none.alias("rest")))
        rows = rows.repartition("block").sortWithinPartitions("block", "phase", "bucket")
    return rows.mapInArrow(run, out)


def ask(table: DataFrame, answers: DataFrame | None, work: Callable, answer: Callable, phase: int) -> DataFrame:
    """One round: work(block, told) gives (bucket, block, payload); answer([payload]) gives [payload] in the same order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        add, take = arrow_rows(_ANSWER)
        for bucket, parts in groups(batches, "bucket"):
            who = [b for p in parts for b in p.column(1).to_pylist()]
            for block, payload in zip(who, answer([x for p in parts for x in p.column(2).to_pylist()])):
                if payload:
                    add(block, int(bucket), phase, payload)
            yield from take()
        yield from take(True)

    asked = met(table, answers, work, "bucket int, block long, payload binary", _ASK)
    dealt = asked.repartition("bucket").sortWithinPartitions("bucket", "block")
    return written(dealt.mapInArrow(run, "block long, bucket int, phase int, payload binary"), f"answers{phase}")


# ---- which keys occur in two documents ------------------------------------------------------------------------------
def key_payloads(keys: np.ndarray, docs: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray, list[tuple[int, bytes]]]:
    """Sorted distinct keys, each bucket's first index, and the payloads: 39 bits of each key and whether the block itself
    has it in two documents (docs: of each key)."""
    order = np.lexsort((docs, keys))
    k, d = keys[order], docs[order]
    first = np.flatnonzero(np.r_[True, k[1:] != k[:-1]]) if len(k) else np.zeros(0, np.int64)
    last = np.r_[first[1:], len(k)] - 1 if len(k) else first
    own = k[first]
    inside = d[first] != d[last]
    value = ((own & np.uint64((1 << 39) - 1)) << np.uint64(1)) | inside.astype(np.uint64)
    raw = np.ascontiguousarray(value).view(np.uint8).reshape(-1, 8)[:, :5]
    bound = np.searchsorted(own >> np.uint64(64 - bits), np.arange((1 << bits) + 1, dtype=np.uint64))
    return own, bound, [(b, raw[bound[b] : bound[b + 1]].tobytes()) for b in range(1 << bits) if bound[b + 1] > bound[b]]


def shared_answer(payloads: list[bytes]) -> list[bytes]:
    """A bit per key: does it occur in two documents?"""
    sizes = [len(p) // 5 for p in payloads]
    raw = np.zeros((sum(sizes), 8), np.uint8)
    raw[:, :5] = np.frombuffer(b"".join(payloads), np.uint8).reshape(-1, 5)
    value = raw.view(np.uint64).ravel()
    names, where, count = np.unique(value >> np.uint64(1), return_inverse=True, return_counts=True)
    shared = count > 1
    shared[where[(value & np.uint64(1)) == 1]] = True
    return [np.packbits(s).tobytes() if s.any() else b"" for s in np.split(shared[where], np.cumsum(sizes)[:-1])]


def shared_keys(own: np.ndarray, bound: np.ndarray, told: dict[int, bytes]) -> np.ndarray:
    """The distinct keys' flags, from the answers."""
    out = np.zeros(len(own), bool)
    for b, bits in told.items():
        n = int(bound[b + 1] - bound[b])
        out[bound[b] : bound[b + 1]] = np.unpackbits(np.frombuffer(bits, np.uint8), count=n).astype(bool)
    return out
