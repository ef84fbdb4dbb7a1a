"""Operator 4, suffix-array dedup: removes every byte covered by a `length`-byte string that also starts in a smaller doc_id.

Each window of `length` bytes is keyed by its minimizer, the 24-gram of it with the least hash. A Spark round finds the
minimizers that two documents share; runs of windows with one such minimizer (`length` + a few bytes each) go to the bucket
of that minimizer, where all equal windows of the corpus so meet. A block sends a run once, with its smallest doc_id. A
bucket sorts the suffixes of its distinct runs by external induced sorting (tarja.llm.suffix), takes groups of suffixes with
a common prefix of `length` bytes, and answers which windows also start in a smaller document. Buckets are sized by the
partition count, and the sort's queues spill to a scratch file, so a bucket may be larger than its memory share.

Strings are judged on the input and never cross documents. Null text counts as empty; only strictly smaller ids remove, so
rows with equal ids leave each other alone; a null id acts as the smallest; empty table: no rows. Other columns go along unread.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.pandas.types import to_arrow_schema

from tarja.llm.blocks import Block, ask, blocks, bucket_bits, expand, key_payloads, met, press, shared_answer, shared_keys
from tarja.llm.common import documents, mix, null_id, pair, table
from tarja.llm.suffix import same_prefix, sorted_suffixes

GRAM = 24
BLOCK_BYTES = 2 << 20  # some ten arrays of a number for each byte are held for a block
_AT = np.uint64((1 << 30) - 1)


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """A hash of the GRAM bytes at each position (the last ones are of no use)."""
    n = len(data)
    padded = np.r_[data, np.zeros(GRAM, np.uint8)]
    eight = np.ndarray((n + GRAM - 7,), "<u8", padded, strides=(1,))
    with np.errstate(over="ignore"):
        h = eight[:n] * np.uint64(0x9FB21C651E98DF25)
        h ^= h >> np.uint64(29)
        h += eight[8 : n + 8] * np.uint64(0xD6E8FEB86659FD93)
        h ^= h >> np.uint64(31)
        h *= np.uint64(0x9E3779B97F4A7C15)
        h += eight[16 : n + 16] * np.uint64(0xA0761D6478BD642F)
    return mix(h, 21)


class Windows:
    """A block's windows in runs of one minimizer: first and past window start, the minimizer's place and hash, the document."""

    def __init__(self, block: Block, length: int):
        data, ends, n = block.data, block.ends, len(block.data)
        self.block, self.length = block, length
        stop = np.repeat(ends, np.diff(np.r_[0, ends]))
        start = np.flatnonzero(np.arange(n) + length <= stop)
        self.h = h = gram_hashes(data) if n else np.zeros(0, np.uint64)
        # the leftmost least gram of the length - GRAM + 1 of a window, its place in the low bits
        w = length - GRAM + 1
        least = (h & ~_AT) | (np.arange(n, dtype=np.uint64) & _AT)
        span = 1
        while span < w:
            step = min(span, w - span)
            wider = least.copy()
            wider[: max(0, n - step)] = np.minimum(least[: max(0, n - step)], least[step:])
            least, span = wider, span + step
        place = (least[start] & _AT).astype(np.int64)
        cut = np.flatnonzero(np.r_[True, (np.diff(place) != 0) | (np.diff(start) != 1)]) if len(start) else np.zeros(0, np.int64)
        self.first, self.place = start[cut], place[cut]
        self.past = start[np.r_[cut[1:], len(start)] - 1] + 1 if len(start) else cut
        self.text = np.searchsorted(ends, self.first, side="right")
        self.key, self.doc = h[self.place], block.docs[self.text]

    def shared_runs(self, shared: dict[int, bytes], bits: int, run_bits: int):
        """The runs with a shared minimizer by content: their indices in order, each content's first, its bucket bounds."""
        own, bound, _ = key_payloads(self.key, self.doc, bits)
        flags = shared_keys(own, bound, shared)
        runs = np.flatnonzero(flags[np.searchsorted(own, self.key)]) if len(own) else np.zeros(0, np.int64)
        # content: length, minimizer's place and the grams that cover the run, in two lanes
        size = self.past[runs] - self.first[runs]
        last = self.past[runs] + self.length - 1 - GRAM
        one = pair(size.astype(np.uint64), (self.place[runs] - self.first[runs]).astype(np.uint64), 31)
        two = mix(one.copy(), 32)
        for k in range(-(-(2 * self.length - GRAM) // GRAM)):
            gram = self.h[np.minimum(self.first[runs] + k * GRAM, last)]
            one, two = pair(one, gram, 33), pair(two, gram, 34)
        name = np.stack([self.key[runs], one, two])
        order = np.lexsort((self.doc[runs], *name[::-1]))
        runs, name = runs[order], name[:, order]
        first = np.flatnonzero(np.r_[True, (name[:, 1:] != name[:, :-1]).any(0)]) if len(runs) else np.zeros(0, np.int64)
        bucket = np.searchsorted(self.key[runs[first]] >> np.uint64(64 - run_bits), np.arange((1 << run_bits) + 1, dtype=np.uint64))
        return runs, first, bucket


def _join(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    ends = np.cumsum(sizes)
    return data[np.repeat(starts - (ends - sizes), sizes) + np.arange(ends[-1] if len(ends) else 0)]


def later_windows(data: np.ndarray, sizes: np.ndarray, docs: np.ndarray, length: int) -> np.ndarray:
    """For each window of the distinct strings in data (one after another): does it start in a string of a smaller doc too?
    Flags at the positions of data."""
    n = len(data)
    out = np.zeros(n, bool)
    if not n:
        return out
    # strings are set apart by a symbol of their own below all bytes, the end by a smaller one
    s = np.ones(n + len(sizes) + 1, np.uint16)
    ends = np.cumsum(sizes)
    at = np.arange(n) + np.repeat(np.arange(len(sizes)), sizes)
    s[at] = data.astype(np.uint16) + 2
    s[-1] = 0
    left = np.zeros(len(s), np.int64)
    left[at] = np.repeat(ends, sizes) - np.arange(n)
    order = sorted_suffixes(s, length)
    order = order[left[order] >= length]
    back = np.zeros(len(s), np.int64)
    back[at] = np.arange(n)
    order = back[order]
    doc = np.repeat(docs, sizes)[order]
    first = np.flatnonzero(~same_prefix(data, order, length))
    if len(first):
        least = np.minimum.reduceat(doc, first)
        out[order] = doc > np.repeat(least, np.diff(np.r_[first, len(order)]))
    return out


def _read(payload: bytes, length: int):
    raw = expand(payload)
    k = int(np.frombuffer(raw[:8], np.int64)[0])
    docs = np.frombuffer(raw[8 : 8 + 8 * k], np.int64)
    sizes = np.frombuffer(raw[8 + 8 * k : 8 + 10 * k], np.uint16).astype(np.int64)
    place = np.frombuffer(raw[8 + 10 * k : 8 + 12 * k], np.uint16).astype(np.int64)
    return docs, sizes, place, np.frombuffer(raw[8 + 12 * k :], np.uint8)


def answer_runs(payloads: list[bytes], length: int) -> list[bytes]:
    """A bit for each window of each run sent."""
    parts = [_read(p, length) for p in payloads]
    docs, sizes, place = (np.concatenate([p[i] for p in parts]) for i in range(3))
    data = np.concatenate([p[3] for p in parts])
    starts = np.cumsum(sizes) - sizes
    text = data.tobytes()
    strings = [text[a : a + k] for a, k in zip(starts.tolist(), sizes.tolist())]
    which: dict[bytes, int] = {}
    number = np.fromiter((which.setdefault(x, len(which)) for x in strings), np.int64, len(strings))
    least = np.full(len(which), np.iinfo(np.int64).max)
    np.minimum.at(least, number, docs)
    head = np.unique(number, return_index=True)[1]  # one run of each content
    gram = mix(gram_hashes(data)[starts + place], 1) if len(data) else np.zeros(0, np.uint64)
    _, family, count = np.unique(gram[head], return_inverse=True, return_counts=True)
    multiple = head[count[family] > 1]  # a run that is alone with its minimizer shares no window with another
    flags = np.zeros(len(data), bool)
    if len(multiple):
        found = later_windows(_join(data, starts[multiple], sizes[multiple]), sizes[multiple], least[number[multiple]], length)
        at = np.repeat(starts[multiple], sizes[multiple]) + np.arange(int(sizes[multiple].sum())) - np.repeat(np.cumsum(sizes[multiple]) - sizes[multiple], sizes[multiple])
        flags[at] = found
    n_windows = sizes - length + 1
    ends = np.cumsum(n_windows)
    inside = np.arange(ends[-1]) - np.repeat(ends - n_windows, n_windows)
    out = flags[np.repeat(starts[head][number], n_windows) + inside] | np.repeat(docs > least[number], n_windows)
    return [np.packbits(x).tobytes() if x.any() else b"" for x in np.split(out, np.cumsum([int((p[1] - length + 1).sum()) for p in parts])[:-1])]


def removed_bytes(docs: DataFrame, length: int, out: str, schema: pa.Schema, finish) -> DataFrame:
    """finish(block, removed flags of its bytes) -> rows, for each block."""
    held = blocks(docs, BLOCK_BYTES)
    bits = bucket_bits(docs)
    run_bits = bits + 2  # a run is far larger than a key

    def ask_keys(block, told):
        w = Windows(block, length)
        for bucket, payload in key_payloads(w.key, w.doc, bits)[2]:
            yield bucket, block.number, payload

    shared = ask(held, None, ask_keys, shared_answer, 0)

    def ask_runs(block, told):
        w = Windows(block, length)
        runs, first, bound = w.shared_runs(told.get(0, {}), bits, run_bits)
        mine = runs[first]
        sizes = w.past[mine] - w.first[mine] + length - 1
        for b in range(1 << run_bits):
            lo, hi = int(bound[b]), int(bound[b + 1])
            if hi > lo:
                r = mine[lo:hi]
                body = _join(block.data, w.first[r], sizes[lo:hi])
                yield b, block.number, press(np.array([hi - lo], np.int64).tobytes() + w.doc[r].tobytes() + sizes[lo:hi].astype(np.uint16).tobytes() + (w.place[r] - w.first[r]).astype(np.uint16).tobytes() + body.tobytes())

    answers = shared.unionAll(ask(held, shared, ask_runs, lambda p: answer_runs(p, length), 1))

    def cut(block, told):
        w = Windows(block, length)
        runs, first, bound = w.shared_runs(told.get(0, {}), bits, run_bits)
        each = w.past[runs] - w.first[runs]
        count = np.diff(np.r_[first, len(runs)])
        late = w.doc[runs] > np.repeat(w.doc[runs[first]], count) if len(runs) else np.zeros(0, bool)
        sizes = each[first]
        offset = np.r_[0, np.cumsum(sizes)]
        bits_of = np.zeros(int(offset[-1]), bool)
        for b, payload in told.get(1, {}).items():
            lo, hi = int(offset[bound[b]]), int(offset[bound[b + 1]])
            bits_of[lo:hi] = np.unpackbits(np.frombuffer(payload, np.uint8), count=hi - lo).astype(bool)
        head = np.repeat(np.arange(len(first)), count)
        inside = np.arange(int(each.sum())) - np.repeat(np.cumsum(each) - each, each)
        gone = np.repeat(late, each) | bits_of[np.repeat(offset[head], each) + inside]
        start = (np.repeat(w.first[runs], each) + inside)[gone]
        edge = np.zeros(len(block.data) + 1, np.int32)
        np.add.at(edge, start, 1)
        np.add.at(edge, start + length, -1)
        yield from finish(block, np.cumsum(edge[:-1]) > 0)

    return met(held, answers, cut, out, schema, True)


def suffix_dedup(docs: DataFrame, length: int = 50) -> DataFrame:
    """doc_id, text (what is left; characters cut in part go whole), n_removed (bytes) for (doc_id, text, ...), and the other columns."""
    other = docs.select(*docs.columns[2:]).schema
    schema = pa.schema([("doc_id", pa.int64()), ("text", pa.string()), ("n_removed", pa.int64()), *to_arrow_schema(other)])

    def finish(block, gone):
        lead = (block.data & 0xC0) != 0x80
        head = np.maximum.accumulate(np.where(lead, np.arange(len(lead)), 0)) if len(lead) else np.zeros(0, np.int64)
        bad = np.zeros(len(gone), bool)
        bad[head[gone]] = True
        gone = bad[head] if len(gone) else gone
        a = 0
        for doc, b, rest in zip(block.docs.tolist(), block.ends.tolist(), block.rest):
            left = ~gone[a:b]
            yield doc, block.data[a:b][left].tobytes().decode(errors="replace"), int(b - a - left.sum()), *rest
            a = b

    shape = ", ".join(["doc_id long, text string, n_removed long", *[f"`{f.name}` {f.dataType.simpleString()}" for f in other]])
    return removed_bytes(docs, length, shape, schema, finish)


def op4_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string())])

    def finish(block, gone):
        a = 0
        for doc, b in zip(block.docs.tolist(), block.ends.tolist()):
            g = gone[a:b]
            kept = block.data[a:b][~g].tobytes()
            yield doc, b - a, b - a - len(kept), int((g[1:] & ~g[:-1]).sum() + (g[:1].sum())), hashlib.sha256(kept).hexdigest()
            a = b

    rows = removed_bytes(documents(table(spark, sf_dir, "documents")), 50, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string", schema, finish)
    return rows.select(null_id(), "n_bytes", "n_removed", "n_spans", "kept_sha256")
