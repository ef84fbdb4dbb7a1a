"""Operator 3, benchmark decontamination by the q-gram lemma.

A document is contaminated by an item if some run of `window` bytes of the item (all of a shorter item) occurs in it with at
most `edits` edits (one for each 16 bytes of a shorter item). Case and kinds of white space do not count. Two strings
of which one has m bytes and that are k edits apart share at least m - q + 1 - kq q-grams, on diagonals at most k apart: so
positions whose neighbourhood holds fewer shared q-grams are out, the others are counted by item in overlapping diagonal
bands, and regions that meet the bound are verified by an alignment limited to the band.
Items go through in blocks of about `block_bytes`, each sent to all tasks; blocks follow one another, the driver holds one at
a time and a written table what it found, so the benchmark may be of any size, at the cost of a pass over the texts for each. Null or empty texts and items shorter than q bytes match nothing; repeated rows match each.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarja.llm.common import arrow_rows, documents, null_id, slices, table, texts_as_bytes, written

Q, WINDOW, EDITS = 8, 48, 3
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_FOLD[9:14] = 32
_BITS = 22


def grams(data: np.ndarray) -> np.ndarray:
    """The q-gram (as a number) at each position but the last q - 1."""
    n = len(data) - Q + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    return np.ndarray((n,), "<u8", np.ascontiguousarray(data), strides=(1,)).astype(np.uint64)


def slot(g: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return (g * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - _BITS)


class Index:
    """The q-grams of a block of items."""

    def __init__(self, items: list[tuple[int, str]]):
        raw = [(i, _FOLD[np.frombuffer((t or "").lower().encode(), np.uint8)]) for i, t in items]
        raw = [(i, b) for i, b in raw if len(b) >= Q]
        self.ids, self.texts = [i for i, _ in raw], [b for _, b in raw]
        self.window = np.array([min(len(b), WINDOW) for b in self.texts], np.int64)
        self.edits = np.array([EDITS if len(b) >= WINDOW else min(len(b) // 16, (len(b) - Q) // Q) for b in self.texts], np.int64)
        self.need = self.window - Q + 1 - self.edits * Q
        every = [grams(b) for b in self.texts]
        code = np.concatenate(every) if every else np.zeros(0, np.uint64)
        order = np.argsort(code, kind="stable")
        self.code = code[order]
        self.item = np.repeat(np.arange(len(every)), [len(g) for g in every])[order] if every else np.zeros(0, np.int64)
        self.place = np.concatenate([np.arange(len(g)) for g in every])[order] if every else np.zeros(0, np.int64)
        self.bits = np.zeros(1 << _BITS, bool)
        self.bits[slot(self.code)] = True
        self.least = int(self.need.min()) if len(self.need) else 1
        self.reach = WINDOW + EDITS

    def __call__(self, data: np.ndarray, ends: np.ndarray) -> list[tuple[int, int, int, int, int]]:
        """(text number, item number, start, end, edits): the best region of each pair."""
        if not self.texts or len(data) < Q:
            return []
        data = _FOLD[data]
        g = grams(data)
        hit = np.flatnonzero(self.bits[slot(g)])
        text = np.searchsorted(ends, hit, side="right")
        ok = hit + Q <= ends[text]
        hit, text = hit[ok], text[ok]
        if not len(hit):
            return []
        exact = np.searchsorted(self.code, g[hit])
        ok = self.code[np.minimum(exact, len(self.code) - 1)] == g[hit]
        hit, text, exact = hit[ok], text[ok], exact[ok]
        if not len(hit):
            return []
        # a region that meets the bound lies within `reach` bytes and holds `least` positions
        t, n = self.least, len(hit)
        dense = np.zeros(n + 1, np.int64)
        first = np.arange(max(0, n - t + 1))
        good = first[(hit[first + t - 1] - hit[first] <= self.reach) & (text[first + t - 1] == text[first])]
        np.add.at(dense, good, 1)
        np.add.at(dense, good + t, -1)
        ok = np.cumsum(dense[:n]) > 0
        hit, text, exact = hit[ok], text[ok], exact[ok]
        if not len(hit):
            return []
        many = np.searchsorted(self.code, g[hit], side="right") - exact
        at = np.repeat(exact, many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
        hit, text, item, place = np.repeat(hit, many), np.repeat(text, many), self.item[at], self.place[at]
        found: dict[tuple[int, int], tuple[int, int, int]] = {}
        for shift in (0, EDITS):  # bands overlap by half
            band = (hit - place + shift) // (2 * EDITS)
            order = np.lexsort((hit, band, item, text))
            h, x, it, bd, pl = hit[order], text[order], item[order], band[order], place[order]
            need = self.need[it]
            last = np.arange(len(h)) + need - 1
            ok = last < len(h)
            a = np.flatnonzero(ok)
            b = last[a]
            good = (x[b] == x[a]) & (it[b] == it[a]) & (bd[b] == bd[a]) & (h[b] - h[a] <= self.window[it[a]] + self.edits[it[a]] - Q)
            a, b = a[good], b[good]
            if not len(a):
                continue
            # neighbouring starts of one band are one region
            cut = np.flatnonzero(np.r_[True, (np.diff(a) != 1) | (x[a[1:]] != x[a[:-1]]) | (it[a[1:]] != it[a[:-1]]) | (bd[a[1:]] != bd[a[:-1]])])
            for i, j in zip(a[cut].tolist(), np.r_[cut[1:], len(a)].tolist()):
                j = int(b[j - 1])
                key = (int(x[i]), int(it[i]))
                if found.get(key, (0, 0, 99))[2] == 0:
                    continue
                lo = int(ends[key[0] - 1]) if key[0] else 0
                if (v := self.verify(data, lo, int(ends[key[0]]), key[1], int(h[i] - pl[i]), int(pl[i : j + 1].min()), int(pl[i : j + 1].max()))) and v[2] < found.get(key, (0, 0, 99))[2]:
                    found[key] = (v[0] - lo, v[1] - lo, v[2])
        return [(x, it, *v) for (x, it), v in found.items()]

    def verify(self, data, lo, hi, item, diagonal, p0, p1):
        """Aligns the item's windows that meet its positions p0 to p1 with the text beside the diagonal."""
        b, m, k = self.texts[item], int(self.window[item]), int(self.edits[item])
        side = 3 * EDITS
        low, high = max(0, min(p0 + Q - m, len(b) - m)), max(0, min(p1, len(b) - m))
        # the same bytes on one diagonal need no alignment
        for d in range(diagonal - 2 * EDITS, diagonal + 2 * EDITS + 1):
            a0, a1 = max(low, lo - d), min(high + m, hi - d)
            if a1 - a0 >= m:
                same = np.flatnonzero(np.r_[True, b[a0:a1] != data[a0 + d : a1 + d], True])
                run = np.diff(same) - 1
                if run.max() >= m:
                    at = a0 + int(same[int(run.argmax())]) + d
                    return at, at + int(run.max()), 0
        starts = np.arange(low, high + 1)
        width = m + 2 * side
        at = starts[:, None] + diagonal - side + np.arange(width)
        inside = (at >= lo) & (at < hi)
        area = np.where(inside, data[np.clip(at, lo, hi - 1)], 255)  # 255 is in no UTF-8 text
        pattern = b[starts[:, None] + np.arange(m)]
        ramp = np.arange(width + 1, dtype=np.int16)
        row = np.zeros((len(starts), width + 1), np.int16)
        for i in range(m):
            new = np.empty_like(row)
            new[:, 0] = i + 1
            np.minimum(row[:, :-1] + (area != pattern[:, i : i + 1]), row[:, 1:] + 1, out=new[:, 1:], casting="unsafe")
            new -= ramp
            row = np.minimum.accumulate(new, axis=1)
            row += ramp
            if i >= 2 * k and i % 8 == 0:  # a row's least never falls
                alive = row.min(1) <= k
                if not alive.all():
                    starts, area, pattern, row = starts[alive], area[alive], pattern[alive], row[alive]
                    if not len(starts):
                        return None
        s, j = np.unravel_index(row.argmin(), row.shape)
        best = int(row[s, j])
        if best > k:
            return None
        stop = int(starts[s]) + diagonal - side + int(j)
        return max(lo, stop - m), min(hi, stop), best


def item_blocks(benchmark: DataFrame, block_bytes: int) -> tuple[int, Callable[[int], list[tuple[int, str]]]]:
    """The number of blocks of about `block_bytes` of text (by hash; a longer item is a block's excess), and what collects one."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where("text is not null")
    n = int((items.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // block_bytes) + 1
    return n, lambda k: [(r[0], r[1]) for r in items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k).collect()]


def contaminated(docs: DataFrame, benchmark: DataFrame, block_bytes: int = 8 << 20) -> DataFrame:
    """doc_id, item_id, start, stop (code points of the lower-cased text), edits: the best region of each pair that meets."""
    schema = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("start", pa.int64()), ("stop", pa.int64()), ("edits", pa.int32())])

    def matched(rows: list[tuple[int, str]]) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            index = Index(rows)
            add, take = arrow_rows(schema)
            for batch in batches:
                for part in slices(batch):
                    data, ends = texts_as_bytes(part.column(1))
                    for x, it, a, b, e in index(data, ends):
                        own = bytes(data[int(ends[x - 1]) if x else 0 : int(ends[x])])
                        chars = lambda k: len(own[:k].decode(errors="ignore"))
                        add(part.column(0)[x].as_py(), index.ids[it], chars(a), chars(b), e)
                    yield from take()
            yield from take(True)

        return docs.select("doc_id", F.lower("text").alias("text")).mapInArrow(run, "doc_id long, item_id long, start long, stop long, edits int")

    n, block = item_blocks(benchmark, block_bytes)
    return matched(block(0)) if n == 1 else reduce(DataFrame.unionAll, [written(matched(block(k)), "contaminated") for k in range(n)])


def clean(docs: DataFrame, benchmark: DataFrame, block_bytes: int = 8 << 20) -> DataFrame:
    """The rows of docs (text in a column `text`) that no item contaminates, unchanged and without a shuffle."""
    schema = docs.schema

    def left(rows_in: DataFrame, items: list[tuple[int, str]]) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            index = Index(items)
            for batch in batches:
                for part in slices(batch, column="text"):
                    keep = np.ones(part.num_rows, bool)
                    keep[[x for x, *_ in index(*texts_as_bytes(part.column(part.num_columns - 1)))]] = False
                    yield part.select(schema.names).filter(pa.array(keep))

        return rows_in.withColumn("lower-cased text", F.lower("text")).mapInArrow(run, schema)

    n, block = item_blocks(benchmark, block_bytes)
    for k in range(n):
        docs = left(docs, block(k)) if n == 1 else written(left(docs, block(k)), "clean")
    return docs


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(documents(table(spark, sf_dir, "documents")), table(spark, sf_dir, "benchmark")).select(null_id(), "item_id", "start", "stop", "edits")
