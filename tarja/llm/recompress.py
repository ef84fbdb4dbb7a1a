"""Operator 8, substring dedup over words, by recompression.

Rounds of recompression shorten each document: the first names maximal runs of one word, the next ones pairs of neighbours of
which the first is in the left and the second in the right half of the names (halves drawn anew each round by hash). A name
is a hash of what it stands for, so all tasks name alike. A symbol whose making a window alone decides is the same wherever
the window stands; each window is keyed by its first such symbol of the highest level that has one. A Spark round finds the
symbols that two documents share; only windows with a shared symbol go on. These are named whole by doubling (pairs of names
of 1, 2, 4 and 8 words, two 64-bit lanes from two independent hashes of each word), a second Spark round finds the smallest document of each window name, and the
windows of later documents are removed. Windows are judged on the input, so order and sharding do not matter.

Null text counts as empty. Only strictly smaller ids remove: rows with equal ids leave each other alone. A null id acts as
the smallest. Texts of fewer words than a window keep all. Very long texts stand alone in a block. Empty table: no rows.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from tarja.llm.blocks import Block, ask, blocks, bucket_bits, expand, key_payloads, met, press, shared_answer, shared_keys
from tarja.llm.common import documents, mix, null_id, pair, table, word_hashes, words_of

ROUNDS = 4


class Level:
    """Symbols of one level: name, text, first and past word, and the words that decide it."""

    def __init__(self, name, text, a, b, ea, eb):
        self.name, self.text, self.a, self.b, self.ea, self.eb = name, text, a, b, ea, eb


def runs(w: np.ndarray, text: np.ndarray) -> Level:
    """Level 0 in runs: a run is decided by the words next to it."""
    n = len(w)
    first = np.flatnonzero(np.r_[True, (w[1:] != w[:-1]) | (text[1:] != text[:-1])]) if n else np.zeros(0, np.int64)
    end = np.r_[first[1:], n] if n else first
    return Level(pair(w[first], (end - first).astype(np.uint64), 1), text[first], first, end, first - 1, end + 1)


def pairs(x: Level, round_: int) -> Level:
    """The next level. A pair is decided by its two symbols, a symbol left alone also by its neighbour on the open side."""
    n = len(x.name)
    if n < 2:
        return x
    left = (mix(x.name.copy(), 40 + round_) >> np.uint64(63)) == 0
    joined = np.zeros(n, bool)
    joined[:-1] = left[:-1] & ~left[1:] & (x.text[:-1] == x.text[1:])
    second = np.r_[False, joined[:-1]]
    ea, eb = x.ea.copy(), x.eb.copy()
    same = x.text[:-1] == x.text[1:]
    # alone on the left side: what follows decided it; at a text's end nothing follows, which no window can tell
    alone = left & ~joined
    k = np.flatnonzero(alone[:-1] & same)
    eb[k] = np.maximum(eb[k], x.eb[k + 1])
    ends = np.flatnonzero(alone & np.r_[~same, True])
    eb[ends] = np.iinfo(np.int64).max // 2
    alone = ~left & ~second
    k = np.flatnonzero(alone[1:] & same) + 1
    ea[k] = np.minimum(ea[k], x.ea[k - 1])
    begins = np.flatnonzero(alone & np.r_[True, ~same])
    ea[begins] = -1
    j = np.flatnonzero(joined)
    name = mix(x.name.copy(), 60 + round_)
    name[j] = pair(x.name[j], x.name[j + 1], 80 + round_)
    b = x.b.copy()
    b[j], ea[j], eb[j] = x.b[j + 1], np.minimum(x.ea[j], x.ea[j + 1]), np.maximum(x.eb[j], x.eb[j + 1])
    keep = ~second
    return Level(name[keep], x.text[keep], x.a[keep], b[keep], ea[keep], eb[keep])


def first_fit(x: Level, starts: np.ndarray, window: int) -> np.ndarray:
    """For each window start the first symbol to end (by what decides it) among those decided within the window, or -1.

    What a window holds alone settles the choice: a symbol outside, or half outside, ends later than any inside."""
    ok = np.flatnonzero((x.ea >= 0) & (x.eb < np.iinfo(np.int64).max // 4) & (x.eb - x.ea <= window))
    if not len(ok):
        return np.full(len(starts), -1)
    order = ok[np.lexsort((ok, x.ea[ok]))]
    soonest = np.minimum.accumulate((x.eb[order] * len(x.eb) + order)[::-1])[::-1]
    at = np.searchsorted(x.ea[order], starts)
    eb, pick = np.divmod(soonest[np.minimum(at, len(order) - 1)], len(x.eb))
    return np.where((at < len(order)) & (eb <= starts + window), pick, -1)


class Words:
    """A block's windows of `window` words and their keys."""

    def __init__(self, block: Block, window: int):
        self.block, self.window = block, window
        self.a, self.b, self.text = words_of(block.data, block.ends)
        self.w, self.w2 = word_hashes(block.data, self.a, self.b, 2)
        n = len(self.w)
        stop = np.searchsorted(self.text, self.text, side="right") if n else np.zeros(0, np.int64)
        self.starts = np.flatnonzero(np.arange(n) + window <= stop)
        self.keys = np.zeros(len(self.starts), np.uint64)
        open_ = np.ones(len(self.starts), bool)
        levels = [runs(self.w, self.text)]
        for r in range(ROUNDS):
            levels.append(pairs(levels[-1], r))
        for depth, level in reversed(list(enumerate(levels))):
            todo = np.flatnonzero(open_)
            if not len(todo):
                break
            pick = first_fit(level, self.starts[todo], window)
            ok = pick >= 0
            self.keys[todo[ok]] = mix(level.name[pick[ok]], 100 + depth)
            open_[todo[ok]] = False
        todo = np.flatnonzero(open_)  # inside long runs: the window's middle word
        self.keys[todo] = mix(self.w[self.starts[todo] + window // 2], 99)
        self.doc = block.docs[self.text[self.starts]] if len(self.starts) else np.zeros(0, np.int64)

    def names(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Two lanes of the names of the windows that begin at words `at`."""
        out = []
        for lane in (0, 1):
            whole, done, level, span = None, 0, (self.w, self.w2)[lane], 1
            rest = self.window
            while rest:
                if rest & 1:
                    part = level[at + done]
                    whole = part if whole is None else pair(whole, part, 200 + lane)
                    done += span
                rest >>= 1
                if rest:
                    longer = level.copy()
                    longer[: max(0, len(level) - span)] = pair(level[: max(0, len(level) - span)], level[span:], 210 + lane)
                    level, span = longer, 2 * span
            out.append(whole)
        return out[0], out[1]


def _smallest(words: Words, shared: dict[int, bytes], bits: int):
    """The windows with a shared key by name: their indices in name order, each name's first, its smallest doc, its two lanes."""
    own, bound, _ = key_payloads(words.keys, words.doc, bits)
    flags = shared_keys(own, bound, shared)
    cand = np.flatnonzero(flags[np.searchsorted(own, words.keys)]) if len(own) else np.zeros(0, np.int64)
    hi, lo = words.names(words.starts[cand]) if len(cand) else (np.zeros(0, np.uint64), np.zeros(0, np.uint64))
    doc = words.doc[cand]
    order = np.lexsort((doc, lo, hi))
    cand, hi, lo, doc = cand[order], hi[order], lo[order], doc[order]
    first = np.flatnonzero(np.r_[True, (hi[1:] != hi[:-1]) | (lo[1:] != lo[:-1])]) if len(cand) else np.zeros(0, np.int64)
    return cand, first, doc, hi[first], lo[first]


def removed_words(docs: DataFrame, window: int, out: str, schema: pa.Schema, finish) -> DataFrame:
    """finish(words, removed flags of the words) -> rows, for each block."""
    held = blocks(docs)
    bits = bucket_bits(docs)

    def ask_keys(block, told):
        w = Words(block, window)
        for bucket, payload in key_payloads(w.keys, w.doc, bits)[2]:
            yield bucket, block.number, payload

    shared = ask(held, None, ask_keys, shared_answer, 0)

    def ask_names(block, told):
        w = Words(block, window)
        _, first, doc, hi, lo = _smallest(w, told.get(0, {}), bits)
        bound = np.searchsorted(hi >> np.uint64(64 - bits), np.arange((1 << bits) + 1, dtype=np.uint64))
        rows = np.stack([hi, lo, doc[first].view(np.uint64)])
        for b in range(1 << bits):
            if bound[b + 1] > bound[b]:
                yield b, block.number, press(rows[:, bound[b] : bound[b + 1]].tobytes())  # by column: the ids shrink

    def answer_names(payloads):
        parts = [np.frombuffer(expand(p), np.uint64).reshape(3, -1) for p in payloads]
        rows = np.concatenate(parts, 1)
        doc = rows[2].view(np.int64)
        order = np.lexsort((doc, rows[1], rows[0]))
        hi, lo, doc = rows[0, order], rows[1, order], doc[order]
        first = np.flatnonzero(np.r_[True, (hi[1:] != hi[:-1]) | (lo[1:] != lo[:-1])])
        later = np.empty(rows.shape[1], bool)
        later[order] = doc > np.repeat(doc[first], np.diff(np.r_[first, len(doc)]))
        return [np.packbits(x).tobytes() if x.any() else b"" for x in np.split(later, np.cumsum([p.shape[1] for p in parts])[:-1])]

    answers = shared.unionAll(ask(held, shared, ask_names, answer_names, 1))

    def cut(block, told):
        w = Words(block, window)
        cand, first, doc, hi, lo = _smallest(w, told.get(0, {}), bits)
        bound = np.searchsorted(hi >> np.uint64(64 - bits), np.arange((1 << bits) + 1, dtype=np.uint64))
        later = shared_keys(hi, bound, told.get(1, {}))
        count = np.diff(np.r_[first, len(cand)])
        gone = (doc > np.repeat(doc[first], count)) | np.repeat(later, count)
        flags = np.zeros(len(w.w) + 1, np.int64)
        at = w.starts[cand[gone]]
        np.add.at(flags, at, 1)
        np.add.at(flags, at + window, -1)
        yield from finish(w, np.cumsum(flags[:-1]) > 0)

    return met(held, answers, cut, out, schema)


def substring_dedup(docs: DataFrame, window: int = 13) -> DataFrame:
    """doc_id, n_words, n_removed, kept (the kept words joined by a space) for (doc_id, text)."""
    return _dedup(docs, window, True)


def _dedup(docs: DataFrame, window: int, text: bool) -> DataFrame:
    schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept", pa.string())])

    def finish(w: Words, gone: np.ndarray):
        bound = np.searchsorted(w.text, np.arange(len(w.block.docs) + 1)).tolist()
        data = w.block.data
        # kept words and one blank after each, in one go
        keep = np.flatnonzero(~gone)
        size = w.b[keep] - w.a[keep] + 1
        ends = np.cumsum(size)
        flat = np.full(int(ends[-1]) if len(ends) else 0, 32, np.uint8)
        source = np.repeat(w.a[keep] - (ends - size), size) + np.arange(len(flat))
        real = np.ones(len(flat), bool)
        real[ends - 1] = False
        flat[real] = data[source[real]]
        flat = flat.tobytes()
        edge = np.r_[0, ends][np.searchsorted(keep, bound)].tolist()
        number = np.searchsorted(keep, bound).tolist()
        for i, doc in enumerate(w.block.docs.tolist()):
            n = bound[i + 1] - bound[i]
            kept = flat[edge[i] : max(edge[i], edge[i + 1] - 1)]
            yield doc, n, n - (number[i + 1] - number[i]), kept.decode() if text else hashlib.sha256(kept).hexdigest()

    return removed_words(docs, window, "doc_id long, n_words long, n_removed long, kept string", schema, finish)


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _dedup(documents(table(spark, sf_dir, "documents")), 13, False)
    return rows.select(null_id(), "n_words", "n_removed", rows["kept"].alias("kept_sha256"))
