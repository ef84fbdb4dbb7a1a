"""Operator 5, token ids in Simple-8b words.

A shard is a range of doc_id; its file is a table of blocks in ascending (doc_id, text) order. A block holds `doc_ids`
(int64), `counts` (uint32 ids per document), `offsets` (uint32, each document's first word) and `words` (uint64). A word's
upper four bits select how many ids share its lower 60 bits; selector 15 is an escape: the id stands whole in the next word.
Every document begins a word, so any document of a block decodes alone and a block decodes by array operations.
Null text counts as empty (only the end id); a null doc_id sorts first and is returned as null; repeated rows are
documents of their own; an empty table gives no rows. No text is cut.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tarja.llm.common import arrow_rows, documents, mix, null_id, partitions, slices, table, texts_as_bytes, word_hashes, words_of, written

COUNTS = np.array([60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1], np.int64)
BITS = 60 // COUNTS
ESCAPE = 15
BLOCK_IDS = 1 << 16
CACHE = 1 << 21  # pieces a task remembers; the ids do not depend on it
STEP = 1 << 16  # pieces looked up together


def pack(ids: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Words of the documents' ids (one after another, document k ends before ends[k]), and each document's first word."""
    ids = ids.astype(np.uint64, copy=False)
    n = len(ids)
    counts = np.diff(np.r_[0, ends])
    if not n:
        return np.zeros(0, np.uint64), np.zeros(len(ends), np.uint32)
    low = ids & np.uint64(0xFFFFFFFF)
    width = np.maximum(1, np.frexp(low.astype(np.float64))[1]).astype(np.uint8)
    high = np.flatnonzero(ids != low)
    width[high] = 32 + np.frexp((ids[high] >> np.uint64(32)).astype(np.float64))[1]
    left = np.repeat(ends, counts) - np.arange(n)
    choice = np.full(n, ESCAPE, np.uint8)
    most, span = width, 1
    for k in range(len(COUNTS) - 1, -1, -1):  # from one id a word to sixty
        c = int(COUNTS[k])
        while span < c:  # widest id of the next c, from two overlapping runs
            step = min(c - span, span)
            wider = most.copy()
            wider[: max(0, n - step)] = np.maximum(most[: max(0, n - step)], most[step:])
            most, span = wider, span + step
        fits = most <= BITS[k]
        if not fits.any():  # then no longer run fits fewer bits
            break
        choice[fits & (left >= c)] = k
    taken = np.r_[COUNTS, 0, 1].astype(np.int64)[choice]
    follow = (np.arange(n) + taken).tolist()
    starts, at = [], 0
    while at < n:
        starts.append(at)
        at = follow[at]
    starts = np.array(starts, np.int64)
    kind = choice[starts]
    place = np.cumsum(np.where(kind == ESCAPE, 2, 1))
    words = np.zeros(int(place[-1]), np.uint64)
    place = place - np.where(kind == ESCAPE, 2, 1)
    for k in np.unique(kind):
        at, to = starts[kind == k], place[kind == k]
        if k == ESCAPE:
            words[to], words[to + 1] = np.uint64(ESCAPE << 60), ids[at]
            continue
        word = np.full(len(at), np.uint64(int(k) << 60), np.uint64)
        for j in range(int(COUNTS[k])):
            word |= ids[at + j] << np.uint64(j * int(BITS[k]))
        words[to] = word
    first = np.searchsorted(starts, ends - counts)
    return words, np.r_[place, len(words)][first].astype(np.uint32)


def unpack(words: np.ndarray) -> np.ndarray:
    """The ids of the words."""
    if not len(words):
        return np.zeros(0, np.uint64)
    kind = (words >> np.uint64(60)).astype(np.int64)
    real = np.ones(len(words), bool)
    if (kind == ESCAPE).any():  # the word after an escape is an id; runs of fifteens alternate
        at, marks = 0, np.flatnonzero(kind == ESCAPE).tolist()
        for m in marks:
            if m >= at:
                real[m + 1] = False
                at = m + 2
    heads = np.flatnonzero(real)
    kind = kind[heads]
    taken = np.r_[COUNTS, 0, 1].astype(np.int64)[kind]
    begin = np.cumsum(taken) - taken
    out = np.empty(int(taken.sum()), np.uint64)
    for k in np.unique(kind):
        at, to = heads[kind == k], begin[kind == k]
        if k == ESCAPE:
            out[to] = words[at + 1]
            continue
        mask = np.uint64((1 << int(BITS[k])) - 1)
        for j in range(int(COUNTS[k])):
            out[to + j] = (words[at] >> np.uint64(j * int(BITS[k]))) & mask
    return out


_TOKENIZERS: dict[str, Encoder] = {}
_BLANK = np.zeros(256, bool)
_BLANK[[10, 32]] = True
#: One sign between a letter and a blank is a token of its own for every tokenizer of this kind: cut off, words are rarer.
_SIGN = np.zeros(256, bool)
_SIGN[[*b",.;:!?"]] = True
_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123)]] = True


def pieces_of(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each piece (a run between blanks or line feeds, its last sign apart) and its text's number."""
    a, b, text = words_of(data, ends, _BLANK)
    cut = np.flatnonzero((b - a > 1) & _SIGN[data[b - 1]] & _LETTER[data[b - 2]]) if len(a) else np.zeros(0, np.int64)
    if len(cut):
        at = np.repeat(np.arange(len(a)), np.bincount(cut, minlength=len(a)) + 1)
        sign = np.r_[False, at[1:] == at[:-1]]
        a, b, text = a[at], b[at], text[at]
        a[sign] = b[sign] - 1
        b[np.flatnonzero(sign) - 1] -= 1
    return a, b, text


class Known:
    """Numbers of pieces by two 64-bit hashes, in an open table of fixed size; when `most` are known, those not asked for
    since the last time go."""

    def __init__(self, most: int = CACHE):
        self.most, self.slots = most, 1 << (2 * most - 1).bit_length()
        self.clear()

    def clear(self) -> None:
        self.table = np.full(self.slots, -1, np.int32)
        self.one, self.two = np.zeros(self.most, np.uint64), np.zeros(self.most, np.uint64)
        self.begin, self.count = np.zeros(self.most, np.int64), np.zeros(self.most, np.int64)
        self.used = np.zeros(self.most, bool)
        self.ids, self.size, self.n = np.zeros(1 << 16, np.uint32), 0, 0

    def find(self, one: np.ndarray, two: np.ndarray) -> np.ndarray:
        """The piece's number, or -1."""
        out = np.full(len(one), -1, np.int64)
        todo, slot = np.arange(len(one)), (one & np.uint64(self.slots - 1)).astype(np.int64)
        while len(todo):
            at = self.table[slot]
            there = at >= 0
            todo, slot, at = todo[there], slot[there], at[there]
            same = (self.one[at] == one[todo]) & (self.two[at] == two[todo])
            out[todo[same]] = at[same]
            todo, slot = todo[~same], (slot[~same] + 1) & (self.slots - 1)
        return out

    def room(self, more: int) -> None:
        if self.n + more > self.most:
            keep = np.flatnonzero(self.used[: self.n])
            old = (self.one[keep], self.two[keep], self.count[keep], self.gather(keep))
            self.clear()
            if 2 * len(keep) <= self.most and len(keep) + more <= self.most:
                self.add(*old)

    def add(self, one: np.ndarray, two: np.ndarray, count: np.ndarray, ids: np.ndarray) -> None:
        """Distinct pieces that are not known yet, with their ids one after another."""
        a, n = self.n, len(one)
        self.one[a : a + n], self.two[a : a + n], self.count[a : a + n] = one, two, count
        self.begin[a : a + n] = self.size + np.cumsum(count) - count
        if self.size + len(ids) > len(self.ids):
            self.ids = np.r_[self.ids, np.zeros(max(len(self.ids), len(ids)), np.uint32)]
        self.ids[self.size : self.size + len(ids)] = ids
        self.size, self.n = self.size + len(ids), a + n
        todo, slot = np.arange(a, a + n), (one & np.uint64(self.slots - 1)).astype(np.int64)
        while len(todo):
            free = self.table[slot] < 0
            self.table[slot[free]] = todo[free]
            lost = self.table[slot] != todo
            todo, slot = todo[lost], (slot[lost] + 1) & (self.slots - 1)

    def gather(self, numbers: np.ndarray) -> np.ndarray:
        """The ids of pieces, one after another."""
        count = self.count[numbers]
        ends = np.cumsum(count)
        return self.ids[np.repeat(self.begin[numbers] - (ends - count), count) + np.arange(int(ends[-1]) if len(ends) else 0)]


class Encoder:
    """Encodes texts with a tokenizer that drops white space and never joins over it. Pieces between blanks go through it once,
    while they are remembered."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer, self.known = Tokenizer.from_file(path), Known()
        self.final = np.zeros(self.tokenizer.get_vocab_size() + 1, bool)
        self.final[[i for t, i in self.tokenizer.get_vocab().items() if t.endswith("</w>") and i < len(self.final)]] = True

    def learn(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The pieces' places in the order in which they come out, the number of ids of each, and the ids."""
        # words of letters go through as one text: each ends with one token that ends a word, unless one is several tokens
        # to the tokenizer, which the count shows
        letters = np.fromiter((p.isalpha() for p in pieces), bool, len(pieces))
        words, rest = np.flatnonzero(letters), np.flatnonzero(~letters)
        ids = np.array(self.tokenizer.encode_batch_fast([" ".join([pieces[i] for i in words])], add_special_tokens=False)[0].ids, np.uint32)
        ends = np.flatnonzero(self.final[np.minimum(ids, len(self.final) - 1)]) + 1
        if len(ends) != len(words) or len(words) and ends[-1] != len(ids):
            words, rest, ids, ends = words[:0], np.arange(len(pieces)), ids[:0], ends[:0]
        codes = [e.ids for e in self.tokenizer.encode_batch_fast([pieces[i] for i in rest], add_special_tokens=False)]
        counts = np.r_[np.diff(np.r_[0, ends]), np.fromiter(map(len, codes), np.int64, len(codes))].astype(np.int64)
        return np.r_[words, rest], counts, np.r_[ids, np.fromiter(chain.from_iterable(codes), np.uint32)].astype(np.uint32)

    def numbers(self, data: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The numbers of at most STEP pieces; those not met before are learned."""
        known, (one, two) = self.known, word_hashes(data, a, b, 2)
        while True:
            number = known.find(one, two)
            new = np.flatnonzero(number < 0)
            if not len(new):
                known.used[number] = True
                return number
            new = new[np.unique(one[new] ^ mix(two[new], 3), return_index=True)[1]]
            if known.n + len(new) > known.most:
                known.used[number[number >= 0]] = True
                known.room(len(new))
                continue  # all may have gone
            for i in range(0, len(new), 20_000):
                part = new[i : i + 20_000]
                text = [data[x:y].tobytes().decode() for x, y in zip(a[part].tolist(), b[part].tolist())]
                order, counts, ids = self.learn(text)
                known.add(one[part[order]], two[part[order]], counts, ids)

    def __call__(self, data: np.ndarray, ends: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the texts that stand one after another in data, `end_id` after each, and each text's number of ids."""
        a, b, text = pieces_of(data, ends)
        ids, counts = [np.zeros(0, np.uint32)], np.zeros(len(ends), np.int64)
        for i in range(0, len(a), STEP):
            number = self.numbers(data, a[i : i + STEP], b[i : i + STEP])
            ids.append(self.known.gather(number))
            counts += np.bincount(text[i : i + STEP], self.known.count[number], len(ends)).astype(np.int64)
        return np.insert(np.concatenate(ids), np.cumsum(counts), np.uint32(end_id)), counts + 1


def _encoder(path: str) -> Encoder:
    if path not in _TOKENIZERS:
        _TOKENIZERS[path] = Encoder(path)
    return _TOKENIZERS[path]


BLOCKS = "shard int, block int, start long, n_docs int, n_ids long, doc_ids binary, counts binary, offsets binary, words binary"
_BLOCKS = pa.schema([("shard", pa.int32()), ("block", pa.int32()), ("start", pa.int64()), ("n_docs", pa.int32()), ("n_ids", pa.int64()), ("doc_ids", pa.binary()), ("counts", pa.binary()), ("offsets", pa.binary()), ("words", pa.binary())])


def write_token_ids(docs: DataFrame, tokenizer_path: str, end_id: int, shards: int | None = None) -> DataFrame:
    """Writes the shards and gives the table of their blocks as read back. One shuffle: the texts, into ranges of doc_id."""
    ordered = docs.repartitionByRange(shards or partitions(docs.sparkSession), "doc_id").sortWithinPartitions("doc_id", "text")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        from pyspark import TaskContext

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        shard, run = TaskContext.get().partitionId(), _encoder(tokenizer_path)
        add, take = arrow_rows(_BLOCKS)
        block = start = held = 0
        docs_, counts_, ids_ = [], [], []

        def close():
            nonlocal block, start, held
            if docs_:
                flat, counts = np.concatenate(ids_), np.concatenate(counts_)
                words, offsets = pack(flat, np.cumsum(counts))
                add(shard, block, start, len(counts), len(flat), np.concatenate(docs_).astype("<i8").tobytes(), counts.astype("<u4").tobytes(), offsets.astype("<u4").tobytes(), words.astype("<u8").tobytes())
                block, start, held = block + 1, start + len(flat), 0
                docs_.clear(), counts_.clear(), ids_.clear()

        for batch in batches:
            for part in slices(batch, 1 << 20):
                flat, counts = run(*texts_as_bytes(part.column(1)), end_id)
                doc, ends, a = part.column(0).to_numpy(), np.r_[0, np.cumsum(counts)], 0
                while a < len(doc):  # a block ends with the document that fills it
                    b = min(len(doc), int(np.searchsorted(ends, ends[a] + BLOCK_IDS - held)))
                    docs_.append(doc[a:b]), counts_.append(counts[a:b]), ids_.append(flat[ends[a] : ends[b]])
                    held, a = held + int(ends[b] - ends[a]), b
                    if held >= BLOCK_IDS:
                        close()
                yield from take()
        close()
        yield from take(True)

    return written(ordered.mapInArrow(encode, BLOCKS), "token-ids")


def read_token_ids(blocks: DataFrame) -> DataFrame:
    """doc_id, shard, start (within all documents), n_tokens, ids (binary, little-endian uint32): one row per document."""
    schema = pa.schema([("doc_id", pa.int64()), ("shard", pa.int32()), ("at", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.binary())])

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        add, take = arrow_rows(schema)
        for batch in batches:
            for r in batch.to_pylist():
                ids = unpack(np.frombuffer(r["words"], "<u8")).astype("<u4")
                counts = np.frombuffer(r["counts"], "<u4").astype(np.int64)
                ends = np.cumsum(counts)
                for doc_id, a, b in zip(np.frombuffer(r["doc_ids"], "<i8").tolist(), (ends - counts).tolist(), ends.tolist()):
                    add(doc_id, r["shard"], r["start"] + a, b - a, ids[a:b].tobytes())
                yield from take()
        yield from take(True)

    rows = blocks.select("shard", "start", "doc_ids", "counts", "words").mapInArrow(decode, "doc_id long, shard int, at long, n_tokens long, ids binary")
    totals = blocks.groupBy("shard").agg(F.sum("n_ids").alias("n"))  # a row per shard
    before = totals.select("shard", (F.sum("n").over(Window.orderBy("shard")) - F.col("n")).alias("before"))
    return rows.join(F.broadcast(before), "shard").select("doc_id", "shard", (F.col("at") + F.col("before")).alias("start"), "n_tokens", "ids")


def op5_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    blocks = write_token_ids(documents(table(spark, sf_dir, "documents")), public_tokenizers.path("word_bpe_49k.json"), 2)
    rows = read_token_ids(blocks)
    return rows.select(null_id(), "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
