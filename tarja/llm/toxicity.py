"""Operator 7, toxicity: gradient-boosted trees over dense features, isotonic calibration.

Features of a whole text: density, count and spread of words whose stem is in a lexicon learned from the labels (whole words
and stems of four to eight letters by log-odds), second-person words near them, capitals, punctuation, marks, and words
written with signs or digits inside. Fitting reads about `most_rows` labelled rows (chosen by a hash of id and text); for the
isotonic map, each third of them is scored by trees and a lexicon that were learned without it. labels, lang, source and doc_id are never features. Several labels of one
document count as the highest; null labels are ignored. Null or empty text is scored like a text without words; without
labels of both kinds every score is 0. Repeated rows are scored each; an empty table gives no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarja.llm.common import slices, table
from tarja.llm.langid import held_out

YOU = frozenset("you your yours u ur yourself tu te toi ton vous votre du dich dir dein deine sie ihr tú ti usted ustedes vos".split())
_WORDS = re.compile(r"[^\W_]+")
_HIDDEN = re.compile(r"[a-zA-Z][0-9@$!*#.]+[a-zA-Z]")
_PLAIN = str.maketrans("013457@$!", "oieasta" + "si")
_KIND = np.zeros(256, np.uint8)  # 1 capital, 2 sign
_KIND[65:91] = 1
_KIND[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = 2
_HIDE = np.zeros(256, bool)
_HIDE[[*b"0123456789@$!*#."]] = True
_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123)]] = True
STEMS = tuple(range(4, 9))
N_FEATURES, FOLDS = 13, 3


class Weights(dict):
    """A word's weight: that of its longest stem in the lexicon, or 0. Remembers words, up to a bound."""

    def __init__(self, lexicon: dict[str, float], most: int = 120_000):
        super().__init__()
        self.lexicon, self.most = lexicon, most

    def __missing__(self, word: str) -> float:
        get = self.lexicon.get
        found = get(word + "$", 0.0)
        if not found:
            for n in range(min(len(word), STEMS[-1]), STEMS[0] - 1, -1):
                if found := get(word[:n], 0.0):
                    break
        if len(self) > self.most:
            self.clear()
        self[word] = found
        return found


def features(text: str, weights: Weights) -> list[float]:
    low = text.lower()
    words = _WORDS.findall(low)
    n, chars = len(words), len(text)
    w = np.fromiter(map(weights.__getitem__, words), np.float32, n)
    hits = np.flatnonzero(w)
    near = near_share = 0.0
    if len(hits):
        you = np.array([i for i, x in enumerate(words) if x in YOU], np.int64)
        if len(you):
            at = np.searchsorted(you, hits)
            gap = np.minimum(np.abs(you[np.minimum(at, len(you) - 1)] - hits), np.abs(you[np.maximum(at - 1, 0)] - hits))
            near = float((gap <= 5).sum())
            near_share = near / len(hits)
    data = np.frombuffer(text.encode(), np.uint8)
    kinds = np.bincount(_KIND[data], minlength=3)
    hidden = int((_HIDE[data[1:-1]] & _LETTER[data[:-2]] & _LETTER[data[2:]]).sum())
    unmasked = sum(1 for t in low.split() if _HIDDEN.search(t) and any(weights[x] for x in _WORDS.findall(t.translate(_PLAIN)))) if hidden else 0
    return [
        float(len(hits)), float(w.sum()), float(w.sum()) / (n + 20.0), len(hits) / (n + 1.0), float(len({words[i] for i in hits})), float(w.max()) if n else 0.0, near, near_share,
        kinds[1] / (chars + 1.0), kinds[2] / (chars + 1.0), (text.count("!") + text.count("?")) / (n + 1.0), (hidden + 5.0 * unmasked) / (n + 1.0), float(np.log1p(n)),
    ]


def learn_lexicons(rows: DataFrame, size: int = 400, support: int = 4) -> list[dict[str, float]]:
    """The `size` words (ending in $) and stems most tied to label 1: learned without fold 0, 1, ... and, last, from all rows.
    rows: text, toxic (0/1), fold (below FOLDS). The words are counted once, by fold."""
    word = F.array_distinct(F.filter(F.split(F.lower("text"), r"[^\p{L}\p{N}]+"), lambda x: x != ""))
    entries = F.flatten(F.transform(word, lambda x: F.concat(F.array(F.concat(x, F.lit("$"))), *[F.when(F.length(x) >= n, F.array(F.substring(x, 1, n))).otherwise(F.array().cast("array<string>")) for n in STEMS])))
    by_fold = lambda: [F.sum(F.when(F.col("fold") == k, value).otherwise(0.0)).alias(f"{name}{k}") for k in range(FOLDS) for name, value in (("t", F.col("toxic")), ("c", 1 - F.col("toxic")))]
    totals = rows.agg(*by_fold()).first()
    seen = rows.select("toxic", "fold", F.explode(F.array_distinct(entries)).alias("entry")).groupBy("entry").agg(*by_fold())
    seen = seen.where(" + ".join(f"t{k}" for k in range(FOLDS)) + f" >= {support}").persist()
    out = []
    for without in [*range(FOLDS), None]:
        kept = [k for k in range(FOLDS) if k != without]
        bad, good = (sum(totals[f"{name}{k}"] or 0.0 for k in kept) for name in "tc")
        if not bad or not good:
            out.append({})
            continue
        counts = seen.select("entry", F.expr(" + ".join(f"t{k}" for k in kept)).alias("t"), F.expr(" + ".join(f"c{k}" for k in kept)).alias("c")).where(f"t >= {support}")
        odds = F.log((F.col("t") + 0.5) / (bad + 1)) - F.log((F.col("c") + 0.5) / (good + 1))
        # a word is toxic by nature, or shared by chance: keep what is far likelier under label 1
        best = counts.select("entry", odds.alias("odds"), (odds * F.sqrt("t")).alias("score")).where("odds > 1.6").orderBy(F.desc("score"), "entry").limit(size).collect()
        out.append({r["entry"]: float(r["odds"]) for r in best})
    seen.unpersist()
    return out


class Trees:
    """Boosted regression trees of depth 3 on the logistic loss, over histograms."""

    def __init__(self, rounds: int = 100, rate: float = 0.1, bins: int = 48, leaf: float = 8.0, seed: int = 3):
        self.rounds, self.rate, self.bins, self.leaf = rounds, rate, bins, leaf

    def fit(self, x: np.ndarray, y: np.ndarray) -> Trees:
        self.cuts = [np.unique(np.quantile(c, np.linspace(0, 1, self.bins + 1)[1:-1])) for c in x.T]
        b = self._binned(x)
        p = np.clip(y.mean(), 1e-3, 1 - 1e-3)
        self.base, self.trees = float(np.log(p / (1 - p))), []
        f = np.full(len(y), self.base)
        for _ in range(self.rounds):
            p = 1 / (1 + np.exp(-f))
            g, h = y - p, np.maximum(p * (1 - p), 1e-6)
            node, tree = np.ones(len(y), np.int64), {}
            for depth in range(3):
                for k in range(1 << depth, 2 << depth):
                    own = node == k
                    if own.sum() < 2 * self.leaf or (split := self._split(b[own], g[own], h[own])) is None:
                        continue
                    tree[k] = split
                    node[own] = 2 * k + (b[own, split[0]] > split[1])
            values = np.bincount(node, g, minlength=16) / (np.bincount(node, h, minlength=16) + 1.0) * self.rate
            f += values[node]
            self.trees.append((tree, values))
        return self

    def _split(self, b, g, h):
        best, found = 1e-3, None
        total_g, total_h = g.sum(), h.sum()
        for j, cuts in enumerate(self.cuts):
            if not len(cuts):
                continue
            n = np.bincount(b[:, j], minlength=len(cuts) + 1).cumsum()[:-1]
            gl, hl = np.bincount(b[:, j], g, len(cuts) + 1).cumsum()[:-1], np.bincount(b[:, j], h, len(cuts) + 1).cumsum()[:-1]
            gain = gl**2 / (hl + 1) + (total_g - gl) ** 2 / (total_h - hl + 1) - total_g**2 / (total_h + 1)
            gain[(n < self.leaf) | (len(b) - n < self.leaf)] = -1
            k = int(gain.argmax())
            if gain[k] > best:
                best, found = gain[k], (j, k)
        return found

    def _binned(self, x):
        return np.stack([np.searchsorted(c, x[:, j], side="left") for j, c in enumerate(self.cuts)], 1) if len(x) else np.zeros((0, len(self.cuts)), np.int64)

    def margin(self, x: np.ndarray) -> np.ndarray:
        b, f = self._binned(x), np.full(len(x), self.base)
        for tree, values in self.trees:
            node = np.ones(len(x), np.int64)
            for k, (j, cut) in tree.items():  # parents stand before their children
                own = node == k
                node[own] = 2 * k + (b[own, j] > cut)
            f += values[node]
        return f


def isotonic(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool-adjacent-violators: points of a rising step map from x to the mean of y."""
    order = np.argsort(x, kind="stable")
    blocks: list[list[float]] = []  # sum, weight, first x, last x
    for a, b in zip(x[order].tolist(), y[order].tolist()):
        blocks.append([b, 1.0, a, a])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            s, w, _, last = blocks.pop()
            blocks[-1][0] += s
            blocks[-1][1] += w
            blocks[-1][3] = last
    xs = np.array([v for b in blocks for v in (b[2], b[3])])
    ys = np.array([v for b in blocks for v in (b[0] / b[1],) * 2])
    return xs, ys


class Model:
    def __init__(self, lexicon: dict[str, float], trees: Trees | None, steps):
        self.lexicon, self.trees, self.steps = lexicon, trees, steps

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.trees is None:
            return np.zeros(len(x))
        return np.clip(np.interp(self.trees.margin(x), *self.steps), 0.0, 1.0)


def _featured(docs: DataFrame, lexicon: dict[str, float], out: str, finish) -> DataFrame:
    """docs: (doc_id, text, ...) through finish(batch, features)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = Weights(lexicon)
        for batch in batches:
            for part in slices(batch):
                x = np.array([features(t or "", weights) for t in part.column(1).to_pylist()], np.float64).reshape(-1, N_FEATURES)
                yield finish(part, x)

    return docs.mapInArrow(run, out)


def fit(rows: DataFrame, most_rows: int = 16_000, seed: int = 5) -> Model:
    """rows: doc_id, text, toxic. The driver gets some tens of numbers for each of about `most_rows` rows."""
    n = rows.count()
    draw = lambda k: F.pmod(F.xxhash64("doc_id", "text", F.lit(seed + k)), F.lit(1 << 30))
    drawn = rows.where(draw(0) / float(1 << 30) < most_rows / max(1, n))
    drawn = drawn.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.col("toxic").cast("double").alias("toxic"), (draw(1) % FOLDS).cast("int").alias("fold"))
    lexicons = learn_lexicons(drawn)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = [Weights(x) for x in lexicons]
        for batch in batches:
            for part in slices(batch):
                x = [np.concatenate([features(t, w) for w in weights]) for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), part.column(3), pa.array(x, pa.list_(pa.float64()))], names=["doc_id", "toxic", "fold", "x"])

    got = drawn.mapInArrow(run, "doc_id long, toxic double, fold int, x array<double>").collect()
    got.sort(key=lambda r: (r["doc_id"], r["toxic"], r["x"]))
    y, fold = np.array([r["toxic"] for r in got]), np.array([r["fold"] for r in got])
    if not len(y) or y.min() == y.max():
        return Model(lexicons[-1], None, None)
    x = np.array([r["x"] for r in got]).reshape(len(got), FOLDS + 1, N_FEATURES)
    margin = np.zeros(len(y))
    for k in range(FOLDS):
        if 0 < (t := y[fold != k]).sum() < len(t) and (fold == k).any():
            margin[fold == k] = Trees().fit(x[fold != k, k], t).margin(x[fold == k, k])
    return Model(lexicons[-1], Trees().fit(x[:, FOLDS], y), isotonic(margin, y))


def labelled(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, text, toxic of the rows to learn from."""
    known = labels.where("toxic is not null and doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.col("toxic").cast("int")).alias("toxic")).where(~held_out())
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(known, "doc_id")


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id and the other columns but text, score."""
    rest = [c for c in docs.columns if c not in ("doc_id", "text")]
    shape = ", ".join(["doc_id long", *[f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema if f.name in rest], "score double"])
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *[f"`{c}`" for c in rest])
    return _featured(rows, model.lexicon, shape, lambda part, x: pa.RecordBatch.from_arrays([part.column(0), *[part.column(i + 2) for i in range(len(rest))], pa.array(model.score(x), pa.float64())], names=["doc_id", *rest, "score"]))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit(labelled(docs, table(spark, sf_dir, "labels")))
    return score(docs, model).select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def reject(docs: DataFrame, model: Model, at: float = 0.5) -> DataFrame:
    """The rows of docs (text in a column `text`) that score below `at`, unchanged and without a shuffle."""
    place = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = Weights(model.lexicon)
        for batch in batches:
            for part in slices(batch):
                x = np.array([features(t or "", weights) for t in part.column(place).to_pylist()], np.float64).reshape(-1, N_FEATURES)
                yield part.filter(pa.array(model.score(x) < at, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
