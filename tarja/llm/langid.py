"""Operator 6, language identification: blended-spectrum presence kernel, Nystroem landmarks, one-versus-rest kernel ridge.

A text's spectrum is the set of hashed byte n-grams (n = 1..4, letters lower-cased, every other ASCII sign a blank). The
kernel of two texts is |A n B| / sqrt(|A||B|). Fitting takes about `per_language` texts of each language, or as many as make
`most_rows` in all where there are many languages (chosen by a hash of id and text, over all labelled rows), and draws `landmarks` of them; ridge regression on the Nystroem features gives a
weight per landmark and language. As the kernel is linear in presence, landmarks fold into one matrix, and scoring is one
product of a presence batch with it. Whole texts are scored; a text that is null or has no letter is `und` with score 0.
Ties go to the first language by name; without any learnable row all is `und`. Null ids are scored and never fitted.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarja.llm.common import slices, table, texts_as_bytes

BINS = 1 << 15
SPANS = (1, 2, 3, 4)
_CLEAN = np.arange(256, dtype=np.uint32)
_CLEAN[:128] = 32
_CLEAN[97:123] = np.arange(97, 123)
_CLEAN[65:91] = np.arange(97, 123)


def presence(data: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A row of BINS flags per text."""
    counts = np.diff(np.r_[0, ends])
    out = np.zeros(len(ends) * BINS, bool)
    code = _CLEAN[data]
    base = np.repeat(np.arange(len(ends), dtype=np.int64) * BINS, counts)
    left = np.repeat(ends, counts) - np.arange(len(data))
    grams = np.zeros(len(data), np.uint32)
    for n in SPANS:
        shifted = code if n == 1 else np.r_[code[n - 1 :], np.zeros(min(n - 1, len(code)), np.uint32)][: len(code)]
        grams = (grams << np.uint32(8)) | shifted
        keys = ((grams * np.uint32(2654435761) + np.uint32(n * 0x9E3779B1 & 0xFFFFFFFF)) * np.uint32(0x85EBCA6B)) >> np.uint32(17)
        ok = left >= n
        out[base[ok] + keys[ok]] = True
    return out.reshape(len(ends), BINS)


def held_out(doc_id="doc_id"):
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0


def fit(rows: DataFrame, per_language: int = 500, landmarks: int = 300, ridge: float = 0.3, seed: int = 11, most_rows: int = 16_000) -> tuple[list[str], np.ndarray]:
    """Languages and the folded matrix (BINS x languages). rows: doc_id, text, lang; what reaches the driver is about
    `most_rows` bitmaps of 4 kB at most, and every language that is in the sample is learned."""
    counts = rows.groupBy("lang").agg(F.count("*").alias("n"))
    n_langs = counts.count()
    if not n_langs:
        return [], np.zeros((BINS, 0), np.float32)
    chance = F.pmod(F.xxhash64("doc_id", "text", F.lit(seed)), F.lit(1 << 30)) / float(1 << 30)
    drawn = rows.join(counts.hint("broadcast") if n_langs <= 100_000 else counts, "lang").where(chance * F.col("n") < min(per_language, most_rows / n_langs)).select("doc_id", "text", "lang")

    def bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 1 << 20):
                flags = presence(*texts_as_bytes(part.column(1)))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array([r.tobytes() for r in np.packbits(flags, axis=1)], pa.binary())], names=["doc_id", "lang", "bits"])

    got = drawn.select("doc_id", F.lower("text").alias("text"), "lang").mapInArrow(bits, "doc_id long, lang string, bits binary").collect()
    got.sort(key=lambda r: (r["doc_id"], r["bits"]))
    langs = sorted({r["lang"] for r in got})
    if not langs:
        return [], np.zeros((BINS, 0), np.float32)
    packed = np.stack([np.frombuffer(r["bits"], np.uint8) for r in got])
    target = np.array([langs.index(r["lang"]) for r in got])
    rng = np.random.default_rng(seed)
    mark = np.sort(np.concatenate([rng.permutation(np.flatnonzero(target == c))[: max(2, landmarks // len(langs))] for c in range(len(langs))]))
    unpack = lambda rows: np.unpackbits(rows, axis=1).astype(np.float32)
    marks = unpack(packed[mark])
    marks /= np.sqrt(np.maximum(1, marks.sum(1, keepdims=True)))
    kernel = []
    for i in range(0, len(packed), 256):
        x = unpack(packed[i : i + 256])
        kernel.append((x @ marks.T) / np.sqrt(np.maximum(1, x.sum(1, keepdims=True))))
    k_nm = np.concatenate(kernel).astype(np.float64)
    values, vectors = np.linalg.eigh((marks @ marks.T).astype(np.float64))
    keep = values > 1e-6 * values.max()
    root = vectors[:, keep] / np.sqrt(values[keep])  # K_mm to the power -1/2
    phi = k_nm @ root
    y = np.where(target[:, None] == np.arange(len(langs)), 1.0, 0.0)
    weight = 1.0 / np.bincount(target, minlength=len(langs))[target]  # languages count alike
    weight = weight[:, None] * len(got) / len(langs)
    w = np.linalg.solve(phi.T @ (weight * phi) + ridge * np.eye(phi.shape[1]), phi.T @ (weight * y))
    return langs, (marks.T @ (root @ w)).astype(np.float32)


def classify(docs: DataFrame, langs: list[str], matrix: np.ndarray) -> DataFrame:
    """doc_id, lang_pred, score for (doc_id, text). The model is a matrix of fixed height; it travels with the function."""

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for big in slices(batch, 1 << 20):
                for at in range(0, big.num_rows, 64):
                    part = big.slice(at, 64)
                    x = presence(*texts_as_bytes(part.column(1))).astype(np.float32)
                    s = np.clip((x @ matrix) / np.sqrt(np.maximum(1, x.sum(1, keepdims=True))), 1e-6, None)
                    letter = np.asarray(part.column(2).fill_null(False).to_numpy(zero_copy_only=False), bool) & bool(langs)
                    best = s.argmax(1) if langs else np.zeros(len(x), int)
                    names = [langs[b] if ok else "und" for b, ok in zip(best, letter)]
                    value = np.where(letter, s[np.arange(len(x)), best] / s.sum(1), 0.0) if langs else np.zeros(len(x))
                    yield pa.RecordBatch.from_arrays([part.column(0), pa.array(names, pa.string()), pa.array(value, pa.float64())], names=["doc_id", "lang_pred", "score"])

    rows = docs.select("doc_id", F.lower("text").alias("text"), F.col("text").rlike(r"\p{L}").alias("letter"))
    return rows.mapInArrow(score, "doc_id long, lang_pred string, score double")


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    langs, matrix = fit(docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out()))
    return classify(docs, langs, matrix).select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "lang_pred", "score")
