"""Brute force for decontamination, fingerprints and the pipeline; edges of all operators."""

import numpy as np
import pytest
import regex
from pyspark.sql import functions as F

import corpus_pipeline as cp
from tarja.llm import chat, decontaminate, fingerprint, langid, minhash, packing, recompress, suffix_dedup, token_ids, toxicity
from tarja.llm.common import NULL_ID, documents, table


# ---- decontamination ------------------------------------------------------------------------------------------------
def _least_edits(pattern: bytes, text: bytes) -> int:
    """The least edit distance of the pattern to any part of the text."""
    row = np.zeros(len(text) + 1, np.int64)
    at = np.arange(len(text) + 1)
    t = np.frombuffer(text, np.uint8)
    for i, c in enumerate(pattern):
        new = np.r_[i + 1, np.minimum(row[:-1] + (t != c), row[1:] + 1)]
        row = np.minimum.accumulate(new - at) + at
    return int(row.min())


def _hit(item: str, text: str) -> bool:
    fold = lambda s: s.lower().encode().translate(bytes(32 if 9 <= i <= 13 else i for i in range(256)))
    b, t = fold(item), fold(text)
    if len(b) < decontaminate.Q or not t:
        return False
    m = min(len(b), decontaminate.WINDOW)
    k = decontaminate.EDITS if len(b) >= decontaminate.WINDOW else min(len(b) // 16, (len(b) - decontaminate.Q) // decontaminate.Q)
    return any(_least_edits(b[i : i + m], t) <= k for i in range(len(b) - m + 1))


@pytest.mark.parametrize("block_bytes", [8 << 20, 100])
def test_decontamination_finds_what_brute_force_finds(spark, block_bytes):
    rng = np.random.default_rng(12)
    word = lambda n: "".join(rng.choice(list("abcd é"), n))
    items = [word(70), word(60), word(30), word(12), word(5), "", None]
    texts = ["", None, "one"]
    for _ in range(90):
        item = items[int(rng.integers(0, 4))]
        lo = int(rng.integers(0, max(1, len(item) - 50)))
        part = list(item[lo : lo + int(rng.integers(44, 56))])
        for _ in range(int(rng.integers(0, 6))):
            at = int(rng.integers(0, len(part)))
            part[at : at + int(rng.integers(0, 2))] = [word(1)] * int(rng.integers(0, 2))
        texts.append(word(int(rng.integers(0, 60))) + "".join(part) + word(int(rng.integers(0, 60))))
    texts += [texts[-1], texts[-1].upper()]
    want = sorted((i, j) for i, t in enumerate(texts) for j, x in enumerate(items) if x and t and _hit(x, t))
    assert 30 < len({i for i, _ in want}) < 92
    docs = documents(spark.createDataFrame([(i, t, 0) for i, t in enumerate(texts)], "doc_id long, text string, item_id long"))
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    assert sorted((r["doc_id"], r["item_id"]) for r in decontaminate.contaminated(docs, bench, block_bytes).collect()) == want
    left = {r["doc_id"] for r in decontaminate.clean(docs, bench, block_bytes).collect()}
    assert left == set(range(len(texts))) - {i for i, _ in want}


# ---- fingerprints ---------------------------------------------------------------------------------------------------
def _tree(text: str) -> list[list[tuple]]:
    sections = regex.split(r"(?<=\n[ \t]{0,8}\n)(?=[^\n])", text)
    return [[tuple(regex.findall(fingerprint.LEAF, p)) for p in regex.split(r"(?<=\n)", s)] for s in sections]


def _like(a: str, b: str) -> float:
    if a == b:
        return 1.0
    x, y = ({(p, leaf) for s in _tree(t) for p in s for leaf in p} for t in (a, b))
    u, v = {leaf for _, leaf in x - y}, {leaf for _, leaf in y - x}
    most = len(x & y) + max(len(u), len(v))
    return (len(x & y) + len(u & v)) / most if most else 0.0


def test_fingerprints_equal_brute_force(spark, tmp_path):
    rng = np.random.default_rng(13)
    word = lambda: "".join(rng.choice(list("abé中"), rng.integers(1, 9)))
    text = lambda n: "".join(word() + str(rng.choice([" ", " ", " ", "\n", "\n\n", "  "])) for _ in range(n))
    texts = ["", None, "x", "a" * 200, "a" * 200, text(5), text(300), text(40), text(40), "\n\n \n", text(3000), "b c\n" * 9]
    rows = [(10 * i, t, "k", "b") for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, root string, range string").repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    got = {r["doc_id"]: r for r in fingerprint.op10_fingerprints(spark, str(tmp_path)).collect()}
    prints = {}
    for i, t in enumerate(texts):
        t, n = t or "", texts[(i + 1) % len(texts)] or ""
        half = len(t) // 2
        edited = t[: len(t) - half] + n[:half]
        import hashlib

        r = got[10 * i]
        assert (r["n_chars"], r["edited_sha256"]) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        assert r["near_edited"] == pytest.approx(_like(t, edited)) and r["near_next"] == pytest.approx(_like(t, n))
        for f, own in ((r["fingerprint"], t), (r["edited_fingerprint"], edited)):
            assert prints.setdefault(f, own) == own
    assert len(set(prints.values())) == len(prints)


def test_edits_are_located(spark):
    one = "a b c d e f\ng h i j\n\nk l m\nn o p q r s\n"
    two = one.replace("n o p", "n o X")
    df = spark.createDataFrame([(one, two)], "a string, b string")
    r = df.select(fingerprint.edits(fingerprint.tree(F.col("b")), fingerprint.tree(F.col("a"))).alias("e"), fingerprint.edits(fingerprint.tree(F.col("a")), fingerprint.tree(F.col("a"))).alias("none")).first()
    assert [tuple(x) for x in r["e"]] == [(1, 1, 0)] and r["none"] == []


# ---- learned operators ----------------------------------------------------------------------------------------------
def test_toxicity_ranks_label_1_first(spark):
    sf = "/root/testdata/sf0.1"
    labels = table(spark, sf, "labels").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    rows = toxicity.op7_toxicity(spark, sf).join(labels, "doc_id").where("held_out and toxic is not null").collect()
    y, s, p = (np.array([r[c] for r in rows], float) for c in ("toxic", "score", "predicted"))
    assert y.sum() >= 20
    recall, precision = p[y == 1].mean(), y[p == 1].mean()
    ranked = np.mean((s[y == 1][:, None] > s[y == 0]) + 0.5 * (s[y == 1][:, None] == s[y == 0]))
    assert recall > 0.7 and precision > 0.7 and ranked > 0.9


def test_every_language_of_many_is_learned(spark):
    rng = np.random.default_rng(14)
    rows = []
    for k in range(30):
        letters = list("abcdefghijklmnopqrstuvwxyz")
        rng.shuffle(letters)
        rows += [(40 * k + i, " ".join("".join(rng.choice(letters[:5], 4)) for _ in range(30)), f"l{k:02}") for i in range(20)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    langs, _ = langid.fit(df, most_rows=300)
    assert langs == [f"l{k:02}" for k in range(30)]


# ---- edges ----------------------------------------------------------------------------------------------------------
def test_empty_tables_give_no_rows(spark):
    import public_tokenizers

    docs = spark.createDataFrame([], "doc_id long, text string")
    labelled = spark.createDataFrame([], "doc_id long, text string, toxic int")
    bench = spark.createDataFrame([], "item_id long, text string")
    turns = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert decontaminate.contaminated(docs, bench).count() == decontaminate.clean(docs, bench).count() == 0
    assert token_ids.read_token_ids(token_ids.write_token_ids(docs, public_tokenizers.path("word_bpe_49k.json"), 2)).count() == 0
    assert langid.classify(docs, *langid.fit(docs.withColumn("lang", F.lit("x")))).count() == 0
    assert toxicity.score(docs, toxicity.fit(labelled)).count() == 0
    assert chat.read_chat(chat.format_chat(turns)).count() == 0
    assert fingerprint.with_next(docs, 4).count() == 0
    one = spark.createDataFrame([(1, "text")], "doc_id long, text string")
    assert [r["score"] for r in toxicity.score(one, toxicity.fit(labelled)).collect()] == [0.0]
    assert decontaminate.clean(one, bench).count() == 1
    assert [r["next_text"] for r in fingerprint.with_next(one, 4).collect()] == ["text"]


def test_null_and_repeated_ids_and_long_texts(spark):
    """A row for each row; a null id acts as the smallest; rows of one id leave each other alone."""
    import public_tokenizers

    text = " ".join(f"w{i}" for i in range(40))
    long = " ".join(f"x{i % 977}" for i in range(60_000))
    rows = [(None, text), (None, text), (3, text), (3, text), (5, long), (6, long + " end"), (7, None), (7, "")]
    docs = documents(spark.createDataFrame([(i, t, "b", 1) for i, t in rows], "doc_id long, text string, block string, start long"))
    n = lambda df, c: sorted((None if r["doc_id"] == NULL_ID else r["doc_id"], r[c]) for r in df.collect() if r["doc_id"] is not None and r["doc_id"] != NULL_ID)
    cut = suffix_dedup.suffix_dedup(docs)
    assert cut.count() == 8 and n(cut, "n_removed")[:2] == [(3, len(text)), (3, len(text))]
    assert [r["n_removed"] for r in cut.where(F.col("doc_id") == NULL_ID).collect()] == [0, 0]
    words = recompress.substring_dedup(docs)
    assert words.count() == 8 and n(words, "n_removed")[:2] == [(3, 40), (3, 40)] and n(words, "n_removed")[-3] == (6, 60_000)
    near = minhash.near_duplicates(docs)
    assert near.count() == 8 and {r["component_id"] for r in near.where("doc_id = 3").collect()} == {NULL_ID}
    ids = token_ids.read_token_ids(token_ids.write_token_ids(docs, public_tokenizers.path("word_bpe_49k.json"), 2)).collect()
    assert len(ids) == 8 and sum(r["n_tokens"] for r in ids) == max(r["start"] + r["n_tokens"] for r in ids)
    packed = packing.pack(docs).groupBy("doc_id").agg(F.sum("n_tokens").alias("n"))
    assert {r["doc_id"]: r["n"] for r in packed.collect()} == {NULL_ID: 80, 3: 80, 5: 60_000, 6: 60_001, 7: 0}
    assert fingerprint.with_next(docs, 3).count() == 8
    scored = toxicity.score(docs, toxicity.Model({}, None, None))
    assert scored.count() == 8 and langid.classify(docs, ["en"], np.ones((langid.BINS, 1), np.float32)).count() == 8


# ---- the pipeline ---------------------------------------------------------------------------------------------------
def test_pipeline_equals_brute_force(spark, tmp_path):
    rng = np.random.default_rng(15)
    words = lambda n: " ".join("".join(rng.choice(list("bcdfghaeiou"), rng.integers(3, 8))) for _ in range(n))
    texts = {i: words(int(rng.integers(40, 90))) for i in range(160)}
    toxic = set(range(0, 160, 4))
    for i in toxic:
        texts[i] += " you vile scum you worthless vermin " * 2
    bench = [words(20) for _ in range(3)]
    leaked = {21: bench[0], 45: bench[1] + " " + words(20)}
    for i, x in leaked.items():
        texts[i] = words(10) + " " + x + " " + words(10)
    passage = words(25)
    for i in (30, 61, 101):
        texts[i] = words(30) + " " + passage + " " + words(30)
    for i, j in ((200, 33), (201, 33), (202, 35)):  # copies, the last but for its end
        texts[i] = texts[j] + (" " + words(1) if i == 202 else "")
    texts |= {210: "", 211: None}
    docs = [(i, t, "en", "s", len(t or ""), "k") for i, t in texts.items()]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long, own string").repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, 1, int(i in toxic)) for i in texts], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame(list(enumerate(bench)), "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    # brute force: labels decide, then near copies, repeated bytes, benchmark passages
    kept = {i: t for i, t in texts.items() if i not in toxic}
    grams = {i: {tuple((t or "").split()[k : k + 5]) for k in range(len((t or "").split()) - 4)} for i, t in kept.items()}
    for i in sorted(kept):
        if any(j < i and grams[i] and 100 * len(grams[i] & grams[j]) >= 80 * len(grams[i] | grams[j]) for j in kept):
            del kept[i]
    assert {200, 201, 202}.isdisjoint(kept)
    first = {}
    for i in sorted(kept):
        b = (kept[i] or "").encode()
        for k in range(len(b) - 49):
            first.setdefault(b[k : k + 50], i)
    for i in list(kept):
        b, gone = (kept[i] or "").encode(), set()
        for k in range(len(b) - 49):
            if first[b[k : k + 50]] < i:
                gone |= set(range(k, k + 50))
        kept[i] = bytes(x for k, x in enumerate(b) if k not in gone).decode()
    kept = {i: t for i, t in kept.items() if not any(_hit(x, t) for x in bench)}
    assert set(leaked).isdisjoint(kept)
    got = cp.run(spark, str(tmp_path)).collect()
    assert sorted((r["doc_id"], r["n_tokens"]) for r in got) == sorted((i, len(t.split())) for i, t in kept.items())


def test_pipeline_of_empty_tables(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert cp.run(spark, str(tmp_path)).count() == 0
