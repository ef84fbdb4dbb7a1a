"""Every operator against a brute-force version on a small table with nulls, empty and long texts, ties and repeated rows."""

import hashlib
import re
import zlib

import numpy as np
import pytest

from oracle import connect, differences
from tarja.llm import chat, common, decontaminate, fingerprint, graph, langid, minhash, packing, recompress, registry, suffix_dedup, token_ids, toxicity
from tarja.llm.common import documents, table
from tarja.llm.suffix import sorted_suffixes

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def _texts():
    rng = np.random.default_rng(1)
    word = lambda: "".join(rng.choice(list("abcdeéfg"), rng.integers(2, 7)))
    base = [" ".join(word() for _ in range(n)) for n in (5, 60, 90, 120, 200, 3000)]
    near = []
    for _ in range(40):
        w = base[3].split()
        w[rng.integers(0, len(w))] = word()
        near.append(" ".join(w))
    return [None, "", "one", "Two Words", "two words", *base, base[1], base[4] + "\n" + base[2], base[2] + " " + base[2], "a " * 50, *near, " \t\n "]


@pytest.fixture(scope="module")
def rows():
    return list(enumerate(_texts()))


@pytest.fixture(scope="module")
def docs(spark, rows):
    df = spark.createDataFrame([(i, t, "x", "y", 0) for i, t in rows], "doc_id long, text string, key string, block string, u long")
    return documents(df.repartition(3))


def test_minhash_links_what_brute_force_links(docs, rows):
    sets = {}
    for i, t in rows:
        w = WORD.findall((t or "").translate({c: c + 32 for c in range(65, 91)}))
        sets[i] = {tuple(w[k : k + 3]) for k in range(len(w) - 2)} if len(w) >= 3 else {tuple(w)} if w else set()
    up = {i: i for i in sets}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in sets:
        for j in range(i):
            if sets[i] and 100 * len(sets[i] & sets[j]) >= 85 * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                up[max(a, b)] = min(a, b)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in minhash.near_duplicates(docs, 3, 85).collect()}
    assert got == {i: (len(s), find(i), find(i) == i) for i, s in sets.items()}


def test_minhash_finds_lone_pairs_in_a_crowded_template(spark):
    rng = np.random.default_rng(6)
    word = lambda n: [f"w{x}" for x in rng.integers(0, 10**9, n)]
    head = word(178)
    texts = [head + word(22) for _ in range(700)]
    for i in range(0, 60, 2):  # pairs at the threshold: 7 of the 22 own words are shared
        texts[i + 1] = texts[i][:185] + word(15)
    texts[699] = texts[698][:183] + word(17)  # under it
    sets = [{tuple(t[k : k + 3]) for k in range(len(t) - 2)} for t in texts]
    alike = lambda i, j: len(sets[i] & sets[j]) / len(sets[i] | sets[j])
    assert alike(2, 5) < alike(698, 699) < 0.85 <= alike(0, 1) < 0.86
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in minhash.near_duplicates(docs, 3, 85).collect()}
    assert got == {i: i - 1 if i < 60 and i % 2 else i for i in range(700)}


def _thue_morse(a: str, b: str, n: int) -> str:
    return "".join((a, b)[bin(i).count("1") & 1] for i in range(n))


def test_structured_words_do_not_share_a_hash(spark):
    one, two = _thue_morse("a", "b", 2048), _thue_morse("b", "a", 2048)
    data = np.frombuffer((one + two + "a" * 200 + "b" * 200).encode(), np.uint8)
    edges = np.array([0, 2048, 4096, 4296, 4496])
    for lane in common.word_hashes(data, edges[:-1], edges[1:], 2):
        assert len(set(lane.tolist())) == 4
    docs = spark.createDataFrame([(i, " ".join([w] * 13)) for i, w in enumerate((one, two))], "doc_id long, text string")
    assert {r["doc_id"]: r["n_removed"] for r in recompress.substring_dedup(docs).collect()} == {0: 0, 1: 0}
    assert {r["doc_id"]: r["component_id"] for r in minhash.near_duplicates(docs, 3, 85).collect()} == {0: 0, 1: 1}


def test_regions_of_a_sorted_order():
    rng = np.random.default_rng(8)
    order = rng.integers(0, 3, (900, minhash.ORDER)).astype(">u2")
    tree = np.repeat([0, 1, 2], 300).astype(np.int32)
    by = np.lexsort((*order.T[::-1], tree))
    order, node = order[by], np.arange(900)
    found, crowds = minhash.regions(tree, order, node, False, False)
    for _, a, b in found:
        assert 1 < b - a <= minhash.REGION
    together = {(i, j) for _, a, b in found for i in range(a, b) for j in range(i + 1, b)}
    prefix = lambda i: (tree[i], *order[i, : minhash.SHALLOW])
    size = {}
    for i in range(900):
        size[prefix(i)] = size.get(prefix(i), 0) + 1
    for i in range(900):
        for j in range(i + 1, 900):
            if prefix(i) == prefix(j) and (size[prefix(i)] <= minhash.REGION or j - i <= minhash.REGION // 2):
                assert (i, j) in together
    open_ = minhash.regions(tree, order, node, True, True)[1]
    assert {a for _, a, _ in crowds} <= {a for _, a, _ in open_} and {0, 900} <= {x for _, a, b in open_ for x in (a, b)}


def test_long_texts_in_a_large_family(spark):
    """Sets above the sketches' size in regions above REGION: near copies, copies at the threshold and copies under it."""
    rng = np.random.default_rng(9)
    word = lambda n: [f"w{x}" for x in rng.integers(0, 10**9, n)]
    texts = []
    for family in range(2):
        head = word(600)
        for i in range(90):
            t = list(head)
            for at in rng.choice(600, int(rng.integers(0, 34)), replace=False):
                t[at] = word(1)[0]
            texts.append(t)
    sets = [{tuple(t[k : k + 3]) for k in range(len(t) - 2)} for t in texts]
    up = list(range(len(texts)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(texts)):
        for j in range(i):
            if 100 * len(sets[i] & sets[j]) >= 85 * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                up[max(a, b)] = min(a, b)
    assert 5 < len({find(i) for i in range(len(texts))}) < 170
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in minhash.near_duplicates(docs, 3, 85).collect()}
    assert got == {i: find(i) for i in range(len(texts))}


def test_minhash_with_null_and_repeated_ids_and_clashing_columns(spark):
    rows = [(None, "a b c d", 1), (None, "p q r s", 1), (4, "a b c d", 1), (4, "x y z v", 1), (9, "x y z v", 1), (9, "x y z v", 1), (7, "", 1), (8, "p q r s t u", 1)]
    docs = documents(spark.createDataFrame(rows, "doc_id long, text string, node long"))
    got = sorted((r["doc_id"], r["component_id"], r["kept"]) for r in minhash.near_duplicates(docs, 3, 85).collect())
    low = common.NULL_ID
    assert got == [(low, low, True), (low, low, True), (4, low, False), (4, low, False), (7, 7, True), (8, 8, True), (9, low, False), (9, low, False)]


def test_deeper_levels_tell_long_texts_apart(spark):
    rng = np.random.default_rng(5)
    texts = [" ".join(map(str, rng.integers(0, 10**9, 1500))) for _ in range(40)]
    got = minhash._signed(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), 3).collect()
    seen = np.frombuffer(b"".join(r["sig"] for r in got), ">u2") >> 8
    assert np.bincount(seen, minlength=256).max() < 0.02 * len(seen)


@pytest.mark.parametrize("few", [0, 10**6])
def test_components_by_both_ways(spark, few):
    rng = np.random.default_rng(2)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 300, (220, 2))] + [(i, i + 1) for i in range(1000, 1040)]
    up = {x: x for e in edges for x in e}
    for _ in range(100):
        for a, b in edges:
            up[a] = up[b] = min(up[a], up[b])
    got = {r["node"]: r["component"] for r in graph.components(spark.createDataFrame(edges, "a long, b long"), few=few).collect()}
    assert got == {x: c for x, c in up.items() if x in got} and all(up[x] == x for x in up if x not in got)


def test_suffix_dedup_removes_what_brute_force_removes(docs, rows):
    seen, want = {}, {}
    for i, t in rows:
        b = (t or "").encode()
        for k in range(len(b) - 49):
            seen.setdefault(b[k : k + 50], i)
    for i, t in rows:
        b = (t or "").encode()
        gone = np.zeros(len(b), bool)
        for k in range(len(b) - 49):
            if seen[b[k : k + 50]] < i:
                gone[k : k + 50] = True
        want[i] = int(gone.sum())
    import pyarrow as pa

    schema = pa.schema([("doc_id", pa.int64()), ("n", pa.int64())])

    def finish(block, gone):
        a = 0
        for d, b in zip(block.docs.tolist(), block.ends.tolist()):
            yield d, int(gone[a:b].sum())
            a = b

    assert {r["doc_id"]: r["n"] for r in suffix_dedup.removed_bytes(docs, 50, "doc_id long, n long", schema, finish).collect()} == want
    assert {r["doc_id"] for r in suffix_dedup.suffix_dedup(docs).collect()} == {i for i, _ in rows}


@pytest.mark.parametrize("held", [0, 1 << 20])
def test_suffixes_are_sorted(held):
    rng = np.random.default_rng(3)
    for n in (3, 10, 200):
        s = np.r_[rng.integers(1, 4, n), 0].astype(np.uint16)
        assert sorted_suffixes(s, n + 2, held).tolist() == sorted(range(len(s)), key=lambda i: s[i:].tolist())


def test_substring_dedup_removes_what_brute_force_removes(docs, rows):
    seen, want = {}, {}
    words = {i: WORD.findall(t or "") for i, t in rows}
    for i, w in words.items():
        for k in range(len(w) - 12):
            seen.setdefault(tuple(w[k : k + 13]), i)
    for i, w in words.items():
        gone = [False] * len(w)
        for k in range(len(w) - 12):
            if seen[tuple(w[k : k + 13])] < i:
                gone[k : k + 13] = [True] * 13
        want[i] = (len(w), sum(gone), " ".join(x for x, g in zip(w, gone) if not g))
    assert {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept"]) for r in recompress.substring_dedup(docs).collect()} == want


def test_token_ids_round_trip(docs, rows):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    got = {r["doc_id"]: r for r in token_ids.read_token_ids(token_ids.write_token_ids(docs, path, 2, 3)).collect()}
    at, t = 0, Tokenizer.from_file(path)
    for i, text in rows:
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 2]
        assert (got[i]["start"], got[i]["n_tokens"], zlib.crc32(got[i]["ids"])) == (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)


def test_simple8b_with_escapes():
    rng = np.random.default_rng(4)
    ids = np.r_[rng.integers(0, 2, 500), rng.integers(0, 2**63, 50, dtype=np.uint64), rng.integers(0, 50000, 500)].astype(np.uint64)
    words, _ = token_ids.pack(ids, np.array([100, 100, 700, len(ids)]))
    assert (token_ids.unpack(words) == ids).all()


def test_packing_holds_every_token_once_with_least_padding(docs, rows):
    got = packing.pack(docs, max_len=100, buckets=3, budget=400).collect()
    n = {i: len(WORD.findall(t or "")) for i, t in rows}
    assert {i: sum(r["n_tokens"] for r in got if r["doc_id"] == i) for i in n} == n
    for r in got:
        assert r["n_tokens"] <= r["bucket_len"] <= 100 and r["slot"] < max(1, 400 // max(1, r["bucket_len"]))
    assert len({(r["bucket_len"], r["batch"], r["slot"]) for r in got}) == len(got)
    from itertools import combinations

    lengths = sorted({r["n_tokens"] for r in got})
    pad = lambda tops: sum(min(t for t in tops if t >= r["n_tokens"]) - r["n_tokens"] for r in got)
    assert pad({r["bucket_len"] for r in got}) == min(pad((*c, lengths[-1])) for c in combinations(lengths[:-1], 2))


def test_decontamination_finds_passages_with_edits_and_leaves_others(spark, docs):
    passage = "the quick brown fox jumps over the lazy dog while seventeen wizards brew potions"
    edited = passage.replace("lazy", "lazzy").replace("brown", "brwn")
    own = spark.createDataFrame([(1, "x " * 40 + edited + " y" * 9), (2, "nothing to see here at all, only plain words of no item"), (3, None), (4, ""), (5, passage.upper())], "doc_id long, text string")
    items = spark.createDataFrame([(7, passage), (8, None), (9, "")], "item_id long, text string")
    assert sorted((r["doc_id"], r["item_id"]) for r in decontaminate.contaminated(own, items).collect()) == [(1, 7), (5, 7)]
    assert sorted(r["doc_id"] for r in decontaminate.clean(own, items).collect()) == [2, 3, 4]


def test_language_and_toxicity_on_held_out_rows(spark):
    d, labels = table(spark, "/root/testdata/sf0.01", "documents"), table(spark, "/root/testdata/sf0.01", "labels")
    rows = langid.op6_language_id(spark, "/root/testdata/sf0.01").join(d.select("doc_id", "lang"), "doc_id").where("held_out and lang is not null").collect()
    assert np.mean([r["lang"] == r["lang_pred"] for r in rows]) > 0.95
    rows = toxicity.op7_toxicity(spark, "/root/testdata/sf0.01").join(labels, "doc_id").where("held_out and toxic is not null").collect()
    assert np.mean([r["predicted"] == r["toxic"] for r in rows]) > 0.9
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_und_without_letters(docs):
    got = {r["doc_id"]: r["lang_pred"] for r in langid.classify(docs, ["en"], np.ones((langid.BINS, 1), np.float32)).collect()}
    assert got[0] == got[1] == "und" and got[2] == "en"


def test_chat_reads_back(spark):
    turns = spark.createDataFrame([(1, 0, "user", 'a<b & "c" </turn>', 9), (1, 1, "assistant", "<part/>", 9), (1, 2, "assistant", None, 9), (2, 0, None, "x", 9)], "conv_id long, turn long, role string, text string, turns long")
    got = {r["conv_id"]: r for r in chat.read_chat(chat.format_chat(turns)).collect()}
    assert [tuple(t) for t in got[1]["turns"]] == [("user", 'a<b & "c" </turn>'), ("assistant", "<part/>"), ("assistant", "")]
    assert got[1]["loss_text"] == "<part/>" and got[2]["loss_text"] == ""


@pytest.mark.parametrize("n", [1, 2, 3, 50, 20_000])
def test_long_conversations(spark, n):
    rng = np.random.default_rng(n)
    rows = [(int(i), ["user", "assistant", "tool"][rng.integers(0, 3)] if n < 1000 or i < n // 2 else "assistant", ["", "é<b", "x & y " * 5, "𝛼 turn"][rng.integers(0, 4)]) for i in range(n)]
    turns = spark.createDataFrame([(9, *r) for r in rows], "conv_id long, turn long, role string, text string").repartition(3)
    formatted = chat.format_chat(turns)
    got = chat.read_chat(formatted).select("turns", "loss_text", "formatted").first()
    esc = lambda x: x.replace("&", "&amp;").replace("<", "&lt;").replace('"', "&quot;")
    text, spans, before = "", [], None
    for _, role, said in rows:
        text += "<part/>" if role == before else ("</turn>\n" if before else "") + f'<turn role="{role}">'
        spans += [(len(text), len(text) + len(esc(said)))] if role == "assistant" else []
        text, before = text + esc(said), role
    assert got["formatted"] == text + "</turn>\n"
    assert [tuple(s) for s in formatted.first()["loss_spans"]] == spans
    assert [tuple(t) for t in got["turns"]] == [r[1:] for r in rows]
    assert got["loss_text"] == "".join(r[2] for r in rows if r[1] == "assistant")


def test_chat_equals_sql(spark):
    assert differences(registry.queries()["op9_chat_formatting"](spark, SF), connect(SF), registry.oracle_sql()["op9_chat_formatting"]) == ""


def test_fingerprints(spark, docs, rows):
    led = {r["doc_id"]: (r["text"], r["next_text"]) for r in fingerprint.with_next(docs, 3).collect()}
    assert led == {i: (t or "", rows[(i + 1) % len(rows)][1] or "") for i, t in rows}
    from pyspark.sql import functions as F

    got = docs.select("doc_id", fingerprint.as_text(fingerprint.tree(F.coalesce("text", F.lit("")))).alias("f")).collect()
    by = {}
    for r in got:
        by.setdefault(r["f"], set()).add(rows[r["doc_id"]][1] or "")
    assert all(len(texts) == 1 for texts in by.values())
    assert hashlib.md5(b"").hexdigest() != got[0]["f"]


@pytest.mark.parametrize("run", [lambda d: minhash.near_duplicates(d), lambda d: suffix_dedup.suffix_dedup(d), lambda d: recompress.substring_dedup(d), lambda d: packing.pack(d)])
def test_empty_tables(spark, docs, run):
    assert run(docs.where("false")).count() == 0


def test_pieces_are_encoded_like_whole_texts():
    import public_tokenizers

    rng = np.random.default_rng(7)
    signs = [*"abcXYZéÉ,.;:!? \n\t'sre019<|>»—½İßﬁ́中🙂\r\x0b\x85", "<|endoftext|>", "'re", "The ", " a"]
    texts = ["", *("".join(rng.choice(signs, rng.integers(0, 60))) for _ in range(300))]
    data = [t.encode() for t in texts]
    encoder = token_ids.Encoder(public_tokenizers.path("word_bpe_49k.json"))
    for most in (1 << 21, 1 << 16):
        encoder.known = token_ids.Known(most)
        ids, counts = encoder(np.frombuffer(b"".join(data), np.uint8), np.cumsum([len(d) for d in data]), 2)
        want = [[*encoder.tokenizer.encode(t, add_special_tokens=False).ids, 2] for t in texts]
        assert ids.tolist() == sum(want, []) and counts.tolist() == [len(w) for w in want]


def test_known_pieces_make_room():
    rng = np.random.default_rng(8)
    known, seen = token_ids.Known(100), {}
    for _ in range(60):
        keys = np.unique(rng.integers(0, 300, 40)).astype(np.uint64) << np.uint64(20)  # all in few slots
        at = known.find(keys, keys)
        for k, i in zip(keys[at >= 0].tolist(), at[at >= 0].tolist()):
            assert known.gather(np.array([i])).tolist() == seen[k]
        known.used[at[at >= 0]] = True
        if known.n + (at < 0).sum() > known.most:
            known.room(int((at < 0).sum()))
            at = known.find(keys, keys)
        new = keys[at < 0]
        count = rng.integers(0, 4, len(new))
        ids = rng.integers(0, 9, int(count.sum())).astype(np.uint32)
        known.add(new, new, count, ids)
        seen |= {k: x.tolist() for k, x in zip(new.tolist(), np.split(ids, np.cumsum(count)[:-1]))}
        at = known.find(keys, keys)
        assert (at >= 0).all() and known.gather(at).tolist() == sum((seen[k] for k in keys.tolist()), [])
