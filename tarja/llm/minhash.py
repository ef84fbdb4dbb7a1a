"""Operator 1, MinHash near-dedup by an LSH forest.

A document's set: distinct shingles of k words (A-Z lower-cased; all words as one with fewer), as 64-bit hashes. Documents of
one word sequence (a 128-bit cryptographic name of it) are one node from the start. Each of `TREES` trees is a sorted order of
the nodes by their signatures, each beginning at values of its own. A pass over the orders takes the longest common prefixes of neighbours:
a region is a run whose neighbours share SHALLOW values or more. A region of at most `REGION` nodes is a group of candidates. In
a larger one the depth adapts: the parts that share one value more are regions in turn, down to ORDER values, and each node also
meets its neighbours in the order, whose common prefixes are the longest, in overlapping blocks of REGION. What that leaves in several
components is joined exactly by prefixes of rare shingles (`_prefix_pairs`), so that no region makes all its pairs and none loses a link. Members of a group are compared
by sketches of their sets, exact up to `SKETCH` shingles and within `SIGMAS` deviations beyond, and tied by a forest. Links are confirmed on the
full sets: first each node's best candidate, then all that still join two components; if the sets refute a link of
which a sketch was sure, its groups are searched exactly too. A pair at the threshold
is missed by all trees with a chance of 1e-5 at 0.85 (2e-4 at 0.8).

Null or empty text, or text without words: an empty set, linked with nothing. Repeated rows and equal ids are one node. A null id
acts as the smallest id and is returned as null. Clashing extra columns are never read. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarja.llm.common import _LOWER, Held, arrow_rows, documents, groups, mix, null_id, pair, slices, table, texts_as_bytes, word_hashes, words_of, written
from tarja.llm.graph import components

TREES, DEPTH, SHALLOW, ORDER, REGION = 12, 6, 3, 16, 64
CHUNK = 1 << 17  # rows of an order that a task looks at together
MARKS = 16  # 64-bit words of the bitmap by which the exact search tells sets apart
SKETCH, SIGMAS = 256, 4.5
_RNG = np.random.default_rng(2024)
_ODD = (_RNG.integers(0, 2**31, TREES * DEPTH, dtype=np.uint64) * 2 + 1).astype(np.uint32)
_XOR = _RNG.integers(0, 2**32, TREES * DEPTH, dtype=np.uint64).astype(np.uint32)


def shingle_sets(data: np.ndarray, ends: np.ndarray, k: int) -> list[np.ndarray]:
    """Each text's sorted distinct shingle hashes."""
    data = _LOWER[data]
    a, b, text = words_of(data, ends)
    w = word_hashes(data, a, b)[0]
    h, n = w, len(w)
    for i in range(1, k):
        h = pair(h[: max(0, n - i)], w[i:], i)
    bound = np.searchsorted(text, np.arange(len(ends) + 1))
    out = []
    for i in range(len(ends)):
        lo, hi = int(bound[i]), int(bound[i + 1])
        if hi - lo >= k:
            out.append(np.unique(h[lo : hi - k + 1]))
        elif hi > lo:
            x = np.array([hi - lo], np.uint64)
            for j in range(lo, hi):
                x = pair(x, w[j : j + 1], 99)
            out.append(x)
        else:
            out.append(w[:0])
    return out


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """TREES * DEPTH minima of each set that is not empty (rows of empty sets are zero)."""
    out = np.zeros((len(sets), TREES * DEPTH), np.uint32)
    full = [i for i, s in enumerate(sets) if len(s)]
    if full:
        x = (np.concatenate([sets[i] for i in full]) >> np.uint64(32)).astype(np.uint32)
        starts = np.r_[0, np.cumsum([len(sets[i]) for i in full])[:-1]]
        for j in range(TREES * DEPTH):
            out[full, j] = np.minimum.reduceat((x ^ _XOR[j]) * _ODD[j], starts)
    return out


def sort_values(sig: np.ndarray) -> np.ndarray:
    """Sixteen bits of each minimum that depend on all of its own: the minima of large sets are small, so that their upper bits are all zero."""
    return (mix(sig.astype(np.uint64), 6) & np.uint64(0xFFFF)).astype(">u2")


def sequence_name(text: bytes) -> bytes:
    """A 128-bit name of the words in their order; bytes' white space and lower case are those of ASCII."""
    return hashlib.blake2b(b" ".join(text.lower().split()), digest_size=16).digest()


def _names(data: np.ndarray, ends: np.ndarray) -> list[bytes]:
    text, out, a = data.tobytes(), [], 0
    for b in ends.tolist():
        out.append(sequence_name(text[a:b]))
        a = b
    return out


def _signed(docs: DataFrame, k: int) -> DataFrame:
    """doc_id, n_shingles, key (the name of the word sequence), sig (the values to sort by), sketch."""
    out = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("key", pa.binary()), ("sig", pa.binary()), ("sketch", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 1 << 20):
                data, ends = texts_as_bytes(part.column(1))
                sets = shingle_sets(data, ends, k)
                sig = sort_values(signatures(sets))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array(_names(data, ends), pa.binary()), pa.array([r.tobytes() for r in sig], pa.binary()), pa.array([sketch(s) for s in sets], pa.binary())], schema=out)

    return docs.mapInArrow(run, "doc_id long, n_shingles long, key binary, sig binary, sketch binary")


def sketch(items: np.ndarray) -> bytes:
    """A halving and the hashes that are left: all that lie in the lowest part of 2 ** -halving, at most SKETCH of them."""
    x, halving = (items >> np.uint64(32)).astype(np.uint32), 0
    while len(x) > SKETCH:
        halving += 1
        x = x[x < 1 << (32 - halving)]
    return np.r_[np.uint32(halving), x].astype("<u4").tobytes()


def group_links(sketches: list[bytes], sizes: np.ndarray, percent: int) -> list[tuple[int, int, float]]:
    """(i, j, similarity) that tie the members which are alike: a spanning forest of the sure links, and every unsure one that
    would join two of its trees. Small sets' similarities are exact; the sure links' of others count as 2 and more."""
    parts = [np.frombuffer(x, "<u4") for x in sketches]
    halving = max(int(p[0]) for p in parts)
    parts = [p[1:] if halving == 0 else p[1:][p[1:] < 1 << (32 - halving)] for p in parts]
    n, counts = len(parts), np.array([len(p) for p in parts])
    value, at = np.unique(np.concatenate(parts), return_inverse=True)
    if not len(value):
        return []
    has = np.zeros((n, len(value)), np.float32)
    has[np.repeat(np.arange(n), counts), at] = 1
    shared = has @ has.T
    union = np.maximum(counts[:, None] + counts[None, :] - shared, 1)
    near, least = shared / union, percent / 100
    margin = 0.0 if halving == 0 else SIGMAS * np.sqrt(least * (1 - least) / union)
    fits = 100 * np.minimum(sizes[:, None], sizes[None, :]) >= percent * np.maximum(sizes[:, None], sizes[None, :])
    fits[np.arange(n), np.arange(n)] = False
    sure = fits & (100 * shared >= percent * union if halving == 0 else near >= least + margin)
    tree, out = np.full(n, -1), []
    for root in range(n):
        if tree[root] >= 0:
            continue
        tree[root] = root
        front = np.array([root])
        while len(front):
            link = sure[front] & (tree < 0)
            new = np.flatnonzero(link.any(0))
            by = front[np.where(link[:, new], near[front][:, new], -1).argmax(0)] if len(new) else new
            tree[new] = root
            out += [(i, j, float(near[i, j]) + 2 * (halving > 0)) for i, j in zip(by.tolist(), new.tolist())]
            front = new
    if halving:
        i, j = np.nonzero(np.triu(fits & (near >= least - margin) & (tree[:, None] != tree[None, :])))
        out += list(zip(i.tolist(), j.tolist(), near[i, j].tolist()))
    return out


def _neighbours(rows: DataFrame, percent: int) -> DataFrame:
    """Pairs (a > b) of nodes that tie the members of each group. rows: group, node, n_shingles, sketch; groups have REGION members at most."""
    out = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("near", pa.float32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        add, take = arrow_rows(out)
        for _, parts in groups(batches, "group"):
            t = pa.Table.from_batches(parts)
            if t.num_rows == 1:
                continue
            node = t.column("node").to_numpy()
            for i, j, near in group_links(t.column("sketch").to_pylist(), t.column("n_shingles").to_numpy(), percent):
                if node[i] != node[j]:
                    add(max(int(node[i]), int(node[j])), min(int(node[i]), int(node[j])), near)
            yield from take()
        yield from take(True)

    return rows.select("group", "node", "n_shingles", "sketch").repartition("group").sortWithinPartitions("group", "node").mapInArrow(run, "a long, b long, near float")


def regions(tree: np.ndarray, order: np.ndarray, node: np.ndarray, open_left: bool, open_right: bool) -> tuple[list, list]:
    """The groups and crowds of a stretch of the sorted orders: lists of (group, nodes). tree, order (rows of ORDER values) and
    node are sorted; an open end goes on elsewhere, so that what touches it counts as a crowd. A crowd's number is its tree and
    its first SHALLOW values."""
    n = len(node)
    same = (order[1:] == order[:-1]) & (tree[1:] == tree[:-1])[:, None]
    common = np.r_[0, np.where(same.all(1), ORDER, same.argmin(1))] if n else np.zeros(0, np.int64)
    found, crowds = [], []

    def part(a: np.ndarray, b: np.ndarray, depth: int) -> None:
        number = mix(node[a].astype(np.uint64) * np.uint64(1 << 11) + tree[a].astype(np.uint64) * np.uint64(128) + np.uint64(depth), 11).view(np.int64)
        found.extend(zip(number.tolist(), a.tolist(), b.tolist()))

    start = np.flatnonzero(common < SHALLOW)
    stop = np.r_[start[1:], n]
    edge = np.zeros(len(start), bool)
    edge[:1] |= open_left
    edge[-1:] |= open_right
    size = stop - start
    small = (size > 1) & (size <= REGION)
    part(start[small], stop[small], SHALLOW)
    crowded = (size > REGION) | edge
    name = (tree[start].astype(np.int64) << 48) | (order[start, 0].astype(np.int64) << 32) | (order[start, 1].astype(np.int64) << 16) | order[start, 2].astype(np.int64) if n else start
    crowds.extend(zip(name[crowded].tolist(), start[crowded].tolist(), stop[crowded].tolist()))
    for a, b in zip(start[size > REGION].tolist(), stop[size > REGION].tolist()):
        left = np.arange(a, b - REGION // 2, REGION // 2)
        part(left, np.minimum(left + REGION, b), 0)
        todo = [(a, b)]
        for depth in range(SHALLOW + 1, ORDER + 1):
            deeper = []
            for x, y in todo:
                inner = np.r_[x, x + 1 + np.flatnonzero(common[x + 1 : y] < depth)]
                outer = np.r_[inner[1:], y]
                size_ = outer - inner
                fits = (size_ > REGION // 2) & (size_ <= REGION)  # smaller ones stand within a block
                part(inner[fits], outer[fits], depth)
                deeper += [(p, q) for p, q in zip(inner[size_ > REGION].tolist(), outer[size_ > REGION].tolist())]
            todo = deeper
    return found, crowds


def _regions(nodes: DataFrame) -> DataFrame:
    """(group, node, crowd): the groups of candidates of all orders, and, where crowd is true, the members of crowds."""
    out = pa.schema([("group", pa.int64()), ("node", pa.int64()), ("crowd", pa.bool_())])
    trees = nodes.select("node", F.concat("sig", "sig").alias("sig"), F.explode(F.sequence(F.lit(0), F.lit(TREES - 1))).alias("tree"))
    rows = trees.select("tree", F.substring("sig", F.col("tree") * 2 * DEPTH + 1, F.lit(2 * ORDER)).alias("order"), "node")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        open_left = True

        def stretch(last: bool):
            nonlocal held, open_left
            t = pa.Table.from_batches(held).combine_chunks()
            tree, node = t.column(0).to_numpy(), t.column(2).to_numpy()
            order = np.frombuffer(texts_as_bytes(t.column(1))[0].tobytes(), ">u2").reshape(-1, ORDER)
            n = cut = len(node)
            if not last:  # up to the last place where no region goes on
                apart = np.flatnonzero((order[1:, :SHALLOW] != order[:-1, :SHALLOW]).any(1) | (tree[1:] != tree[:-1])) + 1
                cut = int(apart[-1]) if len(apart) else n
            found, crowds = regions(tree[:cut], order[:cut], node[:cut], open_left, last or cut == n)
            open_left = cut == n
            held = t.slice(cut).to_batches() if cut < n else []
            for rows, crowd in ((found, False), (crowds, True)):
                for i in range(0, len(rows), 4096):
                    number, a, b = (np.array(x, np.int64) for x in zip(*rows[i : i + 4096]))
                    size = b - a
                    at = np.repeat(a - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
                    for j in range(0, len(at), 1 << 16):
                        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(number, size)[j : j + (1 << 16)]), pa.array(node[at[j : j + (1 << 16)]]), pa.array(np.full(len(at[j : j + (1 << 16)]), crowd))], schema=out)

        for batch in batches:
            if batch.num_rows:
                held.append(batch)
            if sum(b.num_rows for b in held) >= CHUNK:
                yield from stretch(False)
        if held:
            yield from stretch(True)

    ordered = rows.repartitionByRange("tree", "order", "node").sortWithinPartitions("tree", "order", "node")
    return written(ordered.mapInArrow(run, "group long, node long, crowd boolean"), "regions")


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b, ...) whose sets meet 100 * intersection >= percent * union. sets: node, items (sorted uint64)."""
    rest = [c for c in pairs.columns if c not in ("a", "b")]
    both = pairs.join(sets.select(F.col("node").alias("a"), F.col("items").alias("x")).hint("shuffle_merge"), "a").join(sets.select(F.col("node").alias("b"), F.col("items").alias("y")).hint("shuffle_merge"), "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("x"), batch.column("y")):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                x, y = (x, y) if len(x) <= len(y) else (y, x)
                at = np.searchsorted(y, x)
                shared = int((y[np.minimum(at, len(y) - 1)] == x).sum())
                keep.append(100 * shared >= percent * (len(x) + len(y) - shared))
            yield batch.select(["a", "b", *rest]).filter(pa.array(keep, pa.bool_()))

    shape = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in pairs.select("a", "b", *rest).schema)
    return both.select("a", "b", *rest, "x", "y").mapInArrow(run, shape)


def _sets(docs: DataFrame, nodes: DataFrame, k: int) -> DataFrame:
    """(node, items): the full sets of nodes (node, key, rep, ...), from the texts of their first documents."""
    out = pa.schema([("key", pa.binary()), ("items", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 1 << 20):
                data, ends = texts_as_bytes(part.column(0))
                yield pa.RecordBatch.from_arrays([pa.array(_names(data, ends), pa.binary()), pa.array([s.tobytes() for s in shingle_sets(data, ends, k)], pa.binary())], schema=out)

    texts = docs.join(nodes.select(F.col("rep").alias("doc_id")).distinct().hint("shuffle_merge"), "doc_id", "left_semi").select("text")
    sets = texts.mapInArrow(run, "key binary, items binary").join(nodes.select("key", "node").hint("shuffle_merge"), "key")
    return written(sets.groupBy("node").agg(F.first("items").alias("items")), "sets")


def _across(pairs: DataFrame, part: DataFrame) -> DataFrame:
    """The pairs whose two sides are in different components so far."""
    one, two = part.select(F.col("node").alias("a"), F.col("component").alias("ca")), part.select(F.col("node").alias("b"), F.col("component").alias("cb"))
    both = pairs.join(one.hint("shuffle_merge"), "a", "left").join(two.hint("shuffle_merge"), "b", "left")
    return both.where("coalesce(ca, a) <> coalesce(cb, b)").select("a", "b", "near")


def _crowded(crowds: DataFrame, part: DataFrame, held: Held) -> DataFrame:
    """(node, component) of the members of crowds (group, node) that are still in several components."""
    own = crowds.join(part.hint("shuffle_merge"), "node", "left").withColumn("component", F.coalesce("component", "node"))
    own = held(own)
    several = own.groupBy("group").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo <> hi")
    several = written(several.select("group"), "several")  # so that the join stands alone and a large crowd can be split
    return own.join(several.hint("shuffle_merge"), "group", "left_semi").select("node", "component").distinct()


def _prefix_pairs(sets: DataFrame, percent: int, held: Held) -> DataFrame:
    """All pairs (a > b) of nodes in different components that can be alike. sets: node, component, items (sorted uint64).

    Items are ordered by the number of sets that hold them, those of one component only first. Two alike sets share an item of
    both prefixes: the larger set's leaves out what it must share, percent of it, and the smaller one's 2 * percent / (100 + percent)
    of it. So members of a family that is less alike than percent do not meet by what the whole family shares. Where two meet, they share at
    most what lies before the item in either and what lies behind it in either, of the items that other components hold too;
    and bitmaps of sets, a bit for each item, differ in at most as many bits as the sets differ in items. No alike pair fails either bound."""
    out = pa.schema([("node", pa.int64()), ("component", pa.int64()), ("n", pa.int64()), ("bits", pa.list_(pa.int64())), ("items", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            items = [np.frombuffer(x.as_buffer(), np.uint64) for x in batch.column(2)]
            bits = np.zeros((len(items), 64 * MARKS), bool)
            for row, x in zip(bits, items):
                row[(x % np.uint64(64 * MARKS)).astype(np.int64)] = True
            marks = np.packbits(bits, axis=1).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([len(x) for x in items], pa.int64()), pa.array(list(marks), pa.list_(pa.int64())), pa.array([x.view(np.int64) for x in items], pa.list_(pa.int64()))], schema=out)

    whole = held(sets.select("node", "component", "items").mapInArrow(run, "node long, component long, n long, bits array<long>, items array<long>"))
    items = whole.select("node", "component", F.explode("items").alias("item"))
    shared = items.groupBy("item").agg(F.count("*").alias("f"), F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo <> hi").select("item", "f")
    both = items.join(shared.hint("shuffle_merge"), "item").groupBy("node").agg(F.sort_array(F.collect_list(F.struct("f", "item"))).alias("s"))
    both = both.join(whole.select("node", "component", "n", "bits").hint("shuffle_merge"), "node")
    alone = F.col("n") - F.size("s")
    long, short = F.expr(f"n - ({percent} * n + 99) div 100 + 1"), F.expr(f"n - (2 * {percent} * n + {99 + percent}) div {100 + percent} + 1")
    both = both.select("node", "component", "n", "bits", F.size("s").alias("size"), F.slice("s", F.lit(1), F.greatest(F.lit(0), long - alone).cast("int")).alias("s"), (short - alone).alias("short"))
    posts = held(both.select("node", "component", "n", "bits", "size", "short", F.posexplode("s").alias("at", "x")).select("node", "component", "n", *[F.col("bits")[k].alias(f"b{k}") for k in range(MARKS)], "size", "at", "x.item", (F.col("at") < F.col("short")).alias("short")))
    one = posts.where("short").select("item", F.col("node").alias("k"), F.col("component").alias("c"), F.col("n").alias("m"), F.col("size").alias("z"), F.col("at").alias("p"), *[F.col(f"b{k}").alias(f"c{k}") for k in range(MARKS)])
    most, least = "least(at, p) + least(size - at, z - p)", f"({percent} * (n + m) + {99 + percent}) div {100 + percent}"
    apart = " + ".join(f"bit_count(b{k} ^ c{k})" for k in range(MARKS))
    met = posts.join(one.hint("shuffle_merge"), "item").where(f"component <> c and m <= n and 100 * m >= {percent} * n and {most} >= {least} and {apart} <= n + m - 2 * ({least})")
    return met.select(F.greatest("node", "k").alias("a"), F.least("node", "k").alias("b")).distinct()


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for (doc_id, text); one row per row of docs."""
    held = Held()
    signed = written(_signed(docs, words), "signed")
    full = signed.where("n_shingles > 0")
    heads = full.groupBy("key").agg(F.min("doc_id").alias("rep"), *[F.first(c).alias(c) for c in ("n_shingles", "sig", "sketch")])  # a key has one set
    heads = written(heads.withColumn("node", F.monotonically_increasing_id()), "heads")
    regions_ = _regions(heads)
    found = regions_.where("not crowd").select("group", "node")
    compared = _neighbours(found.join(heads.select("node", "n_shingles", "sketch").hint("shuffle_merge"), "node"), percent)
    pairs = written(compared.groupBy("a", "b").agg(F.max("near").alias("near")), "pairs")
    paired = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    sets = _sets(docs, heads.select("node", "key", "rep").join(paired.hint("shuffle_merge"), "node", "left_semi"), words)
    either = pairs.unionAll(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"), "near"))
    best = either.groupBy("a").agg(F.max_by(F.struct("b", "near"), F.struct("near", "b")).alias("b"))
    tried = written(best.select(F.greatest("a", "b.b").alias("a"), F.least("a", "b.b").alias("b"), F.col("b.near").alias("near")).distinct(), "tried")
    first = held(_confirmed(tried, sets, percent))
    links = first.select("a", "b")
    # rows of one id are one document, whatever their texts
    same = full.groupBy("doc_id").agg(F.min("key").alias("lo"), F.max("key").alias("hi")).where("lo <> hi")
    same = held(full.select("doc_id", "key").join(same.select("doc_id", "lo").hint("shuffle_merge"), "doc_id").select("key", "lo").distinct())
    if not same.isEmpty():
        one, two = heads.select("key", F.col("node").alias("a")), heads.select(F.col("key").alias("lo"), F.col("node").alias("b"))
        links = links.unionAll(same.join(one.hint("shuffle_merge"), "key").join(two.hint("shuffle_merge"), "lo").select("a", "b"))
    part = components(links)
    # then the pairs that would still join two components
    rest = written(_across(pairs.join(tried.select("a", "b").hint("shuffle_merge"), ["a", "b"], "left_anti"), part), "rest")
    second = held(_confirmed(rest, sets, percent))
    links = links.unionAll(second.select("a", "b"))
    part = components(links)
    crowds = regions_.where("crowd").select("group", "node")
    # a link of which a sketch was sure stood for others of its group: if the sets refute it, the group is searched exactly
    sure = lambda rows: rows.where("near >= 2").select("a", "b")
    refuted = sure(tried).unionAll(sure(rest)).exceptAll(sure(first).unionAll(sure(second)))
    refuted = held(refuted.select(F.explode(F.array("a", "b")).alias("node")).distinct())
    if not refuted.isEmpty():
        of = found.join(refuted.hint("shuffle_merge"), "node", "left_semi").select("group").distinct()
        crowds = crowds.unionAll(found.join(of.hint("shuffle_merge"), "group", "left_semi"))
    crowded = held(_crowded(crowds, part, held))
    if not crowded.isEmpty():
        sets = _sets(docs, heads.select("node", "key", "rep").join(crowded.select("node").hint("shuffle_merge"), "node", "left_semi"), words)
        links = links.unionAll(_confirmed(_prefix_pairs(sets.join(crowded.hint("shuffle_merge"), "node"), percent, held), sets, percent))
        part = components(links)
    whole = heads.select("node", "key", "rep").join(part.hint("shuffle_merge"), "node", "left").withColumn("component", F.coalesce("component", "node"))
    smallest = written(whole.groupBy("component").agg(F.min("rep").alias("component_id")), "smallest")  # apart from the join, which a large component skews
    classes = whole.select("key", "component").join(smallest.hint("shuffle_merge"), "component").select("key", "component_id")
    held.release()
    done = full.select("doc_id", "n_shingles", "key").join(classes.hint("shuffle_merge"), "key").select("doc_id", "n_shingles", "component_id")
    done = done.unionAll(signed.where("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id")))
    return done.withColumn("kept", F.col("doc_id") == F.col("component_id"))


def op1_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = near_duplicates(documents(table(spark, sf_dir, "documents")), words=3, percent=85)
    return rows.select(null_id(), "n_shingles", null_id("component_id"), "kept")
