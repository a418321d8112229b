"""SimHash fingerprints and exact near pairs through vantage-point trees.

Two fingerprints within ``radius`` bits agree to within ``radius // 4`` bits in at least one of their four 16-bit
quarters (pigeonhole). A vantage-point tree per quarter splits the fingerprints by Hamming distance to a vantage
value at the median; a query goes down every branch that the triangle bound leaves open, so it reaches each shard
whose region its ball overlaps (of two shards that a pair lies in, the later one). Inside a shard the same splitting goes
on; where the quarter's values tell no more apart, one of the other three quarters agrees to within ``radius // 3``
bits, so a tree of each of them splits further. Small blocks are compared whole on all 64 bits. Every pair is found;
only links that join two classes leave a shard.

A ball of one bit holds 17 of a quarter's 65,536 values: a fingerprint is dealt at most 4 x 9 times, whatever the table's
size, and two quarters together keep 17 x 17 x 12 in 2^32 of all pairs for comparison.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from traitloom.llm.common import bounded_batches, materialise, merge_labels
from traitloom.llm.graph import components
from traitloom.llm.mphf import mix
from traitloom.llm.shingles import shingle_hashes

BITS = 64
#: Fingerprints that the top of a tree is fitted on (about this many, picked by hash); every row is indexed.
TREE_SAMPLE = 65_536
#: Members that a shard should hold. A tree is no deeper than a quarter has bits: then a shard is a value.
SHARD_MEMBERS, MAX_DEPTH = 65_536, 16
#: Queries of one task; a shard with more is dealt to several tasks that each hold its members.
TASK_QUERIES = 262_144
#: Cells of a block that is compared whole.
BLOCK = 1 << 17
#: Bits in which the leading fingerprint of a candidate for the shingle comparison may differ (10 on average at 0.8).
REACH = 22
#: Bits of the table that tells the documents to compare from most others (8 MB).
FILTER_BITS = 1 << 26
#: Rows of a block that is compared on shingle sets, and rows of a larger class that its others meet first, about.
MEMBERS, HUBS = 512, 8


def fingerprint(text: str | None, width: int = 4, variants: int = 1) -> list[int]:
    """64-bit SimHash: a bit is 1 if set in over half the shingle hashes; 0 for a text without words.

    Further ``variants`` are made from the same hashes mixed anew, so that a pair which misses in one may meet in another.
    """
    return fingerprint_of(shingle_hashes(text, width), variants)


def fingerprint_of(hashes: np.ndarray, variants: int = 1) -> list[int]:
    count = np.zeros((variants, BITS), np.int64)
    for at in range(0, len(hashes), 1 << 16):
        block = hashes[at : at + (1 << 16)]
        for v in range(variants):
            bits = mix(block, v) if v else block
            count[v] += np.unpackbits(bits.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return np.packbits(count * 2 > len(hashes), axis=1, bitorder="little").view(np.uint64).ravel().tolist()


def fingerprints(docs: DataFrame, width: int = 4, text: str = "text", variants: int = 1) -> DataFrame:
    """doc_id and the fingerprint ``fp`` (signed long) of every row, and ``fp1`` and so on for further variants. Null and
    blank texts: 0."""
    names = ["fp", *(f"fp{v}" for v in range(1, variants))]

    @F.pandas_udf(", ".join(f"{n} long" for n in names))
    def simhash(texts: pd.Series) -> pd.DataFrame:
        out = np.array([fingerprint(t, width, variants) for t in texts], np.uint64).reshape(len(texts), variants)
        return pd.DataFrame(out.view(np.int64), columns=names)

    return bounded_batches(docs).select("doc_id", simhash(F.col(text)).alias("_s")).select("doc_id", "_s.*")


# ---------------------------------------------------------------- trees


def quarters(fps: np.ndarray) -> list[np.ndarray]:
    return [(fps >> np.uint64(16 * q)).astype(np.uint16) for q in range(4)]


def fit_tree(values: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Vantage values and radii of a complete tree in heap order, each radius the median of the sample there."""
    vantage, radius = np.zeros(2**depth, np.uint16), np.zeros(2**depth, np.int16)
    held = {1: values}
    for node in range(1, 2**depth):
        here = held.pop(node)
        if len(here) == 0:
            here = values
        # of a few candidates, the vantage whose distances spread most
        picks = here[np.linspace(0, len(here) - 1, 5).astype(int)]
        best = max(picks, key=lambda p: np.var(np.bitwise_count(here[:2048] ^ p)))
        far = np.bitwise_count(here ^ best).astype(np.int16)
        vantage[node], radius[node] = best, int(np.median(far))
        held[2 * node], held[2 * node + 1] = here[far <= radius[node]], here[far > radius[node]]
    return vantage, radius


def descend(values: np.ndarray, tree: tuple[np.ndarray, np.ndarray], depth: int, reach: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, leaf) for every leaf that the ball of ``reach`` bits around a row's value overlaps."""
    vantage, radius = tree
    row, node = np.arange(len(values)), np.ones(len(values), np.int64)
    for _ in range(depth):
        far = np.bitwise_count(values[row] ^ vantage[node]).astype(np.int16)
        left, right = far - reach <= radius[node], far + reach > radius[node]
        row = np.concatenate([row[left], row[right]])
        node = np.concatenate([2 * node[left], 2 * node[right] + 1])
    return row, node - 2**depth


def near_pairs(queries: np.ndarray, members: np.ndarray, quarter: int, radius: int, ball: int):
    """Yield (query index, member index) arrays of all pairs within ``radius`` bits that differ in ``ball`` bits at most
    in the quarter.

    Splits on the quarter's distance. A large block that this makes no smaller is split on each of the other quarters, if
    the ball is a quarter of the radius; else, and at the end, it is compared in slices of bounded size.
    """
    asks, holds = quarters(queries), quarters(members)
    stack = [(np.arange(len(queries)), np.arange(len(members)), quarter, 0)]
    while stack:
        q, m, by, tries = stack.pop()
        if not len(q) or not len(m):
            continue
        if len(q) * len(m) > BLOCK and tries < 4:
            x, y, reach = asks[by][q], holds[by][m], ball if by == quarter else radius // 3
            spot = y[tries * (len(y) - 1) // 3]
            dm, dq = np.bitwise_count(y ^ spot).astype(np.int16), np.bitwise_count(x ^ spot).astype(np.int16)
            mid = int(np.median(dm))
            if mid == dm.max():
                mid -= 1
            left, to_left, to_right = dm <= mid, dq - reach <= mid, dq + reach > mid
            parts = [(q[to_left], m[left]), (q[to_right], m[~left])]
            if sum(len(a) * len(b) for a, b in parts) < 0.9 * len(q) * len(m):
                stack += [(a, b, by, 0) for a, b in parts]
            else:
                stack.append((q, m, by, tries + 1))
            continue
        if by == quarter and ball >= radius // 4 and len(q) * len(m) > 16 * BLOCK:
            stack += [(q, m, other, 0) for other in range(4) if other != quarter]
            continue
        step = max(1, (BLOCK * 4) // len(m))
        for at in range(0, len(q), step):
            some = q[at : at + step]
            i, j = np.nonzero(np.bitwise_count(queries[some][:, None] ^ members[m][None, :]) <= radius)
            if len(i):
                yield some[i], m[j]


ASKS, MEMBER = 1, 2


def links(fps: DataFrame, radius: int = 4, more: tuple[str, ...] = (), most: int = 0, ball: int | None = None) -> DataFrame:
    """Links (a, b) between node ids that join all pairs within ``radius`` bits into their classes.

    A smaller ``ball`` than a quarter of the radius finds those pairs that differ in so many bits at most in one quarter.

    ``fps``: fingerprints ``fp`` with a node id ``node`` each, neither null; repeated rows are harmless, other columns are
    ignored, an empty table gives no links. With ``more`` (columns of further fingerprints) a pair must also differ in
    ``most`` bits at most over all of them and ``fp`` together. Each shard gives at most one link a row.
    """
    ball = radius // 4 if ball is None else ball
    total = fps.count()
    depth = int(np.clip(np.ceil(np.log2(max(total, 1) / SHARD_MEMBERS)), 0, MAX_DEPTH))
    every = max(1, total // TREE_SAMPLE)
    sample = np.array([r[0] for r in fps.where(F.pmod(F.xxhash64("fp"), F.lit(every)) == 0).select("fp").collect()], np.int64).view(np.uint64)
    sample = sample if len(sample) else np.zeros(1, np.uint64)
    trees, salts = [], []
    for values in quarters(sample):
        trees.append(fit_tree(values, depth))
        _, leaf = descend(values, trees[-1], depth, ball)
        salts.append(1 + np.bincount(leaf, minlength=2**depth) * every // TASK_QUERIES)

    def deal(batches):
        for pdf in batches:
            fp, node = pdf["fp"].to_numpy().view(np.uint64), pdf["node"].to_numpy()
            for q, values in enumerate(quarters(fp)):
                home = np.empty(len(values), np.int64)
                at, leaf = descend(values, trees[q], depth, 0)
                home[at] = leaf
                row, leaf = descend(values, trees[q], depth, ball)
                row, leaf = row[leaf >= home[row]], leaf[leaf >= home[row]]
                member = leaf == home[row]
                turns = salts[q][leaf]
                own = (fp[row] % turns.astype(np.uint64)).astype(np.int64)
                times = np.where(member, turns, 1)  # a member is in every task of its shard, and asks in one
                back = np.repeat(np.arange(len(row)), times)
                turn = np.where(member[back], np.arange(len(back)) - np.repeat(np.cumsum(times) - times, times), own[back])
                rows = row[back]
                yield pd.DataFrame(
                    {
                        "shard": (leaf[back] * 4 + q).astype(np.int32),
                        "salt": turn.astype(np.int32),
                        "role": (ASKS * (turn == own[back]) + MEMBER * member[back]).astype(np.int8),
                        "fp": fp[rows].view(np.int64),
                        "node": node[rows],
                        **{c: pdf[c].to_numpy()[rows] for c in more},
                    }
                )

    def search(key, pdf):
        fp, node, role = pdf["fp"].to_numpy().view(np.uint64), pdf["node"].to_numpy(), pdf["role"].to_numpy()
        others = [pdf[c].to_numpy().view(np.uint64) for c in more]
        nodes, place = np.unique(node, return_inverse=True)
        q, m = np.flatnonzero(role & ASKS), np.flatnonzero(role & MEMBER)
        labels, held, size = np.arange(len(nodes)), [], 0
        for i, j in near_pairs(fp[q], fp[m], int(key[0]) % 4, radius, ball):
            if more:
                near = sum(np.bitwise_count(w[q[i]] ^ w[m[j]]).astype(np.int16) for w in (fp, *others)) <= most
                i, j = i[near], j[near]
            u, v = place[q[i]], place[m[j]]
            apart = labels[u] != labels[v]
            held.append((u[apart], v[apart]))
            size += int(apart.sum())
            if size > 1 << 20:
                labels, held, size = merge_labels(labels, *map(np.concatenate, zip(*held))), [], 0
        if held:
            labels = merge_labels(labels, *map(np.concatenate, zip(*held)))
        moved = np.flatnonzero(labels != np.arange(len(labels)))
        return pd.DataFrame({"a": nodes[moved], "b": nodes[labels[moved]]})

    schema = "shard int, salt int, role byte, fp long, node long" + "".join(f", {c} long" for c in more)
    dealt = fps.select("fp", "node", *more).mapInPandas(deal, schema)
    return dealt.groupBy("shard", "salt").applyInPandas(search, "a long, b long")


def near_classes(docs: DataFrame, width: int = 4, radius: int = 4) -> DataFrame:
    """Fingerprint and class of every document.

    Returns doc_id, fp (signed long), component_id: the smallest doc_id that can be reached over links of ``radius``
    bits or fewer, the document's own included. Null and blank texts have fingerprint 0 and link like any other.
    Repeated rows keep one output row each; rows that share a doc_id share a node where it is the smallest of its
    fingerprint. A null doc_id gets its fingerprint's class, or null if no document with that fingerprint has an id.
    Other columns are ignored; an empty table gives no rows.
    """
    fps = materialise(fingerprints(docs, width), "simhash")
    nodes = materialise(fps.groupBy("fp").agg(F.min("doc_id").alias("node")), "simhash-nodes")
    roots = components(links(nodes.where("node IS NOT NULL"), radius))
    classes = nodes.join(roots, "node", "left").select("fp", F.coalesce("root", "node").alias("component_id"))
    return fps.join(classes, "fp", "left").select("doc_id", "fp", "component_id")


# ---------------------------------------------------------------- near copies by their shingles


def shingle_sets(docs: DataFrame, width: int, variants: int) -> DataFrame:
    """doc_id, ``key`` (a digest of the set of word shingles) and the set's fingerprints ``fp``, ``fp1`` and so on."""
    names = ["fp", *(f"fp{v}" for v in range(1, variants))]

    @F.pandas_udf("key binary, " + ", ".join(f"{n} long" for n in names))
    def prints(texts: pd.Series) -> pd.DataFrame:
        keys, fps = [], np.zeros((len(texts), variants), np.uint64)
        for at, text in enumerate(texts):
            found = np.unique(shingle_hashes(text, width))
            keys.append(xxhash.xxh3_128_digest(found.tobytes()))
            fps[at] = fingerprint_of(found, variants)
        return pd.DataFrame({"key": keys, **{n: fps[:, v].view(np.int64) for v, n in enumerate(names)}})

    return bounded_batches(docs).select("doc_id", prints("text").alias("_s")).select("doc_id", "_s.*")


def _marked(nodes: DataFrame) -> np.ndarray:
    """A table of ``FILTER_BITS`` bits in which those of the nodes' hashes are set, put together from a few slices."""
    slices = 64
    bits = nodes.select(F.pmod(F.xxhash64("node"), F.lit(FILTER_BITS)).alias("bit"))
    width = FILTER_BITS // slices

    def pack(key, pdf):
        held = np.zeros(width, np.uint8)
        held[pdf["bit"].to_numpy() - key[0] * width] = 1
        return pd.DataFrame({"part": [key[0]], "bits": [np.packbits(held, bitorder="little").tobytes()]})

    out = np.zeros(FILTER_BITS // 8, np.uint8)
    part = F.floor(F.col("bit") / width).cast("long")
    for r in bits.distinct().groupBy(part.alias("part")).applyInPandas(pack, "part long, bits binary").collect():
        out[r.part * width // 8 : (r.part + 1) * width // 8] = np.frombuffer(r.bits, np.uint8)
    return out


def with_shingles(docs: DataFrame, nodes: DataFrame, width: int) -> DataFrame:
    """``nodes`` (node, key and other columns) with the shingles ``s`` of the document that has this id and key.

    A table of bits of fixed size, broadcast, tells most other documents before anything is shuffled, so texts stay where
    they are and only sets travel.
    """
    held = docs.sparkSession.sparkContext.broadcast(_marked(nodes))

    def shingles(batches):
        for pdf in batches:
            bit = pdf["bit"].to_numpy()
            pdf = pdf[(held.value[bit >> 3] >> (bit & 7) & 1).astype(bool)]
            sets = [np.unique(shingle_hashes(t, width)) for t in pdf["text"]]
            keys = [xxhash.xxh3_128_digest(x.tobytes()) for x in sets]
            yield pd.DataFrame({"node": pdf["node"].to_numpy(), "key": keys, "s": [x.view(np.int64) for x in sets]})

    asked = bounded_batches(docs).where("doc_id IS NOT NULL").select(F.col("doc_id").alias("node"), F.pmod(F.xxhash64("doc_id"), F.lit(FILTER_BITS)).alias("bit"), "text")
    found = asked.mapInPandas(shingles, "node long, key binary, s array<long>")
    return materialise(found.join(nodes, ["node", "key"]).select(*nodes.columns, "s"), "simhash-sets")


def confirmed(sets: DataFrame, least: float) -> DataFrame:
    """Links (a, b) that join all pairs of Jaccard similarity ``least`` or more of an asked row and a row of its class.

    ``sets``: node, class, shingles ``s``, ``asked``, and the class's rows ``n`` and asked rows ``n_asked``. A class is cut
    into blocks of about ``MEMBERS`` rows; each block of asked rows meets each block of rows in one group, which gives at
    most one link a row.
    """
    whole = lambda n: F.greatest(F.lit(1), F.ceil(F.col(n) / MEMBERS)).cast("int")
    at = lambda n: F.pmod(F.xxhash64("node", "class"), F.col(n)).cast("int")
    cut = sets.withColumn("_r", whole("n_asked")).withColumn("_c", whole("n")).withColumn("row", at("_r")).withColumn("col", at("_c"))
    cell = lambda r, c: F.struct(r.alias("r"), c.alias("c"))
    met = F.transform(F.sequence(F.lit(0), F.col("_r") - 1), lambda r: cell(r, F.col("col")))
    asks = F.transform(F.sequence(F.lit(0), F.col("_c") - 1), lambda c: cell(F.col("row"), c))
    cells = F.array_distinct(F.when(F.col("asked"), F.concat(met, asks)).otherwise(met))
    dealt = cut.where("n_asked > 0").select("node", "class", "s", "asked", "row", "col", F.explode(cells).alias("_at")).select("*", "_at.r", "_at.c")

    def compare(key, pdf):
        nodes, place = np.unique(pdf["node"].to_numpy(), return_inverse=True)
        size = pdf["s"].map(len).to_numpy()
        _, word = np.unique(np.concatenate(pdf["s"].to_list()), return_inverse=True)
        start = np.concatenate([[0], np.cumsum(size)])
        row = np.repeat(np.arange(len(size)), size)
        in_right = (pdf["col"] == key[2]).to_numpy()[row]
        right, of = word[in_right], row[in_right]
        held = np.zeros(len(word), bool)
        labels = np.arange(len(nodes))
        for i in np.flatnonzero(pdf["asked"].to_numpy(bool) & (pdf["row"] == key[1]).to_numpy()):
            own = word[start[i] : start[i + 1]]
            held[own] = True
            common = np.bincount(of[held[right]], minlength=len(size))
            held[own] = False
            near = np.flatnonzero(common / np.maximum(size[i] + size - common, 1) >= least)
            labels = merge_labels(labels, np.full(len(near), place[i]), place[near])
        moved = np.flatnonzero(labels != np.arange(len(labels)))
        return pd.DataFrame({"a": nodes[moved], "b": nodes[labels[moved]]})

    return dealt.drop("_at").groupBy("class", "r", "c").applyInPandas(compare, "a long, b long")


def confirmed_links(sets: DataFrame, least: float) -> DataFrame:
    """Links (a, b) that join all pairs of similarity ``least`` or more inside a class of ``sets`` (node, class, n, s).

    A small class is compared whole. In a large one all rows first meet a few of its rows; what these hold together need
    not be compared again, so only the other rows are compared with the whole class.
    """
    small = sets.where(F.col("n") <= MEMBERS).withColumns({"asked": F.lit(True), "n_asked": F.col("n")})
    large = sets.where(F.col("n") > MEMBERS)
    if large.isEmpty():
        return confirmed(small, least)
    hub = F.pmod(F.xxhash64("class", "node"), F.ceil(F.col("n") / HUBS)) == 0
    first = materialise(confirmed(large.withColumns({"asked": hub, "n_asked": F.lit(1)}), least), "simhash-first")
    told = large.select("node", "class").distinct().join(components(first), "node", "left").select("node", "class", F.coalesce("root", "node").alias("root"))
    told = materialise(told, "simhash-told")
    core = told.groupBy("class", "root").count().groupBy("class").agg(F.max_by("root", F.struct("count", "root")).alias("core"))
    rest = told.join(core, "class").select("node", "class", (F.col("root") != F.col("core")).alias("asked"))
    rest = materialise(rest, "simhash-rest")
    many = rest.groupBy("class").agg(F.count_if("asked").alias("n_asked"))
    return first.unionAll(confirmed(small, least)).unionAll(confirmed(large.join(rest, ["node", "class"]).join(many, "class"), least))


def near_copies(docs: DataFrame, width: int = 5, variants: int = 4, least: float = 0.8, most: int = 54) -> DataFrame:
    """(node, root) of the documents that are near copies of one with a smaller doc_id.

    Near copies have sets of word shingles with a Jaccard similarity of ``least`` or more, or are joined by such pairs.
    Candidates come from ``variants`` fingerprints of the sets: a pair that differs in one bit at most in any 16-bit
    quarter of these and in ``most`` bits at most over all. Sets of one size and similarity 0.8 differ in acos(8 / 9) / pi of
    the bits, 39 of 256 on average with a deviation of 6, and a quarter shows 28 % of them, so sixteen show 99 %. The
    candidates' classes are then compared on the sets themselves.
    """
    more = tuple(f"fp{v}" for v in range(1, variants))
    fps = materialise(shingle_sets(docs, width, variants), "simhash")
    nodes = materialise(fps.groupBy("key", "fp", *more).agg(F.min("doc_id").alias("node")).where("node IS NOT NULL"), "simhash-nodes")
    turns = [("fp", *more)[v:] + ("fp", *more)[:v] for v in range(variants)]  # each fingerprint leads once
    found = [links(nodes.select("node", *(F.col(c).alias(n) for c, n in zip(turn, ("fp", *more)))), REACH, more, most, ball=1) for turn in turns]
    ends = components(reduce(DataFrame.unionAll, found))
    classes = materialise(ends.unionByName(ends.select(F.col("root").alias("node"), "root").distinct()).withColumnRenamed("root", "class"), "simhash-classes")
    held = materialise(nodes.select("node", "key").join(classes, "node"), "simhash-held")
    sizes = held.groupBy("class").agg(F.count("*").alias("n"))
    asked = materialise(held.join(sizes, "class").select("node", "key", "class", "n"), "simhash-asked")  # so that its size is known to the join
    sets = with_shingles(docs, asked, width)
    roots = components(confirmed_links(sets, least))
    told = nodes.join(roots, "node", "left").select("key", F.coalesce("root", "node").alias("root"))
    return fps.join(told, "key").where("doc_id <> root").select(F.col("doc_id").alias("node"), "root")


def keep_one(docs: DataFrame, width: int = 5, variants: int = 4, least: float = 0.8, most: int = 54) -> DataFrame:
    """Documents that are the smallest doc_id of their class of ``near_copies``, with all their columns.

    Rows with a null doc_id are kept: nothing orders them among a class. Rows without words are one class. Repeated rows
    stay or go together. The ids that go are written first, so that Spark broadcasts them only if they are few.
    """
    gone = materialise(near_copies(docs, width, variants, least, most).select(F.col("node").alias("doc_id")).distinct(), "simhash-gone")
    return docs.join(gone, "doc_id", "left_anti")
