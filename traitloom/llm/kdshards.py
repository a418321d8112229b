"""Shards of near-equal bytes from a k-d tree over document metadata.

Equal texts are one point of the tree, with the metadata of the least of them (source, language) and of their text
(characters, bytes a character), and weigh what they hold in bytes. A node that has to fill several shards is split along
its widest dimension (the weighted deviation there against that of all documents), at the weighted quantile that gives
each side the bytes of its shards. Quantiles are found from histograms that Spark sums over all points, two jobs a
level; a hash of the text only breaks ties inside one value of a dimension. Only histograms reach the driver.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from traitloom.llm.common import forget, materialise

SHARDS = 24
#: Metadata columns that are dimensions, where a table has them.
LABELS = ("source", "lang")
#: A group of equal texts, from three rows on, is cut (by a hash of the id) only if it is heavier than this share of a shard.
GROUP_SHARE = 0.05
#: Rows of a bucket in which slots are counted, on average.
SLOT_ROWS = 50_000
#: A point's place along a dimension: its value there, and below that the hash that breaks ties.
VALUE_BITS, TIE_BITS = 12, 14


def measures(docs: DataFrame) -> DataFrame:
    """doc_id, size, text_crc32 and what points are made of, for every row. Null texts count as empty, null labels as "";
    a table without a label column has one value there."""
    text = F.coalesce(F.col("text"), F.lit(""))
    label = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")) if c in docs.columns else F.lit("")
    return docs.select(
        "doc_id",
        (F.octet_length(text) + 8).cast("long").alias("size"),
        F.length(text).cast("long").alias("chars"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.xxhash64(text).alias("text_hash"),
        F.xxhash64("doc_id").alias("row_hash"),
        *(label(c).alias(f"label{n}") for n, c in enumerate(LABELS)),
    )


DIMENSIONS = [f"d{n}" for n in range(2 + len(LABELS))]


def groups_of(rows: DataFrame, shards: int) -> DataFrame:
    """One row for each text: text_hash, rows, weight (bytes), cut (whether it is too heavy for one shard), hot (whether
    many rows meet on it) and its value along each dimension."""
    found = rows.groupBy("text_hash").agg(
        F.count("*").alias("rows"), F.sum("size").alias("weight"), F.min("size").alias("size"), F.min("chars").alias("chars"), *(F.min(f"label{n}").alias(f"label{n}") for n in range(len(LABELS)))
    )
    total = found.agg(F.sum("weight"), F.sum("rows")).first()
    heavy, many = (GROUP_SHARE * (x or 0) / shards for x in total)
    most = 2**VALUE_BITS - 1
    value = lambda c: (F.least(F.lit(1.0), c) * most).cast("int")
    values = [
        value(F.log2(F.col("size")) / 32),
        value((F.col("size") - 8 - F.col("chars")) / F.greatest(F.col("chars"), F.lit(1)) / 3),
        *(F.shiftrightunsigned(F.xxhash64(f"label{n}"), 64 - VALUE_BITS).cast("int") for n in range(len(LABELS))),
    ]
    cut = (F.col("weight") > heavy) & (F.col("rows") > 2)
    return found.select("text_hash", "rows", "weight", cut.alias("cut"), (cut | (F.col("rows") > many)).alias("hot"), *(v.alias(d) for v, d in zip(values, DIMENSIONS)))


def _tie(hash_: Column) -> Column:
    return F.shiftrightunsigned(hash_, 64 - TIE_BITS).cast("int")


def _with_groups(rows: DataFrame, groups: DataFrame) -> DataFrame:
    """``rows`` with their group's values and their tie. The few hot groups are broadcast: many rows share their hash."""
    known = groups.select("text_hash", "cut", "hot", *DIMENSIONS)
    hot = F.broadcast(known.where("hot"))  # at most 2 * shards / GROUP_SHARE groups
    joined = rows.join(hot, "text_hash").unionByName(rows.join(hot.select("text_hash"), "text_hash", "left_anti").join(known.where("NOT hot"), "text_hash"))
    return joined.withColumn("tie", F.when(F.col("cut"), _tie(F.xxhash64("text_hash", "row_hash"))).otherwise(_tie(F.col("text_hash")))).drop("cut", "hot")


def places() -> list[Column]:
    """A point's place along each dimension."""
    return [F.shiftleft(F.col(d), TIE_BITS).bitwiseOR(F.col("tie")) for d in DIMENSIONS]


@dataclass
class Leaf:
    shard: int
    count: int = 1


@dataclass
class Split:
    dimension: int
    below: int
    left: Leaf | Split
    right: Leaf | Split


def shard_of(tree: Leaf | Split, place: list[Column]) -> Column:
    if isinstance(tree, Leaf):
        return F.lit(tree.shard)
    return F.when(place[tree.dimension] < tree.below, shard_of(tree.left, place)).otherwise(shard_of(tree.right, place))


def _spread(histogram: dict[int, int]) -> float:
    """Weighted standard deviation of the values."""
    total = sum(histogram.values())
    mean = sum(v * w for v, w in histogram.items()) / max(total, 1)
    return (sum(w * (v - mean) ** 2 for v, w in histogram.items()) / max(total, 1)) ** 0.5


def _crossing(histogram: dict[int, int], goal: float) -> tuple[int, float]:
    """The value in which the weight from below reaches the goal, and how much of the goal is left at its start."""
    for value in sorted(histogram):
        if histogram[value] >= goal:
            break
        goal -= histogram[value]
    else:
        goal += histogram[value]
    return value, goal


def build_tree(points: DataFrame, shards: int = SHARDS) -> Leaf | Split:
    """Tree with ``shards`` leaves over a table of points (weight, tie and a value along each dimension). An empty table
    gives a tree too; equal places are never told apart."""
    holder = Split(0, 0, Leaf(0, shards), Leaf(0))
    slots = [(holder, "left")] if shards > 1 else []  # where each unsplit node hangs
    whole: list[float] = []
    number = 0
    while slots:
        # nodes of this level get numbers, which the tree so far gives to their points
        for k, (parent, side) in enumerate(slots):
            getattr(parent, side).shard = -1 - k
        level = points.select(shard_of(holder.left, places()).alias("node"), "weight", "tie", *DIMENSIONS).where("node < 0")
        each = level.select("node", "weight", F.posexplode(F.array(*DIMENSIONS)).alias("dimension", "value"))
        seen: dict[tuple[int, int], dict[int, int]] = {}
        for r in each.groupBy("node", "dimension", "value").agg(F.sum("weight").alias("bytes")).collect():
            seen.setdefault((r.node, r.dimension), {})[r.value] = r.bytes
        whole = whole or [_spread(seen.get((-1, d), {})) for d in range(len(DIMENSIONS))]
        cuts, own, digit = [], F.lit(None).cast("int"), F.lit(None).cast("int")
        for k, (parent, side) in enumerate(slots):
            leaf = getattr(parent, side)
            wide = [_spread(seen.get((-1 - k, d), {})) / whole[d] if whole[d] else 0.0 for d in range(len(DIMENSIONS))]
            dimension = max(range(len(wide)), key=lambda d: wide[d])
            histogram = seen.get((-1 - k, dimension), {0: 0})
            value, left = _crossing(histogram, sum(histogram.values()) * (leaf.count // 2) / leaf.count)
            cuts.append((dimension, value, left))
            own = F.when((F.col("node") == -1 - k) & (F.col(DIMENSIONS[dimension]) == value), F.lit(k)).otherwise(own)
        ties: dict[int, dict[int, int]] = {}
        for r in level.select(own.alias("cut"), "tie", "weight").where("cut IS NOT NULL").groupBy("cut", "tie").agg(F.sum("weight").alias("bytes")).collect():
            ties.setdefault(r.cut, {})[r.tie] = r.bytes
        following = []
        for k, (parent, side) in enumerate(slots):
            dimension, value, left = cuts[k]
            tie, left = _crossing(ties.get(k, {0: 0}), left)
            after = left > ties.get(k, {}).get(tie, 0) / 2  # the nearer border
            leaf = getattr(parent, side)
            half = leaf.count // 2
            split = Split(dimension, (value << TIE_BITS) + tie + after, Leaf(0, half), Leaf(0, leaf.count - half))
            setattr(parent, side, split)
            for side in ("left", "right"):
                leaf = getattr(split, side)
                if leaf.count > 1:
                    following.append((split, side))
                else:
                    leaf.shard, number = number, number + 1
        slots = following
    return holder.left


def _planted(rows: DataFrame, shards: int) -> tuple[DataFrame, DataFrame, Leaf | Split]:
    """The rows' groups, the rows with their places, and the tree."""
    groups = materialise(groups_of(rows, shards), "groups")
    placed = _with_groups(rows, groups)
    light = groups.where("NOT cut").select("weight", _tie(F.col("text_hash")).alias("tie"), *DIMENSIONS)
    heavy = _with_groups(rows, groups.where("cut")).select(F.col("size").alias("weight"), "tie", *DIMENSIONS)
    return groups, placed, build_tree(materialise(light.unionByName(heavy), "points"), shards)


def assign(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """Shard and slot of every row under the law ``bytes``: all shards hold nearly the same bytes.

    Returns doc_id, size (UTF-8 bytes of the text and 8 more), text_crc32, law, shard (0 to shards - 1), slot (0, 1, ...
    without gaps in a shard), grown_shard (null under this law). Null texts have no bytes and the checksum 0. Copies of
    a text share a shard unless they are three or more and heavier than ``GROUP_SHARE`` of one; rows with equal ids and
    texts always share one. Null ids are a value like any other. Other columns are ignored; an empty table gives no rows.
    """
    rows = materialise(measures(docs), "measures")
    _, places_, tree = _planted(rows, shards)
    buckets = max(1, -(-rows.count() // (SLOT_ROWS * shards)))
    placed = places_.withColumn("shard", shard_of(tree, places()).cast("int")).withColumn("bucket", F.pmod("row_hash", F.lit(buckets)).cast("int"))
    placed = materialise(placed.select("doc_id", "size", "text_crc32", "text_hash", "shard", "bucket"), "placed")
    forget(rows)
    counts = placed.groupBy("shard", "bucket").agg(F.count("*").alias("rows"))
    before = F.sum("rows").over(Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1))
    offsets = counts.select("shard", "bucket", F.coalesce(before, F.lit(0)).alias("offset"))
    nth = F.row_number().over(Window.partitionBy("shard", "bucket").orderBy("text_hash", "doc_id"))
    return placed.withColumn("nth", nth).join(offsets, ["shard", "bucket"]).select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        (F.col("offset") + F.col("nth") - 1).alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )


def shards_for(docs: DataFrame, target_bytes: int) -> int:
    """How many shards leave none above ``target_bytes`` on average; 1 for an empty table."""
    total = docs.agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0)) + 8)).first()[0] or 0
    return max(1, -(-total // target_bytes))


def write_shards(docs: DataFrame, path: str, shards: int = SHARDS) -> None:
    """Write the documents, all columns, as Parquet partitioned by ``shard`` (which replaces a column of that name).

    Rows get the shards that ``assign`` gives them, null texts, repeated rows and null ids alike; an empty table writes no
    shard. Only the small table of texts' places is joined to the documents.
    """
    inner = docs.select(F.struct("*").alias("_row"), "doc_id", "text", *(c for c in LABELS if c in docs.columns))
    groups, _, tree = _planted(materialise(measures(docs), "measures"), shards)
    marked = inner.select("_row", F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_hash"), F.xxhash64("doc_id").alias("row_hash"))
    full = _with_groups(marked, groups).withColumn("_shard", shard_of(tree, places()).cast("int"))
    kept = [F.col("_row").getField(c).alias(c) for c in docs.columns if c.lower() != "shard"]
    full.select(*kept, F.col("_shard").alias("shard")).write.partitionBy("shard").parquet(path)
