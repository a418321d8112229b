import random
import zlib
from collections import Counter, defaultdict

from traitloom.llm import kdshards


def corpus():
    draw = random.Random(8)
    rows = [(d, draw.choice(["é", "x", "長"]) * draw.randrange(1, 400) + str(d)) for d in range(3000)]
    rows += [(5000 + d, "one hot text " * 20) for d in range(1500)] + [(8000 + d, f"pair {d // 2} " * 9) for d in range(400)]
    return rows + [(9000, None), (9001, ""), (None, "no id"), (7, rows[7][1])]


def test_shards_are_near_equal_and_slots_gapless(spark):
    rows = corpus()
    docs = spark.createDataFrame([(d, t, 5, 1) for d, t in rows], "doc_id long, text string, size int, shard int").repartition(5)
    got = kdshards.assign(docs, 24).collect()
    assert len(got) == len(rows)
    size = lambda t: len((t or "").encode()) + 8
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in got) == Counter((d, size(t), zlib.crc32((t or "").encode())) for d, t in rows)
    weight, slots = Counter(), defaultdict(list)
    for r in got:
        weight[r.shard] += r.size
        slots[r.shard].append(r.slot)
    mean = sum(weight.values()) / 24
    assert set(weight) == set(range(24)) and max(weight.values()) < 1.06 * mean and min(weight.values()) > 0.94 * mean
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    homes = defaultdict(set)
    for r in got:
        homes[(r.size, r.text_crc32)].add(r.shard)
    several = [k for k, s in homes.items() if len(s) > 1]
    assert several == [(268, zlib.crc32(b"one hot text " * 20))]  # the hot text alone is cut
    assert {r.law for r in got} == {"bytes"} and {r.grown_shard for r in got} == {None}
    again = kdshards.assign(docs.repartition(3), 24).collect()
    assert sorted(map(str, again)) == sorted(map(str, got))


def test_edges(spark, tmp_path):
    docs = spark.createDataFrame(corpus()[:40], "doc_id long, text string")
    assert kdshards.assign(docs.limit(0)).count() == 0
    assert {r.shard for r in kdshards.assign(docs, 1).collect()} == {0}
    few = kdshards.assign(docs.limit(3), 24).collect()
    assert len(few) == 3 and all(0 <= r.shard < 24 for r in few)
    assert kdshards.shards_for(docs, 1000) == -(-sum(len((t or "").encode()) + 8 for _, t in corpus()[:40]) // 1000)
    kdshards.write_shards(docs.withColumn("size", docs.doc_id), str(tmp_path / "out"), 4)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert sorted((r.doc_id, r.text, r.size) for r in back.collect()) == sorted((d, t, d) for d, t in corpus()[:40])
    assert {r.shard for r in back.collect()} == {0, 1, 2, 3}


def test_the_tree_splits_on_metadata(spark):
    draw = random.Random(3)
    rows = [(d, "word " * draw.randrange(1, 600) + str(d // 2), f"s{draw.randrange(12)}", draw.choice("abc")) for d in range(4000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string")
    _, placed, tree = kdshards._planted(kdshards.measures(docs), 24)
    dimensions, nodes = Counter(), [tree]
    while nodes:
        node = nodes.pop()
        if isinstance(node, kdshards.Split):
            dimensions[node.dimension] += 1
            nodes += [node.left, node.right]
    assert sum(dimensions.values()) == 23 and {0, 2, 3} <= set(dimensions)
    points = placed.select("size", "tie", *kdshards.DIMENSIONS, kdshards.shard_of(tree, kdshards.places()).alias("shard")).collect()

    def find(node, r):  # the shard by definition
        while isinstance(node, kdshards.Split):
            node = node.left if (r[f"d{node.dimension}"] << kdshards.TIE_BITS) + r.tie < node.below else node.right
        return node.shard

    assert all(find(tree, r) == r.shard for r in points)
    whole = {d: kdshards._spread(Counter({v: sum(r.size for r in points if r[f"d{d}"] == v) for v in {r[f"d{d}"] for r in points}})) for d in range(4)}
    widest = max((d for d in range(4) if whole[d]), key=lambda d: 1.0)
    assert tree.dimension == widest  # all are as wide as themselves at the root, so the first one is taken
    shards = Counter()
    for r in points:
        shards[r.shard] += r.size
    assert max(shards.values()) < 1.05 * sum(shards.values()) / 24


def test_copies_with_other_labels_stay_together(spark):
    rows = [(d, f"text {d % 700} " * 20, f"s{d % 9}", None if d % 5 else "xx") for d in range(1400)]
    got = kdshards.assign(spark.createDataFrame(rows, "doc_id long, text string, source string, lang string")).collect()
    homes = defaultdict(set)
    for r in got:
        homes[r.doc_id % 700].add(r.shard)
    assert {len(h) for h in homes.values()} == {1}
