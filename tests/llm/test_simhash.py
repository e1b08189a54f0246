import random

import xxhash

from tallyspark.llm import simhash


def brute_fingerprint(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    grams = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [b" ".join(words)]
    h = [xxhash.xxh64_intdigest(g, seed=42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(rows):
    rows = [(i, fp & (2**64 - 1)) for i, fp in rows]
    part = list(range(len(rows)))

    def top(i):
        while part[i] != i:
            i = part[i]
        return i

    for a in range(len(rows)):
        for b in range(a):
            if (rows[a][1] ^ rows[b][1]).bit_count() <= 2:
                part[top(a)] = top(b)
    least = {}
    for k, (i, _) in enumerate(rows):
        least[top(k)] = min([x for x in (least.get(top(k)), i) if x is not None], default=None)
    return [least[top(k)] for k in range(len(rows))]


def test_fingerprints(edges):
    for r in edges.select("text").collect():
        assert simhash.fingerprint(r["text"]) & (2**64 - 1) == brute_fingerprint(r["text"])


def test_tree_finds_all():
    r = random.Random(1)
    base = r.getrandbits(64)
    values = list({base ^ sum(1 << r.randrange(64) for _ in range(r.randrange(5))) for _ in range(400)})
    tree = simhash.BKTree()
    for v in values:
        tree.add(v & (2**64 - 1))
    for q in values[:80]:
        q &= 2**64 - 1
        assert sorted(tree.within(q, 2)) == [i for i, v in enumerate(values) if ((v ^ q) & (2**64 - 1)).bit_count() <= 2]


def test_components_like_brute_force_with_large_shards(spark):
    r = random.Random(2)
    near = [r.getrandbits(64) for _ in range(6)]
    fps = {b ^ (1 << r.randrange(64)) ^ (1 << r.randrange(64)) ^ (1 << r.randrange(64)) for b in near for _ in range(60)} | {r.getrandbits(64) for _ in range(50)}
    fps = sorted(f - (1 << 64) if f >> 63 else f for f in (x & (2**64 - 1) for x in fps))
    distinct = spark.createDataFrame([(f,) for f in fps], "fp bigint")
    for shard in (4, 512):
        roots = {x["node"]: x["root"] for x in simhash.components(simhash.links(distinct, shard=shard)).collect()}
        want = brute_components([(k, f) for k, f in enumerate(fps)])
        assert [roots.get(f, f) for f in fps] == [fps[w] if w == k or want.count(w) == 1 else min(fps[j] for j in range(len(fps)) if want[j] == w) for k, (f, w) in enumerate(zip(fps, want))]


def test_edges(spark, edges, empty):
    rows = simhash.near_duplicates(edges).collect()
    assert len(rows) == edges.count()
    want = brute_components([(r["doc_id"], r["fp"]) for r in rows])
    assert [r["component_id"] for r in rows] == want
    assert simhash.near_duplicates(empty).count() == 0


def test_one_of_each_stays(spark, edges, empty):
    kept = simhash.keep_one_of_each(edges)
    assert kept.columns == edges.columns
    rows = simhash.near_duplicates(edges).collect()
    assert kept.count() == len({r["root"] for r in rows})
    assert simhash.keep_one_of_each(empty).count() == 0
    same = spark.createDataFrame([(5, "a b c d"), (3, "a b c d"), (9, "other words stand here")], "doc_id bigint, text string")
    assert sorted(map(tuple, simhash.keep_one_of_each(same).collect())) == [(3, "a b c d"), (9, "other words stand here")]
