"""The pipeline's near-duplicate stage against exact Jaccard similarity on edited copies."""

import random

import corpus_pipeline
from tallyspark.llm import near_dedup


def jaccard(a, b):
    x, y = (set(zip(*(t.lower().split()[i:] for i in range(5)))) for t in (a, b))
    return len(x & y) / len(x | y)


def edited_texts():
    """60 texts of 60 to 300 words, each with seven copies in which 1 to 12 words are changed."""
    r, out = random.Random(3), []
    for _ in range(60):
        base = [f"w{r.randrange(5000)}" for _ in range(r.randrange(60, 300))]
        out.append(" ".join(base))
        for _ in range(7):
            copy = list(base)
            for at in r.sample(range(len(base)), r.randrange(1, 13)):
                copy[at] = f"v{r.randrange(5000)}"
            out.append(" ".join(copy))
    return out


def brute_components(texts):
    part = list(range(len(texts)))

    def top(i):
        while part[i] != i:
            i = part[i]
        return i

    for a in range(len(texts)):
        for b in range(a):
            if jaccard(texts[a], texts[b]) >= 0.8:
                x, y = top(a), top(b)
                part[max(x, y)] = min(x, y)
    return [top(k) for k in range(len(texts))]


def test_stage_finds_edited_copies(spark):
    texts = edited_texts()
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    want = brute_components(texts)
    assert 60 <= len(set(want)) < 400
    got = {r["doc_id"]: r["component_id"] for r in near_dedup.near_duplicates(docs).collect()}
    assert [got[k] for k in range(len(texts))] == want
    assert sorted(r["doc_id"] for r in corpus_pipeline.drop_near_duplicates(spark, docs, "").collect()) == sorted(set(want))


def test_blocks_and_trees_end_alike(spark, monkeypatch):
    """A chain of copies, each a little further from the first: shards of many classes that stay apart, cut into small blocks."""
    r = random.Random(5)
    base = [f"w{r.randrange(900)}" for _ in range(140)]
    texts = []
    for k in range(90):
        copy = list(base)
        for at in r.sample(range(140), r.randrange(0, 14)):
            copy[at] = f"x{k}y{at}"
        texts.append(" ".join(copy))
    want = brute_components(texts)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    for small, shard, blocks in ((32, 512, 16), (4, 8, 16), (4, 8, 2)):
        monkeypatch.setattr(near_dedup, "SMALL", small)
        monkeypatch.setattr(near_dedup, "SHARD", shard)
        monkeypatch.setattr(near_dedup, "BLOCKS", blocks)
        got = {r["doc_id"]: r["component_id"] for r in near_dedup.near_duplicates(docs).collect()}
        assert [got[k] for k in range(len(texts))] == want


def test_large_shards_lose_no_pair(spark, monkeypatch):
    """A shard of many blocks whose classes share this one band and no other."""
    for name, value in (("SMALL", 4), ("SHARD", 4), ("BLOCKS", 2)):
        monkeypatch.setattr(near_dedup, name, value)
    r = random.Random(8)
    common, texts, want = [f"c{k}" for k in range(60)], [], set()
    for k in range(40):
        # half of the words are everybody's; pairs of texts differ in their last words only
        own = common + [f"o{k}n{j}" for j in range(60)]
        texts += [" ".join(own), " ".join(own[: -r.randrange(1, 9)] + [f"x{k}"])]
    rows = [(*near_dedup.sketch(t)[:3], near_dedup.grams(t).tobytes()) for t in texts]
    for k in range(0, 80, 2):
        assert jaccard(texts[k], texts[k + 1]) >= 0.8 > jaccard(texts[k], texts[(k + 2) % 80])
        want.add((min(rows[k][0], rows[k + 1][0]), max(rows[k][0], rows[k + 1][0])))
    classes = spark.createDataFrame([(fp, k, n, sim, [1, 1000 + k]) for k, (fp, n, sim, _) in enumerate(rows)], "fp bigint, least bigint, n int, sim bigint, bands array<bigint>")
    sets = spark.createDataFrame([(x[0], x[3]) for x in rows], "fp bigint, grams binary")
    shard = near_dedup.mixed(classes.selectExpr("1L as key", "fp", "sim", "n", "fp as root"))
    assert shard.first()["blocks"] > near_dedup.BLOCKS
    known = spark.createDataFrame([], "a bigint, b bigint")
    assert {tuple(r) for r in near_dedup.remaining(shard, classes, sets, known).collect()} == want


def test_edges(spark, edges, empty):
    found = near_dedup.near_duplicates(edges).collect()
    assert len(found) == edges.count()
    kept = near_dedup.keep_one_of_each(edges)
    assert kept.columns == edges.columns
    assert kept.count() == len({r["root"] for r in found})
    assert near_dedup.keep_one_of_each(empty).count() == 0


def test_sets_are_made_once(spark):
    """One worker a task makes the sets, of the wanted texts alone, and none of them twice."""
    texts = spark.createDataFrame([(1, "a b c d e f"), (2, "g h"), (None, "i"), (3, "j k")], "id bigint, body string")
    fps = {t: near_dedup.sketch(t)[0] for t in ("a b c d e f", "i", "j k")}
    nodes = spark.createDataFrame([(fps["a b c d e f"], 1), (fps["i"], None), (fps["j k"], 3)], "fp bigint, least bigint")
    found = near_dedup.sets_of(texts, nodes)
    assert found._jdf.queryExecution().optimizedPlan().toString().count("ArrowEvalPython") == 1
    assert {r["fp"]: bytes(r["grams"]) for r in found.collect()} == {fp: near_dedup.grams(t).tobytes() for t, fp in fps.items()}
