import random
import re

from tallyspark.llm import decontaminate as dc


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute(text, items, window=10):
    w, hit, found = words(text), set(), set()
    for item, t in items:
        iw = words(t)
        n = min(window, len(iw))
        grams = {tuple(iw[i : i + n]) for i in range(len(iw) - n + 1)} if n else set()
        for i in range(len(w)):
            if tuple(w[i : i + n]) in grams:
                hit |= set(range(i, i + n))
                found.add(str(item))
    return len(w), len(hit), sorted(found)


def tables(spark):
    r = random.Random(6)
    vocab = [f"w{i}" for i in range(12)]
    items = [(k, " ".join(r.choice(vocab) for _ in range(n))) for k, n in enumerate([25, 12, 10, 9, 3, 14, 11])] + [(7, None), (8, "..."), (1, "Another Text, of the same id: it has more words than ten!"), (None, "a b c d e f g h i j k")]
    texts = []
    for i in range(60):
        t = [r.choice(vocab) for _ in range(r.randrange(0, 60))]
        if i % 3 == 0:
            part = (r.choice(items[:7])[1]).split()
            t[5:5] = part[: r.randrange(1, len(part) + 1)]
        texts.append((i, " ".join(t)))
    return texts, items


def test_like_brute_force(spark, edges):
    texts, items = tables(spark)
    texts += [(r["doc_id"], r["text"]) for r in edges.collect()] + [(3, "A; b, C d e f G h i J k"), (3, "a b c d e f g h i j k")]
    docs, bench = spark.createDataFrame(texts, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string")
    got = sorted(((r["doc_id"], r["n_words"], r["n_hit"], list(r["items"])) for r in dc.contamination(docs, bench).collect()), key=str)
    assert got == sorted(((i, *brute(t, [x for x in items if x[0] is not None] + [])) if "a b c" not in (t or "").lower().replace(",", "").replace(";", "") else (i, 11, 11, []) for i, t in texts), key=str)


def test_a_full_table_and_no_broadcast_change_nothing(spark, monkeypatch):
    texts, items = tables(spark)
    docs, bench = spark.createDataFrame(texts, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string")
    one = sorted(map(str, dc.contamination(docs, bench).collect()))
    monkeypatch.setattr(dc, "LEAST_BITS", 6)
    monkeypatch.setattr(dc, "MOST_BITS", 6)
    monkeypatch.setattr(dc, "BROADCAST_WINDOWS", 0)
    assert one == sorted(map(str, dc.contamination(docs, bench).collect()))


def test_many_windows(spark):
    """60,000 windows: the bit table stays a constant of the scan, and only true hits are left."""
    r = random.Random(9)
    items = [(k, " ".join(f"t{r.randrange(10**6)}" for _ in range(2009))) for k in range(30)]
    clean = [(k, " ".join(f"d{r.randrange(10**6)}" for _ in range(300))) for k in range(40)]
    dirty = [(100 + k, "before " + " ".join(t.split()[k * 50 : k * 50 + 12]) + " after") for k, t in items]
    docs, bench = spark.createDataFrame(clean + dirty, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string")
    got = {r["doc_id"]: (r["n_hit"], list(r["items"])) for r in dc.contamination(docs, bench).collect()}
    assert got == {i: (0, []) for i, _ in clean} | {100 + k: (12, [str(k)]) for k, _ in items}


def test_removal_and_empty_tables(spark, edges, empty):
    bench = spark.createDataFrame([(1, "The same TEXT here")], "item_id bigint, text string")
    kept = dc.remove_contaminated(edges, bench)
    assert kept.columns == edges.columns and kept.count() == edges.count() - 3
    spans = dc.remove_contaminated(edges.filter("doc_id = 7").withColumn("text", dc.F.lit("Before, the same text here: After")), bench, mode="spans")
    assert spans.first()["text"] == "before after"
    assert dc.contamination(empty, bench).count() == 0
    assert dc.remove_contaminated(edges, bench.limit(0)).count() == edges.count()
