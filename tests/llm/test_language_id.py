import random

from tallyspark.llm import language_id

WORDS = {"aa": ["the", "thing", "that", "with", "other"], "bb": ["und", "schön", "nicht", "über", "zwei"], "cc": ["que", "para", "niño", "llama", "calle"]}


def table(spark, n=240):
    r = random.Random(3)
    rows = []
    for i in range(n):
        lang = sorted(WORDS)[i % 3]
        rows.append((i, " ".join(r.choice(WORDS[lang]) for _ in range(r.randrange(3, 40))), lang))
    return spark.createDataFrame(rows, "doc_id bigint, text string, lang string")


def test_held_out_accuracy(spark):
    docs = table(spark)
    rows = language_id.identify_languages(docs).join(docs.select("doc_id", "lang"), "doc_id").filter("held_out").collect()
    assert len(rows) > 20 and sum(r["lang_pred"] == r["lang"] for r in rows) >= 0.97 * len(rows)
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_labels_of_the_held_out_fold_do_not_matter(spark):
    docs = table(spark)
    other = docs.withColumn("lang", language_id.F.when(language_id.held_out(language_id.F.col("doc_id")), "zz").otherwise(language_id.F.col("lang")))
    key = lambda df: sorted(map(tuple, language_id.identify_languages(df).collect()))
    assert key(docs) == key(other)


def test_edges(spark, edges, empty):
    model = language_id.fit(table(spark))
    rows = language_id.identify_languages(edges, model=model).collect()
    assert len(rows) == edges.count()
    by = {(r["doc_id"], r["score"]): r for r in rows}
    assert all(r["lang_pred"] == "und" and r["score"] == 0 and not r["near"] for r in rows if r["doc_id"] in (1, 2, 3, 5))
    assert all(r["lang_pred"] in WORDS for r in rows if r["doc_id"] in (4, 6, 7, 8)) and by
    assert language_id.identify_languages(empty).count() == 0
    assert {r["lang_pred"] for r in language_id.identify_languages(edges.withColumn("lang", language_id.F.lit(None).cast("string"))).collect()} == {"und"}


def test_filter_keeps_columns_and_clean_rows(spark, edges):
    docs = table(spark)
    kept = language_id.keep_known_languages(docs)
    assert kept.columns == docs.columns and kept.count() >= docs.count() - 1
    assert language_id.keep_known_languages(edges).columns == edges.columns


def test_counts_are_those_of_single_texts():
    texts = [b"Abc def", b"", b"x", "été là".encode()]
    together = language_id.gram_counts(texts)
    assert (together == [language_id.gram_counts([t])[0] for t in texts]).all()
