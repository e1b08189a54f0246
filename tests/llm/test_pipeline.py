"""run() against a brute-force version of its own decisions, and planted cases."""

import hashlib

import public_tokenizers
import sentencepiece

import corpus_pipeline
from tallyspark.llm import decontaminate, language_id, toxicity
from tallyspark.llm.common import table


def shingles(text):
    """Five-word shingles of a text, words parted by white space, A-Z lower-cased; a shorter text is one shingle."""
    words = (text or "").encode().lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))}


def alike(a, b):
    return len(a & b) >= 0.8 * len(a | b)


def test_run_like_the_stages_by_hand(spark, sf):
    docs = table(spark, sf, "documents")
    rows = {r["doc_id"]: r["text"] for r in docs.collect()}
    model = toxicity.fit(docs, table(spark, sf, "labels"))
    left = {i: t for i, t in rows.items() if model.score(t) < toxicity.THRESHOLD}
    frame = lambda d: docs.filter(docs["doc_id"].isin(list(d)))
    centroids = language_id.fit(frame(left))
    left = {i: t for i, t in left.items() if any(map(str.isalpha, t)) and centroids.predict(language_id.gram_counts([t.encode()]))[2][0]}
    sets = {i: shingles(t) for i, t in left.items()}
    ids, stays = sorted(left), {}
    for i in ids:  # grow each group from its smallest id
        if i in stays:
            continue
        group, todo = {i}, [i]
        while todo:
            a = todo.pop()
            new = {b for b in ids if b not in group and alike(sets[a], sets[b])}
            group |= new
            todo += new
        stays |= {j: j == min(group) for j in group}
    left = {i: t for i, t in left.items() if stays[i]}
    clean = {r["doc_id"] for r in decontaminate.contamination(frame(left), table(spark, sf, "benchmark")).collect() if not r["n_hit"]}
    sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    want = {i: hashlib.sha256(",".join(map(str, sp.encode(left[i]))).encode()).hexdigest() for i in clean}
    assert {r["doc_id"]: r["ids_sha256"] for r in corpus_pipeline.run(spark, sf).collect()} == want


def test_stages_keep_the_columns(spark, sf):
    docs = table(spark, sf, "documents")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, sf).columns == docs.columns, name


def folder(spark, tmp_path, docs):
    """A folder of the three tables that the stages read."""
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, "a b c d e f g h i j k")], "item_id bigint, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    spark.createDataFrame([(900, 1, 0)], "doc_id bigint, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    return str(tmp_path)


def test_run_on_edges(spark, edges, tmp_path):
    """Null, empty and repeated texts, clashing names and a very long text: rows come back, one for each group, in the last stage's columns."""
    where = folder(spark, tmp_path, edges)
    found = corpus_pipeline.run(spark, where)
    assert found.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    rows = found.collect()
    # without letters nothing has a language, so only texts of words come through, one of each group of equal texts
    said = {r.doc_id for r in rows}
    assert rows and len(rows) == len({r.ids_sha256 for r in rows}) and all(r.n_tokens > 0 for r in rows)
    assert not said & {1, 2, 3, 5} and len(rows) < edges.count()


def test_run_on_an_empty_table(spark, empty, tmp_path):
    assert corpus_pipeline.run(spark, folder(spark, tmp_path, empty)).count() == 0
