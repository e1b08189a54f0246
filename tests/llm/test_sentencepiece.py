import hashlib
import random
import tracemalloc

import public_tokenizers
import sentencepiece

from tallyspark.llm import sentencepiece_codec as codec
from tallyspark.llm.queries import sentencepiece_digests

PATH = public_tokenizers.path("piece_bpe_32k.model")


def test_ids_and_texts_as_the_library(spark, edges):
    sp = sentencepiece.SentencePieceProcessor(model_file=PATH)
    coded = codec.decode_ids(codec.encode_texts(edges, PATH), PATH).collect()
    texts = [t or "" for _, t in sorted(((r["doc_id"], r["text"]) for r in edges.collect()), key=str)]
    got = sorted(((r["doc_id"], list(r["ids"]), r["decoded"]) for r in coded), key=str)
    assert sorted((ids, text) for _, ids, text in got) == sorted((sp.encode(t), sp.decode(sp.encode(t))) for t in texts)
    assert len(got) == len(texts)


def test_random_texts():
    one, r = codec.Codec(PATH, size=50), random.Random(5)
    texts = ["".join(r.choice(" ▁\n\tab theé中😀<s></s>\x00\u200b\xa0ßﬁ") for _ in range(r.randrange(30))) for _ in range(3000)]
    for a in range(0, len(texts), 100):
        assert [list(x) for x in one.encode(texts[a : a + 100])] == one.model.encode(texts[a : a + 100])


def test_digests_and_empty(spark, empty):
    assert codec.encode_texts(empty, PATH).count() == 0
    row = sentencepiece_digests(spark.createDataFrame([(1, None)], "doc_id bigint, text string")).first()
    nothing = hashlib.sha256(b"").hexdigest()
    assert tuple(row) == (1, 0, nothing, nothing)


def test_table_is_small():
    """Chunk, ids and place in the table take under 200 bytes together."""
    one, r = codec.Codec(PATH), random.Random(6)
    words = ["".join(r.choice("abcdefghij") for _ in range(8)) for _ in range(30_000)]
    tracemalloc.start()
    for a in range(0, len(words), 1000):
        one.encode([" ".join(words[a : a + 1000])])
    held = tracemalloc.get_traced_memory()[0]
    tracemalloc.stop()
    assert len(one.table) > 29_000 and held < 200 * len(one.table)
    assert list(one.encode([words[0]])[0]) == one.model.encode(words[0])
