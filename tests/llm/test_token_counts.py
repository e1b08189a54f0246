import random

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tallyspark.llm import token_counts as tc

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.mark.parametrize("head", [0, 3, 1000])
def test_as_the_library(spark, edges, head):
    library = Tokenizer.from_file(PATH)
    want = sorted((len((r["text"] or "").encode()), len(library.encode(r["text"] or "", add_special_tokens=False).ids)) for r in edges.collect())
    rows = tc.count_tokens(edges, PATH, head=head).collect()
    assert sorted((r["n_bytes"], r["n_tokens"]) for r in rows) == want


def test_splits_as_the_library():
    split, r = tc.Splitter(PATH), random.Random(7)
    marks = ["'s", " ", "\n", "B", "é", "中", "😀", "1", "²", "<|endoftext|>", "<|", "\x1c", "\x85", "\xa0", "'ll", "!", "_", "\u0301", "\u0558", "\u208f", "\ua7f1", "\U00010940"]
    texts = ["".join(r.choice(marks) for _ in range(r.randrange(20))) for _ in range(3000)]
    for t, e in zip(texts, split.library.encode_batch(texts, add_special_tokens=False)):
        tokens, added = split.split(t)
        assert sum(split.count(tokens) if tokens else []) + added == len(e.ids)


def test_empty(empty):
    assert tc.count_tokens(empty, PATH).count() == 0


def test_other_vocabularies_are_refused():
    with pytest.raises(ValueError):
        tc.checked(public_tokenizers.path("word_bpe_49k.json"))
