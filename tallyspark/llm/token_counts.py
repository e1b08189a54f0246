"""Token counts from a table of distinct pre-tokens.

A byte-level BPE never merges across its pre-tokens, so a text's count is the
sum of its pre-tokens' counts.  The corpus' distinct pre-tokens are counted
once each by the library.  The most frequent of them, a fixed number, are
broadcast and summed where a document is read; all others leave the document
as (pre-token, frequency) and are joined with the table of counts.  No ids are
kept.
"""

from __future__ import annotations

import json
import os
from collections import Counter
from collections.abc import Iterator
from functools import cached_property

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batched, slices, written

#: Distinct pre-tokens that are broadcast at most (a bound, whatever the corpus), and those a task holds before it passes them on.
HEAD, HELD = 150_000, 50_000
#: The pre-tokenisation of byte-level BPE vocabularies of this family, as published with them (fixed value).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Characters outside these old blocks may have been given a class after the library's Unicode tables; each is looked up once.
RARE = regex.compile(r"[^\x00-\u024F\u0370-\u0377\u0391-\u03CE\u0400-\u04FF\u2010-\u2046\u3041-\u3096\u30A0-\u30FF\u4E00-\u9FA5\uAC00-\uD7A3]")
#: Longer pre-tokens are counted where they stand.
LONG = 200


def checked(path: str) -> None:
    """Raise where the vocabulary file is of another kind than PATTERN stands for: what it says of normalising and splitting is read from the file itself."""
    from tokenizers import Tokenizer

    said = json.loads(Tokenizer.from_file(path).to_str())
    split = said.get("pre_tokenizer") or {}
    plain = split.get("type") == "ByteLevel" and split.get("use_regex", True) and not split.get("add_prefix_space")
    if said.get("normalizer") or not plain or said["model"]["type"] != "BPE" or any(t["normalized"] or t["lstrip"] or t["rstrip"] or t["single_word"] for t in said["added_tokens"]):
        raise ValueError(f"{path} is not a byte-level BPE vocabulary without normaliser, split by its own pattern")


def added_tokens(path: str) -> list[str]:
    """The added tokens of a vocabulary file, longest first."""
    from tokenizers import Tokenizer

    return sorted((t.content for t in Tokenizer.from_file(path).get_added_tokens_decoder().values()), key=len, reverse=True)


class Splitter:
    """Splits texts as the library does: at the added tokens first, then by the pattern."""

    def __init__(self, path: str, added: list[str] | None = None):
        self.path, self.find = path, regex.compile(PATTERN).findall
        added = added_tokens(path) if added is None else added
        self.added = regex.compile("|".join(map(regex.escape, added))) if added else None
        self.agree: dict[str, bool] = {}

    @cached_property
    def library(self):
        """Loaded where a worker first needs it; most that split texts never do."""
        from tokenizers import Tokenizer

        # Spark has a task for each core already; the library's own threads would each keep memory
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        return Tokenizer.from_file(self.path)

    def agrees(self, char: str) -> bool:
        """Whether the pattern puts this character in the same class as the library."""
        if (known := self.agree.get(char)) is None:
            probe = f"a{char}b 1{char}"
            known = self.agree[char] = len(self.find(probe)) == len(self.library.pre_tokenizer.pre_tokenize_str(probe))
        return known

    def tokens(self, text: str) -> list[str]:
        if all(map(self.agrees, set(RARE.findall(text)))):
            return self.find(text)
        return [text[a:b] for _, (a, b) in self.library.pre_tokenizer.pre_tokenize_str(text)]

    def split(self, text: str) -> tuple[list[str], int]:
        """Pre-tokens, and how many added tokens stand in the text."""
        if self.added is None or not self.added.search(text):
            return self.tokens(text), 0
        parts = self.added.split(text)
        return [t for p in parts for t in self.tokens(p)], len(parts) - 1

    def count(self, tokens: list[str]) -> list[int]:
        return [len(e.ids) for e in self.library.encode_batch(tokens, add_special_tokens=False)]


def pre_token_counts(documents: DataFrame, path: str, text_col: str) -> DataFrame:
    """(token, n): how often each pre-token of up to LONG characters stands in all texts."""

    added = added_tokens(path)

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        splitter, held = Splitter(path, added), Counter()

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.string()), pa.array(held.values(), pa.int64())], ["token", "n"])

        for batch in batches:
            for text in batch.column(0):
                held.update(splitter.split(text.as_py() or "")[0])
                if len(held) > HELD:
                    yield out()
                    held.clear()
        yield out()

    rows = documents.select(text_col).mapInArrow(tally, "token string, n bigint")
    return rows.filter(F.length("token") <= LONG).groupBy("token").agg(F.sum("n").alias("n"))


def counted(tokens: DataFrame, path: str) -> DataFrame:
    """``tokens`` with a column ``pieces``: the library's count for each."""

    @F.arrow_udf("int")
    def pieces(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        splitter = Splitter(path, [])
        for batch in slices(batches, 1000):
            yield pa.array(splitter.count(batch.to_pylist()), pa.int32())

    return tokens.withColumn("pieces", pieces("token"))


def most_frequent(table: DataFrame, head: int) -> DataFrame:
    """The rows of the highest frequency classes that hold at most ``head`` rows together: no sort, and never more than ``head``.

    A class is a thirty-second of a doubling, so there are about 2,000 at most.
    """
    level = F.floor(F.log2(F.col("n").cast("double")) * 32)
    room, least = head, None
    for r in table.groupBy(level.alias("level")).count().orderBy(F.desc("level")).collect():
        room -= r["count"]
        if room < 0:
            break
        least = r["level"]
    return table.filter(level >= least) if least is not None else table.limit(0)


def count_tokens(documents: DataFrame, path: str, *, id_col: str = "doc_id", text_col: str = "text", head: int = HEAD) -> DataFrame:
    """(id, n_bytes, n_tokens): one row for each document, counts as the library at ``path`` gives them.

    Null and empty texts have no bytes and no tokens.  Repeated rows and
    repeated ids stay as rows of their own; other columns are not read.  A
    vocabulary of another kind is refused.
    """
    checked(path)
    spark = batched(documents).sparkSession
    table = written(counted(pre_token_counts(documents, path, text_col), path))
    top = most_frequent(table, head).select("token", "pieces").toArrow()
    sent = spark.sparkContext.broadcast((top["token"].combine_chunks(), top["pieces"].combine_chunks(), added_tokens(path)))

    kind = "struct<n_bytes:bigint,known:bigint,tokens:array<string>,times:array<int>>"
    arrow = pa.struct([("n_bytes", pa.int64()), ("known", pa.int64()), ("tokens", pa.list_(pa.string())), ("times", pa.list_(pa.int32()))])

    @F.arrow_udf(kind)
    def summed(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        tokens, pieces, added = sent.value
        splitter, known = Splitter(path, added), dict(zip(tokens.to_pylist(), pieces.to_pylist()))
        for batch in slices(batches):
            out = []
            for text in batch.to_pylist():
                text = text or ""
                tokens, n = splitter.split(text)
                rest: Counter = Counter()
                for token, times in Counter(tokens).items():
                    if (count := known.get(token)) is not None:
                        n += count * times
                    elif len(token) > LONG:
                        n += splitter.count([token])[0] * times
                    else:
                        rest[token] = times
                out.append((len(text.encode("utf-8", "replace")), n, list(rest.keys()), list(rest.values())))
            columns = list(zip(*out)) or [()] * 4
            yield pa.StructArray.from_arrays([pa.array(c, f.type) for c, f in zip(columns, arrow)], fields=list(arrow))

    seen = written(documents.select(F.col(id_col).alias("id"), F.monotonically_increasing_id().alias("row"), summed(F.col(text_col)).alias("s")).select("id", "row", "s.*"))
    rest = (
        seen.select("row", F.explode(F.arrays_zip("tokens", "times")).alias("t"))
        .select("row", "t.tokens", "t.times")
        .join(table.select(F.col("token").alias("tokens"), "pieces"), "tokens")
        .groupBy("row")
        .agg(F.sum(F.col("times").cast("bigint") * F.col("pieces")).alias("more"))
    )
    return seen.join(rest, "row", "left").select(F.col("id").alias(id_col), "n_bytes", (F.col("known") + F.coalesce("more", F.lit(0))).alias("n_tokens"))
