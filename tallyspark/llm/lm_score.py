"""Language-model scores of whole texts: a bigram model in sharded Elias-Fano tries, smoothed by absolute discounting.

    P(w | v) = max(c(v, w) - D, 0) / c(v) + D * T(v) / c(v) * P(w),   P(w) = (c(w) + A) / (N + A * (V + 1))

with T(v) the distinct successors of v; after an unseen v it is P(w).  The
probabilities of all V known words and of one unknown word sum to one.

The model grows with the corpus, so it is never gathered: contexts are dealt
to shards, and a shard is a trie.  Texts are read in chunks.  A chunk sends
each shard its distinct bigrams there, once, with their counts in learning
texts (0 if only held-out texts have them): a few packed arrays instead of a
row a token.  A shard adds up what all chunks sent, builds its trie, looks the
bigrams up in it, and sends each chunk the quantised codes of its bigrams and
the counts of its words.  A word's own count is its count as a context, so a
chunk learns P(w) with the same answer.  The chunk's words, as numbers, come
back to it by way of the shuffles and its texts are scored there.  Totals (N,
V) are two sums that a pass before this one makes, which also says how many
shards there must be.  A frequent word's share of a shard is its distinct
successors, not its occurrences.

Words are told apart by 64-bit hashes (63 bits are used: of a billion words
two are alike with a chance of one in twenty), successors of one context by 32.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batched
from .elias_fano import Trie, restored

#: Text of a chunk, unless one text alone is longer; bounds a task's memory.
CHUNK_BYTES = 12_000_000
#: Tokens that a shard answers for, about: its distinct bigrams are fewer.
SHARD_TOKENS = 2_500_000
DISCOUNT, ADDED = 0.75, 0.1
#: One fold in FOLDS, the one with remainder 0, is held out from learning.
FOLDS = 10
#: Stands before the first word and after the last; no word is empty.
EDGE = b""


def key(word: bytes) -> int:
    return xxhash.xxh3_64_intdigest(word) >> 1


def tokens(text: str | None) -> list[bytes]:
    """Words, A-Z lower-cased, parted by white space of ASCII."""
    return (text or "").encode("utf-8", "replace").lower().split()


class Chunk:
    """Texts as numbers of their words, in the order they came."""

    def __init__(self) -> None:
        self.ids: dict[bytes, int] = {EDGE: 0}
        self.docs: list[tuple[object, bool]] = []
        self.runs: list[np.ndarray] = []
        self.size = 0

    def add(self, doc_id: object, held_out: bool, text: str | None) -> None:
        words = tokens(text)
        ids = self.ids
        for w in words:
            if w not in ids:
                ids[w] = len(ids)
        self.runs.append(np.fromiter(map(ids.__getitem__, words), np.uint32, len(words)))
        self.docs.append((doc_id, held_out))
        self.size += len(text or "") + 1

    def keys(self) -> np.ndarray:
        return np.fromiter(map(key, self.ids), np.int64, len(self.ids))


def chunks(batches: Iterable[pa.RecordBatch]) -> Iterator[Chunk]:
    """Chunks of rows (doc_id, held_out, text)."""
    now = Chunk()
    for b in batches:
        for doc_id, held_out, text in zip(*(c.to_pylist() for c in b.columns)):
            now.add(doc_id, held_out, text)
            if now.size >= CHUNK_BYTES:
                yield now
                now = Chunk()
    if now.docs:
        yield now


def bigrams(runs: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(before, after, length): the tokens of texts with what stands before each; number 0 is the edge, and every text's last token."""
    length = np.array([len(r) + 1 for r in runs], np.int64)
    end = np.cumsum(length)
    after = np.zeros(int(end[-1]) if len(end) else 0, np.int64)
    inner = np.ones(len(after), bool)
    inner[end - 1] = False
    after[inner] = np.concatenate(runs) if runs else []
    # the edge that ends a text stands before the first token of the next
    return np.r_[0, after[:-1]].astype(np.int64) if len(after) else after, after, length


def squeezed(x: np.ndarray) -> bytes:
    """Numbers as bytes, first all lowest bytes, then the next, compressed: high bytes are few values."""
    planes = np.ascontiguousarray(x).view(np.uint8).reshape(len(x), x.itemsize).T.tobytes()
    return pa.compress(planes, "zstd", asbytes=True) if planes else b""


def loosened(data: bytes, n: int, kind: str) -> np.ndarray:
    """n numbers back from squeezed()."""
    size = np.dtype(kind).itemsize
    if not n:
        return np.empty(0, kind)
    planes = np.frombuffer(pa.decompress(data, n * size, "zstd", asbytes=True), np.uint8)
    return np.ascontiguousarray(planes.reshape(size, n).T).view(kind).ravel()


def told(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)


def word_tallies(shards: int):
    """For mapInArrow: (shard, keys, counts) of the words of learning texts, for each chunk and shard."""
    schema = pa.schema([("shard", pa.int64()), ("keys", pa.binary()), ("counts", pa.binary())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in chunks(batches):
            learnt = [r for r, (_, out) in zip(chunk.runs, chunk.docs) if not out]
            if not learnt:
                continue
            count = np.bincount(np.concatenate(learnt), minlength=len(chunk.ids))
            count[0] = len(learnt)
            at, k = np.flatnonzero(count), chunk.keys()
            k, count = k[at], count[at]
            shard = k % shards
            yield told([(s, k[shard == s].astype("<i8").tobytes(), count[shard == s].astype("<u4").tobytes()) for s in np.unique(shard).tolist()], schema)

    return run


def sums(key_: tuple, rows: pa.Table) -> pa.Table:
    """(tokens, words) of one shard's tallies."""
    k = np.concatenate([np.frombuffer(b.as_py(), "<i8") for b in rows["keys"]])
    n = sum(int(np.frombuffer(b.as_py(), "<u4").sum(dtype=np.int64)) for b in rows["counts"])
    return pa.table({"tokens": [n], "words": [len(np.unique(k))]})


def sorted_words(keys: np.ndarray, shards: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(rank, keys, shard): words by (shard, key); rank says where each word of the chunk went."""
    shard = keys % shards
    order = np.lexsort((keys, shard))
    rank = np.empty(len(keys), np.int64)
    rank[order] = np.arange(len(keys))
    return rank, keys[order], shard[order]


#: What travels, squeezed, with how many contexts and bigrams there are: the bigrams of a chunk for a shard, the answer to them, or a chunk's own words (to nobody: it passes through).
PARCEL = "place bigint, chunk bigint, shard int, n_contexts int, n_words int, contexts binary, degrees binary, words binary, counts binary, doc_ids array<{kind}>, held_out array<boolean>, lengths array<bigint>"


def parcels(shards: int, kind: pa.DataType):
    """For mapInArrow: parcels of every chunk to its shards, and the chunk to itself."""
    schema = pa.schema([("place", pa.int64()), ("chunk", pa.int64()), ("shard", pa.int32()), ("n_contexts", pa.int32()), ("n_words", pa.int32()), *[(c, pa.binary()) for c in ("contexts", "degrees", "words", "counts")], ("doc_ids", pa.list_(kind)), ("held_out", pa.list_(pa.bool_())), ("lengths", pa.list_(pa.int64()))])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        for number, chunk in enumerate(chunks(batches)):
            name = part << 24 | number
            rank, keys, shard = sorted_words(chunk.keys(), shards)
            before, after, length = bigrams(chunk.runs)
            pair = rank[before] * len(keys) + rank[after]
            learnt = np.repeat([not out for _, out in chunk.docs], length)
            pairs = np.unique(pair)
            count = np.bincount(np.searchsorted(pairs, pair[learnt]), minlength=len(pairs))
            context, word = pairs // len(keys), pairs % len(keys)
            degree = np.bincount(context, minlength=len(keys))
            at = np.searchsorted(shard, np.arange(shards + 1))
            ends = np.r_[0, np.cumsum(degree)][at]
            low = (keys & 0xFFFFFFFF).astype("<u4")
            for s in range(shards):
                if at[s] < at[s + 1]:
                    w, b = slice(at[s], at[s + 1]), slice(ends[s], ends[s + 1])
                    # one at a time: a batch of all would hold the chunk twice
                    sent = (keys[w].astype("<i8"), degree[w].astype("<u4"), low[word[b]], count[b].astype("<u4"))
                    yield told([(s, name, s, len(sent[0]), len(sent[2]), *map(squeezed, sent), None, None, None)], schema)
            # numbered as they came, so frequent words are small numbers; rank says where each stands among the sorted
            flow = np.concatenate(chunk.runs).astype("<u4")
            ids, out = zip(*chunk.docs)
            yield told([(-1 - name, name, None, len(rank), len(flow), squeezed(rank.astype("<u4")), None, squeezed(flow), None, list(ids), list(out), (length - 1).tolist())], schema)

    return run


def answers(place: tuple, rows: pa.Table) -> pa.Table:
    """The parcels of a shard with codes for words and (count, successors) for contexts in the place of what was asked; a chunk's own parcel as it is."""
    if place[0].as_py() < 0:
        return rows
    load = lambda c, n, t: [loosened(b.as_py(), k.as_py(), t) for b, k in zip(rows[c], rows[n])]
    contexts, degrees = load("contexts", "n_contexts", "<i8"), load("degrees", "n_contexts", "<u4")
    words, counts = load("words", "n_words", "<u4"), load("counts", "n_words", "<u4")
    keys, rank = np.unique(np.concatenate(contexts), return_inverse=True)
    full = np.repeat(rank, np.concatenate(degrees)) << 32 | np.concatenate(words).astype(np.int64)
    grams, at = np.unique(full, return_inverse=True)
    count = np.bincount(at, np.concatenate(counts), len(grams)).astype(np.int64)
    seen = count > 0
    context, word = keys[grams >> 32], grams & 0xFFFFFFFF
    trie = Trie.read(Trie.of(context[seen], word[seen], count[seen], DISCOUNT).bytes())
    where, total, kinds = trie.context(keys)
    code = trie.code(where[grams >> 32], word)[at]
    ends = np.cumsum([0, *map(len, words)])
    tops = np.cumsum([0, *map(len, contexts)])
    cut = lambda x, e, t: pa.array([squeezed(x[a:b].astype(t)) for a, b in zip(e, e[1:])], pa.binary())
    out = {"contexts": cut(total[rank], tops, "<i8"), "degrees": cut(kinds[rank], tops, "<u4"), "words": cut(code, ends, "<u2"), "counts": pa.nulls(len(rows), pa.binary())}
    for name, column in out.items():
        rows = rows.set_column(rows.schema.get_field_index(name), rows.schema.field(name), column)
    return rows


def scored(n: int, v: int):
    """For groups of one chunk: (doc_id, held_out, n_tokens, n_known, base_score, score) of its texts."""

    def run(chunk: tuple, rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("shard")
        own = next(r for r in rows.slice(len(rows) - 1).to_pylist())
        if own["doc_ids"] is None or own["shard"] is not None:
            raise RuntimeError("a chunk came back without its texts")
        rest = rows.slice(0, len(rows) - 1)
        load = lambda c, n, t: np.concatenate([loosened(b.as_py(), k.as_py(), t) for b, k in zip(rest[c], rest[n])])
        count, kinds, code = load("contexts", "n_contexts", "<i8"), load("degrees", "n_contexts", "<u4"), load("words", "n_words", "<u2")
        rank = loosened(own["contexts"], own["n_contexts"], "<u4").astype(np.int64)
        m, edge, flow = len(rank), int(rank[0]), rank[loosened(own["words"], own["n_words"], "<u4")]
        length = np.array(own["lengths"], np.int64)
        end = np.cumsum(length + 1)
        after = np.full(int(end[-1]), edge, np.int64)
        inner = np.ones(len(after), bool)
        inner[end - 1] = False
        after[inner] = flow
        before = np.r_[edge, after[:-1]]
        pairs, at = np.unique(before * m + after, return_inverse=True)
        if len(count) != m or len(code) != len(pairs):
            raise RuntimeError("a chunk came back with other answers than it asked for: its rows must come in the same order each time they are read")
        simple = (count + ADDED) / (n + ADDED * (v + 1))
        context, word = pairs // m, pairs % m
        spare = np.where(count > 0, DISCOUNT * kinds / np.maximum(count, 1), 1.0)
        p = restored(code) + spare[context] * simple[word]
        starts = end - length - 1
        total = lambda x: np.add.reduceat(x, starts)
        return pa.table({"doc_id": pa.array(own["doc_ids"], rows.schema.field("doc_ids").type.value_type), "held_out": own["held_out"], "n_tokens": length + 1, "n_known": total((count[after] > 0).astype(np.int64)), "base_score": total(np.log10(simple)[after]), "score": total(np.log10(p)[at])})

    return run


def score_texts(documents: DataFrame) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score): one row for every row of documents (doc_id, text; others are not read).

    A text without words, null included, is the one token that ends it.  Rows
    with one doc_id are rows of their own, learnt and scored each.  A null id is
    held out.  base_score is the log10 probability under P(w) alone; where
    there is nothing to learn from it and score are those of a uniform
    probability of one.  Rows must come in the same order each time they are
    read, as from files; otherwise the query stops.
    """
    out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % FOLDS == 0, F.lit(True))
    rows = batched(documents.select("doc_id", out.alias("held_out"), "text"))
    spark = documents.sparkSession
    kind = dict(documents.dtypes)["doc_id"]
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    tallies = rows.mapInArrow(word_tallies(4 * parts), "shard bigint, keys binary, counts binary")
    totals = tallies.groupBy("shard").applyInArrow(sums, "tokens bigint, words bigint").agg(F.sum("tokens").alias("n"), F.sum("words").alias("v")).first()
    n, v = totals.n or 0, totals.v or 0
    shards = max(2 * parts, -(-n // SHARD_TOKENS))
    parcel = PARCEL.format(kind=kind)
    sent = rows.mapInArrow(parcels(shards, pa_type(documents)), parcel)
    back = sent.groupBy("place").applyInArrow(answers, parcel)
    found = back.groupBy("chunk").applyInArrow(scored(n, v), f"doc_id {kind}, held_out boolean, n_tokens bigint, n_known bigint, base_score double, score double")
    return found.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(n).cast("bigint").alias("train_tokens"), "base_score", "score")


def pa_type(documents: DataFrame) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(documents.schema["doc_id"].dataType)
