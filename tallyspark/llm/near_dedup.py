"""SimHash near-dedup at a similarity of 0.8 over five-word shingles, as the corpus pipeline runs it.

Two texts at a Jaccard similarity of 0.8 differ in about ten of 64 SimHash
bits, so bands of the fingerprint's own bits cannot bring them together.  Here
MinHash bands choose the shards: a pair at NEAR shares one of them with
probability 1 - (1 - NEAR**ROWS)**BANDS, over 0.99998.  Inside a shard a
BK-tree of the SimHash fingerprints proposes pairs, following only edges
within RADIUS bits (a pair at NEAR lies beyond it about once in a million), and
a pair counts only if its exact Jaccard similarity is NEAR or more.

Texts with the same shingle set are one class.  In every shard each class is
first held against the smallest and the largest one.  Only shards whose classes
are still apart after that grow trees, and only classes outside the shard's
largest part search them.  A small shard gives its proposals as rows.  A larger
one is cut into blocks that carry the shingle sets with them, so that proposals
are confirmed where they are made and a class gives one row for each part it is
tied to, however many classes are alike.  The classes of very large shards are
sharded again by their rarest shingles, which loses no pair at NEAR.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import batched, slices, written
from .simhash import BKTree, components, one_of_each

SHINGLE, NEAR, SEED = 5, 0.8, 42
BANDS, ROWS = 28, 5
#: Bits in which fingerprints of a proposed pair may differ, and classes of a shard that gives its proposals as rows.
RADIUS, SMALL = 24, 32
#: Classes and shingles of a block at most, and blocks above which a shard is sharded again.
SHARD, GRAMS, BLOCKS = 512, 2_000_000, 16
#: Shingles hashed at once; bounds the memory of a long text.
CHUNK = 1 << 11
_RANDOM = np.random.default_rng(SEED).integers(0, 1 << 64, (2, BANDS * ROWS, 1), np.uint64)
TIMES, PLUS = _RANDOM[0] | np.uint64(1), _RANDOM[1]


def grams(text: str | None) -> np.ndarray:
    """Sorted distinct hashes of the shingles; a shorter text is one shingle, a text without words has none."""
    words = (text or "").encode("utf-8", "replace").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    runs = map(b" ".join, zip(*(words[i:] for i in range(SHINGLE)))) if len(words) >= SHINGLE else iter([b" ".join(words)])
    return np.unique(np.fromiter((xxhash.xxh64_intdigest(g, SEED) for g in runs), np.uint64))


def signed(h: int) -> int:
    return h - (1 << 64) if h >> 63 else h


def sketch(text: str | None) -> tuple[int, int, int, list[int]]:
    """Digest of the shingle set, its size, its SimHash fingerprint and the keys of its bands."""
    h = grams(text)
    if not len(h):
        return 0, 0, 0, []
    low, ones = np.full(BANDS * ROWS, 2**64 - 1, np.uint64), np.zeros(64, np.int64)
    for a in range(0, len(h), CHUNK):
        part = h[a : a + CHUNK]
        np.minimum(low, (part[None] * TIMES + PLUS).min(1), out=low)
        ones += np.unpackbits(part.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    keys = [signed(xxhash.xxh64_intdigest(band.tobytes(), k)) for k, band in enumerate(low.reshape(BANDS, ROWS))]
    return signed(xxhash.xxh64_intdigest(h.tobytes(), SEED)), len(h), int(np.packbits(2 * ones > len(h), bitorder="little").view("<i8")[0]), keys


def digest(text: Column) -> Column:
    @F.arrow_udf("bigint")
    def of(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield pa.array([sketch(t.as_py())[0] for t in batch], pa.int64())

    return of(text)


def sketches(text: Column) -> Column:
    kind = pa.struct([("fp", pa.int64()), ("n", pa.int64()), ("sim", pa.int64()), ("bands", pa.list_(pa.int64()))])

    @F.arrow_udf("struct<fp:bigint,n:bigint,sim:bigint,bands:array<bigint>>")
    def of(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in slices(batches):
            yield pa.array([dict(zip(("fp", "n", "sim", "bands"), sketch(t.as_py()))) for t in batch], kind)

    return of(text)


def gram_sets(text: Column) -> Column:
    """Digest and shingles of a text. Not called deterministic, or a join on the digest would make the sets of all texts twice, in two workers a task."""
    kind = pa.struct([("fp", pa.int64()), ("grams", pa.binary())])

    @F.arrow_udf("struct<fp:bigint,grams:binary>")
    def of(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in slices(batches):
            found = (grams(t.as_py()) for t in batch)
            yield pa.array([{"fp": signed(xxhash.xxh64_intdigest(h.tobytes(), SEED)) if len(h) else 0, "grams": h.tobytes()} for h in found], kind)

    return of.asNondeterministic()(text)


def listed(sets: Column) -> Column:
    """The shingles of a set of gram_sets() as an array of signed longs."""

    @F.arrow_udf("array<bigint>")
    def of(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in slices(batches):
            yield pa.array([np.frombuffer(x.as_py(), np.int64) for x in batch], pa.list_(pa.int64()))

    return of(sets)


def similarity(a: Column, b: Column) -> Column:
    """Jaccard similarity of two sets of gram_sets()."""

    @F.arrow_udf("double")
    def of(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for left, right in batches:
            out = []
            for x, y in zip(left, right):
                u, v = (np.frombuffer(z.as_py(), np.uint64) for z in (x, y))
                both = len(np.intersect1d(u, v, assume_unique=True))
                out.append(both / (len(u) + len(v) - both))
            yield pa.array(out, pa.float64())

    return of(a, b)


def tree_pairs(members: list[dict], radius: int = RADIUS) -> list[tuple[int, int]]:
    """(a, b), a below b, of a shard's classes (fp, sim, root) with different roots whose fingerprints lie within the radius.

    Every pair of different roots has a class outside the most common root, so only those search the tree.
    """
    tree, main = BKTree(), Counter(m["root"] for m in members).most_common(1)[0][0]
    for m in members:
        tree.add(m["sim"] & (2**64 - 1))
    out = set()
    for m in members:
        if m["root"] != main:
            near = (members[k] for k in tree.within(m["sim"] & (2**64 - 1), radius))
            out.update((min(m["fp"], o["fp"]), max(m["fp"], o["fp"])) for o in near if o["root"] != m["root"])
    return sorted(out)


def proposals(members: Column) -> Column:
    kind = pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())]))

    @F.arrow_udf("array<struct<a:bigint,b:bigint>>")
    def of(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in slices(batches):
            yield pa.array([[{"a": a, "b": b} for a, b in tree_pairs(m)] for m in batch.to_pylist()], kind)

    return of(members)


def block_ties(rows: list[dict]) -> list[tuple[int, int]]:
    """(a, b): for each searching class of a block a class of each other root whose set is at NEAR or above.

    The block's tree says which classes lie within RADIUS; their common
    shingles are counted through lists of the classes that hold a shingle.
    """
    held, asking = [r for r in rows if not r["asks"]], [r for r in rows if r["asks"]]
    if not held or not asking:
        return []
    tree = BKTree()
    for r in held:
        tree.add(r["sim"] & (2**64 - 1))
    sets = [np.frombuffer(r["grams"], np.uint64) for r in held]
    sizes = np.array([len(x) for x in sets])
    known, place = np.unique(np.concatenate(sets), return_inverse=True)
    holder = np.repeat(np.arange(len(held)), sizes)[np.argsort(place, kind="stable")]
    ends = np.append(0, np.cumsum(np.bincount(place, minlength=len(known))))
    out = []
    for r in asking:
        near = [k for k in tree.within(r["sim"] & (2**64 - 1), RADIUS) if held[k]["root"] != r["root"]]
        if not near:
            continue
        mine = np.frombuffer(r["grams"], np.uint64)
        at = np.searchsorted(known, mine)
        at = at[(at < len(known)) & (known[np.minimum(at, len(known) - 1)] == mine)]
        both = np.bincount(np.concatenate([holder[ends[i] : ends[i + 1]] for i in at] or [np.zeros(0, np.int64)]), minlength=len(held))
        alike = both / (len(mine) + sizes - both)
        out += {held[k]["root"]: (r["fp"], held[k]["fp"]) for k in near if alike[k] >= NEAR}.values()
    return out


def confirmed_inside(rows: Column) -> Column:
    kind = pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())]))

    @F.arrow_udf("array<struct<a:bigint,b:bigint>>")
    def of(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in slices(batches, 1):
            yield pa.array([[{"a": a, "b": b} for a, b in block_ties(m)] for m in batch.to_pylist()], kind)

    return of(rows)


def confirmed(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) whose sets are at NEAR or above."""
    rows = pairs.join(sets.select(F.col("fp").alias("a"), F.col("grams").alias("x")), "a").join(sets.select(F.col("fp").alias("b"), F.col("grams").alias("y")), "b")
    return written(batched(rows).filter(similarity(F.col("x"), F.col("y")) >= NEAR).select("a", "b"))


def fitting(n: str, other: str) -> Column:
    """Whether two sizes allow a similarity of NEAR."""
    return F.least(n, other) >= F.lit(NEAR) * F.greatest(n, other)


def mixed(rows: DataFrame) -> DataFrame:
    """The rows (key, fp, sim, n, root) of the shards that hold more than one root, with the shard's size, its most common root, and the numbers of blocks of its classes and of those with another root."""
    parts = rows.groupBy("key", "root").agg(F.count(F.lit(1)).alias("k"), F.sum("n").alias("n"))
    apart = parts.groupBy("key").agg(F.sum("k").alias("size"), F.sum("n").alias("grams"), F.max(F.struct("k", "root")).alias("m"), F.count(F.lit(1)).alias("roots")).filter("roots > 1")
    blocks = F.ceil(F.greatest(F.col("size") / SHARD, F.col("grams") / GRAMS)).cast("int")
    asking = F.ceil((F.col("size") - F.col("m.k")) * blocks / F.col("size")).cast("int")
    return written(rows.join(apart.select("key", "size", F.col("m.root").alias("main"), blocks.alias("blocks"), asking.alias("asking")), "key"))


def ordered(pairs: DataFrame) -> DataFrame:
    """(a, b), a below b, of the pairs (fp, n, other, other_n) whose sizes allow NEAR."""
    return pairs.filter((F.col("fp") != F.col("other")) & fitting("n", "other_n")).select(F.least("fp", "other").alias("a"), F.greatest("fp", "other").alias("b"))


def in_blocks(rows: DataFrame, sets: DataFrame) -> DataFrame:
    """(a, b): the confirmed ties of rows of mixed(): every block of a shard's classes meets every block of those outside its main part."""
    deal = lambda n: F.pmod(F.xxhash64("fp"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    one = ["key", "fp", "sim", "root"]
    held = rows.select(*one, deal("blocks").alias("block"), every("asking").alias("ask"), F.lit(False).alias("asks"))
    asking = rows.filter("root <> main").select(*one, every("blocks").alias("block"), deal("asking").alias("ask"), F.lit(True).alias("asks"))
    full = held.unionByName(asking).join(sets, "fp")
    groups = full.groupBy("key", "block", "ask").agg(F.collect_list(F.struct("fp", "sim", "root", "asks", "grams")).alias("rows"))
    return batched(groups).select(F.explode(confirmed_inside(F.col("rows"))).alias("t")).select("t.a", "t.b")


def by_rare_grams(rows: DataFrame, sets: DataFrame) -> DataFrame:
    """The classes of rows of mixed() as rows (key, fp, sim, n, root) of other shards, of which two classes at NEAR share one at least.

    All classes order their shingles alike, those in the fewest classes first.
    Of n shingles a class at NEAR holds NEAR * n at least, so the first of those
    that two such classes share is among the first n - NEAR * n + 1 of both.
    Shingles of one class alone come before all others and make no shard.
    """
    pool = rows.select("fp", "sim", "n", "root").distinct()
    every = batched(pool.select("fp").join(sets, "fp")).select("fp", F.explode(listed(F.col("grams"))).alias("gram"))
    shared = every.join(every.groupBy("gram").agg(F.count(F.lit(1)).alias("k")).filter("k > 1"), "gram")
    ranked = shared.groupBy("fp").agg(F.array_sort(F.collect_list(F.struct("k", "gram"))).alias("of")).join(pool, "fp")
    first = F.floor(F.col("n") * (1 - NEAR) + 1e-6) + 1 - (F.col("n") - F.size("of"))
    return ranked.select("fp", "sim", "n", "root", F.explode(F.slice("of", 1, F.greatest(first, F.lit(0)).cast("int"))).alias("g")).select(F.xxhash64("g.gram").alias("key"), "fp", "sim", "n", "root")


def remaining(rows: DataFrame, classes: DataFrame, sets: DataFrame, known: DataFrame) -> DataFrame:
    """The confirmed ties (a, b) between the different roots of the shards of mixed(), without the pairs ``known``."""
    again = (F.col("blocks") > BLOCKS) & (F.col("asking") > 1)
    if not (large := rows.filter(again)).isEmpty():
        rows = rows.filter(~again).unionByName(mixed(by_rare_grams(large, sets)))
    small = rows.filter(F.col("size") <= SMALL).groupBy("key").agg(F.collect_list(F.struct("fp", "sim", "root")).alias("members"))
    pairs = batched(small).select(F.explode(proposals(F.col("members"))).alias("t")).select("t.a", "t.b").distinct()
    sizes = classes.select("fp", "n")
    pairs = pairs.join(sizes.withColumnsRenamed({"fp": "a", "n": "n_a"}), "a").join(sizes.withColumnsRenamed({"fp": "b", "n": "n_b"}), "b")
    found = confirmed(pairs.filter(fitting("n_a", "n_b")).select("a", "b").join(known, ["a", "b"], "left_anti"), sets)
    return written(found.unionByName(in_blocks(rows.filter(F.col("size") > SMALL), sets)))


def sets_of(texts: DataFrame, nodes: DataFrame) -> DataFrame:
    """(fp, grams): the shingles of each class of nodes (fp, least), from the texts (id, body) whose ids are the classes' least."""
    wanted = texts.join(nodes.select(F.col("least").alias("id")).distinct(), "id", "left_semi").unionByName(texts.filter("id is null"))
    sets = batched(wanted).select(gram_sets(F.col("body")).alias("s")).select("s.fp", "s.grams").join(nodes.select("fp"), "fp", "left_semi")
    return sets.groupBy("fp").agg(F.first("grams").alias("grams"))


def near_duplicates(documents: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp, root, component_id) as in simhash.near_duplicates; fp is the digest of the shingle set.

    Null texts and texts without words are one class.  Repeated rows and
    repeated ids stay as rows of their own; other columns are not read; an
    empty table gives no rows.
    """
    marked = written(batched(documents).select(F.col(id_col).alias(id_col), sketches(F.col(text_col)).alias("s")).select(id_col, "s.*"))
    classes = written(marked.groupBy("fp").agg(F.min(id_col).alias("least"), F.first("n").alias("n"), F.first("sim").alias("sim"), F.first("bands").alias("bands")))
    keyed = classes.select("fp", "n", "sim", F.explode("bands").alias("key"))
    ends = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("k"), F.min(F.struct("fp", "n")).alias("lo"), F.max(F.struct("fp", "n")).alias("hi")).filter("k > 1").drop("k")
    rows = written(keyed.join(ends, "key"))
    nodes = written(rows.select("fp").distinct().join(classes.select("fp", "least"), "fp"))
    sets = written(sets_of(documents.select(F.col(id_col).alias("id"), F.col(text_col).alias("body")), nodes))
    star = rows.select("fp", "n", F.explode(F.array("lo", "hi")).alias("o")).select("fp", "n", F.col("o.fp").alias("other"), F.col("o.n").alias("other_n"))
    first = written(ordered(star).distinct())
    tied = confirmed(first, sets)

    roots = components(tied)
    placed = rows.select("key", "fp", "sim", "n").join(roots.withColumnRenamed("node", "fp"), "fp", "left")
    last = remaining(mixed(placed.select("key", "fp", "sim", "n", F.coalesce("root", "fp").alias("root"))), classes, sets, first)
    if not last.isEmpty():
        # the late ties join whole parts, so only the parts' roots are nodes of the second graph
        to = lambda c: roots.select(F.col("node").alias(c), F.col("root").alias(f"root_{c}"))
        parts = last.join(to("a"), "a", "left").join(to("b"), "b", "left").select(F.coalesce("root_a", "a").alias("a"), F.coalesce("root_b", "b").alias("b"))
        joined = components(parts)
        moved = roots.join(joined.select(F.col("node").alias("root"), F.col("root").alias("top")), "root", "left").select("node", F.coalesce("top", "root").alias("root"))
        roots = written(moved.unionByName(joined.join(roots.select("node"), "node", "left_anti")))
    rooted = classes.select("fp", "least").join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    return marked.select(id_col, "fp").join(rooted.join(least, "root").select("fp", "root", "component_id"), "fp").select(id_col, "fp", "root", "component_id")


def keep_one_of_each(documents: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All columns of one row for each component, chosen as in simhash.keep_one_of_each."""
    return one_of_each(documents, near_duplicates(documents, id_col=id_col, text_col=text_col), digest, id_col=id_col, text_col=text_col)
