"""Near-duplicates by SimHash, linked through BK-trees.

A fingerprint bit is set where over half of a text's shingle hashes have it.
Fingerprints that differ in two bits or fewer share at least two of any four
bands of their bits.  So the distinct fingerprints are sharded by pairs of
bands; a shard that is too large is sharded again by pairs of bands of the
bits still free (64, then 32, then 16), until after three levels at most 256
fingerprints can differ.  Every shard is thus small, however many texts look
alike, and no link is lost.  A BK-tree stands for each shard; every member
follows only the edges within the radius, and is tied to one member of its
part of the shard, so no shard gives more rows than it has members.

The trees are made and searched where their shard is, by a shuffle: a
broadcast of all trees would grow with the corpus.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, written

SHINGLE, RADIUS, SEED = 3, 2, 42
#: Fingerprints in a shard; above it, it is sharded by the next level's bands.
SHARD = 512
#: Levels of 64, 32 and 16 free bits; each is cut into four bands, of which two are held equal.
LEVELS = 3
LINES = 1 << 15


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    words = (text or "").encode("utf-8", "replace").lower().split()
    if not words:
        return 0
    grams = map(b" ".join, zip(*(words[i:] for i in range(shingle)))) if len(words) >= shingle else iter([b" ".join(words)])
    n, ones = 0, np.zeros(64, np.int64)
    while len(h := np.fromiter((xxhash.xxh64_intdigest(g, SEED) for _, g in zip(range(LINES), grams)), np.uint64)):
        n += len(h)
        ones += np.unpackbits(h.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
        if len(h) < LINES:
            break
    return int(np.packbits(2 * ones > n, bitorder="little").view("<i8")[0])


def fingerprints(text: Column, shingle: int = SHINGLE) -> Column:
    """The fingerprint as a signed long. bytes.lower() and bytes.split() know A-Z and the six white-space bytes only."""

    @F.arrow_udf("bigint")
    def of(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield pa.array([fingerprint(t.as_py(), shingle) for t in batch], pa.int64())

    return of(text)


class BKTree:
    """Children are keyed by their Hamming distance to the parent."""

    def __init__(self) -> None:
        self.values: list[int] = []
        self.children: list[dict[int, int]] = []

    def add(self, value: int) -> None:
        self.values.append(value)
        self.children.append({})
        at, new = 0, len(self.values) - 1
        while new:
            distance = (self.values[at] ^ value).bit_count()
            if distance not in self.children[at]:
                self.children[at][distance] = new
                return
            at = self.children[at][distance]

    def within(self, value: int, radius: int) -> list[int]:
        """Positions of the members that differ from value in ``radius`` bits or fewer."""
        found, todo = [], [0] if self.values else []
        while todo:
            at = todo.pop()
            distance = (self.values[at] ^ value).bit_count()
            if distance <= radius:
                found.append(at)
            children = self.children[at]
            for edge in range(distance - radius, distance + radius + 1):
                if (child := children.get(edge)) is not None:
                    todo.append(child)
        return found


def ties(members: list[int], radius: int = RADIUS) -> list[tuple[int, int]]:
    """(member, first member of its part) for the parts that the links within the radius make; members that are alone are left out."""
    tree, part = BKTree(), []

    def top(i: int) -> int:
        while part[i] != i:
            part[i] = part[part[i]]
            i = part[i]
        return i

    for k, value in enumerate(members):
        part.append(k)
        for other in tree.within(value & (2**64 - 1), radius):
            a, b = top(other), top(k)
            part[max(a, b)] = min(a, b)
        tree.add(value & (2**64 - 1))
    return [(members[k], members[top(k)]) for k in range(len(members)) if top(k) != k]


def signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def band_pairs(fixed: list[tuple[int, int]], free: list[tuple[int, int]]) -> list[tuple[list[tuple[int, int]], list[tuple[int, int]]]]:
    """The ways to fix two of the four bands of the free bits: (bits that are fixed, bits still free), as (shift, width)."""
    bits = [(s + i, 1) for s, w in free for i in range(w)]
    size = len(bits) // 4
    bands = [bits[i * size : (i + 1) * size] for i in range(4)]
    return [(fixed + bands[a] + bands[b], [x for c in range(4) if c not in (a, b) for x in bands[c]]) for a, b in combinations(range(4), 2)]


def links(distinct: DataFrame, radius: int = RADIUS, shard: int = SHARD) -> DataFrame:
    """(a, b): ties between distinct fingerprints (column fp) whose connected parts are those of all links within the radius, 0 to 2."""
    if radius > 2:
        raise ValueError("two of four bands are sure to be equal up to a radius of 2")
    rows, found = distinct.select(F.lit("").alias("way"), "fp"), None
    plans = {"": ([], [(i, 1) for i in range(64)])}
    for level in range(LEVELS):
        plans = {f"{way}{i}": option for way, (fixed, free) in plans.items() for i, option in enumerate(band_pairs(fixed, free))}
        masks = F.create_map(*[F.lit(x) for way, (fixed, _) in plans.items() for x in (way, signed(sum(1 << bit for bit, _ in fixed)))])
        keyed = rows.select("fp", F.explode(F.array(*[F.concat("way", F.lit(str(i))) for i in range(6)])).alias("way")).withColumn("key", F.col("fp").bitwiseAND(masks[F.col("way")]))
        sized = keyed.join(keyed.groupBy("way", "key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"), ["way", "key"])
        last = level == LEVELS - 1
        shards = (sized if last else sized.filter(F.col("n") <= shard)).groupBy("way", "key").agg(F.array_sort(F.collect_list("fp")).alias("members"))
        tied = shards.select(F.explode(tie_members(F.col("members"), radius)).alias("t")).select("t.a", "t.b")
        found = tied if found is None else found.unionByName(tied)
        if not last:
            rows = cut(sized.filter(F.col("n") > shard).select("way", "fp"))
            if rows.isEmpty():
                break
    return found.distinct()


def tie_members(members: Column, radius: int) -> Column:
    @F.arrow_udf("array<struct<a:bigint,b:bigint>>")
    def tie(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        kind = pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())]))
        for batch in batches:
            yield pa.array([[{"a": a, "b": b} for a, b in ties(m, radius)] for m in batch.to_pylist()], kind)

    return tie(members)


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, root): the smallest node that each node of the edges (a, b) reaches.

    Large-star and small-star rounds until nothing changes; each round is
    written as a table, so the next is planned by its size and not by what went before.  A node's smallest neighbour is found by
    an aggregate with partial sums, so a node with very many edges needs no
    single task.
    """
    pairs = written(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct())
    before = None
    for _ in range(rounds):
        both = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
        large = both.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        pairs = written(large.join(least, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.greatest("v", "m").alias("u"), F.least("v", "m").alias("v")))).alias("e")).select("e.u", "e.v").filter("u <> v").distinct())
        now = tuple(pairs.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        # nothing moves any more, and every node hangs on one root
        if now == before and pairs.select("u").distinct().count() == now[0]:
            break
        before = now
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return pairs.select(F.col("u").alias("node"), F.col("v").alias("root"))


def near_duplicates(documents: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, radius: int = RADIUS, shard: int = SHARD) -> DataFrame:
    """(id, fp, root, component_id): one row for each document.

    fp is the signed fingerprint, root the smallest fingerprint that its links
    reach, component_id the smallest id of all rows there (null only where all
    ids are null).  Null texts and texts without words have fingerprint zero
    and are linked like any other; repeated rows and repeated ids stay as rows
    of their own; other columns are not read.
    """
    marked = cut(documents.select(F.col(id_col).alias(id_col), fingerprints(F.col(text_col), shingle).alias("fp")))
    classes = cut(marked.groupBy("fp").agg(F.min(id_col).alias("least")))
    roots = components(links(classes.select("fp"), radius, shard))
    rooted = classes.join(roots, classes["fp"] == roots["node"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    return marked.join(rooted.join(least, "root").select("fp", "root", "component_id"), "fp").select(id_col, "fp", "root", "component_id")


def keep_one_of_each(documents: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """All columns of one row for each component: the row with the smallest id (a null id only if all are null).

    Where that id stands in several rows of the table, the row with the
    smallest fingerprint, then the smallest row as JSON, stays.
    """
    found = near_duplicates(documents, id_col=id_col, text_col=text_col, shingle=shingle, radius=radius)
    return one_of_each(documents, found, lambda text: fingerprints(text, shingle), id_col=id_col, text_col=text_col)


def one_of_each(documents: DataFrame, found: DataFrame, print_of: Callable[[Column], Column], *, id_col: str, text_col: str) -> DataFrame:
    """The rows that keep_one_of_each() keeps, by found (id, fp, root, component_id) and the function that makes fp."""
    found = found.withColumnRenamed(id_col, "id")
    picked = written(found.filter(F.col("id").eqNullSafe(F.col("component_id"))).groupBy("root").agg(F.min(F.struct("id", "fp")).alias("p")).select("root", "p.id", "p.fp"))
    repeated = written(found.groupBy("id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1 or id is null").select(F.col("id").alias("again")))
    rows = documents.select(F.col(id_col).alias("id"), F.struct(*documents.columns).alias("row"))
    alone = rows.join(picked.join(repeated, F.col("id").eqNullSafe(F.col("again")), "left_anti").select("id"), "id", "left_semi").select("row")
    if repeated.isEmpty():
        return alone.select("row.*")
    unsure = rows.join(repeated, F.col("id").eqNullSafe(F.col("again")), "left_semi").withColumn("fp", print_of(F.col("row")[text_col]))
    named = picked.select("root", F.col("id").alias("picked_id"), F.col("fp").alias("picked_fp"))
    of_root = unsure.join(named, F.col("id").eqNullSafe(F.col("picked_id")) & (F.col("fp") == F.col("picked_fp")))
    return alone.unionByName(of_root.groupBy("root").agg(F.min_by("row", F.to_json("row")).alias("row")).select("row")).select("row.*")
