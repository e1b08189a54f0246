"""Benchmark decontamination: a hash set of benchmark n-grams met by every window of the documents.

Texts are lower-cased (A-Z) and cut into words; ten consecutive words of an
item are a window, and an item of fewer words is one window.  The hashes of
all windows set a flag and a bit of two tables, which travel with the scan.
Each document is read once: its windows are hashed inside the row, and only
positions whose bits are set leave the row, with their words.  These are then
joined with the windows on the words themselves, so no collision counts.

The long table has 64 bits a window and 2**27 (16 MB) at most, the short one
2**17 flags, so their size is bounded whatever the benchmark; beyond two million
windows more positions leave their rows, and the result stays the same.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import lower_ascii, written

WINDOW = 10
#: Bits of the long table for each window, its least and largest size and the largest of the short one as powers of two, and windows up to which the confirming join broadcasts them.
BITS_EACH, LEAST_BITS, MOST_BITS, MOST_FLAGS, BROADCAST_WINDOWS = 64, 12, 27, 17, 50_000
NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words_of(text: Column) -> Column:
    """Words of a text, lower-cased; an empty array for null or a text without words."""
    return F.filter(F.split(lower_ascii(F.coalesce(text, F.lit(""))), NOT_WORD, -1), lambda w: w != "")


def benchmark_windows(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """(item, n, gram): the distinct windows of each item, as words joined by a space."""
    items = benchmark.select(F.col(id_col).alias("item"), words_of(F.col(text_col)).alias("words")).filter(F.size("words") > 0)
    n = F.least(F.size("words"), F.lit(window))
    starts = F.sequence(F.lit(1), F.size("words") - n + 1)
    return items.select("item", n.alias("n"), F.explode(F.transform(starts, lambda i: F.array_join(F.slice(F.col("words"), i, n), " "))).alias("gram")).distinct()


def tables(grams: DataFrame, n_windows: int) -> tuple[DataFrame, int]:
    """One row (flags, bits): an array of booleans and one of longs; and the power of two that is the number of bits.

    Both are put together in one task, at most 2**(MOST_BITS - 6) longs and
    2**MOST_FLAGS booleans, and sent to the scan as values of scalar subqueries, so
    the planner never sees them.
    """
    power = min(MOST_BITS, max(LEAST_BITS, (BITS_EACH * n_windows - 1).bit_length()))
    placed = written(grams.select(*places(F.xxhash64(F.split("gram", " ")), power)))

    def whole(found: DataFrame, size: int, name: str, none: Column) -> DataFrame:
        every = found.sparkSession.range(size).join(found, "id", "left").select(F.struct("id", F.coalesce("value", none).alias("value")).alias("s"))
        return every.agg(F.transform(F.array_sort(F.collect_list("s")), lambda s: s["value"]).alias(name))

    flags = whole(placed.select(F.col("flag").cast("long").alias("id")).distinct().withColumn("value", F.lit(True)), 1 << min(power, MOST_FLAGS), "flags", F.lit(False))
    bits = whole(placed.groupBy(F.shiftright("bit", 6).cast("long").alias("id")).agg(F.bit_or(bit_of(F.col("bit"))).alias("value")), 1 << (power - 6), "bits", F.lit(0).cast("long"))
    # one row each
    return written(flags.join(F.broadcast(bits))), power


def bit_of(at: Column) -> Column:
    """The word's bit that stands for a place of the long table."""
    return F.call_function("shiftleft", F.lit(1).cast("long"), at.bitwiseAND(63))


def places(h: Column, power: int) -> tuple[Column, Column]:
    """The flag and the bit of a hash, from its lower and its upper half."""
    flag = h.bitwiseAND((1 << min(power, MOST_FLAGS)) - 1)
    return flag.cast("int").alias("flag"), F.shiftrightunsigned(h, 32).bitwiseAND((1 << power) - 1).cast("int").alias("bit")


def scan(rows: DataFrame, sizes: list[int], known_tables: DataFrame, power: int) -> DataFrame:
    """row, kept, n_words and hits: (start, n, gram) of the windows whose flag and bit are set."""
    rows = rows.withColumns({"flags": known_tables.select("flags").scalar(), "bits": known_tables.select("bits").scalar()})
    none = F.array().cast("array<struct<start:int,n:int,gram:string>>")

    def way(n: int) -> Column:
        def known(i: Column) -> Column:
            flag, bit = places(F.xxhash64(F.slice("words", i, F.lit(n))), power)
            # the bit is asked for only where the flag is set
            return F.get("flags", flag) & (F.get("bits", F.shiftright(bit, 6)).bitwiseAND(bit_of(bit)) != 0)

        def spoken(i: Column) -> Column:
            return F.struct(i.alias("start"), F.lit(n).alias("n"), F.array_join(F.slice("words", i, F.lit(n)), " ").alias("gram"))

        starts = F.filter(F.sequence(F.lit(1), F.size("words") - (n - 1)), known)
        return F.when(F.size("words") >= n, F.transform(starts, spoken)).otherwise(none)

    ways = [way(n) for n in sizes]
    return rows.select("row", "kept", F.size("words").cast("long").alias("n_words"), (F.concat(*ways) if len(ways) > 1 else ways[0] if ways else none).alias("hits"))


def covered(spans: Column) -> Column:
    """How many words a sorted array of (start, n) covers."""
    zero = F.struct(F.lit(0).cast("long").alias("sum"), F.lit(0).alias("end"))
    step = lambda a, s: F.struct(
        (a["sum"] + F.greatest(F.lit(0), s["start"] + s["n"] - F.greatest(s["start"], a["end"]))).cast("long").alias("sum"),
        F.greatest(a["end"], s["start"] + s["n"]).alias("end"),
    )
    return F.aggregate(spans, zero, step, lambda a: a["sum"])


def judged(documents: DataFrame, benchmark: DataFrame, keep: Column, text_col: str, item_col: str, window: int) -> DataFrame:
    """kept (the column ``keep``), n_words, n_hit, spans and items for each row of ``documents``."""
    grams = benchmark_windows(benchmark, item_col, "text", window)
    sizes = {r["n"]: r["count"] for r in grams.select("n", "gram").distinct().groupBy("n").count().collect()}
    n_windows = sum(sizes.values())
    # the row number is written with the rows, so it stays as it is whoever reads them again
    rows = documents.select(F.monotonically_increasing_id().alias("row"), keep.alias("kept"), words_of(F.col(text_col)).alias("words"))
    seen = written(scan(rows, sorted(sizes), *tables(grams, n_windows)))
    lookup = grams.select("item", "gram")
    if n_windows <= BROADCAST_WINDOWS:
        lookup = F.broadcast(lookup)
    hits = (
        seen.filter(F.size("hits") > 0)
        .select("row", F.explode("hits").alias("hit"))
        .select("row", "hit.start", "hit.n", "hit.gram")
        .join(lookup, "gram")
        .groupBy("row")
        .agg(F.array_sort(F.collect_set(F.struct("start", "n"))).alias("spans"), F.array_sort(F.collect_set(F.col("item").cast("string"))).alias("items"))
    )
    return seen.drop("hits").join(hits, "row", "left").select(
        "kept",
        "n_words",
        F.coalesce(covered(F.col("spans")), F.lit(0).cast("long")).alias("n_hit"),
        F.coalesce("spans", F.array().cast("array<struct<start:int,n:int>>")).alias("spans"),
        F.coalesce("items", F.array().cast("array<string>")).alias("items"),
    )


def contamination(documents: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", window: int = WINDOW) -> DataFrame:
    """(id, n_words, n_hit, spans, items): one row for each document.

    spans: (start, n) of every occurrence, words counted from 1; items: the
    distinct item ids as sorted strings.  Null texts and texts without words
    have no spans; items without words have no window, and a null item id is
    not listed; repeated rows are each reported; an empty benchmark leaves
    every document clean.  Other columns are not read.
    """
    found = judged(documents, benchmark, F.col(id_col), text_col, item_col, window)
    return found.select(F.col("kept").alias(id_col), "n_words", "n_hit", "spans", "items")


def remove_contaminated(documents: DataFrame, benchmark: DataFrame, *, text_col: str = "text", item_col: str = "item_id", mode: str = "documents", window: int = WINDOW) -> DataFrame:
    """``documents``, all columns, without what the benchmark holds: contaminated rows go, or with mode ``spans`` only the hit words.

    With ``spans`` a contaminated text becomes its other words, lower-cased and joined by a space; clean texts stay as they are.
    """
    if mode not in ("documents", "spans"):
        raise ValueError(f"mode is documents or spans, not {mode}")
    found = judged(documents, benchmark, F.struct(*documents.columns), text_col, item_col, window)
    if mode == "documents":
        return found.filter("n_hit = 0").select("kept.*")
    # positions of hit words as one set, so a word is not held against every span
    hit = F.flatten(F.transform("spans", lambda s: F.sequence(s["start"], s["start"] + s["n"] - 1)))
    left = F.array_except(F.sequence(F.lit(1), F.col("n_words").cast("int")), hit)
    rest = F.array_join(F.transform(left, lambda k: F.get(F.col("words"), k - 1)), " ")
    found = found.withColumn("words", words_of(F.col("kept")[text_col]))
    return found.select(*[F.when(F.col("n_hit") > 0, rest).otherwise(F.col("kept")[c]).alias(c) if c == text_col else F.col("kept")[c].alias(c) for c in documents.columns])
