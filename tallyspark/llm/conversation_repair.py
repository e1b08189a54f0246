"""Conversations brought back into shape: the cheapest edits after which the roles read (s?(ua)+)?.

A turn is kept (0), rerolled to user or assistant (2) or deleted (3; blank and
repeated turns always), an empty user or assistant turn is inserted (2), and a
truncated turn that stays adds 1.  The dynamic programme runs over the turns
that stay: the edits between two of them are the deletions in the gap, priced
as a difference of prefix sums, and the inserts that their pair of roles asks
for.  Going backwards, the best continuation of every turn is therefore a
running minimum for each role that the next retained turn may have, so a
conversation takes one pass and a few numbers.

Equal costs are settled by the audit, the initials of the edits in order, the
least in ASCII: in a gap deletions come before inserts, a longer run of
deletions comes before a shorter one, an insert before a kept turn, a kept
before a rerolled one.  No other case arises: the letters and the roles
that went before fix what each letter did.

In Spark a conversation's rows come to one task in order twice, first
backwards with roles and faults alone, then forwards with their texts: the
task keeps some thirty bytes a turn and the audit, never the texts, so a
conversation may be longer than memory.  Repeats are found by a join on digests before
that, so no set of what was seen is kept either.  The digest of a conversation
runs over its texts in order, which one task has to do.
"""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import batched

KEEP, REROLE, DELETE, INSERT, STUB = 0, 2, 3, 2, 1
DAMAGES = 20
#: Characters that are no white space, as a class of a pattern.
SOLID = r"[^\x20\x09-\x0D]"
START, S, U, A = range(4)
INITIAL = {"s": S, "u": U, "a": A}
NAMES = {U: "user", A: "assistant"}
#: The roles that may stand next after each state without an insert, and the role that an insert puts there.
NEXT = {START: (S, U), S: (U,), U: (A,), A: (U,)}
INSERTED = {START: U, S: U, U: A, A: U}
#: Inserts that end a conversation rightly.
CLOSING = {START: "", S: "II", U: "I", A: ""}
#: Letters from one retained turn to the next, its own included, with the role it has there; START stands for the end.
WAYS = [("", START), ("I", START), ("II", START), *[(i + letter, role) for i in ("", "I") for letter in "KR" for role in (S, U, A)]]


def damaged(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, copies): each row after the fault that crc32(conv_id:turn) deals it; copies is 0 for a dropped row, 2 for a repeated one.

    Nulls of role and text, and in the checksum of either number, are one space.
    """
    known = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    fault = F.crc32(F.concat(known("conv_id"), F.lit(":"), known("turn")).cast("binary")) % DAMAGES
    return conversations.select(
        "conv_id",
        "turn",
        F.when(fault == 4, "user").otherwise(known("role")).alias("role"),
        F.when(fault == 1, "").when(fault == 2, F.regexp_replace(known("text"), "[.!?]", "")).otherwise(known("text")).alias("text"),
        F.when(fault == 0, 0).when(fault == 3, 2).otherwise(1).alias("copies"),
    )


class Costs:
    """The backward pass of one conversation: fed from the last turn to the first."""

    def __init__(self) -> None:
        self.turns: list[tuple[int, int]] = []
        #: For each role of the next retained turn: (cost from it on, with the deletions before it counted from the end, which turn it is).
        self.best: dict[int, tuple[int, int, str]] = {}
        self.gone = 0
        #: For each turn and each role it may have: the next retained turn, and which of WAYS leads there.
        self.to, self.way = array("q"), bytearray()

    def ahead(self, state: int) -> tuple[int, int, str, int]:
        """(cost, turn, letters, role): the cheapest way on from a state, past all turns fed so far; turn -1 is the end."""
        close = CLOSING[state]
        # all that is left goes: the longest run of deletions, so ties fall to it
        found = (self.gone + INSERT * len(close), -1, close, START)
        for role, (cost, at, letter) in self.best.items():
            if role in NEXT[state]:
                letters = letter
            elif role in NEXT[INSERTED[state]]:
                letters = "I" + letter
            else:
                continue
            # self.gone - (deletions from the turn on) prices the gap
            total = self.gone + cost + INSERT * (len(letters) - 1)
            if total < found[0] or total == found[0] and found[1] >= 0 and (at < found[1] or at == found[1] and letters < found[2]):
                found = (total, at, letters, role)
        return found

    def feed(self, initial: str, banned: bool, stub: bool) -> None:
        """The next turn towards the beginning."""
        at, after = len(self.way) // 3, {}
        to, way = [-1, -1, -1], [0, 0, 0]
        if not banned:
            own = INITIAL.get(initial)
            for role in (S, U, A):
                if role == own or role != S:
                    letter = "K" if role == own else "R"
                    cost, to[role - 1], letters, next_role = self.ahead(role)
                    way[role - 1] = WAYS.index((letters, next_role))
                    after[role] = (cost + (KEEP if letter == "K" else REROLE) + STUB * stub, letter)
        self.gone += DELETE
        for role, (cost, letter) in after.items():
            relative = cost - self.gone
            now = self.best.get(role)
            # turns are numbered from the end: of equal costs the later turn stays
            if now is None or relative < now[0]:
                self.best[role] = (relative, at, letter)
        self.to.extend(to)
        self.way.extend(way)

    def audit(self) -> tuple[int, str]:
        """(cost, audit) of the whole conversation."""
        cost, to, letters, role = self.ahead(START)
        out, at = [], len(self.way) // 3
        while True:
            out.append("D" * (at - to - 1) + letters)
            if to < 0:
                return cost, "".join(out)
            at, slot = to, 3 * to + role - 1
            to, (letters, role) = self.to[slot], WAYS[self.way[slot]]


class Conversation:
    """What two passes over one conversation leave."""

    def __init__(self) -> None:
        self.costs, self.faults = Costs(), [0, 0, 0]
        self.low = self.high = None
        self.distinct = self.illegal = 0
        self.later = self.last_turn = None
        self.digest, self.edits, self.at, self.state, self.begun = hashlib.sha256(), None, 0, START, False

    def back(self, turn: int | None, initial: str, blank: bool, repeated: bool, stub: bool) -> None:
        if turn is not None and turn != self.last_turn:
            self.high = turn if self.high is None else self.high
            self.low = self.last_turn = turn
            self.distinct += 1
        self.illegal += self.later is not None and initial + self.later not in ("su", "ua", "au")
        self.later = initial
        fault = 0 if blank else 1 if repeated else 2 if stub else None
        if fault is not None:
            self.faults[fault] += 1
        self.costs.feed(initial, fault in (0, 1), stub)

    def line(self, role: str, text: str) -> None:
        self.digest.update((("\n" if self.begun else "") + role + ":" + text).encode("utf-8", "replace"))
        self.begun = True

    def inserts(self) -> None:
        while self.edits[1][self.at : self.at + 1] == "I":
            self.state, self.at = INSERTED[self.state], self.at + 1
            self.line(NAMES[self.state], "")

    def forth(self, role: str, text: str) -> None:
        self.edits = self.edits or self.costs.audit()
        self.inserts()
        letter, self.at = self.edits[1][self.at], self.at + 1
        if letter == "K":
            self.state = INITIAL[role[:1]]
            self.line(role, text)
        elif letter == "R":
            self.state = INSERTED[self.state]
            self.line(NAMES[self.state], text)

    def row(self) -> tuple:
        self.edits = self.edits or self.costs.audit()
        self.inserts()
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.distinct
        return (gaps, *self.faults, self.illegal, self.edits[0], self.edits[1], self.digest.hexdigest())


COLUMNS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


def repair(conversations: DataFrame) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256): one row for every conv_id, null included.

    conversations: conv_id, turn, role, text, copies (0: the row is not there
    but its conv_id is); further columns are not read.  Rows of a conversation
    stand by turn, nulls first, and rows of one turn by role and by the digest of
    their text.  A role that is empty or starts otherwise than s, u, a fits nowhere, so
    such a turn is rerolled or deleted.  An empty table gives no rows.
    """
    solid = F.regexp_extract("text", rf"({SOLID})[\x20\x09-\x0D]*\z", 1)
    narrow = conversations.select("conv_id", "turn", "role", "copies", F.unhex(F.sha2("text", 256)).alias("text_key"), (~F.col("text").rlike(SOLID)).alias("blank"), (~solid.isin(".", "!", "?")).alias("stub"))
    when = lambda c: F.struct(c.isNotNull().alias("known"), c.alias("turn"))
    first = narrow.filter("copies > 0").groupBy(F.col("conv_id").alias("c"), F.col("role").alias("r"), F.col("text_key").alias("k")).agg(F.min(when(F.col("turn"))).alias("first"))
    narrow = narrow.join(first, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("role") == F.col("r")) & (F.col("text_key") == F.col("k")), "left")
    # rows of one turn, role and text are copies of each other: the first of them is new where their turn is the first
    alike = narrow.groupBy("conv_id", "turn", "role", "text_key", "blank", "stub").agg(F.sum("copies").alias("copies"), F.first("first").alias("first"))
    none = lambda kind: F.lit(None).cast(kind)
    back = alike.select("conv_id", F.lit(0).alias("way"), "turn", "role", "text_key", "copies", "blank", "stub", (when(F.col("turn")) != F.col("first")).alias("repeated"), none("string").alias("text"))
    forth = conversations.filter("copies > 0").select("conv_id", F.lit(1).alias("way"), "turn", "role", F.unhex(F.sha2("text", 256)).alias("text_key"), F.col("copies").cast("bigint").alias("copies"), none("boolean").alias("blank"), none("boolean").alias("stub"), none("boolean").alias("repeated"), "text")
    on_way = lambda k, c: F.when(F.col("way") == k, F.col(c))
    order: list[Column] = [F.col("conv_id").asc_nulls_first(), F.col("way").asc(), *[on_way(0, c).desc_nulls_last() for c in ("turn", "role", "text_key")], *[on_way(1, c).asc_nulls_first() for c in ("turn", "role", "text_key")]]
    rows = batched(back.unionByName(forth)).repartition("conv_id").sortWithinPartitions(*order)
    kind = dict(conversations.dtypes)["conv_id"]
    schema = f"conv_id {kind}, gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, audit string, repaired_sha256 string"
    return rows.mapInArrow(repaired_rows, schema)


def repaired_rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of whole conversations, from rows in the order of repair()."""
    open_id, talk, done, kind = None, None, [], None

    def batch() -> pa.RecordBatch:
        ids, rows = [d[0] for d in done], [d[1] for d in done]
        columns = [pa.array(c, pa.int64() if k < 6 else pa.string()) for k, c in enumerate(zip(*rows))]
        done.clear()
        return pa.RecordBatch.from_arrays([pa.array(ids, kind), *columns], names=["conv_id", *COLUMNS])

    for b in batches:
        kind = b.schema.field("conv_id").type
        for conv, way, turn, role, _, copies, blank, stub, repeated, text in zip(*(c.to_pylist() for c in b.columns)):
            if talk is None or conv != open_id:
                if talk is not None:
                    done.append((open_id, talk.row()))
                open_id, talk = conv, Conversation()
            for k in range(copies):
                if way == 0:
                    # backwards: of several copies the last one fed is the first
                    talk.back(turn, role[:1], blank, repeated or k < copies - 1, stub)
                else:
                    talk.forth(role, text)
        if len(done) >= 1000:
            yield batch()
    if talk is not None:
        done.append((open_id, talk.row()))
    if done:
        yield batch()
