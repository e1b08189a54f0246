"""License scans: ordered signature rules behind a keyword prefilter.

Every rule is a regular expression over the text's words, with a label, a
priority, a confidence and keywords.  A text is first searched for all
keywords at once; only the rules whose keyword it holds are run.  Detections
are then resolved: one that lies inside another's interval is dropped if the
other's priority is higher, or equal with a longer interval.
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batched, slices
from .license_rules import rules

#: Bytes of words: digits, a-z and all that is not ASCII; A-Z become a-z, the rest parts words.
WORD_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b > 127 else 32 for b in range(256))
#: Phrases whose places are the base (phrase, label).
BASE = (("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc"))


class Scanner:
    def __init__(self, base: tuple = BASE):
        self.base, self.rules = base, rules()
        self.keywords = ahocorasick.Automaton()
        by: dict[str, list[int]] = {}
        for i, rule in enumerate(self.rules):
            by.setdefault(rule.keyword, []).append(i)
        for keyword, which in by.items():
            self.keywords.add_word(keyword, which)
        self.keywords.make_automaton()

    def scan(self, text: str | None) -> tuple[int, list[dict], list[dict]]:
        """How many words; base places (label, start); detections (label, start, end, rule, confidence), by start. Words count from 0, ends stand behind the last word."""
        words = (text or "").encode("utf-8", "replace").translate(WORD_BYTES).split()
        line = b" ".join(words)
        # a character a byte: patterns and keywords are ASCII, and words are parted by spaces alone
        spoken = line.decode("latin-1")
        ends = np.flatnonzero(np.frombuffer(line, np.uint8) == 32)
        places = []
        for phrase, label in self.base:
            at = spoken.find(phrase)
            while at >= 0:
                if (at == 0 or spoken[at - 1] == " ") and spoken[at + len(phrase) : at + len(phrase) + 1] in ("", " "):
                    places.append((at, label))
                at = spoken.find(phrase, at + 1)
        met = {i for _, which in self.keywords.iter(spoken) for i in which}
        if not met and not places:
            return len(words), [], []
        found = []
        for i in sorted(met):
            rule = self.rules[i]
            found += [(rule.priority, m.end() - m.start(), -i, m.start(), m.end()) for m in rule.pattern.finditer(spoken)]
        # words are numbered once: a character's word is the number of spaces in front of it
        word = lambda at: np.searchsorted(ends, at).tolist()
        places = [{"label": label, "start": k} for k, (_, label) in zip(word([at for at, _ in places]), places)]
        left = sorted(resolved(found), key=lambda d: (d[3], d[2]))
        spans = zip(word([d[3] for d in left]), word([d[4] for d in left]), left)
        detections = [{"label": self.rules[-d[2]].label, "start": a, "end": b + 1, "rule": -d[2], "confidence": self.rules[-d[2]].confidence} for a, b, d in spans]
        return len(words), sorted(places, key=lambda p: (p["start"], p["label"])), detections


def resolved(found: list[tuple]) -> list[tuple]:
    """Without detections that lie inside a better one: (priority, length, -rule, start, end), the larger the better.

    The best is taken first; what is kept is filed by start, so one is compared only with those that can reach over it.
    """
    step = max([64, *(d[4] - d[3] for d in found)])
    kept: dict[int, list[tuple]] = {}
    for one in sorted(set(found), reverse=True):
        file = one[3] // step
        if not any(k[3] <= one[3] and one[4] <= k[4] for f in (file - 1, file) for k in kept.get(f, ())):
            kept.setdefault(file, []).append(one)
    return [d for ds in kept.values() for d in ds]


def scan_licenses(documents: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", base: tuple = BASE) -> DataFrame:
    """(id, n_words, base, detections, score): one row for each document.

    base: every place of the base phrases; detections: what the rules leave;
    score: the largest confidence of a detection, 1 where a base phrase
    stands, else 0.  Null and empty texts have no words and no places.
    Repeated rows stay; other columns are not read.
    """
    place = pa.struct([("label", pa.string()), ("start", pa.int64())])
    spot = pa.struct([("label", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("rule", pa.int32()), ("confidence", pa.float64())])

    @F.arrow_udf("struct<n_words:bigint,base:array<struct<label:string,start:bigint>>,detections:array<struct<label:string,start:bigint,end:bigint,rule:int,confidence:double>>>")
    def scanned(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        scanner = Scanner(base)
        for batch in slices(batches):
            n, places, found = zip(*[scanner.scan(t.as_py()) for t in batch]) if len(batch) else ((), (), ())
            yield pa.StructArray.from_arrays([pa.array(n, pa.int64()), pa.array(places, pa.list_(place)), pa.array(found, pa.list_(spot))], ["n_words", "base", "detections"])

    score = F.when(F.size("base") > 0, 1.0).otherwise(F.coalesce(F.array_max(F.transform("detections", lambda d: d["confidence"])), F.lit(0.0)))
    return batched(documents).select(F.col(id_col).alias(id_col), scanned(F.col(text_col)).alias("s")).select(id_col, "s.*").withColumn("score", score)
