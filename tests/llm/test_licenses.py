import itertools
import random
import re
import time

from tallyspark.llm import license_scan as ls

TEXTS = ["Licensed under the Apache License, Version 2.0.", "under the MIT License under the mit license", "x cc-by-nc y CC BY NC SA 4.0 license", "SPDX-License-Identifier: BSD-3-Clause", "under the mit licenses", "", None, "GNU General Public License v3", "apache license version 20"]


def brute_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute(text):
    words = brute_words(text)
    places = [(i, label) for phrase, label in ls.BASE for i in range(len(words)) if words[i : i + len(phrase.split())] == phrase.split()]
    return len(words), sorted(places)


def test_base_like_brute_force(edges):
    scanner = ls.Scanner()
    for text in TEXTS + [r["text"] for r in edges.collect()]:
        n, places, _ = scanner.scan(text)
        assert (n, [(p["start"], p["label"]) for p in places]) == brute(text)


def spellings(nodes):
    """Everything that a parsed signature matches, with one character for a class and a word for a free run."""
    each = []
    for op, arg in nodes:
        name = str(op)
        if name == "LITERAL":
            each.append([chr(arg)])
        elif name == "IN":
            each.append([chr(v) if str(kind) == "LITERAL" else chr(v[0]) for kind, v in arg])
        elif name in ("MAX_REPEAT", "MIN_REPEAT"):
            low, high, what = arg
            each.append(["some words"] if high > 1 else ["", *spellings(what)])
        elif name == "SUBPATTERN":
            each.append(spellings(arg[3]))
        elif name == "BRANCH":
            each.append([s for way in arg[1] for s in spellings(way)])
        else:
            assert name in ("ASSERT_NOT", "ASSERT"), name
    return ["".join(p) for p in itertools.product(*each)]


def test_keyword_stands_in_every_match():
    n = 0
    for rule in ls.rules():
        for text in spellings(re._parser.parse(rule.pattern.pattern)):
            assert rule.pattern.search(text) and rule.keyword in text, (rule.keyword, text)
            n += 1
    assert n > 400


def brute_labels(text):
    """Every rule over the text without a prefilter; a detection goes if a better one holds it."""
    words = brute_words(text)
    line, found = " ".join(words), []
    for i, rule in enumerate(ls.rules()):
        found += [(rule.priority, m.end() - m.start(), -i, m.start(), m.end()) for m in rule.pattern.finditer(line)]
    left = [d for d in found if not any(e > d and e[3] <= d[3] and d[4] <= e[4] for e in found)]
    return sorted((line[: d[3]].count(" "), line[: d[4]].count(" ") + 1, ls.rules()[-d[2]].label, ls.rules()[-d[2]].confidence) for d in left)


def test_labels_and_places_like_brute_force():
    r = random.Random(8)
    parts = [s for rule in ls.rules() for s in spellings(re._parser.parse(rule.pattern.pattern))[:2]] + ["plain words", "é ü", "the", "license", "Version 2.0", "under the MIT License,"]
    scanner, seen = ls.Scanner(), set()
    for _ in range(400):
        text = " ".join(r.choice(parts) for _ in range(r.randrange(1, 9)))
        got = [(d["start"], d["end"], d["label"], d["confidence"]) for d in scanner.scan(text)[2]]
        assert sorted(got) == brute_labels(text), text
        seen |= {g[2] for g in got}
    assert len(seen) > 80


def test_long_texts_with_many_hits():
    text = "cc by nc " * 450_000
    began = time.process_time()
    n, places, found = ls.Scanner().scan(text)
    assert time.process_time() - began < 15
    assert n == 1_350_000 and len(places) == len(found) == 450_000 and places[-1]["start"] == found[-1]["start"] == 1_349_997


def test_resolution():
    assert ls.resolved([(10, 5, 0, 0, 5), (20, 8, -1, 0, 8)]) == [(20, 8, -1, 0, 8)]
    assert sorted(ls.resolved([(10, 5, 0, 0, 5), (20, 3, -1, 1, 4)])) == [(10, 5, 0, 0, 5), (20, 3, -1, 1, 4)]
    assert len(ls.resolved([(10, 5, 0, 5 * k, 5 * k + 5) for k in range(500)] * 2)) == 500
    labels = [d["label"] for d in ls.Scanner().scan("Released under the MIT License")[2]]
    assert labels == ["mit"]


def test_rules_are_many_and_table(spark, edges, empty):
    assert len(ls.rules()) > 200
    rows = ls.scan_licenses(edges).collect()
    assert len(rows) == edges.count() and all(0 <= r["score"] <= 1 for r in rows)
    assert ls.scan_licenses(empty).count() == 0
