"""The labeller on layouts that its own generator did not write, and broken pages."""

import random
import time

from tallyspark.llm import html_extract as he

#: (page, main text) with neutral names, rows of a table, lists and preformatted text, and no markup but paragraphs.
PLAIN = [
    (
        "<html><body><div class='c1'><a href='/'>Start</a> <a href='/b'>Blog</a></div><div class='c2'><h2>A quiet walk</h2><p>We went along the river for two hours, and saw nobody at all.</p><p>In the evening it rained, so we stayed in.</p></div><div class='c3'>Copyright 2020 by us. All rights reserved.</div></body></html>",
        ["A quiet walk", "We went along the river for two hours, and saw nobody at all.", "In the evening it rained, so we stayed in."],
    ),
    (
        "<html><body><table><tr><td><a href='/'>Home</a> <a href='/n'>News</a></td></tr><tr><td><h1>On bees</h1><p>Bees live in hives, and they make honey from flowers.</p><p>They also sting when they are cross.</p></td></tr><tr><td>Copyright 1999 - terms of use</td></tr></table></body></html>",
        ["On bees", "Bees live in hives, and they make honey from flowers.", "They also sting when they are cross."],
    ),
    ("<html><body><main><h1>Setting up</h1><ol><li>Unpack the box.</li><li>Connect the cable to the wall.</li></ol><pre>run --all now</pre></main></body></html>", ["Setting up", "Unpack the box.", "Connect the cable to the wall.", "run --all now"]),
    ("<html><body><h1>Plain</h1><p>First paragraph of this page, without anything else.</p><p>And another one.</p></body></html>", ["Plain", "First paragraph of this page, without anything else.", "And another one."]),
]
NOUNS = "river mountain garden engine window letter harbour village teacher winter market orchard bridge kitchen station island".split()
VERBS = "crossed painted measured followed opened watched repaired described carried remembered".split()


def texts_of(page):
    blocks = he.leaf_blocks(page)
    return [b.text for b, m in zip(blocks, he.labeller().label([blocks])[0]) if m]


def written(r):
    """A page of English words in one of four shells, and its main text: written apart from the generator that trains."""

    def sentence():
        return f"The {r.choice(NOUNS)} {r.choice(VERBS)} the old {r.choice(NOUNS)} near the {r.choice(NOUNS)}, and nobody {r.choice(VERBS)} it again."

    head = f"The {r.choice(NOUNS)} and the {r.choice(NOUNS)}"
    paras = [" ".join(sentence() for _ in range(r.randrange(1, 4))) for _ in range(r.randrange(2, 7))]
    menu = "".join(f"<li><a href='/{w}'>{w.capitalize()}</a></li>" for w in r.sample(NOUNS, 5))
    body = f"<h1>{head}</h1>" + "".join(f"<p>{p}</p>" for p in paras)
    foot = "&copy; 2021 Example Press. All rights reserved. Privacy policy"
    shell = r.randrange(4)
    if shell == 0:
        page = f"<header><a href='/'>Example Press</a></header><nav><ul>{menu}</ul></nav><main>{body}</main><aside><h3>Related posts</h3><ul>{menu}</ul></aside><footer>{foot}</footer>"
    elif shell == 1:
        page = f"<div id='wrap'><div class='x7'><ul>{menu}</ul></div><div class='x8'>{body}</div><div class='x9'>{foot}</div></div>"
    elif shell == 2:
        page = f"<ul>{menu}</ul><article>{body}</article><form action='/find'><label>Search</label><input><button>Send</button></form><div class='cookie-bar'>We use cookies. Accept cookies?</div><footer>{foot}</footer>"
    else:
        page = f"<div class='topmenu'>{''.join(f'<a href=/{w}>{w}</a> ' for w in NOUNS[:6])}</div><section class='story'>{body}</section><div class='comments'><h3>2 comments</h3><div class='comment'>ann says: {sentence()}</div></div><div class='site-footer'>{foot}</div>"
    return f"<html><head><title>{head}</title></head><body>{page}</body></html>", [head, *paras]


def test_plain_pages():
    for page, want in PLAIN:
        assert texts_of(page) == want


def test_second_generator():
    r, right, n, kept, lost = random.Random(4), 0, 0, 0, 0
    for _ in range(120):
        page, want = written(r)
        got = texts_of(page)
        right, n = right + (got == want), n + 1
        lost += len(set(want) - set(got))
        kept += len(want)
    assert right >= 0.85 * n and lost <= 0.04 * kept, (right, n, lost, kept)


def test_deep_nesting_is_linear():
    """100 KB of tags that never close: parent pointers instead of copies of each path."""
    for mark in ("<b>", "<div>", "<b class=x>", "<i></u>", "<svg>", "<p><b>"):
        page = mark * (100_000 // len(mark)) + "x"
        began = time.process_time()
        assert [b.text for b in he.leaf_blocks(page)] == ["x"]
        assert time.process_time() - began < 3


def test_embedded_elements():
    page = "<article><p>one</p><svg class='i'/><p>two</p><svg><path/><text>no</text></svg><p>three<svg><p>four"
    assert [b.text for b in he.leaf_blocks(page)] == ["one", "two", "three", "four"]
