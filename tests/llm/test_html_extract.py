from tallyspark.llm import html_extract as he

PAGE = "<html><head><title>T</title><style>p{}</style><script>var t='</p>';</script></head><body><nav><ul><li><a href='/x'>Home</a></li></ul></nav><!-- <p>no</p> --><div class=\"ad\">Buy this now.</div><article><h1>A  title&amp;more</h1><p><b>First\n para<br>goes on<p>Second one is &eacute;.</p></article><footer>&copy; me</footer>"


def test_blocks():
    blocks = he.leaf_blocks(PAGE)
    assert [b.text for b in blocks] == ["T", "Home", "Buy this now.", "A title&more", "First para goes on", "Second one is é.", "© me"]
    assert blocks[1].path[-2:] == ("li", "a") or "li" in blocks[1].path
    assert he.leaf_blocks(None) == [] and he.leaf_blocks("<p") == [] and [b.text for b in he.leaf_blocks("plain")] == ["plain"]


def test_unclosed_and_nested():
    assert [b.text for b in he.leaf_blocks("<ul><li>a<li>b<ul><li>c</ul><li>d</ul><table><tr><td>e<td>f</table>g")] == list("abcdefg")
    assert he.leaf_blocks("<script>x<p>y") == [] and he.leaf_blocks("<!-- x") == []


def test_made_pages_are_learnt():
    model, right, n = he.labeller(), 0, 0
    for page, marked in he.made_pages(80, 321):
        blocks = he.leaf_blocks(page)
        want = [i in he.places(blocks, marked) for i in range(len(blocks))]
        right += sum(a == b for a, b in zip(model.label([blocks])[0], want))
        n += len(blocks)
    assert right >= 0.985 * n


def test_batches_do_not_matter():
    pages = [he.leaf_blocks(p) for p, _ in he.made_pages(12, 5)]
    alone = [he.labeller().label([p])[0].tolist() for p in pages]
    assert [x.tolist() for x in he.labeller().label(pages)] == alone


def test_text_of_pages(spark):
    rows = [(1, "u", PAGE, "clash"), (1, "u", PAGE, "clash"), (2, None, None, "clash"), (None, "v", "", "clash"), (3, "w", "<nav><a href='/'>x</a></nav>", "clash"), (4, "l", "<article>" + "<p>Long text goes here.</p>" * 5000 + "</article>", "clash")]
    got = he.extract_text(spark.createDataFrame(rows, "page_id bigint, url string, html string, text string")).collect()
    texts = sorted((str(r["page_id"]), r["text"]) for r in got)
    main = "A title&more\n\nFirst para goes on\n\nSecond one is é."
    assert texts[:2] == [("1", main)] * 2 and texts[2] == ("2", "") and texts[-1] == ("None", "")
    assert dict(texts)["4"].count("\n\n") >= 4900
    assert he.extract_text(spark.createDataFrame([], "page_id bigint, url string, html string")).count() == 0
