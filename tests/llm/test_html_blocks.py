import html
import re
from pathlib import Path

import numpy as np
import pytest

from tallybook.llm import html_blocks as hb
from tallybook.llm.common import table


def drawn(seed, pages):
    draw, found = hb._Draw(seed), []
    for _ in range(pages):
        blocks = hb.page_blocks(draw.page())
        labels = np.array([float("\x01" in b.text) for b in blocks])
        for b in blocks:
            b.text = b.text.replace("\x01", "").strip() or "x"
        if blocks:
            found.append((hb.block_inputs(blocks), labels))
    return found


def test_gradients_match_differences():
    pages = drawn(3, 3)
    model, rng = hb.BlockLabeller(2), np.random.default_rng(0)
    for k in model.w:
        model.w[k] = model.w[k] + rng.normal(0, 0.1, model.w[k].shape)
    inputs, labels = [p[0] for p in pages], [p[1] for p in pages]
    _, grads = model.gradients(inputs, labels)
    for k, g in grads.items():
        at = np.unravel_index(np.argmax(np.abs(g)), g.shape)
        up, down = [], []
        for step, into in ((1e-5, up), (-1e-5, down)):
            model.w[k][at] += step
            into.append(model.gradients(inputs, labels)[0])
            model.w[k][at] -= step
        assert abs((up[0] - down[0]) / 2e-5 - g[at]) < 1e-6


def test_held_out_templates():
    model, wrong, total = hb.trained_labeller(), 0, 0
    for inputs, labels in drawn(99, 200):
        found = model.probabilities([inputs])[0] >= 0.5
        wrong, total = wrong + int((found != (labels > 0)).sum()), total + len(labels)
    assert wrong / total < 0.005


def test_whole_pages_against_plain_reading(spark):
    sf = "/root/testdata/sf0.001"
    assert Path(sf).exists()
    for row in hb.with_main_text(table(spark, sf, "pages")).collect():
        inside = re.search(r"<article>(.*?)(?:</article>|\Z)", row.html, re.S)[1]
        parts = [" ".join(html.unescape(re.sub(r"<[^>]*(>|\Z)", " ", x)).split()) for x in re.split(r"</?p[^>]*>|</?h1>", inside)]
        assert row.main_text == "\n\n".join(x for x in parts if x)


@pytest.mark.parametrize("page, texts", [
    (None, []), ("", []), ("<p>a<p>b &amp; c", ["a", "b & c"]), ("<p>x<br>y</p><scr", ["x y"]), ("<script>if (a<b) '</p>'</script><p>z", ["z"]),
    ("<!-- <p>no</p> --><div>a <b>b</b>c<ul><li>1<li>2</ul></div>t&eacute;", ["a bc", "1", "2", "té"]), ("<style>p{}</style", []),
    ("<title>no</title><body>x\n\n y", ["x y"]), ("a < b", ["a < b"]), ("<p title='a>b'>ok</p>", ["ok"]),
])
def test_blocks(page, texts):
    assert [b.text for b in hb.page_blocks(page)] == texts


def test_odd_rows(frame):
    long_page = "<article>" + "".join(f"<p>Paragraph number {i} of the story goes on here.</p>" for i in range(3000)) + "</article>"
    rows = [(1, None, None), (2, "u", ""), (2, "u", ""), (3, "u", long_page), (4, "u", "<script>x</script>")]
    out = {r.page_id: r for r in hb.with_main_text(frame(rows, "page_id long, url string, html string").selectExpr("*", "1 as main_text")).collect()}
    assert out[1].main_text == out[2].main_text == out[4].main_text == ""
    assert len(out[3].main_blocks) == 3000
    assert hb.with_main_text(frame([], "page_id long, url string, html string")).count() == 0


@pytest.mark.parametrize("page, texts", [
    ("<html><head><title>x</title><p>Article<p>more", ["Article", "more"]),
    ("<head><title>x</title><script>'<p>no'</script><meta a=b><noscript><link></noscript><template><p>no</p></template><div>yes</div>", ["yes"]),
    ("<html><head><title>x</title>Plain text", ["Plain text"]),
    ("<head><title>x</title></head>\n<p>a", ["a"]),
    ("<title>x<p>a", ["a"]),
    ("<div><noscript><b>no</b></div><p>a", ["a"]),
    ("<svg><path><article>a</article>", ["a"]),
    ("<div><object><div>no</div></object>a</div><iframe src=x><section>b</section>", ["a", "b"]),
])
def test_missing_ends_lose_no_article(page, texts):
    assert [b.text for b in hb.page_blocks(page)] == texts


@pytest.mark.parametrize(("page", "texts"), [
    ("<p title=it's>Hello one</p><p>I don't know two</p><p>End", ["Hello one", "I don't know two", "End"]),
    ('<p title="oops>Hello</p><p>next', ["Hello", "next"]),
    ("<p title='a > b' class=\"x>y\">kept</p>", ["kept"]),
    ("<p title = 'it''s'>one</p><p data-x=a\"b>two</p><p ' \" >three", ["one", "two", "three"]),
    ("<a href=http://x/?q='>link</a> text", ["link text"]),
])
def test_quotes_count_only_as_values(page, texts):
    assert [b.text for b in hb.page_blocks(page)] == texts


def test_a_page_of_many_blocks_stays_small():
    """Blocks of one long page, and short pages beside it, within a bound of memory."""
    import tracemalloc

    model = hb.trained_labeller()
    pages = ["<article>" + "".join(f"<p>Line {i} of a long table of contents.</p>" for i in range(30_000)) + "</article>"]
    pages += ["<article><p>A short page of its own.</p></article>"] * 63
    tracemalloc.start()
    kept = hb.main_blocks(pages, model)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert kept[1:] == [hb.main_blocks(pages[1:2], model)[0]] * 63 and len(kept[0]) > 25_000
    assert peak < 600e6
