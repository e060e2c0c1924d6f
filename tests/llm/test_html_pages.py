"""Article text that must stay, parts that must go, and pages that are long, nested or never closed."""

import time
import tracemalloc

import pytest

from weekloom.llm import html_text

TAIL = "Plain words follow in this long paragraph, and they go on for a while."
PAGE = f"<body><article><h1>On energy</h1>%s<p>{TAIL}</p></article></body>"


@pytest.mark.parametrize(
    "markup, text",
    [
        ("<p>The energy is <math><mi>E</mi></math> of mass.</p>", "The energy is E of mass."),
        ("<p>Press <button>Go</button> to start the machine.</p>", "Press Go to start the machine."),
        ("<p>Its plan <object data=x>is a drawing</object> on paper.</p>", "Its plan is a drawing on paper."),
        ('<div class="side-by-side"><p>The two plans are compared here.</p></div>', "The two plans are compared here."),
        ('<div class="related-work"><p>The two plans were seen before in other work.</p></div>', "The two plans were seen before in other work."),
        ("<p>Before <svg><path d=1><title>t</title><text>no</text></svg> and after it.</p>", "Before and after it."),
        ("<p>Before <svg><g/> and after it all.</p>", "Before\n\nand after it all."),
        ("<p>Pick <select><option>a<option>b</select> one of the two plans.</p>", "Pick one of the two plans."),
        ("<template><p>Words that are never shown to any reader.</p></template>", None),
        ('<div class="related-links"><a href="/x">See also this</a></div>', None),
        ('<div class="side-bar"><p>Buy our paper today, it is cheap and good to read.</p></div>', None),
    ],
)
def test_parts_of_an_article(markup, text):
    want = ["On energy", text, TAIL] if text else ["On energy", TAIL]
    assert html_text.main_text(PAGE % markup) == "\n\n".join(want)


def test_an_open_element_takes_nothing_from_the_next_container():
    for tag in ("object", "video", "svg", "template"):
        page = f"<article><div><{tag}><p>One paragraph of words that has to stay.</p></div><div><p>Another one with words to keep.</p><{tag}></{tag}></div></article>"
        assert html_text.main_text(page) == "One paragraph of words that has to stay.\n\nAnother one with words to keep.", tag


@pytest.mark.parametrize("piece", ["<div>text ", "<svg>text ", "<object>text ", "<p>text</div>", "<title>x ", "<p class='a>", "<ul><li>a</li></ul>"])
def test_long_pages_take_time_and_memory_in_proportion(piece):
    page = "<article>" + piece * 100_000
    start = time.process_time()
    html_text.main_text(page)
    assert time.process_time() - start < 15  # a quadratic reader takes minutes
    tracemalloc.start()
    html_text.blocks("<article>" + piece * 20_000)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 100e6


def test_tables_of_pages(spark):
    schema = "page_id long, url string, html string, text string, n_chars int"
    rows = [(1, "u", PAGE % "", "x", 5), (1, "u", PAGE % "", "x", 5), (None, None, None, None, None), (2, "u", "", "x", 1)]
    got = html_text.extracted(spark.createDataFrame(rows, schema).repartition(2))
    text = f"On energy\n\n{TAIL}"
    assert got.columns == ["page_id", "url", "text", "n_chars"]
    found = sorted((r.page_id or 0, r.url or "", r.text, r.n_chars) for r in got.collect())
    assert found == [(0, "", "", 0)] + [(1, "u", text, len(text))] * 2 + [(2, "u", "", 0)]
    assert html_text.extracted(spark.createDataFrame([], schema)).count() == 0
