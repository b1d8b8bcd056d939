"""Broken pages are read in time proportional to their size, and as before."""

import random
import re
import time

import pytest

from mintleaf.llm import html_text


def blocks(page):
    return [(b.path, b.text) for b in html_text._Parser().blocks(page)]


@pytest.mark.parametrize(
    "page",
    ["<p>x</p>" + "<a " * 340_000, "<p>x</p>" + '<a b="' * 170_000, "<div>" * 200_000, "<div>x" * 170_000, "<b>" * 150_000 + "</i>" * 150_000, "<!" * 500_000, "<a<a" * 250_000, "<a \"'" * 200_000, "<a " * 330_000 + '"', "<svg>" * 200_000, "<a'" * 330_000, "<table>" + "<tr><td>x" * 110_000],
    ids=range(12),
)
def test_a_broken_megabyte(page):
    began = time.perf_counter()
    blocks(page)
    assert time.perf_counter() - began < 20  # it took minutes or never ended


def test_markup_is_found_where_one_pattern_finds_it():
    pattern = re.compile(r"<!--.*?(?:-->|$)|<!\[CDATA\[.*?(?:\]\]>|$)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:\"[^\"]*\"|'[^']*'|[^'\">])*)>", re.S)
    rng = random.Random(1)
    bits = ["<", "<a", "<a ", "<p>", "</p>", '"', "'", ">", "x", " ", "=", "/", "<!--", "-->", "<![CDATA[", "]]>", "<!", "<?", "<div class='ad'>", "<br/>", "<1", "</"]
    for _ in range(20000):
        page, at, found = "".join(rng.choice(bits) for _ in range(rng.randrange(14))), 0, []
        scanner = html_text._Scanner(page)
        while m := scanner.after(at):
            found.append((*m[:2], m[3]))
            at = m[1]
        assert found == [(m.start(), m.end(), (m[2] or "").lower()) for m in pattern.finditer(page)], page


def test_deep_elements_and_open_ends():
    assert blocks("<div>" * 600 + "deep")[0][1] == "deep" and len(blocks("<div>" * 600 + "deep")[0][0]) == 512
    assert blocks("<p>a</p><!-- open <p>b</p>") == [(("p",), "a")]
    assert blocks("<p>a</p><script>open <p>b</p>") == [(("p",), "a")]
    assert [t for _, t in blocks("<p>a <b</p> c</p>")] == ["a c"] and [t for _, t in blocks("a <b")] == ["a <b"]
