"""Main text by ratios: without lists and marks, against a second computation, in time that grows with the page."""

import math
import random
import re
import time
from pathlib import Path

import pyarrow.parquet as pq
import pytest

from sparkloom.llm import page_text

SENTENCES = "".join(f"<p>Paragraph {k} has a sentence, and another one. It goes on for a while, as paragraphs do, until it ends.</p>" for k in range(6))
MADE = f"""<body><div class="top-links"><a href=1>Home</a> <a>News</a> <a>About us</a></div><div class="content">{SENTENCES}</div><div class="related-posts"><ul><li>Other story</li><li>Second
 story</li></ul></div><div class="comments-area"><p>I agree, thanks.</p><p>Nice post. I like it.</p></div><div class="site-info">Copyright 2024, Example Inc.</div></body>"""


def plain(page):
    return re.sub(r"<(/?)(article|main)\b", r"<\1div", page)


@pytest.mark.parametrize("listed", [0.0, 1.0])
def test_names_that_no_list_has(listed):
    got = page_text.main_text(MADE, listed, 1.0)
    assert got.split("\n") == re.findall("<p>(Paragraph.*?)</p>", MADE)
    body = page_text.main_text(MADE.replace('<div class="content">', "", 1).replace("</p></div>", "</p>", 1), listed, 1.0)
    assert got == body


@pytest.fixture(scope="module")
def pages():
    return pq.read_table(str(next(Path("/root/testdata/sf0.01").glob("pages.parquet"))), columns=["html"]).column(0).to_pylist()


def test_ratios_alone_on_pages_without_marks(pages):
    right = blocks = 0
    for page in pages:
        want, got = (set(t.split("\n")) for t in (page_text.main_text(page), page_text.main_text(plain(page), 1.0, 1.0)))
        every = {b[-1] for b in page_text.blocks_of(page)}
        right += sum((b in want) == (b in got) for b in every)
        blocks += len(every)
    assert right >= 0.97 * blocks
    assert all(page_text.main_text(plain(p)) == page_text.main_text(p) for p in pages[:100])


def test_equal_ratios_change_the_result(pages, monkeypatch):
    own = [page_text.main_text(plain(p), 1.0, 1.0) for p in [*pages[:100], MADE]]
    monkeypatch.setattr(page_text, "path_ratios", lambda blocks: {path: 1.0 for path, _, _ in blocks})
    assert sum(page_text.main_text(plain(p), 1.0, 1.0) != t for p, t in zip([*pages[:100], MADE], own, strict=True)) == 101


def test_ratios_against_second_computation():
    rng = random.Random(3)
    for _ in range(200):
        paths = [tuple(rng.choice("abc") for _ in range(rng.randint(1, 3))) for _ in range(5)]
        blocks = [(rng.choice(paths), rng.choice([0.0, 1.0, 2.0]), "".join(rng.choice("xy .,!") for _ in range(rng.randint(1, 60)))) for _ in range(rng.randint(1, 25))]
        seen = list(dict.fromkeys(p for p, _, _ in blocks))
        own = {p: [b for b in blocks if b[0] == p] for p in seen}
        mean = [sum(len(t) for _, _, t in own[p]) / len(own[p]) for p in seen]
        weight = [max(w for _, w, _ in own[p]) for p in seen]
        total = [sum(len(t) for _, _, t in own[p]) * w for p, w in zip(seen, weight, strict=True)]
        got = page_text.path_ratios(blocks)
        assert list(got) == seen
        for k, p in enumerate(seen):
            around = 0.25 * mean[max(k - 1, 0)] + 0.5 * mean[k] + 0.25 * mean[min(k + 1, len(seen) - 1)]
            marks = (sum(c in ".,!" for _, _, t in own[p] for c in t) + 0.5) / len(own[p])
            assert math.isclose(got[p], math.sqrt(max(around, mean[k]) * marks) * weight[k] * total[k] / max([*total, 1.0]), rel_tol=1e-9, abs_tol=1e-12)


def test_paths():
    page = "<body><div><div class='a2 b' id=x9><p>one</p></div></div><div><section><p>two</p></section><div>three</div></div></body>"
    assert [keys for _, keys, _, _ in page_text.blocks_of(page)] == [("body", "div@1", "div.a.b#x", "p"), ("body", "div@2", "section@1", "p"), ("body", "div@2", "div")]


@pytest.mark.parametrize("broken", ['<p class="x ', "<a '", "<!", "</script ", "<p>a <b ", "<!-- x "])
def test_time_grows_with_the_page(broken):
    page = f"<body><p>{'Some, text here. ' * 20}</p><script>x</script>" + broken * 60_000
    began = time.perf_counter()
    assert page_text.main_text(page).startswith("Some, text here.")
    assert time.perf_counter() - began < 5


def test_comment_without_an_end():
    assert page_text.main_text("<body><p>Some, text. <!-- a > b") == "Some, text."
    assert page_text.main_text("<body><p>Some, text. <!-- a b") == "Some, text."
    assert page_text.main_text("<body><p>Some, text. <i") == "Some, text. <i"
