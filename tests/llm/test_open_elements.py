"""Elements without text that are never closed."""

import time

import numpy as np
import pytest

from quarry.llm.block_labeller import LEAST, Labeller, features, trained, training_page
from quarry.llm.html_blocks import blocks_of


@pytest.mark.parametrize(
    "page",
    [
        "<html><head><title>t</title><meta charset=utf-8><style>a{}</style><body><p>Long story</p>",
        "<head><title>t</title><script>'<p>no'</script><link rel=x><p>Long story",
        "<head><title>t</title>Long story",
        "<head><title>t</title></head><p>Long story</p>",
        "<head><meta charset=utf-8><noscript><p>no</p></noscript></head><p>Long story</p>",
        "<button><p>Long story</p>",
        "<button><p>Long story</p><button>no</button>",
        "<svg viewBox='0 0 1 1'><p>Long story</p>",
        "<button-bar><p>Long story</p>",
        "<p>Long story</p><script>no",
        "<select><option>no</option></select><p>Long story</p><svg>",
    ],
)
def test_text_stays(page):
    assert [b.text for b in blocks_of(page)] == ["Long story"]


@pytest.mark.parametrize(
    ("page", "texts"),
    [
        ("<p>a<!-->b</p><p>c</p>", ["ab", "c"]),
        ("<p>a<!--->b<!-- x --!>c", ["abc"]),
        ("<!doctype html><title>T</title><p>x", ["x"]),
        ("<head><meta charset=u><title>T</title><p>x<p>y", ["x", "y"]),
        ("<head><title>T<p>x", ["x"]),
        ("<p>a<button>b<p>c</p>", ["ab", "c"]),
        ("<button>x</button><p>a<button>b<p>c<button>d</button>e", ["ab", "ce"]),
        ("<p>x <math><mi>y</mi><mo>=</mo></math> z", ["x y= z"]),
        ("<pre>one\n  two</pre><p>a</p><object>b</object>", ["one two", "a", "b"]),
        ("<p>t</p><svg><title>k</title>in</svg>out<svg/>more<svg>never", ["t", "out", "morenever"]),
        ('<a href="x>unclosed <p>text</p>', ["unclosed", "text"]),
        ("a<p title='>'>b</p>c <x", ["a", "b", "c"]),
        ("1 < 2 <3 a<b>c</b>", ["1 < 2 <3 ac"]),
        ("x<script>y<p>z", ["x"]),
        ("", []),
        (None, []),
    ],
)
def test_ends_of_elements(page, texts):
    assert [b.text for b in blocks_of(page)] == texts


@pytest.mark.parametrize("part", ["<a", "<a ", '<a href="x>', "<div>x", "<svg>x", "<button>x", "<b>", "<!--x", "<title>x", "</p", "<![x", "<a b=", "<p><b>x<i>"])
def test_reading_is_linear(part):
    began = time.process_time()
    blocks_of(part * 100_000)
    assert time.process_time() - began < 30  # quadratic reading takes hours


def test_long_pages_score_alike_in_parts():
    r = np.random.default_rng(5)
    blocks = [b for _ in range(12) for b in training_page(r)[0]]
    model = trained()
    assert np.allclose(model.long_scores(blocks, 7), model.scores([features(blocks)])[0])


def test_gradient_of_words():
    r = np.random.default_rng(2)
    made = [training_page(r) for _ in range(4)]
    pages, labels = [features(b) for b, _ in made], [y for _, y in made]
    model = Labeller(3)
    model.learn_words(pages, 2)
    model.p["words"] += r.normal(0, 0.1, model.p["words"].shape)
    _, g = model.gradient(pages, labels)
    at = np.unravel_index(np.abs(g["words"]).argmax(), g["words"].shape)
    ends = []
    for sign in (1, -1):
        model.p["words"][at] += sign * 1e-5
        ends.append(model.gradient(pages, labels)[0])
        model.p["words"][at] -= sign * 1e-5
    assert np.isclose((ends[0] - ends[1]) / 2e-5, g["words"][at], rtol=1e-3)


def test_held_out_pages():
    r, right, total, model = np.random.default_rng(999), 0, 0, trained()
    for blocks, labels in (training_page(r, silent=True) for _ in range(200)):
        if blocks:
            right += int(((model.scores([features(blocks)])[0] > LEAST) == (labels > 0)).sum())
            total += len(labels)
    assert right / total > 0.97
