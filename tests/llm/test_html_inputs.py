"""op9: the labeller's inputs hold every word of a block and every token of its path."""

import math

import numpy as np
import pytest

from sparkweft.llm import html_blocks as H


def test_nothing_is_left_out():
    words = [f"w{i}" for i in range(500)]
    names = " ".join("n" + chr(97 + i) for i in range(20))
    page = f'<div class="sidebar {names}">' + "<div>" * 60 + f"<p>{' '.join(words)}</p>"
    (block,) = H.blocks(page)
    assert len(block.path) == 83 and block.path[1] == "c:sidebar"
    (path,), (spoken,), _ = H.describe([block])
    assert len(path) == 83 and len(spoken) == 500


@pytest.mark.parametrize(("page", "want"), [
    ("<div><p title=O'Brien>Hello there</p><p>World text</p></div>", ["Hello there", "World text"]),
    ('<p class="a"b">x</p><p>y</p>', ["x", "y"]),
    ("<article><h1>T</h1><p>One.</p><p title=it's>Two.</p><p>Three.</p></article>", ["T", "One.", "Two.", "Three."]),
    ('<p title="never closed>one</p><p>two</p>', ["one", "two"]), ("<p a = 'x>y' b>q</p>", ["q"]), ("<p =>k</p><p a=>l</p>", ["k", "l"]), ("<a href=x/y>t</a>", ["t"]),
    ("<!-->a<!-- x --!>b", ["ab"]), ("<p>a</p><p b='", ["a"]),
])
def test_attributes(page, want):
    assert [b.text for b in H.blocks(page)] == want


@pytest.mark.parametrize("tag", ["noscript", "svg", "object", "select", "template", "datalist", "math", "canvas"])
def test_unclosed_unshown_elements_hide_nothing(tag):
    assert [b.text for b in H.blocks(f"<p>a</p><{tag}><p>b</p>")] == ["a", "b"]
    assert [b.text for b in H.blocks(f"<p>a</p><{tag}><{tag}>x</{tag}>y</{tag}><p>b</p>")] == ["a", "b"]


@pytest.mark.parametrize("tag", ["script", "style", "title", "textarea", "iframe"])
def test_unclosed_raw_text_reaches_the_end(tag):
    assert [b.text for b in H.blocks(f"<p>a</p><{tag}><p>b</p>")] == ["a"]


def test_names_are_read_from_their_own_attributes():
    (b,) = H.blocks('<p data-class="nav" title="x class=footer" CLASS = main id=top>t</p>')
    assert b.path == ("t:p", "c:main", "c:top")


def test_forward_pass_by_plain_loops():
    """The network's outputs against one page at a time, block by block, in plain Python."""
    model = H.Labeller.fresh(np.random.default_rng(3))
    w = {k: v.astype(float) for k, v in model.w.items()}
    sigmoid = lambda x: 1 / (1 + math.exp(-x))

    def states(xs, d):
        n, out = H.HIDDEN, []
        h, c = [0.0] * n, [0.0] * n
        for x in xs:
            g = [w[f"b{d}"][j] + sum(x[i] * w[f"x{d}"][i][j] for i in range(len(x))) + sum(h[i] * w[f"h{d}"][i][j] for i in range(n)) for j in range(4 * n)]
            c = [sigmoid(g[n + k]) * c[k] + sigmoid(g[k]) * math.tanh(g[3 * n + k]) for k in range(n)]
            h = [sigmoid(g[2 * n + k]) * math.tanh(c[k]) for k in range(n)]
            out.append(h)
        return out

    pages = [H.describe(b) for b, _ in H.invented_pages(3, 5)]
    z, _ = model.forward(pages)
    for p, (paths, spoken, figures) in enumerate(pages):
        xs = []
        for rows, said, figure in zip(paths, spoken, figures, strict=True):
            mean = lambda name, at: list(sum(w[name][i] for i in at) / math.sqrt(len(at)))
            xs.append([*mean("path", rows), *mean("word", said), *map(float, figure)])
        forward, back = states(xs, "f"), states(xs[::-1], "b")[::-1]
        for t, (f, b) in enumerate(zip(forward, back, strict=True)):
            want = w["bias"][0] + sum(a * o for a, o in zip(f + b, w["out"], strict=True))
            assert abs(z[t, p] - want) < 1e-3
