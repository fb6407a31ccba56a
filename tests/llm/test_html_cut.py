"""HTML extraction: what the cut decides against the classifier's own sign, names that only look like boilerplate, and linear time."""

import time

from quire.llm import html_extract as h

LONG = "These words stand in a paragraph, and there are many of them. "


def test_cut_changes_labels(monkeypatch):
    calls, flips = [], []
    dinic, cut = h._dinic, h.minimum_cut
    monkeypatch.setattr(h, "_dinic", lambda *a: calls.append(1) or dinic(*a))

    def spy(odds, edges):
        labels = cut(odds, edges)
        flips.extend(k for k, (z, x) in enumerate(zip(odds, labels, strict=True)) if (z > 0) != x)
        return labels

    monkeypatch.setattr(h, "minimum_cut", spy)
    page = f"<body><div><p>{LONG * 4}</p><div>plain label</div><p>{LONG * 4}</p><div>so</div><div>it</div><div>goes</div><p>{LONG * 4}</p></div></body>"
    got = h.extract(page)
    assert "plain label" in got and len(flips) >= 1  # a weak block between strong ones goes with them
    alone = h.extract("<body><div>plain label</div></body>")
    assert alone == ""
    weak = "".join(f"<p>Some words here now {k}.</p><div>one two three {k}</div>" for k in range(6))
    h.extract(f"<body><div>{weak}</div></body>")
    assert calls


def test_names_inside_an_article():
    for name in ('section id="discussion"', 'div class="text related-work"', 'section class="legal-analysis"', "section hidden", 'div style="display:none"'):
        tag = name.split()[0]
        assert LONG.strip() in h.extract(f"<article><h1>Title</h1><p>{LONG * 3}</p><{name}><p>{LONG * 3}</p></{tag}></article>").split("\n\n")[-1]
    for name in ('div class="comments"', 'section id="comment-list"', 'div class="related-posts"', 'div class="social-share-buttons"', 'div id="newsletterSignup"', 'aside class="x"'):
        tag = name.split()[0]
        assert "Other" not in h.extract(f"<article><h1>Title</h1><p>{LONG * 3}</p><{name}><p>Other text is here. It is not long.</p></{tag}><p>{LONG * 3}</p></article>")


def test_text_of_embedded_elements_stays():
    assert "The sum is x=3 in all." in h.extract(f"<article><p>{LONG * 3}</p><p>The sum is <math>x=3</math> in all.</p></article>")
    assert "see fallback text" in h.extract(f"<article><p>{LONG * 3} see <object>fallback text</object></p></article>")


def test_linear_time():
    for page in ('<p "' * 100_000, "<div>" * 50_000 + "</span></p>" * 50_000, "<p '\"" * 50_000 + ">", "<form><li>" * 30_000, "<li>" + "<div>" * 30_000 + "<li>" * 30_000, "<a b='" * 60_000 + "<p>x>"):
        began = time.process_time()
        h.extract(page)
        assert time.process_time() - began < 5
