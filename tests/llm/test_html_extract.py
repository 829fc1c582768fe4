import html
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from diagspark.llm import html_extract as H


@pytest.mark.parametrize("seed", range(6))
def test_suffix_array_equals_sorting(seed):
    rng = random.Random(seed)
    tokens = [rng.randrange(1 + seed) for _ in range(rng.randrange(1, 80))]
    order, lcp = H.suffix_array(np.array(tokens))
    assert order.tolist() == sorted(range(len(tokens)), key=lambda i: tokens[i:])
    for k in range(1, len(order)):
        a, b = tokens[order[k - 1] :], tokens[order[k] :]
        assert lcp[k] == next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))


def test_windows_are_counted_by_distinct_stream():
    streams = [list("abcdefgh"), list("abcdefgh"), list("xabcdefg"), list("abc"), [], list("qqqqqqqqq")]
    hashes, count = H.shared_windows(streams)
    want = Counter(w for s in {tuple(s) for s in streams} for w in {s[i : i + H.WINDOW] for i in range(len(s) - H.WINDOW + 1)})
    assert sorted(count) == sorted(want.values()) and len(set(hashes.tolist())) == len(want)


CASES = [
    ("<html><head><title>T</title><style>p{}</style><script>var t='</p>';</script></head><body><nav>Menu</nav><article><h1>A &amp; B</h1><p>One\n two&nbsp;three.</p>"
     "<p><b>Bold.<br><p>Next &lt;x&gt; &#233;<div class='ad'>Buy</div><aside>Side</aside><form>F<input></form><!-- c --></article><footer>&copy;</footer></body></html>", "A & B\nOne two three.\nBold.\nNext <x> é"),
    ("<main><p>x<span> y </span>z</p><section id='comments'><article class='comment'><p>Reader</p></article></section></main>", "x y z"),
    ("<article><p>cut off &amp", "cut off &"),
    ("<article><div role='complementary'>s</div><ul><li>1<li>2</ul><table><tr><td>a<td>b</table><p class='cookie-notice'>We</p><p>end</article>tail", "1\n2\na b\nend"),
    ("<article><p>a</p></nav><p>b</p></article>", "a\nb"), (None, ""), ("", ""), ("   ", ""), ("plain words", "plain words"), ("<p>", ""),
    ("<article><header><h1>gone</h1></header>kept <i>in</i>line<hr>rule</article>", "kept inline\nrule"),
    ("<body><div class='sidebar'>s</div><p>No article here</p><p>but text</p></body>", "No article here\nbut text"),
]


def test_awkward_pages(spark):
    rows = [(i, None if i % 5 == 0 else f"http://h{i}.example/{i}", h, "clash", 1) for i, (h, _) in enumerate(CASES)]
    rows += [(0, None, CASES[0][0], "clash", 1), (None, "x", CASES[1][0], None, None)]
    found = H.main_texts(spark.createDataFrame(rows, "page_id long, url string, html string, text string, row long"))
    want = [CASES[r[0] if r[0] is not None else 1][1] for r in rows]
    assert Counter((r["page_id"], r["url"], r["text"], r["n_chars"]) for r in found.collect()) == Counter((r[0], r[1], w, len(w)) for r, w in zip(rows, want, strict=True))


def test_a_very_long_page_is_read_whole(spark):
    body = [f"Paragraph {i} with words of its own {i * i}" for i in range(40_000)]
    page = "<nav>" + "<a>Menu</a>" * 5000 + "</nav><article>" + "".join(f"<p>{b}</p>" for b in body) + "</article>"
    deep = "<div>" * 3000 + "<article>" + "<section>" * 300 + "x" * 200_000 + "</section>" * 300 + "</article>" + "</div>" * 3000
    rows = [(1, "http://a/1", page), (2, "http://a/2", deep), (3, "http://a/3", "<p>" + " ".join(body) + "</p>")]
    found = {r["page_id"]: r["text"] for r in H.main_texts(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert found == {1: "\n".join(body), 2: "x" * 200_000, 3: " ".join(body)}


def test_articles_of_whole_table(spark):
    """Against a plain reading of the pages of the tables, whose articles hold paragraphs, line ends and bold text only."""
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    found = {r["page_id"]: r["text"] for r in H.main_texts(pages).collect()}
    for r in pages.collect():
        inner = re.search(r"<article>(.*?)(</article>|$)", r["html"], re.S)[1]
        blocks = [" ".join(html.unescape(re.sub(r"<[^>]*>", "", b)).split()) for b in re.split(r"</?(?:p|h1|br)>", inner)]
        assert found[r["page_id"]] == "\n".join(b for b in blocks if b)


@pytest.mark.parametrize("pages", [256, 4])
def test_repeated_runs_of_a_host_go(spark, monkeypatch, pages):
    """Pages without a marked article: what many share goes, what is unique stays, also in hosts that are split."""
    monkeypatch.setattr(H, "HOST_PAGES", pages)
    rng = random.Random(1)
    words = lambda n: " ".join("".join(rng.choices("abcdefghij", k=6)) for _ in range(n))
    menu, foot = words(12), words(20)
    rows, want = [], {}
    for i in range(30):
        own = [words(15) for _ in range(3)]
        rows.append((i, f"https://one.example/{i}", f"<div>{menu}</div>" + "".join(f"<div>{o}</div>" for o in own) + f"<div>{foot}</div>"))
        want[i] = "\n".join(own)
    rows.append((30, "https://other.example/", f"<div>{menu}</div>"))
    want[30] = menu
    copies = f"<div>{words(40)}</div>"
    for i in range(31, 36):
        rows.append((i, f"https://copy.example/{i}", copies))
        want[i] = copies[5:-6]
    found = H.main_texts(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert {r["page_id"]: r["text"] for r in found} == want
    assert {r["page_id"]: r["shared_blocks"] for r in found} == {i: 2 * (i < 30) for i in range(36)}


@pytest.mark.parametrize("pages", [256, 4])
def test_equal_streams_count_once_in_hosts_of_any_size(spark, monkeypatch, pages):
    """Pages that differ only in a nonce of their mark-up keep their text, also in hosts that are split."""
    monkeypatch.setattr(H, "HOST_PAGES", pages)
    words = " ".join(f"word{i}" for i in range(40))
    rows = [(i, f"https://one.example/{i}", f"<div data-nonce='{i}'>{words}</div>") for i in range(30)]
    rows += [(i, f"https://one.example/{i}", f"<div>{' '.join(f'own{i}x{k}' for k in range(20))}</div>") for i in range(30, 60)]
    found = {r["page_id"]: (r["text"], r["shared_blocks"]) for r in H.main_texts(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert found == {i: (h.split(">", 1)[1][:-6], 0) for i, _, h in rows}


@pytest.mark.parametrize("pages", [10, 256, 1000])
def test_windows_count_pages_in_hosts_of_any_size(spark, pages):
    """One menu on pages of different articles is boilerplate of the page that marks no article, too."""
    menu = " ".join(f"item{i}" for i in range(12))
    rows = [(i, f"https://one.example/{i}", f"<div>{menu}</div><article>{' '.join(f'own{i}x{k}' for k in range(9))}</article>") for i in range(pages)]
    own = " ".join(f"plain{k}" for k in range(30))
    rows.append((pages, "https://one.example/last", f"<div>{menu}</div><div>{own}</div>"))
    found = {r["page_id"]: (r["text"], r["shared_blocks"]) for r in H.main_texts(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert found[pages] == (own, 1) and found[0] == (" ".join(f"own0x{k}" for k in range(9)), 1)


def test_empty_table(spark):
    assert H.main_texts(spark.createDataFrame([], "page_id long, url string, html string").where(F.lit(True))).collect() == []
