"""HTML extraction: markup cases by hand, repetition against brute force."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from helpers import prose
from vekta.llm import html_text
from vekta.llm.html_text import extract, page_blocks

PAGES = "page_id long, url string, html string"


def main(html):
    return [t for t, z in page_blocks(html) if z == html_text.MAIN]


def run(spark, rows):
    pages = spark.createDataFrame(rows, PAGES).selectExpr("*", "1 AS uid", "2 AS ID", "3 AS main", "4 AS start", "5 AS host")
    return {(r["page_id"], r["url"]): r["text"] for r in extract(pages).collect()}


@pytest.mark.parametrize("html,want", [
    ("<article><h1>T</h1><p>a  b\n c<p>d</article>", ["T", "a b c", "d"]),
    ("<article><p><b>lead.<br><p>next &amp; &lt;x&gt; &eacute;&#233;&#x1F600; &am &amp", ["lead.", "next & <x> éé😀 &am &"]),
    ('<nav>m</nav><header>h</header><main><p>x</p><aside>s</aside><form>f<input value="v"><button>go</button></form></main><footer>e</footer>', ["x"]),
    ("<article><p>one</p><script>var t='</p><p>no';</script><style>p{}</style><!-- <p>no</p> --><p>two</p></article>", ["one", "two"]),
    ('<article><div class="ad-box">buy</div><p>a</p><div id="comments"><article><p>first!</p></article></div><section class="user comments">c</section></article>', ["a"]),
    ('<div class="page has-sidebar no-comments"><article class="post with-ads"><p>a</p></article><div class="sideBar sidebar">s</div></div>', ["a"]),
    ('<nav><ul><li>menu<article><p>a</p></article>', ["a"]),
    ('<aside><article>teaser</article></aside><article>a</article>', ["a"]),
    ('<article><p title="x > y" class=\'q>\'>a</p><p data-x=it\'s>b</p></article>', ["a", "b"]),
    ("<article><ul><li>x<li>y</ul><table><tr><td>1<td>2<tr><td>3</table><blockquote>q</blockquote><pre> k \n l</pre></article>", ["x", "y", "1 2", "3", "q", "k l"]),
    ("<article>a<em>b</em>c <a href=x>d</a><br/>e</article>", ["abc d e"]),
    ("<article><p>2 < 3 and <3 hearts</p><p>cut off <span cla", ["2 < 3 and <3 hearts", "cut off"]),
    ("<article><p>a</p><!-- never closed <p>b</p></article>", ["a"]),
    ('<article><header><h1>T</h1></header><p>a</p><footer>tags</footer><div role="alert">n</div><p hidden>h</p><p style="display: none">i</p></article>', ["T", "a"]),
    ('<main><h1>T</h1><article><p>' + "word " * 30 + '</p></article><div>more</div></main>', [" ".join(["word"] * 30)]),
    ('<ARTICLE><P CLASS="Cookie-Notice">we use</P><P>a\xa0 b</P></ARTICLE>', ["a b"]),
    ('<div itemprop="articleBody"><p>a</p></div><p>b</p>', ["a"]),
    ('<article><svg><text>s</text></svg><template><p>t</p></template><noscript>n</noscript><select><option>o</select><p>a</p></article>', ["a"]),
    (None, []), ("", []), ("<", []), ("plain", []), ("<article>", []),
])
def test_marked_pages(html, want):
    assert main(html) == want


def test_open_pages_keep_what_is_no_menu():
    blocks = page_blocks('<ul><li><a href=a>One link</a></li></ul><p>Text with a <a href=b>link</a> inside.</p><div class="menu">m</div>')
    assert blocks == [("One link", html_text.FURNITURE), ("Text with a link inside.", html_text.OPEN), ("m", html_text.FURNITURE)]


def brute_open(rows):
    """Main text of pages without marked text, by looking up every run of tokens on the other pages of the host."""
    def host(u):
        return u.split("://", 1)[1].split("/")[0].lower() if u and "://" in u else ""

    read = []
    for i, url, h in rows:
        blocks = page_blocks(h)
        kept = [t for t, z in blocks if z == html_text.MAIN]
        stream = [(t, z) for t, z in blocks if z != html_text.MAIN]
        open_ = [t for t, z in stream if z == html_text.OPEN]
        read.append((i, url, kept, stream, "\n\n".join(kept) if not open_ else max(open_, key=lambda t: (len(t), t))))
    k, seen = html_text.MIN_RUN, {}
    for i, url, _, stream, core in read:
        words = [w for t, _ in stream for w in t.split()]
        for a in range(len(words) - k + 1):
            seen.setdefault((host(url), *words[a:a + k]), set()).add(core)
    out = {}
    for i, url, kept, stream, core in read:
        words = [w for t, _ in stream for w in t.split()]
        covered = np.zeros(len(words), bool)
        for a in range(len(words) - k + 1):
            if len(seen[(host(url), *words[a:a + k])]) > 1:
                covered[a:a + k] = True
        texts, at = [], 0
        for t, z in stream:
            n = len(t.split())
            if z == html_text.OPEN and covered[at:at + n].mean() < html_text.COVERED:
                texts.append(t)
            at += n
        out[(i, url)] = "\n\n".join(kept or texts)
    return out


def open_rows():
    g = random.Random(2)
    notice, legal = "We use cookies to make this site work better for you today", "All content here belongs to the owners and may not be copied at all"
    rows = []
    for i in range(60):
        body = "".join(f"<p>{prose(i * 10 + k, g.randint(1, 40))}</p>" for k in range(g.randint(1, 4)))
        extra = f"<div>{legal} visit {i}</div>" if i % 3 else ""
        host = "Hot.example.com" if i % 2 else f"h{i % 5}.example.com"
        rows.append((i, f"https://{host}/p{i}?q", f"<body><div>{notice}</div><p>short line</p>{body}{extra}</body>"))
    rows += [(100 + i, "https://hot.example.com/copy", rows[1][2]) for i in range(8)]                # copies are one page
    rows += [(200 + i, "https://hot.example.com/a", f"<div>{notice}</div><article><p>{prose(900 + i, 9)}</p></article>") for i in range(3)]
    rows += [(300, None, "<p>no url here but some words to read in this text</p>"), (301, "no scheme", "<p>x</p>"),
             (302, "https://x.example.com", None), (302, "https://x.example.com", None), (303, "https://x.example.com", ""),
             (None, "https://lone.example.com/", "<p>a page alone on its host keeps all that it says</p>"),
             (304, "https://long.example.com/", "<p>" + prose(77, 20_000) + "</p>")]
    return rows


def test_repetition_equals_brute_force(spark, monkeypatch):
    rows = open_rows()
    want = brute_open(rows)
    got = run(spark, rows)
    assert got == want
    assert all("cookies" not in t for (i, u), t in got.items() if i is not None and i < 300)
    assert got[(101, "https://hot.example.com/copy")] == got[(1, rows[1][1])] != ""


def test_blocks_of_pages_do_not_change_the_result(spark):
    rows = open_rows()
    pages = spark.createDataFrame(rows, PAGES)
    read = html_text.staged(html_text.read_pages(pages.repartition(7)), "t")
    many = html_text.covered_places(html_text.repeat_classes(read))
    one = html_text.covered_places(html_text.repeat_classes(read.coalesce(1)))
    form = lambda df: sorted((r["uid"], sorted(r["covered"])) for r in df.collect())
    assert form(many) == form(one) != []


def test_suffix_classes_equal_brute_force():
    g = np.random.default_rng(1)
    for n, run_ in ((1, 3), (50, 1), (300, 3), (300, 8), (64, 5)):
        tokens = g.integers(0, 3, n)
        order, first = html_text.suffix_classes(tokens, run_)
        starts = [tuple(tokens[i:i + run_].tolist()) for i in order]
        assert sorted(order.tolist()) == list(range(n)) and starts == sorted(starts)
        assert first.tolist() == [i for i in range(n) if i == 0 or starts[i] != starts[i - 1]]


def test_empty_table_and_char_counts(spark):
    assert run(spark, []) == {}
    df = extract(spark.createDataFrame([(1, "u", "<article>é😀</article>")], PAGES))
    assert df.select(F.char_length("text")).first()[0] == 2
