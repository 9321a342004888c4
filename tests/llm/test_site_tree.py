import html
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from tallyloom.llm import site_tree as T
from tallyloom.llm.common import table

from .fixtures import prose

SCHEMA = "page_id bigint, url string, html string, text string, host string, nodes int, shape string, keep int, `a.b` int, _salt int"
EXTRA = ("t", "h", 1, "s", 2, 3, 4)


def extracted(spark, pages):
    df = spark.createDataFrame([(*p, *EXTRA) for p in pages], SCHEMA).repartition(3)
    return {r["page_id"]: r["text"] for r in T.extract(df).collect()}


def texts_of(source):
    """Text of a page that is alone on its host."""
    page = T.Page(source)
    marks = np.array([T._MARKS[m] for m in page.mark])
    text = np.full(len(marks), np.nan)
    for k, _, _ in page.texts:
        if not page.beside[k]:
            text[k] = 1.0
    keep = T.importances(np.array(page.parent), np.ones(len(marks)), np.ones(len(marks)), text, marks)
    return " ".join(t for k, t, _ in page.texts if keep[k] and not page.beside[k])


@pytest.mark.parametrize("source,text", [
    ("", ""), ("plain words", "plain words"), ("<p>one<p>two", "one two"), ("<p>a<b>b</b>c</p>", "abc"),
    ("<p>a<br>b &amp; c&nbsp;d &lt;e&gt; &eacute; &#x41;</p>", "a b & c d <e> é A"),
    ("<p>1 < 2 and 3 > 2</p>", "1 < 2 and 3 > 2"), ("<p>end <b", "end"), ("<p>end</p", "end"), ("<p>cut &am", "cut &am"),
    ("<head><title>t</title></head><body><p>x</p></body>", "x"), ("<title>t</title><p>x", "x"),
    ("<script>var a='</p><p>no';</script><style>p{}</style><p>x</p><!-- <p>no</p> -->", "x"),
    ("<p>a</p><script>never closed <p>b", "a"), ("<textarea>no</textarea><select><option>no</select><p>x", "x"),
    ("<ul><li>a<li>b</ul><table><tr><td>c<td>d<tr><td>e</table>", "a b c d e"),
    ("<p title='a>b' data-x=\"<p>\">x</p>", "x"), ("<P CLASS=lead>X</P>", "X"), ("<div>a<p>b</div>c", "a b c"),
    ("<nav><p>menu</p></nav><p>x</p><footer>f</footer><aside>s</aside><form>q<button>go</button></form>", "x"),
    ("<div class='cookie-notice'>c</div><div id=sidebar>s</div><div class='adSlot'>a</div><p>x</p>", "x"),
    ("<div class='content has-sidebar'><p>x</p></div><div class='main-nav'>m</div>", "x"),
    ("<header><h1>site</h1></header><article><header><h1>Title</h1></header><p>x</p><footer>f</footer></article>", "Title x"),
    ("<body>hello<div>intro</div><article><p>x</p></article><div>outro</div>bye</body>", "x"),
    ("<article><p>x</p></article><section class=comments><article><p>me too</p></article></section>", "x"),
    ("<form><article><p>x</p></article><input></form>", "x"), ("<main></main><p>x</p>", "x"),
    ("<ul><li><a href=a>one</a></li><li><a href=b>two</a></li></ul><p>x <a>link</a></p>", "x link"),
    ("<article><p>x <a href=a>y</a></p><ul><li><a>r</a></li><li><a>s</a></li></ul></article>", "x y r s"),
    ("<p>a</p></div></article></p><p>b</p>", "a b"), ("<p>a <span class=ad>buy</span> b</p>", "a b"),
])
def test_text_of_single_pages(source, text):
    assert texts_of(source) == text


def test_importances_against_a_plain_count(spark):
    """Presentation and content importances from plain counts over the trees of a host."""
    rng = random.Random(4)
    pages = []
    for k in range(40):
        parts = "".join(f"<p>{prose(rng, 8)}</p>" for _ in range(rng.randint(1, 4)))
        extra = "<div class=x>" + rng.choice(["often seen", "seen 12", "seen 13"]) + "</div>" if k % 3 else ""
        pages.append((k, "http://h/1", f"<div class=q>Menu of the site</div>{extra}<div class=z>{parts}</div>"))
    df = spark.createDataFrame([(*p, *EXTRA) for p in pages], SCHEMA)
    source = df.selectExpr("page_id", "url", "cast(html as binary) _html")
    got = {r["node"]: r for r in T.style_tree(source.mapInArrow(T._parse, T.PARSED)).collect()}
    styles, shown, on = defaultdict(Counter), defaultdict(Counter), Counter()
    for _, _, source in pages:
        page = T.Page(source)
        node, style = page.nodes()
        for n, s in zip(node, style):
            styles[n][s] += 1
        on.update(set(node))
        for n, text in {(node[k], re.sub(r"\d+", "0", t)) for k, t, _ in page.texts}:
            shown[n][text] += 1
    assert set(got) == set(styles)
    for n, counts in styles.items():
        m = sum(counts.values())
        own = -sum(c / m * math.log(c / m) for c in counts.values()) / math.log(m) if m > 1 else 1.0
        assert got[n]["own"] == pytest.approx(own) and got[n]["styles"] == len(counts)
        if n not in shown:
            assert got[n]["content"] is None
        else:
            entropies = [math.log(c) / math.log(on[n]) if on[n] > 1 else 0.0 for c in shown[n].values()]
            assert got[n]["content"] == pytest.approx(1 - sum(entropies) / len(entropies))


def test_unmarked_parts_are_told_by_their_host(spark):
    """Nothing but div: what the pages of a host share goes, what is theirs stays whole."""
    rng = random.Random(9)
    pages, expected = [], {}
    for host in ("a.org", "b.org"):
        menu, foot = prose(rng, 6), prose(rng, 12)
        for k in range(30):
            paragraphs = [prose(rng, rng.randint(1, 30)) for _ in range(rng.randint(1, 5))]
            advert = rng.choice([f"Buy {k} of these now", "Win a prize", "New shoes"])
            body = "".join(f"<div>{p}</div>" for p in paragraphs)
            source = f"<div class=k1>{menu}</div><div class=k2>{advert}</div><div class=k3>{body}</div><div class=k4>{foot} {1990 + k}</div>"
            pages.append((len(pages), f"https://{host}/{k}", source))
            expected[len(pages) - 1] = " ".join(paragraphs)
    assert extracted(spark, pages) == expected


def test_awkward_pages(spark):
    rng = random.Random(2)
    long = " ".join(f"<p>{prose(rng, 40)}</p>" for _ in range(3000))
    same = "<article><p>Same words</p></article><div>x</div>"
    pages = [
        (1, None, None), (2, "http://h.org", ""), (3, "no host", "<p>words</p>"), (4, "http://H.org:80/a", "<article>" + long + "</article>"),
        (5, "http://u@h.org/b", same), (6, "http://h.org/c", same), (6, "http://h.org/c", same), (None, None, "<p>no id</p>"),
        (8, "//h.org?x", "<div>" * 3000 + "deep"), (9, "http://h.org/d", "<p " * 2000), (10, "http://h.org/e", "\u0000 <p>퟿</p>"),
    ]
    got = extracted(spark, pages)
    assert (got[1], got[2], got[3], got[5], got[6], got[None]) == ("", "", "words", "Same words", "Same words", "no id")
    assert got[4] == " ".join(re.sub("<[^>]*>", "", long).split())
    assert got[8] == "deep" and got[9] == "" and got[10] == "\u0000 ퟿"
    df = spark.createDataFrame([(*p, *EXTRA) for p in pages], SCHEMA)
    assert T.extract(df).count() == len(pages)
    joined = {r["page_id"]: r["text"] for r in T.extract(df, broadcast=0).collect()}
    assert joined == got
    assert T.extract(df.limit(0)).collect() == []


def test_given_pages(spark):
    found = {r["page_id"]: r for r in T.op12(spark, "/root/testdata/sf0.001").collect()}
    pages = table(spark, "/root/testdata/sf0.001", "pages").collect()
    assert len(found) == len(pages)
    for p in pages:
        inner = re.search("<article>(.*?)</article>", p["html"], re.S)[1]
        text = " ".join(html.unescape(re.sub("<[^>]*>", " ", re.sub("</?b>", "", inner))).split())
        assert (found[p["page_id"]]["text"], found[p["page_id"]]["n_chars"]) == (text, len(text))
