"""Main text of web pages by a site style tree: what a host repeats on its pages is not the article.

Each page becomes a tree of block elements. The pages of a host are laid on top of each other: an element
node is told by its parent, by the sequence of elements it stands in (its style; repeated neighbours count
once) and by its own tag and class. Over all pages of the host a node gets two importances:

* presentation: the entropy of the styles of its children, in units of the most there could be;
* content, where it holds text: one minus the mean entropy of its texts over the pages. A text that every
  page shows has entropy 1, a text of one page has 0. Digits do not tell texts apart.

Both are sums of logarithms over counts, so they are added up before they are shuffled, and a host with a
third of all pages is one row per node and text. The importance of a branch goes up the tree as in the
published method, each page following its own styles: the more styles a node has, the more its own
importance decides; the fewer, the more its children do. A branch that is unimportant as a whole, and whose
parts all are, is cut from the pages.

Markup that says what a part is weighs in before the entropy does, because no host of one page could tell
otherwise: menus, headers, footers, sidebars, notices, adverts, forms and comments (by tag, role or a word
in class or id) are worth ``NOISE`` of their entropy, an article at least ``ARTICLE``; where a page marks an
article, parts outside it are noise; where it does not, lists and blocks of links only are. Entropy decides
about everything that is not marked.

Branches are judged once per host and shape of page. The decisions are measured: up to ``BROADCAST`` bytes
they travel to the pages, beyond that both meet in a join with a salt.

Defined results: null, empty and broken html gives what text there is, by the rules of open and implied
end tags; a tag cut off by the end of the page is no text. Text inside scripts, styles and the head is
dropped, comments too. Pages without a host in the url belong to one host. A page that is repeated counts
like several pages, and each row gets its result. An empty table gives no rows. Only the three columns of
``pages`` are read, so that others may have any name.
"""

from __future__ import annotations

import hashlib
import html
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.llm.common import slices, table
from tallyloom.session import ship_package, store

#: A branch below this importance is cut.
CUT = 0.5
#: Weight of entropy in marked noise, and least importance of a marked article.
NOISE, ARTICLE = 0.25, 0.75
#: Weight of the children's importance, to the power of the number of styles.
DECAY = 0.9
#: Parts that the decisions on one shape are dealt to, so that a common shape is not one task.
SALTS = 32
#: Bytes up to which the decisions are sent to all executors, and bytes of a row beside one for each element.
BROADCAST, ROW_COST = 16 << 20, 100

# Elements by what they do to text.
_VOID = frozenset("area base br col embed frame hr img input link meta param source track wbr".split())
_RAW = frozenset("script style textarea title noscript iframe xmp noembed noframes template svg math select".split())
_INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark q rp rt ruby s samp small span strike "
    "strong sub sup time tt u var wbr".split()
)
_HEAD_ONLY = frozenset("head script style title noscript iframe template svg math select textarea xmp noembed noframes object audio video canvas".split())
_CLOSES_P = frozenset(
    "address article aside blockquote body center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 "
    "h4 h5 h6 header hgroup hr html main menu nav ol p pre section summary table ul li dt dd td th tr tbody thead tfoot".split()
)
#: An opening tag closes these, up to a container.
_CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
    "tbody": ({"tr", "td", "th", "thead", "tbody"}, {"table"}), "option": ({"option"}, {"select"}),
    "body": ({"head"}, {"html"}),
}
#: A closing tag looks for its opening one no further up than these.
_SCOPES = {"p": frozenset("div section article main body table ul ol dl".split()), "li": frozenset("div section article main body table".split())}

# What marks noise and articles.
_NOISE_TAGS = frozenset("nav footer aside form button fieldset dialog menu label".split()) | _HEAD_ONLY
_NOISE_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
_NOISE_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense banner sponsor sponsored promo promotion nav navbar "
    "navigation menu breadcrumb breadcrumbs pagination pager header masthead topbar footer bottombar copyright sidebar "
    "aside cookie cookies consent gdpr notice alert popup modal overlay newsletter subscribe subscription signup login "
    "search comment comments commentlist disqus reply replies respond share sharing social related recommended "
    "recommendations widget widgets toolbar skip form".split()
)
_ARTICLE_TAGS = frozenset(("article", "main"))
_ARTICLE_WORDS = frozenset("article articlebody content main post entry story body".split())
#: Words of noise that a part of an article may carry too, and words that take a name back.
_HEADINGS = frozenset(("header", "banner", "masthead"))
_NEGATIONS = frozenset("no not has with without".split())

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*)(?P<attrs>(?:\"[^\"]*\"|'[^']*'|[^>\"'])*+)>"
    r"|<[!?/][^>]*(?:>|\Z)|</?[a-zA-Z][^>]*(?P<open>>|\Z)",
    re.S,
)
_ATTR = re.compile(r"(?:^|\s)(class|id|role|itemprop)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+)", re.I)
_WORDS = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+")
_DIGITS = re.compile(r"\d+")


def _number(*parts: object) -> int:
    """64 bits of a digest, as a signed number."""
    joined = "\x1f".join(map(str, parts)).encode("utf-8", "surrogatepass")
    return int.from_bytes(hashlib.blake2b(joined, digest_size=8).digest(), "little", signed=True)


class Page:
    """The block elements of a page in order, and its runs of text.

    ``mark`` of an element is "noise", "article" or empty; ``texts`` are (element, text, text outside links).
    """

    def __init__(self, source: str):
        self.tag, self.parent, self.words, self.mark = ["#page"], [-1], [""], [""]
        self.texts: list[tuple[int, str, bool]] = []
        self._stack = [0]
        self._parts: list[str] = []
        self._linked = 0
        self._bare = False
        self._read(source)
        self._mark_outside()

    def _read(self, source: str) -> None:
        at = 0
        while at < len(source):
            found = _TOKEN.search(source, at)
            if not found:
                self._text(source[at:])
                break
            if found.start() > at:
                self._text(source[at : found.start()])
            at = found.end()
            tag = found["tag"]
            if tag is None:
                continue
            tag = tag.lower()
            if found["end"]:
                self._close(tag)
                continue
            self._open(tag, found["attrs"] or "")
            if tag in _RAW and not (found["attrs"] or "").rstrip().endswith("/"):
                closing = re.compile(rf"</{re.escape(tag)}(?=[\s/>]|\Z)", re.I).search(source, at)
                # An unclosed script hides all that follows; other raw elements are then taken as empty.
                if closing:
                    at = closing.start()
                elif tag in ("script", "style"):
                    at = len(source)
                self._close(tag)
        self._flush()

    def _text(self, part: str) -> None:
        part = html.unescape(part)
        self._parts.append(part)
        if not self._linked and not part.isspace():
            self._bare = True

    def _flush(self) -> None:
        """End the run of text: one block."""
        if self._parts:
            text = " ".join("".join(self._parts).split())
            if text:
                self.texts.append((self._stack[-1], text, self._bare))
        self._parts, self._bare = [], False

    def _open(self, tag: str, attrs: str) -> None:
        if tag in _VOID:
            if tag == "br":
                self._parts.append(" ")
            elif tag == "hr":
                self._flush()
            return
        found = {name.lower(): value.strip("\"'") for name, value in _ATTR.findall(attrs)} if attrs else {}
        names = [name for k in ("class", "id", "itemprop") for name in found.get(k, "").split()]
        names = [[w.lower() for w in _WORDS.findall(name)] for name in names]
        words = " ".join(w for name in names for w in name)
        mark = self._marked(tag, names, found.get("role", "").lower())
        if tag in _INLINE and mark != "noise":
            self._linked += tag == "a"
            return
        self._flush()
        if tag in _CLOSES_P:
            self._close_within({"p"}, {"table", "button"}, tag)
        if tag in _CLOSES:
            self._close_within(*_CLOSES[tag], tag)
        self._linked = 0
        self._stack.append(len(self.tag))
        self.tag.append(tag)
        self.parent.append(self._stack[-2])
        self.words.append(words)
        self.mark.append(mark)

    def _close_within(self, which: set[str], limits: set[str], tag: str) -> None:
        """Close open elements that the new tag ends, no further up than a container."""
        for depth in range(len(self._stack) - 1, 0, -1):
            name = self.tag[self._stack[depth]]
            if name in which:
                del self._stack[depth:]
            elif name in limits or name in ("article", "section", "div", "main", "body", "blockquote"):
                break

    def _close(self, tag: str) -> None:
        if tag == "a":
            self._linked = max(0, self._linked - 1)
        limits = _SCOPES.get(tag, ())
        for depth in range(len(self._stack) - 1, 0, -1):
            name = self.tag[self._stack[depth]]
            if name == tag:
                self._flush()
                del self._stack[depth:]
                self._linked = 0
                return
            if name in limits:
                return

    def _marked(self, tag: str, names: list[list[str]], role: str) -> str:
        """What tag, role and the words of each name tell: the last word of a name says what it is."""
        if tag in ("html", "body"):
            return ""
        if tag in _NOISE_TAGS or role in _NOISE_ROLES:
            return "form" if tag == "form" else "noise"
        named = [set(words) & _NOISE_WORDS for words in names if words and words[0] not in _NEGATIONS]
        told = set().union(*named)
        comments = told & {"comment", "comments"}
        if (tag in _ARTICLE_TAGS or role in ("main", "article") or ["article", "body"] in names) and not comments:
            return "article"
        if tag == "header":
            return "heading"
        content = any(words and words[-1] in _ARTICLE_WORDS and not set(words) & _NOISE_WORDS for words in names)
        if told and (comments or not content):
            return "heading" if told <= _HEADINGS else "noise"
        return ""

    def _mark_outside(self) -> None:
        """Settle the marks that depend on the rest of the page."""
        n = len(self.tag)
        inside, noisy = [False] * n, [False] * n
        for k in range(1, n):  # parents come before their children
            noisy[k] = noisy[self.parent[k]] or self.mark[k] == "noise"
            inside[k] = not noisy[k] and (inside[self.parent[k]] or self.mark[k] == "article")
        holds = [False] * n  # an article with text
        bare, linked = [0] * n, [0] * n
        for k, _, free in self.texts:
            holds[k] = holds[k] or inside[k]
            bare[k] += free
            linked[k] += not free
        for k in range(n - 1, 0, -1):
            up = self.parent[k]
            holds[up] = holds[up] or holds[k]
            bare[up] += bare[k]
            linked[up] += linked[k]
        self.marked = holds[0]
        for k in range(1, n):
            around = holds[k] and not inside[k]
            if self.mark[k] == "heading":
                self.mark[k] = "" if inside[k] else "noise"
            if self.mark[k] == "form":  # some sites wrap the whole page in one
                self.mark[k] = "" if around else "noise"
            if inside[k] or around or self.mark[k] == "noise":
                continue
            if self.marked or (linked[k] > 1 and not bare[k]):
                self.mark[k] = "noise"
        # Text that lies beside the article, in an element that holds it, has no branch of its own.
        self.beside = [self.marked and holds[k] and not inside[k] for k in range(n)]

    def nodes(self) -> tuple[list[int], list[int]]:
        """Number of each element in the site's tree, and of the style of its children."""
        n = len(self.tag)
        label = [f"{t}.{w}" for t, w in zip(self.tag, self.words)]
        children: list[list[int]] = [[] for _ in range(n)]
        for k in range(1, n):
            children[self.parent[k]].append(k)
        style, node = [0] * n, [_number("page")] + [0] * (n - 1)
        for k in range(n):
            sequence: list[str] = []
            places = []
            for c in children[k]:
                if not sequence or sequence[-1] != label[c]:
                    sequence.append(label[c])
                places.append(len(sequence))
            style[k] = _number(*sequence)
            for c, place in zip(children[k], places):
                node[c] = _number(node[k], style[k], place)
        return node, style


def importances(
    parent: np.ndarray, own: np.ndarray, styles: np.ndarray, text: np.ndarray, mark: np.ndarray, times: np.ndarray | None = None
) -> np.ndarray:
    """Which elements of a page are kept; each may stand for several that agree.

    ``own`` is the presentation importance of each element, ``styles`` how many styles it has on the host,
    ``text`` its content importance (nan: no text). ``mark`` is 1 for an article, -1 for noise, else 0.
    Parents come before their children.
    """
    n = len(parent)
    times = np.ones(n) if times is None else times
    total, count = np.zeros(n), np.zeros(n)
    whole, best = np.zeros(n), np.zeros(n)
    for k in range(n - 1, -1, -1):
        share = DECAY ** styles[k]
        if count[k]:
            value = (1 - share) * own[k] + share * total[k] / count[k]
            if not np.isnan(text[k]):
                value = max(value, text[k])
        else:
            value = 0.0 if np.isnan(text[k]) else text[k]
        if mark[k] < 0:
            value *= NOISE
        elif mark[k] > 0:
            value = max(value, ARTICLE)
        whole[k] = value
        best[k] = max(best[k], value) if mark[k] >= 0 else value
        if k and (count[k] or not np.isnan(text[k])):
            up = parent[k]
            total[up] += value * times[k]
            count[up] += times[k]
            best[up] = max(best[up], best[k])
    keep, article = np.ones(n, dtype=bool), mark > 0
    for k in range(1, n):
        up = parent[k]
        article[k] = (article[k] or article[up]) and mark[k] >= 0
        keep[k] = keep[up] and (article[k] or best[k] >= CUT)
    return keep


# Spark -----------------------------------------------------------------------------------------

_TEXT = pa.struct([("at", pa.int32()), ("text", pa.string()), ("feature", pa.int64()), ("first", pa.bool_())])
_NODE = pa.struct([("node", pa.int64()), ("style", pa.int64()), ("parent", pa.int32()), ("mark", pa.int8()), ("holds", pa.bool_()), ("times", pa.int32())])
_PARSED = pa.schema(
    [
        ("page_id", pa.int64()), ("url", pa.string()), ("host", pa.string()), ("shape", pa.int64()),
        ("nodes", pa.list_(_NODE)), ("texts", pa.list_(_TEXT)),
    ]
)
PARSED = (
    "page_id bigint, url string, host string, shape bigint, "
    "nodes array<struct<node:bigint,style:bigint,parent:int,mark:tinyint,holds:boolean,times:int>>, "
    "texts array<struct<at:int,text:string,feature:bigint,first:boolean>>"
)
_HOST = re.compile(r"^(?:[a-z][a-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", re.I)
_MARKS = {"noise": -1, "article": 1, "heading": 0, "": 0}


def host_of(url: str | None) -> str:
    found = _HOST.match(url or "")
    return found[1].lower() if found else ""


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "_html"):
        rows = []
        for page_id, url, source in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "_html"))):
            page = Page(source.decode("utf-8", "replace"))
            node, style = page.nodes()
            marks = [_MARKS[m] for m in page.mark]
            holds = [False] * len(node)
            for k, _, _ in page.texts:
                holds[k] = not page.beside[k]
            # Elements that agree in all that is judged are one slot, so that long and short articles have one shape.
            slots: dict[tuple, int] = {}
            slot, times = [], []
            for k, key in enumerate(zip(node, style, marks, holds)):
                at = slots.setdefault((slot[page.parent[k]] if k else -1, *key), len(slots))
                slot.append(at)
                if at == len(times):
                    times.append(0)
                times[at] += 1
            texts, shown = [], set()
            for k, text, _ in page.texts:
                if holds[k]:
                    feature = _number(_DIGITS.sub("0", text))
                    texts.append({"at": slot[k], "text": text, "feature": feature, "first": (node[k], feature) not in shown})
                    shown.add((node[k], feature))
            nodes = [
                {"parent": parent, "node": n, "style": st, "mark": m, "holds": h, "times": t}
                for (parent, n, st, m, h), t in zip(slots, times)
            ]
            shape = _number(*slots, *times)
            rows.append((page_id, url, host_of(url), shape, nodes, texts))
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _PARSED)], schema=_PARSED)


def _judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        kept = []
        for nodes in batch.column("nodes").to_pylist():
            nodes.sort(key=lambda r: r["at"])
            column = lambda name: np.array([r[name] for r in nodes], dtype=float)  # noqa: B023, E731
            parent = column("parent").astype(np.int64)
            kept.append(importances(parent, column("own"), column("styles"), column("content"), column("mark"), column("times")).tolist())
        yield pa.RecordBatch.from_arrays(
            [batch.column("host"), batch.column("shape"), pa.array(kept, pa.list_(pa.bool_()))], ["host", "shape", "keep"]
        )


def _entropy(n: str, weighted: str) -> F.Column:
    """Entropy of shares n_i / N from N and the sum of n_i ln n_i."""
    total = F.sum(n)
    return F.log(total) - F.sum(weighted) / total


def style_tree(parsed: DataFrame) -> DataFrame:
    """(host, node, own, styles, content): the importances of the element nodes of every host."""
    seen = parsed.select("host", F.explode("nodes").alias("e"))
    styles = seen.groupBy("host", F.col("e.node").alias("node"), F.col("e.style").alias("style")).agg(F.sum("e.times").alias("n"))
    styles = styles.withColumn("w", F.col("n") * F.log("n"))
    elements = styles.groupBy("host", "node").agg(
        F.sum("n").alias("m"), F.count(F.lit(1)).alias("styles"), _entropy("n", "w").alias("h")
    )
    own = F.when(F.col("m") > 1, F.col("h") / F.log(F.col("m").cast("double"))).otherwise(1.0)
    # On how many pages each text stands at a node.
    firsts = F.filter("texts", lambda t: t["first"])
    at = F.transform(firsts, lambda t: F.struct(F.element_at("nodes", t["at"] + 1)["node"].alias("node"), t["feature"].alias("feature")))
    shown = parsed.select("host", F.explode(at).alias("e"))
    texts = shown.groupBy("host", F.col("e.node").alias("node"), F.col("e.feature").alias("feature")).agg(F.count(F.lit(1)).alias("n"))
    # A text that n of the m pages show has entropy ln n / ln m.
    content = texts.groupBy("host", "node").agg(F.avg(F.log("n")).alias("mean"))
    pages = parsed.select("host", F.explode(F.array_distinct(F.transform("nodes", lambda e: e["node"]))).alias("node"))
    pages = pages.groupBy("host", "node").agg(F.count(F.lit(1)).alias("pages"))
    both = elements.join(pages, ["host", "node"]).join(content, ["host", "node"], "left")
    shared = F.when(F.col("pages") > 1, 1.0 - F.col("mean") / F.log(F.col("pages").cast("double"))).otherwise(1.0)
    return both.select("host", "node", own.alias("own"), "styles", F.when(F.col("mean").isNotNull(), shared).alias("content"))


def extract(pages: DataFrame, broadcast: int = BROADCAST) -> DataFrame:
    """page_id, url and the main text of every page."""
    ship_package(pages.sparkSession)
    source = pages.select(
        F.col("page_id").cast("bigint").alias("page_id"), F.col("url").cast("string").alias("url"),
        F.coalesce(F.col("html"), F.lit("")).cast("binary").alias("_html"),
    )
    parsed = store(source.mapInArrow(_parse, PARSED), "pages")
    # One row per host and shape: pages of one shape have the same elements, and texts in the same ones.
    shapes = parsed.groupBy("host", "shape").agg(F.any_value("nodes").alias("nodes"))
    elements = shapes.select("host", "shape", F.posexplode("nodes").alias("at", "e"))
    judged = (
        elements.select("host", "shape", "at", "e.node", "e.parent", "e.mark", "e.holds", "e.times")
        .join(style_tree(parsed), ["host", "node"])
        .withColumn("content", F.when(F.col("holds"), F.col("content")))
        .groupBy("host", "shape")
        .agg(F.collect_list(F.struct("at", "parent", "own", "styles", "content", "mark", "times")).alias("nodes"))
        .mapInArrow(_judge, "host string, shape bigint, keep array<boolean>")
    )
    judged = store(judged, "judged")
    if (judged.agg(F.sum(F.size("keep") + ROW_COST)).first()[0] or 0) <= broadcast:
        joined = parsed.join(F.broadcast(judged), ["host", "shape"])
    else:
        dealt = judged.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        salted = parsed.withColumn("_salt", F.pmod(F.xxhash64("page_id", "url"), F.lit(SALTS)).cast("int"))
        joined = salted.join(dealt, ["host", "shape", "_salt"])
    kept = F.filter("texts", lambda t: F.element_at("keep", t["at"] + 1))
    return joined.select("page_id", "url", F.array_join(F.transform(kept, lambda t: t["text"]), " ").alias("text"))


def op12(spark: SparkSession, directory: str) -> DataFrame:
    found = extract(table(spark, directory, "pages"))
    return found.select("page_id", "url", "text", F.length("text").cast("bigint").alias("n_chars"))


QUERIES = {"op12_site_style_tree": op12}
