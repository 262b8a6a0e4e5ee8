"""Main text of web pages by a site style tree.

The DOMs of a host are merged: an element node of the tree is a path of labels (tag,
classes, id with digits as ``#``; unstyled siblings are told apart by their place, from
the ``PLACES``-th on they share a node). It keeps, over the host's pages, how often each
presentation style (sequence of child labels) and each content (digest of the text
below, noise left out) occurs. Both entropies are divided by the log of the number of
pages m; the larger is the node's entropy e, and its importance is ``1 - (1 - e) *
(1 - 1 / m)``: 1 on a host with one page, near 0 for a node that is the same on many.
Pages whose main texts are equal count once, so an article that a host publishes
at many addresses is no evidence against itself.

A branch goes if its importance and its prior together are below ``LEAST``. Priors:

* menus, forms, scripts, styles and the like by tag; headers, footers, sidebars, dialogs
  by tag or role; elements with ``hidden`` or ``aria-hidden=true``: -1 wherever they are.
  Inside an article a header has -0.3, as it may hold the headline.
* a class or id all of whose words are noise or plain filler ("cookie-notice",
  "site-footer"; never "related-work" or "has-sidebar"): -1; words that may also name
  content ("related", "share") have -0.5 inside an article, unless most of their text is links.
* a branch inside an article with half of the article's text or more: +1.

Entropy alone cannot tell an article from an advert that differs on every page, nor keep
one that a site repeats: priors are for that, and the tree decides on all other
branches of every page, inside articles as well. The main text is that of the outermost
``article`` elements (of ``main`` where its articles hold less than half of it), else of
the page. Noise by name, role or form that holds the only article is not noise; nor,
without any article, what holds over half of the page's text. Where entropy would
remove all blocks of a page, they stay.

Plan: one pass parses pages and counts in each partition; rows are finer than a host,
so one with a third of all pages spreads. Only nodes of low importance are kept, joined
to their host's pages (AQE splits a hot host or broadcasts few nodes); if there are
none, the second pass is a map. Parsing is linear in a page's length, whatever its markup.

Defined results: null html = empty text; a page without main text = empty text; an
element left open ends with its parent; a tag without its ``>`` is text; what opens
below ``DEEPEST`` open elements is put beside, not below; white space is Unicode's, the
no-break space included; a null page_id or url is kept (host '' as any that cannot be
read); very long pages are held one at a time; empty table = no rows; repeated rows
give repeated rows; extra columns, whatever their names, are ignored.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, table

LEAST = 0.25
#: Nodes whose prior could still take them below LEAST are kept for the second pass.
WEAK = -0.5
PLACES, DEEPEST = 8, 512
SCHEMA = "page_id bigint, url string, text string, n_chars bigint"

_NAME = re.compile(r"[a-zA-Z][^\s/>]*+")
_ATTRIBUTE = re.compile(r"""[\s/]*+(?:(>)|([^\s/>][^\s=/>]*+)(?:\s*+=\s*+("[^"]*+"|'[^']*+'|[^\s>]*+))?+)""")
_RAW = {t: re.compile(rf"</{t}(?=[\s/>])[^>]*+>", re.I) for t in "script style textarea title xmp iframe noembed noframes".split()}
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_FLOW = frozenset("p h1 h2 h3 h4 h5 h6 li dt dd tr td th tbody thead tfoot caption pre blockquote option legend figcaption summary hr html body".split())
_BLOCK = _FLOW | frozenset(
    "address article aside center details dialog div dl fieldset figure footer form header hgroup main menu nav ol section select table ul".split()
)
#: A paragraph is open at most up to one of these.
_HOLDS = frozenset("p article main div section td th li body button".split())
#: An opening tag ends an open element of these kinds, up to the named limits.
_ENDS = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}
_MAIN = frozenset(["article", "main"])
_HARD = frozenset("head script style noscript template nav button select option input textarea iframe object svg canvas title xmp noembed noframes".split())
_SOFT = frozenset("header footer aside form menu dialog".split())
_ROLES = frozenset("navigation banner contentinfo complementary search form alert dialog alertdialog menu menubar".split())
_STRONG = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion cookie cookies consent gdpr popup modal newsletter subscribe"
    " nav navbar navigation breadcrumb breadcrumbs sidebar aside masthead comment comments disqus replies respond login signup".split()
)
_DOUBTFUL = frozenset("banner notice menu footer foot header share sharing social related recommended widget search".split())
_FILLER = frozenset(
    "site page main top bottom left right box block bar list area container wrapper wrap section slot unit module inner outer primary secondary global post"
    " entry form buttons links items item content text number icons".split()
)
_WORD = re.compile(r"[a-z]+|[0-9]+")
_DIGITS = re.compile(r"[0-9]+")
_PRIME, _BASE = (1 << 61) - 1, 0x1D8AF066C4A5F2B3


class Node:
    """prior: shift of importance, -1 or less is noise, -9 noise that nothing overrules;
    named: noise by class, id, role or as a form; content: digest and number of the texts below."""

    __slots__ = ("tag", "label", "path", "prior", "named", "inside", "children", "parent", "places", "hash", "pieces", "length", "linked", "main")

    def __init__(self, tag: str, label: str, path: int, parent, inside: bool):
        self.tag, self.label, self.path, self.parent, self.inside = tag, label, path, parent, inside
        self.prior, self.named, self.places, self.main = 0.0, False, None, False
        self.children: list = []


def _digest(text: str) -> int:
    return xxhash.xxh64_intdigest(text.encode("utf-8", "surrogatepass"))


def name_prior(names: str) -> float:
    """-1 if a class or id is noise, -0.5 if it may also name content, else 0."""
    least = 0.0
    for name in names.lower().split():
        words = [w for w in _WORD.findall(name) if not w.isdigit()]
        if words and all(w in _STRONG or w in _DOUBTFUL or w in _FILLER for w in words):
            least = min(least, -1.0 if any(w in _STRONG for w in words) else -0.5 if any(w in _DOUBTFUL for w in words) else 0.0)
    return least


def _attributes(html: str, at: int) -> tuple[dict | None, int]:
    """class, id, role and hidden of a tag whose name ends at ``at``, and where it ends;
    None if the text ends before."""
    found: dict = {}
    while m := _ATTRIBUTE.match(html, at):
        at = m.end()
        if m.group(1):
            return found, at
        name = m.group(2).lower()
        if name in ("class", "id", "role", "hidden", "aria-hidden") and name not in found:
            value = m.group(3) or ""
            found[name] = entities.unescape(value[1:-1] if value[:1] in ("'", '"') and value[-1:] == value[:1] and len(value) > 1 else value).lower()
    return None, at


def _prior(tag: str, found: dict, inside: bool) -> tuple[float, bool]:
    """The prior of an element, and whether it is noise by name, role or as a form only."""
    if tag in _HARD:
        return -9.0, False
    if not found and tag not in _SOFT:
        return 0.0, False
    if found.get("hidden", "until-found") != "until-found" or found.get("aria-hidden") == "true":
        return -1.0, False
    tags = (-0.3 if inside and tag == "header" else -1.0) if tag in _SOFT else 0.0
    names = 0.0
    if inside or tag not in ("article", "main", "html", "body"):
        names = min(name_prior(found.get("class", "")), name_prior(found.get("id", "")))
        if names < 0 and not inside:
            names = -1.0
        if found.get("role") in _ROLES:
            names = -1.0
    return min(tags, names), (tags > -1 or tag == "form") and min(tags, names) <= -1


def parse(html: str) -> list[Node]:
    """The elements of a page in the order of their opening, the root first; text is
    kept as strings between elements."""
    root = node = Node("#root", "", 0, None, False)
    nodes, depth, open_ = [root], 0, Counter()
    at, n, quoted = 0, len(html), True
    last = html.rfind(">")

    def text(a: int, b: int) -> None:
        if a < b:
            node.children.append(entities.unescape(html[a:b]))

    def rise(to: Node) -> None:
        """Ends all open elements below ``to``."""
        nonlocal node, depth
        while node is not to:
            open_[node.tag] -= 1
            depth -= 1
            node = node.parent

    while at < n:
        lt = html.find("<", at)
        if lt < 0 or lt > last:  # no tag ends from here on
            text(at, n)
            break
        text(at, lt)
        mark = html[lt + 1 : lt + 2]
        if mark in ("!", "?"):
            if html.startswith("<!--", lt):
                end = html.find("-->", lt + 4)
                at = n if end < 0 else end + 3
            else:
                at = html.find(">", lt) + 1
            continue
        closing = mark == "/"
        m = _NAME.match(html, lt + 1 + closing)
        if m is None:
            if closing:  # "</" without a name is no text
                at = html.find(">", lt) + 1
            else:
                text(lt, lt + 1)
                at = lt + 1
            continue
        tag, at, found = m.group().lower(), m.end(), {}
        if html.startswith(">", at):
            at += 1
        elif quoted:
            found, end = _attributes(html, at)
            if found is None:  # a quote that hides the rest: from now on every tag ends at the first >
                quoted, found, end = False, {}, html.find(">", at) + 1
            at = end
        else:
            at = html.find(">", at) + 1
        if closing:
            if open_[tag]:
                up = node
                while up.tag != tag:
                    up = up.parent
                rise(up.parent)
            continue
        if tag in _BLOCK and open_["p"]:  # a block ends an open paragraph, with what is open in it
            up = node
            while up.parent is not None and up.tag not in _HOLDS:
                up = up.parent
            if up.tag == "p":
                rise(up.parent)
        if tag in _ENDS:
            ends, limits = _ENDS[tag]
            up = node
            while up.parent is not None and up.tag not in limits:
                if up.tag in ends:
                    rise(up.parent)
                    break
                up = up.parent
        if depth >= DEEPEST:
            rise(node.parent)
        styled = found.get("class") or found.get("id")
        label = f"{tag} {_DIGITS.sub('#', found.get('class', ''))} {_DIGITS.sub('#', found.get('id', ''))}" if styled else tag
        place = 0
        if not styled and tag not in _FLOW and tag in _BLOCK:
            node.places = node.places or Counter()
            place = min(node.places[label], PLACES)
            node.places[label] += 1
        new = Node(tag, label, _digest(f"{node.path} {place} {label}") if tag in _BLOCK else node.path, node, node.inside or node.tag in _MAIN)
        new.prior, new.named = _prior(tag, found, new.inside)
        node.children.append(new)
        nodes.append(new)
        if tag in _RAW:
            end = _RAW[tag].search(html, at)
            at = end.end() if end else n
        elif tag not in _VOID:
            node = new
            open_[tag] += 1
            depth += 1
    _sum_up(nodes)
    return nodes


def _sum_up(nodes: list[Node]) -> None:
    """Content, length and links of all elements, children first; noise is left out."""
    for x in reversed(nodes):
        h = pieces = length = linked = 0
        for c in x.children:
            if isinstance(c, str):
                t = " ".join(c.split())
                if t:
                    h, pieces, length = (h * _BASE + _digest(t)) % _PRIME, pieces + 1, length + len(t)
            elif c.pieces:
                if c.prior > -1:
                    h, pieces = (h * pow(_BASE, c.pieces, _PRIME) + c.hash) % _PRIME, pieces + c.pieces
                    length, linked = length + c.length, linked + c.linked
        x.hash, x.pieces, x.length, x.linked = h, pieces, length, length if x.tag == "a" else linked
        if x.prior == -0.5 and 2 * x.linked > length:
            x.prior = -1.0


def tops_of(nodes: list[Node]) -> list[Node]:
    """The elements whose text is the main text; empty if no article or main is there."""
    for heed_names in (True, False):
        mains, stack = [], [nodes[0]]
        while stack:
            x = stack.pop()
            if x.prior <= -1 and (heed_names or not x.named):
                continue
            if x.tag in _MAIN:
                mains.append(x)
            else:
                stack += [c for c in reversed(x.children) if not isinstance(c, str)]
        if mains:
            break
    tops: list[Node] = []
    for m in mains:
        articles = []
        if m.tag == "main":
            stack = [c for c in reversed(m.children) if not isinstance(c, str)]
            while stack:
                x = stack.pop()
                if x.prior <= -1:
                    continue
                if x.tag == "article":
                    articles.append(x)
                else:
                    stack += [c for c in reversed(x.children) if not isinstance(c, str)]
        tops += articles if articles and 2 * sum(a.length for a in articles) >= m.length else [m]
    return tops


def counted(x: Node) -> bool:
    """Whether the tree has an element node for it: a block that is styled or holds others."""
    return x.tag in _BLOCK and x.prior > -1 and (x.tag not in _FLOW or x.label != x.tag) and x.tag not in ("html", "body")


class Page:
    """A parsed page: tops (or the root), whether it has an article, and its open nodes."""

    def __init__(self, html: str):
        self.nodes = parse(html)
        self.tops = tops_of(self.nodes)
        self.loose = not self.tops
        if self.loose:
            self.tops = self.nodes[:1]
            whole = sum(len(" ".join(c.split())) for x in self._seen() for c in x.children if isinstance(c, str))
            free = [x for x in self.nodes if x.named and 2 * x.length > whole]
            if free:
                for x in free:
                    x.prior = 0.0
                _sum_up(self.nodes)
        else:
            for top in self.tops:
                top.main = True
                stack = [c for c in top.children if not isinstance(c, str)]
                while stack:
                    x = stack.pop()
                    if x.prior > -1:
                        x.main = 2 * x.length >= top.length
                        stack += [c for c in x.children if not isinstance(c, str)]
        h = 0
        for top in self.tops:
            h = (h * _BASE + top.hash) % _PRIME
        self.key = h

    def _seen(self) -> Iterator[Node]:
        """All elements but those that are never text."""
        stack = [self.nodes[0]]
        while stack:
            x = stack.pop()
            yield x
            stack += [c for c in x.children if not isinstance(c, str) and c.prior > -9]

    def styles(self) -> dict[int, tuple[int, int]]:
        """path -> (presentation, content) of the page, elements of one path together."""
        shown: dict = {}
        stack = [self.nodes[0]]
        while stack:
            x = stack.pop()
            if counted(x) and x.pieces:
                labels, h = shown.get(x.path, ([], 0))
                labels.append(",".join(c.label for c in x.children if not isinstance(c, str)))
                shown[x.path] = labels, (h * _BASE + x.hash) % _PRIME
            stack += [c for c in reversed(x.children) if not isinstance(c, str) and c.prior > -1]
        return {p: (_digest(";".join(s)), h) for p, (s, h) in shown.items()}

    def blocks(self, importance: dict) -> list[str]:
        out: list[str] = []
        held: list[str] = []

        def goes(x: Node) -> bool:
            if x.prior <= -1:
                return True
            return counted(x) and importance.get(x.path, 1.0) + x.prior + (1.0 if x.main else 0.0) < LEAST

        def close() -> None:
            t = " ".join("".join(held).split())
            if t:
                out.append(t)
            held.clear()

        tops = set(map(id, self.tops))
        for top in self.tops:
            todo: list = [] if not self.loose and importance and counted(top) and importance.get(top.path, 1.0) < LEAST else [top]
            while todo:
                x = todo.pop()
                if x is None:
                    close()
                elif isinstance(x, str):
                    held.append(x)
                elif id(x) in tops or not goes(x):
                    if x.tag in _BLOCK:
                        close()
                        todo.append(None)
                    elif x.tag == "br":
                        held.append(" ")
                    todo += reversed(x.children)
            close()
        return out


def extract(html: str | None, importance: dict | None = None) -> str:
    """Blocks of the main text joined by blank lines; importance: of path digests, 1 where
    it says nothing."""
    if not html:
        return ""
    page = Page(html)
    return "\n\n".join(page.blocks(importance or {}) or page.blocks({}))


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def style_counts(pages: DataFrame) -> DataFrame:
    """host, path, kind (0 presentation, 1 content), digest, page: one row for each node of
    each page of pages (host, html); page is the digest of its main text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set = set()

        def rows() -> pa.RecordBatch:
            cols = list(zip(*seen, strict=True)) or [[]] * 5
            types = [pa.string(), pa.int64(), pa.int32(), pa.int64(), pa.int64()]
            out = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=["host", "path", "kind", "digest", "page"])
            seen.clear()
            return out

        for b in batches:
            for host, html in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                page = Page(html)
                for path, digests in page.styles().items():
                    seen.update((host, _signed(path), kind, _signed(d), page.key) for kind, d in enumerate(digests))
                if len(seen) > 200_000:
                    yield rows()
        yield rows()

    return pages.where(F.col("html").isNotNull()).select("host", "html").mapInArrow(run, "host string, path bigint, kind int, digest bigint, page bigint")


def importances(pages: DataFrame) -> DataFrame:
    """host, path, importance of all nodes of the hosts' style trees."""
    once = style_counts(pages).groupBy("host", "path", "kind", "digest", "page").agg(F.lit(1).cast("bigint").alias("one"))
    sums = once.groupBy("host", "path", "kind", "digest").agg(F.sum("one").alias("n"))
    # Entropy from sums: ln N - sum(n ln n) / N.
    by_kind = sums.groupBy("host", "path", "kind").agg(F.sum("n").alias("m"), (F.log(F.sum("n")) - F.sum(F.col("n") * F.log("n")) / F.sum("n")).alias("h"))
    nodes = by_kind.groupBy("host", "path").agg(F.max("m").alias("m"), F.max(F.when(F.col("m") > 1, F.col("h") / F.log("m")).otherwise(1.0)).alias("e"))
    return nodes.select("host", "path", (1 - (1 - F.col("e")) * (1 - 1 / F.col("m"))).alias("importance"))


def main_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every row of pages (page_id, url, html)."""
    host = F.coalesce(F.lower(F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)), F.lit(""))
    rows = pages.select(F.col("page_id").cast("bigint").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"), host.alias("host"))
    low = importances(rows).where(F.col("importance") < LEAST - WEAK).groupBy("host").agg(F.collect_list(F.struct("path", "importance")).alias("nodes"))
    low = cut(low)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            nodes = b.column(3).to_pylist() if b.num_columns == 4 else [None] * b.num_rows
            text = [extract(h, {x["path"] & ((1 << 64) - 1): x["importance"] for x in p or ()}) for h, p in zip(b.column(2).to_pylist(), nodes, strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(text, pa.string()), pa.array([len(t) for t in text], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    if low.isEmpty():
        return rows.select("page_id", "url", "html").mapInArrow(run, SCHEMA)
    return rows.join(low, "host", "left").select("page_id", "url", "html", "nodes").mapInArrow(run, SCHEMA)


def op5_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text(table(spark, sf_dir, "pages"))
