"""Main text of web pages by site style trees.

The element trees of one host's pages are merged by path (tags with class and id).
A merged element's importance is high if its pages arrange its children in many
ways (entropy over arrangements) and a content element's if its texts differ from
page to page (one minus the entropy of each text over the pages). An element of a
page combines its own with its children's; branches of low importance are template
and go. Equal pages of a host count once, so copies are no template.

What a page says about itself comes first: elements that are markup, forms, menus,
headers, footers, sidebars, notices, adverts or comments by tag, role, class or id
go, and if the page names its article (``article``, ``main``) only that is read, and
its plain text elements stay whatever their importance.

* Null html gives an empty text; null urls are one host. Hosts with fewer than
  ``MIN_PAGES`` different pages have no tree: only the pages' own names count.
* Repeated rows come out each. Other columns are not read.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from updraft.llm.common import arrow_schema, read, small_batches, written

MIN_PAGES = 4
#: Importance below which a branch is removed, and how far children count for their parent.
LEAST = 0.2
DAMPING = 0.9
#: Merged elements up to this many (about 30 MB) are broadcast to the pages; more are joined by a salted shuffle.
BROADCAST_NODES = 400_000
SALTS = 16
STYLE, TEXT = 0, 1

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = re.compile(r"(?is)(.*?)</(script|style|textarea|title|xmp|noframes|iframe)\s*>")
RAW_TAGS = frozenset("script style textarea title xmp noframes iframe".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark math "
                   "output q ruby rb rp rt s samp small span strike strong sub sup time tt u var wbr".split())
DROPPED = frozenset("script style template noscript iframe object embed applet audio video canvas svg map head title nav footer "
                    "aside form button select option input textarea fieldset dialog menu noframes xmp".split())
CONTAINERS = frozenset(("article", "main"))
#: Elements of running text: inside a named article they stay.
PLAIN = INLINE | frozenset("p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd blockquote pre table thead tbody tfoot tr td th "
                           "caption figure figcaption article main section hgroup address".split())
NOISE_WORDS = frozenset(
    "nav navbar navigation menu menubar topbar header masthead footer sidebar aside ad ads advert adverts advertisement "
    "advertising adsense banner promo promotion sponsor sponsored cookie cookies consent gdpr notice notices notification "
    "newsletter subscribe subscription signup popup modal overlay comment comments commentlist disqus respond reply "
    "share sharing social related recommended breadcrumb breadcrumbs pagination pager widget login search skip "
    "copyright toolbar".split())
NOISE_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar".split())
#: What an opening tag closes when it is still open.
CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"),
          "th": ("td", "th"), "option": ("option",), "tbody": ("thead", "tbody", "tr", "td", "th"),
          "tfoot": ("thead", "tbody", "tr", "td", "th")}
SCOPES = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("table", "tr"),
          "th": ("table", "tr"), "option": ("select",), "tbody": ("table",), "tfoot": ("table",)}

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|[^<]+|<", re.S)
ATTRIBUTE = re.compile(r"""(?i)(?<![^\s"'/])(class|id|role|hidden)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?(?=[\s/"']|$)""")
WORDS = re.compile(r"[a-z]+")


class Element:
    __slots__ = ("tag", "label", "path", "parent", "children", "texts", "noise", "container", "inside", "low")

    def __init__(self, tag: str, label: str, parent: "Element | None", noise: bool, container: bool):
        self.tag, self.label, self.parent, self.noise, self.container = tag, label, parent, noise, container
        self.children: list = []     # elements and text strings in page order
        self.low = False
        self.inside = container or (parent is not None and parent.inside)
        self.path = xxhash.xxh3_64_intdigest(label, parent.path) if parent is not None else 0
        if parent is not None:
            parent.children.append(self)


def parse(page: str) -> Element:
    """The page's element tree; unclosed and misplaced tags are repaired as browsers do for common cases."""
    root = Element("", "", None, False, False)
    now, at, n = root, 0, len(page)
    while at < n:
        m = TOKEN.match(page, at)
        at = m.end()
        closing, tag = m[1], m[2]
        if tag is None:
            piece = m[0]
            if piece[0] != "<" or len(piece) == 1:
                now.children.append(piece)
            continue
        tag = tag.lower()
        if closing:
            e = now
            while e is not root and e.tag != tag:
                e = e.parent
            if e is not root:
                now = e.parent
            continue
        if tag not in INLINE:
            e = now      # a block element ends an open paragraph
            while e is not root and e.tag in INLINE:
                e = e.parent
            if e.tag == "p":
                now = e.parent
        if tag in CLOSES:
            e = now
            while e is not root and e.tag not in SCOPES[tag]:
                if e.tag in CLOSES[tag]:
                    now = e.parent
                e = e.parent
        label, noise, container = _described(tag, m[3], now)
        e = Element(tag, label, now, noise, container)
        if tag in VOID or m[3].endswith("/") and tag not in PLAIN:
            continue
        if tag in RAW_TAGS:
            raw = RAW.match(page, at)
            while raw and raw[2].lower() != tag:
                raw = RAW.match(page, raw.end())
            at = raw.end() if raw else n
            continue
        now = e
    return root


def _described(tag: str, attributes: str, parent: Element) -> tuple[str, bool, bool]:
    """Label, whether the element names itself as something else than text, and whether as the article."""
    noise = parent.noise or tag in DROPPED or (tag == "header" and not parent.inside)
    if not attributes:
        return tag, noise, tag in CONTAINERS and not noise
    found = {a.lower(): b or c or d for a, b, c, d in ATTRIBUTE.findall(attributes)}
    named = f"{found.get('class', '')} {found.get('id', '')}".lower()
    role = found.get("role", "").strip().lower()
    words = set(WORDS.findall(named))
    if tag not in ("html", "body") and (words & NOISE_WORDS or role in NOISE_ROLES or "hidden" in found):
        noise = True
    return f"{tag} {named}", noise, (tag in CONTAINERS or role in ("main", "article")) and not noise


def _normal(text: str) -> str:
    return " ".join(entities.unescape(text).split())


def own_texts(e: Element) -> list[str]:
    """Texts that lie in the element with only inline markup between."""
    out, now = [], []

    def flush() -> None:
        if now:
            text = _normal("".join(now))
            now.clear()
            if text:
                out.append(text)

    stack = [iter(e.children)]
    while stack:
        c = next(stack[-1], None)
        if c is None:
            stack.pop()
        elif isinstance(c, str):
            now.append(c)
        elif c.tag in INLINE and (e.noise or not c.noise):
            if c.tag == "br":
                now.append(" ")
            stack.append(iter(c.children))
        else:
            flush()
    flush()
    return out


def _blocks(e: Element) -> Iterator[Element]:
    """The element and the block elements below it."""
    stack = [e]
    while stack:
        x = stack.pop()
        if x.tag not in INLINE:
            yield x
        stack.extend(c for c in reversed(x.children) if not isinstance(c, str))


def _signed(value: int) -> int:
    return value - (1 << 64) if value >= 1 << 63 else value


def _hash(text: str, seed: int = 0) -> int:
    return _signed(xxhash.xxh3_64_intdigest(text, seed))


def page_features(page: str) -> tuple[list[tuple[int, int, int]], int]:
    """(path, kind, feature) of a page's elements, and a number for the page's texts as a whole."""
    arranged: dict[int, list[str]] = {}
    features, whole = set(), xxhash.xxh3_64()
    for e in _blocks(parse(page)):
        path = _signed(e.path)
        kids = [c.label for c in e.children if not isinstance(c, str) and c.tag not in INLINE]
        collapsed = [k for i, k in enumerate(kids) if not i or kids[i - 1] != k]
        arranged.setdefault(path, []).append("\x00".join(collapsed))
        for text in own_texts(e):
            features.add((path, TEXT, _hash(text)))
            whole.update(text + "\n")
    features.update((path, STYLE, _hash("\x01".join(sorted(set(a))))) for path, a in arranged.items())
    return sorted(features), _signed(whole.intdigest())


def host_of(url: Column) -> Column:
    """The host part of a url as a number; urls without one, and nulls, are one host."""
    return F.xxhash64(F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)))


def merged_elements(pages: DataFrame) -> DataFrame:
    """host, path, pages, arrangements, style and content importance of each merged element."""
    spark = pages.sparkSession
    small_batches(spark)
    ddl = "host long, path long, kind int, feature long, page long"
    schema = arrow_schema(spark, ddl)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            out: list[tuple] = []
            for host, page in zip(*(c.to_pylist() for c in batch.columns)):
                found, whole = page_features(page)
                out += [(host, *f, whole) for f in found]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)

    rows = pages.select(host_of(F.col("url")).alias("host"), F.coalesce("html", F.lit("")).alias("html")).mapInArrow(run, ddl)
    seen = rows.distinct().groupBy("host", "path", "kind", "feature").agg(F.count("*").alias("n"))
    style, text = F.col("kind") == STYLE, F.col("kind") == TEXT
    n = F.col("n").cast("double")
    nodes = seen.groupBy("host", "path").agg(
        F.sum(F.when(style, F.col("n"))).alias("pages"),
        F.count(F.when(style, 1)).alias("arrangements"),
        F.sum(F.when(style, n * F.log(n))).alias("style_sum"),
        F.sum(F.when(text, n)).alias("texts"),
        F.sum(F.when(text, n * F.log(n))).alias("text_sum")).where(F.col("pages") >= MIN_PAGES)
    log_m = F.log(F.col("pages").cast("double"))
    return nodes.select(
        "host", "path", "pages", "arrangements",
        # The entropy of arrangements, in units of log pages.
        ((log_m - F.col("style_sum") / F.col("pages")) / log_m).alias("style"),
        (1 - F.col("text_sum") / F.col("texts") / log_m).alias("content"))


def mark_template(root: Element, known: dict[int, tuple[int, float, float]]) -> None:
    """Sets ``low`` of the elements whose composite importance on their page is below ``LEAST``."""
    values: dict[int, float] = {}
    for e in reversed(list(_blocks(root))):        # children before parents
        parts = [values[id(c)] for c in e.children if not isinstance(c, str) and id(c) in values]
        node, texts = known.get(_signed(e.path)), bool(own_texts(e))
        inner = len(parts)
        if texts:
            parts.append(node[2] if node is not None and node[2] is not None else 1.0)
        if not parts:
            continue                               # nothing to judge
        value = sum(parts) / len(parts)
        if node is not None and inner:
            share = DAMPING ** node[0]
            value = (1 - share) * node[1] + share * value
        values[id(e)] = value
        e.low = value < LEAST


def main_text(page: str, known: dict[int, tuple[int, float, float]]) -> str:
    """The page's main text: kept blocks in page order, one a line."""
    root = parse(page)
    if known:
        mark_template(root, known)
    named = any(e.container for e in _blocks(root))
    out: list[str] = []
    now: list[str] = []

    def flush() -> None:
        if now:
            text = _normal("".join(now))
            now.clear()
            if text:
                out.append(text)

    # An explicit stack, since pages may nest deeply. Each entry: element, next child, plain so far.
    stack = [(root, 0, True)]
    while stack:
        e, at, plain = stack.pop()
        if at == len(e.children):
            if e.tag not in INLINE:
                flush()
            continue
        stack.append((e, at + 1, plain))
        c = e.children[at]
        if isinstance(c, str):
            if e.inside or not named:
                now.append(c)
            continue
        if c.noise:
            if c.tag not in INLINE:
                flush()
            continue
        if c.tag in INLINE:
            if c.tag == "br":
                now.append(" ")
            stack.append((c, 0, plain))
            continue
        flush()
        inner = plain and c.tag in PLAIN if e.inside else True
        protected = c.inside and inner
        if known and c.low and not protected and not (named and not c.inside):
            continue
        stack.append((c, 0, inner))
    flush()
    return "\n".join(out)


def known_elements(tree: pa.ListScalar) -> dict[int, tuple[int, float, float]]:
    """(arrangements, style, content) of a host's merged elements by path, of one page at a time: trees are long."""
    if not tree.is_valid:
        return {}
    return dict(zip(tree.values.field(0).to_pylist(), zip(*(tree.values.field(i).to_pylist() for i in (1, 2, 3)))))


def extract_pages(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars of every page."""
    nodes = written(merged_elements(pages), "elements")
    trees = nodes.groupBy("host").agg(F.collect_list(F.struct(
        "path", F.col("arrangements").cast("int").alias("count"), "style", "content")).alias("tree"))

    p = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html"), host_of(F.col("url")).alias("host"))
    if nodes.count() <= BROADCAST_NODES:
        joined = p.join(F.broadcast(trees), "host", "left")
    else:
        copies = trees.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        joined = p.withColumn("salt", F.pmod(F.xxhash64("page_id"), F.lit(SALTS)).cast("int")).join(
            copies, ["host", "salt"], "left")
    spark = pages.sparkSession
    small_batches(spark)
    ddl = "page_id long, url string, text string, n_chars long"
    schema = arrow_schema(spark, ddl)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            texts = [main_text(page.as_py(), known_elements(tree)) for page, tree in zip(batch.column(2), batch.column(3))]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(texts, schema[2].type),
                 pa.array(map(len, texts), schema[3].type)], schema=schema)

    return joined.select("page_id", "url", "html", "tree").mapInArrow(run, ddl)


def op4_style_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_pages(read(spark, sf_dir, "pages"))
