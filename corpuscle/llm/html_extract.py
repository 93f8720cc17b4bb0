"""HTML main-text extraction with a style tree per host.

The pages of a host are merged into one tree whose nodes are element paths
(tags with their class names). A node on which the host's pages agree, in the
children around it and in its texts, is template; a node on which they differ
is content. Nodes that are clearly less important than the host's text at large
are left out of every page, and a branch goes with the last of its nodes. On
hosts of few pages, where entropies say little, the roles of elements (menus,
forms, notices) and articles are checked after that; on others the tree alone
decides.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass, field
from html import unescape

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import hot_join, map_arrow, materialize, without
from .urls import host_of

#: Weight of content against presentation in a node's importance.
GAMMA = 0.5
#: A node whose importance is less than this share of its host's mean is template.
LEAST_SHARE = 0.8
#: From so many pages of a host on its style tree alone decides.
TREE_PAGES = 16
#: Hosts with more than one in so many of all pages meet their template by broadcast.
HOT_HOSTS = 2000

# Element kinds and the names that tell a branch's role.
RAW = set("script style textarea title noscript template iframe svg math select object xmp noembed noframes".split())
#: Those of them whose content is text to the parser; the others hold elements, and are ordinary ones if nothing closes them.
RAW_TEXT = set("script style textarea title iframe xmp noembed noframes".split())
BLOCKS = set(
    "html body address article aside blockquote center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup hr li main menu nav ol option p pre search section summary table tbody td tfoot th thead tr ul caption".split()
)
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
ROLE_TAGS = set("nav header footer aside form menu dialog button search".split())
ROLE_NAMES = set(
    "nav navbar navigation navigational menu menubar breadcrumb breadcrumbs sidebar aside footer header masthead topbar toolbar ad ads adv advert adverts "
    "advertisement advertisements advertising sponsor sponsored sponsors promo promotion promoted banner notice notices cookie cookies consent gdpr alert popup modal overlay "
    "newsletter subscribe subscription signup signin login register share sharing social related recommended recommendations comment comments commentlist reply replies respond disqus "
    "discussion widget widgets pagination pager form search skip disclaimer copyright".split()
)
ROLES = set("navigation banner contentinfo complementary search alert alertdialog dialog menu menubar form note toolbar".split())
CLOSES_P = BLOCKS - {"html", "body", "option", "li", "dd", "dt", "td", "th", "tr", "tbody", "thead", "tfoot", "caption"}
#: An opening tag closes an open element of these kinds, unless one of the second kinds stands between.
IMPLIED = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "td": ({"td", "th"}, {"table"}),
    "th": ({"td", "th"}, {"table"}),
    "tr": ({"tr"}, {"table"}),
    "tbody": ({"tbody", "thead", "tfoot"}, {"table"}),
    "tfoot": ({"tbody", "thead"}, {"table"}),
    "option": ({"option"}, {"datalist"}),
}

#: Quotes count only where a value begins; elsewhere, and unclosed, they are characters like any other.
_TAG = re.compile(r"""<(/?)([a-zA-Z][^\s/>]*+)((?:[\s/]++|[^\s/>][^\s/>=]*+(?:\s*+=\s*+(?:"[^"]*+"|'[^']*+'|[^\s>"'][^\s>]*+)?+)?+)*+)>""")
#: For what follows a tag that found no end.
_PLAIN_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>")
_ATTR = re.compile(r"""([a-zA-Z_:][-\w:.]*)\s*+=\s*+(?:"([^"]*)"|'([^']*)'|([^\s"'>][^\s>]*))|(?<=\s)(hidden)(?=[\s/>]|$)""", re.I)
_NAME = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[0-9]+")


@dataclass
class _Open:
    tag: str
    path: int
    noise: bool
    main: int  # 2 below an article, 1 below a main element, else 0
    children: list[str] = field(default_factory=list)


@dataclass
class Block:
    """One run of text between block-level tags, with the paths of the elements around it, outermost first."""

    text: str
    paths: tuple[int, ...]
    noise: bool
    main: int
    linked: bool


def _attributes(raw: str) -> dict[str, str]:
    out: dict[str, str] = {}
    for m in _ATTR.finditer(raw):
        name = (m[1] or m[5]).lower()
        out.setdefault(name, unescape(m[2] or m[3] or m[4] or ""))
    return out


def _names(value: str) -> list[str]:
    """Words of class and id values; a word after ``has``, ``with`` or ``no`` describes the layout and is left out."""
    found: list[str] = []
    for token in value.split():
        words = [w.lower() for w in _NAME.findall(token)]
        found += [w for i, w in enumerate(words) if not i or words[i - 1] not in ("has", "with", "no", "without")]
    return found


def _is_noise(tag: str, attrs: dict[str, str], inside: int) -> bool:
    if "hidden" in attrs or attrs.get("aria-hidden", "").lower() == "true" or "display:none" in attrs.get("style", "").replace(" ", "").lower():
        return True
    if tag in ("html", "body", "main"):
        return False
    if tag in ROLE_TAGS and not (tag == "header" and inside):
        return True
    if attrs.get("role", "").lower() in ROLES:
        return True
    if "class" in attrs or "id" in attrs:
        names = set(_names(f"{attrs.get('class', '')} {attrs.get('id', '')}"))
        if inside or tag == "article":
            names.discard("header")
        return bool(names & ROLE_NAMES)
    return False


def parse(html: str) -> tuple[list[Block], dict[int, int]]:
    """Blocks of a page in order, and for each element path the style (hash of its children's kinds)."""
    stack: list[_Open] = []
    blocks: list[Block] = []
    styles: dict[int, int] = {}
    held: list[str] = []
    plain = linked = 0
    links = 0

    def flush() -> None:
        nonlocal plain, linked
        text = " ".join("".join(held).split())
        if text:
            top = stack[-1] if stack else None
            blocks.append(Block(text, tuple(e.path for e in stack), bool(top and top.noise), top.main if top else 0, linked > 0 and not plain))
        held.clear()
        plain = linked = 0

    def close(depth: int) -> None:
        nonlocal links
        while len(stack) > depth:
            e = stack.pop()
            if e.path not in styles:
                styles[e.path] = xxhash.xxh64_intdigest(",".join(e.children)) >> 1
            links = 0

    at, n = 0, len(html)
    pattern = _TAG
    unclosed: set[str] = set()  # kinds that no closing tag follows any more
    while at < n:
        i = html.find("<", at)
        piece = html[at:] if i < 0 else html[at:i]
        if piece:
            held.append(unescape(piece) if "&" in piece else piece)
            if not piece.isspace():
                linked, plain = (linked + 1, plain) if links else (linked, plain + 1)
        if i < 0:
            break
        after = html[i + 1 : i + 2]
        if html.startswith("<!--", i):
            j = html.find("-->", i + 4)
            at = n if j < 0 else j + 3
            continue
        if after in ("!", "?"):
            j = html.find(">", i)
            at = n if j < 0 else j + 1
            continue
        if not (after.isascii() and after.isalpha() or after == "/"):
            held.append("<")
            plain += 1
            at = i + 1
            continue
        m = pattern.match(html, i)
        if not m and after == "/" and not (html[i + 2 : i + 3].isascii() and html[i + 2 : i + 3].isalpha()):  # a bogus comment
            j = html.find(">", i)
            at = n if j < 0 else j + 1
            continue
        if not m:
            pattern = _PLAIN_TAG  # a quote swallows the rest: from here on tags end at the next '>'
            m = pattern.match(html, i)
        if not m:
            break  # the page ends inside a tag
        at = m.end()
        ends, tag = m[1], m[2].lower()
        if tag in RAW and not ends:
            if not m[3].endswith("/") or tag not in ("svg", "math"):
                closing = None if tag in unclosed else re.compile(rf"</{tag}[\s/>]", re.I).search(html, at)
                if not closing:
                    if tag in RAW_TEXT:
                        break
                    unclosed.add(tag)
                    continue
                j = html.find(">", closing.start())
                at = n if j < 0 else j + 1
            continue
        if tag == "br":
            held.append(" ")
        elif tag == "a":
            links = 0 if ends else 1
        elif tag == "hr":
            flush()
        elif tag in VOID:
            continue
        elif tag in BLOCKS or tag == "button":
            if ends:
                for d in range(len(stack) - 1, -1, -1):
                    if stack[d].tag == tag:
                        flush()
                        close(d)
                        break
                else:
                    if tag == "p":
                        flush()
                continue
            flush()
            kinds, stops = IMPLIED.get(tag, (set(), set()))
            if tag in CLOSES_P:
                kinds, stops = {"p"}, BLOCKS - {"p"}
            for d in range(len(stack) - 1, -1, -1):
                if stack[d].tag in kinds:
                    close(d)
                    break
                if stack[d].tag in stops:
                    break
            attrs = _attributes(m[3]) if "=" in m[3] or "hidden" in m[3] else {}
            top = stack[-1] if stack else None
            inside = top.main if top else 0
            kind = tag
            if attrs.get("class"):
                kind += "." + re.sub(r"[0-9]+", "#", ".".join(sorted(set(attrs["class"].split()))))
            noise = bool(top and top.noise) or _is_noise(tag, attrs, inside)
            main = 2 if tag == "article" else max(inside, 1 if tag == "main" or attrs.get("role", "").lower() == "main" else 0)
            path = xxhash.xxh64_intdigest(f"{top.path if top else 0}/{kind}") >> 1
            if top:
                top.children.append(kind)
            if not m[3].endswith("/") or tag in ("p", "div", "article", "section", "li"):
                stack.append(_Open(tag, path, noise, main))
    flush()
    close(0)
    return blocks, styles


def choose(blocks: list[Block], template: set[int], roles: bool = True) -> list[Block]:
    """The blocks of nodes outside ``template``; of them, those of articles, else of the main element, else all that aren't menus of links.

    Without ``roles`` the style tree alone decides.
    """
    own = [b for b in blocks if not b.paths or b.paths[-1] not in template]
    if not roles:
        return own
    own = [b for b in own if not b.noise]
    level = max((b.main for b in own), default=0)
    return [b for b in own if b.main == level and (level or not b.linked)]


def extract(html: str | None, template: set[int] = frozenset(), roles: bool = True) -> str:
    """Main text of one page: blocks in page order, one a line."""
    return "\n".join(b.text for b in choose(parse(html or "")[0], template, roles))


def tree_counts(pages: DataFrame) -> DataFrame:
    """(host, node, kind, mark, n) of (host, html): the host's style tree as counts, summed per batch before they are dealt.

    kind 's': on how many pages the node has the style ``mark`` (hash of its
    children's kinds); 't': on how many pages a text of the node itself is
    ``mark``; 'c': characters of the node's own texts; 'a': ``mark`` is the node
    or one above it.
    """

    def run(batch):
        found: Counter = Counter()
        for host, html in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            blocks, styles = parse(html or "")
            found.update((host, node, "s", style) for node, style in styles.items())
            blocks = [b for b in blocks if b.paths]
            found.update((host, node, "t", mark) for node, mark in {(b.paths[-1], xxhash.xxh64_intdigest(b.text) >> 1) for b in blocks})
            for b in blocks:
                found[host, b.paths[-1], "c", 0] += len(b.text)
            for paths in {b.paths for b in blocks}:
                found.update((host, paths[-1], "a", node) for node in paths)
        keys = list(found)
        kinds = [pa.string(), pa.int64(), pa.string(), pa.int64()]
        columns = [pa.array([k[i] for k in keys], kind) for i, kind in enumerate(kinds)]
        yield pa.RecordBatch.from_arrays([*columns, pa.array(list(found.values()), pa.int64())], names=["host", "node", "kind", "mark", "n"])

    return map_arrow(pages, run, "host string, node long, kind string, mark long, n long")


def importance(counts: DataFrame, gamma: float = GAMMA) -> DataFrame:
    """(host, node, pages, chars, content, importance) of every node with text of its own.

    Presentation: the entropy of a node's styles over the host's pages (base: their
    number), of the node or the element around it that varies most. Content: one
    minus the mean entropy of the node's texts over pages, so a text on all pages
    counts 0 and one of a single page 1. ``gamma`` weighs content against
    presentation. A node of a single page has importance 1.
    """
    n, mark = F.col("n"), F.col("mark")
    style, text = F.col("kind") == "s", F.col("kind") == "t"
    marks = counts.groupBy("host", "node", "kind", "mark").agg(F.sum("n").alias("n"))
    nodes = marks.groupBy("host", "node").agg(
        F.sum(F.when(style, n)).alias("pages"),
        F.sum(F.when(style, n * F.ln(n))).alias("style_sum"),
        F.sum(F.when(text, n)).alias("texts"),
        F.sum(F.when(text, n * F.ln(n))).alias("text_sum"),
        F.sum(F.when(F.col("kind") == "c", n)).alias("chars"),
        F.collect_set(F.when(F.col("kind") == "a", mark)).alias("above"),
    )
    nodes = materialize(nodes)  # a tree has as many nodes as templates have elements, not as pages have
    base = F.ln(F.col("pages"))
    looks = F.when(F.col("pages") > 1, (base - F.col("style_sum") / F.col("pages")) / base).otherwise(0.0)
    styles = nodes.select("host", F.col("node").alias("over"), looks.alias("looks"))
    around = nodes.where("texts > 0").select("host", "node", F.explode("above").alias("over"))
    varies = around.join(styles, ["host", "over"]).groupBy("host", "node").agg(F.max("looks").alias("looks"))
    both = nodes.where("texts > 0").select("host", "node", "pages", "texts", "text_sum", "chars").join(varies, ["host", "node"])
    content = F.when(F.col("pages") > 1, 1 - F.col("text_sum") / (F.col("texts") * base)).otherwise(1.0)
    worth = F.when(F.col("pages") > 1, gamma * F.col("content") + (1 - gamma) * F.col("looks")).otherwise(1.0)
    return both.withColumn("content", content).select("host", "node", "pages", "chars", "content", worth.alias("importance"))


def template_nodes(pages: DataFrame, least: float = LEAST_SHARE, gamma: float = GAMMA) -> DataFrame:
    """(host, pages, template): each host's nodes of low importance. One row per host that has any.

    The measure is the host's own text: its mean importance, each node weighed by
    its characters and content, so what a host repeats has no say in it. A host
    whose pages all say the same has no template.
    """
    judged = materialize(importance(tree_counts(pages), gamma))
    weight = F.col("chars") * F.col("content")
    means = judged.groupBy("host").agg((F.sum(weight * F.col("importance")) / F.sum(weight)).alias("mean"), F.max("pages").alias("most"))
    low = judged.join(means, "host").where((F.col("pages") > 1) & (F.col("importance") < least * F.col("mean")))
    return low.groupBy("host").agg(F.max("most").alias("pages"), F.collect_list("node").alias("template"))


def extract_main_text(
    pages: DataFrame, html: str = "html", url: str = "url", least: float = LEAST_SHARE, gamma: float = GAMMA, roles: bool = True, tree_pages: int = TREE_PAGES
) -> DataFrame:
    """``pages`` with ``text``, the main text of each page, in place of the html.

    The whole html is parsed: character references are decoded, white space in a
    block becomes one space, blocks are joined in page order by one newline.
    Unclosed and misnested tags are closed as browsers do, and a tag with a
    stray quote ends at the next ``>``; an svg, math, select, object, noscript
    or template that is never closed is an ordinary element, so that what
    follows stays. A page that ends inside a tag, or inside a script or another
    element of bare text, ends there. A page of one host (or of none, when its URL is
    null) is judged with the pages of that host, from two pages on; null html
    gives an empty text; repeated rows are kept and get equal texts; an empty
    table gives no rows. Columns named ``text`` are replaced. On hosts of
    ``tree_pages`` pages or more that have a template, and everywhere without
    ``roles``, the style tree alone decides, and no tag or class name has a meaning.

    Templates are joined by host. Those of hosts with more than one in HOT_HOSTS
    of all pages, so at most HOT_HOSTS rows, are broadcast; every other host has
    few enough pages for one task.
    """
    names = [c for c in without(pages, "text").columns if c != html]
    slim = pages.select(host_of(F.col(url)).alias("host"), F.col(html).alias("html"))
    found = materialize(template_nodes(slim, least, gamma))
    kept = pages.select(*names, F.col(html).alias("__html")).withColumn("__at", host_of(F.col(url)))
    total = found.agg(F.coalesce(F.sum("pages"), F.lit(0))).first()[0]
    met = hot_join(kept, found.select(F.col("host").alias("__at"), F.col("pages").alias("__n"), "template", (F.col("pages") >= tree_pages).alias("judged")), "__at", "__n", total, HOT_HOSTS)
    met = met.select(*names, "__html", "template", "judged")
    schema = T.StructType([pages.schema[c] for c in names] + [T.StructField("text", T.StringType())])

    def run(batch):
        k = len(names)
        rows = zip(batch.column(k), batch.column(k + 1), batch.column(k + 2))
        texts = [extract(page.as_py(), set(low.as_py() or ()), roles and not judged.as_py()) for page, low, judged in rows]
        yield pa.RecordBatch.from_arrays([*batch.columns[:k], pa.array(texts, pa.string())], names=[f.name for f in schema])

    return map_arrow(met, run, schema)
