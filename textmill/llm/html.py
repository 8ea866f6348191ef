"""Main text of web pages by tag-path ratios.

A page is cut into blocks of text, each with its path of block tags from the root (with class and id names).
For each path the text length and the punctuation of its blocks are summed and divided by the number of
blocks; the product of both ratios, weighed by the share of text outside links and by how the blocks' lengths
vary, is on a logarithmic scale the path's weight. Weights are smoothed over neighbouring blocks in page order
and fused with those of sibling paths under the same parent. Tags and names (menus, footers, notices, adverts,
comments and the like) are weights: an element with such a tag lowers the weight of what stands in it, one with
such a name (or a form) does if it holds half of the page's text at most. A block is content if its fused weight reaches a share of
the mean, and stands in the page's main container: the lowest one that holds all blocks of a path with the
mean weight and more, or the outermost article or main element around that.

Defined results: a null page is empty; a page without content text has the empty text; a tag, comment or
reference that the page's end cuts off is dropped or kept as text as a reader would show it; tags that nothing
closes end with the page, however deep they are; repeated rows get the same result each; an empty table gives
an empty result; other columns are ignored.
"""

from __future__ import annotations

import html as entities
import math
import re
from collections import Counter, defaultdict
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Tags whose content isn't text of the page. Fixed values.
DROPPED = "script|style|textarea|title|noscript|iframe|template|xmp|svg|select|button|object|canvas"
#: Tags that lower the weight of what they hold, and one that does so like a name. Fixed values.
LOWERED, FORM = set("nav footer aside menu dialog".split()), "form"
#: Tags that blocks of one article share, and those of the article itself. Fixed values.
CONTAINERS, ARTICLES = set("article main div section td body html form".split()), ("article", "main")
#: Tags that don't end a block. Fixed values.
INLINE = set("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr br input".split())
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
#: Words in class, id or role that lower the weight of what an element holds. Fixed values.
NAMES = re.compile(r"(?i)(?:^|[\s_-])(?:ads?|advert\w*|adslot|sponsor\w*|promo\w*|banner|cookies?|consent|gdpr|notice|alert|popup|modal|overlay|sidebar|side|widget|comments?|respond|disqus|replies|related|recommend\w*|share|sharing|social|newsletter|subscribe|signup|login|menu|nav|navbar|navigation|breadcrumbs?|pagination|pager|footer|masthead|copyright|complementary|contentinfo|disclaimer|search|toc|tags|skip)(?:$|[\s_-])")
#: Words that do so where they stand outside the article, as a header's tag does. Fixed values.
HEADER_NAMES = re.compile(r"(?i)(?:^|[\s_-])(?:header|topbar|toolbar|brand|logo|hero)(?:$|[\s_-])")
TOKEN = re.compile(rf"<!--.*?(?:-->|\Z)|<(?P<raw>{DROPPED})\b(?:[^>\"'/]|/(?!>)|\"[^\"]*\"|'[^']*')*(?:/>|>.*?(?:</(?P=raw)\s*>|\Z)|\Z)|<![^>]*(?:>|\Z)|<\?[^>]*(?:>|\Z)|<(?P<end>/?)(?P<tag>[a-zA-Z][a-zA-Z0-9:-]*)(?P<attrs>(?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)|<(?=/?[a-zA-Z])[^>]*(?:>|\Z)", re.S | re.I)
ATTR = re.compile(r"""(?i)(?:^|\s)(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""")
HIDDEN = re.compile(r"""(?i)(?:^|\s)(?:hidden(?:[\s=]|$)|aria-hidden\s*=\s*["']?true|style\s*=\s*["'][^"']*display\s*:\s*none)""")
PUNCTUATION = re.compile(r"[.,;:!?…。、，；：！？¿¡]")
SPACE = re.compile(r"\s+")
#: Tags that an opening tag of the same group ends if it is open and nothing but inline tags stand between.
ENDS = {"p": {"p"}, "li": {"li", "p"}, "dt": {"dt", "dd", "p"}, "dd": {"dt", "dd", "p"}, "tr": {"tr", "td", "th", "p"}, "td": {"td", "th", "p"}, "th": {"td", "th", "p"}, "option": {"option"}}
BLOCKS_END_P = set("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main nav ol pre section table ul".split())
#: How an element is lowered: by its tag, or by a name (or as a form), which doesn't count for one that holds most of the page.
ALWAYS, BY_NAME = 2, 1
#: Share of the mean fused weight from which a block is content; blocks on each side that smooth a block's weight; factor of lowered elements.
THRESHOLD, SMOOTH, LOW = 0.25, 1, 0.05


@dataclass
class Tree:
    """Elements of a page in order (0 is the page itself), each with its parent's number, its path's number and how it is lowered (0: not)."""

    parent: list[int] = field(default_factory=lambda: [0])
    path: list[int] = field(default_factory=lambda: [0])
    tag: list[str] = field(default_factory=lambda: [""])
    lowered: list[int] = field(default_factory=lambda: [0])
    paths: dict[tuple[int, str], int] = field(default_factory=dict)  # a path's number by that of the path above and the last name
    above: list[int] = field(default_factory=lambda: [0])

    def add(self, parent: int, tag: str, name: str, lowered: int) -> int:
        key = (self.path[parent], name)
        if key not in self.paths:
            self.paths[key] = len(self.above)
            self.above.append(key[0])
        self.parent.append(parent)
        self.path.append(self.paths[key])
        self.tag.append(tag)
        self.lowered.append(lowered)
        return len(self.parent) - 1


@dataclass
class Block:
    element: int
    text: list[str] = field(default_factory=list)
    linked: int = 0


def blocks_of(page: str) -> tuple[Tree, list[tuple[int, str, int]]]:
    """The page's elements, and (element, text, characters in links) of each block with text, in page order."""
    tree, out = Tree(), []
    stack, open_ = [0], Counter()  # open elements, and how many of each tag
    current: Block | None = None
    at = link = hidden = 0  # link, hidden: how many elements were open where an open link, or a hidden element, begins

    def add(text: str) -> None:
        nonlocal current
        if not text or hidden:
            return
        if current is None:
            current = Block(stack[-1])
            out.append(current)
        current.text.append(text)
        if link:
            current.linked += len(text.strip())

    def close() -> None:
        nonlocal hidden, link
        open_[tree.tag[stack.pop()]] -= 1
        if len(stack) < hidden:
            hidden = 0
        if len(stack) < link:  # a link that nothing closed ends with what it stands in
            link = 0

    for m in TOKEN.finditer(page):
        add(entities.unescape(page[at : m.start()]))
        at, tag = m.end(), (m["tag"] or "").lower()
        if not tag:
            if m["raw"] and current is not None:
                add(" ")
            continue
        if tag in INLINE:
            if tag == "a":
                link = len(stack) if not m["end"] and "href" in m["attrs"].lower() else 0
            elif tag in ("br", "img") and current is not None:
                add(" ")
            continue
        current = None
        if m["end"]:
            if open_[tag]:
                while tree.tag[stack[-1]] != tag:
                    close()
                close()
            continue
        ends = ENDS.get(tag, {"p"} if tag in BLOCKS_END_P else set())
        while tree.tag[stack[-1]] in ends:
            close()
        if tag in VOID:
            continue
        attrs = m["attrs"] or ""
        names = {a.lower(): b or c or d for a, b, c, d in ATTR.findall(attrs)} if "=" in attrs else {}
        outside = tag not in (*ARTICLES, "body", "html") and not any(open_[t] for t in ARTICLES)
        named = tag not in ("body", "html") and any(NAMES.search(v) or (outside and HEADER_NAMES.search(v)) for v in names.values())
        name = f"{tag}.{names.get('class', '')}#{names.get('id', '')}" if names else tag
        lowered = ALWAYS if tag in LOWERED or (outside and tag == "header") else BY_NAME if named or tag == FORM else 0
        stack.append(tree.add(stack[-1], tag, name, lowered))
        open_[tag] += 1
        if not hidden and attrs and HIDDEN.search(attrs):
            hidden = len(stack)
    add(entities.unescape(page[at:]))
    return tree, [(b.element, text, min(b.linked, len(text))) for b in out if (text := SPACE.sub(" ", "".join(b.text)).strip())]


def factors(tree: Tree, blocks: list[tuple[int, str, int]]) -> list[float]:
    """For each element the product of LOW over the lowered ones that it stands in; one lowered by a name or as a form only if it holds half of the page's text at most."""
    held = [0] * len(tree.parent)
    for element, text, _ in blocks:
        held[element] += len(text)
    for k in range(len(held) - 1, 0, -1):  # what an element holds stands after it
        held[tree.parent[k]] += held[k]
    out = [1.0] * len(held)
    for k in range(1, len(out)):
        low = tree.lowered[k] == ALWAYS or (tree.lowered[k] and held[k] <= held[0] / 2)
        out[k] = out[tree.parent[k]] * (LOW if low else 1.0)
    return out


def path_weights(tree: Tree, blocks: list[tuple[int, str, int]]) -> dict[int, float]:
    rows = defaultdict(lambda: [0, 0, 0, 0, 0])  # blocks, characters, their squares, marks, characters in links
    for element, text, linked in blocks:
        r, size = rows[tree.path[element]], len(text)
        r[0] += 1
        r[1] += size
        r[2] += size * size
        r[3] += len(PUNCTUATION.findall(text))
        r[4] += linked
    out = {}
    for path, (n, length, squares, marks, linked) in rows.items():
        mean = length / n
        spread = 1 + math.sqrt(max(0.0, squares / n - mean * mean)) / (1 + mean)
        out[path] = math.log1p(mean * (0.1 + marks / n) * spread * (1 - linked / length) ** 2)
    return out


def fused_weights(tree: Tree, blocks: list[tuple[int, str, int]], own: list[float]) -> list[float]:
    """Of each block: half its path's weight, a quarter each that of its neighbours and that of paths under the same parent; times its element's factor (own)."""
    weight = path_weights(tree, blocks)
    paths = [tree.path[e] for e, _, _ in blocks]
    raw = [weight[p] * own[e] for p, (e, _, _) in zip(paths, blocks, strict=True)]
    raw = [raw[0]] * SMOOTH + raw + [raw[-1]] * SMOOTH
    smoothed, siblings = defaultdict(lambda: [0.0, 0]), defaultdict(lambda: [0.0, 0])
    for k, p in enumerate(paths):
        near, beside = smoothed[p], siblings[tree.above[p]]
        near[0] += sum(raw[k : k + 2 * SMOOTH + 1]) / (2 * SMOOTH + 1)
        near[1] += 1
        beside[0] += weight[p]
        beside[1] += 1
    fused = {}
    for p, (total, n) in smoothed.items():
        beside = siblings[tree.above[p]]
        fused[p] = 0.5 * weight[p] + 0.25 * total / n + 0.25 * beside[0] / beside[1]
    return [fused[p] * own[e] for p, (e, _, _) in zip(paths, blocks, strict=True)]


def container(tree: Tree, elements: list[int]) -> int:
    """The lowest container of all elements, or the outermost main or article element that it stands in."""
    inside = Counter()
    for e in set(elements):  # an element's number is above that of what it stands in
        inside[e] += 1
    wanted, best = len(inside), 0
    for k in range(max(elements), 0, -1):
        if inside[k] == wanted and tree.tag[k] in CONTAINERS:
            best = k
            break
        inside[tree.parent[k]] += inside[k]
    k = best
    while k:
        if tree.tag[k] in ARTICLES:
            best = k
        k = tree.parent[k]
    return best


def content_blocks(tree: Tree, blocks: list[tuple[int, str, int]]) -> list[str]:
    """Texts of the blocks that tag-path ratios take for the article; none if all text stands in lowered elements."""
    own = factors(tree, blocks)
    if all(own[e] < 1 for e, _, _ in blocks):
        return []
    fused = fused_weights(tree, blocks, own)
    mean = sum(w * len(t) for w, (_, t, _) in zip(fused, blocks, strict=True)) / sum(len(t) for _, t, _ in blocks)
    if mean <= 0:
        return []
    inside = [False] * len(tree.parent)
    inside[container(tree, [b[0] for b, w in zip(blocks, fused, strict=True) if w >= mean])] = True
    for k in range(1, len(inside)):
        inside[k] = inside[k] or inside[tree.parent[k]]
    return [text for (element, text, _), w in zip(blocks, fused, strict=True) if inside[element] and w >= THRESHOLD * mean]


def main_text(page: str | None) -> str:
    return "\n\n".join(content_blocks(*blocks_of(page or "")))


def extract_pages(pages: DataFrame) -> DataFrame:
    """page_id, url, text (the article's blocks joined by an empty line, or empty) and n_chars, one row per row of pages."""

    def run(series: pd.Series) -> pd.Series:
        return series.map(main_text)

    text = F.pandas_udf(run, "string")(F.coalesce("html", F.lit("")))
    return pages.select("page_id", "url", text.alias("text")).withColumn("n_chars", F.length("text").cast("long"))


def op5_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_pages(spark.read.parquet(f"{sf_dir}/pages.parquet"))
