"""Main text of web pages: flat text blocks, classified by their own and their neighbours' features with a decision tree.

A small parser per row turns a page into flat blocks: runs of text between block
tags, with word count and link density, those of all blocks of the same
container, and what markup says of it.  Neighbours' word counts and link
densities are added, and a decision tree, trained by Spark ML on the labelled
blocks of TRAINING_PAGES, is compiled into one Column expression that says which
blocks belong to the article.  That a block stands in an article element is no
feature; class names and page parts are, beside how much of the page they hold.

Nulls and odd cases: a null or empty html has no blocks and the empty text.
Each row gives one row, repeated rows too, with its page_id, url and other
columns as they are, null included; only the column that is added takes the
place of one of its name.  The parser reads a page once.  Unclosed and stray
tags and quotes are allowed for.  An unclosed comment, script or style ends with
the page, and so does a tag without an end, as in browsers; an unclosed button
or list of choices ends at the next block.  Nothing is cut, whatever a page's length.
"""

from __future__ import annotations

import html as _html
import re
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.ml.classification import DecisionTreeClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserae.llm.storage import boxed, unboxed

# --- flat blocks of a page -------------------------------------------------------------------------------------------

#: Tags that end a block, whose content is markup or a field of a form, that are page parts other than the article, that enclose it.
BLOCK_TAGS = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head "
    "header hr html legend li main menu nav noscript ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
RAW_TAGS = frozenset("script style title textarea template iframe".split())
FIELD_TAGS = frozenset("button select".split())
ASIDE_TAGS = frozenset("nav footer aside menu dialog".split())
MAIN_TAGS = frozenset("article main".split())
#: Tags whose nesting is followed; these two are like a class name that hints at something else than the article.
NESTED_TAGS = frozenset("article main section div nav header footer aside form menu dialog ul ol table blockquote figure noscript".split())
HINT_TAGS = frozenset("form noscript".split())
#: Parts of class names, ids and roles.
HINT = re.compile(
    r"ads?|advert\w*|banner|breadcrumbs?|comments?|cookies?|consent|disqus|footer|header|masthead|menu|modal|nav\w*|newsletter|notice|popup|promo\w*|related|respond|share|sharing|sidebar|social|sponsor\w*|subscribe|tags|toolbar|widget",
    re.I,
)
_NAMED = re.compile(r"""(?:class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""", re.I)
_NAME = re.compile(r"(/?)([a-zA-Z][^\s/>]*)")
_IN_TAG = re.compile(r">|=\s*([\"'])")

FIELDS = ("text", "words", "links", "group_words", "group_links", "heading", "aside", "hint", "share")
BLOCK_TYPE = pa.list_(pa.struct([("text", pa.string()), *((f, pa.float64()) for f in FIELDS[1:])]))
BLOCK_SQL = f"array<struct<text:string,{','.join(f'{f}:double' for f in FIELDS[1:])}>>"


def _tag_end(page: str, at: int, last: int, dead: set[int]) -> int:
    """Where a tag ends whose name ends at at: after the first '>' outside quoted values, or after the first at all; last is the page's last '>'.

    dead has the beginnings of quoted values from which no such '>' is reached.
    Each leads to one next value only, so none is followed twice, and a page
    full of stray quotes is read in linear time.
    """
    k, seen = at, []
    while k <= last:
        m = _IN_TAG.search(page, k)
        if m[1] is None:
            return m.end()
        if m.end() in dead:
            break
        seen.append(m.end())
        k = page.find(m[1], m.end()) + 1
        if not k:
            break
    dead.update(seen)
    return page.find(">", at) + 1


def _hinted(attributes: str) -> bool:
    return any(HINT.fullmatch(part) for names in _NAMED.findall(attributes) for part in re.split(r"[\s_-]+", names.strip("\"'")))


class _Reader:
    """Reads one page into blocks, keeping a stack of containers: (tag, container, whether a page part, whether hinted)."""

    def __init__(self, page: str) -> None:
        self.page, self.stack, self.open = page, [], defaultdict(int)
        self.parts = self.main = self.headers = 0  # open containers of these kinds
        self.hints: list[int] = []  # open hinted containers, the outermost first
        self.pieces: list[str] = []
        self.linked, self.link_depth, self.heading, self.field = 0, -1, False, ""
        self.blocks: list[list] = []
        self.containers, self.absent, self.dead = 1, set(), set()

    def text(self, raw: str) -> None:
        if raw and not self.field:
            plain = _html.unescape(raw)
            self.pieces.append(plain)
            if self.link_depth >= 0:
                self.linked += len(plain.split())

    def end_block(self) -> None:
        text = " ".join("".join(self.pieces).split())
        if text:
            words = text.count(" ") + 1
            # a header inside an article is the article's own
            aside = self.parts > 0 or (self.headers > 0 and not self.main)
            self.blocks.append([text, words, min(words, self.linked), self.stack[-1][1] if self.stack else 0, self.heading, aside, self.hints[0] if self.hints else 0])
        self.pieces, self.linked = [], 0

    def push(self, tag: str, attributes: str) -> None:
        hint = tag in HINT_TAGS or (tag not in MAIN_TAGS and _hinted(attributes))
        self.stack.append((tag, self.containers, hint))
        if hint:
            self.hints.append(self.containers)
        self.containers += 1
        self._count(tag, 1)

    def pop(self, tag: str) -> None:
        while self.open[tag]:
            name, _, hint = self.stack.pop()
            if hint:
                self.hints.pop()
            self._count(name, -1)
            if name == tag:
                break
        if self.link_depth > len(self.stack):  # a link ends with the container it began in
            self.link_depth = -1

    def _count(self, tag: str, by: int) -> None:
        self.open[tag] += by
        self.parts += by * (tag in ASIDE_TAGS)
        self.main += by * (tag in MAIN_TAGS)
        self.headers += by * (tag == "header")

    def tag(self, tag: str, closing: bool, attributes: str) -> None:
        if tag in BLOCK_TAGS:
            self.end_block()
            self.heading, self.field = tag[0] == "h" and tag[1:].isdigit() and not closing, ""
        elif tag == "br":
            self.pieces.append(" ")
        elif tag == "a":
            self.link_depth = -1 if closing else len(self.stack)
        elif tag in FIELD_TAGS:
            self.field = "" if closing else tag
        if tag in NESTED_TAGS:
            if closing:
                self.pop(tag)
            elif not attributes.endswith("/"):
                self.push(tag, attributes)

    def raw_end(self, tag: str, at: int) -> int:
        """Where the content of a raw element ends that begins at at; at itself where that never ends, the page's end for scripts and styles."""
        if tag not in self.absent:
            m = re.compile(rf"</{tag}(?![^\s/>])[^>]*>?", re.I).search(self.page, at)
            if m:
                return m.end()
            self.absent.add(tag)
        return len(self.page) if tag in ("script", "style") else at

    def read(self) -> list[list]:
        page, at, size, last = self.page, 0, len(self.page), self.page.rfind(">")
        while at < size:
            lt = page.find("<", at)
            self.text(page[at : lt if lt >= 0 else size])
            if lt < 0:
                break
            m = _NAME.match(page, lt + 1)
            if page.startswith("<!--", lt):
                at = page.find("-->", lt + 2) + 3
                at = at if at > 2 else size
            elif m or page[lt + 1 : lt + 2] in ("!", "?", "/"):
                end = _tag_end(page, m.end(), last, self.dead) if m else page.find(">", lt) + 1 if lt < last else 0
                at = end or size
                if m and end:
                    name, closing = m[2].lower(), bool(m[1])
                    attributes = page[m.end() : end - 1]
                    self.tag(name, closing, attributes)
                    if name in RAW_TAGS and not closing and not attributes.endswith("/"):
                        at = self.raw_end(name, at)
            else:
                self.text("<")
                at = lt + 1
        self.end_block()
        return self.blocks


def flat_blocks(page: str) -> list[dict]:
    """The blocks of a page in order, with FIELDS."""
    blocks = _Reader(page).read()
    words, links, n, hinted = defaultdict(int), defaultdict(int), defaultdict(int), defaultdict(int)
    for _, w, l, group, _, _, hint in blocks:
        words[group] += w
        links[group] += l
        n[group] += 1
        hinted[hint] += w
    total = sum(words.values())
    return [
        dict(zip(FIELDS, (text, float(w), l / w, words[g] / n[g], links[g] / words[g], float(heading), float(aside), float(hint > 0), hinted[hint] / total if hint else 0.0)))
        for text, w, l, g, heading, aside, hint in blocks
    ]


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for k in range(0, batch.num_rows, 256):  # a long batch of long pages is not held twice
            part = batch.slice(k, 256)
            blocks = pa.array([flat_blocks(x or "") for x in part.column("_html").to_pylist()], BLOCK_TYPE)
            yield pa.RecordBatch.from_arrays([part.column("_box"), blocks], names=["_box", "_blocks"])


# --- features and tree -----------------------------------------------------------------------------------------------

NEIGHBOURS = {f"{side}_{name}": (step, name) for side, step in (("prev", -1), ("next", 1)) for name in ("words", "links")}
FEATURES = (*FIELDS[1:], *NEIGHBOURS)


def with_neighbours(blocks: Column) -> Column:
    """Blocks with the word count and link density of the ones before and after (0 at the ends)."""
    near = {k: (lambda i, step=step, name=name: F.coalesce(F.get(blocks, i + step)[name], F.lit(0.0))) for k, (step, name) in NEIGHBOURS.items()}
    return F.transform(blocks, lambda b, i: F.struct(*(b[n].alias(n) for n in FIELDS), *(of(i).alias(k) for k, of in near.items())))


def parsed_pages(pages: DataFrame) -> DataFrame:
    """(_box, _blocks): the columns of pages other than html in a struct, and the blocks (array of structs with text and FEATURES)."""
    rows = pages.select(boxed([c for c in pages.columns if c != "html"]), F.col("html").alias("_html"))
    schema = f"_box {rows.schema['_box'].dataType.simpleString()}, _blocks {BLOCK_SQL}"
    return rows.mapInArrow(_parse, schema).withColumn("_blocks", with_neighbours(F.col("_blocks")))


LONG = "The committee met on Tuesday to look at the new plans for the harbour, and after three hours of talk it asked the engineers for a second opinion before any money is spent. "
MIDDLE = "A short walk from the station leads to the old market hall, which opens at nine. "
MENU = "<li><a href=/>Home</a></li><li><a href=/n>News</a></li><li><a href=/s>Sport and games</a></li>"
#: A page, and for each of its blocks whether it belongs to the article.
TRAINING_PAGES = (
    # page parts are marked
    (f"<nav><ul>{MENU}</ul></nav><article><h1>Harbour plans</h1><p>{LONG * 2}</p><p>So.</p><p>{MIDDLE}</p></article><footer>&copy; Gazette. All rights reserved.</footer>", "000" "1111" "0"),
    (f"<nav><ul>{MENU}</ul></nav><div class=ad>Buy two, get one free at the corner shop today.</div><article><h1>Go</h1><p>Go.</p></article><footer>&copy; Gazette, every day but Sunday.</footer>", "000" "0" "11" "0"),
    (f"<nav><ul>{MENU}</ul></nav><div class=ad>Buy two, get one free.</div><article><h1>{MIDDLE}</h1><p>{MIDDLE * 9}</p><p>Yes, and no</p><p>{LONG}</p><p>Salt.</p></article><footer>&copy; Gazette</footer>", "000" "0" "11111" "0"),
    (f"<header><p>The Gazette</p><p>News since 1890, every day but Sunday.</p></header><main><h2>Market hall</h2><p>{MIDDLE}</p><p>Thing.</p><p>Yes, and no</p></main><aside><p>{MIDDLE}</p></aside><footer><p>Imprint</p></footer>", "00" "1111" "0" "0"),
    (f'<div class="ad">{MIDDLE}</div><article><p>{LONG}</p><p>And then?</p><ul><li>First point</li><li>Second point, longer.</li></ul></article><div class=comments><p>{LONG}</p><p>Nice.</p></div>', "0" "1111" "00"),
    (f"<article><header><h1>On bread</h1><p>By a baker</p></header><p>{MIDDLE}</p><nav><a href=/2>2</a> <a href=/3>3</a></nav><p>Salt.</p><footer>Filed under food</footer></article>", "111" "0" "1" "0"),
    (f"<main><div class=sidebar><p>{LONG * 2}</p></div><p>A.</p><p>See <a href=/w>the wide and complete list of works</a></p><div class='cookie notice'>We use cookies to make this site work.</div></main>", "0" "11" "0"),
    (f"<aside><h3>Popular</h3><p>{LONG * 2}</p></aside><form><p>{LONG}</p></form><article><h1>End</h1><p>{MIDDLE}</p></article>", "00" "0" "11"),
    (f"<article><h1>Rain</h1><p>{MIDDLE}</p></article><section id=comments><p>{LONG * 3}</p><p>{LONG * 2}</p><p>No.</p></section><footer><p>{LONG}</p></footer>", "11" "000" "0"),
    (f"<article><p>Go.</p></article><footer><p>{LONG}</p></footer>", "1" "0"),
    (f"<nav><ul>{MENU}</ul></nav><article><h1>Go</h1><p>Go.</p></article><footer>&copy; Gazette, every day but Sunday.</footer>", "000" "11" "0"),
    (f"<nav><ul>{MENU}</ul></nav><article><p>Go on.</p></article><footer>&copy; Gazette</footer>", "000" "1" "0"),
    ("<article><h1>It is</h1><p>It is.</p><p>Yes.</p></article><footer>&copy; Gazette</footer>", "111" "0"),
    ("<article><h1>It is so</h1><p>It is.</p></article>", "11"),
    # nothing is marked: words and links, a block's, its neighbours' and its container's, tell
    (f"<div><a href=/a>Sport</a> <a href=/b>Weather</a></div><div><h1>Notes on rope</h1><p>{LONG * 2}</p><p>{LONG}</p></div><div><a href=/x>Next page</a></div><div>Copyright 2020</div>", "0" "111" "0" "0"),
    (f"<table><tr><td><a href=/a>Start</a></td><td><a href=/b>Archive</a></td></tr></table><div>{LONG * 3}</div><div>{MIDDLE * 3}</div><p><a href=/c>More stories</a> | <a href=/d>Contact us</a></p>", "00" "11" "0"),
    (f"<body><p><a href=/1>One</a></p><p><a href=/2>Two</a></p><p><a href=/3>Three</a></p><h1>Rain</h1><p>{LONG}</p><p>{LONG * 2}</p></body>", "000" "111"),
    (f"<div>Subscribe now</div><div><p>{LONG}</p><p>{LONG}</p><p>Short para.</p><ul><li>Item one</li><li>Item two</li></ul><p>{MIDDLE}</p></div><div><a href=/z>Terms</a> <a href=/y>Privacy</a></div>", "0" "111" "11" "1" "0"),
    (f"<ul>{MENU}</ul><div><p>{MIDDLE}</p><p>Oh.</p><p>{MIDDLE}</p></div><ul>{MENU}</ul>", "000" "111" "000"),
    (f"<h1>{MIDDLE}</h1><p>{LONG}</p><p>Well.</p><p>{LONG}</p><ol><li>Rope</li><li>Tar</li><li>Nails</li></ol><p>{MIDDLE}</p>", "1111" "111" "1"),
    (f"<p>{MIDDLE}</p>", "1"),
    ("<p>Go.</p>", "1"),
    ("<div><h1>Rope</h1><p>Soon.</p></div>", "11"),
    (f"<div><div>{LONG}</div><div>Why?</div><div>{LONG * 2}</div><div>{MIDDLE}</div></div><div><a href=/1>A walk</a><br><a href=/2>A swim in the cold harbour</a></div>", "1111" "0"),
    (f"<div><p>{LONG}</p><p><a href=/q>{MIDDLE}</a></p><p>{LONG}</p></div>", "111"),
    (f"<div><p>{LONG}</p><p>More on <a href=/r>rope</a> and <a href=/t>tar</a> next week.</p><p>{MIDDLE}</p></div>", "111"),
    (f"<div><p>{LONG}</p><p>Ask <a href=/r>the rope maker</a> too.</p><p>{MIDDLE}</p></div>", "111"),
    # headings of link lists
    (f"<div><h1>Oak</h1><p>{LONG}</p></div><div><h3>Popular now</h3><ul>{MENU}</ul></div>", "11" "0" "000"),
    (f"<div><h3>In this issue</h3><ul>{MENU}</ul></div><div><p>{LONG}</p><p>{MIDDLE}</p></div>", "0" "000" "11"),
    (f"<p>More stories from our town</p><ul>{MENU}</ul><h1>Sail</h1><p>{LONG}</p><p>Sails of old.</p><p>Letters to the paper</p><ul>{MENU}</ul>", "0" "000" "111" "0" "000"),
    # link lists inside an article, and pages that are all marked, in which a mark tells nothing
    (f"<article><h1>Tar</h1><p>{LONG}</p><ul><li><a href=/1>A walk</a></li><li><a href=/2>A swim in the cold harbour</a></li><li><a href=/3>A run</a></li></ul><p>{MIDDLE}</p></article>", "11" "000" "1"),
    (f"<article><ul>{MENU}</ul><h1>Tar</h1><p>{MIDDLE}</p><p>{LONG}</p><p><a href=/1>Rope</a> <a href=/2>Tar</a> <a href=/3>Sail</a></p></article>", "000" "111" "0"),
    (f"<main><ul>{MENU}</ul><p>{LONG}</p><p>{LONG}</p><p>Done.</p><ul>{MENU}</ul></main>", "000" "111" "000"),
    (f"<form id=page><ul>{MENU}</ul><h1>Sails</h1><p>{LONG}</p><p>Oak.</p><p>{MIDDLE}</p></form>", "000" "1111"),
    (f'<div class="has sidebar"><div><h1>Oak</h1><p>{LONG * 2}</p><p>Elm.</p><p>{MIDDLE}</p></div><ul>{MENU}</ul></div>', "1111" "000"),
    (f"<div id=social><p>{LONG}</p><p>{LONG}</p></div>", "11"),
    ("<div class=header-page><h1>Elm</h1><p>Soon.</p></div>", "11"),
    (f'<div class="promo"><p>{LONG}</p></div><article><p><a href=/q>{MIDDLE}</a></p><p>Word</p></article><section class=related><p>{LONG}</p></section>', "0" "11" "0"),
    (f"<noscript>Please switch scripts on.</noscript><div><p>{MIDDLE}</p><p>{LONG}</p></div><form><p>Your name and e-mail address, please.</p></form>", "0" "11" "0"),
    (f"<article><h1>Ash</h1><p>{LONG}</p></article><div class=newsletter><p>{MIDDLE}</p></div><div class=related><a href=/1>{MIDDLE}</a></div><footer>Gazette</footer>", "11" "0" "0" "0"),
)


def features_of(page: str) -> list[list[float]]:
    """FEATURES of each block of a page."""
    blocks = flat_blocks(page)
    near = lambda i, name: blocks[i][name] if 0 <= i < len(blocks) else 0.0
    return [[b[f] for f in FIELDS[1:]] + [near(i + step, name) for step, name in NEIGHBOURS.values()] for i, b in enumerate(blocks)]


def fitted(spark: SparkSession, pages: tuple[tuple[str, str], ...] = TRAINING_PAGES, depth: int = 8):
    """A Spark ML decision tree over the blocks of labelled pages."""
    rows = [(float(y), *x) for page, ys in pages for x, y in zip(features_of(page), ys, strict=True)]
    table = spark.createDataFrame(rows, ", ".join(f"{c} double" for c in ("y", *FEATURES)))
    tree = DecisionTreeClassifier(labelCol="y", featuresCol="x", maxDepth=depth, minInstancesPerNode=1, maxBins=64, seed=7)
    return tree.fit(VectorAssembler(inputCols=list(FEATURES), outputCol="x").transform(table.coalesce(1)))


def compiled(model) -> list:
    """A fitted tree as nested [feature, threshold, left, right] lists with predictions as leaves."""

    def walk(node):
        if node.subtreeDepth() == 0:
            return float(node.prediction())
        return [FEATURES[node.split().featureIndex()], float(node.split().threshold()), walk(node.leftChild()), walk(node.rightChild())]

    return walk(model._java_obj.rootNode())


def decided(tree: list | float, block: Column) -> Column:
    """The tree as one expression over a block."""
    if isinstance(tree, float):
        return F.lit(tree == 1.0)
    name, threshold, left, right = tree
    return F.when(block[name] <= threshold, decided(left, block)).otherwise(decided(right, block))


def main_text(pages: DataFrame, tree: list | float) -> DataFrame:
    """pages with text, the article's blocks joined by newlines, in place of html."""
    kept = F.filter("_blocks", lambda b: decided(tree, b))
    text = F.array_join(F.transform(kept, lambda b: b["text"]), "\n")
    return unboxed(parsed_pages(pages), [c for c in pages.columns if c != "html"], text=text)


def op10_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    return main_text(pages, compiled(fitted(spark))).select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


#: For the markup of the given table only: the article element cut at its block tags, the character references that occur there decoded.
ORACLE = r"""WITH a AS (SELECT page_id, url, regexp_replace(regexp_extract(coalesce(html, ''), '<article>(.*)</article>', 1, 's'), '</?(b|i|a|em|strong)>', '', 'g') AS x FROM pages),
b AS (SELECT page_id, url, list_filter(list_transform(string_split_regex(x, '</?(p|h1|br|ul|li|div)>'),
  lambda p: trim(regexp_replace(regexp_replace(replace(regexp_replace(regexp_replace(regexp_replace(p, '&lt;?', '<', 'g'), '&gt;?', '>', 'g'), '&quot;?', '"', 'g'), '&#x27;', ''''), '&amp;?', '&', 'g'), '\s+', ' ', 'g'))), lambda p: p <> '') AS ps FROM a)
SELECT page_id, url, array_to_string(ps, chr(10)) AS text, CAST(length(array_to_string(ps, chr(10))) AS BIGINT) AS n_chars FROM b"""
