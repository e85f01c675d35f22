"""Main text of web pages: flat text blocks classified by a decision tree.

A page is cut into flat blocks of text. Each block has its word count and link density, those of its two
neighbours, and where in the page's markup it stands. A decision tree, trained on a small labelled table,
says which blocks are the article. The tree becomes a Column expression, so only parsing runs in Python.
"""

from __future__ import annotations

import html
import random
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.ml.classification import DecisionTreeClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from linkgauge.llm.text import spare_name

FEATURES = ["words", "links", "prev_words", "prev_links", "next_words", "next_links", "in_article", "in_chrome", "heading", "has_article"]

# HTML elements by their role in the page
RAW = {"script", "style", "noscript", "template", "svg", "iframe", "object", "canvas", "textarea", "select", "button", "audio", "video", "title", "datalist"}
# Of these, the ones whose content is no markup: only their own end tag ends them
RAW_TEXT = {"script", "style", "noscript", "iframe", "textarea", "title"}
BLOCKS = {"address", "article", "aside", "blockquote", "body", "caption", "center", "dd", "details", "dialog", "dir", "div", "dl", "dt", "fieldset",
          "figcaption", "figure", "footer", "form", "frameset", "h1", "h2", "h3", "h4", "h5", "h6", "head", "header", "hgroup", "hr", "html", "legend",
          "li", "main", "menu", "nav", "ol", "optgroup", "option", "p", "pre", "section", "summary", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul"}
CONTAINERS = {"article", "aside", "blockquote", "details", "dialog", "div", "dl", "fieldset", "figure", "footer", "form", "header", "hgroup", "li", "main",
              "menu", "nav", "ol", "p", "section", "span", "table", "td", "th", "tr", "ul", "a", "ins"}
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
CHROME_TAGS = {"nav", "aside", "footer", "menu", "dialog", "header"}
ARTICLE_TAGS = {"article", "main"}
# Closed without an end tag when the same element, or a container, begins or ends
SELF_ENDING = {"p", "li", "td", "th", "tr"}
CHROME_WORDS = {"nav", "navbar", "navigation", "menu", "breadcrumb", "breadcrumbs", "header", "masthead", "footer", "sidebar", "aside", "widget", "ad", "ads",
                "advert", "adverts", "advertisement", "advertising", "banner", "promo", "promoted", "promotion", "sponsor", "sponsored", "cookie", "cookies", "consent",
                "notice", "notices", "alert", "gdpr", "popup", "modal", "overlay", "newsletter", "subscribe", "signup", "login", "form", "search", "share",
                "sharing", "social", "related", "recommended", "comment", "comments", "commentlist", "disqus", "respond", "reply", "replies", "feedback",
                "discussion", "tags", "pagination", "pager", "copyright", "toolbar", "toc", "contentinfo", "complementary", "menubar", "alertdialog"}
ARTICLE_WORDS = {"article", "content", "post", "entry", "story", "main"}

# made pages of the labelled table
MADE_PAGES = 600

_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:"[^"]*+"|'[^']*+'|[^>"'])*+)>|<[!?/][^>]*+>""", re.DOTALL)
_END = {tag: re.compile(rf"</{tag}(?=[\s/>])[^>]*+>?", re.IGNORECASE) for tag in [*RAW, "head"]}
_ATTRIBUTE = re.compile(r"""(?:^|[\s"'/])(class|id|role|hidden|aria-hidden|style)(?=[\s=/]|$)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]+))?""", re.IGNORECASE)
_WORD = re.compile("[a-z]+")
# behind these a class name tells what a page lacks or holds elsewhere
_ABOUT = {"no", "not", "has", "with", "without", "hide"}
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.IGNORECASE)


def _marks(tag: str, attributes: str) -> tuple[bool, bool, bool]:
    """(article, chrome, hidden) of an element."""
    article, chrome, hidden = tag in ARTICLE_TAGS, tag in CHROME_TAGS, False
    for name, value in _ATTRIBUTE.findall(attributes):
        name, value = name.lower(), value.strip("\"'")
        if name in ("class", "id", "role"):
            for token in value.split():
                words = _WORD.findall(re.sub(r"([a-z])([A-Z])", r"\1 \2", token).lower())
                words = words[: next((i for i, w in enumerate(words) if w in _ABOUT), len(words))]
                if words:
                    chrome = chrome or words[0] in CHROME_WORDS or words[-1] in CHROME_WORDS
                    article = article or bool(ARTICLE_WORDS.intersection(words))
        elif name == "hidden" or name == "aria-hidden" and value.lower() == "true" or name == "style" and _HIDDEN.search(value):
            hidden = True
    return article and not chrome, chrome, hidden


def _end_of(tag: str, page: str, start: int, in_head: bool) -> int:
    """Behind the end tag of a raw element whose content begins at ``start``; -1 without one.

    A title without its end tag doesn't reach beyond the head.
    """
    head = _END["head"].search(page, start) if in_head and tag == "title" else None
    end = _END[tag].search(page, start, head.start() if head else len(page))
    return end.end() if end else -1


def blocks_of(page: str | None) -> list[tuple[str, list[float]]]:
    """(text, features) of each block with text, in page order; none for null or empty pages.

    Scripts, styles, forms' fields, the head and hidden elements have no blocks. Character references
    are decoded after the markup is cut, white space becomes one space, and no text is cut off.
    """
    found: list[list] = []  # text, words, link words, in_article, in_chrome, heading, innermost form
    forms = 0
    text: list[tuple[str, bool]] = []
    stack: list[tuple[str, bool, bool, bool, int]] = []  # tag, in article, in chrome, hidden, form
    links, heading, raw, outer, at, page = 0, "", "", "", 0, page or ""
    position, unclosed = 0, set()

    def state() -> tuple[bool, bool, bool, int]:
        return stack[-1][1:] if stack else (False, False, False, 0)

    def end_block() -> None:
        nonlocal text
        if text:
            whole = " ".join(html.unescape("".join(x for x, _ in text)).split())
            article, chrome, hidden, form = state()
            if whole and not hidden:
                n = whole.count(" ") + 1
                linked = len(html.unescape(" ".join(x for x, link in text if link)).split()) if any(link for _, link in text) else 0
                # a header's heading inside an article is the article's title
                titled = bool(heading) and article and all(not s[2] or s[0] in ("header", "hgroup", "div") and "article" in {t[0] for t in stack} for s in stack)
                found.append([whole, n, min(1.0, linked / n), article, chrome and not titled, bool(heading), form])
            text = []

    while token := _TOKEN.search(page, position):
        position = token.end()
        if token.start() > at and not raw:
            text.append((page[at : token.start()], links > 0))
        if not raw or token[1] and token[2].lower() == raw:
            at = token.end()
        closing, tag = token[1], (token[2] or "").lower()
        if not tag:
            continue
        if raw == "head" and not closing and tag in BLOCKS:  # a head without its end tag
            raw, at = "", token.end()
        opens = tag in RAW and not closing and not token[3].endswith("/")
        if raw:
            if closing and tag == raw:
                raw, outer = outer, ""
            elif opens and tag not in unclosed and (raw == "head" or tag in ("script", "style")):
                end = _end_of(tag, page, position, raw == "head")
                if end < 0:
                    unclosed.add(tag)
                elif tag in RAW_TEXT:
                    position = end
                else:
                    raw, outer = tag, raw
            continue
        if tag in RAW:
            if opens and tag in RAW_TEXT:
                at = position = _end_of(tag, page, position, False)
                if at < 0:
                    at = position = len(page)
            elif opens:
                raw = tag
            continue
        if tag == "head":
            end_block()
            raw = "" if closing else "head"
            continue
        if tag == "br":
            text.append((" ", False))
            continue
        if tag in BLOCKS:
            end_block()
            if tag in HEADINGS:
                heading = "" if closing else tag
            links = 0 if tag in CONTAINERS and tag != "p" else links
        if tag == "a":
            links = max(0, links - 1) if closing else 1
        if tag in CONTAINERS:
            if closing:
                for i in range(len(stack) - 1, -1, -1):
                    if stack[i][0] == tag:
                        del stack[i:]
                        break
                    if tag in SELF_ENDING | {"span", "a", "ins"} and stack[i][0] not in SELF_ENDING | {"span", "a", "ins"}:
                        break  # a stray end tag closes nothing outside its container
            else:
                if tag in SELF_ENDING and tag != "tr" or tag not in ("span", "a", "ins"):
                    while stack and stack[-1][0] in ("span", "a", "ins", "p"):
                        if stack[-1][0] != "p" and not any(s[0] == "p" for s in stack):
                            break
                        stack.pop()
                article, chrome, hidden, form = state()
                if tag == "form":
                    forms += 1
                    form = forms
                own = _marks(tag, token[3]) if token[3] or tag in CHROME_TAGS or tag in ARTICLE_TAGS else (False, False, False)
                stack.append((tag, article or own[0], chrome or own[1], hidden or own[2], form))
    if at < len(page) and not raw:
        text.append((page[at:], links > 0))
    end_block()
    # a form is no part of the article, unless it holds most of the page's words outside links: such a form wraps the page
    unlinked: dict[int, float] = {}
    for b in found:
        unlinked[b[6]] = unlinked.get(b[6], 0.0) + b[1] * (1 - b[2])
    for b in found:
        if b[6] and 2 * unlinked[b[6]] <= sum(unlinked.values()):
            b[4] = True
    has = any(b[3] and not b[4] for b in found)
    out = []
    for i, (whole, n, density, article, chrome, head, _) in enumerate(found):
        before = found[i - 1][1:3] if i else [0, 0.0]
        after = found[i + 1][1:3] if i + 1 < len(found) else [0, 0.0]
        out.append((whole, [float(x) for x in (n, density, *before, *after, article, chrome, head, has)]))
    return out


def page_blocks(pages: DataFrame, html_column: str = "html") -> DataFrame:
    """Every row of ``pages`` with blocks: array of (text, features)."""
    fields = pa.list_(pa.struct([("text", pa.string()), ("features", pa.list_(pa.float64()))]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                parsed = [[{"text": t, "features": f} for t, f in blocks_of(x.as_py())] for x in part.column(part.num_columns - 1)]
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(parsed, fields)], names=[*part.schema.names[:-1], "blocks"])

    kept = [c for c in pages.columns if c != html_column]
    given = pages.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(kept)], F.col(html_column).alias("page"))
    kinds = ", ".join(f"c{i} {dict(pages.dtypes)[c]}" for i, c in enumerate(kept))
    made = given.mapInArrow(run, f"{kinds}{', ' * bool(kept)}blocks array<struct<text: string, features: array<double>>>")
    return made.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(kept)], F.col("blocks").alias(spare_name(pages, "blocks")))


# The labelled table: small pages whose blocks begin with 1| (article) or 0| (anything else).
_PROSE = "1|The old bridge was rebuilt after the flood and the town paid for it with a small tax on every cart that crossed the river"
_SHORT = "1|It held."
_PAGES = [
    f"<nav><ul><li><a href=/>0|Home</a><li><a href=/n>0|News</a></ul></nav><div class=ad>0|Buy two lamps and get one free this week only.</div>"
    f"<article><h1>1|A bridge</h1><p>{_PROSE}<p>{_SHORT}<p>{_PROSE}</article><footer>0|&copy; 2020 The town paper</footer>",
    f"<header><h1>0|The paper</h1><a href=/>0|Home</a></header><main><h2>1|Floods</h2><p>{_SHORT}</p><p>{_PROSE} <a href=x>map</a></p><ul><li>1|first<li>1|second one</ul>"
    f"<aside>0|Read more about rivers and how they are measured in spring by the board</aside><p>{_PROSE}</p></main><form>0|Your mail <input></form>",
    f"<div id=menu><a href=a>0|One</a> <a href=b>two</a></div><div class=post-content><h1>1|Carts</h1><div>{_PROSE}</div><p>{_SHORT}</p></div>"
    f"<div class=comments><p>0|I crossed that bridge as a child and never knew about the tax, thank you for the story</p><p>0|Nice</p></div>"
    f"<div class=sidebar><h3>0|Popular</h3><p>0|The tower and its bells were the pride of the valley for more than a hundred years</p></div>",
    f"<div><a href=a>0|Home</a></div><div>0|Menu</div><h1>1|The market moved uphill after the water came</h1><div>{_PROSE}</div><div>{_PROSE} {_PROSE[2:]}</div><div>{_PROSE}</div>"
    f"<div><a href=a>0|Older story</a> <a href=b>Newer story</a></div><div>0|All rights reserved</div>",
    f"<div>0|Log in</div><div><a href=a>0|All the news from the valley of today and of yesterday in one place for you</a></div><p>{_PROSE}</p><p>{_PROSE}</p><p>{_PROSE}</p>"
    f"<div><a href=a>0|Next</a></div><div>0|Contact</div>",
    f"<div class=cookie-notice>0|We use cookies to make this page better for you and our partners, read the long policy here</div><article><header><h1>1|Title</h1></header><p>{_PROSE}"
    f"<div class=promo>0|Subscribe to our letter for ten coins a year and read every story</div><p>{_SHORT}<footer>0|Filed under rivers</footer><section id=comments><p>0|First!<p>0|{_PROSE[2:]}</section></article>",
    f"<div>0|Sections</div><div>0|Weather</div><div>0|Sport</div><p>{_PROSE}</p><p>1|The masons came from the north, and they stayed for two winters to finish it.</p><p>{_PROSE}</p><div>0|Share</div><div>0|Print</div>",
]


def _made_page(seed: int) -> str:
    """A labelled page: short and linked lines around paragraphs, of which some are short or linked too.

    Every third page names nothing in its markup. What tells a short paragraph from a short line, and a long notice
    from a paragraph, is then what stands next to it. The others name their parts by elements or by classes, and have
    lines and paragraphs of any length in them.
    """
    draw, style = random.Random(seed), seed % 3
    text = lambda n: " ".join(draw.choice(_PROSE[2:].split()) for _ in range(n))
    named = {0: ("<div>", "</div>"), 1: ("<nav>", "</nav>"), 2: (f"<div class={draw.choice(['menu', 'sidebar', 'post-comments', 'ad-top'])}>", "</div>")}

    def lines(most: int) -> str:
        sizes = [draw.randint(1, 3 if not style else draw.choice([3, 30])) for _ in range(draw.randint(2, most))]
        out = [f"<div>0|{text(n)}</div>" if draw.random() < 0.6 else f"<div><a href=x>0|{text(n)}</a></div>" for n in sizes]
        if draw.random() < 0.5:  # a notice among short lines
            out.insert(draw.randrange(1, len(out)), f"<div>0|{text(draw.randint(8, 14))}</div>")
        return named[style][0] + "".join(out) + named[style][1]

    def paragraph(n: int) -> str:
        linked = f" <a href=y>{text(draw.randint(1, 3))}</a>" if n > 9 and draw.random() < 0.3 else ""
        tag = draw.choice(["p", "div"])
        return f"<{tag}>1|{text(n)}{linked}</{tag}>"

    lengths = [draw.randint(15, 60), *[draw.choice([2, 3, 4, 12, 25, 40, 60]) for _ in range(draw.randint(0, 6))], draw.randint(15, 60)]
    if style:
        lengths = [draw.choice([1, 2, 4, 8, 9, 15, 40]) for _ in range(draw.randint(1, 8))]
    else:  # no two short ones in a row
        lengths = [n if n > 4 or lengths[i - 1] > 4 else 30 for i, n in enumerate(lengths)]
    begin, end = {0: ("", ""), 1: ("<article>", "</article>"), 2: ("<div class=post-content>", "</div>")}[style]
    heading = f"<h1>1|{text(draw.randint(3, 9))}</h1>" if draw.random() < 0.6 else ""
    before, after = (lines(n) if draw.random() < 0.6 else "" for n in (6, 5))
    return before + begin + heading + "".join(map(paragraph, lengths)) + end + after


def labelled_pages() -> list[str]:
    """The labelled table: pages written by hand and ``MADE_PAGES`` made ones."""
    return [*_PAGES, *[_made_page(seed) for seed in range(MADE_PAGES)]]


def labelled_blocks(spark: SparkSession, pages: list[str] | None = None) -> DataFrame:
    """features and label of every block of the labelled pages."""
    rows = []
    for page in labelled_pages() if pages is None else pages:
        for text, features in blocks_of(page):
            rows.append((*features, float(text.startswith("1|"))))
    return spark.createDataFrame(rows, ", ".join(f"{f} double" for f in [*FEATURES, "label"]))


def fit(labelled: DataFrame, depth: int = 6):
    """The root of a decision tree over ``FEATURES`` fitted to ``labelled``."""
    table = VectorAssembler(inputCols=FEATURES, outputCol="v").transform(labelled.coalesce(1))
    tree = DecisionTreeClassifier(featuresCol="v", maxDepth=depth, minInstancesPerNode=1, seed=3).fit(table)
    return _nested(tree._java_obj.rootNode())


def _nested(node):
    if node.getClass().getSimpleName() == "LeafNode":
        return node.prediction()
    return node.split().featureIndex(), node.split().threshold(), _nested(node.leftChild()), _nested(node.rightChild())


def tree_column(tree, features: Column) -> Column:
    """The tree's verdict on an array of features as one expression."""
    if isinstance(tree, float):
        return F.lit(tree > 0.5)
    feature, threshold, left, right = tree
    return F.when(features[feature] <= threshold, tree_column(left, features)).otherwise(tree_column(right, features))


def extract(pages: DataFrame, tree, html_column: str = "html") -> DataFrame:
    """Every row of ``pages``, without ``html_column``, with main_text: the article's blocks, one a line.

    Null, empty and text-free pages have an empty main_text. Repeated rows each stay, an empty table
    stays empty, and extra columns stay under their names.
    """
    blocks = page_blocks(pages, html_column)
    column = blocks.columns[-1]
    kept = F.filter(column, lambda b: tree_column(tree, b["features"]))
    return blocks.select(*blocks.columns[:-1], F.array_join(F.transform(kept, lambda b: b["text"]), "\n").alias(spare_name(pages, "main_text")))
