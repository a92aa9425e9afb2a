"""Main text of web pages by two-pass block rules.

A page is read tag by tag into blocks, the runs of text between block-level
tags; scripts, styles and other elements without text of their own have none.
The first pass decides a block from its share of link text, its share of stop
words and its length.  Markup is a feature that can only speak against a block:
one without a verdict, or with the verdict content, is boilerplate if it stands
in navigation, headers, footers, asides or forms by tag or role, in an element
whose class or id names a menu, notice, advert, comment section or similar, or
outside of the page's article.  What is then still open, short blocks and blocks
with few stop words, gets the label of its nearest decided neighbour in the second
pass, in an article that of the article's own; content wins a tie, and boilerplate
by markup counts as two blocks further away than it is.

Inside an article or main element a block needs stop words or length, and a list
of links follows its neighbours; elsewhere a block needs stop words and
length.  Character references are decoded once, white space in a block becomes
one space, blocks are joined in page order by one space, and nothing is capped.

Edge cases: null html is empty and gives an empty text; unclosed, crossed and
missing tags are closed where HTML closes them; an unclosed comment or script
runs to the end; a page without decided content gives an empty text; repeated
rows each give a row; ties go to content; very long pages are read whole; an empty
table gives an empty table; other input columns are ignored, whatever their names.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from lithoframe.llm.common import small_batches, table

#: Frequent function words of English, French, German and Spanish.
STOP_WORDS = frozenset(
    """
    the of and to in a is that for it as was with be by on not he his but at are this have from or had an they which one you were all her she there would their
    le la les de des du un une et en est que qui dans pour par sur au aux avec ce cette il elle ne pas plus son sa ses ou se nous vous leur mais sont
    der die das und in den von zu mit sich auf für ist im dem nicht ein eine als auch es an werden aus er hat dass sie nach wird bei einer um am sind noch wie
    el los las del y que en por con para una su al lo como más pero sus ya o este sí porque esta entre cuando muy sin sobre también me hasta hay donde
    """.split()
)

#: Lengths and shares that decide a block outside of articles.
SHORT, LONG, FEW_STOPS, MANY_STOPS, LINKED = 60, 160, 0.08, 0.16, 0.5

_RAW = frozenset("script style noscript template textarea iframe object svg canvas video audio title select button head".split())
_BOILER = frozenset("nav footer aside form dialog menu fieldset".split())
_BLOCK = frozenset("address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that a later start tag closes, and the start tags that do so.
_ENDS = {"p": _BLOCK - {"br"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "tbody", "tfoot"}, "td": {"td", "th", "tr", "tbody", "tfoot"}, "th": {"td", "th", "tr", "tbody", "tfoot"}, "option": {"option", "optgroup"}}
_SCOPE = frozenset("html body div section article main table ul ol dl nav aside footer header form td th".split())
_ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert menu menubar toolbar form".split())
_NAMES = re.compile(
    r"(?:^|[-_\s])(?:nav|navbar|navigation|menu|topmenu|submenu|breadcrumbs?|crumbs|pagination|pager|sidebar|side|aside|rail|footer|foot|header|masthead|topbar|toolbar|banner|ads?|advert|adverts|advertisement|advertising|adsense|"
    r"sponsor|sponsored|promo|promoted|promotion|cookies?|consent|gdpr|notice|notices|notification|alert|popup|modal|overlay|newsletter|subscribe|subscription|signup|signin|login|register|share|sharing|social|"
    r"related|recommended|recommendations|more-?links|comments?|commentlist|respond|replies|reply|disqus|widget|widgets|search|searchform|form|copyright|legal|disclaimer|skip|hidden|sr-only|tags?|tagcloud)(?:$|[-_\s\d])",
    re.I,
)
_TAG = re.compile(r"<!--.*?(?:--!?>|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([A-Za-z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<(/?)([A-Za-z][^\s/>]*)([^>]*)(?:>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"([^\s=\"'/>]+)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+))?")
_WORD = re.compile(r"[^\W\d_]+")


class _Open:
    __slots__ = ("article", "bad", "link", "name")

    def __init__(self, name: str, bad: bool, article: int, link: bool):
        self.name, self.bad, self.article, self.link = name, bad, article, link


def _boilerplate(name: str, attributes: str, inside: int) -> bool:
    if name in _BOILER or name == "header" and not inside:
        return True
    if not attributes or attributes.isspace():
        return False
    for key, value in _ATTRIBUTE.findall(attributes):
        key, value = key.lower(), value.strip("\"'")
        if key in ("class", "id") and name not in ("html", "body", "article", "main"):
            if _NAMES.search(value) and not (inside and name in ("header", "h1", "h2", "h3")):
                return True
        elif key in ("class", "id") and name == "article" and re.search(r"\bcomment|\breply|\bad\b|\bpromo", value, re.I):
            return True
        elif key == "role" and value.lower() in _ROLES or key == "hidden" or key == "aria-hidden" and value.lower() == "true":
            return True
        elif key == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
            return True
    return False


def blocks(page: str) -> list[tuple[str, int, int, bool]]:
    """(text, characters in links, number of the article or 0, boilerplate by markup) of every block."""
    out: list[tuple[str, int, int, bool]] = []
    stack = [_Open("", False, 0, False)]
    parts: list[str] = []
    linked = articles = 0

    def end_block() -> None:
        nonlocal linked
        if parts:
            text = " ".join("".join(parts).split())
            if text:
                out.append((text, min(linked, len(text)), stack[-1].article, stack[-1].bad))
            parts.clear()
        linked = 0

    def say(raw: str) -> None:
        nonlocal linked
        text = html.unescape(raw) if "&" in raw else raw
        parts.append(text)
        if stack[-1].link:
            linked += len(" ".join(text.split()))

    at = 0
    while (m := _TAG.search(page, at)) is not None:
        if m.start() > at:
            say(page[at : m.start()])
        at = m.end()
        name = m[2] or m[5]
        if not name:
            if m[0].startswith("<![CDATA["):
                say(m[0][9:].removesuffix("]]>"))
            continue
        name, closing, attributes = name.lower(), bool(m[1] or m[4]), m[3] or m[6] or ""
        if name in _BLOCK:
            end_block()
        if closing:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].name == name:
                    if stack[-1].bad != stack[k - 1].bad:
                        end_block()
                    del stack[k:]
                    break
                if stack[k].name in _SCOPE and name not in _SCOPE:
                    break
            continue
        if name in _RAW and name != "head":
            close = re.compile(rf"</{name}(?=[\s/>]|\Z)[^>]*(?:>|\Z)", re.I).search(page, at)
            if not attributes.endswith("/") or name not in ("svg",):
                at = close.end() if close else len(page)
            continue
        if name == "body":  # whatever the head left open ends here
            del stack[1:]
        while len(stack) > 1 and name in _ENDS.get(stack[-1].name, ()):
            stack.pop()
        if name in ("li", "td", "th", "tr", "dt", "dd"):
            for k in range(len(stack) - 1, 0, -1):
                if name in _ENDS.get(stack[k].name, ()):
                    del stack[k:]
                    break
                if stack[k].name in _SCOPE - {"td", "th"}:
                    break
        elif name in _BLOCK:  # a paragraph ends here even if inline tags in it were left open
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].name == "p":
                    del stack[k:]
                    break
                if stack[k].name in _SCOPE:
                    break
        if name in _VOID:
            continue
        top = stack[-1]
        article = top.article
        if name in ("article", "main"):
            while len(stack) > 1 and stack[-1].bad and not any(s.article for s in stack) and any(s.name in ("nav", "header", "aside", "footer") for s in stack):
                stack.pop()  # a menu or header left open does not swallow the article
            top = stack[-1]
            articles += 1
            article = top.article or articles
        bad = top.bad or _boilerplate(name, attributes, article)
        if bad != top.bad:
            end_block()
        stack.append(_Open(name, bad, article, top.link or name == "a"))
    if at < len(page):
        say(page[at:])
    end_block()
    return out


def stop_share(text: str) -> float:
    found = _WORD.findall(text.lower())
    return sum(w in STOP_WORDS for w in found) / len(found) if found else 0.0


def _decide(text: str, linked: int, article: int) -> tuple[bool | None, str]:
    """First pass: content, boilerplate or neither yet, and what said so."""
    share, stops = linked / len(text), stop_share(text)
    if share > LINKED:
        return (None, "") if article and (len(text) >= SHORT or share < 1) else (False, "links")
    if stops >= MANY_STOPS and (article or len(text) >= LONG) and (article or share <= 0.2):
        return True, "stop words"
    if len(text) < SHORT:
        return None, ""
    if article:
        return (True, "stop words") if stops >= FEW_STOPS else (None, "")
    if stops < FEW_STOPS:
        return False, "stop words"
    return (True, "stop words") if share <= 0.2 and stops >= MANY_STOPS else (None, "")


def _by_neighbours(labels: list[bool | None], articles: list[int], weak: list[bool]) -> list[bool]:
    """Second pass: every label, with those still open taken from the nearest decided neighbour.

    A block in an article looks at its article's blocks that are not ``weak``
    only, and is content without one; elsewhere a weak one counts as two blocks
    further away.
    """
    n = len(labels)
    nearest: list[list[tuple[int, bool] | None]] = [[None] * n, [None] * n]
    for side, order in zip(nearest, (range(n), range(n - 1, -1, -1))):
        last: int | None = None
        for k in order:
            if last is not None and (not articles[k] or articles[last] == articles[k]):
                side[k] = (abs(k - last) + 2 * weak[last], bool(labels[last]))
            if labels[k] is not None and not (articles[k] and weak[k]):
                last = k
    out = []
    for label, article, p, q in zip(labels, articles, *nearest):
        if label is None:
            if p is None and q is None:
                label = bool(article)
            elif p is None or q is None or p[1] == q[1]:
                label = (p or q)[1]
            else:
                label = True if p[0] == q[0] else (p if p[0] < q[0] else q)[1]
        out.append(label)
    return out


def labelled_blocks(page: str) -> list[tuple[str, bool, str]]:
    """(text, whether it is content, what decided: links, stop words, markup or neighbours) of every block."""
    found = blocks(page)
    anchored = any(article and not bad for _, _, article, bad in found)
    first = [_decide(text, linked, article) for text, linked, article, _ in found]
    for k, (_, _, article, bad) in enumerate(found):
        if first[k][0] is not False and (bad or anchored and not article):
            first[k] = False, "markup"
    weak = [bad or bool(article) and label is False for (_, _, article, bad), (label, _) in zip(found, first)]
    final = _by_neighbours([label for label, _ in first], [article for _, _, article, _ in found], weak)
    return [(text, keep, by or "neighbours") for (text, *_), keep, (_, by) in zip(found, final, first)]


def main_text(page: str | None) -> str:
    """The article of a page as plain text."""
    return " ".join(text for text, keep, _ in labelled_blocks(page or "") if keep)


def extract_text(df: DataFrame, *, html_col: str = "html", keep: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """The ``keep`` columns, text and n_chars (code points) of every row."""
    kept = [f"__c{k}" for k in range(len(keep))]
    rows = df.select(F.coalesce(F.col(html_col).cast("string"), F.lit("")).alias("__html"), *[F.col(c).alias(k) for c, k in zip(keep, kept)])
    schema = StructType([*rows.schema.fields[1:], StructField("__text", StringType()), StructField("__n", LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, batch.num_rows, 512):
                part = batch.slice(first, 512)
                texts = [main_text(x) for x in part.column(0).to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns[1:], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=schema.names)

    return small_batches(rows).mapInArrow(run, schema).select(*[F.col(k).alias(c) for c, k in zip(keep, kept)], F.col("__text").alias("text"), F.col("__n").alias("n_chars"))


def op5_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_text(table(spark, sf_dir, "pages"))
