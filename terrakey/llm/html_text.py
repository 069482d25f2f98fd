"""Main text of web pages: the best contiguous region of words (positive) and tags (negative), found by one scan."""

from __future__ import annotations

import html
import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bounds of the fit: labelled pages, and tags with a weight of their own.
LABELLED_PAGES, KNOWN_TAGS = 5000, 5000
#: Words that a tag outweighs if it was never seen in content.
PENALTY = 40.0

# Fixed values of the HTML language: elements without an end, elements whose content is raw, elements that begin a block.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe noembed noframes xmp template".split())
BLOCKS = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "head header hgroup hr html legend li main menu nav ol optgroup option p pre search section select summary table tbody td tfoot th thead "
    "title tr ul".split()
)
# Elements, roles and class words that are not part of an article wherever they stand.
OUTSIDE = frozenset("script style textarea title noscript iframe noembed noframes xmp template head nav footer aside form menu dialog button select object svg canvas audio video".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar toolbar".split())
NAMES = frozenset(
    "ad ads advert adverts advertisement advertisements advertising sponsor sponsored sponsors promo promos promotion banner menu nav navbar navigation breadcrumb "
    "breadcrumbs sidebar side footer masthead topbar cookie cookies consent notice notices alert gdpr modal popup overlay newsletter subscribe signup login "
    "share sharing social related recommended recommendations comment comments commentlist disqus reply replies respond discussion widget pager pagination skip".split()
)
#: Parts that may stand beside such words in a hyphenated name without giving it another meaning.
PARTS = frozenset(
    "area article bar block blog bottom box btn button container entry form global group header inner item items left link links list main outer page panel policy post posts "
    "primary region right row secondary section site slot space thread title top unit widgets wp wrap wrapper".split()
)
#: Names of what holds an article: beside one, other names describe the layout and not the element.
HOLDERS = frozenset("article body container content entry layout main page post story text wrapper".split())
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>|</?[a-zA-Z](?:[^<>\"']|\"[^\"]*\"|'[^']*')*>|<|[^<]+", re.S)
_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)")
_ATTRIBUTE = re.compile(r"""\b(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"']+)))?""", re.I)


def left_out(value: str) -> bool:
    """Whether class or id names mark an element that is no part of an article.

    A name counts as a whole. A hyphenated one counts if each of its parts is such a word or says only where or what kind of box it is.
    """
    names = value.split()
    if any(n in HOLDERS for n in names):
        names = [n for n in names if n in NAMES]
    split = ([p for p in re.split(r"[-_]+", n) if p] for n in names)
    return any(any(p in NAMES for p in parts) and all(p in NAMES or p in PARTS for p in parts) for parts in split)


@dataclass
class Token:
    """A run of words or a tag: its name with its first class, the depth of what lies outside, and its text."""

    tag: str
    text: str
    outside: bool
    block: bool
    marked: bool


def tokens(page: str) -> Iterator[Token]:
    """The words and tags of a page in order.

    ``outside`` holds within elements that are never part of an article, ``marked`` within article or main elements.
    Unclosed elements end with the element that holds them; a stray end tag closes nothing.
    """
    stack: list[tuple[str, bool, bool]] = []
    held: Counter[str] = Counter()
    at, size = 0, len(page)
    while at < size:
        m = _TOKEN.match(page, at)
        piece, at = m[0], m.end()
        outside, marked = (stack[-1][1], stack[-1][2]) if stack else (False, False)
        if piece[0] != "<" or piece == "<":
            yield Token("", html.unescape(piece), outside, False, marked)
            continue
        t = _TAG.match(piece)
        if not t:
            continue
        name = t[2].lower()
        block = name in BLOCKS
        if t[1]:
            while held[name]:
                closed = stack.pop()[0]
                held[closed] -= 1
                if closed == name:
                    break
            yield Token("/" + name, "", outside, block, marked)
            continue
        # What HTML closes by itself: a paragraph at the next block, a list item at the next one.
        if block and stack and stack[-1][0] == "p" or name == "li" and stack and stack[-1][0] == "li":
            held[stack.pop()[0]] -= 1
            outside, marked = (stack[-1][1], stack[-1][2]) if stack else (False, False)
        label, off = name, name in OUTSIDE
        for a in _ATTRIBUTE.finditer(piece, t.end()):
            key, value = a[1].lower(), (a[2] or a[3] or a[4] or "").lower()
            if key == "class" and value.split():
                label = f"{name}.{value.split()[0]}"
            if name not in ("html", "body", "main"):
                off |= key in ("class", "id") and left_out(value) or key == "role" and value in ROLES
                off |= key == "hidden" or key == "aria-hidden" and value == "true" or key == "style" and "display:none" in value.replace(" ", "")
        # A header belongs to the page unless it is an article's own.
        off |= name == "header" and not marked
        yield Token(label, "", outside or off, block, marked or name in ("article", "main"))
        if name in RAW:
            end = re.compile(f"</{re.escape(name)}(?=[\\s/>])[^>]*>", re.I).search(page, at)
            at = end.end() if end else size
        elif name not in VOID and not piece.endswith("/>"):
            stack.append((name, outside or off, marked or name in ("article", "main")))
            held[name] += 1


def best_region(scores: list[float]) -> tuple[int, int]:
    """First and end of the contiguous run with the largest sum; the earliest and shortest of equal ones, empty if none is positive."""
    best, where, now, start = 0.0, (0, 0), 0.0, 0
    for i, x in enumerate(scores):
        if now <= 0:
            now, start = 0.0, i
        now += x
        if now > best:
            best, where = now, (start, i + 1)
    return where


def main_text(page: str, weights: dict[str, float]) -> str:
    """The blocks of a page's best region, joined by line ends."""
    items = list(tokens(page))
    scores = [0.0 if x.outside else float(len(x.text.split())) if not x.tag else -0.01 if x.marked else weights.get(x.tag, weights.get(x.tag.split(".")[0], -1.0)) for x in items]
    start, end = best_region(scores)
    blocks: list[list[str]] = [[]]
    for x in items[start:end]:
        if x.block and blocks[-1]:
            blocks.append([])
        if not x.outside:
            blocks[-1].append(x.text if not x.tag else " " if x.tag == "br" else "")
    lines = (" ".join("".join(b).split()) for b in blocks)
    return "\n".join(x for x in lines if x)


def _tag_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        inside: Counter[str] = Counter()
        total: Counter[str] = Counter()
        for page in batch.column(0).to_pylist():
            items = list(tokens(page))
            if any(x.marked and not x.tag and not x.outside and x.text.strip() for x in items):
                total[""] += 1
                for x in items:
                    if x.tag and not x.outside:
                        total[x.tag] += 1
                        inside[x.tag] += x.marked
        yield pa.RecordBatch.from_arrays([pa.array(list(total)), pa.array([inside[k] for k in total], pa.int64()), pa.array(list(total.values()), pa.int64())], ["tag", "inside", "total"])


def fit(pages: DataFrame, page_col: str = "html") -> dict[str, float]:
    """Weights of tags, from pages that label their own content by article or main elements.

    The fit takes a bounded sample, the LABELLED_PAGES pages with the smallest hashes of their html, and keeps the
    KNOWN_TAGS most frequent tags. A tag (with its first class) costs next to nothing if it lies in labelled content at
    least as often as not, and up to PENALTY words otherwise, by the share in which it lies there and by how often a page
    has it; so the number of pages makes no difference. Tags never seen cost one word. Elements that are left out anyway
    are not counted.
    """
    n = pages.count()
    share = min(1.0, 1.2 * LABELLED_PAGES / max(n, 1) + 100 / max(n, 1))
    h = F.pmod(F.xxhash64(page_col), F.lit(1 << 30))
    rows = pages.where(F.col(page_col).isNotNull() & (h < int(share * (1 << 30)))).select(F.col(page_col).alias("html"), h.alias("h"))
    rows = rows.orderBy("h").limit(LABELLED_PAGES).select("html")
    seen = rows.mapInArrow(_tag_rows, "tag string, inside long, total long").groupBy("tag").agg(F.sum("inside").alias("inside"), F.sum("total").alias("total"))
    out = {}
    found = seen.orderBy(F.col("tag") != "", F.desc("total"), "tag").limit(KNOWN_TAGS + 1).collect()
    labelled = found[0].total if found else 0
    for r in found[1:]:
        share_in = r.inside / r.total
        out[r.tag] = -0.01 if share_in >= 0.5 or r.tag.lstrip("/").split(".")[0] in ("article", "main") else -max(1.0, PENALTY * (1 - 2 * share_in) * min(1.0, r.total / labelled))
    return out


def extract(pages: DataFrame, weights: dict[str, float], page_col: str = "html") -> DataFrame:
    """Adds ``text`` and ``n_chars`` (code points) to every row of ``pages`` in place of the html.

    Words score one each, tags their (negative) weights, or next to nothing in content that the page itself labels; the
    region with the largest sum is the content. Words and tags in menus, forms, adverts and the like score nothing and are
    left out within the region too. White space in a block becomes
    one space, blocks are joined by line ends. A null or empty page has an empty text. Repeated rows
    give repeated results; columns named like the results are replaced. An empty table gives an empty result.
    """
    keep = [c for c in pages.columns if c not in (page_col, "text", "n_chars")]
    names = [f"_{i}" for i in range(len(keep))]
    rows = pages.select(F.col(page_col).alias("_html"), *(F.col(c).alias(x) for c, x in zip(keep, names, strict=True)))
    schema = ", ".join([*(f"{x} {rows.schema[x].dataType.simpleString()}" for x in names), "text string"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = [main_text(x.as_py() or "", weights) for x in batch.column(0)]
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(text, pa.string())], [*names, "text"])

    out = rows.mapInArrow(run, schema)
    return out.select(*(F.col(x).alias(c) for c, x in zip(keep, names, strict=True)), "text", F.length("text").cast("long").alias("n_chars"))


def op5_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main texts of all pages."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return extract(pages.select("page_id", "url", "html"), fit(pages))
