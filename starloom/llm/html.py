"""Main text of web pages with site template removal.

A page is read into blocks (runs of text between block-level tags) and the block-level subtrees
above them. Each subtree is hashed: its tags, classes and text. Subtrees are counted per host in
Spark, once for each distinct page body; those that recur on many pages of the host are the site's
template. The pages are then read once more and everything in such a subtree is deleted. Elements
that are never part of an article (menus, headers, footers, sidebars, notices, adverts, forms,
scripts, comments by readers) also go by their tag, role or class, and where a page marks an article
or main element, only what stands in it is its main text.

Prose that stands directly in the article (paragraphs, headings, quotes) is counted only where it
begins the article, after its headings, or ends it, and goes there if it does so on EDGE_SHARE of the
host's pages: notices stand there, while a passage that many articles quote inside stays.

Defined results: null or empty html gives an empty text; broken or cut-off markup is read as far as
it goes; a null url is a host of its own name ''; repeated rows are extracted each and count as one
page for the template; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from starloom.llm.common import discard, materialise

#: A subtree is template if it stands on so many distinct pages of its host, and on this share of them.
MIN_PAGES, MIN_SHARE = 4, 0.3
#: The share for prose at the beginning or end of articles, and the blocks without headings that an article needs for these to stand apart.
EDGE_SHARE, EDGE_BLOCKS = 0.5, 3

#: Fixed values of HTML: tags whose content is no text, void tags, tags that begin a block of text.
RAW = "script style noscript template svg math iframe object canvas textarea title xmp noembed noframes".split()
VOID = {*"area base br col embed hr img input link meta param source track wbr".split()}
BLOCKS = {*"html body address article aside blockquote canvas center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()}
#: Tags that are never part of an article.
APART = {*"nav footer aside form menu dialog button select option datalist label input head audio video map".split()}
APART_ROLES = {*"navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar".split()}
#: A class or id with one of these words marks an element as no part of the article.
APART_NAMES = re.compile(
    r"(?:^|[\s_-])(?:ads?|adverts?|advertisements?|advertising|adsense|banner|sponsor(?:ed|s)?|promo(?:tion|s)?|nav|navbar|navigation|menu|breadcrumbs?|sidebar|side-bar|footer|site-?header|page-?header|masthead|topbar|cookies?|consent|gdpr|notices?|popup|modal|overlay|newsletter|subscribe|subscription|signup|login|share|sharing|social|related|recommended|recommendations|comments?|comment-?list|commentlist|disqus|respond|replies|pagination|pager|toolbar|widget|skip-?link|legal|copyright|disclaimer|paywall|toc)(?:$|[\s_-])",
    re.I,
)
#: Prose tags: directly in an article they are counted at its edges only.
PROSE = {*"p h1 h2 h3 h4 h5 h6 blockquote pre article main body html figcaption".split()}
HEADINGS = {*"h1 h2 h3 h4 h5 h6".split()}
#: A paragraph ends where one of these begins.
CLOSES_P = BLOCKS - {"html", "body"}
SIBLINGS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SCOPES = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table", "tbody", "thead", "tfoot"}, "td": {"tr", "table"}, "th": {"tr", "table"}, "option": {"select", "datalist"}}

PIECE = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(>|\Z)", re.S)
RAW_ENDS = {t: re.compile(rf"</{t}[\s/>]", re.I) for t in RAW}
ATTRIBUTES = re.compile(r"""([^\s"'<>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]*)))?""")
WHITE = re.compile(r"\s+")


class Element:
    __slots__ = ("tag", "apart", "number", "digest", "main", "prose")

    def __init__(self, tag: str, apart: bool, number: int, name: str, main: bool, prose: bool):
        self.tag, self.apart, self.number, self.main, self.prose = tag, apart, number, main, prose
        self.digest = xxhash.xxh64(f"<{tag} {name}>")


class Block(NamedTuple):
    text: str
    main: bool
    #: Number of the innermost subtree that a template may claim, -1 for none; whether it is prose of the article.
    above: int
    prose: bool
    heading: bool


class Page(NamedTuple):
    blocks: list[Block]
    #: Hash of each subtree and the number of the next one outside it, which is smaller; whether it counts as prose at an edge of the article, or as prose inside, which isn't counted.
    hashes: list[int]
    outside: list[int]
    edge: list[bool]
    inner: list[bool]

    def text(self, gone: set[int]) -> str:
        """What is left without the subtrees whose hash is in ``gone``."""
        dead: list[bool] = []
        for h, up, inner in zip(self.hashes, self.outside, self.inner):
            dead.append(up >= 0 and dead[up] or not inner and h in gone)
        return "\n\n".join(b.text for b in self.blocks if b.above < 0 or not dead[b.above])


def is_apart(tag: str, attributes: str, in_main: bool) -> tuple[bool, str]:
    """Whether an element is no part of an article by its tag or attributes; its class and id."""
    apart = tag in APART or tag == "header" and not in_main
    name = ""
    if attributes and not attributes.isspace():
        for key, *values in ATTRIBUTES.findall(attributes):
            key, value = key.lower(), next(filter(None, values), "")
            if key in ("class", "id"):
                name += f" {value}"
                apart = apart or tag not in ("html", "body", "article", "main") and bool(APART_NAMES.search(value))
            elif key == "role":
                apart = apart or value.strip().lower() in APART_ROLES
            elif key == "hidden" or key == "aria-hidden" and value == "true" or key == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
                apart = apart or tag not in ("html", "body")
    return apart, name.strip()


def end_of(tag: str, page: str, at: int) -> int:
    """Where the inline element that begins before ``at`` ends; ``at`` if it is never closed."""
    depth = 1
    for found in re.compile(rf"<(/?){tag}(?=[\s/>])[^>]*>", re.I).finditer(page, at):
        depth += -1 if found[1] else not found[0].endswith("/>")
        if not depth:
            return found.end()
    return at


def read_page(page: str) -> Page:
    """Blocks and subtrees of a page. Blocks in elements apart are left out."""
    blocks: list[Block] = []
    hashes: list[int] = []
    outside: list[int] = []
    prose_at: list[bool] = []
    stack: list[Element] = []
    words: list[str] = []
    apart = main = 0
    at, end = 0, len(page)

    def flush() -> None:
        if words:
            text = WHITE.sub(" ", entities.unescape("".join(words))).strip()
            words.clear()
            if text:
                inside = stack[-1] if stack else None
                if inside:
                    inside.digest.update(text)
                number = inside.number if inside else -1
                blocks.append(Block(text, main > 0, number, number >= 0 and prose_at[number], bool(inside) and inside.tag in HEADINGS))

    def close() -> None:
        nonlocal apart, main
        flush()
        e = stack.pop()
        apart -= e.apart
        main -= e.main
        if e.number >= 0 and (not stack or stack[-1].number != e.number):
            hashes[e.number] = e.digest.intdigest() - (1 << 63)
        for above in stack[-1:]:
            above.digest.update(e.digest.digest())

    def close_to(tags: set[str], stops: set[str]) -> None:
        """Closes the innermost open element of ``tags``, unless one of ``stops`` stands inside it."""
        for k in range(len(stack) - 1, -1, -1):
            if stack[k].tag in tags:
                while len(stack) > k:
                    close()
                return
            if stack[k].tag in stops:
                return

    for piece in PIECE.finditer(page):
        begin = piece.start()
        if begin < at:
            continue  # inside a raw element
        if not apart and begin > at:
            words.append(page[at:begin])
        at = piece.end()
        tag = piece[2]
        if tag is None:
            continue
        tag = tag.lower()
        if piece[1]:
            if tag in BLOCKS or tag in APART:
                if tag == "p" or any(e.tag == tag for e in stack):
                    close_to({tag}, set() if tag != "p" else BLOCKS - {"p"})
            continue
        if tag in RAW_ENDS:
            if not piece[3].endswith("/"):
                found = RAW_ENDS[tag].search(page, at)
                at = found.start() if found else end
            continue
        if tag == "br":
            words.append(" ")
            continue
        if tag not in BLOCKS and tag not in APART:
            if tag not in VOID and piece[3]:
                # An inline element that is apart by its class (a share link, an advert) takes its text with it.
                if is_apart(tag, piece[3], main > 0)[0] and tag in ("span", "a", "ins", "small", "sup", "b", "i", "em", "strong", "font"):
                    at = end_of(tag, page, at)
            continue
        flush()
        if tag in CLOSES_P:
            close_to({"p"}, {"button", "table", "td", "th", "article", "section", "div", "li", "blockquote"})
        if tag in SIBLINGS:
            close_to(SIBLINGS[tag], SCOPES[tag])
        if tag in VOID:
            continue
        gone, name = is_apart(tag, piece[3], main > 0)
        is_main = tag in ("article", "main")
        prose = tag in PROSE
        # An element that no template may claim has the number of the one around it.
        number = stack[-1].number if stack else -1
        if not apart and not gone and tag not in ("html", "body", "article", "main"):
            hashes.append(0)
            outside.append(number)
            prose_at.append(prose and main > 0)
            number = len(hashes) - 1
        stack.append(Element(tag, gone, number, name, is_main, prose))
        apart += gone
        main += is_main
    if not apart and at < end:
        rest = page[at:]
        words.append(rest[: rest.rindex("<")] if re.search(r"<[/a-zA-Z!][^<]*\Z", rest) else rest)
    while stack:
        close()
    flush()
    if any(b.main for b in blocks):
        blocks = [b for b in blocks if b.main]  # a page that marks its article holds the main text there
    edge = [False] * len(hashes)
    body = next((k for k, b in enumerate(blocks) if not b.heading), 0)
    for b in {*blocks[body : body + 1], *blocks[-1:]}:
        if b.prose and sum(not x.heading for x in blocks) >= EDGE_BLOCKS:
            edge[b.above] = True
    return Page(blocks, hashes, outside, edge, [p and not e for p, e in zip(prose_at, edge)])


def with_host(pages: DataFrame, id_col: str, url_col: str, html_col: str) -> DataFrame:
    """page_id, url, html, host, key (hash of the html)."""
    d = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.coalesce(F.col(html_col).cast("string"), F.lit("")).alias("html"))
    host = F.coalesce(F.lower(F.regexp_extract("url", r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", 1)), F.lit(""))
    return d.withColumn("host", host).withColumn("key", F.xxhash64("html"))


def page_subtrees(pages: DataFrame) -> DataFrame:
    """host, key, body (hash of all blocks), subtrees array<struct<h, edge>> of every page of ``with_host``."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bodies, found = [], []
            for html in batch.column(2):
                page = read_page(html.as_py())
                bodies.append(xxhash.xxh64_intdigest("\n\n".join(b.text for b in page.blocks)) - (1 << 63))
                found.append([{"h": h, "edge": e} for h, e in dict.fromkeys((h, e) for h, e, inner in zip(page.hashes, page.edge, page.inner) if not inner)])
            kind = pa.list_(pa.struct([("h", pa.int64()), ("edge", pa.bool_())]))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(bodies, pa.int64()), pa.array(found, kind)], ["host", "key", "body", "subtrees"])

    return pages.select("host", "key", "html").mapInArrow(run, "host string, key long, body long, subtrees array<struct<h:long,edge:boolean>>")


def template_subtrees(subtrees: DataFrame, min_pages: int = MIN_PAGES, min_share: float = MIN_SHARE, edge_share: float = EDGE_SHARE) -> DataFrame:
    """host, h: hashes of subtrees that recur on many distinct pages of the host."""
    seen = subtrees.select("host", "body", F.explode("subtrees").alias("s")).select("host", "body", "s.*").distinct().groupBy("host", "h", "edge").agg(F.count("*").alias("n")).where(F.col("n") >= min_pages)
    pages = subtrees.select("host", "body").distinct().groupBy("host").agg(F.count("*").alias("pages"))
    share = F.when(F.col("edge"), F.lit(edge_share)).otherwise(F.lit(min_share))
    return seen.join(pages, "host").where(F.col("n") >= share * F.col("pages")).select("host", "h").distinct()


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", min_pages: int = MIN_PAGES, min_share: float = MIN_SHARE, edge_share: float = EDGE_SHARE) -> DataFrame:
    """page_id, url, text, n_chars of every page."""
    d = with_host(pages, id_col, url_col, html_col)
    # Only hashes are written; the texts are read from the pages once more, which costs less than keeping them.
    subtrees = materialise(page_subtrees(d), "subtrees")
    template = template_subtrees(subtrees, min_pages, min_share, edge_share)
    gone = subtrees.select("host", "key", F.explode("subtrees").alias("s")).select("host", "key", "s.h").distinct().join(template, ["host", "h"])
    gone = materialise(gone.groupBy(F.col("host").alias("g_host"), F.col("key").alias("g_key")).agg(F.collect_set("h").alias("gone")), "gone")
    discard(subtrees)
    joined = d.join(gone, (F.col("host") == F.col("g_host")) & (F.col("key") == F.col("g_key")), "left").select("page_id", "url", "html", "gone")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [read_page(html.as_py()).text({*(g.as_py() or ())}) for html, g in zip(batch.column(2), batch.column(3))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string())], ["page_id", "url", "text"])

    return joined.mapInArrow(run, "page_id long, url string, text string").withColumn("n_chars", F.char_length("text").cast("long"))
