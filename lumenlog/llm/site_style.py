"""Main text of web pages by site style trees.

Pages of a host are merged into one tree, copies of a page counting once. Its element nodes are paths of tags with
their classes; an element's style nodes are the child sequences it shows, its content the blocks of text in it. The
presentation importance of an element is the entropy of its style nodes over the host's pages, the content importance
of a block one minus the entropy of the pages that show it; both fall to 0 for what every page repeats. A block goes
from each page when its composite importance is low, inside article and main elements as elsewhere.

Names are the prior. What a name marks as furniture has importance 0. Else a block starts at 1, or at OUTSIDE where it
lies outside the article or main elements of its page, and the host's m pages weigh against it as m to PRIOR_PAGES.
Inside an article or main element content importance falls by the share of pages instead of by their entropy, so that
a paragraph which some articles have in common stays and a notice which most of them show goes.

Scale: the merged tree is sums over (host, path, hash) keys, so a host of any size is spread by block; only blocks
that repeat and fall below the threshold go back to the pages. Few of them (FEW_LOW) are broadcast; else each page is
sent those that it has itself, never all of its host.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from hashlib import blake2b
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import read, stage

LOW = 0.3  # importance below which a branch is removed
SALTS = 16  # parts of the copies of a page in the join with its low branches
FEW_LOW = 1 << 16  # low blocks that may be broadcast
PRIOR_PAGES = 2.0  # pages that the names count for
OUTSIDE = 0.5  # importance by name of a block outside the article or main elements of its page
MOSTLY = 10  # so many times longer than all else is what a furniture name must not hide
GAMMA = 0.9  # weight of an element's descendants against its own presentation

#: Fixed values of HTML.
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe svg math object select".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr img".split())
FURNITURE = frozenset("head nav footer aside form button dialog menu fieldset input datalist".split()) | RAW
CLOSES_P = frozenset("address article aside blockquote details dialog div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
SAME_LEVEL = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
NAMES = re.compile(r"(?:^|[\s_-])(?:ads?|ad(?:box|slot|unit|wrap|container)s?|adverts?|advertisements?|advertising|sponsor(?:ed)?|banner|promo|cookies?|consent|gdpr|notices?|announcements?|alert|contentinfo|complementary|dialog|nav|navbar|navigation|menu|breadcrumbs?|sidebar|side|widget|footer|header|masthead|topbar|comments?|commentlist|disqus|replies|respond|reviews?|share|sharing|social|related|recommended|newsletter|subscribe|signup|login|search|popup|modal|overlay|pagination|pager|toolbar|skip)(?:$|[\s_-])", re.I)
#: Whole names that no article bears: remarks of readers and notices about cookies go, whatever their length.
SURE = re.compile(r"(?:^|\s)(?:(?:user-?|reader-?|post-?)?comments?(?:-?(?:list|section|area|thread|box|wrap|wrapper|container|form))?|commentlist|disqus(?:_|-)?(?:thread)?|cookies?-?(?:notice|banner|consent|bar|popup|message|policy|law)?|gdpr(?:-?(?:notice|banner|consent|bar))?|consent-?(?:notice|banner|bar|popup))(?=\s|$)", re.I)
TAG = re.compile(r"""<!--.*?(?:-->|$)|<!\[CDATA\[.*?\]\]>|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*)(?:>|$)""", re.S)
ATTRIBUTE = re.compile(r"""(?:^|\s)(class|id|role|hidden|aria-hidden)\s*(?:=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.I)


def _names(attributes: str) -> str:
    """Class, id and role of a tag, in lower case; 'hidden' for a hidden one."""
    if not attributes or "=" not in attributes and "hidden" not in attributes:
        return ""
    out = []
    for key, value in ATTRIBUTE.findall(attributes):
        value = value.strip("\"'")
        if key.lower() in ("class", "id", "role"):
            out.append(value)
        elif key.lower() == "hidden" or value.lower() == "true":
            out.append("hidden")
    return " ".join(" ".join(out).split()).lower()


def _furniture(tag: str, names: str, inside_main: bool) -> int:
    """0 for no furniture, 1 for what the tag, hiding or a sure name makes so, 2 for what its class, id or role does."""
    if tag in FURNITURE or tag == "header" and not inside_main:
        return 1
    if not names or tag in ("html", "body", "main") or names == "main":
        return 0
    return 1 if names == "hidden" or " hidden" in names or SURE.search(names) else 2 * bool(NAMES.search(names))


def _hash(text: str) -> int:
    return int.from_bytes(blake2b(text.encode("utf-8", "replace"), digest_size=8).digest(), "big", signed=True)


class Block:
    __slots__ = ("path", "main", "words")

    def __init__(self, path: int, main: bool, words: list[str]):
        self.path, self.main, self.words = path, main, words

    @property
    def text(self) -> str:
        return " ".join(self.words)

    @property
    def key(self) -> int:
        return _hash(f"{self.path}\n{self.text}")


def page_blocks(html: str) -> tuple[list[Block], dict[int, list[str]]]:
    """Blocks of text outside furniture, in page order, and the child sequence of each element outside furniture.

    Where the only article or main elements lie in elements whose class or id reads as furniture (a page "with
    sidebar"), those names are not believed. Nor is, on a page without such elements, the name of the longest branch that
    only its name makes furniture, where what else the page holds is under 1 / MOSTLY of its length (a "book review").
    """
    blocks, children, named = _page_blocks(html, False)
    if not any(b.main for b in blocks):
        if re.search("<(?:article|main)", html, re.I):
            again = _page_blocks(html, True)
            if any(b.main for b in again[0]):
                return again[:2]
        if named and MOSTLY * sum(len(b.text) for b in blocks) < max(named):
            return _page_blocks(html, False, named.index(max(named)))[:2]
    return blocks, children


def _page_blocks(html: str, revive: bool, spared: int = -1) -> tuple[list[Block], dict[int, list[str]], list[int]]:
    """Blocks, child sequences, and the characters of text in each outermost branch that its name makes furniture.

    revive: article and main elements in such branches are none; spared: the number of a branch that is none.
    """
    blocks: list[Block] = []
    children: dict[int, list[str]] = {}
    stack: list[tuple[str, int, bool, bool, int]] = [("", 0, False, False, -1)]  # tag, hash of the path, furniture, main, named branch
    run: list[str] = []
    named: list[int] = []

    def end_block() -> None:
        if run:
            words = unescape("".join(run)).split()
            run.clear()
            if words:
                at = next(x for x in reversed(stack) if x[0] not in INLINE)
                blocks.append(Block(at[1], at[3], words))

    def leave(depth: int) -> None:
        while len(stack) > depth:
            if stack[-1][0] not in INLINE:
                end_block()
            stack.pop()

    at, low = 0, None
    while at < len(html):
        tag = TAG.search(html, at)
        if tag is None or tag.start() > at:
            text = html[at : tag.start()] if tag else html[at:]
            if not stack[-1][2]:
                run.append(text)
            elif stack[-1][4] >= 0:
                named[stack[-1][4]] += len(text.strip())
        if tag is None:
            break
        at = tag.end()
        name = tag[2]
        if not name:
            continue
        name = name.lower()
        if tag[1]:
            for depth in range(len(stack) - 1, 0, -1):
                if stack[depth][0] == name:
                    leave(depth)
                    break
                if stack[depth][0] in ("article", "main", "body", "nav", "footer", "aside") and name in INLINE:
                    break  # a stray end tag
            continue
        if name == "br" or name == "hr":
            if not stack[-1][2]:
                run.append("\n")
            continue
        if name not in INLINE:
            end_block()
        if name in CLOSES_P:
            for depth in range(len(stack) - 1, 0, -1):
                if stack[depth][0] == "p":
                    leave(depth)
                    break
                if stack[depth][0] not in INLINE:
                    break
        for same in SAME_LEVEL.get(name, ()):
            for depth in range(len(stack) - 1, 0, -1):
                if stack[depth][0] == same:
                    leave(depth)
                    break
                if stack[depth][0] in ("ul", "ol", "dl", "table", "select", "menu"):
                    break
        if name in VOID:
            continue
        _, path, dropped, main, branch = stack[-1]
        names = _names(tag[3])
        kind = _furniture(name, names, main)
        if revive and dropped and name in ("article", "main") and all(x[0] not in FURNITURE for x in stack):
            dropped = bool(kind)
        elif dropped:
            branch = -1 if kind == 1 else branch
        elif kind == 2:
            branch = len(named)
            named.append(0)
            dropped = branch != spared
        else:
            dropped = bool(kind)
        main = not dropped and (main or name in ("article", "main") or "main" in names.split())
        shown = f"{name}.{names}" if names else name
        if not dropped:
            children.setdefault(path, []).append(shown)
            path = path if name in INLINE else _hash(f"{path}/{shown}")
        if name in RAW:  # its content is no markup
            low = low or html.lower()
            end = low.find(f"</{name}", at)
            at = len(html) if end < 0 else end
        if tag[3].endswith("/") and name not in INLINE:
            continue
        stack.append((name, path, dropped, main, branch))
    leave(1)
    end_block()
    return blocks, children, named


def host_of(url: str | None) -> str:
    match = re.search(r"://([^/?#]*)", url or "")
    return match[1].lower() if match else ""


PAGE = pa.schema({"content": pa.string(), "host": pa.string(), "page": pa.int64(), "style_path": pa.list_(pa.int64()), "style_key": pa.list_(pa.int64()), "path": pa.list_(pa.int64()), "key": pa.list_(pa.int64()), "prior": pa.list_(pa.float64()), "main": pa.list_(pa.int32())})


def _facts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each page its host, a hash of its blocks, its style nodes, and its blocks with their prior importance."""
    for batch in batches:
        rows: list[tuple] = []
        for content, url, html in zip(*(batch.column(i).to_pylist() for i in range(3))):
            blocks, children = page_blocks(html or "")
            outside = OUTSIDE if any(b.main for b in blocks) else 1.0
            own = {(b.path, b.key): b.main for b in blocks}
            page = _hash(" ".join(str(key) for _, key in sorted(own)))
            rows.append((content, host_of(url), page, list(children), [_hash(" ".join(x)) for x in children.values()], [path for path, _ in own], [key for _, key in own], [1.0 if x else outside for x in own.values()], list(map(int, own.values()))))
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * len(PAGE), PAGE.types)], schema=PAGE)


def low_branches(pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(host, key) of the blocks whose composite importance is low, and (content, host, key) of the blocks of each page.

    content is a digest that the pages bring along. Null urls are of the host ''; pages without text have no blocks.
    """
    kinds = "content string, host string, page long, style_path array<long>, style_key array<long>, path array<long>, key array<long>, prior array<double>, main array<int>"
    every = stage(pages.select("content", "url", "html").mapInArrow(_facts, kinds), "style")
    facts = stage(every.drop("content").dropDuplicates(["host", "page"]), "style-pages")
    m = facts.groupBy("host").agg(F.count("*").cast("double").alias("m"))
    block = facts.select("host", F.explode(F.arrays_zip("path", "key", "prior", "main")).alias("b")).groupBy("host", "b.path", "b.key").agg(F.count("*").cast("double").alias("c"), F.avg("b.prior").alias("prior"), F.avg("b.main").alias("main"))
    block = block.where("c > 1")  # what one page shows has a content importance of 1
    shown = facts.select("host", F.explode(F.arrays_zip("style_path", "style_key")).alias("s")).groupBy("host", F.col("s.style_path").alias("path"), F.col("s.style_key").alias("key")).agg(F.count("*").cast("double").alias("c"))
    style = shown.groupBy("host", "path").agg(F.sum("c").alias("n"), F.sum(F.col("c") * F.log("c")).alias("clogc"))
    # entropy to base m: of an element over the pages that show it, and of a block over the pages that repeat it
    both = block.join(style, ["host", "path"], "left").join(m, "host")
    presentation = F.coalesce((F.log("n") - F.col("clogc") / F.col("n")) / F.log("m"), F.lit(0.0))
    repeated = F.col("main") * F.col("c") / F.col("m") + (1 - F.col("main")) * F.log("c") / F.log("m")
    measured = (1 - GAMMA) * presentation + GAMMA * (1 - repeated)
    importance = (PRIOR_PAGES * F.col("prior") + F.col("m") * measured) / (PRIOR_PAGES + F.col("m"))
    return stage(both.where(importance < LOW).select("host", "key").distinct(), "low"), every.select("content", "host", F.explode("key").alias("key"))


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = []
        for html, low in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):  # low: keys, of the page or of its host
            blocks, _ = page_blocks(html or "")
            if low:
                low = set(low)
                blocks = [b for b in blocks if b.key not in low]
            texts.append(" ".join(b.text for b in blocks).encode("utf-8", "replace").decode())
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])


def main_texts(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text, n_chars of every row.

    Character references are decoded, white space inside a block becomes one space, blocks are joined by one space.
    A null html counts as empty and gives an empty text; a page gives what its host's tree leaves.
    Null urls share a host of their own. Markup may be broken anywhere. Repeated rows each give a row; other columns
    are ignored; an empty table gives no rows.
    """
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))
    rows = rows.withColumn("content", F.sha1(F.concat_ws("\n", F.coalesce("url", F.lit("")), F.coalesce("html", F.lit("")))))
    low, blocks = low_branches(rows)
    if low.count() <= FEW_LOW:
        host = F.lower(F.coalesce(F.regexp_extract("url", r"://([^/?#]*)", 1), F.lit("")))
        low = low.groupBy(F.col("host").alias("of_")).agg(F.collect_list("key").alias("low"))
        joined = rows.join(F.broadcast(low), host == F.col("of_"), "left")  # FEW_LOW keys at most
    else:
        own = blocks.distinct().join(low, ["host", "key"]).groupBy(F.col("content").alias("of_")).agg(F.collect_list("key").alias("low"))
        own = own.withColumn("salt_", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        salt = F.pmod(F.xxhash64("page_id"), F.lit(SALTS)).cast("int")
        joined = rows.join(own, (F.col("content") == F.col("of_")) & (salt == F.col("salt_")), "left")
    joined = joined.select("page_id", "url", "html", "low")
    return joined.mapInArrow(_texts, "page_id long, url string, text string, n_chars long")


def op7_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_texts(read(spark, sf_dir, "pages"))
