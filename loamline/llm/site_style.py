"""Main text of web pages by a site style tree.

Every page is parsed once into its blocks of text, written as small rows: text, style path and what the markup itself says. A style path
is the chain of styles (tag with classes and ids) from the root, told by a 64-bit digest, so it may be of any depth.

The style tree merges the pages of a host by these paths, and a second one the pages of all hosts. In a tree, a path that stands in m
pages has

* content importance: the mean over its different texts (blocks, divided at separators like "·") of 1 - log(c) / log(m), where c pages hold
  the text: 1 where each page has texts of its own, 0 where all share theirs. Each different text counts once, and pages with the
  same texts under the same paths count once, so copies of an article don't look like furniture;
* presentation importance: the entropy of the style sequences of its children, as a share of log(m), which counts the more,
  the more of them there are (1 - 0.9^l for l sequences).

The importance of a path is the greater of its content importance and of both together. It is weighed by its evidence: 1 - (1 - 1/m)(1 - importance), so one page
says nothing and every further one more, without a bound where it sets in. A branch is removed where its weighed importance is under LOW of that of the path which holds
the most different text by words, which is the article's, in the host's tree or in that of all hosts. The markup is the prior: inside an article element
headings, paragraphs, lists, tables and the like are article text, however many pages repeat them; only text that stands directly in a generic element of a
named style (a div of the site's own) goes there, and only under INSIDE of the main path. Beside the tree, the markup itself removes

* what no reader sees (scripts, styles, forms, comments in the markup, hidden elements),
* branches whose tag, role, class or id names page furniture: menus, headers, footers, side bars, notices, adverts, reader comments,
* where a page has article or main elements, all that is outside of them.

The tree is needed where markup says nothing: generic elements with names of the site's own. It is plain aggregations over the blocks;
the removed paths are joined to the pages of their host.

Null or empty html gives an empty text; a null url counts as the host ''. Repeated rows give repeated rows; extra columns are ignored; an
empty table gives an empty result. Very long pages are treated like others: nothing is cut at any length or depth. Of tied main paths (equally much text) the one with the greater
digest counts; equal pages of a host count once, so ties among rows change nothing.
"""

from __future__ import annotations

import hashlib
import html as markup
import re
from collections import Counter
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, join_skewed, map_slices, small_enough, written

# Element names of the HTML standard and common names of page furniture.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes noscript".split())
UNSEEN = frozenset("head script style template noscript noembed noframes iframe object svg annotation annotation-xml canvas audio video select option button textarea input form datalist dialog title".split())
FURNITURE = frozenset("nav footer aside menu".split())
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul".split()
)
GENERIC = frozenset("center details dir div fieldset header hgroup section summary".split())
ROLES = frozenset("navigation banner contentinfo complementary search menu menubar toolbar alert dialog form".split())
NAMES = re.compile(
    r"(?:^|[-_ ])(?:ad|ads|adv|advert|adverts|advertisement|advertising|adsense|sponsor|sponsored|promo|promotion|banner|cookie|cookies|consent|gdpr|notice|notices|alert|"
    r"sidebar|side-bar|aside|menu|nav|navbar|navigation|breadcrumb|breadcrumbs|topbar|masthead|footer|foot|site-header|page-header|comment|comments|commentlist|disqus|respond|reply|replies|"
    r"share|sharing|social|related|recommended|newsletter|subscribe|subscription|signup|popup|modal|overlay|widget|login|search|pagination|pager|skip)(?:$|[-_ ])"
)
CLOSES_P = BLOCKS - {"body", "html", "li", "dd", "dt", "tr", "td", "th", "tbody", "thead", "tfoot", "caption", "legend", "summary"}
PEERS = {"li": {"li"}, "dd": {"dd", "dt"}, "dt": {"dd", "dt"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "tbody": {"thead", "tbody", "tr", "td", "th"}}
SCOPES = {"li": {"ul", "ol", "menu"}, "dd": {"dl"}, "dt": {"dl"}, "tr": {"table"}, "td": {"table", "tr"}, "th": {"table", "tr"}, "option": {"select"}, "tbody": {"table"}}

TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|</?([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*)>|<[!?/a-zA-Z][^>]*>|[^<]+|<""", re.S)
ATTRIBUTE = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")

PARTS = re.compile(r" *[·|•©»]+ *")

LOW, INSIDE = 0.8, 0.4
READ, NAMED_FURNITURE, UNREAD = 0, 1, 2


def host_of(url: str | None) -> str:
    found = re.match(r"(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//(?:[^/@?#]*@)?([^/:?#]*)", url or "")
    return found[1].lower() if found else ""


@lru_cache(maxsize=1 << 16)
def digest(*parts: str | int) -> int:
    """A 64-bit digest of some values."""
    return int.from_bytes(hashlib.blake2b("\0".join(map(str, parts)).encode("utf-8", "replace"), digest_size=8).digest(), "little", signed=True)


def path_key(path: str) -> int:
    """The digest of a style path written as /style/style/..."""
    key = 0
    for style in path.split("/")[1:]:
        key = digest(key, style)
    return key


class Block:
    """A run of text in one block element: its style path, whether its element is a generic one of a named style, whether it is furniture or unseen, and whether an article holds it."""

    __slots__ = ("article", "dropped", "named", "parts", "path")

    def __init__(self, path: int, named: bool, dropped: int, article: bool):
        self.path, self.named, self.dropped, self.article, self.parts = path, named, dropped, article, []

    def text(self) -> str:
        return " ".join("".join(self.parts).split())


def parse(page: str) -> tuple[list[Block], dict[int, list[str]]]:
    """The blocks of a page in order, and the styles of the children of each style path."""
    # open elements: (tag, path, named, dropped, inside an article)
    blocks: list[Block] = []
    children: dict[int, list[str]] = {}
    stack: list[tuple[str, int, bool, int, bool]] = [("", 0, False, READ, False)]
    current: Block | None = None
    opened: Counter[str] = Counter()
    at, n = 0, len(page)

    def close_to(depth: int) -> None:
        nonlocal current
        for e in stack[depth:]:
            opened[e[0]] -= 1
            if e[0] in BLOCKS:
                current = None
        del stack[depth:]

    def last(tags: set[str] | frozenset[str], stop: set[str] | frozenset[str] = frozenset()) -> int:
        if not any(opened[t] for t in tags):
            return 0
        for i in range(len(stack) - 1, 0, -1):
            if stack[i][0] in tags:
                return i
            if stack[i][0] in stop:
                return 0
        return 0

    while at < n:
        m = TOKEN.match(page, at)
        at = m.end()
        tag = m[1]
        if tag is None:
            token = m[0]
            if token[0] == "<" and len(token) > 1:
                continue
            _, path, named, dropped, article = stack[-1]
            if current is None:
                if token.isspace():
                    continue
                current = Block(path, named, dropped, article)
                blocks.append(current)
            elif dropped != current.dropped:  # an inline element that is not to be read, or the text after it
                if dropped > current.dropped:
                    continue
                current = Block(path, named, dropped, article)
                blocks.append(current)
            current.parts.append(markup.unescape(token) if "&" in token else token)
            continue
        tag = tag.lower()
        if page[m.start() + 1] == "/":
            if tag == "br":
                if current is not None:
                    current.parts.append(" ")
            elif i := last({tag}, {"table", "td", "th"} if tag not in BLOCKS else frozenset()):
                close_to(i)
            elif tag == "p":
                current = None
            continue
        if tag == "br":
            if current is not None:
                current.parts.append(" ")
            continue
        if tag in CLOSES_P and (i := last({"p"}, {"td", "th", "li", "div", "article", "section", "body", "button"})):
            close_to(i)
        if tag in PEERS and (i := last(PEERS[tag], SCOPES[tag])):
            close_to(i)
        attributes = m[2]
        style, role, names, hidden = tag, "", "", False
        if attributes and attributes != "/":
            for a in ATTRIBUTE.finditer(attributes):
                key, value = a[1].lower(), a[2] or a[3] or a[4] or ""
                if key in ("class", "id"):
                    names += f" {value.lower()}"
                elif key == "role":
                    role = value.lower()
                elif key == "hidden" or key == "aria-hidden" and value == "true" or key == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
                    hidden = True
            if names:
                style = f"{tag}.{'.'.join(sorted(re.sub(r'[0-9]+', '0', names).split()))}"
        if tag in BLOCKS:
            current = None
        _, path, named, dropped, article = stack[-1]
        if tag in BLOCKS:
            named = names != "" and tag in GENERIC
        children.setdefault(path, []).append(style)
        if hidden or tag in UNSEEN:
            dropped = UNREAD
        elif not dropped and (tag in FURNITURE or role in ROLES or ((tag == "header" or "header" in names.split()) and not article) or (names != "" and tag not in ("html", "body", "article", "main") and NAMES.search(names) is not None)):
            dropped = NAMED_FURNITURE
        article = article or tag in ("article", "main") or role in ("main", "article")
        if tag in VOID or (attributes or "").endswith("/"):
            continue
        stack.append((tag, digest(path, style), named, dropped, article))
        opened[tag] += 1
        if tag in RAW:
            end = re.compile(rf"</{tag}(?=[\s/>])", re.I).search(page, at)
            at = end.start() if end else n
    return blocks, children


def page_blocks(pages: DataFrame) -> DataFrame:
    """page_id, url, host (its digest), page (a digest of its texts and paths), row, blocks and nodes of every page: blocks have path, named, dropped, article, parts (digest and words) and text; nodes a path and the digest of its children's styles."""

    def emit(batch: pa.RecordBatch) -> pa.RecordBatch:
        hosts, keys, sizes, node_sizes = [], [], [], []
        path, named, dropped, article, value, words, counts, texts, node, shape = ([] for _ in range(10))
        for url, html in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
            blocks, children = parse(html or "")
            seen = [(b, t) for b in blocks if b.dropped != UNREAD and (t := b.text())]
            hosts.append(digest(host_of(url)))
            keys.append(digest(*sorted(digest(b.path, t) for b, t in seen)))
            for _, t in seen:
                parts = [x for x in PARTS.split(t) if x] or [t]
                value += [digest(x) for x in parts]
                words += [x.count(" ") + 1 for x in parts]
                counts.append(len(parts))
            sizes.append(len(seen))
            path += [b.path for b, _ in seen]
            named += [b.named for b, _ in seen]
            dropped += [b.dropped for b, _ in seen]
            article += [b.article for b, _ in seen]
            texts += [t for _, t in seen]
            node_sizes.append(len(children))
            node += children
            shape += [digest(*c) for c in children.values()]
        offsets = lambda n: pa.array(np.concatenate([[0], np.cumsum(n)]), pa.int32())
        part = pa.StructArray.from_arrays([pa.array(value, pa.int64()), pa.array(words, pa.int32())], ["value", "words"])
        plain = [pa.array(x, k) for x, k in zip((path, named, dropped, article), (pa.int64(), pa.bool_(), pa.int32(), pa.bool_()), strict=True)]
        block = pa.StructArray.from_arrays([*plain, pa.ListArray.from_arrays(offsets(counts), part), pa.array(texts, pa.string())], ["path", "named", "dropped", "article", "parts", "text"])
        nodes = pa.StructArray.from_arrays([pa.array(node, pa.int64()), pa.array(shape, pa.int64())], ["path", "value"])
        lists = [pa.ListArray.from_arrays(offsets(n), x) for n, x in ((sizes, block), (node_sizes, nodes))]
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(hosts, pa.int64()), pa.array(keys, pa.int64()), *lists], ["page_id", "url", "host", "page", "blocks", "nodes"])

    schema = "page_id long, url string, host long, page long, blocks array<struct<path: long, named: boolean, dropped: int, article: boolean, parts: array<struct<value: long, words: int>>, text: string>>, nodes array<struct<path: long, value: long>>"
    rows = map_slices(pages.select("page_id", "url", "html"), "html", emit, schema, 4 << 20)
    return rows.withColumn("row", F.monotonically_increasing_id())


def _importances(counts: DataFrame, held: DataFrame, by: list[str]) -> DataFrame:
    """by, path, pages, words (of its different texts), content, presentation and importance from (by, path, kind, value, words, c) rows and the pages of each path."""
    text, shape = F.col("kind") == 0, F.col("kind") == 1
    c, log = F.col("c"), F.log("c")
    sums = counts.groupBy(*by, "path").agg(
        F.avg(F.when(text, log)).alias("_log"), F.sum(F.when(text, F.col("words"))).alias("words"), F.sum(F.when(shape, c)).alias("_n"), F.sum(F.when(shape, c * log)).alias("_spread"), F.count(F.when(shape, 1)).alias("_l")
    )
    share = lambda x: F.least(F.lit(1.0), F.greatest(F.lit(0.0), x))
    content = F.when(F.col("pages") > 1, share(1 - F.col("_log") / F.log("pages"))).otherwise(1.0)
    presentation = F.when((F.col("pages") > 1) & (F.col("_n") > 0), share((F.log("_n") - F.col("_spread") / F.col("_n")) / F.log("pages"))).otherwise(0.0)
    kept = F.pow(F.lit(0.9), F.col("_l"))
    both = (1 - kept) * F.col("presentation") + kept * F.col("content")
    found = held.join(sums, [*by, "path"]).withColumns({"content": content, "presentation": presentation})
    return found.select(*by, "path", "pages", "words", "content", "presentation", F.greatest("content", both).alias("importance"))


def _marked(blocks: DataFrame, by: list[str], name: str) -> DataFrame:
    """blocks with a flag: of the rows that agree in `by`, the one with the smallest row number has it."""
    rows = blocks.withColumn("_key", F.xxhash64(*by))
    again = rows.groupBy("_key").agg(F.min("row").alias("_first"), F.count("*").alias("n")).where("n > 1")
    again = written(again, "copied-pages")
    joined = rows.join(F.broadcast(again.drop("n")), "_key", "left") if small_enough(again) else join_skewed(rows, again, "_key", "n", "left")
    return joined.withColumn(name, F.coalesce(F.col("row") == F.col("_first"), F.lit(True)).cast("int")).drop("_key", "_first")


def style_tree(blocks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The importances of the paths of each host, and of those of all hosts, both written. blocks is a written table."""
    marked = _marked(_marked(blocks.select("host", "page", "row", "blocks", "nodes"), ["host", "page"], "own"), ["page"], "first").where("own = 1")
    paths = F.array_distinct(F.transform("blocks", lambda b: b["path"]))
    held = marked.select("host", "first", F.explode(paths).alias("path")).groupBy("host", "path").agg(F.count("*").alias("pages"), F.sum("first").alias("firsts"))
    held = written(held, "held")
    texts = F.array_distinct(F.flatten(F.transform("blocks", lambda b: F.transform(b["parts"], lambda p: F.struct(b["path"].alias("path"), F.lit(0).alias("kind"), p["value"].alias("value"), p["words"].alias("words"))))))
    shapes = F.transform("nodes", lambda n: F.struct(n["path"].alias("path"), F.lit(1).alias("kind"), n["value"].alias("value"), F.lit(0).alias("words")))
    nodes = marked.select("host", "first", F.explode(F.concat(texts, shapes)).alias("e")).select("host", "first", "e.*")
    counts = written(nodes.groupBy("host", "path", "kind", "value").agg(F.count("*").cast("int").alias("c"), F.sum("first").cast("int").alias("firsts"), F.max("words").alias("words")), "counts")
    tree = written(_importances(counts.drop("firsts"), held.drop("firsts"), ["host"]), "host-tree")
    every = counts.where("firsts > 0").groupBy("path", "kind", "value").agg(F.sum("firsts").alias("c"), F.max("words").alias("words"))
    whole = written(_importances(every, held.where("firsts > 0").groupBy("path").agg(F.sum("firsts").alias("pages")), []), "whole-tree")
    discard(counts)
    discard(held)
    return tree, whole


def weighed(importance: Column, pages: Column) -> Column:
    """An importance by its evidence: 1 on one page, nearer to what was found the more pages there are."""
    return 1 - (1 - 1 / pages) * (1 - importance)


def low_paths(tree: DataFrame, whole: DataFrame) -> DataFrame:
    """host, path and inside (whether it goes within articles, too) of the branches to remove: under LOW or INSIDE of the importance of the path with the most text, on their host or on all hosts."""
    main = F.max_by("weight", F.struct("words", "path")).alias("main")
    tree, whole = (t.withColumn("weight", weighed(F.col("importance"), F.col("pages"))) for t in (tree, whole))
    low = lambda main: (F.col("weight") < LOW * main, (F.col("weight") < INSIDE * main).alias("inside"))
    under, inside = low(F.col("main"))
    own = tree.join(tree.groupBy("host").agg(main), "host").where(under).select("host", "path", inside)
    under, inside = low(F.lit(whole.agg(main).first()["main"] or 0.0))
    everywhere = written(whole.where(under).select("path", inside), "low-everywhere")
    found = tree.select("host", "path").join(F.broadcast(everywhere) if small_enough(everywhere) else everywhere, "path").select("host", "path", "inside")
    return own.unionByName(found).groupBy("host", "path").agg(F.max("inside").alias("inside"))


def main_text(blocks: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars from blocks with the removed paths of their host in `low`, those of them that go inside articles in `inside`."""
    paths = F.transform("blocks", lambda b: b["path"])
    own = blocks.withColumns({c: F.coalesce(F.array_intersect(paths, F.col(c)), F.array().cast("array<long>")) for c in ("low", "inside")})  # the page's few of the host's many
    framed = F.exists("blocks", lambda b: b["article"] & (b["dropped"] == READ))
    rare = lambda b: F.when(b["article"], b["named"] & F.array_contains("inside", b["path"])).otherwise(F.array_contains("low", b["path"]))
    kept = F.filter("blocks", lambda b: (b["dropped"] == READ) & (b["article"] | ~framed) & ~rare(b))
    out = own.select("page_id", "url", F.array_join(F.transform(kept, lambda b: b["text"]), "\n\n").alias("text"))
    return out.withColumn("n_chars", F.length("text").cast("long"))


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars of every page."""
    blocks = written(page_blocks(pages), "blocks")
    low = written(low_paths(*style_tree(blocks)), "low-paths")
    lists = low.groupBy("host").agg(F.collect_list("path").alias("low"), F.collect_list(F.when(F.col("inside"), F.col("path"))).alias("inside"))  # as long as the paths of one host
    if small_enough(low):  # 8 bytes each, beside a host name a list
        joined = blocks.join(F.broadcast(lists), "host", "left")
    else:
        lists = written(lists.join(blocks.groupBy("host").agg(F.count("*").alias("n")), "host"), "low-lists")
        joined = join_skewed(blocks, lists, "host", "n", "left")
    return main_text(joined)
