"""Main text of web pages (op3) by consensus over the pages of a host.

Each page is parsed once into its containers. A container's path is the chain of tags and classes above it, generalised:
digits are taken out, classes sorted. Its score is the text in its own blocks, less what stands in links; text under an
element whose name or class speaks of a notice, a form or the like counts a quarter. Pages vote with their best container's
path, votes are added up per host in Spark, and every page of the host is read again along the winning path. A page
that doesn't have the path, or has nothing there, keeps its own best container.

Names and classes never decide alone: what is above the winning container doesn't matter, and an element inside it is left out
for its class only if it holds at most three quarters of the container's text and no article or main element.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from nearfield.llm.cluster import durable, ship

#: A comment, a declaration, a tag, or a tag with a quote that is never closed, which ends at the next >
TAG = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^<>\"']|\"[^\"]*\"|'[^']*')*)(?:/?>|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)([^<>]*)(?:>|(?=<)|\Z)", re.S
)
ATTRIBUTE = re.compile(r"""([a-zA-Z-]+)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""")

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe xmp noembed svg math object".split())
#: Elements whose text is never main text
SILENT = RAW | frozenset("head button select option label canvas audio video map".split())
#: Elements beside the main text, unless an article or main element begins in them; a header inside an article is part of it
ASIDE = frozenset("nav header footer aside menu dialog".split())
#: Parts of class and id names, and roles, of blocks that are probably beside the main text
NOISE = re.compile(
    r"(?:^|[\s_-])(?:ads?|adverts?|advertisement|sponsor(?:ed)?|promo(?:tion)?|banner|cookies?|consent|gdpr|notice|alert|popup|modal|overlay|newsletter|subscribe|signup|"
    r"nav|navbar|navigation|menu|breadcrumbs?|sidebar|widgets?|footer|header|masthead|toolbar|share|sharing|social|related|recommended|comments?|comment-list|disqus|replies|reply|"
    r"contentinfo|complementary|search|pagination|pager|login)(?:$|[\s_-])",
    re.I,
)
BLOCKS = frozenset("address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul caption".split())
CONTAINERS = frozenset("article body div main section td blockquote center".split())
#: A path down to its last article, or else its last main element
WHOLE = re.compile(r"(.*/article(?:\.[^/]*)?|(?!.*/article(?:[./]|$)).*/main(?:\.[^/]*)?)(?:/|$)")
#: An element of the first kind, when it begins, ends an open one of the second
ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
CLOSES_P = BLOCKS - {"html", "body", "td", "th", "tr", "tbody", "thead", "tfoot", "caption", "summary", "figcaption"}
LIGHT = 4


class Node:
    """A container, which has a path, or an element that may be beside the main text: aside by its name, doubtful by its class."""

    __slots__ = ("path", "parent", "aside", "doubtful", "holds_main", "size")

    def __init__(self, path: str | None, parent: Node | None, aside: bool = False, doubtful: bool = False):
        self.path, self.parent, self.aside, self.doubtful = path, parent, aside, doubtful
        self.holds_main, self.size = False, 0

    def above(self) -> Iterator[Node]:
        node: Node | None = self
        while node:
            yield node
            node = node.parent


class Page:
    """The nodes of a page in the order of their tags, and its blocks of text: (node, text, characters not in links)."""

    def __init__(self, source: str):
        self.nodes = [Node("", None)]
        self.blocks: list[tuple[Node, str, int]] = []
        self._parse(source)
        for node, _, plain in self.blocks:
            node.size += plain
        for node in reversed(self.nodes[1:]):
            node.parent.size += node.size

    def _parse(self, source: str) -> None:
        open_: list[tuple[str, Node | None]] = []  # name, and the node that it is
        inside, run, linked, links, silent = self.nodes[0], [], 0, 0, 0
        at, end = 0, len(source)

        def flush() -> None:
            nonlocal run, linked
            if run:
                text = " ".join(html.unescape("".join(run)).split())
                if text:
                    self.blocks.append((inside, text, max(len(text) - linked, 0)))
                run, linked = [], 0

        def pop(upto: int) -> None:
            nonlocal inside, links, silent
            for name, node in reversed(open_[upto:]):
                if name in BLOCKS:
                    flush()
                if node:
                    inside = node.parent or self.nodes[0]
                links -= name == "a"
                silent -= name in SILENT
            del open_[upto:]

        def close(names: frozenset | set, fence: frozenset | set) -> None:
            """Ends the innermost open element of these names, if it is inside the fence."""
            for k in range(len(open_) - 1, -1, -1):
                if open_[k][0] in names:
                    pop(k)
                    return
                if open_[k][0] in fence:
                    return

        while at < end:
            m = TAG.search(source, at)
            stop = m.start() if m else end
            if stop > at and not silent:
                run.append(source[at:stop])
                linked += (stop - at) * (links > 0)
            if not m:
                break
            at, name = m.end(), (m[2] or m[5] or "").lower()
            marks = m[3] or m[6]
            if not name:
                continue
            if m[1] or m[4]:
                close({name}, frozenset() if name in BLOCKS or name in SILENT else BLOCKS)  # </b> doesn't end the paragraph around it
                continue
            if name in VOID:
                if name == "br" and not silent:
                    run.append(" ")
                elif name == "hr":
                    flush()
                continue
            if name in RAW:
                at = _behind(source, name, at)
                continue
            if name in ("article", "main", "body") and silent:  # something before was never closed
                pop(next(k for k, (x, _) in enumerate(open_) if x in SILENT))
            if name in CLOSES_P:
                close({"p"}, BLOCKS)
            if name in ENDS:
                close(ENDS[name], {"ul", "ol", "dl", "table", "select"})
            node = None
            if name in BLOCKS:
                flush()
                values = [(k.lower(), v.strip("\"'")) for k, v in ATTRIBUTE.findall(marks)] if marks else []
                doubtful = name in ("form", "fieldset") or name not in ("html", "body", "article", "main") and any(NOISE.search(v) for k, v in values if k in ("class", "id", "role"))
                aside = name in ASIDE and not (name == "header" and any(x.path and WHOLE.match(x.path) for x in inside.above()))
                if name in CONTAINERS or doubtful or aside:
                    path = None
                    if name in CONTAINERS:
                        classes = sorted({re.sub(r"\d+", "", c) for k, v in values if k == "class" for c in v.split()} - {""})
                        path = f"{next(x.path for x in inside.above() if x.path is not None)}/{'.'.join([name, *classes])}"
                    node = Node(path, inside, aside, doubtful)
                    self.nodes.append(node)
                    if name in ("article", "main"):
                        for x in inside.above():
                            x.holds_main = True
                    inside = node
            links += name == "a"
            silent += name in SILENT
            open_.append((name, node))
        pop(0)
        flush()

    def best_path(self) -> tuple[str, int]:
        """The path of the containers with the highest score, and the score; the first of equals. Inside an article, or else a
        main element, it is that element that scores."""
        scores: dict[str, int] = {x.path: 0 for x in self.nodes if x.path is not None and not WHOLE.match(x.path)}
        for node, text, plain in self.blocks:
            beside = [x for x in node.above() if not x.holds_main]
            if any(x.aside for x in beside):
                continue
            path = next(x.path for x in node.above() if x.path is not None)
            whole = WHOLE.match(path)
            value = LIGHT * (len(text) - 2 * (len(text) - plain))
            path = whole[1] if whole else path
            scores[path] = scores.get(path, 0) + (value // LIGHT if any(x.doubtful for x in beside) else value)
        path = max(scores, key=lambda p: scores[p])
        return path, max(scores[path], 0)

    def at(self, path: str) -> list[str]:
        """The blocks in the outermost containers with this path, without those beside the main text."""
        out = []
        for node, text, _ in self.blocks:
            chain = list(node.above())
            k = max((k for k, x in enumerate(chain) if x.path == path), default=None)
            if k is not None and not any(not x.holds_main and (x.aside or x.doubtful and 4 * x.size <= 3 * chain[k].size) for x in chain[:k]):
                out.append(text)
        return out

    def text(self, path: str | None) -> str:
        """The blocks along the path, or else of the page's own best container, joined by line ends."""
        return "\n".join((self.at(path) if path is not None else []) or self.at(self.best_path()[0]))


def extract(source: str, path: str | None) -> str:
    return Page(source).text(path)


def _behind(page: str, name: str, at: int) -> int:
    """Where the element of raw text that has just begun ends."""
    m = re.compile(rf"</{re.escape(name)}(?=[\s/>])[^>]*(?:>|\Z)", re.I).search(page, at)
    return m.end() if m else len(page)


def _votes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        added: dict[tuple[str, str], list[int]] = {}
        for host, page in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            path, score = Page(page).best_path()
            if score:
                mine = added.setdefault((host, path), [0, 0])
                mine[0] += 1
                mine[1] += score
        yield pa.record_batch([pa.array([k[0] for k in added], pa.string()), pa.array([k[1] for k in added], pa.string()), pa.array([v[0] for v in added.values()], pa.int64()), pa.array([v[1] for v in added.values()], pa.int64())], ["host", "path", "pages", "score"])


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [extract(page, path) if page else "" for page, path in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)]
        yield pa.record_batch([batch.column(0), batch.column(1), pa.array(texts, pa.string())], ["page_id", "url", "text"])


def host_paths(pages: DataFrame) -> DataFrame:
    """(host, path): the path with most votes of each host; of equals the one with more text, then the first."""
    with_host = pages.select(host(), "html").where("host is not null and html is not null and html <> ''")
    votes = with_host.mapInArrow(_votes, "host string, path string, pages long, score long").groupBy("host", "path").agg(F.sum("pages").alias("pages"), F.sum("score").alias("score"))
    ranked = votes.withColumn("k", F.row_number().over(W.partitionBy("host").orderBy(F.desc("pages"), F.desc("score"), "path")))
    return ranked.where("k = 1").select("host", "path")


def host() -> Column:
    """The host of the url, in lower case; null where it names none."""
    return F.expr("nullif(lower(regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)', 1)), '')").alias("host")


def extract_pages(pages: DataFrame, broadcast_hosts: int = 200_000) -> DataFrame:
    """page_id, url, text: the main text of every page.

    Left out are menus, headers, footers, sidebars, notices, adverts, forms, scripts, styles, markup and comments, by
    the rules at the top of this module; all else in the winning container stays, however long. Time grows with the page's length times its depth.
    Character references are decoded, white space inside a block becomes one space, ends are trimmed, and blocks are
    joined by one line end. A null or empty html gives an empty text. Of paths with equally many votes the one with more text wins, then the first. A page whose url names no host is judged alone.
    Broken markup is read as far as it goes. Repeated rows are read one by one and vote each. Extra columns are not read.

    The winning paths are sent to every executor while there are at most broadcast_hosts of them, and joined by shuffle beyond.
    """
    ship(pages.sparkSession)
    winners = durable(host_paths(pages))
    winners = F.broadcast(winners) if winners.count() <= broadcast_hosts else winners
    texts = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html", host())
    return texts.join(winners, "host", "left").select("page_id", "url", "html", "path").mapInArrow(_texts, "page_id long, url string, text string")


def op3_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = extract_pages(spark.read.parquet(f"{sf_dir}/pages.parquet"))
    return out.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
