"""HTML extraction (2): consensus host paths.

1. Each page is read into a tree (end tags that are left out are supplied), in time and memory proportional to its
   length. Subtrees that are no article by tag, role or class words (menus, headers, footers, sidebars, notices, adverts,
   forms, comments, ...) are left out; the header of an article or main element is part of it. Containers
   are scored by the characters of their blocks less their links' share; the page votes for the generalised
   tag-class path of its best container: an article or main part, else the outermost of which all is article text.
   A part gets the vote instead only where what it leaves out is link text, or div parts that hold nothing but labels.
2. Spark adds up the votes per host and path; a path with SHARE of its host's votes wins.
3. Each page is read again by its own path if that is a winning one, else by the winning path with the most votes that
   it has. A page that has none of them uses its own best container, and so does one in which the path's containers
   are the lesser part of that container.

Votes are added per partition before they are shuffled. The winning paths are as many as hosts: they are broadcast
while their count stays within a bound, else pages and paths are joined by a shuffle, which splits hot hosts.

Cases: null html counts as empty and gives the empty text; a null url has no host and so no consensus; repeated rows
each give a row; broken markup is read as far as it goes (a quote that is never closed ends at the next ">"; a tag without its end
drops the rest of the page); pages may be of any length and depth; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import html as html_
import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from rowloom.llm.common import small, stored, table
from rowloom.llm.textnp import slices

SHARE = 0.1
#: Pages that are Python strings at once.
ROWS = 64
#: Characters of a block that can be a label; one with the end of a sentence is none.
LABEL = 30

#: Elements whose whole content is no markup, or no text of the page.
RAW = frozenset("script style noscript template iframe svg math textarea select title object canvas video audio".split())
_RAW_ENDS = {tag: re.compile(rf"</{tag}\s*>", re.I) for tag in RAW}
_LETTER, _NAME, _UNQUOTED = re.compile(r"[a-zA-Z]"), re.compile(r"[a-zA-Z][^\s/>]*"), re.compile(r"[^>\"']*")
_ATTR = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_HIDDEN = re.compile(r"""(?:^|\s)hidden(?=[\s=/]|$)|aria-hidden\s*=\s*["']?true|display\s*:\s*none""", re.I)
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_SENTENCE = re.compile(r"[.!?…。！？]")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul caption".split())
#: What a start tag closes if it is open, up to the nearest of the second set.
_P_CLOSERS = BLOCKS - {"body", "html", "li", "dd", "dt", "td", "th", "tr", "tbody", "thead", "tfoot", "caption", "option", "legend", "summary"}
_CLOSES = {"li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, set()), "tbody": ({"thead", "tbody", "tr", "td", "th"}, {"table"}), "tfoot": ({"tbody", "tr", "td", "th"}, {"table"})}
_SCOPE = frozenset("table td th article section div main aside body li blockquote figure".split())
NO_ARTICLE = frozenset("nav header footer aside form menu button dialog head label input fieldset".split())
NO_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar toolbar".split())
#: Class and id words of what is no article.
NO_WORDS = frozenset("menu menus nav navbar navigation breadcrumb breadcrumbs header masthead topbar footer foot sidebar side aside rail notice notices cookie cookies consent gdpr banner alert popup modal overlay ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion comment comments reply replies respond discussion disqus share sharing social related recommended newsletter subscribe subscription signup login search widget widgets toolbar pagination pager copyright legal disclaimer skip".split())
_KEEPS = frozenset("with has no without".split())
#: The same for what stands in an article, whose header is its own.
NO_TAGS_INSIDE, NO_WORDS_INSIDE = NO_ARTICLE - {"header"}, NO_WORDS - {"header"}
CONTAINERS = frozenset("body article main section div td center blockquote figure details".split())
#: Containers that lay out a page, and those of them that may hold labels only; the others belong to the text around them.
LAYOUT, DIVS = frozenset("body article main section div td center".split()), frozenset("section div center".split())
HEADINGS, OUTER = frozenset("h1 h2 h3 h4 h5 h6".split()), frozenset(("article", "main"))
#: Kinds of blocks, and of tokens.
TEXT, HEADING, LINK = 0, 1, 2
CHARS, LITERAL, START, END = 0, 1, 2, 3


class Node:
    """An open or closed element. path: number of its generalised path; box: the nearest container around it."""

    __slots__ = ("tag", "path", "off", "link", "score", "parts", "box", "first", "last")

    def __init__(self, tag: str, path: int, off: bool, link: bool, box: Node | None):
        self.tag, self.path, self.off, self.link, self.box = tag, path, off, link, box
        self.score, self.parts, self.first, self.last = 0.0, [], -1, -1


class Paths:
    """The generalised paths of a page, by number: each is its parent's number and a label. Path 0 is the page. Only
    paths that are asked for become strings."""

    def __init__(self) -> None:
        self.number: dict[tuple[int, str], int] = {}
        self.steps: list[tuple[int, str]] = [(-1, "")]
        self.size = [-1]

    def below(self, parent: int, label: str) -> int:
        found = self.number.get((parent, label))
        if found is None:
            found = self.number[parent, label] = len(self.steps)
            self.steps.append((parent, label))
            self.size.append(self.size[parent] + 1 + len(label))
        return found

    def text(self, path: int) -> str:
        labels = []
        while path > 0:
            path, label = self.steps[path]
            labels.append(label)
        return ">".join(reversed(labels))

    def find(self, text: str) -> int:
        """The number of a path, -1 if the page has none like it."""
        for path, size in enumerate(self.size):
            if size == len(text) and path and text.endswith(self.steps[path][1]) and self.text(path) == text:
                return path
        return -1


@dataclass
class Page:
    """containers (the first is the page itself) and blocks, each (kind, text); those of no article are left out. A container's
    blocks are those from first to last."""

    containers: list[Node]
    blocks: list[tuple[int, str]]
    paths: Paths


def tokens(page: str) -> Iterator[tuple[int, str, str]]:
    """What a page is made of: (CHARS, text, ""), (LITERAL, text, "") of CDATA, (START, tag, attributes) and (END, tag, ""). Comments,
    declarations and raw elements are left out. Each character is looked at a bounded number of times: a quote that is never closed ends
    at the next ">", and what opens a tag, a comment or a raw element that never ends is the end of the page's text."""
    at, size, quoted = 0, len(page), True
    last = {q: page.rfind(q) for q in "\"'"}
    while at < size:
        k = page.find("<", at)
        if k < 0:
            yield CHARS, page[at:], ""
            return
        two = page[k + 1 : k + 2]
        if two not in ("!", "?") and not _LETTER.match(page, k + 1 + (two == "/")):
            yield CHARS, page[at : k + 1], ""
            at = k + 1
            continue
        if k > at:
            yield CHARS, page[at:k], ""
        if page.startswith("<!--", k):
            end = page.find("-->", k + 4)
            at = end + 3 if end >= 0 else size
        elif page.startswith("<![CDATA[", k):
            end = page.find("]]>", k + 9)
            yield LITERAL, page[k + 9 : end if end >= 0 else size], ""
            at = end + 3 if end >= 0 else size
        elif two in "!?":
            end = page.find(">", k)
            at = end + 1 if end >= 0 else size
        else:
            name = _NAME.match(page, k + 1 + (two == "/"))
            end = name.end()
            while quoted and (end := _UNQUOTED.match(page, end).end()) < size and page[end] != ">":
                before = end - 1
                while page[before] in " \t\n\f\r":
                    before -= 1
                if page[before] != "=":  # no value begins here
                    end += 1
                    continue
                if end >= last[page[end]]:
                    end = page.find(">", end)  # a quote without its other half
                    break
                end = page.find(page[end], end + 1) + 1
            if end >= size:  # quotes that pair up to the page's end: from here on they are characters like others
                quoted = False
            if not quoted:
                end = page.find(">", name.end())
            if end < 0:
                return
            tag, attrs, at = name[0].lower(), page[name.end() : end], end + 1
            if two == "/":
                yield END, tag, ""
            elif tag not in RAW:
                yield START, tag, attrs
            elif not attrs.endswith("/"):
                found = _RAW_ENDS[tag].search(page, at)
                at = found.end() if found else size


def _label(tag: str, attrs: str, inside: bool = False) -> tuple[str, bool]:
    """(tag and classes with numbers left out, whether it is no article). inside: within an article or main element, whose header is
    part of it."""
    off, classes = tag in (NO_TAGS_INSIDE if inside else NO_ARTICLE), ""
    if attrs and ("=" in attrs or "idden" in attrs):
        if tag not in ("body", "html", "article", "main") and _HIDDEN.search(attrs):
            off = True
        for name, a, b, c in _ATTR.findall(attrs):
            value, name = a or b or c, name.lower()
            if name == "role":
                off = off or value.lower() in NO_ROLES
                continue
            if name == "class":
                classes = ".".join(sorted(re.sub(r"\d+", "#", x) for x in value.lower().split()))
            if tag not in ("body", "html", "article", "main"):
                for one in value.split():
                    words = {w.lower() for w in _WORD.findall(one)}
                    if words & (NO_WORDS_INSIDE if inside else NO_WORDS) and not words & _KEEPS:
                        off = True
    return (f"{tag}.{classes}" if classes else tag), off


class _Reader:
    """Builds a Page from its tokens. The open elements are a stack; where each tag, block and scope stands in it is kept, so no
    step walks up the stack, and an element's score and blocks are added to its parent when it ends."""

    def __init__(self) -> None:
        self.paths = Paths()
        self.root = Node("html", 0, False, False, None)
        self.root.box = self.root
        self.stack, self.containers, self.blocks = [self.root], [self.root], []
        self.places: dict[str, list[int]] = defaultdict(list)
        self.block_places, self.scope_places = [], []
        self.headings = self.articles = 0
        self.run: list[str] = []
        self.chars = self.links = 0
        self.plain = False

    def flush(self) -> None:
        """Ends a block."""
        if self.run:
            text = " ".join("".join(self.run).split())
            if text:
                kind = HEADING if self.headings else TEXT if self.plain or not self.links else LINK
                top = self.stack[-1]
                top.score += len(text) * (1 - min(1.0, self.links / max(1, self.chars)))
                top.first = len(self.blocks) if top.first < 0 else top.first
                top.last = len(self.blocks) + 1
                self.blocks.append((kind, text))
            self.run.clear()
        self.chars = self.links = 0
        self.plain = False

    def add(self, text: str) -> None:
        top = self.stack[-1]
        if text and not top.off:
            if "&" in text:
                text = html_.unescape(text)
            self.run.append(text)
            n = len(text.strip())
            self.chars += n
            if top.link:
                self.links += n
            elif not self.plain:
                self.plain = any(c.isalnum() for c in text)

    def push(self, node: Node) -> None:
        k, tag = len(self.stack), node.tag
        self.stack.append(node)
        self.places[tag].append(k)
        if tag in BLOCKS:
            self.block_places.append(k)
        if tag in _SCOPE:
            self.scope_places.append(k)
        self.headings += tag in HEADINGS
        self.articles += tag in OUTER

    def pop_to(self, size: int) -> None:
        while len(self.stack) > size:
            node = self.stack[-1]
            tag = node.tag
            if tag in BLOCKS:
                self.flush()
                self.block_places.pop()
            if tag in _SCOPE:
                self.scope_places.pop()
            self.headings -= tag in HEADINGS
            self.articles -= tag in OUTER
            self.places[tag].pop()
            self.stack.pop()
            if node.first >= 0:
                up = self.stack[-1]
                up.score += node.score
                up.first = node.first if up.first < 0 else up.first
                up.last = node.last

    def place(self, tags) -> int:
        """Where the innermost open element of these tags stands, 0 if none is open."""
        return max((self.places[t][-1] for t in tags if self.places.get(t)), default=0)

    def end(self, tag: str) -> None:
        if tag == "br":
            self.run.append(" ")
            return
        k = self.place((tag,))
        if not k:
            if tag in BLOCKS:
                self.flush()
        elif tag in _SCOPE or tag in BLOCKS or not self.scope_places or self.scope_places[-1] <= k:
            self.pop_to(k)

    def start(self, tag: str, attrs: str) -> None:
        if tag in VOID:
            if tag == "hr":
                self.flush()
            else:
                self.run.append(" ")
            return
        if tag == "html":
            return
        if tag in _P_CLOSERS:
            if self.block_places and self.stack[self.block_places[-1]].tag == "p":
                self.pop_to(self.block_places[-1])
        elif tag in _CLOSES:
            shut, up_to = map(self.place, _CLOSES[tag])
            if shut > up_to:
                self.pop_to(shut)
        if tag == "body" or (tag in BLOCKS and self.stack[-1].tag == "head"):
            while self.stack[-1].tag == "head":
                self.pop_to(len(self.stack) - 1)
            if tag == "body" and self.places.get("body"):
                return
        top = self.stack[-1]
        if tag in BLOCKS:
            self.flush()
            label, off = _label(tag, attrs, self.articles > 0)
            node = Node(tag, self.paths.below(top.path, label), top.off or off, top.link, top.box)
            if tag in CONTAINERS and not node.off:
                self.containers.append(node)
                top.box.parts.append(node)
                node.box = node
        elif attrs.endswith("/"):
            return
        else:
            node = Node(tag, top.path, top.off or _label(tag, attrs, self.articles > 0)[1], top.link or tag == "a", top.box)
        self.push(node)


def read(page: str) -> Page:
    reader = _Reader()
    for kind, text, attrs in tokens(page):
        if kind == START:
            reader.start(text, attrs)
        elif kind == END:
            reader.end(text)
        else:
            reader.add(text)
    reader.pop_to(1)
    reader.flush()
    return Page(reader.containers, reader.blocks, reader.paths)


def _all_in(now: Node, part: Node, blocks: list[tuple[int, str]]) -> bool:
    """Whether a part has all article text of a container. What stands in the container itself may only be link text; another
    part may be link text too, under headings or not, and a div part may also have labels. Only what lies outside the part is read."""
    if part.tag not in LAYOUT:
        return False
    at = now.first
    for one in [x for x in now.parts if x.first >= 0]:  # in page order
        if any(blocks[k][0] != LINK for k in range(at, one.first)):
            return False
        at = one.last
        if one is not part:
            own = blocks[one.first : one.last]
            linked, labels = any(kind == LINK for kind, _ in own), one.tag in DIVS
            for kind, text in own:
                if kind == HEADING and not linked or kind == TEXT and not (labels and len(text) <= LABEL and not _SENTENCE.search(text)):
                    return False
    return all(blocks[k][0] == LINK for k in range(at, now.last))


def best(page: Page) -> Node | None:
    """The container that the page votes for: the article or main part with most text if it has half of all, else from
    the top down while one part has all article text."""
    containers, blocks = page.containers, page.blocks
    root = containers[0]
    if root.score <= 0:
        return None
    for tag in ("article", "main"):
        named = [c for c in containers if c.tag == tag]
        # Of nested ones the outer, of which all that the inner have is part.
        if named and (top := max(named, key=lambda c: c.score)).score >= 0.5 * root.score / (1 if len(named) == 1 else len(named)):
            return top
    now = next((c for c in containers if c.tag == "body"), root)
    if now.score < 0.5 * root.score:
        now = root
    while now.parts and (part := max(now.parts, key=lambda c: c.score)).score > 0 and _all_in(now, part, blocks):
        now = part
    return now


def taken(page: Page, path: int) -> str:
    """Blocks of all containers with this path, in page order. Containers of one path don't hold each other."""
    return "\n\n".join(text for c in page.containers if c.path == path and c.first >= 0 for _, text in page.blocks[c.first : c.last])


def vote(html: str) -> tuple[str, float] | None:
    page = read(html)
    top = best(page)
    return None if top is None else (page.paths.text(top.path), top.score)


def extract(html: str, paths: list[str] | None) -> str:
    """Text of a page by its own path if it is one of the paths, else by the first of them that it has, else by its own best
    container; by that also where the path's containers are less than half of it. A page that has such a container but
    nothing in it has no text."""
    page = read(html)
    if not page.blocks:
        return ""
    wanted = [k for k in map(page.paths.find, paths or ()) if k > 0]
    parts: dict[int, list[Node]] = {k: [] for k in wanted}
    empty = False
    for c in page.containers:
        if c.path in parts:
            empty = True
            if c.first >= 0:
                parts[c.path].append(c)
    top = best(page)
    own = top.path if top is not None else 0
    for path in [own] if parts.get(own) else wanted:
        if found := parts[path]:
            inner = top is not None and all(top.first <= c.first and c.last <= top.last for c in found)
            if inner and own and sum(c.score for c in found) < 0.5 * top.score:
                path = own
            return taken(page, path)
    if empty:
        return ""
    return taken(page, own) if own else "\n\n".join(t for _, t in page.blocks)


def host(url: Column) -> Column:
    """The host of a URL without www., lower case; null if there is none."""
    return F.nullif(F.regexp_extract(F.lower(url), r"^[a-z][a-z0-9+.\-]*://(?:[^/@]*@)?(?:www\.)?([^/:?#]+)", 1), F.lit(""))


def votes(pages: DataFrame) -> DataFrame:
    """host, path, n, score: the pages of each host that vote for each path."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: dict[tuple[str, str], list[float]] = {}
            for part in slices([batch], ROWS):
                for h, page in zip(part.column("host").to_pylist(), part.column("html").to_pylist()):
                    if page and (v := vote(page)) is not None:
                        one = found.setdefault((h, v[0]), [0, 0.0])
                        one[0] += 1
                        one[1] += v[1]
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in found], pa.string()), pa.array([k[1] for k in found], pa.string()), pa.array([int(v[0]) for v in found.values()], pa.int64()), pa.array([float(v[1]) for v in found.values()], pa.float64())], names=["host", "path", "n", "score"])

    rows = pages.select(host(F.col("url")).alias("host"), "html").where(F.col("host").isNotNull())
    return rows.mapInArrow(run, "host string, path string, n long, score double").groupBy("host", "path").agg(F.sum("n").alias("n"), F.sum("score").alias("score"))


def winners(voted: DataFrame, share: float = SHARE) -> DataFrame:
    """host, paths: the winning paths, most votes first. At most 1/share per host."""
    all_ = F.sum("n").over(Window.partitionBy("host"))
    kept = voted.withColumn("all", all_).where((F.col("n") >= share * F.col("all")) & (F.col("path") != ""))
    return kept.groupBy("host").agg(F.transform(F.sort_array(F.collect_list(F.struct(-F.col("n"), "path"))), lambda x: x["path"]).alias("paths"))


def extracted(pages: DataFrame, share: float = SHARE) -> DataFrame:
    """page_id, url, text: one row per page."""
    won, _ = small(stored(winners(votes(pages), share), "host-paths"))
    rows = pages.select("page_id", "url", "html", host(F.col("url")).alias("host")).join(won, "host", "left").select("page_id", "url", "html", "paths")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, ROWS):
            texts = [extract(page, paths) if page else "" for page, paths in zip(batch.column("html").to_pylist(), batch.column("paths").to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string())], names=["page_id", "url", "text"])

    return rows.mapInArrow(run, rows.select("page_id", "url").schema.add("text", "string"))


def op2_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = extracted(table(spark, sf_dir, "pages").select("page_id", F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html")))
    return out.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
