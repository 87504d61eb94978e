"""HTML extraction by templates deduced from the pages of a host.

Tokens are the elements of a page, told apart by their path of tags and classes, and its text blocks, of any length,
told apart by their element and text. Over the different pages of one host each token has an occurrence vector: how
often it stands in each page. Tokens with equal vectors form an equivalence class. A class is valid if it stands in
enough of the pages and its elements nest: each sits in an element of the template. Valid classes nest into the
host's template, each in the slot of the class around it. A text block belongs to the template if its class also holds
an element around it, so that on every page it comes exactly as often as that element; all other text fills slots and
is what pages are extracted to. Slots that hold mostly links are menus.

Vectors are never gathered: a token's vector is kept as a sum of hashes of (page, count), so that equal vectors have
equal sums. Pages of one title and main heading are copies of an article and count once, as do, where there is no
heading, pages that are alike in all tokens. A host of any size is a few rows to shuffle.

What is left out besides the template: elements that are no article text by tag, role or name (menus, headers, footers,
sidebars, notices, adverts, forms, scripts, styles, reader comments). A name never leaves out an element with an article
in it (unless it names comments), nor, on a page whose text is in no article, one with most of the page's text (names of
comments or related pages need a heading in it); in an article's own paragraphs only the names of adverts and comments
count. Where a page has article elements (or else main elements), its text is what they hold, all of them; an article
within another is a reader's comment. Where a template would leave a page no text at all, the page keeps its text.

Pages without a template (a single page, or pages that are all alike) follow the same rules on the page alone.

Defined results: null and empty html give empty text; an empty table gives an empty result; malformed html is read as
browsers do (unclosed paragraphs and inline elements end with their block, raw text of scripts and styles is skipped, an
open comment or tag runs to the end); html of any length and nesting is read whole, in time that grows with its length; repeated pages repeat their text; pages whose url is null
or names no host share no template; columns of the table besides id, url and html are not read.
"""

from __future__ import annotations

import bisect
import html as htmllib
import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarryline.llm._common import fits_broadcast, materialize
from quarryline.llm.url_filter import split_url

TAG = re.compile(r"<(/?)([A-Za-z][^\s/>]*+)")
#: What ends a tag, or begins a quoted value in which a > ends nothing.
TAG_STOP = re.compile(r">|=\s*+[\"']")
LABEL = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
RAW = {t: re.compile(rf"</{t}\s*>", re.I) for t in ("script", "style", "textarea", "title", "noscript", "template", "iframe", "svg")}
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
PARAGRAPH = frozenset("p h1 h2 h3 h4 h5 h6 li dt dd blockquote pre figure figcaption table thead tbody tr td th caption".split())
LEFT_OUT = frozenset("nav header footer aside form script style textarea title noscript template iframe svg head menu dialog button select option object canvas audio video map fieldset".split())
_NAMED = r"(?:\A|[\s_-])(?<!has-)(?<!no-)(?<!with-)(?<!without-)(?:{})(?:\Z|[\s_-])"
ADVERTS, COMMENTS = r"ads?|advert\w*|adsense|adslot|sponsor\w*", r"comments?|commentlist|replies|disqus|respond"
LEFT_OUT_NAMES = re.compile(
    _NAMED.format(
        rf"{ADVERTS}|promo\w*|banner|cookies?|consent|gdpr|notices?|notifications?|alert|popup|modal|overlay|newsletter|subscribe|signup|login|side-?bar|sidenav|menu\w*|nav|navbar|navigation"
        rf"|breadcrumbs?|pagination|pager|header|masthead|footer|{COMMENTS}|share|sharing|social|related|recommended|widget\w*|tag-?cloud|toolbar|skip-?link"
    ),
    re.I,
)
#: Names that leave out a paragraph of an article, and names that leave out an element even if it has an article in it.
LEFT_OUT_PARAGRAPHS = re.compile(_NAMED.format(f"{ADVERTS}|{COMMENTS}"), re.I)
LEFT_OUT_ARTICLES = re.compile(_NAMED.format(f"{COMMENTS}|related|recommended"), re.I)
LEFT_OUT_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar".split())
ARTICLE = frozenset(("article", "main"))
HEADINGS = frozenset(("h1", "h2"))
#: Tags that a tag ends, and tags below which it ends none.
ENDS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "td": ("td", "th"), "th": ("td", "th"), "tr": ("tr",), "option": ("option",)}
HOLDS = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "td": ("tr", "table"), "th": ("tr", "table"), "tr": ("table",)}
#: Share of a host's pages that a class stands in, share of a page's text with which a name alone leaves nothing out, share of links that makes a slot a menu.
MIN_SUPPORT = 0.5
NAMED_SHARE = 0.5
MENU_SHARE = 0.5


def _hash(*parts) -> int:
    return xxhash.xxh64_intdigest("\0".join(map(str, parts)).encode("utf-8", "surrogatepass")) - (1 << 63)


class _Open:
    """An open element: ``out`` for good, ``named`` (the last of the elements around that only their name leaves out), the articles it is in, and the place of the nearest block on the stack, itself included."""

    __slots__ = ("article", "block", "link", "main", "named", "out", "path", "tag")

    def __init__(self, tag: str, path: int, out: bool, named: int, article: int, main: bool, link: bool, block: int):
        self.tag, self.path, self.out, self.named, self.article, self.main, self.link, self.block = tag, path, out, named, article, main, link, block


class _Name:
    """An element that its name leaves out: the one around it, whether it may hold an article, whether it does, whether it has a heading, its characters, and whether it is kept after all."""

    __slots__ = ("around", "chars", "excused", "heading", "may", "seen")

    def __init__(self, around: int, may: bool):
        self.around, self.may, self.excused, self.seen, self.heading, self.chars = around, may, False, False, False, 0


class Page:
    """``elements``: (path, parent, tag) of those that are not left out; ``blocks``: (path of the element, level of articles, in main, characters of links, text) of theirs.

    One pass over the source; each step costs what it moves on by, whatever the nesting, so that time grows with length alone.
    """

    def __init__(self, source: str):
        self._elements: list[tuple[int, int, str, bool, int]] = []
        self._blocks: list[tuple[int, bool, int, int, bool, int, str]] = []
        self._stack = [_Open("", 0, False, -1, 0, False, False, 0)]
        self._places: dict[str, list[int]] = {}  # of each tag, where it is open on the stack
        self._names: list[_Name] = []
        self._around: dict[int, int] = {}  # path of each element: the path around it
        self._text: list[str] = []
        self._linked = 0
        self._headings: list[tuple[bool, int, str]] = []
        self.title = ""
        self._read(source)
        self._flush()
        self._weigh()
        self.elements = [(path, parent, tag) for path, parent, tag, out, named in self._elements if not out and self._kept(named)]
        self.blocks = [(path, article, main, linked, text) for path, out, named, article, main, linked, text in self._blocks if not out and self._kept(named)]
        self.heading = next((text for out, named, text in self._headings if not out and self._kept(named)), "")

    def _read(self, source: str) -> None:
        at = begin = 0  # what is from begin on is text
        while (at := source.find("<", at)) >= 0:
            if source.startswith("<!--", at):
                end = source.find("-->", at + 4)
            elif source.startswith(("<!", "<?"), at):
                end = source.find(">", at)
            elif m := TAG.match(source, at):
                end = _tag_end(source, m.end())
            else:
                at += 1
                continue
            self._add(source[begin:at])
            if end < 0:
                return
            if source.startswith(("<!", "<?"), at):
                at = begin = end + (3 if source.startswith("<!--", at) else 1)
                continue
            tag, attributes = m[2].lower(), source[m.end() : end]
            at = begin = end + 1
            if m[1]:
                self._close(tag)
                continue
            self._open(tag, attributes)
            if tag in RAW and not attributes.rstrip().endswith("/"):
                found = RAW[tag].search(source, at)
                if tag == "title" and not self.title:
                    self.title = " ".join(htmllib.unescape(source[at : found.start() if found else len(source)]).split())
                at = begin = found.end() if found else len(source)
                self._close(tag)
        self._add(source[begin:])

    def _add(self, text: str) -> None:
        self._text.append(text)
        if self._stack[-1].link:
            self._linked += len(text)

    def _flush(self) -> None:
        if self._text:
            text = " ".join(htmllib.unescape("".join(self._text)).split())
            linked, self._text, self._linked = self._linked, [], 0
            if text:
                top = self._stack[-1]
                self._blocks.append((top.path, top.out, top.named, top.article, top.main, min(linked, len(text)), text))
                if self._places.get("h1"):
                    self._headings.append((top.out, top.named, text))

    def _push(self, opened: _Open) -> None:
        self._places.setdefault(opened.tag, []).append(len(self._stack))
        self._stack.append(opened)

    def _pop(self, k: int) -> None:
        for x in self._stack[k:]:
            self._places[x.tag].pop()
        del self._stack[k:]

    def _last(self, tags: tuple[str, ...]) -> int:
        return max((places[-1] for t in tags if (places := self._places.get(t))), default=0)

    def _end_open(self, tag: str) -> None:
        """Ends what a block's start ends: a paragraph, the entry before it, or what an article can't be in."""
        if tag in ARTICLE:
            if found := [places[0] for t in ("p", "nav", "header") if (places := self._places.get(t))]:
                self._pop(min(found))
        elif tag in ENDS:
            stop, last = self._last(HOLDS.get(tag, ())), self._last(ENDS[tag])
            paragraphs = self._places.get("p") or []
            if last > stop:
                self._pop(last)
            elif (k := bisect.bisect_right(paragraphs, stop)) < len(paragraphs):
                self._pop(paragraphs[k])
        else:
            while (k := self._stack[-1].block) and self._stack[k].tag == "p":
                self._pop(k)

    def _open(self, tag: str, attributes: str) -> None:
        if tag == "br" or tag == "wbr":
            self._text.append(" ")
            return
        if tag in BLOCK:
            self._flush()
            self._end_open(tag)
        if tag in VOID:
            return
        names, role = "", ""
        for name, *values in LABEL.findall(attributes) if attributes else ():
            value = "".join(values)
            if name.lower() == "role":
                role = value.lower()
            else:
                names += " " + value
        around = self._stack[-1]
        out = around.out or (tag in LEFT_OUT and not (tag == "header" and around.article)) or role in LEFT_OUT_ROLES
        named = around.named
        left_out = LEFT_OUT_PARAGRAPHS if around.article and tag in PARAGRAPH else LEFT_OUT_NAMES
        if names and tag not in ("html", "body") and left_out.search(names):
            named = len(self._names)
            self._names.append(_Name(around.named, LEFT_OUT_ARTICLES.search(names) is None))
        article, main = around.article + (tag == "article"), around.main or tag == "main"
        k = named
        while tag in ARTICLE and not out and named == around.named and k >= 0 and not self._names[k].seen:
            self._names[k].seen, self._names[k].excused = True, self._names[k].may
            k = self._names[k].around
        if tag in HEADINGS and not out and named >= 0:
            self._names[named].heading = True
        link = around.link or tag == "a"
        if tag in BLOCK:
            path = _hash(around.path, tag, re.sub(r"\d+", "0", names))
            self._around[path] = around.path
            self._elements.append((path, around.path, tag, out, named))
            self._push(_Open(tag, path, out, named, article, main, link, len(self._stack)))
        else:  # inline elements are in no path, so that bold text stays part of its block
            if (out, named) != (around.out, around.named):  # what stands before it keeps its own block's fate
                self._flush()
            self._push(_Open(tag, around.path, out, named, article, main, link, around.block))

    def _close(self, tag: str) -> None:
        k = self._last((tag,))
        if not k or (tag not in BLOCK and k < self._stack[-1].block):
            if tag in BLOCK:
                self._flush()
            return
        top, below = self._stack[k], self._stack[k - 1]
        if tag in BLOCK or (top.out, top.named) != (below.out, below.named):
            self._flush()
        self._pop(k)

    def _weigh(self) -> None:
        """Keeps what only a name leaves out where the page has most of its text in it, and no article element elsewhere.

        A name of comments or related pages needs a heading in it, too.
        """
        for n in reversed(self._names):  # within comes after around
            if n.around >= 0:
                self._names[n.around].heading |= n.heading
        total = 0
        for _, out, named, *_, text in self._blocks:
            if not out:
                total += len(text)
                if named >= 0:
                    self._names[named].chars += len(text)
        for n in reversed(self._names):
            if n.around >= 0:
                self._names[n.around].chars += n.chars
        if not any(not out and (article or main) and self._kept(named) for _, out, named, article, main, *_ in self._blocks):
            for n in self._names:
                n.excused |= n.chars > NAMED_SHARE * total and (n.may or n.heading)
        for n in self._names:  # from here on excused is with all around it
            n.excused = n.excused and (n.around < 0 or self._names[n.around].excused)

    def _kept(self, named: int) -> bool:
        return named < 0 or self._names[named].excused

    def content(self) -> list[tuple[int, int, int, str]]:
        """(path of the element, level of articles, characters of links, text) of the blocks of all articles, else of all main elements, else of all."""
        told = [(path, article, linked, text) for path, article, _, linked, text in self.blocks]
        for kept in ([t for t in told if t[1] == 1], [t for t in told if t[1]], [t for t, b in zip(told, self.blocks, strict=True) if b[2]]):
            if kept:
                return kept
        return told

    def tokens(self) -> dict[int, list]:
        """Count, parent, tag, characters and characters of links (of the text directly in an element) of each token."""
        found: dict[int, list] = {}
        for path, parent, tag in self.elements:
            found.setdefault(path, [0, parent, tag, 0, 0])[0] += 1
        for at, _, _, linked, text in self.blocks:
            if at in found:
                found[at][3] += len(text)
                found[at][4] += linked
            found.setdefault(block_token(at, text), [0, at, "#text", 0, 0])[0] += 1
        return found

    def _taken(self, template: frozenset[int]) -> dict[int, bool]:
        """Of each element whether it, or one around it, is in the template; elements come after those around them."""
        taken = {0: False}
        for path, around in self._around.items():
            taken[path] = path in template or taken[around]
        return taken

    def text(self, template: frozenset[int] = frozenset()) -> str:
        """The text of the page's slots; ``template`` has the tokens of its host's template that are no text of pages: blocks and menus."""
        inside, taken = self.content(), self._taken(template)
        free = [text for path, article, _, text in inside if block_token(path, text) not in template and (article or not taken[path])]
        return "\n".join(free or [text for *_, text in inside])


def _tag_end(source: str, at: int) -> int:
    """Where the > is that ends a tag; -1 where it runs to the end. A quote that nothing closes is none."""
    while m := TAG_STOP.search(source, at):
        if m[0] == ">":
            return m.start()
        close = source.find(m[0][-1], m.end())
        if close < 0:
            return source.find(">", m.end())
        at = close + 1
    return -1


def block_token(path: int, text: str) -> int:
    return _hash(path, "#text", text)


def occurrences(pages: DataFrame, html_col: str, host_col: str) -> DataFrame:
    """``host, page, tokens``: for each different page of a host its tokens, an array of (token, n, parent, tag, chars, links); ``page`` is a hash of them.

    Pages of one title and main heading are copies of one article, whatever else differs, and count as the one with the least hash.
    """
    rows = pages.where(F.col(host_col) != "").select(F.col(host_col).alias("host"), F.col(html_col).alias("html"))
    one = pa.struct([("token", pa.int64()), ("n", pa.int32()), ("parent", pa.int64()), ("tag", pa.string()), ("chars", pa.int32()), ("links", pa.int32())])

    def batches(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            hosts, told, seen = [], [], set()
            for host, value in zip(batch.column("host"), batch.column("html"), strict=True):
                read = Page(value.as_py() or "")
                host, found = host.as_py(), read.tokens()
                page = _hash(*sorted((t, x[0]) for t, x in found.items()))
                if (host, page) not in seen:
                    seen.add((host, page))
                    hosts.append((host, _hash(read.title, read.heading) if read.heading else page, page))
                    told.append([{"token": t, "n": n, "parent": parent, "tag": tag, "chars": chars, "links": links} for t, (n, parent, tag, chars, links) in found.items()])
            columns = [pa.array(c, kind) for c, kind in zip(zip(*hosts, strict=True) if hosts else ([], [], []), (pa.string(), pa.int64(), pa.int64()), strict=True)]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(told, pa.list_(one))], ["host", "article", "page", "tokens"])

    told = rows.mapInArrow(batches, "host string, article long, page long, tokens array<struct<token:long,n:int,parent:long,tag:string,chars:int,links:int>>")
    return told.groupBy("host", "article").agg(F.min(F.struct("page", "tokens")).alias("one")).select("host", "one.page", "one.tokens")


def summed(found: DataFrame) -> DataFrame:
    """``host, token, parent, tag, chars, links, support, vector`` of the tokens that stand in two pages of a host or more; the tag ``#page`` counts the pages.

    Vectors are summed modulo 2**64 in two halves, so that no sum overflows.
    """
    one = F.struct(F.lit(0).cast("long").alias("token"), F.lit(1).alias("n"), F.lit(0).cast("long").alias("parent"), F.lit("#page").alias("tag"), F.lit(0).alias("chars"), F.lit(0).alias("links"))
    each = found.select("host", "page", F.explode(F.concat(F.array(one), F.col("tokens"))).alias("t"))
    vector = F.xxhash64("page", "t.n")
    low, high = F.sum(vector.bitwiseAND(F.lit(0xFFFFFFFF))), F.sum(F.shiftright(vector, 32))
    told = each.groupBy("host", F.col("t.token").alias("token")).agg(
        F.min("t.parent").alias("parent"), F.min("t.tag").alias("tag"), F.sum("t.chars").alias("chars"), F.sum("t.links").alias("links"), F.count("*").alias("support"),
        F.xxhash64(F.count("*"), low % F.lit(1 << 32), (high + F.floor(low / F.lit(1 << 32))) % F.lit(1 << 32)).alias("vector"),
    )
    return told.where("support > 1")


def deduce_templates(token: DataFrame, min_support: float = MIN_SUPPORT) -> DataFrame:
    """``host, n_pages, tokens``: the frequent tokens of each host with two different pages or more, an array of (token, parent, tag, chars, links, vector).

    Tokens of equal ``vector`` have equal occurrence vectors. How many there are is bound by the tokens of a page, since
    each stands in its share of the host's pages.
    """
    n_pages = token.where("tag = '#page'").select(F.col("host").alias("h"), F.col("support").alias("n_pages"))
    frequent = token.where("tag <> '#page'").join(n_pages, F.col("host").eqNullSafe(F.col("h"))).where(F.col("support") >= F.lit(min_support) * F.col("n_pages"))
    return frequent.groupBy("host").agg(F.first("n_pages").alias("n_pages"), F.collect_list(F.struct("token", "parent", "tag", "chars", "links", "vector")).alias("tokens"))


def nest(tokens: list[dict]) -> dict[int, tuple[int, int]]:
    """(vector, slot) of each token of the template: its equivalence class and the element around the class, 0 for the page.

    An element has a place if all elements around it have one. A text block has one if its class holds an element around
    it; a block that no such element shares its vector with is text of pages that happen to be alike.
    """
    by = {t["token"]: t for t in tokens if t["tag"] != "#text"}
    placed: dict[int, tuple[int, int]] = {}
    for token in by:
        chain, at = [], token
        while at in by and at not in placed:
            chain.append(at)
            at = by[at]["parent"]
        if at != 0 and at not in placed:
            continue
        for k in reversed(chain):
            parent, vector = by[k]["parent"], by[k]["vector"]
            placed[k] = (vector, placed[parent][1] if parent in placed and placed[parent][0] == vector else parent)
    for t in tokens:
        at = t["parent"]
        while t["tag"] == "#text" and at in placed:
            if placed[at][0] == t["vector"]:
                placed[t["token"]] = placed[at]
                break
            at = by[at]["parent"]
    return placed


def no_text(tokens: list[dict]) -> list[int]:
    """The tokens of a template that are no text of pages: its text blocks, and elements whose slot holds mostly links."""
    placed = nest(tokens)
    texts = {t["token"] for t in tokens if t["tag"] == "#text"}
    menus = {t["token"] for t in tokens if t["tag"] != "#text" and t["links"] > MENU_SHARE * t["chars"]}
    return sorted(k for k in placed if k in texts or k in menus)


def choose_slots(templates: DataFrame) -> DataFrame:
    """``host, n_pages, template``: what the template of each host takes from its pages."""

    def batches(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            told = [no_text(tokens.as_py()) for tokens in batch.column("tokens")]
            yield pa.RecordBatch.from_arrays([batch.column("host"), batch.column("n_pages"), pa.array(told, pa.list_(pa.int64()))], ["host", "n_pages", "template"])

    return templates.mapInArrow(batches, "host string, n_pages long, template array<long>").where("size(template) > 0")


def _with_slots(rows: DataFrame, slots: DataFrame, pages_a_task: int = 20_000, most_large: int = 50_000) -> DataFrame:
    """Pages with their host's template: broadcast within the limit, else by a shuffle that spreads large hosts over salts.

    A large host has more than ``pages_a_task`` pages and more than one in ``most_large`` of all, so at most ``most_large`` hosts are large.
    """
    if fits_broadcast(slots):
        return rows.join(F.broadcast(slots.withColumnRenamed("host", "h")), F.col("host").eqNullSafe(F.col("h")), "left").drop("h", "n_pages")
    total = slots.agg(F.sum("n_pages").alias("n")).first()["n"]
    salts = F.greatest(F.lit(1), F.ceil(F.col("n_pages") / max(pages_a_task, total // most_large))).cast("int")
    spread = slots.withColumn("n_salts", salts)
    large = F.broadcast(spread.where("n_salts > 1").select(F.col("host").alias("lh"), F.col("n_salts").alias("ls")))
    salted = rows.join(large, F.col("host").eqNullSafe(F.col("lh")), "left").withColumn("salt", F.pmod(F.xxhash64("id", "html"), F.coalesce("ls", F.lit(1))).cast("int")).drop("lh", "ls")
    copies = spread.withColumn("s", F.explode(F.sequence(F.lit(0), F.col("n_salts") - 1))).withColumnRenamed("host", "h")
    return salted.join(copies, F.col("host").eqNullSafe(F.col("h")) & (F.col("salt") == F.col("s")), "left").drop("h", "s", "salt", "n_pages", "n_salts")


def extract(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", min_support: float = MIN_SUPPORT) -> DataFrame:
    """``page_id, url, text, n_chars`` for each row."""
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"), F.when(F.col(url_col).isNotNull(), split_url(F.col(url_col))[0]).alias("host"))
    templates = deduce_templates(materialize(summed(occurrences(rows, "html", "host")), "occurrences"), min_support)
    slots = materialize(choose_slots(templates), "slots")

    def batches(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            texts = [Page(h.as_py() or "").text(frozenset(t.as_py() or ())) for h, t in zip(batch.column("html"), batch.column("template"), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("url"), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], ["page_id", "url", "text", "n_chars"])

    id_type = rows.schema["id"].dataType.simpleString()
    return _with_slots(rows, slots).select("id", "url", "html", "template").mapInArrow(batches, f"page_id {id_type}, url string, text string, n_chars long")
