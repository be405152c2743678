"""Pages as tables of nodes, and what is read off them.

flatten() parses each page once, in Arrow batches, with the standard library's
tolerant parser; everything after it is relational. Policy for malformed
markup: void elements have no content; a start tag ends the open elements that
cannot hold it (a paragraph before a block, items, terms, cells, rows, options,
headings and links before their like, through what stands open in them, but not
out of the list, table or cell around them); an end tag does not reach out of a
table cell, nor that of a phrase out of a block; one without its start tag is
ignored; comments are dropped. A piece of text is what stands between two tags
or comments, without the blanks around it.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable
from html import unescape
from html.parser import HTMLParser
from itertools import chain

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import urls
from ..sources.shared import keep, spread
from . import dom

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Start tags that end an open paragraph; elements that end the search for an
#: open one; parts of tables; what a head may hold (after the HTML standard).
ENDS_PARAGRAPH = (
    "address article aside blockquote center details dialog dir div dl dd dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr li listing main menu nav ol p plaintext pre search section summary table ul xmp"
).split()
SPECIAL = frozenset(
    (
        "address applet article aside base basefont bgsound blockquote body br button caption center col colgroup dd details dir div dl dt embed fieldset figcaption figure footer form frame frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html"
        " iframe img input keygen li link listing main marquee menu meta nav noembed noframes noscript object ol p param plaintext pre script search section select source style summary table tbody td template textarea tfoot th thead title tr track ul wbr xmp"
    ).split()
)
TABLE_PARTS = frozenset("table caption colgroup thead tbody tfoot tr td th".split())
CELLS = frozenset("td th caption table template".split())
IN_HEAD = frozenset("base basefont bgsound link meta title noscript noframes style script template".split())
#: A tag in its plain form with the text behind it; what stands before the first
#: one; tags whose text may hold no reference, and those that change how the
#: parser reads on.
_PLAIN = re.compile(r'<(?:(/)([a-z][a-z0-9]*)|([a-z][a-z0-9]*)((?: +[a-z][a-z0-9-]*="[^"&<>]*")*)( ?/)?)>([^<]*)')
_BEFORE = re.compile(r"(?:<!DOCTYPE html>)?([^<]*)")
_ATTRS = re.compile(r'([a-z][a-z0-9-]*)="([^"]*)"')
_RAW, _MODES = frozenset(("script", "style")), frozenset("textarea iframe noembed noframes noscript xmp plaintext listing svg math template".split())
#: Nodes in one batch of rows, at least; tokens of the page skeletons that a
#: worker remembers, and of the longest of them.
BATCH_NODES, KNOWN_TOKENS, LONGEST_SKELETON = 20_000, 500_000, 5_000
NODES = "page_id long, node_id int, parent_id int, end_id int, depth int, tag string, attrs map<string,string>, sibling_pos int, own_text string, own_pieces array<struct<at:int,text:string>>"
CHAPTER_TEXT = r"(?i)(?:第\s*[0-9零一二三四五六七八九十百千万两]+\s*[章节回卷]|chapter\s+\d+)"
#: Signs of kinds, and what is cut before they are looked for (fixed values).
AUTH_STATUS = (401, 403, 429, 503)
AUTH_TITLE = r"(?iU)(?:登录|登陆|验证|sign[ -]?in|log[ -]?in|verif(?:y|ication))"
CHALLENGE_TEXT = r"(?iU)(?:verify (?:you are )?human|just a moment|captcha|安全验证|人机验证)"
BLOCKED_TITLE = r"(?iU)(?:sorry,? you have been blocked|access denied|attention required|request blocked|访问被拒绝|访问受限)"
ERROR_TITLE = r"(?iU)(?:404|not found|server error|页面不存在|访问出错)"
SEARCH_TITLE = r"(?iU)(?:搜索结果|search results?|书库|小说列表)"
CLASSIFY_NOISE = "comments, .comments, #comments, .comment, #comment, recommendations, .recommendations, #recommendations, aside"
CLASSIFY_SIGNS = {
    "content": "article, [id*=content i], [class*=chapter-content i], [class*=chapter_content i], [class*=read-content i]",
    "captcha_field": "input[name*=captcha i], input[id*=captcha i]",
    "captcha_image": "img[src*=captcha i], img[alt*=captcha i]",
    "captcha_form": "form[action*=captcha i], form[action*=challenge i]",
    "search_form": "form[role=search], input[type=search i]",
}


def _rules() -> dict[str, list[tuple[frozenset, frozenset]]]:
    """By start tag: the open elements it ends, and those that end the search
    for them (outward from the innermost; the outermost one met is ended)."""
    scope = frozenset("applet button caption html marquee object table td template th".split())
    tables = frozenset(("table", "template"))
    cells, rows = {"td", "th"}, {"tr", "caption", "colgroup"}
    groups = {"thead", "tbody", "tfoot"}
    items = SPECIAL - {"address", "div", "p"}
    rules = {tag: [(frozenset("p"), scope)] for tag in ENDS_PARAGRAPH}
    more = [
        ("li", {"li"}, items), ("dd dt", {"dd", "dt"}, items), ("option", {"option"}, {"select", "optgroup", "datalist"}), ("optgroup", {"option", "optgroup"}, {"select"}),
        ("rp rt", {"rp", "rt"}, {"ruby", *scope}), ("a", {"a"}, scope), ("h1 h2 h3 h4 h5 h6", {"h1", "h2", "h3", "h4", "h5", "h6"}, SPECIAL),
        ("td th", cells, {"tr", *tables}), ("tr", cells | rows, groups | tables), ("caption colgroup thead tbody tfoot", cells | rows | groups, tables), ("body", {"head"}, {"html"}),
    ]
    for tags, ended, stops in more:
        for tag in tags.split():
            rules.setdefault(tag, []).append((frozenset(ended), frozenset(stops) - ended))
    return rules


_RULES = _rules()
_RAW_OR_TITLE, _ENDS_OF_TABLES = _RAW | {"title"}, frozenset(("table", "template"))


class _Flat(HTMLParser):
    """The nodes of pages fed one after another, column by column."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.rules, self.columns = _RULES, {f.split()[0]: [] for f in NODES.split(", ")}
        self.stack, self.names, self.kinds, self.texts, self.first, self.run = [], [], [{}], [], 0, []
        self.appends = [self.columns[c].append for c in ("node_id", "parent_id", "end_id", "depth", "tag", "attrs", "sibling_pos")]

    def __len__(self):
        return len(self.columns["tag"])

    def page(self, page, html):
        self.first, self.texts = len(self), []
        if self._plain(html or ""):
            self.columns["page_id"] += [page] * (len(self) - self.first)
            return
        self.reset()
        self.feed(html)
        self.close()
        self._end_run()
        self._close(0)
        self.columns["page_id"] += [page] * len(self.texts)
        self.columns["own_text"] += [t[0][1] if len(t) == 1 else " ".join([said for _, said in t]) for t in self.texts]
        self.columns["own_pieces"] += [None if not t or len(t) == 1 and t[0][0] == k else [{"at": at, "text": said} for at, said in t] for k, t in enumerate(self.texts)]
        self.kinds = [{}]

    def _plain(self, html):
        """Reads a page of plain tags only, whose tokens one pattern finds;
        others are left to the parser. True if it was read. What stands before
        the first tag belongs to no node. Pages of one skeleton (tags, and where
        texts are) have one layout, which is worked out once."""
        at = _BEFORE.match(html).end()
        met = _PLAIN.findall(html, at)
        if len("".join(chain.from_iterable(met))) + 2 * len(met) != len(html) - at:  # each has two brackets; the tokens leave a gap
            return False
        if not met:
            return True
        closes, ended, tags, attrs, alone, said = zip(*met)
        if "&" in html:
            said = [s if "&" not in s or tag in _RAW else unescape(s) for s, tag in zip(said, tags)]
        said = [s and s.strip() for s in said]
        layout = _layout((ended, tags, alone, tuple(map(bool, said))))
        if layout is None:
            return False
        for name in ("node_id", "parent_id", "end_id", "depth", "tag", "sibling_pos"):
            self.columns[name] += layout[name]
        self.columns["attrs"] += [list(dict(_ATTRS.findall(attrs[k])).items()) if attrs[k] else [] for k in layout["starts"]]
        said.append("")  # that of nodes without
        own, pieces = [said[k] for k in layout["single"]], [None] * len(layout["single"])
        for k, many in layout["many"]:
            own[k] = " ".join([said[token] for _, token in many])
            pieces[k] = [{"at": at, "text": said[token]} for at, token in many]
        self.columns["own_text"] += own
        self.columns["own_pieces"] += pieces
        return True

    def clear(self):
        """Forgets the pages so far."""
        for column in self.columns.values():
            column.clear()

    def handle_starttag(self, tag, attrs):
        if self.run:
            self._end_run()
        names = self.names
        if names and names[-1] == "head" and tag not in IN_HEAD:
            self._close(len(names) - 1)
        for ended, stops in self.rules.get(tag, ()):
            if ended.isdisjoint(names):
                continue
            outermost = None
            for k in range(len(names) - 1, -1, -1):
                if names[k] in ended:
                    outermost = k
                elif names[k] in stops:
                    break
            if outermost is not None:
                self._close(outermost)
        counts, stack = self.kinds[-1], self.stack
        counts[tag] = nth = counts.get(tag, 0) + 1
        at = len(self.texts)
        node, parent, end, depth, name, given, place = self.appends
        node(at)
        parent(stack[-1] if stack else None)
        end(at)
        depth(len(stack))
        name(tag)
        given([(k, v or "") for k, v in dict(attrs).items()])
        place(nth)
        self.texts.append([])
        if tag not in VOID:
            stack.append(at)
            names.append(tag)
            self.kinds.append({})

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self._close(len(self.stack) - 1)

    def handle_endtag(self, tag):
        if self.run:
            self._end_run()
        names = self.names
        if names and names[-1] == tag:
            self._close(len(names) - 1)
            return
        stops = _ENDS_OF_TABLES if tag in TABLE_PARTS else CELLS if tag in SPECIAL else SPECIAL
        for k in range(len(names) - 1, -1, -1):
            if names[k] == tag:
                self._close(k)
                return
            if names[k] in stops:
                return

    def handle_data(self, data):
        self.run.append(data)

    def handle_comment(self, data):
        self._end_run()

    handle_decl = handle_pi = unknown_decl = handle_comment

    def _end_run(self):
        """What was said since the last tag is a piece of the innermost open element."""
        said, self.run = "".join(self.run).strip(), []
        if self.stack and said:
            self.texts[self.stack[-1]].append((len(self.texts) - 1, said))

    def _close(self, depth):
        last, ends = len(self.texts) - 1, self.columns["end_id"]
        while len(self.stack) > depth:
            ends[self.first + self.stack.pop()] = last
            self.names.pop()
            self.kinds.pop()


#: Layouts by skeleton, as far as KNOWN_TOKENS go.
_LAYOUTS: dict[tuple, dict | None] = {}


def _layout(skeleton: tuple) -> dict | None:
    """The nodes of plain pages of a skeleton (ended tags, begun tags, whether
    alone, whether a text follows; one each a token): their columns, the token
    that begins each, and of its pieces of text the tokens that they follow:
    `single` where it is one right behind the start tag (-1: none), else `many`.
    None for pages that the parser is to read."""
    if skeleton in _LAYOUTS:
        return _LAYOUTS[skeleton]
    out, size = None, len(skeleton[0])
    tokens = list(zip(*skeleton))
    if not any(tag in _MODES or tag in _RAW_OR_TITLE and (alone or k + 1 == size or skeleton[0][k + 1] != tag) for k, (_, tag, alone, _) in enumerate(tokens)):
        flat = _Flat()
        for k, (ended, tag, alone, speaks) in enumerate(tokens):
            if ended:
                flat.handle_endtag(ended)
            else:
                (flat.handle_startendtag if alone else flat.handle_starttag)(tag, ())
            if speaks:
                flat.run.append(str(k))
        flat._end_run()
        flat._close(0)
        out = {name: flat.columns[name] for name in ("node_id", "parent_id", "end_id", "depth", "tag", "sibling_pos")}
        texts = [[(at, int(token)) for at, token in t] for t in flat.texts]
        own = [not t or len(t) == 1 and t[0][0] == k for k, t in enumerate(texts)]
        out |= {"starts": [k for k, (ended, *_) in enumerate(tokens) if not ended], "single": [t[0][1] if t and alone else -1 for t, alone in zip(texts, own)], "many": [(k, t) for k, (t, alone) in enumerate(zip(texts, own)) if not alone]}
    if size <= LONGEST_SKELETON:
        _LAYOUTS[skeleton], _KNOWN[0] = out, _KNOWN[0] + size
        if _KNOWN[0] > KNOWN_TOKENS:
            _LAYOUTS.clear()
            _KNOWN[0] = 0
    return out


#: Tokens of the skeletons in _LAYOUTS.
_KNOWN = [0]


def dealt(rows: DataFrame) -> DataFrame:
    """rows of pages in as many parts as the session shuffles into, each page in
    one: few bytes are much work, so parts by bytes would leave cores idle. The
    number stays as it is, and the hash is one of its own: rows that are already
    parted by page would not be dealt again by that."""
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), F.xxhash64("page_id"))


def flatten(pages: DataFrame) -> DataFrame:
    """Nodes of pages (page_id, html) in preorder; a node's descendants are
    those with node_id in (node_id, end_id]. own_text holds the pieces of text
    right below the node, joined by blanks; where it is more than one piece
    behind the start tag, own_pieces tells each and the node begun last before it.
    Null html gives no node."""

    def run(batches):
        kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.map_(pa.string(), pa.string()), pa.int32(), pa.string(), pa.list_(pa.struct([("at", pa.int32()), ("text", pa.string())]))]
        for batch in batches:
            flat = _Flat()
            for page, html in zip(batch.column(0), batch.column(1)):
                flat.page(page.as_py(), html.as_py())
                if len(flat) >= BATCH_NODES:
                    yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(flat.columns.values(), kinds)], list(flat.columns))
                    flat = _Flat()
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(flat.columns.values(), kinds)], list(flat.columns))

    return pages.select(F.col("page_id").cast("long"), "html").mapInArrow(run, NODES)


def _each_page(captured: DataFrame, found: Callable, shape: str, *more: Column) -> DataFrame:
    """found(page_id, columns of its nodes, values of `more`) of every page
    (page_id, html), in one pass that lets no other node leave it: rows as
    `shape` names them. For what needs whole pages and gives little."""

    def run(batches):
        flat = _Flat()
        for batch in batches:
            rows = []
            for page, html, *given in zip(*batch.columns):
                flat.page(page.as_py(), html.as_py())
                rows += found(page.as_py(), flat.columns, *[g.as_py() for g in given])
                flat.clear()
                if len(rows) >= BATCH_NODES:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names)
                    rows = []
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names)

    names = [c.split()[0] for c in shape.split(", ")]
    kinds = [{"long": pa.int64(), "int": pa.int32(), "string": pa.string()}[c.split()[1]] for c in shape.split(", ")]
    return captured.select(F.col("page_id").cast("long"), "html", *more).mapInArrow(run, shape)


def located(captured: DataFrame, asked: Callable[[str, dict], bool] | None = None, plain: bool = False) -> DataFrame:
    """(page_id, node_id, tag, nth, selector) of pages (page_id, html): dom.paths
    of the nodes whose tag and attributes `asked` takes (none given: of all);
    nth counts those of one tag."""
    search = dom.Search(plain)

    def found(page, c):
        given, none = {k: dict(a) for k, a in enumerate(c["attrs"]) if a}, {}
        wanted = [k for k, tag in enumerate(c["tag"]) if asked is None or asked(tag, given.get(k, none))]
        if not wanted:
            return []
        own, classes = [None] * len(c["tag"]), [None] * len(c["tag"])
        for k, a in given.items():
            own[k], classes[k] = a.get("id"), a.get("class")
        parts = [c[name] for name in ("node_id", "parent_id", "end_id", "tag", "sibling_pos")]
        of_page = search(*parts, own, classes, lambda: (c["own_text"], c["own_pieces"]), wanted)
        met, rows = Counter(), []
        for k in wanted:
            met[tag := c["tag"][k]] += 1
            rows.append((page, c["node_id"][k], tag, met[tag], of_page[k]))
        return rows

    return _each_page(captured, found, "page_id long, node_id int, tag string, nth int, selector string")


def text_pieces(nodes: DataFrame) -> DataFrame:
    """(page_id, at, owner, nth, text): the pieces of text of `nodes`; in the
    order of these columns they stand as in the page. at is the node begun last
    before a piece, owner the negative of its node: pieces behind one start tag
    belong to ever outer nodes."""
    alone = F.array(F.struct(F.col("node_id").alias("at"), F.col("own_text").alias("text")))
    spread = nodes.filter("own_text <> ''").select("page_id", "node_id", F.posexplode(F.coalesce("own_pieces", alone)).alias("nth", "p"))
    return spread.select("page_id", F.col("p.at").alias("at"), (-F.col("node_id")).alias("owner"), "nth", F.col("p.text").alias("text"))


def page_texts(pieces: DataFrame) -> DataFrame:
    """(page_id, t): all pieces of a page in order."""
    return pieces.groupBy("page_id").agg(F.array_sort(F.collect_list(F.struct("at", "owner", "nth", "text")))["text"].alias("t"))


def node_text(nodes: DataFrame, of: DataFrame, sep: str = " ", keeping: list[str] = ()) -> DataFrame:
    """(page_id, node_id, text) of the nodes in `of` with all that is in them,
    its pieces in page order joined by sep, and the flags `keeping` of `of`; nodes without text have no row. A
    node's pieces are a run of its page's pieces: one window counts where it
    begins and ends."""
    pieces = text_pieces(nodes)
    flags = lambda df: [F.col(c) if c in df.columns else F.lit(None).cast("boolean").alias(c) for c in keeping]
    mark = lambda df, at, owner, kind, top: df.select("page_id", F.col(at).alias("at"), owner.cast("int").alias("owner"), F.lit(kind).alias("kind"), top.cast("int").alias("top"), *flags(df))
    marks = mark(pieces, "at", F.col("owner"), 1, F.lit(None)).unionByName(mark(of, "node_id", F.lit(-(1 << 31)), 0, F.col("node_id"))).unionByName(mark(of, "end_id", -F.col("node_id"), 2, F.col("node_id")))
    order = Window.partitionBy("page_id").orderBy("at", "owner", "kind").rowsBetween(Window.unboundedPreceding, 0)
    spans = marks.withColumn("n", F.count_if(F.col("kind") == 1).over(order)).filter("kind <> 1").groupBy("page_id", "top").agg(F.min("n").cast("int").alias("first"), F.max("n").cast("int").alias("last"), *[F.max(c).alias(c) for c in keeping])
    found = spans.filter("last > first").join(spread(page_texts(pieces)), "page_id")
    return found.select("page_id", F.col("top").alias("node_id"), F.array_join(F.slice("t", F.col("first") + 1, F.col("last") - F.col("first")), sep).alias("text"), *keeping)


def links(pages: DataFrame, nodes: DataFrame, said: DataFrame | None = None, **more: Column) -> DataFrame:
    """Anchors with href: href, text, absolute url, same-site flag, and `more`
    columns over their nodes. said: node_text of all anchors, where it is known."""
    anchors = nodes.filter((F.col("tag") == "a") & F.col("attrs")["href"].isNotNull())
    said = node_text(nodes, anchors) if said is None else said.select("page_id", "node_id", "text")
    base = pages.select("page_id", F.col("url").alias("base"))
    out = anchors.select("page_id", "node_id", F.col("attrs")["href"].alias("href"), *[c.alias(n) for n, c in more.items()]).join(spread(said), ["page_id", "node_id"], "left").join(spread(base), "page_id")
    return _resolved(out, *more)


def _resolved(anchors: DataFrame, *more: str) -> DataFrame:
    full = urls.resolve(F.col("base"), F.col("href"))
    return anchors.select("page_id", "node_id", "href", F.coalesce("text", F.lit("")).alias("text"), full.alias("url"), (urls.domain_of(full) == urls.domain_of(F.col("base"))).alias("same_site"), *more)


def page_links(captured: DataFrame) -> DataFrame:
    """links() of pages (page_id, url, html) in one pass over them, for where
    nothing else is read of their nodes."""

    def found(page, c, base):
        rows, said = [], None
        for k, (tag, attrs) in enumerate(zip(c["tag"], c["attrs"])):
            if tag == "a" and attrs and (href := dict(attrs).get("href")) is not None:
                text = c["own_text"][k]
                if c["end_id"][k] > k:
                    said = dom.said_pieces(c["node_id"], c["own_text"], c["own_pieces"]) if said is None else said
                    text = " ".join(dom.pieces_in(said, k, c["end_id"][k]))
                rows.append((page, k, href, text, base))
        return rows

    return _resolved(_each_page(captured, found, "page_id long, node_id int, href string, text string, base string", F.col("url").alias("base")))


def page_facts(nodes: DataFrame) -> DataFrame:
    """Title, first h1, and counts of each page."""
    first = lambda tag: F.min_by("own_text", F.when(F.col("tag") == tag, F.col("node_id"))).alias(tag)
    count = lambda tag: F.count_if(F.col("tag") == tag).alias(f"{tag}_count")
    return nodes.groupBy("page_id").agg(F.count(F.lit(1)).alias("nodes"), first("title"), first("h1"), *[count(t) for t in ("a", "p", "li", "article", "nav")])


def classify(pages: DataFrame, nodes: DataFrame) -> DataFrame:
    """(page_id, kind, confidence, evidence) by fixed precedence: blocked title,
    two of four challenge signals, login form (these at a status under 400 or
    of AUTH_STATUS), error status, error title, chapter, book index (three
    distinct chapter links), search or list, unknown. Noise regions are cut
    first; the title is the whole page's. A null status is 200."""
    here = lambda selector: dom.fits_one(selector)
    clean = keep(dom.without(nodes, nodes.filter(here(CLASSIFY_NOISE))))
    first = lambda table, tag: table.filter(F.col("tag") == tag).groupBy("page_id").agg(F.min("node_id").alias("node_id"), F.min_by("end_id", "node_id").alias("end_id"))
    titles = node_text(nodes, first(nodes, "title")).select("page_id", F.trim("text").alias("title"))
    heads = node_text(clean, first(clean, "h1")).select("page_id", F.trim("text").alias("heading"))
    anchors = clean.filter((F.col("tag") == "a") & dom.attr("href").isNotNull())
    chapter_text = F.col("text").rlike(f"(?U){CHAPTER_TEXT}")
    said = node_text(clean, anchors).filter(chapter_text).join(anchors.select("page_id", "node_id", dom.attr("href").alias("href")), ["page_id", "node_id"])
    chapters = said.groupBy("page_id").agg(F.countDistinct("href").alias("chapter_links"))
    spoken = dom.without(clean, clean.filter(F.col("tag").isin("script", "style", "template")))
    texts = page_texts(text_pieces(spoken)).select("page_id", F.array_join("t", " ").alias("said"))
    met = clean.groupBy("page_id").agg(*[F.max(here(selector)).alias(name) for name, selector in CLASSIFY_SIGNS.items()])
    # a password field counts by the form nearest to it
    forms = clean.filter(F.col("tag") == "form").select(
        F.col("page_id"), F.col("node_id").alias("_from"), F.col("end_id").alias("_to"),
        (dom.attr("hidden").isNull() & ~F.replace(F.coalesce(dom.attr("style"), F.lit("")), F.lit(" "), F.lit("")).contains("display:none")).alias("shown"),
    )
    fields = clean.filter(here("input[type=password i]")).join(forms, "page_id").filter("node_id > _from and node_id <= _to")
    logins = fields.groupBy("page_id", "node_id").agg(F.max_by("shown", "_from").alias("shown")).groupBy("page_id").agg(F.max("shown").alias("login"))
    joined = pages
    for table in (titles, heads, chapters, texts, met, logins):
        joined = joined.join(spread(table), "page_id", "left")
    status = F.coalesce("status_code", F.lit(200)) if "status_code" in pages.columns else F.lit(200)
    title, heading = F.coalesce("title", F.lit("")), F.coalesce("heading", F.lit(""))
    both, flag = F.concat_ws(" ", title, heading), lambda name: F.coalesce(F.col(name), F.lit(False))
    refused = status.isin(*AUTH_STATUS)
    asked = (status < 400) | refused
    signals = F.concat_ws(" ", title, F.coalesce("said", F.lit(""))).rlike(CHALLENGE_TEXT).cast("int")
    for name in ("captcha_field", "captcha_image", "captcha_form"):
        signals = signals + flag(name).cast("int")
    rules = [
        (refused & title.rlike(BLOCKED_TITLE), "auth_or_challenge", 0.99, "auth.blocked_title"),
        (asked & (signals >= 2), "auth_or_challenge", 0.96, "auth.challenge_signals"),
        (asked & both.rlike(AUTH_TITLE) & flag("login"), "auth_or_challenge", 0.98, "auth.password_input"),
        (status >= 400, "error", 1.0, "error.http_status"),
        (title.rlike(ERROR_TITLE), "error", 0.9, "error.title_marker"),
        (flag("content") & both.rlike(f"(?U){CHAPTER_TEXT}"), "chapter", 0.95, "chapter.title_and_content"),
        (F.coalesce("chapter_links", F.lit(0)) >= 3, "book_index", 0.93, "book_index.chapter_link_cluster"),
        (title.rlike(SEARCH_TITLE) | flag("search_form"), "search_or_list", 0.88, "list.search_marker"),
    ]
    verdict = lambda kind, sure, why: F.struct(F.lit(kind).alias("kind"), F.lit(sure).alias("confidence"), F.array(*map(F.lit, why)).cast("array<string>").alias("evidence"))
    choice = F
    for test, kind, sure, why in rules:
        choice = choice.when(test, verdict(kind, sure, [why]))
    return joined.select("page_id", choice.otherwise(verdict("unknown", 0.0, [])).alias("v")).select("page_id", "v.*")
