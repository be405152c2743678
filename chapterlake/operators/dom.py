"""Selectors, noise, paths and fingerprints over node tables (see pages.py).

Selector subset: lists split by commas; steps joined by blanks (descendant) or
`>` (child); each step a tag or `*` with any of `#id`, `.class`, `[attr]`,
`[attr=v]`, `[attr*=v]`, `[attr^=v]`, `[attr$=v]` (` i` ignores case) and
`:nth-of-type(n)`. Descendant steps are one window in page order, child steps a join on the parent.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter, defaultdict
from functools import cached_property, reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sources.shared import spread

#: Limits of selectors (fixed values): how many, characters in all and of one, joins.
LIMITS = (20, 4096, 512, 3)
_ATTR = r"\[\s*([A-Za-z][\w:-]*)\s*(?:([*^$]?=)\s*(?:\"([^\"]*)\"|'([^']*)'|([^\]\s]+))\s*(i)?)?\s*\]"
_STEP = re.compile(rf"(?:\*|[A-Za-z][\w-]*)?(?:#[\w-]+|\.[\w-]+|{_ATTR}|:nth-of-type\(\d+\))*")
#: Noise markers in tag, id and classes; noise classes of fingerprints; tags
#: without text of their own (fixed values).
NOISE = r"(?i)(?:comment|recommend|related|advert|\bad\b|banner|footer|share|评论|推荐|广告)"
NOISE_TOKEN = r"(?i)(?:^|[-_\s])(?:ad|ads|advert|advertisement|banner|cookie|popup|promo|social|tracking)(?:$|[-_\s])"
SILENT = "script style noscript template svg".split()
#: Words of ids and classes that name parts of pages (fixed values), and ids and
#: classes that no selector may show.
PARTS = frozenset("content chapter catalog book list reader article author title nav pagination main body text novel entry item link comment recommend related advert ad banner footer share".split())
_SECRET = re.compile(r"token|secret|session|password|@", re.I)
_UUID = re.compile(r"[0-9a-f]{8}(?:-[0-9a-f]{4}){3}-[0-9a-f]{12}", re.I)
_PLAIN = re.compile(r"[A-Za-z_][\w-]*")
#: Tags and roles that a fingerprint tells apart (fixed values).
TAG_BUCKETS = "html body main article section header footer nav aside h1 h2 h3 p ol ul li a form input button table tr td".split()
ROLE_BUCKETS = "article banner button contentinfo form heading link list listitem main navigation region search".split()


def attr(name: str) -> Column:
    return F.col("attrs")[name]


def classes() -> Column:
    return F.split(F.trim(F.coalesce(attr("class"), F.lit(""))), r"\s+")


def marker() -> Column:
    """Tag, id and classes of a node as one text."""
    return F.concat_ws(" ", "tag", attr("id"), attr("class"))


def is_noise() -> Column:
    return marker().rlike(NOISE)


def parse(selector: str) -> list[list[tuple[str, str]]] | None:
    """Alternatives of (joint, step) lists; null for unsupported syntax or a
    selector over the limits."""
    if not selector or len(selector) > LIMITS[2]:
        return None
    out = []
    for one in re.split(r",(?![^\[]*\])", selector):
        tokens = re.split(r"(\s*>\s*|\s+)(?![^\[]*\])", one.strip())
        steps = [(" " if k == 0 else tokens[k - 1].strip() or " ", tokens[k]) for k in range(0, len(tokens), 2)]
        if len(steps) > LIMITS[3] + 1 or not all(s and _STEP.fullmatch(s) for _, s in steps):
            return None
        out.append(steps)
    return out


def _fits(step: str) -> Column:
    tests = []
    if named := re.match(r"[A-Za-z][\w-]*", step):
        tests.append(F.col("tag") == named.group().lower())
    bare = re.sub(_ATTR, "", step)
    tests += [attr("id") == i for i in re.findall(r"#([\w-]+)", bare)]
    tests += [F.array_contains(classes(), c) for c in re.findall(r"\.([\w-]+)", bare)]
    tests += [F.col("sibling_pos") == int(n) for n in re.findall(r":nth-of-type\((\d+)\)", step)]
    for name, op, *values, fold in re.findall(_ATTR, step):
        value, given = next((v for v in values if v), ""), attr(name.lower())
        if fold:
            value, given = value.lower(), F.lower(given)
        tests.append(given.isNotNull() if not op else given == value if op == "=" else given.contains(value) if op == "*=" else given.endswith(value) if op == "$=" else given.startswith(value))
    return F.coalesce(reduce(lambda a, b: a & b, tests, F.lit(True)), F.lit(False))


def fits_one(selector: str) -> Column:
    """Whether a node fits one of a selector's alternatives, each a single step."""
    parsed = parse(selector)
    if parsed is None or any(len(steps) > 1 for steps in parsed):
        raise ValueError(f"unsupported selector: {selector}")
    return reduce(lambda a, b: a | b, [_fits(steps[0][1]) for steps in parsed])


def select(nodes: DataFrame, selector: str) -> DataFrame:
    """Nodes that a selector matches, each once. An unsupported selector raises
    ValueError; select_all reports it instead."""
    parsed = parse(selector)
    if parsed is None:
        raise ValueError(f"unsupported selector: {selector}")
    if all(len(steps) == 1 for steps in parsed):
        return nodes.filter(fits_one(selector))
    found = []
    for steps in parsed:
        hit = nodes.filter(_fits(steps[0][1]))
        for joint, step in steps[1:]:
            if joint == ">":
                hit = nodes.filter(_fits(step)).join(spread(_ranges(hit)), _same_page() & (F.col("parent_id") == F.col("_from")), "left_semi")
            else:
                hit = covered(nodes.filter(_fits(step)), hit, strict=True).filter("_in").drop("_in")
        found.append(hit)
    return found[0] if len(found) == 1 else reduce(DataFrame.unionByName, found).dropDuplicates(["page_id", "node_id"])


def select_each(nodes: DataFrame, selectors: list[str]) -> DataFrame:
    """Matches of each selector: nodes with selector and its position in the
    list. Selectors of single steps are met in one pass over the nodes, those
    of two (`.a b`) in one window over the nodes that fit a step."""
    single, below, many = [], [], []
    for k, s in enumerate(selectors):
        parsed = parse(s)
        if parsed and all(len(steps) == 1 for steps in parsed):
            single.append((k, s))
        elif parsed and len(parsed) == 1 and len(parsed[0]) == 2 and parsed[0][1][0] == " ":
            below.append((k, s, [step for _, step in parsed[0]]))
        else:
            many.append((k, s))
    found = [select(nodes, s).select(*nodes.columns, F.lit(s).alias("selector"), F.lit(k).alias("position")) for k, s in many]
    if single:
        hits = F.array(*[F.when(fits_one(s), F.struct(F.lit(s).alias("selector"), F.lit(k).alias("position"))) for k, s in single])
        met = nodes.select(*nodes.columns, F.explode(F.array_compact(hits)).alias("_hit"))
        found.append(met.select(*nodes.columns, "_hit.selector", "_hit.position"))
    if below:
        found.append(_select_below(nodes, below))
    return reduce(DataFrame.unionByName, found)


def _select_below(nodes: DataFrame, selectors: list[tuple[int, str, list[str]]]) -> DataFrame:
    """Matches of selectors (position, selector, its two steps) as select_each
    has them: of the nodes that fit an outer step, the greatest end met before a
    node tells whether it lies in one. What a node fits goes along as bits."""
    bits = lambda at: reduce(lambda a, b: a.bitwiseOR(b), [F.when(_fits(steps[at]), F.lit(1 << n)).otherwise(F.lit(0)) for n, (_, _, steps) in enumerate(selectors)])
    fit = nodes.withColumns({"_outer": bits(0), "_inner": bits(1)}).filter("_outer <> 0 or _inner <> 0")
    before = Window.partitionBy("page_id").orderBy("node_id").rowsBetween(Window.unboundedPreceding, -1)
    has = lambda c, n: F.col(c).bitwiseAND(F.lit(1 << n)) != 0
    met = fit.withColumns({f"_end{n}": F.max(F.when(has("_outer", n), F.col("end_id"))).over(before) for n in range(len(selectors))}).filter("_inner <> 0")
    hits = F.array(*[F.when(has("_inner", n) & (F.col(f"_end{n}") >= F.col("node_id")), F.struct(F.lit(s).alias("selector"), F.lit(k).alias("position"))) for n, (k, s, _) in enumerate(selectors)])
    return met.select(*nodes.columns, F.explode(F.array_compact(hits)).alias("_hit")).select(*nodes.columns, "_hit.selector", "_hit.position")


def select_all(nodes: DataFrame, selectors: dict[str, str]) -> DataFrame:
    """(page_id, name, selector, matches, first_node, error_code) of named
    selectors; pages without a match of a selector have no row of it."""
    names, known = list(selectors), {k: s for k, s in enumerate(selectors.values()) if parse(s) is not None}
    labels = lambda k: (F.element_at(F.array(*map(F.lit, names)), k + 1).alias("name"), F.element_at(F.array(*map(F.lit, selectors.values())), k + 1).alias("selector"))
    out = []
    if known:
        place = F.element_at(F.array(*map(F.lit, known)), F.col("position") + 1)
        hit = select_each(nodes, list(known.values())).groupBy("page_id", place.alias("k")).agg(F.count(F.lit(1)).alias("matches"), F.min("node_id").alias("first_node"))
        out.append(hit.select("page_id", *labels(F.col("k")), "matches", "first_node", F.lit(None).cast("string").alias("error_code")))
    for k in (k for k in range(len(names)) if k not in known):
        out.append(nodes.select("page_id").distinct().select("page_id", *labels(F.lit(k)), F.lit(0).cast("long").alias("matches"), F.lit(None).cast("int").alias("first_node"), F.lit("selector_invalid").alias("error_code")))
    return reduce(DataFrame.unionByName, out)


def _ranges(roots: DataFrame) -> DataFrame:
    return roots.select(F.col("page_id").alias("_page"), F.col("node_id").alias("_from"), F.col("end_id").alias("_to"))


def _same_page() -> Column:
    return F.col("page_id") == F.col("_page")


def _inside() -> Column:
    return (F.col("node_id") >= F.col("_from")) & (F.col("node_id") <= F.col("_to"))


def covered(nodes: DataFrame, roots: DataFrame, name: str = "_in", strict: bool = False) -> DataFrame:
    """Adds the flag `name`: whether a node lies in the subtree of one of `roots` (with
    strict, below its root). Subtrees nest, so the greatest end among roots
    met so far in page order decides: one window, no pairs."""
    ends = roots.select("page_id", "node_id", F.col("end_id").alias("_to"), F.lit(1 if strict else -1).alias("_kind"))
    both = nodes.withColumn("_kind", F.lit(0)).unionByName(ends, allowMissingColumns=True)
    order = Window.partitionBy("page_id").orderBy("node_id", "_kind").rowsBetween(Window.unboundedPreceding, 0)
    met = both.withColumn("_last", F.max("_to").over(order)).filter("_kind = 0")
    return met.select(*nodes.columns, F.coalesce(F.col("_last") >= F.col("node_id"), F.lit(False)).alias(name))


def without(nodes: DataFrame, roots: DataFrame) -> DataFrame:
    """Nodes outside the subtrees of `roots`."""
    return covered(nodes, roots).filter("not _in").drop("_in")


def blanked(nodes: DataFrame, roots: DataFrame) -> DataFrame:
    """All nodes, those in the subtrees of `roots` without tag, attributes and
    text: nothing selects them, and ranges and totals of others hold."""
    shown = lambda c, none: F.when(F.col("_in"), none).otherwise(F.col(c)).alias(c)
    empty = {"tag": F.lit(""), "attrs": F.lit(None), "own_text": F.lit("")}
    return covered(nodes, roots).select(*[shown(c, empty[c]) if c in empty else F.col(c) for c in nodes.columns])


def denoised(nodes: DataFrame, noise: Column | None = None) -> DataFrame:
    """Nodes outside noise regions and silent tags."""
    return without(nodes, nodes.filter((is_noise() if noise is None else noise) | F.col("tag").isin(*SILENT)))


def subtree_totals(nodes: DataFrame, **sums: Column) -> DataFrame:
    """Adds, for each node, sums over itself and all that is in it, by running
    totals: total(end_id) - total(before node_id). One window a page. Takes
    whole pages: cut regions with blanked(), not without()."""
    order = Window.partitionBy("page_id").orderBy("node_id").rowsBetween(Window.unboundedPreceding, 0)
    running = nodes.withColumns({f"_{name}": F.sum(value.cast("long")).over(order) for name, value in sums.items()} | {f"_own_{name}": value.cast("long") for name, value in sums.items()})
    ends = running.select("page_id", F.col("node_id").alias("end_id"), *[F.col(f"_{n}").alias(f"_end_{n}") for n in sums])
    joined = running.join(spread(ends), ["page_id", "end_id"])
    return joined.select(*nodes.columns, *[(F.col(f"_end_{n}") - F.col(f"_{n}") + F.col(f"_own_{n}")).alias(n) for n in sums])


def totals_of(nodes: DataFrame, of: DataFrame, **sums: Column) -> DataFrame:
    """(page_id, node_id, sums) of the nodes of `of` alone: the totals of
    subtree_totals, from the nodes that add to one of them. A subtree is a run
    of its page's nodes: one window tells what was met where it begins and ends."""
    counted = nodes.select("page_id", F.col("node_id").alias("at"), F.lit(1).alias("kind"), F.lit(None).cast("int").alias("top"), *[F.coalesce(c.cast("long"), F.lit(0)).alias(n) for n, c in sums.items()])
    counted = counted.filter(reduce(lambda a, b: a | b, [F.col(n) != 0 for n in sums]))
    wanted = of.select("page_id", "node_id", "end_id").distinct()
    mark = lambda at, kind: wanted.select("page_id", F.col(at).alias("at"), F.lit(kind).alias("kind"), F.col("node_id").alias("top"), *[F.lit(0).cast("long").alias(n) for n in sums])
    order = Window.partitionBy("page_id").orderBy("at", "kind").rowsBetween(Window.unboundedPreceding, 0)
    met = counted.unionByName(mark("node_id", 0)).unionByName(mark("end_id", 2)).withColumns({n: F.sum(n).over(order) for n in sums}).filter("kind <> 1")
    part = lambda n: F.max(F.when(F.col("kind") == 2, F.col(n))) - F.max(F.when(F.col("kind") == 0, F.col(n)))
    return met.groupBy("page_id", F.col("top").alias("node_id")).agg(*[part(n).alias(n) for n in sums])


def text_length() -> Column:
    return F.when(F.col("tag").isin(*SILENT), 0).otherwise(F.length("own_text"))


def said_pieces(ids, texts, pieces) -> list[tuple]:
    """The pieces of text of a page in order, as pages.text_pieces has them."""
    return sorted((p["at"], -i, n, p["text"]) for i, text, many in zip(ids, texts, pieces) for n, p in enumerate(many or [{"at": i, "text": text}]) if p["text"])


def pieces_in(said: list[tuple], first: int, last: int) -> list[str]:
    """Those of the node `first`, whose subtree ends with `last`."""
    return [text for _, owner, _, text in said[bisect_left(said, (first,)) : bisect_left(said, (last + 1,))] if -owner >= first]  # its own and those of nodes below


def _says(said: list[tuple], first: int, last: int) -> str:
    """What a node says, without blanks and marks."""
    return re.sub(r"\W+", "", "".join(pieces_in(said, first, last))).casefold()


class _Page:
    """The nodes of one page, for the search of selectors that match one node."""

    def __init__(self, ids, parents, ends, tags, positions, own, classes, spoken):
        """spoken: gives the columns of texts and pieces, which few pages need.
        heard: the (word, node, whether it is all that the node says) that were
        asked of them."""
        self.heard: list[tuple[str, int, bool]] = []
        self.at = {i: k for k, i in enumerate(ids)}
        self.ids, self.ends, self.tags, self.positions, self.spoken = ids, ends, tags, positions, spoken
        self.up = [self.at.get(p) for p in parents]
        self.own, self.classes = own, classes
        kinds, self.by_id, self.by_class = Counter(zip(self.up, tags)), defaultdict(set), defaultdict(set)
        # a step names its place only among several of its kind
        self.steps = [tag if kinds[up, tag] == 1 else f"{tag}:nth-of-type({n})" for up, tag, n in zip(self.up, tags, positions)]
        for k, (i, many) in enumerate(zip(own, classes)):
            if i:
                self.by_id[i].add(k)
            if many:
                for c in many.split():
                    self.by_class[c].add(k)

    @cached_property
    def said(self) -> list[tuple]:
        return said_pieces(self.ids, *self.spoken())

    def speaks(self, value: str, k: int) -> bool:
        """Whether an id or class names a part of a page, and neither a secret
        nor what the node says."""
        if _SECRET.search(value) or _UUID.fullmatch(value) or len(value) > 48 or sum(c.isdigit() for c in value) > 4 or not _PLAIN.fullmatch(value):
            return False
        if not any(w in PARTS or w.removesuffix("s") in PARTS for w in re.split(r"[-_]", value.casefold())):
            return False
        bare = re.sub(r"\W+", "", value).casefold()
        if len(bare) < 4:
            return True
        self.heard.append((bare, k, bare == _says(self.said, self.ids[k], self.ends[k])))
        return not self.heard[-1][2]

    def named(self, k: int) -> str | None:
        """By id, else by classes, where that is the page's only match."""
        own = self.own[k]
        if own and len(self.by_id[own]) == 1 and self.speaks(own, k):
            return f"#{own}"
        classes = [c for c in dict.fromkeys((self.classes[k] or "").split()) if self.speaks(c, k)]
        if classes and len(set.intersection(*[self.by_class[c] for c in classes])) == 1:
            return "." + ".".join(classes)
        return None

    def plainly_named(self, k: int) -> str | None:
        """By any id, else by tag and one class, where that is the page's only match."""
        own = self.own[k]
        if own and len(self.by_id[own]) == 1 and _PLAIN.fullmatch(own):
            return f"#{own}"
        for c in (self.classes[k] or "").split():
            if _PLAIN.fullmatch(c) and sum(self.tags[j] == self.tags[k] for j in self.by_class[c]) == 1:
                return f"{self.tags[k]}.{c}"
        return None

    def selectors(self, asked, plain: bool = False) -> dict[int, str]:
        """The selector of each asked node: its name, else the shortest path of
        steps upward that matches it alone; that to the root where none does.
        Paths in use grow by one step a round, and with each the nodes that it
        matches; those of one match are done."""
        out = {k: name for k in asked if (self.own[k] or self.classes[k]) and (name := self.plainly_named(k) if plain else self.named(k))}
        open_ = {k: (self.steps[k], self.up[k]) for k in asked if k not in out}  # path, and the next step's node
        used = {path for path, _ in open_.values()}
        met = defaultdict(list)  # of a path the nodes it matches, each with the node of the next step
        for k, tag in enumerate(self.tags):
            for path in {tag, f"{tag}:nth-of-type({self.positions[k]})"} & used:
                met[path].append((k, self.up[k]))
        while open_:
            longer, used = {}, set()
            for k, (path, up) in open_.items():
                if len(met[path]) == 1 or up is None:
                    out[k] = path
                else:
                    longer[k] = (f"{self.steps[up]} > {path}", self.up[up])
                    used.add(longer[k][0])
            grown, going = defaultdict(list), {path for k, (path, _) in open_.items() if k in longer}
            for path in going:
                for k, up in met[path]:
                    if up is not None:
                        for step in {self.tags[up], f"{self.tags[up]}:nth-of-type({self.positions[up]})"}:
                            if (far := f"{step} > {path}") in used:
                                grown[far].append((k, self.up[up]))
            open_, met = longer, grown
        return out


class Search:
    """The selectors of asked nodes by page, those of pages of one structure
    found once. Nodes, ids, classes and what is asked make a structure; where a
    search asked what nodes say, its selectors hold for pages that answer alike."""

    #: Nodes of the structures that are remembered, and of the largest of them.
    MOST, LARGEST = 300_000, 2_000

    def __init__(self, plain: bool = False):
        self.plain, self.known, self.size = plain, {}, 0

    def __call__(self, ids, parents, ends, tags, positions, own, classes, spoken, asked) -> dict[int, str]:
        small = len(ids) <= self.LARGEST
        key = small and tuple(map(tuple, (ids, parents, ends, tags, positions, own, classes, asked)))
        if small and key in self.known:
            found, heard = self.known[key]
            said = said_pieces(ids, *spoken()) if heard else []
            if all((bare == _says(said, ids[k], ends[k])) == same for bare, k, same in heard):
                return found
        page = _Page(ids, parents, ends, tags, positions, own, classes, spoken)
        found = page.selectors(asked, self.plain)
        if small:
            self.size += len(ids)
            if self.size > self.MOST:
                self.known, self.size = {}, len(ids)
            self.known[key] = (found, page.heard)
        return found


def _by_pages(batches, found):
    """found() of tables of whole pages, whose rows come one after another."""
    held: list = []  # the last page so far: it may go on
    for batch in batches:
        page = batch.column("page_id").to_numpy(zero_copy_only=False)
        cut = int(np.searchsorted(page, page[-1])) if len(page) else 0
        if cut or held and len(page) and held[-1].column("page_id")[-1].as_py() != page[0]:
            yield from found(pa.Table.from_batches([*held, batch.slice(0, cut)])).to_batches()
            held = []
        held.append(batch.slice(cut))
    if held:
        yield from found(pa.Table.from_batches(held)).to_batches()


def _selected(rows: pa.Table, asks: np.ndarray, search: Search) -> tuple[list[int], list[str]]:
    """Places of the asked rows of whole pages, and their selectors."""
    pages = rows.column("page_id").to_numpy(zero_copy_only=False)
    parts = [rows.column(c).to_pylist() for c in ("node_id", "parent_id", "end_id", "tag", "sibling_pos")]
    parts += [pc.map_lookup(rows.column("attrs"), pa.scalar(name), "first").to_pylist() for name in ("id", "class")]
    spoken = [rows.column(c) for c in ("own_text", "own_pieces")]
    chosen, said = [], []
    edges = [0, *(np.flatnonzero(pages[1:] != pages[:-1]) + 1).tolist(), len(pages)]
    for lo, hi in zip(edges, edges[1:]):
        wanted = np.flatnonzero(asks[lo:hi]).tolist()
        if wanted:
            texts = lambda lo=lo, hi=hi: [c.slice(lo, hi - lo).to_pylist() for c in spoken]
            of_page = search(*[p[lo:hi] for p in parts], texts, wanted)
            chosen += [lo + k for k in of_page]
            said += of_page.values()
    return chosen, said


def paths(nodes: DataFrame, of: DataFrame | None = None, plain: bool = False) -> DataFrame:
    """Adds selector to all nodes, or to those of `of` (page_id, node_id): `#id`
    or the class set where that speaks of the page's parts (plain: any id, or tag
    and class) and no other node matches it, else the shortest path of `tag:nth-of-type` steps that matches
    no other node. A page's nodes are searched together, as they came from one
    row; of two nodes that nothing tells apart (roots of a page without one)
    both have the path from the root."""
    columns, search = [*nodes.columns, "selector"], Search(plain)
    every = of is None
    asked = nodes.withColumn("_asked", F.lit(True if every else None).cast("boolean"))
    if not every:  # each asked node is named by a row behind its own
        asked = asked.unionByName(of.select("page_id", "node_id", F.lit(True).alias("_asked")), allowMissingColumns=True)

    def found(rows: pa.Table) -> pa.RecordBatch:
        """Whole pages, one after another."""
        ids = lambda name: rows.column(name).to_numpy(zero_copy_only=False)
        asks = np.ones(rows.num_rows, bool)
        if not every:
            marks = rows.column("_asked").is_valid().to_numpy(zero_copy_only=False)
            pages, numbers, at = ids("page_id"), ids("node_id"), np.cumsum(~marks) - 1
            rows = rows.filter(pa.array(~marks))
            asks, places = np.zeros(rows.num_rows, bool), at[marks]
            if rows.num_rows:
                places[places < 0] = 0
                asks[places[(ids("page_id")[places] == pages[marks]) & (ids("node_id")[places] == numbers[marks])]] = True
        pages = ids("page_id")
        wanted_pages = np.isin(pages, pages[asks])
        rows, asks, pages = rows.filter(pa.array(wanted_pages)), asks[wanted_pages], pages[wanted_pages]
        chosen, said = _selected(rows, asks, search)
        out = rows.take(pa.array(chosen, pa.int64())).drop_columns(["_asked"]).append_column("selector", pa.array(said, pa.string()))
        return out.select(columns).combine_chunks()

    shape = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in nodes.schema.fields)
    parts = int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # not fewer: few bytes are much work
    return asked.repartition(parts, F.xxhash64("page_id")).sortWithinPartitions("page_id", "node_id", "_asked").mapInArrow(lambda batches: _by_pages(batches, found), f"{shape}, selector string")


def laid_out(nodes: DataFrame, roots: Column, marked: DataFrame, sums: dict[str, Column], outside: dict[str, Column]) -> DataFrame:
    """Nodes of whole pages with their selector (see paths), the flag noise
    (whether a node lies in the subtree of one of `roots`, see covered), and of
    each subtree the totals of `sums`, those of `outside` without what is flagged
    and the number of nodes of `marked` (page_id, node_id). One pass in page
    order gives all of these: a subtree is a run of rows, so running sums and
    the greatest end met so far tell."""
    names, clean, width, search = [*sums, *outside], set(outside), len(nodes.columns), Search()
    given = nodes.withColumns({"_root": roots, "_mark": F.lit(None).cast("boolean")} | {f"_{n}": c.cast("long") for n, c in (sums | outside).items()})
    asked = given.unionByName(marked.select("page_id", "node_id", F.lit(True).alias("_mark")), allowMissingColumns=True)
    columns = [*nodes.columns, "selector", "noise", *names, "marks"]

    def found(rows: pa.Table) -> pa.RecordBatch:
        marks = rows.column("_mark").is_valid().to_numpy(zero_copy_only=False)
        owners = (np.cumsum(~marks) - 1)[marks]  # a mark comes behind its node
        rows = rows.filter(pa.array(~marks))
        numbers = lambda name: rows.column(name).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        here = np.arange(rows.num_rows)
        ends = here + numbers("end_id") - numbers("node_id")
        noise = np.maximum.accumulate(np.where(rows.column("_root").fill_null(False).to_numpy(zero_copy_only=False), ends, -1)) >= here if len(here) else np.zeros(0, bool)

        def total(own):
            running = np.cumsum(own)
            return pa.array(running[ends] - running + own)

        told = [total(np.where(noise & (n in clean), 0, numbers(f"_{n}"))) for n in names]
        told.append(total(np.bincount(owners, minlength=rows.num_rows).astype(np.int64)))
        chosen, said = _selected(rows, np.ones(rows.num_rows, bool), search)
        selectors = np.empty(rows.num_rows, object)
        selectors[chosen] = said
        for name, column in zip(columns[width:], (pa.array(selectors, pa.string()), pa.array(noise), *told)):
            rows = rows.append_column(name, column)
        return rows.select(columns).combine_chunks()

    shape = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in nodes.schema.fields] + ["selector string", "noise boolean", *[f"`{n}` long" for n in (*names, "marks")]])
    parts = int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # not fewer: few bytes are much work
    return asked.repartition(parts, F.xxhash64("page_id")).sortWithinPartitions("page_id", "node_id", "_mark").mapInArrow(lambda batches: _by_pages(batches, found), shape)


def fingerprints(nodes: DataFrame, salt: str, counts: DataFrame | None = None) -> DataFrame:
    """(page_id, digest): a keyed hash of the noise-free tree of tag and role
    buckets with, if given, selector match counts (page_id, name, matches).
    Texts do not enter it; another salt gives another digest."""
    clean = denoised(nodes, F.coalesce(attr("class"), F.lit("")).rlike(NOISE_TOKEN))
    tag = F.when(F.col("tag").isin(*TAG_BUCKETS), F.col("tag")).otherwise("other")
    role = F.when(F.lower(attr("role")).isin(*ROLE_BUCKETS), F.lower(attr("role"))).otherwise("none")
    shape = F.concat_ws("/", F.col("depth").cast("string"), tag, role)
    tree = clean.groupBy("page_id").agg(F.array_join(F.array_sort(F.collect_list(F.struct("node_id", shape.alias("s"))))["s"], ",").alias("tree"))
    if counts is not None:
        said = F.concat_ws("=", "name", F.col("matches").cast("string"))
        tree = tree.join(counts.groupBy("page_id").agg(F.array_join(F.array_sort(F.collect_list(said)), ",").alias("matched")), "page_id", "left")
    else:
        tree = tree.withColumn("matched", F.lit(""))
    inner = F.sha2(F.concat(F.lit(salt + "|i|"), "tree", F.lit("|"), F.coalesce("matched", F.lit(""))), 256)
    return tree.select("page_id", F.sha2(F.concat(F.lit(salt + "|o|"), inner), 256).alias("digest"))
