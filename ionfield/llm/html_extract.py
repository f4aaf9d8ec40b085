"""Main-text extraction with a site style tree.

Every page is parsed into a light DOM.  The DOMs of a host are merged by style path (block tags with their
classes); a style node is kept as counts, never as pages: on how many pages each sequence of child tags
(presentation) and each own text (content) occurs under it.  Pages with the same text count as one, so copies
don't make an article a template.  With m pages at a path,

* presentation importance is the entropy of its sequences to base m, content importance of a text on n of them
  is 1 - log n / log m; both are drawn towards 1 by ``PRIOR_PAGES`` pages, which is all that hosts with few pages
  have to go by: one rule for every size;
* composite importance is (1 - g^l) * presentation + g^l * mean over child nodes and own text, with l sequences.

Tags, roles and names are priors on these figures, weights that a branch hands down: menus, headers, footers,
sidebars, notices, adverts, forms and comments ``LOW``; names of which only a part says so ``DOUBTFUL``, outside
of articles; what is beside an article that holds a third of the page's text or more ``BESIDE``.  Plain paragraphs,
headings, lists and tables in articles, and beside a kept text of five words, are drawn half-way towards 1.  A text goes below
``LEAST_IMPORTANCE``; a branch goes below ``LEAST_BRANCH``, unless it holds a kept branch or text of five words.  An article
that would lose over half of its text stays whole, as does a page that would lose all.  Scripts, styles, the head
and form controls are no text at all.

Defined results: null or empty html gives an empty text; null urls form one host; null page_ids and repeated
rows are kept; unclosed elements end where their parent does; an empty table gives an empty result; other
columns are ignored; texts of any length are extracted whole.
"""

from __future__ import annotations

import html as entities
import re

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import materialize, ship_package
from .token_counts import Shared

LEAST_IMPORTANCE, LEAST_BRANCH = 0.5, 0.7
LOW, BESIDE, DOUBTFUL = 0.25, 0.4, 0.6
PRIOR_PAGES = 4
DAMPING = 0.9
MAIN_SHARE = 1 / 3
SENTENCE_WORDS = 5
#: Style tree rows up to which the tree is broadcast (about 100 bytes each).
BROADCAST_NODES = 200_000

# The format's void, raw-text and block elements.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style textarea title xmp iframe noembed noframes".split())
BLOCK = set("address article aside blockquote body br button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre section select summary table tbody td tfoot th thead title tr ul".split())
# What is no text, what says boilerplate, words that go with it, and an article's plain text.
NEVER = set("head script style noscript template button select textarea input iframe svg canvas object embed title".split())
LOW_TAGS = set("nav footer aside dialog menu".split())
LOW_ROLES = set("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
COMMENT_NAMES = set("comment comments commentlist disqus replies reply respond".split())
LOW_NAMES = COMMENT_NAMES | set("ad ads adv advert adverts advertisement advertising adsense adslot banner banners breadcrumb breadcrumbs consent cookie cookies disclaimer footer gdpr header masthead menu menus modal nav navbar navigation newsletter notice notices notification pager pagination popup promo promoted promotion promotions related share sharing sidebar sidebars signup skip social sponsor sponsored sponsors subscribe subscription toolbar topbar widget widgets".split())
WITH_NAMES = set("site page main top bottom left right user users reader readers section list box container wrap wrapper bar block area inner links primary secondary global sticky fixed unit slot item items thread form".split())
NOT_NAMES = set("has no with without not".split())
FLOW = set("p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd blockquote pre table thead tbody tr td th figure figcaption hgroup".split())
# An end tag of the first kind or a start tag closes open elements of the second.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SCOPES = set("article aside body dialog div fieldset figure footer form header html main nav section table td th ul ol dl blockquote".split())

_MARKUP = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*+)>|<[!?][^>]*+>", re.S)
_ATTRIBUTE = re.compile(r"""([a-zA-Z_:][-\w:.]*)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""")
_NAME = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")
_NAMED = ("class", "id", "role")


class Node:
    __slots__ = ("children", "classed", "holds_main", "inner", "label", "main", "named", "own", "path", "size", "tag", "parent", "weight")

    def __init__(self, tag: str, parent, label: str, named: int, main: bool):
        self.tag, self.parent, self.label, self.named, self.main = tag, parent, label, named, main
        self.children: list = []


def _named(value: str) -> int:
    """What a class or id says: 3 comments, 2 boilerplate, 1 boilerplate in part, 0 nothing."""
    found = 0
    for word in value.split():
        if word.lower() in LOW_NAMES:
            found = max(found, 3 if word.lower() in COMMENT_NAMES else 2)
            continue
        parts = [x.lower() for x in _NAME.findall(word)]
        if not parts or parts[0] in NOT_NAMES or not any(x in LOW_NAMES for x in parts):
            continue
        whole = all(x in LOW_NAMES or x in WITH_NAMES for x in parts)
        found = max(found, 1 if not whole else 3 if any(x in COMMENT_NAMES for x in parts) else 2)
    return found


def _says(tag: str, attributes: str) -> tuple[str, int, bool, bool]:
    """The element's style label, what its names say, whether it is an article or main element, and has a class."""
    named = 3 if tag in LOW_TAGS else 2 if tag in ("form", "header") else 0
    if "=" not in attributes:
        return tag, named, tag in ("article", "main"), False
    given = {m[0].lower(): m[1] or m[2] or m[3] for m in _ATTRIBUTE.findall(attributes) if m[0].lower() in _NAMED}
    role, style, ident = given.get("role", "").strip().lower(), given.get("class", ""), given.get("id", "")
    if tag not in ("html", "body"):
        named = max(named, _named(style), _named(ident), 2 if role in LOW_ROLES else 0)
    return f"{tag}.{style}" if style else tag, named, tag in ("article", "main") or role in ("main", "article"), bool(style or ident)


def parse(page: str) -> Node:
    """The page's elements and texts as a tree; children are nodes, strings and None for a line break."""
    root = here = Node("", None, "", 0, False)
    root.classed = False
    at, n = 0, len(page)
    find = _MARKUP.search
    while at < n:
        m = find(page, at)
        if m is None:
            here.children.append(page[at:])
            break
        if m.start() > at:
            here.children.append(page[at : m.start()])
        at = m.end()
        tag = m[2] or m[5]
        if tag is None:
            continue
        tag = tag.lower()
        if m[1] or m[4]:
            node = here
            while node is not None and node.tag != tag:
                if node.tag in SCOPES and tag not in SCOPES:
                    node = None  # an end tag inside a box doesn't close what is outside
                    break
                node = node.parent
            if node is not None and node.parent is not None:
                here = node.parent
            elif tag in ("br", "p"):
                here.children.append(None)
            continue
        attributes = m[3] if m[2] else m[6]
        if tag in BLOCK and tag != "br":
            here = _close(here, {"p"} | CLOSES.get(tag, set()))
        if tag == "br" or tag == "hr":
            here.children.append(None)
            continue
        if tag in VOID:
            continue
        label, named, main, classed = _says(tag, attributes)
        node = Node(tag, here, label, named, main and named < 2)
        node.classed = classed
        here.children.append(node)
        if tag in RAW:
            end = re.compile(f"</{tag}", re.I).search(page, at)
            stop = n if end is None else end.start()
            if tag == "xmp":
                node.children.append(page[at:stop])
            close = page.find(">", stop)
            at = n if end is None or close < 0 else close + 1
        elif not attributes.endswith("/") or tag not in ("svg",):
            here = node
    return root


def _close(here: Node, tags: set[str]) -> Node:
    """Ends the innermost open element of ``tags`` that no box lies between."""
    node = here
    while node.parent is not None:
        if node.tag in tags:
            return node.parent
        if node.tag in SCOPES:
            return here
        node = node.parent
    return here


def _styled(root: Node) -> list[Node]:
    """The style nodes (blocks, and elements whose names say something), parents first, with own texts, paths,
    sizes in characters and weights."""
    root.path, root.own, root.inner = 0, [], []
    nodes, stack = [root], [(root, iter(root.children))]
    while stack:
        owner, children = stack[-1]
        for child in children:
            if child is None:
                owner.own.append(" ")
            elif isinstance(child, str):
                owner.own.append(child)
            elif child.tag in NEVER:
                continue
            elif child.tag in BLOCK or child.named:
                child.path, child.own, child.inner = xxhash.xxh64_intdigest(child.label, owner.path), [], []
                owner.inner.append(child)
                nodes.append(child)
                stack.append((child, iter(child.children)))
                break
            else:
                stack.append((owner, iter(child.children)))
                break
        else:
            stack.pop()
    for node in reversed(nodes):
        node.own = " ".join("".join(node.own).split())
        node.size = len(node.own) + sum(c.size for c in node.inner)
        node.holds_main = any((c.main or c.holds_main) and c.named < 3 for c in node.inner)
    root.weight = 1.0
    for node in nodes:  # parents first: from here on main means inside an article, too
        for c in node.inner:
            boilerplate = c.named == 3 or (c.named == 2 and not c.holds_main and not (c.tag == "header" and node.main and not c.classed))
            part = c.named == 1 and not node.main and not c.holds_main
            c.weight = min(node.weight, LOW if boilerplate else DOUBTFUL if part else 1.0)
            c.main = (c.main and c.weight >= LEAST_IMPORTANCE) or node.main
    return nodes


def _tops(nodes: list[Node]) -> list[Node]:
    """Outermost articles and main elements."""
    return [c for n in nodes if not n.main for c in n.inner if c.main]


def _weigh(nodes: list[Node]) -> None:
    """Lowers what is beside articles that hold enough of the page."""
    kept = {False: 0, True: 0}
    for node in nodes:
        if node.weight >= LEAST_IMPORTANCE:
            kept[node.main] += len(node.own)
    if kept[True] and kept[True] >= MAIN_SHARE * (kept[True] + kept[False]):
        for node in nodes:
            if not node.main:
                node.weight = min(node.weight, BESIDE)


def _hash(text: str) -> int:
    return xxhash.xxh64_intdigest(text) - (1 << 63)


def removals(nodes: list[Node], importance: dict) -> tuple[set[Node], set[Node]]:
    """(branches that go, nodes whose own text goes); importance maps (path, own text's hash) and (path, None)
    to (importance, sequences)."""
    gone, mute, figure = set(), set(), {}
    owns = {n: importance.get((n.path, _hash(n.own)), (1.0, 1))[0] if importance else 1.0 for n in nodes if n.own}
    speaks = {n for n, own in owns.items() if own * n.weight >= LEAST_IMPORTANCE and n.own.count(" ") + 1 >= SENTENCE_WORDS}
    beside = {c for n in nodes if any(c in speaks for c in n.inner) for c in n.inner}
    for node in reversed(nodes):  # children before parents
        parts = [figure[c] for c in node.inner if c in figure]
        plain = (node.main or node in beside) and not node.classed and node.tag in FLOW
        if node.own:
            own = 1 - (1 - owns[node]) / 2 if plain else owns[node]
            parts.append(own)
            if own * node.weight < LEAST_IMPORTANCE:
                mute.add(node)
        if not parts:
            continue
        mean = sum(parts) / len(parts)
        if len(parts) > 1 or not node.own:
            presentation, n = importance.get((node.path, None), (1.0, 1)) if importance else (1.0, 1)
            g = DAMPING**n
            mean = (1 - g) * presentation + g * mean
            mean = 1 - (1 - mean) / 2 if plain else mean
            if not node.inner or any(c in speaks for c in node.inner):
                speaks.add(node)
            if node in speaks or node.main or node.tag in ("", "html", "body"):
                pass
            elif mean * node.weight < LEAST_BRANCH and all(c in gone for c in node.inner if c.inner):
                gone.add(node)
        figure[node] = mean
    for top in _tops(nodes):  # its texts: all come back where over half would go
        inside = [top]
        for node in inside:
            inside += node.inner
        clean = [n for n in inside if n.weight >= LEAST_IMPORTANCE]
        if 2 * sum(len(n.own) for n in clean if n in mute) > sum(len(n.own) for n in clean):
            mute.difference_update(clean)
    return gone, mute


def blocks(root: Node, gone=frozenset(), mute=frozenset()) -> list[str]:
    """Texts of the kept branches, a string per block."""
    out: list[str] = []
    line: list[str] = []

    def flush():
        text = " ".join(entities.unescape("".join(line)).split()) if line else ""
        line.clear()
        if text:
            out.append(text)

    # None ends a block; an explicit stack, as pages may nest deeply.
    stack: list = [(iter(root.children), True, root in mute)]
    while stack:
        children, block, silent = stack[-1]
        child = next(children, stack)
        if child is stack:
            stack.pop()
            if block:
                flush()
        elif child is None:
            flush()
        elif isinstance(child, str):
            if not silent:
                line.append(child)
        else:
            block = child.tag in BLOCK
            if block:
                flush()
            if child.tag not in NEVER and child not in gone:
                stack.append((iter(child.children), block, child in mute if block or child.named else silent))
    return out


def host_of(url: str | None) -> str:
    return (url or "").split("://", 1)[-1].split("/", 1)[0].split("?", 1)[0].lower()


def style_rows(page: str | None) -> list[tuple]:
    """(path, sequence, own text or None, page's text) hashes of a page's style nodes that no name lowers."""
    nodes = _styled(parse(page or ""))
    kept = [n for n in nodes[1:] if n.weight >= LEAST_IMPORTANCE]
    text = _hash("\n".join(n.own for n in kept if n.own))
    return [(n.path - (1 << 63), _hash(",".join(c.label for c in n.inner)), _hash(n.own) if n.own else None, text) for n in kept]


def extract(page: str | None, importance: dict | None = None) -> str:
    """The page's main text under the host's importances (see ``removals``)."""
    root = parse(page or "")
    nodes = _styled(root)
    _weigh(nodes)
    gone, mute = removals(nodes, importance or {})
    out = blocks(root, gone, mute)
    if not out and importance:
        out = blocks(root, *removals(nodes, {}))
    return "\n".join(out)


def _styles(batches):
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            part = batch.slice(at, 256)
            rows = [(host_of(u), *r) for u, h in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True) for r in set(style_rows(h))]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), *(pa.array([r[i] for r in rows], pa.int64()) for i in (1, 2, 3, 4))], names=["host", "path", "sequence", "own", "page"])


def style_tree(pages: DataFrame) -> DataFrame:
    """(host, path, value, importance, sequences): a row with value null per style node on two pages or more, and
    a row per own text found on two pages or more.  Counts are pre-aggregated before each shuffle; a page is in
    the grouping key, so no host is one group."""
    ship_package(pages.sparkSession)
    rows = pages.select("url", "html").mapInArrow(_styles, "host string, path long, sequence long, own long, page long")
    kinds = F.array(F.struct(F.lit(False).alias("text"), F.col("sequence").alias("value")), F.struct(F.lit(True).alias("text"), F.col("own").alias("value")))
    each = rows.select("host", "path", "page", F.explode(kinds).alias("v")).select("host", "path", "page", "v.*").where("value is not null").distinct()
    counts = each.groupBy("host", "path", "text", "value").agg(F.count("*").alias("n"))
    sequence = F.when(~F.col("text"), F.col("n"))
    nodes = counts.groupBy("host", "path").agg(F.sum(sequence).alias("m"), F.sum(sequence * F.log("n")).alias("a"), F.count(sequence).alias("sequences")).where("m > 1")
    drawn = lambda x: (F.col("m") * x + PRIOR_PAGES) / (F.col("m") + PRIOR_PAGES)
    presentation = nodes.select("host", "path", F.lit(None).cast("long").alias("value"), drawn(1 - F.col("a") / (F.col("m") * F.log("m"))).alias("importance"), "sequences")
    texts = counts.where("text and n > 1").join(nodes.select("host", "path", "m"), ["host", "path"])
    return presentation.unionByName(texts.select("host", "path", "value", drawn(F.greatest(1 - F.log("n") / F.log("m"), F.lit(0.0))).alias("importance"), F.lit(1).cast("long").alias("sequences")))


def _out(ids, urls, texts):
    return pa.RecordBatch.from_arrays([ids, urls, pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])


def _lookup(rows) -> dict:
    return {(r["path"] + (1 << 63), r["value"]): (r["importance"], r["sequences"]) for r in rows}


def _extract_broadcast(shared):
    def run(batches):
        trees = shared.value
        for batch in batches:
            yield _out(batch.column(0), batch.column(1), [extract(h, trees.get(host_of(u))) for u, h in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)])

    return run


def _keys(batches):
    for batch in batches:
        rows = []
        for row, url, html in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            host = host_of(url)
            for path, value in {(r[0], v) for r in style_rows(html) for v in (None, r[2])}:
                rows.append((row, host, path, value))
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int64(), pa.string(), pa.int64(), pa.int64()))], names=["row", "host", "path", "value"])


def _extract_joined(batches):
    for batch in batches:
        yield _out(batch.column(0), batch.column(1), [extract(h, _lookup(x or [])) for h, x in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)])


def extract_main_text(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) of every row of pages (page_id, url, html).

    A tree of bounded size is broadcast.  Beyond that each page's own style nodes are looked up by a join: the
    tree's keys are unique, so adaptive execution can split a hot host, and what comes together is one page's."""
    spark = pages.sparkSession
    ship_package(spark)
    tree = materialize(style_tree(pages), "style_tree")
    schema = f"page_id {pages.schema['page_id'].dataType.simpleString()}, url string, text string, n_chars long"
    pages = pages.select("page_id", "url", "html")
    if tree.count() <= BROADCAST_NODES:
        hosts: dict[str, list] = {}
        for r in tree.collect():
            hosts.setdefault(r["host"], []).append(r)
        return pages.mapInArrow(_extract_broadcast(Shared(spark, {k: _lookup(v) for k, v in hosts.items()})), schema)
    pages = materialize(pages.withColumn("row", F.monotonically_increasing_id()), "pages")
    keys = pages.select("row", "url", "html").mapInArrow(_keys, "row long, host string, path long, value long")
    found = keys.alias("k").join(tree.alias("t"), F.expr("k.host = t.host and k.path = t.path and k.value <=> t.value"))
    per_page = found.groupBy("k.row").agg(F.collect_list(F.struct("t.path", "t.value", "t.importance", "t.sequences")).alias("x"))
    return pages.join(per_page, "row", "left").select("page_id", "url", "html", "x").mapInArrow(_extract_joined, schema)
