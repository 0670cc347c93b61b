"""2 HTML extraction by wrapper induction.

Pages become trees of block elements; neighbouring siblings of one kind are one repeated node. Trees of a host's pages are aligned
by simple tree matching (the largest order-preserving match of children with equal labels, top down) and merged into the
host's template tree, which counts for each node the pages that have it and whether its text was the same in all of them. All
pages take part: each task folds its own pages into one tree per host, and trees of a host are merged in two rounds, so
that no task meets more than about the square root of all trees. A page is then aligned with its host's template. Beside that,
pages are counted for each text of each slot of a host (a slot is known by its path from the root), so that what a large
host's template says is not lost when single pages differ or the tree is pruned: exact copies of a page count once, and
pages cut off within a slot count for its text only if they have it whole. Nodes with one text in at least ``support`` pages,
in all of them or in a ``share`` of the counted ones, on a host whose other slots vary, are template; so is what stands in navigation,
header, footer, aside, form, script and similar elements, or in elements whose whole class or role says so; parts of names and ids
say so for elements that are mostly links, and outside of article and main, but ids of headings and sections don't. Of the varying
slots the article element (or main) holds the content where there is one with a fair part of the text; else those that aren't mostly links.

Defined results: null or empty html gives empty text; a page cut off anywhere is read as far as it goes; a page without a url or
host belongs to the host ""; repeated rows give equal results; hosts whose pages are all the same lose nothing to the
template; elements nested more than ``DEPTH`` levels deep count as part of the one at that level; white space in a block becomes one space, blocks are joined by one line feed; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import html as entities
import json
import re

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evenhand.llm.common import skew_safe_join, slices, written

# Element names of HTML.
RAW = {"script", "style", "textarea", "title", "noscript", "template", "iframe", "xmp"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
BLOCKS = {
    "html", "head", "body", "address", "article", "aside", "blockquote", "caption", "center", "dd", "details", "dialog", "dir", "div", "dl", "dt", "fieldset", "figcaption", "figure", "footer", "form",
    "h1", "h2", "h3", "h4", "h5", "h6", "header", "hgroup", "hr", "legend", "li", "main", "menu", "nav", "ol", "p", "pre", "section", "select", "summary", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul",
}
# An element of the first kind ends an open one of the second kinds.
ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "tbody": {"tr", "td", "th", "thead"}, "tfoot": {"tr", "td", "th", "tbody"}}
SCOPE = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table", "tr"}, "th": {"table", "tr"}, "tbody": {"table"}, "tfoot": {"table"}, "option": {"select"}}
ASIDE = {"nav", "header", "footer", "aside", "form", "menu", "dialog", "select", "button", "head", "svg", "canvas", "object"}
# Words of class, id or role that say what an element is for.
ASIDE_WORDS = {
    "ad", "ads", "advert", "adverts", "advertisement", "advertising", "banner", "breadcrumb", "breadcrumbs", "comment", "comments", "complementary", "consent", "contentinfo", "cookie", "cookies", "disqus", "footer", "form", "gdpr",
    "header", "login", "masthead", "menu", "modal", "nav", "navbar", "navigation", "newsletter", "notice", "overlay", "pagination", "popup", "promo", "related", "replies", "reply", "search", "share", "sharing", "sidebar", "signup",
    "skip", "social", "sponsor", "sponsored", "subscribe", "toolbar", "widget",
}
# Elements whose ids are often made of their text.
BY_TEXT = {"h1", "h2", "h3", "h4", "h5", "h6", "section"}
# When an element that has such a name is left out: if it is mostly links; that, or outside of article and main; always (the element's kind, or a whole class or role).
BY_LINKS, OUTSIDE, ALWAYS = 1, 2, 3
TAG = re.compile(r"<(?:!--.*?(?:-->|$)|!\[CDATA\[.*?(?:\]\]>|$)|[!?][^>]*(?:>|$)|(/?)([a-zA-Z][^\s/>]*)((?:[^<>\"']|\"[^\"]*\"|'[^']*')*)>)", re.S)
NAMED = re.compile(r"(?:^|\s)(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
SPACE = re.compile(r"\s+")
DEPTH = 200  # levels of elements; what is nested deeper belongs to the element at that level


class Node:
    """A block element. runs: its child nodes, and texts as (text, letters within links). open: whether the page may end within it or its row of siblings."""

    __slots__ = ("tag", "label", "aside", "runs", "slot", "open")

    def __init__(self, tag: str, label: str, aside: int):
        self.tag, self.label, self.aside, self.runs, self.slot, self.open = tag, label, aside, [], None, False


def node_of(tag: str, attributes: str) -> Node:
    named = [(m[1].lower(), (m[2] or m[3] or m[4] or "").lower()) for m in NAMED.finditer(attributes)] if "=" in attributes else []
    parts = [(k, w) for k, value in named for w in re.split(r"[\s_\-]+", value) if w]
    said = {k for k, w in parts if w in ASIDE_WORDS}
    if tag in ASIDE or any(k != "id" and w in ASIDE_WORDS for k, value in named for w in value.split()):
        aside = ALWAYS
    elif said == {"id"} and tag in BY_TEXT:
        aside = 0 if tag != "section" else BY_LINKS
    else:
        aside = OUTSIDE if said else 0
    return Node(tag, " ".join([tag, *sorted({w for _, w in parts})]), aside)


def parse(html: str) -> Node:
    root = Node("", "", 0)
    stack, inline, links, text, linked = [root], [], 0, [], 0

    def flush():
        nonlocal text, linked
        if text:
            joined = "".join(text)
            if joined and not joined.isspace():
                stack[-1].runs.append((joined, linked))
            text, linked = [], 0

    def leave(depth: int):
        nonlocal inline, links
        flush()
        del stack[depth:]
        inline = [x for x in inline if x[1] <= len(stack)]
        links = sum(x[0] == "a" for x in inline)

    def push(n: Node):
        if len(stack) <= DEPTH:
            stack[-1].runs.append(n)
        else:
            n.runs = stack[-1].runs
        stack.append(n)

    at = 0
    for_end = len(html)
    while at < for_end:
        m = TAG.search(html, at)
        piece = html[at : m.start()] if m else html[at:]
        if piece:
            if m is None and (cut := piece.rfind("<")) >= 0 and re.match(r"<[a-zA-Z/!]", piece[cut:]):
                piece = piece[:cut]  # the page ends within a tag
            piece = entities.unescape(piece) if "&" in piece else piece
            text.append(piece)
            linked += len(piece) if links else 0
        if m is None:
            break
        at = m.end()
        if m[2] is None:
            continue
        tag = m[2].lower()
        if m[1]:
            if tag in BLOCKS:
                depth = next((i for i in range(len(stack) - 1, 0, -1) if stack[i].tag == tag), 0)
                if depth:
                    leave(depth)
            elif tag not in VOID:
                k = next((i for i in range(len(inline) - 1, -1, -1) if inline[i][0] == tag), -1)
                if k >= 0:
                    if inline[k][2] is not None and inline[k][2] in stack:
                        leave(stack.index(inline[k][2]))
                    inline = [x for i, x in enumerate(inline) if i != k]
                    links = sum(x[0] == "a" for x in inline)
            continue
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}\b[^>]*(?:>|$)", re.I).search(html, at)
            at = end.end() if end else for_end
            continue
        if tag == "br":
            text.append(" ")
        if tag in VOID and tag != "hr":
            continue
        if tag in BLOCKS:
            if stack[-1].tag == "p" or any(n.tag == "p" for n in stack):
                depth = next((i for i in range(len(stack) - 1, 0, -1) if stack[i].tag == "p"), 0)
                leave(depth)
            if tag in ENDS:
                for i in range(len(stack) - 1, 0, -1):
                    if stack[i].tag in SCOPE.get(tag, ()):
                        break
                    if stack[i].tag in ENDS[tag]:
                        leave(i)
                        break
            flush()
            if tag != "hr":
                push(node_of(tag, m[3]))
        elif not m[3].endswith("/"):
            n = node_of(tag, m[3]) if tag in ASIDE or "=" in m[3] else None
            own = None
            if n is not None and n.aside == ALWAYS:  # an inline element with a purpose of its own stands apart
                flush()
                push(n)
                own = n
            inline.append((tag, len(stack), own))
            links += tag == "a"
    ends = len(stack) > 1
    leave(1)
    n = root if ends else None
    while n is not None:
        n.open = True
        n = next((r for r in reversed(n.runs) if not isinstance(r, tuple)), None)
    return root


def clean(text: str) -> str:
    return SPACE.sub(" ", text).strip()


# A slot (template node) is [label, pages, digest of its text ("" without text, None if it varies), children].


def slots(node: Node) -> list:
    """The page as a tree of slots: neighbouring siblings with one label share a slot; nodes keep the slot they fell into."""
    made: dict[int, list] = {}

    def gather(nodes: list[Node], label: str) -> list:
        text = hashlib.md5(usedforsecurity=False)
        some, children, group = False, [], []
        for n in nodes:
            for r in n.runs:
                if isinstance(r, tuple):
                    text.update(clean(r[0]).encode("utf-8", "replace"))
                    some = True
                elif group and group[-1][0].label == r.label:
                    group[-1].append(r)
                else:
                    group.append([r])
        for same in group:
            children.append(gather(same, same[0].label))
        slot = [label, 1, text.hexdigest()[:16] if some else "", children]
        for n in nodes:
            n.slot = slot
        made[id(slot)] = slot
        return slot

    return gather([node], node.label)


def places(root: Node) -> list[tuple[int, str, bool, list]]:
    """(path, digest, open, slot) of the slots with text of a page that slots() has seen. A path is the hash of the labels from the root, each with its number among siblings of one label."""
    opened, n = set(), root if root.open else None
    while n is not None:
        opened.add(id(n.slot))
        n = next((r for r in reversed(n.runs) if not isinstance(r, tuple)), None)
    out, todo = [], [(root.slot, 0)]
    while todo:
        slot, path = todo.pop()
        if slot[2]:
            out.append((path, slot[2], id(slot) in opened, slot))
        before: dict[str, int] = {}
        for c in slot[3]:
            k = before[c[0]] = before.get(c[0], -1) + 1
            todo.append((c, (xxhash.xxh3_64_intdigest(f"{path}/{c[0]}#{k}".encode("utf-8", "replace"))) >> 1))
    return out


def tree_match(a: list, b: list) -> tuple[int, list[tuple[int, int]]]:
    """Simple tree matching of two slots with one label: the number of matched slots, and the matched pairs of children."""
    x, y = a[3], b[3]
    if not x or not y:
        return 1, []
    if len(x) == len(y) and all(p[0] == q[0] for p, q in zip(x, y, strict=True)):
        return 1 + sum(tree_match(p, q)[0] for p, q in zip(x, y, strict=True)), [(i, i) for i in range(len(x))]
    best = [[0] * (len(y) + 1) for _ in range(len(x) + 1)]
    own = {}
    for i, p in enumerate(x):
        for j, q in enumerate(y):
            w = own[i, j] = tree_match(p, q)[0] if p[0] == q[0] else 0
            best[i + 1][j + 1] = max(best[i][j + 1], best[i + 1][j], best[i][j] + w)
    pairs, i, j = [], len(x), len(y)
    while i and j:
        if best[i][j] == best[i - 1][j]:
            i -= 1
        elif best[i][j] == best[i][j - 1]:
            j -= 1
        else:
            i, j = i - 1, j - 1
            if own[i, j]:
                pairs.append((i, j))
    return 1 + best[-1][-1], pairs[::-1]


def merge(a: list, b: list) -> list:
    """The slots of both trees: matched ones once, others where they stand."""
    _, pairs = tree_match(a, b)
    children, i, j = [], 0, 0
    for p, q in [*pairs, (len(a[3]), len(b[3]))]:
        children += a[3][i:p] + b[3][j:q]
        if p < len(a[3]) and q < len(b[3]):
            children.append(merge(a[3][p], b[3][q]))
        i, j = p + 1, q + 1
    text = a[2] if a[2] == b[2] else b[2] if a[2] == "" else a[2] if b[2] == "" else None
    return [a[0], a[1] + b[1], text, children]


def count(slot: list) -> int:
    return 1 + sum(map(count, slot[3]))


def pruned(slot: list) -> list:
    """Without slots that a single page has, so that a tree stays small; what they say is still counted in template_texts()."""
    return [*slot[:3], [pruned(c) for c in slot[3] if c[1] > 1]]


def fold(a: list | None, b: list, most: int) -> list:
    out = merge(a, b) if a is not None else b
    return pruned(out) if count(out) > most else out


def varies(slot: list) -> bool:
    return slot[2] is None or any(map(varies, slot[3]))


def constant_slots(template: list, page: list, support: int, found: set[int]) -> set[int]:
    """ids of the page's slots whose text is part of the template."""
    if template[1] >= support and template[2] and template[2] == page[2]:
        found.add(id(page))
    for i, j in tree_match(template, page)[1]:
        constant_slots(template[3][i], page[3][j], support, found)
    return found


def letters(n: Node) -> tuple[int, int]:
    """Letters of an element, and those within links."""
    pairs = [(len(r[0]), r[1]) if isinstance(r, tuple) else letters(r) for r in n.runs]
    return sum(p[0] for p in pairs), sum(p[1] for p in pairs)


def mostly_links(n: Node) -> bool:
    total, linked = letters(n)
    return linked * 2 > total


def content(html: str | None, template: list | None, support: int, texts: frozenset[str] = frozenset()) -> str:
    """The main text of a page; ``texts`` are the counted template texts of its host, as path:digest."""
    if not html:
        return ""
    root = parse(html)
    tree = slots(root)
    constant = constant_slots(template, tree, support, set()) if template is not None and varies(template) else set()
    if texts:
        constant |= {id(slot) for path, digest, _, slot in places(root) if f"{path}:{digest}" in texts}
    blocks: list[tuple[str, int, str]] = []

    def walk(n: Node, region: str):
        region = n.tag if n.tag == "article" or (n.tag == "main" and region != "article") or "main" in n.label.split()[1:] and not region else region
        if n.aside == ALWAYS or n.aside == OUTSIDE and not region or n.aside and mostly_links(n):
            return
        for r in n.runs:
            if not isinstance(r, tuple):
                walk(r, region)
            elif id(n.slot) not in constant and (t := clean(r[0])):
                blocks.append((t, r[1], region))

    walk(root, "")
    # the region that holds a fair part of what is around it: an article that is a teaser only doesn't
    size = {x: sum(len(t) for t, linked, region in blocks if region == x and (x or linked * 2 <= len(t))) for x in {b[2] for b in blocks}}
    article, inside, whole = size.get("article", 0), sum(n for x, n in size.items() if x), sum(size.values())
    want = "article" if article and article * 2 >= inside and article * 3 >= whole else "main" if inside and inside * 3 >= whole else None
    if want:
        return "\n".join(t for t, _, region in blocks if region == want or want == "main" and region)
    return "\n".join(t for t, linked, _ in blocks if linked * 2 <= len(t))


def host(url: str = "url") -> Column:
    return F.coalesce(F.lower(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1)), F.lit(""))


SEEN = "host string, salt bigint, template string, path bigint, text string, open boolean, copy bigint"


def seen(pages: DataFrame, most_hosts: int = 2000, most_slots: int = 4000) -> DataFrame:
    """One pass over all pages, as a written table: trees (host, salt, template) of each task's pages, and each page's slots with text (host, path, text, open, copy).

    A task keeps at most ``most_hosts`` trees, and writes them out when there are more."""
    rows = pages.select(host().alias("host"), "html").where("html is not null")
    names = ["host", "salt", "template", "path", "text", "open", "copy"]

    def batch_of(trees: dict[str, list], salt: int) -> pa.RecordBatch:
        n = len(trees)
        return pa.RecordBatch.from_arrays([pa.array(list(trees), pa.string()), pa.array([salt] * n, pa.int64()), pa.array([json.dumps(t) for t in trees.values()], pa.string()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.string()), pa.nulls(n, pa.bool_()), pa.nulls(n, pa.int64())], names=names)

    def grow(batches):
        from pyspark import TaskContext

        trees: dict[str, list] = {}
        salt = TaskContext.get().partitionId()
        for batch in slices(batches, "html"):
            hosts, copy, found = [], [], []
            for h, page in zip(batch.column("host").to_pylist(), batch.column("html").to_pylist(), strict=True):
                root = parse(page)
                tree = slots(root)
                got = places(root)
                hosts += [h] * len(got)
                copy += [xxhash.xxh3_64_intdigest(page.encode("utf-8", "replace")) >> 1] * len(got)
                found += got
                trees[h] = fold(trees.get(h), tree, most_slots)
            n = len(found)
            yield pa.RecordBatch.from_arrays(
                [pa.array(hosts, pa.string()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.string()), pa.array([f[0] for f in found], pa.int64()), pa.array([f[1] for f in found], pa.string()), pa.array([f[2] for f in found], pa.bool_()), pa.array(copy, pa.int64())],
                names=names,
            )
            if len(trees) > most_hosts:
                yield batch_of(trees, salt)
                trees = {}
        yield batch_of(trees, salt)

    return written(rows.mapInArrow(grow, SEEN), "seen_pages")


def templates(found: DataFrame, most_slots: int = 4000) -> DataFrame:
    """host, pages (their number) and template of every host, from the trees of seen()."""
    names = ["host", "salt", "template"]

    def join(table: pa.Table) -> pa.Table:
        out = None
        for t in sorted(table.column("template").to_pylist()):
            out = fold(out, json.loads(t), most_slots)
        return pa.table([table.column("host")[:1], pa.array([0], pa.int64()), pa.array([json.dumps(out)])], names=names)

    schema = "host string, salt bigint, template string"
    grown = found.where("template is not null").select(*names)
    tasks = (grown.agg(F.max("salt")).first()[0] or 0) + 1
    some = grown.withColumn("salt", F.pmod("salt", F.lit(max(1, int(tasks**0.5))))).groupBy("host", "salt").applyInArrow(join, schema)
    return some.groupBy("host").applyInArrow(join, schema).select("host", F.get_json_object("template", "$[1]").cast("bigint").alias("pages"), "template")


def template_texts(found: DataFrame, support: int = 3, share: float = 0.8) -> DataFrame:
    """host and texts (path:digest, parted by spaces), from the slots of seen(): those that at least ``support`` different pages and a ``share`` of the pages with the slot have.

    Pages cut off within the slot count for the text if they have it, else not at all. Hosts without a slot of two texts have no row.
    """
    each = found.where("path is not null")
    each = each.groupBy("host", "path", "text", "copy").agg(F.max("open").alias("open"))
    said = each.groupBy("host", "path", "text").agg(F.count("*").alias("n"), F.sum((~F.col("open")).cast("bigint")).alias("whole"))
    slot = said.groupBy("host", "path").agg(
        F.max(F.struct("n", "text", "whole")).alias("most"), F.sum("whole").alias("whole"), F.sum((F.col("whole") > 0).cast("bigint")).alias("kinds")
    )
    total = F.col("whole") - F.col("most.whole") + F.col("most.n")
    known = (F.col("most.n") >= support) & (F.col("most.n") >= share * total)
    text = F.when(known, F.concat_ws(":", F.col("path").cast("string"), "most.text"))
    return slot.groupBy("host").agg(F.array_join(F.sort_array(F.collect_list(text)), " ").alias("texts"), F.max("kinds").alias("kinds")).where("kinds > 1").select("host", "texts")


def main_text(pages: DataFrame, support: int = 3, share: float = 0.8) -> DataFrame:
    """page_id, url, text and n_chars of every page."""
    found = seen(pages)
    induced = written(templates(found).join(template_texts(found, support, share), "host", "left"), "templates")
    rows = pages.select("page_id", "url", "html", host().alias("host"))
    rows = skew_safe_join(rows, induced, "host", "pages", F.concat(F.lit("~"), F.xxhash64("url", "page_id").cast("string"))).select("page_id", "url", "html", "template", "texts")

    def run(batches):
        known: dict[str | None, list | None] = {None: None}
        counted: dict[str | None, frozenset[str]] = {None: frozenset()}
        for batch in slices(batches, "html"):
            out = []
            for page, t, x in zip(batch.column("html").to_pylist(), batch.column("template").to_pylist(), batch.column("texts").to_pylist(), strict=True):
                if t not in known:
                    if len(known) > 500:
                        known = {None: None}
                    known[t] = json.loads(t)
                if x not in counted:
                    if len(counted) > 500:
                        counted = {None: frozenset()}
                    counted[x] = frozenset(x.split())
                out.append(content(page, known[t], support, counted[x]))
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(out, pa.string()), pa.array([len(t) for t in out], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return rows.mapInArrow(run, f"page_id {rows.dtypes[0][1]}, url string, text string, n_chars bigint")
