"""Main text of web pages, with site templates removed by counting element subtrees per host.

A first pass hashes the subtrees of container elements, leaves to root; Spark counts on how many pages of
a host with different main texts each subtree stands.  Subtrees on many pages of their host are template and are deleted in a
second pass, whatever the host's size, along with elements that by their tag, role, class or id are no article text.  Only pages on
which a recurring subtree would otherwise stay meet its hash in a join.
"""

from __future__ import annotations

import html as references
import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reviewloom.llm.url_rules import url_host
from reviewloom.session import materialise

#: A subtree is template if it stands on pages of its host with at least so many different main texts.
MANY_PAGES = 5

# Element names of the HTML standard, and words in class, id or role that mark what is no article text (fixed values).
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe xmp noembed noframes".split())
NO_TEXT = frozenset(
    "head script style noscript template iframe noembed noframes xmp title nav header footer aside form svg math button "
    "select option textarea object canvas dialog menu audio video map datalist label".split()
)
NO_ROLE = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar toolbar".split())
NO_WORD = frozenset(
    "nav navbar navigation menu breadcrumb breadcrumbs header footer sidebar aside ad ads advert adverts advertisement "
    "advertising adsense sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices notification "
    "newsletter subscribe subscription signup login popup modal share sharing social related comment comments disqus "
    "replies masthead toolbar widget pagination pager".split()
)
#: Words that say where or how an element stands, not what it is about.  A class or id of several words marks an element
#: only if all its other words are among these; "site-header" does, "social-history" does not.
PLACE_WORD = frozenset(
    "site page main global local primary secondary tertiary top bottom left right center middle upper lower inner outer "
    "inside sticky fixed floating mobile desktop small large mini full wide list lists item items link links box boxes wrap wrapper "
    "container content block blocks bar bars area region section row col column columns grid group panel pane card cards slot "
    "unit units zone position placement layer overlay backdrop window body head title heading label text icon icons image "
    "button buttons btn toggle input field form message msg alert info thread tree entry entries post posts article articles "
    "story stories blog news user users reader readers visitor member author web home index default custom dynamic auto js "
    "hidden visible open closed active first last new old more next prev previous count counter tools tool tags tag categories "
    "archive archives recent popular latest recommended reading also like likes follow media email mail phone legal policy privacy "
    "copyright terms accept settings preferences search login logout sign register account topic topics the and for with".split()
)
#: Elements and roles that the rules drop whatever they hold.
NEVER_TEXT = NO_TEXT - frozenset("form header dialog".split())
NEVER_ROLE = frozenset("navigation contentinfo complementary menu menubar toolbar".split())
COMMENT_WORD = frozenset("comment comments disqus reply replies".split())
BLOCK = frozenset(
    "html body address article aside blockquote center details dialog dd div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hr li main nav ol p pre section summary table tbody td tfoot th thead tr ul caption".split()
)
CLOSES_P = BLOCK - frozenset("html body dd dt li td th tr tbody thead tfoot caption summary".split())
CLOSED_BY = {
    "li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "option": ("option",), "tr": ("tr", "td", "th"), "td": ("td", "th"),
    "th": ("td", "th"), "tbody": ("tr", "td", "th", "thead", "tbody"), "tfoot": ("tr", "td", "th", "thead", "tbody"),
}
SCOPE = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "option": ("select", "datalist")}
EDGE = frozenset("html body table td th caption button object template article section main".split())
CONTAINER = frozenset("div section nav ul ol dl table header footer aside form details figure".split())

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*+>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*+)>",
    re.DOTALL,
)
_MARK = re.compile(r"(?:^|\s)(class|id|role)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+)", re.IGNORECASE)
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")


def marking_words(names: str) -> Iterator[str]:
    """The words of those class or id names that say an element is no article text."""
    for name in names.split():
        words = [w.lower() for w in _WORD.findall(name)]
        whole = "".join(words)
        if whole in NO_WORD:
            yield whole
        elif NO_WORD.intersection(words) and all(w in NO_WORD or w in PLACE_WORD or len(w) <= 2 for w in words):
            yield from words


class Node:
    """An element: children are nodes and strings."""

    __slots__ = ("children", "dropped", "role", "tag", "words")

    def __init__(self, tag: str, attributes: str = ""):
        self.tag, self.children = tag, []
        self.words, self.role = frozenset(), ""
        if attributes and not attributes.isspace():
            marks = {k.lower(): v.strip("\"'") for k, v in _MARK.findall(attributes)}
            self.role = marks.get("role", "").lower()
            self.words = frozenset(w for k in ("class", "id") for w in marking_words(marks.get(k, "")))
        self.dropped = self._no_text()

    def _no_text(self) -> bool:
        if self.tag in ("html", "body", "main"):
            return False
        if self.tag == "article":
            return bool(self.words & COMMENT_WORD)
        return self.tag in NO_TEXT or self.role in NO_ROLE or bool(self.words & NO_WORD)

    def never(self) -> bool:
        """Whether it is dropped whatever it holds."""
        return self.tag in NEVER_TEXT or self.tag == "article" or self.role in NEVER_ROLE or bool(self.words & COMMENT_WORD)


def parse(page: str) -> Node:
    """A forgiving parse: end tags may be missing, stray ones are ignored."""
    root = Node("html")
    stack = [root]
    at = 0
    while m := _TOKEN.search(page, at):
        if m.start() > at:
            stack[-1].children.append(page[at : m.start()])
        at = m.end()
        tag = (m[2] or m[5] or "").lower()
        if not tag:
            continue
        if m[1] or m[4]:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == tag:
                    del stack[i:]
                    break
                if tag not in BLOCK and stack[i].tag in EDGE or tag == "p" and stack[i].tag in EDGE:
                    break
            continue
        if tag in ("html", "body") and len(stack) == 1:
            stack[0].children.append(node := Node(tag, m[3] or m[6]))
            stack.append(node)
            continue
        if tag in CLOSES_P:
            _close(stack, ("p",), EDGE)
        if tag in CLOSED_BY:
            _close(stack, CLOSED_BY[tag], SCOPE.get(tag, ("table",)))
        node = Node(tag, m[3] or m[6] or "")
        stack[-1].children.append(node)
        if tag in RAW:
            end = re.compile(rf"</{tag}\b[^>]*>", re.IGNORECASE).search(page, at)
            if tag not in NO_TEXT:
                node.children.append(page[at : end.start() if end else len(page)])
            at = end.end() if end else len(page)
        elif tag not in VOID and not (m[3] or m[6] or "").endswith("/"):
            stack.append(node)
    stack[-1].children.append(page[at:])
    _spare_wrappers(root)
    return root


def _spare_wrappers(root: Node) -> None:
    """Forms, headers and elements marked by class, id or role are not dropped if they hold the page's main part.

    That is a main or h1 element, or an article where none stands elsewhere on the page; comments are no part of it.
    """
    order = list(_walk(root))
    if not any(n.dropped and not n.never() for n in order):
        return
    state = {id(root): 0}  # 0: live, 1: below a wrapper that the rules drop, 2: below what they always drop
    for node in order:
        here = state[id(node)]
        for child in node.children:
            if isinstance(child, Node):
                state[id(child)] = max(here, child.dropped and (2 if child.never() else 1))
    elsewhere = any(n.tag == "article" and state[id(n)] == 0 for n in order)
    holds: set[int] = set()
    for node in reversed(order):
        if state[id(node)] == 2:
            continue
        main = node.tag == "main" or node.role == "main" or node.tag == "h1" and not node.dropped or node.tag == "article" and not elsewhere
        if main or any(id(c) in holds for c in node.children if isinstance(c, Node)):
            holds.add(id(node))
            node.dropped = False


def _close(stack: list[Node], tags: tuple[str, ...], edge) -> None:
    for i in range(len(stack) - 1, 0, -1):
        if stack[i].tag in edge:
            return
        if stack[i].tag in tags:
            del stack[i:]
            if len(tags) == 1 or not any(n.tag in tags for n in stack[max(1, i - 2) :]):
                return


def main_roots(root: Node) -> tuple[list[Node], bool]:
    """Where the main text is, and whether the page says so: its outermost articles, else main, else the body."""
    for fits in (lambda n: n.tag == "article", lambda n: n.tag == "main" or n.role == "main"):
        found, queue = [], [root]
        while queue:
            node = queue.pop()
            if node.dropped:
                continue
            if fits(node):
                found.append(node)
            else:
                queue += [c for c in reversed(node.children) if isinstance(c, Node)]
        if found:
            return found, True
    return [root], False


def hash_subtrees(root: Node) -> dict[int, tuple[int, bool, int]]:
    """id(element) -> (hash of its subtree, whether rules leave it, length of its text), children first."""
    order = list(_walk(root))
    live = {id(root): not root.dropped}
    for node in order:
        for child in node.children:
            if isinstance(child, Node):
                live[id(child)] = live[id(node)] and not child.dropped
    out: dict[int, tuple[int, bool, int]] = {}
    for node in reversed(order):
        digest, size = xxhash.xxh64(node.tag), 0
        for child in node.children:
            if isinstance(child, Node):
                value, _, length = out[id(child)]
                digest.update(value.to_bytes(8, "little"))
            else:
                text = " ".join(child.split())
                digest.update(text)
                length = len(text)
            size += length
        out[id(node)] = (digest.intdigest(), live[id(node)], size)
    return out


def candidates(page: str) -> tuple[list[Node], dict[int, tuple[int, bool, bool]]]:
    """A page's roots of main text, and the subtrees that may be template: id -> (hash, whether
    the rules leave it, whether it holds over half of the main text).

    Inside an article or main element prose is content however often it recurs: there only containers are
    candidates.  Elsewhere any block is.
    """
    root = parse(page)
    roots, said = main_roots(root)
    hashes = hash_subtrees(root)
    inside = {id(n) for r in roots for n in _walk(r)} if said else set()
    whole = sum(hashes[id(r)][2] for r in roots)
    roots_ids = {id(r) for r in roots}
    out = {}
    for node in _walk(root):
        value, live, size = hashes[id(node)]
        own = id(node) in inside
        if not size or id(node) in roots_ids or node.tag in ("html", "body", "article", "main"):
            continue
        could = own or not said  # only text inside the roots can be deleted; the rest is just counted
        if node.tag in (CONTAINER if said else BLOCK):
            out[id(node)] = (value, live and could, 2 * size > whole)
    return roots, out


def _walk(node: Node) -> Iterator[Node]:
    stack = [node]
    while stack:
        node = stack.pop()
        yield node
        stack += [c for c in reversed(node.children) if isinstance(c, Node)]


def main_text(page: str | None, template: frozenset[int] = frozenset()) -> str:
    """The main text: blocks in page order, white space inside a block as one space, joined by two line feeds.

    Where the templates are all there is, those with over half of the text stay, or else all of them.
    """
    if not page:
        return ""
    if not template:
        return _text(main_roots(parse(page))[0], set())
    roots, found = candidates(page)
    gone = {i: large for i, (value, live, large) in found.items() if live and value in template}
    return _text(roots, set(gone)) or _text(roots, {i for i, large in gone.items() if not large}) or _text(roots, set())


def _text(roots: list[Node], gone: set[int]) -> str:
    blocks: list[list[str]] = [[]]
    for root in roots:
        _blocks(root, blocks, gone)
        blocks.append([])
    texts = (" ".join(references.unescape("".join(b)).split()) for b in blocks)
    return "\n\n".join(t for t in texts if t)


def _blocks(root: Node, blocks: list[list[str]], gone: set[int]) -> None:
    work: list = [root]
    while work:
        item = work.pop()
        if isinstance(item, str):
            blocks[-1].append(item)
        elif item is None:
            blocks.append([])
        elif item.tag in ("br", "wbr", "img"):
            blocks[-1].append("" if item.tag == "wbr" else " ")
        elif not item.dropped and id(item) not in gone:
            if item.tag in BLOCK:
                work.append(None)
                blocks.append([])
            work += reversed(item.children)


def subtree_hashes(pages: DataFrame) -> DataFrame:
    """(page_id, host, main, hash, live): the distinct candidate subtrees of each row of ``pages`` (page_id, url, html).

    main is the hash of the row's main text before templates are deleted: copies share it.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for page_id, host, page in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                found: dict[int, bool] = {}
                roots, subtrees = candidates(page)
                for value, live, _ in subtrees.values():
                    found[value] = found.get(value, False) or live
                main = xxhash.xxh64_intdigest(_text(roots, set())) - (1 << 63)
                rows += [(page_id, host, main, value - (1 << 63), live) for value, live in sorted(found.items())]
            columns = list(zip(*rows, strict=True)) or [()] * 5
            types = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.bool_())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["page_id", "host", "main", "hash", "live"])

    rows = pages.filter("html is not null").select(F.col("page_id").cast("long").alias("page_id"), url_host(F.coalesce("url", F.lit(""))).alias("host"), "html")
    return rows.mapInArrow(run, "page_id long, host string, main long, hash long, live boolean")


def extract(pages: DataFrame, many_pages: int = MANY_PAGES) -> DataFrame:
    """(page_id, url, text, n_chars) for every row of ``pages`` (page_id, url, html; other columns are ignored).

    A null or empty html, or one without article text, has an empty text.  A null URL counts as a host of its
    own.  Repeated rows and null ids are kept.  Rows of a host with the same main text count as one page.
    """
    found = materialise(subtree_hashes(pages), "subtrees")
    once = found.groupBy("host", "hash", "main").agg(F.max("live").alias("live"))
    counts = once.groupBy("host", "hash").agg(F.count("*").alias("n"), F.max("live").alias("live"))
    recurring = materialise(counts.filter((F.col("n") >= many_pages) & F.col("live")).select("host", "hash"), "template")
    marked = found.filter("live").join(recurring, ["host", "hash"]).groupBy("page_id", "host").agg(F.collect_set("hash").alias("template"))
    marked = materialise(marked.select(F.col("page_id").alias("t_page"), F.col("host").alias("t_host"), "template"), "marked")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pages_, marks = batch.column("html").to_pylist(), batch.column("template").to_pylist()
            texts = [main_text(p, frozenset(h + (1 << 63) for h in m or ())) for p, m in zip(pages_, marks, strict=True)]
            arrays = [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())]
            yield pa.RecordBatch.from_arrays(arrays, ["page_id", "url", "text", "n_chars"])

    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html")
    same = F.col("page_id").eqNullSafe(F.col("t_page")) & (url_host(F.coalesce("url", F.lit(""))) == F.col("t_host"))
    joined = rows.join(marked, same, "left").select("page_id", "url", "html", "template")
    return joined.mapInArrow(run, "page_id long, url string, text string, n_chars long")
