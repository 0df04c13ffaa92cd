"""Main-text extraction with wrappers inferred for each host.

Pages of a host share a template.  A page is a stream of texts, each named by its path of
open elements.  Streams of a host are aligned one after another into a wrapper, a regular
expression without alternatives: blocks that follow each other again and again become a
repeated group, texts that only some pages have are optional, texts that differ are
slots, texts that say the same on all pages are constants.  A wrapper matches every page
that it was inferred from.  Wrappers align with each other as pages do.  Alignment depends
on order, so order is fixed by the pages themselves: the pages of a host are dealt to
leaves by a hash of what they say, a leaf aligns its pages in the order of their digests,
and leaves merge in the order of their wrappers.  How pages lie in files or tasks changes
nothing.

Extraction matches a page with the wrapper of its host.  Main text is what stands in
slots, outside of elements whose name, class, id or role says otherwise.  Constants proven
by ``LEAST_PAGES`` distinct pages are template text there.  On a page with a main element
that element says where the main text is: inside it elements alone decide, and nothing
goes because other pages say it too.
"""

from __future__ import annotations

import html
import json
import re
from collections.abc import Callable, Iterable, Iterator, Sequence
from dataclasses import dataclass
from difflib import SequenceMatcher
from functools import lru_cache
from itertools import chain

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import BROADCAST_LIMIT, checkpoint, slices

#: Distinct pages that must say the same before a position counts as the template's.
LEAST_PAGES = 3
#: Leaves that the pages of a host are dealt to, and parts that the wrappers of its leaves merge in first.
LEAVES, SPREAD = 4096, 32
#: Longest block that is sought for repetition, and places of one path in a wrapper before they become one group.
WIDTH, PLACES = 4, 4
_SEPARATOR = "\x1f"

# Elements of HTML by their role.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
UNSEEN = frozenset("script style noscript template iframe svg head title select option textarea button".split())
CHROME = frozenset("nav header footer aside form menu dialog".split())
BLOCKS = frozenset("address article aside blockquote body br caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul".split())
CLOSES_P = BLOCKS - {"br", "caption", "td", "th", "tr", "tbody", "thead", "tfoot", "option", "html", "body"}
#: Words of class, id or role that mark what is not main text; the second kind may head an article.
ASIDE_WORDS = re.compile(r"(?:^|[^a-z])(?:ads?|alerts?|advert\w*|banner|breadcrumbs?|comments?|complementary|contentinfo|cookies?|consent|discussion|disqus|footer|menu|modal|nav\w*|newsletter|notices?|notification|pagination|popup|promo\w*|related|replies|search|share|sharing|sidebar|side|skip|social|sponsor\w*|subscribe|toolbar|widget)(?:$|[^a-z])", re.I)
HEAD_WORDS = re.compile(r"(?:^|[^a-z])(?:header|masthead)(?:$|[^a-z])", re.I)
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"""\b(class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""", re.I)


def tokens(page: str) -> Iterator[tuple[str, str, str]]:
    """(kind, name or text, marks): kind is ``open``, ``close`` or ``text``; what is never shown is left out."""
    at, hidden = 0, ""
    while True:
        if hidden:  # raw content ends at its own end tag only
            end = re.compile(rf"</{hidden}\b[^>]*>", re.I).search(page, at)
            at, hidden = (end.end() if end else len(page)), ""
        m = _TOKEN.search(page, at)
        if not m:
            if page[at:]:
                yield "text", page[at:], ""
            return
        if m.start() > at:
            yield "text", page[at : m.start()], ""
        at = m.end()
        if not m[2]:
            continue
        name = m[2].lower()
        if m[1]:
            yield "close", name, ""
            continue
        if name in ("script", "style", "noscript", "template", "iframe", "textarea") and not m[3].rstrip().endswith("/"):
            hidden = name
            continue
        yield "open", name, " ".join(v.strip("\"'") for _, v in _ATTRIBUTE.findall(m[3])) if m[3] else ""


def texts(page: str) -> Iterator[tuple[tuple[str, ...], int, str]]:
    """(path of open elements with their marks, number of the block, raw text) in page order."""
    stack: list[tuple[str, str]] = []
    block = 0
    for kind, name, marks in tokens(page):
        if kind == "text":
            yield tuple(s for _, s in stack), block, name
            continue
        block += name in BLOCKS
        if kind == "open":
            if name in CLOSES_P and stack and any(n == "p" for n, _ in stack):
                for k in reversed(range(len(stack))):
                    if stack[k][0] == "p":
                        del stack[k:]
                        break
                    if stack[k][0] in ("article", "div", "section", "td", "li", "main", "aside", "body"):
                        break
            if name not in VOID:
                stack.append((name, f"{name}.{marks}" if marks else name))
        else:
            for k in reversed(range(len(stack))):
                if stack[k][0] == name:
                    del stack[k:]
                    break


def _apart(element: str, in_main: bool = False) -> bool:
    name, _, marks = element.partition(".")
    if name in ("html", "body"):
        return False
    marks = marks.replace("-", " ").replace("_", " ")
    if name in UNSEEN or ASIDE_WORDS.search(marks):
        return True
    if in_main and name == "header":  # it heads the article
        return False
    return name in CHROME or bool(not in_main and HEAD_WORDS.search(marks))


@lru_cache(maxsize=100_000)
def _main(element: str) -> bool:
    name, _, marks = element.partition(".")
    return name in ("article", "main") or bool(re.search(r"(?:^|\s)main(?:\s|$)", marks))


@lru_cache(maxsize=100_000)
def _named(element: str) -> str:
    """An element without marks that hold digits, which often name one page, unless they say what it is."""
    name, _, marks = element.partition(".")
    kept = [m for m in marks.split() if not re.search(r"\d", m) or _apart(f"a.{m}")]
    return f"{name}.{' '.join(kept)}" if kept else name


@lru_cache(maxsize=100_000)
def place(path: tuple[str, ...]) -> str:
    """Name of a path in wrappers."""
    return _SEPARATOR.join(map(_named, path))


# -- inference


@dataclass(slots=True)
class Node:
    """Texts at one place of a wrapper: one or more of a path (``many``), or none (``optional``).

    ``says`` is the digest of what they say, None for a slot; ``pages`` are up to
    ``LEAST_PAGES`` distinct pages that say so.  Neighbours of one ``group`` (not 0)
    repeat together.  ``members`` are the numbers of the texts of the page at hand.
    """

    path: str
    says: int | None
    pages: tuple[int, ...] = ()
    many: bool = False
    optional: bool = False
    group: int = 0
    members: tuple[int, ...] = ()

    def join(self, other: Node) -> None:
        self.says = self.says if self.says == other.says else None
        self.pages = tuple(sorted({*self.pages, *other.pages})[:LEAST_PAGES]) if self.says is not None else ()
        self.many, self.optional, self.members = self.many or other.many, self.optional or other.optional, self.members + other.members


def digest(text: str) -> int:
    return xxhash.xxh64_intdigest(text.encode()) - (1 << 63)


def fold(nodes: list[Node]) -> list[Node]:
    """Blocks of up to ``WIDTH`` paths that follow each other again and again, as repeated groups.

    A block that holds or cuts another group loses its order: all its texts are optional.
    """
    out: list[Node] = []
    groups = 0
    for node in nodes:
        out.append(node)
        for w in range(1, WIDTH + 1):
            if len(out) < 2 * w or any(out[-k].path != out[-k - w].path for k in range(1, w + 1)):
                continue
            kept, again = out[-2 * w : -w], out[-w:]
            for a, b in zip(kept, again, strict=True):
                a.members += b.members
                a.many = a.many or b.many or w == 1
            if w > 1:
                known, before = {n.group for n in kept}, len(out) - 2 * w - 1
                alone = len(known) == 1 and (before < 0 or out[before].group not in known)
                whole = not any(n.group for n in again) and (known == {0} or alone)
                groups += 1
                while not whole and before >= 0 and out[before].group in known - {0}:
                    kept = [out[before], *kept]
                    before -= 1
                for a in kept:
                    a.group, a.optional = groups, a.optional or not whole
            del out[-w:]
            break
    return settle(out, _spans(out))


def _spans(nodes: list[Node]) -> list[tuple[int, int]]:
    """First and last node of each group."""
    spans: dict[int, list[int]] = {}
    for i, n in enumerate(nodes):
        if n.group:
            spans.setdefault(n.group, [i, i])[1] = i
    return [(a, b) for a, b in spans.values()]


def settle(nodes: list[Node], spans: list[tuple[int, int]]) -> list[Node]:
    """Spans as groups; spans that overlap, and paths that come again and again, become one group of optional texts."""
    places: dict[str, list[int]] = {}
    for i, n in enumerate(nodes):
        places.setdefault(n.path, []).append(i)
    # first, last, and whether the order in the span is lost
    cuts = [(a, b, False) for a, b in set(spans)] + [(at[0], at[-1], True) for at in places.values() if len(at) > PLACES]
    merged: list[list] = []
    for a, b, loose in sorted(cuts):
        if merged and a <= merged[-1][1]:
            merged[-1] = [merged[-1][0], max(b, merged[-1][1]), True]
        else:
            merged.append([a, b, loose])
    out, at = [], 0
    for number, (a, b, loose) in enumerate(merged, 1):
        out += nodes[at:a]
        inside = nodes[a : b + 1]
        if loose:
            by_path: dict[str, Node] = {}
            for n in inside:
                if n.path in by_path:
                    by_path[n.path].join(n)
                    by_path[n.path].many = True
                else:
                    by_path[n.path] = n
            inside = list(by_path.values())
        for n in inside:
            n.group, n.optional = number, n.optional or loose
        out += inside
        at = b + 1
    return out + nodes[at:]


def matched(wrapper: list[Node], page: list[Node]) -> Iterator[tuple[list[Node], list[Node], bool]]:
    """Stretches of both in order: of equal paths, or of one side alone."""
    left, right = [n.path for n in wrapper], [n.path for n in page]
    if left == right:
        yield wrapper, page, True
        return
    for tag, i, j, k, m in SequenceMatcher(None, left, right, autojunk=False).get_opcodes():
        yield wrapper[i:j], page[k:m], tag == "equal"


def align(wrapper: list[Node], page: list[Node]) -> list[Node]:
    """The wrapper generalized so that it also matches a page, or all that another wrapper matches."""
    out: list[Node] = []
    theirs_at: dict[int, list[int]] = {}
    for ours, theirs, equal in matched(wrapper, page):
        if equal:
            for a, b in zip(ours, theirs, strict=True):
                a.join(b)
                if b.group:
                    theirs_at.setdefault(b.group, []).append(len(out))
                out.append(a)
            continue
        for n in ours:
            n.optional = True
        out += ours
        for n in theirs:
            n.optional = True
            if n.group:
                theirs_at.setdefault(n.group, []).append(len(out))
                n.group = 0
            out.append(n)
    ours_at: dict[int, list[int]] = {}
    for i, n in enumerate(out):
        if n.group:
            ours_at.setdefault(n.group, []).append(i)
            n.group = 0
    # a span that repeats on both sides stays one group: what one side lacks in it is optional
    return settle(out, [(at[0], at[-1]) for at in (*ours_at.values(), *theirs_at.values())])


def stream(page: str) -> tuple[list[Node], list[tuple[tuple[str, ...], int, str]], list[str]]:
    """The folded nodes of a page, all its texts, and what they say (blank ones are in no node)."""
    found = list(texts(page))
    clean = [" ".join(html.unescape(t).split()) for _, _, t in found]
    nodes = fold([Node(place(path), None, members=(i,)) for i, (path, _, _) in enumerate(found) if clean[i]])
    name = digest("\0".join(filter(None, clean)))
    for n in nodes:
        n.says, n.pages = digest("\0".join(clean[i] for i in n.members)), (name,)
    return nodes, found, clean


def infer(pages: Iterable[str]) -> list[Node]:
    """Wrapper of pages of one template; no pages give an empty wrapper."""
    wrapper: list[Node] | None = None
    for page in pages:
        nodes = stream(page)[0]
        wrapper = nodes if wrapper is None else align(wrapper, nodes)
    return wrapper or []


def expression(wrapper: list[Node], symbol: Callable[[str], str] = lambda path: f"<{path}>") -> str:
    """The wrapper as a regular expression over paths."""
    out, last = "", 0
    for n in [*wrapper, Node("", None)]:
        if last and n.group != last:
            out += ")+"
        if n.group and n.group != last:
            out += "(?:"
        last = n.group
        if n.path:
            out += symbol(n.path) + ("*" if n.many and n.optional else "+" if n.many else "?" if n.optional else "")
    return out


# -- main text or not


@lru_cache(maxsize=100_000)
def by_elements(path: tuple[str, ...], has_main: bool) -> bool:
    """Is the text at a path main text, by element names, classes, ids and roles alone?

    Apart are elements whose role or marks say so; on a page with a main element, also
    all that is outside of it.
    """
    for k, e in enumerate(path):
        if _main(e):
            return not any(_apart(x, in_main=True) for x in path[k + 1 :])
    return not has_main and not any(map(_apart, path))


def block_of(path: str) -> str:
    """A path up to its last block element."""
    names = path.split(_SEPARATOR)
    while names and names[-1].partition(".")[0] not in BLOCKS:
        names.pop()
    return _SEPARATOR.join(names)


def roles(wrapper: Sequence[Node], has_main: bool) -> list[bool]:
    """Which nodes are main text, on pages with or without a main element.

    With one, elements decide alone.  Without one proven constants are not main text,
    unless they belong to a block that says other things as well.  Where that leaves
    nothing, the wrapper's pages are copies, which do not show what is template, and
    elements decide alone as well.
    """
    main = [by_elements(tuple(n.path.split(_SEPARATOR)), has_main) for n in wrapper]
    if has_main:
        return main
    varied = {block_of(n.path) for n in wrapper if n.says is None or len(n.pages) < LEAST_PAGES}
    data = [m and block_of(n.path) in varied for m, n in zip(main, wrapper, strict=True)]
    return data if any(data) else main


@dataclass(slots=True)
class Wrapper:
    """A host's wrapper, ready for use."""

    nodes: list[Node]
    main: dict[bool, list[bool]]
    by_path: dict[bool, dict[str, bool]]

    @classmethod
    def of(cls, nodes: list[Node]) -> Wrapper:
        main = {known: roles(nodes, known) for known in (False, True)}
        return cls(nodes, main, {k: dict(zip((n.path for n in nodes), m, strict=True)) for k, m in main.items()})


def extract(page: str | None, wrapper: Wrapper) -> str:
    """Main text of a whole page, by the wrapper of its host.

    A text that alignment leaves over takes the role of its path, and a path that the
    wrapper does not know that of its elements.
    """
    nodes, found, clean = stream(page or "")
    has_main = any(_main(e) for path in {p for p, _, _ in found} for e in path)
    role, by_path = wrapper.main[has_main], wrapper.by_path[has_main]
    main: set[int] = set()
    at = 0
    for ours, theirs, equal in matched(wrapper.nodes, nodes):
        for k, n in enumerate(theirs):
            known = role[at + k] if equal else by_path.get(n.path)
            if by_elements(tuple(n.path.split(_SEPARATOR)), has_main) if known is None else known:
                main.update(n.members)
        at += len(ours)
    blocks: dict[int, list[str]] = {}
    for i, (path, block, text) in enumerate(found):
        if i in main or (not clean[i] and by_elements(path, has_main)):
            blocks.setdefault(block, []).append(text)
    joined = (" ".join(html.unescape("".join(parts)).split()) for parts in blocks.values())
    return " ".join(b for b in joined if b)


# -- on tables


def pack(wrapper: list[Node]) -> str:
    return json.dumps([[n.path, n.says, n.pages, int(n.many), int(n.optional), n.group] for n in wrapper], ensure_ascii=False)


def unpack(text: str | None) -> list[Node]:
    return [Node(path, says, tuple(pages), bool(many), bool(optional), group) for path, says, pages, many, optional, group in json.loads(text or "[]")]


def _streams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``host``, ``name`` (a digest of what the page says), ``page``, ``size``: the folded nodes of each page that says something."""
    for batch in chain.from_iterable(map(slices, batches)):
        rows = {}
        for at, page in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            nodes = stream(page or "")[0]
            if nodes:
                raw = pack(nodes).encode()
                rows[at, nodes[0].pages[0], pa.compress(raw, codec="zstd", asbytes=True), len(raw)] = None
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate((pa.string(), pa.int64(), pa.binary(), pa.int64()))], ["host", "name", "page", "size"])


def _leaves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``host``, ``wrapper`` of each leaf; its pages come in order, copies of a page after each other."""
    at, last, wrapper = None, None, []

    def row() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([at[0]], pa.string()), pa.array([pack(wrapper)], pa.string())], ["host", "wrapper"])

    for batch in batches:
        for host_, leaf, page, size in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if (host_, leaf) != at:
                if at is not None:
                    yield row()
                at, last, wrapper = (host_, leaf), None, []
            if page != last:
                nodes = unpack(pa.decompress(page, decompressed_size=size, codec="zstd", asbytes=True).decode())
                wrapper, last = align(wrapper, nodes) if wrapper else nodes, page
    if at is not None:
        yield row()


def _merge(table: pa.Table) -> pa.Table:
    """One wrapper for all partial ones of a group."""
    wrapper: list[Node] = []
    for k, text in enumerate(sorted(table.column("wrapper").to_pylist())):
        wrapper = align(wrapper, unpack(text)) if k else unpack(text)
    return pa.table({"host": table.column("host").slice(0, 1), "wrapper": pa.array([pack(wrapper)], pa.string())})


def wrappers(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``host`` and ``wrapper`` (JSON), inferred from all pages of the host.

    Only the folded nodes of pages move, and copies of a page but once a slice of a task.
    A host with most of the pages has ``LEAVES`` leaves, whose wrappers merge in two
    steps, spread by a hash first.  A wrapper has at most ``PLACES`` nodes of a path.
    """
    found = pages.select(host(F.col(url_col)).alias("host"), F.col(html_col).alias("html")).mapInArrow(_streams, "host string, name bigint, page binary, size bigint")
    leaf = F.pmod(F.xxhash64("name"), F.lit(LEAVES)).alias("leaf")
    ordered = found.select("host", leaf, "name", "page", "size").repartition("host", "leaf").sortWithinPartitions("host", "leaf", "name", "page")
    found = ordered.select("host", "leaf", "page", "size").mapInArrow(_leaves, "host string, wrapper string").distinct()
    spread = found.groupBy("host", F.pmod(F.xxhash64("wrapper"), F.lit(SPREAD))).applyInArrow(_merge, "host string, wrapper string")
    return spread.groupBy("host").applyInArrow(_merge, "host string, wrapper string")


def host(url):
    """Lower-case host of a URL; none reads as empty."""
    return F.lower(F.coalesce(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1), F.lit("")))


def main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``id_col``, ``url``, ``text``, ``n_chars`` of every page.

    Null and empty pages have the empty text; a page without a host shares the wrapper
    of all such pages; repeated rows stay; an empty table gives an empty result; no other
    column is read.  Host tables are broadcast when proven small, else joined by host.
    """
    learned = checkpoint(wrappers(pages, url_col, html_col))
    size = learned.agg(F.coalesce(F.sum(F.octet_length("wrapper") * 4 + F.octet_length("host") + 300), F.lit(0))).first()[0]
    kind = pages.schema[id_col].dataType.simpleString()
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"), host(F.col(url_col)).alias("host"))
    small = size <= BROADCAST_LIMIT
    if small:
        shared = pages.sparkSession.sparkContext.broadcast({r.host: r.wrapper for r in learned.collect()})
    else:
        rows = rows.join(learned, "host", "left").select("id", "url", "html", "host", "wrapper")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpacked = lru_cache(maxsize=512)(lambda text: Wrapper.of(unpack(text)))
        for batch in chain.from_iterable(map(slices, batches)):
            hosts = batch.column(3).to_pylist()
            given = map(shared.value.get, hosts) if small else batch.column(4).to_pylist()
            found = [extract(page, unpacked(wrapper)) for page, wrapper in zip(batch.column(2).to_pylist(), given, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.string()), pa.array(map(len, found), pa.int64())], [id_col, "url", "text", "n_chars"])

    return rows.mapInArrow(run, f"`{id_col}` {kind}, url string, text string, n_chars bigint")
