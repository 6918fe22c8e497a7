"""Main text of web pages by consensus paths of their hosts.

1. Each page's containers are scored by the prose that stands in them and votes
   for their generalised paths (tag and class names from the root, numbers
   replaced by ``#``), in shares of the page's best score.
2. Votes are summed per host and path in Spark; each host's best path wins.
3. Pages are extracted again from the elements on their host's path, without
   what is boilerplate inside them. A page that has no text there is extracted
   from its own best container, and one without a container from its body. An
   article that is split over unnamed containers side by side is read from all.

What is boilerplate is told by tags and names, weighed by what they hold. A name
says so for certain where all its words do (``site-header``, ``ad-slot``); where
only some do (``social-sciences``, ``banner-text``), it takes links, or a place
outside the article without most of the page's prose. A form, or a name other than
those of reader comments, never hides the article: one that holds more prose
than is left outside, with a first heading or an article in it, is no boilerplate
(a form also where it holds ten times as much). Headings and paragraphs in the
header of an article are its title and lead.

Votes are pre-aggregated per batch and task, and the join on the host may split
a host that has a third of all pages. Null html gives an empty text, a null url
stands for a host of its own. Ties go to the path that sorts first.

Blocks are runs of text between block-level tags; a line break is white space.
The contents of scripts, svg drawings and the like (RAW) are skipped up to their
end tag, or to the end of the enclosing block where that comes first.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache
from html import unescape

import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from concordat.llm.arrow import added, with_columns
from concordat.session import materialize

#: HTML elements by their role.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe svg".split())
CODE = frozenset("script style textarea title iframe".split())  # no tag but their own end tag ends them
BLOCKS = frozenset("""address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form
    h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul""".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
DROPPED = frozenset("nav footer aside form menu dialog button select label fieldset head".split())
CLOSES = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}}
BARRIERS = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table", "tr"}, "th": {"table", "tr"}, "p": BLOCKS - {"p"}}
ROLES = frozenset("navigation banner contentinfo complementary search alert alertdialog dialog menu menubar form toolbar".split())
BAD_NAMES = frozenset("""ad ads adv advert adverts advertisement advertising adsbygoogle sponsor sponsored sponsors promo promos promotion banner nav navbar
    navigation menu menus breadcrumb breadcrumbs header masthead topbar footer sidebar sidebars aside notice notices cookie cookies consent gdpr
    newsletter subscribe subscription signup login social share sharing related recommended recommendations comment comments commentlist disqus respond
    reply replies pagination pager popup modal overlay widget widgets skip search toolbar alert""".split())
COMMENT_NAMES = frozenset("comment comments commentlist disqus respond reply replies".split())
AD_NAMES = frozenset("""ad ads adv advert adverts advertisement advertising adsbygoogle sponsor sponsored sponsors promo promos promotion cookie cookies
    consent gdpr newsletter subscribe subscription signup login""".split())
QUALIFIERS = frozenset("""site page global top bottom left right primary secondary inner outer block box area list wrap wrapper container holder section
    bar links link posts articles stories item items slot unit button buttons btn icon icons group panel row col column zone region module form field
    cta inline mobile desktop sticky fixed float floating tools home blog logo title label message image video count toggle small large full width sub
    js wp ui google facebook twitter mini level depth thread author avatar meta""".split())
WHOLE_TITLES = frozenset("entry post article story".split())  # their "header" holds the title
GOOD_NAMES = frozenset("article articles content contents entry main post story text body prose maintext".split())
HARD_TAGS = frozenset("nav menu dialog button select head".split())
FORM_TAGS = frozenset("form fieldset".split())
HOLD_TITLE = frozenset("article main h1".split())

#: How surely an element is boilerplate: may be, is unless it holds the article, is.
WEAK, FORM, STRONG, HARD = 1, 2, 3, 4

#: Elements below this depth are read as text and blocks of the last one above,
#: but for the outermost one that is boilerplate; longer paths go on from a hash of their beginning.
DEEPEST, LONG_PATH = 512, 2000

#: In an svg these hold HTML; elsewhere in it a block-level tag ends the svg.
HOLDERS = frozenset("foreignobject desc title".split())

_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:"[^"]*"|'[^']*'|[^"'>])*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>""", re.S)
_ATTRIBUTE = re.compile(r"""([a-zA-Z_:][-\w:.]*)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
_SPLIT = re.compile(r"[^a-z0-9]+|(?<=[a-z])(?=[0-9])")
_HUMP = re.compile(r"(?<=[a-z])(?=[A-Z])")
_BESIDE = frozenset("has with no without and".split())
_END = {tag: re.compile(rf"</{tag}\s*>", re.I) for tag in RAW}
_SAME = {tag: re.compile(rf"<(/?){tag}(?=[\s/>])", re.I) for tag in RAW}
_ANY = re.compile(r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:"[^"]*"|'[^']*'|[^"'>])*+)>?""", re.S)


@lru_cache(100_000)
def _weigh(name: str) -> tuple[int, bool, bool]:
    """What a class or id says: how surely boilerplate, whether it holds an
    article's title, whether content."""
    words = [w for w in _SPLIT.split(_HUMP.sub("-", name).lower()) if w and not w.isdigit()]
    # "has-sidebar" and "content-with-sidebar" say what stands beside an element
    words = words[:next((i for i, w in enumerate(words) if w in _BESIDE), len(words))]
    said = set(words)
    good = bool(said & GOOD_NAMES)
    if not said & BAD_NAMES:
        return 0, False, good
    if words[-1] == "header" and len(words) > 1 and said <= WHOLE_TITLES | {"header"}:
        return 0, True, False
    plain = said <= BAD_NAMES | QUALIFIERS | WHOLE_TITLES | {"main"}
    if said & COMMENT_NAMES and (plain or said <= BAD_NAMES | QUALIFIERS | GOOD_NAMES):
        return HARD, False, False
    if plain or said & AD_NAMES and said <= BAD_NAMES | QUALIFIERS | GOOD_NAMES:
        return STRONG, False, False
    return WEAK, False, good


class Page:
    """Elements and blocks of a page in page order."""

    def __init__(self, html: str):
        self.parent, self.tag, self.path, self.mark, self.good, self.head = [-1], ["#"], [""], [0], [False], [False]
        self.blocks: list[tuple[int, str, int]] = []  # element, text, characters in links
        self._parse(html)
        self._settle()

    def _names(self, tag: str, rest: str) -> tuple[int, bool, bool, list[str]]:
        """Mark, whether it holds a title, whether content, classes."""
        mark = HARD if tag in HARD_TAGS else FORM if tag in FORM_TAGS else STRONG if tag in DROPPED else 0
        head, good, classes = tag == "header", tag in ("article", "main"), []
        if rest and not rest.isspace():
            given = {k.lower(): v.strip("\"'") for k, v in _ATTRIBUTE.findall(rest)}
            classes = unescape(given.get("class", "")).split()
            for name in [*classes, given.get("id", "")]:
                sure, titled, content = _weigh(name)
                if sure > WEAK or tag in BLOCKS and tag != "article":
                    mark = max(mark, sure)
                head, good = head or titled, good or content
            role = given.get("role", "").lower()
            if role in ROLES:
                mark = max(mark, FORM if role == "form" else STRONG)
            if ("hidden" in given or given.get("aria-hidden", "").lower() == "true"
                    or "display:none" in given.get("style", "").lower().replace(" ", "")):
                mark = HARD
        if tag in ("html", "body", "main"):
            mark = 0
        return mark, head, good and not mark, [c.lower() for c in classes]

    def _open(self, above: int, tag: str, rest: str) -> int:
        mark, head, good, classes = self._names(tag, rest)
        label = tag + "".join(f".{c}" for c in sorted({re.sub(r"\d+", "#", c) for c in classes}))
        self.parent.append(above)
        self.tag.append(tag)
        base = self.path[above]
        self.path.append(f"{base if len(base) < LONG_PATH else '~' + xxhash.xxh3_64_hexdigest(base)}>{label}")
        self.mark.append(mark)
        self.good.append(good)
        self.head.append(head)
        return len(self.tag) - 1

    def _settle(self) -> None:
        """Which marks hold (``bad``). Children have larger numbers than parents,
        so sums climb in one pass from the last element to the first."""
        n = len(self.tag)
        size, linked, free, titled = [0] * n, [0] * n, [0] * n, [t in HOLD_TITLE for t in self.tag]
        for e, text, links in self.blocks:
            size[e] += len(text)
            linked[e] += links
            free[e] += max(0, len(text) - 2 * links)
        whole = sum(free)
        for e in range(n - 1, 0, -1):
            size[self.parent[e]] += size[e]
            linked[self.parent[e]] += linked[e]
        inside = [False] * n  # inside an element of content
        for e in range(1, n):
            inside[e] = self.good[e] or inside[self.parent[e]]
        self.inside, self.size, self.linked = inside, size, linked
        self.bad = [m > WEAK for m in self.mark]
        for e in range(n - 1, 0, -1):
            if self.mark[e] == WEAK:
                lists = size[e] > 0 and 2 * linked[e] >= size[e]
                self.bad[e] = lists or not (inside[e] or 2 * free[e] >= whole or titled[e])
            if not self.bad[e]:
                free[self.parent[e]] += free[e]
                titled[self.parent[e]] = titled[self.parent[e]] or titled[e]
        outside, under = free[0], [False] * n
        for e in range(1, n):
            under[e] = under[self.parent[e]]
            if self.bad[e] and not under[e]:
                holds = self.mark[e] != HARD and free[e] > outside and (titled[e] or self.mark[e] == FORM and free[e] > 10 * outside)
                if holds:
                    self.bad[e] = False
                    outside += free[e]
                else:
                    under[e] = True

    def _parse(self, html: str) -> None:
        stack, pieces, linked, links, at = [0], [], 0, 0, 0
        endless: set[str] = set()
        flat: dict[str, int] = defaultdict(int)  # open elements too deep to stand on the stack

        def text(piece: str) -> None:
            nonlocal linked
            piece = unescape(piece) if "&" in piece else piece
            pieces.append(piece)
            if links:
                linked += len("".join(piece.split()))

        def flush() -> None:
            nonlocal linked
            if pieces:
                whole = " ".join("".join(pieces).split())
                if whole:
                    owner = next(e for e in reversed(stack) if self.tag[e] in BLOCKS or e == 0)
                    if any(self.mark[e] for e in stack[stack.index(owner) + 1:]):
                        owner = next(e for e in stack[stack.index(owner) + 1:] if self.mark[e])
                    self.blocks.append((owner, whole, linked))
                pieces.clear()
            linked = 0

        while True:
            m = _TOKEN.search(html, at)
            if not m:
                text(html[at:])
                break
            if m.start() > at:
                text(html[at:m.start()])
            at = m.end()
            name = m[2] or m[5]
            if not name:
                continue
            tag, closing = name.lower(), bool(m[1] or m[4])
            if closing:
                if flat[tag]:
                    flat[tag] -= 1
                    if tag in BLOCKS:
                        flush()
                    continue
                here = next((i for i in range(len(stack) - 1, 0, -1) if self.tag[stack[i]] == tag), 0)
                if here:
                    if any(self.tag[e] in BLOCKS or self.mark[e] for e in stack[here:]):
                        flush()
                    links -= sum(self.tag[e] == "a" for e in stack[here:])
                    del stack[here:]
                continue
            if tag in RAW:
                if not _closes_itself(html, at, tag, m[3] or m[6] or ""):
                    at = _after(html, at, tag, {self.tag[e] for e in stack} & BLOCKS, endless)
                continue
            if tag in VOID:
                if tag == "hr":
                    flush()
                pieces.append(" ")
                continue
            if tag in BLOCKS:
                flush()
                if tag in CLOSES or tag not in ("p",):
                    ends = CLOSES.get(tag, {"p"} if tag in BLOCKS else set())
                    walls = BARRIERS.get(tag, BLOCKS - {"p"})
                    for i in range(len(stack) - 1, 0, -1):
                        if self.tag[stack[i]] in ends:
                            links -= sum(self.tag[e] == "a" for e in stack[i:])
                            del stack[i:]
                            break
                        if self.tag[stack[i]] in walls:
                            break
            if len(stack) > DEEPEST and (len(stack) > DEEPEST + 1 or not self._names(tag, m[3] or m[6] or "")[0]):
                flat[tag] += 1
                continue
            e = self._open(stack[-1], tag, m[3] or m[6] or "")
            if self.mark[e]:
                flush()
            links += tag == "a"
            if (m[3] or m[6] or "").rstrip().endswith("/") and tag not in BLOCKS and tag != "a":
                continue
            stack.append(e)
        flush()

    def _chain(self, e: int) -> list[int]:
        out = []
        while e > 0:
            out.append(e)
            e = self.parent[e]
        return out

    def scores(self) -> dict[int, float]:
        """Score of each container: prose in it counts in full for its block's
        parent and half for the next one, and more for elements named or tagged as content."""
        out: dict[int, float] = defaultdict(float)
        for e, text, linked in self.blocks:
            chain = self._chain(e)
            if any(self.bad[x] or self.head[x] for x in chain) or not chain:
                continue
            prose = max(0, len(text) - 2 * linked)
            holders = [x for x in chain if self.tag[x] not in ("p", "li", "ul", "ol", "pre", "blockquote", "td", "th", "tr", "tbody", "table", *HEADINGS)
                       and self.tag[x] in BLOCKS]
            for x, share in zip(holders, (1.0, 0.5), strict=False):
                out[x] += prose * share
        for x in out:
            if self.good[x]:
                out[x] *= 3 if self.tag[x] == "article" else 2
        return {x: s for x, s in out.items() if s > 0}

    def best(self) -> int:
        scores = self.scores()
        return min(scores, key=lambda x: (-scores[x], x)) if scores else 0

    def beside(self, roots: set[int]) -> set[int]:
        """``roots`` and the unnamed containers beside an unnamed one that hold a
        like share of prose (a quarter of its score, more text than links)."""
        scores, out = self.scores(), set(roots)
        least: dict[tuple[int, str], float] = {}
        for r in roots:
            if r > 0 and not self.inside[r]:
                key = self.parent[r], self.tag[r]
                least[key] = min(least.get(key, scores.get(r, 0) / 4), scores.get(r, 0) / 4)
        if least:
            for e, s in scores.items():
                at = least.get((self.parent[e], self.tag[e]))
                if at is not None and s >= at > 0 and 2 * self.linked[e] < self.size[e]:
                    out.add(e)
        return out

    def text_of(self, roots: set[int]) -> str:
        """Blocks inside these elements without the boilerplate below them."""
        kept = []
        for e, text, _ in self.blocks:
            inside, ok, heading, lead = False, True, False, False
            for x in self._chain(e) or [0]:
                if x in roots:
                    inside = True
                    break
                ok = ok and not self.bad[x]
                heading = heading or self.tag[x] in HEADINGS
                lead = lead or self.tag[x] == "p"
                if self.head[x] and not heading and not (lead and self.inside[x]):
                    ok = False
            if (inside or 0 in roots) and ok:
                kept.append(text)
        return "\n".join(kept)


def _closes_itself(html: str, at: int, tag: str, rest: str) -> bool:
    """Whether ``<tag rest>``, which ends at ``at``, has no contents."""
    if not rest.rstrip().endswith("/"):
        return False
    after = None if tag == "svg" else _SAME[tag].search(html, at)
    return not (after and after[1])


def _after(html: str, at: int, tag: str, around: set[str], endless: set[str]) -> int:
    """Where the page goes on after the contents of a RAW element: behind its end
    tag, or before the end of a block ``around`` it if that comes first or no end
    tag comes. ``endless`` keeps the tags whose end tags have all been passed."""
    if tag in CODE and tag not in endless:
        end = _END[tag].search(html, at)
        if end:
            return end.end()
        endless.add(tag)
    depth, same, held = defaultdict(int), 1, 0
    for m in _ANY.finditer(html, at):
        if not m[2]:
            continue
        name, closing, empty = m[2].lower(), bool(m[1]), m[3].rstrip().endswith("/")
        if name == tag and tag not in CODE:
            same += -1 if closing else not empty
            if not same:
                return m.end()
        elif tag == "svg" and name in HOLDERS:
            held += -1 if closing and held else not (closing or empty)
        elif tag == "svg" and not held and not closing and name in BLOCKS:
            return m.start()
        elif name in around:
            if not closing:
                depth[name] = 1 if name in CLOSES else depth[name] + 1
            elif depth[name]:
                depth[name] -= 1
            else:
                return m.start()
    return len(html)


def votes(html: str) -> dict[str, int]:
    """Generalised paths of a page's containers, in thousandths of the best score."""
    page = Page(html)
    by_path: dict[str, float] = defaultdict(float)
    for x, s in page.scores().items():
        by_path[page.path[x]] += s
    most = max(by_path.values(), default=1.0)
    return {p: round(1000 * s / most) for p, s in by_path.items()}


def extract(html: str, path: str | None) -> str:
    page = Page(html)
    found = {x for x in range(1, len(page.tag)) if page.path[x] == path} if path else set()
    text = page.text_of(page.beside(found)) if found else ""
    return text or page.text_of(page.beside({page.best()}))


def host_of(url: str | None) -> str:
    m = re.match(r"\s*(?:[a-zA-Z][-+.\w]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", url or "")
    return m[1].lower() if m else ""


def _vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        total: dict[tuple[str, str], int] = defaultdict(int)
        for url, html in zip(batch.column("url").to_pylist(), batch.column("html").to_pylist(), strict=True):
            for path, n in votes(html or "").items():
                total[host_of(url), path] += n
        yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in total], pa.string()), pa.array([k[1] for k in total], pa.string()),
                                          pa.array(total.values(), pa.int64())], names=["host", "path", "n"])


def winners(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """``host, path, n``: the path with most votes of each host."""
    counted = (pages.select(F.col(url).alias("url"), F.col(html).alias("html")).mapInArrow(_vote, "host string, path string, n long")
               .groupBy("host", "path").agg(F.sum("n").alias("n")))
    return counted.groupBy("host").agg(F.min(F.struct((-F.col("n")).alias("n"), "path")).alias("best")).select(
        "host", F.col("best.path").alias("path"), (-F.col("best.n")).alias("n"))


def _pack(url: str, html: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            c = zstandard.ZstdCompressor(level=1)
            packed = pa.array([c.compress((t or "").encode()) for t in batch.column(html).to_pylist()], pa.binary())
            hosts = pa.array([host_of(u) for u in batch.column(url).to_pylist()], pa.string())
            out = with_columns(batch, _llm_packed=packed, _llm_host=hosts)
            yield out.drop_columns([html])
    return run


def _extract(names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [extract(zstandard.decompress(t).decode(), p)
                   for t, p in zip(batch.column("_llm_packed").to_pylist(), batch.column("_llm_path").to_pylist(), strict=True)]
            yield with_columns(batch, text=pa.array(out, pa.string())).select(names)
    return run


def main_text(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """``pages`` with ``text`` in place of the html."""
    best = materialize(winners(pages, url, html).select(F.col("host").alias("_llm_host"), F.col("path").alias("_llm_path")), "host_paths")
    schema = added(pages.drop(html).schema, text=T.StringType())
    packed = pages.mapInArrow(_pack(url, html), added(pages.drop(html).schema, _llm_packed=T.BinaryType(), _llm_host=T.StringType()))
    return packed.join(best, "_llm_host", "left").mapInArrow(_extract(schema.names), schema)
