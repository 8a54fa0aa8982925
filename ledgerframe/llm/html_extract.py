"""HTML extraction (7): nearest-URL page differencing.

1. Every page is cut into blocks of text, in page order, each with a role:
   *chrome* (menus, headers, footers, sidebars, notices, adverts, forms, reader
   comments: by element, role, or words of class and id), *article* (inside an
   explicit article, or main where no article is), or *open* (neither).
   Blocks of every role are hashed.
2. Pages of a host with equal blocks are folded to one.  Every page is paired
   with the page of nearest URL path (neighbours in path order; the longer
   common run of path segments wins).  Near copies of a page, such as its print
   version, are passed over to the next page that differs.  All pages are dealt in ranges of (host,
   path) and scanned in order in both directions; what a scan holds at the end
   of a range is carried into the next, so ranges change no result.
3. The blocks of both, chrome too, are aligned by their longest common
   subsequence, and open lines that are shared are deleted: what two
   neighbouring pages have in common is not the page's own text.

The article role only protects: lines inside an explicit article are kept even
where the neighbour has them, as pages do repeat paragraphs of their articles
(README); lines beside an article are compared like any other.  Chrome is never
text.  Pages without open lines lose none, so their text is never shuffled; of
every page only hashes are.

Cases: null html or url are empty; a page without a neighbour that differs keeps
its open lines, those beside an article if they are more text than it has; a
text whose every line is shared is not emptied; broken or cut-off markup is read to its end; repeated pages are
extracted alike; an empty table gives no rows.
"""

from __future__ import annotations

import html as html_lib
import re
from collections import Counter, namedtuple
from collections.abc import Iterator
from urllib.parse import urlsplit

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .regions import saved

# Elements without text of their own, elements that are never
# article text, block elements, void elements, and words of class or id.
RAW = frozenset("script style textarea title noscript template iframe object svg math canvas select xmp".split())
CHROME = frozenset("nav footer aside form menu dialog button head label fieldset input".split())
BLOCKS = frozenset("""address article aside blockquote body caption center dd details dialog dir div dl dt fieldset
    figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol option p pre
    section summary table tbody td tfoot th thead tr ul""".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
CHROME_WORDS = frozenset("""ad ads advert adverts advertisement advertising sponsor sponsored promo banner cookie cookies
    consent gdpr notice notices popup modal newsletter subscribe signup menu menubar nav navbar navigation breadcrumb
    breadcrumbs sidebar aside widget widgets footer masthead topbar comment comments disqus replies respond share
    sharing social related recommended pagination pager toolbar login searchform""".split())
CHROME_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar".split())
# An article opened inside one of these does not end them.
STICKY_WORDS = frozenset("comment comments disqus replies respond related recommended sidebar aside".split())
# Further parts of a class name that is chrome by one of the words above; a name
# with any other part (comments-open, has-sidebar) says nothing.
NEUTRAL_WORDS = frozenset("""site page global main top bottom left right upper lower primary secondary header head list
    area box container wrapper wrap section bar block row item items link links button buttons text message slot unit
    inner outer panel form field group title thread the wp js fixed sticky mobile desktop
    post posts entry article articles stories blog news user reader content count""".split())
SIDE_WORDS = frozenset("sidebar aside".split())
# Words that an article element itself may be chrome by.
ARTICLE_ADS = frozenset("ad ads advert advertisement sponsored promo".split())

# Lines of so many characters are running text; pages that share so much of it
# are near copies.
PROSE, NEAR_PERCENT = 40, 80

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][\w:-]*)((?:[^<>\"']|\"[^\"<]*\"|'[^'<]*')*)/?>"
    r"|<(/?)([a-zA-Z][\w:-]*)([^<>]*)(?:>|\Z)|<[!?/][^>]*(?:>|\Z)|[^<]+|<", re.S)
_ATTR = re.compile(r"(class|id|role)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+)", re.I)
_WORD = re.compile(r"[a-z0-9]+")


def _chrome_words(value: str) -> set[str]:
    """The chrome words of those names of a class or id that are whole chrome names."""
    found: set[str] = set()
    for name in value.lower().strip("\"'").split():
        parts = {x for x in _WORD.findall(name) if not x.isdigit()}
        if parts <= CHROME_WORDS | STICKY_WORDS | NEUTRAL_WORDS:
            found |= parts - NEUTRAL_WORDS
    return found


def _chrome_kind(tag: str, attrs: str) -> str:
    """'' for text, 'soft' for chrome that an article element ends, 'side' for a
    sidebar by its class, 'hard' else."""
    words: set[str] = set()
    if attrs and "=" in attrs and tag not in ("html", "body", "main"):
        for name, value in _ATTR.findall(attrs):
            if name.lower() != "role":
                words |= _chrome_words(value)
            elif tag != "article" and CHROME_ROLES.intersection(_WORD.findall(value.lower())):
                return "soft"
    if tag == "article":
        # Only a reader's comment or an advert, and only if nothing else is text.
        return "hard" if "comment" in words else "soft" if words & ARTICLE_ADS else ""
    if tag == "aside" or words & STICKY_WORDS - SIDE_WORDS:
        return "hard"
    if words & SIDE_WORDS:
        return "side"
    return "soft" if tag in CHROME or words & CHROME_WORDS else ""


def page_blocks(source: str) -> list[tuple[str, str]]:
    """(text, role) of the blocks of a page; role: article, main, open or chrome.

    No class word takes the main text: a sidebar whose articles hold most of the
    page's text is its wrapper, and so is anything where no text is left."""
    blocks, held = _blocks(source, ("soft",))
    for kind, ended in (("side", ("soft", "side")), ("hard", ("soft", "side", "hard"))):
        if kind in held:
            again, _ = _blocks(source, ended)
            text, own = (sum(len(t) for t, r in x if r != "chrome") for x in (blocks, again))
            if text == 0 or kind == "side" and own > 3 * text:
                blocks = again
    return blocks


def _blocks(source: str, ended: tuple[str, ...]) -> tuple[list[tuple[str, str]], set[str]]:
    """(blocks, kinds of chrome that hold an article); an article ends chrome of
    the kinds `ended`, and a main element of any."""
    out: list[tuple[str, str]] = []
    piece: list[str] = []
    aside: list[str] = []                  # text inside chrome
    stack: list[tuple[str, str]] = []      # open elements: (tag, chrome kind)
    tags, kinds = Counter(), Counter()     # how many of each are open: no search of the stack
    chrome = articles = mains = 0
    held: set[str] = set()

    def flush():
        for held, role in ((aside, "chrome"), (piece, "article" if articles else "main" if mains else "open")):
            if held:
                text = " ".join(html_lib.unescape("".join(held)).split())
                held.clear()
                if text:
                    out.append((text, role))

    def pop():
        nonlocal chrome, articles, mains
        tag, kind = stack.pop()
        tags[tag] -= 1
        kinds[kind] -= 1
        chrome -= kind != ""
        articles -= tag == "article" and not kind
        mains -= tag == "main" and not kind

    pos, n = 0, len(source)
    while pos < n:
        m = _TOKEN.match(source, pos)
        pos = m.end()
        tag = m[2] or m[5]
        if tag is None:
            if source[m.start()] != "<" or m[0] == "<":
                (aside if chrome else piece).append(m[0])
            continue
        closing, attrs, tag = (m[1] or m[4]), (m[3] or m[6] or ""), tag.lower()
        if tag in BLOCKS:
            flush()
        elif tag == "br":
            (aside if chrome else piece).append(" ")
        if closing:
            if tags[tag]:
                while stack[-1][0] != tag:
                    pop()
                pop()
            continue
        if tag in RAW:
            end = re.compile(f"</{tag}\\b[^>]*>?", re.I).search(source, pos)
            pos = end.end() if end else n
            continue
        if tag in VOID:
            continue
        kind = _chrome_kind(tag, attrs)
        if tag == "header" and not articles:
            kind = kind or "soft"
        if tag == "article" and (kind or chrome):
            held.update((kind, *(k for k, c in kinds.items() if c)))
            if "hard" in ended:
                kind = ""
        if tag == "main" and chrome or tag == "article" and not kind and chrome and all(
                k in ("", *ended) for k, c in kinds.items() if c):
            # Chrome that was never closed ends where the article begins.
            while chrome:
                pop()
        if tag == "body" and chrome:
            while stack and chrome:
                pop()
        if tag in ("p", "li", "option", "dt", "dd", "tr", "td", "th") and stack and stack[-1][0] == tag:
            pop()
        stack.append((tag, kind))
        tags[tag] += 1
        kinds[kind] += 1
        chrome += kind != ""
        articles += tag == "article" and not kind
        mains += tag == "main" and not kind
    flush()
    return out, held


CHROME_LINE, OPEN_LINE, KEPT_LINE = 0, 1, 2


def page_lines(source: str) -> list[tuple[str, int]]:
    """(text, CHROME_LINE, OPEN_LINE or KEPT_LINE) of every block of a page."""
    blocks = page_blocks(source)
    roles = {r for _, r in blocks}
    kept = "article" if "article" in roles else "main"
    return [(t, KEPT_LINE if r == kept else CHROME_LINE if r == "chrome" else OPEN_LINE) for t, r in blocks]


LCS_BITS = 1 << 28  # a table of rows is kept up to this size, and halved above


def _rows(a: list[int], b: list[int]) -> Iterator[int]:
    """The rows of the LCS table as bit strings: bit j is 0 where the length
    grows from j to j + 1 elements of b.  A row takes len(b) / 64 steps."""
    places: dict[int, int] = {}
    for j, x in enumerate(b):
        places[x] = places.get(x, 0) | 1 << j
    full = (1 << len(b)) - 1
    row = full
    for x in a:
        met = row & places.get(x, 0)
        row = (row + met | row - met) & full
        yield row


def _growth(a: list[int], b: list[int]) -> np.ndarray:
    """Length of the LCS of a with each prefix of b."""
    row = (1 << len(b)) - 1
    for row in _rows(a, b):
        pass
    bits = np.unpackbits(np.frombuffer(row.to_bytes(len(b) // 8 + 1, "little"), dtype=np.uint8), bitorder="little")[:len(b)]
    return np.concatenate([[0], np.cumsum(1 - bits.astype(np.int64))])


def shared_lines(a: list[int], b: list[int]) -> list[bool]:
    """Flags of the elements of a that a longest common subsequence with b has.

    Time len(a) * len(b) / 64 however often a line repeats, memory bounded: a
    long a is halved where the two halves' subsequences add up."""
    lead = 0
    while lead < min(len(a), len(b)) and a[lead] == b[lead]:
        lead += 1
    tail = 0
    while tail < min(len(a), len(b)) - lead and a[-1 - tail] == b[-1 - tail]:
        tail += 1
    mid, other = a[lead:len(a) - tail], b[lead:len(b) - tail]
    if len(mid) > 1 and len(mid) * len(other) > LCS_BITS:
        half = len(mid) // 2
        both = _growth(mid[:half], other) + _growth(mid[half:][::-1], other[::-1])[::-1]
        cut = int(both.argmax())
        flags = shared_lines(mid[:half], other[:cut]) + shared_lines(mid[half:], other[cut:])
    else:
        rows = list(_rows(mid, other))
        flags = [False] * len(mid)
        i, j = len(mid), len(other)
        while i and j:
            if rows[i - 1] >> (j - 1) & 1:
                j -= 1
                continue
            i -= 1
            if i == 0 or rows[i - 1] >> (j - 1) & 1:
                flags[i] = True
                j -= 1
    return [True] * lead + flags + [True] * tail


# `lines` are those of the text (no chrome); the other lists have all blocks.
PARSED = ("page_id {kind}, url string, host string, path array<string>, is_open boolean, lines array<string>, "
          "hashes array<long>, sizes array<int>, roles array<tinyint>, digest binary")


def _parse(batches):
    for batch in batches:
        rows = []
        for page_id, url, source in zip(batch.column("page_id").to_pylist(), batch.column("url").to_pylist(),
                                        batch.column("html"), strict=True):
            try:
                parts = urlsplit(url or "")
                host, path = (parts.netloc or "").lower(), parts.path
            except ValueError:
                host, path = "", url
            blocks = page_lines(source.as_py() or "")
            roles = [r for _, r in blocks]
            rows.append((page_id, url, host, [p for p in path.split("/") if p], OPEN_LINE in roles,
                         [x for x, r in blocks if r != CHROME_LINE],
                         [xxhash.xxh3_64_intdigest(x.encode("utf-8", "surrogatepass")) - (1 << 63) for x, _ in blocks],
                         [len(x) for x, _ in blocks], roles,
                         xxhash.xxh3_128_digest(repr(blocks).encode("utf-8", "surrogatepass"))))
        if rows:
            cols = list(zip(*rows, strict=True))
            kinds = (batch.schema.field("page_id").type, pa.string(), pa.string(), pa.list_(pa.string()), pa.bool_(),
                     pa.list_(pa.string()), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.int8()),
                     pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)],
                                             names=["page_id", "url", "host", "path", "is_open", "lines", "hashes", "sizes",
                                                    "roles", "digest"])


def _common(a, b) -> int:
    if a is None or b is None:
        return -1
    n = 0
    for x, y in zip(a, b, strict=False):
        if x != y:
            break
        n += 1
    return n


def own_lines(hashes: list[int], sizes: list[int], roles: list[int], other: list[int] | None) -> list[bool]:
    """Flags of the blocks that are the page's text; other: hashes of its nearest page."""
    if other is None:
        # Nothing to compare with: an article is the text, unless it is a mere
        # teaser beside more open text.
        size = [sum(n for n, r in zip(sizes, roles, strict=True) if r == x) for x in (OPEN_LINE, KEPT_LINE)]
        return [r == KEPT_LINE or r == OPEN_LINE and (size[1] == 0 or size[0] > size[1]) for r in roles]
    return [r == KEPT_LINE or r == OPEN_LINE and not gone
            for r, gone in zip(roles, shared_lines(hashes, other), strict=True)]


Page = namedtuple("Page", "host path hashes sizes roles")
PAGE = "host string, path array<string>, hashes array<long>, sizes array<int>, roles array<tinyint>"
PAGE_KINDS = dict(zip(Page._fields, (pa.string(), pa.list_(pa.string()), pa.list_(pa.int64()), pa.list_(pa.int32()),
                                     pa.list_(pa.int8())), strict=True))
ORDER = ("part", "host", "path", "url", "digest")


def _neighbour(page: Page, last: Page | None, beyond: Page | None) -> Page | None:
    """The page to compare with on one side: of its host, and no near copy;
    last: the page next to it there, beyond: that one's neighbour."""
    if last is None or last.host != page.host:
        return None
    return beyond if near_copies(page, last) else last


def near_copies(a: Page, b: Page) -> bool:
    """Whether most of the running text of two pages is one and the same; of all
    their lines, where one has no running text (menus may outweigh a body)."""
    a, b = sorted((a, b), key=lambda x: (x.hashes, x.roles))     # alike from both sides
    text = [sum(n for n, r in zip(x.sizes, x.roles, strict=True) if r != CHROME_LINE and n >= PROSE) for x in (a, b)]
    least = PROSE if all(text) else 0
    if not least:
        text = [sum(n for n, r in zip(x.sizes, x.roles, strict=True) if r != CHROME_LINE) for x in (a, b)]
    if NEAR_PERCENT * max(text) > 100 * min(text):
        return False
    both = sum(n for n, r, f in zip(a.sizes, a.roles, shared_lines(a.hashes, b.hashes), strict=True)
               if f and r != CHROME_LINE and n >= least)
    return max(text) > 0 and 100 * both >= NEAR_PERCENT * max(text)


def own_blocks(page: Page, before: Page | None, after: Page | None) -> list[bool]:
    """Flags of the blocks that are the page's text, by its nearest neighbour."""
    sides = [x for x in (before, after) if x is not None]
    sides.sort(key=lambda x: -_common(page.path, x.path))
    for other in sides:
        if not near_copies(page, other):
            own = own_lines(page.hashes, page.sizes, page.roles, other.hashes)
            if any(own):
                return own
    return own_lines(page.hashes, page.sizes, page.roles, None)


def _pages(batch, prefix: str = ""):
    """The Page of each row; None where the row has none."""
    cols = [batch.column(prefix + c).to_pylist() for c in Page._fields]
    return [None if x[0] is None else Page(*x) for x in zip(*cols, strict=True)]


def _with_borders(batches):
    """The rows of a range, and behind them, by `side`, what a scan has to know of
    it: its first and last page, and the neighbour of the last (first) page if it
    lies inside the range."""
    part = first = last = before = after = None
    broken = False

    def rows():
        held = [("first", first), ("last", last), ("before", before), ("after", after)]
        held = [(side, x) for side, x in held if x is not None]
        cols = list(zip(*(x for _, x in held), strict=True))
        known = dict(zip(Page._fields, (pa.array(c, k) for c, k in zip(cols, PAGE_KINDS.values(), strict=True)), strict=True))
        known |= {"part": pa.array([part] * len(held), pa.int32()), "broken": pa.array([broken] * len(held)),
                  "side": pa.array([x for x, _ in held])}
        return pa.RecordBatch.from_arrays([known.get(f.name, pa.nulls(len(held), f.type)) for f in out], schema=out)
    out = None
    for batch in batches:
        if out is None:
            out = pa.schema([*(pa.field(f.name, f.type) for f in batch.schema), pa.field("broken", pa.bool_()),
                             pa.field("side", pa.string())])
        yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.nulls(batch.num_rows, k) for k in (pa.bool_(), pa.string()))],
                                         schema=out)
        for now, page in zip(batch.column("part").to_pylist(), _pages(batch), strict=True):
            if part is None:
                part, first = now, page
            else:
                found = _neighbour(page, last, before)
                if page.host != last.host or found is last:
                    if not broken:
                        after = page if page.host == last.host else None
                    before, broken = found, True
            last = page
    if part is not None:
        yield rows()


def _carried(borders: list) -> tuple[dict, dict]:
    """Per range, (page, its neighbour) that a scan holds when it enters the
    range: scanning forward, and scanning backward."""
    ranges: dict[int, dict] = {}
    for r in borders:
        ranges.setdefault(r["part"], {"broken": r["broken"]})[r["side"]] = Page(*(r[c] for c in Page._fields))
    out = []
    for parts, near, far, inside in ((sorted(ranges), "first", "last", "before"),
                                     (sorted(ranges, reverse=True), "last", "first", "after")):
        held, state = {}, (None, None)
        for part in parts:
            held[part], x = state, ranges[part]
            state = x[far], x.get(inside) if x["broken"] else _neighbour(x[near], *state)
        out.append(held)
    return out[0], out[1]


def _scanned(batch, state: tuple, carried: dict):
    """(pages of the batch, the neighbour of each, the state after them)."""
    part, last, beyond = state
    pages, found = _pages(batch), []
    for now, page in zip(batch.column("part").to_pylist(), pages, strict=True):
        if now != part:
            part, (last, beyond) = now, carried[now]
        beyond = _neighbour(page, last, beyond)
        found.append(beyond)
        last = page
    return pages, found, (part, last, beyond)


def own_texts(parsed: DataFrame, ranges: int | None = None) -> DataFrame:
    """(host, digest, own): flags of the lines of the pages that lose some (saved)."""
    folded = (parsed.groupBy("host", "digest").agg(F.min(F.struct("path", "url", "hashes", "sizes", "roles")).alias("x"))
              .select("host", "digest", "x.*"))
    keys = ORDER[1:]
    dealt = folded.repartitionByRange(ranges, *keys) if ranges else folded.repartitionByRange(*keys)
    dealt = dealt.sortWithinPartitions(*keys).withColumn("part", F.spark_partition_id())
    schema = ", ".join(f"{c} {t}" for c, t in dealt.dtypes)
    dealt = saved(dealt.mapInArrow(_with_borders, f"{schema}, broken boolean, side string"), "ranges")
    forward, backward = _carried([r.asDict() for r in dealt.where("side IS NOT NULL").collect()])
    dealt = dealt.where("side IS NULL").drop("broken", "side").repartition("part").sortWithinPartitions(*ORDER)

    def ahead(batches):
        state = (None, None, None)
        for batch in batches:
            _, found, state = _scanned(batch, state, forward)
            cols = [pa.array([None if x is None else x[i] for x in found], k) for i, k in enumerate(PAGE_KINDS.values())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *cols],
                                             names=[*batch.schema.names, *("p_" + c for c in Page._fields)])

    def back(batches):
        state = (None, None, None)
        for batch in batches:
            pages, after, state = _scanned(batch, state, backward)
            rows = []
            for page, before, behind, digest in zip(pages, _pages(batch, "p_"), after, batch.column("digest"), strict=True):
                if OPEN_LINE in page.roles:
                    own = [f for f, r in zip(own_blocks(page, before, behind), page.roles, strict=True) if r != CHROME_LINE]
                    if not all(own):
                        rows.append((page.host, digest.as_py(), own))
            if rows:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, k) for c, k in zip(zip(*rows, strict=True),
                                                    (pa.string(), pa.binary(), pa.list_(pa.bool_())), strict=True)],
                    names=["host", "digest", "own"])
    met = dealt.mapInArrow(ahead, schema + ", " + ", ".join("p_" + c for c in PAGE.split(", ")))
    return saved(met.sortWithinPartitions(*(F.col(c).desc() for c in ORDER))
                 .mapInArrow(back, "host string, digest binary, own array<boolean>"), "own")


def extract_pages(pages: DataFrame, ranges: int | None = None) -> DataFrame:
    """Operator 7: page_id, url, text, n_chars for every page."""
    kind = dict(pages.dtypes)["page_id"]
    parsed = saved(pages.select("page_id", "url", "html").mapInArrow(_parse, PARSED.format(kind=kind)), "pages")
    own = own_texts(parsed, ranges)
    opened = parsed.where("is_open").select("page_id", "url", "host", "digest", "lines").join(own, ["host", "digest"], "left")
    lines = F.when(F.col("own").isNull(), F.col("lines")).otherwise(F.filter("lines", lambda x, i: F.get("own", i)))
    open_text = opened.select("page_id", "url", F.array_join(lines, "\n").alias("text"))
    own_text = parsed.where("NOT is_open").select("page_id", "url", F.array_join("lines", "\n").alias("text"))
    return (own_text.unionByName(open_text)
            .select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars")))
