"""Main text of HTML pages: markup roles and nearest-URL page differencing.

1. A tolerant scanner turns a page, once, into blocks: text between block-level tags, character references decoded,
   white space folded.  A block carries its zone (inside an article, a main element, or neither) and its mark:
   OUT inside menus, headers, footers, forms, adverts, comments and the like, by element, role, or a class or id that
   says nothing else ("ad-box"); DOUBT where such a word is one of several ("legal-analysis").
2. Pages are ordered by (host, path, page_id) over range partitions, so a hot host spreads; windows of that order bring
   each page its NEIGHBOURS nearest urls: the same host, the longest common start of the path first.  Only hashes of
   block texts travel.
3. The page's lines are aligned with each neighbour's by their longest common subsequence.  Shared lines are the site's
   template: they are deleted where no article or main element speaks for them, and inside one where they are in DOUBT
   or mostly links.  Copies of the page are left out, and the next neighbour is taken.
4. Where an article (else a main element) has text, only what is inside stays.

Differencing alone is not right for pages: menus and adverts drawn at random are shared with no neighbour, and
passages that articles share would be lost; hence marks and zones decide where there are any.

Nulls and ties: a null html has no blocks (text ''); a null url has host and path ''; rows that are equal in page_id,
url and html get equal texts and are one page; pages alone on their host are not differenced; an unclosed quote ends its
tag at the next >.
"""

from __future__ import annotations

import html as _html
import re
from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import arrow_table, column, global_offsets, pieces
from lodestone.llm.urls import host_and_path
from lodestone.storage import importable, materialize

_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>|</?[a-zA-Z](?:[^>\"']|\"[^\"]*\"|'[^']*')*+>|</?[a-zA-Z][^>]*(?:>|\Z)", re.S)
_NAME = re.compile(r"</?([a-zA-Z][a-zA-Z0-9:-]*)")
_ATTRIBUTE = re.compile(r"([a-zA-Z][\w:-]*)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_SPACE = re.compile(r"\s+")
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")
#: Elements whose content is text of their own kind, up to their end tag.
RAW = frozenset("script style noscript template textarea title iframe svg math object canvas".split())
#: Elements that carry no article text.
OUT = frozenset("nav aside footer form button select dialog menu head".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
#: Roles and words of class or id that mark a part as no article text.
OUT_ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar toolbar".split())
OUT_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising alert banner breadcrumb breadcrumbs captcha comment comments consent cookie cookies copyright disqus footer gdpr "
    "header hidden legal login masthead menu modal nav navbar navigation newsletter notice notification overlay pager pagination popup promo promotion promoted recommended related replies "
    "reply respond search share sharing sidebar signup skip social sponsor sponsored subscribe subscription toolbar topbar widget".split()
)


#: Words that may stand beside one of OUT_WORDS in a class or id that says nothing else.
BESIDE = frozenset(
    "a area bar body bottom box btn button buttons col column container content count cta fixed full grid group head hero icon icons id in inline inner item items js large label left link links list mobile "
    "module mount outer panel right row section site sized slot small space sticky text thread title top unit wrap wrapper".split()
)
KEEP, DOUBT, OUT_MARK = range(3)
#: Zones.
NONE, MAIN, ARTICLE = range(3)
#: Neighbours that a page is aligned with, and how far away in the order of urls they may be.
NEIGHBOURS, REACH = 2, 6
#: Pages that share so much of their lines are alike: copies, or stubs on one template.
COPY = 0.9
#: A block inside an article whose text is links to this part is deleted if its line is shared.
LINKS = 0.5
#: Matches of lines up to which they are followed one by one.
MATCHES = 1 << 16
#: Pages of one window of the order.
WINDOW = 256


class _Open:
    __slots__ = ("name", "mark", "zone")

    def __init__(self, name: str, mark: int, zone: int):
        self.name, self.mark, self.zone = name, mark, zone


def _named(value: str, inside: bool) -> int:
    """What a class or id says: OUT_MARK if one of its names is made of OUT_WORDS and words BESIDE them, DOUBT if such a
    word is one of several.  An article's own header holds its title."""
    found = KEEP
    for name in value.split():
        words = {w.lower() for w in _WORD.findall(name)}
        out = words & OUT_WORDS - ({"header", "banner", "masthead"} if inside else set())
        if out:
            found = max(found, DOUBT if any(w not in OUT_WORDS and w not in BESIDE and not w.isdigit() for w in words) else OUT_MARK)
    return found


def _marks(tag: str, name: str, inside: bool) -> tuple[int, int]:
    """The mark of an element, and its zone."""
    attributes = {k.lower(): _html.unescape(a or b or c or "") for k, a, b, c in _ATTRIBUTE.findall(tag[len(name) + 1 :])} if len(tag) > len(name) + 2 else {}
    role = attributes.get("role", "").lower()
    said = max(_named(attributes.get("class", ""), inside), _named(attributes.get("id", ""), inside))
    comment = said == OUT_MARK and bool({w.lower() for w in _WORD.findall(attributes.get("class", "") + " " + attributes.get("id", ""))} & {"comment", "comments", "reply", "replies"})
    zone = ARTICLE if (name == "article" or attributes.get(
        "itemprop", "",
    ).lower() == "articlebody" or role == "article") and not comment else MAIN if name == "main" or role == "main" else NONE
    if zone or name in ("html", "body"):
        return KEEP, zone
    hidden = "hidden" in attributes or attributes.get("aria-hidden", "").lower() == "true" or "display:none" in attributes.get("style", "").replace(" ", "").lower()
    out = name in OUT or (name == "header" and not inside) or hidden or role in OUT_ROLES - ({"banner"} if inside else set())
    return OUT_MARK if out else said, NONE


def blocks(page: str | None) -> list[tuple[str, int, int, bool]]:
    """(text, mark, zone, mostly links) of each non-empty block of a page, in page order."""
    out: list[tuple[str, int, int, bool]] = []
    stack: list[_Open] = []
    parts: list[str] = []
    state = [KEEP, NONE, 0, 0]  # mark, zone, open links, characters inside links

    def flush() -> None:
        if parts:
            text = _SPACE.sub(" ", _html.unescape("".join(parts))).strip()
            if text:
                out.append((text, state[0], state[1], state[3] >= LINKS * len(text)))
            parts.clear()
        state[3] = 0

    def say(text: str) -> None:
        parts.append(text)
        state[3] += len(text) * (state[2] > 0)

    def settle() -> None:
        state[0], state[1] = (stack[-1].mark, stack[-1].zone) if stack else (KEEP, NONE)
        state[2] = sum(x.name == "a" for x in stack)

    page, at = page or "", 0
    while at < len(page):
        m = _TAG.search(page, at)
        if m is None:
            say(page[at:])
            break
        if m.start() > at:
            say(page[at : m.start()])
        at, tag = m.end(), m.group()
        if tag[1] in "!?":
            if tag.startswith("<![CDATA["):
                say(_html.escape(tag[9:].removesuffix("]]>")))
            continue
        name = _NAME.match(tag).group(1).lower()
        if tag[1] == "/":
            if name == "br":
                parts.append(" ")
                continue
            depth = next((i for i in range(len(stack) - 1, -1, -1) if stack[i].name == name), None)
            if name not in INLINE:
                flush()
            if depth is not None and not (name in INLINE and any(x.name not in INLINE for x in stack[depth + 1 :])):
                if name in INLINE and stack[depth].mark != state[0]:
                    flush()
                del stack[depth:]
                settle()
            continue
        if name in RAW:
            if not tag.endswith("/>"):
                end = re.compile(rf"</{name}\b[^>]*>", re.I).search(page, at)
                at = end.end() if end else len(page)
            parts.append(" ") if name not in ("script", "style") else None
            continue
        if name == "br":
            parts.append(" ")
            continue
        if name in VOID:
            if name == "hr":
                flush()
            continue
        if name not in INLINE:
            flush()
            closes = {"p"} | ({name} if name in ("li", "dt", "dd", "tr", "td", "th", "option") else set())
            for i in range(len(stack) - 1, -1, -1):
                if stack[i].name in closes:
                    del stack[i:]
                    break
                if stack[i].name not in INLINE:
                    break
            settle()
        mark, zone = _marks(tag, name, state[1] > NONE)
        if mark > state[0] and name in INLINE:
            flush()
        if tag.endswith("/>"):
            continue
        stack.append(_Open(name, max(state[0], mark), max(zone, state[1])))
        settle()
    flush()
    return out


def common(a: list[int], b: list[int]) -> set[int]:
    """Positions of ``a`` in a longest common subsequence of a and b.

    Equal ends are cut off.  Lines that are equal to few others are followed match by match (Hunt and Szymanski); where a
    line is repeated so often that matches are many, rows of differences are kept as bits instead.
    """
    lead = 0
    while lead < min(len(a), len(b)) and a[lead] == b[lead]:
        lead += 1
    tail = 0
    while tail < min(len(a), len(b)) - lead and a[-1 - tail] == b[-1 - tail]:
        tail += 1
    found = set(range(lead)) | set(range(len(a) - tail, len(a)))
    where: dict[int, list[int]] = {}
    for j in range(lead, len(b) - tail):
        where.setdefault(b[j], []).append(j - lead)
    at = [i for i in range(lead, len(a) - tail) if a[i] in where]
    many = sum(len(where[a[i]]) for i in at) > MATCHES + 8 * (len(a) + len(b))
    rows = [where[a[i]] for i in at]
    return found | {at[i] for i in (_by_bits(rows, len(b) - tail - lead) if many else _by_matches(rows))}


def _by_matches(rows: list[list[int]]) -> Iterator[int]:
    """Rows in a longest chain of ascending matches, given each row's ascending matches."""
    ends: list[int] = []
    links: list[tuple] = []
    for i, matches in enumerate(rows):
        for j in reversed(matches):
            k = bisect_left(ends, j)
            link = (i, links[k - 1] if k else None)
            if k == len(ends):
                ends.append(j), links.append(link)
            else:
                ends[k], links[k] = j, link
    link = links[-1] if links else None
    while link is not None:
        yield link[0]
        link = link[1]


def _by_bits(rows: list[list[int]], width: int) -> Iterator[int]:
    """The same by bits: bit j of a row is unset where the chain grows at j.  Every k-th row is kept, and those between are
    made again on the way back, so memory follows the square root of the rows."""
    whole = (1 << width) - 1
    masks: dict[int, int] = {}

    def mask(matches: list[int]) -> int:
        if len(matches) <= 64:
            return sum(1 << j for j in matches)
        if id(matches) not in masks:
            bits = bytearray(width // 8 + 1)
            for j in matches:
                bits[j >> 3] |= 1 << (j & 7)
            masks[id(matches)] = int.from_bytes(bits, "little")
        return masks[id(matches)]

    def step(v: int, matches: list[int]) -> int:
        u = v & mask(matches)
        return ((v + u) | (v - u)) & whole

    k = max(1, int(len(rows) ** 0.5))
    kept, v = [whole], whole
    for i, matches in enumerate(rows, 1):
        v = step(v, matches)
        if i % k == 0:
            kept.append(v)
    size, i, j, held, first = width // 8 + 1, len(rows), width, [], len(rows) + 1
    while i > 0 and j > 0:
        if i - 1 < first:  # make the rows from the last kept one before i - 1 up to i
            first = (i - 1) // k * k
            v, held = kept[(i - 1) // k], []
            held.append(v.to_bytes(size, "little"))
            for matches in rows[first:i]:
                v = step(v, matches)
                held.append(v.to_bytes(size, "little"))
        bit = lambda r: held[r - first][(j - 1) >> 3] >> ((j - 1) & 7) & 1  # noqa: B023, E731
        if bit(i):
            j -= 1
        elif not bit(i - 1):
            i -= 1
        else:
            i, j = i - 1, j - 1
            yield i


def template_lines(hashes: list[int], near: list[list[int]]) -> set[int]:
    """Positions of the lines that the nearest NEIGHBOURS pages share, copies of the page left out.

    A page with the same lines is a copy.  Pages with nearly the same lines are copies too, unless most neighbours are
    such: then it is a template that is longer than the pages' own texts.
    """
    aligned = [(common(hashes, other), other) for other in near if other != hashes]
    alike = [len(shared) >= COPY * max(len(hashes), len(other)) for shared, other in aligned]
    template = sum(alike) >= 2 and 2 * sum(alike) > len(aligned)
    used = [shared for (shared, _), same in zip(aligned, alike) if template or not same]
    return set().union(*used[:NEIGHBOURS])


def main_text(page: list[tuple[str, int, int, bool]], shared: set[int]) -> str:
    """The blocks that stay, given the positions of the lines that nearest pages share."""
    zone = max((z for _, mark, z, _ in page if mark < OUT_MARK), default=NONE)
    kept = []
    for i, (text, mark, z, links) in enumerate(page):
        if mark == OUT_MARK or z < zone:
            continue
        if i in shared and (zone == NONE or mark == DOUBT or links):
            continue
        kept.append(text)
    return "\n".join(kept)


def _hash(text: str) -> int:
    return xxhash.xxh3_64_intdigest(text.encode("utf8", "surrogatepass")) - (1 << 63)


def _shared_prefix(a: str, b: str) -> int:
    n = 0
    for x, y in zip(a, b):
        if x != y:
            break
        n += 1
    return n


def _pack(page: list[tuple[str, int, int, bool]]) -> bytes:
    raw = "\0".join(f"{mark}{zone}{links:d}{text}" for text, mark, zone, links in page).encode("utf8", "surrogatepass")
    return len(raw).to_bytes(8, "little") + pa.compress(raw, "zstd", asbytes=True)


def _unpack(data: bytes) -> list[tuple[str, int, int, bool]]:
    size = int.from_bytes(data[:8], "little")
    if not size:
        return []
    raw = pa.decompress(data[8:], size, "zstd", asbytes=True).decode("utf8", "surrogatepass")
    return [(x[3:], int(x[0]), int(x[1]), x[2] == "1") for x in raw.split("\0")]


def parsed(pages: DataFrame) -> DataFrame:
    """page_id, url, host, path, key, lines (hashes of the block texts), one and blocks (packed), a table in the shared
    folder: each page is parsed once."""
    host, path = host_and_path("url")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", host.alias("host"), path.alias("path"), F.xxhash64("page_id", "url", "html").alias("key"), "html")
    names = ["page_id", "url", "host", "path", "key"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [blocks(h) for h in column(b, "html").to_pylist()]
            lines = pa.array([[_hash(t) for t, *_ in page] for page in found], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays(
                [*(column(b, c) for c in names), lines, pa.array([1] * b.num_rows, pa.int64()), pa.array(map(_pack, found), pa.binary())],
                names=[*names, "lines", "one", "blocks"],
            )

    return arrow_table(rows, run, "page_id long, url string, host string, path string, key long, lines array<bigint>, one long, blocks binary", "html-parsed")


def shared_lines(pages: DataFrame) -> DataFrame:
    """key, shared: positions of the lines that a page's nearest pages by url share, for pages that share any.

    :param pages: the table of ``parsed``; equal pages count once.
    """
    lines = pages.select("host", "path", "page_id", "key", "lines", "one").dropDuplicates(["key"])
    ranked = global_offsets(lines, ["host", "path", "page_id", "key"], "one", "rank", "html-lines")
    # a page is decided in the window of its own rank, and is also shown to a window within REACH
    ends = F.array_distinct(F.array(*(F.floor((F.col("rank") + d) / WINDOW) for d in (-REACH, 0, REACH))))
    shown = ranked.select("key", "host", "path", "lines", "rank", F.explode(ends).alias("window")).where("window >= 0")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def decided() -> pa.RecordBatch:
            keys, found = [], []
            for i, (key, host, path, own, rank, window) in enumerate(held):
                if rank // WINDOW != window or not own:
                    continue
                beside = [(-_shared_prefix(path, held[j][2]), abs(i - j), held[j][3]) for j in range(max(0, i - REACH), min(len(held), i + REACH + 1)) if j != i and held[j][1] == host]
                shared = template_lines(own, [x[2] for x in sorted(beside, key=lambda x: x[:2])])
                if shared:
                    keys.append(key), found.append(sorted(shared))
            return pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(found, pa.list_(pa.int32()))], names=["key", "shared"])

        for b in batches:
            for row in zip(*(column(b, c).to_pylist() for c in ("key", "host", "path", "lines", "rank", "window"))):
                if held and held[0][5] != row[5]:
                    yield decided()
                    held = []
                held.append(row)
        if held:
            yield decided()

    dealt = shown.repartition("window").sortWithinPartitions("window", "rank")
    return dealt.mapInArrow(run, "key long, shared array<int>")


def main_texts(pages: DataFrame) -> DataFrame:
    """page_id, url and main text of every page (page_id, url, html; other columns are ignored)."""
    importable(pages.sparkSession)
    table = parsed(pages)
    shared = materialize(shared_lines(table), "html-shared").withColumnRenamed("key", "k")
    paired = table.join(shared, F.col("key") == F.col("k"), "left").select("page_id", "url", "blocks", "shared")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches):
            texts = [main_text(_unpack(data), set(at or ())) for data, at in zip(column(b, "blocks").to_pylist(), column(b, "shared").to_pylist())]
            yield pa.RecordBatch.from_arrays([column(b, "page_id"), column(b, "url"), pa.array(texts, pa.string())], names=["page_id", "url", "text"])

    return paired.mapInArrow(run, "page_id long, url string, text string")
