"""Main text of web pages by two passes of block rules.

The markup is cut into blocks at block-level tags. A block knows its length, how much of it is link text, how many
of its words are stop words, the elements it stands in, and whether they are page furniture (menus, headers, footers,
sidebars, notices, adverts, forms, reader comments: by tag, role, class or id, which alone can tell a comment from
the article) or an article element.
Pass 1 looks at each block alone: furniture and link-dense blocks are bad; long blocks with many stop words are
good; long blocks with few are bad, inside an article element undecided; blocks with some are nearly good; the rest
is short.
Pass 2 settles nearly good and short blocks by the nearest decided blocks before and after. Two of one label decide.
If only one is good, a heading before a good block is good; else the one with the more elements in common with the
block decides; if they have as many, a block is good in an article element or beside a good block of its own parent
element. Beside the end of the page only nearly good blocks follow a good one. The ends of an article element count
as good; within it furniture decides nothing about the text around it.
If a page has article elements, what is outside of them isn't main text. If it has none, elements that good blocks
stand in directly are treated like them, or, if no block is good either, the element with the most text that isn't
furniture or links.
"""

import html
import re
from collections.abc import Iterator
from dataclasses import dataclass, replace

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trackloom.llm.common import lean

TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:"[^"]*"|'[^']*'|[^"'>])*)(?:>|\Z)""", re.S)
ATTRIBUTE = re.compile(r"""([a-zA-Z-]+)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""")
SPACE = re.compile(r"\s+")
# fixed values: elements by their part in HTML
BLOCK = frozenset("address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 header hgroup hr html label legend li main menu nav ol optgroup option p pre search section select summary table tbody td textarea tfoot th thead tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template iframe svg math object canvas audio video head title textarea select".split())
RAW_ENDS = {tag: re.compile(rf"</{tag}\b[^>]*>" if tag != "head" else r"</head\b[^>]*>|(?=<body\b)", re.I) for tag in RAW}
FURNITURE = frozenset("nav footer aside form menu dialog button label search fieldset legend".split())
CLOSES = {"p": frozenset(["p"]), "li": frozenset(["li"]), "dt": frozenset(["dt", "dd"]), "dd": frozenset(["dt", "dd"]), "td": frozenset(["td", "th"]), "th": frozenset(["td", "th"]), "tr": frozenset(["tr", "td", "th"]), "option": frozenset(["option"])}
# fixed values: names that pages give to their furniture
NAMES = frozenset("ad ads adbox adslot advert adverts advertisement advertisements advertising sponsor sponsored sponsors promo promos promoted promotion banner banners sidebar sidebars rail nav navbar navigation menu menus breadcrumb breadcrumbs footer masthead comment comments commentlist disqus reply replies respond discussion cookie cookies consent gdpr notice notices alert alerts popup modal overlay newsletter subscribe subscription signup login search share sharing social related recommended recommendations widget widgets pagination pager toolbar skip copyright disclaimer hidden".split())
ROLES = frozenset("navigation banner contentinfo complementary search form menu menubar alert alertdialog dialog".split())
# fixed values: frequent function words of English, German, French and Spanish
STOP = frozenset("""a about after all also an and are as at be been but by can for from had has have he her his if in into is it its more no not of on or our she so than that the their them there they this to up was we were what when which who will with would you your
aber als am an auch auf aus bei bis das dass dem den der des die doch durch ein eine einem einen einer es für hat ich im in ist man mit nach nicht noch nur oder sein sich sie sind so über um und von vor war wenn wer wie wir zu zum zur
au aux avec ce ces comme dans de des du elle en est et il ils je la le les leur lui mais ne nous on ou où par pas plus pour qu que qui sa se ses son sont sur un une vous
al como con de del donde el ella en entre era es esta este la las lo los más me muy no o para pero por que se sin sobre son su sus también un una uno y ya""".split())
LONG, SHORT, DENSE_LINKS, MANY_STOPS, SOME_STOPS = 200, 70, 0.33, 0.30, 0.10
WORDS = re.compile(r"\w+")


@dataclass(slots=True)
class Block:
    text: str
    links: float
    furniture: bool
    article: int  # which article element, 0 for none
    heading: bool
    path: tuple[int, ...] = ()  # the elements it stands in, from the outermost to its own
    parent: str = ""  # the tag of the element around its own


def _names(attributes: str) -> tuple[set[str], dict[str, str]]:
    found = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in ATTRIBUTE.finditer(attributes)}
    words = set()
    for key in ("class", "id"):
        words.update(w for w in re.split(r"[^a-z0-9]+", re.sub(r"(?<=[a-z])(?=[A-Z])", "-", found.get(key, "")).lower()) if w)
    return words, found


def _is_furniture(tag: str, attributes: str, in_article: bool) -> bool:
    if tag in FURNITURE or tag == "header" and not in_article:
        return True
    if not attributes or tag in ("html", "body", "main"):
        return False
    words, found = _names(attributes)
    if words & NAMES or "header" in words and not in_article and not words & {"article", "entry", "post", "story"}:
        return True
    hidden = re.search(r"(?:^|\s)hidden(?:\s|=|$)", ATTRIBUTE.sub(" ", attributes)) or "hidden" in found
    return bool(hidden) or found.get("role", "").lower() in ROLES or found.get("aria-hidden") == "true" or "display:none" in found.get("style", "").replace(" ", "").lower()


def _is_article(tag: str, attributes: str) -> bool:
    if tag in ("article", "main"):
        return True
    if not attributes or tag not in ("div", "section", "td"):
        return False
    words, found = _names(attributes)
    return found.get("role") == "main" or found.get("itemprop") == "articleBody" or bool(words & {"article", "articlebody"})


def blocks_of(page: str) -> list[Block]:
    """The non-empty blocks of a page in order."""
    out: list[Block] = []
    stack: list[tuple[str, bool, int]] = [("", False, 0)]  # tag, furniture, article
    path: list[int] = [0]  # a number for each element of the stack
    text: list[str] = []
    linked, in_link, heading, articles, elements, at, n = 0, False, False, 0, 0, 0, len(page)
    unclosed: set[str] = set()  # raw elements that nothing closes from here on

    def flush() -> None:
        nonlocal linked, in_link
        joined = SPACE.sub(" ", "".join(text)).strip()
        text.clear()
        if joined:
            out.append(Block(joined, min(1.0, linked / len(joined)), stack[-1][1], stack[-1][2], heading, tuple(path), stack[max(0, len(stack) - 2)][0]))
        linked, in_link = 0, False

    def say(raw: str) -> None:
        nonlocal linked
        if raw:
            said = html.unescape(raw)
            text.append(said)
            if in_link:
                linked += len(SPACE.sub(" ", said).strip())

    for m in TAG.finditer(page):
        if m.start() < at:
            continue
        say(page[at : m.start()])
        at = m.end()
        if not m[2]:
            continue
        closing, tag = bool(m[1]), m[2].lower()
        if tag in RAW and not closing and not m[3].rstrip().endswith("/"):
            end = None if tag in unclosed else RAW_ENDS[tag].search(page, at)
            if end:
                at = end.end()
            elif tag not in ("head", "svg", "object"):
                at = n
            else:
                unclosed.add(tag)
            text.append(" ")
        elif tag == "a":
            in_link = not closing
        elif tag == "br":
            text.append(" ")
        elif tag in BLOCK:
            flush()
            if closing:
                for k in range(len(stack) - 1, 0, -1):
                    if stack[k][0] == tag:
                        del stack[k:], path[k:]
                        break
            else:
                if stack[-1][0] == "p" or stack[-1][0] in CLOSES.get(tag, ()):
                    stack.pop()
                    while tag == "tr" and stack[-1][0] in CLOSES["tr"]:
                        stack.pop()
                    del path[len(stack) :]
                if tag not in VOID:
                    _, bad, article = stack[-1]
                    bad = bad or _is_furniture(tag, m[3], article > 0)
                    if not bad and not article and _is_article(tag, m[3]):
                        articles += 1
                        article = articles
                    elements += 1
                    stack.append((tag, bad, article))
                    path.append(elements)
            heading = stack[-1][0] in ("h1", "h2", "h3", "h4", "h5", "h6")
    say(page[at:])
    flush()
    return out


GOOD, BAD, NEAR, SHORT_BLOCK, EDGE = "good", "bad", "near", "short", "edge"


def first_pass(b: Block) -> str:
    """A block's label by itself."""
    if b.furniture or b.links > DENSE_LINKS:
        return BAD
    words = WORDS.findall(b.text.lower())
    stops = sum(w in STOP for w in words) / max(1, len(words))
    if len(b.text) < SHORT:
        return BAD if b.links and not b.article else SHORT_BLOCK
    if stops >= MANY_STOPS:
        return GOOD if len(b.text) > LONG else NEAR
    if stops >= SOME_STOPS:
        return GOOD if len(b.text) > 2 * LONG else NEAR
    return SHORT_BLOCK if b.article else BAD


def _in_common(x: tuple[int, ...], y: tuple[int, ...]) -> int:
    return next((k for k, (a, b) in enumerate(zip(x, y, strict=False)) if a != b), min(len(x), len(y)))


def second_pass(blocks: list[Block], labels: list[str]) -> list[bool]:
    """Which blocks stay: undecided ones follow the nearest decided neighbours."""
    good_parents = {b.path[:-1] for b, label in zip(blocks, labels, strict=True) if label == GOOD}
    # what decides before each block and after it: the label and the place of the last decided block on that side
    before, after = _decided(blocks, labels, range(len(blocks))), _decided(blocks, labels, range(len(blocks) - 1, -1, -1))

    def settled(k: int) -> bool:
        (left, i), (right, j) = before[k], after[k]
        if left == right or GOOD not in (left, right):
            return left == GOOD
        if blocks[k].heading and right == GOOD:
            return True
        if EDGE in (left, right):
            return labels[k] == NEAR
        # an end of the article element (no block) is as near as the element itself, which all its blocks have in common
        closer = [0 if x is None else _in_common(blocks[k].path, blocks[x].path) for x in (i, j)]
        if None not in (i, j) and closer[0] != closer[1]:
            return (left, right)[closer[1] > closer[0]] == GOOD
        return blocks[k].article > 0 or blocks[k].path[:-1] in good_parents

    return [label == GOOD if label in (GOOD, BAD) else settled(k) for k, label in enumerate(labels)]


def _decided(blocks: list[Block], labels: list[str], order: range) -> list[tuple[str, int | None]]:
    """For each block the nearest decided one among those that come before it in the order."""
    out: list[tuple[str, int | None]] = [(EDGE, None)] * len(blocks)
    last, home = (EDGE, None), 0
    for k in order:
        b = blocks[k]
        if b.article != home:
            # an article element begins or ends: inside, its edge is good; outside, what was before counts
            if b.article:
                last = (GOOD, None)
            home = b.article
        out[k] = last
        if labels[k] in (GOOD, BAD) and not (home and b.furniture):
            last = (labels[k], k)
    return out


def main_elements(blocks: list[Block], labels: list[str]) -> list[tuple[int, ...]]:
    """The elements (their paths) that stand for article elements: those with a good block of their own, or, without any
    good block, the one whose own blocks have the most text that isn't furniture or links."""
    if GOOD in labels:
        return list(dict.fromkeys(b.path[:-1] for b, label in zip(blocks, labels, strict=True) if label == GOOD and b.parent in ("div", "section", "td")))
    size: dict[tuple[int, ...], int] = {}
    for b in blocks:
        if not b.furniture and b.links <= DENSE_LINKS:
            size[b.path[:-1]] = size.get(b.path[:-1], 0) + len(b.text)
    return [max(size, key=size.__getitem__)] if size else []


def main_text(page: str | None) -> str:
    """The main text's blocks joined by an empty line; empty if there are none."""
    blocks = blocks_of(page or "")
    labels = [first_pass(b) for b in blocks]
    whole = any(b.article for b in blocks)
    if not whole:
        homes = main_elements(blocks, labels)
        place, sizes = {home: k for k, home in enumerate(homes, 1)}, sorted({len(home) for home in homes})
        inside = [min((place[b.path[:n]] for n in sizes if b.path[:n] in place), default=0) for b in blocks]
        blocks = [replace(b, article=k) if k and not b.furniture else b for b, k in zip(blocks, inside, strict=True)]
        labels = [first_pass(b) for b in blocks]
    whole = whole and any(b.article and not b.furniture for b in blocks)
    return "\n\n".join(b.text for b, k in zip(blocks, second_pass(blocks, labels), strict=True) if k and (b.article or not whole))


def _run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [main_text(h.as_py()) for h in batch.column(2)]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], ["page_id", "url", "text", "n_chars"])


def extract(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text, n_chars (code points) of every row of pages.

    Null and empty pages have an empty text; broken markup is read as far as it goes, whole; null ids and urls and
    repeated rows stay as they are; an empty table gives no rows; further columns are not read."""
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    id_type = rows.schema["page_id"].dataType.simpleString()
    return rows.mapInArrow(lean(_run), f"page_id {id_type}, url string, text string, n_chars long")
