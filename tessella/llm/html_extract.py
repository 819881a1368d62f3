"""Main text of web pages by two-pass block rules: stop words, length and links classify blocks, neighbours decide the rest.

A page is cut into blocks at block-level tags, with HTML's rules for end tags that may be left out. Text inside navigation,
headers, footers, asides, forms, scripts, styles and elements whose class or id names an advert, menu, notice, comments and the
like is no block. The first pass labels every block: "bad" where links make up much of it, "good" where it is long and has many
stop words, "near" where it has less of that, "short" else. A stated article (or main) element is one more sign: inside it, less
length and fewer stop words are enough. On a page that has hardly any of the listed stop words, as in other languages, length
and links decide alone. In the second pass near and short blocks take the label of the nearest decided neighbours.
Where these differ, near blocks are good, and short ones inside an article or heading a good block;
where there are none, all are, if no bad block stands near them.

What stands outside of an article is left out, unless good blocks are there alone. Where no block is good, as when all paragraphs
of a page are short, near blocks are the good ones. Inside an article, a sentence that goes on after its link is undecided, however
long the link is.

Layouts have such names too ("content-sidebar-wrap"). So a name hides an article that stands inside its element only if the page shows a
long block elsewhere, or more text than such articles have; if not, that article with the headings beside it is what is shown. Names inside the article, and an article that is itself named as comments are, stay
hidden. On a page that shows nothing, the outermost named element does not hide what it holds if a first-level heading is in it.

Character references are decoded, white space inside a block becomes one space, blocks are joined in page order by one space.
Nulls and edges: a null or empty page has an empty text; a tag that the page's end cuts off is no text, and neither is what
follows an unclosed comment or script; a quote that is not closed ends with its tag. The time is linear in the page's length.
Every row gives one row; other columns are not read. Empty tables give empty results.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from tessella.llm import arrow_words as aw

# Element names as HTML defines them.
BLOCKS = frozenset(
    "address article aside blockquote body br button caption center col colgroup dd details dialog dir div dl dt fieldset figcaption "
    "figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav noframes ol optgroup option p pre "
    "section select summary table tbody td textarea tfoot th thead title tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HIDDEN = frozenset("head title nav header footer aside form button select textarea script style noscript template iframe object svg menu dialog".split())
RAW = {name: re.compile(rf"</{name}\b", re.I) for name in "script style textarea title noscript template iframe".split()}
IN_HEAD = frozenset("base link meta title style script noscript template head html".split())
CLOSES_P = frozenset(
    "address article aside blockquote center details dialog dir div dl dd dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header "
    "hgroup hr li main menu nav ol p pre section table ul".split()
)
_P = (("p",), ("button", "table", "td", "th", "caption", "object", "template"))
_LI, _DD = (("li",), ("ul", "ol", "menu")), (("dd", "dt"), ("dl",))
#: A start tag -> which open elements it closes, if they stand within the last open element of the second list.
CLOSES = {
    **dict.fromkeys(CLOSES_P, (_P,)),
    "li": (_LI, _P),
    **dict.fromkeys(("dd", "dt"), (_DD, _P)),
    **dict.fromkeys(("td", "th"), ((("td", "th", "caption"), ("table", "tr")),)),
    "tr": ((("tr", "caption"), ("table",)),),
    **dict.fromkeys(("thead", "tbody", "tfoot"), ((("thead", "tbody", "tfoot", "tr", "caption"), ("table",)),)),
    "option": ((("option",), ("select", "optgroup")),),
    "optgroup": ((("optgroup", "option"), ("select",)),),
}
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Words of a class or id that name what is not the article.
NAMES = frozenset(
    "ad ads advert adverts advertisement banner breadcrumb breadcrumbs comment comments consent cookie cookies disqus login menu modal nav "
    "navbar navigation newsletter pager pagination popup promo replies sidebar signup sponsor sponsored subscribe".split()
)
#: Words that do so only if no word names the article: "share", but not "post-share".
WEAK = frozenset("copyright footer header notice notices related reply share sharing skip social toolbar widget".split())
ARTICLE = frozenset("article body content entry main page post story text".split())
#: Words that make a name a state: "comments-enabled" says something of the article, not of comments, on an element that names the article too.
STATES = frozenset("active closed disabled enabled free has hidden no off on open with without".split())
#: Frequent function words of the languages at hand.
STOP = frozenset(
    "the of and to a in is that it for was on are with be by this as at from or an have not they which one you were all there would "
    "le la les des du de un une et est que qui dans en pour sur pas avec au aux il elle ce se ne plus son par "
    "der die das und ist von zu den mit ein eine für auf dem nicht sich des im auch als es an werden aus er hat bei "
    "el los las y del una por con no se para su al lo como más o pero sus le ha me si sin".split()
)
MAX_LINKS, SHORT, LONG, LOW, HIGH = 0.2, 70, 200, 0.15, 0.3
#: What ends a sentence, and characters outside of links that one needs.
ENDS, LOOSE = ".!?\u2026\u3002", 8
#: Below this share of stop words in all its blocks, a page is in no listed language.
KNOWN = 0.05

TAG = re.compile(r"<(?:(!--)|([!?])|(/?)([a-zA-Z][^\s/>]*))")
PLAIN = re.compile(r"[^<>\"']*>")
NEXT = re.compile(r">|=\s*([\"'])")
NAMED = re.compile(r"(?:^|\s)(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
GAP = re.compile(r"\s+")


def _names(attributes: str) -> bool:
    """Whether the class, id or role of a tag names what is not the article."""
    named = stated = article = False
    for m in NAMED.finditer(attributes):
        for token in (m[1] or m[2] or m[3] or "").lower().split():
            words = set(re.split(r"[^a-z]+", token))
            if words & NAMES or (words & WEAK and not words & ARTICLE):
                stated |= bool(words & STATES)
                named |= not words & STATES
            else:
                article |= bool(words & ARTICLE)
    return named or (stated and not article)


def _tag_end(page: str, at: int) -> int:
    """The place after the tag whose attributes begin at `at`; -1 if the page ends before."""
    m = PLAIN.match(page, at)
    if m:
        return m.end()
    size = len(page)
    while m := NEXT.search(page, at):
        if not m[1]:
            return m.end()
        shut = page.find(m[1], m.end())
        if shut < 0 or (shut + 1 < size and page[shut + 1] not in " \t\r\n\f/>"):
            return page.find(">", m.end()) + 1 or -1  # the quote is not closed
        at = shut + 1
    return -1


#: What is known of a block when it is cut: shown; in an article that only names around it hide; hidden by one name; hidden.
SHOWN, WRAPPED, NAMED_ONCE, GONE = range(4)


class Block:
    __slots__ = ("text", "linked", "inside", "heading", "label", "status", "open_end", "title")

    def __init__(self, text: str, linked: int, inside: bool, heading: bool, status: int = SHOWN, open_end: bool = True, title: bool = False):
        self.text, self.linked, self.inside, self.heading, self.label = text, linked, inside, heading, ""
        self.status, self.open_end, self.title = status, open_end, title


def blocks(page: str) -> list[Block]:
    """The blocks of a page that no element rules out, in page order, with what names say of them."""
    out: list[Block] = []
    stack: list[tuple[str, bool, bool, bool]] = []  # open elements; whether its kind, or its name, hides its content; whether it is an article
    places: dict[str, list[int]] = {}  # of the open elements, by name
    around: list[tuple[int, bool]] = []  # of the open articles: names outside of them and of articles around; whether they are named themselves
    text: list[str] = []
    status = GONE
    hidden = links = linked = named = at = 0  # named: open elements with names, within the innermost article
    in_link = False

    def now() -> int:
        """The status of text at this place."""
        if hidden:
            return GONE
        outside = around[-1][0] if around else 0
        if not named and not outside:
            return SHOWN
        if around and not named and not around[-1][1]:
            return WRAPPED
        return NAMED_ONCE if named + outside == 1 and not around else GONE

    def flush() -> None:
        nonlocal linked, status
        joined = GAP.sub(" ", html.unescape("".join(text))).strip()
        if joined:
            out.append(Block(joined, linked, bool(around), any(places.get(h) for h in HEADINGS), status, not in_link, bool(places.get("h1"))))
        text.clear()
        linked, status = 0, GONE

    def close(to: int) -> None:
        nonlocal hidden, links, named
        while len(stack) > to:
            name, hides, has_name, article = stack.pop()
            places[name].pop()
            hidden -= hides
            links -= name == "a"
            if article:
                outside, _ = around.pop()
                named = outside - (around[-1][0] if around else 0)
            named -= has_name

    last = lambda names: max((places[n][-1] for n in names if places.get(n)), default=-1)
    size = len(page)
    while at < size:
        m = TAG.search(page, at)
        piece = page[at : m.start() if m else size]
        if not hidden and piece and (own := now()) <= status and own < GONE:
            blank = piece.isspace()
            if own < status and not blank:  # what is less hidden makes the block
                text.clear()
                linked, status = 0, own
            text.append(piece)
            if not blank:
                linked += len(" ".join(piece.split())) if links else 0
                in_link = links > 0
        if not m:
            break
        at = m.end()
        if m[1] or m[2]:
            shut = "-->" if m[1] else "]]>" if page.startswith("[CDATA[", at) else ">"
            end = page.find(shut, at)
            at = end + len(shut) if end >= 0 else size
            continue
        end = _tag_end(page, at)
        if end < 0:
            break
        attributes, at, name = page[at : end - 1], end, m[4].lower()
        if name in BLOCKS and not hidden:
            flush()
        if m[3]:
            if places.get(name):
                close(places[name][-1])
            continue
        if places.get("head") and name not in IN_HEAD:
            close(places["head"][-1])
        for gone, within in CLOSES.get(name, ()):
            border = last(within)
            found = [places[g][-1] for g in gone if places.get(g) and places[g][-1] > border]
            if found:
                close(min(found))
        if name in VOID or (name == "svg" and attributes.endswith("/")):
            continue
        hides, has_name = name in HIDDEN, bool(attributes) and name not in ("body", "html") and _names(attributes)
        article = name in ("article", "main") and not hidden
        if article:
            around.append((named + (around[-1][0] if around else 0), has_name))
            named = has_name = 0  # the name of an article does not hide it
        places.setdefault(name, []).append(len(stack))
        stack.append((name, hides, bool(has_name), article))
        hidden += hides
        links += name == "a"
        named += bool(has_name)
        if name in RAW:
            m = RAW[name].search(page, at)
            at = m.start() if m else size
    flush()
    return out


def density(text: str) -> float:
    """The share of stop words."""
    words = text.lower().split()
    return sum(w.strip(".,;:!?") in STOP for w in words) / len(words)


def label(block: Block, share: float, known: bool) -> str:
    """good, bad, or near or short, which are undecided. `share`: of stop words; `known`: whether the page's language is listed."""
    size, inside = len(block.text), block.inside
    if block.linked > MAX_LINKS * size:
        sentence = inside and block.open_end and block.text[-1] in ENDS and size - block.linked >= LOOSE
        return "near" if sentence else "short" if block.heading else "bad"
    if size < LONG and not inside and ("\xa9" in block.text or block.text.lower().startswith("copyright")):
        return "bad"
    if size < SHORT:
        return "short"
    if not known:
        return "good" if inside or size > LONG else "near"
    if share >= HIGH:
        return "good" if inside or size > LONG else "near"
    if share >= LOW:
        return "good" if inside and size > LONG else "near"
    return "near" if inside else "bad" if size > LONG else "short"


def _second_pass(found: list[Block]) -> None:
    """Decide near and short blocks by their nearest decided neighbours."""
    first = [b.label if b.label in ("good", "bad") else None for b in found]
    before, after = [None] * len(found), [None] * len(found)
    for order, near in ((range(len(found)), before), (range(len(found) - 1, -1, -1), after)):
        last = None
        for i in order:
            near[i] = last
            last = first[i] or last
    for b, x, a, z in zip(found, first, before, after):
        if x is None:
            around = {a, z} - {None}
            if len(around) == 1:
                b.label = around.pop()
            else:
                # nothing decided, or different neighbours
                b.label = "good" if not around or b.label == "near" or b.inside or (b.heading and z == "good") else "bad"


def _chosen(found: list[Block]) -> str:
    """The text of the good blocks."""
    shares = [density(b.text) for b in found]
    n_words = [len(b.text.split()) for b in found]
    known = sum(s * n for s, n in zip(shares, n_words)) >= KNOWN * sum(n_words)
    for b, share in zip(found, shares):
        b.label = label(b, share, known)
    article = [b for b in found if b.inside]
    if any(b.label != "bad" for b in article) and (any(b.label == "good" for b in article) or not any(b.label == "good" for b in found)):
        found = article
    if not any(b.label == "good" for b in found):
        for b in found:
            b.label = "good" if b.label == "near" else b.label
    _second_pass(found)
    return " ".join(b.text for b in found if b.label == "good")


def main_text(page: str | None) -> str:
    found = blocks(page or "")
    shown, wrapped = ([b for b in found if b.status == s] for s in (SHOWN, WRAPPED))
    length = lambda bs: sum(len(b.text) for b in bs)
    if length(wrapped) > length(shown) and not any(len(b.text) >= LONG and b.linked <= MAX_LINKS * len(b.text) for b in shown):
        shown = [b for b in found if b.status == WRAPPED or (b.status == SHOWN and b.inside and b.heading)]
    text = _chosen(shown)
    if not text and any(b.title for b in found if b.status == NAMED_ONCE):
        text = _chosen([b for b in found if b.status <= NAMED_ONCE])
    return text


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for piece in aw.pieces(batch, "html"):
            texts = [main_text(h) for h in piece.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [piece.column("page_id"), piece.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                names=["page_id", "url", "text", "n_chars"],
            )


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars for every row."""
    kinds = {c: pages.schema[c].dataType.simpleString() for c in ("page_id", "url")}
    return pages.select("page_id", "url", "html").mapInArrow(_extract, f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars long")
