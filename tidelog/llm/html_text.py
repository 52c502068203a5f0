"""Main text of web pages by block rules in two passes.

A tolerant tokenizer cuts a page into blocks of text at block-level tags and keeps for each block
its link and stop-word density, length and what it stands in. Pass 1 calls a block good, bad,
near-good or short by these; pass 2 gives ambiguous blocks (near-good, short) the label of their
nearest decided neighbours. The rules and thresholds follow J. Pomikalek, "Removing Boilerplate and
Duplicate Content from Web Corpora" (2011).

Elements that are never main text (menus, footers, forms, scripts, notices, comments and so on, by
tag, role or class) are bad whatever they hold. If a page marks its main text (an article or main
element), only blocks in there can be good, more links are allowed there, and the element's own
edges count as good neighbours: what is ambiguous goes only between blocks that are bad.

Stop words of some languages are known. A page whose prose has few of them is in another language, and
its blocks are told by length and links alone.

Defined results: null and empty html give the empty text, empty tables an empty result; broken markup
is read as far as it goes, and a "<" that starts no tag is text; repeated rows give repeated rows; ties
don't occur; pages of any length are read whole, one at a time, in time that grows with their length;
columns besides page_id, url and html aren't read.
"""

from __future__ import annotations

import html
import re
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame

#: Pass 1: characters, and shares of characters in links and of words that are stop words.
SHORT_CHARS = 70
LONG_CHARS = 200
LINK_DENSITY = 0.2
LINK_DENSITY_MARKED = 0.5
STOPS_LOW = 0.30
STOPS_HIGH = 0.32
#: The language counts as known if so many words of a page's text outside of links are stop words.
STOPS_KNOWN = 0.12
#: A heading counts as main text if a good block begins within so many characters after it.
HEADING_REACH = 200

#: The most frequent function words of some languages.
STOP_WORDS = frozenset(
    """
    a about after all also an and any are as at be because been but by can could did do for from had has have he
    her him his how i if in into is it its just like may more most no not of on one only or other our out over she
    so some such than that the their them then there these they this to up was we were what when which who will
    with would you your
    alors au aux avec ce ces cette comme dans de des du elle elles en est et il ils je la le les leur lui mais me
    même mes moi mon ne nous on ou où par pas plus pour qu que qui sa se ses son sont sur ta te tu un une vos votre
    vous y à été être
    aber alle als am an auch auf aus bei bin bis das dass dem den der des die dies diese doch du durch ein eine
    einem einen einer er es für hat hatte ich ihr im in ist ja kann man mit nach nicht noch nur oder sein sich sie
    sind so über um und uns unter vom von vor war was wenn werden wie wir wird zu zum zur
    al algo como con cuando del desde donde el ella ellos entre era es esa ese esta este esto está fue ha hasta hay
    la las lo los me mi muy más ni no nos o para pero por porque que quien se ser si sin sobre son su sus también
    te tiene todo tu un una uno y ya
    ao com da das do dos e ele ela em foi isso mais mas na nas não nem num numa o os ou pela pelo quando seu sua são
    é che di gli il nel della delle dei non per più sono una anche come questo
    """.split()
)

_BLOCKS = frozenset(
    "address article aside blockquote body caption center col colgroup dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre section summary "
    "table tbody td tfoot th thead title tr ul".split()
)
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style textarea title noscript template iframe noframes xmp svg object audio video canvas map".split())
_NEVER = frozenset("head nav footer aside form button select option optgroup label input menu dialog fieldset legend frameset".split())
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: An end tag of another element doesn't close these.
_WALLS = frozenset("html body article main section div table td th nav aside header footer form ul ol dl blockquote figure details".split())
#: A start tag of these ends an open one of the same group first.
_ENDS_OPEN = {"p": {"p"}, "li": {"li", "p"}, "dt": {"dt", "dd", "p"}, "dd": {"dt", "dd", "p"}, "tr": {"tr", "td", "th", "p"}, "td": {"td", "th", "p"}, "th": {"td", "th", "p"}, "option": {"option"}}
_ENDS_P = _BLOCKS - {"p", "body", "html", "head", "title", "option", "optgroup", "caption", "col", "colgroup", "tbody", "tfoot", "thead"}

#: Words of class names and ids that mark what isn't main text, if all other words of the name are neutral.
_BAD_NAMES = frozenset(
    "ad ads advert adverts advertisement advertising adsense adslot banner sponsor sponsored sponsors promo promotion promoted sidebar aside rail nav "
    "navbar navigation menu menus submenu topbar breadcrumb breadcrumbs footer foot footnav masthead comment comments commentlist disqus replies "
    "respond cookie cookies consent gdpr notice notices notification alert popup modal overlay newsletter subscribe subscription signup signin login "
    "share sharing social related recommended recommendations widget widgets pagination pager toolbar skip hidden copyright legal disclaimer "
    "paywall teaser teasers outbrain taboola search searchform form".split()
)
_NEUTRAL_NAMES = frozenset(
    "site page web global top bottom left right upper lower outer inner main primary secondary header head title box area block blocks bar strip "
    "zone slot unit container wrapper wrap holder panel section group list lists item items link links button buttons icon icons text content "
    "post posts article articles story stories entry news mobile desktop sticky fixed floating small large big mini first last col column row "
    "grid inline in to us up down on by for your and new wp the email mail policy image img logo count thread reply user reader readers wide "
    "narrow full half message msg info component module".split()
)
_BAD_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar note status".split())
_MAIN_NAMES = frozenset("article articlebody article-body article-content post-content post-body entry-content main-content story-body content main story entry post".split())
#: Names beside "header" that mark the head of the article, not of the page.
_TITLE_NAMES = frozenset("article post entry story content title".split())

_TOKEN = re.compile(
    r"<!--(?:.*?-->|.*\Z)|<!\[CDATA\[.*?\]\]>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*\"|'[^']*')*+)>|<[!?/][^>]*>|[^<]++|<",
    re.S,
)
_ATTRIBUTE = re.compile(r"([^\s=/>\"']+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
_NAME_PARTS = re.compile(r"[a-z0-9]+")
_WORD = re.compile(r"\w+")
_HIDES = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden")


@dataclass
class Block:
    text: str
    links: int
    heading: bool
    never: bool
    main: int | None
    label: str = ""
    stops: tuple[int, int] | None = None
    """How many of its words are stop words, and how many it has; counted once."""


def _attributes(source: str) -> dict[str, str]:
    return {m[1].lower(): html.unescape(m[2] or m[3] or m[4] or "") for m in _ATTRIBUTE.finditer(source)} if source.strip(" /\n\t") else {}


def _marks(tag: str, attributes: dict[str, str], in_main: bool) -> tuple[bool, int]:
    """Whether what's in the element is never main text; and how surely it holds the main text (0: no)."""
    if tag in _NEVER or tag == "header" and not in_main:
        return True, 0
    if not attributes:
        return False, {"article": 3, "main": 2}.get(tag, 0)
    if "hidden" in attributes or attributes.get("aria-hidden") == "true" or _HIDES.search(attributes.get("style", "").lower()):
        return True, 0
    if attributes.get("role", "").lower() in _BAD_ROLES:
        return True, 0
    names = [n for n in f"{attributes.get('class', '')} {attributes.get('id', '')}".split()]
    if tag not in ("html", "body", "main"):
        for name in names:
            if tag == "article" and name.lower() not in _BAD_NAMES and not name.lower().startswith("comment"):
                continue  # themes put topics and tags into its class names
            apart = re.sub(r"(?<=[a-z0-9])(?=[A-Z])", "-", name).lower()
            parts = _NAME_PARTS.findall(apart)
            if parts and not _BAD_NAMES.isdisjoint(parts) and all(p in _BAD_NAMES or p in _NEUTRAL_NAMES or p.isdigit() for p in parts) and parts[0] != "no":
                return True, 0
            if not in_main and "header" in parts and _TITLE_NAMES.isdisjoint(parts) and tag not in _HEADINGS:
                return True, 0
    if tag == "article":
        return False, 3
    if tag == "main" or attributes.get("role") == "main" or attributes.get("itemprop", "").lower() == "articlebody":
        return False, 2
    return False, int(tag in ("div", "section", "td") and any(n.lower() in _MAIN_NAMES for n in names))


def blocks(source: str) -> list[Block]:
    """The blocks of a page with any text, in order; the number in main tells marked elements apart."""
    found: list[Block] = []
    parts: list[str] = []
    linked: list[str] = []
    stack: list[tuple[str, bool, int | None]] = []
    marked: list[int] = []  # how surely each marked element holds the main text
    breaks, depth_a = 0, 0

    def flush() -> None:
        if parts:
            text = " ".join(html.unescape("".join(parts)).split())
            if text:
                _, never, main = stack[-1] if stack else ("", False, None)
                links = len(" ".join(html.unescape("".join(linked)).split()))
                found.append(Block(text, links, any(t in _HEADINGS for t, _, _ in stack[-4:]), never, main))
            parts.clear()
            linked.clear()

    def close(tag: str, walls: frozenset | set) -> bool:
        for i in range(len(stack) - 1, -1, -1):
            if stack[i][0] == tag:
                del stack[i:]
                return True
            if stack[i][0] in walls:
                return False
        return False

    at, size = 0, len(source)
    while at < size:
        m = _TOKEN.match(source, at)
        at = m.end()
        token, tag = m[0], (m[2] or "").lower()
        if not tag:
            if token[0] != "<" or token == "<":
                parts.append(token)
                if depth_a:
                    linked.append(token)
                if breaks and not token.isspace():
                    breaks = 0
            elif token.startswith("<![CDATA["):
                parts.append(html.escape(token[9:-3]))
            continue
        if tag == "br":
            breaks += 1
            flush() if breaks > 1 else parts.append(" ")
            continue
        if m[1]:
            if tag in _BLOCKS:
                flush()
            if tag == "a":
                depth_a = max(0, depth_a - 1)
            close(tag, _WALLS if tag not in _WALLS else {"html", "body"} - {tag})
            continue
        if tag in _RAW:
            end = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(source, at)
            if tag in _BLOCKS or tag in ("iframe", "textarea", "object", "video", "audio", "svg"):
                flush()
            # an element that is never closed takes the rest of the page only if browsers read it so
            at = end.end() if end else (size if tag in ("script", "style", "textarea", "title", "iframe", "xmp", "noframes") else at)
            continue
        if tag in _BLOCKS:
            flush()
            for open_tag in _ENDS_OPEN.get(tag, {"p"} if tag in _ENDS_P else ()):
                close(open_tag, _WALLS - {open_tag})
        if tag == "a":
            depth_a += 1
        if tag in _VOID or token.endswith("/>") and tag not in _BLOCKS:
            continue
        _, never, main = stack[-1] if stack else ("", False, None)
        if not never:
            never, sure = _marks(tag, _attributes(m[3]), main is not None)
            if sure and not never and (main is None or sure > marked[main]):
                marked.append(sure)
                main = len(marked) - 1
        if tag in _BLOCKS or never:
            if never and tag not in _BLOCKS:
                flush()
            depth_a = 0 if tag in _WALLS else depth_a
        stack.append((tag, never, main))
    flush()
    sure = {b.main: marked[b.main] for b in found if b.main is not None and not b.never}
    if sure:
        best = max(sure.values())
        for b in found:
            if b.main is None or marked[b.main] < best:
                b.main = None
        for b in found:
            b.never = b.never or b.main is None
    return found


def _stop_words(b: Block) -> tuple[int, int]:
    if b.stops is None:
        words = _WORD.findall(b.text.lower())
        b.stops = sum(w in STOP_WORDS for w in words), len(words)
    return b.stops


def known_language(found: list[Block]) -> bool:
    """Whether the text that could be main text has the stop words of a language that is known."""
    counts = [_stop_words(b) for b in found if not b.never and b.links <= LINK_DENSITY * len(b.text)]
    return sum(s for s, _ in counts) >= STOPS_KNOWN * sum(n for _, n in counts)


def first_pass(b: Block, known: bool = True) -> str:
    stops, words = _stop_words(b)
    share = stops / words if known and words else 1.0
    density = b.links / len(b.text)
    marked = b.main is not None
    if b.never or density > (LINK_DENSITY_MARKED if marked else LINK_DENSITY):
        return "bad"
    if not marked and "©" in b.text:
        return "bad"
    if len(b.text) < SHORT_CHARS:
        return "bad" if b.links and not marked else "short"
    if share >= STOPS_HIGH:
        return "good" if len(b.text) > LONG_CHARS else "near-good"
    return "near-good" if share >= STOPS_LOW or marked else "bad"


def classify(found: list[Block]) -> None:
    """Sets each block's label to good or bad."""
    known = known_language(found)
    first = [first_pass(b, known) for b in found]
    n = len(found)

    def nearest(labels: list[str], stop_at: set[str], order) -> list[str]:
        """The label of the nearest block before each one, in an order, that has one of these; what
        stands around marked elements is skipped, and their edges are good."""
        out, now = [""] * n, {None: "bad"}
        for i in order:
            inside = found[i].main
            out[i] = now.setdefault(inside, "good")
            if labels[i] in stop_at:
                now[inside] = labels[i]
        return out

    def around(labels: list[str], stop_at: set[str]) -> tuple[list[str], list[str]]:
        return nearest(labels, stop_at, range(n)), nearest(labels, stop_at, range(n - 1, -1, -1))

    labels = list(first)
    decided = {"good", "bad"}
    before, after = around(first, decided)
    near_before, near_after = around(first, decided | {"near-good"})
    for i, b in enumerate(found):
        if first[i] == "short":
            sides = {before[i], after[i]}
            near = near_before[i] if before[i] == "bad" else near_after[i]
            labels[i] = "good" if sides == {"good"} or len(sides) == 2 and (b.main is not None or near == "near-good") else "bad"
    before, after = around(labels, decided)
    for i in range(n):
        if labels[i] == "near-good":
            labels[i] = "bad" if before[i] == after[i] == "bad" else "good"
    for i, b in enumerate(found):
        if b.heading and labels[i] == "bad" and first[i] != "bad":
            reach, j = 0, i + 1
            while j < n and reach <= HEADING_REACH and labels[i] == "bad":
                if labels[j] == "good" and found[j].main == b.main:
                    labels[i] = "good"
                reach += len(found[j].text)
                j += 1
    for b, label in zip(found, labels):
        b.label = label


def main_text(source: str | None) -> str:
    """The good blocks of a page in order, one a line."""
    found = blocks(source or "")
    classify(found)
    return "\n".join(b.text for b in found if b.label == "good")


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every page."""

    def run(batches):
        for batch in batches:
            texts = [main_text(h) for h in batch.column("html").to_pylist()]
            cols = [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())]
            yield pa.RecordBatch.from_arrays(cols, names=["page_id", "url", "text", "n_chars"])

    kind = pages.schema["page_id"].dataType.simpleString()
    return pages.select("page_id", "url", "html").mapInArrow(run, f"page_id {kind}, url string, text string, n_chars long")
