"""HTML extraction by line-block distribution.

Markup is stripped to lines, one for each block element's own text, and every line gets
a weight: its text less what is link text, up to ``FULL`` characters, and a constant for
standing in a block of its own; nothing, if it is one link. Marks only multiply weights,
and no line is left out before: lines of a marked article (an article or main element)
weigh more, those around one less, and lines of menus, headers, footers, sidebars,
notices, adverts, forms, comments and other parts that tags, roles, class names or hiding
set apart weigh so little that not even a long one inside the article weighs as much as
the shortest line of the article's own. Scripts, styles and other raw parts have no text.

Weights are summed over sliding windows of ``WINDOW`` lines that aren't set apart, with
what stands between. The sums' course decides, on every page: the main text begins at a
surge, where a sum passes ``SURGE``, from the first line of weight in that window, and
ends at a dive, where a sum falls under ``DIVE`` of it; there may be several surges and
dives. Lines between them that weigh as much as a dive are kept. A single line that is
one link stays in a marked article's text, as links in the text do; several in a row are
a list. A page whose sums all stay under ``NOTHING`` has no main text.

Defined results: null, empty and textless pages have empty text; unclosed elements
and comments reach to the end of their surroundings; each row gives one row,
repeated rows equal ones; null ids and urls stay null; an empty table gives an
empty result; extra columns are ignored. Whole pages are used.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallygrid.llm.words import slices

#: Lines in a window, the sum of weights that makes a surge, and the share of it under which a sum dives.
WINDOW, SURGE, DIVE = 3, 120, 1 / 12
#: What a block of text weighs beside its length, and the most characters that count.
BLOCK, FULL = 15, 300
#: Factors for lines of a marked article, for lines around it, and for lines of parts set apart.
MARKED, AROUND, APART = 3, 0.3, 0.002
#: No window of lines that are all set apart weighs so much.
NOTHING = 6
#: A line that begins like a legal one is a paragraph from this length on.
LONG = 80

# Names of HTML elements.
RAW = ("script", "style", "noscript", "template", "textarea", "title", "iframe", "svg", "math", "canvas", "object", "audio", "video", "xmp")
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = set("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol option optgroup p pre search section select summary table tbody tfoot thead tr ul".split())
SET_APART = set("nav menu aside footer form button select head dialog fieldset datalist search".split())
#: Words in class names, ids and roles of parts that aren't the article.
PARTS = set(
    "ad ads adbox adslot adsense advert adverts advertisement advertisements advertising adverts sponsor sponsored sponsors promo promos promoted promotion "
    "banner banners cookie cookies cookiebar consent gdpr notice notices alert alerts warning announcement paywall "
    "sidebar sidebars side rail aside complementary nav navbar navigation menu menus menubar breadcrumb breadcrumbs toc toolbar topbar tabs "
    "footer foot colophon copyright legal disclaimer header masthead contentinfo skip search searchbox "
    "comment comments commentlist disqus discussion respond reply replies reactions review reviews feedback "
    "share sharing social follow related recommended recommendations trending popular teaser teasers outbrain taboola "
    "newsletter subscribe subscription signup login register form popup modal overlay lightbox pagination pager tags".split()
)
#: Words that make a name the article's after all when they close it, that take the sense away, and states that are no parts.
CONTENT = set("article body content entry main page post story text wrapper container layout".split())
WITHOUT = set("has with no without is js tag category type format status".split())
STATES = set("open closed enabled disabled on off active".split())
#: What a title's box is called.
TITLES = set("header masthead".split())

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(?P<raw>" + "|".join(RAW) + r")\b(?:[^>\"']|\"[^\"]*\"|'[^']*')*(?:(?<=/)>|>.*?(?:</(?P=raw)\s*>|\Z))"
    r"|<(?P<close>/?)(?P<name>[a-z][^\s/>]*)(?P<rest>(?:[^>\"']|\"[^\"]*\"|'[^']*')*)>"
    r"|<[!?/][^>]*(?:>|\Z)",
    re.S | re.I,
)
ATTRIBUTE = re.compile(r"""([^\s"'=<>/]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
NAME_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
LEGAL = re.compile(r"\s*(?:©|\(c\)\s|copyright\b|all rights reserved)", re.I)


def _names_part(value: str, marked: bool, single: bool) -> bool:
    """Whether a class, id or role value names a part that isn't the article.

    ``marked``: inside an article, where headers hold its title. ``single``: names of
    several words don't count, as articles carry those of their topics and states.
    """
    for name in value.split():
        words = [w.lower() for w in NAME_PARTS.findall(name)]
        if not words or WITHOUT & set(words) or words[-1] in STATES or single and len(words) > 1:
            continue
        if words[-1] in TITLES and (marked or len(words) > 1 and words[0] in CONTENT):
            continue
        if words[-1] in PARTS or words[0] in PARTS and not (len(words) > 1 and words[-1] in CONTENT):
            return True
    return False


def set_apart(name: str, rest: str, marked: bool) -> bool:
    """Whether an element with these attributes holds no article text. ``marked``: it stands inside the article."""
    if name in SET_APART or name == "header" and not marked:
        return True
    if name in ("html", "body") or not rest.strip():
        return False
    for key, *values in ATTRIBUTE.findall(rest):
        key, value = key.lower(), "".join(values)
        if key == "hidden" or key == "aria-hidden" and value.lower() == "true" or key == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
            return True
        if key in ("class", "id", "role") and name != "main" and _names_part(value, marked, name == "article"):
            return True
    return False


def lines_of(page: str) -> list[tuple[str, int, bool, bool]]:
    """(text, characters in links, in the article, in a part set apart) of the page's lines."""
    lines: list[tuple[str, int, bool, bool]] = []
    pieces: list[str] = []
    linked = marked = anchors = 0
    stack: list[tuple[str, int]] = []  # open elements that matter, with what they do
    apart = 0

    def end_line() -> None:
        nonlocal linked
        if pieces:
            text = " ".join(html.unescape("".join(pieces)).split())
            if text:
                lines.append((text, linked, marked > 0, apart > 0))
            pieces.clear()
        linked = 0

    def add(text: str) -> None:
        nonlocal linked
        pieces.append(text)
        if anchors:
            linked += len(text.strip())

    at = 0
    for token in TOKEN.finditer(page):
        if token.start() > at:
            add(page[at : token.start()])
        at = token.end()
        name = (token["name"] or "").lower()
        if not name:
            if token["raw"]:
                pieces.append(" ")
            continue
        if name == "a":
            anchors = 0 if token["close"] else 1
            continue
        if name in ("br", "td", "th"):
            pieces.append(" ")
            continue
        if name in BLOCKS:
            end_line()
        if token["close"]:
            # close up to the innermost element of that name, but never out of an article by a smaller one's end
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == name:
                    for _, does in stack[k:]:
                        apart -= does == 1
                        marked -= does == 2
                    del stack[k:]
                    break
                if stack[k][0] in ("article", "main") and name not in ("article", "main", "body", "html"):
                    break
            if name in ("body", "html", "article", "main"):
                anchors = 0
            continue
        if name in VOID or token["rest"].endswith("/") and name not in BLOCKS:
            continue
        if name == "body" and stack and stack[-1][0] == "head":
            stack.pop()
            apart -= 1
        does = 1 if set_apart(name, token["rest"], marked > 0) else 2 if name in ("article", "main") else 0
        if does == 2 and apart and not marked:
            # an article never stands in a menu or advert: that one was left open
            kept = [(x, d) for x, d in stack if d != 1]
            stack[:], apart = kept, 0
        if does or name in ("div", "section", "ul", "ol", "table", "p", "span", "header"):
            if name == "p":
                while stack and stack[-1][0] == "p":  # a paragraph ends where the next starts
                    apart -= stack.pop()[1] == 1
            stack.append((name, does))
            apart += does == 1
            marked += does == 2
    if at < len(page):
        add(page[at:])
    end_line()
    return lines


def weigh(lines: list[tuple[str, int, bool, bool]]) -> list[float]:
    """The weight of each line of ``lines_of``."""
    around = AROUND if any(inside and not apart for _, _, inside, apart in lines) else 1
    weights = []
    for text, linked, inside, apart in lines:
        # a line that is one link is a menu's, wherever it stands
        own = 0 if linked >= 0.9 * len(text) else max(len(text) - 2 * linked, 0)
        if not inside and len(text) < LONG and LEGAL.match(text):
            own = 0
        weights.append((min(own, FULL) + BLOCK) * (MARKED if inside else around) * (APART if apart else 1) if own else 0.0)
    return weights


def window_sums(weights: list[float], counted: list[bool]) -> list[float]:
    """For each line, the weights from it on to the last of the next WINDOW lines that count."""
    total, end, many, sums = 0.0, 0, 0, []
    for i, weight in enumerate(weights):
        while end < len(weights) and (many < WINDOW or not counted[end]):
            total, many, end = total + weights[end], many + counted[end], end + 1
        sums.append(max(total, weight))
        total, many = total - weight, many - counted[i]
    return sums


def spans(weights: list[float], counted: list[bool] | None = None) -> list[bool]:
    """Whether each line lies between a surge and a dive of the window sums."""
    sums = window_sums(weights, counted or [True] * len(weights))
    surge = min(SURGE, max(sums, default=0))
    found, inside = [], False
    for weight, total in zip(weights, sums):
        if inside:
            inside = total >= surge * DIVE
        else:
            inside = total >= surge > 0 and weight >= surge * DIVE
        found.append(inside)
    return found


def main_text(page: str | None) -> str:
    """The article's lines."""
    lines = lines_of(page or "")
    weights, own = weigh(lines), [not apart for *_, apart in lines]
    sums = window_sums(weights, own)
    if max(sums, default=0) < NOTHING:
        return ""
    least = min(SURGE, max(weights)) * DIVE
    lone, before = [False] * len(lines), [i for i, x in enumerate(own) if x]
    links = [linked >= 0.9 * len(text) for text, linked, *_ in lines]
    for a, i, b in zip([None, *before], before, [*before[1:], None]):
        lone[i] = links[i] and not (a is not None and links[a]) and not (b is not None and links[b])
    within = spans(weights, own)
    return "\n".join(text for (text, _, marked, _), weight, single, inside in zip(lines, weights, lone, within) if inside and (weight >= least or single and marked))


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars) for every row."""
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            texts = [main_text(x) for x in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return rows.mapInArrow(run, f"page_id {rows.schema['page_id'].dataType.simpleString()}, url string, text string, n_chars bigint")
