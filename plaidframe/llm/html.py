"""Main text of HTML pages by line-block distribution.

Markup is stripped and block elements make lines.  Lines of menus, headers, footers, sidebars, adverts,
forms, comments and the like stay as empty lines, so the text lengths drop to zero there.  The
length of a line counts without the text of its links; lines of an article or main element count at least
``SURGE``.  With the sums over ``WINDOW`` lines, a surge is where a block reaches ``SURGE`` and a dive where the
lines fall to zero; the lines between a surge and its dive are kept.  If there is an article with text, runs outside it
are not the main text; if no block surges, the run with the longest text is kept.

Defined cases: null, empty and textless pages give an empty text and 0 characters; unclosed elements end with the
page, dropped ones also where an article, main, h1 or the footer begins, dropped inline ones also with the element
around them, a head with the first element that cannot be in it; a tag whose quotes run to the end of the page ends at its next
bracket, one without any bracket is text; pages of any length are read once, whole; after an article with text
further articles count only outside dropped elements and not under a dropped name; repeated rows are repeated; of
other columns those named text and n_chars are replaced.
"""

from __future__ import annotations

import html as characters
import re
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import append

WINDOW = 3
SURGE = 40
# every alternative is taken or left as a whole, so a token costs one look at its characters
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*+>|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+'|[\"'])*+)>"
                    r"|[^<]++|<", re.S)
_BARE = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*+>|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>|[^<]++|<", re.S)  # quotes mean nothing
_PLAIN = re.compile(r"<!--.*?(?:-->|\Z)|()()()(?:[^<]++|<)", re.S)  # where no tag can end any more
_ATTRIBUTE = re.compile(r"(?:^|\s)(?:class|id|role|aria-label)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+)", re.I)
# Element names of HTML and names that pages use for what is not their main text.
RAW = frozenset("script style noscript template textarea title iframe object svg math canvas audio video select".split())
HEAD = frozenset("base basefont bgsound link meta noscript script style template title".split())
DROPPED = frozenset("nav header footer aside form menu dialog button fieldset".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset "
                   "figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol p pre "
                   "section summary table tbody td tfoot th thead tr ul".split())
MAIN = frozenset(["article", "main"])
_ENDS = {name: re.compile(rf"</{name}(?=[\s/>]|\Z)[^>]*>?" + (r"|(?=<(?:body|article|main)\b)" if name == "title" else ""), re.I)
         for name in RAW}
_NAMES = re.compile(
    r"(?:^|[\s_-])(?:ads?|advert\w*|adsense|sponsor\w*|promo\w*|banner\w*|sidebar\w*|side|menu\w*|nav\w*|breadcrumb\w*|footer\w*|"
    r"masthead|header|topbar|cookie\w*|consent|gdpr|notice\w*|alert\w*|popup\w*|modal\w*|overlay|newsletter\w*|"
    r"subscribe\w*|comment\w*|disqus\w*|repl(?:y|ies)|respond|share\w*|sharing|social\w*|related\w*|recommend\w*|"
    r"widget\w*|toolbar|login|signup|search\w*|pagination|pager|tags?|copyright|legal|disclaimer)(?:$|[\s_-])", re.I)

# The names that drop an element inside a line also beside other names.
_ADS = re.compile(r"(?:^|[\s_-])(?:ads?|advert\w*|adsense|sponsor\w*|promo\w*|share-icons?|share-buttons?|social\w*)(?:$|[\s_-])", re.I)


@dataclass
class Line:
    text: str
    linked: int
    main: bool
    dropped: bool


def lines_of(page: str) -> list[Line]:
    out: list[Line] = []
    text: list[str] = []
    linked = anchors = main = 0
    dropping: list[str] = []  # open elements from the dropped one on
    head, at = False, 0

    def inline() -> bool:
        """Whether a dropped inline element is open; its text is left out of the line around it."""
        return bool(dropping) and dropping[0] not in BLOCKS and dropping[0] not in DROPPED

    def flush() -> None:
        nonlocal linked, seen
        line = " ".join(characters.unescape("".join(text)).split())
        if line:
            out.append(Line(line, linked, main > 0, bool(dropping) and not inline()))
            seen = seen or (main > 0 and not out[-1].dropped)
        text.clear()
        linked = 0

    last, reader = page.rfind(">"), _TOKEN
    seen = False  # an article with text
    while at < len(page):
        token = (reader if at <= last else _PLAIN).match(page, at)
        if reader is _TOKEN and token[0] == "<" and page[at + 1:at + 2].isalpha() and at <= last:
            reader = _BARE  # a quote swallows every end that is left
            token = reader.match(page, at)
        at = token.end()
        name = token[2]
        if not name:
            if not head and not inline() and not token[0].startswith(("<!", "<?")):
                text.append(token[0])
                if anchors:
                    linked += len(token[0].strip())
            continue
        name, closing, empty = name.lower(), bool(token[1]), token[3].endswith("/")
        if name == "head":
            head = not closing and not empty
            continue
        if head and not closing and name not in HEAD:
            head = False
        if name in RAW:
            if not closing and not empty:
                end = _ENDS[name].search(page, at)
                at = end.end() if end else len(page)
            continue
        if name == "a":
            anchors = 0 if closing else 1
            continue
        if name == "br":
            text.append(" ")
            continue
        if name not in BLOCKS and name not in DROPPED:
            if name in VOID:
                if name in ("img", "hr", "input"):
                    text.append(" ")
            elif closing:
                if name in dropping:
                    while dropping.pop() != name:
                        pass
            elif not empty and (name in dropping or _named(token[3], _ADS, _NAMES)):
                dropping.append(name)
            continue
        flush()
        if closing:
            if dropping:
                block = not inline()
                if name in dropping:
                    while dropping.pop() != name:
                        pass
                    if not dropping and block:
                        out.append(Line("", 0, False, True))
                elif not block:  # the element around a dropped inline one ends
                    dropping.clear()
                    if name in MAIN:
                        main = max(0, main - 1)
            elif name in MAIN:
                main = max(0, main - 1)
            continue
        if dropping and (name in MAIN or name in ("h1", "footer")):
            # before the article this ends what was left open; after it, comments and teasers may be articles
            if (dropping[0] not in MAIN or name in MAIN) and not (seen and name in MAIN):
                dropping.clear()
        bad = name in DROPPED or ((name not in MAIN or seen) and name not in ("body", "html") and _named(token[3]))
        if dropping or bad:
            if not empty and name not in VOID:
                dropping.append(name)
        elif name in MAIN:
            main += 1
    flush()
    return out


def _named(attributes: str, names: re.Pattern = _NAMES, single: re.Pattern | None = None) -> bool:
    """Whether an attribute holds one of ``names``, or nothing but one of ``single``."""
    values = [m[1].strip("\"' ") for m in _ATTRIBUTE.finditer(attributes or "")]
    return any(names.search(v) or (single is not None and not re.search(r"\s", v) and single.search(v)) for v in values)


def main_lines(lines: list[Line], window: int = WINDOW, surge: int = SURGE) -> list[str]:
    """Texts of the kept lines, in page order."""
    article = any(x.main and not x.dropped for x in lines)
    weight = []
    for x in lines:
        if x.dropped or (article and not x.main):
            weight.append(0)
        else:
            own = max(0, len(x.text) - x.linked)
            weight.append(max(own, surge) if x.main else own)
    blocks = [sum(weight[k:k + window]) for k in range(len(weight))]
    runs, k = [], 0
    while k < len(weight):
        if not weight[k]:
            k += 1
            continue
        end = k
        while end < len(weight) and weight[end]:
            end += 1
        runs.append((k, end, max(blocks[k:end]) >= surge))
        k = end
    kept = [r for r in runs if r[2]] or sorted(runs, key=lambda r: (-sum(weight[r[0]:r[1]]), r[0]))[:1]
    return [lines[k].text for first, end, _ in kept for k in range(first, end)]


def extract(page: str | None) -> str:
    return "\n\n".join(main_lines(lines_of(page))) if page else ""


def main_text(pages: DataFrame, page: str = "html") -> DataFrame:
    """``pages`` with text and n_chars; whole pages, no shuffle."""

    def run(columns: list[pa.Array]) -> list[pa.Array]:
        texts = [extract(x.as_py()) for x in columns[0]]
        return [pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())]

    return append(pages, "text string, n_chars long", [page], run)
