"""Blocks of an HTML page in order: text, path of open elements, share of link text. One tolerant pass, no tree.

Text runs belong to one block until an element that breaks lines opens or closes; ``br`` is white space. Scripts, styles, comments
and the like give no text. Character references are decoded. Unclosed and wrongly nested elements are closed as browsers
would, near enough: a new paragraph, item, row or cell closes an open one of its kind, an end tag closes what stands in it.
"""

from __future__ import annotations

import html
import re
from dataclasses import dataclass

BREAKING = frozenset("address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html iframe legend li main menu nav noscript ol optgroup option p pre search section select summary table tbody td template textarea tfoot th thead title tr ul video audio".split())
EMPTY = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset(("script", "style", "noembed", "noframes", "xmp", "iframe", "svg", "math", "template"))
#: An opening element closes an open one of the second group, up to the first container of the third.
_CELL, _ROW, _ITEM = frozenset(("td", "th")), frozenset(("tr",)), frozenset(("li",))
_CLOSES = {
    "p": (frozenset(("p",)), BREAKING - {"p"}),
    "li": (_ITEM, frozenset(("ul", "ol", "menu", "dir"))),
    "dt": (frozenset(("dt", "dd")), frozenset(("dl",))),
    "dd": (frozenset(("dt", "dd")), frozenset(("dl",))),
    "td": (_CELL, frozenset(("tr", "table"))),
    "th": (_CELL, frozenset(("tr", "table"))),
    "tr": (_ROW, frozenset(("table",))),
    "option": (frozenset(("option",)), frozenset(("select",))),
}
#: Open elements beyond this depth aren't kept, as in browsers.
DEEPEST = 512
#: A tag whose attributes are longer is taken to end at its first ``>``, in quotes or not.
MOST_ATTRIBUTES = 1 << 16
_START = re.compile(r"<(?:!|\?|/?[a-zA-Z])")
_NAME = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)")
_REST = re.compile(r"""[^>"']*+(?:(?:"[^"]*"|'[^']*')[^>"']*+)*+>""")
_NAMED = re.compile(r"""(?:^|[\s"'])(?:class|id|role|itemprop)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"']+))""", re.I)
_SPACE = re.compile(r"[\x20\x09-\x0D]+")
_END = {x: re.compile(rf"</{x}\s*>", re.I) for x in RAW}

Path = tuple[tuple[str, str], ...]


@dataclass(slots=True)
class Block:
    text: str
    path: Path
    linked: int


def blocks_of(page: str | None) -> list[Block]:
    out: list[Block] = []
    stack: list[tuple[str, str]] = []
    parts: list[str] = []
    linked, at, n, place, started = 0, 0, len(page or ""), (), False

    def flush() -> None:
        nonlocal linked, started
        if parts:
            text = _SPACE.sub(" ", "".join(parts)).strip(" ")
            if text:
                out.append(Block(text, place, linked))
            parts.clear()
        linked, started = 0, False

    def markup(at: int) -> tuple[int, str, bool, str]:
        """End of the markup that starts here, its name ("" for none), whether it closes, its attributes."""
        if page.startswith("<!--", at):
            end = page.find("-->", at + 4)
            return (end + 3 if end >= 0 else n), "", False, ""
        found = _NAME.match(page, at)
        first = page.find(">", at)
        if first < 0:
            return n, "", False, ""
        if not found:
            return first + 1, "", False, ""
        rest = _REST.match(page, found.end(), min(n, found.end() + MOST_ATTRIBUTES))
        end = rest.end() if rest else first + 1
        return end, found[2].lower(), bool(found[1]), page[found.end() : end - 1]

    while at < n:
        m = _START.search(page, at)
        stop = m.start() if m else n
        if stop > at:
            text = html.unescape(page[at:stop])
            if not started and text.strip():
                place, started = tuple(stack), True  # of the first text in it
            parts.append(text)
            if any(x == "a" for x, _ in stack):
                linked += len(text)
        if not m:
            break
        at, name, closes, attributes = markup(stop)
        if not name:
            continue
        if name in BREAKING:
            flush()
        elif name == "br":
            parts.append("\n")
        if closes:
            depth = next((i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == name), None)
            if depth is not None and (name in BREAKING or not any(x in BREAKING for x, _ in stack[depth + 1 :])):
                del stack[depth:]
            continue
        if name in RAW:
            end = _END[name].search(page, at)
            at = end.end() if end else n
            continue
        if name in _CLOSES:
            kinds, walls = _CLOSES[name]
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] in kinds:
                    del stack[i:]
                    break
                if stack[i][0] in walls:
                    break
        if name not in EMPTY and not attributes.endswith("/") and len(stack) < DEEPEST:
            named = " ".join(x for g in _NAMED.findall(attributes) for x in g if x).lower() if "=" in attributes else ""
            stack.append((name, named))
    flush()
    return out
