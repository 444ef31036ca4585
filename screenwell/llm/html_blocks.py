"""Pages as sequences of leaf blocks: text between block tags, with the path of elements above it.

A small tolerant reader: unknown and unclosed tags never fail, an end tag without its start is ignored, `p`, `li`, `td` and
the like close their predecessors.  Scripts, styles, comments and other content that is never shown make no leaf.
One pass, linear in the page.
"""

from __future__ import annotations

import html as _html
import re
from typing import NamedTuple

#: Fixed values of HTML: elements without content, without a line of their own, and whose content is not shown as text.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd mark nobr q rp rt ruby s samp small "
                   "span strike strong sub sup time tt u var wbr".split())
HIDDEN = frozenset("iframe noembed noframes noscript script style svg template textarea title".split())
#: Starting one of these ends an open one of those named.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"},
          "option": {"option"}, "thead": {"tr", "td", "th"}, "tbody": {"thead", "tr", "td", "th"}, "tfoot": {"tbody", "tr", "td", "th"}}
#: Beyond these an element is not closed by a later sibling.
SCOPES = frozenset("ul ol dl table select article section aside nav main div body form".split())
#: Starting one of these ends an open paragraph.
BREAKS_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 "
                     "h6 header hgroup hr main menu nav ol p pre search section summary table ul".split())
#: Elements whose tokens a path keeps, innermost first.
DEPTH = 24
#: Quoted values are looked for so far, and no more after so many tags of a page whose quotes do not close.
TAG, UNCLOSED = 1 << 16, 100
_REST = re.compile(r"""(?:[^>"']|"[^"]*"|'[^']*')*+>""")
_SHUT = {tag: re.compile(f"</{tag}", re.I) for tag in HIDDEN}
_NAME = re.compile(r"[a-zA-Z][^\s/>]*")
_ATTR = re.compile(r"""(?<![\w-])(class|id|role|itemprop|style|hidden|aria-hidden)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.I)
_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")


class Leaf(NamedTuple):
    """Tokens of the elements above, the text, and how many of its characters are links."""

    path: tuple[str, ...]
    text: str
    linked: int


def stem(word: str) -> str:
    """A word without its commonest endings."""
    if len(word) > 2 and word.endswith("s") and not word.endswith("ss"):
        word = word[:-1]
    return re.sub(r"(?<=.{4})(?:ed|ing)$", "", word)


def element(tag: str, attributes: str) -> tuple[str, ...]:
    """Tokens of an element: its name, and the word stems of what names it."""
    out = ["t:" + tag]
    for name, value in _ATTR.findall(attributes):
        name = name.lower()
        if name in ("hidden", "aria-hidden"):
            out.append("k:hidden" if value.strip("\"'").lower() != "false" else "k:shown")
        elif name == "style":
            if "display:none" in value.replace(" ", "").lower():
                out.append("k:hidden")
        else:
            for part in _PART.findall(value):
                out.append("k:" + stem(part.lower()))
    return tuple(out[:12])


class Reader:
    """Reads pages; the paths seen lately are kept, as pages of a site share them."""

    def __init__(self, most: int = 20_000) -> None:
        self.most = most
        self.top: tuple = (None, ())
        self.known: dict[tuple, tuple] = {}

    def _path(self, above: tuple, tag: str, attributes: str) -> tuple:
        """A path is (tokens of its elements, innermost first); equal ones are one object."""
        key = (id(above), tag, attributes)
        found = self.known.get(key)
        if found is None:
            if len(self.known) >= self.most:
                self.known.clear()
            found = self.known[key] = (above, (element(tag, attributes), *above[1][:DEPTH - 1]))
        return found

    def leaves(self, page: str | None) -> list[Leaf]:
        if not page:
            return []
        out: list[Leaf] = []
        top = self.top
        stack: list[tuple[str, tuple]] = []      # name, path
        open_tags: dict[str, int] = {}
        pieces: list[str] = []
        linked = 0
        unclosed = 0
        at, end = 0, len(page)

        def flush() -> None:
            nonlocal linked
            if pieces:
                text = " ".join("".join(pieces).split())
                if text:
                    out.append(Leaf((stack[-1][1] if stack else top)[1], text, min(linked, len(text))))
                pieces.clear()
            linked = 0

        def pop(to: int) -> None:
            for name, _ in stack[to:]:
                open_tags[name] -= 1
            del stack[to:]

        def text(a: int, b: int) -> None:
            nonlocal linked
            if a < b:
                s = page[a:b]
                if "&" in s:
                    s = _html.unescape(s)
                pieces.append(s)
                if open_tags.get("a"):
                    linked += len(s)

        while at < end:
            lt = page.find("<", at)
            if lt < 0:
                text(at, end)
                break
            mark = page[lt + 1:lt + 2]
            if mark == "!" or mark == "?":
                text(at, lt)
                if page.startswith("<!--", lt):
                    gt = page.find("-->", lt + 4)
                    at = gt + 3 if gt >= 0 else end
                else:
                    gt = page.find(">", lt)
                    at = gt + 1 if gt >= 0 else end
                continue
            closing = mark == "/"
            name = _NAME.match(page, lt + 1 + closing)
            if not name:
                text(at, lt + 1)
                at = lt + 1
                continue
            text(at, lt)
            gt = page.find(">", name.end())
            if unclosed < UNCLOSED and (page.find('"', name.end(), gt) >= 0 or page.find("'", name.end(), gt) >= 0):
                rest = _REST.match(page, name.end(), min(end, name.end() + TAG))   # a quoted value may hold the sign
                if rest:
                    gt = rest.end() - 1
                else:
                    unclosed += 1
            if gt < 0:
                break
            tag, attributes, at = name[0].lower(), page[name.end():gt], gt + 1
            if tag not in INLINE and tag not in HIDDEN:
                flush()
            elif tag == "br":
                pieces.append(" ")
            if closing:
                if open_tags.get(tag):
                    i = len(stack) - 1
                    while stack[i][0] != tag:
                        i -= 1
                    pop(i)
                continue
            if tag in HIDDEN:
                if not attributes.endswith("/"):
                    shut = _SHUT[tag].search(page, at)
                    shut = page.find(">", shut.end()) if shut else -1
                    at = shut + 1 if shut >= 0 else end
                continue
            if tag in VOID:
                continue
            shuts = CLOSES.get(tag)
            if shuts is None and tag in BREAKS_P and open_tags.get("p"):
                shuts = {"p"}
            if shuts:
                i = len(stack) - 1
                while i >= 0 and stack[i][0] not in shuts and stack[i][0] not in SCOPES:
                    i -= 1
                if i >= 0 and stack[i][0] in shuts:
                    pop(i)
            if not attributes.endswith("/") or tag in INLINE:
                stack.append((tag, self._path(stack[-1][1] if stack else top, tag, attributes) if tag not in INLINE
                              else (stack[-1][1] if stack else top)))
                open_tags[tag] = open_tags.get(tag, 0) + 1
        flush()
        return out
