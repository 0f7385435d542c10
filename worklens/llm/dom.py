"""A small HTML reader: the elements of a page as a tree, and its text in blocks."""

from __future__ import annotations

import html
import re
from dataclasses import dataclass, field

VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
RAW = {"script", "style", "textarea", "title", "xmp", "iframe", "noembed", "noframes"}
#: Elements whose text is never shown as running text.
HIDDEN = {"head", "script", "style", "title", "textarea", "iframe", "noembed", "noframes", "noscript", "template", "svg", "math", "object",
          "select", "option", "optgroup", "button", "datalist", "canvas", "audio", "video", "xmp"}
INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd", "label", "mark", "q", "s",
          "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "nobr", "ruby", "rb", "rt", "rp", "br", "wbr", "img", "input"}
#: Elements that an opening tag closes: the tag, what it closes, and where the search ends.
CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "tbody": ({"tbody", "thead", "tr", "td", "th"}, {"table"}),
    "option": ({"option"}, {"select", "datalist"}),
}

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(>|\Z)|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)", re.S)
_ATTR = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?""")


@dataclass
class Page:
    """Elements in page order (0 is the root) and the text blocks: (element, text pieces of one run)."""

    tag: list[str] = field(default_factory=lambda: ["#root"])
    parent: list[int] = field(default_factory=lambda: [-1])
    depth: list[int] = field(default_factory=lambda: [0])
    attrs: list[str] = field(default_factory=lambda: [""])
    text: list[tuple[int, int, str]] = field(default_factory=list)  # element, block number, decoded text


def read(source: str) -> Page:
    """The page of ``source``. Tags left open are closed by what cannot stand in them, or at the end."""
    page, stack, block = Page(), [0], 0
    tag, parent, depth, attrs, text = page.tag, page.parent, page.depth, page.attrs, page.text
    hidden = 0

    def close(upto: int) -> None:
        nonlocal hidden, block
        for n in stack[upto:]:
            hidden -= tag[n] in HIDDEN
            block += tag[n] not in INLINE
        del stack[upto:]

    def find(names, stop=()) -> int:
        for k in range(len(stack) - 1, 0, -1):
            if tag[stack[k]] in names:
                return k
            if tag[stack[k]] in stop:
                return 0
        return 0

    at = 0
    while at < len(source):
        m = _TOKEN.search(source, at)
        piece = source[at : m.start() if m else len(source)]
        if piece and not hidden:
            text.append((stack[-1], block, html.unescape(piece) if "&" in piece else piece))
        if not m:
            break
        at = m.end()
        name = m[2] or m[6]
        if not name:
            continue
        name, inside = name.lower(), m[3] if m[2] else m[7]
        if m[1] or m[5]:
            k = find({name})
            if k and not (name in INLINE and any(tag[n] not in INLINE for n in stack[k + 1 :])):
                close(k)
            continue
        if name not in INLINE:
            if k := find({"p"}, {"table", "td", "th", "button", "object"}):
                close(k)
            if name[0] == "h" and name[1:].isdigit() and tag[stack[-1]] == name:
                close(len(stack) - 1)
        if name in CLOSES:
            names, stop = CLOSES[name]
            while k := find(names, stop):
                close(k)
        if name == "body" and (k := find({"head"})):
            close(k)
        if name == "br" and not hidden:
            text.append((stack[-1], block, " "))
        block += name not in INLINE
        n = len(tag)
        tag.append(name)
        parent.append(stack[-1])
        depth.append(len(stack))
        attrs.append(" ".join(a[1] or a[2] or a[3] if a[0].lower() != "data-y" else "data-y" + (a[1] or a[2] or a[3]) for a in _ATTR.findall(inside) if a[0].lower() in ("class", "id", "role", "itemprop", "data-y")).lower() if inside.strip() else "")
        if name in VOID or inside.endswith("/") and name in ("path", "svg", "use"):
            continue
        if name in RAW:
            end = re.compile(rf"</{name}(?=[\s/>]|\Z)[^>]*(?:>|\Z)", re.I).search(source, at)
            at = end.end() if end else len(source)
            continue
        stack.append(n)
        hidden += name in HIDDEN
    return page
