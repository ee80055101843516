"""Token streams of HTML pages as nested lists of elements and text runs.

Element tokens are the tags that can hold blocks; inline tags (b, a, span ...) do not break a text run. Every element
carries its name and the part of a page that its name, class, id or role announces (menu, advert ...). Work and memory
follow the page's length: tags are found from left to right, and elements deeper than a bound stay at the bound's level.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from functools import lru_cache

# Element names of the HTML standard by their role here.
BLOCKS = frozenset("""html body main article section div header footer nav aside h1 h2 h3 h4 h5 h6 hgroup p ul ol menu li dl
 dt dd table caption thead tbody tfoot tr td th figure figcaption blockquote pre address form fieldset legend details summary
 dialog center""".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SKIPPED = frozenset("""head title script style noscript template svg math iframe object canvas audio video select button
 textarea option noembed noframes""".split())
RAW = frozenset("script style title textarea iframe noembed noframes xmp".split())
PARTS = {"nav": "menu", "menu": "menu", "header": "header", "footer": "footer", "aside": "side", "form": "form",
         "fieldset": "form", "dialog": "notice", "article": "article", "main": "main"}
# Words of class, id and role that announce a part of a page.
WORDS = {
    "menu": "nav navbar navigation menu menubar breadcrumb breadcrumbs pagination pager toolbar tablist share social",
    "header": "header masthead topbar",
    "footer": "footer colophon copyright contentinfo",
    "side": "sidebar aside complementary related recommended widget widgets",
    "notice": "notice cookie cookies consent gdpr alert popup modal newsletter subscribe subscription dialog paywall promo",
    "advert": "ad ads advert adverts advertisement advertising adsbygoogle banner sponsor sponsored",
    "form": "form search login signup",
    "comment": "comment comments disqus replies respond",
    "main": "main",
    "content": "article articlebody content post entry story",
}
PART_OF_WORD = {word: part for part, words in WORDS.items() for word in words.split()}
#: Parts that are not the main text, and the elements that no class turns into one of them.
FURNITURE = frozenset("menu header footer side notice advert form comment".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6 hgroup".split())

_TAG = re.compile(r"""<([a-zA-Z][^\s/>]*+)((?:[^>"'=]++|=\s*+"[^"]*+"|=\s*+'[^']*+'|=|["'])*+)>""")
_LOOSE_TAG = re.compile(r"<([a-zA-Z][^\s/>]*+)([^>]*+)>")
_MARK = re.compile(r"""(?<![\w-])(?:class|id|role|itemprop)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"']+))""", re.IGNORECASE)
_NAME_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
_RAW_END = {name: re.compile(rf"</{name}(?=[\s/>])", re.IGNORECASE) for name in RAW}
_WALK = 64                      #: open elements that an omitted end tag is looked for in


class Element:
    """An element with its children, or a text run (children None) with its text and the characters inside links."""

    __slots__ = ("children", "key", "links", "text", "tier")

    def __init__(self, key: str, text: str | None = None, links: int = 0):
        self.key, self.text, self.links, self.tier = key, text, links, 0
        self.children: list[Element] | None = [] if text is None else None


@lru_cache(maxsize=65_536)
def _part(name: str, marks: tuple[str, ...]) -> str:
    """What the element announces: a key of WORDS, or empty. An own name counts before class, id and role."""
    if name in ("article", "main", "nav", "aside", "footer", "form", "dialog"):
        own = PARTS[name]
        inner = {PART_OF_WORD.get(w.lower()) for m in marks for w in _NAME_PARTS.findall(m)}
        return "comment" if "comment" in inner and name == "article" else own
    if name in ("html", "body"):
        return ""
    found = []
    for mark in marks:
        for token in mark.split():
            words = [w.lower() for w in _NAME_PARTS.findall(token)]
            parts = [PART_OF_WORD[w] for w in words if w in PART_OF_WORD]
            if words and not {"no", "has", "with", "without"} & set(words):
                found += parts
    named = [p for p in found if p in FURNITURE]
    if named:
        return named[0]
    return PARTS.get(name) or ("content" if "content" in found else "main" if "main" in found else "")


def _marks(attributes: str) -> tuple[str, ...]:
    return tuple(a or b or c for a, b, c in _MARK.findall(attributes)) if "=" in attributes else ()


class _Builder:
    def __init__(self, deepest: int):
        self.root = Element("page")
        self.stack: list[tuple[str, Element]] = []          # (tag, element that its children go to)
        self.open: Counter = Counter()
        self.deepest, self.skip = deepest, 0                # skip: depth of an element whose text is dropped
        self.buffer: list[tuple[str, bool]] = []
        self.in_link = False

    def here(self) -> Element:
        return self.stack[-1][1] if self.stack else self.root

    def text(self, raw: str) -> None:
        if raw and not self.skip:
            self.buffer.append((raw, self.in_link))

    def flush(self) -> None:
        if not self.buffer:
            return
        whole = " ".join(html.unescape("".join(t for t, _ in self.buffer)).split())
        if whole:
            linked = sum(len(t) for t, link in self.buffer if link)
            self.here().children.append(Element("T", whole, min(linked, len(whole))))
        self.buffer = []

    def push(self, name: str, part: str, dropped: bool = False) -> None:
        self.flush()
        parent = self.here()
        if dropped or self.skip or len(self.stack) >= self.deepest:
            node = parent
        else:
            node = Element(f"{name}.{part}" if part else name)
            parent.children.append(node)
        self.stack.append((name, node))
        self.open[name] += 1
        if dropped and not self.skip:
            self.skip = len(self.stack)

    def pop(self) -> None:
        self.flush()
        if self.skip == len(self.stack):
            self.skip = 0
        self.open[self.stack.pop()[0]] -= 1

    def close(self, name: str) -> None:
        if self.open[name]:
            while self.stack[-1][0] != name:
                self.pop()
            self.pop()

    def close_implied(self, names: tuple[str, ...], within: tuple[str, ...]) -> None:
        """End an open element of `names` that the coming tag ends, unless one of `within` stands between."""
        for k in range(len(self.stack) - 1, max(len(self.stack) - 1 - _WALK, -1), -1):
            tag = self.stack[k][0]
            if tag in names:
                while len(self.stack) > k:
                    self.pop()
                return
            if tag in within:
                return

    def start(self, name: str, attributes: str) -> None:
        if name == "a":
            self.in_link = True
        if name in VOID:
            if name in ("br", "hr"):
                self.text(" ")
            if name == "hr":
                self.flush()
            return
        if name in SKIPPED:
            if not attributes.endswith("/"):
                self.push(name, "", dropped=True)
            return
        if name in BLOCKS and self.open["head"]:            # its end tag may be left out
            self.close("head")
        part = _part(name, _marks(attributes))
        if name not in BLOCKS:
            if part in FURNITURE:                           # an inline or unknown element that is set apart
                self.push(name, part)
            elif self.open[name]:
                self.push(name, "")                         # keeps the end tags of equal names apart
            return
        if name in ("html", "body") and self.open[name]:
            return
        if self.open["p"]:
            self.close_implied(("p",), ("td", "th", "li", "div", "section", "article"))
        if name == "li":
            self.close_implied(("li",), ("ul", "ol", "menu"))
        elif name in ("dt", "dd"):
            self.close_implied(("dt", "dd"), ("dl",))
        elif name in ("td", "th"):
            self.close_implied(("td", "th"), ("tr", "table"))
        elif name == "tr":
            self.close_implied(("tr",), ("table",))
        self.push(name, part)

    def end(self, name: str) -> None:
        if name == "a":
            self.in_link = False
        if name not in VOID:
            self.close(name)


def page_tree(page: str | None, deepest: int = 32) -> Element:
    """The page's elements and text runs, character references decoded, white space in a run turned into one space.

    Null and empty pages have no children. Comments, scripts, styles, form controls and embedded objects are left out.
    Omitted end tags of p, li, dt, dd, tr, td and th are implied; other elements that are never closed end with the page."""
    out, at, n, tag = _Builder(deepest), 0, len(page or ""), _TAG
    while at < n:
        left = page.find("<", at)
        if left < 0:
            out.text(page[at:])
            break
        out.text(page[at:left])
        after = page[left + 1:left + 2]
        if page.startswith("<!--", left):
            close = page.find("-->", left + 2)
            at = close + 3 if close >= 0 else n
        elif after and after in "!?":
            close = page.find(">", left)
            at = close + 1 if close >= 0 else n
        elif after == "/":
            close = page.find(">", left)
            name = page[left + 2:close if close >= 0 else n].split(None, 1)
            if close < 0:
                break
            if name and name[0][0].isalpha():
                out.end(name[0].rstrip("/").lower())
            at = close + 1
        elif after.isascii() and after.isalpha():
            found = tag.match(page, left)
            if not found and tag is _TAG:                   # a quote that nothing closes: from here on quotes do not count
                tag = _LOOSE_TAG
                found = tag.match(page, left)
            if not found:
                break
            name, at = found[1].lower(), found.end()
            out.start(name, found[2])
            if name in RAW and not found[2].endswith("/"):
                close = _RAW_END[name].search(page, at)
                if not close:
                    break
                at = close.start()
        else:
            out.text("<")
            at = left + 1
    out.flush()
    while out.stack:
        out.pop()
    return out.root


def runs(root: Element) -> list[Element]:
    """The text runs below an element, in page order."""
    out, todo = [], [root]
    while todo:
        node = todo.pop()
        if node.children is None:
            out.append(node)
        else:
            todo.extend(reversed(node.children))
    return out
