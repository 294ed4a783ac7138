"""HTML as a tree of block elements with the text that each owns.

Time is linear in the page, however broken it is: tags are looked for up to the last
">" only, and what is open is known by name, not by looking through the stack.
"""

from __future__ import annotations

import html
import re

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is not markup; their text is no page text.
RAW = frozenset("script style title textarea iframe xmp noembed noframes template svg math".split())
#: Elements that run inside a block; their text belongs to the block around them.
INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em embed font i img input ins kbd label map mark meter object output "
    "picture progress q rp rt ruby s samp small source span strike strong sub sup time tt u var wbr audio video canvas param track area".split()
)
CLOSES_P = frozenset(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header "
    "hgroup hr main menu nav ol p pre section table ul".split()
)
IN_HEAD = frozenset("base link meta title style script noscript template".split())
#: What an element of this kind ends, and what keeps it from looking further out.
ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "tbody": ({"thead", "tbody", "tfoot"}, {"table"}),
    "thead": ({"thead", "tbody", "tfoot"}, {"table"}),
    "tfoot": ({"thead", "tbody", "tfoot"}, {"table"}),
    "option": ({"option"}, {"select", "datalist"}),
    "optgroup": ({"option", "optgroup"}, {"select"}),
}
CONTROLS = frozenset("input select textarea button".split())
STOPS_P = CLOSES_P | {"td", "th", "li", "button"}

_OTHER = r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>"
_LOOSE = r"<(/?)([a-zA-Z][^\s/>]*+)([^>]*)>"
_TOKEN = re.compile(_OTHER + r"|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|" + _LOOSE, re.S)
#: Without quotes: for pages in which quotes stay open to the end again and again.
_PLAIN = re.compile(_OTHER + r"|(?!)()()()|" + _LOOSE, re.S)
OPEN_QUOTES = 16
_RAW_ENDS = {t: re.compile(rf"</{t}(?=[\s/>]|\Z)", re.I | re.A) for t in RAW}


class Page:
    """tag, attrs, parent, level of each block element; blocks of (owner, text) in page
    order; link and control counts by element; title, the first title's source.  Element 0
    is the page itself."""

    def __init__(self, source: str):
        self.tag, self.attrs, self.parent, self.level = ["#page"], [""], [-1], [0]
        self.blocks: list[tuple[int, str]] = []
        self.linked = [0]
        self.controls = [0]
        self.title: str | None = None
        self._stack: list[tuple[str, int]] = [("#page", 0)]
        self._places: dict[str, list[int]] = {}
        self._run: list[str] = []
        self._links = 0
        self._parse(source)

    def _flush(self) -> None:
        if self._run:
            text = " ".join("".join(self._run).split())
            if text:
                self.blocks.append((self._stack[-1][1], text))
            self._run.clear()

    def _text(self, raw: str) -> None:
        if any(t == "head" for t, _ in self._stack[-2:]):
            if raw.isspace():
                return
            self._close_to("head")
        if "&" in raw:
            raw = html.unescape(raw)
        self._run.append(raw)
        if self._links:
            self.linked[self._stack_owner()] += len(raw)

    def _stack_owner(self) -> int:
        return self._stack[-1][1]

    def _cut(self, k: int) -> None:
        """Ends what is open from place k of the stack on."""
        for tag, _ in self._stack[k:]:
            self._places[tag].pop()
        del self._stack[k:]

    def _innermost(self, tags) -> int:
        """Place of the innermost open element of these, or 0."""
        return max((own[-1] for t in tags if (own := self._places.get(t))), default=0)

    def _close_to(self, tag: str) -> None:
        """Ends the innermost open `tag` and all inside it, if one is open."""
        if k := self._innermost((tag,)):
            self._flush()
            self._cut(k)

    def _open(self, tag: str, attrs: str) -> None:
        self._flush()
        if tag in CLOSES_P and (k := self._innermost(("p",))) and k >= self._innermost(STOPS_P):
            self._cut(k)
        if tag in ENDS:
            ended, fence = ENDS[tag]
            if (k := self._innermost(ended)) > self._innermost(fence):
                self._cut(k)
        if len(self._stack) > 1 and self._stack[-1][0] == "head" and tag not in IN_HEAD:
            self._cut(len(self._stack) - 1)
        if tag == "body":
            self._close_to("head")
        self.parent.append(self._stack[-1][1])
        self.level.append(self.level[self._stack[-1][1]] + 1)
        self.tag.append(tag)
        self.attrs.append(attrs)
        self.linked.append(0)
        self.controls.append(0)
        if tag not in VOID:
            self._places.setdefault(tag, []).append(len(self._stack))
            self._stack.append((tag, len(self.tag) - 1))

    def _parse(self, source: str) -> None:
        at, n = 0, len(source)
        last = source.rfind(">") + 1  # no tag ends behind it
        token, loose = _TOKEN, 0
        while at < last:
            m = token.search(source, at, last)
            if m is None:
                break
            if m.start() > at:
                self._text(source[at : m.start()])
            at = m.end()
            name = m[2] or m[5]
            if not name:
                if m[0].startswith("<![CDATA["):
                    whole = m[0].endswith("]]>")
                    self._text(html.escape(m[0][9:-3] if whole else source[m.start() + 9 :]))
                    at = at if whole else n
                elif m[0].startswith("<!--") and not m[0].endswith("-->"):
                    at = n
                continue
            if m[5]:
                loose += 1
                token = _PLAIN if loose >= OPEN_QUOTES else token
            tag, attrs, ends = name.lower(), m[3] or m[6] or "", m[1] or m[4]
            if tag in INLINE:
                if tag == "a":
                    self._links = max(0, self._links - 1) if ends else 1
                elif tag == "br":
                    self._run.append(" ")
                elif tag == "input" and not ends:
                    self.controls[self._stack[-1][1]] += 1
                continue
            if ends:
                if tag == "p" and not self._places.get("p"):
                    self._flush()
                self._close_to(tag)
                continue
            if tag in CONTROLS:
                self.controls[self._stack[-1][1]] += 1
            if tag in RAW:
                if attrs.endswith("/") and tag in ("svg", "math"):
                    continue
                end = _RAW_ENDS[tag].search(source, at)
                if tag == "title" and self.title is None:
                    self.title = source[at : end.start() if end else n]
                at = source.find(">", end.end()) + 1 or n if end else n
                continue
            if tag in ("html", "body") and self._places.get(tag):
                continue
            self._open(tag, attrs)
        if at < n:
            # Behind the last ">" only a comment or CDATA can start; neither ends there.
            text, mark, rest = re.match(r"(.*?)(?:(<!--|<!\[CDATA\[)(.*))?\Z", source[at:], re.S).groups()
            if text:
                self._text(text)
            if mark == "<![CDATA[":
                self._text(html.escape(rest))
        self._flush()

    def text(self) -> str:
        """All page text, block by block."""
        return "\n".join(t for _, t in self.blocks)
