"""Labelled pages for training: made pages whose main text is known.

`made(n, seed)` writes pages of many layouts (semantic elements or plain divisions
with telling, odd or no class names) around an article of known blocks.  Any other
table of (html, text) pairs can be used in its place.
"""

from __future__ import annotations

import html
import random

_SYLLABLES = "ba be bi bo da de di do en er ing ion la le li lo ma me mi na ne on or ra re sa se ta te ti to un ve wi".split()

#: Class and id names by what they mark; {} is a number or nothing.
NAMES = {
    "nav": "nav navbar navigation menu main-menu topnav mainNav site-nav menubar nav-links breadcrumb breadcrumbs pagination pager tabs toc skip-links submenu".split(),
    "header": "header site-header page-header masthead banner topbar top-bar branding logo site-title hero-bar".split(),
    "footer": "footer site-footer page-footer bottom colophon copyright legal foot footer-links credits".split(),
    "side": "sidebar side aside widget widget-area rail right-column leftcol secondary related related-posts recommended trending popular tags tag-cloud archive recent-posts see-also".split(),
    "ad": "ad ads advert advertisement adbox ad-slot sponsored sponsor promo promotion banner-ad ad-container adsbygoogle dfp teaser-ad commercial".split(),
    "notice": "notice cookie cookie-banner cookies consent gdpr alert warning message popup modal overlay disclaimer notification paywall privacy-notice announcement info-bar".split(),
    "form": "search searchbox search-form login signin signup newsletter subscribe subscription contact-form register form".split(),
    "comment": "comments comment comment-list commentlist comment-thread comments-area discussion responses replies reply disqus reader-comments user-comments feedback reviews".split(),
    "share": "share social social-links sharing share-buttons follow-us social-media tools toolbar actions".split(),
    "body": "content article post entry entry-content post-body article-body story story-body main main-content text body-text page-content article__body single-post prose".split(),
    "odd": "container wrapper row col inner box block section module panel grid outer layout c1 x7 css-1a clearfix group region".split(),
}


class _Maker:
    def __init__(self, rng: random.Random):
        self.rng = rng
        self.hints = rng.random() < 0.7
        self.semantic = rng.random() < 0.6
        self.accents = rng.random() < 0.4

    def word(self) -> str:
        w = "".join(self.rng.choice(_SYLLABLES) for _ in range(self.rng.randint(1, 4)))
        if self.accents and self.rng.random() < 0.2:
            w += self.rng.choice("éèüñç")
        if self.rng.random() < 0.01:
            w += self.rng.choice(["&", "<", "%%%", "###", "***", "$$$"])
        return w

    def words(self, low: int, high: int) -> str:
        return " ".join(self.word() for _ in range(self.rng.randint(low, high)))

    def prose(self, low: int = 1, high: int = 6) -> str:
        return " ".join(self.words(1 if self.rng.random() < 0.2 else 4, 22).capitalize() + self.rng.choice("...!?") for _ in range(self.rng.randint(low, high)))

    def mark(self, kind: str, odds: float = 0.9) -> str:
        """Attributes of an element of a kind: telling, odd or none."""
        out = ""
        if self.hints and self.rng.random() < odds:
            name = self.rng.choice(NAMES[kind])
            if self.rng.random() < 0.25:
                name += " " + self.rng.choice(NAMES["odd"])
            if self.rng.random() < 0.1:
                name += f"-{self.rng.randint(1, 9)}"
            out = f' {self.rng.choice(("class", "class", "class", "id"))}="{name}"'
        elif self.rng.random() < 0.4:
            out = f' class="{self.rng.choice(NAMES["odd"])}"'
        return out

    def wrap(self, tag: str, kind: str, inner: str, odds: float = 0.9) -> str:
        """A semantic element, or a division that must say what it is."""
        plain = not self.semantic or self.rng.random() < 0.3
        if plain:
            return f"<div{self.mark(kind, odds if tag == 'div' else 1)}>{inner}</div>"
        return f"<{tag}{self.mark(kind, 0.5)}>{inner}</{tag}>"

    def links(self, low: int = 3, high: int = 9, tag: str | None = None) -> str:
        made = [f'<a href="/{self.word()}">{html.escape(self.words(1, 4))}</a>' for _ in range(self.rng.randint(low, high))]
        style = tag or self.rng.choice(("ul", "ul", "flat", "divs"))
        if style == "ul":
            return "<ul>" + "".join(f"<li>{x}</li>" for x in made) + "</ul>"
        return "".join(f"<div>{x}</div>" for x in made) if style == "divs" else self.rng.choice((" | ", " ", " &middot; ")).join(made)

    def form(self) -> str:
        fields = "".join(f'<label>{self.words(1, 3)}</label><input name="{self.word()}">' for _ in range(self.rng.randint(1, 3)))
        return f'<form{self.mark("form", 0.6)}><p>{self.words(2, 9)}</p>{fields}<button>{self.words(1, 2)}</button></form>'

    def comments(self) -> str:
        one = lambda: f"<{t}{self.mark('comment', 0.7)}><h4>{self.words(1, 2)}</h4><p>{html.escape(self.prose())}</p><a href='#'>{self.word()}</a></{t}>"
        t = self.rng.choice(("div", "li", "article", "div"))
        inner = "".join(one() for _ in range(self.rng.randint(1, 6)))
        inner = f"<ol>{inner}</ol>" if t == "li" else inner
        tag = self.rng.choice(("section", "div", "aside"))
        return f"<{tag}{self._told('comment')}><h3>{self.rng.randint(1, 90)} {self.words(1, 2)}</h3>{inner}{self.form() if self.rng.random() < 0.4 else ''}</{tag}>"

    def _told(self, kind: str) -> str:
        return f' {self.rng.choice(("class", "id"))}="{self.rng.choice(NAMES[kind])}"'

    def junk(self, kind: str) -> str:
        """One piece of boilerplate."""
        r = self.rng
        if kind == "nav":
            return self.wrap("nav", "nav", self.links())
        if kind == "header":
            tag = r.choice(("h1", "div", "p", "h2"))
            return self.wrap("header", "header", f"<{tag}>{self.words(1, 4)}</{tag}>" + r.choice(("", self.links(), self.form(), f"<p>{self.words(3, 9)}</p>")))
        if kind == "footer":
            return self.wrap("footer", "footer", r.choice((f"&copy; {self.words(1, 5)}", f"<p>&copy; 20{r.randint(10, 29)} {self.words(1, 4)}</p>", f"{self.words(1, 3)} &middot; {self.prose(1, 2)}", self.links() + f"<p>{self.prose(1, 2)}</p>")))
        if kind == "side":
            inner = "".join(f"<div{self.mark('side', 0.5)}><h3>{self.words(1, 3)}</h3>{r.choice((self.links(), f'<p>{self.prose(1, 3)}</p>'))}</div>" for _ in range(r.randint(1, 3)))
            return self.wrap("aside", "side", inner)
        if kind in ("ad", "notice"):
            tag, inner = r.choice(("div", "div", "aside", "section", "p")), r.choice((self.prose(1, 3), f"<p>{self.prose(1, 3)}</p>", f"<p>{self.words(3, 12)}</p><a href='/x'>{self.words(1, 3)}</a>", f"<p>{self.prose(1, 2)}</p><button>{self.word()}</button>"))
            role = r.choice((' role="alert"', ' role="dialog"', "")) if kind == "notice" else ""
            return f"<{tag}{self._told(kind)}{role}>{inner if tag != 'p' else self.prose(1, 3)}</{tag if tag != 'p' else 'p'}>"
        if kind == "form":
            return self.form()
        if kind == "share":
            return f"<div{self._told('share')}>{self.links(2, 5)}</div>"
        return self.comments()

    def block(self) -> tuple[str, list[str]]:
        """One block of the article: markup and the texts it gives."""
        r, kind = self.rng, self.rng.random()
        text = self.prose()
        if kind < 0.7:
            shown = html.escape(text, quote=False)
            if r.random() < 0.25 and " " in shown:
                a, b = shown.split(" ", 1)
                tag = r.choice(("b", "em", "a href='/y'", "span", "strong"))
                shown = f"<{tag}>{a}</{tag.split()[0]}> {b}"
            if r.random() < 0.1:
                shown = " <br> ".join(shown.rsplit(" ", 1))
            if r.random() < 0.05:
                shown = "<b>" + shown
            tag = "p" if r.random() < 0.9 else "div"
            return f"<{tag}>{shown}" + ("" if tag == "p" and r.random() < 0.2 else f"</{tag}>"), [text]
        if kind < 0.8:
            tag, words = r.choice(("h2", "h3", "h4")), self.words(1, 7)
            return f"<{tag}>{html.escape(words)}</{tag}>", [words]
        if kind < 0.88:
            tag, items = r.choice(("ul", "ol")), [self.prose(1, 2) for _ in range(r.randint(2, 5))]
            return f"<{tag}>" + "".join(f"<li>{html.escape(x)}" + r.choice(("</li>", "")) for x in items) + f"</{tag}>", items
        if kind < 0.94:
            return f"<blockquote><p>{html.escape(text)}</p></blockquote>", [text]
        if kind < 0.97:
            rows = [[self.words(1, 3) for _ in range(3)] for _ in range(r.randint(1, 4))]
            return "<table>" + "".join("<tr>" + "".join(f"<td>{html.escape(c)}</td>" for c in row) + "</tr>" for row in rows) + "</table>", [c for row in rows for c in row]
        words = self.words(3, 12)
        return f"<figure><img src='/i'><figcaption>{html.escape(words)}</figcaption></figure>", [words]

    def article(self) -> tuple[str, list[str]]:
        r = self.rng
        title = self.words(2, 9)
        parts, texts = [f"<h1>{html.escape(title)}</h1>"], [title]
        if r.random() < 0.1:
            parts = [f"<header><h1>{html.escape(title)}</h1></header>"]
        for _ in range(r.choice((1, 2, 3, 5, 8, 12, 20))):
            shown, own = self.block()
            parts.append(shown)
            texts += own
            if r.random() < 0.06:
                parts.append(self.junk(r.choice(("ad", "ad", "side", "share", "form", "notice"))))
        body = "".join(parts)
        for _ in range(r.choice((0, 0, 1, 2))):
            body = f"<{r.choice(('div', 'div', 'section'))}{self.mark('body', 0.6)}>{body}" + "</div>"
            body = body if body.startswith("<div") else body[: -len("</div>")] + "</section>"
        if self.semantic:
            tag = r.choice(("article", "article", "main"))
            return f"<{tag}{self.mark('body', 0.4)}>{body}</{tag}>", texts
        return f"<div{self.mark('body', 0.8)}>{body}</div>", texts

    def page(self) -> tuple[str, str]:
        r = self.rng
        main, texts = self.article()
        above = [self.junk(k) for k in ("notice", "header", "nav", "ad", "form") if r.random() < 0.45]
        below = [self.junk(k) for k in ("share", "side", "ad", "comment", "form", "notice", "footer") if r.random() < 0.4]
        if r.random() < 0.3:
            r.shuffle(above)
            r.shuffle(below)
        if r.random() < 0.02:
            main, texts = "", []
        body = "".join((*above, main, *below))
        if r.random() < 0.4:
            body = f"<div{self.mark('odd')}>{body}</div>"
        head = f"<head><meta charset='utf-8'><title>{self.words(2, 8)}</title><style>p{{margin:0}}</style><script>var t='</p>';</script></head>"
        return f"<!DOCTYPE html><html>{head}<body>{body}" + r.choice(("</body></html>", "")), "\n".join(texts)


def made(n: int, seed: int) -> list[tuple[str, str]]:
    """n pairs (html, main text); the same for the same seed."""
    rng = random.Random(seed)
    return [_Maker(rng).page() for _ in range(n)]
