"""Made-up web pages with known main text, to fit the weights of mincut and to test them.

A page has an article and a choice of menus, headers, sidebars, notices, adverts, forms, comments and footers. Each part
says what it is by its tag or class only with some probability; else it is plain elements with classes that mean
nothing, and only its text, its links and what lies around it tell. Words are invented.
"""

from __future__ import annotations

import random
from dataclasses import dataclass, field

_STARTS = "b c d f g h k l m n p r s t v w br ch dr gr kl pr st tr".split()
_ENDS = "a e i o u an el in on ar es is en ur at ing ed".split()
_ARTICLE_CLASSES = "post-content entry-content article-body story-text main-content content post-body".split()
_MARKS = {
    "nav": (("nav", ""), ("div", "menu"), ("ul", "main-nav"), ("div", "navbar"), ("div", "breadcrumbs")),
    "header": (("header", ""), ("div", "site-header"), ("div", "masthead"), ("div", "topbar")),
    "sidebar": (("aside", ""), ("div", "sidebar"), ("div", "related"), ("div", "widget"), ("section", "recommended")),
    "notice": (("div", "cookie-notice"), ("div", "consent"), ("dialog", ""), ("div", "popup"), ("div", "alert")),
    "ad": (("div", "ad"), ("div", "advert"), ("div", "sponsored"), ("aside", ""), ("div", "promo")),
    "form": (("form", ""), ("div", "newsletter"), ("div", "signup"), ("div", "search")),
    "comments": (("section", "comments"), ("div", "comment"), ("div", "replies"), ("div", "discussion")),
    "share": (("div", "share"), ("ul", "social"), ("div", "tags"), ("footer", "")),
    "footer": (("footer", ""), ("div", "footer"), ("div", "site-footer"), ("div", "legal")),
}


@dataclass
class Page:
    html: str = ""
    content: set[str] = field(default_factory=set)  # texts of the article's blocks
    other: set[str] = field(default_factory=set)


class _Maker:
    def __init__(self, seed: int):
        self.r = random.Random(seed)
        self.page = Page()
        self.marked = self.r.choice((0.4, 0.7, 0.95))  # how often a part says what it is

    def word(self) -> str:
        return "".join(self.r.choice(_STARTS) + self.r.choice(_ENDS) for _ in range(self.r.choice((1, 1, 2, 2, 3))))

    def words(self, n: int) -> str:
        return " ".join(self.word() for _ in range(n))

    def sentences(self, n: int) -> str:
        return " ".join(self.words(self.r.randint(3, 18)).capitalize() + self.r.choice("....?!") for _ in range(n))

    def say(self, text: str, content: bool, tag: str, linked: bool = False, attrs: str = "") -> str:
        """One block that says text, which no other block says."""
        text = f"{text} {self.word()}{len(self.page.content) + len(self.page.other)}" if text[-1:] not in ".?!" else f"{self.word()}{len(self.page.content) + len(self.page.other)} {text}"
        (self.page.content if content else self.page.other).add(text)
        inner = f'<a href="/{self.word()}">{text}</a>' if linked else text
        if not linked and self.r.random() < 0.15:
            first, _, rest = text.partition(" ")
            mark = self.r.choice(("b", "em", "a href='/x'", "span"))
            inner = f"<{mark}>{first}</{mark.split()[0]}> {rest}" if rest else inner
        return f"<{tag}{attrs}>{inner}</{tag}>"

    def noise(self) -> str:
        return f' class="{self.r.choice("abcdefgh")}{self.r.choice("xqzj")}{self.r.randint(10, 99)}"' if self.r.random() < 0.6 else ""

    def box(self, kind: str, inner: str, mark: float | None = None) -> str:
        if self.r.random() < (self.marked if mark is None else mark):
            tag, name = self.r.choice(_MARKS[kind])
            attrs = f' {self.r.choice(("class", "id"))}="{name}{self.r.choice(("", "", "-content", " x1"))}"' if name else ""
        else:
            tag, attrs = "div", self.noise()
        return f"<{tag}{attrs}>{inner}</{tag}>"

    def links(self, least: int, most: int) -> str:
        n = self.r.randint(least, most)
        if self.r.random() < 0.7:
            return "<ul>" + "".join(self.say(self.words(self.r.randint(1, 3)), False, "li", self.r.random() < 0.85) for _ in range(n)) + "</ul>"
        return "".join(self.say(self.words(self.r.randint(1, 3)), False, "div", True) for _ in range(n))

    def blurbs(self, least: int, most: int) -> str:
        out, each = "", self.r.random() < 0.2
        for _ in range(self.r.randint(least, most)):
            out += "<article>" * each
            out += self.say(self.words(self.r.randint(2, 8)), False, self.r.choice(("h3", "h4", "p", "div")), self.r.random() < 0.8)
            if self.r.random() < 0.6:
                out += self.say(self.sentences(self.r.randint(1, 2)), False, self.r.choice(("p", "div")))
            out += "</article>" * each
        return out

    def comments(self) -> str:
        out, each = "", self.r.random() < 0.2
        for _ in range(self.r.randint(1, 5)):
            out += "<article>" * each
            out += self.say(self.words(self.r.randint(1, 3)), False, self.r.choice(("div", "h4", "p")), self.r.random() < 0.5)
            out += self.say(self.sentences(self.r.randint(1, 5)), False, self.r.choice(("p", "div")))
            if self.r.random() < 0.7:
                out += self.say("Reply", False, "div", True)
            out += "</article>" * each
        return out

    def other(self, kind: str) -> str:
        if kind == "nav":
            inner = self.links(3, 10)
        elif kind == "header":
            inner = self.say(self.words(self.r.randint(1, 4)), False, self.r.choice(("h1", "div", "p")), self.r.random() < 0.7) + (self.say(self.words(5), False, "p") if self.r.random() < 0.4 else "")
        elif kind == "sidebar":
            inner = self.blurbs(1, 5)
            return self.box(kind, inner, 1.0 if "<article" in inner else None)
        elif kind == "notice":
            inner = self.say(self.sentences(self.r.randint(1, 3)) + self.r.choice(("", " We use cookies.")), False, self.r.choice(("p", "div"))) + self.say(self.words(1), False, self.r.choice(("div", "button")))
        elif kind == "ad":
            inner = self.say(self.sentences(self.r.randint(1, 2)), False, self.r.choice(("p", "div")), self.r.random() < 0.3)
        elif kind == "form":
            inner = self.say(self.words(2), False, "label") + self.say(self.sentences(1), False, "p")
        elif kind == "comments":
            return self.box(kind, self.comments(), max(0.85, self.marked))
        elif kind == "share":
            inner = self.links(2, 4)
        else:
            inner = self.links(0, 4) + self.say(self.r.choice(("© ", "Copyright ", "")) + self.words(self.r.randint(2, 8)), False, self.r.choice(("p", "div")))
        return self.box(kind, inner)

    def split_paragraph(self) -> str:
        """A paragraph with an advert in its middle."""
        before, ad, after = (self.say(self.sentences(1) if i < 2 else self.words(self.r.randint(1, 9)), i != 1, "i") for i in range(3))
        return f'<p>{before}<span class="{self.r.choice(("ad-slot", "advert", "promo"))}">{ad}</span>{after}</p>'

    def article(self) -> str:
        r = self.r
        parts = [self.say(self.words(r.randint(1, 12)), True, "h1")] if r.random() < 0.85 else []
        paragraph = "div" if r.random() < 0.15 else "p"
        for _ in range(r.choice((1, 2, 3, 4, 6, 8, 12))):
            x = r.random()
            if x < 0.62:
                parts.append(self.say(self.sentences(r.choice((1, 1, 2, 3, 5, 8))), True, paragraph))
            elif x < 0.74:
                parts.append(self.say(self.words(r.randint(1, 5)), True, paragraph))
            elif x < 0.82:
                parts.append(self.say(self.words(r.randint(1, 6)), True, r.choice(("h2", "h3"))))
            elif x < 0.89:
                parts.append("<ul>" + "".join(self.say(self.words(r.randint(1, 9)), True, "li", r.random() < 0.1) for _ in range(r.randint(2, 5))) + "</ul>")
            elif x < 0.93:
                parts.append("<blockquote>" + self.say(self.sentences(2), True, "p") + "</blockquote>")
            elif x < 0.96:
                parts.append("<table><tr>" + "".join(self.say(self.words(r.randint(1, 4)), True, "td") for _ in range(4)) + "</tr></table>")
            else:
                parts.append("<figure><img src=x>" + self.say(self.words(r.randint(2, 9)), True, "figcaption") + "</figure>")
            if r.random() < 0.1:
                kind = r.choice(("ad", "sidebar", "share", "notice", "form"))
                inner = self.links(2, 3) if kind == "share" else "".join(self.say(self.sentences(r.choice((1, 2, 5))), False, r.choice(("p", "div"))) for _ in range(r.randint(1, 2)))
                parts.append(self.box(kind, inner, 1.0))
            if r.random() < 0.04:
                parts.append(self.split_paragraph())
        if r.random() < 0.2:
            parts.append(self.box("share", self.links(2, 4), 1.0))
        if r.random() < 0.1:
            parts.append(self.box("comments", self.comments(), 1.0))
        inner = "".join(parts)
        if r.random() < self.marked:
            tag, name = r.choice((("article", ""), ("article", ""), ("main", ""), ("div", r.choice(_ARTICLE_CLASSES)), ("section", r.choice(_ARTICLE_CLASSES))))
            return f'<{tag}{f" class={chr(34)}{name}{chr(34)}" if name else ""}>{inner}</{tag}>'
        return f"<div{self.noise()}>{inner}</div>"

    def make(self) -> Page:
        r = self.r
        if r.random() < 0.06:  # nothing but text or paragraphs
            if r.random() < 0.4:
                text = " ".join(self.words(r.randint(1, 40)).split()) + r.choice(("", "."))
                self.page.content.add(text)
                self.page.html = text
            else:
                self.page.html = "".join(self.say(r.choice((self.words(r.randint(1, 6)), self.sentences(r.randint(1, 4)))), True, r.choice(("p", "p", "div", "h2"))) for _ in range(r.randint(1, 6)))
            return self.page
        before = [k for k in ("header", "nav", "notice", "ad", "form") if r.random() < 0.4]
        after = [k for k in ("sidebar", "ad", "comments", "form", "nav", "notice", "footer") if r.random() < 0.4]
        parts = [self.other(k) for k in before] + [self.article()] + [self.other(k) for k in after]
        for _ in range(r.randint(0, 2)):  # a run of parts in an element of its own
            a = r.randrange(len(parts))
            b = r.randint(a + 1, len(parts))
            name = r.choice(("", "", ' class="wrapper"', ' class="widget"', ' id="page"', ' class="layout has-sidebar"', ' class="row"'))
            parts[a:b] = [f"<div{name}>" + "".join(parts[a:b]) + "</div>"]
        self.page.html = "<html><body>" + "\n".join(parts) + "</body></html>"
        return self.page


def make_page(seed: int) -> Page:
    return _Maker(seed).make()
