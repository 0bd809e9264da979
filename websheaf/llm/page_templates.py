"""Labelled pages for the extractor: layouts drawn from a seed, each block known to be content or not."""

from __future__ import annotations

import html
import random

_SYLLABLES = "ba che di en for ga hi in ka lo men no on pre que re st ti un ver wa zu é ü ñ th er an ed".split()

#: Names that sites give to what is not the article, by kind: class or id values.
_CHROME = {
    "menu": "nav navbar menu main-menu top-menu breadcrumbs pagination site-nav".split(),
    "header": "header site-header masthead top-bar banner".split(),
    "footer": "footer site-footer bottom colophon copyright".split(),
    "sidebar": "sidebar side-bar widget widget-area related related-posts recommended popular right-rail".split(),
    "notice": "notice cookie-notice cookie-consent consent alert announcement banner-message gdpr modal popup".split(),
    "advert": "ad ads advert advertisement ad-slot sponsored promo".split(),
    "form": "form newsletter subscribe signup search-form login contact-form".split(),
    "comments": "comments comment comment-list comment-body reader-comments responses discussion disqus reply".split(),
    "share": "share social social-links share-buttons".split(),
}
#: Words that any part of a page may have in its names.
_PARTS = "container wrapper box area block inner outer section content list main body group holder row page".split()
#: Names that sites give to what holds an article, and ways to write its paragraphs: `bare` is text parted by line breaks.
_BODIES = (
    "article main post post-body entry-content article-body content story main-content body entry text prose post-content article-content story-body markdown-body"
    " page-content body-text article-text s-prose post-text rich-text copy read chapter document mw-parser-output single hentry"
).split()
_PARAGRAPHS = ["p"] * 6 + ["div"] * 4 + ["span", "bare"]


class _Page:
    def __init__(self, seed: int):
        self.r = random.Random(seed)
        self.labels: dict[str, bool] = {}
        self.paragraph = self.r.choice(_PARAGRAPHS)

    def words(self, least: int, most: int) -> str:
        r = self.r
        return " ".join("".join(r.choices(_SYLLABLES, k=r.randint(1, 3))) for _ in range(r.randint(least, most)))

    def block(self, tag: str, content: bool, least: int, most: int, link: bool = False) -> str:
        text = self.words(least, most)
        if self.r.random() < 0.7 and most > 6:
            text = text[:1].upper() + text[1:] + "."
        if text in self.labels:
            text += f" {len(self.labels)}"
        self.labels[text] = content
        shown = html.escape(text)
        if link:
            shown = f'<a href="/{self.r.randint(1, 999)}">{shown}</a>'
        elif self.r.random() < 0.15:
            shown = f"<b>{shown}</b>" if self.r.random() < 0.6 else f"<b>{shown}<br>"
        end = "" if tag in ("p", "li") and self.r.random() < 0.15 else f"</{tag}>"
        return f"<{tag}>{shown}{end}"

    def named(self, kind: str, tags: list[str]) -> tuple[str, str]:
        tag = self.r.choice(tags)
        if tag in ("nav", "header", "footer", "aside", "form") and self.r.random() < 0.5:
            return f"<{tag}>", f"</{tag}>"
        attr = self.r.choice(["class", "class", "id"])
        return f'<{tag} {attr}="{self.suffixed(self.r.choice(_CHROME[kind]))}">', f"</{tag}>"

    def suffixed(self, name: str) -> str:
        """Names are often compounds with a word that says nothing: ad-container, comments-area."""
        return f"{name}-{self.r.choice(_PARTS)}" if self.r.random() < 0.4 else name

    def chrome(self, kind: str) -> str:
        r = self.r
        if kind == "menu":
            a, b = self.named(kind, ["nav", "nav", "div", "ul"])
            return a + "<ul>" + "".join(self.block("li", False, 1, 2, True) for _ in range(r.randint(3, 8))) + "</ul>" + b
        if kind == "header":
            a, b = self.named(kind, ["header", "header", "div"])
            return a + self.block(r.choice(["h1", "h2", "div", "p"]), False, 1, 4, r.random() < 0.5) + (self.chrome("menu") if r.random() < 0.5 else "") + b
        if kind == "footer":
            a, b = self.named(kind, ["footer", "footer", "div"])
            inner = "".join(self.block(r.choice(["p", "div", "li"]), False, 2, 14, r.random() < 0.4) for _ in range(r.randint(0, 3)))
            text = f"© {self.words(1, 2)} · {self.words(3, 12)}"
            self.labels[text] = False
            return a + inner + text.replace("©", "&copy;").replace("·", "&middot;") + b
        if kind == "sidebar":
            a, b = self.named(kind, ["aside", "aside", "div", "section"])
            return a + self.block(r.choice(["h2", "h3", "h4"]), False, 1, 4) + "".join(self.block(r.choice(["li", "p", "p", "div"]), False, 2, 30, r.random() < 0.5) for _ in range(r.randint(1, 6))) + b
        if kind == "comments":
            a, b = self.named(kind, ["section", "div", "ol"])
            inner = "".join(f'<div class="{r.choice(_CHROME[kind])}">' * (k := r.randint(0, 1)) + self.block(r.choice(["p", "p", "div", "li"]), False, 3, 60) + "</div>" * k for _ in range(r.randint(1, 6)))
            return a + (self.block(r.choice(["h2", "h3"]), False, 1, 3) if r.random() < 0.6 else "") + inner + b
        if kind == "form":
            a, b = self.named(kind, ["form", "form", "div"])
            return a + "".join(self.block(r.choice(["p", "label", "button", "h3"]), False, 1, 12) for _ in range(r.randint(1, 4))) + '<input type="text">' + b
        a, b = self.named(kind, ["div", "div", "section", "aside"] if kind != "share" else ["div", "ul"])
        return a + self.bare(kind) + b

    def bare(self, kind: str) -> str:
        """Text of a notice, an advert or share links: often without a tag of its own."""
        if kind != "share" and self.r.random() < 0.5:
            text = self.words(3, 40) + "."
            self.labels[text] = False
            return html.escape(text)
        return "".join(self.block(self.r.choice(["p", "div", "span"] if kind != "share" else ["li", "a"]), False, 2, 30, kind == "share") + "<hr>" for _ in range(self.r.randint(1, 2)))

    def prose(self, least: int, most: int) -> str:
        """A paragraph of the article, as this page writes them."""
        if self.paragraph == "bare":
            return f"{self.block('span', True, least, most)}<hr>" if self.r.random() < 0.5 else self.block("div", True, least, most).replace("</div>", "<br><br></div>")
        if self.paragraph == "span":
            return "<div>" * (k := self.r.randint(1, 2)) + self.block("span", True, least, most) + "</div>" * k
        return self.block(self.paragraph, True, least, most)

    def held(self, inner: str) -> str:
        """`inner` in up to three containers, some without a name, some with a name that says nothing."""
        r = self.r
        for _ in range(r.choice([0, 0, 1, 1, 2, 3])):
            name = r.choice([*_BODIES, *_PARTS, "".join(r.choices(_SYLLABLES, k=2))])
            extra = f" {self.suffixed(r.choice(_BODIES + _PARTS))}" if r.random() < 0.3 else ""
            tag = r.choice(["div", "div", "div", "section"])
            inner = f"<{tag}>{inner}</{tag}>" if r.random() < 0.3 else f'<{tag} {r.choice(["class", "class", "id"])}="{self.suffixed(name)}{extra}">{inner}</{tag}>'
        return inner

    def article(self) -> str:
        r = self.r
        out = []
        if r.random() < 0.9:
            heading = self.block("h1", True, 3, 12)
            out.append(f"<header>{heading}</header>" if r.random() < 0.2 else heading)
        for _ in range(r.randint(1, 14)):
            kind = r.random()
            if kind < 0.72:
                out.append(self.prose(1, 120))
            elif kind < 0.74:
                out.append(self.block(r.choice(["h2", "h3", "blockquote", "pre", "div"]), True, 1, 30))
            elif kind < 0.8:
                tag = r.choice(["ul", "ol"])
                out.append(f"<{tag}>" + "".join(self.block("li", True, 1, 25) for _ in range(r.randint(2, 6))) + f"</{tag}>")
            elif kind < 0.82:
                section = r.choice(["section", "section", 'div class="section"', "div"])
                out.append(f"<{section}>" + self.block("h2", True, 1, 8) + "".join(self.prose(2, 90) for _ in range(r.randint(1, 3))) + f"</{section.split()[0]}>")
            elif kind < 0.84:
                out.append("<table><tr>" + "".join(self.block("td", True, 1, 6) for _ in range(r.randint(2, 6))) + "</table>")
            elif kind < 0.86:
                out.append("<figure>" + self.block("figcaption", True, 3, 20) + "</figure>")
            else:
                out.append(self.chrome(r.choice(["advert", "advert", "notice", "form", "share", "sidebar"])))
        if r.random() < 0.4:
            out.append(self.chrome("comments"))
        inner = self.held("".join(out))
        shape = r.random()
        if shape < 0.4:
            return f"<article>{inner}</article>"
        if shape < 0.5:
            return self.held(f"<div>{inner}</div>")
        name = r.choice(_BODIES)
        if shape < 0.65:
            return f"<main>{inner}</main>"
        if shape < 0.75:
            return f'<main><article class="{name}">{inner}</article></main>'
        return f'<div {r.choice(["class", "id"])}="{self.suffixed(name)}">{inner}</div>'

    def page(self) -> str:
        r = self.r
        top = [self.chrome(k) for k in ("notice", "header", "menu", "advert") if r.random() < 0.5]
        rest = [self.chrome(k) for k in ("share", "sidebar", "comments", "form", "advert", "notice") if r.random() < 0.35]
        if r.random() < 0.2 and rest:
            top.append(rest.pop())
        foot = [self.chrome("footer")] if r.random() < 0.85 else []
        inner = "".join([*top, self.article(), *rest, *foot])
        if r.random() < 0.3:
            inner = f'<div class="{self.suffixed(r.choice(["wrapper", "container", "page", "layout", "site"]))}">{inner}</div>'
        return f"<!DOCTYPE html><html><head><title>{html.escape(self.words(2, 8))}</title><style>p{{margin:0}}</style></head><body>{inner}</body></html>"


def labelled_pages(n: int, seed: int = 1) -> list[tuple[str, dict[str, bool]]]:
    """(html, {block text: is content}) of n pages."""
    out = []
    for i in range(n):
        p = _Page(seed * 1_000_003 + i)
        out.append((p.page(), p.labels))
    return out
