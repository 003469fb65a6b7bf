"""Labelled web pages made by rule: articles among menus, headers, notices, adverts, forms, sidebars, comments and footers."""

from __future__ import annotations

import random
from collections.abc import Iterator

from tierlens.llm.html_blocks import LABEL

# what page authors call the parts of a page, in class and id
_NAMES = {
    "menu": "nav menu navbar navigation topnav main-menu nav-links breadcrumb breadcrumbs pagination pager toolbar tabs",
    "header": "header masthead site-header top topbar page-header branding logo",
    "notice": "cookie cookie-notice cookies consent gdpr notice alert cookie-banner banner popup modal overlay paywall message info-bar",
    "advert": "ad ads advert advertisement adsense sponsored sponsor promo promotion banner-ad ad-slot commercial partner ad-box",
    "side": "sidebar side rail aside widget widgets related related-posts recommended popular trending most-read more-stories teaser teasers tags tag-cloud archive categories",
    "share": "share sharing social social-links share-buttons follow",
    "form": "newsletter subscribe signup login search search-form contact-form register subscription",
    "comments": "comments comment comment-list disqus respond replies reply discussion responses reader-comments feedback",
    "footer": "footer site-footer bottom colophon copyright page-footer legal foot imprint",
    "main": "content main article post entry story article-body post-content entry-content main-content story-body text body-text page-content hentry",
    "plain": "container wrapper page inner row col outer site layout wrap box",
}
_NAMES = {kind: names.split() for kind, names in _NAMES.items()}
_SCRIPTS = ("aeiouestnrlmd", "éèàçouentrsl", "äöüßeinrstgh", "áóñíaosenrl", "аеиностврлкд", "αβγδεικλνορστ")


class _Pen:
    """Writes one page's words and elements."""

    def __init__(self, rng: random.Random):
        self.rng = rng
        self.letters = rng.choice(_SCRIPTS)
        self.cjk = rng.random() < 0.06

    def word(self) -> str:
        if self.cjk:
            return "".join(chr(0x4E00 + self.rng.randrange(2_000)) for _ in range(self.rng.randint(1, 3)))
        return "".join(self.rng.choice(self.letters) for _ in range(self.rng.randint(1, 9)))

    def words(self, low: int, high: int) -> str:
        rng = self.rng
        said = [self.word() for _ in range(int(round(low * (high / low) ** rng.random())))]
        out = []
        for k, w in enumerate(said):
            if rng.random() < 0.01:
                w = rng.choice(("&amp;", "&lt;", "&quot;x&quot;", "&nbsp;", "12", "3.5", "%%%", "###", "&amp;&amp;"))
            out.append(w.capitalize() if k == 0 else w)
        return ("" if self.cjk else " ").join(out)

    def prose(self, low: int, high: int) -> str:
        rng, left, out = self.rng, int(round(low * (high / low) ** self.rng.random())), []
        while left > 0:
            n = min(left, rng.randint(3, 22))
            text = self.words(n, n)
            if rng.random() < 0.16:
                text = self.inline(text)
            out.append(text + rng.choices((".", ",", "!", "?", ""), (70, 12, 4, 4, 10))[0])
            left -= n
        return " ".join(out)

    def inline(self, text: str) -> str:
        tag = self.rng.choice(("b", "i", "em", "strong", "a", "span", "code"))
        return f'<a href="/{self.rng.randrange(999)}">{text}</a>' if tag == "a" else f"<{tag}>{text}</{tag}>"

    def links(self, low: int, high: int) -> str:
        rng = self.rng
        items = [f'<a href="/{k}">{self.words(1, 4)}</a>' for k in range(rng.randint(low, high))]
        style = rng.randrange(3)
        if style == 0:
            return "<ul>" + "".join(f"<li>{i}</li>" if rng.random() < 0.9 else f"<li>{i}" for i in items) + "</ul>"
        return rng.choice((" | ", " ", "<br>", " &middot; ")).join(items)

    def named(self, kind: str, inside: str, tags: tuple = ("div",), bare: float = 0.0) -> str:
        """An element of this kind with a fitting name; of `bare` share without."""
        rng = self.rng
        tag = rng.choice(tags)
        name = "" if rng.random() < bare else f' {rng.choice(("class", "class", "id"))}="{rng.choice(_NAMES[kind])}"'
        return f"<{tag}{name}>{inside}</{tag}>"

    # parts beside the article

    def menu(self) -> str:
        return self.named("menu", self.links(2, 9), ("nav", "nav", "div", "ul"), 0.3) if self.rng.random() < 0.7 else f"<nav>{self.links(2, 9)}</nav>"

    def header(self) -> str:
        rng = self.rng
        inside = rng.choice((f"<h1>{self.words(1, 4)}</h1>", f'<a href="/">{self.words(1, 3)}</a>', f"<p>{self.words(2, 12)}</p>")) + (self.menu() if rng.random() < 0.5 else "")
        return f"<header>{inside}</header>" if rng.random() < 0.5 else self.named("header", inside, ("div", "header"))

    def notice(self) -> str:
        button = f"<button>{self.words(1, 3)}</button>" if self.rng.random() < 0.6 else ""
        return self.named("notice", f"<p>{self.prose(4, 40)}</p>{button}" if self.rng.random() < 0.6 else self.prose(4, 40) + button, ("div", "div", "section", "aside"))

    def advert(self) -> str:
        text = self.prose(2, 30)
        inside = self.rng.choice((text, f"<p>{text}</p>", f'<a href="/buy">{text}</a>', f"<h3>{self.words(2, 6)}</h3><p>{text}</p>"))
        return self.named("advert", inside, ("div", "div", "aside", "section", "p"))

    def side(self) -> str:
        rng = self.rng
        parts = "".join(f"<h3>{self.words(1, 5)}</h3>" + rng.choice((self.links(2, 7), f"<p>{self.prose(4, 30)}</p>", f"<ul><li>{self.words(3, 12)}</li><li>{self.words(3, 12)}</li></ul>")) for _ in range(rng.randint(1, 3)))
        return f"<aside>{parts}</aside>" if rng.random() < 0.4 else self.named("side", parts, ("div", "aside", "section"))

    def share(self) -> str:
        return self.named("share", self.links(2, 4))

    def form(self) -> str:
        rng = self.rng
        inside = f"<label>{self.words(1, 4)}</label><input name=q>" + (f"<p>{self.prose(3, 20)}</p>" if rng.random() < 0.5 else "")
        inside += rng.choice(("", f"<select><option>{self.word()}<option>{self.word()}</select>", f"<textarea>{self.words(1, 8)}</textarea>")) + f"<button>{self.words(1, 2)}</button>"
        form = f"<form action=/x>{inside}</form>"
        return self.named("form", form, ("div", "section")) if rng.random() < 0.4 else form

    def comments(self) -> str:
        rng = self.rng
        one = lambda: self.named("comments", f"<b>{self.words(1, 2)}</b> " + rng.choice((f"<p>{self.prose(2, 60)}</p>", self.prose(2, 60))), ("div", "li", "article"), 0.2)
        inside = f"<h2>{self.words(1, 3)}</h2>" * (rng.random() < 0.7) + "".join(one() for _ in range(rng.randint(1, 5))) + (self.form() if rng.random() < 0.3 else "")
        return self.named("comments", inside, ("section", "div", "ol"))

    def footer(self) -> str:
        rng = self.rng
        inside = rng.choice((f"&copy; {self.word()}.example &middot; {self.prose(2, 14)}", f"<p>© 2020 {self.words(2, 9)}</p>" + self.links(2, 6), f"<address>{self.words(3, 9)}</address>", self.prose(3, 30)))
        return f"<footer>{inside}</footer>" if rng.random() < 0.6 else self.named("footer", inside, ("div", "section", "footer"))

    def between(self) -> str:
        """Something that stands in the middle of an article and isn't it."""
        make = self.rng.choices((self.advert, self.side, self.form, self.share, self.notice, self.comments, self.menu, self.footer), (6, 3, 1, 2, 1, 2, 1, 1))[0]
        return f'<div {LABEL}="0">{make()}</div>' if self.rng.random() < 0.2 else make().replace(">", f' {LABEL}="0">', 1)

    # the article

    def article(self) -> str:
        rng = self.rng
        title = f"<h1>{self.words(1, 14)}{rng.choice(('', '', '.'))}</h1>"
        if rng.random() < 0.15:
            title = f"<header>{title}</header>"
        parts = [title] if rng.random() < 0.75 else []
        for _ in range(int(round(18 ** rng.random())) if rng.random() < 0.8 else 1):
            kind, text = rng.random(), self.prose(1, 160)
            if rng.random() < 0.12:     # tables written as text, prices, credits
                text = text.replace(" ", rng.choice((" | ", " · ", " » ", " © ")), rng.randint(1, 60))
            if kind < 0.72:
                parts.append(f"<p>{text}" + ("</p>" if rng.random() < 0.9 else ""))
            elif kind < 0.78:
                parts.append(f"<p><b>{text}<br>")
            elif kind < 0.82:
                parts.append(f"<h2>{self.words(1, 9)}</h2>")
            elif kind < 0.87:
                parts.append("<ul>" + "".join(f"<li>{self.prose(1, 30)}</li>" for _ in range(rng.randint(2, 5))) + "</ul>")
            elif kind < 0.9:
                parts.append(f"<blockquote>{text}</blockquote>")
            elif kind < 0.92:
                parts.append("<table>" + "".join(f"<tr><td>{self.words(1, 4)}</td><td>{rng.randrange(9999)}</td></tr>" for _ in range(rng.randint(1, 4))) + "</table>")
            elif kind < 0.96:
                parts.append(f"<div>{text}</div>")
            else:
                parts.append(f"{text}<br><br>")
            if rng.random() < 0.16:
                parts.append(self.between())
        if rng.random() < 0.15:
            parts.append(self.between())
        return self.wrapped("".join(parts))

    def wrapped(self, inside: str) -> str:
        rng = self.rng
        style, mark = rng.random(), f'{LABEL}="1"'
        if style < 0.4:
            body = f"<article {mark}>{inside}</article>"
        elif style < 0.8:
            tag = rng.choice(("div", "div", "section", "td", "article"))
            body = f'<{tag} {mark} {rng.choice(("class", "id"))}="{rng.choice(_NAMES["main"])}">{inside}</{tag}>'
            if tag == "td":
                body = f"<table><tr>{body}</tr></table>"
        else:
            body = f"<div {mark}>{inside}</div>"
        return f"<main>{body}</main>" if rng.random() < 0.25 else body

    def page(self) -> str:
        rng = self.rng
        some = lambda share, make: [make()] if rng.random() < share else []
        before = some(0.25, self.notice) + some(0.45, self.header) + some(0.7, self.menu) + some(0.2, lambda: "<!-- ad -->") + some(0.45, self.advert) + some(0.15, self.side) + some(0.12, self.form)
        after = some(0.15, self.share) + some(0.3, self.comments) + some(0.3, self.side) + some(0.2, self.advert) + some(0.15, self.form) + some(0.15, self.menu) + some(0.15, self.notice)
        last = some(0.8, self.footer)
        if rng.random() < 0.3:      # few parts, or the article alone
            before, after, last = before[: rng.choice((0, 0, 1))], [], last if rng.random() < 0.4 else []
        if rng.random() < 0.3:
            rng.shuffle(before)
        rng.shuffle(after)
        inside = "".join(before) + self.article() + "".join(after) + "".join(last)
        if rng.random() < 0.25:
            inside = self.named("plain", inside)
        head = f'<head><meta charset="utf-8"><title>{self.words(1, 9)}</title><style>p{{margin:0}}</style><script>var t="</p>";go(0);</script></head>'
        end = "</body></html>" if rng.random() < 0.9 else ""
        if rng.random() < 0.1:
            return inside
        return f"<!DOCTYPE html><html>{head}<body>{inside}{end}"


    def lone(self) -> str:
        """A page of one part: a short article, seldom something else."""
        rng = self.rng
        if rng.random() < 0.2:
            return rng.choice((self.menu, self.notice, self.footer))()
        said = self.prose(1, 12) if rng.random() < 0.5 else self.words(1, 4)
        body = self.wrapped(f"<p>{said}" + rng.choice(("</p>", "</p>", "")))
        return f"<body>{body}" if rng.random() < 0.3 else body


def labelled_pages(count: int, seed: int = 7) -> Iterator[str]:
    """`count` pages whose article carries the label attribute, the same for a seed; every part of a page has many names and forms.

    Every 20th page is one part alone.
    """
    for k in range(count):
        pen = _Pen(random.Random(seed * 1_000_003 + k))
        yield pen.lone() if k % 20 == 19 else pen.page()
