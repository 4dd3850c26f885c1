"""Seeded web pages with known main text, to train the block labeller.

Layouts vary in elements, class names, nesting, broken markup, and in which
boilerplate stands before, after and inside the article.  Words are invented,
so that the model learns from paths, measures and context.
"""

from __future__ import annotations

import html
import random

#: Class and id names that sites use.
ROLES = {
    "nav": "nav menu navbar navigation main-nav site-nav topnav breadcrumb breadcrumbs tabs pagination pager toc",
    "header": "header site-header masthead topbar banner-top branding logo hero-head page-header",
    "footer": "footer site-footer page-footer bottom colophon copyright legal footer-links",
    "aside": "sidebar aside side-bar widget rail related recommended more-stories popular trending tag-cloud archive",
    "ad": "ad ads advert advertisement adsbox sponsor sponsored promo promotion banner ad-slot google-ad",
    "notice": "notice cookie cookie-banner consent gdpr alert popup modal overlay newsletter subscribe signup paywall disclaimer",
    "form": "search login contact form newsletter-form signup poll",
    "comment": "comments comment comment-list discussion replies responses reader-comments disqus thread",
    "share": "share social sharing buttons follow tools print",
    "meta": "meta byline author date posted-on tags category entry-meta",
    "content": "content article post entry story main text body article-body post-content entry-content main-content richtext document hentry prose copy blog-post story-body post-body page-content single",
    "title": "title headline entry-title post-title lead standfirst intro dek subtitle",
    "neutral": "wrap wrapper container row col page section inner box block grid clearfix outer",
}
ROLES = {k: v.split() for k, v in ROLES.items()}
#: Words that are common in boilerplate.
COMMON = "home about contact privacy terms login register search menu subscribe cookies accept share follow reply comment posted news sports archive help sitemap rss advertise careers next previous read more".split()
SYLLABLES = "an be ci do er fu ga he in jo ka li mo ne or pa qui re sta tho un ve wa ye zu tion ing der sch eau é ñ lo ment ar es".split()


class Page:
    def __init__(self, seed: int) -> None:
        self.r = random.Random(seed)
        self.main: list[str] = []

    def word(self) -> str:
        return "".join(self.r.choices(SYLLABLES, k=self.r.choice((1, 1, 2, 2, 2, 3, 4))))

    def words(self, n: int, common: float = 0.0) -> str:
        out = [self.r.choice(COMMON) if self.r.random() < common else self.word() for _ in range(n)]
        out[0] = out[0].capitalize()
        return " ".join(out)

    def sentences(self, n: int) -> str:
        r, style = self.r, self.r.random()
        out = []
        for _ in range(n):
            s = self.words(r.choice((2, 4, 7, 9, 12, 16, 22)))
            if style < 0.05:
                s = " | ".join(s.split())
            elif style < 0.08:
                s = " ".join(f"{x}{r.choice('#%&*+=/@~') * r.randint(0, 3)}" for x in s.split())
            elif style < 0.11:
                s = " ".join([s.split()[0]] * r.randint(2, 20))
            elif style < 0.13:
                s = s.upper()
            elif style < 0.6 and r.random() < 0.3:
                s = s.replace(" ", ", ", 1)
            out.append(s + r.choice((".", ".", ".", ".", "?", "!", ":", "")))
        return " ".join(out)

    def names(self, role: str) -> str:
        r = self.r
        told = r.random()
        if told < 0.15:
            role = "neutral"
        name = self.word() if told > 0.92 else r.choice(ROLES[role])
        if r.random() < 0.15:
            name = r.choice((f"{r.choice('abcmost')}-{name}", f"{name}__{self.word()}", f"{r.choice(ROLES['neutral'])}-{name}", f"{name}-{self.word()}"))
        if r.random() < 0.25:
            name = f"{name} {r.choice(ROLES['neutral'])}"
        if r.random() < 0.15:
            name = name.replace("-", r.choice(("_", "")))
        kind = r.choice(("class", "class", "class", "id"))
        quote = r.choice(('"', '"', "'", "")) if " " not in name else '"'
        return f" {kind}={quote}{name}{quote}"

    def box(self, role: str, inner: str, tags: str) -> str:
        tag = self.r.choice(tags.split())
        plain = tag not in ("div", "section", "span", "ul")
        return f"<{tag}{'' if plain and self.r.random() < 0.6 else self.names(role)}>{inner}</{tag}>"

    def links(self, n: int, sep: str = "") -> str:
        r = self.r
        one = lambda: f'<a href="/{self.word()}">{html.escape(self.words(r.randint(1, 3), 0.4))}</a>'
        if r.random() < 0.6:
            return "<ul>" + "".join(f"<li>{one()}</li>" for _ in range(n)) + "</ul>"
        return (sep or r.choice((" | ", " ", " &middot; "))).join(one() for _ in range(n))

    def boilerplate(self, role: str) -> str:
        r = self.r
        if role == "nav":
            return self.box(role, self.links(r.randint(2, 9)), "nav nav div div ul div")
        if role == "header":
            return self.box(role, f"{r.choice(('', '<h1>' + self.words(2) + '</h1>', '<p>' + self.words(3) + '</p>'))}<span>{self.words(r.randint(1, 5), 0.3)}</span>" + (self.boilerplate("nav") if r.random() < 0.4 else ""), "header header div")
        if role == "footer":
            owner = r.choice((f"{self.word()}.{r.choice(('com', 'org', 'net', 'de'))}", self.words(2), ""))
            inner = r.choice(("&copy; ", "", "© 2024 ", "Copyright ")) + owner + r.choice((" &middot; ", " | ", ". ", " ")) + self.sentences(r.randint(1, 3))
            return self.box(role, (f"<p>{inner}</p>" if r.random() < 0.4 else inner) + (self.links(3) if r.random() < 0.3 else ""), "footer footer div div")
        if role == "aside":
            return self.box(role, f"<h{r.randint(2, 4)}>{self.words(2, 0.3)}</h3>" + (self.links(r.randint(2, 6)) if r.random() < 0.6 else "".join(f"<p>{self.sentences(r.randint(1, 3))}</p>" for _ in range(r.randint(1, 3)))), "aside aside div")
        if role == "ad":
            inner = self.sentences(r.randint(1, 3))
            return self.box(role, r.choice((inner, f"<p>{inner}</p>", f'<a href="/x">{inner}</a>')), "div div div ins aside section")
        if role == "notice":
            return self.box(role, f"<p>{self.sentences(r.randint(1, 2))}</p>" + r.choice(("", "<button>OK</button>", self.links(1))), "div div section aside dialog")
        if role == "form":
            return f"<form{self.names(role)}><label>{self.words(2, 0.5)}</label><input name=q><p>{self.sentences(1)}</p><button>{self.words(1, 1.0)}</button></form>"
        if role == "comment":
            each = lambda: self.box("comment", f"<{(t := r.choice(('p', 'div', 'span')))}>{self.sentences(r.randint(1, 4))}</{t}>", "div li article div")
            return self.box(role, f"<h3>{self.words(2, 0.5)}</h3>" * (r.random() < 0.7) + "".join(each() for _ in range(r.randint(1, 5))), "section div div ol")
        return self.box(role, self.links(r.randint(1, 4)) if role == "share" else f"<span>{self.words(r.randint(1, 4), 0.3)}</span>", "div ul p span" if role == "meta" else "div ul")

    def say(self, text: str) -> str:
        """Main text, remembered as a reader would see it, and written as HTML."""
        self.main.append(" ".join(text.split()))
        r = self.r
        out = html.escape(text, quote=r.random() < 0.5)
        words = out.split(" ")
        if len(words) > 3 and r.random() < 0.3:
            i = r.randrange(len(words) - 1)
            tag = r.choice(("b", "i", "em", "strong", "a", "span", "code"))
            words[i] = f"<{tag}{' href=/x' if tag == 'a' else ''}>{words[i]}</{tag}>"
        return " ".join(words)

    def article(self) -> str:
        r, out = self.r, []
        title = self.sentences(1) if r.random() < 0.6 else self.words(r.randint(2, 9))
        named = lambda role: self.names(role) if r.random() < 0.2 else ""
        if r.random() < 0.85:
            n = r.choice((1, 1, 1, 2, 3))
            out.append(f"<h{n}{named('title')}>{self.say(title)}</h{n}>")
            if r.random() < 0.15:
                out.append(f"<{(t := r.choice(('p', 'div', 'h2')))}{self.names('title')}>{self.say(self.sentences(1))}</{t}>")
        if r.random() < 0.2:
            out.append(self.boilerplate("meta"))
        count = r.choice((0, 1, 1, 2, 3, 5, 8, 12, 20))
        broken, closed = r.random() < 0.35, r.choice(("</p>", "</p>", "</p>", "\n"))
        opened = r.choice(("p", "p", "p", "p", "div"))
        for i in range(count):
            kind = r.random()
            text = self.sentences(r.choice((1, 1, 2, 4, 7)))
            if i == 0 and r.random() < 0.4:
                text = title + " " + text if r.random() < 0.5 else title
            if kind < 0.08:
                out.append(f"<h{(n := r.randint(2, 4))}>{self.say(self.words(r.randint(1, 6)))}</h{n}>")
            elif kind < 0.13:
                tag = r.choice(("ul", "ol"))
                out.append(f"<{tag}>" + "".join(f"<li>{self.say(self.sentences(1))}" + r.choice(("</li>", "")) for _ in range(r.randint(2, 4))) + f"</{tag}>")
            elif kind < 0.17:
                out.append(f"<blockquote>{self.say(text)}</blockquote>")
            elif kind < 0.20:
                out.append(f"<pre>{self.say(text)}</pre>")
            elif broken and kind < 0.45:
                tag = r.choice(("b", "i", "strong", "font", "span", "em"))
                out.append(f"<p><{tag}>{self.say(text)}{r.choice(('<br>', '<br/>', '', '</div>'))}")
            elif kind < 0.5:
                out.append(f"<p>{self.say(text)}")
            elif kind < 0.58:
                out.append(f"<div>{self.say(text)}</div>")
            elif opened == "div":
                out.append(f"<div{named('content')}>{self.say(text)}</div>")
            else:
                out.append(f"<p{named('content')}>{self.say(text)}{closed}")
            if r.random() < 0.06:
                out.append(self.boilerplate(r.choice(("ad", "aside", "share", "notice", "form"))))
        if r.random() < 0.1:
            out.append(self.boilerplate("share"))
        if r.random() < 0.12:
            out.append(self.boilerplate("comment"))
        return "".join(out)

    def build(self) -> str:
        r = self.r
        before = [x for x, p in (("notice", 0.2), ("header", 0.45), ("nav", 0.8), ("ad", 0.45), ("form", 0.12), ("aside", 0.15)) if r.random() < p]
        after = [x for x, p in (("share", 0.15), ("comment", 0.3), ("aside", 0.3), ("form", 0.12), ("ad", 0.2), ("nav", 0.1), ("footer", 0.85), ("notice", 0.1)) if r.random() < p]
        if r.random() < 0.3:
            r.shuffle(before)
        head = "".join(f"<!-- {x} -->" * (r.random() < 0.2) + self.boilerplate(x) for x in before)
        body = self.article()
        wrap = r.random()
        if wrap < 0.35:
            body = f"<article{self.names('content') if r.random() < 0.4 else ''}>{body}</article>"
        elif wrap < 0.47:
            body = f"<main>{body}</main>"
        elif wrap < 0.55:
            side = f"<td{self.names('nav')}>{self.links(r.randint(2, 6), '<br>')}</td>" if r.random() < 0.6 else ""
            body = f"<table width=100%><tr>{side}<td{self.names('content') if r.random() < 0.5 else ''}>{body}</td></tr></table>"
        else:
            tag = r.choice(("div", "div", "div", "section"))
            body = f"<{tag}{self.names('content')}>{body}</{tag}>"
        for _ in range(r.choice((0, 0, 1, 1, 2))):
            body = f"<{(t := r.choice(('main', 'div', 'div', 'section')))}{self.names(r.choice(('neutral', 'neutral', 'content')))}>{body}</{t}>"
        tail = "".join(self.boilerplate(x) for x in after)
        script = r.choice(("", '<script>var t="</p>";track(1);</script>', "<style>p{margin:0}</style>"))
        title = f"<title>{self.words(4)}</title>" if r.random() < 0.9 else ""
        return f"<!DOCTYPE html><html><head><meta charset=utf-8>{title}{script}</head><body>{head}{body}{tail}</body></html>"


def page(seed: int) -> tuple[str, list[str]]:
    """A page and the texts of its main blocks in order."""
    made = Page(seed)
    out = made.build()
    return out, made.main
