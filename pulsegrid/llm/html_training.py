"""Labelled pages made from a seed, to train the block labeller.

Nothing here comes from the corpus: layouts, names and invented words are drawn
from the lists below, and each block's label is known as it is written.
"""

from __future__ import annotations

import random

#: Names that sites give to containers.
MAIN = ("article", "main", "div.content", "div#content", "div.post", "div.entry-content", "div.article-body", "section.story", "div#main", "div.text", "article.post", "td.body", "div.page")
LINKS = ("nav", "ul.menu", "div.nav", "div#navigation", "nav.breadcrumb", "ol.breadcrumbs", "div.navbar", "div.related", "div.pagination", "div.share", "ul.social", "div.tags", "nav.toc")
NOTES = ("div.ad", "div.ads", "div.advert", "aside.ad", "div.banner", "div.promo", "div.sponsored", "div.cookie", "div#cookie-notice", "div.notice", "div.alert", "div.modal", "div.popup", "div.newsletter", "div.subscribe", "div.disclaimer", "div#consent", "section.ad")
SIDES = ("aside", "div.sidebar", "div#sidebar", "aside.widget", "div.widget", "section.sidebar", "td.side")
TOPS = ("header", "div.header", "div#header", "header.site", "div.masthead", "div.topbar")
ENDS = ("footer", "div.footer", "div#footer", "footer.site", "div.copyright", "div.legal")
TALK = ("section.comments", "div#comments", "ol.commentlist", "div.comment", "div.replies", "section#responses", "div.discussion", "ul.comments")
PHRASES = {
    "note": ("We use cookies to improve your experience", "Advertisement", "Sponsored content", "Subscribe to our newsletter", "Accept all cookies", "Sign up now"),
    "end": ("All rights reserved", "Privacy policy", "Terms of use", "Contact", "© 2024", "Imprint"),
    "talk": ("Reply", "says", "commented 2 days ago", "Report", "Thanks for sharing", "I agree with this"),
    "form": ("Search", "Email address", "Your name", "Submit", "Login", "Password"),
    "link": ("Home", "About", "Contact", "News", "Next", "Previous", "Read more", "Share", "Tweet"),
}


#: Common words, so that texts of words and invented ones are both seen.
COMMON = (
    "the of and to in a is was that for it as with on by are at from this be had have were which not his her an or but they their all one been has can more when "
    "time people year way day new first city water world school house work place state long old great many after before between during about le la les des et une "
    "dans pour que der die das und ist nicht mit von ein eine el los las una por con para"
).split()


class PageMaker:
    def __init__(self, seed: int):
        self.r = random.Random(seed)
        parts = [a + b for a in ("", "th", "st", "b", "r", "ch", "m", "l") for b in ("a", "e", "i", "on", "er", "in", "an", "ü", "é", "ció", "ou")]
        self.syllables = self.r.sample(parts, 40)
        self.common = self.r.choice((0, 0, 0.3, 0.5))

    def word(self) -> str:
        if self.r.random() < self.common:
            return self.r.choice(COMMON)
        return "".join(self.r.choice(self.syllables) for _ in range(self.r.choice((1, 1, 2, 2, 3, 4))))

    def sentence(self, least: int, most: int) -> str:
        words = [self.word() for _ in range(self.r.randint(least, most))]
        junk = self.r.choice(("",) * 12 + ("***", "&amp;&amp;", "%%%"))
        return " ".join(w + junk for w in words).capitalize() + self.r.choice((".", ".", ".", "", "!"))

    def heading(self) -> str:
        """One to eight words, most often a few without a full stop."""
        if self.r.random() < 0.4:
            return self.sentence(1, 8)
        return " ".join(self.word() for _ in range(self.r.choice((1, 1, 1, 2, 2, 3, 5)))).capitalize()

    def prose(self) -> str:
        return " ".join(self.sentence(2, 22) for _ in range(self.r.choice((1, 1, 2, 3, 5, 9))))

    def phrase(self, kind: str) -> str:
        made = self.sentence(1, 14) if kind != "link" else self.sentence(1, 3)
        return self.r.choice((made, made, self.r.choice(PHRASES[kind]), f"{self.r.choice(PHRASES[kind])} {made}"))

    def _open(self, name: str) -> tuple[str, str]:
        tag = name.split(".")[0].split("#")[0]
        if tag in ("div", "section", "td") and name in MAIN and self.r.random() < 0.6:
            # sites name things as they like
            names = " ".join("".join(self.r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(self.r.randint(1, 9))) for _ in range(self.r.randint(1, 4)))
            return f'<{tag} class="{names}">', f"</{tag}>"
        mark = f' class="{name.split(".")[1]}"' if "." in name else f' id="{name.split("#")[1]}"' if "#" in name else ""
        return f"<{tag}{mark}>", f"</{tag}>"

    def page(self) -> tuple[str, list[str]]:
        """(html, the texts of its main blocks in order, with plain single spaces)."""
        r, out, main = self.r, [], []

        def note(names, kind, items=(1, 2)):
            a, b = self._open(r.choice(names))
            inner = "".join(r.choice(("<p>{}</p>", "<div>{}</div>", "{}<br>", "<span>{}</span>", "<h3>{}</h3>")).format(self.phrase(kind)) for _ in range(r.randint(*items)))
            out.append(a + (self.phrase(kind) if r.random() < 0.5 else inner) + b)

        def links(names):
            a, b = self._open(r.choice(names))
            listed = r.random() < 0.7
            items = [f'<a href="/{k}">{self.phrase("link")}</a>' for k in range(r.randint(1, 9))]
            out.append(a + ("<ul>" + "".join(f"<li>{x}</li>" for x in items) + "</ul>" if listed else " | ".join(items)) + b)

        def form():
            out.append("<form action='/'>" + "".join(f"<label>{self.phrase('form')}</label><input>" + r.choice(("", "<p>" + self.phrase("form") + "</p>")) for _ in range(r.randint(1, 3))) + "</form>")

        def talk():
            a, b = self._open(r.choice(TALK))
            rows = "".join(r.choice(('<div class="comment"><p>{}</p></div>', "<li><p>{}</p></li>", "<p>{}</p>", "<article class='comment'><p>{}</p></article>")).format(r.choice((self.prose(), self.phrase("talk")))) for _ in range(r.randint(1, 5)))
            out.append(a + r.choice(("", "<h2>" + self.phrase("talk") + "</h2>")) + rows + b)

        def put(markup: str, text: str):
            out.append(markup.format(text))
            main.append(text)

        def body():
            if r.random() < 0.85:
                put(r.choice(("<h1>{}</h1>", "<h1 class='title'>{}</h1>", "<header><h1>{}</h1></header>")), self.sentence(1, 12))
            for _ in range(r.choice((1, 2, 4, 6, 10, 16))):
                x = r.random()
                if x < 0.58:
                    stray = r.random() < 0.06  # articles, too, quote such phrases
                    text = r.choice(PHRASES[r.choice(("end", "note", "talk"))]) + "." if stray else self.prose()
                    put(r.choice(("<p>{}</p>", "<p>{}</p>", "<p>{}", "<div>{}</div>")), text)
                elif x < 0.65:
                    put("<p><b>{}<br>", self.sentence(2, 18))
                elif x < 0.76:
                    put(r.choice(("<h2>{}</h2>", "<h2>{}</h2>", "<h3>{}</h3>", "<h4>{}</h4>")), self.heading())
                elif x < 0.82:
                    out.append("<ul>")
                    for _ in range(r.randint(1, 5)):
                        put("<li>{}</li>", self.sentence(1, 12))
                    out.append("</ul>")
                elif x < 0.86:
                    put(r.choice(("<blockquote>{}</blockquote>", "<blockquote><p>{}</p></blockquote>", "<pre>{}</pre>")), self.sentence(3, 20))
                elif x < 0.89:
                    out.append("<table>")
                    for _ in range(r.randint(1, 3)):
                        put("<tr><td>{}</td></tr>", self.sentence(1, 6))
                    out.append("</table>")
                elif x < 0.93:
                    note(NOTES, "note")
                elif x < 0.96:
                    links(("div.share", "div.related", "ul.social", "div.tags", "nav.toc"))
                elif x < 0.97:
                    form()

        for _ in range(r.randint(0, 2)):
            r.choice((lambda: links(LINKS), lambda: note(TOPS, "link"), lambda: note(NOTES, "note"), form))()
        if r.random() < 0.4:
            a, b = self._open(r.choice(TOPS))
            out.append(a + f"<a href='/'>{self.phrase('link')}</a>")
            links(LINKS)
            if r.random() < 0.4:
                form()
            out.append(b)
        if r.random() < 0.7:
            links(LINKS)
        if r.random() < 0.6:
            note(NOTES, "note")
        if r.random() < 0.25:
            note(SIDES, "link", (1, 4))
        wrap = self._open(r.choice(("div.wrapper", "div.container", "div#page", "main"))) if r.random() < 0.4 else ("", "")
        a, b = self._open(r.choice(MAIN)) if r.random() < 0.9 else ("", "")
        for _ in range(r.choice((0, 0, 0, 1, 2))):  # containers within each other
            c, d = self._open(r.choice(("div", "div.layout", "div.row", "div.content", "section")))
            a, b = a + c, d + b
        out += [wrap[0], a]
        body()
        inside = r.random() < 0.3
        if inside and r.random() < 0.5:
            talk()
        out.append(b)
        if not inside and r.random() < 0.35:
            talk()
        if r.random() < 0.3:
            r.choice((lambda: links(SIDES), lambda: note(SIDES, "link", (1, 4))))()
        out.append(wrap[1])
        if r.random() < 0.3:
            r.choice((lambda: links(LINKS), lambda: note(NOTES, "note"), form))()
        if r.random() < 0.85:
            note(ENDS, "end", (1, 3))
        tail = r.choice(("</body></html>", "</body></html>", ""))
        head = "<!DOCTYPE html><html><head><title>" + self.sentence(2, 6) + "</title><style>p{}</style><script>var a='</p>';</script></head><body>"
        return head + "\n".join(out) + tail, main
