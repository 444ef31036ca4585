"""Labelled practice pages: texts of real blocks set into drawn layouts, with what surrounds an article.

Every layout is HTML, read by the same reader as real pages.  A block's first character says whether it belongs to
the article; the caller takes it off.  Surrounding blocks use the same texts half of the time, so a text alone does not
give its block away.
"""

from __future__ import annotations

import html as _html
import random

KEEP, DROP = "\ue000", "\ue001"

#: How pages name the parts of a layout.
ARTICLE = ("article", "main", "main class='content'", "div class='content'", "div id='content'", "div class='post'", "div class='entry-content'",
           "div class='article-body'", "section class='story'", "div role='main'", "div class='text'", "div id='main'", "div class='post-content'",
           "article class='post'", "div itemprop='articleBody'", "div id='article'", "td class='content'", "div class='article'",
           "div class='body'", "section class='article'", "div class='blog-post'", "div id='main-content'", "div class='page-content'", "div")
MENU = ("nav", "nav class='menu'", "div class='menu'", "div id='nav'", "div class='navbar'", "div class='breadcrumbs'", "ul class='nav'", "div id='menu'",
        "div class='navigation'", "nav class='main-nav'", "div class='toc'", "div class='pagination'", "div class='tags'", "div class='links'", "div class='topbar'", "ul id='menu'",
        "ul class='menu'", "div class='nav-bar'", "ol class='breadcrumb'", "header class='nav'", "div class='skip-links'")
HEADER = ("header", "div id='header'", "div class='header'", "div class='masthead'", "div class='site-header'", "header class='top'", "div class='logo'",
          "header role='banner'", "div class='branding'")
FOOTER = ("footer", "div id='footer'", "div class='footer'", "div class='copyright'", "footer class='site-footer'", "div class='bottom'", "div class='legal'",
          "div role='contentinfo'", "div class='colophon'")
SIDE = ("aside", "aside class='sidebar'", "div class='sidebar'", "div id='sidebar'", "div class='widget'", "div class='related'", "aside class='related'",
        "section class='related-posts'", "div class='more'", "div class='recommended'", "div class='side'", "div class='popular'", "div class='aside'",
        "section class='recommendations'", "div role='complementary'", "div class='author-box'", "div class='rail'")
ADVERT = ("div class='ad'", "div class='ads'", "div class='advert'", "div class='advertisement'", "div id='ad-top'", "div class='sponsored'",
          "div class='promo'", "aside class='ad'", "div class='ad-slot'", "section class='promotion'", "div class='banner'", "div class='sponsor'",
          "p class='ad'", "ins class='adsbygoogle'", "div class='google-ad'", "div class='commercial'")
NOTICE = ("div class='cookie'", "div class='cookie-notice'", "div class='notice'", "div class='alert'", "div id='consent'", "div class='gdpr'",
          "div class='popup'", "div class='modal'", "div class='cookie-banner'", "div role='alert'", "div class='paywall'", "section class='notice'",
          "div class='message'", "div class='warning'", "aside class='notice'", "div class='disclaimer'", "p class='notice'", "div role='dialog'",
          "div class='announcement'", "div class='overlay'", "div class='privacy'")
FORM = ("form", "form class='search'", "form class='newsletter'", "div class='newsletter'", "form id='login'", "div class='search'", "form class='subscribe'",
        "div class='signup'", "form action='/go'", "div class='subscribe'", "div class='contact-form'", "fieldset", "form class='comment-form'")
COMMENTS = ("section class='comments'", "div id='comments'", "div class='comments'", "ol class='commentlist'", "div class='replies'", "div class='discussion'",
            "section id='comments'", "div class='comment-list'", "div class='reader-comments'", "div class='responses'", "div id='disqus_thread'",
            "div class='feedback'", "section class='reviews'", "div class='user-comments'")
COMMENT = ("div class='comment'", "article class='comment'", "li class='comment'", "div class='reply'", "p", "div", "li", "blockquote", "div class='comment-body'")
SHARE = ("div class='share'", "div class='social'", "ul class='social-links'", "div class='sharing'", "div class='meta-links'", "div class='share-buttons'")
WRAP = ("div class='wrapper'", "div id='page'", "div class='container'", "div class='row'", "div class='site'", "div class='col-md-8'", "div")
INNER = ("div", "section", "div class='inner'", "div class='block'", "div class='section'", "div class='x12'")
NOISE = ("clearfix", "col", "b1", "js", "wide", "box", "hz", "item", "left", "panel", "module", "view", "mt4", "grid", "u", "active")
SAYINGS = (
    "Home", "About", "Contact", "News", "Sport", "Archive", "Login", "Sign up", "Search", "Menu", "Next", "Previous", "Read more", "Share this",
    "Accueil", "Startseite", "Inicio", "Kontakt", "Contacto", "Impressum", "Aviso legal", "Mentions légales", "Datenschutz", "Suche", "Rechercher",
    "Subscribe to our newsletter", "Enter your email address", "We use cookies to improve your experience. Accept all cookies.",
    "Nous utilisons des cookies.", "Wir verwenden Cookies.", "Usamos cookies.", "Advertisement", "Sponsored", "Anzeige", "Publicité", "Publicidad",
    "All rights reserved.", "© 2024 Example Inc.", "Copyright 2023", "Terms of service", "Privacy policy", "Related articles", "You may also like",
    "Most popular", "Follow us", "Leave a comment", "Reply", "Log in to comment", "Posted by", "3 comments", "Great article, thanks!",
    "I do not agree with this at all.", "Buy now and save 50%", "Click here", "Free shipping today only", "Download our app", "Back to top",
    "Password", "User name", "Submit", "Send", "Breaking: site maintenance tonight", "Please enable JavaScript", "Your browser is out of date.",
    "This page is available to members only.", "Skip to content", "Tags:", "Categories", "Recent posts", "Powered by")


class Layout:
    """Draws pages around texts of a pool."""

    def __init__(self, pool: list[str], seed: int) -> None:
        self.rng = random.Random(seed)
        self.pool = pool or list(SAYINGS)

    def tag(self, kinds: tuple[str, ...], inside: str) -> str:
        kind = self.rng.choice(kinds)
        while kind.startswith("p") and "<" in inside:      # a paragraph holds no other block
            kind = self.rng.choice(kinds)
        name = kind.split()[0]
        if self.rng.random() < 0.3:
            noise = self.rng.choice(NOISE)
            kind = kind.replace("class='", f"class='{noise} ") if "class='" in kind else f"{kind} class='{noise}'"
        return f"<{kind}>{inside}" + (f"</{name}>" if name != "p" or self.rng.random() < 0.9 else "")

    def text(self, mark: str, sayings: float, most: int = 1 << 30) -> str:
        said = self.rng.choice(SAYINGS) if self.rng.random() < sayings else " ".join(self.rng.choice(self.pool).split()[:most])
        if mark == DROP and self.rng.random() < 0.1:
            said = self.rng.choice(("© ", "3 ", "» ", "")) + said
        return mark + _html.escape(said, quote=False)

    def link(self, mark: str) -> str:
        return f"{mark}<a href='/x'>{self.text('', 0.5, self.rng.choice((1, 2, 5)))}</a>"

    def lines(self, mark: str, sayings: float, n: int, link: float) -> str:
        r = self.rng
        if r.random() < 0.4:
            return "<ul>" + "".join(f"<li>{self.link(mark) if r.random() < link else self.text(mark, sayings, r.choice((2, 6, 60)))}" +
                                    ("</li>" if r.random() < 0.8 else "") for _ in range(n)) + "</ul>"
        kind = r.choice(("p", "div", "span", "h3", "label", "p"))
        return "".join(f"<{kind}>{self.link(mark) if r.random() < link else self.text(mark, sayings, r.choice((3, 12, 200)))}</{kind}>"
                       if kind != "span" else f"<p>{self.text(mark, sayings, 40)}</p>" for _ in range(n))

    def junk(self, kinds: tuple[str, ...], sayings: float, link: float, most: int) -> str:
        r = self.rng
        inside = self.text(DROP, sayings) if r.random() < 0.35 else self.lines(DROP, sayings, r.randint(1, most), link)
        if r.random() < (0.6 if kinds is HEADER else 0.25):    # a site's name, the title of a box
            inside = self.heading("1234", 8, DROP) + (inside if r.random() < 0.7 else "")
        if kinds is FORM:
            inside += r.choice(("<input name='q'>", "<button>" + self.text(DROP, 1) + "</button>", "<label>" + self.text(DROP, 1) + "</label>"))
        return self.tag(kinds, inside)

    def comments(self) -> str:
        r = self.rng
        head = f"<h3>{self.text(DROP, 0.8, 6)}</h3>" if r.random() < 0.6 else ""
        each = "".join(self.tag(COMMENT, (f"<b>{DROP}{r.choice(('Anna', 'bob77', 'Reader', 'J. Smith'))}</b> " if r.random() < 0.3 else DROP) +
                                self.text("", 0.3) + (f"<p>{self.text(DROP, 0.2)}</p>" if r.random() < 0.3 else "")) for _ in range(r.randint(1, 5)))
        return self.tag(COMMENTS, head + each)

    def piece(self) -> str:
        """One of the things beside an article."""
        r = self.rng
        return r.choice((lambda: self.junk(SIDE, 0.3, 0.5, 5), lambda: self.junk(ADVERT, 0.4, 0.2, 2), lambda: self.junk(NOTICE, 0.5, 0.1, 2),
                         lambda: self.junk(FORM, 0.6, 0.0, 3), lambda: self.junk(SHARE, 0.6, 0.9, 4), self.comments,
                         lambda: self.junk(MENU, 0.4, 0.95, 7)))()

    def heading(self, levels: str, most: int, mark: str = KEEP) -> str:
        level = self.rng.choice(levels)
        return f"<h{level}>{self.text(mark, 0 if mark == KEEP else 0.3, most)}</h{level}>"

    def article(self) -> str:
        r = self.rng
        title = self.heading("1112", 12) if r.random() < 0.8 else ""
        if title and r.random() < 0.15:
            title = f"<header>{title}</header>"
        parts = [title]
        for _ in range(r.choice((1, 2, 3, 5, 8, 14, 25))):
            kind = r.random()
            if kind < 0.72:
                bold = r.random() < 0.1
                parts.append(f"<p>{'<b>' if bold else ''}{self.text(KEEP, 0)}" + ("</p>" if r.random() < 0.85 else "<br>"))
            elif kind < 0.78:
                parts.append(self.heading("234", 8))
            elif kind < 0.83:
                parts.append(self.lines(KEEP, 0, r.randint(1, 5), 0.1))
            elif kind < 0.86:
                parts.append(f"<blockquote><p>{self.text(KEEP, 0)}</p></blockquote>")
            elif kind < 0.88:
                parts.append(f"<table><tr><td>{self.text(KEEP, 0, 3)}<td>{self.text(KEEP, 0, 3)}</table>")
            elif kind < 0.90:
                parts.append(f"<pre>{self.text(KEEP, 0, 20)}</pre>")
            elif kind < 0.93:
                parts.append(f"<div>{self.text(KEEP, 0)}</div>")
            else:
                parts.append(self.piece())
        inside = "".join(parts)
        if r.random() < 0.25:
            inside = self.tag(INNER, inside)
        return self.tag(ARTICLE, inside)

    def page(self) -> str:
        r = self.rng
        before = [self.junk(kinds, 0.4, link, most) for kinds, p, link, most in (
            (HEADER, 0.6, 0.4, 3), (MENU, 0.7, 0.95, 9)) if r.random() < p]
        before += [self.piece() for _ in range(r.choice((0, 0, 1, 2)))]
        after = [self.comments()] if r.random() < 0.4 else []
        after += [self.piece() for _ in range(r.choice((0, 1, 1, 2, 3)))]
        if r.random() < 0.75:
            after.append(self.junk(FOOTER, 0.5, 0.3, 3))
        r.shuffle(before)
        body = "".join(before) + self.article() + "".join(after)
        for _ in range(r.choice((0, 0, 1, 2))):
            body = self.tag(WRAP, body)
        return f"<html><head><title>x</title></head><body>{body}" + ("</body></html>" if r.random() < 0.9 else "")
