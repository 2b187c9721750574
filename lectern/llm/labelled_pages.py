"""Pages with a label on every element that begins or ends main text, to train the extraction on.

`data-main="1"` marks an element whose text belongs to the article, `data-main="0"` one within it
whose text doesn't; what lies outside any mark doesn't. The marks are read as labels and are no
features. Words are invented and drawn anew for each page, so that a model can't learn them.
"""

from __future__ import annotations

import random

_SYLLABLES = "ka lo mi ren sta tur vel on ish da pre quo zan el ber mu tal ki sor nad".split()


def _words(rng: random.Random, low: int, high: int) -> str:
    return " ".join("".join(rng.choice(_SYLLABLES) for _ in range(rng.randint(1, 4))) for _ in range(rng.randint(low, high)))


def _sentence(rng: random.Random, low: int = 5, high: int = 18) -> str:
    return _words(rng, low, high).capitalize() + rng.choice(".....?!")


def _prose(rng: random.Random, low: int = 1, high: int = 6) -> str:
    return " ".join(_sentence(rng) for _ in range(rng.randint(low, high)))


def _links(rng: random.Random, low: int = 3, high: int = 9) -> str:
    return "".join(f'<li><a href="/{_words(rng, 1, 1)}">{_words(rng, 1, 2)}</a></li>' for _ in range(rng.randint(low, high)))


def _body(rng: random.Random) -> list[str]:
    """Blocks of an article, some of them not its text."""
    p = lambda: f"<p>{_prose(rng)}</p>"
    inline = lambda: f'<p><b>{_sentence(rng)}</b> {_prose(rng, 0, 2)} <a href="/x">{_words(rng, 1, 3)}</a> <em>{_words(rng, 1, 2)}</em>.</p>'
    kinds = [p, p, p, p, inline, lambda: f"<p><b>{_prose(rng)}<br><p>{_prose(rng)}</p>", lambda: f"<p>{_sentence(rng, 1, 3)}</p>", lambda: f"<h2>{_words(rng, 2, 5)}</h2>", lambda: f"<h3>{_words(rng, 1, 6)}</h3>", lambda: f"<blockquote><p>{_prose(rng, 1, 2)}</p></blockquote>", lambda: "<ul>" + "".join(f"<li>{_sentence(rng, 2, 9)}</li>" for _ in range(rng.randint(2, 6))) + "</ul>", lambda: "<ol>" + "".join(f"<li>{_words(rng, 2, 9)}</li>" for _ in range(rng.randint(2, 5))) + "</ol>", lambda: f"<pre>{_words(rng, 4, 20)}</pre>", lambda: "<table>" + "".join(f"<tr><td>{_words(rng, 1, 2)}</td><td>{rng.randint(1, 999)}</td></tr>" for _ in range(3)) + "</table>", lambda: f"<figure><img src=x><figcaption>{_words(rng, 3, 9)}</figcaption></figure>", lambda: f'<p>{" | ".join(_words(rng, 1, 1) for _ in range(rng.randint(4, 30)))}</p>', lambda: f'<p class="{rng.choice(["lead", "intro", "text", "paragraph"])}">{_prose(rng)}</p>']
    out = [f"<h1>{_words(rng, 2, 9)}</h1>"] + [rng.choice(kinds)() for _ in range(rng.randint(2, 14))]
    for noise in rng.sample(_INSIDE, rng.choice([0, 0, 0, 1, 2])):
        out.insert(rng.randint(1, len(out)), noise(rng))
    return out


#: What pages put into an article that is not its text.
_INSIDE = [
    lambda r: f'<aside data-main="0" class="{r.choice(["related", "pullout", "sidebar", "more"])}"><h4>{_words(r, 1, 3)}</h4><ul>{_links(r)}</ul></aside>',
    lambda r: f'<div data-main="0" class="{r.choice(["ad", "ads", "advert", "advertisement", "ad-slot", "sponsored", "promo", "banner"])}">{_sentence(r)}</div>',
    lambda r: f'<div data-main="0" class="{r.choice(["share", "social", "share-buttons", "tools"])}"><a href="#">{_words(r, 1, 1)}</a> <a href="#">{_words(r, 1, 1)}</a></div>',
    lambda r: f'<form data-main="0" class="{r.choice(["newsletter", "subscribe", "signup"])}"><label>{_words(r, 1, 3)}</label><input><button>{_words(r, 1, 1)}</button></form>',
    lambda r: f'<section data-main="0" id="comments" class="comments"><h3>{_words(r, 1, 2)}</h3>{"".join(_comment(r) for _ in range(r.randint(1, 4)))}</section>',
]


def _comment(r: random.Random) -> str:
    return r.choice([f'<div class="comment"><b>{_words(r, 1, 1)}</b><p>{_prose(r, 1, 3)}</p></div>', f'<li class="comment"><span class="author">{_words(r, 1, 2)}</span><p>{_prose(r, 1, 2)}</p></li>', f'<article class="comment reply"><p>{_prose(r, 1, 3)}</p><footer>{_words(r, 1, 2)}</footer></article>', f'<p class="comment">{_prose(r, 1, 3)}</p>'])


#: What pages put around an article.
_BEFORE = [
    lambda r: f"<nav><ul>{_links(r)}</ul></nav>",
    lambda r: f'<nav class="{r.choice(["menu", "navbar", "breadcrumb", "main-nav"])}"><a href="/">{_words(r, 1, 2)}</a> <a href="/">{_words(r, 1, 2)}</a></nav>',
    lambda r: f"<header><h1>{_words(r, 1, 3)}</h1><p>{_words(r, 2, 6)}</p></header>",
    lambda r: f'<header class="site-header"><a href="/">{_words(r, 1, 2)}</a><nav><ul>{_links(r)}</ul></nav></header>',
    lambda r: f'<div id="{r.choice(["header", "top", "masthead"])}"><a href="/">{_words(r, 1, 3)}</a> {_words(r, 1, 5)}</div>',
    lambda r: f'<div class="{r.choice(["menu", "nav", "navigation", "topbar"])}"><ul>{_links(r)}</ul></div>',
    lambda r: f'<ul class="{r.choice(["menu", "nav", "breadcrumbs"])}">{_links(r)}</ul>',
    lambda r: f'<div class="{r.choice(["ad", "ads", "advert", "advertisement", "banner", "ad-banner", "sponsor"])}">{_prose(r, 1, 2)}</div>',
    lambda r: f'<div class="{r.choice(["cookie", "cookies", "cookie-notice", "notice", "consent", "gdpr", "alert", "banner-notice"])}"><p>{_prose(r, 1, 2)}</p><button>{_words(r, 1, 2)}</button></div>',
    lambda r: f'<div role="{r.choice(["banner", "alert", "dialog", "navigation", "search"])}"><p>{_prose(r, 1, 1)}</p></div>',
    lambda r: f'<form class="search"><label>{_words(r, 1, 2)}</label><input><button>{_words(r, 1, 1)}</button></form>',
    lambda r: f"<noscript>{_sentence(r)}</noscript>",
    lambda r: f'<div class="notice">{_sentence(r)}</div>',
]
_AFTER = [
    lambda r: f"<footer>&copy; {_words(r, 1, 2)} &middot; {_prose(r, 1, 2)}</footer>",
    lambda r: f'<footer><p>{_prose(r, 1, 2)}</p><ul>{_links(r)}</ul></footer>',
    lambda r: f'<div id="{r.choice(["footer", "bottom", "copyright"])}"><p>&copy; {_words(r, 2, 8)}</p></div>',
    lambda r: f'<div class="{r.choice(["footer", "site-footer", "legal"])}">{_sentence(r)}</div>',
    lambda r: f'<aside><h3>{_words(r, 1, 3)}</h3><p>{_prose(r, 1, 3)}</p><ul>{_links(r)}</ul></aside>',
    lambda r: f'<aside class="{r.choice(["sidebar", "related", "widget"])}"><p>{_prose(r, 1, 3)}</p></aside>',
    lambda r: f'<div class="{r.choice(["sidebar", "side", "widget", "related", "recommended", "popular", "trending"])}"><h3>{_words(r, 1, 3)}</h3><p>{_prose(r, 1, 2)}</p></div>',
    lambda r: f'<div id="sidebar"><h2>{_words(r, 1, 3)}</h2><ul>{_links(r)}</ul><p>{_prose(r, 1, 2)}</p></div>',
    lambda r: f'<section class="{r.choice(["comments", "comment-list", "discussion", "responses"])}"><h2>{_words(r, 1, 3)}</h2>{"".join(_comment(r) for _ in range(r.randint(1, 5)))}</section>',
    lambda r: f'<div id="comments">{"".join(_comment(r) for _ in range(r.randint(1, 5)))}</div>',
    lambda r: f'<ol class="comment-list">{"".join(_comment(r) for _ in range(r.randint(1, 5)))}</ol>',
    lambda r: f'<form action="/post"><p>{_words(r, 2, 6)}</p><textarea>{_words(r, 0, 3)}</textarea><select><option>{_words(r, 1, 1)}</option></select><button>{_words(r, 1, 2)}</button></form>',
    lambda r: f'<div class="{r.choice(["newsletter", "subscribe", "promo", "share", "social"])}"><p>{_sentence(r)}</p></div>',
    lambda r: f'<p class="{r.choice(["copyright", "disclaimer", "legal"])}">{_sentence(r)}</p>',
]
#: What holds the article.
_HOLDERS = [
    lambda r, x: f'<article data-main="1">{x}</article>',
    lambda r, x: f'<article data-main="1" class="{r.choice(["post", "entry", "story"])}">{x}</article>',
    lambda r, x: f'<main><article data-main="1">{x}</article></main>',
    lambda r, x: f'<main data-main="1">{x}</main>',
    lambda r, x: f'<div class="{r.choice(["content", "post", "entry-content", "article", "article-body", "post-body", "story", "main", "text"])}" data-main="1">{x}</div>',
    lambda r, x: f'<div id="{r.choice(["content", "main", "article", "body"])}" data-main="1">{x}</div>',
    lambda r, x: f'<div class="wrapper"><div class="row"><section data-main="1" class="{r.choice(["content", "body", "main"])}">{x}</section></div></div>',
    lambda r, x: f'<div class="container"><article data-main="1"><div class="{r.choice(["inner", "body", "text"])}">{x}</div></article></div>',
]


def _made(r: random.Random) -> str:
    """A class name as style sheets in scripts make them, which says nothing."""
    return r.choice(["css", "sc", "jsx", "x", "_"]) + "-" + "".join(r.choice("abcdefghijklmnopqrstuvwxyz0123456789") for _ in range(r.randint(4, 8)))


#: What pages with such names have around an article, and what holds it.
_MADE_AROUND = [
    lambda r: f'<nav class="{_made(r)}"><a href="/">{_words(r, 1, 2)}</a> <a href="/">{_words(r, 1, 2)}</a></nav>',
    lambda r: f'<div class="{_made(r)}"><ul class="{_made(r)}">{_links(r)}</ul></div>',
    lambda r: f'<header class="{_made(r)}"><a href="/">{_words(r, 1, 3)}</a></header>',
    lambda r: f'<footer class="{_made(r)}">&copy; {_words(r, 2, 8)}</footer>',
    lambda r: f'<aside class="{_made(r)}"><h3>{_words(r, 1, 3)}</h3><ul>{_links(r)}</ul></aside>',
]
_MADE_HOLDERS = [
    lambda r, x: f'<div class="{_made(r)}" data-main="1">{x}</div>',
    lambda r, x: f'<div class="{_made(r)}"><div class="{_made(r)}" data-main="1">{x}</div></div>',
    lambda r, x: f'<div data-main="1">{x}</div>',
    lambda r, x: f'<form method="post" data-main="1">{x}</form>',
    lambda r, x: f'<form id="{r.choice(["form1", "aspnetForm", "mainform"])}" method="post">{r.choice(_HOLDERS)(r, x)}</form>',
]


def _plain(r: random.Random) -> str:
    """Text with no element that makes a block."""
    return _prose(r, 1, 12) + r.choice(["", f" <b>{_words(r, 1, 3)}</b> " + _prose(r), "<br>" + _prose(r)])


def pages(count: int = 600, seed: int = 7) -> list[str]:
    """Labelled pages of varied layout."""
    rng, out = random.Random(seed), []
    for _ in range(count):
        before = "".join(x(rng) for x in rng.sample(_BEFORE, rng.randint(0, 4)))
        after = "".join(x(rng) for x in rng.sample(_AFTER, rng.randint(0, 5)))
        main = rng.choice(_HOLDERS)(rng, "".join(_body(rng)))
        if rng.random() < 0.15:
            before += f'<div class="{rng.choice(["wrap", "page", "layout", "container"])}">'
            after += "</div>"
        head = f"<head><title>{_words(rng, 2, 6)}</title><style>p{{margin:0}}</style><script>var a = '<p>{_words(rng, 1, 3)}</p>';</script></head>"
        out.append(f"<!DOCTYPE html><html lang=xx>{head}<body>{before}{main}{after}</body></html>")
    # One in five has names that tell nothing, lies in a form, is all text or has stray text around it.
    for k in range(0, count, 5):
        kind, body = k // 5 % 6, "".join(_body(rng))
        if kind == 0:
            out[k] = _plain(rng)
        elif kind == 1:
            out[k] = _words(rng, 1, 1) + out[k]
        elif kind == 2:
            out[k] = f'<html><body data-main="1">{body}</body></html>'
        else:
            around = ["".join(x(rng) for x in rng.sample(_MADE_AROUND, rng.randint(0, 2))) for _ in range(2)]
            out[k] = f"<html><body>{around[0]}{rng.choice(_MADE_HOLDERS)(rng, body)}{around[1]}</body></html>"
    return out
