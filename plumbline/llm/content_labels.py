"""Labelled pages from which content.py learns its weights.

The main text stands between OPEN and CLOSE.  The pages are written for this purpose, in
the layouts that sites commonly use.
"""

from __future__ import annotations

OPEN, CLOSE = "\ue000", "\ue001"

PLAIN = "The river rose for three days before the town could count what it had lost. Most of the lower streets were dry again by Sunday."
MORE = "Nobody had expected the old bridge to hold. It did, and the market opened a week later with half its usual stalls."
SHORT = "That was all."
LINKED = 'More of this is in <a href="/report">the full report</a> that the council printed, and in <a href="/map">the map</a> beside it.'
MENU = '<ul><li><a href="/">Home</a></li><li><a href="/news">News</a></li><li><a href="/sport">Sport</a></li><li><a href="/about">About us</a></li><li><a href="/contact">Contact</a></li></ul>'
SCRIPT = '<script>var a = "<p>no text</p>";</script><style>p { margin: 0 }</style>'


def _body(*parts: str) -> str:
    return f'<!DOCTYPE html><html lang="en"><head><meta charset="utf-8"><title>Flood</title>{SCRIPT}</head><body>{"".join(parts)}</body></html>'


def _main(text: str) -> str:
    return OPEN + text + CLOSE


def labelled_pages() -> list[str]:
    paragraphs = f"<h1>The flood</h1><p>{PLAIN}</p><p>{LINKED}</p><p>{MORE}</p>"
    rich = f"<h2>After the flood</h2><p><b>{PLAIN}</b><br>{MORE}</p><ul><li>{PLAIN}</li><li>{MORE}</li></ul><ol><li>{MORE}</li><li>{PLAIN}</li></ol><blockquote><p>{PLAIN}</p></blockquote><h3>What stayed when the water had gone down the valley at last</h3><p><em>{MORE}</em> {LINKED}</p>"
    table = f"<table><thead><tr><th>Street</th><th>What was found there afterwards</th></tr></thead><tbody><tr><td>{PLAIN}</td><td>{MORE}</td></tr></tbody></table>"
    figures = f"<figure><img src='a.png'><figcaption>{MORE}</figcaption></figure><pre>{PLAIN}</pre><dl><dt>Bridge</dt><dd>{MORE}</dd></dl>"
    nav = f"<nav>{MENU}</nav>"
    footer = "<footer><p>&copy; The Daily Page &middot; All rights reserved. Terms of use and privacy policy apply.</p></footer>"
    advert = '<div class="ad">Buy two lamps and get the third one free, only this week.</div>'
    sidebar = f'<aside class="sidebar"><h3>Related stories</h3>{MENU}<p>Sign up and read ten more stories like this one every morning.</p></aside>'
    comments = '<section class="comments" id="comments"><h3>2 comments</h3><div class="comment"><p>I was there and saw it all happen.</p></div><div class="comment"><p>So was I, and it was worse than that.</p></div></section>'
    form = '<form action="/search"><label>Search this site</label><input name="q"><select><option>All</option></select><button>Go</button><p>Enter your address to get our letter each week.</p></form>'
    notice = '<div class="cookie notice banner" role="alert"><p>We use cookies to make this site work better for you. Read how.</p></div>'
    return [
        _body(nav, "<!-- note -->", advert, "<article>", _main(paragraphs), "</article>", footer),
        _body(notice, f'<header class="header"><div class="logo">The Daily Page</div>{nav}</header>', "<main><article>", _main(f"<header><h1>The flood</h1></header><section>{rich}</section>"), "</article></main>", sidebar, footer),
        _body('<div id="header" class="top masthead"><p>The Daily Page, every day but Sunday</p></div>', f'<div class="menu navigation navbar">{MENU}</div>', '<div id="content" class="post entry article body text story">', _main(f"<div><p>{PLAIN}</p><p>{MORE}</p></div><div>{table}</div><div>{PLAIN}</div>"), "</div>", f'<div class="comments">{comments}</div>', '<div id="footer" class="footer bottom copyright legal">All rights reserved by the Daily Page, wherever it is read.</div>'),
        _body(f'<ul class="breadcrumb breadcrumbs crumbs"><li><a href="/">Home</a></li><li><a href="/news">News</a></li></ul>', form, '<section id="main" class="content">', _main(f"{rich}{figures}"), "</section>", f'<div class="related recommended more links tags">{MENU}</div>', '<div class="share social follow buttons"><a href="#">Share this</a> <a href="#">Send it on</a></div>', footer),
        _body(nav, '<div role="main"><div class="article-body">', _main(f"<h1>The bridge</h1><p>{MORE}</p>"), f'<div class="advert advertisement ads sponsor sponsored promo promotion">Lamps at half the price until Friday, while they last.</div>', _main(f"<p><span>{PLAIN}</span> <strong>{MORE}</strong></p><p>{SHORT}</p>"), f'</div></div><div class="widget newsletter subscribe signup popup modal">{form}<p>Get the letter that everybody in town reads.</p></div>', comments, footer),
        _body(f'<div class="toolbar" role="navigation">{MENU}</div>', f'<div class="alert warning message consent gdpr" role="banner">This page is kept for the record and is not brought up to date.</div>', "<article>", _main(paragraphs), advert, _main(f"<p>{PLAIN}</p><p>{MORE}</p>"), f'<aside><p>Read next: how the mill was saved from the water.</p></aside>', _main(f"<p>{MORE}</p><p>{SHORT}</p>"), f'<footer><p>Filed under weather by the news desk, last Sunday.</p></footer></article>', f'<div id="sidebar" class="side column rail" role="complementary"><p>Most read today: ten stories you should not miss.</p>{MENU}</div>', f'<div id="disqus" class="discussion replies reply respond reviews">{comments}<p>Say what you think about this story below.</p></div>', '<div role="contentinfo"><p>The Daily Page is printed on paper made from old copies.</p></div>'),
        _body('<div class="topbar userbar login account"><a href="/in">Login</a> <a href="/new">Register</a></div>', '<div class="article">', _main(paragraphs), '</div>', '<div class="responses feedback answers"><p>I saw this from my window and could not believe it.</p><p>You should have called us when it began.</p></div>', footer),
        _body(nav, _main(f"<div><div><h1>The mill</h1><p>{PLAIN}</p><p>{LINKED}</p></div></div>"), footer),
        _body(_main(f"<p>{PLAIN}</p><p>{MORE}</p><p>{PLAIN}</p>"), footer),
    ]
