"""Labelled pages to train page extraction on: layouts filled with words, and a label per leaf block.

Each part is markup with ``{s}`` for a sentence, ``{w}`` for a few words and ``{p}`` for a paragraph, and
the labels of its leaf blocks in order: 1 for the article, 0 for everything around it.
"""

from __future__ import annotations

import re

import numpy as np

PAGES = 90
SYLLABLES = ("la", "mer", "to", "vin", "ka", "sol", "den", "ri", "pa", "ul", "est", "no")

AROUND_TOP = (
    ("<nav><ul><li><a href='/'>{w}</a></li><li><a href='/a'>{w}</a></li><li><a href='/b'>{w}</a></li></ul></nav>", (0, 0, 0)),
    ("<div class='menu'><a href='/'>{w}</a> <a href='/x'>{w}</a> <a href='/y'>{w}</a></div>", (0,)),
    ("<header><h1>{w}</h1><p>{s}</p></header>", (0, 0)),
    ("<div id='masthead'><p>{w}</p></div>", (0,)),
    ("<div class='breadcrumbs'><a href='/'>{w}</a> &gt; <a href='/a'>{w}</a></div>", (0,)),
    ("<div class='ad'>{s} {s}</div>", (0,)),
    ("<div class='banner advert'><p>{p}</p></div>", (0,)),
    ("<div class='cookie-notice'><p>{s}</p><button>{w}</button></div>", (0,)),
    ("<div role='alert' class='notice'>{s}</div>", (0,)),
    ("<form action='/search'><label>{w}</label><input name='q'></form>", (0,)),
)
AROUND_END = (
    ("<footer>&copy; {w} &middot; {s} {s}</footer>", (0,)),
    ("<footer><p>{p}</p><ul><li><a href='/l'>{w}</a></li><li><a href='/m'>{w}</a></li></ul></footer>", (0, 0, 0)),
    ("<div id='footer'><p>(c) {w}</p><p>{s}</p></div>", (0, 0)),
    ("<aside><h3>{w}</h3><ul><li><a href='/1'>{w}</a></li><li><a href='/2'>{w}</a></li></ul><p>{p}</p></aside>", (0, 0, 0, 0)),
    ("<div class='sidebar widget'><h4>{w}</h4><p>{s}</p></div>", (0, 0)),
    ("<section id='comments'><h2>{w}</h2><div class='comment'><p>{p}</p></div><div class='comment'><p>{s}</p></div></section>", (0, 0, 0)),
    ("<div class='comments'><ul><li>{p}</li><li>{s} {s}</li></ul></div>", (0, 0)),
    ("<form class='newsletter'><p>{s}</p><label>{w}</label><input></form>", (0, 0)),
    ("<div class='related'><h3>{w}</h3><p><a href='/r'>{s}</a></p></div>", (0, 0)),
    ("<div class='share social'><a href='#'>{w}</a><a href='#'>{w}</a></div>", (0,)),
    ("<div class='pagination'><a href='2'>{w}</a></div>", (0,)),
    ("<div class='legal disclaimer'><p>{p}</p></div>", (0,)),
)
BODIES = (
    ("<h1>{w}</h1>", (1,)),
    ("<h2>{s}</h2>", (1,)),
    ("<p>{p}</p>", (1,)),
    ("<p>{p}</p>", (1,)),
    ("<p>{s}</p>", (1,)),
    ("<p><b>{p}<br><p>{s}</p>", (1, 1)),
    ("<p>{w}</p>", (1,)),
    ("<ul><li>{s}</li><li>{w}</li></ul>", (1, 1)),
    ("<blockquote><p>{s}</p></blockquote>", (1,)),
    ("<p>{s} <a href='/in'>{w}</a> {p}</p>", (1,)),
    ("<table><tr><td>{w}</td><td>{w}</td></tr></table>", (1, 1)),
    ("<pre>{s}</pre>", (1,)),
)
INSIDE = (
    ("<div class='ad'>{s}</div>", (0,)),
    ("<aside class='promo'><p>{p}</p></aside>", (0,)),
    ("<div class='share'><a href='#'>{w}</a></div>", (0,)),
    ("<form><label>{w}</label><input></form>", (0,)),
    ("<div class='related'><p>{s}</p></div>", (0,)),
)
HOLDERS = ("<article>{}</article>", "<article>{}</article>", "<main>{}</main>", "<main><article>{}</article></main>", "<div id='content'>{}</div>", "<div class='post entry'>{}</div>", "<div>{}</div>", "{}")


def labelled_pages(n: int = PAGES, seed: int = 11) -> list[tuple[str, list[int]]]:
    """Pages and the labels of their leaf blocks; the same ones for the same arguments."""
    rng = np.random.default_rng(seed)

    def word() -> str:
        return "".join(rng.choice(SYLLABLES, rng.integers(1, 4)))

    def words(low: int, high: int) -> str:
        return " ".join(word() for _ in range(rng.integers(low, high)))

    def filled(markup: str) -> str:
        makers = {
            "{w}": lambda: words(1, 4),
            "{s}": lambda: words(4, 14).capitalize() + rng.choice((".", ".", ".", "!", "?")),
            "{p}": lambda: " ".join(words(5, 16).capitalize() + "." for _ in range(rng.integers(2, 7))),
        }
        return re.sub(r"\{[wsp]\}", lambda m: makers[m.group()](), markup)

    pages = []
    for _ in range(n):
        labels: list[int] = []

        def take(parts, count: int, into: list[int]) -> str:
            out = []
            for i in rng.integers(0, len(parts), count):
                out.append(filled(parts[i][0]))
                into.extend(parts[i][1])
            return "".join(out)

        top = take(AROUND_TOP, rng.integers(0, 5), labels)
        inner = take(BODIES[:2], 1, labels) + take(BODIES, rng.integers(1, 7), labels)
        if rng.random() < 0.5:
            inner += take(INSIDE, 1, labels) + take(BODIES[2:], rng.integers(1, 4), labels)
        if rng.random() < 0.2:
            inner += take((AROUND_END[5], AROUND_END[6]), 1, labels)
        end = take(AROUND_END, rng.integers(0, 5), labels)
        holder = HOLDERS[rng.integers(len(HOLDERS))]
        pages.append((f"<html><head><title>{words(2, 6)}</title></head><body>{top}{holder.format(inner)}{end}</body></html>", labels))
    return pages
