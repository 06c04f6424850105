"""Operator 3, HTML extraction: boosted trees over DOM nodes, hierarchical decoding.

Each block node and each text run gets features of its subtree (text, links,
density), its attribute words, its depth, its siblings and its ancestors.
Gradient-boosted trees, trained here on pages composed at random from common
layouts with known articles, give each node's log-odds of holding main text. The
decoder picks the set of nodes with the largest sum in which a kept node's
parent is kept, so an ancestor is never dropped with a descendant kept. The
kept text runs, in page order, are the text.

Null html and pages without an article give the empty string. Rows are
independent; repeated rows agree; other columns are ignored. An empty table
gives an empty table.
"""

from __future__ import annotations

import random
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .boosting import Trees, fit
from .common import in_batches
from .html_dom import Node, Nodes, feature_rows, parse

TRAIN_PAGES, SEED = 400, 11


def decode(page: Nodes, score: list[float]) -> list[Node]:
    """The kept nodes in page order: the best set that holds the parent of each member."""
    best, parent = list(score), page.parent
    for i in range(len(best) - 1, 0, -1):
        if best[i] > 0:
            best[parent[i]] += best[i]
    kept = [False] * len(best)
    for i, b in enumerate(best):
        kept[i] = b > 0 and (i == 0 or kept[parent[i]])
    return [n for n, k in zip(page.nodes, kept, strict=True) if k]


class Composer:
    """Random pages in common layouts, with the article's blocks."""

    def __init__(self, seed: int):
        self.r = random.Random(seed)
        letters = "abcdefghijklmnoprstuvwéäöüñ"
        self.words = ["".join(self.r.choices(letters, k=self.r.randint(1, 9))) for _ in range(900)]

    def sentence(self, least: int = 3, most: int = 18) -> str:
        w = self.r.choices(self.words, k=self.r.randint(least, most))
        if self.r.random() < 0.4:
            w[self.r.randrange(len(w))] += ","
        return " ".join(w).capitalize() + self.r.choice([".", ".", ".", "?", "!", ""])

    def prose(self, most: int = 8) -> str:
        return " ".join(self.sentence() for _ in range(self.r.randint(1, most)))

    def links(self, n: int, sep: str = "") -> str:
        return sep.join(f'<a href="/{self.r.choice(self.words)}">{" ".join(self.r.choices(self.words, k=self.r.randint(1, 3)))}</a>' for _ in range(n))

    def attr(self, *names: str) -> str:
        x = self.r.random()
        name = self.r.choice(names) + self.r.choice(["", "", "-1", "-wrap", "-inner", " row"])
        return f' class="{name}"' if x < 0.6 else f' id="{name}"' if x < 0.8 else ""

    def menu(self) -> str:
        n = self.r.randint(2, 9)
        items = "".join(f"<li>{self.links(1)}</li>" for _ in range(n))
        return self.r.choice([f"<nav><ul>{items}</ul></nav>", f"<div{self.attr('nav', 'menu', 'navbar')}><ul>{items}</ul></div>", f"<ul class='menu'>{items}</ul>", f"<nav>{self.links(n, ' | ')}</nav>"])

    def head(self) -> str:
        return self.r.choice([f"<header><a href='/'>{self.sentence(1, 3)}</a><p>{self.sentence(2, 6)}</p></header>", f"<div{self.attr('header', 'masthead', 'banner')}><div>{self.sentence(1, 4)}</div></div>", ""])

    def advert(self) -> str:
        return f"<{(t := self.r.choice(['div', 'aside', 'section']))}{self.r.choice([' class=ad', chr(32) + 'class=advert', ' id=ad-top', ' class=sponsored', ' class=promo-box', ' class=banner-ad'])}>{self.r.choice([self.prose(4), '<p>' + self.prose(3) + '</p>', self.links(2)])}</{t}>"

    def side(self) -> str:
        inner = f"<h3>{self.sentence(1, 4)}</h3>" + self.r.choice([f"<ul>{''.join(f'<li>{self.links(1)}</li>' for _ in range(self.r.randint(2, 6)))}</ul>", f"<p>{self.prose(4)}</p>", f"<p>{self.prose(3)}</p><p>{self.prose(2)}</p>"])
        return self.r.choice([f"<aside{self.attr('sidebar', 'widget')}>{inner}</aside>", f"<div class='{self.r.choice(['sidebar', 'widget', 'related', 'side-col', 'recommended'])}'>{inner}</div>"])

    def foot(self) -> str:
        inner = "&copy; " + self.r.choice([f"{self.r.choice(self.words)}.example &middot; {self.prose(3)}", f"<p>{self.sentence()}</p>{self.links(3, ' ')}", f"<p>{self.prose(3)}</p><p>{self.sentence()}</p>"])
        return self.r.choice([f"<footer>{inner}</footer>", f"<footer>{inner}</footer>", f"<div{self.r.choice([' class=footer', ' id=footer', ' class=site-footer'])}>{inner}</div>"])

    def notice(self) -> str:
        return f"<div class='{self.r.choice(['cookie-notice', 'consent', 'alert', 'newsletter', 'gdpr-banner', 'subscribe', 'popup'])}'><p>{self.prose(3)}</p>{self.r.choice(['', '<button>' + self.sentence(1, 2) + '</button>'])}</div>"

    def form(self) -> str:
        return f"<form action='/{self.r.choice(self.words)}'><label>{self.sentence(1, 4)}</label><input type=text><button>{self.sentence(1, 2)}</button>{self.r.choice(['', '<p>' + self.prose(2) + '</p>'])}</form>"

    def comments(self) -> str:
        one = lambda: self.r.choice([f"<div class='comment'><p>{self.prose(4)}</p></div>", f"<li class=comment><b>{self.sentence(1, 2)}</b><p>{self.prose(3)}</p></li>", f"<article class='comment'><p>{self.prose(4)}</p></article>"])
        return f"<{(t := self.r.choice(['section', 'div']))} {self.r.choice(['id=comments', 'class=comments', 'class=replies', 'id=disqus', 'class=discussion'])}><h3>{self.sentence(1, 3)}</h3>{''.join(one() for _ in range(self.r.randint(1, 5)))}</{t}>"

    def inline(self, text: str) -> str:
        words = text.split(" ")
        if len(words) > 3 and self.r.random() < 0.3:
            i = self.r.randrange(len(words) - 1)
            words[i] = self.r.choice(["<b>{}</b>", "<i>{}</i>", "<a href='/x'>{}</a>", "<em>{}</em>", "<code>{}</code>"]).format(words[i])
        return " ".join(words)

    def article(self) -> tuple[str, list[str]]:
        """Markup whose text runs carry the mark of main text, and nothing else does."""
        blocks, out = [], []
        if self.r.random() < 0.85:
            blocks.append(self.sentence(2, 10))
            out.append(f"<h1>{blocks[-1]}</h1>")
        for _ in range(self.r.choice([1, 1, 2, 3, 5, 8, 14])):
            x, text = self.r.random(), self.prose(self.r.choice([1, 1, 3, 8, 20]))
            if x < 0.72:
                out.append(self.r.choice(["<p>{}</p>"] * 5 + ["<p>{}", "<div>{}</div>", "<p><b>{}<br>"]).format(self.inline(text)))
            elif x < 0.8:
                text = self.sentence(1, 7)
                out.append(self.r.choice(["<h2>{}</h2>", "<h3>{}</h3>"]).format(text))
            elif x < 0.86:
                out.append(f"<blockquote>{self.r.choice(['{}', '<p>{}</p>']).format(text)}</blockquote>")
            elif x < 0.94:
                items = [self.sentence(2, 12) for _ in range(self.r.randint(2, 5))]
                out.append(f"<ul>{''.join(f'<li>{self.inline(i)}</li>' for i in items)}</ul>")
                text = None
                blocks += items
            else:
                out.append(f"<pre>{text}</pre>")
            if text is not None:
                blocks.append(text)
            if self.r.random() < 0.06:
                out.append(self.advert())
        start, end = self.r.choice([("<article>", "</article>")] * 4 + [("<main>", "</main>"), ("<main><article>", "</article></main>"), (f"<div class='{self.r.choice(['content', 'post-body', 'entry-content', 'article-text', 'story'])}'>", "</div>"), ("<div id=main><div>", "</div></div>"), ("<div>", "</div>"), ("<table><tr><td>", "</td></tr></table>"), ("<section>", "</section>")])
        return start + "".join(out) + end, blocks

    def page(self) -> tuple[str, list[str]]:
        body, blocks = self.article()
        over = [f() for f in self.r.sample([self.menu, self.head, self.advert, self.notice, self.form, self.side], self.r.randint(0, 4))]
        under = [f() for f in self.r.sample([self.side, self.advert, self.comments, self.form, self.notice, self.foot], self.r.randint(0, 3))]
        if self.r.random() < 0.6:
            over.insert(0, self.menu())
            under.append(self.foot())
        if self.r.random() < 0.3:
            body = f"<div{self.attr('wrapper', 'container', 'layout')}>{body}{self.side() if self.r.random() < 0.5 else ''}</div>"
        return f"<!DOCTYPE html><html><head><title>{self.sentence()}</title></head><body>{''.join(over)}{body}{''.join(under)}</body></html>", blocks


@cache
def trained() -> Trees:
    """The trees, from composed pages; a node counts as main if most of its text is."""
    make = Composer(SEED)
    xs, ys = [], []
    for _ in range(TRAIN_PAGES):
        page, blocks = make.page()
        left: dict[str, int] = {}
        for b in blocks:
            left[" ".join(b.split())] = left.get(" ".join(b.split()), 0) + 1
        tree = Nodes(parse(page))
        nodes = tree.nodes
        main = {id(n) for n in nodes if not n.tag and left.get(n.text, 0) > 0}
        hold = {i: False for i in map(id, nodes)}
        for n in reversed(nodes):
            hold[id(n)] = hold[id(n)] or id(n) in main
            if n.parent is not None and hold[id(n)]:
                hold[id(n.parent)] = True
        xs.append(tree)
        ys.append(np.array([hold[id(n)] for n in nodes], dtype=float))
    return fit(feature_rows(xs), np.concatenate(ys))


def extract(pages: list[str | None], trees: Trees) -> list[str]:
    """The main text of each page."""
    trees_of = [Nodes(parse(p)) if p else None for p in pages]
    x = feature_rows([t for t in trees_of if t is not None])
    scores = trees.scores(x).tolist() if len(x) else []
    out, at = [], 0
    for tree in trees_of:
        size = len(tree.nodes) if tree is not None else 0
        kept = decode(tree, scores[at : at + size]) if size else []
        at += size
        out.append("\n".join(n.text for n in kept if not n.tag))
    return out


def _extracted(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo in range(0, whole.num_rows, 200):
                batch = whole.slice(lo, 200)
                text = extract(batch.column("html").to_pylist(), shared.value)
                yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(text, pa.string()), pa.array([len(t) for t in text], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return run


def main_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars of each page."""
    shared = pages.sparkSession.sparkContext.broadcast(trained())
    return in_batches(pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html"), _extracted(shared), "page_id bigint, url string, text string, n_chars bigint", keeps=True)
