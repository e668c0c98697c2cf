"""Main text of web pages: boosted trees over DOM nodes, decoded so that no kept node stands in a dropped one."""

from __future__ import annotations

import random
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larder.llm.boosting import Trees, boost
from larder.llm.components import bounded_sample
from larder.llm.dom import Page

#: Pages whose sentences fill the training layouts at most (the first by a hash of their addresses, up to `SAMPLE_CHARS`
#: characters each), and layouts made of them.
SAMPLE_PAGES, SAMPLE_CHARS, LAYOUTS = 200, 20_000, 1_000
SEED = 11
_MAIN = "\ue000"


def main_blocks(page: Page, odds: np.ndarray) -> list[str]:
    """The texts of the most likely consistent choice.

    A node counts as kept if it holds main text. Of all choices in which every kept node's parent is kept, the
    one with the largest sum of log probabilities is found from the leaves up: dropping a node
    drops all below; keeping it lets each child choose.
    """
    n = len(page.parent)
    keep = np.concatenate([[0.0], -np.logaddexp(0, -odds)]).tolist()
    drop = np.concatenate([[-1e9], -np.logaddexp(0, odds)]).tolist()
    for i in range(n - 1, 0, -1):
        p = page.parent[i]
        keep[p] += max(keep[i], drop[i])
        if p:
            drop[p] += drop[i]
    kept = [True] * n
    out = []
    for i in range(1, n):
        kept[i] = kept[page.parent[i]] and keep[i] > drop[i]
        if kept[i] and page.text[i] is not None:
            out.append(page.text[i])
    return out


def _sample(pages: DataFrame) -> tuple[list[str], list[str]]:
    """(sentences, short texts of links) of a bounded sample of pages."""
    rows = bounded_sample(pages, SAMPLE_PAGES, "url", "page_id").select(F.substring("html", 1, SAMPLE_CHARS).alias("html"))
    sentences, short = set(), set()
    for row in rows.where("html is not null").collect():
        page = Page(row["html"])
        for text, linked in zip(page.text, page.linked, strict=True):
            if text and linked * 2 > len(text):
                short.add(text[:60])
            elif text:
                sentences.update(s.strip()[:400] for s in text.replace(". ", ".\n").split("\n") if s.strip())
    return sorted(sentences), sorted(short)


class Layouts:
    """Pages of a seeded grammar of layouts, filled with given sentences; main text is marked."""

    def __init__(self, sentences: list[str], short: list[str], seed: int = SEED):
        self.rng = random.Random(seed)
        self.sentences = sentences or ["One plain sentence stands here.", "Another one follows it, somewhat longer than the first."]
        self.short = short or ["Home", "News", "About", "Contact"]

    def _pick(self, *options: str) -> str:
        return self.rng.choice(options)

    def _chance(self, share: float) -> bool:
        return self.rng.random() < share

    def _escape(self, text: str) -> str:
        return text.replace("&", "&amp;").replace("<", "&lt;")

    def _sentences(self, low: int, high: int) -> str:
        return self._escape(" ".join(self.rng.choice(self.sentences) for _ in range(self.rng.randint(low, high))))

    def _label(self) -> str:
        return self._escape(self.rng.choice(self.short))

    def _links(self, low: int, high: int) -> str:
        items = [f'<a href="/x">{self._label()}</a>' for _ in range(self.rng.randint(low, high))]
        return "<ul>" + "".join(f"<li>{x}</li>" for x in items) + "</ul>" if self._chance(0.7) else self._pick(" ", " | ", "").join(items)

    def _box(self, *openings: str) -> tuple[str, str]:
        opening = self._pick(*openings)
        return f"<{opening}>", f"</{opening.split()[0]}>"

    def _junk(self, kind: str) -> str:
        boxes = {
            "nav": ("nav", "div class=menu", 'div id="navigation"', 'ul class="nav navbar"', 'div class="breadcrumbs"', 'nav class="pagination"'),
            "header": ("header", 'div class="header"', 'div id="masthead"', 'div class="site-header top"', 'header class="banner"'),
            "footer": ("footer", 'div class="footer"', 'div id="bottom"', 'div class="copyright"', 'footer class="site"'),
            "aside": ("aside", 'div class="sidebar"', 'div id="side"', 'div class="widget"', 'section class="rail"', "aside class=related"),
            "ad": ('div class="ad"', 'div class="advert"', 'div id="ads"', 'div class="sponsored box"', 'aside class="promo"', 'section class="banner ad-slot"'),
            "notice": ('div class="cookie-notice"', 'div id="consent"', 'div class="alert"', 'div class="popup"', 'section class="notice"', 'div role="dialog"', 'p class="notice"'),
            "form": ("form", 'form class="search"', 'div class="newsletter-signup"', 'form id="login"', "fieldset"),
            "share": ('div class="share"', 'ul class="social"', 'div class="related"', 'section class="more trending"', 'div class="author-bio"', 'div class="recommended"'),
            "hidden": ('div style="display:none"', "div hidden", 'div class="sr-only"'),
        }
        open_, close = self._box(*boxes[kind])
        if kind in ("nav", "share") and self._chance(0.8):
            body = self._links(2, 9)
        elif kind == "form":
            body = f"<label>{self._sentences(1, 1)}</label><input name=q><button>{self._label()}</button>" + (f"<p>{self._sentences(1, 2)}</p>" if self._chance(0.5) else "")
        elif kind == "footer":
            body = f"&copy; {self._label()} &middot; {self._sentences(1, 2)}" if self._chance(0.6) else self._links(2, 6) + f"<p>{self._sentences(1, 1)}</p>"
        elif kind == "header":
            body = f"<{(t := self._pick('h1', 'div', 'p', 'a'))}>{self._label()}</{t}>" + (self._links(2, 6) if self._chance(0.5) else f"<p>{self._sentences(1, 1)}</p>")
        elif kind == "aside":
            body = f"<h3>{self._label()}</h3>" + (self._links(2, 6) if self._chance(0.5) else "") + "".join(
                f"<p>{self._sentences(1, 3)}</p>" for _ in range(self.rng.randint(0, 3)))
        else:
            body = self._sentences(1, 3) if self._chance(0.6) else f"<p>{self._sentences(1, 3)}</p>" + (f"<p>{self._sentences(1, 2)}</p>" if self._chance(0.3) else "")
        return open_ + body + close

    def _comments(self) -> str:
        open_, close = self._box('section class="comments"', 'div id="comments"', 'ol class="commentlist"', 'div class="discussion"', 'div class="reader-comments"', 'section id="disqus_thread"')
        inner = self._box('div class="comment"', "li", "p", 'article class="comment"', "div", 'div class="reply"', "blockquote")
        head = f"<h3>{self._label()}</h3>" if self._chance(0.5) else ""
        return open_ + head + "".join(
            inner[0] + (f"<p>{self._sentences(1, 4)}</p>" if self._chance(0.5) else self._sentences(1, 4)) + inner[1]
            for _ in range(self.rng.randint(1, 6))) + close

    def _main(self) -> str:
        def p() -> str:
            text = _MAIN + (self._label() if self._chance(0.08) else self._sentences(*((1, 1) if self._chance(0.25) else (1, 8))))
            text = f"<b>{text}" + ("</b>" if self._chance(0.7) else "<br>") if self._chance(0.2) else text
            if self._chance(0.2):
                text += f' <a href="/y">{self._label()}</a> {self._sentences(1, 1)}'
            return f"<p>{text}" + ("</p>" if self._chance(0.85) else "")

        parts = [f"<h1>{_MAIN}{self._sentences(1, 1)}</h1>"] if self._chance(0.8) else []
        for _ in range(self.rng.randint(1, 4) if self._chance(0.5) else self.rng.randint(3, 14)):
            roll = self.rng.random()
            if roll < 0.06:
                parts.append("<ul>" + "".join(f"<li>{_MAIN}{self._sentences(1, 2)}</li>" for _ in range(self.rng.randint(2, 5))) + "</ul>")
            elif roll < 0.1:
                parts.append(f"<blockquote>{_MAIN}{self._sentences(1, 3)}</blockquote>")
            elif roll < 0.16:
                parts.append(f"<h2>{_MAIN}{self._sentences(1, 1)}</h2>")
            elif roll < 0.18:
                parts.append(f"<table><tr><td>{_MAIN}{self._sentences(1, 1)}</td><td>{_MAIN}{self._label()} x</td></tr></table>")
            elif roll < 0.2:
                parts.append(f'<figure><img src="i.png"><figcaption>{_MAIN}{self._sentences(1, 1)}</figcaption></figure>')
            elif roll < 0.24:
                parts.append(f"<div>{_MAIN}{self._sentences(1, 3)}</div>")
            else:
                parts.append(p())
        if self._chance(0.35):
            kind = self._pick("ad", "share", "aside", "form", "notice", "nav", "hidden")
            parts.insert(self.rng.randint(1 if len(parts) > 1 else 0, len(parts)), self._junk(kind))
        if self._chance(0.12):
            parts.append(self._comments())
        open_, close = self._box(
            "article", "article", "main", 'article class="post"', 'div class="content"', 'div id="main-content"', 'div class="post-body"',
            'section class="entry-content"', 'div class="article-text"', 'div role="main"', 'div class="story"', "div", 'div id="text"')
        return open_ + "".join(parts) + close

    def page(self) -> str:
        before = [self._junk(k) for k in ("header", "nav", "notice", "ad", "form", "aside", "hidden") if self._chance({"nav": 0.7, "header": 0.5, "ad": 0.4}.get(k, 0.2))]
        after = [self._junk(k) for k in ("ad", "share", "aside", "form", "notice", "footer", "nav", "hidden") if self._chance({"footer": 0.7, "aside": 0.4}.get(k, 0.2))]
        if self._chance(0.4):
            after.insert(self.rng.randint(0, len(after)), self._comments())
        self.rng.shuffle(before)
        middle = self._main()
        if self._chance(0.3):
            inside = before[len(before) // 2 :], after[: len(after) // 2]
            before, after = before[: len(before) // 2], after[len(after) // 2 :]
            open_, close = self._box("div", 'div class="wrapper"', 'div id="page"', "main", 'div class="container"', "section", 'div id="content"')
            middle = open_ + "".join(inside[0]) + middle + "".join(inside[1]) + close
        return f"<!DOCTYPE html><html><head><title>{self._label()}</title></head><body>{''.join(before)}{middle}{''.join(after)}</body></html>"


def training_rows(layouts: Layouts, count: int) -> tuple[np.ndarray, np.ndarray]:
    """Features and labels (holds main text) of the nodes of `count` pages."""
    rows, labels = [], []
    for _ in range(count):
        page = Page(layouts.page())
        holds = [False] * len(page.parent)
        for i in range(len(page.parent) - 1, 0, -1):
            text = page.text[i]
            if text is not None:
                holds[i] = _MAIN in text
                page.text[i] = text.replace(_MAIN, "")
            if holds[i]:
                holds[page.parent[i]] = True
        rows.append(page.features())
        labels.extend(holds[1:])
    return np.concatenate(rows), np.array(labels, float)


def learn(pages: DataFrame, layouts: int = LAYOUTS) -> Trees:
    """Trees fitted to generated layouts that hold sentences of the pages; no page's own layout is taken as an answer."""
    return boost(*training_rows(Layouts(*_sample(pages)), layouts))


def _extract(batches: Iterator[pa.RecordBatch], trees: Trees) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        others = [c for c in batch.schema.names if c != "html"]
        for first in range(0, batch.num_rows, 200):
            part = batch.slice(first, 200)
            pages = [Page(source or "") for source in part.column("html").to_pylist()]
            sizes = [len(page.parent) - 1 for page in pages]
            odds = trees.score(np.concatenate([p.features() for p in pages])) if sum(sizes) else np.zeros(0)
            bounds = np.cumsum([0, *sizes])
            texts = ["\n\n".join(main_blocks(p, odds[bounds[i] : bounds[i + 1]])) for i, p in enumerate(pages)]
            yield pa.RecordBatch.from_arrays(
                [*(part.column(c) for c in others), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                [*others, "text", "n_chars"])


def extract(pages: DataFrame, html_col: str = "html", layouts: int = LAYOUTS) -> DataFrame:
    """`pages` without `html_col`, plus `text` (blocks of the article, joined by blank lines) and `n_chars`.

    Pages are read whole. Scripts, styles, embedded objects and controls are no text. A null or empty page, or one without
    an article, has the empty text. Rows are extracted alone, so repeated rows give equal texts and null ids change nothing.
    Without pages the result is empty. Columns of `pages` named text, n_chars or html in any case are replaced.
    """
    names = [c for c in pages.columns if c != html_col and c.lower() not in ("text", "n_chars", "html")]
    rows = pages.select(*[pages[c] for c in names], F.col(html_col).cast("string").alias("html"))
    keys = [F.col(c) if c in names else F.lit(None).alias(c) for c in ("url", "page_id")]
    trees = learn(pages.select(*keys, F.col(html_col).cast("string").alias("html")), layouts)
    schema = ", ".join(f"`{n}` {t}" for n, t in rows.dtypes if n != "html")
    return rows.mapInArrow(lambda batches: _extract(batches, trees), (schema + ", " if schema else "") + "text string, n_chars long")
