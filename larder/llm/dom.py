"""A page's elements and text blocks, with the features that tell its article from the rest."""

from __future__ import annotations

import html
import math
import re
from collections import Counter

import numpy as np

_NAME = r"[a-zA-Z][^\s/>]*"
_TOKEN = re.compile(
    rf"<!--.*?(?:-->|\Z)|<[!?][^>]*>|</\s*({_NAME})[^>]*>|<({_NAME})((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>|<({_NAME})([^>]*)>", re.S)
_ATTRIBUTE = re.compile(r"(class|id|role|itemprop|aria-label|hidden|style)\s*(?:=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
_WORD = re.compile(r"[a-z]+")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")

# Element names of HTML by how a parser treats them.
INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small "
    "span strike strong sub sup time tt u var wbr object math mi mn mo ms mtext mspace mrow mfrac msqrt mroot mstyle merror mpadded mphantom "
    "mfenced menclose msub msup msubsup munder mover munderover semantics annotation".split())
VOID = frozenset("area base col embed frame hr img input link meta param source track wbr br".split())
#: What these hold is no text of the page.
SKIPPED = frozenset("script style template noscript iframe svg title select textarea button noframes".split())
#: Of these, the ones in which other tags are read: without an end of their own they end with the element they stand in.
PARSED = frozenset("template svg select button".split())
_CLOSES_P = frozenset(
    "address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header "
    "hr main menu nav ol p pre section table ul".split())
_CLOSES = {"li": ("li", ("ul", "ol", "menu")), "dt": ("dt dd", ("dl",)), "dd": ("dt dd", ("dl",)), "tr": ("tr td th", ("table",)),
           "td": ("td th", ("tr", "table")), "th": ("td th", ("tr", "table"))}

TAGS = (
    ("article", "article"), ("main", "main"), ("section", "section"), ("div", "div center"), ("p", "p"), ("heading", "h1 h2 h3 h4 h5 h6 hgroup"),
    ("list", "ul ol menu dir"), ("item", "li"), ("nav", "nav"), ("header", "header"), ("footer", "footer"), ("aside", "aside"),
    ("form", "form fieldset legend"), ("table", "table tbody thead tfoot tr td th caption"), ("root", "body html head"),
    ("figure", "figure figcaption picture video audio"), ("quote", "blockquote pre address"), ("terms", "dl dt dd"), ("dialog", "dialog details summary"),
)
_TAG = {name: i for i, (_, names) in enumerate(TAGS) for name in names.split()}
#: Groups of words in class, id and role attributes.
TOKENS = (
    ("content", "content article post entry story body text main page copy prose read"),
    ("nav", "nav navbar navigation menu breadcrumb breadcrumbs pagination pager toc links skip"),
    ("ad", "ad ads adv advert advertisement banner sponsor sponsored promo promotion dfp commercial outbrain taboola"),
    ("notice", "notice cookie cookies consent gdpr alert popup modal overlay message privacy announcement toast warning dialog"),
    ("comments", "comment comments commentlist reply replies respond discussion disqus reader feedback responses"),
    ("sidebar", "sidebar side aside widget widgets rail complementary secondary tags tagcloud"),
    ("header", "header head masthead top topbar site logo tagline brand hero"),
    ("footer", "footer foot bottom copyright colophon legal contentinfo imprint"),
    ("related", "related recommended share sharing social more also trending popular follow author bio teaser teasers latest"),
    ("form", "form newsletter subscribe subscription signup login search contact register email survey"),
    ("hidden", "hidden none invisible sr print noprint"),
)
_TOKEN_GROUP = {word: i for i, (_, words) in enumerate(TOKENS) for word in words.split()}
_T, _G = len(TAGS), len(TOKENS)
NUMBERS = ("is_block depth log_words log_chars words_per_block link_share punctuation page_share sibling_count sibling_index "
           "sibling_words start_share log_blocks first_upper").split()
FEATURES = [f"tag_{n}" for n, _ in TAGS] + [f"own_{n}" for n, _ in TOKENS] + [f"above_tag_{n}" for n, _ in TAGS] + [
    f"above_{n}" for n, _ in TOKENS] + NUMBERS


class Page:
    """Nodes in page order: elements, and blocks (runs of text between block-level tags) as leaves.

    parent[i] < i. For blocks, text[i] has its references decoded and white space collapsed, and is not empty.
    """

    def __init__(self, source: str):
        self.parent: list[int] = [-1]
        self.tag: list[int] = [_TAG["html"]]
        self.groups: list[int] = [0]
        self.text: list[str | None] = [None]
        self.linked: list[int] = [0]
        self._read(source)

    def _node(self, parent: int, tag: int, groups: int, text: str | None = None, linked: int = 0) -> int:
        self.parent.append(parent)
        self.tag.append(tag)
        self.groups.append(groups)
        self.text.append(text)
        self.linked.append(linked)
        return len(self.parent) - 1

    def _read(self, source: str) -> None:
        stack: list[tuple[str, int]] = [("html", 0)]
        pieces: list[str] = []
        links: list[str] = []
        in_link, at = False, 0
        tags_end = source.rfind(">") + 1  # there is no tag beyond it
        comment = source.find("<!--", tags_end)
        end = comment if comment >= 0 else len(source)
        opened: Counter[str] = Counter()
        unclosed: set[str] = set()

        def close(depth: int) -> None:
            opened.subtract(name for name, _ in stack[depth:])
            del stack[depth:]

        def skip(name: str, at: int) -> int:
            """Where the content of a skipped element ends."""
            if name not in unclosed:
                found = re.compile(rf"</{name}\s*[^>]*>", re.I).search(source, at, tags_end)
                if found:
                    return found.end()
                unclosed.add(name)  # nor is there one further on
            around = {name for name, _ in stack[1:]}
            if name not in PARSED or not around:
                return end
            found = re.compile(rf"</(?:{'|'.join(map(re.escape, sorted(around)))})[\s>]", re.I).search(source, at, tags_end)
            return found.start() if found else end

        def flush() -> None:
            if pieces:
                text = " ".join(html.unescape("".join(pieces)).split())
                if text:
                    linked = len(" ".join(html.unescape("".join(links)).split())) if links else 0
                    self._node(stack[-1][1], -1, 0, text, min(linked, len(text)))
                pieces.clear()
                links.clear()

        while at < end:
            found = _TOKEN.search(source, at, tags_end) if at < tags_end else None
            stop = found.start() if found else end
            if stop > at:
                piece = source[at:stop]
                pieces.append(piece)
                if in_link:
                    links.append(piece)
            if not found:
                break
            at = found.end()
            if found.group().startswith("<!--") and not found.group().endswith("-->"):
                break  # a comment that never ends
            closing, opening = found.group(1), found.group(2) or found.group(4)
            if opening:
                name = opening.lower()
                attributes = found.group(3) if found.group(2) else found.group(5)
                if name in SKIPPED:
                    at = at if attributes.rstrip().endswith("/") else skip(name, at)
                    pieces.append(" ")
                elif name in INLINE:
                    if name == "a":
                        in_link = True
                    elif name in ("br", "img"):
                        pieces.append(" ")
                elif name in VOID:
                    if name == "hr":
                        flush()
                    else:
                        pieces.append(" ")
                else:
                    flush()
                    in_link = False
                    if name in _CLOSES_P and stack[-1][0] == "p":
                        close(len(stack) - 1)
                    elif name in _CLOSES and any(opened[n] for n in _CLOSES[name][0].split()):
                        names, limits = _CLOSES[name]
                        for depth in range(len(stack) - 1, 0, -1):
                            if stack[depth][0] in limits:
                                break
                            if stack[depth][0] in names.split():
                                close(depth)
                                break
                    groups = _groups(attributes) if attributes.strip() else 0
                    if name in ("html", "body") and len(stack) > 1:
                        continue
                    if name != "html":
                        node = self._node(stack[-1][1], _TAG.get(name, _TAG["div"]), groups)
                        stack.append((name, node))
                        opened[name] += 1
            elif closing:
                name = closing.lower()
                if name == "a":
                    in_link = False
                elif opened[name] and name not in INLINE and name not in ("html", "body"):
                    for depth in range(len(stack) - 1, 0, -1):
                        if stack[depth][0] == name:
                            flush()
                            in_link = False
                            close(depth)
                            break
        flush()

    def features(self) -> np.ndarray:
        """(nodes x features) of every node but the root, which is always open."""
        n = len(self.parent)
        words, chars, linked, marks, blocks = [0] * n, [0] * n, [0] * n, [0] * n, [0] * n
        children, index, depth, start = [0] * n, [0] * n, [0] * n, [0] * n
        seen = 0
        for i in range(n):
            if i:
                p = self.parent[i]
                depth[i], index[i] = depth[p] + 1, children[p]
                children[p] += 1
            start[i] = seen
            text = self.text[i]
            if text is not None:
                words[i], chars[i], linked[i], blocks[i] = text.count(" ") + 1, len(text), self.linked[i], 1
                marks[i] = text.count(".") + text.count(",") + text.count("?") + text.count("!") + text.count(";")
                seen += chars[i]
        for i in range(n - 1, 0, -1):
            p = self.parent[i]
            words[p] += words[i]
            chars[p] += chars[i]
            linked[p] += linked[i]
            marks[p] += marks[i]
            blocks[p] += blocks[i]
        total = max(1, chars[0])
        out = np.zeros((n - 1, len(FEATURES)), np.float32)
        above_tag, above = [0] * n, [0] * n
        base = 2 * (_T + _G)
        log = math.log1p
        for i in range(1, n):
            p, row = self.parent[i], out[i - 1]
            above_tag[i] = above_tag[p] | (1 << self.tag[p])
            above[i] = above[p] | self.groups[p]
            if self.tag[i] >= 0:
                row[self.tag[i]] = 1
            for offset, bits in ((_T, self.groups[i]), (_T + _G, above_tag[i]), (2 * _T + _G, above[i])):
                while bits:
                    low = bits & -bits
                    row[offset + low.bit_length() - 1] = 1
                    bits ^= low
            text = self.text[i]
            row[base:] = (
                text is not None, depth[i], log(words[i]), log(chars[i]), words[i] / max(1, blocks[i]), linked[i] / max(1, chars[i]),
                marks[i] / max(1, words[i]), chars[i] / total, children[p], index[i] / children[p],
                (words[p] - words[i]) / max(1, children[p] - 1), start[i] / total, log(blocks[i]),
                bool(text) and text[0].isupper(),
            )
        return out


def _groups(attributes: str) -> int:
    """Bits of the token groups named in class, id and role, and of being hidden."""
    bits = 0
    for name, *values in _ATTRIBUTE.findall(attributes):
        value = next((v for v in values if v), "")
        name = name.lower()
        if name == "hidden" or (name == "style" and "display:none" in value.replace(" ", "").lower()):
            bits |= 1 << _TOKEN_GROUP["hidden"]
        elif name == "style":
            continue
        elif name == "itemprop" and value.lower() != "articlebody":
            continue
        else:
            for word in _WORD.findall(_CAMEL.sub(" ", value).lower()):
                group = _TOKEN_GROUP.get(word)
                if group is None and len(word) > 3 and word.endswith("s"):
                    group = _TOKEN_GROUP.get(word[:-1])
                if group is not None:
                    bits |= 1 << group
                elif word == "articlebody":
                    bits |= 1 << _TOKEN_GROUP["content"]
    return bits
