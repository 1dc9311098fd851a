"""A small reader of HTML: block elements as a tree, text pieces in page order, and features of every block element."""

from __future__ import annotations

import re
from html import unescape

import numpy as np

# Elements that begin and end a block of text, elements whose content is never text of the page, and elements without an end.
BLOCKS = frozenset("html body main article section div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table thead tbody tfoot tr td th blockquote pre "
                   "figure figcaption header footer nav aside form fieldset address details summary dialog center hgroup menu search hr".split())
SILENT = frozenset("script style noscript template textarea select option button svg math iframe object title head canvas audio video datalist".split())
#: Silent elements that can hold one of their own kind.
NESTED = frozenset("svg math object template video audio canvas".split())
#: What can stand in a head; any other tag, or the body's, ends it.
IN_HEAD = frozenset("head title meta link base script style noscript template object bgsound basefont".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_CLOSES = {"p": frozenset(["p"]), "li": frozenset(["li"]), "dt": frozenset(["dt", "dd"]), "dd": frozenset(["dt", "dd"]), "tr": frozenset(["tr", "td", "th"]),
           "td": frozenset(["td", "th"]), "th": frozenset(["td", "th"]), "option": frozenset(["option"])}
#: A list item or cell is not closed by one in an inner list or table.
_SCOPES = {"li": frozenset(["ul", "ol", "menu"]), "dt": frozenset(["dl"]), "dd": frozenset(["dl"]), "tr": frozenset(["table"]), "td": frozenset(["table"]),
           "th": frozenset(["table"])}

GOOD = "article content main post entry body story text prose page".split()
BAD = ("nav menu footer header sidebar side ad ads advert advertisement banner cookie notice consent promo sponsor related comment comments reply respond "
       "disqus share social subscribe newsletter signup login form widget breadcrumb breadcrumbs popup modal masthead toolbar tags meta copyright legal "
       "pagination pager recommended alert search byline skip toc").split()
TAGS = "p h1 h2 h3 li ul div section article main nav header footer aside form table td blockquote pre figure body".split()

#: A quote opens a value only after an equals sign. A tag whose quotes leave it without an end shows that they are broken.
_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*>?|<(/?)([a-zA-Z][^\s/>]*)((?:=\s*"[^"]*"|=\s*'[^']*'|[^>])*+)(?:>|\Z)""", re.S)
_UNQUOTED = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*>?|<(/?)([a-zA-Z][^\s/>]*)([^>]*+)>""", re.S)
#: What can still come where no tag has an end.
_UNENDED = re.compile(r"<[!?].*()()()", re.S)
_ATTRIBUTE = re.compile(r"""\b(class|id|role|aria-label|itemprop|hidden|style)\s*(?:=\s*("[^"]*"|'[^']*'|[^\s>]+))?""", re.I)
_PART = re.compile(r"[a-z]+")


class Page:
    """Nodes in page order. ``parent[i] < i``; ``pieces`` are (node, block number, inside a link, raw text)."""

    def __init__(self, html: str | None):
        self.tag, self.parent, self.names, self.hidden = ["html"], [-1], [frozenset()], [False]
        self.inner = [0]  # tags and form controls within a node itself
        self.controls = [0]
        self.pieces: list[tuple[int, int, bool, str]] = []
        self._read(html or "")

    def _read(self, html: str) -> None:
        """``silent`` is the element whose content is left out, ``inside`` the blocks begun in it. It ends at its own end tag or that of a
        block around it; if only the page's end would end it, its content is read as if it had none of its tags.
        """
        open_, links, block, at, silent, depth = [0], 0, 0, 0, "", 0
        head, inside, begun, plain = False, [], 0, set()
        token, end_of_tags = _TOKEN, html.rfind(">")
        while True:
            m = (token if at <= end_of_tags else _UNENDED).search(html, at)
            if m and m[2] and token is _TOKEN and html[m.end() - 1] != ">":
                token = _UNQUOTED  # from here on quotes mean nothing, so that a page is read in time that grows with its length
                continue
            last = m is None or m[1] == "/" and m[2].lower() in ("body", "html")
            if silent and last and not (m and (m[2].lower() in inside)):
                plain.add(silent)  # read again from its start tag; each name at most once
                silent, at = "", begun
                continue
            text = html[at:m.start() if m else len(html)]
            if not silent and text and not (head and text.isspace()):
                head = False  # a text cannot stand in a head
                self.pieces.append((open_[-1], block, links > 0, text))
            if m is None:
                break
            at = m.end()
            tag = m[2].lower() if m[2] else ""
            if not tag:
                continue
            closing = m[1] == "/"
            if tag in ("script", "style", "title") and not closing and not (silent and tag == "title"):
                end = re.compile(f"</{tag}", re.I).search(html, at)
                if end or tag != "title":
                    at = html.find(">", end.start()) + 1 if end else len(html)
                    at = at or len(html)
                else:
                    at = max(html.find("<", at), at)  # a title without an end is what comes before the next tag
                continue
            if silent:
                if head and tag == ("head" if closing else "body"):
                    silent = ""
                elif tag == silent:
                    depth += -1 if closing else tag in NESTED
                    if depth <= 0:
                        silent = ""
                    continue
                elif tag not in BLOCKS or tag in VOID:
                    continue
                elif not closing:
                    inside.append(tag)
                    continue
                elif tag in inside:
                    del inside[len(inside) - 1 - inside[::-1].index(tag):]
                    continue
                elif not any(self.tag[k] == tag for k in open_):
                    continue
                else:
                    silent = ""
            if head:
                if closing and tag not in ("body", "html") or tag == "html" and not closing:
                    head = head and tag != "head"
                    continue
                if closing or tag not in IN_HEAD:
                    head = False
                elif tag not in SILENT:
                    continue
            if tag == "head":
                head = not closing and len(open_) == 1
                continue
            if tag in SILENT:
                if not closing:
                    self.controls[open_[-1]] += tag in ("textarea", "select", "button")
                    if not m[3].endswith("/") and tag not in plain:
                        silent, depth, inside, begun = tag, 1, [], at
                continue
            if tag == "body" and not closing and len(open_) > 1:
                continue
            if tag in BLOCKS and tag not in VOID:
                block += 1
                if closing:
                    for k in range(len(open_) - 1, 0, -1):
                        if self.tag[open_[k]] == tag:
                            del open_[k:]
                            break
                elif tag != "html":
                    if tag not in ("body", "html") and self.tag[open_[-1]] == "p" and tag != "p":
                        open_.pop()
                    closes, scope = _CLOSES.get(tag), _SCOPES.get(tag, frozenset())
                    if closes:
                        for k in range(len(open_) - 1, 0, -1):
                            if self.tag[open_[k]] in closes:
                                del open_[k:]
                                break
                            if self.tag[open_[k]] in scope or tag == "p":
                                break
                    self._add(tag, open_[-1], m[3])
                    open_.append(len(self.tag) - 1)
            else:
                self.inner[open_[-1]] += not closing
                if tag == "a":
                    links = max(0, links - 1) if closing else 1
                elif tag in ("input", "label"):
                    self.controls[open_[-1]] += not closing
                elif tag == "br" or tag == "hr":
                    block += tag == "hr"
                    self.pieces.append((open_[-1], block, links > 0, " "))

    def _add(self, tag: str, parent: int, attributes: str) -> None:
        found = _ATTRIBUTE.findall(attributes)
        words = {w for name, value in found if name.lower() not in ("style", "hidden") for w in _PART.findall(value.lower())}
        style = "".join(v for n, v in found if n.lower() == "style").replace(" ", "").lower()
        self.tag.append(tag)
        self.parent.append(parent)
        self.names.append(frozenset(words))
        self.hidden.append(any(n.lower() == "hidden" for n, _ in found) or "display:none" in style)
        self.inner.append(0)
        self.controls.append(0)

    def blocks(self, kept: np.ndarray) -> list[str]:
        """Text blocks of kept nodes: references decoded, white space as one space, trimmed, empty ones left out."""
        out: list[str] = []
        last = None
        for node, block, _, raw in self.pieces:
            if kept[node]:
                if (node, block) == last:
                    out[-1] += raw
                else:
                    out.append(raw)
                    last = (node, block)
        return [t for t in (" ".join(unescape(raw).split()) for raw in out) if t]

    def features(self) -> tuple[np.ndarray, np.ndarray]:
        """One row of FEATURES per node, and the characters of each subtree."""
        n = len(self.tag)
        parent = np.array(self.parent)
        own = np.zeros((n, 6))  # characters, words, characters in links, sentence marks, pieces, position
        at = 0
        for node, _, link, raw in self.pieces:
            size = len(raw)
            own[node, 0] += size
            own[node, 1] += raw.count(" ") + 1
            own[node, 2] += size * link
            own[node, 3] += raw.count(".") + raw.count(",")
            own[node, 4] += 1
            at += size
        sub = np.column_stack([own[:, :5], np.array(self.inner) + 1.0, np.array(self.controls, dtype=float),
                               np.array([t == "p" for t in self.tag], dtype=float), np.array([t in ("li", "td") for t in self.tag], dtype=float)])
        depth, children = np.zeros(n), np.zeros(n)
        for i in range(n - 1, 0, -1):
            sub[parent[i]] += sub[i]
            children[parent[i]] += 1
        for i in range(1, n):
            depth[i] = depth[parent[i]] + 1
        rank, before = np.zeros(n), np.zeros(n)
        seen = np.zeros(n)
        for i in range(1, n):
            p = parent[i]
            rank[i] = seen[p]
            seen[p] += 1
        # Text before a node in page order: pieces carry it.
        run, first = 0.0, {}
        for node, _, _, raw in self.pieces:
            first.setdefault(node, run)
            run += len(raw)
        low = np.full(n, run)
        for node, value in first.items():
            low[node] = value
        for i in range(n - 1, 0, -1):
            low[parent[i]] = min(low[parent[i]], low[i])
        before = low / max(run, 1.0)
        chars, whole = sub[:, 0], max(sub[0, 0], 1.0)
        up = np.maximum(parent, 0)
        good = np.array([bool(w & _GOOD) for w in self.names], dtype=float)
        bad = np.array([bool(w & _BAD) for w in self.names], dtype=float)
        tags = np.array([_TAG.get(t, len(TAGS)) for t in self.tag])
        above_good, above_bad = good.copy(), bad.copy()
        boiler = np.isin(tags, _BOILER).astype(float)
        body = np.isin(tags, _BODY).astype(float)
        for i in range(1, n):
            p = parent[i]
            above_good[i] = max(above_good[i], above_good[p])
            above_bad[i] = max(above_bad[i], above_bad[p])
            boiler[i] = max(boiler[i], boiler[p])
            body[i] = max(body[i], body[p])
        hidden = np.array(self.hidden, dtype=float)
        table = np.column_stack([
            depth, np.log1p(chars), chars / whole, np.log1p(own[:, 0]), sub[:, 2] / np.maximum(chars, 1), chars / sub[:, 5], sub[:, 3] / np.maximum(sub[:, 1], 1),
            chars / np.maximum(sub[:, 4], 1), np.log1p(sub[:, 6]), np.log1p(sub[:, 7]), sub[:, 7] / sub[:, 5], sub[:, 8] / sub[:, 5], children, children[up],
            rank, rank / np.maximum(children[up], 1), chars / np.maximum(chars[up], 1), np.log1p(chars[up]), sub[up, 2] / np.maximum(chars[up], 1),
            before, before + chars / whole, good, bad, above_good, above_bad, boiler, body, hidden, *((tags == k).astype(float) for k in range(len(TAGS)))])
        return table.astype(np.float32), chars


_GOOD, _BAD = frozenset(GOOD), frozenset(BAD)
_TAG = {t: i for i, t in enumerate(TAGS)}
_BOILER = [_TAG[t] for t in ("nav", "header", "footer", "aside", "form")]
_BODY = [_TAG[t] for t in ("article", "main")]
FEATURES = ["depth", "log_chars", "page_share", "log_own", "link_share", "density", "marks", "piece_length", "controls", "paragraphs", "paragraph_share",
            "item_share", "children", "siblings", "rank", "relative_rank", "sibling_share", "log_parent", "parent_links", "from", "to", "good", "bad",
            "above_good", "above_bad", "in_boilerplate", "in_article", "hidden", *(f"is_{t}" for t in TAGS)]
