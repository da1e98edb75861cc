"""Main text of web pages by boosted trees over DOM nodes (operator 7).

A page is parsed into elements and text blocks.  Every node gets features of its
subtree (text, links, density), its tag and attribute words, its depth and place,
its siblings and its ancestors; gradient-boosted trees give the log odds that the
node holds or belongs to the main text.  Decoding is hierarchical: a node is kept
only with all its ancestors, and the kept set has the greatest sum of log odds,
found from the leaves up; so no choice contradicts that of an ancestor.

The trees are fitted here, on ``TRAINING_PAGES`` generated pages whose layouts,
names and lengths vary and whose main text is known.

Defined cases: a null or empty page has the empty text; unclosed and stray tags
are mended as browsers do for paragraphs, list items, cells and options; scripts,
styles, templates, frames, form values and comments are no text, that of formulas,
drawings and fallbacks (math, svg, noscript, object) is; a page of any length or
depth is read in one pass that is linear in it; nodes of equal log odds are treated
alike and a sum of zero keeps nothing; repeated rows return once each; extract()
passes other columns through whatever their names, but for the new one; an empty
table gives an empty one.
"""

from __future__ import annotations

import functools
import html as entities
import random
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql import types as T

from glyphlake.llm.boosting import BoostedTrees, fit
from glyphlake.llm.common import as_bytes, chunks, table, tidy

#: Generated pages that the trees are fitted on.
TRAINING_PAGES = 700

# Tags by their role.
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style template iframe textarea select title".split())
_INLINE = frozenset("a abbr acronym audio b bdi bdo big br canvas cite code data del dfn em font i img ins kbd label mark math mfrac mi mn mo mrow ms msqrt mstyle msub msup mtext noscript object q rp rt ruby s samp small span strike strong sub sup svg time tt u var video wbr".split())
_CLOSED_BY_BLOCK = frozenset(["p"])
_CLOSES_SELF = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table", "tbody", "thead"}, "td": {"tr"}, "th": {"tr"}, "option": {"select"}}
_SCOPE = frozenset("article aside body div footer form header html main nav section table td ul ol".split())
_TAGS = ["html", "body", "main", "article", "section", "div", "header", "footer", "nav", "aside", "form", "p", "ul", "ol", "li", "table", "blockquote", "pre", "a", "button", "figure", "#text"]
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
# Words of class, id and role that speak against and for main text.
_AGAINST = frozenset("nav navbar navigation menu header masthead banner footer foot contentinfo sidebar side aside complementary rail widget ad ads advert advertisement adslot sponsor sponsored promo promotion cookie cookies consent notice alert gdpr popup modal overlay comment comments reply replies discussion disqus respond share sharing social related recommended trending newsletter subscribe signup login search form breadcrumb breadcrumbs pagination pager toolbar tags meta byline legal copyright skip hidden".split())
_FOR = frozenset("article content main post entry story text body page copy".split())
_NAME_RE = re.compile(r"</?([a-zA-Z][^\s/>]*)")
_STOP_RE = re.compile(r"""=\s*["']|>""")
_ATTR_RE = re.compile(r"""([^\s=/>"']+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]+))?""")
_WORD_RE = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_COMMON = ("class", "id", "role", "hidden", "aria-hidden", "style")


#: Elements that may be open at once; what is nested deeper counts as a child of the last.
MAX_DEPTH = 512


def tags(source: str) -> Iterator[tuple[int, int]]:
    """Spans of tags, comments and declarations, in one pass that never goes back; what runs off the end ends there.

    A quote protects ``>`` only where a value begins, and only if it is closed.
    """
    end, at, unclosed = len(source), 0, set()
    while (begin := source.find("<", at)) >= 0:
        if source.startswith("<!--", begin):
            stop = source.find("-->", begin + 4)
            at = end if stop < 0 else stop + 3
        elif source.startswith("<![CDATA[", begin):
            stop = source.find("]]>", begin + 9)
            at = end if stop < 0 else stop + 3
        elif source.startswith(("<!", "<?"), begin):
            stop = source.find(">", begin)
            at = end if stop < 0 else stop + 1
        elif m := _NAME_RE.match(source, begin):
            at = m.end()
            while stop := _STOP_RE.search(source, at):
                at = stop.end()
                quote = source[at - 1]
                if quote == ">":
                    break
                if quote not in unclosed:
                    closed = source.find(quote, at)
                    if closed < 0:
                        unclosed.add(quote)  # nor is there one further on
                    else:
                        at = closed + 1
            else:
                at = end
        else:
            at = begin + 1
            continue
        yield begin, at


class Page:
    """Nodes in page order: parent, tag, depth, attribute words, own text; text blocks are nodes with the tag #text."""

    def __init__(self, source: str):
        self.parent: list[int] = [-1]
        self.tag: list[str] = ["#page"]
        self.words: list[tuple[int, int, int]] = [(0, 0, 0)]
        self.text: list[str] = [""]
        self.linked: list[int] = [0]
        self._open: list[int] = [0]
        #: Open elements beyond MAX_DEPTH, and open inline elements, by name.
        self._deeper: Counter[str] = Counter()
        self._inline: Counter[str] = Counter()
        self._run: list[str] = []
        self._run_linked = 0
        at, end = 0, len(source)
        for begin, stop in tags(source):
            if begin < at:  # inside an element that is left out
                continue
            if begin > at:
                self._chars(source[at:begin])
            at = stop
            raw = source[begin:stop]
            if raw[1] in "!?":
                if raw.startswith("<![CDATA["):
                    self._chars(raw[9:].removesuffix("]]>"))
                continue
            name = _NAME_RE.match(raw).group(1).lower()
            if raw[1] == "/":
                self._end(name)
            elif name in _RAW and not raw.endswith("/>"):
                found = re.compile(rf"</{name}(?![^\s/>])", re.I).search(source, at)
                stop = source.find(">", found.end()) if found else -1
                at = end if stop < 0 else stop + 1
                if at == end:
                    break
            else:
                self._begin(name, raw)
        if at < end:
            self._chars(source[at:])
        self._flush()

    def _chars(self, s: str) -> None:
        s = entities.unescape(s)
        self._run.append(s)
        if self._inline["a"]:
            self._run_linked += len(s.strip())

    def _flush(self) -> None:
        """End the text block that is being read."""
        if self._run:
            text = " ".join("".join(self._run).split())
            if text:
                self._add("#text", self._open[-1], (0, 0, 0))
                self.text[-1], self.linked[-1] = text, min(self._run_linked, len(text))
            self._run, self._run_linked = [], 0

    def _add(self, tag: str, parent: int, words: tuple[int, int, int]) -> None:
        self.parent.append(parent)
        self.tag.append(tag)
        self.words.append(words)
        self.text.append("")
        self.linked.append(0)

    def _begin(self, name: str, raw: str) -> None:
        if name in _INLINE:
            if name == "br":
                self._run.append(" ")
            elif name not in _VOID:
                self._inline[name] += 1
            return
        self._flush()
        self._inline.clear()
        if name in _VOID:
            return
        last = self.tag[self._open[-1]]
        if last in _CLOSED_BY_BLOCK or last in _HEADINGS and name in _HEADINGS:
            self._open.pop()
        if name in _CLOSES_SELF:
            for k in range(len(self._open) - 1, 0, -1):
                t = self.tag[self._open[k]]
                if t in _CLOSES_SELF[name]:
                    break
                if t == name or name in ("dt", "dd") and t in ("dt", "dd") or name in ("td", "th") and t in ("td", "th"):
                    del self._open[k:]
                    break
        attributes = {a.lower(): (v or "").strip("\"'") for a, v in _ATTR_RE.findall(raw[1 + len(name) :].rstrip("/>"))} if len(raw) > len(name) + 2 else {}
        against = favour = hidden = 0
        for key in ("class", "id", "role"):
            for w in _WORD_RE.findall(attributes.get(key, "")):
                w = w.lower()
                against += w in _AGAINST
                favour += w in _FOR
        style = attributes.get("style", "").replace(" ", "").lower()
        hidden = int("hidden" in attributes or attributes.get("aria-hidden") == "true" or "display:none" in style or "visibility:hidden" in style)
        self._add(name, self._open[-1], (against, favour, hidden))
        if raw.endswith("/>"):
            return
        if len(self._open) < MAX_DEPTH:
            self._open.append(len(self.tag) - 1)
        else:
            self._deeper[name] += 1

    def _end(self, name: str) -> None:
        if name in _INLINE:
            if self._inline[name]:
                self._inline[name] -= 1
            return
        self._flush()
        self._inline.clear()
        if self._deeper[name]:
            self._deeper[name] -= 1
            return
        for k in range(len(self._open) - 1, 0, -1):
            t = self.tag[self._open[k]]
            if t == name:
                del self._open[k:]
                return
            if t in _SCOPE and name not in _SCOPE:
                return


NEGATIVE_TAGS = frozenset(["nav", "header", "footer", "aside", "form", "button", "dialog"])
POSITIVE_TAGS = frozenset(["article", "main"])
_N_FEATURES = len(_TAGS) + 25


def features(page: Page) -> np.ndarray:
    """One row of features a node."""
    n = len(page.tag)
    parent = np.array(page.parent)
    chars = np.array([len(t) for t in page.text], float)
    linked = np.array(page.linked, float)
    blocks = np.array([t == "#text" for t in page.tag], float)
    stops = np.array([sum(map(t.count, ".,;!?")) for t in page.text], float)
    nodes = np.ones(n)
    for i in range(n - 1, 0, -1):
        p = parent[i]
        chars[p] += chars[i]
        linked[p] += linked[i]
        blocks[p] += blocks[i]
        stops[p] += stops[i]
        nodes[p] += nodes[i]
    depth = np.zeros(n)
    above_against, above_for, above_neg, above_pos, above_hidden = (np.zeros(n) for _ in range(5))
    words = np.array(page.words, float)
    neg = np.array([t in NEGATIVE_TAGS for t in page.tag], float)
    pos = np.array([t in POSITIVE_TAGS for t in page.tag], float)
    for i in range(1, n):
        p = parent[i]
        depth[i] = depth[p] + 1
        above_against[i] = above_against[p] + words[p, 0]
        above_for[i] = above_for[p] + words[p, 1]
        above_neg[i] = above_neg[p] + neg[p]
        above_pos[i] = above_pos[p] + pos[p]
        above_hidden[i] = above_hidden[p] + words[p, 2]
    children = np.bincount(parent[1:], minlength=n).astype(float) if n > 1 else np.zeros(n)
    up = np.maximum(parent, 0)
    before = np.concatenate([[0], np.cumsum([len(t) for t in page.text])[:-1]])
    total = max(chars[0], 1.0)
    sibling_chars = (chars[up] - chars) / np.maximum(children[up] - 1, 1)
    has_article = float(any(t in POSITIVE_TAGS for t in page.tag))
    heading = np.array([t in _HEADINGS for t in page.tag], float)
    parent_heading = heading[up]
    x = np.zeros((n, _N_FEATURES))
    code = {t: k for k, t in enumerate(_TAGS)}
    for i, t in enumerate(page.tag):
        if t in code:
            x[i, code[t]] = 1
    columns = [
        heading, parent_heading, np.log1p(chars), linked / np.maximum(chars, 1), chars / np.maximum(nodes, 1), stops / np.maximum(chars, 1), np.log1p(blocks),
        depth, before / total, chars / total, children, children[up], np.log1p(sibling_chars), chars / np.maximum(chars[up], 1),
        words[:, 0], words[:, 1], words[:, 2], above_against, above_for, above_neg, above_pos, above_hidden, neg, pos, np.full(n, has_article),
    ]
    x[:, len(_TAGS) :] = np.stack(columns, 1)
    return x


def decode(page: Page, log_odds: np.ndarray) -> list[str]:
    """Text blocks of the kept set: a node goes with its ancestors, and the sum of log odds is the greatest."""
    best = np.clip(log_odds, -8, 8).tolist()
    best[0] = 0.0
    for i in range(len(best) - 1, 0, -1):
        if best[i] > 0:
            best[page.parent[i]] += best[i]
    kept = [True] * len(best)
    out = []
    for i in range(1, len(best)):
        kept[i] = kept[page.parent[i]] and best[i] > 0
        if kept[i] and page.tag[i] == "#text":
            out.append(page.text[i])
    return out


def _generated(rng: random.Random) -> str:
    """A page; the words of its main text, and no others, end in q."""
    letters = "abcdefghijklmnoprstuvwxyz"

    def words(n: int, main: bool) -> str:
        out = []
        for k in range(n):
            w = "".join(rng.choices(letters, k=rng.choice([1, 2, 2, 3, 4, 5, 6, 8, 11])))
            if main:
                w += "q"
            if rng.random() < 0.12:
                w += rng.choice([".", ",", ".", "!!", "###", "&amp;"])
            out.append(w.capitalize() if k == 0 or rng.random() < 0.05 else w)
        return " ".join(out) + rng.choice([".", "", "."])

    def links(n: int) -> str:
        style = rng.randrange(3)
        each = [f'<a href="/{rng.randrange(999)}">{words(rng.randint(1, 4), False)}</a>' for _ in range(n)]
        return "<ul>" + "".join(f"<li>{x}</li>" for x in each) + "</ul>" if style == 0 else " | ".join(each) if style == 1 else "".join(f"<div>{x}</div>" for x in each)

    def named(tag: str, name: str, body: str) -> str:
        suffix = rng.choice(["", "", "-1", " box", "-wrap", "-inner clearfix"])
        how = rng.choice([f'class="{name}{suffix}"', f'id="{name}{suffix}"', f'class="site {name}"'])
        return f"<{tag} {how}>{body}</{tag}>"

    def small(tag: str) -> str:
        return "".join(f"<{tag}>{words(rng.randint(1, 30), False)}</{tag}>" for _ in range(rng.randint(1, 3)))

    def block(kind: str) -> str:
        plain = rng.random()
        if kind == "nav":
            return f"<nav>{links(rng.randint(3, 9))}</nav>" if plain < 0.6 else named(rng.choice(["div", "ul"]), rng.choice(["menu", "nav", "navbar", "breadcrumbs"]), links(rng.randint(3, 9)))
        if kind == "header":
            body = rng.choice([f"<h1>{words(rng.randint(1, 5), False)}</h1>", "", small("p")]) + rng.choice(["", links(4), words(3, False)])
            return f"<header>{body or words(2, False)}</header>" if plain < 0.6 else named("div", rng.choice(["header", "masthead", "banner"]), body or words(2, False))
        if kind == "footer":
            body = f"&copy; {words(rng.randint(2, 12), False)} &middot; {words(rng.randint(1, 8), False)}" + rng.choice(["", links(3), small("p")])
            return f"<footer>{body}</footer>" if plain < 0.7 else named("div", rng.choice(["footer", "site-footer", "copyright"]), body)
        if kind == "side":
            body = f"<h3>{words(2, False)}</h3>" * rng.randrange(2) + rng.choice([links(5), small("p"), small("div")])
            return f"<aside>{body}</aside>" if plain < 0.5 else named(rng.choice(["div", "section", "aside"]), rng.choice(["sidebar", "related", "widget", "recommended", "trending", "complementary"]), body)
        if kind == "ad":
            return named(rng.choice(["div", "div", "section", "aside", "p"]), rng.choice(["ad", "ads", "advert", "sponsored", "promo", "ad-slot", "banner-ad"]), rng.choice([words(rng.randint(2, 40), False), f"<a href='#'>{words(5, False)}</a>"]) if plain < 0.7 else words(rng.randint(2, 25), False))
        if kind == "notice":
            return named(rng.choice(["div", "section", "p"]), rng.choice(["cookie", "cookie-notice", "consent", "notice", "alert", "gdpr-banner", "popup", "newsletter", "subscribe"]), rng.choice([words(rng.randint(5, 50), False), small("p") if plain < 0.9 else words(9, False)]))
        if kind == "form":
            body = f"<label>{words(2, False)}</label><input name='q'><button>{words(1, False)}</button>" + rng.choice(["", small("p"), f"<p>{words(12, False)}</p>"])
            return f"<form action='/s'>{body}</form>"
        comments = "".join(named(rng.choice(["div", "li", "article"]), rng.choice(["comment", "reply", "comment-body"]), f"<p>{words(rng.randint(3, 60), False)}</p>") for _ in range(rng.randint(1, 6)))
        return named(rng.choice(["section", "div", "ol"]), rng.choice(["comments", "discussion", "comment-list", "responses comments"]), f"<h3>{words(1, False)}</h3>" * rng.randrange(2) + comments)

    def paragraph() -> str:
        n = rng.choice([1, 2, 3, 8, 15, 30, 60, 90, 150])
        r, body = rng.random(), words(n, True)
        if r < 0.08 and n > 3:
            cut = body.split(" ")
            k = rng.randrange(len(cut))
            cut[k] = rng.choice(['<a href="/x">{}</a>', "<b>{}</b>", "<em>{}</em>", "<code>{}</code>"]).format(cut[k])
            body = " ".join(cut)
        if r < 0.65:
            return f"<p>{body}</p>"
        if r < 0.72:
            return f"<p><b>{body}<br>" if rng.random() < 0.5 else f"<p>{body}"
        if r < 0.8:
            return f"<h{rng.randint(2, 4)}>{words(rng.randint(1, 9), True)}</h2>".replace("</h2>", "") + f"<p>{body}</p>" if rng.random() < 0.3 else (lambda k: f"<h{k}>{words(rng.randint(1, 9), True)}</h{k}>")(rng.randint(2, 4))
        if r < 0.86:
            return "<ul>" + "".join(f"<li>{words(rng.randint(1, 15), True)}</li>" for _ in range(rng.randint(2, 6))) + "</ul>"
        if r < 0.9:
            return f"<blockquote><p>{body}</p></blockquote>"
        if r < 0.93:
            return f"<div>{body}</div>"
        if r < 0.96:
            return f"<pre>{words(rng.randint(3, 20), True)}</pre>"
        return "<table>" + "".join("<tr>" + "".join(f"<td>{words(rng.randint(1, 3), True)}</td>" for _ in range(3)) + "</tr>" for _ in range(rng.randint(1, 4))) + "</table>"

    parts = []
    if rng.random() < 0.85:
        parts.append(f"<h1>{words(rng.randint(1, 14), True)}</h1>")
    if rng.random() < 0.93:
        parts += [paragraph() for _ in range(rng.choice([0, 1, 2, 4, 8, 15, 25]))]
    if len(parts) > 2 and rng.random() < 0.3:
        parts.insert(rng.randrange(1, len(parts)), block(rng.choice(["ad", "notice", "side", "form", "ad"])))
    body = "".join(parts)
    shape = rng.random()
    if shape < 0.6:
        main = f"<article>{body}</article>"
    elif shape < 0.7:
        main = f"<main>{body}</main>"
    elif shape < 0.78:
        main = f"<main><article>{body}</article>{block(rng.choice(['comment', 'side']))}</main>"
    else:
        main = named(rng.choice(["div", "section"]), rng.choice(["content", "post", "entry-content", "article-body", "main", "story"]), body)
    kinds = ["nav", "header", "footer", "side", "ad", "notice", "form", "comment"]
    before = [block(k) for k in kinds if rng.random() < {"nav": 0.7, "header": 0.4, "footer": 0.02, "side": 0.15, "ad": 0.5, "notice": 0.25, "form": 0.15, "comment": 0.02}[k]]
    after = [block(k) for k in ("side", "ad", "comment", "nav", "notice", "form", "footer") if rng.random() < {"nav": 0.1, "footer": 0.85, "side": 0.25, "ad": 0.2, "notice": 0.15, "form": 0.15, "comment": 0.35}[k]]
    rng.shuffle(before)
    page = "".join(before) + main + "".join(after)
    if rng.random() < 0.35:
        page = named("div", rng.choice(["wrapper", "container", "page", "outer", "site"]), page)
    end = rng.choice(["</body></html>", "", "</body></html>"])
    return f"<!DOCTYPE html><html><head><title>{words(3, False)}</title><style>p{{margin:0}}</style></head><body>{page}{end}"


@functools.lru_cache(1)
def trained(pages: int = TRAINING_PAGES) -> BoostedTrees:
    """The trees, fitted on generated pages; a node's label is whether its subtree has main text."""
    rng = random.Random(7)
    xs, ys = [], []
    for _ in range(pages):
        page = Page(_generated(rng))
        y = np.array([any(w.rstrip(".,!#&").lower().endswith("q") for w in t.split()) for t in page.text], float)
        for i in range(len(y) - 1, 0, -1):
            if y[i]:
                y[page.parent[i]] = 1
        xs.append(features(page)[1:])
        ys.append(y[1:])
    return fit(np.concatenate(xs), np.concatenate(ys))


def extract_texts(pages: list[str], trees: BoostedTrees) -> list[str]:
    """Main text of each page."""
    parsed = [Page(p) for p in pages]
    if not parsed:
        return []
    x = [features(p) for p in parsed]
    odds = trees.log_odds(np.concatenate(x))
    ends = np.cumsum([len(r) for r in x])
    return ["\n".join(decode(p, odds[e - len(r) : e])) for p, r, e in zip(parsed, x, ends)]


def extract(df: DataFrame, html: str = "html", into: str = "_text") -> DataFrame:
    """df with the main text of ``html`` added as ``into``."""
    rest = [c for c in df.columns if c != into]
    schema = T.StructType([df.schema[c] for c in rest] + [T.StructField(into, T.StringType())])
    sent = df.sparkSession.sparkContext.broadcast(trained())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees = sent.value
        for b in batches:
            pages = as_bytes(b.column(b.schema.get_field_index(html)))
            texts = [t for i, j in chunks(pages, 1 << 20) for t in extract_texts([p.decode("utf-8", "replace") for p in pages[i:j]], trees)]
            yield pa.RecordBatch.from_arrays([b.column(b.schema.get_field_index(c)) for c in rest] + [pa.array(texts, pa.string())], names=schema.names)

    return df.mapInArrow(tidy(run), schema)


def op7_html_extraction(spark, sf_dir):
    out = extract(table(spark, sf_dir, "pages").select("page_id", "url", "html")).drop("html")
    return out.select("page_id", "url", F.col("_text").alias("text"), F.char_length("_text").cast("bigint").alias("n_chars"))
