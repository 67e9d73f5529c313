"""HTML extraction with a tree-structured graphical model.

A page becomes a tree of its block elements; inline elements and line breaks are part of the block's text, and scripts,
styles, the head, forms' controls and the like are left out while parsing. Every node hides a state, article or not.
Node potentials come from tag, class and id words, lengths, link share and place; parent-child potentials from how
often each pair of states meets. Both are counted, with add-one smoothing, on labelled pages, which ``training_pages``
composes by rule from a seed. Messages go up and down the tree (sum-product), and a node's text is kept if its
marginal says article.

Text of a block: character references decoded, white space to one space, trimmed; blocks are joined in page order by
one space.

Defined results: null and empty html, and pages without an article, give an empty text of 0 characters; unclosed tags
end where HTML's rules imply it, an unclosed comment, script or other raw text runs to the end; very long pages are parsed whole, in
linear time; repeated pages give repeated rows; null ids and urls stay; other columns are ignored.
"""

from __future__ import annotations

import html as entities
import math
import random
import re
from collections import defaultdict

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from tidemark.llm.shared import map_arrow, table

# fixed values: kinds of HTML elements
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr math mi mn mo ms mtext mrow msup msub msubsup mfrac msqrt mroot mover munder munderover mstyle mpadded semantics".split())
VOID = frozenset("area base br col embed hr img input link meta mspace param source track wbr".split())
RAW = frozenset("script style title textarea noscript template iframe svg select button head noembed noframes canvas audio video annotation annotation-xml".split())
TO_THE_END = frozenset("script style textarea title iframe noembed noframes".split())
CLOSES_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split())
IMPLIED = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
SCOPES = frozenset("ul ol dl table tbody body article section div main aside nav".split())
CELL_SCOPES = SCOPES - {"div"}
FLOW = frozenset("p h1 h2 h3 h4 h5 h6 li ul ol dl dt dd blockquote pre table tbody tr td th figure figcaption address".split())

#: Weight of the node potentials: a node's features are not independent.
TEMPER = 0.6

_NAME = re.compile(r"[a-zA-Z][^\s/>]*")
_ATTR = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
# HTML's attribute states: a quote opens a value right after '=' only (and if it closes), elsewhere it is part of a name
TAG = re.compile(r"""</?[a-zA-Z][^ \t\n\f\r/>]*+(?:[ \t\n\f\r/]++|(?:=[^ \t\n\f\r/>=]*+|[^ \t\n\f\r/>=]++)(?:[ \t\n\f\r]*+=[ \t\n\f\r]*+(?:"[^"]*+"|'[^']*+'|[^ \t\n\f\r>"'][^ \t\n\f\r>]*+|(?=>)))?+)*+>""")
_WORDS = re.compile(r"[a-z]+")
_END = {t: re.compile(rf"</{t}\b", re.I) for t in RAW}
_BODY = re.compile(r"<body\b", re.I)


class Node:
    __slots__ = ("tag", "words", "parent", "runs", "own", "linked", "chars", "links", "place", "label")

    def __init__(self, tag: str, words: frozenset, parent: int, place: int, label: int | None):
        self.tag, self.words, self.parent, self.place, self.label = tag, words, parent, place, label
        self.runs: list[tuple[int, list[str]]] = []
        self.own = self.linked = self.chars = self.links = 0


def _tag_end(text: str, at: int) -> int:
    """Where the tag that opens at ``at`` closes, beyond any '>' within a quoted value; -1 if nowhere."""
    tag = TAG.match(text, at)
    return tag.end() - 1 if tag else -1


def parse(text: str) -> list[Node]:
    """Block elements in page order; each holds the runs of text directly in it (with their order in the page)."""
    nodes = [Node("#page", frozenset(), -1, 0, None)]
    stack: list[tuple[str, int]] = [("#page", 0)]
    places: dict[str, list[int]] = defaultdict(list)  # where on the stack each tag is open
    link_depth = 0
    pos, turn, size = 0, 0, len(text)
    fresh = True  # the next text begins a run
    unclosed: set[str] = set()  # tags that nothing closes from here on

    def say(piece: str) -> None:
        nonlocal fresh, turn
        if not piece:
            return
        if "&" in piece:
            piece = entities.unescape(piece)
        node = nodes[stack[-1][1]]
        if fresh:
            if not piece.strip():
                return
            node.runs.append((turn, []))
            turn += 1
            fresh = False
        node.runs[-1][1].append(piece)
        n = len(piece)
        node.own += n
        if link_depth:
            node.linked += n

    def cut(k: int) -> None:
        while len(stack) > k:
            places[stack.pop()[0]].pop()

    def innermost(tags) -> int:
        return max((places[t][-1] for t in tags if places[t]), default=0)

    while pos < size:
        at = text.find("<", pos)
        if at < 0:
            say(text[pos:])
            break
        if at > pos:
            say(text[pos:at])
        if text.startswith("<!--", at):
            end = text.find("-->", at + 4)
            pos = size if end < 0 else end + 3
            continue
        closing = text.startswith("/", at + 1)
        name = _NAME.match(text, at + 1 + closing)
        if not name:
            if text.startswith(("<!", "<?", "</"), at):
                end = text.find(">", at)
                pos = size if end < 0 else end + 1
            else:
                say("<")
                pos = at + 1
            continue
        end = _tag_end(text, at)
        if end < 0:
            break
        tag, pos = name[0].lower(), end + 1
        if tag in RAW and not closing:
            if not text.endswith("/", at, end) or tag in ("script", "style"):
                stop = None if tag in unclosed else _END[tag].search(text, pos)
                closed = text.find(">", stop.end()) if stop else -1
                if closed >= 0:
                    pos = closed + 1
                elif tag in TO_THE_END:
                    pos = size
                else:
                    if tag == "head" and tag not in unclosed:
                        body = _BODY.search(text, pos)
                        pos = body.start() if body else pos
                    unclosed.add(tag)
            if tag not in ("noscript", "template"):
                say(" " if not fresh else "")
            continue
        if tag in VOID:
            if tag in ("br", "hr", "img", "input"):
                say(" " if not fresh else "")
            continue
        if tag in INLINE:
            if tag == "a":
                link_depth = max(0, link_depth + (-1 if closing else 1)) if closing else 1
            continue
        fresh = True
        link_depth = 0
        if closing:
            if places[tag]:
                cut(places[tag][-1])
            continue
        if tag in CLOSES_P and stack[-1][0] == "p":
            cut(len(stack) - 1)
        if tag in IMPLIED:
            k = innermost(IMPLIED[tag])
            if k and k > innermost(CELL_SCOPES if tag in ("td", "th", "tr") else SCOPES):
                cut(k)
        if tag in ("html", "body") and places[tag]:
            continue
        inside = text[name.end() : end]
        words, label = frozenset(), None
        if "=" in inside:
            words = frozenset(w for m in _ATTR.finditer(inside) for w in _WORDS.findall((m[2] or m[3] or m[4] or "").lower()))
            if "data-article" in inside:
                label = int('data-article="1"' in inside)
        nodes.append(Node(tag, words, stack[-1][1], at, label))
        places[tag].append(len(stack))
        stack.append((tag, len(nodes) - 1))
    for i in range(len(nodes) - 1, -1, -1):
        x = nodes[i]
        x.chars += x.own
        x.links += x.linked
        if x.parent >= 0:
            nodes[x.parent].chars += x.chars
            nodes[x.parent].links += x.links
    return nodes


def features(x: Node, page_chars: int, page_bytes: int, above: str) -> list[str]:
    share = x.links / x.chars if x.chars else 0
    part = 0 if not page_chars else int(4 * x.chars / page_chars)
    return [
        f"tag {x.tag}",
        f"above {above} {x.tag in FLOW}",
        f"links {0 if not x.links else 1 if share < 0.3 else 2 if share < 0.7 else 3}",
        f"own {min(8, int(math.log2(x.own + 1)))} {x.tag in ('p', 'li', 'td')}",
        f"part {part} {bool(x.own)}",
        f"place {int(5 * x.place / max(1, page_bytes))}",
        *(f"word {w}" for w in x.words),
    ]


class Model:
    """Log potentials; states are 0 (other) and 1 (article)."""

    def __init__(self):
        self.node: dict[str, tuple[float, float]] = {}
        # [parent][child], for children that are sections and for those that are paragraphs and the like
        self.edge = (((0.0, 0.0), (0.0, 0.0)),) * 2
        self.root = (0.0, 0.0)

    def train(self, pages: list[str]) -> Model:
        """Count on pages whose elements bear data-article='0' or '1' (inherited)."""
        seen: dict[str, list[float]] = defaultdict(lambda: [1.0, 1.0])
        edge, state, kinds = [[[1.0, 1.0], [1.0, 1.0]] for _ in range(2)], [1.0, 1.0], defaultdict(set)
        for text in pages:
            nodes = parse(text)
            for i, x in enumerate(nodes):
                if x.label is None:
                    x.label = nodes[x.parent].label if i else 0
                state[x.label] += 1
                if i:
                    edge[x.tag in FLOW][nodes[x.parent].label][x.label] += 1
                for f in features(x, nodes[0].chars, len(text), nodes[x.parent].tag if i else ""):
                    seen[f][x.label] += 1
                    kinds[f.split(" ")[0]].add(f)
        for f, (other, article) in seen.items():
            self.node[f] = (math.log(other / (state[0] + len(kinds[f.split(" ")[0]]))), math.log(article / (state[1] + len(kinds[f.split(" ")[0]]))))
        self.edge = tuple(tuple(tuple(math.log(n / sum(row)) for n in row) for row in kind) for kind in edge)
        self.root = (math.log(0.99), math.log(0.01))
        return self

    def marginals(self, nodes: list[Node], page_bytes: int) -> list[float]:
        """P(article) of every node: messages up, then down."""
        n, page_chars = len(nodes), nodes[0].chars
        own = []
        for i, x in enumerate(nodes):
            a = b = 0.0
            for f in features(x, page_chars, page_bytes, nodes[x.parent].tag if i else ""):
                p = self.node.get(f)
                if p:
                    a += p[0]
                    b += p[1]
            own.append([TEMPER * a, TEMPER * b])
        up = [list(p) for p in own]
        sent = [(0.0, 0.0)] * n
        for i in range(n - 1, 0, -1):
            (e00, e01), (e10, e11) = self.edge[nodes[i].tag in FLOW]
            a, b = up[i]
            m = (_sum(e00 + a, e01 + b), _sum(e10 + a, e11 + b))
            sent[i] = m
            p = up[nodes[i].parent]
            p[0] += m[0]
            p[1] += m[1]
        down = [(0.0, 0.0)] * n
        down[0] = self.root
        out = [0.0] * n
        for i in range(n):
            if i:
                k = nodes[i].parent
                (e00, e01), (e10, e11) = self.edge[nodes[i].tag in FLOW]
                a = down[k][0] + up[k][0] - sent[i][0]
                b = down[k][1] + up[k][1] - sent[i][1]
                down[i] = (_sum(a + e00, b + e10), _sum(a + e01, b + e11))
                top = max(down[i])
                down[i] = (down[i][0] - top, down[i][1] - top)
            z = up[i][0] + down[i][0] - up[i][1] - down[i][1]
            out[i] = 1 / (1 + math.exp(min(700, max(-700, z))))
        return out

    def extract(self, text: str | None) -> str:
        if not text:
            return ""
        nodes = parse(text)
        keep = self.marginals(nodes, len(text))
        runs = sorted(r for x, p in zip(nodes, keep, strict=True) if p >= 0.5 for r in x.runs)
        return " ".join(t for t in (" ".join("".join(pieces).split()) for _, pieces in runs) if t)


def _sum(a: float, b: float) -> float:
    """log(exp(a) + exp(b))"""
    return a + math.log1p(math.exp(b - a)) if a >= b else b + math.log1p(math.exp(a - b))


# fixed values: words that name the parts of pages
OTHER_WORDS = {
    "nav": "nav navbar navigation menu breadcrumb breadcrumbs pagination toc", "header": "header masthead topbar banner logo", "footer": "footer copyright colophon legal",
    "aside": "sidebar side widget related recommended popular trending rail", "ad": "ad ads advert advertisement sponsored promo sponsor adbox", "notice": "cookie consent notice gdpr alert popup modal overlay newsletter subscribe paywall",
    "comments": "comments comment replies respond discussion reviews", "share": "share social sharing tools meta byline tags", "form": "search login signup form contact",
}
ARTICLE_WORDS = "article content post entry main story body text page single prose articlebody maincontent postcontent"


def training_pages(n: int = 400, seed: int = 5) -> list[str]:
    """Labelled pages: parts that pages have, in usual orders and markups, with made-up words."""
    r = random.Random(seed)
    syllables = [a + b for a in "b d f k l m n p r s t v".split() for b in "a e i o u".split()]

    def words(k: int) -> str:
        return " ".join("".join(r.choices(syllables, k=r.choice((1, 2, 2, 3)))) for _ in range(k))

    def sentence(low: int = 4, high: int = 25) -> str:
        return words(r.randint(low, high)).capitalize() + "."

    def attrs(names: str, label: int) -> str:
        kind = r.random()
        name = r.choice(names.split())
        name = f' class="{name}"' if kind < 0.55 else f' id="{name}"' if kind < 0.75 else f' class="{name} {words(1)}"' if kind < 0.85 else ""
        return f'{name} data-article="{label}"'

    def links(k: int) -> str:
        items = [f'<a href="/{words(1)}">{words(r.randint(1, 4))}</a>' for _ in range(k)]
        return "<ul>" + "".join(f"<li>{i}</li>" for i in items) + "</ul>" if r.random() < 0.7 else r.choice((" | ", " ", "")).join(items)

    def other(kind: str) -> str:
        native = {"nav": "nav", "header": "header", "footer": "footer", "aside": "aside", "form": "form"}
        tag = native[kind] if kind in native and r.random() < 0.7 else r.choice(("div", "div", "section", "ul" if kind == "nav" else "div"))
        head = f"<{tag}{attrs(OTHER_WORDS[kind], 0)}>"
        if kind in ("nav", "share"):
            inner = links(r.randint(3, 12))
        elif kind == "header":
            inner = r.choice((f"<h1>{words(2)}</h1>", f"<div>{words(3)}</div>", "")) + links(r.randint(0, 6))
        elif kind == "footer":
            inner = r.choice((f"&copy; {words(2)} &middot; {sentence()}", f"<p>&copy; 2020 {words(4)}</p>" + links(3), sentence() + "\n" + sentence()))
        elif kind == "aside":
            inner = f"<h3>{words(2)}</h3>" + r.choice((links(r.randint(3, 8)), f"<p>{sentence()}</p>"))
        elif kind == "comments":
            inner = f"<h3>{words(2)}</h3>" + "".join(f'<div class="{r.choice(("comment", "reply", "user"))}"><p>{" ".join(sentence() for _ in range(r.randint(1, 4)))}</p></div>' for _ in range(r.randint(1, 6)))
        elif kind == "form":
            inner = f"<p>{words(4)}</p><input name=q><label>{words(2)}</label>"
        else:
            inner = r.choice((sentence(), f"<p>{sentence()}</p>", f"{sentence()} <a href='/x'>{words(2)}</a>", sentence() + "\n" + sentence(2, 6)))
        return head + inner + (f"</{tag}>" if r.random() < 0.97 else "")

    def loose() -> str:
        """Loose text with line breaks, in a box whose name says nothing."""
        name = f' {r.choice(("id", "class"))}="{r.choice(("wrap", "wrapper", "container", "outer", "box", words(1)))}"' if r.random() < 0.8 else ""
        lines = (" ".join(sentence() for _ in range(r.choice((1, 1, 3)))) for _ in range(r.randint(2, 9)))
        return f'<div{name} data-article="1">' + "".join(line + r.choice(("<br>", "<br><br>", "<br/>")) for line in lines) + "</div>"

    def article() -> str:
        tag = r.choice(("article", "article", "article", "main", "div", "section"))
        names = attrs(ARTICLE_WORDS, 1)
        if tag in ("article", "main") and r.random() < 0.6:
            names = ' data-article="1"'
        parts = [f"<h1>{sentence(2, 10)}</h1>"] if r.random() < 0.85 else []
        for _ in range(r.randint(1, 14)):
            kind = r.random()
            text = " ".join(sentence(1, 25) for _ in range(r.choice((1, 1, 2, 4, 8))))
            if kind < 0.72:
                parts.append(f"<p>{text}" + ("</p>" if r.random() < 0.9 else ""))
            elif kind < 0.8:
                parts.append(f"<p><b>{text}<br>")
            elif kind < 0.86:
                parts.append(f"<h2>{words(r.randint(1, 6))}</h2>")
            elif kind < 0.9:
                parts.append("<ul>" + "".join(f"<li>{sentence()}</li>" for _ in range(r.randint(2, 6))) + "</ul>")
            elif kind < 0.93:
                parts.append(f"<blockquote>{text}</blockquote>")
            elif kind < 0.96:
                parts.append(f'<p>{words(5)} <a href="/y">{words(2)}</a> {text}</p>')
            else:
                parts.append(other(r.choice(("ad", "share", "aside", "notice"))))
        if r.random() < 0.12:
            return loose()
        if r.random() < 0.06:  # no element of its own: paragraphs among the other parts
            return "".join(re.sub(r"^<(p|h1|h2|ul|blockquote)>", r'<\1 data-article="1">', p) for p in parts)
        return f"<{tag}{names}>" + r.choice(("", "\n")).join(parts) + f"</{tag}>"

    pages = []
    for _ in range(n):
        before = [other(k) for k in ("header", "nav", "notice", "ad", "share", "form") if r.random() < (0.6 if k == "nav" else 0.4)]
        after = [other(k) for k in ("share", "aside", "ad", "comments", "nav", "notice", "form") if r.random() < 0.35] + [other("footer")] * (r.random() < 0.85)
        if r.random() < 0.2:
            before.append(other("aside"))
        middle = article() if r.random() < 0.96 else ""
        if r.random() < 0.07:  # a page that has nothing else, or hardly anything
            before, middle, after = before[:1] if r.random() < 0.5 else [], loose(), after[-1:] if r.random() < 0.5 else []
        if r.random() < 0.25:
            middle = f'<div data-article="0" class="{r.choice(("container", "wrapper", "row", "layout"))}">{middle}</div>'
        pages.append(f'<!DOCTYPE html><html><head><title>{words(3)}</title></head><body data-article="0">' + r.choice(("", "\n")).join([*before, middle, *after]) + r.choice(("</body></html>", "")))
    return pages


def extract_text(pages: DataFrame, model: Model | None = None) -> DataFrame:
    """page_id, url, text and n_chars of every page; one pass, no shuffle."""
    shared = pages.sparkSession.sparkContext.broadcast(model or Model().train(training_pages()))  # some hundred potentials

    def run(batches):
        model = shared.value
        for batch in batches:
            texts = [model.extract(h.as_py()) for h in batch.column("html")]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    kinds = dict(pages.dtypes)
    return map_arrow(pages.select("page_id", "url", "html"), run, f"page_id {kinds['page_id']}, url string, text string, n_chars long")


def op6_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_text(table(spark, sf_dir, "pages"))


QUERIES = {"op6_extraction": op6_extraction}
