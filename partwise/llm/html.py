"""Main text of web pages by a tree-structured graphical model.

A page becomes a tree: block elements, and as leaves the runs of text between block borders. Each node has a hidden state,
content or not. Its look (tag, words of class and id; for text: length, share of links, sentence end, parent's tag) gives a node potential,
its parent's state an edge potential, by the kind of node. Sum-product messages go up from the leaves and down from the root, and a run
of text belongs to the article if its marginal of content is over one half. Potentials are smoothed counts over labelled
pages; `labelled_pages` makes those from a seed: random layouts of menus, headers, sidebars, adverts, notices, forms,
comments and articles, whose labels are known. Their number is a parameter.

Defined results: a null page is empty; a page without content gives the empty text; broken markup (unclosed or stray tags, a
cut end) is read as far as it makes sense; any depth and length is read whole, in linear time; repeated rows give
repeated results; further columns are ignored.
"""

from __future__ import annotations

import html as references
import math
import random
import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from partwise.llm.common import column, slices, with_columns

# Elements that begin a block, that never hold text, whose text is never shown, and which of these hold raw text, that
# runs to the end of the page if it isn't closed, or can't hold a block, so that a block ends them.
BLOCKS = set("html body main article section aside nav header footer div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table thead tbody tfoot tr caption form fieldset legend figure figcaption blockquote pre address details summary dialog center menu hgroup label".split())
VOID = set("br hr img input meta link area base col embed source track wbr param".split())
RAW = "script|style|textarea|title|iframe"
ENDED = set("select button svg option optgroup datalist".split())
UNSHOWN = ENDED | set("noscript template object canvas".split())
CLOSES_P = BLOCKS - {"label"}
ITEMS = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table", "tbody", "thead", "tfoot")}
# Words of class and id, by what they tell.
KEYWORDS = {
    "ad": "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner adslot dfp taboola outbrain".split(),
    "nav": "nav navbar navigation menu breadcrumb breadcrumbs pagination pager toc tabs skip".split(),
    "header": "header masthead topbar branding logo".split(),
    "footer": "footer copyright legal imprint colophon".split(),
    "side": "sidebar aside widget related recommended recommendations trending popular rail more".split(),
    "notice": "cookie cookies consent gdpr notice alert newsletter subscribe subscription popup modal overlay paywall toast".split(),
    "comment": "comment comments reply replies disqus discussion respond feedback".split(),
    "share": "share sharing social follow tags tag author-bio".split(),
    "form": "form login signup search register".split(),
    "main": "article content main post entry story body text prose page".split(),
}
WORD_KIND = {w: k for k, each in KEYWORDS.items() for w in each}

TOKEN = re.compile(
    rf"<!--.*?(?:-->|\Z)|<({RAW})\b(?:[^>\"']++|\"[^\"]*\"|'[^']*')*+>.*?(?:</\1\s*>|\Z)"
    r"|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>\"']++|\"[^\"]*\"|'[^']*')*+)>|<[!?/][^>]*>",
    re.S | re.I,
)
NAMES = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
HIDDEN = re.compile(r"\bhidden\b|display\s*:\s*none|aria-hidden\s*=\s*.?true", re.I)
LETTERS = re.compile(r"[a-z]+")


class Tree:
    """Nodes in page order: parent (index), look (a key of node potentials), text (None for elements)."""

    def __init__(self, page: str):
        self.parent, self.look, self.text = [-1], [("root", "")], [None]
        stack, tags, opened = [0], ["root"], Counter()
        run: list[str] = []
        linked = 0
        in_link = False
        unshown: list[str] = []  # open elements whose text isn't shown
        inside = 0  # blocks opened in these

        def flush() -> None:
            nonlocal linked
            if run:
                if body := " ".join(references.unescape("".join(run)).split()):
                    self._add(stack[-1], text_look(body, min(linked, len(body)), tags[-1]), body)
                run.clear()
            linked = 0

        def close() -> None:
            opened[tags.pop()] -= 1
            stack.pop()

        at = 0
        for m in TOKEN.finditer(page):
            if m.start() > at and not unshown:
                run.append(said := page[at : m.start()])
                linked += len(said) if in_link else 0
            at = m.end()
            ends, name, more = m[2], m[3], m[4]
            if name is None:
                continue
            tag = name.lower()
            if tag in UNSHOWN:
                if ends and tag in unshown:
                    del unshown[len(unshown) - 1 - unshown[::-1].index(tag) :]
                elif not ends and not more.endswith("/") and (tag in ENDED or page.find("</" + name, at) >= 0):
                    if unshown and unshown[-1] == tag == "option":
                        continue
                    unshown.append(tag)
                    inside = 0
                    run.append(" ")
                continue
            if unshown:
                if tag not in BLOCKS:
                    continue
                if unshown[-1] in ENDED or ends and not inside:
                    # a block can't stand in these, and the end of a block around them is theirs
                    while unshown and (unshown[-1] in ENDED or ends):
                        unshown.pop()
                if unshown:
                    inside += -1 if ends else 1
                    continue
            if tag not in BLOCKS:
                if tag == "a":
                    in_link = not ends
                elif tag in ("br", "td", "th", "hr"):
                    run.append(" ")
                continue
            flush()
            if ends:
                if opened[tag]:
                    while tags[-1] != tag:
                        close()
                    close()
                continue
            if tags[-1] == "p" and tag in CLOSES_P:
                close()
            if (own := ITEMS.get(tag)) and opened[tag] and tags[-1] not in own:
                while tags[-1] not in own and tags[-1] != tag and opened[tag]:
                    if tags[-1] in ("ul", "ol", "dl", "table"):
                        break
                    close()
                if tags[-1] == tag or tag in ("dt", "dd") and tags[-1] in ("dt", "dd"):
                    close()
            stack.append(self._add(stack[-1], (tag, more.strip() if not more.endswith("/") else more[:-1].strip()), None))
            tags.append(tag)
            opened[tag] += 1
        if at < len(page) and not unshown:
            run.append(page[at:])
            linked += len(page) - at if in_link else 0
        flush()

    def _add(self, parent: int, look: tuple, text: str | None) -> int:
        self.parent.append(parent)
        self.look.append(look)
        self.text.append(text)
        return len(self.parent) - 1


def text_look(text: str, linked: int, tag: str) -> tuple:
    size = len(text)
    return "#text", min(6, int(math.log2(size + 1) / 1.5)), min(3, int(4 * linked / size)), text[-1] in ".!?", tag


def features(look: tuple) -> list[str]:
    if look[0] == "#text":
        _, size, links, sentence, tag = look
        return [f"size {size}", f"links {links}", f"sentence {sentence}", f"in {tag}"]
    tag, more = look
    names = " ".join(a or b or c for a, b, c in NAMES.findall(more)).lower()
    kinds = sorted({WORD_KIND[w] for w in LETTERS.findall(names) if w in WORD_KIND})
    return [f"tag {tag}", *(f"word {k}" for k in kinds), *(["hidden"] if HIDDEN.search(more) else [])]


FLOW = set("p li h1 h2 h3 h4 h5 h6 dt dd tr pre figcaption label legend summary".split())


OUTER = {"root", "html", "body"}


def kind_of(look: tuple, above: tuple) -> int:
    """0: a run of text, 1: an element that holds running text, 2: another element; 3 and 4: the first two right in the body."""
    outer = above[0] in OUTER
    return (3 if outer else 0) if look[0] == "#text" else (4 if outer else 1) if look[0] in FLOW else 2


class Model:
    """Potentials: node[feature] = (not content, content); edge[kind of node][parent's state][child's state]."""

    def __init__(self, pages: list[tuple[str, list[str]]]):
        """pages: markup with the texts of its runs that are content."""
        seen = defaultdict(lambda: [0.5, 0.5])
        states, edges = [1.0, 1.0], [[[1.0, 1.0], [1.0, 1.0]] for _ in range(5)]
        for page, content in pages:
            tree, own = Tree(page), Counter(content)
            state = self._states(tree, own)
            for i in range(1, len(state)):
                states[state[i]] += 1
                edges[kind_of(tree.look[i], tree.look[tree.parent[i]])][state[tree.parent[i]]][state[i]] += 1
                for f in features(tree.look[i]):
                    seen[f][state[i]] += 1
        self.node = {f: (n / states[0], m / states[1]) for f, (n, m) in seen.items()}
        self.edge = [tuple(x / sum(row) for row in each for x in row) for each in edges]
        self.memo: dict[tuple, tuple[float, float]] = {}

    @staticmethod
    def _states(tree: Tree, content: Counter) -> list[int]:
        """A text's state is its label; an element is content if most of the text below it is."""
        n = len(tree.parent)
        inside, all_text, state = [0] * n, [0] * n, [0] * n
        for i in range(n - 1, 0, -1):
            if (t := tree.text[i]) is not None:
                state[i] = int(content[t] > 0)
                inside[i], all_text[i] = len(t) * state[i], len(t)
            elif tree.look[i][0] not in ("html", "body"):
                state[i] = int(2 * inside[i] > all_text[i])
            inside[tree.parent[i]] += inside[i]
            all_text[tree.parent[i]] += all_text[i]
        # what holds anything beside the article isn't the article
        for i in range(n):
            if state[i] and tree.text[i] is None and inside[i] < 0.8 * all_text[i]:
                state[i] = 0
        return state

    def potential(self, look: tuple) -> tuple[float, float]:
        if (p := self.memo.get(look)) is None:
            a = b = 1.0
            for f in features(look):
                x, y = self.node.get(f, (1.0, 1.0))
                a, b = a * x, b * y
            if len(self.memo) > 50_000:
                self.memo.clear()
            p = self.memo[look] = (a / (a + b), b / (a + b))
        return p

    def marginals(self, tree: Tree) -> list[float]:
        """The probability of content of each node."""
        parent, n = tree.parent, len(tree.parent)
        edges = [self.edge[2]] * n
        below0, below1, up0, up1 = [1.0] * n, [1.0] * n, [1.0] * n, [1.0] * n
        below1[0] = 0.0
        for i in range(1, n):
            below0[i], below1[i] = self.potential(tree.look[i])
            edges[i] = self.edge[kind_of(tree.look[i], tree.look[parent[i]])]
        for i in range(n - 1, 0, -1):  # upward: children come after their parents
            a, b = below0[i], below1[i]
            s = a + b
            a, b = a / s, b / s
            below0[i], below1[i] = a, b
            e00, e01, e10, e11 = edges[i]
            x, y = e00 * a + e01 * b, e10 * a + e11 * b
            up0[i], up1[i] = x, y
            p = parent[i]
            x, y = below0[p] * x, below1[p] * y
            s = x + y
            below0[p], below1[p] = x / s, y / s
        out = [0.0] * n
        belief0, belief1 = below0[:], below1[:]
        for i in range(1, n):  # downward: the parent's belief without this child's message
            p = parent[i]
            e00, e01, e10, e11 = edges[i]
            x, y = belief0[p] / up0[i], belief1[p] / up1[i]
            a, b = below0[i] * (x * e00 + y * e10), below1[i] * (x * e01 + y * e11)
            s = a + b
            belief0[i], belief1[i] = a / s, b / s
            out[i] = b / s
        return out

    def main_text(self, page: str | None) -> str:
        tree = Tree(page or "")
        return "\n\n".join(t for t, p in zip(tree.text, self.marginals(tree), strict=True) if t is not None and p > 0.5)


def labelled_pages(pages: int = 400, seed: int = 5) -> list[tuple[str, list[str]]]:
    """Random pages, each with the texts of its runs that are content."""
    rng = random.Random(seed)
    letters = "etaoinshrdlucmfwypvbgk"
    word = lambda: "".join(rng.choice(letters) for _ in range(rng.randint(1, 9)))
    words = lambda a, b: " ".join(word() for _ in range(rng.randint(a, b)))
    sentence = lambda a, b: words(a, b).capitalize() + rng.choice((".", ".", ".", "!", "?", ""))
    attr = lambda kind: f' {rng.choice(("class", "id"))}="{rng.choice(KEYWORDS[kind])}{rng.choice(("", "-box", "-1", " wide"))}"'

    def links(n: int) -> str:
        return "<ul>" + "".join(f'<li><a href="/{word()}">{words(1, 3)}</a></li>' for _ in range(n)) + "</ul>"

    def aside() -> str:
        kind = rng.choice(("ad", "nav", "header", "footer", "side", "notice", "comment", "share", "form"))
        tag = rng.choice({"nav": ("nav", "nav", "div"), "header": ("header", "div"), "footer": ("footer", "footer", "div"), "side": ("aside", "section", "div"), "form": ("form", "div"), "comment": ("section", "div", "ol")}.get(kind, ("div", "div", "aside", "section")))
        own = attr(kind) if tag in ("div", "section", "ol") or rng.random() < 0.5 else ""
        body = {
            "nav": lambda: links(rng.randint(2, 9)),
            "comment": lambda: "".join(f'<{t}{attr("comment")}><p>{sentence(3, 40)}</p></{t}>' for t in [rng.choice(("div", "div", "div", "div", "li", "li", "li", "article"))] for _ in range(rng.randint(1, 6))),
            "form": lambda: f"<label>{words(1, 3)}</label><input><p>{words(1, 5)}</p>",
            "side": lambda: f"<h3>{words(1, 4)}</h3>" + rng.choice((links(4), f"<p>{sentence(4, 30)}</p>")),
            "footer": lambda: rng.choice((f"&copy; {words(2, 9)}", f"<p>{sentence(3, 20)}</p>" + links(3))),
            "header": lambda: rng.choice((f"<h1>{words(1, 3)}</h1>", f'<div{attr("header")}>{words(1, 6)}</div>' + links(3))),
        }.get(kind, lambda: rng.choice((sentence(3, 25), f"<p>{sentence(3, 25)}</p>")))
        return f"<{tag}{own}>{body()}</{tag}>"

    out = []
    for _ in range(pages):
        content: list[str] = []

        def put(tag: str, text: str, content=content) -> str:
            content.append(text)
            end = f"</{tag}>" if rng.random() < 0.8 or tag != "p" else ""
            marked = re.sub(r"^(\w+)", rng.choice((r"\1", r"<b>\1</b>", r"<em>\1</em>", r'<a href="/x">\1</a>')), text)
            return f"<{tag}>{marked}{end}"

        inner = [put("h1", words(1, 10))] if rng.random() < 0.8 else []
        for _ in range(rng.choice((1, 2, rng.randint(1, 14)))):
            pick = rng.random()
            if pick < 0.66:
                inner.append(put("p", sentence(1, rng.choice((4, 30, 120)))))
            elif pick < 0.74:
                inner.append(put(rng.choice(("h2", "h3")), words(1, 7)))
            elif pick < 0.88:
                inner.append("<ul>" + "".join(put("li", sentence(1, 25)) for _ in range(rng.randint(1, 8))) + "</ul>")
            elif pick < 0.92:
                inner.append("<blockquote>" + put("p", sentence(5, 50)) + "</blockquote>")
            elif pick < 0.95:
                kind = rng.choice(("ad", "share", "notice", "side"))
                inner.append(rng.choice((aside(), f"<p{attr(kind)}>{sentence(2, 20)}</p>")))
            else:
                inner.append("<figure>" + put("figcaption", sentence(2, 12)) + "</figure>")
        tag = rng.choice(("article", "article", "article", "main", "div", "section"))
        body = f"<{tag}{attr('main') if tag in ('div', 'section') or rng.random() < 0.4 else ''}>{''.join(inner)}</{tag}>"
        if rng.random() < 0.1:  # the article stands in the body, in nothing of its own
            body = "".join(inner)
        elif rng.random() < 0.3:
            body = f"<div{attr('main') if rng.random() < 0.5 else ''}>{aside()}{body}{aside()}</div>"
        before, after = ("".join(aside() for _ in range(rng.randint(0, 4))) for _ in range(2))
        texts = set(content)
        page = f"<html><body>{before}{body}{after}</body></html>"
        out.append((page, [t for t in Tree(page).text if t in texts]))
    return out


def extract(pages: DataFrame, model: Model | None = None) -> DataFrame:
    """page_id, url, text, n_chars. The model's size doesn't depend on the pages."""
    shared = pages.sparkSession.sparkContext.broadcast((model or Model(labelled_pages())).__dict__)
    kinds = ", ".join(f"{c} {pages.schema[c].dataType.simpleString()}" for c in ("page_id", "url"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Model.__new__(Model)
        own.__dict__.update(shared.value)
        for batch in slices(batches, 512):
            texts = [*map(own.main_text, column(batch, "html"))]
            yield with_columns(batch, ["page_id", "url"], {"text": pa.array(texts, pa.string()), "n_chars": pa.array([*map(len, texts)], pa.int64())})

    return pages.select("page_id", "url", "html").mapInArrow(run, f"{kinds}, text string, n_chars long")
