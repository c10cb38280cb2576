"""Main text of HTML pages: flat text blocks, classified by a decision tree.

A page is cut at block-level tags into flat blocks. Each block is described by its words and link density, those of
the blocks before and after, and where it stands (below an element of the page's frame; in the article; elsewhere on
a page that has an article; a heading). A small decision tree, trained once per job on the blocks of the labelled
pages below, tells text from the rest.

An element is taken for frame by its tag, class, id or role, but has to stand against the page: one that holds the
page's article, or most of the unlinked words, is a layout and frames nothing. Only navigation, footers, comments
and hidden elements are frame whatever they hold.

Character references are decoded; white space in a block becomes one space, <br> too; blocks are trimmed and joined
by a line feed. Null html is empty; pages without text give an empty text; broken markup is read on as far as it
goes, very long pages are read whole. Every row is read by itself: repeated rows give equal texts, ties of the tree go
to "no text", an empty table gives an empty result. Other columns of pages are not looked at.
"""

from __future__ import annotations

import html as html_lib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import load

_TOKEN = re.compile(
    r"""<!--.*?(?:-->|\Z)
    |<(?P<raw>script|style|title|textarea|iframe)\b[^>]*+(?:>.*?(?:</(?P=raw)\s*>|\Z)|\Z)
    |<(?P<close>/?)(?P<name>[a-z][a-z0-9-]*)(?P<attrs>(?:[^>"']++|"[^"]*"|'[^']*')*+)(?:>|\Z)
    |</?[a-z][^>]*+(?:>|\Z)
    |<[!?][^>]*+(?:>|\Z)""",
    re.S | re.I | re.X,
)
#: A name, and its value if it has one; values are passed over as a whole, so nothing inside them is read as a name.
_ATTR = re.compile(r"""([^\s"'>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>][^\s>]*)))?""")
_WORDED = frozenset("class id role itemprop".split())
_BLOCK = frozenset("address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav noscript object ol optgroup option p pre section select summary svg table tbody td template tfoot th thead tr ul video audio".split())
_VOID = frozenset("hr".split())
#: Closed by the next block, so never on the stack.
_LOOSE = frozenset("p li dt dd td th tr option".split())
_HARD = frozenset("nav footer button select noscript template dialog menu svg object video audio head".split())
_SOFT = frozenset("header form fieldset".split())
_HARD_WORDS = frozenset("comment comments cookie cookies disqus footer menu nav navbar navigation replies reply respond contentinfo".split())
_FRAME_WORDS = frozenset("ad ads adv advert advertisement advertising banner breadcrumb breadcrumbs byline complementary consent copyright header legal login modal newsletter notice notices outbrain pagination popup promo promoted recommended related search share sharing sidebar signup social sponsor sponsored subscribe taboola teaser toolbar widget".split())
_TEXT_WORDS = frozenset("article articlebody content entry main post story".split())
#: Beside these, a word of the frame names a layout rather than an element of the frame.
_LAYOUT_WORDS = frozenset("body container layout page site wrap wrapper".split()) | _TEXT_WORDS
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: What an element says of the blocks below it: nothing, article, or frame that gives way to most evidence, to strong evidence or to none.
_NONE, _ARTICLE, _WEAK, _STRONG, _FIRM = range(5)


def _kind(name: str, attrs: str, in_article: bool) -> int:
    words: set[str] = set()
    for key, *values in _ATTR.findall(attrs):
        key, value = key.lower(), "".join(values).lower()
        if key == "hidden" or (key == "aria-hidden" and value.strip() == "true"):
            return _FIRM
        if key in _WORDED:
            words.update(re.split(r"[^a-z]+", value))
    if name in _HARD:
        return _FIRM
    if name == "aside":
        return _STRONG
    if name in _SOFT and not (name == "header" and in_article):
        return _WEAK
    if name in ("html", "body", "main"):
        return _ARTICLE if name == "main" else _NONE
    if not words & {"no", "has", "with", "without"}:
        if words & _HARD_WORDS:
            return _WEAK if words & {"container", "content", "layout", "page", "site", "wrap", "wrapper"} and not words & {"comment", "comments"} else _FIRM
        framed = words & _FRAME_WORDS
        if in_article or words & _TEXT_WORDS:
            framed -= {"header"}
        if framed:
            return _WEAK if words & _LAYOUT_WORDS or framed == {"widget"} else _STRONG
    return _ARTICLE if name == "article" or words & _TEXT_WORDS else _NONE


class _Frame:
    """An element of the page's frame, with the unlinked words and the articles below it."""

    def __init__(self, kind: int, above: _Frame | None = None):
        self.kind, self.above, self.words, self.articles = kind, above, 0, 0
        self.firm, self.frames = kind == _FIRM or (above is not None and above.firm), False

    def stands(self, words: int, articles: int) -> bool:
        """Does it frame the page, given the unlinked words and the articles outside firm frames? Not if it holds what is left of the page."""
        share, whole = self.words / max(1, words), 0 < self.articles == articles
        if self.kind == _WEAK:
            return not (share > 0.5 or (whole and share > 0.1))
        return self.kind == _FIRM or not ((whole and share > 0.5) or (not articles and share > 0.6))


def blocks_of(page: str) -> list[tuple[str, int, int, int, bool]]:
    """Flat blocks of a page: (text, words, linked words, place, heading); place is 1 below a frame that stands, else 2 in an article, else 0."""
    out: list[tuple] = []
    stack: list[tuple[str, _Frame | None, bool]] = []  # name, innermost frame and whether in an article, above it
    parts: list[str] = []
    every: list[_Frame] = []  # the outer before the inner
    frame: _Frame | None = None
    in_article, loose, heading, links, linked, at = False, _NONE, False, 0, [], 0
    words_outside, articles = 0, 0  # outside firm frames

    def end() -> None:
        nonlocal words_outside
        if parts:
            text = " ".join("".join(parts).split())
            if text:
                words, of_links = len(text.split()), len("".join(linked).split())
                if loose > _ARTICLE:
                    every.append(own := _Frame(_FIRM, frame))
                else:
                    own = frame
                if own:
                    own.words += max(0, words - of_links)
                if not (own and own.firm):
                    words_outside += max(0, words - of_links)
                out.append((text, words, of_links, own, in_article or loose == _ARTICLE, heading))
            parts.clear()
            linked.clear()

    def text(piece: str) -> None:
        piece = html_lib.unescape(piece) if "&" in piece else piece
        parts.append(piece)
        if links:
            linked.append(piece)

    for m in _TOKEN.finditer(page):
        if m.start() > at:
            text(page[at : m.start()])
        at = m.end()
        name = m["name"]
        if name is None:
            continue
        name = name.lower()
        if name == "a":
            links = 0 if m["close"] else 1
            if m["close"]:
                linked.append(" ")
        elif name == "br":
            parts.append(" ")
        elif name in _BLOCK:
            end()
            links = 0
            if m["close"]:
                loose = _NONE
                if name in _HEADINGS:
                    heading = False
                for i in range(len(stack) - 1, -1, -1):
                    if stack[i][0] == name:
                        frame, in_article = stack[i][1:]
                        del stack[i:]
                        break
            elif name in _LOOSE or name in _HEADINGS:
                loose, heading = _kind(name, m["attrs"], in_article), name in _HEADINGS
            elif name not in _VOID:
                kind = _kind(name, m["attrs"], in_article)
                if not m["attrs"].endswith("/"):
                    stack.append((name, frame, in_article))
                    if kind > _ARTICLE:
                        frame = _Frame(kind, frame)
                        every.append(frame)
                    elif kind == _ARTICLE and not (frame and frame.firm):
                        in_article, articles = True, articles + 1
                        if frame:
                            frame.articles += 1
                loose, heading = _NONE, False
    if at < len(page):
        text(page[at:])
    end()
    for f in reversed(every):
        if f.above:
            f.above.words += f.words
            f.above.articles += f.articles
    for f in every:
        f.frames = f.stands(words_outside, articles) or (f.above is not None and f.above.frames)
    return [(t, n, k, 1 if own and own.frames else 2 if inside else 0, h) for t, n, k, own, inside, h in out]


def features(blocks: list[tuple[int, int, int, bool]]) -> np.ndarray:
    """Of blocks (words, linked words, place, heading): words and link density of each, the one before and the one after, framed, in the article, outside of it, heading."""
    if not blocks:
        return np.empty((0, 10))
    words, linked, place, heading = (np.array(x, float) for x in zip(*blocks))
    density = np.minimum(1.0, linked / np.maximum(words, 1))
    before = lambda x: np.concatenate(([0.0], x[:-1]))
    after = lambda x: np.concatenate((x[1:], [0.0]))
    outside = (place == 0) & (place == 2).any()
    return np.stack([words, density, before(words), before(density), after(words), after(density), place == 1, place == 2, outside, heading], axis=1).astype(float)


#: The labelled table: written pages, where {n} stands for n words and [n] for n linked ones; blocks that start with + are text.
LABELLED = (
    "<nav><li>[1]<li>[1]<li>[2]</nav><div class=ad>{9}</div><article><h1>+{8}</h1><p>+{64}<p>+{2}<p>+{117} [3]<p>+{1}</article><footer><p>{12}</footer>",
    "<div>[3]</div><div>[3]</div><div>[2]</div><h1>+{7}</h1><p>+{54} [1]<p>+{80}<p>+{14}<p>+{45} [2]<ul><li>[4]<li>[5]</ul><p>{6} [2]",
    "<header>{1}</header><main><h2>+{6}</h2><p>+{3}<p>+[30]<p>+{18}</main><aside><p>{40}<p>{24} [1]<p>{33}<p>{4}</aside>",
    "<div>[4]</div><div>{2}</div><div class=post><h1>+{9}</h1><p>+{5}<p>+{1}<p>+{66} [4]</div><div>{3}</div><div>{22}</div><div>[6]</div>",
    "<nav>[2]</nav><div id=cookie-notice><p>{60}<p>{45}</div><article><h1>+{11}</h1><p>+{90}<p>+{3} [1]<p>+{35}</article><section class=comments><p>{28}<p>{49} [2]</section>",
    "<p>[2]<h1>+{6}</h1><p>+{38}<p>+{9}<p>+{66}<p>{3}<p>[2]<p>[2]",
    "<main><h1>+{5}</h1><p>+{92} [8]<p>+[2]<p>+{2} [1]<p>+{75}</main><div class=related><p>[10]<p>[9]</div><footer>{16}</footer>",
    "<p>[1]<p>[1]<p>[1]<p>+{42}<p>+{36}<p>+{45} [5]<p>{1} [11]<p>{7}<p>[3]",
    "<form><p>{15}</form><article><h1>+{2}</h1><p>+{1}<p>+{4}<p>+{2}</article><aside>{20}</aside><div>{31}</div><div>{6} [3]</div>",
    "<div>{3}</div><div>[3]</div><div>[4]</div><div>{4}</div><div>[2]</div><div>[5]</div>",
    "<div>[2]</div><p>+{40}<p>+{2}<p>+{50}<p>+{4}<p>+{6}<p>+{43} [1]<p>[3]<p>[3]",
    "<h1>+{5}</h1><p>+{30}<p>+{1}<p>+{72}<h2>+{7}</h2><p>+{55} [3]<p>[2]<p>[4]<p>{2}",
    "<p>+{14}",
    "<div>+{45}</div>",
    "<p>+{12}<p>+{16}<p>+{11}",
    "<div class='page search'><nav>[3]</nav><h1>+{6}</h1><p>+{52}<p>+{31} [2]<div class=sidebar><p>[3]<p>{18}</div></div><footer>[4]</footer>",
    "<form id=f><div>[2]</div><article><h1>+{4}</h1><p>+{25}<p>+{1}<p>+{60}</article><fieldset>{5}</fieldset></form>",
    "<div class=content-sidebar-wrap><article><header><h1>+{7}</h1></header><p>+{33}<p>+{41}<div class=newsletter-signup>{14}</div></article><div class=sidebar><p>{20}<p>[6]</div></div>",
    "<main><h1>+{3}</h1><ul><li>+{4}<li>+{6}<li>+{2}</ul><p>+{19} [2]<blockquote>+{23}</blockquote><table><tr><td>+{2}<td>+{1}</table></main><div role=contentinfo>{9}</div>",
)


def written_page(template: str) -> str:
    """The HTML of a labelled page."""
    words = lambda n: " ".join(["word"] * int(n))
    page = re.sub(r"\[(\d+)\]", lambda m: f"<a href=#>{words(m[1])}</a>", template)
    return re.sub(r"\{(\d+)\}", lambda m: words(m[1]), page)


def fit_tree(x: np.ndarray, y: np.ndarray, depth: int = 7, least: int = 1):
    """A classification tree by Gini impurity: a leaf's class, or (feature, limit, at most, above)."""
    if depth == 0 or len(y) < 2 * least or len(np.unique(y)) == 1:
        return int(2 * y.sum() > len(y))
    best = None
    for f in range(x.shape[1]):
        order = np.argsort(x[:, f], kind="stable")
        v, t = x[order, f], y[order]
        ones, n = np.cumsum(t)[:-1], np.arange(1, len(t))
        p, q = ones / n, (t.sum() - ones) / (len(t) - n)
        cost = n * p * (1 - p) + (len(t) - n) * q * (1 - q)
        cost[(v[1:] == v[:-1]) | (n < least) | (len(t) - n < least)] = np.inf
        i = int(cost.argmin())
        if np.isfinite(cost[i]) and (best is None or cost[i] < best[0] - 1e-12):
            best = (cost[i], f, (v[i] + v[i + 1]) / 2)
    if best is None:
        return int(2 * y.sum() > len(y))
    _, f, limit = best
    low = x[:, f] <= limit
    return (f, limit, fit_tree(x[low], y[low], depth - 1, least), fit_tree(x[~low], y[~low], depth - 1, least))


def classify(tree, x: np.ndarray) -> np.ndarray:
    if not isinstance(tree, tuple):
        return np.full(len(x), bool(tree))
    f, limit, low, high = tree
    return np.where(x[:, f] <= limit, classify(low, x), classify(high, x))


def trained_tree(labelled=LABELLED):
    pages = [blocks_of(written_page(template)) for template in labelled]
    x = np.concatenate([features([b[1:] for b in page]) for page in pages])
    return fit_tree(x, np.array([b[0].startswith("+") for page in pages for b in page], int))


def main_text(page: str, tree) -> str:
    blocks = blocks_of(page)
    keep = classify(tree, features([b[1:] for b in blocks]))
    return "\n".join(b[0] for b, k in zip(blocks, keep) if k)


def extract_text(pages: DataFrame, labelled=LABELLED) -> DataFrame:
    """page_id, url and the main text of pages(page_id, url, html)."""
    tree = trained_tree(labelled)

    def extract(batches):
        for batch in batches:
            texts = [main_text(x, tree) if x else "" for x in batch["html"].to_pylist()]
            yield pa.RecordBatch.from_arrays([batch["page_id"], batch["url"], pa.array(texts, pa.string())], ["page_id", "url", "text"])

    return pages.select(F.col("page_id").cast("long"), "url", "html").mapInArrow(extract, "page_id long, url string, text string")


def op10_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = extract_text(load(spark, sf_dir, "pages"))
    return out.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
