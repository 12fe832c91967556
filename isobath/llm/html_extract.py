"""Main-text extraction: a linear-chain conditional random field over the leaf blocks of a page.

A tolerant reader walks the markup once, keeps a stack of open elements with implied ends, skips
scripts, styles and the like, and yields leaf blocks: the text between two edges of
block elements, with the path of ancestors. Features are ancestor tags, words of their class
and id names, the block's own element, length, link share, punctuation and place. A chain model with two
labels, main and other, is trained by maximum likelihood (forward-backward gradient, L2) on
labelled pages that a seeded generator composes from many layouts, and decoded by Viterbi.

Defined results. A null or empty html, and one without main blocks, give an empty text;
cut-off markup is read as far as it goes; time and memory grow with the length of a page, however deep it nests; repeated rows give equal texts; an empty table gives an
empty result. Character references are decoded, white space in a block becomes one space,
blocks are joined by one line feed; nothing is dropped or capped within a main block. Columns
other than those named are not carried.
"""

from __future__ import annotations

import html as _html
import re
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


from .shared import small_batches

_TOKEN = re.compile(r"""<!--.*?(?:-->|$)|<[!?][^>]*>?|</?[a-zA-Z](?:"[^"]*"|'[^']*'|[^>])*>?|[^<]+|<""", re.S)
_NAME = re.compile(r"</?([a-zA-Z][^\s/>]*)")
_ATTRIBUTE = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
_WORD = re.compile(r"[a-z]+")

INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr ruby rt rp".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea title iframe svg select object noframes head math".split())
CLOSES_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
#: An opening tag ends the nearest of these, if no element of the second set lies between.
IMPLIED = {"li": ("li", {"ul", "ol", "menu"}), "dt": ("dt dd", {"dl"}), "dd": ("dt dd", {"dl"}), "tr": ("tr", {"table"}), "td": ("td th", {"table", "tr"}), "th": ("td th", {"table", "tr"})}
#: Stems of class and id words, each a feature of its own.
STEMS = "nav menu header head masthead footer foot side aside ad ads advert banner sponsor promo notice cookie consent gdpr alert warn comment discuss respon reply form login sign search news subscri share social relat recommend breadcrumb pagin meta byline toc tag widget copyright legal popup modal skip article content main post entry body story text page blog".split()


#: Sections that the feature near tells apart.
SECTIONS = frozenset("article main section aside nav header footer form".split())


@lru_cache(maxsize=4096)
def _marks(attributes: str) -> tuple[str, ...]:
    found = []
    for name, a, b, c in _ATTRIBUTE.findall(attributes):
        for word in _WORD.findall((a or b or c).lower()):
            stem = next((s for s in STEMS if word == s or len(s) > 3 and word.startswith(s)), None)
            if stem or name.lower() == "role":
                found.append("c:" + (stem or word))
    return tuple(dict.fromkeys(found))


class Path:
    """The open elements, and how often each of their features is open; only known features are kept, so that a block costs the same at any depth."""

    def __init__(self, known: frozenset[str] | None):
        self.known, self.names, self.features = known, [], []
        self.depths: dict[str, list[int]] = {}
        self.counts: dict[str, int] = {}
        self.blocks: list[int] = []
        self.sections: list[str] = []
        self.now: frozenset[str] | None = None

    def push(self, tag: str, attributes: str) -> None:
        own: tuple[str, ...] = ()
        if tag not in INLINE:
            own = tuple(f for f in ("t:" + tag, *(_marks(attributes) if "=" in attributes else ())) if self.known is None or f in self.known)
            for f in own:
                self.counts[f] = self.counts.get(f, 0) + 1
            self.blocks.append(len(self.names))
            if tag in SECTIONS:
                self.sections.append(tag)
            self.now = None
        self.depths.setdefault(tag, []).append(len(self.names))
        self.names.append(tag)
        self.features.append(own)

    def cut(self, depth: int) -> None:
        """Close all elements from depth on."""
        for tag, own in zip(self.names[depth:], self.features[depth:], strict=True):
            self.depths[tag].pop()
            if tag not in INLINE:
                for f in own:
                    self.counts[f] -= 1
                    if not self.counts[f]:
                        del self.counts[f]
                self.blocks.pop()
                if tag in SECTIONS:
                    self.sections.pop()
                self.now = None
        del self.names[depth:], self.features[depth:]

    def find(self, tags: tuple[str, ...], stop: frozenset[str] | set[str] = frozenset(), inline: bool = False) -> int:
        """Depth of the innermost open element of tags, -1 if none is open, one of stop lies inside it, or (inline) any block element does."""
        depth = self.innermost(tags)
        if self.innermost(stop) > depth or inline and self.blocks and self.blocks[-1] > depth:
            return -1
        return depth

    def innermost(self, tags: Iterable[str]) -> int:
        return max((own[-1] for t in tags if (own := self.depths.get(t))), default=-1)

    def block(self) -> frozenset[str]:
        """The features of the path that a block of text has here."""
        if self.now is None:
            own = self.names[self.blocks[-1]] if self.blocks else ""
            last = self.features[self.blocks[-1]] if self.blocks else ()
            self.now = frozenset([*self.counts, "own:" + own, "near:" + (self.sections[-1] if self.sections else "none"), *("last" + f for f in last if f[0] == "c")])
        return self.now


def blocks_of(markup: str, known: frozenset[str] | None = None) -> list[tuple[frozenset[str], str, int]]:
    """(features of its path, text, letters in links) of every leaf block with text; of a path's features only known ones, if given."""
    out: list[tuple[frozenset[str], str, int]] = []
    path = Path(known)
    where: frozenset[str] = frozenset()
    parts: list[str] = []
    linked, position, size = 0, 0, len(markup)

    def flush() -> None:
        nonlocal linked
        if parts:
            text = " ".join("".join(parts).split())
            if text:
                out.append((where, text, linked))
            parts.clear()
            linked = 0

    while position < size:
        token = _TOKEN.match(markup, position)
        piece = token[0]
        position = token.end()
        if piece[0] != "<" or piece == "<":
            if not parts:
                if piece.isspace():
                    continue
                where = path.block()
            piece = _html.unescape(piece) if "&" in piece else piece
            parts.append(piece)
            if path.depths.get("a"):
                linked += len(piece)
            continue
        name = _NAME.match(piece)
        if not name:
            continue
        tag = name[1].lower()
        if piece[1] == "/":
            if tag not in INLINE:
                flush()
            depth = path.find((tag,))
            if depth >= 0:
                path.cut(depth)
            continue
        if tag == "br":
            if parts:
                parts.append("\n")
            continue
        if tag in RAW and tag != "head":
            if tag not in ("svg", "math"):
                flush()
            if not piece.endswith("/>"):
                end = _ends(tag).search(markup, position)
                position = end.end() if end else size
            continue
        if tag not in INLINE:
            flush()
            depth = -1
            if tag in CLOSES_P:
                depth = path.find(("p",), inline=True)
            elif tag in IMPLIED:
                ends, stop = IMPLIED[tag]
                depth = path.find(tuple(ends.split()), stop)
            if depth >= 0:
                path.cut(depth)
        if tag not in VOID and not piece.endswith("/>"):
            path.push(tag, piece)
    flush()
    return out


@lru_cache(maxsize=64)
def _ends(tag: str) -> re.Pattern:
    return re.compile(rf"</{tag}\b[^>]*>?", re.I)


def features(block: tuple[frozenset[str], str, int], place: int, count: int) -> tuple[str, ...]:
    path, text, linked = block
    n = text.count(" ") + 1
    share = linked / max(1, len(text))
    return (
        "bias",
        *sorted(path),
        "n:" + ("1" if n < 2 else "3" if n < 4 else "8" if n < 9 else "20" if n < 21 else "more"),
        "links:" + ("0" if share == 0 else "some" if share < 0.5 else "most"),
        "end:" + ("stop" if text[-1] in ".!?:;\"')»”" else "open"),
        "sign" if any(c in text for c in "©®|·»") else "plain",
        "at:" + str(10 * place // max(1, count)),
    )


# ---- labelled pages ---------------------------------------------------------------


def _phrase(rng: np.random.Generator, lo: int, hi: int) -> str:
    vowels, rest = "aeiouéüó", "bcdfglmnprstvß"
    made = ["".join(rest[rng.integers(len(rest))] + vowels[rng.integers(len(vowels))] for _ in range(rng.integers(1, 4))) for _ in range(rng.integers(lo, hi + 1))]
    text = " ".join(made)
    return text.capitalize() + (rng.choice([".", ".", ".", "!", "?", ""]) if hi > 3 else "")


def labelled_page(rng: np.random.Generator) -> tuple[str, list[str]]:
    """A page of a random layout and the texts of its main blocks in order."""
    main: list[str] = []
    pick = lambda *x: x[rng.integers(len(x))]
    phrase = lambda lo, hi: _phrase(rng, lo, hi)

    def links(n: int) -> str:
        return "".join(f'<li><a href="/{k}">{phrase(1, 2)}</a></li>' for k in range(n))

    def other() -> str:
        s, long = phrase(3, 14), f"<p>{phrase(6, 30)}</p>" * int(rng.integers(1, 3))
        kind = pick("ad", "advert", "ads", "banner", "sponsored", "promo", "notice", "cookie-notice", "consent", "alert", "newsletter", "subscribe", "share", "social", "related", "sidebar", "widget", "breadcrumbs", "popup", "login", "toc", "pagination", "recommended", "meta", "legal")
        return pick(
            f'<div class="{kind}">{s}</div>',
            f'<div id="{kind}">{long}</div>',
            f'<section class="box {kind}"><h3>{phrase(1, 4)}</h3>{long}</section>',
            f'<aside><h3>{phrase(1, 3)}</h3>{long}</aside>',
            f'<aside class="{kind}">{s}</aside>',
            f'<form class="{pick("search", "login", "subscribe", "form")}"><label>{phrase(1, 4)}</label><input name="q"><button>{phrase(1, 2)}</button></form>',
            f"<form><p>{s}</p><input></form>",
            f'<ul class="{kind}">{links(int(rng.integers(2, 6)))}</ul>',
            f'<div role="{pick("alert", "complementary", "banner", "search", "dialog")}">{s}</div>',
        )

    def paragraph(text: str) -> str:
        shown = text.replace("&", "&amp;")
        words = shown.split(" ")
        if len(words) > 4 and rng.random() < 0.3:
            words[2] = pick(f"<b>{words[2]}</b>", f'<a href="/x">{words[2]}</a>', f"<em>{words[2]}</em>")
        return " ".join(words)

    def article() -> str:
        out, lists = [], rng.random() < 0.3
        headed = rng.random() < 0.85
        if headed:
            main.append(phrase(1, 10))
            out.append(f"<h1>{main[-1]}</h1>" if rng.random() < 0.8 else f"<header><h1>{main[-1]}</h1></header>")
        for k in range(int(rng.integers(1, 14))):
            roll = rng.random()
            if roll < 0.1:
                main.append(phrase(1, 8))
                out.append(f"<h2>{main[-1]}</h2>")
            elif roll < 0.16 and lists:
                items = [phrase(1, 9) for _ in range(3)]
                main.extend(items)
                out.append("<ul>" + "".join(f"<li>{i}</li>" for i in items) + "</ul>")
            elif roll < 0.2:
                main.append(phrase(5, 30))
                out.append(f"<blockquote>{main[-1]}</blockquote>")
            elif roll < 0.25:
                a, b = phrase(1, 4), phrase(1, 4)
                main.extend([a, b])
                out.append(f"<table><tr><td>{a}</td><td>{b}</td></tr></table>")
            elif roll < 0.34 and k:
                out.append(other())
            elif roll < 0.44:
                main.append(phrase(1, 12))
                out.append(f"<p><b>{main[-1]}<br>")
            else:
                main.append(phrase(1, 60))
                out.append(f"<p>{paragraph(main[-1])}" + ("</p>" if rng.random() < 0.8 else ""))
        return "".join(out)

    def comments() -> str:
        inner = "".join(pick(f'<div class="comment"><p>{phrase(3, 40)}</p></div>', f'<li class="comment"><p>{phrase(3, 40)}</p></li>', f"<p>{phrase(3, 40)}</p>", f'<article class="comment"><p>{phrase(3, 30)}</p></article>') for _ in range(int(rng.integers(1, 5))))
        return pick(f'<section class="comments"><h2>{phrase(1, 3)}</h2>{inner}</section>', f'<div id="comments"><h3>{phrase(1, 3)}</h3>{inner}</div>', f'<ol class="comment-list">{inner}</ol>', f'<div class="discussion">{inner}</div>', f'<section id="respond"><p>{phrase(2, 9)}</p>{inner}</section>')

    top = pick(f"<nav><ul>{links(6)}</ul></nav>", f"<header><h1>{phrase(1, 3)}</h1><p>{phrase(2, 8)}</p><nav>{links(4)}</nav></header>", f'<div id="header"><a href="/">{phrase(1, 2)}</a></div><div class="menu"><ul>{links(5)}</ul></div>', f'<div class="masthead">{phrase(1, 5)}</div>', "")
    body = article()
    wrap = pick("<article>{}</article>", "<article>{}</article>", '<article class="post">{}</article>', "<main>{}</main>", "<main><article>{}</article></main>", '<div class="content">{}</div>', '<div id="main"><div class="entry-content">{}</div></div>', '<section class="story-body">{}</section>', '<div class="post-body">{}</div>')
    inside = comments() if rng.random() < 0.15 else ""
    low = "".join(other() for _ in range(int(rng.integers(0, 3)))) + (comments() if rng.random() < 0.35 else "")
    foot = pick(f"<footer>&copy; {phrase(1, 2)} &middot; {phrase(2, 9)}</footer>", f"<footer><p>{phrase(3, 20)}</p><ul>{links(3)}</ul></footer>", f'<div class="footer">{phrase(2, 12)}</div>', f'<div id="footer"><p>&copy; {phrase(1, 4)}</p></div>', "")
    between = "".join(other() for _ in range(int(rng.integers(0, 3))))
    page = f"<!DOCTYPE html><html><head><title>{phrase(1, 6)}</title><style>p{{}}</style><script>var t='</p>';</script></head><body>{top}<!-- x -->{between}{wrap.format(body + inside)}{low}{foot}</body></html>"
    return page, main


# ---- chain model -------------------------------------------------------------------


def _chain(emission: np.ndarray, steps: np.ndarray, trans: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """Sum of log partition functions, label marginals, expected transition counts. emission: pages x blocks x 2."""
    pages, most, _ = emission.shape
    lse = lambda x, axis: np.logaddexp.reduce(x, axis=axis)
    a, b = np.zeros_like(emission), np.zeros_like(emission)
    a[:, 0] = emission[:, 0]
    for t in range(1, most):
        a[:, t] = lse(a[:, t - 1, :, None] + trans[None], 1) + emission[:, t]
    last = steps - 1
    z = lse(a[np.arange(pages), last], 1)
    for t in range(most - 2, -1, -1):
        on = (t < last)[:, None]
        b[:, t] = np.where(on, lse(trans[None] + (emission[:, t + 1] + b[:, t + 1])[:, None, :], 2), 0)
    inside = np.arange(most)[None] < steps[:, None]
    marginal = np.exp(np.minimum(a + b - z[:, None, None], 0)) * inside[:, :, None]
    pair = np.exp(np.minimum(a[:, :-1, :, None] + trans + (emission[:, 1:] + b[:, 1:])[:, :, None, :] - z[:, None, None, None], 0)) * inside[:, 1:, None, None]
    return float(z.sum()), marginal, pair.sum((0, 1))


@lru_cache(maxsize=2)
def train(pages: int = 500, seed: int = 5, rounds: int = 160, ridge: float = 0.02) -> tuple[dict[str, float], np.ndarray]:
    """Weights (main less other) of all features, and the 2 x 2 transitions (other = 0, main = 1)."""
    rng = np.random.default_rng(seed)
    names: dict[str, int] = {}
    rows, labels, steps = [], [], []
    for _ in range(pages):
        page, main = labelled_page(rng)
        found = blocks_of(page)
        left, own = list(main), []
        for b in found:
            hit = bool(left) and " ".join(left[0].split()) == b[1]
            own.append(int(hit))
            if hit:
                left.pop(0)
        if left or not found:
            continue
        rows.append([[names.setdefault(f, len(names)) for f in features(b, k, len(found))] for k, b in enumerate(found)])
        labels.append(own)
        steps.append(len(found))
    most, n = max(steps), len(rows)
    x = np.zeros((n, most, len(names)), np.float32)
    y = np.zeros((n, most), int)
    for i, (page, own) in enumerate(zip(rows, labels, strict=True)):
        y[i, : len(own)] = own
        for k, ids in enumerate(page):
            x[i, k, ids] = 1
    steps_ = np.array(steps)
    inside = np.arange(most)[None] < steps_[:, None]
    flat = x.reshape(-1, len(names))
    w, trans = np.zeros(len(names)), np.zeros((2, 2))
    seen = np.zeros((2, 2))
    both = inside[:, 1:]
    for i in range(2):
        for j in range(2):
            seen[i, j] = ((y[:, :-1] == i) & (y[:, 1:] == j) & both).sum()
    mw, vw, mt, vt = np.zeros_like(w), np.zeros_like(w), np.zeros_like(trans), np.zeros_like(trans)
    for step in range(1, rounds + 1):
        e = np.zeros((n, most, 2))
        e[:, :, 1] = (flat @ w.astype(np.float32)).reshape(n, most)
        _, marginal, pair = _chain(e, steps_, trans)
        gw = flat.T @ ((y * inside - marginal[:, :, 1]).astype(np.float32).ravel()) / n - ridge * w
        gt = (seen - pair) / n - ridge * trans
        for g, m, v, p in ((gw, mw, vw, w), (gt, mt, vt, trans)):
            m *= 0.9
            m += 0.1 * g
            v *= 0.99
            v += 0.01 * g * g
            p += 0.15 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return {f: float(w[i]) for f, i in names.items()}, trans


def viterbi(scores: list[float], trans: list[list[float]]) -> list[int]:
    """Best labels of one chain; scores are main less other."""
    if not scores:
        return []
    a, b, back = 0.0, scores[0], []
    (t00, t01), (t10, t11) = trans
    for s in scores[1:]:
        from_a, from_b = b + t10 > a + t00, b + t11 > a + t01
        back.append((from_a, from_b))
        a, b = (b + t10 if from_a else a + t00), s + (b + t11 if from_b else a + t01)
    label = int(b > a)
    out = [label]
    for step in reversed(back):
        label = int(step[label])
        out.append(label)
    return out[::-1]


def main_text(markup: str | None, weights: dict[str, float], trans: list[list[float]]) -> str:
    found = blocks_of(markup or "", frozenset(weights))
    n = len(found)
    get = weights.get
    scores = [sum(get(f, 0.0) for f in features(b, k, n)) for k, b in enumerate(found)]
    return "\n".join(b[1] for b, y in zip(found, viterbi(scores, trans), strict=True) if y)


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """id, url, text and n_chars (code points) of every row."""
    weights, trans = train()
    table = trans.tolist()
    picked = small_batches(pages).select(F.col(id_col), F.col(url_col), F.col(html_col).cast("string").alias("_html"))
    schema = T.StructType([picked.schema[id_col], picked.schema[url_col], T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 500):
                part = batch.slice(lo, 500)
                texts = [main_text(h, weights, table) for h in part.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], schema.names)

    return picked.mapInArrow(run, schema)
