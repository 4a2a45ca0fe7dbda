"""Main text of web pages by maximum-scoring subsequence.

A page is a sequence of words and tags. A word scores the share of such words that are content in
labelled pages, a tag loses by the share of such tags that stand outside of it, so words are
positive and tags negative; one linear scan finds the contiguous region with the largest sum. The
region is widened to whole blocks. Where it starts and ends is the scan's alone; what stands between its blocks
in a menu, notice, advert, form, comment or sidebar is left out.

Words are told apart by the kind of block that holds them, its length, its share of links, and the
element or class name around them that speaks of boilerplate. Such a name is a feature like others: an element that
holds more than half of the page's running words is none, whatever its name. Labelled pages are those that mark one article
(article or main element). These marks only label: they give no tokens and no features. Of the labelled pages a third
counts without its attributes and a third also without telling element names, so that weights do not rest on
names alone. Counts are summed by Spark for a fixed set of features; pages are handled in their own rows.
"""

from __future__ import annotations

import html as entities
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fairlead.llm.common import slices

TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']++|"[^"<]*+"|'[^'<]*+'|["'])*+)>|<[!?][^>]*+(?:>|\Z)|</?[a-zA-Z][^>]*+\Z""", re.S)
NAMES = re.compile(r"""\b(?:class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s>]+)""", re.I)

#: Elements by what they mean for a page's text.
RAW = frozenset("script style noscript template iframe svg math textarea object canvas audio video head".split())
SIDE = {"nav": "nav", "menu": "nav", "footer": "footer", "aside": "aside", "form": "form", "button": "form", "select": "form", "dialog": "notice", "header": "header"}
ARTICLE = frozenset(("article", "main"))
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul".split()
)
#: Words in class, id or role that mark what is not content.
MARKS = {
    "ad": "ad ads advert adverts advertisement advertising banner sponsor sponsored promo promotion".split(),
    "nav": "nav navigation navbar menu breadcrumb breadcrumbs pagination pager toc".split(),
    "aside": "sidebar side aside related recommended recommendations widget share sharing social".split(),
    "notice": "cookie cookies consent notice gdpr popup modal overlay alert disclaimer paywall".split(),
    "comment": "comment comments reply replies respond disqus discussion".split(),
    "form": "form newsletter subscribe subscription signup login search contentinfo".split(),
    "footer": "footer copyright legal colophon".split(),
    "header": "masthead header site-header".split(),
}
MARK_OF = {word: kind for kind, words in MARKS.items() for word in words}
CONTEXTS = ("none", *sorted({*SIDE.values(), *MARKS}))
#: Contexts whose blocks are main text if the region has them; a header can be that of the article.
OPEN_CONTEXTS = frozenset(("none", "header"))
#: What holds a word: the nearest block element, by kind.
HOLDERS = {**{f"h{i}": "h" for i in range(1, 7)}, **dict.fromkeys("p blockquote pre dd dt figcaption".split(), "p"), "li": "li", "td": "cell", "th": "cell"}
KINDS = ("p", "h", "li", "cell", "other")
#: Weights without labelled pages, and how many labelled tokens they count as.
WORD_PRIOR, LINKS_PRIOR, HEADING_PRIOR, TITLE_PRIOR = 0.7, 0.1, 0.5, 0.9
SIDE_PRIOR, TAG_PRIOR, TAG_LOSS, PRIOR_TOKENS = 0.02, 0.6, 3.25, 20
#: What one run of tags and hardly scoring words can cost at most, so that a list within the text does not cut it.
RUN_LOSS = 60.0
TEXT_TAGS, TEXT_TAG_PRIOR = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre figure figcaption other".split()), 0.12


def mark(name: str, attributes: str) -> str | None:
    """The kind of boilerplate that an element's name or its class, id or role speaks of; of a paragraph only
    that it is an advert."""
    if name in ARTICLE:
        return None
    if attributes and name not in ("html", "body"):
        for m in NAMES.finditer(attributes):
            for word in re.split(r"[^a-z0-9]+", m[1].lower()):
                if (kind := MARK_OF.get(word)) and (kind == "ad" or name not in HOLDERS):
                    return kind
    return SIDE.get(name)


class Page:
    """A page's tokens and blocks.

    tokens: (feature, mark, article, is word run, number of words, block); a run of words is one token. Outermost
    article elements are numbered from 1, 0 is outside of them. blocks: their texts in pieces (text, mark).
    contexts: what each mark comes to; mark 0 is none. ``how``: 1 leaves out attributes, 2 also the names of elements
    that tell boilerplate."""

    def __init__(self, page: str, how: int = 0):
        self.tokens: list[tuple[str, int, int, bool, int, int]] = []
        self.blocks: list[list[tuple[str, int]]] = [[]]
        self.marks: list[tuple[str, int]] = [("none", 0)]  # kind, and the mark outside
        self.sizes: list[list[int]] = [[0, 0]]  # words and linked words of each block
        self.running: list[int] = [0]  # words outside of links, by mark
        self.scan(page, how)
        self.contexts = self.settled()
        ends = [f":{int(2 * linked > n)}:{(n > 4) + (n > 20)}" for n, linked in self.sizes]
        self.tokens = [(f"w:{self.contexts[t[1]]}:{t[0]}{ends[t[5]]}", *t[1:]) if t[3] else t for t in self.tokens]

    def settled(self) -> list[str]:
        """The context of each mark: that of the outermost one around it that counts."""
        held = list(self.running)
        for k in range(len(self.marks) - 1, 0, -1):  # inner ones come later
            held[self.marks[k][1]] += held[k]
        out = ["none"]
        for k, (kind, outer) in enumerate(self.marks[1:], 1):
            around = out[outer]
            out.append(around if around not in OPEN_CONTEXTS or 2 * held[k] > held[0] else kind)
        return out

    def scan(self, page: str, how: int) -> None:
        stack: list[tuple[str, int, bool, str, int]] = []  # name; outside: mark, link, holder, article
        now, link, holder, article, articles, at = 0, False, "other", 0, 0, 0
        length, tokens, blocks, sizes = len(page), self.tokens, self.blocks, self.sizes

        def words(a: int, b: int) -> None:
            if a < b:
                text = entities.unescape(page[a:b])
                blocks[-1].append((text, now))
                if n := len(text.split()):
                    sizes[-1][0] += n
                    sizes[-1][1] += n * link
                    self.running[now] += n * (not link)
                    tokens.append((holder, now, article, True, n, len(blocks) - 1))

        while at < length:
            m = TOKEN.search(page, at)
            if m is None:
                words(at, length)
                break
            words(at, m.start())
            at = m.end()
            if m[2] is None:
                continue
            name, closing = m[2].lower(), bool(m[1])
            if how == 2 and name in SIDE and name in BLOCKS:
                name = "div"
            if name in BLOCKS and blocks[-1]:
                blocks.append([])
                sizes.append([0, 0])
            if name == "br":
                blocks[-1].append((" ", now))
            tag = f"t:{name if name in BLOCKS or name == 'a' else 'other'}"
            if closing:
                if name not in ARTICLE:
                    tokens.append((tag, now, article, False, 0, len(blocks) - 1))
                k = next((k for k in range(len(stack) - 1, -1, -1) if stack[k][0] == name), None)
                if k is not None:
                    now, link, holder, article = stack[k][1:]
                    del stack[k:]
                continue
            if name in RAW:
                end = re.compile(rf"</{re.escape(name)}(?=[\s/>])", re.I).search(page, at) if not m[3].endswith("/") else None
                if end:
                    close = page.find(">", end.start())
                    at = length if close < 0 else close + 1
                elif not m[3].endswith("/"):
                    at = length
                continue
            if name not in ARTICLE:
                tokens.append((tag, now, article, False, 0, len(blocks) - 1))
            if name in VOID or m[3].endswith("/") or (name not in BLOCKS and name not in ("a", "span", "button", "select", "label")):
                continue
            if name in ("p", "li") and stack and stack[-1][0] == name:
                now, link, holder, article = stack.pop()[1:]
            stack.append((name, now, link, holder, article))
            link = link or name == "a"
            if kind := mark(name, "" if how else m[3]):
                self.marks.append((kind, now))
                self.running.append(0)
                now = len(self.marks) - 1
            if name in ARTICLE:
                if not article:
                    articles += 1
                    article = articles
            elif name in BLOCKS:
                holder = HOLDERS.get(name, "other")


def counts(pages: DataFrame, html: str = "html") -> dict[str, tuple[int, int]]:
    """For every feature how often it is inside and outside of the article, in pages that mark one.
    Features are a fixed set: words by context, holder, links and length, tags by name."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        inside, outside = Counter(), Counter()
        for batch in batches:
            for page in batch.column(0).to_pylist():
                p = Page(page or "", how=zlib.crc32((page or "").encode("utf-8", "replace")) % 3)
                if {t[2] for t in p.tokens if t[2]} == {1}:
                    for feature, m, article, word, n, _ in p.tokens:
                        (inside if article and p.contexts[m] in OPEN_CONTEXTS else outside)[feature] += n if word else 1
        names = sorted({*inside, *outside})
        if names:
            yield pa.RecordBatch.from_arrays([pa.array(names), pa.array([inside[x] for x in names], pa.int64()), pa.array([outside[x] for x in names], pa.int64())], names=["feature", "inside", "outside"])

    rows = pages.select(html).mapInArrow(run, "feature string, inside long, outside long")
    return {r["feature"]: (r["inside"], r["outside"]) for r in rows.groupBy("feature").agg(F.sum("inside").alias("inside"), F.sum("outside").alias("outside")).collect()}


def weights(found: dict[str, tuple[int, int]]) -> dict[str, float]:
    """What a word of a context earns (0 to 1) and what a tag loses (-TAG_LOSS to 0)."""
    out = {}
    for c in CONTEXTS:
        for kind in KINDS:
            for links in (0, 1):
                prior = SIDE_PRIOR if c != "none" else LINKS_PRIOR if links else WORD_PRIOR
                if kind == "h" and c in OPEN_CONTEXTS and not links:
                    prior = HEADING_PRIOR if c == "header" else TITLE_PRIOR
                for size in (0, 1, 2):
                    a, b = found.get(key := f"w:{c}:{kind}:{links}:{size}", (0, 0))
                    out[key] = (a + prior * PRIOR_TOKENS) / (a + b + PRIOR_TOKENS)
    for name in (*BLOCKS, "a", "other"):
        a, b = found.get(f"t:{name}", (0, 0))
        outside = (b + (TEXT_TAG_PRIOR if name in TEXT_TAGS else TAG_PRIOR) * PRIOR_TOKENS) / (a + b + PRIOR_TOKENS)
        out[f"t:{name}"] = -TAG_LOSS * outside
    return out


def best_region(scores: list[float]) -> tuple[int, int]:
    """The contiguous range with the largest positive sum, the first of equals; (0, 0) if none."""
    best, found, total, start = 0.0, (0, 0), 0.0, 0
    for i, s in enumerate(scores):
        if total <= 0:
            total, start = 0.0, i
        total += s
        if total > best:
            best, found = total, (start, i + 1)
    return found


def bounded(scores: list[float]) -> list[float]:
    """``scores`` with each run of those below one made to cost RUN_LOSS at most."""
    out, start = list(scores), 0
    for i in range(len(scores) + 1):
        if i == len(scores) or scores[i] >= 1:
            total = sum(scores[start:i])
            if total < -RUN_LOSS:
                out[start:i] = [x * RUN_LOSS / -total for x in scores[start:i]]
            start = i + 1
    return out


def main_text(page: str | None, weight: dict[str, float]) -> str:
    """The page's main text: one line for each block; empty if there is none."""
    p = Page(page or "")
    a, b = best_region(bounded([weight[f] * (n if word else 1) for f, _, _, word, n, _ in p.tokens]))
    words = [(k, p.contexts[m] in OPEN_CONTEXTS) for _, m, _, word, _, k in p.tokens[a:b] if word]
    plain = [i for i, (_, open_) in enumerate(words) if open_]
    first, last = (plain[0], plain[-1]) if plain else (len(words), -1)
    inside: dict[int, bool] = {}  # block: whether it stands between blocks of the text, so that only its own text counts
    for i, (k, open_) in enumerate(words):
        if open_ or not first < i < last:
            inside[k] = inside.get(k, True) and (open_ or first < i < last)
    lines = []
    for k in sorted(inside):
        pieces = [t if not inside[k] or p.contexts[m] in OPEN_CONTEXTS else " " for t, m in p.blocks[k]]
        lines.append(" ".join("".join(pieces).split()))
    return "\n".join(x for x in lines if x)


def extract(pages: DataFrame, html: str = "html", out: str = "text", weight: dict[str, float] | None = None) -> DataFrame:
    """``pages`` with column ``out`` (main text) and n_chars in place of the html column.

    Weights are learned from the same pages unless given. Null and empty pages, and pages without
    a region of positive score, give an empty text. A page that is cut off counts as far as it
    goes. Very long pages are scanned once. Repeated rows give repeated results; an empty table stays
    empty. Columns of these names are replaced.
    """
    weight = weight or weights(counts(pages, html))
    rest = [c for c in pages.columns if c not in (html, out, "n_chars")]
    schema = T.StructType([*(pages.schema[c] for c in rest), T.StructField(out, T.StringType()), T.StructField("n_chars", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pages_of = [x or "" for x in batch.column(len(rest)).to_pylist()]
            for a, b in slices(pages_of):
                texts = [main_text(x, weight) for x in pages_of[a:b]]
                part = batch.slice(a, b - a)
                yield pa.RecordBatch.from_arrays([*part.columns[: len(rest)], pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], names=schema.names)

    return pages.select(*rest, html).mapInArrow(run, schema)
