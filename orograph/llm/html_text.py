"""Main text of web pages: flat blocks, their neighbours' word counts and link densities, and a trained decision tree.

Markup is cut into blocks at block-level tags. A block's features are its words, the share of them in links, the same of the blocks before and after it,
whether it is a heading or a list item, and what the elements around it say: which landmark is the nearest (one of the article, or one of what
stands beside it), how far the nearest landmark of each kind is, whether the block is within a form, under a heading such as "Comments", or in the narrow
column of a grid. A landmark is an element, a role or a class name or id; what a name says is learnt from labelled names by the words that it is made of.
A classification tree, trained on the labelled pages, decides which blocks are main text.
"""

from __future__ import annotations

import html
import re
from functools import cache, lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_of
from .labelled_pages import CUES, MAIN_NAMES, OPEN_NAMES, PAGES, SIDE_NAMES, STRONG_NAMES

OPEN, MAIN, SIDE, STRONG = 0, 1, 2, 3
#: Elements whose content is no text of the page.
_RAW = "script|style|noscript|template|title|textarea|select|button|iframe|object|svg|math|canvas|audio|video"
_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(?:svg|math)(?=[\s/>])(?:[^<>\"']|\"[^\"]*\"|'[^']*')*/>"
    rf"|<(?P<raw>{_RAW})(?=[\s/>])[^>]*>.*?(?:</(?P=raw)\s*>|\Z)"
    r"""|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*)(?P<rest>(?:[^<>"']|"[^"]*"|'[^']*')*)>|</?[a-zA-Z][^>]*(?:>|\Z)""",
    re.DOTALL | re.IGNORECASE,
)
_BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6"
    " header hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
#: Elements that hold blocks; they are on the stack until they are closed.
_HOLDERS = _BLOCKS - frozenset("p h1 h2 h3 h4 h5 h6 hr html body tr tbody thead tfoot pre caption".split())
#: Items end where the next of their kind begins, unless a list or table was opened in between.
_ITEMS = {"li": 1, "dt": 2, "dd": 2, "td": 3, "th": 3, "tr": 3}
_LISTS = frozenset("ul ol menu dir dl table".split())
#: Landmarks among elements and roles. A form is none: whole pages may be one.
_ELEMENTS = {"article": MAIN, "main": MAIN, "nav": STRONG, "footer": STRONG, "aside": SIDE, "dialog": STRONG, "menu": STRONG, "header": SIDE}
_ROLES = {"main": MAIN, "article": MAIN} | dict.fromkeys("navigation banner contentinfo complementary search dialog alertdialog menu menubar toolbar alert form".split(), SIDE)
_NAMED = re.compile(r"""(?:^|\s)(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.IGNORECASE)
_HIDDEN = re.compile(r"""(?:^|\s)hidden(?=[\s=/]|$)|display\s*:\s*none|aria-hidden\s*=\s*["']?true""", re.IGNORECASE)
#: A tag that closes itself; the slash of an unquoted value is none.
_EMPTY = re.compile(r"""(?:^|[\s"'])/$""")
_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
#: Columns of grids by their twelfths, as in col-md-4, span4 or large-4.
_COLUMN = re.compile(r"(?:^|\s)(?:col|span|large|medium|grid|lg|md)(?:-(?:xs|sm|md|lg|xl|xxl))?[-_]?(1[0-2]|[1-9])(?=\s|$)")
_LETTERS = re.compile(r"[^\W\d_]+")
#: How far a landmark can be, in landmarks and holders, before it counts as none.
FAR = 9


def _name_features(name: str) -> tuple[list[str], list[str]]:
    """The words that a class name or id is made of, and which are its first and last ones."""
    parts = [p.lower() for p in _PART.findall(name)]
    return parts, [f"^{parts[0]}", f"{parts[-1]}$"] if parts else []


@cache
def name_weights() -> tuple[dict[str, int], np.ndarray]:
    """A softmax regression over the words of labelled names: a row of weights for each word, by kind; the last row is that of no word.

    Each name is learnt as it is and as a part of a longer one, without its ends.
    """
    rows, kinds = [], []
    for kind, names in ((OPEN, OPEN_NAMES), (MAIN, MAIN_NAMES), (SIDE, SIDE_NAMES), (STRONG, STRONG_NAMES)):
        for name in names:
            parts, (first, last) = _name_features(name)
            for ends in ([first, last], [first], [last], []):
                rows.append({*parts, *ends})
                kinds.append(kind)
    rows += [set()] * 40
    kinds += [OPEN] * 40
    index = {w: i for i, w in enumerate(sorted(set().union(*rows)))}
    x = np.zeros((len(rows), len(index) + 1))
    for i, r in enumerate(rows):
        x[i, [index[w] for w in r]] = 1
    x[:, -1] = 1
    y = np.eye(4)[kinds]
    w = np.zeros((x.shape[1], 4))
    for _ in range(600):
        e = np.exp(x @ w - (x @ w).max(axis=1, keepdims=True))
        w -= 4.0 * (x.T @ (e / e.sum(axis=1, keepdims=True) - y) / len(x) + 1e-5 * w)
    return index, w


@lru_cache(1 << 16)
def name_kind(name: str) -> int:
    """What a class name or id says: OPEN unless another kind is likelier than all others together."""
    index, w = name_weights()
    parts, ends = _name_features(name)
    known = [index[f] for f in {*parts, *ends} if f in index]
    if not known:
        return OPEN
    z = w[known].sum(axis=0) + w[-1]
    e = np.exp(z - z.max())
    best = int(e.argmax())
    return best if 2 * e[best] > e.sum() else OPEN


def is_cue(text: str) -> bool:
    """Whether a short text is one of the phrases that head comments, adverts, related articles and the like; numbers and marks don't count."""
    return len(text) <= 60 and " ".join(_LETTERS.findall(text.lower())) in CUES


def landmark(tag: str, rest: str) -> tuple[int, int]:
    """What an element says of its content, MAIN, SIDE, STRONG (beside the article for sure, such as a menu, comments or hidden parts) or OPEN, and the
    width of a grid's column, 0 if it is none.

    Names that say MAIN win over those that say SIDE, as in "content has-sidebar".
    """
    kind = _ELEMENTS.get(tag, OPEN)
    if not rest or ("=" not in rest and "hidden" not in rest):
        return kind, 0
    if _HIDDEN.search(rest):
        return STRONG, 0
    said = set()
    width = 0
    for m in _NAMED.finditer(rest):
        names = html.unescape(m[2] or m[3] or m[4] or "")
        if m[1].lower() == "role":
            said |= {_ROLES.get(n, OPEN) for n in names.lower().split()}
        else:
            said |= {name_kind(n) for n in names.split()}
            width = max([width, *(int(n) for n in _COLUMN.findall(names.lower()))])
    if MAIN in said and kind in (OPEN, MAIN):
        return MAIN, width
    if STRONG in said:
        return STRONG, width
    if kind == OPEN and SIDE in said:
        return SIDE, width
    return STRONG if SIDE in said else kind, width


def _links(tokens: list[re.Match]) -> set[int]:
    """Where links start: anchors that lead somewhere and are closed before the next begins."""
    at, found = None, set()
    for m in tokens:
        if (m["tag"] or "").lower() == "a":
            if not m["end"]:
                at = m.start() if not m["rest"].strip() or "href" in m["rest"].lower() else None
            elif at is not None:
                found.add(at)
                at = None
    return found


def blocks(page: str) -> list[tuple]:
    """(text, words, linked words, is heading, is list item, nearest landmark, steps to a MAIN one, steps to a SIDE or STRONG one, form, in a STRONG one,
    column, cue) of each block with a word, in page order. form: 2 within a form of the article, 1 within one that may hold the whole page. column: the
    width of the nearest column of a grid, 0 for none. cue: the block is a phrase that heads what stands beside an article, or comes under such a heading.

    Character references are decoded, white space becomes one space. Unclosed comments, scripts and the like last to the end. End tags without a
    start are passed over. Links may hold blocks; an anchor that isn't closed is none.
    """
    out: list[tuple] = []
    tokens = list(_TOKEN.finditer(page))
    links = _links(tokens)
    #: Open holders: tag, where the innermost open item of the innermost list stands and its kind, and what is said of their content.
    stack: list[tuple[str, int, int, tuple]] = []
    #: The level of the heading with a cue that was last met directly in a holder, by depth, or 0, and after how many blocks.
    cues = [(0, 0)]
    under = 0
    open_tags: dict[str, int] = {}
    parts: list[str] = []
    linked = link = heading = item = 0
    outside = (OPEN, FAR, FAR, 0, 0, 0)
    own: tuple | None = None  # what a block's own tag says

    def within(tag: str, rest: str) -> tuple:
        near, main, side, form, strong, column = stack[-1][3] if stack else outside
        kind, width = landmark(tag, rest)
        if tag == "form":
            form = 1 if main == FAR else 2
        if kind == OPEN:
            return near, main, side, form, strong, width or column
        return kind, 0 if kind == MAIN else min(FAR, main + 1), 0 if kind != MAIN else min(FAR, side + 1), form, int(strong or kind == STRONG), width or column

    def note(level: int) -> None:
        nonlocal under
        under += (level > 0) - (cues[-1][0] > 0)
        cues[-1] = (level, len(out))

    def close() -> None:
        nonlocal linked
        if parts:
            words = html.unescape("".join(parts)).split()
            if words:
                text = " ".join(words)
                cue = is_cue(text)
                if heading > 1 and cue:
                    note(heading)
                elif heading and cues[-1][0] >= heading:
                    note(0)
                out.append((text, len(words), min(linked, len(words)), int(heading > 0), item, *(own or (stack[-1][3] if stack else outside)), int(cue or under > 0)))
                if heading > 1 and cue:
                    note(heading)
            parts.clear()
        linked = 0

    def pop() -> str:
        gone = stack.pop()[0]
        open_tags[gone] -= 1
        level, since = cues[-1]
        note(0)
        cues.pop()
        # A header of its own that holds nothing but the heading speaks for what follows it.
        if level and gone == "header" and since == len(out):
            note(level)
        return gone

    at = 0
    for m in tokens:
        if m.start() > at:
            run = page[at : m.start()]
            parts.append(run)
            if link:
                linked += len(run.split())
        at = m.end()
        tag = m["tag"]
        if tag is None:
            continue
        tag = tag.lower()
        if tag == "a":
            link = int(m.start() in links)
        elif tag == "br":
            parts.append(" ")
        elif tag in _BLOCKS:
            close()
            heading = item = 0
            own = None
            if m["end"]:
                if open_tags.get(tag):
                    while pop() != tag:
                        pass
                continue
            if tag in ("html", "body"):
                continue
            group = _ITEMS.get(tag, 0)
            if group and stack and stack[-1][2] == group:
                for _ in range(len(stack) - stack[-1][1]):
                    pop()
            said = within(tag, m["rest"])
            item = int(0 < group and tag != "tr")
            if tag in _HOLDERS:
                if not _EMPTY.search(m["rest"]):
                    place, kind = (len(stack), group) if group else (-1, 0) if tag in _LISTS or not stack else stack[-1][1:3]
                    stack.append((tag, place, kind, said))
                    cues.append((0, 0))
                    open_tags[tag] = open_tags.get(tag, 0) + 1
            else:
                own = said
                heading = int(tag[1]) if tag[0] == "h" and tag[1:].isdigit() else 0
    if at < len(page):
        parts.append(page[at:])
    close()
    return out


FEATURES = (
    "heading", "item", "landmark", "to_main", "to_side", "form", "strong", "narrow", "cue", "words", "links", "words_before", "links_before", "words_after", "links_after",
    "page_main",
)
#: In twelfths of a row: a column is narrow up to the one, on pages that have one from the other on.
NARROW, WIDE = 4, 7


def features(found: list[tuple]) -> np.ndarray:
    """A row for each block; page_main is 1 on pages that have a MAIN landmark with words in it. A narrow column without a landmark counts as one beside."""
    n = len(found)
    x = np.zeros((n + 2, 2))
    rows = np.array([b[1:] for b in found], float).reshape(n, 11)
    x[1:-1, 0], x[1:-1, 1] = rows[:, 0], rows[:, 1] / np.maximum(rows[:, 0], 1)
    some = np.full((n, 1), float((rows[:, 4] == MAIN).any()))
    narrow = (rows[:, 9] > 0) & (rows[:, 9] <= NARROW) & (rows[:, 9].max(initial=0) >= WIDE)
    beside = narrow & (rows[:, 4] == OPEN)
    rows[beside, 4], rows[beside, 6] = SIDE, 0
    return np.column_stack([rows[:, 2], rows[:, 3], rows[:, 4:9], narrow, rows[:, 10], x[1:-1], x[:-2], x[2:], some])


class Tree:
    """A classification tree by Gini impurity. Nodes are (feature, limit, at most, above), leaves a class."""

    def __init__(self, x: np.ndarray, y: np.ndarray, depth: int = 12, least: int = 1):
        self.root = self._grow(x, y, depth, least)

    def _grow(self, x, y, depth, least):
        share = float(y.mean())
        if depth == 0 or share in (0.0, 1.0):
            return int(share >= 0.5)
        best = (0.0, None, None)
        for f in range(x.shape[1]):
            order = np.argsort(x[:, f], kind="stable")
            v, ones = x[order, f], np.cumsum(y[order])
            k = np.flatnonzero(v[:-1] < v[1:])
            if not len(k):
                continue
            a, b = k + 1, len(y) - k - 1
            p, q = ones[k] / a, (ones[-1] - ones[k]) / b
            gain = share * (1 - share) - (a * p * (1 - p) + b * q * (1 - q)) / len(y)
            gain[np.minimum(a, b) < least] = 0
            i = int(gain.argmax())
            if gain[i] > best[0] + 1e-12:
                best = (float(gain[i]), f, (v[k[i]] + v[k[i] + 1]) / 2)
        _, f, limit = best
        if f is None:
            return int(share >= 0.5)
        low = x[:, f] <= limit
        return (f, limit, self._grow(x[low], y[low], depth - 1, least), self._grow(x[~low], y[~low], depth - 1, least))

    def predict(self, x: np.ndarray) -> np.ndarray:
        out = np.zeros(len(x), bool)

        def go(node, rows):
            if not len(rows):
                return
            if not isinstance(node, tuple):
                out[rows] = bool(node)
                return
            low = x[rows, node[0]] <= node[1]
            go(node[2], rows[low])
            go(node[3], rows[~low])

        go(self.root, np.arange(len(x)))
        return out


_MARK = re.compile(r"(?<=[>\s])([+-])(\d+)")


def labelled(page: str, rng: np.random.Generator | None = None) -> tuple[str, list[bool]]:
    """A labelled page as markup and its blocks' labels, in order: +9 stands for nine words of main text, -9 for nine others.

    With a generator the numbers of words vary by up to a third.
    """
    marks: list[bool] = []

    def fill(m: re.Match) -> str:
        n = int(m[2])
        if rng is not None:
            n = max(1, round(n * float(rng.uniform(0.67, 1.33))))
        return f"{'yes' if m[1] == '+' else 'no'} " + "word " * (n - 1)

    text = _MARK.sub(fill, page)
    marks = [b[0].startswith("yes") for b in blocks(text)]
    return text, marks


@cache
def tree(leave_out: int | None = None, variations: int = 6) -> Tree:
    """Trained on all labelled pages, or all but every fifth from ``leave_out`` on (to measure it on those)."""
    x, y = [], []
    rng = np.random.default_rng(5)
    for i, page in enumerate(PAGES):
        if leave_out is not None and i % 5 == leave_out:
            continue
        for k in range(variations):
            text, marks = labelled(page, rng if k else None)
            x.append(features(blocks(text)))
            y += marks
    return Tree(np.concatenate(x), np.array(y, float))


def main_text(page: str) -> str:
    found = blocks(page)
    if not found:
        return ""
    keep = tree().predict(features(found))
    return "\n".join(b[0] for b, k in zip(found, keep, strict=True) if k)


def extract(pages: DataFrame) -> DataFrame:
    """Per page: page_id, url, text (main blocks joined by line feeds, empty if there are none) and n_chars, its code points.

    Null html counts as empty, pages of any length are read whole. Rows may repeat, alike or under one id, and are each looked at alone; null ids and urls stay null. Other columns are not looked
    at. Nesting may be as deep as the page is long. An empty table gives an empty result.
    """
    kind = pages.schema["page_id"].dataType.simpleString()

    def run(batches):
        for b in batches:
            texts = [main_text(x) for x in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())],
                ["page_id", "url", "text", "n_chars"],
            )

    rows = pages.select("page_id", F.col("url").cast("string").alias("url"), text_of(pages, "html").alias("html"))
    return rows.mapInArrow(run, f"page_id {kind}, url string, text string, n_chars long")
