"""Quality rules: plain counts, and how well public vocabularies fit a text.

Each word is encoded by the public vocabularies on its own. Four figures come of it: code points per token in a piece vocabulary and in a byte-level one, the
share of the pieces that are single bytes because no piece fits, and the entropy of the pieces. A text in the wrong encoding, of symbols or random letters has few
characters a token or many byte tokens; a text that says one thing again and again has little entropy.

What is rejected depends on the language and the script that most letters are in. The bands are set from the figures of all documents of that
language which pass the plain rules: the median and so many times a robust spread (the distance of the quartiles). They lean towards the script's bands as if these spoke for PRIOR documents more,
and these towards the fixed ones below in the same way; so nothing turns on a number of documents, and the first of a language are judged by its script. Texts without a letter are judged by their fixed band alone.
"""

from __future__ import annotations

import base64
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import looked_up, stored, text_of

SYMBOLS = "#*$%&|<>"
SPACES = " \t\n\x0b\x0c\r"
_BYTE_SPACES = bytes.maketrans(b"\t\n\x0b\x0c\r", b"     ")
REPEAT_WINDOW = 8
MEMO = 200_000


@dataclass(frozen=True)
class Band:
    """What is kept: code points a token within limits, at most a share of byte tokens, at least an entropy (bits a token)."""

    least_chars: float
    most_chars: float
    byte_share: float
    entropy: float = 3.0


#: Rejection bands that a script's own lean on. Alphabets have a few characters a token, scripts of syllables and words about one or less; texts
#: without a letter are "none".
BANDS = {
    "latin": Band(1.6, 12.0, 0.25),
    "cyrillic": Band(1.2, 12.0, 0.40),
    "greek": Band(0.8, 12.0, 0.60),
    "arabic": Band(0.6, 12.0, 0.80),
    "hebrew": Band(0.6, 12.0, 0.80),
    "indic": Band(0.4, 12.0, 0.80),
    "cjk": Band(0.4, 8.0, 0.85),
    "other": Band(0.4, 12.0, 0.85),
    "none": Band(1.3, 12.0, 0.25),
}
#: For how many documents a script's band counts in a language's, and a fixed one in a script's; the entropy says something from so many tokens on.
PRIOR = {"lang": 10.0, "script": 100.0}
LEAST_TOKENS = 100
#: Texts of fewer tokens have wider bands, by the root of the ratio.
SCATTER = 200
#: How many spreads a band reaches from the median, and the least width of one, in characters a token, share and bits.
REACH = 10.0
WIDTHS = (0.2, 0.25, 1.0)


#: Code points at which a script's range begins; each lasts to the next.
_STARTS = np.array([0x0, 0x41, 0x5B, 0x61, 0x7B, 0xAA, 0xAB, 0xC0, 0x250, 0x370, 0x400, 0x530, 0x590, 0x600, 0x780, 0x900, 0x1000,
                    0x1E00, 0x1F00, 0x2000, 0x2E80, 0xA000, 0xAC00, 0xD800, 0xF900, 0xFB00, 0xFB1D, 0xFB50, 0xFE00, 0xFE70, 0xFF00, 0x1F000, 0x20000, 0x40000])
_NAMES = ["", "latin", "", "latin", "", "latin", "", "latin", "other", "greek", "cyrillic", "other", "hebrew", "arabic", "other", "indic", "other",
          "latin", "greek", "", "cjk", "other", "cjk", "", "cjk", "latin", "hebrew", "arabic", "", "arabic", "cjk", "", "cjk", "other"]


def script(text: str) -> str:
    """The script of most letters; "none" for a text without one."""
    if text.isascii():
        return "latin" if any(map(str.isalpha, text)) else "none"
    if not any(map(str.isalpha, text)):
        return "none"
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    seen = np.bincount(np.searchsorted(_STARTS, points, "right") - 1, minlength=len(_STARTS))
    totals: dict[str, int] = {}
    for name, n in zip(_NAMES, seen.tolist(), strict=True):
        if name and n:
            totals[name] = totals.get(name, 0) + n
    return max(totals, key=lambda k: (totals[k], k), default="other")


class Vocabularies:
    """A piece vocabulary with byte fallback, whose tokens are looked at, and a byte-level one, whose tokens are counted."""

    def __init__(self, pieces: str, byte_level: str, pattern: str):
        import sentencepiece
        import tiktoken

        self.pieces = sentencepiece.SentencePieceProcessor(model_file=pieces)
        self.byte = np.array([self.pieces.is_byte(i) for i in range(self.pieces.get_piece_size())])
        with open(byte_level, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.level = tiktoken.Encoding("byte level", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.memo: dict[bytes, bytes] = {}
        self.counts: dict[bytes, int] = {}

    def packed(self, words: list[bytes]) -> tuple[bytes, int]:
        """The piece ids of all words, each encoded alone, as unsigned 16-bit numbers; and how many byte-level tokens they have, each after a space."""
        found, counts = list(map(self.memo.get, words)), list(map(self.counts.get, words))
        if None in found:
            new = list({w for w, x in zip(words, found, strict=True) if x is None})
            texts = [w.decode("utf-8", "replace") for w in new]
            made = {w: np.array(ids, "<u2").tobytes() for w, ids in zip(new, self.pieces.encode(texts, num_threads=1), strict=True)}
            own = {w: len(self.level.encode_ordinary(" " + t)) for w, t in zip(new, texts, strict=True)}
            found = [made[w] if x is None else x for w, x in zip(words, found, strict=True)]
            counts = [own[w] if x is None else x for w, x in zip(words, counts, strict=True)]
            if len(self.memo) > MEMO:
                self.memo.clear()
                self.counts.clear()
            short = [w for w in new if len(w) < 64]
            self.memo.update((w, made[w]) for w in short)
            self.counts.update((w, own[w]) for w in short)
        return b"".join(found), sum(counts)


@cache
def vocabularies(pieces: str, byte_level: str, pattern: str) -> Vocabularies:
    return Vocabularies(pieces, byte_level, pattern)


def repeated_words(words: list[bytes], window: int = REPEAT_WINDOW) -> int:
    """How many words are in windows that are found twice or more, the first included."""
    n = len(words) - window + 1
    if n < 2:
        return 0
    h = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
    mixed = np.zeros(n, np.uint64)
    for i in range(window):
        mixed = mixed * np.uint64(0x9E3779B97F4A7C15) + h[i : i + n]
    order = np.argsort(mixed, kind="stable")
    same = mixed[order[1:]] == mixed[order[:-1]]
    if not same.any():
        return 0
    marks = np.zeros(len(words) + 1, np.int64)
    hit = np.zeros(n, bool)
    hit[order[1:][same]] = hit[order[:-1][same]] = True
    at = np.flatnonzero(hit)
    marks[at] += 1
    marks[at + window] -= 1
    return int((np.cumsum(marks) > 0).sum())


def entropy(ids: np.ndarray) -> float:
    """Bits a token."""
    if not len(ids):
        return 0.0
    s = np.sort(ids)
    counts = np.diff(np.r_[np.flatnonzero(np.r_[True, s[1:] != s[:-1]]), len(s)])
    return float(np.log2(len(s)) - (counts * np.log2(counts)).sum() / len(s))


def measure(text: str, vocab: Vocabularies) -> tuple:
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, n_tokens, chars_per_token, level_chars, byte_share, token_entropy, script)"""
    words = text.encode("utf-8", "surrogatepass").translate(_BYTE_SPACES).split()
    lines = [x for x in text.split("\n") if x.strip(SPACES)]
    chars = len(text) - sum(map(text.count, SPACES))
    repeats = repeated_words(words)
    packed, level = vocab.packed(words)
    ids = np.frombuffer(packed, "<u2")
    n = len(ids)
    share = float(vocab.byte[ids].mean()) if n else 0.0
    failed = len(words) < 20 or 100 * repeats > 30 * len(words)
    symbols = sum(map(text.count, SYMBOLS))
    return (
        len(words), chars, symbols, len(lines) - len(set(lines)), repeats, failed, n, chars / n if n else 0.0, chars / level if level else 0.0, share,
        entropy(ids), script(text),
    )


_OUT = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, n_tokens long, chars_per_token double, level_chars double, byte_share double, token_entropy double, script string"


def figures(documents: DataFrame, pieces: str, byte_level: str, pattern: str) -> DataFrame:
    """doc_id, lang (null where there is no such column) and the counts and figures of every document."""
    names = [x.split()[0] for x in _OUT.split(", ")]
    kinds = [pa.int64()] * 5 + [pa.bool_(), pa.int64()] + [pa.float64()] * 4 + [pa.string()]
    kind = documents.schema["doc_id"].dataType.simpleString()
    lang = F.col("lang").cast("string") if "lang" in documents.columns else F.lit(None).cast("string")

    def run(batches):
        vocab = vocabularies(pieces, byte_level, pattern)
        for b in batches:
            rows = [measure(text, vocab) for text in b.column(2).to_pylist()]
            cols = list(zip(*rows, strict=True)) if rows else [[]] * len(names)
            yield pa.RecordBatch.from_arrays([*b.columns[:2], *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], ["doc_id", "lang", *names])

    return documents.select("doc_id", lang.alias("lang"), text_of(documents).alias("_text")).mapInArrow(run, f"doc_id {kind}, lang string, {_OUT}")


#: Figures that bands are for. best_chars is the better of both vocabularies: one that fits the text is enough where nothing else is known.
_FIGURES = ["chars_per_token", "level_chars", "best_chars", "byte_share", "token_entropy"]


def calibrated(found: DataFrame, by: str) -> DataFrame:
    """(by, _n_by, _by) of each language or script: how many of its documents pass the plain rules, and per figure the median (mid), and how far from it figures may be below (down) and above (up)."""

    def band(c: str, width: float) -> Column:
        low, mid, high = (F.percentile_approx(c, q, 10_000) for q in (0.25, 0.5, 0.75))
        reach = F.greatest(REACH * (high - low) / 1.35, F.lit(width))
        return F.struct(mid.alias("mid"), reach.alias("down"), reach.alias("up")).alias(c)

    chars, share, bits = WIDTHS
    bands = [band(c, w) for c, w in zip(_FIGURES, (chars, chars, chars, share, bits), strict=True)]
    passing = found.where(~F.col("base_failed") & F.col(by).isNotNull())
    return passing.groupBy(by).agg(F.count(F.lit(1)).alias(f"_n_{by}"), F.struct(*bands).alias(f"_{by}"))


def _fixed(bands: dict[str, Band], figure: str, part: str) -> Column:
    """The fixed band of the row's script as mid, down and up. Neither vocabulary alone has to fit, and shares and entropies have one side."""
    out = F.lit(None).cast("double")
    for name, b in bands.items():
        mid = 2 * b.least_chars
        told = {
            "chars_per_token": (mid, mid, b.most_chars - mid), "level_chars": (mid, mid, b.most_chars), "best_chars": (mid, b.least_chars, b.most_chars),
            "byte_share": (0.0, 1.0, b.byte_share), "token_entropy": (b.entropy + 2, 2.0, 20.0),
        }[figure]
        out = F.when(F.col("script") == name, told[("mid", "down", "up").index(part)]).otherwise(out)
    return out


def assess(documents: DataFrame, pieces: str, byte_level: str, pattern: str, bands: dict[str, Band] | None = None) -> DataFrame:
    """Per document: doc_id, the plain counts, base_failed, the vocabularies' figures, and kept.

    base_failed: under 20 words, or over 30 % of the words in repeated windows. Kept: not base_failed, and within the band of the document's language and script. A text of few tokens has wider bands. Null text counts as
    empty: no words, not kept; a null lang is none, and the script's band holds. Rows may repeat and lack an id, and equal rows are judged alike, so there are no ties; very long texts are measured whole; other columns are not
    looked at. An empty table gives an empty result.
    """
    found = stored(figures(documents, pieces, byte_level, pattern), "figures").withColumn("best_chars", F.greatest("chars_per_token", "level_chars"))
    joined = found
    for by in ("lang", "script"):
        joined = looked_up(joined, stored(calibrated(found, by), "bands"), by, "left")
    fixed = bands or BANDS

    def limit(figure: str, part: str) -> Column:
        """Of the language, leaning on the script's, which leans on the fixed one."""
        out = _fixed(fixed, figure, part)
        for by in ("script", "lang"):
            n = F.when(F.col("script") == "none", 0).otherwise(F.coalesce(F.col(f"_n_{by}"), F.lit(0)))
            out = (n * F.coalesce(F.col(f"_{by}")[figure][part], F.lit(0.0)) + PRIOR[by] * out) / (n + PRIOR[by])
        return out

    joined = joined.select("*", *[limit(f, p).alias(f"_{f}_{p}") for f in _FIGURES for p in ("mid", "down", "up")])
    # Figures of few tokens scatter more.
    wider = F.sqrt(F.greatest(F.lit(1.0), SCATTER / F.greatest(F.lit(1), F.col("n_tokens"))))
    above = lambda f: F.col(f) >= F.col(f"_{f}_mid") - wider * F.col(f"_{f}_down")
    below = lambda f: F.col(f) <= F.col(f"_{f}_mid") + wider * F.col(f"_{f}_up")
    fits = below("byte_share") & ((F.col("n_tokens") < LEAST_TOKENS) | above("token_entropy"))
    for f in ("chars_per_token", "level_chars", "best_chars"):
        fits &= above(f) & below(f)
    kept = ~F.col("base_failed") & fits
    return joined.select("doc_id", *[x.split()[0] for x in _OUT.split(", ")], kept.alias("kept"))
