"""Per-document statistics that tell prose from lists, tables, dumps and junk.

A document is cut into stretches: lines that belong together because no blank line lies between them and because they
either all line up with their neighbours or all do not. For every stretch the layout is measured:

* vertical alignment: how much of a line's delimiters, wide gaps, list markers and tree strokes stand in the same order,
  or in the same column, as those of a line before or after it;
* indentation period: the autocorrelation of the lines' indentation;
* length period: the autocorrelation of the lines' lengths.

These speak for lists, tables and records. Word, symbol and punctuation ratios speak for or against running text: words
of ordinary length made of letters, sentences of ordinary length with proper ends, few symbols, no word pairs over and
over. The two sides are weighed against each other for each stretch (``WEIGHTS``), and a document is prose when the
stretches that read as running text make up at least half of its characters. No word list is needed for this; words that
are common in the corpus languages only add to the side of the text.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from codeweft.runtime import spread

#: Common words of the corpus languages. Fixed values.
COMMON = frozenset(
    "the a an and or of to in is are was were be been it its that this these those for on with as by at from not but no which who what when where how has have had do does did can could may might will would shall should must "
    "one all each every both any some into out up than then so if there here only about after before until because since while also more most other such own same too very just over under again they them their we our you your he she his her i my me "
    "der die das den dem des und oder ist sind war waren wird werden wurde nicht kein keine ein eine einen einem einer eines zu zum zur von vom mit auf für im in ins es er sie wir ihr sich auch als an am aus bei nach vor über unter noch nur wenn weil dass aber wie man hat haben hatte kann muss dann danach alle jeder jede jedes mehr "
    "el la los las lo de del que y o u en un una unos unas es son era fue ser está no se por para con su sus al como más pero si cuando porque ya también muy sin sobre este esta estos estas ese esa hay ha han todo todos todas cada le les me mi nos antes después desde hasta entre quien "
    "le les des du et ou où est sont été être ne pas ce cette ces il elle ils elles on nous vous je tu qui dans sur pour par avec sans au aux plus mais comme si leur leurs son sa ses".split()
)

#: What a stretch's signals weigh. Layout on one side, running text on the other; prose where text minus layout is above LIMIT.
WEIGHTS = {"alignment": 1.2, "indent_period": 0.6, "length_period": 0.6, "symbols": 3.0, "repetition": 2.0, "words": 0.5, "rhythm": 0.6, "common": 0.5}
LIMIT = 0.3
#: Share of a line's marks that has to line up with a neighbour's for the line to belong to a layout.
ALIGNED = 0.6

_BULLET = re.compile(r"[ \t]*(?:[-*+•‣◦·–]|\(?\d{1,3}[.)]|\(?[a-zA-Z][.)]|\[[ xX]\])\s+")
_FENCE = re.compile(r"\s*(?:```|~~~)")
# Marks of a line: what is neither letter, digit nor blank, wide gaps and tabs. Quotes, apostrophes, hyphens inside words and full stops at the end are writing.
# The patterns begin with a set of signs, so a scan passes over all others at once, and none can read a text in two ways: time grows with the length only.
_SIGN = r"[^A-Za-z0-9 \n\x0b-\r\x1c-\x1f'\"!?’“”„«»¿¡…](?:(?<=[_,\t])|(?<![\w\s.-])|(?<=\w\.)(?=\w)|(?<=-)(?:(?<![^\W_]-)|(?![^\W_])))"
_MARK, _MARK_OR_GAP = re.compile(_SIGN), re.compile(_SIGN + r"| (?<!  ) ++(?=\S)")
_STOP, _CLOSE = "[.!?…؟।]", r"[\"')\]»”]"
_END = re.compile(rf"[.!?…؟।\"')\]»”。！？](?:(?<=[^\W_]{_STOP}){_STOP}*{_CLOSE}*(?=\s|$)|(?<=[^\W_]{_CLOSE}){_CLOSE}*{_STOP}+{_CLOSE}*(?=\s|$)|(?<=[。！？]))")
_WORD = re.compile(r"[^\W_]+(?:['’-][^\W_]+)*")
_WIDE = re.compile(r"[\u3040-\u30ff\u3400-\u9fff\uac00-\ud7af\u0e00-\u0eff\u1780-\u17ff]")
_UNPUNCTUATED = re.compile(r"[\u0e00-\u0eff\u1780-\u17ff]")  # Thai, Lao and Khmer: a blank ends a clause, nothing else does
#: Vowel signs and accents written as signs of their own; without them a word of such a script is one run of letters.
_COMBINING = {c: None for c in range(0x300, 0x1E000) if unicodedata.category(chr(c)) in ("Mn", "Mc")}
_COMBINING_SIGNS = frozenset(map(chr, _COMBINING))
_LETTERLESS, _SYMBOLLESS, _DIGITLESS = re.compile(r"[\W\d_]+"), re.compile(r"[\w\s]+"), re.compile(r"\D+")
_ASCII, _BEYOND = bytes(range(128)), bytes(range(128, 256))
_NO_LETTER, _NO_SYMBOL, _NO_DIGIT = (bytes(c for c in _ASCII if rx.fullmatch(chr(c))) for rx in (_LETTERLESS, _SYMBOLLESS, _DIGITLESS))
_BLANK = bytes(c for c in _ASCII if chr(c).isspace())
_LOWER_WORDS = "".join(c.lower() if c.isalnum() or c in "'-" else " " for c in map(chr, _ASCII))


def _beyond(text: str) -> str:
    """The signs of a text that are not ASCII."""
    return "" if text.isascii() else text.encode("utf-8", "surrogatepass").translate(None, _ASCII).decode("utf-8", "surrogatepass")


def _left(text: str, without: re.Pattern, ascii_without: bytes) -> int:
    """Number of signs left without those a pattern names; ASCII as bytes, which is several times faster."""
    if text.isascii():
        return len(text.encode("ascii").translate(None, ascii_without))
    return len(text.encode("utf-8", "surrogatepass").translate(None, _BEYOND + ascii_without)) + len(without.sub("", _beyond(text)))


def _solid(text: str) -> int:
    """Number of signs without blanks."""
    return len(text.encode("ascii").translate(None, _BLANK)) if text.isascii() else sum(map(len, text.split()))


def _uncombined(text: str) -> str:
    return text if _COMBINING_SIGNS.isdisjoint(_beyond(text)) else text.translate(_COMBINING)


def _words(text: str) -> list[str]:
    """``_WORD`` over a text in lower case."""
    if not text.isascii():
        return _WORD.findall(text.lower())
    words = text.translate(_LOWER_WORDS).split()
    if "'" in text or "-" in text:
        words = [w for x in words for w in ((x,) if x.isalnum() else _WORD.findall(x))]
    return words


def autocorrelation(x: np.ndarray) -> float:
    """Greatest autocorrelation of a series over lags up to a third of its length; 1 where it does not vary, 0 where it is short."""
    n = len(x)
    if n < 6:
        return 0.0
    x = x - x.mean()
    power = float(x @ x)
    if power <= 1e-9:
        return 1.0
    f = np.fft.rfft(x, 2 * n)
    whole = np.fft.irfft(f * f.conj(), 2 * n)[1 : n // 3 + 1]
    # each lag against the power of the two pieces it compares, so long periods are not at a disadvantage
    return float((whole / (power * (n - np.arange(1, n // 3 + 1)) / n)).max())


@dataclass(slots=True)
class Line:
    text: str
    indent: int
    marks: list[tuple[str, int]]
    bullet: int  # where a list item's text begins; 0 where the line is none


def _line(x: str) -> Line:
    m = _BULLET.match(x)
    indent = len(x) - len(x.lstrip())
    if "  " in x:
        marks = [(" " if (s := k.group())[0] == " " else s, k.end()) for k in _MARK_OR_GAP.finditer(x, indent)]
    else:
        marks = [(k.group(), k.end()) for k in _MARK.finditer(x, indent)]
    return Line(x, indent, marks, m.end() if m else 0)


def _alike(a: Line, b: Line) -> float:
    """Share of the marks of two lines that line up: the same mark at the same place in order, or ending in the same column."""
    if a.bullet and b.bullet and a.indent == b.indent:
        return 1.0
    if not a.marks or not b.marks:
        return 0.0
    x, y = [m for m, _ in a.marks], [m for m, _ in b.marks]
    most = max(len(x), len(y))
    if x == y:
        hit = most
    else:
        hit = 0
        for p, q in zip(x, y):
            if p != q:
                break
            hit += 1
        columns = {c: m for m, c in b.marks}
        hit = max(hit, sum(columns.get(c) == m for m, c in a.marks))
    if most == 1 and hit:
        # one mark in both lines says little, unless it is in the same column or the lines hold little else
        return 1.0 if (a.marks[0][1] == b.marks[0][1] and x != [","]) or max(len(a.text.split()), len(b.text.split())) <= 4 else 0.0
    if hit == most and set(x) <= {","} and most < 3 and a.marks != b.marks:
        return 0.0  # a comma or two in both lines is how sentences go
    return hit / most


def alignment(lines: list[Line]) -> list[float]:
    """For each line the best likeness with one of the two lines before or after it."""
    n = len(lines)
    best = [0.0] * n
    for k in range(n):
        if not lines[k].marks and not lines[k].bullet:
            continue
        for j in (k + 1, k + 2):
            if j < n and (best[k] < 1.0 or best[j] < 1.0):
                v = _alike(lines[k], lines[j])
                if v > best[k]:
                    best[k] = v
                if v > best[j]:
                    best[j] = v
    return best


def text_side(text: str, n_lines: int = 1, w: dict[str, float] = WEIGHTS) -> tuple[float, int]:
    """What words, symbols and punctuation of a stretch say for (positive) or against running text, and its number of words.

    Short lines without sentence ends may be verse, captions or titles: for those only their layout tells.
    """
    text = _uncombined(text)
    tokens = text.split()
    solid = _solid(text)
    if not solid:
        return 0.0, 0
    words = _words(text)
    letters = _left(text, _LETTERLESS, _NO_LETTER)
    wide = len(_WIDE.findall(_beyond(text)))
    n = max(1, len(words), wide // 2)  # scripts without blanks: two signs a word
    length = letters / n
    # words: letters, in tokens of ordinary length
    likely = letters >= 0.65 * solid and 1.5 <= length <= 14 and (wide > 0.3 * solid or solid <= 14 * len(tokens))
    symbols = max(0.0, (solid - letters) / solid - 0.12)
    # rhythm: sentences of ordinary length; a stretch too short for one may do without
    ends = len(_END.findall(text))
    if not ends and wide > 0.3 * solid and len(_UNPUNCTUATED.findall(_beyond(text))) > 0.3 * solid:
        ends = len(tokens)
    if n < 9 or (not ends and n < 6 * n_lines):
        rhythm = 0.6 if ends else 0.0
    else:
        rhythm = 1.0 if ends and 3 <= n / ends <= 48 else -0.5
    repeated = 0.0
    if len(words) >= 16:
        repeated = max(0.0, 0.6 - len(set(zip(words, words[1:]))) / (len(words) - 1))
    common = min(1.0, sum(map(COMMON.__contains__, words)) / len(words) / 0.25) if words else 0.0
    score = w["words"] * (1.0 if likely else -1.0) + w["rhythm"] * rhythm + w["common"] * common - w["symbols"] * symbols - w["repetition"] * repeated
    return score, n


@dataclass(slots=True)
class Stretch:
    kind: str  # text, layout, fence
    lines: list[Line]
    aligned: list[float]


def _stretches(raw: list[str]) -> tuple[list[Stretch], list[Line], list[float]]:
    lines = [_line(x) for x in raw if x.strip()]
    aligned = alignment(lines)
    out: list[Stretch] = []
    fenced, k, fresh = False, 0, True
    for x in raw:
        if not x.strip():
            fresh = True
            continue
        line, own, k = lines[k], aligned[k], k + 1
        if _FENCE.match(x):
            fenced, fresh = not fenced, True
            continue
        kind = "fence" if fenced else "layout" if own >= ALIGNED else "text"
        if fresh or out[-1].kind != kind:
            out.append(Stretch(kind, [], []))
        out[-1].lines.append(line)
        out[-1].aligned.append(own)
        fresh = False
    return out, lines, aligned


def _read(s: Stretch, w: dict[str, float]) -> float:
    """Text minus layout of a stretch."""
    joined = " ".join(x.text[x.bullet :].strip() for x in s.lines)
    n_lines = len(s.lines)
    says, n = text_side(joined, n_lines, w)
    if n_lines == 1:
        # alone on a line what lines up with a neighbour elsewhere is a row only if it does not read as a sentence
        return says - w["alignment"] * s.aligned[0] * (0.5 if n >= 7 else 1.0)
    ended = sum(1 for x in s.lines if x.text.rstrip("\"')]»”").endswith((".", "!", "?", "…", "。", "！", "？")))
    # lines that end sentences are less likely rows
    rows = sum(s.aligned) / n_lines * (1.0 if ended < 0.5 * n_lines else 0.5)
    lengths = np.array([len(x.text) for x in s.lines], float)
    indents = np.array([x.indent for x in s.lines], float)
    length_period = max(0.0, autocorrelation(lengths)) if n / n_lines < 6 else 0.0  # wrapped text has full lines
    indent_period = max(0.0, autocorrelation(indents)) if indents.any() else 0.0
    return says - w["alignment"] * rows - w["length_period"] * length_period - w["indent_period"] * indent_period


STATS = [
    ("n_chars", "int"), ("n_words", "int"), ("n_lines", "int"), ("mean_word_length", "double"), ("symbol_ratio", "double"), ("digit_ratio", "double"), ("punctuated_line_share", "double"),
    ("common_word_share", "double"), ("bullet_line_share", "double"), ("aligned_line_share", "double"), ("alignment", "double"), ("length_autocorrelation", "double"),
    ("indent_autocorrelation", "double"), ("repeated_pair_share", "double"), ("prose_share", "double"), ("is_prose", "boolean"),
]


def prose_share(text: str, weights: dict[str, float] = WEIGHTS) -> float:
    """Share of a text's characters in stretches that read as running text."""
    raw = [x.rstrip() for x in text.replace("\r\n", "\n").replace("\r", "\n").split("\n")]
    solid = _solid(text)
    return _share(_stretches(raw)[0], solid, weights) if solid else 0.0


def _share(stretches: list[Stretch], solid: int, w: dict[str, float]) -> float:
    held = sum(_solid(" ".join([x.text for x in s.lines])) for s in stretches if s.kind != "fence" and _read(s, w) > LIMIT)
    return min(1.0, held / solid)


def statistics(text: str | None, weights: dict[str, float] = WEIGHTS) -> tuple:
    """Values of ``STATS`` for one text. Null and blank texts have zeros and are not prose."""
    text = text or ""
    solid = _solid(text)
    if not solid:
        return (len(text), 0, 0, *[0.0] * 12, False)
    raw = [x.rstrip() for x in text.replace("\r\n", "\n").replace("\r", "\n").split("\n")]
    stretches, lines, aligned = _stretches(raw)
    n, words = len(lines), _words(_uncombined(text))
    share = _share(stretches, solid, weights)
    pairs = len(words) - 1
    indents = np.array([x.indent for x in lines], float)
    return (
        len(text), len(words), n, sum(map(len, words)) / max(1, len(words)), (_left(text, _SYMBOLLESS, _NO_SYMBOL) + text.count("_")) / solid, _left(text, _DIGITLESS, _NO_DIGIT) / solid,
        sum(x.text.rstrip("\"')]").endswith((".", "!", "?", "…", ":", ";")) for x in lines) / n, sum(map(COMMON.__contains__, words)) / max(1, len(words)), sum(x.bullet > 0 for x in lines) / n,
        sum(a >= ALIGNED for a in aligned) / n, sum(aligned) / n, autocorrelation(np.array([len(x.text) for x in lines], float)), autocorrelation(indents) if indents.any() else 0.0,
        1 - len(set(zip(words, words[1:]))) / pairs if pairs > 0 else 0.0, share, share >= 0.5,
    )


VERDICT = STATS[-2:]


def verdict(text: str | None) -> tuple[float, bool]:
    """The last two values of ``statistics``, which need none of the others."""
    share = prose_share(text or "")
    return share, share >= 0.5


def _schema(columns: list[tuple[str, str]]) -> str:
    return "doc_id bigint, " + ", ".join(f"{n} {t}" for n, t in columns)


def _documents(of: Callable[[str | None], tuple], columns: list[tuple[str, str]]) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    kinds = {"int": "int32", "double": "float64", "boolean": bool}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = pd.DataFrame([of(t) for t in b["text"]], columns=[n for n, _ in columns]).astype({n: kinds[t] for n, t in columns})
            out.insert(0, "doc_id", b["doc_id"].to_numpy())
            yield out

    return run


def text_quality(documents: DataFrame) -> DataFrame:
    """One row of statistics per row with a doc_id, from whole texts and without a shuffle.

    Null, empty and blank texts have zero statistics and ``is_prose`` false; repeated rows stay; other columns are ignored.
    """
    return spread(documents.where("doc_id is not null").select("doc_id", "text")).mapInPandas(_documents(statistics, STATS), _schema(STATS))


def prose_verdicts(documents: DataFrame) -> DataFrame:
    """doc_id, prose_share and is_prose of the rows of ``text_quality``, without the statistics that do not decide them."""
    return spread(documents.where("doc_id is not null").select("doc_id", "text")).mapInPandas(_documents(verdict, VERDICT), _schema(VERDICT))
