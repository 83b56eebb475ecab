"""PII: offset-preserving deobfuscation.

Base spans are what the four patterns find in a text as it stands. For disguised identifiers, transducers
rewrite a text piece by piece: invisible characters vanish, homoglyphs and compatibility forms become ASCII,
spelled digits (four languages) become digits, letters between digits become the digits they resemble, and
at/dot disguises become ``@`` and ``.``. Every piece remembers its source range. The patterns run over the
rewritten text, and a span found there that covers a rewritten piece is mapped back to source characters and
added unless a base span of its kind holds it already. Base spans always stay.

Offsets are code points, ends exclusive. A null or empty text has no spans. Rows are handled one by one:
repeated rows and extra columns change nothing, an empty table gives an empty result. All scans take time in
proportion to the text, whatever it holds.
"""

from __future__ import annotations

import hashlib
import re
import sys
import unicodedata
from bisect import bisect_right
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("email", "ip", "card", "phone")
Span = tuple[int, int, str]

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# Each number is taken whole, so that a long one is read once; only with three more behind it is it a chain.
_CHAIN = re.compile(r"[0-9]++(?:\.[0-9]++){3,}+|[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9]){11,}+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGITS = re.compile("[^0-9]+")
_NO_DIGITS = bytes(b for b in range(256) if not 48 <= b < 58)
_ASCII = bytes(range(128))


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d)
    return total % 10 == 0


def _emails(text: str) -> Iterator[Span]:
    """Leftmost matches: each holds one ``@``, so it is the run of local characters before one and the domain after it."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at)):
            yield start, m.end(), "email"
            done = m.end()
        else:
            done = at + 1
        at = text.find("@", done)


def _ips(text: str) -> Iterator[Span]:
    """A chain of dotted numbers gives its numbers in fours; what is left over is too short."""
    for m in _CHAIN.finditer(text):
        if m.end() - m.start() < 7:
            continue
        parts, at = m.group().split("."), m.start()
        for k in range(0, len(parts) - 3, 4):
            four = parts[k : k + 4]
            end = at + sum(map(len, four)) + 3
            if all(len(p.lstrip("0")) <= 3 and int(p[-4:]) <= 255 for p in four):
                yield at, end, "ip"
            at = end + 1


def _cards(text: str) -> Iterator[Span]:
    for m in _CARD.finditer(text):
        digits = _DIGITS.sub("", m.group())
        if len(digits) <= 19 and luhn(digits):
            yield m.start(), m.end(), "card"


def _phones(text: str) -> Iterator[Span]:
    for m in _PHONE.finditer(text):
        if 9 <= len(_DIGITS.sub("", m.group())) <= 15:
            yield m.start(), m.end(), "phone"


def find(text: str) -> list[Span]:
    """The spans of the patterns in a text as it stands, by start, then kind as in ``KINDS``."""
    digits = len(text.encode("utf-8", "surrogatepass").translate(None, _NO_DIGITS))
    found = [*(_emails(text) if "@" in text else ()), *(_ips(text) if digits >= 4 else ()), *(_cards(text) if digits >= 12 else ()), *(_phones(text) if digits >= 9 and "+" in text else ())]
    return sorted(found, key=lambda s: (s[0], KINDS.index(s[2]), s[1]))


# Letters of other scripts that look like ASCII letters.
HOMOGLYPHS = {
    "А": "A", "В": "B", "Е": "E", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C", "Т": "T", "У": "Y", "Х": "X", "Ѕ": "S", "І": "I", "Ј": "J",
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "ѕ": "s", "і": "i", "ј": "j", "һ": "h", "ԁ": "d", "ԛ": "q", "ԝ": "w", "ӏ": "l", "к": "k", "м": "m", "т": "t", "в": "b", "н": "h", "г": "r", "п": "n",
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X",
    "α": "a", "ο": "o", "ν": "v", "ρ": "p", "ι": "i", "κ": "k", "υ": "u", "τ": "t", "ε": "e", "χ": "x", "γ": "y", "ɡ": "g", "ı": "i", "ա": "w", "օ": "o", "ս": "u", "ո": "n", "հ": "h", "ց": "g",
    "‐": "-", "‑": "-", "‒": "-", "–": "-", "—": "-", "―": "-", "−": "-", "﹘": "-", "⁃": "-", "․": ".", "。": ".", "｡": ".", "·": ".", "•": ".", "∙": ".", "⋅": ".", "﹒": ".", "＠": "@", "﹫": "@", "➕": "+", "﹢": "+",
}
# Words for the digits 0 to 9 in English, French, German and Spanish.
DIGIT_WORDS = (
    ("zero", "oh", "nought", "zéro", "null", "cero"),
    ("one", "un", "eins", "uno"),
    ("two", "deux", "zwei", "zwo", "dos"),
    ("three", "trois", "drei", "tres"),
    ("four", "quatre", "vier", "cuatro"),
    ("five", "cinq", "fünf", "cinco"),
    ("six", "sechs", "seis"),
    ("seven", "sept", "sieben", "siete"),
    ("eight", "huit", "acht", "ocho"),
    ("nine", "neuf", "neun", "nueve"),
)
_VALUE = {w: str(d) for d, words in enumerate(DIGIT_WORDS) for w in words}
_INVISIBLE = "­͏؜᠎​‌‍‎‏⁠⁡⁢⁣⁤﻿"


@lru_cache(maxsize=1)
def _characters() -> dict[str, str]:
    """What single characters become: the table above, and every compatibility form or digit that has an ASCII reading."""
    out = dict.fromkeys(_INVISIBLE, "")
    for cp in range(0x80, sys.maxunicode + 1 if sys.maxunicode < 0x20000 else 0x20000):
        c = chr(cp)
        kind = unicodedata.category(c)
        if kind == "Nd":
            out[c] = str(unicodedata.digit(c))
        elif kind == "Zs":
            out[c] = " "
        elif kind[0] in "LNPS" and unicodedata.decomposition(c).startswith("<"):
            plain = unicodedata.normalize("NFKC", c)
            if len(plain) == 1 and "!" <= plain <= "~":
                out[c] = plain
    return out | HOMOGLYPHS


@lru_cache(maxsize=1)
def _patterns() -> dict[str, re.Pattern]:
    words = "|".join(sorted(_VALUE, key=lambda w: (-len(w), w)))
    dot_words = r"(?:dot|d0t|punkt|point|punto|ponto|\.)"
    at_words = r"(?:at|ät|arobase|arroba|chez|@)"
    label = r"[A-Za-z0-9-]{1,63}"
    # After a bare at: a domain with a spelled or bracketed dot in it, or one that stands as it is and ends in a name.
    domain = rf"(?:{label}\.)*+{label}(?:\x20dot\x20|\s{{0,3}}[\[({{<]\s{{0,3}}{dot_words}\s{{0,3}}[\])}}>])|(?:{label}\.)+(?:[A-Za-z]{{2,63}}|xn--[A-Za-z0-9-]{{1,59}})(?![A-Za-z0-9-])"
    return {
        "char": re.compile("[" + re.escape("".join(_characters())) + "]"),
        "at": re.compile(rf"\s{{0,3}}[\[({{<]\s{{0,3}}{at_words}\s{{0,3}}[\])}}>]\s{{0,3}}|&\#0{{0,3}}64;|&\#x40;|&commat;|(?<=[A-Za-z0-9])\x20at\x20(?={domain})", re.I),
        "dot": re.compile(rf"\s{{0,3}}[\[({{<]\s{{0,3}}{dot_words}\s{{0,3}}[\])}}>]\s{{0,3}}|&\#0{{0,3}}46;|&\#x2e;|&period;|(?<=[A-Za-z0-9])\x20dot\x20(?=[A-Za-z0-9])", re.I),
        "digits": re.compile(rf"(?<![^\W_])(?:plus[\s-]{{1,3}})?(?:{words})(?:[\s,-]{{1,3}}(?:{words}|[0-9]{{1,19}})(?![^\W_])){{2,40}}|(?<![^\W_])(?:{words})(?![^\W_])", re.I),
        "spelled": re.compile(rf"(?<![^\W_])(?:{words})(?![^\W_])", re.I),
        "like": re.compile(r"[0-9]([OoIl])(?=[0-9])"),
    }


Piece = tuple[int, int, str]


def _apply(text: str, pieces: list[Piece]) -> tuple[str, list[int], list[int], list[bool]]:
    """The rewritten text; for each of its segments the start there, the start in the source and whether it was rewritten."""
    out, starts, sources, changed, at, done = [], [], [], [], 0, 0

    def put(piece: str, source: int, new: bool) -> None:
        nonlocal at
        out.append(piece)
        starts.append(at)
        sources.append(source)
        changed.append(new)
        at += len(piece)

    for s, e, new in pieces:
        if s > done:
            put(text[done:s], done, False)
        put(new, s, True)
        done = e
    if done < len(text):
        put(text[done:], done, False)
    sources.append(len(text))
    return "".join(out), starts, sources, changed


def _character_pieces(text: str) -> list[Piece]:
    if text.isascii():
        return []
    table = _characters()
    if table.keys().isdisjoint(text.encode("utf-8", "surrogatepass").translate(None, _ASCII).decode("utf-8", "surrogatepass")):
        return []
    return [(m.start(), m.end(), table[m.group()]) for m in _patterns()["char"].finditer(text)]


def _digit(word: str) -> str:
    return _VALUE[word.lower().replace("\u0307", "")]


def _identifies(run: str) -> bool:
    """Whether a run of spelled and written digits holds a card's digits, or a plus and a phone's."""
    digits = _DIGITS.sub("", _patterns()["spelled"].sub(lambda w: _digit(w.group()), run))
    return 12 <= len(digits) <= 19 and luhn(digits) or run[:4].lower() == "plus" and 9 <= len(digits) <= 15


def _word_pieces(text: str) -> list[Piece]:
    """Disguises by words and brackets, and digits spelled or drawn with letters; none overlap."""
    p, found = _patterns(), []
    low = text.lower()
    spaced = " dot " in low
    if spaced or " at " in low or any(c in low for c in "[({<&"):
        found += [(m.start(), m.end(), "@") for m in p["at"].finditer(text)]
        found += [(m.start(), m.end(), ".") for m in p["dot"].finditer(text)]
    found += [(m.start(1), m.end(1), "0" if m.group(1) in "Oo" else "1") for m in p["like"].finditer(text)]
    for m in p["digits"].finditer(text) if any(w in low for w in _VALUE) else ():
        spelled = list(p["spelled"].finditer(text, m.start(), m.end()))
        near = text[max(0, m.start() - 6) : m.end() + 6].lower()
        # Three words at least, or a spelled dot; fewer only in a run that is an identifier by itself.
        if len(spelled) < 3 and "dot" not in near and not _identifies(m.group()):
            continue
        head = re.match(r"plus[\s-]{1,3}", m.group(), re.I)
        if head:
            found.append((m.start(), m.start() + head.end(), "+"))
        last = None
        for w in spelled:
            # What stands between two spelled digits goes; between a spelled and a written one stays a space.
            if last is not None:
                gap = text[last : w.start()]
                if re.fullmatch(r"[\s,-]{1,3}", gap):
                    found.append((last, w.end(), _digit(w.group())))
                    last = w.end()
                    continue
            found.append((w.start(), w.end(), _digit(w.group())))
            last = w.end()
    found.sort()
    out: list[Piece] = []
    for s, e, new in found:
        if not out or s >= out[-1][1]:
            out.append((s, e, new))
    return out


def _map_back(spans: list[Span], starts: list[int], sources: list[int], changed: list[bool]) -> list[tuple[Span, bool]]:
    out = []
    for a, b, kind in spans:
        i, j = bisect_right(starts, a) - 1, bisect_right(starts, b - 1) - 1
        while i > 0 and starts[i - 1] == starts[i]:  # pieces that became nothing stand before
            if not changed[i - 1]:
                break
            i -= 1
        first = bisect_right(starts, a) - 1
        start = sources[first] if changed[first] else sources[first] + a - starts[first]
        end = sources[j + 1] if changed[j] else sources[j] + b - starts[j]
        out.append(((start, end, kind), any(changed[first : j + 1])))
    return out


def deobfuscated(text: str) -> list[Span]:
    """Spans in source characters that only the rewritten text shows."""
    chars = _character_pieces(text)
    plain, s1, src1, ch1 = _apply(text, chars) if chars else (text, [0], [0, len(text)], [False])
    words = _word_pieces(plain)
    if not chars and not words:
        return []
    final, s2, src2, ch2 = _apply(plain, words) if words else (plain, [0], [0, len(plain)], [False])
    out = []
    for (a, b, kind), new in _map_back(find(final), s2, src2, ch2):
        if chars and b > a:
            ((a, b, kind), again), = _map_back([(a, b, kind)], s1, src1, ch1)
            new = new or again
        if new:
            out.append((a, b, kind))
    return out


def spans_of(text: str | None) -> tuple[list[Span], list[Span]]:
    """Base spans, and all spans."""
    if not text:
        return [], []
    base = find(text)
    more = [s for s in deobfuscated(text) if not any(b[2] == s[2] and b[0] <= s[0] and s[1] <= b[1] for b in base)]
    return base, sorted({*base, *more}, key=lambda s: (s[0], KINDS.index(s[2]), s[1]))


def render(spans: list[Span]) -> str:
    return ",".join(f"{k}:{s}:{e}" for s, e, k in spans)


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        counts: dict[str, list[int]] = {k: [] for k in KINDS}
        shas, alls, added = [], [], []
        for text in b.column("text"):
            base, every = spans_of(text.as_py())
            for k in KINDS:
                counts[k].append(sum(s[2] == k for s in base))
            shas.append(hashlib.sha256(render(base).encode()).hexdigest())
            alls.append(render(every))
            added.append(len(every) - len(base))
        yield pa.RecordBatch.from_arrays(
            [b.column("id"), *(pa.array(counts[k], pa.int64()) for k in KINDS), pa.array(shas, pa.string()), pa.array(alls, pa.string()), pa.array(added, pa.int64())],
            names=["id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans", "n_added"],
        )


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: id, base counts by kind, SHA-256 of the base spans, all spans, how many were added."""
    kind = dict(docs.dtypes)[id_col]
    narrow = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    out = narrow.mapInArrow(_scan, f"id {kind}, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long")
    return out.withColumnRenamed("id", id_col)


def _mask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        out = []
        for text in b.column("text"):
            t = text.as_py()
            if t is not None:
                pieces, at = [], 0
                for s, e, k in spans_of(t)[1]:
                    if s >= at:
                        pieces += [t[at:s], f"<{k}>"]
                    at = max(at, e)
                t = "".join([*pieces, t[at:]])
            out.append(t)
        yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(out, pa.string())], names=["id", "text"])


def mask_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents' ids and texts with each span replaced by its kind."""
    narrow = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return narrow.mapInArrow(_mask, f"id {dict(docs.dtypes)[id_col]}, text string").withColumnRenamed("id", id_col).withColumnRenamed("text", text_col)
