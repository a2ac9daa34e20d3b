"""One form for texts that read the same.

A longest-match transducer over grapheme clusters, compiled once from rules over the
Unicode database and a short list of look-alike letters. It maps widths, ligatures,
radicals, spaces, invisible characters and look-alike letters and recomposes accents,
in one pass. Letter case, accents, raised or circled digits, letters of mathematical styles
and other character forms of Chinese are kept, as they are visible; so is a joiner between
pictographs, as the joined sign reads otherwise. Of the Greek small letters that resemble a
Latin one (``RESEMBLING``) alpha, rho, iota and upsilon are folded only between Latin letters, so
a formula keeps them, and nu and omicron everywhere but beside other Greek letters.

Null stays null; an empty text stays empty; texts of any length take linear time;
applying the transducer twice equals applying it once.
"""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Letters of other scripts that look like a Latin letter.
LOOKALIKES = {
    "а": "a", "с": "c", "ԁ": "d", "е": "e", "һ": "h", "і": "i", "ј": "j", "ӏ": "l", "о": "o", "р": "p", "ԛ": "q",
    "ѕ": "s", "у": "y", "х": "x", "ѵ": "v", "ԝ": "w", "ԍ": "g",
    "А": "A", "В": "B", "С": "C", "Е": "E", "Н": "H", "І": "I", "Ј": "J", "К": "K", "М": "M", "О": "O", "Р": "P",
    "Ѕ": "S", "Т": "T", "У": "Y", "Х": "X", "Ԛ": "Q", "Ԝ": "W", "Ԍ": "G", "Ү": "Y",
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P",
    "Τ": "T", "Υ": "Y", "Χ": "X", "ϲ": "c", "ϳ": "j",
    "ɡ": "g", "ɑ": "a", "ı": "i",
    "օ": "o", "ս": "u", "հ": "h", "ց": "g", "զ": "q",
    "Ꭰ": "D", "Ꭱ": "R", "Ꭲ": "T", "Ꭵ": "i", "Ꭺ": "A", "Ꭻ": "J", "Ꭼ": "E", "Ꮃ": "W", "Ꮇ": "M", "Ꮋ": "H", "Ꮐ": "G", "Ꮓ": "Z", "Ꮢ": "R", "Ꮪ": "S", "Ꮩ": "V", "Ꮮ": "L", "Ꮯ": "C", "Ꮲ": "P", "Ꮶ": "K",
    "ꓐ": "B", "ꓑ": "P", "ꓓ": "D", "ꓔ": "T", "ꓖ": "G", "ꓗ": "K", "ꓙ": "J", "ꓚ": "C", "ꓜ": "Z", "ꓝ": "F", "ꓟ": "M", "ꓠ": "N", "ꓡ": "L", "ꓢ": "S", "ꓣ": "R", "ꓦ": "V", "ꓧ": "H", "ꓪ": "W", "ꓫ": "X", "ꓬ": "Y", "ꓮ": "A", "ꓰ": "E", "ꓲ": "I", "ꓳ": "O", "ꓴ": "U",
}
# Greek small letters that resemble a Latin one; the first two so closely that only a Greek word keeps them.
RESEMBLING = {"ν": "v", "ο": "o", "ι": "i", "ρ": "p", "α": "a", "υ": "u"}
_LATIN = "A-Za-z\u00c0-\u024f\u03bd\u03bf"
_GREEK = "\u0370-\u03bc\u03be\u03c0-\u03ff\u1f00-\u1fff"
_AMONG_LATIN = re.compile(f"(?<=[{_LATIN}])[ιραυ](?=[{_LATIN}])|(?<![{_GREEK}νο])([νο]+)(?![{_GREEK}νο])")
_RESEMBLES = frozenset(RESEMBLING)
_JOINER = "\u200d"
_PICTURE = "[\u2600-\u27bf\U0001f000-\U0001faff]"


def _among_latin(text: str) -> str:
    """Greek letters of a form that stand among Latin ones; places stay."""
    return text if _RESEMBLES.isdisjoint(text) else _AMONG_LATIN.sub(lambda x: "".join([RESEMBLING[c] for c in x.group()]), text)


def _rule(c: str) -> str | None:
    """What a character becomes by rule; None where it stays."""
    cat = unicodedata.category(c)
    if cat == "Cf" or 0xFE00 <= ord(c) <= 0xFE0F or c in "ᅟᅠㅤ͏":
        return ""
    if cat == "Zs":
        return None if c == " " else " "
    if c in LOOKALIKES:
        return LOOKALIKES[c]
    dec = unicodedata.decomposition(c)
    tag = dec.split(" ")[0] if dec.startswith("<") else ""
    n = ord(c)
    if tag in ("<wide>", "<narrow>"):
        return unicodedata.normalize("NFKC", c)
    if tag == "<compat>" and (0xFB00 <= n <= 0xFB06 or 0x2E80 <= n <= 0x2FDF):
        return unicodedata.normalize("NFKC", c)
    if not tag and dec and " " not in dec and not unicodedata.combining(c):
        return unicodedata.normalize("NFC", c) if unicodedata.normalize("NFC", c) != c else None
    return None


@lru_cache(maxsize=1)
def mapping() -> dict[str, str]:
    """The whole map, closed (no image is itself mapped) and checked for conflicts."""
    out: dict[str, str] = {}
    # Ideographs, syllables, surrogates and private characters map to themselves.
    spans = ((0, 0x3400), (0xA000, 0xAC00), (0xF900, 0x17000), (0x1B000, 0x20000), (0x2F800, 0x2FA20), (0xE0000, 0xE0200))
    for c in (chr(n) for a, b in spans for n in range(a, b)):
        if (to := _rule(c)) is not None and to != c:
            out[c] = to
    for c, to in out.items():
        closed = "".join(out.get(x, x) for x in to)
        if closed != "".join(out.get(x, x) for x in closed):
            raise ValueError(f"the mapping of {c!r} does not settle")
        out[c] = closed
    return out


@lru_cache(maxsize=1)
def _compiled() -> tuple[re.Pattern, frozenset[str], frozenset[str]]:
    m = mapping()
    points = sorted(map(ord, m))
    runs: list[list[int]] = []
    for n in points:
        if runs and n == runs[-1][1] + 1:
            runs[-1][1] = n
        else:
            runs.append([n, n])
    cls = "".join(f"\\U{a:08x}" if a == b else f"\\U{a:08x}-\\U{b:08x}" for a, b in runs)
    marks = [n for n in range(0x300, 0x20000) if unicodedata.combining(chr(n))]
    mruns: list[list[int]] = []
    for n in marks:
        if mruns and n == mruns[-1][1] + 1:
            mruns[-1][1] = n
        else:
            mruns.append([n, n])
    mcls = "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in mruns)
    # The longest match: a base with the marks after it (invisible characters between them
    # included), or else a single character that is mapped.
    inv = "".join(f"\\U{ord(c):08x}" for c, to in m.items() if not to)
    joined = f"(?:(?<={_PICTURE})|(?<={_PICTURE}\ufe0f)){_JOINER}(?={_PICTURE})"
    cluster = re.compile(f"[^{mcls}{inv}][{inv}]*(?:[{mcls}][{inv}]*)+|{joined}|[{cls}]|[{mcls}]+")
    found = frozenset(map(chr, marks))
    return cluster, found, frozenset(m) | found


def _image(s: str) -> str:
    m = mapping()
    return unicodedata.normalize("NFC", "".join([m.get(c, c) for c in s]))


def _of(x: re.Match) -> str:
    s = x.group()
    if s == _JOINER and _JOINED.match(x.string, x.start()):
        return s
    return _cluster(s)


_JOINED = re.compile(f"(?:(?<={_PICTURE})|(?<={_PICTURE}\ufe0f)){_JOINER}(?={_PICTURE})")


@lru_cache(maxsize=65536)
def _cluster(s: str) -> str:
    return _image(s)


def fold(text: str | None) -> str | None:
    """The one form of a text."""
    if text is None or text.isascii():
        return text
    cluster, marks, special = _compiled()
    if not special.isdisjoint(text):
        text = cluster.sub(_of, text)
    return _among_latin(text)


def fold_with_offsets(text: str) -> tuple[str, list[int] | None]:
    """The form of a text, and for each of its characters where it began in the text (None: unmoved)."""
    if text.isascii():
        return text, None
    cluster, marks, special = _compiled()
    if special.isdisjoint(text):
        return _among_latin(text), None
    out: list[str] = []
    at: list[int] = []
    last, moved = 0, False
    for x in cluster.finditer(text):
        a, b = x.span()
        out.append(text[last:a])
        at.extend(range(last, a))
        to = _of(x)
        out.append(to)
        at.extend([a] * len(to))
        moved = moved or b - a != 1 or len(to) != 1
        last = b
    out.append(text[last:])
    at.extend(range(last, len(text)))
    return _among_latin("".join(out)), at if moved else None


@F.pandas_udf(T.StringType())
def fold_udf(s: pd.Series) -> pd.Series:
    return pd.Series([fold(x) for x in s], index=s.index, dtype=object)


def unify(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    """Add for each ``{column: name}`` the one form of a text column as ``name``.

    Rows of ASCII text never leave the JVM's view of them: their form is the text itself.
    Null stays null; every other column, whatever its name, is kept.
    """
    for column, name in columns.items():
        c = df[column]
        df = df.withColumn(name, F.when(c.rlike(r"^[\x00-\x7f]*$"), c).otherwise(fold_udf(c)))
    return df


def reads_same(a: Column, b: Column) -> Column:
    """Whether two texts read the same; null if either is null."""
    return fold_udf(a) == fold_udf(b)


def find_disguised(df: DataFrame, a: str, b: str) -> DataFrame:
    """Rows whose ``a`` and ``b`` are different strings that read the same.

    Rows with a null in either are out. Two different ASCII texts never read the same, so
    only pairs with a character beyond ASCII reach the transducer.
    """
    wide = r"[^\x00-\x7f]"
    different = df.where(df[a].isNotNull() & df[b].isNotNull() & (df[a] != df[b]) & (df[a].rlike(wide) | df[b].rlike(wide)))
    return different.where(reads_same(different[a], different[b]))
