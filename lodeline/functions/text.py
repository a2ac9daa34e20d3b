"""Text features as column expressions; all patterns are plain character classes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Character ranges of scripts.
SCRIPTS = {
    "han": r"\x{3400}-\x{4DBF}\x{4E00}-\x{9FFF}\x{F900}-\x{FAFF}",
    "kana": r"\x{3040}-\x{30FF}",
    "hangul": r"\x{1100}-\x{11FF}\x{AC00}-\x{D7AF}",
    "latin": r"A-Za-z\x{00C0}-\x{00D6}\x{00D8}-\x{00F6}\x{00F8}-\x{024F}",
    "cyrillic": r"\x{0400}-\x{04FF}",
    "arabic": r"\x{0600}-\x{06FF}",
    "devanagari": r"\x{0900}-\x{097F}",
    "thai": r"\x{0E00}-\x{0E7F}",
    "hebrew": r"\x{0590}-\x{05FF}",
}
# Words that stand for no text.
NO_TEXT = ("nan", "none", "<na>", "null")


def occurrences(c: Column, pattern: str) -> Column:
    return F.regexp_count(c, F.lit(pattern))


def strip(c: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(c, r"^[\s\p{Z}]+|[\s\p{Z}]+$", "")


def has_content(c: Column) -> Column:
    """Holds a letter or a number and is no word for a missing value; false for null."""
    return F.coalesce(c.rlike(r"[\p{L}\p{N}]") & ~F.lower(strip(c)).isin(*NO_TEXT), F.lit(False))


def char_profile(c: Column) -> dict[str, Column]:
    """Twelve features of a text."""
    han = occurrences(c, f"[{SCRIPTS['han']}]")
    latin, digit = occurrences(c, "[A-Za-z]"), occurrences(c, "[0-9]")
    punct, space = occurrences(c, r"[^\p{L}\p{N}_\s]"), occurrences(c, r"\s")
    n = F.length(c)
    return {
        "len": n,
        "n_han": han,
        "n_lat": latin,
        "n_dig": digit,
        "n_punct": punct,
        "n_space": space,
        "r_han": F.when(n > 0, han / n).otherwise(0.0),
        "has_lat": latin > 0,
        "has_dig": digit > 0,
        "has_punct": punct > 0,
        "has_qmark": c.rlike("[?？]"),
        "is_mixed_script": (han > 0) & (latin > 0),
    }


def script_shares(c: Column) -> dict[str, Column]:
    """Share of each script among the letters of a text; 'other' is what none of them covers."""
    letters = occurrences(c, r"\p{L}")
    counts = {s: occurrences(c, f"[{r}]") for s, r in SCRIPTS.items()}
    share = {s: F.when(letters > 0, n / letters).otherwise(0.0) for s, n in counts.items()}
    rest = F.greatest(F.lit(0), letters - sum(counts.values(), F.lit(0)))
    return share | {"other": F.when(letters > 0, rest / letters).otherwise(0.0)}


def script_label(c: Column, mixed: float = 0.2) -> Column:
    """'nonlinguistic', one script, 'mixed:a+b' if a second script has ``mixed`` of the letters, or 'mixed'."""
    shares = script_shares(c)
    names = list(shares)
    ranked = F.sort_array(F.array(*[F.struct(shares[s].alias("p"), F.lit(len(names) - i).alias("o"), F.lit(s).alias("s")) for i, s in enumerate(names)]), asc=False)
    first, second = ranked[0], ranked[1]
    return (
        F.when(c.isNull() | (first["p"] == 0), "nonlinguistic")
        .when(second["p"] >= mixed, F.concat(F.lit("mixed:"), first["s"], F.lit("+"), second["s"]))
        .when(first["p"] >= 0.5, first["s"])
        .otherwise("mixed")
    )


def without_controls(c: Column) -> Column:
    return F.regexp_replace(c, r"[\x00-\x08\x0b\x0c\x0e-\x1f]", " ")


def tokens(c: Column, how: str = "words") -> Column:
    """'words': lower-case runs of letters and digits; 'chars': single characters without white space."""
    if how == "words":
        return F.regexp_extract_all(F.lower(c), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))
    if how == "chars":
        return F.filter(F.split(c, ""), lambda x: (x != "") & ~x.rlike(r"\s"))
    raise ValueError(f"unknown tokenizer {how!r}")


def grams(c: Column, shortest: int, longest: int) -> Column:
    """All substrings of a text of the given lengths, in characters."""
    n = F.length(c)

    def of(k: int) -> Column:
        return F.when(n >= k, F.transform(F.sequence(F.lit(1), n - k + 1), lambda i: F.substring(c, i, F.lit(k)))).otherwise(F.array().cast("array<string>"))

    return F.flatten(F.array(*[of(k) for k in range(shortest, longest + 1)]))
