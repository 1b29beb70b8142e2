"""Text and identifier expressions."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F


def _plain_letters() -> tuple[str, str]:
    """Latin letters with marks, and the letters without them, by Unicode decomposition."""
    pairs = [(c, unicodedata.normalize("NFKD", c)) for c in map(chr, range(0xC0, 0x250))]
    pairs += [(c, unicodedata.normalize("NFKD", c)) for c in map(chr, range(0x1E00, 0x1F00))]
    bare = [(c, "".join(x for x in d if not unicodedata.combining(x))) for c, d in pairs]
    bare = [(c, b) for c, b in bare if len(b) == 1 and b != c]
    return "".join(c for c, _ in bare), "".join(b for _, b in bare)


_MARKED, _PLAIN = _plain_letters()


def strip_accents(x: Column) -> Column:
    """Latin letters without their marks; loose combining marks go."""
    return F.regexp_replace(F.translate(x, _MARKED, _PLAIN), r"\p{Mn}", "")


def norm_name(x: Column) -> Column:
    """No accents, upper case, single spaces, trimmed; null as ''."""
    return F.trim(F.regexp_replace(F.upper(strip_accents(F.coalesce(x, F.lit("")))), r"\s+", " "))


def header_name(text: str) -> str:
    """A column header without accents, line breaks and double spaces (driver side)."""
    flat = "".join(c for c in unicodedata.normalize("NFKD", str(text)) if not unicodedata.combining(c))
    return " ".join(flat.split())


def number(x: Column) -> Column:
    """A double, or null for what is no number; NaN counts as none."""
    return F.nanvl(x.try_cast("double"), F.lit(None).cast("double"))


def coordinate(x: Column) -> Column:
    """A coordinate from text: trimmed, decimal comma allowed, null for what is no number."""
    return number(F.replace(F.trim(x), F.lit(","), F.lit(".")))


def pad_id(x: Column, width: int) -> Column:
    """An identifier as text: without a trailing ".0", trimmed, filled with zeros on the left; longer ones stay whole."""
    bare = F.trim(F.regexp_replace(x.cast("string"), r"\.0$", ""))
    return F.when(F.length(bare) < width, F.lpad(bare, width, "0")).otherwise(bare)


def district_of(x: Column) -> Column:
    """The six-digit district of a ten-digit place code."""
    return F.substring(pad_id(x, 10), 1, 6)


def title(x: Column) -> Column:
    """Every run of letters with a capital first, as in "O'Higgins"."""
    parts = F.regexp_extract_all(F.lower(x), F.lit(r"(\p{L}+|[^\p{L}]+)"), F.lit(1))
    return F.array_join(F.transform(parts, F.initcap), "")


def facility_label(name: Column, category: Column, district: Column, department: Column, code: Column) -> Column:
    """One line a facility, unique by its code; what is missing reads "sin dato" (fixed values: this and the dot)."""
    said = lambda x: F.coalesce(x.cast("string"), F.lit("sin dato"))
    dot = F.lit("  ·  ")
    return F.concat(
        said(title(name)), dot, said(category), dot, said(title(district)), F.lit(", "), said(title(department)), dot, said(code)
    )


def looks_twice_encoded(x: Column) -> Column:
    """Whether a text shows signs of UTF-8 read as Latin-1 (fixed value: the pattern)."""
    return F.coalesce(x.rlike("Ã.|Â.|ï¿½|�"), F.lit(False))


def looks_lossy(x: Column) -> Column:
    """Whether a question mark stands where a letter was lost (fixed value: the pattern)."""
    return F.coalesce(x.rlike(r"[A-Za-z]\?[A-Za-z]|^\?[A-Za-z]"), F.lit(False))
