"""Width, case and blank folding inside the JVM."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

#: One-character compatibility forms (full-width ASCII, half-width katakana, wide blank), from the Unicode tables.
SINGLE = {chr(c): unicodedata.normalize("NFKC", chr(c)) for c in [*range(0xFF01, 0xFFA0), 0x3000, 0x00A0]}
SINGLE = {a: b for a, b in SINGLE.items() if len(b) == 1 and a != b}
#: A kana followed by a voicing mark, and the one character that both make.
VOICED = {
    chr(base) + mark: whole
    for mark in "゙゚"
    for base in range(0x30A1, 0x30FB)
    if len(whole := unicodedata.normalize("NFC", chr(base) + mark)) == 1
}


def fold_width(text: Column) -> Column:
    """Full-width ASCII, wide blanks and half-width katakana in their ordinary form."""
    narrow = F.translate(text, "".join(SINGLE), "".join(SINGLE.values()))
    voiced = narrow
    for pair, whole in VOICED.items():
        voiced = F.replace(voiced, F.lit(pair), F.lit(whole))
    return F.when(narrow.rlike("[゙゚]"), voiced).otherwise(narrow)


def folded(text: Column) -> Column:
    """Case, width and surrounding blanks removed; null stays null."""
    return F.lower(F.trim(fold_width(text)))
