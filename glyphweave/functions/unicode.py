"""Folding tables, made from the Unicode database by rule."""

from __future__ import annotations

import unicodedata
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Letters and signs without a decomposition, and what they fold to.
SPECIAL = {
    "Æ": "AE", "æ": "ae", "Ø": "O", "ø": "o", "Œ": "OE", "œ": "oe", "ß": "ss", "ẞ": "SS", "Ð": "D", "ð": "d", "Þ": "TH", "þ": "th", "Đ": "D", "đ": "d",
    "Ħ": "H", "ħ": "h", "ı": "i", "ĸ": "q", "Ł": "L", "ł": "l", "Ŋ": "N", "ŋ": "n", "Ŧ": "T", "ŧ": "t", "Ɖ": "D", "Ɛ": "E", "ɛ": "e", "Ƒ": "F", "ƒ": "f",
    "ƀ": "b", "Ɓ": "B", "Ƈ": "C", "ƈ": "c", "Ɗ": "D", "Ɠ": "G", "Ƙ": "K", "ƙ": "k", "ƚ": "l", "Ɲ": "N", "ƞ": "n", "Ƥ": "P", "ƥ": "p", "ƫ": "t", "Ƭ": "T",
    "ƭ": "t", "Ʈ": "T", "Ʋ": "V", "Ƴ": "Y", "ƴ": "y", "Ƶ": "Z", "ƶ": "z", "ȷ": "j", "Ⱥ": "A", "ⱥ": "a", "Ƀ": "B", "Ʉ": "U", "Ɇ": "E", "ɇ": "e", "Ɉ": "J",
    "ɉ": "j", "Ɍ": "R", "ɍ": "r", "Ɏ": "Y", "ɏ": "y", "\u2018": "'", "\u2019": "'", "\u201a": ",", "\u201b": "'", "\u201c": '"', "\u201d": '"', "\u201e": ",,",
    "\u201f": '"', "\u2032": "'", "\u2033": '"', "«": "<<", "»": ">>", "‹": "<", "›": ">", "\u2010": "-", "\u2011": "-", "\u2012": "-", "\u2013": "-",
    "\u2014": "-", "\u2015": "-", "\u2212": "-", "×": "*", "÷": "/", "©": "(C)", "®": "(R)", "\u00a0": " ", "\u00ad": "-", "¼": " 1/4", "½": " 1/2", "¾": " 3/4", "\u2044": "/",
}
#: Blocks whose characters are folded by their decomposition: Latin letters, number forms, ligatures, full width forms, spaces and signs.
BLOCKS = ((0xA0, 0x250), (0x1E00, 0x1F00), (0x2000, 0x2070), (0x2100, 0x2190), (0x2460, 0x24EB), (0xFB00, 0xFB07), (0xFF01, 0xFF5F))


@lru_cache(maxsize=1)
def folds() -> dict[str, str]:
    """Character -> ASCII."""
    out = {}
    for low, high in BLOCKS:
        for point in range(low, high):
            c = chr(point)
            base = "".join(SPECIAL.get(x, x) for x in unicodedata.normalize("NFKD", c) if not unicodedata.combining(x))
            if base.isascii() and base and base != c and unicodedata.category(c)[0] in "LNZP":
                out[c] = base
    return out | SPECIAL


def native_fold(x: Column, sub: str | None = None) -> Column:
    """Fold to ASCII inside the JVM: letters with one letter by a translation, the others by a map; ASCII texts are left alone."""
    table = folds()
    single = {k: v for k, v in table.items() if len(v) == 1}
    several = F.create_map(*[F.lit(t) for k, v in table.items() if len(v) != 1 for t in (k, v)])
    y = F.translate(x, "".join(single), "".join(single.values()))
    chars = F.regexp_extract_all(F.regexp_replace(y, r"\p{M}+", ""), F.lit("(?s)."), F.lit(0))
    z = F.array_join(F.transform(chars, lambda c: F.coalesce(F.try_element_at(several, c), c)), "")
    if sub is not None:
        z = F.regexp_replace(z, r"[^\x00-\x7F]", sub.replace("\\", r"\\").replace("$", r"\$"))
    return F.when(x.rlike(r"[^\x00-\x7F]"), z).otherwise(x)
