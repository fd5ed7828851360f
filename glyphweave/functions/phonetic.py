"""Phonetic codes of name columns: rewriting chains inside the JVM, or kernels over the different names of a batch.

Accents are folded first; what is no letter does not count. A name without letters has no code (null),
unless a function says otherwise.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import lit

from glyphweave.functions.udf import ColumnLike, col, each, once
from glyphweave.functions.unicode import native_fold
from glyphweave.kernels import double_metaphone as double
from glyphweave.kernels import phonetic as kernels

#: Refined Soundex codes of A to Z.
REFINED = "01360240043788015936020505"
#: The steps of Caverphone 2.0 in their order, pattern and replacement.
CAVERPHONE = (
    "e$ |^cough cou2f|^rough rou2f|^tough tou2f|^enough enou2f|^trough trou2f|^gn 2n|mb$ m2|cq 2q|ci si|ce se|cy sy|tch 2ch|c k|q k|x k|v f|dg 2g|tio sio|tia sia|d t|ph fh|b p|sh s2|z s|"
    "^[aeiou] A|[aeiou] 3|j y|^y3 Y3|^y A|y 3|3gh3 3kh3|gh 22|g k|s+ S|t+ T|p+ P|k+ K|f+ F|m+ M|n+ N|w3 W3|wh3 Wh3|w$ 3|w 2|^h A|h 2|r3 R3|r$ 3|r 2|l3 L3|l$ 3|l 2|2 |3$ A|3 "
)


def letters(x: ColumnLike) -> Column:
    """Folded capital letters of a name; null if there is none."""
    return F.nullif(F.regexp_replace(F.upper(native_fold(col(x))), "[^A-Z]", ""), lit(""))


def _runs(x: Column) -> Column:
    return F.regexp_replace(x, r"(.)\1+", "$1")


def _rest(x: Column) -> Column:
    return x.substr(lit(2), F.char_length(x))


def soundex(x: ColumnLike) -> Column:
    """American Soundex."""
    return F.soundex(letters(x))


def refined_soundex(x: ColumnLike) -> Column:
    w = letters(x)
    return F.concat(F.substring(w, 1, 1), _runs(F.translate(w, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", REFINED)))


def caverphone(x: ColumnLike) -> Column:
    """Caverphone 2.0, ten signs; a text without letters has ten ones."""
    y = F.lower(F.regexp_replace(native_fold(col(x)), "[^A-Za-z]", ""))
    for step in CAVERPHONE.split("|"):
        pattern, new = step.split(" ")
        y = F.regexp_replace(y, pattern, new) if any(s in pattern for s in "^$+[") else F.replace(y, lit(pattern), lit(new))
    return F.rpad(y, 10, "1")


def mra_encode(x: ColumnLike) -> Column:
    """Match Rating codex."""
    w = letters(x)
    kept = F.concat(F.substring(w, 1, 1), F.regexp_replace(_rest(_runs(w)), "[AEIOU]", ""))
    return F.when(F.char_length(kept) > 6, F.concat(F.substring(kept, 1, 3), F.right(kept, lit(3)))).otherwise(kept)


def statcan(x: ColumnLike, max_length: int = 4) -> Column:
    """Statistics Canada name code."""
    w = letters(x)
    return F.substring(_runs(F.concat(F.substring(w, 1, 1), F.regexp_replace(_rest(w), "[AEIOUY]", ""))), 1, max_length)


def lein(x: ColumnLike, max_length: int = 4) -> Column:
    w = letters(x)
    rest = _runs(F.regexp_replace(_rest(w), "[AEIOUYWH]", ""))
    code = F.translate(rest, "DTMNLRBFPVCJKGQSXZ", "112233444455555555")
    return F.rpad(F.concat(F.substring(w, 1, 1), code), max_length, "0")


def phonex(x: ColumnLike, max_length: int = 4) -> Column:
    """Phonex; a name of nothing but S has an empty code."""
    w = F.regexp_replace(letters(x), "S+$", "")
    for pattern, new in (("^KN", "N"), ("^WR", "R"), ("^PH", "F"), ("^H", ""), ("^[EIOUY]", "A"), ("^P", "B"), ("^V", "F"), ("^[KQ]", "C"), ("^J", "G"), ("^Z", "S")):
        w = F.regexp_replace(w, pattern, new)

    def code(w: Column) -> Column:
        rest = _rest(w)
        for pattern, new in (("R(?:[AEHIOUWY]|$)", "6"), ("R", ""), ("L(?:[AEHIOUWY]|$)", "4"), ("L", ""), ("[AEHIOUWY]", ""), ("[MN][DG]*", "5"), ("[BFPV]", "1"), ("[DT]C", "C"), ("[DT]", "3"), ("[CGJKQSXZ]", "2")):
            rest = F.regexp_replace(rest, pattern, new)
        return F.rpad(F.concat(F.substring(w, 1, 1), _runs(rest)), max_length, "0")

    return once(w, lambda w: once(code(w), lambda c: F.when((w == "") | c.rlike("^0*$"), lit("")).otherwise(c)))


def _coded(kernel: Callable, *fixed: object) -> Callable[[ColumnLike], Column]:
    return lambda x: each("string", kernel, *fixed)(letters(x))


def nysiis(x: ColumnLike) -> Column:
    return _coded(kernels.nysiis)(x)


def onca(x: ColumnLike, max_length: int = 4) -> Column:
    """NYSIIS, then Soundex."""
    return _coded(kernels.onca, max_length)(x)


def cologne(x: ColumnLike) -> Column:
    """Kölner Phonetik."""
    return _coded(kernels.cologne)(x)


def metaphone(x: ColumnLike, max_length: int = 4) -> Column:
    return _coded(kernels.metaphone, max_length)(x)


def roger_root(x: ColumnLike, max_length: int = 5) -> Column:
    return _coded(kernels.roger_root, max_length)(x)


def double_metaphone(x: ColumnLike) -> Column:
    """A struct of primary and secondary code."""
    return each("struct<primary:string,secondary:string>", double.double_metaphone)(native_fold(col(x)))


def mra_compare(a: ColumnLike, b: ColumnLike) -> Column:
    """Whether two names match by the Match Rating Approach."""
    return each("boolean", kernels.mra_compare)(letters(a), letters(b))


def daitch_mokotoff(x: ColumnLike) -> Column:
    """All six-digit codes of a name; four letters with accents have rules of their own, the others are folded."""
    own, held = "ąęţț", "\ue001\ue002\ue003\ue004"
    small = F.replace(F.translate(F.lower(col(x)), own, held), lit("ß"), lit("s"))
    return each("array<string>", kernels.daitch_mokotoff)(F.translate(F.lower(native_fold(small)), held, own))


def eudex(x: ColumnLike) -> Column:
    """A hash of sounds as 16 hexadecimal digits."""
    return each("string", kernels.eudex_hex)(col(x))


def eudex_distance(a: ColumnLike, b: ColumnLike, method: str = "graduated") -> Column:
    """Bits in which the hashes of two words differ, weighted by place (graduated) or not (hamming)."""
    if method not in ("graduated", "hamming"):
        raise ValueError("method is graduated or hamming")
    return each("double", kernels.eudex_distance, method == "graduated")(col(a), col(b))
