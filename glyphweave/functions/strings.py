"""String utilities, tokens, parsing, check digits and hashes. A null text gives null."""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import lit

from glyphweave.functions.match import FEW, ascii_lower, java_pattern
from glyphweave.functions.udf import ColumnLike, col, each
from glyphweave.functions.unicode import native_fold
from glyphweave.kernels import text as kernels

#: The characters with the property White_Space.
WHITE = r"[\u0009-\u000D\u0020\u0085\u00A0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000]"


def _n(x: int | Column) -> Column:
    return x if isinstance(x, Column) else lit(x)


def ftrimws(x: ColumnLike, which: str = "both", whitespace: str | None = None) -> Column:
    """Cut white space (blank, tab, line ends) or another class off the ends."""
    if which not in ("both", "left", "right"):
        raise ValueError("which is both, left or right")
    if whitespace is None:
        return {"both": F.btrim, "left": F.ltrim, "right": F.rtrim}[which](col(x), lit(" \t\r\n"))
    one = java_pattern(whitespace)[5:]
    ends = {"left": rf"\A(?:{one})+", "right": rf"(?:{one})+\z", "both": rf"\A(?:{one})+|(?:{one})+\z"}
    return F.regexp_replace(col(x), "(?sU)" + ends[which], "")


def fsubstr(x: ColumnLike, start: int | Column, stop: int | Column) -> Column:
    """Characters from ``start`` to ``stop``, counted from 1 and clamped."""
    first = F.when(_n(start) < 1, lit(1)).otherwise(_n(start))
    length = F.when(_n(stop) < first, lit(0)).otherwise(_n(stop) - first + 1)
    return col(x).substr(first.cast("int"), length.cast("int"))


def fnchar(x: ColumnLike, type: str = "chars", keep_na: bool = True) -> Column:  # noqa: A002
    """Number of characters, bytes or columns on a terminal; null counts 2 if it is not kept."""
    n = {"chars": F.char_length, "bytes": F.octet_length, "width": lambda c: each("int", kernels.width)(c)}[type](col(x))
    return n if keep_na else F.coalesce(n, lit(2))


def fchartr(old: str, new: str, x: ColumnLike) -> Column:
    """Each character of ``old`` (with ranges like a-z) becomes that of ``new``; the last of repeated ones counts."""
    a, b = kernels.expand_ranges(old), kernels.expand_ranges(new)
    if len(b) < len(a):
        raise ValueError("new is shorter than old")
    table = dict(zip(a, b, strict=False))
    return F.translate(col(x), "".join(table), "".join(table.values()))


def fsquish(x: ColumnLike) -> Column:
    """Runs of white space as one space, none at the ends."""
    return F.trim(F.regexp_replace(col(x), WHITE + "+", " "))


def tokens(x: ColumnLike) -> Column:
    """Words between white space."""
    return F.filter(F.split(fsquish(x), " "), lambda t: t != "")


def fstrsplit(x: ColumnLike, split: str, fixed: bool = False, perl: bool = False, ignore_case: bool = False) -> Column:
    """Pieces between separators: no empty last one, nothing of an empty text, characters for an empty separator."""
    if split == "":
        return F.regexp_extract_all(col(x), lit("(?s)."), lit(0))
    parts = F.split(col(x), java_pattern(split, ignore_case, perl, fixed), -1)
    return F.when(F.element_at(parts, -1) == "", F.slice(parts, lit(1), F.size(parts) - 1)).otherwise(parts)


def fstrsplit_columns(df: DataFrame, x: str, split: str, n: int, prefix: str = "part_", **kind: bool) -> DataFrame:
    """The first ``n`` pieces as columns, null where there are fewer."""
    parts = fstrsplit(x, split, **kind)
    return df.select("*", *[F.get(parts, lit(i)).alias(f"{prefix}{i + 1}") for i in range(n)])


def fsplit_field(x: ColumnLike, split: str, field: int, fixed: bool = False, perl: bool = False, ignore_case: bool = False) -> Column:
    """One piece, from the end if negative; empty pieces count; null out of range."""
    if field == 0:
        raise ValueError("fields count from 1 or from -1")
    return F.try_element_at(F.split(col(x), java_pattern(split, ignore_case, perl, fixed), -1), lit(field))


def ascii_fold(x: ColumnLike, sub: str | None = None) -> Column:
    """Latin letters and common signs as ASCII; ``sub`` stands for what has no such form."""
    return native_fold(col(x), sub)


def fpad(x: ColumnLike, width: int | Column, side: str = "left", pad: str = " ") -> Column:
    """At least so many characters; nothing is cut. On both sides the left gets the smaller half."""
    if len(pad) != 1:
        raise ValueError("pad is one character")
    n = F.greatest(_n(width) - F.char_length(col(x)), lit(0)).cast("int")
    left, right = {"left": (n, lit(0)), "right": (lit(0), n), "both": (F.floor(n / 2).cast("int"), (n - F.floor(n / 2)).cast("int"))}[side]
    return F.concat(F.repeat(lit(pad), left), col(x), F.repeat(lit(pad), right))


def freplace_tokens(x: ColumnLike, old: Sequence[str], new: Sequence[str], ignore_case: bool = False) -> Column:
    """Whole words replaced by a dictionary in one pass; the first of equal keys counts; an empty word goes."""
    table: dict[str, str] = {}
    for a, b in zip(old, new, strict=True):
        table.setdefault(kernels.ascii_lower(a) if ignore_case else a, b)
    if len(table) > FEW:
        return each("string", kernels.replace_tokens, table, ignore_case)(col(x))
    names = F.create_map(*[lit(v) for kv in table.items() for v in kv])
    put = lambda t: F.coalesce(F.try_element_at(names, ascii_lower(t) if ignore_case else t), t)
    return fsquish(F.array_join(F.filter(F.transform(tokens(x), put), lambda t: t != ""), " "))


def fupper(x: ColumnLike) -> Column:
    return F.upper(col(x))


def flower(x: ColumnLike) -> Column:
    return F.lower(col(x))


def ftitle_case(x: ColumnLike, style: str = "name", particles: Sequence[str] | None = None) -> Column:
    """Title case; names keep particles small between words, Mc and O' prefixes, and Roman numerals."""
    if style not in ("name", "simple"):
        raise ValueError("style is name or simple")
    return each("string", kernels.title_case, style == "name", tuple(kernels.PARTICLES if particles is None else particles))(col(x))


def url_encode(x: ColumnLike, reserved: bool = False, repeated: bool = False) -> Column:
    """Percent-encoding; reserved characters stay unless ``reserved``, encoded texts stay unless ``repeated``."""
    return each("string", kernels.url_encode, reserved, repeated)(col(x))


def url_decode(x: ColumnLike, plus: bool = False) -> Column:
    """Percent-decoding; broken escapes stay; ``plus`` makes + a space."""
    return each("string", kernels.url_decode, plus)(col(x))


def html_unescape(x: ColumnLike) -> Column:
    return each("string", kernels.html_unescape)(col(x))


def html_escape(x: ColumnLike, attribute: bool = False) -> Column:
    """&, < and > as entities; in attributes quotes and line ends as well."""
    y = col(x)
    for a, b in [("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")] + [('"', "&quot;"), ("'", "&#39;"), ("\r", "&#13;"), ("\n", "&#10;")] * attribute:
        y = F.replace(y, lit(a), lit(b))
    return y


def token_counts(df: DataFrame, x: ColumnLike, ignore_case: bool = False, min_count: int = 1) -> DataFrame:
    """Of every word: token, n, docs (rows that hold it), most frequent first.

    A row's words are sorted, so the first of equal ones is known where it stands, and one shuffle of partial sums by word is all.
    """
    words = F.sort_array(tokens(ascii_lower(col(x)) if ignore_case else x))
    before = F.concat(F.array(lit(None).cast("string")), words)
    held = df.select(F.inline(F.arrays_zip(words.alias("token"), before.alias("before")))).where("token is not null")
    out = held.groupBy("token").agg(F.count(lit(1)).alias("n"), F.count(F.when(~F.col("token").eqNullSafe(F.col("before")), 1)).alias("docs"))
    return out.where(F.col("n") >= min_count).orderBy(F.desc("n"), "token")


def token_sort(x: ColumnLike, unique: bool = False, decreasing: bool = False) -> Column:
    """Words in the order of their bytes."""
    words = F.array_distinct(tokens(x)) if unique else tokens(x)
    return F.array_join(F.sort_array(words, asc=not decreasing), " ")


def token_initials(x: ColumnLike, sep: str = "") -> Column:
    return F.array_join(F.transform(tokens(x), lambda t: F.substring(t, 1, 1)), sep)


def freverse(x: ColumnLike) -> Column:
    """Reversed; combining marks stay with their letters."""
    clusters = F.regexp_extract_all(col(x), lit(r"(?s)\P{M}\p{M}*|\p{M}+"), lit(0))
    return F.array_join(F.reverse(clusters), "")


def _longest(x: ColumnLike, table: Sequence[str], ignore_case: bool, end: bool) -> Column:
    if len(table) > FEW:
        return each("int", kernels.longest_affix, tuple(table), ignore_case, end)(col(x))
    y = ascii_lower(col(x)) if ignore_case else col(x)
    fold = kernels.ascii_lower if ignore_case else (lambda s: s)
    test = F.endswith if end else F.startswith
    order = sorted(range(len(table)), key=lambda i: (-len(table[i].encode()), i))
    return F.coalesce(*[F.when(test(y, lit(fold(table[i]))), lit(i + 1)) for i in order], lit(None).cast("int"))


def longest_prefix(x: ColumnLike, prefixes: Sequence[str], ignore_case: bool = False) -> Column:
    """Number, from 1, of the longest entry that the text starts with."""
    return _longest(x, prefixes, ignore_case, False)


def longest_suffix(x: ColumnLike, suffixes: Sequence[str], ignore_case: bool = False) -> Column:
    return _longest(x, suffixes, ignore_case, True)


def fparse_number(x: ColumnLike, decimal_mark: str = ".", grouping_mark: str | None = ",") -> Column:
    """The first number in a text. A minus before it counts unless it joins it to a letter or digit."""
    quote = lambda s: java_pattern(s, fixed=True)
    group = f"(?:{quote(grouping_mark)})?" if grouping_mark else ""
    point = quote(decimal_mark)
    number = rf"(?:[0-9](?:{group}[0-9])*(?:{point}[0-9]+)?|{point}[0-9]+)(?:[eE][+-]?[0-9]+)?"
    before, found = F.regexp_extract(col(x), rf"\A((?s:.*?))({number})", 1), F.regexp_extract(col(x), rf"\A((?s:.*?))({number})", 2)
    if grouping_mark:
        found = F.replace(found, lit(grouping_mark), lit(""))
    value = F.replace(found, lit(decimal_mark), lit(".")).try_cast("double")
    minus = before.rlike("(?:\\A|[^0-9A-Za-z])[-\u2212][^0-9A-Za-z+\u2212-]*\\z")
    return F.when(minus, -value).otherwise(value)


def _digit(x: Column, i: int) -> Column:
    return F.ascii(F.substring(x, i, 1)) - 48


def _weighted(x: Column, weights: Sequence[int], start: int = 1) -> Column:
    return sum((_digit(x, start + i) * w for i, w in enumerate(weights)), lit(0))


def _ean(x: Column) -> Column:
    body = F.reverse(x)
    total = sum((F.when(F.char_length(x) > i, _digit(body, i + 1) * (3 if i % 2 else 1)).otherwise(0) for i in range(1, 14)), lit(0))
    return x.rlike(r"\A(?:\d{8}|\d{12,14})\z") & (F.pmod(10 - total, lit(10)) == _digit(body, 1))


def _luhn(x: Column) -> Column:
    digits = F.transform(F.split(F.reverse(x), ""), lambda d: F.ascii(d) - 48)
    part = F.transform(digits, lambda d, i: F.when(i % 2 == 0, d).when(d > 4, d * 2 - 9).otherwise(d * 2))
    return x.rlike(r"\A[0-9]+\z") & (F.aggregate(part, lit(0), lambda a, d: a + d) % 10 == 0)


def valid_id(x: ColumnLike, type: str = "luhn") -> Column:  # noqa: A002
    """Whether the check digits of an identifier hold; blanks and hyphens do not count."""
    y = F.regexp_replace(col(x), r"[ \-\t\n\r\f\x0B.]" if type == "iban" else r"[ \-\t\n\r\f\x0B]", "")
    nine, digits = y.rlike(r"\A[0-9]{9}\z"), y.rlike(r"\A[0-9]*\z")
    if type == "luhn":
        return _luhn(y)
    if type == "abn":
        left = 11 + F.pmod(-_weighted(y, (3, 5, 7, 9, 11, 13, 15, 17, 19), 3) - 1, lit(89))
        return y.rlike(r"\A[0-9]{11}\z") & (left == _digit(y, 1) * 10 + _digit(y, 2))
    if type == "acn":
        return nine & (F.pmod(_weighted(y, range(-8, 0)), lit(10)) == _digit(y, 9))
    if type == "tfn":
        return F.when(y.rlike(r"\A[0-9]{8}\z"), lit(None).cast("boolean")).otherwise(digits & nine & (_weighted(y, (1, 4, 3, 7, 5, 8, 6, 9, 10)) % 11 == 0))
    if type == "medicare":
        return y.rlike(r"\A[2-6][0-9]{9,10}\z") & (_weighted(y, (1, 3, 7, 9, 1, 3, 7, 9)) % 10 == _digit(y, 9))
    if type == "isbn":
        z = F.upper(y)
        z = F.when(F.char_length(z) == 9, F.concat(lit("0"), z)).otherwise(z)
        check = _weighted(z, range(1, 10)) % 11
        ten = z.rlike(r"\A[0-9]{9}[0-9X]\z") & (F.when(check == 10, F.substring(z, 10, 1) == "X").otherwise(_digit(z, 10) == check))
        return ten | (z.rlike(r"\A97[89][0-9]{10}\z") & _ean(z))
    if type == "ean":
        return _ean(y)
    if type == "iban":
        return each("boolean", kernels.valid_iban)(F.upper(y))
    raise ValueError("no such kind of identifier")


def string_shape(x: ColumnLike, collapse: bool = False, ignore_case: bool = False) -> Column:
    """A for capitals, a for other letters, 9 for digits; marks go, the rest stays."""
    y = F.regexp_replace(col(x), r"\p{M}+", "")
    y = y if ignore_case else F.regexp_replace(y, r"[\p{Lu}\p{Lt}]", "\ue000")
    y = F.regexp_replace(F.regexp_replace(y, r"\p{L}", "a"), r"\p{Nd}", "9")
    y = F.replace(y, lit("\ue000"), lit("A"))
    return F.regexp_replace(y, r"(?s)([Aa9])\1+" if collapse else r"(?!)", "$1") if collapse else y


def fhash(x: ColumnLike, algo: str = "sha256", key: str | None = None, seed: int = 0) -> Column:
    """Hexadecimal digest of the text in UTF-8; with a key the keyed digest (HMAC)."""
    raw = F.encode(col(x), "UTF-8")
    if algo == "xxh64":
        if key is not None:
            raise ValueError("xxh64 takes no key")
        return each("string", kernels.xxh64, seed)(col(x))
    digest = {"sha256": lambda c: F.sha2(c, 256), "sha512": lambda c: F.sha2(c, 512), "sha1": F.sha1, "md5": F.md5}[algo]
    if key is None:
        return digest(raw)
    size = 128 if algo == "sha512" else 64
    own = key.encode()
    own = (hashlib.new(algo, own).digest() if len(own) > size else own).ljust(size, b"\0")
    inner, outer = (lit(bytearray(b ^ pad for b in own)) for pad in (0x36, 0x5C))
    return digest(F.concat(outer, F.unhex(digest(F.concat(inner, raw)))))


def _key_text(x: ColumnLike) -> Column:
    y = native_fold(F.lower(F.trim(fsquish(x))))
    return F.regexp_replace(F.lower(y), r"[\p{Punct}\p{P}\x00-\x08\x0A-\x1F\x7F-\x9F]", "")


def fingerprint(x: ColumnLike) -> Column:
    """Key of a text: small letters without marks and punctuation, its different words in order."""
    return token_sort(_key_text(x), unique=True)


def ngram_fingerprint(x: ColumnLike, n: int = 2) -> Column:
    """The same from the different runs of ``n`` characters; a shorter text is its own key."""
    y = F.regexp_replace(_key_text(x), WHITE, "")
    grams = F.transform(F.sequence(lit(1), F.char_length(y) - (n - 1)), lambda i: F.substring(y, i, lit(n)))
    return F.when(F.char_length(y) < n, y).otherwise(F.array_join(F.sort_array(F.array_distinct(grams)), ""))
