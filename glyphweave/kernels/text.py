"""Text functions that the JVM's built-in ones do not cover, one text at a time."""

from __future__ import annotations

import html
import re
import unicodedata
from functools import lru_cache
from urllib.parse import quote, unquote_to_bytes

import xxhash

_FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
#: Words that stay small between the words of a name.
PARTICLES = ("af", "av", "da", "das", "de", "del", "della", "den", "der", "di", "do", "dos", "du", "la", "le", "ten", "ter", "the", "van", "von", "zu", "and", "of")
#: Roman numerals that stay capitals after a name.
ROMAN = ("II", "III", "IV", "V", "VI", "VII", "VIII", "IX", "X", "XI", "XII", "XIII")
_WORD = re.compile(r"(?:[^\W_](?:['\u2019](?=[^\W_]))?[\u0300-\u036f]*)+")
#: Country codes and the national part of their account numbers, n digit, a letter, c either, with counts.
IBAN = (
    "AD n8c12,AE n19,AL n8c16,AT n16,AZ a4c20,BA n16,BE n12,BG a4n6c8,BH a4c14,BI n23,BR n23a1c1,BY c4n4c16,CH n5c12,CR n18,CY n8c16,CZ n20,DE n18,DJ n23,DK n14,DO c4n20,EE n16,EG n25,"
    "ES n20,FI n14,FK a2n12,FO n14,FR n10c11n2,GB a4n14,GE a2n16,GI a4c15,GL n14,GR n7c16,GT c24,HN a4n20,HR n17,HU n24,IE a4n14,IL n19,IQ a4n15,IS n22,IT a1n10c12,JO a4n4c18,KW a4c22,KZ n3c13,"
    "LB n4c20,LC a4c24,LI n5c12,LT n16,LU n3c13,LV a4c13,LY n21,MC n10c11n2,MD c20,ME n18,MK n3c10n2,MN n16,MR n23,MT a4n5c18,MU a4n19a3,NI a4n20,NL a4n10,NO n11,OM n3c16,PK a4c16,PL n24,PS a4c21,PT n21,"
    "QA a4c21,RO a4c16,RS n18,RU n14c15,SA n2c18,SC a4n18a3,SD n14,SE n20,SI n15,SK n20,SM a1n10c12,SO n19,ST n21,SV a4n20,TL n19,TN n20,TR n6c16,UA n6c19,VA n18,VG a4n16,XK n16"
)


def ascii_lower(text: str) -> str:
    return text.translate(_FOLD)


def width(text: str) -> int:
    return sum(0 if unicodedata.combining(c) or unicodedata.category(c) in ("Cf", "Cc") else 2 if unicodedata.east_asian_width(c) in "WF" else 1 for c in text)


def expand_ranges(text: str) -> str:
    """a-e as abcde."""
    out, i = "", 0
    while i < len(text):
        if text[i + 1 : i + 2] == "-" and i + 2 < len(text):
            if text[i] > text[i + 2]:
                raise ValueError("a range runs backwards")
            out += "".join(map(chr, range(ord(text[i]), ord(text[i + 2]) + 1)))
            i += 3
        else:
            out += text[i]
            i += 1
    return out


def replace_tokens(text: str, table: dict[str, str], fold: bool) -> str:
    return " ".join(" ".join(table.get(ascii_lower(t) if fold else t, t) for t in text.split()).split())


def _title_word(word: str, names: bool) -> str:
    small = word.lower()
    forced = names and len(word.encode()) >= 3 and (small[1] in "'\u2019" or small[:2] == "mc") and small[0].isascii()
    out = (small[0].title() if word[0].lower() != word[0].upper() else small[0]) + small[1:]
    return out[:2] + out[2:3].title() + out[3:] if forced else out


def title_case(text: str, names: bool, particles: tuple[str, ...]) -> str:
    found = list(_WORD.finditer(text))
    out, at = "", 0
    for k, m in enumerate(found):
        word = m[0]
        if names and k and word.upper() in ROMAN and len(word) > 1:
            new = word.upper()
        elif names and 0 < k < len(found) - 1 and word.lower() in particles:
            new = word.lower()
        else:
            new = _title_word(word, names)
        out += text[at : m.start()] + new
        at = m.end()
    return out + text[at:]


def url_encode(text: str, reserved: bool, repeated: bool) -> str:
    if not repeated and re.search("%[0-9A-Fa-f]{2}", text):
        return text
    return quote(text, safe="-._~" + "" if reserved else "-._~:/?#[]@!$&'()*+,;=")


def url_decode(text: str, plus: bool) -> str:
    return unquote_to_bytes(text.replace("+", " ") if plus else text).decode("utf-8", "replace")


def html_unescape(text: str) -> str:
    return html.unescape(text) if "&" in text else text


@lru_cache(maxsize=8)
def _by_length(table: tuple[str, ...], fold: bool) -> tuple[list[int], dict[str, int]]:
    place: dict[str, int] = {}
    for i, t in enumerate(table):
        place.setdefault(ascii_lower(t) if fold else t, i + 1)
    return sorted({len(t) for t in place}, reverse=True), place


def longest_affix(text: str, table: tuple[str, ...], fold: bool, end: bool) -> int | None:
    text = ascii_lower(text) if fold else text
    lengths, place = _by_length(table, fold)
    for n in lengths:
        if n <= len(text) and (found := place.get(text[len(text) - n :] if end else text[:n])):
            return found
    return None


@lru_cache(maxsize=1)
def _ibans() -> dict[str, re.Pattern]:
    kinds = {"n": "[0-9]", "a": "[A-Z]", "c": "[A-Z0-9]"}
    told = (x.split(" ") for x in IBAN.split(","))
    return {country: re.compile(re.sub(r"([nac])(\d+)", lambda m: f"{kinds[m[1]]}{{{m[2]}}}", form)) for country, form in told}


def valid_iban(text: str) -> bool:
    if not re.fullmatch("[0-9A-Z]{4,}", text):
        return False
    if int("".join(str(int(c, 36)) for c in text[4:] + text[:4])) % 97 != 1:
        return False
    form = _ibans().get(text[:2])
    return form is not None and form.fullmatch(text[4:]) is not None


def xxh64(text: str, seed: int) -> str:
    return xxhash.xxh64_hexdigest(text.encode(), seed)
