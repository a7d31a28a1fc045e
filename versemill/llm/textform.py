"""The form in which a reader sees a text: one sequence of code points for texts that look the same.

`reader_form` decomposes, folds width, kinds of blank and line break, drops what is not visible and
composes again (NFC). Look-alike letters of other scripts are replaced when the text is written in
Latin script. Null stays null, empty stays empty; whole texts are processed.
"""

from __future__ import annotations

import re
import unicodedata

import pyarrow as pa
import pyarrow.compute as pc

# Letters of other scripts with the Latin letter that they look like.
CYRILLIC_LOOKALIKES = {
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "і": "i", "ј": "j", "ѕ": "s",
    "һ": "h", "ԁ": "d", "ԛ": "q", "ԝ": "w", "ӏ": "l", "А": "A", "В": "B", "Е": "E", "К": "K", "М": "M",
    "Н": "H", "О": "O", "Р": "P", "С": "C", "Т": "T", "У": "Y", "Х": "X", "І": "I", "Ј": "J", "Ѕ": "S",
    "Ԛ": "Q", "Ԝ": "W",
}
GREEK_LOOKALIKES = {
    "α": "a", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "υ": "u", "Α": "A", "Β": "B", "Ε": "E",
    "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y",
    "Χ": "X",
}
LATIN_LOOKALIKES = {"Ð": "Đ", "Ɖ": "Đ", "ɑ": "a", "ɡ": "g", "ı": "i"}
LOOKALIKES = CYRILLIC_LOOKALIKES | GREEK_LOOKALIKES | LATIN_LOOKALIKES
#: Blanks of any kind, line breaks of any kind.
BLANKS = "\t               　"
BREAKS = "\r\n|[\r\x0b\x0c\x85  ]"

_fold = {ord(c): " " for c in BLANKS} | {0xFF01 + i: chr(0x21 + i) for i in range(94)}
_letters = {ord(a): b for a, b in LOOKALIKES.items()}
_lookalike = re.compile("[" + "".join(LOOKALIKES) + "]")
_breaks, _blank_ends, _word = re.compile(BREAKS), re.compile(r" +(?=\n|$)"), re.compile(r"\S+")
_latin = re.compile("[A-Za-zÀ-ɏḀ-ỿ]")
_invisible = re.compile("[\u0000-\u0008\u000e-\u001b\u007f­͏؜ᅟᅠ឴឵᠋-᠎​-‏‪-‮⁠-⁯︀-️﻿]")
#: Texts of these characters alone, without stray blanks at line ends, are in reader's form already.
_PLAIN = "^[\\n\\x20-\\x7e¡-¬®-ÏÑ-İĲ-ƈƊ-ɏḀ-ỿ‐-‧‰-⁞]*$"
_STRAY = " \\n|^[ \\n]|[ \\n]$"


def decomposed(text: str) -> str:
    """NFD with width, blanks, breaks and invisible characters settled; look-alikes are still there."""
    text = unicodedata.normalize("NFD", _breaks.sub("\n", text)).translate(_fold)
    return _blank_ends.sub("", _invisible.sub("", text)).strip()


def is_latin(text: str) -> bool:
    """True if most letters that belong to one script only are Latin; look-alikes do not vote."""
    bare = _lookalike.sub("", text)
    latin = len(_latin.findall(bare))
    return latin > 0 and latin >= sum(c.isalpha() for c in bare) - latin


def fold_lookalikes(text: str) -> str:
    return text.translate(_letters)


def reader_form(text: str | None, fold: bool = True) -> str | None:
    """The form of one text; with `fold`, look-alikes in a text of Latin script become Latin."""
    if text is None:
        return None
    text = decomposed(text)
    if fold and _lookalike.search(text) and is_latin(text):
        text = fold_lookalikes(text)
    return unicodedata.normalize("NFC", text)


def reader_forms(texts: pa.Array, fold: bool = True) -> pa.Array:
    """reader_form of an Arrow array; only rows that are not plain leave Arrow."""
    texts = texts.cast(pa.string())
    odd = pc.or_(pc.invert(pc.match_substring_regex(texts, _PLAIN)), pc.match_substring_regex(texts, _STRAY))
    odd = pc.fill_null(odd, False)
    if not pc.any(odd).as_py():
        return texts
    fixed = pa.array([reader_form(x, fold) for x in pc.filter(texts, odd).to_pylist()], pa.string())
    return pc.replace_with_mask(texts, odd, fixed)


def word_lists(texts: pa.Array) -> pa.ListArray:
    """The words of each text: runs of letters and digits of its reader's form, in lower case."""
    low = pc.utf8_lower(reader_forms(texts))
    spaced = pc.replace_substring_regex(low, r"[^\p{L}\p{N}\p{M}]+", " ")
    return pc.split_pattern(pc.utf8_trim(spaced, " "), " ")
