"""Fragments of DuckDB SQL from which the comparison queries are put together."""

from __future__ import annotations

import re

from versemill.functions import tables as T


def q(text: str) -> str:
    """A string literal; control characters become chr() calls."""
    out, plain = [], ""
    for c in text:
        if ord(c) < 32:
            out += ["'" + plain.replace("'", "''") + "'", f"chr({ord(c)})"]
            plain = ""
        else:
            plain += c
    out.append("'" + plain.replace("'", "''") + "'")
    return "(" + " || ".join(out) + ")" if len(out) > 1 else out[0]


def array(items) -> str:
    return "[" + ", ".join(q(x) for x in items) + "]"


def strip(x: str) -> str:
    return f"regexp_replace({x}, {q(f'^{T.WS}+|{T.WS}+$')}, '', 'g')"


def squeeze(x: str) -> str:
    return strip(f"regexp_replace({x}, {q(T.WS + '+')}, ' ', 'g')")


def tokens(x: str, punctuation: str = T.PUNCT) -> str:
    edge = q(f"^{punctuation}+|{punctuation}+$")
    return f"list_filter(list_transform(regexp_split_to_array({x}, {q(T.WS + '+')}), lambda w: lower(regexp_replace(w, {edge}, '', 'g'))), lambda w: w <> '')"


def words(x: str, pattern: str = T.WORD) -> str:
    return f"regexp_extract_all(lower({x}), {q(pattern)})"


def tone(x: str) -> str:
    mark = f"regexp_extract({x}, {q(f'[{T.TONAL}]')}, 0)"
    cases = " ".join(f"WHEN contains({q(chars)}, {mark}) THEN {q(name)}" for name, chars in T.OF_TONE.items())
    return f"(CASE WHEN {x} = '' THEN 'unknown' WHEN {mark} = '' THEN 'ngang' {cases} END)"


def bang(x: str) -> str:
    return f"({tone(x)} IN ('ngang', 'huyền'))"


def trac(x: str) -> str:
    return f"({tone(x)} IN ('sắc', 'hỏi', 'ngã', 'nặng'))"


def detoned(x: str) -> str:
    for long, bare in T.DETONE_LONG.items():
        x = f"replace({x}, {q(long)}, {q(bare)})"
    return f"translate({x}, {q(T.DETONE[0])}, {q(T.DETONE[1])})"


def rhyme(x: str) -> str:
    rest = f"regexp_replace({detoned(x)}, {q('^(' + '|'.join(T.ONSETS) + ')')}, '')"
    return f"(CASE WHEN length({rest}) > 2 AND regexp_matches({rest}, '^[uo][aeioâă]') THEN substr({rest}, 2) ELSE {rest} END)"


def kind(a: str, b: str) -> str:
    """exact, slant or null for two extracted rhymes."""
    table = "MAP {" + ", ".join(f"{q(k)}: {q(v)}" for k, v in T.SLANT_CANON.items()) + "}"
    pairs = ", ".join(f"({q(x)}, {q(y)}), ({q(y)}, {q(x)})" for x, y in T.SLANT_PAIRS)
    canon = lambda x: f"coalesce({table}[{x}], {x})"
    return f"(CASE WHEN {a} = '' OR {b} = '' THEN NULL WHEN {a} = {b} THEN 'exact' WHEN {canon(a)} = {canon(b)} OR ({a}, {b}) IN ({pairs}) THEN 'slant' END)"


def marks(x: str) -> str:
    return f"(length(regexp_replace({x}, {q(f'[^{T.TONAL}]')}, '', 'g')) + length(regexp_replace({x}, {q(f'[^{T.DOUBLE}]')}, '', 'g')))"


def syllable(x: str) -> str:
    return f"(regexp_matches({x}, {q(f'^[{T.SYLLABLE_LETTERS}]+$')}) AND {marks(x)} <= 1)"


def lexicon(x: str) -> str:
    bare = f"translate({x}, {q(T.UNACCENT[0])}, {q(T.UNACCENT[1])})"
    return f"({syllable(x)} AND regexp_matches({bare}, '[aeiouy]') AND (NOT regexp_matches({bare}, '[^aeiouy]{{3}}') OR starts_with({bare}, 'ngh')) AND NOT regexp_matches({bare}, '[aeiouy]{{4}}'))"


def line_table(table: str, key: str, text: str = "text", punctuation: str = T.PUNCT, source: str = "") -> str:
    """A query for (id, pos, tk): the words of each line that has some, pos counting such lines from 0."""
    extra = f", {source}" if source else ""
    split = f"SELECT {key} AS id{extra}, unnest(string_split(nfc_normalize({text}), chr(10))) AS line, generate_subscripts(string_split(nfc_normalize({text}), chr(10)), 1) AS ord0 FROM {table} WHERE {text} IS NOT NULL"
    cleaned = f"SELECT id{extra}, ord0, {tokens('line', punctuation)} AS tk FROM ({split})"
    return f"SELECT id{extra}, row_number() OVER (PARTITION BY id ORDER BY ord0) - 1 AS pos, tk FROM ({cleaned}) WHERE len(tk) > 0"


def fill(text: str, **values: str) -> str:
    """A text with names in braces as a concatenation of literals and expressions; null if one of them is."""
    out = []
    for k, part in enumerate(re.split(r"\{([a-z_0-9]+)\}", text)):
        if k % 2:
            out.append(f"(({values[part]})::VARCHAR)")
        elif part:
            out.append(q(part))
    return "(" + " || ".join(out) + ")"
