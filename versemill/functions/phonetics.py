"""Column functions on one syllable: tone, rhyme, validity.

All take a column in NFC and lower case, as `text.tokens` and `text.normalize_text` give it.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from versemill.functions import tables as T


def tone(syllable: Column) -> Column:
    """The tone of the first mark; ngang without one, unknown for an empty syllable."""
    return tone_of_mark(syllable, F.regexp_extract(syllable, f"[{T.TONAL}]", 0))


def tone_of_mark(syllable: Column, mark: Column) -> Column:
    """The tone of a syllable whose first character with a tone mark is known."""
    found = F.when(syllable == "", "unknown").when(mark == "", "ngang")
    for name, chars in T.OF_TONE.items():
        found = found.when(F.instr(F.lit(chars), mark) > 0, name)
    return found


def is_bang(syllable: Column) -> Column:
    return tone(syllable).isin(*T.BANG)


def is_trac(syllable: Column) -> Column:
    return tone(syllable).isin(*T.TRAC)


def tone_bit(syllable: Column) -> Column:
    """0 for ngang, 1 for huyền, 2 for trắc, null for no syllable."""
    t = tone(syllable)
    return F.when(t == "ngang", 0).when(t == "huyền", 1).when(t.isin(*T.TRAC), 2)


def detoned(syllable: Column) -> Column:
    """Without tone marks; the marks of vowels stay."""
    for long, bare in T.DETONE_LONG.items():
        syllable = F.replace(syllable, F.lit(long), F.lit(bare))
    return F.translate(syllable, *T.DETONE)


def rhyme(syllable: Column) -> Column:
    """The rhyme: without tone, onset and, before a vowel, the glide. Not for extracted rhymes."""
    return without_glide(F.regexp_replace(detoned(syllable), "^(" + "|".join(T.ONSETS) + ")", ""))


def without_glide(rest: Column) -> Column:
    glide = (F.length(rest) > 2) & rest.rlike("^[uo][aeioâă]")
    return F.when(glide, F.substring(rest, 2, 1_000_000)).otherwise(rest)


def canon(extracted: Column) -> Column:
    """What an extracted rhyme passes for."""
    table = F.create_map(*[F.lit(x) for kv in T.SLANT_CANON.items() for x in kv])
    return F.coalesce(table[extracted], extracted)


def rhyme_kind_extracted(a: Column, b: Column, strict: bool = False) -> Column:
    """exact, slant or null for two extracted rhymes; empty ones match nothing."""
    full = (a != "") & (b != "")
    kind = F.when(full & (a == b), "exact")
    if strict:
        return kind
    pairs = [F.lit("|".join(sorted(p))) for p in T.SLANT_PAIRS]
    paired = F.concat_ws("|", F.least(a, b), F.greatest(a, b)).isin(*pairs)
    return kind.when(full & ((canon(a) == canon(b)) | paired), "slant")


def rhyme_kind(a: Column, b: Column, strict: bool = False) -> Column:
    """exact, slant or null for two syllables."""
    return rhyme_kind_extracted(rhyme(a), rhyme(b), strict)


def tone_marks(syllable: Column) -> Column:
    """How many tone marks there are."""
    marks = F.length(F.regexp_replace(syllable, f"[^{T.TONAL}]", ""))
    return marks + F.length(F.regexp_replace(syllable, f"[^{T.DOUBLE}]", "")) if T.DOUBLE else marks


def is_syllable(word: Column) -> Column:
    """Letters of the alphabet only and at most one tone mark."""
    return word.rlike(f"^[{T.SYLLABLE_LETTERS}]+$") & (tone_marks(word) <= 1)


def is_lexicon_syllable(word: Column) -> Column:
    """A syllable with a vowel, no long run of consonants (but ngh at its head) or of vowels."""
    bare = F.translate(word, *T.UNACCENT)
    return is_syllable(word) & bare.rlike("[aeiouy]") & (~bare.rlike("[^aeiouy]{3}") | bare.startswith("ngh")) & ~bare.rlike("[aeiouy]{4}")
