"""Character tables and word lists behind the column functions.

Tables of characters are built from Unicode data by rule. Lists under "fixed values" decide results
and are given as they are.
"""

from __future__ import annotations

import string
import unicodedata

# Combining tone marks.
TONE_MARKS = {"̀": "huyền", "́": "sắc", "̃": "ngã", "̉": "hỏi", "̣": "nặng"}
BANG, TRAC = ("ngang", "huyền"), ("sắc", "hỏi", "ngã", "nặng")

# Onsets in match order.
ONSETS = ["ngh", "tr", "th", "ch", "ph", "nh", "kh", "gh", "gi", "ng", "qu", *"bcdđghklmnprstvx"]

# Rhymes that pass for another (one step), and pairs that pass for each other.
SLANT_CANON = {
    "y": "i", "ye": "ie", "ya": "ia", "uo": "ua", "uơ": "ưa", "e": "ê", "en": "ên", "et": "êt", "o": "ô", "on": "ôn",
    "ot": "ôt", "om": "ôm", "au": "âu", "an": "ân", "am": "âm", "anh": "ang", "ach": "ac", "inh": "ing", "ich": "ic",
}
SLANT_PAIRS = [("ơi", "ươi"), ("ai", "oai"), ("uân", "ân"), ("ang", "âng")]

# Vowels that are no word by themselves.
ORPHAN_VOWELS = ["ă", "â", "ê", "ô", "ơ", "ư"]

# Recipients and keywords with the phrases that count for them.
RECIPIENTS = {
    "ông bà": ["ông bà", "bà ông"],
    "cha mẹ": ["cha mẹ", "mẹ cha", "ba mẹ", "mẹ ba", "bố mẹ", "mẹ bố"],
    "bố mẹ": ["bố mẹ", "mẹ bố", "ba mẹ", "mẹ ba", "cha mẹ", "mẹ cha"],
    "ba mẹ": ["ba mẹ", "mẹ ba", "bố mẹ", "mẹ bố", "cha mẹ", "mẹ cha"],
    "thầy cô": ["thầy cô", "cô thầy"],
    "anh chị": ["anh chị", "chị anh"],
    "con cháu": ["con cháu", "cháu con"],
}
KEYWORD_ALIASES = {
    "con cháu": ["cháu con", "trẻ nhỏ", "trẻ con", "đàn trẻ", "trẻ"],
    "sum vầy": ["quây quần", "đoàn viên", "tụ họp", "đầm ấm"],
    "lộc xuân": ["lộc mới", "lộc biếc", "mầm lộc", "chồi lộc"],
    "bình an": ["an lành", "yên bình", "an yên"],
    "vui khỏe": ["khỏe vui", "mạnh khỏe", "khỏe mạnh"],
    "mai vàng": ["hoa mai", "mai nở", "cành mai"],
}

# Words that are no keywords; foreign tokens kept out of the lexicon.
STOP_WORDS = ["bài", "thơ", "lục", "bát", "về", "và", "của", "cho", "một", "những", "trong", "người", "đời", "em", "anh", "tôi", "đã", "là", "có"]

# What makes a page or window one of the season.
SEASON = ["tết", "xuân", "năm mới", "giao thừa", "an khang", "phúc", "lộc", "thọ", "mừng tuổi", "lì xì"]

# The anchors that stand in when a proposal fails.
SCAFFOLD_KEYS = ["line_1_end", "line_2_sixth", "line_2_end", "line_3_end", "line_4_sixth"]
DEFAULT_SCAFFOLD = ["xuân", "xuân", "nhà", "qua", "ca"]

# Weights of the metrics and of the ranking.
METRIC_WEIGHTS = {"scr": 0.4, "tcr": 0.3, "rma": 0.3}
RANK_WEIGHTS = {"evaluator": 0.80, "diversity": 0.05, "cliche": 0.10, "keyword": 0.03, "length": 0.02}


def _marks(c: str) -> list[str]:
    return [TONE_MARKS[m] for m in unicodedata.normalize("NFD", c) if m in TONE_MARKS]


def _bare(c: str) -> str:
    return unicodedata.normalize("NFC", "".join(m for m in unicodedata.normalize("NFD", c) if m not in TONE_MARKS))


#: Lower-case characters that carry a tone mark, composed, then the marks alone.
COMPOSED = [c for c in map(chr, range(0x80, 0x2000)) if c == c.lower() and _marks(c) and c not in TONE_MARKS and unicodedata.normalize("NFC", c) == c]
TONAL = "".join(COMPOSED) + "".join(TONE_MARKS)
OF_TONE = {t: "".join(c for c in TONAL if _marks(c)[0] == t) for t in ("huyền", "sắc", "hỏi", "ngã", "nặng")}
DOUBLE = "".join(c for c in COMPOSED if len(_marks(c)) == 2)
#: Characters whose bare form is one character, and those few where it is two.
_ONE = [c for c in COMPOSED if len(_bare(c)) == 1]
DETONE = ("".join(_ONE) + "".join(TONE_MARKS), "".join(map(_bare, _ONE)))
DETONE_LONG = {c: _bare(c) for c in COMPOSED if len(_bare(c)) > 1}
#: All accents off, for the lexicon test; đ stays.
_ACCENTED = [c for c in map(chr, range(0xC0, 0x1F00)) if c == c.lower() and unicodedata.normalize("NFD", c)[0] != c]
UNACCENT = ("".join(_ACCENTED), "".join(unicodedata.normalize("NFD", c)[0] for c in _ACCENTED))
#: Letters of a syllable, in lower case: no f, j, w, z.
SYLLABLE_LETTERS = "abcdeghiklmnopqrstuvxyđ" + "".join(sorted({unicodedata.normalize("NFC", v + t) for v in "aăâeêioôơuưy" for t in ["", *TONE_MARKS]}))

#: White space and punctuation classes in the syntax that Java and RE2 share.
WS = r"[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
_ascii = "".join("\\" + c for c in string.punctuation)
PUNCT_CORPUS = "[" + _ascii + "“”‘’…–—]"
PUNCT = "[" + _ascii + "“”‘’…–—«»·]"
#: The letters of the three word patterns; one range is of raw code points.
WORD = r"[a-z\x{e0}-\x{1ef9}đ]+"
WORD_ANY = r"[a-zA-Z\x{c0}-\x{1ef9}Đđ]+"
#: Line ends of any kind.
LINE_END = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x{85}\x{2028}\x{2029}]"
EDGE = r"[^\p{L}\p{N}_]"

# Foreign tokens that look like syllables and are kept out of the lexicon. Words such as "in", "an",
# "so", "to" and "no" are syllables of the language and stay.
FOREIGN = [
    "the", "and", "guy", "led", "dien", "a", "i",
    "you", "your", "have", "has", "with", "this", "that",
    "they", "there", "not", "for", "are", "but", "his",
    "her", "she", "which", "will", "what", "who", "when",
]
