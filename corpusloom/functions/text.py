"""Text functions, Column -> Column. Patterns are Java's; each has an equal RE2 pattern in the plans' SQL."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters that mark a language, as the detector defines them.
SPANISH = "Ññáéíóúü"
INVERTED = "¡¿"
FRENCH = "ÀÂÇÈÉÊËÎÏÔÙÛÜŸàâçèéêëîïôùûüœæ"
ARABIC, CJK, GREEK, LATIN = r"؀-ۿݐ-ݿࢠ-ࣿ", r"一-鿿", r"Ͱ-Ͽἀ-῿", r"A-Za-zÀ-ɏ"
# Letter to sounds, and sound to spelling.
SOUNDS = {"a": "AH", "b": "B", "c": "K", "d": "D", "e": "EH", "f": "F", "g": "G", "h": "HH", "i": "IH", "j": "JH", "k": "K", "l": "L", "m": "M", "n": "N", "o": "AA", "p": "P", "q": "K", "r": "R", "s": "S", "t": "T", "u": "AH", "v": "V", "w": "W", "x": "K S", "y": "Y", "z": "Z"}
SPELLINGS = {"AA": "a", "AE": "a", "AH": "u", "AO": "o", "AW": "ow", "AY": "ay", "B": "b", "CH": "ch", "D": "d", "DH": "th", "EH": "e", "ER": "er", "EY": "ey", "F": "f", "G": "g", "HH": "h", "IH": "i", "IY": "ee", "JH": "j", "K": "k", "L": "l", "M": "m", "N": "n", "NG": "ng", "OW": "o", "OY": "oy", "P": "p", "R": "r", "S": "s", "SH": "sh", "T": "t", "TH": "th", "UH": "oo", "UW": "oo", "V": "v", "W": "w", "Y": "y", "Z": "z", "ZH": "zh", "<blank>": ""}


def normalize_punct(c: Column) -> Column:
    """BOM and no-break space to space, curly quotes and dashes to ASCII."""
    return F.translate(c, "﻿ ‘’“”–—", "  ''\"\"--")


def count_class(c: Column, chars: str) -> Column:
    """Characters of a regex class."""
    return F.length(F.regexp_replace(c, f"[^{chars}]", ""))


def detect_language(c: Column, inverted: bool, other: str) -> Column:
    """Script, then accent marks; `inverted`: whether the Spanish inverted signs count (two callers differ)."""
    es, fr = count_class(c, SPANISH + (INVERTED if inverted else "")), count_class(c, FRENCH)
    return (
        F.when(c.rlike(f"[{ARABIC}]"), "arabic").when(c.rlike(f"[{CJK}]"), "chinese").when(c.rlike(f"[{GREEK}]"), "greek")
        .when(~c.rlike(f"[{LATIN}]"), other).when(es > fr, "spanish").when(fr > 0, "french").otherwise("english")
    )


KEPT = {"english": rf"a-z0-9' À-ɏ", "greek": r" Ͱ-Ͽἀ-῿0-9'", "arabic": rf" {ARABIC}0-9'", "chinese": rf" {CJK}0-9'"}


def normalize(c: Column, language: str = "auto", lowercase: bool = True, strip_bracketed: bool = False, strip_speaker: bool = False, remove_urls: bool = False) -> Column:
    """The label normaliser, in its fixed order. The speaker tag is only taken from the first line (no multi-line flag)."""
    c = normalize_punct(c)
    if remove_urls:
        c = F.regexp_replace(c, r"(?U)(https?://\S+|www\.\S+)", " ")
    if strip_speaker:
        c = F.regexp_replace(c, r"(?U)^\s*[A-Z0-9_]{2,20}:\s*", "")
    if strip_bracketed:
        c = F.regexp_replace(c, r"\[[^\]]*\]|\([^\)]*\)|<[^>]*>", " ")
    lang = detect_language(c, False, "auto") if language == "auto" else F.lit(language)
    low = F.lower(c) if lowercase else c
    only = lambda k: F.regexp_replace(low, f"[^{KEPT[k]}]+", " ")
    out = (
        F.when(lang.isin("english", "spanish", "french"), only("english")).when(lang == "greek", only("greek"))
        .when(lang == "arabic", only("arabic")).when(lang == "chinese", only("chinese"))
        .otherwise(F.regexp_replace(low, r"[^\p{L}\p{N} ']", " "))
    ) if language == "auto" else only("english" if language in ("spanish", "french") else language)
    return F.trim(F.regexp_replace(out, r"(?U)\s+", " "))


def tokens(c: Column) -> Column:
    """Words of a normalised text; none for an empty one."""
    return F.array_remove(F.split(c, r"\s+"), "")


def longest_run(c: Column) -> Column:
    """Length of the longest run of one character."""
    return F.coalesce(F.array_max(F.transform(F.regexp_extract_all(c, F.lit(r"(?s)((.)\2*)"), 1), F.length)), F.lit(0))


def char_normalize(c: Column) -> Column:
    """Lower case, apostrophes unified, everything but a-z, apostrophe and space to a space, collapsed."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.translate(F.lower(c), "’‘`", "'''"), r"[^a-z'\s]", " "), r"\s+", " "))


def clean_word(c: Column) -> Column:
    """Stripped, then without other characters, then with white space collapsed: a space may stay at an end."""
    inner = F.regexp_replace(c, r"(?U)\A[\s\x1c-\x1f]+|[\s\x1c-\x1f]+\z", "")
    return F.regexp_replace(F.regexp_replace(inner, r"[^a-zA-Z0-9' -]+", ""), " +", " ")


def safe_stem(c: Column) -> Column:
    """Of a path: its last part less the last suffix, other characters as _, bare of dots and _ at the ends."""
    name = F.regexp_extract(F.regexp_replace(c, "/+$", ""), "([^/]*)$", 1)
    stem = F.regexp_replace(name, r"(?s)^(.+)\.[^.]+$", "$1")
    out = F.regexp_replace(F.regexp_replace(stem, r"[^A-Za-z0-9_.-]+", "_"), r"^[._]+|[._]+$", "")
    return F.when(out == "", "video").otherwise(out)


def strip_markup(c: Column) -> Column:
    """Caption text without tags and bracketed notes."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.regexp_replace(c, r"<[^>]+>", ""), r"\[[^\]]+\]", ""), r"\s+", " "))


def soundex(c: Column) -> Column:
    """The simplified key: vowels, H and W all break runs and the first letter is not merged; '' for non-ASCII words."""
    up = F.upper(F.regexp_replace(c, r"[^A-Za-z]", ""))
    code = F.translate(up.substr(F.lit(2), F.length(up)), "BFPVCGJKQSXZDTLMNRAEIOUHWY", "11112222222233455600000000")
    code = F.regexp_replace(F.regexp_replace(code, r"([1-6])\1+", "$1"), "0", "")
    key = F.substring(F.concat(F.substring(up, 1, 1), code, F.lit("000")), 1, 4)
    return F.when(c.rlike(r"[^\x00-\x7F]") | (up == ""), "").otherwise(key)


def _lookup(values: dict) -> Column:
    return F.create_map(*[F.lit(x) for kv in values.items() for x in kv])


def phonemes(c: Column) -> Column:
    """Sounds of a text's letters; other characters have none."""
    letters = F.split(F.regexp_replace(F.lower(c), "[^a-z]", ""), "")
    return F.flatten(F.transform(F.array_remove(letters, ""), lambda x: F.split(F.element_at(_lookup(SOUNDS), x), " ")))


def grapheme_hint(sounds: Column) -> Column:
    return F.array_join(F.transform(sounds, lambda x: F.coalesce(F.element_at(_lookup(SPELLINGS), x), F.lit(""))), "")


def ctc_frames(c: Column) -> Column:
    """Least number of frames for a text: its length and one blank between equal neighbours."""
    return F.length(c) + F.length(c) - F.length(F.regexp_replace(c, r"(?s)(.)(?=\1)", ""))


def edit_distance(a: Column, b: Column, most: int | None = None) -> Column:
    """Levenshtein distance; over `most`: most + 1."""
    if most is None:
        return F.levenshtein(a, b)
    d = F.levenshtein(a, b, most)
    return F.when(d < 0, most + 1).otherwise(d)


def error_rate(target: Column, got: Column) -> Column:
    """Character error rate; an empty target gives 0 for an empty prediction, else 1."""
    return F.when(F.length(target) == 0, F.when(F.length(got) == 0, 0.0).otherwise(1.0)).otherwise(F.levenshtein(target, got) / F.greatest(F.lit(1), F.length(target)))


def word_edit_distance(a: Column, b: Column) -> Column:
    """Levenshtein distance of two word arrays: each distinct word becomes one character, then the built-in applies."""
    vocab = F.array_distinct(F.concat(a, b))
    one = lambda words: F.array_join(F.transform(words, lambda w: F.decode(F.unhex(F.lpad(F.hex(F.array_position(vocab, w) + 0x4E00), 4, "0")), "UTF-16BE")), "")
    return F.levenshtein(one(a), one(b))


def seconds(c: Column) -> Column:
    """H:M:S.mmm, M:S or S as seconds."""
    p = F.split(c, ":")
    num = lambda i: F.get(p, F.lit(i)).cast("double")
    return F.when(F.size(p) == 3, num(0) * 3600 + num(1) * 60 + num(2)).when(F.size(p) == 2, num(0) * 60 + num(1)).otherwise(num(0))


def srt_time(c: Column, mark: str = ",") -> Column:
    """Seconds as HH:MM:SS,mmm; milliseconds are rounded, so they can read 1000, as in the format's source."""
    whole = F.floor(c).cast("long")
    return F.concat(F.format_string("%02d", F.floor(whole / 3600)), F.lit(":"), F.lpad((F.floor(whole / 60) % 60).cast("string"), 2, "0"), F.lit(":"), F.lpad((whole % 60).cast("string"), 2, "0"), F.lit(mark), F.format_string("%03d", F.round((c - whole) * 1000).cast("int")))


def four(c: Column) -> Column:
    """Rounded to four decimals by the arithmetic that SQL engines share (exact ties go up)."""
    return F.floor(c * 10000 + 0.5) / 10000
