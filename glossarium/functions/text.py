"""Text functions as column expressions. Only Unicode normalisation, of text that is not ASCII, and string similarity run
Python, a batch at a time."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType

# The white space of Unicode's basic plane, line ends, and marks that stand for a prime.
WS = r"\t-\r\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
LINE_END = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]"
PRIME = "ʹ"
APOSTROPHES = "'’ʼ`´"
ACUTE_VOWELS = "áéíóúýÁÉÍÓÚÝ"
ACCENTED = "áàâäéèêëíìîïóòôöúùûüýÿãõ"


#: The characters of WS.
SPACES = "".join(chr(k) for k in range(0x3001) if re.fullmatch(f"[{WS}]", chr(k)))


def nonblank(c: Column) -> Column:
    """Null where nothing but white space is left."""
    return F.when(strip(c) != "", c)


def strip(c: Column) -> Column:
    return F.btrim(c, F.lit(SPACES))


def squeeze(c: Column) -> Column:
    """Runs of white space as one space, none at the ends."""
    return F.trim(F.regexp_replace(c, f"[{WS}]+", " "))


def split_lines(c: Column) -> Column:
    """Lines of a text."""
    return whole_lines(F.split(c, LINE_END, -1))


def whole_lines(parts: Column) -> Column:
    """The pieces of a text between line ends; the empty piece after a last line end is no line."""
    return F.when(F.element_at(parts, -1) == "", F.slice(parts, F.lit(1), F.size(parts) - 1)).otherwise(parts)


def regex(pattern: str, ignore_case: bool = False, whole: bool = False, start: bool = False) -> str:
    """A pattern of Python's dialect in Java's: line ends, white space, digits and case as Python has them."""
    body = pattern.replace(r"\s", f"[{WS}]").replace(r"\d", r"\p{Nd}")
    body = re.sub(r"\[([^\]]*)\[([^\]]*)\]([^\]]*)\]", r"[\1\2\3]", body)  # a class within a class
    if whole:
        body = f"^(?:{body})$"
    elif start:
        body = f"^(?:{body})"
    return "(?d" + ("iu" if ignore_case else "") + ")" + body


def _by_value(text: pd.Series, change) -> pd.Series:
    """``change`` of each distinct value of a batch; a batch of nulls alone is given back as it is."""
    known = {t: change(t) for t in text.dropna().unique()}
    return text.map(known) if known else text


@F.pandas_udf(StringType())
def _normal(text: pd.Series, form: pd.Series) -> pd.Series:
    return _by_value(text, lambda t: unicodedata.normalize(form.iloc[0], t))


@F.pandas_udf(StringType())
def _bare(text: pd.Series) -> pd.Series:
    drop = lambda t: "".join(c for c in unicodedata.normalize("NFD", t) if not unicodedata.combining(c))
    return _by_value(text, lambda t: unicodedata.normalize("NFC", drop(t)))


# Spark may copy an expression into each filter and projection above it; of a nondeterministic one it keeps one copy, so
# that a batch goes to Python once.
_normal, _bare = _normal.asNondeterministic(), _bare.asNondeterministic()

ASCII_ONLY = r"^[\x00-\x7F]*$"


def _beyond_ascii(c: Column) -> Column:
    """Null for ASCII text. A Python function sees every row whatever condition stands around it, so ASCII text, which no
    form changes, goes as null and is not converted."""
    return F.when(~F.rlike(c, F.lit(ASCII_ONLY)), c)


def normalize_unicode(c: Column, form: str = "NFC") -> Column:
    return F.coalesce(_normal(_beyond_ascii(c), F.lit(form)), c)


def strip_diacritics(c: Column) -> Column:
    return F.coalesce(_bare(_beyond_ascii(c)), c)


def map_chars(c: Column, mapping: dict[str, str]) -> Column:
    """Each character by its replacement, in one pass."""
    if not mapping:
        return c
    if all(len(k) == 1 and len(v) == 1 for k, v in mapping.items()):
        return F.translate(c, "".join(mapping), "".join(mapping.values()))
    table = F.create_map(*(F.lit(x) for kv in mapping.items() for x in kv))
    return F.array_join(F.transform(F.split(c, ""), lambda ch: F.coalesce(F.try_element_at(table, ch), ch)), "")


def primes(c: Column) -> Column:
    return F.translate(c, APOSTROPHES, PRIME * len(APOSTROPHES))


def drop_punctuation(c: Column, keep_hyphen: bool = True) -> Column:
    return F.regexp_replace(c, f"[^{WS}\\p{{L}}\\p{{N}}\\p{{M}}" + ("-" if keep_hyphen else "") + "]", " ")


def normalized_key(c: Column) -> Column:
    """NFC, squeezed, lower case."""
    return F.lower(squeeze(normalize_unicode(F.coalesce(c, F.lit("")))))


def alpha_bucket(c: Column) -> Column:
    """The first letter without its marks, upper case, if it is A-Z; else #."""
    letter = F.regexp_extract(F.coalesce(c, F.lit("")), r"(\p{L})", 1)
    base = F.upper(F.substring(strip_diacritics(letter), 1, 1))
    return F.when((base >= "A") & (base <= "Z"), base).otherwise("#")


def stored_bucket(c: Column) -> Column:
    """The bucket of stored runs: the first character as it is."""
    first = F.substring(F.ltrim(c), 1, 1)
    up = F.translate(first, "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ")
    return F.when(F.rlike(up, F.lit("^[A-Z]$")), up).otherwise("#")


def slug(c: Column) -> Column:
    low = F.lower(strip_diacritics(c))
    out = F.regexp_replace(F.regexp_replace(low, f"[{WS}]+", "_"), "[^a-z0-9_]+", "_")
    return F.btrim(F.regexp_replace(out, "_+", "_"), F.lit("_"))


def indel_ratio(a: str, b: str) -> float:
    """100 (1 - (insertions and deletions) / (both lengths)), by a bit-parallel longest common subsequence."""
    if not a and not b:
        return 100.0
    masks: dict[str, int] = {}
    for i, ch in enumerate(a):
        masks[ch] = masks.get(ch, 0) | 1 << i
    full = (1 << len(a)) - 1
    state = full
    for ch in b:
        hit = state & masks.get(ch, 0)
        state = (state + hit | state - hit) & full
    common = len(a) - state.bit_count()
    return (1.0 - (len(a) + len(b) - 2 * common) / (len(a) + len(b))) * 100.0


@F.pandas_udf(DoubleType())
def similarity(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([None if x is None or y is None else indel_ratio(x, y) for x, y in zip(a, b)], dtype="float64")
