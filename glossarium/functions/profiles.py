"""Normalisation profiles: a declared configuration compiled to columns for display, norm, render and features."""

from __future__ import annotations

import hashlib
from dataclasses import dataclass, field

import pandas as pd
import unicodedata
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType

from . import text as T


@dataclass(frozen=True)
class Profile:
    profile_id: str = "default"
    version: int = 1
    unicode: str = "NFC"
    display_keep_long_s: bool = True
    display_lower: bool = False
    norm_lower: bool = True
    strip_diacritics: bool = True
    remove_punctuation: bool = False
    keep_hyphen: bool = True
    char_map: dict[str, str] = field(default_factory=dict)
    render_enabled: bool = True
    render_source: str = "norm"
    paren_primes: bool = False
    paren_accents: bool = False
    open_paren: str = "("
    close_paren: str = ")"
    prime: str = T.PRIME
    acute_vowels: str = T.ACUTE_VOWELS
    stress_marks: tuple[str, ...] = (T.PRIME,)
    #: mark and its label, in order
    quantity_marks: dict[str, str] = field(default_factory=dict)
    #: (condition, values): condition has contains, contains_any or pattern; all must hold, later rules overwrite
    rules: tuple[tuple[dict, dict], ...] = ()
    allowed_symbols: str = ""
    #: further known symbols, from a corpus' inventory
    inventory: tuple[str, ...] = ()
    enforce_stress_consistency: bool = False
    require_prime: bool = False
    require_acute: bool = False
    require_pronunciation: bool = False

    def __post_init__(self):
        if self.unicode not in ("NFC", "NFD", "NFKC", "NFKD"):
            raise ValueError(f"unknown Unicode form {self.unicode}")
        if self.render_source not in ("norm", "display"):
            raise ValueError(f"unknown render source {self.render_source}")

    def sha256(self) -> str:
        return hashlib.sha256(repr(self).encode()).hexdigest()


def base(c: Column, p: Profile) -> Column:
    return T.primes(T.normalize_unicode(F.coalesce(c, F.lit("")), p.unicode))


def display(c: Column, p: Profile) -> Column:
    return _display(base(c, p), p)


def norm(c: Column, p: Profile) -> Column:
    return _norm(base(c, p), p)


def _display(out: Column, p: Profile) -> Column:
    if not p.display_keep_long_s:
        out = F.replace(out, F.lit("ſ"), F.lit("s"))
    out = T.map_chars(out, p.char_map)
    return T.squeeze(F.lower(out) if p.display_lower else out)


def _norm(out: Column, p: Profile) -> Column:
    out = T.map_chars(F.replace(out, F.lit("ſ"), F.lit("s")), p.char_map)
    if p.strip_diacritics:
        out = T.strip_diacritics(out)
    if p.norm_lower:
        out = F.lower(out)
    if p.remove_punctuation:
        out = T.drop_punctuation(out, p.keep_hyphen)
    return T.squeeze(out)


def render(display_: Column, norm_: Column, p: Profile) -> Column:
    if not p.render_enabled:
        return norm_
    out = display_ if p.render_source == "display" else norm_
    quote = lambda s: "\\Q" + s + "\\E"
    wrap = p.open_paren.replace("$", "\\$") + "$1" + p.close_paren.replace("$", "\\$")
    if p.paren_primes:
        out = F.regexp_replace(out, f"(?d){quote(p.prime)}(.+?){quote(p.prime)}", wrap)
        out = F.regexp_replace(out, f"([^{T.WS}]){quote(p.prime)}", wrap)
        out = F.replace(out, F.lit(p.prime), F.lit(""))
    if p.paren_accents:
        out = F.regexp_replace(out, f"([{p.acute_vowels}])", wrap)
    return T.squeeze(out)


@F.pandas_udf(IntegerType())
def detached_marks(text: pd.Series) -> pd.Series:
    """Combining marks at the start, after white space or after another."""

    def count(t: str) -> int:
        n, last = 0, " "
        for ch in t:
            if unicodedata.combining(ch) and (last.isspace() or unicodedata.combining(last)):
                n += 1
            last = ch
        return n

    return pd.Series([None if t is None else count(t) for t in text], dtype="Int32")


detached_marks = detached_marks.asNondeterministic()


def _has(c: Column, s: str) -> Column:
    return F.contains(c, F.lit(s))


def _fits(c: Column, when: dict) -> Column:
    out = F.lit(True)
    if "contains" in when:
        out = out & _has(c, when["contains"])
    if "contains_any" in when:
        any_ = F.lit(False)
        for ch in when["contains_any"]:
            any_ = any_ | _has(c, ch)
        out = out & any_
    if "pattern" in when:
        out = out & F.rlike(c, F.lit(T.regex(when["pattern"])))
    return out


def primary_stress(c: Column, p: Profile) -> Column:
    """Distinct places that carry stress: acute vowels, and what stands before a prime."""
    chars = F.split(c, "")
    at = F.transform(
        chars,
        lambda ch, i: F.when(F.lit(p.acute_vowels).contains(ch) & (ch != ""), i).when(ch == p.prime, F.greatest(i - 1, F.lit(0))),
    )
    return F.size(F.array_distinct(F.filter(at, lambda i: i.isNotNull())))


def features(c: Column, p: Profile) -> dict[str, Column]:
    """Named feature columns of a display form."""
    accented = F.length(c) - F.length(F.translate(c, p.acute_vowels, ""))
    out = {
        "has_prime": _has(c, p.prime),
        "prime_count": ((F.length(c) - F.length(F.replace(c, F.lit(p.prime), F.lit("")))) / len(p.prime)).cast("int"),
        "accented_vowel_count": accented,
        "has_accented_vowel": accented > 0,
        "combining_detached_count": F.coalesce(detached_marks(F.when(F.rlike(c, F.lit(r"\p{M}")), c)), F.lit(0)),
        "primary_stress_count": primary_stress(c, p),
    }
    if p.stress_marks:
        out["stress"] = F.when(_fits(c, {"contains_any": p.stress_marks}), "primary").otherwise("none")
    if p.quantity_marks:
        labels = F.array_compact(F.array(*(F.when(_has(c, m), F.lit(v)) for m, v in p.quantity_marks.items())))
        out["quantity"] = F.when(F.size(labels) > 0, labels)
    values: dict[str, list[Column]] = {}
    for when, sets in p.rules:
        for k, v in sets.items():
            values.setdefault(k, []).insert(0, F.when(_fits(c, when), F.lit(v)))
    for k, v in values.items():  # the last rule that fits wins, then what was there
        out[k] = F.coalesce(*v, *([out[k]] if k in out else []))
    return out


def symbols_used(c: Column) -> Column:
    """Sorted characters that are neither white space, letters nor numbers."""
    chars = F.filter(F.array_distinct(F.split(c, "")), lambda ch: F.rlike(ch, F.lit(f"[^{T.WS}\\p{{L}}\\p{{N}}]")))
    return F.array_sort(chars)


def allowed_symbols(p: Profile) -> list[str]:
    """What a profile declares anywhere: marks, both sides of its map, extras and the inventory."""
    marks = "".join([p.prime, p.acute_vowels, *p.stress_marks, *p.quantity_marks])
    return sorted({"ʹ", "ſ", "-", *marks, *p.allowed_symbols, *p.inventory, *"".join(p.char_map), *"".join(p.char_map.values())})


def unknown_symbols(c: Column, p: Profile) -> Column:
    return F.array_except(symbols_used(c), F.array(*map(F.lit, allowed_symbols(p))))


def stress_inconsistent(features_: Column, p: Profile) -> Column:
    """An accented vowel without a prime, or a prime without one, as far as the profile asks for it and has the marks."""
    prime, accented = features_["prime_count"], features_["accented_vowel_count"]
    out = F.lit(False)
    if p.enforce_stress_consistency and p.require_prime and p.prime:
        out = out | ((accented > 0) & (prime == 0))
    if p.enforce_stress_consistency and p.require_acute and p.acute_vowels:
        out = out | ((prime > 0) & (accented == 0))
    return out


def warnings(features_: Column, unknown: Column, p: Profile) -> Column:
    """Sorted codes of what is odd about a form."""
    return F.array_compact(
        F.array(
            F.when(features_["combining_detached_count"] > 0, "DETACHED_COMBINING_MARK"),
            F.when(stress_inconsistent(features_, p), "INCONSISTENT_STRESS"),
            F.when(features_["primary_stress_count"] > 1, "MULTIPLE_PRIMARY_STRESS"),
            F.when(F.size(unknown) > 0, "UNKNOWN_SYMBOL"),
        )
    )


def apply_profile(df, source: str, p: Profile):
    """``df`` with form_display, form_norm, form_render, features, symbols_used, unknown_symbols and warnings of a column.
    The features are those of the display form. Nulls are taken as empty."""
    based = df.withColumn("_base", base(F.col(source), p))  # once for both forms
    out = based.withColumns({"form_display": _display(F.col("_base"), p), "form_norm": _norm(F.col("_base"), p)}).drop("_base")
    out = out.withColumn("form_render", render(F.col("form_display"), F.col("form_norm"), p))
    named = features(F.col("form_display"), p)
    out = out.withColumns(
        {
            "features": F.struct(*(v.alias(k) for k, v in named.items())),
            "symbols_used": symbols_used(F.col("form_display")),
            "unknown_symbols": unknown_symbols(F.col("form_display"), p),
        }
    )
    return out.withColumn("warnings", warnings(F.col("features"), F.col("unknown_symbols"), p))
