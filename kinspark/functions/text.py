"""Normalisation of names and addresses, as Column expressions only.

Strings are never null past ``blank``: a missing value is the empty string.
"""

from __future__ import annotations

import unicodedata
from functools import cache

from pyspark.sql import Column
from pyspark.sql import functions as F

from .wordlists import ADDRESS_FORMS, LEGAL, NAME_FORMS

#: Characters that normalised text keeps besides spaces.
KEPT = r"0-9a-zऀ-ൿ"
DEVANAGARI, INDIC = r"[ऀ-ॿ]", r"[ऀ-෿]"


def blank(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


@cache
def fold_tables() -> tuple[str, str, dict[str, str], str]:
    """What folding does to the characters of the basic plane, made from the Unicode database: characters that
    become one other (two parallel strings), those that become several, and a class of combining marks."""
    single_from, single_to, several, marks = [], [], {}, []
    for code in range(0x80, 0x10000):
        if 0xD800 <= code <= 0xDFFF:
            continue
        ch = chr(code)
        if unicodedata.combining(ch):
            marks.append(code)
        kept: list[str] = []
        for x in unicodedata.normalize("NFKD", ch):
            if not (unicodedata.combining(x) and kept and kept[-1].isascii()):
                kept.append(x)
        out = "".join(kept).lower()
        # Other characters part words whatever they fold to.
        if out != ch and any(x.isdigit() and x.isascii() or "a" <= x <= "z" or 0x900 <= ord(x) <= 0xD7F for x in out):
            if len(out) == 1:
                single_from.append(ch)
                single_to.append(out)
            else:
                several[ch] = out
    ranges, start = [], None
    for code in marks:
        if start is None or code != last + 1:  # noqa: F821
            if start is not None:
                ranges.append((start, last))  # noqa: F821
            start = code
        last = code
    ranges.append((start, last))
    return "".join(single_from), "".join(single_to), several, "".join(f"\\u{a:04X}-\\u{b:04X}" for a, b in ranges)


@cache
def latin_table() -> tuple[str, str, str]:
    """What folding does to the characters up to U+00FF (two parallel strings), and a class of those and all others that need more."""
    a, b, several, _ = fold_tables()
    pairs = [(x, y) for x, y in zip(a, b) if x <= "\xff"]
    more = "".join(x for x in several if x <= "\xff")
    return "".join(x for x, _ in pairs), "".join(y for _, y in pairs), f"[{more}]|[^\\x00-\\xFF]"


def fold(c: Column) -> Column:
    """Lower case without accents on Latin letters; signs of other scripts stay.

    Exact, within the basic plane, for all that ``punct_norm`` and ``alnum`` keep, but that
    several marks in a row are taken in the order they come in. Strings up to U+00FF, by far the most, take one short
    table; the long classes are matched only against characters beyond.
    """
    latin_from, latin_to, more = latin_table()
    return F.lower(F.when(~c.rlike(r"[^\x00-\x7F]"), c).when(~c.rlike(more), F.translate(c, latin_from, latin_to)).otherwise(fold_all(c)))


def fold_all(c: Column) -> Column:
    a, b, several, marks = fold_tables()
    s = F.translate(c, a, b)
    # Characters that become several are rare, so only strings that have one are taken apart, and only such characters are looked up.
    some = "[" + "".join(several) + "]"
    pairs = F.create_map(*[F.lit(x) for kv in several.items() for x in kv])
    own = lambda x: F.when(x.rlike(some), F.coalesce(F.try_element_at(pairs, x), x)).otherwise(x)
    long = F.array_join(F.transform(F.split(s, ""), lambda x: F.when(x < "\x80", x).otherwise(own(x))), "")
    s = F.when(s.rlike(rf"(?=[^\x00-\x7F]){some}"), long).otherwise(s)
    # The general category is a quick test that spares most characters the class of marks.
    return F.regexp_replace(s, rf"([\x00-\x7F])(?=\p{{M}})[{marks}]+", "$1")


def punct_norm(c: Column) -> Column:
    """Folded; all but letters, digits and Indic characters is one space; trimmed."""
    return F.trim(F.regexp_replace(fold(c), f"[^{KEPT}]+", " "))


def alnum(c: Column) -> Column:
    return F.regexp_replace(fold(c), f"[^{KEPT}]+", "")


def tokens(c: Column) -> Column:
    return F.filter(F.split(c, " "), lambda t: t != "")


def mapped(words: Column, forms: dict[str, str]) -> Column:
    table = F.create_map(*[F.lit(x) for kv in forms.items() for x in kv])
    return F.transform(words, lambda t: F.coalesce(F.try_element_at(table, t), t))


def name_tokens(pn: Column) -> Column:
    return mapped(tokens(pn), NAME_FORMS)


def core_tokens(names: Column) -> Column:
    """Without legal suffixes, unless nothing would be left."""
    core = F.filter(names, lambda t: ~t.isin(*LEGAL))
    return F.when(F.size(core) > 0, core).otherwise(names)


def address_tokens(pa: Column) -> Column:
    return mapped(tokens(pa), ADDRESS_FORMS)


def joined(words: Column) -> Column:
    return F.array_join(words, " ")


def sorted_unique(words: Column) -> Column:
    return F.array_sort(F.array_distinct(words))


def digit_runs(c: Column) -> Column:
    """Distinct runs of decimal digits of any script, sorted as strings."""
    return F.array_sort(F.array_distinct(F.regexp_extract_all(c, F.lit(r"(\p{Nd}+)"), F.lit(1))))


def long_runs(runs: Column) -> Column:
    return F.filter(runs, lambda x: F.length(x) >= 5)


def token_count(c: Column) -> Column:
    return F.when(c == "", 0).otherwise(F.size(F.split(c, " "))).cast("long")


def has_devanagari(c: Column) -> Column:
    return c.rlike(DEVANAGARI)


def script_of(c: Column) -> Column:
    return F.when(c == "", "empty").when(c.rlike(INDIC), "indic").otherwise("latin")


def char_ngrams(c: Column, n: int = 3) -> Column:
    """All n-grams; the string itself where it is shorter; none of an empty one."""
    own = F.transform(F.sequence(F.lit(1), F.greatest(F.length(c) - n + 1, F.lit(1))), lambda i: F.substring(c, i, F.lit(n)))
    return F.when(c == "", F.array().cast("array<string>")).otherwise(own)


def source_of(entity: Column) -> Column:
    return F.substring(entity, 2, 1)


def duplicate_key(name: Column, address: Column, country: Column) -> Column:
    return F.concat_ws("|", alnum(name), alnum(address), country)


def percent(x: Column, n: Column) -> Column:
    return F.round(100 * x / F.greatest(n, F.lit(1)), 2)


def views(df, name: str = "name", address: str = "address"):
    """``df`` with all normalised views of its name and address, in one projection after another and no shuffle."""
    df = df.withColumn("nm", punct_norm(blank(F.col(name)))).withColumn("ad", punct_norm(blank(F.col(address))))
    df = df.withColumn("__n", core_tokens(name_tokens(F.col("nm")))).withColumn("__a", address_tokens(F.col("ad")))
    df = df.withColumn("nmc", joined(F.col("__n"))).withColumn("adn", joined(F.col("__a")))
    df = df.withColumn("nms", joined(sorted_unique(F.col("__n")))).withColumn("ads", joined(sorted_unique(F.col("__a"))))
    df = df.withColumn("__d", digit_runs(F.col("adn")))
    return df.select(
        *[c for c in df.columns if not c.startswith("__")],
        joined(F.col("__d")).alias("num"),
        joined(long_runs(F.col("__d"))).alias("zip"),
        F.length("nm").cast("long").alias("nlen"),
        F.length("ad").cast("long").alias("alen"),
        token_count(F.col("nmc")).alias("ntn"),
        token_count(F.col("adn")).alias("nta"),
        has_devanagari(blank(F.col(name))).cast("int").alias("indic"),
    )
