"""Scalar semantics of words, features and hashes as column expressions.

All of them stay inside the JVM. The Unicode work that has no built-in function
is a translation table made from character properties; ``normalize_exact`` sends
only rows with characters beyond it through Python.
"""

from __future__ import annotations

import unicodedata
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Characters whose decomposition the native normaliser knows: Latin, and what has none.
KNOWN = "[\\x{0000}-\\x{024F}\\x{0300}-\\x{036F}\\x{0400}-\\x{04FF}\\x{1E00}-\\x{1EFF}\\x{2000}-\\x{206F}\\x{3000}-\\x{303F}\\x{4E00}-\\x{9FFF}]"
SEEDS = "9223372036854775808"  # seeds lie below it
RETRY_STEP = 1_000_000_007


def _c(x: str | Column) -> Column:
    return F.col(x) if isinstance(x, str) else x


@lru_cache(1)
def fold_table() -> tuple[str, str]:
    """Characters and what is left of each without its combining marks."""
    pairs = []
    for cp in (*range(0xC0, 0x250), *range(0x400, 0x500), *range(0x1E00, 0x1F00)):
        bare = "".join(ch for ch in unicodedata.normalize("NFD", chr(cp)) if unicodedata.category(ch) != "Mn")
        if bare != chr(cp) and len(bare) == 1:
            pairs.append((chr(cp), bare))
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


def strip(x: str | Column) -> Column:
    """Without white space at either end; white space is Unicode's and U+001C to U+001F."""
    return F.regexp_replace(_c(x), r"(?U)^[\s\x1C-\x1F]+|[\s\x1C-\x1F]+$", "")


def collapse(x: str | Column) -> Column:
    return F.regexp_replace(_c(x), r"(?U)[\s\x1C-\x1F]+", " ")


def normalize_word(x: str | Column) -> Column:
    """Stripped, without combining marks, in lower case, white space collapsed."""
    bare = F.translate(strip(x), *fold_table())
    return collapse(F.lower(F.regexp_replace(bare, r"\p{Mn}", "")))


def _python_normalize(x: str | None) -> str | None:
    if x is None:
        return None
    bare = "".join(ch for ch in unicodedata.normalize("NFD", x.strip()) if unicodedata.category(ch) != "Mn")
    return " ".join(bare.lower().split()) if bare.strip() else ""


def normalize_exact(df: DataFrame, column: str, out: str) -> DataFrame:
    """``normalize_word`` for any text: rows with characters beyond the table go through Python."""

    @F.pandas_udf("string")
    def slow(s: pd.Series) -> pd.Series:
        return s.map(_python_normalize)

    known = F.regexp_replace(F.coalesce(_c(column), F.lit("")), KNOWN, "") == ""
    # One pass: of most rows Python sees a null only.
    hard = df.withColumn("__slow", slow(F.when(~known, _c(column))))
    return hard.withColumn(out, F.when(known, normalize_word(column)).otherwise(F.col("__slow"))).drop("__slow")


@lru_cache(1)
def casefold_table() -> tuple[str, str, dict[str, str]]:
    """What case folding changes in lower-case text: characters, what each becomes, and those that become several.

    By the rule of Unicode's case folding, as str.casefold() has it.
    """
    single, several = {}, {}
    for cp in range(0x110000):
        ch = chr(cp)
        folded = ch.casefold()
        if folded != ch and ch.lower() == ch:
            (single if len(folded) == 1 else several)[ch] = folded
    return "".join(single), "".join(single.values()), several


def casefold(x: str | Column) -> Column:
    """Full case folding. Few texts hold characters for which it is more than lower case and the German sharp s."""
    singles, folded, several = casefold_table()
    low = F.replace(F.lower(_c(x)), F.lit("ß"), F.lit("ss"))
    rest = {ch: to for ch, to in several.items() if ch != "ß"}
    # A loop over the pairs, as a nest of a hundred calls would be too large a method to be compiled.
    pairs = F.array(*[F.array(F.lit(ch), F.lit(to)) for ch, to in rest.items()])
    full = F.aggregate(pairs, F.translate(low, singles, folded), lambda text, pair: F.replace(text, pair[0], pair[1]))
    special = sorted(map(ord, (*singles, *rest)))
    few = [cp for cp in special if cp < 0x300]
    # Most texts are told by a class that is quick to test; only others are searched for each of the characters.
    written = lambda cps: "".join(f"\\x{{{cp:X}}}" for cp in cps)
    likely = F.regexp_like(low, F.lit(f"[{written(few)}\\x{{300}}-\\x{{10FFFF}}]"))
    return F.when(likely & F.regexp_like(low, F.lit(f"[{written(special)}]")), full).otherwise(low)


def normalize_feature(x: str | Column) -> Column:
    """Case folded, stripped, without the dots at the end, white space collapsed."""
    return strip(collapse(F.regexp_replace(strip(casefold(x)), r"\.+$", "")))


def match_key(x: str | Column) -> Column:
    """The form in which a returned target word is compared: parentheses do not count."""
    return strip(collapse(F.regexp_replace(normalize_word(x), "[()]", " ")))


def distinct_features(x: str | Column) -> Column:
    """An array's texts, collapsed, without empty ones, each once whatever its case; first spellings and their order stay."""
    clean = F.filter(F.transform(_c(x), lambda t: strip(collapse(t))), lambda t: t != "")
    folded = F.transform(clean, casefold)
    return F.filter(clean, lambda t, i: F.array_position(folded, casefold(t)) == i + 1)


def strip_fence(x: str | Column) -> Column:
    """If the text starts with a code fence: without all lines that start with one."""
    fence = "```"
    lines = F.filter(F.split(strip(x), "\n"), lambda t: ~F.startswith(strip(t), F.lit(fence)))
    return F.when(F.startswith(strip(x), F.lit(fence)), F.array_join(lines, "\n")).otherwise(strip(x))


def json_literals(x: str | Column) -> Column:
    """Python's None, True and False as JSON's, wherever they stand as words and outside quotes that touch them."""
    out = _c(x)
    for name, literal in (("None", "null"), ("True", "true"), ("False", "false")):
        out = F.regexp_replace(out, rf'(?U)(?<!["\w]){name}(?!["\w])', literal)
    return out


def row_hash(word: str | Column, feature_id: str | Column) -> Column:
    return F.sha2(F.concat_ws("|", _c(word), _c(feature_id).cast("string")), 256)


def prompt_hash(system: str | Column, user: str | Column) -> Column:
    return F.sha2(F.concat(_c(system), F.lit("\n---\n"), _c(user)), 256)


def response_id(*parts: str | Column) -> Column:
    """Of word, variant, replicate, model, seed and prompt hash, in this order."""
    return F.sha2(F.concat_ws("|", *[_c(p).cast("string") for p in parts]), 256)


def sampling_seed(base: int | Column, word: str | Column, replicate: str | Column) -> Column:
    """A 63-bit seed that does not depend on the prompt, so variants are paired."""
    digest = F.sha2(F.concat_ws("|", (F.lit(base) if isinstance(base, int) else base).cast("string"), _c(word), _c(replicate).cast("string")), 256)
    return (F.conv(F.substring(digest, 1, 16), 16, 10).cast("decimal(20,0)") % F.lit(SEEDS).cast("decimal(20,0)")).cast("long")


def retry_seed(seed: str | Column, attempt: str | Column | int) -> Column:
    attempt = F.lit(attempt) if isinstance(attempt, int) else _c(attempt)
    return ((_c(seed).cast("decimal(30,0)") + attempt.cast("decimal(10,0)") * F.lit(RETRY_STEP)) % F.lit(SEEDS).cast("decimal(20,0)")).cast("long")


def half_even(x: str | Column, scale: int = 0) -> Column:
    return F.bround(_c(x), scale)


def truthy(x: str | Column) -> Column:
    return F.coalesce(F.lower(_c(x).cast("string")).isin("true", "1", "yes"), F.lit(False))


def high_confidence(x: str | Column, least: float = 0.80) -> Column:
    return F.coalesce(_c(x) >= least, F.lit(False))


def routing(x: str | Column, threshold: float = 1.0) -> Column:
    """Whether a resolved value goes to positive verification."""
    return F.when(_c(x).try_cast("double") >= threshold, "candidate").otherwise("not_candidate")
