"""Column builders for transcript text: all built-in functions."""

from __future__ import annotations

import unicodedata

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

from marlpit.schema import FILLERS, STOP_WORDS


def normal_form(text: Column, form: str) -> Column:
    """Unicode normal form, for which Spark has no function: Arrow batches, looked into only where they aren't ASCII.
    (Arrow's own utf8_normalize decomposes what it should compose.)"""

    @F.arrow_udf("string")
    def normal(x: pa.Array) -> pa.Array:
        if pc.all(pc.string_is_ascii(x), skip_nulls=True).as_py() is not False:
            return x
        return pa.array([v and unicodedata.normalize(form, v) for v in x.to_pylist()], pa.string())

    return normal(text)


def cut_text(text: Column, limit: int) -> Column:
    """White space squeezed, then cut."""
    return F.substring(squeeze(F.coalesce(text, F.lit(""))), 1, limit)


def squeeze(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def word_count(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"(?U)\S+"))


def estimate_tokens(text: Column) -> Column:
    """Words times 1.3, rounded up, 1 at least."""
    return F.greatest(F.lit(1), F.ceil(word_count(text) * F.lit(1.3)).cast("int"))


def clean(text: Column) -> Column:
    """Composed characters, one space between words, none before closing or after opening punctuation."""
    out = squeeze(normal_form(F.coalesce(text, F.lit("")), "NFC"))
    out = F.regexp_replace(out, r"\s+([,.;:!?%)\]])", "$1")
    return F.regexp_replace(out, r"([(\[])\s+", "$1")


def dedup_key(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}_]+", " "))


def ends_sentence(text: Column) -> Column:
    return text.rlike(r"[.!?][\"')\]]*$")


def capitalise(text: Column) -> Column:
    return F.concat(F.upper(F.substring(text, 1, 1)), F.substring(text, 2, 1 << 30))


def clock(seconds: Column, pad: bool = True) -> Column:
    """H:MM:SS from an hour on, below it MM:SS, or M:SS without padding."""
    s = F.floor(seconds).cast("long")
    h, m, rest = F.floor(s / 3600).cast("long"), F.floor(s % 3600 / 60).cast("long"), s % 60
    short = F.format_string("%02d:%02d" if pad else "%d:%02d", m, rest)
    return F.when(h > 0, F.format_string("%d:%02d:%02d", h, m, rest)).otherwise(short)


def neutralise(text: Column) -> Column:
    return F.translate(text, "<>", "‹›")


def highlight_terms(text: Column, limit: int = 6) -> Column:
    """The first distinct lower-cased words of four or more letters or digits that aren't stop words."""
    words = F.regexp_extract_all(F.lower(text), F.lit(r"([\p{L}\p{N}]{4,})"), F.lit(1))
    return F.slice(F.filter(F.array_distinct(words), lambda w: ~w.isin(STOP_WORDS)), 1, limit)


def like_pattern(query: str) -> str:
    """A metadata query as LIKE text with its wildcards escaped and asterisks removed, ready to be surrounded by wildcards."""
    text = query.replace("*", "").strip().lower()
    for c in "\\%_":
        text = text.replace(c, "\\" + c)
    return text


def spoken(text: Column) -> Column:
    """Words as a transcript comparison sees them: compatibility forms unified, lower case, no bracketed remarks, other
    punctuation a space, no quotes around words, no fillers."""
    out = F.lower(F.translate(normal_form(F.coalesce(text, F.lit("")), "NFKC"), "’‘ʼ`", "''''"))
    out = F.regexp_replace(out, r"\[[^\]]*\]|\([^)]*\)", " ")
    out = F.regexp_replace(out, r"[\p{P}\p{S}&&[^']]", " ")
    words = F.transform(F.split(squeeze(out), " "), lambda w: F.btrim(w, F.lit("'")))
    return F.array_join(F.filter(words, lambda w: (w != "") & ~w.isin(FILLERS)), " ")
