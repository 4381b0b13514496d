"""Quality rules, line first: failing lines go, then documents that lose too much text.

A map over documents: no shuffle, no Python. Defined results for odd input: a null or empty text has no words, fails the
base rules and is not kept; repeated rows are judged each on their own; very long texts are judged whole, in time that grows with their length; other columns pass through, except that columns
named like the results are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marlpit.llm.common import ASCII_SPACE

WORD = rf"[^{ASCII_SPACE}]+"
SPACES = " \t\n\x0b\x0c\r"
SYMBOL = r"[#*$%&|<>]"
#: Phrases of boilerplate lines in English, French, German and Spanish, matched in lower case.
BOILERPLATE = (
    r"cookie policy|use of cookies|accept cookies|privacy policy|terms of (use|service)|all rights reserved|"
    r"enable javascript|lorem ipsum|click here|sign up for our newsletter|subscribe to our newsletter|"
    r"licensed under the|under the (mit|bsd|apache|gpl) license|"
    r"politique de confidentialité|conditions d.utilisation|utilisation de(s)? cookies|tous droits réservés|cliquez ici|abonnez-vous à|activez javascript|"
    r"datenschutzerklärung|nutzungsbedingungen|verwendung von cookies|alle rechte vorbehalten|hier klicken|newsletter abonnieren|javascript aktivieren|"
    r"política de privacidad|(condiciones|términos) de uso|uso de cookies|todos los derechos reservados|haga clic aquí|suscríbase a|active javascript"
)
#: What a base column is called here and nowhere in a document table.
COLUMNS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_lines_removed", "kept_words", "clean_text"]


def count_matches(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern))


def line_fails(line: Column, max_boilerplate_words: int = 30) -> Column:
    """A line with words fails if it breaks one of four rules; a line without words never does.

    punctuation: it doesn't end in sentence punctuation (closing quotes and brackets may follow) and has no sentence
    end inside either; navigation: three or more bars or angle marks and at least one for every three words;
    boilerplate: a phrase of BOILERPLATE in a line of at most max_boilerplate_words words; noise: symbols, or pairs of
    exclamation marks, at least one for every two words."""
    words = count_matches(line, WORD)
    closed = line.rlike(r"[.!?:;…]['\")\]»”’]*[\x20\x09-\x0D]*$") | line.rlike(r"[.!?][\x20\x09-\x0D]")
    navigation = count_matches(line, r"[|<>»›]")
    return (words > 0) & (
        ~closed
        | ((navigation >= 3) & (navigation * 3 >= words))
        | ((words <= max_boilerplate_words) & F.lower(line).rlike(BOILERPLATE))
        | (count_matches(line, SYMBOL) * 2 >= words)
        | (count_matches(line, "!!") * 2 >= words)
    )


def _shifted(array: Column, by: int) -> Column:
    return F.slice(array, 1 + by, F.size(array))


def _repeated_positions(hashes: str) -> Column:
    """Places, in order, of the windows whose hash another window has; looked for only where there are such.

    Arrays are set beside their shifted selves, and no lambda looks at a whole array: that would be made again for every element."""
    pairs = F.sort_array(F.transform(F.col(hashes), lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    pairs = F.when(F.size(F.array_distinct(hashes)) < F.size(hashes), pairs).otherwise(F.slice(pairs, 1, 0))

    def again(p):
        one = p[0]
        before = F.concat(F.slice(F.array(F.lit(None).cast("struct<h:bigint,i:int>")), 1, 1), one)
        near = F.arrays_zip(one.alias("here"), before.alias("before"), _shifted(one, 1).alias("after"))
        met = F.filter(near, lambda x: F.coalesce(x["here"]["h"] == x["before"]["h"], F.lit(False)) | F.coalesce(x["here"]["h"] == x["after"]["h"], F.lit(False)))
        return F.sort_array(F.transform(met, lambda x: x["here"]["i"]))

    return F.transform(F.array(F.struct(pairs.alias("p"))), lambda x: again([x["p"]]))[0]


def quality_rules(docs: DataFrame, text: str = "text", min_words: int = 10, max_repeat_percent: int = 20, min_kept: float = 0.5) -> DataFrame:
    """docs with COLUMNS added: the base counts, kept, and clean_text, the text without its failing lines.

    A document is kept if it has min_words words, no more than max_repeat_percent of them in repeated 5-word windows,
    and at least min_kept of its words in lines that pass line_fails()."""
    out = docs.drop(*[c for c in docs.columns if c in COLUMNS])
    body = F.coalesce(F.col(text), F.lit(""))
    trimmed = F.btrim(body, F.lit(SPACES))
    out = out.withColumn("__words", F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, rf"[{ASCII_SPACE}]+")))
    out = out.withColumn("__lines", F.split(body, "\n"))
    n = F.size("__words")
    windows = F.arrays_zip(*[_shifted(F.col("__words"), k).alias(f"w{k}") for k in range(5)])
    windows = F.slice(F.transform(windows, lambda w: F.xxhash64(*[w[f"w{k}"] for k in range(5)])), F.lit(1), n - 4)
    out = out.withColumn("__hashes", F.when(n >= 5, windows).otherwise(F.array().cast("array<bigint>")))
    out = out.withColumn("__worded", F.filter("__lines", lambda x: x.rlike(WORD)))
    out = out.withColumn("__good", F.filter("__lines", lambda x: ~line_fails(x)))
    out = out.withColumn("__starts", _repeated_positions("__hashes"))
    covered = F.aggregate(
        "__starts",
        F.struct(F.lit(0).alias("n"), F.lit(0).alias("end")),
        lambda acc, p: F.struct((acc["n"] + p + 5 - F.greatest(p, acc["end"])).alias("n"), (p + 5).alias("end")),
        lambda acc: acc["n"],
    )
    out = out.withColumns(
        {
            "n_words": n.cast("long"),
            "word_chars": F.length(F.array_join("__words", "")).cast("long"),
            "n_symbols": count_matches(body, SYMBOL).cast("long"),
            "n_dup_lines": (F.size("__worded") - F.size(F.array_distinct("__worded"))).cast("long"),
            "n_repeat_words": covered.cast("long"),
            "n_lines_removed": (F.size("__lines") - F.size("__good")).cast("long"),
            "clean_text": F.array_join("__good", "\n"),
        }
    )
    out = out.withColumn("kept_words", count_matches(F.col("clean_text"), WORD).cast("long"))
    out = out.withColumn("base_failed", (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat_percent * F.col("n_words")))
    out = out.withColumn("kept", ~F.col("base_failed") & (F.col("kept_words") >= F.lit(min_kept) * F.col("n_words")))
    return out.drop("__words", "__lines", "__hashes", "__worded", "__good", "__starts")
