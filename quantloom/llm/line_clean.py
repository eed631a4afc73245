"""Line-first cleaning with DataFrame functions only: rules judge each line, failing lines go, and a document that
loses too much of its text is rejected.

Line rules, each on a line that has a word:

* punctuation: symbols of ``[#*$%&|<>]`` are more than ``max_symbol_percent`` of its characters, or it has letters
  and none of them is lower case over at least ``min_words`` words, or it has under ``min_words`` words and does not
  end like a sentence;
* navigation: three or more menu separators between words;
* boilerplate: a stock phrase of sites (cookies, log-in, policies) in a line of at most 30 words.

Everything stays inside one row, so there is no shuffle and no skew; repeated five-word windows are found by
64-bit hashes first and decided on the words themselves.

Texts are read whole, whatever their length; a text with a repeated window is in memory as its words and as its sorted
windows, some seven times its size.

Defined results: null text has no words; texts without words fail the base rules and keep nothing; repeated rows
give repeated results; an empty table gives an empty result; other columns do not matter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quantloom.llm.common import WORD, WS

SYMBOLS = "#*$%&|<>"
#: Stock phrases of web sites.
BOILERPLATE = (
    "accept cookies|cookie policy|enable javascript|terms of use|terms of service|privacy policy|all rights reserved"
    "|sign in|log in|sign up|click here|read more|lorem ipsum|share this|subscribe to"
)
SEPARATORS = "[|»›·•>]"
SEPARATOR = r"(?:\S[\x20\x09]*[|»›·•>][\x20\x09]*){3}"
ENDS_LIKE_SENTENCE = r"[.!?…:;\"”»)\]]" + WS + "*$"


def symbols_in(text: Column) -> Column:
    return F.length(F.regexp_replace(text, F.lit(f"[^{SYMBOLS}]+"), F.lit("")))


def at_least_words(n: int) -> str:
    return f"(?:{WORD}{WS}+){{{n - 1}}}[^\\x20\\x09-\\x0D]" if n > 1 else WORD


def line_ok(line: Column, max_symbol_percent: int = 5, min_words: int = 5) -> Column:
    """The tests that most lines settle within their first words come first; the others then see few lines."""
    few = ~line.rlike(at_least_words(min_words))
    shouted = ~line.rlike(r"\p{Ll}") & ~few & line.rlike(r"\p{Lu}")
    fragment = few & ~line.rlike(ENDS_LIKE_SENTENCE)
    stock = ~line.rlike(at_least_words(31)) & F.lower(line).rlike(BOILERPLATE)
    separated = line.rlike(SEPARATORS) & line.rlike(SEPARATOR)
    return ~(fragment | shouted | stock | (symbols_in(line) * 100 > F.length(line) * max_symbol_percent) | separated)


def repeat_words(df: DataFrame, words: str, out: str, window: int = 5) -> DataFrame:
    """Words in windows of ``window`` words that a text has twice or more, first ones included."""
    n_windows = F.size(words) - (window - 1)
    at = F.when(n_windows > 0, F.sequence(F.lit(1), n_windows)).otherwise(F.array().cast("array<int>"))
    word = lambda i, k: F.element_at(F.col(words), i + k)
    # hashes of windows from those of their two parts; zip_with pads the shorter side, so only the first ones count
    after = lambda c, n: F.slice(c, n + 1, F.greatest(F.size(c) - n, F.lit(0)))
    joined = lambda x, y, n: F.zip_with(x, after(y, n), lambda a, b: F.xxhash64(a, b))
    df = df.withColumn("_of1", F.transform(words, lambda w: F.xxhash64(w)))
    size = 1
    while size < window:
        step = 1 << (min(size, window - size).bit_length() - 1)
        df = df.withColumn(f"_of{size + step}", joined(F.col(f"_of{size}"), F.col(f"_of{step}"), size))
        size += step
    df = df.withColumn("_hashes", F.slice(f"_of{window}", 1, F.greatest(n_windows, F.lit(0)))).drop(*(f"_of{k}" for k in range(1, window + 1)))
    df = df.withColumn("_suspect", F.size(F.array_distinct("_hashes")) < F.size("_hashes"))
    gram = lambda i: F.struct(F.concat_ws(" ", *[word(i, k) for k in range(window)]).alias("gram"), i.alias("at"))
    df = df.withColumn("_grams", F.when(F.col("_suspect"), F.sort_array(F.transform(at, gram))))
    gram_at = lambda k: F.try_element_at(F.col("_grams"), k)["gram"]
    same = lambda a, b: F.coalesce(gram_at(a) == gram_at(b), F.lit(False))
    found = F.filter(
        F.sequence(F.lit(1), F.size("_grams")),
        lambda k: same(k, k + 1) | F.when(k > 1, same(k, F.greatest(k - 1, F.lit(1)))).otherwise(False),
    )
    df = df.withColumn(
        "_at", F.when(F.col("_suspect"), F.sort_array(F.transform(found, lambda k: F.element_at(F.col("_grams"), k)["at"])))
    )
    n = F.size("_at")
    steps = F.when(n > 1, F.sequence(F.lit(1), n - 1)).otherwise(F.array().cast("array<int>"))
    step = lambda j: F.least(F.lit(window), F.element_at("_at", j + 1) - F.element_at("_at", j)).cast("long")
    covered = F.aggregate(steps, F.lit(window).cast("long"), lambda total, j: total + step(j))
    return df.withColumn(out, F.when(F.col("_suspect") & (n > 0), covered).otherwise(F.lit(0).cast("long"))).drop(
        "_hashes", "_suspect", "_grams", "_at"
    )


def clean_lines(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    max_symbol_percent: int = 5,
    min_words: int = 5,
    max_lost_percent: int = 50,
) -> DataFrame:
    """(id_col, counts of the text, base_failed, cleaned_text, n_lines, n_lines_removed, kept_chars, kept)."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    df = docs.select(F.col(id_col).alias("_id"), text.alias("_text"))
    df = df.withColumn("_words", F.filter(F.split("_text", WS + "+"), lambda w: w != ""))
    df = df.withColumn("_lines", F.filter(F.split("_text", "\n"), lambda x: x.rlike(WORD)))
    df = repeat_words(df, "_words", "n_repeat_words")
    df = df.withColumn("_good", F.filter("_lines", lambda x: line_ok(x, max_symbol_percent, min_words)))
    df = df.select(
        F.col("_id").alias(id_col),
        F.size("_words").cast("long").alias("n_words"),
        F.length(F.array_join("_words", "")).cast("long").alias("word_chars"),
        symbols_in(F.col("_text")).cast("long").alias("n_symbols"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        "n_repeat_words",
        F.concat_ws("\n", "_good").alias("cleaned_text"),
        F.size("_lines").cast("long").alias("n_lines"),
        (F.size("_lines") - F.size("_good")).cast("long").alias("n_lines_removed"),
    )
    df = df.withColumn("base_failed", (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words")))
    df = df.withColumn("kept_chars", F.length(F.regexp_replace("cleaned_text", WS, "")).cast("long"))
    enough = F.col("kept_chars") * 100 >= F.col("word_chars") * (100 - max_lost_percent)
    return df.withColumn("kept", ~F.col("base_failed") & enough)
