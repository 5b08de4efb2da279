"""Quality rules: a threshold table compiled into one projection of length, symbol, stop-word and line ratios.

All counts are built-in functions over whole texts; nothing is shuffled and no user function runs.

Defined results: null, empty or blank text: no words, all counts 0, ``base_failed``, not kept.
Repeated rows are judged each for itself; other columns are not read. A rule whose metric is
null (a ratio by zero words) fails.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from flowlens.llm.common import with_results

BLANK = r"[\x20\x09-\x0D]"

#: Frequent short words of the languages that are told apart.
STOP_WORDS = (
    "the of and to a in is it that for on was as with be by this are from at or an not "
    "le la les de des du un une et est que qui dans pour sur au avec il elle ce "
    "der die das und ist ein eine nicht mit von den zu sich auf dem im als auch "
    "el los las y en es por con para se su al lo no"
).split()

#: (metric, least, most); None: no limit. A text is kept if every metric lies within its limits.
THRESHOLDS: tuple[tuple[str, float | None, float | None], ...] = (
    ("mean_word", 2.0, 16.0),
    ("symbols_per_word", None, 0.10),
    ("bangs_per_word", None, 0.10),
    ("stop_words", 1, None),
    ("dup_line_share", None, 0.40),
    ("letter_share", 0.60, None),
)


def _counted(docs: DataFrame, text: str) -> DataFrame:
    """The counts of each text beside all columns, in a struct ``__rules_q``."""
    t = F.coalesce(F.col(text).cast("string"), F.lit(""))
    trimmed = F.btrim(t, F.lit(" \t\n\x0b\f\r"))
    df = docs.withColumn("__rules_t", t).withColumn("__rules_w", F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, BLANK + "+")))
    n = F.size("__rules_w")
    windows = F.when(n >= 5, F.transform(F.sequence(F.lit(1), n - 4), lambda i: F.xxhash64(F.slice("__rules_w", i, 5)))).otherwise(F.array().cast("array<bigint>"))
    df = df.withColumn("__rules_h", windows)
    # Only texts with a repeated window need the places of the windows.
    placed = F.sort_array(F.transform("__rules_h", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    df = df.withColumn("__rules_s", F.when(F.size(F.array_distinct("__rules_h")) < F.size("__rules_h"), placed).otherwise(F.array().cast("array<struct<h:bigint,i:int>>")))
    # A place is repeated if its hash equals that of a neighbour. Neighbours meet as two slices: an array that a
    # lambda over it names would be computed anew for every element where Spark unfolds aliases.
    m = F.size("__rules_s")
    first, second = F.slice("__rules_s", 1, F.greatest(m - 1, F.lit(0))), F.slice("__rules_s", 2, F.greatest(m - 1, F.lit(0)))
    both = F.zip_with(first, second, lambda x, y: F.when(x.getField("h") == y.getField("h"), F.array(x.getField("i"), y.getField("i"))).otherwise(F.array().cast("array<int>")))
    starts = F.array_distinct(F.flatten(both))
    df = df.withColumn("__rules_r", F.sort_array(starts))
    gaps = F.zip_with(F.slice("__rules_r", 2, F.greatest(F.size("__rules_r") - 1, F.lit(0))), F.slice("__rules_r", 1, F.greatest(F.size("__rules_r") - 1, F.lit(0))), lambda b, a: F.least(b - a, F.lit(5)))
    covered = F.when(F.size("__rules_r") > 0, F.aggregate(gaps, F.lit(5), lambda s, x: s + x)).otherwise(F.lit(0))
    lines = F.filter(F.split("__rules_t", "\n"), lambda x: F.btrim(x, F.lit(" \t\x0b\f\r")) != "")
    df = df.withColumn("__rules_l", lines)
    counts = F.struct(
        n.cast("long").alias("n_words"),
        (F.char_length("__rules_t") - F.regexp_count("__rules_t", F.lit(BLANK))).cast("long").alias("word_chars"),
        F.regexp_count("__rules_t", F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        (F.size("__rules_l") - F.size(F.array_distinct("__rules_l"))).cast("long").alias("n_dup_lines"),
        covered.cast("long").alias("n_repeat_words"),
        F.size("__rules_l").cast("long").alias("n_lines"),
        F.size(F.array_intersect(F.split(F.lower("__rules_t"), r"[\x00-\x60\x7B-\x7F]+"), F.lit(STOP_WORDS))).cast("long").alias("stop_words"),
        F.regexp_count("__rules_t", F.lit("!")).cast("long").alias("n_bangs"),
        F.regexp_count("__rules_t", F.lit(r"[^\x20\x09-\x0DA-Za-z\x{80}-\x{10FFFF}]")).cast("long").alias("n_other"),
    )
    # Filters on a generated column stay above it, so that no filter repeats the counting.
    return df.withColumn("__rules_q", F.explode(F.array(counts))).drop("__rules_t", "__rules_w", "__rules_h", "__rules_s", "__rules_r", "__rules_l")


def judge(docs: DataFrame, text: str = "text", thresholds: tuple[tuple[str, float | None, float | None], ...] = THRESHOLDS) -> DataFrame:
    """All columns of ``docs`` and the counts, ``base_failed`` and ``kept``; a result replaces a column of its name."""
    q = lambda c: F.col(f"__rules_q.{c}")
    per_word = lambda c: q(c) / F.nullif(q("n_words"), F.lit(0))
    metrics = {
        "n_words": q("n_words"),
        "mean_word": per_word("word_chars"),
        "symbols_per_word": per_word("n_symbols"),
        "bangs_per_word": per_word("n_bangs"),
        "repeat_share": per_word("n_repeat_words"),
        "stop_words": q("stop_words"),
        "dup_line_share": q("n_dup_lines") / F.nullif(q("n_lines"), F.lit(0)),
        "letter_share": 1 - q("n_other") / F.nullif(q("word_chars"), F.lit(0)),
    }
    base_failed = (q("n_words") < 10) | (100 * q("n_repeat_words") > 20 * q("n_words"))
    rule = ~base_failed
    for name, least, most in thresholds:
        if least is not None:
            rule = rule & F.coalesce(metrics[name] >= least, F.lit(False))
        if most is not None:
            rule = rule & F.coalesce(metrics[name] <= most, F.lit(False))
    counts = {c: q(c) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")}
    return with_results(_counted(docs, text), counts | {"base_failed": base_failed, "kept": rule}).drop("__rules_q")
