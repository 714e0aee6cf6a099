"""Quality rules whose cutoffs carry a guarantee.

Every rule measures a text; a cutoff rejects texts above it. Labelled good documents show how many a cutoff would
reject wrongly. For each stratum (language) and rule the cutoffs of a fixed grid are tested in a fixed sequence, the
mildest first: one passes if the exact binomial upper bound on its false rejection is within the rule's share of the
risk, and the first that fails ends the sequence. Such a sequence needs no correction within itself; the level is
divided by the number of strata and rules (Bonferroni), so all chosen cutoffs hold together.
"""

from __future__ import annotations

import math
from itertools import chain

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trisettle.llm.common import SPACE, written
from trisettle.llm.spans import let

#: Rules and their cutoffs, strictest first; fixed beforehand, as the sequence of tests must be.
RULES = {
    "symbol_share": (0.02, 0.05, 0.1, 0.2, 0.3),
    "repeat_share": (0.1, 0.2, 0.3, 0.4, 0.5),
    "dup_line_share": (0.1, 0.2, 0.3, 0.4, 0.5),
    "mean_word_chars": (8.0, 10.0, 12.0, 15.0, 20.0),
}
RISK = 0.05
LEVEL = 0.05


def word_list(text: Column) -> Column:
    return F.array_remove(F.split(text, f"{SPACE}+"), "")


def repeated_words(grams: Column) -> Column:
    """Words covered by windows whose hash occurs twice or more: equal windows meet after sorting (hash, place)."""

    def covered(rows: Column) -> Column:
        twice = lambda x, i: (x["h"] == F.get(rows, i - 1)["h"]) | (x["h"] == F.get(rows, i + 1)["h"])
        places = F.transform(F.filter(rows, twice), lambda x: F.array(x["p"], x["p"] + 1, x["p"] + 2))
        return F.size(F.array_distinct(F.flatten(places)))

    rows = F.array_sort(F.transform(grams, lambda h, i: F.struct(h.alias("h"), i.alias("p"))))
    return F.when(F.size(F.array_distinct(grams)) == F.size(grams), 0).otherwise(let(rows, covered))


def measures(df: DataFrame, key: str = "doc_id", text: str = "text", stratum: str = "lang") -> DataFrame:
    """doc_id, stratum and the counts of every whole text; a null text has no words and one empty line."""
    docs = df.select(F.col(key).alias("doc_id"), F.coalesce(F.col(stratum), F.lit("")).alias("stratum"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    docs = docs.withColumn("words", word_list(F.col("text")))
    hashes = let(F.col("words"), lambda w: F.transform(F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.xxhash64(w[i], w[i + 1], w[i + 2])))
    docs = docs.withColumn("grams", F.when(F.size("words") >= 3, hashes).otherwise(F.array().cast("array<bigint>")))
    lines = F.filter(F.split("text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    return docs.select(
        "doc_id", "stratum",
        F.size("words").cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        (F.length("text") - F.length(F.regexp_replace("text", r"[#*$%&|<>]+", ""))).cast("long").alias("n_symbols"),
        let(lines, lambda x: F.struct((F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("dup"), F.size(x).cast("long").alias("all"))).alias("lines"),
        repeated_words(F.col("grams")).cast("long").alias("n_repeat_words"),
    ).select("doc_id", "stratum", "n_words", "word_chars", "n_symbols", F.col("lines.dup").alias("n_dup_lines"), F.col("lines.all").alias("n_lines"), "n_repeat_words",
             ((F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))).alias("base_failed"))


def share(part: str, whole: str) -> Column:
    return F.when(F.col(whole) > 0, F.col(part) / F.col(whole)).otherwise(0.0)


def rule_values() -> dict[str, Column]:
    return {
        "symbol_share": share("n_symbols", "word_chars"),
        "repeat_share": share("n_repeat_words", "n_words"),
        "dup_line_share": share("n_dup_lines", "n_lines"),
        "mean_word_chars": share("word_chars", "n_words"),
    }


def binomial_tail(k: int, n: int, p: float) -> float:
    """P(X <= k) of a binomial(n, p): the regularised incomplete beta function of (n - k, k + 1) at 1 - p."""
    if k >= n:
        return 1.0
    return 0.0 if k < 0 else incomplete_beta(n - k, k + 1, 1 - p)


def incomplete_beta(a: float, b: float, x: float) -> float:
    """I_x(a, b) by its continued fraction, which takes about sqrt(a + b) steps on the side where it converges."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1.0 - incomplete_beta(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    kept = lambda v: v if abs(v) > 1e-300 else 1e-300
    c, d = 1.0, 1 / kept(1 - (a + b) * x / (a + 1))
    total, m = d, 1
    while True:
        for factor in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 / kept(1 + factor * d)
            c = kept(1 + factor / c)
            total *= c * d
        if abs(c * d - 1) < 1e-14:
            return front * total
        m += 1


def cutoffs(measured: DataFrame, labels: DataFrame, risk: float = RISK, level: float = LEVEL) -> dict[str, list[float | None]]:
    """By stratum, for each rule the strictest cutoff with bounded false rejection; None where no cutoff has it.

    Only counts reach the driver: one row for each stratum.
    """
    good = labels.groupBy("doc_id").agg(F.min("quality").alias("quality")).filter("quality = 1").select("doc_id")
    held = measured.filter(~F.col("base_failed")).join(good, "doc_id", "left_semi")
    counts = [F.count_if(value > c).alias(f"{name}|{i}") for name, value in rule_values().items() for i, c in enumerate(RULES[name])]
    rows = held.groupBy("stratum").agg(F.count("*").alias("n"), *counts).collect()
    tests = max(1, len(rows)) * len(RULES)
    each = risk / len(RULES)  # the rules together reject at most ``risk`` of the good documents

    def strictest(row, name: str) -> float | None:
        found = None
        for i, cutoff in reversed(list(enumerate(RULES[name]))):
            if binomial_tail(row[f"{name}|{i}"], row["n"], each) > level / tests:
                break
            found = cutoff
        return found

    return {row["stratum"]: [strictest(row, name) for name in RULES] for row in rows}


def judge(df: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", stratum: str = "lang") -> DataFrame:
    """Counts, base_failed, kept and the rules that rejected (``failed_rules``) of every document.

    A null or empty text fails the base; a null stratum is a stratum of its own; strata without enough labelled
    documents, or without any, only have the base rules; repeated rows are judged each; repeated labels of a document
    count once, the worst of them; extra columns are ignored; empty tables give empty results.
    """
    measured = written(measures(df, key, text, stratum), "quality-measures")
    limits = cutoffs(measured, labels.select("doc_id", "quality"))
    none = F.array(*[F.lit(None).cast("double")] * len(RULES))
    found = none
    if limits:
        table = F.create_map(*chain.from_iterable((F.lit(k), F.array(*[F.lit(x).cast("double") for x in v])) for k, v in sorted(limits.items())))
        found = F.coalesce(F.try_element_at(table, F.col("stratum")), none)
    broken = [F.when(value > found[i], F.lit(name)) for i, (name, value) in enumerate(rule_values().items())]
    return (measured.withColumn("failed_rules", F.array_compact(F.array(*broken)))
            .withColumn("kept", ~F.col("base_failed") & (F.size("failed_rules") == 0)))
