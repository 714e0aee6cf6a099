"""Language identification as inference of a mixture.

Training counts hashed character trigrams of labelled documents by language. A document is taken as drawn from a
mixture of the languages: expectation-maximisation estimates the proportions from the likelihoods of its trigrams,
starting from all languages; then languages are dropped one by one, the smallest share first, while that lowers the
penalised likelihood ``-2 log L + parameters * log n`` (BIC). The prediction is the language with the largest share
of the chosen set.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trisettle.llm.common import small_batches

#: Hash buckets of trigrams.
BITS = 15
BUCKETS = 1 << BITS
#: Labelled documents of each language that training uses, in expectation: a bounded sample, chosen by a hash.
TRAIN_DOCUMENTS = 3_000
STEPS = 12
ANSWER = T.StructType([T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("mixture", T.StringType())])
LETTER = regex.compile(r"\p{L}")


def trigrams(text: str) -> np.ndarray:
    """Hash buckets of the trigrams of a text with its letters lower-cased; other characters count as one space."""
    codes = np.frombuffer((" " + text.lower() + " ").encode("utf-32-le", "replace"), "<u4")
    letters = codes > 127
    letters |= (codes >= 97) & (codes <= 122)
    codes = np.where(letters, codes, 32)
    gap = codes == 32
    keep = ~gap
    keep[1:] |= ~gap[:-1]
    keep[0] = True
    codes = codes[keep].astype(np.uint32)
    if len(codes) < 3:
        return np.zeros(0, np.int64)
    mixed = (codes[:-2] * np.uint32(0x9E3779B1)) ^ (codes[1:-1] * np.uint32(0x85EBCA77)) ^ (codes[2:] * np.uint32(0xC2B2AE3D))
    mixed ^= mixed >> np.uint32(15)
    mixed *= np.uint32(0x2C1B3C6D)
    return (mixed >> np.uint32(32 - BITS)).astype(np.int64)


def mixture(likelihood: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, float]:
    """Proportions and log-likelihood of the best mixture; rows of ``likelihood`` are trigrams, columns languages."""
    n = counts.sum()
    share = np.full(likelihood.shape[1], 1 / likelihood.shape[1])
    for _ in range(STEPS):
        total = likelihood @ share
        share = share * ((counts / total) @ likelihood) / n
    return share, float(counts @ np.log(likelihood @ share))


def inferred(grams: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Proportions over all languages, zero outside the chosen set."""
    counts = np.bincount(grams, minlength=BUCKETS)
    found = np.flatnonzero(counts)
    likelihood, counts = table[found], counts[found].astype(float)
    cost = np.log(counts.sum())
    langs = np.arange(table.shape[1])
    share, fit = mixture(likelihood, counts)
    while len(langs) > 1:
        keep = np.delete(np.arange(len(langs)), np.argmin(share))
        less, worse = mixture(likelihood[:, keep], counts)
        if -2 * worse + (len(keep) - 1) * cost > -2 * fit + (len(langs) - 1) * cost:
            break
        likelihood, langs, share, fit = likelihood[:, keep], langs[keep], less, worse
    out = np.zeros(table.shape[1])
    out[langs] = share
    return out


def sampled(df: DataFrame, per_language: int) -> DataFrame:
    """About ``per_language`` rows of each language, those with the lowest hash of their key."""
    totals = {r["lang"]: r["n"] for r in df.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not totals:
        return df
    rank = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30))
    limit = F.coalesce(*[F.when(F.col("lang") == k, F.lit(int(min(1.0, per_language / n) * (1 << 30)))) for k, n in sorted(totals.items())])
    return df.filter(rank < limit)


def train(df: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", per_language: int = TRAIN_DOCUMENTS) -> tuple[list[str], np.ndarray]:
    """Languages in order and the smoothed probability of each trigram bucket in each; only counts reach the driver."""
    rows = small_batches(df).select(F.col(key).alias("doc_id"), F.col(text).alias("text"), F.col(lang).alias("lang")).filter("text is not null and lang is not null")

    def counted(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[str, np.ndarray] = {}
        for batch in source:
            for doc, language in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                own = totals.setdefault(language, np.zeros(BUCKETS, np.int64))
                own += np.bincount(trigrams(doc.as_py()), minlength=BUCKETS)
        for language, own in sorted(totals.items()):
            found = np.flatnonzero(own)
            yield pa.RecordBatch.from_arrays([pa.array([language] * len(found)), pa.array(found), pa.array(own[found])], ["lang", "bucket", "n"])

    counts = sampled(rows, per_language).select("text", "lang").mapInArrow(counted, "lang string, bucket long, n long")
    found = counts.groupBy("lang", "bucket").agg(F.sum("n").alias("n")).collect()
    names = sorted({r["lang"] for r in found})
    table = np.full((BUCKETS, max(1, len(names))), 0.5)
    place = {x: i for i, x in enumerate(names)}
    for r in found:
        table[r["bucket"], place[r["lang"]]] += r["n"]
    return names, table / table.sum(axis=0)


def predict(df: DataFrame, model: tuple[list[str], np.ndarray], *keep: str, text: str = "text") -> DataFrame:
    """The columns ``keep`` with lang_pred, score (share of that language) and mixture (text of all shares).

    Null texts and texts without a letter are ``und`` with score 0, and so is every text of a model without
    languages; ties go to the first language in order; texts are taken whole; repeated rows are judged each.
    """
    broadcast = small_batches(df).sparkSession.sparkContext.broadcast(model)

    # only the text goes to Python and only the answer comes back; the other columns stay where they are
    @F.pandas_udf(ANSWER)
    def infer(source: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        names, table = broadcast.value
        for texts in source:
            out = []
            for doc in texts:
                grams = trigrams(doc) if isinstance(doc, str) and names and LETTER.search(doc) else ()
                if not len(grams):
                    out.append(("und", 0.0, ""))
                    continue
                share = inferred(grams, table)
                best = int(np.argmax(share))
                parts = ",".join(f"{names[i]}:{share[i]:.4f}" for i in np.flatnonzero(share))
                out.append((names[best], float(min(1.0, share[best])), parts))
            yield pd.DataFrame(out, columns=["lang_pred", "score", "mixture"])

    # as it is costly, no filter on the answer may be pushed below it and ask twice
    answer = infer.asNondeterministic()(F.col(text).cast("string")).alias("_answer")
    return df.select(*keep, answer).select(*keep, "_answer.*")


def held_out(key: str = "doc_id"):
    """The fold that training never sees."""
    return F.crc32(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")) % 3 == 1


def fold_model(df: DataFrame, key: str = "doc_id") -> tuple[list[str], np.ndarray]:
    return train(df.filter(~held_out(key)), key)
