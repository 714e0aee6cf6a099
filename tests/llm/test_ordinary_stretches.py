"""op8: every stretch of ordinary text counts, with the same randomness as a token of the same letters."""

from __future__ import annotations

import random
import re
from collections import Counter

from pyspark.sql import functions as F

from trisettle.llm import secrets


def test_every_stretch_is_measured_as_a_token_is(spark):
    rnd = random.Random(3)
    kinds = ["0123456789abcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", "ABCDEFGHIJKLMNOPQRSTUVWXYZ0189", "abcdefghijklmnopqrstuvwxyz0123456789", secrets.BASE64[:62], "a", "Zz", "etaoinshrdlu", "0123456789", "QZ9"]
    texts = ["".join(rnd.choice(kinds[k % len(kinds)]) + (" - " if rnd.random() < 0.2 else "") for _ in range(rnd.choice([0, 23, 24, 60, 900, 2000]))) for k in range(40)] + [None, "ß€ ", "x" * 24]
    want = Counter()
    for text in texts:
        run = re.sub("[^A-Za-z0-9]+", "", text or "")
        for size, n in enumerate(secrets.STRETCHES):
            want.update((size, run[at:at + n]) for at in range(0, len(run) - n + 1, n))
    docs = spark.createDataFrame([(t,) for t in texts], "text string").select(F.coalesce("text", F.lit("")).alias("text"))
    got = Counter()
    for r in secrets.stretches(docs).select("size", "m").collect():
        got[r.size, r.m] += 1
    assert got == want and len(want) > 800
    # the same stretches as tokens, by the tests over arrays
    words = spark.createDataFrame([(size, m, n) for (size, m), n in want.items()], "size int, m string, times long")
    token = F.struct(F.lit(0).alias("s"), F.length("m").alias("e"), F.col("m").alias("m"), F.lit("").alias("before"), F.lit("").alias("after"))
    slow = words.select("times", F.explode(secrets.scored(F.array(token))).alias("x")).groupBy("x.size", "x.bin").agg(F.sum("times").alias("n"))
    slow, fast = ({(r[0], r[1]): r[2] for r in t.collect()} for t in (slow, secrets.ordinary(docs)))
    assert sum(fast.values()) == sum(slow.values()) == sum(want.values())
    assert fast == slow and len({b for _, b in fast}) > 20
