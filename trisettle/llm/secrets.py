"""Secrets: key patterns, and a battery of randomness tests over long tokens.

Base kinds are ``assign``, ``access`` and ``hex``. The method adds ``random``: long tokens with a letter that no base
span covers and that look drawn from their inferred alphabet (hex, upper-case base 32, base 36 or base 64). Three
tests, a chi-squared test of uniform characters, a runs test about the middle of the alphabet and a lag-1 serial
correlation, give p-values for "drawn uniformly"; Fisher's method combines them. How random ordinary writing looks at a
similar length is measured on every stretch of every text, its Latin letters and digits run together and cut into
stretches of each length class: a token's p-value under "ordinary text" is the share of stretches of its length class that
look at least as random, and the Benjamini-Hochberg procedure picks one cutoff per length class.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trisettle.llm.common import text_or_empty, written
from trisettle.llm.spans import MATCH, as_spans, in_order, joined, let, matches

KINDS = ("assign", "access", "hex", "random")
# The base patterns. Quantifiers are possessive where nothing could be given back.
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]++"""
ASSIGNED = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}+"
HEX = r"(?<![0-9a-f])[0-9a-f]{24,}+"
#: High-recall candidates of the method: whole runs of token characters.
CANDIDATE = r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}+"
#: Alphabets by inferred encoding, in code order.
HEX_DIGITS = "0123456789abcdef"
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
BASE36 = "0123456789abcdefghijklmnopqrstuvwxyz"
BASE64 = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
#: Upper ends of the length classes, and the number of bins of the combined p-value's logarithm.
LENGTHS = (31, 47)
BINS = 100
FALSE_DISCOVERY = 0.01
SCORED = "struct<s:int,e:int,lettered:boolean,size:int,bin:int>"
#: Length of the stretches of ordinary text for each length class.
STRETCHES = (24, 40, 56)
#: Letters of a row that stretches are cut from: a multiple of all their lengths.
PIECE = 840


def upper_normal(z: Column) -> Column:
    """P(Z > z), by the logistic approximation (error below 0.0002)."""
    return 1.0 / (1.0 + F.exp(F.least(F.lit(300.0), 1.5976 * z + 0.070566 * z * z * z)))


def randomness(token: Column, alphabet: Column) -> Column:
    """Combined p-value of the three tests that ``token`` is drawn uniformly from ``alphabet``."""
    codes = let(alphabet, lambda a: F.transform(F.split(token, ""), lambda c: F.greatest(F.instr(a, c), F.lit(1)) - 1))

    # whatever is used twice is bound first, as lambdas know no common subexpressions
    def chi_squared(x: Column, n: Column, size: Column) -> Column:
        # a character's c places in sorted order add 1 + 3 + ... + (2 c - 1), which is its count squared
        squares = let(F.sort_array(x), lambda s: F.aggregate(F.transform(s, lambda c, i: 2 * (i + 1 - F.array_position(s, c)) + 1), F.lit(0).cast("long"), lambda acc, v: acc + v)).cast("double")
        chi, df = squares * size / n - n, size - 1
        # Wilson-Hilferty: the cube root of chi-squared over df is nearly normal
        z = (F.pow(F.greatest(chi, F.lit(0.0)) / df, F.lit(1 / 3)) - (1 - 2 / (9 * df))) / F.sqrt(2 / (9 * df))
        return let(z, upper_normal)

    def runs_test(x: Column, n: Column, size: Column) -> Column:
        def counted(high: Column) -> Column:
            n1 = F.aggregate(high, F.lit(0), lambda acc, c: acc + c).cast("double")
            runs = F.aggregate(F.sequence(F.lit(1), F.size(high) - 1), F.lit(1), lambda acc, i: acc + (high[i] != high[i - 1]).cast("int")).cast("double")
            return let(F.struct(n1.alias("n1"), runs.alias("runs"), (2 * n1 * (n - n1) / n + 1).alias("mean")), judged)

        def judged(r: Column) -> Column:
            deviation = F.sqrt(F.greatest((r["mean"] - 1) * (r["mean"] - 2) / (n - 1), F.lit(1e-9)))
            return F.when((r["n1"] == 0) | (r["n1"] == n), 0.0).otherwise(2 * let(F.abs(r["runs"] - r["mean"]) / deviation, upper_normal))

        return let(F.transform(x, lambda c: (c * 2 >= size).cast("int")), counted)

    def serial_test(x: Column, n: Column) -> Column:
        def about(m: Column) -> Column:
            spread = F.aggregate(x, F.lit(0.0), lambda acc, c: acc + (c - m) * (c - m))
            lagged = F.aggregate(F.sequence(F.lit(1), F.size(x) - 1), F.lit(0.0), lambda acc, i: acc + (x[i] - m) * (x[i - 1] - m))
            return let(spread, lambda v: F.when(v == 0, 0.0).otherwise(2 * let(F.abs(lagged / v) * F.sqrt(n), upper_normal)))

        return let(F.aggregate(x, F.lit(0.0), lambda acc, c: acc + c) / n, about)

    def tests(t: Column) -> Column:
        x, n, size = t["codes"], t["n"], t["size"]
        logs = [F.log(F.greatest(F.least(p, F.lit(1.0)), F.lit(1e-12))) for p in (chi_squared(x, n, size), runs_test(x, n, size), serial_test(x, n))]
        half = -(logs[0] + logs[1] + logs[2])  # half of Fisher's statistic, chi-squared with six degrees
        return let(half, lambda h: F.exp(-h) * (1 + h + h * h / 2))

    return let(F.struct(codes.alias("codes"), F.length(token).cast("double").alias("n"), F.length(alphabet).cast("double").alias("size")), tests)


def inferred_alphabet(token: Column) -> Column:
    return (F.when(token.rlike("^[0-9a-f]+$"), HEX_DIGITS).when(token.rlike("^[A-Z2-7]+$"), BASE32)
            .when(token.rlike("^[0-9a-z]+$"), BASE36).otherwise(BASE64))


def scored(found: Column) -> Column:
    """Candidates with their length class, kind of characters and the bin of their randomness (0: none at all)."""

    def row(x: Column) -> Column:
        p = let(inferred_alphabet(x["m"]), lambda a: randomness(F.translate(x["m"], "-_", "+/"), a))
        place = F.least(F.greatest(F.floor(BINS + 5 * F.log(F.greatest(p, F.lit(1e-9)))), F.lit(0)), F.lit(BINS)).cast("int")
        length = x["e"] - x["s"]
        size = F.when(length <= LENGTHS[0], 0).when(length <= LENGTHS[1], 1).otherwise(2)
        return F.struct(x["s"].alias("s"), x["e"].alias("e"), x["m"].rlike("[A-Za-z]").alias("lettered"), size.alias("size"), place.alias("bin"))

    return F.transform(found, row).cast(f"array<{SCORED}>")


def cutoffs(counts: list[tuple[int, int, int, int]], rate: float = FALSE_DISCOVERY) -> dict[int, int]:
    """By length class, the lowest bin whose tokens pass the Benjamini-Hochberg procedure; no entry: none passes.

    ``counts``: length class, bin, candidate tokens, ordinary stretches. p of a bin: (1 + ordinary ones in it or above)
    / (1 + ordinary ones). All tokens of all classes are tested together; a class's tokens pass where their p is at
    most rate * rank / number.
    """
    tests = sum(tokens for _, _, tokens, _ in counts)
    if not tests:
        return {}
    values = []
    for size in {x[0] for x in counts}:
        null = [x for x in counts if x[0] == size]
        total = sum(x[3] for x in null)
        values += [((1 + sum(x[3] for x in null if x[1] >= b)) / (1 + total), size, b, tokens) for s, b, tokens, _ in counts if s == size and tokens]
    passed, rank = 0.0, 0
    for p, _, _, tokens in sorted(values):
        rank += tokens
        if p <= rate * rank / tests:
            passed = p
    return {size: min(b for p, s, b, _ in values if s == size and p <= passed) for size in {s for p, s, _, _ in values if p <= passed}}


def stretches(docs: DataFrame) -> DataFrame:
    """m, size: every stretch of every length class, one after the other, of the Latin letters and digits of ``text``, and
    what the tests need of it: alphabet size, sums of squared counts, codes, squared codes and products of neighbours, the
    first and last code, codes in the upper half and runs.

    A stretch has no more letters than a word has bits, so the six bits of its codes are six words, and all but the
    counts of its characters come from counting bits. Codes are places in ``BASE64``; those of other alphabets are these
    with a constant added to each letter and digit, modulo 64."""
    pieces = docs.select(F.explode(F.regexp_extract_all(F.regexp_replace("text", "[^A-Za-z0-9]+", ""), F.lit(f".{{{STRETCHES[0]},{PIECE}}}"), F.lit(0))).alias("piece"))
    known = BASE64[:62]
    pieces = pieces.select("piece", *[F.translate("piece", known, "".join(str(k >> b & 1) for k in range(62))).alias(f"t{b}") for b in range(6)])
    slots = F.array(*[F.struct(F.lit(k).alias("size"), F.lit(n).alias("n"), F.lit(at).alias("at")) for k, n in enumerate(STRETCHES) for at in range(0, PIECE, n)])
    cut = pieces.select("*", F.inline(slots)).filter("at + n <= length(piece)")
    rows = cut.selectExpr("size", "n", "substring(piece, at + 1, n) AS m", *[f"coalesce(cast(conv(substring(t{b}, at + 1, n), 2, 10) AS bigint), 0L) AS p{b}" for b in range(6)], "(1L << n) - 1 AS full")
    rows = rows.selectExpr("*", "p5 & p4 & (p3 | p2) AS digit", "full & ~p5 & (~p4 | ~p3 | (~p2 & ~p1)) AS upper")
    rows = rows.selectExpr("*", "CASE WHEN upper = 0 THEN full ELSE 0L END AS by36", "CASE WHEN upper <> 0 AND (upper | digit) = full AND (digit & p2 & ~p1) = 0 THEN full ELSE 0L END AS by32")
    # lower-case letters are 16 places further up in BASE64 than in BASE36 and digits 52, digits 28 further than in BASE32
    rows = rows.selectExpr("size", "n", "m", "full", "by36", "by32", "p0 AS x0", "p1 AS x1", "p3", "p4", "p5", "p2 ^ ((by36 | by32) & digit) AS x2", "p2 & (by36 | by32) & digit AS k2", "by36 & digit AS c3", "by36 & ~digit AS c4", "(by36 & ~digit) | (by32 & digit) AS c5")
    rows = rows.selectExpr("*", "p3 ^ c3 ^ k2 AS x3", "(p3 & c3) | (p3 & k2) | (c3 & k2) AS k3")
    rows = rows.selectExpr("*", "p4 ^ c4 ^ k3 AS x4", "p5 ^ c5 ^ ((p4 & c4) | (p4 & k3) | (c4 & k3)) AS x5")
    rows = rows.selectExpr("size", "n", "m", "full", *[f"x{b}" for b in range(6)], "CASE WHEN by36 <> 0 THEN CASE WHEN (x5 | x4) = 0 THEN 16 ELSE 36 END WHEN by32 <> 0 THEN 32 ELSE 64 END AS letters")
    rows = rows.selectExpr("*", "CASE letters WHEN 16 THEN x3 WHEN 32 THEN x4 WHEN 36 THEN x5 | (x4 & (x3 | x2 | x1)) ELSE x5 END AS high")
    add = lambda terms: " + ".join(f"{w} * {x}" for w, x in terms)
    bits = range(6)
    rows = rows.selectExpr(
        "size", "n", "m", "letters", "bit_count(high) AS n_high", "1 + bit_count((high ^ (high >> 1)) & (full >> 1)) AS runs",
        add((1 << b, f"bit_count(x{b})") for b in bits) + " AS total",
        add((1 << a + b + (a != b), f"bit_count(x{a} & x{b})") for a in bits for b in bits if a <= b) + " AS squares",
        add((1 << a + b, f"bit_count(x{a} & (x{b} >> 1))") for a in bits for b in bits) + " AS lagged",
        add((1 << b, f"(x{b} >> (n - 1))") for b in bits) + " AS first", add((1 << b, f"(x{b} & 1)") for b in bits) + " AS last")
    counts = F.aggregate(F.array_distinct(F.split("m", "")), F.lit(0.0), lambda acc, c: acc + F.pow(F.col("n") - F.length(F.replace(F.col("m"), c, F.lit(""))), F.lit(2)))
    return rows.withColumn("counts", counts)


def ordinary(docs: DataFrame) -> DataFrame:
    """size, bin and the number of ordinary stretches of each: ``randomness`` of ``stretches``, from their sums."""
    rows = stretches(docs).withColumnsRenamed({"n": "len"}).withColumns({"n": F.col("len").cast("double"), "df": F.col("letters") - 1.0})
    normal = lambda z: f"(1.0D / (1.0D + exp(least(300.0D, 1.5976D * {z} + 0.070566D * {z} * {z} * {z}))))"
    rows = rows.selectExpr(
        "size", "n", "n_high", "runs", "(power(greatest(counts * letters / n - n, 0.0D) / df, 1.0D / 3) - (1 - 2 / (9 * df))) / sqrt(2 / (9 * df)) AS chi", "2.0D * n_high * (n - n_high) / n + 1 AS mean",
        "n * squares - cast(total AS double) * total AS spread", "n * lagged - cast(total AS double) * (2 * total - first - last) + (n - 1) * total * total / n AS together")
    rows = rows.selectExpr("size", "n", "chi", "n_high", "abs(runs - mean) / sqrt(greatest((mean - 1) * (mean - 2) / (n - 1), 1e-9D)) AS off", "spread", "CASE WHEN spread <> 0 THEN abs(together / spread) * sqrt(n) END AS serial")
    rows = rows.selectExpr("size", f"{normal('chi')} AS p1", f"CASE WHEN n_high = 0 OR n_high = n THEN 0.0D ELSE 2 * {normal('off')} END AS p2", f"CASE WHEN spread = 0 THEN 0.0D ELSE 2 * {normal('serial')} END AS p3")
    rows = rows.selectExpr("size", "-(" + " + ".join(f"ln(greatest(least(p{k}, 1.0D), 1e-12D))" for k in (1, 2, 3)) + ") AS half")
    rows = rows.selectExpr("size", "exp(-half) * (1 + half + half * half / 2) AS p")
    place = F.least(F.greatest(F.floor(BINS + 5 * F.log(F.greatest("p", F.lit(1e-9)))), F.lit(0)), F.lit(BINS)).cast("int")
    return rows.groupBy("size", place.alias("bin")).agg(F.count("*").alias("ordinary"))


def find(df: DataFrame, key: str = "doc_id", text: str = "text", rate: float = FALSE_DISCOVERY) -> DataFrame:
    """doc_id, the base spans by kind and ``added`` ones of every whole text.

    A null or empty text has no spans; repeated rows are searched each; extra columns are ignored; an empty table
    gives an empty result. Cutoffs come from bounded counts over all candidates and all stretches of ordinary text, for which
    the text is read a second time.
    Texts of other scripts add no stretches; with none at all, or too few for a p-value small enough, nothing is added.
    Tokens of digits alone are numbers and not added.
    """
    docs = df.select(F.col(key).alias("doc_id"), text_or_empty(text).alias("text"))
    none = F.array().cast(f"array<{MATCH}>")

    def where(hint: Column, pattern: str) -> Column:
        return F.when(hint, matches(F.col("text"), pattern)).otherwise(none)

    long_run = F.col("text").rlike(r"[A-Za-z0-9+/_-]{20}")
    rows = docs.select(
        "doc_id",
        as_spans(F.filter(matches(F.col("text"), ASSIGN), lambda x: F.length(F.regexp_extract(x["m"], ASSIGNED, 1)) >= 6), 0).alias("assign"),
        as_spans(where(F.contains("text", F.lit("AKIA")), ACCESS), 1).alias("access"),
        as_spans(where(long_run, HEX), 2).alias("hex"),
        scored(where(long_run, CANDIDATE)).alias("candidates"),
    )
    found = written(rows, "secret-candidates")
    covered = lambda x: F.exists(F.concat("assign", "access", "hex"), lambda b: (b["s"] <= x["s"]) & (b["e"] >= x["e"]))
    open_ones = F.filter("candidates", lambda x: x["lettered"] & ~covered(x))
    tokens = found.select(F.explode(open_ones).alias("x")).select("x.size", "x.bin", F.lit(1).alias("tokens"), F.lit(0).alias("ordinary"))
    codes = ordinary(docs).select("size", "bin", F.lit(0).alias("tokens"), "ordinary")
    tallies = tokens.union(codes).groupBy("size", "bin").agg(F.sum("tokens").alias("tokens"), F.sum("ordinary").alias("ordinary")).collect()
    limits = cutoffs([tuple(x) for x in tallies], rate)
    least = lambda size: F.coalesce(*[F.when(size == k, F.lit(b)) for k, b in sorted(limits.items())], F.lit(BINS + 1))
    kept = F.filter(open_ones, lambda x: x["bin"] >= least(x["size"]))
    return found.select("doc_id", "assign", "access", "hex", as_spans(kept, 3).alias("added"))


def summary(found: DataFrame) -> DataFrame:
    base = in_order(F.col("assign"), F.col("access"), F.col("hex"))
    spans = in_order(F.col("assign"), F.col("access"), F.col("hex"), F.col("added"))
    return found.select("doc_id", *[F.size(k).cast("long").alias(f"n_{k}") for k in KINDS[:3]],
                        F.sha2(joined(base, KINDS).cast("binary"), 256).alias("base_sha256"), joined(spans, KINDS).alias("spans"))
