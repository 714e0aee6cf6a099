"""Personal data: base patterns, and candidates judged by boosted trees.

High-recall generators propose mail-like and number-like spans. Each has a few small integer features of its format
and its context. Gradient boosted trees of depth two learn which candidates are personal data. There are no labelled
spans, so the lessons are made from what the base is sure of and from plain text:

* right: candidates that overlap a base span; every base mail with its sign and dots spelled out, with two and with three
  parts; every base phone in a dozen local layouts, with and without a trunk zero, next to a phone's cue (``POSITIVE``);
* wrong: other candidates, except spelled-out mails and phone-sized numbers next to a cue, of which nothing is known;
  plain text with a two-letter word for the sign; spelled-out mails whose parts are no domain; the same local layouts
  without a cue; and, from the phones' own digits, lists, ranges, years, sums and dates with and without a cue.

As features are bins, training needs only counts by feature vector, taken over all documents. Isotonic regression on
held-out documents calibrates the score for each form (how a mail's dots are written, how many groups a number has),
equal scores pooled; candidates of a calibrated probability of at least ``PRECISION`` are added as kind ``other``. In a
form that had no wrong rows to judge by nothing is added.
"""

from __future__ import annotations

import math
from collections import defaultdict
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trisettle.llm.common import text_or_empty, written
from trisettle.llm.spans import MATCH, SPAN, as_spans, in_order, joined, let, matches, redacted

KINDS = ("email", "ip", "card", "phone", "other")
# The base patterns; look-behinds stand where a match could only begin at the first of like characters.
EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?[0-9]){13,}+"
PHONE = r"\+[0-9][ ().0-9-]+[0-9]"
OCTETS = r"^0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])(?:\.0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])){3}$"
#: High-recall generators.
MAIL_LIKE = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++ ?(?:@|\(at\)|\[at\]) ?[A-Za-z0-9-]++(?: ?(?:\.|\(dot\)|\[dot\]) ?[A-Za-z0-9-]++)*+"
NUMBER_LIKE = r"(?<![0-9A-Za-z])[+(]?[0-9][0-9 ().\-/]{5,}[0-9]"
#: A mail up to where a blank beside a bare dot may already be the next sentence; the generator's sign in it.
DOT = r"(?: \. |\.| ?(?:\(dot\)|\[dot\]) ?)"
SIGN = r" ?(?:@|\(at\)|\[at\]) ?"
TIGHT = rf"^[A-Za-z0-9._%+-]+{SIGN}[A-Za-z0-9-]+(?:{DOT}[A-Za-z0-9-]+)*"
#: Plain text of the form of MAIL_LIKE, a two-letter word in the place of the sign.
DECOY = MAIL_LIKE.replace(r" ?(?:@|\(at\)|\[at\]) ?", " [a-z]{2} ")
DATE = r"^(?:[0-9]{4}[-/. ][0-9]{1,2}[-/. ][0-9]{1,2}|[0-9]{1,2}[-/. ][0-9]{1,2}[-/. ][0-9]{4})(?![0-9])"
COUNTRY = r"^\+(?:[0-9]{1,3}(?=[ ().-])|[0-9]{2})[ .-]*"
#: A phone's cue, and where it stands right before the number.
CUE = r"\b(?:tele?(?:phone|fon)?|phone|call|fax|mobile?|ring)\b"
NEAR = rf"{CUE}(?: ?(?:me|us|at|on|no|number|under|nr))*[.:]* *$"
FEATURES = ("generator", "plus", "digits", "groups", "equal", "short", "lead", "loose", "thousands", "years", "octets", "cue", "left", "date", "luhn", "at", "dots", "spelled", "labels", "tail")
ROUNDS, SHRINK, PRECISION = 24, 0.4, 0.9
CANDIDATE = f"struct<s:int,e:int,{','.join(f'{x}:int' for x in FEATURES)}>"
#: How a mail's sign and dots may be written; cues and other words before a number.
SIGNS = (" (at) ", "(at)", " [at] ", "[at]")
DOTS = (".", " (dot) ", "(dot)", " [dot] ", "[dot]")
COUNTRIES = ("de", "fr", "co.uk", "es")
CUES = ("call ", "phone: ", "Tel. ", "tel ", "fax: ", "mobile ", "call me at ")
OTHERS = ("the order ", "item no. ", "in ", "between ", "of about ", "page ")


def digits(token: Column) -> Column:
    return F.regexp_replace(token, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""

    def step(acc: Column, i: Column) -> Column:
        d = F.substr(number, F.length(number) - i, F.lit(1)).cast("int")
        twice = F.when(i % 2 == 1, d * 2 - F.when(d > 4, 9).otherwise(0)).otherwise(d)
        return acc + twice

    return F.aggregate(F.sequence(F.lit(0), F.length(number) - 1), F.lit(0), step) % 10 == 0


def base(text: Column) -> dict[str, Column]:
    """The base spans of a text by kind."""
    none = F.array().cast(f"array<{MATCH}>")
    numbers = text.rlike(r"[0-9]{2}|[0-9][ .-][0-9]")

    def some(hint: Column, pattern: str, valid) -> Column:
        return F.filter(F.when(hint, matches(text, pattern)).otherwise(none), lambda x: valid(x["m"]))

    def long_enough(low: int, high: int):
        return lambda m: F.length(digits(m)).between(low, high)

    return {
        "email": as_spans(some(F.contains(text, F.lit("@")), EMAIL, lambda m: F.lit(True)), 0),
        "ip": as_spans(some(numbers, IP, lambda m: m.rlike(OCTETS)), 1),
        "card": as_spans(some(numbers, CARD, lambda m: long_enough(14, 19)(m) & luhn(digits(m))), 2),
        "phone": as_spans(some(F.contains(text, F.lit("+")) & numbers, PHONE, long_enough(10, 15)), 3),
    }


def features(m: Column, before: Column, generator: int) -> dict[str, Column]:
    """The features of a candidate."""
    zero = F.lit(0)
    lower = F.lower(before)
    if generator == 0:
        domain = F.regexp_replace(m, rf"^[A-Za-z0-9._%+-]+{SIGN}", "")
        labels = F.split(domain, DOT, -1)
        own = {
            "at": m.rlike("[^ ]@[^ ]").cast("int"),
            "dots": F.least(F.size(labels) - 1, F.lit(4)),
            "spelled": F.when(domain.rlike(r"[(\[]dot[)\]]"), 2).when(domain.rlike(r" \. "), 3).when(F.contains(domain, F.lit(".")), 1).otherwise(0),
            "labels": F.array_min(F.transform(labels, lambda x: F.least(F.length(x), F.lit(3)))),
            "tail": domain.rlike(rf"{DOT}(?:[a-z]{{2,24}}|[A-Z]{{2,24}})$").cast("int"),
            "cue": F.when(lower.rlike("mail|contact"), 1).otherwise(0),
        }
    else:
        n = F.length(digits(m))
        sizes = F.transform(F.regexp_extract_all(m, F.lit("[0-9]+"), F.lit(0)), lambda x: F.length(x))
        own = {
            "digits": F.when(n < 7, 0).when(n < 10, 1).when(n < 13, 2).when(n < 14, 3).when(n < 17, 4).when(n < 20, 5).otherwise(6),
            "groups": F.least(F.size(sizes), F.lit(6)),
            "equal": (F.size(F.array_distinct(sizes)) == 1).cast("int") * F.when(F.size(sizes) > 1, 1).otherwise(0),
            "short": F.least(F.array_min(sizes), F.lit(4)),
            "plus": m.startswith("+").cast("int"),
            "lead": F.when(m.startswith("("), 2).when(m.startswith("0"), 1).otherwise(0),
            "loose": m.rlike(r" [-/.]|[-/.] ").cast("int"),
            "thousands": m.rlike(r"^[1-9][0-9]{0,2}(?:[ .][0-9]{3})+$").cast("int"),
            "years": m.rlike(r"^(?:19|20)[0-9]{2}(?:[^0-9]+(?:19|20)[0-9]{2})+$").cast("int"),
            "octets": F.when(m.rlike(OCTETS), 1).when(m.rlike(r"^[0-9]+(?:\.[0-9]+){3}$"), 2).otherwise(0),
            "date": m.rlike(DATE).cast("int"),
            "luhn": F.when(n.between(14, 19), luhn(digits(m)).cast("int")).otherwise(0),
            "cue": F.when(lower.rlike(NEAR), 2).when(lower.rlike(CUE), 5).when(lower.rlike("card|visa|account|iban"), 3).when(lower.rlike("ip|host|server|addr"), 4).otherwise(0),
        }
    left = F.substring(before, -1, 1)
    own |= {"generator": F.lit(generator), "left": F.when(left.rlike(r"^\s*$"), 0).when(left.rlike("[0-9]|\\p{L}"), 2).otherwise(1)}
    return {name: own.get(name, zero) for name in FEATURES}


def candidates(text: Column) -> Column:
    """What the generators propose, with features."""
    none = F.array().cast(f"array<{MATCH}>")

    def row(x: Column, m: Column, generator: int) -> Column:
        return let(m, lambda m: F.struct(x["s"].alias("s"), (x["s"] + F.length(m)).alias("e"), *[v.alias(k) for k, v in features(m, x["before"], generator).items()]))

    mails = F.when(text.rlike(r"@|[(\[]at[)\]]"), matches(text, MAIL_LIKE)).otherwise(none)
    numbers = F.when(text.rlike(r"[0-9][0-9 ().\-/]{5}"), matches(text, NUMBER_LIKE)).otherwise(none)
    return F.concat(F.transform(mails, lambda x: row(x, F.regexp_extract(x["m"], TIGHT, 0), 0)), F.transform(numbers, lambda x: row(x, x["m"], 1))).cast(f"array<{CANDIDATE}>")


def decoys(text: Column) -> Column:
    """Plain text as if a two-letter word in it were a mail's sign: those that have dots, and how many have none."""
    found = F.regexp_extract_all(text, F.lit(DECOY), F.lit(0))

    def sorted_out(all_: Column) -> Column:
        dotted = F.filter(all_, lambda m: m.rlike(r"^[^ ]+ [a-z]{2} .*[.\])]"))
        return F.struct((F.size(all_) - F.size(dotted)).alias("plain"), F.transform(dotted, lambda m: F.regexp_replace(m, r"^([^ ]+) [a-z]{2} ", "$1 (at) ")).alias("dotted"))

    return let(found, sorted_out)


def proposed(df: DataFrame, key: str, text: str, *keep: str) -> DataFrame:
    """The base spans by kind, candidates, and what lessons are made of (mails, phones, decoys), beside the columns ``keep``."""
    rows = df.select(F.col(key).alias("doc_id"), text_or_empty(text).alias("_text"), *keep)
    body = F.col("_text")
    found = rows.select("doc_id", "_text", *keep, *[v.alias(k) for k, v in base(body).items()], candidates(body).alias("candidates"), decoys(body).alias("decoys"))
    said = lambda spans: F.transform(spans, lambda x: F.substr(body, x["s"] + 1, x["e"] - x["s"]))
    return found.select("doc_id", *keep, *KINDS[:4], "candidates", "decoys", said("email").alias("mails"), said("phone").alias("phones"))


def overlaps(spans: Column, x: Column) -> Column:
    return F.exists(spans, lambda b: (b["s"] < x["e"]) & (b["e"] > x["s"]))


@dataclass(frozen=True)
class Model:
    """Trees (feature, cut, left node, right node; a float is a leaf) and the least margin for each form."""

    trees: tuple
    margins: dict[int, float]

    def margin(self, row: dict[str, int]) -> float:
        def leaf(node) -> float:
            while not isinstance(node, float):
                node = node[2] if row[node[0]] <= node[1] else node[3]
            return node

        return sum(map(leaf, self.trees))

    def column(self, x: Column) -> Column:
        """Whether the candidate ``x`` is chosen."""

        def leaf(node) -> Column:
            return F.lit(node) if isinstance(node, float) else F.when(x[node[0]] <= node[1], leaf(node[2])).otherwise(leaf(node[3]))

        if not self.margins:
            return F.lit(False)
        total = sum((leaf(t) for t in self.trees), F.lit(0.0))
        least = F.coalesce(*[F.when(form_of(x) == k, F.lit(v)) for k, v in sorted(self.margins.items())], F.lit(math.inf))
        return total >= least - 1e-9


def form_of(x):
    """The form of a candidate, of a row of counts or a Column: how a mail's dots are written, how many groups a number has."""
    return 10 * x["generator"] + x["spelled"] + x["groups"]


def grown(rows: list[tuple[dict, float, float]], depth: int):
    """A regression tree by Newton's steps over (features, gradient, curvature)."""
    g, h = sum(r[1] for r in rows), sum(r[2] for r in rows)
    best = None
    if depth:
        for name in FEATURES:
            sums = defaultdict(lambda: [0.0, 0.0])
            for row, a, b in rows:
                sums[row[name]][0] += a
                sums[row[name]][1] += b
            left_g = left_h = 0.0
            for value in sorted(sums)[:-1]:
                left_g += sums[value][0]
                left_h += sums[value][1]
                gain = left_g**2 / (left_h + 1) + (g - left_g) ** 2 / (h - left_h + 1) - g**2 / (h + 1)
                if gain > 1e-6 and (best is None or gain > best[0] + 1e-12):
                    best = gain, name, value
    if best is None:
        return SHRINK * g / (h + 1)
    _, name, value = best
    return name, value, grown([r for r in rows if r[0][name] <= value], depth - 1), grown([r for r in rows if r[0][name] > value], depth - 1)


def boosted(counts: list[dict]) -> tuple:
    """Trees from counts by feature vector: dicts with FEATURES, ``yes`` and ``no``."""
    margins, trees = [0.0] * len(counts), []
    for _ in range(ROUNDS):
        chances = [1 / (1 + math.exp(-max(-30.0, min(30.0, m)))) for m in margins]
        tree = grown([(c, c["yes"] - (c["yes"] + c["no"]) * p, (c["yes"] + c["no"]) * p * (1 - p)) for c, p in zip(counts, chances, strict=True)], 2)
        trees.append(tree)
        one = Model((tree,), {})
        margins = [m + one.margin(c) for m, c in zip(margins, counts, strict=True)]
    return tuple(trees)


def calibrated(scored: list[tuple[float, float, float]], least: float) -> float | None:
    """The lowest margin whose isotonic probability on (margin, yes, no) is at least ``least``; rows of one margin are
    one row. None if there is no such margin, or no wrong row at all to judge by."""
    pooled: dict[float, list[float]] = defaultdict(lambda: [0.0, 0.0])
    for margin, yes, no in scored:
        pooled[round(margin, 9)][0] += yes
        pooled[round(margin, 9)][1] += no
    if not sum(no for _, no in pooled.values()):
        return None
    blocks: list[list[float]] = []
    for margin, (yes, no) in sorted(pooled.items()):
        blocks.append([margin, yes, yes + no])
        while len(blocks) > 1 and blocks[-2][1] * blocks[-1][2] >= blocks[-1][1] * blocks[-2][2]:
            _, yes, n = blocks.pop()
            blocks[-1][1] += yes
            blocks[-1][2] += n
    return next((m for m, yes, n in blocks if yes >= least * n), None)


def made(text: Column, before: Column, right: bool) -> Column:
    return F.struct(text.alias("m"), before.alias("before"), F.lit(right).alias("yes"))


def pick(values: tuple[str, ...], key: Column, salt: int) -> Column:
    return F.array(*map(F.lit, values))[F.pmod(F.xxhash64(key, F.lit(salt)), F.lit(len(values))).cast("int")]


def made_mails(mail: Column) -> Column:
    """A base mail spelled out with two and three parts, and spelled out so that it is none."""
    parts = F.split(F.regexp_extract(mail, "@(.*)$", 1), r"\.")
    local, last, name = F.regexp_extract(mail, "^([^@]*)@", 1), F.element_at(parts, -1), F.element_at(parts, -2)
    outer = F.when(F.size(parts) > 2, F.element_at(parts, -3)).otherwise(F.lit("mail"))
    rows = []
    for i, dot in enumerate(DOTS):
        sign = pick(SIGNS, mail, i)
        rows += [made(F.concat(local, sign, name, F.lit(dot), last), F.lit("to "), True), made(F.concat(local, sign, name, F.lit(dot), pick(COUNTRIES, mail, i)), F.lit("to "), True), made(F.concat(local, sign, outer, F.lit(dot), name, F.lit(dot), last), F.lit("to "), True),
                 made(F.concat(local, sign, name, F.lit(dot + "5")), F.lit("to "), False), made(F.concat(local, sign, F.lit(f"a{dot}b{dot}"), last), F.lit("to "), False),
                 made(F.concat(local, sign, F.substring(name, 1, 1), F.lit(dot), last), F.lit("to "), False)]
    rows += [made(F.concat(local, pick(SIGNS, mail, 7), name), F.lit("to "), False), made(F.concat(local, pick(SIGNS, mail, 8), name, F.lit(" . "), last), F.lit("to "), False)]
    return F.array(*rows)


def made_numbers(phone: Column) -> Column:
    """A base phone in local layouts next to a cue, and wrong rows of its digits: the layouts without a cue, and lists,
    ranges, years, sums and dates with and without one."""
    n = F.regexp_replace(digits(F.regexp_replace(phone, COUNTRY, "")), "^0+", "")
    cut = lambda a, size=None: F.substring(n, a, size if size else 20)
    join = lambda sep, *parts: F.concat(*[x for p in parts for x in (F.lit(sep), p)][1:])
    zero = F.lit("0")
    layouts = [F.concat(zero, n), join(" ", F.concat(zero, cut(1, 3)), cut(4)), join("/", F.concat(zero, cut(1, 3)), cut(4)), join("-", F.concat(zero, cut(1, 2)), cut(3, 4), cut(7)), join(" ", F.concat(zero, cut(1, 2)), cut(3, 4), cut(7)),
               join("-", F.concat(zero, cut(1, 3)), cut(4, 3), cut(7)), F.concat(F.lit("(0"), cut(1, 2), F.lit(") "), cut(3, 3), F.lit("-"), cut(6)), F.concat(F.lit("(0"), cut(1, 3), F.lit(") "), cut(4)),
               join("-", cut(1, 3), cut(4, 3), cut(7)), F.concat(F.lit("("), cut(1, 3), F.lit(") "), cut(4, 3), F.lit("-"), cut(7, 4)), join(" ", cut(1, 3), cut(4, 3), cut(7)), join(".", cut(1, 3), cut(4, 3), cut(7)), join("-", cut(1, 3), cut(4, 4))]
    two, four = lambda i: F.concat(F.lit("20"), cut(i, 2)), lambda i: F.concat(F.lit("1"), cut(i, 3))
    tens = [F.concat(F.lit(str(k)), cut(k, 1)) for k in range(1, 7)]
    hundreds = [F.concat(F.lit(str(k)), cut(k, 2)) for k in range(1, 6)]
    lists = [join(" ", *tens[:5]), join(" ", *tens), join("-", *tens[:4]), join(" ", *hundreds[:3]), join(" ", *hundreds), join("/", *hundreds[:3]), join(" ", two(1), two(3)), join("-", two(1), two(3)), join(" ", two(1), two(3), two(5)), join(" ", two(1), two(3), two(5), two(7)),
             join(" - ", four(1), four(4)), join(" - ", four(1), four(3), four(5)), join(" - ", F.concat(zero, cut(1, 3)), cut(4, 4)), join(" ", F.lit("1"), cut(1, 3), cut(4, 3)), join(".", F.concat(F.lit("1"), cut(1, 2)), cut(3, 3), cut(6, 3)), join(" ", cut(1, 2), F.lit("000"), F.lit("000")),
             join("-", two(1), F.lit("03"), cut(3, 2)), join(" ", *[four(i) for i in (1, 2, 3)]), join(" ", *[F.concat(F.lit(str(k)), cut(k, 4)) for k in (1, 2)]), join(" - ", F.concat(cut(1, 2), F.lit(".5")), F.concat(cut(3, 2), F.lit(".75"))), join(" / ", cut(1, 3), cut(4, 4))]
    rows = []
    for i, layout in enumerate(layouts):
        rows += [made(layout, pick(CUES, phone, i), True), made(layout, pick(OTHERS, phone, i), False)]
    for i, values in enumerate(lists):
        rows += [made(values, pick(CUES, phone, 20 + i), False), made(values, pick(OTHERS, phone, 50 + i), False), made(values, F.lit("call me in "), False)]
    return F.filter(F.array(*rows), lambda x: F.regexp_extract(x["m"], NUMBER_LIKE, 0) == x["m"])


def lessons(found: DataFrame) -> DataFrame:
    """Counts (yes, no) by held, made (1: made of base spans, 2: of plain text) and FEATURES."""
    held = (F.pmod(F.xxhash64("doc_id"), F.lit(3)) == 0).alias("held")
    known = F.concat(*KINDS[:4])

    def taught(k: Column) -> Column:
        def known_nothing_of(x: Column) -> Column:
            return ((x["generator"] == 0) & (x["at"] == 0)) | ((x["generator"] == 1) & (x["plus"] == 0) & x["digits"].between(1, 3) & (x["cue"] == 2))

        rows = F.transform("candidates", lambda x: x.withField("yes", overlaps(k, x)).withField("made", F.lit(0)))
        failing = F.filter(rows, lambda x: x["yes"] & ((x["luhn"] == 1) | (x["octets"] == 1)))
        failed = F.transform(failing, lambda x: x.withField("luhn", F.lit(0)).withField("octets", F.when(x["octets"] == 1, 2).otherwise(x["octets"])).withField("yes", F.lit(False)))
        return F.concat(F.filter(rows, lambda x: x["yes"] | ~known_nothing_of(x)), failed)

    real = found.filter(F.size("candidates") > 0).select(held, F.explode(let(known, taught)).alias("x")).select("held", "x.made", *[F.col(f"x.{f}") for f in FEATURES], F.col("x.yes").cast("double").alias("yes"), (~F.col("x.yes")).cast("double").alias("no"))
    parts = [real]
    for column, generator, make in (("mails", 0, made_mails), ("phones", 1, made_numbers)):
        rows = found.filter(F.size(column) > 0).select(held, F.explode(column).alias("one")).select("held", F.explode(make(F.col("one"))).alias("x"))
        said = F.regexp_extract("x.m", TIGHT, 0) if generator == 0 else F.col("x.m")
        parts.append(rows.select("held", F.lit(1).alias("made"), *[v.alias(k) for k, v in features(said, F.col("x.before"), generator).items()], F.col("x.yes").cast("double").alias("yes"), (~F.col("x.yes")).cast("double").alias("no")))
    plain = found.select(held, F.filter(F.array(F.struct(F.lit("a (at) the").alias("m"), F.col("decoys.plain").cast("double").alias("n"))), lambda x: x["n"] > 0).alias("none"), F.transform("decoys.dotted", lambda m: F.struct(m.alias("m"), F.lit(1.0).alias("n"))).alias("some"))
    rows = plain.select("held", F.explode(F.concat("none", "some")).alias("x"))
    parts.append(rows.select("held", F.lit(2).alias("made"), *[v.alias(k) for k, v in features(F.regexp_extract("x.m", TIGHT, 0), F.lit("to "), 0).items()], F.lit(0.0).alias("yes"), F.col("x.n").alias("no")))
    counts = [p.groupBy("held", "made", *FEATURES).agg(F.sum("yes").alias("yes"), F.sum("no").alias("no")) for p in parts]
    every = counts[0]
    for other in counts[1:]:
        every = every.unionByName(other)
    return every


def fit(found: DataFrame) -> Model:
    """Train on two of three documents by hash and calibrate on the third; only counts by feature vector, bounded by
    the product of the bins, reach the driver. Decoys of plain text weigh no more together than what was made of mails."""
    counts = [r.asDict() for r in lessons(found).collect()]
    counts.sort(key=lambda c: (c["held"], c["made"], *[c[f] for f in FEATURES]))
    totals = defaultdict(float)
    for c in counts:
        totals[c["held"], c["generator"], c["made"]] += c["yes"] + c["no"]
    for c in counts:
        if c["made"] == 2:
            c["no"] *= min(1.0, totals[c["held"], 0, 1] / totals[c["held"], 0, 2])
    trees = boosted([c for c in counts if not c["held"]])
    model = Model(trees, {})
    margins = {}
    for form in sorted({form_of(c) for c in counts}):
        least = calibrated([(model.margin(c), c["yes"], c["no"]) for c in counts if c["held"] and form_of(c) == form and c["yes"] + c["no"] > 0], PRECISION)
        if least is not None:
            margins[form] = least
    return Model(trees, margins)


def chosen(model: Model) -> Column:
    """Candidates that the model takes and no base span covers, as spans of kind ``other``."""
    known = F.concat("email", "ip", "card", "phone")
    taken = let(known, lambda k: F.filter("candidates", lambda x: model.column(x) & ~overlaps(k, x)))
    return F.transform(taken, lambda x: F.struct(x["s"].alias("s"), F.lit(4).alias("k"), x["e"].alias("e"))).cast(f"array<{SPAN}>")


def find(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, the base spans by kind and ``other`` ones of every whole text.

    A null or empty text has no spans; repeated rows are searched each; extra columns are ignored; an empty table
    gives an empty result, and so do texts without candidates. The text is read once.
    """
    found = written(proposed(df, key, text), "pii-candidates")
    return found.select("doc_id", "email", "ip", "card", "phone", chosen(fit(found)).alias("other"))


def summary(found: DataFrame) -> DataFrame:
    kinds = [F.col(k) for k in KINDS]
    return found.select("doc_id", *[F.size(k).cast("long").alias(f"n_{k}") for k in KINDS[:4]],
                        F.sha2(joined(in_order(*kinds[:4]), KINDS).cast("binary"), 256).alias("base_sha256"), joined(in_order(*kinds), KINDS).alias("spans"))


def redact(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``df`` with every span replaced by its kind; a null text stays null. Texts are searched twice, once to count
    candidates and once to redact, so that no text is shuffled."""
    model = fit(written(proposed(df, key, text), "pii-candidates"))
    columns = df.columns
    kept = F.struct(*[F.col(c) for c in columns]).alias("_row")
    rows = df.select(key, text, kept)
    found = proposed(rows, key, text, "_row").withColumn("other", chosen(model))
    spans = in_order(*[F.col(k) for k in KINDS])
    clean = redacted(F.col(f"_row.{text}"), spans, KINDS)
    return found.select(*[(clean.alias(c) if c == text else F.col(f"_row.{c}").alias(c)) for c in columns])
