"""Settlement arithmetic and what it proves: bank credits, batches, ledger legs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trisettle.config import DEFAULT, Config
from trisettle.functions.scoring import confidence, tolerance
from trisettle.operators.shared import dealt, settled

#: Cells of the logarithmic amount grid for a relative width of one.
CELLS = 2_000


def arithmetic(gateway: DataFrame) -> DataFrame:
    """Per settlement: gross (amount and fee of payment credits), fee, gst within the fee, deductions, additions and
    the net they leave; tax is part of the fee and not subtracted again."""
    payment = (F.col("txn_type") == "payment") & (F.col("direction") == "credit")
    fee = F.coalesce("fee_paise", F.lit(0))
    total = lambda when, what: F.coalesce(F.sum(F.when(when, what)), F.lit(0)).cast("bigint")
    sums = gateway.filter("settlement_id is not null").groupBy("settlement_id").agg(
        total(payment, F.col("amount_paise") + fee).alias("gross_paise"), total(payment, fee).alias("fee_paise"),
        total(payment, F.coalesce("tax_raw", F.lit(0))).alias("gst_paise"),
        total(~payment & (F.col("direction") == "debit"), F.col("amount_paise")).alias("deductions_paise"),
        total(~payment & (F.col("direction") == "credit"), F.col("amount_paise")).alias("additions_paise"),
        F.count_if(payment).alias("n_txns"), F.min("txn_date").alias("first_date"), F.array_sort(F.collect_set("utr")).alias("utrs"))
    return sums.withColumn("expected_net_paise", F.col("gross_paise") - F.col("fee_paise") - F.col("deductions_paise") + F.col("additions_paise"))


def named(rows: DataFrame, gateway: DataFrame, tasks: int | None = None) -> DataFrame:
    """Bank or ledger rows with the settlement that their own text names: ``Settlement credit <id>``, else the
    settlement that alone has the reference in ``utr`` or in the narration. Rows that name none stay, with null.
    ``tasks``: how many to deal the lookup to."""
    known = dealt(gateway.filter("utr is not null").select(F.concat(F.lit("="), "utr").alias("_key"), "settlement_id"), tasks, "_key").groupBy("_key").agg(F.min("settlement_id").alias("_low"), F.max("settlement_id").alias("_high")).filter("_low = _high")
    token = F.coalesce(F.when(F.length("utr") >= 16, F.col("utr")), F.nullif(F.regexp_extract("narration", r"\bUTR[0-9]{13}\b", 0), F.lit("")))
    said = F.nullif(F.regexp_extract("narration", r"Settlement credit (\S+)", 1), F.lit(""))
    # rows that look nothing up get a key of their own: with null as their key they would all be one task's
    asked = F.coalesce(F.when(said.isNull(), F.concat(F.lit("="), token)), F.concat(F.lit("-"), "event_id"))
    own = dealt(rows.withColumns({"_said": said, "_key": asked}), tasks, "_key").join(known, "_key", "left")
    return own.withColumn("settlement_id", F.coalesce("_said", "_low")).drop("_key", "_said", "_low", "_high")


def cell(amount: Column) -> Column:
    return F.floor(F.log(F.greatest(amount, F.lit(1)).cast("double")) * CELLS).cast("bigint")


FOUND = ("credit_id", "settlement_id", "credit_paise", "expected_net_paise", "delta_paise", "tolerance_paise", "n_txns", "by_reference", "days")


def _credits(bank: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Bank credits with a whole reference, and those without."""
    rows = bank.filter("direction = 'credit' and amount_paise is not null").select(F.col("event_id").alias("credit_id"), F.col("amount_paise").alias("credit_paise"), F.col("txn_date").alias("credit_date"), "utr")
    whole = F.coalesce(F.length("utr") >= 16, F.lit(False))
    return rows.filter(whole), rows.filter(~whole)


def _payable(settlements: DataFrame, cfg: Config) -> DataFrame:
    return settlements.filter("expected_net_paise > 0").withColumn("tolerance_paise", tolerance(F.col("expected_net_paise"), F.col("n_txns"), cfg))


def _fitting(pairs: DataFrame, by_reference: bool, window_days: int | None) -> DataFrame:
    delta, days = F.col("credit_paise") - F.col("expected_net_paise"), F.datediff("credit_date", "first_date")
    out = pairs.filter(F.abs(delta) <= F.col("tolerance_paise")).withColumns({"delta_paise": delta, "by_reference": F.lit(by_reference), "days": days})
    return (out if window_days is None else out.filter(F.col("days").between(-window_days, window_days))).select(*FOUND)


def _by_reference(credits: DataFrame, s: DataFrame, window_days: int | None) -> DataFrame:
    """A credit with a whole reference meets only the settlements that have it."""
    return _fitting(credits.join(s.withColumn("utr", F.explode("utrs")), "utr"), True, window_days)


def candidates(bank: DataFrame, settlements: DataFrame, cfg: Config = DEFAULT, window_days: int | None = None) -> DataFrame:
    """Bank credits beside every settlement whose expected net is within tolerance and whose references do not
    contradict. Without a whole reference, settlements span the cells of their tolerance on a logarithmic grid and
    credits stand in one. All pairs are listed; ``reconcile`` counts them."""
    s = _payable(settlements, cfg)
    whole, others = _credits(bank)
    spread = s.withColumn("cell", F.explode(F.sequence(cell(F.col("expected_net_paise") - F.col("tolerance_paise")), cell(F.col("expected_net_paise") + F.col("tolerance_paise")))))
    return _by_reference(whole, s, window_days).unionByName(_fitting(others.withColumn("cell", cell(F.col("credit_paise"))).join(spread, "cell"), False, window_days))


def _judged(rows: DataFrame) -> DataFrame:
    one = F.col("n_candidates") == 1
    value = confidence(F.lit("0.97"), F.when(F.col("x.by_reference"), 2).otherwise(1), F.lit(0), F.col("x.delta_paise"), F.col("x.credit_paise"), F.lit(0), F.col("n_candidates"), F.lit(2))
    return rows.select("credit_id", "n_candidates", F.when(one, F.col("x.settlement_id")).alias("settlement_id"), F.when(one, F.col("x.delta_paise")).alias("delta_paise"),
                       F.when(one, F.col("x.tolerance_paise")).alias("tolerance_paise"), F.when(one, value.cast("double")).alias("confidence"))


DETAIL = ("settlement_id", "credit_paise", "delta_paise", "tolerance_paise", "n_txns", "by_reference")


def reconciled(found: DataFrame) -> DataFrame:
    """One row for each credit: its settlement if it is the only one that fits, and the confidence; several fits are
    a refusal, with their number."""
    return _judged(found.groupBy("credit_id").agg(F.count("*").cast("bigint").alias("n_candidates"), F.min(F.struct(*DETAIL)).alias("x")))


def reconcile(bank: DataFrame, settlements: DataFrame, cfg: Config = DEFAULT, window_days: int | None = None) -> DataFrame:
    """``reconciled(candidates(...))`` without listing the candidates of credits that have no whole reference.

    Settlements that fit an amount are those whose interval begins at or below it less those whose interval ends below
    it. Both are running counts over the distinct amounts of a day (of all days without a window), within the cells of
    the grid on top of sums over cells. The exclusive or of the settlements' numbers runs along: of one it is that one.
    """
    s = settled(_payable(settlements, cfg).withColumn("number", F.monotonically_increasing_id()), "payable")
    whole, others = _credits(bank)
    if window_days is None:
        asked, spans = others.withColumn("day", F.lit(None).cast("date")), s.withColumn("day", F.lit(None).cast("date"))
    else:
        asked, spans = others.withColumn("day", F.explode(F.sequence(F.date_sub("credit_date", window_days), F.date_add("credit_date", window_days)))), s.withColumn("day", F.col("first_date"))
    end = lambda at, n: F.struct(at.alias("at"), F.lit(n).alias("n"))
    ends = spans.select("day", "number", F.inline(F.array(end(F.col("expected_net_paise") - F.col("tolerance_paise"), 1), end(F.col("expected_net_paise") + F.col("tolerance_paise") + 1, -1))))
    points = ends.unionByName(asked.select("day", F.lit(0).cast("long").alias("number"), F.col("credit_paise").alias("at"), F.lit(0).alias("n"))).withColumn("cell", cell(F.col("at")))
    points = settled(points.groupBy("day", "cell", "at").agg(F.sum("n").alias("n"), F.bit_xor("number").alias("number")), "interval-ends")
    upto = lambda *by: Window.partitionBy(*by).rowsBetween(Window.unboundedPreceding, 0)
    earlier = Window.partitionBy("day").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    cells = points.groupBy("day", "cell").agg(F.sum("n").alias("n"), F.bit_xor("number").alias("number"))
    cells = cells.select("day", "cell", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("n_before"), F.coalesce(F.bit_xor("number").over(earlier), F.lit(0)).alias("number_before"))
    within = upto("day", "cell").orderBy("at")
    level = points.select("day", "cell", F.col("at").alias("credit_paise"), F.sum("n").over(within).alias("n"), F.bit_xor("number").over(within).alias("number"))
    same_day = lambda a, b: a["day"].eqNullSafe(b["day"])
    level = level.join(cells, same_day(level, cells) & (level["cell"] == cells["cell"])).select(level["day"], "credit_paise", (F.col("n") + F.col("n_before")).alias("n_candidates"), F.col("number").bitwiseXOR(F.col("number_before")).alias("number")).filter("n_candidates > 0")
    counts = asked.join(level, same_day(asked, level) & (asked["credit_paise"] == level["credit_paise"])).select("credit_id", asked["credit_paise"], "credit_date", "n_candidates", "number")
    if window_days is not None:
        counts = counts.groupBy("credit_id", "credit_paise", "credit_date").agg(F.sum("n_candidates").alias("n_candidates"), F.bit_xor("number").alias("number"))
    counts = settled(counts, "candidate-counts")
    single = _fitting(counts.filter("n_candidates = 1").join(s, "number"), False, window_days).select("credit_id", F.lit(1).cast("bigint").alias("n_candidates"), F.struct(*DETAIL).alias("x"))
    several = counts.filter("n_candidates > 1").select("credit_id", "n_candidates", F.lit(None).cast(single.schema["x"].dataType).alias("x"))
    return reconciled(_by_reference(whole, s, window_days)).unionByName(_judged(single.unionByName(several)))


def wanted(bank: DataFrame, settlements: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """settlement_id of the settlements that stand beside some credit in ``candidates``, without listing the pairs of
    credits that have no whole reference: within each cell of the grid the next amount of a credit, from the beginning
    of a settlement's interval upwards, lies in the interval or not."""
    s = _payable(settlements, cfg)
    whole, others = _credits(bank)
    low, high = F.col("expected_net_paise") - F.col("tolerance_paise"), F.col("expected_net_paise") + F.col("tolerance_paise")
    asked = s.select("settlement_id", low.alias("at"), high.alias("high"), F.explode(F.sequence(cell(low), cell(high))).alias("cell"))
    paid = others.select(F.lit(None).cast("string").alias("settlement_id"), F.col("credit_paise").alias("at"), F.lit(None).cast("long").alias("high"), cell(F.col("credit_paise")).alias("cell")).distinct()
    downwards = Window.partitionBy("cell").orderBy(F.desc("at")).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    rows = asked.unionByName(paid).withColumn("next", F.min(F.when(F.col("settlement_id").isNull(), F.col("at"))).over(downwards))
    return rows.filter("settlement_id is not null and next <= high").select("settlement_id").unionByName(_by_reference(whole, s, None).select("settlement_id")).distinct()


def weighed(bank: DataFrame, settlements: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """credit_id and the sum of ``weight`` of the settlements beside it in ``candidates``, without listing those of credits
    that have no whole reference: weights of the intervals that begin at or below an amount less of those that end below it."""
    s = settled(_payable(settlements, cfg), "weighed")
    whole, others = _credits(bank)
    end = lambda at, w: F.struct(at.alias("at"), w.alias("w"))
    ends = s.select(F.inline(F.array(end(F.col("expected_net_paise") - F.col("tolerance_paise"), F.col("weight")), end(F.col("expected_net_paise") + F.col("tolerance_paise") + 1, -F.col("weight")))))
    points = settled(ends.unionByName(others.select(F.col("credit_paise").alias("at"), F.lit(0).cast("long").alias("w"))).withColumn("cell", cell(F.col("at"))).groupBy("cell", "at").agg(F.sum("w").alias("w")), "weighed-ends")
    cells = points.groupBy("cell").agg(F.sum("w").alias("w")).select("cell", F.coalesce(F.sum("w").over(Window.orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    within = Window.partitionBy("cell").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    level = points.select("cell", F.col("at").alias("credit_paise"), F.sum("w").over(within).alias("w")).join(cells, "cell").select("credit_paise", (F.col("w") + F.col("before")).alias("weight"))
    named_ = _by_reference(whole, s, None).join(s.select("settlement_id", "weight"), "settlement_id").select("credit_id", "weight")
    return others.join(level, "credit_paise").select("credit_id", "weight").unionByName(named_).groupBy("credit_id").agg(F.sum("weight").alias("weight"))


def claims(bank: DataFrame) -> DataFrame:
    """Credits whose narration names a settlement."""
    claim = F.nullif(F.regexp_extract("narration", r"Settlement credit (\S+)", 1), F.lit(""))
    return bank.select(F.col("event_id").alias("credit_id"), F.col("amount_paise").alias("credit_paise"), claim.alias("settlement_id")).filter("settlement_id is not null")


def agreeing(claims_: DataFrame, settlements: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """Of ``claims`` those whose settlement's net agrees."""
    delta = F.col("credit_paise") - F.col("expected_net_paise")
    return claims_.join(settlements, "settlement_id").filter(F.abs(delta) <= tolerance(F.col("expected_net_paise"), F.col("n_txns"), cfg)).select("credit_id", "settlement_id", delta.alias("delta_paise"), "n_txns")


def grouped(bank: DataFrame, settlements: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """Credits whose narration names one settlement whose net agrees."""
    return agreeing(claims(bank), settlements, cfg)


def three_way(groups: DataFrame, ledger: DataFrame) -> DataFrame:
    """Reconciled credits with the ledger row that names their settlement, where exactly one does; else the number."""
    claim = F.nullif(F.regexp_extract("narration", r"Settlement credit (\S+)", 1), F.lit(""))
    legs = ledger.select(F.col("event_id").alias("ledger_id"), F.col("amount_paise").alias("ledger_paise"), claim.alias("settlement_id"))
    rows = groups.filter("settlement_id is not null").select("credit_id", "settlement_id").join(legs, "settlement_id", "left")
    return rows.groupBy("credit_id", "settlement_id").agg(F.count("ledger_id").alias("n_legs"), F.min("ledger_id").alias("leg"), F.min("ledger_paise").alias("leg_paise")).select(
        "credit_id", "settlement_id", "n_legs", F.when(F.col("n_legs") == 1, F.col("leg")).alias("ledger_id"), F.when(F.col("n_legs") == 1, F.col("leg_paise")).alias("ledger_paise"))


def nearest_beyond(left: DataFrame, right: DataFrame, by: str, day: str, more_than_days: int) -> DataFrame:
    """For each distinct (``by``, ``day``) of left the right row of the same value that is nearest among those more than
    so many days before or after: right_id and days; ties go to the smaller id. ``right`` has event_id. Rows without a value or day have none and are none.

    Two as-of joins by ordered windows. Both sides are first reduced to distinct values and days, with the smallest
    right id of each, so a value that a third of all rows share is no more rows than it has days.
    """
    marks = right.filter(F.col(by).isNotNull() & F.col(day).isNotNull()).groupBy(by, day).agg(F.min("event_id").alias("right_id")).select(by, F.col(day).alias("at"), F.struct(F.col(day).alias("right_day"), "right_id").alias("mark"), F.lit(None).cast("date").alias("asked"))
    asked = left.filter(F.col(by).isNotNull() & F.col(day).isNotNull()).select(by, day).distinct()

    def probe(shift: int) -> DataFrame:
        """The last mark at or before ``shift`` days from each asked day, looking backwards in time if it is negative."""
        rows = marks.unionByName(asked.select(by, F.date_add(day, shift).alias("at"), F.lit(None).cast(marks.schema["mark"].dataType).alias("mark"), F.col(day).alias("asked")))
        time = F.col("at") if shift < 0 else F.desc("at")
        upto = Window.partitionBy(by).orderBy(time, F.col("asked").isNotNull()).rowsBetween(Window.unboundedPreceding, 0)
        return rows.withColumn("mark", F.last("mark", ignorenulls=True).over(upto)).filter("asked is not null and mark is not null").select(by, F.col("asked").alias(day), F.abs(F.datediff("mark.right_day", "asked")).alias("days"), "mark.right_id")

    both = probe(-more_than_days - 1).unionByName(probe(more_than_days + 1))
    return both.groupBy(by, day).agg(F.min(F.struct("days", "right_id")).alias("x")).select(by, day, "x.right_id", "x.days")


def nearest_opposite(left: DataFrame, right: DataFrame, more_than_days: int = 3) -> DataFrame:
    """For each left row the right row of the same amount that is nearest among those further off than the window;
    ties go to the smaller event."""
    near = nearest_beyond(left, right, "amount_paise", "txn_date", more_than_days)
    return left.select(F.col("event_id").alias("left_id"), "amount_paise", "txn_date").join(near, ["amount_paise", "txn_date"]).select("left_id", "right_id", "days")


def duplicate_legs(ledger: DataFrame) -> DataFrame:
    """Vouchers that repeat in type, direction, amount, date and narration."""
    keys = ["voucher_type", "direction", "amount_paise", "txn_date", F.upper(F.trim("narration")).alias("narration_key")]
    return ledger.groupBy(*keys).agg(F.count("*").alias("n"), F.min("event_id").alias("first_id"), F.max("event_id").alias("last_id")).filter("n > 1")


def running_balance(bank: DataFrame, opening: int = 0) -> DataFrame:
    """Closing balance after each credit in (date, event) order: a sum within days on top of a sum over days, so that
    no task takes every row."""
    daily = bank.groupBy("txn_date").agg(F.sum("amount_paise").alias("day_paise"))
    before = Window.orderBy("txn_date").rowsBetween(Window.unboundedPreceding, -1)
    daily = daily.select("txn_date", (F.coalesce(F.sum("day_paise").over(before), F.lit(0)) + opening).alias("before"))
    within = Window.partitionBy("txn_date").orderBy("event_id").rowsBetween(Window.unboundedPreceding, 0)
    return bank.select("event_id", "txn_date", "amount_paise", F.sum("amount_paise").over(within).alias("so_far")).join(daily, "txn_date").select(
        "event_id", "txn_date", "amount_paise", (F.col("before") + F.col("so_far")).alias("closing_paise"))


def shift_pairs(bank: DataFrame, ledger: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """Bank and ledger rows one to three days apart, amounts within tolerance, where one reference of six characters
    or more is a beginning of the other.

    Amounts meet on the logarithmic grid: a bank row spans the cells of its tolerance and the days around it, a ledger
    row stands in one cell on one day.
    """
    reach = tolerance(F.col("paid_paise"), F.lit(1), cfg)
    paid = bank.filter("length(utr) >= 6").select(F.col("event_id").alias("bank_id"), F.col("amount_paise").alias("paid_paise"), F.col("txn_date").alias("paid_on"), F.col("utr").alias("paid_utr"))
    paid = paid.withColumn("cell", F.explode(F.sequence(cell(F.col("paid_paise") - reach), cell(F.col("paid_paise") + reach)))).withColumn("txn_date", F.explode(F.array(*[F.date_add("paid_on", k) for k in (-3, -2, -1, 1, 2, 3)])))
    books = ledger.filter("length(utr) >= 6").select(F.col("event_id").alias("ledger_id"), "amount_paise", "txn_date", "utr", cell(F.col("amount_paise")).alias("cell"))
    begins = (F.col("utr") != F.col("paid_utr")) & (F.startswith("utr", F.col("paid_utr")) | F.startswith("paid_utr", F.col("utr")))
    days = F.abs(F.datediff("paid_on", "txn_date"))
    return paid.join(books, ["cell", "txn_date"]).filter(begins & (F.abs(F.col("paid_paise") - F.col("amount_paise")) <= reach)).select("bank_id", "ledger_id", "utr", "paid_utr", "paid_paise", days.alias("days"))


def date_shifted(bank: DataFrame, ledger: DataFrame, cfg: Config = DEFAULT, pairs: DataFrame | None = None) -> DataFrame:
    """The shifted pairs where only one reference completes the other; each row in one pair only."""
    pairs = shift_pairs(bank, ledger, cfg) if pairs is None else pairs
    alone = lambda side, other: pairs.groupBy(side).agg(F.count("*").alias("n"), F.count_distinct(other).alias("k")).filter("n = 1 and k = 1").select(side)
    return pairs.join(alone("bank_id", "utr"), "bank_id").join(alone("ledger_id", "paid_utr"), "ledger_id").select("bank_id", "ledger_id", "days")
