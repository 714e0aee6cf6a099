"""The deduction rulebook: rules are small Python values that compile to Columns."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Sequence
from dataclasses import dataclass
from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trisettle.functions import text
from trisettle.functions.money import per_line
from trisettle.operators.shared import settled


@dataclass(frozen=True)
class Deduction:
    """One line: a percentage of ``gross``, of the live ``net`` or of an earlier line (by type), plus fixed paise."""

    type: str
    rate: str = "0"
    basis: str = "gross"
    fixed_paise: int = 0


@dataclass(frozen=True)
class Rule:
    id: str
    version: int
    priority: int
    deductions: tuple[Deduction, ...]
    method: str | None = None
    counterparty: str | None = None
    amount_min: int | None = None
    amount_max: int | None = None
    date_from: str | None = None
    date_to: str | None = None
    absolute_paise: int = 100
    percent: str = "0"
    confidence: str = "0.95"
    status: str = "active"
    rule_set: str = "default"
    source: str | None = None
    rail: str | None = None
    #: Any of these, after the same normalisation as the case's party; any of these in the narration, in either case.
    counterparties: tuple[str, ...] | None = None
    narrations: tuple[str, ...] | None = None
    #: When the rule holds, as against which cases it is about.
    effective_from: str | None = None
    effective_to: str | None = None

    @property
    def specificity(self) -> int:
        """How many clauses the scope has; when the rule holds is none."""
        return sum(x is not None for x in (self.method, self.counterparty, self.amount_min, self.amount_max, self.date_from, self.date_to, self.source, self.rail, self.counterparties, self.narrations))

    def in_scope(self, as_of: Column | None = None) -> Column:
        """Whether a case (method, counterparty, gross_paise, on_date, and source, rail, narration where a clause asks
        for them) meets all clauses, and the rule holds ``as_of`` that day, the case's own unless given. A clause about
        something that the case does not have is not met."""
        case = F.col("on_date")
        day = case if as_of is None else as_of
        date = lambda day_text: F.lit(day_text).cast("date")
        party = text.normalise_counterparty(F.col("counterparty"))
        clauses = {
            "method": lambda v: F.col("method") == v, "counterparty": lambda v: F.col("counterparty") == v, "amount_min": lambda v: F.col("gross_paise") >= v, "amount_max": lambda v: F.col("gross_paise") <= v,
            "date_from": lambda v: case >= date(v), "date_to": lambda v: case <= date(v), "source": lambda v: F.col("source") == v, "rail": lambda v: F.col("rail") == v,
            "counterparties": lambda v: F.array_contains(F.array(*[text.normalise_counterparty(F.lit(x)) for x in v]), party),
            "narrations": lambda v: F.exists(F.array(*[F.lit(x.upper()) for x in v]), lambda x: F.contains(F.upper("narration"), x)),
            "effective_from": lambda v: day >= date(v), "effective_to": lambda v: day <= date(v),
        }
        out = F.lit(True)
        for name, test in clauses.items():
            if (value := getattr(self, name)) is not None:
                out = out & test(value)
        return F.coalesce(out, F.lit(False))

    def lines(self, gross: Column) -> dict[str, Column]:
        """Each line in whole paise, rounded half up by itself."""
        done: dict[str, Column] = {}
        for d in self.deductions:
            net = gross - sum(done.values(), F.lit(0).cast("bigint"))
            basis = gross if d.basis == "gross" else net if d.basis == "net" else done[d.basis]
            done[d.type] = per_line(d.rate, basis) + d.fixed_paise
        return done

    def total(self, gross: Column) -> Column:
        return sum(self.lines(gross).values(), F.lit(0).cast("bigint"))

    def tolerance(self, gap: Column, n: Column) -> Column:
        return F.greatest(F.lit(self.absolute_paise).cast("bigint"), per_line(self.percent, F.abs(gap)), n.cast("bigint"))


def candidate_order(rules: Sequence[Rule]) -> list[Rule]:
    """Priority and specificity and version descending, then id."""
    return sorted(rules, key=lambda r: (-r.priority, -r.specificity, -r.version, r.id))


# Names of deductions in rate cards, and what the rulebook calls them.
ALIASES = {"tax": "gst_on_fee", "gst": "gst_on_fee", "gst_on_commission": "gst_on_fee", "tds": "tds_194o", "tds_194_o": "tds_194o", "tcs": "custom", "rolling_reserve": "reserve"}


def chained(lines: Sequence[Deduction], aliases: dict[str, str] | None = None) -> tuple[Deduction, ...]:
    """The lines of one rule by their canonical names, if their bases form a chain.

    A line may build on ``gross``, ``net`` or a line before it. One that builds on itself or on a line that builds on
    it is a cycle, one that builds on a later line is out of order, and a name that is given twice would hide the first;
    all are refused, as are negative numbers and lines that take more than the gross."""
    names = aliases or {}
    canonical = lambda name: names.get(name.strip().lower(), name)
    lines = tuple(Deduction(canonical(d.type), d.rate, canonical(d.basis), d.fixed_paise) for d in lines)
    at = {d.type: i for i, d in enumerate(lines)}
    if len(at) < len(lines) or {"gross", "net"} & set(at):
        raise ValueError("a line is named twice")
    for i, d in enumerate(lines):
        if Decimal(d.rate) < 0 or d.fixed_paise < 0:
            raise ValueError(f"{d.type} is negative")
        seen, basis = {d.type}, d.basis
        while basis not in ("gross", "net"):
            if basis not in at:
                raise ValueError(f"basis {basis} of {d.type} is no line")
            if basis in seen:
                raise ValueError(f"{d.type} builds on itself through {basis}")
            seen.add(basis)
            basis = lines[at[basis]].basis
        if d.basis in at and at[d.basis] >= i:
            raise ValueError(f"{d.type} builds on the later line {d.basis}")
    if sum(Decimal(d.rate) for d in lines if d.basis in ("gross", "net")) > 100:
        raise ValueError("deductions exceed the gross")
    return lines


def load_rules(source_text: str, aliases: dict[str, str] | None = None) -> list[Rule]:
    """Rules from JSON with exact decimals; unknown keys and stacks that do not chain (``chained``) are refused. With
    ``aliases`` lines may go by the names of rate cards."""
    out = []
    for entry in json.loads(source_text, parse_float=Decimal):
        lines = []
        for d in entry.pop("deductions"):
            if extra := set(d) - {"type", "rate", "basis", "fixed_paise"}:
                raise ValueError(f"unknown keys {sorted(extra)}")
            lines.append(Deduction(d["type"], str(d.get("rate", "0")), d.get("basis", "gross"), int(d.get("fixed_paise", 0))))
        if extra := set(entry) - set(Rule.__dataclass_fields__):
            raise ValueError(f"unknown keys {sorted(extra)}")
        entry |= {k: tuple(entry[k]) for k in ("counterparties", "narrations") if entry.get(k) is not None}
        out.append(Rule(deductions=chained(lines, aliases), **entry))
    return out


def first_rule(cases: DataFrame, rules: Sequence[Rule], as_of: Column | None = None) -> DataFrame:
    """``cases`` with n_rules, the active rules whose clauses each meets, and rule, the first of them in candidate
    order as id:version. A rulebook is a configuration; its rules are unrolled into expressions, nothing is joined."""
    live = candidate_order([r for r in rules if r.status == "active"])
    hits = [r.in_scope(as_of) for r in live]
    first = F.coalesce(*[F.when(h, F.lit(f"{r.id}:{r.version}")) for h, r in zip(hits, live, strict=True)], F.lit(None).cast("string"))
    return cases.withColumns({"n_rules": sum((h.cast("int") for h in hits), F.lit(0)), "rule": first})


SCOPE = ("amount_max", "amount_min", "counterparties", "counterparty", "date_from", "date_to", "method", "narrations", "rail", "source")


def meaning(rule: Rule) -> str:
    """Canonical text of what a rule does: its scope, its deductions in order and its tolerance; numbers without
    trailing zeros. Priority, confidence, set and status say how it is used, so they are left out."""
    plain = lambda rate: format(Decimal(rate).normalize(), "f")
    parts = {
        "scope": {k: getattr(rule, k) for k in SCOPE if getattr(rule, k) is not None},
        "deductions": [{"type": d.type, "basis": d.basis, "rate": plain(d.rate), "fixed_paise": d.fixed_paise} for d in rule.deductions],
        "tolerance": {"absolute_paise": rule.absolute_paise, "percent": plain(rule.percent)},
    }
    return json.dumps(parts, separators=(",", ":"), ensure_ascii=False)


def version_hash(rule: Rule) -> str:
    """SHA-256 of what a rule means."""
    return hashlib.sha256(meaning(rule).encode()).hexdigest()


def considered(rules: Sequence[Rule]) -> Column:
    """How many active rules have a case in their scope."""
    return sum((r.in_scope().cast("int") for r in rules if r.status == "active"), F.lit(0))


def apply_rules(cases: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """Explain each case's gap (gross_paise, gap_paise, method, counterparty, on_date, n_txns).

    Rules in order look at the gap that is left: one that explains it within tolerance ends the search, one that is
    smaller takes its part and the search goes on, any other is skipped, as is one above the gross. Adds
    explained_paise, residual_paise, rules_applied and fully_explained; the fold is unrolled over the rules.
    """
    left, open_, applied = F.col("gap_paise"), F.lit(True), F.array().cast("array<string>")
    out = cases
    for i, rule in enumerate(candidate_order([r for r in rules if r.status == "active"])):
        total = rule.total(F.col("gross_paise"))
        fits = open_ & rule.in_scope() & (total > 0) & (total <= F.col("gross_paise"))
        full = fits & (F.abs(left - total) <= rule.tolerance(left, F.col("n_txns")))
        part = fits & ~full & (total < left)
        out = out.select("*", F.when(full | part, left - total).otherwise(left).alias(f"_left{i}"), (open_ & ~full).alias(f"_open{i}"),
                         F.when(full | part, F.concat(applied, F.array(F.lit(f"{rule.id}:{rule.version}")))).otherwise(applied).alias(f"_applied{i}"))
        left, open_, applied = F.col(f"_left{i}"), F.col(f"_open{i}"), F.col(f"_applied{i}")
    return out.select(*cases.columns, (F.col("gap_paise") - left).alias("explained_paise"), left.alias("residual_paise"), applied.alias("rules_applied"), (~open_).alias("fully_explained"))


@dataclass(frozen=True)
class Verdict:
    """Back-test of a rule."""

    least_support: int = 3
    never: tuple[str, ...] = ("chargeback_unrecorded", "duplicate_ledger_entry")


def backtest(cases: DataFrame, rule: Rule, verdict: Verdict | None = None) -> DataFrame:
    """One rule alone over history: cases it would close, those of categories it must not close, and the advice."""
    verdict = verdict or Verdict()
    tried = apply_rules(cases, [rule])
    closed = F.col("fully_explained")
    wrong = closed & F.col("category").isin(*verdict.never)
    return tried.agg(F.count("*").alias("n_cases"), F.count_if(closed).alias("n_closed"), F.count_if(wrong).alias("n_wrong"), F.coalesce(F.sum(F.when(closed, F.col("explained_paise"))), F.lit(0)).alias("explained_paise")).withColumn(
        "advice", F.when(F.col("n_wrong") > 0, "discard").when(F.col("n_closed") >= verdict.least_support, "activate").otherwise("adjust"))


#: A starter rulebook: fees by payment method, then a flat batch charge.
STARTER = (
    Rule("fee_card", 2, 90, (Deduction("fee", "2.00"), Deduction("gst", "18", "fee")), method="card"),
    Rule("fee_upi", 1, 90, (Deduction("fee", "0.50"), Deduction("gst", "18", "fee")), method="upi"),
    Rule("fee_bank", 1, 80, (Deduction("fee", "5.00"),), method="netbanking", percent="1"),
    Rule("tds", 1, 50, (Deduction("tds", "1.00"),)),
    Rule("commission", 1, 40, (Deduction("commission", "3.00"), Deduction("tcs", "1.00", "net"))),
)


def by_version(rules: Sequence[Rule], value) -> Column:
    """A map literal from id:version to a value of the rule; a rulebook is a bounded configuration."""
    return F.create_map(*[F.lit(x) for r in rules for x in (f"{r.id}:{r.version}", value(r))])


def with_ceiling(explained: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """Confidence of cases with no more than the least confidence of the rules applied to each; never raised."""
    ceilings = by_version(rules, lambda r: Decimal(r.confidence))
    least = F.array_min(F.transform("rules_applied", lambda r: ceilings[r])).cast("decimal(5,4)")
    return explained.withColumn("confidence", F.least(F.col("confidence").cast("decimal(5,4)"), least))


def replayed(cases: DataFrame, before: Sequence[Rule], after: Sequence[Rule], key: str) -> DataFrame:
    """Cases explained otherwise under another rulebook: rules that no longer or newly explain, and what it changes.

    Both rulebooks are applied to the same row, one after the other, so nothing is joined or shuffled. The folds are
    written before the filter: Catalyst would otherwise push it below them and copy every step into the next.
    """
    old = apply_rules(cases, before).withColumnsRenamed({c: f"_{c}" for c in ("explained_paise", "residual_paise", "rules_applied", "fully_explained")})
    names = ("residual_paise", "rules_applied", "fully_explained")
    both = settled(apply_rules(old, after).select(key, *names, *[f"_{c}" for c in names]), "replayed")
    gone, come = F.array_except("_rules_applied", "rules_applied"), F.array_except("rules_applied", "_rules_applied")
    state = F.when(F.col("_fully_explained") & ~F.col("fully_explained"), "reopened").when(~F.col("_fully_explained") & F.col("fully_explained"), "closed").otherwise("same")
    rows = both.select(key, F.array_join(gone, ",").alias("no_longer"), F.array_join(come, ",").alias("newly"), state.alias("state"), (F.col("residual_paise") - F.col("_residual_paise")).alias("residual_change"))
    return rows.filter("no_longer <> '' or newly <> '' or state <> 'same' or residual_change <> 0")
