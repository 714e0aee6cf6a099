"""Narration text: references, rails, counterparties and scans, all as Column expressions."""

from __future__ import annotations

import unicodedata
from itertools import chain

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Length of a complete reference by rail; other rails have none.
REFERENCE_LENGTH = {"neft": 16, "rtgs": 16, "imps": 12, "upi": 12}
#: A narration of this length or more may have been cut off by the bank.
FULL_NARRATION = 98
ID_KINDS = {"order": "order_ids", "setl": "settlement_ids", "pay": "payment_ids", "rfnd": "refund_ids"}
#: The id alphabet (digits and capitals without I, L, O, U), 26 long.
ID = r"(?:order|setl|pay|rfnd)_[0-9A-HJKMNP-TV-Z]{26}"
#: What an instruction hidden in a narration looks like.
INJECTIONS = {
    "ignore_instructions": r"(?i)\b(?:ignore|disregard|forget)\b.{0,40}\b(?:instructions?|rules?|prompts?)\b",
    "role_marker": r"(?i)(?:^|\s)(?:system|assistant|user)\s*:",
    "act_as": r"(?i)\b(?:you are now|act as|pretend to be)\b",
    "template_token": r"<\|[a-z_]+\|>|\[/?INST\]",
    "approve": r"(?i)\b(?:mark|approve|close)\b.{0,30}\b(?:matched|resolved|settled)\b",
    "sql": r"(?i)\b(?:drop|delete|insert|update)\s+(?:table|from|into)\b",
    "url": r"(?i)https?://",
    "encoded": r"[A-Za-z0-9+/]{60,}={0,2}",
}


def rail_of(narration: Column) -> Column:
    up = F.upper(narration)
    return (F.when(up.startswith("UPI"), "upi").when(up.startswith("IMPS"), "imps").when(up.startswith("NEFT"), "neft")
            .when(up.startswith("RTGS"), "rtgs").when(up.rlike("^(?:NACH|ACH)"), "nach"))


def parse_slashed(narration: Column) -> Column:
    """RAIL/reference/counterparty, the form most banks print; null fields where it has another form."""
    parts = F.split(narration, "/")
    good = (F.size(parts) >= 3) & rail_of(narration).isNotNull()
    return F.when(good, F.struct(rail_of(narration).alias("rail"), F.trim(parts[1]).alias("reference"), F.trim(parts[2]).alias("counterparty")))


def parse_dashed(narration: Column) -> Column:
    """RAIL-part-part-..., where content, not position, tells the reference: a part of 10 to 22 letters and digits
    with four digits in a row; the first other part is the counterparty."""
    parts = F.filter(F.transform(F.split(narration, "-"), lambda x: F.trim(x)), lambda x: x != "")
    rest = F.slice(parts, 2, 20)
    is_ref = lambda x: x.rlike("^[A-Z0-9]{10,22}$") & x.rlike("[0-9]{4}")
    good = (F.size(parts) >= 2) & rail_of(narration).isNotNull()
    return F.when(good, F.struct(rail_of(narration).alias("rail"), F.get(F.filter(rest, is_ref), F.lit(0)).alias("reference"),
                                 F.get(F.filter(rest, lambda x: ~is_ref(x)), F.lit(0)).alias("counterparty")))


def parse_narration(narration: Column) -> Column:
    """Rail, reference and counterparty by the first form that fits."""
    return F.coalesce(parse_slashed(narration), parse_dashed(narration))


def is_truncated(narration: Column, rail: Column, reference: Column) -> Column:
    """Whether a long narration lost part of its reference; NACH has none to lose."""
    table = F.create_map(*chain.from_iterable((F.lit(k), F.lit(v)) for k, v in REFERENCE_LENGTH.items()))
    wanted = F.try_element_at(table, rail)
    lost = reference.isNull() | (F.length(reference) < wanted)
    return F.coalesce((F.length(narration) >= FULL_NARRATION) & (rail != "nach") & lost, F.lit(False))


def document_reference(narration: Column) -> Column:
    """The one token of eight or more letters and digits with four digits in a row; null if none or several."""
    tokens = F.filter(F.array_distinct(F.regexp_extract_all(F.upper(narration), F.lit("[A-Z0-9]{8,}"), F.lit(0))), lambda x: x.rlike("[0-9]{4}"))
    return F.when(F.size(tokens) == 1, tokens[0])


def cited_ids(narration: Column) -> Column:
    """Ids that a narration cites, by kind, in order and once each."""
    found = F.array_distinct(F.regexp_extract_all(F.coalesce(narration, F.lit("")), F.lit(f"({ID})"), F.lit(1)))

    def of_kind(kind: str) -> Column:
        return F.filter(found, lambda x: x.startswith(f"{kind}_"))

    return F.struct(*[of_kind(kind).alias(name) for kind, name in ID_KINDS.items()])


def identity_claim(ids: Column) -> Column:
    """An id counts only where it is the one of its kind."""
    return F.when(F.size(ids) == 1, ids[0])


def normalise_counterparty(name: Column, aliases: dict[str, str] | None = None) -> Column:
    """Upper case, without rail prefix and punctuation, blanks collapsed, then the alias table."""
    up = F.regexp_replace(F.upper(F.trim(name)), r"^(?:UPI|IMPS|NEFT|RTGS|NACH|ACH)[-/ ]+", "")
    plain = F.trim(F.regexp_replace(F.regexp_replace(up, "[^A-Z0-9 ]", " "), " +", " "))
    if not aliases:
        return plain
    table = F.create_map(*chain.from_iterable((F.lit(k), F.lit(v)) for k, v in sorted(aliases.items())))
    return F.coalesce(F.try_element_at(table, plain), plain)


def injection_hits(narration: Column) -> Column:
    """Names of the patterns that occur."""
    return F.array_compact(F.array(*[F.when(narration.rlike(p), F.lit(k)) for k, p in INJECTIONS.items()]))


def numbers_in(text: Column) -> Column:
    """Numbers as plain digits, without commas and trailing zeros after the point."""
    found = F.regexp_extract_all(text, F.lit(r"([0-9][0-9,]*(?:\.[0-9]+)?)"), F.lit(1))
    clean = F.transform(found, lambda x: F.regexp_replace(F.replace(x, F.lit(","), F.lit("")), r"(\.[0-9]*?)0+$", "$1"))
    return F.array_distinct(F.transform(clean, lambda x: F.regexp_replace(x, r"\.$", "")))


def grounded(prose: Column, facts: Column) -> Column:
    """Whether every number of a text is among the facts'."""
    return F.size(F.array_except(numbers_in(prose), numbers_in(facts))) == 0


@F.pandas_udf(T.StringType())
def compatible(texts: pd.Series) -> pd.Series:
    """NFKC, for which Spark has no function."""
    return texts.map(lambda t: unicodedata.normalize("NFKC", t), na_action="ignore")


def sanitised(name: str, longest: int = 500) -> Column:
    """Text in its compatible form without control and format characters, at most ``longest`` code points."""
    return F.substring(F.regexp_replace(compatible(F.col(name)), r"[\p{Cc}\p{Cf}]", ""), 1, longest)
