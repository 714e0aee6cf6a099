"""The matching cascade over the derived sources, as queries. Greedy stages are procedural: rows only, no SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from trisettle.operators import cascade
from trisettle.operators.shared import settled
from trisettle.sources.harness import derived

QUERIES = {}
ORACLE_SQL = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


def members(spark, sf_dir):
    """The cascade's result over the three sources, each written once; the harness's key is not handed on."""
    gateway, bank, ledger = (settled(x.drop("batch"), "cascade-source") for x in derived(spark, sf_dir))
    every = gateway.unionByName(bank).unionByName(ledger)
    return cascade.run(every)


@query
def cascade_members(spark, sf_dir):
    return members(spark, sf_dir).members


@query
def cascade_closed(spark, sf_dir):
    """Matches that close by themselves, by stage of their first proof."""
    done = members(spark, sf_dir)
    claimed = done.members
    return cascade.closable(claimed, refused=done.named).join(claimed.select("match_id", "stage"), "match_id").groupBy("match_id").agg(F.min("stage").alias("stage"), F.count("*").alias("n_events"))


@query
def cascade_left(spark, sf_dir):
    """Rows that no stage claimed, by source."""
    return members(spark, sf_dir).left.groupBy("source").agg(F.count("*").alias("n"), F.sum("amount_paise").alias("amount_paise"))
