"""The audit log: hash chains by tenant, their verification, and lineage of runs."""

from __future__ import annotations

import hashlib
import json

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trisettle.operators.shared import settled

GENESIS = "0" * 64
CHAINED = "tenant string, seq long, payload string, prev_hash string, this_hash string"


def canonical(payload: dict) -> str:
    """Payload text with sorted keys and no blanks; floats are refused, money is integer or text."""

    def check(value):
        if isinstance(value, float):
            raise TypeError("no floats in audit payloads")
        for x in value.values() if isinstance(value, dict) else value if isinstance(value, list) else ():
            check(x)

    check(payload)
    return json.dumps(payload, sort_keys=True, separators=(",", ":"), ensure_ascii=False)


def append(rows: DataFrame, heads: DataFrame | None = None) -> DataFrame:
    """Chain new rows (tenant, seq, payload) to each tenant's head (tenant, this_hash). A chain is sequential by its
    nature, so a tenant's new rows are one task's work, read in batches in order of seq."""
    rows = rows.select("tenant", "seq", "payload")
    rows = rows.join(heads.select("tenant", F.col("this_hash").alias("head")), "tenant", "left") if heads is not None else rows.withColumn("head", F.lit(None).cast("string"))

    def chain(batches):
        tenant, last = None, GENESIS
        for batch in batches:
            out = []
            for r in batch.itertuples(index=False):
                if r.tenant != tenant:
                    tenant, last = r.tenant, r.head or GENESIS
                this = hashlib.sha256(f"{last}{r.payload}".encode()).hexdigest()
                out.append((r.tenant, r.seq, r.payload, last, this))
                last = this
            yield pd.DataFrame(out, columns=["tenant", "seq", "payload", "prev_hash", "this_hash"])

    return rows.repartition("tenant").sortWithinPartitions("tenant", "seq").mapInPandas(chain, CHAINED)


def verify(log: DataFrame) -> DataFrame:
    """The first bad row of each tenant: its hash is not that of its payload, or it does not follow its predecessor.
    Burned sequence numbers are no break."""
    before = F.lag("this_hash", 1, GENESIS).over(Window.partitionBy("tenant").orderBy("seq"))
    checked = log.withColumn("expected", before)
    bad = (F.col("prev_hash") != F.col("expected")) | (F.sha2(F.concat("prev_hash", "payload"), 256) != F.col("this_hash"))
    return checked.filter(bad).groupBy("tenant").agg(F.min("seq").alias("first_bad"))


def owner_runs(runs: DataFrame, depth: int = 64) -> DataFrame:
    """For each run the nearest ancestor (or itself) that owns events: run_id, parent_id, owns. Parents are followed
    for ``depth`` steps or up to the next power of two, so a cycle ends without an answer.

    Each round jumps as far as all rounds before together, so 64 steps take six joins of written tables.
    """
    links = settled(runs.select("run_id", F.when(~F.col("owns"), F.col("parent_id")).alias("up"), "owns"), "run-links")
    state = links.select("run_id", F.coalesce("up", "run_id").alias("at"))  # owners and first runs stay where they are
    for _ in range((depth - 1).bit_length()):
        further = state.select(F.col("run_id").alias("at"), F.col("at").alias("next"))
        state = settled(state.join(further, "at", "left").select("run_id", F.coalesce("next", "at").alias("at")), "run-jumps")
    owners = links.filter("owns").select(F.col("run_id").alias("owner_id"))
    return state.join(owners, state.at == owners.owner_id, "left").select("run_id", "owner_id")
