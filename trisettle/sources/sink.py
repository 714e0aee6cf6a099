"""All tables of a run, published together.

Tables are written under a name of the attempt's own; then one manifest, moved into place in one step, names them. A
reader takes tables by manifests alone, so it sees a run with all its tables or not at all, whatever was killed when. A
run that has a manifest is not written again, and of two attempts that race one manifest wins.
"""

from __future__ import annotations

import json
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _files(spark: SparkSession, root: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(root)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()), spark._jvm.org.apache.hadoop.fs.Path


def manifest(spark: SparkSession, root: str, run_id: str) -> dict | None:
    """What was published for a run, None if nothing was."""
    fs, path = _files(spark, root)
    at = path(f"{root}/manifests/{run_id}.json")
    if not fs.exists(at):
        return None
    stream = fs.open(at)
    try:
        return json.loads(spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
    finally:
        stream.close()


def publish(spark: SparkSession, root: str, run_id: str, tables: dict[str, DataFrame]) -> dict:
    """Writes and publishes the tables of a run; returns its manifest, the existing one if the run is published."""
    if not run_id or set(run_id) & set("/\\:*?"):
        raise ValueError("a run id must be a plain file name")
    if done := manifest(spark, root, run_id):
        return done
    attempt = uuid.uuid4().hex
    listed = {}
    for name, df in tables.items():
        place = f"data/{name}/{run_id}-{attempt}"
        df.write.parquet(f"{root}/{place}")
        listed[name] = {"place": place, "rows": spark.read.parquet(f"{root}/{place}").count(), "schema": json.loads(df.schema.json())}
    text = json.dumps({"run_id": run_id, "attempt": attempt, "tables": listed}, sort_keys=True)
    fs, path = _files(spark, root)
    staged, final = path(f"{root}/staged/{attempt}.json"), path(f"{root}/manifests/{run_id}.json")
    fs.mkdirs(final.getParent())
    out = fs.create(staged)
    out.write(bytearray(text.encode()))
    out.close()
    context = spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), spark._jsc.hadoopConfiguration())
    nothing = spark.sparkContext._gateway.new_array(getattr(spark._jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
    try:
        context.rename(staged, final, nothing)  # never over an existing one
    except Py4JJavaError:
        if manifest(spark, root, run_id) is None:
            raise
        fs.delete(staged, False)
    return manifest(spark, root, run_id)


def runs(spark: SparkSession, root: str) -> list[str]:
    fs, path = _files(spark, root)
    folder = path(f"{root}/manifests")
    return sorted(f.getPath().getName().removesuffix(".json") for f in fs.listStatus(folder) if f.getPath().getName().endswith(".json")) if fs.exists(folder) else []


def read(spark: SparkSession, root: str, table: str, run_id: str) -> DataFrame:
    """One table of a published run, with the column run_id."""
    found = manifest(spark, root, run_id)
    if found is None or table not in found["tables"]:
        raise LookupError(f"{table} of run {run_id} is not published")
    return spark.read.parquet(f"{root}/{found['tables'][table]['place']}").withColumn("run_id", F.lit(run_id))


def leftovers(spark: SparkSession, root: str) -> list[str]:
    """Folders of attempts that no manifest names: what killed or beaten attempts left."""
    fs, path = _files(spark, root)
    named = {t["place"] for r in runs(spark, root) for t in manifest(spark, root, r)["tables"].values()}
    data = path(f"{root}/data")
    found = [f"data/{t.getPath().getName()}/{a.getPath().getName()}" for t in (fs.listStatus(data) if fs.exists(data) else []) for a in fs.listStatus(t.getPath())]
    return sorted(set(found) - named)
