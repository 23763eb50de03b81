"""Sinks: sheets, manifest, provenance documents and the mirrored log. Spark's commit protocol makes each folder whole or absent."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_sheets(sheets: dict[str, DataFrame], path: str) -> None:
    """SNK-01: one folder per sheet, and the records as CSV with header as well."""
    for name, df in sheets.items():
        df.write.mode("overwrite").parquet(f"{path}/{name}")
    if "records" in sheets:
        sheets["records"].write.mode("overwrite").option("header", True).csv(f"{path}/records_csv")


def run_manifest(selection: DataFrame, budget: float) -> DataFrame:
    """SNK-02: counts of a selection, by class as well, in one row."""
    per = selection.groupBy("discovery_class_primary").agg(F.count_if(~F.col("excluded")).alias("n"), F.count_if("excluded").alias("x"))
    listed = F.array_sort(F.collect_list(F.when(F.col("n") > 0, F.concat_ws("=", "discovery_class_primary", "n"))))
    return per.agg(F.sum("n").alias("selected"), F.sum("x").alias("excluded"), F.array_join(listed, ",").alias("per_class")).withColumn("budget", F.lit(budget))


def provenance_documents(records: DataFrame) -> DataFrame:
    """SNK-03: one document per lead with its fields, for write_provenance_json (entity_id, field_name, record)."""
    return records.groupBy("entity_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("field_name", "record")))).alias("fields"))


def write_provenance_json(records: DataFrame, path: str) -> None:
    provenance_documents(records).write.mode("overwrite").json(path)


def mirror_run_log(runs: DataFrame, prov: DataFrame, limit: int) -> tuple[DataFrame, DataFrame]:
    """SNK-04: the newest runs and all their rows, the name drawn out of the record (run_id, started_at; run_id, entity_id, record JSON)."""
    newest = runs.orderBy(F.desc("started_at"), "run_id").limit(limit)
    rows = prov.join(newest.select("run_id"), "run_id", "left_semi")
    return newest, rows.withColumn("canonical_name", F.get_json_object("record", "$.canonical_name"))
