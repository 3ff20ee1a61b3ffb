"""Label sheets, predictions, cases and evaluation results as files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from folio.functions.columns import normalise_decision

# The columns of a label sheet.
SHEET_COLUMNS = ("case_id", "decision", "confidence", "labeler", "notes")


def read_label_sheets(spark: SparkSession, *paths: str) -> DataFrame:
    """Filled label sheets as (labeler, case_id, decision).

    Blank and invalid decisions are skipped; the last row of a case wins; the labeler
    is the last name given in a file, else the file's name; of two files by one
    labeler the later path replaces the earlier one.  A sheet is one person's work and
    one input split, so its rows keep their order.
    """
    schema = ", ".join(f"{c} string" for c in SHEET_COLUMNS)
    rows = (
        spark.read.schema(schema).option("header", True).option("multiLine", True).option("escape", '"')
        .option("encoding", "UTF-8").option("enforceSchema", False).csv(list(paths))
    )
    at = F.monotonically_increasing_id()
    rows = rows.select("*", F.col("_metadata.file_path").alias("file"), at.alias("at"))
    name = F.when(F.trim("labeler") != "", F.trim("labeler"))
    stem = F.regexp_replace(F.element_at(F.split("file", "/"), -1), r"\.[^.]*$", "")
    owner = rows.groupBy("file").agg(F.max(F.when(name.isNotNull(), F.struct("at", name.alias("name")))).alias("o"))
    owner = owner.select("file", F.coalesce("o.name", stem).alias("labeler"))
    newest = owner.groupBy("labeler").agg(F.max("file").alias("file"))
    case, decision = F.trim("case_id"), normalise_decision(F.col("decision"))
    kept = rows.filter(decision.isNotNull() & (F.coalesce("case_id", F.lit("")) != "")).select(
        "file", case.alias("case_id"), decision.alias("decision"), "at"
    )
    last = kept.groupBy("file", "case_id").agg(F.max_by("decision", "at").alias("decision"))
    return last.join(newest, "file").select("labeler", "case_id", "decision")


def read_predictions(spark: SparkSession, path: str) -> DataFrame:
    """The ``predictions`` array of a JSON file; invalid decisions are skipped, the last of a case wins."""
    schema = "predictions array<struct<case_id: string, predicted_decision: string, rationale: string, parse_error: boolean>>"
    items = spark.read.schema(schema).option("multiLine", True).json(path).select(F.posexplode("predictions").alias("pos", "p"))
    items = items.select("p.case_id", normalise_decision(F.col("p.predicted_decision")).alias("decision"), "pos")
    valid = items.filter("decision is not null")
    return valid.groupBy("case_id").agg(F.max_by("decision", "pos").alias("decision"))


def write_cases(cases: DataFrame, folder: str) -> None:
    """The cases with their bundles, and an empty sheet for people to fill in."""
    cases.write.mode("overwrite").json(f"{folder}/cases")
    blank = [F.lit("").alias(c) for c in SHEET_COLUMNS[1:]]
    # a labelling set is tens of cases: one sheet for one person
    sheet = cases.select("case_id", *blank).orderBy("case_id").coalesce(1)
    sheet.write.mode("overwrite").option("header", True).option("emptyValue", "").csv(f"{folder}/label_sheet")


def write_eval(scored: DataFrame, folder: str, **metrics: DataFrame) -> None:
    """Scored rows and the metric tables, each in a folder of its own."""
    scored.write.mode("overwrite").json(f"{folder}/results")
    for name, df in metrics.items():
        df.write.mode("overwrite").json(f"{folder}/{name}")
