"""The progress journal of a job: what its records say, and what to do after a stop."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkgrid.functions import names, sizing
from inkgrid.plans.batch import free_names, pending

FIELDS = ("status", "output", "widthCM", "heightCM", "widthPX", "heightPX", "whiteOutput", "error")
STATES = ("pending", "done", "error", "cancelled")


def valid_record(row_output: Column) -> Column:
    """Whether a journal record (its columns in scope) can be of the variant whose first output is row_output (null: no such variant)."""
    base = F.regexp_replace(row_output, r"\.png$", "")
    own = (F.col("output") == row_output) | (F.startswith(F.col("output"), F.concat(base, F.lit("_r"))) & F.substr(F.col("output"), F.length(base) + 1).rlike(r"^_r[0-9]+\.png$"))
    side = lambda c: F.col(c).isNull() | F.col(c).between(1, sizing.MOST_SIDE)
    area = F.coalesce(F.col("widthPX").cast("long") * F.col("heightPX") <= sizing.MOST_PIXELS, F.lit(True))
    twin = F.col("whiteOutput").isNull() | F.coalesce(F.col("whiteOutput") == names.white_name(F.col("output")), F.lit(False))
    return row_output.isNotNull() & F.coalesce(F.col("status").isin(*STATES), F.lit(False)) & (F.col("output").isNull() | own) & side("widthPX") & side("heightPX") & area & twin


def checked(progress: DataFrame, variants: DataFrame) -> DataFrame:
    """The records with `valid`. variants: (id, output)."""
    rows = variants.select("id", F.col("output").alias("row_output"))
    return progress.join(rows, "id", "left").withColumn("valid", valid_record(F.col("row_output"))).drop("row_output")


def counts(progress: DataFrame, variants: DataFrame) -> DataFrame:
    """One row: all records, those that can be of the job, and those that are left out."""
    return checked(progress, variants).agg(F.count("*").alias("records"), F.count_if("valid").alias("valid"), F.count_if(~F.col("valid")).alias("invalid"))


def latest_state(progress: DataFrame) -> DataFrame:
    """For each id and field the last value by sequence number that isn't null. Only valid records may be in progress."""
    return progress.groupBy("id").agg(*(F.max_by(f, F.when(F.col(f).isNotNull(), F.col("seq"))).alias(f) for f in FIELDS), F.max("seq").alias("seq"))


def resume(variants: DataFrame, progress: DataFrame, verified: DataFrame, existing: DataFrame, white: bool = False) -> tuple[DataFrame, DataFrame]:
    """(all variants with their state, those to run with a free name). verified: (output) of checked files, existing: (output) of all files.

    A verified output makes its variant done even if no record says so. Invalid records are left out; counts() says how many."""
    good = checked(progress, variants).where("valid")
    state = latest_state(good).select("id", F.col("status").alias("logged"), F.col("output").alias("logged_output"), "widthPX", "heightPX")
    all_ = variants.drop("status").join(state, "id", "left").withColumn("output", F.coalesce("logged_output", "output"))
    todo = pending(all_, verified, F.lit(white))
    done = all_.join(todo.select("id", F.lit("pending").alias("todo")), "id", "left").withColumn("status", F.coalesce("todo", F.lit("done"))).drop("todo", "logged", "logged_output")
    first = variants.select("id", F.col("output").alias("first"))
    again = todo.select("id").join(first, "id").select("id", F.col("first").alias("output"))
    return done, free_names(again, existing, white)
