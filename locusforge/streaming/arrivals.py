"""Studies that arrive as files: a stream of rows through QC into an appended table.

An extension; summary statistics are bounded. Each row is judged by itself, so that any micro-batch gives the same
verdicts. Copies of a variant within a study are dropped by the watermark of their arrival.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import qc

SCHEMA = "study string, arrived timestamp, ordinal long, chromosome string, base_pair_location long, reference_allele string, alternate_allele string, effect_allele string, other_allele string, beta double, standard_error double, effect_allele_frequency double, p_value double"


def accepted(rows: DataFrame, late: str = "1 hour", build: str = "GRCh38") -> DataFrame:
    """Rows of a stream that no reason speaks against, one for each study and variant."""
    beta, se = F.col("beta"), F.col("standard_error")
    ready = qc.with_parts(rows.withColumn("z", F.when(se > 0, beta / se)), build)
    bad = F.lit(False)
    for mask in qc.reasons(ready).values():
        bad = bad | F.coalesce(mask, F.lit(False))
    kept = ready.where(~bad).drop(*qc.PARTS)
    return qc.canonicalize(kept, build).withWatermark("arrived", late).dropDuplicatesWithinWatermark(["study", "variant_code"])


def follow(spark: SparkSession, folder: str, target: str, checkpoint: str, **options) -> StreamingQuery:
    """Read Parquet files as they arrive in a folder and append what is accepted, by study; stops when it has caught up."""
    rows = spark.readStream.schema(SCHEMA).parquet(folder)
    out = accepted(rows, **options)
    return out.writeStream.format("parquet").partitionBy("study").option("path", target).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
