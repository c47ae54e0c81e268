"""Session settings that wide expressions depend on."""

from __future__ import annotations

from pyspark.sql import DataFrame


def tuned(df: DataFrame) -> DataFrame:
    """Bounds generated methods at 8,000 bytes of code, beyond which the JVM doesn't compile them.

    Spark's own limit is 65,535. A pass with some forty masks lies between the two and would run interpreted, seven times
    slower than when Spark splits it.
    """
    conf = df.sparkSession.conf
    if conf.get("spark.sql.codegen.hugeMethodLimit", "65535") != "8000":
        conf.set("spark.sql.codegen.hugeMethodLimit", "8000")
    return df
