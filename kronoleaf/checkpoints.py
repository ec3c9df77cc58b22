"""Where lineage is cut."""

import tempfile

from pyspark.sql import DataFrame


def written(df: DataFrame) -> DataFrame:
    """`df` written in the session's checkpoint folder and read from there.

    The folder is the cluster's (spark.checkpoint.dir). Only where none is set, one is: in the
    warehouse, which executors share, or, in a local session, a temporary one.
    """
    spark = df.sparkSession
    context = spark.sparkContext
    if not spark.conf.get("spark.checkpoint.dir", None) and not context.getCheckpointDir():
        local = context.master.startswith("local")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="spark-") if local else f"{spark.conf.get('spark.sql.warehouse.dir')}/checkpoints")
    return df.checkpoint()
