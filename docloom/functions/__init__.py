"""Column builders: they return expressions, so plans stay inside the JVM."""

from pyspark.sql import DataFrame


def read_size(df: DataFrame) -> int:
    """Bytes of the tables that df reads, as Spark knows them without reading; very large for what isn't a file."""
    leaves = df._jdf.queryExecution().analyzed().collectLeaves()
    return sum(int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size()))


def spread(df: DataFrame) -> DataFrame:
    """df over as many partitions as there are cores where a small table lies in fewer files: a file of one row group is
    one task, however long its Python function takes. A table with a full split for every core is left as it lies."""
    spark = df.sparkSession
    cores = spark.sparkContext.defaultParallelism
    split = spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get("spark.sql.files.maxPartitionBytes"))
    if read_size(df) >= cores * split or len(df._jdf.inputFiles()) >= cores:
        return df
    return df.repartition(cores)
