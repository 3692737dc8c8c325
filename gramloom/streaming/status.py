"""A stream of status messages: those that carry a text are told as id and text; an error ends the query."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from gramloom.sources.store import scratch


def read_stream(spark: SparkSession, path: str, schema: StructType, files_per_trigger: int = 64) -> DataFrame:
    """The files of a folder as a stream; a single file is a folder in which only its name counts."""
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).format("parquet")
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(at).isFile():
        parent, _, name = path.rpartition("/")
        return stream.option("pathGlobFilter", name).load(parent)
    return stream.load(path)


def with_text(events: DataFrame, id_col: str, json_col: str, field: str) -> DataFrame:
    """id, text of the messages whose JSON has the field."""
    return events.select(F.col(id_col).alias("id"), F.get_json_object(json_col, f"$.{field}").alias("text")).filter("text is not null")


def drained(stream: DataFrame) -> DataFrame:
    """All that the stream has now, written exactly once and read back: the checkpoint makes a restart go on."""
    spark = stream.sparkSession
    base = scratch(spark, "stream")
    query = stream.writeStream.format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{base}/out")
