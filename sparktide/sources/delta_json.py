"""Delta documents of other nodes: ``{"rows": [...], "watermark": "..."}``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparktide.functions.labels import empty_labels, labels_json

DELTA_DDL = (
    "rows array<struct<node_id:string,hostname:string,metric_name:string,labels:map<string,string>,"
    "time:string,value:double,anomalous:boolean>>, watermark string"
)


def delta_rows(documents: DataFrame) -> DataFrame:
    """Lake rows out of parsed delta documents."""
    rows = documents.select(F.explode("rows").alias("r")).select("r.*")
    stamp = F.to_timestamp("time")
    return rows.select(
        "node_id", "hostname", "metric_name",
        labels_json(F.coalesce("labels", empty_labels())).alias("labels_json"),
        stamp.alias("ts"), "value", F.coalesce("anomalous", F.lit(False)).alias("anomaly_bit"),
        F.to_date(stamp).alias("ts_day"),
    )


def parse_delta_json(texts: DataFrame, column: str = "value") -> DataFrame:
    """Lake rows out of a text column holding one document per row."""
    return delta_rows(texts.select(F.from_json(column, DELTA_DDL).alias("d")).select("d.*"))


def read_delta_json(spark: SparkSession, path: str, *, multi_line: bool = False) -> DataFrame:
    """Lake rows out of landed delta files."""
    return delta_rows(spark.read.schema(DELTA_DDL).option("multiLine", multi_line).json(path))
