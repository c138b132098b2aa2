"""Readers and writers of the record formats."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evalmill.functions.text import two_digits

_CALL = T.ArrayType(T.MapType(T.StringType(), T.MapType(T.StringType(), T.StringType())))
#: Schemas of the record files; nested values of mixed types stay JSON text.
SCHEMAS = {
    "prompt": "id string, question array<array<struct<role string, content string>>>, function array<struct<name string, description string, parameters string>>, involved_classes array<string>, depends_on array<string>, scenario string",
    "truth": T.StructType([T.StructField("id", T.StringType()), T.StructField("ground_truth", _CALL)]),
    "truth_text": "id string, ground_truth string",
    "result": "model string, category string, id string, result string, input_token_count string, output_token_count string, latency string",
    "battle": "Agent_A struct<`Agent name` string, Category array<string>, Frameworks array<string>, Models array<string>, Tools array<string>>, Agent_B struct<`Agent name` string, Category array<string>, Frameworks array<string>, Models array<string>, Tools array<string>>, Rating string",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(scan: DataFrame) -> DataFrame:
    """Rows of a plain scan dealt out evenly, if it has fewer partitions than there are cores: a small file can't be split, but what is done with its texts can.

    At most as many partitions' bytes as cores are shuffled; larger inputs stay as they are.
    """
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan.repartition(cores) if scan._jdf.queryExecution().toRdd().getNumPartitions() < cores else scan


def shared_folder(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir; one of our own only where none is set and all run in one process."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = "file://" + tempfile.mkdtemp(prefix="evalmill-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


_stored: list[tuple] = []


def _clean() -> None:
    """Delete what ``stored`` wrote; the JVM may be gone already."""
    for sc, path in _stored:
        try:
            at = sc._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(sc._jsc.hadoopConfiguration()).delete(at, True)
        except Exception:  # noqa: BLE001 - nothing more can be done at exit
            return


atexit.register(_clean)


def stored(df: DataFrame, name: str) -> DataFrame:
    """Written below the shared folder and read again, so that loops don't grow their lineage; deleted at exit."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/evalmill/{name}-{uuid.uuid4().hex}"
    _stored.append((spark.sparkContext, path))
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def json_lines(spark: SparkSession, path: str, kind: str, glob: str = "*.json") -> DataFrame:
    """JSON lines below a folder with the schema of ``kind``, bad lines kept apart, and the category of each file's name."""
    schema = SCHEMAS[kind]
    struct = T._parse_datatype_string(schema) if isinstance(schema, str) else schema
    df = spark.read.schema(T.StructType([*struct.fields, T.StructField("_bad", T.StringType())])).option("columnNameOfCorruptRecord", "_bad").option("recursiveFileLookup", True).option("pathGlobFilter", glob).json(path)
    return df.withColumn("file_category", F.regexp_extract(F.col("_metadata.file_path"), r"([A-Za-z_]+?)(?:_score|_result)?\.json$", 1))


def whole_texts(spark: SparkSession, path: str, glob: str = "*.txt") -> DataFrame:
    return spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", glob).text(path, wholetext=True)


def json_array(spark: SparkSession, path: str) -> DataFrame:
    """Documents of a JSON array, each as text."""
    df = spark.read.option("multiLine", True).json(path)
    return df.select(F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns])).alias("chunk"))


def rating_file(lines: DataFrame, ranges: int = 32) -> DataFrame:
    """(category, name, rating) of (line_no, value): a header line names the category of the ratings below it.

    Lines are dealt by ranges; a range takes over the last header before it, so
    that no task holds all lines.
    """
    rating = r"^(.+):\s+(\d+\.\d+)\s*$"
    header = F.when(~F.col("value").rlike(rating) & (F.trim("value") != ""), F.regexp_replace(F.trim("value"), ":$", ""))
    dealt = lines.repartitionByRange(ranges, "line_no").withColumns({"em_range": F.spark_partition_id(), "em_head": header})
    dealt = stored(dealt, "lines")
    inside = F.last("em_head", ignorenulls=True).over(Window.partitionBy("em_range").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0))
    ends = dealt.groupBy("em_range").agg(F.max_by("em_head", F.when(F.col("em_head").isNotNull(), F.col("line_no"))).alias("em_last"))  # a row a range
    before = F.last("em_last", ignorenulls=True).over(Window.orderBy("em_range").rowsBetween(Window.unboundedPreceding, -1))
    held = dealt.withColumn("em_in", inside).join(F.broadcast(ends.select("em_range", before.alias("em_before"))), "em_range")
    found = held.filter(F.col("value").rlike(rating))
    return found.select(F.coalesce("em_in", "em_before").alias("category"), F.trim(F.regexp_extract("value", rating, 1)).alias("name"), F.regexp_extract("value", rating, 2).cast("double").alias("rating"))


def jdbc(spark: SparkSession, url: str, query: str, **options: str) -> DataFrame:
    return spark.read.format("jdbc").options(url=url, query=query, **options).load()


def write_results(df: DataFrame, path: str) -> None:
    """JSON lines by group and category, in the order of ids within each file."""
    df.repartition("group", "category").sortWithinPartitions("group", "category", "id").write.partitionBy("group", "category").mode("overwrite").json(path)


def write_ranked_csv(df: DataFrame, path: str, percent: list[str]) -> None:
    """A leaderboard as CSV: shares as per cent of two digits, null as N/A."""
    shown = df.withColumns({c: F.coalesce(F.concat(two_digits(F.col(c) * 100), F.lit("%")), F.lit("N/A")) for c in percent})
    shown.coalesce(1).sortWithinPartitions("rank").write.mode("overwrite").option("header", True).csv(path)
