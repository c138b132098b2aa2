"""Sets of tests, answers and results as tables; parts of long jobs; written boards and score files."""

from __future__ import annotations

import json
import re
import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evalmill.functions.code_text import hinted
from evalmill.functions.prompts import category_and_format, directory_key, expand_categories
from evalmill.operators import synthesis
from evalmill.operators.relational import global_position
from evalmill.sources.tables import json_lines


def load_tests(spark: SparkSession, folder: str, names: list[str], hints: bool = True) -> DataFrame:
    """(id, category, config, question, functions) of the categories and collections named, functions as JSON, with language hints if wanted.

    Files are found by the category at the end of their names; a category without a file gives no rows.
    """
    wanted = expand_categories(names)
    rows = json_lines(spark, folder, "prompt").filter(F.col("_bad").isNull())
    found = rows.select("id", category_and_format(F.col("id")).alias("x"), F.to_json("question").alias("question"), F.to_json("function").alias("functions")).select("id", "x.*", "question", "functions")
    found = found.filter(F.col("category").isin(wanted) | (F.lit("format_sensitivity" in wanted) & F.col("id").rlike("^[^:]*:[^:]*:[^:]*$")))
    return with_hints(found) if hints else found


def with_hints(tests: DataFrame, functions: str = "functions", category: str = "category") -> DataFrame:
    """``tests`` whose functions (JSON) say which language they are in."""
    at, by = tests.columns.index(functions), tests.columns.index(category)

    def one(text: str | None, cat: str | None) -> str | None:
        language = "java" if "simple_java" == cat else "javascript" if "simple_javascript" == cat else "python"
        if not text:
            return text
        docs = [d | {"parameters": json.loads(d["parameters"])} if isinstance(d.get("parameters"), str) else d for d in json.loads(text)]
        return json.dumps([hinted(d, language) for d in docs])

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            yield pdf.assign(**{functions: [one(t, c) for t, c in zip(pdf.iloc[:, at], pdf.iloc[:, by], strict=True)]})

    return tests.mapInPandas(run, tests.schema)


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(position, value): the lines of a file with their number from 1."""
    lines = spark.read.text(path).withColumn("em_id", F.monotonically_increasing_id())
    return global_position(lines, ["em_id"], "position").select("position", "value")


def api_tables(spark: SparkSession, apis: str, pairs: str, responses: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The reference calls (id, domain, call), the answers (position, domain) and the responses (id, question, text), each of JSON lines in order."""
    read = lambda path, schema: numbered_lines(spark, path).select("position", F.from_json("value", schema).alias("x"))
    a = read(apis, "domain string, api_call string").select(F.col("position").alias("id"), "x.domain", F.col("x.api_call").alias("call"))
    p = read(pairs, "api_data struct<domain string, api_call string>").select("position", "x.api_data.domain")
    r = read(responses, "question_id long, text string").select(F.col("position").alias("id"), F.col("x.question_id").alias("question"), "x.text")
    return a, p, r


def save_part(df: DataFrame, folder: str, part: int) -> None:
    """One finished part of a job below ``folder``; written anew if it is there."""
    df.write.mode("overwrite").parquet(f"{folder}/part={part}")


def _children(spark: SparkSession, folder: str) -> list[str]:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    return [s.getPath().getName() for s in fs.listStatus(path)] if fs.exists(path) else []


def saved_parts(spark: SparkSession, folder: str) -> list[int]:
    """Numbers of the parts that are finished: those with the mark of a complete write."""
    names = [m[1] for n in _children(spark, folder) if (m := re.fullmatch(r"part=(\d+)", n))]
    return sorted(int(n) for n in names if "_SUCCESS" in _children(spark, f"{folder}/part={n}"))


def load_parts(spark: SparkSession, folder: str) -> DataFrame:
    """All finished parts together, with their number in ``part``."""
    done = saved_parts(spark, folder)
    return spark.read.option("basePath", folder).parquet(*[f"{folder}/part={n}" for n in done])


def resumed(spark: SparkSession, folder: str, parts: int, make) -> DataFrame:
    """``make(part)`` for each of the parts that isn't finished yet, saved one by one; all of them read back."""
    for n in sorted(set(range(parts)) - set(saved_parts(spark, folder))):
        save_part(make(n), folder, n)
    return load_parts(spark, folder)


def append_rows(df: DataFrame, path: str) -> None:
    """Rows added to a table by several writers at once: each commits its own files."""
    df.write.mode("append").parquet(path)


def save_index(vectors: DataFrame, path: str, key: str, vector: str = "embedding") -> None:
    """Vectors with their norms, for ``load_index``."""
    v = F.col(vector).cast("array<double>")
    vectors.select(key, v.alias(vector), F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x)).alias("norm")).write.mode("overwrite").parquet(path)


def load_index(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def write_score_files(lines: DataFrame, path: str, keys: list[str]) -> None:
    """A text file a key below ``path``, the header line first, from ``scored`` lines (keys, pos, id, line)."""
    named = lines.withColumns({"folder": directory_key(F.col("category"))}) if "category" in keys else lines
    by = ["folder", *keys] if "category" in keys else keys
    by = [b for b in by if b in named.columns]
    named.repartition(*by).sortWithinPartitions(*by, "pos", "id").select(*by, F.col("line").alias("value")).write.mode("overwrite").partitionBy(*by).text(path)


def write_rating_files(lines: DataFrame, path: str, group: str) -> None:
    """Sections of ``rating_lines`` as text, one after the other, in one file: ratings are few."""
    lines.repartition(1).sortWithinPartitions(group, "pos").select(F.col("line").alias("value")).write.mode("overwrite").text(path)


def write_boards(boards: dict[str, DataFrame], path: str) -> None:
    """Each leaderboard as a CSV folder of its name, maps as JSON."""
    for name, df in boards.items():
        flat = df.select(*[F.to_json(c).alias(c) if isinstance(df.schema[c].dataType, T.MapType | T.ArrayType | T.StructType) else F.col(c) for c in df.columns])
        flat.repartition(1).sortWithinPartitions("rank").write.mode("overwrite").option("header", True).csv(f"{path}/{name}")


def load_rows(spark: SparkSession, path: str) -> DataFrame:
    """Rows of a set of data: Parquet, JSON lines or CSV by the ending of its name; other names are Parquet folders."""
    if re.search(r"\.jsonl?$", path):
        return spark.read.json(path)
    return spark.read.option("header", True).csv(path) if path.endswith(".csv") else spark.read.parquet(path)


#: Shapes of training rows, and what they are written as.
FORMATTERS = {"rows": lambda rows: rows, "completion": synthesis.completion, "chat": synthesis.chat, "eval": synthesis.evaluation}
EXPORTERS = {"jsonl": lambda df, path: df.write.mode("overwrite").json(path), "parquet": lambda df, path: df.write.mode("overwrite").parquet(path)}


def export(rows: DataFrame, path: str, shape: str = "rows", kind: str = "jsonl") -> None:
    """Training rows written in a shape of ``FORMATTERS`` and a kind of ``EXPORTERS``."""
    if shape not in FORMATTERS or kind not in EXPORTERS:
        raise ValueError(f"no shape {shape} or no kind {kind}")
    EXPORTERS[kind](FORMATTERS[shape](rows), path)


def read_sqlite(spark: SparkSession, path: str, sql: str, schema: str, rows: int = 10_000) -> DataFrame:
    """Rows of a query on an SQLite file, read some at a time by one task; the file must be where tasks run."""
    names = [x.split()[0] for x in schema.split(", ")]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import sqlite3

        for _ in frames:
            with sqlite3.connect(f"file:{path}?mode=ro", uri=True) as con:
                cursor = con.execute(sql)
                while got := cursor.fetchmany(rows):
                    yield pd.DataFrame(got, columns=names)

    return spark.range(0, 1, 1, numPartitions=1).mapInPandas(run, schema)


def retried(fn: Callable[[], object], attempts: int = 5, wait: float = 1.0, most: float = 60.0, sleep: Callable[[float], None] = time.sleep) -> object:
    """What ``fn`` returns, tried again after waits that double; the last failure is raised."""
    if attempts < 1:
        raise ValueError("at least one attempt")
    for k in range(attempts - 1):
        try:
            return fn()
        except Exception:  # noqa: BLE001 - any failure of a source may pass
            sleep(min(most, wait * 2**k))
    return fn()


_CREATE = re.compile(r"CREATE TABLE\s+`?(\w+)`?\s*\((.*)\)[^)]*$", re.DOTALL | re.IGNORECASE)
_INSERT = re.compile(r"INSERT INTO\s+`?(\w+)`?\s*(?:\([^)]*\)\s*)?VALUES\s*(.*)$", re.DOTALL | re.IGNORECASE)
_CELL = re.compile(r"'((?:[^'\\]|\\.|'')*)'|([^,()']+)", re.DOTALL)


def read_dump(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """The tables of a small SQL dump, all columns as text; other statements are left out."""
    text = "\n".join(r[0] for r in spark.read.text(path, wholetext=True).collect())
    text = re.sub(r"/\*.*?\*/;?|^--.*?$", "", text, flags=re.DOTALL | re.MULTILINE)
    columns: dict[str, list[str]] = {}
    rows: dict[str, list[tuple]] = {}
    for statement in re.findall(r"(?:'(?:[^'\\]|\\.)*'|[^;'])+", text):
        s = statement.strip()
        if m := _CREATE.match(s):
            columns[m[1]] = [c[1] for line in m[2].split("\n") if (c := re.match(r"\s*`(\w+)`", line))]
        elif m := _INSERT.match(s):
            for cells in re.findall(r"\(((?:'(?:[^'\\]|\\.|'')*'|[^()'])*)\)", m[2]):
                found = [c[0].replace("''", "'") if c[0] or not c[1].strip() else None if c[1].strip().upper() == "NULL" else c[1].strip() for c in _CELL.findall(cells)]
                rows.setdefault(m[1], []).append(tuple(found))
    return {t: spark.createDataFrame(rows.get(t, []), ", ".join(f"`{c}` string" for c in cols)) for t, cols in columns.items()}


def described(tables: dict[str, DataFrame]) -> str:
    """Tables and their columns with types, a line each, for a prompt."""
    return "\n".join(line for name, df in sorted(tables.items()) for line in (f"Table: {name}", *(f"  {f.name} ({f.dataType.simpleString()})" for f in df.schema)))
