"""Command line: version, test-categories, queries, run, evaluate, scores."""

from __future__ import annotations

import argparse

VERSION = "0.2"


def session():
    from pyspark.sql import SparkSession

    return SparkSession.builder.config("spark.sql.session.timeZone", "UTC").getOrCreate()


def evaluate(results: str, tests: str, truth: str, out: str, categories: list[str], partial: bool) -> None:
    """Results checked against tests and truth: score files and leaderboards below ``out``."""
    from pyspark.sql import functions as F

    from evalmill.operators import evaluation
    from evalmill.operators.scoring import category_accuracy
    from evalmill.sources import datasets
    from evalmill.sources.tables import json_lines, stored

    spark = session()
    asked = datasets.load_tests(spark, tests, categories)
    answers = json_lines(spark, truth, "truth_text").select("id", F.col("ground_truth").alias("truth"))
    folder = F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)/[^/]*/[^/]*$", 1)
    given = json_lines(spark, results, "result").filter(F.col("_bad").isNull()).select("id", F.coalesce("model", folder).alias("model"), "result")
    for name in [r[0] for r in given.select("model").distinct().collect()]:  # a model at a time only to compare counts
        evaluation.length_checked(given.filter(F.col("model") == name).select("id"), asked.select("id"), partial=partial)
    rows = given.join(asked, "id").join(answers, "id", "left").withColumn("style", F.lit("python"))
    plain = rows.filter(~F.col("category").contains("relevance")).withColumnRenamed("functions", "docs")
    checked = evaluation.call_entries(plain).select("model", "category", "id", "result", "valid", "error_type")
    other = evaluation.relevance(evaluation.decode_results(rows.filter(F.col("category").contains("relevance")))).select("model", "category", "id", "result", "valid", "error_type")
    checked = stored(checked.union(other), "checked")
    datasets.write_score_files(evaluation.score_lines(checked, ["model", "category"]), f"{out}/scores", ["model", "category"])
    datasets.write_boards(evaluation.leaderboards(category_accuracy(checked, "model", "category")), f"{out}/boards")


def main(argv: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="evalmill")
    verbs = parser.add_subparsers(dest="verb", required=True)
    verbs.add_parser("version")
    verbs.add_parser("test-categories")
    verbs.add_parser("queries")
    run = verbs.add_parser("run")
    run.add_argument("query")
    run.add_argument("tables")
    run.add_argument("--out")
    ev = verbs.add_parser("evaluate")
    for name in ("results", "tests", "truth", "out"):
        ev.add_argument(name)
    ev.add_argument("--categories", nargs="+", default=["all_scoring"])
    ev.add_argument("--partial", action="store_true")
    sc = verbs.add_parser("scores")
    sc.add_argument("out")
    sc.add_argument("--board", default="overall")
    args = parser.parse_args(argv)
    if args.verb == "version":
        print(VERSION)
    elif args.verb == "test-categories":
        from evalmill.functions.prompts import COLLECTIONS

        for name, members in COLLECTIONS.items():
            print(f"{name}: {', '.join(members)}")
    elif args.verb == "queries":
        from evalmill.plans import catalogue, more, sessions  # noqa: F401 - all register

        print("\n".join(catalogue.QUERIES))
    elif args.verb == "run":
        from evalmill.plans import catalogue, more, sessions  # noqa: F401 - all register

        df = catalogue.QUERIES[args.query](session(), args.tables)
        df.write.mode("overwrite").parquet(args.out) if args.out else df.show(20, truncate=False)
    elif args.verb == "evaluate":
        evaluate(args.results, args.tests, args.truth, args.out, args.categories, args.partial)
    else:
        session().read.option("header", True).csv(f"{args.out}/boards/{args.board}").orderBy("rank").show(100, truncate=False)


if __name__ == "__main__":
    main()
