"""Evaluation of model results: decoding, the checkers of each kind of test, score files and leaderboards.

Decoding needs Python and is done once for all checkers (``decode_results``);
what follows from it is native.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evalmill.functions import calls as C
from evalmill.functions import source_calls
from evalmill.functions.checking import check_calls
from evalmill.functions.text import category_group, contains_answer
from evalmill.operators import scoring

#: Names that a call must not have: fixed values.
DENIED = ["kill", "exit", "quit", "remove", "unlink", "popen", "Popen", "run"]
#: Steps after which a turn is ended by force.
STEP_LIMIT = 20


def length_checked(results: DataFrame, prompts: DataFrame, key: str = "id", partial: bool = False) -> DataFrame:
    """``prompts`` joined with ``results``; other numbers of rows raise ValueError, unless ``partial`` allows prompts without a result."""
    if not partial:
        n, m = results.count(), prompts.count()
        if n != m:
            raise ValueError(f"{n} results and {m} prompts")
    return prompts.join(results, key)


def decode_results(rows: DataFrame, text: str = "result", style: str = "style") -> DataFrame:
    """``rows`` with ``decoded`` (calls as JSON, null where they can't be read), ``is_calls`` and ``is_empty``."""
    names = rows.columns
    at, by = names.index(text), names.index(style)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            found = [source_calls.decode(s, t)[0] for s, t in zip(pdf.iloc[:, by], pdf.iloc[:, at], strict=True)]
            yield pdf.assign(decoded=[None if f is None else C.canon(f) for f in found], is_calls=[f is not None and C.is_call_format(f) for f in found], is_empty=[f is None or C.is_empty(f) for f in found])

    from pyspark.sql import types as T

    schema = T.StructType([*rows.schema.fields, T.StructField("decoded", T.StringType()), T.StructField("is_calls", T.BooleanType()), T.StructField("is_empty", T.BooleanType())])
    return rows.mapInPandas(run, schema)


def relevance(decoded: DataFrame, category: str = "category") -> DataFrame:
    """``valid`` and ``error_type``: a call is wanted, or, where the category says irrelevance, none."""
    called = F.col("decoded").isNotNull() & ~F.col("is_empty")
    irrelevant = F.col(category).contains("irrelevance")
    valid = F.when(irrelevant, ~called).otherwise(called)
    error = F.when(valid, F.lit(None).cast("string")).when(irrelevant, "irrelevance_error:decoder_success").otherwise("relevance_error:decoder_failed")
    return decoded.withColumns({"valid": valid, "error_type": error})


def call_entries(rows: DataFrame, text: str = "result", style: str = "style", category: str = "category", docs: str = "docs", truth: str = "truth") -> DataFrame:
    """``rows`` with ``valid`` and ``error_type``: decoded, in the form of calls, and checked against the truth; docs and truth are JSON lists."""
    names = rows.columns
    at = [names.index(c) for c in (text, style, category, docs, truth)]

    def verdict(result, how, kind, functions, expected) -> tuple[bool, str | None]:
        found, error = source_calls.decode(how, result)
        if error:
            return False, error
        language = how if how in ("java", "javascript") else "python"
        return check_calls(json.loads(functions), found, json.loads(expected), kind, language)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            got = [verdict(*r) for r in zip(*(pdf.iloc[:, i] for i in at), strict=True)]
            yield pdf.assign(valid=[g[0] for g in got], error_type=[g[1] for g in got])

    from pyspark.sql import types as T

    return rows.mapInPandas(run, T.StructType([*rows.schema.fields, T.StructField("valid", T.BooleanType()), T.StructField("error_type", T.StringType())]))


def last_message(steps: DataFrame, key: str, order: str, text: str = "result") -> DataFrame:
    """(key, message): the last step of each row that holds no call; null where every step does.  ``steps`` are decoded."""
    silent = F.col("decoded").isNull() | F.col("is_empty")
    return steps.groupBy(key).agg(F.max_by(F.when(silent, F.col(text)), F.when(silent, F.col(order))).alias("message"))


def agentic(messages: DataFrame, answers: str = "answers") -> DataFrame:
    """``valid`` and ``error_type`` of rows with ``message``: one of the answers (an array) must stand in it as words."""
    message = F.coalesce(F.col("message"), F.lit(""))
    hit = F.coalesce(F.exists(answers, lambda a: contains_answer(message, a)), F.lit(False))
    error = F.when(message == "", "agentic:no_last_message").when(~hit, "agentic:answer_not_found")
    return messages.withColumns({"valid": (message != "") & hit, "error_type": error})


def irrelevance_by_turn(turns: DataFrame, key: str, turn: str, truth: str, model: str) -> DataFrame:
    """(key, valid, turn): where a turn has no true calls the model's must be empty too; the first that fails."""
    empty = (F.size(model) == 0) | ((F.size(model) == 1) & (F.length(F.get(F.col(model), 0)) == 0))
    bad = (F.size(truth) == 0) & ~empty
    return turns.groupBy(key).agg((~F.max(bad)).alias("valid"), F.min(F.when(bad, F.col(turn))).alias("turn"))


def in_same_order(wanted: Column, found: Column) -> Column:
    """All of ``wanted`` occur in ``found`` in that order, with others between."""
    return F.aggregate(found, F.lit(0), lambda k, x: k + F.coalesce((F.get(wanted, k) == x).cast("int"), F.lit(0))) == F.size(wanted)


def never_called(wanted: Column, found: Column) -> Column:
    return F.filter(wanted, lambda x: ~F.array_contains(found, x))


def is_denied(call: Column) -> Column:
    """The method's name, without arguments and without what it belongs to, is one that must not be called."""
    head = F.split(call, r"\(")[0]
    return F.when(head.contains("."), F.get(F.split(head, r"\."), 1)).otherwise(head).isin(DENIED)


def is_executable(calls: Column) -> Column:
    """One or more texts, none of them null."""
    return F.coalesce((F.size(calls) > 0) & F.forall(calls, lambda c: c.isNotNull()), F.lit(False))


def is_empty_execution(results: Column) -> Column:
    return (F.size(results) == 0) | ((F.size(results) == 1) & (F.length(F.get(results, 0)) == 0))


def over_budget(steps: DataFrame, key: str, turn: str, step: str, limit: int = STEP_LIMIT) -> DataFrame:
    """(key, turn, forced): whether a turn took more than ``limit`` steps."""
    return steps.groupBy(key, turn).agg((F.count(step) > limit).alias("forced"))


def held_out(functions: Column, missed: Column) -> Column:
    """(functions, missed): docs (structs with ``name``) without the missed names, and the docs of those by turn.

    ``missed`` maps a turn to names.  Of equal names the first doc goes, to the
    first turn that misses it.
    """
    names = F.array_distinct(F.flatten(F.map_values(missed)))
    first = lambda n: F.try_element_at(F.filter(functions, lambda d: d["name"] == n), F.lit(1))
    place = lambda n: F.array_position(F.transform(functions, lambda d: d["name"]), n)
    gone = F.transform(names, lambda n: place(n).cast("int"))
    kept = F.filter(functions, lambda d, i: ~F.array_contains(gone, i + 1))
    return F.struct(kept.alias("functions"), F.transform_values(missed, lambda _, ns: F.filter(F.transform(ns, first), lambda d: d.isNotNull())).alias("missed"))


def by_category(rows: DataFrame, category: str, row_id: str) -> DataFrame:
    """(category, ids): the ids of each, in order; for the lists of tests, not for large tables."""
    return rows.groupBy(category).agg(F.array_sort(F.collect_list(row_id)).alias("ids"))


def with_model(scores: DataFrame, models: DataFrame, key: str = "model") -> DataFrame:
    """``scores`` with the columns of their model; an underscore in a folder's name stands for a slash."""
    named = scores.withColumn("em_name", F.replace(key, F.lit("_"), F.lit("/")))
    return named.join(F.broadcast(models.withColumnRenamed(key, "em_name")), "em_name", "left").drop("em_name")  # models are a few hundred


def score_lines(checked: DataFrame, keys: list[str], valid: str = "valid") -> DataFrame:
    """Lines of score files: for each file (``keys``) a header with accuracy and counts at ``pos`` 0, then its failed rows as JSON."""
    head = checked.groupBy(*keys).agg(F.avg(F.col(valid).cast("double")).alias("accuracy"), F.count_if(valid).alias("correct_count"), F.count("*").alias("total_count"))
    first = head.select(*keys, F.lit(0).alias("pos"), F.lit("").alias("id"), F.to_json(F.struct("accuracy", "correct_count", "total_count")).alias("line"))
    rest = checked.filter(~F.col(valid)).select(*keys, F.lit(1).alias("pos"), F.col("id").cast("string").alias("id"), F.to_json(F.struct(*[c for c in checked.columns if c not in keys])).alias("line"))
    return first.union(rest)


#: The leaderboards, and the members of each with their weights in the overall score.
BOARDS = {"non_live": 10, "live": 10, "irrelevance": 10, "multi_turn": 30, "agentic": 40}


def board_of(category: Column) -> Column:
    """The part of the overall score that a category belongs to; null for those that don't count."""
    group = category_group(category)
    return F.when(category.contains("irrelevance"), "irrelevance").when(group.isin("non_live", "live", "multi_turn", "agentic"), group)


def leaderboards(scores: DataFrame) -> dict[str, DataFrame]:
    """A table for each group of categories, one for configurations, and the overall one, ranked; from (model, category, accuracy, total_count)."""
    grouped = scores.withColumn("board", category_group(F.col("category")))
    out = {}
    for name in ("non_live", "live", "multi_turn", "agentic", "format_sensitivity"):
        mine = grouped.filter(F.col("board") == name)
        out[name] = scoring.ranked(mine.groupBy("model").agg(F.avg("accuracy").alias("accuracy"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("category", "accuracy")))).alias("categories")), "accuracy", "model")
    parts = scores.withColumn("board", board_of(F.col("category"))).filter("board is not null").groupBy("model", "board").agg(F.avg("accuracy").alias("accuracy"))
    weight = F.create_map(*[F.lit(x) for kv in BOARDS.items() for x in kv])
    total = parts.groupBy("model").agg((F.sum(F.col("accuracy") * weight[F.col("board")]) / sum(BOARDS.values())).alias("accuracy"))
    out["overall"] = scoring.ranked(total, "accuracy", "model")
    return out


def first_api(responses: DataFrame, apis: DataFrame) -> DataFrame:
    """(response, api): for each response (id, text) the first api (id, args: an array) all of whose arguments stand in its text.

    An api without arguments never fits.  The apis are a stated reference list:
    they are met in a scan of the responses, and only each response's least fit
    is kept, before any shuffle.
    """
    usable = apis.filter(F.size("args") > 0).select(F.col("id").alias("api"), "args")
    listed = F.broadcast(usable) if usable.count() <= 100_000 else usable
    fit = F.forall("args", lambda a: F.contains(F.col("text"), F.trim(a, F.lit("'"))))
    hits = responses.select(F.col("id").alias("response"), "text").join(listed, fit)
    return responses.select(F.col("id").alias("response")).join(hits.groupBy("response").agg(F.min("api").alias("api")), "response", "left")


def functional_accuracy(found: DataFrame, apis: DataFrame, answers: DataFrame) -> DataFrame:
    """One row: the share of responses whose api has the domain of the answer at their question's position, and the share with no api.

    ``found`` has response, question (1-based) and api; ``apis`` id and domain; ``answers`` position and domain.
    """
    known = found.join(apis.select(F.col("id").alias("api"), F.col("domain").alias("got")), "api", "left").join(answers.select(F.col("position").alias("question"), F.col("domain").alias("want")), "question", "left")
    right = F.coalesce(F.col("got") == F.col("want"), F.lit(False))
    return known.agg(F.avg(right.cast("double")).alias("accuracy"), F.avg(F.col("api").isNull().cast("double")).alias("hallucination"), F.count("*").alias("n"))
