"""Text functions as native column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def standardize_call_string(c: Column) -> Column:
    """Lower case without spaces and ``,./-_*^``; single quotes become double."""
    return F.translate(F.lower(F.regexp_replace(c, r"[ ,./\-_*^]", "")), "'", '"')


def standardize_answer(c: Column) -> Column:
    """Lower case without ``,./-_*^()``; spaces stay, single quotes become double."""
    return F.translate(F.lower(F.regexp_replace(c, r"[,./\-_*^()]", "")), "'", '"')


def contains_answer(response: Column, answer: Column) -> Column:
    """The standardised answer occurs in the standardised response between word borders."""
    quoted = F.concat(F.lit(r"(?U)\b\Q"), F.replace(standardize_answer(answer), F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E\b"))
    return F.regexp_like(standardize_answer(response), quoted)


def category_of(row_id: Column) -> Column:
    """``category`` of ``category_index`` or ``category_index:config:origin``; the mark of a prerequisite goes."""
    return F.regexp_replace(F.regexp_replace(F.split(row_id, ":")[0], "_prereq", ""), "_[^_]*$", "")


def prompt_format_of(row_id: Column, default: str) -> Column:
    """The second field of an id with colons, else the default."""
    return F.coalesce(F.get(F.split(row_id, ":"), 1), F.lit(default))


def final_answer(c: Column) -> Column:
    """What follows the last ``<ANSWER>: ``; the whole text without it."""
    return F.element_at(F.split(c, r"\Q<ANSWER>: \E"), -1)


def without_last_line(c: Column) -> Column:
    return F.regexp_replace(c, r"\n?[^\n]*\z", "")


def code_fence(c: Column, *tags: str) -> Column:
    """The first fenced block with one of the tags; empty without one."""
    return F.regexp_extract(c, r"(?s)```(?:" + "|".join(tags) + r")\s*\n(.*?)```", 1)


def tool_call(c: Column) -> Column:
    return F.regexp_extract(c, r"(?s)<TOOLCALL>(.*?)</TOOLCALL>", 1)


def after_reasoning(c: Column) -> Column:
    """The text after the last ``</think>``; unchanged without one."""
    return F.ltrim(F.substring_index(c, "</think>", -1))


def between_letters(c: Column) -> Column:
    """From the first letter to one character past the last."""
    return F.regexp_extract(c, r"(?s)\p{L}(?:.*\p{L})?.?", 0)


def secret_mask(c: Column, shown: int = 4) -> Column:
    """Dots, and the last characters."""
    return F.concat(F.repeat(F.lit("."), F.greatest(F.length(c) - shown, F.lit(0))), F.right(c, F.lit(shown)))


def two_digits(c: Column, up: bool = False) -> Column:
    """A number from 0 to below 1000 with two digits, rounded as the double it is, ties to the even digit or upwards."""
    x = c.cast("double")
    unit = F.when(x < 1, F.lit(2**60)).otherwise(F.lit(2**53))  # parts of a double: all of those that matter are whole
    whole = unit.cast("decimal(38,0)")
    twice = (x * unit.cast("double")).cast("long").cast("decimal(38,0)") * 200
    n = F.call_function("div", twice + whole, whole * 2)
    tie = (twice + whole) == n.cast("decimal(38,0)") * whole * 2
    n = n if up else F.when(tie & (n % 2 == 1), n - 1).otherwise(n)
    return F.format_string("%d.%02d", F.call_function("div", n, F.lit(100)), n % 100)


def human_size(c: Column) -> Column:
    """Bytes as B, KB, MB, GB or TB of 1024, two digits, halves to even."""
    units = ["B", "KB", "MB", "GB", "TB"]
    out = F.format_string("%.2f B", c.cast("double"))
    for k in range(1, len(units)):
        out = F.when(c >= float(1024**k), F.format_string(f"%.2f {units[k]}", F.bround(c / float(1024**k), 2))).otherwise(out)
    return out


def fixed_chunks(c: Column, size: int) -> Column:
    """Pieces of ``size`` characters in order; none of an empty text."""
    n = F.length(c)
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1, F.lit(size)), lambda i: F.substring(c, i + 1, F.lit(size)))).otherwise(F.array().cast("array<string>"))


def ngrams(tokens: Column, n: int) -> Column:
    """Runs of n tokens as texts with single spaces."""
    return F.when(F.size(tokens) >= n, F.transform(F.sequence(F.lit(0), F.size(tokens) - n), lambda i: F.array_join(F.slice(tokens, i + 1, n), " "))).otherwise(F.array().cast("array<string>"))


def grep(c: Column, needle: Column | str) -> Column:
    """Lines that hold the literal text."""
    return F.filter(F.split(c, "\n"), lambda x: F.contains(x, F.lit(needle) if isinstance(needle, str) else needle))


def sorted_lines(c: Column) -> Column:
    return F.array_join(F.array_sort(F.split(c, "\n")), "\n")


def tail(c: Column, n: int) -> Column:
    lines = F.split(c, "\n")
    return F.array_join(F.slice(lines, F.greatest(F.size(lines) - n, F.lit(0)) + 1, F.lit(n)), "\n")


def cosine(a: Column, b: Column) -> Column:
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return dot(a, b) / F.sqrt(dot(a, a) * dot(b, b))


def python_round(c: Column, digits: int) -> Column:
    """Rounding half to even on the shortest decimal form."""
    return F.bround(c, digits)


def category_group(c: Column) -> Column:
    """The general group of a test category; the order of the cases decides."""
    return (
        F.when(c.contains("format_sensitivity"), "format_sensitivity")
        .when(~(c.contains("live") & ~c.contains("non_live")) & ~c.contains("multi_turn") & ~c.contains("memory") & ~c.contains("web_search"), "non_live")
        .when(c.contains("live"), "live")
        .when(c.contains("multi_turn"), "multi_turn")
        .otherwise("agentic")
    )


def category_predicates(c: Column) -> dict[str, Column]:
    """What a test category is, by name."""
    has = c.contains
    agentic, multi = has("web_search") | has("memory"), has("multi_turn")
    return {
        "format_sensitivity": has("format_sensitivity"), "web_search": has("web_search"), "memory": has("memory"), "memory_prereq": has("prereq"), "first_memory_prereq": has("prereq") & c.endswith("-0"), "agentic": agentic, "multi_turn": multi, "live": has("live"),
        "non_live": ~(has("format_sensitivity") | agentic | multi | has("live")), "multi_turn_irrelevance": has("miss_func") | has("miss_param"), "executable": has("exec") | has("rest"), "rest": has("rest"), "relevance": has("relevance"), "chatable": has("chatable"),
        "java": has("java") & ~has("javascript"), "javascript": has("javascript"), "sql": has("sql"), "multi_turn_interaction": multi | agentic,
    }
