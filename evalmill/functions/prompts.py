"""Prompts, message lists and test ids as native column expressions."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from evalmill.functions.text import category_group, category_of

# Output formats, parameter notes, styles and templates of the system prompt, as the evaluated models get them.
OUTPUT_FORMATS = {
    "python": "[func_name1(params_name1=params_value1, params_name2=params_value2...), func_name2(params)]",
    "json": '```json\n[{"function":"func_name1","parameters":{"param1":"value1","param2":"value2"...}},{"function":"func_name2","parameters":{"param":"value"}}]\n```',
    "verbose_xml": '<functions><function name="func_name1"><params><param name="param1" value="value1" type="type1"/><param name="param2" value="value2" type="type2"/>...</params></function><function name="func_name2"><params><param name="param3" value="value3" type="type3"/></params></function></functions>',
    "concise_xml": '<functions><function name="func_name1"><param name="param1" type="type1">value1</param><param name="param2" type="type2">value2</param>...</function><function name="func_name2"><param name="param3" type="type3">value</param></function></functions>',
}
XML_TYPES = "The type fields of the parameters in your function calls must be one of: string, integer, float, boolean, array, dict, or tuple."
STYLES = {
    "classic": {
        "persona": "You are an expert in composing functions.",
        "task": "You are given a question and a set of possible functions. Based on the question, you will need to make one or more function/tool calls to achieve the purpose. If none of the functions can be used, point it out. If the given question lacks the parameters required by the function, also point it out.",
        "bare": ("You should only return the function calls in your response.\n\nIf you decide to invoke any of the function(s), you MUST put it in the format of ", ". ", " You SHOULD NOT include any other text in the response."),
        "tagged": ("You should only return the function calls in the <TOOLCALL> section. If you decide to invoke any of the function(s), you MUST put it in the format of <TOOLCALL>", "</TOOLCALL>. ", " You SHOULD NOT include any other text in the response."),
        "turns": "At each turn, you should try your best to complete the tasks requested by the user within the current turn. Continue to output functions to call until you have fulfilled the user's request to the best of your ability. Once you have no more functions to call, the system will consider the current turn complete and proceed to the next turn or task.",
        "tools": ("Here is a list of functions in ", " format that you can invoke.\n"),
    },
    "experimental": {
        "persona": "You are an expert in generating structured function calls.",
        "task": "You are given a user query and a set of available functions. Your task is to produce one or more function/tool calls to fulfill the user's request. If no suitable function exists, or required parameters are missing, clearly indicate this.",
        "bare": ("Respond with only the function calls.\n\nYou MUST format it exactly as ", ". ", " Do NOT include any other text."),
        "tagged": ("Return only the function calls enclosed in <TOOLCALL> tags.\n\nYou MUST format it exactly as <TOOLCALL>", "</TOOLCALL>. ", " Do NOT include any other text."),
        "turns": "At every turn, aim to complete the user's tasks within that turn. Continue emitting function calls until the request is satisfied to the best of your ability. Once no more calls are needed, the system will proceed to the next turn.",
        "tools": ("Below is a list of callable functions in the ", " style:\n"),
    },
}
HEADINGS = {"plaintext": ("", "\n\n", "\n\n", "\n\n"), "markdown": ("\n\n## Task\n", "\n\n## Tool Call Format\n", "\n\n## Multi-turn Behavior\n", "\n\n## Available Tools\n")}
DEFAULT_CONFIG = "ret_fmt=python&tool_call_tag=False&func_doc_fmt=json&prompt_fmt=plaintext&style=classic"
CONFIG = r"^ret_fmt=(python|json|verbose_xml|concise_xml)&tool_call_tag=(True|False)&func_doc_fmt=(python|xml|json)&prompt_fmt=(plaintext|markdown)&style=(classic|experimental)$"
#: Collections of test categories.
NON_LIVE = ["simple_python", "simple_java", "simple_javascript", "multiple", "parallel", "parallel_multiple", "irrelevance"]
LIVE = ["live_simple", "live_multiple", "live_parallel", "live_parallel_multiple", "live_irrelevance", "live_relevance"]
MULTI_TURN = ["multi_turn_base", "multi_turn_miss_func", "multi_turn_miss_param", "multi_turn_long_context"]
MEMORY, WEB_SEARCH = ["memory_kv", "memory_vector", "memory_rec_sum"], ["web_search_base", "web_search_no_snippet"]
_SCORING = [*NON_LIVE, *LIVE, *MULTI_TURN, *MEMORY, *WEB_SEARCH]
COLLECTIONS = {
    "all": [*_SCORING, "format_sensitivity"], "all_scoring": _SCORING, "multi_turn": MULTI_TURN, "single_turn": [*NON_LIVE, *LIVE], "live": LIVE, "non_live": NON_LIVE,
    "non_python": ["simple_java", "simple_javascript"], "python": ["simple_python", "irrelevance", "parallel", "multiple", "parallel_multiple", *LIVE], "memory": MEMORY, "web_search": WEB_SEARCH, "agentic": [*MEMORY, *WEB_SEARCH],
}


def expand_categories(names: Iterable[str]) -> list[str]:
    """Categories of the names, which are collections or categories, each once and in order; others raise ValueError."""
    found: set[str] = set()
    for n in names:
        if n not in COLLECTIONS and n not in COLLECTIONS["all"]:
            raise ValueError(f"no category {n}")
        found.update(COLLECTIONS.get(n, [n]))
    return sorted(found)


def config_fields(c: Column) -> Column:
    """(return_format, has_tag, doc_format, prompt_format, style) of a configuration; null where it has another form."""
    part = lambda i: F.regexp_extract(c, CONFIG, i)
    return F.when(c.rlike(CONFIG), F.struct(part(1).alias("return_format"), (part(2) == "True").alias("has_tag"), part(3).alias("doc_format"), part(4).alias("prompt_format"), part(5).alias("style")))


def _chosen(key: Column, of: dict[str, Column]) -> Column:
    out = F.lit(None).cast("string")
    for k, v in of.items():
        out = F.when(key == k, v).otherwise(out)
    return out


def system_prompt(functions: Column, config: Column | None = None) -> Column:
    """The system prompt for rendered ``functions``; null for a configuration of another form."""
    x = config_fields(config if config is not None else F.lit(DEFAULT_CONFIG))
    formats = _chosen(x["return_format"], {k: F.lit(v) for k, v in OUTPUT_FORMATS.items()})
    types = F.when(x["return_format"].isin("verbose_xml", "concise_xml"), XML_TYPES).otherwise("")
    how = lambda parts: F.concat(F.lit(parts[0]), formats, F.lit(parts[1]), types, F.lit(parts[2]))

    def filled(style: dict, heads: tuple[str, ...]) -> Column:
        call = F.when(x["has_tag"], how(style["tagged"])).otherwise(how(style["bare"]))
        tools = F.concat(F.lit(style["tools"][0]), x["doc_format"], F.lit(style["tools"][1]), functions, F.lit("\n"))
        return F.concat(F.lit(style["persona"] + heads[0] + style["task"] + heads[1]), call, F.lit(heads[2] + style["turns"] + heads[3]), tools)

    return _chosen(x["style"], {s: _chosen(x["prompt_format"], {p: filled(style, heads) for p, heads in HEADINGS.items()}) for s, style in STYLES.items()})


def memory_backend(category: Column) -> Column:
    """What follows ``memory_``; null for other categories."""
    return F.when(category.startswith("memory_"), F.substring(category, len("memory_") + 1, 1 << 20))


def directory_key(category: Column) -> Column:
    """The general group, for memory categories with the kind of memory below it."""
    backend = memory_backend(category)
    return F.concat(category_group(category), F.when(backend.isNotNull(), F.concat(F.lit("/memory/"), backend)).otherwise(""))


def sort_key(row_id: Column) -> Column:
    """(priority, category, index): memory preparation, web search, single turn, multi turn, then memory; ``index`` up to its first dash."""
    head = F.split(row_id, ":")[0]
    category = F.regexp_replace(head, "_[^_]*$", "")
    index = F.split(F.element_at(F.split(head, "_"), -1), "-")[0].cast("int")
    memory, multi = category.contains("memory"), category.contains("multi_turn")
    priority = F.when(memory & category.contains("prereq"), 0).when(category.contains("web_search"), 1).when(~memory & ~multi, 2).when(multi, 3).otherwise(4)
    return F.struct(priority.alias("priority"), category.alias("category"), index.alias("index"))


def _message(role: str, content: Column) -> Column:
    return F.struct(F.lit(role).alias("role"), content.alias("content"))


def with_system(messages: Column, text: Column) -> Column:
    """Messages whose first is the system's: ``text`` goes before what it says, or before all messages."""
    first = F.get(messages, 0)
    merged = F.concat(F.array(_message("system", F.concat(text, F.lit("\n\n"), first["content"]))), F.slice(messages, F.lit(2), F.greatest(F.size(messages) - 1, F.lit(0))))
    return F.when(F.coalesce(first["role"] == "system", F.lit(False)), merged).otherwise(F.concat(F.array(_message("system", text)), messages))


def system_as_user(messages: Column) -> Column:
    return F.transform(messages, lambda m: F.struct(F.when(m["role"] == "system", "user").otherwise(m["role"]).alias("role"), m["content"].alias("content")))


def tool_results(results: Column, calls: Column) -> Column:
    """(role, name, content) of each result and the call it answers, as far as both go."""
    n = F.least(F.size(results), F.size(calls))
    return F.transform(F.slice(calls, F.lit(1), n), lambda call, i: F.struct(F.lit("tool").alias("role"), call.alias("name"), F.get(results, i).alias("content")))


def message_list(texts: Column, system: Column) -> Column:
    """The system's message, then user and assistant in turn; an assistant's null is left out."""
    turns = F.transform(texts, lambda t, i: F.struct(F.when(i % 2 == 0, "user").otherwise("assistant").alias("role"), t.alias("content")))
    return F.concat(F.array(_message("system", system)), F.filter(turns, lambda m: (m["role"] == "user") | m["content"].isNotNull()))


def chat_fold(messages: Column, style: str, system: Column, sep: str = "\n", sep2: str = "</s>") -> Column:
    """Messages (role, content) as one prompt; an empty or null content leaves the role's mark open at the end.

    Styles: colon_single, colon_two (separators in turn), colon_space (the open
    mark ends in a space), no_colon, new_line, dolly, rwkv, phoenix.
    """
    one, in_turn = F.lit(sep), lambda i: F.when(i % 2 == 0, sep).otherwise(sep2)
    squeezed = lambda t: F.replace(F.replace(t, F.lit("\r\n"), F.lit("\n")), F.lit("\n\n"), F.lit("\n"))
    # (after the role, the text, after the text, after the role of an open message, separator after the system's text)
    forms = {
        "colon_single": (": ", lambda t: t, lambda i: one, ":", sep),
        "colon_two": (": ", lambda t: t, in_turn, ":", sep),
        "colon_space": (": ", lambda t: t, lambda i: one, ": ", sep),
        "no_colon": ("", lambda t: t, lambda i: one, "", ""),
        "new_line": ("\n", lambda t: t, lambda i: one, "\n", sep),
        "dolly": (":\n", lambda t: t, lambda i: F.concat(in_turn(i), F.when(i % 2 == 1, "\n\n").otherwise("")), ":\n", ""),
        "rwkv": (": ", squeezed, lambda i: F.lit("\n\n"), ":", ""),
        "phoenix": (": <s>", lambda t: t, lambda i: F.lit("</s>"), ": <s>", ""),
    }
    if style not in forms:
        raise ValueError(f"no style {style}")
    mark, shown, end, open_, head = forms[style]
    said = lambda m: F.coalesce(m["content"], F.lit("")) != ""
    parts = F.transform(messages, lambda m, i: F.when(said(m), F.concat(m["role"], F.lit(mark), shown(m["content"]), end(i))).otherwise(F.concat(m["role"], F.lit(open_))))
    return F.concat(system, F.lit(head), F.array_join(parts, ""))


def function_prompt(question: Column, functions: Column, system: str) -> Column:
    """A question with functions (JSON, null or empty for none) for a model that was trained on this form."""
    none = F.coalesce(functions, F.lit("[]")).isin("", "[]")
    return F.concat(F.lit(system + "\n### Instruction: "), F.when(none, F.concat(F.lit("<<question>> "), question)).otherwise(F.concat(F.lit("<<function>>"), functions, F.lit("\n<<question>>"), question)), F.lit("\n### Response: "))


def question_prompt(template: str, question: Column, context: Column) -> Column:
    """A template with ``{question}`` and ``{context}`` filled in."""
    out, at = [], 0
    for name, value in sorted(((n, v) for n, v in (("{question}", question), ("{context}", context))), key=lambda x: template.find(x[0])):
        k = template.find(name)
        if k < 0:
            raise ValueError(f"the template lacks {name}")
        out += [F.lit(template[at:k]), value]
        at = k + len(name)
    return F.concat(*out, F.lit(template[at:]))


def statements(sql: Column) -> Column:
    """Parts between semicolons, trimmed, empty ones left out."""
    return F.filter(F.transform(F.split(sql, ";"), lambda s: F.trim(s)), lambda s: s != "")


def with_overrides(env: Column, prefix: str, allowed: Iterable[str]) -> Column:
    """Allowed variables of a map; one with the prefix takes the place of that without."""
    names = list(allowed)
    plain = F.map_filter(env, lambda k, _: k.isin(names))
    over = F.map_filter(env, lambda k, _: k.startswith(prefix) & F.substring(k, len(prefix) + 1, 1 << 20).isin(names))
    over = F.transform_keys(over, lambda k, _: F.substring(k, len(prefix) + 1, 1 << 20))
    return F.map_concat(F.map_filter(plain, lambda k, _: ~F.map_contains_key(over, k)), over)


def age(birth: Column, on: Column) -> Column:
    """Whole years between two dates, by month and day."""
    early = F.struct(F.month(on), F.dayofmonth(on)) < F.struct(F.month(birth), F.dayofmonth(birth))
    return F.year(on) - F.year(birth) - early.cast("int")


def bumped(counter: Column, key: Column, wanted: Column, by: int = 1) -> Column:
    """A counter, raised where the key is the wanted one."""
    return F.when(key.eqNullSafe(wanted), F.coalesce(counter, F.lit(0)) + by).otherwise(counter)


def tool_calls_block(c: Column) -> Column:
    """What stands on the lines between the first tool-calls tags; empty without them."""
    return F.regexp_extract(c, r"(?s)<tool_calls>\n(.*?)\n</tool_calls>", 1)


def reasoning_split(c: Column) -> Column:
    """(reasoning, answer) around the last ``</think>``; without one all is answer."""
    at = F.length(c) - F.length(F.substring_index(c, "</think>", -1)) - len("</think>")
    reasoning = F.when(c.contains("</think>"), F.trim(F.replace(F.substring(c, F.lit(1), at), F.lit("<think>"), F.lit("")))).otherwise("")
    return F.struct(reasoning.alias("reasoning"), F.ltrim(F.substring_index(c, "</think>", -1)).alias("answer"))


def category_and_format(row_id: Column) -> Column:
    """(category, configuration) of an id; three parts are a configuration's, whose category is that of the last."""
    parts = F.split(row_id, ":")
    return F.when(F.size(parts) == 3, F.struct(category_of(parts[2]).alias("category"), parts[1].alias("config"))).otherwise(F.struct(category_of(row_id).alias("category"), F.lit(DEFAULT_CONFIG).alias("config")))
