"""Conversations as text with supervised spans, and label masks from token offsets."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Marks of the chat format, and the empty block that switches thinking off.
START, END, NO_THINKING = "<|im_start|>", "<|im_end|>", "<think>\n\n</think>\n\n"


def render(messages: Column, mode: str = "plain") -> Column:
    """``text, spans`` of an array of ``role, content`` (and ``reasoning`` for ``thinking``).

    A span covers what an assistant says and its end mark, in code points. ``plain``
    renders contents alone; ``no_thinking`` puts an empty block before an assistant's
    content, outside the span; ``thinking`` puts the reasoning in a block inside it. An
    empty array gives an empty text.
    """

    def parts(m: Column) -> Column:
        assistant = m["role"] == "assistant"
        head = F.concat(F.lit(START), m["role"], F.lit("\n"))
        body = m["content"]
        if mode == "no_thinking":
            head = F.concat(head, F.when(assistant, NO_THINKING).otherwise(""))
        elif mode == "thinking":
            thought = F.concat(F.lit("<think>\n"), F.btrim(m["reasoning"], F.lit("\n")), F.lit("\n</think>\n\n"), F.ltrim(m["content"], F.lit("\n")))
            body = F.when(assistant, thought).otherwise(body)
        return F.struct(head.alias("head"), F.concat(body, F.lit(END)).alias("body"), assistant.alias("own"))

    start = F.struct(F.lit("").alias("text"), F.array().cast("array<struct<start: int, end: int>>").alias("spans"))

    def add(a: Column, p: Column) -> Column:
        at = F.length(a["text"]) + F.length(p["head"])
        span = F.struct(at.alias("start"), (at + F.length(p["body"])).alias("end"))
        return F.struct(F.concat(a["text"], p["head"], p["body"], F.lit("\n")).alias("text"), F.when(p["own"], F.array_append(a["spans"], span)).otherwise(a["spans"]).alias("spans"))

    return F.aggregate(F.transform(messages, parts), start, add)


#: What a conversation with tools begins with where it has no system message, and how tools are told.
TOOL_SYSTEM = "Use the provided tools when required and answer from evidence."
TOOL_INTRO = "# Tools\n\nYou may call one or more functions to assist with the user query.\n\nYou are provided with function signatures within <tools></tools> XML tags:\n<tools>\n"
TOOL_OUTRO = "\n</tools>\n\nFor each function call, return a JSON object with function name and arguments within <tool_call></tool_call> XML tags."


def render_tools(messages: Column, tools: Column) -> Column:
    """``text, spans`` of an array of ``role, content, calls`` with the tools' signatures (JSON texts).

    ``calls`` are JSON texts of an assistant's calls. A leading system message, or a
    standing one, tells the tools; neighbouring tool results are one user message; an
    empty think block before an assistant's part is outside its span.
    """
    start, end = F.lit(START), F.lit(END + "\n")
    told = lambda system: F.concat(start, F.lit("system\n"), system, F.when(F.size(tools) > 0, F.concat(F.lit("\n\n" + TOOL_INTRO), F.array_join(tools, "\n"), F.lit(TOOL_OUTRO))).otherwise(""), end)
    own = F.get(messages, F.lit(0))
    led = F.coalesce(own["role"] == "system", F.lit(False))
    system = F.when(led & (F.coalesce(own["content"], F.lit("")) != ""), own["content"]).otherwise(TOOL_SYSTEM)
    rest = F.when(led, F.slice(messages, F.lit(2), F.size(messages))).otherwise(messages)
    zero = F.struct(told(system).alias("text"), F.array().cast("array<struct<start: int, end: int>>").alias("spans"), F.lit(False).alias("tool"))

    def add(a: Column, m: Column) -> Column:
        said = F.coalesce(m["content"], F.lit(""))
        called = F.transform(F.coalesce(m["calls"], F.array().cast("array<string>")), lambda c: F.concat(F.lit("<tool_call>\n"), c, F.lit("\n</tool_call>")))
        body = F.array_join(F.concat(F.when(said != "", F.array(said)).otherwise(F.array().cast("array<string>")), called), "\n")
        head = F.concat(a["text"], start, F.lit("assistant\n" + NO_THINKING))
        answer = F.concat(F.lit("<tool_response>\n"), said, F.lit("\n</tool_response>"))
        # A further result goes into the message that the one before has ended.
        open_ = F.when(a["tool"], F.concat(F.substring(a["text"], F.lit(1), F.length(a["text"]) - len(END) - 1), F.lit("\n"))).otherwise(F.concat(a["text"], start, F.lit("user\n")))
        span = F.struct(F.length(head).alias("start"), (F.length(head) + F.length(body) + len(END)).alias("end"))
        assistant, tool = m["role"] == "assistant", m["role"] == "tool"
        text = F.when(assistant, F.concat(head, body, end)).when(tool, F.concat(open_, answer, end)).otherwise(F.concat(a["text"], start, m["role"], F.lit("\n"), said, end))
        return F.struct(text.alias("text"), F.when(assistant, F.array_append(a["spans"], span)).otherwise(a["spans"]).alias("spans"), tool.alias("tool"))

    return F.aggregate(rest, zero, add, lambda a: F.struct(a["text"].alias("text"), a["spans"].alias("spans")))


def label_mask(tokens: Column, spans: Column) -> Column:
    """Labels of ``id, start, end`` tokens: the id inside a span, -100 outside, null where a token crosses an end."""

    def label(t: Column) -> Column:
        touches = lambda s: (t["start"] < s["end"]) & (t["end"] > s["start"])
        inside = lambda s: (t["start"] >= s["start"]) & (t["end"] <= s["end"])
        return F.when(~F.exists(spans, touches), -100).when(F.exists(spans, lambda s: touches(s) & inside(s)), t["id"])

    return F.transform(tokens, label)


def drop_unsupervised(labels: Column) -> Column:
    """Why a row can't be trained on, or null."""
    return F.when(F.exists(labels, lambda x: x.isNull()), "boundary_crossed").when(~F.exists(labels, lambda x: x != -100), "no_supervised_tokens")
