"""Prompt assembly and the optional answer step.

The language-model call is not part of the engine: pass ``complete_fn``
(``list[prompt] -> list[str]``) to get answers; a failing prompt or an
empty reply gives ''."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import py_strip

# Instruction text and generation settings of the two
# prompt styles.
INSTRUCTION = ("Answer the question based on the context below, and if the question "
               "can't be answered based on the context, say \"I don't know\"")
CHAT_SETTINGS = {"model": "gpt-3.5-turbo", "temperature": 0.2, "max_tokens": 150, "top_p": 0.8,
                 "frequency_penalty": 0.0, "presence_penalty": 0.0}
COMPLETION_SETTINGS = {"model": "text-davinci-003", "temperature": 0.0, "max_tokens": 150,
                       "top_p": 1.0, "frequency_penalty": 0.0, "presence_penalty": 0.0}


def _settings(d):
    return F.struct(F.lit(d["model"]).alias("model"),
                    F.lit(d["temperature"]).cast("double").alias("temperature"),
                    F.lit(d["max_tokens"]).cast("int").alias("max_tokens"),
                    F.lit(d["top_p"]).cast("double").alias("top_p"),
                    F.lit(d["frequency_penalty"]).cast("double").alias("frequency_penalty"),
                    F.lit(d["presence_penalty"]).cast("double").alias("presence_penalty"),
                    F.lit(None).cast("array<string>").alias("stop"))


def chat_prompt(ctx: DataFrame, question_col: str = "question", context_col: str = "context",
                settings: dict | None = None) -> DataFrame:
    """+ messages ARRAY<STRUCT<role, content>>: a system message with the
    instruction and the context, a user message with the question; and a
    ``settings`` struct."""
    system = F.concat(F.lit(INSTRUCTION + "\n\nContext: "), F.col(context_col))
    user = F.concat(F.lit("Question: "), F.col(question_col))
    msgs = F.array(F.struct(F.lit("system").alias("role"), system.alias("content")),
                   F.struct(F.lit("user").alias("role"), user.alias("content")))
    return ctx.withColumn("messages", msgs).withColumn("settings", _settings(settings or CHAT_SETTINGS))


def completion_prompt(ctx: DataFrame, question_col: str = "question", context_col: str = "context",
                      settings: dict | None = None) -> DataFrame:
    """+ prompt: instruction, context, a rule, the question, 'Answer:'."""
    prompt = F.concat(F.lit(INSTRUCTION + "\n\nContext: "), F.col(context_col),
                      F.lit("\n\n---\n\nQuestion: "), F.col(question_col), F.lit("\nAnswer:"))
    return ctx.withColumn("prompt", prompt).withColumn(
        "settings", _settings(settings or COMPLETION_SETTINGS))


def _complete_all(complete_fn, calls: list) -> list[tuple[str, str | None]]:
    """(reply, error) of each call; a batch that fails is tried call by call."""
    def reply(r):
        return "" if not r else str(r)
    try:
        out = list(complete_fn(calls))
        if len(out) != len(calls):
            raise ValueError(f"{len(out)} replies to {len(calls)} prompts")
        return [(reply(r), None) for r in out]
    except Exception as ex:
        if len(calls) == 1:
            return [("", f"{type(ex).__name__}: {ex}")]
    return [_complete_all(complete_fn, [c])[0] for c in calls]


def answer(prompts: DataFrame, complete_fn=None, prompt_col: str = "prompt", with_settings: bool = False) -> DataFrame:
    """+ answer, answer_error: ``complete_fn`` gets a list of prompts and
    gives a list of replies. A prompt that fails, and only that one, has the
    answer '' and the error; an empty reply is ''; replies are stripped.

    ``prompt_col`` may hold texts or chat messages (a list of role/content
    dicts for each). With ``with_settings`` each item of the list is a pair
    of the prompt and its ``settings`` dict. Without ``complete_fn`` every
    answer is ''."""
    if complete_fn is None:
        return prompts.withColumn("answer", F.lit("")).withColumn("answer_error", F.lit(None).cast("string"))
    from pyspark.sql.functions import pandas_udf
    as_json = prompts.schema[prompt_col].dataType.typeName() != "string"
    body = F.to_json(F.col(prompt_col)) if as_json else F.coalesce(F.col(prompt_col), F.lit(""))
    settings = F.to_json("settings") if with_settings else F.lit("{}")

    @pandas_udf("struct<answer:string,error:string>")
    def _complete(body: pd.Series, settings: pd.Series) -> pd.DataFrame:
        import json
        calls = [json.loads(p) if as_json and p else p for p in body]
        if with_settings:
            calls = [(p, json.loads(s)) for p, s in zip(calls, settings)]
        return pd.DataFrame(_complete_all(complete_fn, calls), columns=["answer", "error"], dtype="object")

    done = prompts.withColumn("_reply", _complete(body, settings))
    return (done.withColumn("answer", py_strip(F.col("_reply.answer"))).withColumn("answer_error", F.col("_reply.error"))
            .drop("_reply"))
