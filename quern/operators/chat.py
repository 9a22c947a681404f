"""Prompts and chats: classification, flattening, payload rewriting, template wrapping, envelopes."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What a summary prompt, an action prompt and a compact action prompt say.
SUMMARY_SIGNALS = ("summary of this step:", "description for the before screenshot", "description for the after screenshot", "this is the action you picked:", "based on the reason:")
ACTION_SIGNALS = ("now output an action from the above list", "your answer should look like:", "reason: ...", 'action: {"action_type":...}', "here is a list of descriptions for some ui elements")
COMPACT_SIGNALS = ("androidworld", "action_type", "next androidworld action", "return exactly one action line")


def prompt_kind(prompt: Column) -> Column:
    """summarization, action_selection or other, by how many signals the prompt has."""
    low = F.lower(F.coalesce(prompt, F.lit("")))
    count = lambda signals: sum((low.contains(s).cast("int") for s in signals), F.lit(0))
    return F.when(count(SUMMARY_SIGNALS) >= 3, "summarization").when((count(ACTION_SIGNALS) >= 2) & low.contains("action_type") | (count(COMPACT_SIGNALS) >= 3), "action_selection").otherwise("other")


def flattened(turns: DataFrame, labels: bool = False) -> DataFrame:
    """(conv_id, prompt): turns in order as blocks of role and text.

    labels: "User: ..." lines with a closing "Assistant:", the second service's form. A chat is one
    prompt, so its turns are gathered; chats, not turns, are what grows.
    """
    head = F.concat(F.initcap("role"), F.lit(": ")) if labels else F.concat(F.upper("role"), F.lit(":\n"))
    block = F.concat(head, F.coalesce("text", F.lit("")))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("turn", "role", block.alias("b")))), lambda x: x["b"])
    joined = F.array_join(ordered, "\n" if labels else "\n\n")
    return turns.groupBy("conv_id").agg((F.concat(joined, F.lit("\nAssistant:")) if labels else joined).alias("prompt"))


PART = "struct<type:string,text:string,url:string>"


def request_parts(messages: Column) -> Column:
    """struct(text, images) of messages, an array of (role, parts): all texts parted by empty lines, and the image parts in order."""
    parts = F.flatten(F.transform(messages, lambda m: m["parts"]))
    texts = F.transform(F.filter(parts, lambda p: (p["type"] == "text") & (F.coalesce(p["text"], F.lit("")) != "")), lambda p: p["text"])
    return F.struct(F.regexp_replace(F.array_join(texts, "\n\n"), r"^\s+|\s+$", "").alias("text"), F.filter(parts, lambda p: p["type"] == "image_url").alias("images"))


def rewritten(payloads: DataFrame, question: Callable[[Column], Column], cap: int | None = 128) -> DataFrame:
    """payloads (messages, max_tokens): an action request becomes one user message, its question and its images.

    question makes the new text of the old one; an action request gets cap tokens at most, and cap
    itself if it names no number. Other requests stay as they are.
    """
    rows = payloads.withColumn("_parts", request_parts(F.col("messages"))).withColumn("_action", prompt_kind(F.col("_parts.text")) == "action_selection")
    text = F.struct(F.lit("text").alias("type"), question(F.col("_parts.text")).alias("text"), F.lit(None).cast("string").alias("url"))
    one = F.array(F.struct(F.lit("user").alias("role"), F.concat(F.array(text).cast(f"array<{PART}>"), F.col("_parts.images")).alias("parts")))
    tokens = F.col("max_tokens") if cap is None else F.when(F.col("_action"), F.least(F.coalesce("max_tokens", F.lit(cap)), F.lit(cap))).otherwise(F.col("max_tokens"))
    return rows.withColumns({"messages": F.when(F.col("_action"), one).otherwise(F.col("messages")), "max_tokens": tokens}).drop("_parts", "_action")


def wrapped(question: Column, style: str = "llama") -> Column:
    """A chat template around a question. The special tokens of two public model families."""
    if style == "llama":
        return F.concat(F.lit("<|start_header_id|>user<|end_header_id|> "), question, F.lit("<|eot_id|><|start_header_id|>assistant<|end_header_id|>"))
    return F.concat(F.lit("<|user|>\n"), question, F.lit("<|end|>\n<|assistant|>\n"))


def stripped(text: Column, tokens: tuple[str, ...] = ("<|eot_id|>", "<|start_header_id|>assistant<|end_header_id|>", "<|start_header_id|>user<|end_header_id|>", "<|end_of_text|>", "<|end|>", "<|assistant|>", "<|user|>")) -> Column:
    for t in tokens:
        text = F.replace(text, F.lit(t), F.lit(""))
    return text


def envelope(content: Column, model: str, created: Column, prompt_tokens: Column, completion_tokens: Column, key: Column | None = None, **metadata: Column) -> Column:
    """A chat completion as a struct; its id is 24 hex digits of key (the content, unless given), metadata stand at its end."""
    message = F.struct(F.lit("assistant").alias("role"), content.alias("content"))
    usage = F.struct(prompt_tokens.alias("prompt_tokens"), completion_tokens.alias("completion_tokens"), (prompt_tokens + completion_tokens).alias("total_tokens"))
    choice = F.struct(F.lit(0).alias("index"), message.alias("message"), F.lit("stop").alias("finish_reason"))
    name = F.concat(F.lit("chatcmpl-"), F.left(F.md5(content if key is None else key), F.lit(24)))
    extra = [v.alias(k) for k, v in metadata.items()]
    return F.struct(name.alias("id"), F.lit("chat.completion").alias("object"), created.alias("created"), F.lit(model).alias("model"), F.array(choice).alias("choices"), usage.alias("usage"), *extra)


def error_envelope(message: Column, code: Column | None = None, param: Column | None = None, kind: str = "invalid_request_error") -> Column:
    """An error as a struct with the one field error."""
    none = F.lit(None).cast("string")
    return F.struct(F.struct(message.alias("message"), F.lit(kind).alias("type"), (none if param is None else param).alias("param"), (none if code is None else code).alias("code")).alias("error"))


def truncated(tokens: Column, answer_start: Column, most: int) -> Column:
    """A token array cut to most tokens so that the answer, from answer_start (0-based) on, stays whole."""
    answer = F.size(tokens) - answer_start
    start = F.greatest(F.lit(0), answer_start - F.greatest(F.lit(0), F.lit(most) - answer))
    return F.when(F.size(tokens) <= most, tokens).otherwise(F.slice(tokens, start + 1, F.lit(most)))
