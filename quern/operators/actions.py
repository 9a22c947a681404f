"""Recorded actions: conversion to index actions, validation with typed errors, JSON text, reasons."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.functions.text import collapse

#: Action types, directions and statuses.
ACTION_TYPES = ("status", "answer", "click", "long_press", "input_text", "keyboard_enter", "navigate_home", "navigate_back", "scroll", "open_app", "wait")
DIRECTIONS = ("up", "down", "left", "right")
STATUSES = ("complete", "infeasible")
NO_ARGUMENT = ("keyboard_enter", "navigate_home", "navigate_back", "wait")
#: The fields each type may have, besides action_type.
FIELDS = {"click": ("idx", "x", "y"), "long_press": ("idx", "x", "y"), "input_text": ("idx", "text"), "scroll": ("direction", "idx"), "open_app": ("app_name",), "answer": ("text",), "status": ("goal_status",)}
ARGUMENTS = ("idx", "x", "y", "text", "direction", "app_name", "goal_status")


def convert(rows: DataFrame, point_index: Column | None = None, field_index: Column | None = None) -> DataFrame:
    """Raw actions (columns action_type and ARGUMENTS) to index actions, with conversion_error.

    point_index: index of the element at (x, y); field_index: of the best text field. What can't
    be converted becomes an infeasible status, and says why.
    """
    kind = F.col("action_type")
    point = F.lit(None).cast("bigint") if point_index is None else point_index
    place = F.lit(None).cast("bigint") if field_index is None else field_index
    has_xy = F.col("x").isNotNull() & F.col("y").isNotNull()
    is_point = kind.isin("click", "long_press")
    at = F.coalesce("idx", F.when(has_xy, point).otherwise(F.when(kind == "input_text", place)))
    error = (
        F.when(is_point & F.col("idx").isNull() & ~has_xy, F.concat(kind, F.lit(" requires index or both x and y.")))
        .when(is_point & at.isNull(), F.concat(kind, F.lit(" point ("), F.col("x").cast("string"), F.lit(", "), F.col("y").cast("string"), F.lit(") did not map to a visible UI element.")))
        .when((kind == "input_text") & F.col("text").isNull(), "input_text requires text.")
        .when((kind == "input_text") & at.isNull(), "input_text could not find a visible editable UI element index.")
        .when((kind == "scroll") & ~F.coalesce(F.col("direction").isin(*DIRECTIONS), F.lit(False)), "scroll requires direction in up/down/left/right.")
        .when((kind == "open_app") & (F.btrim(F.coalesce("app_name", F.lit(""))) == ""), "open_app requires a non-empty app_name.")
        .when((kind == "answer") & (F.btrim(F.coalesce("text", F.lit(""))) == ""), "answer requires non-empty text.")
        .when((kind == "status") & ~F.coalesce(F.col("goal_status").isin(*STATUSES), F.lit(False)), "status requires goal_status complete or infeasible.")
        .when(~F.coalesce(kind.isin(*ACTION_TYPES), F.lit(False)), F.concat(F.lit("Unsupported action_type: "), F.coalesce(F.concat(F.lit("'"), kind, F.lit("'")), F.lit("None")), F.lit(".")))
    )
    rows = rows.withColumn("conversion_error", error).withColumn("_at", at)
    ok = F.col("conversion_error").isNull()
    keep = lambda c, *kinds: F.when(ok & kind.isin(*kinds), F.col(c))
    return rows.select(
        *[c for c in rows.columns if c not in ("action_type", "conversion_error", "_at", *ARGUMENTS)],
        "conversion_error",
        F.when(ok, kind).otherwise("status").alias("action_type"),
        F.when(ok & (is_point | (kind == "input_text")), F.col("_at")).when(ok & (kind == "scroll"), F.col("idx")).alias("idx"),
        keep("text", "input_text", "answer").alias("text"),
        keep("direction", "scroll").alias("direction"),
        keep("app_name", "open_app").alias("app_name"),
        F.when(ok, F.when(kind == "status", F.col("goal_status"))).otherwise("infeasible").alias("goal_status"),
    )


def error_code(visible: Column | None = None, index_only: bool = False) -> Column:
    """The first rule that the action in columns action_type and ARGUMENTS breaks; null if it is valid.

    visible: array of the screen's indices, null for unknown. index_only: points must be indices.
    """
    kind = F.col("action_type")
    has = lambda c: F.col(c).isNotNull()
    extra = F.lit(False)
    for c in ARGUMENTS:
        allowed = [k for k, fields in FIELDS.items() if c in fields]
        extra |= has(c) & ~kind.isin(*allowed)
    point = kind.isin("click", "long_press")
    indexed = kind.isin("click", "long_press", "input_text", "scroll") & has("idx")
    blank = lambda c: F.btrim(F.col(c)) == ""
    missing = (point & ~has("idx") & ~(has("x") & has("y"))) | ((kind == "input_text") & ~(has("idx") & has("text"))) | ((kind == "scroll") & ~has("direction")) | ((kind == "open_app") & ~has("app_name")) | ((kind == "answer") & ~has("text")) | ((kind == "status") & ~has("goal_status"))
    out = (
        F.when(kind.isNull() | (kind == ""), "missing_action_type")
        .when(~kind.isin(*ACTION_TYPES), "unsupported_action_type")
        .when(extra, "unsupported_action_field")
        .when(point & has("idx") & (has("x") | has("y")), "conflicting_action_fields")
        .when(missing, "missing_action_field")
        .when(((kind == "scroll") & ~F.col("direction").isin(*DIRECTIONS)) | ((kind == "status") & ~F.col("goal_status").isin(*STATUSES)), "invalid_action_enum")
        .when(indexed & (F.col("idx") < 0), "invalid_action_field")
        .when(((kind == "open_app") & blank("app_name")) | ((kind == "answer") & blank("text")), "invalid_action_field")
    )
    if visible is not None:
        out = out.when(indexed & visible.isNotNull() & ~F.array_contains(visible, F.col("idx")), "index_out_of_range")
    return out.when(point & ~has("idx"), "missing_index_action") if index_only else out


def parsed_index(value: Column) -> Column:
    """An index from text: digits with white space around, else null."""
    return F.when(value.rlike(r"^\s*[0-9]+\s*$"), F.btrim(value).try_cast("bigint"))


def action_json() -> Column:
    """Compact JSON of the action, fields in order, nulls left out."""
    return F.to_json(F.struct("action_type", F.col("idx").alias("index"), "text", "direction", "app_name", "goal_status"))


def json_string(c: Column) -> Column:
    """A text as a JSON string."""
    whole = F.to_json(F.struct(c.alias("v")))
    return F.when(c.isNotNull(), F.substr(whole, F.lit(6), F.length(whole) - 6))


def history_json() -> Column:
    """JSON of the action as histories show it: fields in order of their names, blanks after commas and colons."""
    said = lambda name, value: F.concat(F.lit(f'"{name}": '), value)
    fields = [said(c, json_string(F.col(c))) for c in ("action_type", "app_name", "direction", "goal_status")]
    return F.concat(F.lit("{"), F.concat_ws(", ", *fields, said("index", F.col("idx").cast("string")), said("text", json_string(F.col("text")))), F.lit("}"))


#: What an action is called while it is done, by type.
PHRASES = {
    "keyboard_enter": "pressing Enter after text input",
    "navigate_home": "navigating to the home screen",
    "navigate_back": "navigating back",
    "wait": "waiting for the screen to update",
    "answer": "answering the user",
}


def phrase() -> Column:
    """What the action does, in the progressive form."""
    kind, index = F.col("action_type"), F.col("idx").cast("string")
    cat = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])
    element = F.concat(F.lit(" UI element "), F.coalesce(index, F.lit("None")))
    scrolled = cat("scrolling ", collapse(F.col("direction"), "the needed direction"))
    plain = F.coalesce(*[F.when(kind == k, said) for k, said in PHRASES.items()], F.lit("choosing the next action"))
    return (
        F.when(kind == "open_app", cat("opening ", collapse(F.col("app_name"), "the requested app")))
        .when(kind == "click", cat("tapping", element))
        .when(kind == "long_press", cat("long pressing", element))
        .when(kind == "input_text", cat("typing ", collapse(F.col("text"), "the requested text"), " into", element))
        .when(kind == "scroll", F.when(F.col("idx").isNotNull(), cat(scrolled, " on", element)).otherwise(scrolled))
        .when(kind == "status", cat("marking the task ", collapse(F.col("goal_status"), "complete")))
        .otherwise(plain)
    )


def reason(task: Column) -> Column:
    """One sentence by type; task: what the step is for. conversion_error explains an infeasible status."""
    index = F.col("idx").cast("string")
    app, text, way = collapse(F.col("app_name"), "the requested app"), collapse(F.col("text"), "the requested text"), collapse(F.col("direction"), "down")
    cat = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])
    kind = F.col("action_type")
    return (
        F.when(kind == "open_app", cat("The task requires ", app, ", so I should open that app."))
        .when(kind == "wait", "The previous action may need time to update the screen, so I should wait.")
        .when(kind == "click", cat("The next step is to select the relevant visible UI element at index ", index, "."))
        .when(kind == "long_press", cat("The next step requires a long press on the relevant visible UI element at index ", index, "."))
        .when(kind == "input_text", cat("The target text field at index ", index, " needs ", text, ", so I should enter it there."))
        .when(kind == "keyboard_enter", "The text has been entered, so I should press Enter to submit it.")
        .when(kind == "navigate_home", "The next step requires returning to the Android home screen.")
        .when(kind == "navigate_back", "The current screen is not the needed destination, so I should go back.")
        .when((kind == "scroll") & F.col("idx").isNotNull(), cat("The needed item is not visible yet, so I should scroll ", way, " on UI element ", index, "."))
        .when(kind == "scroll", cat("The needed item is not visible yet, so I should scroll ", way, "."))
        .when((kind == "status") & (F.col("goal_status") == "complete"), "The recorded episode has reached its final state, so the task is complete.")
        .when((kind == "status") & F.col("conversion_error").isNotNull(), cat("The recorded target action could not be converted into a valid AndroidWorld action because ", collapse(F.col("conversion_error"))))
        .when(kind == "status", "The required action cannot be safely performed from this state.")
        .when(kind == "answer", "The requested information is available, so I should answer the user directly.")
        .otherwise(cat("This action is the next recorded step for ", collapse(task, "the current task"), "."))
    )


def past_summary() -> Column:
    """What the action did, in the past tense."""
    kind, index = F.col("action_type"), F.col("idx").cast("string")
    cat = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])
    way = collapse(F.col("direction"), "a direction")
    return (
        F.when(kind == "open_app", cat("opened ", collapse(F.col("app_name"), "an app")))
        .when(kind == "click", cat("clicked UI element ", index))
        .when(kind == "long_press", cat("long pressed UI element ", index))
        .when(kind == "input_text", cat("typed text into UI element ", index))
        .when((kind == "scroll") & F.col("idx").isNotNull(), cat("scrolled ", way, " in UI element ", index))
        .when(kind == "scroll", cat("scrolled ", way))
        .when(kind == "status", cat("marked the goal ", collapse(F.col("goal_status"), "done")))
        .when(kind == "answer", "answered the user")
        .when(kind != "", F.replace(kind, F.lit("_"), F.lit(" ")))
        .otherwise("selected an action")
    )
