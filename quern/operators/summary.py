"""Summaries of question/key/value rows and of actions before and after their conversion."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.compat import or_default
from quern.operators.episodes import parsed_name
from quern.operators.outputs import with_normalized
from quern.operators.stats import tallied, value_profile


def with_action(rows: DataFrame) -> DataFrame:
    """Adds parsed(episode, step, suffix) of the name and output(reason, action, error) of the description, else of A."""
    return with_normalized(rows.withColumns({"parsed": parsed_name(F.col("name")), "_said": or_default(F.col("description"), or_default(F.col("A"), ""))}), "_said").drop("_said")


def synthetic_kinds(suffix: Column) -> Column:
    """Which kinds of made rows a name's suffix tells of (array); one row may be of several."""
    kinds = (
        ("keyboard_enter_after_input_text", suffix.contains("keyboard_enter_after_input_text")),
        ("terminal_complete", suffix.contains("terminal_complete") | suffix.endswith("status_complete")),
        ("invalid_action_to_infeasible", suffix.endswith("infeasible")),
    )
    return F.array_compact(F.array(*[F.when(ok, kind) for kind, ok in kinds]))


def _field(json: Column, name: str) -> Column:
    return or_default(F.get_json_object(json, f"$.{name}"), "missing")


def qkv_summary(acted: DataFrame) -> DataFrame:
    """(section, key, n) of with_action rows: rows, episodes, description_type, action_type, status_goal, synthetic.

    An output that isn't a valid action is "malformed" and has no goal. One pass counts all: each episode is a
    key first, and the keys are counted after.
    """
    action, failed = F.col("output.action"), F.col("output.error").isNotNull()
    kind = F.when(failed, "malformed").otherwise(_field(action, "action_type"))
    none = acted.sparkSession.createDataFrame([("episodes", "total", 0)], "section string, key string, n bigint")
    counts = tallied(
        acted,
        rows=F.array(F.lit("total")),
        description_type=F.array(or_default(F.col("description_type"), "missing")),
        action_type=F.array(kind),
        status_goal=F.array(F.when(kind == "status", _field(action, "goal_status"))),
        synthetic=synthetic_kinds(F.col("parsed.suffix")),
        episodes=F.array("parsed.episode"),
    )
    each = F.col("section") == "episodes"
    counts = counts.select("section", F.when(each, "total").otherwise(F.col("key")).alias("key"), F.when(each, 1).otherwise(F.col("n")).alias("n"))
    return none.unionByName(counts).groupBy("section", "key").agg(F.sum("n").alias("n"))


def malformed_rows(acted: DataFrame, most: int = 20) -> DataFrame:
    """(name, error) of the first rows by name whose output isn't a valid action; a report, so it has an end."""
    return acted.filter("output.error is not null").select("name", F.col("output.error").alias("error")).orderBy("name", "error").limit(most)


def original_steps(acted: DataFrame) -> DataFrame:
    """(episode, step): the recorded steps that the rows come from, each once."""
    # A filter would be pushed below the names and make each of them again.
    known = F.filter(F.array(F.struct("parsed.episode", "parsed.step")), lambda p: p["step"].isNotNull())
    return acted.select(F.inline(known)).distinct()


def action_report(rows: DataFrame) -> DataFrame:
    """(section, key, field, type, n): actions before and after conversion, their validity and errors, their fields.

    rows: original and converted (JSON objects), conversion_error, error (of the converted action).
    field and type are null but in the two sections of fields.
    """
    counts = tallied(
        rows,
        original_action_type=F.array(_field(F.col("original"), "action_type")),
        converted_action_type=F.array(_field(F.col("converted"), "action_type")),
        validity=F.array(F.when(F.col("error").isNull(), "valid").otherwise("invalid")),
        conversion_error=F.array("conversion_error"),
    ).select("section", "key", F.lit(None).cast("string").alias("field"), F.lit(None).cast("string").alias("type"), "n")
    for side in ("original", "converted"):
        fields = value_profile(rows, F.get_json_object(side, "$.action_type"), F.col(side))
        counts = counts.unionByName(fields.select(F.lit(f"{side}_fields").alias("section"), "key", "field", "type", "n"))
    return counts
