"""Episode logic: history, next and previous steps, synthetic rows, question/key/value rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from quern.compat import or_default
from quern.functions.text import collapse, completed_goal_phrase, goal_phrase, last_instruction, safe_name, truncate, with_phrases
from quern.operators.actions import action_json, history_json, past_summary, reason
from quern.operators.screens import question

STARTED = "You just started, no action has been performed yet."
#: How many steps a compact history shows whole, how many parts stand for the older ones,
#: and the characters of a part and of all parts.
RECENT, PARTS, PART_CHARS, ALL_CHARS = 5, 5, 80, 360
#: Fixed value: the reason of an action that can't be used.
UNUSABLE = "The recorded target action could not be converted into a valid index-based AndroidWorld action, so the task should be marked infeasible."


def by_step() -> WindowSpec:
    """Steps of an episode in order."""
    return Window.partitionBy("episode_id").orderBy("step_index")


def before() -> WindowSpec:
    """All earlier steps of the episode."""
    return by_step().rowsBetween(Window.unboundedPreceding, -1)


def with_lines(steps: DataFrame, teacher: DataFrame | None = None) -> DataFrame:
    """Adds step_line, the step's line in a history, and summary, what stands for it once it is old.

    teacher (episode_id, step_index, line): its text stands in for the derived one.
    """
    line = F.concat(F.lit("Action selected: "), history_json(), F.lit("."), F.when(F.coalesce("instruction", F.lit("")) != "", F.concat(F.lit(" Instruction: "), F.col("instruction"), F.lit("."))).otherwise(""))
    told = truncate(F.col("instruction"), PART_CHARS)
    summary = F.when(told != "", told).otherwise(truncate(past_summary(), PART_CHARS))
    number = F.concat(F.lit("Step "), (F.col("step_index") + 1).cast("string"), F.lit(": "))
    if teacher is None:
        return steps.withColumns({"step_line": F.concat(number, line), "summary": summary})
    rows = steps.join(teacher.select("episode_id", "step_index", F.col("line").alias("_line")), ["episode_id", "step_index"], "left")
    own = F.concat(number, F.col("_line"))
    return rows.withColumns({"step_line": F.coalesce(own, F.concat(number, line)), "summary": F.coalesce(truncate(own, PART_CHARS), summary)}).drop("_line")


def with_history(steps: DataFrame, teacher: DataFrame | None = None) -> DataFrame:
    """Adds previous_instruction and history, the numbered lines of all earlier steps (array).

    The lines themselves are the result, so it grows with the square of an episode; a question needs
    with_compact_history only, which doesn't.
    """
    lined = with_lines(steps, teacher)
    return lined.withColumns({"history": F.collect_list("step_line").over(before()), "previous_instruction": F.lag("instruction").over(by_step())})


def history_text(history: Column) -> Column:
    return F.when(F.size(history) > 0, F.array_join(history, "\n")).otherwise(STARTED)


def _compact(count: Column, recent: list[Column], parts: list[Column], heads: list[Column], first: Column, last: Column) -> Column:
    """A compact history of count lines.

    recent: the last RECENT lines, parts: the PARTS summaries before them, both in order and null where
    there is none; heads: the first three summaries; first and last: numbers of the first and last
    older step.
    """
    many = F.array(*heads, F.lit("..."), *parts[-2:])
    told = truncate(F.array_join(F.when(count > RECENT + PARTS, many).otherwise(F.array(*parts)), "; "), ALL_CHARS)
    shown = F.concat_ws("\n", *recent)
    earlier = F.concat(F.lit("Earlier steps "), first.cast("string"), F.lit("-"), last.cast("string"), F.lit(": "), told, F.lit(".\n"))
    return F.when(count == 0, STARTED).when(count <= RECENT, shown).otherwise(F.concat(earlier, shown))


def with_compact_history(lined: DataFrame, appended: Column | None = None) -> DataFrame:
    """Adds to with_lines' rows compact, the compact history of the earlier steps.

    appended, this step's own line: also adds compact_after, the history with that line. Only the
    lines and summaries around a step and at its episode's start are looked at, so the work is
    linear in the steps.
    """
    w = by_step()
    lag = lambda c, k: F.lag(c, k).over(w)
    seen = {f"_l{k}": lag("step_line", k) for k in range(1, RECENT + 1)}
    seen |= {f"_s{k}": lag("summary", k) for k in range(RECENT, RECENT + PARTS + 1)}
    seen |= {f"_n{k}": lag("step_index", k) + 1 for k in (RECENT, RECENT + 1)}
    seen |= {f"_h{k}": F.nth_value("summary", k).over(w) for k in (1, 2, 3)}
    seen |= {"_count": F.row_number().over(w) - 1, "_first": F.first("step_index").over(w) + 1}
    rows = lined.withColumns(seen)
    lines = lambda since, until: [F.col(f"_l{k}") for k in range(since, until - 1, -1)]
    parts = lambda since: [F.col(f"_s{k}") for k in range(since + PARTS - 1, since - 1, -1)]
    heads = [F.col(f"_h{k}") for k in (1, 2, 3)]
    out = {"compact": _compact(F.col("_count"), lines(RECENT, 1), parts(RECENT + 1), heads, F.col("_first"), F.col(f"_n{RECENT + 1}"))}
    if appended is not None:
        out["compact_after"] = _compact(F.col("_count") + 1, [*lines(RECENT - 1, 1), appended], parts(RECENT), heads, F.col("_first"), F.col(f"_n{RECENT}"))
    return rows.withColumns(out).drop(*seen)


def history_phrase(previous: Column, history: Column) -> Column:
    """What was done before, from the previous step's instruction or else from a history's text.

    The last instruction in the history counts; without any, what the history tells besides its
    actions and numbers.
    """
    told = F.coalesce(F.when(previous != "", previous), last_instruction(history))
    bare = F.rtrim(F.btrim(or_default(history, STARTED)), F.lit(" ."))
    rest = bare
    for pattern in (r"(?s)Action selected:\s*\{.*?\}\.?", r"\bStep\s+[0-9]+:\s*", r"\bInstruction:\s*"):
        rest = F.regexp_replace(rest, pattern, "")
    rest = or_default(F.btrim(collapse(rest), F.lit(" .")), "previous recorded actions")
    return F.when(told != "", completed_goal_phrase(told)).when(bare == STARTED.rstrip("."), "no previous actions").otherwise(rest)


def key_string(task: Column, done: Column) -> Column:
    """task: the step's instruction, else the goal; done: a phrase such as history_phrase gives."""
    return _key(goal_phrase(task), done)


def _key(doing: Column, done: Column) -> Column:
    return F.concat(F.lit("For the AndroidWorld goal of "), doing, F.lit(", after "), done, F.lit(", the current screen shows the visible UI elements, and the next action should be"))


def _unusable(reason_: Column, action: Column) -> Column:
    """Whether a description of these would not be read back as one reason and one action."""
    marks = F.size(F.regexp_extract_all(F.concat(reason_, F.lit("\nAction: "), action), F.lit(r"(?i)\bAction\s*:\s*"), F.lit(0)))
    return (marks != 1) | reason_.rlike(r"[{}]|(?i)\bReason\s*:")


def qkv_rows(steps: DataFrame, skip_invalid: bool = False, keyboard_enter: bool = True, terminal: bool = True) -> DataFrame:
    """Question/key/value rows of converted steps (columns goal, instruction, ui, and invalid: an error code or null).

    A row a step, then a keyboard row after each usable text input, and a completing row after each
    episode's last step. A keyboard row stands on the next step's screen, if there is one. An unusable
    action is skipped, or becomes an infeasible status. One window by episode serves all of it, and one
    generator makes the rows, so the steps are read and sorted once.
    """
    w = by_step()
    own = F.concat(F.lit("Step "), (F.col("step_index") + 1).cast("string"), F.lit(": Action selected: "), action_json(), F.lit("."), F.when(F.coalesce("instruction", F.lit("")) != "", F.concat(F.lit(" Instruction: "), collapse(F.col("instruction")), F.lit("."))).otherwise(""))
    told = F.when(F.col("instruction") != "", F.col("instruction"))
    # All texts of a step are made before the window, what stands around it is put together after.
    rows = with_lines(steps).withColumns({"_own": own, "_json": action_json(), "_reason": collapse(reason(F.coalesce(told, F.col("goal"))))})
    rows = with_phrases(with_phrases(rows, F.coalesce(told, F.col("goal")), "_doing"), F.col("goal"), "_doing_goal")
    rows = with_phrases(rows, told, done="_done").withColumn("_done", F.when(told.isNotNull(), F.col("_done")))
    rows = rows.withColumn("_bad", F.col("invalid").isNotNull() | _unusable(F.col("_reason"), F.col("_json")))
    rows = with_compact_history(rows, F.col("_own"))
    rows = rows.withColumns({"_prior": F.last("_done", ignorenulls=True).over(before()), "_start": F.row_number().over(w) == 1, "_next": F.lead("step_index").over(w).isNotNull()})
    rows = rows.withColumns({f"_next_{c}": F.lead(c).over(w) for c in ("goal", "ui", "compact", "_doing_goal")})
    ahead = lambda c, own: F.when(F.col("_next"), F.col(f"_next_{c}")).otherwise(F.col(own))
    rows = rows.withColumns({"_goal": ahead("goal", "goal"), "_ui": ahead("ui", "ui"), "_history": ahead("compact", "compact_after"), "_doing_next": F.when(told.isNotNull(), F.col("_doing")).otherwise(ahead("_doing_goal", "_doing_goal"))})
    recorded = F.lit("previous recorded actions")
    past = F.coalesce("_prior", F.when(F.col("_start"), "no previous actions").otherwise(recorded))
    past_after = F.coalesce("_done", "_prior", recorded)
    kind, step = F.col("action_type"), F.col("step_index").cast("string")

    # A made row differs from a step's own by its mark alone until here, so what a caller drops is never made.
    bad, mark = F.col("_bad"), F.col("synthetic")
    marks = [F.when(~bad, "no") if skip_invalid else F.lit("no")]
    marks += [F.when(~bad & (kind == "input_text"), "keyboard")] if keyboard_enter else []
    marks += [F.when(~F.col("_next"), "terminal")] if terminal else []
    rows = rows.withColumn("synthetic", F.explode(F.array_compact(F.array(*marks))))

    def told_by(no: Column, typed: Column, last: Column) -> Column:
        return F.when(mark == "no", no).when(mark == "keyboard", typed).otherwise(last)

    name = F.concat(
        F.lit("aw_"), safe_name(F.col("episode_id"), "episode"), F.lit("_"), step,
        told_by(F.concat(F.lit("_"), safe_name(kind), F.when(bad, "_infeasible").otherwise("")), F.lit("_keyboard_enter_keyboard_enter_after_input_text"), F.lit("_terminal_complete_status_complete")),
    )
    out = rows.select(
        "episode_id", "step_index", "synthetic", name.alias("name"), "conversion_error", bad.alias("invalid"),
        told_by(F.when(bad, UNUSABLE).otherwise(F.col("_reason")), F.lit("The text has been entered, so I should press Enter to submit it."), F.lit("The recorded episode has reached its final state, so the task is complete.")).alias("reason"),
        told_by(F.when(bad, '{"action_type":"status","goal_status":"infeasible"}').otherwise(F.col("_json")), F.lit('{"action_type":"keyboard_enter"}'), F.lit('{"action_type":"status","goal_status":"complete"}')).alias("action"),
        told_by(F.col("goal"), F.col("_goal"), F.col("goal")).alias("g"),
        told_by(F.col("compact"), F.col("_history"), F.col("compact_after")).alias("h"),
        told_by(F.col("ui"), F.col("_ui"), F.col("ui")).alias("u"),
        told_by(_key(F.col("_doing"), past), _key(F.col("_doing_next"), past_after), _key(F.col("_doing"), past_after)).alias("key_string"),
    )
    text = F.concat(F.lit("Reason: "), F.col("reason"), F.lit("\nAction: "), F.col("action"))
    return out.select(
        "episode_id", "step_index", "synthetic", "name", F.lit("next AndroidWorld action").alias("description_type"), "reason", text.alias("description"), question(F.col("g"), F.col("h"), F.col("u")).alias("Q"), text.alias("A"),
        "key_string", F.lit("").alias("extended_Q"), F.lit("").alias("extended_A"), "conversion_error", "invalid",
    )


def goal_of_step(by_instruction: bool) -> Column:
    """What a step's question asks for: the episode's goal, or the step's instruction where it has one."""
    return F.coalesce("instruction", "goal") if by_instruction else F.col("goal")


def parsed_name(name: Column) -> Column:
    """struct(episode, step, suffix) of a row's name; the episode is "unknown" if it doesn't match."""
    pattern = r"^aw_(.*)_([0-9]+)(?:_(.*))?$"
    ok = name.rlike(pattern)
    episode = F.regexp_extract(name, pattern, 1)
    return F.struct(F.when(ok & (episode != ""), episode).otherwise("unknown").alias("episode"), F.when(ok, F.regexp_extract(name, pattern, 2)).cast("bigint").alias("step"), F.when(ok, F.regexp_extract(name, pattern, 3)).otherwise("").alias("suffix"))


def qkv_counts(rows: DataFrame) -> DataFrame:
    """Counts of one pass: rows, real, keyboard, terminal, invalid, conversion errors, episodes."""
    n = lambda c: F.count_if(c)
    return rows.agg(
        F.count("*").alias("qkv_rows"),
        n(F.col("synthetic") == "no").alias("prompt_rows"),
        n(F.col("synthetic") == "keyboard").alias("keyboard_enter_rows"),
        n(F.col("synthetic") == "terminal").alias("terminal_rows"),
        n(F.col("invalid") & (F.col("synthetic") == "no")).alias("invalid_actions"),
        n(F.col("conversion_error").isNotNull() & (F.col("synthetic") == "no")).alias("conversion_error_rows"),
        F.countDistinct("episode_id").alias("episodes"),
    )
