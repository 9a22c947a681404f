"""Screen listings: trees to elements, what is worth showing, compact lines, questions about a screen."""

from __future__ import annotations

import ast
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.compat import or_default
from quern.functions.text import collapse, compact_text, compacted, is_semantic_resource, q_sections, readable, short_class
from quern.operators.geometry import package_kind, with_region

TEXTS = ("text", "content_description", "hint_text")
FLAGS = ("is_checked", "is_clickable", "is_editable", "is_scrollable", "is_selected")
#: Classes that hold others, the longest static text, and what a screen without elements says.
GENERIC_CLASSES = ("FrameLayout", "ImageView", "LinearLayout", "RelativeLayout", "RecyclerView", "View", "ViewGroup")
MAX_STATIC = 64
NO_ELEMENTS = "No UI element details were found."


def flatten_trees(forests: DataFrame, visible_only: bool = True) -> DataFrame:
    """(screen, idx, node): leaf, described or scrollable nodes of every window's tree, numbered after filtering.

    forests: (screen, windows array<struct<nodes: array<struct<child_ids, content_description, is_scrollable, is_visible, ...>>>>).
    """
    nodes = forests.select("screen", F.posexplode("windows").alias("_w", "window")).select("screen", "_w", F.posexplode("window.nodes").alias("_n", "node"))
    keep = (F.coalesce(F.size("node.child_ids"), F.lit(0)) == 0) | (F.coalesce("node.content_description", F.lit("")) != "") | F.coalesce("node.is_scrollable", F.lit(False))
    if visible_only:
        keep &= F.coalesce("node.is_visible", F.lit(False))
    w = Window.partitionBy("screen").orderBy("_w", "_n")
    return nodes.filter(keep).select("screen", (F.row_number().over(w) - 1).cast("bigint").alias("idx"), "node")


def _is(c: str) -> Column:
    return F.coalesce(F.col(c), F.lit(False))


def informative() -> Column:
    """Whether an element tells something: seven rules, in order."""
    return _informative([compact_text(F.col(c)) for c in TEXTS], is_semantic_resource(F.col("resource_name")), collapse(F.col("text")))


def _informative(texts: list[Column], own_name: Column, full: Column) -> Column:
    """texts: the compact ones of TEXTS, own_name: a semantic resource, full: the whole text collapsed."""
    body, description, hint = texts
    some_text = F.coalesce(*texts).isNotNull()
    words = F.size(F.regexp_extract_all(full, F.lit("[A-Za-z0-9]+"), F.lit(0)))
    wordy = (words >= 10) | ((words >= 7) & full.rlike("[a-z]") & full.rlike("[.,;:]$"))
    flagged = F.greatest(*[_is(c).cast("int") for c in FLAGS]) == 1
    static = body.isNotNull() & (short_class(F.col("class_name")) == "TextView") & ~flagged & description.isNull() & hint.isNull() & ~own_name & ((F.length(full) > MAX_STATIC) | wordy)
    generic = short_class(F.col("class_name")).isin(*GENERIC_CLASSES) & ~some_text & ~own_name
    return (
        F.when(F.coalesce(static, F.lit(False)), False)
        .when(some_text | _is("is_editable") | _is("is_scrollable") | _is("is_checked") | _is("is_selected"), True)
        .when(_is("is_clickable") & ~F.coalesce(generic, F.lit(False)), True)
        .when(~F.coalesce(F.col("is_enabled"), F.lit(True)), True)
        .otherwise(own_name)
    )


#: What a line of a listing is kept for, names that say nothing, and packages whose lines are noise.
LINE_TEXTS = ("text", "content_description", "hint_text", "tooltip")
LINE_FLAGS = ("is_checkable", "is_clickable", "is_editable", "is_focusable", "is_scrollable", "is_selected", "is_checked", "is_focused", "is_long_clickable")
GENERIC_RESOURCES = ("container", "content", "decor_view", "navigationBarBackground", "status_bar_launch_animation_container", "wifi_signal")
NOISY_PACKAGES = ("com.android.systemui",)


def line_field(line: Column, name: str) -> Column:
    """A field's value in a line, name='value' or else "name": "value"; empty without one, or if it is none or false."""
    python = F.regexp_extract(line, rf"""\b{name}=('(?:\\'|[^'])*'|"(?:\\"|[^"])*"|None|True|False)""", 1)
    json = F.regexp_extract(line, rf"""\"{name}":\s*("(?:\\"|[^"])*"|null|true|false)""", 1)
    raw = F.when(python != "", python).otherwise(json)
    return F.when(raw.isin("None", "False", "null", "false"), "").when(raw == "true", "True").otherwise(F.regexp_replace(raw, r"""^['"]|['"]$""", ""))


def line_flag(line: Column, name: str) -> Column:
    """Whether a line says that a flag is set: name=True, "name": true, or its bare name."""
    return line.rlike(rf"""\b{name}=True\b|"{name}":\s*true\b|\b{name}\b(?=\s*[,)])""")


def is_informative_line(line: Column) -> Column:
    """Whether a line has a text, a flag that is set, or a name of its own."""
    resource = line_field(line, "resource_name")
    told = F.greatest(*[F.length(line_field(line, c)) for c in LINE_TEXTS]) > 0
    flagged = F.greatest(*[line_flag(line, c).cast("int") for c in LINE_FLAGS]) == 1
    return told | flagged | ((resource != "") & ~F.element_at(F.split(resource, "/"), -1).isin(*GENERIC_RESOURCES))


def informative_lines(listing: Column, include_system: bool = False) -> Column:
    """A listing's lines that tell something; those of the system's own surface go unless they are asked for."""
    lines = F.filter(F.split(listing, r"\r\n|[\n\r]"), lambda x: (F.btrim(x) != "") & is_informative_line(x))
    kept = lines if include_system else F.filter(lines, lambda x: ~line_field(x, "package_name").isin(*NOISY_PACKAGES))
    return F.array_join(kept, "\n")


def quoted(c: Column) -> Column:
    """A text in quotes, as the listings show it: single ones unless only single ones stand in it."""
    single = F.concat(F.lit("'"), F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit("'"), F.lit("\\'")), F.lit("'"))
    return F.when(c.contains("'") & ~c.contains('"'), F.concat(F.lit('"'), F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit('"'))).otherwise(single)


def with_arguments(elements: DataFrame) -> DataFrame:
    """Adds args, what a compact line says of an element: texts, class, place, flags, package if not the main one."""
    return _with_arguments(_with_compact(elements).withColumn("_shown", F.lit(True))).drop("_shown")


def _with_compact(elements: DataFrame) -> DataFrame:
    """Adds the compact texts as _c_ columns: each text is cleaned once, however often a rule asks for it."""
    rows = elements.withColumns({f"_c_{c}": readable(F.col(c)) for c in TEXTS})
    return rows.withColumns({f"_c_{c}": compacted(F.col(f"_c_{c}")) for c in TEXTS})


def _with_arguments(rows: DataFrame) -> DataFrame:
    """The rows of _with_compact that are _shown, with args; what isn't shown has no part in extent and main package.

    Windows by screen serve both, so the rows are dealt out once. The filter stands behind a window, or
    it would be evaluated again below every column.
    """
    w = Window.partitionBy("screen")
    kind = package_kind(F.col("package"))
    rows = rows.withColumn("_kind", kind).withColumn("_own", F.col("_shown") & (F.col("package") != "") & F.col("_kind").isNull())
    rows = rows.withColumn("_n", F.count(F.when(F.col("_own"), 1)).over(Window.partitionBy("screen", "package")))
    seen = lambda c: F.max(F.when(F.col("_shown"), F.col(c))).over(w)
    main = F.min_by("package", F.when(F.col("_own"), F.struct(-F.col("_n"), F.col("package")))).over(w)
    placed = with_region(rows.withColumns({"_w": seen("x_max"), "_h": seen("y_max"), "_main": main}).filter("_shown"))
    part = lambda name, c: F.when(c.isNotNull(), F.concat(F.lit(f"{name}="), quoted(c)))
    other = F.when((F.col("package") != "") & ~F.col("package").eqNullSafe(F.col("_main")), F.col("package"))
    args = [*[part(c, F.col(f"_c_{c}")) for c in TEXTS], part("class_name", short_class(F.col("class_name"))), part("loc", F.col("region"))]
    args += [F.when(_is(c), c) for c in FLAGS] + [F.when(~F.coalesce(F.col("is_enabled"), F.lit(True)), "disabled"), part("package_name", F.coalesce("_kind", other))]
    return placed.withColumn("args", F.array_compact(F.array(*args))).drop("_main", "_kind", "_own", "_n", *[f"_c_{c}" for c in TEXTS])


def compact_listing(elements: DataFrame, keep: Column | None = None) -> DataFrame:
    """(screen, idx, line): informative elements, the first of those that read alike; keep: stays anyway."""
    rows = _with_compact(elements).withColumns({"_name": is_semantic_resource(F.col("resource_name")), "_full": collapse(F.col("text")), "_forced": F.coalesce(F.lit(False) if keep is None else keep, F.lit(False))})
    rows = rows.withColumn("_shown", F.coalesce(_informative([F.col(f"_c_{c}") for c in TEXTS], F.col("_name"), F.col("_full")), F.lit(False)) | F.col("_forced"))
    rows = _with_arguments(rows).select("screen", "idx", "_forced", F.when(F.size("args") > 0, F.array_join("args", ", ")).alias("_said"))
    first = F.row_number().over(Window.partitionBy("screen", "_said").orderBy("idx")) == 1
    kept = rows.withColumn("_first", first).filter(F.when(F.col("_first") | F.col("_forced"), F.col("_said").isNotNull()))
    return kept.select("screen", "idx", F.concat(F.lit("UI element "), F.col("idx").cast("string"), F.lit(": UIElement("), F.col("_said"), F.lit(")")).alias("line"))


def listing_text(lines: DataFrame) -> DataFrame:
    """(screen, ui): the lines of each screen in order."""
    return lines.groupBy("screen").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("idx", "line"))), lambda x: x["line"]), "\n").alias("ui"))


#: The head and the end of a question.
ALLOWED_ACTIONS = (
    "Allowed action JSON shapes: status(goal_status=complete|infeasible); answer(text); click(index); long_press(index); input_text(index,text); keyboard_enter; navigate_home; "
    "navigate_back; scroll(direction=up|down|left|right[,index]); open_app(app_name); wait."
)
ANSWER_FORMAT = """Please answer in exactly this format:
Reason: <one brief reason grounded in the goal, history, or visible UI elements>
Action: {"action_type": "..."}
Use concrete JSON values. Do not output UI element metadata or a second action."""


def question(goal: Column, history: Column, ui: Column, suffix: Column | str = f"{ALLOWED_ACTIONS}\n\n{ANSWER_FORMAT}") -> Column:
    suffix = F.lit(suffix) if isinstance(suffix, str) else suffix
    return F.concat(
        F.lit("What is the next AndroidWorld action?\n\nThe current AndroidWorld user goal is: "), collapse(goal, "Unknown goal."), F.lit("\nHistory: "), history, F.lit("\nThe visible UI elements are:\n"), F.coalesce(F.when(ui != "", ui), F.lit(NO_ELEMENTS)), F.lit("\n\n"), suffix
    )


def renormalized(q: Column) -> Column:
    """A question put together anew from its sections; one without the sections stays as it is."""
    s = q_sections(q)
    suffix = F.when((s["suffix"] == "") | s["suffix"].contains("Allowed action JSON shapes:") | s["suffix"].contains("Valid action_type values:"), f"{ALLOWED_ACTIONS}\n\n{ANSWER_FORMAT}").otherwise(s["suffix"])
    return F.coalesce(question(s["goal"], s["history"], s["ui_elements"], suffix), q)


_LINE = re.compile(r"^\s*UI\s+element\s+(\d+)\s*:\s*UIElement\((.*)\)\s*$", re.I)
_FIELD = re.compile(r"""(\w+)=('(?:\\.|[^'\\])*'|"(?:\\.|[^"\\])*"|\w+\([^()]*\)|\{[^{}]*\}|[^,]+)|(\w+)""")
ELEMENT = "idx bigint, text string, content_description string, hint_text string, class_name string, package string, resource_name string, is_checked boolean, is_clickable boolean, is_editable boolean, is_scrollable boolean, is_selected boolean, is_enabled boolean"
_NAMES = {"package_name": "package"}
_FIELDS = tuple(x.split()[0] for x in ELEMENT.split(", "))[1:]


@lru_cache(maxsize=1 << 16)
def _values(body: str) -> tuple:
    """Values of ELEMENT's fields, but idx, of what stands in a line's brackets. Lines of many screens read alike."""
    found: dict = {}
    for name, value, flag in _FIELD.findall(body):
        if flag:
            found[flag] = True
        elif value[0] in "'\"" and "\\" not in value and value.isprintable() and value[0] == value[-1] and len(value) > 1:
            found[name] = value[1:-1]  # no escapes, so the literal is what it shows
        else:
            try:
                found[name] = ast.literal_eval(value)
            except (SyntaxError, ValueError):
                continue  # a nested element, such as a box
    if found.pop("disabled", False):
        found["is_enabled"] = False
    out = {_NAMES.get(k, k): v for k, v in found.items()}
    return tuple(out.get(name) for name in _FIELDS)


def parsed_line(line: str | None) -> dict | None:
    """Fields of one listing line, values by the safe literal parser; bare flags are true, "disabled" is not enabled."""
    m = _LINE.match(line or "")
    return {"idx": int(m[1]), **dict(zip(_FIELDS, _values(m[2])))} if m else None


def parse_listing(rows: DataFrame, column: str = "line") -> DataFrame:
    """Adds element, the fields of a listing line (null if it isn't one); Python's literals need Python's parser."""
    kinds = [pa.int64(), *(pa.bool_() if x.split()[1] == "boolean" else pa.string() for x in ELEMENT.split(", ")[1:])]

    @F.arrow_udf(ELEMENT)
    def parse(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        none = (None,) * len(kinds)
        for lines in batches:
            matches = [_LINE.match(x or "") for x in lines.to_pylist()]
            columns = zip(*[(int(m[1]), *_values(m[2])) if m else none for m in matches]) if matches else [()] * len(kinds)
            yield pa.StructArray.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["idx", *_FIELDS])

    return rows.withColumn("element", parse(F.col(column))).withColumn("element", F.when(F.col("element.idx").isNotNull(), F.col("element")))


__all__ = ["compact_listing", "flatten_trees", "informative", "listing_text", "parse_listing", "question", "renormalized", "with_arguments"]


def labelled_lines(elements: DataFrame, shown: Column) -> DataFrame:
    """(screen, idx, line): the detailed style, one brace-enclosed line an element that is on the screen."""
    text = lambda c: F.when(F.coalesce(F.col(c), F.lit("")) != "", F.concat(F.lit(f'"{c}": "'), F.col(c), F.lit('"')))
    flag = lambda c: F.concat(F.lit(f'"{c}": '), F.when(_is(c), "True").otherwise("False"))
    only = lambda c: F.when(_is(c), F.lit(f'"{c}": True'))
    parts = [F.concat(F.lit('"index": '), F.col("idx").cast("string")), text("text"), text("content_description"), text("hint_text"), flag("is_clickable"), flag("is_editable"), only("is_scrollable"), flag("is_selected"), flag("is_checked")]
    line = F.concat(F.lit("UI element "), F.col("idx").cast("string"), F.lit(": {"), F.array_join(F.array_compact(F.array(*parts)), ", "), F.lit("}"))
    return elements.filter(shown).select("screen", "idx", line.alias("line"))


#: How a listing is announced, without a screenshot and beside a labelled one, and what an empty one says.
LISTING = "\n\nHere is a list of descriptions for some UI elements on the current screen:\n"
LABELLED_LISTING = (
    "\n\nThe current screenshot and the same screenshot with bounding boxes and labels added are also given to you.\n"
    "Here is a list of detailed information for some of the UI elements (notice that some elements in this list may not be visible in the current screen and so you can not interact with it, "
    "can try to scroll the screen to reveal it first), the numeric indexes are consistent with the ones in the labeled screenshot:\n"
)
NOT_AVAILABLE = "Not available"


def selection_prompt(goal: Column, history: Column, ui: Column, prefix: str = "", guidance: str = "", screenshots: bool = False, guidelines: Column | None = None) -> Column:
    """A prompt that asks for the next action, around a goal, a history and a listing.

    screenshots: the style of requests that come with pictures; guidelines: an array of lines for this task, none if empty.
    """
    own = F.lit("")
    if guidelines is not None:
        own = F.when(F.size(guidelines) > 0, F.concat(F.lit("For The Current Task:\n"), F.array_join(F.transform(guidelines, lambda g: F.concat(F.lit("- "), g, F.lit("\n"))), ""))).otherwise("")
    gap = "\n" if screenshots else "\n\n"
    return F.concat(
        F.lit(f"{prefix}\nThe current user goal/request is: "), goal, F.lit("\n\nHere is a history of what you have done so far:\n"), history,
        F.lit(LABELLED_LISTING if screenshots else LISTING), or_default(ui, NOT_AVAILABLE),
        F.lit(guidance), own, F.lit(f'{gap}Now output an action from the above list in the correct JSON format, following the reason why you do that. Your answer should look like:\nReason: ...\nAction: {{"action_type":...}}\n\nYour Answer:\n'),
    )


#: The parts of a request to sum a step up, each before its section, and the closing rules.
SUMMARY_PARTS = (
    "\nThe (overall) user goal/request is:",
    "\nNow I want you to summerize the latest step based on the action you pick with the reason and descriptions for the before and after (the action) screenshots.\nHere is the description for the before screenshot:\n",
    "\nHere is the description for the after screenshot:\n",
    "\nThis is the action you picked: ",
    "\nBased on the reason: ",
)
SUMMARY_RULES = (
    "\n\n\nBy comparing the descriptions for the two screenshots and the action performed, give a brief summary of this step. "
    "This summary will be added to action history and used in future action selection, so try to include essential information you think that will be most useful for future action selection like "
    "what you intended to do, why, if it worked as expected, if not what might be the reason (be critical, the action/reason might not be correct), what should/should not be done next and so on. "
    "Some more rules/tips you should follow:\n- Keep it short and in one line.\n"
    "- Some actions (like `answer`, `wait`) don't involve screen change, you can just assume they work as expected.\n"
    "- Given this summary will be added into action history, it can be used as memory to include information that needs to be remembered, or shared between different apps.\n\nSummary of this step: "
)


def summary_prompt(goal: Column, action: Column, reason: Column, before: Column, after: Column, prefix: str = "") -> Column:
    """A prompt that asks to sum up a step, from the listings before and after it; empty ones are said to be."""
    said = (goal, or_default(before, NOT_AVAILABLE), or_default(after, NOT_AVAILABLE), action, reason)
    return F.concat(F.lit(prefix), *[x for part, c in zip(SUMMARY_PARTS, said) for x in (F.lit(part), c)], F.lit(SUMMARY_RULES))


def elements_of(nodes: DataFrame, width: Column | None = None, height: Column | None = None) -> DataFrame:
    """Elements of tree nodes: empty texts are null, edges become x_min, x_max, y_min, y_max.

    nodes has left, right, top, bottom, is_visible_to_user, view_id_resource_name, and what else an
    element has under its own name. With a screen's width and height, bbox holds the same box in parts
    of the screen; without, it is null.
    """
    texts = {c: F.when(F.col(c) != "", F.col(c)) for c in ("text", "content_description", "class_name", "hint_text", "package_name", "view_id_resource_name") if c in nodes.columns}
    names = {"left": "x_min", "right": "x_max", "top": "y_min", "bottom": "y_max", "is_visible_to_user": "is_visible", "view_id_resource_name": "resource_name"}
    out = nodes.withColumns(texts).withColumnsRenamed(names)
    box = "struct<x_min:double,x_max:double,y_min:double,y_max:double>"
    if width is None or height is None:
        return out.withColumn("bbox", F.lit(None).cast(box))
    return out.withColumn("bbox", F.struct((F.col("x_min") / width).alias("x_min"), (F.col("x_max") / width).alias("x_max"), (F.col("y_min") / height).alias("y_min"), (F.col("y_max") / height).alias("y_max")).cast(box))


def prompt_section(text: Column, start: str, ends: tuple[str, ...]) -> Column:
    """What stands between the first match of start and the nearest match of an end; empty without a start."""
    body = F.regexp_extract(text, f"(?is){start}(.*)$", 1)
    return F.regexp_replace(F.element_at(F.split(body, "(?is)" + "|".join(ends), 2), 1), r"^\s+|\s+$", "")
