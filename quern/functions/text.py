"""Text functions on columns: tokens, cleaning, names, verb forms, sections, histories."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.compat import WS, once, or_default


def token_count(c: Column) -> Column:
    """White-space separated pieces, none empty; null counts as none."""
    return F.coalesce(once(collapse(c), lambda t: F.when(t == "", 0).otherwise(F.length(t) - F.length(F.replace(t, F.lit(" "), F.lit(""))) + 1)), F.lit(0)).cast("bigint")


def char_count(c: Column) -> Column:
    return F.length(c).cast("bigint")


def collapse(c: Column, default: str | None = "") -> Column:
    """White space collapsed and trimmed; null or empty gives default."""
    return or_default(F.btrim(F.regexp_replace(c, WS, " ")), default)


def clean_instruction(c: Column, default: str = "") -> Column:
    """Collapsed, blanks and stops trimmed off, a leading "to " taken away."""
    return once(F.btrim(collapse(c, default), F.lit(" .")), lambda t: F.when(F.lower(F.left(t, F.lit(3))) == "to ", F.btrim(F.substring(t, 4, 1 << 30))).otherwise(t))


#: All but ASCII letters, digits and underscores, as ranges: Java tests a negated class some thirty times slower.
UNSAFE = r"[\x00-/:-@\[-^`{-\x{10FFFF}]+"


def safe_name(c: Column, default: str = "row") -> Column:
    return or_default(F.btrim(F.regexp_replace(collapse(c, default), UNSAFE, "_"), F.lit("_")), default)


def truncate(c: Column, limit: int) -> Column:
    """At most limit - 1 characters and "..." if the cleaned text is longer than limit."""
    cut = lambda t: F.concat(F.rtrim(F.left(t, F.lit(limit - 1)), F.lit(" .,;")), F.lit("..."))
    return once(F.btrim(collapse(c), F.lit(" .")), lambda t: F.when(F.length(t) <= limit, t).otherwise(cut(t)))


def sentence(c: Column) -> Column:
    """Cleaned text with one stop at its end; empty stays empty."""
    return once(F.btrim(collapse(c), F.lit(" .")), lambda t: F.when(t == "", t).otherwise(F.concat(t, F.lit("."))))


#: Irregular forms.
GERUNDS = dict(be="being", begin="beginning", cancel="canceling", do="doing", get="getting", go="going", have="having", make="making", open="opening", run="running", set="setting", stop="stopping", tap="tapping")
PARTICIPLES = dict(
    be="been", begin="begun", do="done", get="gotten", go="gone", have="had", input="input", make="made", open="opened", run="run", send="sent", set="set", take="taken", visit="visited", write="written"
)
GERUND_PARTICIPLES = dict(
    adding="added", checking="checked", choosing="chosen", clearing="cleared", clicking="clicked", closing="closed", creating="created", decreasing="decreased", deleting="deleted", disabling="disabled",
    enabling="enabled", entering="entered", getting="gotten", going="gone", increasing="increased", making="made", moving="moved", navigating="navigated", opening="opened", pressing="pressed",
    returning="returned", saving="saved", scrolling="scrolled", searching="searched", selecting="selected", sending="sent", setting="set", sharing="shared", starting="started", stopping="stopped",
    swiping="swiped", tapping="tapped", taking="taken", typing="typed", using="used", viewing="viewed", waiting="waited", writing="written",
)

#: The end of a word whose last consonant doubles before a suffix.
DOUBLES = "[^aeiou][aeiou][^aeiouwxy]$"


def _looked_up(table: dict[str, str], c: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), c)


def gerund(c: Column) -> Column:
    return _gerund(F.lower(c))


def _gerund(v: Column) -> Column:
    regular = (
        F.when(v.endswith("ie"), F.concat(F.regexp_replace(v, "ie$", ""), F.lit("ying")))
        .when(v.endswith("e") & ~v.rlike("[eoy]e$"), F.concat(F.regexp_replace(v, "e$", ""), F.lit("ing")))
        .when(v.rlike(DOUBLES), F.concat(v, F.right(v, F.lit(1)), F.lit("ing")))
        .otherwise(F.concat(v, F.lit("ing")))
    )
    return F.when(v.endswith("ing"), v).otherwise(F.coalesce(_looked_up(GERUNDS, v), regular))


def _participle_of_base(v: Column) -> Column:
    regular = F.when(v.endswith("e"), F.concat(v, F.lit("d"))).when(v.rlike(DOUBLES), F.concat(v, F.right(v, F.lit(1)), F.lit("ed"))).otherwise(F.concat(v, F.lit("ed")))
    return F.coalesce(_looked_up(PARTICIPLES, v), regular)


def base_of_gerund(c: Column) -> Column:
    return _base_of_gerund(F.lower(c))


def _base_of_gerund(v: Column) -> Column:
    stem = F.regexp_replace(v, "ing$", "")
    return (
        F.when(~v.endswith("ing") | (F.length(v) <= 4), v)
        .when(v.endswith("ying"), F.concat(F.regexp_replace(v, "ying$", ""), F.lit("ie")))
        .when(stem.rlike("[aeiou]([^aeiou])\\1$"), F.regexp_replace(stem, ".$", ""))
        .when(stem.rlike("(ak|av|az|os|ov|yp|rit)$"), F.concat(stem, F.lit("e")))
        .otherwise(stem)
    )


def past_participle(c: Column) -> Column:
    """Of a verb, or of its gerund by way of the base form; a base that still ends in "ing" is regular."""
    v = F.lower(c)
    return F.when(v.endswith("ing"), F.coalesce(_looked_up(GERUND_PARTICIPLES, v), _participle_of_base(base_of_gerund(v)))).otherwise(_participle_of_base(v))


_LONG_PRESS = r"(?i)^(long[-\s]?press|long[-\s]?pressing|longing press)\b"
_FIRST_WORD = r"^[A-Za-z]+(\b.*)?$"


def goal_phrase(c: Column) -> Column:
    t = clean_instruction(c, "the current task")
    rest = F.regexp_replace(t, "^[A-Za-z]+", "")
    return F.when(t.rlike(_LONG_PRESS), F.concat(F.lit("long pressing"), F.regexp_replace(t, _LONG_PRESS, ""))).when(t.rlike(_FIRST_WORD), F.concat(gerund(F.regexp_extract(t, "^[A-Za-z]+", 0)), rest)).otherwise(t)


def completed_goal_phrase(c: Column) -> Column:
    t = clean_instruction(c)
    rest = F.regexp_replace(t, "^[A-Za-z]+", "")
    return (
        F.when(t == "", "starting from the initial state")
        .when(t.rlike(_LONG_PRESS), F.concat(F.lit("having long pressed"), F.regexp_replace(t, _LONG_PRESS, "")))
        .when(t.rlike(_FIRST_WORD), F.concat(F.lit("having "), past_participle(F.regexp_extract(t, "^[A-Za-z]+", 0)), rest))
        .otherwise(F.concat(F.lit("having completed "), t))
    )


def with_phrases(rows: DataFrame, instruction: Column, doing: str | None = None, done: str | None = None) -> DataFrame:
    """Adds goal_phrase and completed_goal_phrase of an instruction under the names given.

    Each intermediate text is a column of its own, so it is made once and the generated code stays
    small. One of the two names is given; a null instruction is the current task, or the initial state.
    """
    t, word, rest, base = (F.col(c) for c in ("__t", "__word", "__rest", "__base"))
    out = rows.withColumn("__t", clean_instruction(instruction, "" if done else "the current task"))
    out = out.withColumns({"__word": F.when(t.rlike(_FIRST_WORD), F.lower(F.regexp_extract(t, "^[A-Za-z]+", 0))), "__rest": F.regexp_replace(t, "^[A-Za-z]+", ""), "__long": F.when(t.rlike(_LONG_PRESS), F.regexp_replace(t, _LONG_PRESS, ""))})
    found = {}
    if doing:
        found[doing] = F.coalesce(F.concat(F.lit("long pressing"), F.col("__long")), F.concat(_gerund(word), rest), t)
    if done:
        out = out.withColumn("__base", F.when(word.endswith("ing"), _base_of_gerund(word)).otherwise(word))
        participle = F.coalesce(F.when(word.endswith("ing"), _looked_up(GERUND_PARTICIPLES, word)), _participle_of_base(base))
        found[done] = F.when(t == "", "starting from the initial state").otherwise(
            F.coalesce(F.concat(F.lit("having long pressed"), F.col("__long")), F.concat(F.lit("having "), participle, rest), F.concat(F.lit("having completed "), t))
        )
    return out.withColumns(found).drop("__t", "__word", "__rest", "__long", "__base")


def last_instruction(history: Column) -> Column:
    """The last "Instruction:" of a history; null if it has none."""
    found = F.regexp_extract_all(history, F.lit(r"Instruction:\s*(.*?)(?:\.\s*(?:Step|$)|$)"), F.lit(1))
    return F.when(F.size(found) > 0, collapse(F.try_element_at(found, F.lit(-1))))


#: Characters without a public meaning, icon names, and the length of a compact text.
PRIVATE_USE = r"[\x{E000}-\x{F8FF}\x{F0000}-\x{10FFFF}]"
ICONS = r"\b(custom\s+)?icon[-_][A-Za-z0-9_-]+\b|\bcurrency_[A-Za-z]{3}\b"
MACHINE_ID = r"^([0-9a-f]{12,}|[0-9a-f]{8,}([-_][0-9a-f]{4,})+)([-_][0-9]{6,})?$"
MAX_COMPACT = 96


def is_machine_id(c: Column) -> Column:
    t = F.lower(F.btrim(c))
    return (t != "") & (t.rlike(MACHINE_ID) | ((F.length(t) >= 20) & t.rlike("[0-9]") & t.contains("-") & ~t.rlike(WS)))


def readable(c: Column) -> Column:
    """Without private-use characters and icon names, collapsed; null stays null."""
    return F.when(c.isNotNull(), collapse(F.regexp_replace(F.regexp_replace(F.regexp_replace(c, "\u00a0", " "), PRIVATE_USE, ""), ICONS, " ")))


def compacted(t: Column) -> Column:
    """A readable text, capped; null if it is empty or an id. t is named often, so it had better be a column."""
    capped = F.when(F.length(t) > MAX_COMPACT, F.concat(F.rtrim(F.left(t, F.lit(MAX_COMPACT - 1)), F.lit(" .,;")), F.lit("..."))).otherwise(t)
    return F.when((t != "") & ~is_machine_id(t), capped)


def compact_text(c: Column) -> Column:
    """Without private-use characters and icon names, collapsed, capped; null if nothing or an id is left."""
    return once(readable(c), compacted)


def short_class(c: Column) -> Column:
    return F.when(F.btrim(c) != "", F.substring_index(c, ".", -1))


#: Words of a resource name that say nothing.
GENERIC_TOKENS = (
    "background btn button cell constraint container content decor frame fragment host icon id image item items layout linear list nav navigation panel "
    "recycler relative root row screen scroll text view views"
).split()


#: A word that is neither generic nor a number.
OWN_WORD = rf"(?<![a-z0-9])(?!(?:{'|'.join(GENERIC_TOKENS)}|[0-9]+)(?![a-z0-9]))[a-z0-9]+"


def is_semantic_resource(c: Column) -> Column:
    """A resource name with a word of its own after its last slash."""
    suffix = F.lower(F.btrim(F.substring_index(c, "/", -1)))
    named = suffix.rlike("[a-z]") & ~suffix.isin("decor_view", "navigationbarbackground") & ~suffix.contains("resource_name_obfuscated") & ~suffix.rlike("^(input_method_nav|key_pos_|navigationbar)")
    return F.coalesce(named & suffix.rlike(OWN_WORD), F.lit(False))


#: Markers of the sections of a question.
GOAL_MARKER = "The current AndroidWorld user goal is:"
HISTORY_MARKER = "\nHistory:"
UI_MARKER = "\nThe visible UI elements are:"
END_MARKERS = ("\n\nAllowed action JSON shapes:", "\n\nValid action_type values:", "\n\nPlease answer in exactly this format:")


def q_sections(q: Column) -> Column:
    """struct(goal, history, ui_elements, suffix); null unless the three markers stand in order."""
    g = F.locate(GOAL_MARKER, q)
    goal_at = g + len(GOAL_MARKER)
    h = F.expr("0") + _locate(HISTORY_MARKER, q, goal_at)
    history_at = h + len(HISTORY_MARKER)
    u = _locate(UI_MARKER, q, history_at)
    ui_at = u + len(UI_MARKER)
    size = F.length(q)
    end = F.coalesce(F.least(*[F.when(_locate(m, q, ui_at) > 0, _locate(m, q, ui_at)) for m in END_MARKERS]), size + 1)
    part = lambda a, b: F.regexp_replace(F.substr(q, a, F.greatest(b - a, F.lit(0))), r"^\s+|\s+$", "")
    return F.when((g > 0) & (h > 0) & (u > 0), F.struct(part(goal_at, h).alias("goal"), part(history_at, u).alias("history"), part(ui_at, end).alias("ui_elements"), part(end, size + 1).alias("suffix")))


def _locate(marker: str, q: Column, since: Column) -> Column:
    return F.call_function("locate", F.lit(marker), q, since)
