"""Question augmentation, multi-entity questions, instruction lists, schedules, lookups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quern.compat import or_default

#: Question templates; the places take the property and the name.
QUESTIONS = (
    "What {} does {} have?",
    "What is the {} of {}?",
    "Tell me about the {} of {}.",
    "Can you let me know the {} of {}?",
    "Can you inform me about the {} of {}?",
    "Describe the {} of {}.",
    "What details can you share about the {} of {}?",
    "What kind of {} does {} have?",
    "Provide details on the {} of {}.",
    "What features does the {} of {} include?",
    "Can you elaborate on the {} of {}?",
    "How would you describe the {} of {}?",
    "What can you tell me about the {} characteristics of {}?",
    "Can you explain the {} of {}?",
    "What insights can you provide about the {} of {}?",
    "What should I know about the {} of {}?",
)
#: Templates of questions about several entities.
MULTI_QUESTIONS = (
    "What is {}?",
    "Tell me {}.",
    "Can you let me know {}?",
    "Can you inform me {}?",
    "Describe {}.",
    "Explain {}.",
    "Could you describe the {}?",
    "What can you tell me about {}?",
    "Could you provide information on {}?",
    "Please enlighten me about {}.",
    "Can you clarify {} for me?",
    "Could you give me a detailed description of {}?",
    "I need more information on {}.",
)
#: Fixed value: the answer to a question that the knowledge base doesn't cover.
UNKNOWN = "I am sorry I cannot find relevant information in the KB."
#: What generated entities are about.
IDEAS = (
    "software companies", "tech companies", "software tools", "greek letters", "product reviews", "product releases", "work-related concepts", "work-related documents",
    "document types", "financial terms", "legal terms", "medical terms", "fiction characters", "famous rock bands", "birds", "animals",
    "natural phenomena", "physical locations", "artist names", "classical music", "musical instruments", "music genres", "art styles", "ancient Roman concepts",
    "Hindu myths", "Cthulhu Mythos", "real-world company names", "mythological creatures", "planets and stars", "historical figures", "political figures", "literary genres",
    "botanical names", "famous landmarks", "scientific concepts", "space missions", "inventions", "philosophical terms", "chemical elements", "famous scientists",
    "famous mathematicians", "famous authors", "marine life", "mythological places", "famous battles", "sports teams", "sport events", "food and drinks",
)
#: Kinds of generated entities; "meeting" stands twice.
KINDS = (
    "person name", "idea", "team", "meeting", "event", "location", "document", "presentation", "meeting", "conference", "workshop", "database", "organization",
    "tech company", "car company", "entertainment company", "construction company", "retail company", "finance company", "healthcare company", "restaurant",
    "hotel", "museum", "university", "educational institution", "government agency", "hospital", "github repo", "project", "meeting room", "building", "product",
    "lab", "airline", "textbook", "tv show", "music album", "website", "personal blog", "gaming company", "game", "movie studio", "consulting firm", "biotech company",
    "app", "software tool", "bookstore", "coffee shop", "bar", "e-commerce site", "social media platform", "fitness brand", "fashion brand", "beauty brand",
    "food brand", "drink brand", "sports brand", "travel brand", "non-profit organization", "political party",
)


def picked(templates: tuple[str, ...], key: Column) -> Column:
    """A template by a hash of key that any engine can repeat: 28 bits of its md5."""
    h = F.conv(F.substring(F.md5(key), 1, 7), 16, 10).cast("bigint")
    return F.element_at(F.array(*[F.lit(t) for t in templates]), (h % len(templates) + 1).cast("int"))


def filled(template: Column, *values: Column) -> Column:
    """Each place of the template takes the next value, whatever the values hold."""
    parts = F.split(template, r"\{\}")
    out = F.element_at(parts, 1)
    for k, v in enumerate(values):
        out = F.concat(out, v, F.element_at(parts, k + 2))
    return out


def questions(rows: DataFrame) -> DataFrame:
    template = picked(QUESTIONS, F.concat_ws("|", "name", "description_type"))
    return rows.withColumn("question", filled(template, F.col("description_type"), F.col("name")))


def multi_entity(rows: DataFrame, group: str | list[str], order: str) -> DataFrame:
    """(group, question, answer) over each group's (name, property, answer) in order."""
    group = [group] if isinstance(group, str) else group
    items = F.array_sort(F.collect_list(F.struct(order, "name", "property", "answer")))
    of = lambda x: F.concat(F.lit("he "), x["property"], F.lit(" of "), x["name"])
    g = rows.groupBy(*group).agg(items.alias("items"))
    body = F.array_join(F.transform("items", lambda x: F.concat(F.lit("t"), of(x))), ", ")
    answer = F.array_join(F.transform("items", lambda x: F.concat(F.lit("T"), of(x), F.lit(" is "), x["answer"])), "; ")
    return g.select(*group, filled(picked(MULTI_QUESTIONS, F.concat_ws("|", *[F.col(c).cast("string") for c in group])), body).alias("question"), answer.alias("answer"))


#: A request for names of an idea, around one of the kinds; the places take the idea and the kind.
REQUEST = (
    "Please randomly generate a {} name innovated by or associated with {}."
    "The generated name should be of diverse style and length. A valid name should consist of a single word (such as Alexandria or Microsoft) or multiple words (such as Microsoft Office or Theta-Phoenix Entertainment). "
)


def instructions(spark: SparkSession) -> DataFrame:
    """The request for each idea with each kind; two short fixed lists."""
    pairs = spark.range(1).select(F.explode(F.array(*[F.lit(x) for x in IDEAS])).alias("s"), F.array(*[F.lit(x) for x in KINDS]).alias("ds")).select("s", F.explode("ds").alias("d"))
    return pairs.select(filled(F.lit(REQUEST), F.col("s"), F.col("d")).alias("instruction"))


#: Fixed value: the least size and the bound of a dynamic knowledge base.
DYNAMIC = (10, 200)


def drawn(low: int, high: int, *parts: Column) -> Column:
    """A number from low to high - 1 by 32 bits of the md5 of parts, which any engine can repeat."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *parts)), 1, 8), 16, 10).cast("bigint") % (high - low) + low


def step_schedule(spark: SparkSession, steps: int, outliers: int = 0, multi: int | None = None, extended: bool = False, kb_size: int | tuple[int, int] | str | None = None, seed: int = 0) -> DataFrame:
    """(step, kind, entities, kb_size, fixed_answer) of each training step.

    The last steps, from steps - 1 - outliers on, are outliers with one fixed answer; of the others
    every third asks for several entities (if multi says how many), the next for the extended
    question (if extended), the rest are plain. kb_size: a number; a range or "dynamic" for a draw of
    each step; None or 0 grows by four every hundred steps.
    """
    step = F.col("step")
    kind = (
        F.when(step >= steps - 1 - outliers, "outlier")
        .when(step % 3 == 0, "multi" if multi is not None else "plain")
        .when(step % 3 == 1, "extended" if extended else "plain")
        .otherwise("plain")
    )
    low_high = DYNAMIC if kb_size == "dynamic" else kb_size
    size = drawn(*low_high, F.lit(str(seed)), step.cast("string")) if isinstance(low_high, (tuple, list)) else F.lit(low_high) if low_high else (F.floor(step / 100) + 1) * 4
    rows = spark.range(steps).select(F.col("id").alias("step")).withColumn("kind", kind)
    return rows.withColumns({"entities": F.when(F.col("kind") == "multi", F.lit(multi)).cast("int"), "kb_size": size.cast("bigint"), "fixed_answer": F.when(F.col("kind") == "outlier", UNKNOWN)})


#: Primes, more than any table's rows; one is the distance between a step's draws.
STRIDES = (4294967311, 4294967357, 4294967371, 4294967377, 4294967387, 4294967389, 4294967459, 4294967477)


def draws(steps: DataFrame, size: int, rows: Column | int, seed: int = 0) -> DataFrame:
    """(step, slot, pick, position): size draws without replacement a step, or size times entities of them.

    The draws of a step stand a prime's distance apart, from a start and by a prime that a hash of the
    step chooses; a prime over the number of rows is coprime to it, so no position comes twice, and no
    draw depends on another. rows: the table's rows, at least as many as a step draws and below 2 ** 31.
    """
    n = F.lit(rows) if isinstance(rows, int) else rows
    picks = F.coalesce("entities", F.lit(1))
    name = F.col("step").cast("string")
    stride = F.element_at(F.array(*[F.lit(p) for p in STRIDES]), (drawn(0, len(STRIDES), F.lit(f"{seed}/stride"), name) + 1).cast("int"))
    out = steps.withColumns({"_n": n.cast("bigint"), "_start": drawn(0, 1 << 31, F.lit(str(seed)), name), "_stride": stride})
    out = out.withColumn("_draw", F.explode(F.sequence(F.lit(0), (size * picks - 1).cast("int"))))
    at = (F.col("_start") + F.col("_draw") * (F.col("_stride") % F.col("_n"))) % F.col("_n")
    return out.withColumns({"slot": F.floor(F.col("_draw") / picks).cast("int"), "pick": (F.col("_draw") % picks).cast("int"), "position": at}).drop("_n", "_start", "_stride", "_draw")


def batches(steps: DataFrame, data: DataFrame, size: int, rows: Column | int, augmented: bool = False, seed: int = 0) -> DataFrame:
    """(step, slot, kind, question, answer) of each training step; pairs with a null are left out.

    steps: step_schedule's; data: (position, name, description_type, description, Q, A, extended_Q,
    extended_A), position from 0 on. A multi step asks for its entities in one question, an extended
    one takes the extended pair, an outlier the fixed answer; augmented: plain questions come from a
    template.
    """
    picked_ = draws(steps, size, rows, seed).join(data, "position")
    named = picked_.withColumnsRenamed({"description_type": "property", "description": "told"})
    several = multi_entity(named.filter("kind = 'multi'").withColumn("answer", F.col("told")), ["step", "slot", "kind"], "pick")
    plain = F.coalesce(filled(picked(QUESTIONS, F.concat_ws("|", "name", "property")), F.col("property"), F.col("name"))) if augmented else F.col("Q")
    extended = F.col("kind") == "extended"
    ones = named.filter("kind <> 'multi'").select("step", "slot", "kind", F.when(extended, F.col("extended_Q")).otherwise(plain).alias("question"), F.when(extended, F.col("extended_A")).otherwise(F.coalesce("fixed_answer", F.col("A"))).alias("answer"))
    return ones.unionByName(several).filter("question is not null and answer is not null")


def knowledge_base(true_rows: DataFrame, context: DataFrame) -> DataFrame:
    """(step, place, position, is_true): a step's true positions first, in order, then its context's.

    Both: (step, slot, position). A step's true rows are counted, so the context follows them gapless.
    """
    n = true_rows.groupBy("step").agg(F.count("*").alias("_n"))
    w = Window.partitionBy("step").orderBy("slot", "position")
    first = true_rows.select("step", (F.row_number().over(w) - 1).cast("bigint").alias("place"), "position", F.lit(True).alias("is_true"))
    then = context.select("step", "slot", "position", (F.row_number().over(w) - 1).cast("bigint").alias("_k")).join(n, "step", "left")
    return first.unionByName(then.select("step", (F.coalesce("_n", F.lit(0)) + F.col("_k")).alias("place"), "position", F.lit(False).alias("is_true")))


def with_both(rows: DataFrame) -> DataFrame:
    """rows that have a question and an answer."""
    return rows.filter("Q is not null and A is not null")


def context(rows: DataFrame) -> DataFrame:
    """One row: every key and description in order, each ended by "; "."""
    items = F.array_sort(F.collect_list(F.struct("rid", F.concat("key_string", F.lit(" is "), "description").alias("t"))))
    return rows.agg(F.concat(F.array_join(F.transform(items, lambda x: x["t"]), "; "), F.lit("; ")).alias("context"))


def restored(rows: DataFrame, source: DataFrame, order: str) -> DataFrame:
    """rows (name, Q) with Q from the last source row of the name that has one."""
    last = source.filter("name <> ''").groupBy("name").agg(F.max_by("Q", order).alias("_q"))
    return rows.join(last, "name", "left").select("name", or_default(F.col("_q"), F.col("Q")).alias("Q"), F.coalesce(F.col("_q") != "", F.lit(False)).alias("restored"))


def count_guard(name: str, rows: DataFrame, vectors: DataFrame) -> DataFrame:
    """(name, expected, found, aligned): whether two tables have as many rows."""
    a, b = rows.agg(F.count("*").alias("expected")), vectors.agg(F.count("*").alias("found"))
    return a.join(F.broadcast(b)).select(F.lit(name).alias("name"), "expected", "found", (F.col("expected") == F.col("found")).alias("aligned"))
