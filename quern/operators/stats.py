"""Counts, length statistics, field profiles, token usage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.compat import or_default, written


def counted(rows: DataFrame, key: str | Column, name: str = "key") -> DataFrame:
    """(key, n), most frequent first, then by key; a null or empty key is "missing"."""
    c = F.col(key) if isinstance(key, str) else key
    return rows.groupBy(or_default(c, "missing").alias(name)).agg(F.count("*").alias("n")).orderBy(F.desc("n"), name)


def length_stats(rows: DataFrame, episode: str, first: int = 10) -> DataFrame:
    """One row: mean, least and greatest rows an episode, and the first episodes at each end, in string order.

    The two lists are cut to their length by a ranking, so only their ends are gathered.
    """
    lengths = written(rows.groupBy(F.col(episode).alias("ep")).agg(F.count("*").alias("n")), "lengths")  # read three times
    ends = lengths.agg(F.round(F.avg("n"), 3).alias("avg"), F.min("n").alias("min"), F.max("n").alias("max"))

    def listed(end: str) -> DataFrame:
        at = lengths.join(F.broadcast(ends.select(F.col(end).alias("_n"))), F.col("n") == F.col("_n")).orderBy("ep").limit(first)
        return at.agg(F.array_sort(F.collect_list("ep")).alias(f"{end}_episodes"))

    return ends.join(F.broadcast(listed("min"))).join(F.broadcast(listed("max")))


def field_profile(rows: DataFrame, group: str, fields: list[str]) -> DataFrame:
    """(group, field, type, n): which fields are present, and of what type, in each group."""
    names = {"bigint": "int", "int": "int", "double": "float", "float": "float", "string": "str", "boolean": "bool"}
    kinds = dict(rows.dtypes)
    entries = F.array(*[F.struct(F.lit(f).alias("field"), F.lit(names.get(kinds[f], kinds[f])).alias("type"), F.col(f).isNotNull().alias("there")) for f in fields])
    return rows.select(F.col(group), F.inline(entries)).filter("there").groupBy(group, "field", "type").agg(F.count("*").alias("n"))


#: What the types of a variant's values are called.
VALUE_TYPES = {"BOOLEAN": "bool", "BIGINT": "int", "DOUBLE": "float", "FLOAT": "float", "STRING": "str", "VOID": "null"}


def value_type(value: Column) -> Column:
    """The type's name of a variant: null, bool, int, float, str, list or dict. Integers over 64 bits are floats."""
    kind = F.schema_of_variant(value)
    named = F.coalesce(*[F.when(kind == k, name) for k, name in VALUE_TYPES.items()])
    return F.coalesce(named, F.when(kind.startswith("DECIMAL"), "float"), F.when(kind.startswith("ARRAY"), "list"), F.when(kind.startswith("OBJECT"), "dict"), kind)


def value_profile(rows: DataFrame, group: Column, json: Column) -> DataFrame:
    """(key, field, type, n): the fields of each group's JSON objects by the type of each value.

    Anything but an object has no fields, as has one that names a field twice; a null or empty group is "missing".
    """
    fields = F.try_variant_get(F.try_parse_json(json), "$", "map<string,variant>")
    entries = rows.select(or_default(group, "missing").alias("key"), F.explode(fields).alias("field", "value"))
    typed = entries.select("key", "field", F.coalesce(value_type(F.col("value")), F.lit("null")).alias("type"))
    return typed.groupBy("key", "field", "type").agg(F.count("*").alias("n"))


def tallied(rows: DataFrame, /, **sections: Column) -> DataFrame:
    """(section, key, n): how often each value of each section's column occurs; null counts nowhere.

    An array's entries count each. All sections are counted in one pass and one shuffle of counts.
    """

    def named(name: str, values: Column) -> Column:
        entries = F.transform(values, lambda x: F.struct(F.lit(name).alias("section"), x.alias("key")))
        return F.coalesce(entries, F.array().cast("array<struct<section:string,key:string>>"))

    pairs = rows.select(F.inline(F.flatten(F.array(*[named(*s) for s in sections.items()]))))
    return pairs.filter(F.col("key").isNotNull()).groupBy("section", "key").agg(F.count("*").alias("n"))


def counter_text(title: str, rows: DataFrame, most: int = 10_000) -> str:
    """A counter (key, n) as lines, most frequent first; over most keys it is refused, not cut."""
    found = rows.orderBy(F.desc("n"), "key").limit(most + 1).collect()
    if len(found) > most:
        raise ValueError(f"over {most} keys: write a table instead")
    return "\n".join([f"{title}:", *(f"  {r['key']}: {r['n']}" for r in found)] if found else [f"{title}:", "  none: 0"])


def lengths_text(title: str, stats: DataFrame) -> str:
    """The row of length_stats as a line."""
    r = stats.first()
    return f"{title}: avg={r['avg']}, min={r['min']} ({', '.join(r['min_episodes'] or []) or 'n/a'}), max={r['max']} ({', '.join(r['max_episodes'] or []) or 'n/a'})"


def examples(rows: DataFrame, group: str, order: list[str], n: int = 3) -> DataFrame:
    """The first n rows of each group, numbered."""
    w = Window.partitionBy(group).orderBy(*order)
    return rows.withColumn("example", F.row_number().over(w)).filter(F.col("example") <= n)


def usage(rows: DataFrame, model: str, prompt: Column, completion: Column, prices: dict[str, tuple[float, float]]) -> DataFrame:
    """(model, calls, prompt_tokens, completion_tokens, total_tokens, cost_usd); prices a million tokens.

    Null counts count as nothing; the cost of a model without a price is null.
    """
    price = F.create_map(*[x for m, (a, b) in prices.items() for x in (F.lit(m), F.struct(F.lit(a).alias("p"), F.lit(b).alias("c")))])
    own = rows.select(F.col(model).alias("model"), prompt.alias("p"), completion.alias("c"))
    sums = own.groupBy("model").agg(F.count("*").alias("calls"), F.coalesce(F.sum("p"), F.lit(0)).alias("prompt_tokens"), F.coalesce(F.sum("c"), F.lit(0)).alias("completion_tokens"))
    cost = F.try_element_at(price, F.col("model"))
    return sums.withColumn("total_tokens", F.col("prompt_tokens") + F.col("completion_tokens")).withColumn("cost_usd", F.round((F.col("prompt_tokens") * cost["p"] + F.col("completion_tokens") * cost["c"]) / 1e6, 6))
