"""Collection diffs and text de-duplication within a record."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brambling.functions.numbers import near
from brambling.functions.text import col, jaccard, ocr_alike, ocr_key, similarity, stem_set
from brambling.operators.joins import loosely_equal


def field_diff(before: DataFrame, after: DataFrame, keys: list[str], fields: dict[str, str]) -> DataFrame:
    """One row per key and field that changed: (keys, field, old, new). fields: name -> number, text or exact."""
    a = before.select(*keys, *[F.col(f).alias(f"_a_{f}") for f in fields])
    b = after.select(*keys, *[F.col(f).alias(f"_b_{f}") for f in fields])

    def differs(f: str, kind: str) -> Column:
        x, y = F.col(f"_a_{f}"), F.col(f"_b_{f}")
        if kind == "number":
            return ~near(x, y)
        if kind == "text":
            return ~ocr_alike(x, y)
        return ~x.eqNullSafe(y)

    found = [F.when(differs(f, k), F.struct(F.lit(f).alias("field"), F.col(f"_a_{f}").cast("string").alias("old"), F.col(f"_b_{f}").cast("string").alias("new"))) for f, k in fields.items()]
    return a.join(b, keys).select(*keys, F.explode(F.array_compact(F.array(*found))).alias("d")).select(*keys, "d.*")


def match_verdict(same: Column, total: int) -> Column:
    share = same / total
    return F.when(share == 1, "exact").when(share >= 0.8, "high").when(share >= 0.5, "medium").otherwise("low")


def arrays_alike(a: Column | str, b: Column | str, threshold: float = 0.9) -> Column:
    """Equally many items, and the sorted normal forms are pairwise similar."""
    x, y = F.array_sort(F.transform(col(a), ocr_key)), F.array_sort(F.transform(col(b), ocr_key))
    pairs = F.zip_with(x, y, lambda p, q: F.coalesce((p == q) | (similarity(p, q) >= threshold), F.lit(False)))
    return (F.size(x) == F.size(y)) & F.forall(pairs, lambda t: t)


def union_first_spelling(*arrays: Column) -> Column:
    """Items of all arrays once, compared without case; the first spelling and the order of arrival stay."""
    every = F.concat(*[F.coalesce(a, F.array().cast("array<string>")) for a in arrays])
    keys = F.transform(every, lambda x: F.lower(F.trim(x)))
    return F.filter(every, lambda x, i: F.array_position(keys, F.lower(F.trim(x))) == i + 1)


def overrides(template: DataFrame, current: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Template rows whose current value differs or is absent; numbers in text count as numbers."""
    now = current.select(*keys, F.col(value).alias("current"))
    return template.join(now, keys, "left").filter(F.col("current").isNull() | ~loosely_equal(F.col(value), F.col("current")))


def disagreements(rows: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """Fields on which the rows have more than one value: (field, n_values, values), at most 100 of them listed."""
    stacked = reduce(DataFrame.unionByName, (rows.select(F.lit(f).alias("field"), F.col(f).cast("string").alias("value")) for f in fields))
    counts = stacked.filter("value is not null").distinct()
    return counts.groupBy("field").agg(F.count(F.lit(1)).alias("n_values"), F.min("value").alias("least"), F.max("value").alias("most")).filter("n_values > 1")


def merge_by_name(base: DataFrame, table: DataFrame, keys: list[str], name: str, values: list[str], trusted: Column) -> DataFrame:
    """Full outer merge by lower-case name; values of the second table win where it is trusted."""
    t = table.filter(trusted).select(*keys, F.lower(F.trim(name)).alias("_k"), F.col(name).alias("_name"), *[F.col(v).alias(f"_{v}") for v in values])
    b = base.withColumn("_k", F.lower(F.trim(name)))
    both = b.join(t, [*keys, "_k"], "full_outer")
    return both.select(*keys, F.coalesce(name, "_name").alias(name), *[F.coalesce(f"_{v}", v).alias(v) for v in values])


def latest_per_key(new: DataFrame, old: DataFrame, keys: list[str]) -> DataFrame:
    """Upsert: rows of ``new`` replace those of ``old`` with the same key."""
    return old.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(new, allowMissingColumns=True)


def insert_absent(new: DataFrame, old: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``new`` whose key ``old`` does not have, one per key."""
    return new.dropDuplicates(keys).join(old.select(*keys).distinct(), keys, "left_anti")


def paraphrase_groups(items: DataFrame, group: str, position: str, text: str, stop_words: list[str], threshold: float = 0.65) -> DataFrame:
    """Items of a record that say the same are one: equal stem sets first, then Jaccard of stem sets; the longer text stays.

    Greedy in order of position: an item joins the first kept item that it resembles and replaces its text if longer.
    A record's items are folded in one expression, so nothing leaves the JVM.
    """
    listed = items.groupBy(group).agg(F.array_sort(F.collect_list(F.struct(F.col(position).alias("pos"), F.col(text).alias("text")))).alias("items"))
    kind = "array<struct<text: string, stems: array<string>>>"
    start = F.array().cast(kind)

    def step(kept: Column, item: Column) -> Column:
        stems = stem_set(item["text"], stop_words)
        alike = lambda k: (jaccard(k["stems"], stems) >= threshold) | (F.size(stems) + F.size(k["stems"]) == 0)
        hit = F.exists(kept, alike)
        at = F.array_position(F.transform(kept, alike), F.lit(True))
        entry = F.struct(item["text"].alias("text"), stems.alias("stems"))
        replaced = F.transform(kept, lambda k, i: F.when((i + 1 == at) & (F.length(item["text"]) > F.length(k["text"])), entry).otherwise(k))
        return F.when(hit, replaced).otherwise(F.concat(kept, F.array(entry))).cast(kind)

    folded = listed.select(group, F.size("items").alias("n_before"), F.aggregate("items", start, step).alias("kept"))
    return folded.select(group, "n_before", F.size("kept").alias("n_after"), F.transform("kept", lambda k: k["text"]).alias("texts"))


def deep_merge(maps: list[Column]) -> Column:
    """Flattened configuration maps as one; later values win."""
    return reduce(lambda a, b: F.map_zip_with(a, b, lambda k, x, y: F.coalesce(y, x)), maps)


def preferred(defaults: Column, preferences: Column, allowed: list[str]) -> Column:
    """A configuration map with a user's values for the keys that users may set; other keys of theirs count for nothing."""
    own = F.map_filter(F.coalesce(preferences, F.create_map().cast("map<string,string>")), lambda k, v: k.isin(allowed) & v.isNotNull())
    return deep_merge([defaults, own])


def flatten(df: DataFrame, separator: str = ".") -> DataFrame:
    """Nested structs as columns with dotted names."""
    from pyspark.sql.types import StructType

    def walk(schema: StructType, path: list[str]) -> list[Column]:
        out = []
        for f in schema.fields:
            here = [*path, f.name]
            if isinstance(f.dataType, StructType):
                out += walk(f.dataType, here)
            else:
                out.append(F.col(".".join(f"`{p}`" for p in here)).alias(separator.join(here)))
        return out

    return df.select(*walk(df.schema, []))
