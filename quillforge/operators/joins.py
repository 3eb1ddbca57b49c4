"""Nesting, resolving, longest-prefix and first-match joins, and structural differences of two versions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def nest(parents: DataFrame, children: DataFrame, key: str, fields: list[str], order: list[str], name: str = "children") -> DataFrame:
    """JON-04: each parent with its children as an ordered array, empty for none."""
    item = F.struct(*order, *[f for f in fields if f not in order])
    nested = children.groupBy(key).agg(F.sort_array(F.collect_list(item)).alias(name))
    kind = children.select(*order, *[f for f in fields if f not in order]).schema
    return parents.join(nested, key, "left").withColumn(name, F.coalesce(name, F.array().cast(f"array<{kind.simpleString()}>")))


def resolve_or_drop(claims: DataFrame, targets: DataFrame, item: str, path: str, ord_: str, names: str = "path") -> DataFrame:
    """JON-05, FLT-11: claimed paths that exist, once for each item, first by order; items without any go.

    claims(item, ord_, path), targets(path, ...).
    """
    known = claims.join(targets.withColumnRenamed(names, path), path)
    w = Window.partitionBy(item, path).orderBy(ord_)
    return known.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def longest_prefix(df: DataFrame, name: str, known: DataFrame, key: str, value: str, separator: str = ".") -> DataFrame:
    """JON-07: each row with the value of the longest known prefix of its name, by whole segments; null for none."""
    parts = F.split(F.col(name), F.lit("\\" + separator if separator == "." else separator))
    names = df.select(name).distinct().withColumn("_len", F.explode(F.sequence(F.lit(1), F.size(parts))))
    names = names.withColumn(key, F.array_join(F.slice(parts, F.lit(1), F.col("_len")), separator))
    found = names.join(known.select(key, value), key).groupBy(name).agg(F.max_by(value, "_len").alias(value), F.max("_len").alias("matched"))
    return df.join(found, name, "left")


def first_match(df: DataFrame, base: str, known: DataFrame, key: str, suffixes: list[str], index: str = "/index") -> DataFrame:
    """JON-10: each base with the first of its candidates that is known: itself, with each suffix, with index and each suffix."""
    endings = ["", *suffixes, *[index + s for s in suffixes]]
    tries = df.select(base).distinct().select(base, F.posexplode(F.array(*[F.lit(e) for e in endings])).alias("_rank", "_end")).withColumn(key, F.concat(base, "_end"))
    found = tries.join(known.select(key), key).groupBy(base).agg(F.min_by(key, "_rank").alias("target"), F.min("_rank").alias("rank"))
    return df.join(found, base, "left")


def prefer_submodules(imports: DataFrame, known: DataFrame) -> DataFrame:
    """JON-08: targets of `from base import names`: every name that is a module of base; only where none is, base itself.

    imports(import_id, base, names array), known(module, path).
    """
    named = imports.select("import_id", "base", F.explode_outer("names").alias("n")).withColumn("module", F.when(F.col("base") == "", F.col("n")).otherwise(F.concat("base", F.lit("."), "n")))
    hits = named.join(known, "module").select("import_id", "path").distinct()
    rest = imports.join(hits.select("import_id").distinct(), "import_id", "left_anti").join(known.withColumnRenamed("module", "base"), "base").select("import_id", "path")
    return hits.unionByName(rest)


def relative_base(path: Column, level: Column, raw: Column) -> Column:
    """JON-09: dotted module that a relative import of `level` dots names; null above the root.

    raw has the dots and, after them, the module's own name if any.
    """
    package = F.slice(F.split(path, "/"), F.lit(1), F.size(F.split(path, "/")) - 1)
    hops = level - 1
    own = F.substring(raw, level + 1, F.length(raw))
    kept = F.slice(package, F.lit(1), F.greatest(F.size(package) - hops, F.lit(0)))
    parts = F.when(own != "", F.concat(kept, F.split(own, "\\."))).otherwise(kept)
    return F.when(hops <= F.size(package), F.array_join(parts, "."))


def diff_members(before: DataFrame, after: DataFrame, key: str, members: str, name: str) -> DataFrame:
    """JON-14, SET-01/02/06: added, removed and changed groups. Only keys and member sets count; the later name is shown."""
    as_set = lambda df, p: df.select(key, F.array_sort(F.array_distinct(members)).alias(f"{p}_members"), F.col(name).alias(f"{p}_name"))
    both = as_set(before, "b").join(as_set(after, "a"), key, "full_outer")
    kind = F.when(F.col("b_members").isNull(), "added").when(F.col("a_members").isNull(), "removed").when(F.col("a_members") != F.col("b_members"), "changed")
    none = F.array().cast(before.schema[members].dataType)
    out = both.withColumn("kind", kind).where("kind IS NOT NULL")
    a, b = F.coalesce("a_members", none), F.coalesce("b_members", none)
    return out.select("kind", key, F.coalesce("a_name", "b_name").alias(name), F.array_except(a, b).alias("gained"), F.array_except(b, a).alias("lost"))


def diff_by_evidence(before: DataFrame, after: DataFrame, evidence: str, label: str) -> DataFrame:
    """JON-15, WIN-04: items are the same if their sets of evidence are; of each set the first label stands. Moved evidence is removed and added."""

    def keyed(df: DataFrame, p: str) -> DataFrame:
        k = df.withColumn("evidence_key", F.array_join(F.array_sort(F.array_distinct(evidence)), "\n"))
        return k.groupBy("evidence_key").agg(F.min(label).alias(f"{p}_{label}"))

    both = keyed(before, "b").join(keyed(after, "a"), "evidence_key", "full_outer")
    kind = F.when(F.col(f"b_{label}").isNull(), "added").when(F.col(f"a_{label}").isNull(), "removed").when(F.col(f"a_{label}") != F.col(f"b_{label}"), "changed").otherwise("same")
    return both.select(F.coalesce(f"a_{label}", f"b_{label}").alias(label), kind.alias("kind"), "evidence_key")


def changed(before: DataFrame, after: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """SET-07: keys whose fields differ, null-safe, with both values."""
    b = before.select(key, *[F.col(f).alias(f"before_{f}") for f in fields])
    a = after.select(key, *[F.col(f).alias(f"after_{f}") for f in fields])
    same = F.lit(True)
    for f in fields:
        same = same & F.col(f"before_{f}").eqNullSafe(F.col(f"after_{f}"))
    return b.join(a, key, "full_outer").where(~same)


def leftovers(items: DataFrame, grouped: DataFrame, item: str, group: str, other: str = "Other") -> DataFrame:
    """JON-13: each item with its group; those in none form a last group."""
    rest = items.join(grouped, item, "left_anti").select(item, F.lit(other).alias(group), F.lit(1).alias("last"))
    return items.join(grouped, item).select(item, group, F.lit(0).alias("last")).unionByName(rest)


def valid_refs(refs: DataFrame, modules: DataFrame, path: str, start: str, end: str, module_end: str, visible_end: str) -> DataFrame:
    """FLT-06: references into a known module, within its lines and the lines that were shown."""
    return refs.join(modules, path).where((F.lit(1) <= F.col(start)) & (F.col(start) <= F.col(end)) & (F.col(end) <= F.least(module_end, visible_end)))


def allow_list(truth: DataFrame, output: DataFrame, key: str, field: str, fallback: Column) -> DataFrame:
    """FLT-13: model output only for known keys; keys or values that lack get the fallback."""
    return truth.join(output.select(key, F.nullif(F.col(field), F.lit("")).alias("_given")), key, "left").withColumn(field, F.coalesce("_given", fallback)).drop("_given")


def asof(left: DataFrame, right: DataFrame, key: str, at: str, order: str, value: str, bucket: str = "day") -> DataFrame:
    """Each row of left with the value of the latest row of right of its key at or before its time, null for none.

    Time is cut into buckets. A row meets the rows of its own bucket by a window
    over (key, bucket), and for what lies before it the last value of the earlier
    buckets, so that a key of any size is split by time. left(key, at, ...),
    right(key, at, order, value); `order` breaks ties of time, the greatest counts.
    """
    cut = F.date_trunc(bucket, F.col(at).cast("timestamp"))
    r = right.select(key, at, F.col(order).alias("_order"), F.struct(F.col(value).alias("v")).alias("_v")).withColumns({"_bucket": cut, "_side": F.lit(0)})
    rows = left.withColumns({"_bucket": cut, "_side": F.lit(1), "_row": F.struct(*left.columns)}).select(key, at, "_bucket", "_side", "_row")
    both = r.select(key, at, "_bucket", "_side", "_order", "_v").unionByName(rows, allowMissingColumns=True)
    within = Window.partitionBy(key, "_bucket").orderBy(at, "_side", "_order").rowsBetween(Window.unboundedPreceding, 0)
    own = both.withColumn("_own", F.last("_v", ignorenulls=True).over(within)).where("_side = 1")
    # for each bucket of either side, the last value of the buckets before it
    last = r.groupBy(key, "_bucket").agg(F.max_by("_v", F.struct(at, "_order")).alias("_last")).unionByName(rows.select(key, "_bucket").distinct(), allowMissingColumns=True)
    last = last.groupBy(key, "_bucket").agg(F.max("_last").alias("_last"))
    before = Window.partitionBy(key).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    carried = last.withColumn("_before", F.last("_last", ignorenulls=True).over(before)).select(key, "_bucket", "_before")
    return own.join(carried, [key, "_bucket"], "left").select("_row.*", F.coalesce("_own", "_before")["v"].alias(value))
