"""What readers of the tables ask for: lookups, scopes, lists, lines of sections, and the small updates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .graph import joined_lines
from .ranking import first_per_group


def owned(rows: DataFrame, owners: DataFrame, key: str) -> DataFrame:
    """FLT-05: rows of what the caller owns; rows of others and rows that are not there look the same."""
    return rows.join(owners.select(key).distinct(), key, "left_semi")


def by_keys(rows: DataFrame, key: str, values: list) -> DataFrame:
    """FLT-01, FLT-02, SRC-17, SRC-18: a pushed-down equality or IN filter."""
    return rows.where(F.col(key).isin(values))


def claim_unowned(rows: DataFrame, column: str, value: Column) -> DataFrame:
    """FLT-03, DML-02: sets a value where there is none."""
    return rows.withColumn(column, F.coalesce(column, value))


def without(rows: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """DML-01: all rows but those of the keys (the table is written anew without them)."""
    return rows.join(keys.select(key).distinct(), key, "left_anti")


def evolve(rows: DataFrame, defaults: dict[str, Column]) -> DataFrame:
    """DDL-01: columns that lack are added; where old rows have null they get the default."""
    have = set(rows.columns)
    return rows.select(*[c for c in rows.columns if c not in defaults], *[(F.coalesce(c, v) if c in have else v).alias(c) for c, v in defaults.items()])


def results(questions: DataFrame, submissions: DataFrame, citations: DataFrame) -> DataFrame:
    """JON-02: every question with its submission and its citation, if any."""
    return questions.join(submissions, "question_id", "left").join(citations, "citation_id", "left")


def lookup(rows: DataFrame, table: DataFrame, key: str, value: str) -> DataFrame:
    """JON-03, MAP-01: a value by key, null where there is none."""
    return rows.join(table.select(key, value), key, "left")


def group_of_files(groups: DataFrame, file: str = "file") -> DataFrame:
    """JON-06: (file, key) from groups(key, ord, files); a file in several groups belongs to the last."""
    return groups.select("key", "ord", F.explode("files").alias(file)).groupBy(file).agg(F.max_by("key", F.struct("ord", "key")).alias("key"))


def imports_of(edges: DataFrame) -> DataFrame:
    """JON-17: each file's imports, external ones too, in order of place."""
    return edges.groupBy("source").agg(F.transform(F.sort_array(F.collect_list(F.struct("ord", "target"))), lambda x: x["target"]).alias("targets"))


def first_where(rows: DataFrame, condition: Column, order: list) -> DataFrame:
    """JON-18, TOP-08: one row that fulfils a condition, or none."""
    return rows.where(condition).orderBy(*order).limit(1)


def first_of_each(rows: DataFrame, condition: Column, keys: list[str], order: list) -> DataFrame:
    """JON-18 for all keys at once: of each, the first row that fulfils a condition."""
    return first_per_group(rows.where(condition), keys, order)


def vocabulary_sources(questions: DataFrame, citations: DataFrame, quizzes: DataFrame, guides: DataFrame, groups: DataFrame) -> DataFrame:
    """JON-19: the snippet and path a question was drawn from, and its group's name in the snapshot of its guide; null where a link lacks."""
    q = questions.join(citations.select("citation_id", "file_path", "snippet"), "citation_id", "left")
    q = q.join(quizzes.select("quiz_id", "guide_id"), "quiz_id", "left").join(guides.select("guide_id", "snapshot_id"), "guide_id", "left")
    return q.join(groups.select("snapshot_id", "key", "name"), ["snapshot_id", "key"], "left").select("question_id", "file_path", "snippet", "name")


def bounded_entry_points(entries: DataFrame, files: DataFrame, kept: DataFrame, most: int = 200) -> DataFrame:
    """FLT-10: entry points of kept files and of files that are in no graph, by (file, kind), at most so many."""
    known = entries.join(files.select(F.col("id").alias("file")), "file", "left_anti").unionByName(entries.join(kept.select(F.col("id").alias("file")), "file", "left_semi"))
    return known.orderBy("file", "kind", "reason").limit(most)


def public_questions(quizzes: DataFrame, questions: DataFrame, secret: list[str]) -> DataFrame:
    """PRJ-01, PRJ-02, PRJ-09: questions of quizzes that are ready, without the columns that give answers away."""
    return questions.join(quizzes.where("status = 'ready'").select("quiz_id"), "quiz_id", "left_semi").drop(*secret)


def adjacent(edges: DataFrame) -> DataFrame:
    """SET-04: each node once with each of its neighbours, whichever way the edge goes."""
    return edges.select("source", "target").unionByName(edges.select(F.col("target").alias("source"), F.col("source").alias("target"))).distinct()


def merged(parts: list[DataFrame], order: list) -> DataFrame:
    """SET-05, TOP-13: rows of several kinds together, columns that one lacks as null, with their place in the natural order."""
    from functools import reduce

    both = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    return both.withColumn("place", F.row_number().over(Window.partitionBy("quiz_id").orderBy(*order)))


def ordered(rows: DataFrame, key: list[str], order: list) -> DataFrame:
    """TOP-01, TOP-14: rows of each key with their place."""
    return rows.withColumn("place", F.row_number().over(Window.partitionBy(*key).orderBy(*order)))


def latest(rows: DataFrame, order: list) -> DataFrame:
    """TOP-07."""
    return rows.orderBy(*order).limit(1)


def capped(items: Column, most: int) -> Column:
    """TOP-11: the first items in order, and how many are not shown."""
    return F.struct(F.slice(F.sort_array(items), 1, most).alias("shown"), F.greatest(F.size(items) - most, F.lit(0)).alias("not_shown"))


def capped_list(items: Column, most: int = 8) -> Column:
    """TOP-12: a comma list of the first items "…and N more"."""
    return F.concat(F.array_join(F.slice(items, 1, most), ", "), F.when(F.size(items) > most, F.concat(F.lit(" …and "), (F.size(items) - most).cast("string"), F.lit(" more"))).otherwise(""))


def tally(rows: DataFrame, keys: list[str], score: str, lists: str) -> DataFrame:
    """AGG-18: how many scores are full, and how long the lists are together."""
    return rows.groupBy(*keys).agg(F.count_if(F.col(score) >= 1).alias("full"), F.sum(F.size(lists)).alias("listed"))


def resume_at(questions: DataFrame) -> DataFrame:
    """WIN-13: of each attempt, the place of the first question without an answer; null if all have one."""
    return questions.groupBy("attempt_id").agg(F.min(F.when(~F.col("answered"), F.col("ord"))).alias("resume_at"))


def byte_chunks(content: Column, size: int) -> Column:
    """SNK-09: a payload as an array of pieces in order."""
    n = F.ceil(F.octet_length(content) / size).cast("int")
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.substring(content, i * size + 1, F.lit(size)))).otherwise(F.array().cast("array<binary>"))


def audio_facts(response: Column) -> Column:
    """JSN-03: seconds and language of a transcription response: usage.seconds of a duration, else a numeric duration; the first of a list of languages, or the one."""
    v = F.try_parse_json(response)
    get = lambda p, t: F.try_variant_get(v, p, t)
    seconds = F.coalesce(F.when(get("$.usage.type", "string") == "duration", get("$.usage.seconds", "double")), F.when(F.schema_of_variant(get("$.duration", "variant")) != "STRING", get("$.duration", "double")))
    named = F.when(F.schema_of_variant(get("$.language", "variant")) == "STRING", get("$.language", "string"))
    return F.struct(seconds.alias("seconds"), F.coalesce(get("$.languages[0]", "string"), named).alias("language"))


def payload(columns: list[Column]) -> Column:
    """JSN-01: a JSON object, nulls included."""
    return F.to_json(F.struct(*columns), {"ignoreNullFields": "false"})


def from_payload(text: Column, schema: str, defaults: dict[str, Column]) -> list[Column]:
    """JSN-02: the fields of a payload, missing ones by default."""
    parsed = F.from_json(text, schema)
    return [F.coalesce(parsed[k], v).alias(k) for k, v in defaults.items()]


# -- sections of a guide, as lines (STR-26)


def overview_lines(languages: DataFrame, entries: DataFrame, most: int = 30) -> DataFrame:
    """TOP-06: one text: languages with their files, the first entry points by (file, kind), and how many more there are."""
    langs = F.array_join(F.sort_array(F.collect_list(F.concat("lang", F.lit(" ("), F.col("n").cast("string"), F.lit(" files)")))), ", ")
    top = languages.agg(langs.alias("l")).select(F.lit(0).alias("part"), F.lit("").alias("file"), F.lit("").alias("kind"), F.concat(F.lit("## Tech Stack\n\nLanguages: "), F.when(F.col("l") == "", "none detected").otherwise(F.col("l")), F.lit(".\n\n## Entry Points\n")).alias("line"))
    shown = entries.orderBy("file", "kind", "reason").limit(most).select(F.lit(1).alias("part"), "file", "kind", F.format_string("- **%s** (%s): %s", "file", "kind", "reason").alias("line"))
    more = entries.agg((F.count("*") - most).alias("n")).where("n > 0").select(F.lit(2).alias("part"), F.lit("").alias("file"), F.lit("").alias("kind"), F.format_string("- _...and %d more, not shown._", "n").alias("line"))
    return joined_lines(top.unionByName(shown).unionByName(more), ["part", "file", "kind"])


def tradeoff_lines(cards: DataFrame, key: str) -> DataFrame:
    """A text for each guide: its cards by decision. cards(key, decision, reasoning, cost, alternatives, confidence)."""
    none = F.array_join("alternatives", ", ")
    line = F.concat(F.lit("### "), "decision", F.lit("\n\n**Reasoning:** "), "reasoning", F.lit("\n\n**Trade-off:** "), "cost", F.lit("\n\n**Alternatives considered:** "), F.when(none == "", "none recorded").otherwise(none), F.lit("\n\n**Confidence:** "), "confidence", F.lit("\n"))
    return joined_lines(cards.select(key, "decision", line.alias("line")), ["decision"], [key]).select(key, F.rtrim(F.regexp_replace("text", r"\n+$", "")).alias("text"))


def architecture_lines(claims: DataFrame, key: str) -> DataFrame:
    """A text for each guide: pattern, caveats, and its evidence in order; in a fold below the narrative where there is one.

    claims(key, narrative, pattern, confidence, caveats, evidence array<struct<claim, paths>>).
    """
    items = F.transform("evidence", lambda e: F.concat(F.lit("- "), e["claim"], F.lit(" — "), F.array_join(F.transform(e["paths"], lambda p: F.concat(F.lit("`"), p, F.lit("`"))), ", ")))
    caveats = F.when(F.coalesce("caveats", F.lit("")) != "", F.concat(F.lit("\n\n"), "caveats")).otherwise("")
    body = F.concat(F.lit("**Primary pattern:** "), "pattern", F.lit(" (confidence: "), "confidence", F.lit(")"), caveats, F.lit("\n\n**Evidence:**\n\n"), F.array_join(items, "\n"))
    folded = F.concat("narrative", F.lit("\n\n<details>\n<summary>Evidence ("), F.size("evidence").cast("string"), F.lit(" claims)</summary>\n\n"), body, F.lit("\n\n</details>"))
    return claims.select(key, F.when(F.col("pattern").isNull(), F.coalesce("narrative", F.lit("_No architecture pattern could be grounded in evidence._"))).when(F.col("narrative").isNull(), body).otherwise(folded).alias("text"))


def deep_dive_lines(chunks: DataFrame, key: str) -> DataFrame:
    """A text for each guide: files in order, their chunks as "Part i of n" where there are several. chunks(key, file, chunk_index, chunk_count, line_start, line_end, purpose, role)."""
    w = Window.partitionBy(key, "file")
    parts = F.count("*").over(w) > 1
    first = F.row_number().over(w.orderBy("chunk_index")) == 1
    line = F.concat(
        F.when(first, F.format_string("### `%s` (lines %d-%d)\n\n", "file", "line_start", "line_end")).otherwise(""),
        F.when(parts, F.format_string("**Part %d of %d:**\n", "chunk_index", "chunk_count")).otherwise(""), "purpose", F.lit("\n\n"), "role", F.lit("\n"),
    )
    lines = chunks.select(key, "file", "chunk_index", line.alias("line"))
    return joined_lines(lines, ["file", "chunk_index"], [key]).select(key, F.regexp_replace("text", r"\n+$", "").alias("text"))
