"""Operator 12: spelling variants of words, by anagram hashing.

A word's key is the sum of the fifth powers of its letters' code points (modulo a
prime): anagrams share it, adding a letter adds the letter's power, an exchange of letters
changes the key by the difference of their powers. So that no alphabet has to be tried, each word gives its
own key and its key less the power of each of its distinct letters:

* removal, addition: one word's own key is the other's less one letter;
* exchange: both words' keys are equal less one letter each.

Candidates are joined by these integers; the order of the letters is verified by the
edit distance in the condition of the join, so only true pairs become rows. A word has
a bounded number of near words (by its length and the alphabet), pairs follow the number of words.
A key that many words share (anagrams of one another) is dealt further by the halves of the
words: one edit leaves either the first or the second half as it is.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written

#: The letters of a run.
LETTERS = r"A-Za-zÀ-ÿ"
PRIME = (1 << 61) - 1
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def power(letter: Column) -> Column:
    x = F.ascii(letter).cast("long")
    return x * x * x * x * x


def anagram_key(word: Column) -> Column:
    return F.aggregate(F.split(word, ""), F.lit(0).cast("long"), lambda a, c: (a + power(c)) % F.lit(PRIME))


def noisy_runs(docs: DataFrame, every: int = 31, least: int = 7) -> DataFrame:
    """(word): each run of letters of docs(doc_id, text), A-Z lowered; where `every` divides the crc32 of <doc_id>:<run>, one letter is removed. Only words of `least` letters or more. A null doc_id is written as nothing."""
    runs = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"), F.explode(F.regexp_extract_all("text", F.lit(f"([{LETTERS}]{{{least},}})"), F.lit(1))).alias("run"))
    low = runs.select("id", F.translate("run", _UPPER, _LOWER).alias("run"))
    h = F.crc32(F.concat("id", F.lit(":"), "run"))
    at = F.expr("cast(h % char_length(run) as int)")
    cut = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.char_length("run")))
    return low.withColumn("h", h).select(F.when(F.col("h") % every == 0, cut).otherwise(F.col("run")).alias("word")).where(F.char_length("word") >= least)


def entries(words: DataFrame) -> DataFrame:
    """(akey, less, word, n): each of words(word, n) under its own key and, with less, under its key less each of its letters."""
    keyed = words.withColumn("k", anagram_key(F.col("word")))
    keys = F.transform(F.array_distinct(F.split("word", "")), lambda c: F.struct(F.pmod(F.col("k") - power(c), F.lit(PRIME)).alias("akey"), F.lit(True).alias("less")))
    own = F.array(F.struct(F.col("k").alias("akey"), F.lit(False).alias("less")))
    return keyed.select(F.explode(F.concat(own, keys)).alias("_"), "word", "n").select("_.akey", "_.less", "word", "n")


def near_words(words: DataFrame, group: int = 64) -> DataFrame:
    """(word, n, other, other_n): all pairs of words(word, n) that differ by one code point inserted, deleted or replaced, in both directions.

    A pair that meets under one key in a few ways is still one row: an exchange
    meets at the key without the two letters only, a removal at the shorter word's own key only.
    """
    rows = written(entries(words), "entries")  # read several times below
    large = written(rows.groupBy("akey").agg(F.count("*").alias("m")).where(F.col("m") > group).select("akey"), "large_keys")
    few = rows.join(large, "akey", "left_anti")
    # halves of the shorter word's length, for keys of more than `group` entries
    short = F.char_length("word") - F.col("less").cast("int")
    first, second = F.substring("word", F.lit(1), F.floor(short / 2).cast("int")), F.expr("right(word, short - floor(short / 2))")
    many = rows.join(large, "akey", "left_semi").withColumn("short", short).select("*", F.xxhash64(first).alias("h1"), F.xxhash64(second).alias("h2"))
    other = lambda df: df.select(*[F.col(c).alias(c if c in ("akey", "h1") else f"{c}_") for c in df.columns])
    near = (F.col("less") | F.col("less_")) & (F.levenshtein("word", "word_", 1) == 1)
    a, b = few, other(few)
    found = [a.join(b, (a.akey == b.akey) & near)]
    for side in ("h1", "h2"):
        x, y = many, many.select(*[F.col(c).alias(f"{c}_") for c in many.columns])
        met = (F.col("akey") == F.col("akey_")) & (F.col(side) == F.col(f"{side}_")) & near
        found.append(x.join(y, met if side == "h1" else met & (F.col("h1") != F.col("h1_"))))
    pick = [df.select("word", "n", F.col("word_").alias("other"), F.col("n_").alias("other_n")) for df in found]
    return pick[0].unionByName(pick[1]).unionByName(pick[2])


def spelling_variants(docs: DataFrame, factor: int = 10, least_n: int = 2, every: int = 31, least: int = 7) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of the words of docs(doc_id, text); see noisy_runs().

    Words come least_n times or more (n). n_near counts the words that differ by one code point; form
    is the most frequent of them (ties: the first in code-point order) if it comes
    `factor` times as often, form_n how often; root is where the forms lead to, the word itself if it has none. Null and
    empty texts have no words; rows with a repeated doc_id are counted each. Extra columns are left
    out. An empty table gives no rows.
    """
    words = written(noisy_runs(docs, every, least).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least_n), "words")
    best = near_words(words).groupBy("word", "n").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("other_n")).alias("m"), F.col("other").alias("form"))).alias("_b"))
    takes = -F.col("_b.m") >= factor * F.col("n")
    best = written(best.select("word", "n_near", F.when(takes, F.col("_b.form")).alias("form"), F.when(takes, -F.col("_b.m")).alias("form_n")), "forms")
    # each step multiplies n by `factor` or more, so the jumps double up to an end that is reached soon
    up = written(best.where("form IS NOT NULL").select("word", F.col("form").alias("root")), "up")
    moved = 1
    while moved:
        further = up.select(F.col("word").alias("root"), F.col("root").alias("next"))
        nxt = written(up.join(further, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "up")
        moved = nxt.where("moved").limit(1).count()
        up = nxt.select("word", "root")
    out = words.join(best, "word", "left").join(up, "word", "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), "form_n")
