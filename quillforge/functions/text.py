"""Text functions as column expressions; those that no built-in expresses are vectorised pandas functions."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Extensions of code files; words not worth a hint; directories without meaning of their own.
CODE_EXTENSIONS = ["py", "js", "ts", "tsx", "jsx", "json", "yml", "yaml", "toml", "md", "sql", "sh"]
STOPWORDS = (
    "self cls def class return import from async await if else elif for while in not and or is none true false with as try "
    "except finally raise pass lambda yield the of to a an const let var function export default new this null undefined"
).split()
GENERIC_DIRS = ["app", "src", "lib", "backend", "frontend", "tests", "test", "pkg"]
#: Spoken separators, in the order in which they are replaced.
SPOKEN = [(r"\s+underscore\s+", "_"), (r"\s+under\s+score\s+", "_"), (r"\s+dot\s+", "."), (r"\s+slash\s+", "/"), (r"\s+forward\s+slash\s+", "/"), (r"\s+dash\s+", "-"), (r"\s+hyphen\s+", "-")]
CODE_OMITTED = "Code example omitted."
#: Markdown marks and what stands in for them, in the order in which they go; emphasis goes twice, for marks within marks.
_EMPHASIS = [(r"(\*\*|\*)(?=\S)(.+?)(?<=\S)\1", "$2"), (r"(?<![A-Za-z0-9])(__|_)(?=\S)(.+?)(?<=\S)\1(?![A-Za-z0-9])", "$2")]
MARKDOWN = [
    (r"(?s)```.*?```", f" {CODE_OMITTED} "), (r"!\[([^\]]*)\]\([^)]*\)", "$1"), (r"\[([^\]]+)\]\([^)]*\)", "$1"), (r"<[^>]+>", ""),
    (r"(?m)^\s*(?:-{3,}|\*{3,}|_{3,})\s*$", ""), (r"(?m)^\s{0,3}#{1,6}\s+", ""), (r"(?m)^\s*(?:[-*+]|\d+[.)])\s+", ""), (r"(?m)^\s*>\s?", ""), (r"`([^`]*)`", "$1"),
    *_EMPHASIS, *_EMPHASIS, (r"[ \t]+", " "),
]
#: Fixed value: the shape of an identifier, dotted name or path.
TOKEN = r"[A-Za-z_][A-Za-z0-9_]*(?:[./][A-Za-z0-9_]+)*"


def normal(x: Column) -> Column:
    """STR-01, STR-02: white space collapsed and trimmed, letters folded so that those which differ in case only are alike."""
    return folded(F.trim(F.regexp_replace(x, r"(?U)\s+", " ")))


def folded(x: Column) -> Column:
    """Full case folding by the built-ins: what upper case spells out (ß as SS, ﬁ as FI) is lowered again; the dotless i is no i, and a final sigma is a sigma."""
    return F.translate(F.lower(F.upper(F.translate(x, "ı", "\ue000"))), "\ue000ς", "ıσ")


def or_default(x: Column, default: Column) -> Column:
    """PRJ-07: the empty string counts as missing."""
    return F.coalesce(F.nullif(x, F.lit("")), default)


def _after(x: Column, n: int) -> Column:
    """All that follows the first n characters."""
    return F.substring(x, F.lit(n + 1), F.char_length(x))


def _title(x: Column) -> Column:
    """Each run of letters with a capital first and the others small."""
    parts = F.regexp_extract_all(x, F.lit(r"(\p{L}+|[^\p{L}]+)"), 1)
    return F.array_join(F.transform(parts, lambda p: F.concat(F.upper(F.substring(p, 1, 1)), F.lower(_after(p, 1)))), "")


def fallback_label(path: Column) -> Column:
    """STR-06: the file's name without extension, underscores as spaces, in title case."""
    return _title(F.replace(F.regexp_replace(F.substring_index(path, "/", -1), r"\.[^.]*$", ""), F.lit("_"), F.lit(" ")))


def fallback_name(key: Column) -> Column:
    """STR-08: the last segment of a directory, '_' and '-' as spaces, in title case."""
    return F.when(key == "(root)", "Project root").otherwise(_title(F.translate(F.substring_index(key, "/", -1), "_-", "  ")))


def sanitize_label(x: Column) -> Column:
    """STR-07: white space collapsed, quotes, brackets and braces out, "Unnamed" for nothing."""
    return or_default(F.trim(F.regexp_replace(F.regexp_replace(x, r"\s+", " "), r'["\[\]{}]', "")), F.lit("Unnamed"))


def file_stem(x: Column, default: str = "study-guide", most: int = 60) -> Column:
    """STR-09: letters and digits, all else as single '-', lower case, then cut."""
    return or_default(F.substring(F.lower(F.regexp_replace(F.regexp_replace(x, r"[^\p{L}\p{N}]+", "-"), r"^-+|-+$", "")), 1, most), F.lit(default))


def truncate(x: Column, most: int = 2000, mark: str = "… (truncated)") -> Column:
    """STR-10."""
    return F.when(F.length(x) > most, F.concat(F.substring(x, 1, most), F.lit(mark))).otherwise(x)


def arrow_paths(x: Column) -> Column:
    """STR-11: the trimmed parts of "a -> b"."""
    return F.transform(F.split(x, " -> "), lambda p: F.trim(p))


def speakable(x: Column) -> Column:
    """STR-12: Markdown as plain sentences: code blocks named, marks dropped, lines joined."""
    for pattern, by in MARKDOWN:
        x = F.regexp_replace(x, pattern, by)
    lines = F.filter(F.transform(F.split(x, "\n"), lambda s: F.trim(F.regexp_replace(s, r"^\s+|\s+$", ""))), lambda s: s != "")
    return F.array_join(lines, " ")


def cut_at_sentence(x: Column, most: int) -> Column:
    """STR-13: up to the last sentence end within `most` characters, else the last space, else all of them."""
    head = F.substring(x, 1, most)
    sentence = F.regexp_extract(head, r"(?s)^(.*[.!?])(?:\s|$)", 1)
    words = F.regexp_extract(head, r"(?s)^(.+) ", 1)
    return F.when(F.length(x) <= most, x).when(sentence != "", sentence).when(words != "", F.rtrim(words)).otherwise(F.rtrim(head))


def sentences(x: Column) -> Column:
    """STR-14, without the cutting of long ones."""
    return F.filter(F.transform(F.split(F.trim(x), r"(?<=[.!?])\s+"), lambda s: F.trim(s)), lambda s: s != "")


#: The longest beginning of 40 to 349 characters before a comma, else before a space, else 350 characters.
_PIECE = re.compile(r"(?s).{40,349}(?=,)|.{40,349}(?= )|.{350}")


@F.pandas_udf(T.ArrayType(T.StringType()))
def sentence_pieces(texts: pd.Series) -> pd.Series:
    """STR-14: sentences in pieces of 350 characters at most, cut at a comma or space from 40 on, else hard."""

    def pieces(text: str | None) -> list[str]:
        out = []
        for s in filter(None, map(str.strip, re.split(r"(?<=[.!?])\s+", text or ""))):
            while len(s) > 350:
                head = _PIECE.match(s)[0]
                out.append(head.strip())
                s = s[len(head) :].lstrip(", ")
            out.append(s)
        return out

    return texts.map(pieces)


def looks_technical(t: Column) -> Column:
    """STR-15: an underscore, a slash, an inner capital, or the extension of a code file."""
    return t.contains("_") | t.contains("/") | t.rlike(r"(?s)^.+\p{Lu}") | (t.contains(".") & F.lower(F.substring_index(t, ".", -1)).isin(CODE_EXTENSIONS))


def technical_terms(x: Column) -> Column:
    """STR-15: the identifier-shaped tokens of a text, in order."""
    return F.filter(F.regexp_extract_all(F.coalesce(x, F.lit("")), F.lit(f"({TOKEN})"), 1), looks_technical)


def path_segments(path: Column) -> Column:
    """STR-16: the file's name, then its directories that mean something."""
    parts = F.filter(F.split(F.replace(path, F.lit("\\"), F.lit("/")), "/"), lambda p: p != "")
    return F.concat(F.slice(parts, F.greatest(F.size(parts), F.lit(1)), F.lit(1)), F.filter(F.slice(parts, F.lit(1), F.greatest(F.size(parts) - 1, F.lit(0))), lambda p: ~F.lower(p).isin(GENERIC_DIRS)))


def vocabulary(rows: DataFrame, key: str, snippet: str, path: str, name: str, excluded: str, most_terms: int = 40, most_chars: int = 400) -> DataFrame:
    """AGG-15, STR-17, WIN-15: (key, rank, term, weight): hint terms of each row by weight, ties by first place; nothing that gives the answer away.

    excluded is an array of terms; a term goes if it or one of its components is
    among them. At most most_terms, as long as their list joined by ", " keeps within most_chars.
    """
    items = F.concat(
        F.transform(technical_terms(F.col(snippet)), lambda t: F.struct(t.alias("term"), F.lit(1).alias("weight"))),
        F.transform(path_segments(F.coalesce(path, F.lit(""))), lambda t: F.struct(t.alias("term"), F.lit(2).alias("weight"))),
        F.transform(F.filter(F.array(F.trim(F.coalesce(name, F.lit("")))), lambda t: t != ""), lambda t: F.struct(t.alias("term"), F.lit(2).alias("weight"))),
    )
    terms = rows.select(key, F.transform(F.filter(F.coalesce(excluded, F.array().cast("array<string>")), lambda t: F.trim(t) != ""), lambda t: F.lower(F.trim(t))).alias("_out"), F.posexplode(items).alias("pos", "item"))
    terms = terms.select(key, "_out", "pos", F.col("item.term").alias("term"), F.col("item.weight").alias("weight"), F.lower(F.trim("item.term")).alias("_k"))
    parts = F.filter(F.split("_k", r"[/._\-]"), lambda p: p != "")
    terms = terms.where((F.col("_k") != "") & ~F.col("_k").isin(STOPWORDS) & ~F.array_contains("_out", F.col("_k")) & ~F.arrays_overlap(parts, "_out"))
    ranked = terms.groupBy(key, "_k").agg(F.sum("weight").alias("weight"), F.min("pos").alias("_first"), F.min_by("term", "pos").alias("term"))
    w = Window.partitionBy(key).orderBy(F.desc("weight"), "_first")
    ranked = ranked.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= most_terms)
    ranked = ranked.withColumn("_chars", F.sum(F.length("term") + F.when(F.col("rank") > 1, 2).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return ranked.where(F.col("_chars") <= most_chars).select(key, "rank", "term", "weight")


def vocabulary_prompt(terms: Column) -> Column:
    """STR-18."""
    return F.when(F.size(terms) == 0, "").otherwise(F.concat(F.lit("Technical terms: "), F.array_join(terms, ", "), F.lit(".")))


@F.pandas_udf(T.StringType())
def fold_accents(texts: pd.Series) -> pd.Series:
    """The part of STR-19 that no built-in has: compatibility decomposition without combining marks."""
    return texts.map(lambda t: None if t is None else "".join(c for c in unicodedata.normalize("NFKD", t) if not unicodedata.combining(c)))


def spoken_tokens(x: Column) -> Column:
    """STR-19: the tokens of a transcript: lower-cased, spoken separators as signs, other punctuation out. x is a column of ASCII text or of fold_accents()."""
    x = F.concat(F.lit(" "), F.lower(x), F.lit(" "))
    for pattern, sign in SPOKEN:
        x = F.regexp_replace(x, pattern, sign)
    x = F.regexp_replace(x, r"[^\p{L}\p{N}_\s./\-]", " ")
    edge = lambda t: F.regexp_replace(t, r"^[./\-]+|[./\-]+$", "")
    return F.filter(F.transform(F.split(F.trim(F.regexp_replace(x, r"\s+", " ")), " "), edge), lambda t: t != "")


def word_error_rate(ref: Column, hyp: Column) -> Column:
    """STR-20: token edit distance over the reference's length; without reference 0 if the hypothesis is empty too, else 1.

    Each distinct token of a pair becomes one code point (surrogates left out),
    so that the built-in edit distance counts tokens. Beyond the 1,112,031 code
    points that there are, decode() raises an error.
    """

    def rate(p: Column) -> Column:
        place = lambda t: F.lit(32) + F.array_position(p["words"], t)
        few = lambda t: F.lpad(F.hex(place(t)), 8, "0")
        many = lambda t: F.lpad(F.hex(place(t) + F.when(place(t) >= 0xD800, 0x800).otherwise(0)), 8, "0")
        codes = lambda a: F.when(F.size(p["words"]) < 0xD800 - 32, F.transform(a, few)).otherwise(F.transform(a, many))
        coded = lambda a: F.decode(F.unhex(F.array_join(codes(a), "")), "UTF-32")
        r, h = p["r"], p["h"]
        return F.when(F.size(r) == 0, F.when(F.size(h) == 0, 0.0).otherwise(1.0)).otherwise(F.levenshtein(coded(r), coded(h)) / F.size(r))

    with_words = lambda p: F.struct(F.array_distinct(F.concat(p["r"], p["h"])).alias("words"), p["r"].alias("r"), p["h"].alias("h"))
    return _once(F.struct(ref.alias("r"), hyp.alias("h")), lambda p: _once(with_words(p), rate))


def _once(x: Column, f) -> Column:
    """f(x), with x worked out once however often f uses it, within lambdas too."""
    return F.element_at(F.transform(F.array(x), f), 1)


def identifier_recall(expected: Column, tokens: Column) -> Column:
    """STR-21: the share of expected tokens that come exactly; null if none are expected."""
    share = lambda p: F.when(F.size(p["e"]) > 0, F.size(F.filter(p["e"], lambda t: F.array_contains(p["t"], t))) / F.size(p["e"]))
    return _once(F.struct(expected.alias("e"), tokens.alias("t")), share)


def numbered(items: Column) -> Column:
    """STR-22."""
    return F.array_join(F.transform(items, lambda t, i: F.concat((i + 1).cast("string"), F.lit(". "), t)), "\n")


def snippet(text: Column, start: Column, end: Column, most_lines: int = 200, most_chars: int = 20_000, mark: str = "\n… (truncated)") -> Column:
    """SRC-14: lines start to end of a text; cut to so many lines, then characters, and marked if cut."""
    n = F.least(end - start + 1, F.lit(most_lines))
    lines = F.array_join(F.slice(F.split(text, "\n"), start, F.greatest(n, F.lit(0))), "\n")
    cut = (end - start + 1 > most_lines) | (F.length(lines) > most_chars)
    return F.when(cut, F.concat(F.substring(lines, 1, most_chars), F.lit(mark))).otherwise(lines)


def last_visible_line(shown: Column, start: Column) -> Column:
    """SRC-15: the last line that a snippet shows wholly, from what it shows."""
    return start + F.length(shown) - F.length(F.replace(shown, F.lit("\n"), F.lit("")))


def pattern_summary(pattern: Column, confidence: Column, evidence: Column) -> Column:
    """STR-24: one sentence of the parts that are there."""
    return F.concat_ws(" ", F.concat(pattern, F.lit(" ("), confidence, F.lit(" confidence).")), evidence)


def token_hash(x: Column) -> Column:
    """STR-25, SRC-19."""
    return F.sha2(x.cast("binary"), 256)
