"""The jobs as queries: each runs twice into one new folder and gives all that is there then."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobs import passages, transcripts
from quillforge.io import shared_folder
from quillforge.plans import texts


def job1_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = shared_folder(spark, "job1_passages")
    for _ in range(2):
        passages.run(spark, f"{sf_dir}/documents.parquet", f"{folder}/index", f"{folder}/checkpoint")
    return passages.index(spark, f"{folder}/index").withColumn("terms", F.array_join("terms", " "))


def job2_transcripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = shared_folder(spark, "job2_transcripts")
    for _ in range(2):
        transcripts.run(spark, f"{sf_dir}/conversations.parquet", folder)
    return transcripts.whole_output(spark, folder)


PASSAGES_SQL = r"""WITH l AS (SELECT doc_id, source, lang, string_split(text, chr(10)) AS l FROM documents WHERE text IS NOT NULL), p AS (SELECT doc_id, source, lang, l, unnest(range(0, CAST(ceil(len(l) / 20) AS BIGINT))) AS ord FROM l),
c AS (SELECT doc_id, source, lang, CAST(ord AS INTEGER) AS ord, CAST(ord * 20 + 1 AS INTEGER) AS line_start, CAST(least(ord * 20 + 20, len(l)) AS INTEGER) AS line_end, array_to_string(l[ord * 20 + 1:ord * 20 + 20], chr(10)) AS x FROM p),
t AS (SELECT *, list_filter(regexp_extract_all(x, '[A-Za-z_][A-Za-z0-9_]*(?:[./][A-Za-z0-9_]+)*'), lambda t: contains(t, '_') OR contains(t, '/') OR regexp_matches(substr(t, 2), '\p{Lu}') OR (contains(t, '.') AND lower(string_split(t, '.')[-1]) IN ('py','js','ts','tsx','jsx','json','yml','yaml','toml','md','sql','sh'))) AS k FROM c WHERE regexp_matches(x, '[^ \t\r\n]'))
SELECT DISTINCT doc_id, source, lang, ord, line_start, line_end, sha256(x) AS hash, CAST(length(x) AS INTEGER) AS n_chars, array_to_string(list_sort(list_distinct(k)), ' ') AS terms FROM t"""

_PAIRS = "s AS (SELECT conv_id, CAST(turn AS INTEGER) AS turn, role, strip_accents(coalesce(text, '')) AS ref FROM conversations WHERE role IN ('user', 'assistant')), h AS (SELECT a.conv_id, a.turn, a.role, a.ref, b.ref AS hyp FROM s a JOIN s b ON b.conv_id = a.conv_id AND b.turn = a.turn + 1)"
_MEDIAN = "list_sort(list(tokens) FILTER ({0}))[CAST(round_even(0.5::DOUBLE * (count(*) FILTER ({0}) - 1), 0) AS INTEGER) + 1]"
TRANSCRIPTS_SQL = f"""WITH RECURSIVE {_PAIRS}, t AS (SELECT conv_id, turn, {texts._tokens_sql('ref')} AS r, {texts._tokens_sql('hyp')} AS p FROM h), {texts._DISTANCES},
e AS (SELECT conv_id, turn, len(r) AS tokens, CASE WHEN len(r) = 0 THEN CASE WHEN len(p) = 0 THEN 0.0 ELSE 1.0 END ELSE row[len(p) + 1] / len(r) END::DOUBLE AS wer, list_filter(r, lambda t: length(t) > 3) AS x, p FROM d WHERE i = len(r)),
v AS (SELECT conv_id, turn, turn % 4 < 2 AS hinted, round(wer, 6) AS wer, round(CASE WHEN len(x) > 0 THEN len(list_filter(x, lambda t: list_contains(p, t))) / len(x) END, 6) AS recall, CAST(tokens AS INTEGER) AS tokens, CASE WHEN conv_id % 2 = 0 THEN 'local' ELSE 'hosted' END AS backend, role AS category FROM e JOIN h USING (conv_id, turn)),
g AS (SELECT backend, CASE WHEN grouping(category) = 1 THEN 'all' ELSE category END AS category, count(*) FILTER (NOT hinted) AS n_plain, count(*) FILTER (hinted) AS n_hinted, avg(wer) FILTER (NOT hinted) AS w0, avg(wer) FILTER (hinted) AS w1, avg(recall) FILTER (NOT hinted) AS r0, avg(recall) FILTER (hinted) AS r1,
{_MEDIAN.format('NOT hinted')} AS tokens_p50_plain, {_MEDIAN.format('hinted')} AS tokens_p50_hinted FROM v GROUP BY GROUPING SETS ((backend, category), (backend)))
SELECT 'score' AS part, conv_id, turn, hinted, wer, recall, tokens, backend, category, NULL::BIGINT AS n_plain, NULL::BIGINT AS n_hinted, NULL::DOUBLE AS wer_plain, NULL::DOUBLE AS wer_hinted, NULL::DOUBLE AS wer_change, NULL::DOUBLE AS recall_plain, NULL::DOUBLE AS recall_hinted, NULL::DOUBLE AS recall_change, NULL::INTEGER AS tokens_p50_plain, NULL::INTEGER AS tokens_p50_hinted FROM v
UNION ALL SELECT 'report', NULL, NULL, NULL, NULL, NULL, NULL, backend, category, n_plain, n_hinted, round(w0, 6), round(w1, 6), round(w1 - w0, 6), round(r0, 6), round(r1, 6), round(r1 - r0, 6), tokens_p50_plain, tokens_p50_hinted FROM g"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"job1_passages": job1_passages, "job2_transcripts": job2_transcripts}


def oracle_sql() -> dict[str, str]:
    return {"job1_passages": PASSAGES_SQL, "job2_transcripts": TRANSCRIPTS_SQL}
