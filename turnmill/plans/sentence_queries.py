"""Queries over sentences and tokens of the given texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from turnmill.functions import text as X
from turnmill.operators import ranks as R, sentences as ST
from turnmill.plans.registry import query, r6, read, words

_CORE = r"""lower(regexp_replace({0}, '^["''“‘(\[{{]+|(?:["''”’)\]}}]|[,;:])+$', '', 'g'))"""
_TYPE = r"CASE WHEN regexp_matches(regexp_replace({0}, '\.$', ''), '^\p{{L}}[\p{{L}}.]*$') AND NOT suffix({0}, '..') THEN regexp_replace({0}, '\.$', '') END"


def core(x: str) -> str:
    return _CORE.format(x)


def typed(x: str) -> str:
    return _TYPE.format(x)


def ll(n: str, k: str, p: str) -> str:
    return f"({k} * ln(greatest({p}, 1e-12)) + ({n} - {k}) * ln(greatest(1 - {p}, 1e-12)))"


#: SQL: w has a row for each word (type, stop, type of the next), a the abbreviations with their scores, s the sentence starters.
LEARNED = rf"""u AS (SELECT doc_id, unnest({words('text')}) AS word, generate_subscripts({words('text')}, 1) AS i FROM documents),
c AS (SELECT doc_id, i, {core('word')} AS c FROM u), n AS (SELECT *, lead(c) OVER (PARTITION BY doc_id ORDER BY i) AS d FROM c),
w AS (SELECT {typed('c')} AS type, suffix(c, '.') AND NOT suffix(c, '..') AS stop, {typed('d')} AS next FROM n),
f AS (SELECT type, count(*) FILTER (stop) AS stopped, count(*) AS total FROM w WHERE type IS NOT NULL GROUP BY type),
p AS (SELECT sum(stopped) / sum(total) AS p FROM f), l AS (SELECT *, length(replace(type, '.', '')) AS m FROM f, p WHERE stopped > 0),
a0 AS (SELECT type, stopped, total, 2 * ({ll('total', 'stopped', '0.99')} - {ll('total', 'stopped', 'p')}) * exp(-m) * (length(type) - m + 1) * pow(m, stopped - total) AS score FROM l),
a AS (SELECT * FROM a0 WHERE score >= 0.3)"""
STARTERS = rf"""e AS (SELECT next FROM w WHERE stop AND type IS NOT NULL AND type NOT IN (SELECT type FROM a)),
k AS (SELECT next AS type, count(*) AS k FROM e WHERE next IS NOT NULL GROUP BY next),
t AS (SELECT CAST(sum(total) AS BIGINT) AS n, (SELECT count(*) FROM e) AS a FROM f),
r AS (SELECT type, k AS after, total, k / a AS inside, total / n AS expected, 2 * ({ll('a', 'k', '(k / a)')} + {ll('(n - a)', '(total - k)', 'coalesce((total - k) / nullif(n - a, 0), 0)')} - {ll('a', 'k', '(total / n)')} - {ll('(n - a)', '(total - k)', '(total / n)')}) AS ratio FROM k JOIN f USING (type), t),
s AS (SELECT type, after, total, ratio FROM r WHERE ratio >= 30 AND inside > expected)"""


def _model(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    docs = read(spark, sf_dir, "documents")
    pairs = R.written(ST.pairs(docs), "word-pairs")  # the one pass over the texts
    short = R.written(ST.abbreviations(docs, of_pairs=pairs), "abbreviations")
    return docs, short, ST.starters(docs, short, of_pairs=pairs)


@query(f"WITH {LEARNED} SELECT type, stopped, total, round(score, 6) AS score FROM a")
def sentence_abbreviations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Abbreviations learned from all documents."""
    return ST.abbreviations(read(spark, sf_dir, "documents")).withColumn("score", r6("score"))


@query(f"WITH {LEARNED}, {STARTERS} SELECT type, after, total, round(ratio, 6) AS ratio FROM s")
def sentence_starters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that begin sentences, learned from all documents."""
    return _model(spark, sf_dir)[2].withColumn("ratio", r6("ratio"))


@query(rf"""WITH {LEARNED}, {STARTERS}, v AS (SELECT doc_id, unnest(regexp_extract_all(text, '\S+\s*')) AS piece, generate_subscripts(regexp_extract_all(text, '\S+\s*'), 1) AS i FROM documents),
x AS (SELECT *, regexp_replace(piece, '\s+$', '') AS word, lead(piece) OVER o AS after FROM v WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
y AS (SELECT doc_id, i, piece, regexp_matches(word, '[.!?…]["''”’)\]}}]*$') AND NOT regexp_matches(after, '^["''“‘(\[{{]*\p{{Ll}}') AS ends, {core('word')} AS c, regexp_replace({core(r"regexp_replace(after, '\s+$', '')")}, '([^.])\.$', '\1') AS d FROM x WHERE after IS NOT NULL),
b AS (SELECT doc_id, i FROM y WHERE ends AND NOT (suffix(c, '.') AND NOT suffix(c, '..') AND (regexp_matches(c, '^\p{{L}}\.$') OR regexp_replace(c, '\.$', '') IN (SELECT type FROM a)) AND d NOT IN (SELECT type FROM s))),
g AS (SELECT v.doc_id, v.i, v.piece, count(b.i) OVER (PARTITION BY v.doc_id ORDER BY v.i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS k FROM v LEFT JOIN b ON v.doc_id = b.doc_id AND v.i = b.i),
z AS (SELECT doc_id, k, regexp_replace(string_agg(piece, '' ORDER BY i), '\s+$', '') AS sentence FROM g GROUP BY doc_id, k),
h AS (SELECT doc_id, count(*) AS sentences, md5(string_agg(sentence, chr(10) ORDER BY k)) AS digest FROM z GROUP BY doc_id)
SELECT doc_id, CASE WHEN text IS NOT NULL THEN coalesce(sentences, 0) END AS sentences, CASE WHEN text IS NOT NULL THEN coalesce(digest, md5('')) END AS digest FROM documents LEFT JOIN h USING (doc_id)""")
def document_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents cut into sentences by what they teach: how many, and a digest of them."""
    docs, short, first = _model(spark, sf_dir)
    s = ST.split(docs, short, R.written(first, "starters"), ["doc_id"])
    return s.select("doc_id", F.when(F.col("sentences").isNotNull(), F.size("sentences").cast("long")).alias("sentences"), F.md5(F.array_join("sentences", "\n")).alias("digest"))


_RULE = r"regexp_extract_all(text, '@url\$|<[\p{L}\p{N}_]+>|\p{Nd}+(?:[.,]\p{Nd}+)+|[\p{L}\p{N}_]+(?:[''’][\p{L}\p{N}_]+)*|\.\.\.|[^\p{L}\p{N}_\s]')"


@query(rf"""WITH d AS (SELECT doc_id, text || ' Don''t go' || doc_id || ', @url$ <person> it’s 3.5...' AS text FROM documents), t AS (SELECT doc_id, unnest({_RULE}) AS t, generate_subscripts({_RULE}, 1) AS i FROM d),
s AS (SELECT doc_id, i, regexp_replace(t, '(?i)^([\p{{L}}\p{{N}}_]+?)(n[''’]t|[''’](?:ve|ll|d|re|s|m))$', '\1 \2') AS t FROM t)
SELECT doc_id, md5(string_agg(t, ' ' ORDER BY i)) AS tokens, CAST(sum(CASE WHEN contains(t, ' ') THEN 2 ELSE 1 END) AS INTEGER) AS n FROM s GROUP BY doc_id""")
def rule_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens by rule of all documents, each with some contractions and placeholders at its end."""
    text = F.concat("text", F.lit(" Don't go"), "doc_id", F.lit(", @url$ <person> it’s 3.5..."))
    t = read(spark, sf_dir, "documents").select("doc_id", X.rule_tokens(text).alias("t")).where(F.col("t").isNotNull())
    return t.select("doc_id", F.md5(F.array_join("t", " ")).alias("tokens"), F.size("t").alias("n"))
