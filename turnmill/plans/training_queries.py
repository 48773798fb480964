"""Queries over training samples, batches, decoded sequences and evaluations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from turnmill.functions import numbers as M
from turnmill.operators import batches as B, decoding as DE, evaluate as V
from turnmill.session import new_path
from turnmill.plans.registry import DIALOGUES, conversations, query, r6, read, words

LEN = f"l AS (SELECT conv_id, turn, len({words('text')}) AS src, len({words('coalesce(nxt, chr(32))')}) AS tgt FROM (SELECT *, lead(text) OVER (PARTITION BY conv_id ORDER BY turn) AS nxt FROM conversations))"
BUCKET = "b AS (SELECT conv_id, turn, src, tgt, least(5, greatest(src // 6, tgt // 6)) AS bucket FROM l)"


def _lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    from turnmill.functions.text import tok

    c = read(spark, sf_dir, "conversations")
    after = c.select("conv_id", (F.col("turn") - 1).alias("turn"), F.size(tok("text")).alias("tgt"))
    return c.select("conv_id", "turn", F.size(tok("text")).alias("src")).join(after, ["conv_id", "turn"], "left").withColumn("tgt", F.coalesce("tgt", F.lit(0)))


@query(f"WITH {LEN}, {BUCKET} SELECT CAST(bucket AS INTEGER) AS bucket, count(*) AS n FROM b GROUP BY bucket")
def bucket_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.bucketed(_lengths(spark, sf_dir), ["src", "tgt"], src_max_len=30, buckets=5).groupBy("bucket").agg(F.count("*").alias("n"))


BATCH = "x AS (SELECT *, (row_number() OVER (PARTITION BY bucket ORDER BY conv_id, turn) - 1) // 16 AS batch FROM b)"


@query(f"WITH {LEN}, {BUCKET}, {BATCH} SELECT conv_id, turn, CAST(bucket AS INTEGER) AS bucket, CAST(batch AS BIGINT) AS batch FROM x")
def batch_assignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = B.bucketed(_lengths(spark, sf_dir), ["src", "tgt"], src_max_len=30, buckets=5)
    return B.batched(rows, 16, ["conv_id", "turn"]).select("conv_id", "turn", "bucket", "batch")


@query(f"WITH {LEN}, {BUCKET}, {BATCH}, y AS (SELECT bucket, batch, count(*) AS n, sum(src) AS t, max(src) AS m FROM x GROUP BY bucket, batch) SELECT CAST(bucket AS INTEGER) AS bucket, count(*) AS batches, CAST(sum(n) AS BIGINT) AS samples, CAST(sum(t) AS BIGINT) AS tokens, CAST(sum(n * m - t) AS BIGINT) AS padded FROM y GROUP BY bucket")
def pad_waste(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = B.batched(B.bucketed(_lengths(spark, sf_dir), ["src", "tgt"], src_max_len=30, buckets=5), 16, ["conv_id", "turn"])
    return B.pad_waste(rows, "src")


@query(f"WITH {LEN} SELECT conv_id, turn, CASE WHEN src < 10 AND tgt < 15 THEN 0 WHEN src < 30 AND tgt < 40 THEN 1 WHEN src < 200 AND tgt < 200 THEN 2 ELSE -1 END AS pair_bucket FROM l")
def pair_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = M.pair_bucket(F.col("src"), F.col("tgt"), [(10, 15), (30, 40), (200, 200)])
    return _lengths(spark, sf_dir).select("conv_id", "turn", F.coalesce(found, F.lit(-1)).alias("pair_bucket"))


CUT = f"list_transform(u[1 : len(u) - 1], lambda x, i: CASE WHEN i < len(u) - 1 THEN list_append({words('x')}[1 : 29], '<SEP>') ELSE {words('x')}[1 : 30] END)"


@query(f"WITH {DIALOGUES}, s AS (SELECT conv_id, flatten({CUT})[1 : 30] AS src, {words('u[len(u)]')}[1 : 30] AS tgt FROM d WHERE len(u) > 1) SELECT conv_id, array_to_string(src, ' ') AS src, '<S> ' || array_to_string(tgt, ' ') AS tgt_in, array_to_string(tgt, ' ') || ' </S>' AS tgt_out, CAST(len(src) AS INTEGER) AS src_len, CAST(len(tgt) + 1 AS INTEGER) AS tgt_len FROM s WHERE len(src) > 0 AND len(tgt) > 0")
def seq_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = B.flat_samples(conversations(spark, sf_dir), src_max_len=30, tgt_max_len=30)
    return rows.select("conv_id", *[F.array_join(c, " ").alias(c) for c in ("src", "tgt_in", "tgt_out")], "src_len", "tgt_len")


@query(f"WITH {DIALOGUES} SELECT conv_id, array_to_string({words('u[1]')}[1 : 20], ' ') AS s1, array_to_string({words('coalesce(u[2], chr(32))')}[1 : 20], ' ') AS s2, array_to_string(list_append({words('coalesce(u[3], chr(32))')}[1 : 25], '</S>'), ' ') AS tgt_out FROM d")
def turn_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = B.turn_samples(conversations(spark, sf_dir), turns=3, src_max_len=20, tgt_max_len=25)
    return rows.select("conv_id", F.array_join(F.element_at("srcs", 1), " ").alias("s1"), F.array_join(F.element_at("srcs", 2), " ").alias("s2"), F.array_join("tgt_out", " ").alias("tgt_out"))


@query(f"WITH {DIALOGUES}, s AS (SELECT conv_id, {words('u[len(u) - 1]')}[1 : 30] AS tgt, {words('u[len(u)]')}[1 : 5] AS topic FROM d WHERE len(u) > 2) SELECT conv_id, array_to_string(tgt, ' ') AS tgt, array_to_string(topic, ' ') AS topic, CAST(len(topic) AS INTEGER) AS topic_len FROM s WHERE len(tgt) > 0 AND len(topic) > 0")
def topical_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = B.flat_samples(conversations(spark, sf_dir), src_max_len=30, tgt_max_len=30, topical=True, topic_words=5)
    return rows.select("conv_id", F.array_join("tgt", " ").alias("tgt"), F.array_join("topic", " ").alias("topic"), "topic_len")


@query(f"WITH {LEN}, {BUCKET}, {BATCH} SELECT conv_id, turn, CAST(max(src) OVER (PARTITION BY bucket, batch) AS INTEGER) AS width FROM x")
def padded_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = B.batched(B.bucketed(_lengths(spark, sf_dir), ["src", "tgt"], src_max_len=30, buckets=5), 16, ["conv_id", "turn"])
    rows = rows.withColumn("ids", F.array_repeat(F.lit(7).cast("bigint"), F.col("src")))
    return B.padded(rows, ["ids"]).select("conv_id", "turn", F.size("ids").alias("width"))


PAIRS = "p AS (SELECT conv_id || ':' || turn AS key, text AS hypothesis, lead(text) OVER (PARTITION BY conv_id ORDER BY turn) AS reference FROM conversations QUALIFY reference IS NOT NULL)"


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each turn as the hypothesis for the next."""
    c = read(spark, sf_dir, "conversations")
    key = lambda turn: F.concat_ws(":", "conv_id", turn).alias("key")
    return c.select(key(F.col("turn")), F.col("text").alias("hypothesis")).join(c.where(F.col("turn") > 0).select(key(F.col("turn") - 1), F.col("text").alias("reference")), "key")


def _bleu_sql(max_order: int = 4) -> str:
    grams = lambda side: " UNION ALL ".join(f"SELECT key, {n} AS n, unnest(list_transform(range(1, greatest(len({side}) - {n - 2}, 1)), lambda i: array_to_string({side}[i : i + {n - 1}], ' '))) AS g FROM w" for n in range(1, max_order + 1))
    precision = [f"(coalesce((SELECT sum(m) FROM o WHERE n = {n}), 0) + 1.0) / ((SELECT sum(greatest(len(h) - {n - 1}, 0)) FROM w) + 1.0)" for n in range(1, max_order + 1)]
    return f"""WITH {PAIRS}, w AS (SELECT key, {words('hypothesis')} AS h, {words('reference')} AS r FROM p), a AS (SELECT key, n, g, count(*) AS c FROM ({grams('h')}) GROUP BY ALL), b AS (SELECT key, n, g, count(*) AS c FROM ({grams('r')}) GROUP BY ALL),
o AS (SELECT a.n, sum(least(a.c, b.c)) AS m FROM a JOIN b USING (key, n, g) GROUP BY a.n), z AS (SELECT (SELECT sum(len(h)) FROM w) AS hl, (SELECT sum(len(r)) FROM w) AS rl, {', '.join(f'{p} AS p{n}' for n, p in enumerate(precision, 1))})
SELECT round(exp((ln(p1) + ln(p2) + ln(p3) + ln(p4)) / 4) * CASE WHEN hl / rl > 1 THEN 1.0 ELSE exp(1 - rl / hl) END, 6) AS bleu, round(CASE WHEN hl / rl > 1 THEN 1.0 ELSE exp(1 - rl / hl) END, 6) AS brevity_penalty, round(hl / rl, 6) AS ratio, CAST(hl AS BIGINT) AS hypothesis_length, CAST(rl AS BIGINT) AS reference_length FROM z"""


@query(_bleu_sql())
def bleu_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _pairs(spark, sf_dir).withColumn("references", F.array("reference"))
    return V.bleu(rows, key="key", smooth=True).select(*[r6(c).alias(c) for c in ("bleu", "brevity_penalty", "ratio")], "hypothesis_length", "reference_length")


@query("WITH p AS (SELECT event_type AS reference, lag(event_type) OVER (ORDER BY event_id) AS hypothesis FROM events) SELECT round(avg(CASE WHEN reference = coalesce(hypothesis, '') THEN 100.0 ELSE 0 END), 6) AS line_accuracy FROM p")
def line_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events")
    pairs = V.aligned(e.select(F.col("event_id").alias("line_no"), F.col("event_type").alias("value")), e.select((F.col("event_id") + 1).alias("line_no"), F.col("event_type").alias("value")), keep_all=True)
    return V.line_accuracy(pairs).select(r6("line_accuracy").alias("line_accuracy"))


@query(f"WITH {PAIRS}, w AS (SELECT string_split(trim(reference), ' ') AS r, string_split(trim(hypothesis), ' ') AS h FROM p) SELECT round(avg(100.0 * len(list_filter(range(1, least(len(r), len(h)) + 1), lambda i: r[i] = h[i])) / greatest(len(r), len(h))), 6) AS word_accuracy FROM w")
def word_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.word_accuracy(_pairs(spark, sf_dir)).select(r6("word_accuracy").alias("word_accuracy"))


@query("SELECT event_type, round(exp(sum(value / 100 * (user_id + 1)) / sum(user_id + 2)), 6) AS perplexity FROM events GROUP BY event_type")
def perplexity(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events").select("event_type", (F.col("value") / 100).alias("loss"), (F.col("user_id") + 1).alias("batch_size"), (F.col("user_id") + 2).alias("predict_count"))
    return V.perplexity(e, by=["event_type"]).withColumn("perplexity", r6("perplexity"))


@query("SELECT round(exp(sum(value / 100 * (user_id + 1)) / sum(user_id + 2)), 6) AS perplexity FROM events")
def perplexity_overall(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events").select((F.col("value") / 100).alias("loss"), (F.col("user_id") + 1).alias("batch_size"), (F.col("user_id") + 2).alias("predict_count"))
    return V.perplexity(e).select(r6("perplexity").alias("perplexity"))


@query("SELECT vec_id, round(coalesce(list_sum(list_transform(embedding[1 : label + 3], lambda x: CAST(abs(x) AS DOUBLE))), 0), 5) AS loss FROM embeddings")
def masked_loss(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first components of each vector as the cross entropies of a sequence."""
    e = read(spark, sf_dir, "embeddings")
    return e.select("vec_id", F.round(V.masked_loss(F.transform("embedding", lambda x: F.abs(x).cast("double")), F.col("label") + 3), 5).alias("loss"))


@query("SELECT event_type, round(avg(value), 6) AS step_time, round(avg(user_id), 6) AS grad_norm, round(sum(user_id) / 1000 / sum(value), 6) AS kwords_per_s, round(exp(sum(value / 100 * user_id) / sum(user_id + 1)), 6) AS perplexity, false AS overflow FROM events GROUP BY event_type")
def train_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = read(spark, sf_dir, "events").select("event_type", (F.col("value") / 100).alias("loss"), F.col("user_id").alias("batch_size"), (F.col("user_id") + 1).alias("predict_count"), F.col("value").alias("step_time"), F.col("user_id").alias("grad_norm"), F.col("user_id").alias("word_count"))
    return V.train_stats(log, "event_type").withColumns({c: r6(c) for c in ("step_time", "grad_norm", "kwords_per_s", "perplexity")})


@query("SELECT o_orderkey AS step, CASE WHEN o_orderkey < 1200 THEN 1.0 ELSE power(0.5, (o_orderkey - 1200) // 150) END AS luong234, CASE WHEN o_orderkey < 900 THEN 1.0 ELSE power(0.5, (o_orderkey - 900) // 90) END AS luong10, CASE WHEN o_orderkey < 100 THEN 0.5 ELSE 0.5 * power(0.9, (o_orderkey - 100) // 50) END AS manual FROM orders")
def lr_schedule(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rates at the orders' keys as steps, of a run of 1,800."""
    s = F.col("step")
    steps = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("step"))
    return steps.select(s, M.decayed(1.0, s, 1800, "luong234").alias("luong234"), M.decayed(1.0, s, 1800, "luong10").alias("luong10"), M.decayed(0.5, s, 1800, "manual", 100, 50, 0.9).alias("manual"))


@query("SELECT event_id, CAST(floor(3 * ceil(value * 100 / 16)) AS BIGINT) AS steps, coalesce(value / nullif(user_id % 7, 0), 0) AS quotient, coalesce(user_id % nullif(user_id % 5, 0), 0) AS rest, CAST(round_even(value * 2, 0) AS INTEGER) AS decode_steps FROM events")
def safe_math(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events")
    return e.select("event_id", M.train_steps(F.lit(3), F.col("value") * 100, F.lit(16)).alias("steps"), M.safe_div(F.col("value"), F.col("user_id") % 7).alias("quotient"), M.safe_mod(F.col("user_id"), F.col("user_id") % 5).cast("bigint").alias("rest"), M.decode_steps(F.col("value"), 2.0).alias("decode_steps"))


LOG = "e AS (SELECT event_id AS step, CAST(100 AS DOUBLE) / (CAST(1 AS DOUBLE) + event_id * CAST(0.001 AS DOUBLE)) + value * CAST(0.05 AS DOUBLE) AS ppl FROM events)"


@query(f"""WITH {LOG}, b AS (SELECT *, min(ppl) OVER (ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev FROM e),
c AS (SELECT *, prev IS NULL OR ppl < prev AS new, CASE WHEN ppl >= prev AND ppl > CAST(1.003 AS DOUBLE) * prev THEN 1 ELSE 0 END AS cost FROM b),
r AS (SELECT *, sum(CASE WHEN new THEN 1 ELSE 0 END) OVER (ORDER BY step ROWS UNBOUNDED PRECEDING) AS run FROM c),
f AS (SELECT step, coalesce(least(prev, ppl), ppl) AS best, greatest(5 - sum(cost) OVER (PARTITION BY run ORDER BY step ROWS UNBOUNDED PRECEDING), 0) AS left_ FROM r)
SELECT step, round(best, 6) AS best, CAST(left_ AS BIGINT) AS patience_left, max(CASE WHEN left_ <= 0 THEN 1 ELSE 0 END) OVER (ORDER BY step ROWS UNBOUNDED PRECEDING) = 1 AS stopped FROM f""")
def early_stop(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Patience and best value along a log of all events."""
    log = read(spark, sf_dir, "events").select(F.col("event_id").alias("step"), (F.lit(100.0) / (F.lit(1.0) + F.col("event_id") * F.lit(0.001)) + F.col("value") * F.lit(0.05)).alias("ppl"))
    return V.early_stopping(log, "step", "ppl", 5, 1.003).select("step", r6("best").alias("best"), F.col("left").alias("patience_left"), "stopped")


@query(f"WITH w AS (SELECT conv_id, turn, {words('text')} AS w FROM conversations) SELECT conv_id, turn, array_to_string(CASE WHEN len(w) > 3 THEN w[1 : 3] ELSE w END, ' ') AS decoded FROM w")
def decode_cut(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words up to an end mark, put in after the third."""
    from turnmill.functions.text import tok

    w = tok("text")
    marked = F.when(F.size(w) > 3, F.concat(F.slice(w, 1, 3), F.array(F.lit("</S>")), F.slice(w, F.lit(4), F.greatest(F.size(w), F.lit(0))))).otherwise(w)
    return read(spark, sf_dir, "conversations").select("conv_id", "turn", V.cut_at_end(marked).alias("decoded"))


@query("SELECT vec_id, CAST(b AS INTEGER) AS beam, CAST(embedding[b + 1] * 1000 AS INTEGER) || ' ' || CAST(embedding[b + 3] * 1000 AS INTEGER) AS ids FROM embeddings, (SELECT unnest([0, 1]) AS b)")
def beam_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two steps of two beams, beam by beam."""
    # in floats as the vectors are: with an integer Spark would multiply in doubles, and halves would round otherwise
    at = lambda k: F.bround(F.try_element_at("embedding", F.lit(k)) * F.lit(1000).cast("float")).cast("int")
    rows = read(spark, sf_dir, "embeddings").withColumn("steps", F.array(F.array(at(1), at(2)), F.array(at(3), at(4))))
    return V.beam_major(rows, "vec_id").select("vec_id", "beam", F.concat(F.col("ids")[0].cast("string"), F.lit(" "), F.col("ids")[1].cast("string")).alias("ids"))


@query("SELECT event_type, min(event_id) FILTER (value = m) AS step, min(value) AS value FROM (SELECT *, min(value) OVER (PARTITION BY event_type) AS m FROM events) GROUP BY event_type")
def best_checkpoint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.best_checkpoint(read(spark, sf_dir, "events"), "event_id", "value", "event_type").withColumnRenamed("event_id", "step")


@query("SELECT user_id, event_id, rank FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY -value / power((5 + user_id % 7) / 6.0, 0.5) DESC, event_id) AS rank FROM events) WHERE rank <= 3")
def ranked_beams(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as beams of users, three responses each."""
    rows = read(spark, sf_dir, "events").select("user_id", "event_id", (-F.col("value")).alias("log_prob"), (F.col("user_id") % 7).alias("length"))
    return V.ranked_beams(rows, "user_id", "log_prob", "length", 0.5, 3).select("user_id", "event_id", F.col("rank").cast("bigint").alias("rank"))


@query("SELECT doc_id FROM documents ORDER BY n_chars, doc_id LIMIT 25")
def row_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.first_rows(read(spark, sf_dir, "documents"), 25, ["n_chars", "doc_id"]).select("doc_id")


@query("SELECT doc_id FROM documents ORDER BY md5('3:' || doc_id), doc_id LIMIT 5")
def dev_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five rows by a seeded digest (a sampling operator)."""
    return B.sample(read(spark, sf_dir, "documents"), 5, "doc_id", seed=3).select("doc_id")


@query(f"WITH {LEN}, {BUCKET}, {BATCH}, k AS (SELECT DISTINCT bucket, batch FROM x), n AS (SELECT bucket, batch, row_number() OVER (ORDER BY md5('3:' || CAST(bucket AS INTEGER) || ':' || CAST(batch AS BIGINT))) - 1 AS number FROM k) SELECT conv_id, turn, number FROM x JOIN n USING (bucket, batch) WHERE number >= (SELECT (3 * count(*) + 7) % count(*) FROM n)")
def training_resume(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of the fourth epoch after seven of its batches, from batches that are stored by number."""
    rows = B.batched(B.bucketed(_lengths(spark, sf_dir), ["src", "tgt"], src_max_len=30, buckets=5), 16, ["conv_id", "turn"])
    path = new_path(spark, "epoch")
    n = B.store_epoch(rows, path, seed=3, part=4)
    return B.resumed(spark, path, 3 * n + 7, rows.schema, part=4).select("conv_id", "turn", "number")


@query()
def beam_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three best continuations of each conversation's first word, by what follows what in all conversations (checked against a search sample by sample)."""
    c = read(spark, sf_dir, "conversations")
    starts = c.where("turn = 0").select("conv_id", F.element_at(F.split(F.trim("text"), r"\s+"), 1).alias("first")).where("first <> ''")
    found = DE.beam_search(starts, DE.next_words(c), key="conv_id", start="first", width=3, max_length=8, penalty=1.0)
    return found.select("conv_id", "rank", F.array_join("words", " ").alias("response"), r6("log_prob").alias("log_prob"))
