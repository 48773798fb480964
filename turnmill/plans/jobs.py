"""Whole jobs: raw dumps to posts, posts to dialogues and samples, corpus reports, topic models."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.ml import PipelineModel
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from turnmill.functions import text as X
from turnmill.functions.text import rule_tokens
from turnmill.functions.tweets import normalize_post
from turnmill.operators import batches as B, dialogues as D, evaluate as EV, ngrams as N, posts as P, sanitize as Z, stats as S, threads as T, topics as TP, vocab as V
from turnmill.operators.ranks import ranked, written
from turnmill.session import adopt
from turnmill.sources import readers as R, writers as W
from turnmill.streaming import ingest


def _judge(posts: DataFrame, *, bots: str | None, rules: DataFrame | None, emoticons: list[str] | None, max_chars: int, max_words: int | None, min_words: int) -> DataFrame:
    spark = posts.sparkSession
    return P.judged(adopt(posts), bots=R.bots(spark, bots) if bots else None, rules=rules, normalize=lambda t: normalize_post(t, emoticons), max_chars=max_chars, max_words=max_words, min_words=min_words, tokens=rule_tokens)


def ingest_posts(spark: SparkSession, out: str, *, comments: str | None = None, submissions: str | None = None, subreddits: str | None = None, bots: str | None = None, emoticons: str | None = None, max_chars: int = 150, max_words: int | None = None, min_words: int = 2, stream: bool = False, checkpoint: str | None = None, min_chars: int = 5, batch_size: int = 100_000) -> DataFrame | None:
    """JSON lines of comments or submissions to a table of posts; returns the reasons of rejection (None when streaming).

    stream: files that arrive in the folder, exactly once, going on from the checkpoint. min_chars and batch_size are accepted for old command lines; the first never had an effect,
    and partitions take the place of the second.
    """
    del min_chars, batch_size
    if bool(comments) == bool(submissions):
        raise ValueError("give comments or submissions")
    rules = R.rules(spark, subreddits) if subreddits else None
    schema = P.COMMENT if comments else P.SUBMISSION
    path = comments or submissions
    raw = ingest.json_stream(spark, path, schema) if stream else R.json_lines(spark, path, schema)
    posts = P.comment_posts(raw) if comments else P.submission_posts(raw, rules)
    listed = R.terms(emoticons) if emoticons else None
    judged = _judge(posts, bots=bots, rules=rules, emoticons=listed, max_chars=max_chars, max_words=max_words, min_words=min_words)
    if stream:
        ingest.write_posts(P.accepted(judged).select(*P.NAMES), out, checkpoint or f"{out}.checkpoint").awaitTermination()
        return None
    judged = written(judged, "judged")
    W.posts(P.accepted(judged), out)
    return P.report(judged)


def build_dialogues(spark: SparkSession, posts: str, out: str) -> None:
    """Root-to-leaf dialogues of a table of posts."""
    W.dialogues(T.dialogues(spark.read.parquet(posts)), out)


def prepare_windows(spark: SparkSession, dialogues: str, turns: int, min_length: int = 2, drop_last: bool = True) -> str:
    """N-turn lines of dialogue lines, each once."""
    return W.windows(D.windows(R.dialogue_lines(spark, dialogues), turns, drop_last=drop_last, min_length=min_length), dialogues, turns)


def thread_documents(spark: SparkSession, posts: str, out: str) -> None:
    rows = spark.read.parquet(posts)
    if "line_no" not in rows.columns:
        rows = ranked(rows, [F.col("created_utc"), F.col("id")], "line_no")
    W.thread_documents(T.thread_documents(rows), out)


def sanitize(spark: SparkSession, data: str, profanities: str) -> dict:
    """Filtered lines beside the data; returns the counts."""
    rows, terms = R.dialogue_lines(spark, data), R.terms(profanities)
    W.filtered(Z.sanitize(rows, terms), data)
    return Z.report(rows, terms).first().asDict()


def analyze(spark: SparkSession, data: str, *, separator: str = "\t", n_frequents: int = -1, n_rares: int = -1, vocab_size: int = 0, min_freq: int = 1, save_tf: bool = False) -> dict:
    """Statistics of a corpus of lines; most frequent and rarest words and the term frequencies are written beside it on demand."""
    rows = R.dialogue_lines(spark, data, separator)
    utterances = written(S.utterances(rows), "utterances")
    tf = written(S.first_positions(utterances, ["line_no", "turn"]), "tf")
    out = S.report(rows).first().asDict() | {"lengths": [r.asDict() for r in S.length_stats(utterances, ["turn"], rollup=True).collect()]}
    if vocab_size or min_freq > 1:
        out |= S.coverage(tf, vocab_size, min_freq, "first").first().asDict()
    order = [F.desc("tf"), F.col("first")]
    if n_frequents > 0:
        W.ordered_words(S.most_frequent(tf, n_frequents, "first"), [F.col("rank")], f"{data}.top{n_frequents}")
    if n_rares > 0:
        W.ordered_words(S.rarest(tf, n_rares, ties="first"), [F.col("rank")], f"{data}.bottom{n_rares}")
    if save_tf:
        W.ordered_words(tf, order, f"{data}.tf", ["word", "tf"])
    return out


def ngrams(spark: SparkSession, data: str, orders: list[int], operation: str = "count", separator: str = "\t", compat: bool = False) -> DataFrame:
    """count: approximate numbers of distinct n-grams; rank: n-grams above ten, written beside the data."""
    texts = S.utterances(R.dialogue_lines(spark, data, separator)).select("text")
    if operation == "count":
        return N.distinct(texts, orders, compat=compat)
    if operation != "rank":
        raise ValueError(f"unknown operation {operation}")
    found = written(N.counts(texts, orders, compat=compat), "ngrams")
    W.ngrams(found, data)
    return found


def preprocess_lda(spark: SparkSession, data: str, out: str, *, min_word_length: int = 3, min_utterance_length: int = 3, n_frequents_to_drop: int = 400, ngrams_file: str | None = None, seed: int = 0) -> None:
    """Kept words and the lines that they come from; lines that hold listed n-grams too often are thinned out first."""
    lines = R.text_lines(spark, data).withColumnRenamed("value", "text")
    drop = None
    if ngrams_file:
        drop = N.thinned(lines, R.ngram_counts(spark, ngrams_file).withColumnRenamed("freq", "quota"), seed=seed)
    W.topic_preparation(TP.prepare(lines, min_word_length=min_word_length, min_utterance_length=min_utterance_length, drop_frequent=n_frequents_to_drop, drop_lines=drop, key="line_no"), out)


def train_topics(spark: SparkSession, data: str, model_dir: str, *, n_topics: int = 200, no_below: float = 600, min_length: int | None = None, passes: int = 70) -> PipelineModel:
    model = TP.train(R.document_lines(spark, data), n_topics=n_topics, no_below=no_below, passes=passes, min_length=min_length)
    model.write().overwrite().save(model_dir)
    arguments = json.dumps({"n_topics": n_topics, "no_below": no_below, "min_length": min_length, "passes": passes})
    spark.createDataFrame([(arguments,)], "value string").coalesce(1).write.mode("overwrite").text(f"{model_dir}.arguments")
    return model


def topic_arguments(spark: SparkSession, model_dir: str) -> dict:
    """What a topic model was trained with."""
    return json.loads(spark.read.text(f"{model_dir}.arguments").first()["value"])


def infer_topics(spark: SparkSession, data: str, model_dir: str, out: str, *, dialogue_as_doc: bool = True, n_words: int = 100) -> None:
    """Lines with topic words; dialogue_as_doc: one topic for a dialogue's context, else one for each utterance. Terms are cut as they were in training."""
    model = PipelineModel.load(model_dir)
    min_length = topic_arguments(spark, model_dir)["min_length"]
    rows = R.dialogue_lines(spark, data)
    if dialogue_as_doc:
        W.topical(TP.infer_dialogues(rows, model, n_words=n_words, min_length=min_length), out)
    else:
        each = TP.infer(R.utterance_rows(rows), model, n_words=n_words, min_length=min_length)
        W.topical(each.withColumn("utterances", F.array("text")), out)


def training_batches(dialogues: DataFrame, vocab: DataFrame, *, key: str, kind: str = "flat", turns: int = 3, src_max_len: int | None = 30, tgt_max_len: int | None = 30, buckets: int = 5, batch_size: int = 128, topical: bool = False, topic_words: int | None = None) -> DataFrame:
    """Samples of dialogues as padded batches of ids; kind: flat (one source sequence) or turns (one per turn)."""
    if kind == "flat":
        rows = B.flat_samples(dialogues, src_max_len=src_max_len, tgt_max_len=tgt_max_len, topical=topical, topic_words=topic_words)
        columns, lengths = ["src", "tgt_in", "tgt_out"], ["src_len", "tgt_len"]
    else:
        rows = B.turn_samples(dialogues, turns=turns, src_max_len=src_max_len, tgt_max_len=tgt_max_len, topical=topical, topic_words=topic_words)
        rows = rows.withColumns({f"src_{i}": F.element_at("srcs", i) for i in range(1, turns)}).withColumns({f"src_len_{i}": F.element_at("src_lens", i) for i in range(1, turns)})
        columns, lengths = [*[f"src_{i}" for i in range(1, turns)], "tgt_in", "tgt_out"], [*[f"src_len_{i}" for i in range(1, turns)], "tgt_len"]
    columns += ["topic"] * topical
    rows = written(rows, "samples")
    rows = V.encode_all(rows, vocab, columns, key)
    rows = B.batched(B.bucketed(rows, lengths, src_max_len=src_max_len, buckets=buckets), batch_size, [key])
    return B.padded(rows, columns).select(key, "bucket", "batch", *columns, *lengths)


def test_model(spark: SparkSession, data: str, out: str, decode: Callable, losses: Callable | None = None, *, src_max_len: int | None = 30, tgt_max_len: int | None = 30, beam_width: int = 0, length_penalty: float = 0.0, temperature: float = 0.0) -> dict:
    """Dialogue lines through a model of the caller's: responses at out/output_{label}, and the perplexity over the lines with a target.

    decode: Arrow batches of (line_no, src) to (line_no, responses); losses: of (line_no, src, tgt_in, tgt_out, tgt_len) to (loss, batch_size, predict_count).
    """
    rows = R.dialogue_lines(spark, data)
    samples = B.flat_samples(rows, src_max_len=src_max_len, tgt_max_len=tgt_max_len).select("line_no", "src", "tgt_in", "tgt_out", "tgt_len")
    label = EV.output_label(data, beam_width, length_penalty, temperature)
    W.responses(EV.score(samples.select("line_no", "src"), decode, "line_no bigint, responses string").orderBy("line_no"), out, label)
    result = {"output": f"{out}/output_{label}"}
    if losses:
        ppl = EV.perplexity(EV.score(samples, losses, "loss double, batch_size bigint, predict_count bigint"))
        result |= ppl.select("perplexity", EV.result_line(F.lit("test"), F.col("perplexity")).alias("result")).first().asDict()
    return result


def vocabulary(texts: DataFrame, max_size: int, order: list[str], text: str = "text") -> DataFrame:
    """Vocabulary with ties by first appearance. order: columns that say where a text stands."""
    return V.build(S.first_positions(texts, order, text), max_size, "first")


def normalized(x: Column) -> Column:
    """The native steps of normalization only, for text without markdown or emoticons."""
    return X.normalize_after_emoticons(X.normalize_before_emoticons(X.strip_quotes(x)))
