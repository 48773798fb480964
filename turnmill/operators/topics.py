"""Topic models: preparation of documents, training, topics of documents and utterances."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.ml.clustering import LDA
from pyspark.ml.feature import CountVectorizerModel, StopWordsRemover
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, functions as F

from turnmill.functions.text import tok, topic_terms
from turnmill.operators.ranks import written
from turnmill.operators.stats import most_frequent, term_frequency

NO_TOPIC = "<NO_TOPIC>"


def stopwords() -> list[str]:
    return StopWordsRemover.loadDefaultStopWords("english")


def prepare(texts: DataFrame, *, text: str = "text", min_word_length: int = 3, min_utterance_length: int = 3, drop_frequent: int = 400, drop_lines: DataFrame | None = None, key: str | None = None) -> DataFrame:
    """texts with kept: the words of min_word_length characters that aren't among the drop_frequent most frequent of the corpus; lines with fewer than min_utterance_length of them go.

    The frequent words are a list of drop_frequent at most, so they are a literal of the plan.
    """
    if drop_lines is not None and key:
        texts = texts.join(drop_lines.select(key), key, "left_anti")
    frequent = [r["word"] for r in most_frequent(term_frequency(texts, text), drop_frequent).select("word").collect()] if drop_frequent else []
    kept = F.filter(tok(text), lambda w: (F.length(w) >= min_word_length) & (~w.isin(*frequent) if frequent else F.lit(True)))
    # through a generator, so that the words are made once: a filter on a projected column would be pushed below it and make them twice
    return texts.select("*", F.explode(F.array(kept)).alias("kept")).where(F.size("kept") >= min_utterance_length)


def train(docs: DataFrame, *, text: str = "text", n_topics: int = 200, no_below: float = 600, no_above: float = 0.5, keep_n: int = 100_000, passes: int = 70, min_length: int | None = None, seed: int = 1) -> PipelineModel:
    """Vectorizer and LDA, learned online. docs: one row per document.

    The vocabulary is the keep_n terms of the most documents, among those in no_below documents at least and a share of no_above at most; ties go by the term,
    so that equal input gives an equal vocabulary.
    """
    rows = docs.withColumn("terms", topic_terms(tok(text), stopwords(), min_length))
    df = rows.select(F.explode(F.array_distinct("terms")).alias("term")).groupBy("term").count().where(F.col("count") >= no_below)
    if no_above < 1:
        df = df.where(F.col("count") <= no_above * rows.count())
    vocabulary = [r["term"] for r in df.orderBy(F.desc("count"), "term").limit(keep_n).collect()]  # keep_n terms at most
    if not vocabulary:
        raise ValueError("no term is left: lower no_below or raise no_above")
    vectors = CountVectorizerModel.from_vocabulary(vocabulary, inputCol="terms", outputCol="counts")
    lda = LDA(k=n_topics, maxIter=passes, optimizer="online", featuresCol="counts", topicDistributionCol="topics", seed=seed, optimizeDocConcentration=True)
    made = written(vectors.transform(rows).select("counts"), "term-vectors")  # read once a pass; the texts are split into terms once
    return PipelineModel([vectors, lda.fit(made)])


def words_of_topics(model: PipelineModel, n: int = 100) -> DataFrame:
    """(topic, words): the n foremost terms of each topic."""
    words = model.stages[0].vocabulary
    described = model.stages[1].describeTopics(n)
    named = [(r["topic"], [words[i] for i in r["termIndices"]]) for r in described.select("topic", "termIndices").collect()]  # n terms for each topic
    return described.sparkSession.createDataFrame(named, "topic int, words array<string>")


def argmax(v: Column) -> Column:
    """0-based place of the greatest value, -1 for none."""
    return F.when(F.size(v) > 0, F.array_position(v, F.array_max(v)).cast("int") - 1).otherwise(F.lit(-1))


def infer(docs: DataFrame, model: PipelineModel, *, text: str = "text", n_words: int = 100, min_length: int | None = None) -> DataFrame:
    """docs with topic (-1 where no term is known) and topic_words."""
    rows = model.transform(docs.withColumn("terms", topic_terms(tok(text), stopwords(), min_length)))
    some = F.size(F.filter(vector_to_array("counts"), lambda c: c > 0)) > 0
    rows = rows.withColumn("topic", F.when(some, argmax(vector_to_array("topics"))).otherwise(F.lit(-1))).drop("terms", "counts", "topics")
    named = words_of_topics(model, n_words).withColumnRenamed("words", "topic_words")  # one row per topic
    return rows.join(F.broadcast(named), "topic", "left").withColumn("topic_words", F.coalesce("topic_words", F.array().cast("array<string>")))


def infer_dialogues(dialogues: DataFrame, model: PipelineModel, *, column: str = "utterances", n_words: int = 100, with_response: bool = False, min_length: int | None = None) -> DataFrame:
    """dialogues with the topic of their context: all utterances but the response, unless with_response."""
    used = F.col(column) if with_response else F.slice(column, F.lit(1), F.greatest(F.size(column) - 1, F.lit(0)))
    return infer(dialogues.withColumn("_text", F.array_join(used, " ")), model, text="_text", n_words=n_words, min_length=min_length).drop("_text")


def topical_lines(rows: DataFrame, column: str = "utterances") -> DataFrame:
    """One text line per row: utterances and, as the last column, topic words or <NO_TOPIC>."""
    words = F.when(F.size("topic_words") > 0, F.array_join("topic_words", " ")).otherwise(F.lit(NO_TOPIC))
    return rows.select(F.concat_ws("\t", F.array_join(column, "\t"), words).alias("value"))


def bag_of_words(docs: DataFrame, key: str, terms: str = "terms") -> DataFrame:
    """(key, word, n)."""
    return docs.select(key, F.explode(terms).alias("word")).groupBy(key, "word").agg(F.count("*").alias("n"))


def document_frequency(docs: DataFrame, terms: str = "terms", no_below: int = 1, no_above: float = 1.0, keep_n: int | None = None) -> DataFrame:
    """(word, df, tf) of the words in no_below documents at least and a share of no_above at most; the keep_n most frequent. docs: one row per document.

    A document's distinct words are marked where it is, so what is shuffled is one partial count per word and task.
    """
    once = F.transform(F.array_distinct(terms), lambda t: F.struct(t.alias("word"), F.lit(1).alias("df"), F.lit(0).alias("tf")))
    each = F.transform(terms, lambda t: F.struct(t.alias("word"), F.lit(0).alias("df"), F.lit(1).alias("tf")))
    bag = docs.select(F.inline(F.concat(once, each))).groupBy("word").agg(F.sum("df").alias("df"), F.sum("tf").alias("tf"))
    total = docs.agg(F.count("*").alias("_docs"))
    kept = bag.crossJoin(total).where((F.col("df") >= no_below) & (F.col("df") <= no_above * F.col("_docs"))).drop("_docs")  # one row on the right
    return kept.orderBy(F.desc("df"), "word").limit(keep_n) if keep_n else kept
