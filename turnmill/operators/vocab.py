"""Vocabularies, token ids and back, out-of-vocabulary words, topic vocabularies."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F, types as T

from turnmill.functions.text import basic_tokens, no_nbsp, tok, zero_digits
from turnmill.operators.ranks import ranked, top
from turnmill.session import adopt, release

# Reserved words in the order of their ids, and those of the older layout.
RESERVED = ["<UNK>", "<S>", "</S>", "<SEP>"]
RESERVED_OLD = ["_PAD", "_GO", "_EOS", "_UNK"]
UNK, START, END, SEP = range(4)


def with_reserved(words: DataFrame, reserved: list[str]) -> DataFrame:
    """(id, word, tf): reserved words first, then `words` (rank from 1, word, tf)."""
    listed = words.sparkSession.range(1, numPartitions=1).select(F.posexplode(F.array(*[F.lit(w) for w in reserved]).cast("array<string>")).alias("id", "word"))
    head = listed.select(F.col("id").cast("bigint").alias("id"), "word", F.lit(None).cast("bigint").alias("tf"))
    return head.unionByName(words.select((F.col("rank") + len(reserved) - 1).alias("id"), "word", "tf"))


def build(tf: DataFrame, max_size: int, ties: str | Column = "word", reserved: list[str] | None = None, drop_reserved: bool = True) -> DataFrame:
    """Vocabulary of at most max_size words, reserved ones included. tf: word, tf and the column that settles ties (first: order of appearance)."""
    reserved = RESERVED if reserved is None else reserved
    if drop_reserved:
        tf = tf.where(~F.col("word").isin(*reserved))
    return with_reserved(top(tf, [F.desc("tf"), F.col(ties) if isinstance(ties, str) else ties], max(0, max_size - len(reserved))), reserved)


def build_old(texts: DataFrame, max_size: int, text: str = "text", normalize_digits: bool = True) -> DataFrame:
    """The older layout: basic tokens, digits as 0, other reserved words, which aren't taken from the counts."""
    words = basic_tokens(text)
    words = F.transform(words, zero_digits) if normalize_digits else words
    tf = texts.select(F.explode(words).alias("word")).groupBy("word").agg(F.count("*").alias("tf"))
    return build(tf, max_size, reserved=RESERVED_OLD, drop_reserved=False)


def words_of(text: Column | str, normalize_digits: bool = False) -> Column:
    words = tok(no_nbsp(text))
    return F.transform(words, zero_digits) if normalize_digits else words


#: A vocabulary is broadcast up to this many words (its size is a parameter); a larger one is joined by shuffle.
BROADCAST_WORDS = 200_000


def _looked_up(rows: DataFrame, vocab: DataFrame, steps: list[tuple[str, str, str, int | str]]) -> DataFrame:
    """rows with lists of words as ids, or of ids as words, looked up where they are in a broadcast vocabulary.

    steps: (list, what it becomes, the vocabulary's column of that, what stands for unknown values); a step may take the list that an earlier one made. The values of a
    batch are one flat array, so a batch is one hashed lookup; nothing is shuffled or put back together, and one Python process a task takes all steps.
    """
    rows = adopt(rows)
    table = vocab.select("word", "id").toArrow()  # BROADCAST_WORDS rows at most
    sent = rows.sparkSession.sparkContext.broadcast({c: table.column(c).combine_chunks() for c in ("word", "id")})
    made = {out: T.ArrayType(vocab.schema[to].dataType) for _, out, to, _ in steps}
    given = [c for k, (c, *_) in enumerate(steps) if c not in [out for _, out, *_ in steps[:k]]]
    rows = rows.withColumns({c: F.coalesce(c, F.array().cast(rows.schema[c].dataType)) for c in given})
    others = [c for c in rows.columns if c not in made]
    schema = T.StructType([*(rows.schema[c] for c in others), *(T.StructField(c, kind) for c, kind in made.items())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = dict(zip(b.schema.names, b.columns, strict=True))
            for c, out, to, default in steps:
                values = sent.value["id" if to == "word" else "word"]
                flat = sent.value[to].take(pc.index_in(lists[c].flatten().cast(values.type), value_set=values))
                offsets = np.append(0, np.cumsum(lists[c].value_lengths().to_numpy(zero_copy_only=False)))
                lists[out] = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pc.fill_null(flat, default))
            yield pa.RecordBatch.from_arrays([lists[c] for c in schema.names], names=schema.names)
        release()

    return rows.mapInArrow(run, schema)


def encode(rows: DataFrame, vocab: DataFrame, words: str = "words", out: str = "ids", unk: int = UNK, joined: bool | None = None, key: str | None = None) -> DataFrame:
    """rows with `out`, the ids of an array of words; unknown words have the id unk.

    A vocabulary of up to `BROADCAST_WORDS` is looked up where the rows are. With a larger one words are exploded, joined and put back by position. key: a unique column (the first by default).
    """
    large = vocab.count() > BROADCAST_WORDS if joined is None else joined
    key = key or rows.columns[0]
    if not large:
        return _looked_up(rows, vocab, [(words, out, "id", unk)])
    side = vocab.select("word", "id")
    flat = rows.select(key, F.posexplode(words).alias("_pos", "word")).join(side, "word", "left")
    back = flat.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("_pos", F.coalesce("id", F.lit(unk)).alias("id")))).alias("_s"))
    return rows.join(back.select(key, F.col("_s.id").alias("_i")), key, "left").withColumn(out, F.coalesce("_i", F.array().cast("array<bigint>"))).drop("_i")


def encode_all(rows: DataFrame, vocab: DataFrame, columns: list[str], key: str, unk: int = UNK, joined: bool | None = None) -> DataFrame:
    """rows with several arrays of words as ids, all in one pass. key: a unique column."""
    side = vocab.select("word", "id")
    large = vocab.count() > BROADCAST_WORDS if joined is None else joined
    if not large:
        coded = {c: f"_id_{k}" for k, c in enumerate(columns)}
        found = _looked_up(rows, vocab, [(c, o, "id", unk) for c, o in coded.items()])
        return found.select(*[F.col(c) for c in rows.columns if c not in columns], *[F.col(o).alias(c) for c, o in coded.items()])
    tagged = F.explode(F.array(*[F.struct(F.lit(c).alias("c"), F.col(c).alias("w")) for c in columns]))
    flat = rows.select(key, tagged.alias("_t")).select(key, F.col("_t.c").alias("_c"), F.posexplode("_t.w").alias("_pos", "word")).join(side, "word", "left")
    ids = lambda c: F.transform(F.array_sort(F.collect_list(F.when(F.col("_c") == c, F.struct("_pos", F.coalesce("id", F.lit(unk)).alias("id"))))), lambda s: s["id"])
    back = flat.groupBy(key).agg(*[ids(c).alias(f"_{c}") for c in columns])
    return rows.drop(*columns).join(back, key, "left").withColumns({c: F.coalesce(f"_{c}", F.array().cast("array<bigint>")) for c in columns}).drop(*[f"_{c}" for c in columns])


def decode(rows: DataFrame, vocab: DataFrame, ids: str = "ids", out: str = "decoded", key: str | None = None, joined: bool | None = None) -> DataFrame:
    """rows with the words of their ids; ids beyond the vocabulary are <UNK>. As encode."""
    key = key or rows.columns[0]
    if not (vocab.count() > BROADCAST_WORDS if joined is None else joined):
        return _looked_up(rows, vocab, [(ids, out, "word", RESERVED[UNK])])
    side = vocab.select("id", "word")
    flat = rows.select(key, F.posexplode(ids).alias("_pos", "id")).join(side, "id", "left")
    back = flat.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("_pos", F.coalesce("word", F.lit(RESERVED[UNK])).alias("word")))).alias("_s"))
    return rows.join(back.select(key, F.col("_s.word").alias("_w")), key, "left").withColumn(out, F.coalesce("_w", F.array().cast("array<string>"))).drop("_w")


def encode_decode(rows: DataFrame, vocab: DataFrame, words: str = "words", ids: str = "ids", out: str = "decoded", unk: int = UNK, joined: bool | None = None, key: str | None = None) -> DataFrame:
    """rows with `ids`, as encode makes them, and `out`, the words of these as decode makes them, in one pass. As encode."""
    large = vocab.count() > BROADCAST_WORDS if joined is None else joined
    if not large:
        return _looked_up(rows, vocab, [(words, ids, "id", unk), (ids, out, "word", RESERVED[UNK])])
    return decode(encode(rows, vocab, words, ids, unk, True, key), vocab, ids, out, key, True)


def oov(tf: DataFrame, vocab: DataFrame) -> DataFrame:
    """tokens, oov_tokens, words, oov_words."""
    seen = tf.join(vocab.select("word", F.lit(1).alias("in")), "word", "left")
    return seen.agg(F.sum("tf").alias("tokens"), F.coalesce(F.sum(F.when(F.col("in").isNull(), F.col("tf"))), F.lit(0)).alias("oov_tokens"), F.count("*").alias("words"), F.count_if(F.col("in").isNull()).alias("oov_words"))


def topical(dialog: DataFrame, topic: DataFrame, max_size: int) -> tuple[DataFrame, DataFrame]:
    """(topic words, joint vocabulary) from two term-frequency tables.

    A topic word's count is its own plus its count in dialogues. The dialogue words are cut to max_size (reserved ones included) first, then topic words
    are taken out of them, and all topic words are appended.
    """
    both = topic.withColumnRenamed("tf", "t").join(dialog.withColumnRenamed("tf", "d"), "word", "left").select("word", (F.col("t") + F.coalesce("d", F.lit(0))).alias("tf"))
    order = [F.desc("tf"), F.col("word")]
    topics = ranked(both, order)
    head = top(dialog.where(~F.col("word").isin(*RESERVED)), order, max(0, max_size - len(RESERVED)))
    own = top(head.drop("rank").join(topic.select("word"), "word", "left_anti"), order, max_size)
    n = own.count() + len(RESERVED)  # at most max_size rows
    tail = topics.select((F.col("rank") + n - 1).alias("id"), "word", "tf")
    return topics, with_reserved(own, RESERVED).unionByName(tail)
