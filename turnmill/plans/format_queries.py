"""Queries that write a format and read it again, and queries over rows of literal cases."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from turnmill.functions import numbers as M, text as X, tweets as T
from turnmill.operators import batches as B, embeddings as E, evaluate as EV, ngrams as N, posts as P, stats as S, topics as TP, vocab as V
from turnmill.operators.dialogues import windows
from turnmill.plans.corpus_queries import VOCAB
from turnmill.plans.registry import query, read, words
from turnmill.streaming import ingest
from turnmill.session import adopt, new_path
from turnmill.sources import readers as R, writers as W

#: SQL: utterances in one line each, and one row per conversation of them.
LINE = r"trim(regexp_replace(coalesce(text, ''), '\s+', ' ', 'g'))"
TURNS = f"c AS (SELECT conv_id, turn, {LINE} AS x FROM conversations)"
LISTS = f"{TURNS}, d AS (SELECT conv_id, list(x ORDER BY turn) AS u FROM c GROUP BY conv_id)"


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    one = F.trim(F.regexp_replace(F.coalesce("text", F.lit("")), r"\s+", " "))
    return read(spark, sf_dir, "conversations").select("conv_id", "turn", one.alias("text"))


def dialogues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(conv_id, utterances, ids), ids being conversation and turn."""
    rows = turns(spark, sf_dir).groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "text"))).alias("u"))
    return rows.select("conv_id", F.col("u.text").alias("utterances"), F.transform("u", lambda x: F.concat_ws(":", "conv_id", x["turn"])).alias("ids"))


#: SQL: the plain words of every turn.
PLAIN = r"t AS (SELECT conv_id, turn, coalesce(array_to_string(list_filter(string_split_regex(text, '\s+'), lambda w: regexp_matches(w, '^[a-z]+$')), ' '), '') AS t FROM conversations)"


def cased_sql(rows: list[tuple[str, str]], glue: str = " ", joint: str = " ") -> str:
    """SQL for `cased` after a rule that leaves plain words alone, turns each case's x into its y, and `glue` into `joint`."""
    spell = lambda s: "'" + s.replace("'", "''").replace("\n", "' || chr(10) || '") + "'"
    values = ", ".join(f"({k}, {spell(x)}, {spell(y)})" for k, (x, y) in enumerate(rows))
    put = lambda t, sep, c: f"{t} || CASE WHEN t = '' THEN '' ELSE {spell(sep)} END || {c} AS {c}"
    words = f"replace(t, ' ', {spell(joint)})"
    return f"WITH v AS (SELECT * FROM (VALUES {values}) AS v(k, x, y)), {PLAIN} SELECT conv_id, turn, {put('t', glue, 'x')}, {put(words, joint, 'y')} FROM t JOIN v ON k = (conv_id + turn) % {len(rows)}"


def cased(spark: SparkSession, sf_dir: str, rows: list[tuple[str, str]], glue: str = " ") -> DataFrame:
    """(conv_id, turn, x): the plain words of every turn, and behind them one of the cases, each in its turn."""
    t = F.array_join(F.filter(X.tok("text"), lambda w: w.rlike("^[a-z]+$")), " ")
    case = F.element_at(F.array(*[F.lit(x) for x, _ in rows]), (F.pmod(F.col("conv_id") + F.col("turn"), F.lit(len(rows))) + 1).cast("int"))
    x = adopt(read(spark, sf_dir, "conversations")).select("conv_id", "turn", F.coalesce(t, F.lit("")).alias("t"), case.alias("case"))
    return x.where(F.col("case").isNotNull()).select("conv_id", "turn", F.concat("t", F.when(F.col("t") == "", "").otherwise(glue), "case").alias("x"))


@query(f"WITH {TURNS}, r AS (SELECT row_number() OVER (ORDER BY conv_id, turn) - 1 AS line_no, x AS value FROM c) SELECT line_no, value FROM r WHERE line_no >= 10")
def text_line_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines in a total order, numbered when they are read, without the first ten."""
    path = new_path(spark, "lines")
    turns(spark, sf_dir).orderBy("conv_id", "turn").select(F.col("text").alias("value")).write.text(path)
    return R.text_lines(spark, path, skip=10)


@query(f"WITH {TURNS} SELECT x AS value FROM c")
def stripped_line_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "lines")
    turns(spark, sf_dir).select(F.concat(F.lit("  "), "text", F.lit(" ")).alias("value")).write.text(path)
    return R.text_lines(spark, path, strip=True).select("value")


@query(f"WITH {LISTS} SELECT array_to_string(u, '|') AS utterances, array_to_string(list_transform(range(len(u)), lambda i: conv_id || ':' || i), '|') AS ids, CAST(len(u) AS INTEGER) AS turns FROM d")
def dialogue_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dialogue lines and their ids, two files that correspond line by line, joined by position."""
    path = new_path(spark, "dialogues")
    W.dialogues(dialogues(spark, sf_dir), path)
    ids = R.dialogue_lines(spark, f"{path}.ids").withColumnRenamed("utterances", "ids")
    both = R.dialogue_lines(spark, path).join(ids, "line_no")
    return both.select(F.array_join("utterances", "|").alias("utterances"), F.array_join("ids", "|").alias("ids"), F.size("utterances").alias("turns"))


@query(f"WITH {LISTS}, e AS (SELECT unnest(u) AS text, generate_subscripts(u, 1) - 1 AS turn FROM d) SELECT CAST(turn AS INTEGER) AS turn, text FROM e")
def utterance_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "dialogues")
    W.filtered(dialogues(spark, sf_dir), path)
    return R.utterance_rows(R.dialogue_lines(spark, f"{path}.filtered")).select("turn", "text")


def event_posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    none = lambda n, k="string": F.lit(None).cast(k).alias(n)
    raw = read(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("author"), F.col("event_id").cast("string").alias("id"), F.concat(F.lit("t3_"), F.col("user_id").cast("string")).alias("link_id"), F.concat(F.lit("t1_"), F.col("event_id").cast("string")).alias("parent_id"),
                                               F.concat_ws(" ", "event_type", "props").alias("body"), none("created_utc"), none("subreddit_id"), F.length("props").cast("bigint").alias("score"), none("distinguished"), none("gilded"), F.col("props").alias("controversiality"))
    return P.comment_posts(raw)


@query("SELECT CAST(event_id AS VARCHAR) AS id, CAST(user_id AS VARCHAR) AS author, event_type || ' ' || props AS text, CAST(length(props) AS BIGINT) AS score, props AS controversiality, CAST(user_id AS VARCHAR) AS thread FROM events")
def post_pair_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Posts as tables and text lines, joined by position."""
    path = new_path(spark, "posts")
    W.post_pair(event_posts(spark, sf_dir), f"{path}.csv", f"{path}.txt")
    return R.post_pair(spark, f"{path}.csv", f"{path}.txt").select("id", "author", "text", "score", "controversiality", P.without_kind(F.col("link_id")).alias("thread"))


@query("SELECT CAST(event_id AS VARCHAR) AS id, event_type || ' ' || props AS text FROM events")
def post_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "posts")
    W.posts(event_posts(spark, sf_dir), path)
    return spark.read.parquet(path).select("id", "text")


@query("""SELECT 't3_' || doc_id AS id, CASE WHEN source LIKE 'src1%' AND lang = 'en' THEN coalesce(lang, '') || chr(10) || trim(regexp_replace(text, '\\s+', ' ', 'g')) WHEN lang = 'de' THEN coalesce(source, '') ELSE '' END AS text, n_chars AS num_comments
FROM documents WHERE lang IS NOT NULL AND source IS NOT NULL""")
def submission_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Submissions as posts: two fields for one community, one for another, none for the rest, and no row without a community."""
    d = read(spark, sf_dir, "documents")
    community = F.when(d["lang"].isNotNull() & d["source"].isNotNull(), F.when(d["source"].startswith("src1") & (d["lang"] == "en"), "two").when(d["lang"] == "de", "one").otherwise("none"))
    title = F.when(community == "two", d["lang"]).otherwise(d["source"])
    none = lambda n, k="string": F.lit(None).cast(k).alias(n)
    raw = d.select(F.concat(F.lit("t3_"), F.col("doc_id").cast("string")).alias("id"), none("author"), title.alias("title"), F.trim(F.regexp_replace("text", r"\s+", " ")).alias("selftext"), none("created_utc"), community.alias("subreddit_id"), none("score", "bigint"),
                   none("distinguished"), none("gilded"), none("suggested_sort"), F.col("n_chars").cast("bigint").alias("num_comments"), none("num_crossposts", "bigint"), none("num_reports", "bigint"), none("brand_safe"))
    rules = spark.createDataFrame([("a", "two", ["title", "selftext"], [], [], []), ("b", "one", ["title"], [], [], [])], "name string, id string, fields array<string>, positions array<string>, affixes array<string>, replacements array<string>")
    return P.submission_posts(raw, rules).select("id", "text", "num_comments")


@query("SELECT n_name || chr(10) AS text FROM nation")
def document_folder(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A folder of documents, one in each file."""
    path = new_path(spark, "folder")
    read(spark, sf_dir, "nation").select(F.col("n_name").alias("value")).write.option("maxRecordsPerFile", 1).text(path)
    return R.document_directory(spark, path).select("text")


@query(f"WITH {LISTS} SELECT array_to_string(u, chr(9)) AS text FROM d WHERE trim(array_to_string(u, chr(9))) <> ''")
def document_line_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "threads")
    W.thread_documents(dialogues(spark, sf_dir), path)
    return R.document_lines(spark, path).select("text")


@query("SELECT lower(r_name) AS name FROM region UNION SELECT '[deleted]'")
def bot_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "bots")
    rows = read(spark, sf_dir, "region").select(F.explode(F.array(F.concat(F.lit(" "), "r_name"), F.concat(F.lit("# "), "r_name"), F.lit(""))).alias("value"))
    rows.write.text(path)
    return R.bots(spark, path)


@query("SELECT n_name AS term FROM nation")
def term_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "terms")
    read(spark, sf_dir, "nation").select(F.explode(F.array(F.concat("n_name", F.lit(" ")), F.lit(""))).alias("value")).write.text(path)
    return spark.createDataFrame([(t,) for t in R.terms(path)], "term string")


@query("SELECT n_name AS name, CAST(n_nationkey AS VARCHAR) AS id, 'title' AS fields, 'start' AS positions, 'TIL,TIL:' AS affixes, CASE WHEN n_nationkey % 2 = 0 THEN 'Today,Today' ELSE '' END AS replacements FROM nation")
def rule_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "rules")
    command = F.concat(F.lit("start$TIL,TIL:"), F.when(F.col("n_nationkey") % 2 == 0, "$Today").otherwise(""))
    read(spark, sf_dir, "nation").select(F.concat_ws("\t", "n_name", F.col("n_nationkey").cast("string"), F.lit("Title"), command).alias("value")).write.text(path)
    return R.rules(spark, path).select("name", "id", *[F.array_join(c, ",").alias(c) for c in ("fields", "positions", "affixes", "replacements")])


@query(f"WITH {VOCAB} SELECT id, word FROM v")
def vocabulary_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "vocabulary")
    W.vocabulary(V.build(S.term_frequency(read(spark, sf_dir, "documents")), 5000), path)
    return R.vocabulary(spark, path)


@query(f"WITH {LISTS} SELECT DISTINCT array_to_string(u[i : i + 2], chr(9)) AS value FROM (SELECT u, unnest(range(1, len(u) - 2)) AS i FROM d)")
def window_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = W.windows(windows(dialogues(spark, sf_dir), 3), new_path(spark, "windows"), 3)
    return R.text_lines(spark, path).select("value")


@query(f"WITH {TURNS}, k AS (SELECT x, list_filter({words('x')}, lambda w: length(w) >= 3) AS w FROM c) SELECT array_to_string(w, ' ') AS kept, x AS line FROM k WHERE len(w) >= 3")
def topic_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Kept words and their lines, two files that correspond line by line."""
    path = new_path(spark, "topics")
    W.topic_preparation(TP.prepare(turns(spark, sf_dir), drop_frequent=0), path)
    kept = R.text_lines(spark, f"{path}.lda.t").withColumnRenamed("value", "kept")
    return kept.join(R.text_lines(spark, f"{path}.processed").withColumnRenamed("value", "line"), "line_no").select("kept", "line")


TF = f"f AS (SELECT word, count(*) AS tf FROM (SELECT unnest({words('text')}) AS word FROM conversations) GROUP BY word)"


@query(f"WITH {TF} SELECT row_number() OVER (ORDER BY tf DESC, word) - 1 AS line_no, word || chr(9) || tf AS value FROM f")
def ranked_word_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "words")
    W.ordered_words(S.term_frequency(read(spark, sf_dir, "conversations")), [F.desc("tf"), F.col("word")], path, ["word", "tf"])
    return R.text_lines(spark, path)


@query(f"WITH w AS (SELECT {words('text')} AS w FROM conversations), g AS (SELECT unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS ngram FROM w) SELECT ngram, count(*) AS freq FROM g GROUP BY ngram HAVING count(*) > 2")
def ngram_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "grams")
    W.ngrams(N.counts(read(spark, sf_dir, "conversations"), [1, 2]), path, more_than=2)
    return R.ngram_counts(spark, f"{path}.2grams")


GRAMS3 = f"w AS (SELECT {words('text')} AS w FROM conversations), g AS (SELECT DISTINCT unnest(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) AS ngram FROM w)"


@query(f"WITH {GRAMS3} SELECT conv_id, turn, ngram FROM conversations, g WHERE contains(text, ngram)")
def lines_with_listed_ngrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every 3-gram of the conversations (45,000 at sf0.01), written as an n-gram file, read again, and found in their lines."""
    path = new_path(spark, "listed")
    rows = read(spark, sf_dir, "conversations")
    W.ngrams(N.counts(rows, [3]), path, more_than=0, order=3)
    found = N.found_in(rows.withColumn("at", F.struct("conv_id", "turn")), R.ngram_counts(spark, f"{path}.3grams"), key="at")
    return found.select("at.conv_id", "at.turn", "ngram")


@query(f"""WITH {GRAMS3}, l AS (SELECT DISTINCT md5('0:' || text) AS h, text FROM conversations WHERE text IS NOT NULL), m AS (SELECT ngram, h FROM l, g WHERE contains(text, ngram)),
  q AS (SELECT ngram, h, row_number() OVER (PARTITION BY ngram ORDER BY h) AS k FROM m) SELECT conv_id, turn FROM conversations WHERE md5('0:' || text) IN (SELECT h FROM q WHERE k <= 1 AND ngram LIKE 'th%')""")
def lines_thinned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines that go so that every 3-gram that begins with th loses one of its lines."""
    rows = read(spark, sf_dir, "conversations").withColumn("at", F.struct("conv_id", "turn"))
    quotas = N.counts(rows, [3]).where("ngram LIKE 'th%'").select("ngram", F.lit(1).alias("quota"))
    return N.thinned(rows, quotas, key="at").select("at.conv_id", "at.turn")


@query(f"WITH {LISTS} SELECT array_to_string(u, chr(9)) || chr(9) || CASE WHEN conv_id % 3 = 0 THEN '<NO_TOPIC>' ELSE 'w' || conv_id || ' x' END AS value FROM d")
def topical_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "topical")
    some = F.array(F.concat(F.lit("w"), F.col("conv_id").cast("string")), F.lit("x"))
    W.topical(dialogues(spark, sf_dir).withColumn("topic_words", F.when(F.col("conv_id") % 3 == 0, F.array().cast("array<string>")).otherwise(some)), path)
    return R.text_lines(spark, f"{path}.topical").select("value")


@query(f"WITH {TURNS} SELECT x AS value FROM c")
def response_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "out")
    W.responses(turns(spark, sf_dir).withColumnRenamed("text", "responses"), path, "test")
    return R.text_lines(spark, f"{path}/output_test").select("value")


@query("SELECT CAST(vec_id AS VARCHAR) AS word, CAST(len(embedding) AS INTEGER) AS dim, round(CAST(embedding[1] AS DOUBLE), 6) AS first FROM embeddings")
def embedding_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors as text lines, as a table, and as text again."""
    path = new_path(spark, "vectors")
    rows = read(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("string").alias("word"), F.col("embedding").alias("vec"))
    rows.select(F.concat_ws(" ", "word", F.array_join(F.transform("vec", lambda x: x.cast("string")), " ")).alias("value")).write.text(path)
    W.embeddings(R.vectors(spark, path), f"{path}.parquet")
    return R.vectors(spark, f"{path}.parquet").select("word", F.size("vec").alias("dim"), F.round(F.col("vec")[0].cast("double"), 6).alias("first"))


@query("SELECT vec_id AS id, label % 2 = 0 AS trainable, CASE WHEN label % 2 = 0 THEN 0 ELSE round(CAST(embedding[1] AS DOUBLE), 6) END AS first FROM embeddings")
def embedding_zero(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors that sum to zero count as missing; what is found is looked up by word."""
    rows = read(spark, sf_dir, "embeddings").withColumn("word", F.col("vec_id").cast("string"))
    zeros = F.transform("embedding", lambda x: F.lit(0.0).cast("float"))
    table = rows.select("word", F.when(F.col("label") % 2 == 0, zeros).otherwise(F.col("embedding")).alias("vec"))
    made = E.from_table(rows.select("word"), table, 64, zero_is_missing=True)
    found = E.lookup(rows.select("vec_id", "word"), made).join(made.select("word", "trainable"), "word")
    return found.select(F.col("vec_id").alias("id"), "trainable", F.when(F.col("trainable"), F.lit(0.0)).otherwise(F.round(F.col("vec")[0].cast("double"), 6)).alias("first"))


SRC = f"list_transform(u, lambda x, i: CASE WHEN i < len(u) THEN list_append({words('x')}[1 : 29], '<SEP>') ELSE {words('x')}[1 : 30] END)"


@query(f"WITH {LISTS}, s AS (SELECT conv_id, flatten({SRC})[1 : 30] AS src FROM d) SELECT conv_id, array_to_string(src, ' ') AS src, CAST(len(src) AS INTEGER) AS src_len FROM s WHERE len(src) > 0")
def infer_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flat samples without a target: all turns are sources."""
    return B.flat_samples(dialogues(spark, sf_dir), src_max_len=30, has_target=False).select("conv_id", F.array_join("src", " ").alias("src"), "src_len")


@query(f"WITH {LISTS} SELECT conv_id, array_to_string({words('u[1]')}[1 : 9], ' ') AS s1, array_to_string({words('coalesce(u[2], chr(32))')}[1 : 9], ' ') AS s2, array_to_string(list_append({words('coalesce(u[3], chr(32))')}[1 : 12], '</S>'), ' ') AS tgt_out, array_to_string({words('u[len(u)]')}[1 : 4], ' ') AS topic FROM d")
def topical_turn_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Samples per turn with a topic from the last column."""
    rows = B.turn_samples(dialogues(spark, sf_dir), turns=3, src_max_len=9, tgt_max_len=12, topical=True, topic_words=4)
    return rows.select("conv_id", *[F.array_join(F.element_at("srcs", i), " ").alias(f"s{i}") for i in (1, 2)], F.array_join("tgt_out", " ").alias("tgt_out"), F.array_join("topic", " ").alias("topic"))


@query(f"WITH {LISTS} SELECT conv_id, " + ", ".join(f"array_to_string({words(f'coalesce(u[{i}], chr(32))')}, ' ') AS s{i}" for i in (1, 2, 3)) + " FROM d")
def infer_turn_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = B.turn_samples(dialogues(spark, sf_dir), turns=3, has_target=False)
    return rows.select("conv_id", *[F.array_join(F.element_at("srcs", i), " ").alias(f"s{i}") for i in (1, 2, 3)])


@query("SELECT conv_id, turn, role AS text, text AS role FROM conversations")
def reversed_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.reversed_pairs(read(spark, sf_dir, "conversations"), "text", "role").select("conv_id", "turn", "text", "role")


@query("SELECT doc_id, source FROM documents")
def shuffled_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Another order, the same rows."""
    return B.shuffled(read(spark, sf_dir, "documents").select("doc_id", "source"), 3)


@query("""SELECT o_orderkey AS id, CAST(floor(1.5 * ceil(o_orderkey / 128.0)) AS BIGINT) AS steps, CAST(round_even(o_orderkey * 1.5, 0) AS INTEGER) AS longest, CASE WHEN o_orderkey % 2 = 0 THEN 0.8 ELSE 1.0 END AS keep,
'f0,b0,f1,b1' AS states FROM orders""")
def step_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Steps of a training run, of decoding, keep probabilities, interleaved states."""
    k = F.col("o_orderkey")
    states = B.interleaved(F.array(F.lit("f0"), F.lit("f1")), F.array(F.lit("b0"), F.lit("b1")))
    return read(spark, sf_dir, "orders").select(k.alias("id"), M.train_steps(F.lit(1.5), k, F.lit(128)).alias("steps"), M.decode_steps(k, 1.5).alias("longest"), M.keep_probability(F.lit(0.2), k % 2 == 0).alias("keep"), F.array_join(states, ",").alias("states"))


@query("SELECT c_custkey AS id, printf('%s ppl %.2f, %s bleu %.1f', 'c' || c_custkey, c_custkey + 0.25, 'c' || c_custkey, CAST(c_custkey AS DOUBLE)) AS line FROM customer")
def result_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    line = EV.result_line(F.concat(F.lit("c"), k.cast("string")), k + F.lit(0.25), {"bleu": k.cast("double")})
    return read(spark, sf_dir, "customer").select(k.alias("id"), line.alias("line"))


WORD_CASES = [("see @url$ RedditUser @URL$", "see <url> <person> <url>"), ("plain", "plain")]


@query(cased_sql(WORD_CASES))
def placeholder_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cased(spark, sf_dir, WORD_CASES).select("conv_id", "turn", "x", F.array_join(X.placeholders(X.tok("x")), " ").alias("y"))


BLANK_CASES = [("a b", "a b"), (" a   b　c\n", "a b c"), ("x", "x")]


@query(cased_sql(BLANK_CASES))
def blank_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cased(spark, sf_dir, BLANK_CASES).select("conv_id", "turn", "x", X.squeeze_whitespace(X.no_nbsp("x")).alias("y"))


CONTRACTION_CASES = [("don't", "do|n't"), ("we've", "we|'ve"), ("she'll", "she|'ll"), ("I'm", "I|'m"), ("it’s", "it|’s"), ("plain", "plain"), ("they'd", "they|'d")]


@query(r"""WITH w AS (SELECT DISTINCT word || e AS x FROM (SELECT unnest(string_split_regex(text, '\s+')) AS word FROM conversations), (SELECT unnest(['', 'n''t', '''ve', '’ll', '''D', '''re', '’s', '''m', 'n’t']) AS e) WHERE word <> ''),
m AS (SELECT x, regexp_extract(x, '(?i)^.*?([\p{L}\p{N}_\p{M}]+)(n[''’′]t|[''’′]ve|[''’′]ll|[''’′]d|[''’′]re|[''’′]s|[''’′]m)$', ['a', 'b']) AS m FROM w) SELECT x, CASE WHEN m.b <> '' THEN m.a || '|' || m.b ELSE x END AS y FROM m""")
def contraction_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every word of the conversations by itself and with each contraction."""
    ends = F.array(*[F.lit(e) for e in ("", "n't", "'ve", "’ll", "'D", "'re", "’s", "'m", "n’t")])
    x = read(spark, sf_dir, "conversations").select(F.explode(X.tok("text")).alias("w")).distinct().select(F.explode(F.transform(ends, lambda e: F.concat("w", e))).alias("x")).distinct()
    return x.select("x", F.array_join(X.contraction_parts(F.col("x")), "|").alias("y"))


RULE_CASES = [("Don't go, @url$ (now)...", "Do n't go , @url$ ( now ) ..."), ("it's 3.5 <person>!", "it 's 3.5 <person> !")]


@query(cased_sql(RULE_CASES))
def rule_token_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cased(spark, sf_dir, RULE_CASES).select("conv_id", "turn", "x", F.array_join(X.rule_tokens("x"), " ").alias("y"))


TWEET_CASES = [
    ("ask me.if or it.or see a.de", "ask|me|.|if|or|it|.|or|see|a.de"), ("hi :) @bob #tag http://x.com/a?b=1.", "hi|:)|@bob|#tag|http://x.com/a?b=1|."), ("I <3 you &lt;3", "I|<3|you|<3"),
    ("costs $3.50, 1,000 at 10:30", "costs|$3.50|,|1,000|at|10:30"), ("Mr. Smith's U.S. friends...", "Mr.|Smith's|U.S.|friends|..."), ("mail bob@x.com now-->", "mail|bob@x.com|now|-->"), ("(well) “quoted”", "(|well|)|“|quoted|”"),
]


@query(cased_sql(TWEET_CASES, joint="|"))
def tweet_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens: country domains only where there is such a country, faces, addresses, amounts, times, abbreviations, arrows, quotes."""
    return cased(spark, sf_dir, TWEET_CASES).select("conv_id", "turn", "x", F.array_join(T.raw_tokens_udf()("x"), "|").alias("y"))


FACE_CASES = [("good :) day", "good  day"), ("well ಠ_ಠ then", "well  then"), ("xD is a word", "xD is a word"), ("a:)b", "a:)b"), (":)", "")]


@query(cased_sql(FACE_CASES))
def emoticon_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cased(spark, sf_dir, FACE_CASES).select("conv_id", "turn", "x", T.emoticons_udf()("x").alias("y"))


POST_CASES = [
    ("&gt; quoted\n\nown words", "own words"), ("| a | b |\n|---|---|\n| c | d |", "a b c d"), ("see [this][1] ok\n\n[1]: http://q.org 'T'", "see this ok"), ("x\n\n    code *y*\n", "x code *y*"),
    ("**bold** _it_ `c`", "bold it c"), ("two&nbsp;words", "two words"), ("x^(2 3) y^2", "x2 3 y2"), ("‘a’ “b” ★", "'a' \"b\" *"), ("hi @bob and /u/al-b", "hi RedditUser and RedditUser"), ("at r/aww now", "at @url$ now"),
    ("see:http://x.com/a now", "see: @url$ now"), ("go www.x.com/a?b=1 now", "go @url$ now"), ("-LRB- a -RRB-", "( a )"), ("so!!!! ... ... ... \"\"q\"\"", "so!! ... \"q\""), ("ｈéʟʟᴏ ǆ", "heLLO dz"), ("a ── b ¿", "a  b"),
    ("fun \U0001f602 end", "fun  end"), ("´s a_b", "'s a_b"),
]


@query(cased_sql(POST_CASES, "\n\n"))
def post_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every step of post normalization on a case of its own."""
    return cased(spark, sf_dir, POST_CASES, "\n\n").select("conv_id", "turn", "x", T.normalize_post(F.col("x")).alias("y"))


EVENT_JSON = "event_id bigint, event_type string, user_id bigint, props string"


def event_lines(spark: SparkSession, sf_dir: str) -> str:
    """The events as bzip2-compressed JSON lines, a JSON text among their fields; the folder."""
    path = new_path(spark, "events-json")
    rows = read(spark, sf_dir, "events").select(F.to_json(F.struct(*[x.split()[0] for x in EVENT_JSON.split(", ")])).alias("value"))
    rows.repartition(3).write.option("compression", "bzip2").text(path)
    return path


@query("SELECT event_id, event_type, user_id, props FROM events")
def json_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Compressed JSON lines, read in one go."""
    return R.json_lines(spark, event_lines(spark, sf_dir), StructType.fromDDL(EVENT_JSON))


@query("SELECT event_id, event_type, user_id, props FROM events")
def json_stream_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Compressed JSON lines, read as a stream, a file to a micro-batch."""
    out = new_path(spark, "events-streamed")
    rows = ingest.json_stream(spark, event_lines(spark, sf_dir), StructType.fromDDL(EVENT_JSON), files_per_trigger=1)
    ingest.write_posts(rows, out, f"{out}.checkpoint").awaitTermination()
    return spark.read.parquet(out)
