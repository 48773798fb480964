"""Raw comments and submissions to posts: projection, rules, filters with reasons."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F, types as T

from turnmill.functions import text as X

COMMENT = T.StructType([T.StructField(n, T.StringType()) for n in ("author", "id", "link_id", "parent_id", "body", "created_utc", "subreddit_id")] + [T.StructField("score", T.LongType())] + [T.StructField(n, T.StringType()) for n in ("distinguished", "gilded", "controversiality")])
SUBMISSION = T.StructType([T.StructField(n, T.StringType()) for n in ("author", "id", "title", "selftext", "created_utc", "subreddit_id")] + [T.StructField("score", T.LongType())] + [T.StructField(n, T.StringType()) for n in ("distinguished", "gilded", "suggested_sort")] + [T.StructField(n, T.LongType()) for n in ("num_comments", "num_crossposts", "num_reports")] + [T.StructField("brand_safe", T.StringType())])
POST = "type int, id string, author string, link_id string, parent_id string, text string, created_utc string, subreddit_id string, score bigint, distinguished string, gilded string, controversiality string, num_comments bigint, num_crossposts bigint, num_reports bigint, brand_safe string, url string"
NAMES = [x.split()[0] for x in POST.split(", ")]
DELETED = "[deleted]"


def comment_posts(raw: DataFrame) -> DataFrame:
    """Comments as posts: type 0, text from the body, no counts."""
    null = F.lit(None)
    return raw.select(F.lit(0).alias("type"), "id", "author", "link_id", "parent_id", F.col("body").alias("text"), "created_utc", "subreddit_id", "score", "distinguished", "gilded", "controversiality",
                      *[null.cast("bigint").alias(n) for n in ("num_comments", "num_crossposts", "num_reports")], null.cast("string").alias("brand_safe"), F.lit("").alias("url"))


def submission_posts(raw: DataFrame, rules: DataFrame | None = None) -> DataFrame:
    """Submissions as posts: type 1, own link, suggested_sort as controversiality; without a community they are skipped. Text comes by rule for listed communities, else it is empty."""
    raw = raw.where(F.col("subreddit_id").isNotNull())
    if rules is not None:
        # the rules are a hand-written list, read whole by the driver beforehand: bounded
        raw = raw.join(F.broadcast(rules.select(F.col("id").alias("subreddit_id"), "fields", "positions", "affixes", "replacements")), "subreddit_id", "left")
        made = rule_text(F.struct("title", "selftext"), F.col("fields"), F.col("positions"), F.col("affixes"), F.col("replacements"))
        words = F.when(F.col("fields").isNull(), "").otherwise(made)
    else:
        words = F.lit("")
    null = F.lit(None).cast("string")
    return raw.select(F.lit(1).alias("type"), "id", "author", F.col("id").alias("link_id"), F.lit("").alias("parent_id"), words.alias("text"), "created_utc", "subreddit_id", "score", "distinguished", "gilded",
                      F.col("suggested_sort").alias("controversiality"), "num_comments", "num_crossposts", "num_reports", "brand_safe", null.alias("url"))


def rule_text(fields: Column, names: Column, positions: Column, affixes: Column, replacements: Column) -> Column:
    """The configured fields joined by line ends, with known affixes stripped or replaced.

    Affixes go from the longest to the shortest (each with its own replacement); one affix acts at one end, each end is used once, case doesn't matter.
    """
    body = F.concat_ws("\n", F.transform(names, lambda n: F.coalesce(F.when(n == "title", fields["title"]).when(n == "selftext", fields["selftext"]), F.lit(""))))
    pairs = F.arrays_zip(F.coalesce(affixes, F.array().cast("array<string>")).alias("a"), F.coalesce(replacements, F.array().cast("array<string>")).alias("r"))
    pairs = F.array_sort(F.transform(pairs, lambda p: F.struct((-F.length(p["a"])).alias("n"), p["a"].alias("a"), p["r"].alias("r"))))
    state = F.struct(body.alias("t"), F.array_contains(positions, "start").alias("s"), F.array_contains(positions, "end").alias("e"))

    def step(x: Column, p: Column) -> Column:
        n, low, a = F.length(p["a"]), F.lower(x["t"]), F.lower(p["a"])
        at_start = x["s"] & low.startswith(a)
        at_end = ~at_start & x["e"] & low.endswith(a)
        head = F.expr("0") + F.length(x["t"]) - n
        new = (F.when(at_start & p["r"].isNotNull(), F.concat(p["r"], F.substring(x["t"], n + 1, F.length(x["t"]))))
               .when(at_start, F.trim(F.substring(x["t"], n + 1, F.length(x["t"]))))
               .when(at_end & p["r"].isNotNull(), F.concat(F.substring(x["t"], F.lit(1), head), p["r"]))
               .when(at_end, F.trim(F.substring(x["t"], F.lit(1), head))).otherwise(x["t"]))
        return F.struct(new.alias("t"), (x["s"] & ~at_start).alias("s"), (x["e"] & ~at_end).alias("e"))

    return F.when(F.size(pairs) > 0, F.aggregate(pairs, state, step)["t"]).otherwise(body)


def without_kind(x: Column) -> Column:
    """An id without its three-character kind."""
    return F.substring(x, 4, 1 << 30)


def listed(posts: DataFrame, rules: DataFrame) -> DataFrame:
    """Posts of listed communities."""
    return posts.join(F.broadcast(rules.select(F.col("id").alias("subreddit_id"))), "subreddit_id", "left_semi")


def without_bots(posts: DataFrame, bots: DataFrame) -> DataFrame:
    """Posts that aren't deleted and whose author isn't a known bot. bots: column name, lower case, a hand-kept list."""
    kept = posts.where(F.coalesce(F.col("text"), F.lit("")) != DELETED)
    return kept.join(F.broadcast(bots.select(F.col("name").alias("_bot"))), F.lower("author") == F.col("_bot"), "left_anti")


def judged(posts: DataFrame, *, bots: DataFrame | None = None, rules: DataFrame | None = None, normalize: Callable[[Column], Column] | None = None, max_chars: int = 150, max_words: int | None = None, min_words: int = 2,
           min_chars: int | None = None, tokens: Callable[[Column], Column] = X.tok, textual: bool = True) -> DataFrame:
    """Posts with norm (normalized text), tokens and the reason that rejects them, null for those that pass.

    Reasons, in the order in which they are looked for: not_in_subreddits, deleted_or_bot, norm_empty, long_len, not_en, short_word_len. Cheap tests
    come first. min_chars is accepted for the sake of old settings and has no effect.
    """
    del min_chars
    posts = posts.withColumn("_listed", F.lit(True)).withColumn("_bot", F.lit(False))
    if rules is not None:
        ids = F.broadcast(rules.select(F.col("id").alias("subreddit_id"), F.lit(True).alias("_in")).distinct())
        posts = posts.join(ids, "subreddit_id", "left").withColumn("_listed", F.coalesce("_in", F.lit(False))).drop("_in")
    if bots is not None:
        names = F.broadcast(bots.select(F.col("name").alias("_name"), F.lit(True).alias("_is")).distinct())
        posts = posts.join(names, F.lower("author") == F.col("_name"), "left").withColumn("_bot", F.coalesce("_is", F.lit(False))).drop("_name", "_is")
    gone = F.col("_bot") | (F.coalesce(F.col("text"), F.lit("")) == DELETED) | (F.lower("author") == DELETED)
    norm = (normalize or (lambda t: X.normalize_after_emoticons(X.strip_emojis(X.normalize_before_emoticons(X.strip_quotes(t))))))(F.coalesce("text", F.lit("")))
    # rows that are out already aren't normalized
    posts = posts.withColumn("norm", F.when(F.col("_listed") & ~F.coalesce(gone, F.lit(False)), norm))
    posts = posts.withColumn("tokens", tokens(F.lower("norm")))
    too_long = F.size("tokens") > max_words if max_words else F.length("norm") > max_chars
    reason = (F.when(~F.col("_listed"), "not_in_subreddits").when(gone, "deleted_or_bot").when(F.col("norm") == "", "norm_empty").when(too_long, "long_len")
              .when(~X.is_textual("norm") if textual else F.lit(False), "not_en").when(F.size("tokens") < F.lit(min_words), "short_word_len"))
    return posts.withColumn("reason", reason).withColumn("tokens", X.placeholders(F.col("tokens"))).drop("_listed", "_bot")


def accepted(posts: DataFrame) -> DataFrame:
    """The posts that pass, with their tokens joined as text."""
    return posts.where("reason IS NULL").withColumn("text", X.join(F.col("tokens"))).drop("norm", "tokens", "reason")


def report(posts: DataFrame) -> DataFrame:
    """Posts by reason, `processed` for those that pass, and their total."""
    return posts.groupBy(F.coalesce("reason", F.lit("processed")).alias("reason")).count().withColumnRenamed("count", "n").unionByName(posts.agg(F.count("*").alias("n")).select(F.lit("total").alias("reason"), "n"))
