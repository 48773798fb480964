"""Sentence ends learned from the corpus, without a model of a language.

The method is that of Kiss and Strunk, "Unsupervised multilingual sentence boundary detection" (2006): a word that comes with a full stop far more
often than words do is an abbreviation, and a word that follows sure sentence ends far more often than chance is a sentence starter. Both are
log-likelihood ratios over counts of the whole corpus, one aggregation each. Texts are then cut by native expressions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

# Fixed values of the published method: the share of stops of a true abbreviation, the least score of one, the least log-likelihood of a starter.
SURE, ABBREVIATION, STARTER = 0.99, 0.3, 30.0
OPENING, CLOSING, CLAUSE, ENDS = "\"'“‘([{", "\"'”’)]}", ",;:", ".!?…"
#: A word that counts: letters, with stops among them.
WORD = r"^\p{L}[\p{L}.]*$"
#: Lists up to so many words become part of the plan; longer ones are joined.
LISTED = 20_000


def core(t: Column) -> Column:
    """A word in lower case without what opens before it, closes after it, or marks a clause."""
    return F.lower(F.rtrim(F.ltrim(t, F.lit(OPENING)), F.lit(CLOSING + CLAUSE)))


def one_stop(c: Column) -> Column:
    return c.endswith(".") & ~c.endswith("..")


def without_stop(c: Column) -> Column:
    return F.when(one_stop(c), F.rtrim(c, F.lit("."))).otherwise(c)


def typed(c: Column) -> Column:
    """The type of a word's core: the core without its stop; null if it has other characters than letters and stops, or ends in several stops."""
    return F.when(c.rlike(WORD) & ~c.endswith(".."), F.rtrim(c, F.lit(".")))


def pairs(df: DataFrame, column: str = "text") -> DataFrame:
    """(word, next, n): how often each word comes, told apart by the next one (null after the last) if it has a full stop.

    All that is learned comes from this table: texts are read once, and cores and types are made of a word once, not each time it comes.
    """
    w = F.filter(F.split(F.col(column), r"(?U)\s+"), lambda t: t != "")
    rows = df.select(w.alias("w")).where(F.size("w") > 0).select(F.inline(F.arrays_zip(F.col("w").alias("word"), F.expr("slice(w, 2, size(w))").alias("next"))))
    return rows.select("word", F.when(F.col("word").contains("."), F.col("next")).alias("next")).groupBy("word", "next").agg(F.count("*").alias("n"))


def _ll(n: Column, k: Column, p: Column | float) -> Column:
    """Log-likelihood of k of n with probability p; both sides kept off zero."""
    p = p if isinstance(p, Column) else F.lit(p)
    return k * F.ln(F.greatest(p, F.lit(1e-12))) + (n - k) * F.ln(F.greatest(1 - p, F.lit(1e-12)))


def counts(df: DataFrame, column: str = "text", of_pairs: DataFrame | None = None) -> DataFrame:
    """(type, stopped, total) of each word's type. of_pairs: `pairs` of df, if they are there already."""
    words = (pairs(df, column) if of_pairs is None else of_pairs).groupBy("word").agg(F.sum("n").alias("n"))
    w = words.select(core(F.col("word")).alias("c"), "n").select(typed(F.col("c")).alias("type"), one_stop(F.col("c")).alias("stop"), "n").where(F.col("type").isNotNull())
    return w.groupBy("type").agg(F.coalesce(F.sum(F.when(F.col("stop"), F.col("n"))), F.lit(0)).alias("stopped"), F.sum("n").alias("total"))


def scored(of_types: DataFrame) -> DataFrame:
    """(type, stopped, total, score) of all types that a stop follows anywhere. The score is the log-likelihood ratio of "nearly always with a stop" against
    "with a stop as often as any word", less for long types, more for stops inside, and much less for each time without a stop."""
    whole = of_types.agg((F.sum("stopped") / F.sum("total")).alias("share"))
    x = of_types.where(F.col("stopped") > 0).crossJoin(F.broadcast(whole))
    letters = F.length(F.replace(F.col("type"), F.lit("."), F.lit("")))
    ratio = 2 * (_ll(F.col("total"), F.col("stopped"), SURE) - _ll(F.col("total"), F.col("stopped"), F.col("share")))
    score = ratio * F.exp(-letters) * (F.length("type") - letters + 1) * F.pow(letters.cast("double"), (F.col("stopped") - F.col("total")).cast("double"))
    return x.select("type", "stopped", "total", score.alias("score"))


def abbreviations(df: DataFrame, column: str = "text", least: float = ABBREVIATION, of_pairs: DataFrame | None = None) -> DataFrame:
    """(type, stopped, total, score) of the corpus's abbreviations."""
    return scored(counts(df, column, of_pairs)).where(F.col("score") >= least)


def starters(df: DataFrame, short: DataFrame, column: str = "text", least: float = STARTER, of_pairs: DataFrame | None = None) -> DataFrame:
    """(type, after, total, ratio) of the words that stand after sure ends (a stop whose word isn't in `short`) more often than elsewhere."""
    of_pairs = pairs(df, column) if of_pairs is None else of_pairs
    cores = of_pairs.where(F.col("word").contains(".")).select(core(F.col("word")).alias("c"), core(F.col("next")).alias("d"), "n").where(one_stop(F.col("c")))
    stops = cores.select(typed(F.col("c")).alias("type"), typed(F.col("d")).alias("next"), "n").where(F.col("type").isNotNull())
    # Pairs are counted before they meet the abbreviations, so the join reads a row for each pair of types with a stop between.
    stops = stops.groupBy("type", "next").agg(F.sum("n").alias("n"))
    ends = stops.join(short.select("type"), "type", "left_anti")
    after = ends.where(F.col("next").isNotNull()).groupBy(F.col("next").alias("type")).agg(F.sum("n").alias("after"))
    of_types = counts(df, column, of_pairs)
    whole = of_types.agg(F.sum("total").alias("words")).crossJoin(ends.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("ends")))
    x = after.join(of_types, "type").crossJoin(F.broadcast(whole))
    n, a, k, b = (F.col(c) for c in ("words", "ends", "after", "total"))
    elsewhere, expected, inside = F.try_divide(b - k, n - a), b / n, k / a
    ratio = 2 * (_ll(a, k, inside) + _ll(n - a, b - k, F.coalesce(elsewhere, F.lit(0.0))) - _ll(a, k, expected) - _ll(n - a, b - k, expected))
    return x.select("type", "after", "total", ratio.alias("ratio")).where((F.col("ratio") >= least) & (inside > expected))


def _listed(table: DataFrame) -> list[str] | None:
    rows = table.select("type").limit(LISTED + 1).collect()
    return [r[0] for r in rows] if len(rows) <= LISTED else None


def split(df: DataFrame, short: DataFrame, first: DataFrame, key: list[str], column: str = "text", listed: int | None = None) -> DataFrame:
    """df with `sentences`: an array of the parts of `column`, blanks inside them as they were (null for null, empty for a text without words).

    A word ends a sentence if it ends in ! ? … or stops (closing marks may follow) and the next doesn't begin with a small letter. A single stop after an
    abbreviation or a single letter is an end only before a sentence starter. `key` must name a unique key; it is read only where a list is longer
    than LISTED, and then positions alone are shuffled to find the exceptions.
    """
    rest = [c for c in df.columns if c != "sentences"]
    x = df.withColumns({"_w": F.regexp_extract_all(F.col(column), F.lit(r"(?U)\S+\s*"), F.lit(0)), "_t": F.regexp_extract_all(F.col(column), F.lit(r"(?U)\S+"), F.lit(0))})
    word = lambda i: F.element_at("_t", i)
    marked = lambda i: F.right(F.rtrim(word(i), F.lit(CLOSING)), F.lit(1)).isin(*ENDS) & ~F.ltrim(word(i + 1), F.lit(OPENING)).rlike(r"^\p{Ll}")
    size = F.size("_t")
    none = F.array().cast("array<int>")
    x = x.withColumn("_c", F.when(size > 1, F.filter(F.sequence(F.lit(1), size - 1), marked)).otherwise(none))
    # What a list can overrule: a single stop.
    open_ = lambda i: one_stop(core(word(i)))
    doubtful = lambda i: F.rtrim(core(word(i)), F.lit("."))
    follower = lambda i: without_stop(core(word(i + 1)))
    one = lambda t: t.rlike(r"^\p{L}$")
    bound = LISTED if listed is None else listed
    names, begins = _listed(short), _listed(first)
    if names is not None and begins is not None and len(names) <= bound and len(begins) <= bound:
        isin = lambda t, names: t.isin(*names) if names else F.lit(False)
        x = x.withColumn("_x", F.filter("_c", lambda i: open_(i) & (one(doubtful(i)) | isin(doubtful(i), names)) & ~isin(follower(i), begins)))
    else:
        at = F.filter("_c", open_)
        rows = x.select(*key, F.explode(F.transform(at, lambda i: F.struct(i.alias("i"), doubtful(i).alias("type"), follower(i).alias("next")))).alias("r")).select(*key, "r.*")
        rows = rows.join(short.select("type", F.lit(True).alias("_a")), "type", "left").where(one(F.col("type")) | F.col("_a"))
        rows = rows.join(first.select(F.col("type").alias("next")), "next", "left_anti")
        found = rows.groupBy(*key).agg(F.collect_list("i").alias("_x"))
        same = [F.col("l." + k).eqNullSafe(F.col("r." + k)) for k in key]
        x = x.alias("l").join(found.alias("r"), same, "left").select("l.*", F.coalesce("r._x", none).alias("_x"))
    x = x.withColumn("_e", F.when(size > 0, F.concat(F.array_except("_c", "_x"), F.array(size))).otherwise(none))
    begin = lambda k: F.when(k > 0, F.element_at("_e", F.greatest(k, F.lit(1)))).otherwise(0)
    part = lambda e, k: F.regexp_replace(F.array_join(F.slice("_w", begin(k) + 1, e - begin(k)), ""), r"(?U)\s+$", "")
    return x.select(*rest, F.when(F.col(column).isNotNull(), F.transform("_e", part)).alias("sentences"))
