"""Word n-grams: windows, counts, distinct counts, lines that contain them, down-sampling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from turnmill import session
from turnmill.functions.text import tok
from turnmill.operators import packed as P
from turnmill.operators.ranks import ranked_in, written


def ngrams(words: Column, n: int, compat: bool = False) -> Column:
    """Joined n-grams of an array of words; compat: the last one is left out.

    Each order is the one before it zipped with the words shifted by one more place: a concatenation per n-gram and no slice. `words` should be a column,
    since it is referred to at each order.
    """
    rest = lambda k: F.greatest(F.size(words) - k, F.lit(0))
    out = words
    for k in range(1, n):
        out = F.zip_with(F.slice(out, F.lit(1), rest(k)), F.slice(words, F.lit(k + 1), rest(k)), lambda a, b: F.concat(a, F.lit(" "), b))
    return F.slice(out, F.lit(1), rest(n)) if compat else out


def marked(words: Column, n: int, compat: bool = False) -> Column:
    """array<struct<n, ngram>>."""
    return F.transform(ngrams(words, n, compat), lambda g: F.struct(F.lit(n).alias("n"), g.alias("ngram")))


def exploded(texts: DataFrame, orders: list[int], text: str = "text", compat: bool = False, by: list[str] | None = None) -> DataFrame:
    """(by, n, ngram) of all orders in one pass over the texts: a row for each position with the words from there on, and of it a row for each order.

    So n-grams are joined in generated code, and no array of all n-grams of a text is made.
    """
    by = by or []
    return _spread(texts.select(*by, tok(text).alias("_w")), orders, compat, by)


def _spread(words: DataFrame, orders: list[int], compat: bool, by: list[str]) -> DataFrame:
    """(by, n, ngram) of an array of words, _w."""
    longest = max(orders) + compat
    places = [F.col("_w"), *[F.slice(F.col("_w"), F.lit(k + 1), F.greatest(F.size("_w") - k, F.lit(0))) for k in range(1, longest)]]
    rows = words.select(*by, F.inline(F.arrays_zip(*[x.alias(f"w{k}") for k, x in enumerate(places)])))
    rows = rows.toDF(*by, *[f"w{k}" for k in range(longest)])
    w = [F.col(f"w{k}") for k in range(longest)]
    grams = [F.struct(F.lit(n).alias("n"), (F.concat_ws(" ", *w[:n]) if n > 1 else w[0]).alias("ngram"), w[n - 1 + compat].isNotNull().alias("_whole")) for n in orders]
    return rows.select(*by, F.inline(F.array(*grams))).where("_whole").drop("_whole")


def _runs(texts: DataFrame, longest: int, text: str) -> DataFrame:
    """(_run, _k, _f): the runs of `longest` words from each position on, _k < longest words where a text ends before, and how often each comes.

    A row for each position is counted, not one for each order; shorter n-grams are the beginnings of runs and come from what is left.
    """
    words = texts.select(tok(text).alias("_w"))
    places = [F.col("_w"), *[F.slice(F.col("_w"), F.lit(k + 1), F.greatest(F.size("_w") - k, F.lit(0))) for k in range(1, longest)]]
    rows = words.select(F.inline(F.arrays_zip(*[x.alias(f"w{k}") for k, x in enumerate(places)]))).toDF(*[f"w{k}" for k in range(longest)])
    k = sum((F.col(w).isNotNull().cast("int") for w in rows.columns[1:]), F.lit(1))
    return rows.select(F.concat_ws(" ", *rows.columns).alias("_run"), k.alias("_k")).groupBy("_run", "_k").agg(F.count("*").alias("_f"))


#: Characters of text up to which n-grams are exchanged as rows; those of more are exchanged in compressed blocks.
ROWS_CHARS = 4_000_000


def counts(texts: DataFrame, orders: list[int], text: str = "text", compat: bool = False, more_than: int = 0, rows_chars: int = ROWS_CHARS) -> DataFrame:
    """(n, ngram, freq) with freq above `more_than`.

    Chunks of texts are counted where they are, and what they hold is exchanged in compressed blocks (`packed`), a pass over the texts having counted their characters. Texts of few characters need no Python
    and are counted in runs: words hold no blank, so a run is cut at its blanks. A single order needs no runs then and is counted as it stands.
    """
    chars = P.characters((texts, F.col(text)))
    if chars > rows_chars:
        return P.counted(texts.select(tok(text).alias("_w")), orders, compat, chars, more_than)
    if len(orders) == 1:
        found = exploded(texts, orders, text, compat).groupBy("n", "ngram").agg(F.count("*").alias("freq"))
        return found.where(F.col("freq") > more_than) if more_than else found
    grams = [F.struct(F.lit(n).alias("n"), F.substring_index("_run", " ", n).alias("ngram"), (F.col("_k") >= n + compat).alias("_whole")) for n in orders]
    each = _runs(texts, max(orders) + compat, text).select("_f", F.inline(F.array(*grams))).where("_whole")
    found = each.groupBy("n", "ngram").agg(F.sum("_f").alias("freq"))
    return found.where(F.col("freq") > more_than) if more_than else found


def distinct(texts: DataFrame, orders: list[int], text: str = "text", compat: bool = False, rsd: float = 0.0081) -> DataFrame:
    """(n, distinct_ngrams, words, distinct_n): approximate numbers of distinct n-grams (a sketch per order, merged), over the number of words."""
    found = exploded(texts, orders, text, compat).groupBy("n").agg(F.approx_count_distinct("ngram", rsd).alias("distinct_ngrams"))
    words = texts.agg(F.sum(F.size(tok(text))).alias("words"))
    return found.crossJoin(words).withColumn("distinct_n", F.try_divide("distinct_ngrams", "words"))  # one row on the right


def distinct_exact(texts: DataFrame, orders: list[int], text: str = "text", compat: bool = False) -> DataFrame:
    """As distinct(), exactly: n-grams are counted as groups first, so that no task holds a set of them."""
    found = counts(texts, orders, text, compat).groupBy("n").agg(F.count("*").alias("distinct_ngrams"))
    words = texts.agg(F.sum(F.size(tok(text))).alias("words"))
    return found.crossJoin(words).withColumn("distinct_n", F.try_divide("distinct_ngrams", "words"))


def sketches(texts: DataFrame, orders: list[int], by: list[str], text: str = "text", compat: bool = False) -> DataFrame:
    """(by, n, sketch): mergeable distinct-count sketches, for corpora that arrive in parts (hll_union_agg, hll_sketch_estimate)."""
    return exploded(texts, orders, text, compat, by).groupBy(*by, "n").agg(F.hll_sketch_agg("ngram").alias("sketch"))


#: Characters of the pieces by which n-grams of a table are found; a shorter n-gram is a piece by itself.
PIECE = 8
#: Pieces of listed n-grams that are broadcast, at most (some 100 bytes each); more are joined by shuffle.
BROADCAST_PIECES = 500_000


def containing(texts: DataFrame, grams: list[str], text: str = "text", key: str = "line_no") -> DataFrame:
    """(key, ngram) for each line that contains an n-gram of a hand-made list as a substring: the list is tested where each line is, and only matches leave. For n-grams of a table see found_in."""
    listed = F.array(*[F.lit(g) for g in sorted(set(grams))]).cast("array<string>")
    return texts.select(key, F.explode(F.filter(listed, lambda g: F.contains(F.col(text), g))).alias("ngram"))


def _pieces(x: str, lengths: list[int]) -> Column:
    """All substrings of the given lengths, each once, in time linear in the text: one overlapping match per position."""
    every = [F.regexp_extract_all(F.col(x), F.lit(rf"(?s)(?=(.{{{n}}}))"), F.lit(1)) for n in lengths]
    return F.array_distinct(every[0] if len(every) == 1 else F.concat(*every))


#: n-grams of 2 to so many parts between blanks are met by their runs of parts; others by their pieces.
LONGEST_RUN = 5
#: If the listed first (last) parts have so many different beginnings of two characters at most, runs without any of them are left out at once.
FEW_HEADS = 16


def found_in(texts: DataFrame, grams: DataFrame, text: str = "text", key: str = "line_no", gram: str = "ngram", broadcast_pieces: int = BROADCAST_PIECES) -> DataFrame:
    """(key, ngram) for each text that contains an n-gram of a table as a substring, for n-gram lists of any length.

    A list with up to `broadcast_pieces` pieces of `PIECE` characters is met where the texts are, and no text is moved (`_by_pieces`). A longer list meets the texts' runs of parts between blanks in
    compressed blocks (`packed.met`). Its n-grams without a blank are looked for in the different parts only; those of more than `LONGEST_RUN` parts by pieces.

    key: unique. grams: read more than once, so a table or a file. Null texts and null n-grams are none; the empty n-gram is in every text.
    """
    rows = texts.select(F.col(key).alias("_key"), F.col(text).alias("_text")).where(F.col("_text").isNotNull())
    listed = grams.select(F.col(gram).alias("ngram")).where("ngram IS NOT NULL")
    parts = F.length("ngram") - F.length(F.replace(F.col("ngram"), F.lit(" "), F.lit(""))) + 1
    listed = listed.withColumn("_parts", F.when(F.length("ngram") == 0, 0).when(parts > LONGEST_RUN, LONGEST_RUN + 1).otherwise(parts))
    pieces = F.greatest(F.length("ngram") - (PIECE - 1), F.lit(1)).cast("bigint")
    of_parts = listed.groupBy("_parts").agg(F.sum(pieces), F.sum(F.length("ngram").cast("bigint"))).collect()  # LONGEST_RUN + 2 rows at most
    sizes, chars = {r[0]: r[1] for r in of_parts}, {r[0]: r[2] for r in of_parts}
    found = rows.where(F.lit(0 in sizes)).select("_key", F.lit("").alias("ngram"))
    own = sorted(n for n in sizes if n)
    if own and sum(sizes[n] for n in own) <= broadcast_pieces:
        found = found.unionByName(_by_pieces(rows, written(listed.where("_parts > 0").distinct(), "listed"), True))
    elif own:
        of = lambda n: written(listed.where(F.col("_parts") == n).distinct(), "listed")
        if 1 in own:
            held = written(rows.select("_key", F.explode(F.array_distinct(F.split("_text", " "))).alias("_part")), "parts")
            met = _by_pieces(held.select(F.col("_part").alias("_key"), F.col("_part").alias("_text")).distinct(), of(1), sizes[1] <= broadcast_pieces)
            # an n-gram may lie in several parts of a text
            found = found.unionByName(held.join(met.select(F.col("_key").alias("_part"), "ngram"), "_part").select("_key", "ngram").distinct())
        if runs := [n for n in own if 1 < n <= LONGEST_RUN]:
            found = found.unionByName(_by_runs(rows, listed.where(F.col("_parts").isin(runs)), sum(chars[n] for n in runs)))
        if (n := LONGEST_RUN + 1) in own:
            found = found.unionByName(_by_pieces(rows, of(n), sizes[n] <= broadcast_pieces))
    return found.select(F.col("_key").alias(key), "ngram")


def _by_runs(rows: DataFrame, listed: DataFrame, chars: int) -> DataFrame:
    """(_key, ngram) by runs of parts between blanks, for n-grams of 2 to `LONGEST_RUN` parts; chars: of all n-grams of the list."""
    few = []
    for at in (1, -1):
        heads = [r[0] for r in listed.select(F.left(F.substring_index("ngram", " ", at), F.lit(2)).alias("h")).distinct().limit(FEW_HEADS + 1).collect()]
        few.append(heads if len(heads) <= FEW_HEADS else None)  # most runs of the texts go before they are moved
    kinds = listed.select("_parts", F.startswith("ngram", F.lit(" ")), F.endswith("ngram", F.lit(" "))).distinct().collect()  # 4 for each number of parts at most
    buckets = P.buckets_for(P.characters((rows, F.col("_text"))) + chars)
    return P.met(rows.select("_key", F.split("_text", " ").alias("_w")), listed.select(F.split("ngram", " ").alias("_w")), sorted(map(tuple, kinds)), buckets, *few)


def _by_pieces(rows: DataFrame, listed: DataFrame, few: bool) -> DataFrame:
    """(_key, ngram) by pieces.

    Each n-gram is keyed by that of its pieces of `PIECE` characters which the fewest texts hold, so a common beginning makes no common key, and an n-gram with a piece that no text
    holds is done with. One pass over the texts counts the pieces of the list; a second one meets the keys. few: the list is broadcast, and what meets is compared on the spot, so
    no text is moved. Else (key, n-gram) pairs meet without their texts, and these are read a third time to be compared.
    """
    sized = F.least(F.length("ngram"), F.lit(PIECE))
    lengths = sorted(r[0] for r in listed.select(sized.alias("n")).distinct().collect())  # PIECE numbers at most
    of_gram = F.coalesce(*[F.when(sized == n, _pieces("ngram", [n])) for n in lengths])
    own = written(listed.select("ngram", F.explode(of_gram).alias("_piece")), "pieces")
    side = F.broadcast if few else (lambda x: x.hint("merge"))
    each = rows.select("_key", "_text", F.explode(_pieces("_text", lengths)).alias("_p"))
    wanted = own.select("_piece").distinct()
    held = each.select("_p").join(side(wanted), F.col("_p") == F.col("_piece")).groupBy("_piece").agg(F.count("*").alias("_n"))
    # an n-gram whose pieces aren't all held is in no text
    keys = own.join(held, "_piece", "left").groupBy("ngram").agg(F.min(F.struct("_n", "_piece")).alias("_least"), F.min(F.col("_n").isNotNull()).alias("_all"))
    keys = written(keys.where("_all").select("ngram", F.col("_least._piece").alias("_k")), "rarest")
    if few:
        return each.join(F.broadcast(keys), F.col("_p") == F.col("_k")).where(F.contains("_text", "ngram")).select("_key", "ngram")
    pairs = each.select("_key", "_p").join(keys.hint("merge"), F.col("_p") == F.col("_k")).select(F.col("_key").alias("_c"), "ngram")
    return pairs.join(rows, F.col("_c") == F.col("_key")).where(F.contains("_text", "ngram")).select("_key", "ngram")


def _line_digests(texts: DataFrame, text: str, key: str, seed: int) -> DataFrame:
    return texts.select(F.col(key).alias(key), F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(text))).alias("_h"))


def down_sampled(texts: DataFrame, quotas: dict[str, int], text: str = "text", key: str = "line_no", seed: int = 0, eligible: Column | None = None) -> DataFrame:
    """Keys of lines to drop: for each n-gram its quota of distinct lines, in the order of a seeded digest; lines chosen for an earlier n-gram count towards the quota of later ones.

    The n-grams are a hand-made list in an order of its own, so there is a step for each; steps read a table of matches, and the texts are read once. For n-grams of a table see thinned.
    """
    lines = _line_digests(texts, text, key, seed)
    rows = containing(texts.where(eligible) if eligible is not None else texts, list(quotas), text, key).join(lines, key)
    # equal lines are one line here, as all copies of a chosen line go
    found = written(rows.select("ngram", "_h").distinct(), "matches")
    base, schema = session.new_path(texts.sparkSession, "chosen"), found.select("_h").schema
    chosen = found.select("_h").limit(0)
    for k, (g, n) in enumerate(quotas.items()):
        mine = found.where(F.col("ngram") == g).select("_h")
        n -= mine.join(chosen, "_h", "left_semi").count() if k else 0
        session.written(mine.join(chosen, "_h", "left_anti").orderBy("_h").limit(max(0, n)), f"{base}/{k}")
        chosen = texts.sparkSession.read.schema(schema).parquet(f"{base}/*")
    return lines.join(chosen, "_h", "left_semi").select(key)


def thinned(texts: DataFrame, quotas: DataFrame, text: str = "text", key: str = "line_no", seed: int = 0, eligible: Column | None = None) -> DataFrame:
    """Keys of lines to drop, for n-grams of a table (ngram, quota) of any length: of each n-gram's distinct lines those that come first by a seeded digest, as many as its quota.

    The digest orders all n-grams' lines alike, so a line that goes for one n-gram goes first for every other one that it holds, and counts towards its quota. Each n-gram loses its quota, or all its
    lines, whatever the order of the n-grams; there is no step for each, but one ranking in which an n-gram with most of the lines is spread over many ranges.
    """
    lines = _line_digests(texts, text, key, seed)
    quota = written(quotas.groupBy("ngram").agg(F.max("quota").alias("_quota")), "quotas")
    # equal lines are one line here, as all copies of a chosen line go
    some = texts.where(eligible) if eligible is not None else texts
    different = _line_digests(some.where(F.col(text).isNotNull()), text, text, seed).groupBy("_h").agg(F.first(text).alias("_line"))
    ranks = ranked_in(found_in(different, quota, "_line", "_h"), "ngram", [F.col("_h")])
    chosen = ranks.join(quota, "ngram").where(F.col("rank") <= F.col("_quota")).select("_h").distinct()
    return lines.join(chosen, "_h", "left_semi").select(key)


def ranked_per(rows: DataFrame, by: str, order: list[Column], k: int) -> DataFrame:
    """The first k rows of each group."""
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(by).orderBy(*order)).cast("bigint")).where(F.col("rank") <= k)
