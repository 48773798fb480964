"""Reply trees: edges, roots, root and depth of every post, root-to-leaf paths, threads as documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, functions as F

from turnmill import session
from turnmill.operators.ranks import written
from turnmill.session import new_path


def edges(posts: DataFrame) -> DataFrame:
    """(id, parent) of each post; parent is null for submissions, and an id without its kind for comments."""
    parent = F.when(F.col("type") == 0, F.substring("parent_id", 4, 1 << 30))
    return posts.select("id", F.when(parent != "", parent).alias("parent"))


def nodes(links: DataFrame) -> DataFrame:
    """All ids, parents that aren't in the data included."""
    return links.select("id").unionByName(links.where("parent IS NOT NULL").select(F.col("parent").alias("id"))).distinct()


def roots(links: DataFrame) -> DataFrame:
    """Nodes without a parent other than themselves."""
    return nodes(links).join(links.where("parent IS NOT NULL AND parent <> id").select("id"), "id", "left_anti")


class Jumps:
    """Ancestors at distances of 1, 2, 4 and so on, by pointer doubling.

    Table k has (id, up, dist, top) for each node deeper than 2 ** (k - 1): `up` lies 2 ** k links above it or is its root, whichever is nearer, and top says that it is a root. A node that has
    reached its root isn't carried on. Each round is one join and one written table, and there are log2(depth) of them. Nodes that never reach a root, those of a cycle
    and below one, are found by a round in which no node reaches its root: then nobody left ever does, since every deeper node has ancestors that would come first.
    """

    def __init__(self, links: DataFrame):
        self.spark = links.sparkSession
        self.base = new_path(self.spark, "jumps")
        # an id that comes with several parents keeps the least
        links = links.where("id IS NOT NULL AND parent IS NOT NULL AND parent <> id").groupBy("id").agg(F.min("parent").alias("up"))
        links = written(links, "edges")
        inner = links.select(F.col("id").alias("_u"))
        first = links.join(inner, links["up"] == inner["_u"], "left").select("id", "up", F.lit(1).cast("bigint").alias("dist"), F.col("_u").isNull().alias("top"))
        self.schema = first.schema
        self.rounds = 0
        tops, rest = self._write(first)
        while rest and tops:  # without new tops, what is left is in a cycle or below one
            level = self.table(self.rounds - 1)
            every = self.reached().unionByName(level.where("NOT top"))
            over = every.select(F.col("id").alias("_i"), F.col("up").alias("_up"), F.col("dist").alias("_d"), F.col("top").alias("_top"))
            grown = level.where("NOT top").join(over, F.col("up") == F.col("_i"))
            tops, rest = self._write(grown.select("id", F.col("_up").alias("up"), (F.col("dist") + F.col("_d")).alias("dist"), F.col("_top").alias("top")))

    def _write(self, level: DataFrame) -> tuple[int, int]:
        """Write the next table; how many of its nodes have reached their root, and how many have not, counted as they are written."""
        seen = Observation()
        session.written(level.observe(seen, F.count_if("top").alias("tops"), F.count_if(~F.col("top")).alias("rest")), f"{self.base}/{self.rounds}")
        self.rounds += 1
        return seen.get["tops"], seen.get["rest"]

    def table(self, k: int) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(f"{self.base}/{k}")

    def reached(self) -> DataFrame:
        """(id, up, dist, top) of every node whose root is known, up being the root."""
        return self.spark.read.schema(self.schema).parquet(*[f"{self.base}/{k}" for k in range(self.rounds)]).where("top")

    def lost(self) -> DataFrame:
        """The ids that never reach a root."""
        return self.table(self.rounds - 1).where("NOT top").select("id")

    def at(self, k: int) -> DataFrame:
        """(id, up): the nodes at least 2 ** k deep with their ancestor there."""
        return self.table(k).where(F.col("dist") == 1 << k).select("id", "up")


def root_of(links: DataFrame, jumps: Jumps | None = None) -> DataFrame:
    """(id, root, depth, in_cycle) of every node, missing parents included: depth counts the links up to the root. A node of a cycle or below one has no root.

    A parent with very many replies is one key of a join whose other side has it once, so adaptive execution can split it.
    """
    jumps = jumps or Jumps(links)
    null = lambda kind: F.lit(None).cast(kind)
    found = jumps.reached().select("id", F.col("up").alias("root"), F.col("dist").alias("depth"), F.lit(False).alias("in_cycle"))
    lost = jumps.lost().select("id", null("string").alias("root"), null("bigint").alias("depth"), F.lit(True).alias("in_cycle"))
    tops = roots(links).where("id IS NOT NULL").select("id", F.col("id").alias("root"), F.lit(0).cast("bigint").alias("depth"), F.lit(False).alias("in_cycle"))
    return found.unionByName(lost).unionByName(tops)


def ancestors(links: DataFrame, jumps: Jumps | None = None) -> DataFrame:
    """(leaf, id, above): each leaf's nodes up to its root, itself at 0. A leaf has a parent and no reply.

    A distance is a sum of different powers of two, so taking the jumps from the longest to the shortest, each from all nodes found so far, meets every ancestor once: log2(depth) joins of
    rows of three values, and no path is copied on the way.
    """
    jumps = jumps or Jumps(links)
    inner = jumps.table(0).select("up").distinct()
    ids = jumps.reached().select("id")
    leaves = ids.join(inner, ids["id"] == inner["up"], "left_anti")
    out = leaves.select(F.col("id").alias("leaf"), "id", F.lit(0).cast("bigint").alias("above"))
    for k in reversed(range(jumps.rounds)):
        step = jumps.at(k).select(F.col("id").alias("_i"), F.col("up").alias("_up"))
        here, further = F.struct("id", "above"), F.struct(F.col("_up").alias("id"), (F.col("above") + (1 << k)).alias("above"))
        out = out.join(step, out["id"] == step["_i"], "left").select("leaf", F.inline(F.array(here, further))).where("id IS NOT NULL")
        if k and k % 6 == 0:
            out = written(out, "ancestors")  # short lineage
    return out


def paths(links: DataFrame) -> DataFrame:
    """(leaf, path) for each root-to-leaf path, path being array<string>. Posts that nobody answers and that answer nobody have none, nor have cycles and what hangs on them."""
    found = ancestors(links).groupBy("leaf").agg(F.array_sort(F.collect_list(F.struct((-F.col("above")).alias("k"), "id"))).alias("p"))
    return found.select("leaf", F.col("p.id").alias("path"))


def dialogues(posts: DataFrame, found: DataFrame | None = None) -> DataFrame:
    """(leaf, ids, utterances) of the paths with two texts or more: a root without a text is dropped; a text that is missing further down ends the path's use.

    posts: id, type, parent_id, text.
    """
    found = paths(edges(posts)) if found is None else found
    texts = posts.select(F.col("id").alias("_id"), F.col("text").alias("_text")).where("_text IS NOT NULL AND trim(_text) <> ''").dropDuplicates(["_id"])
    steps = found.select("leaf", F.xxhash64("path").alias("_h"), F.posexplode("path").alias("pos", "_id")).join(texts, "_id", "left")
    whole = steps.groupBy("leaf", "_h").agg(F.array_sort(F.collect_list(F.struct("pos", "_id", "_text"))).alias("s"))
    used = F.filter("s", lambda x: x["_text"].isNotNull() | (x["pos"] > 0))
    whole = whole.select("leaf", used.alias("s")).where((F.size("s") >= 2) & F.forall("s", lambda x: x["_text"].isNotNull()))
    return whole.select("leaf", F.col("s._id").alias("ids"), F.col("s._text").alias("utterances"))


def thread_documents(posts: DataFrame, compat: bool = False) -> DataFrame:
    """(thread, n_posts, utterances): the texts of each thread of two posts or more, in the order of line_no. compat: all submissions count as one thread.

    A thread is a document, so it is as large as its posts; the array is its output.
    """
    own = F.lit("id") if compat else F.col("id")
    key = F.when(F.col("type") == 1, own).otherwise(F.substring("link_id", 4, 1 << 30))
    rows = posts.where("text IS NOT NULL").select(key.alias("thread"), F.struct("line_no", "text").alias("p"))
    return rows.groupBy("thread").agg(F.count("*").alias("n_posts"), F.array_sort(F.collect_list("p")).alias("p")).where("n_posts > 1").select("thread", "n_posts", F.col("p.text").alias("utterances"))
