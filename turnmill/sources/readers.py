"""Readers."""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from turnmill.operators.posts import NAMES
from turnmill.operators.ranks import numbered


def json_lines(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """JSON lines, compressed (bz2, gz) or not; a malformed line fails the job."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def text_lines(spark: SparkSession, path: str, skip: int = 0, strip: bool = False) -> DataFrame:
    """(line_no, value), without the first `skip` lines; strip: without blanks around the lines."""
    rows = numbered(spark.read.text(path))
    rows = rows.withColumn("value", F.trim("value")) if strip else rows
    return rows.where(F.col("line_no") >= skip) if skip else rows


def dialogue_lines(spark: SparkSession, path: str, sep: str = "\t", strip: bool = True) -> DataFrame:
    """(line_no, utterances) from text lines with utterances between separators."""
    value = F.trim("value") if strip and sep != " " else F.col("value")
    return numbered(spark.read.text(path)).select("line_no", F.split(value if sep == "\t" else F.col("value"), re.escape(sep)).alias("utterances"))


def utterance_rows(dialogues: DataFrame) -> DataFrame:
    """(line_no, turn, text)."""
    return dialogues.select("line_no", F.posexplode("utterances").alias("turn", "text"))


def post_pair(spark: SparkSession, csv: str, text: str) -> DataFrame:
    """Posts from a table without header and a text file, aligned by line; the shorter ends both."""
    columns = [n for n in NAMES if n != "text"]
    table = numbered(spark.read.csv(csv, schema=", ".join(f"{n} string" for n in columns), nullValue="", emptyValue=""))
    lines = numbered(spark.read.text(text)).withColumnRenamed("value", "text")
    rows = table.join(lines, "line_no")
    kinds = {"type": "int", "score": "bigint", "num_comments": "bigint", "num_crossposts": "bigint", "num_reports": "bigint"}
    return rows.select("line_no", *[F.col(n).cast(kinds[n]).alias(n) if n in kinds else F.col(n) for n in NAMES])


def document_directory(spark: SparkSession, path: str) -> DataFrame:
    """(path, text): one row per .txt file, empty files included."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.txt").option("recursiveFileLookup", "true").load(path)
    names = spark.createDataFrame([(p,) for p in files.inputFiles()], "path string")  # which the driver has listed anyway; scans leave empty files out
    seen = files.select("length", F.input_file_name().alias("path"))
    empty = names.join(seen, "path", "left_anti").select("path", F.lit("").alias("text"))
    return files.select("path", F.col("content").cast("string").alias("text")).unionByName(empty)


def document_lines(spark: SparkSession, path: str) -> DataFrame:
    """(line_no, text): one row per line, without blank ones."""
    return numbered(spark.read.text(path)).where(F.trim("value") != "").select("line_no", F.col("value").alias("text"))


def bots(spark: SparkSession, path: str) -> DataFrame:
    """(name), lower case; lines with # are comments; deleted authors are bots."""
    rows = spark.read.text(path).select(F.lower(F.trim("value")).alias("name")).where("name <> '' AND name NOT LIKE '#%'")
    return rows.unionByName(spark.createDataFrame([("[deleted]",)], "name string")).distinct()


def listed(path: str, spark: SparkSession | None = None) -> list[str]:
    """The lines of a hand-made list, read from wherever Spark reads."""
    spark = spark or SparkSession.active()
    files = spark.read.text(path, wholetext=True).select("_metadata.file_path", "value").collect()
    return [line for f in sorted(files) for line in f["value"].splitlines()]


def terms(path: str) -> list[str]:
    """A word or phrase per line (profanities, emoticons, dull responses)."""
    return [x for x in map(str.strip, listed(path)) if x]


def rules(spark: SparkSession, path: str) -> DataFrame:
    """(name, id, fields, positions, affixes, replacements) from lines of name, id, fields and positions$affixes[$replacements]. One replacement serves all affixes."""
    rows = []
    for line in listed(path, spark):
        if not line.strip() or line.startswith("#"):
            continue
        part = [*line.rstrip("\n").split("\t"), None, None][:4] if line.count("\t") < 3 else line.rstrip("\n").split("\t")[:4]
        name, key, names, command = part
        names = [f.strip().lower() for f in names.split(",")] if names else []
        if any(f not in ("title", "selftext") for f in names):
            raise ValueError(f"unknown field in {line!r}")
        positions, affixes, new = [], [], []
        if command:
            sub = command.strip().split("$")
            positions, affixes = sub[0].split(","), sub[1].split(",")
            new = sub[2].split(",") if len(sub) > 2 else []
            if len(new) == 1:
                new = new * len(affixes)
            if new and len(new) != len(affixes):
                raise ValueError(f"as many replacements as affixes are needed in {line!r}")
        rows.append((name, key, names, positions, affixes, new))
    return spark.createDataFrame(rows, "name string, id string, fields array<string>, positions array<string>, affixes array<string>, replacements array<string>")


def ngram_counts(spark: SparkSession, path: str) -> DataFrame:
    """(ngram, freq) from tab-separated lines."""
    return spark.read.csv(path, sep="\t", schema="ngram string, freq bigint", quote="")


def vocabulary(spark: SparkSession, path: str, start: int = 0) -> DataFrame:
    """(id, word): a word per line."""
    return numbered(spark.read.text(path), "id").select((F.col("id") + start).alias("id"), F.trim("value").alias("word"))


def vectors(spark: SparkSession, path: str) -> DataFrame:
    """(word, vec) from a Parquet table, or from text lines of a word and its components."""
    if str(path).endswith(".parquet"):
        return spark.read.parquet(path).select("word", F.col("vec").cast("array<float>").alias("vec"))
    part = F.split(F.trim("value"), " +")
    return spark.read.text(path).where(F.size(part) > 2).select(part[0].alias("word"), F.slice(part, F.lit(2), F.size(part) - 1).cast("array<float>").alias("vec"))


@dataclass
class Config:
    """Settings from a YAML file, overridden by values that are given and not None."""

    values: dict = field(default_factory=dict)

    @classmethod
    def load(cls, path: str, **given: object) -> Config:
        import yaml

        base = yaml.safe_load(Path(path).read_text(encoding="utf-8")) or {}
        return cls(base | {k: v for k, v in given.items() if v is not None})

    def __getattr__(self, name: str) -> object:
        try:
            return self.__dict__["values"][name]
        except KeyError:
            raise AttributeError(name) from None

    def get(self, name: str, default: object = None) -> object:
        return self.values.get(name, default)

    def save(self, path: str, base: str | None = None) -> None:
        """Write as YAML; paths of data (names that end in _data or _file) are made absolute, other paths below `base` relative to it."""
        import yaml

        out = {}
        for k, v in self.values.items():
            if isinstance(v, str) and (k.endswith("_data") or k.endswith("_file")):
                v = str(Path(v).resolve())
            elif isinstance(v, str) and base and v.startswith(str(base).rstrip("/") + "/"):
                v = v[len(str(base).rstrip("/")) + 1 :]
            out[k] = v
        Path(path).write_text(yaml.safe_dump(out, sort_keys=True), encoding="utf-8")


def pretrained_catalogue(path: str) -> dict[str, dict]:
    """Embedding types of a YAML catalogue: name -> url, dim, src_type."""
    import yaml

    return yaml.safe_load(Path(path).read_text(encoding="utf-8")) or {}
