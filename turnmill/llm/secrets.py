"""Secret scans with an incremental blob ledger.

Every version of every path is content-addressed (SHA-256). The ledger holds (blob, rule version) with the findings of that scan.
A run scans only blobs without a row for the present rule version, appends them, and joins findings back to all paths and versions that
hold the blob. The ledger is a Parquet folder in shared storage; an append is a set of whole files, and a blob that two runs both append
has equal findings, of which reading takes one.

A ledger serves as many runs as it is given to. The registered query takes that below `spark.turnmill.cache.dir`, if the session names such a folder, and else
a new one, so that a run without the setting scans every content.

Base kinds (leftmost, not overlapping, per kind; matches that fail the length are dropped): `assign`, `access`, `hex`. The rules below
them add further spans: private keys with their bodies, JSON web tokens, and access tokens with well-known prefixes. Offsets are
code points, end exclusive.

Defined results: null text counts as empty; repeated rows keep one row each; equal contents are scanned once; of spans with one start the kind that is
listed first comes first; texts may be of any length (scanning and masking take time in proportion to it); extra columns are kept by
`redact` and ignored by `scan`; an empty table or ledger is fine.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from turnmill.llm.common import adopt, append, arrow_map, chunks, compact, cut, digest_of, first_texts, free, kept, keyed, cache_path, table

# The contract's base patterns, with the group and the length that a match needs.
BASE = [
    ("assign", r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 1, 6),
    ("access", r"AKIA[A-Z0-9]+", 0, 20),
    ("hex", r"[0-9a-f]+", 0, 24),
]
# Added by the operator: well-known forms of keys and tokens.
MORE = [
    ("private_key", r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----", 0, 1),  # with its body, see key_blocks
    ("jwt", r"eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}", 0, 1),  # see web_tokens
    ("host_token", r"gh[pousr]_[A-Za-z0-9]{36,}", 0, 1),
    ("chat_token", r"xox[abprs]-[A-Za-z0-9-]{10,}", 0, 1),
]
RULES = BASE + MORE
ORDER = {kind: k for k, (kind, *_) in enumerate(RULES)}
#: A closed key block has so many characters at most; beyond, its lines tell where it ends. (A key of 16,384 bits has some 13,000.)
KEY_LENGTH = 16_384
RULE_VERSION = hashlib.sha256(repr((RULES, "key bodies", KEY_LENGTH)).encode()).hexdigest()[:16]
SPANS = "array<struct<kind:string,start:bigint,end:bigint>>"
LEDGER = f"digest binary, version string, found {SPANS}"
#: re.A keeps both case folding and \w to ASCII. A run of hex digits that is long enough is the same match as a run that is measured afterwards.
_compiled = [(kind, re.compile(p if kind != "hex" else r"[0-9a-f]{24,}", re.A), group, least) for kind, p, group, least in RULES]
_assign_hint = re.compile(r"[:=]\x20*[\"']?[A-Za-z0-9+/_.=-]")


_part = re.compile(r"[A-Za-z0-9_-]+")


def web_tokens(text: str) -> Iterator[tuple[int, int]]:
    """The matches of the jwt rule, in one pass: three parts in a row with a dot between, the last two of 10 characters or more, the first with eyJ and 10 more."""
    parts = [(m.start(), m.end()) for m in _part.finditer(text)] if "eyJ" in text else []
    k = 0
    while k + 2 < len(parts):
        (a, b), (c, d), (e, f) = parts[k : k + 3]
        at = text.find("eyJ", a, max(a, b - 10)) if c == b + 1 and e == d + 1 and text[b] == text[d] == "." and d - c >= 10 and f - e >= 10 else -1
        if at >= 0:
            yield at, f
        k += 3 if at >= 0 else 1


_key_begin = re.compile(next(p for k, p, *_ in MORE if k == "private_key"), re.A)
_key_end = re.compile(r"-----END [A-Z ]{0,40}PRIVATE KEY-----", re.A)
_key_lines = re.compile(r"(?:[ \t\r]*\n[ \t]*[A-Za-z0-9+/=]{16,}(?=[ \t\r]*(?:\n|\Z)))*(?:[ \t\r]*\n[ \t]*[A-Za-z0-9+/]+={1,2}(?=[ \t\r]*(?:\n|\Z)))?", re.A)


def key_blocks(text: str) -> Iterator[tuple[int, int]]:
    """Private keys with their bodies: up to the end line that follows before another key begins, or, where there is none within `KEY_LENGTH`, up to the last line of base64."""
    begins = [m.span() for m in _key_begin.finditer(text)]
    ends = [m.span() for m in _key_end.finditer(text)] if begins else []
    k = 0
    for n, (a, b) in enumerate(begins):
        further = begins[n + 1][0] if n + 1 < len(begins) else len(text) + 1
        while k < len(ends) and ends[k][0] < b:
            k += 1
        closed = k < len(ends) and ends[k][0] < further and ends[k][1] - a <= KEY_LENGTH
        yield a, ends[k][1] if closed else _key_lines.match(text, b).end()


def findings(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of a text, by start and then by the rules' order."""
    out = []
    for kind, pattern, group, least in _compiled:
        if kind == "assign" and not _assign_hint.search(text) or kind == "access" and "AKIA" not in text or kind == "private_key" and "-----BEGIN" not in text or kind == "host_token" and "gh" not in text or kind == "chat_token" and "xox" not in text:
            continue
        if kind in ("jwt", "private_key"):
            out += [(kind, a, b) for a, b in (web_tokens if kind == "jwt" else key_blocks)(text)]
            continue
        for m in pattern.finditer(text):
            if m.end(group) - m.start(group) >= least:
                out.append((kind, m.start(), m.end()))
    return sorted(out, key=lambda x: (x[1], ORDER[x[0]]))


#: Findings of up to so many spans are broadcast, however they are spread over texts.
BROADCAST_SPANS = 200_000


def scan_blobs(texts: DataFrame, version: str = RULE_VERSION) -> DataFrame:
    """digest and _text to rows of the ledger."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
        for b in chunks(batches, "_text", 1 << 22):
            found = [[dict(zip(("kind", "start", "end"), x, strict=True)) for x in findings(t)] for t in b.column("_text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("digest"), pa.array([version] * b.num_rows, pa.string()), pa.array(found, kind)], names=["digest", "version", "found"])

    return arrow_map(texts, run, LEDGER)


def read_ledger(spark: SparkSession, ledger: str) -> DataFrame:
    at = spark._jvm.org.apache.hadoop.fs.Path(ledger)
    if not at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
        return spark.createDataFrame([], LEDGER)
    return spark.read.schema(LEDGER).parquet(ledger)


def scan(docs: DataFrame, ledger: str, *, doc_id: str = "doc_id", text: str = "text", version: str = RULE_VERSION) -> DataFrame:
    """(_id, digest, found) of each row of docs (a path's version). ledger: a folder of shared storage, made if it isn't there."""
    docs = adopt(docs)
    spark = docs.sparkSession
    keys = keyed(docs, doc_id, text)
    firsts = keys.groupBy("digest").agg(F.min("_id").alias("_id"))
    # the ledger is read once, for this run's blobs; all that is written has the size of this run
    known = kept(read_ledger(spark, ledger).where(F.col("version") == version).join(firsts.select("digest"), "digest", "left_semi").select("digest", "found").dropDuplicates(["digest"]))
    unseen = kept(firsts.join(known.select("digest"), "digest", "left_anti"))
    held = [known, unseen]
    new = cut(compact(scan_blobs(first_texts(docs, keys, unseen, doc_id, text, held=held), version)), "new-findings")
    # only blobs with findings are joined back; a hot blob is one row of this side
    found = cut(known.unionByName(new.select("digest", "found")).where(F.size("found") > 0), "found")
    free(*held)
    append(new, ledger)  # last: what is kept of a folder is computed anew when rows are added to it
    return keys.join(found, "digest", "left").select("_id", "digest", F.coalesce("found", F.array().cast(SPANS)).alias("found"))


def redact(docs: DataFrame, ledger: str, *, doc_id: str = "doc_id", text: str = "text", mark: str = "[SECRET]", broadcast_spans: int = BROADCAST_SPANS) -> DataFrame:
    """docs with each secret replaced by a mark; spans that overlap are one. Findings are broadcast if they are few, rows and spans, and shuffled beyond."""
    docs = adopt(docs)
    found = scan(docs, ledger, doc_id=doc_id, text=text).where(F.size("found") > 0).select(F.col("digest").alias("_d"), F.col("found").alias("_f"))
    found = cut(found.dropDuplicates(["_d"]), "secrets")
    size = found.agg(F.count("*").alias("rows"), F.coalesce(F.sum(F.size("_f")), F.lit(0)).alias("spans")).first()
    few = size.rows <= 50_000 and size.spans <= broadcast_spans
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("_row"), digest_of(docs[text]).alias("_h"))
    joined = rows.join(F.broadcast(found) if few else found.hint("merge"), F.col("_h") == F.col("_d"), "left")
    rows = joined.select("_row", "_f")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            row, spans = b.column("_row"), b.column("_f")
            if spans.null_count < b.num_rows:
                at = row.type.get_field_index(text)
                column = row.field(at).to_pylist()
                for k, x in enumerate(spans.to_pylist()):
                    if x:
                        column[k] = masked(column[k], [(s["start"], s["end"]) for s in x], mark)
                fields = [pa.array(column, row.type.field(j).type) if j == at else row.field(j) for j in range(row.type.num_fields)]
                row = pa.StructArray.from_arrays(fields, fields=[row.type.field(j) for j in range(row.type.num_fields)])
            yield pa.RecordBatch.from_arrays([row], names=["_row"])

    return arrow_map(rows, run, rows.select("_row").schema).select("_row.*")


def masked(text: str, spans: list[tuple[int, int]], mark: str) -> str:
    """text with a mark for each span; spans, by start, that overlap are one."""
    out, to = [], 0
    for start, end in spans:
        if start >= to:
            out += [text[to:start], mark]
        to = max(to, end)
    return "".join([*out, text[to:]])


def op8_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(table(spark, sf_dir, "documents"), cache_path(spark, "blob-ledger"))
    spell = lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))
    base = F.filter("found", lambda x: x["kind"].isin(*[k for k, *_ in BASE]))
    count = lambda kind: F.size(F.filter("found", lambda x: x["kind"] == kind)).cast("bigint")
    return found.select(F.col("_id").alias("doc_id"), *[count(k).alias(f"n_{k}") for k, *_ in BASE],
                        F.sha2(F.array_join(F.transform(base, spell), ",").cast("binary"), 256).alias("base_sha256"), F.array_join(F.transform("found", spell), ",").alias("spans"))
