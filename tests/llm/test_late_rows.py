import glob
import hashlib
import math
import random
import zlib
from collections import defaultdict
from datetime import datetime, timedelta

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from turnmill.llm import late_rows as L

SALES = "sale_id bigint, client_id bigint, status string, total double, sold_at timestamp_ntz, arrived_at timestamp_ntz, priority int"
NAMES = [x.split()[0] for x in SALES.split(", ")]
EPOCH = datetime(1970, 1, 1)


def day(t):
    return -1 if t is None else (t - EPOCH).days


def micros(t):
    return "" if t is None else str((t - EPOCH) // timedelta(microseconds=1))


def order(x):
    return (x is not None, x if x is not None else 0) if not isinstance(x, str) else (True, x)


def latest(rows):
    best = {}
    rank = lambda r: [order(r[k]) for k in ("arrived_at", "sold_at", "client_id", "status", "total", "priority")]
    for r in rows:
        k = r["sale_id"]
        if k not in best or rank(r) > rank(best[k]):
            best[k] = r
    return best


def layout(rows, n):
    days = defaultdict(list)
    for r in latest(rows).values():
        days[day(r["sold_at"])].append(r)
    out = {}
    for d, x in days.items():
        x.sort(key=lambda r: (order(r["sold_at"]), order(r["sale_id"])))
        for k in range(0, len(x), n):
            out[d, k // n] = x[k : k + n]
    return out


def expected(sales):
    """The rows of op13's contract."""
    n, rows = 1 + len(sales) // 700, []
    for r in sales:
        rows.append(r)
        h = zlib.crc32(str(r["sale_id"]).encode())
        if r["sale_id"] is not None and h % 3 == 0 and day(r["sold_at"]) % 7 == 0:
            later = lambda t, k: None if t is None else t + timedelta(days=k)
            rows.append(r | {"total": None if r["total"] is None else r["total"] + 1, "sold_at": later(r["sold_at"], h % 2), "arrived_at": later(r["arrived_at"], 1 + h % 97)})
    early = [r for r in rows if r["arrived_at"] is not None and r["arrived_at"] < L.LATE_FROM]
    before, final = layout(early, n), layout(rows, n)
    stood, touched = latest(early), set()
    for k, r in latest(rows).items():
        if r["arrived_at"] is None or r["arrived_at"] >= L.LATE_FROM:
            touched |= {day(r["sold_at"]), *([day(stood[k]["sold_at"])] if k in stood else [])}
    out = []
    for (d, k), x in final.items():
        cents = sum(0 if r["total"] is None else math.floor(100 * r["total"] + 0.5) for r in x)
        crc = sum(zlib.crc32(f"{'' if r['sale_id'] is None else r['sale_id']}:{micros(r['sold_at'])}:{micros(r['arrived_at'])}".encode()) for r in x)
        ids = ",".join("" if r["sale_id"] is None else str(r["sale_id"]) for r in x)
        assert d in touched or before[d, k] == x
        out.append((d, k, len(x), cents, crc, ",".join(NAMES), hashlib.sha256(ids.encode()).hexdigest(), d in touched))
    return sorted(out)


def result(rows):
    return sorted((r.day, r.file_no, r.n_rows, r.cents, r.rows_crc, r.columns, r.ids_sha256, r.rewritten) for r in rows)


def local(path):
    return path.removeprefix("file:").replace("///", "/")


def made(seed, n, spread=150):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        sold = datetime(2024, 1, 1) + timedelta(seconds=rng.randrange(spread * 86400), microseconds=rng.choice([0, 123456])) if rng.random() > 0.03 else None
        arrived = (sold or datetime(2024, 3, 1)) + timedelta(seconds=rng.randrange(20 * 86400)) if rng.random() > 0.03 else None
        key = i if rng.random() > 0.3 else rng.choice([7, 7, 7, rng.randrange(n)])
        out.append(dict(zip(NAMES, (key, i % 5, rng.choice(["open", "done", None]), rng.choice([None, 0.005, 12.345, rng.random() * 900]), sold, arrived, i % 3), strict=True)))
    return out


@pytest.mark.parametrize("sales", [made(1, 900), made(2, 2500, 3), made(3, 1), []], ids=["spread", "few days", "one row", "empty"])
def test_query(spark, tmp_path, sales):
    rows = [tuple(r[c] for c in NAMES) for r in sales]
    # further columns, with names that the operator uses inside
    spark.createDataFrame(rows, SALES).withColumns({c: F.lit("x") for c in ("day", "_at", "_path", "_k", "_b", "_i", "_p")}).repartition(3).write.parquet(f"{tmp_path}/sales.parquet")
    got = L.op13_late_overwrite(spark, str(tmp_path)).collect()
    assert result(got) == expected(sales)
    if got:
        root = local(got[0].path).split("/day=")[0]
        assert sorted(glob.glob(f"{root}/**/*.parquet", recursive=True)) == sorted(local(r.path) for r in got)
        assert all(pq.ParquetFile(local(r.path)).schema.names == NAMES for r in got)


def test_untouched_files_and_emptied_days(spark, tmp_path):
    t = lambda d, h=0: datetime(2024, 1, d, h)
    how = {"key": "sale_id", "time": "sold_at", "arrived": "arrived_at", "file_rows": 2}
    path = f"{tmp_path}/table"
    frame = lambda rows: spark.createDataFrame(rows, SALES)
    L.write_days(frame([(i, 1, "a", 1.0, t(1 + i // 5, i), t(2, i), 1) for i in range(10)] + [(50, 1, "a", 1.0, t(9), t(9), 1)]), path, **how)
    before = {f: open(f, "rb").read() for f in glob.glob(f"{path}/day=*/*.parquet")}
    assert len(before) == 7
    # 50 moves to day 2, 99 is new there; 3 arrives again, no later; a row without arrival does not replace a stored one
    late = [(50, 1, "b", 2.0, t(2, 1), t(20), 1), (99, 1, "b", 2.0, t(2, 23), t(20), 1), (3, 9, "b", 2.0, t(1), t(1), 1), (4, 9, "b", 2.0, t(1), None, 1)]
    assert L.overwrite_late(frame(late), path, **how) == [L_day(t(2)), L_day(t(9))]
    after = {f: open(f, "rb").read() for f in glob.glob(f"{path}/day=*/*.parquet")}
    assert not glob.glob(f"{path}/day={L_day(t(9))}")
    same = [f for f in before if f"day={L_day(t(1))}/" in f]
    assert len(same) == 3 and all(after[f] == before[f] for f in same)
    ids = [pq.ParquetFile(f).read(["sale_id"]).column(0).to_pylist() for f in sorted(after) if f"day={L_day(t(2))}/" in f]
    assert ids == [[50, 5], [6, 7], [8, 9], [99]]
    assert L.overwrite_late(frame([]), path, **how) == []
    assert {f: open(f, "rb").read() for f in glob.glob(f"{path}/day=*/*.parquet")} == after


def L_day(t):
    return (t - EPOCH).days


def test_deletion_vectors_over_block_borders(spark):
    at = [0, 7, 8, L.BLOCK - 1, L.BLOCK, 5 * L.BLOCK + 9]
    v = L.deletion_vectors(spark.createDataFrame([("f", x) for x in at], "_path string, _at bigint"))
    every = spark.range(6 * L.BLOCK).select(F.col("id").alias("_at")).join(v, F.expr(f"_at div {L.BLOCK}") == F.col("_block"), "left")
    assert sorted(r[0] for r in every.where(L.marked(F.col("_bits"), F.col("_at"))).select("_at").collect()) == at


def test_session_zone_takes_no_part(spark):
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        r = spark.sql("SELECT timestamp_ntz'2024-03-10 02:30:00.123456' AS t").select(L.micros_of(F.col("t")), L.day_of(F.col("t"))).first()
        x = datetime(2024, 3, 10, 2, 30, 0, 123456)
        assert tuple(r) == (int(micros(x)), day(x))
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
