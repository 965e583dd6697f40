import glob
import hashlib
import random
import zlib
from datetime import datetime, timedelta
from math import floor

import duckdb
import pyarrow.parquet as pq
import pytest

from glossarium.llm import merkle, overwrite, topk
from glossarium.llm.common import table


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def field(x):
    return "-" if x is None else f"{len(str(x).encode())}:{x}"


def leaf_of(r, more=0):
    n = None if r["n_chars"] is None else r["n_chars"] + more
    return sha(*map(field, (r["doc_id"], r["source"], r["lang"], n, r["text"])))


def tree_brute(hashes):
    """The root, and for each leaf its siblings' (place, hash) on the way up, None where there is none."""
    ways, at, level = [[] for _ in hashes], list(range(len(hashes))), hashes
    while len(level) > 1:
        for k, way in enumerate(ways):
            i = at[k]
            way.append((i ^ 1 > i, level[i ^ 1]) if i ^ 1 < len(level) else None)
            at[k] = i // 2
        level = [sha(*level[j : j + 2]) for j in range(0, len(level), 2)]
    return level[0], ways


def manifest_brute(rows):
    groups = {}
    for r in rows:
        groups.setdefault(r["lang"], []).append(r)
    langs = sorted(groups, key=lambda x: (x is not None, (x or "").encode()))
    trees = {}
    for lang in langs:
        own = sorted(groups[lang], key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, leaf_of(r)))
        trees[lang] = (own, *tree_brute([leaf_of(r) for r in own]))
    root, tops = tree_brute([trees[lang][1] for lang in langs]) if langs else (None, [])
    out = []
    for lang, top in zip(langs, tops):
        own, subroot, ways = trees[lang]
        for r, way in zip(own, ways):
            touched = r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 7 == 0
            acc = leaf_of(r, int(touched))
            for step in way + top:
                acc = sha(acc) if step is None else sha(acc, step[1]) if step[0] else sha(step[1], acc)
            proof = sha(*(s[1] for s in way + top if s))
            out.append((r["doc_id"], leaf_of(r), subroot, root, proof, acc, acc == root))
    return out


KEYS = ("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


def manifest_rows(spark, docs):
    touched = merkle.F.crc32(merkle.F.col("doc_id").cast("string").cast("binary")) % 7 == 0
    more = {"n_chars": merkle.F.col("n_chars").cast("decimal(20,0)") + 1}
    return [tuple(r[k] for k in KEYS) for r in merkle.manifest(docs, merkle.FIELDS, "lang", "doc_id", more, touched).collect()]


def in_order(rows):
    return sorted(rows, key=repr)


def test_manifest_of_all_documents(spark, sf):
    got = [tuple(r[k] for k in KEYS) for r in merkle.op13_merkle(spark, sf).collect()]
    rows = [r.asDict() for r in table(spark, sf, "documents").collect()]
    assert in_order(got) == in_order(manifest_brute(rows))
    assert {r[6] for r in got} == {True, False}
    assert all(r[6] == (zlib.crc32(str(r[0]).encode()) % 7 != 0) for r in got)


def test_manifest_sql(spark, sf):
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{sf}/documents.parquet'")
    assert in_order(con.execute(f"select {', '.join(KEYS)} from ({merkle.OP13_SQL})").fetchall()) == in_order(manifest_brute([r.asDict() for r in table(spark, sf, "documents").collect()]))


def test_manifest_of_odd_rows(spark):
    rng = random.Random(3)
    rows = [(k, None if k % 9 == 0 else f"é{k}", rng.choice([None, "a", "ä", "b", ""]), None if k % 4 == 0 else k, None if k % 5 == 0 else "x" * (k % 3)) for k in range(61)]
    rows += [(7, "s", "a", 1, "t")] * 3 + [(None, "s", "a", 1, "t"), (None, None, None, None, None), (1 << 40, "long", "b", (1 << 63) - 1, "y" * 300_000), (99, "s", "alone", 2, "z")]
    docs = spark.createDataFrame([(*r, "q", 1) for r in rows], "doc_id long, source string, lang string, n_chars long, text string, g string, i int").repartition(3)
    got = manifest_rows(spark, docs)
    assert in_order(got) == in_order(manifest_brute([dict(zip(("doc_id", "source", "lang", "n_chars", "text"), r)) for r in rows]))


@pytest.mark.parametrize("n", [0, 1, 2, 3])
def test_manifest_of_few_rows(spark, n):
    docs = spark.createDataFrame([(k, "s", "a", k, "t") for k in range(n)], "doc_id long, source string, lang string, n_chars int, text string")
    assert in_order(manifest_rows(spark, docs)) == in_order(manifest_brute([r.asDict() for r in docs.collect()]))


def top_brute(rows, k=5):
    valid = [(i, [floor(256 * x) for x in v]) for i, v in rows if v is not None and all(x is not None and abs(x) != float("inf") and x == x for x in v)]
    best = {}
    for q, a in valid:
        if q is None or q % 50:
            continue
        for c, b in valid:
            if c != q:
                s = sum(x * y for x, y in zip(a, b))
                best.setdefault(q, {})[c] = max(s, best.get(q, {}).get(c, s))
    out = []
    for q, found in best.items():
        for rank, (c, s) in enumerate(sorted(found.items(), key=lambda x: (-x[1], x[0] is None, x[0] or 0))[:k], 1):
            out.append((q, rank, c, s))
    return sorted(out, key=repr)


def test_top_k_of_all_vectors(spark, sf):
    got = sorted(((r.query_id, r["rank"], r.vec_id, r.score) for r in topk.op12_top_k(spark, sf).collect()), key=repr)
    assert got == top_brute([(r.vec_id, r.embedding) for r in table(spark, sf, "embeddings").collect()])


def test_top_k_sql(spark, sf):
    con = duckdb.connect()
    con.execute(f"create view embeddings as select * from '{sf}/embeddings.parquet'")
    cols = ("query_id", "rank", "vec_id", "score")
    want = sorted(con.execute(f"select {', '.join(cols)} from ({topk.OP12_SQL})").fetchall())
    assert sorted(tuple(r[c] for c in cols) for r in topk.op12_top_k(spark, sf).collect()) == want


@pytest.mark.parametrize("block", [4096, 7])
def test_top_k_of_odd_rows(spark, monkeypatch, block):
    monkeypatch.setattr(topk, "CANDIDATES", block)
    monkeypatch.setattr(topk, "QUERIES", 2)
    rng = random.Random(8)
    sparse = lambda n: [rng.choice([0.0, 0.0, 0.0, 1.0, -0.5, 0.001]) for _ in range(n)]
    rows = [(k * 25, sparse(6)) for k in range(40)]
    rows += [(50, sparse(6)), (100, rows[4][1]), (100, rows[4][1]), (7, sparse(6)), (7, sparse(6)), (None, sparse(6)), (None, sparse(6))]
    rows += [(150, None), (200, [1.0, None]), (250, [float("nan")] * 6), (300, [float("inf")] * 6), (350, []), (400, sparse(3)), (8, sparse(9))]
    frame = spark.createDataFrame([(*r, 1, "x") for r in rows], "vec_id long, embedding array<float>, id int, v string").repartition(3)
    got = sorted(((r.query_id, r["rank"], r.id, r.score) for r in topk.exact_top(frame).collect()), key=repr)
    assert got == top_brute(rows)
    assert topk.exact_top(frame.limit(0)).collect() == []
    one = spark.createDataFrame([(50, [1.0])], "vec_id long, embedding array<float>")
    assert topk.exact_top(one).collect() == []


EPOCH, CUT = datetime(1970, 1, 1), datetime(2024, 4, 10)
SALE = ("sale_id", "client_id", "status", "total", "sold_at", "arrived_at", "priority")


def day_of(at):
    return -1 if at is None else (at - EPOCH) // timedelta(days=1)


def layout_brute(rows, size):
    """(day, file number) -> rows."""
    best = {}
    for r in rows:
        if r["sale_id"] not in best or (r["arrived_at"] or datetime.min) > (best[r["sale_id"]]["arrived_at"] or datetime.min):
            best[r["sale_id"]] = r
    days = {}
    for r in best.values():
        days.setdefault(day_of(r["sold_at"]), []).append(r)
    files = {}
    for d, own in days.items():
        own.sort(key=lambda r: (r["sold_at"] or datetime.min, r["sale_id"] is not None, r["sale_id"] or 0))
        files |= {(d, k // size): own[k : k + size] for k in range(0, len(own), size)}
    return files, {k: day_of(r["sold_at"]) for k, r in best.items()}, best


def copies_brute(rows):
    out = []
    for r in rows:
        h = None if r["sale_id"] is None else zlib.crc32(str(r["sale_id"]).encode())
        if h is not None and h % 3 == 0 and r["sold_at"] is not None and day_of(r["sold_at"]) % 7 == 0:
            out.append(r | {"total": None if r["total"] is None else r["total"] + 1, "sold_at": r["sold_at"] + timedelta(days=h % 2), "arrived_at": r["arrived_at"] and r["arrived_at"] + timedelta(days=1 + h % 97)})
    return rows + out


def micros(at):
    return "" if at is None else (at - EPOCH) // timedelta(microseconds=1)


def report_brute(rows, size):
    rows = copies_brute(rows)
    late = lambda r: r["arrived_at"] is None or r["arrived_at"] >= CUT
    _, stood, _ = layout_brute([r for r in rows if not late(r)], size)
    files, days, best = layout_brute(rows, size)
    dirty = {d for k, r in best.items() if late(r) for d in (days[k], stood.get(k))}
    out = {}
    for (d, k), own in files.items():
        name = lambda x: "" if x is None else str(x)
        crc = sum(zlib.crc32(f"{name(r['sale_id'])}:{micros(r['sold_at'])}:{micros(r['arrived_at'])}".encode()) for r in own)
        cents = sum(0 if r["total"] is None else floor(100 * r["total"] + 0.5) for r in own)
        out[d, k] = (len(own), cents, crc, hashlib.sha256(",".join(name(r["sale_id"]) for r in own).encode()).hexdigest(), d in dirty)
    return out


def test_overwrite_of_all_sales(spark, sf):
    got = overwrite.op11_overwrite(spark, sf).collect()
    rows = [r.asDict() for r in table(spark, sf, "sales").collect()]
    want = report_brute(rows, 1 + len(rows) // 700)
    assert {(r.day, r.file_no): (r.n_rows, r.cents, r.rows_crc, r.ids_sha256, r.rewritten) for r in got} == want
    assert {r.columns for r in got} == {",".join(SALE)} and {r.rewritten for r in got} == {True, False}
    folder = got[0].path.rsplit("/", 2)[0]
    assert sorted(glob.glob(f"{folder}/**/*.parquet", recursive=True)) == sorted(r.path for r in got)
    assert not glob.glob(folder.replace("/layout-", "/staging-"))
    assert pq.read_schema(got[0].path).types == pq.read_schema(f"{sf}/sales.parquet").types


SALES_DDL = "sale_id long, client_id long, status string, total double, sold_at timestamp_ntz, arrived_at timestamp_ntz, priority int"


def test_overwrite_of_odd_rows(spark):
    rng = random.Random(4)
    start = datetime(2024, 4, 1)
    rows = []
    for k in range(300):
        sold = None if k % 11 == 0 else start + timedelta(hours=rng.randrange(24 * 20), microseconds=k)
        rows.append({"sale_id": rng.randrange(200), "client_id": None, "status": "it's", "total": None if k % 7 == 0 else k / 8, "sold_at": sold, "arrived_at": None if k % 13 == 0 else start + timedelta(minutes=37 * k), "priority": k})
    rows = list({(r["sale_id"], r["arrived_at"]): r for r in rows}.values())  # ties have a test of their own
    rows += [dict(rows[5])] * 3 + [rows[9] | {"sale_id": None}]
    frame = spark.createDataFrame([(*(r[c] for c in SALE), "x", 2) for r in rows], SALES_DDL + ", layout_day string, `row_number` int").repartition(3)
    layout, first = overwrite.build_and_overwrite(overwrite.with_copies(frame), "2024-04-10 00:00:00", 4, "sale_id", "arrived_at", "sold_at")
    before = set(overwrite.layout_files(layout))
    got = overwrite.report(spark, layout, first, "sale_id", "sold_at", "arrived_at", "total").collect()
    assert {(r.day, r.file_no): (r.n_rows, r.cents, r.rows_crc, r.ids_sha256, r.rewritten) for r in got} == report_brute(rows, 4)
    assert {r.columns for r in got} == {",".join(SALE) + ",layout_day,row_number"} and len(before) == len(got)
    layout, first = overwrite.build_and_overwrite(frame.limit(0), "2024-04-10 00:00:00", 4, "sale_id", "arrived_at", "sold_at")
    assert not overwrite.layout_files(layout) and overwrite.report(spark, layout, first, "sale_id", "sold_at", "arrived_at", "total").collect() == []


def test_of_rows_that_arrive_together_the_greatest_stands(spark):
    at = datetime(2024, 4, 2)
    rows = [(1, 5, "a", 1.0, at, at, 1), (1, 6, "a", 0.5, at, at, 1), (1, None, "z", 9.0, at, at, 1)]
    layout, _ = overwrite.build_and_overwrite(spark.createDataFrame(rows, SALES_DDL), "2024-04-10 00:00:00", 4, "sale_id", "arrived_at", "sold_at")
    (path,) = overwrite.layout_files(layout)
    assert pq.read_table(path).column("client_id").to_pylist() == [6]


def test_days_that_lose_all_rows_have_no_files_and_a_repeated_commit_changes_nothing(spark, tmp_path):
    early, late = datetime(2024, 4, 2), datetime(2024, 4, 12)
    rows = [(1, 1, "a", 1.0, early, early, 1), (1, 1, "b", 1.0, late, late, 1), (2, 1, "c", 1.0, None, early, 1)]
    layout, first = overwrite.build_and_overwrite(spark.createDataFrame(rows, SALES_DDL), "2024-04-10 00:00:00", 4, "sale_id", "arrived_at", "sold_at")
    now = overwrite.layout_files(layout)
    assert [p.split("/")[-2] for p in now] == ["day=-1", f"day={day_of(late)}"] and [p in first for p in now] == [True, False]
    stamp = now[1].rsplit("part-00000-", 1)[1].removesuffix(".parquet")
    import pyarrow as pa

    made = pa.RecordBatch.from_arrays([pa.array([day_of(late)]), pa.array([str(tmp_path / "moved")])], names=["day", "folder"])
    list(overwrite._commit(layout, stamp)(iter([made])))
    assert overwrite.layout_files(layout) == now


def test_a_day_beyond_memory_is_sorted_on_disk(tmp_path):
    con = duckdb.connect()
    con.execute(f"copy (select hash(i) % 1000000007 as id, i % 97 as at, repeat(md5(i::varchar), 12) as pad from range(900000) t(i)) to '{tmp_path}/in.parquet'")
    out = overwrite.merge_day([], [], [f"{tmp_path}/in.parquet"], f"{tmp_path}/new", "s", ["id", "at", "pad"], "id", ["at", "id"], 250_000, f"{tmp_path}/work")
    assert [pq.ParquetFile(p).metadata.num_rows for p in out] == [250_000, 250_000, 250_000, 150_000]
    seen = [x for p in out for x in zip(*(pq.read_table(p, columns=["at", "id"]).column(c).to_pylist() for c in ("at", "id")))]
    assert seen == sorted(seen) and not glob.glob(f"{tmp_path}/work*")
