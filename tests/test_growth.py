"""Results that must not depend on how a table lies in files, and steps whose cost must grow no faster than their input."""

from __future__ import annotations

import hashlib

import duckdb
import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from docquarry.operators import analytics, chunking, lexical, retrieval
from docquarry.plans import registry


def test_batch_cost_takes_the_first_row_of_a_job_in_table_order(spark, tmp_path):
    at = tmp_path / "lineitem.parquet"
    at.mkdir()
    columns = "l_orderkey, l_linenumber, l_returnflag, l_linestatus, l_quantity"
    duck = duckdb.connect()
    # the second file is larger, so that the engine reads it first
    duck.sql(f"copy (select 1 + i // 4 as l_orderkey, (1 + i % 4)::int as l_linenumber, 'A' as l_returnflag, 'O' as l_linestatus, 1.0::double as l_quantity from range(200) r(i)) to '{at}/part-0.parquet'")
    duck.sql(f"copy (select 1 + i // 4 as l_orderkey, (1 + i % 4)::int as l_linenumber, 'R' as l_returnflag, 'F' as l_linestatus, random() as l_quantity from range(20000) r(i)) to '{at}/part-1.parquet'")
    duck.sql(f"set threads = 1; create view lineitem as select {columns} from read_parquet('{at}/*.parquet')")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "16k")
    try:
        got = registry.queries()["batch_cost"](spark, str(tmp_path))
        names = ", ".join(got.columns)
        assert sorted(map(tuple, got.collect())) == sorted(duck.sql(f"select {names} from ({registry.oracle_sql()['batch_cost']})").fetchall())
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_batch_cost_rounds_tokens_as_its_sql_does(spark, tmp_path):
    duck = duckdb.connect()
    rows = "(1, 1, 'A', 'O', 1.25), (1, 2, 'A', 'O', 1.25), (2, 1, 'R', 'O', 2.5), (2, 2, 'R', 'O', 1.0), (3, 1, 'N', 'O', 0.75), (10, 1, 'N', 'F', 5.0), (10, 1, 'N', 'O', 7.0), (null, 1, 'X', null, 0.5), (null, 1, 'X', 'O', 0.5), (4, 1, null, 'O', null)"
    duck.sql(f"copy (select a::bigint as l_orderkey, b::int as l_linenumber, c as l_returnflag, d as l_linestatus, e::double as l_quantity from (values {rows}) v(a, b, c, d, e)) to '{tmp_path}/lineitem.parquet'")
    duck.sql(f"set threads = 1; create view lineitem as select * from '{tmp_path}/lineitem.parquet'")
    got = registry.queries()["batch_cost"](spark, str(tmp_path))
    names = ", ".join(got.columns)
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, duck.sql(f"select {names} from ({registry.oracle_sql()['batch_cost']})").fetchall()))


def test_stems_in_python_equal_those_in_columns(spark):
    words = "classes ponies dies gas bus cats running hopped sized tabled agreed feed y try sky fizzing conflated needing strasse día naïve ß ties 12s añadidas s es ing ed bring flies ﬁlled straßen élancées".split()
    words += [a + b for a in ("ca", "bat", "tabl", "siz", "hopp", "agre", "ski", "oy", "é", "x") for b in ("", "s", "es", "ies", "sses", "ed", "eed", "ing", "y", "ys")]
    got = spark.createDataFrame([(w,) for w in words], "w string").select("w", retrieval.stem(F.col("w"))).collect()
    assert [(w, s) for w, s in got if s != retrieval.stem_word(w)] == []


def test_remembered_stems_are_bounded():
    stems, most = {}, 0
    for k in range(150):
        words = ["running", *(f"w{k}x{i}s" for i in range(1000))]
        assert lexical._stems_of(words, stems) == [retrieval.stem_word(w) for w in words]
        most = max(most, len(stems))
    assert most <= 102_000


def test_index_is_built_without_a_shuffle_of_words(spark, tmp_path):
    words = [f"w{k}x" for k in range(3000)]
    docs = spark.createDataFrame([(k, " ".join(words[(7 * k + 13 * i) % 3000] for i in range(400))) for k in range(1000)], "doc_id long, text string").repartition(4)
    path = str(tmp_path / "docs")
    docs.write.parquet(path)
    tracker = spark.sparkContext._jsc.sc().statusStore()
    written = lambda: sum(tracker.executorList(False).apply(i).totalShuffleWrite() for i in range(tracker.executorList(False).size()))
    before = written()
    index = lexical.LexicalIndex(spark, str(tmp_path / "index"))
    assert index.add(spark.read.parquet(path)) == 1000
    assert written() - before < 100_000  # keys and lengths; the words were several MB
    assert index.postings().agg(F.sum("n")).first()[0] == 400_000
    # a row repeated under one key is one document with all texts
    twice = lexical.LexicalIndex(spark, str(tmp_path / "twice"))
    assert twice.add(spark.createDataFrame([(1, "alpha beta"), (1, "alpha"), (2, "beta")], "doc_id long, text string")) == 2
    posts = twice.postings().select("term", F.inline("posts"))
    assert {tuple(r) for r in posts.collect()} == {("alpha", 1, 2, 3), ("beta", 1, 1, 3), ("beta", 2, 1, 1)}


def test_a_side_without_weight_is_not_searched(spark, monkeypatch):
    monkeypatch.setattr(lexical, "index_of", None)
    assert registry.queries()["hybrid_one_sided"](spark, "/root/testdata/sf0.001").count()


def test_headers_are_tried_only_where_one_begins(monkeypatch):
    tried = []

    class Counted:
        def __getattr__(self, name):
            def run(text, *at):
                tried.append(at)
                return getattr(pattern, name)(text, *at)

            return run

    pattern = chunking._HEADERS
    monkeypatch.setattr(chunking, "_HEADERS", Counted())
    text = "Plain prose with items of interest. " * 500 + "ITEM 1A. Risk Factors xItem 2 Management's Discussion and Analysis of Financial Condition and Results of Operations, Properties"
    got = [m.span() for m in chunking._headers(text)]
    assert got == [m.span() for m in pattern.finditer(text)] and len(got) == 4 and len(tried) < 510 and all(at for at in tried)
    odd = "Item 3. İtem 4. Legal Proceedingſ K"
    assert [m.span() for m in chunking._headers(odd)] == [m.span() for m in pattern.finditer(odd)]


def test_letters_of_a_window_stop_early():
    page = chunking.Page("<p>" + "ab&amp;c<b>d</b> 12 " * 1000)
    shown = [c for c in __import__("re").sub("<[^>]+>|&[^;]+;", "", page.html) if c.isalpha()]
    assert page.shows_letters(0, len(page.html), len(shown)) and not page.shows_letters(0, len(page.html), len(shown) + 1)
    assert "letters" not in vars(page)


def test_ranks_sort_a_date_once_and_carry_no_other_column(spark):
    df = spark.createDataFrame([(d, float(x % 7), float((x * 5) % 11), "long" * 9) for d in (1, 2) for x in range(40)] + [(3, 1.0, 2.0, ""), (3, 2.0, 1.0, "")], "d int, a double, b double, other string")
    got = analytics.rank_ic(df, "d", "a", "b", least=3)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Window [") == 2 and "other#" not in plan.split("LogicalRDD")[0].split("Project")[-1]
    assert {r["d"]: round(r["ic"], 9) for r in got.collect()} == {d: round(float(pd.DataFrame([(x % 7, (x * 5) % 11) for x in range(40)]).corr("spearman").iloc[0, 1]), 9) for d in (1, 2)}


def test_ic_of_all_horizons_has_t_and_decay_and_sorts_a_date_once_a_column(spark):
    rng = np.random.default_rng(4)
    rows = [(day, float(rng.integers(6)), *[float(x) if rng.random() < 0.8 else None for x in rng.integers(9, size=2)]) for day in range(12) for _ in range(30)]
    rows += [(20, 1.0, float(x), float(x)) for x in range(5)] + [(21, float(x), 2.0, float(x)) for x in range(5)] + [(22, 1.0, 2.0, 3.0), (22, 2.0, 1.0, 3.0), (20, None, 9.0, 9.0)]
    df = spark.createDataFrame(rows, "day int, s double, y1 double, y5 double")
    got = analytics.ic_by_horizon(df, "day", "s", {1: "y1", 5: "y5"}, least=3)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and plan.count("Sort [") == 3
    want = {}
    for h, y in ((1, "y1"), (5, "y5")):
        for day, g in pd.DataFrame(rows, columns=["day", "s", "y1", "y5"]).dropna(subset=["s", y]).groupby("day"):
            if len(g) >= 3:
                want[h, day] = round(float(g["s"].rank().corr(g[y].rank())), 9) if g["s"].nunique() > 1 and g[y].nunique() > 1 else None
    ics = {(r["horizon"], r["day"]): r["ic"] for r in got.collect()}
    assert {k: None if x is None else round(x, 9) for k, x in ics.items()} == want and want[1, 20] is None and want[1, 21] is None and want[5, 21] == 1
    stats = {r["horizon"]: r for r in analytics.ic_summary(got, "horizon", "ic").collect()}
    for h in (1, 5):
        x = pd.Series([v for (at, _), v in want.items() if at == h and v is not None])
        assert stats[h]["n"] == len(x) and abs(stats[h]["mean"] - x.mean()) < 1e-8 and abs(stats[h]["t"] - x.mean() / (x.std() / len(x) ** 0.5)) < 1e-6
        assert abs(stats[h]["decay"] - stats[h]["mean"] / stats[1]["mean"]) < 1e-9


def test_ic_analysis_judges_each_date_at_all_horizons(spark, tmp_path):
    duck = duckdb.connect()
    # 5 keys, 30 days; the returns from the 12th to the 13th are 0, so that neither date has an information coefficient
    close = "case when i % 30 = 12 then 100 + 7 * (((i - 1) * 37 + (i - 1) // 30 * 11) % 23) else 100 + 7 * ((i * 37 + i // 30 * 11) % 23) end"
    duck.sql(f"copy (select i // 30 as l_suppkey, timestamp '2024-01-01' + interval 1 day * (i % 30) as l_shipdate, ({close})::double as l_extendedprice, 1.0::double as l_quantity from range(150) r(i) union all select 9, null, 5.0, 1.0) to '{tmp_path}/lineitem.parquet'")
    duck.sql(f"create view lineitem as select * from '{tmp_path}/lineitem.parquet'")
    got = registry.queries()["ic_analysis"](spark, str(tmp_path))
    names = ", ".join(got.columns)
    rows = sorted(map(str, map(tuple, got.collect())))
    assert rows == sorted(map(str, duck.sql(f"select {names} from ({registry.oracle_sql()['ic_analysis']})").fetchall()))
    found = {(r["horizon"], r["day"]): r for r in got.collect()}
    assert {h: sum(at == h for at, _ in found) for h in (1, 5, 20)} == {1: 28, 5: 24, 20: 9}
    assert found[1, "2024-01-12"]["ic"] is None and found[1, "2024-01-13"]["ic"] is None and found[1, "2024-01-13"]["n"] == 26 and found[1, "2024-01-13"]["decay"] == 1


def test_bootstrap_compares_digests_as_they_are(spark):
    df = spark.createDataFrame([(k, float(k % 13)) for k in range(300)], "k int, x double")
    got = analytics.bootstrap_means(df, "k", "x", 5)
    assert "conv(" not in got._jdf.queryExecution().optimizedPlan().toString()
    for r in got.collect():
        units = [int(hashlib.md5(f"0:{r['replicate']}:{k}".encode()).hexdigest()[:8], 16) / 2**32 for k in range(300)]
        w = [sum(u >= t for t in analytics.POISSON) for u in units]
        assert abs(r["mean"] - sum(a * (k % 13) for k, a in enumerate(w)) / sum(w)) < 1e-12
