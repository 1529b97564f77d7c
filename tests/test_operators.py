from __future__ import annotations

import datetime as dt
import shutil
import subprocess
import sys
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from docquarry import session
from docquarry.functions import text
from docquarry.operators import analytics, calls, chunking, citations, ledger, pit, readers, retrieval, store
from docquarry.sources import files
from docquarry.streaming import streams


def test_calendar_anchors():
    nxt = {d: (s, h) for d, s, h in pit.calendar_rows()}
    day = dt.date.fromisoformat
    for at, session, hour in (
        ("2024-03-28", "2024-04-01", 16),  # Good Friday
        ("2023-12-22", "2023-12-26", 16),
        ("2024-11-27", "2024-11-29", 13),  # the day after Thanksgiving
        ("2024-12-23", "2024-12-24", 13),
        ("2024-07-02", "2024-07-03", 13),
        ("2022-06-17", "2022-06-21", 16),  # Juneteenth observed
        ("2001-09-10", "2001-09-17", 16),
        ("2024-01-12", "2024-01-16", 16),
        ("2021-12-31", "2022-01-03", 16),
    ):
        assert nxt[day(at)] == (day(session), hour)


def test_cutoff_refuses_naive_and_missing_times(spark):
    with pytest.raises(TypeError):
        pit.with_cutoff(spark.sql("select timestamp_ntz'2024-01-02 00:00:00' as event_datetime"))
    with pytest.raises(Exception, match="outside the calendar"):
        pit.with_cutoff(spark.sql("select cast(null as timestamp) as event_datetime")).collect()


def test_cutoff_uses_the_new_york_date(spark):
    rows = spark.sql("select timestamp'2024-01-02 02:00:00' as event_datetime union all select timestamp'2024-07-05 13:00:00'")
    got = sorted(r[0].isoformat() for r in pit.with_cutoff(rows).select(F.date_format("as_of_ts", "yyyy-MM-dd HH:mm").alias("x")).select(F.to_timestamp("x")).collect())
    assert [g[:16] for g in got] == ["2024-01-02T21:00", "2024-07-08T20:00"]


def test_as_of_never_looks_ahead(spark):
    f = spark.createDataFrame([(1, "2024-01-02 21:00:00", 1.0, 1), (1, "2024-01-03 21:00:00", 2.0, 2)], "e int, a string, v double, tie int").select("e", F.to_timestamp("a").alias("as_of_ts"), "v", "tie")
    s = spark.createDataFrame([(1, 1, "2024-01-02 20:59:59"), (2, 1, "2024-01-02 21:00:00"), (3, 1, "2024-02-03 00:00:00"), (4, 9, "2024-02-03 00:00:00")], "s int, e int, t string").select("s", "e", F.to_timestamp("t").alias("t"))
    got = {r["s"]: r["v"] for r in pit.as_of(s, f, "e", "t", ["v"], tie="tie").collect()}
    assert got == {1: None, 2: 1.0, 3: 2.0, 4: None}
    assert {r["s"]: r["v"] for r in pit.as_of(s, f, "e", "t", ["v"], 7, tie="tie").collect()} == {1: None, 2: 1.0, 3: None, 4: None}


def test_ledger_append_keeps_repeats_inside_a_batch_and_compares_nulls(spark):
    ddl = "source string, doc_id string, status string"
    old = spark.createDataFrame([("a", "1", "ok"), (None, "2", "ok")], ddl)
    new = spark.createDataFrame([("a", "1", "ok"), ("a", "1", "error"), (None, "2", "ok"), ("b", "3", "ok"), ("b", "3", "ok")], ddl)
    assert sorted(map(tuple, ledger.new_rows(old, new).collect())) == [("a", "1", "error"), ("b", "3", "ok"), ("b", "3", "ok")]
    with pytest.raises(ValueError):
        ledger.new_rows(old, new, ("nope",))


def test_missing_ledger_is_an_empty_table(spark, tmp_path):
    assert files.scan_ledger(spark, str(tmp_path / "none")).count() == 0


def test_offsets_are_code_points(spark):
    df = spark.createDataFrame([("a😀b.c a😀b.c",)], "t string").withColumn("q", F.lit("b.c"))
    assert df.select(text.occurrences(F.col("t"), F.col("q"))).first()[0] == [2, 8]
    html = "x<!-- 😀 -->y<!-- open"
    assert spark.createDataFrame([(html,)], "t string").select(text.mask_comments(F.col("t"))).first()[0] == "x" + " " * 10 + "y<!-- open"


def test_spans_pair_in_order_or_not_at_all(spark):
    docs = spark.createDataFrame([(1, "ab ab x")], "doc_id int, text string")
    quotes = spark.createDataFrame([(1, "ab"), (2, "x"), (3, "zz")], "item_id int, quote string")
    found = citations.occurrence_table(docs, quotes)
    claims = spark.createDataFrame([(1, 1, "ab", 0), (1, 1, "ab", 1), (1, 2, "x", 0), (1, 2, "x", 1), (1, 3, "zz", 0)], "doc_id int, item_id int, quote string, ordinal int")
    got = sorted((r["item_id"], r["ordinal"], r["outcome"], r["start"]) for r in citations.pair_spans(claims, found).collect())
    assert got == [(1, 0, "ok", 0), (1, 1, "ok", 3), (2, 0, "insufficient", None), (2, 1, "insufficient", None), (3, 0, "not_found", None)]


def test_chunks_tile_their_sections_exactly():
    prose = "<p>" + "Plain words of a long report follow here. " * 60 + "</p>"
    html = f"<p>Item 1. Business</p>{prose * 9}<table><tr><td><table></table></td></tr></table>{prose}<p>Item&#160;1A. Risk Factors</p>{prose}<p><a href='#x'>Item 7. Results</a></p>"
    outcome, rows = chunking.chunk(html)
    assert outcome == "chunked" and {r["section"] for r in rows} == {"Item 1", "Item 1A"}
    assert [r["start"] for r in rows][1:] == [r["end"] for r in rows][:-1] and rows[0]["start"] == 3 and rows[-1]["end"] == len(html)
    assert sum(r["from_table"] for r in rows) == 1
    assert all(chunking.default_tokens(r["end"] - r["start"]) <= chunking.HARD_CHILD for r in rows)


def test_statistics():
    assert analytics.digamma(np.array([1.0]))[0] == pytest.approx(-0.5772156649, abs=1e-8)
    assert analytics.deflated_sharpe(0.1, 100, 0.0, 3.0, 1, 0.0) == pytest.approx(0.84, abs=0.01)
    assert np.abs(analytics.shrunk_weights(np.random.default_rng(0).normal(size=(50, 3)), np.array([0.1, 0.2, 0.3]))).sum() == pytest.approx(1)


def test_stream_append_is_idempotent(spark, tmp_path):
    src, path = str(tmp_path / "src"), str(tmp_path / "ledger")
    df = spark.createDataFrame([("a", "1", "ok"), ("a", "1", "ok"), ("b", "2", "ok")], "source string, doc_id string, status string")
    df.write.parquet(src)
    for k in range(2):
        streams.append_to_ledger(spark.readStream.schema(df.schema).parquet(src), path, str(tmp_path / f"p{k}")).awaitTermination()
    assert spark.read.parquet(path).count() == 2


def test_sessions_open_at_the_end_are_returned(spark):
    import duckdb

    from docquarry.plans import registry

    path = "/root/testdata/sf0.01"
    got = registry.queries()["stream_session"](spark, path).selectExpr("user_id", "start as s", "`end` as e", "n").collect()
    sql = f"""with g as (select user_id, ts, coalesce(ts - lag(ts) over w > interval 6 hours, true)::int as fresh from '{path}/events.parquet' window w as (partition by user_id order by ts)),
    n as (select *, sum(fresh) over (partition by user_id order by ts rows unbounded preceding) as k from g)
    select user_id, epoch_us(min(ts)), epoch_us(max(ts) + interval 6 hours), count(*) from n group by user_id, k"""
    assert sorted(tuple(r) for r in got) == sorted(duckdb.sql(sql).fetchall())


def test_library_stands_without_the_optional_subpackage(tmp_path):
    root = Path(__file__).resolve().parents[1]
    shutil.copytree(root / "docquarry", tmp_path / "docquarry", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(root / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; assert len(e.queries()) > 50 and 'pipeline' not in e.queries()"
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True)
    assert done.returncode == 0, done.stderr


PROSE = "<p>Plain words of a long report follow here. " + "More of them come. " * 40 + "</p>"


def sections(html):
    return [name for name, _, _ in chunking.detect_sections(chunking.Page(html))]


@pytest.mark.parametrize("dash", ["&#8212;", "&mdash;", " &#8211; ", "&ndash;", " - ", ": ", ". ", "—"])
def test_header_separators(dash):
    assert sections(f"<div><span style='font-weight:700'>Item 1A{dash}Risk Factors</span></div>{PROSE}") == ["Item 1A"]


def test_header_contexts():
    assert sections(f"{PROSE}Item 7. Results{PROSE}") == ["Item 7"]  # right after a closing block
    assert sections(f"<h1>Item 1A. Risks</h1>{PROSE}<p>... compared to <span>Item 7</span> discussed elsewhere{PROSE}") == ["Item 1A"]
    assert sections(f"<p>see Item 7 of this Form</p><p>Item 408. Rules</p><p>Item&NBSP;5. No</p><!-- Item 2. Properties -->{PROSE}") == []
    assert sections("<p>Item 1. Business</p><p>short</p>") == []
    titles = "<div><span style='font-size:18pt;font-weight:700'>Risk Factors</span></div>"
    toc = "<div><a href='#i'>Risk Factors</a></div><p>about <b>Risk Factors</b> in prose</p>"
    html = f"{toc}{PROSE}{titles}{PROSE}<!-- cut -->Legal Proceedings{PROSE}"
    assert sections(html) == ["Item 1A", "Item 3"] and chunking.detect_sections(chunking.Page(html))[0][1] == html.index("Risk Factors</span></div><p>Plain")


def test_outcomes_by_kind(spark):
    html = f"<p>Item 1. Business</p>{PROSE}"
    docs = spark.createDataFrame([(1, html, "10-K"), (2, html, "8-K"), (3, html, "memo"), (4, "<p>none</p>", "10-K"), (5, None, "10-K"), (6, html, "own")], "doc_id int, html string, kind string")
    detectors = chunking.DETECTORS | {"own": lambda h, masked: [("All", 0, len(h))]}
    got = {r["doc_id"]: (r["outcome"], r["section"], r["parent_id"]) for r in chunking.parse_filings(docs, kind="kind", detectors=detectors).collect()}
    assert got == {1: ("chunked", "Item 1", 0), 2: ("not_implemented", None, None), 3: ("unsupported_doc_type", None, None), 4: ("no_sections", None, None), 5: ("no_sections", None, None), 6: ("chunked", "All", 0)}


def test_flexible_quotes(spark):
    text = "We may offer\n  shares. We may\toffer shares (a+b) again; a.b"
    docs = spark.createDataFrame([(1, text), (2, None), (3, "We may offer shares")], "doc_id int, text string")
    asked = [(1, 0, "We may offer shares"), (1, 1, "We may offer shares"), (1, 2, "a.b"), (1, 3, "(a+b)  again"), (1, 4, "  "), (1, 5, None), (1, 6, "shares"), (1, 7, "a.b c"), (2, 0, "x"), (9, 0, "x")]
    got = {(r["doc_id"], r["ordinal"]): (r["outcome"], r["snapped"]) for r in citations.resolve_quotes(docs, spark.createDataFrame(asked, "doc_id int, ordinal int, quote string")).collect()}
    assert got == {
        (1, 0): ("ok", "We may offer\n  shares"), (1, 1): ("ok", "We may\toffer shares"), (1, 2): ("ok", "a.b"), (1, 3): ("ok", "(a+b) again"), (1, 4): ("empty", None), (1, 5): ("empty", None),
        (1, 6): ("ambiguous", None), (1, 7): ("not_found", None), (2, 0): ("not_found", None), (9, 0): ("not_found", None),
    }
    quotes = spark.createDataFrame([(1, "We may offer shares"), (2, "e may offer sha"), (3, "offer"), (4, "may offer shares ("), (5, ""), (6, None), (7, "offer shares")], "item_id int, quote string")
    rows = sorted((r["item_id"], r["doc_id"], r["start"]) for r in citations.occurrence_table(docs, quotes).collect())
    starts = {1: [0, 23], 2: [1, 24], 3: [7, 30], 4: [26], 7: [7, 30]}
    assert rows == sorted([(i, 1, s) for i, v in starts.items() for s in v] + [(i, 3, {1: 0, 2: 1, 3: 7, 7: 7}[i]) for i in (1, 2, 3, 7)])


def test_stems_and_sides(spark):
    words = "classes ponies cats bus caress offered agreed hoping sized running falling happy say sing red".split()
    got = spark.createDataFrame([(w,) for w in words], "w string").select(retrieval.stem(F.col("w"))).collect()
    assert [r[0] for r in got] == "class poni cat bus caress offer agreed hop size run fall happi say sing red".split()
    side = spark.createDataFrame([(1, 7, 1), (1, 8, 2)], "query_id int, doc_id int, rank long")
    other = spark.createDataFrame([(1, 9, 1)], "query_id int, doc_id int, rank long")
    assert [r["doc_id"] for r in retrieval.hybrid(side, other, "doc_id", w_lexical=0.0).collect()] == [9]
    with pytest.raises(ValueError):
        retrieval.rrf(side, other, "doc_id", w_lexical=0, w_dense=0)


@pytest.mark.parametrize("few", [True, False])
def test_dense_search_against_brute_force(spark, monkeypatch, few):
    """Ties, rows without a vector, k beyond the table, several blocks, both joins."""
    monkeypatch.setattr(retrieval, "BLOCK", 7)
    monkeypatch.setattr(retrieval, "BROADCAST_VECTORS", 1000 if few else 0)
    rng = np.random.default_rng(1)
    v = rng.integers(0, 3, (50, 4)).astype(float)
    rows = [(i, x.tolist()) for i, x in enumerate(v)] + [(99, None)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    q = df.where("vec_id < 20 or vec_id = 99").withColumnRenamed("vec_id", "query_id")
    for k in (5, 80):
        got = {}
        for r in retrieval.dense_topk(q, df, k).orderBy("query_id", "rank").collect():
            got.setdefault(r["query_id"], []).append(r["vec_id"])
        d = ((v[:20, None] - v) ** 2).sum(-1)
        assert got == {i: np.lexsort((np.arange(50), d[i]))[:k].tolist() for i in range(20)}
    assert retrieval.dense_topk(q.where("query_id < 0"), df, 3).count() == 0 and retrieval.dense_topk(q, df.where("vec_id < 0"), 3).count() == 0


def test_guard_order_of_cap_breaker_and_retries():
    waits = []
    g = calls.Guard(calls.Policy(usd=1.0, failures=2, retries=2, first_wait=1.0, most_wait=3.0, sleep=waits.append))

    def busy():
        raise calls.Retryable("busy", 2.5)

    def wrong():
        raise TypeError("wrong")

    assert g.run(busy)[::2] == ("error", 3) and len(waits) == 2 and waits[0] == 2.5 and 2.5 <= waits[1] <= 3.0
    assert g.run(lambda: (1, 0.6)) == ("ok", 1, 1)  # resets the streak
    assert g.run(wrong)[::2] == ("error", 1) and g.run(wrong)[0] == "error" and g.run(lambda: (1, 0.0))[0] == "open"
    h = calls.Guard(calls.Policy(usd=1.0))
    assert [h.run(lambda: (1, 0.6))[0] for _ in range(3)] == ["ok", "ok", "cost_cap"]


@pytest.mark.parametrize(
    "sql",
    [
        "drop table t", "select 1; drop table t", "insert into t select 1", "select * from parquet.`/etc/x`", "select * from other", "select reflect('java.lang.System', 'exit', 1)",
        "with x as (select 1 as a) select * from x join y on true", "show tables", "select * from t where a in (select a from other)",
    ],
)
def test_read_only_sql_refuses(spark, sql):
    with pytest.raises(PermissionError):
        readers.read_only_sql(spark, sql, {"t": spark.createDataFrame([(1,)], "a int")})


def test_read_only_sql_runs(spark):
    t = spark.createDataFrame([(1, "drop; t"), (2, "b")], "a int, s string")
    assert [r[0] for r in readers.read_only_sql(spark, "with x as (select a, s from t) select s from x where s = 'drop; t';", {"t": t}).collect()] == ["drop; t"]


def test_store_ignores_unfinished_writes_and_keeps_control_files_whole(spark, tmp_path):
    s = store.Store(spark, str(tmp_path / "s"))
    rows = spark.createDataFrame([(1, 0, "narrative", [1.0], "a"), (2, 0, "x", [2.0], "a")], "doc_id int, chunk_id int, chunk_type string, vector array<double>, embed_space string")
    s.write(rows, "v1")
    half = tmp_path / "s" / "vectors" / "version=v1" / "write=000001"
    shutil.copytree(tmp_path / "s" / "vectors" / "version=v1" / "write=000000", half)
    (half / "_SUCCESS").unlink()
    assert s.read("v1").count() == 2 and s.active() is None
    with pytest.raises(ValueError, match="no version is active"):
        s.read()
    with pytest.raises(ValueError, match="more than one embed space"):
        s.write(rows.unionByName(rows.withColumn("embed_space", F.lit("b"))), "v1")
    s.promote("v1")
    assert s.active() == {"version": "v1", "embed_space": "a"} and s.corpus().count() == 1 and s.collect_garbage(1) == []
    assert not [f for f in (tmp_path / "s").iterdir() if f.name.startswith(".active") and not f.name.endswith(".crc")]
    with pytest.raises(ValueError, match="empty"):
        s.write(rows.where("doc_id < 0"), "v2")
        s.promote("v2")


def test_calls_refuse_what_does_not_fit(spark):
    df = spark.createDataFrame([("a", "b")], "q string, t string")
    for bad in (lambda: calls.score(df, "q", "t", lambda q, t: []), lambda: calls.encode(df, "t", calls.hash_encoder(4), "query", 5)):
        with pytest.raises(Exception, match="scores for|dimensions"):
            bad().collect()


def test_shared_folder_is_asked_for_on_a_cluster_and_tables_can_be_discarded(spark):
    class Elsewhere:
        class conf:
            get = staticmethod(lambda k, d: None)

        class sparkContext:
            master = "spark://somewhere:7077"

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        session.shared_dir(Elsewhere)
    t = session.materialize(spark.range(3), "test-discard")
    assert t.count() == 3 and Path(t._written).exists()
    session.discard(t, spark.range(1))
    assert not Path(t._written).exists()


def test_decayed_index_over_a_long_history(spark):
    days = [0, 1, 59, 60, 61, 119, 120, 30_000, 30_001, 30_061]
    df = spark.createDataFrame([(1, d) for d in days], "e int, day int")
    got = {r["day"]: r["index"] for r in analytics.decayed_index(df, "e", "day", 60, 0.05).collect()}
    assert len(got) == len(days)
    for d in days:
        assert got[d] == pytest.approx(sum(np.exp(-0.05 * (d - x)) for x in days if 0 <= d - x <= 60), rel=1e-9)


def test_equal_groups_match_a_sort(spark):
    v = np.random.default_rng(3).permutation(1003).tolist()
    got = sorted((r["x"], r["block"]) for r in analytics.equal_groups(spark.createDataFrame([(x,) for x in v], "x int").repartition(5), "x", 6).collect())
    assert [b for _, b in got] == [1] * 168 + [b for b in range(2, 7) for _ in range(167)]
    assert analytics.equal_groups(spark.createDataFrame([], "x int"), "x", 6).count() == 0


def test_backends_are_checked():
    assert calls.choose_backend("local", "large", base_url="u")["model"] == "local/large"
    for bad in (("cloud", "large", {}), ("hosted", "medium", {}), ("hosted", "large", {"base_url": "u"})):
        with pytest.raises(ValueError):
            calls.choose_backend(bad[0], bad[1], **bad[2])


def test_calls_keep_large_keys_beside_null_ones(spark):
    big = 9_007_199_254_740_993
    df = spark.createDataFrame([(big, "a b"), (None, "c"), (big - 1, None)], "doc_id long, text string").coalesce(1)
    got = calls.encode(df.where("text is not null"), "text", calls.hash_encoder(4), "document", 4)
    assert {r["doc_id"] for r in got.collect()} == {big, None}
    assert {r["doc_id"] for r in calls.fetch(df, "text", lambda u: b"x").collect()} == {big, big - 1, None}
