"""Chunking against plain rules: what is seen, where headers stand, greedy spans, unsound chunk sets."""

from __future__ import annotations

import random
import re
import time

import pytest
from pyspark.sql import functions as F

from docquarry.operators import chunking

PROSE = "<p>Plain words of a long report follow here. " + "More of them come. " * 40 + "</p>"


def sections(html):
    return [name for name, _, _ in chunking.detect_sections(chunking.Page(html))]


def random_page(rng):
    bits = ["<p>", "</p>", "<div class='x'>", "</div>", "<a href='#q'>", "</a>", "Words and more words. ", "é letters ", "&nbsp;", "&amp", "; ", "<!-- Item 3. No ", "-->", "< ", "> ", "<table>", "</table>", "Item 1. Business ", "Item&#160;7&#8212;Results ", "Risk Factors ", "x" * 40, "\n", "item 1A: Risks "]
    return "".join(rng.choice(bits) for _ in range(rng.randint(1, 300)))


def test_prose_is_what_the_window_shows():
    """Counts by differences and by reading are those of the window alone, wherever it cuts a tag or an entity."""
    rng = random.Random(1)
    for _ in range(150):
        html = random_page(rng)
        page = chunking.Page(html)
        for at in [rng.randint(0, len(html)) for _ in range(6)]:
            shown = re.sub(r"<[^>]+>|&[^;]+;", "", html[at : at + chunking.WINDOW])
            assert page.prose(at) == (sum(map(str.isalpha, shown)) >= chunking.LETTERS)


def test_tables_balance_outside_comments():
    assert chunking.table_spans("<table>a<table></table></table>b<table>") == [(0, 31)]
    assert chunking.table_spans("<!-- <table> --><table><!-- </table> -->x</table>") == [(16, 49)]
    assert chunking.table_spans("</table><TABLE border=1>x</TABLE >") == [(8, 34)]


def test_an_open_comment_hides_nothing():
    assert sections(f"<p>Item 1. Business</p>{PROSE}<!-- stray <p>Item 7. Results</p>{PROSE}") == ["Item 1", "Item 7"]
    assert sections(f"<p>Item 1. Business</p>{PROSE}<!-- <p>Item 7. Results</p> -->{PROSE}") == ["Item 1"]


def test_numbers_come_before_titles_and_long_titles_before_short():
    html = f"<div>Risk Factors</div>{PROSE}<p>Item 1A. Risk Factors</p>{PROSE}"
    assert chunking.detect_sections(chunking.Page(html))[0][1] == html.index("Item 1A")
    short, long = "Quantitative and Qualitative Disclosures", "Quantitative and Qualitative Disclosures About Market Risk"
    html = f"<div>{short}</div>{PROSE}<div>{long}</div>{PROSE}"
    assert chunking.detect_sections(chunking.Page(html))[0][1] == html.index(long)


def plain_packed(cuts, start, end, most, tokens):
    out, at = [], start
    while at < end:
        fits = [c for c in [*cuts, end] if at < c <= end and tokens(c - at) <= most]
        after = [c for c in [*cuts, end] if at < c <= end]
        stop = max(fits) if fits else min(after)
        out.append((at, stop))
        at = stop
    return out


def test_greedy_spans():
    rng = random.Random(2)
    for _ in range(300):
        n = rng.randint(1, 400)
        cuts = sorted(rng.sample(range(n + 50), rng.randint(0, min(n, 30))))
        start = rng.randint(0, n - 1)
        most = rng.randint(1, 40)
        for tokens in (chunking.default_tokens, lambda c: c // 3):
            assert chunking._packed(cuts, start, n, most, tokens) == plain_packed(cuts, start, n, most, tokens)


def test_chunks_of_random_pages_tile_their_sections():
    rng = random.Random(3)
    for _ in range(100):
        html = "<p>Item 1. Business</p>" + PROSE + random_page(rng) + PROSE
        outcome, rows = chunking.chunk(html, max_parent=200, max_child=40, hard_child=10**6)
        assert outcome == "chunked" and rows[0]["start"] == 3 and rows[-1]["end"] == len(html)
        assert all(a["end"] == b["start"] for a, b in zip(rows, rows[1:])) and all(r["parent_start"] <= r["start"] < r["end"] <= r["parent_end"] for r in rows)


@pytest.mark.parametrize("piece", ["<a ", "<!--", "&", "<table>", "Item 1. ", "Risk Factors ", "<a href=x>", "x. "])
def test_pages_are_read_in_about_linear_time(piece):
    def seconds(n):
        began = time.perf_counter()
        chunking.chunk(piece * (n // len(piece)), hard_child=10**9)
        return time.perf_counter() - began

    seconds(5_000)
    assert seconds(200_000) < 40 * max(seconds(20_000), 0.02)


def test_unsound_chunk_sets_are_quarantined(spark):
    html = f"<p>Item 1. Business</p>{PROSE}"
    docs = spark.createDataFrame([(k, html) for k in range(5)], "doc_id long, html string")
    chunks = chunking.parse_filings(docs)
    assert chunking.quarantined_chunks(chunks, docs).count() == 0
    bad = chunks.withColumn("text", F.when(F.col("doc_id") == 1, F.upper("text")).otherwise(F.col("text"))).withColumn("end", F.when(F.col("doc_id") == 2, F.lit(10**6)).otherwise(F.col("end")))
    bad = bad.withColumn("parent_end", F.when(F.col("doc_id") == 3, F.col("parent_end") - 1).otherwise(F.col("parent_end")))
    got = {r["doc_id"]: (r["reason"], r["section"], r["parent_id"]) for r in chunking.quarantined_chunks(bad, docs).collect()}
    assert got == {1: ("text_differs", "Item 1", 0), 2: ("bad_span", "Item 1", 0), 3: ("outside_parent", "Item 1", 0)}


def test_large_keys_beside_null_ones(spark):
    big = 9_007_199_254_740_993
    docs = spark.createDataFrame([(big, f"<p>Item 1. Business</p>{PROSE}"), (None, None)], "doc_id long, html string").coalesce(1)
    assert {r[0] for r in chunking.parse_filings(docs).collect()} == {big, None} and {r[0] for r in chunking.section_rows(docs).collect()} == {big}
