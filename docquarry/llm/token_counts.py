"""Exact token counts by a map-side two-tier lookup.

Tier one: a broadcast table of frequent pre-tokens' token counts. Tier two: a cache in each worker, filled by encoding misses with
the library itself. Both only save time; every count is the library's. No pre-token is shuffled: rows go in and out of one map.

A pre-token here is a run between ASCII white space, which the vocabulary's normaliser and splitter never join or cross, so that a
text's count is the sum over its runs. ``tests/llm`` holds this against the library on whole texts.
"""

from __future__ import annotations

import uuid
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from docquarry.session import ship_package

#: Bounds of the two tiers. They limit memory; counts don't depend on them.
SAMPLE_DOCS, SAMPLE_CHARS, FREQUENT, CACHE = 1000, 4_000_000, 20_000, 400_000
_BLANK = str.maketrans({c: " " for c in "\t\n\r\x0b\x0c"})


def _runs(text: str) -> list[str]:
    return text.translate(_BLANK).split(" ") if not text.isascii() else text.replace("\n", " ").replace("\t", " ").replace("\r", " ").replace("\x0b", " ").replace("\x0c", " ").split(" ")


class Counts(dict):
    """run -> tokens; a miss is encoded by the library. Holds ``room`` runs beyond the frequent ones, then starts over from those."""

    def __init__(self, spec: str, frequent: dict[str, int], room: int = CACHE):
        from tokenizers import Tokenizer

        super().__init__(frequent)
        self[""] = 0
        self.tok, self.frequent, self.most = Tokenizer.from_str(spec), frequent, len(frequent) + 1 + room
        self.tok.no_truncation()
        self.tok.no_padding()

    def __missing__(self, run: str) -> int:
        n = len(self.tok.encode(run, add_special_tokens=False).ids)
        if len(run) <= 64:
            self[run] = n
        return n

    def trim(self) -> None:
        if len(self) > self.most:
            self.clear()
            self.update(self.frequent)
            self[""] = 0

    def of(self, text: str | None) -> int:
        return sum(map(self.__getitem__, _runs(text))) if text else 0


_KEPT: dict[str, Counts] = {}


def _kept(name: str, spec: str, frequent: dict[str, int]) -> Counts:
    """This process's counts of that name: a worker's cache lives on from task to task. One is kept at a time."""
    if name not in _KEPT:
        _KEPT.clear()
        _KEPT[name] = Counts(spec, frequent)
    return _KEPT[name]


def frequent_table(docs: DataFrame, spec: str, text: str = "text", sample_docs: int = SAMPLE_DOCS, entries: int = FREQUENT) -> dict[str, int]:
    """Token counts of the most frequent runs in the first rows that come; at most ``sample_docs`` rows of SAMPLE_CHARS / sample_docs characters."""
    seen: Counter[str] = Counter()
    for (t,) in docs.select(F.substring(F.col(text), 1, SAMPLE_CHARS // sample_docs)).limit(sample_docs).collect():
        seen.update(_runs(t or ""))
    table = Counts(spec, {})
    return {w: table[w] for w, _ in seen.most_common(entries) if w and len(w) <= 64}


def count_tokens(docs: DataFrame, tokenizer_path: str, key: str = "doc_id", text: str = "text", limit: int = 2048) -> DataFrame:
    """(key, n_bytes, n_tokens, over_limit) of every row, whole texts, as the library gives them without added special tokens.

    Null and empty texts: 0 bytes, 0 tokens. Repeated rows stay. Empty table: no rows. Other columns are not read.
    ``tokenizer_path`` is read once, on the driver."""
    with open(tokenizer_path, encoding="utf-8") as f:
        spec = f.read()
    ship_package(docs.sparkSession)
    sc = docs.sparkSession.sparkContext
    shared = sc.broadcast((uuid.uuid4().hex, spec, frequent_table(docs, spec, text)))
    kind = docs.schema[key].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = _kept(*shared.value)
        for b in batches:
            n = []
            for t in b.column(1):
                n.append(counts.of(t.as_py()))
                counts.trim()
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(n, pa.int64())], ["k", "b", "n"])

    narrow = docs.select(F.col(key).alias("k"), F.col(text).alias("t"), F.coalesce(F.octet_length(text), F.lit(0)).cast("long").alias("b"))
    schema = StructType([StructField("k", kind), StructField("b", LongType()), StructField("n", LongType())])
    got = narrow.mapInArrow(run, schema)
    return got.select(F.col("k").alias(key), F.col("b").alias("n_bytes"), F.col("n").alias("n_tokens"), (F.col("n") > limit).alias("over_limit"))
