"""Injected calls: models, encoders, fetchers and sources as plain callables, run in batches where the rows are.

A callable must be picklable and self-contained; it is loaded once a task. Failures become statuses of rows, never of the job.
"""

from __future__ import annotations

import random
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import _parse_datatype_string

from docquarry.operators.ledger import cache_split
from docquarry.session import ship_package


class Retryable(Exception):
    """A failure worth another attempt; ``retry_after``: seconds that the server asked for."""

    def __init__(self, message: str = "", retry_after: float | None = None):
        super().__init__(message)
        self.retry_after = retry_after


class NoCoverage(Exception):
    """There is nothing to fetch."""


@dataclass(frozen=True)
class Policy:
    """Outermost first: no call once ``usd`` is exceeded, none while ``failures`` in a row have occurred, ``retries`` more attempts.

    ``sleep`` is injected, so that tests don't wait. State is a task's: ``repartition`` to one to share it among all rows."""

    usd: float = 5.0
    failures: int = 3
    retries: int = 3
    first_wait: float = 1.0
    most_wait: float = 30.0
    sleep: Callable[[float], None] = time.sleep


def backoff(attempt: int, policy: Policy, retry_after: float | None, jitter: float) -> float:
    """Seconds before the next attempt: exponential with ``jitter`` (0 to 1 second), at least what the server asked for."""
    return max(retry_after or 0.0, min(policy.first_wait * 2**attempt + jitter, policy.most_wait))


def backoff_column(attempt: Column, retry_after: Column, policy: Policy = Policy()) -> Column:
    """The same without jitter, as a column."""
    return F.greatest(F.coalesce(retry_after, F.lit(0.0)), F.least(F.lit(policy.first_wait) * F.pow(F.lit(2.0), attempt), F.lit(policy.most_wait)))


class Guard:
    """Runs calls under a policy; remembers what was spent and how many failed in a row."""

    def __init__(self, policy: Policy):
        self.p, self.spent, self.streak = policy, 0.0, 0
        self.rng = random.Random(0)

    def run(self, call: Callable[[], tuple[object, float]]) -> tuple[str, object, int]:
        """(status, value or message, attempts); ``call`` gives (value, cost in USD). Statuses: ok, no_coverage, error, cost_cap, open."""
        if self.spent > self.p.usd:
            return "cost_cap", None, 0
        if self.streak >= self.p.failures:
            return "open", None, 0
        for attempt in range(self.p.retries + 1):
            try:
                value, usd = call()
                self.spent += usd
                self.streak = 0
                return "ok", value, attempt + 1
            except NoCoverage as e:
                self.streak = 0
                return "no_coverage", str(e), attempt + 1
            except Retryable as e:
                if attempt < self.p.retries:
                    self.p.sleep(backoff(attempt, self.p, e.retry_after, self.rng.random()))
                    continue
                why = e
            except Exception as e:  # any other failure is the row's, and not worth another attempt
                why = e
            self.streak += 1
            return "error", f"{type(why).__name__}: {why}", attempt + 1
        raise AssertionError


#: So many rows of a batch become Python objects at once, whatever the batch holds.
SLICE = 512


def _mapped(df: DataFrame, columns: list[str], add: str, rows: Callable[[], Callable[[pd.DataFrame], pd.DataFrame]]) -> DataFrame:
    """``columns`` of ``df`` and what ``rows()`` makes of each batch of them (one column a name of ``add``). Kept columns never leave Arrow, so
    that large keys stay as they are beside nulls; functions see such columns as Python's integers."""
    ship_package(df.sparkSession)
    kept = df.select(*columns)
    ddl = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields), add])
    types = [to_arrow_type(f.dataType) for f in kept.schema.fields]
    made = [(f.name, to_arrow_type(f.dataType)) for f in _parse_datatype_string(add).fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one = rows()
        for b in (whole.slice(lo, SLICE) for whole in batches for lo in range(0, whole.num_rows, SLICE)):
            got = one(b.to_pandas(integer_object_nulls=True))
            new = [pa.array(got[n].tolist(), t, from_pandas=True) for n, t in made]
            yield pa.RecordBatch.from_arrays([*(c if c.type == t else c.cast(t) for c, t in zip(b.columns, types)), *new], [*kept_names, *(n for n, _ in made)])

    kept_names = kept.columns
    return kept.mapInArrow(run, ddl)


def fetch(listing: DataFrame, url: str, get: Callable[[str], bytes], policy: Policy = Policy(usd=float("inf")), concurrency: int | None = None) -> DataFrame:
    """``listing`` with (status, content, error, attempts), a row each whatever fails: what was fetched isn't lost with the rest.
    ``concurrency``: tasks at once, where the host allows no more."""

    def rows() -> Callable[[pd.DataFrame], pd.DataFrame]:
        guard = Guard(policy)

        def one(b: pd.DataFrame) -> pd.DataFrame:
            got = [guard.run(lambda u=u: (get(u), 0.0)) for u in b[url]]
            return pd.DataFrame({"status": [g[0] for g in got], "content": [g[1] if g[0] == "ok" else None for g in got], "error": [g[1] if g[0] != "ok" else None for g in got], "attempts": [g[2] for g in got]}, index=b.index)

        return one

    df = listing.repartition(concurrency) if concurrency else listing
    return _mapped(df, df.columns, "status string, content binary, error string, attempts int", rows)


def first_source(df: DataFrame, sources: dict[str, Callable[[dict], str | None]]) -> DataFrame:
    """``df`` with (audio_source, audio_url) of the first of ``sources``, in order, that has one; nulls where none has."""

    def rows() -> Callable[[pd.DataFrame], pd.DataFrame]:
        def one(b: pd.DataFrame) -> pd.DataFrame:
            got = []
            for r in b.to_dict("records"):
                got.append(next(((n, u) for n, f in sources.items() if (u := f(r))), (None, None)))
            return pd.DataFrame(got, columns=["audio_source", "audio_url"], index=b.index)

        return one

    return _mapped(df, df.columns, "audio_source string, audio_url string", rows)


def transcribe(segments: DataFrame, key: str, order: str, audio: str, engine: Callable[[bytes], str]) -> DataFrame:
    """(key, transcript): each segment's text by ``engine``, joined by new lines in order; blank ones are left out. A recording's
    segments meet as texts only."""

    def rows() -> Callable[[pd.DataFrame], pd.DataFrame]:
        return lambda b: pd.DataFrame({"said": [engine(bytes(a)).strip() if a is not None else "" for a in b[audio]]}, index=b.index)

    said = _mapped(segments, [key, order, audio], "said string", rows).drop(audio)
    parts = F.filter(F.transform(F.array_sort(F.collect_list(F.struct(order, "said"))), lambda x: x["said"]), lambda s: s != "")
    return said.groupBy(key).agg(F.array_join(parts, "\n").alias("transcript"))


def score(hits: DataFrame, query: str, passage: str, scorer: Callable[[list[str], list[str]], list[float]], column: str = "scorer_score") -> DataFrame:
    """``hits`` with the scorer's score of each (query, passage), in batches. A wrong number of scores is an error."""

    def rows() -> Callable[[pd.DataFrame], pd.DataFrame]:
        def one(b: pd.DataFrame) -> pd.DataFrame:
            got = list(scorer(b[query].tolist(), b[passage].tolist()))
            if len(got) != len(b):
                raise ValueError(f"{len(got)} scores for {len(b)} passages")
            return pd.DataFrame({column: np.asarray(got, float)}, index=b.index)

        return one

    return _mapped(hits, hits.columns, f"{column} double", rows)


#: What asymmetric encoders put before a text by its role.
PREFIX = {"query": "query: ", "document": "passage: "}


def encode(df: DataFrame, text: str, encoder: Callable[[list[str]], np.ndarray], role: str, dim: int, column: str = "vector") -> DataFrame:
    """``df`` with unit vectors of ``dim`` of its texts, prefixed by role. Another dimension, or a vector of length 0, is an error."""
    prefix = PREFIX[role]

    def rows() -> Callable[[pd.DataFrame], pd.DataFrame]:
        def one(b: pd.DataFrame) -> pd.DataFrame:
            v = np.asarray(encoder([prefix + (t or "") for t in b[text]]), float).reshape(len(b), -1)
            if v.shape[1] != dim:
                raise ValueError(f"the encoder gives {v.shape[1]} dimensions, not {dim}")
            n = np.sqrt((v * v).sum(1, keepdims=True))
            if not n.all():
                raise ValueError("a vector of length 0")
            return pd.DataFrame({column: list(v / n)}, index=b.index)

        return one

    return _mapped(df, df.columns, f"{column} array<double>", rows)


def extract(docs: DataFrame, text: str, extractor: Callable[[str], tuple[object, float]], check: Callable[[dict, str], list[str]], policy: Policy = Policy()) -> DataFrame:
    """``docs`` without their texts, with (outcome, record, problems, usd): ``extractor`` gives (object, cost), ``check`` the problems of a
    record on its text. persisted: none; quarantined: some, or not an object; skipped: no answer; else the guard's status."""
    import json

    def rows() -> Callable[[pd.DataFrame], pd.DataFrame]:
        guard = Guard(policy)

        def one(b: pd.DataFrame) -> pd.DataFrame:
            out = []
            for t in b[text]:
                before = guard.spent
                status, value, _ = guard.run(lambda t=t: extractor(t or ""))
                record, problems = None, []
                if status != "ok":
                    outcome, problems = status, [str(value)] if value else []
                elif value is None:
                    outcome = "skipped"
                elif not isinstance(value, dict):
                    outcome, record, problems = "quarantined", json.dumps(value), ["not an object"]
                else:
                    problems = check(value, t or "")
                    outcome, record = "quarantined" if problems else "persisted", json.dumps(value, sort_keys=True)
                out.append((outcome, record, problems, guard.spent - before))
            return pd.DataFrame(out, columns=["outcome", "record", "problems", "usd"], index=b.index)

        return one

    got = _mapped(docs, docs.columns, "outcome string, record string, problems array<string>, usd double", rows)
    return got.drop(text)


def contextualise(chunks: DataFrame, prompt: str, key: str, call: Callable[[str], str], cache: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(``chunks`` with ``context``, rows to add to ``cache``): cached contexts (key, payload) are taken, one call is made for each other
    distinct key, and empty answers are neither used nor cached."""
    split = cache_split(chunks, cache.withColumnRenamed("cache_key", key) if "cache_key" in cache.columns else cache, key)
    asked = split.where("not hit").groupBy(key).agg(F.min(prompt).alias("__prompt"))

    def rows() -> Callable[[pd.DataFrame], pd.DataFrame]:
        return lambda b: pd.DataFrame({"payload": [(call(t) or "").strip() or None for t in b["__prompt"]]}, index=b.index)

    fresh = _mapped(asked, [key, "__prompt"], "payload string", rows).drop("__prompt").where("payload is not null")
    made = split.drop("payload", "hit").join(cache.select(F.col("cache_key" if "cache_key" in cache.columns else key).alias(key), "payload").unionByName(fresh), key, "left")
    return made.withColumnRenamed("payload", "context"), fresh


def batch_outcomes(requests: DataFrame, results: DataFrame, key: str = "custom_id") -> DataFrame:
    """Each submitted request with its result's (status, payload): a result without a request is left out, a request without one is
    pending, and of repeated results the first by arrival counts."""
    first = results.groupBy(key).agg(F.min_by(F.struct("status", "payload"), "arrival").alias("r"))
    return requests.join(first, key, "left").select(*requests.columns, F.coalesce("r.status", F.lit("pending")).alias("status"), F.col("r.payload").alias("payload"))


def hash_encoder(dim: int) -> Callable[[list[str]], np.ndarray]:
    """A deterministic stand-in for a model: signed counts of hashed words."""
    import zlib

    def run(texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), dim))
        for i, t in enumerate(texts):
            for w in t.lower().split():
                h = zlib.crc32(w.encode())
                out[i, h % dim] += 1 if h >> 31 else -1
            out[i, 0] += 1e-6
        return out

    return run


#: Backends and what each may be asked for.
BACKENDS = {"local": {"models": ("small", "medium", "large"), "options": ("base_url",)}, "hosted": {"models": ("small", "large"), "options": ("api_key", "batch")}}


def choose_backend(name: str, model: str, **options: object) -> dict:
    """A checked choice of backend: unknown names, models and options, and options that exclude each other, are errors."""
    if name not in BACKENDS:
        raise ValueError(f"unknown backend {name}")
    if model not in BACKENDS[name]["models"]:
        raise ValueError(f"{name} has no model {model}")
    wrong = sorted(set(options) - set(BACKENDS[name]["options"]))
    if wrong:
        raise ValueError(f"{name} doesn't take {', '.join(wrong)}")
    return {"backend": name, "model": f"local/{model}" if name == "local" else model, **options}


def cited_worker(docs: DataFrame, text: str, key: str, extractor: Callable[[str], tuple[object, float]], fields: tuple[str, ...], policy: Policy = Policy()) -> DataFrame:
    """A whole worker: (key, outcome, record, problems, citations). Records must be objects with just ``fields``, of which ``citations`` is
    a list of {source_quote}; quotes are resolved on the document, and one that isn't found as often as it is cited quarantines the
    record. ``citations`` of persisted ones carry their spans and the text's own spelling."""
    from docquarry.operators.citations import resolve_quotes

    def check(record: dict, _: str) -> list[str]:
        return sorted({f"unknown:{k}" for k in record if k not in fields} | {f"missing:{k}" for k in fields if k not in record})

    got = extract(docs.select(key, text), text, extractor, check, policy)
    quotes = F.from_json(F.get_json_object("record", "$.citations"), "array<struct<source_quote:string>>")
    claims = got.where("outcome = 'persisted'").select(F.col(key).alias("doc_id"), F.posexplode(quotes).alias("ordinal", "c")).select("doc_id", "ordinal", F.col("c.source_quote").alias("quote"))
    found = resolve_quotes(docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text")), claims)
    bad = F.when(F.col("outcome") != "ok", F.concat_ws(":", "outcome", F.col("ordinal")))
    per = found.groupBy("doc_id").agg(F.array_sort(F.collect_list(bad)).alias("bad"), F.array_sort(F.collect_list(F.struct("ordinal", "start", "stop", "snapped"))).alias("spans"))
    both = got.join(per.withColumnRenamed("doc_id", key), key, "left")
    failed = F.size(F.coalesce("bad", F.array().cast("array<string>"))) > 0
    return both.select(key, F.when(failed, "quarantined").otherwise(F.col("outcome")).alias("outcome"), "record", F.concat("problems", F.coalesce("bad", F.array().cast("array<string>"))).alias("problems"), F.when(~failed, F.col("spans")).alias("citations"))
