"""Versioned tables and their control files: writes that a reader sees whole or not at all, promotion, retention, re-encoding.

A store is a folder with ``vectors/version=.../write=...``, written only by adding; a document's rows are those of its latest write in
a version, so that a write replaces what it holds again (delete, then insert) without touching files that others read. Control files
are small JSON texts, replaced atomically.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docquarry.operators.ledger import retained


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def read_text(spark: SparkSession, path: str) -> str | None:
    """The file's text; None where there is none."""
    p, fs = _fs(spark, path)
    if not fs.exists(p):
        return None
    stream = fs.open(p)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def replace_text(spark: SparkSession, path: str, text: str) -> None:
    """Writes beside ``path``, then renames over it: readers see the old text or the new one, and a failure leaves the old."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    p, fs = _fs(spark, path)
    part = jvm.org.apache.hadoop.fs.Path(p.getParent(), f".{p.getName()}.{uuid.uuid4().hex}")
    fs.mkdirs(p.getParent())
    try:
        out = fs.create(part, True)
        try:
            out.write(bytearray(text.encode()))
            out.hsync()
        finally:
            out.close()
        over = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
        over[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
        jvm.org.apache.hadoop.fs.FileContext.getFileContext(p.toUri(), conf).rename(part, p, over)
    finally:
        fs.delete(part, False)


def write_outcomes(rows: DataFrame, path: str, ok: str = "outcome = 'persisted'") -> dict[str, int]:
    """Splits ``rows`` by ``ok``: good ones to ``path``/extracted, others to ``path``/quarantine, each as JSON lines by worker. Counts."""
    rows.where(ok).write.mode("append").partitionBy("worker").json(f"{path}/extracted")
    rows.where(f"not coalesce({ok}, false)").withColumn("quarantined_at", F.current_timestamp()).write.mode("append").partitionBy("worker").json(f"{path}/quarantine")
    return {r[0]: r[1] for r in rows.groupBy("outcome").count().collect()}


class Store:
    """Versioned vectors under ``root``. ``narrative``: the chunk types that the corpus view holds."""

    def __init__(self, spark: SparkSession, root: str, narrative: tuple[str, ...] = ("narrative",)):
        self.spark, self.root, self.narrative = spark, root.rstrip("/"), narrative

    # --- control files
    def active(self) -> dict | None:
        text = read_text(self.spark, f"{self.root}/active.json")
        return json.loads(text) if text else None

    def history(self) -> list[dict]:
        text = read_text(self.spark, f"{self.root}/history.jsonl") or ""
        return [json.loads(x) for x in text.splitlines() if x.strip()]

    def _promoted(self, version: str, space: str) -> None:
        past = read_text(self.spark, f"{self.root}/history.jsonl") or ""
        entry = {"position": len(past.splitlines()), "version": version, "embed_space": space}
        replace_text(self.spark, f"{self.root}/history.jsonl", past + json.dumps(entry, sort_keys=True) + "\n")
        replace_text(self.spark, f"{self.root}/active.json", json.dumps({"version": version, "embed_space": space}, sort_keys=True))

    # --- tables
    def write(self, rows: DataFrame, version: str) -> None:
        """``rows`` (doc_id, chunk_id, chunk_type, text, vector, embed_space, ...) replace those of their documents in ``version``."""
        spaces = [r[0] for r in rows.select("embed_space").distinct().limit(2).collect()]
        if len(spaces) > 1:
            raise ValueError(f"more than one embed space: {spaces}")
        _, fs = _fs(self.spark, self.root)
        p = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/vectors/version={version}")
        held = [f.getPath().getName() for f in fs.listStatus(p)] if fs.exists(p) else []
        nxt = max([int(n.split("=")[1]) for n in held if n.startswith("write=")], default=-1) + 1
        # the folder of a write appears with its commit marker, or isn't read
        rows.write.mode("error").parquet(f"{p.toString()}/write={nxt:06d}")

    def versions(self) -> list[str]:
        p, fs = _fs(self.spark, f"{self.root}/vectors")
        return sorted(f.getPath().getName().split("=", 1)[1] for f in fs.listStatus(p)) if fs.exists(p) else []

    def read(self, version: str | None = None, embed_space: str | None = None) -> DataFrame:
        """The rows of a version, the active one by default, each document's from its latest write. A reader's ``embed_space`` must be
        the pointer's: vectors of different spaces don't compare. Writing names its version itself and ignores the pointer."""
        pointer = self.active()
        if version is None:
            if pointer is None:
                raise ValueError("no version is active")
            version = pointer["version"]
            if embed_space is not None and pointer["embed_space"] != embed_space:
                raise ValueError(f"the active version is of {pointer['embed_space']}, not {embed_space}")
        p, fs = _fs(self.spark, f"{self.root}/vectors/version={version}")
        whole = [f.getPath().toString() for f in fs.listStatus(p) if fs.exists(self.spark._jvm.org.apache.hadoop.fs.Path(f.getPath(), "_SUCCESS"))] if fs.exists(p) else []
        if not whole:
            raise ValueError(f"no version {version}")
        all_ = self.spark.read.option("basePath", p.toString()).parquet(*whole)
        last = all_.groupBy("doc_id").agg(F.max("write").alias("write"))
        return all_.join(last, ["doc_id", "write"], "left_semi").drop("write")

    def corpus(self, version: str | None = None) -> DataFrame:
        """The narrative rows of a version: a view of the same table, so that the two can't differ."""
        return self.read(version).where(F.col("chunk_type").isin(*self.narrative))

    # --- commands
    def reembed(self, source: str, target: str, encode: Callable[[DataFrame], DataFrame]) -> None:
        """Writes ``target`` from ``source``: only ``encode`` changes (vector, embed_space); texts and upstream stamps stay."""
        old = self.read(source)
        new = encode(old.drop("vector", "embed_space"))
        if set(new.columns) != set(old.columns):
            raise ValueError("an encoder adds vector and embed_space, and changes nothing else")
        self.write(new.select(*old.columns), target)

    def blockers(self, version: str, expected: DataFrame | None = None) -> list[str]:
        """Why ``version`` can't be promoted: no rows, documents of ``expected`` without rows, several dimensions or embed spaces,
        no narrative rows."""
        if version not in self.versions():
            return ["no_version"]
        rows = self.read(version)
        dims = F.count_distinct(F.size("vector"))
        n, d, s, narrative = rows.agg(F.count("*"), dims, F.count_distinct("embed_space"), F.count_if(F.col("chunk_type").isin(*self.narrative))).first()
        out = [why for why, bad in (("empty", not n), ("mixed_dimensions", d > 1), ("mixed_embed_spaces", s > 1), ("no_narrative", n and not narrative)) if bad]
        if expected is not None and expected.select("doc_id").join(rows.select("doc_id"), "doc_id", "left_anti").limit(1).count():
            out.append("missing_documents")
        return out

    def promote(self, version: str, expected: DataFrame | None = None) -> None:
        """Makes ``version`` the active one, or raises with every reason against it."""
        why = self.blockers(version, expected)
        if why:
            raise ValueError(f"{version} can't be promoted: {', '.join(why)}")
        self._promoted(version, self.read(version).select("embed_space").first()[0])

    def collect_garbage(self, keep: int, dry_run: bool = True) -> list[str]:
        """Versions beyond the active one and the newest promoted others, ``keep`` in all; deleted unless it is a dry run."""
        if keep < 1:
            raise ValueError("the active version is always kept")
        past, pointer = self.history(), self.active()
        stay = {pointer["version"]} if pointer else set()
        if past:
            rows = retained(self.spark.createDataFrame([(h["version"], h["position"]) for h in past], "version string, position long"), pointer["version"], keep)
            stay |= {r["version"] for r in rows.where("keep").collect()}
        gone = [v for v in self.versions() if v not in stay]
        for v in [] if dry_run else gone:
            p, fs = _fs(self.spark, f"{self.root}/vectors/version={v}")
            fs.delete(p, True)
        return gone


class Prompts:
    """A registry of prompt texts: versions count from 1, tags point at versions, every change is one line of a log."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.path = spark, f"{root.rstrip('/')}/prompts.jsonl"

    def _log(self) -> list[dict]:
        return [json.loads(x) for x in (read_text(self.spark, self.path) or "").splitlines()]

    def _add(self, entry: dict) -> None:
        replace_text(self.spark, self.path, "".join(json.dumps(e, sort_keys=True) + "\n" for e in [*self._log(), entry]))

    def register(self, name: str, text: str) -> int:
        version = sum(e["kind"] == "register" and e["name"] == name for e in self._log()) + 1
        self._add({"kind": "register", "name": name, "version": version, "text": text})
        return version

    def tag(self, name: str, tag: str, version: int) -> None:
        if not any(e["kind"] == "register" and e["name"] == name and e["version"] == version for e in self._log()):
            raise ValueError(f"{name} has no version {version}")
        self._add({"kind": "tag", "name": name, "tag": tag, "version": version})

    def get(self, name: str, tag: str) -> tuple[int, str]:
        """(version, text) that the tag points at now."""
        at = [e["version"] for e in self._log() if e["kind"] == "tag" and (e["name"], e["tag"]) == (name, tag)]
        if not at:
            raise ValueError(f"{name} has no tag {tag}")
        return at[-1], next(e["text"] for e in self._log() if e["kind"] == "register" and (e["name"], e["version"]) == (name, at[-1]))
