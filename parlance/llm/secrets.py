"""Secret scans over an incremental blob ledger.

Every version of a path is addressed by its content: a blob is the SHA-256 of its text. The ledger is a folder
of finished runs; a run's row says of a blob which rule versions have seen it and what they found. A scan

1. addresses all versions, and thins copies within a task before anything is shuffled, so a text that fills a
   third of the table leaves a task once;
2. joins the thinned texts with the ledger by blob and keeps, of each blob once, the rule versions that have not
   seen it (the joined stream is sorted by blob, so copies lie side by side);
3. runs only those rules, and appends a run to the ledger; a run that breaks off leaves none;
4. joins the findings of all runs back to every version of every path. Only blobs with findings are on the other
   side, so it is repeated for each of ``SPREAD`` parts that the versions of a blob are dealt over.

A rule's new version leaves older findings of that rule unused and looks at all blobs again; other rules stay.

Rules are patterns matched leftmost and non-overlapping, with a condition on top; a match that fails it is
dropped and not retried. ``assign``, ``access`` and ``hex`` are the base; further rules add private keys, access
tokens of code hosts and chats, bearer tokens and passwords in addresses.

Defined results: null text counts as empty; offsets are code points, end exclusive; repeated rows get the same
findings each; an empty table gives no rows and leaves the ledger as it is; extra columns are kept.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parlance.llm.common import clean_shuffles, fresh, ship, slices, strings, text_or_empty

SEEN, SPREAD = 100_000, 16
LEDGER = "blob binary, rules array<string>, found array<struct<rule:string,start:int,end:int>>"


@dataclass(frozen=True)
class Rule:
    """``hint`` is a pattern of the same syntax that every text with a match has; ``least``: (group, characters)."""

    kind: str
    pattern: str
    hint: str
    least: tuple[int, int] = (0, 1)
    version: int = 1

    @property
    def key(self) -> str:
        return f"{self.kind}@{self.version}"

    def spans(self, text: str) -> list[tuple[int, int]]:
        group, size = self.least
        return [m.span() for m in re.compile(self.pattern, re.ASCII).finditer(text) if len(m[group]) >= size]


def either_case(word: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


_WORDS = "|".join(either_case(w) for w in ("password", "passwd", "secret", "token", "api_?key"))
#: Base rules, fixed by contract, in the order of their kinds.
BASE = (
    Rule("assign", rf"""({_WORDS})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", rf"""({_WORDS})["']?\x20*[:=]""", (2, 6)),
    Rule("access", r"AKIA[A-Z0-9]+", r"AKIA[A-Z0-9]{16}", (0, 20)),
    Rule("hex", r"[0-9a-f]+", r"[0-9a-f]{24}", (0, 24)),
)
MORE = (
    Rule("private", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", r"PRIVATE KEY-----"),
    Rule("codehost", r"gh[pousr]_[A-Za-z0-9]+", r"gh[pousr]_[A-Za-z0-9]{36}", (0, 40)),
    Rule("chat", r"xox[abeoprs]-[A-Za-z0-9-]+", r"xox[abeoprs]-[A-Za-z0-9-]{10}", (0, 15)),
    Rule("bearer", r"[Bb]earer ([A-Za-z0-9._~+/=-]+)", r"[Bb]earer [A-Za-z0-9._~+/=-]{20}", (1, 20)),
    Rule("userinfo", r"://[^\x00-\x20/:@]+:([^\x00-\x20/@]+)@", r"://[^\x00-\x20/:@]+:[^\x00-\x20/@]+@", (1, 4)),
)
RULES = BASE + MORE


def findings(texts: pa.Array, wanted: list[list[str]], rules: tuple[Rule, ...]) -> list[list[dict]]:
    """Per text the spans of the wanted rules; Arrow's linear-time matcher picks the texts that Python looks at."""
    out: list[list[dict]] = [[] for _ in wanted]
    for rule in rules:
        asked = pa.array([rule.key in w for w in wanted], pa.bool_())
        rows = pc.indices_nonzero(pc.and_(asked, pc.match_substring_regex(texts, rule.hint)))
        for row, text in zip(rows.to_pylist(), texts.take(rows).to_pylist(), strict=True):
            out[row] += [{"rule": rule.key, "start": a, "end": b} for a, b in rule.spans(text)]
    return out


def _folder(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def runs(spark: SparkSession, ledger: str) -> list[str]:
    """The finished runs of a ledger, oldest first."""
    at, fs = _folder(spark, ledger)
    if not fs.exists(at):
        return []
    found = sorted(s.getPath().toString() for s in fs.listStatus(at))
    done = lambda p: fs.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{p}/_SUCCESS"))
    return [p for p in found if done(p)]


def read_ledger(spark: SparkSession, ledger: str) -> DataFrame:
    paths = runs(spark, ledger)
    return spark.read.schema(LEDGER).parquet(*paths) if paths else spark.createDataFrame([], LEDGER)


def _thinned(texts: DataFrame) -> DataFrame:
    """(blob, text) with each blob once a task, as far as a bounded memory of blobs reaches."""

    def run(batches):
        seen: set[bytes] = set()
        for batch in batches:
            keep = []
            for row, blob in enumerate(batch.column("blob").to_pylist()):
                if blob not in seen:
                    if len(seen) >= SEEN:
                        seen.clear()
                    seen.add(blob)
                    keep.append(row)
            yield batch.take(pa.array(keep, pa.int64()))

    return texts.mapInArrow(run, "blob binary, text string")


def scan_unseen(texts: DataFrame, ledger: str, rules: tuple[Rule, ...] = RULES) -> str | None:
    """Scan what the ledger lacks of ``texts(blob, text)`` and append a run; its path, or None where nothing was lacking."""
    spark = texts.sparkSession
    ship(spark)
    keys = [r.key for r in rules]
    known = runs(spark, ledger)
    thin = _thinned(texts)
    if known:
        seen = spark.read.schema(LEDGER).parquet(*known).select("blob", F.explode("rules").alias("rule")).where(F.col("rule").isin(keys))
        seen = seen.groupBy("blob").agg(F.collect_set("rule").alias("seen"))  # as many as there are rules
        todo = thin.join(seen.hint("merge"), "blob", "left").withColumn("wanted", F.array_except(F.array(*map(F.lit, keys)), F.coalesce("seen", F.array().cast("array<string>"))))
        todo = todo.where(F.size("wanted") > 0).select("blob", "text", "wanted").sortWithinPartitions("blob")
    else:
        todo = thin.repartition("blob").sortWithinPartitions("blob").withColumn("wanted", F.array(*map(F.lit, keys)))

    def scan(batches):
        late = None
        for batch in batches:
            blobs = batch.column("blob").to_pylist()
            first = [b != a for a, b in zip([late, *blobs[:-1]], blobs, strict=True)]
            late = blobs[-1] if blobs else late
            for part in slices(batch.filter(pa.array(first, pa.bool_())), "text"):
                wanted = part.column("wanted").to_pylist()
                found = findings(strings(part.column("text")), wanted, rules)
                yield pa.RecordBatch.from_arrays([part.column("blob"), part.column("wanted"), pa.array(found, pa.list_(pa.struct([("rule", pa.string()), ("start", pa.int32()), ("end", pa.int32())])))], names=["blob", "rules", "found"])

    done = todo.mapInArrow(scan, LEDGER)
    path = f"{ledger}/run-{len(known):06d}"
    at, fs = _folder(spark, path)
    if fs.exists(at):  # what a run that broke off has left
        fs.delete(at, True)
    with clean_shuffles(spark):
        done.write.option("compression", "zstd").parquet(path)
    if spark.read.schema(LEDGER).parquet(path).isEmpty():
        fs.delete(at, True)
        return None
    return path


def blob_findings(spark: SparkSession, ledger: str, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(blob, found) of blobs with findings: those of all runs by these rule versions, by start and order of rules."""
    order = F.create_map(*(x for i, r in enumerate(rules) for x in (F.lit(r.key), F.lit(i))))
    rows = read_ledger(spark, ledger).select("blob", F.explode("found").alias("f")).where(F.col("f.rule").isin([r.key for r in rules]))
    span = F.struct(F.col("f.start").alias("start"), order[F.col("f.rule")].alias("rule"), F.col("f.end").alias("end"))
    return rows.groupBy("blob").agg(F.array_sort(F.collect_set(span)).alias("found"))  # of one blob


def scan_versions(versions: DataFrame, ledger: str, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``versions`` (any columns, with ``text``) without the text, with ``blob`` and ``found``: spans (kind, start, end)."""
    spark = versions.sparkSession
    blob, found = fresh(versions, "blob", "found")
    addressed = versions.withColumn(blob, F.unhex(F.sha2(text_or_empty().cast("binary"), 256)))
    scan_unseen(addressed.select(F.col(blob).alias("blob"), text_or_empty().alias("text")), ledger, rules)
    kinds = F.array(*(F.lit(r.kind) for r in rules))
    held = blob_findings(spark, ledger, rules).select(
        F.col("blob").alias(blob), F.transform("found", lambda s: F.struct(kinds[s["rule"]].alias("kind"), s["start"].alias("start"), s["end"].alias("end"))).alias(found)
    )
    # A blob's versions are spread over SPREAD keys; the findings, which only blobs with secrets have, go to all of them.
    (salt,) = fresh(addressed.drop("text"), "salt")
    spread = addressed.drop("text").withColumn(salt, F.pmod(F.monotonically_increasing_id(), F.lit(SPREAD)))
    held = held.withColumn(salt, F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SPREAD - 1).cast("long"))))
    out = spread.join(held.hint("merge"), [blob, salt], "left")
    none = F.array().cast("array<struct<kind:string,start:int,end:int>>")
    return out.select(*(c for c in versions.columns if c.lower() != "text"), blob, F.coalesce(F.col(found), none).alias(found))


def digests(scanned: DataFrame) -> DataFrame:
    """doc_id, counts of base spans, base_sha256 and spans of scanned versions."""
    joined = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    base = F.filter("found", lambda s: s["kind"].isin([r.kind for r in BASE]))
    count = lambda kind: F.size(F.filter("found", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return scanned.select(F.col("doc_id").cast("long").alias("doc_id"), *(count(r.kind) for r in BASE), F.sha2(joined(base).cast("binary"), 256).alias("base_sha256"), joined(F.col("found")).alias("spans"))


def find_secrets(docs: DataFrame, ledger: str, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """One row per row of ``docs(doc_id, text)``, by way of the ledger."""
    return digests(scan_versions(docs.select("doc_id", "text"), ledger, rules))
