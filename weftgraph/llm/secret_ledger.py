"""Secret scans through a ledger of text blobs, in DataFrame functions only.

Every version of every document is content-addressed (SHA-256 of its text).  The ledger has a row
for each pair of blob and rule version that was ever scanned, with the spans found.  A run scans
only the pairs that the ledger lacks, each blob once however many paths hold it, appends them, and
joins the findings back to all paths.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import shared_folder, texts


@dataclass(frozen=True)
class Rule:
    """``pattern`` finds leftmost non-overlapping matches; a match counts if ``group`` has ``least`` characters or more.

    ``needs`` is a pattern that every text with a counting match also matches; it saves work.
    """

    kind: str
    version: int
    pattern: str
    group: int
    least: int
    needs: str

    @property
    def name(self) -> str:
        return f"{self.kind}@{self.version}"


#: The base rules of the contract.  A longer run of one class is found whole either
#: way, so for ``access`` and ``hex`` the least length can stand in the pattern itself.
_ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]%s)"""
RULES = (
    Rule("assign", 1, _ASSIGN % "+", 2, 12, _ASSIGN % "{12,}"),
    Rule("access", 1, r"AKIA[A-Z0-9]{14,}", 0, 18, r"AKIA[A-Z0-9]{14,}"),
    Rule("hex", 1, r"[0-9a-f]{16,}", 0, 16, r"[0-9a-f]{16,}"),
)


#: Parts that the paths of one blob are dealt into.
SALTS = 32


def spans_of(text: Column, rule: Rule) -> Column:
    """Array of (start, end) in code points, end exclusive, of the matches that count."""
    pattern = F.lit(rule.pattern)
    found = F.arrays_zip(
        F.transform(F.split(text, rule.pattern, -1), lambda x: F.length(x)).alias("gap"),
        F.transform(F.regexp_extract_all(text, pattern, F.lit(0)), lambda x: F.length(x)).alias("size"),
        F.transform(F.regexp_extract_all(text, pattern, F.lit(rule.group)), lambda x: F.length(x)).alias("tested"),
    )
    no_spans = F.array().cast("array<struct<start:int,end:int>>")
    start = lambda acc, x: acc["at"] + x["gap"]
    walked = F.aggregate(
        F.filter(found, lambda x: x["size"].isNotNull()),
        F.struct(F.lit(0).alias("at"), no_spans.alias("spans")),
        lambda acc, x: F.struct(
            (start(acc, x) + x["size"]).alias("at"),
            F.when(x["tested"] >= rule.least, F.concat(acc["spans"], F.array(F.struct(start(acc, x).alias("start"), (start(acc, x) + x["size"]).alias("end"))))).otherwise(acc["spans"]).alias("spans"),
        ),
        lambda acc: acc["spans"],
    )
    return F.when(text.rlike(rule.needs), walked).otherwise(no_spans)


def exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def update_ledger(versions: DataFrame, ledger_path: str, rules: tuple[Rule, ...] = RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Scan the pairs of blob and rule version that the ledger lacks, append them, and return the ledger.

    Ledger columns: ``blob``, ``rule`` and ``spans`` (array of start and end).  One row of each
    blob is scanned, chosen by least id; only keys are shuffled to choose it.
    """
    spark = versions.sparkSession
    held = texts(versions, id_col, text_col).select(F.col(id_col).alias("id"), F.sha2(text_col, 256).alias("blob"), F.col(text_col).alias("text"))
    wanted = F.array(*[F.lit(rule.name) for rule in rules])
    todo = held.groupBy("blob").agg(F.min("id").alias("id"))
    if exists(spark, ledger_path):
        seen = spark.read.parquet(ledger_path).where(F.col("rule").isin([rule.name for rule in rules])).groupBy("blob").agg(F.collect_set("rule").alias("seen"))
        todo = todo.join(seen, "blob", "left").withColumn("todo", F.array_except(wanted, F.coalesce("seen", F.array().cast("array<string>")))).where(F.size("todo") > 0).select("blob", "id", "todo")
    else:
        todo = todo.withColumn("todo", wanted)
    chosen = todo.select(F.col("blob").alias("blob_"), F.col("id").alias("id_"), "todo").hint("shuffle_hash")
    to_scan = held.join(chosen, (F.col("blob") == F.col("blob_")) & F.col("id").eqNullSafe(F.col("id_")))
    pairs = [F.when(F.array_contains("todo", rule.name), F.struct(F.lit(rule.name).alias("rule"), spans_of(F.col("text"), rule).alias("spans"))) for rule in rules]
    # repeated rows of the chosen id and text would enter twice
    scanned = to_scan.select("blob", F.filter(F.array(*pairs), lambda x: x.isNotNull()).alias("pairs")).dropDuplicates(["blob"])
    scanned = scanned.select("blob", F.explode("pairs").alias("pair")).select("blob", "pair.rule", "pair.spans")
    scanned.write.mode("append").parquet(ledger_path)
    return spark.read.parquet(ledger_path)


def scan_secrets(versions: DataFrame, ledger_path: str | None = None, rules: tuple[Rule, ...] = RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, ``blob`` and ``findings`` (array of start, kind order, kind, end; sorted).

    ``ledger_path`` is the lasting ledger; without one a new ledger is made in the shared folder.
    A null text counts as empty.  Repeated rows get the same findings, which are scanned once.  An
    empty table gives no rows.
    """
    spark = versions.sparkSession
    if ledger_path is None:
        ledger_path = f"{shared_folder(spark)}/secret-ledger-{uuid.uuid4().hex}"
    ledger = update_ledger(versions, ledger_path, rules, id_col, text_col)
    order = F.create_map(*[x for k, rule in enumerate(rules) for x in (F.lit(rule.name), F.struct(F.lit(k).alias("order"), F.lit(rule.kind).alias("kind")))])
    # two runs at once may both append a pair; its spans are the same
    found = ledger.where((F.size("spans") > 0) & F.col("rule").isin([rule.name for rule in rules])).dropDuplicates(["blob", "rule"])
    kind = order[F.col("rule")]
    by_blob = found.select("blob", F.transform("spans", lambda x: F.struct(x["start"].alias("start"), kind["order"].alias("order"), kind["kind"].alias("kind"), x["end"].alias("end"))).alias("spans")).groupBy("blob").agg(F.array_sort(F.flatten(F.collect_list("spans"))).alias("findings"))
    # the paths of one blob are dealt into SALTS parts, and the findings, which few blobs have, go to each
    paths = texts(versions, id_col, text_col).select(id_col, F.sha2(text_col, 256).alias("blob"), F.pmod(F.xxhash64(id_col), F.lit(SALTS)).cast("int").alias("salt_"))
    by_blob = by_blob.select("blob", "findings", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt_"))
    empty = F.array().cast("array<struct<start:int,order:int,kind:string,end:int>>")
    return paths.join(by_blob, ["blob", "salt_"], "left").select(id_col, "blob", F.coalesce("findings", empty).alias("findings"))
