"""Token counts: delta-maintained rollups with idempotent batch commits.

A change record says what one document contributed before and contributes now::

    source, lang, tokenizer_version, old_tokens, new_tokens

An insert has a null ``old_tokens``, a delete a null ``new_tokens``, a revised count both.
Totals by (source, lang, tokenizer_version) are additive, so a batch is the signed sum of its
records and a commit touches only totals, never earlier records.

Defined results: null keys form their own group; a record with both counts null changes nothing;
repeated records count each time (the caller's batch id makes a whole batch idempotent); an empty
batch commits and leaves the totals as they were; groups that return to no documents are dropped.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from concordia.llm._common import WORD, fresh_folder, ship, stage

KEYS = ["source", "lang", "tokenizer_version"]
TOTALS = "source string, lang string, tokenizer_version string, n_docs long, n_tokens long"
#: Tokenizer versions whose counts SQL can state: words, and words with punctuation split off.
VERSIONS = {"words-1": WORD, "wordpunct-1": r"[A-Za-z0-9_\x{80}-\x{10FFFF}]+|[^A-Za-z0-9_\x{80}-\x{10FFFF}\x20\x09-\x0D]"}


def signed(changes: DataFrame) -> DataFrame:
    """Signed totals of a batch of change records."""
    return (
        changes.groupBy(*KEYS)
        .agg(
            F.sum(F.col("new_tokens").isNotNull().cast("long") - F.col("old_tokens").isNotNull().cast("long")).alias("n_docs"),
            F.sum(F.coalesce("new_tokens", F.lit(0)) - F.coalesce("old_tokens", F.lit(0))).alias("n_tokens"),
        )
        .select(*KEYS, "n_docs", "n_tokens")
    )


class Rollup:
    """Totals in a folder that all executors share.

    Each commit writes a whole new snapshot ``v<k>`` (totals are few) whose Spark ``_SUCCESS`` marker
    is its commit point, and the batch id is a column of that snapshot's ``batches`` table.  A batch
    id that was committed before is a no-op, and a half-written snapshot is not seen: the reader takes
    the last version that a ``batches`` folder completes.  One writer at a time.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        jvm = spark.sparkContext._jvm
        self._Path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._Path(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def version(self) -> int:
        """The last complete version; 0 before the first commit."""
        k = 0
        while self._fs.exists(self._Path(f"{self.path}/v{k + 1}/batches/_SUCCESS")):
            k += 1
        return k

    def _read(self, name: str, schema: str, k: int) -> DataFrame:
        if not k:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(f"{self.path}/v{k}/{name}")

    def totals(self) -> DataFrame:
        return self._read("totals", TOTALS, self.version())

    def commit(self, batch_id: str, changes: DataFrame) -> bool:
        """Apply *changes* once; False if *batch_id* was committed before."""
        k = self.version()
        done = self._read("batches", "batch_id string", k)
        if done.where(F.col("batch_id") == batch_id).take(1):
            return False
        new = (
            self._read("totals", TOTALS, k)
            .unionByName(signed(changes))
            .groupBy(*KEYS)
            .agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))
            .where("n_docs <> 0 or n_tokens <> 0")
        )
        to = f"{self.path}/v{k + 1}"
        new.write.mode("overwrite").parquet(f"{to}/totals")
        added = self.spark.createDataFrame([(batch_id,)], "batch_id string")
        done.unionByName(added).coalesce(1).write.mode("overwrite").parquet(f"{to}/batches")
        return True


def corpus_token_counts(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """Totals of *docs* after a day of commits: insert all, replay that batch, revise, delete, reinsert.

    The counts of each document are taken once and staged; the batches are:
    1. all documents under both tokenizer versions (and the same batch again, which changes nothing);
    2. a recount that was twice too high for the documents whose doc_id mod 5 is 1;
    3. its correction;
    4. deletion of the documents whose doc_id mod 7 is 3.
    """
    text = F.coalesce("text", F.lit(""))
    n = {v: F.regexp_count(text, F.lit(p)).cast("long") for v, p in VERSIONS.items()}
    counted = docs.select(
        F.col("source").cast("string"), F.col("lang").cast("string"), F.col("doc_id").alias("ticket"),
        F.explode(F.map_from_arrays(F.array(*map(F.lit, n)), F.array(*n.values()))).alias("tokenizer_version", "n"),
    )
    counted = stage(counted, "token-counts")
    none = F.lit(None).cast("long")
    change = lambda rows, old, new: rows.select(*KEYS, old.alias("old_tokens"), new.alias("new_tokens"))
    store = Rollup(spark, fresh_folder(spark, "rollup"))
    first = change(counted, none, F.col("n"))
    store.commit("2024-01-01/load", first)
    store.commit("2024-01-01/load", first)
    revised = counted.where("ticket % 5 = 1")
    store.commit("2024-01-02/recount", change(revised, F.col("n"), F.col("n") * 2))
    store.commit("2024-01-03/fix", change(revised, F.col("n") * 2, F.col("n")))
    store.commit("2024-01-04/takedown", change(counted.where("ticket % 7 = 3"), F.col("n"), none))
    return store.totals()


ship(__name__)
