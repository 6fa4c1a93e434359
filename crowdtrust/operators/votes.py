"""Vote tables: compaction (P8), graph profile (A10) and the partitioned vote
store every EM iteration reads.

Layout of the store (the one real engineering decision of the engine):

* compacted votes ``(group.., prompt_id, annotator_id, vote, n)`` – duplicate
  rows collapse into a count, which is exact because every EM sum is linear
  in the rows;
* **cold** rows – prompts with at most ``hot_threshold`` votes – are written
  once as a bucketed parquet table in the shared checkpoint folder.  Each
  E-step groups by prompt and each M-step joins votes to their prompt's
  posterior inside the bucket: no exchange of vote rows in any iteration, and
  the written table survives executor loss;
* **parameters** are broadcast to the votes while there are at most
  ``BROADCAST_ROW_LIMIT`` of them.  Beyond, they are *routed*: the votes are
  bucketed by a label of their prompt, and a **routing table**, bucketed by
  annotator, lists the labels under which each annotator has votes.  In each
  iteration the parameters meet the routes, go to the labels' buckets and join
  the votes there.  Parameters travel, votes stay where they were written;
* **hot** rows – prompts with more than ``hot_threshold`` votes – go to a
  separate table spread over many files (routed: bucketed by annotator, where
  the parameters come to them).  Their per-prompt sums are combined map-side
  and the resulting per-prompt table is broadcast back; its size is bounded by
  ``n_votes / hot_threshold`` rows, a proven bound;
* a **packed** store has its cold votes in a row per prompt instead, arrays of
  annotators, votes and counts: an iteration then is one pass of array sums
  (``operators/packed.py``).  For one group whose parameters are broadcast;
* several groups (configurations) in one store fall into ``GROUP_PARTS``
  partition folders by the hash of their key, so that folders in which no
  group is fitted any more are not read.

A single prompt holding a third of all votes therefore never lands in one
task.  Hot annotators are harmless in both steps: per-annotator sums are
partial aggregates combined map-side, and a routed annotator has one row per
label at most.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field, replace

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crowdtrust.session import checkpoint_root, delete_path, scratch_path, unique_table_name

# Fixed engineering defaults (not reference values).
ROWS_PER_BUCKET = 4_000_000       # ~100 MB of compacted vote rows per bucket
MAX_BUCKETS = 100_000             # Spark's limit; beyond 4e11 rows the buckets grow instead
MIN_HOT_THRESHOLD = 100_000       # never call a prompt hot below this many votes
BROADCAST_ROW_LIMIT = 2_000_000   # broadcast per-annotator params up to this size
GROUP_PARTS = 32                  # partition folders over which several groups are dealt

#: Off while a routed store lives: rows that are partitioned by the bucket label alone may then be joined inside
#: the bucket on label and annotator, or label and prompt.  On, Spark would exchange both sides by all keys.
ALL_KEYS = "spark.sql.requireAllClusterKeysForCoPartition"

PART, BUCKET = "_part", "_bucket"  # columns of the layout: a group's folder, a prompt's bucket label


def compact_votes(votes: DataFrame, group_cols: list[str] | tuple = ()) -> DataFrame:
    """(group.., prompt_id, annotator_id, vote) -> count ``n``."""
    keys = list(group_cols) + ["prompt_id", "annotator_id", "vote"]
    return votes.groupBy(*keys).agg(F.count(F.lit(1)).cast("bigint").alias("n"))


def vote_profile(votes: DataFrame) -> DataFrame:
    """A10: one-row profile of the task-worker graph."""
    per_prompt = votes.groupBy("prompt_id").agg(F.count(F.lit(1)).alias("l"))
    per_worker = votes.groupBy("annotator_id").agg(F.count(F.lit(1)).alias("r"))
    pairs = votes.groupBy("prompt_id", "annotator_id").agg(F.count(F.lit(1)).alias("c"))
    a = votes.agg(F.count(F.lit(1)).cast("bigint").alias("n_votes"),
                  F.sum("vote").cast("bigint").alias("sum_vote"))
    b = per_prompt.agg(F.count(F.lit(1)).cast("bigint").alias("n_prompts"),
                       F.min("l").cast("bigint").alias("min_votes_per_prompt"),
                       F.max("l").cast("bigint").alias("max_votes_per_prompt"))
    c = per_worker.agg(F.count(F.lit(1)).cast("bigint").alias("n_annotators"),
                       F.min("r").cast("bigint").alias("min_tasks_per_annotator"),
                       F.max("r").cast("bigint").alias("max_tasks_per_annotator"))
    d = pairs.agg(F.sum(F.col("c") - 1).cast("bigint").alias("repeated_pairs"))
    # four one-row aggregates side by side
    return (a.withColumn("_k", F.lit(0)).join(b.withColumn("_k", F.lit(0)), "_k")
            .join(c.withColumn("_k", F.lit(0)), "_k").join(d.withColumn("_k", F.lit(0)), "_k").drop("_k"))


def votes_per_task_histogram(votes: DataFrame) -> DataFrame:
    """A10: number of prompts by votes-per-prompt L."""
    per_prompt = votes.groupBy("prompt_id").agg(F.count(F.lit(1)).cast("bigint").alias("votes_per_prompt"))
    return per_prompt.groupBy("votes_per_prompt").agg(F.count(F.lit(1)).cast("bigint").alias("n_prompts"))


def group_part(group_cols: list[str]) -> F.Column:
    """The partition folder of a group."""
    return F.pmod(F.hash(*group_cols), F.lit(GROUP_PARTS)).cast("int")


def bucket_labels(spark, b: int) -> DataFrame:
    """(slot, label) for the ``b`` buckets of a table bucketed by a long: the
    smallest number whose own hash falls into the bucket.  So each label fills
    one bucket and no two share one."""
    ids = spark.range(0, 64 * b).withColumn("_slot", F.pmod(F.hash("id"), F.lit(b)))
    return ids.groupBy("_slot").agg(F.min("id").alias(BUCKET))


_ROUTED: dict = {"stores": 0, "before": None}


def _routed(spark, change: int) -> None:
    """Count the routed stores; with the first the setting goes, with the last it comes back."""
    if not _ROUTED["stores"]:
        _ROUTED["before"] = spark.conf.get(ALL_KEYS)
    _ROUTED["stores"] += change
    spark.conf.set(ALL_KEYS, "false" if _ROUTED["stores"] else _ROUTED["before"])


@dataclass
class PromptTable:
    """Values per prompt, laid out like the votes: ``cold`` joins inside the
    bucket, ``hot`` (a row per hot prompt) by broadcast."""

    cold: DataFrame
    hot: DataFrame | None


@dataclass
class VoteStore:
    """Compacted, partitioned votes ready for iterative EM."""

    cold: DataFrame
    hot: DataFrame | None
    group_cols: list[str]
    n_votes: int
    n_rows: int
    n_annotators: int
    n_hot_prompts: int
    num_buckets: int
    hot_threshold: int
    single_group: bool = True
    routes: DataFrame | None = None
    hot_keys: DataFrame | None = None
    packed: DataFrame | None = None
    tables: list[str] = field(default_factory=list)
    paths: list[str] = field(default_factory=list)

    @property
    def prompt_keys(self) -> list[str]:
        return self.group_cols + ["prompt_id"]

    @property
    def cold_keys(self) -> list[str]:
        """What identifies a prompt among the cold rows; the bucketing columns are among them."""
        return ([BUCKET] if self.routes is not None else []) + self.prompt_keys

    @property
    def annotator_keys(self) -> list[str]:
        return self.group_cols + ["annotator_id"]

    @property
    def broadcast_params(self) -> bool:
        return self.n_annotators <= BROADCAST_ROW_LIMIT

    def rows(self) -> DataFrame:
        """All compacted rows (cold and hot)."""
        cols = [*self.prompt_keys, "annotator_id", "vote", "n"]
        cold = self.cold.select(*cols)
        return cold if self.hot is None else cold.unionByName(self.hot.select(*cols))

    def pruned(self, parts: list[int] | None) -> "VoteStore":
        """The same store, reading only these partition folders."""
        if parts is None or self.single_group:
            return self
        keep = F.col(PART).isin(parts)
        cut = lambda df: None if df is None else df.filter(keep)
        return replace(self, cold=cut(self.cold), hot=cut(self.hot), routes=cut(self.routes))

    def params_at_cold(self, params: DataFrame) -> DataFrame:
        """Routed parameters: (bucket label, annotator keys, parameters) in the
        partitions of the cold votes.  What is exchanged are parameters, once
        to the routes and once per route to the votes."""
        b = self.num_buckets
        here = params.repartition(b, *self.annotator_keys).hint("shuffle_hash")
        routed = self.routes.select(BUCKET, *self.annotator_keys).join(here, self.annotator_keys)
        return routed.repartition(b, BUCKET)

    def per_prompt(self, values: DataFrame) -> PromptTable:
        """Values per prompt (keyed by ``prompt_id`` and any of the group
        columns) written in the layout of the votes; prompts without votes
        are left out.  Only prompts are exchanged, and only here."""
        on = [c for c in self.prompt_keys if c in values.columns]
        if self.packed is not None:
            cold = self.packed.select("prompt_id").join(values.drop(*self.group_cols), "prompt_id")
            cold = self._write(cold, "ct_values", ["prompt_id"]).withColumns({g: F.lit(0) for g in self.group_cols})
            return PromptTable(cold, None if self.hot is None else self.hot_keys.join(values, on))
        cold = self.cold.select(*self.cold_keys, *([] if self.single_group else [PART])).distinct().join(values, on)
        keys = [BUCKET] if self.routes is not None else self.prompt_keys
        cold = self._write(cold, "ct_values", keys)
        return PromptTable(cold, None if self.hot is None else self.hot_keys.join(values, on))

    def _write(self, df: DataFrame, prefix: str, keys: list[str], dealt: bool = False) -> DataFrame:
        """``dealt``: the rows lie in the partitions of the buckets already."""
        name, spark = unique_table_name(prefix), df.sparkSession
        path = scratch_path(spark, name)
        w = (df if dealt else df.repartition(self.num_buckets, *keys)).write.mode("overwrite").option("path", path)
        if not self.single_group:
            w = w.partitionBy(PART)
        w.bucketBy(self.num_buckets, *keys).saveAsTable(name)
        self.tables.append(name)
        self.paths.append(path)
        return spark.table(name)

    def drop(self) -> None:
        """Take the store out of the catalog and delete its files (both are
        its own: they lie in folders that it made)."""
        spark = self.cold.sparkSession
        for t in self.tables:
            spark.sql(f"DROP TABLE IF EXISTS {t}")
        for p in self.paths:
            delete_path(spark, p)
        if self.routes is not None:
            _routed(spark, -1)

    def __enter__(self) -> "VoteStore":
        return self

    def __exit__(self, *exc) -> None:
        self.drop()

    @classmethod
    def build(cls, votes: DataFrame, group_cols: list[str] | tuple = (), *,
              num_buckets: int | None = None, hot_threshold: int | None = None,
              compacted: bool = False, packed: bool = False) -> "VoteStore":
        """``packed``: a packed store, where the annotators are few enough
        (the one group must be 0 then)."""
        spark = votes.sparkSession
        checkpoint_root(spark)
        group_cols = list(group_cols)
        if packed:
            store = cls._build_packed(votes, group_cols, num_buckets, hot_threshold, compacted)
            if store is not None:
                return store
        pkeys = group_cols + ["prompt_id"]
        comp = votes if compacted else compact_votes(votes, group_cols)
        comp = comp.select(*group_cols, F.col("prompt_id").cast("bigint"), F.col("annotator_id").cast("bigint"),
                           F.col("vote").cast("int"), F.col("n").cast("bigint"))
        comp = comp.persist(StorageLevel.MEMORY_AND_DISK)
        group = F.struct(*group_cols) if group_cols else F.lit(0)
        st = comp.agg(F.sum("n").alias("v"), F.count(F.lit(1)).alias("r"), (F.min(group) == F.max(group)).alias("one"),
                      F.count_distinct(*(group_cols + ["annotator_id"])).alias("a")).first()
        n_votes, n_rows, n_ann = int(st["v"] or 0), int(st["r"] or 0), int(st["a"] or 0)
        shuffle = int(spark.conf.get("spark.sql.shuffle.partitions"))
        b = num_buckets or min(MAX_BUCKETS, max(shuffle, math.ceil(n_rows / ROWS_PER_BUCKET)))
        t = hot_threshold if hot_threshold is not None else max(MIN_HOT_THRESHOLD, n_votes // (4 * b))
        # at most n_votes / t prompts can exceed t votes: a bounded table
        hot_keys = (comp.groupBy(*pkeys).agg(F.sum("n").alias("cnt")).filter(F.col("cnt") > t)
                    .select(*pkeys)).checkpoint(eager=True)
        n_hot = hot_keys.count()
        store = cls(comp, None, group_cols, n_votes, n_rows, n_ann, n_hot, b, t, st["one"] is not False)
        if not store.single_group:
            comp_rows = comp.withColumn(PART, group_part(group_cols))
        else:
            comp_rows = comp
        cold_src = comp_rows if n_hot == 0 else comp_rows.join(F.broadcast(hot_keys), pkeys, "left_anti")
        if store.broadcast_params:
            store.cold = store._write(cold_src, "ct_votes", pkeys)
        else:
            slot = F.pmod(F.hash(*pkeys), F.lit(b))
            cold_src = cold_src.withColumn("_slot", slot).join(F.broadcast(bucket_labels(spark, b)), "_slot").drop("_slot")
            store.cold = store._write(cold_src, "ct_votes", [BUCKET])
            routes = store.cold.select(BUCKET, *store.annotator_keys, *([] if store.single_group else [PART])).distinct()
            store.routes = store._write(routes, "ct_votes_routes", store.annotator_keys)
            _routed(spark, 1)
        if n_hot:
            store.hot_keys = hot_keys
            hot_src = comp_rows.join(F.broadcast(hot_keys), pkeys, "left_semi")
            if store.broadcast_params:
                path = scratch_path(spark, "hot_votes")
                w = hot_src.repartition(b, *(pkeys + ["annotator_id", "vote"])).write.mode("overwrite")
                (w if store.single_group else w.partitionBy(PART)).parquet(path)
                store.hot = spark.read.parquet(path)
                store.paths.append(path)
            else:
                # an annotator has two rows per hot prompt at most
                store.hot = store._write(hot_src, "hot_votes", store.annotator_keys)
        comp.unpersist()
        return store

    @classmethod
    def _build_packed(cls, votes: DataFrame, group_cols: list[str], num_buckets: int | None, hot_threshold: int | None,
                      compacted: bool) -> "VoteStore | None":
        """A packed store; None where there are too many annotators.

        Prompts and annotators are counted on their own columns alone; the
        votes are exchanged once, by prompt, and compacted and packed where
        they arrive.  Votes without an annotator never count and stay away."""
        spark = votes.sparkSession
        pkeys = group_cols + ["prompt_id"]
        n = F.col("n").cast("bigint") if compacted else F.lit(1).cast("bigint")
        raw = votes.select(*group_cols, F.col("prompt_id").cast("bigint"), F.col("annotator_id").cast("bigint"),
                           F.col("vote").cast("int"), n.alias("n"))
        n_ann = raw.select("annotator_id").distinct().count()
        if n_ann > BROADCAST_ROW_LIMIT:
            return None
        per_prompt = raw.groupBy(*pkeys).agg(F.sum("n").alias("cnt"))
        n_votes, largest = per_prompt.agg(F.coalesce(F.sum("cnt"), F.lit(0)), F.coalesce(F.max("cnt"), F.lit(0))).first()
        b = num_buckets or min(MAX_BUCKETS, max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(n_votes / ROWS_PER_BUCKET)))
        t = hot_threshold if hot_threshold is not None else max(MIN_HOT_THRESHOLD, n_votes // (4 * b))
        store = cls(raw, None, group_cols, n_votes, n_votes, n_ann, 0, b, t)
        raw = raw.filter("annotator_id is not null")
        cold = raw
        if largest > t:
            # at most n_votes / t prompts: a bounded table
            store.hot_keys = per_prompt.filter(F.col("cnt") > t).select(*pkeys).checkpoint(eager=True)
            store.n_hot_prompts = store.hot_keys.count()
            cold = raw.join(F.broadcast(store.hot_keys), pkeys, "left_anti")
            path = scratch_path(spark, "hot_votes")
            hot = raw.join(F.broadcast(store.hot_keys), pkeys, "left_semi").groupBy(*pkeys, "annotator_id", "vote").agg(F.sum("n").alias("n"))
            hot.repartition(b, *pkeys, "annotator_id", "vote").write.parquet(path)
            store.hot = spark.read.parquet(path)
            store.paths.append(path)
        # compacted and packed in the partitions of the buckets: no exchange but this one
        cold = cold.select("prompt_id", "annotator_id", "vote", "n").repartition(b, "prompt_id")
        cold = cold.groupBy("prompt_id", "annotator_id", "vote").agg(F.sum("n").alias("n"))
        cold = cold.groupBy("prompt_id").agg(F.collect_list(F.struct("annotator_id", "vote", "n")).alias("v"))
        cold = cold.select("prompt_id", F.col("v.annotator_id").alias("annotators"), F.col("v.vote").alias("votes"), F.col("v.n").alias("ns"))
        store.packed = store._write(cold, "ct_votes", ["prompt_id"], dealt=True)
        one = [F.lit(0).alias(g) for g in group_cols]
        store.cold = store.packed.select("prompt_id", F.explode(F.arrays_zip("annotators", "votes", "ns")).alias("z")).select(
            *one, "prompt_id", F.col("z.annotators").alias("annotator_id"), F.col("z.votes").alias("vote"), F.col("z.ns").alias("n"))
        return store
