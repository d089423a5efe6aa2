"""The case library as versioned tables: one change of keys or one merge reaches every table that refers to cases.

All tables that a change touches are written anew under fresh names, and one manifest makes them the library; a job that dies between two
tables leaves the version before it readable, and is simply run again. Readers hold a version by its number.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shipping import materialised
from .versions import Versions

#: Rows of a map of keys that are broadcast at most.
BROADCAST_ROWS = 500_000
#: Tables that belong to a case as a whole: they move to a keeper that has none. And those whose rows are one for each user and case.
WHOLE, SHARED = ("chunks", "benches", "analyses"), ("bookmarks", "annotations")


class Library:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.versions = spark, Versions(spark, root)

    def tables(self, number: int | None = None) -> dict[str, str]:
        """Folders of the tables of a version, the newest one if none is named."""
        return self.versions.read(number).get("tables", {})

    def table(self, name: str, number: int | None = None) -> DataFrame:
        return self.spark.read.parquet(self.tables(number)[name])

    def change(self, tables: dict[str, DataFrame]) -> int:
        """Write some tables and make them, with the others as they are, the next version."""
        number = self.versions.latest()
        paths = dict(self.tables(number))
        for name, df in tables.items():
            paths[name] = self.versions.fresh(name)
            df.write.option("compression", "zstd").parquet(paths[name])
        return self.versions.commit({"tables": paths}, number)

    def _sized(self, df: DataFrame) -> DataFrame:
        return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df

    def rename(self, names: DataFrame) -> int:
        """Apply a map (old, new) of case numbers to every table with a case_no; old names that nothing has change nothing."""
        to = self._sized(names.select(F.col("old").alias("case_no"), F.col("new").alias("_new")).filter("case_no IS NOT NULL").dropDuplicates(["case_no"]))
        held = {n: self.table(n) for n in self.tables()}
        return self.change({n: d.join(to, "case_no", "left").withColumn("case_no", F.coalesce("_new", "case_no")).select(*d.columns) for n, d in held.items() if "case_no" in d.columns})

    def merge(self, pairs: DataFrame) -> int:
        """Drop rows of judgements for keepers: pairs (dropped, keeper) of file names, each file dropped once, no keeper dropped.

        A case number that a row left still carries keeps its children. Others move: chunks to a keeper without chunks (which takes over n_chunks), benches and
        analyses to a keeper without, of several cases the first one's by file name, else they go; bookmarks and annotations move unless their user has one
        there. log gets a row for each file: (filename, case_no, keeper_filename, keeper_case_no, shared).
        """
        held = {n: self.table(n) for n in self.tables()}
        j = held["judgements"]
        named = pairs.filter("dropped IS NOT NULL AND keeper IS NOT NULL").select("dropped", "keeper")
        few = named.count() <= BROADCAST_ROWS

        def sized(df: DataFrame) -> DataFrame:
            return F.broadcast(df) if few else df

        # judgements meet the pairs in one shuffle by file name, and what comes of it is read by all that follows
        going = named.select(F.col("dropped").alias("filename"), F.col("keeper").alias("_keeper"))
        keeping = named.select(F.col("keeper").alias("filename"), F.lit(True).alias("_keeps")).distinct()
        rows = materialised(j.join(sized(going), "filename", "left").join(sized(keeping), "filename", "left"), "library-rows")
        kept = rows.filter("_keeps").select(F.col("filename").alias("keeper"), F.col("case_no").alias("keeper_no"), F.col("n_chunks").alias("keeper_chunks"), F.lit(True).alias("_found"))
        own = rows.filter("_keeper IS NOT NULL").withColumnRenamed("_keeper", "keeper").drop("_keeps").join(sized(kept), "keeper", "left")
        own = materialised(own, "library-pairs")
        stay = own.filter("_found IS NULL").select(*j.columns)  # their keepers don't exist
        left = rows.filter("_keeper IS NULL").select(*j.columns).unionByName(stay)
        own = own.filter("_found").select(F.col("filename").alias("dropped"), "keeper", "case_no", "n_chunks", "keeper_no", "keeper_chunks")
        alive = left.select("case_no", F.lit(True).alias("shared")).distinct()
        marked = materialised(own.join(alive, "case_no", "left").withColumn("shared", F.coalesce("shared", F.lit(False))), "library-merged")
        log = marked.select(F.col("dropped").alias("filename"), "case_no", F.col("keeper").alias("keeper_filename"), F.col("keeper_no").alias("keeper_case_no"), "shared")
        moves = marked.filter(~F.col("shared")).groupBy("case_no").agg(F.min_by(F.struct("keeper_no", "keeper", "keeper_chunks", "dropped", "n_chunks"), "dropped").alias("m")).select("case_no", "m.*")
        moves = materialised(moves, "library-moves")
        out: dict[str, DataFrame] = {}
        for name in (n for n in WHOLE if n in held):
            d = held[name]
            having = d.select(F.col("case_no").alias("keeper_no"), F.lit(True).alias("_has")).distinct()
            known = moves.join(having, "keeper_no", "left").withColumn("_has", F.coalesce("_has", F.lit(False)) | ((F.col("keeper_chunks") > 0) if name == "chunks" else F.lit(False)))
            with_own = known.join(d.select("case_no").distinct(), "case_no", "left_semi")
            first = F.row_number().over(Window.partitionBy("keeper_no").orderBy("dropped"))
            plan = materialised(with_own.withColumn("_to", F.when(~F.col("_has") & (first == 1), F.col("keeper_no"))), f"library-{name}")
            placed = d.join(self._sized(plan.select("case_no", "_to", F.lit(True).alias("_gone"))), "case_no", "left")
            out[name] = placed.filter(F.col("_gone").isNull() | F.col("_to").isNotNull()).withColumn("case_no", F.coalesce("_to", "case_no")).select(*d.columns)
            if name == "chunks":
                took = plan.filter("_to IS NOT NULL").select(F.col("keeper").alias("filename"), F.col("n_chunks").alias("_took"))
                left = left.join(self._sized(took), "filename", "left").withColumn("n_chunks", F.coalesce("_took", "n_chunks")).select(*j.columns)
        for name in (n for n in SHARED if n in held):
            d = held[name]
            moved = d.join(self._sized(moves.select("case_no", "keeper_no", "dropped")), "case_no", "left")
            one = Window.partitionBy("user", F.coalesce("keeper_no", "case_no")).orderBy(F.col("dropped").asc_nulls_first())
            kept = moved.withColumn("_at", F.when(F.col("keeper_no").isNull(), 1).otherwise(F.row_number().over(one)))
            out[name] = kept.filter("_at = 1").withColumn("case_no", F.coalesce("keeper_no", "case_no")).select(*d.columns)
        before = held["log"].unionByName(log) if "log" in held else log
        return self.change({"judgements": left, **out, "log": before})
