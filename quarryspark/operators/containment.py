"""Which of many names a text contains: long names by their rarest gram, short ones by an automaton in shards of a bounded size.

A name of GRAM letters or more is looked for only in the distinct texts that have the gram of it that fewest names share, so names and texts
meet in a shuffle and no task holds all names. Shorter names make an automaton; a text is read once for each shard of it.
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shipping import materialised, ship

#: Characters of the names of a shard, about; what the driver and each worker hold.
SHARD_CHARS = 8_000_000
#: Letters of a gram.
GRAM = 8


def _grams(c: str) -> Column:
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(c) - (GRAM - 1)), lambda i: F.substring(F.col(c), i, F.lit(GRAM))))


def longest_contained(texts: DataFrame, names: DataFrame, id_col: str, text_col: str = "norm", name_col: str = "norm") -> DataFrame:
    """(id_col, name): the longest of names that each text contains, all of them if several are as long.

    Null and empty texts and names contain and are contained in nothing; repeated names count once, repeated texts give a row each.
    """
    spark = texts.sparkSession
    ship(spark)
    known = materialised(names.select(F.col(name_col).alias("name")).filter("name <> ''").distinct(), "names")
    asked = materialised(texts.select(id_col, F.col(text_col).alias("text")).filter("text <> ''"), "texts")
    whole = asked.select("text").distinct()

    grams = known.filter(F.length("name") >= GRAM).select("name", F.explode(_grams("name")).alias("gram"))
    rarity = grams.groupBy("gram").agg(F.count("*").alias("n"))
    keys = grams.join(rarity, "gram").groupBy("name").agg(F.min_by("gram", F.struct("n", "gram")).alias("gram"))
    out = whole.filter(F.length("text") >= GRAM).select("text", F.explode(_grams("text")).alias("gram")).join(keys.hint("merge"), "gram").filter(F.contains("text", "name")).select("text", "name")

    short = known.filter(F.length("name") < GRAM)
    total = short.agg(F.sum(F.length("name"))).first()[0] or 0
    shards = -(-total // SHARD_CHARS)
    for shard in range(shards):
        own = [r["name"] for r in short.filter(F.pmod(F.xxhash64("name"), F.lit(shards)) == shard).collect()]  # about SHARD_CHARS characters
        if own:
            out = out.unionByName(whole.mapInPandas(_finder(own, "text"), "text string, name string"))
    longest = F.rank().over(Window.partitionBy("text").orderBy(F.length("name").desc()))  # of the names that one text contains
    return asked.join(out.withColumn("_at", longest).filter("_at = 1").select("text", "name").distinct(), "text").select(id_col, "name")


def _finder(names: list[str], id_col: str):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        automaton = ahocorasick.Automaton()
        for n in names:
            automaton.add_word(n, n)
        automaton.make_automaton()
        for b in batches:
            ids, found = [], []
            for i, text in zip(b[id_col], b["text"], strict=True):
                longest: set[str] = set()
                most = 1
                for _, name in automaton.iter(text):
                    if len(name) > most:
                        longest, most = {name}, len(name)
                    elif len(name) == most:
                        longest.add(name)
                ids += [i] * len(longest)
                found += sorted(longest)
            yield pd.DataFrame({id_col: pd.Series(ids, dtype=b[id_col].dtype), "name": pd.Series(found, dtype=object)})

    return run
