"""Translations that are remembered between batches, in a keyed table with a bound."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..frames import cut
from ..functions import translation
from ..sources.merge import KeyedTable

SCHEMA = "text string, target string, english string, code string, engine string, note string, used long"
KEYS = ["text", "target"]
#: Translations that are kept; those used longest ago go first.
MOST = 4096


def translate(texts: DataFrame, cache: KeyedTable, model, batch: int, text: str = "text", target: str = "eng_Latn", most: int = MOST) -> DataFrame:
    """texts with english, code, engine and note as translation.translate() gives them; a model sees a text only if no earlier batch did.

    cache: a table of SCHEMA by KEYS. ``batch`` numbers the calls: what a batch uses counts as
    used then, and of equal use the first by text stay. Only what a model said is kept, so texts that it
    failed on are asked for again.
    """
    said = F.coalesce(F.col(text), F.lit(""))
    asked = texts.select(said.alias("text"), F.lit(target).alias("target")).distinct()
    held = cut(cache.lookup(asked))
    open_ = asked.join(held, KEYS, "left_anti").select("text")
    fresh = cut(translation.translate(open_, model))
    found = held.select("text", "english", "code", "engine", "note").unionByName(fresh.select("text", "english", "code", "engine", "note"))
    used = found.where("engine = 'model'").select("text", F.lit(target).alias("target"), "english", "code", "engine", "note", F.lit(batch).cast("long").alias("used"))
    every = cut(cache.read().join(used, KEYS, "left_anti").unionByName(used))
    kept = every.orderBy(F.col("used").desc(), "text", "target").limit(most)  # at most so many rows
    stays = every.join(kept.select(*KEYS), KEYS, "left_semi") if every.count() > most else every
    changes = used.join(stays.select(*KEYS), KEYS, "left_semi").withColumn("gone", F.lit(False)).unionByName(every.join(stays.select(*KEYS), KEYS, "left_anti").withColumn("gone", F.lit(True)))
    cache.merge(cut(changes), batch=f"{target}:{batch}", deleted="gone")
    return texts.join(found.withColumnRenamed("text", "__t"), said == F.col("__t"), "left").drop("__t")
