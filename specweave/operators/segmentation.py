"""Words that lost the space between them, put apart by a two-word language model. Every step is a join over pieces."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..frames import cut, stored

#: Letters from which a run may be two or three words; letters of a word at least and at most.
LONG, SHORTEST, LONGEST = 8, 2, 20
#: What a pair that was never seen keeps of its second word's share.
BACK_OFF = 0.4
_RUN = rf"\b[a-z]{{{LONG},}}\b"


@dataclass(frozen=True)
class Model:
    """words: word, n; pairs: a, b, n; total: all words counted."""

    words: DataFrame
    pairs: DataFrame
    total: int


def counted(texts: DataFrame, text: str = "text") -> Model:
    """Counts of words and of pairs of neighbours in lower-cased texts; a pair never leaves its text.

    Texts are read once: a word stands as often as it comes first in a pair, or last in its text.
    """
    t = texts.select(F.regexp_extract_all(F.lower(text), F.lit("[a-z]+"), F.lit(0)).alias("w")).where(F.size("w") > 0)
    both = F.zip_with("w", F.slice("w", F.lit(2), F.size("w")), lambda a, b: F.struct(a.alias("a"), b.alias("b")))  # null behind the last
    all_ = stored(t.select(F.inline(both)).groupBy("a", "b").agg(F.count(F.lit(1)).alias("n")))
    words, pairs = cut(all_.groupBy(F.col("a").alias("word")).agg(F.sum("n").alias("n"))), all_.where("b is not null")
    return Model(words, pairs, words.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0])


def runs_of(texts: DataFrame, text: str = "text") -> DataFrame:
    """run: the distinct long runs of small letters in texts."""
    return texts.select(F.explode(F.regexp_extract_all(text, F.lit(_RUN), F.lit(0))).alias("run")).distinct()


def pieces(runs: DataFrame, words: DataFrame) -> DataFrame:
    """(run, start, end, piece, n) of every stretch of a run that is a known word."""
    n = F.char_length("run")
    ends = lambda i: F.sequence(i + SHORTEST, F.least(n, i + LONGEST))
    starts = F.when(n >= SHORTEST, F.sequence(F.lit(0), n - SHORTEST))
    each = runs.select("run", F.explode(starts).alias("start")).select("run", "start", F.explode(ends(F.col("start"))).alias("end"))
    each = each.select("run", "start", "end", F.substring("run", F.col("start") + 1, F.col("end") - F.col("start")).alias("piece"))
    return each.join(words.withColumnRenamed("word", "piece"), "piece").select("run", "start", "end", "piece", "n")


def split(runs: DataFrame, model: Model) -> DataFrame:
    """(run, words, cost): each run as one, two or three words, whichever the model finds likeliest.

    The cost of a way is minus the logarithm of its chance: the first word's share of all
    words, then each word's chance behind the one before, or with back-off its share. A run that
    is no known word by itself has the chance of a word of its length. Ties: fewer words, then by
    code points.
    """
    total = float(max(model.total, 1))
    # a word's letters and its place decide who meets: pieces of one run, one ending where the next begins
    known = stored(pieces(runs.where(F.char_length("run") >= LONG), model.words))
    # pairs of words that no run holds are left out before they move
    held = stored(known.select("piece").distinct())
    both_held = stored(model.pairs.join(held.withColumnRenamed("piece", "a"), "a", "left_semi").join(held.withColumnRenamed("piece", "b"), "b", "left_semi"))
    size = F.char_length("run")
    alone = -F.log(F.col("n") / total)
    first = known.where("start = 0").select("run", F.col("end").alias("at"), F.col("piece").alias("last"), F.col("n").alias("last_n"), F.col("piece").alias("words"), alone.alias("cost"))

    def further(ways: DataFrame) -> DataFrame:
        nexts = known.where("start > 0").select("run", F.col("start").alias("at"), "end", "piece", "n")
        pairs = both_held.select(F.col("a").alias("last"), F.col("b").alias("piece"), F.col("n").alias("both"))
        step = F.when(F.col("both").isNotNull(), -F.log(F.col("both") / F.col("last_n"))).otherwise(-F.log(F.lit(BACK_OFF) * F.col("n") / total))
        out = ways.where(F.col("at") < size).join(nexts, ["run", "at"]).join(pairs, ["last", "piece"], "left")
        return out.select("run", F.col("end").alias("at"), F.col("piece").alias("last"), F.col("n").alias("last_n"), F.concat_ws(" ", "words", "piece").alias("words"), (F.col("cost") + step).alias("cost"))

    two = further(first)
    three = further(two)
    whole = runs.join(model.words.withColumnRenamed("word", "run"), "run", "left").select("run", F.col("run").alias("words"), F.coalesce(alone, F.log(F.lit(total) / 10) + size * F.log(F.lit(10.0))).alias("cost"), F.lit(1).alias("k"))
    full = lambda ways, k: ways.where(F.col("at") == size).select("run", "words", "cost", F.lit(k).alias("k"))
    every = whole.union(full(two, 2)).union(full(three, 3)).withColumn("cost", F.round("cost", 6))
    w = W.partitionBy("run").orderBy("cost", "k", "words")
    return every.withColumn("__n", F.row_number().over(w)).where("__n = 1").select("run", "words", "cost")


def unjoin(texts: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """texts with glued words of text put apart; all else stays as it is. Keys are distinct."""
    parts = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(rf"{_RUN}|(?:(?!{_RUN})[\s\S])+"), F.lit(0))
    each = texts.select(key, F.posexplode(parts).alias("pos", "part"))
    ways = split(runs_of(texts, text), model).where("words <> run").select(F.col("run").alias("part"), "words")
    put = each.join(ways, "part", "left").select(key, F.struct("pos", F.coalesce("words", "part").alias("w")).alias("x"))
    out = put.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["w"]), "").alias("__t"))
    return texts.join(out, key, "left").withColumn(text, F.when(F.col(text).isNull(), F.col(text)).otherwise(F.coalesce("__t", F.lit("")))).drop("__t").select(texts.columns)


def glued(text: str = "text") -> Column:
    """Neighbouring words of a text without the space between them; to see what comes back."""
    w = F.regexp_extract_all(F.lower(text), F.lit("[a-z]+"), F.lit(0))
    return F.when(F.size(w) > 1, F.zip_with(F.slice(w, 1, F.size(w) - 1), F.slice(w, F.lit(2), F.size(w) - 1), lambda a, b: F.concat(a, b)))
