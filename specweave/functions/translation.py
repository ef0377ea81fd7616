"""Languages around retrieval: registry, glossary, translators behind a callable, localisation."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import language, notation

#: Code, short code where there is one, name.
LANGUAGES = (
    ("eng_Latn", "en", "english"), ("asm_Beng", "as", "assamese"), ("ben_Beng", "bn", "bengali"), ("brx_Deva", None, "bodo"), ("doi_Deva", None, "dogri"), ("gom_Deva", "kok", "konkani"),
    ("guj_Gujr", "gu", "gujarati"), ("hin_Deva", "hi", "hindi"), ("kan_Knda", "kn", "kannada"), ("kas_Arab", "ks", "kashmiri"), ("mai_Deva", None, "maithili"), ("mal_Mlym", "ml", "malayalam"),
    ("mni_Beng", None, "manipuri"), ("mar_Deva", "mr", "marathi"), ("npi_Deva", "ne", "nepali"), ("ory_Orya", "or", "odia"), ("pan_Guru", "pa", "punjabi"), ("san_Deva", "sa", "sanskrit"),
    ("sat_Olck", None, "santali"), ("snd_Arab", "sd", "sindhi"), ("tam_Taml", "ta", "tamil"), ("tel_Telu", "te", "telugu"), ("urd_Arab", "ur", "urdu"),
    ("arb_Arab", "ar", "arabic"), ("deu_Latn", "de", "german"), ("fra_Latn", "fr", "french"), ("ind_Latn", "id", "indonesian"), ("jpn_Jpan", "ja", "japanese"), ("kor_Hang", "ko", "korean"),
    ("pes_Arab", "fa", "persian"), ("por_Latn", "pt", "portuguese"), ("rus_Cyrl", "ru", "russian"), ("spa_Latn", "es", "spanish"), ("swh_Latn", "sw", "swahili"), ("tha_Thai", "th", "thai"),
    ("vie_Latn", "vi", "vietnamese"), ("zho_Hans", "zh", "chinese (simplified)"),
)
RTL = ("urd_Arab", "snd_Arab", "kas_Arab", "arb_Arab", "pes_Arab")
PREFIX = 4


def resolve_language(c: Column) -> Column:
    """Code of a code, short code or name; else of what stands before "_" or "-"; else null."""
    known = {k: code for code, short, name in LANGUAGES for k in (code.lower(), short, name, code[:3]) if k}
    table = F.create_map(*[F.lit(x) for kv in known.items() for x in kv])
    low = F.lower(F.trim(c))
    return F.coalesce(table[low], table[F.regexp_extract(low, r"^([^_-]+)[_-]", 1)])


def glossary_hits(texts: DataFrame, glossary: DataFrame, key: str = "id") -> DataFrame:
    """(key, term, english) of glossary terms in texts (key, lang, text): a word, the beginning of one from four letters on, or a phrase.

    Words and beginnings join by equality: a token offers itself and its beginnings.
    """
    tokens = F.filter(F.split(F.lower("text"), r"[\s\p{P}\p{S}]+"), lambda x: x != "")
    t = texts.select(key, "lang", tokens.alias("t"))
    each = t.select(key, "lang", F.explode("t").alias("w"))
    longest = F.greatest(F.char_length("w"), F.lit(PREFIX))
    starts = each.select(key, "lang", F.explode(F.array_union(F.array("w"), F.transform(F.sequence(F.lit(PREFIX), longest), lambda n: F.substring(F.col("w"), F.lit(1), n)))).alias("term")).distinct()
    words = starts.join(glossary.where("instr(term, ' ') = 0"), ["lang", "term"])
    # phrases are found by their first word
    phrases = glossary.where("instr(term, ' ') > 0").withColumn("w", F.substring_index("term", " ", 1))
    joined = F.concat(F.lit(" "), F.array_join("t", " "), F.lit(" "))
    long_ = t.select(key, "lang", joined.alias("j"), F.explode(F.array_distinct("t")).alias("w")).join(phrases, ["lang", "w"]).where(F.contains("j", F.concat(F.lit(" "), F.col("term"), F.lit(" "))))
    return words.select(key, "term", "english").union(long_.select(key, "term", "english")).distinct()


def augment(queries: DataFrame, hits: DataFrame, key: str = "id", query: str = "query") -> DataFrame:
    """queries with the glossary's English words appended that they lack, each once."""
    words = hits.groupBy(key).agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("term", "english"))), lambda x: F.split(x["english"], r"\s+"))).alias("extra"))
    out = queries.join(words, key, "left")
    have = F.regexp_extract_all(F.lower(query), F.lit("[a-z0-9]+"), F.lit(0))
    new = F.filter(F.array_distinct(F.coalesce("extra", F.array().cast("array<string>"))), lambda x: ~F.array_contains(have, F.lower(x)))
    return out.withColumn(query, F.trim(F.concat_ws(" ", query, F.array_join(new, " ")))).drop("extra")


def classify(c: Column, enabled: bool = True) -> Column:
    """struct(code, note): note says why a text needs no model, and is null if it does."""
    code = language.detect(c)["code"]
    bare = F.regexp_replace(c, "|".join(f"(?:{p.replace('(?i)', '')})" for _, p in notation.SHAPES[:4]), "")
    note = (
        F.when(code == "eng_Latn", "already English").when(code.isin(*[f"{k[:3]}_Latn" for k in language.ROMANISED]), "romanised").when(F.lit(not enabled), "translation disabled").when(~bare.rlike(r"\p{L}"), "notation only")
    )
    return F.struct(code.alias("code"), note.alias("note"))


Backend = Callable[[list[str], str], Iterable[str]]


def translate(texts: DataFrame, model: Backend | Sequence[Backend] | None, text: str = "text", enabled: bool = True) -> DataFrame:
    """texts with english, code, engine and note. A model sees prose without notation, a batch a language.

    Models are asked in order, each for what those before it left open. Each distinct text
    is translated once. One that fails or says nothing leaves the text as it is; nothing raises.
    """
    models = [] if model is None else [model] if callable(model) else list(model)
    need = texts.select(F.coalesce(text, F.lit("")).alias("t")).distinct().withColumn("c", classify(F.col("t"), enabled and bool(models)))

    def run(batches):
        for b in batches:
            english, engine, note = b["t"].tolist(), ["none"] * len(b), b["note"].tolist()
            for code, part in b[b["note"].isna()].groupby("code"):
                open_ = {b.index.get_loc(i): notation.Notation(t, notation.LIFTED) for i, t in part["t"].items()}
                for ask in models:
                    try:
                        got, why = list(ask([n.prose() for n in open_.values()], code)), "translator gave nothing"
                    except Exception as e:  # a translator's failure must not cost the query
                        got, why = [], f"translator failed: {type(e).__name__}"
                    for (k, n), said in zip(list(open_.items()), [*got, *[""] * (len(open_) - len(got))], strict=False):
                        if said:
                            english[k], engine[k], note[k] = n.behind(said), "model", None
                            del open_[k]
                        else:
                            note[k] = why
                    if not open_:
                        break
            yield pd.DataFrame({"t": b["t"], "code": b["code"], "english": english, "engine": engine, "note": note})

    done = need.select("t", "c.code", "c.note").mapInPandas(run, "t string, code string, english string, engine string, note string")
    return texts.join(done, F.coalesce(F.col(text), F.lit("")) == F.col("t"), "left").drop("t")


def localise(labels: DataFrame, curated: DataFrame, target: str, key: str = "label") -> DataFrame:
    """labels with text in the target language where a curated label exists, and whether it reads right to left."""
    side = curated.where(F.col("lang") == target).select(F.col("label").alias(key), F.col("text").alias("localized"))
    side = side.withColumn("n", F.row_number().over(W.partitionBy(key).orderBy("localized"))).where("n = 1").drop("n")
    return labels.join(side, key, "left").withColumn("localized", F.coalesce("localized", key)).withColumn("rtl", F.lit(target in RTL))
