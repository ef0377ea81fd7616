"""Scripts, digits and language as column expressions."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: First code points of decimal digit blocks besides ASCII: built from the Unicode database.
DIGIT_ZEROS = tuple(c for c in range(0x0660, 0xFF20) if unicodedata.decimal(chr(c), -1) == 0 and all(unicodedata.decimal(chr(c + i), -1) == i for i in range(10)))
SCRIPTS = ("Latin", "Devanagari", "Bengali", "Gurmukhi", "Gujarati", "Oriya", "Tamil", "Telugu", "Kannada", "Malayalam", "Sinhala", "Arabic", "Ol_Chiki", "Meetei_Mayek", "Cyrillic", "Greek", "Thai", "Hiragana", "Katakana", "Hangul", "Han")
#: Scripts that one language stands for.
BY_SCRIPT = {
    "Gurmukhi": "pan_Guru", "Gujarati": "guj_Gujr", "Oriya": "ory_Orya", "Tamil": "tam_Taml", "Telugu": "tel_Telu", "Kannada": "kan_Knda", "Malayalam": "mal_Mlym", "Sinhala": "sin_Sinh",
    "Ol_Chiki": "sat_Olck", "Meetei_Mayek": "mni_Beng", "Cyrillic": "rus_Cyrl", "Greek": "ell_Grek", "Thai": "tha_Thai", "Hiragana": "jpn_Jpan", "Katakana": "jpn_Jpan", "Hangul": "kor_Hang", "Han": "zho_Hans",
}
#: Words that tell languages of one script apart; the first of a script is the usual one.
MARKERS = {
    "Devanagari": {
        "hin_Deva": "है हैं का की के को लिये लिए और में नहीं होगा क्या इस उस वाला".split(), "mar_Deva": "आहे आणि साठी च्या ची चे मध्ये नाही पाहिजे असलेल्या".split(), "npi_Deva": "छ छन् लागि र पर्छ गर्ने भयो".split(),
        "san_Deva": "अस्ति च इति भवति एव तथा".split(), "mai_Deva": "अडि अछि लेल केँ".split(), "gom_Deva": "आसा आनी खातीर जाल्यार".split(), "brx_Deva": "आरो थाखाय बुं गोनां".split(), "doi_Deva": "हैगा गीं देंदे".split(),
    },
    "Bengali": {"ben_Beng": "আর করা হবে জন্য আছে এবং নয় কি".split(), "asm_Beng": "আৰু হয় কৰি লাগিব আছে".split(), "mni_Beng": "অমসুং মখোয় কোয় ওইরিবা".split()},
    "Arabic": {"urd_Arab": "ہے کے اور کۓ کا کی لیہ میں چاہیے".split(), "snd_Arab": "اڳي جي هتي احم".split(), "pes_Arab": "است برای و می‌شود".split(), "arb_Arab": "هو ذلك في من على".split()},
    "Latin": {
        "fra_Latn": "le la les des une pour avec dans est sont doit nous vous cette".split(), "spa_Latn": "el la los las una para con del que son debe este esta".split(), "por_Latn": "o a os as uma para com dos que sao deve este esta nao".split(),
        "deu_Latn": "der die das und mit fur ist sind muss eine einen nicht".split(), "ind_Latn": "dan yang untuk dengan adalah harus ini itu dari pada".split(), "vie_Latn": "va cua cho voi la phai nay khong trong duoc".split(),
        "swh_Latn": "na ya kwa katika ni lazima hii hiyo ajili".split(),
    },
}
#: Letters that one language of a script has and its neighbours have not, and how sure they make.
LETTERS = {"Bengali": (("asm_Beng", "ৰৱ", 0.9),), "Arabic": (("snd_Arab", "ٻڀٿٽڦڻڱڳڇڄ", 0.85), ("kas_Arab", "ۆۄݜٲٳ", 0.8))}
#: How sure a script makes of its usual language without a marker word, with one, for each more, and at most.
SURE = {"Devanagari": (0.7, 0.75, 0.1, 0.95), "Bengali": (0.75, 0.8, 0.1, 0.95), "Arabic": (0.6, 0.75, 0.1, 0.9)}
#: What one word of another language than Hindi is worth in Devanagari, a script of one language, no letters at all, other languages in Latin letters, English with and without its words.
ONE_WORD, ONE_LANGUAGE, NOTHING, OTHER_LATIN, ENGLISH, MAYBE_ENGLISH = 0.6, 0.95, 0.3, 0.55, 0.8, 0.6
#: Languages of other scripts in Latin letters, and words of English.
ROMANISED = {
    "hin_Deva": (
        "ka ki ke kaa kii liye lie hai hain hei hona hoga chahiye chahiyay chaahiye aur ya se mein kya kyon kaise kitna kitne kitni nahi nahin yeh woh wala wali wale iske uske jarurat zaroorat jaruri "
        "zaroori banane banwana lagana kharidna khareedna saman samagri kaam sariya gitti balu reti bijli paani tanki makan dukan sadak chhota bada naya purana accha achha behtar sasta mehenga"
    ).split(),
    "mar_Deva": "aahe ahe aani ani sathi saathi chya chi che madhe nahi pahije paahije asleli karaycha havi hava lagnar".split(),
    "ben_Beng": "ache achhe ebong jonno korte hobe amar tomar kintu tahole khub bhalo lagbe dorkar".split(),
}
ENGLISH_WORDS = (
    "the a an and or of for with to in on at by from as is are be been shall must should will not no any each per than that this these those it its their there required supply supplied provide "
    "provided make made used using type grade"
).split()
#: What parts words; marks of vowels do not.
BETWEEN = r"""[\s,;:.()\[\]/\\|"'!?%+*=<>@#&~`{}^_–—-]+"""
TELLING = sorted({w for table in (*MARKERS.values(), ROMANISED, {"eng_Latn": ENGLISH_WORDS}) for words in table.values() for w in words})
DEFAULTS = {"Devanagari": "hin_Deva", "Bengali": "ben_Beng", "Arabic": "urd_Arab", "Latin": "eng_Latn"}
PRESENT = 0.10


def _text(c: Column | str) -> Column:
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))


def fold_digits(c: Column | str) -> Column:
    """Digits of all scripts as ASCII digits."""
    return F.translate(_text(c), "".join(chr(z + i) for z in DIGIT_ZEROS for i in range(10)), "0123456789" * len(DIGIT_ZEROS))


def normalise(c: Column | str) -> Column:
    """Composed characters and ASCII digits. Only texts with marks or other characters that may compose go to Python."""

    @F.pandas_udf("string")
    def nfc(t: pd.Series) -> pd.Series:
        return t.map(lambda x: unicodedata.normalize("NFC", x))

    # the composed form of a text up to U+02FF is the text itself
    return F.when(fold_digits(c).rlike(r"[^\x{0000}-\x{02FF}]"), nfc(fold_digits(c))).otherwise(fold_digits(c))


def letters(c: Column | str) -> Column:
    return F.regexp_count(_text(c), F.lit(r"\p{L}"))


def script_share(c: Column | str, script: str) -> Column:
    """Share of letters in a script; 0 for texts without letters."""
    n = letters(c)
    return F.when(n == 0, F.lit(0.0)).otherwise(F.regexp_count(_text(c), F.lit(rf"[\p{{L}}&&\p{{Is{script}}}]")) / n)


def non_latin_share(c: Column | str) -> Column:
    """Share of letters beyond the Latin blocks (above U+024F)."""
    n = letters(c)
    return F.when(n == 0, F.lit(0.0)).otherwise(F.regexp_count(_text(c), F.lit(r"[\p{L}&&[^\x{0000}-\x{024F}]]")) / n)


def _tokens(c: Column | str) -> Column:
    return F.filter(F.split(F.lower(_text(c)), BETWEEN), lambda x: x != "")


def _hits(tokens: Column, words: list[str] | tuple[str, ...]) -> Column:
    return F.size(F.filter(tokens, lambda x: x.isin(*words)))


def _let(value: Column, use) -> Column:
    """use(value) with value worked out once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _script(c: Column | str) -> Column:
    """The strongest script besides Latin if it has a share worth naming; texts within Latin blocks are not counted."""
    shares = F.array(*[F.struct(script_share(c, s).alias("share"), F.lit(s).alias("script")) for s in SCRIPTS if s != "Latin"])
    strongest = _let(F.array_max(shares), lambda x: F.when(x["share"] >= PRESENT, x["script"]).otherwise("Latin"))
    return F.when(_text(c).rlike(r"[\p{L}&&[^\x{0000}-\x{024F}]]"), strongest).otherwise("Latin")


FOUND = "struct<code:string,confidence:double,method:string,script:string,romanised:boolean>"


def _found(code: Column | str, confidence: Column | float, method: str, script: str, romanised: bool = False) -> Column:
    lit = lambda x: x if isinstance(x, Column) else F.lit(x)
    return F.struct(lit(code).alias("code"), F.round(lit(confidence), 6).alias("confidence"), F.lit(method).alias("method"), F.lit(script).alias("script"), F.lit(romanised).alias("romanised"))


def _most_hits(tokens: Column, table: dict[str, list[str]]) -> Column:
    """struct(n, order, code): the language with most marker words, of equal ones the first of the table."""
    return F.array_max(F.array(*[F.struct(_hits(tokens, w).alias("n"), F.lit(-i).alias("order"), F.lit(code).alias("code")) for i, (code, w) in enumerate(table.items())]))


def _of_script(script: str, text: Column, tokens: Column) -> Column:
    """A language of a script that several share: by letters of its own, else by marker words, else the usual one."""
    usual, (none, one, more, most) = DEFAULTS[script], SURE[script]

    def by_words(x: Column) -> Column:
        sure = _found(x["code"], F.least(one + more * (x["n"] - 1), F.lit(most)), "script+markers", script)
        out = F.when(x["n"] == 0, _found(usual, none, "script", script))
        if script == "Devanagari":  # words this short: a single one does not outweigh the usual language
            out = out.when((x["n"] == 1) & (x["code"] != usual), _found(usual, ONE_WORD, "script", script))
        return out.otherwise(sure)

    found = _let(_most_hits(tokens, MARKERS[script]), by_words)
    for code, own, confidence in reversed(LETTERS.get(script, ())):
        found = F.when(text.rlike(f"[{own}]"), _found(code, confidence, "script+markers", script)).otherwise(found)
    return found


def _of_latin(tokens: Column, n: Column) -> Column:
    """English, another language in Latin letters, or one of another script that is written in them; n: words in all."""

    def choose(x: Column) -> Column:
        roman, other = x["roman"], x["other"]
        enough = ((roman["n"] >= 2) | ((roman["n"] == 1) & (n <= 6))) & (roman["n"] >= x["english"])
        return (
            F.when(n == 0, _found("eng_Latn", NOTHING, "default", "Latin"))
            .when(enough, _found(roman["code"], F.least(0.45 + roman["n"] / n, F.lit(0.8)), "romanised", "Latin", True))
            .when((other["n"] >= 2) & (other["n"] > x["english"]), _found(other["code"], OTHER_LATIN, "script+markers", "Latin"))
            .otherwise(_found("eng_Latn", F.when(x["english"] > 0, ENGLISH).otherwise(MAYBE_ENGLISH), "script", "Latin"))
        )

    return _let(F.struct(_most_hits(tokens, ROMANISED).alias("roman"), _most_hits(tokens, MARKERS["Latin"]).alias("other"), _hits(tokens, ENGLISH_WORDS).alias("english")), choose)


def detection(c: Column | str, declared: Column | None = None) -> Column:
    """struct(code, confidence, method, script, romanised) of a text.

    A declared code that is known wins; then the strongest script besides Latin with a tenth of all
    letters, its languages told apart by their own letters and by marker words; then words in
    Latin letters. method: declared, script, script+markers, romanised or default.
    """

    def choose(x: Column) -> Column:
        one = F.create_map(*[F.lit(v) for kv in BY_SCRIPT.items() for v in kv])[x["script"]]
        out = _of_latin(x["tokens"], x["n"])
        for script in SURE:
            out = F.when(x["script"] == script, _of_script(script, x["text"], x["tokens"])).otherwise(out)
        single = F.struct(one.alias("code"), F.lit(ONE_LANGUAGE).alias("confidence"), F.lit("script").alias("method"), x["script"].alias("script"), F.lit(False).alias("romanised"))
        return F.when(one.isNotNull(), single).when(~x["text"].rlike(r"\p{L}"), _found("eng_Latn", NOTHING, "default", "Latin")).otherwise(out)

    # tables are looked up for words that stand in any of them, which are few
    told = lambda t: F.struct(_script(c).alias("script"), F.filter(t, lambda w: w.isin(*TELLING)).alias("tokens"), F.size(t).alias("n"), _text(c).alias("text"))
    found = _let(_let(_tokens(c), told), choose)
    if declared is None:
        return found
    named = F.struct(declared.alias("code"), F.lit(1.0).alias("confidence"), F.lit("declared").alias("method"), F.lit(None).cast("string").alias("script"), F.lit(False).alias("romanised"))
    return F.when(declared.isNotNull(), named).otherwise(found)


def detect(c: Column | str, declared: Column | None = None) -> Column:
    """struct(code, method): what detection() finds, Hindi in Latin letters as a language of its own; by script, by words or declared."""
    kind = lambda x: F.when(x["method"] == "declared", "declared").when(x["script"] == "Latin", "words").otherwise("script")
    code = lambda x: F.when(x["romanised"], F.concat(F.substring(x["code"], 1, 3), F.lit("_Latn"))).otherwise(x["code"])
    return _let(detection(c, declared), lambda x: F.struct(code(x).alias("code"), kind(x).alias("method")))


def reconcile(declared: Column, transcript: Column, guess: Column) -> Column:
    """Language of a transcript: declared, else by its script or words, else the recogniser's guess."""
    found = _let(detect(transcript), lambda x: F.when((x["method"] == "script") | x["code"].isin(*[f"{k[:3]}_Latn" for k in ROMANISED]), x["code"]))
    return F.struct(F.coalesce(declared, found, guess, F.lit("eng_Latn")).alias("code"), (F.coalesce(declared, found) != guess).alias("mismatch"))
