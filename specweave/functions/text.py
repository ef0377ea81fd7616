"""Text functions as column expressions: they stay inside the JVM and its code generation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# What counts as missing, and words that tokenizers leave out.
MISSING = ("", "n/a", "na", "none", "nan", "-")
INDEX_STOPWORDS = tuple("a an the of for and or to in on at by with from as is are be been this that these those its their it into over under per".split())
VOCABULARY_STOPWORDS = tuple(
    "and are but for from had has its not the that their them they this was were with within without into over under per etc such shall may can all any other others "
    "part sec section revision reaffirmed amendment amendments volume".split()
)
OVERLAP_STOPWORDS = tuple("a an and are as at be by for from in is it of on or that the this to was were which will with you".split())
ORDINALS = "first|second|third|fourth|fifth|sixth|seventh|eighth|ninth|tenth|eleventh|twelfth|superseding|reaffirmed"

# Words of letters and digits of any script; combining vowel signs of Indic and Arabic text belong to them.
WORD = r"[\p{L}\p{N}]+(?:[ऀ-෿؀-ۿ][\p{L}\p{N}]*)*"


def _text(c: Column | str) -> Column:
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))


def is_missing(c: Column | str) -> Column:
    return F.lower(F.trim(_text(c))).isin(*MISSING)


def clean_text(c: Column | str) -> Column:
    """One free-text field without placeholders, broken quotes, revision notes and loose separators."""
    t = F.regexp_replace(_text(c), r"\s[?]\s", " - ")
    t = F.regexp_replace(t, "ï¿½|[�`‘’“”]", " ")
    t = F.regexp_replace(t, rf"(?i)\(\s*(?:{ORDINALS})[^)]*\)", " ")
    t = F.replace(t, F.lit("--"), F.lit(" - "))
    t = F.regexp_replace(t, r"\s+", " ")
    return F.when(is_missing(c), F.lit("")).otherwise(F.btrim(t, F.lit(" -:;,")))


def _without(tokens: Column, stop: tuple[str, ...], least: int = 1) -> Column:
    return F.filter(tokens, lambda x: ~x.isin(*stop) & (F.char_length(x) >= least))


def tokens(c: Column | str, stop: tuple[str, ...] = INDEX_STOPWORDS) -> Column:
    """Index tokens in order: lower case, any script, without stopwords and underscores."""
    return _without(F.regexp_extract_all(F.lower(_text(c)), F.lit(WORD), F.lit(0)), stop)


def ascii_tokens(c: Column | str, stop: tuple[str, ...] = (), least: int = 3) -> Column:
    """Runs of a-z and 0-9 of at least so many characters."""
    found = F.regexp_extract_all(F.lower(_text(c)), F.lit("[a-z0-9]+"), F.lit(0))
    return F.filter(found, lambda x: (F.char_length(x) >= least) & (~x.isin(*stop) if stop else F.lit(True)))


def content_words(c: Column | str, stop: tuple[str, ...] = VOCABULARY_STOPWORDS) -> Column:
    """Distinct runs of four or more letters a-z, without stopwords."""
    return F.array_distinct(_without(F.regexp_extract_all(F.lower(_text(c)), F.lit("[a-z]{4,}"), F.lit(0)), stop))


def join_parts(*parts: Column, separator: str = " | ") -> Column:
    """Parts that say something, joined."""
    return F.array_join(F.filter(F.array(*[F.trim(_text(p)) for p in parts]), lambda x: x != ""), separator)


# --- citations ---------------------------------------------------------------------------

# The shape of a citation; number, part, section and year are its groups. A number is taken whole, however long: its
# first five digits would name another standard.
CITATION = (
    r"(?i)\bIS(?:\s*/\s*(?:ISO|IEC|TS|TR|QC|EN))*\s*[:.]?\s*(\d+)"
    r"(?:\s*\(?\s*Part\s*(\d+)\s*\)?)?(?:\s*\(?\s*Sec(?:tion)?\s*(\d+)\s*\)?)?(?:\s*[:\-]\s*((?:19|20)\d{2}))?"
)


def number(digits: Column) -> Column:
    """Digits without leading zeros, however many."""
    return F.regexp_replace(digits, r"^0+(?=\d)", "")


def citations(c: Column | str) -> Column:
    """Base ids that a text cites, in order of appearance, each once."""
    group = lambda i: F.regexp_extract_all(_text(c), F.lit(CITATION), F.lit(i))
    parts = F.arrays_zip(group(1).alias("n"), group(2).alias("p"), group(3).alias("s"))
    name = lambda x: F.concat(
        F.lit("IS "), number(x["n"]),
        F.when(x["p"] != "", F.concat(F.lit(" (Part "), number(x["p"]), F.lit(")"))).otherwise(F.lit("")),
        F.when(x["s"] != "", F.concat(F.lit(" (Sec "), number(x["s"]), F.lit(")"))).otherwise(F.lit("")),
    )
    return F.array_distinct(F.transform(parts, name))


def strip_citations(c: Column | str) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(_text(c), CITATION, " "), r"\s+", " "))


def base_id(c: Column | str) -> Column:
    """Base id of one reference, with "Part p" or "Part p/Sec s"; null for ranges and anything else."""
    pattern = r"(?i)^\s*IS(?:\s*/\s*(?:ISO|IEC|TS|TR|QC|EN))*\s*[:.]?\s*(\d+)(?:\s*\(\s*Part\s*(\d+)(?:\s*/\s*Sec(?:tion)?\s*(\d+))?\s*\))?(?:\s*[:\-]\s*(?:19|20)\d{2})?\s*$"
    n, p, s = (F.regexp_extract(_text(c), pattern, i) for i in (1, 2, 3))
    part = F.when(p == "", "").when(s == "", F.concat(F.lit(" (Part "), number(p), F.lit(")"))).otherwise(F.concat(F.lit(" (Part "), number(p), F.lit("/Sec "), number(s), F.lit(")")))
    return F.when(n != "", F.concat(F.lit("IS "), number(n), part))


def id_parts(c: Column | str) -> Column:
    """(number, part, section) of an identifier, for natural order."""
    t = _text(c)
    first = lambda p: F.when(F.regexp_extract(t, p, 1) != "", F.regexp_extract(t, p, 1).cast("int"))
    return F.struct(first(r"(\d+)").alias("number"), first(r"(?i)Part\s*(\d+)").alias("part"), first(r"(?i)Sec(?:tion)?\s*(\d+)").alias("section"))


def in_family(base: Column, family: Column) -> Column:
    """The family itself or one of its parts."""
    return (base == family) | F.startswith(base, F.concat(family, F.lit(" (")))


# --- other scalars -----------------------------------------------------------------------


def squash(c: Column | str) -> Column:
    """Lower case without the separators that tell "IP 66" from "IP66"."""
    return F.regexp_replace(F.lower(_text(c)), r"[\s\-_/]+", "")


def singular(c: Column | str) -> Column:
    """Plural endings off the last word."""
    t = _text(c)
    low, n = F.lower(t), F.char_length(F.regexp_extract(t, r"(\S*)$", 1))
    return (
        F.when(low.rlike("ies$") & (n > 4), F.regexp_replace(t, r"(?i)ies$", "y"))
        .when(low.rlike("(?:ss|us|is)$"), t)
        .when(low.rlike("(?:ches|shes|xes|ses)$"), F.regexp_replace(t, r"(?i)es$", ""))
        .when(low.rlike("s$") & (n > 3), F.regexp_replace(t, r"(?i)s$", ""))
        .otherwise(t)
    )


def keyphrases(c: Column | str, most: int = 8) -> Column:
    """Stretches between function words, longer than three characters, the first few."""
    parts = F.transform(F.split(_text(c), r"\s+(?:of|for|with|and|in|to)\s+"), lambda x: F.trim(x))
    return F.slice(F.filter(parts, lambda x: F.char_length(x) > 3), 1, most)


def values_of(c: Column | str) -> Column:
    """A field's values: split on commas, slashes, semicolons and "and"."""
    parts = F.filter(F.transform(F.split(_text(c), r"\s*(?:,|/|;|\band\b)\s*"), lambda x: F.trim(x)), lambda x: x != "")
    return F.when(F.size(parts) > 0, parts).otherwise(F.array(F.trim(_text(c))))


def is_table_header(c: Column | str) -> Column:
    """Two to eight words, all of them labels of columns."""
    words = F.regexp_extract_all(F.lower(_text(c)), F.lit("[a-z]+"), F.lit(0))
    return F.size(words).between(2, 8) & F.forall(words, lambda w: w.isin(*HEADER_WORDS))


#: Labels of table columns.
HEADER_WORDS = tuple("sl sr s no nos item items description particulars unit units qty quantity rate amount total of the code sn srno slno remarks".split())


def is_heading(c: Column | str) -> Column:
    """A line that names a part of a document and no product; a line that cites a standard never is one."""
    t = F.trim(_text(c))
    capitals = t.rlike(r"\p{L}") & ~t.rlike(r"[\p{L}&&[^\p{Lu}]]") & (F.size(F.split(t, r"\s+")) <= 10) & ~t.rlike(r"\p{Nd}")
    label = t.rlike(r"(?i)^(?:section|part|annexure|annex|appendix|schedule|chapter)\s+[A-Z0-9]+(?![A-Za-z0-9])")
    return (F.size(citations(t)) == 0) & (t.endswith(":") | label | capitals | is_table_header(t))


def html_to_text(c: Column | str) -> Column:
    """Visible lines of a page: scripts and styles go, block tags end lines, other tags are spaces."""
    t = F.regexp_replace(_text(c), r"(?is)<(script|style)\b.*?</\1\s*>", " ")
    t = F.regexp_replace(t, r"(?i)</?(?:p|div|br|tr|li|h[1-6]|table|ul|ol|article|section|footer|nav)\b[^>]*>", "\n")
    t = F.regexp_replace(t, r"<[^>]*>", " ")
    for name, value in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&copy;", "©"), ("&middot;", "·"), ("&amp;", "&")):
        t = F.replace(t, F.lit(name), F.lit(value))
    lines = F.transform(F.split(t, "\n"), lambda x: F.trim(F.regexp_replace(x, r"[ \t\r\f]+", " ")))
    return F.array_join(F.filter(lines, lambda x: x != ""), "\n")


def title_overlap(title: Column, scope: Column) -> Column:
    """Share of the title's words that the scope has, to three places; 0 for a title without words."""
    n = F.size(title)
    return F.when(n == 0, F.lit(0.0)).otherwise(F.round(F.size(F.array_intersect(title, scope)) / n, 3))


def json_object(c: Column | str) -> Column:
    """The JSON object in a model's answer: a fenced one, else from the first brace to the last."""
    fenced = F.regexp_extract(_text(c), r"(?s)```(?:json)?\s*(\{.*?\})\s*```", 1)
    bare = F.regexp_extract(_text(c), r"(?s)(\{.*\})", 1)
    return F.when(fenced != "", fenced).when(bare != "", bare)


def one_object(json: Column) -> Column:
    """Whether the first brace of a text closes at its very end, quoted text aside: parsers stop there and read no further."""
    braces = F.split(F.regexp_replace(F.regexp_replace(json, r'"(?:[^"\\]|\\.)*"', ""), r"[^{}]", ""), "")
    start = F.struct(F.lit(0).alias("open"), F.lit(0).alias("closed"))
    step = lambda s, x: F.struct((s["open"] + F.when(x == "{", 1).when(x == "}", -1).otherwise(0)).alias("open"), (s["closed"] + F.when((x == "}") & (s["open"] <= 1), 1).otherwise(0)).alias("closed"))
    return F.aggregate(braces, start, step, lambda s: (s["open"] == 0) & (s["closed"] == 1))


def cites_unknown_clause(reason: Column, title: Column) -> Column:
    """Whether a reason names a clause, section or part number that the title does not have."""
    found = F.regexp_extract_all(F.lower(_text(reason)), F.lit(r"\b(?:clause|section|sec|cl)\.?\s*\d+(?:\.\d+)*"), F.lit(0))
    return F.exists(found, lambda x: ~F.contains(F.lower(_text(title)), x))


def short_title(c: Column | str, most: int) -> Column:
    """A title for a small place: without its kind, up to the first dash or colon, cut to fit."""
    t = F.regexp_replace(F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit("")), r"(?i)^(specification|code of practice|methods? of test)\s+for\s+", "")
    t = F.trim(F.get(F.split(t, r"\s[-–—]\s|:\s", 2), F.lit(0)))
    t = F.concat(F.upper(F.substring(t, 1, 1)), t.substr(F.lit(2), F.char_length(t)))
    return F.when(F.char_length(t) > most, F.concat(F.rtrim(F.substring(t, 1, most - 1)), F.lit("…"))).otherwise(t)


def split_number(c: Column | str) -> Column:
    """struct(base, part) of a number without its year: "IS 1 (Part 1) (Sec 2):2019" is IS 1 and (Part 1) (Sec 2)."""
    bare = F.regexp_replace(F.col(c) if isinstance(c, str) else c, r":\d{4}$", "")
    base = F.substring_index(bare, " (", 1)
    return F.struct(base.alias("base"), bare.substr(F.char_length(base) + 2, F.char_length(bare)).alias("part"))
