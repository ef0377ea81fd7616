"""What a procurement line asks for: quantities, product, terms of known lists.

A line is cut into tokens once (numbers, words, signs, with their places). Quantities are
read off the tokens from left to right; the product is what is left of the head of the line
when quantities, numbers, verbs of work and qualities are off.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, replace
from functools import cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Units. Each has its spellings, what it measures, and the field it fills by default.
UNITS = (
    ("L", ("l", "ltr", "ltrs", "litre", "litres", "liter", "liters"), "volume", "capacity"),
    ("ml", ("ml",), "volume", "capacity"),
    ("m3", ("cum", "m3"), "volume", "capacity"),
    ("LPD", ("lpd",), "flow", "capacity"),
    ("LPH", ("lph",), "flow", "capacity"),
    ("m2", ("sqm", "m2"), "area", "area"),
    ("mm", ("mm",), "length", "size"),
    ("cm", ("cm",), "length", "size"),
    ("m", ("m",), "length", "size"),
    ("km", ("km",), "length", "size"),
    ("dia", ("dia",), "length", "diameter"),
    ("DN", ("dn",), "length", "diameter"),
    ("NB", ("nb",), "length", "diameter"),
    ("gauge", ("gauge",), "length", "gauge"),
    ("SWG", ("swg",), "length", "gauge"),
    ("kg", ("kg",), "mass", "weight"),
    ("g", ("g", "gm", "gms"), "mass", "weight"),
    ("t", ("ton", "tonne", "tonnes", "mt"), "mass", "weight"),
    ("kW", ("kw",), "power", "power"),
    ("W", ("w", "watt", "watts"), "power", "power"),
    ("kVA", ("kva",), "power", "power"),
    ("hp", ("hp",), "power", "power"),
    ("V", ("v", "volt", "volts"), "voltage", "voltage"),
    ("kV", ("kv",), "voltage", "voltage"),
    ("A", ("a", "amp", "amps", "ampere", "amperes"), "current", "current"),
    ("Hz", ("hz",), "frequency", "frequency"),
    ("MPa", ("mpa",), "pressure", "pressure"),
    ("bar", ("bar",), "pressure", "pressure"),
    ("psi", ("psi",), "pressure", "pressure"),
    ("kN", ("kn",), "force", "force"),
    ("N", ("n",), "force", "force"),
    ("degC", ("degc",), "temperature", "temperature"),
)
# Words that name a field before a number, and what they measure.
FIELD_WORDS = {
    "capacity": "volume", "volume": "volume", "flow": "flow", "head": "length", "size": "length", "diameter": "length", "dia": "length", "bore": "length", "length": "length",
    "width": "length", "height": "length", "depth": "length", "thickness": "length", "weight": "mass", "mass": "mass", "power": "power", "rating": "power", "voltage": "voltage",
    "current": "current", "pressure": "pressure", "temperature": "temperature", "frequency": "frequency", "speed": "speed",
}
SAME_FIELD = {"dia": "diameter", "bore": "diameter"}
# Words that bound a quantity, from below or above.
AT_LEAST = ("minimum", "min", "at least", "not less than", "no less than", "above")
AT_MOST = ("maximum", "max", "at most", "not more than", "no more than", "up to", "upto", "below", "not exceeding")
# Units that stand before their number, words that count things, words between the ends of a range.
UNIT_FIRST = frozenset(["dn", "nb", "dia", "gauge", "swg"])
COUNTS = frozenset("no nos pcs piece pieces unit units set sets number numbers".split())
BETWEEN = re.compile(r"\s*(?:-|–|to|upto|up\s+to|and)\s*", re.I)
# Keys of "key: value" lines and the list that their values belong to.
KEY_FIELDS = {
    "material": ("material", "moc", "material of construction", "construction", "body material", "metallurgy"),
    "environment": ("installation", "mounting", "location", "environment", "application", "service"),
    "property": ("finish", "coating", "treatment", "protection", "property", "features"),
}
QUANTITY_KEYS = frozenset([*FIELD_WORDS, "load"]) - {"mass"}
PRODUCT_KEYS = frozenset(["product", "item", "description", "item description", "name", "equipment"])
# Verbs that open a line of works, and one that opens an order.
WORK_VERBS = frozenset(
    "providing provision supplying supply laying fixing fitting installing installation erecting erection constructing construction dismantling testing commissioning stacking transporting "
    "carriage conveying lowering jointing refixing relaying".split()
)
ORDER_VERBS = frozenset("procure procurement supply supplying provide provision purchase install installation furnish deliver delivery erect erection of for".split())
# Words that end the head of a line, and words that qualify a product from behind.
ENDS_HEAD = frozenset("of for with and in to as from having conforming confirming complying".split())
ARTICLES = frozenset("the a an all each any".split())
TRAILING = frozenset(
    "grade grades class classes type types series size sizes make model variety quality spec specification thick thickness long length wide width high height deep depth dia diameter nominal bore "
    "duty rated medium heavy light standard".split()
)
# Fixed values: "resistant to X" is "X resistant"; words on how a thing is made say nothing.
TURNED = re.compile(r"\b(?:(?P<quality>resistant|resistance)\s+to|(?P<proof>proof)\s+against)\s+(?P<what>\w+)", re.I)
SAYS_NOTHING = re.compile(r"\b(?:made\s+(?:out\s+)?of\s+|material\s+of\s+construction\b)", re.I)

_UNIT = {s: (unit, measures, field) for unit, spellings, measures, field in UNITS for s in spellings}
_TOKEN = re.compile(r"(?P<number>\d+(?:,\d{2,3})*(?:\.\d+)?)|(?P<word>[A-Za-z]+(?:(?<=\bm)[23]\b)?)|(?P<sign>[^\sA-Za-z\d])")


@dataclass(frozen=True)
class Token:
    kind: str
    text: str
    start: int
    end: int

    @property
    def low(self) -> str:
        return self.text.lower()


@dataclass(frozen=True)
class Quantity:
    value: float
    unit: str
    raw: str
    qualifier: str | None = None
    field: str | None = None
    value_max: float | None = None


@dataclass(frozen=True)
class Measure:
    """A number with a unit where it stands; quantity is None for numbers of standards and counted things."""

    start: int
    end: int
    quantity: Quantity | None


def tokens_of(text: str) -> list[Token]:
    return [Token(m.lastgroup or "", m[0], *m.span()) for m in _TOKEN.finditer(text)]


class Scanner:
    """Reads the quantities of one line, token by token."""

    def __init__(self, text: str) -> None:
        self.text, self.tokens = text, tokens_of(text)

    def _at(self, i: int) -> Token:
        return self.tokens[i] if 0 <= i < len(self.tokens) else Token("", "", len(self.text), len(self.text))

    def _spaced(self, i: int, j: int) -> bool:
        """Whether nothing but white space lies between tokens i and j."""
        return self._at(j).kind != "" and not self.text[self._at(i).end : self._at(j).start].strip()

    def _unit(self, i: int) -> str | None:
        """The unit that token i spells out, if it ends there and opens no initials."""
        t = self._at(i)
        if t.kind != "word" or t.low not in _UNIT or self.text[t.end : t.end + 1].isalnum() or self.text[t.end : t.end + 1] == "_":
            return None
        return None if re.match(r"\s*\.\s*[A-Za-z]", self.text[t.end :]) else t.low

    def _qualifier(self, i: int) -> tuple[str | None, int]:
        """What bounds the number at i, and where that begins: a phrase up to two words before it."""
        for skipped in range(3):
            last = i - 1 - skipped
            if any(self._at(k).kind != "word" or not self._spaced(k, k + 1) for k in range(last, i)) or last < 0:
                break
            for name, phrases in (("minimum", AT_LEAST), ("maximum", AT_MOST)):
                for words in (p.split() for p in phrases):
                    first = last - len(words) + 1
                    if first >= 0 and [t.low for t in self.tokens[first : last + 1]] == words and all(self._spaced(k, k + 1) for k in range(first, last)):
                        return name, self.tokens[first].start
        return None, self._at(i).start

    def _field(self, start: int, spelling: str) -> str:
        """The field that one of the three words before names, if it measures what the unit does; else the unit's own."""
        _, measures, usual = _UNIT[spelling]
        before = [t.low for t in self.tokens if t.end <= start and t.kind == "word"][-3:]
        named = next((w for w in reversed(before) if w in FIELD_WORDS), None)
        return SAME_FIELD.get(named, named) if named and FIELD_WORDS[named] == measures else usual

    def measures(self) -> Iterator[Measure]:
        i = 0
        while i < len(self.tokens):
            t = self.tokens[i]
            after, top = i + 1, None
            if t.kind == "number" and (self._at(after).text == "-" or self._at(after).low in ("to", "and")) and self._at(after + 1).kind == "number" and self._unit(after + 2):
                after, top = after + 2, self._at(after + 1).text
            spelling = self._unit(after) if t.kind == "number" and self._spaced(after - 1, after) else None
            if spelling is None:
                i += 1
                continue
            qualifier, start = self._qualifier(i)
            end = self._at(after).end
            unit = _UNIT[spelling][0]
            near = self.text[max(0, start - 12) : end + 12]
            cited = re.search(r"\bIS\s*[:/]?\s*$", self.text[: t.start], re.I)
            counted = unit in ("m", "A") and any(x.low in COUNTS for x in tokens_of(near))
            q = Quantity(_number(t.text), unit, self.text[start:end].strip(), qualifier, self._field(start, spelling), _number(top) if top else None)
            yield Measure(start, end, None if cited or counted else q)
            i = after + 1

    def unit_first(self) -> Iterator[Measure]:
        for i, t in enumerate(self.tokens):
            value = self._at(i + 1)
            whole = not self.text[max(0, t.start - 1) : t.start].isalnum() and not self.text[value.end : value.end + 1].isalnum()
            if t.kind == "word" and t.low in UNIT_FIRST and value.kind == "number" and self._spaced(i, i + 1) and whole:
                unit, _, usual = _UNIT[t.low]
                yield Measure(t.start, value.end, Quantity(_number(value.text), unit, self.text[t.start : value.end], None, usual))


def _number(text: str) -> float:
    return float(text.replace(",", ""))


def quantities(text: str | None) -> list[Quantity]:
    """Numbers with units, with qualifier, field and range: a rising number of the same unit after "to" or the like is the range's end."""
    line = Scanner(text or "")
    found = [m for m in line.measures() if m.quantity]
    raws = {m.quantity.raw for m in found if m.quantity}
    found += [m for m in line.unit_first() if m.quantity and m.quantity.raw not in raws]
    out: list[Measure] = []
    for m in found:
        low, q = (out[-1].quantity, m.quantity) if out else (None, m.quantity)
        between = line.text[out[-1].end : m.start] if out else ""
        if low and q and low.unit == q.unit and low.value_max is None and q.value > low.value and BETWEEN.fullmatch(between):
            out[-1] = Measure(out[-1].start, m.end, replace(low, value_max=q.value, raw=low.raw + between + q.raw))
        else:
            out.append(m)
    return [m.quantity for m in out if m.quantity]


def rephrase(text: str) -> str:
    """Qualities before what they are of, and no words on making."""
    turned = TURNED.sub(lambda m: f"{m['what']} {m['quality'] or m['proof']}", text)
    return " ".join(SAYS_NOTHING.sub(" ", turned).split())


def singular(phrase: str) -> str:
    """The phrase with its last word in the singular."""
    *rest, last = phrase.split() or [""]
    low = last.lower()
    if low.endswith("ies") and len(last) > 4:
        last = f"{last[:-3]}y"
    elif low.endswith(("ches", "shes", "xes", "ses")):
        last = last[:-2]
    elif low.endswith("s") and len(last) > 3 and not low.endswith(("ss", "us", "is")):
        last = last[:-1]
    return " ".join([*rest, last])


def _unmeasured(text: str) -> str:
    """The line without quantities, counts of things and numbers."""
    line, out, at = Scanner(text), [], 0
    spans = [(m.start, m.end) for m in line.measures()]
    for i, t in enumerate(line.tokens):
        if t.kind == "number" and not any(a <= t.start < b for a, b in spans):
            alone = not text[max(0, t.start - 1) : t.start].isalnum()
            follows = line._at(i + 1)
            if alone and line._spaced(i, i + 1) and follows.low in COUNTS:
                spans.append((t.start, follows.end))
            elif alone and not text[t.end : t.end + 1].isalnum():
                spans.append((t.start, t.end))
    for a, b in sorted(spans):
        out.append(text[at:a])
        at = max(at, b)
    return " ".join(" ".join([*out, text[at:]]).split()).strip(" ,.-:;/")


def _opened(words: list[str]) -> int:
    """How many words (and signs) at the start are verbs of work or of order, and what belongs to them."""
    i = verbs = 0
    while verbs < 4 and i < len(words) and words[i].lower() in WORK_VERBS:
        verbs, i = verbs + 1, i + 1
        while i < len(words) - 1 and words[i].lower() in (",", "&", "and"):
            i += 1
    if verbs:
        while i < len(words) and words[i].lower() in ("of", "the"):
            i += 1
    if i < len(words) and words[i].lower() in ORDER_VERBS:
        i += 1
        while i < len(words) and words[i].lower() in (":", "of"):
            i += 1
    return i


def product(text: str | None, attributes: list[str] | None = None) -> str | None:
    """What a line asks for, in at most five words, the last in the singular."""
    words = re.findall(r"[,;:&]|[^\s,;:&]+", _unmeasured(rephrase(text or "")))
    words = words[_opened(words) :]
    head: list[str] = []
    for i, w in enumerate(words):
        if w in (",", ";", ":") or i and w in ENDS_HEAD:
            break
        head.append(w)
    if head and len(head) > 1 and head[0].lower() in ARTICLES:
        head = head[1:]
    qualities = sorted((a.lower().split() for a in attributes or []), key=lambda a: -len(" ".join(a)))
    while lead := next((a for a in qualities if a and [w.lower().strip(",-") for w in head[: len(a)]] == a), None):
        head = head[len(lead) :]
    named = [w for w in (x.strip(" ,.-:;/") for x in head[:5]) if w]
    while named and (named[-1].lower() in TRAILING or any(c.isdigit() for c in named[-1]) or len(named[-1]) <= 2):
        named.pop()
    return singular(" ".join(named)) if named else None


@cache
def _known(vocabulary: tuple[str, ...]) -> re.Pattern:
    return re.compile(rf"(?<![A-Za-z0-9])(?:{'|'.join(map(re.escape, sorted(vocabulary, key=lambda w: (-len(w), w))))})(?![A-Za-z0-9])")


def terms_in(text: str | None, vocabulary: list[str]) -> list[str]:
    """Known terms in order of appearance, longest first where they overlap, each once."""
    return list(dict.fromkeys(_known(tuple(vocabulary)).findall((text or "").lower()))) if vocabulary else []


def requirements(text: str | None, pairs: list[tuple[str, str]] | None = None, gazetteer: dict[str, list[str]] | None = None) -> dict:
    """product, material, property, environment, quantities and unmapped of a line and its "key: value" pairs.

    A key says which list its value belongs to; terms of the reviewed lists are added from the
    line; quantities come from it where no pair has any. What neither names a field nor holds
    a quantity stays as it was typed, in unmapped.
    """
    lists = {k: (gazetteer or {}).get(k, []) for k in KEY_FIELDS}
    of_key = {key: name for name, keys in KEY_FIELDS.items() for key in keys}
    out: dict = {"product": None, **{k: [] for k in lists}, "quantities": [], "unmapped": []}
    named = None
    for key, value in pairs or []:
        low = key.strip().lower()
        if low in PRODUCT_KEYS:
            named = named or value
        elif low in of_key:
            out[of_key[low]] += [v.strip() for v in re.split(r",|/|;|\band\b", value) if v.strip()] or [value.strip()]
        elif got := quantities(f"{low} {value}"):
            out["quantities"] += [replace(q, field=SAME_FIELD.get(low, low)) if low in QUANTITY_KEYS else q for q in got]
        elif low not in QUANTITY_KEYS:
            out["unmapped"].append(f"{key.strip()}: {value}")
    line = rephrase(text or "")
    for name, known in lists.items():
        has = {x.lower() for x in out[name]}
        out[name] += [t for t in terms_in(line, known) if t not in has]
    out["quantities"] = out["quantities"] or quantities(line)
    out["product"] = product(named or line, [*out["material"], *out["property"], *out["environment"]])
    return out


# --- column forms ------------------------------------------------------------------------

QUANTITY = "struct<value:double,unit:string,raw:string,qualifier:string,field:string,value_max:double>"


def quantity_items(text: Column) -> Column:
    @F.pandas_udf(f"array<{QUANTITY}>")
    def read(t: pd.Series) -> pd.Series:
        return t.map(lambda x: [q.__dict__ for q in quantities(x)])

    return read(text)


def product_column(text: Column, attributes: list[str] | None = None) -> Column:
    @F.pandas_udf("string")
    def name(t: pd.Series) -> pd.Series:
        return t.map(lambda x: product(x, attributes))

    return name(text)


def requirement_column(text: Column, pairs: Column, gazetteer: dict[str, list[str]]) -> Column:
    """pairs: array of struct(k, v)."""

    @F.pandas_udf(f"struct<product:string,material:array<string>,property:array<string>,environment:array<string>,quantities:array<{QUANTITY}>,unmapped:array<string>>")
    def read(t: pd.Series, p: pd.Series) -> pd.DataFrame:
        rows = [requirements(x, [(k["k"], k["v"]) for k in (y if y is not None else [])], gazetteer) for x, y in zip(t, p, strict=True)]
        return pd.DataFrame([{**r, "quantities": [q.__dict__ for q in r["quantities"]]} for r in rows], columns=["product", "material", "property", "environment", "quantities", "unmapped"])

    return read(text, pairs)
