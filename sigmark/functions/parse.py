"""Text to values: null tokens, numbers, times, concentrations, assay classes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Tokens that mean no value; names of time units and their hours; units and their micromolar; assay classes by substring, in order.
NULL_TOKENS = ["", "-", "NA", "N/A", "None", "nan"]
TIMES = [("sec second seconds", 1.0 / 3600), ("min minute minutes", 1.0 / 60), ("hr hrs hour hours", 1.0), ("day days", 24.0)]
AMOUNTS = [("m", 1e6), ("mm", 1e3), ("um µm microm micromolar", 1.0), ("nm", 1e-3), ("pm", 1e-6)]
ASSAYS = [
    (["tht", "thioflavin t"], "ThT", True),
    (["ths", "thioflavin s"], "ThS", True),
    (["congo"], "CongoRed", True),
    (["cytoflu"], "Cytofluor", True),
    (["turbid"], "turbidity", False),
    (["light scatter", "scatter", "dls", "sls"], "light_scattering", False),
    (["fluor"], "fluorescence", True),
]
DECIMAL, SCIENTIFIC = r"(-?[0-9]+(?:\.[0-9]+)?)", r"(-?[0-9]+(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?)"
DIGITS, WORD = r"([0-9.]+)\s*", r"([A-Za-z]+)\b"
REDUCERS = r"(?i)\b(DTT|TCEP|BME|mercaptoethanol|glutathione)\b"


def _first(text: Column, pattern: str, group: int = 1) -> Column:
    x = F.regexp_extract(text, pattern, group)
    return F.when(x != "", x)


def clean(text: Column) -> Column:
    t = F.trim(text)
    return F.when(~t.isin(NULL_TOKENS), t)


def _names(groups: list[tuple[str, float]]) -> Column:
    """A map from each name of a group to the group's value."""
    return F.create_map(*[F.lit(x) for names, v in groups for name in names.split() for x in (name, v)])


def parse_hours(text: Column) -> Column:
    """The first number that a word of time follows, in hours."""
    t, known = clean(text), _names(TIMES)
    pairs = F.arrays_zip(F.regexp_extract_all(t, F.lit(DIGITS + WORD), F.lit(1)).alias("n"), F.transform(F.regexp_extract_all(t, F.lit(DIGITS + WORD), F.lit(2)), F.lower).alias("unit"))
    first = F.get(F.filter(pairs, lambda p: F.map_contains_key(known, p["unit"])), F.lit(0))
    return first["n"].try_cast("double") * F.try_element_at(known, first["unit"])


def parse_float(text: Column) -> Column:
    return _first(clean(text), DECIMAL).try_cast("double")


def num(text: Column) -> Column:
    return _first(clean(text), SCIENTIFIC).try_cast("double")


def _cut(text: Column, head: Column) -> Column:
    return F.ltrim(F.substring(text, F.length(head) + 1, F.length(text)))


def _amount(piece: Column) -> Column:
    """{number, unit} of a number and what follows it, up to the next number.

    A unit is the small letters behind the number; the M of molar may stand
    apart from them. A unit that begins with a capital has no small letters, so
    it isn't one.
    """
    number = F.regexp_extract(piece, "^[0-9.]+", 0)
    behind = F.regexp_replace(_cut(piece, number), "^\\s+", "")
    small = F.regexp_extract(behind, "^[a-zµ]+", 0)
    after = F.substring(behind, F.length(small) + 1, F.length(behind))
    gap = F.regexp_extract(after, "^\\s*", 0)
    molar = F.upper(F.substring(after, F.length(gap) + 1, F.lit(1))) == "M"
    unit = F.concat(small, F.when(molar, F.substring(after, F.lit(1), F.length(gap) + 1)).otherwise(""))
    return F.struct(number.alias("number"), F.when(small != "", unit).alias("unit"))


def parse_concentration(text: Column) -> Column:
    """{raw, value_uM, unit} of the first number that a unit follows; '20 M' has no value."""
    raw = clean(text)
    amounts = F.transform(F.regexp_extract_all(raw, F.lit("[0-9.]+[^0-9.]*"), F.lit(0)), _amount)
    first = F.get(F.filter(amounts, lambda a: a["unit"].isNotNull()), F.lit(0))
    factor = F.try_element_at(_names(AMOUNTS), F.lower(F.translate(first["unit"], " ", "")))
    return F.struct(raw.alias("raw"), (first["number"].try_cast("double") * factor).alias("value_uM"), first["unit"].alias("unit"))


def classify_assay(text: Column) -> Column:
    """{name, mass}: the first class with a substring in text; other text keeps its name, mass unknown."""
    raw = clean(text)
    name, mass = raw, F.lit(None).cast("boolean")
    for keys, label, flag in reversed(ASSAYS):
        hit = F.greatest(*[F.lower(raw).contains(k) for k in keys]) if len(keys) > 1 else F.lower(raw).contains(keys[0])
        name, mass = F.when(hit, label).otherwise(name), F.when(hit, flag).otherwise(mass)
    return F.struct(name.alias("name"), mass.alias("mass"))


def endpoint_class(assay: Column) -> Column:
    low = F.lower(assay)
    return F.when(assay.isNull(), "unknown").when(low.contains("tht") | low.contains("ths") | low.contains("congo"), "amyloid").otherwise("generic")


def is_wt(mutant: Column) -> Column:
    t = F.lower(clean(mutant))
    return t.isNull() | t.isin("wt", "wild type", "wild-type", "wildtype")


def drop_sentinel(value: Column, sentinel: float = 10000.0) -> Column:
    return F.when(value < sentinel, value)


def parse_span(text: Column) -> Column:
    part = F.split(text, "-")
    return F.struct(F.get(part, F.lit(0)).try_cast("int").alias("first"), F.get(part, F.lit(1)).try_cast("int").alias("last"))


def reducing_agent(text: Column) -> Column:
    return _first(text, REDUCERS)


def seed(key: Column, base: str) -> Column:
    """A number from a key, the same on every machine: the first 12 hex digits of an md5."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(base), key.cast("string"))), 1, 12), 16, 10).cast("long")


def uniform(key: Column, base: str) -> Column:
    return seed(key, base) / F.lit(float(1 << 48))


def to_scale(x: Column, scale: str) -> Column:
    return F.when(x > 0, F.log10(x)) if scale == "log10" else x


def from_scale(x: Column, scale: str) -> Column:
    return F.pow(F.lit(10.0), x) if scale == "log10" else x


def sd_from_interval(lo: Column, hi: Column) -> Column:
    return F.when(hi > lo, (hi - lo) / (2 * 1.96))


def ref_position(v: Column, lo: float, hi: float, log: bool) -> Column:
    """{position in 0..1, side}: where v stands on a reference scale; side tells that it lies beyond."""
    f = F.log10 if log else (lambda c: c)
    x = (f(v) - f(F.lit(lo))) / (f(F.lit(hi)) - f(F.lit(lo)))
    return F.struct(F.greatest(F.lit(0.0), F.least(F.lit(1.0), x)).alias("position"), F.when(x < 0, "below").when(x > 1, "above").otherwise("in").alias("side"))


def plausible(value: Column, lo: Column, hi: Column) -> Column:
    return F.when(value.isNull(), "missing").when(value < lo, "below_range").when(value > hi, "above_range").otherwise("ok")
