"""Quality rules kept as a ledger of failure bits, in DataFrame functions alone.

``ledger`` evaluates every rule once and stores the measurements and one bit a
failed rule.  A policy is a bitmask: a document is kept when it fails no rule of
the mask.  ``ablation`` tells, from the stored bits, how many documents each
rule of a policy rejects, and how many it alone rejects.

Null text has no words and all counts 0, so it fails the base rule; empty text
too.  Repeated rows get a row each.  Extra columns are left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The rules, bit by bit.
RULES = [
    ("few_words", "n_words < 50"),
    ("repeated_words", "100 * n_repeat_words > 50 * n_words"),
    ("symbols", "10 * n_symbols > n_words"),
    ("word_length", "word_chars < 2 * n_words or word_chars > 15 * n_words"),
    ("repeated_lines", "10 * n_dup_lines > 3 * n_lines"),
    ("capitals", "10 * n_capitals > 4 * word_chars"),
    ("exclamations", "5 * n_exclaims > n_words"),
    ("long_repeat", "100 * n_repeat_words > 80 * n_words"),
]
#: Versioned policies, as sums of rule bits.
POLICIES = {"base": 0b11, "v1": 0b1111, "v2": 0b1111111, "v3": 0b11111111}
SPACE = " \t\n\u000b\f\r"


def _count(text: Column, chars: str) -> Column:
    return (F.length(text) - F.length(F.translate(text, chars, ""))).cast("long")


def _words(text: Column) -> Column:
    return F.filter(F.split(text, "[\\x20\\x09-\\x0D]+"), lambda w: w != "")


def _let(value: Column, use) -> Column:
    """use(value), with value worked out once: it is bound as a lambda's variable."""
    return F.transform(F.array(value), use)[0]


def _repeated(words: Column) -> Column:
    """Words within 3-word windows that occur twice or more: sort the windows, keep those equal to a neighbour, join their places."""
    n = F.size(words)
    keys = F.transform(
        F.slice(words, 1, F.greatest(n - 2, F.lit(0))),
        lambda w, i: F.struct(F.xxhash64(w, F.get(words, i + 1), F.get(words, i + 2)).alias("h"), i.alias("i")),
    )
    return F.when(n < 4, F.lit(0)).otherwise(F.aggregate(
        F.array_sort(F.transform(_let(F.sort_array(keys), _twice), lambda x: x["i"])),
        F.struct(F.lit(0).alias("n"), F.lit(-3).alias("last")),
        lambda s, i: F.struct((s["n"] + F.least(i - s["last"], F.lit(3))).alias("n"), i.alias("last")),
        lambda s: s["n"],
    ))


def _twice(keys: Column) -> Column:
    """Entries of a sorted array whose h equals the one before or after."""
    return F.filter(keys, lambda x, i: F.coalesce(F.get(keys, i - 1)["h"] == x["h"], F.lit(False)) | F.coalesce(F.get(keys, i + 1)["h"] == x["h"], F.lit(False)))


def measure(docs: DataFrame) -> DataFrame:
    """doc_id and the measurements that the rules read."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select("doc_id", text.alias("_t")).select(
        "doc_id", "_t", _words(F.col("_t")).alias("_w"),
        F.filter(F.split(F.col("_t"), "\n"), lambda x: F.length(F.translate(x, SPACE, "")) > 0).alias("_l"),
    )
    return rows.select(
        "doc_id",
        F.size("_w").cast("long").alias("n_words"),
        F.length(F.translate("_t", SPACE, "")).cast("long").alias("word_chars"),
        _count(F.col("_t"), "#*$%&|<>").alias("n_symbols"),
        (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long").alias("n_dup_lines"),
        _let(F.col("_w"), _repeated).cast("long").alias("n_repeat_words"),
        F.size("_l").cast("long").alias("n_lines"),
        _count(F.col("_t"), "ABCDEFGHIJKLMNOPQRSTUVWXYZ").alias("n_capitals"),
        _count(F.col("_t"), "!").alias("n_exclaims"),
    )


def ledger(docs: DataFrame) -> DataFrame:
    """The measurements and ``failed``: bit i is set when rule i fails."""
    bits = [F.when(F.expr(rule), F.lit(1 << i)).otherwise(F.lit(0)) for i, (_, rule) in enumerate(RULES)]
    failed = bits[0]
    for b in bits[1:]:
        failed = failed.bitwiseOR(b)
    return measure(docs).withColumn("failed", failed)


def apply_policy(led: DataFrame, policy: str = "v2") -> DataFrame:
    """base_failed and kept, from the bits alone."""
    mask = POLICIES[policy]
    return led.withColumns({
        "base_failed": F.col("failed").bitwiseAND(F.lit(POLICIES["base"])) != 0,
        "kept": F.col("failed").bitwiseAND(F.lit(mask | POLICIES["base"])) == 0,
    })


def ablation(led: DataFrame, policy: str = "v2") -> DataFrame:
    """For each rule of a policy: documents that fail it, and those that only it rejects."""
    mask = POLICIES[policy]
    rules = [(i, name) for i, (name, _) in enumerate(RULES) if mask >> i & 1]
    hit = F.col("failed").bitwiseAND(F.lit(mask))
    sums = led.agg(*[F.sum((hit.bitwiseAND(F.lit(1 << i)) != 0).cast("long")).alias(f"f{i}") for i, _ in rules],
                   *[F.sum((hit == (1 << i)).cast("long")).alias(f"o{i}") for i, _ in rules])
    each = F.array(*[F.struct(F.lit(name).alias("rule"), F.coalesce(F.col(f"f{i}"), F.lit(0)).alias("failed"), F.coalesce(F.col(f"o{i}"), F.lit(0)).alias("only")) for i, name in rules])
    return sums.select(F.explode(each).alias("x")).select("x.*")


def keep_good(docs: DataFrame, policy: str = "v2") -> DataFrame:
    """The documents that a policy keeps, with all their columns: the verdict is worked out in the row, without a join."""
    led = apply_policy(ledger(docs.select(F.struct("*").alias("doc_id"), "text")), policy)
    return led.where("kept").select("doc_id.*")
