"""Quality rules as a ledger: every rule is evaluated once and leaves one failure bit.

`ledger` adds the measurements and `failed_bits` to each document, `stored` keeps that as a table; policies are masks over the
bits, so a new policy version, or the question what one rule alone rejects, reads only the table and never the texts again.

Nulls and edges: a null text counts as an empty one (no words, fails `few_words`). Empty tables give empty results. Every row
of the input gives one row of the output, repeated rows and null ids included. Other columns of the input are not touched;
only `doc_id` and `text` are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.llm.common import SHINGLE, SPACES, WORD, fresh, once, settle, windows, words

SYMBOLS = "#*$%&|<>"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()

#: Rule name -> failure as a condition on the measurements. The position of a rule is its bit and never changes; add at the end.
RULES: dict[str, str] = {
    "few_words": "n_words < 10",
    "repeated_words": "100 * n_repeat_words > 20 * n_words",
    "symbols": "10 * n_symbols > 3 * n_words",
    "repeated_lines": "100 * n_dup_lines > 30 * n_lines",
    "short_words": "word_chars < 2 * n_words",
    "long_words": "word_chars > 15 * n_words",
    "shouting": "2 * n_upper > n_upper + n_lower",
    "stutter": "100 * n_stutter > 30 * n_words",
}
BIT = {name: 1 << i for i, name in enumerate(RULES)}
BASE = BIT["few_words"] | BIT["repeated_words"]

#: Policy version -> mask of the rules that reject.
POLICIES: dict[str, int] = {
    "base": BASE,
    "v1": BASE | BIT["symbols"] | BIT["repeated_lines"],
    "v2": sum(BIT.values()),
}
CURRENT = "v2"
MEASURES = ["n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_upper", "n_lower", "n_stutter"]


def _count(text: Column, characters: str) -> Column:
    """How many characters of `text` are among `characters`."""
    return F.length(text) - F.length(F.translate(text, characters, ""))


def _repeat_words(df: DataFrame, ws: str, private) -> tuple[DataFrame, Column]:
    """Adds what the number of words in repeated windows needs, and gives that number.

    Where all windows differ, nothing repeats. Otherwise the windows are sorted by hash and place, equal neighbours are
    repeats, and the words that their places cover are counted.
    """
    hashes, order = private("windows"), private("order")
    df = df.withColumn(hashes, once(windows(ws)))
    places = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    df = df.withColumn(order, once(F.when(F.size(F.array_distinct(hashes)) < F.size(hashes), places)))
    same = lambda i, j: F.coalesce(F.get(order, i)["h"] == F.get(order, j)["h"], F.lit(False))
    repeats = F.filter(F.sequence(F.lit(0), F.size(order) - 1), lambda j: same(j, j - 1) | same(j, j + 1))
    covered = F.aggregate(
        F.sort_array(F.transform(repeats, lambda j: F.get(order, j)["i"])),
        F.struct(F.lit(0).alias("n"), F.lit(-SHINGLE).alias("last")),
        lambda s, i: F.struct((s["n"] + F.least(F.lit(SHINGLE), i - s["last"])).alias("n"), i.alias("last")),
        lambda s: s["n"],
    )
    return df, F.when(F.col(order).isNull(), 0).otherwise(covered)


def ledger(docs: DataFrame) -> DataFrame:
    """doc_id, the measurements and `failed_bits` of every document; no shuffle."""
    private = lambda x: fresh(x, ["doc_id", "text", *MEASURES])
    ws, lines = private("ws"), private("lines")
    text = F.coalesce(F.col("text"), F.lit(""))
    df = docs.select("doc_id", text.alias("text"))
    df = df.withColumn(ws, once(words(F.col("text"))))
    df = df.withColumn(lines, once(F.filter(F.split("text", "\n"), lambda x: x.rlike(WORD))))
    df, repeated = _repeat_words(df, ws, private)
    measured = {
        "n_words": F.size(ws),
        "word_chars": F.length(F.translate("text", SPACES, "")),
        "n_symbols": _count(F.col("text"), SYMBOLS),
        "n_lines": F.size(lines),
        "n_dup_lines": F.size(lines) - F.size(F.array_distinct(lines)),
        "n_repeat_words": repeated,
        "n_upper": _count(F.col("text"), UPPER),
        "n_lower": _count(F.col("text"), LOWER),
        "n_stutter": F.size(F.filter(F.transform(ws, lambda w, i: w == F.get(ws, i + 1)), lambda same: same)),
    }
    df = df.select("doc_id", *[c.cast("long").alias(k) for k, c in measured.items()])
    bits = [F.when(F.expr(rule), F.lit(BIT[name])).otherwise(0) for name, rule in RULES.items()]
    return df.withColumn("failed_bits", sum(bits[1:], bits[0]).cast("long"))


def stored(docs: DataFrame) -> DataFrame:
    """The ledger of `docs`, written to the shared folder once and read from there."""
    return settle(ledger(docs))


def judged(entries: DataFrame, policy: str = CURRENT) -> DataFrame:
    """The ledger with base_failed and with `kept` under a policy. Base rules reject under every policy."""
    mask = POLICIES[policy] | BASE
    return entries.withColumns(
        {"base_failed": F.col("failed_bits").bitwiseAND(BASE) != 0, "kept": F.col("failed_bits").bitwiseAND(mask) == 0}
    )


def ablation(entries: DataFrame, policy: str = CURRENT) -> DataFrame:
    """For each rule of the policy: documents that fail it, and those that only it rejects. One aggregate over the bits."""
    mask = POLICIES[policy] | BASE
    failed = F.col("failed_bits").bitwiseAND(mask)
    names = [name for name in RULES if BIT[name] & mask]
    counts = [F.count_if(failed.bitwiseAND(BIT[n]) != 0).alias(f"{n}_failed") for n in names]
    counts += [F.count_if(failed == BIT[n]).alias(f"{n}_alone") for n in names]
    rows = ", ".join(f"'{n}', {n}_failed, {n}_alone" for n in names)
    return entries.agg(*counts).selectExpr(f"stack({len(names)}, {rows}) AS (rule, n_failed, n_only)")


def keep_good(docs: DataFrame, policy: str = CURRENT) -> DataFrame:
    """The documents that the policy keeps, with all their columns.

    The ledger is joined by nothing: the measurements are taken beside the row, which is carried along whole.
    """
    row = fresh("row", ["doc_id", "text", *MEASURES])
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc_id"), F.col("text"))
    kept = judged(ledger(packed), policy).filter("kept").select(F.col("doc_id").alias(row))
    return kept.select(*[F.col(row)[c].alias(c) for c in docs.columns])
