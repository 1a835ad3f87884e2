"""Quality rules as a bitmask ledger, in DataFrame operations only."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD

WINDOW = 5

#: Rules in bit order: each is evaluated once for a document and its failure stored as a bit.
RULES = {
    "few_words": "n_words < 10",
    "repeated_windows": "100 * n_repeat_words > 20 * n_words",
    "many_words": "n_words > 10000000",
    "short_words": "word_chars < 2 * n_words",
    "long_words": "word_chars > 15 * n_words",
    "symbols": "10 * n_symbols > n_words",
    "repeated_lines": "10 * n_dup_lines > 5 * n_lines and n_dup_lines > 3",
    "few_alphabetic": "10 * n_alpha < 4 * word_chars",
}
BIT = {name: 1 << i for i, name in enumerate(RULES)}


@dataclass(frozen=True)
class Policy:
    """A version of what to reject: the rules whose failure counts."""

    version: str
    rules: tuple[str, ...]

    @property
    def mask(self) -> int:
        return sum(BIT[r] for r in self.rules)


POLICIES = {
    "v1-base": Policy("v1-base", ("few_words", "repeated_windows")),
    "v1": Policy("v1", tuple(RULES)),
}


def _windows() -> Column:
    """64-bit hashes of the 5-word windows of the array w, in order; null for a shorter text."""
    starts = F.sequence(F.lit(0), F.greatest(F.size("w") - WINDOW, F.lit(0)))
    return F.when(F.size("w") >= WINDOW, F.transform(starts, lambda i: F.xxhash64(*[F.get("w", i + k) for k in range(WINDOW)])))


def measure(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The measurements: n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines, n_alpha (long).

    Row by row, without a shuffle, so a hot source or a group of copies costs what its rows cost.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    base = documents.select(F.col(id_col).alias("doc_id"), text.alias("t"))
    base = base.select(
        "doc_id",
        F.regexp_extract_all("t", F.lit(f"({WORD})"), F.lit(1)).alias("w"),
        (F.length("t") - F.length(F.regexp_replace("t", r"[#*$%&|<>]", ""))).cast("long").alias("n_symbols"),
        F.length(F.regexp_replace("t", r"[^\p{L}]+", "")).cast("long").alias("n_alpha"),
        F.filter(F.split("t", "\n"), lambda x: F.length(F.trim(F.translate(x, "\t\x0b\x0c\r", ""))) > 0).alias("lines"),
    )
    base = base.select(
        "doc_id",
        "w",
        "n_symbols",
        "n_alpha",
        F.size("w").cast("long").alias("n_words"),
        F.length(F.array_join("w", "")).cast("long").alias("word_chars"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        _windows().alias("hashes"),
    )
    # only a text with some repeated window sorts its windows; then equal ones are neighbours
    pairs = F.array_sort(F.transform("hashes", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    base = base.withColumn("pairs", F.when(F.size(F.array_distinct("hashes")) < F.size("hashes"), pairs))
    twice = F.filter(
        F.transform(
            "pairs",
            lambda p, i: F.when((F.get("pairs", i - 1)["h"] == p["h"]) | (F.get("pairs", i + 1)["h"] == p["h"]), p["i"]),
        ),
        lambda i: i.isNotNull(),
    )
    base = base.withColumn("positions", F.array_sort(twice))
    # min(5, gap to the previous repeated window) counts each covered word once
    covered = F.aggregate(
        "positions",
        F.struct(F.lit(0).alias("n"), F.lit(-WINDOW).alias("last")),
        lambda acc, i: F.struct((acc["n"] + F.least(F.lit(WINDOW), i - acc["last"])).alias("n"), i.alias("last")),
    )["n"]
    return base.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"), "n_lines", "n_alpha")


def ledger(documents: DataFrame, **cols: str) -> DataFrame:
    """The measurements and fail_bits: bit i is set if rule i of RULES fails."""
    bits = sum((F.when(F.expr(rule), BIT[name]).otherwise(0) for name, rule in RULES.items()), F.lit(0))
    return measure(documents, **cols).withColumn("fail_bits", bits.cast("long"))


def apply_policy(ledger: DataFrame, policy: Policy = POLICIES["v1"]) -> DataFrame:
    """Adds policy and kept: no rule of the policy failed. Reads the ledger only, so a new version costs no text scan."""
    return ledger.withColumn("policy", F.lit(policy.version)).withColumn("kept", F.col("fail_bits").bitwiseAND(F.lit(policy.mask)) == 0)


def ablations(ledger: DataFrame, policy: Policy = POLICIES["v1"]) -> DataFrame:
    """(rule, failed, failed_alone, kept_without): per rule of the policy, how many documents fail it, fail it
    alone, and would be kept without it. One partial aggregation over the bits."""
    bits = F.col("fail_bits").bitwiseAND(F.lit(policy.mask))
    sums = [F.count_if(bits == 0).alias("kept")]
    for name in policy.rules:
        sums += [F.count_if(bits.bitwiseAND(F.lit(BIT[name])) != 0).alias(f"f_{name}"), F.count_if(bits == BIT[name]).alias(f"a_{name}")]
    one = ledger.agg(*sums)
    rows = F.array(*[F.struct(F.lit(n).alias("rule"), F.col(f"f_{n}").alias("failed"), F.col(f"a_{n}").alias("failed_alone"), (F.col("kept") + F.col(f"a_{n}")).alias("kept_without")) for n in policy.rules])
    return one.select(F.inline(rows))


def quality(documents: DataFrame, policy: Policy = POLICIES["v1"], **cols: str) -> DataFrame:
    """A row per document: measurements, base_failed, fail_bits, policy, kept.

    Words are runs of characters other than space and tab to carriage return. A null or empty text has no
    words and fails few_words. Repeated rows and ids are measured row by row; extra columns are ignored.
    """
    out = apply_policy(ledger(documents, **cols), policy)
    base = F.col("fail_bits").bitwiseAND(F.lit(POLICIES["v1-base"].mask)) != 0
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base.alias("base_failed"), (F.col("kept") & ~base).alias("kept"), "fail_bits", "n_lines", "n_alpha", "policy")


def quality_oracle(policy: Policy = POLICIES["v1"]) -> str:
    """The same in DuckDB's SQL; repeated windows by counting each window of each row."""
    bits = " + ".join(f"CASE WHEN {rule} THEN {BIT[name]} ELSE 0 END" for name, rule in RULES.items())
    return rf"""
    WITH w AS (SELECT row_number() OVER () AS rid, doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
      FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents)),
    win AS (SELECT rid, i, list_slice(w, i, i + 4) AS g FROM (SELECT rid, w, unnest(range(1, len(w) - 3)) AS i FROM w WHERE len(w) >= 5)),
    dup AS (SELECT rid, i FROM win QUALIFY count(*) OVER (PARTITION BY rid, g) > 1),
    cov AS (SELECT rid, count(DISTINCT i + k) AS n FROM dup, range(0, 5) r(k) GROUP BY rid),
    m AS (SELECT doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars, (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
      (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(n, 0)::BIGINT AS n_repeat_words, len(lines)::BIGINT AS n_lines, length(regexp_replace(t, '[^\p{{L}}]+', '', 'g'))::BIGINT AS n_alpha FROM w LEFT JOIN cov USING (rid)),
    b AS (SELECT *, ({bits})::BIGINT AS fail_bits FROM m)
    SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, fail_bits & {POLICIES["v1-base"].mask} <> 0 AS base_failed, fail_bits & {policy.mask | POLICIES["v1-base"].mask} = 0 AS kept,
      fail_bits, n_lines, n_alpha, '{policy.version}' AS policy FROM b"""
