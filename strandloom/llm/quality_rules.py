"""Quality rules: a threshold table compiled into Spark projections, without user functions.

Every metric is an integer built from whole texts with built-in expressions, every rule is an
integer comparison, so the verdict is the same in any engine. Windows of three words are compared by 64 bits of hash.

The stop-word rule reads the document's language from its column ``lang`` and has lists for English,
German, French and Spanish; documents of other languages, of none, and tables without the column get
no verdict from it, all other rules hold for them.

Defined results: a null or blank text has no words and fails ``min_words``; repeated rows are
judged one by one; very long texts are judged in whole; an empty table gives no rows; columns of the input whose names start with ``__q_`` are not supported, any
other extra column passes through untouched.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandloom.llm.common import WORD_BREAK, documents

SYMBOLS = "#*$%&|<>"

#: Frequent function words by language. A document of another language, or of none, gets no verdict from them.
STOP_WORDS = {
    "en": "the of and to in that a is was it for on with as be at by are this from or an not".split(),
    "de": "der die das und zu den von ein eine ist im nicht mit es sich auf in an".split(),
    "fr": "le la les de des du et un une que en est pour dans qui sur au a".split(),
    "es": "el los las la y de en que por con para se del un una su lo como es a".split(),
}


@dataclass(frozen=True)
class Rule:
    """Keep a text while ``scale * metric`` lies in [low * per, high * per] (None: open)."""

    name: str
    metric: str
    low: int | None = None
    high: int | None = None
    per: str | None = None
    scale: int = 1


#: Base rules of the contract.
BASE_RULES = (
    Rule("min_words", "n_words", low=50),
    Rule("repeated_windows", "n_repeat_words", high=50, per="n_words", scale=100),
)

#: The method's own threshold table.
RULES = (
    Rule("mean_word_length", "word_chars", low=15, high=120, per="n_words", scale=10),
    Rule("symbol_ratio", "n_symbols", high=25, per="n_words", scale=100),
    Rule("alphabetic_words", "n_alpha_words", low=60, per="n_words", scale=100),
    Rule("stop_words", "n_stop_words", low=1, per="n_listed_words", scale=200),
    Rule("duplicate_lines", "n_dup_lines", high=50, per="n_lines", scale=100),
    Rule("ellipsis_lines", "n_ellipsis_lines", high=50, per="n_lines", scale=100),
)


def compile_rules(rules: tuple[Rule, ...], metric=F.col) -> Column:
    """One boolean expression: true while every rule holds."""
    verdict = F.lit(True)
    for rule in rules:
        value = metric(rule.metric) * rule.scale
        unit = metric(rule.per) if rule.per else F.lit(1)
        if rule.low is not None:
            verdict = verdict & (value >= unit * rule.low)
        if rule.high is not None:
            verdict = verdict & (value <= unit * rule.high)
    return verdict


def compile_sql(rules: tuple[Rule, ...]) -> str:
    """The same table as an SQL condition."""
    parts = []
    for rule in rules:
        unit = rule.per or "1"
        parts += [f"{rule.metric} * {rule.scale} >= {unit} * {rule.low}"] * (rule.low is not None)
        parts += [f"{rule.metric} * {rule.scale} <= {unit} * {rule.high}"] * (rule.high is not None)
    return " AND ".join(parts)


def _count(array: Column) -> Column:
    return F.size(array).cast("long")


def _listed(words: Column, wanted: list[str]) -> Column:
    return _count(F.filter(words, lambda w: F.lower(w).isin(*wanted)))


def measure(docs: DataFrame, text: str = "text") -> DataFrame:
    """Add the struct column ``__q_metrics`` with every metric of the rule tables.

    The projections are layered so that each array is built once: an array that a later lambda
    reads is referenced more than once there, and Spark keeps such projections apart.
    """
    whole = F.coalesce(F.col(text), F.lit(""))
    lang = F.lower("lang") if "lang" in docs.columns else F.lit(None).cast("string")
    staged = docs.select(
        "*",
        F.filter(F.split(whole, WORD_BREAK), lambda w: w != "").alias("__q_words"),
        F.filter(F.split(whole, "\n"), lambda s: s.rlike(r"[^\x20\x09-\x0D]")).alias("__q_lines"),
        (F.length(whole) - F.length(F.translate(whole, SYMBOLS, ""))).cast("long").alias("__q_symbols"),
        F.length(F.regexp_replace(whole, WORD_BREAK, "")).cast("long").alias("__q_chars"),
    )
    words = F.col("__q_words")
    windows = F.transform(words, lambda w, i: F.xxhash64(w, F.get(words, i + 1), F.get(words, i + 2)))
    staged = staged.select(
        "*", F.when(F.size(words) >= 3, F.slice(windows, F.lit(1), F.size(words) - 2)).alias("__q_windows")
    )
    hashes = F.col("__q_windows")
    repeated = F.size(hashes) > F.size(F.array_distinct(hashes))
    ordered = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    staged = staged.select("*", F.when(repeated, ordered).alias("__q_ordered"))
    ranked = F.col("__q_ordered")
    twice = F.filter(
        ranked,
        lambda x, i: F.coalesce(x["h"] == F.get(ranked, i - 1)["h"], F.lit(False))
        | F.coalesce(x["h"] == F.get(ranked, i + 1)["h"], F.lit(False)),
    )
    staged = staged.select("*", F.sort_array(F.transform(twice, lambda x: x["i"])).alias("__q_starts"))
    starts = F.col("__q_starts")
    covered = F.aggregate(
        F.transform(starts, lambda s, i: F.least(F.lit(3), F.coalesce(F.get(starts, i + 1) - s, F.lit(3)))),
        F.lit(0).cast("long"),
        lambda total, n: total + n,
    )
    lines = F.col("__q_lines")
    common = F.lit(0).cast("long")
    for name, listed in STOP_WORDS.items():
        common = F.when(lang == name, _listed(words, listed)).otherwise(common)
    metrics = F.struct(
        _count(words).alias("n_words"),
        F.col("__q_chars").alias("word_chars"),
        F.col("__q_symbols").alias("n_symbols"),
        _count(lines).alias("n_lines"),
        (_count(lines) - _count(F.array_distinct(lines))).alias("n_dup_lines"),
        F.coalesce(covered, F.lit(0).cast("long")).alias("n_repeat_words"),
        _count(F.filter(words, lambda w: w.rlike(r"\p{L}"))).alias("n_alpha_words"),
        common.alias("n_stop_words"),
        F.when(lang.isin(*STOP_WORDS), _count(words)).otherwise(F.lit(0).cast("long")).alias("n_listed_words"),
        _count(F.filter(lines, lambda s: s.rlike(r"(\.\.\.|…)$"))).alias("n_ellipsis_lines"),
    )
    return staged.select(*(F.col(f"`{c}`") for c in docs.columns), metrics.alias("__q_metrics"))


def judge(measured: DataFrame) -> DataFrame:
    """Add ``__q_base_failed`` and ``__q_kept`` from the threshold tables, in one projection."""
    metric = lambda name: F.col("__q_metrics")[name]
    base = compile_rules(BASE_RULES, metric)
    return measured.select("*", (~base).alias("__q_base_failed"), (base & compile_rules(RULES, metric)).alias("__q_kept"))


def keep_good(docs: DataFrame) -> DataFrame:
    """The documents that pass every rule, with the input's columns."""
    # a filter over plain projections would be pushed below them, with every metric written out for
    # each use; the row number, which is not deterministic, keeps it above
    numbered = measure(docs).select("*", F.monotonically_increasing_id().alias("__q_row"))
    return judge(numbered).filter("__q_kept AND __q_row >= 0").select(*(F.col(f"`{c}`") for c in docs.columns))


OUTPUT = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = judge(measure(documents(spark, sf_dir).select("doc_id", "text", "lang")))
    return judged.select(
        "doc_id",
        *(F.col("__q_metrics")[name].alias(name) for name in OUTPUT),
        F.col("__q_base_failed").alias("base_failed"),
        F.col("__q_kept").alias("kept"),
    )


_LISTED = " ".join(
    f"WHEN '{name}' THEN len(list_filter(w, lambda x: lower(x) IN ({', '.join(repr(x) for x in listed)})))" for name, listed in STOP_WORDS.items()
)
_NAMED = ", ".join(f"'{name}'" for name in STOP_WORDS)

ORACLE = rf"""
WITH split AS (
  SELECT doc_id, lower(lang) AS lang, coalesce(text, '') AS t,
         list_filter(string_split_regex(coalesce(text, ''), '{WORD_BREAK}'), lambda w: w <> '') AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda s: regexp_matches(s, '[^\x20\x09-\x0D]')) AS l
  FROM documents),
windows AS (
  SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM split WHERE len(w) >= 3)),
twice AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c FROM windows) WHERE c >= 2),
covered AS (SELECT doc_id, count(DISTINCT i + k) AS n_repeat_words FROM twice, range(0, 3) AS r(k) GROUP BY doc_id),
metrics AS (
  SELECT s.doc_id, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars,
         length(t) - length(translate(t, '{SYMBOLS}', '')) AS n_symbols, len(l) AS n_lines,
         len(l) - len(list_distinct(l)) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words,
         len(list_filter(w, lambda x: regexp_matches(x, '\p{{L}}'))) AS n_alpha_words,
         CASE lang {_LISTED} ELSE 0 END AS n_stop_words, CASE WHEN lang IN ({_NAMED}) THEN len(w) ELSE 0 END AS n_listed_words,
         len(list_filter(l, lambda x: regexp_matches(x, '(\.\.\.|\x{{2026}})$'))) AS n_ellipsis_lines
  FROM split s LEFT JOIN covered c ON s.doc_id = c.doc_id)
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols,
       n_dup_lines::BIGINT AS n_dup_lines, n_repeat_words::BIGINT AS n_repeat_words,
       NOT ({compile_sql(BASE_RULES)}) AS base_failed,
       ({compile_sql(BASE_RULES)}) AND ({compile_sql(RULES)}) AS kept
FROM metrics
"""
