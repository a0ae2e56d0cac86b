"""Quality rules: a threshold table compiled into one projection of text ratios.

Everything is a built-in expression of one pass over the table; there is no shuffle, no user
function and no state, so the plan is the same at any size.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from meteospan.llm.columns import SPACES, WORD, fresh, let, whole, words

WINDOW = 8
# Symbols of markup and noise.
SYMBOLS = "#*$%&|<>"
# Frequent function words of German, English, French and Spanish.
STOP_WORDS = (
    "a al an and are as at be but by con da das de del dem den der des die du e ein eine el en er es est et "
    "for from has have he her his i ich il in is ist it its la las le les lo los mit my nicht no not of on or "
    "para pas por pour qu que qui se sich sie so son su sur that the they this to un una und une von was we "
    "were wh which with y you zu"
).split()


@dataclass(frozen=True)
class Rule:
    """A text passes when ``low <= value <= high``; value is SQL over the measures of a text."""

    name: str
    value: str
    low: float | None = None
    high: float | None = None


#: Bounds are wide: a rule is there for texts of noise, not for unusual prose.
RULES = (
    Rule("length", "n_words", high=1_000_000),
    Rule("mean_word_length", "word_chars / n_words", low=1.5, high=24.0),
    Rule("symbols_per_word", "n_symbols / n_words", high=0.3),
    Rule("duplicate_line_ratio", "n_dup_lines / n_lines", high=0.7),
    Rule("alphabetic_word_ratio", "n_alpha_words / n_words", low=0.4),
    Rule("stop_word_ratio", "n_stop_words / n_words", high=0.9),
)


def _repeated(hashes: Column) -> Column:
    """Words inside windows whose hash occurs twice or more, every word counted once."""
    found = lambda s, i: (F.get(s, i - 1)["h"] == F.get(s, i)["h"]) | (F.get(s, i + 1)["h"] == F.get(s, i)["h"])
    positions = lambda s: F.sort_array(
        F.transform(F.filter(s, lambda x, i: F.coalesce(found(s, i), F.lit(False))), lambda x: x["i"])
    )
    covered = lambda p: F.aggregate(
        F.transform(p, lambda x, i: F.least(F.coalesce(F.get(p, i + 1) - x, F.lit(WINDOW)), F.lit(WINDOW))),
        F.lit(0).cast("bigint"),
        lambda a, x: a + x,
    )
    order = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    return F.when(
        F.size(F.array_distinct(hashes)) < F.size(hashes), let(order, lambda s: let(positions(s), covered))
    ).otherwise(F.lit(0).cast("bigint"))


def measures(text: Column) -> Column:
    """Struct of the counts that rules refer to, in one evaluation of the words of the text."""
    text = whole(text)
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(WORD))

    def counted(w: Column) -> Column:
        coded = F.transform(w, lambda x: F.xxhash64(x))
        windows = lambda h: F.when(
            F.size(h) >= WINDOW,
            F.transform(
                F.sequence(F.lit(0), F.size(h) - WINDOW),
                lambda i: F.xxhash64(*[F.get(h, i + k) for k in range(WINDOW)]),
            ),
        ).otherwise(F.array().cast("array<bigint>"))
        return F.struct(
            F.size(w).cast("bigint").alias("n_words"),
            let(let(coded, windows), _repeated).alias("n_repeat_words"),
            F.size(F.filter(w, lambda x: F.lower(x).isin(STOP_WORDS))).cast("bigint").alias("n_stop_words"),
            F.size(F.filter(w, lambda x: x.rlike(r"\p{L}"))).cast("bigint").alias("n_alpha_words"),
        )

    def line_counts(x: Column) -> Column:
        return F.struct(
            F.size(x).cast("bigint").alias("n_lines"),
            (F.size(x) - F.size(F.array_distinct(x))).cast("bigint").alias("n_dup_lines"),
        )

    return F.struct(
        F.char_length(F.translate(text, SPACES, "")).cast("bigint").alias("word_chars"),
        (F.char_length(text) - F.char_length(F.translate(text, SYMBOLS, ""))).cast("bigint").alias("n_symbols"),
        let(words(text), counted).alias("w"),
        let(lines, line_counts).alias("l"),
    )


def verdict(rules=RULES) -> str:
    """The rules as one SQL condition; a ratio without denominator passes."""
    tests = []
    for r in rules:
        if r.low is not None:
            tests.append(f"coalesce(try_divide({r.value.replace(' / ', ', ')}) >= {r.low}, true)" if " / " in r.value else f"{r.value} >= {r.low}")
        if r.high is not None:
            tests.append(f"coalesce(try_divide({r.value.replace(' / ', ', ')}) <= {r.high}, true)" if " / " in r.value else f"{r.value} <= {r.high}")
    return " AND ".join(tests) if tests else "true"


def quality_rules(docs: DataFrame, rules=RULES, text_col: str = "text") -> DataFrame:
    """All columns of ``docs`` and the measures ``n_words, word_chars, n_symbols, n_dup_lines,
    n_repeat_words, n_lines, n_stop_words, n_alpha_words, base_failed, kept``.

    A null or empty text has no words and fails the base rule (fewer than 20 words, or over 30 %
    of the words in repeated 8-word windows). Repeated rows are judged one by one; an empty table
    gives an empty result. Columns of the input that bear the name of a measure are replaced.
    """
    tmp = fresh(docs.columns, "_m")
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_stop_words", "n_alpha_words")
    at = {"word_chars": "", "n_symbols": "", "n_dup_lines": ".l", "n_lines": ".l"}
    taken = {*names, "base_failed", "kept"}
    measured = docs.withColumn(tmp, measures(F.col(text_col)))
    kept = [f"`{c}`" for c in docs.columns if c.lower() not in taken]
    flat = measured.selectExpr(*kept, *[f"{tmp}{at.get(n, '.w')}.{n} AS {n}" for n in names])
    failed = "n_words < 20 OR 100 * n_repeat_words > 30 * n_words"
    return flat.withColumn("base_failed", F.expr(failed)).withColumn("kept", F.expr(f"NOT ({failed}) AND ({verdict(rules)})"))


def keep_good(docs: DataFrame, rules=RULES, text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, with their own columns, whose text passes every rule."""
    tmp = fresh(docs.columns, "_text")
    judged = quality_rules(docs.select(F.struct(*docs.columns).alias("_row"), F.col(text_col).alias(tmp)), rules, tmp)
    return judged.filter("kept").select("_row.*")


def _sql_rule(r: Rule) -> list[str]:
    value = r.value if " / " not in r.value else "{} / nullif(CAST({} AS DOUBLE), 0)".format(*r.value.split(" / "))
    return [f"coalesce({value} {op} {bound}, true)" for op, bound in ((">=", r.low), ("<=", r.high)) if bound is not None]


def op4_quality_rules(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return quality_rules(docs).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


def op4_sql() -> str:
    space = "[\\x20\\x09-\\x0D]+"
    stop = ", ".join(f"'{w}'" for w in STOP_WORDS)
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, text, list_filter(string_split_regex(text, '{space}'), lambda x: x <> '') AS ws,
             list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS ls FROM d),
g AS (SELECT doc_id, i, hash(array_to_string(ws[i : i + 7], ' ')) AS h, array_to_string(ws[i : i + 7], ' ') AS win
      FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 6)) AS i FROM w WHERE len(ws) >= 8)),
c AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, win) AS n FROM g),
r AS (SELECT doc_id, sum(least(8, coalesce(nxt - i, 8))) AS n_repeat_words
      FROM (SELECT doc_id, i, lead(i) OVER (PARTITION BY doc_id ORDER BY i) AS nxt FROM c WHERE n > 1) GROUP BY doc_id),
m AS (SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words,
             CAST(len(regexp_replace(text, '{space}', '', 'g')) AS BIGINT) AS word_chars,
             CAST(len(text) - len(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
             CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines, len(ls) AS n_lines,
             CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words,
             len(list_filter(ws, lambda x: lower(x) IN ({stop}))) AS n_stop_words,
             len(list_filter(ws, lambda x: regexp_matches(x, '\\pL'))) AS n_alpha_words
      FROM w LEFT JOIN r USING (doc_id)),
f AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND {" AND ".join(x for r in RULES for x in _sql_rule(r))} AS kept FROM f"""
