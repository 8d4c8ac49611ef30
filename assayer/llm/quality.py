"""Quality rules as a short-circuit cascade, in DataFrame functions only.

Every rule rejects by measures of a text.  On a random sample over all
partitions each rule's cost (the time of its own measures over that of an empty
pass) and its rejected share are estimated; rules then run in falling order of
rejection per cost inside one CASE expression, in which each branch holds the
measures that it needs.  So a row pays for those of the rules up to its first
rejection and no others: verdicts() evaluates nothing else.  assess() puts out
all measures and so computes all; there the cascade only compares them.  The
order never changes a verdict.
"""

from __future__ import annotations

import math
import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from assayer.llm.common import SPACES, Workspace, columns, table, words

#: About so many rows serve to estimate costs and selectivities; verdicts cover all rows.
SAMPLE_ROWS = 2000
SYMBOLS = "#*$%&|<>"


Measures = dict[str, Column]


@dataclass(frozen=True)
class Rule:
    """rejects: from measures by name to a boolean Column that is true where the rule rejects."""

    name: str
    rejects: Callable[[Measures], Column]


def lines_with_words(text: Column) -> Column:
    blank = "^[ \\t\\x0B\\f\\r]*$"
    return F.filter(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: ~x.rlike(blank))


def repeated_words(tokens: Column) -> Column:
    """How many words lie in 3-word windows that occur twice or more.

    Windows are hashed to 64 bits and sorted with their places, so that equal
    ones are neighbours: n log n in a text's words, without a shuffle.
    """
    n = F.size(tokens)
    windows = F.transform(F.sequence(F.lit(0), n - 3), lambda i: F.struct(F.xxhash64(F.get(tokens, i), F.get(tokens, i + 1), F.get(tokens, i + 2)).alias("h"), i.alias("i")))

    def covered(s: Column) -> Column:
        h = lambda k: F.get(s, k)["h"]
        again = F.filter(s, lambda x, k: F.coalesce(x["h"] == h(k - 1), F.lit(False)) | F.coalesce(x["h"] == h(k + 1), F.lit(False)))
        return F.size(F.array_distinct(F.flatten(F.transform(again, lambda x: F.array(x["i"], x["i"] + 1, x["i"] + 2)))))

    # A one-element array binds the sorted windows to a name, so that they are sorted once.
    return F.when(n < 4, F.lit(0)).otherwise(F.get(F.transform(F.array(F.sort_array(windows)), covered), F.lit(0)))


def split(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, text (a null one is empty), its words and its lines: what measures() are made of."""
    own = columns(docs, doc_id=doc_id, text=text).withColumn("text", F.coalesce("text", F.lit("")))
    return own.withColumn("words", words(F.col("text")))


def measures() -> Measures:
    """The counts that rules use, as expressions over the columns of split(); each is computed where it is needed."""
    text, lines = F.col("text"), lines_with_words(F.col("text"))
    return {
        "n_words": F.size("words").cast("long"),
        "word_chars": F.length(F.translate(text, SPACES, "")).cast("long"),
        "n_symbols": (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long"),
        "n_dup_lines": F.get(F.transform(F.array(lines), lambda x: F.size(x) - F.size(F.array_distinct(x))), F.lit(0)).cast("long"),
        "n_repeat_words": repeated_words(F.col("words")).cast("long"),
        "n_lines": F.size(lines).cast("long"),
    }


def measure(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id and all measures.  A null text counts as empty."""
    own = split(docs, doc_id, text).withColumn("lines", lines_with_words(F.col("text")))
    lines = {"n_lines": F.size("lines").cast("long"), "n_dup_lines": (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long")}
    return own.select("doc_id", *[c.alias(k) for k, c in (measures() | lines).items()])


def default_rules() -> list[Rule]:
    return [
        Rule("few_words", lambda m: m["n_words"] < 50),
        Rule("repeated_words", lambda m: 100 * m["n_repeat_words"] > 50 * m["n_words"]),
        Rule("word_length", lambda m: (m["word_chars"] < 2 * m["n_words"]) | (m["word_chars"] > 20 * m["n_words"])),
        Rule("symbols", lambda m: 10 * m["n_symbols"] > 3 * m["n_words"]),
        Rule("repeated_lines", lambda m: 10 * m["n_dup_lines"] > 3 * m["n_lines"]),
    ]


def rank_rules(sample: DataFrame, rules: list[Rule]) -> list[tuple[Rule, float, float]]:
    """sample: of split().  (rule, seconds, rejected share) by falling rejection per cost.

    Seconds are the least of three runs, rounded to a power of two, as times
    vary; ties go by name.  Even so orders may differ from run to run.
    """
    all_ = measures()

    def timed(condition: Column) -> tuple[float, float]:
        took = []
        for _ in range(3):  # the first run compiles
            began = time.perf_counter()
            share = sample.agg(F.avg(F.coalesce(condition, F.lit(False)).cast("double")).alias("x")).first()["x"]
            took.append(time.perf_counter() - began)
        return min(took), share or 0.0

    empty, _ = timed(F.lit(False))
    found = []
    for r in rules:
        seconds, share = timed(r.rejects(all_))
        found.append((r, 2.0 ** round(math.log2(max(1e-3, seconds - empty))), share))
    return sorted(found, key=lambda x: (-x[2] / x[1], x[0].name))


def cascade(rules: list[Rule], m: Measures) -> tuple[Column, Column]:
    """The verdict (true: keep) and the name of the rule that rejected (null: none), in the rules' order."""
    verdict, reason = F, F
    for r in rules:
        verdict, reason = verdict.when(r.rejects(m), F.lit(False)), reason.when(r.rejects(m), F.lit(r.name))
    if not rules:
        return F.lit(True), F.lit(None).cast("string")
    return verdict.otherwise(F.lit(True)), reason.otherwise(F.lit(None).cast("string"))


def order_rules(docs: DataFrame, rules: list[Rule], doc_id: str = "doc_id", text: str = "text", sample_rows: int = SAMPLE_ROWS) -> list[Rule]:
    """The rules in the order that a sample of about sample_rows rows over all partitions suggests."""
    work = Workspace(docs.sparkSession)
    own = columns(docs, doc_id=doc_id, text=text)
    share = min(1.0, sample_rows / max(1, own.count()))
    sample = work.write(own.sample(share, seed=11), "sample")
    order = [r for r, _, _ in rank_rules(split(sample).select("doc_id", "text", "words"), rules)]
    work.drop("sample")
    return order


def verdicts(docs: DataFrame, rules: list[Rule] | None = None, doc_id: str = "doc_id", text: str = "text", order: list[Rule] | None = None) -> DataFrame:
    """doc_id and kept, of every row, for the least work: measures of rules behind the first rejection aren't computed.

    order: what order_rules() gave, to spare the sample.  Null, empty and blank
    texts have no words and are measured so.
    """
    rules = default_rules() if rules is None else rules
    order = order_rules(docs, rules, doc_id, text) if order is None else order
    return split(docs, doc_id, text).select("doc_id", cascade(order, measures())[0].alias("kept"))


def assess(docs: DataFrame, rules: list[Rule] | None = None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """All measures, base_failed, kept and rejected_by of every row.

    rejected_by names the first rule in the measured order that rejects, so it
    may differ between runs; kept can't.  Null, empty and blank texts have no
    words and so fail the base; very long texts take time in proportion to
    n log n of their words; null ids, repeated rows and further columns of any
    name do no harm; an empty table gives an empty result.
    """
    rules = default_rules() if rules is None else rules
    order = order_rules(docs, rules, doc_id, text)
    kept, reason = cascade(order, {k: F.col(k) for k in measures()})
    n = F.col("n_words")
    failed = (n < 50) | (100 * F.col("n_repeat_words") > 50 * n)
    return measure(docs, doc_id, text).select("*", failed.alias("base_failed"), F.when(failed, F.lit(False)).otherwise(kept).alias("kept"), reason.alias("rejected_by"))


def op7_rule_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assess(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


#: The same counts by set operations, and the same verdict.
OP7_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS (SELECT r, i, w[i] || ' ' || w[i+1] || ' ' || w[i+2] AS g FROM (SELECT r, w, unnest(range(1, len(w) - 1)) AS i FROM d)),
again AS (SELECT r, i FROM g QUALIFY count(*) OVER (PARTITION BY r, g) > 1),
rep AS (SELECT r, count(DISTINCT j) AS n FROM (SELECT r, unnest([i, i + 1, i + 2]) AS j FROM again) GROUP BY r),
l AS (SELECT r, x FROM (SELECT r, unnest(string_split(t, chr(10))) AS x FROM d) WHERE regexp_matches(x, '[^\x20\x09-\x0D]')),
dup AS (SELECT r, count(*) AS n_lines, count(*) - count(DISTINCT x) AS n FROM l GROUP BY r),
m AS (
  SELECT doc_id, len(w)::BIGINT AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
         (length(t) - length(translate(t, '#*$%&|<>', '')))::BIGINT AS n_symbols,
         coalesce(dup.n, 0)::BIGINT AS n_dup_lines, coalesce(rep.n, 0)::BIGINT AS n_repeat_words, coalesce(n_lines, 0) AS n_lines
  FROM d LEFT JOIN dup USING (r) LEFT JOIN rep USING (r))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
       NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words OR word_chars < 2 * n_words OR word_chars > 20 * n_words
            OR 10 * n_symbols > 3 * n_words OR 10 * n_dup_lines > 3 * n_lines) AS kept
FROM m
"""
