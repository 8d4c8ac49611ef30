from __future__ import annotations

import random
import time

import duckdb
import pytest
from helpers import ODD, WORDS, folder, frame
from pyspark.sql import functions as F

from assayer.llm import quality


def texts_of(seed=4):
    rng = random.Random(seed)
    small = [" ".join(rng.choices(["a", "b", "c", "#x", "the", "end.", "|", "é"], k=rng.randrange(120))) for _ in range(60)]
    lined = ["\n".join(" ".join(rng.choices(["one", "two", "three", "four"], k=rng.randrange(5))) for _ in range(rng.randrange(30))) for _ in range(40)]
    wide = [" ".join(f"w{rng.randrange(3000)}" for _ in range(rng.randrange(40, 400))) for _ in range(60)]
    return [*small, *lined, *wide, *ODD, "w " * 20_000, "a b c", "a b c a b c", "a b a b"]


def brute(t):
    t = t or ""
    w = WORDS(t)
    windows = [tuple(w[k : k + 3]) for k in range(len(w) - 2)]
    again = {x for x in windows if windows.count(x) > 1} if len(w) < 2000 else set(windows)
    covered = {k + j for k, x in enumerate(windows) if x in again for j in range(3)}
    lines = [x for x in t.split("\n") if WORDS(x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(covered), len(lines)


def test_counts_and_verdicts(spark, tmp_path):
    texts = texts_of()
    path = folder(spark, tmp_path, texts)
    df = quality.op7_rule_cascade(spark, path)
    assert df.columns[:8] == ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    rows = {r["doc_id"]: r for r in df.collect()}
    assert len(rows) == len(texts)
    for i, t in enumerate(texts):
        n, chars, symbols, dup, rep, lines = brute(t)
        r = rows[i]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == (n, chars, symbols, dup, rep), t and t[:80]
        failed = n < 50 or 100 * rep > 50 * n
        assert r["base_failed"] is failed
        assert r["kept"] is (not (failed or chars < 2 * n or chars > 20 * n or 10 * symbols > 3 * n or 10 * dup > 3 * lines))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{path}/documents.parquet/*.parquet'")
    sql = con.execute(quality.OP7_SQL).fetchall()
    assert sorted(map(tuple, sql)) == sorted(tuple(rows[i]) for i in rows)


def test_the_order_follows_rejection_per_cost_and_changes_no_verdict(spark):
    docs = frame(spark, texts_of(5))
    rules = quality.default_rules()
    ranked = quality.rank_rules(quality.split(docs).cache(), rules)
    worth = [share / cost for _, cost, share in ranked]
    assert worth == sorted(worth, reverse=True) and {r.name for r, _, _ in ranked} == {r.name for r in rules}
    shares = {r.name: share for r, _, share in ranked}
    assert abs(shares["few_words"] - sum(brute(t)[0] < 50 for t in texts_of(5)) / len(texts_of(5))) < 1e-9
    measured, found = quality.measure(docs).cache(), []
    for order in (rules, rules[::-1], [r for r, _, _ in ranked]):
        kept, reason = quality.cascade(order, {k: F.col(k) for k in quality.measures()})
        rows = measured.select("doc_id", kept.alias("k"), reason.alias("why")).orderBy("doc_id").collect()
        found.append([r["k"] for r in rows])
        assert all((r["why"] is None) == r["k"] for r in rows)
        alone = quality.verdicts(docs, order=order).orderBy("doc_id").collect()
        assert [r["kept"] for r in alone] == found[-1]
    assert found[0] == found[1] == found[2] == [r["kept"] for r in quality.verdicts(docs).orderBy("doc_id").collect()]


def test_measures_behind_the_first_rejection_are_not_computed(spark):
    docs = frame(spark, ["few words", None, "one two three"])
    boom = quality.Rule("boom", lambda m: F.raise_error(F.lit("not reached")).cast("boolean"))
    few = quality.default_rules()[0]
    assert [r["kept"] for r in quality.verdicts(docs, order=[few, boom]).collect()] == [False] * 3
    with pytest.raises(Exception, match="not reached"):
        quality.verdicts(docs, order=[boom, few]).collect()
    kept, reason = quality.cascade([], {})
    assert [tuple(r) for r in spark.range(1).select(kept, reason).collect()] == [(True, None)]


def test_short_circuits_save_time(spark):
    """Texts that the first rule rejects cost a fraction of what all their measures do."""
    docs = frame(spark, [" ".join(f"w{k}" for k in range(4000))] * 400, partitions=4).cache()
    docs.count()
    long = quality.Rule("long", lambda m: m["n_words"] > 1000)
    slow = quality.default_rules()[1]

    def seconds(order):
        took = []
        for _ in range(3):
            began = time.perf_counter()
            assert quality.verdicts(docs, order=order).agg(F.count_if("kept")).first()[0] == 0
            took.append(time.perf_counter() - began)
        return min(took)

    assert seconds([long, slow]) < 0.6 * seconds([slow, long])


def test_very_long_texts(spark):
    t = " ".join(f"w{k % 70_000}" for k in range(150_000))
    (row,) = quality.assess(frame(spark, [t])).collect()
    assert (row["n_words"], row["n_repeat_words"], row["kept"]) == (150_000, 150_000, False)


def test_it_runs_no_python(spark, tmp_path):
    plan = quality.op7_rule_cascade(spark, folder(spark, tmp_path, ["a", "b"]))._jdf.queryExecution().toString()
    assert not any(x in plan for x in ("Python", "Arrow", "Pandas", "Exchange"))


def test_null_ids_repeated_rows_and_empty_tables(spark):
    assert quality.assess(frame(spark, ["a"] * 3, [None, 1, 1])).count() == 3
    assert quality.assess(frame(spark, ["a"]).limit(0)).count() == 0
    assert quality.assess(frame(spark, ["a", "b"]).withColumnRenamed("lang", "words").withColumnRenamed("source", "n_words")).count() == 2
