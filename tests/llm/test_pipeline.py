import cases
import corpus_pipeline
import numpy as np
import pytest
from conftest import SF
from pyspark.sql import functions as F
from test_groups import classes, hits

import __spark_entry__ as entry
from granary.llm import ordinal, quality_rules


@pytest.fixture(scope="module")
def data(spark):
    folder = SF.replace("0.001", "0.01")
    return spark.read.parquet(f"{folder}/documents.parquet"), ordinal.ratings(spark.read.parquet(f"{folder}/labels.parquet"))


def test_held_out_accuracy(spark, data):
    docs, rated = data
    fitted, held = rated.filter("doc_id % 4 != 0"), rated.filter("doc_id % 4 = 0 and grade is not null")
    model = ordinal.fit(docs, fitted)
    assert len(model.thresholds) == 2 and model.thresholds[0] < model.thresholds[1]
    got = ordinal.rate(docs, model, keep=["doc_id"]).join(held, "doc_id").select(
        (F.col("grade") == 2).alias("good"), ordinal.keeps(F.col("__tail")).alias("kept")).collect()
    right = sum(r.good == r.kept for r in got) / len(got)
    assert right > 0.9
    assert sum(r.kept for r in got if r.good) >= 0.97 * sum(r.good for r in got)


def test_probabilities_follow_the_thresholds():
    above = ordinal.tails(0.5, (-1.0, 2.0))
    assert above[0] > 0.5 > above[1] and ordinal.tails(3.0, (-1.0, 2.0))[1] > above[1]


def test_the_fit_orders_grades():
    rng = np.random.default_rng(1)
    grades = rng.integers(0, 3, 600)
    columns = [np.flatnonzero(rng.random(6) < [0.5, 0.5, 0.1 + 0.35 * g, 0.8 - 0.35 * g, 0.5, 0.3]) for g in grades]
    starts = np.concatenate([[0], np.cumsum([len(c) for c in columns])])
    w, cut = ordinal.solve(grades, np.concatenate(columns), starts, 6, 3)
    assert w[2] > 0.8 and w[3] < -0.8 and abs(w[4]) < 0.4 and cut[0] < cut[1]


def test_awkward_ratings(spark):
    docs = cases.documents(spark)
    schema = "doc_id long, grade int, text string"
    empty = ordinal.fit(docs, spark.createDataFrame([], schema))
    rows = ordinal.rate(docs, empty).select("__tail", ordinal.keeps(F.col("__tail")).alias("k")).collect()
    assert len(rows) == len(cases.texts()) and all(r["__tail"] is None and r.k for r in rows)
    odd = spark.createDataFrame([(None, 1, "t"), (1, None, "t"), (2, 2, "t"), (2, 0, "t"), (3, 1, "t"), (777, 2, "t")], schema)
    model = ordinal.fit(docs, odd)
    rated = ordinal.rate(docs, model).collect()
    assert len(rated) == len(cases.texts()) and all(0 <= r["__tail"] <= 1 and 0 <= r["__grade"] <= 2 for r in rated)
    assert ordinal.rate(cases.empty(spark), model).count() == 0


def rules_by_hand(text):
    words = cases.space_words(text)
    lines = [x for x in (text or "").split("\n") if cases.space_words(x)]
    from test_rows import repeated

    return (len(words) >= 50 and 2 * repeated(words) <= len(words)
            and 100 * sum(text.count(c) for c in quality_rules.SYMBOLS) <= 30 * len(words)
            and 100 * (len(lines) - len(set(lines))) <= 60 * len(lines)
            and 2 * sum("A" <= c <= "Z" for c in text) <= sum(map(len, words)))


def test_stages_one_by_one(spark, tmp_path):
    """Each stage against brute force on what the stage before kept."""
    import public_tokenizers
    import tiktoken

    folder = SF
    stages = dict(corpus_pipeline.STAGES)
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    names = docs.columns

    def step(name):
        nonlocal docs
        path = str(tmp_path / name.replace(" ", "-"))
        stages[name](spark, docs, folder).write.parquet(path)
        before, docs = {r.doc_id: r.text for r in docs.collect()}, spark.read.parquet(path)
        if name != "byte-level BPE":
            assert docs.columns == names
        return before, docs.collect()

    before, after = step("quality rules")
    assert {r.doc_id for r in after} == {i for i, t in before.items() if rules_by_hand(t)}
    labels = {r.doc_id: r for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    before, after = step("quality classifier")
    kept = {r.doc_id for r in after}
    good = [i for i in before if i in labels and labels[i].quality == 1 and labels[i].toxic == 0]
    assert kept <= set(before) and sum(i in kept for i in good) >= 0.97 * len(good)
    before, after = step("near-duplicate removal")
    assert sorted(r.doc_id for r in after) == sorted({c for _, _, c in classes(list(before.items()), 5)})
    before, after = step("benchmark decontamination")
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    assert {r.doc_id for r in after} == {h[0] for h in hits(list(before.items()), items) if not h[2]}
    before, after = step("byte-level BPE")
    import hashlib

    from granary.llm import byte_bpe

    code = byte_bpe.coder(cases.RANKS, public_tokenizers.PATTERN)
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=code.bpe.ranks, special_tokens={})
    assert {(r.doc_id, r.n_tokens, r.decoded_sha256) for r in after} == {
        (i, len(library.encode_ordinary(t)), hashlib.sha256(t.encode()).hexdigest()) for i, t in before.items()}


def test_stages_take_awkward_rows_and_none(spark, tmp_path):
    spark.createDataFrame([(1, 1, 0), (2, None, None), (None, 0, 1)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, None), (2, cases.prose(7))], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    for rows in ([], cases.texts()):
        path = tmp_path / f"documents-{len(rows)}"
        path.mkdir()
        for name in ("labels", "benchmark"):
            (path / f"{name}.parquet").symlink_to(tmp_path / f"{name}.parquet")
        cases.documents(spark, rows).write.parquet(str(path / "documents.parquet"))
        got = corpus_pipeline.run(spark, str(path)).collect()
        ids = [r.doc_id for r in got if r.doc_id is not None]
        assert len(ids) == len(set(ids)) and (-4 not in ids) and bool(got) == bool(rows)


ODD = ("a.b", "__grade", "__tail", "__spans", "__kinds", "__n_words", "__in", "node", "c0", "kept", "weird `tick")


def test_stages_take_any_column_names_and_types(spark, tmp_path):
    spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(2, cases.prose(7))], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    rows = [(i, t, {"k": i or 0}) for i, t in cases.texts()]
    docs = spark.createDataFrame(rows, "doc_id long, text string, m map<string,long>").select(
        "*", *[F.lit("x").alias(c) for c in ODD])
    for name, stage in corpus_pipeline.STAGES:
        got = stage(spark, docs, str(tmp_path))
        if name != "byte-level BPE":
            assert got.columns == docs.columns and [t for _, t in got.dtypes] == [t for _, t in docs.dtypes]
        assert got.toDF(*[f"c{i}" for i in range(len(got.columns))]).count() > 0


def test_rows_without_id_are_deduplicated(spark):
    base, other = cases.prose(1), cases.prose(6)
    near = base.replace(base.split()[7], "changed", 1)
    rows = [(None, base), (None, near), (5, near), (None, other), (None, other), (None, None), (None, ""), (7, None), (7, "")]
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, extra string")
    got = corpus_pipeline.near_dedup_stage(spark, docs, "").collect()
    assert sorted(((r.doc_id or 0, r.text or "", r.extra) for r in got)) == sorted(
        [(5, near, "x"), (0, other, "x"), (0, "", "x"), (7, "", "x")])


def test_every_operator_is_registered():
    names = entry.queries()
    for n in range(1, 14):
        assert sum(name.startswith(f"op{n}_") for name in names) == 1
    assert "pipeline" in names and 4 <= len(corpus_pipeline.STAGES) <= 5
    for name in ("op4_quality_rules", "op5_decontaminate", "op7_licenses", "op8_chat", "op12_filter_audit", "op13_fill_middle"):
        assert name in entry.oracle_sql()


NATIVE = ("op4_quality_rules", "op7_licenses", "op8_chat", "op10_urls")


@pytest.mark.parametrize("name", NATIVE)
def test_native_plans_have_no_python(spark, name):
    plan = entry.queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    for node in ("EvalPython", "InPandas", "InArrow", "CartesianProduct", "BroadcastNestedLoopJoin"):
        assert node not in plan
