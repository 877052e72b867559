"""The registered queries against their SQL twins, and the pipeline stage by stage."""

import random

import duckdb
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from stockwell.llm import queries


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_sql_twin(name, spark, sf_dir):
    con = duckdb.connect()
    for t in ("documents", "conversations"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    got, want = queries.QUERIES[name](spark, sf_dir).toPandas(), con.sql(queries.ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    columns, by = sorted(got.columns), got.columns[0]
    assert got[columns].sort_values(by).values.tolist() == want[columns].sort_values(by).values.tolist()


def test_stages(spark, tmp_path):
    words = [f"w{i}" for i in range(3000)]
    text = lambda a, n: " ".join(random.Random(a).choices(words, k=n))
    bad = lambda i: text(i, 60) + ". you vile loathsome thing. " + text(i + 5000, 10)
    passage = text(9999, 55)
    rows, labels = [], []
    for i in range(240):
        t = bad(i) if i % 6 == 0 else text(i, 150)
        rows.append((i, t, "en", f"s{i % 3}", len(t)))
        labels.append((i, 1, int(i % 6 == 0)))
    near = rows[1][1].split()
    near[70] = "other"
    rows += [(300, rows[1][1], "en", "s0", 1), (301, " ".join(near), "en", "s0", 1)]
    rows += [(310 + k, f"{text(500 + k, 40)} {passage} {text(600 + k, 40)}", "en", "s1", 1) for k in range(4)]
    rows += [(320, bad(777), "en", "s1", 1), (321, "", "en", "s1", 0), (322, None, None, None, None)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    ids = lambda df: {r.doc_id for r in df.select("doc_id").collect()}

    clean = corpus_pipeline.drop_toxic(spark, docs, str(tmp_path))
    kept = {r[0] for r in rows if not (r[1] and "vile" in r[1])}
    assert ids(clean) == kept and clean.columns == docs.columns
    unique = corpus_pipeline.drop_near_duplicates(spark, clean, str(tmp_path))
    assert ids(unique) == kept - {300, 301, 322} and unique.count() == len(kept) - 3
    cut = corpus_pipeline.drop_repeats(spark, unique, str(tmp_path))
    texts = {r.doc_id: r.text for r in cut.collect()}
    assert passage in texts[310] and not any(passage in texts[310 + k] for k in (1, 2, 3))
    assert texts[1] == rows[1][1] and ids(cut) == ids(unique)
    mixed = corpus_pipeline.mix_sources(spark, cut, str(tmp_path))
    assert mixed.columns == docs.columns and ids(mixed) <= ids(cut)
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == mixed.count()
    none = docs.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, none, str(tmp_path)).count() == 0


def test_repeated_rows_stay_once_per_group(spark, tmp_path):
    rows = [(1, "a b c d e f", "en", "s", 1)] * 3 + [(None, "a b c d e f", "en", "s", 1), (2, "", "en", "s", 1), (3, None, "en", "s", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = corpus_pipeline.drop_near_duplicates(spark, docs, str(tmp_path))
    assert sorted(r.doc_id for r in got.collect()) == [1, 2]
    assert got.where(F.col("doc_id") == 1).count() == 1


def test_stages_drop_other_columns(spark, tmp_path):
    rows = [(i, f"{'alpha beta gamma delta ' * 5}{i % 7} {i}", "en", f"s{i % 2}", 1, "r", 1, "x", 2, 3, "z", 1) for i in range(30)]
    schema = "doc_id long, text string, lang string, source string, n_chars long, row string, _k int, k string, copies int, _copy int, d string, _toxicity int"
    spark.createDataFrame([(i, 1, i % 2) for i in range(30)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    docs = spark.createDataFrame(rows, schema)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        done = stage(spark, docs, str(tmp_path))
        assert done.columns == list(corpus_pipeline.COLUMNS), name
        assert name == "toxicity" or done.count() > 0
    assert corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).count() == 30
