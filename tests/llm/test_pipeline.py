"""The pipeline's stages against brute force, and every query on its oracle or its contract."""

import duckdb
import pytest
from conftest import SF
from test_entry import _rows as normal
from kiln.plans.tables import TABLES

import __spark_entry__ as entry
import corpus_pipeline
from kiln.llm import queries
from llm.test_decontaminate import brute as leaks
from llm.test_secret_scan import base
from llm.test_simhash import plain_components, plain_fingerprint


def test_registered():
    names = entry.queries()
    assert all(sum(n.startswith(f"op{k}_") for n in names) == 1 for k in range(1, 11)) and "pipeline" in names


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_oracles(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    assert normal(entry.queries()[name](spark, SF).toPandas()) == normal(con.execute(queries.ORACLE[name]).df())


def _pairs(df):
    return sorted((r.doc_id, r.text) for r in df.collect())


def test_stages(spark):
    docs = queries.table(spark, SF, "documents")
    labels = {r.doc_id: r.quality for r in queries.table(spark, SF, "labels").collect()}
    kept = corpus_pipeline.quality(spark, docs, SF)
    ids = {r.doc_id for r in kept.select("doc_id").collect()}
    wrong = [i for i, q in labels.items() if (i in ids) != (q == 1)]
    assert kept.columns == docs.columns and len(wrong) <= 0.1 * len(labels)
    assert all(i in ids for i, q in labels.items() if q == 1)  # clean documents stay

    alone = corpus_pipeline.near_duplicates(spark, kept, SF)
    items = [(i, plain_fingerprint(t)) for i, t in _pairs(kept)]
    groups = plain_components(items, 2)
    assert [i for i, _ in _pairs(alone)] == sorted(set(groups.values()))

    clean = corpus_pipeline.decontamination(spark, alone, SF)
    bench = [(r.item_id, r.text) for r in queries.table(spark, SF, "benchmark").collect()]
    found = {d for d, *_ in leaks(_pairs(alone), bench)}
    assert [i for i, _ in _pairs(clean)] == [i for i, _ in _pairs(alone) if i not in found]

    cut = corpus_pipeline.secrets(spark, clean, SF)
    after = dict(_pairs(cut))
    for i, t in _pairs(clean):
        assert not base(after[i]) and (after[i] == t or "[secret]" in after[i])
        assert after[i] == t or base(t)
    assert cut.columns == docs.columns and cut.where("n_chars != length(text)").count() == 0


def test_run(spark):
    got = corpus_pipeline.run(spark, SF)
    assert got.columns == ["doc_id", "lang", "source", "n_tokens", "ids", "decoded"]
    assert got.count() > 50 and got.where("n_tokens != size(ids)").count() == 0


def test_awkward_table(spark, messy):
    docs = messy
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF)
        assert docs.columns == messy.columns
    assert docs.where("ids != 'x' or score != 'x' or found != 'x'").count() == 0
    assert corpus_pipeline.tokens(spark, docs, SF).count() == docs.count() > 20


def test_empty_table(spark, empty):
    docs = empty
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
    assert docs.collect() == []
