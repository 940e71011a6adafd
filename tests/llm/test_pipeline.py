import os
import shutil
import subprocess
import sys
from pathlib import Path

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from corpusmill.llm.near_dup import near_duplicates
from corpusmill.llm.pii import find_spans
from tests.llm.tables import edge_docs, no_docs, table
from tests.llm.test_decontam import brute_force as leaks
from tests.llm.test_duplicates import brute_force as components
from tests.llm.test_packing import check, slow  # noqa: F401

ROOT = Path(__file__).resolve().parents[2]


def test_stages():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_duplicates", "decontamination", "pii", "packing"]


def test_stages_against_brute_force(spark, sf_dir, tmp_path, slow):  # noqa: F811
    docs = table(spark, sf_dir, "documents")
    columns, kept = docs.columns, []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, sf_dir)
        out.write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        kept.append([r.asDict() for r in docs.collect()])
        if k < 4:
            assert docs.columns == columns
    texts = [{r["doc_id"]: r["text"] for r in rows} for rows in kept[:4]]
    assert set(texts[1]) == {i for i, (_, c) in components(texts[0], 80).items() if i == c}
    items = [tuple(r) for r in table(spark, sf_dir, "benchmark").select("item_id", "text").collect()]
    found = {i for i, _, _ in leaks(list(texts[1].items()), items)}
    assert set(texts[2]) == set(texts[1]) - found
    assert set(texts[3]) == set(texts[2])
    assert all(r["n_chars"] == len(r["text"]) for r in kept[3])
    assert any(texts[3][i] != texts[2][i] for i in texts[3])
    assert all(texts[3][i] == texts[2][i] or find_spans(texts[2][i]) for i in texts[3])
    rows = spark.read.parquet(str(tmp_path / "4")).collect()
    check(rows, list(texts[3].items()), slow)
    assert corpus_pipeline.run(spark, sf_dir).count() == len(rows)


def test_stages_take_awkward_tables(spark, sf_dir):
    for docs in (edge_docs(spark), no_docs(spark)):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            assert stage(spark, docs, sf_dir).columns == docs.columns
        assert corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir).count() >= docs.select("doc_id").count()


def test_similarity_is_an_option(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    assert near_duplicates(docs, 100).where("kept").count() >= near_duplicates(docs, 80).where("kept").count()


def test_rest_works_without_this_subpackage(tmp_path):
    for name in ("corpusmill", "__spark_entry__.py"):
        (shutil.copytree if (ROOT / name).is_dir() else shutil.copy)(ROOT / name, tmp_path / name)
    shutil.rmtree(tmp_path / "corpusmill" / "llm")
    code = "import __spark_entry__ as e; q = e.queries(); assert 'word_counts' in q and not any(n.startswith('op') for n in q) and 'pipeline' not in q; assert set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env=os.environ | {"PYTHONPATH": str(tmp_path)})


def test_import_errors_are_not_hidden(tmp_path):
    for name in ("corpusmill", "__spark_entry__.py", "corpus_pipeline.py"):
        (shutil.copytree if (ROOT / name).is_dir() else shutil.copy)(ROOT / name, tmp_path / name)
    (tmp_path / "corpusmill" / "llm" / "pii.py").write_text("import no_such_module\n")
    done = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; e.queries()"], cwd=tmp_path, env=os.environ | {"PYTHONPATH": str(tmp_path)}, capture_output=True)
    assert done.returncode != 0


@pytest.mark.parametrize("name", ["op1_license_scan", "op10_packing"])
def test_registered(name):
    import __spark_entry__

    assert name in __spark_entry__.queries()


def test_toxic_documents_go(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    kept = corpus_pipeline.drop_toxic(spark, docs, sf_dir)
    labels = {r["doc_id"]: r["toxic"] for r in table(spark, sf_dir, "labels").collect()}
    gone = {r["doc_id"] for r in docs.select("doc_id").exceptAll(kept.select("doc_id")).collect()}
    known = [i for i in gone if i in labels]
    assert not known or sum(labels[i] for i in known) >= 0.5 * len(known)
    assert kept.where(F.col("doc_id").isNull()).count() == 0
