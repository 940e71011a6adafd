"""Whole jobs over small files, token files, and the stream."""

import json

import pytest
from pyspark.sql import functions as F

from corpusmill import jobs
from corpusmill.operators import bpe
from corpusmill.sources import files, tokens
from corpusmill.streaming.word_counts import start_word_counts, total_counts


def sentences(n, lang):
    words = {"en": "the cat sat on a mat and ran far away from home again", "hi": "नमस्ते दुनिया आप कैसे हैं मैं ठीक हूँ धन्यवाद"}[lang].split()
    return [" ".join(words[(i * k) % len(words)] for k in range(1, 40)) for i in range(1, n + 1)]


@pytest.fixture(scope="module")
def folders(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("corpus")
    for k in range(3):
        spark.createDataFrame([(t, 0.9) for t in sentences(20, "en")], "text string, language_score double").coalesce(1).write.mode("append").parquet(str(root / "en"))
    spark.createDataFrame([(t,) for t in sentences(10, "hi")], "text string").coalesce(1).write.parquet(str(root / "hi"))
    for name, record in {"oasst1": {"messages": [{"role": "user", "content": "hi"}, {"role": "assistant", "content": "yo"}, {"role": "user", "content": "bye"}]}, "dolly": {"instruction": "i", "context": "", "response": "r"}, "flan_v2": {"inputs": "a", "targets": "b"}, "nmt-seed": {"input_text": "x", "output_text": "y"}, "lm_sys": {"messages": [{"role": "user", "content": "I am NAME_1"}]}}.items():
        (root / "sft" / name).mkdir(parents=True)
        (root / "sft" / name / "part.jsonl").write_text(json.dumps(record) + "\n")
    return root


def test_all_jobs(spark, folders):
    path = lambda x: str(folders / x)
    model = jobs.train_tokenizer(spark, path("en"), path("hi"), 2, 1, 300, path("tok"))
    assert len(model.merges) == 44
    assert model.specials["<eos>"] == 300
    jobs.build_corpus(spark, path("en"), path("hi"), 2, 1, path("tok"), path("out"))
    stored = spark.read.parquet(path("out/tokens"))
    assert stored.count() == 50
    assert stored.where(F.element_at("tokens", -1) != 300).count() == 0
    index = spark.read.parquet(path("out/index"))
    assert index.agg(F.sum("length")).first()[0] == stored.agg(F.sum(F.size("tokens"))).first()[0]
    jobs.validate(spark, path("en"), path("hi"), 2, 1, path("tok"), path("out"), 5, path("checked"))
    assert {(r["n_checked"], r["n_missing"], r["n_mismatch"]) for r in spark.read.parquet(path("checked")).collect()} == {(5, 0, 0)}
    jobs.build_sft(spark, path("sft"), path("tok"), path("sft_out"))
    samples = spark.read.parquet(path("sft_out/samples")).orderBy("id").collect()
    assert [s["id"] for s in samples] == list(range(6))
    assert [s["offset"] for s in samples] == [sum(x["length"] for x in samples[:i]) for i in range(6)]
    chats = {r["chat"] for r in jobs.render_all(spark, path("sft")).collect()}
    assert "<user>hi<assistant>yo<eos><user>bye" in chats
    assert not any("NAME_" in c for c in chats)
    first = files.list_files(spark, path("en"))[0]
    jobs.evaluate(spark, first, 10, "english", path("tok"), path("report"))
    assert (spark.read.text(path("report")).collect()[1]["value"]).startswith("  ")
    report = spark.read.json(path("report"), multiLine=True).first()
    assert report["num_samples"] == 10
    assert report["metrics"]["num_round_trip_failures"] == 0


def test_file_sampling(spark, folders):
    paths = files.list_files(spark, str(folders / "en"))
    assert len(paths) == 3
    assert files.sample_files(paths, 2) == files.sample_files(paths[::-1], 2)
    with pytest.raises(ValueError, match="asked for"):
        files.sample_files(paths, 4)


def test_flat_tokens(spark):
    df = spark.createDataFrame([(1, [0, 65535, 7]), (2, [])], "doc_id long, tokens array<int>")
    packed = tokens.packed_bytes(df)
    assert {r["id"]: bytes(r["raw"]) for r in packed.collect()}[1] == b"\x00\x00\xff\xff\x07\x00"
    assert {r["id"]: r["tokens"] for r in tokens.unpacked_tokens(packed).collect()} == {1: [0, 65535, 7], 2: []}
    with pytest.raises(Exception, match="16 bits"):
        tokens.packed_bytes(spark.createDataFrame([(1, [65536])], "doc_id long, tokens array<int>")).collect()
    assert df.select(tokens.token_slice(F.col("tokens"), 1, 2).alias("t")).first()["t"] == [65535, 7]


@pytest.mark.parametrize("file_tokens", [1 << 20, 7])
def test_flat_files(spark, tmp_path, file_tokens):
    rows = [("a/x.parquet", i, [(i * k) % 65536 for k in range(i % 5)]) for i in range(40)] + [("b/x.parquet", i, [i] * 3) for i in range(100, 110)] + [("c", 7, [65535])]
    df = spark.createDataFrame(rows, "source string, doc_id long, tokens array<int>")
    folder = "file://" + str(tmp_path / "flat")
    listed = tokens.write_flat(df, folder, file_tokens)
    assert not [f.name for f in (tmp_path / "flat").iterdir() if f.name.count(".") > 1]
    streams = {s: [t for source, _, own in rows if source == s for t in own] for s in {r[0] for r in rows}}
    got = {}
    for r in tokens.read_flat(spark, folder, 5).orderBy("source", "start").collect():
        assert len(got.setdefault(r["source"], [])) == r["start"]
        assert len(r["tokens"]) == r["n"] <= 5
        got[r["source"]] += r["tokens"]
    assert got == streams
    asked = spark.createDataFrame([("b/x.parquet", 3, 3), ("b/x.parquet", 4, 2), ("c", 0, 1)], "source string, start long, n long")
    assert {(r["source"], r["start"]): r["tokens"] for r in tokens.flat_slices(asked, listed, folder).collect()} == {("b/x.parquet", 3): [101] * 3, ("b/x.parquet", 4): [101] * 2, ("c", 0): [65535]}
    tokens.write_flat(df, folder, file_tokens)
    assert tokens.read_flat(spark, folder).agg(F.sum("n")).first()[0] == sum(map(len, streams.values()))


def test_scan_sizes(spark, folders):
    sizes = files.scan_sizes(spark, files.list_files(spark, str(folders / "en")), 15).collect()
    assert sorted((r["n_rows"], r["n_batches"]) for r in sizes) == [(20, 2)] * 3


def test_stream_adds_up(spark, folders, tmp_path):
    stream = spark.readStream.schema("text string, language_score double").option("maxFilesPerTrigger", 1).parquet(str(folders / "en"))
    start_word_counts(stream, str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination()
    got = {r["word"]: r["n"] for r in total_counts(spark.read.parquet(str(tmp_path / "out"))).collect()}
    docs = spark.read.parquet(str(folders / "en"))
    from corpusmill.operators.counts import clean_docs, word_counts

    assert got == {r["word"]: r["n"] for r in word_counts(clean_docs(docs), F.col("clean")).collect()}


def test_unknown_dataset(spark, tmp_path):
    (tmp_path / "odd").mkdir()
    (tmp_path / "odd" / "x.jsonl").write_text("{}\n")
    with pytest.raises(Exception, match="unknown dataset"):
        jobs.render_all(spark, str(tmp_path)).collect()


def test_bpe_size():
    assert bpe.BpeModel().with_specials(bpe.BASE_SPECIALS).size == 261
