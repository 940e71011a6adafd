"""Whole jobs and their command line: python -m corpusmill.jobs JOB --help."""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill import schemas
from corpusmill.functions.text import clean_text, nfc, replace_names
from corpusmill.operators import bpe, chat, corpus, counts, report, sft
from corpusmill.session import build_session
from corpusmill.sources import files, tokens

SEED = 42
#: Names that placeholders are replaced with; any list will do.
NAMES = ["Aarav Sharma", "Diya Patel", "Ishaan Gupta", "Kavya Nair", "Rohan Mehta", "Saanvi Reddy", "Vihaan Rao", "Ananya Iyer", "Arjun Singh", "Meera Joshi", "Kabir Das", "Nisha Verma"]


def _corpus(spark: SparkSession, english: str, hindi: str, n_english: int, n_hindi: int, use: str, seed: int = SEED) -> DataFrame:
    """Selected and cleaned documents of sampled files, English first."""
    parts = []
    for folder, n, schema, lang in ((english, n_english, schemas.ENGLISH_DOC, "en"), (hindi, n_hindi, schemas.PLAIN_DOC, "hi")):
        if n:
            paths = files.sample_files(files.list_files(spark, folder), n, seed)
            docs = files.read_documents(spark, paths, schema, lang)
            kept = counts.select_docs(docs, (lang,), scored=("en",) if lang == "en" else (), use=use)
            parts.append(kept.select("lang", "source", "doc_id", clean_text(F.col("text")).alias("clean")))
    out = parts[0]
    for p in parts[1:]:
        # Ids of the second read begin anew: they go above those of the first.
        out = out.unionByName(p.withColumn("doc_id", F.col("doc_id") + F.lit(1 << 60)))
    return out


def train_tokenizer(spark: SparkSession, english: str, hindi: str, n_english: int, n_hindi: int, vocab_size: int, out: str) -> bpe.BpeModel:
    docs = _corpus(spark, english, hindi, n_english, n_hindi, "tokenizer")
    model = bpe.train(counts.word_counts(docs, nfc(F.col("clean"))), vocab_size).with_specials(bpe.BASE_SPECIALS)
    model.save(spark, out)
    return model


def build_corpus(spark: SparkSession, english: str, hindi: str, n_english: int, n_hindi: int, tokenizer: str, out: str, seed: int = SEED) -> None:
    """Token store, offsets and the shuffled index, as Parquet."""
    model = bpe.BpeModel.load(spark, tokenizer)
    docs = _corpus(spark, english, hindi, n_english, n_hindi, "corpus", seed)
    encoded = docs.select("lang", "source", "doc_id", F.array_append(bpe.encode(F.col("clean"), model), F.lit(model.specials["<eos>"])).alias("tokens"))
    encoded.write.mode("overwrite").parquet(f"{out}/tokens")
    lengths = spark.read.parquet(f"{out}/tokens").select("source", "doc_id", F.size("tokens").cast("long").alias("length"))
    corpus.doc_offsets(lengths).write.mode("overwrite").parquet(f"{out}/offsets")
    corpus.shuffled_index(lengths, seed).write.mode("overwrite").parquet(f"{out}/index")


def render_all(spark: SparkSession, folder: str) -> DataFrame:
    """dataset, path, row, part and chat of all instruction files, by the kind of their folder; unknown folders are an error.

    row is a hash of the line, part the number of a chat among those of its line: an order that hangs on no setting of the read.
    """
    raw = spark.read.option("pathGlobFilter", "*.jsonl").option("recursiveFileLookup", "true").text(folder).select("value", F.element_at(F.split(F.input_file_name(), "/"), -2).alias("dataset"), F.input_file_name().alias("path"))
    parse = lambda schema: F.from_json("value", schema)
    m, i, p, t = parse(schemas.MESSAGES), parse(schemas.INSTRUCTION), parse(schemas.INPUT_TARGET), parse(schemas.TRANSLATION)
    rendered = chat.render_messages(m["messages"])
    named = replace_names(rendered, F.md5("value"), NAMES, SEED)
    chats = (
        F.when(F.col("dataset").isin(*chat.MESSAGE_SETS), F.array(rendered))
        .when(F.col("dataset").isin(*chat.NAMED_SETS), F.array(named))
        .when(F.col("dataset") == "dolly", F.array(chat.render_instruction(i["instruction"], i["context"], i["response"])))
        .when(F.col("dataset") == "flan_v2", F.array(chat.render_pair(p["inputs"], p["targets"])))
        .when(F.col("dataset") == "nmt-seed", chat.render_translation(t["input_text"], t["output_text"]))
        .otherwise(F.raise_error(F.concat(F.lit("unknown dataset: "), "dataset")).cast("array<string>"))
    )
    return raw.select("dataset", "path", F.xxhash64("value").alias("row"), F.posexplode(chats).alias("part", "chat"))


def build_sft(spark: SparkSession, folder: str, tokenizer: str, out: str) -> bpe.BpeModel:
    """Rendered, cleaned and encoded chats with their ids and offsets; the tokenizer with the two chat tokens is saved too."""
    model = bpe.BpeModel.load(spark, tokenizer).with_specials(bpe.CHAT_SPECIALS)
    model.save(spark, f"{out}/tokenizer")
    chats = render_all(spark, folder).select("dataset", "path", "row", "part", clean_text(F.col("chat")).alias("chat"))
    encoded = chats.select("dataset", "path", "row", "part", F.array_append(bpe.encode(F.col("chat"), model), F.lit(model.specials["<eos>"])).alias("tokens"))
    encoded.write.mode("overwrite").parquet(f"{out}/chats")
    stored = spark.read.parquet(f"{out}/chats")
    numbered = sft.sample_offsets(stored, ["dataset", "path", "row", "part"], F.struct("dataset", "path", F.shiftright("row", 54)))
    numbered.select("id", "dataset", "offset", "length", "tokens").write.mode("overwrite").parquet(f"{out}/samples")
    return model


def validate(spark: SparkSession, english: str, hindi: str, n_english: int, n_hindi: int, tokenizer: str, store: str, n_docs: int, out: str) -> None:
    """Documents of each source encoded anew and compared with the store."""
    model = bpe.BpeModel.load(spark, tokenizer)
    fresh = F.array_append(bpe.encode(F.col("clean"), model), F.lit(model.specials["<eos>"]))
    docs = _corpus(spark, english, hindi, n_english, n_hindi, "corpus")
    report.validate_stored(docs, tokens.read_store(spark, f"{store}/tokens"), fresh, n_docs).write.mode("overwrite").parquet(out)


def evaluate(spark: SparkSession, path: str, n_rows: int, lang: str, tokenizer: str, out: str) -> None:
    """A report of tokens for each word and round-trip failures, as indented JSON. Failures are numbered among the rows that were read."""
    schema = {"english": schemas.ENGLISH_DOC, "hindi": schemas.PLAIN_DOC}[lang]
    code = lang[:2]
    model = bpe.BpeModel.load(spark, tokenizer)
    docs = counts.select_docs(files.read_documents(spark, [path], schema, code), (code,), scored=("en",) if code == "en" else (), use="evaluation")
    picked = corpus.numbered(files.head_rows(docs, "doc_id", n_rows), "doc_id").select("lang", "index", clean_text(F.col("text")).alias("clean"))
    coded = picked.withColumn("ids", bpe.encode(F.col("clean"), model)).withColumn("decoded", bpe.decode(F.col("ids"), model))
    words = report.tokens_per_word(coded, F.col("clean"), F.size("ids"), ["lang"])
    trips = report.round_trip(coded, "index", F.col("clean"), F.col("decoded"), ["lang"])
    shown = report.failure_examples(coded, "index", "clean", "decoded").agg(F.collect_list(F.struct("index", "original", "decoded")).alias("failure_examples"))
    full = trips.join(words.drop("n_docs"), "lang", "left").crossJoin(F.broadcast(shown))  # one row on the right
    metrics = F.struct(F.col("avg_tokens_per_word"), F.col("n_failures").alias("num_round_trip_failures")).alias("metrics")
    fields = F.struct(F.lit(lang).alias("language"), F.col("n_docs").alias("num_samples"), metrics, F.col("failure_examples"))
    full.select(F.to_json(fields, {"pretty": "true"})).coalesce(1).write.mode("overwrite").text(out)


def main(args: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(description=__doc__)
    jobs = parser.add_subparsers(dest="job", required=True)
    both = [("eng_data_dir", str), ("hin_data_dir", str), ("num_eng_files", int), ("num_hin_files", int)]
    flags = {
        "train-tokenizer": [*both, ("vocab_size", int), ("save_tokenizer_state", str)],
        "build-corpus": [*both, ("tokenizer_state", str), ("save_dir", str)],
        "build-sft": [("sft_data_dir", str), ("tokenizer_state", str), ("save_dir", str)],
        "validate": [*both, ("tokenizer_state", str), ("cleaned_data_dir", str), ("num_docs_to_test", int), ("output", str)],
        "evaluate": [("parquet_file", str), ("num_rows", int), ("lang", str), ("tokenizer_state", str), ("output_json", str)],
    }
    for job, own in flags.items():
        sub = jobs.add_parser(job)
        for name, kind in own:
            sub.add_argument(f"--{name}", type=kind, required=True)
    given = vars(parser.parse_args(args))
    job = given.pop("job")
    run = {"train-tokenizer": train_tokenizer, "build-corpus": build_corpus, "build-sft": build_sft, "validate": validate, "evaluate": evaluate}[job]
    run(build_session(f"corpusmill-{job}"), *(given[name] for name, _ in flags[job]))


if __name__ == "__main__":
    main()
