"""Running sums, windows, samples and batches on hand-checked cases."""

from pyspark.sql import functions as F

from corpusmill.operators import chat, corpus, sft, windows
from corpusmill.operators.report import validate_stored

E = 0


def index(spark):
    return spark.createDataFrame([(0, 1, "s", 3, 0, 0), (1, 2, "s", 2, 3, 3), (2, 3, "s", 4, 5, 5)], "pos long, doc_id long, source string, length long, local_offset long, global_offset long")


def test_windows(spark):
    tokens = spark.createDataFrame([(1, [1, 2, E]), (2, [3, E]), (3, [4, 5, 6, E])], "doc_id long, tokens array<int>")
    starts = spark.createDataFrame([(0, "T", 1), (1, "T", 3), (2, "T", 5)], "window_id long, split string, start long")
    got = {r["window_id"]: r for r in windows.packed_windows(starts, index(spark), tokens, 3, E).collect()}
    assert [got[i]["input_tokens"] for i in range(3)] == [[2, E, 3], [3, E, 4], [4, 5, 6]]
    assert [got[i]["output_tokens"] for i in range(3)] == [[E, 3, E], [E, 4, 5], [5, 6, E]]
    assert [got[i]["segment_ids"] for i in range(3)] == [[1, 1, 2], [1, 1, 2], [1, 1, 1]]
    assert [got[i]["position_ids"] for i in range(3)] == [[0, 1, 0], [0, 1, 0], [0, 1, 2]]
    at = {r["window_id"]: (r["doc_id"], r["doc_start"]) for r in windows.docs_at(starts, index(spark), block=2).collect()}
    assert at == {0: (1, 1), 1: (2, 0), 2: (3, 0)}


def test_bounds(spark):
    rows = {r["split"]: (r["start_idx"], r["end_idx"]) for r in corpus.split_bounds(index(spark), 1, 3).collect()}
    assert rows == {"TRAIN": (0, 1), "VAL": (5, 5)}
    none = {r["split"]: (r["start_idx"], r["end_idx"]) for r in corpus.split_bounds(index(spark), 0, 3).collect()}
    assert none == {"TRAIN": (0, 5), "VAL": (9, 9)}
    bounds = corpus.split_bounds(index(spark), 1, 3)
    assert windows.window_starts(bounds, F.lit(5)).where("split = 'VAL'").count() == 0
    assert {r["start"] for r in windows.window_starts(bounds, F.lit(5)).collect()} == {0}


def test_running_sum_over_blocks(spark):
    n = 5000
    df = spark.range(n).select((F.col("id") * 7919 % n).alias("k"), (F.col("id") % 13 + 1).alias("v"), (F.col("id") % 3).alias("g"))
    got = corpus.running_sum(df, "v", F.floor(F.col("k") / 100), ["k"], ["g"]).collect()
    by = {}
    for r in sorted(got, key=lambda r: r["k"]):
        total, count = by.get(r["g"], (0, 0))
        assert (r["offset"], r["offset_pos"]) == (total, count)
        by[r["g"]] = (total + r["v"], count + 1)


def test_shuffled_index_is_a_permutation(spark):
    lengths = spark.range(300).select(F.concat(F.lit("s"), (F.col("id") % 4).cast("string")).alias("source"), F.col("id").alias("doc_id"), (F.col("id") % 9).alias("length"))
    rows = sorted(corpus.shuffled_index(lengths).collect(), key=lambda r: r["pos"])
    assert [r["pos"] for r in rows] == list(range(300))
    total = 0
    for r in rows:
        assert r["global_offset"] == total
        total += r["length"]
    assert [r["doc_id"] for r in rows] != list(range(300))


MASKS = [
    ([5, 100, 6, 7, 101, 8, 9, 0, 100, 3, 101, 4, 0], [-100, -100, -100, -100, 8, 9, 0, -100, -100, -100, 4, 0]),
    ([100, 6, 100, 7, 101, 8, 0], [-100, 100, 7, -100, -100, -100]),
    ([100, 6, 101, 7, 0], [-100, -100, 7, 0]),
    ([5, 6, 100, 7, 101, 8, 0], [6, -100, -100, -100, 8, 0]),
    ([5], []),
]


def test_loss_mask(spark):
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(MASKS)], "i int, tokens array<int>")
    got = {r["i"]: r["output_tokens"] for r in sft.sft_samples(df, 100, 101, 0).collect()}
    assert [got[i] for i in range(len(MASKS))] == [o for _, o in MASKS]
    only = {r["i"]: r["output_tokens"] for r in sft.sft_samples(df, 100, 101, 0, mask="assistant_only").collect()}
    assert only[1] == [-100, -100, -100, -100, 8, 0]
    assert only[3] == [-100, -100, -100, -100, 8, 0]


def test_padding(spark):
    df = spark.createDataFrame([(0, [100, 6, 101], [-100, -100, 7]), (1, [100], [9]), (2, [1], [2])], "pos long, input_tokens array<int>, output_tokens array<int>")
    rows = sorted(sft.padded_batches(df, 2, 2).collect(), key=lambda r: r["pos"])
    assert [(r["input_tokens"], r["output_tokens"], r["pad_mask"]) for r in rows] == [([100, 6, 101], [-100, -100, 7], [False] * 3), ([100, 2, 2], [9, -100, -100], [False, True, True])]
    assert sft.padded_batches(df, 2, 2, drop_last=False).count() == 3


def test_split_without_validation(spark):
    df = spark.createDataFrame([(i, [1]) for i in range(6)], "k long, tokens array<int>")
    count = lambda n: {r["split"]: r["count"] for r in sft.shuffled_split(df, "k", n).groupBy("split").count().collect()}
    assert count(0) == {"TRAIN": 6}
    assert count(2) == {"TRAIN": 4, "VAL": 2}


def test_rendering(spark):
    turns = [(1, 0, "user", "q1"), (1, 1, "assistant", "a1"), (1, 2, "user", "q2"), (2, 0, "user", "q1"), (2, 1, "assistant", "a1"), (3, 0, None, None)]
    got = {r["conv_id"]: r["chat"] for r in chat.render_conversations(spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")).collect()}
    assert got == {1: "<user>q1<assistant>a1<eos><user>q2", 2: "<user>q1<assistant>a1", 3: "<>"}
    cell = lambda c: spark.range(1).select(c.alias("x")).first()["x"]
    assert cell(chat.render_instruction(F.lit("i"), F.lit(""), F.lit("r"))) == "<user>i<assistant>r"
    assert cell(chat.render_instruction(F.lit("i"), F.lit("c"), F.lit("r"))) == "<user>i Context: c<assistant>r"
    assert cell(chat.render_instruction(F.lit("i"), F.lit(None).cast("string"), F.lit("r"))) == "<user>i<assistant>r"
    assert cell(chat.render_translation(F.lit("x"), F.lit("y"))) == ["<user>Translate from english to hindi: x<assistant>y", "<user>Translate from hindi to english: y<assistant>x"]


def test_validation_sees_any_difference(spark):
    docs = spark.createDataFrame([("s", i, i) for i in range(6)], "source string, doc_id long, x int")
    stored = spark.createDataFrame([(0, [0]), (1, [9]), (2, [2, 2]), (3, [3]), (4, None)], "doc_id long, tokens array<int>")
    r = validate_stored(docs, stored, F.array("x"), 10).first()
    assert (r["n_checked"], r["n_missing"], r["n_mismatch"]) == (6, 1, 3)
