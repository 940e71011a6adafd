"""Array kernels of the model as Columns and small joins: rotary positions, masked attention, sampling, loss."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusmill.session import materialized

ROPE_BASE = 10_000.0


def rope_table(spark: SparkSession, max_len: int, dim: int, base: float = ROPE_BASE) -> DataFrame:
    """pos, pair, cos and sin: the angle is pos / base^(2 pair / dim)."""
    if dim % 2:
        raise ValueError("rotary positions need an even width")
    pairs = F.explode(F.sequence(F.lit(0), F.lit(dim // 2 - 1))).alias("pair")
    angle = F.col("pos") * F.pow(F.lit(base), -2.0 * F.col("pair") / dim)
    return spark.range(max_len).withColumnRenamed("id", "pos").select("pos", pairs).select("pos", "pair", F.cos(angle).alias("cos"), F.sin(angle).alias("sin"))


def rope_rotate(vector: Column, position: Column, dim: int, base: float = ROPE_BASE) -> Column:
    """The vector with neighbouring components (2i, 2i + 1) turned by the angle of the position and the pair."""

    def turned(i: Column) -> Column:
        pair = F.floor(i / 2)
        angle = position * F.pow(F.lit(base), -2.0 * pair / dim)
        x = F.get(vector, i.cast("int")).cast("double")
        other = F.when(i % 2 == 0, -F.get(vector, (i + 1).cast("int"))).otherwise(F.get(vector, (i - 1).cast("int"))).cast("double")
        return x * F.cos(angle) + other * F.sin(angle)

    return F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), turned)


def top_k_softmax(logits: DataFrame, keys: list[str], value: str, k: int, temperature: float = 1.0) -> DataFrame:
    """logits with probability over the k largest of each key; ties with the kth stay, smaller ones have 0."""
    scaled = logits.withColumn("_x", F.col(value).cast("double") / temperature)
    own = Window.partitionBy(*keys)
    kept = scaled.withColumn("_kept", F.rank().over(own.orderBy(F.desc("_x"))) <= k).withColumn("_e", F.when(F.col("_kept"), F.exp(F.col("_x") - F.max("_x").over(own))).otherwise(0.0))
    return kept.withColumn("probability", F.col("_e") / F.sum("_e").over(own)).drop("_x", "_kept", "_e")


def pick_token(probabilities: DataFrame, keys: list[str], token: str, draw: Column) -> DataFrame:
    """One token for each key by inverse distribution: the first whose running probability is above draw, in [0, 1)."""
    run = Window.partitionBy(*keys).orderBy(token).rowsBetween(Window.unboundedPreceding, 0)
    reached = probabilities.where("probability > 0").withColumn("_run", F.sum("probability").over(run)).withColumn("_draw", draw)
    last = reached.groupBy(*keys).agg(F.min(F.when(F.col("_run") > F.col("_draw"), F.col(token))).alias("_first"), F.max(token).alias("_last"))
    return last.select(*keys, F.coalesce("_first", "_last").alias(token))


def _once(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value evaluated once for each row."""
    return F.transform(F.array(value), body)[0]


def next_token(logits: Column, draw: Column, k: int, temperature: float = 1.0) -> Column:
    """The place in logits that draw, in [0, 1), falls on: top_k_softmax() and pick_token() within one row."""
    first = F.lit(0).cast("int")

    def picked(x: Column) -> Column:
        kth, top = F.element_at(F.sort_array(x, asc=False), F.least(F.lit(k), F.size(x))), F.array_max(x)
        return _once(F.struct(kth.alias("kth"), top.alias("top")), lambda b: _once(F.transform(x, lambda v: F.when(v >= b["kth"], F.exp(v - b["top"])).otherwise(0.0)), found))

    def found(weights: Column) -> Column:
        return _once(F.aggregate(weights, F.lit(0.0), lambda s, w: s + w) * draw, lambda goal: reached(weights, goal))

    def reached(weights: Column, goal: Column) -> Column:
        """The number of places whose running sum does not exceed the goal; at most the last place that has a weight."""
        state = F.struct(F.lit(0.0).alias("sum"), first.alias("n"), first.alias("at"), first.alias("last"))

        def step(s: Column, w: Column) -> Column:
            total = s["sum"] + w
            return F.struct(total.alias("sum"), (s["n"] + 1).alias("n"), F.when(total <= goal, s["n"] + 1).otherwise(s["at"]).alias("at"), F.when(w > 0, s["n"]).otherwise(s["last"]).alias("last"))

        return F.aggregate(weights, state, step, lambda s: F.least(s["at"], s["last"]))

    return _once(F.transform(logits, lambda v: v.cast("double") / temperature), picked)


def generate(prompts: DataFrame, model: Callable[[DataFrame, int], DataFrame], ctx_len: int, max_new: int, eos_id: int | None = None, cut_every: int = 16) -> DataFrame:
    """prompts with their tokens continued by up to max_new tokens, never beyond ctx_len; the end mark stops a row and is not kept.

    model(rows, step) gives the rows with a column next: the token after tokens, or null to stop. It may join, or score in Arrow
    batches; what it gives for rows that are done is not read. Lineage is cut every cut_every steps.
    """
    columns = prompts.columns
    rows = prompts.withColumn("_room", F.least(F.lit(max_new), F.lit(ctx_len) - F.size("tokens"))).withColumn("_live", F.lit(True))
    for step in range(max_new):
        scored = model(rows, step)
        goes_on = F.col("_live") & (F.col("_room") > step) & F.col("next").isNotNull()
        if eos_id is not None:
            goes_on &= F.col("next") != eos_id
        rows = scored.withColumn("_live", F.coalesce(goes_on, F.lit(False))).withColumn("tokens", F.when(F.col("_live"), F.array_append("tokens", F.col("next"))).otherwise(F.col("tokens"))).select(*columns, "_room", "_live")
        if (step + 1) % cut_every == 0 and step + 1 < max_new:
            rows = materialized(rows)
    return rows.select(*columns)


def token_loss(logits: Column, target: Column, ignored: int = -100) -> Column:
    """Negative log likelihood of the target's logit, null where the target is ignored."""
    top = F.array_max(logits).cast("double")
    total = F.aggregate(logits, F.lit(0.0), lambda s, x: s + F.exp(x.cast("double") - top))
    return F.when(target != ignored, F.log(total) + top - F.get(logits, target.cast("int")).cast("double"))


def cross_entropy(rows: DataFrame, logits: Column, target: Column) -> DataFrame:
    """n_targets, loss (the mean over targets that count; null without any) and perplexity."""
    loss = rows.select(token_loss(logits, target).alias("nll")).agg(F.count("nll").alias("n_targets"), F.avg("nll").alias("loss"))
    return loss.withColumn("perplexity", F.exp("loss"))


def allowed_pairs(rows: DataFrame, window: str, segment: str, position: str, pad: str | None = None) -> DataFrame:
    """window, i and j: what each place may attend to, itself and earlier places of its segment. Windows are of bounded length.

    pad: a column that is true at padding, which no place may attend to.
    """
    left = rows.select(F.col(window).alias("w"), F.col(segment).alias("s"), F.col(position).alias("i"))
    seen = rows.where(~F.col(pad)) if pad else rows
    right = seen.select(F.col(window).alias("w2"), F.col(segment).alias("s2"), F.col(position).alias("j"))
    return left.join(right, (F.col("w") == F.col("w2")) & (F.col("s") == F.col("s2")) & (F.col("j") <= F.col("i"))).select(F.col("w").alias(window), "i", "j")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def attention_weights(rows: DataFrame, window: str, segment: str, position: str, vector: str, dim: int, pad: str | None = None) -> DataFrame:
    """window, i, j and weight: the softmax of scaled products over the allowed pairs."""
    vectors = rows.select(F.col(window).alias("vw"), F.col(position).alias("vp"), F.col(vector).alias("v"))
    pairs = allowed_pairs(rows, window, segment, position, pad)
    q = vectors.select(F.col("vw").alias("qw"), F.col("vp").alias("qp"), F.col("v").alias("q"))
    k = vectors.select(F.col("vw").alias("kw"), F.col("vp").alias("kp"), F.col("v").alias("k"))
    met = pairs.join(q, (F.col(window) == F.col("qw")) & (F.col("i") == F.col("qp"))).join(k, (F.col(window) == F.col("kw")) & (F.col("j") == F.col("kp")))
    scored = met.select(window, "i", "j", (dot(F.col("q"), F.col("k")) / dim**0.5).alias("x"))
    own = Window.partitionBy(window, "i")
    raised = scored.withColumn("e", F.exp(F.col("x") - F.max("x").over(own)))
    return raised.select(window, "i", "j", (F.col("e") / F.sum("e").over(own)).alias("weight"))


def clip_to_norm(vector: Column, limit: float = 1.0) -> Column:
    """The vector scaled down to a length of at most limit."""
    norm = F.sqrt(dot(vector, vector))
    return F.transform(F.array(norm), lambda n: F.transform(vector, lambda x: x.cast("double") * F.least(F.lit(1.0), F.lit(limit) / F.greatest(n, F.lit(1e-300)))))[0]
