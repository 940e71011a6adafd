"""Near duplicates: SuperMinHash signatures of word shingles, bands, verification on whole sets, components."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusmill.llm.common import BLANKS, GOLDEN, WordHasher, batch_column, bounded_batches, golden, grams, mixed, release_memory, signed, slices, stored, text_bytes
from corpusmill.llm.components import connected_components

SHINGLE_WORDS = 5
#: A pair of similarity 0.8 shares none of 42 bands of 6 once in 350,000 times, one of 0.85 once in 400 million times.
BANDS, BAND_ROWS = 42, 6
SLOTS = BANDS * BAND_ROWS
SLICE = 1 << 19
#: Slots give one bit each to a sketch of SKETCH longs. Of a pair at the limit that many deviations more bits differ than
#: expected once in ten million times; such a pair is taken for no candidate.
SKETCH, DEVIATIONS = -(-SLOTS // 64), 6
#: Members of a bucket whose pairs are all taken; in larger buckets pairs are found by what they have in common.
SMALL_BUCKET = 16
#: Ids that may be broadcast, 16 MB at most; more are joined by a shuffle.
BROADCAST_IDS = 2_000_000
#: Tasks that the rows of one hot key are dealt to. A key is hot with more rows than this and than one in HOT_KEYS of all rows; so
#: there are HOT_KEYS hot keys at most, and they are broadcast.
SALTS, HOT_ROWS, HOT_KEYS = 16, 10_000, 10_000


_BITS = [f"s{k}" for k in range(SKETCH)]


@lru_cache(maxsize=1)
def _hasher() -> WordHasher:
    """One for each process: its tables of powers are large."""
    return WordHasher(BLANKS, lower=True, seed=7)


def shingle_sets(data: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
    """The sorted 64-bit hashes of each text's distinct shingles; a text with fewer words has one of all of them, or none."""
    words, _, _, first = _hasher().hashes(data, offsets)
    whole = grams(words, SHINGLE_WORDS)
    out = []
    for a, b in zip(first[:-1], first[1:], strict=True):
        if b - a >= SHINGLE_WORDS:
            own = np.sort(whole[a : b - SHINGLE_WORDS + 1])
            out.append(own[np.append(True, own[1:] != own[:-1])])
        else:
            out.append(grams(words[a:b], b - a) if b > a else np.zeros(0, np.uint64))
    return out


def super_minhash(elements: np.ndarray, group: np.ndarray, n_groups: int, slots: int = SLOTS) -> np.ndarray:
    """A signature of each group's elements: a row of slots, each a rank in the upper and a random number in the lower 32 bits.

    Each element deals the ranks 0, 1, 2... to the slots in an order of its own, a Fisher-Yates shuffle seeded by the element, and
    a slot keeps its smallest rank and number. Ranks are dealt to all elements at once; a group is done as soon as the next rank
    is above all its slots, which for many elements is after a few ranks.
    """
    out = np.full(n_groups * slots, np.iinfo(np.uint64).max)
    order = np.tile(np.arange(slots, dtype=np.uint8 if slots <= 256 else np.uint16), (len(elements), 1))
    flat_order, rows, low32 = order.reshape(-1), np.arange(len(elements)), np.uint64(0xFFFFFFFF)
    active = np.zeros(n_groups, bool)
    active[group] = True
    for rank in range(slots):
        if not len(rows):
            break
        drawn = mixed(elements[rows] + golden(rank + 1))
        pick = rank + ((drawn >> np.uint64(32)) * np.uint64(slots - rank) >> np.uint64(32)).astype(np.int64)
        slot = flat_order[rows * slots + pick].astype(np.int64)
        flat_order[rows * slots + pick] = flat_order[rows * slots + rank]
        np.minimum.at(out, group[rows] * slots + slot, np.uint64(rank) << np.uint64(32) | drawn & low32)
        busy = np.flatnonzero(active)
        done = out.reshape(n_groups, slots)[busy].max(axis=1) < np.uint64(rank + 1) << np.uint64(32)
        if done.any():
            active[busy[done]] = False
            rows = rows[active[group[rows]]]
    return out.reshape(n_groups, slots)


def band_keys(signatures: np.ndarray, bands: int = BANDS) -> np.ndarray:
    """A 64-bit key of each band of each signature; it holds the band's number."""
    parts = signatures.reshape(len(signatures), bands, -1)
    key = np.full(parts.shape[:2], GOLDEN) * np.arange(1, bands + 1, dtype=np.uint64)
    for k in range(parts.shape[2]):
        key = mixed(key ^ mixed(parts[:, :, k] + golden(k + 1)))
    return key


def sketches(signatures: np.ndarray) -> np.ndarray:
    """SKETCH longs for each signature: a bit of each slot; slots that agree give equal bits, others in half the cases."""
    bits = np.zeros((len(signatures), 64 * SKETCH), np.uint8)
    bits[:, :SLOTS] = mixed(signatures) >> np.uint64(63)
    return np.packbits(bits, axis=1, bitorder="little").view("<i8")


def most_bits(percent: int) -> int:
    """Bits in which the sketches of a pair at the limit may differ."""
    share = (1 - percent / 100) / 2
    return int(SLOTS * share + DEVIATIONS * (SLOTS * share * (1 - share)) ** 0.5) + 1


def _alike(left: list[str], right: list[str], percent: int) -> Column:
    """Whether two rows' sketches, in these columns, differ in so few bits that their texts may be similar enough."""
    return sum((F.bit_count(F.col(x).bitwiseXOR(F.col(y))) for x, y in zip(left, right, strict=True)), F.lit(0)) <= most_bits(percent)


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, offsets = text_bytes(batch_column(batch, "text"))
        ids = batch_column(batch, "doc_id")
        for a, b in slices(offsets, SLICE):
            sets = shingle_sets(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
            sizes = np.array([len(s) for s in sets], np.int64)
            elements, group = np.concatenate(sets), np.repeat(np.arange(b - a), sizes)
            signatures = super_minhash(elements, group, b - a)
            keys, bits = band_keys(signatures), sketches(signatures)
            sums = []
            for salt in (GOLDEN, np.uint64(0xD1B54A32D192ED03)):
                so_far = np.append(np.uint64(0), np.cumsum(mixed(elements ^ salt), dtype=np.uint64))
                ends = np.cumsum(sizes)
                sums.append(signed(so_far[ends] - so_far[ends - sizes]))
            flat = pa.array(signed(np.ascontiguousarray(keys[sizes > 0])).reshape(-1))
            places = pa.array(np.append(0, np.cumsum((sizes > 0) * BANDS)).astype(np.int32))
            release_memory()
            yield pa.RecordBatch.from_arrays([ids.slice(a, b - a), pa.array(sizes), pa.array(sums[0]), pa.array(sums[1]), pa.ListArray.from_arrays(places, flat), *(pa.array(np.ascontiguousarray(x)) for x in bits.T)], ["doc_id", "n_shingles", "h1", "h2", "keys", *_BITS])


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, offsets = text_bytes(batch_column(batch, "text"))
        for a, b in slices(offsets, SLICE):
            sets = shingle_sets(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
            yield pa.RecordBatch.from_arrays([batch_column(batch, "doc_id").slice(a, b - a), pa.array([s.tobytes() for s in sets], pa.binary())], ["id", "shingles"])


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        left, right = batch_column(batch, "set_a"), batch_column(batch, "set_b")
        both, last, own = np.zeros((2, len(batch)), np.int64), None, None
        for i in range(len(batch)):
            raw = left[i].as_buffer()
            if last is None or not raw.equals(last):
                last, own = raw, np.frombuffer(raw, np.uint64)
            other = np.frombuffer(right[i].as_buffer(), np.uint64)
            same = int((own[np.minimum(np.searchsorted(own, other), len(own) - 1)] == other).sum())
            both[:, i] = same, len(own) + len(other) - same
        yield pa.RecordBatch.from_arrays([batch_column(batch, "a"), batch_column(batch, "b"), *map(pa.array, both)], ["a", "b", "common", "union"])
        release_memory()


def _salt(by: Column) -> Column:
    return F.pmod(F.xxhash64(by), F.lit(SALTS)).cast("int")


def _dealt(rows: DataFrame, hot: DataFrame, by: str) -> DataFrame:
    """rows with a salt, by which those with a hot key are dealt."""
    return rows.join(F.broadcast(hot), rows["key"] == hot["hot_key"], "left").withColumn("salt", F.when(F.col("hot_key").isNotNull(), _salt(F.col(by))).otherwise(0)).drop("hot_key")


def _copied(rows: DataFrame, hot: DataFrame) -> DataFrame:
    """rows, one for each key, with the salts that _dealt() may give: the other side of its joins."""
    every = F.when(F.col("hot_key").isNotNull(), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    return rows.join(F.broadcast(hot), rows["key"] == hot["hot_key"], "left").withColumn("salt", F.explode(every)).drop("hot_key")


def _with_sets(pairs: DataFrame, docs: DataFrame) -> DataFrame:
    """The pairs (a, b) of ids with their whole shingle sets. Only texts of these ids are hashed again."""
    involved = stored(pairs.select("a").unionByName(pairs.select(F.col("b").alias("a"))).distinct().withColumnRenamed("a", "want"))
    small = involved.count() <= BROADCAST_IDS
    texts = docs.join(F.broadcast(involved) if small else involved, docs["doc_id"] == involved["want"], "left_semi")
    sets = stored(texts.mapInArrow(_sets, "id long, shingles binary").groupBy("id").agg(F.min("shingles").alias("shingles")))
    # Many b have one a: its pairs are dealt to several tasks, and its set goes to those that ask for it.
    dealt = pairs.select("a", "b", _salt(F.col("b")).alias("salt"))
    a = sets.join(dealt.select("a", "salt").distinct(), F.col("id") == F.col("a")).select("a", "salt", F.col("shingles").alias("set_a"))
    b = sets.select(F.col("id").alias("b"), F.col("shingles").alias("set_b"))
    return dealt.join(b, "b").join(a, ["a", "salt"]).select("a", "b", "set_a", "set_b")


def _compared(pairs: DataFrame, docs: DataFrame) -> DataFrame:
    """The pairs (a, b) with the sizes of intersection and union of their sets."""
    return stored(_with_sets(pairs, docs).mapInArrow(_compare, "a long, b long, common long, union long"))


def _differences(percent: int):
    """Of pairs (a, b) with their sets: what sets b apart from a, as rows a, b, element, similar, leading, after, weight, excess.

    Let A be the shingles that b adds to a and D those that it lacks, C a's number of shingles, q = p / (1 + p) for a least
    similarity p, and weight(b) = (1 - q) |D| + q |A|. Two texts b and c are similar just if they have weight(b) + weight(c) -
    (1 - 2q) C or more of these differences in common, and b is similar to a just if its weight is at most (1 - 2q) C. excess is
    what the weight is above that.

    So with a c that is not similar to a, b must have more than its weight in common. Of b's differences, in an order that all
    texts keep, so many may come last that the common ones cannot all be among them: the others are leading. The order puts A
    first, as edits mostly add what no other text has. after: how many differences come later in the order. Of a similar b only
    leading ones are given, and a row without an element.
    """
    q = percent / (100 + percent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            left, right = batch_column(batch, "set_a"), batch_column(batch, "set_b")
            rows, elements, similar, leading, after, weights, excess = [], [], [], [], [], [], []
            for i in range(len(batch)):
                a, b = np.frombuffer(left[i].as_buffer(), np.uint64), np.frombuffer(right[i].as_buffer(), np.uint64)
                added, lacked = np.setdiff1d(b, a, assume_unique=True), np.setdiff1d(a, b, assume_unique=True)
                close = 100 * (len(b) - len(added)) >= percent * (len(a) + len(added))
                size, weight = len(added) + len(lacked), (1 - q) * len(lacked) + q * len(added)
                # A little less than the bound: rounding must not make it larger.
                first = size - int(weight - 1e-6)
                own = signed(np.concatenate([added, lacked]))
                values = [*own[:first].tolist(), None] if close else own.tolist()
                n = len(values)
                rows += [i] * n
                elements += values
                similar += [close] * n
                leading += [k < first for k in range(n)]
                after += [size - k - 1 for k in range(n)]
                weights += [weight] * n
                excess += [weight - (1 - 2 * q) * len(a)] * n
            numbers = [pa.array(elements, pa.int64()), pa.array(similar, pa.bool_()), pa.array(leading, pa.bool_()), pa.array(after, pa.int64()), pa.array(weights, pa.float64()), pa.array(excess, pa.float64())]
            yield pa.RecordBatch.from_arrays([*(batch_column(batch, n).take(pa.array(rows, pa.int64())) for n in ("a", "b")), *numbers], _DIFFERENCE.names)

    return run


_DIFFERENCE = T.StructType([T.StructField(n, t) for n, t in (("a", T.LongType()), ("b", T.LongType()), ("element", T.LongType()), ("similar", T.BooleanType()), ("leading", T.BooleanType()), ("after", T.LongType()), ("weight", T.DoubleType()), ("excess", T.DoubleType()))])


def _links(compared: DataFrame, percent: int) -> DataFrame:
    return compared.where(100 * F.col("common") >= percent * F.col("union")).select(F.col("a").alias("src"), F.col("b").alias("dst"))


def near_duplicates(documents: DataFrame, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of documents: id, n_shingles, component_id (the smallest id reachable) and kept (id = component_id).

    Two documents are linked if their sets of 5-word shingles have 100 * intersection >= percent * union. Words are what stands
    between blanks, A-Z in lower case. Documents with equal sets are one class; classes of a shared band are candidates, checked
    on their whole sets. In a bucket all classes are checked with its most central one. Then, with components known, those pairs of
    a bucket that lie in different components are checked: all of a small bucket, and of a large one those that differ from a
    common text in shared shingles, as similar ones must. So no link between components is lost, and no group is paired off or
    gathered.

    Null and empty texts have no shingles and are linked with nothing. Rows with a null id have a null component and are kept;
    rows of one id with different texts are one document to others, by the smaller of their sets, and each give their own row. Other
    columns are not read; an empty table gives no rows.
    """
    docs = bounded_batches(documents).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    kind = T.StructType([T.StructField(n, T.LongType()) for n in ("doc_id", "n_shingles", "h1", "h2")] + [T.StructField("keys", T.ArrayType(T.LongType()))] + [T.StructField(n, T.LongType()) for n in _BITS])
    signed_docs = stored(docs.mapInArrow(_sign, kind))
    named = signed_docs.where("doc_id is not null and n_shingles > 0")
    first_of_class = [F.min(F.struct("doc_id", *_BITS, "keys")).alias("first"), F.count("*").alias("n_docs")]
    classes = stored(named.groupBy("h1", "h2", "n_shingles").agg(*first_of_class).select("h1", "h2", "n_shingles", "n_docs", F.col("first.doc_id").alias("rep"), "first.keys", *(f"first.{n}" for n in _BITS)))

    every = classes.select("rep", F.explode("keys").alias("key"))
    shared = stored(every.groupBy("key").agg(F.count("*").alias("size")).where("size > 1"))
    hot = shared.where(F.col("size") > max(HOT_ROWS, classes.count() * BANDS // HOT_KEYS)).select(F.col("key").alias("hot_key"))
    members = stored(_dealt(every, hot, "rep").join(_copied(shared, hot), ["key", "salt"]).select("key", "rep", "size", "salt"))
    # The member whose buckets are the fullest is the likeliest to be similar to all others: of copies of one text, that text.
    weight = members.groupBy("rep").agg(F.sum("size").alias("weight")).select(F.col("rep").alias("of"), "weight")
    weighed = members.join(weight, members["rep"] == weight["of"])
    center = stored(weighed.groupBy("key").agg(F.max(F.struct("weight", (-F.col("rep")).alias("back"))).alias("top")).select("key", (-F.col("top.back")).alias("center"), "top"))
    centered = members.join(_copied(center, hot), ["key", "salt"])  # members keep their salts
    spokes = centered.where("rep <> center").select(F.col("center").alias("a"), F.col("rep").alias("b")).distinct()
    sketch = lambda name: classes.select(F.col("rep").alias(name), F.col("n_shingles").alias(f"{name}_n"), *(F.col(x).alias(f"{name}_{x}") for x in _BITS))
    alike = lambda x, y: _alike([f"{x}_{k}" for k in _BITS], [f"{y}_{k}" for k in _BITS], percent) & (100 * F.least(f"{x}_n", f"{y}_n") >= percent * F.greatest(f"{x}_n", f"{y}_n"))
    first = stored(spokes.join(sketch("b"), "b").join(sketch("a"), "a").where(alike("a", "b")).select("a", "b"))
    links = stored(_links(_compared(first, docs), percent))
    roots = connected_components(links)

    # Buckets that hold several components yet.
    placed = centered.join(roots, centered["rep"] == roots["id"], "left").select("key", "rep", "size", "center", F.coalesce("root", "rep").alias("root"))
    mixed_keys = placed.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low < high").select(F.col("key").alias("mixed_key"))
    open_members = stored(placed.join(mixed_keys, placed["key"] == mixed_keys["mixed_key"]).drop("mixed_key"))
    few = open_members.where(F.col("size") <= SMALL_BUCKET).select("key", F.col("rep").alias("y"), F.col("root").alias("y_root"))
    other = few.select(F.col("key").alias("x_key"), F.col("y").alias("x"), F.col("y_root").alias("x_root"))
    in_small = other.join(few, (F.col("x_key") == F.col("key")) & (F.col("x") < F.col("y")) & (F.col("x_root") != F.col("y_root"))).select("x", "y")

    # In a large bucket all members are compared with one text, the same one for as many buckets as can be: the center of the
    # fullest bucket that the bucket's center is in. Two members can only be similar if they differ from it in the same shingles.
    upper = centered.groupBy("rep").agg(F.max("top").alias("best")).select(F.col("rep").alias("lower"), (-F.col("best.back")).alias("reference"))
    many = open_members.where(F.col("size") > SMALL_BUCKET).select("center", "rep").distinct()
    compared_with = many.join(upper, many["center"] == upper["lower"]).where("rep <> reference").select(F.col("reference").alias("a"), F.col("rep").alias("b")).distinct()
    apart = stored(_with_sets(stored(compared_with), docs).mapInArrow(_differences(percent), _DIFFERENCE))
    more_links = apart.where("element is null").select(F.col("a").alias("src"), F.col("b").alias("dst"))
    probe = apart.where("not similar").select(F.col("a").alias("x_reference"), F.col("b").alias("x"), F.col("element").alias("x_element"), F.col("leading").alias("x_leading"), F.col("after").alias("x_after"), "excess")
    target = apart.where("leading and element is not null").select("a", F.col("b").alias("y"), "element", "similar", "after", "weight")
    shares = (F.col("x_reference") == F.col("a")) & (F.col("x_element") == F.col("element")) & (F.col("similar") | (F.col("x_leading") & (F.col("x") < F.col("y"))))
    # From the first difference that two texts share, no more can be common than come later in either.
    enough = 1 + F.least("x_after", "after") >= F.col("excess") + F.col("weight") - 1e-6
    in_large = probe.join(target, shares & enough).select("x", "y")

    named_roots = lambda name: roots.select(F.col("id").alias(f"{name}_id"), F.col("root").alias(f"{name}_root"))
    rest = in_small.unionByName(in_large).select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y")).distinct()
    rest = rest.join(sketch("x"), "x").join(sketch("y"), "y").where(alike("x", "y")).select("x", "y")
    rest = rest.join(named_roots("x"), F.col("x") == F.col("x_id"), "left").join(named_roots("y"), F.col("y") == F.col("y_id"), "left")
    rest = rest.where(F.coalesce("x_root", "x") != F.coalesce("y_root", "y")).select(F.col("x").alias("a"), F.col("y").alias("b"))
    known = first.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    more = stored(_links(_compared(stored(rest.join(known, ["a", "b"], "left_anti")), docs), percent).unionByName(more_links))
    if not more.isEmpty():
        roots = connected_components(links.unionByName(more))

    # Copies meet their class by its sums, dealt to several tasks; a text without copies is its class's first and meets its root by id.
    several = classes.where("n_docs > 1").join(roots, classes["rep"] == roots["id"], "left").withColumn("c4", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    several = several.select(F.col("h1").alias("c1"), F.col("h2").alias("c2"), F.col("n_shingles").alias("c3"), "c4", F.coalesce("root", "rep").alias("component"))
    salted = signed_docs.select("doc_id", "n_shingles", "h1", "h2", _salt(F.col("doc_id")).alias("salt"))
    same = (salted["h1"] == several["c1"]) & (salted["h2"] == several["c2"]) & (salted["n_shingles"] == several["c3"]) & (salted["salt"] == several["c4"]) & salted["doc_id"].isNotNull()
    placed = salted.join(several, same, "left").select("doc_id", "n_shingles", "component")
    own = roots.select(F.col("id").alias("own_id"), F.col("root").alias("own_root"))
    out = placed.join(own, (placed["doc_id"] == own["own_id"]) & (placed["n_shingles"] > 0), "left").select("doc_id", "n_shingles", F.coalesce("component", "own_root", "doc_id").alias("component_id"))
    return out.select(F.col("doc_id").alias(id_col), "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))


def keep_first(documents: DataFrame, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """documents with one of each group of near duplicates, the one of the smallest id; all columns, and rows without an id, stay.

    Of rows with one id and one text one stays.
    """
    dropped = near_duplicates(documents, percent, id_col, text_col).where("not kept").select(F.col(id_col).alias("dropped_id")).distinct()
    kept = documents.join(dropped, documents[id_col] == dropped["dropped_id"], "left_anti")
    again = stored(documents.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("again_id")).count().where("count > 1").select("again_id"))
    if again.isEmpty():
        return kept
    once = kept.join(again, kept[id_col] == again["again_id"], "left_anti")
    return once.unionByName(kept.join(again, kept[id_col] == again["again_id"], "left_semi").dropDuplicates([id_col, text_col]))
