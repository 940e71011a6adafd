import gc

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from corpusmill.llm import common
from corpusmill.llm.common import BLANKS, NOT_ALNUM, WordHasher, discard, path_of_stored, scratch_dir, scratch_until, stored, text_bytes

HASHERS = [WordHasher(BLANKS, lower=True), WordHasher(NOT_ALNUM, lower=True, seed=5)]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text("aB c\né0.", max_size=30), max_size=6), st.integers(1, 12))
def test_texts_hashed_in_parts(texts, limit):
    for hasher in HASHERS:
        data, offsets = text_bytes(pa.array(texts, pa.string()))
        for whole, parts in zip(hasher.hashes(data, offsets), hasher.hashes(data, offsets, limit), strict=True):
            assert np.array_equal(whole, parts)


def test_tables_of_powers_stay_short():
    """A text of many bytes makes no table of its length, as long as its words are shorter."""
    hasher = WordHasher(BLANKS, lower=True)
    data, offsets = text_bytes(pa.array(["ab " * 3_000_000, "x"]))
    assert len(hasher.hashes(data, offsets)[0]) == 3_000_001
    assert len(hasher.powers) <= 2 * common.HASH_BYTES + 2


def test_scratch_tables_go(spark):
    made = stored(spark.range(5))
    path = path_of_stored(made)
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = target.getFileSystem(spark._jsc.hadoopConfiguration())
    assert made.count() == 5 and files.exists(target)
    discard(made)
    assert not files.exists(target)
    with scratch_until(spark) as keep:
        kept, gone = stored(spark.range(3)), stored(spark.range(4))
        keep.add(path_of_stored(kept))
        gone = spark._jvm.org.apache.hadoop.fs.Path(path_of_stored(gone))
    assert kept.count() == 3 and not files.exists(gone)


def test_a_cluster_must_name_its_folder():
    class Conf:
        def get(self, *_):
            return None

    class Cluster:
        conf = Conf()
        sparkContext = type("Context", (), {"master": "spark://host:7077"})

    with pytest.raises(RuntimeError, match="checkpoint"):
        scratch_dir(Cluster())


def test_driver_gives_memory_back(spark, monkeypatch):
    """Between plans the heap is collected if it has grown beyond its share, and left alone else."""
    java = spark._jvm.java.lang
    monkeypatch.setattr(common, "HEAP_SHARE", 1)
    assert not common.release_driver(spark)
    monkeypatch.setattr(common, "HEAP_SHARE", 0)
    garbage = java.ref.WeakReference(spark._jvm.java.util.ArrayList())
    gc.collect()
    table = common.stored(spark.range(10))
    assert garbage.get() is None
    assert common.release_driver(spark)
    assert table.count() == 10
    common.discard(table)
