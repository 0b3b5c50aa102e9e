"""Shared folders, worker tables and free names."""

import pyarrow as pa
import pytest

from factloom.llm import shared


def test_saved_tables_are_deleted(spark):
    df = shared.saved(spark.range(3), "x")
    fs, path = shared.filesystem(df._saved_in)
    assert fs.get_file_info(path).is_file is False and df.count() == 3
    shared.discard(df)
    assert fs.get_file_info(path).type.name == "NotFound"
    kept = shared.saved(spark.range(3), "y")
    assert shared.clean_up(spark) > 0
    assert fs.get_file_info(shared.filesystem(kept._saved_in)[1]).type.name == "NotFound"


def test_a_cluster_without_a_shared_folder_is_an_error():
    class Conf:
        def get(self, *_):
            return None

    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        conf, sparkContext = Conf(), Context()

    with pytest.raises(ValueError, match="checkpoint"):
        shared.checkpoint_root(Session())


def test_a_worker_holds_one_operators_tables():
    shared.only("a")["x"] = 1
    assert shared.only("a") == {"x": 1}
    assert shared.only("b") == {} and shared.only("a") == {}


def test_slices_by_bytes_keep_all_rows():
    texts = pa.array(["a" * n for n in (0, 5, 500, 0, 20, 20, 1)] + [None])
    parts = list(shared.by_bytes([texts], limit=40))
    assert pa.concat_arrays(parts).equals(texts) and [len(p) for p in parts] == [2, 1, 4, 1] or sum(map(len, parts)) == 8
    assert all(len(p) == 1 or len("".join(x or "" for x in p.to_pylist())) <= 40 for p in parts)


def test_free_names(spark):
    df = spark.createDataFrame([(1, 2)], "Score int, _score int")
    assert shared.fresh("score", df) == "__score" and shared.fresh("other", df) == "other"
