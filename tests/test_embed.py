import numpy as np
import pytest
from pyspark.sql import functions as F

from leafmill.functions import embed as E
from leafmill.sources.datasource import Notes


def lengths():
    class Lengths:  # local, so that it is sent to the workers
        dimension = 2

        def embed(self, texts):
            self.sizes = [*getattr(self, "sizes", []), len(texts)]
            return E.normalised(np.array([[len(t), 1.0] for t in texts]))

    return Lengths()


def test_batches_keep_the_order():
    texts = ["x" * n for n in (5, 1, 9, 3, 7, 2, 8, 4, 6, 0)]
    e = lengths()
    got = E.in_batches(e, texts, 4)
    assert e.sizes == [4, 4, 2] and np.allclose(got, E.normalised(np.array([[len(t), 1.0] for t in texts])))
    assert E.in_batches(e, []).shape == (0, 2)


def test_pooling_and_checks():
    hidden = np.array([[[1.0, 0.0], [3.0, 2.0], [9.0, 9.0]]])
    assert E.mean_pooled(hidden, np.array([[1, 1, 0]])).tolist() == [[2.0, 1.0]]
    with pytest.raises(ValueError):
        E.checked(np.ones((1, 2)), 2)
    with pytest.raises(ValueError):
        E.checked(np.ones((1, 3)), 2)
    with pytest.raises(FileNotFoundError):
        E.OnnxModel("no.onnx", "no.json", 2).embed(["x"])


def test_embedded_column(spark):
    df = spark.createDataFrame([("ab",), (None,), ("",)], "t string")
    got = [r[0] for r in df.select(E.embedded(F.col("t"), lengths())).collect()]
    assert got[1] is None and np.allclose(got[0], [2 / 5**0.5, 1 / 5**0.5]) and got[2] == [0.0, 1.0]


def test_notes_source(spark, tmp_path):
    (tmp_path / "a.md").write_text("---\nx: 1\n---\nbody\n", encoding="utf-8")
    (tmp_path / "b.txt").write_bytes(b"\xff")
    spark.dataSource.register(Notes)
    rows = {r["file_path"].rsplit("/", 1)[1]: r for r in spark.read.format("notes").load(str(tmp_path)).collect()}
    assert rows["a.md"]["text"] == "body" and rows["b.txt"]["text"] is None and rows["b.txt"]["error"]
