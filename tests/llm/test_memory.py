"""Workers give memory back while a task runs, not only at its end."""

import numpy as np
import pyarrow as pa

from tracequarry.llm import _text, byte_bpe
from tracequarry.llm.queries import vocabulary


def test_lean_gives_back_after_each_batch(monkeypatch):
    given = []
    monkeypatch.setattr(_text, "give_back", lambda: given.append(1))
    batch = pa.RecordBatch.from_arrays([pa.array([1])], names=["a"])
    seen = [len(given) for _ in _text.lean(lambda batches: batches, tables=True)(iter([batch] * 3))]
    assert seen == [0, 1, 2] and len(given) == 4


def test_powers_grow_with_the_text(monkeypatch):
    monkeypatch.setattr(_text, "_powers", np.ones(1, np.uint64))
    monkeypatch.setattr(_text, "_inverses", np.ones(1, np.uint64))
    data = np.arange(1000, dtype=np.uint8)
    one = _text.Prefix(data).of(np.array([3]), np.array([9]))
    assert len(_text._powers) < 1 << 12
    _text.Prefix(np.zeros(5000, np.uint8))
    assert len(_text._powers) > 5000 and (_text.Prefix(data).of(np.array([3]), np.array([9])) == one).all()


def test_tables_have_no_mark_of_success(spark):
    from pathlib import Path
    from urllib.parse import urlparse

    from tracequarry.plans.shared import materialise

    df = materialise(spark.range(10), "t")
    assert df.count() == 10 and not (Path(urlparse(df.inputFiles()[0]).path).parent / "_SUCCESS").exists()


def test_encoding_returns_portions(spark, monkeypatch):
    texts = ["", None, "a b " * 300, "x" * 5000, "é", "", "word " * 40] * 3
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").coalesce(1)
    sizes = []

    class Docs:  # takes the function that the workers would run
        dtypes = docs.dtypes

        def __getitem__(self, c):
            return docs[c]

        def select(self, *c):
            return self

        def mapInArrow(self, run, schema):
            batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts)), pa.int64()), pa.array(texts)], names=["doc_id", "text"])
            out = list(run(iter([batch])))
            sizes.extend(x.num_rows for x in out)
            return pa.Table.from_batches(out).to_pylist()

    monkeypatch.setattr(byte_bpe, "PORTION_BYTES", 1500, raising=False)
    got = byte_bpe.encode_documents(Docs(), *vocabulary(), keep_ids=True)
    assert sum(sizes) == len(texts) and len(sizes) > 6  # portions, each row once and in order
    want = byte_bpe.Codec(*vocabulary())
    assert [(r["doc_id"], r["ids"]) for r in got] == [(i, want.encode(t or "")) for i, t in enumerate(texts)]
