"""What Python workers hold at once doesn't grow with a batch or with a block."""

import numpy as np
import pyarrow as pa

from tablewell.functions import vectors
from tablewell.operators import chunk


def test_texts_are_embedded_a_few_at_a_time(monkeypatch):
    texts, seen, real = ["red blue", None, "a" * 9, "", *(f"word {k}" for k in range(900))], [], vectors._vectors_of
    monkeypatch.setattr(vectors, "_vectors_of", lambda own: seen.append(len(own)) or real(own))
    out = vectors._hash_embeddings(pa.float64())(pa.array(texts))
    assert max(seen) <= vectors.TEXTS and sum(seen) == len(texts) and len(seen) > 3
    assert np.allclose(np.array(out.to_pylist()), np.array(real(texts)))
    assert len(vectors._hash_embeddings(pa.float32())(pa.array([], pa.string()))) == 0
    monkeypatch.setattr(vectors, "TEXTS_CHARS", 10)
    assert [len(x) for x in vectors._few_at_once(["a" * 30, "b", "c" * 9, "d", None])] == [1, 2, 2]


def test_products_are_made_in_tiles(monkeypatch):
    rng = np.random.default_rng(1)
    rows, asked = rng.integers(-2, 3, (700, 4)).astype(float), rng.integers(-2, 3, (90, 4)).astype(float)
    schema = pa.schema([("block", pa.int64()), ("ids", pa.list_(pa.int64())), ("vectors", pa.binary()), ("query_ids", pa.list_(pa.int64())), ("query_vectors", pa.binary())])
    made = [{"block": 0, "ids": list(range(lo, lo + 350)), "vectors": rows[lo : lo + 350].tobytes(), "query_ids": list(range(90)), "query_vectors": asked.tobytes()} for lo in (350, 0)]
    want = {(q, r) for q in range(90) for r in sorted(range(700), key=lambda r: (-round(float(asked[q] @ rows[r]), 9), r))[:5]}
    for tile in (1 << 20, 16):
        monkeypatch.setattr(vectors, "TILE", tile)
        out = list(vectors._best(5, 4, (pa.int64(), pa.int64()))(iter([pa.RecordBatch.from_pylist(made, schema=schema)])))
        assert {(r["query"], r["row"]) for b in out for r in b.to_pylist()} == want
        assert max(b.num_rows for b in out) <= 5 * min(tile, 90)


def test_documents_are_cut_a_few_at_a_time():
    texts = ["word " * 60_000, None, "", "short", *["word " * 60_000] * 9]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts), pa.array(["text/plain"] * len(texts))], names=["id", "text", "kind"])
    out = list(chunk._cut(None)(iter([batch])))
    assert len(out) == 3
    got = [(r["id"], r["ordinal"], r["text"]) for b in out for r in b.to_pylist()]
    assert got == [(k, c["ordinal"], c["text"]) for k, t in enumerate(texts) for c in chunk._parts(t, "text/plain", None)]


def test_the_text_of_a_family_is_copied_a_few_times(monkeypatch):
    """Many small parts with a look at the whole after each: room is doubled, not made anew each time."""
    from tablewell.llm import suffix_dedup

    family, rooms, parts = suffix_dedup.IndexFamily(), set(), [np.full(100, k % 256, np.uint8) for k in range(500)]
    for k, part in enumerate(parts):
        assert family.put_text(part) == 100 * k
        rooms.add(family.text().__array_interface__["data"][0])
        assert len(family.text()) == 100 * (k + 1)
    assert len(rooms) <= 10 and (family.text() == np.concatenate(parts)).all()


def test_office_files_are_made_and_read_once(spark, tmp_path):
    from tablewell.plans import office

    spark.createDataFrame([(1, 1, 5, "A"), (1, 2, 6, "N")], "l_orderkey long, l_linenumber int, l_quantity int, l_returnflag string").write.parquet(str(tmp_path / "lineitem.parquet"))
    out = office.office_chunks(spark, str(tmp_path))
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInPandas") == 1 and plan.count("ArrowEvalPython") == 1 and "Join" not in plan
    assert sorted((r.filename, r.ordinal) for r in out.collect()) == [("1.docx", 0), ("1.pptx", 0), ("1.pptx", 1)]
