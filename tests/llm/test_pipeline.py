"""The pipeline's stages on a small table, each held against what it should do to its input."""

import corpus_pipeline
from glyphweave.llm import packing
from tests.llm.test_operators import ROWS, brute_near, brute_removed, squeezed, words


def test_stages(spark, tmp_path):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(120)
    extra = spark.createDataFrame([(100_000 + k, t, "en", "s", len(t or "")) for k, (i, t) in enumerate(ROWS)], docs.schema)
    docs = docs.unionByName(extra)
    columns, before = docs.columns, {r["doc_id"]: r["text"] for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES:
        docs.write.mode("overwrite").parquet(f"{tmp_path}/{name}")
        docs = stage(spark, spark.read.parquet(f"{tmp_path}/{name}"), str(tmp_path))
        rows = docs.collect()
        if name == "best_fit_packing":
            break
        assert docs.columns == columns
        after = {r["doc_id"]: r["text"] for r in rows}
        assert len(after) == len(rows) and set(after) <= set(before)
        if name == "language_id":
            assert all(any(c.isalpha() for c in t) for t in after.values())
        elif name == "exact_dedup":
            texts = {squeezed(t) for t in before.values()}
            assert len(after) == len(texts) == len({squeezed(t) for t in after.values()})
        elif name == "minhash_dedup":
            assert set(after) == {i for i, low in brute_near(before.items(), 5, 80)[1].items() if i == low}
        else:
            gone = brute_removed(before.items())
            assert after == {i: " ".join(w for p, w in enumerate(words(t)) if p not in gone[i]) if i in gone else t for i, t in before.items()}
            assert all(r["n_chars"] == len(r["text"]) for r in rows)
        before = after
    assert {r["doc_id"] for r in rows} == set(before)
    assert sum(r["length"] for r in rows) == sum(r["length"] for r in packing.tokenized(spark.createDataFrame(list(before.items()), "doc_id bigint, text string")).collect())


def test_empty_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, "")
        assert docs.count() == 0
