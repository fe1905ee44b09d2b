import re

from pyspark.sql import functions as F

import corpus_pipeline
from carnelian.llm import mixing, secrets


def test_stages_run_in_order_and_take_effect(spark, tmp_path, make):
    base = [" ".join(f"{w}{(i * 13 + k * (i + 3)) % 97}" for k in range(60)) for i in range(40) for w in ["the" if i % 2 else "le"]]
    leak = " ".join(f"item{k}" for k in range(14))
    rows = [(i, t, "en" if i % 2 else "fr", f"s{i % 3}") for i, t in enumerate(base)]
    rows += [(100, base[4], "fr", "s0"), (101, base[4] + " extra", "fr", "s1"), (102, None, None, "s1"), (103, "123 !!", "en", "s2"), (104, base[5] + " q r s t u " + leak + " and the rest of it token=Zx81aQw3", "en", "s2"), (105, leak, "en", "s2")]
    columns = ["doc_id", "text", "lang", "source", "n_chars"]
    make(rows).select(*columns).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, leak)], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs, kept = spark.read.parquet(f"{tmp_path}/documents.parquet"), []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        docs = stage(spark, docs, str(tmp_path))
        if k < 4:
            assert docs.columns == columns
        docs.write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        kept.append({r.doc_id: r for r in docs.collect()})
    assert not {102, 103} & set(kept[0]) and set(range(40)) <= set(kept[0])
    assert not {100, 101} & set(kept[1]) and 4 in kept[1]
    assert 105 not in kept[2] and "item3" not in kept[2][104].text and "and the rest" in kept[2][104].text
    assert secrets.MASK in kept[3][104].text and not re.search("Zx81aQw3", kept[3][104].text)
    assert set(kept[4]) == set(kept[3]) and all(r.taken <= 2 * r["size"] for r in kept[4].values())
    assert sorted(r.doc_id for r in corpus_pipeline.run(spark, str(tmp_path)).collect()) == sorted(kept[4])
    sizes = docs.agg(F.sum("size")).first()[0]
    assert abs(docs.agg(F.sum("taken")).first()[0] - float(mixing.SHARE) * sizes) < 0.1 * sizes


def test_empty_documents_pass_through(spark, tmp_path, nothing):
    nothing.select("doc_id", "text", "lang", "source", "n_chars").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
