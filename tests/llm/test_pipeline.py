import corpus_pipeline
from hearthlog.llm.common import read, settle


def test_stages_keep_columns_and_clean_documents(spark):
    sf = "/root/testdata/sf0.001"
    docs = read(spark, sf, "documents")
    columns, n = docs.columns, docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, sf)
        assert docs.columns == columns, name
    assert 0.5 * n < docs.count() < n
    packed = corpus_pipeline.run(spark, sf)
    assert packed.select("doc_id").distinct().count() == docs.count()


def test_stages_stand_hard_and_empty_tables(spark):
    """Nulls, blank and very long texts, repeated rows, and columns named like those that the operators use."""
    from pyspark.sql import functions as F

    from .helpers import DOCS, hard_docs

    sf = "/root/testdata/sf0.001"
    for rows in (hard_docs(), []):
        docs = spark.createDataFrame(rows, DOCS)
        for c in ("spans", "kept", "n_words", "g", "n", "part", "unit", "bucket", "base_spans", "Chunk", "bin", "mark"):
            docs = docs.withColumn(c, F.concat(F.lit(c), F.col("node").cast("string")))
        columns = docs.columns
        for name, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, docs, sf)
            assert out.columns == columns, name
            assert all(r["spans"] == f"spans{r['node']}" and r["kept"] == f"kept{r['node']}" for r in out.collect()), name
        packed = corpus_pipeline.STAGES[-1][1](spark, docs, sf).collect()
        assert (len(packed) > 0) == bool(rows)


def test_pipeline_by_brute_force(spark):
    """Each stage against SQL or brute force on what the stage before kept; the last one's ids against `tokenizers`."""
    import struct
    import zlib

    import duckdb
    import public_tokenizers
    import tokenizers

    from hearthlog.llm import oracles, packing, pii

    from .test_documents import base_spans, jaccard_brute, leaks_brute, texts

    sf = "/root/testdata/sf0.001"
    docs = read(spark, sf, "documents")
    steps = dict(corpus_pipeline.STAGES)
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{sf}/documents.parquet'")
    good = settle(steps["quality rules"](spark, docs, sf), "good")
    want = {i for i, kept in con.execute(f"select doc_id, kept from ({oracles.ORACLES['op9_quality_rules']})").fetchall() if kept}
    assert sorted(i for i, _ in texts(good)) == sorted(want)
    alone = settle(steps["n-gram Jaccard join"](spark, good, sf), "alone")
    assert sorted(i for i, _ in texts(alone)) == sorted({root for _, _, root in jaccard_brute(texts(good))})
    clean = settle(steps["benchmark decontamination"](spark, alone, sf), "clean")
    bad = {i for i, _ in leaks_brute(texts(alone), [(r["item_id"], r["text"]) for r in read(spark, sf, "benchmark").collect()])}
    assert sorted(i for i, _ in texts(clean)) == sorted(i for i, _ in texts(alone) if i not in bad)
    red = settle(steps["PII"](spark, clean, sf), "red")
    spans = {r["doc_id"]: [x for x in r["spans"].split(",") if x] for r in pii.report(clean).collect()}
    before, after = dict(texts(clean)), dict(texts(red))
    for i, t in before.items():
        assert set(base_spans(t)) <= set(spans[i])
        out, at = [], 0
        for x in spans[i]:
            kind, a, b = x.split(":")
            if int(a) >= at:
                out += [t[at : int(a)], f"<{kind.upper()}>"]
            at = max(at, int(b))
        assert after[i] == "".join(out) + t[at:]
    assert all(r["n_chars"] == len(r["text"]) for r in red.collect())
    tok = tokenizers.Tokenizer.from_file(public_tokenizers.path(packing.VOCABULARY))
    ids = {i: [*tok.encode(t, add_special_tokens=False).ids, 1] for i, t in after.items()}
    pieces = steps["packing"](spark, red, sf).collect()
    assert {r["doc_id"] for r in pieces} == set(ids) and sum(r["length"] for r in pieces) == sum(map(len, ids.values()))
    for r in pieces:
        part = ids[r["doc_id"]][r["start"] : r["start"] + r["length"]]
        assert zlib.crc32(struct.pack(f"<{len(part)}I", *part)) == r["ids_crc32"]
