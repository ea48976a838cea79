import brute
import corpus_pipeline
import pytest
from frametide.llm import quality_rules, toxicity
from test_operators import check_packing, toxic_corpus


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    rows, marks = toxic_corpus()
    rows += [(i, t) for i, t in brute.awkward_docs() if i is None or i >= 1000]
    rows = [(i, t) for i, t in rows]
    folder = tmp_path_factory.mktemp("tables")
    spark.createDataFrame([(i, t, "en", "src0", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(marks, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return str(folder), rows


def brute_quality(text):
    got = dict(zip(quality_rules.MEASURES, quality_rules.measure(text or "")))
    return not any(eval(c.replace(" = ", " == "), {}, got) for c in quality_rules.RULES.values())


def test_stages_against_brute_force(spark, tables):
    folder, rows = tables
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    left = [r for r in rows if brute_quality(r[1])]
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality", "toxicity", "exact_dedup", "near_dedup", "packing"]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        if name == "toxicity":
            bad = {r["doc_id"] for r in toxicity.toxicity(docs, labels).collect() if r["is_toxic"]}
            left = [r for r in left if r[0] not in bad]
        if name == "exact_dedup":
            kept = {}
            for i, t in left:
                kept.setdefault(brute.SPACE.sub("", t or ""), []).append((-len(t or ""), i is None, i or 0, t))
            left = [(None if min(v)[1] else min(v)[2], min(v)[3]) for v in kept.values()]
        if name == "near_dedup":
            least = {}
            for (i, t), (_, _, comp) in zip(left, brute.near(left)[0]):
                if comp not in least or i == comp:
                    least[comp] = (i, t)
            left = list(least.values())
        docs = stage(spark, docs, folder)
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        path = f"{folder}/{name}"
        docs.write.parquet(path)
        docs = spark.read.parquet(path)
        got = sorted(((r["doc_id"], r["text"]) for r in docs.collect()), key=repr)
        assert got == sorted(left, key=repr), name
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, folder).collect()
    assert sorted((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in packed) == sorted(brute.pieces(left))
    check_packing(packed)
    assert sorted((r["doc_id"], r["piece"]) for r in corpus_pipeline.run(spark, folder).collect()) == sorted((r["doc_id"], r["piece"]) for r in packed)


def test_stages_of_an_empty_table_and_of_clashing_columns(spark, tables, tmp_path):
    from pyspark.sql import functions as F

    folder, rows = tables
    docs, labels = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")
    docs.limit(0).write.parquet(f"{tmp_path}/empty/documents.parquet")
    labels.write.parquet(f"{tmp_path}/empty/labels.parquet")
    done = corpus_pipeline.run(spark, f"{tmp_path}/empty")
    assert done.count() == 0 and {"doc_id", "sequence_id", "ids"} <= set(done.columns)
    extra = {"kept": F.lit(1), "uid": F.lit("u"), "_c0": F.lit(2.0), "frametide_row_uid": F.lit(None).cast("string"), "component_id": F.lit(0), "n_words": F.lit(3), "failed": F.lit(9), "fp": F.lit("f")}
    docs.withColumns(extra).write.parquet(f"{tmp_path}/clash/documents.parquet")
    labels.withColumn("text", F.lit("other")).write.parquet(f"{tmp_path}/clash/labels.parquet")
    clash = spark.read.parquet(f"{tmp_path}/clash/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        left = stage(spark, clash, f"{tmp_path}/clash")
        assert left.columns == clash.columns, name
    key = lambda r: (r["doc_id"] is None, r["doc_id"] or 0, r["piece"], r["ids_crc32"])
    got, want = (sorted(corpus_pipeline.run(spark, d).select("doc_id", "piece", "ids_crc32").collect(), key=key) for d in (f"{tmp_path}/clash", folder))
    assert got == want
