import zlib

import brute
import corpus_pipeline


def test_packing_stage_yields_the_ids(spark):
    rows = [r for r in brute.awkward_docs() if r[0] is not None and r[0] != 3]
    docs = brute.docs_frame(spark, rows).repartition(5)
    got = corpus_pipeline.packing(spark, docs, "").collect()
    whole = {}
    for r in sorted(got, key=lambda r: (r["doc_id"], r["piece"])):
        assert len(r["ids"]) == 4 * r["length"] and zlib.crc32(r["ids"]) == r["ids_crc32"]
        whole[r["doc_id"]] = whole.get(r["doc_id"], b"") + bytes(r["ids"])
    tok = brute.tok("word_bpe_49k.json")
    want = {i: b"".join(x.to_bytes(4, "little") for x in [*tok.encode(t or "", add_special_tokens=False).ids, 1]) for i, t in rows}
    assert whole == want
