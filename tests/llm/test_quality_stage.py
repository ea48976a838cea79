import brute
from frametide.llm import quality_rules


def test_stage_filters_by_the_ledger(spark, monkeypatch):
    """A rule in the ledger's language, SQL, decides in the stage as it does in the ledger."""
    monkeypatch.setitem(quality_rules.RULES, "few_words", "n_words BETWEEN 0 AND 19")
    docs = brute.docs_frame(spark, brute.awkward_docs())
    book = quality_rules.quality_rules(docs)
    left = quality_rules.drop_low_quality(docs)
    assert left.columns == docs.columns
    assert 0 < left.count() == book.filter("kept").count() < book.count()
