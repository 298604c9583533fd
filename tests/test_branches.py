"""Keys' bigrams beyond the bound of a broadcast are dealt out by bigram, with the same matches."""

from larder.operators import matching
from larder.plans import catalog

SF = "/root/testdata/sf0.001"


def test_both_joins_on_bigrams_match_alike(spark, monkeypatch):
    names = ("fn_cascade", "jn_ngram_block", "win_top50")
    rows = lambda: [sorted(map(str, catalog.queries()[n](spark, SF).collect())) for n in names]
    few = rows()
    monkeypatch.setattr(matching, "BROADCAST_GRAMS", 0)
    assert rows() == few and all(few)
