import pytest

from strandloom.llm import leaks, queries


@pytest.mark.parametrize("name", ["p7_found", "p7_overlaps"])
def test_seeds_are_spaced(spark, monkeypatch, name):
    """Both queries of p7 seed texts and items with masks that hide places."""
    used, seeds = [], leaks.seeds

    def noted(words, key, masks=leaks.MASKS):
        used.append(masks)
        return seeds(words, key, masks)

    monkeypatch.setattr(leaks, "seeds", noted)
    queries.queries()[name](spark, "/root/testdata/sf0.001").count()
    assert len(used) == 2 and all("0" in mask for masks in used for mask in masks)
