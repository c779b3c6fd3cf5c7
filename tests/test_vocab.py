import pytest

from lakeloom import vocab


def test_class_numbers():
    assert [vocab.coarse_id(c) for c in ("ERROR_FREE", "COMPILE_ERROR", "RUNTIME_ERROR", "LOGICAL")] == [0, 1, 2, 3]
    assert [vocab.leaf_id(c) for c in ("ERROR_FREE", "SYNTAX", "SEMANTIC", "LINKER", "SIGSEGV", "SIGFPE", "SIGABRT", "NZEC", "LOGICAL")] == list(range(9))


def test_hierarchy_is_total_and_tiers_grow():
    assert {vocab.to_coarse(leaf) for leaf, _, _ in vocab.LEAVES} == set(vocab.COARSE)
    assert vocab.leaves_for_tier(1) == ("ERROR_FREE", "LOGICAL")
    assert set(vocab.leaves_for_tier(1)) < set(vocab.leaves_for_tier(2)) < set(vocab.leaves_for_tier(3))
    assert [leaf for leaf, _, _ in vocab.LEAVES if vocab.is_terminal(leaf)] == ["ERROR_FREE", "LOGICAL"]
    for bad in (0, 4):
        with pytest.raises(ValueError):
            vocab.leaves_for_tier(bad)
    for f in (vocab.leaf_id, vocab.to_coarse, vocab.is_terminal, vocab.coarse_id):
        with pytest.raises(ValueError):
            f("syntax")


@pytest.mark.parametrize("verdict,outcome", [(v, c or r) for v, c, r in vocab.VERDICTS])
def test_each_verdict(verdict, outcome):
    assert vocab.classify(verdict) == outcome
    assert vocab.is_kept(verdict) == (outcome in vocab.COARSE)
    if not vocab.is_kept(verdict):
        with pytest.raises(ValueError, match=outcome):
            vocab.coarse_class_of(verdict)


@pytest.mark.parametrize("near", ["accepted", "Accepted ", " Accepted", "WRONG ANSWER", "Wrong  Answer", "Internal Error", "Presentation Error", ""])
def test_near_misses_raise(near):
    with pytest.raises(vocab.UnknownVerdictError):
        vocab.classify(near)


def test_all_unknown_are_named():
    with pytest.raises(vocab.UnknownVerdictError, match=r"2 unknown.*\['Aha', 'Oho'\]"):
        vocab.check_verdicts(["Oho", "Accepted", "Aha", "Oho", "Wrong Answer"])


def test_leaves_with_the_rows_of_their_class(spark):
    from lakeloom.operators.labeling import leaf_coverage

    df = spark.createDataFrame([("LOGICAL",)] * 3 + [("RUNTIME_ERROR",)] * 2, "coarse_label string")
    rows = {r.leaf: (r.class_rows, r.leaf_rows) for r in leaf_coverage(df).collect()}
    assert len(rows) == len(vocab.LEAVES)
    assert rows["LOGICAL"] == (3, 3) and rows["SIGFPE"] == (2, 0) and rows["ERROR_FREE"] == (0, 0)
