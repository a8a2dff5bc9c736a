"""Values that lie exactly between two rounded ones: sums of doubles fall to either side by their order, the query's rows must not."""

import os

import pytest

from undula.plans import catalog

DATA = "/root/testdata/sf0.1"


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables here")
def test_summary_rounds_exact_halves_up(spark):
    """In rational numbers these deviations are 0.05625, these means 0.98495 and 0.98565."""
    got = {(r["track"], r["metric"]): r for r in catalog.queries()["a4_summary"](spark, DATA).collect()}
    assert [got[t, "zcr"]["std"] for t in (11, 403)] == [0.0563, 0.0563]
    assert [got[t, "peak"]["mean"] for t in (256, 1449)] == [0.985, 0.9857]
