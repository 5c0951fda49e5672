import math
import random

import numpy as np
import pytest
from driftline.operators import scoring
from driftline.plans import registry

SF = "/root/testdata/sf0.001"
#: Queries that score every target line.
SCORING = (
    "display_dedupe", "report_json", "report_separators", "report_totals", "single_index_fallback", "anomaly_source_counts", "context_windows", "log_report_sorted",
    "reduction_percent", "report_ignored_patterns", "report_lines", "report_order", "report_sources", "set_cosine_distance", "severity_histogram",
)


@pytest.mark.parametrize("name", SCORING)
def test_no_shuffle_is_dealt_by_words(spark, name):
    """Word sets are joined by their hashes: as arrays of words they took more disk than the lines."""
    plan = registry.queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    dealt = [x for x in plan.split("\n") if "Exchange hashpartitioning(" in x]
    assert dealt and not [x for x in dealt if "words" in x.split("ENSURE")[0]]


def test_overlaps_equal_brute_force():
    """Frequent and rare words, overlaps beyond a byte, words and sets that the baseline lacks."""
    dice = random.Random(3)
    sets = [sorted({int(dice.paretovariate(0.6)) % 5000 for _ in range(dice.choice((1, 3, 40, 900)))}) for _ in range(300)]
    sets[160] = list(range(400))
    known, asked = sets[:200], [*sets[150:], [], [9999]]
    flat = np.array([w for s in known for w in s])
    held = scoring.Postings(flat, np.array([len(s) for s in known]))
    got = held.similarities(np.array([w for s in asked for w in s]), np.array([len(s) for s in asked]))
    assert len(held.often) and max(map(len, known)) > 300
    want = [max((len({*s} & {*k}) / math.sqrt(len(s) * len(k)) for k in known), default=0) if s else 0.0 for s in asked]
    assert np.allclose(got, want)


def test_rounds_keep_both_bounds_and_hold_every_set(spark):
    rows = [("ab"[i % 7 > 0], [f"w{i}", f"v{i}"]) for i in range(70)] + [(None, ["x"]), ("c", [])]
    known = scoring.Known(spark.createDataFrame(rows, "index_name string, words array<string>"))
    rounds = known.rounds(50, 20)
    assert len(rounds) > 3 and sorted(x for x in known.names.collect() if x[0]) == [("a",), ("b",), ("c",)]
    held = [sum(p.n for p in known.postings(r).values()) for r in rounds]
    assert sum(held) == 71
