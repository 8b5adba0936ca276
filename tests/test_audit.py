"""The audit of a labelled corpus and the summary of scored rows against plain loops."""

import random
from collections import defaultdict

from ringwarden.operators.audit import audited
from ringwarden.operators.metrics import risk_summary


def test_reasons_equal_a_loop(spark):
    rng = random.Random(2)
    texts = [None, "", "  ﻿ ", "A b.", "a  B", "c d", "e", "e!", "!!", "??"]
    rows = [(i, rng.choice([None, "x", "y"]), rng.choice(texts), rng.choice([None, "0", "1", " 1 ", "2", "0"]), "k") for i in range(300)]
    want, groups = {}, defaultdict(list)
    for i, source, text, label, _ in rows:
        if text is None:
            want[i] = "missing_text"
        elif not text.replace("﻿", "").strip():
            want[i] = "empty_text"
        elif label is None or label.strip() not in ("0", "1"):
            want[i] = "invalid_label"
        else:
            groups[source, "".join(c if c.isalnum() else " " for c in text.lower()).strip().replace("  ", " ")].append((i, label.strip()))
    for found in groups.values():
        for n, (i, _) in enumerate(found):
            want[i] = "conflicting_label" if len({x for _, x in found}) > 1 else "exact_duplicate" if n else None
    schema = "id long, source string, text string, label string, extra string"
    assert {r.id: r.reason for r in audited(spark.createDataFrame(rows, schema)).collect()} == want
    assert set(want.values()) == {None, "missing_text", "empty_text", "invalid_label", "conflicting_label", "exact_duplicate"}
    assert audited(spark.createDataFrame([], schema)).count() == 0


def test_risk_summary_without_denominators(spark):
    schema = "part string, label int, level string, probability double, flagged boolean, capped boolean"
    rows = [("a", 0, "LOW", 0.2, False, False), ("b", 1, "LOW", 0.7, False, True), ("c", 1, "HIGH", 0.4, True, False), ("c", 1, "LOW", 0.9, False, False), ("c", 0, "MEDIUM", 0.5, True, False)]
    got = {r.part: r for r in risk_summary(spark.createDataFrame(rows, schema), ["part"]).collect()}
    assert (got["a"].precision, got["a"].recall, got["a"].f1, got["a"].accuracy) == (None, None, None, 1.0)
    assert (got["b"].precision, got["b"].recall, got["b"].f1, got["b"].capped, got["b"].model_missed, got["b"].rules_missed) == (None, 0.0, None, 1, 0, 1)
    c = got["c"]
    assert (c.precision, c.recall, c.f1, c.accuracy, c.model_missed, c.model_flagged, c.rules_missed, c.rules_flagged, c.model_accuracy) == (0.5, 0.5, 0.5, 0.3333, 1, 1, 1, 1, 0.3333)
