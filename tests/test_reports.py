"""Reports and reviews against plain loops over submissions and decisions in order of time."""

import random
import re

from ringwarden.operators.reports import blacklist_after, decided, reviewed

SENT = "id long, reporter_id long, call_id long, raw_number string, reason string, created_at long, extra string"
DECIDED = "decision_id long, report_id long, verdict string, reason string, at long"


def number(raw):
    if raw is None or not raw.strip():
        return None
    s = re.sub(r"[\s.()-]", "", raw)
    if not re.fullmatch(r"\+?[0-9]{6,15}", s):
        raise ValueError
    if s.startswith("0") and len(s) >= 10:
        return "+84" + s[1:]
    return "+" + s if s.startswith("84") and len(s) >= 11 else s


def submit_all(sent, calls, listed, most):
    stored, out = [], {}
    for i, who, call, raw, reason, at, _ in sorted(sent, key=lambda r: (r[5] is not None, r[5] or 0, r[0])):
        def outcome():
            try:
                phone = number(raw)
            except ValueError:
                return "INVALID_PHONE_NUMBER"
            if call is not None:
                if calls.get(call, (None,))[0] != who:
                    return "CALL_NOT_FOUND"
                caller = calls[call][1]
                if phone is None:
                    phone = caller
                elif caller is not None and phone != caller:
                    return "PHONE_NUMBER_MISMATCH"
            if phone is None:
                return "INVALID_PHONE_NUMBER"
            if reason and reason.strip() and len(reason) > 10:
                return "VALIDATION_FAILED"
            if phone in listed:
                return "PHONE_NUMBER_ALREADY_BLACKLISTED"
            if (who, phone) in stored:
                return "NUMBER_ALREADY_REPORTED"
            if sum(w == who for w, _ in stored) >= most:
                return "TOO_MANY_PENDING_REPORTS"
            stored.append((who, phone))
            return "ACCEPTED"
        out[i] = outcome()
    return out


def test_submissions_equal_a_loop_in_order_of_time(spark):
    rng = random.Random(5)
    calls = {i: (rng.randrange(6), rng.choice([None, "+84900000001", "+84900000002", "+84900000003"])) for i in range(40)}
    raws = [None, "", " \t", "()", "abc", "0900000001", "84 900-000-002", "+84900000003", "0900000004", "0900000005", "123456", "12345"]
    sent = [(i, rng.randrange(6), rng.choice([None, rng.randrange(45)]), rng.choice(raws), rng.choice([None, " ", "bad", " " * 20, "x" * 11]), rng.choice([None, *range(30)]), "e") for i in range(600)]
    listed = {"+84900000005"}
    out = decided(spark.createDataFrame(sent, SENT), spark.createDataFrame([(i, *v, "e") for i, v in calls.items()], "id long, user_id long, caller_number string, reason string"),
                  spark.createDataFrame([(x,) for x in listed], "phone_number string"), most_pending=3, most_signs=10)
    got = {r.id: r.outcome for r in out.collect()}
    want = submit_all(sent, calls, listed, 3)
    assert got == want and len(set(want.values())) == 8
    empty = decided(spark.createDataFrame([], SENT), spark.createDataFrame([], "id long, user_id long, caller_number string"), spark.createDataFrame([], "phone_number string"))
    assert empty.count() == 0


def test_reviews_equal_a_loop_over_decisions(spark):
    rng = random.Random(6)
    reports = [(i, f"n{rng.randrange(25)}", rng.choice([None, f"r{i}"])) for i in range(120)]
    taken = [(d, rng.randrange(130), rng.choice(["APPROVE", "REJECT", "REJECT"]), rng.choice([None, "  ", f" d{d} "]), rng.randrange(40)) for d in range(150)]
    book = {f"n{k}": (k % 2 == 0, f"old{k}") for k in range(0, 25, 3)}
    state, results, after = {i: "PENDING" for i, _, _ in reports}, {}, dict(book)
    by_id = {i: (n, r) for i, n, r in reports}
    for d, report, verdict, reason, _ in sorted(taken, key=lambda x: (x[4], x[0])):
        if report not in by_id:
            results[d] = "BLACKLIST_REPORT_NOT_FOUND"
        elif state[report] != "PENDING":
            results[d] = "REPORT_ALREADY_REVIEWED"
        elif verdict == "REJECT":
            state[report] = results[d] = "REJECTED"
        else:
            n, text = by_id[report][0], (reason or "").strip() or None
            after[n] = (True, text or (after[n][1] if n in after else by_id[report][1]))
            for i, m, _ in reports:
                if m == n and state[i] == "PENDING":
                    state[i] = "APPROVED"
            results[d] = "APPROVED"
    r = spark.createDataFrame(reports, "id long, phone_number string, reason string")
    states, outcomes, approved = reviewed(r, spark.createDataFrame(taken, DECIDED))
    assert {x.id: x.status for x in states.collect()} == state
    assert {x.decision_id: x.result for x in outcomes.collect()} == results
    numbers = spark.createDataFrame([(n, *v) for n, v in book.items()], "phone_number string, active boolean, reason string")
    assert {x.phone_number: (x.active, x.reason) for x in blacklist_after(numbers, approved).collect()} == after
