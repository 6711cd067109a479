"""The review log replayed event by event."""

from plotlink.operators import ledger


def replay(spark, steps, needs=(), links=(), advice=None, failing=()):
    ids = sorted({i for i, _ in steps} | {x for n in needs for x in n} | {x for n in links for x in n})
    events = spark.createDataFrame([("s", k, i, d) for k, (i, d) in enumerate(steps)], "session string, seq long, id long, decision string").repartition(3)
    candidates = spark.createDataFrame([(i, (advice or {}).get(i, "ANGLEICHEN"), i not in failing, "extra") for i in ids], "id long, recommendation string, can_apply boolean, links string")
    wait = spark.createDataFrame([(a, b, n) for n, (a, b) in enumerate(needs)], "candidate long, prerequisite long, n int")
    link = spark.createDataFrame(list(links), "src long, dst long")
    reach = {i: {i} for i in ids}
    for _ in ids:
        for a, b in links:
            for i in ids:
                if a in reach[i]:
                    reach[i].add(b)
    groups = spark.createDataFrame([(i, j) for i in ids for j in reach[i]], "start long, node long")
    out = ledger.replayed(events, candidates, wait, link, groups)
    steps = [(r.outcome, r.redirect, [(c.id, c.status) for c in r.changes]) for r in out.orderBy("seq").collect()]
    return steps, {r.id: r.status for r in ledger.final_states(out).collect()}


def test_an_early_accept_is_held_and_not_made_up_for(spark):
    steps, final = replay(spark, [(10, "accept"), (20, "accept")], needs=[(10, 20)])
    assert steps == [("held", 20, []), ("applied", None, [(20, "applied")])] and final == {20: "applied"}


def test_a_skipped_prerequisite_is_opened_and_a_rejected_one_lets_pass(spark):
    steps, final = replay(spark, [(20, "skip"), (10, "force"), (20, "reject"), (10, "accept"), (10, "reject"), (20, "accept")], needs=[(10, 20)])
    assert [s[0] for s in steps] == ["skipped", "held", "rejected", "applied", "ignored", "ignored"]
    assert steps[1] == ("held", 20, [(20, "open")]) and final == {10: "applied", 20: "rejected"}


def test_groups_follow_undecided_members_only(spark):
    links = [(1, 2), (2, 3), (3, 4), (4, 1)]
    steps, final = replay(spark, [(3, "reject"), (1, "accept"), (4, "accept")], links=links)
    assert steps[1][2] == [(1, "applied"), (2, "applied")] and steps[2][2] == [(4, "applied")]
    assert final == {1: "applied", 2: "applied", 3: "rejected", 4: "applied"}


def test_reset_needs_the_last_command_and_undo_takes_groups_back(spark):
    steps, final = replay(spark, [(1, "accept"), (5, "accept"), (2, "reset"), (5, "reset"), (2, "reset"), (2, "redo"), (1, "undo"), (5, "redo"), (7, "accept"), (7, "redo"), (7, "undo")], links=[(1, 2)])
    assert [s[0] for s in steps] == ["applied", "applied", "ignored", "undone", "undone", "redone", "undone", "redone", "applied", "ignored", "undone"]
    assert steps[4][2] == [(1, "open"), (2, "open")] and steps[7][2] == [(1, "applied"), (2, "applied")]
    assert final == {1: "applied", 2: "applied", 5: "open", 7: "open"}


def test_what_is_refused_fails_or_is_unknown(spark):
    steps, final = replay(spark, [(1, "accept"), (1, "force"), (2, "force"), (3, "force"), (4, None), (4, "skip"), (4, "skip"), (4, "reset")], advice={1: "DISKREPANZ", 2: "MANUELL"}, failing=[3])
    assert [s[0] for s in steps] == ["refused", "applied", "refused", "failed", "ignored", "skipped", "ignored", "reset"] and final == {1: "applied", 4: "open"}
    assert replay(spark, [])[0] == []
