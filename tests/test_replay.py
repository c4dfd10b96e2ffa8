"""What scripted replies bring about; the last reply repeats."""

import json

import pytest

from pagewright.streaming.replay import Limits, State, guard, replay, step

GOOD = {"title": "t", "category": "c", "summary": "s", "tags": [], "language": ["en"], "confidence": 0.5}


def act(action, **more):
    return json.dumps({"action": action, "page": None, "memo": None, "identity": None} | more)


PUBLISH, BAD = act("publish", identity=GOOD), act("publish", identity={"title": "t"})
READ = act("read_page", page=1)


def drive(replies, limits, sent=40, most=12):
    s, out = State(4, limits.retries), []
    for i in range(most):
        while before := guard(s, limits):
            out += before
            if before != ["roll"]:
                break
        s.chars += sent
        out.append(step(s, replies[min(i, len(replies) - 1)], limits))
        if s.over:
            break
    return s, out


@pytest.mark.parametrize(
    ("replies", "limits", "over", "counts"),
    [
        ([PUBLISH], {}, "published", {}),
        ([READ, READ, PUBLISH], {}, "published", {"stall_to_publish": 1, "page_deliver": 1}),
        ([READ, BAD, PUBLISH], {"rolls": 0, "force": 5}, "published", {"publish_retry": 1, "force_publish": 1}),
        ([BAD, PUBLISH], {}, "published", {"publish_retry": 1}),
        ([BAD], {}, "gave up", {"publish_retry": 3}),
        (["not json", PUBLISH], {}, "published", {"bad_json_retry": 1}),
        ([act("help"), PUBLISH], {}, "published", {"help": 1}),
        ([act("write_memo", memo="note"), act("read_memo", page=1), PUBLISH], {}, "published", {"memo_saved": 1, "memo_deliver": 1}),
        ([act("write_memo", memo=123), PUBLISH], {}, "published", {"memo_reject": 1}),
        ([READ, PUBLISH], {"rolls": 0, "remind": 5}, "published", {"remind": 1}),
        ([READ, act("help"), PUBLISH], {"rolls": 0, "force": 5}, "published", {"force_publish": 1, "publish_retry": 1}),
        ([READ, READ, READ], {"rolls": 0, "force": 5, "retries": 1}, "gave up", {"publish_retry": 1}),
        ([BAD, BAD, BAD, PUBLISH], {"rolls": 0, "force": 5, "retries": 2}, "published", {"publish_retry": 3, "force_publish": 1}),
        ([READ, act("read_chatlog", page=1), act("read_chatlog", page=1), PUBLISH], {"force": 5}, "published", {"chatlog_deliver": 2}),
        ([act("read_page", page=True), PUBLISH], {}, "published", {"stall_to_publish": 1}),
        ([act("anything", page=2), PUBLISH], {}, "published", {"page_deliver": 1}),
    ],
)
def test_scripts(replies, limits, over, counts):
    s, out = drive(replies, Limits(**limits))
    assert s.over == over, out
    for key, n in counts.items():
        assert out.count(key) == n, out


def test_batch_replay_keeps_runs_apart(spark):
    rows = [("a", 1, 1, 1, "user", "x"), ("a", 1, 2, 2, "assistant", READ), ("a", 1, 3, 3, "assistant", READ), ("a", 1, 4, 4, "assistant", PUBLISH), ("a", 1, 5, 5, "assistant", READ), ("b", 1, 1, 6, "assistant", READ), (None, None, None, 7, "assistant", None)]
    m = spark.createDataFrame(rows, "run_id string, session long, turn long, msg_id long, speaker string, text string")
    ctx = spark.createDataFrame([("a", 1), ("a", 2)], "run_id string, page_no long")
    got = {r["msg_id"]: r["answer"] for r in replay(m, ctx).collect()}
    assert got == {2: "page_deliver", 3: "stall_to_publish", 4: "published", 5: "after the end", 6: "stall_to_publish", 7: "bad_json_retry"}


def test_texts_stay_out_of_the_shuffle(spark):
    assert step(State(4, 3), act("read_page", page=1 << 70), Limits()) == "stall_to_publish" and step(State(4, 3), act(["help"], page=2), Limits()) == "page_deliver"
    m = spark.createDataFrame([("a", 1, 1, 1, "user", "x")], "run_id string, session long, turn long, msg_id long, speaker string, text string")
    plan = replay(m, spark.createDataFrame([("a", 1)], "run_id string, page_no long"))._jdf.queryExecution().optimizedPlan().toString()
    above = plan.split("RepartitionByExpression")[1].split("ArrowEvalPython")[0]
    assert "fits" in above and "text#" not in above
