import io
import json
import zipfile

from pyspark.sql import functions as F

from pagewright.operators import messages as M, paging as P, runs, selection as S
from pagewright.sources import archives

MEMBERS = "target string, ord long, name string, size long, is_dir boolean"


def test_caps_and_nulls(spark):
    rows = [("t", 0, "a.txt", 5, False), ("t", 1, "b.bin", 5, False), ("t", 2, "c.txt", 500, False), ("t", 3, "d/", 0, True), ("t", 4, "e.txt", None, False), ("t", 5, "f.txt", 9, False), ("t", 6, "g.txt", 1, None), (None, 0, None, None, None)]
    m = spark.createDataFrame(rows, MEMBERS)
    got = S.select_members(m, per_file=100, count=3, total=14).orderBy("ord").collect()
    assert [(r["ord"], r["running"]) for r in got] == [(0, 5), (4, 5), (5, 14)]
    assert [r["ord"] for r in S.select_members(m, per_file=100, count=9, total=13).orderBy("ord").collect()] == [0, 4]
    assert S.probe_member(m).first()["name"] == "g.txt"
    assert {r["warning"] for r in S.size_warnings(m, 100).collect()} == {"skipped c.txt: 500 bytes over per-file cap", "skipped unsafe member: "}
    assert S.select_members(m.limit(0)).count() == 0


def test_packages_of_archives(spark, tmp_path):
    def archive(name, members):
        with zipfile.ZipFile(tmp_path / name, "w") as z:
            for k, v in members.items():
                z.writestr(k, v)

    archive("one.zip", {"inner/readme.txt": "First one. Second one. " * 5, "inner/data.csv": "a,b\n1,2", "tool.exe": b"\x00\x01", "../evil.txt": "no"})
    archive("empty.zip", {"x.png": b"1"})
    (tmp_path / "broken.zip").write_bytes(b"nothing")
    (tmp_path / "plain.txt").write_text("no archive")
    (tmp_path / "s.7z").write_bytes(b"7z")
    pages, errors = archives.scan_folder(spark, str(tmp_path), page_chars=60, ratio=0.9)
    got = [r["text"] for r in pages.orderBy("page_no").collect()]
    assert got[0].startswith("Catalog") and "text files packed: 2 / 3" in got[-1] and "tool.exe (2 bytes, not usable" in got[-1] and "- inner/readme.txt" in got[-1]
    said = {r["target"].rsplit("/", 1)[-1]: r["error"] for r in errors.collect()}
    assert said["plain.txt"].endswith("not a zip/7z archive") and "listing failed" in said["broken.zip"] and "7z" in said["s.7z"] and "one.zip" not in said


def test_page_requests_deliver_once(spark):
    ctx = spark.createDataFrame([("r", 1, 10, "x"), ("r", 2, 11, "y")], "run_id string, page_no long, page_id long, text string")
    rows = [(1, "r", 1, 1, 1), (2, "r", 1, 2, 1), (3, "r", 1, 3, 9), (4, "r", 1, 4, None), (5, "r", 2, 1, 2), (6, "q", 1, 1, 1)]
    rep = spark.createDataFrame(rows, "msg_id long, run_id string, session long, turn long, page long").withColumn("branch", F.lit("read_page"))
    got = {r["msg_id"]: r["verdict"] for r in M.page_requests(rep, ctx).collect()}
    assert got == {1: "deliver", 2: "stall", 3: "stall", 4: "stall", 5: "deliver", 6: "stall"}


def test_memo_pages_equal_repaging_everything(spark):
    from tests.test_functions import pages

    notes = ["One. Two. Three.", "Four words are here. Five.", "", "Six! " * 20]
    import json

    rows = [(i, "r", 1, i, json.dumps({"action": "write_memo", "memo": n})) for i, n in enumerate(notes)]
    rep = spark.createDataFrame(rows, "msg_id long, run_id string, session long, turn long, doc string").withColumn("branch", F.lit("write_memo"))
    for r in M.memo_pages(rep, 30, 0.9).orderBy("section").collect():
        want = pages("\n".join(notes[: r["section"]]), 30, 0.9)
        assert (r["pages"], r["tail"]) == (len(want), want[-1] if want else "")


def test_registry_last_word(spark):
    rows = [("a", "t", "running", "", None, "2020-01-01"), ("a", "t", " Done", "ok", None, "2020-01-02"), ("a", "t", "done", "ok", "late", "2020-01-03"), ("b", "u", "running", None, None, "2020-01-01"), (None, None, None, None, None, None)]
    log = spark.createDataFrame(rows, "run_id string, target string, status string, state string, error string, logged_at string")
    got = {r["run_id"]: (r["status"], r["state"], r["error"]) for r in runs.registry_state(log).collect()}
    assert got["a"] == ("done", "ok", "late") and got["b"] == ("running", "", "")


def test_recognition(spark):
    rows = [("a.txt", bytearray(b"hi")), ("a.exe", bytearray(b"hi")), ("b.txt", bytearray()), ("c.txt", bytearray(b"\x00")), (None, None), ("d.txt", None)]
    got = P.recognized(spark.createDataFrame(rows, "rel string, content binary")).collect()
    assert [r["text"] for r in got] == ["hi", None, None, None, None, None]


def test_sidecars_keep_lists(spark, tmp_path):
    rows = spark.createDataFrame([("a.publish.json", "r", "T", "c", "s", ["x|y", "z"], [], 0.5)], "path string, run_id string, title string, category string, summary string, tags array<string>, language array<string>, confidence double")
    runs.write_sidecars(rows, str(tmp_path / "out"))
    got = json.loads(spark.read.json(str(tmp_path / "out")).first()["value"])["identity"]
    assert got["tags"] == ["x|y", "z"] and got["language"] == []


def test_memo_page_must_be_there_by_then(spark):
    say = lambda i, doc: (i, "r", 1, i, "assistant", json.dumps(doc), None, None)
    rows = [say(1, {"action": "read_memo", "page": 1}), say(2, {"action": "write_memo", "memo": "One note. " * 9}), say(3, {"action": "read_memo", "page": 2}), say(4, {"action": "read_memo", "page": 999}), say(5, {"action": "read_memo", "page": "1"})]
    log = M.unique_messages(spark.createDataFrame(rows, "msg_id long, run_id string, session long, turn long, role string, text string, prompt_key string, logged_at timestamp"))
    got = {r["msg_id"]: r["verdict"] for r in M.memo_verdicts(M.parsed_replies(log), page_chars=50, ratio=1.0).collect()}
    assert got == {1: "stall", 2: "memo_saved", 3: "deliver", 4: "stall", 5: "stall"}


def test_first_arrivals(spark, monkeypatch):
    rows = spark.createDataFrame([(1, 5, "b"), (1, 3, "a"), (1, None, "c"), (2, None, "d"), (None, 2, "e"), (None, 1, "f"), (3, 1, None)], "k long, t long, v string")
    want = {(1, 3, "a"), (2, None, "d"), (None, 1, "f"), (3, 1, None)}
    assert {tuple(r) for r in M.first_arrivals(rows, "k", "t").collect()} == want
    monkeypatch.setattr(M, "FEW_KEYS", 0)
    assert {tuple(r) for r in M.first_arrivals(rows, "k", "t").collect()} == want and M.first_arrivals(rows.limit(0), "k", "t").count() == 0
