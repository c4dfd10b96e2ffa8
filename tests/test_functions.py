import json
import re

from pyspark.sql import functions as F

from pagewright.functions import replies as R, text as X


def one(spark, value, column, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(column(F.col("v")).alias("r")).first()["r"]


def sentences(text):
    out, buf = [], ""
    for c in text:
        buf += c
        if c in "。！？；;\n.!?":
            out, buf = [*out, buf.strip()], ""
    return [s for s in [*out, buf.strip()] if s]


def pages(text, most, ratio):
    done, page = [], ""
    for s in sentences(text):
        if len(s) > max(1, int(most * ratio)):
            continue
        if page and len(page) + 1 + len(s) > most:
            done, page = [*done, page], s
        else:
            page = f"{page}\n{s}" if page else s
    return done + [page] if page else done


TEXTS = ["", "One. Two! Three? tail", "3.14 is... pi\n\nnext。下一句！完；好", "  x　.", "a" * 40 + ". b.", "no end", "\r\n.\n"]


def test_sentences_and_pages_equal_a_plain_reading(spark):
    for t in TEXTS:
        assert one(spark, t, X.sentences) == sentences(t)
        for most, ratio in ((8, 0.5), (50, 0.1), (20, 2.0)):
            assert one(spark, t, lambda c: X.paginate(c, most, ratio)) == pages(t, most, ratio)
    assert one(spark, None, X.sentences) is None


def test_pages_keep_within_size_and_repaging_changes_nothing(spark):
    got = pages("One. Two words! " * 30, 25, 1.0)
    assert all(len(p) <= 25 for p in got) and pages("\n".join(got), 25, 1.0) == got


def test_decode_and_binary(spark):
    assert one(spark, bytearray(b"a\r\nb\rc\xff"), X.decode_text, "binary") == "a\nb\nc�"
    for raw, want in ((b"", False), (b"abc\n", False), (b"ab\x00", True), (b"\x01" * 2 + b"a" * 8, True), (b"\x01" + b"a" * 9, False), (b"\xff" * 9, False)):
        assert one(spark, bytearray(raw), X.looks_binary, "binary") is want


def test_paths(spark):
    cases = {"a/b.txt": "a/b.txt", "a\\b": "a/b", "/abs": None, "../x": None, "a/../b": None, "C:x": None, "./a//b/": "a/b", "": None, ".": None, "a..b": "a..b"}
    for name, want in cases.items():
        assert one(spark, name, X.safe_path) == want, name
    assert one(spark, "d/.hidden", X.suffix) == "" and one(spark, "a.TAR.Gz", X.suffix) == ".gz"
    for name, want in {"README.first": True, "x.exe": True, "my.key": True, "key.my": False, "author": True, "notes": False}.items():
        assert one(spark, name, X.notable) is want


def walked(names, folder=()):
    """Names as a walk from folder to folder meets them."""
    inside = [n for n in names if tuple(n.split("/")[: len(folder)]) == folder]
    files = sorted(n for n in inside if n.count("/") == len(folder))
    deeper = sorted({n.split("/")[len(folder)] for n in inside if n.count("/") > len(folder)})
    return files + [n for d in deeper for n in walked(names, (*folder, d))]


def test_walk_order_compares_names_part_by_part(spark):
    names = ["b/a.txt", "a.txt", "b/c/d.txt", "b.txt", "a/b.txt", "a!/z.txt", "a-b/c.txt", "a b/x.txt", "a.b/q/y.txt", "a/b/!.txt", "a/b-c/k.txt", "a/b/c/m.txt", "ä/n.txt", "a0/o.txt"]
    rows = spark.createDataFrame([(n,) for n in names], "v string").orderBy(X.walk_key(F.col("v"))).collect()
    assert [r["v"] for r in rows] == walked(names)


def test_reply_json(spark):
    cases = {'{"a": 1}': {"a": 1}, '```json\n{"a": 1}\n```': {"a": 1}, 'x {"a": {"b": 2}} y': {"a": {"b": 2}}, '{"x":1} {"y":2}': None, "[1]": None, "": None, '{"a": 1': None, '{"a":1,"a":2}': {"a": 2}}
    for text, want in cases.items():
        got = one(spark, text, R.reply_json)
        assert (json.loads(got) if got else None) == want, text
    assert one(spark, None, R.reply_json) is None


SHAPE = {"kind": "note", "size": 0, "place": {"shelf": "", "level": 4, "box": {"open": True, "marks": []}}, "extra": None}
FILLED = {"kind": "note", "size": 2.5, "place": {"shelf": "left", "level": 4, "box": {"open": True, "marks": ["x"]}}, "extra": [1]}


def changed(path, value=None, drop=False):
    doc = json.loads(json.dumps(FILLED))
    node = doc
    for k in path[:-1]:
        node = node[k]
    if drop:
        del node[path[-1]]
    else:
        node[path[-1]] = value
    return doc


def test_template_check(spark):
    cases = [
        (FILLED, []), (changed(["size"], 4), []), (changed(["size"], True), ["size: expected number"]), (changed(["size"], "2"), ["size: expected number"]),
        (changed(["kind"], "memo"), ["kind: expected 'note'"]), (changed(["place", "level"], "4"), ["place.level: expected 4"]), (changed(["place", "level"], 4.0), []), (changed(["place", "level"], None), ["place.level: expected 4"]),
        (changed(["place", "box", "open"], "true"), ["place.box.open: expected True"]), (changed(["place", "box", "open"], False), ["place.box.open: expected True"]), (changed(["place", "box", "marks"], {}), ["place.box.marks: expected list"]),
        (changed(["place", "box"], 7), ["place.box: expected object"]), (changed(["place"], drop=True), ["place: missing"]), (changed(["place", "shelf"], None), ["place.shelf: expected string"]), (changed(["extra"], drop=True), ["extra: missing"]),
    ]
    for doc, want in cases:
        assert one(spark, json.dumps(doc), lambda c: R.check_template(c, SHAPE)) == want, doc
    mixed = changed(["place", "box", "lid"], 1) | {"kind": "note", "new": 1}
    mixed["place"]["side"], mixed["extra"] = 2, 3
    del mixed["place"]["shelf"]
    assert one(spark, json.dumps(mixed), lambda c: R.check_template(c, SHAPE)) == ["place.shelf: missing", "place.box.lid: unexpected", "place.side: unexpected", "new: unexpected"]
    assert one(spark, None, lambda c: R.check_template(c, SHAPE)) == ["root: expected object"]


def test_schema_and_contracts():
    s = R.response_format("session_actions")["schema"]
    assert s["required"] == ["action", "page", "memo", "identity"] and s["properties"]["action"]["enum"] == list(R.ACTIONS) and s["properties"]["page"] == {} and s["additionalProperties"] is False
    assert R.json_schema({"a": True, "b": 0, "c": []})["properties"] == {"a": {"type": "boolean"}, "b": {"type": "number"}, "c": {"type": "array"}}
    lines = R.render_contract("session_actions").split("\n")
    assert lines[0] == "contract session_actions" and len(lines) == 1 + len(R.ACTIONS) and json.loads(lines[1])["action"] == "read_page"


def test_page_numbers_are_whole_json_numbers(spark):
    for text, want in {'{"page": 3}': 3, '{"page": 3.0}': None, '{"page": true}': None, '{"page": "3"}': None, "{}": None}.items():
        assert one(spark, text, R.page_number) == want


def test_render(spark):
    got = one(spark, "x{b}", lambda c: X.render(F.lit("{a}-{b}-{c}"), a=c, b=F.lit("B")))
    assert got == "xB-B-{c}"


def test_registered_functions_are_the_columns(spark):
    X.register(spark)
    raw = [b"", b"abc\n", b"ab\x00", b"\x01\x02\x03\x04abc", b"\x01" * 2 + b"a" * 8, b"\x01" + b"a" * 9, b"\xff" * 9, None]
    df = spark.createDataFrame([(bytearray(b) if b is not None else None,) for b in raw], "b binary").select(X.looks_binary(F.col("b")).alias("c"), F.expr("looks_binary(b)").alias("s"))
    assert all(r["c"] == r["s"] for r in df.collect())
    names = spark.createDataFrame([(n,) for n in ("a/b.txt", "a\\b", "/abs", "../x", "a/../b", "C:x", "./a//b/", "", ".", "a..b", None)], "n string")
    assert all(r["c"] == r["s"] for r in names.select(X.safe_path(F.col("n")).alias("c"), F.expr("safe_path(n)").alias("s")).collect())
    texts = spark.createDataFrame([(t,) for t in [*TEXTS, None]], "t string").select(
        X.sentences(F.col("t")).alias("a"), F.expr("split_sentences(t)").alias("b"), X.paginate(F.col("t"), 20, 0.5).alias("c"), F.expr("paginate(t, 20, 10)").alias("d"), F.expr("strip_text(t)").alias("e"), X.strip(F.col("t")).alias("f")
    )
    assert all(r["a"] == r["b"] and r["c"] == r["d"] and r["e"] == r["f"] for r in texts.collect())
