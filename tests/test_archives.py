"""Archives over the size limit."""

import zipfile

from pagewright.sources.archives import list_members, read_inbox


def test_large_archives_have_an_error_row(spark, tmp_path):
    for name, n in (("small.zip", 10), ("large.zip", 5000)):
        with zipfile.ZipFile(tmp_path / name, "w") as z:
            z.writestr("a.txt", "x" * n)
    rows = list_members(read_inbox(spark, str(tmp_path), 1000)).collect()
    assert {(r["target"].rsplit("/", 1)[1], r["name"], r["error"]) for r in rows} == {("small.zip", "a.txt", None), ("large.zip", None, "archive over the size limit")}
