"""Bad CSV lines: every line of the files is accounted for, offsets point at the lines."""

from collections import Counter


from riskmart.plans import catalog
from riskmart.sources.quarantine import read_csv_checked
from tests.conftest import SF_SMALL


def test_lines_add_up_and_offsets_point(spark, tmp_path):
    head = "id,name,score"
    good = [f'{i},"n ""{i}"", é",{i / 4}' for i in range(400)]
    bad = ["7,x", "8,a,1.5,extra", '9,"open,2', "x9,a,1.0", "10,a,abc", '"11,b,3"']
    want = []
    for k, end in enumerate(("\n", "\r\n")):
        lines = [head, *good[:200], *bad[:3], "", *good[200:], *bad[3:], "   "]
        with open(tmp_path / f"f{k}.csv", "wb") as f:
            f.write((b"\xef\xbb\xbf" if k else b"") + end.join(lines).encode() + (end.encode() if k else b""))
        want += bad
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")      # parts inside the files
    try:
        rows, quarantine = read_csv_checked(spark, str(tmp_path), "id long, name string, score double")
        got, out = rows.collect(), quarantine.collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert Counter(map(tuple, got)) == Counter({(i, f'n "{i}", é', i / 4): 2 for i in range(400)})
    assert Counter(r["line"] for r in out) == Counter(want)
    why = {r["line"]: r["reason"] for r in out}
    assert [why[x] for x in bad] == ["too few fields", "too many fields", "unclosed quote", "wrong type", "wrong type",
                                     "too few fields"]
    for r in out:
        with open(r["file"].removeprefix("file:"), "rb") as f:
            f.seek(r["offset"])
            assert f.readline().rstrip(b"\r\n").decode() == r["line"]


def test_text_columns_tokens_and_empty_files(spark, tmp_path):
    (tmp_path / "a.csv").write_text("a,b\n?,1\n,2\nx\n")
    rows, bad = read_csv_checked(spark, str(tmp_path / "a.csv"))
    assert rows.columns == ["a", "b"] and sorted(map(tuple, rows.collect()), key=str) == [(None, "1"), (None, "2")]
    assert [(r["offset"], r["line"]) for r in bad.collect()] == [(11, "x")]
    (tmp_path / "b.csv").write_text("")
    rows, bad = read_csv_checked(spark, str(tmp_path / "b.csv"), "a string, b string")
    assert rows.count() == 0 and bad.count() == 0


def test_query(spark, duck):
    got = catalog.queries()["csv_quarantine"](spark, SF_SMALL)
    want = duck.execute(f"SELECT {', '.join(got.columns)} FROM ({catalog.oracles()['csv_quarantine']})").fetchall()
    assert sorted(map(tuple, got.collect())) == sorted(want)
