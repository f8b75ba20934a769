"""The pipeline's stages on a small corpus with planted cases, and its contract."""

import corpus_pipeline as P
from riskmart.llm import common, mixing
from riskmart.session import scratch_path

from .test_text_operators import prose

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def corpus(spark):
    root = scratch_path(spark, "corpus")
    rows, labels = [], []
    for i in range(400):
        w = prose(i, 60)
        if i % 8 == 0:
            w[i % 50], w[i % 11] = "rotten", "filthy"
        rows.append((i, "\n".join(" ".join(w[k:k + 20]) for k in range(0, 60, 20)), "en", f"s{i % 3}"))
        labels.append((i, 1, int(i % 8 == 0)))
    passage, bench = " ".join(prose(7000, 60)), " ".join(prose(8000, 30))
    rows += [(1000 + k, " ".join(prose(1000 + k, 50)) + "\n" + passage, "en", "s1") for k in range(5)]
    near = prose(9000, 300)
    rows += [(2000 + k, " ".join(near[:k * 9] + [f"q{k}"] + near[k * 9 + 1:]), "en", "s2") for k in range(4)]
    rows += [(3000, " ".join(prose(3000, 40)) + " " + bench, "en", "s0"), (3001, None, "en", "s0"), (3002, "", None, None),
             (None, " ".join(prose(3003, 40)), "en", "s0"), (3004, rows[1][1], "en", "s1"), (3, rows[3][1], "en", "s0")]
    spark.createDataFrame([(*r, len(r[1] or "")) for r in rows], "doc_id long, text string, lang string, source string, n_chars long") \
        .write.parquet(f"{root}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{root}/labels.parquet")
    spark.createDataFrame([(1, bench)], "item_id long, text string").write.parquet(f"{root}/benchmark.parquet")
    return root, passage


def test_stages(spark):
    root, passage = corpus(spark)
    docs = common.table(spark, root, "documents")
    seen = []
    for k, (_, stage) in enumerate(P.STAGES):
        docs = common.store(stage(spark, docs, root), "stage")
        assert k == len(P.STAGES) - 1 or docs.columns == COLUMNS
        seen.append({r["doc_id"]: r for r in docs.collect()})
    toxic, lines, groups, clean, mix = seen
    bad = {i for i in range(400) if i % 8 == 0}
    assert len(bad & set(toxic)) <= len(bad) * 0.1 and set(range(400)) - bad <= set(toxic)
    assert [i for i in range(1000, 1005) if passage in lines[i]["text"]] == [1000] and 3004 not in lines
    assert all(r["n_chars"] == len(r["text"]) for r in lines.values() if r["text"] is not None)
    assert {3001, 3002, None} <= set(lines)
    assert [i for i in range(2000, 2004) if i in groups] == [2000] and {1001, 5, 3001, 3002, None} <= set(groups)
    assert set(groups) - set(clean) == {3000}
    assert set(mix) == set(clean)
    taken = sum(r["taken"] for r in mix.values())
    assert abs(taken - sum({r["source"]: r["target"] for r in mix.values()}.values())) <= 200


def test_run_and_empty(spark):
    root, _ = corpus(spark)
    out = P.run(spark, root)
    assert out.count() > 0 and P.ORACLE_SQL is None and 4 <= len(P.STAGES) <= 5
    docs = common.table(spark, root, "documents").where("false")
    for _, stage in P.STAGES:
        docs = stage(spark, docs, root)
    assert docs.count() == 0


def test_ids_that_name_several_texts(spark):
    one, two, three = ("\n".join(" ".join(prose(s + k, 20)) for k in range(3)) for s in (100, 200, 300))
    rows = [(1, one), (1, two), (1, one), (2, one + "\n" + " ".join(prose(900, 12))), (3, three), (4, three), (4, two + " x"),
            (None, one), (5, None), (5, "")]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows],
                                 "doc_id long, text string, lang string, source string, n_chars long")
    got = sorted(((r["doc_id"], r["text"]) for r in P.one_of_each_group(spark, docs, "").collect()), key=str)
    # the first text of id 1 and its near copy 2 are a group that 2 leads, as do 3 over 4 and
    # one of the two near-equal texts of ids 1 and 4
    assert [g for g in got if g[0] in (2, 3, None)] == sorted([rows[3], rows[4], rows[7]], key=str)
    assert sum(t in (two, two + " x") for _, t in got) == 1
    assert {(5, None), (5, "")} <= set(got)
    lines = P.dedup_lines(spark, docs, "").collect()
    texts = "\n".join(r["text"] for r in lines if r["doc_id"] is not None and r["text"])
    for line in {x for i, t in rows if t for x in t.split("\n") if not x.endswith(" x")}:
        assert texts.split("\n").count(line) + texts.split("\n").count(line + " x") == 1, line
    assert any(r["doc_id"] == 2 for r in lines) and all(len(r["text"]) == r["n_chars"] for r in lines if r["text"])


def test_queries_are_registered():
    import __spark_entry__ as entry
    names = [n for n in entry.queries() if n.startswith("op")]
    assert sorted(int(n[2:].split("_")[0]) for n in names if n[2].isdigit()) == list(range(1, 14))
    assert "pipeline" in entry.queries() and mixing.oracle() == entry.oracle_sql()["op4_pareto_mix"]
