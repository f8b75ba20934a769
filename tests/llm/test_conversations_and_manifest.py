"""Conversation repair and the Merkle manifest against brute force."""

import hashlib
import random
import re
import zlib
from itertools import pairwise

import pytest

from riskmart.llm import conversations as C
from riskmart.llm import manifest as M

TARGET = re.compile(r"(s?(ua)+)?\Z")
EMPTY = hashlib.sha256(b"").hexdigest()


def exhaustive(codes):
    """(cost, audit) by dynamic programming over all edits, without bounds."""
    best = {0: (0, "")}

    def inserted(table):
        out = dict(table)
        for _ in range(3):
            for s, (c, a) in list(out.items()):
                to = C.INSERTED[s]
                if to not in out or (c + 5, a + "I") < out[to]:
                    out[to] = (c + 5, a + "I")
        return out

    for code in codes:
        nxt = {}

        def offer(s, c, a):
            if s not in nxt or (c, a) < nxt[s]:
                nxt[s] = (c, a)
        for s, (c, a) in inserted(best).items():
            offer(s, c + 2, a + "D")
            if code[1] == "d":
                continue
            extra = 5 if code[1] == "t" else 0
            if s in C.SAID[code[0]]:
                offer(C.SAID[code[0]][s], c + extra, a + "K")
            for role in "ua":
                if s in C.SAID[role]:
                    offer(C.SAID[role][s], c + 1 + extra, a + "R")
        best = nxt
    best = inserted(best)
    return min(best[s] for s in (0, 3) if s in best)


@pytest.mark.parametrize("window", [1, 3, 16])
def test_search_is_optimal(window):
    rnd = random.Random(window)
    for _ in range(1500):
        codes = [rnd.choice("ssuuuaaax") + rnd.choice("ffftd") for _ in range(rnd.randrange(0, 24))]
        assert C.search(codes, C.START, C.TAIL, window) == exhaustive(codes), codes


def test_search_of_long_and_uniform_rows():
    for codes in (["af"] * 3000, ["ut"] * 3000, ["xf", "sf"] * 1500, ["ud"] * 3000, ["uf", "af"] * 1500):
        cost, audit = C.search(codes, C.START, C.TAIL)
        assert cost == exhaustive(codes)[0] and len(audit.replace("I", "")) == len(codes)


def reference(rows, ids):
    """conv_id -> result row, from (conv_id, turn, role, text) as they are."""
    out = {}
    for cid in ids:
        mine = sorted((r for r in rows if r[0] == cid), key=lambda r: (
            r[1] is not None, r[1] or 0, r[2].encode(),
            hashlib.sha256(f"{len(r[2].encode())}:{r[2]}{r[3]}".encode()).digest()))
        seen, codes, n = set(), [], {"b": 0, "r": 0, "t": 0, "f": 0}
        for _, _, role, text in mine:
            end = re.sub(r"[\x20\x09-\x0D]+\Z", "", text)
            fault = "b" if not end else "r" if (role, text) in seen else "f" if end[-1] in ".!?" else "t"
            seen.add((role, text))
            n[fault] += 1
            codes.append((role[:1] if role[:1] in tuple("sua") else "x") + ("d" if fault in "br" else fault))
        cost, audit = exhaustive(codes)
        state, said, at = 0, [], iter(mine)
        for e in audit:
            role, text = ("assistant" if state == 2 else "user"), ""
            if e != "I":
                _, _, own, text = next(at)
                role = own if e == "K" else role
            if e != "D":
                said.append((role, text))
                state = C.SAID[role[0]][state]
        assert TARGET.match("".join(r[0] for r, _ in said))
        turns = [r[1] for r in mine if r[1] is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in pairwise(mine))
        out[cid] = (gaps, n["b"], n["r"], n["t"], illegal, cost, audit,
                    hashlib.sha256("\n".join(f"{r}:{t}" for r, t in said).encode()).hexdigest())
    return out


SCHEMA = "conv_id long, turn long, role string, text string, pos int, block int, code string, h string"


def talk():
    rnd = random.Random(5)
    rows = []
    for c in range(60):
        for t in range(rnd.randrange(1, 14)):
            rows.append((c, t, rnd.choice(["user", "assistant", "assistant", "system", "tool", ""]),
                         rnd.choice(["Yes.", "No", "ok?", "", " \n", "Long. text", "é!", "x" * 50 + "."])))
    for t in range(700):             # one conversation holds most rows
        rows.append((900, t // 2, "assistant" if t % 3 else "user", f"turn {t % 400}" + "." * (t % 5 > 0)))
    rows += [(901, 3, "user", "Same.")] * 40
    rows += [(None, 1, "user", "Hi."), (None, None, "assistant", "No turn."), (902, None, None, None), (903, 1, "user", "z" * 300_000)]
    return rows


@pytest.mark.parametrize("bits", [3, 10])
def test_repaired_against_brute_force(spark, bits):
    rows = [(a, b, " " if c is None else c, " " if d is None else d) for a, b, c, d in talk()]
    df = spark.createDataFrame([(*r, 1, 2, "x", "y") for r in rows], SCHEMA)
    ids = spark.createDataFrame([(i,) for i in {r[0] for r in rows} | {77}], "conv_id long")
    got = {r["conv_id"]: tuple(r)[1:] for r in C.repaired(df, ids, block_bits=bits).collect()}
    want = reference(rows, list(got))
    assert got == want and got[77] == (0, 0, 0, 0, 0, 0, "", EMPTY)


def test_damage(spark):
    rows = talk()
    df = spark.createDataFrame([(*r, 1, 2, "x", "y") for r in rows], SCHEMA)
    want = []
    for c, t, role, text in rows:
        d = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        role, text = (" " if x is None else x for x in (role, text))
        if d == 0:
            continue
        text = "" if d == 1 else re.sub("[.!?]", "", text) if d == 2 else text
        want += [(c, t, "user" if d == 4 else role, text)] * (2 if d == 3 else 1)
    got = [tuple(r) for r in C.damaged(df).collect()]
    assert sorted(map(str, got)) == sorted(map(str, want))
    out = C.repair(df)
    assert {r["conv_id"] for r in out.collect()} == {r[0] for r in rows}
    assert C.repair(df.where("false")).count() == 0


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def framed(*values):
    return "".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values)


def reference_manifest(rows):
    """(doc_id, leaf) -> list of expected rows, by building the whole tree."""
    def levels(nodes):
        out = [nodes]
        while len(out[-1]) > 1:
            out.append([sha(*out[-1][i:i + 3]) for i in range(0, len(out[-1]), 3)])
        return out

    def way(tree, i):
        out = []
        for level in tree[:-1]:
            lo = i // 3 * 3
            out.append((level[lo:i], level[i + 1:lo + 3]))
            i //= 3
        return out

    trees, order = {}, sorted({r[3] for r in rows}, key=lambda s: (s is not None, (s or "").encode()))
    for s in order:
        mine = sorted((r for r in rows if r[3] == s),
                      key=lambda r: (r[0] is not None, r[0] or 0, sha(framed(r[0], r[3], r[2], r[4], r[1]))))
        trees[s] = (mine, levels([sha(framed(r[0], r[3], r[2], r[4], r[1])) for r in mine]))
    top = levels([trees[s][1][-1][0] for s in order])
    out = []
    for k, s in enumerate(order):
        mine, tree = trees[s]
        for i, r in enumerate(mine):
            path = way(tree, i) + way(top, k)
            text = r[1]
            if text is not None and r[0] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0:
                text = text.replace("\n", "")
            leaf = sha(framed(r[0], r[3], r[2], r[4], text))
            holds = M.proof_holds(leaf, path, top[-1][0])
            for left, right in path:
                leaf = sha(*left, leaf, *right)
            assert holds == (leaf == top[-1][0])
            out.append((r[0], tree[0][i], tree[-1][0], top[-1][0], sha(*(x for a, b in path for x in a + b)), leaf, holds))
    return out


DOCS = "doc_id long, text string, lang string, source string, n_chars long, pos int, tree int, hash string, idx int"


def manifest_rows():
    rows = [(i, f"text {i}\nline" if i % 3 else f"text {i}", "en", "hot", i) for i in range(200)]
    rows += [(i, "a\n\nb", None, f"s{i % 5}", None) for i in range(300, 330)]
    rows += [(None, "no id\n", "en", "hot", 1), (None, None, None, None, None), (7, "other text", "de", "hot", 2),
             (8, "text 8\nline", "en", "hot", 8), (400, "", "en", "é", 0), (401, "x\n" * 100_000, "fr", "", 5)]
    return rows


@pytest.mark.parametrize("cut", [None, 1, 2, 4])
def test_manifest_against_the_whole_tree(spark, cut):
    rows = manifest_rows() if cut is None else manifest_rows()[:cut]
    got = M.manifest(spark.createDataFrame([(*r, 1, 2, "x", 3) for r in rows], DOCS))
    assert got.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    assert sorted(map(str, (tuple(r) for r in got.collect()))) == sorted(map(str, reference_manifest(rows)))


def test_manifest_of_many_sources_and_of_none(spark):
    rows = [(i, f"{i}\n", "en", f"source {i:04d}", i) for i in range(100)]
    got = M.manifest(spark.createDataFrame([(*r, 1, 2, "x", 3) for r in rows], DOCS))
    assert sorted(map(str, (tuple(r) for r in got.collect()))) == sorted(map(str, reference_manifest(rows)))
    assert M.manifest(spark.createDataFrame([], DOCS)).count() == 0
    assert spark.conf.get(M.ROW_LIMIT) != "-1"
