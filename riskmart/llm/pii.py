"""Operator 9: personal data by candidate generation and gradient-boosted trees.

Exact patterns with their checks give the base spans of every kind; they always
stay. Wider generators propose further, overlapping spans. Boosted trees score
each candidate on its format and context; what only the exact rules look at (the
plus sign, the check digit, the at sign) is no feature, so candidates that look
like checked spans but miss the rule can be told from other numbers. Candidates that
agree with a base span are the positive rows, phone numbers also without their country
code; those that cannot be personal data by format, or have neither the sign of a
rewriting nor a cue word of their kind before them, are the negative rows; the rest is
unlabelled, and only that can be added. Trees are fitted on a bounded sample per kind
and label; a threshold per kind is set on all held-out labelled candidates so that at
least ``PRECISION`` of those above it are positive. Fitted trees become one SQL expression
that is evaluated where the candidates lie. DataFrame functions and Spark ML only.
"""

from __future__ import annotations

import re

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import drop_stored, store

KINDS = ("email", "ip", "card", "phone")

# The base patterns, written so that Java's matcher takes linear time and no
# recursion: possessive repeats, and no start inside a run that failed before.
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){12,18}(?![\x20-]?[0-9])",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
WIDE = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++(?:@|\x20?[\[(]at[\])]\x20?)[A-Za-z0-9-]++"
             r"(?:(?:\.|\x20?[\[(]dot[\])]\x20?)[A-Za-z0-9-]++)*+",
    "ip": r"(?<![0-9.,])[0-9]{1,4}(?:[.,][0-9]{1,4}){3}(?![0-9])",
    "card": r"(?<![0-9])(?<![0-9][\x20.-])[0-9](?:[\x20.-]?[0-9]){11,19}(?![\x20.-]?[0-9])",
    "phone": r"(?<![0-9])[+]?[(]?[0-9][\x20().0-9-]{5,18}[0-9](?![0-9])",
}
#: Without this character or class no span of the kind exists.
NEEDS = {"email": r"@|[\[(]at", "ip": "[0-9]", "card": "[0-9]", "phone": "[0-9]"}
CUES = {"email": r"(?i)(mail|contact|write|reach)", "ip": r"(?i)(\bip\b|host|server|addr)",
        "card": r"(?i)(card|visa|account|pay)", "phone": r"(?i)(\btel|phone|call|fax|mobile|contact)"}
AT, DOT = r"\x20?[\[(]at[\])]\x20?", r"\x20?[\[(]dot[\])]\x20?"

MAX_ROWS = 20_000     # about: an even share for every kind and label
PRECISION = 0.98
TREES, DEPTH = 12, 3
SPANS = "array<struct<s:int,e:int,t:string>>"


def spans(text: Column, pattern: str, needs: str) -> Column:
    """(s, e, t) of every match, in code points, by adding up the lengths of the
    matches and of the text between them."""
    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.split(text, pattern, -1)
    start = F.struct(F.lit(0).alias("pos"), F.array().cast(SPANS).alias("out"))

    def add(acc: Column, x: Column) -> Column:
        s = acc["pos"] + F.length(x["gap"])
        e = s + F.length(x["hit"])
        return F.struct(e.alias("pos"), F.concat(acc["out"], F.array(
            F.struct(s.alias("s"), e.alias("e"), x["hit"].alias("t")))).alias("out"))

    pairs = F.zip_with(F.slice(gaps, F.lit(1), F.size(hits)), hits,
                       lambda g, h: F.struct(g.alias("gap"), h.alias("hit")))
    found = F.when(F.size(hits) > 0, F.aggregate(pairs, start, add, lambda acc: acc["out"]))
    return F.coalesce(F.when(text.rlike(needs), found), F.array().cast(SPANS))


def digits(t: Column) -> Column:
    return F.regexp_replace(t, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """Check digit over a text of digits."""
    n = F.length(number)

    def worth(i: Column) -> Column:
        d = F.substring(number, n - i, F.lit(1)).cast("int")
        twice = d * 2
        return F.when(i % 2 == 0, d).otherwise(F.when(twice > 9, twice - 9).otherwise(twice))

    total = F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0), lambda a, i: a + worth(i))
    return total % 10 == 0


def passes(kind: str, t: Column) -> Column:
    if kind == "ip":
        return F.forall(F.split(t, r"\."), lambda p: p.rlike(r"^0*+(?:25[0-5]|2[0-4][0-9]|1?[0-9]{0,2})$"))
    if kind == "card":
        return luhn(digits(t))
    if kind == "phone":
        return F.length(digits(t)).between(9, 15)
    return F.lit(True)


def _char_class(c: Column) -> Column:
    return (F.when((c == "") | c.rlike(r"\s"), 0.0).when(c.rlike(r"[A-Za-z\x{80}-\x{10FFFF}]"), 1.0)
            .when(c.rlike("[0-9]"), 2.0).when(c.rlike("[\"'`=]"), 3.0).otherwise(4.0))


def cue(text: Column, kind: str, x: Column) -> Column:
    """Is there a word that goes with the kind in the 16 characters before?"""
    return F.substring(text, F.greatest(x["s"] - 15, F.lit(1)), F.least(x["s"], F.lit(16))).rlike(CUES[kind])


def may_be(text: Column, kind: str, x: Column) -> Column:
    """Can a candidate that is no base span be personal data all the same?"""
    t, n = x["t"], F.length(digits(x["t"]))
    if kind == "email":         # name [at] host [dot] org
        return t.rlike(r"[\[(](?:at|dot)[\])]")
    if kind == "ip":            # other separators, and called an address
        return t.contains(",") & passes(kind, F.regexp_replace(t, ",", ".")) & cue(text, kind, x)
    if kind == "card":          # other separators, check digit right
        return n.between(13, 19) & t.contains(".") & luhn(digits(t))
    return ~t.startswith("+") & n.between(7, 15) & cue(text, kind, x)


def features(text: Column, kind: int, x: Column) -> Column:
    """Format and context of one candidate."""
    t = F.regexp_replace(F.regexp_replace(x["t"], AT, "@"), DOT, ".")
    runs = F.regexp_extract_all(t, F.lit("[0-9]+"), F.lit(0))
    n, letters = F.length(digits(t)), F.length(F.regexp_replace(t, "[^A-Za-z]", ""))
    prev = F.when(x["s"] > 0, F.substring(text, x["s"], F.lit(1))).otherwise("")
    nxt = F.substring(text, x["e"] + 1, F.lit(1))
    # signs that the exact rules demand are left out of the counts
    marks = F.length(F.regexp_replace(t, r"[A-Za-z0-9+@]", ""))
    values = [F.lit(float(kind)), n, letters, marks, F.size(runs),
              F.coalesce(F.array_max(F.transform(runs, F.length)), F.lit(0)),
              _char_class(prev), _char_class(nxt), cue(text, KINDS[kind], x).cast("int"),
              t.rlike(r"[(][0-9]").cast("int")]
    return F.array(*[v.cast("double") for v in values])


def candidates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, base (k, s, e), cand (k, s, e, f, y): one row per document, from one
    scan of the texts. ``y`` is 1 for base spans, 0 for what cannot be personal data
    and null for the rest."""
    text = F.coalesce(F.col("text"), F.lit(""))
    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    base, cand = [], []

    def checked(kind: str) -> Column:
        return F.filter(spans(text, BASE[kind], NEEDS[kind]), lambda x: passes(kind, x["t"]))

    def as_base(k: int, found: Column) -> Column:
        return F.transform(found, lambda x: F.struct(F.lit(k).alias("k"), x["s"].alias("s"), x["e"].alias("e"),
                                                     x["t"].alias("t")))

    def candidate(k: int, x: Column, y: Column) -> Column:
        return F.struct(F.lit(k).alias("k"), x["s"].alias("s"), x["e"].alias("e"),
                        features(text, k, x).alias("f"), y.cast("double").alias("y"))

    def as_candidate(k: int, wide: Column, known: Column) -> Column:
        def label(x: Column) -> Column:
            same = F.exists(known, lambda b: (b["s"] == x["s"]) & (b["e"] == x["e"]))
            part = F.exists(known, lambda b: (b["s"] < x["e"]) & (x["s"] < b["e"]))
            return F.when(same, 1.0).when(~part & ~may_be(text, KINDS[k], x), 0.0)

        return F.transform(wide, lambda x: candidate(k, x, label(x)))

    def without_code(k: int, known: Column) -> Column:
        short = F.transform(known, lambda b: F.struct(
            b["s"].alias("s"), b["e"].alias("e"),
            F.regexp_replace(b["t"], r"^\+[0-9]{1,3}[\x20.-]+", "").alias("t")))
        return F.transform(F.filter(short, lambda x: ~x["t"].startswith("+") & (F.length(digits(x["t"])) >= 7)),
                           lambda x: candidate(k, x, F.lit(1.0)))

    for k, kind in enumerate(KINDS):
        src = src.withColumn(f"b{k}", as_base(k, checked(kind))).withColumn(
            f"w{k}", spans(text, WIDE[kind], NEEDS[kind]))
        base.append(F.col(f"b{k}"))
    for k in range(len(KINDS)):
        cand.append(as_candidate(k, F.col(f"w{k}"), F.col(f"b{k}")))
    cand.append(without_code(KINDS.index("phone"), F.col(f"b{KINDS.index('phone')}")))
    plain = F.transform(F.concat(*base), lambda b: F.struct(b["k"].alias("k"), b["s"].alias("s"), b["e"].alias("e")))
    return src.select("doc_id", plain.alias("base"), F.concat(*cand).alias("cand"))


def _tree(lines: list[str], at: int, f: Column) -> tuple[Column, int]:
    """Column of a printed tree: 'If (feature i <= v)' ... 'Else' ... 'Predict: p'."""
    line = lines[at].strip()
    if line.startswith("Predict:"):
        return F.lit(float(line.split(":")[1])), at + 1
    m = re.match(r"If \(feature (\d+) <= (\S+)\)", line)
    yes, at = _tree(lines, at + 1, f)
    no, at = _tree(lines, at + 1, f)
    return F.when(F.get(f, F.lit(int(m[1]))) <= float(m[2]), yes).otherwise(no), at


def probability(model, f: Column) -> Column:
    """The fitted ensemble as a column expression over the feature array."""
    margin = F.lit(0.0)
    for tree, weight in zip(model.trees, model.treeWeights):
        lines = [x for x in tree.toDebugString.split("\n")[1:] if x.strip()]
        margin = margin + _tree(lines, 0, f)[0] * float(weight)
    return 1.0 / (1.0 + F.exp(-2.0 * margin))


def fit(found: DataFrame):
    """(score expression as a function of the feature array, thresholds by kind)."""
    rows = (found.where("size(cand) > 0").select("doc_id", F.explode("cand").alias("c")).where("c.y IS NOT NULL")
            .select(F.xxhash64("doc_id", "c.s", "c.e", "c.k").alias("o"), "c.k", "c.f", "c.y"))
    part = F.pmod("o", F.lit(3))
    # at most 2 x kinds groups; of each, the rows with the smallest share of the hash range
    sizes = rows.where(part < 2).groupBy("k", "y").count().collect()
    if {r["y"] for r in sizes} != {0.0, 1.0}:
        return None, {}
    wanted, place = F.lit(False), F.pmod(F.xxhash64("o"), F.lit(1 << 31))
    for r in sizes:
        share = int((1 << 31) * min(1.0, MAX_ROWS / (2 * len(KINDS)) / r["count"]))
        wanted = wanted | ((F.col("k") == r["k"]) & (F.col("y") == r["y"]) & (place < share))
    sample = store(rows.where((part < 2) & wanted).orderBy("o", "k", "y", "f"), "op9-sample")
    if sample.select("y").distinct().count() < 2:
        return None, {}
    train = sample.coalesce(1).sortWithinPartitions("o", "k", "y", "f") \
        .select(array_to_vector("f").alias("features"), F.col("y").alias("label"))
    model = GBTClassifier(maxIter=TREES, maxDepth=DEPTH, stepSize=0.3, seed=7).fit(train)
    held = rows.where(part == 2).select(
        "k", "y", F.floor(probability(model, F.col("f")) * 100).cast("int").alias("bin"))
    counts = held.groupBy("k", "bin").agg(F.count("*").alias("n"), F.sum("y").alias("good")).collect()
    limits = {}
    for k in range(len(KINDS)):
        n = good = 0
        for r in sorted((r for r in counts if r["k"] == k), key=lambda r: -r["bin"]):
            n, good = n + r["n"], good + r["good"]
            if good < PRECISION * n:
                break
            if good:
                limits[k] = r["bin"] / 100.0
    drop_stored(sample)
    return (lambda f: probability(model, f)), limits


def find_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, base (k, s, e), added (k, s, e, score): spans per document, kinds
    numbered as in ``KINDS``, ends exclusive, in code points. A null or empty text has
    none. An added span never overlaps a base span; of overlapping added spans the
    better one stays. Rows without an id and repeated rows are judged alike. Other
    columns are not read.
    """
    found = store(candidates(docs, id_col, text_col), "op9-candidates")
    score, limits = fit(found)
    empty = F.array().cast("array<struct<k:int,s:int,e:int,score:double>>")
    if not limits:
        return found.select("doc_id", "base", empty.alias("added"))

    def over(a: Column, b: Column) -> Column:
        return (a["s"] < b["e"]) & (b["s"] < a["e"])

    scored = F.transform(
        F.filter("cand", lambda c: c["y"].isNull() & ~F.exists("base", lambda b: over(c, b))),
        lambda c: F.struct(c["k"].alias("k"), c["s"].alias("s"), c["e"].alias("e"), score(c["f"]).alias("score")))

    def above(c: Column) -> Column:
        out = F.lit(False)
        for k, v in limits.items():
            out = out | ((c["k"] == k) & (c["score"] >= v))
        return out

    def better(a: Column, b: Column) -> Column:
        return (a["score"] > b["score"]) | ((a["score"] == b["score"]) & (
            (a["k"] < b["k"]) | ((a["k"] == b["k"]) & (a["s"] < b["s"]))))

    out = found.withColumn("hot", F.when(F.size("cand") > 0, F.filter(scored, above)).otherwise(empty))
    added = F.filter("hot", lambda c: ~F.exists("hot", lambda o: over(c, o) & better(o, c)))
    return out.select("doc_id", "base", added.alias("added"))


def _text(items: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(items, lambda x: F.concat_ws(
        ":", F.get(names, x["k"]), x["s"].cast("string"), x["e"].cast("string"))), ",")


def report(found: DataFrame) -> DataFrame:
    """doc_id, counts of base spans, their digest, and all spans as text."""
    plain = F.transform("added", lambda x: F.struct(x["k"].alias("k"), x["s"].alias("s"), x["e"].alias("e")))
    every = F.array_sort(F.concat("base", plain))

    def count(k: int) -> Column:
        return F.size(F.filter("base", lambda b: b["k"] == k)).cast("long")

    counts = [count(k).alias(f"n_{kind}") for k, kind in enumerate(KINDS)]
    return found.select("doc_id", *counts, F.sha2(_text(F.array_sort("base")), 256).alias("base_sha256"),
                        _text(every).alias("spans"))


def redact(docs: DataFrame, found: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` (ids unique) with every span replaced by its kind in brackets."""
    names = F.array(*[F.lit(f"[{k}]") for k in KINDS])
    merged = F.array_sort(F.concat(
        F.transform("base", lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"), x["k"].alias("k"))),
        F.transform("added", lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"), x["k"].alias("k")))))
    marks = found.select(F.col("doc_id").alias("__id"), merged.alias("__spans")).where("size(__spans) > 0")
    start = F.struct(F.lit(0).alias("pos"), F.lit("").alias("out"))

    def add(acc: Column, x: Column) -> Column:
        gap = F.substring(F.col(text_col), acc["pos"] + 1, F.greatest(x["s"] - acc["pos"], F.lit(0)))
        tag = F.when(x["s"] >= acc["pos"], F.get(names, x["k"])).otherwise("")
        return F.struct(F.greatest(acc["pos"], x["e"]).alias("pos"), F.concat(acc["out"], gap, tag).alias("out"))

    clean = F.aggregate("__spans", start, add, lambda acc: F.concat(acc["out"], F.substring(
        F.col(text_col), acc["pos"] + 1, F.length(text_col))))
    text = F.when(F.col("__spans").isNull(), F.col(text_col)).otherwise(clean)
    columns = [text.alias(c) if c == text_col else F.col(c) for c in docs.columns]
    return docs.join(marks, F.col(id_col) == F.col("__id"), "left").select(*columns)
