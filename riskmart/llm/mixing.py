"""Operator 4: mix sources to target weights by Pareto order sampling.

Sources in code-point order weigh 5, 2, 1, repeating. Their targets share all
words by weight; a target stops at ``most`` times its source's words and the rest
is shared again until none is above. A target of f times the source's words gives
every document floor(f) whole copies; the words still missing come from a sample
without replacement. A document's inclusion probability lambda is min(1, c * size),
with c per source such that the expected words, the sum of lambda * size, are those
missing. Documents with lambda 1 are certain and come first; the others are ranked by
random odds divided by inclusion odds, (u / (1 - u)) / (lambda / (1 - lambda)), and
taken in that order up to the fixed number of words.

The order is never sorted as a whole: ranks are cut into fine bins, bin totals
locate the bin in which a source's words run out, and only that bin is refined
until single documents are compared. Since one document may not fit, the words
then missing are filled from the documents not taken yet that do fit, by the same
rule, a few times. Everything is DataFrame functions; all sums are whole numbers,
so reruns and any partitioning agree.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.sequence import dense_row_id
from .common import drop_stored, store

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)
MOST = 3
BINS = 1 << 10
FILLS = 3
REPEATS = 1 << 14


def size_of(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def random_odds(doc_id: Column, seed: int) -> Column:
    """u / (1 - u) with u in (0, 1) from the md5 of seed and id (52 bits)."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("null"))))
    u = (F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") + 0.5) / float(1 << 52)
    return u / (1.0 - u)


def targets(sizes: DataFrame) -> DataFrame:
    """source, source_size, weight, target of every source of (source, size).

    The shared rate per weight is found by rounds: sources above their limit are
    set to it and the others share the rest, until no further one is above. Only
    two sums a round reach the driver."""
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    ranked = dense_row_id(store(per.withColumn("last", F.col("source").isNull()), "op4-sources"),
                          ["last", "source"], "pos", start=0)
    turn = F.pmod(F.col("pos"), F.lit(len(WEIGHTS)))
    weight = F.element_at(F.array(*[F.lit(w) for w in WEIGHTS]), (turn + 1).cast("int"))
    src = store(ranked.select("source", "source_size", weight.cast("long").alias("weight")), "op4-weights")
    limit = F.lit(MOST) * F.col("source_size")
    total = src.agg(F.sum("source_size")).first()[0] or 0
    rate, above = 0.0, -1
    while True:
        full = F.col("weight") * F.lit(rate) > limit if above >= 0 else F.lit(False)
        n, fixed, share = src.agg(
            F.coalesce(F.sum(full.cast("long")), F.lit(0)),
            F.coalesce(F.sum(F.when(full, limit)), F.lit(0)),
            F.coalesce(F.sum(F.when(~full, F.col("weight"))), F.lit(0))).first()
        if n == above or not share:
            break
        above, rate = n, (total - fixed) / share
    target = F.least(F.col("weight") * F.lit(rate), limit.cast("double"))
    return src.select("source", "source_size", "weight", target.alias("target"))


def inclusion(sizes: DataFrame, goal: DataFrame) -> DataFrame:
    """s, rest, squares of every source: a document is certain if rest * size >= squares,
    else lambda = size * rest / squares.

    ``rest`` are the words still needed after the certain documents and ``squares`` the
    sum of the squared sizes of the others. Certain documents are found by rounds over
    the counts per (source, size): taking them out lowers ``rest`` and ``squares`` and can
    make smaller ones certain, until no further one is. One number a round reaches the driver."""
    whole, wide = "decimal(20,0)", "decimal(38,0)"
    hist = store(sizes.where("size > 0").groupBy("source", F.col("size").cast("decimal(12,0)").alias("size"))
                 .agg(F.count("*").cast("decimal(15,0)").alias("n")), "op4-histogram")
    state = goal.select("s", F.col("need").cast(whole).alias("rest"), F.lit(None).cast(wide).alias("squares"))
    before = -1
    while True:
        certain = F.coalesce(F.col("rest") * F.col("size") >= F.col("squares"), F.lit(False))
        at = hist.join(state, F.col("source").eqNullSafe(F.col("s"))).withColumn("certain", certain)
        words = (F.col("n") * F.col("size")).cast(whole)
        sums = at.groupBy(F.col("source").alias("hs")).agg(
            F.sum(F.when(F.col("certain"), words).otherwise(0)).cast(whole).alias("fixed"),
            F.sum(F.when(~F.col("certain"), words.cast("decimal(26,0)") * F.col("size")).otherwise(0))
            .cast(wide).alias("squares"),
            F.sum(F.when(F.col("certain"), F.col("n")).otherwise(0)).cast("long").alias("many"))
        state = store(goal.join(sums, F.col("s").eqNullSafe(F.col("hs")))
                      .select("s", (F.col("need") - F.col("fixed")).cast(whole).alias("rest"), "squares", "many"),
                      "op4-inclusion")
        many = state.agg(F.sum("many")).first()[0]
        if many == before or many is None:
            drop_stored(hist)
            return state.select("s", "rest", "squares")
        before = many


def _prefix(rows: DataFrame, need: DataFrame, picked: str) -> DataFrame:
    """Rows of every source that come first by (q, doc_id) and whose sizes add up
    to at most ``need``; returns rows with a boolean column ``picked``.

    Bins of the rank are totalled per source (BINS rows each at most); bins before
    the cut are in, the bin of the cut is sorted on its own."""
    bins = rows.groupBy("source", "bin").agg(F.sum("size").alias("words"))
    w = Window.partitionBy("source").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    bins = bins.withColumn("before", F.coalesce(F.sum("words").over(w), F.lit(0)))
    bins = bins.join(need, F.col("source").eqNullSafe(F.col("s"))).drop("s")
    bins = bins.select(F.col("source").alias("bs"), F.col("bin").alias("bb"), "before", "need",
                       (F.col("before") + F.col("words") <= F.col("need")).alias("all_in"),
                       ((F.col("before") <= F.col("need"))
                        & (F.col("before") + F.col("words") > F.col("need"))).alias("cut"))
    bins = store(bins.where("all_in OR cut"), "op4-bins")
    at = rows.join(bins, F.col("source").eqNullSafe(F.col("bs")) & (F.col("bin") == F.col("bb")), "left")
    at = at.withColumn("all_in", F.coalesce("all_in", F.lit(False))).withColumn("cut", F.coalesce("cut", F.lit(False)))
    inside = Window.partitionBy("source", "sub").orderBy("q", "doc_id", "size") \
        .rowsBetween(Window.unboundedPreceding, 0)
    first = Window.partitionBy("source").orderBy("sub").rowsBetween(Window.unboundedPreceding, -1)
    edge = at.where("cut").withColumn("sub", F.floor((F.col("pos") * BINS - F.floor(F.col("pos") * BINS)) * BINS))
    subs = edge.groupBy(F.col("source").alias("ss"), F.col("sub").alias("sb")).agg(F.sum("size").alias("sw"))
    subs = subs.withColumnRenamed("ss", "source").withColumnRenamed("sb", "sub")
    subs = subs.withColumn("ahead", F.coalesce(F.sum("sw").over(first), F.lit(0))) \
        .select(F.col("source").alias("ss"), F.col("sub").alias("sb"), "ahead")
    edge = (edge.join(subs, F.col("source").eqNullSafe(F.col("ss")) & (F.col("sub") == F.col("sb")))
            .withColumn("run", F.sum("size").over(inside) + F.col("ahead") + F.col("before"))
            .withColumn(picked, F.col("run") <= F.col("need")))
    names = [c for c in rows.columns] + [picked]
    return at.where("NOT cut").withColumn(picked, F.col("all_in")).select(*names) \
        .union(edge.select(*names))


def mix_sources(docs: DataFrame, seed: int = 42, id_col: str = "doc_id", text_col: str = "text",
                source_col: str = "source") -> DataFrame:
    """doc_id, size, source_size, target, copies, taken: one row per document.

    ``size`` counts the words of the whole text (null or blank: 0), ``taken`` is
    copies times size with copies from 0 to 3. A null source is a source of its own,
    the last. Documents of size 0 take nothing. Repeated rows tie in every rank; any
    of them may be taken, with the same multiset of results. A null id has one fixed
    rank. Other columns are not read. An empty table gives an empty result.
    """
    base = store(docs.select(F.col(id_col).cast("long").alias("doc_id"),
                             F.col(source_col).cast("string").alias("source"),
                             size_of(F.col(text_col).cast("string")).alias("size")), "op4-sizes")
    goal = targets(base)
    goal = store(goal.withColumn("whole", F.least(F.floor(F.try_divide("target", "source_size")), F.lit(MOST)))
                 .withColumn("whole", F.coalesce("whole", F.lit(0)).cast("int"))
                 .withColumn("need", F.round(F.col("target") - F.col("whole") * F.col("source_size")).cast("long"))
                 .withColumnRenamed("source", "s"), "op4-goal")
    share = inclusion(base, goal).select(F.col("s").alias("ls"), "rest", "squares")
    # inclusion odds lambda / (1 - lambda) from whole numbers; certain documents come first
    part = F.col("rest") * F.col("size").cast("decimal(12,0)")
    odds = F.try_divide(part.cast("double"), (F.col("squares") - part).cast("double"))
    q = F.when(part >= F.col("squares"), 0.0).otherwise(F.try_divide(random_odds(F.col("doc_id"), seed), odds))
    rows = (base.join(goal, F.col("source").eqNullSafe(F.col("s")))
            .join(share, F.col("source").eqNullSafe(F.col("ls")), "left")
            .withColumn("q", F.when(F.col("size") > 0, q))
            .withColumn("pos", F.coalesce(F.col("q") / (F.lit(1.0) + F.col("q")), F.lit(0.0)))
            .withColumn("bin", F.floor(F.col("pos") * BINS))
            .select("doc_id", "source", "size", "source_size", "target", "whole", "q", "pos", "bin"))
    rows = store(rows, "op4-ranked")
    need = goal.select("s", "need")
    open_rows = rows.where("size > 0 AND q IS NOT NULL")
    taken = []
    for _ in range(1 + FILLS):
        fits = (open_rows.join(need.withColumnRenamed("need", "room").withColumnRenamed("s", "rs"),
                               F.col("source").eqNullSafe(F.col("rs")))
                .where("size <= room").drop("room", "rs"))
        out = store(_prefix(fits, need, "in"), "op4-picked")
        got = out.where("in")
        taken.append(got.select("doc_id", "source", "size"))
        used = got.groupBy(F.col("source").alias("us")).agg(F.sum("size").alias("used"))
        need = store(need.join(used, F.col("s").eqNullSafe(F.col("us")), "left")
                     .select("s", (F.col("need") - F.coalesce("used", F.lit(0))).alias("need")), "op4-need")
        open_rows = out.where("NOT in").drop("in")
    extra = taken[0]
    for t in taken[1:]:
        extra = extra.union(t)
    # one row per (doc_id, source, size): how many of its repeats were taken
    extra = extra.groupBy("doc_id", "source", "size").agg(F.count("*").alias("more"))
    again = rows.groupBy("doc_id", "source", "size").agg(F.count("*").alias("n"),
                                                         *[F.first(c).alias(c) for c in ("source_size", "target", "whole")])
    joined = again.alias("a").join(
        extra.alias("x"), F.col("a.doc_id").eqNullSafe(F.col("x.doc_id"))
        & F.col("a.source").eqNullSafe(F.col("x.source")) & (F.col("a.size") == F.col("x.size")), "left")
    drop_stored(base)
    return (joined.select("a.*", F.coalesce("x.more", F.lit(0)).alias("more"))
            # repeats one by one, in runs of REPEATS, so that none is one long array
            .withColumn("run", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / REPEATS))))
            .withColumn("k", F.explode(F.sequence(F.col("run") * REPEATS + 1,
                                                  F.least("n", (F.col("run") + 1) * REPEATS))))
            .withColumn("copies", F.col("whole") + (F.col("k") <= F.col("more")).cast("int"))
            .select("doc_id", "size", "source_size", "target", "copies",
                    (F.col("copies") * F.col("size")).cast("long").alias("taken"), "source"))


def oracle(documents: str = "documents", seed: int = 42) -> str:
    """DuckDB SQL for doc_id, size, source_size, target, copies, taken (rows whose
    id is unique)."""
    steps = []
    for i in range(1 + FILLS):
        pool = "ranked" if i == 0 else f"got{i - 1}"
        keep = "" if i == 0 else " AND NOT r.picked"
        steps.append(f"""
room{i} AS (SELECT s.source, s.need - coalesce({' + '.join(f"(SELECT coalesce(sum(g.size), 0) FROM got{j} g WHERE g.picked AND g.source IS NOT DISTINCT FROM s.source)" for j in range(i)) or '0'}, 0) AS room FROM goal s),
got{i} AS (SELECT r.doc_id, r.source, r.size, r.q,
    sum(r.size) OVER (PARTITION BY r.source ORDER BY r.q, r.doc_id ROWS UNBOUNDED PRECEDING) <= m.room AS picked
  FROM {pool} r JOIN room{i} m ON m.source IS NOT DISTINCT FROM r.source
  WHERE r.size > 0 AND r.size <= m.room{keep})""")
    picked = " UNION ALL ".join(f"SELECT doc_id FROM got{i} WHERE picked" for i in range(1 + FILLS))
    return f"""
WITH base AS (SELECT doc_id, source,
    CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size FROM {documents}),
per AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM base GROUP BY source),
src AS (SELECT *, CASE (row_number() OVER (ORDER BY encode(source) NULLS LAST) - 1) % 3
    WHEN 0 THEN {WEIGHTS[0]} WHEN 1 THEN {WEIGHTS[1]} ELSE {WEIGHTS[2]} END AS weight FROM per),
total AS (SELECT CAST(sum(source_size) AS BIGINT) AS t, CAST(sum(weight) AS BIGINT) AS w FROM src),
run AS (SELECT CAST(sum({MOST} * source_size) OVER o AS BIGINT) AS fixed, CAST(sum(weight) OVER o AS BIGINT) AS used
  FROM src WINDOW o AS (ORDER BY {MOST} * source_size / weight, encode(source) NULLS LAST ROWS UNBOUNDED PRECEDING)),
cand AS (SELECT 0 AS fixed, 0 AS used UNION ALL SELECT fixed, used FROM run),
rates AS (SELECT used, CAST(t - fixed AS DOUBLE) / (w - used) AS rate FROM cand, total WHERE w > used),
best AS (SELECT min_by(rate, used) AS rate FROM rates r WHERE NOT EXISTS (
    SELECT 1 FROM (SELECT *, sum(weight) OVER (ORDER BY {MOST} * source_size / weight, encode(source) NULLS LAST
                                               ROWS UNBOUNDED PRECEDING) AS upto FROM src) s
    WHERE s.upto > r.used AND s.weight * r.rate > {MOST} * s.source_size)),
tgt AS (SELECT src.*, CASE WHEN rate IS NULL THEN CAST({MOST} * source_size AS DOUBLE)
    ELSE least(weight * rate, CAST({MOST} * source_size AS DOUBLE)) END AS target FROM src, best),
goal0 AS (SELECT *, CASE WHEN source_size = 0 THEN 0 ELSE CAST(least(floor(target / source_size), {MOST}) AS INT) END AS whole FROM tgt),
goal AS (SELECT *, CAST(round(target - whole * source_size) AS BIGINT) AS need FROM goal0),
hist AS (SELECT b.source, b.size, CAST(count(*) AS HUGEINT) AS n, any_value(g.need) AS need
  FROM base b JOIN goal g ON g.source IS NOT DISTINCT FROM b.source WHERE b.size > 0 GROUP BY b.source, b.size),
upto AS (SELECT source, size, need,
    need - coalesce(sum(n * size) OVER (PARTITION BY source ORDER BY size DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest,
    sum(n * size * size) OVER (PARTITION BY source ORDER BY size ROWS UNBOUNDED PRECEDING) AS squares FROM hist),
sure AS (SELECT source, min(size) AS least FROM upto WHERE rest * size >= squares GROUP BY source),
share AS (SELECT h.source, any_value(h.need) - coalesce(sum(h.n * h.size) FILTER (h.size >= s.least), 0) AS rest,
    coalesce(sum(h.n * h.size * h.size) FILTER (s.least IS NULL OR h.size < s.least), 0) AS squares
  FROM hist h LEFT JOIN sure s ON s.source IS NOT DISTINCT FROM h.source GROUP BY h.source),
odd AS (SELECT b.doc_id, b.source, b.size, g.source_size, g.target, g.whole,
    (CAST(CAST('0x' || substr(md5('{seed}:' || coalesce(CAST(doc_id AS VARCHAR), 'null')), 1, 13) AS BIGINT) AS DOUBLE) + 0.5)
      / {float(1 << 52)} AS u, l.rest * b.size AS part, l.squares
  FROM base b JOIN goal g ON g.source IS NOT DISTINCT FROM b.source LEFT JOIN share l ON l.source IS NOT DISTINCT FROM b.source),
ranked AS (SELECT doc_id, source, size, source_size, target, whole, CASE WHEN size = 0 THEN NULL WHEN part >= squares THEN 0.0::DOUBLE
    ELSE (u / (1.0::DOUBLE - u)) / nullif(CAST(part AS DOUBLE) / CAST(squares - part AS DOUBLE), 0) END AS q FROM odd),
{','.join(steps)},
picked AS (SELECT DISTINCT doc_id FROM ({picked}))
SELECT r.doc_id, r.size, r.source_size, r.target, r.whole + (p.doc_id IS NOT NULL)::INT AS copies,
  CAST((r.whole + (p.doc_id IS NOT NULL)::INT) * r.size AS BIGINT) AS taken, r.source
FROM ranked r LEFT JOIN picked p ON p.doc_id = r.doc_id"""
