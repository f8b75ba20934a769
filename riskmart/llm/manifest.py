"""Operator 12: Merkle manifest of a dataset, climbed by a recursive query.

Every row is a leaf; per source the leaves, in order of their id, are folded three by
three into one subroot, and the subroots likewise into the root. The tree is built
bottom-up and stored as parent-linked node rows: a row names its node, the ancestor
``STRIDE`` levels up and the siblings met on the way there, so a table of n leaves takes
about log27(n) rounds of groups of at most 27 nodes. A recursive query then ascends from
every leaf: each step joins the frontier with the node rows, appends the siblings of the
way and folds the (tampered) digest, until a node has no parent.

An upper node meets many leaves. Its side of the join is one row, so adaptive execution
splits such a key (or broadcasts the node rows where it measures them as small); nothing
is broadcast by a hint. Siblings travel as rows of one step each and are brought together
once at the end, so what a step shuffles does not grow with the height.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.sequence import dense_row_id
from .common import drop_stored, id_hash, setting, store

FAN = 3
STRIDE = 3
GROUP = FAN ** STRIDE
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
WAY = "array<struct<before: binary, after: binary>>"
ROW_LIMIT = "spark.sql.cteRecursionRowLimit"


def digest(col: Column) -> Column:
    return F.sha2(col, 256)


def framed(col: Column) -> Column:
    """``-`` for null, else byte count, colon, value."""
    text = col.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_of(fields: list[Column]) -> Column:
    return digest(F.concat(*[framed(c) for c in fields]))


def tampered_text(doc_id: Column, text: Column) -> Column:
    """Line feeds deleted where 2 divides the crc32 of the id."""
    return F.when(F.pmod(id_hash(doc_id), F.lit(2)) == 0, F.replace(text, F.lit("\n"), F.lit(""))).otherwise(text)


def _run_digests(level: Column) -> Column:
    """Digests of the runs of three consecutive nodes (hex texts)."""
    runs = F.sequence(F.lit(0), F.floor((F.size(level) - 1) / FAN).cast("int"))
    return F.transform(runs, lambda i: digest(F.array_join(F.slice(level, i * FAN + 1, F.lit(FAN)), "")))


def _way(levels: list[str], place: Column, height: Column) -> Column:
    """Siblings left and right of a node's ancestors on ``height`` levels."""
    steps = []
    for k, level in enumerate(levels):
        at = F.floor(place / FAN ** k).cast("int")
        within = at % FAN
        before = F.slice(level, at - within + 1, within)
        after = F.slice(level, at + 2, FAN - 1 - within)
        steps.append(F.when(height > k, F.struct(F.unhex(F.array_join(before, "")).alias("before"),
                                                 F.unhex(F.array_join(after, "")).alias("after"))))
    return F.filter(F.array(*steps), lambda x: x.isNotNull())


def build(nodes: DataFrame, top: bool) -> tuple[DataFrame, DataFrame]:
    """(node rows, roots) of the trees over ``nodes``: tree, idx (from 0), n (nodes of the
    tree), hash (binary).

    Node rows: tree, round, idx, hash, way, and the ancestor's p_tree, p_round, p_idx.
    A tree's last ancestor is its place in the top tree, or null in the top tree itself.
    """
    out, roots, rnd = [], [], 0
    height = F.lit(0)
    for k in range(STRIDE):
        height = height + (F.col("n") > FAN ** k).cast("int")
    end = (F.lit(None).cast("long"), F.lit(None).cast("int"), F.lit(None).cast("long")) if top else \
        (F.lit(0).cast("long"), F.lit(0), F.col("tree") - 1)
    while True:
        roots.append(nodes.where("n = 1").select("tree", F.col("hash").alias("root")))
        if rnd == 0:           # a lone leaf is the root of its tree
            out.append(nodes.where("n = 1").select("tree", F.lit(0).alias("round"), "idx", "hash",
                                                   F.expr(f"cast(array() as {WAY})").alias("way"),
                                                   end[0].alias("p_tree"), end[1].alias("p_round"), end[2].alias("p_idx")))
        left = nodes.where("n > 1")
        if left.isEmpty():
            break
        groups = (left.groupBy("tree", "n", F.floor(F.col("idx") / GROUP).alias("g"))
                  .agg(F.array_sort(F.collect_list(F.struct("idx", "hash"))).alias("kids"))
                  .withColumn("height", height)
                  .withColumn("l0", F.transform("kids", lambda x: F.lower(F.hex(x["hash"])))))
        levels = ["l0"]
        for k in range(1, STRIDE + 1):
            groups = groups.withColumn(f"l{k}", F.when(F.col("height") >= k, _run_digests(F.col(f"l{k - 1}"))))
            levels.append(f"l{k}")
        last = F.element_at(F.coalesce(*[F.col(x) for x in reversed(levels)]), 1)
        groups = store(groups.withColumn("last", F.unhex(last)).drop("l3"), "op12-groups")
        final = F.col("n") <= F.pow(F.lit(FAN), F.col("height"))
        rows = (groups.select("tree", "n", "g", "height", "l0", "l1", "l2", F.posexplode("kids").alias("p", "kid"))
                .select("tree", F.lit(rnd).alias("round"), F.col("kid.idx").alias("idx"), F.col("kid.hash").alias("hash"),
                        _way(["l0", "l1", "l2"], F.col("p"), F.col("height")).alias("way"),
                        F.when(final, end[0]).otherwise(F.col("tree")).alias("p_tree"),
                        F.when(final, end[1]).otherwise(F.lit(rnd + 1)).alias("p_round"),
                        F.when(final, end[2]).otherwise(F.col("g")).alias("p_idx")))
        out.append(store(rows, "op12-nodes"))
        nodes = store(groups.select("tree", F.col("g").alias("idx"), F.col("last").alias("hash"),
                                    F.ceil(F.col("n") / F.pow(F.lit(FAN), F.col("height"))).cast("long").alias("n")),
                      "op12-level")
        drop_stored(groups)
        rnd += 1
    both = out[0]
    for x in out[1:]:
        both = both.unionByName(x)
    found = roots[0]
    for x in roots[1:]:
        found = found.unionByName(x)
    return both, found


#: One step of the climb: the frontier meets its nodes, each way's siblings are appended
#: as a row and the digest is folded along it.
CLIMB = """
WITH RECURSIVE climb (pos, step, tree, round, idx, fold, beside) AS (
  SELECT pos, 0, p_tree, p_round, p_idx,
         aggregate(way, start, (a, w) -> sha2(concat(lower(hex(w.before)), a, lower(hex(w.after))), 256)),
         aggregate(way, X'', (a, w) -> concat(a, w.before, w.after))
  FROM {leaves}
  UNION ALL
  SELECT c.pos, c.step + 1, n.p_tree, n.p_round, n.p_idx,
         aggregate(n.way, c.fold, (a, w) -> sha2(concat(lower(hex(w.before)), a, lower(hex(w.after))), 256)),
         aggregate(n.way, X'', (a, w) -> concat(a, w.before, w.after))
  FROM climb c JOIN {nodes} n ON c.tree = n.tree AND c.round = n.round AND c.idx = n.idx
)
SELECT pos, step, fold, beside FROM climb
"""


def climb(leaves: DataFrame, nodes: DataFrame) -> DataFrame:
    """pos, folded (hex digest at the top), proof (concatenated sibling digests, hex) of
    every leaf: pos, start (hex digest to fold), way and ancestor of its node row."""
    steps = leaves.sparkSession.sql(CLIMB, leaves=leaves, nodes=nodes)
    return (steps.groupBy("pos").agg(F.max_by("fold", "step").alias("folded"),
                                     F.array_sort(F.collect_list(F.struct("step", "beside"))).alias("s"))
            .select("pos", "folded",
                    F.array_join(F.transform("s", lambda x: F.lower(F.hex(x["beside"]))), "").alias("proof")))


def manifest(docs: DataFrame) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified per row.

    Nulls of the five fields are framed as ``-``; null sources form one tree, which comes
    first, and null ids come first in their tree. Rows that repeat an id stand beside
    each other in order of their digests, equal rows give equal digests but each has its
    own proof. A single row is its own subroot and root with an empty proof. An empty
    table gives an empty result. Other columns are not read, so they may have any names.
    """
    spark = docs.sparkSession
    fields = {c: F.col(c) for c in FIELDS}
    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"),
                      F.col("lang").cast("string").alias("lang"), F.col("n_chars").cast("long").alias("n_chars"),
                      F.col("text").cast("string").alias("text"))
    changed = {**fields, "text": tampered_text(F.col("doc_id"), F.col("text"))}
    hashed = src.select("source", "doc_id", F.unhex(leaf_of(list(fields.values()))).alias("leaf"),
                        F.when(F.pmod(id_hash(F.col("doc_id")), F.lit(2)) == 0,
                               F.unhex(leaf_of(list(changed.values())))).alias("other"))
    order = store(dense_row_id(hashed, ["source", "doc_id", "leaf"], out="pos", start=0), "op12-order")
    trees = order.groupBy("source").agg(F.min("pos").alias("first"), F.count("*").alias("n"))
    trees = store(dense_row_id(trees, ["source"], out="tree"), "op12-trees")
    leaves = store(order.join(trees.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s")))
                   .select("pos", "doc_id", "tree", "n", (F.col("pos") - F.col("first")).alias("idx"), "leaf", "other"),
                   "op12-leaves")
    drop_stored(order)
    nodes, subroots = build(leaves.select("tree", "idx", "n", F.col("leaf").alias("hash")), top=False)
    subroots = store(subroots, "op12-subroots")
    count = F.lit(subroots.count()).cast("long")
    upper, roots = build(subroots.select(F.lit(0).cast("long").alias("tree"), (F.col("tree") - 1).alias("idx"),
                                         count.alias("n"), F.col("root").alias("hash")), top=True)
    node = ["tree", "round", "idx"]
    ways = nodes.where("round = 0").drop("hash", "round")
    # the two sides of this join hold every leaf once, so no key is hot
    start = (leaves.join(ways, ["tree", "idx"])
             .select("pos", F.lower(F.hex(F.coalesce("other", "leaf"))).alias("start"), "way", "p_tree", "p_round", "p_idx"))
    above = nodes.where("round > 0").drop("hash").unionByName(upper.drop("hash")) \
        .select(*node, "way", "p_tree", "p_round", "p_idx")
    root = roots.select(F.lower(F.hex("root")).alias("root"))
    with setting(spark, ROW_LIMIT, "-1"):
        above = store(above, "op12-above")
        climbed = store(climb(start, above), "op12-climbed")
        drop_stored(above)
    out = (leaves.join(climbed, "pos").join(subroots.withColumnRenamed("root", "sub"), "tree")
           .crossJoin(F.broadcast(root)))          # one row
    return out.select("doc_id", F.lower(F.hex("leaf")).alias("leaf"), F.lower(F.hex("sub")).alias("subroot"), "root",
                      digest(F.col("proof")).alias("proof_sha256"), F.col("folded").alias("folded_root"),
                      (F.col("folded") == F.col("root")).alias("verified"))


def proof_holds(leaf: str, way: list[tuple[list[str], list[str]]], root: str) -> bool:
    """Whether ``leaf`` folds to ``root`` over (left, right) siblings level by level."""
    for left, right in way:
        leaf = hashlib.sha256("".join([*left, leaf, *right]).encode()).hexdigest()
    return leaf == root


#: Lowest bit of crc32, bit by bit: a byte is taken in, then eight shifts.
CRC = """list_reduce(list_prepend(4294967295::UBIGINT, flatten(list_transform({bytes},
  lambda b: [b::UBIGINT] || [9999999999::UBIGINT, 9999999999, 9999999999, 9999999999, 9999999999, 9999999999, 9999999999, 9999999999]))),
  lambda c, x: CASE WHEN x < 256 THEN xor(c, x) WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384::UBIGINT) ELSE c >> 1 END)"""


def crc32_sql(text: str) -> str:
    """DuckDB expression of the unsigned crc32 of an ASCII text."""
    return f"xor({CRC.format(bytes=f'''list_transform(string_split({text}, ''), lambda c: ascii(c))''')}, 4294967295::UBIGINT)"


def _framed_sql(col: str) -> str:
    return f"coalesce(octet_length(encode({col}::VARCHAR))::VARCHAR || ':' || {col}::VARCHAR, '-')"


def oracle() -> str:
    head = " || ".join(_framed_sql(c) for c in FIELDS[:-1])
    changed = "replace(text, chr(10), '')"
    return f"""
WITH RECURSIVE base AS (
  SELECT doc_id, dense_rank() OVER (ORDER BY source NULLS FIRST) AS tree,
         sha256({head} || {_framed_sql('text')}) AS leaf,
         CASE WHEN {crc32_sql('doc_id::VARCHAR')} % 2 = 0 THEN sha256({head} || {_framed_sql(changed)}) END AS other
  FROM documents),
leaves AS (
  SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS idx,
         count(*) OVER (PARTITION BY tree) AS n FROM base),
up AS (
  SELECT tree, 0 AS lvl, idx, leaf AS h, n FROM leaves
  UNION ALL
  SELECT tree, lvl + 1, idx // 3, sha256(string_agg(h, '' ORDER BY idx)), (any_value(n) + 2) // 3
  FROM up WHERE n > 1 GROUP BY tree, lvl, idx // 3),
subroots AS (SELECT tree, lvl, h FROM up WHERE n = 1),
over AS (
  SELECT 0 AS lvl, tree - 1 AS idx, h, (SELECT count(*) FROM subroots) AS n FROM subroots
  UNION ALL
  SELECT lvl + 1, idx // 3, sha256(string_agg(h, '' ORDER BY idx)), (any_value(n) + 2) // 3
  FROM over WHERE n > 1 GROUP BY lvl, idx // 3),
nodes AS (SELECT tree, lvl, idx, h FROM up WHERE n > 1 UNION ALL SELECT 0, lvl, idx, h FROM over WHERE n > 1),
sib AS (
  SELECT tree, lvl, idx, coalesce(lag(h, 2) OVER w, '') || coalesce(lag(h, 1) OVER w, '') AS before,
         coalesce(lead(h, 1) OVER w, '') || coalesce(lead(h, 2) OVER w, '') AS after
  FROM nodes WINDOW w AS (PARTITION BY tree, lvl, idx // 3 ORDER BY idx)),
heights AS (SELECT tree, lvl AS height, h AS subroot FROM subroots),
climb AS (
  SELECT l.doc_id, l.leaf, l.tree AS home, CASE WHEN t.height = 0 THEN 0 ELSE l.tree END AS tree, 0 AS lvl,
         CASE WHEN t.height = 0 THEN l.tree - 1 ELSE l.idx END AS idx, l.tree AS at, coalesce(l.other, l.leaf) AS fold,
         '' AS proof, t.height, t.subroot, false AS done
  FROM leaves l JOIN heights t ON l.tree = t.tree
  UNION ALL
  SELECT c.doc_id, c.leaf, c.home, CASE WHEN c.tree > 0 AND c.lvl + 1 = c.height THEN 0 ELSE c.tree END,
         CASE WHEN c.tree > 0 AND c.lvl + 1 = c.height THEN 0 ELSE c.lvl + 1 END,
         CASE WHEN c.tree > 0 AND c.lvl + 1 = c.height THEN c.home - 1 ELSE c.idx // 3 END, c.at,
         CASE WHEN s.idx IS NULL THEN c.fold ELSE sha256(s.before || c.fold || s.after) END,
         CASE WHEN s.idx IS NULL THEN c.proof ELSE c.proof || s.before || s.after END, c.height, c.subroot, s.idx IS NULL
  FROM climb c LEFT JOIN sib s ON c.tree = s.tree AND c.lvl = s.lvl AND c.idx = s.idx
  WHERE NOT c.done),
top AS (SELECT h AS root FROM over WHERE n = 1)
SELECT doc_id, leaf, subroot, root, sha256(proof) AS proof_sha256, fold AS folded_root, fold = root AS verified
FROM climb, top WHERE done
"""
