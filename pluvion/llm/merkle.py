"""A Merkle manifest of a table: leaves by group and key, subroots, one root, and a proof for every row.

Nodes are labelled by the interval [lo, hi] of the leaf ranks that they cover. Going up, runs of eight neighbours become
one node whose interval encloses theirs. Going down, the runs of a level meet the nodes above them by the bucket that both
intervals fall in at that level, where one interval contains the other, and take over their paths; the siblings of a node
are what is left of its parent's interval without its own. Only runs of at most `fanout` nodes are ever gathered, and paths
travel with whole runs, so that leaves never carry them through a shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.components import stored
from .common import ranked, table

#: Up to so many groups, their table of ranks is broadcast to the leaves.
FEW_GROUPS = 10_000

STEPS = "array<struct<left:string,right:string>>"


def field(value: Column) -> Column:
    """A value as a leaf takes it: its UTF-8 byte count, a colon and the value, or `-` if it is null."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_digest(*values: Column) -> Column:
    return F.sha2(F.concat(*[field(v) for v in values]), 256)


def ascii_lower(text: Column) -> Column:
    """text with A-Z, and nothing else, in lower case."""
    upper = "".join(map(chr, range(65, 91)))
    return F.translate(text, upper, upper.lower())


def runs_upward(leaves: DataFrame, most: int, fanout: int) -> tuple[list[DataFrame], DataFrame]:
    """(runs of each level, tops) of the trees of leaves(tree, n, lo, hi, digest, ...), where n counts a tree's leaves.

    A run is (tree, n, lo, hi, kids): the children of one node and the interval that it covers. tops(tree, lo, hi, digest,
    level) has the last node of each tree. most: the leaves of the largest tree.
    """
    levels, nodes, width, tops = [], leaves, 1, None
    payload = [c for c in leaves.columns if c not in ("tree", "n", "lo", "hi", "digest")]
    while True:
        top = nodes.where(F.col("n") <= width).select("tree", "lo", "hi", "digest", F.lit(len(levels)).alias("level"))
        tops = top if tops is None else tops.unionByName(top)
        if width >= most:
            return levels, tops
        bucket = F.floor(F.col("lo") / (width * fanout))
        kid = F.struct("lo", "hi", "digest", *(payload if width == 1 else []))
        runs = nodes.where(F.col("n") > width).groupBy("tree", "n", bucket.alias("bucket")).agg(F.array_sort(F.collect_list(kid)).alias("kids"))
        runs = stored(
            runs.select("tree", "n", F.col("kids")[0]["lo"].alias("lo"), F.element_at("kids", -1)["hi"].alias("hi"), "kids")
        )
        levels.append(runs)
        joined = F.sha2(F.array_join(F.col("kids.digest"), ""), 256)
        nodes = runs.select("tree", "n", "lo", "hi", joined.alias("digest"))
        width *= fanout


def paths_downward(levels: list[DataFrame], tops: DataFrame, carry: list[str], fanout: int) -> DataFrame:
    """One row a leaf that has a parent: (tree, kid, steps, carry...), steps leading from the leaf to the last node.

    tops(tree, lo, hi, level, steps, carry...): the last node of each tree with the steps that follow it.
    """
    above, out = None, None
    for level in range(len(levels), -1, -1):
        here = tops.where(F.col("level") == level).select("tree", "lo", "hi", "steps", *carry)
        above = here if above is None else above.unionByName(here)
        if level == 0:
            break
        width = fanout**level
        runs = levels[level - 1].select("tree", "lo", "hi", "kids").alias("r")
        inside = (
            (F.col("r.tree") == F.col("a.tree"))
            & (F.floor(F.col("r.lo") / width) == F.floor(F.col("a.lo") / width))
            & (F.col("a.lo") <= F.col("r.lo")) & (F.col("r.hi") <= F.col("a.hi"))
        )
        met = runs.join(above.alias("a"), inside).select("r.tree", "r.kids", F.col("steps").alias("after"), *carry)
        each = met.select("tree", "kids", "after", *carry, F.explode("kids").alias("kid"))
        left = F.filter("kids", lambda k: k["hi"] < F.col("kid.lo"))
        right = F.filter("kids", lambda k: k["lo"] > F.col("kid.hi"))
        step = F.struct(F.array_join(left["digest"], "").alias("left"), F.array_join(right["digest"], "").alias("right"))
        out = each.select("tree", "kid", F.concat(F.array(step), "after").alias("steps"), *carry)
        above = out.select("tree", "kid.lo", "kid.hi", "steps", *carry)
        above = stored(above) if level > 1 else above
    return out


def prove(leaves: DataFrame, fanout: int = 8) -> DataFrame:
    """(key, leaf, subroot, root, proof_sha256, folded_root, verified) for every row of leaves(key, grp, leaf, claim).

    leaf: a row's digest; claim: the digest to be verified against the root in its place. Leaves ascend by key in each
    group, null first, equal keys by leaf; groups ascend bytewise, null first. A lone leaf is its group's subroot, a lone
    subroot the root; the proof of a leaf without siblings is the digest of nothing. Null keys and groups count as values,
    repeated rows are leaves of their own, an empty table gives no rows. A group of any size spreads over all tasks.
    """
    placed = ranked(leaves, ["grp", "key", "leaf"], "pos")
    groups = placed.groupBy("grp").agg(F.count("*").alias("n"), F.min("pos").alias("first"))
    groups = ranked(groups, ["grp"], "tree")
    count, most = groups.agg(F.count("*"), F.max("n")).first()
    if not count:
        nothing = F.lit(None).cast("string")
        none = [nothing.alias(c) for c in ("subroot", "root", "proof_sha256", "folded_root")]
        return leaves.select("key", "leaf", *none, F.lit(False).alias("verified"))
    known = groups.select(F.col("grp").alias("g"), "n", "first", "tree")
    known = F.broadcast(known) if count <= FEW_GROUPS else known
    rank = F.col("pos") - F.col("first")
    nodes = placed.join(known, F.col("grp").eqNullSafe(F.col("g"))).select(
        "tree", "n", rank.alias("lo"), rank.alias("hi"), F.col("leaf").alias("digest"), "key", "claim"
    )
    levels, subroots = runs_upward(nodes, most, fanout)
    subroots = stored(subroots)
    upper = subroots.select(
        F.lit(0).cast("long").alias("tree"), F.lit(count).cast("long").alias("n"), F.col("tree").alias("lo"), F.col("tree").alias("hi"), "digest"
    )
    upper_levels, last = runs_upward(upper, count, fanout)
    nowhere = F.array().cast(STEPS)
    last = last.withColumn("steps", nowhere).withColumn("root", F.col("digest"))
    above = paths_downward(upper_levels, last, ["root"], fanout)
    above = last.select("lo", "steps", "root") if above is None else above.select("kid.lo", "steps", "root")
    tops = subroots.withColumn("subroot", F.col("digest")).join(above.withColumnRenamed("lo", "tree"), "tree")
    tops = tops.select("tree", "lo", "hi", "level", "steps", "subroot", "root")
    # groups of one leaf have no run: their leaf is the subroot
    alone = nodes.where("n = 1").join(tops.select("tree", "steps", "subroot", "root"), "tree")
    found = alone.select("key", F.col("digest").alias("leaf"), "claim", "steps", "subroot", "root")
    below = paths_downward(levels, tops, ["subroot", "root"], fanout)
    if below is not None:
        rows = below.select("kid.key", F.col("kid.digest").alias("leaf"), "kid.claim", "steps", "subroot", "root")
        found = found.unionByName(rows)
    sides = F.array_join(F.transform("steps", lambda s: F.concat(s["left"], s["right"])), "")
    folded = F.aggregate("steps", F.col("claim"), lambda h, s: F.sha2(F.concat(s["left"], h, s["right"]), 256))
    out = found.select("key", "leaf", "subroot", "root", F.sha2(sides, 256).alias("proof_sha256"), folded.alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's leaf, subroot, root and proof; where 3 divides the id's crc32 the proof meets a lower-cased text.

    Nulls in any column are `-`; a null doc_id is not tampered with. Only the five named columns are read, whatever others
    are called. Text is read once, whole; what travels on is digests.
    """
    docs = table(spark, sf_dir, "documents")
    rest = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars")]
    leaf = leaf_digest(*rest, F.col("text"))
    struck = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0, F.lit(False))
    claim = F.when(struck, leaf_digest(*rest, ascii_lower(F.col("text")))).otherwise(leaf)
    leaves = stored(docs.select(F.col("doc_id").alias("key"), F.col("lang").alias("grp"), leaf.alias("leaf"), claim.alias("claim")))
    return prove(leaves).withColumnRenamed("key", "doc_id")


QUERIES = {"op12_merkle_manifest": op12_merkle_manifest}

#: lv and tv hold the nodes of all levels, of a language's tree (tr) and of the subroots'; sb and st their siblings.
ORACLE = {
    "op12_merkle_manifest": """
WITH RECURSIVE dc AS (SELECT doc_id, text, lang, dense_rank() OVER (ORDER BY lang NULLS FIRST) - 1 AS tr,
  coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-') || coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-') AS head,
  list_reduce(list_prepend(4294967295, list_transform(string_split(doc_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)), lambda c, b: list_reduce(list_prepend(xor(c, b), [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]), lambda x, z: xor(x >> 1, 3988292384 * (x & 1)))) AS crc FROM documents),
lf AS MATERIALIZED (SELECT doc_id, tr, leaf, claim, row_number() OVER (PARTITION BY tr ORDER BY doc_id NULLS FIRST, leaf) - 1 AS r, count(*) OVER (PARTITION BY tr) AS n FROM (
  SELECT doc_id, tr, sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS leaf,
  sha256(head || coalesce(strlen(text) || ':' || CASE WHEN xor(crc, 4294967295) % 3 = 0 THEN translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE text END, '-')) AS claim FROM dc)),
lv AS (SELECT 0 AS k, tr, r AS i, leaf AS h, n FROM lf UNION ALL SELECT k + 1, tr, i // 8, sha256(string_agg(h, '' ORDER BY i)), (n + 7) // 8 FROM lv WHERE n > 1 GROUP BY k, tr, i // 8, n),
sr AS MATERIALIZED (SELECT tr, h, count(*) OVER () AS n FROM lv WHERE n = 1),
tv AS (SELECT 0 AS k, tr AS i, h, n FROM sr UNION ALL SELECT k + 1, i // 8, sha256(string_agg(h, '' ORDER BY i)), (n + 7) // 8 FROM tv WHERE n > 1 GROUP BY k, i // 8, n),
sb AS MATERIALIZED (SELECT a.k, a.tr, a.i, coalesce(string_agg(b.h, '' ORDER BY b.i) FILTER (WHERE b.i < a.i), '') AS l, coalesce(string_agg(b.h, '' ORDER BY b.i) FILTER (WHERE b.i > a.i), '') AS r FROM lv a JOIN lv b ON a.k = b.k AND a.tr = b.tr AND a.i // 8 = b.i // 8 WHERE a.n > 1 GROUP BY a.k, a.tr, a.i),
st AS MATERIALIZED (SELECT a.k, a.i, coalesce(string_agg(b.h, '' ORDER BY b.i) FILTER (WHERE b.i < a.i), '') AS l, coalesce(string_agg(b.h, '' ORDER BY b.i) FILTER (WHERE b.i > a.i), '') AS r FROM tv a JOIN tv b ON a.k = b.k AND a.i // 8 = b.i // 8 WHERE a.n > 1 GROUP BY a.k, a.i),
fd AS (SELECT doc_id, leaf, tr, 0 AS k, r AS i, claim AS acc, '' AS pf FROM lf UNION ALL SELECT doc_id, leaf, fd.tr, fd.k + 1, fd.i // 8, sha256(l || acc || r), pf || l || r FROM fd JOIN sb ON sb.k = fd.k AND sb.tr = fd.tr AND sb.i = fd.i),
low AS MATERIALIZED (SELECT fd.* FROM fd JOIN (SELECT tr, max(k) AS k FROM lv GROUP BY tr) m ON m.tr = fd.tr AND m.k = fd.k),
fu AS (SELECT doc_id, leaf, tr, 0 AS k, tr AS i, acc, pf FROM low UNION ALL SELECT doc_id, leaf, tr, fu.k + 1, fu.i // 8, sha256(l || acc || r), pf || l || r FROM fu JOIN st ON st.k = fu.k AND st.i = fu.i)
SELECT doc_id, leaf, sr.h AS subroot, root, sha256(pf) AS proof_sha256, acc AS folded_root, acc = root AS verified FROM fu JOIN sr ON sr.tr = fu.tr, (SELECT h AS root, k AS top FROM tv WHERE n = 1) WHERE fu.k = top
"""
}
