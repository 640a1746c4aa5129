"""A Merkle manifest of a table: one tree per source, and one tree over the sources' roots.

Every node is labelled with the half-open interval of leaf ranks it covers. A node of level h starts
at a multiple of ``FAN ** h``, so (tree, level, lo div FAN ** h) names the one node of level h that contains
an interval: ancestors are attached level by level, by equi-joins on that bucket with a test of containment.
The siblings of a node are what is left of its parent's interval without its own. No group holds more than
``FAN`` rows; a level is a ``FAN``-th of the one below, and only levels above the leaves are joined.

Leaves are ranked by (doc_id, digest) inside their source with running counts over range partitions, so a
source may hold any share of the rows.

Defined results: a null column is hashed as ``-``; null ids come first, rows that repeat an id come in the order of
their digests, and rows that are equal in all five columns have proofs of places next to each other; a null id
is never tampered with; a null source comes first; an empty table gives no rows; extra columns take no part.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from demandloom.llm import ranking
from demandloom.llm.tables import lower_ascii, pick, stage

FAN = 16
TAMPER_EVERY = 5
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
_NO_STEPS = "CAST(array() AS ARRAY<STRUCT<left: STRING, right: STRING>>)"


def digest(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def field(value: Column) -> Column:
    """A column of a leaf as it is hashed: ``-`` for null, else its UTF-8 byte count, a colon and the value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_digest(**changed: Column) -> Column:
    return digest(F.concat(*[field(changed.get(name, F.col(name))) for name in FIELDS]))


def _leaves(docs: DataFrame) -> DataFrame:
    """(tree, doc_id, leaf, altered, tie, one row per document, with its rank and the size of its source).

    ``altered`` is the digest after tampering, null for rows that are left alone.
    """
    source = pick(docs, **{name: name for name in FIELDS})
    picked = F.crc32(F.col("doc_id").cast("string").cast("binary")) % TAMPER_EVERY == 0
    hashed = source.select(
        F.coalesce(F.concat(F.lit("1"), "source"), F.lit("0")).alias("tree"),
        "doc_id",
        leaf_digest().alias("leaf"),
        F.when(picked, leaf_digest(text=lower_ascii(F.col("text")))).alias("altered"),
    )
    # equal rows are told apart by their place in the written table, which is read again for nothing else
    leaves = stage(hashed).withColumn("tie", F.monotonically_increasing_id())
    ranked = ranking.running(leaves, "tree", ["doc_id", "leaf", "tie"], {"rank": F.lit(1).cast("long")})
    return ranked.select(
        "tree", F.col("rank_before").alias("lo"), (F.col("rank_before") + 1).alias("hi"),
        F.col("rank_all").alias("size"), F.col("leaf").alias("digest"), "doc_id", "altered",
    )


def _bucket(lo: Column, level: int, fan: int) -> Column:
    return F.floor(lo / fan**level).cast("long")


def _families(nodes: DataFrame, level: int, fan: int, payload: tuple[str, ...] = ()) -> DataFrame:
    """(tree, lo, hi, size, digest, children): the nodes of ``level`` over those below, children in order of rank."""
    child = F.struct("lo", "hi", "digest", *payload)
    grouped = nodes.groupBy("tree", _bucket(F.col("lo"), level, fan).alias("bucket"))
    made = grouped.agg(F.array_sort(F.collect_list(child)).alias("children"), F.max("size").alias("size"))
    together = digest(F.array_join(F.transform("children", lambda c: c["digest"]), ""))
    # a leaf that is alone in its tree is the root itself
    value = F.when(F.col("size") == 1, F.col("children")[0]["digest"]).otherwise(together)
    return made.select(
        "tree", F.col("children")[0]["lo"].alias("lo"), F.element_at("children", -1)["hi"].alias("hi"),
        "size", value.alias("digest"), "children",
    )


def _levels(nodes: DataFrame, fan: int, payload: tuple[str, ...] = ()) -> list[DataFrame]:
    """The families of every level from 1 up; the last level holds the root of the largest tree."""
    below = stage(_families(nodes, 1, fan, payload))
    levels = [below]
    while True:
        # a node that covers its whole tree is the root and has no parent
        open_nodes = below.where("hi - lo < size").select("tree", "lo", "hi", "size", "digest")
        if open_nodes.isEmpty():
            return levels
        below = stage(_families(open_nodes, len(levels) + 1, fan))
        levels.append(below)


def _roots(levels: list[DataFrame]) -> DataFrame:
    """(tree, size, digest, level): one row per tree."""
    tops = [
        f.where("hi - lo = size").select("tree", "size", "digest", F.lit(i + 1).alias("level")) for i, f in enumerate(levels)
    ]
    return reduce(DataFrame.unionByName, tops)


def _step() -> Column:
    """What the parent's interval holds before and behind the child ``at``."""
    digests = F.transform("children", lambda c: c["digest"])
    left = F.array_join(F.slice(digests, F.lit(1), F.col("at")), "")
    right = F.array_join(F.slice(digests, F.col("at") + 2, F.size("children")), "")
    return F.when(F.col("size") > 1, F.array(F.struct(left.alias("left"), right.alias("right")))).otherwise(F.expr(_NO_STEPS))


def _descend(levels: list[DataFrame], roots: DataFrame, carry: tuple[str, ...], fan: int) -> DataFrame:
    """(tree, child, path, carry): every leaf with the siblings on its way up, the lowest step first.

    ``roots`` has per tree its level, the path above it, and the columns to hand down.
    """
    known = None
    for level in range(len(levels), 0, -1):
        tops = roots.where(F.col("level") == level)
        tops = tops.select("tree", F.lit(0).cast("long").alias("lo"), F.col("size").alias("hi"), "path", *carry)
        known = tops if known is None else known.unionByName(tops)
        above = known.withColumns({"bucket": _bucket(F.col("lo"), level, fan)})
        above = above.withColumnsRenamed({"lo": "from", "hi": "to"})
        family = levels[level - 1].withColumn("bucket", _bucket(F.col("lo"), level, fan))
        met = family.join(above, ["tree", "bucket"]).where(F.col("lo").between(F.col("from"), F.col("to") - 1))
        down = met.select("tree", "size", "children", "path", *carry, F.posexplode("children").alias("at", "child"))
        known = down.select("tree", "child", F.concat(_step(), "path").alias("path"), *carry)
        if level > 1:
            known = known.select("tree", "child.lo", "child.hi", "path", *carry)
    return known


def manifest(docs: DataFrame, fan: int = FAN) -> tuple[DataFrame, DataFrame]:
    """(nodes, proofs) of ``docs``.

    nodes: (tree, level, lo, hi, digest) of all nodes above the leaves of all sources; tree is the source behind
    a ``1``, or ``0`` for the null source. proofs: (doc_id, leaf, altered, path, subroot, root), one row per document;
    ``path`` lists per level the siblings to the left and to the right, from the leaf up to the root.
    """
    lower = _levels(_leaves(docs), fan, ("doc_id", "altered"))
    subroots = _roots(lower).withColumn("all", F.lit(0))
    ranked = ranking.running(subroots, "all", ["tree"], {"rank": F.lit(1).cast("long")})
    tops = ranked.select(
        F.lit("all").alias("tree"), F.col("rank_before").alias("lo"), (F.col("rank_before") + 1).alias("hi"),
        F.col("rank_all").alias("size"), "digest",
        F.col("tree").alias("source"), F.col("size").alias("leaves"), F.col("level").alias("height"),
    )
    upper = _levels(tops, fan, ("source", "leaves", "height"))
    root = _roots(upper).select("tree", "size", "level", F.col("digest").alias("root"), F.expr(_NO_STEPS).alias("path"))
    sources = stage(_descend(upper, root, ("root",), fan)).select(
        F.col("child.source").alias("tree"), F.col("child.leaves").alias("size"), F.col("child.height").alias("level"),
        F.col("child.digest").alias("subroot"), "path", "root",
    )
    placed = _descend(lower, sources, ("subroot", "root"), fan)
    proofs = placed.select(
        "child.doc_id", F.col("child.digest").alias("leaf"), "child.altered", "path", "subroot", "root"
    )
    numbered = [f.select("tree", F.lit(i + 1).alias("level"), "lo", "hi", "digest") for i, f in enumerate(lower)]
    return reduce(DataFrame.unionByName, numbered), proofs


def fold(start: Column, path: Column) -> Column:
    """The root that ``start`` and the siblings of ``path`` lead to."""
    return F.aggregate(path, start, lambda h, step: digest(F.concat(step["left"], h, step["right"])))


def manifest_digest(docs: DataFrame) -> DataFrame:
    """The contract's columns: doc_id, leaf, subroot, root, proof_sha256, folded_root, verified."""
    siblings = F.array_join(F.transform("path", lambda step: F.concat(step["left"], step["right"])), "")
    folded = manifest(docs)[1].withColumn("folded_root", fold(F.coalesce("altered", "leaf"), F.col("path")))
    return folded.select(
        "doc_id", "leaf", "subroot", "root", digest(siblings).alias("proof_sha256"), "folded_root",
        (F.col("folded_root") == F.col("root")).alias("verified"),
    )


def _sql_field(name: str) -> str:
    text = f"CAST({name} AS VARCHAR)"
    return f"coalesce(CAST(octet_length(encode({text})) AS VARCHAR) || ':' || {text}, '-')"


_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
# crc32 bit by bit: -1 stands for a shift of the register, other numbers for a byte that enters it.
_CRC = (
    "xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), flatten(list_transform(range(1, length(s) + 1), "
    "lambda i: [CAST(ascii(substr(s, i, 1)) AS BIGINT), -1, -1, -1, -1, -1, -1, -1, -1]))), "
    "lambda c, x: CASE WHEN x >= 0 THEN xor(c, x) WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END), 4294967295)"
)


def _sql_tree(name: str, start: str) -> str:
    """All levels of the trees that ``start`` (tree, rank, size, digest) holds the leaves of."""
    return f"""
{name}(tree, level, rank, size, digest) AS (
  SELECT tree, 0, rank, size, digest FROM {start}
  UNION ALL
  SELECT tree, level + 1, rank // {FAN}, any_value((size + {FAN - 1}) // {FAN}),
         sha256(string_agg(digest, '' ORDER BY rank))
  FROM {name} WHERE size > 1 GROUP BY tree, level, rank // {FAN})"""


def _sql_steps(name: str, tree: str) -> str:
    """Per node of ``tree`` the digests before and behind it under its parent."""
    run = f"PARTITION BY tree, level, rank // {FAN} ORDER BY rank ROWS BETWEEN"
    return f"""
{name} AS (
  SELECT *, coalesce(string_agg(digest, '') OVER ({run} UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS l,
         coalesce(string_agg(digest, '') OVER ({run} 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS r
  FROM {tree})"""


SQL = f"""
WITH RECURSIVE leaves AS (
  SELECT doc_id, coalesce('1' || source, '0') AS tree,
         sha256({" || ".join(map(_sql_field, FIELDS))}) AS leaf,
         sha256({" || ".join(_sql_field(f if f != "text" else f"translate(text, '{_UPPER}', '{_UPPER.lower()}')") for f in FIELDS)}) AS low,
         CAST(doc_id AS VARCHAR) AS s
  FROM documents),
ranked AS (
  SELECT *, coalesce({_CRC} % {TAMPER_EVERY} = 0, false) AS tampered, leaf AS digest,
         row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS rank,
         count(*) OVER (PARTITION BY tree) AS size
  FROM leaves),
{_sql_tree("lower_tree", "ranked")},
subroots AS (
  SELECT 'all' AS tree, tree AS source, digest, row_number() OVER (ORDER BY tree) - 1 AS rank, count(*) OVER () AS size
  FROM lower_tree WHERE size = 1),
{_sql_tree("upper_tree", "subroots")},
{_sql_steps("lower_steps", "lower_tree")},
{_sql_steps("upper_steps", "upper_tree")},
steps AS (
  SELECT k.doc_id, k.leaf, k.tree, k.rank, n.level, n.l, n.r
  FROM ranked k JOIN lower_steps n ON n.tree = k.tree AND n.size > 1 AND n.rank = k.rank // CAST(pow({FAN}, n.level) AS BIGINT)
  UNION ALL
  SELECT k.doc_id, k.leaf, k.tree, k.rank, 100 + n.level, n.l, n.r
  FROM ranked k JOIN subroots t ON t.source = k.tree
  JOIN upper_steps n ON n.size > 1 AND n.rank = t.rank // CAST(pow({FAN}, n.level) AS BIGINT)),
paths AS (
  SELECT tree, rank, list(l || '|' || r ORDER BY level) AS path, string_agg(l || r, '' ORDER BY level) AS siblings
  FROM steps GROUP BY tree, rank),
folded AS (
  SELECT k.doc_id, k.leaf, t.digest AS subroot, (SELECT digest FROM upper_tree WHERE size = 1) AS root,
         sha256(coalesce(p.siblings, '')) AS proof_sha256,
         list_reduce(list_prepend(CASE WHEN k.tampered THEN k.low ELSE k.leaf END, coalesce(p.path, [])),
           lambda h, x: sha256(split_part(x, '|', 1) || h || split_part(x, '|', 2))) AS folded_root
  FROM ranked k JOIN subroots t ON t.source = k.tree
  LEFT JOIN paths p ON p.tree = k.tree AND p.rank = k.rank)
SELECT *, folded_root = root AS verified FROM folded
"""
