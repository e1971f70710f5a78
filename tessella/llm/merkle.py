"""Merkle manifest of a table: a root over all rows, and for every row a proof of membership.

A row's leaf is the SHA-256 of its fields, each as `-` if null, else as its number of UTF-8
bytes, `:` and its value. The leaves of a group, ordered by key, are hashed in runs of two until
one node is left, the group's subroot; a last run may be a single node, which is hashed too. The
subroots, ordered by group (null first, bytewise), give the root in the same way. Digests are
hashed as lowercase hex text and kept as 32 bytes.

Levels are windows: partitioned by group and parent, the ordered full-frame collect_list of a run
is the parent's preimage and holds each node's sibling. The first node of a run stands for it in
the next level, so parents are there once. Each level is written, half as large as the one below.
Proofs go down again: a level's rows join their parents' proofs and put their sibling in front.
There is a join a level and no key with more than two rows, however large a group is.

Places in a group are found without bringing it together: rows are dealt by range of (group, key,
leaf, place in the leaves' table), sorted within partitions and numbered from the counts of the
partitions before. Rows of one key are ordered by leaf; equal rows are a leaf each. A null key is
a field `-` and comes first. An empty table has no rows and no root.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import shared

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def field(c: Column) -> Column:
    said = c.cast("string")
    return F.coalesce(F.concat(F.octet_length(said).cast("string"), F.lit(":"), said), F.lit("-"))


def digest(*fields: Column) -> Column:
    """The leaf of these fields."""
    return F.unhex(F.sha2(F.concat(*map(field, fields)), 256))


def text_of(h: Column) -> Column:
    return F.lower(F.hex(h))


def node(run: Column) -> Column:
    """H of an array of digests."""
    return F.unhex(F.sha2(F.array_join(F.transform(run, text_of), ""), 256))


def numbered(rows: DataFrame, order: Sequence[str]) -> DataFrame:
    """rows (a table that was written, with grp) with idx, the place in its group by order, and n, the group's size."""
    salt = "_salt"
    dealt = rows.withColumn(salt, F.monotonically_increasing_id()).repartitionByRange(shared.partitions(rows.sparkSession), "grp", *order, salt)
    held = shared.table(dealt.sortWithinPartitions("grp", *order, salt).drop(salt).withColumn("_at", F.monotonically_increasing_id()), "sorted")
    held = held.withColumn("_part", F.shiftrightunsigned("_at", 33))
    whole = Window.partitionBy("grp")
    before = F.coalesce(F.sum("_n").over(whole.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = held.groupBy("grp", "_part").agg(F.count("*").alias("_n"), F.min("_at").alias("_first"))
    parts = parts.select("grp", "_part", (before - F.col("_first")).alias("_shift"), F.sum("_n").over(whole).alias("n"))
    return held.join(parts, ["grp", "_part"]).withColumn("idx", F.col("_at") + F.col("_shift")).drop("_at", "_part", "_shift")


def levels(nodes: DataFrame) -> list[DataFrame]:
    """Of nodes (grp, idx, n, h, ...) every level with more than one node, from the leaves up: its rows with
    parent, sib (null for a lone node) and up, the parent's digest. Further columns stay with the leaves."""
    run = Window.partitionBy("grp", "parent").orderBy("idx").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    tall, made = nodes.agg(F.max("n")).first()[0] or 0, []
    while tall > 1:
        both = nodes.where("n > 1").withColumn("parent", F.shiftright("idx", 1)).withColumn("run", F.collect_list("h").over(run))
        sib = F.when(F.size("run") > 1, F.get("run", (1 - F.col("idx") % 2).cast("int")))
        level = shared.table(both.withColumns({"sib": sib, "up": node(F.col("run"))}).drop("run"), "level")
        made.append(level)
        nodes = level.where("idx % 2 = 0").select("grp", F.col("parent").alias("idx"), F.shiftright(F.col("n") + 1, 1).alias("n"), F.col("up").alias("h"))
        tall = (tall + 1) // 2
    return made


def tops(nodes: DataFrame, made: list[DataFrame]) -> DataFrame:
    """grp, height, h: the last node of each group."""
    found = nodes.where("n = 1").select("grp", F.lit(0).alias("height"), "h")
    for i, level in enumerate(made):
        found = found.unionByName(level.where("n = 2 AND idx = 0").select("grp", F.lit(i + 1).alias("height"), F.col("up").alias("h")))
    return found


def proved(nodes: DataFrame, made: list[DataFrame], above: DataFrame, carried: Sequence[str]) -> DataFrame:
    """The leaves with path (siblings from the leaf up, null where a node is alone), at (its bits from the lowest:
    whether the node is the right one) and what is carried. above: grp, height, path, at, carried of each group's top."""
    rest = ["path", "at", *carried]
    start = lambda i: above.where(F.col("height") == i).select(F.col("grp").alias("_grp"), F.lit(0).cast("long").alias("_idx"), *rest)
    below = None
    for i, level in reversed(list(enumerate(made))):
        over = start(i + 1) if below is None else start(i + 1).unionByName(below)
        met = level.join(over, (F.col("grp") == F.col("_grp")) & (F.col("parent") == F.col("_idx")))
        met = met.withColumns({"path": F.concat(F.array("sib"), "path"), "at": F.col("at") * 2 + F.col("idx") % 2})
        below = met.select(F.col("grp").alias("_grp"), F.col("idx").alias("_idx"), *rest) if i else met
    leaves = [c for c in nodes.columns if c not in ("n", "idx")]
    alone = nodes.where("n = 1").join(start(0), F.col("grp") == F.col("_grp")).select(*leaves, *rest)
    return alone if below is None else alone.unionByName(below.select(*leaves, *rest))


def folded(leaf: Column, path: Column, at: Column) -> Column:
    """The root that a leaf and a path give, as bytes."""
    sides = lambda a, s: F.when(s.isNull(), F.array(a["h"])).when(a["at"] % 2 == 0, F.array(a["h"], s)).otherwise(F.array(s, a["h"]))
    start = F.struct(leaf.alias("h"), at.alias("at"))
    return F.aggregate(path, start, lambda a, s: F.struct(node(sides(a, s)).alias("h"), F.shiftright(a["at"], 1).alias("at")), lambda a: a["h"])


def manifest(docs: DataFrame, key: str = "doc_id", group: str = "lang", fields: Sequence[str] = FIELDS, carried: dict[str, Column] | None = None) -> DataFrame:
    """key, leaf, path, at, subroot, root of every row, and what is carried (columns over docs); digests as bytes."""
    with shared.temporary(docs.sparkSession) as keep:
        return keep(shared.table(_manifest(docs, key, group, fields, carried or {}), "manifest"))


def _manifest(docs: DataFrame, key: str, group: str, fields: Sequence[str], carried: dict[str, Column]) -> DataFrame:
    own = F.coalesce(F.concat(F.lit("="), F.col(group).cast("string")), F.lit(""))  # orders as the group does, null first
    rows = docs.select(own.alias("grp"), F.col(key).alias("key"), digest(*map(F.col, fields)).alias("h"), F.struct(F.lit(0), *[c.alias(n) for n, c in carried.items()]).alias("more"))
    nodes = shared.table(numbered(shared.table(rows, "leaves"), ["key", "h"]), "nodes")
    made = levels(nodes)
    groups = shared.table(tops(nodes, made), "subroots")
    over = shared.table(numbered(groups.select(F.lit("").alias("grp"), F.col("grp").alias("of"), "height", "h"), ["of"]), "groups")
    high = levels(over)
    one = tops(over, high).select("grp", "height", F.array().cast("array<binary>").alias("path"), F.lit(0).cast("long").alias("at"), F.col("h").alias("root"))
    above = proved(over.withColumnsRenamed({"height": "tall"}), [x.withColumnsRenamed({"height": "tall"}) for x in high], one, ["root"])
    above = shared.table(above.select(F.col("of").alias("grp"), F.col("tall").alias("height"), "path", "at", F.col("h").alias("subroot"), "root"), "above")
    found = proved(nodes, made, above, ["subroot", "root"])
    return found.select(F.col("key").alias(key), F.col("h").alias("leaf"), "path", "at", "subroot", "root", *[F.col(f"more.{n}").alias(n) for n in carried])


def judged(docs: DataFrame, key: str = "doc_id", group: str = "lang", fields: Sequence[str] = FIELDS, count: str = "n_chars", every: int = 7) -> DataFrame:
    """Digests of the manifest, and what comes of it where `every` divides the CRC-32 of the key's decimal
    text: there the count is one more (null stays) when the root is computed again."""
    more = F.when(F.crc32(F.col(key).cast("string")) % every == 0, F.col(count).cast("decimal(38,0)") + 1)
    other = digest(*[F.coalesce(more.cast("string"), F.col(c).cast("string")) if c == count else F.col(c) for c in fields])
    made = manifest(docs, key, group, fields, {"other": F.when(more.isNotNull(), other)})
    again = folded(F.coalesce("other", "leaf"), F.col("path"), F.col("at"))
    proof = F.sha2(F.array_join(F.transform(F.filter("path", lambda s: s.isNotNull()), text_of), ""), 256)
    out = made.select(key, *[text_of(F.col(c)).alias(c) for c in ("leaf", "subroot", "root")], proof.alias("proof_sha256"), text_of(again).alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))
