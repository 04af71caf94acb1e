"""Operator 13: a Merkle manifest of a dataset, by sibling-shift self-joins.

Every row is a leaf: a digest of its columns. Leaves of a group stand in the order of their ids; every ``fanout``
consecutive nodes are a run, and a run's digest is its parent. At each level nodes meet their siblings by an equijoin on
computed indices (the other one of a pair is ``idx ^ 1``; in wider runs the slot is moved by 1, 2, ...), and the node in
slot 0 emits the parent. Groups' roots, in the order of the groups, are the leaves of one more such tree. The way up
from a leaf is handed down from the root: a node's proof is its siblings and then its parent's proof, again one equijoin
a level, so the work on a table of N rows is some 2 N rows in all and not N for each level.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ROWS_PER_TASK, Scratch, column, running_total, staged

#: Levels of at most this many nodes (under 200 bytes each without proofs) are sent to the tasks instead of shuffled.
SMALL = 10_000
#: Columns of a document's leaf, in this order.
LEAF = ("doc_id", "source", "lang", "n_chars", "text")


def leaf_digest(values: list[Column]) -> Column:
    """SHA-256 (lowercase hex) of values, each as its UTF-8 length, a colon and itself, or ``-`` for null."""
    text = [v.cast("string") for v in values]
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in text]), 256)


def text_of(digest: Column) -> Column:
    """Lowercase hex of one digest or of several in a row; tables hold digests as bytes."""
    return F.lower(F.hex(digest))


def parent_of(before: Column, digest: Column, after: Column) -> Column:
    """Digest of a run: of its nodes' digests as hex text, one after the other."""
    return F.unhex(F.sha2(F.concat(text_of(before), text_of(digest), text_of(after)), 256))


def with_siblings(nodes: DataFrame, fanout: int, small: bool) -> DataFrame:
    """Nodes (``g, idx, n, digest``) with ``before`` and ``after``: the digests of the lower and the higher slots of their run."""
    out = nodes
    slot = F.col("idx") % fanout
    for d in range(1, fanout):
        moved = F.col("idx").bitwiseXOR(F.lit(1).cast("long")) if fanout == 2 else F.col("idx") - slot + (slot + d) % fanout
        shifted = nodes.select("g", moved.alias("idx"), F.struct(slot.alias("slot"), "digest").alias(f"s{d}"))
        out = out.join(F.broadcast(shifted) if small else shifted, ["g", "idx"], "left")
    others = F.array_sort(F.array_compact(F.array(*[F.col(f"s{d}") for d in range(1, fanout)])))

    def side(keep) -> Column:
        return F.aggregate(F.filter(others, keep), F.unhex(F.lit("")), lambda s, x: F.concat(s, x["digest"]))

    return out.select("g", "idx", "n", "digest", side(lambda x: x["slot"] < slot).alias("before"), side(lambda x: x["slot"] > slot).alias("after"))


def climb(leaves: DataFrame, rows: int, most: int, groups: int, fanout: int, work: Scratch) -> list[tuple[DataFrame, bool]]:
    """The levels of all groups' trees, leaves first, each a staged table and whether it is small; ``most`` is the largest group's leaves."""
    levels, nodes = [], leaves
    while True:
        small = rows <= SMALL
        level = with_siblings(nodes, fanout, small)
        levels.append((work.table(level.coalesce(1) if small else level, "level"), small))
        if most <= 1:
            return levels
        parent = parent_of(F.col("before"), F.col("digest"), F.col("after"))
        nodes = levels[-1][0].filter((F.col("n") > 1) & (F.col("idx") % fanout == 0)).select("g", F.floor(F.col("idx") / fanout).alias("idx"), F.ceil(F.col("n") / fanout).alias("n"), parent.alias("digest"))
        most, rows = -(-most // fanout), rows // fanout + groups


def tops(levels: list[tuple[DataFrame, bool]]) -> DataFrame:
    """``g, digest``: the root of each group's tree."""
    out = None
    for level, _ in levels:
        top = level.filter("n = 1").select("g", "digest")
        out = top if out is None else out.unionByName(top)
    return out


def descend(levels: list[tuple[DataFrame, bool]], above: DataFrame, fanout: int, work: Scratch) -> DataFrame:
    """``g, idx, path`` of the leaves: siblings from the leaf up, then what ``above`` (``g, path``) says of the group."""
    upper = None
    for at in reversed(range(len(levels))):
        level, small = levels[at]
        now = level.filter("n = 1").join(above, "g").select("g", "idx", "path")
        if upper is not None:
            up = upper.select("g", F.col("idx").alias("parent"), F.col("path").alias("rest"))
            own = level.filter("n > 1").withColumn("parent", F.floor(F.col("idx") / fanout))
            own = own.join(F.broadcast(up) if levels[at + 1][1] else up, ["g", "parent"])
            now = now.unionByName(own.select("g", "idx", F.concat(F.array(F.struct("before", "after")), F.col("rest")).alias("path")))
        done, upper = upper, now if at == 0 else work.table(now.coalesce(1) if small else now, "paths")
        if at:
            work.drop(level, done)
    return upper


def folded(start: Column, path: Column) -> Column:
    """The root that a leaf and its path give."""
    return F.aggregate(path, start, lambda d, x: parent_of(x["before"], d, x["after"]))


def manifest(docs: DataFrame, *, group_col: str = "lang", id_col: str = "doc_id", columns: tuple[str, ...] = LEAF, changed: dict[str, Column] | None = None, fanout: int = 2) -> DataFrame:
    """``<id>, <group>, idx, leaf, subroot, root, path, claimed, folded_root, verified`` of every row, a staged table.

    ``leaf`` is the digest of ``columns`` (those that the table hasn't count as null); leaves of a group ascend by id (long,
    null first), rows that share one by digest. ``path`` is an array of what stands before and after in each run, up to
    ``root``, as bytes; the other digests are hex. ``changed`` gives other values for some columns: ``claimed`` is the leaf of the changed row (else ``leaf``), and ``verified``
    says whether it still folds to ``root``. Groups ascend by UTF-8 bytes, null first; each group's size is counted, no
    group is ever in one task, and only two numbers and the root come to the driver. An empty table gives no rows.
    """
    if fanout < 2:
        raise ValueError("a run has two nodes at least")
    kinds = {c: "long" for c in (id_col, "n_chars")}
    values = [column(docs, c, kinds.get(c, "string")) for c in columns]
    other = [(changed or {}).get(c, v) for c, v in zip(columns, values, strict=True)]
    rows = docs.select(
        column(docs, id_col, "long").alias("id"), column(docs, group_col, "string").alias("grp"), F.unhex(leaf_digest(values)).alias("leaf"),
        (F.unhex(leaf_digest(other)) if changed else F.lit(None).cast("binary")).alias("claimed"), F.lit(1).cast("long").alias("one"),
    ).withColumn("claimed", F.nullif("claimed", "leaf"))
    with Scratch(docs.sparkSession, "manifest") as work, Scratch(docs.sparkSession, "manifest-order") as first:
        rows = first.table(rows, "leaves")
        total = rows.count()
        ordered = running_total(rows, ["grp", "id", "leaf"], "one", "at", first, max(1, total // ROWS_PER_TASK, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
        groups = work.table(ordered.groupBy("grp").agg(F.min("at").alias("first"), F.count("*").alias("n")).withColumn("one", F.lit(1).cast("long")), "groups")
        n_groups, most = groups.agg(F.count("*"), F.coalesce(F.max("n"), F.lit(0))).first()
        numbered = work.table(running_total(groups, ["grp"], "one", "g", work, max(1, n_groups // ROWS_PER_TASK)).withColumnRenamed("grp", "of"), "numbered")
        place = ordered.join(numbered, F.col("grp").eqNullSafe(F.col("of"))).select("g", (F.col("at") - F.col("first")).alias("idx"), "n", "id", "grp", "leaf", "claimed")
        place = work.table(place, "placed")
        first.clear()
        levels = climb(place.select("g", "idx", "n", F.col("leaf").alias("digest")), total, most, n_groups, fanout, work)
        subroots = work.table(tops(levels), "subroots")
        upper = climb(subroots.select(F.lit(0).cast("long").alias("g"), F.col("g").alias("idx"), F.lit(n_groups).cast("long").alias("n"), "digest"), n_groups, n_groups, 1, fanout, work)
        found = tops(upper).first()
        root = F.lit(bytes(found["digest"]) if found else None).cast("binary")
        nothing = F.array().cast("array<struct<before:binary,after:binary>>")
        ways = descend(upper, docs.sparkSession.range(1).select(F.col("id").alias("g"), nothing.alias("path")), fanout, work)
        above = work.table(ways.select(F.col("idx").alias("g"), "path").join(subroots, "g"), "groups-up")
        paths = descend(levels, above.select("g", "path"), fanout, work)
        out = place.drop("n").join(paths, ["g", "idx"]).join(above.select("g", F.col("digest").alias("subroot")), "g")
        end = folded(F.coalesce("claimed", "leaf"), F.col("path"))
        out = out.select(F.col("id").alias(id_col), F.col("grp").alias(group_col), "idx", text_of(F.col("leaf")).alias("leaf"), text_of(F.col("subroot")).alias("subroot"), text_of(root).alias("root"), "path", text_of(F.coalesce("claimed", "leaf")).alias("claimed"), end.alias("end"))
        return staged(out.select(*out.columns[:-1], text_of(F.col("end")).alias("folded_root"), (F.col("end") == root).alias("verified")), "manifest")


def proof_digest(path: Column) -> Column:
    """SHA-256 of all siblings of a path, level by level, left to right."""
    return F.sha2(F.array_join(F.transform(path, lambda x: text_of(F.concat(x["before"], x["after"]))), ""), 256)


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row of ``documents`` as a leaf; one more in ``n_chars`` where 7 divides the id's crc32."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    tampered = F.when(F.crc32(F.col("doc_id").cast("string")) % 7 == 0, F.col("n_chars") + 1).otherwise(F.col("n_chars"))
    out = manifest(docs, changed={"n_chars": tampered})
    return out.select("doc_id", "leaf", "subroot", "root", proof_digest(F.col("path")).alias("proof_sha256"), "folded_root", "verified")


OP13_SQL = """
with recursive d as (select row_number() over () as r, doc_id, source, lang, n_chars, text, coalesce(strlen(cast(doc_id as varchar)) || ':' || cast(doc_id as varchar), '-') || coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-') as a, coalesce(strlen(text) || ':' || text, '-') as z,
  xor(list_reduce(list_prepend(4294967295::ubigint, list_transform(string_split(cast(doc_id as varchar), ''), lambda c: ascii(c)::ubigint)), lambda x, b: list_reduce(list_prepend(xor(x, b), list_transform(range(8), lambda i: i::ubigint)), lambda v, j: case when v % 2 = 1 then xor(v >> 1, 3988292384::ubigint) else v >> 1 end)), 4294967295::ubigint) as crc from documents),
leaves as (select r, doc_id, lang, sha256(a || coalesce(strlen(cast(n_chars as varchar)) || ':' || n_chars, '-') || z) as leaf, case when crc % 7 = 0 then sha256(a || coalesce(strlen(cast(n_chars + 1 as varchar)) || ':' || (n_chars + 1), '-') || z) end as claimed from d),
placed as (select *, coalesce('=' || lang, '-') as g, row_number() over (partition by lang order by doc_id nulls first, leaf) - 1 as idx, count(*) over (partition by lang) as n from leaves),
tree as (select g, 0 as lvl, idx, n, leaf as h from placed union all select g, lvl + 1, idx // 2, (n + 1) // 2, sha256(string_agg(h, '' order by idx)) from tree where n > 1 group by g, lvl, idx // 2, n),
subs as (select g, h as subroot, row_number() over (order by g <> '-', encode(g)) - 1 as idx, count(*) over () as n from tree where n = 1),
top as (select 0 as lvl, idx, n, subroot as h from subs union all select lvl + 1, idx // 2, (n + 1) // 2, sha256(string_agg(h, '' order by idx)) from top where n > 1 group by lvl, idx // 2, n),
walk as (select p.r, p.g, 0 as lvl, p.idx, p.n, coalesce(p.claimed, p.leaf) as h, '' as proof from placed p
  union all select w.r, w.g, w.lvl + 1, w.idx // 2, (w.n + 1) // 2, sha256(case when w.idx % 2 = 1 then s.h || w.h else w.h || coalesce(s.h, '') end), w.proof || coalesce(s.h, '') from walk w left join tree s on s.g = w.g and s.lvl = w.lvl and s.idx = xor(w.idx, 1) where w.n > 1),
up as (select w.r, 0 as lvl, s.idx, s.n, w.h, w.proof from walk w join subs s on s.g = w.g where w.n = 1
  union all select w.r, w.lvl + 1, w.idx // 2, (w.n + 1) // 2, sha256(case when w.idx % 2 = 1 then s.h || w.h else w.h || coalesce(s.h, '') end), w.proof || coalesce(s.h, '') from up w left join top s on s.lvl = w.lvl and s.idx = xor(w.idx, 1) where w.n > 1)
select p.doc_id, p.leaf, s.subroot, t.h as root, sha256(u.proof) as proof_sha256, u.h as folded_root, u.h = t.h as verified
from placed p join subs s on s.g = p.g join up u on u.r = p.r and u.n = 1 join top t on t.n = 1
"""
