"""A Merkle manifest of a dataset: a digest per row, a tree per group of rows, and a tree over the groups' roots.

1. Every row becomes a leaf, the SHA-256 of its columns with their lengths.
2. Leaves are numbered in order within their group. A row_number over a group would be one task for a group that holds
   a third of all rows, so rows are dealt by ranges and numbered within them; the ranges' counts give the offsets.
3. Levels go up in strides: nodes are grouped by their index divided by FANOUT^STRIDE, the sorted child array of such a
   block is hashed into parents STRIDE times, and what remains is a node of the next stride. A stride of 1 would be a
   shuffle a level; the result is the same for any stride.
4. Levels come down by a join a stride, which appends the siblings on a block's way to the root to those within it. It
   joins blocks, not rows; rows are unfolded from their block at the end, so no proof is shuffled with a row.

A proof is the array of (left, right) sibling digests of a row, one entry a level; it recomputes the root from a leaf.
All work here is DataFrame operations.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from brightloom.llm.common import dealt, packed, stored

FANOUT, STRIDE = 2, 8
#: Columns of a leaf, in order, and the group that has a tree of its own.
COLUMNS, GROUP, ORDER = ("doc_id", "source", "lang", "n_chars", "text"), "lang", "doc_id"
#: The query tampers with rows whose id has a CRC-32 that this divides.
TAMPERED = 7
STEP = "struct<left:array<string>,right:array<string>>"


def field(value: Column) -> Column:
    """A value with its length in bytes, or - for null, so that no two rows have the same concatenation."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(columns: list[Column]) -> Column:
    return F.sha2(F.concat(*map(field, columns)), 256)


def hashed(digests: Column) -> Column:
    """The digest of an array of digests, as their hex texts one behind the other."""
    return F.sha2(F.array_join(digests, ""), 256)


def numbered(rows: DataFrame, group: str, order: list[str]) -> DataFrame:
    """rows with ``place``, from 0 in each group by ``order``, and ``total``, the size of the group.

    Equal rows of any number are told apart by their place in the stored table, so that no range holds them all.
    """
    keys = [group, *order, "_at"]
    ranged = rows.withColumn("_at", F.monotonically_increasing_id()).repartitionByRange(*keys).sortWithinPartitions(*keys).drop("_at")
    # the id of a row is its partition's number, shifted, plus its number in the partition
    spot = F.monotonically_increasing_id()
    ranged = stored(ranged.withColumn("_part", F.shiftright(spot, 33).cast("int")).withColumn("_row", spot.bitwiseAND(F.lit((1 << 33) - 1))), "merkle-ranges")
    parts = ranged.groupBy(group, "_part").agg(F.count("*").alias("_n"), F.min("_row").alias("_first"))
    whole = Window.partitionBy(group)  # at most a row for each range
    before = F.sum("_n").over(whole.orderBy("_part")) - F.col("_n")
    shifts = parts.select(F.col(group).alias("_group"), "_part", (before - F.col("_first")).alias("_shift"), F.sum("_n").over(whole).alias("total"))
    shifts = stored(shifts, "merkle-offsets")
    same = F.col(group).eqNullSafe(F.col("_group")) & (ranged["_part"] == shifts["_part"])
    return ranged.join(shifts, same).select(*[ranged[c] for c in rows.columns], (F.col("_row") + F.col("_shift")).alias("place"), "total")


def parents(nodes: Column, fanout: int) -> Column:
    """The next level of an array of digests."""
    last = F.floor((F.size(nodes) - 1) / fanout).cast("int")
    return F.transform(F.sequence(F.lit(0), last), lambda i: hashed(F.slice(nodes, i * fanout + 1, fanout)))


def levels(nodes: Column, times: Column, fanout: int) -> Column:
    """The array of levels above an array of digests, itself first; a block has at most fanout^stride nodes."""
    up = lambda acc, _: F.concat(acc, F.array(parents(F.element_at(acc, -1), fanout)))
    turns = F.when(times > 0, F.sequence(F.lit(1), times)).otherwise(F.array().cast("array<int>"))
    return F.aggregate(turns, F.array(nodes), up)


def siblings(levels_: Column, place: Column, fanout: int) -> Column:
    """One (left, right) a level: the digests beside the node at ``place`` of the lowest level in its run of ``fanout``."""
    up = F.slice(levels_, 1, F.size(levels_) - 1)

    def step(nodes: Column, k: Column) -> Column:
        at = F.floor(place / F.pow(F.lit(fanout), k)).cast("int")
        first = at - at % fanout
        return F.struct(F.slice(nodes, first + 1, at - first).alias("left"), F.slice(nodes, at + 2, F.lit(fanout - 1) - (at - first)).alias("right"))

    return F.transform(up, step)


def folded(leaf_: Column, path: Column) -> Column:
    """The root that a leaf and the siblings on its way give."""
    return F.aggregate(path, leaf_, lambda acc, x: hashed(F.concat(x["left"], F.array(acc), x["right"])))


def blocks(nodes: DataFrame, group: str, more: list[str], fanout: int, stride: int) -> DataFrame:
    """(group, block, total, nodes, levels): nodes of ``group`` by place, grouped into blocks with all their levels."""
    width = fanout**stride
    block = F.floor(F.col("place") / width).cast("long").alias("block")
    held = F.struct((F.col("place") % width).cast("int").alias("at"), "digest", *more)
    grouped = nodes.groupBy(group, block).agg(F.first("total").alias("total"), F.sort_array(F.collect_list(held)).alias("nodes"))
    # a group of one block ends at one node, any other goes up the whole stride
    alone = F.aggregate(F.sequence(F.lit(1), F.lit(stride)), F.struct(F.size("nodes").alias("n"), F.lit(0).alias("k")), lambda acc, _: F.struct(F.ceil(acc["n"] / fanout).cast("int").alias("n"), (acc["k"] + (acc["n"] > 1).cast("int")).alias("k")))["k"]
    times = F.when(F.col("total") <= width, alone).otherwise(F.lit(stride))
    digests = F.transform("nodes", lambda x: x["digest"])
    return grouped.select(group, "block", "total", "nodes", levels(digests, times, fanout).alias("levels"))


def tree(leaves: DataFrame, group: str, order: list[str], more: list[str], fanout: int = FANOUT, stride: int = STRIDE) -> tuple[DataFrame, DataFrame]:
    """((group, root), (group, *more, digest, path)) of leaves (group, digest, *more): the trees, and each leaf's way up."""
    width, tables = fanout**stride, []
    nodes, kept = numbered(leaves, group, order), more
    while True:
        tables.append(stored(blocks(nodes, group, kept, fanout, stride), "merkle-blocks"))
        if (tables[-1].agg(F.max("block")).first()[0] or 0) == 0:
            break
        top = F.element_at("levels", -1)[0].alias("digest")
        nodes, kept = tables[-1].select(group, F.col("block").alias("place"), top, F.ceil(F.col("total") / width).alias("total")), []
    roots = tables[-1].select(group, F.element_at("levels", -1)[0].alias("root"))
    ways = tables[-1].select(F.col(group).alias("_group"), F.col("block").alias("_block"), F.array().cast(f"array<{STEP}>").alias("_way"))
    for n, table in reversed(list(enumerate(tables))):
        same = F.col(group).eqNullSafe(F.col("_group")) & (F.col("block") == F.col("_block"))
        at = table.join(ways, same).select(group, "block", "levels", "_way", F.explode("nodes").alias("x"))
        way = F.concat(siblings(F.col("levels"), F.col("x.at"), fanout), "_way")
        if n:
            ways = at.select(F.col(group).alias("_group"), (F.col("block") * width + F.col("x.at")).alias("_block"), way.alias("_way"))
    return roots, at.select(group, *[F.col(f"x.{c}").alias(c) for c in more], F.col("x.digest").alias("digest"), way.alias("path"))


def manifest(docs: DataFrame, columns: tuple[str, ...] = COLUMNS, group: str = GROUP, order: str = ORDER, changed: dict[str, Column] | None = None, fanout: int = FANOUT, stride: int = STRIDE) -> DataFrame:
    """(order, group, leaf, subroot, root, proof, folded_root, verified) of every row of docs.

    ``changed`` replaces columns of the rows that are checked against the manifest: folded_root is what their leaves and
    the manifest's siblings give, and verified whether that is the root; without it every row verifies.

    Defined cases: a null column is a mark of its own and differs from an empty text; rows without a group form a group,
    the first; rows without an order value come first in theirs. Rows that repeat an order value are ordered by their
    digest, and equal rows are leaves each. Columns beyond ``columns`` are neither hashed nor needed, whatever their
    names. An empty table gives no rows.
    """
    of = lambda name: F.col("row").getField(name)
    names = {group: F.col("row").getField(group), order: F.col("row").getField(order)}
    rows = packed(docs).select(leaf([of(c) for c in columns]).alias("leaf"), leaf([(changed or {}).get(c, of(c)) for c in columns]).alias("now"), *[c.alias(f"_{n}") for n, c in enumerate(names.values())])
    # digests as bytes, half the size of their texts, until they are needed
    rows = stored(rows.select(F.col("_0").alias("group"), F.col("_1").alias("order"), F.unhex("leaf").alias("leaf"), F.when(F.col("now") != F.col("leaf"), F.unhex("now")).alias("now")), "merkle-leaves")
    text = lambda digest: F.lower(F.hex(digest))
    subroots, ways = tree(rows.select("group", "order", text("leaf").alias("digest"), "now"), "group", ["order", "digest"], ["order", "now"], fanout, stride)
    subroots = stored(subroots.withColumnRenamed("root", "digest"), "merkle-subroots")
    top, above = tree(subroots.select(F.lit(0).alias("all"), "group", "digest"), "all", ["group"], ["group"], fanout, stride)
    upper = above.join(top.withColumnRenamed("all", "_all"), F.col("all") == F.col("_all")).select(F.col("group").alias("_of"), F.col("digest").alias("subroot"), "root", F.col("path").alias("_path"))
    # one row a group; a group of a third of the rows is split, as both sides are plain tables
    upper = stored(upper, "merkle-groups")
    found = ways.join(upper, F.col("group").eqNullSafe(F.col("_of"))).withColumn("path", F.concat("path", "_path"))
    found = found.withColumn("folded_root", folded(F.coalesce(text("now"), "digest"), F.col("path")))
    proof = F.flatten(F.transform("path", lambda x: F.concat(x["left"], x["right"])))
    return found.select(F.col("order").alias(order), F.col("group").alias(group), F.col("digest").alias("leaf"), "subroot", "root", proof.alias("proof"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


def op13_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The manifest of documents by language, checked against rows of which some have n_chars raised by 1; cases as in
    ``manifest``. A null doc_id is not tampered with."""
    docs = dealt(spark.read.parquet(f"{sf_dir}/documents.parquet").select(*COLUMNS))
    row = F.col("row")
    hit = F.coalesce(F.crc32(row["doc_id"].cast("string").cast("binary")) % TAMPERED == 0, F.lit(False))
    out = manifest(docs, changed={"n_chars": row["n_chars"].cast("long") + hit.cast("int")})
    return out.select("doc_id", "leaf", "subroot", "root", hashed(F.col("proof")).alias("proof_sha256"), "folded_root", "verified")


#: CRC-32 of a decimal number: its generator is a fixed value.
CRC_SQL = """
crcs AS (
  SELECT doc_id, xor(list_reduce([4294967295::UBIGINT] || list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ord(c)::UBIGINT),
    lambda acc, byte: list_reduce([xor(acc, byte)] || [0::UBIGINT, 0, 0, 0, 0, 0, 0, 0], lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384::UBIGINT) ELSE c >> 1 END)), 4294967295::UBIGINT) AS crc
  FROM (SELECT DISTINCT doc_id FROM documents)
)"""

OP13_SQL = f"""
WITH RECURSIVE {CRC_SQL}, fields AS (
  SELECT doc_id, lang, n_chars, coalesce(crc % 7 = 0, false) AS hit,
    coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-') AS ahead,
    coalesce(strlen(text) || ':' || text, '-') AS behind
  FROM documents LEFT JOIN crcs USING (doc_id)
), leaves AS (
  SELECT doc_id, lang, sha256(ahead || coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-') || behind) AS leaf,
    sha256(ahead || coalesce(strlen((n_chars + hit::INT)::VARCHAR) || ':' || (n_chars + hit::INT), '-') || behind) AS now
  FROM fields
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS place FROM leaves
), low(level, lang, place, digest) AS (
  SELECT 0, lang, place, leaf FROM placed
  UNION ALL
  SELECT level + 1, lang, place // 2, sha256(string_agg(digest, '' ORDER BY place))
  FROM (SELECT *, count(*) OVER (PARTITION BY lang) AS n FROM low) WHERE n > 1 GROUP BY level, lang, place // 2
), tops AS (
  SELECT lang, max(level) AS height, arg_max(digest, level) AS subroot FROM low GROUP BY lang
), ordered AS (
  SELECT *, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS number FROM tops
), high(level, place, digest) AS (
  SELECT 0, number, subroot FROM ordered
  UNION ALL
  SELECT level + 1, place // 2, sha256(string_agg(digest, '' ORDER BY place))
  FROM (SELECT *, count(*) OVER () AS n FROM high) WHERE n > 1 GROUP BY level, place // 2
), ways(doc_id, leaf, lang, level, place, height, number, subroot, digest, proof) AS (
  SELECT p.doc_id, p.leaf, p.lang, 0, p.place, o.height, o.number, o.subroot, p.now, ''
  FROM placed p JOIN ordered o ON p.lang IS NOT DISTINCT FROM o.lang
  UNION ALL
  SELECT w.doc_id, w.leaf, w.lang, w.level + 1, w.place // 2, w.height, w.number, w.subroot,
    sha256(CASE WHEN w.place % 2 = 1 THEN s.digest || w.digest ELSE w.digest || coalesce(s.digest, '') END), w.proof || coalesce(s.digest, '')
  FROM ways w LEFT JOIN low s ON s.level = w.level AND s.lang IS NOT DISTINCT FROM w.lang AND s.place = xor(w.place, 1)
  WHERE w.level < w.height
), upper(doc_id, leaf, subroot, level, place, digest, proof) AS (
  SELECT doc_id, leaf, subroot, 0, number, digest, proof FROM ways WHERE level = height
  UNION ALL
  SELECT w.doc_id, w.leaf, w.subroot, w.level + 1, w.place // 2,
    sha256(CASE WHEN w.place % 2 = 1 THEN s.digest || w.digest ELSE w.digest || coalesce(s.digest, '') END), w.proof || coalesce(s.digest, '')
  FROM upper w LEFT JOIN high s ON s.level = w.level AND s.place = xor(w.place, 1)
  WHERE w.level < (SELECT max(level) FROM high)
)
SELECT u.doc_id, u.leaf, u.subroot, r.digest AS root, sha256(u.proof) AS proof_sha256, u.digest AS folded_root, u.digest = r.digest AS verified
FROM upper u JOIN (SELECT digest, max(level) OVER () AS top, level FROM high) r ON r.level = r.top
WHERE u.level = r.top
"""
