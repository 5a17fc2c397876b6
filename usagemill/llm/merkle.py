"""A Merkle manifest of documents: a tree for each source, a tree over the sources, and a proof for each document.

1. A leaf is the SHA-256 of a document's fields, each with its length. Texts are hashed where they are read and never
   shuffled.
2. Bitmaps that count (``rank_bitmaps.py``) say at which place of its source a leaf stands; no table is sorted by id.
3. Leaves meet in blocks of 3^6 neighbours, an array of slots each. A block reduces six levels at once, so a tree of N
   leaves takes log(N) / log(729) shuffles of ever fewer rows; a source of any size is dealt over its blocks.
4. From the root down each block hands the siblings above it to the nodes below it: a path is written once for a
   block, not once for a leaf.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from usagemill.llm.rank_bitmaps import containers, ranked
from usagemill.llm.tables import checkpointed, kept_table
from usagemill.operators.batches import number_batches

FAN = 3
LEVELS = 6
BLOCK = FAN**LEVELS
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
# Rows that share an id are told apart by their leaf, in buckets by the first letters of it.
_BUCKET_LETTERS = 3
_COPIES = 4096
_PATH = "array<struct<slot:int,siblings:array<string>>>"


def field(value: Column) -> Column:
    """``-`` for a null, else the length in bytes, a colon and the value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_digest(**changed: Column) -> Column:
    """The leaf of a row of documents in hex, with some of its fields changed."""
    return F.sha2(F.concat(*[field(changed.get(name, F.col(name))) for name in FIELDS]).cast("binary"), 256)


def _powers() -> Column:
    """1, 3, 9 and so on; a long holds no more than 3^39."""
    return F.array(*[F.lit(FAN**k).cast("bigint") for k in range(40)])


def levels_above(n: Column) -> Column:
    """How often ``n`` nodes are reduced until one is left."""
    return F.size(F.filter(_powers(), lambda power: power < n))


def _reduced(nodes: Column) -> Column:
    """The parents of an array of neighbours; the last one may have fewer children."""
    starts = F.sequence(F.lit(0), F.floor((F.size(nodes) - 1) / FAN).cast("int"))
    return F.transform(starts, lambda i: F.sha2(F.array_join(F.slice(nodes, i * FAN + 1, FAN), "").cast("binary"), 256))


def _blocks(nodes: DataFrame) -> DataFrame:
    """``tree, block, size, slots, levels`` of nodes ``tree, place, size, digest, item``."""
    slots = F.array_sort(F.collect_list(F.struct("place", "digest", "item")))
    block = F.expr(f"place div {BLOCK}").alias("block")
    found = nodes.groupBy("tree", block, "size").agg(slots.alias("slots"))
    steps = F.least(levels_above(F.col("size")), F.lit(LEVELS))
    counts = F.filter(F.sequence(F.lit(0), F.lit(LEVELS)), lambda k: (k > 0) & (k <= steps))
    own = F.array(F.transform("slots", lambda slot: slot["digest"]))
    levels = F.aggregate(counts, own, lambda done, _: F.concat(done, F.array(_reduced(F.element_at(done, -1)))))
    return found.select("tree", "block", "size", "slots", levels.alias("levels"))


def _siblings(levels: Column, place: Column) -> Column:
    """The way of a slot up through its block: at each level its slot and the others of its run."""

    def one(level: Column, k: Column) -> Column:
        at = F.floor(place / F.element_at(_powers(), k + 1)).cast("int")
        slot = F.pmod(at, F.lit(FAN))
        first = at - slot + 1
        others = F.concat(F.slice(level, first, slot), F.slice(level, first + slot + 1, FAN - 1 - slot))
        return F.struct(slot.alias("slot"), others.alias("siblings"))

    return F.transform(F.slice(levels, 1, F.size(levels) - 1), one)


def _climb(nodes: DataFrame) -> list[DataFrame]:
    """The blocks of all trees, from the leaves up to the roots."""
    tables = []
    while True:
        blocks = kept_table(_blocks(nodes), "merkle")
        tables.append(blocks)
        if (blocks.agg(F.max("size")).first()[0] or 0) <= BLOCK:
            return tables
        size = F.ceil(F.col("size") / BLOCK).cast("bigint").alias("size")
        top = F.element_at(F.element_at("levels", -1), 1).alias("digest")
        nodes = blocks.select("tree", F.col("block").alias("place"), size, top, F.lit(None).cast("int").alias("item"))


def _tops(blocks: DataFrame) -> DataFrame:
    """``tree, block, top`` of the last table: one block for each tree."""
    return blocks.select("tree", "block", F.element_at(F.element_at("levels", -1), 1).alias("top"))


def _descend(tables: list[DataFrame], above: DataFrame) -> DataFrame:
    """Leaves ``tree, place, digest, item, top, root, path``; ``above`` has ``tree, block, top, root, path``."""
    for blocks in reversed(tables):
        met = blocks.join(above, ["tree", "block"])
        path = lambda i: F.concat(_siblings(F.col("levels"), i), F.col("path"))
        each = F.transform("slots", lambda slot, i: F.struct(slot["place"].alias("place"), slot["digest"].alias("digest"), slot["item"].alias("item"), path(i).alias("path")))
        leaves = met.select("tree", "top", "root", F.explode(each).alias("leaf")).select("tree", "top", "root", "leaf.*")
        above = leaves.select("tree", F.col("place").alias("block"), "top", "root", "path")
    return leaves


def folded(leaf: Column, path: Column) -> Column:
    """The root that a leaf and a path lead to."""

    def up(node: Column, level: Column) -> Column:
        run = F.concat(F.slice(level["siblings"], 1, level["slot"]), F.array(node), F.slice(level["siblings"], level["slot"] + 1, FAN))
        return F.sha2(F.array_join(run, "").cast("binary"), 256)

    return F.aggregate(path, leaf, up)


def _tied(rows: DataFrame) -> DataFrame:
    """Rows of one group and id, numbered by their leaf: in buckets of it, equal rows as one with a count."""
    key = ["number", "id"]
    has_id = F.when(F.col("doc_id").isNull(), "0").otherwise("1")
    bucket = F.concat(has_id, F.substring("leaf", 1, _BUCKET_LETTERS)).alias("bucket")
    kinds = checkpointed(rows.groupBy(*key, "rank", "size", "doc_id", "leaf", "changed").agg(F.count(F.lit(1)).alias("n")).select("*", bucket))
    sums = kinds.groupBy(*key, "bucket").agg(F.sum("n").alias("n"))
    ahead = Window.partitionBy(*key).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(*key, "bucket", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("of_bucket"))
    inner = Window.partitionBy(*key, "bucket").orderBy("leaf", "changed")
    inside = F.coalesce(F.sum("n").over(inner.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = kinds.withColumn("of_leaf", inside).join(sums, [*key, "bucket"])
    # A row that repeats very often is dealt out in runs of copies.
    runs = placed.withColumn("copy", F.explode(F.sequence(F.lit(0), F.col("n") - 1, F.lit(_COPIES)))).repartition(*key, "leaf", "copy")
    last = F.least(F.col("copy") + _COPIES, F.col("n")) - 1
    copies = runs.withColumn("copy", F.explode(F.sequence(F.col("copy"), last)))
    return copies.withColumn("rank", F.col("rank") + F.col("of_bucket") + F.col("of_leaf") + F.col("copy"))


def manifest(docs: DataFrame, changed_text: Column | None = None) -> DataFrame:
    """``doc_id, leaf, changed, subroot, root, path`` of every row of ``docs``.

    A leaf is the digest of ``doc_id, source, lang, n_chars, text``. The leaves of a source stand by doc_id, null first,
    rows of one doc_id by their leaf; every three neighbours become the digest of their hex digests, until one is
    left, the ``subroot``. Subroots, by source in UTF-8 order, null first, become the ``root`` likewise. ``path`` has, from
    the leaf up to the root, the leaf's ``slot`` among its run and the ``siblings`` of that run. ``changed`` is the leaf
    that the row would have with ``changed_text`` instead of its text (null: the same).

    Rows that repeat are leaves of their own. A text of any length is hashed as it is read; other columns of ``docs``
    may have any name. An empty table gives no row.
    """
    other = F.lit(None).cast("string") if changed_text is None else leaf_digest(text=changed_text)
    leaf = leaf_digest()
    own = docs.select(*FIELDS).select(
        F.coalesce(F.concat(F.lit("s"), F.col("source").cast("string")), F.lit("n")).alias("grp"),
        F.coalesce(F.col("doc_id").cast("bigint"), F.lit(-(1 << 63)).cast("bigint")).alias("id"),
        F.col("doc_id"),
        leaf.alias("leaf"),
        F.coalesce(other, leaf).alias("changed"),
    )
    rows = kept_table(own, "leaves")
    found = checkpointed(containers(rows))
    sizes = found.groupBy("grp").agg(F.sum("n").alias("size"))
    numbered = number_batches(sizes, ["grp"], 1)
    groups = numbered.select("grp", F.col("position").alias("number"), "size")
    met = kept_table(ranked(rows, found, groups), "places")
    names = ["number", "rank", "size", "doc_id", "leaf", "changed"]
    placed = met.filter("same = 1").select(*names).unionByName(_tied(met.filter("same > 1").drop("same")).select(*names))
    item = F.struct("doc_id", "changed").alias("item")
    nodes = placed.select(F.col("number").alias("tree"), F.col("rank").alias("place"), "size", F.col("leaf").alias("digest"), item)
    trees = _climb(nodes)
    subroots = checkpointed(_tops(trees[-1]))

    trunk = subroots.select(
        F.lit(0).cast("bigint").alias("tree"),
        F.col("tree").alias("place"),
        F.lit(subroots.count()).cast("bigint").alias("size"),
        F.col("top").alias("digest"),
        F.lit(None).cast("int").alias("item"),
    )
    stems = _climb(trunk)
    start = _tops(stems[-1]).select("tree", "block", "top", F.col("top").alias("root"), F.array().cast(_PATH).alias("path"))
    roots = _descend(stems, start).select(F.col("place").alias("tree"), "root", "path")
    above = subroots.join(roots, "tree").select("tree", "block", "top", "root", "path")
    return _descend(trees, above).select("item.doc_id", F.col("digest").alias("leaf"), "item.changed", F.col("top").alias("subroot"), "root", "path")


def manifest_report(docs: DataFrame) -> DataFrame:
    """``doc_id, leaf, subroot, root, proof_sha256, folded_root, verified`` of every row.

    Rows whose doc_id has an even CRC-32 (as decimal text) are folded from the leaf of their text without line feeds;
    rows without a doc_id keep theirs.
    """
    struck = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0, F.lit(False))
    found = manifest(docs, F.when(struck, F.replace(F.col("text").cast("string"), F.lit("\n"), F.lit(""))).otherwise(F.col("text").cast("string")))
    siblings = F.flatten(F.transform("path", lambda level: level["siblings"]))
    out = found.select(
        "doc_id", "leaf", "subroot", "root",
        F.sha2(F.array_join(siblings, "").cast("binary"), 256).alias("proof_sha256"),
        folded(F.col("changed"), F.col("path")).alias("folded_root"),
    )
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))
