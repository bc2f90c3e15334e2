"""Shards of bounded size by extendible hashing. DataFrame functions only."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridloom.llm.arrowtext import as_text
from gridloom.runtime import cut, free_name, quoted, release, table

#: Bits of a hash: the first 15 hexadecimal digits of an MD5, which stay below 2^63.
BITS = 60
#: The query's limit: blocks that a loader reads at once.
LIMIT = 1 << 20
#: Cells of the directory (about 60 bytes each in memory) that are broadcast at most.
MOST_BROADCAST = 100_000


def hash_of(key: Column) -> Column:
    return F.conv(F.substring(F.md5(F.coalesce(key.cast("string"), F.lit("")).cast("binary")), 1, 15), 16, 10).cast("bigint")


def prefix(h: Column, depth: int) -> Column:
    return F.shiftright(h, BITS - depth)


def directory(sizes: DataFrame, limit: int) -> list[tuple[int, DataFrame]]:
    """Rounds (bits, cells): cells(cell, depth, shard_bytes, shard_rows) says for each hash prefix of so many bits at
    which depth its bucket stopped splitting; depth is null where it is still too large at that many bits.

    sizes: (h, bytes). A bucket splits on its next bit while it holds more than ``limit`` bytes and more than one
    hash. The first round takes as many bits as buckets of the limit would need, and four more; later rounds look only
    at what is still too large, eight bits further. Sums are made per cell on the executors, then per prefix of cells.
    A bucket is a prefix that fits while the one a bit shorter doesn't, so prefixes meet by distinct keys; cells then
    look for their bucket at the depths that buckets have.
    """
    total = sizes.agg(F.sum("bytes").alias("b")).first()["b"] or 0
    start, stop = 0, min(BITS, max(1, math.ceil(math.log2(max(1.0, total / limit))) + 4))
    active, rounds = sizes, []
    while True:
        cells = cut(active.groupBy(prefix(F.col("h"), stop).alias("cell")).agg(F.sum("bytes").alias("b"), F.count(F.lit(1)).alias("n"), F.min("h").alias("lo"), F.max("h").alias("hi")), "cells")
        nodes = _at_depths(cells, stop, start, stop).groupBy("depth", "p").agg(F.sum("b").alias("shard_bytes"), F.sum("n").alias("shard_rows"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))
        nodes = cut(nodes.withColumn("fits", (F.col("shard_bytes") <= limit) | (F.col("lo") == F.col("hi"))), "nodes")
        large = nodes.where(~F.col("fits")).select((F.col("depth") + 1).alias("depth"), F.col("p").alias("up"))
        fit = nodes.where("fits").select("depth", "p", F.shiftright("p", 1).alias("up"), "shard_bytes", "shard_rows")
        leaves = fit.join(large.hint("merge"), ["depth", "up"], "left_semi")
        if not start:
            leaves = leaves.unionByName(fit.where("depth = 0"))
        leaves = cut(leaves.drop("up"), "leaves")
        span = leaves.agg(F.min("depth").alias("a"), F.max("depth").alias("b")).first()
        if span["a"] is None:
            found = cells.select("cell", *[F.lit(None).cast(t).alias(c) for c, t in (("depth", "int"), ("shard_bytes", "bigint"), ("shard_rows", "bigint"))])
        else:
            found = _at_depths(cells, stop, span["a"], span["b"]).select("cell", "depth", "p").join(leaves.hint("merge"), ["depth", "p"]).select("cell", "depth", "shard_bytes", "shard_rows")
            found = cells.select("cell").join(found.hint("merge"), "cell", "left")
        known = cut(found, "directory")
        release(cells, nodes, leaves)
        rounds.append((stop, known))
        left = known.where(F.col("depth").isNull()).select("cell")
        if stop == BITS or left.isEmpty():
            return rounds
        active = active.join(_side(left), prefix(F.col("h"), stop) == F.col("cell"), "left_semi")
        start, stop = stop, min(BITS, stop + 8)


def _at_depths(cells: DataFrame, bits: int, first: int, last: int) -> DataFrame:
    """Each cell with its prefix ``p`` at every depth from first to last."""
    depth = F.explode(F.sequence(F.lit(first), F.lit(last))).alias("depth")
    return cells.select("*", depth).withColumn("p", F.call_function("shiftright", F.col("cell"), (F.lit(bits) - F.col("depth")).cast("int")))


def _side(cells: DataFrame) -> DataFrame:
    """The directory's side of a join: broadcast up to MOST_BROADCAST cells, which are counted, and sorted beyond."""
    return F.broadcast(cells) if cells.count() <= MOST_BROADCAST else cells.hint("merge")


def assign(docs: DataFrame, limit: int = LIMIT, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, bytes, shard, depth, page, shard_bytes, shard_rows), a row for each of ``docs``.

    shard: the bits of the hash of the key that its bucket is reached by (empty for the root); depth: how many.
    bytes: UTF-8 bytes of the whole text; null and empty texts have none, null keys hash as the empty string. Rows of
    one key share a hash, so they can't be split by bits: where such rows exceed the limit they go to numbered pages
    that fit (page; 0 elsewhere). A text of over half the limit, and one over the limit, has a page of its own; the
    others fill pages to half at least. shard_bytes and shard_rows are those of the bucket, all its pages together. An
    empty table gives no row; other columns may have any name. Only key, hash and size are shuffled, never texts.
    """
    slim = cut(docs.select(quoted(key).alias("k"), hash_of(quoted(key)).alias("h"), F.octet_length(as_text(quoted(text))).cast("bigint").alias("bytes")), "sizes")
    todo, found = slim, None
    for bits, known in directory(slim.select("h", "bytes"), limit):
        hit = todo.join(_side(known), prefix(F.col("h"), bits) == F.col("cell")).drop("cell")
        done = hit.where(F.col("depth").isNotNull())
        found = done if found is None else found.unionByName(done)
        todo = hit.where(F.col("depth").isNull()).select("k", "h", "bytes")
    bits = F.substring(F.lpad(F.bin("h"), BITS, "0"), F.lit(1), F.col("depth"))
    out = found.withColumn("shard", bits)
    over = F.col("shard_bytes") > limit
    return _pages(out.where(over), limit).unionByName(out.where(~over).withColumn("page", F.lit(0).cast("bigint"))).select(F.col("k").alias(key), "bytes", "shard", "depth", "page", "shard_bytes", "shard_rows")


def _pages(rows: DataFrame, limit: int) -> DataFrame:
    """Number pages within buckets of one hash: first a page for each text over half the limit, then pages by running
    sums of the others. Both are counted within each part of the input first, then over the parts."""
    each = cut(rows.withColumns({"part": F.spark_partition_id(), "alone": F.col("bytes") * 2 > limit}), "overflow")
    to_here = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    within = to_here(Window.partitionBy("shard", "part", "alone").orderBy("bytes", "k"))
    parts = each.groupBy("shard", "part", "alone").agg(F.sum("bytes").alias("sum"), F.count(F.lit(1)).alias("count"), F.max("bytes").alias("most"))
    across, side, shard = to_here(Window.partitionBy("shard", "alone").orderBy("part")), Window.partitionBy("shard", "alone"), Window.partitionBy("shard")
    before = lambda c, w: F.coalesce(F.sum(c).over(w), F.lit(0))
    base = parts.select("shard", "part", "alone", before("sum", across).alias("sum"), before("count", across).alias("count"), F.max("most").over(side).alias("most"), F.coalesce(F.sum(F.when(F.col("alone"), F.col("count"))).over(shard), F.lit(0)).alias("first"))
    room = F.lit(limit) - F.col("most") + 1
    packed = F.col("first") + F.floor((F.col("sum") + before("bytes", within)) / room)
    page = F.when(F.col("alone"), F.col("count") + before(F.lit(1), within)).otherwise(packed).cast("bigint")
    return each.join(base.hint("merge"), ["shard", "part", "alone"]).withColumn("page", page).drop("part", "alone", "sum", "count", "most", "first")


def shard(docs: DataFrame, limit: int = LIMIT, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with the columns shard and page, for writing; names that are taken get underscores.

    Rows of a key without pages are found by their key. Where a key has pages, its rows of one size are numbered both
    here and in ``assign``, and each number has one page, so a page gets just the bytes it was given there.
    """
    s, p = free_name(docs, "shard"), free_name(docs, "page")
    k, size, part, no, base, size2, part2, no2 = (free_name(docs, x) for x in ("_k", "_size", "_part", "_no", "_base", "_size2", "_part2", "_no2"))
    place = cut(assign(docs, limit, key, text).select(quoted(key).alias(k), quoted("bytes").alias(size), F.col("shard").alias(s), F.col("page").alias(p)), "places")
    homes = cut(place.groupBy(k).agg(F.first(s).alias(s), F.max(p).alias(p)), "homes")
    out = [quoted(c) for c in [*docs.columns, s, p]]
    plain = docs.join(homes.where(quoted(p) == 0), quoted(key).eqNullSafe(quoted(k))).select(*out)
    paged = homes.where(quoted(p) > 0).select(quoted(k).alias(base))

    to = Window.partitionBy(k, size).orderBy(p)
    spots = place.join(paged, quoted(k).eqNullSafe(quoted(base)), "left_semi").groupBy(k, size, s, p).agg(F.count(F.lit(1)).alias("n")).withColumn("end", F.sum("n").over(to))
    spots = spots.select(k, size, s, p, F.explode(F.sequence(F.col("end") - F.col("n") + 1, F.col("end"))).alias(no))

    sized = docs.join(paged, quoted(key).eqNullSafe(quoted(base)), "left_semi").withColumn(size, F.octet_length(as_text(quoted(text))).cast("bigint"))
    rows = cut(sized.withColumn(part, F.spark_partition_id()), "paged")
    before = Window.partitionBy(k, size).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    parts = rows.groupBy(quoted(key).alias(k), size, part).agg(F.count(F.lit(1)).alias("n")).select(k, size, part, F.coalesce(F.sum("n").over(before), F.lit(0)).alias(base))
    within = F.row_number().over(Window.partitionBy(quoted(key), size, part).orderBy(size))
    numbered = rows.withColumn(no, within).join(parts.withColumnsRenamed({size: size2, part: part2}), quoted(key).eqNullSafe(quoted(k)) & (quoted(size) == quoted(size2)) & (quoted(part) == quoted(part2)))
    numbered = numbered.select(*[quoted(c) for c in docs.columns], quoted(size).alias(size2), (quoted(no) + quoted(base)).alias(no2))
    spread = numbered.join(spots, quoted(key).eqNullSafe(quoted(k)) & (quoted(size2) == quoted(size)) & (quoted(no2) == quoted(no))).select(*out)
    return plain.unionByName(spread)


def write(docs: DataFrame, folder: str, limit: int = LIMIT, key: str = "doc_id", text: str = "text") -> None:
    """One directory a shard under ``folder``; a shard fits one task, as its bytes are bounded."""
    placed = shard(docs, limit, key, text)
    s, p = placed.columns[-2:]
    placed.withColumn(s, F.concat(F.lit("b"), quoted(s))).repartition(s, p).write.partitionBy(s, p).parquet(folder)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assign(table(spark, sf_dir, "documents")).select("doc_id", F.col("bytes").alias("n_bytes"), "shard", F.col("depth").cast("long").alias("depth"), "page", "shard_bytes", "shard_rows")


SQL = f"""
WITH docs AS (SELECT doc_id, CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15) AS BIGINT) AS h, CAST(octet_length(encode(coalesce(text, ''))) AS BIGINT) AS n_bytes FROM documents),
depths AS (SELECT CAST(range AS BIGINT) AS depth FROM range(0, {BITS + 1})),
placed AS (SELECT doc_id, h, n_bytes, depth, h // CAST(power(2, {BITS} - depth) AS BIGINT) AS p FROM docs CROSS JOIN depths),
nodes AS (SELECT depth, p, CAST(sum(n_bytes) AS BIGINT) AS shard_bytes, CAST(count(*) AS BIGINT) AS shard_rows, min(h) AS lo, max(h) AS hi FROM placed GROUP BY depth, p),
leaves AS (SELECT placed.doc_id, placed.n_bytes, placed.h, placed.depth, shard_bytes, shard_rows, row_number() OVER (PARTITION BY placed.doc_id ORDER BY placed.depth) AS k
           FROM placed JOIN nodes ON placed.depth = nodes.depth AND placed.p = nodes.p WHERE shard_bytes <= {LIMIT} OR lo = hi)
SELECT doc_id, n_bytes, substr(lpad(bin(h), {BITS}, '0'), 1, CAST(depth AS INTEGER)) AS shard, depth, CAST(0 AS BIGINT) AS page, shard_bytes, shard_rows FROM leaves WHERE k = 1
"""
