"""SimHash near-duplicates by tiled exact comparison of fingerprints, verified by sets of shingles for deduplication."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridloom.graph.components import components
from gridloom.llm.arrowtext import as_text, give_back, map_rows
from gridloom.runtime import cut, free_name, quoted, release, table

_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_BITS = ((np.arange(256)[:, None] >> np.arange(8)[None, :]) & 1).astype(np.float64)
_OFFSETS = (np.arange(8) * 256)[None, :]
#: Fingerprints are laid out in tiles of at least this many and at most so many rows; see ``links``.
LEAST_TILE, MOST_TILE = 16_384, 131_072
#: Keys that ``deduplicate`` broadcasts at most.
MOST_BROADCAST = 500_000
#: 64-bit lanes of the fingerprints by which ``proposals`` finds pairs. Two sets of shingles with 0.8 in common differ in
#: a share of 0.1875 of the bits at most (4 against 5 shingles; 0.151 for large sets), so the limits for two lanes and
#: for all lie five deviations above the mean: 24 + 5 * 4.42 of 128 bits and 144 + 5 * 10.8 of 768.
PROPOSING_LANES, PROPOSE_TWO, PROPOSE_ALL = 12, 46, 198
#: Rows of candidate clusters that one task of ``alike`` verifies, about.
VERIFIED_ROWS = 2_000
#: Comparisons of one numpy step: rows of one side by rows of the other.
STEP = (64, 2_048)


def shingle_hashes(text: str, width: int) -> np.ndarray:
    """XXH64 (seed 42, UTF-8) of each run of ``width`` words, repeats included; of all words where there are fewer."""
    words = text.encode("utf-8", "replace").translate(_LOWER).split()
    if not words:
        return np.empty(0, np.uint64)
    joined, n = b" ".join(words), len(words)
    if n <= width:
        return np.array([xxhash.xxh64_intdigest(joined, 42)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, n) + 1) - 1
    starts = np.concatenate([[0], ends[: n - width] + 1])
    digest = xxhash.xxh64_intdigest
    return np.array([digest(joined[s:e], 42) for s, e in zip(starts.tolist(), ends[width - 1 :].tolist())], np.uint64)


def _mixed(h: np.ndarray, lane: int) -> np.ndarray:
    """Another 64 bits for each hash; lane 0 is the hash itself."""
    if not lane:
        return h
    x = h + np.uint64((lane * 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def fingerprint(text: str, width: int, lanes: int = 1, distinct: bool = False) -> bytes:
    """``lanes`` times 8 bytes, big-endian; a bit is 1 if it is set in over half the hashes. No word: all zero.

    distinct: each shingle counts once, so that a line repeated over and over doesn't make the fingerprint.
    """
    h = shingle_hashes(text, width)
    return _majority(np.unique(h) if distinct else h, lanes)


def _majority(h: np.ndarray, lanes: int) -> bytes:
    n = len(h)
    if not n:
        return bytes(8 * lanes)
    out = np.empty(lanes, ">u8")
    for lane in range(lanes):
        counts = np.zeros((8, 256))
        for at in range(0, n, 65_536):
            octets = _mixed(h[at : at + 65_536], lane).astype("<u8").view(np.uint8).reshape(-1, 8)
            counts += np.bincount((octets + _OFFSETS).ravel(), minlength=2048).reshape(8, 256)
        ones = (counts @ _BITS).ravel() * 2 > n
        out[lane] = np.packbits(ones, bitorder="little").view("<u8")[0]
    return out.tobytes()


def fingerprints(docs: DataFrame, width: int, lanes: int = 1, key: str = "doc_id", text: str = "text", distinct: bool = False) -> DataFrame:
    """(k, fp binary) of each row; one pass without a shuffle."""

    def work():
        return lambda columns: [columns[0], [fingerprint(t, width, lanes, distinct) for t in columns[1]]]

    slim = docs.select(quoted(key).alias("k"), as_text(quoted(text)).alias("t"))
    return map_rows(slim, {"k": "k", "t": "t"}, f"k {docs.schema[key].dataType.simpleString()}, fp binary", work)


def forest(home: np.ndarray, guests: np.ndarray, radius: int, wide_radius: int | None) -> np.ndarray:
    """A spanning forest of the links between the rows of two arrays of fingerprints (n x lanes): pairs (row, root).

    Rows are numbered home first, then guests. Every pair is compared: exclusive-or and bit count of the first lane,
    then of all lanes for those within ``radius``. Only the forest is kept, so a group of many copies gives as many
    pairs as it has rows.
    """
    n = len(home)
    root = np.arange(n + len(guests))
    a, b = np.ascontiguousarray(home[:, 0]), np.ascontiguousarray(guests[:, 0])

    def top(x: np.ndarray) -> np.ndarray:
        r = root[x]
        while True:
            s = root[r]
            if (s == r).all():
                return r
            r = s

    for i in range(0, len(b), STEP[0]):
        rows = b[i : i + STEP[0], None]
        for j in range(0, n, STEP[1]):
            near = np.bitwise_count(rows ^ a[None, j : j + STEP[1]]) <= radius
            if not near.any():
                continue
            g, h = np.nonzero(near)
            g, h = g + i, h + j
            if wide_radius is not None:
                far = np.zeros(len(g), np.int64)
                for lane in range(home.shape[1]):
                    far += np.bitwise_count(guests[g, lane] ^ home[h, lane])
                g, h = g[far <= wide_radius], h[far <= wide_radius]
            x, y = top(g + n), top(h)
            while (left := x != y).any():
                x, y = x[left], y[left]
                root[np.maximum(x, y)] = np.minimum(x, y)
                x, y = top(x), top(y)
    r = top(np.arange(len(root)))
    moved = np.flatnonzero(r != np.arange(len(root)))
    return np.stack([moved, r[moved]])


def _sent(laid: DataFrame, radius: int, name: str, more: list[str]) -> DataFrame:
    """Rows (p, q, name, more) sent to the tiles of their own cell and to the blocks of all cells within ``radius``."""
    spark = laid.sparkSession
    cells = {(r["p"], r["q"]): r["n"] for r in laid.groupBy("p", "q").agg(F.count(F.lit(1)).alias("n")).collect()}
    tile = min(MOST_TILE, max(LEAST_TILE, sum(cells.values()) // 64))
    plan = []
    for home, n in cells.items():
        reach = [c for c in cells if c <= home and abs(c[0] - home[0]) + abs(c[1] - home[1]) <= radius]
        tiles, blocks = -(-n // tile), -(-sum(cells[c] for c in reach) // (4 * tile))
        plan += [(*c, *home, tiles, blocks, False) for c in reach] + [(*home, *home, tiles, blocks, True)]
    routes = spark.createDataFrame(plan, "p int, q int, hp int, hq int, tiles int, blocks int, own boolean")
    salt = F.xxhash64(name)
    return (
        laid.join(F.broadcast(routes), ["p", "q"])
        .withColumn("fixed", F.when(F.col("own"), F.pmod(salt, F.col("tiles"))).otherwise(F.pmod(F.xxhash64(name, F.lit(1)), F.col("blocks"))).cast("int"))
        .withColumn("free", F.explode(F.sequence(F.lit(0), F.when(F.col("own"), F.col("blocks")).otherwise(F.col("tiles")) - 1)))
        .select("hp", "hq", F.when(F.col("own"), F.col("fixed")).otherwise(F.col("free")).alias("tile"), F.when(F.col("own"), F.col("free")).otherwise(F.col("fixed")).alias("block"), "own", name, *more)
    )


def links(fps: DataFrame, radius: int, lanes: int = 1, wide_radius: int | None = None) -> DataFrame:
    """(u, v): enough links between distinct fingerprints for their components.

    fps: one row a distinct fingerprint, in column fp. Fingerprints are laid out in cells by population count: of both
    halves of the first lane for a small radius, of the whole lane for a large one. Two within the radius lie in cells
    whose counts differ by the radius at most, so pairs of other cells are skipped; all pairs of the rest are compared.
    A cell is cut into tiles, and what comes to it from its neighbours into blocks of four tiles, by hash; each tile
    meets each block once. Tiles grow with the number of rows from LEAST_TILE to MOST_TILE, so up to 10^7 rows each
    row is sent about as often at every size; beyond, tasks stay as they are and grow in number. The table of cells has at most 33 x 33 rows at any size of the input:
    that alone comes to the driver, and what is broadcast has at most that many rows times the cells in reach.
    """
    first = F.conv(F.substring(F.hex("fp"), 1, 16), 16, -10).cast("long")
    whole = F.bit_count(first)
    if radius <= 6:
        p, q = F.bit_count(F.shiftrightunsigned(first, 32)), F.bit_count(first.bitwiseAND(0xFFFFFFFF))
    else:
        p, q = whole, F.lit(0)
    laid = fps.select("fp", p.cast("int").alias("p"), q.cast("int").alias("q"))
    sent = _sent(laid, radius, "fp", [])

    def compare(group: pa.Table) -> pa.Table:
        raw = group.column("fp").combine_chunks()
        values = np.frombuffer(b"".join(raw.to_pylist()), ">u8").astype(np.uint64).reshape(-1, lanes)
        own = group.column("own").to_numpy()
        order = np.concatenate([np.flatnonzero(own), np.flatnonzero(~own)])
        k = int(own.sum())
        pairs = forest(values[order[:k]], values[order[k:]], radius, wide_radius) if 0 < k < len(order) else np.empty((2, 0), int)
        names = values[order].astype(">u8")
        u, v = ([names[i].tobytes() for i in side] for side in pairs)
        keep = [(x, y) for x, y in zip(u, v) if x != y]
        return pa.table({"u": pa.array([x for x, _ in keep], pa.binary()), "v": pa.array([y for _, y in keep], pa.binary())})

    return sent.groupBy("hp", "hq", "tile", "block").applyInArrow(compare, "u binary, v binary")


def classes(docs: DataFrame, width: int = 4, radius: int = 4, lanes: int = 1, wide_radius: int | None = None, key: str = "doc_id", text: str = "text", distinct: bool = False) -> DataFrame:
    """(key, fp binary, component_id) for each row of ``docs``.

    Words are what lies between spaces, tabs and line breaks once A-Z are lower-cased; shingles are ``width`` words.
    Rows whose fingerprints differ in at most ``radius`` bits (with more lanes: and in at most ``wide_radius`` bits of
    all lanes) are linked, and component_id is the smallest key reachable. Null and wordless texts have the zero
    fingerprint, linked like any other. Rows with equal keys each give a row; null keys give rows, but are no
    component_id unless all of a component are null. An empty table gives no row. Texts are read whole, however long;
    columns other than key and text may have any name. Equal fingerprints are one row from the first aggregate on, so
    copies cost nothing more; no text is shuffled.
    """
    each = cut(fingerprints(docs, width, lanes, key, text, distinct), "fingerprints")
    distinct = cut(each.groupBy("fp").agg(F.min("k").alias("least")), "distinct")
    roots = components(links(distinct.select("fp"), radius, lanes, wide_radius))
    named = distinct.join(roots, distinct["fp"] == roots["node"], "left").select("fp", "least", F.coalesce("component", "fp").alias("root"))
    named = cut(named, "roots")
    least = named.groupBy("root").agg(F.min("least").alias("component_id"))
    known = named.join(least, "root").select("fp", "component_id")
    out = each.join(known, "fp").select(F.col("k").alias(key), "fp", "component_id")
    release(distinct)
    return out


def outlines(docs: DataFrame, width: int, key: str, text: str) -> DataFrame:
    """(k, sid, n, fp) of each row: a 128-bit digest of its set of shingles, their number and their fingerprint."""

    def work():
        def step(columns):
            sets = [np.unique(shingle_hashes(t, width)) for t in columns[1]]
            return [columns[0], [_sid(h) for h in sets], [len(h) for h in sets], [_majority(h, PROPOSING_LANES) for h in sets]]

        return step

    slim = docs.select(quoted(key).alias("k"), as_text(quoted(text)).alias("t"))
    return map_rows(slim, {"k": "k", "t": "t"}, f"k {docs.schema[key].dataType.simpleString()}, sid binary, n int, fp binary", work)


def _sid(h: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(h.astype("<u8").tobytes())


def near(home: np.ndarray, guests: np.ndarray, m: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Clusters of the rows of two arrays of fingerprints (home first, numbered on) that may be alike in 0.8.

    m, n: shingles of each row, both ascending. Pairs whose numbers rule 0.8 out are skipped, the others compared by two
    lanes and then by all. Gives the rows that have a partner, and the least row of the cluster of each.
    """
    k = len(home)
    root = np.arange(k + len(guests))

    def top(x: np.ndarray) -> np.ndarray:
        r = root[x]
        while True:
            s = root[r]
            if (s == r).all():
                return r
            r = s

    a, b = np.ascontiguousarray(home.T), np.ascontiguousarray(guests.T)
    for i in range(0, len(guests), STEP[0]):
        at = slice(i, i + STEP[0])
        first, last = np.searchsorted(m, -(-4 * n[at][0] // 5)), np.searchsorted(m, 5 * n[at][-1] // 4, "right")
        for j in range(first, last, STEP[1]):
            to = slice(j, min(j + STEP[1], last))
            close = np.bitwise_count(b[0, at, None] ^ a[0, None, to]) + np.bitwise_count(b[1, at, None] ^ a[1, None, to]) <= PROPOSE_TWO
            if not close.any():
                continue
            g, h = np.nonzero(close)
            g, h = g + i, h + j
            fit = (5 * n[g] >= 4 * m[h]) & (5 * m[h] >= 4 * n[g])
            g, h = g[fit], h[fit]
            far = np.zeros(len(g), np.int64)
            for lane in range(len(a)):
                far += np.bitwise_count(b[lane, g] ^ a[lane, h])
            g, h = g[far <= PROPOSE_ALL], h[far <= PROPOSE_ALL]
            x, y = top(g + k), top(h)
            while (left := x != y).any():
                x, y = x[left], y[left]
                root[np.maximum(x, y)] = np.minimum(x, y)
                x, y = top(x), top(y)
    r = top(np.arange(len(root)))
    rows = np.flatnonzero(np.bincount(r, minlength=len(r))[r] > 1)
    return rows, r[rows]


def proposals(sets: DataFrame) -> DataFrame:
    """(cluster, sid): clusters within which all pairs of sets alike in 0.8 lie, but for chance (see PROPOSE_ALL).

    sets: one row a distinct set, (sid, n, fp). Cells are of sets of about the same number of shingles, and only
    neighbouring cells meet, as 0.8 leaves no others; tiles and blocks are as in ``links``. A set that is in no cluster
    has no partner; one may be in a cluster of each tile and block it is sent to.
    """
    laid = sets.where("n > 0").select("sid", "n", "fp", F.floor(F.log(F.col("n")) / math.log(1.26)).cast("int").alias("p"), F.lit(0).alias("q"))
    sent = _sent(laid, 1, "sid", ["n", "fp"])

    def compare(group: pa.Table) -> pa.Table:
        own, n = group.column("own").to_numpy(), group.column("n").to_numpy().astype(np.int64)
        order = np.lexsort((n, ~own))
        k = int(own.sum())
        sids = group.column("sid").combine_chunks().take(pa.array(order))
        values = np.frombuffer(b"".join(group.column("fp").to_pylist()), ">u8").astype(np.uint64).reshape(-1, PROPOSING_LANES)[order]
        n = n[order]
        rows, least = near(values[:k], values[k:], n[:k], n[k:]) if 0 < k < len(order) else (np.empty(0, int), np.empty(0, int))
        place = "/".join(str(group.column(c)[0]) for c in ("hp", "tile", "block")) if len(order) else ""
        seen = {(r, s) for r, s in zip(least.tolist(), sids.take(pa.array(rows)).to_pylist())}
        sizes: dict[int, int] = {}
        for r, _ in seen:
            sizes[r] = sizes.get(r, 0) + 1
        kept = [(f"{place}/{r}", s) for r, s in seen if sizes[r] > 1]
        give_back()
        return pa.table({"cluster": pa.array([c for c, _ in kept], pa.string()), "sid": pa.array([s for _, s in kept], pa.binary())})

    return sent.groupBy("hp", "hq", "tile", "block").applyInArrow(compare, "cluster string, sid binary")


def alike_pairs(sets: list[np.ndarray]) -> list[tuple[int, int]]:
    """A spanning forest of the pairs of sets whose intersection is 0.8 of their union or more; every pair is counted."""
    order = sorted(range(len(sets)), key=lambda i: len(sets[i]))
    sizes = np.array([len(sets[i]) for i in order])
    names = np.unique(np.concatenate([sets[i] for i in order]), return_inverse=True)[1]
    starts = np.concatenate([[0], np.cumsum(sizes)])
    mark = np.zeros(len(names), np.int64)
    root = np.arange(len(order))
    out = []
    for i in range(len(order) - 1):
        last = np.searchsorted(sizes, 5 * sizes[i] // 4, "right")
        if last <= i + 1:
            continue
        mark[names[starts[i] : starts[i + 1]]] = 1
        both = np.add.reduceat(mark[names[starts[i + 1] : starts[last]]], starts[i + 1 : last] - starts[i + 1])
        mark[names[starts[i] : starts[i + 1]]] = 0
        for j in (np.flatnonzero(5 * both >= 4 * (sizes[i] + sizes[i + 1 : last] - both)) + i + 1).tolist():
            if root[i] != root[j]:
                out.append((order[i], order[j]))
                root[root == root[j]] = root[i]
    return out


def alike(docs: DataFrame, width: int = 5, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, sid binary, root binary, component_id) for each row: rows are linked where the sets of their shingles of ``width`` words
    have an intersection of 0.8 of the union or more, component_id is the smallest key reachable,
    root the same for all rows of a class and no others.

    Fingerprints propose clusters, and the sets themselves decide. Texts of equal sets (sid) are one row from the first
    aggregate on; only those of clusters are read again, one a set, and cut into shingles for the decision. Nulls, equal
    keys and empty tables are as in ``classes``.
    """
    each = cut(outlines(docs, width, key, text), "outlines")
    distinct = cut(each.groupBy("sid").agg(F.min("k").alias("least"), F.first("n").alias("n"), F.first("fp").alias("fp")), "sets")
    clusters = cut(proposals(distinct.select("sid", "n", "fp")), "clusters")
    mine = free_name(docs, "_k")
    wanted = distinct.join(clusters.select("sid").distinct(), "sid", "left_semi").select(F.col("least").alias(mine)).distinct()
    if wanted.count() <= MOST_BROADCAST:
        wanted = F.broadcast(wanted)
    read = docs.join(wanted, quoted(key).eqNullSafe(quoted(mine)), "left_semi").select(as_text(quoted(text)).alias("t"))

    def shingles():
        def step(columns):
            sets = [np.unique(shingle_hashes(t, width)) for t in columns[0]]
            return [[_sid(h) for h in sets], [h.astype("<u8").tobytes() for h in sets]]

        return step

    sets = map_rows(read, {"t": "t"}, "sid binary, shingles binary", shingles).dropDuplicates(["sid"])
    deals = max(1, -(-clusters.count() // VERIFIED_ROWS))
    dealt = clusters.join(sets, "sid").withColumn("deal", F.pmod(F.xxhash64("cluster"), F.lit(deals)))

    def verify(group: pa.Table) -> pa.Table:
        found: dict[str, list[int]] = {}
        for i, c in enumerate(group.column("cluster").to_pylist()):
            found.setdefault(c, []).append(i)
        sids, raw = group.column("sid").to_pylist(), group.column("shingles")
        u, v = [], []
        for rows in found.values():
            for i, j in alike_pairs([np.frombuffer(raw[r].as_buffer(), "<u8") for r in rows]):
                u.append(sids[rows[i]])
                v.append(sids[rows[j]])
        give_back()
        return pa.table({"u": pa.array(u, pa.binary()), "v": pa.array(v, pa.binary())})

    roots = components(dealt.groupBy("deal").applyInArrow(verify, "u binary, v binary"))
    named = cut(distinct.join(roots, distinct["sid"] == roots["node"], "left").select("sid", "least", F.coalesce("component", "sid").alias("root")), "roots")
    known = named.join(named.groupBy("root").agg(F.min("least").alias("component_id")), "root").select("sid", "root", "component_id")
    release(distinct, clusters)
    return each.join(known, "sid").select(F.col("k").alias(key), "sid", "root", "component_id")


def deduplicate(docs: DataFrame, width: int = 5, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` whose key is the component_id of their class, all columns as they were.

    Classes are those of ``alike``: texts whose sets of five-word shingles are alike in 0.8 or more are linked.
    One row stays of each class, of its least
    key, and of rows of that key in the class the one whose text hashes least. Rows of one key that are of different
    classes are decided each by its own. Rows with a null key stay. The keys of which no row stays are broadcast up to
    MOST_BROADCAST of them, and joined beyond, which shuffles the texts once.
    """
    from pyspark.sql.pandas.functions import pandas_udf

    k, k2, sid, sid2, root, rank = (free_name(docs, x) for x in ("_k", "_k2", "_sid", "_sid2", "_root", "_rank"))
    found = cut(alike(docs, width, key, text).where(quoted(key).isNotNull()).select(quoted(key).alias(k), "sid", "root", (quoted(key) == F.col("component_id")).alias("stands")), "alike")
    keys = cut(found.groupBy(k).agg(F.count(F.lit(1)).alias("n"), F.max("stands").alias("stays")), "keys")
    gone, again = keys.where(~F.col("stays")).select(k), keys.where(F.col("stays") & (F.col("n") > 1)).select(k)
    if gone.count() <= MOST_BROADCAST:
        gone = F.broadcast(gone)
    kept = docs.join(gone, quoted(key) == quoted(k), "left_anti")
    if again.isEmpty():
        return kept

    @pandas_udf("binary")
    def sid_of(column):
        return column.map(lambda t: _sid(np.unique(shingle_hashes(t, width))))

    standing = found.where("stands").select(quoted(k).alias(k2), F.col("sid").alias(sid2), F.col("root").alias(root)).distinct()
    once = kept.join(again, quoted(key) == quoted(k), "left_semi").withColumn(sid, sid_of(as_text(quoted(text))))
    once = once.join(standing, (quoted(key) == quoted(k2)) & (quoted(sid) == quoted(sid2)))
    order = Window.partitionBy(k2, root).orderBy(F.xxhash64(quoted(text)), *[quoted(c) for c, t in docs.dtypes if not t.startswith("map")])
    first = once.withColumn(rank, F.row_number().over(order)).where(quoted(rank) == 1).select(*[quoted(c) for c in docs.columns])
    return kept.join(again, quoted(key) == quoted(k), "left_anti").unionByName(first)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = classes(table(spark, sf_dir, "documents"), width=4, radius=4)
    return found.select("doc_id", F.lower(F.hex("fp")).alias("fingerprint"), "component_id")
