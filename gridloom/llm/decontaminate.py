"""Benchmark passages in documents: q-gram lemma over diagonal bands, then banded alignment."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import ahocorasick
import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.llm.arrowtext import as_text, give_back, map_rows
from gridloom.runtime import cut, quoted, table


@dataclass(frozen=True)
class Settings:
    """q: bytes of a gram. stride: every so many grams of an item are indexed. share: of an item's bytes that may be
    edited. least: items with fewer normalised bytes are found as they are only, as whole words, without an edit.
    most_bytes: of items that go along with a task at once; more are searched in parts, one after another."""

    q: int = 8
    stride: int = 2
    share: float = 0.1
    least: int = 40
    most_bytes: int = 32_000_000


_SPACE = np.ones(256, bool)
_SPACE[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_FOLD[_SPACE] = 32
#: Bytes worked on at once; longer texts are searched in pieces that overlap by more than the longest match.
PIECE = 1 << 20


def normal(text: str) -> np.ndarray:
    """UTF-8 bytes in lower case, runs of anything but letters and digits made one space, none at the ends."""
    if not text.isascii():
        text = text.lower()
    b = _FOLD[np.frombuffer(text.encode("utf-8", "replace"), np.uint8)]
    space = b == 32
    keep = ~space
    keep[1:] |= space[1:] & ~space[:-1]
    b = b[keep]
    if len(b) and b[0] == 32:
        b = b[1:]
    if len(b) and b[-1] == 32:
        b = b[:-1]
    return b


def grams(b: np.ndarray, q: int) -> np.ndarray:
    """The q bytes from each place as one number (q of at most 8)."""
    n = len(b) - q + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = b[:n].astype(np.uint64)
    for i in range(1, q):
        out <<= np.uint64(8)
        out |= b[i : n + i]
    return out


class Index:
    """The sampled grams of all items, in order, with a table of hash bits for a quick look; short items apart, in an
    automaton that finds all of them in one scan. keys: of the long items, then of the short ones."""

    BITS = 22

    def __init__(self, items: list[tuple[object, str]], settings: Settings):
        self.settings = s = settings
        self.keys, self.items, self.edits, self.need = [], [], [], []
        codes, owners, places = [], [], []
        short: list[tuple[object, bytes]] = []
        for key, text in items:
            b = normal(text)
            if len(b) < s.least:
                short += [(key, b.tobytes())] if len(b) else []
                continue
            k = int(len(b) * s.share)
            g = grams(b, s.q)[:: s.stride]
            # an edit changes at most ceil(q / stride) of the sampled grams
            need = len(g) - k * -(-s.q // s.stride)
            codes.append(g)
            owners.append(np.full(len(g), len(self.items)))
            places.append(np.arange(len(g)) * s.stride)
            self.keys.append(key)
            self.items.append(b)
            self.edits.append(k)
            self.need.append(max(1, need))
        self.edits, self.need = np.array(self.edits, np.int64), np.array(self.need, np.int64)
        code = np.concatenate(codes) if codes else np.empty(0, np.uint64)
        order = np.argsort(code, kind="stable")
        code = code[order]
        self.owner = np.concatenate(owners)[order] if codes else np.empty(0, np.int64)
        self.place = np.concatenate(places)[order] if codes else np.empty(0, np.int64)
        self.code, first = np.unique(code, return_index=True)
        self.first = np.append(first, len(code))
        self.bits = np.zeros(1 << self.BITS, bool)
        self.bits[self._slot(self.code)] = True
        self.longest = max(map(len, self.items), default=0)
        #: Bands are twice this wide and start this far apart, so that each band of one more than the edits lies in one.
        self.width = int(max(self.edits, default=0)) + 1
        self.words = ahocorasick.Automaton() if short else None
        for key, b in short:
            whole = f" {b.decode('latin-1')} "
            self.words.add_word(whole, (len(b), [*(self.words.get(whole, (0, []))[1]), len(self.keys)]))
            self.keys.append(key)
        if short:
            self.words.make_automaton()

    def _slot(self, code: np.ndarray) -> np.ndarray:
        return (code * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.BITS)

    def regions(self, b: np.ndarray) -> list[tuple[int, int, int]]:
        """(item, first and last diagonal) where as many grams are shared as an occurrence would leave.

        Counted in overlapping bands first, wide enough for any item; then, where that is enough, within as many
        diagonals as the item's own edits can shift, each sampled gram of the item once.
        """
        if not len(self.items):
            return []
        g = grams(b, self.settings.q)
        at = np.flatnonzero(self.bits[self._slot(g)])
        if not len(at):
            return []
        hit = np.searchsorted(self.code, g[at])
        same = self.code[np.minimum(hit, len(self.code) - 1)] == g[at]
        at, hit = at[same], hit[same]
        count = self.first[hit + 1] - self.first[hit]
        if not len(at) or count.sum() < self.need.min():
            return []
        offset = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        entry = np.repeat(self.first[hit], count) + offset
        owner, diagonal = self.owner[entry], np.repeat(at, count) - self.place[entry]
        band = (diagonal + self.longest) // self.width
        bands = int(band.max()) + 2
        key = owner * bands + band
        if len(self.items) * bands <= 16 * len(key) + 20_000:
            each = np.bincount(key, minlength=len(self.items) * bands).reshape(-1, bands)
            whose, left = np.nonzero(each[:, :-1] + each[:, 1:] >= self.need[:, None])
            edge = np.flatnonzero(each[:, 0] >= self.need)  # nothing lies left of the first band
        else:  # many items: only the bands that have grams
            filled, each = np.unique(key, return_counts=True)
            start = np.unique(np.concatenate([filled, filled[filled % bands > 0] - 1]))
            value = np.zeros(len(start), np.int64)
            for step in (0, 1):
                i = np.minimum(np.searchsorted(filled, start + step), len(filled) - 1)
                value += np.where((filled[i] == start + step) & ((start + step) // bands == start // bands), each[i], 0)
            good = start[value >= self.need[start // bands]]
            whose, left, edge = good // bands, good % bands, good[:0]
        out: dict[tuple[int, int, int], None] = {}
        for item, start in (*zip(whose.tolist(), left.tolist()), *((int(i), 0) for i in edge)):
            own = (owner == item) & ((band == start) | (band == start + 1))
            d, place = diagonal[own], self.place[entry[own]]
            order = np.argsort(d, kind="stable")
            d, place = d[order], place[order]
            # the item's own edits: so many grams within as many diagonals, at different places of the item
            upto = np.searchsorted(d, d + self.edits[item], "right")
            wide = np.flatnonzero(upto - np.arange(len(d)) >= self.need[item])
            if len(wide) and len(np.unique(place[wide[0] : upto[wide[-1]]])) >= self.need[item]:
                out[item, int(d[wide[0]]), int(d[upto[wide[-1]] - 1])] = None
        return list(out)

    def search(self, text: str) -> dict[int, tuple[int, int, int]]:
        """For each item that occurs with its edits at most: least edits, and start and end bytes in the normal text."""
        b = normal(text)
        best: dict[int, tuple[int, int, int]] = {}
        if self.words:
            for end, (size, found) in self.words.iter(f" {b.tobytes().decode('latin-1')} "):
                for item in found:
                    best.setdefault(item, (0, end - size - 1, end - 1))
        overlap = 2 * self.longest + 4 * self.width + self.settings.q
        for start in range(0, max(1, len(b)), PIECE):
            piece = b[max(0, start - overlap) : start + PIECE]
            base = max(0, start - overlap)
            for item, low, high in self.regions(piece):
                if item in best and best[item][0] == 0:
                    continue
                got = self.align(piece, item, low, high)
                if got and (item not in best or got[0] < best[item][0]):
                    best[item] = (got[0], got[1] + base, got[2] + base)
        return best

    def align(self, b: np.ndarray, item: int, low: int, high: int) -> tuple[int, int, int] | None:
        """Least edits of the item against any stretch of ``b`` that passes those diagonals; None if over its share."""
        a, k = self.items[item], int(self.edits[item])
        lo, hi = low - k, high + k
        stretch = b[max(0, lo) : hi + len(a)].tobytes()
        exact = stretch.find(a.tobytes())
        if exact >= 0:
            start = max(0, lo) + exact
            return 0, start, start + len(a)
        return banded(a, b, lo, hi, k)


def banded(a: np.ndarray, b: np.ndarray, lo: int, hi: int, k: int) -> tuple[int, int, int] | None:
    """Edit distance of ``a`` to the nearest stretch of ``b``, over cells (i, i + d) with lo <= d <= hi.

    A row of the table is one array over d. Free start and end in ``b``. Gives (edits, start, end) or None over k.
    """
    size, m, far = hi - lo + 1, len(b), 1 << 20
    d = np.arange(size)
    j = lo + d
    inside = (j >= 0) & (j <= m)
    row = np.where(inside, 0, far)
    begin = np.where(inside, j, 0)
    for i in range(1, len(a) + 1):
        j = i + lo + d
        inside = (j >= 0) & (j <= m)
        letter = b[np.clip(j - 1, 0, max(0, m - 1))] if m else np.zeros(size, np.uint8)
        across = row + np.where((j >= 1) & (j <= m) & (letter == a[i - 1]), 0, 1)
        across[j < 1] = far
        down = np.append(row[1:], far) + 1  # a letter of a alone: same j, one diagonal up
        origin = np.where(down < across, np.append(begin[1:], 0), begin)
        new = np.where(inside, np.minimum(across, down), far)
        # a letter of b alone: from the left, one more for each step
        level = new - d
        low = np.minimum.accumulate(level)
        source = np.maximum.accumulate(np.where(level == low, d, 0))
        row = np.where(inside, low + d, far)
        begin = origin[source]
        if row.min() > k:
            return None
    at = int(row.argmin())
    edits = int(row[at])
    return (edits, int(begin[at]), len(a) + lo + at) if edits <= k else None


def _parts(benchmark: DataFrame, settings: Settings) -> Iterator[list[tuple[int, str]]]:
    """The items on the driver, in parts of ``most_bytes`` at most (or one item); null ids are left out."""
    rows = benchmark.select(F.col("item_id").cast("bigint").alias("i"), as_text(F.col("text")).alias("t")).where("i is not null")
    size = rows.agg(F.sum(F.octet_length("t")).alias("n")).first()["n"] or 0
    if size <= settings.most_bytes:
        yield sorted((r["i"], r["t"]) for r in rows.collect())
        return
    n = -(-5 * size // (4 * settings.most_bytes))
    part = lambda: F.pmod(F.xxhash64("i", "t"), F.lit(n))
    while True:
        sums = rows.groupBy(part().alias("p")).agg(F.sum(F.octet_length("t")).alias("b"), F.count_distinct("i", "t").alias("n"))
        if sums.where((F.col("b") > settings.most_bytes) & (F.col("n") > 1)).isEmpty():
            break
        n *= 2
    for p in range(n):
        yield sorted((r["i"], r["t"]) for r in rows.where(part() == p).collect())


_FOUND = "items array<bigint>, edits array<bigint>, starts array<bigint>, ends array<bigint>"


def _searched(slim: DataFrame, name: str, items: list, settings: Settings) -> DataFrame:
    """(name, n_items, items, edits, starts, ends) of each row of (name, t)."""

    def work():
        index = Index(items, settings)

        def step(columns):
            keys, texts = columns
            out = [[], [], [], [], []]
            for t in texts:
                got = sorted((index.keys[i], *x) for i, x in index.search(t).items())
                out[0].append(len(got))
                for c in range(4):
                    out[c + 1].append([g[c] for g in got])
            return [keys, *out]

        return step

    kind = slim.schema[name].dataType.simpleString()
    return map_rows(slim, {name: name, "t": "t"}, f"`{name}` {kind}, n_items long, {_FOUND}", work)


def matches(docs: DataFrame, benchmark: DataFrame, settings: Settings | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_items, items, edits, starts, ends) of each row of ``docs``: ids of the benchmark items (ascending) that
    occur in its whole text with at most their share of bytes edited, the least edits of each, and the bytes of the
    normal text where it lies. Case, punctuation and white space count for nothing.

    One pass without a shuffle for each ``most_bytes`` of the benchmark, which go along with the tasks; where that takes
    several, rows are numbered, and what each pass found meets by number. Null and empty texts hold no item; null and
    empty items are never found; items that repeat an id count once each. Very long texts are searched whole, in pieces
    that overlap. Rows that repeat each give a row, an empty table none; other columns may have any name.
    """
    settings = settings or Settings()
    name = "k"
    slim = docs.select(quoted(key).alias(name), as_text(quoted(text)).alias("t"))
    parts = _parts(benchmark, settings)
    first, second = next(parts), next(parts, None)
    if second is None:
        return _searched(slim, name, first, settings).withColumnRenamed(name, key)
    rows = cut(slim.withColumn("_row", F.monotonically_increasing_id()), "numbered")
    each = []
    for items in (first, second, *parts):
        found = _searched(rows.select("_row", "t"), "_row", items, settings).where("n_items > 0")
        each.append(cut(found.select("_row", F.inline(F.arrays_zip("items", "edits", "starts", "ends"))), "found"))
    whole = each[0]
    for e in each[1:]:
        whole = whole.unionByName(e)
    fields = ["items", "edits", "starts", "ends"]
    put = whole.groupBy("_row").agg(F.sort_array(F.collect_list(F.struct(*fields))).alias("all"))
    out = rows.select("_row", F.col("k").alias(key)).join(put, "_row", "left")
    none = F.array().cast("array<bigint>")
    return out.select(quoted(key), F.coalesce(F.array_size("all"), F.lit(0)).cast("long").alias("n_items"), *[F.coalesce(F.col("all")[f], none).alias(f) for f in fields])


def remove(docs: DataFrame, benchmark: DataFrame, settings: Settings | None = None, text: str = "text") -> DataFrame:
    """The rows of ``docs`` whose text holds no item, columns as they were; null texts stay. No shuffle; where the
    benchmark takes several passes, what each keeps is written for the next."""
    from pyspark.sql.pandas.functions import pandas_udf

    settings = settings or Settings()

    def pass_of(rows: DataFrame, items: list) -> DataFrame:
        index: list[Index] = []

        @pandas_udf("boolean")
        def clean(column):
            if not index:
                index.append(Index(items, settings))
            out = column.map(lambda t: not index[0].search(t or ""))
            give_back()
            return out

        return rows.where(clean(quoted(text).cast("string")))

    parts = _parts(benchmark, settings)
    out = pass_of(docs, next(parts))
    for items in parts:
        out = pass_of(cut(out, "clean"), items)
    return out


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


