"""Order MinHash fingerprints: near under edit distance, not only in what texts hold."""

from __future__ import annotations

import bisect
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.functions import arrow_udf, pandas_udf
from pyspark.sql.pandas.types import to_arrow_schema

from gridloom.llm.arrowtext import as_text
from gridloom.runtime import cut, free_name, quoted, table

#: k-mers are this many code points; each tuple has this many of them; a fingerprint has this many tuples.
LENGTH, TUPLE, TUPLES = 8, 2, 64
_BASE = np.uint64(0x9E3779B97F4A7C15)
_ODD = (np.random.default_rng(20).integers(0, 1 << 32, TUPLES, dtype=np.uint64) | np.uint64(1)).astype(np.uint32)
_XOR = np.random.default_rng(21).integers(0, 1 << 32, TUPLES, dtype=np.uint64).astype(np.uint32)
#: LENGTH is a power of two.
_POWERS = [(1 << i, np.uint64(pow(int(_BASE), 1 << i, 1 << 64))) for i in range(LENGTH.bit_length() - 1)]
_BLOCK = 8_192
#: Runs of rows in order at most, and rows that a worker hands on at once for one that stands for many.
MOST_RUNS, COPIES = 4_096, 10_000


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def kmers(text: str) -> np.ndarray:
    """A 64-bit code of each run of LENGTH code points; of the whole text where it is shorter; none for an empty one."""
    c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64) + np.uint64(1)
    if len(c) < LENGTH:
        code = np.full(min(1, len(c)), len(c), np.uint64)
        for v in c:
            code = code * _BASE + v
        return _mix(code)
    for span, power in _POWERS:  # codes of twice the span from two of the span
        c = c[:-span] * power + c[span:]
    return _mix(c)


def numbered(codes: np.ndarray) -> np.ndarray:
    """Codes made distinct by how often the same one came before."""
    n = len(codes)
    if n < 2:
        return codes
    order = np.argsort(codes, kind="stable")
    s = codes[order]
    starts = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1]]))
    if len(starts) == n:
        return codes
    rank = np.arange(n) - np.repeat(starts, np.diff(np.append(starts, n)))
    out = codes.copy()
    again = np.flatnonzero(rank)
    out[order[again]] = _mix(s[again] + rank[again].astype(np.uint64) * _BASE)
    return out


def signature(text: str) -> np.ndarray:
    """TUPLES 32-bit values: for each of as many orders the TUPLE least occurrence-numbered k-mers, in the order of the
    text, hashed together. Texts with fewer k-mers take all they have; an empty text has zeros."""
    codes = kmers(text)
    n = len(codes)
    if not n:
        return np.zeros(TUPLES, np.uint32)
    x = (numbered(codes) >> np.uint64(32)).astype(np.uint32)
    best = np.empty((TUPLES, 0), np.uint32)
    place = np.empty((TUPLES, 0), np.int64)
    rows = np.arange(TUPLES)
    for start in range(0, n, _BLOCK):
        part = x[start : start + _BLOCK]
        h = (part[None, :] ^ _XOR[:, None]) * _ODD[:, None]
        got, at = [], []
        for _ in range(min(TUPLE, len(part))):
            i = h.argmin(1)
            got.append(h[rows, i])
            at.append(i + start)
            h[rows, i] = 0xFFFFFFFF
        best = np.concatenate([best, np.stack(got, 1)], 1)
        place = np.concatenate([place, np.stack(at, 1)], 1)
        if best.shape[1] > TUPLE:
            keep = np.argsort(best, axis=1, kind="stable")[:, :TUPLE]
            best, place = np.take_along_axis(best, keep, 1), np.take_along_axis(place, keep, 1)
    place.sort(axis=1)
    out = np.zeros(TUPLES, np.uint64)
    for i in range(place.shape[1]):
        out = _mix(out * _BASE + codes[place[:, i]] + np.uint64(1))
    return np.maximum((out >> np.uint64(32)).astype(np.uint32), 1)


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """The share of equal tuples."""
    return float((a == b).mean())


def written(s: np.ndarray) -> str:
    return s.astype(">u4").tobytes().hex()


def fingerprint(docs: DataFrame, text: str = "text", into: str = "fingerprint") -> DataFrame:
    """``docs`` with the fingerprint of the whole text as hexadecimal digits; null counts as empty. No shuffle."""
    @pandas_udf("string")
    def run(column):
        return column.map(lambda t: written(signature(t or "")))

    return docs.withColumn(free_name(docs, into), run(quoted(text).cast("string")))


def in_order(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(b, helper, k, t, c): rows in runs of descending keys, each run followed by the first row of the next run.

    Rows of one key follow each other by hash and text; null keys go last. c: rows that this one stands for, as equal
    rows of which there are more than a run should hold are one row here, gathered without their copies being shuffled.
    Runs have about equal bytes (four runs a shuffle partition, MOST_RUNS at most); they are cut at rows of a sample,
    a bounded number of keys and hashes, which come to the driver like the first key of each run. A worker finds a
    row's run by bisection. Every text is shuffled once, and first ones twice.
    """
    spark = docs.sparkSession
    n = max(2, min(MOST_RUNS, 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))))
    t = as_text(quoted(text))
    kind = docs.schema[key].dataType.simpleString()
    order = {"timestamp": F.unix_micros, "float": lambda k: F.nanvl(k, F.lit(None)), "double": lambda k: F.nanvl(k, F.lit(None))}.get(kind, lambda k: k)
    slim = docs.select(quoted(key).alias("k"), order(quoted(key)).alias("o"), F.xxhash64(t).alias("h"), F.octet_length(t).alias("bytes"), t.alias("t"))
    counts = cut(slim.groupBy("o", "h").agg(F.count(F.lit(1)).alias("c"), F.sum("bytes").alias("bytes")), "counts")
    size = counts.agg(F.sum("c").alias("rows"), F.sum(F.col("bytes") + 64).alias("bytes")).first()
    rows, total = size["rows"] or 0, size["bytes"] or 1
    # at most n pairs of key and hash have over an nth of the rows
    many = counts.where(F.col("c") > max(2, rows // n)).select(F.col("o").alias("o2"), F.col("h").alias("h2"))
    same = F.col("o").eqNullSafe(F.col("o2")) & (F.col("h") == F.col("h2"))
    once = slim.join(F.broadcast(many), same, "left_semi").groupBy("k", "o", "h", "t").agg(F.count(F.lit(1)).alias("c"))
    single = slim.join(F.broadcast(many), same, "left_anti").select("k", "o", "h", "t", F.lit(1).cast("bigint").alias("c"))
    slim = single.unionByName(once)
    share = min(1.0, 32.0 * n / max(1, rows))
    drawn = counts.where(F.pmod(F.xxhash64("o", "h", F.lit(5)), F.lit(1 << 30)) < int(share * (1 << 30))).select("o", "h", "bytes").limit(64 * n).collect()
    # ascending in the reverse of the order: null keys, then keys, falling hashes among equals
    place = lambda o, h: (o is not None, plain(o), ~h)
    plain = lambda o: bytes(o) if isinstance(o, bytearray) else o
    cuts, step, since = [], sum(r["bytes"] + 64 for r in drawn) / n, 0
    for r in sorted(drawn, key=lambda r: place(r["o"], r["h"])):
        since += r["bytes"] + 64
        if since >= step:
            cuts.append(place(r["o"], r["h"]))
            since = 0

    @arrow_udf("int")
    def run(o: pa.Array, h: pa.Array) -> pa.Array:
        return pa.array([len(cuts) - bisect.bisect_left(cuts, place(x, y)) for x, y in zip(o.to_pylist(), h.to_pylist())], pa.int32())

    latest = F.max(F.struct(F.col("o").isNotNull().alias("known"), "o", F.bitwise_not("h").alias("r"))).alias("m")
    first = counts.select("o", "h", run("o", "h").alias("b")).groupBy("b").agg(latest).select("b", "m.o", F.bitwise_not("m.r").alias("h"))
    heads = sorted((r["b"], plain(r["o"]), r["h"]) for r in first.collect()) if rows else []
    ends = {(o, h): heads[i - 1][0] for i, (_, o, h) in enumerate(heads)}  # the first of all ends the last run

    @arrow_udf("int")
    def before(o: pa.Array, h: pa.Array) -> pa.Array:
        return pa.array([ends.get(x, -1) for x in zip(o.to_pylist(), h.to_pylist())], pa.int32())

    named = slim.withColumns({"b": run("o", "h"), "end": before("o", "h")})
    both = F.filter(F.array(F.struct("b", F.lit(0).alias("helper")), F.struct(F.col("end").alias("b"), F.lit(1).alias("helper"))), lambda x: x["b"] >= 0)
    runs = named.select("k", "o", "h", "t", "c", F.inline(both)).repartition("b").sortWithinPartitions("b", "helper", F.desc_nulls_last("o"), "h", "t")
    return runs.select("b", "helper", "k", "t", "c")


def pairs(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next) of each row.

    The edited text has the last floor(n/2) code points replaced by the first as many (or all) of the next row's text,
    by descending key, the first after the last; a single row is next to itself. Keys are of any type that has an
    order; those that aren't numbers count as null. Null texts count as empty, null keys come last, rows of one key go by hash and text of their texts. Equal
    texts have equal fingerprints; two empty texts are alike (1). An empty table gives no row. Other columns may have
    any name. Rows stream through in order: a worker holds two texts, however long.
    """
    schema = T._parse_datatype_string(f"doc_id {docs.schema[key].dataType.simpleString()}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
    arrow = to_arrow_schema(schema)

    def result(k, text_: str, sig: np.ndarray, next_: str, next_sig: np.ndarray) -> tuple:
        half = len(text_) // 2
        edited = text_[: len(text_) - half] + next_[:half]
        changed = signature(edited)
        return (k, len(text_), hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest(), written(sig), written(changed), likeness(sig, changed), likeness(sig, next_sig))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # run, key, text, signature of the row that waits for the next

        def out(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(x, type=f.type) for x, f in zip(zip(*rows), arrow)], schema=arrow)

        for batch in batches:
            rows = []
            for b, helper, k, t, c in zip(*(batch.column(i).to_pylist() for i in range(5))):
                same = held is not None and held[0] == b
                if not same and helper:
                    held = None
                    continue
                own = signature(t)
                if same:
                    rows.append(result(*held[1:], t, own))
                held = None if helper else (b, k, t, own)
                if c > 1 and not helper:
                    again = result(k, t, own, t, own)
                    for left in range(c - 1, 0, -COPIES):
                        yield out([again] * min(left, COPIES))
            if rows:
                yield out(rows)

    return in_order(docs, key, text).mapInArrow(work, schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairs(table(spark, sf_dir, "documents"))


