"""Each operator against a brute-force version on small rows, and on nulls, empty, long and repeated rows."""

import base64
import hashlib
import json
import os
import random
import re

import numpy as np
import public_tokenizers
import pytest
import tiktoken
import xxhash
from pyspark.sql import functions as F

from gridloom.llm import bpe, decontaminate, htmltext, orderhash, pii, secrets, sharding, simhash, toxicity, urls
from gridloom.llm.queries import QUERIES, SQL

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def words(rng, n, vocabulary=400):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


def odd_rows():
    rng = random.Random(3)
    long = words(rng, 30_000, 5_000) + " " + "x" * 100_000
    rows = [(1, None), (2, ""), (3, "  \n\t"), (4, "one"), (5, "one"), (5, "one"), (None, "no key at all"), (7, long), (8, words(rng, 60)), (9, "é漢字 ☃ \u00a0 Ω"), (10, words(rng, 60))]
    return [(i, t, None, "s", None) for i, t in rows]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(odd_rows(), DOCS)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


def by_key(df):
    return {r["doc_id"]: r for r in df.collect()}


# 1


def test_bpe_equals_the_library_and_comes_back(spark, docs, none):
    settings = bpe.production()
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(settings["rank_file"], "rb"))}
    enc = tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    got = bpe.digests(docs, **settings).collect()
    assert len(got) == docs.count() and bpe.digests(none, **settings).count() == 0
    texts = {i: t or "" for i, t, *_ in odd_rows()}
    for r in got:
        t = texts[r["doc_id"]]
        ids = enc.encode_ordinary(t)
        assert r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(t.encode()).hexdigest()
    back = bpe.decode(bpe.encode(docs.withColumn("IDS", F.lit(1)), **settings), **settings, ids="_ids")
    assert all(bytes(r["bytes"]) == (r["text"] or "").encode() for r in back.collect())


def test_bpe_merges_of_long_pieces_and_safe_places():
    c = bpe.Codec.of(**bpe.production())
    rng = random.Random(1)
    for alphabet in ("ab", "the in", "é漢x0"):
        t = "".join(rng.choice(alphabet) for _ in range(2_000))
        want = c.encoding.encode_ordinary(t)
        assert [i for m in c.pattern.finditer(t) for i in c.merge(m[0].encode())] == want
    t = ("it's   a\n\n test 123" * 9_000) + " " * 70_000 + "end"
    assert "".join(bpe.parts(t)) == t and c.encode(t) == c.encoding.encode_ordinary(t)
    half = "é".encode()[:1]
    assert c.decode([c.ranks[half]]) == half


# 2


def slow_fingerprint(text, width):
    w = re.findall(rb"[^\x20\x09-\x0D]+", bytes(c + 32 if 65 <= c <= 90 else c for c in (text or "").encode()))
    sh = [b" ".join(w[i : i + width]) for i in range(max(1, len(w) - width + 1))] if w else []
    h = [xxhash.xxh64_intdigest(s, 42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def slow_classes(values, radius):
    root = list(range(len(values)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(values)):
        for j in range(i):
            if bin(values[i] ^ values[j]).count("1") <= radius:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(values))]


def test_simhash_against_all_pairs(spark):
    rng = random.Random(2)
    rows, k = [], 0
    for _ in range(40):
        t = words(rng, rng.choice([1, 3, 20, 150])).split()
        for _ in range(rng.choice([1, 1, 2, 6])):
            c = list(t)
            if rng.random() < 0.6:
                c[rng.randrange(len(c))] = "Changed"
            rows.append((k, " ".join(c)))
            k += 3
    rows += [(k, None), (k + 1, ""), (k + 2, " \x0b ")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = simhash.classes(df).collect()
    values = [slow_fingerprint(t, 4) for _, t in rows]
    roots = slow_classes(values, 4)
    assert {r["doc_id"]: (r["fp"].hex(), r["component_id"]) for r in got} == {i: (f"{v:016x}", rows[r][0]) for (i, _), v, r in zip(rows, values, roots)}


def test_simhash_tiles_blocks_and_dense_groups(spark, monkeypatch):
    """Small tiles, so that cells are cut into several, and a group in which all are near all."""
    monkeypatch.setattr(simhash, "LEAST_TILE", 8)
    rng = np.random.default_rng(4)
    base = rng.integers(0, 1 << 63, 1, dtype=np.uint64)[0]
    near = [int(base) ^ (1 << int(a)) ^ (1 << int(b)) for a, b in rng.integers(0, 64, (150, 2))]
    values = list(dict.fromkeys([*near, *map(int, rng.integers(0, 1 << 63, 200, dtype=np.uint64))]))
    fps = spark.createDataFrame([(bytearray(v.to_bytes(8, "big")),) for v in values], "fp binary")
    for radius in (4, 14):
        edges = simhash.links(fps, radius).collect()
        assert len(edges) < 20 * len(values)
        root = {v.to_bytes(8, "big"): v.to_bytes(8, "big") for v in values}

        def find(x):
            while root[x] != x:
                x = root[x]
            return x

        for e in edges:
            a, b = find(bytes(e["u"])), find(bytes(e["v"]))
            root[max(a, b)] = min(a, b)
        slow = slow_classes(values, radius)
        mine = [find(v.to_bytes(8, "big")) for v in values]
        assert len(set(zip(mine, slow))) == len(set(slow)) == len(set(mine))


def test_simhash_odd_rows(spark, docs, none):
    got = simhash.classes(docs).collect()
    assert len(got) == docs.count() and simhash.classes(none).count() == 0
    assert {r["component_id"] for r in got if r["doc_id"] in (1, 2, 3)} == {1} and {r["component_id"] for r in got if r["doc_id"] in (4, 5)} == {4}


def test_deduplicate_keeps_one_of_similar_and_all_others(spark, none):
    rng = random.Random(9)
    rows, want = [], set()
    for i in range(60):
        t = words(rng, 400, 5_000).split()
        rows.append((10 * i, " ".join(t)))
        want.add(10 * i)
        near = list(t)
        for _ in range(8):  # about 0.82 of the five-word shingles stay
            near[rng.randrange(400)] = "other"
        rows.append((10 * i + 1, " ".join(near)))
        rows.append((10 * i + 2, " ".join(t[:200]) + " " + words(rng, 200, 5_000)))  # a third alike: stays
        want.add(10 * i + 2)
    rows += [(None, "keyless"), (None, "keyless"), (0, rows[0][1]), (5000, "twice"), (5000, "twice")]
    df = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], DOCS)
    got = [r["doc_id"] for r in simhash.deduplicate(df).collect()]
    assert got.count(None) == 2 and got.count(0) == 1 and got.count(5000) == 1
    kept = set(got) - {None, 5000}
    assert want <= kept and len(kept - want) <= 3
    assert simhash.deduplicate(none).columns == none.columns and simhash.deduplicate(none).count() == 0


def slow_alike(texts):
    sets = [{" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if (w := (t or "").lower().split()) else set() for t in texts]
    root = list(range(len(texts)))
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if 5 * len(a & b) >= 4 * len(a | b):
                root = [root[j] if r == root[i] else r for r in root]
    return root


def test_near_duplicates_are_those_of_all_pairs_of_sets(spark, monkeypatch):
    """Pairs at exactly 0.8, just above and just below it, of few and many words; no tolerance."""
    rng = random.Random(12)
    texts = []
    for n in (8, 8, 8, 9, 9, 10, 12, 13, 24, 44, 54, 104, 204) * 12:
        t = words(rng, n, 9_000).split()
        texts += [" ".join(t), " ".join([*t, "more"])]
        m = n - 4  # shingles; others at the end make as many new ones as they take
        for k in {m // 9, m // 9 + 1}:
            texts.append(" ".join([*t[: n - k], *(f"e{rng.random()}" for _ in range(k))]))
    group = words(rng, 60, 9_000).split()
    for _ in range(120):  # a dense group around 0.8
        g = list(group)
        for _ in range(rng.randrange(1, 4)):
            g[rng.randrange(60)] = f"o{rng.randrange(999)}"
        texts.append(" ".join(g))
    texts += [None, "", " ", "one", "One"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    roots = slow_alike(texts)
    least = {}
    for i, r in enumerate(roots):
        least.setdefault(r, i)
    want = {i: least[r] for i, r in enumerate(roots)}
    for tile in (simhash.LEAST_TILE, 32):
        monkeypatch.setattr(simhash, "LEAST_TILE", tile)
        assert {r["doc_id"]: r["component_id"] for r in simhash.alike(df).collect()} == want
    assert sorted(r["doc_id"] for r in simhash.deduplicate(df).collect()) == sorted(set(want.values()))


def test_rows_of_one_key_are_decided_by_their_own_class(spark):
    a, b, c, d = (" ".join(f"{x}{i}" for i in range(30)) for x in "abcd")
    rows = [(1, a), (2, a), (2, b), (3, b), (4, c), (4, d), (4, d), (5, c)]
    got = simhash.deduplicate(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r["doc_id"], r["text"]) for r in got) == [(1, a), (2, b), (4, c), (4, d)]


# 3


def slow_shards(rows, limit):
    out = []

    def split(part, bits):
        size = sum(b for _, _, b in part)
        if size <= limit or len({h for _, h, _ in part}) == 1 or len(bits) == sharding.BITS:
            out.extend((i, bits, size) for i, _, _ in part)
            return
        for bit in "01":
            half = [x for x in part if format(x[1], f"0{sharding.BITS}b")[len(bits)] == bit]
            if half:
                split(half, bits + bit)

    split(rows, "")
    return sorted(out)


def test_shards_against_recursive_splitting(spark, docs, none):
    rng = random.Random(5)
    rows = [(i, "é" * rng.choice([0, 3, 50, 400])) for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    h = lambda i: int(hashlib.md5(str(i).encode()).hexdigest()[:15], 16)
    for limit in (500, 3_000, 10**9):
        got = sorted((r["doc_id"], r["shard"], r["shard_bytes"]) for r in sharding.assign(df, limit).collect())
        assert got == slow_shards([(i, h(i), len(t.encode())) for i, t in rows], limit)
    assert sharding.assign(none).count() == 0 and sharding.assign(docs, 1_000).count() == docs.count()


def test_shards_of_one_hot_key_go_to_pages_that_fit(spark, tmp_path):
    df = spark.createDataFrame([(1, "x" * (i % 90)) for i in range(400)] + [(i, "y" * 50) for i in range(2, 60)] + [(1, "z" * 900)], "doc_id long, text string").repartition(5)
    got = sharding.assign(df, 1_000).collect()
    assert len(got) == 459
    pages = {}
    for r in got:
        pages[r["shard"], r["page"]] = pages.get((r["shard"], r["page"]), 0) + r["bytes"]
    assert max(pages.values()) <= 1_000 and len(pages) > 15
    placed = sharding.shard(df.withColumn("Shard", F.lit("mine")), 1_000)
    assert placed.columns == ["doc_id", "text", "Shard", "_shard", "page"] and placed.count() == 459
    sharding.write(df, str(tmp_path / "out"), 1_000)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 459


def test_written_pages_of_a_hot_key_keep_the_limit(spark, tmp_path):
    """All rows of one key and one size: each page that is written has the bytes that it was given."""
    for name, key in (("one", 1), ("null", None)):
        rows = [(key, f"{i:050d}") for i in range(300)] + [(key, f"{i:09d}") for i in range(40)] + [(i, "y" * 50) for i in range(2, 60)]
        df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
        want = {(r["shard"], r["page"]): r["b"] for r in sharding.assign(df, 1_000).groupBy("shard", "page").agg(F.sum("bytes").alias("b")).collect()}
        assert max(want.values()) <= 1_000
        placed = sharding.shard(df, 1_000)
        assert max(r["b"] for r in placed.groupBy("shard", "page").agg(F.sum(F.octet_length("text")).alias("b")).collect()) <= 1_000
        sharding.write(df, str(tmp_path / name), 1_000)
        back = [spark.read.parquet(str(d)).collect() for d in (tmp_path / name).glob("shard=*/page=*")]
        assert all(sum(len(r["text"]) for r in rows) <= 1_000 for rows in back)
        assert sorted((r["doc_id"] or 0, r["text"]) for rows in back for r in rows) == sorted((i or 0, t) for i, t in rows)


def test_pages_of_repeated_and_oversized_texts(spark):
    """A long text doesn't make pages of the short ones beside it, and equal rows spread over pages one to one."""
    rows = [(1, "x" * 10)] * 50 + [(1, "y" * 5_000), (1, "z" * 700), (1, "z" * 700)] + [(2, "w" * 100)] * 50 + [(3, None)] * 9
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit(1) for c in ("_k", "_s", "_p", "_b", "_size", "_size2", "_part", "_no", "shard", "cell", "h", "bytes")}).repartition(4)
    for placed in (sharding.assign(df, 1_000).select("doc_id", "shard", "page", "bytes"), sharding.shard(df, 1_000).select("doc_id", F.col("_shard").alias("shard"), "page", F.coalesce(F.octet_length("text"), F.lit(0)).alias("bytes"))):
        pages = {}
        for r in placed.collect():
            pages.setdefault((r["doc_id"], r["shard"], r["page"]), []).append(r["bytes"])
        assert sorted(sum(b) for (k, *_), b in pages.items() if k == 1) == [500, 700, 700, 5_000]
        assert all(sum(b) <= 1_000 for (k, *_), b in pages.items() if k != 1) and 5 <= sum(k == 2 for k, *_ in pages) <= 6
        assert sum(map(len, pages.values())) == len(rows)


def test_directory_of_deep_buckets(spark, monkeypatch):
    """Keys whose hashes share many bits: buckets split far below the first round, beyond the broadcast too."""
    h = lambda k: F.when(k < 64, k * (1 << 40)).otherwise((k * 0x9E3779B97F4A7) % (1 << sharding.BITS)).cast("bigint")
    monkeypatch.setattr(sharding, "hash_of", lambda key: h(key))
    rows = [(i, "x" * 10) for i in range(64)] + [(i, "y" * 10) for i in range(1_000, 1_100)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = slow_shards([(i, i << 40 if i < 64 else i * 0x9E3779B97F4A7 % (1 << sharding.BITS), len(t)) for i, t in rows], 50)
    monkeypatch.setattr(sharding, "MOST_BROADCAST", 20)
    assert sorted((r["doc_id"], r["shard"], r["shard_bytes"]) for r in sharding.assign(df, 50).collect()) == want
    assert max(len(b) for _, b, _ in want) > 16


# 4


def slow_distance(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [row[0] + 1]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return min(row)


def test_banded_alignment_against_the_whole_table():
    rng = random.Random(6)
    for _ in range(60):
        a = bytes(rng.choice(b"abc ") for _ in range(rng.randrange(5, 40)))
        noise = bytearray(a)
        for _ in range(rng.randrange(0, 5)):
            noise[rng.randrange(len(noise))] = rng.choice(b"abc ")
        left = bytes(rng.choice(b"abc ") for _ in range(rng.randrange(0, 30)))
        b = left + bytes(noise) + bytes(rng.choice(b"abc ") for _ in range(rng.randrange(0, 30)))
        got = decontaminate.banded(np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8), -len(a), len(b), len(a))
        assert got[0] == slow_distance(a, b)
        assert slow_distance(a, b[got[1] : got[2]]) == got[0]


def test_matches_lose_no_occurrence_within_the_budget(spark, docs, none):
    rng = random.Random(7)
    items = [(i, words(rng, rng.choice([12, 30, 70]), 300).capitalize() + ".") for i in range(25)] + [(98, None), (99, "short"), (None, "no id")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    rows, want = [], {}
    for d in range(120):
        i, t = items[d % 25]
        n = len(decontaminate.normal(t))
        s = list(t.upper() if d % 3 == 0 else t)
        for _ in range(int(n * 0.1) if d % 2 else 0):
            p = rng.randrange(len(s))
            s[p] = rng.choice([s[p] + "q", "q", ""])
        whole = words(rng, 200, 300) + " \n" + "".join(s) + "!! " + words(rng, 100, 300)
        rows.append((d, whole))
        best = slow_distance(decontaminate.normal(t).tobytes(), decontaminate.normal(whole).tobytes())
        want[d] = (i, best) if best <= int(n * 0.1) else None
    rows += [(500 + d, words(rng, 300, 300)) for d in range(40)]
    found = by_key(decontaminate.matches(spark.createDataFrame(rows, "doc_id long, text string"), bench))
    for d, w in want.items():
        assert w is None and not found[d]["n_items"] or w and dict(zip(found[d]["items"], found[d]["edits"])).get(w[0]) == w[1]
    assert all(found[500 + d]["n_items"] == 0 for d in range(40))
    assert decontaminate.matches(docs, bench).count() == docs.count() and decontaminate.matches(none, bench).count() == 0
    kept = decontaminate.remove(docs, bench)
    assert kept.count() == docs.count() and kept.columns == docs.columns
    assert decontaminate.matches(docs, bench.limit(0)).where("n_items > 0").count() == 0


def test_benchmarks_in_parts_and_short_items(spark, docs, none):
    """Beyond the bytes that go along at once, and under the least length: nothing is lost across either bound."""
    rng = random.Random(11)
    items = [(i, words(rng, 12, 300)) for i in range(30)] + [(50, "two words"), (51, "Yes!"), (51, "w1 w2"), (52, ""), (53, "?!"), (54, "é漢"), (None, "no")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    rows = [(d, words(rng, 40, 300) + " " + " ".join(items[i][1] or "" for i in rng.sample(range(36), 3)) + "; Two -- WORDS" * (d % 2) + " twowords yesterday é漢x") for d in range(60)] + [(7, rows_[1]) for rows_ in [(0, "W1, w2")]] + [(None, None), (8, "")]
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], "k long, body string, _row int, all int")
    whole = sorted(map(repr, decontaminate.matches(df, bench, key="k", text="body").collect()))
    s = decontaminate.Settings(most_bytes=700)
    assert sorted(map(repr, decontaminate.matches(df, bench, s, key="k", text="body").collect())) == whole
    norm = lambda t: f" {decontaminate.normal(t or '').tobytes().decode('latin-1')} "
    for r in decontaminate.matches(df, bench, key="k", text="body").collect():
        t = [t for k, t in rows if k == r["k"]]
        short = [{i for i, x in items[30:] if i and norm(x).strip() and norm(x) in norm(y)} for y in t]
        assert {i for i in r["items"] if i >= 30} in short
    for settings in (decontaminate.Settings(), s):
        kept = decontaminate.remove(df, bench, settings, text="body")
        assert kept.columns == df.columns and kept.count() == sum("n_items=0" in r for r in whole)
    assert decontaminate.matches(none, bench, s).count() == 0 and decontaminate.matches(docs, bench, s).count() == docs.count()


def test_matches_across_pieces_of_a_long_text(monkeypatch):
    monkeypatch.setattr(decontaminate, "PIECE", 1_000)
    rng = random.Random(8)
    item = words(rng, 40, 999)
    ix = decontaminate.Index([(1, item)], decontaminate.Settings())
    for lead in range(700, 1_100, 7):
        assert ix.search("z" * lead + " " + item + " " + "y" * 2_000)


def test_sparse_and_dense_counting_agree():
    rng = random.Random(8)
    many = [(i, words(rng, 30, 60)) for i in range(3_000)]
    text = words(rng, 50, 60) + " " + many[5][1] + " " + words(rng, 20, 60)
    assert 5 in decontaminate.Index(many, decontaminate.Settings()).search(text)
    assert list(decontaminate.Index(many[5:6], decontaminate.Settings()).search(text)) == [0]


# 5


def test_factorization_machine_learns_a_pair():
    """Only both words together are toxic, which no sum of weights can say."""
    rng = random.Random(1)
    s = toxicity.Settings(prefixes=(), epochs=80, decay=1e-5)
    m = toxicity.Model(s)
    texts = [" ".join(rng.sample(["insult", "group", "calm", "tree", "sky", "lake", "road"], rng.choice([2, 3, 4]))) for _ in range(1500)]
    y = np.array([float("insult" in t and "group" in t) for t in texts])
    m.terms = np.array(sorted({h for t in texts for h in toxicity.hashed(t, s)}), np.int64)
    got = [m.features(t) for t in texts]
    toxicity.train(m, [np.array(a) for a, _ in got], [np.array(x) for _, x in got], y)
    assert m.score("insult group") > 0.7 > 0.5 > max(m.score("insult"), m.score("group"), m.score("calm lake"), m.score("insult tree"))


def test_gradient_of_the_margin():
    m = toxicity.Model(toxicity.Settings(), np.arange(5), np.arange(5.0), np.random.default_rng(0).normal(size=(5, 3)), 0.3)
    at, x = np.array([0, 2, 4]), np.array([1.0, 2.0, 0.5])
    pairs = sum((m.factors[at[i]] * x[i]) @ (m.factors[at[j]] * x[j]) for i in range(3) for j in range(i))
    assert m.margin(at, x) == pytest.approx(0.3 + m.weights[at] @ x + pairs)


def test_scores_and_terms_against_plain_loops(spark, monkeypatch):
    """Terms by chi-square over all labelled rows, and the score as the sum over all pairs of terms."""
    import math
    import zlib

    rng = random.Random(21)
    mean = ["scum", "idiots", "Idiot", "pathetic"]
    rows = [(i, " ".join(rng.choice(mean) if (toxic := i % 3 == 0) and rng.random() < 0.3 else f"w{rng.choice('abcdefgh')}x" for _ in range(rng.randrange(1, 30))), int(toxic)) for i in range(300)]
    rows += [(300, "", 0), (301, None, 0), (302, "idiot " * 50_000, 1)]
    s = toxicity.Settings(epochs=5, least_rows=3)
    texts = spark.createDataFrame([(i, t or "", y) for i, t, y in rows], "k long, t string, y int").repartition(3).select("k", "y", "t")
    model = toxicity.fit(texts, s)

    def terms(t):
        return [zlib.crc32(x.encode()) % s.buckets for w in re.findall(r"[^\W\d_]+", (t or "").lower()) for x in (w, *(w[:n] + "\x01" for n in s.prefixes if len(w) > n))]

    counts = {}
    for _, t, y in rows:
        for h in set(terms(t)):
            counts.setdefault(h, [0, 0])[y] += 1
    neg, pos = sum(y == 0 for *_, y in rows), sum(y == 1 for *_, y in rows)
    chi = {h: (b * neg - a * pos) ** 2 * (neg + pos) / ((a + b) * (neg + pos - a - b + 1) * neg * pos) for h, (a, b) in counts.items() if a + b >= s.least_rows}
    assert set(model.terms.tolist()) == {h for h, c in chi.items() if c >= s.least_chi} and len(model.terms) > 5
    monkeypatch.setattr(toxicity, "MOST_CACHED", 2)
    got = {r["i"]: r["score"] for r in toxicity.score(spark.createDataFrame([(i, t) for i, t, _ in rows], "i long, text string"), model).collect()}
    for i, t, _ in rows:
        x = {}
        for h in terms(t):
            if h in model.terms:
                x[h] = x.get(h, 0) + 1
        at = {h: list(model.terms).index(h) for h in x}
        x = {h: 1 + math.log(c) for h, c in x.items()}
        margin = model.bias + sum(model.weights[at[h]] * v for h, v in x.items())
        for a in x:
            for b in x:
                if at[a] < at[b]:
                    margin += float(model.factors[at[a]] @ model.factors[at[b]]) * x[a] * x[b]
        assert got[i] == pytest.approx(1 / (1 + math.exp(-max(-40, min(40, margin)))), abs=1e-9)


def test_toxicity_on_held_out_rows(spark, sf, docs, none):
    d = sf.replace("sf0.001", "sf0.01")
    labels = spark.read.parquet(f"{d}/labels.parquet")
    got = toxicity.scores(spark.read.parquet(f"{d}/documents.parquet"), labels)
    held = got.join(labels, "doc_id").where("held_out").toPandas()
    pos, neg = held[held.toxic == 1].score, held[held.toxic == 0].score
    assert len(held) > 80 and np.mean([(p > neg).mean() + (p == neg).mean() / 2 for p in pos]) > 0.85 and (neg >= 0.7).mean() < 0.03
    assert got.agg(F.min("score"), F.max("score")).first()[0] >= 0
    odd = toxicity.scores(docs, labels.limit(0)).collect()
    assert len(odd) == docs.count() and all(0 <= r["score"] <= 1 for r in odd)
    assert toxicity.scores(none, labels).count() == 0 and toxicity.reject(docs, labels.limit(0)).count() == docs.count()


def test_labels_of_held_out_rows_are_never_seen(spark, sf):
    d = spark.read.parquet(f"{sf}/documents.parquet")
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    turned = labels.withColumn("toxic", F.when(toxicity.held_out(F.col("doc_id")), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    a, b = (sorted(map(tuple, toxicity.scores(d, x).collect())) for x in (labels, turned))
    assert a == b


# 6


def test_surrogates(spark, none):
    a = [
        "Mail Anna.B@mail1.example.com or ANNA.B@MAIL1.EXAMPLE.COM now; not a@b. But -c.d@mail1.example.com",
        "Call +1 (553) 555-5580. Again: +1 553 555 5580! Or (553) 555-5580; version 2.0.1 and 1.2.3.4.5 stay, 300.1.1.1 too.",
        "Card 4111 1111 1111 1111 and 4111111111111111, but 4111111111111112 has a wrong digit.",
        "From 10.20.30.40. And again 10.20.30.40, then 10.20.30.41",
        "Mr. John Smith met Frau Erika Muster and Господин Иван Петров; Mr. John Smith left. Misty Mountain.",
        "SSN 123-45-6789, IBAN DE89 3704 0044 0532 0130 00.", None, "", "nothing here", "nothing here \u0001\u0002 \u0001 x",
    ]
    rows = [(i, t, "en", "s", len(t or "")) for i, t in enumerate(a)] + [(0, a[0], "en", "s", 1), (None, a[3], "en", "s", 1)]
    df = spark.createDataFrame(rows, DOCS).withColumns({c: F.lit(1) for c in ("_PIECES", "_row", "_there", "_surrogates", "_replaced", "row", "at", "value", "sur", "kind", "n", "subs", "_sig", "_subs", "_n", "matches")})
    out = pii.replace(df, "k1", counted="n")
    assert out.columns == [*df.columns, "__n"]
    got = {r["doc_id"]: r for r in out.collect()}
    t = {i: r["text"] for i, r in got.items()}
    assert out.count() == len(rows) and t[6] is None and t[7] == "" and t[8] == a[8] and t[9] == a[9] and t[None] == t[3]
    m = re.fullmatch(r"Mail (\S+@\S+) or (\S+@\S+) now; not a@b\. But -(\S+)", t[0])
    assert m[1].lower() != "anna.b@mail1.example.com" and m[2] == m[1].upper() and re.fullmatch(r"[A-Z][a-z]{3}\.[A-Z]@[a-z]{4}\d\.[a-z]{7}\.com", m[1])
    assert m[3].split("@")[1] == m[1].split("@")[1] and "example" not in m[3]
    m = re.fullmatch(r"Call (\+1 \(\d{3}\) \d{3}-\d{4})\. Again: (\+1 \d{3} \d{3} \d{4})! Or (\(\d{3}\) \d{3}-\d{4}); version 2\.0\.1 and 1\.2\.3\.4\.5 stay, 300\.1\.1\.1 too\.", t[1])
    assert re.sub(r"\D", "", m[1]) == re.sub(r"\D", "", m[2]) == "1" + re.sub(r"\D", "", m[3]) != "15535555580"
    m = re.fullmatch(r"Card (4\d{3} \d{4} \d{4} \d{4}) and (4\d{15}), but 4111111111111112 has a wrong digit\.", t[2])
    digits = [int(c) for c in m[2]]
    assert m[1].replace(" ", "") == m[2] != "4111111111111111" and sum(d if i % 2 else (2 * d - 9 * (d > 4)) for i, d in enumerate(digits)) % 10 == 0
    m = re.fullmatch(r"From ([\d.]+)\. And again ([\d.]+), then ([\d.]+)", t[3])
    assert m[1] == m[2] != m[3] and "10.20.30.40" not in t[3]
    m = re.fullmatch(r"Mr\. (\w+ \w+) met Frau (\w+ \w+) and Господин (\w+ \w+); Mr\. (\w+ \w+) left\. Misty Mountain\.", t[4])
    assert m[1] == m[4] and m[1].split()[0] in pii.GIVEN["male", "latin"] and m[2].split()[0] in pii.GIVEN["female", "latin"] and m[3].split()[0] in pii.GIVEN["male", "cyrillic"]
    m = re.fullmatch(r"SSN \d{3}-\d{2}-\d{4}, IBAN (DE\d\d \d{4} \d{4} \d{4} \d{4} \d\d)\.", t[5])
    iban = m[1].replace(" ", "")
    assert "123-45-6789" not in t[5] and int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97 == 1
    assert [got[i]["__n"] for i in range(10)] == [3, 3, 2, 3, 4, 2, 0, 0, 0, 0]
    again = {r["doc_id"]: r["text"] for r in pii.replace(df, "k1").collect()}
    other = {r["doc_id"]: r["text"] for r in pii.replace(df, "k2").collect()}
    assert again == t and other[3] != t[3]
    assert pii.replace(none, "k").count() == 0


def test_names_share_their_parts(spark):
    texts = ["Mr John Smith met Mr Smith.", "Mrs. SMITH and Dr John Smith", "Mr John Brown", "Herr Ludwig van Beethoven; Herr van Beethoven", "Prof. Kim Lee or Frau Kim Lee"]
    got = [r["text"] for r in pii.replace(spark.createDataFrame(list(enumerate(texts)), "i long, text string"), "k").orderBy("i").collect()]
    a = re.fullmatch(r"Mr (\S+) (\S+) met Mr (\S+)\.", got[0])
    b = re.fullmatch(r"Mrs\. (\S+) and Dr (\S+) (\S+)", got[1])
    c = re.fullmatch(r"Mr (\S+) (\S+)", got[2])
    d = re.fullmatch(r"Herr (\S+) van (\S+); Herr van (\S+)", got[3])
    e = re.fullmatch(r"Prof\. (\S+) (\S+) or Frau (\S+) (\S+)", got[4])
    assert a[2] == a[3] == b[3] and b[1] == a[2].upper() and b[2] == a[1] == c[1] and c[2] != a[2] and d[2] == d[3] and e.groups()[:2] == e.groups()[2:]
    assert e[1] in pii.GIVEN["female", "latin"]


def slow_entities(text):
    """(start, end, kind, key) of each entity by another regular expression engine; equal keys are one entity."""
    import regex

    out = []
    for m in regex.finditer(pii.ANY.replace(r"\p{IsCyrillic}", r"\p{Cyrillic}"), text or ""):
        v = m[0]
        kind = next((k for k, p in pii.KINDS.items() if k != "email" and regex.fullmatch(p, v)), "email" if "@" in v else None)
        if kind == "card":
            d = [int(c) for c in re.sub(r"\D", "", v)][::-1]
            if sum(x if i % 2 == 0 else 2 * x - 9 * (2 * x > 9) for i, x in enumerate(d)) % 10:
                continue
        if kind == "email" and not re.search(r"[^.]@.*\.[A-Za-z][A-Za-z0-9-]+$", v):
            continue
        digits = re.sub(r"\D", "", v)
        if kind == "phone" and len(digits) == 11 and digits[0] == "1":
            digits = digits[1:]
        key = digits if kind in ("phone", "card", "ssn") else v.lower().lstrip("._%+-") if kind == "email" else v.replace(" ", "") if kind == "iban" else re.sub(r"^\S+\s+", "", v.lower()) if kind in pii.TITLES else v
        out.append((m.start(), m.end(), kind, key))
    return out


def test_surrogates_against_a_plain_search(spark):
    """Random texts: what is between entities stays, one entity has one surrogate, different ones differ."""
    rng = random.Random(17)
    n = lambda k: "".join(rng.choice("0123456789") for _ in range(k))
    make = [
        lambda: f"{rng.choice(['ann', 'Bob.C', 'x_1', '-dan'])}{rng.randrange(30)}@{rng.choice(['a.org', 'mail.b.com', 'c-d.net', 'E.ORG'])}", lambda: f"10.{rng.randrange(300)}.0.{rng.randrange(9)}", lambda: f"{n(3)}-{n(2)}-{n(4)}",
        lambda: f"+1 {n(3)} 555 {n(4)}", lambda: f"({n(3)}) 555-{n(4)}", lambda: f"+49 30 {n(6)}", lambda: n(16), lambda: "4111 1111 1111 1111", lambda: f"DE{n(2)} {n(4)} {n(4)} {n(4)} {n(4)} {n(2)}",
        lambda: f"{rng.choice(['Mr', 'Mr.', 'Herr'])} {rng.choice(['John', 'Paul', 'Adam'])} {rng.choice(['Smith', 'Brown', 'Stone'])}", lambda: f"Mrs {rng.choice(['Ada', 'Eve'])} {rng.choice(['Smith', 'Lane'])}", lambda: "a@b", lambda: "1.2.3", lambda: "plain words", lambda: "é", lambda: "(1) 2 3 4",
    ]
    texts = [" , ".join(rng.choice(make)() for _ in range(rng.randrange(0, 12))) for _ in range(150)]
    got = {r["i"]: r for r in pii.replace(spark.createDataFrame(list(enumerate(texts)), "i long, text string"), "k", counted="n").collect()}
    put = {}
    for i, t in enumerate(texts):
        found = slow_entities(t)
        assert got[i]["n"] == len(found), t
        at, pattern = 0, ""
        for a, b, *_ in found:
            pattern, at = pattern + re.escape(t[at:a]) + "(.+?)", b
        m = re.fullmatch(pattern + re.escape(t[at:]), got[i]["text"])
        assert m, (t, got[i]["text"])
        for (a, b, kind, key), new in zip(found, m.groups()):
            for _, _, k, same in slow_entities(new):
                assert k == kind
                new = same
            assert put.setdefault((kind, key), new) == new and new != key
    assert len(set(put.values())) == len(put) and not {v for (_, v) in put} & set(put.values())


def test_long_entities_and_runs(spark):
    """No stack and no more time than a text's length asks for, whatever repeats in it."""
    long = ["x@" + "a." * k + "com" for k in (2_000, 20_000, 200_000)] + ["a" * 300_000 + "@b.com", "Mr " + "A" * 300_000, "." * 100_000 + "a@b.com"]
    none = ["1 " * 100_000, "+" * 100_000 + "@x.com", "1-" * 100_000, "(5) " * 50_000, "@" * 200_000, "a@" * 100_000, "Mr " * 100_000, "1" + " " * 200_000, "1." * 100_000, "AB1 " * 40_000 + "é", "x@" + "a-" * 100_000]
    got = {r["i"]: r for r in pii.replace(spark.createDataFrame(list(enumerate(long + none)), "i long, text string"), "k", counted="n").collect()}
    for i, t in enumerate(long):
        assert got[i]["n"] == 1 and got[i]["text"] != t and ("@" not in t or len(got[i]["text"]) == len(t))
    assert [got[len(long) + i]["text"] == t for i, t in enumerate(none)] == [True] * len(none)


def test_surrogates_stay_distinct_when_candidates_collide(spark):
    """Many entities of few surrogates: every draw collides often, and real entities are no surrogates."""
    rows = [("given", "male latin", f"n{i}") for i in range(90)] + [("given", "male latin", "adam"), ("given", "male latin", "paul")]
    rows += [("mailbox", "a.com", c) for c in "abcdefghijklmnopqrstuvwxyz0123456789"] + [("host", "", f"{c}.com") for c in "abcdefghijklmnopqrstuvwxyz"]
    got = pii.surrogates(spark.createDataFrame(rows, "kind string, scope string, canon string"), "k").collect()
    assert sorted((r["kind"], r["scope"], r["canon"]) for r in got) == sorted(rows)
    assert len({(r["kind"], r["scope"], r["sur"]) for r in got}) == len(rows) and not {(r["kind"], r["scope"], r["sur"]) for r in got} & set(rows)


def test_first_look_passes_whatever_is_an_entity(spark):
    texts = ["+12345", "+1 2345", "+1 (5) 23 45", "(553) 555-5580", "553-555-5580", "a@b.example", "1" * 13, "123-45-6789", "1.2.3.4", "100.20.30.40", "DE89 3704 0044 0532 0130 00", "DE89370400440532"]
    texts += [f"{t}{dot} Erika" for titles in pii.TITLES.values() for t in titles for dot in ("", ".")]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    assert [r["text"] for r in df.where(F.col("text").rlike(pii.ANY) & pii.pieces(F.col("text")).isNull()).collect()] == []
    assert df.where(F.col("text").rlike(pii.ANY)).count() == len(texts)


# 7


def slow_signature(text):
    codes = [int(c) for c in orderhash.kmers(text)]
    seen, numbered = {}, []
    for c in codes:
        n = seen.get(c, 0)
        seen[c] = n + 1
        numbered.append(c if not n else int(orderhash._mix(np.array([c], np.uint64) + np.array([n], np.uint64) * orderhash._BASE)[0]))
    out = []
    for x, o in zip(orderhash._XOR.tolist(), orderhash._ODD.tolist()):
        ranked = sorted(range(len(codes)), key=lambda i: (((numbered[i] >> 32) ^ x) * o % (1 << 32), i))[: orderhash.TUPLE]
        v = np.zeros(1, np.uint64)
        for i in sorted(ranked):
            v = orderhash._mix(v * orderhash._BASE + np.array([codes[i]], np.uint64) + np.uint64(1))
        out.append(max(1, int(v[0]) >> 32) if codes else 0)
    return out


def test_signature_against_plain_loops(monkeypatch):
    rng = random.Random(4)
    texts = ["", "a", "short", "exactly8", "abab" * 30, words(rng, 80), "é漢☃" * 40]
    for block in (8_192, 16):
        monkeypatch.setattr(orderhash, "_BLOCK", block)
        for t in texts:
            assert orderhash.signature(t).tolist() == slow_signature(t)
    a = words(rng, 300)
    moved = a[len(a) // 2 :] + a[: len(a) // 2]
    near = a[:500] + "edit" + a[500:]
    like = lambda x, y: orderhash.likeness(orderhash.signature(x), orderhash.signature(y))
    assert like(a, near) > 0.85 > like(a, moved) and like(a, words(rng, 300)) < 0.2 and like("", "") == 1


def test_pairs_take_the_next_document_in_falling_order(spark, docs, none):
    def check(rows, got):
        order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0)))
        left = sorted(got, key=lambda r: (r["doc_id"] is None, -(r["doc_id"] or 0)))
        assert len(left) == len(order)
        for n, (i, t) in enumerate(order):
            t, nxt = t or "", order[(n + 1) % len(order)][1] or ""
            half = len(t) // 2
            edited = t[: len(t) - half] + nxt[:half]
            r = left[n]
            assert (r["doc_id"], r["n_chars"]) == (i, len(t)) and r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
            assert r["fingerprint"] == orderhash.written(orderhash.signature(t)) and r["edited_fingerprint"] == orderhash.written(orderhash.signature(edited))
            assert r["near_next"] == orderhash.likeness(orderhash.signature(t), orderhash.signature(nxt))

    rng = random.Random(2)
    for n in (1, 2, 90):
        rows = [(7 * i - 40, words(rng, rng.choice([0, 1, 5, 30]))) for i in range(n)]
        rng.shuffle(rows)
        check(rows, orderhash.pairs(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect())
    assert orderhash.pairs(docs).count() == docs.count() and orderhash.pairs(none).count() == 0


def test_pairs_of_any_key_with_copies(spark):
    """String, date and null keys; rows of one key by hash and text; a key and a text that many rows repeat."""
    import datetime

    rng = random.Random(6)
    names = [f"d{i}" for i in range(40)] + ["é", "", "Z" * 50]
    for keys in (names, [datetime.datetime(2000, 1, 1) + datetime.timedelta(i) for i in range(30)], [(1 << 60) + i for i in range(30)]):
        rows = [(k, words(rng, rng.choice([0, 4, 20]))) for k in keys] + [(keys[3], words(rng, 5)) for _ in range(60)] + [(keys[5], "the same words")] * 90 + [(None, "x y z " + str(i)) for i in range(3)] + [(None, None)] * 2
        rng.shuffle(rows)
        kind = {"str": "string", "int": "long"}.get(type(keys[0]).__name__, "timestamp")
        df = spark.createDataFrame(rows, f"doc_id {kind}, text string")
        h = {(r["t"]): r["h"] for r in df.select(F.coalesce("text", F.lit("")).alias("t"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("h")).collect()}
        known = sorted((r for r in rows if r[0] is not None), key=lambda r: (h[r[1] or ""], r[1] or ""))
        order = [r for k in sorted({r[0] for r in known}, reverse=True) for r in known if r[0] == k] + sorted((r for r in rows if r[0] is None), key=lambda r: (h[r[1] or ""], r[1] or ""))
        want = []
        for n, (k, t) in enumerate(order):
            t, nxt = t or "", order[(n + 1) % len(order)][1] or ""
            half = len(t) // 2
            want.append((str(k), len(t), hashlib.sha256((t[: len(t) - half] + nxt[:half]).encode()).hexdigest(), orderhash.likeness(orderhash.signature(t), orderhash.signature(nxt))))
        got = [(str(r["doc_id"]), r["n_chars"], r["edited_sha256"], r["near_next"]) for r in orderhash.pairs(df.repartition(3)).collect()]
        assert sorted(got) == sorted(want)


# 8


def slow_verdict(url, rules, listed):
    host = path = ""
    if url and "://" in url:
        m = re.match(r"([^/?#]*)([^?#]*)", url.split("://", 1)[1], re.S)
        host, path = "".join(c.lower() if c.isascii() else c for c in m[1]), m[2]
    best = None
    for text, what in rules:
        h, s, p = text.partition("/")
        if (host == h or host.endswith("." + h)) and path.startswith(s + p) and (best is None or len(text) > len(best[0])):
            best = (text, what)
    site = ".".join(host.split(".")[-3:])
    return host, path, best and best[0], best[1] if best else "block" if site in listed else "allow"


def test_urls_against_plain_rules(spark):
    rng = random.Random(3)
    bits = ["http://", "HTTPS://", "", "ftp://x://"], ["m.", "www.", "A.b.", ""], ["spam-farm", "good", "free-bets", "ORG"], [".example", ""], [".com", ".org", ".net", ""], ["/fr/1", "/de/", "/es/9?x=/", "/en/17#a", "/", "", "?q", "#f", "/en/2://y"]
    rows = [(i, "".join(rng.choice(b) for b in bits)) for i in range(400)] + [(400, None), (401, ""), (402, "://"), (402, "://"), (None, "http://a.org/\nx")]
    df = spark.createDataFrame([(*r, "h", "mine") for r in rows], "page_id long, url string, html string, host string")
    listed = {f"{n}.{e}" for n in urls.LISTED_NAMES for e in urls.LISTED_ENDINGS}
    rows += [(403, "http://" + "a." * 100_000 + "spam-farm.example.com/" + "x" * 100_000), (404, "://" * 60_000)]
    df = spark.createDataFrame([(*r, "h", "mine") for r in rows], "page_id long, url string, html string, host string")
    for most in (10**6, 2):  # one cascade, and several
        out = urls.judge(df, urls.production_list(spark), per_cascade=most)
        assert out.columns == ["page_id", "url", "html", "host", "_host", "path", "rule", "verdict"] and out.count() == len(rows)
        for r in out.collect():
            assert (r["_host"], r["path"], r["rule"], r["verdict"]) == slow_verdict(r["url"], urls.RULES, listed), r["url"]
    assert urls.judge(df.limit(0), urls.production_list(spark)).count() == 0


def test_cascades_are_exact_over_their_universe(spark):
    universe = spark.range(20_000).select(F.concat(F.lit("site"), "id").alias("key"))
    listed = universe.where("key like '%7'").unionByName(spark.createDataFrame([("elsewhere",), (None,)], "key string"))
    (c,) = urls.cascades(universe, listed)
    assert len(c.levels) > 2 and sum(x.bits for x in c.levels) < 10 * 2_000
    assert universe.where(c.holds(F.col("key")) != F.col("key").endswith("7")).count() == 0
    parts = urls.cascades(universe, listed, per_cascade=700)
    assert len(parts) == 3 and sum(universe.where((urls.segment(F.col("key"), 3) == i) & (p.holds(F.col("key")) != F.col("key").endswith("7"))).count() for i, p in enumerate(parts)) == 0
    assert [c.levels for c in urls.cascades(universe, listed.limit(0))] == [[]]


# 9


def test_main_text(spark, sf):
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    w = htmltext.fit(pages)
    import html

    for r in pages.collect():
        body = re.search(r"<article>(.*)</article>", r["html"], re.S)[1]
        want = "\n".join(x for x in (" ".join(html.unescape(re.sub("<[^>]*>", " ", b)).split()) for b in re.split(r"</?(?:h1|p)>", body)) if x)
        assert htmltext.extract(r["html"], w) == want
    page = """<html><head><title>T</title></head><body><header>Top words here</header><nav><a href=x>Menu one</a></nav><div id="main"><h1>Head &amp; line</h1>
    <p>First  para <b>bold</b>&nbsp;end<p>Second &lt;para&gt;<aside>side words not here</aside><div class="advert">buy this now please</div><p>Third<br>line</p><form><p>your name please</p></form>
    <script>var x = "<p>no</p>";</script><!-- <p>hidden</p> --></div><section class="comments"><p>A reader says many words here today</p></section><footer>Foot words</footer></body></html>"""
    assert htmltext.extract(page, w) == "Head & line\nFirst para bold end\nSecond <para>\nThird line"
    assert htmltext.extract("", w) == "" and htmltext.extract("<nav>a b c</nav>", w) == "" and htmltext.extract("just words", w) == "just words"
    assert htmltext.extract("<p>cut off <a hre", w) == "cut off"
    odd = spark.createDataFrame([(1, "u", None), (1, "u", None), (None, None, "<p>x"), (2, "v", "<p>" + "word " * 200_000)], "page_id long, url string, html string")
    assert sorted(r["n_chars"] for r in htmltext.texts(odd, w).collect()) == [0, 0, 1, 999_999]
    assert htmltext.texts(odd.limit(0)).count() == 0 and htmltext.fit(odd.limit(0)).tags == {}
    clash = htmltext.add_text(odd.withColumn("text", F.lit("mine")), w)
    assert clash.columns[-2:] == ["text", "_text"]


def test_main_text_in_wrappers_named_like_sides():
    w = htmltext.Weights()
    text = "<p>First words of it</p><p>Second words of it</p>"
    want = "First words of it\nSecond words of it"
    for about in ("class='container with-sidebar'", "id='search-results'", "class='post tag-economy'", "class='sidebar'", "class=modal role=complementary"):
        for inner in (text, f"<article>{text}</article>", f"<main>{text}</main>"):
            page = f"<nav>Menu</nav><div {about}>{inner}</div><div class='ad'><p>buy</p></div>"
            assert htmltext.extract(page, w) == want, page
    assert htmltext.extract(f"<form id=f>{text}</form>", w) == want
    assert htmltext.extract("<div class='search'>All that is said<br>without paragraphs</div><div class=menu><a>x</a></div>", w) == "All that is said without paragraphs"
    cards = "<div class='related'><article><p>card</p></article></div>"
    assert htmltext.extract(f"<div class='sidebar'><article>{text}{cards}</article></div>{cards}", w) == want
    for gap in ("<svg class='icon'/>", "<math/>", "<object>", "<canvas>", "<noscript>", "<svg>", "<svg><path/></svg>", "<noscript>no</noscript>"):
        assert htmltext.extract(text.replace("</p><p>", f"</p>{gap}<p>"), w) == want, gap
    assert htmltext.extract("<p>Sum <math><mi>x</mi><mo>=</mo><mn>2</mn></math> holds</p>", w) == "Sum x=2 holds"
    assert htmltext.extract(text + "<script>var x", w) == want


def test_main_text_comes_from_the_region(spark, sf, monkeypatch):
    """With the whole page for the region, most pages change: nothing but the scores leaves words out."""
    pages = [r["html"] for r in spark.read.parquet(f"{sf}/pages.parquet").collect()]
    w = htmltext.learn(pages)
    with monkeypatch.context() as m:
        texts = [htmltext.extract(h, w) for h in pages]
        m.setattr(htmltext, "region", lambda found, scores: found)
        assert sum(htmltext.extract(h, w) != t for h, t in zip(pages, texts)) > 0.9 * len(pages)
    body = "".join(f"<p>{words(random.Random(i), 30)}</p>" for i in range(4))
    want = "\n".join(re.findall("<p>(.*?)</p>", body))
    for page in ('<div class="content with-sidebar">%s</div>', '<div class="post tags-on">%s</div>', '<section class="social-studies">%s</section>', "<form><article>%s</article></form>", '<form action="x"><div>%s</div></form>'):
        page = "<body><nav><ul><li><a href=x>Menu</a></li></ul></nav>" + page % body + "<div class='ad'>Buy this.</div><footer>Foot words</footer></body>"
        assert htmltext.extract(page, w) == htmltext.extract(page, htmltext.Weights()) == want, page
    # learned: a class that only labelled pages tell to be an advert
    odd = [f"<article><p>{words(random.Random(i), 40)}</p></article><div class='zq'><p>{words(random.Random(-i), 9)}</p></div>" for i in range(30)]
    page = f"<div>{body}</div><div class='zq'><p>{words(random.Random(1), 9)}</p></div>"
    assert htmltext.extract(page, htmltext.learn(odd)) == want != htmltext.extract(page, htmltext.Weights())


def test_main_text_takes_time_in_proportion():
    import time

    w = htmltext.Weights()
    n = 20_000
    hostile = ["<div>" * n + "</span>" * n, "<b>" * n + "<i>" * n, "<a \"" * n, "<a '" * n, "<!" * n, "<div class=ad>" * n + "x", "<p><b>" * n, "<" * n, "<li><ul>" * n, "<div class='" + "c " * n + "'>" * 3, "<form>" * n + "<p>x</p>" * 9, "<article>" * n + "x", "<svg>" * n, "&" * n, "<aside>" * n + "</aside>" * n]
    for page in hostile:
        start = time.perf_counter()
        htmltext.extract(page, w)
        htmltext.extract(page + page, w)
        assert time.perf_counter() - start < 6, page[:20]


def test_best_region_against_all_runs():
    rng = random.Random(5)
    for _ in range(200):
        s = [rng.randrange(-5, 6) for _ in range(rng.randrange(0, 15))]
        a, b = htmltext.best_run([float(x) for x in s])
        assert sum(s[a:b]) == max([0, *(sum(s[i:j]) for i in range(len(s)) for j in range(i + 1, len(s) + 1))])


# 10


def der(tag, *parts):
    body = b"".join(parts)
    n = len(body)
    return bytes([tag]) + (bytes([n]) if n < 128 else bytes([0x80 + (n.bit_length() + 7) // 8]) + n.to_bytes((n.bit_length() + 7) // 8, "big")) + body


def key_bytes():
    rng = random.Random(1)
    big = lambda n: der(2, bytes([1 + rng.randrange(100)] + [rng.randrange(256) for _ in range(n)]))
    rsa = der(0x30, der(2, b"\0"), *[big(40) for _ in range(8)])
    return rsa, der(0x30, der(2, b"\0"), der(0x30, der(6, b"\x2a\x86\x48"), der(5)), der(4, rsa)), der(0x30, der(2, b"\1"), der(4, bytes(range(32))), der(0xA0, der(6, b"\x2a\x86")))


def ssh_key():
    s = lambda b: len(b).to_bytes(4, "big") + b
    return b"openssh-key-v1\0" + s(b"none") + s(b"none") + s(b"") + (1).to_bytes(4, "big") + s(b"public" * 5) + s(b"private" * 9)


def token(alg=True):
    e = lambda x: base64.urlsafe_b64encode(json.dumps(x).encode()).rstrip(b"=").decode()
    return f"{e({'alg' if alg else 'x': 'HS256'})}.{e({'sub': '1'})}.c2lnbmF0dXJl"


def test_confirmed_secrets():
    kinds = lambda t: [(k, t[a:b]) for k, a, b in secrets.spans(t)[1] if k in ("jwt", "key", "pem")]
    for raw in (*key_bytes(), ssh_key()):
        b64 = base64.b64encode(raw).decode()
        assert kinds(f"see {b64} there") == [("key", b64)]
        assert kinds(f"hex {raw.hex()} there") == [("key", raw.hex())]
        twice = base64.b64encode(b64.encode()).decode()
        assert kinds(twice) == [("key", twice)]
        lines = "\n".join(b64[i : i + 64] for i in range(0, len(b64), 64))
        pem = f"-----BEGIN PRIVATE KEY-----\n{lines}\n-----END PRIVATE KEY-----"
        assert kinds("a " + pem + " b") == [("pem", pem)]
        cut = base64.b64encode(raw[:-3]).decode()
        assert kinds(cut) == [] and kinds(pem.replace(lines, cut)) == []
    t = token()
    assert kinds(f'x="{t}"') == [("jwt", t)] and kinds(token(False)) == [] and kinds("eyJhbGciOiJ.abc.def") == []
    assert kinds("A" * 200) == [] and kinds(base64.b64encode(b"plain words of some length, nothing more than that").decode()) == []


def test_confirmed_secrets_in_other_forms():
    kinds = lambda t: [(k, t[a:b]) for k, a, b in secrets.spans(t)[1] if k in ("jwt", "key", "pem")]
    for raw in (*key_bytes(), ssh_key()):
        b64 = base64.b64encode(raw).decode()
        for body, size in ((b64, 64), (raw.hex(), 64)):
            lines = [body[i : i + size] for i in range(0, len(body), size)]
            if len(lines) > 1 and len(lines[-1]) < size:
                for br in ("\n", "\r\n", "\\n", "\n  "):
                    t = br.join(lines)
                    assert kinds(f"so\n{t}\nThen words") == [("key", t)], t
        pem = "-----BEGIN RSA PRIVATE KEY-----\\n" + "\\n".join(b64[i : i + 64] for i in range(0, len(b64), 64)) + "\\n-----END RSA PRIVATE KEY-----\\n"
        assert kinds('{"key": "' + pem + '"}') == [("pem", pem[:-2])]
        inner = base64.b64encode("é ".encode() + b64.encode()).decode()
        assert kinds(inner) == [("key", inner)]
        deep = b64
        for _ in range(5):
            deep = base64.b64encode(deep.encode()).decode()
        assert kinds(deep) == [("key", deep)]
        broken = pem.replace("END RSA", "END EC")
        assert [k for k, _ in kinds(broken)] in ([], ["key"])


def test_secrets_take_time_in_proportion():
    import time

    rsa = base64.b64encode(key_bytes()[0]).decode()
    pem = f"-----BEGIN PRIVATE KEY-----\n{rsa}\n-----END PRIVATE KEY-----\n"
    for t in ("-----BEGIN RSA PRIVATE KEY-----" * 8_000, "-----BEGIN RSA PRIVATE KEY-----\n" * 8_000, pem * 1_000, (rsa + " ") * 1_000, "eyJ" * 80_000, "eyJa.eyJb." * 20_000, "password" + " " * 200_000, "0f" * 100_000, ("A" * 40 + "\n") * 5_000, ("A" * 40 + " ") * 5_000, "AKIA" * 50_000, "A" * 250_000, "-" * 250_000, "-----BEGIN " * 20_000):
        start = time.perf_counter()
        secrets.spans(t + t)
        assert time.perf_counter() - start < 8, t[:30]


def slow_base(text):
    out = []
    rules = {"assign": (re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A), lambda m: len(m[2]) >= 6), "access": (re.compile("AKIA[A-Z0-9]+"), lambda m: len(m[0]) >= 20), "hex": (re.compile("[0-9a-f]+"), lambda m: len(m[0]) >= 24)}
    for n, (kind, (p, good)) in enumerate(rules.items()):
        out += [(m.start(), n, f"{kind}:{m.start()}:{m.end()}") for m in p.finditer(text or "") if good(m)]
    return ",".join(x for *_, x in sorted(out))


def test_base_spans(spark, docs, none):
    rng = random.Random(4)
    bits = ["password", "Token", "API_KEY", "apikey", "secret", "PassWd", "=", ":", " ", '"', "'", "abc", "x1y2z3w4", "AKIA", "AKIA" + "Q" * 17, "0f" * 13, "é", "ſecret", "\n", "-", "deadbeef"]
    rows = [(i, "".join(rng.choice(bits) for _ in range(rng.randrange(1, 40)))) for i in range(400)]
    for r in secrets.digests(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        want = slow_base(rows[r["doc_id"]][1])
        assert r["base_sha256"] == hashlib.sha256(want.encode()).hexdigest() and set(want.split(",")) <= set(r["spans"].split(","))
    assert secrets.digests(docs).count() == docs.count() and secrets.digests(none).count() == 0
    found = secrets.scan(docs.withColumn("secrets", F.lit(1)))
    assert found.columns[-1] == "_secrets"


# All


def slow_leaks(text, items):
    """Whether an item lies in the text with a tenth of its bytes edited at most: the whole table of distances, for the
    items that share eight bytes in a row with the text (fewer edits than a ninth of the bytes leave such a run)."""
    b = decontaminate.normal(text or "")
    whole = b.tobytes()
    for a in items:
        raw = a.tobytes()
        if len(a) < 40:
            if f" {raw} " in f" {whole} ":
                return True
            continue
        if not any(raw[i : i + 8] in whole for i in range(len(raw) - 7)):
            continue
        at = np.arange(len(b) + 1)
        row = np.zeros(len(b) + 1, np.int64)
        for i, c in enumerate(a, 1):
            new = np.concatenate([[i], np.minimum(row[1:] + 1, row[:-1] + (b != c))])
            row = np.minimum.accumulate(new - at) + at
        if row.min() <= len(a) // 10:
            return True
    return False


def test_pipeline_against_brute_force(spark, sf):
    """Every stage's rows by all pairs of sets, whole tables of distances, a plain search of entities and tiktoken."""
    import corpus_pipeline

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert [len(x) for x in corpus_pipeline.STAGES] == [2] * 5
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    scored = {r["doc_id"]: r["score"] for r in toxicity.scores(docs, spark.read.parquet(f"{sf}/labels.parquet")).collect()}
    left = sorted(i for i in texts if scored[i] < 0.7)
    roots = slow_alike([texts[i] for i in left])
    first = {}
    for i, r in zip(left, roots):
        first.setdefault(r, i)
    kept = sorted(first.values())
    items = [decontaminate.normal(r["text"]) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    kept = [i for i in kept if not slow_leaks(texts[i], items)]
    rows, stages = docs, []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        rows = stage(spark, rows, sf)
        stages.append(sorted(r["doc_id"] for r in rows.select("doc_id").collect()))
        assert rows.columns == docs.columns
    assert stages[0] == left and stages[1] == sorted(first.values()) and stages[2] == stages[3] == kept and 100 < len(kept) < len(left) < len(texts)
    new = {r["doc_id"]: r for r in rows.collect()}
    found = 0
    for i in kept:
        at, pattern = 0, ""
        for a, b, *_ in slow_entities(texts[i]):
            pattern, at, found = pattern + re.escape(texts[i][at:a]) + "(?!" + re.escape(texts[i][a:b]) + ").+?", b, found + 1
        assert re.fullmatch(pattern + re.escape((texts[i] or "")[at:]), new[i]["text"] or "", re.S), i
        assert new[i]["n_chars"] == len(new[i]["text"])
    assert found > 5
    got = {r["doc_id"]: r for r in corpus_pipeline.run(spark, sf).collect()}
    settings = bpe.production()
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(settings["rank_file"], "rb"))}
    enc = tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    assert sorted(got) == kept
    for i, r in got.items():
        assert list(r["ids"]) == enc.encode_ordinary(new[i]["text"]) and r["n_tokens"] == len(r["ids"])
        assert r["decoded_sha256"] == hashlib.sha256(new[i]["text"].encode()).hexdigest()


def test_pipeline_stages_take_columns_of_any_name(spark, sf):
    import corpus_pipeline

    clash = ("_k", "_sid", "_pieces", "_row", "sur", "score", "t", "k", "n", "sid", "root", "fp", "value", "at")
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(40).withColumns({c: F.lit(1) for c in clash})
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf)
        assert out.columns == docs.columns and 0 < out.count() <= 40


def test_pipeline_on_odd_rows(spark, tmp_path, docs):
    for name, df in {"documents": docs, "labels": spark.createDataFrame([], "doc_id long, quality int, toxic int"), "benchmark": spark.createDataFrame([], "item_id long, text string")}.items():
        df.write.parquet(str(tmp_path / f"{name}.parquet"))
    import corpus_pipeline

    got = [r["doc_id"] for r in corpus_pipeline.run(spark, str(tmp_path)).collect()]
    assert sorted(x for x in got if x is not None) == [1, 4, 7, 8, 9, 10] and got.count(None) == 1


def test_queries_are_all_there():
    assert {n.split("_")[0] for n in QUERIES} == {f"op{i}" for i in range(1, 11)} and set(SQL) <= set(QUERIES)
    assert os.path.exists(bpe.production()["rank_file"])


def test_pipeline_sends_small_batches_to_python(spark):
    import corpus_pipeline

    key, docs = "spark.sql.execution.arrow.maxRecordsPerBatch", spark.range(4_000).select(F.col("id").alias("doc_id"), F.lit("a b").alias("text")).coalesce(1)
    was = spark.conf.get(key)
    sizes = lambda: [r["n"] for r in docs.select("doc_id").mapInArrow(lambda batches: (b.from_pydict({"n": [b.num_rows]}) for b in batches), "n long").collect()]
    try:
        for given, most in (("10000", 1_000), ("3000", 3_000)):
            spark.conf.set(key, given)
            assert corpus_pipeline.tokens(spark, docs, "").count() == 4_000
            assert max(sizes()) == most and sum(sizes()) == 4_000
    finally:
        spark.conf.set(key, was)
