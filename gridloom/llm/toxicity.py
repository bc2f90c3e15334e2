"""Toxicity scores of a factorization machine over hashed terms."""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.llm.arrowtext import as_text, give_back, map_rows
from gridloom.runtime import free_name, quoted, table

_WORD = re.compile(r"[^\W\d_]+")
#: Words whose terms a worker remembers; the rest are hashed each time.
MOST_CACHED = 50_000


@dataclass
class Settings:
    """buckets: of the hash of a term. prefixes: lengths of the beginnings of words that are terms too (inflections).
    most_rows: labelled rows to learn from, those whose hashed key is least; the only bound on what is learned from.
    most_terms: terms kept, by chi-square over these rows, which must be least_chi (below, chance makes as many).
    factors: of each term. least_rows: a term must have."""

    buckets: int = 1 << 22
    prefixes: tuple[int, ...] = (3, 4, 5, 6, 7)
    most_rows: int = 20_000
    most_terms: int = 6_000
    least_rows: int = 4
    least_chi: float = 8.0
    factors: int = 4
    epochs: int = 30
    rate: float = 0.08
    decay: float = 2e-4
    seed: int = 7


@dataclass
class Model:
    """score = logistic(bias + sum w_i x_i + sum_{i<j} <v_i, v_j> x_i x_j), x being dampened counts of terms."""

    settings: Settings
    terms: np.ndarray = field(default_factory=lambda: np.empty(0, np.int64))
    weights: np.ndarray = field(default_factory=lambda: np.empty(0))
    factors: np.ndarray = field(default_factory=lambda: np.empty((0, 1)))
    bias: float = -2.0

    def features(self, text: str) -> tuple[list[int], list[float]]:
        """Places in ``terms`` and values: 1 + log of how often the words of a term occur."""
        where = self._where()
        found: dict[int, int] = {}
        for w, c in Counter(_WORD.findall(text.lower())).items():
            at = self._cache.get(w)
            if at is None:
                at = tuple(where[h] for h in word_hashes(w, self.settings) if h in where)
                if len(self._cache) < MOST_CACHED:
                    self._cache[w] = at
            for i in at:
                found[i] = found.get(i, 0) + c
        return list(found), [1 + math.log(c) for c in found.values()]

    def score(self, text: str) -> float:
        at, x = self.features(text)
        return float(1 / (1 + np.exp(-np.clip(self.margin(np.array(at, np.int64), np.array(x)), -40, 40))))

    def margin(self, at: np.ndarray, x: np.ndarray) -> float:
        if not len(at):
            return self.bias
        f = self.factors[at] * x[:, None]
        s = f.sum(0)
        return self.bias + float(self.weights[at] @ x) + 0.5 * float((s * s).sum() - (f * f).sum())

    def _where(self) -> dict[int, int]:
        if not hasattr(self, "_index"):
            self._index = {int(h): i for i, h in enumerate(self.terms)}
            self._cache: dict[str, tuple[int, ...]] = {}  # of words, their places in terms
        return self._index


def word_hashes(word: str, settings: Settings) -> list[int]:
    """The hashed terms of a word: the word itself and its beginnings, marked as such."""
    terms = [word, *(word[:n] + "\x01" for n in settings.prefixes if len(word) > n)]
    return [zlib.crc32(t.encode("utf-8", "replace")) % settings.buckets for t in terms]


def hashed(text: str, settings: Settings) -> set[int]:
    """The hashed terms of the words of a text."""
    return {h for w in set(_WORD.findall(text.lower())) for h in word_hashes(w, settings)}


def fit(texts: DataFrame, settings: Settings | None = None) -> Model:
    """A model from (k, t, y): key, whole text and label 0 or 1, of at most ``settings.most_rows`` rows.

    Counts of each term by label are summed on the executors; the best terms (a bounded number) and then each row's
    few values at them come to the driver. With rows of one label only, or none, every text gets that label's share.
    """
    settings = settings or Settings()

    def count():
        def step(columns):
            _, labels, bodies = columns
            total: dict[int, list[int]] = {}
            for y, t in zip(labels, bodies):
                for h in hashed(t, settings):
                    total.setdefault(h, [0, 0])[y] += 1
            return [list(total), [c[0] for c in total.values()], [c[1] for c in total.values()]]

        return step

    names = {"k": "k", "y": "y", "t": "t"}
    sums = {r["y"]: r["n"] for r in texts.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    neg, pos = sums.get(0, 0), sums.get(1, 0)
    model = Model(settings, bias=math.log((pos + 0.5) / (neg + 0.5)))
    if not neg or not pos:
        return model
    each = map_rows(texts, names, "h long, c0 long, c1 long", count).groupBy("h").agg(F.sum("c0").alias("a"), F.sum("c1").alias("b"))
    n = float(neg + pos)
    seen = F.col("a") + F.col("b")
    chi = F.pow(F.col("b") * F.lit(float(neg)) - F.col("a") * F.lit(float(pos)), 2) * n / (seen * (F.lit(n) - seen + 1) * float(neg) * float(pos))
    best = each.where(seen >= settings.least_rows).select("h", "a", "b", chi.alias("chi")).where(F.col("chi") >= settings.least_chi).orderBy(F.desc("chi"), "h").limit(settings.most_terms).collect()
    model.terms = np.array([r["h"] for r in best], np.int64)

    def values():
        def step(columns):
            keys, labels, bodies = columns
            got = [model.features(t) for t in bodies]
            return [keys, labels, [g[0] for g in got], [g[1] for g in got]]

        return step

    rows = map_rows(texts, names, f"k {texts.schema['k'].dataType.simpleString()}, y int, at array<int>, x array<float>", values).collect()
    rows.sort(key=lambda r: (str(r["k"]), r["y"], r["at"]))
    train(model, [np.array(r["at"], np.int64) for r in rows], [np.array(r["x"]) for r in rows], np.array([r["y"] for r in rows], float))
    return model


def train(model: Model, at: list[np.ndarray], x: list[np.ndarray], y: np.ndarray) -> None:
    """Logistic loss by AdaGrad over mini-batches; both labels weigh alike up to a factor of four."""
    s, m = model.settings, len(model.terms)
    rng = np.random.default_rng(s.seed)
    w, v, b = np.zeros(m), rng.normal(0, 0.05, (m, s.factors)), model.bias
    gw, gv, gb = np.full(m, 1e-3), np.full((m, s.factors), 1e-3), 1e-3
    weight = np.where(y == 1, min(4.0, max(1.0, (y == 0).sum() / max(1, (y == 1).sum()))), 1.0)
    rate = s.rate
    for _ in range(s.epochs):
        order = rng.permutation(len(y))
        for start in range(0, len(order), 128):
            part = order[start : start + 128]
            lens = np.array([len(at[i]) for i in part])
            row = np.repeat(np.arange(len(part)), lens)
            idx = np.concatenate([at[i] for i in part]) if lens.sum() else np.empty(0, np.int64)
            val = np.concatenate([x[i] for i in part]) if lens.sum() else np.empty(0)
            f = v[idx] * val[:, None]
            total = np.zeros((len(part), s.factors))
            np.add.at(total, row, f)
            square = np.bincount(row, (f * f).sum(1), len(part))
            margin = b + np.bincount(row, w[idx] * val, len(part)) + 0.5 * ((total * total).sum(1) - square)
            g = (1 / (1 + np.exp(-np.clip(margin, -40, 40))) - y[part]) * weight[part] / len(part)
            dw = np.bincount(idx, g[row] * val, m).astype(float)
            dv = np.zeros_like(v)
            np.add.at(dv, idx, (g[row] * val)[:, None] * (total[row] - f))
            hit = np.unique(idx)
            dw[hit] += s.decay * w[hit]
            dv[hit] += s.decay * v[hit]
            gw[hit] += dw[hit] ** 2
            gv[hit] += dv[hit] ** 2
            w[hit] -= rate * dw[hit] / np.sqrt(gw[hit])
            v[hit] -= rate * dv[hit] / np.sqrt(gv[hit])
            gb += g.sum() ** 2
            b -= rate * g.sum() / math.sqrt(gb)
        rate *= 0.93
    model.weights, model.factors, model.bias = w, v, float(b)


def score(docs: DataFrame, model: Model, text: str = "text", into: str = "score") -> DataFrame:
    """``docs`` with a score between 0 and 1 from the whole text, higher where label 1 is likelier.

    One pass, no shuffle; the model has at most ``most_terms`` terms and goes along with the task. Null and empty
    texts get the score of a text without a term. All columns pass; ``into`` gets underscores where it is taken.
    """
    from pyspark.sql.pandas.functions import pandas_udf

    bare = model

    @pandas_udf("double")
    def run(column):
        out = column.map(lambda t: bare.score(t or ""))
        give_back()
        return out

    return docs.withColumn(free_name(docs, into), run(quoted(text).cast("string")))


def held_out(key) -> F.Column:
    """The rows that labels are never learned from."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def labelled(docs: DataFrame, labels: DataFrame, settings: Settings, key: str = "doc_id", text: str = "text", label: str = "toxic") -> DataFrame:
    """(k, t, y) of labelled rows that aren't held out: those with the least hashed keys, ``settings.most_rows`` at most.

    The keys are bounded by that number, so they are broadcast. Null keys and labels are left out; a key that labels
    hold twice takes the larger label; rows of ``docs`` that repeat a key count once each.
    """
    open_ = labels.select(quoted(key).alias("k"), quoted(label).cast("int").alias("y")).where(F.col("k").isNotNull() & F.col("y").isin(0, 1) & ~held_out(F.col("k")))
    # each task sends its share of the rows only, whatever their number
    draw = F.pmod(F.xxhash64("k"), F.lit(1 << 31))
    share = min(1.0, 1.1 * settings.most_rows / max(1, open_.count()))
    chosen = open_.where(draw < F.lit(int((1 << 31) * share))).groupBy("k").agg(F.max("y").alias("y")).orderBy(draw, "k").limit(settings.most_rows)
    return docs.select(quoted(key).alias("k"), as_text(quoted(text)).alias("t")).join(F.broadcast(chosen), "k").select("k", "y", "t")


def scores(docs: DataFrame, labels: DataFrame, settings: Settings | None = None, threshold: float = 0.7) -> DataFrame:
    """(doc_id, held_out, score, predicted) of each row of ``docs``; a null doc_id isn't held out.

    Null and empty texts get the score of a text without a term, whole texts count however long they are, repeated rows
    each give a row, an empty table none. Other columns may have any name; none but the text goes into a score. Without
    labels of both kinds every text gets the share of the one (a half without any).
    """
    settings = settings or Settings()
    model = fit(labelled(docs, labels, settings), settings)
    slim = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), F.col("text").alias("t"))

    def work():
        return lambda columns: [columns[0], columns[1], got := [model.score(t or "") for t in columns[2]], [int(x >= threshold) for x in got]]

    kind = docs.schema["doc_id"].dataType.simpleString()
    return map_rows(slim, {"doc_id": "doc_id", "held_out": "held_out", "t": "t"}, f"doc_id {kind}, held_out boolean, score double, predicted int", work)


def reject(docs: DataFrame, labels: DataFrame, settings: Settings | None = None, threshold: float = 0.7) -> DataFrame:
    """The rows of ``docs`` that score under the threshold, columns as they were."""
    settings = settings or Settings()
    model = fit(labelled(docs, labels, settings), settings)
    name = free_name(docs, "score")
    return score(docs, model, into=name).where(quoted(name) < threshold).drop(name)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
