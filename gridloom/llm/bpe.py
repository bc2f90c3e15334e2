"""Byte-level BPE encoding and decoding with a local rank file."""

from __future__ import annotations

import base64
import hashlib
import heapq

import regex
import tiktoken
from pyspark.sql import DataFrame, SparkSession

from gridloom.llm.arrowtext import as_text, map_rows
from gridloom.runtime import free_name, quoted, table

#: Texts are cut into parts of about this many characters before the tokenizer sees them.
PART_CHARS = 65_536
#: A match of the pattern of more bytes than this is merged by the heap below, in n log n steps.
LONG_PIECE = 4_096

_loaded: dict[tuple[str, str], Codec] = {}


class Codec:
    """Encoder and decoder for one rank file and one splitting pattern; equals tiktoken's ordinary encoding."""

    def __init__(self, rank_file: str, pattern: str):
        with open(rank_file, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        self.encoding = tiktoken.Encoding("local", pat_str=pattern, mergeable_ranks=self.ranks, special_tokens={})
        self.pattern = regex.compile(pattern)
        self.decimal = [str(i) for i in range(max(self.ranks.values()) + 1)]

    @staticmethod
    def of(rank_file: str, pattern: str) -> Codec:
        """One codec a process."""
        if (rank_file, pattern) not in _loaded:
            _loaded[rank_file, pattern] = Codec(rank_file, pattern)
        return _loaded[rank_file, pattern]

    def encode(self, text: str) -> list[int]:
        if len(text) <= PART_CHARS:
            return self.encoding.encode_ordinary(text)
        ids: list[int] = []
        for part in parts(text):
            if len(part) <= 2 * PART_CHARS:
                ids += self.encoding.encode_ordinary(part)
            else:  # no white space for long: go match by match
                for m in self.pattern.finditer(part):
                    piece = m[0].encode()
                    ids += self.merge(piece) if len(piece) > LONG_PIECE else self.encoding.encode_ordinary(m[0])
        return ids

    def merge(self, piece: bytes) -> list[int]:
        """The merges of one match by rank, leftmost first among equals, from a heap over a linked list."""
        ranks, n = self.ranks, len(piece)
        if piece in ranks:
            return [ranks[piece]]
        end = list(range(1, n + 1))  # of the part that starts here
        before = list(range(-1, n - 1))
        alive = [True] * n

        def pair(i: int) -> int | None:
            return ranks.get(piece[i : end[end[i]]]) if end[i] < n else None

        heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(piece[i : i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, upto = heapq.heappop(heap)
            if not alive[i] or end[i] >= n or end[end[i]] != upto or end[i] == upto:
                continue
            j = end[i]
            alive[j] = False
            end[i] = upto
            if upto < n:
                before[upto] = i
            for k in (before[i], i):
                if k >= 0 and (r := pair(k)) is not None:
                    heapq.heappush(heap, (r, k, end[end[k]]))
        ids, i = [], 0
        while i < n:
            ids.append(ranks[piece[i : end[i]]])
            i = end[i]
        return ids

    def decode(self, ids: list[int]) -> bytes:
        """The raw bytes; a cut through a character is left as it is."""
        return self.encoding.decode_bytes(ids)


def parts(text: str) -> list[str]:
    """Cut before a space or line break that follows a character which isn't white space: no match spans that place.

    Each match of the pattern is white space only, or at most one leading space and then none; the look-ahead of the
    white-space branch only looks to the right.
    """
    out, start, n = [], 0, len(text)
    while n - start > PART_CHARS:
        at = start + PART_CHARS
        while at < n and not (text[at] in " \n" and not text[at - 1].isspace()):
            at += 1
        out.append(text[start:at])
        start = at
    if start < n:
        out.append(text[start:])
    return out


def encode(docs: DataFrame, rank_file: str, pattern: str, text: str = "text", into: str = "ids") -> DataFrame:
    """``docs`` with one more column of token ids (array<int>); a null text counts as empty and has none.

    No shuffle; nothing but the rank file, read by each Python worker from ``rank_file`` (it is installed on every
    machine), is kept. All columns pass, whatever their names; if ``into`` is taken, underscores go before it.
    """
    return _per_text(docs, text, {free_name(docs, into): "array<int>"}, lambda codec, t: [codec.encode(t)], rank_file, pattern)


def decode(tokens: DataFrame, rank_file: str, pattern: str, ids: str = "ids", into: str = "bytes") -> DataFrame:
    """``tokens`` with one more binary column: the raw bytes of its ids; null ids give empty bytes."""
    from pyspark.sql.pandas.functions import pandas_udf

    @pandas_udf("binary")
    def raw(column):
        codec = Codec.of(rank_file, pattern)
        return column.map(lambda x: codec.decode([] if x is None else [int(i) for i in x]))

    return tokens.withColumn(free_name(tokens, into), raw(quoted(ids)))


def _per_text(docs: DataFrame, text: str, new: dict[str, str], step, rank_file: str, pattern: str) -> DataFrame:
    from pyspark.sql.pandas.functions import pandas_udf

    (name, kind), *_ = new.items()

    @pandas_udf(kind)
    def run(column):
        codec = Codec.of(rank_file, pattern)
        return column.map(lambda t: step(codec, t or "")[0])

    return docs.withColumn(name, run(quoted(text)))


def digests(docs: DataFrame, rank_file: str, pattern: str, key: str = "doc_id", text: str = "text", with_ids: bool = False) -> DataFrame:
    """(key, n_tokens, ids_sha256, decoded_sha256, n_bytes[, ids]) for each row: encodes the whole text, then decodes the ids.

    One pass without a shuffle; only digests leave the Python worker, and the ids where asked for. A null or empty text has no token and the
    digests of no bytes. Repeated rows each give a row; a null key stays null.
    """

    def work():
        codec = Codec.of(rank_file, pattern)

        def step(columns):
            keys, texts = columns
            count, a, b, size, every = [], [], [], [], []
            for t in texts:
                ids = codec.encode(t)
                raw = codec.decode(ids)
                count.append(len(ids))
                a.append(hashlib.sha256(" ".join([codec.decimal[i] for i in ids]).encode()).hexdigest())
                b.append(hashlib.sha256(raw).hexdigest())
                size.append(len(raw))
                if with_ids:
                    every.append(ids)
            return [keys, count, a, b, size, *[every] * with_ids]

        return step

    kind = docs.schema[key].dataType.simpleString()
    slim = docs.select(quoted(key).alias("k"), as_text(quoted(text)).alias("t"))
    return map_rows(slim, {"k": "k", "t": "t"}, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string, n_bytes long" + ", ids array<int>" * with_ids, work)


def production() -> dict[str, str]:
    import public_tokenizers

    return {"rank_file": public_tokenizers.path("byte_bpe_50k.tiktoken"), "pattern": public_tokenizers.PATTERN}


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(table(spark, sf_dir, "documents"), **production())


__all__ = ["Codec", "decode", "digests", "encode", "parts", "query"]
