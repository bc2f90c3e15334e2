"""Secrets in texts: patterns, and candidates confirmed by the structure of what they decode to."""

from __future__ import annotations

import base64
import binascii
import bisect
import hashlib
import json
import re

from pyspark.sql import DataFrame, SparkSession

from gridloom.llm.arrowtext import as_text, map_rows
from gridloom.runtime import free_name, quoted, table

# The base patterns. Only A-Z and a-z of the assigned names match in either case.
ASSIGN = re.compile(
    r"""([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
HEX_RUN = re.compile(r"[0-9a-f]{24,}")  # the same matches as HEX with 24 or more characters
LEAST = {"assign": 6, "access": 20, "hex": 24}
ORDER = {k: i for i, k in enumerate(("assign", "access", "hex", "jwt", "key", "pem"))}
NAMES = ("password", "passwd", "secret", "token", "apikey", "api_key")

BEGIN = re.compile(r"-----BEGIN ([A-Z0-9 ]*PRIVATE KEY)-----")
PEM_BODY = re.compile(r"[A-Za-z0-9+/=\s:,.\\-]*+")
JWT = re.compile(r"(?<![A-Za-z0-9_-])eyJ[A-Za-z0-9_-]++\.[A-Za-z0-9_-]++\.[A-Za-z0-9_-]*+")
BASE64 = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{40,}+={0,2}")
LONG_HEX = re.compile(r"(?<![0-9A-Fa-f])[0-9A-Fa-f]{64,}+")
#: The same over several lines, whose breaks may be written as \\n.
BREAK = r"(?:\\r)?(?:\\n|\r?\n)[ \t]*+"
WRAPPED = re.compile(rf"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{{32,}}+(?:{BREAK}[A-Za-z0-9+/_-]++)++={{0,2}}")
LINE = re.compile(r"[A-Za-z0-9+/_-]+={0,2}")
HEX_LINE = re.compile(r"[0-9A-Fa-f]+")
#: A text without white-space-free runs of this length can only hold assignments and PEM blocks.
LEAST_RUN = 20
#: Encodings within encodings that are followed; each is a quarter shorter than what holds it, at least.
DEPTH = 8


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) by the base patterns, each kind leftmost and not overlapping; short matches drop out."""
    out = []
    low = text.lower()
    if any(n in low for n in NAMES):
        out += [("assign", *m.span()) for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST["assign"]]
    if max(map(len, text.split()), default=0) >= LEAST_RUN:
        if "AKIA" in text:
            out += [("access", *m.span()) for m in ACCESS.finditer(text) if m.end() - m.start() >= LEAST["access"]]
        out += [("hex", *m.span()) for m in HEX_RUN.finditer(text)]
    return out


def _decode64(s: str) -> bytes | None:
    s = s.rstrip("=").replace("-", "+").replace("_", "/")
    try:
        return base64.b64decode(s + "=" * (-len(s) % 4), validate=True)
    except (binascii.Error, ValueError):
        return None


def _element(raw: bytes, at: int, stop: int) -> tuple[int, int, int] | None:
    """(tag, start of the content, end) of the DER element at ``at``; None where its length isn't minimal or too long."""
    if at + 2 > stop:
        return None
    tag, size, start = raw[at], raw[at + 1], at + 2
    if size & 0x80:
        n = size & 0x7F
        if not 1 <= n <= 4 or start + n > stop or raw[start] == 0:
            return None
        size, start = int.from_bytes(raw[start : start + n], "big"), start + n
        if size < 0x80:
            return None
    return (tag, start, start + size) if start + size <= stop else None


def _elements(raw: bytes, at: int, stop: int) -> list[tuple[int, int, int]] | None:
    """All elements between two places, which they must fill."""
    out = []
    while at < stop:
        e = _element(raw, at, stop)
        if e is None:
            return None
        out.append(e)
        at = e[2]
    return out


def is_der_key(raw: bytes) -> bool:
    """A private key in PKCS#1, PKCS#8 (also encrypted), SEC1 or DSA form, all nested lengths filling each other."""
    whole = _element(raw, 0, len(raw))
    if whole is None or whole[0] != 0x30 or whole[2] != len(raw):
        return False
    parts = _elements(raw, whole[1], whole[2])
    if not parts:
        return False
    tags = [p[0] for p in parts]
    inner = lambda p: _elements(raw, p[1], p[2])
    first = raw[parts[0][1] : parts[0][2]]
    if tags[0] == 0x02 and first == b"\x00" and len(tags) in (6, 9) and set(tags) == {0x02}:
        return True
    if tags[0] == 0x02 and first in (b"\x00", b"\x01") and tags[1:3] == [0x30, 0x04]:
        known = inner(parts[1])
        return bool(known) and known[0][0] == 0x06 and parts[2][2] > parts[2][1]
    if tags[0] == 0x02 and first == b"\x01" and len(tags) >= 2 and tags[1] == 0x04 and 16 <= parts[1][2] - parts[1][1] <= 80:
        return all(t in (0xA0, 0xA1) and inner(p) for t, p in zip(tags[2:], parts[2:], strict=True))
    if tags == [0x30, 0x04]:
        known = inner(parts[0])
        return bool(known) and known[0][0] == 0x06 and parts[1][2] - parts[1][1] >= 32
    return False


def is_openssh_key(raw: bytes) -> bool:
    """openssh-key-v1: cipher, kdf and its options, count, public keys and private part as length-prefixed strings that fill it."""
    magic = b"openssh-key-v1\x00"
    if not raw.startswith(magic):
        return False
    at = len(magic)

    def take() -> bytes | None:
        nonlocal at
        if at + 4 > len(raw):
            return None
        n = int.from_bytes(raw[at : at + 4], "big")
        at += 4 + n
        return raw[at - n : at] if at <= len(raw) else None

    if any(take() is None for _ in range(3)) or at + 4 > len(raw):
        return False
    n, at = int.from_bytes(raw[at : at + 4], "big"), at + 4
    if not 1 <= n <= 16 or any(not take() for _ in range(n)):
        return False
    return bool(take()) and at == len(raw)


def is_token(text: str) -> bool:
    """Three parts, of which the first decodes to a JSON object that names an algorithm and the second to an object."""
    head, _, rest = text.partition(".")
    body = rest.partition(".")[0]
    try:
        header, claims = (json.loads((_decode64(x) or b"").decode()) for x in (head, body))
    except (ValueError, RecursionError):
        return False
    return isinstance(header, dict) and isinstance(header.get("alg"), str) and isinstance(claims, dict)


def is_key(raw: bytes, depth: int = DEPTH) -> bool:
    """Decoded bytes that are a key, or a text that holds a PEM key, a signed token or an encoding of one again."""
    if is_der_key(raw) or is_openssh_key(raw):
        return True
    if depth <= 1:
        return False
    return any(True for _ in confirmed(raw.decode("latin-1"), depth - 1))


def _unhex(s: str) -> bytes | None:
    return bytes.fromhex(s) if len(s) % 2 == 0 else None


def _blocks(text: str):
    """(start, end, body) of PEM blocks of private keys: what lies between a BEGIN line and the END line of the same
    name, with no other such line between."""
    for m in BEGIN.finditer(text):
        stop = text.find("-----", m.end())
        end = f"-----END {m[1]}-----"
        if stop >= 0 and text.startswith(end, stop) and PEM_BODY.fullmatch(text, m.end(), stop):
            yield m.start(), stop + len(end), text[m.end() : stop].replace("\\r", "").replace("\\n", "\n")


def _wrapped(text: str):
    """(start, end, whole) of encodings cut into lines of one length, the last of which may be shorter; where the last
    is as long as the others, also without what follows it."""
    for m in WRAPPED.finditer(text):
        for line in (HEX_LINE, LINE):
            parts = list(re.compile(rf"(?:^|{BREAK})({line.pattern})(?=\s|\\|$)").finditer(m[0]))
            if len(parts) < 2:
                continue
            size = len(parts[0][1])
            k = next((i for i, p in enumerate(parts) if len(p[1]) != size), len(parts))
            for n in ((k + 1, k) if k < len(parts) and len(parts[k][1]) < size else (k,)):
                if n > 1:
                    yield m.start(), m.start() + parts[n - 1].end(), "".join(p[1] for p in parts[:n]), _unhex if line is HEX_LINE else _decode64


def confirmed(text: str, depth: int = DEPTH):
    """(kind, start, end) of what its structure confirms: pem blocks, jwt tokens, keys in bare base64 or hex, in one
    piece or in lines. None overlaps one found before. Time is in proportion to the text for each depth."""
    taken: list[tuple[int, int]] = []

    def free(a: int, b: int) -> bool:
        i = bisect.bisect_left(taken, (b,))
        return i == 0 or taken[i - 1][1] <= a

    def take(kind: str, a: int, b: int) -> tuple[str, int, int]:
        bisect.insort(taken, (a, b))
        return kind, a, b

    if "PRIVATE KEY-----" in text:
        for a, b, body in _blocks(text):
            raw = _decode64("".join(re.sub(r"(?m)^[A-Za-z-]++:.*$", "", body).split()))
            if raw and (is_der_key(raw) or is_openssh_key(raw) or "Proc-Type" in body and len(raw) % 8 == 0):
                yield take("pem", a, b)
    if "eyJ" in text:
        for m in JWT.finditer(text):
            if free(*m.span()) and is_token(m[0]):
                yield take("jwt", *m.span())
    for pattern, decode in ((LONG_HEX, _unhex), (BASE64, _decode64)):
        for m in pattern.finditer(text):
            if free(*m.span()) and (raw := decode(m[0])) and is_key(raw, depth):
                yield take("key", *m.span())
    for a, b, whole, decode in _wrapped(text):
        if free(a, b) and (raw := decode(whole)) and is_key(raw, depth):
            yield take("key", a, b)


def spans(text: str) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]:
    """Base spans, and all spans with those that structure confirms; by start, then kind. Code points, end exclusive."""
    by = lambda s: (s[1], ORDER[s[0]], s[2])
    base = sorted(base_spans(text), key=by)
    more = list(confirmed(text)) if max(map(len, text.split()), default=0) >= LEAST_RUN or "PRIVATE KEY-----" in text else []
    return base, sorted(base + more, key=by)


def written(found: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in found)


def scan(docs: DataFrame, text: str = "text", into: str = "secrets") -> DataFrame:
    """``docs`` with array<struct<kind, start, end, value>> of all spans of the whole text; empty for null texts.

    One pass, no shuffle; all columns pass, ``into`` gets underscores where it is taken.
    """
    from pyspark.sql.pandas.functions import pandas_udf

    @pandas_udf("array<struct<kind:string,start:int,end:int,value:string>>")
    def run(column):
        return column.map(lambda t: [{"kind": k, "start": a, "end": b, "value": t[a:b]} for k, a, b in spans(t)[1]] if t else [])

    return docs.withColumn(free_name(docs, into), run(quoted(text).cast("string")))


def digests(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_assign, n_access, n_hex, base_sha256, spans) of each row; null and empty texts have no span.

    Repeated rows each give a row; null keys stay null; an empty table gives no row; other columns may have any name.
    Texts are read whole, however long, in time in proportion to their length.
    """

    def work():
        def step(columns):
            keys, texts = columns
            out = [[], [], [], [], []]
            for t in texts:
                base, every = spans(t)
                for i, k in enumerate(LEAST):
                    out[i].append(sum(s[0] == k for s in base))
                out[3].append(hashlib.sha256(written(base).encode()).hexdigest())
                out[4].append(written(every))
            return [keys, *out]

        return step

    slim = docs.select(quoted(key).alias("k"), as_text(quoted(text)).alias("t"))
    kind = docs.schema[key].dataType.simpleString()
    return map_rows(slim, {"k": "k", "t": "t"}, f"doc_id {kind}, n_assign long, n_access long, n_hex long, base_sha256 string, spans string", work)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(table(spark, sf_dir, "documents"))


