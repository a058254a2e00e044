"""Secret scan (op 10): Aho-Corasick keyword prefilter, regular expressions anchored at its hits,
then the checksum or structure that the secret embeds.

One pass of a keyword automaton over each text finds where a keyword stands; only there are the kinds'
patterns tried, anchored. Runs of hex digits have no keyword: they are found by their own run pattern. A pure map:
no shuffle, memory of one Arrow batch, nothing that a skewed source could bring into one task.

Kinds ``assign``, ``access`` and ``hex`` follow the base rules as they are. Further kinds must pass validation:
``forge`` and ``registry`` tokens end in a base-62 CRC-32 of what precedes it, ``jwt`` headers must decode to JSON
with an ``alg``, ``private_key`` blocks must decode as base64 DER whose length bytes fit.

Defined cases: a null or empty text has no spans; repeated rows and null ids are scanned one by one;
other columns are ignored.
"""

from __future__ import annotations

import base64
import binascii
import functools
import hashlib
import json
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import importable

#: In the order in which spans of equal start are listed.
KINDS = ("assign", "access", "hex", "forge", "registry", "jwt", "private_key")

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A | re.I)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
FORGE = re.compile(r"gh[pousr]_[A-Za-z0-9]{36}(?![A-Za-z0-9])")
REGISTRY = re.compile(r"npm_[A-Za-z0-9]{36}(?![A-Za-z0-9])")
JWT = re.compile(r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]*\.[A-Za-z0-9_-]+")
JWT_RUN = re.compile(r"[A-Za-z0-9_-]+")
PRIVATE_KEY = re.compile(r"-----BEGIN ((?:RSA |EC |DSA )?PRIVATE KEY)-----([A-Za-z0-9+/=\s]+)-----END \1-----")
BASE62 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"


def base62_crc(body: str) -> str:
    """Six base-62 digits of the CRC-32."""
    n, out = zlib.crc32(body.encode()), ""
    for _ in range(6):
        n, d = divmod(n, 62)
        out = BASE62[d] + out
    return out


def _checksum_ok(m: re.Match) -> bool:
    body = m.group().split("_", 1)[1]
    return base62_crc(body[:-6]) == body[-6:]


def _jwt_ok(m: re.Match) -> bool:
    head = m.group().split(".")[0]
    try:
        found = json.loads(base64.urlsafe_b64decode(head + "=" * (-len(head) % 4)))
    except (ValueError, binascii.Error, RecursionError):
        return False
    return isinstance(found, dict) and "alg" in found


def _der_ok(m: re.Match) -> bool:
    """An ASN.1 SEQUENCE that is as long as it says."""
    try:
        der = base64.b64decode("".join(m.group(2).split()), validate=True)
    except (ValueError, binascii.Error):
        return False
    if len(der) < 4 or der[0] != 0x30:
        return False
    if der[1] < 0x80:
        return len(der) == 2 + der[1]
    n = der[1] & 0x7F
    return len(der) == 2 + n + int.from_bytes(der[2 : 2 + n], "big")


#: keyword (lower case) -> kind, pattern anchored at the keyword, test of a match
PROBES = {
    **{w: ("assign", ASSIGN, lambda m: len(m.group(2)) >= 6) for w in ("password", "passwd", "secret", "token", "apikey", "api_key")},
    "akia": ("access", ACCESS, lambda m: len(m.group()) >= 20),
    **{f"gh{c}_": ("forge", FORGE, _checksum_ok) for c in "pousr"},
    "npm_": ("registry", REGISTRY, _checksum_ok),
    "eyj": ("jwt", JWT, _jwt_ok),
    "-----begin ": ("private_key", PRIVATE_KEY, _der_ok),
}
_LOWER = {c: c + 32 for c in range(65, 91)}


@functools.cache
def _automaton():
    import ahocorasick

    a = ahocorasick.Automaton()
    for w, probe in PROBES.items():
        a.add_word(w, (len(w), probe))
    a.make_automaton()
    return a


def scan(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of all secrets, by start and kind; code points, end exclusive."""
    low = text.lower()
    if len(low) != len(text):  # some capital became two characters; only A to Z matter
        low = text.translate(_LOWER)
    hits = sorted(((end + 1 - n, probe) for end, (n, probe) in _automaton().iter(low)), key=lambda h: h[0]) if low else []
    spans, over = [], dict.fromkeys(KINDS, 0)
    for start, (kind, pattern, good) in hits:
        if start < over[kind]:
            continue
        if m := pattern.match(text, start):
            over[kind] = m.end()
            if good(m):
                spans.append((start, m.end(), kind))
        elif kind == "jwt":  # what follows the run of letters decides, for all starts in it alike
            over[kind] = JWT_RUN.match(text, start).end()
    spans += [(*m.span(), "hex") for m in HEX.finditer(text)]
    return sorted(spans, key=lambda s: (s[0], KINDS.index(s[2])))


def shown(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, b, k in spans)


def redact(text: str, spans: list[tuple[int, int, str]]) -> str:
    """``text`` with each span replaced by its kind in brackets; overlapping spans become one."""
    out, at = [], 0
    for a, b, k in spans:
        if a >= at:
            out += [text[at:a], f"[{k}]"]
        at = max(at, b)
    return "".join([*out, text[at:]])


def scan_table(docs: DataFrame, with_text: bool = False) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans; with_text: also the redacted text."""
    importable(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").to_pylist()
            found = [scan(t) for t in texts]
            base = [[s for s in x if s[2] in KINDS[:3]] for x in found]
            out = {"doc_id": batch.column("doc_id")}
            for kind in KINDS[:3]:
                out[f"n_{kind}"] = pa.array([sum(s[2] == kind for s in x) for x in base], pa.int64())
            out["base_sha256"] = pa.array([hashlib.sha256(shown(x).encode()).hexdigest() for x in base], pa.string())
            out["spans"] = pa.array([shown(x) for x in found], pa.string())
            if with_text:
                out["redacted"] = pa.array([redact(t, x) for t, x in zip(texts, found, strict=True)], pa.string())
            yield pa.RecordBatch.from_pydict(out)

    schema = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string" + ", redacted string" * with_text
    return docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text")).mapInArrow(run, schema)
