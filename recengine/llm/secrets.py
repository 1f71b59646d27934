"""Secret scans: patterns, and strings that the text around them does not explain.

Base spans are matches of three patterns. Novelty then looks at other strings in sensitive places: every run of 12 or more characters
of keys that begins shortly after a word like "key", "auth" or "credential". Its novelty is how many bytes zstandard needs to add it
to what a dictionary primed with the surrounding text and with common identifiers already gives, against its length. Words,
identifiers and repeated strings compress; random ones do not, and are reported as ``novel`` spans.

Nothing is learned or shuffled: every text is scanned where it is read. Only the bytes near a sensitive word are compressed.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Callable
from functools import partial

import numpy as np
from pyspark.sql import DataFrame

from recengine.llm import _text
from recengine.llm.spans import Span, digest, written

KINDS = ("assign", "access", "hex", "novel")
ASSIGN = re.compile(r"""(?ai:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
#: Words that make a place sensitive, and how far behind one a string may begin.
SENSITIVE = re.compile(r"(?ai:passphrase|password|passwd|credential|secret|token|bearer|private|access|signature|auth|api|key)")
REACH = 48
#: The fewest characters of a candidate.
LEAST = 12
CANDIDATE = re.compile(rf"[A-Za-z0-9+/_=-]{{{LEAST},}}")
#: So long a run of letters of one case, or of digits, is no word or number.
LONG = 24
#: Characters of surrounding text on either side in the dictionary.
AROUND = 1024
#: Bytes of compressed output for each byte of the string from which on it counts as novel.
NOVEL = 0.85
#: Common identifiers of code and configuration, the fixed part of the dictionary.
IDENTIFIERS = (
    "abcdefghijklmnopqrstuvwxyz ABCDEFGHIJKLMNOPQRSTUVWXYZ 0123456789 000000000000 xxxxxxxxxxxx "
    "password passwd secret token api_key apikey access_key private_key public_key authorization bearer credential username user_id client_id "
    "client_secret session cookie signature certificate environment variable default example placeholder changeme undefined "
    "configuration parameter function return string integer boolean import export class static const public private protected "
    "http https localhost example.com index document content application database connection server host port path file name value"
)


#: Runs are maximal, so that a run that is too short can have no match.
LONG_HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{24,}")


def base(text: str, hexes: bool = True) -> list[Span]:
    """Leftmost non-overlapping matches of each kind; a match that is too short is dropped and not tried again."""
    out: list[Span] = []
    if any(w in text.lower() for w in WORDS):
        out += [(*m.span(), "assign") for m in ASSIGN.finditer(text) if len(m[1]) >= 6]
    if "AKIA" in text:
        out += [(*m.span(), "access") for m in ACCESS.finditer(text) if len(m[0]) >= 20]
    if hexes:
        out += [(*m.span(), "hex") for m in LONG_HEX.finditer(text)]
    return out


def novelty(candidate: str, around: str) -> float:
    """Compressed bytes that ``candidate`` adds, for each of its own, given ``around`` and the identifiers."""
    import zstandard

    raw = candidate.encode()
    prime = zstandard.ZstdCompressionDict((IDENTIFIERS + around).encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    packer = zstandard.ZstdCompressor(level=3, dict_data=prime, write_checksum=False, write_content_size=False, write_dict_id=False)
    return max(0, len(packer.compress(raw)) - len(packer.compress(b""))) / len(raw)


_CLASSES = re.compile("[a-z]+|[A-Z]+|[0-9]+")


def _varied(s: str) -> bool:
    """What words, numbers and identifiers alone are not: digits and letters mixed, letters that change their case every other letter
    on average, and four times or more, or a run of ``LONG`` letters or digits and more."""
    runs = _CLASSES.findall(s)
    cases = sum(1 for a, b in zip(runs, runs[1:], strict=False) if a[0].isalpha() and b[0].isalpha() and a[0].islower() != b[0].islower())
    return (any(c.isdigit() for c in s) and any(c.isalpha() for c in s)) or (cases >= 4 and len(s) <= 2 * len(runs)) or max(map(len, runs), default=0) >= LONG


def novel(text: str, known: list[Span], threshold: float = NOVEL) -> list[Span]:
    """Strings near sensitive words that no base span touches and that the text around does not explain."""
    out: list[Span] = []
    done = 0
    taken: list[tuple[int, int]] = []
    for a, b, _ in sorted(known):
        if taken and a < taken[-1][1]:
            taken[-1] = taken[-1][0], max(b, taken[-1][1])
        else:
            taken.append((a, b))
    ends = [b for _, b in taken]
    for m in SENSITIVE.finditer(text):
        for c in CANDIDATE.finditer(text, max(m.end(), done), min(len(text), m.end() + REACH + LEAST)):
            a, b = CANDIDATE.match(text, c.start()).span()
            if a > m.end() + REACH:
                break
            done = b
            k = bisect_right(ends, a)  # the first span that ends behind the candidate's begin
            if (k < len(taken) and taken[k][0] < b) or not _varied(text[a:b]):
                continue
            if novelty(text[a:b], text[max(0, a - AROUND) : a] + text[b : b + AROUND]) >= threshold:
                out.append((a, b, "novel"))
    return out


def _hex_rows(data: np.ndarray, offsets: np.ndarray, least: int = 24) -> np.ndarray:
    """Whether each text has a run of ``least`` hexadecimal digits, from the bytes of all at once."""
    starts, ends, rows = _text.cut(data, offsets, _HEX)
    out = np.zeros(len(offsets) - 1, bool)
    out[rows[ends - starts >= least]] = True
    return out


_HEX = np.zeros(256, bool)
_HEX[0x30:0x3A] = _HEX[0x61:0x67] = True


def _work(data: np.ndarray, offsets: np.ndarray, threshold: float) -> dict[str, object]:
    hexes = _hex_rows(data, offsets)
    raw = data.tobytes()
    low = _text.LOWER[data].tobytes()
    out: dict[str, list] = {k: [] for k in ("n_assign", "n_access", "n_hex", "n_novel", "base_sha256", "spans")}
    edges = offsets.tolist()
    for k, (a, b) in enumerate(zip(edges[:-1], edges[1:], strict=True)):
        known: list[Span] = []
        more: list[Span] = []
        sensitive = any(low.find(w, a, b) >= 0 for w in _MARKS)
        if hexes[k] or sensitive or raw.find(b"AKIA", a, b) >= 0:
            text = raw[a:b].decode()
            known = base(text, bool(hexes[k]))
            more = novel(text, known, threshold) if sensitive else []
        for kind in KINDS:
            out[f"n_{kind}"].append(sum(s[2] == kind for s in (*known, *more)))
        first = written(known, KINDS)
        out["base_sha256"].append(digest(first))
        out["spans"].append(written([*known, *more], KINDS) if more else first)
    return out


#: A text without any of these has no sensitive word.
_MARKS = (b"key", b"secret", b"token", b"pass", b"auth", b"credential", b"bearer", b"private", b"access", b"signature", b"api")


def scan_secrets(docs: DataFrame, *, threshold: float = NOVEL) -> DataFrame:
    """``docs`` with n_assign, n_access, n_hex, n_novel (long), base_sha256 and spans ("kind:start:end", code points, end exclusive).

    Null and empty texts have no spans: counts 0, spans "", the digest of "". Repeated rows are each scanned. A column of
    ``docs`` with a result's name gives way. Long texts are scanned whole; patterns take time in proportion to the text.
    """
    work: Callable = partial(_work, threshold=threshold)
    columns = {f"n_{k}": "long" for k in KINDS} | {"base_sha256": "string", "spans": "string"}
    return _text.appended(docs, columns, work)
