"""Personal data: patterns, and a semi-Markov conditional random field for forms that patterns miss.

Base spans are matches of four patterns (email, ip, card, phone). The model looks at stretches between them that may hold
another form: runs of digits and separators with 7 or more digits, and e-mail addresses spelled out with "at" and "dot". Base
spans are cut out of a stretch, and what is left is cut into tokens; every span of at most ``LONGEST`` tokens (of whole words
and ``LONGEST_SPELLED`` where there are letters) is a candidate segment with features of the whole span
(its shape, its number of digits, check digits, octets, the cue word before it), and dynamic programming over bounded
segments chooses boundaries and types together. Weights maximise the likelihood of generated stretches with known
segments, of personal data and of numbers that are none (dates, versions, identifiers). Every segment may be of any kind, so kinds
compete for it as boundaries do.

No shuffle: every text is scanned whole where it is read, and only stretches are decoded.
"""

from __future__ import annotations

import math
import random
import re
from bisect import bisect_right, insort
from collections import defaultdict
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from recengine.llm import _text
from recengine.llm.spans import Span, anchored, digest, written

KINDS = ("email", "ip", "card", "phone")
LONGEST = 15
#: The most that ``SPELLED`` admits: 9 words, and between them 8 times a blank, a bracket, "at" or "dot", a bracket and a blank.
LONGEST_SPELLED = 9 + 8 * 5
_LOCAL = re.compile(r"[A-Za-z0-9._%+-]")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

#: Stretches that may hold a form the patterns miss.
NUMBERS = re.compile(r"[(\[]?[0-9](?:[\x20()\[\]./-]{0,3}[0-9])+")
SPELLED = re.compile(r"(?ai)(?<![A-Za-z0-9_-])[A-Za-z0-9_-]++(?:(?:\.|\x20?[\[(]?dot[\])]?\x20?)[A-Za-z0-9_-]++){0,3}\x20?[\[(]?(?:@|at)[\])]?\x20?[A-Za-z0-9-]+(?:(?:\.|\x20?[\[(]?dot[\])]?\x20?)[A-Za-z0-9-]+){1,4}")
TOKEN = re.compile(r"[0-9]+|[A-Za-z]+|[^0-9A-Za-z]")
SPELLED_TOKEN = re.compile(r"[0-9A-Za-z_-]+|[^0-9A-Za-z_-]")
#: Words before a number or an address that tell its type, in the languages of the corpus.
CUES = {
    "phone": ("phone", "tel", "call", "mobile", "fax", "cell", "telefon", "handy", "móvil", "téléphone", "appelez"),
    "card": ("card", "visa", "mastercard", "amex", "credit", "karte", "tarjeta", "carte"),
    "ip": ("ip", "host", "server", "address", "adresse"),
    "email": ("mail", "email", "contact", "write", "correo", "courriel"),
}


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if k % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def base(text: str) -> list[Span]:
    """Leftmost non-overlapping matches of each kind; those that fail their check are dropped and not tried again."""
    out: list[Span] = [(a, b, "email") for a, b in anchored(text, "@", _LOCAL, _DOMAIN)]
    out += [(*m.span(), "ip") for m in IP.finditer(text) if all(int(x[-4:]) <= 255 and not x[:-4].strip("0") for x in m[0].split("."))]
    out += [(*m.span(), "card") for m in CARD.finditer(text) if 12 <= len(d := _digits(m[0])) <= 19 and luhn(d)]
    if "+" in text:
        out += [(*m.span(), "phone") for m in PHONE.finditer(text) if 9 <= len(_digits(m[0])) <= 15]
    return out


def features(segment: str, before: str) -> list[str]:
    """Features of a whole span, which every kind weighs for itself; ``before`` is the text to its left."""
    digits = _digits(segment)
    letters = any(c.isalpha() for c in segment)
    shape = re.sub("[A-Za-z]+", "a", re.sub("[0-9]+", lambda m: str(min(len(m[0]), 9)), segment))
    cue = next((k for k, words in CUES.items() for w in re.findall(r"\w+", before[-24:].lower())[-3:] if w in words), "none")
    out = ["", f"shape {shape}", f"cue {cue}", f"digits {len(digits)}", f"letters {letters}"]
    if not letters and 12 <= len(digits) <= 19:
        out.append(f"luhn {luhn(digits)}")
    parts = re.split(r"\[\.\]|\x20?\.\x20?", segment)
    if len(parts) == 4 and all(p.isdigit() and len(p) < 4 for p in parts):
        out.append(f"octets {all(int(p) < 256 for p in parts)}")
    if letters:
        low = segment.lower()
        out.append(f"spelled {bool(re.search(r'@|[^a-z]at[^a-z]', low))} {bool(re.search(r'[.]|[^a-z]dot[^a-z]', low))} {bool(re.search(r'[([]', low))}")
        out.append(f"ends {re.search('[a-z0-9]*$', low)[0] in ('com', 'org', 'net', 'edu', 'de', 'fr', 'es', 'info', 'io')}")
    out.append(f"edges {segment[0].isalnum() or segment[0] in '(+['} {segment[-1].isalnum()}")
    return out


class Model:
    """Weights by feature; a token outside all segments scores 0."""

    def __init__(self, weights: dict[str, float]):
        self.weights = weights

    def candidates(self, text: str, before: str) -> tuple[list[tuple[int, int]], list[tuple[int, int, str, list[str]]]]:
        """Tokens of a stretch, and segments (first token, end token, kind, features) that may stand in it."""
        spelled = any(c.isalpha() for c in text)
        tokens = [m.span() for m in (SPELLED_TOKEN if spelled else TOKEN).finditer(text)]
        longest = LONGEST_SPELLED if spelled else LONGEST
        out = []
        for i in range(len(tokens)):
            if text[tokens[i][0]].isspace():
                continue
            for j in range(i + 1, min(len(tokens), i + longest) + 1):
                segment = text[tokens[i][0] : tokens[j - 1][1]]
                if segment[-1].isspace() or segment[-1] in "([./-":
                    continue
                if any(c.isalpha() for c in segment) or len(_digits(segment)) >= 4:
                    found = features(segment, before + text[: tokens[i][0]])
                    out += [(i, j, kind, [f"{kind} {f}" for f in found]) for kind in KINDS]
        return tokens, out

    def score(self, found: list[str]) -> float:
        return sum(self.weights.get(f, 0.0) for f in found)

    def best(self, text: str, before: str) -> list[Span]:
        """The segmentation of a stretch with the highest score."""
        tokens, found = self.candidates(text, before)
        ending: dict[int, list] = defaultdict(list)
        for i, j, kind, f in found:
            ending[j].append((i, kind, self.score(f)))
        top: list[tuple[float, tuple | None]] = [(0.0, None)]
        for j in range(1, len(tokens) + 1):
            here = top[j - 1][0], None
            for i, kind, s in ending[j]:
                if top[i][0] + s > here[0] + 1e-9:
                    here = top[i][0] + s, (i, kind)
            top.append(here)
        out, j = [], len(tokens)
        while j:
            step = top[j][1]
            if step:
                out.append((tokens[step[0]][0], tokens[j - 1][1], step[1]))
                j = step[0]
            else:
                j -= 1
        return out[::-1]


def _generated(rng: random.Random) -> tuple[str, str, list[tuple[int, int, str]]]:
    """(text before, stretch, its segments): personal data in a form of its own, or a number that is none."""
    d = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    word = lambda: "".join(rng.choice("abcdefghilmnoprstu") for _ in range(rng.randint(3, 8)))
    cue = lambda k, p: f"{rng.choice(CUES[k])}{rng.choice([': ', ' '])}" if rng.random() < p else f"{word()} "

    def card() -> str:
        x = d(15)
        return next(x + c for c in "0123456789" if luhn(x + c))

    kind = rng.choice(["phone", "card", "ip", "email", "none", "none", "none", "none"])
    if kind == "phone":
        x = rng.choice([f"({d(3)}) {d(3)}-{d(4)}", f"({d(3)}) {d(3)}-{d(4)}", f"{d(3)}-{d(3)}-{d(4)}", f"({d(3)}) {d(3)} {d(4)}"])
        plain = rng.random() < 0.3
        x = rng.choice([f"{d(3)} {d(3)} {d(4)}", f"0{d(3)}/{d(7)}", f"{d(3)}.{d(3)}.{d(4)}"]) if plain else x
        return cue("phone", 1.0 if plain else 0.4), x, [(0, len(x), kind)]
    if kind == "card":
        c = card()
        x = rng.choice([".", "/"]).join((c[:4], c[4:8], c[8:12], c[12:]))
        return cue("card", 0.5), x, [(0, len(x), kind)]
    if kind == "ip":
        x = rng.choice(["[.]", " . "]).join(str(rng.randint(1, 255)) for _ in range(4))
        return cue("ip", 0.5), x, [(0, len(x), kind)]
    if kind == "email":
        at, dot = rng.choice([(" at ", " dot "), (" [at] ", " [dot] "), (" (at) ", " (dot) "), ("[at]", "[dot]"), ("(at)", "."), (" @ ", "."), ("[at]", ".")])
        x = f"{word()}{at}{word()}{dot}{rng.choice(['com', 'org', 'net', 'de', 'fr', 'es'])}"
        return cue("email", 0.5), x, [(0, len(x), kind)]
    x = rng.choice([
        d(rng.randint(7, 19)), d(rng.randint(7, 19)), f"{d(4)}-{d(2)}-{d(2)}", f"{d(2)}/{d(2)}/{d(4)}", f"{d(2)}.{d(2)}.{d(4)}", f"{d(1)}.{d(2)}.{d(1)}.{d(4)}", f"{d(3)}-{d(1)}-{d(2)}-{d(6)}-{d(1)}",
        f"{d(4)} {d(4)}", f"{d(3)}-{d(4)}", f"{d(4)}.{d(4)}", f"{d(3)} {d(4)} {d(5)}", f"{d(4)} {d(4)} {d(4)} {d(4)}", f"{d(5)}-{d(5)}", f"{word()} at {word()}.{word()}", f"{word()} at {word()} dot {word()} {word()}", f"{d(2)}.{d(3)}.{d(3)}.{d(3)}.{d(2)}",
    ])
    return f"{word()} ", x, []


@lru_cache(maxsize=1)
def trained(examples: int = 600, rounds: int = 12, rate: float = 0.3, decay: float = 0.002, seed: int = 5) -> Model:
    """Weights that maximise the likelihood of generated stretches: forward and backward sums over all segmentations."""
    rng = random.Random(seed)
    model = Model({})
    seen = []
    for _ in range(examples):
        before, text, gold = _generated(rng)
        tokens, found = model.candidates(text, before)
        seen.append((len(tokens), found, {(i, j, k) for i, j, k, _ in found if (tokens[i][0], tokens[j - 1][1], k) in gold}))
    w = model.weights
    for _ in range(rounds):
        rng.shuffle(seen)
        for n, found, gold in seen:
            scores = [model.score(f) for *_, f in found]
            ends, begins = defaultdict(list), defaultdict(list)
            for (i, j, _, _), s in zip(found, scores, strict=True):
                ends[j].append((i, s))
                begins[i].append((j, s))
            forward, backward = [0.0], [0.0] * (n + 1)
            for j in range(1, n + 1):
                forward.append(_sum([forward[j - 1], *(forward[i] + s for i, s in ends[j])]))
            for i in range(n - 1, -1, -1):
                backward[i] = _sum([backward[i + 1], *(backward[j] + s for j, s in begins[i])])
            for (i, j, kind, f), s in zip(found, scores, strict=True):
                off = ((i, j, kind) in gold) - math.exp(min(0.0, forward[i] + s + backward[j] - forward[n]))
                if abs(off) > 1e-4:
                    for x in f:
                        w[x] = w.get(x, 0.0) * (1 - rate * decay) + rate * off
    return model


def _sum(logs: list[float]) -> float:
    top = max(logs)
    return top + math.log(sum(math.exp(x - top) for x in logs))


def more(text: str, known: list[Span], model: Model) -> list[Span]:
    """Segments that the model finds in what ``known`` leaves of stretches."""
    out: list[Span] = []
    taken: list[tuple[int, int]] = []
    for a, b in sorted((a, b) for a, b, _ in known):
        if taken and a < taken[-1][1]:
            taken[-1] = taken[-1][0], max(b, taken[-1][1])
        else:
            taken.append((a, b))
    low = text.lower()
    patterns = [NUMBERS] + [SPELLED] * ("dot" in low or "(at)" in low or "[at]" in low or " @ " in low)
    stretches = [(*m.span(), k) for k, p in enumerate(patterns) for m in p.finditer(text) if _holds(m, p)]
    for a, b, k in sorted(stretches):
        for x, y in _left(a, b, taken):
            for m in patterns[k].finditer(text, x, y):
                if _holds(m, patterns[k]):
                    at = m.start()
                    found = [(at + i, at + j, kind) for i, j, kind in model.best(m[0], text[max(0, at - 40) : at])]
                    out += found
                    for i, j, _ in found:
                        insort(taken, (i, j))
    return out


def _holds(m: re.Match, pattern: re.Pattern) -> bool:
    return pattern is not NUMBERS or len(_digits(m[0])) >= 7 or len(re.findall("[0-9]+", m[0])) >= 4


def _left(a: int, b: int, taken: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The parts of a stretch from ``a`` to ``b`` that ``taken`` (in order, apart) leaves."""
    out = []
    k = bisect_right(taken, (a, a))
    k -= k > 0 and taken[k - 1][1] > a
    while k < len(taken) and taken[k][0] < b:
        if a < taken[k][0]:
            out.append((a, taken[k][0]))
        a, k = taken[k][1], k + 1
    return [*out, (a, b)] if a < b else out


_ANCHORS = np.zeros(256, bool)
_ANCHORS[0x30:0x3A] = _ANCHORS[0x40] = True


def find_personal_data(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """``docs`` with n_email, n_ip, n_card, n_phone (long, base spans), base_sha256 and spans ("kind:start:end", code points).

    Null and empty texts have no spans: counts 0, spans "", the digest of "". Repeated rows are each scanned. A column of
    ``docs`` with a result's name gives way. Base spans stay whatever the model says, and its spans overlap none of them.
    """
    sent = spark.sparkContext.broadcast(trained().weights)

    def work(data: np.ndarray, offsets: np.ndarray) -> dict[str, object]:
        model = Model(sent.value)
        raw, edges = data.tobytes(), offsets.tolist()
        low = _text.LOWER[data].tobytes()
        marked = np.zeros(len(edges) - 1, bool)
        marked[np.searchsorted(offsets, np.flatnonzero(_ANCHORS[data]), "right") - 1] = True
        out: dict[str, list] = {k: [] for k in (*(f"n_{k}" for k in KINDS), "base_sha256", "spans")}
        for k, (a, b) in enumerate(zip(edges[:-1], edges[1:], strict=True)):
            known: list[Span] = []
            extra: list[Span] = []
            if marked[k] or low.find(b"dot", a, b) >= 0 or low.find(b"at)", a, b) >= 0 or low.find(b"at]", a, b) >= 0:
                text = raw[a:b].decode()
                known = base(text)
                extra = more(text, known, model)
            for kind in KINDS:
                out[f"n_{kind}"].append(sum(s[2] == kind for s in known))
            first = written(known, KINDS)
            out["base_sha256"].append(digest(first))
            out["spans"].append(written([*known, *extra], KINDS) if extra else first)
        return out

    return _text.appended(docs, {f"n_{k}": "long" for k in KINDS} | {"base_sha256": "string", "spans": "string"}, work)
