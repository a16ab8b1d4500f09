"""Personal data: fixed base patterns, plus candidates that boosted trees accept.

Base spans (email, ip, card, phone) are found by rule and always stay. Further
generators propose looser, overlapping spans of these kinds (numbers without a plus sign,
other separators, spelled-out addresses, colon addresses) and of one more, ``secret`` (keys,
tokens and passwords); gradient-boosted trees judge their format and the words around them; a span is
added where its probability reaches its kind's threshold, best first, if it overlaps no span
already chosen. A secret may enclose base spans; other candidates may not touch them.

Training examples are written out by families, each one way to write a thing that is personal
data or that only looks so (``FAMILIES``: order numbers, dates, checksums, versions). The families are
split in two: the trees learn ``N_TRAIN`` examples of one half, and the thresholds are the
lowest that keep ``PRECISION`` on ``N_CALIBRATE`` examples of the other, so that they hold for ways of writing the trees have
not seen. ``measure`` gives precision and recall on further examples of the other half.

Every scan is linear in the text's length. Defined results: null text is the
empty text (no spans); offsets count code points, ends are exclusive; of candidates with equal
probability the one that starts first, then ends first, then is of the first kind as listed is chosen; rows that repeat
an id are judged each by its own text; an empty table gives an empty result; other
columns are ignored or kept as they are, and result columns get an underscore where the id column has their name.
"""

from __future__ import annotations

import bisect
import hashlib
import re
from collections.abc import Iterator
from functools import cache, partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quilter.llm.boosting import BoostedTrees
from quilter.llm.common import arrow_map, free

KINDS = ("email", "ip", "card", "phone")
#: Kinds of all spans, in the order they are listed.
EVERY_KIND = (*KINDS, "secret")
N_TRAIN, N_CALIBRATE, PRECISION, SEED = 6000, 5000, 0.995, 11

Span = tuple[str, int, int]

LOCAL = re.compile(r"[A-Za-z0-9._%+-]+")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# A match can only begin where a run of digits does, so the look-behind changes no result.
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]+){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DIGIT = re.compile(r"[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = d * 2 - 9 * (d > 4)
        total += d
    return total % 10 == 0


def only_digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def emails(text: str) -> list[Span]:
    """Leftmost non-overlapping matches of local@domain, found from each @ outwards."""
    out, done, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in LOCAL_CHARS:
            start -= 1
        if start < at and (m := DOMAIN.match(text, at + 1)):
            done = m.end()
            out.append(("email", start, done))
            at = text.find("@", done)
        else:
            at = text.find("@", at + 1)
    return out


def base_spans(text: str) -> list[Span]:
    """The fixed patterns' spans by kind, then start."""
    out = emails(text)
    if DIGIT.search(text) is None:
        return out
    for m in IP.finditer(text):
        if all(len(p.lstrip("0")) < 4 and int(p.lstrip("0") or 0) < 256 for p in m.group().split(".")):
            out.append(("ip", m.start(), m.end()))
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 13 and 13 <= len(d := only_digits(m.group())) <= 19 and luhn(d):
            out.append(("card", m.start(), m.end()))
    if "+" in text:
        for m in PHONE.finditer(text):
            if 9 <= len(only_digits(m.group())) <= 15:
                out.append(("phone", m.start(), m.end()))
    return out


# ---- candidates -----------------------------------------------------------

SPELLED = re.compile(r"(?i)(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64} ?[\[({<] ?at ?[\])}>] ?[A-Za-z0-9-]{1,63}(?: ?(?:[\[({<] ?dot ?[\])}>]|\.) ?[A-Za-z0-9-]{2,63}){1,4}")
NUMBER = re.compile(r"(?<![0-9])[+(]{0,2}[0-9](?:[\x20()./\[\]-]{0,3}[0-9]){6,23}(?![0-9])")
COLONS = re.compile(r"(?<![0-9A-Za-z:])(?:[0-9A-Fa-f]{1,4}:{1,2}){2,7}[0-9A-Fa-f]{0,4}(?![0-9A-Za-z:])")
KEY = re.compile(r"(?<![A-Za-z0-9+/_.=-])[A-Za-z0-9+_-][A-Za-z0-9+/_.-]{10,}+={0,2}")
#: Words near a span that speak for a kind, or for none.
HINTS = {
    "email": ("mail", "contact", "write", "correo", "schreib"),
    "ip": ("ip", "host", "server", "address", "login", "adresse", "gateway", "ping"),
    "card": ("card", "visa", "credit", "karte", "carte", "tarjeta", "payment", "pay", "amex"),
    "phone": ("tel", "phone", "call", "mobile", "fax", "cell", "anruf", "appel", "llame", "dial"),
    "secret": ("token", "secret", "key", "password", "passwd", "pwd", "auth", "bearer", "credential", "apikey", "passwort", "clave"),
    "none": ("version", "order", "isbn", "invoice", "ref", "serial", "id", "no.", "#", "price", "total", "section", "build", "sku", "date", "commit", "sha", "md", "checksum", "etag", "uuid", "hash", "digest", "file", "http", "www"),
}
BEFORE, AFTER = 28, 12


def candidates(text: str) -> list[Span]:
    """Looser spans, several kinds for the same characters where they may fit."""
    out: list[Span] = [("email", m.start(), m.end()) for m in SPELLED.finditer(text)] if "at" in text or "AT" in text else []
    if DIGIT.search(text) is None:
        return out
    if "::" in text or text.count(":") > 3:
        out += [("ip", m.start(), m.end()) for m in COLONS.finditer(text)]
    for m in KEY.finditer(text):
        body = m.group()
        if DIGIT.search(body) and not body.isdigit() and re.search("[A-Za-z]", body):
            out.append(("secret", m.start(), m.start() + len(body.rstrip(".-"))))
    for m in NUMBER.finditer(text):
        n = len(only_digits(m.group()))
        s, e = m.start(), m.end()
        parts = [p for p in re.split(r"[^0-9]+", m.group()) if p]
        if len(parts) == 4 and all(len(p) <= 3 for p in parts):
            out.append(("ip", s, e))
        if 13 <= n <= 19:
            out.append(("card", s, e))
        if 7 <= n <= 15:
            out.append(("phone", s, e))
    return out


def features(text: str, span: Span) -> list[float]:
    """Format and context of one candidate."""
    kind, s, e = span
    body = text[s:e]
    digits = only_digits(body)
    parts = [p for p in re.split(r"[^0-9]+", body) if p]
    near = text[max(0, s - BEFORE) : s].lower()
    words = re.findall(r"[a-z#.]+", near) + re.findall(r"[a-z]+", text[e : e + AFTER].lower())
    hint = {k: float(any(w.startswith(h) for w in words for h in hints)) for k, hints in HINTS.items()}
    before, after = text[s - 1 : s], text[e : e + 1]
    letters = [c for c in body if c.isalpha()]
    turns = sum(a.isdigit() != b.isdigit() for a, b in zip(body[:200], body[1:200], strict=False))
    return [
        *(float(kind == k) for k in EVERY_KIND),
        min(len(body), 200), min(len(digits), 200), min(len(parts), 50), max(map(len, parts), default=0), min(map(len, parts), default=0),
        float(bool(digits) and luhn(digits)), float(all(len(p) < 4 and int(p) < 256 for p in parts)),
        body.count(" "), body.count("-"), body.count("."), body.count("("), body.count("/"), body.count("["), body.count(":"), body.count("_"),
        float(body[:1] == "+"), float(digits[:2] == "00"), float(digits[:1] == "0"), float(len(parts) >= 3 and len(set(map(len, parts[:-1]))) == 1),
        float(before.isalnum() or before in ("_", "-", ".", "=", "/")), float(after.isalnum() or after in ("_", "-", "/", "%")),
        len(set(body)) / len(body), float(all(c in "0123456789abcdefABCDEF-" for c in body)), float(any(c.isupper() for c in letters) and any(c.islower() for c in letters)),
        float(before in ("'", '"')), float(bool(re.search(r"[=:]\s*[\"']?$", near))), turns / len(body), float(bool(re.search(r"bearer $", near))),
        hint[kind], hint["none"], max(v for k, v in hint.items() if k not in (kind, "none")),
    ]


# ---- training -------------------------------------------------------------

FILLER = "the of and to in that is for on with der die und in den von la de el que en los et les des pour dans sur ionst erhaw ntore lyeda".split()
HEX, BASE62 = "0123456789abcdef", "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"


class Writer:
    """Seeded pieces of made-up text."""

    def __init__(self, rng: np.random.Generator):
        self.rng = rng

    def pick(self, *options: str) -> str:
        return str(self.rng.choice(options))

    def digits(self, n: int) -> str:
        return "".join(map(str, self.rng.integers(0, 10, n)))

    def chars(self, alphabet: str, n: int) -> str:
        return "".join(self.rng.choice(list(alphabet), n))

    def words(self, n: int) -> str:
        return " ".join(self.rng.choice(FILLER, n))

    def with_luhn(self, n: int) -> str:
        body = self.digits(n - 1)
        return body + next(d for d in "0123456789" if luhn(body + d))

    def without_luhn(self, n: int) -> str:
        body = self.with_luhn(n)
        return body[:-1] + str((int(body[-1]) + 1 + int(self.rng.integers(0, 9))) % 10)

    def octets(self, least: int = 0, below: int = 256) -> list[str]:
        return [str(x) for x in self.rng.integers(least, below, 4)]

    def name(self) -> str:
        return "".join(self.rng.choice(FILLER, 2))

    def fours(self, d: str, sep: str) -> str:
        return sep.join([d[:4], d[4:8], d[8:12], d[12:]])


def _phone(w: Writer, form: str) -> str:
    return "".join(w.digits(1) if c == "9" else c for c in form)


#: (kind, whether it is personal data, body). The first, third, ... of each kind and side train, the others calibrate.
FAMILIES = (
    ("email", True, lambda w: f"{w.name()} [at] {w.name()} [dot] {w.pick('com', 'org', 'net')}"),
    ("email", True, lambda w: f"{w.name()}(at){w.name()}.{w.pick('com', 'de', 'fr')}"),
    ("email", True, lambda w: f"{w.name()}.{w.digits(2)} (at) {w.name()} (dot) {w.pick('com', 'org', 'es')}"),
    ("email", True, lambda w: f"{w.name()}{w.digits(2)}[at]{w.name()}.{w.pick('com', 'org', 'net')}"),
    ("email", False, lambda w: f"{w.pick(*FILLER)} (at) {w.pick(*FILLER)}. {w.pick(*FILLER)}"),
    ("email", False, lambda w: f"{w.pick(*FILLER)} [at] {w.pick(*FILLER)} . {w.pick(*FILLER)}"),
    ("ip", True, lambda w: "[.]".join(w.octets())),
    ("ip", True, lambda w: w.pick(" . ", "[.] ").join(w.octets())),
    ("ip", True, lambda w: ":".join(w.chars(HEX, 4) for _ in range(8))),
    ("ip", True, lambda w: f"{w.chars('23', 1)}{w.chars(HEX, 3)}:{w.chars(HEX, 4)}::{w.chars(HEX, 3)}"),
    ("ip", False, lambda w: w.pick(".", "/", "-").join(w.octets(256, 999))),
    ("ip", False, lambda w: f"{w.digits(2)}:{w.digits(2)}:{w.digits(2)}"),
    ("ip", False, lambda w: f"{w.digits(2)}-{w.digits(2)}-{w.digits(2)} {w.digits(2)}"),
    ("ip", False, lambda w: f"{w.digits(2)}/{w.digits(2)}/{w.digits(2)}/{w.digits(2)}"),
    ("card", True, lambda w: w.fours(w.with_luhn(16), ".")),
    ("card", True, lambda w: w.fours(w.with_luhn(16), w.pick("/", " - ", "  "))),
    ("card", True, lambda w: w.fours(w.with_luhn(15), w.pick(". ", " / "))),
    ("card", True, lambda w: w.fours(w.with_luhn(16), w.pick(". ", "-/-"))),
    ("card", False, lambda w: w.without_luhn(16)),
    ("card", False, lambda w: w.without_luhn(int(w.rng.integers(13, 20)))),
    ("card", False, lambda w: w.fours(w.without_luhn(16), w.pick(".", "/"))),
    ("card", False, lambda w: w.fours(w.without_luhn(16), w.pick(" ", "-"))),
    ("phone", True, lambda w: _phone(w, w.pick("(999) 999-9999", "999-999-9999"))),
    ("phone", True, lambda w: _phone(w, w.pick("999.999.9999", "(999)999-9999"))),
    ("phone", True, lambda w: _phone(w, w.pick("0049 99 9999999", "0999 9999999"))),
    ("phone", True, lambda w: _phone(w, w.pick("0033 9 99 99 99 99", "1-999-999-9999"))),
    ("phone", False, lambda w: w.digits(int(w.rng.integers(7, 16)))),
    ("phone", False, lambda w: f"20{w.digits(2)}-{w.digits(2)}-{w.digits(2)}/{w.digits(2)}"),
    ("phone", False, lambda w: f"{w.digits(2)}.{w.digits(3)}.{w.digits(3)}"),
    ("phone", False, lambda w: w.digits(9)),
    ("phone", False, lambda w: f"978-{w.digits(1)}-{w.digits(4)}-{w.digits(4)}-{w.digits(1)}"),
    ("phone", False, lambda w: f"{w.digits(4)} {w.digits(4)} {w.digits(2)}"),
    ("secret", True, lambda w: w.chars(HEX, 40)),
    ("secret", True, lambda w: w.chars(HEX, int(w.rng.choice([32, 48, 64])))),
    ("secret", True, lambda w: f"{w.pick('ghp_', 'sk-', 'xoxb-')}{w.chars(BASE62, 36)}"),
    ("secret", True, lambda w: w.chars(BASE62, int(w.rng.integers(20, 60)))),
    ("secret", True, lambda w: f"AKIA{w.chars(BASE62[:36], 16)}"),
    ("secret", True, lambda w: f"{w.chars(BASE62, 12)}-{w.chars(BASE62, 10)}_{w.chars(BASE62, 8)}"),
    ("secret", False, lambda w: f"{w.name()}/{w.name()}-{w.digits(3)}.html"),
    ("secret", False, lambda w: f"{w.name()}-{w.name()}{w.digits(2)}"),
    ("secret", False, lambda w: f"{w.chars(HEX, 8)}-{w.chars(HEX, 4)}-{w.chars(HEX, 4)}-{w.chars(HEX, 4)}-{w.chars(HEX, 12)}"),
    ("secret", False, lambda w: w.chars(HEX, int(w.rng.choice([32, 40, 64])))),
    ("secret", False, lambda w: f"20{w.digits(2)}-{w.digits(2)}-{w.digits(2)}T{w.digits(2)}"),
    ("secret", False, lambda w: w.name().upper() + w.digits(6)),
)
#: How much of each kind is led by a word that speaks for it, or for none.
LED, MISLED = 0.85, 0.75


def _half(which: int) -> list[tuple[str, bool, object]]:
    counts: dict[tuple[str, bool], int] = {}
    out = []
    for kind, yes, body in FAMILIES:
        at = counts[kind, yes] = counts.get((kind, yes), -1) + 1
        if at % 2 == which:
            out.append((kind, yes, body))
    return out


def _examples(rng: np.random.Generator, n: int, which: int) -> list[tuple[str, Span, int]]:
    """n sentences with one candidate each, of one half of the families."""
    w, out = Writer(rng), []
    families = {yes: {k: [f for kind, y, f in _half(which) if kind == k and y == yes] for k in EVERY_KIND} for yes in (False, True)}
    for _ in range(n):
        kind, yes = str(rng.choice(EVERY_KIND)), bool(rng.random() < 0.5)
        family = families[yes][kind]
        body = family[int(rng.integers(len(family)))](w)
        bare = kind == "secret" and yes  # a key is a secret where it is called one
        lead = kind if yes and (bare or rng.random() < LED) else "none" if not yes and rng.random() < MISLED else ""
        hint = w.pick(*HINTS[lead]) + (w.pick(" = ", ": ", '="', " = \"", ":") if bare else w.pick(" ", ": ", " is ")) if lead else ""
        glue = "" if yes or rng.random() < 0.7 or kind == "secret" else w.pick("x", "a9", "_", "=")
        left = f"{w.words(3)} {hint}{glue}"
        quote = '"' if hint.endswith('"') else ""
        out.append((f"{left}{body}{quote} {w.words(2)}", (kind, len(left), len(left) + len(body)), int(yes)))
    return out


def _judged(rows: list[tuple[str, Span, int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return np.array([features(t, s) for t, s, _ in rows]), np.array([v for _, _, v in rows], float), np.array([s[0] for _, s, _ in rows])


@cache
def train(n_train: int = N_TRAIN, n_calibrate: int = N_CALIBRATE, precision: float = PRECISION, seed: int = SEED) -> tuple[BoostedTrees, dict[str, float]]:
    """The trees, and for each kind the lowest threshold that keeps the precision on families they have not seen."""
    rng = np.random.default_rng(seed)
    x, y, _ = _judged(_examples(rng, n_train, 0))
    trees = BoostedTrees().fit(x, y)
    x, truth, kinds = _judged(_examples(rng, n_calibrate, 1))
    p, cuts = trees.predict(x), {}
    for kind in EVERY_KIND:
        own = kinds == kind
        order = np.argsort(-p[own], kind="stable")
        good = np.cumsum(truth[own][order]) / np.arange(1, own.sum() + 1) >= precision
        cuts[kind] = float(max(p[own][order][np.flatnonzero(good).max()], 0.5)) if good.any() else 1.1
    return trees, cuts


def measure(n: int = 5000, seed: int = SEED + 1) -> dict[str, tuple[float, float]]:
    """(precision, recall) of each kind on new examples of the families that the trees were not trained on."""
    trees, cuts = train()
    x, truth, kinds = _judged(_examples(np.random.default_rng(seed), n, 1))
    p, out = trees.predict(x), {}
    for kind in EVERY_KIND:
        own = kinds == kind
        said, real = p[own] >= cuts[kind], truth[own] > 0
        out[kind] = (float((said & real).sum() / max(1, said.sum())), float((said & real).sum() / max(1, real.sum())))
    return out


# ---- detection ------------------------------------------------------------


def _merged(base: list[Span]) -> tuple[list[int], list[int]]:
    """Starts and ends of the unions of overlapping base spans."""
    starts: list[int] = []
    ends: list[int] = []
    for s, e in sorted((s, e) for _, s, e in base):
        if ends and s < ends[-1]:
            ends[-1] = max(ends[-1], e)
        else:
            starts.append(s)
            ends.append(e)
    return starts, ends


def open_candidates(text: str, base: list[Span]) -> list[Span]:
    """Candidates that touch no base span; secrets may enclose some, but not be one."""
    found = candidates(text)
    if not found or not base:
        return found
    starts, ends = _merged(base)
    own = {(s, e) for _, s, e in base}
    out = []
    for c in found:
        kind, s, e = c
        first, after = bisect.bisect_right(ends, s), bisect.bisect_left(starts, e)
        if first >= after or kind == "secret" and s <= starts[first] and ends[after - 1] <= e and (s, e) not in own:
            out.append(c)
    return out


def choose(found: list[Span], p: np.ndarray, cuts: dict[str, float]) -> list[Span]:
    """Accepted candidates, best first, that do not overlap each other."""
    best = sorted((-q, c[1], c[2], EVERY_KIND.index(c[0]), c) for q, c in zip(p.tolist(), found, strict=True) if q >= cuts[c[0]])
    starts: list[int] = []
    ends: list[int] = []
    out = []
    for *_, c in best:
        _, s, e = c
        i = bisect.bisect_left(starts, e)  # chosen spans are apart, so the last that starts before e ends last
        if i and ends[i - 1] > s:
            continue
        starts.insert(i, s)
        ends.insert(i, e)
        out.append(c)
    return out


def spans_of(texts: list[str], model: tuple[BoostedTrees, dict[str, float]]) -> list[tuple[list[Span], list[Span]]]:
    """(base spans, all spans by kind as listed, then start) of many texts; the trees see all their candidates at once."""
    trees, cuts = model
    base = [base_spans(t) for t in texts]
    found = [open_candidates(t, b) for t, b in zip(texts, base, strict=True)]
    rows = [features(t, c) for t, own in zip(texts, found, strict=True) for c in own]
    p = trees.predict(np.array(rows)) if rows else np.zeros(0)
    out, at = [], 0
    for b, own in zip(base, found, strict=True):
        added = choose(own, p[at : at + len(own)], cuts) if own else []
        at += len(own)
        out.append((b, sorted([*b, *added], key=lambda x: (EVERY_KIND.index(x[0]), x[1]))))
    return out


def find_spans(text: str, model: tuple[BoostedTrees, dict[str, float]]) -> list[Span]:
    """Base spans and accepted candidates of one text."""
    return spans_of([text], model)[0][1]


def digest_form(spans: list[Span]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)


def redact(text: str, spans: list[Span]) -> str:
    """Each span, or union of overlapping ones, becomes its first kind in brackets."""
    out, at = [], 0
    for k, s, e in sorted(spans, key=lambda x: (x[1], -x[2])):
        if s >= at:
            out += [text[at:s], f"[{k.upper()}]"]
        at = max(at, e)
    return "".join([*out, text[at:]])


COLUMNS = (*(f"n_{k}" for k in KINDS), "base_sha256", "spans", "n_spans", "n_added", "redacted")


def _detect(batches: Iterator[pa.RecordBatch], names: list[str], model: tuple, redacted: bool) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        values = batch.column(1).to_pylist()
        texts = [v or "" for v in values]
        found = spans_of(texts, model)
        cols = [batch.column(0)]
        cols += [pa.array([sum(k == kind for k, _, _ in base) for base, _ in found], pa.int64()) for kind in KINDS]
        cols.append(pa.array([hashlib.sha256(digest_form(base).encode()).hexdigest() for base, _ in found], pa.string()))
        cols.append(pa.array([digest_form(every) for _, every in found], pa.string()))
        cols.append(pa.array([len(every) for _, every in found], pa.int64()))
        cols.append(pa.array([len(every) - len(base) for base, every in found], pa.int64()))
        if redacted:
            cols.append(pa.array([v if v is None else redact(v, every) for v, (_, every) in zip(values, found, strict=True)], pa.string()))
        yield pa.RecordBatch.from_arrays(cols, names)


def detect(df: DataFrame, id_col: str, text_col: str, redacted: bool = False) -> DataFrame:
    """id_col, counts and digest of base spans, all spans, their number and how many were added, and on request the redacted text; one narrow pass."""
    names = [id_col, *(free(c, (id_col,)) for c in COLUMNS[: None if redacted else -1])]
    types = [dict(df.dtypes)[id_col], *["long"] * len(KINDS), "string", "string", "long", "long", "string"]
    schema = ", ".join(f"`{n}` {t}" for n, t in zip(names, types, strict=False))
    return arrow_map(df.select(F.col(id_col), F.col(text_col)), partial(_detect, names=names, model=train(), redacted=redacted), schema)


def _redact_rows(batches: Iterator[pa.RecordBatch], text_col: str, length_col: str | None, model: tuple) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        at = batch.schema.get_field_index(text_col)
        values = batch.column(at).to_pylist()
        found = spans_of([v or "" for v in values], model)
        texts = [v if v is None else redact(v, every) for v, (_, every) in zip(values, found, strict=True)]
        batch = batch.set_column(at, batch.schema.field(at), pa.array(texts, batch.schema.field(at).type))
        if length_col is not None:
            k = batch.schema.get_field_index(length_col)
            batch = batch.set_column(k, batch.schema.field(k), pa.array([t if t is None else len(t) for t in texts], batch.schema.field(k).type))
        yield batch


def redact_documents(df: DataFrame, text_col: str = "text", length_col: str | None = None) -> DataFrame:
    """The same rows and columns with personal data in text_col replaced; length_col, if named, is set to the new length."""
    return arrow_map(df, partial(_redact_rows, text_col=text_col, length_col=length_col, model=train()), df.schema)
