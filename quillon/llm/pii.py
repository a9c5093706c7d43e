"""Personal data: candidate generation, gradient-boosted trees and calibrated thresholds.

Base spans (email, ip, card, phone) follow fixed formats and always stay. Generators of high recall then propose further, overlapping spans: emails
spelled out with "at" and "dot", valid version 6 addresses, long digit groups, phone numbers without a plus sign, values of named secrets and long mixed runs
of letters and digits. Boosted trees rate each by its format and its context; a logistic curve calibrates the ratings, and a kind's threshold is the least
one that keeps the wanted precision. Trees, curve and thresholds are fitted on three separate sets of examples. Of overlapping candidates the best rated one is
selected; none that meets a base span is. Secrets are a kind of their own, after the four of the base.

The examples are written from templates under a fixed seed (FIT_EXAMPLES of them), as the tables hold no labels for spans: personal data, and look-alikes such as
order numbers, dates, versions, digests, clock times and scoped names, in contexts that suggest the one, the other or nothing.
Scanning is one pass over whole texts, linear in their length: formats whose plain regular expression would scan a run of characters again and again
are matched from their rare character (`@`, `:`, a digit) outwards.

Defined cases: a null text counts as empty and has no spans; very long texts are scanned whole; repeated rows agree; an empty table gives an empty result; input columns
named like a result column are replaced by it; candidates that tie are taken from the left.
"""

from __future__ import annotations

import ipaddress
import re
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillon.llm.common import table
from quillon.runtime import map_columns

KINDS = ("email", "ip", "card", "phone", "secret")
BASE_KINDS = 4
FIT_EXAMPLES = 9000
PRECISION = 0.97
Span = tuple[int, int, int]  # start, kind, end

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+)+")
_NUMBER = re.compile(r"[0-9]+")
_GROUPED = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_DIGITS = re.compile(r"[^0-9]+")


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def _emails(text: str) -> list[Span]:
    out, pos = [], 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > pos and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            out.append((start, 0, m.end()))
            pos = m.end()
        at = text.find("@", max(at + 1, pos))
    return out


def _octet(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) < 4 and int(part or "0") <= 255


def _ips(text: str) -> list[Span]:
    out = []
    for m in _DOTTED.finditer(text):
        parts = list(_NUMBER.finditer(text, m.start(), m.end()))
        for k in range(0, len(parts) - 3, 4):
            if all(_octet(p[0]) for p in parts[k : k + 4]):
                out.append((parts[k].start(), 1, parts[k + 3].end()))
    return out


def base_spans(text: str) -> list[Span]:
    """Spans in code points, by start, then kind."""
    out = _emails(text) if "@" in text else []
    if _DIGIT.search(text):
        if "." in text:
            out += _ips(text)
        for m in _GROUPED.finditer(text):
            if m.end() - m.start() >= 12:
                digits = _DIGITS.sub("", m[0])
                if 12 <= len(digits) <= 19 and luhn(digits):
                    out.append((m.start(), 2, m.end()))
        if "+" in text:
            out += [(m.start(), 3, m.end()) for m in _PHONE.finditer(text) if 9 <= len(_DIGITS.sub("", m[0])) <= 15]
    return sorted(out)


# ---- candidates

_SPELLED = re.compile(r"(?:\(dot\)|\[dot\]| dot |\(at\)|\[at\]| at )", re.I)
_SPELLED_AT = re.compile(r"([A-Za-z0-9._%+-]{1,64}) ?(?:@|\(at\)|\[at\]| at ) ?([A-Za-z0-9-]{1,63}(?:(?:\.| ?\(dot\) ?| ?\[dot\] ?| dot )[A-Za-z0-9-]{1,63})+)", re.I)
_HEX = frozenset("0123456789abcdefABCDEF:")
_LONG = re.compile(r"\(?[0-9][0-9 ()./-]{5,}[0-9]")
_PART = re.compile(r"\(?[0-9](?:[ .-]?[0-9])+(?:[ ./()-]{1,2}[0-9]+)*")
_RUN = re.compile(r"[A-Za-z0-9+/_=-]{20,}")
_NAMED = re.compile(r"(?:passw(?:or)?d|pwd|secret|token|api[_ -]?key)[\"']?\s{0,3}[:=]\s{0,3}[\"']?([^\s\"']{6,200})", re.I)
_ADDRESS = 45  # characters of the longest version 6 address
#: Words that the context features look for.
WORDS = {
    "email": ("email", "e-mail", "mail", "contact", "write"),
    "ip": ("ip", "host", "server", "address", "ping", "gateway", "client"),
    "card": ("card", "visa", "mastercard", "amex", "credit", "debit", "payment", "account"),
    "phone": ("phone", "tel", "call", "mobile", "fax", "cell", "dial"),
    "secret": ("token", "secret", "password", "passwd", "pwd", "key", "auth", "bearer", "credential"),
    "other": ("isbn", "order", "invoice", "version", "serial", "page", "id", "ref", "doi", "sku", "section", "total", "tracking", "at", "pi"),
    "digest": ("commit", "sha", "sha1", "sha256", "md5", "hash", "checksum", "digest", "revision", "etag", "file", "path"),
}
_CONTEXT = {k: re.compile(r"(?<![a-z])(?:" + "|".join(map(re.escape, v)) + r")(?![a-z])") for k, v in WORDS.items()}


def valid_address(text: str) -> bool:
    try:
        return len(text) <= _ADDRESS and ipaddress.IPv6Address(text) is not None
    except ValueError:
        return False


def candidates(text: str) -> list[Span]:
    """Proposed spans, overlapping ones too."""
    out = []
    for m in _SPELLED.finditer(text):
        low = max(0, m.start() - 140)
        out += [(x.start(), 0, x.end()) for x in _SPELLED_AT.finditer(text, low, min(len(text), m.end() + 140)) if x.start() <= m.start() < x.end()]
    done = 0
    at = text.find(":")
    while at >= 0:
        s, e = at, at
        while s > done and text[s - 1] in _HEX:
            s -= 1
        while e < len(text) and text[e] in _HEX:
            e += 1
        if valid_address(text[s:e]):
            out.append((s, 1, e))
        done = e
        at = text.find(":", max(e, at + 1))
    if _DIGIT.search(text):
        for m in _LONG.finditer(text):
            for part in _PART.finditer(m[0]):
                s, e = m.start() + part.start(), m.start() + part.end()
                n = len(_DIGITS.sub("", part[0]))
                if 12 <= n <= 19:
                    out.append((s, 2, e))
                if 7 <= n <= 15:
                    out.append((s, 3, e))
        out += [(m.start(), 2, m.end()) for m in _NUMBER.finditer(text) if 12 <= m.end() - m.start() <= 19]  # beside other numbers too
        out += [(m.start(), 4, m.end()) for m in _RUN.finditer(text) if _DIGIT.search(m[0]) and not m[0].isdigit()]
    out += [(m.start(1), 4, m.end(1)) for m in _NAMED.finditer(text)]
    return sorted(set(out))


_DATE = re.compile(r"(?:19|20)\d\d[-/.]?\d\d?[-/.]?\d\d?(?:\d{2,6})?|\d\d?[-/.]\d\d?[-/.](?:19|20)\d\d")


def spread(text: str) -> float:
    """Bits a character, by the characters' shares."""
    n = np.unique(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4"), return_counts=True)[1] / max(1, len(text))
    return float(-(n * np.log2(n)).sum())


def features(text: str, span: Span) -> list[float]:
    start, kind, end = span
    own = text[start:end]
    digits = _DIGITS.sub("", own)
    groups = [len(x) for x in _NUMBER.findall(own)]
    before = text[max(0, start - 40) : start].lower()
    near = before.rstrip(" \"'")
    prior, after = text[start - 1 : start], text[end : end + 1]
    return [
        *(float(kind == k) for k in range(len(KINDS))),
        len(own), len(digits), len(digits) / len(own), len(groups), max(groups, default=0), min(groups, default=0),
        float(len(digits) > 1 and luhn(digits)), float(len(set(digits)) <= 2), float(own.startswith("(")), float(own.startswith("00")),
        float(len({c for c in own if c in " ./-"})), own.count(":"), float("::" in own), float("dot" in own.lower()),
        *(float(bool(p.search(before))) for p in _CONTEXT.values()),
        float(near.endswith(("=", ":"))), spread(own[:200]), float(all(c in _HEX for c in own)), float("/" in own or "_" in own),
        float(prior.isalnum() or prior in ("=", "#", "/", ".", "_", "$")), float(after.isalnum() or after in ("%", "/", "_")),
        float(bool(_DATE.fullmatch(own))), float(digits.startswith(("15", "16", "17", "18")) and len(digits) == 13),
    ]


# ---- boosted trees


def fit_tree(x: np.ndarray, g: np.ndarray, h: np.ndarray, cuts: list[np.ndarray], depth: int, least: int = 8):
    """A regression tree on gradients and curvatures, as nested (feature, cut, left, right) or a leaf's value."""
    leaf = float(-g.sum() / (h.sum() + 1.0))
    if depth == 0 or len(g) < 2 * least:
        return leaf
    best, root = (1e-6, None, None), g.sum() ** 2 / (h.sum() + 1.0)
    for j, values in enumerate(cuts):
        for cut in values:
            left = x[:, j] <= cut
            n = int(left.sum())
            if least <= n <= len(g) - least:
                gl, hl = g[left].sum(), h[left].sum()
                gain = gl**2 / (hl + 1) + (g.sum() - gl) ** 2 / (h.sum() - hl + 1) - root
                if gain > best[0]:
                    best = (gain, j, cut)
    if best[1] is None:
        return leaf
    left = x[:, best[1]] <= best[2]
    return best[1], float(best[2]), fit_tree(x[left], g[left], h[left], cuts, depth - 1, least), fit_tree(x[~left], g[~left], h[~left], cuts, depth - 1, least)


def tree_value(tree, row) -> float:
    while isinstance(tree, tuple):
        tree = tree[2] if row[tree[0]] <= tree[1] else tree[3]
    return tree


def fit_boosting(x: np.ndarray, y: np.ndarray, trees: int = 40, depth: int = 3, rate: float = 0.3) -> list:
    cuts = [np.unique(np.quantile(c, np.linspace(0.05, 0.95, 10))) for c in x.T]
    margin, out = np.zeros(len(y)), []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-margin))
        tree = fit_tree(x, p - y, p * (1 - p), cuts, depth)
        margin += rate * np.array([tree_value(tree, r) for r in x])
        out.append(tree)
    return out


def margin(trees: list, row, rate: float = 0.3) -> float:
    return rate * sum(tree_value(t, row) for t in trees)


def examples(n: int, seed: int = 11) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features, labels and kinds of candidates in texts written from templates."""
    rng = np.random.default_rng(seed)
    pick = lambda options: options[int(rng.integers(len(options)))]
    digits = lambda k: "".join(map(str, rng.integers(0, 10, k)))
    word = lambda: "".join(pick(["er", "an", "on", "the", "ti", "es", "or"]) for _ in range(int(rng.integers(1, 4))))
    letters = lambda k, alphabet: "".join(alphabet[int(v)] for v in rng.integers(0, len(alphabet), k))
    hexes = lambda k: ":".join("%x" % v for v in rng.integers(1, 65536, k))
    plain, base64 = "0123456789abcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789_-"

    def card() -> str:
        """Sixteen digits that pass the check, or, as typed by hand, don't."""
        own = pick(["4", "5", "37", "6011"])
        own += digits(15 - len(own))
        own += next(str(c) for c in range(10) if luhn(own + str(c))) if rng.random() < 0.5 else digits(1)
        return pick(["", " ", ".", "-"]).join(own[k : k + 4] for k in range(0, 16, 4))

    secret = lambda: pick([letters(int(rng.choice([24, 32, 40, 64])), plain), letters(int(rng.integers(20, 60)), base64), "sk-" + letters(32, base64[:-2])])
    day = lambda: f"20{digits(2)}{pick(['-', '', '/', '.'])}0{1 + int(rng.integers(9))}{pick(['-', '', '/', '.'])}1{digits(1)}"
    positive = {
        0: lambda: f"{word()} {pick(['(at)', '[at]', 'at'])} {word()}{pick([' dot ', ' (dot) ', '.'])}{pick(['com', 'org', 'net', 'de', 'fr'])}",
        1: lambda: pick([hexes(8), f"fe80::{hexes(4)}", f"2001:db8::{hexes(3)}", f"{hexes(2)}::{hexes(1)}"]),
        2: card,
        3: lambda: pick(["({}) {}-{}", "{}-{}-{}", "{}.{}.{}", "0{} {} {}"]).format(digits(3), digits(3), digits(4)),
        4: secret,
    }
    negative = {
        0: lambda: f"{word()} at {word()}{pick([' dot ', '.'])}{word()}",
        1: lambda: pick([f"{letters(2, 'abcdef')}::{letters(3, 'abcdef')}", f"::{letters(3, 'abcdef')}"]),
        2: lambda: pick([digits(13), "1" + digits(12), digits(14), day() + digits(6), f"{digits(6)}-{digits(8)}", f"{digits(8)} {digits(6)}", f"0.{digits(14)}", digits(18)]),
        3: lambda: pick([day(), digits(8), digits(10), f"{digits(4)}/{digits(4)}", f"{digits(2)}.{digits(2)}.{digits(3)}.{digits(2)}", f"{digits(5)} {digits(5)}", f"{digits(4)}-{digits(4)}"]),
        4: lambda: pick([letters(40, plain), letters(64, plain), f"{word()}_{word()}_{word()}_{word()}_{digits(3)}", f"/{word()}/{word()}/{word()}{word()}/{digits(4)}", "-".join(letters(k, plain) for k in (8, 4, 4, 4, 12)), "=" * 20 + digits(1)]),
    }
    no_cue = {0: 0.4, 1: 0.4, 2: 0.5, 3: 0.1, 4: 0.05}
    rows, labels, kinds = [], [], []
    while len(rows) < n:
        kind, label = int(rng.integers(len(KINDS))), int(rng.integers(2))
        lead = f"{word()} {word()} "
        if label:
            cue = f"{pick(WORDS[KINDS[kind]])}{pick([': ', ' ', ' is '] if kind < BASE_KINDS else [' = ', '=', ': ', ' = ' + chr(34), ': ' + chr(34)])}" if rng.random() >= no_cue[kind] else ""
            core = positive[kind]()
        else:
            strange = "digest" if kind == 4 else "other"
            confused = rng.random() < 0.3 and kind in (2, 3)  # the format of personal data where a word says that it is none
            cue = f"{pick(WORDS[strange])}{pick([': ', ' ', ' #'])}" if confused or rng.random() < 0.5 else ""
            core = positive[kind]() if confused else negative[kind]()
        text = f"{lead}{cue}{core}{pick(['', '.', ',', chr(34)])} {word()}"
        start = len(lead) + len(cue)
        for s in candidates(text):
            if s[1] == kind and s[0] <= start + 1 and s[2] >= start + len(core) - 1:
                rows.append(features(text, s))
                labels.append(label)
                kinds.append(kind)
    return np.array(rows), np.array(labels, float), np.array(kinds)


@cache
def fit(n: int = FIT_EXAMPLES, precision: float = PRECISION):
    """Trees, the calibrating curve's slope and offset, and each kind's threshold, from three fifths, a fifth and a fifth of the examples."""
    x, y, kind = examples(n)
    part = np.arange(len(y)) % 5
    trees = fit_boosting(x[part < 3], y[part < 3])
    m = np.array([margin(trees, r) for r in x])
    curve, last = part == 3, part == 4
    a, b = 1.0, 0.0
    for _ in range(300):
        p = 1 / (1 + np.exp(-(a * m[curve] + b)))
        a -= 0.2 * float(((p - y[curve]) * m[curve]).mean()) / max(1.0, float((m[curve] ** 2).mean() / 4))
        b -= 0.5 * float((p - y[curve]).mean())
    p = 1 / (1 + np.exp(-(a * m + b)))
    thresholds = []
    for k in range(len(KINDS)):
        own = last & (kind == k)
        order = np.argsort(-p[own], kind="stable")
        rated = p[own][order]
        right = np.cumsum(y[own][order]) / np.arange(1, own.sum() + 1)
        good = np.flatnonzero((right >= precision) & np.append(rated[1:] < rated[:-1], True))  # ties enter together
        thresholds.append(float(rated[good[-1]]) if len(good) else 2.0)
    return trees, a, b, thresholds


def added_spans(text: str, base: list[Span], model) -> list[Span]:
    trees, a, b, thresholds = model
    rated = []
    for s in candidates(text):
        p = 1 / (1 + np.exp(-(a * margin(trees, features(text, s)) + b)))
        if p >= thresholds[s[1]]:
            rated.append((-p, s))
    taken, out = list(base), []
    for _, s in sorted(rated):
        if all(s[2] <= t[0] or t[2] <= s[0] for t in taken):
            taken.append(s)
            out.append(s)
    return out


def written(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in sorted(spans))


def redact(text: str, spans: list[Span]) -> str:
    """The text with each span, overlapping ones joined, replaced by its kind in brackets."""
    out, pos = [], 0
    for s, k, e in sorted(spans):
        if s >= pos:
            out += [text[pos:s], f"[{KINDS[k].upper()}]"]
        pos = max(pos, e)
    return "".join(out) + text[pos:]


COUNTED = [*(f"n_{k}" for k in KINDS[:BASE_KINDS]), "n_spans"]
FOUND = T.StructType([*(T.StructField(c, T.LongType()) for c in COUNTED), T.StructField("base_spans", T.StringType()), T.StructField("spans", T.StringType()), T.StructField("redacted", T.StringType())])


def find_pii(docs: DataFrame, model=None, text_col: str = "text") -> DataFrame:
    """docs with the base spans' counts, n_spans (of all spans), base_spans and spans (kind:start:end, comma-joined) and the redacted text."""
    shared = docs.sparkSession.sparkContext.broadcast(model or fit())

    def make():
        trained = shared.value

        def f(b: pa.RecordBatch) -> list[pa.Array]:
            rows = []
            for text in b.column(text_col).to_pylist():
                text = text or ""
                base = base_spans(text)
                spans = base + added_spans(text, base, trained)
                kinds = [k for _, k, _ in base]
                rows.append((*(kinds.count(k) for k in range(BASE_KINDS)), len(spans), written(base), written(spans), redact(text, spans)))
            return [pa.array([r[k] for r in rows], pa.int64() if k < 5 else pa.string()) for k in range(8)]

        return f

    return map_columns(docs, FOUND, make)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_pii(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", *COUNTED[:BASE_KINDS], F.sha2("base_spans", 256).alias("base_sha256"), "spans", "n_spans")
