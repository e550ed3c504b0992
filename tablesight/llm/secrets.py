"""Secret scan: fixed patterns, and guess-cost of values in credential contexts.

Patterns find assignments, access keys and hexadecimal digests. Beyond them, a value that follows a
name with a credential word in it (``DB_PASSWORD``, ``secretKey``), or stands as the password of a url, is judged by how many guesses it takes: the
cheapest way to cut it into dictionary words, dates, repeats, keyboard walks and brute-force spans,
by dynamic programming over its characters. Values that take ``GUESSES`` (as a power of ten) or more
are secrets of kind ``guess``; weaker ones are placeholders and stay. Spans are code points, end
exclusive.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Kinds in the order in which spans that start together are listed.
KINDS = ("assign", "access", "hex", "guess")
LEAST_VALUE = 8
GUESSES = 9.0

ASSIGN = re.compile(r"""(?ai:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]{12,}")  # 16 characters in all
HEX = re.compile(r"[0-9a-f]{32,}")
# A credential word is a part of a name: parts are set off by underscores, hyphens, digits or a change of case.
# The longer words also end a run of letters (dbpassword), and password stands anywhere in one.
_NAME = "[A-Za-z0-9_-]"
_FROM = "(?:(?<![A-Za-z])|(?<=[a-z])(?=[A-Z])|(?<=[A-Z])(?=[A-Z][a-z]))"
_TO = "(?:(?![A-Za-z])|(?<=[a-z])(?=[A-Z])|(?<=[A-Z])(?=[A-Z][a-z]))"
_CREDENTIAL = (
    f"(?:(?ai:password|passwd|api[_-]?key)"
    f"|(?ai:passphrase|passcode|pwd|secret|token|credential|(?:private|access|client|signing)[_-]?(?:key|secret))(?:[sS]?{_TO})"
    f"|{_FROM}(?ai:pass|auth(?:orization)?){_TO})"
)
CONTEXT = re.compile(
    rf"""(?<!{_NAME})(?={_NAME}++["'\])]?\s{{0,4}}[:=])(?={_NAME}*?{_CREDENTIAL}){_NAME}++"""
    r"""["'\])]?\s{0,4}(?:[:=]|=>|:=)\s{0,4}(?:(?ai:bearer|basic)\x20)?["'`]?([^\s"'`<>,;{}()\[\]|]{6,})"""
    r"""|(?ai:\bbearer\x20)([^\s"'`<>,;{}()\[\]|]{6,})"""
    r"""|://[^\s/:@"'<>]+:([^\s/@"'<>]{4,})@"""
)

# Common parts of passwords, the most common first; keyboard rows.
WORDS = (
    "password", "pass", "admin", "welcome", "login", "letmein", "qwerty", "dragon", "monkey", "master", "secret", "changeme",
    "default", "example", "test", "user", "root", "guest", "hello", "love", "summer", "winter", "spring", "autumn", "sun", "star",
    "super", "access", "shadow", "football", "baseball", "princess", "flower", "sample", "dummy", "placeholder", "your", "my",
    "the", "key", "token", "api", "here", "none", "null", "true", "false", "redacted", "hidden", "value", "string", "prod", "dev",
    "demo", "temp", "new", "old", "me", "foo", "bar", "baz", "abc",
)
ROWS = ("1234567890-=", "qwertyuiop[]", "asdfghjkl;'", "zxcvbnm,./")

_RANK = {w: math.log10(i + 2) for i, w in enumerate(WORDS)}
_LONGEST = max(map(len, WORDS))
_LEET = str.maketrans("4@301$57!", "aaeoisstl")
_DATE = re.compile(r"(?:19|20)\d\d(?:[-/.]?(?:0[1-9]|1[0-2])(?:[-/.]?(?:0[1-9]|[12]\d|3[01]))?)?|(?:0[1-9]|[12]\d|3[01])[-/.]?(?:0[1-9]|1[0-2])[-/.]?(?:(?:19|20)\d\d|\d\d)")
_NEAR = {
    (a, b)
    for r, row in enumerate(ROWS)
    for c, a in enumerate(row)
    for dr, dc in ((0, 1), (0, -1), (1, 0), (1, -1), (-1, 0), (-1, 1))
    if 0 <= r + dr < len(ROWS) and 0 <= c + dc < len(ROWS[r + dr])
    for b in ROWS[r + dr][c + dc]
}
#: Tenth powers of any span, a walk's start, a walk's turn and a date.
_SPAN, _START, _TURN, _DAY = 0.3, 1.6, 0.35, 4.0


def _alphabet(ch: str) -> float:
    """Tenth power of the size of the class a character is drawn from."""
    if ch.isdigit():
        return 1.0
    if ch.isalpha():
        return math.log10(26) if ch.isascii() else 2.0
    return 0.5 if ch in "_-. " else 1.5


def guess_cost(value: str) -> float:
    """Tenth power of the guesses for ``value`` along its cheapest segmentation; 0 for an empty one.

    Time grows with the length: words and dates are short, and walks and repeats are carried along.
    """
    lower = value.lower()
    plain, n = lower.translate(_LEET) if len(lower) == len(value) else lower, len(value)
    if len(lower) != n:  # case changes that alter the length are not folded
        lower = plain = value
    best, walk, dates = [0.0] + [math.inf] * n, [math.inf] * (n + 1), {}
    for found in _DATE.finditer(value):
        dates.setdefault(found.end(), []).append(found.start())
    brute, runs = math.inf, {}
    for j in range(1, n + 1):
        ch = value[j - 1]
        # A brute-force span that goes on, or one that starts at this character.
        brute = min(brute, best[j - 1] + _SPAN) + _alphabet(ch) + (math.log10(2) if ch.isupper() else 0)
        options = [brute]
        if j > 1 and (lower[j - 2], lower[j - 1]) in _NEAR:
            walk[j] = min(walk[j - 1] + (0.0 if j > 2 and _straight(lower, j) else _TURN), best[j - 2] + _SPAN + _START + _TURN)
            options.append(walk[j])
        for period in range(1, min(16, j // 2) + 1):
            if lower[j - 1] == lower[j - 1 - period]:
                length, start = runs.get(period, (0, j - 1 - period))
                length, start = (length + 1, start) if length else (1, j - 1 - period)
                runs[period] = (length, start)
                if length >= period and start + period <= j:
                    options.append(best[start + period] + _SPAN + math.log10(1 + length // period))
            else:
                runs.pop(period, None)
        for i in range(max(0, j - _LONGEST), j - 1):
            for text, extra in ((lower, 0.0), (plain, 0.5)):
                rank = _RANK.get(text[i:j])
                if rank is not None:
                    cased = 0.0 if value[i:j] == lower[i:j] else 0.5
                    options.append(best[i] + _SPAN + rank + extra + cased)
        options += [best[i] + _SPAN + _DAY for i in dates.get(j, ())]
        best[j] = min(options)
    return best[n]


def _straight(text: str, j: int) -> bool:
    """Whether the last two steps of a walk go the same way along a row."""
    a, b, c = text[j - 3 : j]
    return any((a + b + c) in row or (c + b + a) in row for row in ROWS)


def find_secrets(text: str | None, guesses: float = GUESSES) -> list[tuple[str, int, int]]:
    """Spans (kind, start, end) of a whole text, sorted by start and then kind as listed; null gives none."""
    if not text:
        return []
    base = [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= LEAST_VALUE]
    base += [("access", *m.span()) for m in ACCESS.finditer(text)]
    base += [("hex", *m.span()) for m in HEX.finditer(text)]
    covered, added = sorted((s, e) for _, s, e in base), []
    at, far = 0, -1
    for m in CONTEXT.finditer(text):
        start, end = m.span(m.lastindex)
        while at < len(covered) and covered[at][0] <= start:
            far = max(far, covered[at][1])
            at += 1
        if far < end and guess_cost(text[start:end]) >= guesses:
            added.append(("guess", start, end))
    return sorted(base + added, key=lambda x: (x[1], KINDS.index(x[0])))


def redacted(text: str | None, mark: str = "[SECRET]") -> str | None:
    """``text`` with every span, or run of overlapping spans, replaced by ``mark``; null stays null."""
    spans = [(s, e) for _, s, e in find_secrets(text)]
    if not spans:
        return text
    out, at, until = [], 0, -1
    for start, end in spans:
        if start >= until:
            out += [text[at:start] if at <= start else "", mark]
        until = max(until, end)
        at = until
    return "".join([*out, text[at:]])


def scan(docs: DataFrame) -> DataFrame:
    """Per row of ``docs``: doc_id, counts per kind, the digest of the pattern spans, and all spans.

    ``spans`` is kind:start:end, comma-joined. A null or empty text has no spans. Other columns are not read.
    """

    @F.pandas_udf("n_assign long, n_access long, n_hex long, n_guess long, base_sha256 string, spans string")
    def found(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            rows = []
            for text in texts:
                spans = find_secrets(text if isinstance(text, str) else None)
                kinds = [k for k, _, _ in spans]
                listed = [f"{k}:{s}:{e}" for k, s, e in spans]
                base = ",".join(x for x, k in zip(listed, kinds, strict=True) if k != "guess")
                rows.append((*map(kinds.count, KINDS), hashlib.sha256(base.encode()).hexdigest(), ",".join(listed)))
            yield pd.DataFrame(rows, columns=["n_assign", "n_access", "n_hex", "n_guess", "base_sha256", "spans"])

    return docs.select("doc_id", found(F.col("text").cast("string")).alias("found")).select("doc_id", "found.*")


def redact(text: Column) -> Column:
    """A text column with its secrets replaced."""

    @F.pandas_udf("string")
    def clean(texts: pd.Series) -> pd.Series:
        return pd.Series([redacted(t) if isinstance(t, str) else None for t in texts], dtype="object")

    return clean(text.cast("string"))


def without_secrets(docs: DataFrame) -> DataFrame:
    """``docs`` with redacted texts and, where a text changed, its length in ``n_chars``; other columns stay as they are."""
    mark = next(n for i in range(len(docs.columns) + 1) if (n := f"clean_{i}") not in docs.columns)
    changed = ~F.col(mark).eqNullSafe(F.col("text"))
    out = {"text": F.col(mark), "n_chars": F.when(changed, F.length(mark).cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))}
    return docs.withColumn(mark, redact(F.col("text"))).select(*[out.get(c, F.col(f"`{c}`")).alias(c) for c in docs.columns])
