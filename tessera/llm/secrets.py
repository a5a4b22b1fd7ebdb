"""Secret scans by assignment-aware lexing.

A text is lexed as source or configuration: `name = value`, `"name": value`, `name => value`,
`export NAME=value`, whatever the quotes. The value is a concatenation of string literals, bare
literals and names; names seen before stand for their constant (constant propagation). Every
name-literal pair is scored by how sensitive the words of the name are and how key-like the literal
is, and literals scoring `threshold` or more are reported at the place where they were written. Three
fixed lexical rules (assign, access, hex) always apply; spans the lexer adds have kind `lexed`, and
are left out where a fixed rule's span already covers them.

A constant built from other constants is kept as its parts and its character counts, never as a
string, so `a = a + a` line after line costs no memory, and each literal of a secret is reported once.

Defined cases: a null or empty text has no secrets; whole texts are lexed, with names, gaps and values
of any length; repeated documents are scanned one by one; extra columns pass through; offsets are code
points, ends exclusive.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_right
from collections import Counter
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import free_name, text_of, text_udf

# The three base rules.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")
KINDS = ("assign", "access", "hex", "lexed")
KEYWORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
MIN_ASSIGN, MIN_ACCESS = 8, 16

#: How sensitive the words of a name are.
SENSITIVE = {
    "password": 1.0, "passwd": 1.0, "pwd": 0.9, "passphrase": 1.0, "secret": 1.0, "token": 0.9, "apikey": 1.0, "credential": 0.9,
    "credentials": 0.9, "auth": 0.6, "authorization": 0.7, "bearer": 0.8, "private": 0.5, "key": 0.5, "access": 0.3, "api": 0.3,
    "client": 0.2, "signing": 0.4, "encryption": 0.4, "session": 0.3, "salt": 0.5, "pass": 0.7,
}
THRESHOLD = 0.7
_HARMLESS = re.compile(r"(?:your|my|the|some|dummy|example|sample|test|change|replace|placeholder|none|null|true|false|todo|xxx|\*{3}|<|\$\{|%\()", re.I)
# Possessive repeats: what follows can't begin inside them, so nothing is tried twice.
_NAME = r"[A-Za-z_][A-Za-z0-9_.\-]*+"
_STATEMENT = re.compile(rf"""(?<![A-Za-z0-9_.\-])["']?({_NAME})["']?[\x20\t]*+(?:=>|:=|[:=](?!=))[\x20\t]*+(?=["'A-Za-z0-9+/_])""")
_TERM = re.compile(r"""[\x20\t]*+(?:"([^"\n]*+)"|'([^'\n]*+)'|([A-Za-z0-9+/_.=\-]++))""")
_JOINER = re.compile(r"[\x20\t]*+\+(?=[\x20\t]|[\"'])")
_PARTS = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|[0-9]+")
_QUICK = re.compile(r"[A-Za-z0-9_\"'.\-][\x20\t]*+[:=][=>]?[\x20\t]*+[\"'A-Za-z0-9+/_]")
#: Characters at a value's start that tell a placeholder.
_HEAD = 16


def name_score(name: str) -> float:
    """Sensitivity of a target name: its words' weights combined as independent evidence, 0 to 1."""
    words = [w.lower() for w in _PARTS.findall(name)]
    words += [a + b for a, b in zip(words, words[1:])]
    miss = 1.0
    for w in set(words):
        miss *= 1 - SENSITIVE.get(w, 0.0)
    return 1 - miss


class Constant:
    """The value of an assignment: its literals' spans and the constants it was built from, in order."""

    __slots__ = ("_known", "parts", "text")

    def __init__(self, text: str, parts: list[Constant | tuple[int, int]], summary: tuple[Counter, str] | None = None):
        self.text, self.parts, self._known = text, parts, summary
        if any(isinstance(p, Constant) for p in parts):
            self.summary()  # at once: parts are known already, so this never goes deep

    def summary(self) -> tuple[Counter, str]:
        """Character counts and the first characters."""
        if self._known is None:
            counts, head = Counter(), ""
            for p in self.parts:
                own, start = p.summary() if isinstance(p, Constant) else (Counter(self.text[p[0] : p[1]]), self.text[p[0] : min(p[1], p[0] + _HEAD)])
                counts.update(own)
                head = (head + start)[:_HEAD]
            self._known = counts, head
        return self._known

    def spans(self, seen: set[int]) -> list[tuple[int, int]]:
        """Spans of the literals it was built from, but for constants in `seen`, which gets all met."""
        out, todo = [], [self]
        while todo:
            now = todo.pop()
            if id(now) not in seen:
                seen.add(id(now))
                out += [p for p in now.parts if not isinstance(p, Constant)]
                todo += [p for p in now.parts if isinstance(p, Constant)]
        return out


def literal_score(counts: Counter, head: str) -> float:
    """How key-like a literal is, from its character counts and first characters: length, entropy, mixture of classes.

    0 for placeholders, short ones and such with control characters.
    """
    n = sum(counts.values())
    if n < 8 or _HARMLESS.match(head) or not all(map(str.isprintable, counts)):
        return 0.0
    entropy = -sum(c / n * math.log2(c / n) for c in counts.values() if c / n > 0)
    has = ["a" <= c <= "z" and 1 or "A" <= c <= "Z" and 2 or "0" <= c <= "9" and 3 or 4 for c in counts]
    classes = len(set(has))
    return min(1.0, entropy / 3.5) * (0.6 if classes == 1 and not all(map(str.isdigit, counts)) else 1.0) * (0.5 if " " in counts else 1.0)


def lex(text: str) -> list[tuple[str, Constant]]:
    """Name and constant value of each assignment, in order.

    Assignments inside a bare literal (`a=b=c`) share its end, and their counts are taken from one
    running tail. A joined bare literal that holds an assignment is the next statement's.
    """
    known: dict[str, Constant] = {}
    out, longest, bare, tail, tail_at = [], 0, (0, 0), None, 0
    for statement in _STATEMENT.finditer(text):
        name, at = statement[1], statement.end()
        parts: list[Constant | tuple[int, int]] = []
        while True:
            if bare[0] < at < bare[1]:
                tail, tail_at = tail if tail is not None else Counter(text[at : bare[1]]), tail_at if tail is not None else at
                tail.subtract(text[tail_at:at])
                tail_at, kind, span, end = at, 3, (at, bare[1]), bare[1]
            elif term := _TERM.match(text, at):
                kind, span, end = term.lastindex, term.span(term.lastindex), term.end()
                if kind == 3 and parts and "=" in text[span[0] : span[1]].rstrip("="):
                    break
                if kind == 3:
                    bare, tail = span, None
            else:
                break
            constant = known.get(text[span[0] : span[1]]) if kind == 3 and span[1] - span[0] <= longest else None
            if constant is None and tail is not None and span[1] == bare[1] and span[0] == tail_at:
                constant = Constant(text, [span], (+tail, text[at : min(end, at + _HEAD)]))
            parts.append(constant or span)
            at = end
            if not (joiner := _JOINER.match(text, at)):
                break
            at = joiner.end()
        if any(isinstance(p, Constant) or p[1] > p[0] for p in parts):
            value = parts[0] if len(parts) == 1 and isinstance(parts[0], Constant) else Constant(text, parts)
            known[name] = value
            longest = max(longest, len(name))
            out.append((name, value))
    return out


def base_spans(text: str) -> list[tuple[int, str, int]]:
    """(start, kind, end) by the fixed rules."""
    found = [(m.start(), "hex", m.end()) for m in HEX.finditer(text)]
    if "AKIA" in text:
        found += [(m.start(), "access", m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= MIN_ACCESS]
    low = text.lower()
    if any(w in low for w in KEYWORDS):
        found += [(m.start(), "assign", m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= MIN_ASSIGN]
    return found


def scan(text: str, threshold: float = THRESHOLD) -> tuple[list[tuple[int, str, int]], list[tuple[int, str, int]]]:
    """Base spans and all spans of a text, each by start, then kind as listed."""
    order = lambda s: (s[0], KINDS.index(s[1]), s[2])
    base = sorted(base_spans(text), key=order)
    starts, reach = [s for s, _, _ in base], list(accumulate((e for _, _, e in base), max))
    covered = lambda a, b: (k := bisect_right(starts, a)) > 0 and reach[k - 1] >= b
    added = set()
    if _QUICK.search(text):
        seen: set[int] = set()
        found = lex(text)
        for name, value in found:
            sensitive = name_score(name)
            if sensitive >= 0.5 and (key_like := literal_score(*value.summary())) > 0 and (sensitive + key_like) / 2 >= threshold:
                added.update((a, "lexed", b) for a, b in value.spans(seen) if b > a and not covered(a, b))
    return base, sorted([*base, *added], key=order)


_ROW = "struct<n_assign:bigint,n_access:bigint,n_hex:bigint,base:string,spans:string,redacted:string>"
_ROW_ARROW = pa.struct([("n_assign", pa.int64()), ("n_access", pa.int64()), ("n_hex", pa.int64()), ("base", pa.string()), ("spans", pa.string()), ("redacted", pa.string())])


def redact(text: str, spans: list[tuple[int, str, int]], mark: str = "[SECRET]") -> str:
    """The text with every span, overlaps merged, replaced by `mark`."""
    out, at = [], 0
    end = -1
    for a, _, b in spans:
        if a >= end:
            out += [text[at:a], mark] if a >= at else []
        end = at = max(at, b)
    return "".join([*out, text[at:]])


def _scanner(redacting: bool, threshold: float):
    show = lambda spans: ",".join(f"{k}:{a}:{b}" for a, k, b in spans)

    def make():
        def run(texts: list[str]) -> list[dict]:
            rows = []
            for text in texts:
                base, spans = scan(text, threshold)
                n = Counter(k for _, k, _ in base)
                rows.append(
                    {"n_assign": n["assign"], "n_access": n["access"], "n_hex": n["hex"], "base": show(base), "spans": show(spans)}
                    | {"redacted": redact(text, spans) if redacting and spans else None}
                )
            return rows

        return run

    return text_udf(make, _ROW, _ROW_ARROW)


def scan_column(text: Column, redacting: bool = False, threshold: float = THRESHOLD) -> Column:
    """Struct of counts, base spans, all spans and, if asked for and anything was found, the redacted text."""
    return _scanner(redacting, threshold)(text)


def report(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """One row per document: counts and digest of the base spans, and all spans."""
    found = docs.select("doc_id", scan_column(text_of(docs), threshold=threshold).alias("f"))
    return found.select(
        "doc_id",
        F.col("f.n_assign").alias("n_assign"),
        F.col("f.n_access").alias("n_access"),
        F.col("f.n_hex").alias("n_hex"),
        F.sha2("f.base", 256).alias("base_sha256"),
        F.col("f.spans").alias("spans"),
    )


def redact_secrets(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """`docs` with every secret replaced in text (n_chars, if there, follows); no row goes, a null text stays null."""
    name = free_name(docs, "secrets_")
    found = docs.withColumn(name, scan_column(text_of(docs), redacting=True, threshold=threshold))
    redacted = F.col(name)["redacted"]
    text = F.coalesce(redacted, F.col("text"))
    changed = redacted.isNotNull()
    columns = {"text": text}
    if "n_chars" in docs.columns:
        columns["n_chars"] = F.when(changed, F.length(redacted).cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))
    return found.withColumns(columns).drop(name)
