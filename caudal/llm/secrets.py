"""Secret scans: fixed patterns, and an assignment-aware lexer with constant propagation.

``assignments`` turns a whole text into name-literal pairs that point to the pairs they
take over. Where a pair's name is sensitive, each literal that can be reached from it is
scored: name, length, variety and entropy count for it, placeholders and references
against.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caudal.llm.assignments import REFERENCE, WORDS, Pair, pairs
from caudal.llm.tables import whole_text

# The contract's patterns.
ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE
)
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
KINDS = ("assign", "access", "hex", "literal")

# Words that make a name sensitive, alone or with the word after them.
SENSITIVE = {
    "apikey", "auth", "authorization", "bearer", "credential", "credentials", "passphrase", "passwd", "password",
    "passwort", "privatekey", "pwd", "secret", "token", "contraseña", "clave",
}
KEYED = {"access", "api", "auth", "client", "encryption", "master", "private", "secret", "signing", "storage", "ssh"}
# Last words of names that hold something about a secret, not the secret.
HARMLESS = {
    "count", "expiry", "field", "file", "header", "id", "label", "length", "limit", "name", "path", "policy", "prefix",
    "ttl", "type", "uri", "url",
}
PLACEHOLDER = re.compile(r"change_?me|example|placeholder|your[_-]|dummy|redacted|x{4,}|\*{3,}|<[^>]*>|^(none|null|true|false|undefined)$", re.I)

# Names under which several words in a row may be the secret.
PHRASED = {"clave", "contraseña", "passphrase", "passwd", "password", "passwort", "pwd"}

_SCHEME = re.compile(r"^(?:Basic|Bearer|Token)\s+", re.I)
_THRESHOLD = 1.0

SPANS = "array<struct<kind: string, start: int, end: int, target: string, score: double>>"


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, place of kind, end) of the fixed patterns, leftmost and not overlapping per kind."""
    found = []
    if "=" in text or ":" in text:
        found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    return found + [(m.start(), 2, m.end()) for m in HEX.finditer(text)]


def name_score(name: str) -> float:
    words = [w.lower() for w in WORDS.findall(name)]
    if not words or words[-1] in HARMLESS:
        return 0.0
    if any(w in SENSITIVE for w in words):
        return 1.0
    return 0.9 if any(a in KEYED and b in ("key", "keys") for a, b in zip(words, words[1:])) else 0.0


def literal_score(text: str, quoted: bool = True, phrase: bool = False) -> float:
    """Between -1 and 0.5: how little a literal looks like a secret. ``phrase``: several words may be one."""
    text = _SCHEME.sub("", text)
    if len(text) < 6 or PLACEHOLDER.search(text) or REFERENCE.fullmatch(text):
        return -1.0
    if re.search(r"\s", text):
        words = text.split()
        plain = all(re.fullmatch(r"[\w-]+", w) and w.lower() not in SENSITIVE for w in words)
        long = 3 <= len(words) <= 12 and len(text) >= 4 * len(words) and (len(words) > 3 or any(map(str.isdigit, text)))
        return 0.1 if phrase and quoted and plain and long else -1.0
    counts = Counter(text)
    bits = -sum(n * math.log2(n / len(text)) for n in counts.values())
    kinds = sum(any(map(test, text)) for test in (str.islower, str.isupper, str.isdigit, lambda c: not c.isalnum()))
    if "://" in text and "@" not in text:
        return -1.0
    if not quoted and not (kinds > 1 and any(map(str.isdigit, text))):
        return -1.0  # a bare word is a name or prose
    return min(0.5, (bits - 18) / 60 + 0.1 * (kinds - 1))


def lexed_spans(text: str) -> dict[tuple[int, int], tuple[str, float]]:
    """Spans of literals that a sensitive name holds, with that name and the score.

    Pairs are visited from the most sensitive names on, each once: time is linear in the
    text however often names are joined and passed on.
    """
    found: dict[tuple[int, int], tuple[str, float]] = {}
    seen: set[Pair] = set()
    weighted = [(name_score(p.name), p) for p in pairs(text)]
    for weight, root in sorted((x for x in weighted if x[0]), key=lambda x: -x[0]):
        phrase = any(w.lower() in PHRASED for w in WORDS.findall(root.name))
        ahead = [root]
        while ahead:
            pair = ahead.pop()
            if pair in seen:
                continue
            seen.add(pair)
            ahead += pair.uses
            for start, end, quoted in pair.literals:
                score = weight + literal_score(text[start:end], quoted, phrase)
                if score >= _THRESHOLD and score > found.get((start, end), ("", 0.0))[1]:
                    found[start, end] = (root.name, score)
    return found


def spans(text: str) -> list[tuple[str, int, int, str | None, float]]:
    """All spans by start, then kind; a lexed literal inside a fixed pattern's span adds nothing."""
    base = sorted(base_spans(text))
    starts = [s for s, _, _ in base]
    reach = list(accumulate((e for _, _, e in base), max))  # the farthest end of the spans so far
    rows = [(start, kind, end, None, 1.0) for start, kind, end in base]
    for (start, end), (name, score) in lexed_spans(text).items():
        at = bisect_right(starts, start)
        if not at or reach[at - 1] < end:
            rows.append((start, 3, end, name, score))
    return [(KINDS[k], s, e, name, score) for s, k, e, name, score in sorted(rows, key=lambda r: r[:3])]


def scan(docs: DataFrame) -> DataFrame:
    """One row per document: ``doc_id, spans``, positions in code points, ends exclusive.

    Null and empty texts have no spans; ids may be null or repeat; other columns are
    ignored. Base kinds are ``assign``, ``access`` and ``hex``, lexed ones ``literal``.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    struct = pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("target", pa.string()), ("score", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [[dict(zip(struct.names, s)) for s in spans(text)] for text in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.list_(struct))], ["doc_id", "spans"])

    return docs.select("doc_id", whole_text().alias("text")).mapInArrow(run, f"doc_id {kind}, spans {SPANS}")


def written(column: str, only_base: bool = False):
    """Spans as kind:start:end, comma-joined."""
    found = F.filter(column, lambda s: s["kind"] != "literal") if only_base else F.col(column)
    return F.concat_ws(",", F.transform(found, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])))
