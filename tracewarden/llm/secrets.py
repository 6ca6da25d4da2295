"""Secret scans: fixed patterns, then random strings by how few characters a token of theirs has.

A vocabulary learned from prose and code needs few tokens for words and names, and a token for nearly every other
character of a random string.  Candidates are runs of 20 or more key characters; known digests and identifiers are
left out.  A run with a letter and a digit that has at most ``RATIO`` characters a token counts as random as a whole.
In any other the densest stretches are looked for, as readable words joined to a secret lift the ratio of the run.
"""

from __future__ import annotations

import base64
import re

import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewarden.llm.passing import attach, restored

RATIO = 2.1
KINDS = ("assign", "access", "hex", "random")
FOUND = "spans array<struct<kind:string,start:long,end:long>>"
MASK = "[secret]"
#: Token counts of longer runs are sums over pieces of this length.
PIECE = 256
#: Least length of a random string, of its longest part between separators, and the loss at which a stretch ends.
LEAST, LEAST_PART, DROP = 20, 12, 8.0
#: Strings of letters alone: at most this share of them in tokens of four or more, as words have.
WORDY = 0.3

# The patterns of the base kinds and what their matches must have.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
ASSIGN_LEAST, ACCESS_LEAST, HEX_LEAST = 8, 16, 32
_HEX_LONG = re.compile(rf"(?<![0-9a-f])[0-9a-f]{{{HEX_LEAST},}}")
_ASSIGN_HINTS = ("passw", "secret", "token", "api")

_CANDIDATE = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}")
_MIXED = re.compile(r"(?=[^A-Za-z]*[A-Za-z])[^0-9]*[0-9]")
# Digests by their number of hex digits (MD5, SHA-1, SHA-2 family), UUIDs, numbers, dates and times.
_KNOWN = re.compile(
    r"(?:[0-9a-fA-F]{32}|[0-9a-fA-F]{40}|[0-9a-fA-F]{56}|[0-9a-fA-F]{64}|[0-9a-fA-F]{96}|[0-9a-fA-F]{128})"
    r"|[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}"
    r"|(?:sha(?:1|224|256|384|512)|md5)[-=][A-Za-z0-9+/=]+"
    r"|[0-9eETZ+/_=-]+"
)
# The same inside a run, between separators: neither is part of a random string.
_KNOWN_PART = re.compile(
    r"(?<![A-Za-z0-9])(?:"
    r"(?:[0-9a-fA-F]{128}|[0-9a-fA-F]{96}|[0-9a-fA-F]{64}|[0-9a-fA-F]{56}|[0-9a-fA-F]{40}|[0-9a-fA-F]{32})"
    r"|[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}"
    r"|(?:sha(?:1|224|256|384|512)|md5)[-=][A-Za-z0-9+/=]+"
    r"|[0-9eETZ]+)(?![A-Za-z0-9])"
)
_PART = re.compile(r"[A-Za-z0-9]+")
# Same rule as the vocabulary was made with: words, numbers, other characters.
_SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def vocabulary(content: bytes) -> tiktoken.Encoding:
    """An encoding from the content of a rank file."""
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, content.splitlines())}
    return tiktoken.Encoding("ranks", pat_str=_SPLIT, mergeable_ranks=ranks, special_tokens={})


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, number of the kind, end) of the fixed patterns."""
    out = []
    low = text.lower()
    if any(hint in low for hint in _ASSIGN_HINTS):
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= ASSIGN_LEAST]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if len(m[0]) >= ACCESS_LEAST]
    return out + [(m.start(), 2, m.end()) for m in _HEX_LONG.finditer(text)]


def _tokens(part: str, words: tiktoken.Encoding) -> list[int]:
    """Lengths of the tokens of a string of ASCII characters."""
    pieces = (part[k : k + PIECE] for k in range(0, len(part), PIECE))
    return [len(words.decode_single_token_bytes(t)) for x in pieces for t in words.encode_ordinary(x)]


def _wordy(text: str, lengths: list[int]) -> bool:
    """Letters that are words to the vocabulary, or the alphabet."""
    return sum(n for n in lengths if n > 3) > WORDY * sum(lengths) or "abcdefg" in text.lower()


def _stretches(scores: list[float]) -> list[tuple[int, int]]:
    """Runs of items with the largest sums, one after the other; each ends where the sum fell by ``DROP`` or to zero."""
    out, k = [], 0
    while k < len(scores):
        if scores[k] <= 0:
            k += 1
            continue
        total, best, stop, j = 0.0, 0.0, k, k
        while j < len(scores):
            total += scores[j]
            j += 1
            if total > best:
                best, stop = total, j
            if total <= 0 or total < best - DROP:
                break
        out.append((k, stop))
        k = stop
    return out


def dense_spans(run: str, words: tiktoken.Encoding, ratio: float = RATIO) -> list[tuple[int, int]]:
    """(start, end) of the random strings inside a run, widened to the separators around them.

    Separators count neither way, so that they neither hide a secret nor make one of short words.
    """
    known = {k for m in _KNOWN_PART.finditer(run) for k in range(m.start(), m.end())}
    out, items = [], []

    def flush():
        for i, j in _stretches([ratio - n for _, n, _, _ in items]):
            inside = items[i:j]
            # a part of which only a small rest is dense stays out
            parts: dict[tuple[int, int], int] = {}
            for _, n, s, e in inside:
                parts[s, e] = parts.get((s, e), 0) + n
            held = [(s, e) for (s, e), n in parts.items() if n >= LEAST_PART or n == e - s]
            size = sum(n for _, n, _, _ in inside)
            if size < LEAST or size > ratio * len(inside) or max(parts.values()) < LEAST_PART or not held:
                continue
            start, end = min(s for s, _ in held), max(e for _, e in held)
            letters = all(run[s:e].isalpha() for s, e in held)
            if not letters or max(parts.values()) >= LEAST and not _wordy(run[start:end], [n for _, n, _, _ in inside]):
                out.append((start, end))
        items.clear()

    for m in _PART.finditer(run):
        if m.start() in known:
            # short numbers are as likely pieces of a secret in base64; longer known ones end a stretch
            if m.end() - m.start() >= 8:
                flush()
            continue
        at, lengths = m.start(), _tokens(m[0], words)
        if LEAST <= len(m[0]) <= ratio * len(lengths) and not (m[0].isalpha() and _wordy(m[0], lengths)):
            out.append(m.span())
        for n in lengths:
            items.append((at, n, m.start(), m.end()))
            at += n
    flush()
    merged: list[tuple[int, int]] = []
    for start, end in sorted(out):
        if merged and start <= merged[-1][1]:
            merged[-1] = merged[-1][0], max(end, merged[-1][1])
        else:
            merged.append((start, end))
    return merged


def random_spans(text: str, words: tiktoken.Encoding, ratio: float = RATIO) -> list[tuple[int, int, int]]:
    out = []
    for m in _CANDIDATE.finditer(text):
        run = m[0]
        if _KNOWN.fullmatch(run):
            continue
        if _MIXED.match(run):
            tokens = sum(len(words.encode_ordinary(run[k : k + PIECE])) for k in range(0, len(run), PIECE))
            if len(run) <= ratio * tokens:
                out.append((m.start(), 3, m.end()))
                continue
        out += [(m.start() + s, 3, m.start() + e) for s, e in dense_spans(run, words, ratio)]
    return out


def spans(text: str, words: tiktoken.Encoding, ratio: float = RATIO) -> list[tuple[int, int, int]]:
    """All spans by start and kind; a random string inside a base span is not told twice."""
    found = base_spans(text)
    for extra in random_spans(text, words, ratio):
        if not any(s <= extra[0] and extra[2] <= e for s, k, e in found if k < 3):
            found.append(extra)
    return sorted(found)


def masked(text: str, found: list[tuple[int, int, int]]) -> str:
    """The text with each run of overlapping spans replaced by one mask."""
    out, at = [], 0
    for start, _, end in sorted(found):
        if start >= at:
            out += [text[at:start], MASK]
        at = max(at, end)
    return "".join(out) + text[at:]


_loaded: dict[int, tiktoken.Encoding] = {}


def _vocabulary(content: bytes) -> tiktoken.Encoding:
    key = hash(content)
    if key not in _loaded:
        _loaded.clear()
        _loaded[key] = vocabulary(content)
    return _loaded[key]


def _shared(docs: DataFrame, path: str):
    with open(path, "rb") as file:
        return docs.sparkSession.sparkContext.broadcast(file.read())


def scan(docs: DataFrame, path: str, text_col: str = "text", ratio: float = RATIO) -> DataFrame:
    """``(row, spans)`` of every row of ``docs``; ``row`` holds its columns.

    ``path`` names a rank file on the driver (about a MB, broadcast).  Spans are in code points, end exclusive, by
    start and then kind; a null text is empty; repeated rows are scanned alike; spans of different kinds may overlap.
    """
    shared = _shared(docs, path)
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def found(texts: pa.Array) -> list[pa.Array]:
        words = _vocabulary(shared.value)
        each = (spans(t.as_py() or "", words, ratio) for t in texts)
        return [pa.array([[{"kind": KINDS[k], "start": s, "end": e} for s, k, e in x] for x in each], kind)]

    return attach(docs, text_col, FOUND, found)


def redact(docs: DataFrame, path: str, text_col: str = "text", size_col: str = "n_chars", ratio: float = RATIO) -> DataFrame:
    """``docs`` with every span replaced by a mask; ``size_col``, if there, is counted anew where text changed."""
    shared = _shared(docs, path)

    def replaced(texts: pa.Array) -> list[pa.Array]:
        words, out, changed = _vocabulary(shared.value), [], []
        for t in texts:
            text = t.as_py()
            found = spans(text or "", words, ratio)
            changed.append(bool(found))
            out.append(masked(text, found) if found else text)
        return [pa.array(changed, pa.bool_()), pa.array(out, pa.string())]

    found = attach(docs, text_col, "changed boolean, masked string", replaced)
    new = {text_col: found["masked"]}
    if size_col in docs.columns:
        count = F.when(found["changed"], F.char_length(found["masked"])).otherwise(found["row"].getField(size_col))
        new[size_col] = count.cast(docs.schema[size_col].dataType)
    return restored(found, docs.columns, **new)
