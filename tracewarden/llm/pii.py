"""Personal data: fixed patterns, and a character BiLSTM-CRF that adds what they miss.

The tagger is trained in numpy on windows of about ``SAMPLE`` texts whose spans the patterns have labelled, and on
altered copies of them: there each labelled span also stands in forms that the patterns miss (numbers without a plus
sign, written-out or accented addresses, shorter cards, dots in brackets), in its place and between other words, beside
dates, amounts, versions and other numbers that are none.  A span of any kind holds a digit, an at sign or one of the
two spelled out, so windows cover all text within ``REACH`` characters of those and the rest cannot hold a span.
Windows overlap by half; a character takes its tag from the window in which it stands farthest from an edge, and spans
are read off the whole text's tags.  An added span must be plausible for its kind; it overlaps no fixed one, but may
contain one of its own kind and then stands beside it.
"""

from __future__ import annotations

import random
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewarden.llm.lstm_crf import Tagger
from tracewarden.llm.passing import attach

KINDS = ("email", "ip", "card", "phone")
SAMPLE = 1500
SAMPLE_BYTES = 1 << 15
COPIES, WINDOWS = 8, 12000
WINDOW, REACH = 64, 32
STEPS, WIDTH, HIDDEN, SEED = 600, 12, 24, 7
_AT_ONCE = 1024
FOUND = "spans array<struct<kind:string,start:long,end:long,added:boolean>>"

# The patterns of the base kinds.  A lookbehind stands where a match cannot begin inside a run.
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
IP = re.compile(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
# Spelled-out signs; an at sign between bare words counts only if the dot is spelled out as well.
_SPELLED = rb"(?i)\bdot\b|[(\[{] ?at ?[)\]}]"
_CUE, _CUES = re.compile("[0-9@]|" + _SPELLED.decode()[4:], re.I), re.compile(_SPELLED)
_AT, _DOT = r"(?:@| ?[(\[{] ?at ?[)\]}] ?)", r"(?:\.| ?[(\[{] ?(?:dot|\.) ?[)\]}] ?| dot )"
_NAME, _LABEL = r"[^\s@()\[\]{}<>,;:\"]+", r"[^\W_](?:[\w-]*[^\W_])?"
_ADDRESS = re.compile(rf"{_NAME}(?:{_AT}{_LABEL}(?:{_DOT}{_LABEL})*{_DOT}| at {_LABEL}(?: dot {_LABEL})* dot )[^\W\d_]{{2,}}", re.I)
_PART_OF_ADDRESS, _PART_OF_NUMBER = re.compile(r"[\w.+%-]"), re.compile("[0-9]")
_NUMBERS = re.compile(rf"([0-9]{{1,3}}){_DOT}([0-9]{{1,3}}){_DOT}([0-9]{{1,3}}){_DOT}([0-9]{{1,3}})", re.I)
_DATE = re.compile(r"(?:19|20)[0-9]{2}[-. ][0-9]{1,2}[-. ][0-9]{1,2}\b.*|[0-9]{1,2}[-. ][0-9]{1,2}[-. ](?:19|20)[0-9]{2}\b.*")


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        n = int(d) * (1 + k % 2)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def _digits(text: str) -> str:
    return "".join(c for c in text if c in "0123456789")


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """A match begins where the run before its at sign does, or the last match ended."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL_CHARS:
            start -= 1
        domain = _DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            yield start, domain.end()
            done = domain.end()
        # without a match this sign ends every later run too
        else:
            done = at + 1
        at = text.find("@", max(at + 1, done))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(number of the kind, start, end) of the fixed patterns, in order."""
    out = [(0, a, z) for a, z in _emails(text)] if "@" in text else []
    out += [(1, m.start(), m.end()) for m in IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p[-4:]) <= 255 for p in m[0].split("."))]
    out += [(2, m.start(), m.end()) for m in CARD.finditer(text) if len(m[0]) >= 16 and 16 <= len(d := _digits(m[0])) <= 19 and luhn(d)]
    if "+" in text:
        out += [(3, m.start(), m.end()) for m in PHONE.finditer(text) if 8 <= len(_digits(m[0])) <= 15]
    return out


# Tags: 0 outside, then begin and inside of each kind.
_TAGS = 1 + 2 * len(KINDS)
_FORBIDDEN = np.zeros((_TAGS, _TAGS), bool)
_BARRED = np.zeros(_TAGS, bool)
for _k in range(len(KINDS)):
    _FORBIDDEN[:, 2 + 2 * _k] = True
    _FORBIDDEN[[1 + 2 * _k, 2 + 2 * _k], 2 + 2 * _k] = False
# Symbols: ASCII as it is (letters without case are left to the network), other letters, other characters, padding.
_LETTER, _OTHER, _PAD, _SYMBOLS = 128, 129, 130, 131


def symbols(text: str) -> np.ndarray:
    codes = np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)
    out = np.where(codes < 128, codes, np.where((codes < 0x2000) | (codes >= 0x3000), _LETTER, _OTHER))
    return out.astype(np.uint8)


def windows(chars: np.ndarray) -> np.ndarray:
    """Starts of overlapping windows over everything within reach of a digit, an at sign or one spelled out."""
    anchor = np.flatnonzero(((chars >= 48) & (chars <= 57)) | (chars == 64))
    spelled = [m.start() for m in _CUES.finditer(chars.tobytes())]
    if spelled:
        # a spelled-out sign stands in the middle of a longer form
        around = np.array(spelled)[:, None] + np.array([-REACH, 0, REACH])
        anchor = np.union1d(anchor, np.clip(around, 0, len(chars) - 1))
    if not len(anchor):
        return anchor
    breaks = np.flatnonzero(np.diff(anchor) > 2 * REACH)
    low = np.maximum(0, anchor[np.concatenate([[0], breaks + 1])] - REACH)
    high = np.minimum(len(chars), anchor[np.concatenate([breaks, [len(anchor) - 1]])] + REACH + 1)
    half = WINDOW // 2
    many = np.maximum(1, -(-(high - low - half) // half))
    return np.repeat(low - (np.cumsum(many) - many) * half, many) + np.arange(many.sum()) * half


def cut(chars: np.ndarray, starts: np.ndarray, fill: int) -> np.ndarray:
    padded = np.concatenate([chars, np.full(WINDOW, fill, chars.dtype)])
    return padded[starts[:, None] + np.arange(WINDOW)]


def gold_tags(text: str, n: int) -> np.ndarray:
    """Tags of the fixed spans; of overlapping ones the kind listed first wins."""
    tags = np.zeros(n, np.uint8)
    for k, a, z in base_spans(text):
        if not tags[a:z].any():
            tags[a:z], tags[a] = 2 + 2 * k, 1 + 2 * k
    return tags


def _grouped(digits: str, sizes: tuple[int, ...], between: str) -> str:
    parts, at = [], 0
    for n in sizes:
        parts.append(digits[at : at + n])
        at += n
    return between.join(parts)


def _card(rng: random.Random) -> str:
    """A card number of 13 to 15 digits."""
    sizes = rng.choice([(4, 6, 5), (4, 6, 4), (4, 4, 4, 1), (4, 4, 4, 2)])
    body = str(rng.randrange(3, 7)) + "".join(rng.choices("0123456789", k=sum(sizes) - 2))
    body += next(c for c in "0123456789" if luhn(body + c))
    return rng.choice([body, _grouped(body, sizes, rng.choice(" -"))])


def variant(rng: random.Random, kind: int, piece: str, words: list[str]) -> str:
    """Another form of a labelled span, which the patterns miss in whole or in part; addresses take words of the text."""
    if kind == 0:
        name, host = piece.rsplit("@", 1)
        if words and rng.random() < 0.7:
            name = rng.choice(["", "", ".", "_", "-"]).join(rng.sample(words, min(len(words), 2))) if rng.random() < 0.5 else rng.choice(words)
            name += rng.choice(["", "", str(rng.randrange(100))])
            host = ".".join([rng.choice(words)] * rng.choice([1, 1, 2]) + [rng.choice(["com", "org", "net", "de", "fr", "info", "example", "co.uk"])])
        if rng.random() < 0.35:
            swap = {c: rng.choice(v) for c, v in {"a": "áäå", "e": "éèë", "o": "öóø", "u": "üúû", "i": "íï", "n": "ñ", "s": "šß", "c": "çč"}.items()}
            return "".join(swap.get(c, c) if rng.random() < 0.6 else c for c in name) + "@" + host
        at, dot = rng.choice([(" at ", " dot "), (" at ", " dot "), (" (at) ", "."), ("(at)", "."), (" [at] ", "."), ("[at]", "."), (" (at) ", " (dot) "), (" [at] ", " [dot] "), ("(at)", "(dot)"), (" AT ", " DOT ")])
        return name + at + host.replace(".", dot)
    if kind == 1:
        return rng.choice(["[.]", " dot ", "(.)", "[dot]"]).join(piece.split("."))
    if kind == 2:
        return _card(rng)
    if piece and rng.random() < 0.2:
        return piece.lstrip("+")
    digits = str(rng.randrange(2, 10)) + "".join(rng.choices("0123456789", k=12))
    sizes = rng.choice([(3, 3, 4), (3, 3, 4), (3, 3, 4), (4, 3, 3), (4, 3, 4), (3, 4, 4), (2, 4, 4), (3, 7)])
    if rng.random() < 0.35:
        head, tail = digits[: sizes[0]], _grouped(digits[sizes[0] :], sizes[1:], rng.choice(" -."))
        return rng.choice(["", "1 ", "0 "]) + f"({head})" + rng.choice([" ", "", "-"]) + tail
    return rng.choice(["", "", "", "0", "00"]) + _grouped(digits, sizes, rng.choice([" ", " ", "-", "."]))


def other_number(rng: random.Random) -> str:
    """Something with digits or an at that is no personal data."""
    n = rng.randrange
    return rng.choice([
        f"{n(1950, 2040)}-{n(1, 13):02}-{n(1, 29):02}", f"{n(1, 29):02}.{n(1, 13):02}.{n(1950, 2040)}", f"{n(24):02}:{n(60):02}:{n(60):02}",
        f"{n(1950, 2040)}-{n(1, 13):02}-{n(1, 29):02} {n(24):02}:{n(60):02}", f"{n(1, 13)}/{n(1, 29)}/{n(1950, 2040)}", f"{n(1, 900)},{n(1000):03}.{n(100):02}",
        f"{n(10)}.{n(20)}.{n(30)}", f"v{n(10)}.{n(20)}.{n(30)}", f"{n(10**9):x}-{n(10**4):04x}", str(n(10 ** n(1, 14))), f"{n(1800, 2000)}-{n(2000, 2030)}",
        f"{n(100)} {n(100)} {n(100)}", f"{n(1000)} of {n(1000, 9000)}", f"at {n(1, 12)} am", "look at the dot", "at the end", f"{n(100)}.{n(10**6):06}", f"ISBN {n(978, 980)}-{n(10)}-{n(100, 999)}-{n(10**5):05}-{n(10)}", "@home", f"room {n(900)}", f"{n(1, 99)} - {n(1, 99)}",
    ])


def altered(text: str, copy: int = 0) -> tuple[str, np.ndarray]:
    """The text with its labelled spans in other forms, each in its place and some more elsewhere, and its tags.

    What is drawn follows from the text and the number of the copy alone.
    """
    rng = random.Random(zlib.crc32(text.encode("utf-8", "replace"), copy))
    words = list(dict.fromkeys(w.lower() for w in re.findall(r"[A-Za-z]{3,12}", text)))[:200]
    spans, at = [], 0
    for k, a, z in sorted(base_spans(text), key=lambda s: (s[1], s[0])):
        if a >= at:
            spans.append((k, a, z))
            at = z
    # (place, end of what it replaces, kind or none, text)
    edits = [(a, z, k, variant(rng, k, text[a:z], words)) for k, a, z in spans]
    gaps = [m.start() for m in re.finditer(r"(?<=\w) (?=\w)", text)]
    free = [g for g in gaps if not any(a - 1 <= g <= z for _, a, z in spans)]
    seen = {0: "name@host.org", 1: ".".join(str(rng.randrange(256)) for _ in range(4))} | {k: text[a:z] for k, a, z in spans}

    def any_variant() -> tuple[int, str]:
        k = rng.randrange(len(KINDS))
        return k, variant(rng, k, seen.get(k, ""), words)

    for g in rng.sample(free, min(len(free), 4 * len(spans) + 2)):
        edits.append((g, g, *(any_variant() if spans and rng.random() < 0.6 else (None, other_number(rng)))))
    if spans and spans[0][1] > 0 and copy % 2:
        edits.append((0, 0, *any_variant()))
    pieces, marks, at = [], [], 0
    for a, z, k, new in sorted(edits, key=lambda e: e[:2]):
        # what is put in stands between blanks
        lead, tail = (" " if a == z > 0 else ""), (" " if a == z == 0 else "")
        pieces += [text[at:a], lead, new, tail]
        tags = np.zeros(len(new) + len(tail), np.uint8)
        if k is not None:
            tags[: len(new)], tags[0] = 2 + 2 * k, 1 + 2 * k
        marks += [np.zeros(a - at + len(lead), np.uint8), tags]
        at = z
    return "".join([*pieces, text[at:]]), np.concatenate([*marks, np.zeros(len(text) - at, np.uint8)])


def training_windows(text: str) -> list[tuple[bytes, bytes]]:
    """Windows of a text and its altered copies with their tags: every labelled one, and as many others at most."""
    out: list[tuple[bytes, bytes]] = []
    for body, tags in [(text, gold_tags(text, len(text)))] + [altered(text, k) for k in range(COPIES)]:
        chars = symbols(body)
        starts = windows(chars)
        if not len(starts):
            continue
        tags = cut(tags, starts, 0)
        # the network never sees the inside of a span without its beginning
        whole = (tags[:, 0] % 2 == 1) | (tags[:, 0] == 0)
        marked = tags.any(1) & whole
        plain = np.flatnonzero(~tags.any(1))[: max(2, int(marked.sum()))]
        picked = np.concatenate([np.flatnonzero(marked), plain])
        out += [(c.tobytes(), t.tobytes()) for c, t in zip(cut(chars, starts, _PAD)[picked], tags[picked])]
    return out


def _training_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = [w for text in batch.column(0) for w in training_windows(text.as_py())]
        yield pa.RecordBatch.from_arrays([pa.array([c for c, _ in out], pa.binary()), pa.array([t for _, t in out], pa.binary())], ["chars", "tags"])


def fit_windows(chars: np.ndarray, tags: np.ndarray) -> Tagger | None:
    """Train on (windows, WINDOW) arrays; nothing to learn from gives None."""
    if not tags.any():
        return None
    tagger = Tagger.fresh(_SYMBOLS, _TAGS, WIDTH, HIDDEN, _FORBIDDEN, np.isin(np.arange(_TAGS), np.arange(2, _TAGS, 2)), SEED)
    tagger.train(chars, tags, STEPS)
    return tagger


def fit(docs: DataFrame, text_col: str = "text", sample: int = SAMPLE) -> Tagger | None:
    """Train on about ``sample`` different texts with an at sign or a number, and ``WINDOWS`` windows at most.

    Texts are drawn by a hash whose share follows from how many there are, and copies count once: no task and not the
    driver gets more of them when the table grows.
    """
    body = F.col(text_col).cast("string").alias("text")
    texts = docs.select(body).where(F.col("text").rlike(r"@|[0-9][.)( -]?[0-9]") & (F.octet_length("text") <= SAMPLE_BYTES)).withColumn("hash", F.xxhash64("text"))
    there = texts.agg(F.approx_count_distinct("hash")).first()[0]
    drawn = texts.where(F.pmod(F.col("hash"), F.lit(1 << 30)) < F.lit(int(min(1.0, sample / max(1, there)) * (1 << 30))))
    picked = drawn.groupBy("hash").agg(F.min("text").alias("text")).select("text")
    rows = picked.mapInArrow(_training_batches, "chars binary, tags binary").orderBy(F.xxhash64("chars"), "chars").limit(WINDOWS).collect()
    grid = lambda name: np.frombuffer(b"".join(r[name] for r in rows), np.uint8).reshape(-1, WINDOW)
    return fit_windows(grid("chars"), grid("tags")) if rows else None


def plausible(kind: int, text: str) -> bool:
    """Whether an added span can be of its kind at all."""
    digits = _digits(text)
    if kind == 0:
        return bool(_ADDRESS.fullmatch(text))
    if kind == 1:
        parts = _NUMBERS.fullmatch(text)
        return bool(parts) and all(int(p) <= 255 for p in parts.groups())
    if kind == 2:
        return 13 <= len(digits) <= 19 and bool(re.fullmatch(r"[0-9]([ -]?[0-9])*", text)) and luhn(digits)
    shape = re.fullmatch(r"[+(]?[0-9][0-9().\x20-]*[0-9]", text) and not re.fullmatch("[0-9]+", text) and text.count("(") == text.count(")")
    return 8 <= len(digits) <= 15 and bool(shape) and not _DATE.fullmatch(text)


def _whole_word(text: str, a: int, z: int, kind: int) -> tuple[int, int]:
    """A tagged span with the rest of the words, or of the numbers, in which it begins and ends."""
    part = _PART_OF_ADDRESS if kind == 0 else _PART_OF_NUMBER
    while 0 < a < z and part.match(text[a]) and part.match(text[a - 1]):
        a -= 1
    while a < z < len(text) and part.match(text[z - 1]) and part.match(text[z]):
        z += 1
    return a, z


def added_spans(text: str, tags: np.ndarray, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Spans of a text's tags that are plausible and overlap no fixed one but those of their kind that they contain."""
    inside = tags > 0
    begin = inside & ((tags % 2 == 1) | np.concatenate([[True], (tags[1:] + 1) // 2 != (tags[:-1] + 1) // 2]))
    end = inside & np.concatenate([~inside[1:] | begin[1:], [True]])
    out = []
    for a, z in zip(np.flatnonzero(begin).tolist(), (np.flatnonzero(end) + 1).tolist()):
        piece = text[a:z]
        a, z = a + len(piece) - len(piece.lstrip(" .,;:")), z - len(piece) + len(piece.rstrip(" .,;:"))
        kind = (int(tags[a]) - 1) // 2 if a < z else 0
        a, z = _whole_word(text, a, z, kind)
        meets = [(k, s, e) for k, s, e in base if s < z and a < e]
        if a < z and plausible(kind, text[a:z]) and all(k == kind and a <= s and e <= z and (a, z) != (s, e) for k, s, e in meets):
            out.append((kind, a, z))
    return out


def tag_texts(texts: list[str], tagger: Tagger) -> list[np.ndarray]:
    """Tags of whole texts, reconciled from overlapping windows."""
    chars = [symbols(t) for t in texts]
    starts = [windows(c) for c in chars]
    grid = np.concatenate([cut(c, s, _PAD) for c, s in zip(chars, starts)]) if texts else np.zeros((0, WINDOW), np.uint8)
    found = np.concatenate([tagger.decode(grid[k : k + _AT_ONCE].T).T for k in range(0, len(grid), _AT_ONCE)]) if len(grid) else grid.astype(np.int8)
    # how far from an edge each place of a window stands
    depth = np.minimum(np.arange(WINDOW), np.arange(WINDOW)[::-1]) + 1
    out, at = [], 0
    for c, s in zip(chars, starts):
        tags, best = np.zeros(len(c) + WINDOW, np.int8), np.zeros(len(c) + WINDOW, np.int64)
        place = s[:, None] + np.arange(WINDOW)
        for odd in (0, 1):  # windows of one parity do not overlap within a stretch
            for half in (place[odd::2],):
                mine = found[at + odd : at + len(s) : 2]
                wins = depth[None, :] > best[half]
                tags[half[wins]] = mine[wins]
                np.maximum.at(best, half.ravel(), np.broadcast_to(depth, half.shape).ravel())
        at += len(s)
        out.append(tags[: len(c)])
    return out


def scan(docs: DataFrame, tagger: Tagger | None, text_col: str = "text") -> DataFrame:
    """``(row, spans)`` of every row of ``docs``; ``row`` holds its columns.

    Spans are in code points, end exclusive, by kind as listed and then start; ``added`` marks those of the network.
    A null text is empty; repeated rows are scanned alike; whole texts are read.  Without a tagger only fixed
    patterns are found.
    """
    shared = docs.sparkSession.sparkContext.broadcast(tagger)
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("added", pa.bool_())]))

    def found(texts: pa.Array) -> list[pa.Array]:
        out: list[list[dict]] = [[] for _ in range(len(texts))]
        held: list[tuple[int, str]] = []
        size = 0

        def flush():
            bodies = [t for _, t in held]
            tags = tag_texts(bodies, shared.value) if shared.value else [np.zeros(len(t), np.int8) for t in bodies]
            for (row, text), own in zip(held, tags):
                base = base_spans(text)
                both = sorted([(*s, False) for s in base] + [(*s, True) for s in added_spans(text, own, base)])
                out[row] = [{"kind": KINDS[k], "start": a, "end": z, "added": new} for k, a, z, new in both]
            held.clear()

        for row, text in enumerate(texts):
            text = text.as_py() or ""
            if _CUE.search(text):
                held.append((row, text))
                size += len(text)
            if size > 1 << 20:
                flush()
                size = 0
        flush()
        return [pa.array(out, kind)]

    return attach(docs, text_col, FOUND, found)
