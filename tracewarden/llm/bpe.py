"""Byte-pair encoding as a streaming transducer with bounded lookahead, and incremental decoding.

``Merges.lookahead`` is computed from the merge list: how far, at most, text beyond a point can move token borders
before it.  Tokens that end further back than that are stable and are emitted at once; only the rest is held.  So a
word of any length needs the memory of a few lookaheads.  Every word goes through that transducer; what it gave for a
word of ordinary length is remembered.  Words are cut from normalised text, and a word that is not complete at the end
of a piece stays open, so a text without white space needs no more memory than another.

The bound: let the text be known up to a border.  A merge of index k across it takes the symbol u on its left and
the symbol v on its right; the border moves back by the length of u, and what stands right of it is then u or uv.
Only merges of a higher index can move it further, since a merge list builds symbols before it uses them and equal
merges run from left to right.  The longest such chain is found in one pass over the merges, from last to first.
"""

from __future__ import annotations

import codecs
import heapq
import json
import re
import unicodedata
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from tracewarden.llm.passing import attach

#: Text is normalised in pieces of about so many characters.
PIECE = 1 << 16
#: Longer words are not remembered; the memory of words is emptied when it holds CACHE of them.
REMEMBERED = 40
CACHE = 250_000
_NO_MERGE = 1 << 60
TOKENS = "ids array<int>, decoded string"

_CONTRACTIONS = "'s|'t|'re|'ve|'m|'ll|'d"
_ANY_WORD = regex.compile(_CONTRACTIONS + r"|\p{L}+|\p{N}|[^\p{White_Space}\p{L}\p{N}]+")
_LETTERS, _OTHERS = regex.compile(r"\p{L}*"), regex.compile(r"[^\p{White_Space}\p{L}\p{N}]*")
_NUMBER = regex.compile(r"\p{N}")
_ASCII_WORD = re.compile(_CONTRACTIONS + r"|[a-z]+|[0-9]|[^\t-\r a-z0-9]+")


def byte_letters() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


class Merges:
    """A merge list over symbols named by strings, ranked by their order."""

    def __init__(self, merges: Iterable[tuple[str, str]]):
        self.rank: dict[tuple[str, str], int] = {}
        made: dict[str, int] = {}
        for k, (left, right) in enumerate(merges):
            if max(made.get(left, -1), made.get(right, -1)) >= k or left + right in made:
                raise ValueError(f"merge {k} makes a symbol twice or uses one that is not made yet")
            self.rank[left, right] = k
            made[left + right] = k
        for left, right in self.rank:
            if any(made.get(x, -1) > self.rank[left, right] for x in (left, right)):
                raise ValueError(f"{left} {right} uses a symbol that is made later")

    def lookahead(self, units) -> int:
        """Units (``units(symbol)`` of a symbol) before a point whose token borders may depend on what follows it."""
        best: dict[str, int] = {}
        get = best.get
        for left, right in reversed(self.rank):
            both = left + right
            back = units(left) + max(get(left, 0), get(both, 0))
            grown = get(both, 0)
            best[right] = max(get(right, 0), back)
            best[left] = max(get(left, 0), grown)
        return max(best.values(), default=0)

    def apply(self, symbols: list[str]) -> list[str]:
        """All merges, lowest rank first, equal ones from left to right; ``symbols`` may be changed."""
        rank = self.rank
        if len(symbols) < 48:
            get = rank.get
            ranks = [get(pair, _NO_MERGE) for pair in zip(symbols, symbols[1:])]
            while ranks and (least := min(ranks)) != _NO_MERGE:
                k = ranks.index(least)
                symbols[k : k + 2] = [symbols[k] + symbols[k + 1]]
                del ranks[k]
                if k:
                    ranks[k - 1] = get((symbols[k - 1], symbols[k]), _NO_MERGE)
                if k < len(ranks):
                    ranks[k] = get((symbols[k], symbols[k + 1]), _NO_MERGE)
            return symbols
        symbols = list(symbols)
        after, before = list(range(1, len(symbols) + 1)), list(range(-1, len(symbols) - 1))
        queue = [(r, k) for k, pair in enumerate(zip(symbols, symbols[1:])) if (r := rank.get(pair)) is not None]
        heapq.heapify(queue)
        while queue:
            r, k = heapq.heappop(queue)
            n = after[k]
            if symbols[k] is None or n >= len(symbols) or rank.get((symbols[k], symbols[n])) != r:
                continue
            symbols[k] += symbols[n]
            symbols[n] = None
            after[k] = n = after[n]
            if n < len(symbols):
                before[n] = k
                if (r := rank.get((symbols[k], symbols[n]))) is not None:
                    heapq.heappush(queue, (r, k))
            if (p := before[k]) >= 0 and (r := rank.get((symbols[p], symbols[k]))) is not None:
                heapq.heappush(queue, (r, p))
        return [s for s in symbols if s is not None]


class Tokenizer:
    """The parts of a word-end BPE tokenizer file: vocabulary, merges, special tokens."""

    def __init__(self, text: str):
        parts = json.loads(text)
        model = parts["model"]
        if model["type"] != "BPE" or model["unk_token"] or model["continuing_subword_prefix"] or not model["end_of_word_suffix"]:
            raise ValueError("a BPE file with word ends and no unknown token is needed")
        self.ids: dict[str, int] = model["vocab"]
        self.end: str = model["end_of_word_suffix"]
        self.special = {t["content"]: t["id"] for t in parts["added_tokens"]}
        self.merges = Merges(m if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"])
        self.lookahead = self.merges.lookahead(lambda s: len(s.removesuffix(self.end)))
        self.names = {i: s for s, i in (self.ids | self.special).items()}
        self.letters = byte_letters()
        self.specials = re.compile("|".join(re.escape(s) for s in sorted(self.special, key=len, reverse=True)) or r"(?!)")
        self.table: list[str] = [self.names.get(k, "") for k in range(max(self.names, default=-1) + 1)]
        self.cache: dict[str, tuple[int, ...]] = {}

    def normalise(self, text: str) -> str:
        """NFC, then lower case letter by letter (a final sigma is no special case)."""
        if text.isascii():
            return text.lower()
        return unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()

    def units(self, word: str) -> Iterator[str]:
        """The byte letters of a word, without its end mark."""
        for k in range(0, len(word), PIECE):
            yield from map(self.letters.__getitem__, word[k : k + PIECE].encode("utf-8", "replace"))

    def word(self, word: str) -> Iterable[int]:
        """Ids of a word of any length, from the transducer; those of an ordinary one are remembered."""
        machine = Transducer(self)
        if len(word) > REMEMBERED:
            return chain(machine.feed(word), machine.finish())
        ids = (*machine.feed(word), *machine.finish())
        if len(self.cache) >= CACHE:
            self.cache.clear()
        self.cache[word] = ids
        return ids

    def words(self, normal: str) -> list[str]:
        """The words of normalised text."""
        return (_ASCII_WORD if normal.isascii() else _ANY_WORD).findall(normal)

    def ids_of(self, words: list[str]) -> list[Iterable[int]]:
        """Ids of complete words, word by word."""
        found = list(map(self.cache.get, words))
        if None in found:
            for k, word in enumerate(words):
                if found[k] is None:
                    # a word may come again in the list
                    known = self.cache.get(word)
                    found[k] = self.word(word) if known is None else known
        return found

    def encode(self, text: str) -> Iterator[Iterable[int]]:
        """Ids of a text, in groups."""
        encoder = Encoder(self)
        yield from encoder.feed(text)
        yield from encoder.finish()


class Transducer:
    """One word, fed in any cut: ids come out once no further text can change them.

    Held: at most two lookaheads and a constant of byte letters.
    """

    def __init__(self, tokenizer: Tokenizer):
        self.tokenizer, self.held = tokenizer, []
        self.room = 2 * tokenizer.lookahead + 256

    def feed(self, part: str) -> Iterator[int]:
        ids, back = self.tokenizer.ids, self.tokenizer.lookahead
        for unit in self.tokenizer.units(part):
            self.held.append(unit)
            # the last unit may still turn out to be the word's last
            if len(self.held) > self.room:
                done = 0
                for symbol in self.tokenizer.merges.apply(self.held[:-1]):
                    if done + len(symbol) > len(self.held) - 1 - back:
                        break
                    done += len(symbol)
                    if symbol in ids:
                        yield ids[symbol]
                self.held = self.held[done:]

    def finish(self) -> Iterator[int]:
        ids, held, self.held = self.tokenizer.ids, self.held, []
        held[-1] += self.tokenizer.end
        for symbol in self.tokenizer.merges.apply(held):
            if symbol in ids:
                yield ids[symbol]


def _starts(char: str) -> bool:
    """Whether normal forms never reach back over the place before ``char``: no mark, no joining Hangul letter."""
    return char.isascii() or not (unicodedata.category(char)[0] == "M" or "\u1160" <= char <= "\u11ff" or "\ud7b0" <= char <= "\ud7ff")


class Encoder:
    """Feeds of a text in any cut; what is returned is final.

    Held between feeds: a few characters that may become part of a special token, of a composed character or of a
    contraction, and the transducer of an open word.  Only a run of combining marks is held as a whole, since its
    normal form depends on all of it.
    """

    def __init__(self, tokenizer: Tokenizer):
        self.tokenizer = tokenizer
        self.raw = ""  # not normalised yet
        self.tail = ""  # normalised, a possible contraction
        self.open: Transducer | None = None
        self.more = _LETTERS  # what goes on with the open word

    def characters_held(self) -> int:
        return len(self.raw) + len(self.tail) + (len(self.open.held) if self.open else 0)

    def feed(self, text: str) -> Iterator[Iterable[int]]:
        text, tok = self.raw + text, self.tokenizer
        cut = len(text)
        for k in range(min(len(text), max(map(len, tok.special), default=1) - 1), 0, -1):
            if any(s.startswith(text[-k:]) for s in tok.special):
                cut = len(text) - k
                break
        cut -= cut == len(text)
        while cut > 0 and not _starts(text[cut]):
            cut -= 1
        # a special token that is already whole is not cut
        cut = max(cut, 0)
        cut = next((m.end() for m in tok.specials.finditer(text) if m.start() < cut < m.end()), cut)
        self.raw = text[cut:]
        return self._ready(text[:cut])

    def finish(self) -> Iterator[Iterable[int]]:
        text, self.raw = self.raw, ""
        yield from self._ready(text)
        yield from self._close()

    def _ready(self, text: str) -> Iterator[Iterable[int]]:
        tok, at = self.tokenizer, 0
        for special in tok.specials.finditer(text):
            yield from self._plain(text[at : special.start()])
            yield from self._close()
            yield (tok.special[special[0]],)
            at = special.end()
        yield from self._plain(text[at:])

    def _plain(self, text: str) -> Iterator[Iterable[int]]:
        at = 0
        while at < len(text):
            cut = min(at + PIECE, len(text))
            while cut < len(text) and not _starts(text[cut]):
                cut += 1
            yield from self._piece(self.tokenizer.normalise(text[at:cut]))
            at = cut

    def _piece(self, normal: str) -> Iterator[Iterable[int]]:
        """Words of normalised text that may go on after it."""
        text, self.tail = self.tail + normal, ""
        if self.open and text:
            end = self.more.match(text).end()
            yield list(self.open.feed(text[:end]))
            if end == len(text):
                return
            yield from self._close()
            text = text[end:]
        words = self.tokenizer.words(text)
        last = words[-1] if words and text.endswith(words[-1]) else ""
        if last == "'":
            self.tail = words.pop()
        elif last in ("r", "v", "l") and words[-2:-1] == ["'"] and text.endswith("'" + last):
            self.tail = "'" + last
            del words[-2:]
        elif last and not _NUMBER.match(last) and not (last[0] == "'" and last[-1].isalpha()):
            words.pop()
            yield from self.tokenizer.ids_of(words)
            words = []
            self.open, self.more = Transducer(self.tokenizer), _LETTERS if _LETTERS.match(last).end() else _OTHERS
            yield list(self.open.feed(last))
        yield from self.tokenizer.ids_of(words)

    def _close(self) -> Iterator[Iterable[int]]:
        """The text ends here, or a special token comes."""
        tail, self.tail = self.tail, ""
        if self.open:
            machine, self.open = self.open, None
            yield list(machine.finish())
        yield from self.tokenizer.ids_of(self.tokenizer.words(tail))


class Decoder:
    """Ids to text, in feeds of any size.

    ``surface`` gives what a tokenizer file without a decoder means: vocabulary entries joined by a space.  Otherwise
    byte letters are turned back to bytes and these, by an incremental machine, to text; a word's end is a space.
    """

    def __init__(self, tokenizer: Tokenizer, surface: bool = True):
        self.tokenizer, self.surface, self.begun = tokenizer, surface, False
        self.machine = codecs.getincrementaldecoder("utf-8")("replace")
        self.bytes = {c: b for b, c in enumerate(tokenizer.letters)}

    def feed(self, ids: Iterable[int]) -> str:
        if self.surface:
            text = " ".join(map(self.tokenizer.table.__getitem__, ids))
            text, self.begun = (f" {text}" if self.begun and text else text), self.begun or bool(text)
            return text
        out = []
        for i in ids:
            symbol = self.tokenizer.table[i]
            if symbol in self.tokenizer.special:
                out += [self.machine.decode(b"", True), symbol]
                continue
            word = symbol.removesuffix(self.tokenizer.end)
            out.append(self.machine.decode(bytes(map(self.bytes.__getitem__, word))))
            if word != symbol:
                out += [self.machine.decode(b"", True), " "]
        return "".join(out)

    def finish(self) -> str:
        return "" if self.surface else self.machine.decode(b"", True)


_loaded: dict[int, Tokenizer] = {}


def loaded(text: str) -> Tokenizer:
    """One tokenizer for each file content and process."""
    key = hash(text)
    if key not in _loaded:
        _loaded.clear()
        _loaded[key] = Tokenizer(text)
    return _loaded[key]


def tokenize_texts(texts: pa.Array, tokenizer: Tokenizer) -> list[pa.Array]:
    """``ids`` and ``decoded`` of each text."""
    ids, decoded, first = [], [], [0]
    for text in texts:
        flat = np.fromiter(chain.from_iterable(tokenizer.encode(text.as_py() or "")), np.int32)
        ids.append(flat)
        first.append(first[-1] + len(flat))
        decoder = Decoder(tokenizer)
        decoded.append(decoder.feed(flat.tolist()) + decoder.finish())
    values = pa.array(np.concatenate(ids) if ids else np.zeros(0, np.int32), pa.int32())
    return [pa.ListArray.from_arrays(pa.array(first, pa.int32()), values), pa.array(decoded, pa.string())]


def tokenize(docs: DataFrame, path: str, text_col: str = "text") -> DataFrame:
    """``(row, ids, decoded)`` of every row of ``docs``; ``row`` holds its columns.

    ``path`` names the tokenizer file on the driver; its text (a few MB) is broadcast.  A null or empty text has no
    ids and decodes to an empty text; repeated rows are encoded alike; special tokens' strings are special tokens.
    """
    with open(path, encoding="utf-8") as file:
        text = file.read()
    Tokenizer(text)  # a file that does not fit fails here, not in a task
    shared = docs.sparkSession.sparkContext.broadcast(text)
    return attach(docs, text_col, TOKENS, lambda texts: tokenize_texts(texts, loaded(shared.value)))
