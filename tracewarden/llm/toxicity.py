"""Toxicity by a weighted finite-state grammar over clauses.

Words are read as symbols: insults and threats (stems learned from labels), targets, negations, words of reporting
and anything else.  Three transducers are composed: one marks insults and threats within reach of a negation, one
marks those after a word of reporting, one reads the marked clause and ends in the state that names its kind.  A
clause is worth the summed weights of its path times what its kind is worth; single words score nothing by
themselves.  The sum over clauses and the length of the text, in which chance hits grow, give the score.

Only clauses that hold a learned stem are read; these are found by hashes of word beginnings, in numpy.  ASCII and
Latin-1 letters are compared without case.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewarden.llm.byte_text import ALNUM, LOWER, Block, blocks
from tracewarden.llm.passing import attach

SAMPLE = 3000
THRESHOLD = 0.7
STEM = (3, 8)
LEAST_DOCS, LEAST_G2, LEAST_RATIO, MOST_STEMS = 3, 30.0, 8.0, 500

# Words of the grammar in English, German, French and Spanish.
TARGETS = "you your yours yourself he she him her they them their u ur du dich dir ihr euch sie tu toi te vous il elle ils elles usted tú ti él ella ellos".split()
NEGATIONS = "not no never isn aren wasn don doesn nicht kein keine nie pas jamais non nunca jamás sin".split()
REPORTS = "said says say wrote writes called calls claimed quoted sagte schrieb nannte dit écrit appelé dijo escribió llamó".split()
THREATS = "kill hurt destroy murder stab shoot töten vernichten tuer détruire matar destruir".split()

_CLAUSE = np.zeros(256, bool)
_CLAUSE[list(b".!?;:|\n")] = True
_NEAR = 3  # words a negation reaches


@dataclass(frozen=True)
class Transducer:
    """Deterministic: ``arcs[state, symbol] = (next state, output)``; a missing arc keeps the state and copies."""

    arcs: dict
    start: int | str | tuple = 0

    def step(self, state, symbol):
        return self.arcs.get((state, symbol), (state, symbol))

    def then(self, other: Transducer, alphabet: str) -> Transducer:
        """Composition: what this one puts out is what the other reads."""
        arcs, open_states = {}, [(self.start, other.start)]
        seen = set(open_states)
        while open_states:
            a, b = open_states.pop()
            for symbol in alphabet:
                a2, middle = self.step(a, symbol)
                b2, out = other.step(b, middle)
                arcs[(a, b), symbol] = ((a2, b2), out)
                if (a2, b2) not in seen:
                    seen.add((a2, b2))
                    open_states.append((a2, b2))
        return Transducer(arcs, (self.start, other.start))

    def end(self, symbols: str):
        state = self.start
        for symbol in symbols:
            state, _ = self.step(state, symbol)
        return state


# Symbols: I insult, T threat, Y target, N negation, R report, W other; i and t negated, q reported.
def _negation() -> Transducer:
    arcs = {}
    for left in range(_NEAR + 1):
        after = max(0, left - 1)
        for symbol in "TIYRW":
            arcs[left, symbol] = (after, symbol.lower() if left and symbol in "TI" else symbol)
        arcs[left, "N"] = (_NEAR, "N")
    return Transducer(arcs)


def _report() -> Transducer:
    return Transducer({(0, "R"): (1, "R"), (1, "I"): (1, "q"), (1, "T"): (1, "q")})


KINDS = ("plain", "aimed", "threat", "negated", "reported", "none")


def _clause() -> Transducer:
    """States are (kind so far, was there a target)."""
    order = {"none": 0, "reported": 1, "negated": 2, "plain": 3, "threat": 4}
    arcs = {}
    for kind in order:
        for aimed in (False, True):
            arcs[(kind, aimed), "Y"] = ((kind, True), "Y")
            for symbol, new in (("I", "plain"), ("T", "threat"), ("i", "negated"), ("t", "negated"), ("q", "reported")):
                arcs[(kind, aimed), symbol] = ((max(kind, new, key=order.get), aimed), symbol)
    return Transducer(arcs, ("none", False))


GRAMMAR = _negation().then(_report(), "ITYNRW").then(_clause(), "ITYNRW")


def kind_of(symbols: str) -> str:
    """What the composed grammar makes of a clause."""
    _, (kind, aimed) = GRAMMAR.end(symbols)
    return "aimed" if kind == "plain" and aimed else kind


def fold(data: np.ndarray) -> np.ndarray:
    """Lower case of ASCII and Latin-1 letters in UTF-8."""
    out = LOWER[data]
    if len(out) > 1:
        capital = (out[:-1] == 0xC3) & (out[1:] >= 0x80) & (out[1:] <= 0x9E) & (out[1:] != 0x97)
        out[1:][capital] += 0x20
    return out


_WORDS = {w.encode(): s for s, words in (("Y", TARGETS), ("N", NEGATIONS), ("R", REPORTS)) for w in words}


@dataclass
class Model:
    """Weights of stems (UTF-8) and of kinds, and the regression on (worth of clauses, length, any clause)."""

    stems: dict[bytes, float] = field(default_factory=dict)
    kinds: dict[str, float] = field(default_factory=lambda: dict.fromkeys(KINDS, 1.0))
    beta: tuple[float, float, float, float] = (0.0, 0.0, 0.0, -2.0)

    def __post_init__(self):
        self.by_size = {}
        for stem in self.stems:
            self.by_size.setdefault(len(stem), []).append(stem)

    def clauses(self, block: Block) -> tuple[np.ndarray, list[tuple[int, str, float]]]:
        """Words of each row, and (row, kind, summed weight) of each clause that holds a stem."""
        data = fold(block.data)
        words = block.runs(ALNUM)
        length, hit = words.end - words.start, []
        for size, stems in self.by_size.items():
            fits = np.flatnonzero(length >= size)
            start = words.start[fits]
            # the first byte and the last one sort out nearly all words
            ends = {(s[0], s[-1]) for s in stems}
            table = np.zeros(1 << 16, bool)
            table[[a << 8 | z for a, z in ends]] = True
            fits = fits[table[data[start].astype(np.int64) << 8 | data[start + size - 1]]]
            known = set(stems)
            hit += [(int(k), s) for k in fits if (s := data[words.start[k] : words.start[k] + size].tobytes()) in known]
        found: list[tuple[int, str, float]] = []
        if hit:
            cuts = np.flatnonzero(_CLAUSE[data])
            best: dict[tuple[int, int], dict[int, float]] = {}
            for k, stem in hit:
                row, at = int(words.row[k]), int(words.start[k])
                clause = int(np.searchsorted(cuts, at))
                marked = best.setdefault((row, clause), {})
                marked[k] = max(self.stems[stem], marked.get(k, 0.0))
            for (row, clause), marked in best.items():
                low = max(int(cuts[clause - 1]) + 1 if clause else 0, int(block.offset[row]))
                high = min(int(cuts[clause]) if clause < len(cuts) else len(data), int(block.offset[row + 1]))
                a, z = np.searchsorted(words.start, [low, high])
                symbols = []
                for k in range(int(a), int(z)):
                    word = data[words.start[k] : words.end[k]].tobytes()
                    symbols.append(("T" if word in _THREATS else "I") if k in marked else _WORDS.get(word, "W"))
                found.append((row, kind_of("".join(symbols)), sum(marked.values())))
        return np.diff(words.first), found

    def inputs(self, block: Block) -> np.ndarray:
        n_words, found = self.clauses(block)
        x = np.zeros((block.rows, 4))
        for row, kind, weight in found:
            x[row, 0] += weight * self.kinds[kind]
        x[:, 1] = n_words / 100
        x[:, 2] = x[:, 0] > 0
        x[:, 3] = 1
        return x

    def scores(self, block: Block) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.inputs(block) @ np.array(self.beta), -500, 500)))


_THREATS = {w.encode() for w in THREATS}


def _stem_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each word beginning: distinct words with it, text by text, of toxic and of clean texts; how many toxic texts."""
    for batch in batches:
        times: tuple[Counter, Counter] = Counter(), Counter()
        texts = Counter()
        for label, text in zip(batch.column(0).to_pylist(), batch.column(1)):
            for block in blocks(pa.array([text.as_py()], pa.string())):
                words, data = block.runs(ALNUM), fold(block.data).tobytes()
                own = {data[a:z] for a, z in zip(words.start.tolist(), words.end.tolist())}
                stems: Counter = Counter()
                for w in own:
                    s = w.decode("utf-8", "replace")
                    for k in range(STEM[0], min(STEM[1], len(s)) + 1):
                        stems[s[:k]] += 1
                times[label].update(stems)
                if label:
                    texts.update(stems.keys())
        names = sorted(times[0].keys() | times[1].keys())
        columns = [pa.array([c[n] for n in names], pa.int64()) for c in (times[1], times[0], texts)]
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), *columns], ["stem", "toxic", "clean", "texts"])


def learned_stems(rows: list[tuple[str, int, int]], words_toxic: int, words_clean: int) -> dict[bytes, float]:
    """Greedy choice by strength of association; a stem that begins, or begins with, a chosen one is left out."""
    chosen: dict[str, float] = {}
    for stem, toxic, clean in rows:
        if any(stem.startswith(c) or c.startswith(stem) for c in chosen):
            continue
        chosen[stem] = float(np.log((toxic + 0.5) / (words_toxic + 1)) - np.log((clean + 0.5) / (words_clean + 1)))
    return {s.encode(): w for s, w in chosen.items()}


def _g2(a: Column, b: Column, n1: int, n0: int) -> Column:
    """Twice the log-likelihood ratio of a and b occurrences among n1 and n0 words."""
    part = lambda k, n: k * F.log(F.greatest(k, F.lit(0.5)) / ((a + b) * F.lit(n / (n1 + n0))))
    return 2 * (part(a, n1) + part(b, n0))


def _input_batches(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            model, out, row = shared.value, [], []
            for block in blocks(batch.column(1)):
                n_words, found = model.clauses(block)
                own: list[Counter] = [Counter() for _ in range(block.rows)]
                for r, kind, weight in found:
                    own[r][kind] += weight
                out += [[float(o[k]) for k in KINDS] for o in own]
                row += n_words.tolist()
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(row, pa.int64()), pa.array(out, pa.list_(pa.float64()))], ["label", "n_words", "worth"])

    return run


def fit_beta(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Logistic regression by damped Newton steps with a small ridge."""
    beta = np.zeros(x.shape[1])
    ridge = np.diag([1e-3] * (x.shape[1] - 1) + [1e-6])
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -500, 500)))
        h = np.maximum(p * (1 - p), 1e-9)
        step = np.linalg.solve((x * h[:, None]).T @ x + ridge, x.T @ (p - y) + ridge @ beta)
        beta = beta - step * min(1.0, 2.0 / max(1e-9, np.abs(step).max()))
    return beta


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample: int = SAMPLE) -> Model:
    """Learn stems, kinds and the regression from at most ``sample`` labelled rows of each class.

    Rows are taken in order of a hash of their id; null ids and labels other than 0 and 1 are left out.  Without both
    classes nothing is toxic.
    """
    marked = labels.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("int").alias("label")).where("id is not null")
    order = F.xxhash64("id"), F.col("id")
    picked = [marked.where(f"label = {k}").orderBy(*order).limit(sample) for k in (0, 1)]
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    # at most 2 * sample pairs of numbers are broadcast
    rows = texts.join(F.broadcast(picked[0].unionByName(picked[1])), "id").select("label", "text")
    words = F.size(F.array_distinct(F.split(F.lower("text"), r"[^\p{L}\p{N}]+"))).cast("long")
    n = {r[0]: r[1] for r in rows.groupBy("label").agg(F.sum(words)).collect()}
    if len(n) < 2:
        return Model()
    totals = F.sum("toxic").alias("a"), F.sum("clean").alias("b"), F.sum("texts").alias("texts")
    counts = rows.mapInArrow(_stem_batches, "stem string, toxic long, clean long, texts long").groupBy("stem").agg(*totals)
    strong = counts.where((F.col("texts") >= LEAST_DOCS) & (F.col("a") * n[0] >= LEAST_RATIO * n[1] * F.col("b")))
    strong = strong.withColumn("g2", F.round(_g2(F.col("a"), F.col("b"), n[1], n[0]), 6)).where(F.col("g2") >= LEAST_G2)
    # of equally strong stems the longest
    best = strong.orderBy(F.desc("g2"), F.desc(F.length("stem")), "stem").limit(40 * MOST_STEMS).select("stem", "a", "b").collect()
    stems = dict(list(learned_stems([tuple(r) for r in best], n[1], n[0]).items())[:MOST_STEMS])
    first = docs.sparkSession.sparkContext.broadcast(Model(stems))
    got = rows.mapInArrow(_input_batches(first), "label int, n_words long, worth array<double>").toArrow()
    worth = np.array(got["worth"].to_pylist(), float).reshape(-1, len(KINDS))
    y, n_words = got["label"].to_numpy().astype(float), got["n_words"].to_numpy()
    # what a kind is worth: its rate in toxic texts against clean ones, relative to the commonest kind
    total = [np.maximum(1, n_words[y == k].sum()) for k in (0, 1)]
    gain = {k: float(np.log((worth[y == 1, j].sum() + 0.5) / total[1] * total[0] / (worth[y == 0, j].sum() + 0.5))) for j, k in enumerate(KINDS)}
    kinds = {k: float(np.clip(g / max(gain["plain"], 1e-9), 0.1, 1.5)) if worth[:, j].sum() >= 20 else {"negated": 0.3, "reported": 0.5, "none": 0.0}.get(k, 1.0) for j, (k, g) in enumerate(gain.items())}
    value = worth @ np.array([kinds[k] for k in KINDS])
    x = np.stack([value, n_words / 100, value > 0, np.ones(len(y))], 1)
    return Model(stems, kinds, tuple(fit_beta(x, y).tolist()))


def score(docs: DataFrame, model: Model, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """``(row, score, predicted)`` of every row of ``docs``; ``row`` holds its columns.

    Null and empty texts have the score of a text without words; repeated rows score alike; whole texts are read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(texts: pa.Array) -> list[pa.Array]:
        each = [shared.value.scores(block) for block in blocks(texts)]
        values = np.concatenate(each) if each else np.zeros(0)
        return [pa.array(values, pa.float64()), pa.array((values >= threshold).astype(np.int32), pa.int32())]

    return attach(docs, text_col, "score double, predicted int", run)
