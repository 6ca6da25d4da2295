import random
from itertools import chain

import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer as Library

from tests.llm.brute import digest
from tracewarden.llm import bpe
from tracewarden.llm.queries import op9

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def ours():
    return bpe.Tokenizer(open(PATH, encoding="utf-8").read())


@pytest.fixture(scope="module")
def library():
    return Library.from_file(PATH)


ODD = [
    "", " ", "\n", "a", "Don't we'll I'M they'VE", "<|endoftext|>", "x<|startoftext|><|endoftext|>y <|endoftext|", "İstanbul ΣΑΣ ǅ ﬁ", "é café ́x a ́",
    "한국어 각 한", "日本語" * 50, "1234567890 ½ Ⅷ ٣", "a b c　d\x85e\x1cf", "👩‍👩‍👧 👍🏽!!!", "!!'s''t..", "a" * 10_000, "ab" * 5_000, "thethethethe" * 900,
    "\U0001F600" * 2000, ("word " * 30_000), "\x00\x01\x7f", "x​y", "'" * 999, "é" * 3000, "aaaa<|endoftext|>" * 3, "ß ẞ ŉ ǰ",
]


def test_like_the_library(ours, library):
    rng = random.Random(4)
    alphabet = "abcdefghinorst éü'’<|>endoftext \n.,!0123ΣςİḰ 日한"
    texts = ODD + ["".join(rng.choice(alphabet) for _ in range(rng.randrange(1, 400))) for _ in range(1500)]
    texts += ["".join(rng.choice("aeinorst") for _ in range(4000)) for _ in range(20)]
    for text, want in zip(texts, library.encode_batch(texts, add_special_tokens=False)):
        ids = list(chain.from_iterable(ours.encode(text)))
        assert ids == want.ids, text[:80]
        assert bpe.Decoder(ours).feed(ids) == library.decode(want.ids, skip_special_tokens=False)


def test_any_cut_of_a_stream(ours):
    rng = random.Random(5)
    for text in ODD:
        whole = list(chain.from_iterable(ours.encode(text)))
        encoder, got, at = bpe.Encoder(ours), [], 0
        while at < len(text):
            step = rng.randrange(1, 2000)
            got += chain.from_iterable(encoder.feed(text[at : at + step]))
            at += step
        got += chain.from_iterable(encoder.finish())
        assert got == whole
        for surface in (True, False):
            once, parts = bpe.Decoder(ours, surface), bpe.Decoder(ours, surface)
            joined = "".join(parts.feed([i]) for i in whole) + parts.finish()
            assert joined == once.feed(whole) + once.finish()


def test_round_trip_of_bytes(ours):
    text = "naïve 日本 👍🏽 plain words"
    decoder = bpe.Decoder(ours, surface=False)
    assert decoder.feed(chain.from_iterable(ours.encode(text))) + decoder.finish() == "naïve 日本 👍🏽 plain words "


def test_lookahead_is_sufficient():
    """Random merge lists: no extension moves a border further back than the computed bound; some reach it."""
    rng = random.Random(6)
    reached = 0
    for _ in range(300):
        symbols, merges = list("abc"), []
        for _ in range(rng.randrange(1, 14)):
            pair = rng.choice(symbols), rng.choice(symbols)
            if len("".join(pair)) <= 9 and "".join(pair) not in symbols:
                merges.append(pair)
                symbols.append("".join(pair))
        made = bpe.Merges(merges)
        bound = made.lookahead(len)
        for _ in range(60):
            text = [rng.choice("abc") for _ in range(rng.randrange(1, 60))]
            cut = rng.randrange(1, len(text) + 1)

            def borders(part):
                at, out = 0, {0}
                for s in made.apply(list(part)):
                    at += len(s)
                    out.add(at)
                return out

            known, full = borders(text[:cut]), borders(text)
            moved = [p for p in known ^ full if p <= cut]
            if moved:  # the last border before the first that moved is where both agree
                agreed = max(p for p in known & full if p < min(moved))
                assert cut - agreed <= bound
                reached += cut - agreed == bound
    assert reached


def test_wrong_merges():
    for merges in ([("ab", "c"), ("a", "b")], [("a", "b"), ("a", "b")]):
        with pytest.raises(ValueError):
            bpe.Merges(merges)


def test_query(spark, library):
    read = lambda t: spark.read.parquet(f"/root/testdata/sf0.001/{t}.parquet")
    docs = {r.doc_id: r.text for r in read("documents").collect()}
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in op9(read).collect()}
    for i, text in docs.items():
        ids = library.encode(text or "", add_special_tokens=False).ids
        assert got[i] == (len(ids), digest(" ".join(map(str, ids))), digest(library.decode(ids, skip_special_tokens=False)))


def test_edge_rows(spark):
    docs = spark.createDataFrame([(1, None), (1, None), (None, ""), (2, "a b"), (3, "long " * 100_000)], "doc_id long, text string").withColumn("ids", F.lit(1)).withColumn("row", F.lit("r"))
    rows = {(r.doc_id, r.n_tokens) for r in op9(lambda t: docs).collect()}
    assert rows == {(1, 0), (None, 0), (2, 2), (3, 100_000)}
    assert op9(lambda t: docs.where("false")).collect() == []


def test_memory_of_a_text_without_spaces(ours, library):
    """Neither one long word nor a text without white space is held."""
    for unit in ("thequickbrown", "über", "日本語", "!?", "a1!", "<|endoftext|>", "'r'", "한국"):
        text = unit * (400_000 // len(unit))
        encoder, got, most = bpe.Encoder(ours), [], 0
        for at in range(0, len(text), 5_000):
            got += chain.from_iterable(encoder.feed(text[at : at + 5_000]))
            most = max(most, encoder.characters_held())
        got += chain.from_iterable(encoder.finish())
        assert most <= 2 * ours.lookahead + 256 + 20
        assert got == library.encode(text, add_special_tokens=False).ids


def test_every_word_goes_through_the_transducer(ours, monkeypatch):
    fed = []
    feed = bpe.Transducer.feed
    monkeypatch.setattr(bpe.Transducer, "feed", lambda self, part: (fed.append(part), feed(self, part))[1])
    ours.cache.clear()
    list(chain.from_iterable(ours.encode("Some words, some 'll'l of them twice: words x")))
    assert {"some", "words", ",", "of", "them", "twice", ":", "x"} <= set(fed) and fed.count("words") == 1


def test_any_cut_of_contractions_and_marks(ours, library):
    rng = random.Random(8)
    for _ in range(1500):
        text = "".join(rng.choice(["'", "r", "e", "l", "v", "s", "t", "!", " ", "1", "é", "\u0301", "가", "\u11a8", "<|endoftext|>", "<|end", "İ", "x"]) for _ in range(rng.randrange(1, 25)))
        encoder, got, at = bpe.Encoder(ours), [], 0
        while at < len(text):
            step = rng.randrange(1, 5)
            got += chain.from_iterable(encoder.feed(text[at : at + step]))
            at += step
        got += chain.from_iterable(encoder.finish())
        assert got == library.encode(text, add_special_tokens=False).ids, ascii(text)
