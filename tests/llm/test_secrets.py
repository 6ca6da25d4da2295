import base64
import random
import re

import public_tokenizers
import pytest
from pyspark.sql import functions as F

from tests.llm.brute import digest
from tracewarden.llm import secrets
from tracewarden.llm.queries import op2

PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def words():
    return secrets.vocabulary(open(PATH, "rb").read())


def brute(text):
    """The base patterns as the contract states them."""
    text, out = text or "", []
    key = "|".join("".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in w) for w in ("password", "passwd", "secret", "token", "api_?key"))
    for m in re.finditer(rf"""({key})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text):
        if len(m[2]) >= 8:
            out.append((m.start(), 0, m.end()))
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    out += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 32]
    return sorted(out)


def named(found):
    return ",".join(f"{secrets.KINDS[k]}:{s}:{e}" for s, k, e in found)


TEXTS = [
    None, "", "x", 'API_KEY = "abcdefgh"', "apikey:abcdefg", "Token=short token = longer-than-8 toKen:'x.y=z/w+1_2'", "ſecret=abcdefghijk toKen=abcdefghijk",
    "AKIA" + "A" * 12, "AKIAAKIA" + "Z9" * 4, "AKIA123", "f" * 31, "f" * 32, "g" + "0a" * 40 + "G", "password=password=12345678", "secret: é token == abcdefgh1234", 'secret"  :   "0123456789abcdef0123456789abcdef"', "passwd = " + "a" * 100_000,
]


def test_base_spans():
    rng = random.Random(2)
    parts = ["token", "Secret", "api_key", "APIKEY", " ", "=", ":", '"', "'", "AKIA", "0123456789abcdef", "ABCDEF0123456789", "é", "x", "-", "\n", "passwd", "password"]
    for text in TEXTS + ["".join(rng.choice(parts) for _ in range(rng.randrange(30))) for _ in range(3000)]:
        assert sorted(secrets.base_spans(text or "")) == brute(text), text


def test_random_strings(words):
    rng = random.Random(3)
    for _ in range(200):
        key = base64.b64encode(rng.randbytes(30)).decode()
        if re.search("[0-9]", key) and not re.search("[+/=]{2}", key):
            assert [s[1] for s in secrets.spans(f"see {key} there", words)] in ([3], [1, 3]), key
    for plain in ("internationalization-of-things_2024", "https/www/example/com/articles/2023/introduction", "d41d8cd98f00b204e9800998ecf8427e"[:32].upper(), "550e8400-e29b-41d4-a716-446655440000", "1234567890123456789012345", "20240131T120000Z-20240201T120000Z", "averylongcompoundwordwithoutdigits"):
        assert secrets.random_spans(plain, words) == [], plain
    inside = "token = " + base64.b64encode(rng.randbytes(30)).decode().replace("+", "a").replace("/", "b")
    assert [s[1] for s in secrets.spans(inside, words)] == [0]


def test_query(spark, words):
    read = lambda t: spark.read.parquet(f"/root/testdata/sf0.001/{t}.parquet")
    more = spark.createDataFrame([(-k, t) for k, t in enumerate(TEXTS)] + [(None, "x"), (-1, "")], "doc_id long, text string")
    docs = read("documents").select("doc_id", "text").union(more).withColumn("spans", F.lit(1)).withColumn("row", F.lit("r"))

    def row(i, text):
        base = brute(text)
        return i, *(sum(k == n for _, k, _ in base) for n in range(3)), digest(named(base)), named(secrets.spans(text or "", words))

    want = sorted((row(r.doc_id, r.text) for r in docs.collect()), key=str)
    got = sorted((tuple(r) for r in op2(lambda t: docs).collect()), key=str)
    assert got == want
    assert op2(lambda t: docs.where("false")).collect() == []


def test_redaction(spark):
    docs = spark.createDataFrame([(1, "a token = 'abcdefgh12' b AKIA" + "A" * 20, 5), (2, None, None), (3, "é", 1)], "doc_id long, text string, n_chars long").withColumn("masked", F.lit(0))
    rows = {r.doc_id: r for r in secrets.redact(docs, PATH).collect()}
    assert secrets.redact(docs, PATH).columns == docs.columns
    assert rows[1].text == "a [secret]' b [secret]" and rows[1].n_chars == 22
    assert (rows[2].text, rows[2].n_chars, rows[3].text, rows[3].n_chars) == (None, None, "é", 1)


@pytest.mark.parametrize("alphabet, size", [("abcdefghijklmnopqrstuvwxyz0123456789", 32), ("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789", 24), ("abcdefghijklmnopqrstuvwxyz", 32), ("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz", 24)])
@pytest.mark.parametrize("before", ["", "https://hooks.example.com/services/integrations/notifications/", "/etc/application/credentials/production/", "my-service-account=", "deploy_value_of_the_service="])
def test_recall_in_paths_and_assignments(words, alphabet, size, before):
    rng = random.Random(5)
    hit = 0
    for _ in range(200):
        key = "".join(rng.choices(alphabet, k=size))
        text = f"see {before}{key} there"
        at = text.index(key)
        hit += any(s <= at and at + size <= e for s, k, e in secrets.spans(text, words) if k == 3)
    assert hit >= 190


def test_no_random_strings_in_names(words):
    for plain in ("com/services/integrations/notifications/settings", "getHttpResponseCodeFromServerConnection", "HAVE_SCHED_SETSCHEDULER", "abcdefghijklmnopqrstuvwxyz", "api/550e8400-e29b-41d4-a716-446655440000/items", "archive/d41d8cd98f00b204e9800998ecf8427e/download", "donaudampfschifffahrtsgesellschaft", "--------------------------------"):
        assert secrets.dense_spans(plain, words) == [], plain
