import math
import re
from collections import Counter

from pyspark.sql import functions as F

from tracewarden.llm import licences
from tracewarden.llm.queries import op5


def brute(rows):
    idf, unknown, vectors = licences.weights(licences.TEMPLATES)
    names = sorted(licences.TEMPLATES)

    def best(body):
        c = Counter(re.findall(licences.WORD, body.lower(), re.A))
        w = {k: n * idf.get(k, unknown) for k, n in c.items()}
        size = math.sqrt(sum(x * x for x in w.values()))
        if not size:
            return None
        s, k = max((round(sum(x * vectors[n].get(word, 0) for word, x in w.items()) / size, 9), -k) for k, n in enumerate(names))
        return (s, k, names[-k]) if s >= licences.SIMILAR else None

    own, held = [], {}
    for _, path, text in rows:
        text, folder = text or "", re.sub("/?[^/]*$", "", path or "")
        file = bool(path and re.search(licences.LICENCE_FILE[4:], path, re.I))
        bodies = [text] if file and text else [x for x in text.split("\n") if re.search(licences.CUE[4:], x, re.I)]
        mine = max(filter(None, map(best, bodies)), default=None)
        own.append(mine)
        if file and mine:
            held[folder] = max(mine, held.get(folder, mine))
    for (i, path, _), mine in zip(rows, own):
        folder = re.sub("/?[^/]*$", "", path or "")
        theirs = None
        while theirs is None:
            theirs = held.get(folder)
            if not folder:
                break
            folder = folder.rpartition("/")[0]
        got = mine or theirs
        yield i, path, got[2] if got else None, round(got[0], 6) if got else 0.0, "own" if mine else "inherited" if theirs else "none"


def got(df):
    return sorted(((r.row.doc_id, r.row.path, r.licence, round(r.similarity, 6), r.origin) for r in df.collect()), key=str)


def test_inheritance_and_edges(spark):
    t = licences.TEMPLATES
    rows = [
        (1, "a/LICENSE", t["MIT"]), (2, "a/b/c/x.py", "code"), (3, "a/b/COPYING.txt", "  " + t["GPL-3.0"].upper()), (4, "a/b/c/d/y.py", None),
        (5, "a/z.py", "# " + t["Apache-2.0"] + "\nbody"), (6, "q/none.py", "nothing"), (7, "q/LICENSE", "something unrelated entirely"), (8, None, "x"), (None, "a/w", ""),
        (9, "a/b/c/e/LICENCE", t["MIT"] + "\n" + t["MIT"]), (10, "a/b/c/e/NOTICE", t["MPL-2.0"]), (11, "a/b/c/e/f/g", "line\n" * 50_000), (12, "top", "All Rights Reserved.\nlicense to kill\n" + t["CC-BY-NC-4.0"]),
        (13, "ab/x", "not below a"), (14, "LICENSE", ""), (15, "é/LICENSE", t["MIT"]), (16, "é/x", "é"), (5, "a/z.py", "copy"), (5, "a/z.py", "copy"), (17, "e/LICENSE", "copyright"),
    ]
    df = spark.createDataFrame(rows, "doc_id long, path string, text string").withColumn("row", F.lit(1)).withColumn("licence", F.lit("x")).withColumn("directory", F.lit("y"))
    assert got(licences.scan(df, ["doc_id", "path", "row", "licence"])) == sorted(brute(rows), key=str)
    assert licences.scan(df.where("false"), ["path"]).collect() == []


def test_whole_table(spark):
    read = lambda t: spark.read.parquet(f"/root/testdata/sf0.001/{t}.parquet")
    texts = {r.doc_id: r.text for r in read("documents").collect()}
    have = [tuple(r) for r in op5(read).collect()]
    assert sorted(have, key=str) == sorted(brute([(i, p, texts[i]) for i, p, *_ in have]), key=str)
    plan = op5(read)._jdf.queryExecution().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow", "Cartesian", "NestedLoop"))


def test_whole_licence_files_are_found_and_inherited(spark):
    texts = dict(licences.whole_texts())
    mit = texts["MIT"].replace("<year> <copyright holders>", "2019 Jane Roe and the Foo project")
    rows = [(1, "m/LICENSE", mit), (2, "m/src/a.py", "code"), (3, "p/LICENSE.txt", texts["Apache-2.0"]), (4, "p/b/c.py", None)]
    rows += [(10 + k, f"all/{n}/COPYING", t.replace("\n", "\r\n")) for k, (n, t) in enumerate(texts.items())]
    rows += [(30, "prose/LICENSE", "story of the sea and the old boat\n" * 40 + licences.TEMPLATES["CC-BY-4.0"] + "\nmore"), (31, "prose/x", "x"), (32, "s/x.c", "// SPDX-License-Identifier: GPL-2.0-or-later"), (33, "none/LICENSE", "the of and to in a is that for it " * 300)]
    have = {r.row.doc_id: (r.licence, r.origin) for r in licences.scan(spark.createDataFrame(rows, "doc_id long, path string, text string"), ["doc_id"]).collect()}
    want = {1: ("MIT", "own"), 2: ("MIT", "inherited"), 3: ("Apache-2.0", "own"), 4: ("Apache-2.0", "inherited"), 30: ("CC-BY-4.0", "own"), 31: ("CC-BY-4.0", "inherited"), 32: ("GPL-2.0", "own"), 33: (None, "none")}
    assert have == want | {10 + k: (n, "own") for k, n in enumerate(texts)}
