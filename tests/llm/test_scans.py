"""License scan, filter audit and importance resampling against plain versions and, on awkward rows, against their SQL."""

import hashlib
import math
import zlib
from collections import Counter
from itertools import permutations

import brute
import duckdb
import numpy as np
import pytest
from conftest import DOCS, ITEMS, PAGES, tables

import __spark_entry__ as entry
from assayspark.llm import crc, filter_audit, importance, license_scan

SF = "/root/testdata/sf0.001"
NOTICES = [
    (30, "Licensed under the Apache License, Version 2.0.", "en", "a"),
    (31, "licensed under the apache license one two three four five six seven eight nine version 2.0", "en", "a"),
    (32, "Apache License (the copy of ours), Version 2.0", "en", "a"),
    (33, "cc by cc by-nc CC-BY general public license General Public License all rights reserved", "en", "a"),
    (34, "general public", "en", "a"), (35, "license all rights reserved", "en", "a"),
    (36, "x " * 30_000 + "Released under the MIT License. All rights reserved.", "en", "b"),
    (37, "gnu general public license, version 3", "en", "b"), (37, "gnu general public license, version 3", "en", "b"),
    (38, "GNU general public license", "de", "b"), (39, "version 3", "de", "b"), (None, "all rights reserved", None, None),
    (40, "A B C D e", "de", "b"), (41, "A B C D e", "fr", "b"), (42, "word " * 120 + "$", "fr", "b"), (43, "word " * 120 + "$", "", "b"),
]


@pytest.fixture(scope="module")
def notices(tmp_path_factory):
    folder = tmp_path_factory.mktemp("notices")
    tables(folder, DOCS + NOTICES, ITEMS, PAGES)
    return str(folder)


@pytest.fixture(scope="module", params=["small", "notices"])
def place(request):
    return SF if request.param == "small" else request.getfixturevalue("notices")


def load(folder, name, columns):
    return duckdb.sql(f"SELECT {columns} FROM '{folder}/{name}.parquet'").fetchall()


def got(spark, name, folder):
    return [tuple(r) for r in entry.queries()[name](spark, folder).collect()]


def like(a, b):
    return sorted(map(repr, a)) == sorted(map(repr, b))


def places(words, phrase):
    p = phrase.split()
    return [i for i in range(len(words) - len(p) + 1) if words[i : i + len(p)] == p]


def scanned(texts):
    """Every template at every place, with dictionaries."""
    split = [brute.words(t) for t in texts]
    df = Counter(w for s in split for w in set(s))
    idf = lambda w: math.log((len(texts) + 1) / (df[w] + 0.5))
    out = []
    for words in split:
        base, labels, starts, score = set(), set(), [], 0.0
        for t in license_scan.TEMPLATES:
            own = t.words.split()
            offsets = [f" {t.words} ".split(f" {p} ")[0].split() for p in t.phrases]
            found = [[i - len(o) for i in places(words, p)] for p, o in zip(t.phrases, offsets, strict=True)]
            for begin in found[0]:
                if all(any(abs(begin - b) <= license_scan.SLACK for b in other) for other in found[1:]):
                    labels.add(t.label)
                    hit = sum(idf(w) for k, w in enumerate(own) if 0 <= begin + k < len(words) and words[begin + k] == w)
                    score = max(score, hit / sum(map(idf, own)))
                    if t.base:
                        base.add(t.label)
                        starts.append(begin)
        out.append((len(words), len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(base)), ",".join(sorted(labels)), round(score, 6)))
    return out


def test_op11(spark, place):
    data = load(place, "documents", "doc_id, text")
    want = [(d, *s) for (d, _), s in zip(data, scanned([t for _, t in data]), strict=True)]
    have = got(spark, "op11_license_scan", place)
    assert like([r[:7] for r in have], [r[:7] for r in want])
    assert np.allclose(sorted(r[7] for r in have), sorted(r[7] for r in want), atol=2e-6)
    if place != SF:
        labels = {r[0]: r[6] for r in have}
        assert labels[30] == "apache-2.0" and labels[31] == "" and labels[32] == "apache-2.0" and labels[34] == "" and labels[36] == "mit,reserved"
        assert labels[33] == "cc-by,cc-by-nc,gpl,reserved" and labels[37] == "gpl,gpl-3.0" and labels[38] == "gpl"


def test_op11_spans_and_own_templates(spark):
    docs = spark.createDataFrame([(1, "Our house licence, full text follows", "k"), (2, None, "k")], "doc_id long, text string, labels string")
    own = [license_scan.Template("house", "our house licence", ("house licence",))]
    rows = {r["doc_id"]: r for r in license_scan.scan(docs, templates=own).collect()}
    assert [tuple(s) for s in rows[1]["spans"]] == [("house", 0, 3)] and rows[1]["score"] == 1 and rows[2]["labels"] == "" and rows[1]["n_base"] == 0
    with pytest.raises(ValueError, match="phrase"):
        license_scan.Index([license_scan.Template("x", "a b", ("b a",))])


def audited(docs, labels):
    least = {}
    for d, t, _ in docs:
        if d is not None:
            least[t or ""] = min(d, least.get(t or "", d))
    good, toxic = ({d for d, *v in labels if d is not None and v[i] == 1} for i in (0, 1))
    rows = []
    for d, t, lang in docs:
        t = t or ""
        w = brute.INK.findall(t)
        fails = {"A": len(w) < 100, "B": 100 * len(set(w)) < 80 * len(w), "C": 100 * sum("A" <= c <= "Z" for c in t) > 10 * len(t),
                 "D": any(c in "#$%&*|" for c in t), "E": d is not None and least[t] < d}
        rows.append((lang or "", {k for k, v in fails.items() if v}, d in good, d in toxic))
    out = []
    for part in {r[0] for r in rows}:
        own = [r[1:] for r in rows if r[0] == part]
        steps, total = [], Counter()
        for order in map("".join, permutations("ABCDE")):
            here = own
            for k, f in enumerate(order):
                lost = [r for r in here if f in r[0]]
                here = [r for r in here if f not in r[0]]
                steps.append((part, order, k + 1, len(here), len(lost), sum(f in r[0] for r in own) - len(lost), sum(r[0] == {f} for r in own),
                              sum(r[1] for r in lost), sum(r[2] for r in lost)))
                total[f] += len(lost)
        out += [(*s, total[s[1][s[2] - 1]]) for s in steps]
    return out


def test_op12(spark, place):
    want = audited(load(place, "documents", "doc_id, text, lang"), load(place, "labels", "doc_id, quality, toxic"))
    assert like(got(spark, "op12_filter_audit", place), want)


def test_path_counts_are_factorials():
    forward, backward = filter_audit.path_counts(5)
    assert all(forward[s] == math.factorial(s.bit_count()) and backward[s] == math.factorial(5 - s.bit_count()) for s in range(32))


def test_audit_takes_other_filters(spark):
    docs = spark.createDataFrame([(1, "a b", "x"), (2, "a b", "x"), (3, "c", "x")], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    rows = {(r["filter_order"], r["step"]): r for r in filter_audit.audit(docs, labels, filters={"S": lambda n: n["words"] < 2}).collect()}
    assert {k: (r["kept"], r["removed"], r["shapley"]) for k, r in rows.items()} == {("SE", 1): (2, 1, 2), ("SE", 2): (1, 1, 2), ("ES", 1): (2, 1, 2), ("ES", 2): (1, 1, 2)}


def resampled(docs, items):
    def features(t):
        w = brute.words(t)
        return w, [zlib.crc32(f.encode()) % 10_000 for f in w + [f"{a} {b}" for a, b in zip(w, w[1:], strict=False)]]

    found = [(d, *features(t)) for d, t in docs]
    s, t = Counter(b for *_, f in found for b in f), Counter(b for x in items for b in features(x)[1])
    n_s, n_t = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1) * (n_s + 10_000) / ((s[b] + 1) * (n_t + 10_000)))) for b in range(10_000)]
    rows = []
    for d, w, f in found:
        weight = sum(gain[b] for b in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"7:{'' if d is None else d}".encode()).hexdigest()[:8], 16)
        rows.append((d, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), len(w) >= 20))
    able = sorted((r for r in rows if r[4]), key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[1]))
    drawn = 25 * len(able) // 100
    return [(*r[:4], i + 1 if i < drawn else None) for i, r in enumerate(able)] + [(*r[:4], None) for r in rows if not r[4]]


def test_op13(spark, place):
    want = resampled(load(place, "documents", "doc_id, text"), [t for (t,) in load(place, "benchmark", "text")])
    assert like(got(spark, "op13_importance", place), want)


def test_ranks_over_many_ranges(spark):
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled", "true")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        rows = spark.range(3000).selectExpr("id AS doc_id", "id AS key", "id % 7 AS score", "1L AS n_features")
        ranks = importance.ranked(importance.materialize(rows, "ranks")).select("doc_id", "score", "rank").collect()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)
    want = sorted(ranks, key=lambda r: (-r["score"], r["doc_id"]))
    assert [r["rank"] for r in want] == list(range(1, 3001))


def test_draw_keeps_columns_and_prefers_the_target(spark):
    rows = [(i, ("apple pear plum fig " if i % 2 else f"stone rock{i} sand clay ") * 6, "k") for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, key string")
    target = spark.createDataFrame([("apple pear plum fig " * 50,)], "text string")
    kept = importance.draw(docs, target)
    ids = [r["doc_id"] for r in kept.collect()]
    assert kept.columns == docs.columns and len(ids) == 50 and np.mean([i % 2 for i in ids]) > 0.8


def test_crc_of_any_part():
    rng = np.random.default_rng(3)
    for n in (0, 1, 63, 64, 65, 129, 5000):
        data = rng.integers(0, 256, n).astype(np.uint8)
        start = rng.integers(0, n + 1, 300)
        end = start + rng.integers(0, n + 1, 300) % (n + 1 - start)
        running = crc.RunningCrc(data)
        parts = crc.between(start, end, running.at(start), running.at(end))
        assert parts.tolist() == [zlib.crc32(data[i:j].tobytes()) for i, j in zip(start, end, strict=True)]


@pytest.mark.parametrize("name", ["op11_license_scan", "op12_filter_audit", "op13_importance"])
def test_sql_on_awkward_rows(spark, notices, name):
    con = duckdb.connect()
    for table in ("documents", "benchmark", "labels"):
        con.sql(f"CREATE VIEW {table} AS SELECT * FROM '{notices}/{table}.parquet'")
    frame = entry.queries()[name](spark, notices)
    want = con.sql(entry.oracle_sql()[name])
    at = [want.columns.index(c) for c in frame.columns]
    assert like([tuple(r) for r in frame.collect()], [tuple(r[i] for i in at) for r in want.fetchall()])
