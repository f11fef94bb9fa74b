"""Every operator's query against its plain version, on the smallest tables and on awkward rows."""

import brute
import duckdb
import numpy as np
import pytest

import __spark_entry__ as entry
import corpus_pipeline
from assayspark.llm import html_text, language_id, pii, quality_rules, url_filter

SF = "/root/testdata/sf0.001"
QUERIES = entry.queries()
OPS = [q for q in QUERIES if q.startswith("op")]


def load(folder, name, columns):
    return duckdb.sql(f"SELECT {columns} FROM '{folder}/{name}.parquet'").fetchall()


@pytest.fixture(scope="module", params=["small", "edge"])
def place(request):
    return SF if request.param == "small" else request.getfixturevalue("edge")


def rows(spark, name, folder):
    return [r.asDict() for r in QUERIES[name](spark, folder).collect()]


def like(a, b):
    """Equal as multisets; nulls compare."""
    return sorted(map(repr, a)) == sorted(map(repr, b))


def test_all_are_there():
    assert sorted(int(q[2:].split("_")[0]) for q in OPS) == list(range(1, 14)) and "pipeline" in QUERIES


@pytest.mark.parametrize("name", OPS)
def test_empty_tables_give_no_rows(spark, empty, name):
    assert QUERIES[name](spark, empty).collect() == []


def test_op1(spark, place):
    got = rows(spark, "op1_url_filter", place)
    aliases = {3: "block", 4: "block", 9: "allow", 10: "block"} if "edge" in place else {}
    want = []
    for page, url in load(place, "pages", "page_id, url"):
        host, path = brute.url_parts(url)
        rule = brute.url_rule(host, path, url_filter.RULES)
        want.append((page, host, path, rule and rule[1], aliases.get(page, "allow") if rule is None else rule[0]))
    assert like([tuple(g[c] for c in ("page_id", "host", "path", "rule", "verdict")) for g in got], want)


def test_op2(spark, place):
    got = rows(spark, "op2_quality_model", place)
    assert like([g["doc_id"] for g in got], [r[0] for r in load(place, "documents", "doc_id")])
    assert all(0 <= g["score"] <= 1 and g["predicted"] == (g["score"] >= 0.3) for g in got)
    held = {r[0] for r in duckdb.sql(f"SELECT doc_id FROM '{place}/documents.parquet' WHERE doc_id IS NOT NULL").fetchall() if brute.zlib.crc32(str(r[0]).encode()) % 5 == 0}
    assert {g["doc_id"] for g in got if g["held_out"]} == held


def test_op2_ranks_unseen_labels(spark):
    folder = "/root/testdata/sf0.01"
    label = dict(load(folder, "labels", "doc_id, quality"))
    held = [(g["score"], label[g["doc_id"]]) for g in rows(spark, "op2_quality_model", folder) if g["held_out"] and g["doc_id"] in label]
    good, bad = [s for s, y in held if y], [s for s, y in held if not y]
    assert np.mean([[a > b for b in bad] for a in good]) > 0.95 and np.mean([(s >= 0.3) == y for s, y in held]) > 0.93


def test_op3(spark, place):
    data = load(place, "documents", "doc_id, text")
    want = brute.near_classes([d for d, _ in data], [t for _, t in data])
    got = rows(spark, "op3_near_duplicates", place)
    assert like([(g["doc_id"], g["class_id"]) for g in got], [(d, w) for (d, _), w in zip(data, want, strict=True)])


def test_op4(spark, place):
    data = load(place, "documents", "doc_id, text")
    counts = brute.token_counts([t for _, t in data])
    want = [(d, len((t or "").encode()), n, n > 2048) for (d, t), n in zip(data, counts, strict=True)]
    assert like([tuple(g.values()) for g in rows(spark, "op4_token_counts", place)], want)


def test_op5(spark, place):
    items = dict(load(place, "benchmark", "item_id, text"))
    want = []
    for d, t in load(place, "documents", "doc_id, text"):
        n, hit, found = brute.benchmark_hits(t, items)
        want.append((d, n, hit, len(found), brute.sha(",".join(found)), hit > 0))
    assert like([tuple(g.values()) for g in rows(spark, "op5_decontaminate", place)], want)


def test_op6(spark, edge):
    got = {g["page_id"]: g for g in rows(spark, "op6_html_text", edge)}
    assert got[1]["text"] == "Title & more\n\nFirst para bold.\n\nSecond line"
    assert got[2]["text"] == "Text of the page." and got[11]["text"] == "only"
    assert got[5]["text"] == "" and got[6]["text"] == "" and got[5]["n_chars"] == 0
    assert all(g["n_chars"] == len(g["text"]) for g in got.values())


def test_op6_finds_articles_of_pages_it_has_not_seen(spark):
    pages = [h for (h,) in duckdb.sql("SELECT html FROM '/root/testdata/sf0.01/pages.parquet' ORDER BY page_id").fetchall()]
    forest = html_text.learn(pages[:120])
    for html, text in zip(pages[120:], html_text.extract(pages[120:], forest), strict=True):
        nodes, parents = html_text.flatten(html_text.parse(html_text.marked(html)))
        assert text == "\n\n".join(html_text.blocks_of(nodes, parents, html_text.truth(nodes, parents)))


def test_op7(spark, place):
    data = load(place, "documents", "doc_id, text")
    spans = brute.all_spans([t or "" for _, t in data])
    want = []
    for (d, t), every in zip(data, spans, strict=True):
        base = brute.base_spans(t)
        want.append((d, *[sum(k == i for _, k, _ in base) for i in range(4)], brute.sha(brute.show(base)), brute.show(every)))
    got = [tuple(g.values()) for g in rows(spark, "op7_pii", place)]
    assert like(got, want)
    if "edge" in place:
        assert any("term:" in g[-1] for g in got)


def test_op7_survives_long_runs(spark):
    def texts(n):
        return ["1" * n, "a" * n + "@", "a@b" + ".c" * n, "+1" + "(" * n, "1." * n, "1 " * n, "x@" * n, "10.0.0.1 " * n]

    docs = [(i, t) for i, t in enumerate(texts(300))] + [(100 + i, t) for i, t in enumerate(texts(12_000))]
    got = {r["doc_id"]: r["base"] for r in pii.find_pii(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    for i, t in enumerate(texts(300)):
        assert [(s["start"], s["kind"], s["end"]) for s in got[i]] == brute.base_spans(t)
    assert [len(got[100 + i]) for i in range(8)] == [0, 0, 1, 0, 3000, 0, 0, 12_000]


def test_sanitised_text(spark):
    docs = spark.createDataFrame([(1, "a@b.cc and 10.0.0.1x", 5, "k"), (2, None, 0, "k"), (3, "clean", 5, "k")], "doc_id long, text string, n_chars long, key string")
    got = {r["doc_id"]: r for r in pii.sanitise(docs).collect()}
    assert got[1]["text"] == "[EMAIL] and [IP]x" and got[1]["n_chars"] == 17 and got[2]["text"] is None and got[3]["text"] == "clean"
    assert pii.sanitise(docs).columns == docs.columns


def test_op8(spark, place):
    data = load(place, "documents", "doc_id, text")
    want = []
    for d, t in data:
        n = brute.base_counts(t)
        want.append((d, *n, n[0] < 10 or 100 * n[4] > 20 * n[0]))
    got = rows(spark, "op8_quality_rules", place)
    assert like([tuple(g[c] for c in ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")) for g in got], want)
    assert not any(g["kept"] and g["base_failed"] for g in got)


def test_op8_limits_follow_the_group(spark):
    clean = "plain words in a row that nobody would call odd number {}"
    loud = "# plain # words # in # a # row # that # nobody # would # call # odd {}"
    data = [(i, clean.format(i), "en", "calm") for i in range(300)] + [(i, loud.format(i), "en", "loud") for i in range(300, 600)]
    data += [(600, loud.format(600), "en", "calm"), (601, clean.format(601), "en", "loud"), (602, loud.format(602), "en", "new")]
    docs = spark.createDataFrame(data, "doc_id long, text string, lang string, source string")
    kept = {r["doc_id"]: r["kept"] for r in quality_rules.quality_rules(docs).collect()}
    assert not kept[600] and all(v for k, v in kept.items() if k != 600)


def test_sketch_quantiles_are_near(spark):
    from pyspark.sql import functions as F

    values = np.random.default_rng(2).lognormal(size=4000)
    frame = spark.createDataFrame([(float(v),) for v in values], "v double").select(quality_rules.middle(quality_rules.bucket(F.col("v"))).alias("m"), "v")
    assert all(abs(r["m"] - r["v"]) <= 0.011 * r["v"] for r in frame.collect())


def test_op9(spark, place):
    got = rows(spark, "op9_language_id", place)
    data = dict(load(place, "documents", "doc_id, text"))
    assert len(got) == len(load(place, "documents", "doc_id"))
    for g in got:
        assert 0 <= g["score"] <= 1 and (g["lang_pred"] == "und") == (not any(c.isalpha() for c in data[g["doc_id"]] or ""))
    if place == SF:
        lang = dict(load(place, "documents", "doc_id, lang"))
        assert np.mean([g["lang_pred"] == lang[g["doc_id"]] for g in got if g["held_out"]]) > 0.95


def test_op9_without_labels(spark):
    from pyspark.sql import functions as F

    docs = spark.createDataFrame([(1, "hello", None)], "doc_id long, text string, lang string")
    parser = language_id.fit_languages(docs, F.lit(True))
    out, names = language_id.identify(docs, parser)
    assert parser is None and out.first()[names[0]] == "und"


def test_op10(spark, place):
    data = load(place, "documents", "doc_id, text")
    ids = [x + [2] for x in brute.byte_ids([t for _, t in data])]
    want = []
    for (d, _), x in zip(data, ids, strict=True):
        head = len(x) - 1024 * (-(-len(x) // 1024) - 1)
        cuts = [0, *range(head, len(x) + 1, 1024)]
        want += [(d, i, a, b - a, brute.crc(x[a:b])) for i, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True))]
    got = rows(spark, "op10_best_fit_packing", place)
    assert like([tuple(g[c] for c in ("doc_id", "piece", "start", "length", "ids_crc32")) for g in got], want)
    bins = {}
    for g in got:
        bins.setdefault(g["sequence_id"], []).append((g["offset"], g["length"]))
    for parts in bins.values():
        parts.sort()
        assert [o for o, _ in parts] == [0, *np.cumsum([n for _, n in parts])[:-1].tolist()] and sum(n for _, n in parts) <= 1024
    total = sum(map(len, ids))
    assert len(bins) <= 1.02 * -(-total // 1024) + 2


def stages(spark, folder, tmp):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    out = []
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, folder).write.parquet(path := f"{tmp}/{i}")
        after = spark.read.parquet(path)
        out.append((name, docs, after))
        docs = after
    return out


def test_pipeline_stage_by_stage(spark, place, tmp_path):
    (_, raw, good), (_, _, single), (_, _, clean), (_, _, safe), (_, last, packed) = stages(spark, place, tmp_path)
    for frame in (good, single, clean, safe):
        assert frame.columns == raw.columns
    pairs = lambda f: sorted(((r["doc_id"], r["text"]) for r in f.select("doc_id", "text").collect()), key=repr)
    before, kept = pairs(raw), pairs(good)
    assert all(brute.base_counts(t)[0] >= 10 for _, t in kept) and set(kept) <= set(before)
    classes = brute.near_classes([d for d, _ in kept], [t for _, t in kept])
    one = pairs(single)
    assert len(one) == len({(c if brute.words(t) else (d, t)) for c, (d, t) in zip(classes, kept, strict=True)}) and set(one) <= set(kept)
    items = dict(load(place, "benchmark", "item_id, text"))
    assert like(pairs(clean), [p for p in one if not brute.benchmark_hits(p[1], items)[1]])
    texts = pairs(clean)
    after = pairs(safe)
    assert len(after) == len(texts) and not any(brute.base_spans(t) for _, t in after)
    plain = [p for p, s in zip(texts, brute.all_spans([t or "" for _, t in texts]), strict=True) if not s]
    assert set(plain) <= set(after)
    total = sum(len(x) + 1 for x in brute.byte_ids([t for _, t in after]))
    assert sum(r["length"] for r in packed.collect()) == total


def test_pipeline_on_empty_tables(spark, empty, tmp_path):
    assert corpus_pipeline.run(spark, empty).collect() == []
