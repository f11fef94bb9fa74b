"""The whole job where a shortcut would pass on the ordinary tables."""

import time
import zlib
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import pytest

import brute

from assayspark.llm import html_text, near_duplicates, pii, quality_rules, url_filter


def term_spans(spark, texts):
    """(text number, word) of every term span."""
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return {
        (r["doc_id"], texts[r["doc_id"]][s["start"] : s["end"]])
        for r in pii.find_pii(docs).collect() for s in r["spans"] if s["kind"] == pii.KINDS.index("term")}


OTHERS = [f"text number {i} about nothing" for i in range(60)]


def test_copies_do_not_hide_a_disclosing_term(spark):
    one, two = "Zorblax wrote zz@mail.example.org first", "again Zorblax uses zz@mail.example.org"
    got = term_spans(spark, [one] * 100 + [two] + OTHERS)
    assert got == {(i, "Zorblax") for i in range(101)}


def test_terms_far_from_their_entity_are_marked_everywhere(spark):
    far = " some more of the usual words" * 20
    texts = [f"Zorblax wrote{far} zz@mail.example.org{far} signed Zorblax", f"zz@mail.example.org{far} by Zorblax", *[x + far for x in OTHERS]]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: [texts[r["doc_id"]][s["start"] : s["end"]] for s in r["spans"] if s["kind"] == 4] for r in pii.find_pii(docs).collect()}
    assert got.pop(0) == ["Zorblax"] * 2 and got.pop(1) == ["Zorblax"] and not any(got.values())


def test_repeated_passages_count_as_often_as_they_stand():
    # 24 words in a circle, walked 50 times, and 60 words of each side's own
    circle = " ".join(f"w{i}" for i in range(24))
    a, b = (" ".join([circle] * 50 + [f"{side}{i}" for i in range(60)]) for side in "xy")
    plain = near_duplicates.Weights(np.zeros(0, dtype=np.uint64), np.zeros(0), 1.0)
    assert near_duplicates.similarity(pa.array([a]), pa.array([b]), plain)[0] > 0.8


@pytest.mark.parametrize("tag", [
    "<svg/>", "<svg width='1' />", "<script src='a.js' />", "<iframe/>", "<object/>", "<select><option>", "<noscript>", "<object>",
    "<svg><title>t</title><svg></svg>no</svg>", "<noscript><p>no</noscript>", "<template><div>no</div></template>",
    "<script src=/a/>no()</script>", "<select><option>no</select>", "<noscript><i>", "<div><svg></div>",
])
def test_text_after_an_empty_or_unclosed_element_stays(tag):
    page = f"<body><p>before</p>{tag}<p>after</p><noscript>no</noscript><p>end</p></body>"
    (text,) = html_text.extract([page], None)
    assert [b for b in text.split("\n\n") if b] == ["before", "after", "end"]


def test_copies_do_not_open_the_limits(spark):
    loud = "THESE ARE TEN OR MORE WORDS IN CAPITALS FOR ALL OF YOU"
    again = " ".join(f"word{i}" for i in range(60)) + " one two three four five again one two three four five"
    texts = [f"plain words in a row that nobody would call odd number {i}" for i in range(250)] + [loud] * 150 + [loud + " NOW", again]
    docs = spark.createDataFrame([(i, t, "en", "a") for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string")
    kept = {r["doc_id"]: r["kept"] for r in quality_rules.quality_rules(docs).collect()}
    assert all(kept[i] for i in range(250)) and not any(kept[i] for i in range(250, 402))


def test_recurring_parts_are_entities(spark):
    texts = [f"{w} writes from Quarnholm, mail {w}.lee@box.example.org please" for w in ("ann", "bob", "cyd")]
    texts += [f"host 10.20.30.{i} stands in Vettelby {w}" for i, w in enumerate(("so on", "more", "less", "then"))]
    texts += ["call +1 (212) 555-0188 at Orrin", "call +1 212 555 0199 at Orrin", "two of a kind mail x9@sole.example.net Twig", "and mail y9@sole.example.net Twig again"]
    # the phone numbers share an exchange in two texts only, as do the last addresses: too few for a part
    got = term_spans(spark, texts + OTHERS)
    assert {w for i, w in got if i < 3} == {"writes", "from", "Quarnholm", "please"} and {w for i, w in got if 3 <= i < 7} == {"host", "stands", "in", "Vettelby"}
    assert not [x for x in got if x[0] >= 7]


def test_values_are_the_same_however_they_are_written(spark):
    texts = ["card 4111 1111 1111 1111 of Umbrel", "card 4111-1111-1111-1111 of Umbrel today"]
    assert term_spans(spark, texts + OTHERS) == {(i, w) for i in (0, 1) for w in ("card", "of", "Umbrel")}


def test_long_texts_with_marked_terms_take_linear_time(spark):
    import time

    def took(n):
        texts = ["Zorblax zz@mail.example.org " + " ".join(f"w{i % 5000}x" for i in range(n)) + " Zorblax", "mail zz@mail.example.org Zorblax", *OTHERS]
        docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
        start = time.perf_counter()
        rows = {r["doc_id"]: r["spans"] for r in pii.find_pii(docs).collect()}
        assert [texts[0][s["start"] : s["end"]] for s in rows[0] if s["kind"] == 4] == ["Zorblax"] * 2
        return time.perf_counter() - start

    took(1000)
    assert took(100_000) < 20 + 10 * took(10_000)


def test_rule_verdicts_equal_brute_force(spark):
    draw = np.random.default_rng(5)
    words = ["some", "plain", "words", "Here", "THERE", "and", "now", "#tag", "5|6", "wörd", "<b>"]
    rows = []
    for i in range(700):
        lang, source = ("en", "calm") if i < 260 else ("en", "loud") if i < 520 else ("en", "few") if i < 640 else ("fr", None)
        odds = np.array([3, 3, 3, 1, 0.2, 3, 3, *([2, 1, 1, 2] if source == "loud" else [0.05, 0.01, 0.3, 0.02])])
        take = [" ".join(draw.choice(words, size=draw.integers(3, 25), p=odds / odds.sum())) + f" {i}" for _ in range(draw.integers(1, 4))]
        rows.append(("\n".join([*take, take[0]] if draw.random() < 0.1 else take), lang, source))
    rows += [(f"#a {i} #b |c ### now <x> and $ some %% more && of {i} <<>>", *r[1:]) for i, r in enumerate(rows[250:270])]
    rows += [rows[3]] * 40 + [(None, "en", "calm"), ("", "fr", None), ("ALL OF THESE WORDS ARE LOUD AND THERE ARE MORE THAN TEN", "en", "calm")] * 2
    docs = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "doc_id long, text string, lang string, source string")
    got = {r["doc_id"]: r["kept"] for r in quality_rules.quality_rules(docs).collect()}
    want = brute.rule_verdicts(rows)
    assert [got[i] for i in range(len(rows))] == want
    passed = [w for w, r in zip(want, rows, strict=True) if not quality_base(r[0])]
    assert 0.02 < 1 - np.mean(passed) < 0.5


def quality_base(text):
    n = brute.base_counts(text)
    return n[0] < 10 or 100 * n[4] > 20 * n[0]


@pytest.mark.parametrize("page", [
    "<i>" * 100_000 + "x" + "</b>" * 100_000, "<i>" * 50_000 + "<div></div>" * 50_000, "<ul><li>" * 30_000 + "<option>x" * 30_000,
    "<a \"" * 100_000, "<!--" * 100_000, "<svg>" * 100_000,
])
def test_odd_nesting_takes_time_in_proportion(page):
    begin = time.process_time()
    html_text.extract([page], None)
    assert time.process_time() - begin < 15


def test_url_query_and_sql_agree_on_declared_addresses(spark, tmp_path):
    link, meta = "<LINK REL=canonical HREF='{}'>", "<meta content='0;URL={}' http-equiv=refresh>"
    targets = [
        "http://evil.net/a", "https://Evil.NET/b?x=1&amp;y=2#f", "//host.evil.net/c", "/de/x", "rel/y", "?q=1", "#top", "http://example.net/en/z",
        "http://a.org/fr/q", "http://one.example.com/p1", "https://two.example.com/p2",
    ]
    urls = [f"http://{n}.example.com/p{i}" for i, n in enumerate(["zero", "one", "two", "three", "four", "five", "six", "seven"])]
    urls += ["http://example.com/de/a", "http://EXAMPLE.com/en/b", "http://evil.net/a", "http://example.net/de/q", "http://example.net", None, "none"]
    pages = [(k, url, form.format(target)) for k, (url, target, form) in enumerate(
        (u, t, f) for i, u in enumerate(urls) for j, t in enumerate(targets) for f in (link, meta) if (i * 5 + j * 3) % 7 == 0)]
    pages += [(10_000, "http://x.example.org/1", None), (10_001, "http://y.example.org/1", "<link href='http://evil.net/z' rel=\"canonical\">")]
    spark.createDataFrame(pages, "page_id long, url string, html string").coalesce(1).write.parquet(f"{tmp_path}/pages.parquet")
    columns = ["page_id", "host", "path", "rule", "verdict"]
    got = sorted(tuple(r[c] for c in columns) for r in url_filter.op1_url_filter(spark, str(tmp_path)).collect())
    base = duckdb.connect()
    base.execute(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    want = sorted(base.sql(f"SELECT {', '.join(columns)} FROM ({url_filter._SQL})").fetchall())
    assert got == want
    inherited = {v for p, h, _, rule, v in got if rule is None and h}
    assert inherited == {"allow", "block"} and dict((r[0], r[4]) for r in got)[10_001] == "block"


def test_rare_shingles_have_their_own_document_frequency(spark, monkeypatch):
    # what the two share stands in two documents, what sets them apart in 38: equal weights for both would part them
    monkeypatch.setattr(near_duplicates, "FREQUENT", 16)
    own, common = " ".join(f"own{i}" for i in range(44)), " ".join(f"common{i}" for i in range(11))
    texts = [own, f"{own} {common}", *[f"{common} other{k} thing{k}" for k in range(38)]]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = near_duplicates.near_duplicate_classes(docs)[0].collect()
    got = {r["doc_id"]: r["class_id"] for r in rows}
    assert [got[i] for i in range(len(texts))] == brute.near_classes(range(len(texts)), texts, frequent=1 << 40)
    assert got[1] == 0 and got[2] == 2


def test_ranges_count_every_shingle(spark, monkeypatch):
    monkeypatch.setattr(near_duplicates, "RANGE", 500)
    monkeypatch.setattr(near_duplicates, "CHUNK", 700)
    texts = [" ".join(f"w{(i * j) % 13}" for j in range(i % 29)) or None for i in range(120)]
    docs = spark.createDataFrame(list(enumerate(texts)), "h long, text string").repartition(3)
    counts = near_duplicates.shingle_counts(docs)
    bags = brute.shingle_bags(texts)
    df = Counter(s for b in bags for s in b)
    assert counts.bits > 2 and counts.total == sum(df.values()) and counts.docs == sum(1 for b in bags if b)
    for r in near_duplicates.weigh(docs, counts).collect():
        got = np.frombuffer(zlib.decompress(r["dfs"]), dtype=np.uint32)
        assert sorted(got) == sorted(df[s] for s in bags[r["h"]])
        heavy = sum(k * near_duplicates.idf(np.float64(df[s]), counts.docs) for s, k in bags[r["h"]].items())
        assert r["total"] == pytest.approx(heavy)


def test_texts_that_are_nearly_similar_are_not_all_joined(spark, monkeypatch):
    # 120 texts of similarity 0.77 to each other, and near copies of some of them
    monkeypatch.setattr(near_duplicates, "SLICE", 32)
    base = [f"b{i}" for i in range(124)]
    texts = [" ".join([*base, *[f"x{k}y{i}" for i in range(9)]]) for k in range(120)]
    texts += [f"{t} tail{k}" for k, t in enumerate(texts[:15])]
    seen, old = [], near_duplicates.verify
    monkeypatch.setattr(near_duplicates, "verify", lambda pairs, *rest: seen.append(pairs.count()) or old(pairs, *rest))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["class_id"] for r in near_duplicates.near_duplicate_classes(docs)[0].collect()}
    assert [got[i] for i in range(len(texts))] == brute.near_classes(range(len(texts)), texts, frequent=1 << 40)
    assert len(set(got.values())) > 1 and sum(seen) <= near_duplicates.BANDS * len(texts)


def test_shared_weights_of_a_group_are_those_of_its_pairs():
    rng = np.random.default_rng(3)
    bags = [rng.choice(400, 90, replace=False).astype(np.uint32) for _ in range(40)]
    df = rng.integers(2, 50, 400)
    both = near_duplicates.shared_weight([b.tobytes() for b in bags], np.concatenate([df[b] for b in bags]), 60)
    want = [[near_duplicates.idf(df[np.intersect1d(a, b)], 60).sum() for b in bags] for a in bags]
    assert np.allclose(both - np.diag(np.diag(both)), np.array(want) - np.diag(np.diag(want)), rtol=1e-5)
