import pyarrow as pa
import pyarrow.parquet as pq
import pytest

LONG = ("Weit weg wohnt ein Wort. " * 9000) + "end"
DOCS = [
    (1, "The quick brown fox jumps over the lazy dog while the small cat sleeps near the warm fire tonight.", "en", "a"),
    (2, "The quick brown fox jumps over the lazy dog while the small cat sleeps near the warm fire tonight.", "en", "a"),
    (2, "The quick brown fox jumps over the lazy dog while the small cat sleeps near the warm fire tonight.", "en", "a"),
    (3, "the QUICK brown fox jumps over the lazy dog, while the small cat sleeps near the warm fire tonight!", "en", None),
    (4, None, "en", "b"),
    (5, "", None, "b"),
    (6, "  \n\t ", "fr", "b"),
    (7, LONG, "de", "a"),
    (8, "Write to ann.lee@mail.example.com or +1 (212) 555-0188, host 10.0.0.255 not 10.0.0.256, card 4111 1111 1111 1111 ok.", "en", "c"),
    (9, "Ann of Zorblax wrote: mail zz.top@mail.example.org from Zorblax castle today.", "en", "c"),
    (10, "Bob says: mail zz.top@mail.example.org from Zorblax castle again.", "en", "c"),
    (None, "A row without an id but with enough words to be kept by the rules of the house.", None, None),
    (11, "one two three", "en", "c"),
    (12, "same line here\nsame line here\nsame line here\nother", "en", "c"),
    (13, "### $$$ *** &&& %%% ||| <<< >>> ### $$$ *** &&&", "xx", "c"),
    (14, "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi", "en", "a"),
    (15, "intro alpha beta gamma delta epsilon zeta eta theta iota kappa outro", "en", "a"),
    (16, "it's <|endoftext|> they're ''s 's\n'tis we'll  x's'd    ΑΣ Ünï İ \r\n end ", "en", "a"),
    (17, "日本語の文章 です。 123 4567 ٣٤ ½ ok", "ja", "a"),
    (18, "a@b.c.d..e@f-g.h.. 1.2.3.4.5.6.7.8 +1-2 +12345678901234567 12-3456-7890-1234-5678-9", "en", "a"),
    (19, "0000 0000 0000 0000 " * 30 + "9" * 4000, "en", "a"),
]
ITEMS = [
    (1, "Alpha beta, gamma delta epsilon zeta eta theta iota kappa LAMBDA!"), (2, "one TWO three"), (3, None), (4, ""), (5, "..."),
    (6, "alpha beta gamma delta epsilon zeta eta theta iota kappa"), (7, "quick brown"), (None, "small cat"),
]
PAGES = [
    (1, "https://Good.example.net/en/x?q=1#f", "<html><body><nav><a href='/x'>menu</a></nav><article><h1>Title &amp; more</h1><p>First&nbsp;para <b>bold</b>.<p>Second<br>line</article><footer>foot</footer></body></html>"),
    (2, "http://evil.net/a", "<html><head><link href='https://alias.example.com/x' rel=canonical></head><body><article><p>Text of the page.</p></article></body></html>"),
    (3, "https://alias.example.com/x", "<article><p>Alias text here.</p></article>"),
    (4, "https://third.example.com/y", "<meta http-equiv='refresh' content='0; url=https://alias.example.com/x'><main><p>Main words.</p></main>"),
    (5, None, None), (6, "no scheme", ""), (7, "ftp://x.org", "plain words only"), (8, "http://a.org/fr/z", "<p>unclosed <i>tags"),
    (9, "http://mixed.example.com/m", "<link rel='canonical' href='https://Good.example.net/en/x?q=1'>"),
    (10, "http://evil.net/b", "<link rel='canonical' href='https://Good.example.net/en/x?q=1'>"),
    (11, "http://EXAMPLE.com/de/1", "<script>if (a<b) x();</script><article>only</article>"),
]


def write(folder, name, columns, rows, types):
    arrays = [pa.array([r[i] for r in rows], t) for i, t in enumerate(types)]
    pq.write_table(pa.table(dict(zip(columns, arrays, strict=True))), f"{folder}/{name}.parquet")


def tables(folder, docs, items, pages):
    """All tables of the corpus, with further columns whose names the operators use themselves."""
    extra = ["key", "n_words", "kept", "score", "h", "class", "spans", "n_tokens", "lang_pred", "main_text", "host", "bands", "piece"]
    rows = [(*d, len(d[1] or ""), *[f"x{i}" for i in range(len(extra))]) for d in docs]
    s, n = pa.string(), pa.int64()
    write(folder, "documents", ["doc_id", "text", "lang", "source", "n_chars", *extra], rows, [n, s, s, s, n, *[s] * len(extra)])
    write(folder, "benchmark", ["item_id", "text", "key", "mark"], [(*i, "x", "y") for i in items], [n, s, s, s])
    write(folder, "pages", ["page_id", "url", "html", "text", "host", "verdict"], [(*p, "x", "y", "z") for p in pages], [n, s, s, s, s, s])
    labels = [(d[0], (d[0] or 0) % 3 != 0, 0) for d in docs]
    write(folder, "labels", ["doc_id", "quality", "toxic"], [(a, int(b), c) for a, b, c in labels], [n, pa.int32(), pa.int32()])


@pytest.fixture(scope="session")
def edge(tmp_path_factory):
    folder = tmp_path_factory.mktemp("edge")
    tables(folder, DOCS, ITEMS, PAGES)
    return str(folder)


@pytest.fixture(scope="session")
def empty(tmp_path_factory):
    folder = tmp_path_factory.mktemp("empty")
    tables(folder, [], [], [])
    return str(folder)
