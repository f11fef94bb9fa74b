"""Personal data: base patterns, and terms that would give a protected entity away.

Everything here is a DataFrame expression. The four base kinds are patterns with a check each;
their positions follow from the lengths of the pieces between the matches. Protected entities are the
values found and what recurs of them: an address's domain and the names in front of it, a host's
network, a card's issuer and a number's exchange. Terms are all words of the documents that hold an
entity, at any distance from it. Over the whole corpus

    disclosure(term, entity) = PMI(term; entity) / IC(entity)
                             = log(N n(term, entity) / (n(term) n(entity))) / log(N / n(entity))

with N different texts, n(x) of them with x, is 1 for a term that is met with the entity only and 0 for
one that is independent of it. Copies of a text count once in all four counts. Terms seen with a value in
``SUPPORT`` different texts, or with a part in ``PART_SUPPORT`` (parts are common enough for two texts to meet
by chance), and with a disclosure of ``LIMIT`` or more are spans of the kind ``term`` wherever they stand
in a document with that entity; other documents are left alone.

Base spans are worked out once and written. For n(term) every different text is shuffled once, by its hash;
its words are summed up per task, so the vocabulary is shuffled and not the words. Positions are worked out
for texts with a marked term only, one row per word, so time is linear in the text.

Defined cases: a null text is empty; overlapping spans are all listed, and are replaced as one;
repeated rows get equal results; an entity found in every document discloses nothing; terms of equal score are
all marked; texts of any length are searched whole; tables without personal data are returned as they are,
empty ones as well; further columns, whatever their names, are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from assayspark.llm.shared import fresh, materialize, query, table

KINDS = ["email", "ip", "card", "phone", "term"]
SUPPORT = 2
PART_SUPPORT = 3
LIMIT = 0.9

# A run of characters is only tried from its start (or from where the last match ended), and
# repetitions never give back what they took: the same matches in time linear in the text.
_LOCAL = "[A-Za-z0-9._%+-]"
PATTERNS = {
    "email": rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    # a whole run of digits with single separators, of 12 to 19 digits; shorter and longer runs fail anyway
    "card": r"(?<![0-9]|[0-9][ -])[0-9](?:[ -]?[0-9]){11,18}(?![ -]?[0-9])",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
_PART = "0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])"
WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SPAN = "struct<start:int,kind:int,end:int>"


def fold(text: Column) -> Column:
    return F.translate(text, _UPPER, _LOWER)


def _luhn(digits: Column) -> Column:
    """Whether a string of digits has a right check digit."""
    n = F.char_length(digits)

    def weight(i: Column) -> Column:
        d = F.substring(digits, n - i, F.lit(1)).cast("int")
        return F.when(i % 2 == 1, F.when(d > 4, 2 * d - 9).otherwise(2 * d)).otherwise(d)

    return F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0), lambda s, i: s + weight(i)) % 10 == 0


def _passes(kind: str, match: Column) -> Column:
    if kind == "ip":
        return match.rlike(rf"^(?:{_PART}\.){{3}}{_PART}$")
    digits = F.regexp_replace(match, "[^0-9]", "")
    if kind == "card":
        return _luhn(digits)
    if kind == "phone":
        return F.char_length(digits).between(9, 15)
    return F.lit(True)


def places(text: Column, pattern: str, passes, kind: int) -> Column:
    """Array of ``SPAN`` of the matches that pass, in code points."""
    none = F.array().cast(f"array<{SPAN}>")
    steps = F.arrays_zip(
        F.transform(F.split(text, pattern, -1), F.char_length).alias("gap"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("hit"),
    )

    def step(state: Column, x: Column) -> Column:
        start = state["at"] + x["gap"]
        end = start + F.coalesce(F.char_length(x["hit"]), F.lit(0))
        found = F.array(F.struct(start.alias("start"), F.lit(kind).alias("kind"), end.alias("end")))
        keep = x["hit"].isNotNull() & passes(x["hit"])
        return F.struct(end.alias("at"), F.when(keep, F.concat(state["out"], found)).otherwise(state["out"]).alias("out"))

    return F.aggregate(steps, F.struct(F.lit(0).alias("at"), none.alias("out")), step, lambda state: state["out"])


def base_spans(text: Column) -> Column:
    """All base spans by start, then kind; the patterns run only where a cheap test allows a match."""
    possible = {
        "email": F.contains(text, F.lit("@")), "ip": text.rlike(r"[0-9]\.[0-9]"),
        "card": text.rlike(r"[0-9](?:[ -]?[0-9]){11}"), "phone": F.contains(text, F.lit("+")),
    }
    none = F.array().cast(f"array<{SPAN}>")
    return F.array_sort(F.concat(*[
        F.when(possible[k], places(text, p, lambda m, k=k: _passes(k, m), KINDS.index(k))).otherwise(none) for k, p in PATTERNS.items()
    ]))


def joined(spans: Column) -> Column:
    name = lambda s: F.element_at(F.array(*map(F.lit, KINDS)), s["kind"] + 1)
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", name(s), s["start"], s["end"])), ",")


def blanked(text: Column, spans: Column) -> Column:
    """The text with blanks in place of every span, of the same length."""
    def step(state: Column, s: Column) -> Column:
        start = F.greatest(s["start"], state["at"])
        new = F.array(F.substring(text, state["at"] + 1, start - state["at"]), F.repeat(F.lit(" "), s["end"] - start))
        return F.when(s["end"] <= state["at"], state).otherwise(F.struct(s["end"].alias("at"), F.concat(state["out"], new).alias("out")))

    first = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))
    return F.aggregate(
        spans, first, step,
        lambda state: F.concat(F.array_join(state["out"], ""), F.substring(text, state["at"] + 1, F.char_length(text))))


def entities(text: Column, s: Column) -> Column:
    """Array of (entity, least): the value of a span and its recurring parts, with the texts a term must share with them."""
    value = fold(F.substring(text, s["start"] + 1, s["end"] - s["start"]))
    digits = F.regexp_replace(value, "[^0-9]", "")
    name = lambda kind, part, least: F.struct(F.xxhash64(F.lit(kind), part).alias("entity"), F.lit(least).alias("least"))
    local, domain = F.substring_index(value, "@", 1), F.substring_index(value, "@", -1)
    network = F.regexp_replace(value, r"\.[0-9]+$", "")
    names = F.transform(F.regexp_extract_all(local, F.lit("[a-z]{3,}"), F.lit(0)), lambda n: name("name", n, PART_SUPPORT))
    kind = lambda k: s["kind"] == KINDS.index(k)
    return (
        F.when(kind("email"), F.concat(F.array(name("email", value, SUPPORT), name("domain", domain, PART_SUPPORT)), names))
        .when(kind("ip"), F.array(name("ip", value, SUPPORT), name("network", network, PART_SUPPORT)))
        .when(kind("card"), F.array(name("card", digits, SUPPORT), name("issuer", F.substring(digits, 1, 6), PART_SUPPORT)))
        .otherwise(F.array(name("phone", digits, SUPPORT), name("exchange", F.substring(digits, F.lit(1), F.char_length(digits) - 7), PART_SUPPORT))))


def body_of(text: str) -> Column:
    """Hash of a text, null as empty; equal texts have the same."""
    return F.xxhash64(F.coalesce(F.col(text), F.lit("")))


def with_spans(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """(doc_id, key, body, spans, text) of all documents, written; the text only where there are spans."""
    t = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.xxhash64(doc_id, text).alias("key"), body_of(text).alias("body"), t.alias("text"))
    # a one-element generator keeps the optimiser from working the spans out again for every use
    rows = rows.select("*", F.explode(F.array(base_spans(F.col("text")))).alias("spans"))
    return materialize(rows.withColumn("text", F.when(F.size("spans") > 0, F.col("text"))), "spans")


def bodies_with_spans(found: DataFrame) -> DataFrame:
    """(body, text, spans), one row per different text with base spans."""
    return found.where(F.size("spans") > 0).select("body", "text", "spans").dropDuplicates(["body"])


def holders(texts: DataFrame) -> DataFrame:
    """(body, entity, least), once each."""
    every = F.flatten(F.transform("spans", lambda s: entities(F.col("text"), s)))
    return texts.select("body", F.explode(F.array_distinct(every)).alias("e")).select("body", "e.*")


def plain_of(texts: DataFrame) -> DataFrame:
    """(body, plain): the texts with blanks in place of base spans."""
    return texts.select("body", F.explode(F.array(blanked(F.col("text"), F.col("spans")))).alias("plain"))


def words_of(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(fold(text), F.lit(WORD), F.lit(0)))


def disclosing(held: DataFrame, terms: DataFrame, docs: DataFrame, text: str, n: int, limit: float = LIMIT) -> DataFrame:
    """(entity, term) over the limit; frequencies cover all different texts of ``docs``, ``n`` in number.

    ``held`` has (body, entity, least) and ``terms`` (body, term) of the texts with base spans, both written
    tables. A disclosure of ``limit`` means n(term) <= n(entity, term) (N / n(entity)) ^ (1 - limit).
    """
    by_entity = held.groupBy("entity", "least").agg(F.count("*").alias("n_entity")).where(F.col("n_entity") >= F.col("least"))
    by_term = terms.groupBy("term").agg(F.count("*").alias("n_held")).where(F.col("n_held") >= SUPPORT)
    most = lambda n_both: F.col(n_both) * F.pow(F.lit(float(n)) / F.col("n_entity"), F.lit(1 - limit)) * (1 + 1e-9)
    able = held.drop("least").join(by_entity, "entity").join(terms.join(by_term, "term"), "body").where(F.col("n_held") <= most("n_entity"))
    both = able.groupBy("entity", "term").agg(
        F.count("*").alias("n_both"), *[F.first(c).alias(c) for c in ("n_entity", "n_held", "least")])
    both = materialize(both.where((F.col("n_both") >= F.col("least")) & (F.col("n_held") <= most("n_both")) & (F.lit(float(n)) > F.col("n_entity"))), "both")

    # one row per different text, then one per word and task: the vocabulary is shuffled, not the words
    single = docs.select(body_of(text).alias("body"), F.coalesce(F.col(text), F.lit("")).alias("text")).dropDuplicates(["body"])
    df = single.select(F.explode(words_of(F.col("text"))).alias("term")).groupBy("term").agg(F.count("*").alias("n_term"))
    return both.join(df, "term").where(F.col("n_term") <= most("n_both")).select("entity", "term")


def term_places(plain: DataFrame, marks: DataFrame) -> DataFrame:
    """(body, more): places of the marked terms, (body, term), in their texts; a row per word and a running length."""
    wanted = marks.groupBy("body").agg(F.collect_set("term").alias("wanted"))
    pieces = F.arrays_zip(
        F.transform(F.split("plain", WORD, -1), F.char_length).alias("gap"), F.regexp_extract_all("plain", F.lit(WORD), F.lit(0)).alias("hit"))
    rows = plain.join(wanted, "body").select("body", "wanted", F.posexplode(pieces).alias("at", "piece"))
    rows = rows.where("piece.hit IS NOT NULL").select(
        "body", "at", "piece.gap", F.char_length("piece.hit").alias("size"), F.array_contains("wanted", fold(F.col("piece.hit"))).alias("marked"))
    end = F.sum(F.col("gap") + F.col("size")).over(W.partitionBy("body").orderBy("at").rowsBetween(W.unboundedPreceding, 0)).cast("int")
    hits = rows.withColumn("end", end).where("marked")
    span = F.struct((F.col("end") - F.col("size")).alias("start"), F.lit(KINDS.index("term")).alias("kind"), "end")
    return hits.groupBy("body").agg(F.sort_array(F.collect_list(span)).alias("more"))


def added_spans(found: DataFrame, docs: DataFrame, text: str = "text", limit: float = LIMIT) -> DataFrame:
    """(body, more): the term spans of the texts that have any. ``found`` is the table of ``with_spans``."""
    texts = materialize(bodies_with_spans(found), "texts")
    held = materialize(holders(texts), "held")
    plain = materialize(plain_of(texts), "plain")
    terms = materialize(plain.select("body", F.explode(words_of(F.col("plain"))).alias("term")), "words")
    told = materialize(disclosing(held, terms, docs, text, found.select("body").distinct().count(), limit), "told")
    marks = held.join(told, "entity").select("body", "term").distinct()
    marks = materialize(marks.join(terms, ["body", "term"], "left_semi"), "marks")
    return materialize(term_places(plain, marks), "more")


def _all_spans(base: str, more: str) -> Column:
    return F.when(F.col(more).isNull(), F.col(base)).otherwise(F.array_sort(F.concat(base, F.coalesce(more, F.array().cast(f"array<{SPAN}>")))))


def find_pii(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", limit: float = LIMIT) -> DataFrame:
    """One row per document: doc_id, key, base spans and all spans."""
    found = with_spans(docs, doc_id, text)
    more = added_spans(found, docs, text, limit)
    rows = found.select("doc_id", "key", "body", F.col("spans").alias("base"))
    clean = rows.where(F.size("base") == 0).select("doc_id", "key", "base", F.col("base").alias("spans"))
    dirty = rows.where(F.size("base") > 0).join(more, "body", "left").select("doc_id", "key", "base", _all_spans("base", "more").alias("spans"))
    return clean.unionByName(dirty)


def replaced(text: Column, spans: Column) -> Column:
    """The text with every span, or run of overlapping spans, replaced by the kind of its first."""
    tag = lambda s: F.concat(F.lit("["), F.upper(F.element_at(F.array(*map(F.lit, KINDS)), s["kind"] + 1)), F.lit("]"))

    def step(state: Column, s: Column) -> Column:
        new = F.array(F.substring(text, state["at"] + 1, s["start"] - state["at"]), tag(s))
        return F.struct(
            F.greatest(state["at"], s["end"]).alias("at"),
            F.when((s["start"] >= state["at"]), F.concat(state["out"], new)).otherwise(state["out"]).alias("out"))

    first = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))
    return F.aggregate(
        spans, first, step,
        lambda state: F.concat(F.array_join(state["out"], ""), F.substring(text, state["at"] + 1, F.char_length(text))))


def sanitise(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", length: str | None = "n_chars", limit: float = LIMIT) -> DataFrame:
    """The documents with their own columns; base values and disclosing terms give way to the name
    of their kind. Documents without personal data pass unchanged and unshuffled. A column
    ``length``, if the table has it, follows the new text."""
    found = with_spans(docs, doc_id, text)
    body, spans, extra = fresh(docs, "body"), fresh(docs, "spans"), fresh(docs, "more")
    more = added_spans(found, docs, text, limit).select(F.col("body").alias(body), F.col("more").alias(extra))
    marked = docs.select("*", F.explode(F.array(base_spans(F.coalesce(F.col(text), F.lit(""))))).alias(spans))
    clean = marked.where(F.size(spans) == 0).select(*docs.columns)
    dirty = marked.where(F.size(spans) > 0).withColumn(body, body_of(text)).join(more, body, "left")
    dirty = dirty.withColumn(spans, _all_spans(spans, extra)).withColumn(text, replaced(F.col(text), F.col(spans)))
    if length in docs.columns:
        dirty = dirty.withColumn(length, F.char_length(text).cast(docs.schema[length].dataType))
    return clean.unionByName(dirty.select(*docs.columns))


@query("op7_pii")
def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_pii(table(spark, sf_dir, "documents"))
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == KINDS.index(k))).cast("long").alias(f"n_{k}")
    return found.select(
        "doc_id", *[count(k) for k in PATTERNS], F.sha2(joined(F.col("base")).cast("binary"), 256).alias("base_sha256"),
        joined(F.col("spans")).alias("spans"))
