"""Personal data: pattern spans, and information-theoretic sanitisation around them.

Base spans are found by regular expressions in the JVM.  Split and extract give
the gaps and the matches of a text, and their running lengths give places in
code points.  The patterns are written so that a run of characters is tried
once: an attempt starts at the beginning of a run or where the last match
ended, and quantifiers give nothing back.

The method adds terms (runs of letters, in lower case) that disclose a protected
entity: what a base span names, from the value itself to what it has in common with
others, since a value seldom comes back and its provider, network or owner does.
Entities are each span's value, the domain of a mail address and the words of its
mailbox, the first three numbers of an ip address, the issuer digits of a card, the
country and area digits of a phone number, and the kind of data.  A term counts that
stands in at least SUPPORT of the documents with the entity, with
strength = PMI(term, entity) / IC(entity)
         = log(n(t,e) N / (n(t) n(e))) / log(N / n(e)),
which is 1 when the term occurs only with the entity.  n counts documents of
the whole corpus, wherever in them the term stands.  From REMOVE on, the term is
removed; from GENERALISE on, replaced by a general word; either way everywhere in
the documents with that entity, so documents without personal data stay as
they are.

Plan: one pass finds base spans (row-local) and writes them; rows with spans,
few, are reduced to one a (id, text) with its number of copies.  Entities in
SUPPORT documents or more meet each term of their documents, counted with partial
sums before the shuffle and written nowhere.  Terms that reach SUPPORT are counted
over all texts, combined before the shuffle.  Decisions return to rows by term,
then by entity; terms of more than 1/1000 of the rows joined are broadcast, all
others shuffled.  Places of terms are running sums over a document's runs of
letters and others, for documents with a decision only.
DataFrame expressions only.

Defined results: null text counts as empty and has no spans; spans that overlap
across kinds are all reported, and in rewriting an overlapping run becomes the
mark of its first span; terms inside base spans are left to them; rows repeated
with one id are each handled, by id and text, and count as documents of their
own, as do rows without an id; an empty table gives an empty result; extra
columns are not read (sanitise returns them as they are); of a very long text
one task holds the spans and runs, and a document with e entities that others share
and t terms makes e t rows on the way.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewater.llm.common import discard, fresh, id_text, lookup, materialise, table

SUPPORT = 3
REMOVE = 0.98
GENERALISE = 0.9
KINDS = ("email", "ip", "card", "phone")
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[ -]?+[0-9])++",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
OCTET = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
ISSUER, AREA, MAILBOX = 6, 5, 3  # digits of a card and a phone number, letters of a word of a mailbox at least
MARKS = {"email": "[EMAIL]", "ip": "[IP]", "card": "[CARD]", "phone": "[PHONE]", "remove": "", "generalise": "[TERM]"}
SPAN = "struct<start:int,rank:int,end:int,kind:string,value:string>"
NONE = f"array<{SPAN}>"


CHUNK = 256


def _let(value: Column, then) -> Column:
    """then(value), with value computed once."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def find(text: Column, pattern: str, kind: str, rank: int) -> Column:
    """array<span> of the leftmost non-overlapping matches."""
    gaps = F.split(text, pattern, -1)
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    zero = F.struct(F.lit(0).alias("at"), F.lit([]).cast(NONE).alias("out"))

    def span(start: Column, end: Column, value: Column) -> Column:
        return F.struct(start.alias("start"), F.lit(rank).alias("rank"), end.alias("end"), F.lit(kind).alias("kind"), value.alias("value"))

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + F.length(x["gap"])
        end = start + F.length(x["value"])
        return F.struct(end.alias("at"), F.concat(acc["out"], F.array(span(start, end, x["value"]))).alias("out"))

    # running lengths within chunks and over chunks, as an accumulator is copied at every step
    def chunks(pairs: Column) -> Column:
        numbers = F.sequence(F.lit(0), F.greatest(F.ceil(F.size(pairs) / CHUNK).cast("int") - 1, F.lit(0)))
        return F.transform(numbers, lambda c: F.aggregate(F.slice(pairs, c * CHUNK + 1, F.lit(CHUNK)), zero, step))

    def joined(parts: Column) -> Column:
        none = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out"))
        offsets = F.aggregate(parts, none, lambda acc, x: F.struct((acc["at"] + x["at"]).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out")), lambda acc: acc["out"])
        return F.flatten(F.zip_with(parts, offsets, lambda x, o: F.transform(x["out"], lambda s: span(s["start"] + o, s["end"] + o, s["value"]))))

    pairs = F.filter(F.arrays_zip(gaps.alias("gap"), found.alias("value")), lambda x: x["value"].isNotNull())
    return _let(_let(pairs, chunks), joined)


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    turned = F.split(F.reverse(digits), "")
    values = F.transform(F.filter(turned, lambda d: d != ""), lambda d, i: F.when(i % 2 == 0, d.cast("int")).otherwise(F.when(d.cast("int") > 4, d.cast("int") * 2 - 9).otherwise(d.cast("int") * 2)))
    return F.aggregate(values, F.lit(0), lambda a, d: a + d) % 10 == 0


def base_spans(text: Column) -> Column:
    """array<span>, sorted by start and then by kind as listed."""
    none = F.lit([]).cast(NONE)
    email = F.when(F.contains(text, F.lit("@")), find(text, PATTERNS["email"], "email", 0)).otherwise(none)
    number = F.regexp_like(text, F.lit("[0-9]"))
    ip = F.filter(find(text, PATTERNS["ip"], "ip", 1), lambda s: F.regexp_like(s["value"], F.lit(rf"^{OCTET}(?:\.{OCTET}){{3}}$")))
    card = F.filter(find(text, PATTERNS["card"], "card", 2), lambda s: F.length(_digits(s["value"])).between(14, 19) & _luhn(_digits(s["value"])))
    phone = F.filter(find(text, PATTERNS["phone"], "phone", 3), lambda s: F.length(_digits(s["value"])).between(10, 15))
    some = F.when(number & F.regexp_like(text, F.lit(r"[0-9]\.[0-9]")), ip).otherwise(none)
    cards = F.when(number & F.regexp_like(text, F.lit(r"[0-9](?:[ -]?+[0-9]){13}")), card).otherwise(none)
    phones = F.when(number & F.contains(text, F.lit("+")), phone).otherwise(none)
    return F.array_sort(F.concat(email, some, cards, phones))


def _row(doc_id: Column, text: Column) -> Column:
    """Tells rows apart even where they share an id."""
    return F.concat_ws(":", doc_id.cast("string"), F.hex(F.xxhash64(text)))


def _terms(text: Column) -> Column:
    """The distinct runs of letters, each put in lower case by itself."""
    return F.array_remove(F.array_distinct(F.split(F.lower(F.regexp_replace(text, r"[^\p{L}]+", "\n")), "\n")), "")


def term_frequencies(texts: DataFrame, terms: DataFrame) -> DataFrame:
    """term, n: documents of all texts with each of the terms (a table)."""
    words = texts.select(F.explode(_terms(F.col("text"))).alias("term"))
    # words are counted before the join, so it never has more rows than there are words; an inner join
    # (terms are distinct) because the optimizer would move a semi join below the count
    return words.groupBy("term").agg(F.count(F.lit(1)).alias("n")).join(terms, "term")


def entities(span: Column) -> Column:
    """What a base span names: its value, and what values of its kind have in common (array<string>)."""
    value, kind, digits = span["value"], span["kind"], _digits(span["value"])
    words = F.filter(F.split(F.lower(F.substring_index(value, "@", 1)), "[^a-z]+"), lambda w: F.length(w) >= MAILBOX)
    wider = (
        F.when(kind == "email", F.concat(F.array(F.concat(F.lit("domain "), F.lower(F.substring_index(value, "@", -1)))), F.transform(words, lambda w: F.concat(F.lit("mailbox "), w))))
        .when(kind == "ip", F.array(F.concat(F.lit("network "), F.substring_index(value, ".", 3))))
        .when(kind == "card", F.array(F.concat(F.lit("issuer "), F.substring(digits, 1, ISSUER))))
        .otherwise(F.array(F.concat(F.lit("area "), F.substring(digits, 1, AREA))))
    )
    return F.concat(F.array(F.concat(F.lit("kind "), kind), F.concat(F.lit("value "), value)), wider)


def disclosures(texts: DataFrame, here: DataFrame, total: int) -> DataFrame:
    """entity, term, weight (rows of here), kind (remove or generalise) for the pairs above the thresholds.

    here: row, copies, entity, of_entity, term.
    """
    seen = here.groupBy("entity", "term").agg(F.sum("copies").alias("seen"), F.count(F.lit(1)).alias("weight"), F.max("of_entity").alias("of_entity"))
    seen = materialise(seen.filter(F.col("seen") >= SUPPORT), "pii-pairs")
    wanted = materialise(seen.select("term").distinct(), "pii-wanted")
    terms = materialise(term_frequencies(texts, wanted), "pii-terms")
    ic = F.log(F.lit(float(total)) / F.col("of_entity"))
    pmi = F.log(F.col("seen") * F.lit(float(total)) / (F.col("n").cast("double") * F.col("of_entity")))
    strength = F.when(ic > 0, pmi / ic).otherwise(F.lit(0.0))
    pairs = seen.groupBy("term").agg(F.count(F.lit(1)).alias("entities"))
    counted = materialise(terms.join(pairs, "term"), "pii-counted")
    scored = lookup(seen, counted, "term", "entities", seen.count(), "inner").withColumn("strength", strength).filter(F.col("strength") >= GENERALISE)
    told = materialise(scored.select("entity", "term", "weight", F.when(F.col("strength") >= REMOVE, F.lit("remove")).otherwise(F.lit("generalise")).alias("kind")), "pii-told")
    discard(seen, wanted, terms, counted)
    return told


def disclosing_terms(some: DataFrame, texts: DataFrame, total: int) -> DataFrame:
    """row, copies, terms (array<span>) of the rows with disclosing terms.

    some: row, text, spans of the documents with base spans; texts: text of all
    documents, total of them.
    """
    some = materialise(some.groupBy("row").agg(F.first("text").alias("text"), F.first("spans").alias("spans"), F.count(F.lit(1)).alias("copies")), "pii-some")
    held = materialise(some.select("row", "copies", F.explode(F.array_distinct(F.flatten(F.transform("spans", entities)))).alias("entity")), "pii-held")
    often = held.groupBy("entity").agg(F.sum("copies").alias("of_entity"), F.count(F.lit(1)).alias("rows")).filter(F.col("of_entity") >= SUPPORT)
    known = materialise(often, "pii-entities")
    often = lookup(held, known, "entity", "rows", held.count(), "inner").select("row", "entity", "of_entity")
    often = materialise(often, "pii-often")
    words = some.join(often.select("row").distinct(), "row").select("row", "copies", F.explode(_terms(F.col("text"))).alias("term"))
    words = materialise(words, "pii-words")
    # the pairs of a document exist on the way to their sums only
    told = disclosures(texts, words.join(often, "row"), total)
    by_term = told.groupBy("term").agg(F.collect_list(F.struct("entity", "kind")).alias("told"), F.max("weight").alias("weight"))  # entities that the term discloses
    by_term = materialise(by_term, "pii-by-term")
    hits = lookup(words.select("row", "term"), by_term, "term", "weight", words.count(), "inner").select("row", "term", F.explode("told").alias("t"))
    decided = hits.select("row", "term", "t.entity", "t.kind").join(often.select("row", "entity"), ["row", "entity"])
    decided = materialise(decided.groupBy("row", "term").agg(F.max("kind").alias("kind")), "pii-decided")  # removal wins
    rows = some.join(decided.select("row").distinct(), "row")
    cut = r"(?<=\p{L})(?!\p{L})|(?<!\p{L})(?=\p{L})"
    runs = rows.select("row", "copies", "spans", F.posexplode(F.split("text", cut, -1)).alias("at", "run"))
    end = F.sum(F.length("run")).over(Window.partitionBy("row").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)).cast("int")
    runs = runs.select("row", "copies", "spans", F.lower("run").alias("term"), (end - F.length("run")).alias("start"), end.alias("end"))
    outside = ~F.exists("spans", lambda s: (F.col("start") < s["end"]) & (s["start"] < F.col("end")))
    found = runs.join(decided, ["row", "term"]).filter(outside)
    span = F.struct("start", F.lit(4).alias("rank"), "end", "kind", F.col("term").alias("value"))
    terms = materialise(found.groupBy("row").agg(F.max("copies").alias("copies"), F.array_sort(F.collect_list(span)).alias("terms")), "pii-spans")
    discard(held, often, words, told, by_term, decided, some)
    return terms


def find_personal(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, row (of id and text), base array<span>, terms array<span>; one row per input row."""
    texts = id_text(docs, id_col, text_col)
    found = texts.select("doc_id", _row(F.col("doc_id"), F.col("text")).alias("row"), base_spans(F.col("text")).alias("spans"), "text")
    rows = materialise(found.withColumn("text", F.when(F.size("spans") > 0, F.col("text"))), "pii-rows")
    some = rows.filter(F.size("spans") > 0)
    terms = disclosing_terms(some, texts.select("text"), rows.count())
    told = lookup(some.drop("text"), terms, "row", "copies", some.count())
    none = rows.filter(F.size("spans") <= 0).select("doc_id", "row", "spans", F.lit(None).cast(NONE).alias("terms"))
    told = told.select("doc_id", "row", "spans", "terms").unionByName(none)
    return told.select("doc_id", "row", F.col("spans").alias("base"), F.coalesce("terms", F.lit([]).cast(NONE)).alias("terms"))


def rewrite(text: Column, spans: Column) -> Column:
    """The text with each run of overlapping spans replaced by the mark of its first."""
    mark = F.create_map(*(F.lit(x) for kv in MARKS.items() for x in kv))
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))

    def step(acc: Column, s: Column) -> Column:
        more = F.array(F.substring(text, acc["at"] + 1, s["start"] - acc["at"]), F.try_element_at(mark, s["kind"]))
        longer = F.struct(F.greatest(acc["at"], s["end"]).alias("at"), acc["out"].alias("out"))
        return F.when(s["start"] < acc["at"], longer).otherwise(F.struct(s["end"].alias("at"), F.concat(acc["out"], more).alias("out")))

    return F.when(F.size(spans) == 0, text).otherwise(F.aggregate(spans, zero, step, lambda acc: F.concat(F.array_join(acc["out"], ""), F.substring(text, acc["at"] + 1, F.length(text)))))


def sanitise(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The input rows, all columns, with personal data and disclosing terms replaced in the text.

    Texts without base spans stay where they are; only the others are shuffled.
    """
    row, spans, copies, terms = (fresh(docs, f"pii_{k}") for k in ("row", "spans", "copies", "terms"))
    text = F.coalesce(F.col(text_col), F.lit(""))
    marked = materialise(docs.select("*", base_spans(text).alias(spans)), "pii-marked")
    clean = marked.filter(F.size(spans) <= 0).select(*docs.columns)
    some = marked.filter(F.size(spans) > 0).withColumn(row, _row(F.col(id_col).cast("long"), text))
    found = disclosing_terms(some.select(F.col(row).alias("row"), text.alias("text"), F.col(spans).alias("spans")), marked.select(text.alias("text")), marked.count())
    found = found.select(F.col("row").alias(row), F.col("copies").alias(copies), F.col("terms").alias(terms))
    told = lookup(some, found, row, copies, some.count())
    every = F.array_sort(F.concat(spans, F.coalesce(terms, F.lit([]).cast(NONE))))
    told = told.withColumn(spans, every)
    return told.withColumn(text_col, rewrite(F.col(text_col), F.col(spans))).select(*docs.columns).unionByName(clean)


def _listed(spans: Column) -> Column:
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))))


def _count(kind: str) -> Column:
    return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")


def op5_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_personal(table(spark, sf_dir, "documents"))
    return found.select("doc_id", *(_count(k) for k in KINDS), F.sha2(_listed(F.col("base")), 256).alias("base_sha256"), _listed(F.array_sort(F.concat("base", "terms"))).alias("spans"))
