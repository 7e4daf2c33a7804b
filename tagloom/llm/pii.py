"""Information-theoretic sanitisation of personal data.

Protected entities are the e-mail addresses, IP addresses, card and telephone
numbers of the texts.  How much a term t tells of an entity e is estimated from
the whole corpus: PMI(t, e) = log2(n(t,e) * N / (n(t) * n(e))), at most the
information IC(e) = log2(N / n(e)) of the entity itself.  In a text that holds
e, a term with PMI >= disclose * IC(e), seen with e in at least ``support``
different texts, is generalised; from ``remove`` * IC(e) on it is removed.
Counts are rows over all documents.  All steps are column expressions.

Defined results: a null text is empty; a row's result depends on its text and
the corpus, so repeated rows get equal results; empty tables give empty results.
Matches that fail a kind's check are dropped and not tried again.  Extra columns
are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tagloom.llm import spans
from tagloom.llm.common import narrow, written
from tagloom.operators.joins import lookup

KINDS = ("email", "ip", "card", "phone")
# Fixed patterns.  The guards keep long runs from being tried at each of their characters:
# a run that fails at its start fails everywhere, and a match may begin where the last one ended.
EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?[0-9]){11,}+"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
BYTE = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
TERM = r"[\p{L}\p{N}]++"
NOT_TERM = r"[^\p{L}\p{N}]++"
TAGS = {"email": "[EMAIL]", "ip": "[IP]", "card": "[CARD]", "phone": "[PHONE]"}


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(value: Column) -> Column:
    """Whether the digits of a value pass the checksum."""
    digits = F.transform(F.split(F.reverse(_digits(value)), ""), lambda d: d.cast("int"))
    doubled = F.transform(
        digits, lambda d, i: F.when(i % 2 == 0, d).when(d > 4, d * 2 - 9).otherwise(d * 2)
    )
    return F.aggregate(doubled, F.lit(0), lambda a, d: a + F.coalesce(d, F.lit(0))) % 10 == 0


def find(text: Column) -> Column:
    """Ordered base spans of a text."""
    none = spans.nothing()
    email = F.when(F.contains(text, F.lit("@")), spans.matches(text, "email", 0, EMAIL)).otherwise(none)
    ip = F.filter(spans.matches(text, "ip", 1, IP), lambda x: x["value"].rlike(rf"^{BYTE}(?:\.{BYTE}){{3}}$"))
    size = lambda x: F.length(_digits(x["value"]))
    card = F.filter(spans.matches(text, "card", 2, CARD), lambda x: F.when(size(x) <= 19, luhn(x["value"])).otherwise(False))
    phone = F.when(F.contains(text, F.lit("+")), spans.matches(text, "phone", 3, PHONE)).otherwise(none)
    phone = F.filter(phone, lambda x: size(x).between(9, 15))
    return spans.ordered(F.concat(email, ip, card, phone))


def terms_of(text: Column, base: str) -> tuple[Column, str]:
    """The words of a text, and SQL that keeps those of the column ``terms`` outside the spans of ``base``, lower-case."""
    lower = "transform(terms, w -> struct(w.start AS start, w.end AS end, lower(w.value) AS value))"
    return spans.matches(text, "term", len(KINDS), TERM), f"get(transform(array({lower}), terms -> {spans.outside('terms', base)}), 0)"


def disclosures(held: DataFrame, corpus: DataFrame, disclose: float, remove: float, support: int) -> DataFrame:
    """(entity, revealing): per entity its revealing terms as (term, removed).

    ``held`` has key, entities and the terms of each text with entities, and
    copies of a text are counted before pairs are formed.
    """
    texts = held.groupBy("content", "entities", "words").agg(F.count(F.lit(1)).alias("m"))
    # Narrow rows decide which entities have support; words never meet an exchange by entity.
    single = texts.select("content", "m", F.explode("entities").alias("entity"))
    supported = written(
        single.groupBy("entity").agg(F.sum("m").alias("n_e"), F.count(F.lit(1)).alias("texts"))
        .filter(F.col("texts") >= support).select("entity", "n_e"), "supported",
    )
    own = lookup(single.select("content", "entity"), supported.select("entity"), "entity", "inner")
    own = own.groupBy("content").agg(F.collect_set("entity").alias("own"))
    pairs = (
        texts.select("content", "words", "m").join(own, "content")
        .select("m", "words", F.explode("own").alias("entity")).select("entity", "m", F.explode("words").alias("term"))
        .groupBy("entity", "term").agg(F.sum("m").alias("n_te"), F.count(F.lit(1)).alias("texts"))
        .filter(F.col("texts") >= support)
    )
    words = F.array_distinct(F.split(F.lower("text"), NOT_TERM))
    frequency = corpus.select(F.explode(words).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("n_t"))
    total = corpus.agg(F.count(F.lit(1)).alias("n"))
    # One row on the right side: its size is fixed.
    rated = lookup(lookup(pairs, supported, "entity", "inner"), frequency, "term", "inner").join(F.broadcast(total), how="inner")
    pmi = F.log2(F.col("n_te") * F.col("n") / (F.col("n_t") * F.col("n_e")))
    information = F.log2(F.col("n") / F.col("n_e"))
    rated = rated.withColumn("pmi", pmi).withColumn("ic", information)
    telling = rated.filter((F.col("ic") > 0) & (F.col("pmi") >= disclose * F.col("ic")))
    removed = F.col("pmi") >= remove * F.col("ic")
    return telling.groupBy("entity").agg(
        F.map_from_entries(F.collect_list(F.struct("term", removed.alias("removed")))).alias("revealing")
    )


def sanitised(text: str, found: str) -> str:
    """SQL: the text with its ordered spans replaced, base spans by their tag, terms by ``[TERM]`` or nothing.

    Spans are taken in runs of 256 with their own stretch of the text: cutting a piece out of
    a text, and appending to one, takes time by its length.
    """
    tags = " ".join(f"WHEN '{kind}' THEN '{tag}'" for kind, tag in TAGS.items())
    tag = f"CASE f.kind {tags} ELSE CASE WHEN startswith(f.value, '-') THEN '' ELSE '[TERM]' END END"
    runs = f"transform(sequence(0, cast((size({found}) - 1) div 256 AS int)), i -> slice({found}, i * 256 + 1, 256))"
    length = "cast(greatest(array_max(transform(r, f -> f.end)) - s.at, 0L) AS int)"
    run = f"""aggregate(r, struct(s.at AS at, '' AS out), (a, f) -> CASE WHEN f.end <= a.at THEN a ELSE struct(f.end AS at,
        concat(a.out, substring(p, cast(a.at - s.at + 1 AS int), cast(greatest(f.start - a.at, 0L) AS int)), {tag}) AS out) END)"""
    bound = f"get(transform(array(substring({text}, cast(s.at + 1 AS int), {length})), p -> {run}), 0)"
    return f"""CASE WHEN size({found}) = 0 THEN {text} ELSE aggregate({runs},
        struct(0L AS at, cast(array() AS array<string>) AS outs),
        (s, r) -> get(transform(array({bound}), x -> struct(x.at AS at, concat(s.outs, array(x.out)) AS outs)), 0),
        s -> concat(array_join(s.outs, ''), substring({text}, cast(s.at + 1 AS int)))) END"""


def find_personal_data(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
    disclose: float = 0.8, remove: float = 0.99, support: int = 3,
) -> DataFrame:
    """One row per document: doc_id, base, found, clean.

    ``base`` are the spans of the four kinds, ``found`` also those of kind
    ``term``; ``clean`` is the sanitised text where anything was found, else
    null: texts without personal data stay as they are and are not moved.
    Only texts with entities are kept aside, written once with their words.
    """
    rows = narrow(docs, doc_id=id_col, text=text_col).withColumn("text", F.coalesce("text", F.lit("")))
    base = rows.select("doc_id", "text", find(F.col("text")).alias("base"))
    has = F.size("base") > 0
    entity = F.transform("base", lambda b: F.concat(b["kind"], F.lit(":"), F.lower(b["value"])))
    kept = base.select("doc_id", "base", F.when(has, F.col("text")).alias("text"), F.when(has, F.array_sort(F.array_distinct(entity))).alias("entities"))
    # Words are found once, where the texts are read, and stored with the few texts that need them.
    words, outside = terms_of(F.col("text"), "base")
    kept = kept.withColumn("terms", F.when(F.col("text").isNotNull(), words))
    table = written(kept.withColumn("terms", F.when(F.col("text").isNotNull(), F.expr(outside))), "personal")
    content = F.xxhash64("text")
    held = table.filter(has).select("doc_id", "base", "text", "entities", "terms", content.alias("content"))
    word = F.array_distinct(F.transform("terms", lambda w: w["value"]))
    revealing = written(
        disclosures(held.select("content", "entities", word.alias("words")), rows, disclose, remove, support), "revealing"
    )
    # Rows with equal text share entities: the choice is made once per content.
    each = held.select("content", "entities").dropDuplicates(["content"]).select("content", F.explode("entities").alias("entity"))
    told = lookup(each, revealing, "entity", "inner").groupBy("content")
    told = told.agg(F.flatten(F.collect_list(F.map_entries("revealing"))).alias("telling"))
    joined = lookup(held, told, "content")
    added = F.when(F.col("telling").isNotNull(), F.expr(spans.named("terms", "telling", "term", len(KINDS)))).otherwise(spans.nothing())
    full = joined.withColumn("found", spans.ordered(F.concat("base", added)))
    full = full.select("doc_id", "base", "found", F.expr(sanitised("text", "found")).alias("clean"))
    plain = table.filter(~has).select("doc_id", "base", F.col("base").alias("found"), F.lit(None).cast("string").alias("clean"))
    return plain.unionByName(full)
