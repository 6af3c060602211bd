"""Personal data: fixed patterns, and terms that disclose them by what the corpus says, in DataFrame operations only.

Base spans are e-mail addresses, IP addresses, payment cards and phone numbers. They are the protected entities, and so
is what many of them share (``SHARED``: an e-mail's domain, the first numbers of the others), as most data are in one document
only and their terms can only be weighed together. Terms are words of two characters or more outside the base spans. They are
weighed by corpus co-occurrence: with n(e), n(t) and n(e, t) the documents that hold the entity, the term and both, of N in
all, the term reveals the share log(N n(e, t) / (n(e) n(t))) / log(N / n(e)) of the entity's information. Terms that are in
``SUPPORT`` documents or more with an entity and reveal ``DISCLOSURE`` of it or more are spans of kind ``term`` in each place
of every text, also where the entity is not written. Counts are over all documents.

Patterns are read without backtracking into a run (possessive repeats, begun only where a run begins), and positions are
added up in chunks of ``CHUNK`` spans, so that long texts and texts of very many spans take about linear time. Terms are
read from the text with its base spans blanked out by as many line feeds. Positions are code points, end exclusive.
Defined cases: null text is empty; a text without spans gives empty strings; overlapping kinds are all reported; repeated
rows are documents of their own; an empty table gives an empty result; extra columns are ignored by ``find`` and kept by
``sanitise``, which removes all that overlapping spans cover and puts the name of the first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rowloom.llm import buckets, store

KINDS = ("email", "ip", "card", "phone")
LOCAL = "[A-Za-z0-9._%+-]"
#: A match begins where the last one ended or where a run begins.
PATTERNS = {
    "email": rf"(?:\G|(?<!{LOCAL})){LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
SUPPORT, DISCLOSURE = 3, 0.9
#: Spans that are gone through together, as an array that grows is copied at each step.
CHUNK = 64
#: Terms of all rows that are broadcast at most.
BROADCAST_TERMS = 1_000_000
#: What entities have in common, by kind: first group of the pattern in the lower-cased text.
SHARED = {"email": "(@.*)$", "ip": r"^(.*\.)[^.]*$", "card": "^((?:[^0-9]*[0-9]){6})", "phone": r"^(\+(?:[^0-9]*[0-9]){6})"}
TERM = r"[\p{L}\p{N}_]++(?:['\u2019-][\p{L}\p{N}_]++)*+"


def _valid(kind: str, m: str) -> str:
    if kind == "ip":
        return rf"{m} rlike '^(?:0*(?:25[0-5]|2[0-4][0-9]|[01]?[0-9]?[0-9])(?:\\.|$)){{4}}$'"
    if kind == "card":
        digits = f"regexp_replace({m}, '[^0-9]', '')"
        return f"length({digits}) between 12 and 19 and luhn_check({digits})"
    if kind == "phone":
        return f"length(regexp_replace({m}, '[^0-9]', '')) between 9 and 15"
    return "true"


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once."""
    return F.transform(F.array(value), body)[0]


def _chunks(z: Column) -> Column:
    return F.sequence(F.lit(0), F.floor(F.size(z) / CHUNK).cast("int"))


def _chunk(z: Column, c: Column) -> Column:
    return F.slice(z, c * CHUNK + 1, F.lit(CHUNK))


def _before(z: Column, of) -> Column:
    """What the aggregate ``of`` (state, chunk) has come to before each chunk of z, and at the end."""
    step = lambda acc, c: F.struct(of(acc["at"], _chunk(z, c)).alias("at"), F.array_append(acc["out"], acc["at"]).alias("out"))
    start = F.struct(F.lit(0).alias("at"), F.expr("cast(array() as array<int>)").alias("out"))
    return F.aggregate(_chunks(z), start, step, lambda acc: F.array_append(acc["out"], acc["at"]))


def placed(text: Column, pattern: str) -> Column:
    """array<struct<start, end, text>> of a pattern's matches, leftmost and non-overlapping.

    The text's pieces between matches (split) and the matches themselves alternate, so their lengths give the positions.
    """
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.transform(F.split(text, pattern, -1), F.length)
    empty = F.expr("cast(array() as array<struct<start: int, end: int, text: string>>)")
    length = lambda part: F.aggregate(part, F.lit(0), lambda n, x: n + x["gap"] + F.length(x["m"]))

    def one(acc: Column, x: Column) -> Column:
        start = acc["at"] + x["gap"]
        end = start + F.length(x["m"])
        return F.struct(end.alias("at"), F.array_append(acc["out"], F.struct(start.alias("start"), end.alias("end"), x["m"].alias("text"))).alias("out"))

    def every(z: Column) -> Column:
        part = lambda at: lambda c: F.aggregate(_chunk(z, c), F.struct(at[c].alias("at"), empty.alias("out")), one, lambda acc: acc["out"])
        return _let(_before(z, lambda at, x: at + length(x)), lambda at: F.flatten(F.transform(_chunks(z), part(at))))

    zipped = lambda m: F.arrays_zip(m.alias("m"), F.slice(gaps, F.lit(1), F.size(m)).alias("gap"))
    return _let(found, lambda m: F.when(F.size(m) == 0, empty).otherwise(_let(zipped(m), every)))


def cut_out(text: Column, spans: Column, put) -> Column:
    """``text`` with each of ``spans`` (start, end, ...; in order) taken out; ``put`` (span, first position not yet taken out)
    stands there instead. A span that begins inside another puts something for what is left of it."""
    none = F.expr("cast(array() as array<string>)")
    last = lambda at, part: F.aggregate(part, at, lambda n, x: F.greatest(n, x["end"]))

    def one(region: Column, base: Column):
        def step(acc: Column, x: Column) -> Column:
            piece = F.substring(region, acc["at"] - base + 1, F.greatest(x["start"] - acc["at"], F.lit(0)))
            out = F.array_append(acc["out"], F.concat(piece, put(x, F.greatest(acc["at"], x["start"]))))
            return F.struct(F.greatest(acc["at"], x["end"]).alias("at"), out.alias("out"))

        return step

    def every(z: Column) -> Column:
        def parts(at: Column) -> Column:
            part = lambda c: _let(
                F.substring(text, at[c] + 1, at[c + 1] - at[c]),
                lambda region: F.aggregate(_chunk(z, c), F.struct(at[c].alias("at"), none.alias("out")), one(region, at[c]), lambda acc: acc["out"]),
            )
            rest = F.substring(text, F.element_at(at, -1) + 1, F.length(text))
            return F.array_join(F.array_append(F.flatten(F.transform(_chunks(z), part)), rest), "")

        return _let(_before(z, last), parts)

    return F.when(F.size(spans) == 0, text).otherwise(_let(spans, every))


def base_spans(docs: DataFrame) -> DataFrame:
    """(doc_id, text, base): base is the array of (start, kind no., kind, end, text), sorted."""
    d = store.columns(docs, "doc_id", "text").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    for k in KINDS:
        d = d.withColumn(k, placed(F.col("text"), PATTERNS[k]))
    parts = [
        F.expr(f"transform(filter({k}, x -> {_valid(k, 'x.text')}), x -> struct(x.start as start, {i} as no, '{k}' as kind, x.end as end, x.text as text))")
        for i, k in enumerate(KINDS)
    ]
    return d.select("doc_id", "text", F.array_sort(F.concat(*parts)).alias("base"))


def _entities() -> Column:
    """array<string>: the entities of a row's base spans, and what they share."""
    own = "transform(base, s -> concat(s.kind, ':', lower(s.text)))"
    esc = lambda p: p.replace("\\", "\\\\")
    cases = " ".join(f"when '{k}' then regexp_extract(lower(s.text), '{esc(p)}', 1)" for k, p in SHARED.items())
    return F.expr(f"array_distinct(concat({own}, transform(base, s -> concat('shared ', s.kind, ':', case s.kind {cases} end))))")


def find(docs: DataFrame, support: int = SUPPORT, disclosure: float = DISCLOSURE) -> DataFrame:
    """(doc_id, row, th, base, terms): arrays of spans of every row of ``docs``; row is a unique number, th the text's hash."""
    blank = lambda x, at: F.repeat(F.lit("\n"), F.greatest(x["end"] - at, F.lit(0)))
    based = base_spans(docs).select(
        "doc_id", F.xxhash64("text").alias("th"), "base", cut_out(F.col("text"), F.col("base"), blank).alias("plain"), F.monotonically_increasing_id().alias("row")
    )
    based = store.keep(based, "pii-base")
    words = F.filter(F.array_distinct(F.regexp_extract_all(F.lower("plain"), F.lit(TERM), F.lit(0))), lambda x: F.length(x) > 1)
    terms = based.select("row", F.explode(words).alias("term"))
    total = based.count()
    entities = based.filter("size(base) > 0").select("row", F.explode(_entities()).alias("entity"))
    # n(e, t) can't exceed n(e)
    n_e = store.keep(entities.groupBy("entity").agg(F.count("*").alias("n_e")).filter((F.col("n_e") >= support) & (F.col("n_e") < total)), "pii-entities")
    held = store.keep(entities.join(n_e, "entity").groupBy("row").agg(F.collect_set("entity").alias("held")), "pii-held")
    beside = based.filter("size(base) > 0").select("row", words.alias("words")).join(held, "row")
    pairs = beside.select(F.explode("held").alias("entity"), "words").select("entity", F.explode("words").alias("term"))
    pairs = store.keep(pairs.groupBy("entity", "term").agg(F.count("*").alias("n_et")).filter(F.col("n_et") >= support), "pii-pairs")
    wanted = pairs.select("term").distinct()
    n_t = terms.groupBy("term").agg(F.count("*").alias("n_t")).join(wanted, "term", "left_semi")
    share = (F.log(F.lit(float(total))) + F.log("n_et") - F.log("n_e") - F.log("n_t")) / (F.log(F.lit(float(total))) - F.log("n_e"))
    telling = store.keep(pairs.join(n_e, "entity").join(n_t, "term").filter(share >= disclosure).select("term").distinct(), "pii-telling")
    if telling.count() <= buckets.BROADCAST_KEYS:
        telling = F.broadcast(telling)
    told = store.keep(terms.join(telling, "term", "left_semi").groupBy("row").agg(F.collect_set("term").alias("told")), "pii-told")
    many = told.agg(F.count("*") + F.coalesce(F.sum(F.size("told")), F.lit(0))).first()[0] > BROADCAST_TERMS
    at = F.filter(placed(F.col("plain"), TERM), lambda x: F.array_contains(F.col("told"), F.lower(x["text"])))
    spans = based.select("row", "plain").join(told if many else F.broadcast(told), "row")
    spans = spans.select("row", F.transform(at, lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"))).alias("terms"))
    out = based.select("doc_id", "row", "th", "base").join(spans, "row", "left")
    return out.withColumn("terms", F.coalesce("terms", F.expr("cast(array() as array<struct<start: int, end: int>>)")))


def report(docs: DataFrame) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans)."""
    f = find(docs)
    count = [F.expr(f"cast(size(filter(base, s -> s.kind = '{k}')) as long)").alias(f"n_{k}") for k in KINDS]
    line = "s -> concat(s.kind, ':', s.start, ':', s.end)"
    every = f"array_sort(concat(transform(base, s -> struct(s.start as start, s.no as no, s.kind as kind, s.end as end)), transform(terms, t -> struct(t.start as start, {len(KINDS)} as no, 'term' as kind, t.end as end))))"
    digest = F.sha2(F.array_join(F.expr(f"transform(base, {line})"), ","), 256)
    return f.select("doc_id", *count, digest.alias("base_sha256"), F.array_join(F.expr(f"transform({every}, {line})"), ",").alias("spans"))


def sanitise(docs: DataFrame) -> DataFrame:
    """``docs`` with base spans generalised to ``[kind]`` and disclosing terms removed."""
    every = "array_sort(concat(transform(base, s -> struct(s.start as start, -s.end as last, s.end as end, concat('[', s.kind, ']') as put)), transform(terms, t -> struct(t.start as start, -t.end as last, t.end as end, '' as put))))"
    cuts = find(docs).select(F.col("doc_id").alias("__id"), F.col("th").alias("__th"), F.expr(every).alias("__cuts")).filter(F.size("__cuts") > 0)
    cuts = cuts.dropDuplicates(["__id", "__th"])
    joined = docs.join(cuts, docs["doc_id"].eqNullSafe(cuts["__id"]) & (F.xxhash64(docs["text"]) == cuts["__th"]), "left")
    name = lambda x, at: F.when(x["start"] == at, x["put"]).otherwise("")
    cut = cut_out(F.col("text"), F.col("__cuts"), name)
    return joined.withColumn("text", F.when(F.col("__cuts").isNull(), F.col("text")).otherwise(cut)).select(*docs.columns)
