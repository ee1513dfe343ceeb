"""Personal data: pattern spans, and information-theoretic sanitisation of the terms around them.

All of it is DataFrame functions. Pattern spans come from regular expressions
(e-mail, IP address, payment card, phone). The position of each match is a
running sum over the texts between matches and the matches themselves, taken
in blocks, so a long text with many matches stays cheap.

The values found are the protected entities. A term (three letters or more, in
lower case) in the same document, however far off, reveals an entity as far as
the corpus says so: with document frequencies over all N documents,

    PMI(e; t) = log2(N * df(e, t) / (df(e) * df(t))),  IC(e) = log2(N / df(e)),

and the disclosure is PMI / IC: 1 means that who sees t knows e. Pairs seen in
fewer than ``support`` documents prove nothing. From ``generalise`` on, a term
becomes ``[WORD]``; from ``remove`` on, it goes altogether, wherever it stands
in a document that holds the entity. Occurrences that lie in or touch a pattern
span are left to it. An entity in every document is no
secret.

A null text is empty. Copies count as documents. Spans depend on the text and
the corpus counts only, so they are joined back by a digest of the text; null
and repeated ids and rows do no harm. An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from talus.llm.common import cut, hidden

# Each pattern is the public one with possessive loops and a guard against
# starting inside a run that has failed already; the matches are the same.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
MASKS = {"email": "[EMAIL]", "ip": "[IP]", "card": "[CARD]", "phone": "[PHONE]"}
_TERM = r"\p{L}{3,}"
_BLOCK = 256
_SALTS = 32
_SPAN = "array<struct<start:bigint,end:bigint,value:string>>"


def _valid(kind: str, value: Column) -> Column:
    digits = F.regexp_replace(value, "[^0-9]", "")
    if kind == "ip":
        return value.rlike(r"\A(?:0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])(?:\.|\z)){4}\z")
    if kind == "card":
        return F.length(digits).between(16, 19) & F.call_function("luhn_check", digits)
    if kind == "phone":
        return F.length(digits).between(8, 15)
    return F.lit(True)


def _may_hold(kind: str, text: Column) -> Column:
    """A cheap test that no match fails."""
    if kind == "email":
        return F.contains(text, F.lit("@"))
    if kind == "phone":
        return F.contains(text, F.lit("+"))
    return text.rlike(r"[0-9]\.[0-9]" if kind == "ip" else "[0-9][\\x20-]?[0-9]")


def placed(gaps: Column, values: Column) -> Column:
    """Matches with offsets in code points."""
    rows = F.transform(
        values,
        lambda v, i: F.struct(
            v.alias("value"),
            F.length(F.get(gaps, i)).cast("bigint").alias("gap"),
            F.length(v).cast("bigint").alias("size"),
        ),
    )
    count = F.ceil(F.size(values) / F.lit(_BLOCK)).cast("int")
    blocks = F.transform(F.sequence(F.lit(0), count - 1), lambda b: F.slice(rows, b * _BLOCK + 1, F.lit(_BLOCK)))
    zero = F.lit(0).cast("bigint")
    totals = F.transform(blocks, lambda b: F.aggregate(b, zero, lambda s, r: s + r.gap + r["size"]))
    starts = F.aggregate(
        totals,
        F.struct(zero.alias("sum"), F.array().cast("array<bigint>").alias("all")),
        lambda acc, t: F.struct((acc["sum"] + t).alias("sum"), F.array_append(acc["all"], acc["sum"]).alias("all")),
        lambda acc: acc["all"],
    )

    def within(block: Column, first: Column) -> Column:
        def add(acc, r):
            start = acc["at"] + r.gap
            span = F.struct(start.alias("start"), (start + r["size"]).alias("end"), r.value.alias("value"))
            return F.struct((start + r["size"]).alias("at"), F.array_append(acc["all"], span).alias("all"))

        return F.aggregate(
            block, F.struct(first.alias("at"), F.array().cast(_SPAN).alias("all")), add, lambda acc: acc["all"]
        )

    spans = F.flatten(F.zip_with(blocks, starts, within))
    return F.when(F.size(values) > 0, spans).otherwise(F.array().cast(_SPAN))


def _passes(kind: str):
    return lambda span: _valid(kind, span.value)


def _each(make) -> Column:
    """One list of ``make(kind)(span)`` over the spans of all kinds, by kind."""
    return F.concat(*[F.transform(F.col(k), make(k)) for k in PATTERNS])


def _beside(text: Column, reach: int):
    """A span with up to ``reach`` characters of the text on both sides, whatever else matches there."""

    def add(s: Column) -> Column:
        size = F.least(s.start, F.lit(reach)).cast("int")
        left = F.substring(text, (s.start + 1).cast("int") - size, size)
        right = F.substring(text, (s.end + 1).cast("int"), F.lit(reach))
        return F.struct(s.start.alias("start"), s.end.alias("end"), s.value.alias("value"), left.alias("left"), right.alias("right"))

    return add


def pattern_spans(docs: DataFrame, text: str, names: dict[str, str], reach: int) -> DataFrame:
    """Adds, for each kind, the spans that pass its test, with the texts beside them if there is a reach. ``text`` may not be null."""
    values, gaps = dict(zip(PATTERNS, hidden(*PATTERNS))), dict(zip(PATTERNS, hidden(*PATTERNS)))
    none = F.array().cast("array<string>")
    docs = docs.withColumns(
        {
            values[k]: F.when(_may_hold(k, F.col(text)), F.regexp_extract_all(F.col(text), F.lit(p), F.lit(0))).otherwise(none)
            for k, p in PATTERNS.items()
        }
    )
    docs = docs.withColumns(
        {gaps[k]: F.when(F.size(values[k]) > 0, F.split(F.col(text), p, -1)).otherwise(none) for k, p in PATTERNS.items()}
    )
    spans = {
        names[k]: F.filter(placed(F.col(gaps[k]), F.col(values[k])), _passes(k)) for k in PATTERNS
    }
    if reach:
        spans = {name: F.transform(s, _beside(F.col(text), reach)) for name, s in spans.items()}
    return docs.withColumns(spans).drop(*values.values(), *gaps.values())


def _digest(text: str) -> Column:
    return F.sha2(F.col(text), 256)


def _words(text: Column) -> Column:
    """The distinct terms of a text."""
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(_TERM), F.lit(0)), lambda w: F.lower(w)))


def entities(docs: DataFrame, *, doc_id: str, text: str) -> DataFrame:
    """Stored: id, digest of the text, one list of spans for each kind, and of a text that has spans its terms and itself."""
    own = docs.select(F.col(doc_id).alias("doc"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    own = own.withColumn("digest", _digest("text"))
    found = pattern_spans(own, "text", {k: k for k in PATTERNS}, 0)
    held = F.size(F.concat(*[F.transform(F.col(k), lambda s: s.start) for k in PATTERNS])) > 0
    own_text = F.when(held, F.col("text")).alias("text")
    return cut(found.select("doc", "digest", *PATTERNS, F.when(held, _words(F.col("text"))).alias("words"), own_text))


def _places(gaps: Column, values: Column, risk: Column, base: Column) -> Column:
    """Every occurrence of a risky term that no pattern span holds or touches, in order."""
    spans = placed(gaps, values)
    known = F.transform(
        spans, lambda s: F.struct(s.start.alias("start"), s.end.alias("end"), F.try_element_at(risk, F.lower(s.value)).alias("disclosure"))
    )
    risky = F.filter(known, lambda s: s.disclosure.isNotNull())
    return F.filter(risky, lambda s: ~F.exists(base, lambda b: (b.start <= s.end) & (b.end >= s.start)))


def disclosing_terms(docs: DataFrame, *, doc_id: str, text: str, support: int, generalise: float) -> tuple[DataFrame, DataFrame]:
    """The stored entities by document, and (digest, spans) of the terms that disclose one.

    Copies of a text are counted together. A pair can reach ``generalise`` only
    if df(t) <= N^(1 - generalise) * df(e)^generalise, since df(e, t) is no more
    than either; other pairs are left out before they are joined.
    """
    found = entities(docs, doc_id=doc_id, text=text)
    total = found.agg(F.count(F.lit(1)).alias("N")).first().N
    every = _each(lambda kind: lambda s: F.concat_ws(":", F.lit(kind), F.lower(s.value)))
    base = _each(lambda kind: lambda s: F.struct(s.start.alias("start"), s.end.alias("end")))
    texts = cut(
        found.where(F.col("words").isNotNull())
        .select("digest", F.array_distinct(every).alias("entities"), base.alias("base"), "words")
        .groupBy("digest")
        .agg(F.count(F.lit(1)).alias("copies"), *[F.first(c).alias(c) for c in ("entities", "base", "words")])
    )

    def most(de: Column) -> Column:
        return F.pow(F.lit(float(total)), F.lit(1 - generalise)) * F.pow(de, F.lit(generalise)) * (1 + 1e-9)

    single = texts.select("digest", "copies", F.explode("entities").alias("entity"))
    df_entity = single.groupBy("entity").agg(F.sum("copies").alias("de")).where((F.col("de") >= support) & (F.col("de") < total))
    salts = F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(_SALTS - 1).cast("bigint")))
    salted = single.withColumn("salt", F.pmod(F.xxhash64("digest"), F.lit(_SALTS).cast("bigint")))
    holders = cut(salted.join(df_entity.select("entity", "de", salts.alias("salt")), ["entity", "salt"]).drop("salt"))
    top = holders.agg(F.max("de").alias("de")).first().de or 0
    df_term = docs.select(F.explode(_words(F.col(text))).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("dt"))
    df_term = df_term.where((F.col("dt") >= support) & (F.col("dt") <= most(F.lit(float(top)))))
    terms = texts.join(holders.select("digest").distinct(), "digest", "left_semi").select("digest", F.explode("words").alias("term"))
    pairs = cut(terms.join(df_term, "term").join(holders, "digest").where(F.col("dt") <= most(F.col("de"))))
    df_pair = pairs.groupBy("entity", "term").agg(F.sum("copies").alias("det"), F.first("de").alias("de"), F.first("dt").alias("dt"))
    known = F.log2(F.lit(float(total)) * F.col("det") / (F.col("de") * F.col("dt"))) / F.log2(F.lit(float(total)) / F.col("de"))
    risky = df_pair.where(F.col("det") >= support).select("entity", "term", known.alias("disclosure")).where(F.col("disclosure") >= generalise)
    hits = pairs.select("digest", "entity", "term").join(risky, ["entity", "term"]).groupBy("digest", "term").agg(F.max("disclosure").alias("d"))
    risk = cut(hits.groupBy("digest").agg(F.map_from_entries(F.collect_list(F.struct("term", "d"))).alias("risk")))
    # only texts that hold an entity have places, so no other text is moved
    whole = found.where(F.col("words").isNotNull()).select("digest", "text").join(risk.select("digest"), "digest", "left_semi")
    whole = whole.groupBy("digest").agg(F.first("text").alias("text")).join(risk, "digest").join(texts.select("digest", "base"), "digest")
    # columns of their own: inside a lambda they would be made anew for every term
    parts = {"values": F.regexp_extract_all("text", F.lit(_TERM), F.lit(0)), "gaps": F.split("text", _TERM, -1)}
    places = _places(F.col("gaps"), F.col("values"), F.col("risk"), F.col("base"))
    return found, cut(whole.withColumns(parts).select("digest", places.alias("terms")))


def _named(kind: str, spans: Column) -> Column:
    return F.transform(spans, lambda s: F.concat_ws(":", F.lit(kind), s.start, s.end))


def find_personal_data(
    docs: DataFrame,
    *,
    doc_id: str = "doc_id",
    text: str = "text",
    support: int = 2,
    generalise: float = 0.8,
) -> DataFrame:
    """One row per document: id, a list of spans for each kind, and ``terms``; as ``kind:start:end`` in base and spans."""
    found, terms = disclosing_terms(docs, doc_id=doc_id, text=text, support=support, generalise=generalise)
    base = F.concat(*[_named(k, F.col(k)) for k in PATTERNS])
    narrow = found.select("doc", "digest", *PATTERNS, base.alias("base"))
    none = F.array().cast("array<struct<start:bigint,end:bigint,disclosure:double>>")
    joined = narrow.join(terms, "digest", "left").withColumn("terms", F.coalesce("terms", none))
    return joined.select(
        F.col("doc").alias(doc_id), *PATTERNS, "terms", "base", F.concat("base", _named("term", F.col("terms"))).alias("spans")
    )


def masked(text: Column, spans: Column) -> Column:
    """The text with sorted spans (start, end, mask) replaced; of overlapping ones the first gives the mask."""
    kind = "array<struct<start:bigint,end:bigint,mask:string>>"
    merged = F.aggregate(
        spans,
        F.array().cast(kind),
        lambda acc, s: F.when(
            (F.size(acc) > 0) & (s.start < F.try_element_at(acc, F.lit(-1))["end"]),
            F.concat(
                F.slice(acc, F.lit(1), F.size(acc) - 1),
                F.array(
                    F.struct(
                        F.try_element_at(acc, F.lit(-1))["start"].alias("start"),
                        F.greatest(F.try_element_at(acc, F.lit(-1))["end"], s.end).alias("end"),
                        F.try_element_at(acc, F.lit(-1))["mask"].alias("mask"),
                    )
                ),
            ),
        ).otherwise(F.array_append(acc, s)),
    )

    def piece(s: Column, before: Column) -> Column:
        return F.concat(F.substring(text, (before + 1).cast("int"), (s.start - before).cast("int")), s.mask)

    ends = F.concat(F.array(F.lit(0).cast("bigint")), F.transform(merged, lambda s: s.end))
    pieces = F.zip_with(merged, F.slice(ends, F.lit(1), F.size(merged)), piece)
    rest = F.substring(text, (F.element_at(ends, -1) + 1).cast("int"), F.length(text))
    return F.concat(F.array_join(pieces, ""), rest)


def sanitise(
    docs: DataFrame,
    *,
    doc_id: str = "doc_id",
    text: str = "text",
    support: int = 2,
    generalise: float = 0.8,
    remove: float = 1.0,
) -> DataFrame:
    """All documents with their own columns. Texts with personal data are rewritten; the others, null included, stay.

    A text without entities has no spans, so only the others are joined to theirs.
    """
    found, terms = disclosing_terms(docs, doc_id=doc_id, text=text, support=support, generalise=generalise)
    spans = _each(lambda kind: lambda s: F.struct(s.start.alias("start"), s.end.alias("end"), F.lit(MASKS[kind]).alias("mask")))
    own = found.where(F.size(spans) > 0).groupBy("digest").agg(*[F.first(k).alias(k) for k in PATTERNS])
    more = F.transform(
        F.coalesce("terms", F.array().cast("array<struct<start:bigint,end:bigint,disclosure:double>>")),
        lambda s: F.struct(
            s.start.alias("start"), s.end.alias("end"), F.when(s.disclosure >= remove, "").otherwise("[WORD]").alias("mask")
        ),
    )
    key, all_spans, held = hidden("digest", "spans", "held")
    every = own.join(terms, "digest", "left").select(
        F.col("digest").alias(key), F.sort_array(F.concat(spans, more)).alias(all_spans)
    )
    joined = docs.withColumn(key, _digest(text)).join(cut(every), key, "left")
    return joined.withColumn(
        text, F.when(F.col(all_spans).isNull(), F.col(text)).otherwise(masked(F.col(text), F.col(all_spans)))
    ).select(*[f"`{c}`" for c in docs.columns])
