"""Personal data: patterns, and terms that disclose a protected entity.

Base spans are pattern matches, found with built-in functions. An entity is the value of such a
span. A term in a document with an entity discloses it when knowing the term makes the entity much
more likely: with document frequencies over the whole corpus, PMI(e; t) / IC(e) =
log(p(e, t) / (p(e) p(t))) / -log p(e), which is 1 when the term never occurs without the entity.
Terms over ``remove`` are removed and those over ``generalise`` are replaced by a class.

Spans and distinct terms of each text are worked out once and written as a narrow table, from which all
counts are made. Shuffles: the texts, once; their base spans; the term counts after partial aggregation;
the distinct terms of each document that are rare enough to disclose anything; and the (entity, term)
pairs of documents after partial aggregation.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from meteospan.llm.columns import fresh, let, located, row_keys, whole
from meteospan.llm.store import written

KINDS = ("email", "ip", "card", "phone", "term")

# The patterns of the contract. A run of the first class is tried from its start (or
# from the end of the last match) only, and loops that need no way back are possessive, so that a
# long run of letters or digits costs no square.
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"[0-9](?<![0-9]{2})[0-9]*+(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9]){13,}+",  # shorter ones fail, and no match is tried within them
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: A term and the characters next to it. A-Za-z0-9 are letters and digits that are told without a look at their category.
LETTER, OTHER = r"[A-Za-z\p{L}]", r"[A-Za-z0-9\p{L}\p{N}]"
TERM = rf"(?<!{OTHER}){LETTER}{{3,24}}+(?!{OTHER})"


#: Terms too frequent to disclose anything that are dropped before a shuffle; the rest of them after it.
FREQUENT = 1 << 15
#: Disclosing terms that are broadcast to the texts; if there are more, terms and texts' words are shuffled.
TOLD = 1 << 17


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    doubled = lambda x, i: F.when(i % 2 == 1, F.when(x > 4, x * 2 - 9).otherwise(x * 2)).otherwise(x)
    numbers = F.transform(F.split(F.reverse(digits), ""), lambda x: F.when(x == "", 0).otherwise(x.cast("int")))
    return F.aggregate(F.transform(numbers, doubled), F.lit(0), lambda a, x: a + x) % 10 == 0


def _valid(kind: str, value: Column) -> Column:
    if kind == "ip":
        part = lambda x: let(
            F.regexp_replace(x, "^0+", ""), lambda y: (F.char_length(y) < 3) | ((F.char_length(y) == 3) & (y <= "255"))
        )
        return F.forall(F.split(value, r"\."), part)
    if kind == "card":
        return let(_digits(value), lambda d: F.when(F.char_length(d).between(14, 19), _luhn(d)).otherwise(False))
    if kind == "phone":
        return F.char_length(_digits(value)).between(10, 15)
    return F.lit(True)


def base_spans(text: Column) -> Column:
    """Valid matches of the four kinds as structs ``start, kind, end, value``."""
    text = whole(text)
    # a cheap test first; the regular expressions see few texts
    hint = {"email": F.contains(text, F.lit("@")), "phone": F.contains(text, F.lit("+"))}

    def of(number: int, kind: str) -> Column:
        found = F.filter(located(text, PATTERNS[kind]), lambda s: _valid(kind, s["value"]))
        spans = F.transform(
            found,
            lambda s: F.struct(
                s["start"].alias("start"), F.lit(number).alias("kind"), s["end"].alias("end"),
                F.lower(s["value"]).alias("value"),
            ),
        )
        empty = F.array().cast("array<struct<start:bigint,kind:int,end:bigint,value:string>>")
        return F.when(hint[kind], spans).otherwise(empty) if kind in hint else spans

    return F.sort_array(F.concat(*[of(i, k) for i, k in enumerate(KINDS[:4])]))


def outside(text: Column, spans: Column) -> Column:
    """The text between blanks, with a blank for each code point of a span."""
    blank = lambda n: F.repeat(F.lit(" "), n.cast("int"))
    step = lambda a, s: F.when(s["end"] <= a["at"], a).otherwise(
        let(
            F.greatest(a["at"], s["start"]),
            lambda at: F.struct(
                s["end"].alias("at"),
                F.concat(a["out"], F.substring(text, a["at"].cast("int") + 1, (at - a["at"]).cast("int")), blank(s["end"] - at)).alias("out"),
            ),
        )
    )
    start = F.struct(F.lit(0).cast("bigint").alias("at"), F.lit(" ").alias("out"))
    end = lambda a: F.concat(a["out"], F.substring(text, a["at"].cast("int") + 1, F.char_length(text)), F.lit(" "))
    return F.when(F.size(spans) > 0, F.aggregate(spans, start, step, end)).otherwise(F.concat(F.lit(" "), text, F.lit(" ")))


def _forms(text: Column) -> Column:
    """Terms of a text as they stand in it."""
    return F.regexp_extract_all(text, F.lit(TERM), F.lit(0))


def terms(text: Column) -> Column:
    """Distinct terms of a text, lower-cased."""
    return F.array_distinct(F.transform(_forms(text), F.lower))


def marked(text: Column, marks: str) -> Column:
    """Terms of a text that are keys of the map ``marks``, as structs ``start, end, term``: first the forms
    in which they stand in the text, then the places of these forms."""
    known = F.filter(F.array_distinct(_forms(text)), lambda x: F.map_contains_key(marks, F.lower(x)))
    # the first letter of a form is looked for before anything else
    first = lambda forms: F.array_join(F.transform(forms, lambda x: F.left(x, F.lit(1))), "")
    pattern = lambda forms: F.concat(F.lit("(?=["), first(forms), F.lit(f"])(?<!{OTHER})(?:"), F.array_join(forms, "|"), F.lit(f")(?!{OTHER})"))
    one = lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.lower(s["value"]).alias("term"))
    none = F.array().cast("array<struct<start:bigint,end:bigint,term:string>>")
    return let(known, lambda forms: F.when(F.size(forms) > 0, F.transform(located(text, pattern(forms)), one)).otherwise(none))


def disclosing_spans(
    docs: DataFrame, text_col: str = "text", around: int = 64, remove: float = 0.9, generalise: float = 0.7, support: int = 3,
) -> DataFrame:
    """One row per input row: its columns and ``spans``, an array of ``start, kind, end, action``
    (code points, end exclusive; kind is a position in ``KINDS``; action is ``base``, ``remove`` or
    ``generalise``), sorted.

    A document is the context of its entities (``around`` is without effect); a pair of entity and
    term counts when at least ``support`` documents have it, and a disclosing term is marked wherever
    it stands outside base spans, in any document. A null or empty text has no spans, equal
    rows get equal spans and count as often as they occur, an empty table gives an empty result. A
    column of the input called ``spans`` is replaced; any other name is kept.
    """
    names = [c for c in docs.columns if c.lower() != "spans"]
    text = F.col(text_col)
    keys = row_keys(docs.columns, *[F.col(c) for c in docs.columns])
    k = list(keys)
    out = [c for c in names if c != text_col]
    row, own, body, marks = (fresh(docs.columns, x) for x in ("_row", "_own", "_body", "_marks"))
    read = docs.select(*[v.alias(n) for n, v in keys.items()], F.struct(*out).alias(row) if out else F.lit(True).alias(row), whole(text).alias(body))

    # narrow tables that are read more than once: spans and words of the texts are not worked out anew for each use
    spanned = read.select(*k, body, base_spans(F.col(body)).alias(own))
    free = let(F.struct(body, own), lambda s: terms(outside(s[body], s[own])))
    words = written(spanned.select(*k, own, free.alias("free"), F.when(F.size(own) > 0, terms(F.col(body))).alias("all")), "words")
    values = words.select(*k, F.explode(F.array_distinct(F.transform(own, lambda s: s["value"]))).alias("entity"))
    entities = written(values.groupBy(*k, "entity").agg(F.count("*").alias("copies")), "entities")
    entity = entities.groupBy("entity").agg(F.sum("copies").alias("n_entity")).filter(F.col("n_entity") >= support)
    term = words.select(F.explode(F.coalesce("all", "free")).alias("term")).groupBy("term").agg(F.count("*").alias("n_term"))
    term = written(term.filter(F.col("n_term") >= support), "terms")
    total = docs.agg(F.count("*").cast("double").alias("n")).scalar()
    least = min(remove, generalise)
    power = max(least, 0.0)
    # told <= least for any number of joint documents when the term is in more than this
    most = lambda n_entity: F.pow(total, F.lit(1 - power)) * F.pow(n_entity.cast("double"), F.lit(power)) * (1 + 1e-9)
    top = entity.agg(F.coalesce(F.max("n_entity"), F.lit(0)).alias("top")).scalar()
    frequent = term.filter(F.col("n_term") > most(top)).orderBy(F.desc("n_term"), "term").limit(FREQUENT).select("term")
    tokens = lambda rows: rows.select(*k, F.explode("free").alias("term"))
    # only documents with an entity say anything about terms
    beside = tokens(words.filter(F.size(own) > 0)).join(F.broadcast(frequent), "term", "left_anti")
    usable = term.filter((F.col("n_term") >= support) & (F.col("n_term") <= most(top)))
    joint = (
        beside.join(usable, "term").join(entities.join(entity, "entity").drop("copies"), k)
        .filter(F.col("n_term") <= most(F.col("n_entity")))
        .groupBy("entity", "term", "n_entity", "n_term").agg(F.count("*").alias("n_joint"))
    )
    pmi = F.log(F.col("n_joint") * F.col("n") / (F.col("n_entity") * F.col("n_term")))
    told = (
        joint.filter(F.col("n_joint") >= support).withColumn("n", total)
        .withColumn("told", F.when(F.col("n_entity") < F.col("n"), pmi / F.log(F.col("n") / F.col("n_entity"))).otherwise(0.0))
        .groupBy("term").agg(F.max("told").alias("told")).filter(F.col("told") >= least)
        .select("term", F.when(F.col("told") >= remove, "remove").otherwise("generalise").alias("action"))
    )
    told = written(told, "told")
    few = F.broadcast(told) if told.count() <= TOLD else told
    hits = tokens(words).join(few, "term").groupBy(*k).agg(F.map_from_entries(F.collect_set(F.struct("term", "action"))).alias(marks))
    base = F.transform(own, lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"), F.lit("base").alias("action")))
    placed = F.transform(
        marked(outside(F.col(body), F.col(own)), marks),
        lambda t: F.struct(
            (t["start"] - 1).alias("start"), F.lit(4).alias("kind"), (t["end"] - 1).alias("end"),
            F.element_at(marks, t["term"]).alias("action"),
        ),
    )
    empty = F.array().cast("array<struct<start:bigint,kind:int,end:bigint,action:string>>")
    spans = words.groupBy(*k).agg(F.first(own).alias(own))
    return read.join(spans, k).join(hits, k, "left").select(
        *([f"{row}.*"] if out else []),
        F.sort_array(F.concat(base, F.when(F.col(marks).isNotNull(), placed).otherwise(empty))).alias("spans"),
    )


def listed(spans: Column) -> Column:
    """``kind:start:end`` of every span, comma-joined."""
    kinds = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", F.get(kinds, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ","
    )


def sanitised(text: Column, spans: Column) -> Column:
    """The text with every span replaced by its kind in brackets; a removed term leaves nothing.
    Of overlapping spans the first and longest counts."""
    kinds = F.array(*[F.lit(f"[{k}]") for k in KINDS])
    step = lambda a, s: F.when(s["start"] < a["at"], a).otherwise(
        F.struct(
            s["end"].alias("at"),
            F.concat(
                a["out"], F.substring(a["text"], a["at"].cast("int") + 1, (s["start"] - a["at"]).cast("int")),
                F.when(s["action"] == "remove", "").otherwise(F.get(kinds, s["kind"])),
            ).alias("out"),
            a["text"].alias("text"),
        )
    )
    start = F.struct(F.lit(0).cast("bigint").alias("at"), F.lit("").alias("out"), whole(text).alias("text"))
    return F.aggregate(spans, start, step, lambda a: F.concat(a["out"], F.substring(a["text"], a["at"].cast("int") + 1, F.char_length(a["text"]))))


def op5_pii(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = disclosing_spans(docs)
    own = F.filter("spans", lambda s: s["action"] == "base")
    count = lambda i: F.size(F.filter("spans", lambda s: s["kind"] == i)).cast("bigint")
    return found.select(
        "doc_id", *[count(i).alias(f"n_{k}") for i, k in enumerate(KINDS[:4])], F.sha2(listed(own), 256).alias("base_sha256"),
        listed(F.col("spans")).alias("spans"),
    )
