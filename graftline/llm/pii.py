r"""Personal data: base kinds by pattern, and terms that reveal them by information theory.

Every e-mail address, IP address, card number and phone number is a protected entity.  A term (a run of at
least three letters outside e-mail addresses, bounded by anything but letters) co-occurs with an entity if it stands whole within ``CONTEXT`` code points of it.  With
counts over the whole corpus, a term's disclosure of an entity is PMI(entity; term) / IC(entity), which is 1
for a term that is never seen without the entity; terms of at least ``MIN_SUPPORT`` joint occurrences whose disclosure reaches
``THRESHOLD`` are sanitised where they stand beside it: generalised to the class of words with the same first letters if
that class stays under the threshold, else removed.  All of it is DataFrame expressions; texts are not shuffled for the spans.

The patterns below match what the plain ones match, leftmost and non-overlapping: possessive
quantifiers where classes are disjoint, and no start inside a run that has failed already, so that a long text
costs linear time.  Positions are code points; they come from the lengths of the pieces between the matches.

Defined results: a null text counts as empty and has no spans; rows that repeat id and text have the same spans; a null
doc_id is an id like any other; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graftline.staging import stage

CONTEXT, MIN_SUPPORT, THRESHOLD, CLASS_LETTERS = 80, 5, 0.95, 3
#: Values whose lengths are summed together, and code points of a text's block.
GROUP, BLOCK = 128, 512

KINDS = ("email", "ip", "card", "phone")
TERM = len(KINDS)
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
_PART = "0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])"
_IP = rf"^{_PART}(?:\.{_PART}){{3}}$"
_TERMS = r"(?<!\p{L})\p{L}{3,}+"


def _let(value: Column, body) -> Column:
    """body(value), with value computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _starts(pieces: Column, values: Column) -> Column:
    """struct(at, value) for each value, given the pieces between the values.

    Lengths are summed in groups of ``GROUP``, so that a value's place needs the groups before it and its own group only.
    """
    total = lambda a: F.aggregate(a, F.lit(0), lambda s, x: s + x)
    lengths = F.transform(values, lambda v, i: F.length(F.get(pieces, i)) + F.length(v))
    groups = lambda n: F.transform(F.sequence(F.lit(0), F.floor(F.size(n) / GROUP).cast("int")), lambda j: total(F.slice(n, j * GROUP + 1, GROUP)))
    before = lambda g: F.transform(g, lambda _, j: total(F.slice(g, F.lit(1), j)))

    def places(n: Column, base: Column) -> Column:
        def place(v: Column, i: Column) -> Column:
            group = F.floor(i / GROUP).cast("int")
            return F.struct((F.get(base, group) + total(F.slice(n, group * GROUP + 1, i % GROUP)) + F.length(F.get(pieces, i))).alias("at"), v.alias("value"))

        return F.transform(values, place)

    return _let(lengths, lambda n: _let(groups(n), lambda g: _let(before(g), lambda base: places(n, base))))


def _blocks(text: Column) -> Column:
    """The text in blocks of ``BLOCK`` code points, from which short parts are cut without going through all of it."""
    return F.regexp_extract_all(text, F.lit(f"(?s).{{1,{BLOCK}}}"), 0)


def _between(blocks: Column, start: Column, end: Column) -> Column:
    """The code points from start to below end."""
    first, last = F.floor(start / BLOCK).cast("int"), F.floor(F.greatest(end - 1, start) / BLOCK).cast("int")
    return F.substring(F.array_join(F.slice(blocks, first + 1, last - first + 1), ""), start - first * BLOCK + 1, F.greatest(end - start, F.lit(0)))


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    def add(total: Column, i: Column) -> Column:
        d = F.substring(digits, -i, F.lit(1)).cast("int")
        twice = d * 2
        return total + F.when(i % 2 == 0, twice - F.when(twice > 9, 9).otherwise(0)).otherwise(d)

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), add) % 10 == 0


def _valid(kind: str, value: Column) -> Column:
    if kind == "ip":
        return value.rlike(_IP)
    if kind == "card":
        d = _digits(value)
        return F.when(F.length(d).between(14, 19), _luhn(d)).otherwise(False)
    if kind == "phone":
        return F.length(_digits(value)).between(10, 15)
    return F.lit(True)


def _spans(n: int, pieces: Column, values: Column) -> Column:
    valid = F.filter(_starts(pieces, values), lambda x: _valid(KINDS[n], x["value"]))
    return F.transform(valid, lambda x: F.struct(x["at"].alias("start"), F.lit(n).alias("kind"), (x["at"] + F.length(x["value"])).alias("end"), x["value"].alias("value")))


def _number(spans: Column, kind: int) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")


def base_spans(docs: DataFrame) -> DataFrame:
    """doc_id, text (null as empty), masked (text with blanks for e-mail addresses) and base: array of (start, kind, end, value), kind an index of KINDS, in order."""
    df = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    df = df.withColumns({f"m_{k}": F.regexp_extract_all("text", F.lit(p), 0) for k, p in PATTERNS.items()})
    df = df.withColumns({f"g_{k}": F.when(F.size(f"m_{k}") > 0, F.split("text", p, -1)).otherwise(F.array(F.lit(""))) for k, p in PATTERNS.items()})
    for n, k in enumerate(KINDS):
        df = df.withColumn(f"s_{k}", _spans(n, F.col(f"g_{k}"), F.col(f"m_{k}")))
    blank = lambda i: F.coalesce(F.repeat(F.lit(" "), F.length(F.get("m_email", i))), F.lit(""))
    masked = F.when(F.size("m_email") > 0, F.array_join(F.transform("g_email", lambda p, i: F.concat(p, blank(i))), "")).otherwise(F.col("text"))
    return df.select("doc_id", "text", masked.alias("masked"), F.sort_array(F.concat(*[f"s_{k}" for k in KINDS])).alias("base"))


def _context_terms(masked: Column, span: Column) -> Column:
    """Terms beside a span, of a masked text in blocks: array of (entity, term, start, end)."""
    entity = F.concat(span["kind"].cast("string"), F.lit(":"), F.lower(span["value"]))
    # one code point more than the context, so that words cut by its edge are told from whole ones
    left_from = F.greatest(span["start"] - CONTEXT - 1, F.lit(0))

    def terms(part: Column, offset: Column) -> Column:
        found = _starts(F.split(part, _TERMS, -1), F.regexp_extract_all(part, F.lit(_TERMS), 0))
        return F.transform(found, lambda x: F.struct(entity.alias("entity"), F.lower(x["value"]).alias("term"), (offset + x["at"]).alias("start"), (offset + x["at"] + F.length(x["value"])).alias("end")))

    left = _between(masked, left_from, span["start"])
    right = _between(masked, span["end"], span["end"] + CONTEXT + 1)
    both = F.concat(terms(left, left_from), terms(right, span["end"]))
    return F.filter(both, lambda x: (x["start"] >= span["start"] - CONTEXT) & (x["end"] <= span["end"] + CONTEXT))


def term_counts(docs: DataFrame) -> DataFrame:
    """term, n: occurrences of every term in the corpus."""
    masked = F.regexp_replace("text", PATTERNS["email"], " ")
    return docs.select(F.explode(F.regexp_extract_all(masked, F.lit(_TERMS), 0)).alias("w")).groupBy(F.lower("w").alias("term")).agg(F.count("*").alias("n"))


def _disclosure(joint: Column, term: Column, entity: Column, every: Column) -> Column:
    """PMI / IC, from counts."""
    p_entity = F.least(entity / every, F.lit(1.0))
    return 1 - F.log2(F.least(joint / term, F.lit(1.0))) / F.log2(p_entity)


def disclosing_terms(found: DataFrame, counts: DataFrame, min_support: int = MIN_SUPPORT, threshold: float = THRESHOLD) -> DataFrame:
    """entity, term, general: the pairs over the threshold; general is the term's class, null if that discloses too."""
    every = F.lit(float(counts.agg(F.sum("n")).first()[0] or 0))
    entities = found.select(F.explode("base").alias("b")).groupBy(F.concat(F.col("b.kind").cast("string"), F.lit(":"), F.lower("b.value")).alias("entity")).agg(F.count("*").alias("n_entity"))
    joint = stage(found.select(F.explode("beside").alias("x")).groupBy("x.entity", "x.term").agg(F.count("*").alias("n_joint")), "joint")
    often = joint.filter(F.col("n_joint") >= min_support).join(entities, "entity").join(counts, "term")
    over = often.filter(_disclosure(F.col("n_joint"), F.col("n"), F.col("n_entity"), every) >= threshold)
    letters = lambda c: F.substring(c, 1, CLASS_LETTERS)
    classes = counts.groupBy(letters("term").alias("class")).agg(F.sum("n").alias("n_class"))
    joint_classes = joint.groupBy("entity", letters("term").alias("class")).agg(F.sum("n_joint").alias("n_joint_class"))
    full = over.withColumn("class", letters("term")).join(joint_classes, ["entity", "class"]).join(classes, "class")
    hidden = _disclosure(F.col("n_joint_class"), F.col("n_class"), F.col("n_entity"), every) < threshold
    return full.select("entity", "term", F.when(hidden, F.concat("class", F.lit("*"))).alias("general"))


def _keys(df: DataFrame) -> DataFrame:
    return df.withColumns({"k": F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63))), "h": F.xxhash64("text")})


def _replaced(blocks: Column, length: Column, spans: Column) -> Column:
    """The text with base spans replaced by their kind's name, and terms generalised or removed; an overlapped span goes with the first."""
    label = F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS])
    kept_type = "array<struct<start:int,end:int,put:string>>"
    # spans are gone through in groups, so that no long array grows by single spans
    groups = F.transform(F.sequence(F.lit(0), F.floor(F.size(spans) / GROUP).cast("int")), lambda j: F.slice(spans, j * GROUP + 1, GROUP))

    def keep(acc: Column, s: Column) -> Column:
        put = F.when(s["kind"] == TERM, F.coalesce(s["general"], F.lit(""))).otherwise(F.get(label, s["kind"]))
        more = F.array(F.struct(s["start"].alias("start"), s["end"].alias("end"), put.alias("put")))
        return F.when(s["start"] >= acc["at"], F.struct(F.concat(acc["kept"], more).alias("kept"), s["end"].alias("at"))).otherwise(acc)

    def keep_group(acc: Column, group: Column) -> Column:
        own = F.aggregate(group, F.struct(F.array().cast(kept_type).alias("kept"), acc["at"].alias("at")), keep)
        return _let(own, lambda o: F.struct(F.concat(acc["kept"], F.array(o["kept"])).alias("kept"), o["at"].alias("at")))

    def text(kept: Column) -> Column:
        end = lambda i: F.coalesce(F.get(kept, i)["end"], F.lit(0))
        parts = F.transform(kept, lambda s, i: F.concat(_between(blocks, end(i - 1), s["start"]), s["put"]))
        return F.concat(F.array_join(parts, ""), _between(blocks, end(F.size(kept) - 1), length))

    none = F.struct(F.array().cast(f"array<{kept_type}>").alias("kept"), F.lit(0).alias("at"))
    return _let(F.aggregate(groups, none, keep_group, lambda acc: F.flatten(acc["kept"])), text)


def _clean(text: str, spans: str, digest: bool) -> Column:
    """What is left of the text, or its SHA-256."""
    blocks = lambda whole: F.when(F.size(spans) > 0, _let(_blocks(whole), lambda b: _replaced(b, F.length(whole), F.col(spans)))).otherwise(whole)
    out = blocks(F.col(text))
    return F.sha2(out, 256) if digest else out


def detect(docs: DataFrame, digest: bool = True) -> DataFrame:
    """doc_id, spans: array of (start, kind, end, general) in order, kind TERM for disclosing terms; clean: the sanitised text's SHA-256, or with digest False the text.

    Only texts with terms beside an entity are carried to the corpus-wide decision; all others are done in the first pass.
    """
    spans = base_spans(docs).withColumn("blocks", _blocks(F.col("masked")))
    spans = spans.withColumn("beside", F.flatten(F.transform("base", lambda s: _context_terms(F.col("blocks"), s))))
    spans = _keys(spans).withColumn("base", F.transform("base", lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"), F.lit(None).cast("string").alias("general"), s["value"].alias("value"))))
    undecided = F.size("beside") > 0
    # no name of a column that a lambda reads is given again in the same projection: it would be taken for the new one
    found = stage(spans.select("doc_id", "k", "h", "base", "beside", F.when(undecided, F.col("text")).alias("whole"), F.when(~undecided, _clean("text", "base", digest)).alias("clean")), "found")
    counts = stage(term_counts(docs), "terms")
    over = disclosing_terms(found, counts)
    base = F.transform("base", lambda s: s.dropFields("value")).alias("spans")
    done = found.filter(~undecided).select("doc_id", base, "clean")
    left = found.filter(undecided)
    beside = left.select("k", "h", F.explode("beside").alias("x")).select("k", "h", "x.*")
    own = beside.join(over, ["entity", "term"]).groupBy("k", "h", "start", "end").agg(F.min("general").alias("general"))
    terms = own.groupBy("k", "h").agg(F.collect_list(F.struct("start", F.lit(TERM).alias("kind"), "end", "general")).alias("terms"))
    both = left.select("doc_id", "k", "h", "whole", base).join(terms, ["k", "h"], "left")
    both = both.withColumn("spans", F.sort_array(F.when(F.col("terms").isNull(), F.col("spans")).otherwise(F.concat("spans", "terms"))))
    return done.unionByName(both.select("doc_id", "spans", _clean("whole", "spans", digest).alias("clean")))


def _shown(spans: Column) -> Column:
    name = F.array(*[F.lit(k) for k in (*KINDS, "term")])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", name[s["kind"]], s["start"], s["end"])), ",")


def report(docs: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, n_term, base_sha256, spans, n_general and n_removed (terms by what becomes of them), clean_sha256."""
    d = detect(docs)
    counts = [_number(F.col("spans"), n).alias(f"n_{k}") for n, k in enumerate((*KINDS, "term"))]
    base = F.filter("spans", lambda s: s["kind"] < TERM)
    general = F.size(F.filter("spans", lambda s: s["general"].isNotNull())).cast("long")
    gone = F.size(F.filter("spans", lambda s: (s["kind"] == TERM) & s["general"].isNull())).cast("long")
    return d.select("doc_id", *counts, F.sha2(_shown(base), 256).alias("base_sha256"), _shown(F.col("spans")).alias("spans"), general.alias("n_general"), gone.alias("n_removed"), F.col("clean").alias("clean_sha256"))


def sanitise(docs: DataFrame) -> DataFrame:
    """doc_id and text with base spans replaced by their kind's name and disclosing terms generalised or removed; an overlapped span is replaced by the first."""
    return detect(docs, digest=False).select("doc_id", F.col("clean").alias("text"))
