"""Personal data: exact patterns, and terms that give the data away (Sanchez and Batet, C-sanitized, 2016).

Emails, IP addresses, card and phone numbers are protected entities, found by pattern. Leaving the words next to
them can still reveal them, if these words stand in the corpus mostly where the entity stands. So for a term t in the context of an entity e,
over all documents,

    PMI(e; t) = log2( N * n(e, t) / (n(e) * n(t)) ),    IC(e) = log2( N / n(e) )

are estimated by co-occurrence counts; PMI / IC is the share of the entity's information that t discloses, 1 if t
stands nowhere else. Over one threshold t is generalised, over a higher one removed. A pair seen in fewer than
`support` documents is no evidence.

A term is generalised to one that the corpus uses more widely: g subsumes t (Sanderson and Croft, 1999) if it stands in nearly all
contexts that t stands in, and it may be written in t's place if it discloses less of the entity than the threshold. Of several the most telling one is taken.

Most values stand in one document. So what a value shares with others is an entity, too, with counts of its own: the user and the
domain of an email, the first two numbers of an address, the first six digits of a card, the first four of a phone. A term is
judged by the most that it discloses of the value or of a part. That some entity of a kind stands here is no disclosure, as the
brackets say it.

All of it is DataFrame expressions; counts are aggregates with map-side combining. Patterns run once over each text, and only spans, contexts
and counts of words go on from there. Positions of matches
come from the lengths of what lies between them (`split`), so they are those of the regex engine itself.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import shielded, stored, table

KINDS = ("email", "ip", "card", "phone")
#: The patterns of the four kinds. Possessive loops and look-behinds keep matching linear in the text and do not change what matches:
#: a match begins where a run of its first class begins, or where the last match ended. Cards: whole
#: runs of 16 to 19 digits, as longer and shorter ones fail.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){15,18}+(?![\x20-]?[0-9])",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Characters on either side of an entity that are its context; letters that a term has at least.
CONTEXT, TERM = 64, r"\p{L}{3,}+"
SUPPORT, GENERALISE_AT, REMOVE_AT = 3, 0.8, 0.95
#: Share of a term's contexts that a more general term stands in.
SUBSUMES = 0.8
#: Matches whose places are added up in one step; characters of a text that one key of `_free` stands for.
FOLD, CELL = 256, 256
#: Bytes of terms that are sent to the texts; with more of them, texts with an entity move instead.
BROADCAST_BYTES = 8 << 20
SPAN = "array<struct<kind: string, start: int, end: int, value: string>>"


def _once(value: Column, body) -> Column:
    """`body` of a value that is worked out once, however often the body names it."""
    return F.transform(F.array(value), body)[0]


def _blocks(values: Column) -> Column:
    """An array (not empty) as arrays of FOLD elements, so that folds which append copy short arrays only."""
    return F.transform(F.sequence(F.lit(0), F.floor((F.size(values) - 1) / FOLD).cast("int"), F.lit(1)), lambda k: F.slice(values, k * FOLD + 1, F.lit(FOLD)))


def matches(text: Column, pattern: str) -> Column:
    """array<struct<start, end, value>> of a pattern's matches: code points, end exclusive. Null where there is none.

    Places are running sums, which are taken in steps of FOLD matches: of the steps' sums first, then inside each step.
    """
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    # What lies between the matches has one piece more than there are matches.
    paired = _once(found, lambda f: F.zip_with(F.slice(F.split(text, pattern, -1), 1, F.size(f)), f, lambda b, m: F.struct(F.length(b).alias("gap"), m.alias("value"))))
    size = lambda x: x["gap"] + F.length(x["value"])

    def spread(block: Column, begin: Column) -> Column:
        start = F.struct(begin.alias("at"), F.array().cast("array<struct<start: int, end: int, value: string>>").alias("out"))

        def step(acc: Column, x: Column) -> Column:
            to = acc["at"] + size(x)
            return F.struct(to.alias("at"), F.array_append(acc["out"], F.struct((acc["at"] + x["gap"]).alias("start"), to.alias("end"), x["value"].alias("value"))).alias("out"))

        return F.aggregate(block, start, step, lambda acc: acc["out"])

    def placed(blocks: Column) -> Column:
        sums = F.transform(blocks, lambda b: F.aggregate(b, F.lit(0), lambda acc, x: acc + size(x)))
        begins = F.aggregate(sums, F.array(F.lit(0)), lambda acc, n: F.array_append(acc, F.element_at(acc, -1) + n))
        return F.flatten(F.zip_with(blocks, F.slice(begins, 1, F.size(blocks)), spread))

    return F.when(text.rlike(pattern), _once(_once(paired, _blocks), placed))


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(value: Column) -> Column:
    digits = _digits(value)

    def step(acc: Column, i: Column) -> Column:
        d = F.substring(digits, -i, F.lit(1)).cast("int") * F.when(i % 2 == 0, 2).otherwise(1)
        return acc + d - F.when(d > 9, 9).otherwise(0)

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), step) % 10 == 0


def _octets(value: Column) -> Column:
    def fits(part: Column) -> Column:
        bare = F.regexp_replace(part, "^0+", "")
        return (F.length(bare) <= 3) & (F.coalesce(F.substring(bare, 1, 4).try_cast("int"), F.lit(0)) <= 255)

    return F.forall(F.split(value, r"\."), fits)


def _holds(kind: str, value: Column) -> Column:
    if kind == "ip":
        return _octets(value)
    if kind == "card":
        return _luhn(value)
    return F.length(_digits(value)).between(8, 15) if kind == "phone" else F.lit(True)


def base_spans(text: Column) -> Column:
    """Spans of the four kinds, in the order of the kinds, then by start."""
    return F.concat(*(_spans_of(kind, text) for kind in KINDS))


def _spans_of(kind: str, text: Column) -> Column:
    seen = F.filter(matches(text, PATTERNS[kind]), lambda m: _holds(kind, m["value"]))
    named = F.transform(seen, lambda m: F.struct(F.lit(kind).alias("kind"), m["start"].alias("start"), m["end"].alias("end"), m["value"].alias("value")))
    return F.coalesce(named, F.array().cast(SPAN))


#: A term near an entity: the entity's kind, value and start, the term and its place.
NEAR = "array<struct<kind: string, value: string, at: int, term: string, start: int, end: int>>"


def contexts(text: Column, spans: Column) -> Column:
    """Terms on either side of each span, of type NEAR. A term that the edge of the context may have cut is left out; at the text's own ends none is."""

    def side(span: Column, stretch: Column, begin: Column, length: Column, cut_before: Column | bool, cut_after: Column | bool) -> Column:
        """Terms of a stretch (its begin in the text, its length) that its own ends may have cut or not."""
        found = _once(stretch, lambda t: matches(t, TERM))
        uncut = F.filter(found, lambda m: ((m["start"] > 0) | ~F.lit(cut_before)) & ((m["end"] < length) | ~F.lit(cut_after)))
        term = lambda m: F.struct(span["kind"].alias("kind"), span["value"].alias("value"), span["start"].alias("at"), F.lower(m["value"]).alias("term"), (begin + m["start"]).alias("start"), (begin + m["end"]).alias("end"))
        return F.coalesce(F.transform(uncut, term), F.array().cast(NEAR))

    def both(span: Column, stretch: Column, low: Column, size: Column) -> Column:
        first = F.greatest(span["start"] - CONTEXT, F.lit(0))
        last = F.least(span["end"] + CONTEXT, size)
        before = side(span, F.substring(stretch, first - low + 1, span["start"] - first), first, span["start"] - first, first > 0, False)
        after = side(span, F.substring(stretch, span["end"] - low + 1, last - span["end"]), span["end"], last - span["end"], False, last < size)
        return F.concat(before, after)

    def block(b: Column, size: Column) -> Column:
        # The spans of a block of one kind stand close: their surroundings are taken from the block's own stretch of the text.
        ends = F.struct(F.greatest(F.array_min(F.transform(b, lambda s: s["start"])) - CONTEXT, F.lit(0)).alias("low"), (F.array_max(F.transform(b, lambda s: s["end"])) + CONTEXT).alias("high"))
        inside = lambda e: _once(F.substring(text, e["low"] + 1, e["high"] - e["low"]), lambda t: F.flatten(F.transform(b, lambda s: both(s, t, e["low"], size))))
        return _once(ends, inside)

    sorted_ = F.sort_array(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"), s["value"].alias("value"))))
    return _once(F.length(text), lambda size: F.flatten(F.transform(_blocks(sorted_), lambda b: block(b, size))))


def _free(near: DataFrame, spans: DataFrame) -> DataFrame:
    """Terms that share no character with a span of their text. Both are dealt by cells of the text, so a text with very many of either is not one key."""
    cell = lambda c: F.floor(c / CELL)
    # A term is no longer than its context: a span that reaches it ends in its cell or behind, and begins at most a context behind its start.
    reach = spans.select("id", "text_hash", F.col("span.start").alias("s"), F.col("span.end").alias("e"))
    reach = reach.withColumn("cell", F.explode(F.sequence(cell(F.col("s") - CONTEXT), cell(F.col("e") - 1)))).alias("r")
    n = near.withColumn("cell", cell(F.col("start"))).alias("n")
    key = [F.col(f"n.{c}") == F.col(f"r.{c}") for c in ("id", "text_hash", "cell")]
    return n.join(reach, [*key, F.col("r.s") < F.col("n.end"), F.col("r.e") > F.col("n.start")], "left_anti").drop("cell")


def _parts(kind: Column, value: Column) -> Column:
    """An entity's exact value, and the parts that it shares with others."""
    named = lambda name, part: F.concat(F.lit(f"{name}:"), part)
    mail = F.array(named("user", F.lower(F.substring_index(value, "@", 1))), named("domain", F.lower(F.substring_index(value, "@", -1))))
    number = lambda name, n: F.array(named(name, F.substring(_digits(value), 1, n)))
    more = F.when(kind == "email", mail).when(kind == "ip", F.array(named("network", F.substring_index(value, ".", 2)))).when(kind == "card", number("issuer", 6)).otherwise(number("area", 4))
    return F.concat(F.array(named("value", value)), more)


def disclosing_terms(docs: DataFrame, near: DataFrame, support: int = SUPPORT) -> DataFrame:
    """kind, value, term, disclosure (the most of the value and its parts) for pairs with enough documents; counts are over every row of `docs`."""
    entity = ["kind", "part"]
    parted = near.withColumn("part", F.explode(_parts(F.col("kind"), F.col("value"))))
    once = parted.select("id", "text_hash", *entity, "term").distinct()
    pairs = stored(once.groupBy(*entity, "term").agg(F.count("*").alias("n_both")).where(F.col("n_both") >= support))
    if pairs.isEmpty():
        return near.select("kind", "value", "term", F.lit(0.0).alias("disclosure")).limit(0)
    entities = parted.select("id", "text_hash", *entity).distinct().groupBy(*entity).agg(F.count("*").alias("n_entity"))
    # Words are counted before they meet the pairs: a join with the texts' words makes a row for each text and term that has evidence, and the
    # larger the corpus, the more of its words have. Not a semi join, which Spark would move below the count.
    words = docs.select(F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(TERM), F.lit(0)))).alias("term"))
    terms = words.groupBy("term").agg(F.count("*").alias("n_term"))
    total = docs.agg(F.count("*").alias("n_all")).select("n_all")
    counted = pairs.join(entities, entity).join(terms, "term").join(F.broadcast(total))  # one row
    information = F.log2(F.col("n_all") / F.col("n_entity"))
    mutual = F.log2(F.col("n_all") * F.col("n_both") / (F.col("n_entity") * F.col("n_term")))
    told = counted.where(information > 0).select(*entity, "term", (mutual / information).alias("disclosure"))
    return parted.select("kind", "value", "part", "term").distinct().join(told, [*entity, "term"]).groupBy("kind", "value", "term").agg(F.max("disclosure").alias("disclosure"))


def general_terms(near: DataFrame, told: DataFrame, generalise_at: float, remove_at: float, share: float = SUBSUMES) -> DataFrame:
    """kind, value, term, general: for terms to be generalised, the most telling term under the threshold that subsumes them; without a row where none does."""
    asked = told.where((F.col("disclosure") >= generalise_at) & (F.col("disclosure") < remove_at)).select("kind", "value", "term")
    context = ["id", "text_hash", "kind", "at"]  # the surroundings of one entity: a few dozen terms
    terms = near.select(*context, "term").distinct()
    ours = terms.join(asked.select("kind", "term").distinct(), ["kind", "term"])
    total = ours.groupBy("kind", "term").agg(F.count("*").alias("n"))
    both = ours.join(terms.withColumnRenamed("term", "general"), context).where("term <> general").groupBy("kind", "term", "general").agg(F.count("*").alias("n_both"))
    subsumes = both.join(total, ["kind", "term"]).where(F.col("n_both") >= share * F.col("n")).select("kind", "term", "general")
    safe = told.where(F.col("disclosure") < generalise_at).select("kind", "value", F.col("term").alias("general"), F.col("disclosure").alias("tells"))
    found = asked.join(subsumes, ["kind", "term"]).join(safe, ["kind", "value", "general"])
    return found.groupBy("kind", "value", "term").agg(F.max_by("general", F.struct("tells", "general")).alias("general"))


def find_personal_data(docs: DataFrame, support: int = SUPPORT, generalise_at: float = GENERALISE_AT, remove_at: float = REMOVE_AT) -> tuple[DataFrame, DataFrame]:
    """Rows with entities, and the term spans of rows that have any.

    The first has id (doc_id, null as the largest), text_hash, spans: base spans, one row for each row of `docs` (doc_id, text);
    the second id, text_hash, terms: array<struct<start, end, value, disclosure, action, general>>, sorted. It has a row
    once for an id and text, however often it is repeated. Null and empty texts have no spans; an empty table gives no rows.
    """
    spans = docs.select(row_id().alias("id"), F.xxhash64("text").alias("text_hash"), "text").withColumn("spans", base_spans(F.col("text")))
    near = F.when(F.size("spans") > 0, contexts(F.col("text"), F.col("spans")))
    rows = stored(spans.select("id", "text_hash", "spans", near.alias("near")))  # what a text gives, without the text
    each = rows.where("near is not null")
    near = stored(_free(each.select("id", "text_hash", F.explode("near").alias("t")).select("id", "text_hash", "t.*"), each.select("id", "text_hash", F.explode("spans").alias("span"))))
    told = stored(disclosing_terms(docs.select("text"), near, support))
    action = F.when(F.col("disclosure") >= remove_at, "remove").otherwise("generalise")
    marked = told.where(F.col("disclosure") >= generalise_at).join(general_terms(near, told, generalise_at, remove_at), ["kind", "value", "term"], "left")
    # A place near several entities is judged by the one that it tells most of.
    best = F.max_by("general", F.struct("disclosure", "kind", "value"))
    hits = near.join(marked, ["kind", "value", "term"]).groupBy("id", "text_hash", "start", "end", "term").agg(F.max("disclosure").alias("disclosure"), best.alias("general"))
    span = F.struct("start", "end", F.col("term").alias("value"), "disclosure", action.alias("action"), "general")
    terms = hits.groupBy("id", "text_hash").agg(F.sort_array(F.collect_set(span)).alias("terms"))
    return rows.select("id", "text_hash", "spans"), stored(terms)


def row_id() -> Column:
    return F.coalesce(F.col("doc_id"), F.lit((1 << 63) - 1))


@shielded
def sanitise(docs: DataFrame, support: int = SUPPORT, generalise_at: float = GENERALISE_AT, remove_at: float = REMOVE_AT) -> DataFrame:
    """`docs` with each entity replaced by its kind in brackets, generalised terms by a more general one in brackets ([TERM] where there is none), removed terms by nothing.

    Every row stays, with all its columns; only `text` changes, and a column n_chars with it; a null text stays null. Overlapping spans are
    replaced as one, by the first one's replacement. An empty table gives no rows; repeated rows come out alike.

    Terms are sent to the texts where their size, which is known before, is under BROADCAST_BYTES. Beyond that, texts move, but only those with an entity,
    as terms stand near entities only.
    """
    _, terms = find_personal_data(docs, support, generalise_at, remove_at)
    terms = terms.select(F.col("id").alias("__id"), F.col("text_hash").alias("__hash"), F.col("terms").alias("__terms"))
    spans, keyed = base_spans(F.col("text")), docs.withColumns({"__id": row_id(), "__hash": F.xxhash64("text")})
    term_bytes = F.lit(48) + F.aggregate("__terms", F.lit(0), lambda acc, t: acc + 64 + F.octet_length(t["value"]) + F.coalesce(F.octet_length(t["general"]), F.lit(0)))
    if (terms.agg(F.sum(term_bytes)).first()[0] or 0) <= BROADCAST_BYTES:
        met = keyed.join(F.broadcast(terms), ["__id", "__hash"], "left")
    else:
        any_entity = F.coalesce(F.col("text").rlike("|".join(f"(?:{p})" for p in PATTERNS.values())), F.lit(False))
        met = keyed.where(any_entity).join(terms, ["__id", "__hash"], "left")
        met = met.unionByName(keyed.where(~any_entity).withColumn("__terms", F.lit(None).cast(terms.schema["__terms"].dataType)))
    edit = lambda x, put: F.struct(x["start"].alias("start"), x["end"].alias("end"), put.alias("put"))
    base = F.transform(spans, lambda s: edit(s, F.concat(F.lit("["), F.upper(s["kind"]), F.lit("]"))))
    more = F.transform("__terms", lambda t: edit(t, F.when(t["action"] == "remove", "").otherwise(F.concat(F.lit("["), F.coalesce(t["general"], F.lit("TERM")), F.lit("]")))))
    none = F.array().cast("array<struct<start: int, end: int, put: string>>")
    edits = F.sort_array(F.concat(base, F.coalesce(more, none)))
    done = met.withColumn("__clean", replaced(F.col("text"), edits))
    changed = {"text": F.col("__clean")} | ({"n_chars": F.length("__clean").cast(docs.schema["n_chars"].dataType)} if "n_chars" in docs.columns else {})
    return done.withColumns(changed).select(*docs.columns)


def replaced(text: Column, edits: Column) -> Column:
    """The text with each of the sorted edits (start, end, put) made; one that begins inside an earlier one is left out, and its end counts."""
    piece = "array<struct<begin: int, end: int, put: string>>"  # text up to an edit, and what is put for the edit

    def step(acc: Column, e: Column) -> Column:
        own = F.struct(acc["at"].alias("begin"), e["start"].alias("end"), e["put"].alias("put"))
        return F.struct(F.greatest(acc["at"], e["end"]).alias("at"), F.when(e["start"] >= acc["at"], F.array_append(acc["out"], own)).otherwise(acc["out"]).alias("out"))

    def block(acc: Column, b: Column) -> Column:
        inner = F.aggregate(b, F.struct(acc["at"].alias("at"), F.array().cast(piece).alias("out")), step)
        return _once(inner, lambda i: F.struct(i["at"].alias("at"), F.array_append(acc["out"], i["out"]).alias("out")))

    def written(b: Column) -> Column:
        low = b[0]["begin"]  # a block's pieces are taken from its own stretch of the text, not each from the text's start
        stretch = F.substring(text, low + 1, F.element_at(b, -1)["end"] - low)
        made = _once(stretch, lambda t: F.array_join(F.transform(b, lambda e: F.concat(F.substring(t, e["begin"] - low + 1, e["end"] - e["begin"]), e["put"])), ""))
        return F.when(F.size(b) > 0, made).otherwise("")

    start = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{piece}>").alias("out"))
    whole = lambda d: F.concat(F.array_join(F.transform(d["out"], written), ""), F.substring(text, d["at"] + 1, F.length(text)))
    return _once(edits, lambda e: F.when(F.size(e) > 0, _once(F.aggregate(_blocks(e), start, block), whole)).otherwise(text))


def op2_pii(spark, sf_dir: str) -> DataFrame:
    """Counts and spans of every row of documents. Null and empty texts have none; repeated rows are found alike; an empty table gives no rows."""
    docs = table(spark, sf_dir, "documents")
    rows, terms = find_personal_data(docs)
    text = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    number = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    narrow = rows.select("id", "text_hash", *map(number, KINDS), text(F.col("spans")).alias("base"))
    found = narrow.join(terms, ["id", "text_hash"], "left")
    extra = text(F.transform("terms", lambda t: F.struct(F.lit("term").alias("kind"), t["start"].alias("start"), t["end"].alias("end"))))
    return found.select(
        F.when(F.col("id") != (1 << 63) - 1, F.col("id")).alias("doc_id"),
        *(f"n_{kind}" for kind in KINDS),
        F.sha2(F.col("base").cast("binary"), 256).alias("base_sha256"),
        F.concat_ws(",", F.nullif("base", F.lit("")), F.nullif(extra, F.lit(""))).alias("spans"),
        F.coalesce(F.size("terms"), F.lit(0)).cast("long").alias("n_term"),
    )
