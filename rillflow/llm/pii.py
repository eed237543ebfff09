"""Personal data: pattern findings plus information-theoretic sanitisation, in DataFrame functions only.

Patterns find the protected entities: every e-mail, IP, card and phone value is one, and so is each of the four
classes as a whole. Corpus co-occurrence then estimates how strongly a term reveals an entity e. The context of
a finding is the text on either side, CONTEXT code points at most and up to the next match of its pattern. With
n(e) terms standing in contexts of e, n(e, t) of them t, cf(t) occurrences of t and T of all terms in the corpus,

    PMI(e; t) = log2( n(e, t) * T / (n(e) * cf(t)) )      IC(e) = log2( T / n(e) )

and the disclosure PMI / IC is 1 for a term that occurs only beside e. What may be chance doesn't count: of cf(t)
occurrences, each beside e with probability p = n(e) / T, so many stand there with a probability of at most
exp(-cf(t) * KL(n(e, t) / cf(t) || p)) (Chernoff), which must not be over CHANCE divided by the number of pairs.
A term's disclosure is its highest. Wherever they stand in any text, terms at or above REMOVE_AT are removed and
those at or above GENERALISE_AT become the class of the entity that they reveal most, as <class-term>.

Spans and masks are functions of one text and of the disclosing terms in it. These are few beside the texts and are
joined to them: a broadcast while their number is within BROADCAST_HITS, so that texts don't cross the network.

Defined results: a null or empty text has no findings (zero counts, the digest of the empty string,
empty spans); repeated rows give repeated results; a null doc_id is kept; an empty table gives an
empty result; extra columns of the input, whatever their names, pass through sanitise() and are ignored by report().
Work on a text is in proportion to its length, times a logarithm of its matches.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import sized_broadcast, stored, whole_row

KINDS = ("email", "ip", "card", "phone")
#: A start inside a run that failed fails as well, so each run is tried once: linear on long runs.
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[ -]?[0-9])++",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
#: Method spans: terms removed or generalised.
TERM_KINDS = ("term_removed", "term_generalised")
OCTET = "0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])"
#: Code points on either side of a finding that count as its context.
CONTEXT = 64
#: The probability that any term at all is taken for a disclosing one by chance.
CHANCE = 0.05
GENERALISE_AT, REMOVE_AT = 0.85, 0.95
#: Texts with disclosing terms that are broadcast, by keys and terms (some hundred bytes each); more are joined by a shuffle.
BROADCAST_HITS = 1 << 17
#: Code points in a piece of a text that is cut.
PIECE = 1024
TERM, NO_TERM = r"[\p{L}\p{N}]+", r"[^\p{L}\p{N}]+"
FINDING, SPAN = "array<struct<s:int,e:int,m:string,l:string,r:string>>", "array<struct<s:int,e:int,k:int,l:string>>"


def _none(kind: str) -> Column:
    return F.expr(f"cast(array() as {kind})")


def scanned(values: Column, n: Column, merge: Callable[[Column, Column], Column]) -> Column:
    """The running merge of an array of n values: by doubling, as appending one by one would copy the array each time."""
    back = lambda j: F.call_function("shiftleft", F.lit(1), j)
    steps = F.sequence(F.lit(0), F.ceil(F.log2(F.greatest(n, F.lit(1)))).cast("int"))
    return F.aggregate(steps, values, lambda acc, j: F.transform(acc, lambda v, i: merge(v, F.get(acc, i - back(j)))))


def placed(found: Column, gaps: Column) -> Column:
    """array<struct<s, e, m, l, r>>: matches with code-point offsets, end exclusive, and the text up to the neighbouring ones."""
    n = F.size(found)
    ends = scanned(F.zip_with(found, F.slice(gaps, F.lit(1), n), lambda m, g: F.length(m) + F.length(g)), n, lambda v, w: v + F.coalesce(w, F.lit(0)))
    rows = F.arrays_zip(found.alias("m"), ends.alias("e"), F.slice(gaps, F.lit(1), n).alias("l"), F.slice(gaps, F.lit(2), n).alias("r"))
    span = lambda x: F.struct((x["e"] - F.length(x["m"])).alias("s"), x["e"].alias("e"), x["m"].alias("m"), x["l"].alias("l"), x["r"].alias("r"))
    return F.when(n > 0, F.transform(rows, span)).otherwise(_none(FINDING))


def luhn(digits: Column) -> Column:
    def add(acc: Column, i: Column) -> Column:
        d = F.substring(digits, F.length(digits) - i, F.lit(1)).cast("int")
        d = F.when(i % 2 == 1, F.when(d > 4, 2 * d - 9).otherwise(2 * d)).otherwise(d)
        return acc + d

    return F.aggregate(F.sequence(F.lit(0), F.length(digits) - 1), F.lit(0), add) % 10 == 0


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


KEEP = {
    "email": lambda m: F.lit(True),
    "ip": lambda m: m.rlike(rf"^{OCTET}(?:\.{OCTET}){{3}}$"),
    "card": lambda m: F.when(F.length(_digits(m)).between(16, 19), luhn(_digits(m))).otherwise(F.lit(False)),
    "phone": lambda m: F.length(_digits(m)).between(8, 15),
}
GUARDS = {
    "email": lambda t: t.contains("@"),
    "ip": lambda t: t.contains("."),
    "card": lambda t: F.lit(True),
    "phone": lambda t: t.contains("+"),
}


def _kept(kind: str) -> Column:
    return F.filter(placed(F.col(f"m_{kind}"), F.col(f"g_{kind}")), lambda x: KEEP[kind](x["m"]))


def with_findings(d: DataFrame, *keep: str) -> DataFrame:
    """``keep``, text and an array of findings per kind, from ``keep`` and text (not null).

    Step by step, so that each pattern runs over a text once."""
    text = F.col("text")
    d = d.select(*keep, "text", *[F.when(GUARDS[k](text), F.regexp_extract_all(text, F.lit(PATTERNS[k]), F.lit(0))).otherwise(_none("array<string>")).alias(f"m_{k}") for k in KINDS])
    d = d.select(*keep, "text", *[f"m_{k}" for k in KINDS], *[F.when(F.size(f"m_{k}") > 0, F.split(text, PATTERNS[k], -1)).otherwise(_none("array<string>")).alias(f"g_{k}") for k in KINDS])
    return d.select(*keep, "text", *[_kept(k).alias(k) for k in KINDS])


def context(x: Column, length: Column) -> Column:
    """The terms around a finding. A run that touches the edge of the context may go on beyond it and is left out, but at the text's own."""
    left = F.concat(F.when((x["s"] == F.length(x["l"])) & (x["s"] <= CONTEXT), " ").otherwise(""), F.right(x["l"], F.lit(CONTEXT)))
    right = F.concat(F.left(x["r"], F.lit(CONTEXT)), F.when((x["e"] + F.length(x["r"]) == length) & (F.length(x["r"]) <= CONTEXT), " ").otherwise(""))
    words = lambda side: F.split(side, NO_TERM)
    inner = lambda side: F.slice(words(side), F.lit(2), F.greatest(F.size(words(side)) - 2, F.lit(0)))
    return F.transform(F.filter(F.concat(inner(left), inner(right)), lambda w: w != ""), F.lower)


def _texts(docs: DataFrame, *keep: Column | str) -> DataFrame:
    return docs.select(*keep, F.coalesce("text", F.lit("")).alias("text"))


def disclosing_terms(docs: DataFrame) -> DataFrame:
    """term, k (in TERM_KINDS), kind (in KINDS), disclosure: the terms that reveal an entity at GENERALISE_AT or above, stored."""
    found = with_findings(_texts(docs)).withColumn("size", F.length("text"))
    of_kind = lambda i: F.transform(KINDS[i], lambda x: F.struct(F.lit(i).alias("kind"), F.xxhash64(F.lit(i), F.lower(x["m"])).alias("value"), context(x, F.col("size")).alias("terms")))
    every = F.concat(*map(of_kind, range(len(KINDS))))
    beside = found.filter(" OR ".join(f"size({k}) > 0" for k in KINDS)).select(F.explode(every).alias("x")).select("x.kind", "x.value", F.explode("x.terms").alias("term"))
    beside = beside.groupBy("kind", "value", "term").agg(F.count(F.lit(1)).alias("n"))
    # an entity is a value, or (null) the class
    of_class = F.struct("kind", F.lit(None).cast("long").alias("value"))
    pairs = beside.select(F.explode(F.array(F.struct("kind", "value"), of_class)).alias("entity"), "term", "n")
    pairs = stored(pairs.groupBy("entity", "term").agg(F.sum("n").alias("n")), "pii-pairs")
    entities = stored(pairs.groupBy("entity").agg(F.sum("n").alias("n_entity")), "pii-entities")
    words = _texts(docs).select(F.filter(F.split("text", NO_TERM), lambda w: w != "").alias("words"))
    total = max(words.agg(F.sum(F.size("words"))).first()[0] or 0, 2)
    candidates = stored(pairs.select("term").distinct(), "pii-candidates")
    counts = words.select(F.explode("words").alias("word")).select(F.lower("word").alias("term")).join(sized_broadcast(candidates), "term", "left_semi").groupBy("term").agg(F.count(F.lit(1)).alias("cf"))
    joined = pairs.join(counts, "term").join(entities, "entity")
    n_entity = F.least(F.col("n_entity"), F.lit(total - 1))
    disclosure = F.log2(F.col("n") * F.lit(float(total)) / (n_entity * F.col("cf"))) / F.log2(F.lit(float(total)) / n_entity)
    # an occurrence between two findings counts for both, so n may be over cf
    q, p = F.least(F.lit(1.0), F.col("n") / F.col("cf")), n_entity / F.lit(float(total))
    kl = q * F.log(q / p) + F.when(q < 1, (1 - q) * F.log((1 - q) / (1 - p))).otherwise(0.0)
    sure = (q > p) & (F.col("cf") * kl >= math.log(max(pairs.count(), 1) / CHANCE))
    strong = joined.filter(sure).select("term", "entity.kind", disclosure.alias("disclosure")).filter(F.col("disclosure") >= GENERALISE_AT)
    best = strong.groupBy("term").agg(F.max(F.struct("disclosure", (-F.col("kind")).alias("kind"))).alias("b"))
    return stored(best.select("term", F.when(F.col("b.disclosure") >= REMOVE_AT, 0).otherwise(1).alias("k"), (-F.col("b.kind")).alias("kind"), "b.disclosure"), "pii-strong")


def with_spans(docs: DataFrame) -> DataFrame:
    """row (all columns), text, an array of findings per kind, and ``terms``: array<struct<s, e, k, l>> of disclosing
    terms outside of them, k in TERM_KINDS, l what replaces them."""
    strong = disclosing_terms(docs).select("term", "k", "kind")
    texts = _texts(docs, "doc_id").select(F.xxhash64("doc_id", "text").alias("d"), F.xxhash64("text").alias("h"), F.array_distinct(F.split("text", NO_TERM)).alias("w"))
    hits = texts.select("d", "h", F.explode("w").alias("w")).select("d", "h", F.lower("w").alias("term")).join(sized_broadcast(strong), "term")
    hits = stored(hits.groupBy("d", "h").agg(F.collect_set(F.struct("term", "k", "kind")).alias("strong")), "pii-hits")
    d = _texts(docs, whole_row(docs)).select("row", "text", F.xxhash64("row.doc_id", "text").alias("d"), F.xxhash64("text").alias("h"))
    d = d.join(sized_broadcast(hits, BROADCAST_HITS), ["d", "h"], "left").select("row", "text", "strong", F.col("strong").isNotNull().alias("some"))
    is_strong = lambda w: F.exists("strong", lambda x: x["term"] == F.lower(w))
    label = lambda w: F.get(F.filter("strong", lambda x: x["term"] == F.lower(w)), F.lit(0))
    d = with_findings(d, "row", "strong", "some")
    d = d.select("*", F.when(F.col("some"), F.regexp_extract_all("text", F.lit(TERM), F.lit(0))).otherwise(_none("array<string>")).alias("m"), F.when(F.col("some"), F.split("text", TERM, -1)).otherwise(_none("array<string>")).alias("g"))

    def span(x: Column) -> Column:
        t = label(x["m"])
        words = F.when(t["k"] == 0, "").otherwise(F.concat(F.lit("<"), F.get(F.array(*map(F.lit, KINDS)), t["kind"]), F.lit("-term>")))
        return F.struct(x["s"].alias("s"), x["e"].alias("e"), t["k"].cast("int").alias("k"), words.alias("l"))

    terms = F.transform(F.filter(placed(F.col("m"), F.col("g")), lambda x: is_strong(x["m"])), span)
    d = d.select("row", "text", *KINDS, terms.cast(SPAN).alias("terms"))
    return d.select("row", "text", *KINDS, outside("terms", *KINDS).alias("terms"))


def outside(terms: str, *kinds: str) -> Column:
    """The terms that no finding overlaps. With all spans in order, a finding that begins before a term overlaps it
    if the last end so far is beyond the term's start, and one that begins in it is the first from there on."""
    both = F.array_sort(F.concat(*[F.transform(k, lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"), F.lit(-1).alias("k"), F.lit("").alias("l"))) for k in kinds], F.col(terms)))
    n = sum((F.size(k) for k in kinds), F.size(terms))
    reached = scanned(F.transform(both, lambda x: F.when(x["k"] < 0, x["e"]).otherwise(-1)), n, lambda v, w: F.greatest(v, w))
    begins = F.reverse(scanned(F.reverse(F.transform(both, lambda x: F.when(x["k"] < 0, x["s"]).otherwise(2**31 - 1))), n, lambda v, w: F.least(v, w)))
    free = F.filter(F.arrays_zip(both.alias("x"), reached.alias("r"), begins.alias("b")), lambda y: (y["x"]["k"] >= 0) & (y["r"] <= y["x"]["s"]) & (y["b"] >= y["x"]["e"]))
    some = sum((F.size(k) for k in kinds), F.lit(0)) > 0
    return F.when((F.size(terms) > 0) & some, F.transform(free, lambda y: y["x"])).otherwise(F.col(terms))


def _named(spans: Column | str, kind: str) -> Column:
    return F.transform(spans, lambda x: F.concat_ws(":", F.lit(kind), x["s"].cast("string"), x["e"].cast("string")))


def report(docs: DataFrame) -> DataFrame:
    """doc_id, a count per kind, base_sha256 and spans, as text."""
    base = [_named(k, k) for k in KINDS]
    of = lambda i: F.filter("terms", lambda t: t["k"] == i)
    extra = [_named(of(i), n) for i, n in enumerate(TERM_KINDS)]
    return with_spans(docs.select("doc_id", "text")).select(
        "row.doc_id",
        *[F.size(k).cast("long").alias(f"n_{k}") for k in KINDS],
        F.sha2(F.array_join(F.concat(*base), ","), 256).alias("base_sha256"),
        F.array_join(F.concat(*base, *extra), ",").alias("spans"),
        F.size("terms").cast("long").alias("n_terms"),
    )


def masked(marks: str, pieces: str) -> Column:
    """The text, given in pieces of PIECE code points, with the marks (array<struct<s, e, l>> in order) replaced.

    Overlapping marks are merged from the left: the first keeps its label, the rest extend it."""
    n = F.size(marks)
    reached = scanned(F.transform(marks, lambda x: x["e"]), n, lambda v, w: F.greatest(v, w))
    steps = F.zip_with(marks, F.concat(F.array(F.lit(0)), reached), lambda x, p: F.struct(p.alias("p"), x["s"].alias("s"), x["l"].alias("l")))

    def between(p: Column, q: Column) -> Column:
        a, b = F.floor(p / PIECE).cast("int"), F.floor(q / PIECE).cast("int")
        at = lambda i: F.coalesce(F.get(pieces, i), F.lit(""))
        inner = F.array_join(F.slice(pieces, a + 2, F.greatest(b - a - 1, F.lit(0))), "")
        return F.when(a == b, F.substring(at(a), p % PIECE + 1, q - p)).otherwise(F.concat(F.substring(at(a), p % PIECE + 1, F.lit(PIECE)), inner, F.substring(at(b), F.lit(1), q % PIECE)))

    fresh = F.filter(steps, lambda x: x["l"].isNotNull() & (x["s"] >= x["p"]))
    head = F.array_join(F.transform(fresh, lambda x: F.concat(between(x["p"], x["s"]), x["l"])), "")
    last = F.array_max(F.transform(marks, lambda x: x["e"]))
    return F.concat(head, between(last, PIECE * F.size(pieces)))


def sanitise(docs: DataFrame) -> DataFrame:
    """The documents with findings replaced by <kind>, strong terms removed and weaker ones generalised."""
    labelled = lambda k: F.transform(k, lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"), F.lit(f"<{k}>").alias("l")))
    at = with_spans(docs).select("row", F.array_sort(F.concat(*[labelled(k) for k in KINDS], F.transform("terms", lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"), x["l"].alias("l"))))).alias("marks"), "text")
    at = at.select("row", "marks", F.when(F.size("marks") > 0, F.regexp_extract_all("text", F.lit(rf"(?s).{{1,{PIECE}}}"), F.lit(0))).alias("pieces"))
    at = at.select("row", F.when(F.size("marks") > 0, masked("marks", "pieces")).otherwise(F.col("row.text")).alias("text"))
    new = {"text": F.col("text")}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.length("text").cast(docs.schema["n_chars"].dataType)
    return at.select(*[new.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns])
