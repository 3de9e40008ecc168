"""Personal data: fixed patterns for four kinds, and further identifiers by bootstrapped contextual
extraction (Riloff & Jones 1999; Agichtein & Gravano 2000). DataFrame expressions only.

The *base* patterns find e-mail and IP addresses, card and phone numbers; leftmost matches that don't
overlap, per kind, those that fail their check (parts up to 255, Luhn sum, number of digits) dropped.
They are the seeds. The rest of a text is searched for *candidates*: tokens that look like identifiers
(``least_digits`` digits or an @) but are no base span.

The *context* of a seed or candidate is the pair of words (runs of letters, lower case) just before it. The
mentions form a bipartite graph of contexts and instances, and rounds of scoring go back and forth:

* a context's confidence for a kind is the confidence of the instances that it precedes, summed over its
  mentions, divided by how often the pair of words occurs in the whole corpus, whatever follows.
  It counts from ``least_support`` different instances on, and from ``confident`` on;
* an instance's confidence is 1 for seeds, otherwise 1 − Π (1 − confidence of a context that it follows).

Candidates that end with ``confident`` or more for a kind are spans of that kind, wherever they are
mentioned.

Offsets are code points from 0, the end exclusive. A row's spans follow from its own text and the corpus's
contexts; repeated rows get the same spans. Null and empty texts have no spans; null ids are kept.
Further columns of the input are not read. Empty tables give an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from duoglot.llm.common import stored, text_key
from duoglot.operators.skew import hot_keys, salted_join

# Kinds in the order of the results.
KINDS = ("email", "ip", "card", "phone")
# The same matches as the plain patterns give: possessive quantifiers where what follows cannot
# occur in the run, and no attempt inside a run whose start has failed (a run of a million letters
# costs one pass). \G is the end of the match before.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
# Texts without this have no match.
HINTS = {"email": "@[A-Za-z0-9-]", "ip": r"[0-9]\.[0-9]", "card": r"[0-9][\x20-]?[0-9]", "phone": r"\+[0-9]"}
CANDIDATE = (r"(?<![\p{L}\p{N}@._/:#+-])[A-Za-z._/:#+-]*+[0-9@][A-Za-z0-9@._/:#+-]*+"
             r"(?:\x20[0-9][A-Za-z0-9@._/:#+-]*+)*+")
WORD = r"\p{L}+"
CONTEXT = r"[^\p{L}](\p{L}+)[^\p{L}]{1,3}(\p{L}+)[^\p{L}\p{N}]{1,4}$"
CONTEXT_CHARS = 64
BLOCK = 256
BROADCAST_CONTEXTS = 1_000_000
HOT_ROWS = 100_000
# Contexts are counted in the first 1, 16 and 256 of 256 parts of the corpus in turn.
PARTS = (1, 16, 256)


def _running(values: Column) -> Column:
    """Sum of the values before each one. Blocks of 256: the work grows far less than with
    the square of the number of values, though arrays are copied when they are appended to."""
    def scan(part: Column, start: Column) -> Column:
        return F.aggregate(
            part, F.struct(start.alias("at"), F.array().cast("array<int>").alias("out")),
            lambda acc, v: F.struct((acc["at"] + v).alias("at"), F.array_append(acc["out"], acc["at"]).alias("out")),
            lambda acc: acc["out"])

    def blocks(x: Column) -> Column:
        return F.when(F.size(x) > 0, F.transform(
            F.sequence(F.lit(1), F.size(x), F.lit(BLOCK)), lambda at: F.slice(x, at, BLOCK))
        ).otherwise(F.array().cast("array<array<int>>"))

    parts = blocks(values)
    sums = F.transform(parts, lambda p: F.aggregate(p, F.lit(0), lambda acc, v: acc + v))
    starts = scan(sums, F.lit(0))
    return F.flatten(F.zip_with(parts, starts, scan))


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    """Whether the check sum of a string of digits is a multiple of 10."""
    n = F.length(digits)

    def share(at: Column) -> Column:
        value = F.substr(digits, at, F.lit(1)).cast("int")
        doubled = F.when(value > 4, 2 * value - 9).otherwise(2 * value)
        return F.when((n - at) % 2 == 1, doubled).otherwise(value)

    return F.aggregate(F.sequence(F.lit(1), n), F.lit(0), lambda acc, at: acc + share(at)) % 10 == 0


def _valid(kind: str, value: Column) -> Column:
    if kind == "ip":
        return F.forall(F.split(value, r"\."), lambda part: (F.length(F.ltrim(part, F.lit("0"))) <= 3) & (
            F.coalesce(F.right(part, F.lit(3)).cast("int"), F.lit(0)) <= 255))
    if kind == "card":
        n = F.length(_digits(value))
        return F.when(n.between(13, 19), _luhn(_digits(value))).otherwise(False)
    if kind == "phone":
        return F.length(_digits(value)).between(9, 15)
    return F.lit(True)


def _context(piece: Column) -> Column:
    """The two words at the end of the text between the match before and this one, or null. The
    last 64 characters are looked at; a word that reaches beyond them is none."""
    window = F.when(F.length(piece) <= CONTEXT_CHARS, F.concat(F.lit(" "), piece)).otherwise(
        F.right(piece, F.lit(CONTEXT_CHARS)))
    first = F.regexp_extract(window, CONTEXT, 1)
    return F.when(first != "", F.xxhash64(F.lower(first), F.lower(F.regexp_extract(window, CONTEXT, 2))))


def _found(df: DataFrame, pattern: str, hint: str, name: str, text: str, valid) -> DataFrame:
    """Add ``name``: the matches as ``(start, end, value, context, valid)``, in order."""
    empty = F.array().cast("array<string>")
    df = df.withColumn("_values", F.when(F.col(text).rlike(hint), F.regexp_extract_all(
        text, F.lit(pattern), F.lit(0))).otherwise(empty))
    # One more piece than matches: the text around them.
    df = df.withColumn("_pieces", F.when(F.size("_values") > 0, F.split(text, pattern, -1)).otherwise(empty))
    df = df.withColumn("_gaps", F.zip_with(F.slice("_pieces", 1, F.size("_values")), "_values",
                                           lambda p, v: F.length(p) + F.length(v)))
    df = df.withColumn("_starts", _running(F.col("_gaps")))
    df = df.withColumn(name, F.transform(
        F.arrays_zip(F.col("_starts").alias("a"), F.col("_pieces").alias("p"), F.col("_values").alias("v")),
        lambda m: F.struct((m["a"] + F.length(m["p"])).alias("start"),
                           (m["a"] + F.length(m["p"]) + F.length(m["v"])).alias("end"),
                           F.lower(m["v"]).alias("value"), _context(m["p"]).alias("context"),
                           F.coalesce(valid(m["v"]), F.lit(False)).alias("valid"))))
    # arrays_zip has a last entry for the piece behind the last match.
    return df.withColumn(name, F.slice(name, 1, F.size("_values"))).drop("_gaps", "_starts")


def mentions(docs: DataFrame, least_digits: int = 4) -> DataFrame:
    """``(doc_id, key, seeds, candidates)`` of every row: base spans ``(kind, start, end, value, context)``,
    kinds numbered in their order, and candidates ``(start, end, value, context)``."""
    df = docs.select("doc_id", text_key().alias("key"), F.col("text").cast("string").alias("_text"))
    df = df.withColumn("_rest", F.col("_text"))
    for kind in KINDS:
        df = _found(df, PATTERNS[kind], HINTS[kind], f"_{kind}", "_text", lambda v, k=kind: _valid(k, v))
        # In the rest of the text the spans are blotted out, character by character.
        df = _found(df, PATTERNS[kind], HINTS[kind], "_again", "_rest", lambda v, k=kind: _valid(k, v))
        blotted = F.zip_with("_pieces", F.concat(F.zip_with(
            "_values", "_again", lambda v, m: F.when(m["valid"], F.repeat(F.lit("\x01"), F.length(v))).otherwise(v)),
            F.array(F.lit(""))), lambda p, v: F.concat(p, v))
        df = df.withColumn("_rest", F.when(F.exists("_again", lambda m: m["valid"]), F.array_join(blotted, ""))
                           .otherwise(F.col("_rest"))).drop("_again", "_values", "_pieces")
    df = _found(df, CANDIDATE, "[0-9@]", "_more", "_rest", lambda v: F.lit(True))

    def of_kind(number: int, spans: str) -> Column:
        return F.transform(F.filter(spans, lambda m: m["valid"]), lambda m: F.struct(
            F.lit(number).alias("kind"), m["start"].alias("start"), m["end"].alias("end"),
            m["value"].alias("value"), m["context"].alias("context")))

    seeds = F.concat(*[of_kind(number, f"_{kind}") for number, kind in enumerate(KINDS)])

    def trimmed(m: Column) -> Column:
        core = F.rtrim(m["value"], F.lit("._/:#+-@"))
        inner = F.ltrim(core, F.lit("._/:#-@"))
        start = m["start"] + F.length(core) - F.length(inner)
        return F.struct(start.alias("start"), (start + F.length(inner)).alias("end"),
                        inner.alias("value"), m["context"].alias("context"))

    likely = F.filter(F.transform("_more", trimmed), lambda m: (
        F.length(_digits(m["value"])) >= least_digits) | m["value"].contains("@"))
    nothing = F.array()

    def or_none(spans: Column, kind: str) -> Column:
        return F.coalesce(spans, nothing.cast(kind)).cast(kind)

    return df.select(
        "doc_id", "key",
        or_none(seeds, "array<struct<kind:int,start:int,end:int,value:string,context:bigint>>").alias("seeds"),
        or_none(likely, "array<struct<start:int,end:int,value:string,context:bigint>>").alias("candidates"))


def _small(df: DataFrame, bound: int = BROADCAST_CONTEXTS) -> DataFrame:
    """Broadcast a stored table of narrow rows up to a counted bound."""
    return F.broadcast(df) if df.limit(bound + 1).count() <= bound else df


def context_counts(docs: DataFrame, contexts: DataFrame, confident: float) -> DataFrame:
    """``(context, occurrences)``: how often the pairs of words of ``(context, mentions)`` occur, one next to
    the other, in the whole corpus; only for those that can still be confident.

    The corpus is counted in disjoint parts that grow. A context that has occurred more than ``mentions /
    confident`` times cannot become confident whatever the rest of the corpus holds, and is not
    counted any further: very common pairs are given up after a small part, and what the
    later joins find is in proportion to the mentions."""
    part = F.pmod(text_key(), F.lit(PARTS[-1]))
    counted = contexts.select("context", "mentions", F.lit(0).cast("bigint").alias("occurrences"))
    low = 0
    for high in PARTS:
        open_ = stored(counted.where(F.col("occurrences") * confident <= F.col("mentions")), "personal-open")
        lower = docs.where((part >= low) & (part < high)).select(
            F.regexp_extract_all(F.lower("text"), F.lit(WORD), F.lit(0)).alias("w"))
        pairs = lower.where(F.size("w") > 1).select(F.explode(F.zip_with(
            F.slice("w", 1, F.size("w") - 1), F.slice("w", 2, F.size("w") - 1),
            lambda a, b: F.xxhash64(a, b))).alias("context"))
        more = pairs.join(_small(open_.select("context")), "context", "left_semi").groupBy("context").agg(
            F.count(F.lit(1)).alias("n"))
        counted = open_.join(more, "context", "left").select(
            "context", "mentions", (F.col("occurrences") + F.coalesce("n", F.lit(0))).alias("occurrences"))
        low = high
    return counted.select("context", "occurrences")


def score_graph(edges: DataFrame, occurrences: DataFrame, least_support: int, confident: float,
                rounds: int) -> DataFrame:
    """``(kind, value)`` of the candidates that end up confident.

    ``edges`` is ``(context, value, kind, n)``: kind null for candidates. Every round joins contexts
    and instances once in either direction; a context that precedes very many instances is
    spread over several tasks."""
    edges = stored(edges, "personal-edges")
    seeds = edges.where("kind IS NOT NULL").select("context", "value", "kind", "n", F.lit(1.0).alias("c"))
    open_edges = edges.where("kind IS NULL").select("context", "value", "n")
    sizes = open_edges.groupBy("context").agg(F.count(F.lit(1)).alias("m"))
    hot = stored(hot_keys(sizes, ["context"], "m", 0, HOT_ROWS), "personal-hot")
    found = None
    for _ in range(rounds):
        known = seeds
        if found is not None:
            known = known.unionByName(open_edges.join(_small(found), "value").select(
                "context", "value", "kind", "n", "c"))
        scored = known.groupBy("context", "kind").agg(
            F.sum(F.col("n") * F.col("c")).alias("mass"), F.count(F.lit(1)).alias("support"))
        contexts = stored(scored.where(F.col("support") >= least_support).join(occurrences, "context").select(
            "context", "kind", F.least(F.lit(1.0), F.col("mass") / F.col("occurrences")).alias("confidence"))
            .where(F.col("confidence") >= confident), "personal-contexts")
        reached = salted_join(open_edges, contexts, ["context"], "value", hot)
        # The value joined last is the least certain: 1 - product of (1 - confidence).
        doubt = F.sum(F.log(F.greatest(1 - F.col("confidence"), F.lit(1e-12))))
        found = stored(reached.groupBy("value", "kind").agg((1 - F.exp(doubt)).alias("c"))
                       .where(F.col("c") >= confident), "personal-found")
    return found.select("kind", "value")


def spans_of(spans: str, kind: str) -> Column:
    """How many of the spans are of a kind."""
    number = KINDS.index(kind)
    return F.size(F.filter(spans, lambda m: m["kind"] == number)).cast("bigint")


def _listed(spans: Column) -> Column:
    """``kind:start:end``, by kind and start, joined by commas."""
    names = F.array(*[F.lit(k) for k in KINDS])
    ordered = F.array_sort(F.transform(spans, lambda m: F.struct(
        m["kind"].alias("kind"), m["start"].alias("start"), m["end"].alias("end"))))
    return F.array_join(F.transform(ordered, lambda m: F.concat_ws(
        ":", names[m["kind"]], m["start"].cast("string"), m["end"].cast("string"))), ",")


def personal_data(docs: DataFrame, least_support: int = 3, confident: float = 0.8, rounds: int = 3,
                  least_digits: int = 4) -> DataFrame:
    """``(doc_id, seeds, more, base, spans)`` of every row: base spans and discovered ones as arrays of
    ``(kind, start, end)``, and both lists as text (base only; all)."""
    rows = stored(mentions(docs, least_digits), "personal-mentions")
    unseen = rows.select("key", F.explode("candidates").alias("m")).select("key", "m.*")
    edges = rows.select(F.explode("seeds").alias("m")).select("m.context", "m.value", "m.kind").unionByName(
        unseen.select("context", "value", F.lit(None).cast("int").alias("kind"))).where(
        "context IS NOT NULL").groupBy("context", "value", "kind").agg(F.count(F.lit(1)).alias("n"))
    edges = stored(edges, "personal-graph")
    # Only contexts of enough instances can ever count.
    supported = edges.groupBy("context").agg(F.count(F.lit(1)).alias("support"), F.sum("n").alias("mentions"))
    occurrences = stored(context_counts(docs, supported.where(F.col("support") >= least_support), confident),
                         "personal-occurrences")
    found = score_graph(edges, occurrences, least_support, confident, rounds)

    sizes = unseen.groupBy("value").agg(F.count(F.lit(1)).alias("m"))
    hot = hot_keys(sizes, ["value"], "m", 0, HOT_ROWS)
    more = salted_join(unseen, found, ["value"], "key", hot).groupBy("key").agg(
        F.collect_set(F.struct("kind", "start", "end")).alias("more"))
    none = F.array().cast("array<struct<kind:int,start:int,end:int>>")
    plain = F.transform("seeds", lambda m: F.struct(
        m["kind"].alias("kind"), m["start"].alias("start"), m["end"].alias("end")))
    joined = rows.select("doc_id", "key", plain.alias("seeds")).join(
        _small(stored(more, "personal-more")), "key", "left").withColumn("more", F.coalesce("more", none))
    return joined.select("doc_id", "seeds", "more", _listed(F.col("seeds")).alias("base"),
                         _listed(F.concat("seeds", "more")).alias("spans"))
