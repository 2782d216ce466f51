"""Personal data: fixed patterns, and identifiers found by bootstrapped context.

DataFrame functions only. Base spans are the matches of four patterns with their checks. They seed the bootstrapping:

* an instance is an identifier by its value: the text of a base span (a seed), or an identifier-like token outside all base
  spans (a word of LEAST_CHARS characters or more that holds a digit; words end at white space, quotes, brackets and = , ; |);
* a pattern is lexical: the one, two or three words before or after an instance, or the four letters that a value begins with.
  Context words are lower-cased and read from the WINDOW characters before and after, the same for every instance;
* patterns and instances form a bipartite graph with one edge a pair of distinct pattern and value, so that copies of a text
  count once. In each of ROUNDS rounds a pattern with F accepted values of N scores F / N * log2(1 + F); it is trusted with
  F >= MIN_SUPPORT, F / N >= MIN_SHARE and a score of MIN_SCORE or more. The values of trusted patterns are accepted in
  turn, which lets further patterns reach the scores: "the" leads to a token, the token to "token =", that to all its values.

Accepted tokens that overlap no base span are added. A pattern's kind is that of at least
MIN_SHARE_OF_KIND of its accepted values, else "other" (identifiers of none of the four kinds); a token takes the kind of its
best pattern of one of the four kinds, or else "other".
A context that merely happens to precede seeds has many other identifier-like fillers, and scores low.

Scores and counts are aggregations over all documents with map-side combination, over written tables that Spark can split;
nothing of the graph reaches the driver. Positions are in code points.

Defined cases: null text is empty; a document without a match returns zero counts and empty strings; overlapping matches of
different kinds are all kept; rows that repeat a doc_id each come back with the spans of all of them added; a token of fewer
than LEAST_CHARS characters is no instance; other columns of documents are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, staged, table

KINDS = ("email", "ip", "card", "phone")
OTHER = "other"
MIN_SUPPORT = 3
MIN_SHARE = 0.3
MIN_SCORE = 1.2
MIN_SHARE_OF_KIND = 0.6
ROUNDS = 4
LEAST_CHARS = 5
WINDOW = 64
#: Matches whose places are summed up in one go: copying grows with the square of this, not of a text's matches.
CHUNK = 256

# Each pattern finds what the contract's pattern finds, leftmost and non-overlapping, without its backtracking: a match can
# start only where no longer run of the same characters started it, or where the last match ended.
_EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
_IP = r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
_PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
#: A separator is part of a card only between two digits; the others are first replaced, character for character.
_LONE = r"(?<![0-9])[\x20-]|[\x20-](?![0-9])"
_CARD = r"[0-9][0-9\x20-]{13,}+"
_CARD_HINT = r"[0-9](?:[\x20-]?[0-9]){13}"
_BREAK = r"\x20\x09-\x0D=,;|\"'`<>()\[\]{}"
_TOKEN = rf"(?<![^{_BREAK}])[^{_BREAK}0-9]*+[0-9][^{_BREAK}]*+"


def _bound(value: Column, body) -> Column:
    """body of value, which is worked out once however often body names it (also inside lambdas)."""
    return F.element_at(F.transform(F.array(value), body), 1)


def matches(text: Column, pattern: str) -> Column:
    """array<struct<at, to, value>> of a pattern's matches: their places follow from the lengths of what lies between them."""
    between = F.split(text, pattern, -1)
    sized = F.zip_with(F.slice(between, F.lit(1), F.size(between) - 1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda gap, value: F.struct(F.length(gap).alias("gap"), value.alias("value")))
    span = "struct<at:int,to:int,value:string>"

    def placed(chunk: Column, pos: Column) -> Column:
        start = F.struct(pos.alias("pos"), F.array().cast(f"array<{span}>").alias("out"))

        def step(state: Column, m: Column) -> Column:
            at = state["pos"] + m["gap"]
            to = at + F.length(m["value"])
            one = F.struct(at.alias("at"), to.alias("to"), m["value"].alias("value"))
            return F.struct(to.alias("pos"), F.concat(state["out"], F.array(one)).alias("out"))

        return F.aggregate(chunk, start, step, lambda state: state["out"])

    def in_chunks(chunks: Column) -> Column:
        length = lambda chunk: F.aggregate(chunk, F.lit(0), lambda n, m: n + m["gap"] + F.length(m["value"]))
        before = lambda lengths: F.transform(lengths, lambda _, i: F.aggregate(F.slice(lengths, F.lit(1), i), F.lit(0), lambda n, m: n + m))
        return F.flatten(F.zip_with(chunks, _bound(F.transform(chunks, length), before), placed))

    def cut(every: Column) -> Column:
        starts = F.sequence(F.lit(1), F.size(every), F.lit(CHUNK))
        return _bound(F.transform(starts, lambda at: F.slice(every, at, F.lit(CHUNK))), in_chunks)

    return _bound(sized, lambda every: F.when(F.size(every) <= CHUNK, placed(every, F.lit(0))).otherwise(cut(every)))


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the check: from the right, every second digit is doubled and its digits are summed."""
    n = F.length(digits)
    terms = F.transform(
        F.sequence(F.lit(1), n),
        lambda i: F.when((n - i) % 2 == 0, F.substring(digits, i, F.lit(1)).cast("int")).otherwise(
            F.substring(digits, i, F.lit(1)).cast("int") * 2 - F.when(F.substring(digits, i, F.lit(1)).cast("int") > 4, 9).otherwise(0)
        ),
    )
    return F.aggregate(terms, F.lit(0), lambda a, b: a + b) % 10 == 0


def base_spans(text: Column) -> Column:
    """array<struct<at, to, kind, value>> of the base spans: kind is its place in KINDS."""
    none = F.array().cast("array<struct<at:int,to:int,value:string>>")
    is_ip = lambda m: F.forall(  # noqa: E731  of at most three digits once leading zeros are gone, and at most 255
        F.transform(F.split(m["value"], r"\."), lambda p: F.regexp_replace(p, "^0+(?=[0-9])", "")),
        lambda p: (F.length(p) <= 3) & (F.substring(F.concat(F.lit("00"), p), -3, 3) <= "255"),
    )
    n_digits = lambda m: F.length(_digits(m["value"]))
    is_card = lambda m: n_digits(m).between(14, 19) & luhn(F.substring(_digits(m["value"]), 1, 19))
    is_phone = lambda m: n_digits(m).between(10, 15)
    by_kind = [
        F.when(text.contains("@"), matches(text, _EMAIL)),
        F.when(text.rlike(r"[0-9]\.[0-9]"), F.filter(matches(text, _IP), is_ip)),
        F.when(text.rlike(_CARD_HINT), F.filter(matches(F.regexp_replace(text, _LONE, "_"), _CARD), is_card)),
        F.when(text.contains("+"), F.filter(matches(text, _PHONE), is_phone)),
    ]
    def tagged(found: Column, kind: int) -> Column:
        named = lambda m: F.struct(m["at"].alias("at"), m["to"].alias("to"), F.lit(kind).alias("kind"), m["value"].alias("value"))
        return F.transform(F.coalesce(found, none), named)

    return F.array_sort(F.concat(*(tagged(found, kind) for kind, found in enumerate(by_kind))))


def patterns_of(text: Column, at: Column, to: Column, value: Column) -> Column:
    """array<string> of the patterns of an instance: words before (<), words after (>), leading letters (^)."""
    words = lambda piece: F.filter(F.split(F.lower(piece), f"[{_BREAK}]+"), lambda w: w != "")
    left = words(F.substring(text, F.greatest(at - (WINDOW - 1), F.lit(1)), F.least(at, F.lit(WINDOW))))
    right = words(F.substring(text, to + 1, F.lit(WINDOW)))

    def beside(mark: str, near: Column, last: bool) -> Column:
        some = lambda k: F.slice(near, -k if last else F.lit(1), k)
        runs = F.transform(F.sequence(F.lit(1), F.least(F.size(near), F.lit(3))), lambda k: F.concat(F.lit(mark), F.concat_ws(" ", some(k))))
        return F.when(F.size(near) > 0, runs).otherwise(F.array(F.lit(mark)))  # nothing beside it: the text's edge

    letters = F.regexp_extract(value, "^[A-Za-z]{4}", 0)
    return F.concat(beside("<", left, True), beside(">", right, False), F.when(letters != "", F.array(F.concat(F.lit("^"), letters))).otherwise(F.array()))


def tokens(text: Column) -> Column:
    """array<struct<at, to, value>>: identifier-like tokens, without punctuation around them."""
    bare = lambda v: F.regexp_replace(v, r"^[^A-Za-z0-9+]++|(?<=[A-Za-z0-9])[^A-Za-z0-9]++$", "")
    lead = lambda v: F.length(v) - F.length(F.regexp_replace(v, r"^[^A-Za-z0-9+]++", ""))
    placed = lambda m: F.struct((m["at"] + lead(m["value"])).alias("at"), (m["at"] + lead(m["value"]) + F.length(bare(m["value"]))).alias("to"), bare(m["value"]).alias("value"))
    return F.filter(F.transform(matches(text, _TOKEN), placed), lambda t: F.length(t["value"]) >= LEAST_CHARS)


def find_spans(docs: DataFrame) -> DataFrame:
    """(doc_id, base, seeds, unseen) of every document, as a written table.

    seeds has the kind, value and patterns of each base span; unseen the place, value and patterns of each token outside them.
    """
    text = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    found = text.select("doc_id", "text", base_spans(F.col("text")).alias("base"), F.when(F.col("text").rlike("[0-9]"), tokens(F.col("text"))).alias("tokens"))
    outside = F.filter("tokens", lambda t: ~F.exists("base", lambda b: (b["at"] < t["to"]) & (t["at"] < b["to"])))
    named = lambda s: patterns_of(F.col("text"), s["at"], s["to"], s["value"]).alias("patterns")
    seed = lambda b: F.struct(b["kind"].alias("kind"), b["value"].alias("value"), named(b))
    fresh = lambda t: F.struct(t["at"].alias("at"), t["to"].alias("to"), t["value"].alias("value"), named(t))
    return staged(found.select("doc_id", "base", F.transform("base", seed).alias("seeds"), F.transform(outside, fresh).alias("unseen")), "pii-found")


def _with_scores(state: DataFrame) -> DataFrame:
    """(pattern, kind, accepted, share, score) of the patterns that state, (pattern, value, kind, accepted), makes trusted."""
    hits = F.count_if("accepted")
    by_kind = [F.count_if(F.col("kind") == k).alias(f"of_{k}") for k in range(len(KINDS))]
    stats = state.groupBy("pattern").agg(F.count(F.lit(1)).alias("fillers"), hits.alias("hits"), *by_kind)
    stats = stats.withColumn("share", F.col("hits") / F.col("fillers")).withColumn("score", F.col("share") * F.log2(1 + F.col("hits")))
    kind = F.coalesce(*[F.when(F.col(f"of_{k}") >= MIN_SHARE_OF_KIND * F.col("hits"), F.lit(k)) for k in range(len(KINDS))], F.lit(len(KINDS)))
    trusted = (F.col("hits") >= MIN_SUPPORT) & (F.col("share") >= MIN_SHARE) & (F.col("score") >= MIN_SCORE)
    return stats.where(trusted).select("pattern", kind.alias("kind"), "hits", "share", "score")


def bootstrapped(found: DataFrame, rounds: int = ROUNDS) -> tuple[DataFrame, DataFrame]:
    """(pattern, kind, hits, share, score) of the trusted patterns and (value, kind) of the values accepted beside the seeds."""
    seeds = found.select(F.explode("seeds").alias("s")).select("s.value", "s.kind", "s.patterns")
    unseen = found.select(F.explode("unseen").alias("t")).select("t.value", F.lit(None).cast("int").alias("kind"), "t.patterns")
    marked = seeds.unionByName(unseen).select("value", "kind", F.explode("patterns").alias("pattern"))
    edges = staged(marked.groupBy("pattern", "value").agg(F.min("kind").alias("kind")), "pii-edges")
    state = edges.withColumn("accepted", F.col("kind").isNotNull())
    written = []
    for _ in range(rounds):
        trusted = staged(_with_scores(state), "pii-patterns")
        heard = edges.where("kind is null").select("pattern", "value").join(trusted, "pattern")
        best = F.max(F.struct(F.col("kind") < len(KINDS), "score", (-F.col("kind")).alias("order"))).alias("best")  # one of the four kinds first
        accepted = staged(heard.groupBy("value").agg(best).select("value", (-F.col("best.order")).alias("found_kind")), "pii-accepted")
        state = edges.join(accepted, "value", "left").select("pattern", "value", "kind", (F.col("kind").isNotNull() | F.col("found_kind").isNotNull()).alias("accepted"))
        discard(*written)
        written = [trusted, accepted]
    discard(edges)
    return trusted, accepted.withColumnRenamed("found_kind", "kind")


def contextual_spans(found: DataFrame, accepted: DataFrame) -> DataFrame:
    """(doc_id, added): array<struct<at, to, kind>> of the accepted tokens."""
    fresh = found.select("doc_id", F.explode("unseen").alias("t")).select("doc_id", "t.at", "t.to", "t.value")
    hits = fresh.join(accepted, "value").select("doc_id", F.struct("at", "to", "kind").alias("span"))
    return hits.groupBy("doc_id").agg(F.array_sort(F.collect_set("span")).alias("added"))


def listed(spans: Column) -> Column:
    """kind:start:end, comma-joined, by start and then kind."""
    ordered = F.array_sort(F.transform(spans, lambda s: F.struct(s["at"].alias("at"), s["kind"].alias("kind"), s["to"].alias("to"))))
    name = F.array(*map(F.lit, (*KINDS, OTHER)))
    return F.array_join(F.transform(ordered, lambda s: F.concat_ws(":", F.element_at(name, s["kind"] + 1), s["at"], s["to"])), ",")


def personal_data(docs: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """(doc_id, base, added) of every document: the base spans and those that the bootstrapping adds."""
    found = find_spans(docs)
    _, accepted = bootstrapped(found, rounds)
    return found.select("doc_id", "base").join(contextual_spans(found, accepted), "doc_id", "left")


def op4_pii(spark, sf_dir):
    spans = personal_data(table(spark, sf_dir, "documents"))
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long")
    bare = F.transform("base", lambda s: F.struct(s["at"].alias("at"), s["to"].alias("to"), s["kind"].alias("kind")))
    both = F.concat(bare, F.coalesce("added", F.array().cast("array<struct<at:int,to:int,kind:int>>")))
    return spans.select(
        "doc_id", *[count(k).alias(f"n_{kind}") for k, kind in enumerate(KINDS)], F.sha2(listed(F.col("base")), 256).alias("base_sha256"), listed(both).alias("spans")
    )
