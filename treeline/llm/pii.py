"""Operator 8: personal data by base patterns and bootstrapped contextual extraction.

Base spans are found by expressions of the JVM's regular expression engine. They are rewritten so
that no group is repeated (which would recurse on long runs) and no start inside a run is tried in
vain, and find exactly what the plain forms of the contract find: characters that may not belong
to a match (a dot before no domain character, a separator not between digits) are first replaced
one for one, so positions stay. Positions are sums of the lengths of matches and of the gaps
between them.

The base spans are seeds. Every identifier-like token (6 to 64 characters, four digits or an ``@``)
is an instance with lexical patterns from the text between it and the tokens beside it: its two words
before, and the word before with the word behind. In
each round patterns are scored by the share of their distinct instances that are known to be of a
kind, instances by their patterns (noisy or), and instances that score enough become known for the
next round. Tokens found in the end add spans where they stand outside base spans, seeds too if their patterns there
score enough; base spans always stay. Patterns and instances are
aggregated in tasks before they are shuffled, so a context that a third of all tokens share is no
hot spot.

Nulls count as empty texts. Texts without personal data have counts of 0, an empty span string and
the hash of the empty string. Repeated rows are searched one by one. An empty table gives an empty
result. n_* count base spans; ``n_found`` counts the added ones.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut

KINDS = ["email", "ip", "card", "phone"]
#: Character classes of the contract's patterns.
LOCAL, DOMAIN = "A-Za-z0-9._%+-", "A-Za-z0-9-"
EMAIL = rf"(?:(?<![{LOCAL}])|\G)[{LOCAL}]++@[{DOMAIN}]++\.[{DOMAIN}.]++"
IP = r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9][0-9\x20-]*+"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
#: Identifier-like tokens.
TOKEN = r"(?<![A-Za-z0-9._%+@/-])[A-Za-z0-9._%+@/-]*[0-9@][A-Za-z0-9._%+@/-]*+"
#: Rounds of the bootstrap; least distinct instances of a pattern, least share of a kind, least score of an instance.
ROUNDS, SUPPORT, CONFIDENCE, SCORE = 2, 3, 0.7, 0.9
_SPANS = "array<struct<start:long,end:long,value:string,left:string,right:string>>"
#: Matches whose positions are summed together; sums of such runs are then summed, so that a text with very many matches takes no quadratic time.
RUN = 128
#: Characters of the gaps around a token that are searched for its context.
LEFT, RIGHT = 48, 32
#: Characters of a cell in which tokens and base spans meet.
CELL = 64


def _found(text: str, pattern: str, when: Column) -> Column:
    """Spans (start, end, value, left, right) of the pattern's matches in a column, where ``when`` holds; left and right are the ends of the gaps beside the match."""
    matches = F.regexp_extract_all(F.col(text), F.lit(pattern), F.lit(0))
    gaps = F.split(F.col(text), pattern, -1)
    ends = F.transform(gaps, lambda g: F.struct(F.char_length(g).cast("long").alias("size"), F.substring(g, -LEFT, LEFT).alias("left"), F.substring(g, 1, RIGHT).alias("right")))
    beside = F.zip_with(ends, F.slice(ends, F.lit(2), F.greatest(F.size(gaps) - 1, F.lit(0))), lambda a, b: F.struct(a["size"].alias("gap"), a["left"].alias("left"), b["right"].alias("right")))
    both = F.zip_with(matches, F.slice(beside, F.lit(1), F.size(matches)), lambda m, g: F.struct(g["gap"].alias("gap"), m.alias("value"), g["left"].alias("left"), g["right"].alias("right")))
    empty = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast(_SPANS).alias("spans"))

    def add(s, x):
        start = s["at"] + x["gap"]
        end = start + F.char_length(x["value"])
        return F.struct(end.alias("at"), F.concat(s["spans"], F.array(F.struct(start.alias("start"), end.alias("end"), x["value"].alias("value"), x["left"].alias("left"), x["right"].alias("right")))).alias("spans"))

    # The one-element array binds the matches to a variable, so they are found once and not once a run.
    runs = F.get(F.transform(F.array(both), lambda b: F.transform(
        F.sequence(F.lit(0), F.greatest(F.ceil(F.size(b) / F.lit(RUN)).cast("int") - 1, F.lit(0))), lambda r: F.aggregate(F.slice(b, r * RUN + 1, F.lit(RUN)), empty, add))), F.lit(0))
    none = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast(f"array<{_SPANS}>").alias("runs"))

    def shift(s, r):
        moved = F.transform(r["spans"], lambda x: F.struct((x["start"] + s["at"]).alias("start"), (x["end"] + s["at"]).alias("end"), x["value"].alias("value"), x["left"].alias("left"), x["right"].alias("right")))
        return F.struct((s["at"] + r["at"]).alias("at"), F.concat(s["runs"], F.array(moved)).alias("runs"))

    return F.when(when, F.aggregate(runs, none, shift, lambda s: F.flatten(s["runs"]))).otherwise(F.array().cast(_SPANS))


def digits(c: Column) -> Column:
    return F.regexp_replace(c, "[^0-9]", "")


def luhn(c: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    each = F.transform(F.split(F.reverse(c), ""), lambda x, i: F.when(i % 2 == 0, F.try_to_number(x, F.lit("9")).cast("int")).otherwise(
        F.element_at(F.array(*[F.lit(v) for v in (0, 2, 4, 6, 8, 1, 3, 5, 7, 9)]), F.try_to_number(x, F.lit("9")).cast("int") + 1)))
    return F.aggregate(each, F.lit(0), lambda s, x: s + F.coalesce(x, F.lit(0))) % 10 == 0


def is_ip(c: Column) -> Column:
    parts = F.transform(F.split(c, r"\."), lambda p: F.regexp_replace(p, "^0+(?=[0-9])", ""))
    return F.forall(parts, lambda p: (F.char_length(p) < 3) | ((F.char_length(p) == 3) & (p <= "255")))


def base_spans(texts: DataFrame) -> DataFrame:
    """``texts`` (columns doc_id, text) as doc_id, mark, email, ip, card, phone, token: arrays of spans; gaps' words with tokens."""
    t = F.col("text")
    seen = texts.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).select(
        "doc_id", "text", F.xxhash64("text").alias("mark"),
        t.contains("@").alias("at"), t.contains("+").alias("plus"), t.rlike("[0-9]").alias("digit"))
    long_run = F.col("digit") & t.rlike("[0-9](?:[\\x20-]?[0-9]){12}")
    ready = seen.withColumn("dots", F.when(F.col("at"), F.regexp_replace("text", rf"\.(?![{DOMAIN}])", "_")).otherwise("")).withColumn(
        "runs", F.when(long_run, F.regexp_replace("text", r"(?<![0-9])[\x20-]|[\x20-](?![0-9])", "_")).otherwise(""))
    n = lambda x: F.char_length(digits(x["value"]))
    found = ready.select(
        "doc_id", "mark", "text",
        _found("dots", EMAIL, F.col("at")).alias("email"),
        F.filter(_found("text", IP, F.col("digit")), lambda x: is_ip(x["value"])).alias("ip"),
        F.filter(_found("runs", CARD, F.col("runs") != ""), lambda x: n(x).between(13, 19) & luhn(digits(x["value"]))).alias("card"),
        F.filter(_found("text", PHONE, F.col("plus")), lambda x: n(x).between(9, 15)).alias("phone"),
        _found("text", TOKEN, F.col("digit") | F.col("at")).alias("token"))
    like = lambda x: F.char_length(x["value"]).between(6, 64) & ((n(x) >= 4) | x["value"].contains("@"))
    words = lambda c: F.filter(F.split(F.lower(c), r"[^\p{L}\p{N}]+"), lambda w: w != "")

    def context(x):
        left, right = words(x["left"]), words(x["right"])
        last = lambda k: F.coalesce(F.get(left, F.size(left) - k), F.lit("^"))
        return F.struct(x["start"].alias("start"), x["end"].alias("end"), x["value"].alias("value"), F.array(
            F.concat_ws(" ", last(2), last(1), F.lit("_")), F.concat_ws(" ", last(1), F.lit("_"), F.coalesce(F.get(right, F.lit(0)), F.lit("$")))).alias("patterns"))

    return found.select("doc_id", "mark", *KINDS, F.transform(F.filter("token", like), context).alias("token"))


def _found_values(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """(value, kind) of instances whose patterns outside base spans score enough after the bootstrap; seeds are judged like any other.

    ``edges``: value, pattern and free, whether the pattern is met outside base spans. Scores are compared as
    log(1 - score), because the noisy or of many patterns rounds to 1.
    """
    known, best = seeds, None
    totals = edges.groupBy("pattern").agg(F.count(F.lit(1)).alias("all")).where(F.col("all") >= SUPPORT)
    for _ in range(ROUNDS):
        hits = edges.join(known, "value").groupBy("pattern", "kind").agg(F.sum("score").alias("hits"))
        trusted = hits.join(totals, "pattern").withColumn("confidence", F.col("hits") / (F.col("all") + F.lit(1))).where(
            (F.col("confidence") >= CONFIDENCE) & (F.col("hits") >= SUPPORT - 1)).select("pattern", "kind", "confidence")
        scored = edges.where("free").join(trusted, "pattern").groupBy("value", "kind").agg((-F.sum(F.log1p(-F.col("confidence")))).alias("evidence")).withColumn(
            "score", F.lit(1.0) - F.exp(-F.col("evidence")))
        best = cut(scored.where(F.col("score") >= SCORE).groupBy("value").agg(F.max(F.struct("evidence", "kind", "score")).alias("b")).select("value", F.col("b.kind").alias("kind"), F.col("b.score").alias("score")))
        known = seeds.unionByName(best.join(seeds, "value", "left_anti"))
    return best.select("value", "kind")


# Functions of one parameter each: a second one would get an element's index.
def _of_kind(kind: str):
    return lambda x: F.struct(F.lit(kind).alias("kind"), x["start"].alias("start"), x["end"].alias("end"))


def _is_kind(kind: str):
    return lambda x: x["kind"] == kind


def _as_text(kind: str):
    return lambda x: F.concat_ws(":", F.lit(kind), x["start"].cast("string"), x["end"].cast("string"))


def _place(x):
    return F.struct(x["start"].alias("start"), x["end"].alias("end"))


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Columns doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_found."""
    held = cut(base_spans(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))))
    # Tokens that touch base spans are known to be of their kind; both meet in cells of CELL characters, so nothing is compared across a text.
    cells = lambda c: F.explode(F.sequence(F.floor(c["start"] / CELL), F.floor((c["end"] - 1) / CELL)))
    listed = held.where(F.size("token") > 0).select("doc_id", "mark", F.explode("token").alias("t"))
    spans = held.select("doc_id", "mark", F.explode(F.concat(*[F.transform(k, _of_kind(k)) for k in KINDS])).alias("s")).select(F.col("doc_id").alias("d"), F.col("mark").alias("m"), "s", cells(F.col("s")).alias("c"))
    near = listed.select("doc_id", "mark", "t.start", "t.end", cells(F.col("t")).alias("cell"))
    touch = near.join(spans, near["doc_id"].eqNullSafe(spans["d"]) & (near["mark"] == spans["m"]) & (near["cell"] == spans["c"]) & (spans["s.start"] < near["end"]) & (near["start"] < spans["s.end"]))
    known = touch.groupBy(F.col("doc_id").alias("d"), F.col("mark").alias("m"), F.col("start").alias("from")).agg(F.min("s.kind").alias("base"))
    tokens = listed.select("doc_id", "mark", "t.*")
    tokens = cut(tokens.join(known, tokens["doc_id"].eqNullSafe(known["d"]) & (tokens["mark"] == known["m"]) & (tokens["start"] == known["from"]), "left").drop("d", "m", "from"))
    edges = cut(tokens.select("value", F.col("base").isNull().alias("free"), F.explode(F.array_distinct("patterns")).alias("pattern")).groupBy("value", "pattern").agg(F.bool_or("free").alias("free")))
    seeds = tokens.where("base is not null").groupBy("value").agg(F.min("base").alias("kind"), F.lit(1.0).alias("score"))
    new = _found_values(edges, cut(seeds))
    extra = tokens.where("base is null").join(new, "value").groupBy("doc_id", "mark").agg(F.collect_set(F.struct("kind", "start", "end")).alias("extra"))
    rows = held.join(extra, [held["doc_id"].eqNullSafe(extra["doc_id"]), held["mark"] == extra["mark"]], "left").select(held["doc_id"], *KINDS, F.coalesce("extra", F.array().cast("array<struct<kind:string,start:long,end:long>>")).alias("extra"))
    base = F.flatten(F.array(*[F.transform(k, _as_text(k)) for k in KINDS]))
    whole = F.flatten(F.array(*[F.transform(F.array_sort(F.concat(
        F.transform(k, _place), F.transform(F.filter("extra", _is_kind(k)), _place))), _as_text(k)) for k in KINDS]))
    return rows.select(
        "doc_id", *[F.size(k).cast("long").alias(f"n_{k}") for k in KINDS], F.sha2(F.concat_ws(",", base), 256).alias("base_sha256"),
        F.concat_ws(",", whole).alias("spans"), F.size("extra").cast("long").alias("n_found"))
