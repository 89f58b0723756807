"""Personal data: base patterns, and bootstrapped contexts that discover further identifiers.

DataFrame functions only. Positions are code points; ends are exclusive.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .shared import discard, written

#: Kinds in the order in which spans with one start are listed.
KINDS = ("email", "ip", "card", "phone")
# Runs are possessive and may not start inside a run, except where the last match ended; this
# finds what the plain patterns find, in time linear in the text.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9]){13,}+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Tokens that may be identifiers: they hold a digit or an at sign.
CANDIDATE = r"(?<!\S)[^\s0-9@]*+[0-9@]\S*+"
#: What stands for the neighbour of a mention that has no word before or behind it.
START, END = "^", "$"
#: Rounds of scoring; distinct seed instances and score that make a pattern trusted; digits of a discovered number.
ROUNDS, MIN_SEEDS, TRUST, MIN_DIGITS = 3, 4, 0.8, 6


def _mentions(pieces: Column, values: Column, k: int) -> Column:
    """``(k, i, gap, v, left, right)`` of the matches ``values`` of a text, of which ``pieces`` is the rest.

    ``gap`` is the length of the text since the last match. Neighbours are the last word before a match and the
    first behind it, in lower case; they are looked for up to the next match of the pattern on either side, itself
    included. Each piece is looked at once or twice, so the work grows with the text's length.
    """
    n = F.size(values)
    before = F.zip_with(F.slice(F.concat(F.array(F.lit("")), values), F.lit(1), n), F.slice(pieces, F.lit(1), n), lambda v, p: F.struct(v.alias("v"), p.alias("p")))
    behind = F.zip_with(F.slice(pieces, F.lit(2), n), F.slice(F.concat(values, F.array(F.lit(""))), F.lit(2), n), lambda p, v: F.concat(p, v))
    left = lambda x: F.reverse(F.regexp_extract(F.reverse(F.concat(x["v"], x["p"])), r"^\s*+(\S++)", 1))
    right = lambda x: F.regexp_extract(x, r"^\S*+\s++(\S++)", 1)
    known = lambda x, none: F.when(x == "", F.lit(none)).otherwise(F.lower(x))
    found = F.zip_with(values, before, lambda v, x: F.struct(F.length(x["p"]).alias("gap"), v.alias("v"), known(left(x), START).alias("left")))
    both = F.zip_with(found, behind, lambda x, y: F.struct(x["gap"].alias("gap"), x["v"].alias("v"), x["left"].alias("left"), known(right(y), END).alias("right")))
    return F.transform(both, lambda x, i: F.struct(F.lit(k).alias("k"), i.alias("i"), x["gap"].alias("gap"), x["v"].alias("v"), x["left"].alias("left"), x["right"].alias("right")))


def _digits(v: Column) -> Column:
    return F.regexp_replace(v, "[^0-9]", "")


def _luhn(v: Column) -> Column:
    rev = F.reverse(_digits(v))

    def term(i: Column) -> Column:
        d = F.substring(rev, i, F.lit(1)).cast("int")
        return F.when(i % 2 == 1, d).when(d > 4, 2 * d - 9).otherwise(2 * d)

    return F.aggregate(F.sequence(F.lit(1), F.length(rev)), F.lit(0), lambda a, i: a + term(i)) % 10 == 0


def _valid(kind: str, v: Column) -> Column:
    if kind == "ip":
        return F.forall(F.split(v, r"\."), lambda x: (F.length(F.regexp_replace(x, "^0+", "")) <= 3) & (F.right(F.concat(F.lit("00"), x), F.lit(3)).cast("int") <= 255))
    if kind == "card":
        return F.length(_digits(v)).between(14, 19) & _luhn(v)
    if kind == "phone":
        return F.length(_digits(v)).between(10, 15)
    return F.lit(True)


def matches(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """A written table ``(rid, doc_id, found)``: a text's matches of each pattern, with ``k`` its place in ``KINDS``, and 4 for candidates."""
    t = F.col("text")
    rows = docs.select(F.monotonically_increasing_id().alias("rid"), F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    # a cheap test spares most texts the search
    hint = [t.contains("@"), t.rlike(PATTERNS["ip"]), t.rlike(r"[0-9](?:[\x20-]?[0-9]){13}"), t.contains("+"), t.rlike("[0-9@]")]
    patterns = [*(PATTERNS[k] for k in KINDS), CANDIDATE]
    parts = rows.select("rid", "doc_id", *(c for k, (h, p) in enumerate(zip(hint, patterns)) for c in (F.when(h, F.split(t, p, -1)).alias(f"p{k}"), F.when(h, F.regexp_extract_all(t, F.lit(p), F.lit(0))).alias(f"v{k}"))))
    none = F.array().cast("array<struct<k:int,i:int,gap:int,v:string,left:string,right:string>>")
    found = F.concat(*(F.when(F.size(f"v{k}") > 0, _mentions(F.col(f"p{k}"), F.col(f"v{k}"), k)).otherwise(none) for k in range(len(patterns))))
    return written(parts.select("rid", "doc_id", found.alias("found")), "matches")


def mentions(found: DataFrame) -> DataFrame:
    """``(rid, k, s, e, kind, v, left, right)`` of the valid base spans of :func:`matches`, and of the candidates that none of them touches.

    Positions are running sums of the lengths of gaps and matches; whether a candidate touches a base span
    follows from the furthest end before it and the nearest start behind it.
    """
    m = found.select("rid", F.explode("found").alias("m")).select("rid", "m.*").repartition("rid")
    e = F.sum(F.col("gap") + F.length("v")).over(Window.partitionBy("rid", "k").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)).cast("int")
    m = m.withColumn("e", e).withColumn("s", F.col("e") - F.length("v"))
    base = F.col("k") < len(KINDS)
    valid = F.lit(True)
    for k, kind in enumerate(KINDS):
        valid = F.when(F.col("k") == k, _valid(kind, F.col("v"))).otherwise(valid)
    m = m.where(valid)
    reach = F.max(F.when(base, F.col("e"))).over(Window.partitionBy("rid").orderBy("s").rangeBetween(Window.unboundedPreceding, 0))
    ahead = F.min(F.when(base, F.col("s"))).over(Window.partitionBy("rid").orderBy(F.desc("s")).rangeBetween(Window.unboundedPreceding, 0))
    m = m.withColumn("reach", reach).withColumn("ahead", ahead)
    m = m.where(base | ((F.coalesce("reach", F.lit(0)) <= F.col("s")) & (F.coalesce("ahead", F.col("e")) >= F.col("e"))))
    names = F.array(*map(F.lit, KINDS))
    return m.select("rid", "k", "s", "e", F.when(base, F.get(names, F.col("k"))).alias("kind"), F.lower("v").alias("v"), "left", "right")


def discover(m: DataFrame, rounds: int = ROUNDS, min_seeds: int = MIN_SEEDS, trust: float = TRUST) -> DataFrame:
    """``(rid, s, e, kind)`` of those of ``m``, the :func:`mentions`, outside the base spans that trusted patterns point to.

    A pattern is the word before a mention, the word behind it, or both; a text's start and end count as words. A seed
    instance scores 1 for its kind; a pattern's score for a kind is the share of its
    instances' scores among its distinct instances, damped by two; another instance's score is the
    mean of its patterns'. After ``rounds`` rounds, patterns with enough distinct seeds
    and score are trusted, and mentions in them with a fitting shape are found.
    """
    lexical = F.array(F.concat(F.lit("l "), "left"), F.concat(F.lit("r "), "right"), F.concat(F.lit("b "), "left", F.lit(" _ "), "right"))
    m = m.withColumn("pattern", F.explode(lexical))
    edges = written(m.groupBy("pattern", "v").agg(F.max("kind").alias("kind")), "edges")
    total = edges.groupBy("pattern").agg(F.count("*").alias("n"))
    score = edges.where("kind is not null").select("v", "kind", F.lit(1.0).alias("r")).distinct()
    patterns = None
    for _ in range(rounds):
        got = edges.select("pattern", "v").join(score, "v").groupBy("pattern", "kind").agg(F.sum("r").alias("r"), F.sum(F.when(F.col("r") >= 1.0, 1).otherwise(0)).alias("seeds"))
        patterns = written(got.join(total, "pattern").select("pattern", "kind", "seeds", (F.col("r") / (F.col("n") + 2)).alias("score")), "patterns")
        heard = edges.where("kind is null").select("pattern", "v").join(patterns, "pattern").groupBy("v", "kind").agg(F.avg("score").alias("r"))
        score = written(edges.where("kind is not null").select("v", "kind", F.lit(1.0).alias("r")).distinct().union(heard.select("v", "kind", F.least("r", F.lit(0.999)))), "scores")
    trusted = patterns.where((F.col("seeds") >= min_seeds) & (F.col("score") >= trust)).select("pattern", F.col("kind").alias("told"))
    hits = m.where("kind is null").join(trusted, "pattern").select("rid", "s", "e", "v", "told").distinct()
    fits = F.when(F.col("told") == "email", F.col("v").contains("@")).otherwise(F.length(_digits(F.col("v"))) >= MIN_DIGITS)
    return hits.where(fits).groupBy("rid", "s", "e").agg(F.min("told").alias("kind"))


def _listed(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["s"].cast("string"), x["e"].cast("string"))), ",")


def personal_data(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans)`` per row of ``docs``.

    Counts and digest are of the base spans; ``spans`` lists discovered ones as
    well. Null and empty texts have none; texts of any length are searched whole, in time linear in their length; repeated
    rows repeat; a null doc_id stays null; other columns are ignored; an empty table gives no rows.
    """
    found = matches(docs, doc_id, text)
    seen = written(mentions(found), "mentions")
    more = written(discover(seen), "more")
    order = F.element_at(F.create_map(*(x for i, k in enumerate(KINDS) for x in (F.lit(k), F.lit(i)))), F.col("kind"))
    every = seen.where("kind is not null").select("rid", "s", "k", "e", "kind", F.lit(True).alias("base")).union(more.select("rid", "s", order, "e", "kind", F.lit(False)))
    spans = written(every.groupBy("rid").agg(F.array_sort(F.collect_list(F.struct("s", "k", "e", "kind", "base"))).alias("every")), "spans")
    discard(seen, more)
    rows = found.select("rid", "doc_id").join(spans, "rid", "left").withColumn("every", F.coalesce("every", F.array().cast(spans.schema["every"].dataType)))
    rows = rows.withColumn("base", F.filter("every", lambda x: x["base"]))
    count = lambda k: F.size(F.filter("base", lambda x: x["kind"] == k)).cast("long").alias(f"n_{k}")
    return rows.select("doc_id", *map(count, KINDS), F.sha2(_listed(F.col("base")), 256).alias("base_sha256"), _listed(F.col("every")).alias("spans"))
