"""Personal data: patterns for known kinds, and more identifiers found by their context.

E-mail addresses, IP addresses, card and phone numbers follow patterns. They are the
seeds of a bootstrap over the whole corpus: every token with a digit is an instance,
the words before and behind it and a key inside it (``name=``) with the token's shape
are its lexical patterns. On the graph of patterns and instances a pattern is as
credible as the mean of its instances, an instance as its best pattern, seeds being
certain. After a few rounds, credible patterns that hold several different instances
add the tokens that no rule knew.

DataFrame operations only. Expressions never try a place twice, so a long run of
letters or digits costs its length, not its square.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wattfleet.llm.arrays import bound, matches
from wattfleet.session import stored

KINDS = ["email", "ip", "card", "phone"]
FOUND = "id"
# Equal to the plain patterns, leftmost and greedy: a run of characters is entered at its first one only
# (or right behind the match before), and no quantifier gives back what it took where that cannot help.
_LOCAL = r"[A-Za-z0-9._%+-]"
PATTERNS = {
    "email": rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
_BYTE = "0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]{1,2})"
_TOKEN = r"(?<![^\x20\x09-\x0D])[^\x20\x09-\x0D0-9]*+[0-9][^\x20\x09-\x0D]*+"
ROUNDS = 3
#: A pattern adds tokens from this credibility on, if it holds as many different instances.
CREDIBLE = 0.5
SUPPORT = 3


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    values = F.transform(F.split(F.reverse(digits), ""), lambda d: d.cast("int"))
    shown = F.transform(values, lambda d, i: F.when(i % 2 == 0, d).otherwise(F.when(d > 4, 2 * d - 9).otherwise(2 * d)))
    return F.aggregate(shown, F.lit(0), lambda s, x: s + x) % 10 == 0


def _valid(kind: str, value: Column) -> Column:
    if kind == "ip":
        return F.regexp_like(value, F.lit(rf"^{_BYTE}\.{_BYTE}\.{_BYTE}\.{_BYTE}$"))
    if kind == "card":
        return F.when(F.length(_digits(value)).between(13, 19), _luhn(_digits(value))).otherwise(False)
    if kind == "phone":
        return F.length(_digits(value)).between(9, 15)
    return F.lit(True)


def _span(found: Column) -> Column:
    return F.transform(found, lambda m: F.struct(m["start"].alias("start"), m["end"].alias("end")))


def known(text: Column, kind: str) -> Column:
    """Places ``(start, end)`` of one known kind, in code points, end exclusive."""
    needed = {"email": "@", "phone": "+", "ip": "."}.get(kind)
    found = F.filter(matches(text, F.lit(PATTERNS[kind]), F.length), lambda m: _valid(kind, m["value"]))
    gate = F.contains(text, F.lit(needed)) if needed else F.regexp_like(text, F.lit("[0-9]"))
    return F.when(gate, _span(found)).otherwise(F.array().cast("array<struct<start:bigint,end:bigint>>"))


def _shape(token: Column) -> Column:
    """A token's kinds of characters, each run as one: letters a and A, digits 9, others themselves."""
    plain = F.regexp_replace(F.regexp_replace(F.regexp_replace(token, r"\p{Lu}+", "A"), r"[\p{L}&&[^A]]+", "a"), "[0-9]+", "9")
    return F.substring(plain, 1, 40)


def _patterned(instances: DataFrame) -> DataFrame:
    """`instances` with a row for each lexical pattern, in the column ``pattern``."""
    shape = _shape(F.col("token"))
    key = F.regexp_extract("token", r"^([^0-9=:]{2,30}+[=:])", 1)
    patterns = F.array(
        F.when(F.col("left") != "", F.concat(F.lit("left "), F.lower("left"), F.lit(" "), shape)),
        F.when(F.col("right") != "", F.concat(F.lit("right "), F.lower("right"), F.lit(" "), shape)),
        F.when(key != "", F.concat(F.lit("key "), F.lower(key))),
    )
    return instances.withColumn("pattern", F.explode(F.array_compact(patterns)))


def credible_patterns(instances: DataFrame, rounds: int = ROUNDS, credible: float = CREDIBLE, support: int = SUPPORT) -> DataFrame:
    """Rows ``(pattern, credibility)`` of the patterns that may add tokens."""
    edges = _patterned(instances).groupBy("pattern", F.col("token").alias("instance")).agg(F.max("seed").alias("seed"))
    edges = stored(edges, "pattern-edges")
    sizes = edges.groupBy("pattern").agg(F.count(F.lit(1)).alias("n"))
    trusted = edges.select("pattern", "instance", F.col("seed").cast("double").alias("trust"))
    for turn in range(rounds):
        # One instance short of the mean: a pattern seen once convinces nobody.
        scored = trusted.groupBy("pattern").agg((F.sum("trust") / (F.count(F.lit(1)) + 1)).alias("credibility"))
        scored = stored(scored, f"patterns-{turn}")
        if turn < rounds - 1:
            best = edges.join(scored, "pattern").groupBy("instance").agg(F.max("credibility").alias("best"))
            trusted = edges.join(best, "instance").select(
                "pattern", "instance", F.when(F.col("seed") == 1, 1.0).otherwise(F.col("best")).alias("trust")
            )
    return scored.join(sizes, "pattern").where((F.col("credibility") >= credible) & (F.col("n") >= support)).select("pattern", "credibility")


def _tokens(text: Column) -> Column:
    """Structs ``(start, end, token, left, right)`` of the tokens with a digit and the words beside them."""
    def flat(piece: Column) -> Column:
        return F.translate(piece, "\t\n\x0b\x0c\r", " " * 5)

    def told(found: Column) -> Column:
        rest = F.array(F.element_at(F.split(text, F.lit(_TOKEN), -1), -1))
        after = F.concat(F.slice(F.transform(found, lambda m: m["before"]), 2, F.size(found)), rest)
        return F.zip_with(found, after, lambda m, a: F.struct(
            m["start"].alias("start"), m["end"].alias("end"), m["value"].alias("token"),
            F.substring_index(F.rtrim(flat(m["before"])), " ", -1).alias("left"),
            F.substring_index(F.ltrim(flat(a)), " ", 1).alias("right"),
        ))

    return bound(matches(text, F.lit(_TOKEN), F.length), told)


def _instances(spans: DataFrame) -> DataFrame:
    """Rows ``(id, text_hash, start, end, token, left, right, seed)``; a seed shares a character with a known place."""
    key = ["id", "text_hash"]
    tokens = spans.select(*key, F.explode("tokens").alias("t")).select(*key, "t.*")
    places = spans.select(*key, F.explode(F.flatten(F.array(*KINDS))).alias("k")).select(
        *key, F.col("k.start").alias("start"), F.col("k.start").alias("known_start"), F.col("k.end").alias("known_end")
    )
    rows = tokens.unionByName(places, allowMissingColumns=True)
    # Frames that grow from one end cost a row each; one that shrinks is computed anew for every row.
    until = F.max("known_end").over(Window.partitionBy(*key).orderBy("start"))
    onward = F.min("known_start").over(Window.partitionBy(*key).orderBy(F.desc("start")))
    touched = F.coalesce(until > F.col("start"), F.lit(False)) | F.coalesce(onward < F.col("end"), F.lit(False))
    return rows.withColumn("seed", touched.cast("int")).where("token is not null").drop("known_start", "known_end")


def personal_data(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rounds: int = ROUNDS,
    credible: float = CREDIBLE, support: int = SUPPORT,
) -> DataFrame:
    """Rows ``(id, email, ip, card, phone, found)``, one for each row of ``docs``.

    Each column is a sorted array of ``(start, end)`` in code points, end exclusive;
    ``found`` holds the tokens that credible patterns add, outside all others. Null texts
    are empty. An id with several texts is looked at text by text, repeated rows stay
    repeated, null ids stay. Other columns play no part.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    keyed = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("text_hash"), text.alias("text"))
    relevant = keyed.where(F.regexp_like("text", F.lit("[0-9@]")))
    spans = relevant.select(
        "id", "text_hash", *[known(F.col("text"), k).alias(k) for k in KINDS], _tokens(F.col("text")).alias("tokens")
    ).dropDuplicates(["id", "text_hash"])
    spans = stored(spans, "known-spans")
    instances = stored(_instances(spans), "instances")
    good = credible_patterns(instances, rounds, credible, support)
    new = _patterned(instances.where("seed = 0")).join(good, "pattern", "left_semi")
    found = new.groupBy("id", "text_hash").agg(F.sort_array(F.collect_set(F.struct("start", "end"))).alias("found"))
    both = spans.select("id", "text_hash", *KINDS).alias("s").join(
        found.alias("f"), F.col("s.id").eqNullSafe(F.col("f.id")) & (F.col("s.text_hash") == F.col("f.text_hash")), "left"
    ).select("s.*", "f.found")
    joined = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("text_hash")).alias("d").join(
        both.alias("b"), F.col("d.id").eqNullSafe(F.col("b.id")) & (F.col("d.text_hash") == F.col("b.text_hash")), "left"
    )
    none = F.array().cast("array<struct<start:bigint,end:bigint>>")
    return joined.select(F.col("d.id").alias(id_col), *[F.coalesce(f"b.{k}", none).alias(k) for k in [*KINDS, "found"]])
