"""Benchmark decontamination by a prefix-filtered set join, in DataFrame operations only.

A window is `window` consecutive words of a benchmark item, or the whole item where it
has fewer. A document is hit where it holds all shingles of a window in the window's
order. Full containment makes a prefix of one shingle necessary: with shingles
ordered by rarity in the whole corpus, each window joins on its rarest one only. The
place of that shingle in the window says where the window would begin in the document;
a start before the first word or an end behind the last one (positional and length
bound) ends the candidate. What is left is compared word by word.

The join moves shingle hashes, not texts. Texts are read again for the documents that
have candidates; a table of bits of fixed size spares the others the shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wattfleet.llm.rows import as_rows
from wattfleet.session import stored

WINDOW = 13
SHINGLE = 3
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text: Column | str) -> Column:
    """Words of ASCII letters, digits and all other characters beyond ASCII; A-Z are lowered."""
    return F.array_remove(F.split(F.translate(F.coalesce(text, F.lit("")), _UPPER, _LOWER), _SEPARATORS), "")


def _shingles(words: Column, size: int) -> Column:
    """Hashes of `size` consecutive words, by position; empty where there are fewer words."""
    starts = F.sequence(F.lit(0), F.size(words) - size)
    hashed = F.transform(starts, lambda i: F.xxhash64(*[F.get(words, i + k) for k in range(size)]))
    return F.when(F.size(words) >= size, hashed).otherwise(F.array().cast("array<bigint>"))


def _key(id_col: str, text_col: str) -> list[Column]:
    # An id may occur with several texts, so the text takes part.
    return [F.col(id_col).alias("id"), F.xxhash64(text_col).alias("text_hash")]


def with_candidates(docs: DataFrame, keys: DataFrame, key: Column) -> DataFrame:
    """Rows of ``docs`` whose long ``key`` may be in ``keys(key)``; all that are in it stay.

    The table that is broadcast has 65,536 rows of 64 bits at most, 1 MB, at any size of the input.
    """
    bits = (
        keys.select(
            F.shiftrightunsigned("key", 48).alias("_row"),
            F.expr("shiftleft(1L, cast(pmod(key, 64) as int))").alias("bit"),
        )
        .groupBy("_row")
        .agg(F.bit_or("bit").alias("_bits"))
    )
    joined = docs.withColumn("_key", key).withColumn("_row", F.shiftrightunsigned("_key", 48)).join(
        F.broadcast(bits), "_row"
    )
    return joined.where("(_bits & shiftleft(1L, cast(pmod(_key, 64) as int))) <> 0").drop("_key", "_row", "_bits")


def windows(items: DataFrame, id_col: str, text_col: str, window: int = WINDOW) -> DataFrame:
    """Distinct rows ``(item, window)``, a window being an array of words."""
    listed = items.select(F.col(id_col).cast("string").alias("item"), words(F.col(text_col)).alias("w")).where("size(w) > 0")
    starts = F.sequence(F.lit(1), F.greatest(F.size("w") - window + 1, F.lit(1)))
    return listed.select("item", F.explode(F.transform(starts, lambda i: F.slice("w", i, window))).alias("window")).distinct()


def occurrences(
    docs: DataFrame, distinct_windows: DataFrame, id_col: str, text_col: str, shingle: int = SHINGLE
) -> DataFrame:
    """Rows ``(id, text_hash, window, start)``: every place of every window in every document."""
    distinct_windows = distinct_windows.withColumn("n", F.least(F.size("window"), F.lit(shingle)))
    # Items shorter than a shingle are shingles of their own length: at most `shingle` lengths.
    sizes = sorted(r.n for r in distinct_windows.select("n").distinct().collect())
    pieces = F.lit(None).cast("array<bigint>")
    for n in sizes:
        pieces = F.when(F.col("n") == n, _shingles(F.col("window"), n)).otherwise(pieces)
    parts = distinct_windows.select(
        F.xxhash64("window").alias("window_id"), "window", F.size("window").alias("length"),
        F.posexplode(pieces).alias("offset", "shingle"),
    )
    parts = stored(parts, "windows")

    listed = docs.select(*_key(id_col, text_col), words(F.col(text_col)).alias("w"))
    flat = F.flatten(F.array(*[
        F.transform(_shingles(F.col("w"), n), lambda s, i: F.struct(i.alias("position"), s.alias("shingle"))) for n in sizes
    ])) if len(sizes) > 1 else None
    if flat is None:
        tokens = listed.select(
            "id", "text_hash", F.size("w").alias("n_words"),
            F.posexplode(_shingles(F.col("w"), sizes[0] if sizes else shingle)).alias("position", "shingle"),
        )
    else:
        tokens = listed.select("id", "text_hash", F.size("w").alias("n_words"), F.explode(flat).alias("t")).select(
            "id", "text_hash", "n_words", "t.position", "t.shingle"
        )

    # Rarity over the whole corpus; a window with a shingle that never occurs has no place in it.
    counts = tokens.select("shingle").join(parts.select("shingle").distinct(), "shingle").groupBy("shingle").count()
    ordered = parts.join(counts, "shingle", "left").select("*", F.coalesce("count", F.lit(0)).alias("frequency"))
    prefix = ordered.groupBy("window").agg(
        F.min(F.struct("frequency", "shingle", "offset", "length")).alias("p")
    ).where("p.frequency > 0").select("window", "p.shingle", "p.offset", "p.length")
    prefix = stored(prefix, "prefix")

    candidates = tokens.join(prefix, "shingle").where("position >= offset and position - offset + length <= n_words")
    candidates = stored(
        candidates.select("id", "text_hash", "window", (F.col("position") - F.col("offset")).alias("start")), "candidates"
    )
    per_doc = candidates.groupBy("id", "text_hash").agg(F.collect_set(F.struct("start", "window")).alias("found"))
    reached = with_candidates(
        docs.select(*_key(id_col, text_col), F.col(text_col).alias("text")),
        candidates.select(F.xxhash64("id", "text_hash").alias("key")), F.xxhash64("id", "text_hash"),
    )
    listed = reached.dropDuplicates(["id", "text_hash"]).alias("d")
    both = listed.join(
        per_doc.alias("c"),
        F.col("d.id").eqNullSafe(F.col("c.id")) & (F.col("d.text_hash") == F.col("c.text_hash")),
    ).select("d.id", "d.text_hash", words(F.col("d.text")).alias("w"), "c.found")
    exact = F.filter("found", lambda o: F.slice(F.col("w"), o["start"] + 1, F.size(o["window"])) == o["window"])
    return both.select("id", "text_hash", F.explode(exact).alias("o")).select("id", "text_hash", "o.window", "o.start")


def contamination(
    docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text",
    item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW, shingle: int = SHINGLE,
) -> DataFrame:
    """Rows ``(id, text_hash, n_words, n_hit, items, contaminated)``, one for each row of ``docs``.

    ``n_hit`` counts the words inside any occurrence of a window, ``items`` holds the
    sorted ids, as strings, of the items whose windows occur. A document is contaminated
    where a twentieth of its words or more are hit. Null texts have no words; items
    without words have no window; hits of an item without an id count but add no id.
    Repeated rows stay repeated, an id with several texts is judged text by text, other
    columns play no part. Without items or documents nothing is hit.
    """
    listed = stored(windows(items, item_col, item_text_col, window), "item-windows")
    places = stored(occurrences(docs, listed.select("window").distinct(), id_col, text_col, shingle), "places")
    covered = places.groupBy("id", "text_hash").agg(
        F.size(F.array_distinct(F.flatten(F.collect_list(
            F.sequence("start", F.col("start") + F.size("window") - 1)
        )))).cast("long").alias("n_hit")
    )
    named = places.select("id", "text_hash", "window").distinct().join(listed, "window").groupBy("id", "text_hash").agg(
        F.array_sort(F.collect_set("item")).alias("items")
    )
    hits = covered.alias("h").join(
        named.alias("n"),
        F.col("h.id").eqNullSafe(F.col("n.id")) & (F.col("h.text_hash") == F.col("n.text_hash")), "left",
    ).select("h.id", "h.text_hash", "h.n_hit", "n.items")
    counted = docs.select(*_key(id_col, text_col), F.size(words(F.col(text_col))).cast("long").alias("n_words"))
    joined = counted.alias("d").join(
        hits.alias("h"),
        F.col("d.id").eqNullSafe(F.col("h.id")) & (F.col("d.text_hash") == F.col("h.text_hash")), "left",
    ).select(
        F.col("d.id").alias(id_col), "d.text_hash", "d.n_words",
        F.coalesce("h.n_hit", F.lit(0).cast("long")).alias("n_hit"),
        F.coalesce("h.items", F.array().cast("array<string>")).alias("items"),
    )
    return joined.withColumn("contaminated", (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words")))


def keep_clean(
    docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text",
    item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW, shingle: int = SHINGLE,
) -> DataFrame:
    """The rows of ``docs`` that are not contaminated, with all their columns."""
    found = contamination(docs, items, id_col, text_col, item_col, item_text_col, window, shingle)
    dirty = stored(found.where("contaminated").select(F.col(id_col).alias("_id"), F.col("text_hash").alias("_hash")).distinct(), "dirty")
    same = (F.xxhash64(F.col("row")[text_col]) == F.col("_hash")) & F.col("row")[id_col].eqNullSafe(F.col("_id"))
    return as_rows(docs).join(dirty, same, "left_anti").select("row.*")
