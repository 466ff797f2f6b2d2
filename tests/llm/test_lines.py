"""Line removal against brute force over all pairs of lines."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from wattfleet.llm import lines as L

SPACES = " \t\n\x0b\x0c\r"


def shingles(line):
    return {line[i : i + 8] for i in range(len(line) - 7)} or {line}


def slow(docs, similarity=0.8):
    """Text, number of lines and of removed lines per document; documents in order of id."""
    first, sets = {}, {}
    for name, text in docs:
        for number, line in enumerate((text or "").split("\n")):
            if line.strip(SPACES):
                first.setdefault(line, (name, number))
                sets[line] = shingles(line)
    distinct = list(first)
    root = {line: line for line in distinct}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(distinct):
        for b in distinct[:i]:
            both = len(sets[a] & sets[b])
            if both and both >= similarity * (len(sets[a]) + len(sets[b]) - both):
                root[find(a)] = find(b)
    kept = {}
    for line, place in first.items():
        kept[find(line)] = min(kept.get(find(line), place), place)
    out = {}
    for name, text in docs:
        rows = (text or "").split("\n")
        stay = [x for n, x in enumerate(rows) if not x.strip(SPACES) or kept[find(x)] == (name, n)]
        out[name] = (text if text is None else "\n".join(stay), sum(1 for x in rows if x.strip(SPACES)), len(rows) - len(stay))
    return out


def same(spark, docs):
    got = L.dedup_lines(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert {r.doc_id: (r.text, r.n_lines, r.n_removed) for r in got} == slow(docs) and len(got) == len(docs)


def test_test_documents(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").orderBy("doc_id").select("doc_id", "text").collect()
    same(spark, [tuple(r) for r in docs])


def test_families_of_near_lines(spark):
    rng = random.Random(2)
    rows = []
    for _ in range(12):
        base = "".join(rng.choice("abcdefghijklmnopqrstu ") for _ in range(rng.choice([9, 120, 300])))
        for _ in range(25):
            at = rng.randrange(len(base))
            # Chains: each line is near the one before, not all are near each other.
            base = base[:at] + rng.choice("xyzé😀") + base[at + 1 :] if len(base) > 50 else base
            rows.append(base)
    rng.shuffle(rows)
    docs = [(i, "\n".join(rows[3 * i : 3 * i + 3])) for i in range(100)]
    same(spark, docs)


def test_edge_cases(spark):
    long = "word " * 60_000
    docs = [(1, None), (2, ""), (3, "\n\n"), (4, "a"), (5, "a\na"), (6, " \t\na"), (7, long), (8, long + "!"),
            (9, "keep me, a line of its own\n\na"), (10, "é" * 7), (11, "é" * 7)]
    same(spark, docs)


def test_nulls_repeated_rows_and_other_columns(spark):
    rows = [(1, "same line here", "x"), (1, "same line here", "x"), (1, "another\nsame line here", "y"), (None, "same line here", "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, line string").withColumn("component", F.lit(1))
    got = L.dedup_lines(docs)
    assert got.columns == ["doc_id", "text", "line", "component", "n_lines", "n_removed"] or set(got.columns) == {
        "doc_id", "text", "line", "component", "n_lines", "n_removed"}
    found = sorted((r.line, r.text) for r in got.collect())
    # Which of two texts of one id comes first is settled by the hash of the text.
    assert found in ([("x", ""), ("x", ""), ("y", "another\nsame line here"), ("z", "")],
                     [("x", "same line here"), ("x", "same line here"), ("y", "another"), ("z", "")])
    assert L.dedup_lines(docs.limit(0)).count() == 0


def test_bands_find_similar_lines():
    rng = random.Random(7)
    hit = total = 0
    for _ in range(2000):
        n = rng.choice([60, 120, 400, 900])
        a = "".join(rng.choice("abcdefghijklmnop ") for _ in range(n))
        b = list(a)
        for _ in range(max(1, n // 90)):
            b[rng.randrange(n)] = rng.choice("uvwxyz")
        b = "".join(b)
        if 0.8 <= L.jaccard(a, b) < 0.9:
            x, y = L.band_keys(L.signatures([a, b]))
            total, hit = total + 1, hit + bool((x == y).any())
    assert total > 500 and hit >= 0.99 * total


@pytest.mark.parametrize("similarity,recall", [(0.8, 0.97), (0.85, 0.99), (0.9, 0.999)])
@pytest.mark.parametrize("length", [40, 150, 600])
def test_recall_of_bands(similarity, recall, length):
    rng = random.Random(length)
    hit = total = 0
    while total < 600:
        a = "".join(rng.choice("abcdefghijklmnop ") for _ in range(length))
        b = list(a)
        for _ in range(rng.randint(1, max(1, length // 50))):
            b[rng.randrange(length)] = rng.choice("uvwxyz")
        b = "".join(b)
        if rng.random() < 0.5:
            b += "".join(rng.choice("qrst") for _ in range(rng.randint(0, length // 6)))
        if similarity <= L.jaccard(a, b) < similarity + 0.03:
            x, y = L.band_keys(L.signatures([a, b]))
            total, hit = total + 1, hit + bool((x == y).any())
    assert hit >= recall * total


def test_bitmaps_never_rule_out_a_link():
    rng = random.Random(11)
    for _ in range(1500):
        a = "".join(rng.choice("abcdefgh ") for _ in range(rng.randint(1, 900)))
        b = list(a)
        for _ in range(rng.randint(0, max(1, len(a) // 40))):
            b[rng.randrange(len(b))] = rng.choice("xyz")
        b = "".join(b) + "tail" * rng.randint(0, 3)
        n, bits = L.sketches([a, b])
        assert n.tolist() == [len(shingles(a)), len(shingles(b))]
        ones = np.bitwise_count(bits.view(np.uint64)).sum(axis=1)
        both = int(np.bitwise_count((bits[0] & bits[1]).view(np.uint64)).sum())
        bound = min((n[0] - (ones[0] - both)) / (n[0] + ones[1] - both), (n[1] - (ones[1] - both)) / (n[1] + ones[0] - both))
        assert L.jaccard(a, b) <= bound + 1e-12


@pytest.mark.parametrize("batches", [1, 3, 7])
def test_shared_keys_over_batches(batches):
    import pyarrow as pa

    rows = sorted([(1, 5), (1, 5), (2, 1), (2, 2), (2, 2), (2, 9), (3, 3), (4, 1), (4, 1), (5, 1), (5, 2)])
    cuts = [round(i * len(rows) / batches) for i in range(batches + 1)]
    parts = [pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows[a:b]], pa.int64()) for k in (0, 1)], ["key", "line"])
             for a, b in zip(cuts, cuts[1:], strict=False)]
    found = [tuple(r.values()) for part in L._shared(iter(parts)) for r in part.to_pylist()]
    assert sorted(found) == [(2, 1), (2, 2), (2, 9), (5, 1), (5, 2)]


def test_bound_of_two_sketches_counts_their_common_bits_once(spark):
    rng = random.Random(12)
    lines = ["".join(rng.choice("abc") for _ in range(rng.randint(8, 60))) for _ in range(30)]
    lines += [line[: len(line) - 2] + "zz" for line in lines] + [line + "q" for line in lines]
    n, bits = L.sketches(lines)
    rows = [(i, int(n[i]), int(np.bitwise_count(bits[i].view(np.uint64)).sum()), *map(int, bits[i])) for i in range(len(lines))]
    df = spark.createDataFrame(rows, ", ".join(f"{c} long" for c in ("line", "n", "ones", *L._BITS)))
    condition = L._may_reach("x", "y", 0.8)
    assert str(condition).count("bit_count") == len(L._BITS)
    pairs = df.alias("x").join(df.alias("y"), condition).select("x.line", "y.line").collect()

    def bound(i, j):
        both = int(np.bitwise_count((bits[i] & bits[j]).view(np.uint64)).sum())
        own, others = rows[i][2] - both, rows[j][2] - both
        s = 0.8 - 1e-9
        sizes = n[i] >= s * n[j] and n[j] >= s * n[i]
        return sizes and n[i] - own >= s * (n[i] + others) and n[j] - others >= s * (n[j] + own)

    expected = {(i, j) for i in range(len(lines)) for j in range(len(lines)) if bound(i, j)}
    assert {tuple(p) for p in pairs} == expected and len(lines) < len(expected) < len(lines) ** 2
    assert all((i, j) in expected for i in range(len(lines)) for j in range(len(lines)) if L.jaccard(lines[i], lines[j]) >= 0.8)


def test_packed_shingles_give_the_exact_similarity():
    rng = random.Random(13)
    exact = L._Exact(8)
    assert L._packed("latin one: é, ÿ", 8) is not None and L._packed("short", 8) is None and L._packed("the cedi: ₵ and more", 8) is None
    assert L._packed("nine characters", 9) is None
    for _ in range(1500):
        letters = rng.choice(["ab", "abcdefgh é\0ÿ", "abcdefgh ₵😀"])
        a = "".join(rng.choice(letters) for _ in range(rng.randint(1, 200)))
        b = "".join(rng.choice(["", c, c, c, c, c, c, rng.choice("xÿ₵")]) for c in a) + "tail" * rng.randint(0, 2) or "x"
        x, y = shingles(a), shingles(b)
        assert exact.jaccard(a, b) == exact.jaccard(b, a) == len(x & y) / len(x | y) == L.jaccard(a, b)


def test_hashes_of_runs_are_one_polynomial():
    codes = np.random.default_rng(14).integers(0, 1 << 21, 300).astype(np.uint64)
    for size in range(1, 20):
        slow = np.zeros(len(codes) - size + 1, np.uint64)
        for i in range(size):
            slow = slow * np.uint64(0x9E3779B97F4A7C15) + codes[i : i + len(slow)]
        assert (L._shingle_hashes(codes, size) == slow).all()


def test_blank_lines(spark):
    lines = ["", " ", "\t\r\x0b\x0c ", " a ", "a", "\xa0", " ", "\x00", " \x1f"]
    df = spark.createDataFrame([(line,) for line in lines], "line string")
    assert [r[0] for r in df.select(L._not_blank(F.col("line"))).collect()] == [bool(line.strip(SPACES)) for line in lines]
    # Looking at a line's start is enough; trimming its end goes over the whole line.
    assert "btrim" not in df.where(L._not_blank(F.col("line")))._jdf.queryExecution().optimizedPlan().toString()


def test_a_text_is_hashed_before_its_lines_are_rows(spark):
    docs = spark.createDataFrame([(1, "a\nb")], "doc_id long, text string")
    listed = L._lines(docs, "doc_id", "text", keep_text=False)
    plan = listed._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Generate posexplode") < plan.index("AS text_hash") and sorted(r.number for r in listed.collect()) == [0, 1]
