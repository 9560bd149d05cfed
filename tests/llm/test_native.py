"""Quality rules, sharding and mixing against plain Python."""

import collections
import re
import zlib
from fractions import Fraction

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from rowtide.llm import mixing, oracle, queries, quality_rules, sharding

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def facts(text):
    text = text or ""
    ws = WORD.findall(text)
    seen = collections.Counter(zip(ws, ws[1:], ws[2:]))
    covered = {p for i in range(len(ws) - 2) if seen[tuple(ws[i : i + 3])] > 1 for p in (i, i + 1, i + 2)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    failed = len(ws) < 50 or 100 * len(covered) > 50 * len(ws)
    return (len(ws), sum(map(len, ws)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered), failed)


def test_quality_facts(spark, edge, nothing):
    texts = ["a b c a b c", "x x x x", "a b c d\na b c d\n\n x\n", "a|b ### $", "1 2 3 1 2 3 4 1 2", "one\rtwo\x0bthree\x0cfour five"]
    more = spark.createDataFrame([(100 + i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    for df in (edge, more):
        for r in quality_rules.clean_lines(df).collect():
            assert tuple(r[n] for n in names) == facts(r.text), r.text[:50]
            assert r.kept in (True, False) and (r.clean_text is None) == (r.text is None)
    assert quality_rules.clean_lines(nothing).count() == 0
    assert quality_rules.clean_lines(edge).columns.count("kept") == 1 and "extra" in quality_rules.clean_lines(edge).columns


def test_line_rules(spark):
    prose = "A sentence with words in it, ending well.\n"
    cases = {
        prose * 3: (0, prose * 3),
        prose + "Home | News | Sport | Shop | Help\n" + prose: (1, prose + prose),
        prose + "menu entry without marks\n": (1, prose),
        prose + "Permission is hereby granted, free of charge.\n": (1, prose),
    }
    df = spark.createDataFrame([(i, t) for i, t in enumerate(cases)], "doc_id long, text string")
    for r in quality_rules.clean_lines(df, min_words=1, max_repeat=1.0).collect():
        assert (r.n_removed_lines, r.clean_text) == cases[r.text]
    lost = quality_rules.clean_lines(spark.createDataFrame([(1, "Fine.\n" + "junk without marks " * 20)], "doc_id long, text string"), min_words=1, max_repeat=1.0)
    assert lost.first().kept is False


@pytest.mark.parametrize("name", sorted(oracle.ORACLE_SQL))
def test_sql(spark, sf, name):
    c = duckdb.connect()
    for t in ("documents", "benchmark", "pages"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    theirs, ours = c.sql(oracle.ORACLE_SQL[name]).df(), queries.QUERIES[name](spark, sf).toPandas()
    columns = sorted(ours.columns)
    assert columns == sorted(theirs.columns)
    tidy = lambda f: sorted(repr(tuple(None if v != v else v for v in r)) for r in f[columns].astype(object).where(f[columns].notna(), None).itertuples(index=False))
    assert tidy(ours) == tidy(theirs)


# --- sharding ----------------------------------------------------------------------


@pytest.mark.parametrize("n", [1, 2, 3, 5, 16, 17, 100, 1000, 4099])
def test_permutation(spark, n):
    images = [r[0] for r in spark.range(n).select(sharding.permuted(F.col("id"), n, 7)).collect()]
    assert sorted(images) == list(range(n)) and (n < 100 or images != list(range(n)))


def gapless(rows, shards):
    by = collections.defaultdict(list)
    for r in rows:
        by[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in by.values()) and set(by) <= set(range(shards))
    sizes = [len(by[k]) for k in range(shards)]
    assert max(sizes) - min(sizes) <= 1


@pytest.mark.parametrize("hot_rows", [1, 2, 50_000])
def test_shards(edge, nothing, hot_rows):
    made = sharding.shard_rows(edge, 4, hot_rows=hot_rows)
    rows = made.collect()
    gapless(rows, 4)
    kept = [c for c in edge.columns if c != "shard"]
    assert made.columns == [*kept, "shard", "slot"]
    plain = lambda rs: collections.Counter(tuple(r[c] for c in kept) for r in rs)
    assert plain(rows) == plain(edge.collect())
    assert sharding.shard_rows(nothing, 4).count() == 0


def test_shards_do_not_depend_on_layout(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    place = lambda df: sorted((r.doc_id, r.shard, r.slot) for r in sharding.shard_rows(df).select("doc_id", "shard", "slot").collect())
    assert place(docs) == place(docs.orderBy(F.desc("n_chars")).repartition(7))


def test_hot_rows_are_split(spark):
    df = spark.range(5000).select(F.when(F.col("id") < 4000, 0).otherwise(F.col("id")).alias("doc_id"), F.lit("t").alias("text"))
    rows = sharding.shard_rows(df, 3, hot_rows=700).collect()
    gapless(rows, 3)
    assert sum(r.doc_id == 0 for r in rows) == 4000


def test_op4(spark, sf):
    texts = {r.doc_id: (r.text or "").encode() for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = queries.QUERIES["op4_feistel_shards"](spark, sf).collect()
    gapless(rows, 16)
    assert all(r["size"] == len(texts[r.doc_id]) + 1 and r.text_crc32 == zlib.crc32(texts[r.doc_id]) and r.law == "rows" for r in rows) and len(rows) == len(texts)


# --- mixing ------------------------------------------------------------------------


def slow_targets(sizes, weights, total, cap=3):
    """Shares by weight, what is cut off shared anew until none is above."""
    out, left, todo = {}, Fraction(total), list(range(len(sizes)))
    while todo:
        share = {i: left * weights[i] / sum(weights[j] for j in todo) for i in todo}
        full = [i for i in todo if share[i] > cap * sizes[i]]
        if not full:
            out |= share
            break
        for i in full:
            out[i] = Fraction(cap * sizes[i])
            left -= out[i]
        todo = [i for i in todo if i not in full]
    return [out[i] for i in range(len(sizes))]


@pytest.mark.parametrize("sizes, total", [([100, 100, 100], 300), ([10, 1000], 1010), ([0, 10], 10), ([1, 5, 100, 200], 306), ([5], 100), ([], 0), ([0, 0], 0)])
def test_targets(spark, sizes, total):
    weights = [(3, 1, 2, 1)[i % 4] for i in range(len(sizes))]
    df = spark.createDataFrame([(s, float(w)) for s, w in zip(sizes, weights)], "source_size long, weight double")
    at = mixing.level(df, total, 3)
    assert [min(3 * s, at * w) if s else 0 for s, w in zip(sizes, weights)] == pytest.approx([float(t) for t in slow_targets(sizes, weights, total)])


def test_splitting_tree():
    quotas = [0, 1, 7, 100, 5000]
    columns = mixing.even_columns(sum(quotas), 7)
    table = mixing.split_quotas(quotas, columns, [3])
    assert (table.sum(axis=1) == quotas).all() and table.min() >= 0
    assert table.sum(axis=0).tolist() == columns and max(columns) - min(columns) <= 3
    assert (table == mixing.split_quotas(quotas, columns, [3])).all() and (table != mixing.split_quotas(quotas, columns, [4])).any()
    draws = np.array([mixing.split_quotas([300, 700], [100] * 10, [s])[0] for s in range(200)])
    assert abs(draws.mean() - 30) < 0.5 and 3 < draws.std() < 6  # hypergeometric: about 4.4


def mixed_sums(docs, **options):
    """Per source (words, taken words, target), and the placed rows."""
    rows = mixing.placed(*mixing.plan_mix(docs, **options)).select("doc_id", "source", "size", "source_size", "target", "copies", "places").collect()
    by = collections.defaultdict(lambda: [0, 0, 0.0])
    for r in rows:
        assert 0 <= r.copies <= 3 and len(r.places) == r.copies
        b = by[r.source]
        b[0], b[1], b[2] = b[0] + r["size"], b[1] + r["size"] * r.copies, r.target
    return by, rows


def near_targets(by, off):
    names = sorted(by, key=lambda s: (s is None, s or ""))
    want = slow_targets([by[s][0] for s in names], [1 + i % 3 for i in range(len(names))], sum(b[0] for b in by.values()))
    for s, t in zip(names, want):
        assert by[s][2] == pytest.approx(float(t)) and abs(by[s][1] - t) <= off, (s, by[s])


def test_mix_near_targets(spark):
    rows = [(i, " ".join(["w"] * (1 + i * 7919 % 300)), f"s{i % 4}" if i % 10 else None) for i in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    by, placed = mixed_sums(docs)
    for r in placed:
        assert r["size"] == 1 + r.doc_id * 7919 % 300
        assert r.source_size == sum(1 + i * 7919 % 300 for i, _, s in rows if s == r.source) if r.doc_id < 11 else True
    near_targets(by, 65)
    mixed = mixing.mix(docs).collect()
    assert collections.Counter(r.doc_id for r in mixed) == collections.Counter({r.doc_id: r.copies for r in placed if r.copies})
    sizes = collections.Counter(r.mix_shard for r in mixed)
    assert set(sizes) == set(range(16)) and max(sizes.values()) < 3 * min(sizes.values())
    _, again = mixed_sums(docs.repartition(5))
    assert {r.doc_id: r.places for r in again} == {r.doc_id: r.places for r in placed}


def test_mix_finds_thresholds_by_bits(spark, monkeypatch):
    monkeypatch.setattr(mixing, "LEVEL_BITS", 3)
    rows = [(i, " ".join(["w"] * (1 + i * 31 % 200)), f"s{i % 2}") for i in range(900)]
    near_targets(mixed_sums(spark.createDataFrame(rows, "doc_id long, text string, source string"))[0], 65)


@pytest.mark.parametrize("hot", [50_000, 70])
def test_mix_takes_any_number_of_equal_rows(spark, hot, monkeypatch):
    monkeypatch.setattr(mixing, "HOT_ROWS", hot)
    rows = [(1, "five words are in this", "a")] * 1000 + [(i, "four words in each", "b") for i in range(1200)] + [(5, "x y", None)] * 3
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(4)
    by, placed = mixed_sums(docs)
    near_targets(by, 5)
    mixed = mixing.mix(docs)
    got = collections.Counter((r.doc_id, r.mix_shard) for r in mixed.collect())
    want = collections.Counter((r.doc_id, p.shard) for r in placed for p in r.places)
    assert got == want and len({s for d, s in got if d == 1}) > 8  # spread over shards


def test_mix_many_sources(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BROADCAST_SOURCES", 10)
    rows = [(i, " ".join(["w"] * (1 + i * 31 % 9)), f"h{i % 700:04d}" if i % 50 else None) for i in range(4000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    by, placed = mixed_sums(docs, bucket_sources=64)
    assert len(by) > 600 and len(placed) == len(rows)
    near_targets(by, 5)
    sizes = collections.Counter(p.shard for r in placed for p in r.places)
    assert set(sizes) == set(range(16)) and max(sizes.values()) < 1.5 * min(sizes.values())


def test_mix_edges(spark, edge, nothing):
    made = mixing.mix(edge)
    assert made.columns.count("mix_shard") == 1 and {r["size"] for r in made.collect()} <= {"mine", "x", None}
    assert mixing.mix(nothing).count() == 0
    empty = spark.createDataFrame([(1, "", "a"), (2, None, None)], "doc_id long, text string, source string")
    table, plan = mixing.plan_mix(empty)
    assert {(r.target, r.copies) for r in mixing.placed(table, plan).collect()} == {(0.0, 0)}


def test_op1(spark, sf):
    docs = {r.doc_id: r for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = queries.QUERIES["op1_mix_sources"](spark, sf).collect()
    assert len(rows) == len(docs) and all(r["size"] == len(re.findall("[^ \t-\r]+", docs[r.doc_id].text or "")) for r in rows)
    by = collections.defaultdict(lambda: [0, 0, 0.0])
    for r in rows:
        b = by[docs[r.doc_id].source]
        b[0], b[1], b[2] = b[0] + r["size"], b[1] + r.taken, r.target
        assert r.taken <= 3 * r["size"] and len(r.shards) == r.copies
    near_targets(by, 300)


THAI = "ข้อความภาษาไทยไม่มีเครื่องหมายจบประโยค"
UNMARKED = [THAI, "ຂໍ້ຄວາມພາສາລາວ ບໍ່ມີເຄື່ອງໝາຍ", "မြန်မာစာ။", "អត្ថបទ។", "བོད་ཡིག།", "हिन्दी॥"]


def test_scripts_without_sentence_marks(spark):
    """Lines of Thai and Lao are no fragments; Burmese, Khmer, Tibetan and Devanagari end by marks of their own."""
    rows = [(i, "\n".join([line] * 3)) for i, line in enumerate([*UNMARKED, "no marks here", "Ελληνικά χωρίς σημεία"])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    lost = {r.doc_id: r.n_removed_lines for r in quality_rules.clean_lines(docs).collect()}
    assert lost == {i: 3 * (i >= len(UNMARKED)) for i, _ in rows}
    duck = duckdb.connect()
    frame = docs.toPandas()
    duck.register("documents", frame)
    assert dict(duck.sql(f"SELECT doc_id, n_removed_lines FROM ({oracle.QUALITY_RULES})").fetchall()) == lost


def test_numbers_over_many_ranges(spark, monkeypatch):
    """First numbers of buckets and of hot groups come from sums over ranges of them."""
    monkeypatch.setattr(sharding, "RANGE", 3)
    docs = spark.range(3000).select((F.col("id") % 1000).alias("x")).unionByName(spark.range(40).select(F.lit(-1).cast("long").alias("x")))
    for hot in (2, 50_000):
        numbered, n = sharding.number_rows(docs, hot_rows=hot, bucket_rows=10)
        assert n == 3040 and sorted(r[0] for r in numbered.select(sharding.NUMBER).collect()) == list(range(3040))


def test_written_shards(spark, tmp_path, edge):
    rows = edge.drop("size").withColumn("part", F.lit("mine"))
    sharded = sharding.shard_rows(rows, 3)
    sharding.write_shards(sharded, str(tmp_path / "out"), part_rows=2)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.count() == rows.count() and all(r.part == r.slot // 2 for r in back.collect())
    for folder in tmp_path.glob("out/shard=*/part=*"):
        own = [r.slot for r in spark.read.parquet(str(folder)).collect()]
        assert own == sorted(own) and len(own) <= 2
    sharding.write_shards(sharding.shard_rows(rows.limit(0), 3), str(tmp_path / "none"))
