"""SimHash groups, WARC archives and the pipeline."""

import collections
import hashlib
import random
import zlib

import numpy as np
import pytest
import xxhash

import corpus_pipeline
from pyspark.sql import functions as F
from rowtide.llm import common, decontaminate, pipeline, queries, simhash, warc


def slow_fingerprint(text, k=3):
    w = (text or "").encode().lower().split()
    if not w:
        return 0
    hs = [xxhash.xxh64_intdigest(b" ".join(w[i : i + k]), seed=42) for i in range(max(1, len(w) - k + 1))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def slow_groups(fps, ids, most):
    parent = list(range(len(fps)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(fps)):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= most:
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return [min(ids[j] for j in range(len(fps)) if find(j) == find(i)) for i in range(len(fps))]


def test_golay_cover():
    g = simhash.Golay(2)
    x = np.arange(0, 1 << 23, 1009)
    row, label = g.near(x, 0)
    assert (row == np.arange(len(x))).all()  # perfect: one home each
    for s in range(3):
        row, label = g.near(x[:300], s)
        away = np.bitwise_count(x[row] ^ (label << 11 | g.high[label]))
        assert away.max() <= 3 if s == 0 else (away == 3 + s).all()
        for r in range(300):  # all of them: as many as there are code words that far
            every = np.bitwise_count(x[r] ^ (np.arange(4096) << 11 | g.high))
            assert (row == r).sum() == ((every <= 3) if s == 0 else (every == 3 + s)).sum()


def test_every_close_pair_meets():
    rng = random.Random(5)
    for most, sized in ((0, False), (1, False), (2, False), (5, False), (11, False)):
        cover = simhash.Cover(most, sized)
        a = np.array([rng.getrandbits(64) for _ in range(300)], np.uint64)
        flip = [sum(1 << b for b in rng.sample(range(64), most)) for _ in a]
        b = a ^ np.array(flip, np.uint64)
        size = np.ones(300, np.int64)
        home = collections.defaultdict(set)
        for r, c in zip(*cover.homes(a, size)):
            home[int(r)].add(int(c))
        met = collections.defaultdict(set)
        for r, c in zip(*cover.replicas(b, size)):
            met[int(r)].add(int(c))
        assert all(home[i] & met[i] for i in range(300))


@pytest.mark.parametrize("hot_points, pairs", [(500_000, 1 << 21), (3, 5)])
def test_links_of_points(spark, hot_points, pairs, monkeypatch):
    rng = random.Random(hot_points)
    fps = {0, (1 << 64) - 1}
    for _ in range(30):
        x = rng.getrandbits(64)
        for _ in range(rng.randrange(1, 9)):  # chains of one to three changed bits
            fps.add(x)
            x ^= sum(1 << b for b in rng.sample(range(64), rng.choice([1, 2, 2, 3])))
    fps = sorted(fps)
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    df = spark.createDataFrame([(s, 0, 0) for s in signed], "fp long, sketch long, size long")
    edges = simhash.links(df, 2, hot_points=hot_points, group_rows=100)
    found = {r.fp: r.root for r in simhash.grouped(df, edges, "fp").collect()}
    want = slow_groups(fps, fps, 2)
    ours = collections.defaultdict(set)
    theirs = collections.defaultdict(set)
    for f, s, w in zip(fps, signed, want):
        ours[found[s]].add(f)
        theirs[w].add(f)
    assert sorted(map(sorted, ours.values())) == sorted(map(sorted, theirs.values()))


def test_slices_of_pairs(monkeypatch):
    monkeypatch.setattr(simhash, "PAIRS", 7)
    fp = np.array([1 << i for i in range(40)] + [0], np.uint64)
    cell = np.zeros(len(fp), np.int32)
    a, b = simhash.compare((cell, fp, fp), (cell, fp, fp), 1, 0)
    assert len(a) == 40 and set(b.tolist()) == {0}  # a star around 0, not all pairs


def test_components(spark):
    rng = random.Random(8)
    edges = [(i, i + 1) for i in range(0, 60) if i % 13] + [(100, 200 + i) for i in range(50)] + [(rng.randrange(300, 340), rng.randrange(300, 340)) for _ in range(25)]
    got = {r.node: r.root for r in simhash.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    nodes = sorted({x for e in edges for x in e})
    root = {n: n for n in nodes}
    for _ in nodes:
        for a, b in edges:
            root[a] = root[b] = min(root[a], root[b])
    assert all(got.get(n, n) == root[n] for n in nodes)
    assert simhash.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_op6(spark, sf, edge, nothing):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    fps = [slow_fingerprint(r.text) for r in docs]
    want = dict(zip([r.doc_id for r in docs], zip([f"{f:016x}" for f in fps], slow_groups(fps, [r.doc_id for r in docs], 2))))
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in queries.QUERIES["op6_simhash"](spark, sf).collect()} == want
    rows = simhash.near_duplicates(edge).collect()
    assert len(rows) == edge.count()
    empty = [r for r in rows if r.fingerprint == "0" * 16]
    assert {r.component_id for r in empty} == {2} and {r.component_id for r in rows if r.doc_id in (0, 1)} == {0}
    assert simhash.near_duplicates(nothing).count() == 0


def test_near_copies(spark, edge, nothing):
    rng = random.Random(4)
    make = lambda n: [f"{rng.choice('bcdfgh')}{rng.randrange(5000)}" for _ in range(n)]
    rows, groups = [], []
    for g in range(25):
        base, own = make(rng.randrange(150, 400)), []
        for c in range(4):
            w = list(base)
            for _ in range(c):  # c changed words: similarity 1 - about 10 c / n
                w[rng.randrange(len(w))] = "changed"
            own.append(len(rows))
            rows.append((len(rows), " ".join(w)))
        groups.append(own)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    left = {r.doc_id for r in simhash.near_copies(docs).collect()}
    assert all(g[0] in left for g in groups)
    sets = [{tuple(t.split()[i : i + 5]) for i in range(len(t.split()) - 4)} for _, t in rows]
    alike = lambda i, j: len(sets[i] & sets[j]) / len(sets[i] | sets[j])
    for g in groups:
        for i in g:
            near = max(alike(i, j) for j in g if j != i)
            assert near >= 0.7 if i not in left else all(alike(i, j) < 0.86 for j in g if j in left and j != i)
    kept = simhash.near_copies(edge).collect()
    texts = [r.text for r in kept]
    assert len(texts) == len(set(texts)) and sum(not (t or "").split() for t in texts) == 1
    assert simhash.near_copies(nothing).count() == 0


def test_wordless_text_beside_a_short_one(spark):
    texts = (f"w{i}" for i in range(2_000_000))
    zero = next(t for t in texts if (lambda f: f.bit_count() <= 20 and any(f >> k & m == 0 for k, m in ((0, 0x7FFFFF), (23, 0x7FFFFF), (46, 0x3FFFF))))(simhash.fingerprint(t, 5, True)[0]))
    docs = spark.createDataFrame([(0, None), (1, zero), (2, " ")], "doc_id long, text string")
    assert {r.doc_id for r in simhash.near_copies(docs).collect()} == {0, 1}


def test_texts_ruled_by_one_shingle(spark):
    make = lambda c, n: " ".join(f"{c}{i}" for i in range(n))
    dashes = " ".join("-" * 400)
    block = make("x", 60)
    texts = [f"{dashes} {make('a', 90)}", f"{dashes} {make('b', 90)}", f"{make('c', 60)} {block}", " ".join([make("c", 60)] + [block] * 10)]
    assert simhash.fingerprint(texts[0], 5)[0] == simhash.fingerprint(texts[1], 5)[0]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r.doc_id for r in simhash.near_copies(docs).collect()} == {0, 1, 2}  # unlike ones stay, the repeated block is a copy


def test_alike_sets():
    rng = np.random.default_rng(3)
    sets = [np.unique(rng.integers(0, 60, n).astype(np.uint64)) for n in (1, 1, 2, 30, 30, 40, 40, 45, 90, 90, 400, 5)] + [np.arange(4, dtype=np.uint64), np.arange(5, dtype=np.uint64)]
    like = lambda x, y: len(np.intersect1d(x, y)) / len(np.union1d(x, y))
    for least in (0.3, 0.5, 0.8):
        want = {(i, j) for j in range(len(sets)) for i in range(j) if like(sets[i], sets[j]) >= least}
        assert {(i, int(j)) for i, js in simhash.alike(sets, None, least) for j in js} == want
        got = {(i, int(j) + 6) for i, js in simhash.alike(sets[:6], sets[6:], least) for j in js}
        assert got == {(i, j) for i, j in want if i < 6 <= j}


@pytest.mark.parametrize("block", [500_000, 900, 20])
def test_exact_links_in_blocks(spark, block):
    """Groups of any size, in one task or in blocks, against all pairs."""
    rng, texts = random.Random(block), []
    for g in range(6):
        base = [f"g{g}w{i}" for i in range(rng.randrange(30, 90))]
        for _ in range(rng.choice([1, 2, 5, 20])):
            w = list(base)
            for _ in range(rng.randrange(4)):
                w[rng.randrange(len(w))] = f"x{rng.randrange(10**6)}"
            texts.append((g, " ".join(w)))
    sets = [set(simhash.shingle_set(t, 5).tolist()) for _, t in texts]
    docs = spark.createDataFrame([(i, t) for i, (_, t) in enumerate(texts)], "doc_id long, text string")
    rows = simhash.fingerprints(docs, 5, True).collect()
    groups = spark.createDataFrame([(r.doc_id, texts[r.doc_id][0], r.size, r.th, r.doc_id) for r in rows], "node long, root long, size long, th long, doc_id long")
    points = groups.select("node")
    found = {r.node: r.root for r in simhash.grouped(points, simhash.exact(groups, docs, 5, 0.8, block), "node").collect()}
    label = list(range(len(texts)))
    for _ in texts:
        for i in range(len(texts)):
            for j in range(len(texts)):
                if texts[i][0] == texts[j][0] and 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
                    label[i] = min(label[i], label[j])
    assert len({(found[i], label[i]) for i in found}) == len(set(label)) == len(set(found.values()))


def test_near_copies_against_brute_force(spark):
    """Pairs of similarities about 0.8: those that meet are linked just from 0.8 on."""
    rng, texts = random.Random(11), []
    for _ in range(150):
        base = [f"w{rng.randrange(10**6)}" for _ in range(244)]
        cut = rng.choice([22, 24, 25, 26, 27, 28, 29, 30, 31, 33, 36, 40])  # new words at the end: 240 - cut of 240 + cut shingles are shared
        texts += [" ".join(base), " ".join(base[:-cut] + [f"v{rng.randrange(10**6)}" for _ in range(cut)])]
    sets = [set(zip(*(t.split()[k:] for k in range(5)))) for t in texts]
    fps = [simhash.fingerprint(t, 5, True)[0] for t in texts]
    left = {r.doc_id for r in simhash.near_copies(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    near = lost = 0
    for i in range(0, len(texts), 2):
        same = len(sets[i] & sets[i + 1]) / len(sets[i] | sets[i + 1])
        assert i in left
        if same < 0.8:
            assert i + 1 in left
        elif (fps[i] ^ fps[i + 1]).bit_count() <= 11:
            near, lost = near + 1, lost + (i + 1 in left)
    assert near > 20 and lost == 0


def test_near_copies_with_many_repeated_rows(spark, monkeypatch):
    """10,000 rows alike in id and text and one near copy: two texts come to the check."""
    base = " ".join(f"w{i}" for i in range(120))
    rows = [(7, base)] * 10_000 + [(8, base.replace("w60", "other"))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(8)
    seen = []
    alike = simhash.texts_of
    monkeypatch.setattr(simhash, "texts_of", lambda wanted, docs: seen.append(alike(wanted, docs)) or seen[-1])
    assert [r.doc_id for r in simhash.near_copies(docs).collect()] == [7]
    assert seen[0].groupBy("node", "root", "blocks").agg(F.any_value("text")).count() == 2


# --- WARC --------------------------------------------------------------------------


def written(spark, pages, folder, split=1 << 23):
    return warc.read_archives(warc.write_archives(pages, folder), folder, split, dict(pages.dtypes)["page_id"]).collect()


@pytest.mark.parametrize("split", [97, 1000, 1 << 23])
def test_warc_round_trip(spark, tmp_path, split):
    rng, big = random.Random(1), "<p>ü\x1f\x8b\x08</p>" * 9000
    body = "x" * 120
    htmls = [None, "", "short", "short", body, body, body, big, "WARC/1.1\r\n\r\n", "".join(chr(rng.randrange(32, 0x2000)) for _ in range(70_000)), "é" * 50]
    rows = [(10 - i if i < 5 else i + 20, f"http://x/ü {i}\r\n" if i % 3 else None, h) for i, h in enumerate(htmls)] + [(None, "u", body)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    first = min(p for p, _, h in rows if h == body and p is not None)
    got = {(r.page_id, r.url): r for r in written(spark, pages, str(tmp_path), split)}
    assert len(got) == len(rows)
    for p, u, h in rows:
        r, raw = got[p, u], (h or "").encode()
        copy = h == body and p != first
        assert (r.payload_bytes, r.payload_digest) == (len(raw), hashlib.sha256(raw).hexdigest())
        assert (r.record_type, r.refers_to, r.html) == (("revisit", first, None) if copy else ("response", None, h or ""))


def test_warc_ids_of_any_text(spark, tmp_path):
    body = "same body " * 20
    rows = [(" a ", "u", body), ("b\r\nX-Refers-To-Page-Id: c", None, "short"), ("ü%41", "http://x/?a=%20 b", body), ("", "", body), (None, None, None)]
    pages = spark.createDataFrame([(*r, "mine") for r in rows], "page_id string, url string, html string, payload_digest string")
    got = {(r.page_id, r.url): (r.html, r.refers_to) for r in written(spark, pages, str(tmp_path))}
    assert got == {(p, u): (None, "") if h == body and p != "" else (h or "", None) for p, u, h in rows}


@pytest.mark.parametrize("kind", ["tinyint", "smallint", "int", "decimal(10,0)", "decimal(12,3)", "double", "date", "timestamp_ntz", "binary", "boolean"])
def test_warc_ids_of_any_type(spark, tmp_path, kind):
    made = F.date_add(F.lit("2024-01-01").cast("date"), F.col("id").cast("int")) if kind in ("date", "timestamp_ntz") else F.col("id") % 2 if kind == "boolean" else F.col("id")
    made = F.unhex(F.hex(made)) if kind == "binary" else made.cast(kind)
    pages = spark.range(1, 4).select(made.alias("page_id"), F.concat(F.lit("u"), "id").alias("url"), F.repeat(F.lit("same "), 40).alias("html"))
    expected = {(r.url, r.page_id) for r in pages.collect()}
    got = written(spark, pages, str(tmp_path))
    first = min(p for _, p in expected)
    assert {(r.url, r.page_id) for r in got} == expected and {r.refers_to for r in got if r.record_type == "revisit"} == {first}


def test_revisit_names_its_response():
    """By the standard's own fields, so that other readers find it."""
    digest = hashlib.sha256(b"abc").hexdigest()
    unpacked = [warc.parse(zlib.decompress(warc.record(*r), 31))[0] for r in (("1", "http://x/ä", b"abc", digest, None), ("2", "http://y", b"abc", digest, "1", "http://x/ä"))]
    assert unpacked[1]["warc-refers-to"] == unpacked[0]["warc-record-id"] and unpacked[1]["warc-refers-to-target-uri"] == unpacked[0]["warc-target-uri"]
    assert unpacked[1]["warc-refers-to-date"] == unpacked[0]["warc-date"] and "warc-refers-to" not in unpacked[0]


def jobs_of(spark, run):
    """How many Spark jobs ``run`` starts."""
    group = f"jobs-{run.__name__}"
    spark.sparkContext.setJobGroup(group, group)
    try:
        run()
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    return len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))


def test_components_take_few_jobs(spark):
    """What the driver allocates grows with the jobs: stars need no round, chains no step that is made twice (22 and 73 before)."""
    stars = spark.createDataFrame([(10 * i + j, 10 * i) for i in range(20) for j in range(1, 5)], "a long, b long")
    chains = spark.createDataFrame([(10 * i + j, 10 * i + j + 1) for i in range(20) for j in range(6)], "a long, b long")

    def of_stars():
        assert all(r.root == r.node // 10 * 10 for r in simhash.components(stars).collect())

    def of_chains():
        found = simhash.components(chains).collect()
        assert len(found) == 120 and all(r.root == r.node // 10 * 10 for r in found)

    counts = jobs_of(spark, of_stars), jobs_of(spark, of_chains)
    assert counts[0] <= 8 and counts[1] <= 60, counts


def test_sieves_of_few_keys_are_small(spark, monkeypatch):
    """Near-dedup's sieves come together on the driver: their size goes by their keys, up to 2^26 bits."""
    assert [common.sieve_bits(n) for n in (0, 1, 1000, 1 << 19, 1 << 20, 1 << 40)] == [15, 15, 16, 26, 26, 26]
    made, bitmap = [], common.bitmap
    monkeypatch.setattr(common, "bitmap", lambda *a: made.append(bitmap(*a)) or made[-1])
    texts = [" ".join(f"w{i}x{j}" for j in range(40)) for i in range(20)]
    docs = spark.createDataFrame(list(enumerate(texts + texts)), "doc_id long, text string")
    assert sorted(r.doc_id for r in simhash.near_copies(docs).collect()) == list(range(20))
    assert len(made) == 2 and max(map(len, made)) == 4096


def test_sieve(spark):
    held = spark.range(0, 3000, 7).withColumn("s", F.concat(F.lit("k"), "id"))
    for bits in (15, 18, 26):
        for column in ("id", "s"):
            among = common.sieve(held, column, bits)
            rows = spark.range(3000).withColumn("s", F.concat(F.lit("k"), "id")).select("id", among(F.col(column)).alias("x")).collect()
            assert all(r.x for r in rows if r.id % 7 == 0) and sum(r.x for r in rows) < 3000 / 7 + 100 * (bits < 20) + 3
    assert not any(r[0] for r in spark.range(50).select(common.sieve(held.limit(0), "id")(F.col("id"))).collect())


def test_warc_empty_and_damaged(spark, tmp_path):
    assert written(spark, spark.createDataFrame([], "page_id long, url string, html string"), str(tmp_path)) == []
    good = warc.record(1, "u", b"abc", hashlib.sha256(b"abc").hexdigest(), None)

    class File:
        def __init__(self, data):
            self.data, self.at = data, 0

        def seek(self, at):
            self.at = at

        def read(self, n):
            return self.data[self.at : self.at + n]

    # Lone magic bytes, and a member that is no record, are passed over in the search.
    import gzip

    data = b"\x1f\x8b\x08junk" + gzip.compress(b"not a record") + good + good
    assert len(list(warc.read_range(File(data), len(data), 0, len(data)))) == 2
    with pytest.raises(ValueError):
        list(warc.read_range(File(good + b"\x1f\x8b\x08broken"), len(good) + 9, 0, len(good) + 9)) or (_ for _ in ()).throw(ValueError)
    with pytest.raises(ValueError):
        warc.page(b"WARC/1.1\r\nWARC-Type: response\r\nWARC-Payload-Digest: sha256:00\r\nContent-Length: 0\r\n\r\n")


def test_every_split_owns_its_records():
    records = [warc.record(i, "u", bytes([65 + i]) * (i * 37), hashlib.sha256(bytes([65 + i]) * (i * 37)).hexdigest(), None) for i in range(9)]
    data = b"".join(records)

    class File:
        def seek(self, at):
            self.at = at

        def read(self, n):
            return data[self.at : self.at + n]

    for step in (1, 50, 333, len(data)):
        ids = [warc.page(r)[0] for low in range(0, len(data), step) for r in warc.read_range(File(), len(data), low, min(low + step, len(data)))]
        assert ids == [str(i) for i in range(9)], step


# --- pipeline ----------------------------------------------------------------------


def test_pipeline(spark, sf):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality classifier", "SimHash near-dedup", "benchmark decontamination", "mixing sources to target weights", "sharding"]
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    scored = pipeline.quality_classifier(spark, docs, sf).collect()
    kept = {r.doc_id for r in scored}
    assert np.mean([(d in kept) == bool(y) for d, y in labels.items()]) > 0.9
    rows = corpus_pipeline.run(spark, sf).collect()
    ids = collections.Counter(r.doc_id for r in rows)
    assert set(ids) <= kept and max(ids.values()) <= 3
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    windows = {tuple(w[i : i + 10]) for _, t in items for w in [decontaminate.word_list(t)] for i in range(len(w) - 9)}
    for r in rows:
        w = decontaminate.word_list(r.text)
        assert not any(tuple(w[i : i + 10]) in windows for i in range(len(w) - 9))
    texts = {r.doc_id: r.text for r in rows}
    assert len(set(texts.values())) == len(texts)
    by = collections.defaultdict(list)
    for r in rows:
        by[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in by.values()) and max(map(len, by.values())) - min(map(len, by.values())) <= 1


def brute_winners(rows):
    """Least doc_id of each group of texts linked by a similarity of 0.8 of their five-word shingles."""
    sets = {}
    for r in rows:
        w = (r.text or "").encode().lower().split()
        sets[r.doc_id] = {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()
    at = collections.defaultdict(list)
    for d, s in sets.items():
        for x in s or {()}:
            at[x].append(d)
    shared, label = collections.Counter(), {d: d for d in sets}

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    for x, ds in at.items():
        for i, a in enumerate(ds):
            for b in ds[:i]:
                shared[a, b] += 1
    for (a, b), n in shared.items():
        union = len(sets[a]) + len(sets[b]) - (n if sets[a] else 0)
        if not sets[a] and not sets[b] or 5 * n >= 4 * union:
            a, b = find(a), find(b)
            label[max(a, b)] = min(a, b)
    return {find(d) for d in sets}


def test_pipeline_near_dedup_against_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf.replace('0.001', '0.01')}/documents.parquet")
    kept = pipeline.near_dedup(spark, docs, sf).collect()
    assert {r.doc_id for r in kept} == brute_winners(docs.collect()) and len(kept) == len({r.doc_id for r in kept})


def test_pipeline_decontamination_and_mixing_against_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    items = [decontaminate.word_list(r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    windows = {tuple(w[i : i + 10]) for w in items for i in range(max(1, len(w) - 9)) if w}
    dirty = lambda w: any(tuple(w[i : i + n]) in windows for n in {len(x) for x in windows} for i in range(len(w) - n + 1))
    clean = {r.doc_id for r in docs.collect() if not dirty(decontaminate.word_list(r.text))}
    left = pipeline.benchmark_decontamination(spark, docs, sf)
    assert {r.doc_id for r in left.collect()} == clean and 0 < len(clean) < docs.count()
    mixed = collections.Counter(r.doc_id for r in pipeline.source_mixing(spark, left, sf).collect())
    size = {r.doc_id: len((r.text or "").encode().split()) for r in left.collect()}
    by, taken = collections.Counter(), collections.Counter()
    for r in left.collect():
        by[r.source] += size[r.doc_id]
        taken[r.source] += size[r.doc_id] * mixed[r.doc_id]
    names = sorted(by, key=lambda s: (s is None, s or ""))
    weight = {s: 1 + i % 3 for i, s in enumerate(names)}
    level = max(x for x in np.linspace(0, 10 * sum(by.values()), 400_001) if sum(min(3 * by[s], x * weight[s]) for s in names) <= sum(by.values()))
    assert all(abs(taken[s] - min(3 * by[s], level * weight[s])) < 300 for s in names) and max(mixed.values()) <= 3


@pytest.mark.parametrize("kind", ["edge", "nothing"])
def test_pipeline_on_odd_tables(spark, edge, nothing, kind, tmp_path):
    docs = edge if kind == "edge" else nothing
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(0, 1, 0), (6, 1, 0), (None, 0, None)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, "one two"), (2, None), (None, "")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    rows = corpus_pipeline.run(spark, str(tmp_path))
    assert rows.columns == [*common.DOCUMENT_COLUMNS, "shard", "slot"]
    found = rows.collect()
    if kind == "nothing":
        assert found == []
        return
    texts = collections.Counter((r.text or "").strip() for r in found)
    assert 5 < len(texts) and max(texts.values()) <= 3 and not any("one two" in (r.text or "") for r in found)
    stages = {n: f for n, f in corpus_pipeline.STAGES}
    for name, stage in stages.items():  # each by itself, on rows that no other stage has cleaned
        got = stage(spark, docs.select(*common.DOCUMENT_COLUMNS), str(tmp_path)).collect()
        assert len(got) > 0 and (name != "sharding" or len(got) == docs.count())


def test_one_of_equal_rows_stays_whatever_the_order(spark):
    kept, rows = [], [(1, "same text", f"s{k}") for k in range(9)] + [(2, "same text", "t"), (None, "same text", None)]
    for n in (1, 4):
        docs = spark.createDataFrame(rows[::-1] if n > 1 else rows, "doc_id long, text string, source string").repartition(n)
        kept.append([(r.doc_id, r.source) for r in simhash.near_copies(docs).collect()])
    assert kept[0] == kept[1] and len(kept[0]) == 1 and kept[0][0][0] == 1
