"""Language id, classifier, tokens, decontamination and line templates."""

import collections
import hashlib
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
import zstandard
from tokenizers import Tokenizer

from rowtide.llm import decontaminate, language_id, line_templates, queries, quality_model, token_count

PATH = str(public_tokenizers.path("word_bpe_49k.json"))


# --- language id -------------------------------------------------------------------


def test_language_accuracy(spark, sf):
    sf = sf.replace("0.001", "0.01")
    langs = {r.doc_id: r.lang for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang").collect()}
    rows = queries.QUERIES["op3_language_id"](spark, sf).collect()
    assert len(rows) == len(langs) and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    held = [r.lang_pred == langs[r.doc_id] for r in rows if r.held_out]
    assert np.mean(held) >= 0.97 and all(0 <= r.score <= 1 for r in rows)


def test_language_edges(spark, edge, nothing, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    learnt = language_id.learn(docs)
    assert max(map(len, learnt.values())) <= 98_304 and learnt == language_id.learn(docs.repartition(3))
    rows = language_id.predict(edge, learnt).collect()
    for r in rows:
        letterless = not any(c.isalpha() for c in r.text or "")
        assert (r.lang_pred == "und") == letterless and (r.score == 0) == letterless and (not letterless or not r.accepted)
    assert language_id.predict(nothing, learnt).count() == 0
    assert {r.lang_pred for r in language_id.predict(edge, language_id.learn(nothing)).collect()} == {"und"}
    with pytest.raises(ValueError):
        language_id.learn(docs, max_languages=1)


def test_op3_is_the_least_of_plain_sizes(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    learnt = language_id.learn(docs)
    plain = lambda data, lang: len(zstandard.ZstdCompressor(level=9, dict_data=zstandard.ZstdCompressionDict(learnt[lang], dict_type=zstandard.DICT_TYPE_RAWCONTENT), write_checksum=False, write_content_size=False, write_dict_id=False).compress(data))
    for r in queries.QUERIES["op3_language_id"](spark, sf).where("doc_id % 9 = 0").collect():
        letters = "".join(c if c.isalpha() else " " for c in (texts[r.doc_id] or "").lower())
        if not letters.split():
            assert r.lang_pred == "und" and r.score == 0
            continue
        data = re.sub(" +", " ", letters).encode()
        sizes = {lang: sum(plain(data[i : i + 4096], lang) for i in range(0, len(data), 4096)) for lang in learnt}
        assert r.lang_pred == min(sorted(sizes), key=sizes.get)


def test_repeated_texts_are_learnt_once(spark):
    known = next(i for i in range(99) if zlib.crc32(str(i).encode()) % 4 != 2)
    rows = [(known, "immer derselbe text mit worten " * 9, "de")] * 300 + [(i, f"{w} eigener satz " * 20, "de") for i, w in enumerate(["eins", "zwei", "drei", "vier"] * 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    learnt = language_id.learn(docs, max_texts=5)
    assert all(w in learnt["de"] for w in (b"eins", b"zwei", b"drei", b"vier", b"immer"))


# --- classifier --------------------------------------------------------------------


def test_op7_against_a_plain_network(spark, sf):
    """Features by hand, the same steps of descent without shortcuts, scores as a softmax over the mean vector."""
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    labels = spark.read.parquet(f"{sf}/labels.parquet").collect()
    n = 1 << 16

    def share_of(text):
        v = np.zeros(n)
        for w in (text or "").encode().split():
            v[zlib.crc32(w) % n] += 1
            letters = f"<{w.decode('utf-8', 'ignore')}>"
            for g in (3, 4):
                for i in range(len(letters) - g + 1):
                    v[zlib.crc32(letters[i : i + g].encode(), g) % n] += 1
        return v / v.sum() if v.sum() else v

    sample = sorted((r.doc_id, r.quality) for r in labels if r.quality is not None and r.doc_id in docs and zlib.crc32(str(r.doc_id).encode()) % 5)
    sample = [(share_of(docs[d]), y) for d, y in sample if (docs[d] or "").split()]
    epochs, rng = min(100, max(8, 24_000 // len(sample))), np.random.default_rng(5)
    vectors, top, bias = rng.uniform(-1 / 16, 1 / 16, (n, 16)), np.zeros((16, 2)), np.zeros(2)
    for e in range(epochs):
        for k, i in enumerate(rng.permutation(len(sample))):
            share, y = sample[i]
            lr = 0.5 * (1 - (e * len(sample) + k) / (epochs * len(sample)))
            there = np.flatnonzero(share)
            hidden = share[there] @ vectors[there]
            p = np.exp(hidden @ top + bias)
            p = p / p.sum() - np.eye(2)[y]
            step = top @ p
            top -= lr * np.outer(hidden, p)
            bias -= lr * 0.1 * p
            vectors[there] -= (lr * 20 * share[there])[:, None] * step
    for r in queries.QUERIES["op7_quality_model"](spark, sf).collect():
        z = (share_of(docs[r.doc_id]) @ vectors) @ top + bias
        assert abs(r.score - 1 / (1 + np.exp(z[0] - z[1]))) < 0.02, r.doc_id


def test_classifier_with_text_ids_and_repeats(spark):
    a, c = [x for x in ("a b", "b", "c", "d e", "f") if zlib.crc32(x.encode()) % 5][:2]
    docs = spark.createDataFrame([(a, "good text here")] * 500 + [(c, "### bad"), ("new", "good again here")], "doc_id string, text string").repartition(4)
    labels = spark.createDataFrame([(a, 1), (c, 0)], "doc_id string, quality int")
    rows = {r.doc_id: r.score for r in quality_model.score(docs, quality_model.fit(docs, labels)).collect()}
    assert rows[a] > 0.5 > rows[c] and rows["new"] > 0.5


def test_classifier_held_out(spark, sf):
    sf = sf.replace("0.001", "0.01")
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    rows = queries.QUERIES["op7_quality_model"](spark, sf).collect()
    held = [(labels[r.doc_id], r.score, r.predicted) for r in rows if r.held_out and r.doc_id in labels]
    good, bad = [s for y, s, _ in held if y], [s for y, s, _ in held if not y]
    assert np.mean([g > b for g in good for b in bad]) > 0.95 and np.mean([p == y for y, _, p in held]) > 0.9
    assert all(r.predicted == int(r.score >= 0.3) and r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)


def test_classifier_edges(spark, edge, nothing):
    labels = spark.createDataFrame([(0, 1), (0, 0), (None, 1), (4, None)], "doc_id long, quality int")
    model = quality_model.fit(edge, labels)
    rows = quality_model.score(edge, model).collect()
    assert len(rows) == edge.count() and all(0 <= r.score <= 1 for r in rows)
    assert len({r.score for r in rows if not (r.text or "").split()}) == 1
    none = quality_model.fit(edge, labels.limit(0))
    assert {r.score for r in quality_model.score(edge, none).collect()} == {0.5}
    assert quality_model.score(nothing, model).count() == 0


def test_flat_scoring_equals_the_network():
    texts = ["good words here", "bad !! ### words", "good fine text", "### !!", "fine"]
    rows = [(*quality_model.counted(t), y) for t, y in zip(texts, [1, 0, 1, 0, 1])]
    weights, bias = quality_model.train(rows, epochs=60)
    memo = quality_model.Memo(weights)
    for t, (ids, share, y) in zip(texts, rows):
        z = float(share @ weights[ids]) + bias
        assert abs(quality_model.score_text(t, memo, bias) - 1 / (1 + np.exp(-z))) < 1e-5
        assert (quality_model.score_text(t, memo, bias) > 0.5) == bool(y)


# --- tokens ------------------------------------------------------------------------

ODD = [
    "<|startoftext|>a<|endoftext|> b", "it's THE CAT'S they'll we'D", "x" * 3000, "3.14 ½ ² 10000", "a b c\x85d\x1ce", "İstanbul ΣΑΣ ﬁ é",
    "中文字符 テスト 한국어", "👩‍👩‍👧 👍🏽", "<|endoftext", "don''t '' 's'", "\t\n \r", "ÀÉÎõü ñandú straße", "a_b-c.d,e;f", "\u0000\u0001z", "ſ ŉ ǰ", "“quoted” – dash — it’s…",
]


def test_tokens_equal_the_library(spark, edge, nothing):
    tok = Tokenizer.from_file(PATH)
    docs = edge.select("doc_id", "text", "n_tokens", "extra").union(spark.createDataFrame([(500 + i, t, "mine", "y") for i, t in enumerate(ODD)], "doc_id long, text string, n_tokens string, extra string"))
    rows = token_count.count_tokens(docs, PATH).collect()
    for r in rows:
        n = len(tok.encode(r.text or "", add_special_tokens=False).ids)
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len((r.text or "").encode()), n, n > 2048), r.text
    assert token_count.count_tokens(nothing, PATH).count() == 0


def test_op8_over_documents(spark, sf):
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = queries.QUERIES["op8_token_count"](spark, sf).collect()
    want = dict(zip(texts, (len(e.ids) for e in Tokenizer.from_file(PATH).encode_batch(list(texts.values()), add_special_tokens=False))))
    assert {r.doc_id: (r.n_bytes, r.n_tokens, r.over_limit) for r in rows} == {d: (len(t.encode()), want[d], want[d] > 2048) for d, t in texts.items()}


def test_other_tokenizers_are_left_to_the_library(spark, edge):
    path = str(public_tokenizers.path("byte_bpe_50k.json"))
    tok = Tokenizer.from_file(path)
    rows = token_count.count_tokens(edge.union(edge.limit(0)).select("text"), path).collect()
    assert token_count.known(PATH) and token_count.proven(path) == {} and all(r.n_tokens == len(tok.encode(r.text or "", add_special_tokens=False).ids) for r in rows)


def test_proof():
    tok, table = Tokenizer.from_file(PATH), token_count.proven(PATH)
    assert len(table) > 30_000 and all(len(tok.encode(s, add_special_tokens=False).ids) == 1 for s in list(table)[::37])


def test_memo_is_bounded(monkeypatch):
    monkeypatch.setattr(token_count, "MEMO", 3)
    c = token_count.Counter({"a": 1}, PATH)
    for i in range(50):
        c.count(f"qzx{'y' * i}")
        assert len(c) <= 5


# --- decontamination ---------------------------------------------------------------

ITEM_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = {i: i + 32 for i in range(65, 91)}


def by_hand(texts, items, n=10):
    windows = collections.defaultdict(set)
    for k, t in items:
        w = ITEM_WORD.findall((t or "").translate(LOWER))
        for i in range(max(1, len(w) - n + 1) if w else 0):
            windows[tuple(w[i : i + n])].add(k)
    out = []
    for t in texts:
        w, hit, names = ITEM_WORD.findall((t or "").translate(LOWER)), set(), set()
        for m in {len(x) for x in windows}:
            for i in range(len(w) - m + 1):
                if tuple(w[i : i + m]) in windows:
                    hit |= set(range(i, i + m))
                    names |= windows[tuple(w[i : i + m])]
        names = sorted(str(x) for x in names if x is not None)
        out.append((len(w), len(hit), len(names), hashlib.sha256(",".join(names).encode()).hexdigest(), bool(hit)))
    return out


def near_by_hand(text, items, slack, n=10, least=0.8):
    w = ITEM_WORD.findall((text or "").translate(LOWER))
    places = collections.defaultdict(set)
    for p, x in enumerate(w):
        places[x] |= set(range(p - slack, p + slack + 1))
    found = set()
    for k, t in items:
        own = ITEM_WORD.findall((t or "").translate(LOWER))
        for i in range(max(1, len(own) - n + 1) if own and k is not None else 0):
            window = own[i : i + n]
            need = -(-len(window) * 8 // 10)
            if any(sum(s + x in places[term] for x, term in enumerate(window)) >= need for s in range(-n, len(w) + n)):
                found.add(k)
    return len(found)


@pytest.mark.parametrize("block_words, candidates", [(10**6, 1 << 19), (15, 3)])
def test_decontamination(spark, edge, nothing, block_words, candidates, monkeypatch, tmp_path):
    monkeypatch.setattr(decontaminate, "CANDIDATES", candidates)
    monkeypatch.setattr(decontaminate, "SEGMENT_BYTES", 200 if candidates == 3 else 6 << 20)
    passage = " ".join(f"w{i}" for i in range(25))
    items = [(1, passage), (12, "short item"), (2, "Ünï cödé"), (3, None), (4, "..."), (None, "one two"), (5, passage), (6, "the the the"), (7, "a b " * 10)]
    texts = [passage, passage.upper() + ". " + passage, " ".join(passage.split()[3:13]), " ".join(passage.split()[3:12]), "ünï cödé, ÜNÏ cödé", "the the the the", "a b " * 30, "Short-Item!", "w24 " + passage]
    texts += [" ".join(passage.split()[4:12]), "w2 w1 w0 w5 w4 w3 w7 w6 w9 w8", "item of a short"]
    docs = edge.select("doc_id", "text", "extra").union(spark.createDataFrame([(900 + i, t, "z") for i, t in enumerate(texts)], "doc_id long, text string, extra string"))
    bench = spark.createDataFrame(items, "item_id long, text string")
    rows = decontaminate.decontaminate(docs, bench, block_words=block_words).collect()
    all_texts = [r.text for r in docs.collect()]
    want = sorted((*x, near_by_hand(t, items, 2) if len(t or "") < 5000 else 0) for t, x in zip(all_texts, by_hand(all_texts, items)))
    assert sorted(tuple(r)[1:] for r in rows) == want and max(x[-1] for x in want) > 1
    where = str(tmp_path / "index")
    decontaminate.build_index(docs).repartition(5).write.parquet(where)  # a stored index gives the same, and serves other test sets
    index = spark.read.parquet(where)
    assert sorted(tuple(r)[1:] for r in decontaminate.search(index, bench, block_words=block_words).collect()) == want
    other = [(1, "w3 w4 w5")]
    rows = decontaminate.search(index, spark.createDataFrame(other, "item_id long, text string"), slack=0).collect()
    assert sorted(tuple(r)[1:6] for r in rows) == sorted(by_hand(all_texts, other))
    flagged = decontaminate.flag(edge.drop("x"), bench, block_words=block_words).collect()
    assert sorted(r.contaminated for r in flagged) == sorted(x[4] for x in by_hand([r.text for r in edge.collect()], items))
    assert decontaminate.decontaminate(nothing, bench).count() == 0 == decontaminate.flag(nothing, bench).count()
    assert not any(r.contaminated for r in decontaminate.decontaminate(docs, bench.limit(0)).collect())


def test_small_candidate_batches(monkeypatch):
    monkeypatch.setattr(decontaminate, "CANDIDATES", 8)
    words = [b"a", b"b", b"c"] * 40
    block = decontaminate.Block([("i", [b"a", b"b", b"c", b"a"]), ("j", [b"c", b"c"])], 3)
    s = decontaminate.Segment(*decontaminate.postings([words, [], words[:2]]), block)
    hit, exact, _ = s.search(block)
    assert exact == [{0}, set(), set()] and hit[:120].all() and not hit[120:].any()


def test_proximity(spark):
    item = "alpha beta gamma delta epsilon zeta eta theta iota kappa"
    texts = [item, item.replace("gamma", "gamma very"), item.replace("delta", "x"), "kappa iota theta eta zeta epsilon delta gamma beta alpha", "alpha beta"]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    for slack, want in ((1, [1, 1, 1, 0, 0]), (0, [0] * 5)):
        rows = decontaminate.decontaminate(docs, spark.createDataFrame([(1, item)], "item_id long, text string"), slack=slack).orderBy("doc_id").collect()
        assert [r.n_items for r in rows] == [1, 0, 0, 0, 0] and [r.n_near_items for r in rows] == want


@pytest.mark.parametrize("slack, least", [(1, 0.8), (2, 0.8), (3, 0.6), (2, 1.0)])
def test_proximity_against_brute_force(slack, least):
    rng = np.random.default_rng(slack)
    lists = [[b"t%d" % i for i in rng.zipf(1.5, n) % 40] for n in (0, 3, 60, 200, 9, 90)]
    items = [("i%d" % k, [b"t%d" % i for i in rng.zipf(1.5, n) % 45]) for k, n in enumerate((1, 2, 5, 8, 12, 20))]
    items += [("j", lists[3][50:53] + [b"?"] + lists[3][53:60]), ("k", lists[2][20:24] + lists[2][26:32])]
    block = decontaminate.Block(items, 10)
    _, _, near = decontaminate.Segment(*decontaminate.postings(lists), block, slack).search(block, slack, least)
    for d, w in enumerate(lists):
        want = set()
        for k, (_, own) in enumerate(items):
            for i in range(max(1, len(own) - 9)):
                window = own[i : i + 10]
                for s in range(-15, len(w) + 15):
                    if sum(any(0 <= p < len(w) and w[p] == t for p in range(s + x - slack, s + x + slack + 1)) for x, t in enumerate(window)) >= least * len(window) - 1e-9:
                        want.add(k)
        assert near[d] == want


# --- line templates ----------------------------------------------------------------


def test_line_templates(spark, edge, nothing):
    notice = "Printed on page {} of {} by user {} at noon."
    texts = [f"Unique start {w} here, really {w * 2} new.\n" + notice.format(i, i * 7, w) + f"\nLast words {w}{w} of mine." for i, w in enumerate("abcdefghijkl")]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    for r in line_templates.drop_templates(docs, least_docs=8).collect():
        lines = r.text.split("\n")
        assert (r.n_lines, r.n_dropped, r.clean_text) == (3, 1, "\n".join([lines[0], lines[2]]))
    assert {r.n_dropped for r in line_templates.drop_templates(docs, least_docs=13, evidence=1000).collect()} == {0}
    rows = line_templates.drop_templates(edge, least_docs=2).collect()
    assert len(rows) == edge.count() and all((r.clean_text is None) == (r.text is None) for r in rows)
    assert {r.n_dropped for r in rows if r.doc_id in (0, 1)} == {0}  # one text, however often it is repeated
    assert line_templates.drop_templates(nothing).count() == 0


def slow_templates(texts, least, depth, evidence):
    """Places that each distinct text loses, by a plain tree of dictionaries."""
    leaves = collections.defaultdict(lambda: collections.defaultdict(set))  # shape -> masked line -> texts
    lines = {t: [(i, [("<*>" if re.search("[0-9]", w) else w) for w in re.findall(r"[^ \t\r\x0b\x0c]+", x)]) for i, x in enumerate(t.split("\n"))] for t in texts}
    for t, own in lines.items():
        for _, w in own:
            if w:
                leaves[len(w), *w[:depth]][tuple(w)].add(t)
    first = {}  # masked line -> the text that keeps it, or none
    for (width, *_), found in leaves.items():
        enough = max(2, min(least, -(-evidence // width)))
        docs = collections.Counter()
        for w, where in found.items():
            for p, tok in enumerate(w):
                docs[p, tok] += len(where)
        template = lambda w: tuple((p, tok) for p, tok in enumerate(w) if tok != "<*>" and docs[p, tok] >= enough)
        total, owners = collections.Counter(), collections.defaultdict(set)
        for w, where in found.items():
            total[template(w)] += len(where)
            owners[template(w)] |= where
        for w in found:
            n = total[template(w)]
            if n >= enough and 2 * len(template(w)) >= len(w):
                first[w] = None if n >= least else min(owners[template(w)], key=lambda t: hashlib.md5(t.encode()).digest())
    return {t: {i for i, w in own if tuple(w) in first and first[tuple(w)] != t} for t, own in lines.items()}


@pytest.mark.parametrize("least, depth, bits", [(3, 3, 26), (2, 1, 15), (8, 3, 26)])
def test_line_templates_against_a_plain_tree(spark, sf, least, depth, bits):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    rng = np.random.default_rng(least)
    made = ["\n".join(["user %d said hello to %s at noon" % (rng.integers(9), "abcdefgh"[rng.integers(8)]), "Home", "1 2 3", " ".join("w%s" % "xyz"[i % 3] * (i % 4 + 1) for i in range(60 + int(rng.integers(2))))][: int(rng.integers(1, 5))]) for _ in range(30)]
    docs = docs.union(spark.createDataFrame([(10**6 + i, t) for i, t in enumerate(made)], "doc_id long, text string"))
    want = slow_templates({r.text or "" for r in docs.collect()}, least, depth, 100)
    rows = line_templates.drop_templates(docs, least_docs=least, depth=depth, bits=bits).collect()
    assert sum(r.n_dropped > 0 for r in rows) > 20
    for r in rows:
        gone = want[r.text or ""]
        assert r.n_dropped == len(gone) and (r.clean_text or "") == "\n".join(x for i, x in enumerate((r.text or "").split("\n")) if i not in gone)


def test_op5(spark, sf):
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    want = slow_templates(set(docs.values()), 8, 3, 100)
    rows = queries.QUERIES["op5_line_templates"](spark, sf).collect()
    assert {r.doc_id: r.n_dropped for r in rows} == {d: len(want[t]) for d, t in docs.items()} and any(want.values())


@pytest.mark.parametrize("word", [b"a", b"ab", b"word", "naïve".encode(), "中文".encode(), b"x" * 399, b"y" * 401, b"\xff\xfe"])
def test_features_of_any_word(word):
    assert sorted(quality_model.features(word)) == sorted(f for part in quality_model.slices(word) for f in part)


def test_long_words_are_scored_whole():
    word = ("naïve" * 3000 + "end").encode()
    letters = f"<{word.decode()}>"
    want = [zlib.crc32(word) % (1 << 16)] + [zlib.crc32(letters[i : i + n].encode(), n) % (1 << 16) for n in (3, 4) for i in range(len(letters) - n + 1)]
    assert sorted(quality_model.features(word)) == sorted(want)
    ids, share = quality_model.counted(f"a {word.decode()} {word.decode()}")
    assert set(want) <= set(ids.tolist()) and abs(share.sum() - 1) < 1e-5
    weights = np.random.default_rng(1).normal(size=1 << 16).astype(np.float32)
    memo = quality_model.Memo(weights)
    total, n = memo[word]
    assert n == len(want) and abs(total - weights[want].sum(dtype=float)) < 0.1 and word not in memo


def test_languages_of_short_or_long_texts_alone_are_learnt(spark):
    rows = [(i, f"kurzer satz nummer {chr(97 + i % 26)}{chr(97 + i // 26)}", "de") for i in range(60)] + [(100 + i, f"palabra{chr(97 + i)} larga " * 900, "es") for i in range(20)]
    found = language_id.learn(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert set(found) == {"de", "es"} and b"kurzer" in found["de"] and b"larga" in found["es"]


def test_a_repeated_passage_stays_once(spark):
    """What is enough depends on the length: 50 tokens in two texts, 25 in four; one text keeps what fewer than eight have."""
    line = lambda n, tag: " ".join(f"{tag}{'abcdefghij'[i % 10]}{'klmnop'[i // 10 % 6]}" for i in range(n))
    rows = [(k, "\n".join([f"own {'abcdefgh'[k]} line", *(line(n, tag) for n, tag, docs in ((50, "x", 2), (49, "y", 2), (25, "z", 4), (25, "u", 3), (12, "v", 8), (12, "w", 7)) if k < docs)])) for k in range(8)]
    done = line_templates.drop_templates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    left = collections.Counter(tag for r in done for tag in (x[0] for x in r.clean_text.split("\n")))
    assert left == {"o": 8, "x": 1, "y": 2, "z": 1, "u": 3, "w": 7}
