import re
import zlib
from collections import Counter

from rowtide.llm import spelling
from rowtide.llm.queries import QUERIES

RUN = re.compile("[A-Za-zÀ-ÿ]+")
DOWN = str.maketrans(spelling.UPPER, spelling.LOWER)


def counted(rows, misspell=199):
    found = Counter()
    for doc_id, text in rows:
        for run in RUN.findall(text or ""):
            word = run.translate(DOWN)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{word}".encode())
            if misspell and h % misspell == 0:
                word = word[: h % len(word)] + word[h % len(word) + 1 :]
            found[word] += 1
    return {w: n for w, n in found.items() if len(w) >= 6 and n >= 5}


def one_apart(words):
    """Pairs by wildcards and gaps, another way than bands."""
    near = {w: set() for w in words}
    by = {}
    for w in words:
        for i in range(len(w)):
            by.setdefault((w[:i], w[i + 1 :]), []).append(w)
            gone = w[:i] + w[i + 1 :]
            if gone in near:
                near[w].add(gone)
                near[gone].add(w)
    for same in by.values():
        for a in same:
            near[a].update(b for b in same if b != a)
    return near


def plain(words, times=5):
    near, form = one_apart(words), {}
    for w in words:
        top = min(near[w], key=lambda v: (-words[v], v), default=None)
        form[w] = top if top is not None and words[top] >= times * words[w] else None
    out = {}
    for w in words:
        root = w
        while form[root]:
            root = form[root]
        out[w] = (form[w], root, words[w], len(near[w]), words[form[w]] if form[w] else None)
    return out


def rows_of(frame):
    return {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in frame.collect()}


def test_table(spark, sf):
    import duckdb

    rows = duckdb.sql(f"SELECT doc_id, text FROM '{sf}/documents.parquet'").fetchall()
    ours = rows_of(QUERIES["op12_spelling_variants"](spark, sf))
    assert ours == plain(counted(rows)) and len(ours) > 100


def test_chains_ties_and_hot_groups(spark):
    words = {"colour": 3000, "color": 1, "colours": 500, "colourz": 90, "colxurz": 10, "bolour": 3000, "dolour": 600, "naïvete": 50, "naivete": 10, "ßßßßßß": 9, "ßßßßß": 1, "×÷×÷×÷": 5, "×÷×÷×÷÷": 25}
    # Words of letters of one band alone: all meet in the groups of the other two bands.
    words |= {"".join("adgjmpsv"[(k // 8**i) % 8] for i in range(6)): 5 + k % 7 * 30 for k in range(0, 8**6, 97)}
    words |= {f"{w}x": n for w, n in list(words.items())[20:400]}
    words = {w: n for w, n in words.items() if len(w) >= 6}
    table = spark.createDataFrame([*words.items()], "word string, n long")
    expected = plain(words)
    assert rows_of(spelling.variants(table)) == expected == rows_of(spelling.variants(table, hot=3))
    assert expected["colxurz"][:2] == ("colourz", "colour") and expected["dolour"][0] == "bolour"


def test_odd_rows(spark, edge, nothing):
    rows = [(r.doc_id, r.text) for r in edge.select("doc_id", "text").collect()]
    assert {r.word: r.n for r in spelling.vocabulary(edge, misspell=199).collect()} == counted(rows)
    assert {r.word: r.n for r in spelling.vocabulary(edge).collect()} == counted(rows, None)
    assert spelling.variants(spelling.vocabulary(nothing, misspell=199)).collect() == []


def test_one_edit_leaves_a_band(spark):
    """Masks differ in two bits at most, so in two bands at most."""
    pairs = [("planet", "plane"), ("planet", "plamet"), ("planet", "xplanet"), ("größer", "großer"), ("größer", "größter")]
    table = spark.createDataFrame(pairs, "a string, b string")
    masks = table.select(*[spelling.mask(table[c], b).alias(f"{c}{b}") for c in "ab" for b in range(3)]).collect()
    for (a, b), r in zip(pairs, masks):
        flipped = [bin(r[f"a{k}"] ^ r[f"b{k}"]).count("1") for k in range(3)]
        assert sum(flipped) <= 2 and 0 in flipped, (a, b)
