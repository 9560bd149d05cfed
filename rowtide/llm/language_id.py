"""Language identification by compression against per-language dictionaries.

For every language a zstandard raw-content dictionary is filled with training texts
(at most ``max_texts`` of at most ``max_text_bytes`` each, up to ``dict_bytes``: the
documented bounds of the sample).  Texts of 200 to ``max_text_bytes`` bytes come first;
where a language has fewer than ``max_texts`` of them, shorter ones and the first
``max_text_bytes`` characters of longer ones fill the sample up.  Lines that the samples of two languages share, such
as notices, and repeated lines tell nothing and are left out.  Texts and dictionaries
are lower-cased and keep letters only, so marks and digits do not count as language.
A text is cut into chunks
of CHUNK bytes, all of them encoded with every dictionary; the language with the
smallest sum is predicted.  ``accepted`` is false where the runner-up is nearer
than ``least_margin``: there the prediction should not be relied on.

Only chunk sizes matter, so a text of any length needs memory for itself alone.
Dictionaries are broadcast: languages times ``dict_bytes``, at most
``max_languages`` of them (else an error).

Defined results: null, empty or letterless texts are ``und`` with score 0; ties go to
the first language in order; without training rows everything is ``und``; rows without
lang or doc_id are predicted but never learnt from; of repeated texts of a language one
is learnt from, and equal texts get equal answers; an empty table gives an empty one.
Input columns named like an output column are replaced by it; others are carried along.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
import regex
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rowtide.llm.common import shape_with, text_batches

CHUNK = 4096
LETTER = regex.compile(r"\p{L}")
OTHER = regex.compile(r"[^\p{L}]+")
LEVEL = 9


def folded(text: str) -> bytes:
    """Lower case, with a space for whatever is no letter."""
    return OTHER.sub(" ", text.lower()).encode()


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def learn(docs: DataFrame, dict_bytes: int = 98_304, max_texts: int = 96, max_text_bytes: int = 8192, max_languages: int = 512) -> dict[str, bytes]:
    """Raw dictionary content by language."""
    size = F.octet_length("text")
    usable = docs.where((size > 0) & F.col("doc_id").isNotNull() & F.col("lang").isNotNull() & ~held_out(F.col("doc_id")))
    # Of a longer text a stretch that its hash picks.
    part = F.substring("text", (F.lit(1) + F.pmod(F.xxhash64("text"), F.greatest(F.length("text") - max_text_bytes + 1, F.lit(1)))).cast("int"), F.lit(max_text_bytes))
    keyed = usable.select("lang", F.xxhash64("text").alias("h"), (~size.between(200, max_text_bytes)).alias("other"), part.alias("text"))
    # Repeated texts are one before they are ranked, and again when their text is fetched: no more travels than is ranked.
    ranked = keyed.groupBy("lang", "h", "other").count().drop("count")
    # Ranked in parts of a language first, so that a hot one is no task's work alone.
    for by in ([F.col("lang"), F.pmod("h", F.lit(16))], [F.col("lang")]):
        rank = F.row_number().over(Window.partitionBy(*by).orderBy("other", "h"))
        ranked = ranked.withColumn("k", rank).where(F.col("k") <= max_texts)
    ranked = ranked.select("lang", "h", "k").limit(max_texts * max_languages + 1)
    rows = keyed.join(F.broadcast(ranked), ["lang", "h"]).groupBy("lang", "h", "k").agg(F.min("text").alias("text")).collect()
    rows.sort(key=lambda r: (r.lang, r.k))
    owners: dict[str, set[str]] = {}
    for r in rows:
        for line in r.text.split("\n"):
            owners.setdefault(line, set()).add(r.lang)
    found: dict[str, bytes] = {}
    for r in rows:
        own = []
        for line in r.text.split("\n"):
            if len(owners[line]) == 1:
                own.append(line)
                owners[line] = set()  # once is enough
        have = found.get(r.lang, b"")
        if len(have) < dict_bytes:
            found[r.lang] = have + folded("\n".join(own)) + b" "
    if len(found) > max_languages:
        raise ValueError(f"more than {max_languages} languages")
    return {lang: found[lang][:dict_bytes] for lang in sorted(found)}


class Judge:
    """Compressors for all languages, made once in each Python worker."""

    def __init__(self, dictionaries: dict[str, bytes], level: int = LEVEL):
        self.langs = sorted(dictionaries)
        self.by = []
        for lang in self.langs:
            d = zstandard.ZstdCompressionDict(dictionaries[lang], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(level=level)
            self.by.append(zstandard.ZstdCompressor(level=level, dict_data=d, write_checksum=False, write_content_size=False, write_dict_id=False))

    def __call__(self, text: str | None) -> tuple[str, float, float]:
        """Language, score and margin (the runner-up's excess over the best)."""
        if text is None or not self.langs or not LETTER.search(text):
            return "und", 0.0, 0.0
        data = folded(text)
        chunks = [data[i : i + CHUNK] for i in range(0, len(data), CHUNK)]
        sizes = [sum(len(c.compress(x)) for x in chunks) for c in self.by]
        best = min(sizes)
        k = sizes.index(best)
        margin = (min([*sizes[:k], *sizes[k + 1 :]], default=2 * best) - best) / best
        return self.langs[k], 1 / sum(math.exp(-40 * (s - best) / best) for s in sizes), margin


def predict(docs: DataFrame, dictionaries: dict[str, bytes], least_margin: float = 0.01) -> DataFrame:
    """``docs`` with ``lang_pred``, ``score`` and ``accepted``; same-named columns are replaced."""
    kept = [c for c in docs.columns if c.lower() not in ("lang_pred", "score", "accepted")]
    rows = docs.select(*[f"`{c}`" for c in kept])
    shared = docs.sparkSession.sparkContext.broadcast(dictionaries)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge = Judge(shared.value)
        for batch in batches:
            for part in text_batches(batch, "text"):
                said = [judge(t) for t in part.column("text").to_pylist()]
                more = [
                    pa.array([x[0] for x in said], pa.string()),
                    pa.array([x[1] for x in said], pa.float64()),
                    pa.array([x[2] >= least_margin for x in said], pa.bool_()),
                ]
                yield pa.RecordBatch.from_arrays([*part.columns, *more], [*part.schema.names, "lang_pred", "score", "accepted"])

    return rows.mapInArrow(run, shape_with(rows, "lang_pred string, score double, accepted boolean"))
