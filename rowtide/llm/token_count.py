"""Token counts with a whole-token shortcut.

The vocabulary is tried once on the driver: a string that the tokenizer library
encodes alone as one token is proven to count 1 wherever it stands as a pre-token.
Texts are normalised and cut into pre-tokens by one regular expression; proven
strings are counted straight from a table, and only the rest goes through the
library's merges, each distinct string once (a bounded memo).

The expression is used for texts whose characters are all in a range where
normalisation is known to be lower-casing alone (FAST).  Any other text, and any
that holds a special string such as ``<|endoftext|>``, is encoded by the library
as a whole, so counts equal the library's for every text.  The expression is that of
tokenizers which normalise and cut as STEPS says; for any other file nothing counts as
proven, and the library encodes every text.

Defined results: a null text counts as empty (0 bytes, 0 tokens); equal texts count
alike; a very long text is counted whole; an empty table gives an empty one.  The table
that is broadcast is bounded by the vocabulary.  Same-named input columns are replaced,
others are carried along.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from rowtide.llm.common import shape_with, text_batches

#: Below U+0250 every character is in normal form C; controls, U+0085, U+00A0 and U+0130 (it lower-cases to two characters) are left out.
FAST = regex.compile("[\\t-\\r -~¡-įı-ɏ–—‘-”…€]*")
PIECE = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+")
MEMO = 500_000
#: What FAST and PIECE stand for, in the words of a tokenizer file.
STEPS = {
    "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {
        "type": "Sequence",
        "pretokenizers": [
            {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
        ],
    },
}


def known(path: str) -> bool:
    """True if the file normalises and cuts texts as STEPS, and ends words with ``</w>``."""
    with open(path, encoding="utf-8") as file:
        about = json.load(file)
    return all(about.get(k) == v for k, v in STEPS.items()) and about["model"].get("end_of_word_suffix") == "</w>"


def proven(path: str) -> dict[str, int]:
    """The strings, as pre-tokens, that the tokenizer encodes alone as exactly one token; none if PIECE is not how it cuts."""
    if not known(path):
        return {}
    tokenizer = Tokenizer.from_file(path)
    back = {byte: chr(byte) for byte in [*range(33, 127), *range(161, 173), *range(174, 256)]}
    back |= {byte: chr(256 + i) for i, byte in enumerate(b for b in range(256) if b not in back)}
    forward = {c: b for b, c in back.items()}
    found = []
    for piece in tokenizer.get_vocab(with_added_tokens=False):
        if piece.endswith("</w>") and all(c in forward for c in piece[:-4]):
            try:
                s = bytes(forward[c] for c in piece[:-4]).decode()
            except UnicodeDecodeError:
                continue
            if s and FAST.fullmatch(s) and PIECE.findall(s) == [s] and s.lower() == s:
                found.append(s)
    found.sort()
    return {s: 1 for s, e in zip(found, tokenizer.encode_batch(found, add_special_tokens=False)) if len(e.ids) == 1}


class Counter(dict):
    """pre-token -> number of tokens."""

    def __init__(self, table: dict[str, int], path: str):
        super().__init__(table)
        self.table, self.tokenizer = table, Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]

    def __missing__(self, piece: str) -> int:
        if len(self) >= len(self.table) + MEMO:
            self.clear()
            self.update(self.table)
        self[piece] = n = self.whole(piece)
        return n

    def whole(self, text: str) -> int:
        return len(self.tokenizer.encode(text, add_special_tokens=False).ids)

    def count(self, text: str | None) -> int:
        if not text:
            return 0
        if not self.table or not FAST.fullmatch(text) or any(s in text for s in self.special):
            return self.whole(text)
        return sum(map(self.__getitem__, PIECE.findall(text.lower())))


def count_tokens(docs: DataFrame, path: str, limit: int = 2048) -> DataFrame:
    """``docs`` with ``n_bytes``, ``n_tokens`` and ``over_limit``."""
    kept = [c for c in docs.columns if c.lower() not in ("n_bytes", "n_tokens", "over_limit")]
    rows = docs.select(*[f"`{c}`" for c in kept])
    shared = docs.sparkSession.sparkContext.broadcast(proven(path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(shared.value, path)
        for batch in batches:
            for part in text_batches(batch, "text"):
                n = [counter.count(t) for t in part.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(n, pa.int64())], [*part.schema.names, "n_tokens"])

    counted = rows.mapInArrow(run, shape_with(rows, "n_tokens long"))
    return counted.withColumns({"n_bytes": F.coalesce(F.octet_length("text"), F.lit(0)).cast("long"), "over_limit": F.col("n_tokens") > limit})
