"""Byte-level BPE encoding by dynamic programming over prefixes, and decoding.

For every prefix of a pre-token there is exactly one token that can be the last of the prefix's encoding.  An automaton over the
vocabulary gives the tokens that end at each position; the one whose left neighbour (the last token of the shorter prefix) is compatible with it
is stored.  Following the stored tokens back from the end gives the ids.  Two tokens are compatible when encoding their joined bytes
gives just these two tokens: no merge across their boundary would have come before the merges inside them.

Defined results: a null text is taken as empty; empty text has no ids; repeated rows are encoded each; other columns are ignored.
"""

from __future__ import annotations

import json
from array import array
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import quoted, small_batches, text_or_empty

#: The pre-token pattern of the byte-level tokenizers, and how they write bytes as characters.
PRETOKENS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
PRINTED_AS_THEMSELVES = ((0x21, 0x7E), (0xA1, 0xAC), (0xAE, 0xFF))


#: Parameter: results of pair tests that are remembered, a prime.
PAIR_SLOTS = 524_287


def byte_alphabet() -> dict[str, int]:
    """The character that stands for each byte in a byte-level vocabulary: printable ones for themselves, the rest from U+0100 on."""
    plain = [b for low, high in PRINTED_AS_THEMSELVES for b in range(low, high + 1)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + n): b for n, b in enumerate(rest)}


class PrefixBpe:
    """Encodes and decodes as the tokenizer in ``path`` does, without special tokens at the ends."""

    def __init__(self, path: str, room: int = 96 << 20):
        import ahocorasick
        import regex

        from .pieces import Memory, SpaceLedPieces

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pre = spec["pre_tokenizer"]
        if spec["model"]["type"] != "BPE" or pre["type"] != "ByteLevel" or pre["add_prefix_space"] or spec["normalizer"]:
            raise ValueError("a byte-level BPE without normalizer or prefix space is asked for")
        alphabet = byte_alphabet()
        raw = lambda token: bytes(alphabet[c] for c in token)
        vocab = spec["model"]["vocab"]
        self.bytes_of = {i: raw(t) for t, i in vocab.items()}
        self.specials = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.bytes_of |= {i: s.encode() for s, i in self.specials.items()}
        merges = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        #: For each merge its place in the order; for each merged token that place and its two parts.
        self.place: dict[tuple[int, int], int] = {}
        self.parts: dict[int, tuple[int, int, int]] = {}
        for n, (a, b) in enumerate(merges):
            pair = vocab[a], vocab[b]
            self.place[pair] = n
            if self.parts.setdefault(vocab[a + b], (n, *pair)) != (n, *pair):
                raise ValueError("two merges make one token: last tokens of prefixes would not be unique")
        usable = [*self.parts, *(vocab[c] for c in alphabet if c in vocab)]
        self.automaton = ahocorasick.Automaton()
        for i in usable:
            self.automaton.add_word(self.bytes_of[i].decode("latin-1"), (len(self.bytes_of[i]), i))
        self.automaton.make_automaton()
        self.bytes_of = [self.bytes_of.get(i, b"") for i in range(max(self.bytes_of) + 1)]
        #: Results of pair tests, each at the remainder of its pair: a table of fixed size in which a later pair may take an earlier one's place.
        self.tested = array("q", [-1]) * PAIR_SLOTS
        self.pattern = regex.compile(PRETOKENS)
        self.pretokens = Memory(self._pretoken, room // 3)
        self.pieces = SpaceLedPieces(self._literal, room // 2, self.specials)

    def fits(self, pair: int) -> bool:
        """Whether encoding the joined bytes of two tokens gives these two; ``pair`` is the left id times the vocabulary's size plus the right id.

        Walks the tokens that face each other at the boundary, undoing the latest merge on either side first; a merge across the
        boundary that comes before the one just undone would have been made instead.
        """
        left, right = divmod(pair, len(self.bytes_of))
        undone, by_left = len(self.place), True  # the place of the merge undone last, and on which side it lay
        while True:
            across = self.place.get((left, right))
            # At equal places (the same merge on both sides) the one further left is made first.
            if across is not None and (across < undone or across == undone and not by_left):
                return False
            l, r = self.parts.get(left), self.parts.get(right)
            if l is None and r is None:
                return True
            if r is None or l is not None and l[0] > r[0]:
                undone, left, by_left = l[0], l[2], True
            else:
                undone, right, by_left = r[0], r[1], False

    def _pretoken(self, pretoken: str) -> bytes:
        data = pretoken.encode()
        last: list[int] = [-1] * len(data)
        tested, n = self.tested, len(self.bytes_of)
        for end, (size, token) in self.automaton.iter(data.decode("latin-1")):
            if last[end] < 0:
                before = end - size
                if before < 0:
                    last[end] = token
                elif last[before] >= 0:
                    pair = last[before] * n + token
                    known = tested[pair % PAIR_SLOTS]
                    if known >> 1 != pair:
                        known = tested[pair % PAIR_SLOTS] = pair << 1 | self.fits(pair)
                    if known & 1:
                        last[end] = token
        ids, end = [], len(data) - 1
        while end >= 0:
            token = last[end]
            if token < 0:
                raise ValueError(f"no token of the vocabulary ends a prefix of {pretoken!r}")
            ids.append(token)
            end -= len(self.bytes_of[token])
        ids.reverse()
        return array("i", ids).tobytes()

    def _literal(self, stretch: str) -> bytes:
        """The ids of a stretch of text without special strings, or of one special string, packed as int32."""
        if stretch in self.specials:
            return array("i", [self.specials[stretch]]).tobytes()
        if stretch.isascii() and stretch[stretch[:1] == " " :].isalpha():  # one pre-token, remembered as a piece
            return self._pretoken(stretch)
        return b"".join(map(self.pretokens.__getitem__, self.pattern.findall(stretch)))

    def encode(self, text: str) -> bytes:
        """The ids of a whole text, packed as int32."""
        return b"".join(self.pieces.values(text))

    def forget(self) -> None:
        """Drops what it remembers, which refers back to it and would else wait for the collector of cycles."""
        self.tested = self.pretokens = self.pieces = None

    def decode(self, ids) -> str:
        return b"".join(map(self.bytes_of.__getitem__, ids)).decode("utf-8", "replace")


def _batches(whole: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    return (whole.slice(start, 256) for start in range(0, whole.num_rows, 256))


def _coded(docs: DataFrame, tokenizer_path: str, id_col: str, text_col: str, decodes: bool, room: int) -> DataFrame:
    small_batches(docs.sparkSession)
    id_type = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        bpe = PrefixBpe(tokenizer_path, room)  # this task's own, freed with it
        try:
            for batch in (part for whole in batches for part in _batches(whole)):
                packed = [bpe.encode(x) for x in batch.column(1).to_pylist()]
                ends = np.cumsum([0, *(len(x) // 4 for x in packed)])
                ids = np.frombuffer(b"".join(packed), np.int32)
                columns = [batch.column(0), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(ids))]
                if decodes:
                    values = ids.tolist()
                    columns.append(pa.array([bpe.decode(values[a:b]) for a, b in zip(ends[:-1], ends[1:], strict=True)], pa.string()))
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "ids", "decoded"][: len(columns)])
        finally:
            bpe.forget()

    schema = f"doc_id {id_type}, ids array<int>" + (", decoded string" if decodes else "")
    return docs.select(F.col(quoted(id_col)), text_or_empty(text_col).alias("content")).mapInArrow(run, schema)


def encode(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", room: int = 96 << 20) -> DataFrame:
    """``doc_id, ids array<int>`` for each row: the ids of the whole text.  A task remembers about ``room`` bytes of pieces; more of them save time."""
    return _coded(docs, tokenizer_path, id_col, text_col, False, room)


def encode_decode(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", room: int = 288 << 20) -> DataFrame:
    """``doc_id, ids array<int>, decoded string`` for each row: the ids of the whole text and the text decoded from them."""
    return _coded(docs, tokenizer_path, id_col, text_col, True, room)
