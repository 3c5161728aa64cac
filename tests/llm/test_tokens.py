"""Token counts, BPE and binary records against the tokenizers library."""

import hashlib
import random
import struct
import sys
import zlib

import pytest
from pyspark.sql import functions as F

from lingweave.llm import binary_records, bpe, pieces, token_counts
from lingweave.llm.common import scratch_path

P = pytest.importorskip("public_tokenizers")
BYTE, WORD = P.path("byte_bpe_50k.json"), P.path("word_bpe_49k.json")
TEXTS = [None, "", " ", "\n\n", "a  b", "Hello, world's <|endoftext|> end\n\n\n x", "\t mixed　\x85 \x1c space ", "é" * 50, "a" * 3000 + " b", "你好 😀 straße İ Σς", "<|startoftext|>x", "same", "same"]


@pytest.fixture(scope="module")
def libraries():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(BYTE), Tokenizer.from_file(WORD)


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i if i != 3 else None, t, "x", 1) for i, t in enumerate(TEXTS)] + [(7, "another of the same id", "x", 1)]
    return spark.createDataFrame(rows, "doc_id long, text string, digest string, n_tokens int")


def ids_of(tokenizer, text):
    return tokenizer.encode(text or "", add_special_tokens=False).ids


def random_texts(n):
    rng = random.Random(5)
    alphabet = [*"aabbcd \n\t\r.,!?'%éßö你😀१²½", " the", "\n", "  ", "<|endoftext|>", "<|startoftext|>", "'ll", " ", "\x1c", "aaaa", "Σ", "İ", "́"]
    return ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 30))) for _ in range(n)]


def test_encoders_equal_the_library_on_random_texts(libraries):
    byte, word = libraries
    import numpy as np

    own, count, spaceless = bpe.PrefixBpe(BYTE, room=50_000), token_counts.counter(BYTE), binary_records.SpacelessEncoder(WORD, 1, room=50_000)
    for t in random_texts(3000):
        expected = ids_of(byte, t)
        got = np.frombuffer(own.encode(t), np.int32).tolist()
        assert got == expected, t
        assert own.decode(got) == byte.decode(expected, skip_special_tokens=False)
        assert count(t) == len(expected)
        assert np.frombuffer(spaceless.encode(t), np.uint16).tolist() == [*ids_of(word, t), 1]


def test_words_are_encoded_once_whatever_stands_beside_them(libraries, monkeypatch):
    import numpy as np

    made, missing = [], pieces.Memory.__missing__
    monkeypatch.setattr(pieces.Memory, "__missing__", lambda self, key: made.append(key) or missing(self, key))
    spaceless = binary_records.SpacelessEncoder(WORD, 1)
    words, marks = ["Haus", "élan", "tree", "señor", "über"], [".", ",", "!", ";", "###", ")", "...", "%"]
    for w in words:
        for m in marks:
            text = f"{w}{m} {w.upper()}\n{m}{w.title()}"
            assert np.frombuffer(spaceless.encode(text), np.uint16).tolist() == [*ids_of(libraries[1], text), 1]
    assert len(made) <= len(words) + len(marks)


def test_spaceless_encoder_equals_the_library_on_all_early_characters(libraries):
    import numpy as np

    spaceless = binary_records.SpacelessEncoder(WORD, 1)
    for c in [*map(chr, range(0x600)), "’", "“", "\u2028", "\u3000", "Ⱥ", "Ⱦ", "ẞ", "中", "😀", "ﬁ", "K"]:
        for text in (f"a{c}b Cd{c}'s {c}1{c}{c}\n{c}", f"it's {c} x", c, f" {c}", "я" * 200 + f" {c}a{c}", f"a{c} b c{c}É “d{c}” e"):
            assert np.frombuffer(spaceless.encode(text), np.uint16).tolist() == [*ids_of(libraries[1], text), 1], (c, text)


def test_patterns_are_spelt_out_or_left():
    import re

    import regex

    known = [chr(c) for c in range(0x500)]
    for pattern in (r"[\p{L}]+|[^\s\p{N}\]]", r"\p{Lu}\p{^L}|\s(?=x)|'s", r"[\^\p{P}]+|\n"):
        for a in known:
            for text in (a, f"a{a}]", f"X{a}x"):
                assert re.findall(pieces.spelt_out(pattern), text) == regex.findall(pattern, text), (pattern, text)
    assert [pieces.spelt_out(p) for p in (r"\p{Greek}", r"\S+", r"(?i:'s)", r"[a[b]]", r"\P{L}", r"\w")] == [None] * 6


def test_memory_keeps_keys_in_use():
    made = []
    memory = pieces.Memory(lambda k: made.append(k) or k, 4 * (pieces.Memory.ENTRY + 2 * sys.getsizeof(1)))
    for k in (1, 2, 3, 1, 4, 1):
        assert memory[k] == k
    assert made.count(1) == 1


def test_token_counts_and_cache(spark, docs, libraries):
    path = scratch_path(spark, "cache")
    found = sorted((tuple(r) for r in token_counts.count_tokens(docs, BYTE, path, limit=20).collect()), key=repr)
    expected = sorted(((r.doc_id, len((r.text or "").encode()), len(ids_of(libraries[0], r.text)), len(ids_of(libraries[0], r.text)) > 20) for r in docs.collect()), key=repr)
    assert found == expected
    distinct = len({r.text or "" for r in docs.collect()})
    assert spark.read.parquet(path).count() == distinct
    again = token_counts.count_tokens(docs.union(spark.createDataFrame([(99, "new one", "x", 1)], docs.schema)), BYTE, path)
    assert again.count() == len(expected) + 1
    assert spark.read.parquet(path).count() == distinct + 1
    assert token_counts.count_tokens(docs.limit(0), BYTE).count() == 0


def test_repeated_rows_are_encoded_once(spark, libraries):
    path = scratch_path(spark, "cache")
    rows = spark.createDataFrame([(1, "a row that comes again")] * 40 + [(None, "of no id")] * 3 + [(2, "a row that comes again"), (3, "word " * 100_000)], "doc_id long, text string").repartition(5)
    found = token_counts.count_tokens(rows, BYTE, path).collect()
    assert spark.read.parquet(path).count() == 3
    assert len(found) == 45 and {r.n_tokens for r in found if r.doc_id == 3} == {len(ids_of(libraries[0], "word " * 100_000))}
    again = spark.createDataFrame([(9, "of no id"), (9, "of no id"), (9, "new"), (9, "new")], "doc_id long, text string")
    assert token_counts.count_tokens(again, BYTE, path).count() == 4
    assert spark.read.parquet(path).count() == 4


def test_bpe_round_trip(spark, docs, libraries):
    rows = sorted(((r.doc_id, tuple(r.ids), r.decoded) for r in bpe.encode_decode(docs, BYTE).collect()), key=repr)
    assert rows == sorted(((r.doc_id, tuple(ids_of(libraries[0], r.text)), r.text or "") for r in docs.collect()), key=repr)
    assert bpe.encode_decode(docs.limit(0), BYTE).count() == 0


def test_pairs_fit_as_merging_says(libraries):
    own, rng = bpe.PrefixBpe(BYTE), random.Random(3)
    tokens = [i for i in range(50256) if own.bytes_of[i].isalpha()]
    n = len(own.bytes_of)
    for _ in range(3000):
        a, b = rng.choice(tokens), rng.choice(tokens)
        text = (own.bytes_of[a] + own.bytes_of[b]).decode()
        assert own.fits(a * n + b) == (ids_of(libraries[0], text) == [a, b])


def test_records_round_trip(spark, docs, libraries):
    out = scratch_path(spark, "records")
    manifest = binary_records.write_token_records(docs, out, WORD, 1)
    rows = binary_records.read_token_records(spark, out).orderBy("shard", "place").collect()
    ordered = sorted(docs.collect(), key=lambda r: (r.doc_id is not None, r.doc_id or 0, r.text or ""))
    start = 0
    assert len(rows) == len(ordered)
    for r, d in zip(rows, ordered, strict=True):
        ids = [*ids_of(libraries[1], d.text), 1]
        assert (r.doc_id, r.start, r.n_tokens, list(r.ids)) == (d.doc_id, start, len(ids), ids)
        assert zlib.crc32(bytes(r.ids_le)) == zlib.crc32(struct.pack(f"<{len(ids)}I", *ids))
        start += len(ids)
    assert manifest.agg(F.sum("n_tokens")).first()[0] == start
    empty = scratch_path(spark, "records")
    binary_records.write_token_records(docs.limit(0), empty, WORD, 1)
    assert binary_records.read_token_records(spark, empty).count() == 0


def test_damage_is_found():
    framed = bytearray(binary_records.frame(binary_records.pack(5, b"\x01\x00", 2)))
    assert binary_records.unpack(binary_records.unframe(framed, 0)[0])[0] == 5
    framed[15] ^= 1
    with pytest.raises(ValueError):
        binary_records.unframe(framed, 0)
    framed[15] ^= 1
    framed[0] ^= 1
    with pytest.raises(ValueError):
        binary_records.unframe(framed, 0)


def test_queries(spark):
    from lingweave.llm import queries

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").orderBy("doc_id").collect()
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(BYTE)

    for r, d in zip(queries.op4_bpe(spark, "/root/testdata/sf0.001").orderBy("doc_id").collect(), docs, strict=True):
        ids = ids_of(library, d.text)
        assert (r.doc_id, r.n_tokens, r.ids_sha256) == (d.doc_id, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(d.text.encode()).hexdigest()
