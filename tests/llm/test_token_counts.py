"""The histogram of encoded lengths against the tokenizers library and plain loops."""

import math
from collections import Counter

from assayer.llm import token_counts
from assayer.llm.queries import queries, tokenizer_path

TEXTS = [None, "", " \t\n", "one", "one", "Größe über alles, naïve café", "a b c " * 700, "word " * 30_000, "x", "don't stop 12345"]


def brute(lengths):
    n, before = len(lengths), 0
    ordered = sorted(lengths)
    ranks = [ordered[max(1, math.ceil(p * n / 100)) - 1] for p in range(101)]
    for size, documents in sorted(Counter(lengths).items()):
        before += documents
        rest = [x for x in lengths if x >= size]
        yield size, documents, before, len(rest), sum(rest), sum(min(x, size) for x in lengths), [p for p in range(101) if ranks[p] == size]


def test_histogram_equals_brute_force(spark):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer_path())
    texts = TEXTS + [" ".join(f"w{i}x{k}" for k in range(i % 37)) for i in range(230)]
    docs = spark.createDataFrame([(i, x, "clash") for i, x in enumerate(texts)] + [(None, "one", "no id")], "doc_id long, text string, n_tokens string").repartition(5)
    lengths = [len(t.encode(x or "", add_special_tokens=False).ids) for x in [*texts, "one"]]
    got = sorted(map(tuple, token_counts.length_histogram(docs, tokenizer_path()).collect()))
    assert got == list(brute(lengths))
    for limit in range(max(lengths) + 1) if max(lengths) < 3000 else [*range(3000), max(lengths)]:
        row = next(r for r in got if r[0] >= limit)
        assert row[5] - (row[0] - limit) * row[3] == sum(min(x, limit) for x in lengths)


def test_histogram_of_nothing(spark):
    assert token_counts.length_histogram(spark.createDataFrame([], "text string"), tokenizer_path()).count() == 0


def test_query_counts_every_document(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = queries()["op2_token_counts"](spark, "/root/testdata/sf0.001").collect()
    assert sum(r.documents for r in rows) == docs.count()
    assert max(r.truncated_tokens for r in rows) == sum(r.n_tokens * r.documents for r in rows) == max(r.tokens_at_least for r in rows)


def test_ids_equal_the_library_on_composing_letters_and_special_looks():
    """Every letter that joins with a mark, apart and joined, in both cases, and special tokens in any case."""
    import unicodedata

    import pyarrow as pa
    from assayer.llm.tokens import PieceEncoder
    from tokenizers import Tokenizer

    pairs = {unicodedata.normalize("NFD", chr(c)) for c in range(0xC0, 0x2FFF) if unicodedata.decomposition(chr(c)) and "<" not in unicodedata.decomposition(chr(c))}
    pairs |= {chr(c) + m for c in [*range(65, 91), *range(97, 123)] for m in map(chr, range(0x300, 0x370))}
    words = sorted(pairs | {p.upper() for p in pairs} | {p.lower() for p in pairs})
    texts = [*words, *(f"Ab{w}C, x" for w in words), *(f"{w}." for w in words), *(a + t + b for t in ("<|endoftext|>", "<|ENDOFTEXT|>", "<|EndOfText|>", "<|startoftext|>", "<|STARTOFTEXT|>", "<|endoftext") for a in ("", "x", "X ", "\u0130") for b in ("", "y", ".", "!Z"))]
    t = Tokenizer.from_file(tokenizer_path())
    got = list(PieceEncoder(tokenizer_path()).encode(pa.array([x.encode() for x in texts], pa.binary())))
    want = t.encode_batch(texts, add_special_tokens=False)
    assert [x for x, a, b in zip(texts, got, want) if a.tolist() != b.ids] == []
