"""Cached tokenizing against the tokenizers library, on random texts over all characters, and through the queries."""

import random
import unicodedata
import zlib

import numpy as np
import pytest

from lodestone.llm import packing, token_counts, token_io
from lodestone.llm.queries import QUERIES
from lodestone.llm.tokens import CachedTokenizer, cached, tokenizer_path

FILES = ("byte_bpe_50k.json", "word_bpe_49k.json")
#: Letters whose lower case lies beyond the Latin letters of the faster expression, and other changeable ones.
TURNING = "ƁƆƉƊƎƏƐƓƔƖƗƜƝƟƦƩƮƱƲƷẞΣςİIıKÅﬁǅ"
AFRICAN = "Ƙasa ta Ɓauna da Ɗan Ɛwe ƐƲƐ Ŋutsu"


def _blocks() -> list[list[str]]:
    """Characters this Python knows, in groups from which a random text draws."""
    known = [chr(c) for c in range(1, 0x110000) if unicodedata.category(chr(c)) not in ("Cn", "Cs", "Co")]
    latin = [c for c in known if ord(c) < 0x250]
    spaces = [c for c in known if c.isspace()]
    marks = [c for c in known if unicodedata.combining(c)]
    return [latin, latin, spaces + latin[:60], marks + latin[40:120], list(TURNING) + latin[:90], [c for c in known if ord(c) < 0x3000], known]


@pytest.mark.parametrize("name", FILES)
def test_random_texts_equal_the_library(name):
    random.seed(8)
    tokenizer, blocks = CachedTokenizer(tokenizer_path(name)), _blocks()
    fast = 0
    for _ in range(20_000):
        pool = random.choice(blocks)
        text = "".join(random.choice(" '" if random.random() < 0.2 else pool) for _ in range(random.randint(1, 24)))
        want = tokenizer.library.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(tokenizer.encode(text), "<u4").tolist() == want, ascii(text)
        assert tokenizer.count(text) == len(want), ascii(text)
        fast += tokenizer.pre_tokens(text) is not None
    assert fast > (12_000 if tokenizer.folds else 19_999)  # the cached way; folding leaves unusual marks to the library


@pytest.mark.parametrize("name", FILES)
def test_every_character_equals_the_library(name):
    """Each character below U+3000, and others in steps, between letters, digits, signs and spaces."""
    tokenizer = CachedTokenizer(tokenizer_path(name))
    for c in [*range(0x3000), *range(0x3000, 0x20000, 23)]:
        if not 0xD800 <= c < 0xE000:
            x = chr(c)
            text = f"a{x}B 1{x}2 !{x}? {x}{x}  {x}"
            assert np.frombuffer(tokenizer.encode(text), "<u4").tolist() == tokenizer.library.encode(text, add_special_tokens=False).ids, hex(c)


def test_special_and_unknown_go_to_the_library():
    for name in FILES:
        tokenizer = cached(tokenizer_path(name))
        for text in ("x<|endoftext|>y", "a<|startoftext|> b", "a՘b", "\U000187f8 z"):
            assert tokenizer.pre_tokens(text) is None or "startoftext" in text
            assert np.frombuffer(tokenizer.encode(text), "<u4").tolist() == tokenizer.library.encode(text, add_special_tokens=False).ids


def test_queries_equal_brute_force(spark, tmp_path):
    """op2, op3 and op8 on texts of many scripts and on the documents of a test table, against the library."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    extra = [(10**6, AFRICAN), (10**6 + 1, TURNING), (10**6 + 2, "Ελλάς ΟΔΟΣ Σ"), (10**6 + 3, "é 日本語 123 ١٢٣"), (10**6 + 4, "don't “quote” — 😀…"), (10**6 + 5, None)]
    docs = docs.unionByName(spark.createDataFrame(extra, "doc_id long, text string"))
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    texts = sorted((r["doc_id"], r["text"] or "") for r in docs.collect())

    def want(name, text, end):
        return [*cached(tokenizer_path(name)).library.encode(text, add_special_tokens=False).ids, *end]

    crc = lambda ids: zlib.crc32(np.array(ids, "<u4").tobytes())
    at, expected = 0, {}
    for doc_id, text in texts:
        ids = want("word_bpe_49k.json", text, [2])
        expected[doc_id] = (at, len(ids), crc(ids))
        at += len(ids)
    rows = QUERIES["op8_token_output"](spark, str(tmp_path)).collect()
    assert {r["doc_id"]: (r["start"], r["n_tokens"], r["ids_crc32"]) for r in rows} == expected and len(rows) == len(texts)
    rows = QUERIES["op3_token_counts"](spark, str(tmp_path)).collect()
    counts = {d: (len(t.encode()), len(want("byte_bpe_50k.json", t, []))) for d, t in texts}
    assert {r["doc_id"]: (r["n_bytes"], r["n_tokens"]) for r in rows} == counts and all(r["over_limit"] == (r["n_tokens"] > 1024) for r in rows)
    whole = {d: want("byte_bpe_50k.json", t, [1]) for d, t in texts}
    got = {}
    for r in QUERIES["op2_packing"](spark, str(tmp_path)).collect():
        ids = whole[r["doc_id"]][r["start"] : r["start"] + r["length"]]
        assert len(ids) == r["length"] and r["ids_crc32"] == crc(ids) and r["doc_tokens"] == len(whole[r["doc_id"]])
        got[r["doc_id"]] = got.get(r["doc_id"], 0) + r["length"]
    assert got == {d: len(x) for d, x in whole.items()}
    assert packing.CAPACITY == 2048 and token_counts.LIMIT == 1024 and token_io.END_ID == 2
