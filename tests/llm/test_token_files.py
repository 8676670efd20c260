import zlib

import numpy as np
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tests.llm.helpers import frame
from tidewire.llm.queries import tokenizer_file
from tidewire.llm.token_files import read_tokens, token_digest, tokens_path, write_tokens

FILE = tokenizer_file("word_bpe_49k.json")
TEXTS = [
    "It's a dog's life, DON'T'S! <|endoftext|>x ÀÉ×Ÿ ÷a. é. ñ!! “x.” H̱ é Σ İ ab cd.",
    None,
    "",
    " \n a.b.c... 3.14, 2, ß. KK. x²! ’s it’s 'S. a's.. <|startoftext|>. ．. ª. º! Þ",
    "x" * 50_000 + " " + "word. " * 30_000,
    "the end",
    "the end",
]


def want(tokenizer, text):
    return tokenizer.encode(text or "", add_special_tokens=False).ids + [2]


def test_round_trip_equals_the_tokenizer(spark):
    tokenizer = Tokenizer.from_file(FILE)
    ids = [9, 4, 2, 30, 11, 5, 5]
    df = frame(spark, TEXTS, ids).withColumns({"part": F.lit("x"), "_base": F.lit(1), "n_tokens": F.lit(0)})
    path = tokens_path(spark)
    write_tokens(df, path, FILE)
    rows = read_tokens(spark, path).orderBy("start").collect()
    order = sorted(range(len(ids)), key=lambda i: ids[i])
    assert [r.doc_id for r in rows] == [ids[i] for i in order]
    assert [r.tokens for r in rows] == [want(tokenizer, TEXTS[i]) for i in order]
    starts = np.cumsum([0] + [r.n_tokens for r in rows])[:-1]
    assert [r.start for r in rows] == starts.tolist()
    digest = token_digest(spark, path).orderBy("start").collect()
    assert [r.ids_crc32 for r in digest] == [zlib.crc32(np.array(r.tokens, "<u4").tobytes()) for r in rows]
    some = read_tokens(spark, path, ids=[30], tokens=False)
    assert [tuple(r) for r in some.collect()] == [(30, int(starts[-1]), rows[-1].n_tokens)]
    plan = some._jdf.queryExecution().executedPlan().toString()
    assert "tokens:array" not in plan and "PushedFilters: [In(doc_id" in plan or "EqualTo(doc_id,30)" in plan


def test_null_id_and_empty_table(spark):
    path = tokens_path(spark)
    write_tokens(frame(spark, ["a b", "c"], [3, None]), path, FILE)
    assert [r.doc_id for r in token_digest(spark, path).orderBy("start").collect()] == [None, 3]
    path = tokens_path(spark)
    write_tokens(frame(spark, []), path, FILE)
    assert token_digest(spark, path).collect() == []
