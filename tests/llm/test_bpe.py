import hashlib
import random
import struct

import public_tokenizers
from tokenizers import Tokenizer

from quillon.llm import bpe

PATH = public_tokenizers.path("byte_bpe_50k.json")
HARD = [None, "", " ", "  a  ", "it's we'll '' ''s", "x<|endoftext|>y  <|endoftext|>", "a  b \u0085\n\n c", "中文 \U0001f600\U0001f600 é 123٣", "\t\t x\x1c\x1dy", "same", "same", "0" * 5000]


def expected(text, tok=Tokenizer.from_file(PATH)):
    ids = tok.encode(text or "", add_special_tokens=False).ids
    return len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest(), hashlib.sha256(tok.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_digests_follow_the_library(spark):
    rnd = random.Random(3)
    alphabet = "ab'sS \n\t.,!<|>19éßΣ́　\U0001f680"
    texts = HARD + ["".join(rnd.choice(alphabet) for _ in range(rnd.randint(1, 60))) for _ in range(300)]
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, words string")
    got = {r.doc_id: tuple(r)[1:] for r in bpe.digests(df, PATH).collect()}
    assert got == {i: expected(t) for i, t in enumerate(texts)}


def test_encode_then_decode_gives_the_text(spark):
    df = spark.createDataFrame(list(enumerate(HARD)), "doc_id long, text string")
    back = bpe.decode(bpe.encode(df, PATH), PATH)
    assert {r.doc_id: r.text for r in back.collect()} == {i: t or "" for i, t in enumerate(HARD)}


def test_table_and_rare_words_agree(spark):
    df = spark.createDataFrame([(1, "one two two three"), (2, "two five")], "doc_id long, text string")
    table = bpe.word_table(bpe.split(df), PATH)
    assert {r.word: r.n for r in table.collect()} == {"one": 1, " two": 2, " three": 1, "two": 1, " five": 1}
    assert bpe.frequent(table, most=1)["word"].to_pylist() == [" two"] and bpe.frequent(table, most=4).num_rows == 1 and bpe.frequent(table).num_rows == 5


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert bpe.digests(df, PATH).count() == 0


def test_whole_table(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    assert {r.doc_id: tuple(r)[1:] for r in bpe.op1_bpe_codec(spark, sf).collect()} == {r.doc_id: expected(r.text) for r in docs}
