import random

import pytest
from pyspark.sql import functions as F

from auralake.functions import subwords
from auralake.operators import models

files = pytest.importorskip("public_tokenizers")
tokenizers = pytest.importorskip("tokenizers")


@pytest.fixture(scope="module")
def library():
    t = tokenizers.Tokenizer.from_file(files.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    return t


@pytest.fixture(scope="module", params=["byte_bpe_50k.json", "byte_bpe_50k.tiktoken"])
def own(request):
    return subwords.PairTokenizer(subwords.read(files.path(request.param)))


ODD = ["", " ", "  \n\t x ", "Hello world", "it's we'll DON'T", "日本語 한국어 😀", "é́ ﬁ Ⅷ ½", "a" * 5000, "<|endoftext|>", "x\x00y\x85z\xa0", "12345 67,890.12", "ab " * 200, "\r\n\r\n", " " * 70 + "end", "ſ ʼn K"]


@pytest.mark.parametrize("text", ODD)
def test_odd_texts(own, library, text):
    ids = own.encode(text)
    assert ids == library.encode(text, add_special_tokens=False).ids and own.decode(ids) == text


def test_random_bytes_of_letters(own, library):
    rng = random.Random(0)
    for n in (1, 2, 3, 17, 400):
        for alphabet in ("ab", "the and", "aeiounrst", "áéß日"):
            text = "".join(rng.choice(alphabet) for _ in range(n))
            assert own.encode(text) == library.encode(text, add_special_tokens=False).ids


def test_a_long_pre_token_takes_no_square_of_its_length(own):
    text = "".join(random.Random(1).choice("etaoinshrdlu") for _ in range(300_000))
    assert own.decode(own.encode(text)) == text


def test_all_documents_by_the_model_step(spark, library):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    make = subwords.shared(spark, files.path("byte_bpe_50k.json"))
    rows = docs.select("text", models.encode_text(F.col("text"), make).alias("ids"))
    rows = rows.select("text", "ids", models.decode_text(F.col("ids"), make).alias("again")).collect()
    want = library.encode_batch([r.text for r in rows], add_special_tokens=False)
    assert all(list(r.ids) == w.ids and r.again == r.text for r, w in zip(rows, want, strict=True))


def test_unknown_ids_and_cut_characters(own):
    ids = own.encode("é日")
    assert own.decode([*ids, 10**6]) == "é日" and "�" in own.decode(own.encode("日")[:1])
