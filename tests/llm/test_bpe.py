import random

import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from lexweave.llm import bpe

PATH = public_tokenizers.path("byte_bpe_50k.json")
WORDS = [
    "the", " ", "  ", "\n", "'s", "'", "r", "ll", "é", "ß", "中", "22", "½", ".", "!!!", "\t", "\x1c",
    "\xa0", "<|endoftext|>", "<|end", "😀", "́", " the", "ing", "\r\n", "_", "\0",
]


@pytest.fixture(scope="module")
def vocabulary():
    with open(PATH, "rb") as file:
        return bpe.Vocabulary(file.read())


@pytest.fixture(scope="module")
def library():
    found = Tokenizer.from_file(PATH)
    found.no_truncation()
    found.no_padding()
    return found


def streamed(encoder, text, step):
    out = [x for at in range(0, len(text), step) for x in encoder.feed(text[at : at + step])]
    return list(memoryview(b"".join([*out, *encoder.finish()])).cast("i"))


def samples():
    random.seed(5)
    for k in range(150):
        text = "".join(random.choices(WORDS, k=random.randint(0, 40)))
        if k % 4 == 0:
            text += random.choice(["ing", "a", " ", "!", "7", "\n"]) * random.randint(1, 900)
        yield text + random.choice(["", "x", " x"])


@pytest.mark.parametrize("window", [8, 1000, 1 << 16])
def test_any_portions_give_the_library_s_ids(vocabulary, library, window):
    encoder = bpe.Encoder(vocabulary, window)
    for text in samples():
        want = library.encode(text, add_special_tokens=False).ids
        assert streamed(encoder, text, random.choice([1, 7, 5000])) == want


def test_long_run_keeps_only_the_lookahead(vocabulary, library):
    encoder = bpe.Encoder(vocabulary, 64)
    text, most, out = "ingth" * 4000, 0, []
    for at in range(0, len(text), 50):
        out += encoder.feed(text[at : at + 50])
        most = max(most, len(encoder.pending) + len(encoder.tail))
    out += encoder.finish()
    assert most <= 6 * vocabulary.lookahead
    ids = list(memoryview(b"".join(out)).cast("i"))
    assert ids == library.encode(text, add_special_tokens=False).ids


def test_decoder_takes_any_ids(vocabulary, library):
    random.seed(6)
    decoder = bpe.Decoder(vocabulary)
    for _ in range(100):
        ids = [random.randrange(50257) for _ in range(12)]
        text = "".join([decoder.feed(ids[i : i + 2]) for i in range(0, 12, 2)])
        assert text + decoder.finish() == library.decode(ids, skip_special_tokens=False)
    assert decoder.feed([-1, 10**6]) + decoder.finish() == ""


def test_round_trip_of_a_table(table, library):
    texts = [None, "", "a  b", "x" * 70_000, "né 中 <|endoftext|>", "né 中 <|endoftext|>"]
    rows = [(i, t, 1, "kept") for i, t in enumerate(texts)]
    df = table(rows, "doc_id bigint, text string, IDS int, text_ string")
    out = bpe.decode(bpe.encode(df, PATH), PATH)
    assert out.columns == ["doc_id", "text", "text_", "ids", "decoded"]
    for row in out.collect():
        want = library.encode(texts[row.doc_id] or "", add_special_tokens=False).ids
        assert row.ids == want and row.decoded == (texts[row.doc_id] or "") and row.text_ == "kept"
    assert bpe.encode(df.where("false"), PATH).count() == 0


def test_result_named_like_the_text(table):
    out = bpe.encode(table([(1, "a")], "doc_id int, text string"), PATH, ids="text")
    assert out.first().text == [64]
    assert out.where(F.size("text") == 1).count() == 1
