import hashlib
import random

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from plait.llm import bpe
from tests.llm.conftest import EDGE_TEXTS

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def test_equals_library(library, prose):
    own = bpe.load(PATH)
    rng = random.Random(1)
    odd = ["".join(chr(rng.choice([rng.randrange(32, 127), rng.randrange(160, 600), rng.randrange(0x370, 0x500), 10, 32, 0x3A3])) for _ in range(80)) for _ in range(200)]
    for t in [x or "" for x in EDGE_TEXTS] + prose + odd:
        want = library.encode(t, add_special_tokens=False).ids
        assert own.encode(t) == want, t
        text = library.decode(want, skip_special_tokens=False)
        assert own.decode(want) == text
        n, ids, decoded = own.digest(t)
        assert n == len(want)
        assert ids == hashlib.sha256(" ".join(map(str, want)).encode()).hexdigest()
        assert decoded == hashlib.sha256(text.encode()).hexdigest()


def test_long_words_merge_alike(prose):
    own = bpe.load(PATH)
    rng = random.Random(2)
    for n in (65, 100, 400):
        word = "".join(rng.choice("abcdethsiou") for _ in range(n))
        ids = [own.inner[b] for b in word.encode()]
        ids[-1] = own.final[word.encode()[-1]]
        short = list(ids)
        old, bpe.LONG = bpe.LONG, 10**9
        try:
            want = own.merge(short)
        finally:
            bpe.LONG = old
        assert own.merge(list(ids)) == want


def test_query_rows(spark, edge_docs):
    got = bpe.encode_digests(edge_docs, PATH).collect()
    assert len(got) == edge_docs.count()
    empty = hashlib.sha256(b"").hexdigest()
    assert [r for r in got if r.doc_id == 0][0][1:] == (0, empty, empty)
    assert bpe.encode_digests(edge_docs.limit(0), PATH).count() == 0
    assert bpe.encoded(edge_docs, PATH).where("doc_id = 4").first().decoded == "a</w>"


def test_letters_of_any_block(library):
    own = bpe.load(PATH)
    rng = random.Random(3)
    blocks = [range(0x250, 0x400), range(0x400, 0x600), range(0x600, 0x1100), range(0x1100, 0x3000), range(0x3000, 0xD7FF), range(0xE000, 0x10000), range(0x10000, 0x20000)]
    texts = ["".join(chr(rng.choice(rng.choice(blocks))) for _ in range(rng.randrange(1, 40))) for _ in range(1500)]
    texts += ["a" + c + "b!" + c + "!" + c + "1" for c in "ᲉꟋꟚ՘აᲐ\U00016EA0"]
    for t in texts:
        assert own.encode(t) == library.encode(t, add_special_tokens=False).ids, t


def test_other_steps_are_refused(tmp_path):
    import json

    with open(PATH, encoding="utf-8") as f:
        spec = json.load(f)
    spec["normalizer"]["normalizers"].pop()
    (tmp_path / "other.json").write_text(json.dumps(spec))
    with pytest.raises(ValueError):
        bpe.WordBpe(str(tmp_path / "other.json"))
