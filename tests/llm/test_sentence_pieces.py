from __future__ import annotations

import hashlib
import random
import struct

import public_tokenizers
import pytest
import sentencepiece

from querylens.llm import sentence_pieces as s

PATH = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=PATH)


@pytest.fixture(scope="module")
def model():
    return s.Model(s.model_bytes())


def wanted(library, text):
    ids = library.encode(text or "", add_bos=True, add_eos=True)
    packed = hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest()
    return len(ids), packed, hashlib.sha256(library.decode(ids).encode()).hexdigest()


def test_tables_equal_the_library(odd, small, library, model):
    for rows, df in (odd, small):
        got = s.digests(df, s.model_bytes()).collect()
        assert sorted(((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in got), key=repr) == sorted(
            ((i, *wanted(library, t)) for i, t, *_ in rows), key=repr
        )
        spans = {(r.doc_id, r.n_tokens): r.spans_sha256 for r in got}
        for i, t, *_ in rows:
            ids, edges = model.encode(t or "")
            assert spans[i, len(ids) + 2] == hashlib.sha256(edges.astype("<i8").tobytes()).hexdigest() or i in (12, None)


def test_no_rows(none):
    assert s.digests(none, s.model_bytes()).collect() == [] and s.encoded(none, s.model_bytes()).collect() == []


def test_encoded_keeps_columns(odd, library):
    rows, df = odd
    out = s.encoded(df.drop("ids"), s.model_bytes())
    assert set(out.columns) == (set(df.columns) - {"text"}) | {"ids", "begins", "ends"}
    for r in out.collect():
        text = next(t or "" for i, t, *_ in rows if i == r.doc_id)
        assert r.ids == library.encode(text, add_bos=True, add_eos=True)
        raw = text.encode()
        assert len(r.begins) == len(r.ids) - 2 and (not r.ends or r.ends[-1] == len(raw))
        assert b"".join(raw[a:b] for a, b in zip(r.begins, r.ends)) == raw


def test_random_texts_and_ids(library, model):
    random_ = random.Random(5)
    for _ in range(1500):
        text = "".join(random_.choice(" \n\tabAB12▁é日🙂.,!<>s/") for _ in range(random_.randint(0, 60)))
        ids, _ = model.encode(text)
        assert ids.tolist() == library.encode(text)
        ids = [random_.randrange(0, 700) for _ in range(random_.randint(0, 12))]
        assert model.decode(ids) == library.decode(ids)


@pytest.mark.parametrize("rule", ["nmt_nfkc", "nfkc_cf"])
def test_compiled_character_map(rule):
    """Longest-prefix rules of other models, and the alignment they leave."""
    theirs = sentencepiece.SentencePieceNormalizer(rule_name=rule, add_dummy_prefix=True, remove_extra_whitespaces=True, escape_whitespaces=True)
    spec = dict(s._fields(dict(s._fields(theirs.serialized_model_proto()))[3]))
    ours = object.__new__(s.Model)
    ours.map, ours.dummy_prefix, ours.squeeze, ours.escape = s.CharacterMap(spec[2]), True, True, True
    random_ = random.Random(6)
    texts = ["  Ⅷ ﬁ ｶﾞ ①  ㌔ x ", "", "   "] + [
        "".join(random_.choice(" \tabAÉéŉ①ﬁ㌔ｶﾞ日　­") for _ in range(random_.randint(1, 30))) for _ in range(800)
    ]
    for text in texts:
        got, source = ours.normalized(text)
        assert got == theirs.normalize(text)
        assert len(source) == len(got.encode()) + 1 and (source[1:] >= source[:-1]).all() and source[-1] <= len(text.encode())
