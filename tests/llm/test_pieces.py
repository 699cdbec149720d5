"""op13 against the tokenizer library: ids, byte spans, decoding; other normalisations by changed copies of the model."""

import collections
import hashlib
import random

import pytest
import sentencepiece

from tests.llm.cases import awkward, corpus, prose
from trawlmill.llm import op13_pieces
from trawlmill.llm.op13_pieces import PieceModel, _fields, default_model


def varint(n: int) -> bytes:
    out = b""
    while n > 127:
        out, n = out + bytes([n & 127 | 128]), n >> 7
    return out + bytes([n])


def field(number: int, content: bytes) -> bytes:
    return varint(number << 3 | 2) + varint(len(content)) + content


def changed(charsmap: bytes = b"", flags: tuple[int, int, int] = (1, 0, 1), trainer: bytes = b"", kinds: dict[str, int] | None = None) -> bytes:
    """The model with another normaliser (map; dummy prefix, trimming, escaping), more trainer fields, other kinds of pieces."""
    out = b""
    for number, value in _fields(open(default_model(), "rb").read()):
        if number == 1 and kinds and (kind := kinds.get(dict(_fields(value))[1].decode())):
            value += varint(3 << 3) + varint(kind)
        if number == 2:
            value += trainer
        if number == 3:
            value = field(1, b"own") + field(2, charsmap) + b"".join(varint(k << 3) + varint(f) for k, f in zip((3, 4, 5), flags, strict=True))
        out += field(number, value)
    return out


def nfkc() -> bytes:
    own = sentencepiece.SentencePieceNormalizer(rule_name="nmt_nfkc").serialized_model_proto()
    return next(dict(_fields(v))[2] for n, v in _fields(own) if n == 3)


def texts() -> list[str]:
    rng = random.Random(7)
    letters = list("aábeè  \t\n\r'stdlm0123.,!#<>\x00\x1c\x85  　▁﻿ñ漢字가각ｶﾞ①ﬁ½㍿😀éΩжЖé​…")
    out = ["".join(rng.choices(letters, k=rng.randint(0, 60))) for _ in range(1500)]
    out += ["".join(rng.choices("abcdethe ", k=rng.randint(0, 400))) for _ in range(200)]
    out += ["", " ", "   ", " a ", "a  b   c", "<s>", "</s> <unk> <0x41>", "a" * 3000, " " * 3000, "ab" * 2000, "▁▁x", "\n\n  \n", prose(3, 400)]
    return out


def spans(library, text: str) -> list[tuple[int, int, int]]:
    """Id, begin and end of each piece in source bytes."""
    out = []
    for number, value in _fields(library.encode(text, out_type="serialized_proto")):
        if number == 2:
            own = dict(_fields(value))
            out.append((own[2], own.get(4, 0), own.get(5, 0)))
    return out


def same(content: bytes, some: list[str]) -> None:
    own, library = PieceModel(content), sentencepiece.SentencePieceProcessor(model_proto=content)
    for text in some:
        ids, begins, ends = own.encode(text)
        assert list(zip(ids.tolist(), begins.tolist(), ends.tolist(), strict=True)) == spans(library, text), repr(text)
        assert own.decode(ids.tolist()) == library.decode(ids.tolist()), repr(text)


def test_ids_spans_and_decoding_are_exact():
    same(open(default_model(), "rb").read(), texts())


@pytest.mark.parametrize("flags", [(1, 1, 1), (0, 1, 1), (1, 0, 1), (0, 0, 1), (1, 1, 0)])
def test_compiled_character_map(flags):
    same(changed(nfkc(), flags), texts())


def test_other_models():
    no_bytes = varint(35 << 3) + varint(0)
    same(changed(trainer=no_bytes, kinds={f"<0x{b:02X}>": op13_pieces.CONTROL for b in range(256)}), texts())
    same(changed(trainer=varint(24 << 3) + varint(1)), texts())
    same(changed(kinds={"the": op13_pieces.USER_DEFINED, "ab": op13_pieces.USER_DEFINED, "漢字": op13_pieces.USER_DEFINED}), texts())
    same(changed(nfkc(), (1, 1, 1), kinds={"the": op13_pieces.UNUSED, "▁the": op13_pieces.UNUSED, "st": op13_pieces.UNUSED}), texts())
    with pytest.raises(ValueError):
        PieceModel(changed(trainer=varint(3 << 3) + varint(1)))


def test_decoding_of_any_ids():
    content = open(default_model(), "rb").read()
    rng = random.Random(3)
    for model in (content, changed(nfkc(), (1, 1, 1)), changed(flags=(0, 0, 1))):
        own, library = PieceModel(model), sentencepiece.SentencePieceProcessor(model_proto=model)
        for _ in range(1500):
            ids = [rng.choice((0, 1, 2, rng.randrange(3, 259), rng.randrange(259, 275), rng.randrange(32000))) for _ in range(rng.randint(0, 8))]
            assert own.decode(ids) == library.decode(ids), ids


def test_new_parts_are_merged_together(monkeypatch):
    # no short part is merged by itself, with or without characters outside the vocabulary, and full memos lose nothing
    content = open(default_model(), "rb").read()
    library = sentencepiece.SentencePieceProcessor(model_proto=content)
    some = [*texts()[:300], prose(3, 400), "漢字\n\n가각 end.\nNext &&& x", ""]
    for kinds in (None, {library.id_to_piece(library.get_piece_size() - 1): op13_pieces.CONTROL}):
        model = changed(kinds=kinds) if kinds else content
        expected = sentencepiece.SentencePieceProcessor(model_proto=model)
        for most in (op13_pieces.MEMO_PARTS, 7):
            monkeypatch.setattr(op13_pieces, "MEMO_PARTS", most)
            got = [ids.tolist() for ids, _, _ in PieceModel(model).encode_all(some)]
            assert got == [expected.encode(t) for t in some]
    monkeypatch.undo()
    own = PieceModel(content)
    monkeypatch.setattr(own, "_by_search", None)
    for text in (prose(5, 300), "new words\nover two lines, 漢字"):
        assert own.encode(text)[0].tolist() == library.encode(text)


def test_query_columns(spark):
    library = sentencepiece.SentencePieceProcessor(model_file=default_model())
    want = collections.Counter()
    for i, t in awkward():
        ids = library.encode(t or "")
        size = len((t or "").encode())
        digests = [hashlib.sha256(x.encode()).hexdigest() for x in (",".join(map(str, ids)), library.decode(ids))]
        want[i, len(ids), *digests, size, size] += 1
    assert collections.Counter(map(tuple, op13_pieces.piece_digests(corpus(spark), default_model()).collect())) == want
    encoded = op13_pieces.encode_pieces(corpus(spark), default_model())
    assert all(r.begins == sorted(r.begins) and len(r.ids) == len(r.begins) == len(r.ends) for r in encoded.collect())
    back = op13_pieces.decode_pieces(encoded, default_model()).collect()
    assert collections.Counter(map(tuple, back)) == collections.Counter((i, library.decode(library.encode(t or ""))) for i, t in awkward())
    assert op13_pieces.piece_digests(corpus(spark, []), default_model()).collect() == []
