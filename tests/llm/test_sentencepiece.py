"""The codec against the library's own Viterbi, brute force and round trips."""

import pathlib
import random

import numpy as np
import pytest

from sievestone.llm import sentencepiece_codec as codec

MODEL = pathlib.Path("/opt/tokenizers/piece_bpe_32k.model")
pytestmark = pytest.mark.skipif(not MODEL.exists(), reason="needs the vocabulary file")


@pytest.fixture(scope="module")
def vocabulary():
    return codec.load_vocabulary(str(MODEL))


def varint(data, at):
    out = shift = 0
    while True:
        b = data[at]
        at += 1
        out |= (b & 127) << shift
        shift += 7
        if b < 128:
            return out, at


def write_varint(n):
    out = bytearray()
    while True:
        out.append((n & 127) | (128 if n > 127 else 0))
        n >>= 7
        if not n:
            return bytes(out)


def fields(data):
    at = 0
    while at < len(data):
        begin = at
        tag, at = varint(data, at)
        if tag & 7 == 2:
            n, at = varint(data, at)
            body, at = data[at : at + n], at + n
        elif tag & 7 == 0:
            body, at = varint(data, at)
        else:
            at += 4 if tag & 7 == 5 else 8
            body = None
        yield tag, body, data[begin:at]


def as_unigram(data):
    """The same pieces and scores, as a model that the library searches by Viterbi."""
    out = b""
    for tag, body, raw in fields(data):
        if tag >> 3 == 2:
            inner = b"".join(write_varint(3 << 3) + write_varint(1) if t >> 3 == 3 else r for t, _, r in fields(body))
            raw = write_varint(tag) + write_varint(len(inner)) + inner
        out += raw
    return out


TEXTS = ["", " ", "  two  spaces ", "That it.", "Grüße aus Köln\n\nñandú", "tabs\tand\nlines\r\n", "▁mark▁ in text", "emoji 😀 and 汉字", "a" * 500, "é" * 90, "ab" * 300, "word " * 50, "!?...---===", "\x00\x01", " ▁"]


def whole_viterbi(v, text):
    """Plain search over the whole text."""
    chars = list(codec.SPACE + text.replace(codec.SPACE, codec._MARK).replace(" ", codec.SPACE)) if text else []
    best, back = [0.0], [None]
    for end in range(1, len(chars) + 1):
        top = (float("-inf"), None)
        for start in range(max(0, end - v.longest), end):
            i = v.real.get("".join(chars[start:end]))
            if i is None and end - start > 1:
                continue
            score = best[start] + (v.unknown_score if i is None else v.scores[i])
            if score > top[0]:
                top = (score, (start, i))
        best.append(top[0])
        back.append(top[1])
    ids, at = [], len(chars)
    while at:
        start, i = back[at]
        c = codec.SPACE if chars[start] == codec._MARK else chars[start]
        ids = ([v.byte_ids[b] for b in c.encode()] if i is None else [i]) + ids
        at = start
    return ids


@pytest.mark.parametrize("text", TEXTS)
def test_same_as_plain_search_and_round_trip(vocabulary, text):
    ids = codec.encode(vocabulary, text)
    assert ids == whole_viterbi(vocabulary, text)
    assert codec.decode(vocabulary, ids) == text


def test_streaming_same_as_batched(vocabulary):
    rng = random.Random(4)
    for _ in range(40):
        text = "".join(rng.choice("abehrt nñ\n.,▁é") for _ in range(rng.randrange(1, 200)))
        chars = [codec.SPACE, *text.replace(codec.SPACE, codec._MARK).replace(" ", codec.SPACE)]
        stream = codec.StreamingViterbi(vocabulary)
        got, widest = [], 0
        for c in chars:
            got += stream.feed(c)
            widest = max(widest, len(stream.chars))
        got += stream.finish()
        assert got == codec.encode(vocabulary, text)
        assert widest <= 6 * vocabulary.longest


def test_same_as_library(vocabulary):
    sentencepiece = pytest.importorskip("sentencepiece")
    sp = sentencepiece.SentencePieceProcessor(model_proto=as_unigram(MODEL.read_bytes()))
    rng = random.Random(1)
    # Words of ASCII letters: the library sums in single precision, which a lone space mark (score -1e9) would drown.
    texts = [" ".join("".join(rng.choice("theandofingtionouer") for _ in range(rng.randrange(1, 14))) for _ in range(60)) for _ in range(40)]
    for text in texts:
        assert codec.encode(vocabulary, text) == sp.encode(text), text


def test_many_texts_in_a_row(vocabulary):
    data = [t.encode() for t in TEXTS]
    offsets = np.cumsum([0, *map(len, data)])
    ids, first = codec.encode_texts(vocabulary, np.frombuffer(b"".join(data), np.uint8), offsets)
    for k, t in enumerate(TEXTS):
        assert ids[first[k] : first[k + 1]].tolist() == codec.encode(vocabulary, t)


@pytest.mark.parametrize("piece", [1, 7, 50, 1000])
def test_long_texts_go_by_pieces(vocabulary, piece):
    """Pieces end at boundaries that all paths share, so the ids are those of the whole."""
    for text in [*TEXTS, "Straße und señor ▁ x" * 40, "汉字" * 50]:
        data = np.frombuffer(text.encode(), np.uint8)
        got = codec.encode_long(vocabulary, data, piece).tolist()
        assert got == codec.encode(vocabulary, text)
        if text:
            assert codec.decode(vocabulary, got) == text


def test_shared_boundaries_are_inside_no_piece(vocabulary):
    text = "The quick brown fox, señor; das Straßenfest 汉字 😀 x1y2"
    data = np.frombuffer(text.encode(), np.uint8)
    at = 0
    while (at := codec.shared_boundary(vocabulary, data, at + 1)) < len(data):
        left, right = data[:at].tobytes().decode(), data[at:].tobytes().decode()
        pair = (left[-1] + right[0]).replace(" ", codec.SPACE)
        assert not any(pair in p for p in vocabulary.real)
