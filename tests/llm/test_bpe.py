import hashlib
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from touchline.llm import bpe as m

PATH = m.default_file()
LIBRARY = Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def machine():
    return m.transducer(PATH)


def expect(text):
    return LIBRARY.encode(text, add_special_tokens=False).ids


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=80))
def test_any_text(text):
    machine = m.transducer(PATH)
    ids = machine.encode([text])[0]
    assert ids == expect(text) and machine.decode(ids) == LIBRARY.decode(ids, skip_special_tokens=False)


def long_texts():
    rnd = random.Random(1)
    return ["a" * 5000, "é" * 900, " " * 4000, "=-" * 2000, "<|endoftext|>" * 3 + "x <|endoftext", *("".join(rnd.choice(a) for _ in range(6000)) for a in ("etaoin", "ab", "ETAOINshrdlu", "漢字かなéß"))]


def test_pieces_longer_than_the_window(machine):
    for t in long_texts():
        assert machine.encode([t])[0] == expect(t)


def whole_digests(text):
    ids = expect(text)
    return len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(LIBRARY.decode(ids, skip_special_tokens=False).encode()).hexdigest()


@pytest.mark.parametrize("pieces", [1, 3, 50, 1 << 16])
def test_digests_in_blocks(machine, monkeypatch, pieces):
    monkeypatch.setattr(m, "PIECES", pieces)
    texts = ["", "one  two\n", *long_texts(), "é漢🙂 " * 40, "<|endoftext|>", "a<|endoftext|>" * 5, "word " * 300 + "z" * 6000 + " end"]
    assert machine.digests(texts) == [whole_digests(t) for t in texts]
    assert machine.digests([]) == []


def test_memory_of_a_long_text(machine):
    import tracemalloc

    def peak(n):
        text = "some words of a text that goes on, and on. " * n
        tracemalloc.start()
        machine.digests([text])
        top = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        return top

    few, many = peak(20_000), peak(80_000)
    assert many < few * 1.2 and many < 16_000_000


def test_other_settings_are_refused(tmp_path):
    import json

    spec = json.load(open(PATH, encoding="utf-8"))
    m.supported(spec)
    for change in ({"normalizer": {"type": "NFC"}}, {"pre_tokenizer": {"type": "Whitespace"}}, {"pre_tokenizer": spec["pre_tokenizer"] | {"add_prefix_space": True}}, {"model": spec["model"] | {"dropout": 0.1}}, {"added_tokens": [spec["added_tokens"][0] | {"lstrip": True}]}):
        with pytest.raises(ValueError):
            m.supported(spec | change)
    path = tmp_path / "t.json"
    path.write_text(json.dumps(spec | {"normalizer": {"type": "NFC"}}))
    with pytest.raises(ValueError):
        m.Transducer(str(path))


def test_stream_equals_whole(machine):
    rnd = random.Random(2)
    raw = "".join(rnd.choice("thereinonatsion") for _ in range(5000)).encode()
    chunks = [raw[i : i + 37] for i in range(0, len(raw), 37)]
    emitted = list(machine.stream(chunks))
    assert sum(emitted, []) == machine.merge([raw])[0] and len(emitted) > 5


def test_lookahead_of_small_lists():
    # ab needs b to stay: bc is an earlier rule, so one byte beyond b
    ids = {1: 1, 2: 1, 3: 1, 4: 2, 5: 2}
    assert m.sufficient_lookahead([(2, 3, 4), (1, 2, 5)], ids) == 2
    assert m.sufficient_lookahead([(1, 2, 5)], ids) == 1


def test_decode_holds_unfinished_characters():
    raw = "aé漢🙂".encode()
    assert "".join(m.decode_stream([bytes([b]) for b in raw], block=1)) == "aé漢🙂"
    assert "".join(m.decode_stream([b"\xe6\xbc", b"x", b"\xf0\x9f"], block=1)) == "�x�"


def test_query_and_edges(spark):
    texts = [None, "", "Hello  world\n", "x" * 9000, "Hello  world\n"]
    docs = spark.createDataFrame([(i, t, "n") for i, t in enumerate(texts)], "doc_id long, text string, ids string")
    got = {r["doc_id"]: r for r in m.token_digests(docs).collect()}
    for i, t in enumerate(texts):
        ids = expect(t or "")
        assert got[i]["n_tokens"] == len(ids)
        assert got[i]["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert got[i]["decoded_sha256"] == hashlib.sha256(LIBRARY.decode(ids, skip_special_tokens=False).encode()).hexdigest()
    assert {r["doc_id"]: r["ids"] for r in m.encode_documents(docs).collect()}[2] == expect(texts[2])
    assert m.token_digests(docs.limit(0)).count() == 0
