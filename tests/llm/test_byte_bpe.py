"""Ids against the library that defines them, the machine's bounds, and incremental decoding."""

import codecs
import hashlib

import numpy as np
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from tracequarry.llm import byte_bpe, token_spans
from tracequarry.llm.queries import vocabulary

PATH, PATTERN = vocabulary()
CODEC = byte_bpe.Codec(PATH, PATTERN)
LIBRARY = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=CODEC.machine.ranks, special_tokens={})
TEXTS = st.one_of(st.text(max_size=60), st.text(alphabet="aeinrst' \n.1é", max_size=80), st.text(alphabet="ab", max_size=120))


def ids(data: bytes) -> list[int]:
    return np.frombuffer(data, "<u4").tolist()


@settings(max_examples=400, deadline=None)
@given(TEXTS)
def test_ids_equal_the_library(text):
    assert ids(CODEC.encode(text)) == LIBRARY.encode_ordinary(text)
    assert CODEC.decode(CODEC.encode(text)) == text


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 50255), min_size=1, max_size=8))
def test_joined_tokens_equal_the_library(found):
    piece = b"".join(CODEC.bytes_of[i] for i in found)
    assert CODEC.machine.encode(piece) == LIBRARY._core_bpe.encode_single_piece(piece)


@settings(max_examples=200, deadline=None)
@given(st.integers(0, 50255), st.integers(0, 50255))
def test_pairs_by_definition(left, right):
    machine = CODEC.machine
    if machine.proper(left) and machine.proper(right):
        assert machine.apart(left, right) == (machine.merged(machine.tokens[left] + machine.tokens[right]) == [left, right])


def test_tables_stay_bounded(monkeypatch):
    monkeypatch.setattr(byte_bpe, "MAX_STATES", 40)
    monkeypatch.setattr(byte_bpe, "MAX_PIECES", 5)
    monkeypatch.setattr(byte_bpe, "MAX_PAIRS", 30)
    small = byte_bpe.Codec(PATH, PATTERN)
    text = "unboundedlylongpiecewithoutanyspace" * 40 + " several different words follow here and there"
    assert ids(small.encode(text)) == LIBRARY.encode_ordinary(text)
    assert len(small.machine.states) <= 42 and len(small.pieces) <= 5 and len(small.machine.pairs) <= 30


def test_emission_lookahead_is_bounded():
    machine, state, waiting = CODEC.machine, CODEC.machine.begin, 0
    longest = max(map(len, machine.ranks))
    for k, b in enumerate(b"internationalisation" * 30, 1):
        out, state = state.steps.get(b) or machine.step(state, b)
        waiting = k if not out else 0 if waiting == 0 else waiting
        assert all(sum(len(machine.tokens[t]) for t in rest) <= 2 * longest for _, _, rest in state.items)


@settings(max_examples=200, deadline=None)
@given(st.binary(max_size=30), st.integers(1, 5))
def test_utf8_machine_equals_the_standard_decoder(data, size):
    ours, theirs = byte_bpe.Utf8Machine(), codecs.getincrementaldecoder("utf-8")("replace")
    got = "".join(ours.feed(data[i : i + size]) for i in range(0, len(data), size)) + ours.end()
    assert got == theirs.decode(data, True) == data.decode("utf-8", "replace")


@settings(max_examples=100, deadline=None)
@given(st.text(max_size=30), st.integers(1, 4))
def test_utf8_machine_holds_back_only_unfinished_characters(text, size):
    ours, data, out = byte_bpe.Utf8Machine(), text.encode(), ""
    for i in range(0, len(data), size):
        out += ours.feed(data[i : i + size])
        assert out == data[: i + size].decode("utf-8", "ignore")


def test_rows(spark):
    texts = [None, "", "Hello wörld", "\n\n \t", "日本語" * 5000, "a" * 5000, "Hello wörld"]
    docs = spark.createDataFrame([(None if i == 6 else i, t, "x", 1) for i, t in enumerate(texts)], "doc_id long, text string, n_tokens string, ids int")
    got = byte_bpe.encode_documents(docs, PATH, PATTERN, keep_ids=True).collect()
    assert len(got) == 7
    for r in got:
        text = texts[6 if r.doc_id is None else r.doc_id] or ""
        true = np.array(LIBRARY.encode_ordinary(text), "<u4").tobytes()
        assert (r.n_tokens, bytes(r.ids), r.ids_sha256) == (len(true) // 4, true, hashlib.sha256(true).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()
    assert byte_bpe.encode_documents(docs.limit(0), PATH, PATTERN).count() == 0


def brute_sections(text: str, rule: str) -> list[tuple]:
    cuts, lines = [], text.split("\n")
    for k, line in enumerate(lines):
        cuts.append((cuts[-1] if cuts else 0) + len(line) + (k < len(lines) - 1))
    begins, counts, crossing = [0, *cuts[:-1]], [0] * len(cuts), [0] * len(cuts)
    char_at = [i for i, c in enumerate(text) for _ in c.encode()]
    at = 0
    for i in LIBRARY.encode_ordinary(text):
        size = len(CODEC.bytes_of[i])
        touched = sorted(set(char_at[at : at + size]))
        at += size
        per = [sum(b <= c < e for c in touched) for b, e in zip(begins, cuts)]
        held = [k for k, n in enumerate(per) if n]
        own = held[0] if rule == "start" else held[-1] if rule == "end" else per.index(max(per))
        counts[own] += 1
        crossing[own] += len(held) > 1
    return list(zip(range(len(cuts)), begins, cuts, counts, crossing))


@pytest.mark.parametrize("rule", token_spans.RULES)
def test_sections_equal_brute_force(spark, rule):
    texts = ["", None, "one\ntwo words\n", "\n\n\n", "a \n\n\n b\n日本\n🙂🙂\n", "x" * 3000 + "\n" + "tail", "no end", "  \n\n   \n c"]
    docs = spark.createDataFrame([(i, t, 7) for i, t in enumerate(texts)], "doc_id long, text string, section int")
    got = token_spans.attribute_tokens(docs, PATH, PATTERN, rule=rule).collect()
    for i, t in enumerate(texts):
        mine = sorted((r.section, r.start_char, r.end_char, r.n_tokens, r.n_crossing) for r in got if r.doc_id == i)
        assert mine == brute_sections(t or "", rule)
    assert token_spans.attribute_tokens(docs.limit(0), PATH, PATTERN).count() == 0


def test_unknown_rule_and_separator(spark):
    docs = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    with pytest.raises(ValueError):
        token_spans.attribute_tokens(docs, PATH, PATTERN, rule="both")
    with pytest.raises(ValueError):
        token_spans.attribute_tokens(docs, PATH, PATTERN, separator="¶")
