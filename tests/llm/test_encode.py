"""Token ids against two public implementations."""

from __future__ import annotations

import random
from pathlib import Path

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from parchemin.llm import encode as E

pytestmark = pytest.mark.skipif(not Path(E.FOLDER, E.VOCABULARY).exists(), reason="no vocabulary files")


@pytest.fixture(scope="module")
def reference():
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(f"{E.FOLDER}/byte_bpe_50k.json")
    own.encode_special_tokens = True
    return lambda text: own.encode(text, add_special_tokens=False).ids


@pytest.fixture(scope="module")
def mine():
    return E.encoder()


@settings(max_examples=300, deadline=None)
@given(text=st.text(max_size=80))
def test_any_text(reference, mine, text):
    assert mine.encode(text) == reference(text) and mine.count(text) == len(reference(text))


def test_vocabulary_words_and_long_runs(reference, mine):
    rng = random.Random(0)
    words = [w.decode() for w in mine.ranks if w.isalpha()]
    for _ in range(1500):
        text = "".join(rng.choices(words, k=4))
        assert mine.encode(text) == reference(text)
    for text in ("a" * 3000, "=" * 500, " " * 700 + "x", "\n" * 50, "é" * 400, "<|endoftext|>", "L'été  dernier…\t1 234,5 €"):
        assert mine.encode(text) == reference(text)


def test_many_languages_vocabulary():
    import tiktoken

    own = E.PrefixEncoder(vocabulary="byte_bpe_multi_50k.tiktoken")
    other = tiktoken.Encoding("own", pat_str=E.PATTERN, mergeable_ranks=own.ranks, special_tokens={})
    for text in ("Où est l'été ?", "Straße und Maß", "¿Qué? añadir", "данни за сигурност", "数据保护"):
        assert own.encode(text) == other.encode_ordinary(text)


@settings(max_examples=120, deadline=None)
@given(a=st.text(alphabet="ab é\n.1'", max_size=20), b=st.text(alphabet="ab é\n.1'", max_size=20), start=st.integers(0, 20), length=st.integers(0, 6))
def test_appends_and_edits_are_exact(reference, mine, a, b, start, length):
    table = E.PrefixTable(mine, a)
    table.append(b)
    assert table.ids() == reference(a + b)
    text = a + b
    table.edit(start, start + length, "xé")
    assert table.ids() == reference(text[:start] + "xé" + text[start + length :])


def test_operator(spark, reference):
    df = spark.createDataFrame([(1, "Bonjour", 5), (2, None, 5), (3, "", 5), (4, " ", 5)], "doc_id long, text string, ids int")
    assert {r.doc_id: r.ids for r in E.encode_documents(df).collect()} == {1: reference("Bonjour"), 2: [], 3: [], 4: reference(" ")}
    assert E.encode_documents(df.limit(0)).count() == 0
    assert {r.doc_id: r.n_tokens for r in E.count_tokens(df, "doc_id").collect()} == {1: len(reference("Bonjour")), 2: 0, 3: 0, 4: 1}
