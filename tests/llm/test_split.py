"""Splitting of oversized sections: limits, overlap, exact joining, boundaries."""

from __future__ import annotations

from hypothesis import given, settings
from hypothesis import strategies as st

from parchemin.llm import split as S


def prose(n: int, size: int = 12) -> str:
    """n words in sentences, five sentences a line, three lines a paragraph."""
    out = []
    for k in range(0, n, size):
        words = [f"mot{j}" for j in range(k, min(n, k + size))]
        end = "\n\n" if (k // size) % 15 == 14 else "\n" if (k // size) % 5 == 4 else " "
        out.append(" ".join(words) + "." + end)
    return "".join(out).strip()


def joined(found: list[tuple[str, int, int]]) -> str:
    out = found[0][0]
    for text, _, shared in found[1:]:
        starts = [m.start() for m in S.WORD.finditer(text)]
        out += text[starts[shared] :]
    return out


def check(text: str, limit: int, overlap: int) -> list[tuple[str, int, int]]:
    found = S.pieces(text, limit, overlap)
    assert joined(found) == text
    for k, (piece, n, shared) in enumerate(found):
        words = S.WORD.findall(piece)
        assert len(words) == n and (n <= limit) and shared == (overlap if k else 0)
        if k:
            assert words[:overlap] == S.WORD.findall(found[k - 1][0])[-overlap:]
    return found


def test_limit_is_inclusive():
    assert len(check(prose(600), 600, 50)) == 1
    assert len(check(prose(601), 600, 50)) == 2


def test_cuts_fall_between_sentences_and_at_headings():
    found = check(prose(3000), 600, 50)
    assert all(piece.rstrip().endswith(".") for piece, _, _ in found)
    text = "# Un\n" + prose(400) + "\n# Deux\n" + prose(400) + "\n# Trois\n" + prose(100)
    first, second = check(text, 600, 50)
    assert first[0].rstrip().endswith("mot399.") and "# Deux" in second[0] and "# Trois" in second[0]


def test_siblings_are_merged_before_parents_are_cut():
    text = "\n".join(f"## Partie {k}\n{prose(120)}" for k in range(10))
    found = check(text, 600, 50)
    assert len(found) == 3


def test_one_sentence_and_long_words():
    check(" ".join(f"w{k}" for k in range(2000)), 600, 50)
    check("x" * 100_000 + " " + " ".join(["y"] * 700), 600, 50)


def test_short_heading_before_a_large_block():
    found = check("# Titre\n" + " ".join(f"w{k}" for k in range(900)) + ".", 600, 50)
    assert found[0][1] >= 50


def test_deep_headings_and_lists():
    text = "\n".join("#" * (1 + k % 6) + f" Titre {k}\n- " + " ".join(["point"] * 30) for k in range(200))
    check(text, 100, 10)


def test_white_space_of_any_width():
    assert len(S.WORD.findall("a b c　d\te\nf​g")) == 6


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from(["mot", "Fin.", "# Titre", "\n", "\n\n", "- item", "a | 1 | b", "1.2 Sous", "\t", " ", "!"]), max_size=200), st.integers(6, 30), st.integers(1, 5))
def test_any_text_is_kept_whole(parts, limit, overlap):
    check(" ".join(parts), limit, overlap)


def test_operator_counts_rows_once_and_keeps_nulls(spark):
    data = [("a_1", "X", prose(700), "z"), ("a_1", "X", prose(700), "z"), ("a_2", None, "court", "z"), ("a_3", "Y", None, "z"), ("a_4", "Y", "", "z")]
    df = spark.createDataFrame(data, "chunk_id string, chunk_index string, text string, piece_no string")
    found = {(r.chunk_id, r.piece_no): r for r in S.split_all(df).collect()}
    assert set(found) == {("a_1", 1), ("a_1", 2), ("a_2", 1), ("a_3", 1), ("a_4", 1)}
    assert found[("a_3", 1)].text is None and found[("a_4", 1)].n_words == 0 and found[("a_1", 2)].n_shared == 50
    assert S.split_oversized(df.limit(0)).count() == 0


def test_a_heading_stays_with_what_follows():
    words = lambda n, w: " ".join([w] * n)
    text = f"Titre A\n{words(100, 'a')}.\n\n# Section B\n{words(549, 'b')}.\n{words(300, 'c')}.\n"
    found = S.pieces(text, 600, 50)
    assert len(found) > 1 and all(n <= 600 for _, n, _ in found)
    for piece, _, _ in found:
        assert not piece.rstrip().endswith("# Section B")
    assert any("# Section B\nb b" in piece for piece, _, _ in found)


def test_large_sections_are_not_merged_over_their_border():
    part = lambda w, n: f"# Section {w}\n" + " ".join([w] * n) + ".\n"
    starts = [piece.split("# Section")[-1].strip()[0] for piece, _, _ in S.pieces(part("a", 300) + part("b", 200) + part("c", 300), 600, 50)]
    assert starts == ["a", "b", "c"]
