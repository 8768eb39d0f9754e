"""Repeated passages are found wherever their pieces are whole, and nothing else is."""

import random

import pytest

from loomtale.llm import queries, sentence_dedup


def words(prefix, n):
    return " ".join(f"{prefix}{k}" for k in range(n))


def brute(rows, least_pieces, least_words):
    """doc_id -> (kept, n_removed), run by run."""
    seen, out = set(), {}
    for i, t in sorted(rows):
        parts = sentence_dedup.pieces(t)
        assert "".join(parts) == t
        gone = set()
        for k in range(len(parts)):
            n = least_pieces
            while k + n <= len(parts) and sum(len(p.split()) for p in parts[k : k + n]) < least_words:
                n += 1
            if k + n > len(parts):
                break
            run = tuple(p.strip() for p in parts[k : k + n])
            if run in seen:
                gone.update(range(k, k + n))
            seen.add(run)
        out[i] = ("".join(p for k, p in enumerate(parts) if k not in gone), len(gone))
    return out


@pytest.mark.parametrize(("least_pieces", "least_words"), [(2, 16), (1, 5), (3, 1)])
def test_against_brute_force(spark, least_pieces, least_words):
    rng = random.Random(least_words)
    base = [" ".join(f"w{rng.randint(0, 40)}{rng.choice(['', '', '', ',', '.', '! ', ';'])}" for _ in range(rng.randint(5, 60))) for _ in range(15)]
    rows = [(i, rng.choice([" ", "\n"]).join(rng.choice(base) if rng.random() < 0.7 else words(f"u{i}x", rng.randint(1, 40)) for _ in range(rng.randint(0, 4)))) for i in range(120)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    out = sentence_dedup.drop_repeated_sentences(docs, least_pieces=least_pieces, least_words=least_words).collect()
    assert {r["doc_id"]: (r["kept"], r["n_removed"]) for r in out} == brute(rows, least_pieces, least_words)


def test_query_on_real_texts(spark):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    expected = {i: n for i, (_, n) in brute(rows, sentence_dedup.PIECES, sentence_dedup.WORDS).items()}
    assert {r["doc_id"]: r["n_removed"] for r in queries.op7_sentence_dedup(spark, "/root/testdata/sf0.001").collect()} == expected


def test_planted_passages(spark):
    """Passages of 51 to 90 words, cut anywhere and put anywhere, with and without punctuation."""
    rng = random.Random(4)
    text = lambda name, n, stops: " ".join(f"{name}{k}{rng.choice(stops)}" for k in range(n))
    rows, marked = [], set()
    for k in range(60):
        stops = [""] if k % 3 == 0 else ["", "", "", "", "", "", ",", "."]
        passage = text(f"p{k}q", rng.randint(51, 90), stops)
        rows.append((2 * k, f"{text(f'a{k}b', 30, stops)} {passage} {text(f'c{k}d', 30, stops)}"))
        rows.append((2 * k + 1, f"{text(f'e{k}f', 30, stops)} {passage} {text(f'g{k}h', 30, stops)}"))
        marked.add(2 * k + 1)
    out = sentence_dedup.drop_repeated_sentences(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    found = {r["doc_id"] for r in out if r["n_removed"]}
    assert not found - marked and len(found) >= 0.95 * len(marked)
    assert all(f"a{r['doc_id'] // 2}b0" in r["kept"] or f"e{r['doc_id'] // 2}f0" in r["kept"] for r in out)


def test_short_and_empty_texts(spark):
    rows = [(1, "One two. Three."), (2, "One two. Three."), (3, ""), (4, None), (5, " \n "), (None, "One two. Three.")]
    out = sentence_dedup.drop_repeated_sentences(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r["doc_id"]: (r["kept"], r["n_removed"]) for r in out} == {i: (t or "", 0) for i, t in rows}
