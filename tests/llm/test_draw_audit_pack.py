"""Importance resampling, the audit of sources and best-fit packing: against plain Python, the library and SQL."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from loomtale.llm import divergence, importance, packing, queries

DATA = "/root/testdata/sf0.001"
CLASHING = ["TEXT ", "Score", "RANK", "weight", "row", "c0", "n_words", "N_Features", "part", "at", "a`b", "x.y", "sequence_id", "Offset", "length", "term", "n", "value"]
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def lowered(text):
    return re.sub("[A-Z]", lambda m: m.group().lower(), text or "")


def test_spans_are_the_checksums_of_zlib():
    r = random.Random(3)
    data = np.frombuffer(bytes(r.randrange(256) for _ in range(30_000)), np.uint8)
    sizes = [*range(1, 300), *(importance.REACH * k + d for k in (1, 2, 3, 9, 70) for d in (-1, 0, 1))]
    r.shuffle(sizes)
    starts = [r.randrange(len(data) - n) for n in sizes]
    assert importance.crc32_spans(data, np.array(starts), np.array(sizes)).tolist() == [zlib.crc32(data[a : a + n].tobytes()) for a, n in zip(starts, sizes, strict=True)]


ODD = [(1, "One two three one TWO three " * 5, "a", "x"), (1, "One two three one TWO three " * 5, "a", "x"), (2, None, None, "x"), (3, "", "a", None), (None, "three two one " * 9, "b", "y"), (4, "ß é 日本 😀 \x00 a\x00b", "a", "y"),
    (5, "w" * 3000 + " one two " + "é" * 700 + " " + "w" * 3000, "a", "x"), (6, " ".join(f"word{i % 50}" for i in range(9000)), "b", "y"), (7, "one two, three! " * 12, "a", "z"), (8, "averyveryverylongterm one averyveryverylongterm ONE", "a", "z"), (9, "averyveryverylongterm x", "a", "x")]


@pytest.fixture(scope="module")
def odd(spark):
    base = spark.createDataFrame(ODD, "doc_id long, text string, lang string, source string")
    return base.select("*", *[F.lit(f"user's {c}").alias(c) for c in CLASHING]).repartition(3)


@pytest.fixture(scope="module")
def target(spark):
    return spark.createDataFrame([(1, "three two one two"), (2, None), (3, "")], "item_id long, text string").withColumn("TEXT ", F.lit(1))


def drawn(rows, aimed, percent, min_words):
    """(doc_id, text) -> n_features, weight, score and rank, in plain Python."""

    def features(text):
        w = WORD.findall(lowered(text))
        return [" ".join(w[i : i + k]) for k in (1, 2, 3) for i in range(len(w) - k + 1)], len(w)

    bucket = lambda f: zlib.crc32(f.encode()) % 10000
    s, t = (Counter(bucket(f) for x in texts for f in features(x)[0]) for texts in ([r[1] for r in rows], aimed))
    total, goal = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (total + 10000) / ((s[b] + 1) * (goal + 10000))))
    made = []
    for i, text, *_ in rows:
        f, n = features(text)
        weight = sum(gain(bucket(x)) for x in f)
        h = int(hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        made.append((i, text, n, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    order = sorted((m for m in made if m[2] >= min_words), key=lambda m: (-m[5], m[0] is not None, m[0] or 0))
    n_drawn = percent * len(order) // 100
    out = defaultdict(list)
    for m in made:
        out[m[0], m[1]].append(m[3:6])
    return {k: sorted(v) for k, v in out.items()}, [(m[0], m[5]) for m in order[:n_drawn]]


@pytest.mark.parametrize("percent", [5, 60, 100])
def test_a_draw_against_plain_python(odd, target, percent):
    got = importance.resample(odd, target, percent=percent)
    results = ["n_words", "n_features", "weight", "score", "rank"]
    assert got.columns == ["doc_id", "text", "lang", "source", *[c for c in CLASHING if c.lower() not in results], *results]
    rows = got.select("doc_id", "text", "n_features", "weight", "score", "rank").collect()
    expected, order = drawn(ODD, [r["text"] for r in target.select("text").collect()], percent, 20)
    found = defaultdict(list)
    for r in rows:
        found[r["doc_id"], r["text"]].append((r["n_features"], r["weight"], r["score"]))
    assert {k: sorted(v) for k, v in found.items()} == expected
    ranked = sorted((r["rank"], r["doc_id"], r["score"]) for r in rows if r["rank"] is not None)
    assert [r[0] for r in ranked] == list(range(1, len(order) + 1)) and [r[1:] for r in ranked] == order


def test_draws_of_empty_tables(odd, target):
    assert importance.resample(odd.limit(0), target).collect() == []
    assert importance.resample(odd, target.limit(0)).count() == len(ODD)


def test_ranks_go_on_over_partitions(spark):
    """Many equal scores, among them one document's repeated rows."""
    rows = spark.range(2000).select((F.col("id") % 7).alias("doc_id"), (F.col("id") % 3).alias("score"), F.col("id").alias("row")).repartition(5)
    got = sorted((r["rank"], -r["score"], r["doc_id"], r["row"]) for r in importance._ranked(rows).collect())
    assert [g[0] for g in got] == list(range(1, 2001)) and [g[1:] for g in got] == sorted(g[1:] for g in got)


def audited(rows, min_docs, top):
    """lang, source, part, item, value and rank in plain Python."""
    docs = [(lang or "", source or "", TERM.findall(lowered(text))) for _, text, lang, source in rows]
    out = []
    for lang in {d[0] for d in docs}:
        mine = [d for d in docs if d[0] == lang]
        seen = Counter(t for d in mine for t in set(d[2]))
        kept = {t for t, n in seen.items() if n >= min_docs}
        whole = Counter(t for d in mine for t in d[2] if t in kept)
        groups = {s: Counter(t for d in mine if d[1] == s for t in d[2] if t in kept) for s in {d[1] for d in mine}}
        share = lambda c, t: 1 + 1_000_000_000 * (c[t] + 1) // (sum(c.values()) + len(kept))  # noqa: E731, B023
        f = lambda p, q: (p - q) ** 2 // q
        for s, c in groups.items():
            pairs = [(o, sum(f(share(c, t), share(groups[o], t)) for t in kept)) for o in groups if o != s]
            terms = [(t, f(share(c, t), share(whole, t))) for t in c if share(c, t) > share(whole, t)]
            for part, items, most in (("pair", pairs, len(pairs)), ("term", terms, top)):
                out += [(lang, s, part, i, v, k + 1) for k, (i, v) in enumerate(sorted(items, key=lambda x: (-x[1], x[0].encode()))[:most])]
    return sorted(out)


@pytest.mark.parametrize(("min_docs", "top"), [(3, 200), (1, 200), (1, 2), (99, 5)])
def test_an_audit_against_plain_python(odd, min_docs, top):
    assert sorted(map(tuple, divergence.audit(odd, min_docs=min_docs, top=top).collect())) == audited(ODD, min_docs, top)


def test_audits_in_many_blocks(odd, monkeypatch):
    monkeypatch.setattr(divergence, "BLOCK", 7)
    monkeypatch.setattr(divergence, "_CELLS", 5)
    assert sorted(map(tuple, divergence.audit(odd, min_docs=1).collect())) == audited(ODD, 1, 200)
    assert divergence.audit(odd.limit(0)).collect() == []


def test_terms_of_all_lengths():
    r = random.Random(5)
    texts = [" ".join(r.choice("abé日") * r.randrange(1, 40) + r.choice(["", "b", "Z"]) for _ in range(400)) for _ in range(30)]
    groups = np.sort(np.array([r.randrange(4) for _ in texts]))
    found = defaultdict(lambda: [0, 0])
    for group, term, n, documents in divergence.count_terms([t.encode() for t in texts], groups):
        for g, t, a, b in zip(group.tolist(), term.to_pylist(), n.tolist(), documents.tolist(), strict=True):
            found[g, t][0] += a
            found[g, t][1] += b
    expected = defaultdict(lambda: [0, 0])
    for g, text in zip(groups.tolist(), texts, strict=True):
        words = TERM.findall(lowered(text))
        for t, n in Counter(words).items():
            expected[g, t][0] += n
            expected[g, t][1] += 1
    assert dict(found) == dict(expected)


@pytest.mark.parametrize("name", ["op11_importance", "op12_divergence"])
def test_queries_against_sql(spark, same_rows, name):
    same_rows(queries.QUERIES[name](spark, DATA), queries.ORACLE_SQL[name])


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(queries.WORDS)


HARD = ["", " ", "a", "It's the dogs' 'sun' they've '' ''s x'll--'s don't'd", "<|endoftext|> a<|startoftext|>b <|", "İstanbul ŒUVRE ÀÉÎõü÷×ß ª² ́é Ω ΟΔΟΣ", "tab\tand\x0bmore\x1cx\x85y z", "\x00a \x00 a\x00 a", "日本語 😀😀 Привет", "12345 ¼ ٣ _a_b__", "x" * 500 + "é" * 300,
    "\r\n\r\n a \n\n b", "İ", "<", "|", "<|", "a<|b", "aaaaaaaaaaaaaaaaaaaaaa bbbbbbbbbbbbb", "ſ ŉ ǰ Ǆ ȺȾ"]


def test_ids_are_the_library_s(tokenizer):
    r = random.Random(7)
    made = ["".join(r.choice("abcdefghijklmnopqrstuvwxyzABCÀÉäöüßñçœŠž'.,;:-_!?0123456789 \n") for _ in range(r.randrange(200))) for _ in range(400)]
    texts = HARD + made
    encode = packing.Encoder(queries.WORDS)
    assert encode.merges is not None
    for _ in range(2):  # the second time from memory
        ids, ends = encode([t.encode() for t in texts])
        starts = [0, *ends[:-1].tolist()]
        for t, a, b in zip(texts, starts, ends.tolist(), strict=True):
            assert ids[a:b].tolist() == [*tokenizer.encode(t, add_special_tokens=False).ids, packing.END_ID], t
    encode.merges = None  # a tokenizer of other rules
    encode.forget()
    again, _ = encode([t.encode() for t in texts])
    assert np.array_equal(ids, again)


def test_other_tokenizer_files_are_left_to_the_library(tmp_path):
    import json

    with open(queries.WORDS, encoding="utf-8") as f:
        file = json.load(f)
    file["normalizer"] = None
    (tmp_path / "other.json").write_text(json.dumps(file))
    assert packing.Merges.of(str(tmp_path / "other.json")) is None


@pytest.mark.parametrize("most", [1, 2, 7, 1000])
def test_best_fit_against_a_list_of_open_sequences(most):
    r = random.Random(most)
    lengths = [r.choice([1, 3, 30, 50, 99, 100]) if r.random() < 0.5 else r.randrange(1, 101) for _ in range(3000)]
    packer, closed = packing.BestFit(100, most), []
    opened, expected = [], []  # naive: [free, pieces]
    for k, n in enumerate(lengths):
        closed += [[p for p, _ in b.pieces] for b in packer.add(n, k)]
        fits = [b for b in opened if b[0] >= n]
        if fits:
            best = min(b[0] for b in fits)
            target = [b for b in opened if b[0] == best][-1]
            opened.remove(target)
        else:
            if n < 100 and len(opened) == most:
                full = min(b[0] for b in opened)
                gone = [b for b in opened if b[0] == full][-1]
                opened.remove(gone)
                expected.append(gone[1])
            target = [100, []]
        target[0] -= n
        target[1].append(k)
        (opened if target[0] else expected).append(target if target[0] else target[1])
        assert packer.n_open == len(opened) <= most
    assert closed == expected
    assert sorted(map(sorted, ([p for p, _ in b.pieces] for b in packer.rest()))) == sorted(sorted(b[1]) for b in opened)


def laid_out(rows, capacity):
    by = defaultdict(list)
    for r in rows:
        by[r["sequence_id"]].append((r["offset"], r["length"]))
    for places in by.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by)


def test_op13(spark, tokenizer):
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    rows = queries.op13_best_fit(spark, DATA).collect()
    by = defaultdict(list)
    for r in rows:
        by[r["doc_id"]].append(r)
    assert set(by) == set(texts)
    for i, text in texts.items():
        ids = [*tokenizer.encode(text, add_special_tokens=False).ids, 1]
        expected = [(k, a, len(x), zlib.crc32(np.array(x, "<u4").tobytes())) for k, (a, x) in enumerate((a, ids[a : a + 4096]) for a in range(0, len(ids), 4096))]
        assert sorted((r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in by[i]) == expected
    total = sum(r["length"] for r in rows)
    assert laid_out(rows, 4096) <= math.ceil(total / 4096 * 1.05) + 1


@pytest.mark.parametrize(("capacity", "most"), [(16, 1), (16, 3), (64, 8)])
def test_rounds_of_packing(spark, odd, tokenizer, capacity, most):
    """Several rounds, long documents and odd rows; sequences have their pieces' ids."""
    packed = packing.pack(odd.unionByName(odd).repartition(6), queries.WORDS, capacity=capacity, most_open=most, keep_ids=True)
    rows = packed.collect()
    ids = sorted(tuple([*tokenizer.encode(t or "", add_special_tokens=False).ids, 1]) for _, t, *_ in ODD * 2)
    by = defaultdict(list)
    for r in sorted(rows, key=lambda r: r["start"]):
        assert r["length"] == len(r["ids"]) and r["start"] == r["piece"] * capacity and r["ids_crc32"] == zlib.crc32(np.array(r["ids"], "<u4").tobytes())
        by[r["doc_id"]].append(r)
    assert sum(len(x) for x in ids) == sum(r["length"] for r in rows)
    for i in (None, 3, 6):
        whole = tuple([*tokenizer.encode(next(t for d, t, *_ in ODD if d == i) or "", add_special_tokens=False).ids, 1])
        for start in range(0, len(whole), capacity):
            assert [tuple(r["ids"]) for r in by[i] if r["start"] == start] == [whole[start : start + capacity]] * 2
    n = laid_out(rows, capacity)
    made = packing.sequences(packed).collect()
    assert len(made) == n and sorted(x for r in made for x in r["ids"]) == sorted(x for t in ids for x in t)
    assert packing.pack(odd.limit(0), queries.WORDS).collect() == []
