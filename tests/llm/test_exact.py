"""Operators that SQL can't express, against brute force or the library."""

import random
import re
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from loomtale.llm import decontam, host_quality, near_dedup, phrase_dedup, sp_codec, token_counts

PIECES = public_tokenizers.path("piece_bpe_32k.model")
DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text")


def strings(n, seed=1):
    rng = random.Random(seed)
    parts = ["a", "b", " ", "  ", "\n", "the", "ing", "é", "😀", "▁", "ß", "tion", "\t", "x" * 90, "<s>", "<0x0A>", "　"]
    return ["".join(rng.choice(parts) for _ in range(rng.randint(0, 40))) for _ in range(n)]


def test_agenda_is_the_library():
    model = sp_codec.model(PIECES)
    texts = ["", " ", "  ", "\n", "▁x", "ab" * 300, " " * 70, *strings(2000)]
    assert model.encode(texts, False) == model.lib.encode(texts)
    assert model.encode(["a b"], True) == [[*model.lib.encode("a b"), 2]]


def test_heap_and_rounds_agree():
    model = sp_codec.model(PIECES)
    units = [u.replace(" ", "▁") for t in strings(300, 2) for u in sp_codec.UNITS.findall(" " + t)]
    assert [model._ids(model._heap(u)) for u in units] == model.agenda(units)


def test_encode_and_count(docs):
    lib = sp_codec.model(PIECES).lib
    for r in token_counts.count_tokens(sp_codec.encode_decode(docs, PIECES), PIECES).collect():
        expected = lib.encode(r["text"])
        assert list(r["ids"]) == [*expected, 2] and r["n_tokens"] == len(expected) and r["decoded"] == lib.decode([*expected, 2])


def test_base_rules(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    word = re.compile(r"[^\x20\x09-\x0d]+")
    for r in host_quality.judge(docs).collect():
        w = word.findall(r["text"])
        lines = [x for x in r["text"].split("\n") if word.search(x)]
        places = {}
        for k in range(len(w) - 7):
            places.setdefault(tuple(w[k : k + 8]), []).append(k)
        repeated = {i for v in places.values() if len(v) > 1 for k in v for i in range(k, k + 8)}
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == (
            len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", r["text"])), len(lines) - len(set(lines)), len(repeated),
        )
        assert r["base_failed"] == (len(w) < 20 or 100 * len(repeated) > 30 * len(w))
        assert not (r["base_failed"] and r["kept"])


def test_host_verdicts(spark):
    rows = [(f"h{k}", k * 50 + i, " ".join(f"w{i}x{j}" for j in range(30)) if i >= (48 if k == 0 else 2) else "few") for k in range(6) for i in range(50)]
    out = host_quality.judge(spark.createDataFrame(rows, "source string, doc_id long, text string")).groupBy("source").agg({"kept": "max", "host_rate": "max"}).collect()
    kept = {r["source"]: r["max(kept)"] for r in out}
    assert kept == {"h0": False, "h1": True, "h2": True, "h3": True, "h4": True, "h5": True}
    rate = {r["source"]: r["max(host_rate)"] for r in out}
    assert rate["h1"] > 2 / 50 and rate["h0"] < 48 / 50  # shrunk towards the others


@pytest.mark.parametrize("max_windows", [1_000_000, 300])
def test_decontamination(spark, docs, max_windows):
    items = spark.read.parquet(f"{DATA}/benchmark.parquet")
    extra = spark.createDataFrame([(900, "Thé three-words"), (901, "")], "item_id long, text string")
    more = spark.createDataFrame([(5000, "so THé three, words ran"), (5001, "thé three"), (5002, None)], "doc_id long, text string")
    items, docs = items.unionByName(extra), docs.unionByName(more)
    lower = lambda s: re.sub("[A-Z]", lambda m: m[0].lower(), s)
    find = lambda t: re.findall(decontam.WORD, lower(t or ""))
    windows = {}
    for i in items.collect():
        w = find(i["text"])
        width = min(10, len(w))
        for k in range(len(w) - width + 1 if width else 0):
            windows.setdefault(tuple(w[k : k + width]), set()).add(str(i["item_id"]))
    widths = {len(k) for k in windows}
    hit = 0
    for r in decontam.decontaminate(docs, items, max_windows=max_windows, cleaned="cleaned").collect():
        w = find(r["text"])
        at, found = set(), set()
        for n in widths:
            for k in range(len(w) - n + 1):
                if x := windows.get(tuple(w[k : k + n])):
                    found |= x
                    at.update(range(k, k + n))
        hit += bool(at)
        assert (r["n_words"], r["n_hit"], r["hit_items"]) == (len(w), len(at), sorted(found))
        assert find(r["cleaned"]) == [x for k, x in enumerate(w) if k not in at]
    assert hit > 1


def corpus(seed):
    rng = random.Random(seed)
    base = ["".join(rng.choice("abcdé \n") for _ in range(rng.randint(50, 400))) for _ in range(12)]
    piece = lambda: rng.choice(base)[rng.randint(0, 40) : rng.randint(41, 400)] if rng.random() < 0.6 else "".join(rng.choice("abcdé ") for _ in range(rng.randint(0, 120)))
    rows = [(i, "".join(piece() for _ in range(rng.randint(0, 6)))) for i in range(150)]
    return rows + [(300, "a" * 900), (301, "ab" * 300), (302, ""), (303, "x" * 99), (304, "a" * 100)]


@pytest.mark.parametrize(("width", "gram", "part"), [(100, 32, 1 << 19), (20, 7, 1 << 19), (30, 9, 200)])
def test_phrase_dedup(spark, monkeypatch, width, gram, part):
    monkeypatch.setattr(phrase_dedup, "PART", part)  # small parts cut documents into pieces
    rows = corpus(width)
    seen, expected = set(), {}
    for i, t in sorted(rows):
        b = t.encode()
        gone = bytearray(len(b))
        for p in range(len(b) - width + 1):
            s = b[p : p + width]
            if s in seen:
                gone[p : p + width] = b"\1" * width
            seen.add(s)
        expected[i] = bytes(x for x, g in zip(b, gone, strict=True) if not g)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert {r["doc_id"]: bytes(r["kept"]) for r in phrase_dedup.drop_repeats(df, width=width, gram=gram).collect()} == expected


def test_kept_text_has_whole_characters(spark):
    shared = "é" * 60
    df = spark.createDataFrame([(1, "x" + shared), (2, "yy" + shared + "z")], "doc_id long, text string")
    out = {r["doc_id"]: r["kept"] for r in phrase_dedup.drop_repeats(df, kept_text=True).collect()}
    assert out[1].startswith("xé") and out[2] == "yyz"


@pytest.mark.parametrize("crowd", [0, 3_000])
def test_phrases_of_crowded_triggers(spark, monkeypatch, crowd):
    """Suffixes that Spark sorts, and those that tasks sort, give the same."""
    rows = corpus(7)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    kept = lambda: {r["doc_id"]: bytes(r["kept"]) for r in phrase_dedup.drop_repeats(df, width=20, gram=7).collect()}
    expected = kept()
    monkeypatch.setattr(phrase_dedup, "CROWD", crowd)
    assert kept() == expected


def test_suffix_array():
    rng = random.Random(3)
    data = np.frombuffer(bytes(rng.choice(b"ab\0") for _ in range(3000)), np.uint8)
    for width in (8, 11, 16, 30):
        start = np.array(rng.sample(range(3000 - width), 1500))
        group = np.array([rng.randint(0, 3) for _ in start])
        rank = phrase_dedup.equal_suffixes(data, start, group, width)
        key = [(g, data[s : s + width].tobytes()) for g, s in zip(group.tolist(), start.tolist())]
        counts = Counter(key)
        assert [r >= 0 for r in rank.tolist()] == [counts[k] > 1 for k in key]
        order = sorted(key)
        assert all(r < 0 or order.index(k) == r for k, r in zip(key, rank.tolist()))


def weighted(text):
    w = re.findall(decontam.WORD, re.sub("[A-Z]", lambda m: m[0].lower(), text))
    n = min(5, len(w))
    return Counter(tuple(w[i : i + n]) for i in range(len(w) - n + 1)) if n else Counter()


def jaccard(a, b):
    return sum(1 / sum(max(a[y] / a[x], b[y] / b[x]) for y in a.keys() | b.keys()) for x in a.keys() & b.keys())


def test_probability_jaccard():
    rng = random.Random(5)
    for _ in range(30):
        a, b = ([" ".join(rng.choice("pqr") for _ in range(30))] for _ in range(2))
        sets = []
        for t in (a, b):
            _, h, w, _ = near_dedup.shingles([t[0].encode()])
            sets.append((h, w.astype(float)))
        assert near_dedup.probability_jaccard(*sets) == pytest.approx(jaccard(weighted(a[0]), weighted(b[0])))


def test_sketch_estimates():
    words = [f"w{i}" for i in range(300)]
    texts = [" ".join(words), " ".join(words[:270] + [f"x{i}" for i in range(30)])]
    doc, h, w, _ = near_dedup.shingles([t.encode() for t in texts])
    s = near_dedup.sketch(doc, h, w, 2)
    assert abs((s[0] == s[1]).mean() - jaccard(weighted(texts[0]), weighted(texts[1]))) < 0.15


def test_near_duplicates(docs):
    rows = near_dedup.near_duplicates(docs).collect()
    sets = {r["doc_id"]: weighted(r["text"]) for r in rows}
    parent = {i: i for i in sets}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ids = sorted(sets)
    for k, j in enumerate(ids):
        for i in ids[:k]:
            a, b = sets[i], sets[j]
            if 2 * len(a.keys() & b.keys()) >= max(len(a), len(b), 1) and jaccard(a, b) >= 0.8 - near_dedup.NEAR:
                parent[max(find(i), find(j))] = min(find(i), find(j))
    assert {r["doc_id"]: r["class_id"] for r in rows} == {i: find(i) for i in ids}
    assert sum(r["first"] for r in rows) == len({find(i) for i in ids})


def test_rows_of_a_mixed_bucket_and_its_links(spark):
    """Every second node outside the pivot's class: few rows more than nodes, and links found across all tiles."""
    def rest(n):
        node = F.struct(F.col("id"), F.lit(0).cast("long").alias("k"))
        nodes = spark.range(n).select(node.alias("node"), F.lit(5000).cast("long").alias("bytes"))
        home = F.struct(F.lit(0).cast("long").alias("id"), F.lit(0).cast("long").alias("k"))
        starred = nodes.select(F.lit(1).cast("long").alias("bucket"), "node", F.lit(n).cast("long").alias("n"), home.alias("pivot"))
        classes = nodes.where("node.id % 2 = 0 and node.id > 0").select("node", home.alias("class"))
        return near_dedup._rest_blocks(starred, classes, nodes)

    few, many = rest(2000).count(), rest(8000).count()
    assert few <= 3000 and many < 6 * few
    made = rest(8000).groupBy("block").agg(F.count_if("left").alias("l"), F.count_if(~F.col("left")).alias("r")).collect()
    assert sum(r["l"] * r["r"] for r in made) == 4000 * 8000
    sets = [np.arange(20 * (i % 7), 20 * (i % 7) + 20, dtype=np.uint64).tobytes() for i in range(2800)]
    rows = [(left, (i, 0), sets[i], None) for left in (True, False) for i in range(2800)]
    links = list(near_dedup._joined(iter(rows)))
    assert len(links) == 2800 - 7 and all(a[0] % 7 == b[0] % 7 for a, b in links)
