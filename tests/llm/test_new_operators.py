"""Best-fit packing, periodic runs and phrase collocations against brute force, on nulls, empty and long texts, ties,
repeated rows, an empty table and clashing columns."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from paylume.llm import bin_packing, collocations, jaccard_join, licenses, periodic_runs, queries, substring_dedup, textkit

from ..conftest import SMALL
from .test_operators import LONG, TEXTS, WORD

SCHEMA = "doc_id long, text string, lang string, source string, n long, length int, runs string, rank int"


@pytest.fixture(scope="module")
def docs(spark):
    texts = [*TEXTS, LONG]
    rows = [(None if i == 3 else i, t, ["en", "de", None][i % 3], "s", 5, 6, "x", 7) for i, t in enumerate(texts)]
    return spark.createDataFrame([*rows, rows[8], rows[3]], SCHEMA)


# best-fit packing


def fewest(items, size):
    items, best = sorted(items, reverse=True), [len(items)]

    def go(i, bins):
        if len(bins) >= best[0]:
            return
        if i == len(items):
            best[0] = len(bins)
            return
        tried = set()
        for k, used in enumerate(bins):
            if used + items[i] <= size and used not in tried:
                tried.add(used)
                bins[k] += items[i]
                go(i + 1, bins)
                bins[k] -= items[i]
        go(i + 1, [*bins, items[i]])

    go(0, [])
    return best[0]


def test_reduction_keeps_the_optimum():
    rng = random.Random(4)
    above = fixed = 0
    for _ in range(400):
        size = rng.randint(5, 30)
        items = [rng.randint(1, size) for _ in range(rng.randint(1, 9))]
        instance = bin_packing.Instance(dict(Counter(items)), size)
        instance.reduce()
        rest = [s for s, n in instance.left.items() for _ in range(n)]
        optimum = fewest(items, size)
        assert sum(t for t, _ in instance.fixed) + (fewest(rest, size) if rest else 0) == optimum
        fixed += len(instance.fixed)
        patterns = bin_packing.solve(dict(Counter(items)), size)
        assert all(sum(s * k for s, k in content) <= size for _, content in patterns)
        held = Counter()
        for times, content in patterns:
            held.update({s: k * times for s, k in content})
        assert held == Counter(items)
        above += sum(t for t, _ in patterns) > optimum
    assert fixed > 400 and above < 10


def test_solution_is_bounded_by_the_size():
    count = {s: 10**9 + s * 7919 for s in range(1, 257)}
    patterns = bin_packing.solve(count, 256)
    assert len(patterns) <= 4 * 256
    used, total = sum(t for t, _ in patterns), sum(s * n for s, n in count.items())
    assert total <= 256 * used <= 1.01 * total
    with pytest.raises(ValueError):
        bin_packing.solve({257: 1}, 256)


@pytest.mark.parametrize("size", [16, 1024])
def test_best_fit_packing(docs, size):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    encode = Tokenizer.from_file(path).encode
    rows = bin_packing.pack(docs.repartition(3), path, size).collect()
    want = Counter()
    for r in docs.collect():
        ids = [*encode(r["text"] or "", add_special_tokens=False).ids, 2]
        first = len(ids) % size or size
        for piece, start in enumerate([0, *range(first, len(ids), size)]):
            part = np.array(ids[start : start + (size if piece else first)], "<u4").tobytes()
            want[r["doc_id"], piece, start, len(part) // 4, zlib.crc32(part), part] += 1
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"], bytes(r["ids"])) for r in rows) == want
    by = {}
    for r in rows:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for pieces in by.values():
        pieces.sort()
        assert [o for o, _ in pieces] == np.cumsum([0, *(n for _, n in pieces[:-1])]).tolist() and sum(n for _, n in pieces) <= size
    assert len(by) <= -(-sum(r["length"] for r in rows) // size) + 2
    assert bin_packing.pack(docs.limit(0), path, size).count() == 0
    assert "ids" not in bin_packing.pack(docs, path, size, ids=False).columns


# periodic runs


def runs(w, least, times):
    out = set()
    for q in range(1, len(w) // times + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            end = j + q
            if j > i and end - i >= max(least, times * q) and not any(w[i : end - p] == w[i + p : end] for p in range(1, q)):
                out.add((i, end - i, q))
            i = j + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def test_runs_of_words_that_repeat():
    rng = random.Random(2)
    for _ in range(300):
        texts = []
        for _ in range(rng.randint(0, 4)):
            w = []
            while rng.random() < 0.8 and len(w) < 60:
                w += [rng.randint(0, rng.choice([1, 2, 5])) for _ in range(rng.randint(1, 6))] * rng.randint(1, 6)
            texts.append(w)
        least, times = rng.choice([(24, 3), (6, 3), (4, 2), (2, 2), (9, 4)])
        of = np.r_[0, np.cumsum([len(x) for x in texts])].astype(np.int64)
        got = periodic_runs.runs_of(np.array([x for w in texts for x in w], np.int64), of, least, times)
        assert got == [runs(w, least, times) for w in texts]


def collapsed(w, found):
    gone = {i for s, n, q in found for i in range(s + q, s + n)}
    return [x for i, x in enumerate(w) if i not in gone]


def test_find_runs(spark, docs):
    more = spark.createDataFrame([(90, "a b c " * 12 + "a b", None, None, 0, 0, "", 0), (91, ("x y " * 14 + "z z \t") * 3, "en", "", 0, 0, "", 0), (92, "w " * 20000, "en", "", 0, 0, "", 0)], SCHEMA)
    table = docs.unionByName(more)
    want = Counter()
    for r in table.collect():
        w = WORD.findall(r["text"] or "")
        found = runs(w, 24, 3) if len(w) < 5000 else [(0, len(w), 1)]
        want[r["doc_id"], len(w), tuple(found), " ".join(collapsed(w, found))] += 1
    got = periodic_runs.find_runs(table).collect()
    assert Counter((r["doc_id"], r["n_words"], tuple((x["start"], x["length"], x["period"]) for x in r["runs"]), r["collapsed"]) for r in got) == want
    assert all(r["n_dropped"] == r["n_words"] - len(WORD.findall(r["collapsed"])) for r in got)
    assert periodic_runs.find_runs(docs.limit(0)).count() == 0
    with pytest.raises(ValueError):
        periodic_runs.find_runs(docs, 24, 1)


def test_periodic_query_against_brute_force(spark):
    from fractions import Fraction

    got = {r["doc_id"]: r for r in queries.QUERIES["op12_periodic_runs"](spark, SMALL).collect()}
    some = 0
    for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect():
        w, h = WORD.findall(r["text"] or ""), zlib.crc32(str(r["doc_id"]).encode())
        g, n = h // 10, len(w)
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [x if i < a else w[a + (i - a) % p] for i, x in enumerate(w)]
        found = runs(w, 24, 3)
        best = max(found, key=lambda x: (Fraction(x[1], x[2]), -x[0], -x[2]), default=(None, None, None))
        some += bool(found)
        row = got[r["doc_id"]]
        assert (row["n_runs"], row["start"], row["length"], row["period"]) == (len(found), *best)
        assert row["exponent_milli"] == (None if best[0] is None else 1000 * best[1] // best[2])
        assert row["runs_sha256"] == hashlib.sha256("".join(f"{s},{n},{q}\n" for s, n, q in found).encode()).hexdigest()
        assert row["collapsed_sha256"] == hashlib.sha256(" ".join(collapsed(w, found)).encode()).hexdigest()
    assert some > 5


def test_planting_leaves_null_and_empty_texts(spark):
    df = spark.createDataFrame([(i, t) for i in range(40) for t in (None, "", " \n")] + [(None, "a b")], "doc_id long, text string")
    got = df.select("text", periodic_runs.with_planted_period(df.doc_id, df.text).alias("t")).collect()
    assert all(r["text"] == r["t"] for r in got)


# collocations


def phrases(rows, support, top, longest=4):
    """The contract, word by word."""
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    size, count = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\n-\r]", (text or "").translate(low)):
            w = re.findall(r"[^\x20\x09]+", piece)
            size[lang] += len(w)
            for k in range(1, longest + 1):
                count.update((lang, tuple(w[i : i + k])) for i in range(len(w) - k + 1))
    out = {}
    good = {x: a for x, a in count.items() if len(x[1]) > 1 and a >= support}
    for (lang, p), a in good.items():
        if any(x[0] == lang and len(x[1]) > len(p) and 100 * c >= 80 * a and any(x[1][i : i + len(p)] == p for i in range(len(x[1]))) for x, c in good.items()):
            continue
        cuts = [(2000000 * a // (count[lang, p[:k]] + count[lang, p[k:]]), k) for k in range(1, len(p))]
        score, k = min(cuts)
        out.setdefault(lang, []).append((-score, -a, " ".join(p).encode(), count[lang, p[:k]], count[lang, p[k:]], size[lang]))
    return sorted((lang, i + 1, p.decode(), -a, left, right, n, -score) for lang, found in out.items() for i, (score, a, p, left, right, n) in enumerate(sorted(found)[:top]))


@pytest.mark.parametrize(("support", "shards", "top", "longest"), [(3, 1, 2000, 4), (3, 8, 2000, 4), (5, 2, 7, 3), (2, 30, 50, 5), (4, 3, 2000, 2)])
def test_collocations(spark, docs, support, shards, top, longest):
    rng = random.Random(9)
    texts = [" ".join(rng.choice("Red green, blue. old\tnew house tree ÄRGER ärger x-y 'q' !sky".split(" ")) for _ in range(rng.randint(0, 90))) for _ in range(60)]
    table = docs.drop("source").unionByName(spark.createDataFrame([(i, t, "en" if i % 4 else "fr", 1, 1, "", 1) for i, t in enumerate(texts)], SCHEMA.replace("source string, ", ""))).repartition(7)
    got = collocations.collocations(table, support, longest, shards, top).collect()
    want = phrases([(r["lang"], r["text"]) for r in table.collect()], support, top, longest)
    assert sorted(tuple(r) for r in got) == want and len(want) > 5


def test_collocations_with_a_full_filter(docs, monkeypatch):
    """False answers of the filter only add candidates."""
    want = sorted(tuple(r) for r in collocations.collocations(docs, 3).collect())
    monkeypatch.setattr(collocations.Filter, "has", lambda self, hashes: np.ones(len(hashes), bool))
    assert sorted(tuple(r) for r in collocations.collocations(docs, 3).collect()) == want and want


def test_collocations_of_nothing(docs):
    assert collocations.collocations(docs.limit(0)).count() == 0
    with pytest.raises(ValueError):
        collocations.collocations(docs, shards=0)


def test_scores_beyond_64_bits(spark):
    words = spark.createDataFrame([("en", "a", 9 * 10**18), ("en", "b", 9 * 10**18)], "lang string, phrase string, n long")
    pair = spark.createDataFrame([("en", "a b", 2, 8 * 10**18)], "lang string, phrase string, k int, n long")
    rows = collocations.scored(words.where("phrase = 'a'").unionByName(words.where("phrase = 'b'")).withColumn("n", words.n), pair).select("a", "l", "r", "score")
    assert [tuple(r) for r in rows.collect()] == [(8 * 10**18, 9 * 10**18, 9 * 10**18, 2000000 * 8 // 18)]


# hashes


def morse(n, a, b):
    return "".join(a if bin(i).count("1") % 2 else b for i in range(n))


@pytest.mark.parametrize("n", [1024, 4096])
def test_words_of_two_letters_in_morse_order_differ(spark, n):
    """Any polynomial modulo 2**64 gives these two words, and these two texts of bytes or words, one hash."""
    one, two = morse(n, "a", "b"), morse(n, "b", "a")
    data = np.frombuffer((one + two).encode(), np.uint8)
    at = np.array([0, n])
    for which in (0, 1):
        assert len(set(textkit.word_hashes(data, at, at + n, which).tolist())) == 2
        assert len(set(textkit.range_hash(textkit.prefix_sums(data.astype(np.uint64), which), at, at + n, which).tolist())) == 2
    tail = " ".join(f"t{i}" for i in range(12))
    df = spark.createDataFrame([(1, f"{one} {tail}"), (2, f"{two} {tail}"), (3, one), (4, two)], "doc_id long, text string")
    assert {r["doc_id"]: r["n_removed"] for r in substring_dedup.remove_repeats(df).collect()} == {1: 0, 2: 0, 3: 0, 4: 0}
    assert {r["doc_id"]: r["component_id"] for r in jaccard_join.classes(df).collect()} == {1: 1, 2: 2, 3: 3, 4: 4}


def test_products_modulo_the_prime():
    rng = random.Random(1)
    p = int(textkit.PRIME)
    a, b = ([rng.choice([0, 1, p - 1, rng.randrange(p)]) for _ in range(500)] for _ in range(2))
    assert textkit.product(np.array(a, np.uint64), np.array(b, np.uint64)).tolist() == [x * y % p for x, y in zip(a, b, strict=True)]
    values = [rng.randrange(1 << 64) for _ in range(3000)]
    assert int(textkit.prefix_sums(np.array(values, np.uint64), 1)[-1]) == sum(x * pow(textkit._BASE[1], i, p) for i, x in enumerate(values)) % p


# licences


def test_notices_with_any_line_ends_and_by_size(spark):
    name, text = max(licenses.TEMPLATES.items(), key=lambda x: len(x[1]))
    words = text.split()
    lines = [" ".join(words[i : i + 8]) for i in range(0, len(words), 8)]
    rows = [(0, "\n".join(lines)), (1, "\r\n".join(["intro", "", *lines, "", "\r", "rest"])), (2, "\n\n".join(lines)), (3, None), (4, "\r\n\r\n")]
    got = {r["doc_id"]: r["found"] for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [(x["template"], x["dice"]) for x in got[0]] == [(x["template"], x["dice"]) for x in got[1]] and (name, 1.0) in [(x["template"], x["dice"]) for x in got[0]]
    assert not any(x["dice"] == 1.0 and x["template"] == name for x in got[2]) and got[3] == got[4] == []
    known = licenses.Templates(licenses.TEMPLATES, 0.8)
    rng = random.Random(5)
    for _ in range(300):
        own = " ".join(w for w in rng.choice(list(licenses.TEMPLATES.values())).split() if rng.random() < rng.choice([0.8, 0.95, 1])).encode()
        a = licenses.bigrams(own)
        dice = [(-2 * len(a & b) / (len(a) + len(b)), n) for n, t in licenses.TEMPLATES.items() if (b := licenses.bigrams(t.encode()))]
        best = min(dice)
        assert known.best(own) == ((best[1], -best[0]) if -best[0] >= 0.8 else None)
