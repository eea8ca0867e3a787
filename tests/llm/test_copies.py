import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from llm import decontam, graph, near_dup, suffix_array, suffix_dedup
from tests_llm_words import words


def test_suffix_arrays_and_common_prefixes_equal_sorting():
    rng = np.random.default_rng(1)
    for n in [*range(1, 40), 200, 600]:
        for kinds in (1, 2, 3, 200):
            text = np.append(rng.integers(1, kinds + 1, n - 1), 0).astype(np.uint16)
            if n > 100:
                text[n // 2 : n // 2 + n // 4] = text[: n // 4]
            array, want = suffix_array.suffix_array(text), sorted(range(n), key=lambda i: tuple(text[i:]))
            assert array.tolist() == want
            shared = suffix_array.permuted_common_prefixes(text, array)
            for a, b in zip(want, want[1:], strict=False):
                x, y = text[a:].tolist(), text[b:].tolist()
                assert shared[b] == next(k for k in range(len(x) + 1) if k >= min(len(x), len(y)) or x[k] != y[k])


def without_repeats(texts, length):
    data = [(t or "").encode() for t in texts]
    seen = Counter(d[p : p + length] for d in data for p in range(len(d) - length + 1))
    out = []
    for d in data:
        gone = bytearray(len(d))
        for p in range(len(d) - length + 1):
            if seen[d[p : p + length]] > 1:
                gone[p : p + length] = b"\1" * length
        runs = [(k, k + next((j for j, g in enumerate(gone[k:]) if not g), len(d) - k)) for k in range(len(d)) if gone[k] and (k == 0 or not gone[k - 1])]
        out.append((len(d), bytes(c for c, g in zip(d, gone, strict=True) if not g), runs))
    return out


@pytest.mark.parametrize("contents", [2000, 2])
def test_repeats_equal_brute_force(spark, monkeypatch, contents):
    monkeypatch.setattr(suffix_dedup, "CONTENTS", contents)
    rng = random.Random(4)
    passages = [words(k, 60) for k in range(4)]
    texts = [rng.choice(["", "é" * 30, "ab" * 200]) + words(100 + k, rng.randint(0, 40)) + rng.choice(passages)[rng.randint(0, 40) :] + rng.choice(["", words(200 + k, 30), passages[0]]) for k in range(60)]
    texts += [texts[0], texts[0], None, "", "x" * 1000, words(1, 20)]
    frame = spark.createDataFrame([(k % 50, t, "x") for k, t in enumerate(texts)], "doc_id int, text string, key string").repartition(5)
    got = Counter((r["n_bytes"], bytes(r["kept"]), tuple((s["start"], s["end"]) for s in r["removed"])) for r in suffix_dedup.remove(frame, length=80, anchor=40).collect())
    assert got == Counter((n, kept, tuple(runs)) for n, kept, runs in without_repeats(texts, 80)) and sum(n - len(k) for n, k, _ in got) > 5000


def test_very_long_texts_are_cut_into_pieces(monkeypatch):
    monkeypatch.setattr(suffix_dedup, "_PIECE", 1000)
    data = words(9, 3000).encode()
    first, last, place, mark, whole = suffix_dedup.all_stretches(data, 80, 40)
    covered = [p for a, b in zip(first.tolist(), last.tolist(), strict=True) for p in range(a, b + 1)]
    assert covered == list(range(len(data) - 79)) and all(a <= p <= b + 40 for a, p, b in zip(first, place, last, strict=True))


def test_repeats_of_odd_rows(odd, none):
    rows = suffix_dedup.remove(odd).collect()
    assert len(rows) == odd.count()
    by_id = {r["doc_id"]: r for r in rows if r["doc_id"]}
    assert len(by_id[1]["kept"]) == 0 and by_id[4]["n_bytes"] == 0 and by_id[7]["n_bytes"] == len(by_id[7]["kept"])
    assert suffix_dedup.remove(none).count() == 0


def sets_of(text, n):
    own = [w for w in (text or "").encode().lower().split()]
    return frozenset(tuple(own[k : k + n]) for k in range(len(own) - n + 1)) if len(own) >= n else frozenset([tuple(own)] if own else [])


def expected_groups(rows, n):
    sets = [(k, sets_of(t, n)) for k, t in rows]
    parent = list(range(len(sets)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, (_, a) in enumerate(sets):
        for j, (_, b) in enumerate(sets[:i]):
            if a and b and 100 * len(a & b) >= 80 * len(a | b):
                parent[find(i)] = find(j)
    least = defaultdict(lambda: None)
    for i, (k, _) in enumerate(sets):
        if k is not None:
            least[find(i)] = k if least[find(i)] is None else min(k, least[find(i)])
    return Counter((k, len(s), least[find(i)]) for i, (k, s) in enumerate(sets))


def test_groups_equal_brute_force(spark):
    rng = random.Random(8)
    rows = []
    for group in range(12):
        base = words(group, rng.choice([3, 12, 40, 200])).split()
        for _ in range(rng.randint(1, 14)):  # chains: each is a change of one of those before
            base = list(base)
            for _ in range(rng.randint(0, max(1, len(base) // 25))):
                base[rng.randrange(len(base))] = "new%d" % rng.randrange(10**6)
            rows.append((len(rows), rng.choice([str.upper, str])(" ".join(base))))
    rows += [(900, "a"), (901, "A"), (902, "É"), (903, "é"), (904, "a b"), (905, None), (906, " \t")]
    frame = spark.createDataFrame(rows, "doc_id int, text string").repartition(4)
    for n in (2, 5):
        got = Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in near_dup.groups(frame, words=n).collect())
        assert got == expected_groups(rows, n)


def test_signatures_estimate_similarity():
    rng = np.random.default_rng(3)
    for size in (1, 5, 60, 3000):
        total, trials = 0.0, 20
        for _ in range(trials):
            pool = rng.integers(0, 2**63, 2 * size, dtype=np.int64).astype(np.uint64)
            a, b = near_dup.signature(pool[: size + size // 2]), near_dup.signature(pool[size // 2 :])
            assert (a < np.uint64(near_dup.SLOTS << 32)).all()
            total += float((a == b).mean())
        a, b = set(range(size + size // 2)), set(range(size // 2, 2 * size))
        assert abs(total / trials - len(a & b) / len(a | b)) < 0.06


def test_bands_fit_the_limit(spark):
    assert [near_dup.band_slots(p) for p in (100, 80, 70, 60, 50)] == [6, 6, 4, 3, 2]
    assert all((1 - (p / 100) ** near_dup.band_slots(p)) ** (near_dup.SLOTS // near_dup.band_slots(p)) <= 3e-6 for p in range(5, 101))
    with pytest.raises(ValueError):
        near_dup.band_slots(4)
    rows = []
    for k in range(60):  # pairs that share 40 of 80 words
        own = [f"w{k}x{j}" for j in range(80)]
        rows += [(2 * k, " ".join(own[:60])), (2 * k + 1, " ".join(own[20:]))]
    got = near_dup.groups(spark.createDataFrame(rows, "doc_id int, text string"), words=1, percent=50).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == {k: k - k % 2 for k in range(120)}


def test_odd_rows_are_grouped_and_kept_once(odd, none):
    found = near_dup.groups(odd).collect()
    assert len(found) == odd.count()
    assert {r["component_id"] for r in found if r["doc_id"] in (1, 2, 3)} == {1}
    kept = near_dup.deduplicate(odd)
    assert kept.dtypes == odd.dtypes
    ids = Counter(r["doc_id"] for r in kept.collect())
    assert ids[1] == 1 and not ids[2] and not ids[3] and ids[4] == ids[5] == ids[6] == 1 and ids[None] == 2 and ids[7] == ids[12] == 1
    assert near_dup.groups(none).count() == 0 and near_dup.deduplicate(none).count() == 0


def test_long_chains_become_one_component(spark):
    links = spark.range(1, 200).select(F.col("id").alias("a"), (F.col("id") - 1).alias("b")).union(spark.range(1).select(F.lit(1000).alias("a"), F.lit(1001).alias("b")))
    roots = {r["node"]: r["root"] for r in graph.components(links).collect()}
    assert roots == {k: 0 for k in range(1, 200)} | {1001: 1000}
    assert graph.components(links.where("false")).count() == 0


def longest(own, item, percent=80):
    best = 0
    for shift in range(-len(item), len(own)):
        low, high = max(0, shift), min(len(own), shift + len(item))
        sums = [0]
        for p in range(low, high):
            sums.append(sums[-1] + (100 - percent if own[p] == item[p - shift] else -percent))
        best = max([best, *(j - i for j in range(len(sums)) for i in range(j) if sums[i] <= sums[j])])
    return best


def test_overlaps_equal_brute_force(spark):
    rng = random.Random(5)
    bench = [(k, words(500 + k, rng.choice([6, 9, 14, 30]))) for k in range(12)] + [(None, words(700, 20)), (50, None), (51, "")]
    docs = []
    for k in range(80):
        own = words(600 + k, rng.randint(0, 60)).split()
        if k % 2:
            part = rng.choice(bench)[1]
            part = (part or "").upper().split()
            for p in range(len(part)):
                if rng.random() < rng.choice([0, 0.1, 0.3]):
                    part[p] = "other"
            part = part[rng.randint(0, 3) : len(part) - rng.randint(0, 12)]
            own[len(own) // 2 : len(own) // 2] = part
        docs.append((k, " ".join(own)))
    docs += [(90, None), (91, "")]
    got = {r["doc_id"]: r for r in decontam.report(spark.createDataFrame(docs, "doc_id int, text string"), spark.createDataFrame(bench, "item_id int, text string")).collect()}
    missed = found = 0
    for k, text in docs:
        own = (text or "").lower().split()
        want = {}
        for item_id, item in bench:
            item = (item or "").lower().split()
            n = longest(own, item) if len(item) >= decontam.LEAST else len(item) if any(own[p : p + len(item)] == item for p in range(len(own))) else 0
            if n and n >= min(decontam.WORDS, len(item)):
                want[item_id] = n
        assert set(got[k]["item_ids"]) <= {i for i in want if i is not None} and (not want) <= got[k]["kept"]
        assert got[k]["kept"] or got[k]["n_words"] == max(want.values())
        found += len(want)
        missed += bool(want) and got[k]["kept"]
    assert found > 5 and not missed


def test_stretches_are_whole_however_far_hits_are_apart(spark):
    item, other = words(300, 740).split(), words(301, 740).split()
    docs = [(1, " ".join(item[:300] + other[300:440] + item[440:])), (2, words(302, 50) + " " + " ".join(item[:300] + other[300:440] + item[440:]) + " " + words(303, 500)),
            (3, " ".join(item[:600] + other[600:])), (4, " ".join(item[400:]))]
    got = {r["doc_id"]: r["n_words"] for r in decontam.report(spark.createDataFrame(docs, "doc_id int, text string"), spark.createDataFrame([(1, " ".join(item))], "item_id int, text string")).collect()}
    assert got == {1: 740, 2: 740, 3: 740, 4: 340}


def most_equal_without_seed(n):
    """The most words of n that can be equal where no mask fits."""
    masks = [(m[-1] + 1, sum(1 << (m[-1] - p) for p in m)) for m in decontam.MASKS]
    states = {(0, 0): 0}
    for _ in range(n):
        after = {}
        for (length, last), equal in states.items():
            for word in (0, 1):
                key = (min(length + 1, 8), (last << 1 | word) & 255)
                if not any(key[0] >= size and key[1] & mask == mask for size, mask in masks):
                    after[key] = max(after.get(key, 0), equal + word)
        states = after
    return max(states.values())


def test_every_contaminated_stretch_has_a_seed():
    assert not [n for n in range(8, 121) if 100 * most_equal_without_seed(n) >= decontam.PERCENT * n]


def test_every_fourth_word_substituted(spark):
    bench = [(n, words(800 + n, n)) for n in (10, 11, 15)]
    changed = [" ".join("other" if p % 4 == 3 else w for p, w in enumerate(text.split())) for _, text in bench]
    docs = spark.createDataFrame([(n, f"before it {text} behind it") for (n, _), text in zip(bench, changed, strict=True)], "doc_id int, text string")
    got = {r["doc_id"]: r for r in decontam.report(docs, spark.createDataFrame(bench, "item_id int, text string")).collect()}
    assert {k: (r["item_ids"], r["n_words"], r["kept"]) for k, r in got.items()} == {n: ([n], n, False) for n in (10, 11, 15)}


def test_short_items_are_found_word_for_word(spark):
    bench = [(n, words(900 + n, n)) for n in range(1, 9)]
    docs = [(n, f"{words(950, 90)} {text.upper()} {words(951, 90)}") for n, text in bench]
    docs += [(20 + n, f"{words(950, 90)} {' '.join([*text.split()[:-1], 'other'])} {words(951, 90)}") for n, text in bench[:7]] + [(40, bench[2][1]), (41, None)]
    frames = spark.createDataFrame(docs, "doc_id int, text string"), spark.createDataFrame([*bench, (60, ""), (61, None)], "item_id int, text string")
    got = {r["doc_id"]: (r["item_ids"], r["n_words"]) for r in decontam.report(*frames, short=True).collect()}
    assert got == {n: ([n], n) for n in range(1, 9)} | {20 + n: ([], 0) for n in range(1, 8)} | {40: ([3], 3), 41: ([], 0)}
    assert {r["doc_id"] for r in decontam.decontaminate(*frames, short=True).collect()} == {*range(21, 28), 41}


def test_contaminated_odd_rows_go(spark, odd, none):
    bench = spark.createDataFrame([(1, words(1, 40)), (2, "One"), (None, None)], "item_id bigint, text string")
    kept = decontam.decontaminate(odd, bench)
    assert kept.dtypes == odd.dtypes and Counter(r["doc_id"] for r in kept.collect()) == Counter(r["doc_id"] for r in odd.collect() if r["doc_id"] not in (1, 2, 3, 8, 11))
    assert decontam.decontaminate(none, bench).count() == 0 and decontam.decontaminate(odd, bench.where("false")).count() == odd.count()
