"""Training-data operators against brute force, on small tables with every dirty case."""

import math
import random
import unicodedata
from operator import itemgetter

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexispan.functions.letters import letters
from lexispan.llm import frequency, leakage, overlap, packing, queries, reading, splits, topn

SEGMENT = "segment_id string, split string, text string, encoded_at timestamp, code string"


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, old = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(old[j] + 1, row[j - 1] + 1, old[j - 1] + (x != y)))
    return row[-1]


def segments(spark, rows):
    return spark.createDataFrame([(i, s, t, None, "clash") for i, s, t in rows], SEGMENT).withColumn("encoded_at", F.to_timestamp(F.lit("2025-01-01")))


def mutated(rng, text, k):
    text = list(text)
    for _ in range(k):
        i = rng.randrange(len(text))
        text[i : i + rng.randrange(2)] = rng.choice("abdeghiklmnoprstuv") * rng.randrange(2)
    return "".join(text)


def lines(rng, n):
    words = ["".join(rng.choice("kgtdnpbmrlvs") + rng.choice("aiueo") for _ in range(rng.randrange(2, 5))) for _ in range(60)]
    return [" ".join(rng.choice(words) for _ in range(rng.randrange(5, 14))) for _ in range(n)]


@pytest.mark.parametrize("hot_pairs", [100_000_000, 20])
def test_overlaps_equal_brute_force(spark, hot_pairs):
    rng = random.Random(3)
    base = lines(rng, 60)
    phrase = "namo bhagavate vasudevaya "
    rows = [(f"d:l{i:08d}", "train", (phrase if i % 2 else "") + t) for i, t in enumerate(base)]
    rows += [(f"e:l{i:08d}", rng.choice(["dev", " Test "]), (phrase if i % 2 else "") + mutated(rng, t, rng.randrange(0, 7))) for i, t in enumerate(base)]
    rows += [("x:l1", "dev", None), ("x:l2", None, base[0]), ("x:l3", "dev", ""), ("x:l4", "other", base[0]), (None, "dev", base[0]), rows[0], ("y:l1", "test", base[0].upper() + " ||")]
    found = overlap.split_overlaps(segments(spark, rows), hot_pairs=hot_pairs)
    got = {(r.train_id, r.held_id): r.edits for r in found.collect()}
    valid = {i: ((s or "").strip().lower(), letters(t)) for i, s, t in rows if i and t}
    want = {}
    for a, (s, x) in valid.items():
        for b, (h, y) in valid.items():
            if s == "train" and h in ("dev", "test") and min(len(x), len(y)) >= 30 and abs(len(x) - len(y)) * 100 <= 15 * max(len(x), len(y)):
                d = distance(x, y)
                if d * 100 <= 15 * max(len(x), len(y)):
                    want[a, b] = d
    assert got == want and len(want) > 40


def test_overlaps_of_nothing_and_of_copies(spark):
    assert overlap.split_overlaps(segments(spark, []).where("false")).count() == 0
    text = "rama gacchati vanam sita ca tisthati grhe " * 900
    copies = [(f"a:l{i}", "train", text) for i in range(5)] + [(f"b:l{i}", "dev", text[:-1] + "x") for i in range(4)]
    found = overlap.split_overlaps(segments(spark, copies))
    assert found.count() == 20
    manifest = spark.createDataFrame([("b", "src", "2025")], "document_id string, source string, built_at string")
    assert [(r.split, r.source, r.segments, r.links) for r in overlap.overlap_report(found, manifest).collect()] == [("dev", "src", 4, 20)]


def test_short_lines_with_edits_all_over_are_found(spark):
    rng = random.Random(6)
    base = ["".join(rng.choice("kgtdnpbmrlvs") + rng.choice("aiueo") for _ in range(30))[: rng.randrange(30, 53)] for _ in range(200)]
    rows, want = [], set()
    for i, x in enumerate(base):
        k = 15 * len(x) // 100
        y = list(x)
        for j in range(k):  # evenly spread, so that hardly a window of 8 letters is left whole
            at = (2 * j + 1) * len(x) // (2 * k)
            y[at] = rng.choice(["", "z", y[at] + "z" if len(x) <= 50 else "z"])
        y = "".join(y)
        rows += [(f"a:l{i}", "train", x), (f"b:l{i}", "dev", y)]
        if len(y) >= 30 and distance(x, y) * 100 <= 15 * max(len(x), len(y)):
            want.add((f"a:l{i}", f"b:l{i}"))
    found = overlap.split_overlaps(segments(spark, rows))
    assert {(r.train_id, r.held_id) for r in found.collect()} >= want and len(want) > 150


def test_pieces_meet_in_every_short_pair():
    rng = random.Random(12)
    n = 0
    for _ in range(3000):
        x = "".join(rng.choice("abcd") for _ in range(rng.randrange(30, 61)))
        y = mutated(rng, x, rng.randrange(0, 12))
        if 30 <= len(y) <= 60 and distance(x, y) * 100 <= 15 * max(len(x), len(y)):
            a, b = (set(overlap.short_codes([t], 15, 30, 60, held)[2].tolist()) for t, held in ((x, False), (y, True)))
            assert a & b
            n += 1
    assert n > 1000


@pytest.mark.parametrize("percent", [100, 125, 150])
def test_evenly_spread_edits_are_found(percent):
    """Blocks of pairs that differ by one edit every few letters, or by as many at random places."""
    rng = random.Random(percent)
    base = ["".join(rng.choice("kgtdnpbmrlvs") + rng.choice("aiueo") for _ in range(80))[: rng.randrange(61, 150)] for _ in range(400)]
    for kind in ("even", "random"):
        other = []
        for x in base:
            k = percent * len(x) // 1000
            phase, y = rng.random(), list(x)
            places = [min(len(x) - 1, int((i + phase) * len(x) / k)) for i in range(k)] if kind == "even" else rng.sample(range(len(x)), k)
            for at in places:
                y[at] = rng.choice(["z", "", y[at] + "z"]) if kind == "random" or rng.random() < 0.3 else "z"
            other.append("".join(y))
        shared = np.zeros(len(base), dtype=bool)
        for make in (lambda t, held: overlap.window_blocks(t, 8, 5), lambda t, held: overlap.gapped_blocks(t, 5, 22 if held else 18)):
            sides = [{}, {}]
            for held, texts in ((False, base), (True, other)):
                owner, _, code = make(texts, held)
                for i, c in zip(owner.tolist(), code.tolist(), strict=True):
                    sides[held].setdefault(i, set()).add(c)
            shared |= [bool(sides[0].get(i, set()) & sides[1].get(i, set())) for i in range(len(base))]
        assert shared.mean() >= 0.99


def test_a_stock_phrase_does_not_multiply_pairs():
    rng = random.Random(8)
    syllable = lambda n: "".join(rng.choice("kgtdnpbmrlvs") + rng.choice("aiueo") for _ in range(n // 2))
    phrase = syllable(40)
    texts = [x[:cut] + phrase + x[cut:] for x in (syllable(60) for _ in range(5000)) for cut in (rng.randrange(60),)]
    held = [i % 5 == 0 for i in range(len(texts))]
    sizes = np.array([len(t) for t in texts])
    ids, whole = np.arange(len(texts)) * 4 + 1, overlap.count_codes(texts)

    def side(blocks):
        return overlap._Side([overlap._pack(*blocks[:2], blocks[2] & np.uint64(0xFFFFFFFF), ids, whole, sizes)])

    of = lambda blocks, want: tuple(x[np.array(held)[blocks[0]] == want] for x in blocks)
    blocks, plain, refined = overlap.window_blocks(texts, 8, 5), [], []
    _, over = overlap._meet(side(of(blocks, False)), side(of(blocks, True)), 15, 100_000, plain)
    assert len(over) >= 5  # every window of the phrase that is chosen
    hot = np.unique(blocks[2][np.isin((blocks[2] & np.uint64(0xFFFFFFFF)).astype(np.uint32), over)])
    made = [overlap.phrase_blocks(texts, 8, 5, hot, 15, h) for h in (False, True)]
    overlap._meet(side(of(made[0], False)), side(of(made[1], True)), 15, 0, refined)
    assert plain[0] + refined[0] < 4000 * 1000 / 2  # of all pairs; the phrase's windows alone would make over ten times as many


def test_radius_is_safe():
    rng = random.Random(5)
    for text in lines(rng, 80):
        x = letters(text)
        for k in (1, 5, 12):
            y = letters(mutated(rng, x, k))
            a, b = overlap.count_codes([x, y])
            assert sum(int(u ^ v).bit_count() for u, v in zip(a.tolist(), b.tolist(), strict=True)) <= 2 * distance(x, y)
            percent = -(-100 * distance(x, y) // max(len(x), len(y)))
            assert overlap.near_in_pairs([x], [y], percent).all()


def test_counts_and_moves_are_safe():
    rng = random.Random(9)
    for text in lines(rng, 60):
        x = letters(text)
        for _ in range(6):
            start = rng.randrange(len(x) - 8)  # a block that stays whole, with edits before and after it
            before, after = (mutated(rng, part, rng.randrange(min(5, len(part)) or 1)) for part in (x[:start], x[start + 8 :]))
            y = before + x[start : start + 8] + after
            a, b = overlap._plain_counts(overlap.count_codes([x, y]))
            edits = distance(x[:start], before) + distance(x[start + 8 :], after)
            moved = abs(start - len(before)) + abs(len(x) - start - 8 - len(after))
            assert overlap.count_distance(a[:1], b[:1])[0] + overlap.count_distance(a[1:], b[1:])[0] <= 2 * edits - moved


def test_hardly_any_pairs_by_chance_leave_a_bucket():
    rng = random.Random(14)
    words = ["".join(rng.choice("kgtdnpbmrlvs") + rng.choice("aiueo") for _ in range(rng.randrange(2, 6))) for _ in range(1500)]
    texts = ["".join(rng.choice(words) for _ in range(rng.randrange(7, 16))) for _ in range(12_000)]
    sizes, ids, whole = np.array([len(t) for t in texts]), np.arange(len(texts)) * 4 + 1, overlap.count_codes(texts)
    owner, place, code = overlap.window_blocks(texts, 8, 5)
    sides = [overlap._Side([overlap._pack(owner[s], place[s], code[s] & np.uint64(0xFFFFFFFF), ids, whole, sizes)]) for s in (owner % 5 > 0, owner % 5 == 0)]
    _, at = np.unique(code, return_inverse=True)
    shared = int((np.bincount(at[owner % 5 > 0], minlength=at.max() + 1) * np.bincount(at[owner % 5 == 0], minlength=at.max() + 1)).sum())
    compared = []
    pairs, _ = overlap._meet(*sides, 15, 0, compared)
    assert shared > 400_000 and compared[0] < shared / 4 and len(pairs) < shared / 2000


def test_common_windows_are_counted_over_all_records(spark):
    rng = random.Random(16)
    syllables = lambda n: "".join(rng.choice("kgtdnpbmrlvs") + rng.choice("aiueo") for _ in range(n // 2))
    texts = [syllables(30) for _ in range(110_000)]
    i = 0
    for k in range(20):  # phrases in 0.95 to 1.05 % of all records
        phrase = syllables(24)
        for i in range(i + 1, i + 1045 + 6 * k):
            texts[i] += phrase
    classes = spark.createDataFrame([(4 * i + 1 + i % 2, x) for i, x in enumerate(texts)], "class_id long, letters string")
    held = {}
    for i, code in set(zip(*(x.tolist() for x in itemgetter(0, 2)(overlap.window_blocks(texts, 8, 5))), strict=True)):
        held.setdefault(code, [0, 0])[i % 2] += 1
    for hot_pairs in (10_000, 308_000):
        want = {c for c, (t, h) in held.items() if t + h >= len(texts) // 100 and t * h > hot_pairs}
        assert set(overlap.common_windows(classes, len(texts), 8, 5, hot_pairs).tolist()) == want and 5 < len(want) < 100
    assert len(overlap.common_windows(classes, len(texts), 8, 5, len(texts) ** 2)) == 0


def test_pairs_are_verified_a_share_at_a_time(spark, monkeypatch):
    rng = random.Random(15)
    base = [letters(t) for t in lines(rng, 40)]
    rows = [(4 * i + 1, 0, i, x) for i, x in enumerate(base)] + [(4 * i + 2, 1, i, letters(mutated(rng, x, 3))) for i, x in enumerate(base)]
    classes = spark.createDataFrame(rows, "class_id long, h1 long, h2 long, letters string")
    kept, largest = [0], [0]
    make, drop = overlap.cut, overlap.drop_cut
    monkeypatch.setattr(overlap, "drop_cut", lambda df: (kept.__setitem__(0, kept[0] - 1), drop(df)))

    def tables():
        for k in range(6):
            some = [(4 * i + 1, 4 * j + 2) for i in range(40) for j in range(40) if i == j or (i + j) % 6 == k]
            kept[0] += 1
            largest[0] = max(largest[0], kept[0])
            yield make(spark.createDataFrame(some, "train_class long, held_class long")), len(some)

    want = sorted((4 * i + 1, 4 * j + 2) for i, x in enumerate(base) for j in range(40) for y in (rows[40 + j][3],) if distance(x, y) * 100 <= 15 * max(len(x), len(y)))
    for most, tables_kept in ((10_000, 6), (400, 2), (100, 1)):
        kept[0] = largest[0] = 0
        got = overlap.verified_pairs(tables(), classes, 15, most)
        assert sorted((r.train_class, r.held_class) for r in got.collect()) == want and len(want) >= 40
        assert (kept[0], largest[0]) == (0, tables_kept)


@pytest.mark.parametrize("partitions", [1, 7])
def test_top_n_equals_sort(spark, partitions):
    rng = random.Random(1)
    rows = [("hot", f"s{rng.randrange(400):03d}", rng.choice([0.5, 0.25, 1.0])) for _ in range(600)] + [(f"g{i % 9}", f"t{i}", float(i % 4)) for i in range(70)]
    rows += [(None, "a", 1.0), ("g", None, 1.0), ("g", "a", None), ("g", "b", math.nan), ("", "é", 1.0), ("", "z", 1.0), ("hot", "s001", 1.0)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "key string, item string, score double, rank_no string")
    got = [tuple(r) for r in topn.top_in_groups(df, "key", "score", "item", 5, partitions=partitions).collect()]
    groups = {}
    for k, i, s in rows:
        if None not in (k, i, s) and not math.isnan(s):
            groups.setdefault(k, []).append((-s, i))
    want = [(k, i, n) for k, v in groups.items() for n, (_, i) in enumerate(sorted(v)[:5], 1)]
    assert sorted(got) == sorted(want)
    assert topn.top_in_groups(df.where("false"), "key", "score", "item", 5).count() == 0


def test_latest_masses(spark):
    rows = [("k", "s", 1.0, "2025-01-01"), ("k", "s", 9.0, "2024-01-01"), ("k", "s", math.nan, "2026-01-01"), ("k", "t", 2.0, None), (None, "s", 1.0, "2025-01-01")]
    df = spark.createDataFrame(rows, "form_key string, surface string, expected_mass double, exported_at string")
    assert sorted(tuple(r) for r in topn.latest_masses(df).collect()) == [("k", "s", 1.0), ("k", "t", 2.0)]


def test_frequencies(spark):
    rows = [(f"f{i:05d}", "a", 1) for i in range(70_000)] + [(f"f{i:05d}", "b", 2) for i in range(0, 70_000, 3)] + [("f00001", "c", 4), ("f00002", "c", None), (None, "a", 1), ("f1", None, 1), ("f00001", "a", 5)]
    df = spark.createDataFrame(rows, "file string, token string, n long").withColumn("term", F.lit("clash"))
    got = {r.term: (r.records, r.occurrences, r.mark) for r in frequency.marked_terms(df, record="file", term="token", count="n").collect()}
    assert got == {"a": (70_000, 70_005, "common"), "b": (23_334, 46_668, None), "c": (2, 4, "rare")}
    assert frequency.marked_terms(df.where("false"), record="file", term="token", count="n").count() == 0
    bitmaps = frequency.term_bitmaps(df, record="file", term="token", count="n")
    assert bitmaps.where("term = 'a'").count() == 2 and bitmaps.where("term = 'c'").first()["records"] is not None
    twice = frequency.term_frequencies(frequency.merge_bitmaps(bitmaps, bitmaps))
    assert {r.term: (r.records, r.occurrences) for r in twice.collect()}["b"] == (23_334, 2 * 46_668)


def test_bitmaps_are_compressed():
    rng = np.random.default_rng(4)
    for n in (0, 1, 2, 300, 4096, 4097, 30_000, 65_536):
        places = np.sort(rng.choice(frequency.BLOCK, n, replace=False))
        for some in (places, np.arange(n)):
            bitmap = frequency.compressed(some)
            assert frequency.places_of(bitmap).tolist() == some.tolist() and frequency.cardinality(bitmap) == n
            assert len(bitmap) <= 8193 and frequency.union([bitmap, frequency.compressed(places)]) == frequency.compressed(np.union1d(some, places))
    assert len(frequency.compressed(np.array([7]))) == 3  # bytes of a term in one record
    assert len(frequency.compressed(np.arange(frequency.BLOCK))) == 5  # and of one in all


def test_entries_that_name_nobody(spark):
    nobody = ["author not known", "Unknown poet", "s.n.", "unattributed", "ajñātakavi", "Verfasser unbekannt", "Anonymous", "अज्ञात", "N.N.", "n.a.", "[unknown]", "AuthorUnknown", "anon."]
    known = ["Anna", "Kālidāsa", "Nala", "Na-rada", "Noname Kavi Rama", "Author Rama", "kavi", "Various Hands of Rama"]
    rows = [(f"d{i}", "author", name) for i, name in enumerate(nobody + known)] + [("w", "work", "Nil")]
    got = {r.document_id for r in splits.document_ties(spark.createDataFrame(rows, "document_id string, kind string, name string")).collect()}
    assert got == {f"d{len(nobody) + i}" for i in range(len(known))} | {"w"}


def test_reports(spark):
    rows = [("./x\\y", " Ā ", 3, "2025"), ("x/y", unicodedata.normalize("NFD", "ā") + "​", 7, "2026"), ("x/y", "a", None, "2027"), ("x/y", "​", 1, "2025")]
    df = spark.createDataFrame(rows, "file string, token string, count long, audited_at string")
    assert [tuple(r) for r in frequency.valid_reports(df).collect()] == [("x/y", "ā", 7)]


def credit_rows():
    return [
        ("d1", "author", "Rāma"), ("d2", "author", "RAMA "), ("d2", "work", "Gītā"), ("d3", "work", "gita"), ("d4", "editor", "Rāma"), ("d5", "author", "anon."), ("d6", "author", "?"),
        ("d5", "author", "Unknown"), ("d6", "author", None), (None, "author", "Rāma"), ("d3", "work", "gita"), ("d7", "work", "Rāma"), ("d8", " Author", "रामा"),
    ]


def test_groups_and_splits(spark):
    credits = spark.createDataFrame([(*r, "x") for r in credit_rows()], "document_id string, kind string, name string, split string")
    rows = [("d1", "train", "2025"), ("d1", "dev", "2026"), ("d2", " DEV", "2025"), ("d3", "test", "2025"), ("d4", "test", "2025"), ("d5", None, "2025"), ("d6", "dev", "2025"), ("d8", None, "2025")]
    manifest = spark.createDataFrame([(*r, "s") for r in rows], "document_id string, split string, built_at string, source string")
    got = sorted(tuple(r) for r in splits.torn_groups(manifest, credits).collect())
    assert got == [("d1", "d1"), ("d2", "d1"), ("d3", "d1"), ("d8", "d1")]
    assigned = {r.document_id: r.split for r in splits.grouped_splits(manifest, credits).collect()}
    assert len({assigned[d] for d in ("d1", "d2", "d3", "d8")}) == 1 and set(assigned) == {r[0] for r in rows}
    ids = spark.createDataFrame([("d1:l00000001",), ("d1:l00000001",), ("zz:l1",), (None,)], "segment_id string")
    where = {r.segment_id: r.split for r in splits.segment_splits(ids, splits.grouped_splits(manifest, credits)).collect()}
    assert where == {"d1:l00000001": assigned["d1"], "zz:l1": None}
    assert splits.torn_groups(manifest, credits.where("false")).count() == 0 and splits.grouped_splits(manifest.where("false"), credits).count() == 0


def test_hash_to_min_on_chains_and_stars(spark):
    chain = [(f"c{i:03d}", f"c{i + 1:03d}") for i in range(40)] + [("hub", f"s{i:03d}") for i in range(300)] + [("a", "a"), ("b", None)]
    got = {r.node: r.component for r in splits.hash_to_min(spark.createDataFrame(chain, "x string, y string"), "x", "y").collect()}
    assert {got[f"c{i:03d}"] for i in range(41)} == {"c000"} and got["s299"] == "hub" and got["a"] == "a" and "b" not in got


def test_split_shares(spark):
    rows = [(f"d{i:05d}", "train", "2025", "s") for i in range(4000)]
    manifest = spark.createDataFrame(rows, "document_id string, split string, built_at string, source string")
    credits = spark.createDataFrame([(f"d{i:05d}", "author", "big") for i in range(1300)], "document_id string, kind string, name string")
    shares = {r[0]: r[1] / 4000 for r in splits.grouped_splits(manifest, credits).groupBy("split").count().collect()}
    assert abs(shares["train"] - 0.8) < 0.03 and abs(shares["dev"] - 0.1) < 0.03 and abs(shares["test"] - 0.1) < 0.03


def test_packing(spark):
    rng = np.random.default_rng(2)
    sizes = [int(x) for x in np.exp(rng.normal(5.5, 1.2, 3000))] + [0, 2048, 2049, 50_000, 1] + [700] * 1000
    df = spark.createDataFrame([*((i, n) for i, n in enumerate(sizes)), (9_999_999, None)], "key long, n_tokens long")
    rows = packing.pack_windows(df).collect()
    by_window, by_key = {}, {}
    for r in rows:
        by_key.setdefault(r.key, []).append(r)
        if r.window_id is not None:
            by_window[r.window_id] = by_window.get(r.window_id, 0) + r.n_tokens
    assert max(by_window.values()) <= 2048 and set(by_window) == set(range(len(by_window)))
    assert sum(by_window.values()) / (2048 * len(by_window)) > 0.97
    for i, n in enumerate(sizes):
        pieces = sorted(by_key[i], key=lambda r: r.piece_no)
        assert sum(r.n_tokens for r in pieces) == n and (len(pieces) == 1 or n > 2048)
        assert [r.first_token for r in pieces] == [2048 * k for k in range(len(pieces))]
    assert packing.pack_windows(df.where("false")).count() == 0
    assert packing.harmonic_windows(df).count() > 3


def test_plan_uses_every_length():
    counts = {5: 7, 3: 11, 10: 2, 1: 1}
    used = {}
    for lengths, windows in packing.plan_windows(counts, 10):
        assert sum(n * k for n, k in lengths) <= 10
        for n, k in lengths:
            used[n] = used.get(n, 0) + k * windows
    assert used == counts


def brute_tiles(d, i, least):
    free_d, free_i, tiles = [True] * len(d), [True] * len(i), []
    while True:
        best = (least - 1, 0, 0)
        for a in range(len(d)):
            for b in range(len(i)):
                n = 0
                while a + n < len(d) and b + n < len(i) and d[a + n] == i[b + n] and free_d[a + n] and free_i[b + n]:
                    n += 1
                if n > best[0]:
                    best = (n, a, b)
        n, a, b = best
        if n < least:
            return tiles
        free_d[a : a + n] = [False] * n
        free_i[b : b + n] = [False] * n
        tiles.append((a, b, n))


def test_tiling_equals_brute_force():
    rng = random.Random(4)
    for _ in range(60):
        d = [rng.randrange(2) for _ in range(rng.randrange(0, 60))]
        i = [rng.randrange(2) for _ in range(rng.randrange(0, 40))]
        got = leakage.tile(np.array(d, dtype=np.int32), np.array(i, dtype=np.int32), 4)
        want = brute_tiles(d, i, 4)
        assert [t[2] for t in got] == [t[2] for t in want] and got == want


def test_leaks(spark):
    rng = random.Random(9)
    texts = lines(rng, 12)
    items = [(i, t * 2) for i, t in enumerate(texts[:5])] + [(5, None), (6, ""), (7, "short"), (8, texts[0] * 2)]
    docs = [(i, "pre " + letters(texts[i] * 2)[3:43] + " post") for i in range(5)] + [(5, letters(texts[0] * 2)[:39]), (6, None), (7, ""), (8, ("x " + texts[1] * 2) * 300), (9, texts[9])]
    frames = spark.createDataFrame([(*r, 1) for r in docs], "doc_id long, text string, item_id int"), spark.createDataFrame([(*r, "t") for r in items], "item_id long, text string, task string")
    grams = {i: {letters(t)[k : k + 40] for k in range(len(letters(t)) - 39)} for i, t in items}
    want = {(d, i) for d, t in docs for i, g in grams.items() if any(x in letters(t) for x in g)}
    for limit in (4_000_000, 0):
        found = leakage.leaks(*frames, broadcast_windows=limit)
        assert {(r.doc_id, r.item_id) for r in found.collect()} == want and found.count() == len(want)
    assert (5, 0) not in want and (0, 8) in want
    assert leakage.leaks(frames[0].where("false"), frames[1]).count() == 0 and leakage.leaks(frames[0], frames[1].where("false")).count() == 0
    halves = letters(texts[2] * 2)
    shuffled = spark.createDataFrame([(1, halves[35:] + "zz" + halves[:35])], "doc_id long, text string")
    assert {r.item_id for r in leakage.leaks(shuffled, frames[1], passage=10_000, coverage=0.9).collect()} == {2}
    report = {r.item_id: r.documents for r in leakage.leak_report(leakage.leaks(*frames), frames[1]).collect()}
    assert report[5] == 0 and report[1] == 2


def test_leaks_by_coverage_at_every_place(spark):
    rng = random.Random(11)
    word = lambda n: "".join(rng.choice("kgtdnpbmrlvs") + rng.choice("aiueo") for _ in range(n // 2))
    items = [(i, word(n)) for i, n in enumerate((20, 30, 38, 60, 100, 160))]
    docs = []
    for i, t in items[:3]:
        docs += [(100 * i + k, i, "z" * k + t + word(40)) for k in range(21)]
    for i, t in items[3:]:
        size = {60: 30, 100: 25, 160: 20}[len(t)]
        pieces = [t[k : k + size] for k in range(0, len(t), size)]
        docs += [(100 * i + k, i, "z" * k + "zz".join(reversed(pieces)) + word(40)) for k in range(21)]
    frames = spark.createDataFrame([(d, t) for d, _, t in docs], "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    for limit in (4_000_000, 0):
        got = {(r.doc_id, r.item_id) for r in leakage.leaks(*frames, coverage=0.8, broadcast_windows=limit).collect()}
        assert got == {(d, i) for d, i, _ in docs}


def test_hashes_by_doubling():
    letters_ = np.array([random.Random(2).randrange(97, 123) for _ in range(80)], dtype=np.int32)
    for width in range(1, 42):
        assert (leakage._hash_all(letters_, width) == leakage.run_hashes(letters_, width)).all()


def test_words_and_languages():
    many = ["the king sees a river and every child " * 8, "der König und die Frau sehen das Haus " * 8, "rāmo gacchati vanaṃ | " * 30, "रामः गच्छति वनम् । " * 30, "phala — vana — giri — " * 30, None, "", "the king"]
    words = reading.words_of(many)
    assert words.count.tolist() == [64, 64, 90, 90, 90, 0, 0, 2]
    assert (words.lang[:4].tolist(), words.running.tolist()) == ([0, -1, 1, 1], [True, True, True, True, False, False, False, False])
    assert words.code[words.owner == 2][0] == reading.word_hash("ramo")
    assert words.code[words.owner == 3][0] == reading.word_hash("ramah")


def test_short_verse_lines_are_running_text():
    lines = ["kekāt genini |", "gulholnulanti ghanaḥ || 2 ||", "रामः गच्छति ॥ २ ॥"]
    verse = ["\r\n".join(lines[i % 3] for i in range(30)), "\n".join("turāḥ ca ||" for _ in range(30)), " ".join("na jumī | |" for _ in range(30))]
    lists = ["\r\n".join(f"phala || {i} ||" for i in range(60)), ",\n".join("phala giri" for _ in range(60)), "phala, giri; " * 30]
    assert reading.words_of(verse + lists).running.tolist() == [True] * 3 + [False] * 3


def test_no_labelled_text_of_fifty_words_is_left_out(spark):
    d, g = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    words = reading.words_of([r.text for r in d.join(reading.consensus(g), "doc_id").select("text").collect()])
    long = (words.count >= 50) & (words.lang >= 0)
    assert long.sum() > 600 and words.running[long].all()


def test_levels(spark):
    rng = random.Random(8)
    tiers = [["cat", "dog", "sun", "milk"], ["market", "teacher", "village", "garden"], ["grammar", "colophon", "recension", "tradition"], ["epistemology", "phenomenological", "hermeneutics", "ontological"]]

    def text(level):
        pick = lambda: rng.choice(tiers[min(3, max(0, level + rng.choice([-1, 0, 0, 0, 0, 1])))])
        return " ".join(f"the {pick()} sees a {pick()}" + ("." if rng.random() < 0.4 else "") for _ in range(25))

    docs = [(i, text(i % 4), "noise") for i in range(400)] + [(1000, None, "x"), (1001, "", "x"), (1002, "the cat", "x"), (1003, "der Hund und die Katze ist " * 20, "x")]
    labels = [(i, i % 4 + 1, "g1", "2025") for i in range(400) if i // 4 % 2 == 0] + [(0, 1, "g1", "2024"), (2, None, "g2", "2025"), (None, 3, "g", "2025"), (4, 9, "g", "2025"), (5000, 1, "g", "2025")]
    d = spark.createDataFrame(docs, "doc_id long, text string, level string")
    g = spark.createDataFrame(labels, "doc_id long, level int, grader string, graded_at string")
    got = {r.doc_id: r.level for r in reading.reading_levels(d, g).collect()}
    assert set(got) == set(range(400))
    held = [i for i in range(400) if i // 4 % 2]
    assert sum(got[i] == i % 4 + 1 for i in held) / len(held) > 0.85
    assert reading.reading_levels(d, g.where("false")).count() == 0 and reading.reading_levels(d.where("false"), g).count() == 0


def test_levels_do_not_depend_on_the_broadcast_bound(spark):
    d, g = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    want, got, none = ({r.doc_id: r.level for r in reading.reading_levels(d, g, max_words=n).collect()} for n in (1_000_000, 400, 300))
    assert got == want and none == want and len(want) > 500


def test_reading_accuracy_on_held_out_labels(spark, sf):
    d, g = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    inside = F.pmod(F.xxhash64("doc_id"), F.lit(4)) > 0
    judged = reading.consensus(g.where(~inside))
    both = reading.reading_levels(d, g.where(inside)).join(judged, "doc_id")
    n, right = both.agg(F.count(F.lit(1)), F.avg(F.col("level").between(F.col("low"), F.col("high")).cast("int"))).first()
    assert n > 100 and right > 0.8


@pytest.mark.parametrize("name", sorted(queries.queries()))
def test_queries_run(spark, sf, name):
    assert queries.queries()[name](spark, sf).count() >= 0
