"""N-gram join, fingerprints, passages and substring dedup against brute force."""

import hashlib
import itertools
import random
import re

import numpy as np
import pytest
from tables import odd_texts, roots, words

from braid.llm import fingerprints, ngram_join, passages, suffixes
from braid.llm.graph import components
from braid.llm.words import shingle_set

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain_set(text):
    w = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def linked(a, b):
    return bool(a) and bool(b) and 100 * len(a & b) >= 75 * len(a | b)


def edited(dice, base, share):
    out = list(base)
    for _ in range(round(share * len(base))):
        out[dice.randrange(len(out))] = f"x{dice.randrange(10**6)}"
    return out


@pytest.mark.parametrize("text", [t for t in odd_texts() if t is None or len(t) < 5000])
def test_shingles_count_as_plain_sets(text):
    assert len(shingle_set((text or "").encode())) == len(plain_set(text))


def test_components_of_paths_stars_and_loops(spark):
    dice = random.Random(2)
    pairs = [(i, i + 1) for i in range(0, 60)] + [(100, 100 + i) for i in range(1, 50)] + [(200, 200), (201, None)]
    pairs += [(dice.randrange(300, 400), dice.randrange(300, 400)) for _ in range(70)]
    dice.shuffle(pairs)
    got = dict(components(spark.createDataFrame(pairs, "src long, dst long")).collect())
    real = [(a, b) for a, b in pairs if b is not None]
    low = roots(400, real)
    assert got == {x: low[x] for p in real for x in p}
    assert components(spark.createDataFrame([], "src long, dst long")).count() == 0


def test_a_pair_that_is_a_star_and_a_candidate_stays_a_star(spark):
    hot = [(1, node) for node in range(ngram_join.FEW + 6)]
    entries = np.array(hot + [(2, 0), (2, 5), (3, 7), (3, 8)])
    size = np.full(len(entries), np.uint32(100) | ngram_join._INDEXED, "<u4")
    packed = (0, entries[:, 0].astype("<u8").tobytes(), entries[:, 1].astype("<i8").tobytes(), size.tobytes())
    rows = spark.createDataFrame([packed], ngram_join.schema(list(ngram_join._ENTRY)))
    got = sorted(map(tuple, ngram_join._candidates(rows, 75).collect()))
    assert got == [*((0, node, True) for _, node in hot[1:]), (7, 8, False)]


def test_prefix_tree_finds_every_link():
    dice = random.Random(3)
    sets = []
    for _ in range(12):
        base = dice.sample(range(3000), dice.randrange(5, 90))
        for _ in range(6):
            sets.append(np.array(sorted({x if dice.random() > 0.05 else dice.randrange(3000) for x in base}), np.uint64))
    want = [(i, j) for i, j in itertools.combinations(range(len(sets)), 2) if linked(set(sets[i].tolist()), set(sets[j].tolist()))]
    universe = 3000
    tree = ngram_join.PrefixTree([s.astype(np.int64) for s in sets])
    got = {tuple(sorted((i, j))) for i, s in enumerate(sets) for j in tree.linked(s.astype(np.int64), universe) if i != j}
    assert got == set(want)
    forest = ngram_join.block_links(sets)
    assert roots(len(sets), forest) == roots(len(sets), want)


def check_join(spark, rows):
    got = ngram_join.similar_texts(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    sets = [plain_set(t) for _, t in rows]
    pairs = [(i, j) for i, j in itertools.combinations(range(len(rows)), 2) if linked(sets[i], sets[j])]
    low = roots(len(rows), pairs)
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == {d: (len(s), rows[k][0]) for (d, _), s, k in zip(rows, sets, low, strict=True)}
    return pairs


@pytest.mark.parametrize("few", [64, 3])
def test_ngram_join_is_exact(spark, monkeypatch, few):
    """Also when nearly every n-gram counts as held by many, and blocks are small."""
    monkeypatch.setattr(ngram_join, "FEW", few)
    monkeypatch.setattr(ngram_join, "BLOCK", 64 if few == 64 else 4)
    dice = random.Random(few)
    rows, passage = [], words(dice, 60)
    for _ in range(14):
        base = words(dice, dice.randrange(3, 160))
        for _ in range(dice.randrange(1, 9)):
            rows.append(edited(dice, base, dice.choice([0, 0.01, 0.03, 0.06])))
    rows += [words(dice, 40) + passage + words(dice, 40) for _ in range(20)]
    rows += [passage] * 5
    dice.shuffle(rows)
    rows = [(7 + i, " ".join(r)) for i, r in enumerate(rows)] + [(0, None), (1, ""), (2, " "), (3, "one"), (4, "One")]
    assert check_join(spark, rows)


def test_ngram_join_of_a_large_group_of_copies(spark):
    dice = random.Random(11)
    base = words(dice, 200)
    rows = [(i, " ".join(edited(dice, base, 0.015))) for i in range(150)] + [(200 + i, " ".join(base)) for i in range(40)]
    check_join(spark, rows)


def test_shards_have_a_task_each(spark):
    dice = random.Random(20)
    rows = [(" ".join(words(dice, 80)),) for _ in range(200)]
    entries = ngram_join._entries(spark.createDataFrame(rows, "text string"), np.zeros(0, np.uint64), 5, 75)
    dealt = entries.selectExpr("shard", "spark_partition_id() AS task").distinct().collect()
    assert len(dealt) == len({r["task"] for r in dealt}) == ngram_join.shards_of(entries)


def test_stages_hand_few_texts_to_python_at_once(spark):
    import corpus_pipeline

    docs = spark.range(3000).selectExpr("id AS doc_id", "concat('text ', id) AS text").coalesce(1)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        corpus_pipeline._plain(docs)
        sizes = docs.mapInArrow(lambda batches: (type(b).from_pydict({"n": [b.num_rows]}) for b in batches), "n long").collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert sum(r["n"] for r in sizes) == 3000 and max(r["n"] for r in sizes) <= 1000


def test_ngram_join_of_odd_rows(spark, odd_docs, no_docs):
    got = ngram_join.similar_texts(odd_docs)
    assert got.count() == odd_docs.count()
    by_id = {r["doc_id"]: r for r in got.collect()}
    assert by_id[0]["n_shingles"] == 0 and by_id[0]["component_id"] == 0
    assert by_id[7]["component_id"] == by_id[8]["component_id"] == by_id[6]["component_id"] == 6
    assert by_id[10]["component_id"] == 9
    gone = ngram_join.losers(got)
    assert {r["doc_id"] for r in gone.collect()} == {None, 7, 8, 10}
    assert ngram_join.similar_texts(no_docs).count() == 0


def test_fingerprint_estimates():
    dice = random.Random(4)
    a = words(dice, 900, 10**6)
    b = a[:450] + words(dice, 450, 10**6)
    fa, fb = (fingerprints.sketch(" ".join(x).encode()) for x in (a, b))
    true = len(plain_set(" ".join(a)) & plain_set(" ".join(b))) / len(plain_set(" ".join(a)) | plain_set(" ".join(b)))
    assert abs(fingerprints.resemblance(fingerprints.decode(fa), fingerprints.decode(fb)) - true) < 0.13
    assert abs(fingerprints.distinct_shingles(fa) - 896) < 250
    half = fingerprints.sketch(" ".join(a[:300]).encode())
    assert fingerprints.containment(half, fa) > 0.75 > 0.5 > fingerprints.containment(fa, half)
    assert fingerprints.distinct_shingles(fingerprints.sketch(b"a b c d e f")) == 2
    assert fingerprints.sketch(b"") == fingerprints.sketch(None) == ""
    assert fingerprints.resemblance(fingerprints.decode(""), fingerprints.decode("")) == 1.0


def test_fingerprints_merge_across_parts(spark):
    dice = random.Random(6)
    texts = [" ".join(words(dice, 120)) for _ in range(12)]
    df = spark.createDataFrame([("k" if i % 2 else "m", t) for i, t in enumerate(texts)], "key string, text string").repartition(5)
    marked = df.select("key", fingerprints.fingerprint_column(df["text"]).alias("fingerprint"))
    got = dict(fingerprints.merged(marked, ["key"]).collect())
    for key, start in (("m", 0), ("k", 1)):
        every = np.unique(np.concatenate([shingle_set(t.encode()) for t in texts[start::2]]) >> np.uint64(16))
        assert got[key] == fingerprints.encode(every[: fingerprints.K])


def test_edited_pairs(spark, odd_docs, no_docs):
    rows = [(5 * i, t) for i, t in enumerate(odd_texts())]
    got = {r["doc_id"]: r for r in fingerprints.edited_pairs(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()}
    assert len(got) == len(rows)
    for i, (d, t) in enumerate(rows):
        t, n = t or "", rows[(i + 1) % len(rows)][1] or ""
        cut = len(t) // 4
        changed = t[: len(t) - cut] + n[:cut]
        assert got[d]["n_chars"] == len(t)
        assert got[d]["edited_sha256"] == hashlib.sha256(changed.encode()).hexdigest()
        assert got[d]["edited_fingerprint"] == fingerprints.sketch(changed.encode())
        assert 0 <= got[d]["near_edited"] <= 1 and 0 <= got[d]["near_next"] <= 1
    assert got[25]["fingerprint"] != "" and got[45]["near_edited"] > 0.4
    assert fingerprints.edited_pairs(odd_docs).count() == odd_docs.count()
    assert fingerprints.edited_pairs(no_docs).count() == 0


def brute_removed(rows, size=100):
    seen, out = set(), []
    for _, text in rows:
        data = (text or "").encode()
        cover = np.zeros(len(data) + 1, int)
        for i in range(len(data) - size + 1):
            piece = data[i : i + size]
            if piece in seen:
                cover[i] += 1
                cover[i + size] -= 1
            seen.add(piece)
        out.append(np.cumsum(cover)[: len(data)] > 0)
    return out


def test_substring_dedup_is_exact(spark, monkeypatch):
    """Overlaps, repeats inside a text, and several batches and chunks."""
    monkeypatch.setattr(suffixes, "BATCH", 64)
    dice = random.Random(8)
    blocks = [" ".join(words(dice, dice.randrange(8, 60))) for _ in range(12)]
    rows = []
    for i in range(60):
        parts = [dice.choice(blocks) if dice.random() < 0.5 else " ".join(words(dice, dice.randrange(1, 30))) for _ in range(dice.randrange(0, 6))]
        rows.append((i, "".join(parts)))
    rows += [(100, "ab" * 300), (101, "ab" * 120), (102, "\0" * 500), (103, None), (104, "é" * 120), (105, "x" * 99)]
    got = {r["doc_id"]: r for r in suffixes.deduplicated(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()}
    for (d, t), gone in zip(rows, brute_removed(rows), strict=True):
        data = (t or "").encode()
        kept = np.frombuffer(data, np.uint8)[~gone].tobytes()
        spans = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        r = got[d]
        assert (r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept"])) == (len(data), int(gone.sum()), spans, kept), d
        assert r["kept_sha256"] == hashlib.sha256(kept).hexdigest()


def test_anchors_of_long_texts_meet_at_chunk_borders(monkeypatch):
    data = np.frombuffer(" ".join(words(random.Random(1), 3000)).encode(), np.uint8)
    whole = suffixes.anchors(data)
    monkeypatch.setattr(suffixes, "CHUNK", 1000)
    cut = suffixes.anchors(data)
    for _, place, first, last in (whole, cut):
        assert first[0] == 0 and last[-1] == len(data) - suffixes.MATCH and (first[1:] == last[:-1] + 1).all()
        assert ((place >= last) & (place <= first + suffixes.SPAN - 1)).all()
    owner = lambda a: np.repeat(a[1], a[3] - a[2] + 1)
    assert (owner(whole) == owner(cut)).all()


def test_substring_dedup_of_odd_rows(odd_docs, no_docs):
    got = suffixes.deduplicated(odd_docs).collect()
    assert len(got) == odd_docs.count()
    by_id = {r["doc_id"]: r for r in got}
    assert by_id[10]["n_removed"] >= by_id[10]["n_bytes"] - 2 and by_id[9]["n_removed"] == 0
    assert by_id[11]["n_removed"] > 400
    assert suffixes.deduplicated(no_docs).count() == 0


def plain_lcs(a, b):
    table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
    return table[-1][-1]


def test_equal_words_is_the_longest_common_subsequence():
    dice = random.Random(9)
    for _ in range(200):
        a, b = ([dice.randrange(6) for _ in range(dice.randrange(0, 30))] for _ in range(2))
        assert passages.equal_words(np.array(a, np.uint64), np.array(b, np.uint64)) == plain_lcs(a, b)


def test_chains_follow_diagonals_and_part_at_gaps():
    x = np.array([0, 10, 20, 30, 200, 210, 15])
    y = np.array([5, 15, 25, 35, 205, 215, 400])
    got = passages.chains(x, y)
    assert sorted(map(len, got)) == [1, 2, 4]
    assert got[0].tolist() == [0, 1, 2, 3] or got[0].tolist() == [4, 5]


def test_a_large_group_is_not_shipped_in_pairs_of_chunks(spark, monkeypatch):
    dice = random.Random(22)
    base, far = words(dice, 200, 10**5), words(dice, 200, 10**5)
    texts = [edited(dice, base, 0.005) for _ in range(90)] + [far, edited(dice, far, 0.005)]
    sent, verified = [], ngram_join._verified
    monkeypatch.setattr(ngram_join, "BLOCK", 8)
    monkeypatch.setattr(ngram_join, "_verified", lambda places, *rest: sent.append(places.count()) or verified(places, *rest))
    docs = spark.createDataFrame([(d, " ".join(w)) for d, w in enumerate(texts)], "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in ngram_join.similar_texts(docs).collect()}
    assert got == {d: 0 if d < 90 else 90 for d in range(92)}
    # Not each of 90 sets in each of a dozen chunks.
    assert 90 <= sum(sent) < 300


def test_planted_passages_are_found(spark):
    dice = random.Random(10)
    base = words(dice, 110, 10**5)
    rows, where = [], {}
    for d in range(60):
        own = edited(dice, base, 0.04) if d % 2 else words(dice, 110, 10**5)
        before = words(dice, dice.randrange(0, 200), 10**5)
        rows.append((d, " ".join([*before, *own, *words(dice, 50, 10**5)])))
        where[d] = range(len(before), len(before) + 110)
    got = passages.shared_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    found = {d: set() for d in where}
    for r in got:
        found[r["doc_id"]].update(range(r["start"], r["end"]))
        found[r["src_doc_id"]].update(range(r["src_start"], r["src_end"]))
        assert r["src_doc_id"] < r["doc_id"] and r["equal"] >= 0.7 * (r["end"] - r["start"])
    for d, place in where.items():
        if d % 2:
            assert len(found[d] & set(place)) > 80, d
            assert len(found[d] - set(place)) <= 3
        else:
            assert not found[d]


def test_a_passage_with_one_seed_left_is_grown(spark):
    dice = random.Random(12)
    passage = words(dice, 50, 10**5)
    _, place = passages.seeds(passages.word_hashes(" ".join(passage).encode()))
    kept = min(place.tolist(), key=lambda p: abs(p - 22))
    rows = [(d, " ".join(passage[p : p + 6])) for d, p in enumerate(place.tolist()) if p != kept]
    rows += [(100, " ".join(passage)), (101, " ".join(passage + words(dice, 30, 10**5)))]
    got = passages.shared_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert [tuple(r) for r in got] == [(101, 0, 50, 100, 0, 50, 50)]


def test_a_passage_whose_seeds_are_first_in_parts_of_it(spark):
    dice = random.Random(13)
    passage = words(dice, 60, 10**5)
    rows = [(1, passage[:30]), (2, passage[30:]), (3, passage), (4, passage)]
    rows = [(d, " ".join(words(dice, 20, 10**5) + w + words(dice, 20, 10**5))) for d, w in rows]
    got = passages.shared_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {tuple(r) for r in got} == {(4, 20, 80, 3, 20, 80, 60)}


def sampled(dice, seed, before, after):
    """A text in which the words `seed` are a sampled seed, with drawn words around them."""
    name = passages.shingles(passages.word_hashes(" ".join(seed).encode()), passages.K)[0]
    for _ in range(1000):
        text = [*before(dice), *seed, *after(dice)]
        if name in passages.seeds(passages.word_hashes(" ".join(text).encode()))[0]:
            return text


def test_a_passage_between_others_of_the_same_seed_is_found(spark):
    dice = random.Random(17)
    while True:
        seed, left, right = (words(dice, n, 10**5) for n in (6, 24, 24))
        if 24 in passages.seeds(passages.word_hashes(" ".join([*left, *seed, *right]).encode()))[1]:
            break
    drawn = lambda n: lambda dice: words(dice, n, 10**5)
    # Every sixth word differs, so that no other seed, next seed or run of words is shared.
    changed = lambda text: lambda dice: [w if i % 6 else f"{w}x{dice.randrange(10**6)}" for i, w in enumerate(text)]
    before = lambda dice: changed(left[::-1])(dice)[::-1]
    rows = [sampled(dice, seed, drawn(40), drawn(40)) for _ in range(9)]
    rows[4] = sampled(dice, seed, lambda dice: left, lambda dice: right)
    rows.append(sampled(dice, seed, before, changed(right)))
    got = passages.shared_passages(spark.createDataFrame([(d, " ".join(w)) for d, w in enumerate(rows)], "doc_id long, text string")).collect()
    assert [(r["doc_id"], r["src_doc_id"]) for r in got] == [(9, 4)]
    assert got[0]["end"] - got[0]["start"] >= 50


def test_a_chain_of_two_runs_with_a_long_gap_is_two_passages():
    dice = random.Random(14)
    runs = [words(dice, 45, 10**5) for _ in range(2)]
    a, b = (passages.word_hashes(" ".join([*runs[0], *words(dice, 55, 10**5), *runs[1]]).encode()) for _ in range(2))
    at = np.array([0, 20, 39, 100, 120, 139])
    assert sorted(passages._aligned(a, b, at, at, 6, 40, 36)) == [(0, 45, 0, 45, 45), (100, 145, 100, 145, 45)]


def test_repeated_runs_of_words_are_found(spark):
    dice = random.Random(15)
    templates = [words(dice, 150, 10**5) for _ in range(4)]
    rows = []
    for d in range(120):
        text = words(dice, dice.randrange(30), 10**5)
        for _ in range(3):
            t = dice.choice(templates)
            at = dice.randrange(100)
            text += edited(dice, t[at : at + dice.randrange(20, 120)], dice.choice([0, 0, 0.02])) + words(dice, dice.randrange(40), 10**5)
        rows.append((d, text))
    got = passages.shared_passages(spark.createDataFrame([(d, " ".join(w)) for d, w in rows], "doc_id long, text string")).collect()
    held = {d: set() for d, _ in rows}
    for r in got:
        held[r["doc_id"]].update(range(r["start"], r["end"]))
    size, seen, runs = passages.LEAST_WORDS + passages.WINDOW - 1, set(), 0
    for d, w in rows:
        grams = [tuple(w[i : i + size]) for i in range(len(w) - size + 1)]
        for i, gram in enumerate(grams):
            if gram in seen:
                runs += 1
                assert held[d] >= set(range(i + passages.WINDOW - 1, i + size - passages.WINDOW + 1)), (d, i)
        seen.update(grams)
    assert runs > 1000


def test_a_repeated_word_has_few_seeds_in_every_window():
    dice = random.Random(18)
    for _ in range(50):
        text = [w for _ in range(20) for w in words(dice, 1, 5) * dice.choice([1, 3, 40, 100])]
        hashes = passages.word_hashes(" ".join(text).encode())
        grams = passages.shingles(hashes, passages.K)
        held = dict(zip(*(c.tolist() for c in passages.seeds(hashes)[::-1]), strict=True))
        for i in range(len(grams) - passages.WINDOW + 1):
            low = int(grams[i : i + passages.WINDOW].min())
            assert any(held.get(p) == low for p in range(i, i + passages.WINDOW)), i
    _, place = passages.seeds(passages.word_hashes(b"the " * 200))
    assert len(place) <= 20 and place[0] == 0 and place[-1] >= 182


def test_texts_of_repeated_words_share_them(spark):
    rows = [(1, "the " * 60 + "end"), (2, "so " + "the " * 200)]
    got = passages.shared_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {p for r in got for p in range(r["start"], r["end"])} >= set(range(2, 200))


def test_every_two_documents_with_a_passage_have_it(spark):
    dice = random.Random(20)
    passage = words(dice, 70, 10**5)
    # A copy of the passage in other words, one with words changed, and a text that three documents have.
    rows = [words(dice, 30, 10**6) + passage + words(dice, 30, 10**6) for _ in range(6)]
    rows += [words(dice, 30, 10**6) + edited(dice, passage, 0.03) for _ in range(3)] + [rows[2], rows[2]]
    got = passages.shared_passages(spark.createDataFrame([(d, " ".join(w)) for d, w in enumerate(rows)], "doc_id long, text string")).collect()
    assert {(r["doc_id"], r["src_doc_id"]) for r in got} == {(d, s) for d in range(len(rows)) for s in range(d)}
    whole = {(r["doc_id"], r["src_doc_id"]): r for r in got if r["equal"] == len(rows[2])}
    assert set(whole) == {(9, 2), (10, 2), (10, 9)}
    assert all((r["start"], r["end"], r["src_start"], r["src_end"]) == (0, 130, 0, 130) for r in whole.values())
    for r in got:
        # The words beside the passage are nowhere else.
        if r["doc_id"] < 6:
            assert (r["start"], r["end"], r["src_start"], r["src_end"], r["equal"]) == (30, 100, 30, 100, 70)


def test_shards_of_passages_change_nothing(spark, monkeypatch):
    dice = random.Random(21)
    passage = words(dice, 300, 10**5)
    rows = [(d, " ".join(words(dice, 20, 10**6) + edited(dice, passage, 0.02))) for d in range(12)]
    docs = spark.createDataFrame(rows + [(20, rows[3][1])], "doc_id long, text string")
    whole = sorted(map(tuple, passages.shared_passages(docs).collect()))
    monkeypatch.setattr(passages, "SEEDS", 20)
    monkeypatch.setattr(passages, "SHARD_WORDS", 500)
    found = passages._all_seeds(passages._rows(docs, "doc_id", "text"), 6, 12, 40, 60)
    assert found.rdd.getNumPartitions() > int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert sorted(map(tuple, passages.shared_passages(docs).collect())) == whole and len(whole) >= 78


def test_a_line_of_many_texts_makes_no_matches(spark):
    dice = random.Random(19)
    line = words(dice, 13, 10**5)
    rows = [(d, " ".join([*words(dice, 30, 10**6), *line, *words(dice, 30, 10**6)])) for d in range(40)]
    found = passages._all_seeds(passages._rows(spark.createDataFrame(rows, "doc_id long, text string"), "doc_id", "text"), 6, 12, 40, 60)
    assert passages.unpack(iter(found.select("hash").toArrow().to_batches()), {"hash": "<u8"})["hash"].size > 20
    assert passages._matches(found, 6, 40).count() == 0


def test_passages_of_odd_rows(odd_docs, no_docs):
    got = passages.shared_passages(odd_docs).collect()
    assert {(r["doc_id"], r["src_doc_id"]) for r in got} == {(10, 9)}
    assert max(r["end"] for r in got) >= 29_990
    assert passages.shared_passages(no_docs).count() == 0
