"""URL filter, secret scan, embeddings, language ID, mixing, packing and the pipeline."""

import hashlib
import itertools
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest
from tables import odd_texts, roots, words
from pyspark.sql import functions as F

import corpus_pipeline
from braid.llm import embeddings, languages, mixing, packing, secrets, urls

# ---- urls -----------------------------------------------------------------------------

URLS = [
    ("http://EXAMPLE.com/en/1?x#y", "example.com", "/en/1", "example.com/en/", "block"),
    ("https://www.example.com/en/1", "www.example.com", "/en/1", "www.example.com/en/", "allow"),
    ("https://notexample.com/en/1", "notexample.com", "/en/1", "com/", "allow"),
    ("https://a.example.com", "a.example.com", "", None, "allow"),
    ("x://b.net/es/", "b.net", "/es/", "net/es/", "block"),
    ("x://b.net/ES/", "b.net", "/ES/", None, "allow"),
    ("no scheme/com/", "", "", None, "allow"),
    (None, "", "", None, "allow"),
    ("", "", "", None, "allow"),
    ("a://b://c.com/x", "b:", "//c.com/x", None, "allow"),
    ("a://ÄB.com/\nq", "Äb.com", "/\nq", "com/", "allow"),
    ("a://h.com?z/", "h.com", "", None, "allow"),
]


def test_rules_and_parts(spark):
    df = spark.createDataFrame([(i, u[0], None) for i, u in enumerate(URLS)], "page_id long, url string, html string")
    got = {r["page_id"]: tuple(r)[1:5] for r in urls.judge_pages(df).collect()}
    assert got == {i: tuple(u[1:]) for i, u in enumerate(URLS)}


def test_blocks_follow_aliases_and_allow_precedes(spark):
    link = '<html><head><LINK href="{}" rel=canonical></head>'
    refresh = "<meta http-equiv='refresh' content='0; url={}'>"
    pages = [
        (1, "http://a.org/x", link.format("http://b.net/fr/1")),
        (2, "http://b.net/fr/1", ""),
        (3, "http://c.org/y", refresh.format("http://a.org/x/")),
        (4, "http://d.org/z", link.format("http://e.net/es/9")),
        (5, "http://f.org/q", link.format("http://d.org/z.html?a=1")),
        (6, "http://g.org/1", link.format("http://h.com/")),
        (7, "http://i.org/1", link.format("http://g.org/1")),
        (8, "http://j.net/fr/2", link.format("http://g.org/1")),
        (9, "http://k.org/1", link.format("/2")),
        (10, "http://k.org/2", None),
        (10, "http://k.org/2", None),
    ]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").withColumn("host", F.lit("clash")).withColumn("component", F.lit(1))
    log = spark.createDataFrame([("http://l.org/1", "http://b.net/fr/1"), ("http://k.org/2", "http://l.org/1"), (None, "x")], "src string, dst string")
    got = urls.judge_pages(df, links=log).collect()
    assert len(got) == len(pages)
    verdict = {r["page_id"]: r["verdict"] for r in got}
    # Pages 9 and 10 lead to a blocked page by the redirect log; pages 6 to 8 to an allowed one.
    assert verdict == {1: "block", 2: "block", 3: "block", 4: "block", 5: "block", 6: "allow", 7: "allow", 8: "block", 9: "block", 10: "block"}
    assert urls.judge_pages(df.limit(0)).count() == 0
    with pytest.raises(ValueError):
        urls.judge_pages(df, [urls.Rule("block", f"h{i}", "/") for i in range(1001)])


# ---- secrets --------------------------------------------------------------------------

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)


def base_spans(text):
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    out += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 24]
    return sorted(out)


SECRETS = [
    "token:token:abcdefgh",
    'x API_KEY" = "0123456789abcdef0123456789abcdef" 𝔘 password=short pass',
    "secret = abc",
    "AKIAAKIA" + "Z" * 14 + " AKIA AKIA" + "9" * 16,
    "é" * 50 + "apikey:'" + "f" * 30 + "'",
    "passwd:\nabcdefgh PASSWORD  :  AbCdEf==",
    "ſecret=abcdefgh to\u212aen=abcdefgh",
    "username: bob " + "x" * 150 + " pwd = hunter22",
    "username: bob " + "x" * 300 + " pwd = hunter22",
    "see https://example.com/a and user=carol with auth: abcdef123",
    "see https://example.com/a only",
    "deadbeef" * 2000,
]


def test_base_spans_equal_brute_force(spark):
    dice = random.Random(3)
    atoms = ["password", "api_key", "token", "=", ":", " ", "'", '"', "abc", "AKIA", "QQQQQQQQQQQQQQQQ", "0123456789abcdef", "ffffffffff", "é", "\n", "secret"]
    texts = [*SECRETS, *odd_texts(), *["".join(dice.choice(atoms) for _ in range(40)) for _ in range(150)]]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: [(s["start"], s["kind"], s["end"]) for s in r["spans"]] for r in secrets.scan(df).collect()}
    for i, t in enumerate(texts):
        assert [s for s in got[i] if s[1] < 3] == base_spans(t or ""), t
    of = lambda i: {secrets.KINDS[s[1]] for s in got[i]}
    assert of(7) == {"identifier", "key"} and of(8) == set()
    assert of(9) == {"identifier", "key", "endpoint"} and of(10) == set()


def test_secrets_of_odd_rows(odd_docs, no_docs):
    assert secrets.scan(odd_docs).count() == odd_docs.count()
    assert secrets.scan(no_docs).count() == 0


def test_redaction(spark):
    df = spark.createDataFrame(list(enumerate(SECRETS)), "doc_id long, text string")
    rows = secrets.scan(df).join(df, "doc_id").select("doc_id", "text", "spans", secrets.redacted(F.col("text"), F.col("spans")).alias("clean")).collect()
    for r in rows:
        want, at = "", 0
        for s in sorted((s["start"], s["end"]) for s in r["spans"]):
            if s[0] >= at:
                want += r["text"][at : s[0]] + "[secret]"
            at = max(at, s[1])
        assert r["clean"] == want + r["text"][at:]
        assert not base_spans(r["clean"].replace("[secret]", ""))


# ---- embeddings -----------------------------------------------------------------------


def test_embedding_links_equal_brute_force(spark):
    dice = np.random.default_rng(5)
    base = dice.standard_normal((40, 24))
    rows = [b + dice.standard_normal(24) * s for b in base for s in (0, 0.2, 0.35, 0.45, 0.5)]
    rows += [rows[0]] * 6 + [rows[0] * 3, -rows[0], rows[1] * 1e200, rows[1] * 1e-200, rows[2] * 1e-314, rows[3] * 1e-316]
    got = embeddings.near_vectors(spark.createDataFrame([(i + 10, r.tolist()) for i, r in enumerate(rows)], "vec_id long, embedding array<double>"), slab=40, block=8)
    unit = np.array([r / np.abs(r).max() for r in rows])
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    near = unit @ unit.T >= 0.9
    pairs = [(i, j) for i, j in itertools.combinations(range(len(rows)), 2) if near[i, j]]
    low = roots(len(rows), pairs)
    want = {i + 10: (int(near[i].sum()) - 1, low[i] + 10, low[i] == i) for i in range(len(rows))}
    assert {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in got.collect()} == want


def test_unsound_vectors_link_with_nothing(spark):
    nan, inf = float("nan"), float("inf")
    vectors = [None, [], [0.0, 0.0], [nan, 1.0], [inf, 1.0], [1.0, None], [1.0, 1.0], [1.0, 1.0], [1.0, 1.0, 0.0], [2.0, 2.0, 0.0], [-0.0, 1.0], [0.0, 1.0]]
    df = spark.createDataFrame(list(enumerate(vectors)), "vec_id long, embedding array<float>").withColumn("node", F.lit(1))
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in embeddings.near_vectors(df).collect()}
    assert all(got[i] == (0, i, True) for i in range(6))
    assert got[6] == (1, 6, True) and got[7] == (1, 6, False)
    assert got[8] == (1, 8, True) and got[9] == (1, 8, False)
    assert got[10] == (1, 10, True) and got[11] == (1, 10, False)
    assert embeddings.near_vectors(df.limit(0)).count() == 0


def test_near_pairs_lose_none():
    dice = np.random.default_rng(1)
    a = dice.standard_normal((300, 30))
    b = np.concatenate([a[:150] + dice.standard_normal((150, 30)) * 0.4, dice.standard_normal((50, 30))])
    i, j = embeddings.near_pairs(a, b, 0.9, 7, 64)
    cosine = (a / np.linalg.norm(a, axis=1, keepdims=True)) @ (b / np.linalg.norm(b, axis=1, keepdims=True)).T
    assert set(zip(i.tolist(), j.tolist(), strict=True)) == set(zip(*(x.tolist() for x in np.nonzero(cosine >= 0.9)), strict=True))


# ---- languages ------------------------------------------------------------------------

SYLLABLES = {"en": "the ing and tion wh sh ed".split(), "fr": "eau eux la é que oi è".split(), "de": "sch ung ein ä der zu ß".split()}


def prose(dice, lang, n):
    return " ".join("".join(dice.choice(SYLLABLES[lang]) for _ in range(dice.randrange(1, 4))) for _ in range(n)).capitalize()


def test_language_accuracy_and_held_out(spark):
    dice = random.Random(7)
    rows = [(i, prose(dice, lang := dice.choice(list(SYLLABLES)), dice.randrange(1, 80)), lang) for i in range(600)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = languages.train(df)
    marked = df.withColumn("held_out", languages.held_out(F.col("doc_id")))
    got = languages.classify(marked, model).collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in got)
    tested = [r for r in got if r["held_out"]]
    assert sum(r["lang_pred"] == r["lang"] for r in tested) >= 0.97 * len(tested)
    assert all(0 <= r["score"] <= 1 for r in got)
    # The labels of held-out rows and other columns play no part.
    other = df.withColumn("lang", F.when(languages.held_out(F.col("doc_id")), "xx").otherwise(F.col("lang")))
    again = languages.train(other)
    assert again.languages == model.languages and all((a == b).all() for a, b in zip(again.weights, model.weights, strict=True))


def test_scores_are_those_of_the_kernel():
    """The summed weights give the same as kernels with every landmark."""
    dice = random.Random(2)
    examples = [(lang, languages.presence(prose(dice, lang, 30))) for lang in SYLLABLES for _ in range(12)]
    model = languages.fit(examples, landmarks=4)
    text = prose(dice, "fr", 25)
    runs = languages.presence(text)
    by_size = [runs[(runs >= at) & (runs < at + languages.CODES**n)] for at, n in zip(languages._OFFSETS, languages.SIZES, strict=True)]
    score = model.bias + sum(w[model.columns[r]].sum(0) / np.sqrt(len(r)) for w, r in zip(model.weights, by_size, strict=True))
    e = np.exp(languages.SHARPNESS * (score - score.max()))
    lang, share = languages.predict(model, [text])[0]
    assert lang == model.languages[int(np.argmax(score))] == "fr" and abs(share - e.max() / e.sum()) < 1e-4


def test_languages_of_odd_rows(odd_docs, no_docs):
    model = languages.train(odd_docs)
    assert model.languages == ["en"]
    got = languages.classify(odd_docs, model)
    assert got.columns.count("score") == 1
    by_id = {r["doc_id"]: r for r in got.collect()}
    assert [by_id[i]["lang_pred"] for i in (0, 1, 2, 13)] == ["und"] * 4 and by_id[0]["score"] == 0
    assert by_id[11]["lang_pred"] == "en"
    nothing = languages.train(no_docs)
    assert nothing.languages == [] and languages.classify(no_docs, nothing).count() == 0
    assert {r["lang_pred"] for r in languages.classify(odd_docs, nothing).collect()} == {"und"}


# ---- mixing ---------------------------------------------------------------------------


def corpus_with_labels(spark, n=400):
    dice = random.Random(4)
    rows, labels = [], []
    for i in range(n):
        kind = dice.choice(["toxic", "poor", "good", "good", "good"])
        text = words(dice, dice.randrange(20, 90))
        if kind == "toxic":
            text += ["nasty", "vile"]
        if kind == "poor":
            text = [w + "###" for w in text]
        dice.shuffle(text)
        rows.append((i, " ".join(text), kind))
        if i % 2:
            labels.append((i, int(kind == "good"), int(kind == "toxic")))
    labels += [(1, 1, 0), (10**6, 1, 0), (None, 1, 0), (2, None, None)]
    return spark.createDataFrame(rows, "doc_id long, text string, kind string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_rates_meet_the_targets(spark):
    docs, labels = corpus_with_labels(spark)
    mixed = mixing.mix(docs, labels).collect()
    assert len(mixed) == docs.count() and min(r["rate"] for r in mixed) >= 0
    right = sum(r["domain"] == r["kind"] for r in mixed)
    assert right >= 0.95 * len(mixed)
    sums = np.zeros(3)
    for r in mixed:
        assert abs(sum(r["p"]) - 1) < 1e-9
        sums += r["rate"] * r["n_tokens"] * np.array(r["p"])
    share = dict(zip(mixing.TARGETS, sums / sums.sum(), strict=True))
    assert all(abs(share[d] - t) < 0.03 for d, t in mixing.TARGETS.items())
    assert np.mean([r["rate"] for r in mixed if r["kind"] == "toxic"]) < 0.1 < 0.8 < np.mean([r["rate"] for r in mixed if r["kind"] == "good"])


def test_projected_gradient_against_dense_solution(spark):
    """The gaps are as small as a long plain projected gradient makes them."""
    dice = np.random.default_rng(3)
    p = dice.dirichlet([0.5, 0.5, 0.5], 80)
    t = dice.integers(1, 500, 80).astype(float)
    members = spark.createDataFrame([(int(a), b.tolist()) for a, b in zip(t, p, strict=True)], "n_tokens long, p array<double>")
    targets = [0.7, 0.25, 0.05]
    _, now, goal = mixing.fit_rates(members, targets, 60, 1e-9)
    a = p * t[:, None]
    rate = np.ones(80)
    for _ in range(20000):
        rate = np.maximum(0, rate - a @ (a.T @ rate - goal) / np.linalg.norm(a, 2) ** 2)
    assert np.abs(now - goal).sum() <= np.abs(a.T @ rate - goal).sum() + 1e-2 * goal.sum()


def test_mixing_of_odd_rows(spark, odd_docs, no_docs):
    _, labels = corpus_with_labels(spark, 20)
    got = mixing.mix(odd_docs, labels).collect()
    assert len(got) == odd_docs.count() and all(r["rate"] >= 0 for r in got)
    assert mixing.mix(odd_docs, labels.limit(0)).count() == odd_docs.count()
    assert mixing.mix(no_docs, labels).count() == 0


@pytest.mark.parametrize(
    ("page", "target", "want"),
    [
        ("http://h.org/a/b.html", "page2.html", "http://h.org/a/page2.html"),
        ("http://h.org/a/b.html", "../x", "http://h.org/x"),
        ("http://h.org/a/b/", "../../../x/./y/..", "http://h.org/x/"),
        ("http://h.org/a/b?q=1", "?p=2", "http://h.org/a/b?p=2"),
        ("http://h.org", "x?u=http://k.org/", "http://h.org/x?u=http://k.org/"),
        ("http://h.org/a", "/x/../y", "http://h.org/y"),
        ("http://h.org/a", "https://k.org/z", "https://k.org/z"),
        ("http://h.org/a", "mailto:x@h.org", None),
    ],
)
def test_targets_of_pages_are_resolved(spark, page, target, want):
    html = f"<link rel='canonical' href='{target}'>"
    got = urls.page_links(spark.createDataFrame([(page, html)], "url string, html string")).collect()
    assert [r["dst"] for r in got] == ([want] if want else [])


def test_a_relative_canonical_link_carries_a_decision(spark):
    rows = [(1, "http://h.org/a/old.html", "<link rel='canonical' href='../en/new'>"), (2, "http://h.org/en/new", "")]
    got = urls.judge_pages(spark.createDataFrame(rows, "page_id long, url string, html string"), [urls.Rule("block", "h.org", "/en/")]).collect()
    assert {r["page_id"]: r["verdict"] for r in got} == {1: "block", 2: "block"}


# ---- packing --------------------------------------------------------------------------


def tokenizer_path():
    return pytest.importorskip("public_tokenizers").path("word_bpe_49k.json")


def test_word_tokens_equal_the_tokenizers(monkeypatch):
    from tokenizers import Tokenizer

    monkeypatch.setattr(packing, "REMEMBERED", 20)
    own = packing.WordTokens(tokenizer_path())
    plain = Tokenizer.from_file(tokenizer_path())
    plain.encode_special_tokens = True
    texts = [t or "" for t in odd_texts()] + [
        "Don't I'll we've  İstanbul ΣΑΣ σας ﬁ ① ½ \u00a0x\u2003y\x1cz …).” “¿", "e\u0301 A\u030a <|endoftext|> \ufeff\u200b \u0301x", "a" * 5000, "日本語のテキスト 漢字", "\x00 \x07",
    ]
    for _ in range(2):
        for text, ids in zip(texts, own.ids([t.encode() for t in texts]), strict=True):
            assert ids.tolist() == plain.encode(text, add_special_tokens=False).ids, text[:40]


def check_packed(rows, window):
    places = defaultdict(list)
    for r in rows:
        places[r["sequence_id"]].append((r["offset"], r["length"]))
    for own in places.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= window
    return len(places)


def test_pieces_round_trip(spark, odd_docs):
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(tokenizer_path())
    docs = odd_docs.filter("doc_id IS NOT NULL").dropDuplicates(["doc_id"])
    rows = packing.pack(packing.tokenized_pieces(docs, tokenizer_path()), rounds=2).collect()
    check_packed(rows, packing.WINDOW)
    by_doc = defaultdict(list)
    for r in rows:
        by_doc[r["doc_id"]].append(r)
    for d in docs.collect():
        ids = np.array([*plain.encode(d["text"] or "", add_special_tokens=False).ids, 1], "<u4")
        own = sorted(by_doc[d["doc_id"]], key=lambda r: r["piece"])
        assert [r["piece"] for r in own] == list(range(-(-len(ids) // 4096)))
        for r in own:
            part = ids[r["start"] : r["start"] + r["length"]]
            assert r["start"] == 4096 * r["piece"] and r["ids_crc32"] == zlib.crc32(part.tobytes()) and len(part) == r["length"]


def test_special_tokens_in_a_text_have_their_ids(spark):
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(tokenizer_path())
    texts = ["One text<|endoftext|>and the next", "<|startoftext|> a b <|endoftext|>", "in capitals <|ENDOFTEXT|>", "nothing special", ""]
    rows = packing.tokenized_pieces(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), tokenizer_path()).collect()
    want = {}
    for d, text in enumerate(texts):
        ids = np.array([*plain.encode(text, add_special_tokens=False).ids, 1], "<u4")
        want[d] = (0, 0, len(ids), zlib.crc32(ids.tobytes()))
    assert {r["doc_id"]: tuple(r)[1:] for r in rows} == want


@pytest.mark.parametrize(("block", "n"), [(4000, 600), (60, 600), (4000, 1)])
def test_packing_is_near_the_least_number(spark, block, n):
    dice = random.Random(block)
    rows = [(i // 2, i % 2, dice.choice([100, dice.randrange(1, 60), 37])) for i in range(n)] + [(None, None, 50), (None, None, 50)]
    got = packing.pack(spark.createDataFrame(rows, "doc_id long, piece int, length long"), window=100, block=block).collect()
    assert len(got) == len(rows) and sorted(r["length"] for r in got) == sorted(r[2] for r in rows)
    used = check_packed(got, 100)
    greedy = len(packing.best_fit([r[2] for r in rows], 100))
    assert used <= greedy * (1 if block > n else 1.03)


def test_packing_nothing(spark, no_docs):
    assert packing.pack(packing.tokenized_pieces(no_docs, tokenizer_path())).count() == 0


def test_crossover_and_mutation_keep_every_piece():
    dice = random.Random(1)
    sizes = [dice.randrange(1, 100) for _ in range(300)]
    a, b, *_ = packing.first_generation(sizes, 100, 4, dice)
    for bins in (a, b, packing.crossover(a, b, 100, dice), packing.mutate(b, 100, dice), *packing.evolve([a, b], 100, 5, dice)):
        assert sorted(s for x in bins for s in x) == sorted(sizes) and max(map(sum, bins)) <= 100


# ---- pipeline -------------------------------------------------------------------------


@pytest.fixture(scope="module")
def small_corpus(spark, tmp_path_factory):
    """Documents with planted copies, secrets and toxic texts, and their labels, as files."""
    dice = random.Random(12)
    rows, labels = [], []
    for i in range(300):
        lang = dice.choice(list(SYLLABLES))
        text = prose(dice, lang, dice.randrange(40, 120))
        kind = "toxic" if i % 10 == 3 else "clean"
        if kind == "toxic":
            text += " nasty vile" * 3
        if i % 25 == 1:
            text += " password: hunter2secret"
        rows.append((i, text, lang, "s", len(text)))
        if i % 2:
            labels.append((i, 1, int(kind == "toxic")))
    rows += [(1000 + i, rows[i][1], rows[i][2], "copy", 0) for i in range(0, 40, 4)]
    rows += [(2000 + i, rows[i][1] + " tail", rows[i][2], "near", 0) for i in range(1, 40, 4)]
    rows += [(3000, None, None, None, None), (3001, "", None, None, None), (3002, "!!! 123", "en", None, 0), (None, rows[0][1], None, None, None), (5, rows[5][1], "en", "s", 0)]
    path = tmp_path_factory.mktemp("corpus")
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return str(path), rows


def test_pipeline_stages(spark, small_corpus, tmp_path):
    path, rows = small_corpus
    docs = spark.read.parquet(f"{path}/documents.parquet")
    columns = docs.columns
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, path).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        kept[name] = docs.collect()
        if name != "packing":
            assert docs.columns == columns
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language", "near_duplicates", "secrets", "target_weights", "packing"]
    ids = {n: [r["doc_id"] for r in k] for n, k in kept.items()}
    clean = {r[0] for r in rows if r[0] is not None and r[0] < 300}
    assert clean <= set(ids["language"]) and not {3000, 3001, 3002} & set(ids["language"])
    # One of each group: the smallest id, of repeated rows one.
    assert sorted(ids["near_duplicates"]) == sorted(clean)
    texts = {r["doc_id"]: r for r in kept["secrets"]}
    assert sorted(texts) == sorted(clean) and "hunter2secret" not in " ".join(r["text"] for r in kept["secrets"])
    assert texts[1]["n_chars"] == len(texts[1]["text"]) and texts[1]["text"].endswith("[secret]")
    assert texts[2]["text"] == rows[2][1]
    toxic = {i for i in clean if i % 10 == 3}
    left = set(ids["target_weights"])
    assert len(left & toxic) <= 2 and len((clean - toxic) - left) <= 3
    assert set(ids["packing"]) == left
    check_packed(kept["packing"], packing.WINDOW)


def test_pipeline_run_and_empty_table(spark, small_corpus, tmp_path):
    path, _ = small_corpus
    assert corpus_pipeline.run(spark, path).count() > 200
    empty = spark.read.parquet(f"{path}/documents.parquet").limit(0)
    empty.write.parquet(str(tmp_path / "documents.parquet"))
    spark.read.parquet(f"{path}/labels.parquet").limit(0).write.parquet(str(tmp_path / "labels.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_stages_take_odd_rows(spark, odd_docs, small_corpus):
    path, _ = small_corpus
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, odd_docs, path)
        assert out.columns == odd_docs.columns, name
        assert out.count() <= odd_docs.count()


def test_digest_of_no_secret():
    assert hashlib.sha256(b"").hexdigest().startswith("e3b0c442")


def test_every_language_is_learned(spark):
    from braid.llm import languages

    letters = "abcdefghijklmnopqrstuvwxyz"
    rows = [(i, f"{letters[i % 26]}{letters[i // 26 % 26]}{letters[(i * 7) % 26]} " * 5, f"l{i % 230:03d}") for i in range(920)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    learned = {r["lang"] for r in docs.filter(~languages.held_out(docs.doc_id)).select("lang").distinct().collect()}
    assert len(learned) > 200 and set(languages.train(docs).languages) == learned
