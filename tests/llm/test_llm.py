"""The training-data operators against brute force, and on awkward input."""

import itertools
import random
import re
import tracemalloc
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from loomtrace.llm import catalog, classifier, minhash, packing, pii, toxicity
from loomtrace.llm.exact_dedup import exact_dedup
from loomtrace.llm.license_scan import BASE_PHRASES, TEMPLATES, inverse_frequencies, license_scan, vocabulary
from loomtrace.llm.pieces import Encoder, decode, encode
from loomtrace.llm.quality_rules import keep_good, quality_rules, repeated_words
from loomtrace.llm.url_filter import url_filter

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, label string, key string"
P = pytest.importorskip("public_tokenizers")

LONG = " ".join(f"w{i % 997}x{i}" for i in range(30_000))
AWKWARD = [
    (1, None, None), (2, "", "en"), (3, " \t\n", "en"), (4, LONG, "en"), (None, "one two three", None),
    (5, "the same words here", "en"), (6, "the same  words here", "en"), (7, "the same words here", "fr"),
    (7, "the same words here", "fr"), (8, "released under the MIT license.\nApache License, Version 2.0", "en"),
    (9, "mail jo.12@mail4.example.com or 4539578763621486, token = \"9c8b45435718dcc700c184a7e303cdc64c6a8f7f\"", "en"),
    (10, "\x00\x1c▁ 😀 é́", "de"),
]


@pytest.fixture(scope="module")
def awkward(spark):
    rows = [(i, t, g, "s", 0, "x", "y") for i, t, g in AWKWARD]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def texts():
    return duckdb.sql(f"SELECT doc_id, text FROM '{SF}/documents.parquet'").fetchall()


def by_id(df, key="doc_id"):
    return {r[key]: r.asDict() for r in df.collect()}


def labels(spark):
    return spark.createDataFrame([], "doc_id long, quality int, toxic int")


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_same_rows_as_sql(spark, name):
    import sys
    sys.path.insert(0, __file__.rsplit("/llm/", 1)[0])
    from compare import compare, connect

    same, *_ = compare(spark, SF, name, catalog.QUERIES[name], catalog.ORACLES[name], connect(SF))
    assert same


def test_awkward_and_empty_input(spark, awkward, empty):
    none = labels(spark)
    spec = packing.read_tokenizer(spark, P.path("word_bpe_49k.json"))
    with open(P.path("piece_bpe_32k.model"), "rb") as file:
        model = file.read()
    operators = {
        "quality": lambda d: classifier.quality_scores(d, none), "near": minhash.near_duplicates,
        "toxic": lambda d: toxicity.toxicity_scores(d, none), "license": license_scan, "exact": exact_dedup,
        "pii": pii.replace_pii, "rules": quality_rules, "pieces": lambda d: encode(d, model),
        "pack": lambda d: packing.pack(d, spec),
    }
    for name, operator in operators.items():
        assert operator(empty).count() == 0, name
        rows = operator(awkward).collect()
        if name == "pack":
            rows = [r for r in rows if r["piece"] == 0]
        assert sorted(r["doc_id"] or -1 for r in rows) == sorted(i or -1 for i, *_ in AWKWARD), name
    assert keep_good(empty).count() == 0
    clashing = awkward.withColumns({"ref_lang": F.lit(1), "ref_classes": F.lit(2), "kept": F.lit(3)})
    assert keep_good(clashing).count() == keep_good(awkward).count()
    assert keep_good(awkward).columns == awkward.columns


def test_exact_dedup_of_awkward_rows(awkward):
    rows = exact_dedup(awkward).collect()
    groups = {}
    for r in rows:
        groups.setdefault(r["text_sha256"], []).append(r)
    assert all(sum(r["kept"] for r in g) == 1 and {r["group_size"] for r in g} == {len(g)} for g in groups.values())
    found = {r["doc_id"]: r for r in rows}
    assert found[1]["keep_id"] == found[2]["keep_id"] == 3  # the longest original, white space only
    assert found[5]["keep_id"] == found[7]["keep_id"] == 6 and found[5]["group_size"] == 4


def test_repeated_words():
    rng = random.Random(3)
    for _ in range(300):
        words = [rng.choice("abc").encode() for _ in range(rng.randint(0, 30))]
        windows = [tuple(words[i:i + 5]) for i in range(len(words) - 4)]
        covered = {i + k for i, w in enumerate(windows) if windows.count(w) > 1 for k in range(5)}
        assert repeated_words(words) == len(covered)


def test_quality_rules_counts(spark, texts):
    rows = by_id(catalog.QUERIES["op10_quality_rules"](spark, SF))
    assert len(rows) == len(texts)
    for i, text in texts:
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        windows = [tuple(words[k:k + 5]) for k in range(len(words) - 4)]
        seen, covered = {}, set()
        for w in windows:
            seen[w] = seen.get(w, 0) + 1
        for k, w in enumerate(windows):
            if seen[w] > 1:
                covered.update(range(k, k + 5))
        lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        failed = len(words) < 10 or 100 * len(covered) > 20 * len(words)
        r = rows[i]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) == (
            len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)),
            len(covered), failed)
        assert not (failed and r["kept"])


@pytest.mark.parametrize("odd_texts", [[1], [0] * 60], ids=["one huge text", "a hot copied text"])
def test_quality_reference_withstands_odd_texts(spark, odd_texts):
    """Neither the length nor the copies of an odd text make it the norm of its language."""
    rng = random.Random(2)
    words = "der Hund und die Katze gehen mit dem alten Mann auf einem Weg zu einer Brücke nicht weit von hier".split()
    good = [(i, " ".join(rng.choice(words) for _ in range(150)), "de") for i in range(40)]
    numbers = " ".join(str(rng.randrange(10**6)) for _ in range(60_000))
    odd = [(100 + i, numbers if huge else numbers[:5_000], "de") for i, huge in enumerate(odd_texts)]
    found = by_id(quality_rules(spark.createDataFrame(good + odd, "doc_id long, text string, lang string")))
    assert all(found[i]["kept"] for i, *_ in good) and not any(found[i]["kept"] for i, *_ in odd)


def test_quality_of_a_language_without_usual_texts(spark):
    rng = random.Random(2)
    rows = [(i, " ".join(rng.choice(["the", "cat", "and", "dog", "walk"]) + str(rng.random())[-1] for _ in range(150)), "en")
            for i in range(5)] + [(9, "7 7 7 " * 40, "xx")]
    found = by_id(quality_rules(spark.createDataFrame(rows, "doc_id long, text string, lang string")))
    assert found[9]["class_distance"] > 0.2 and not found[9]["kept"]


def shingles(text, width):
    words = text.encode().lower().split()
    return {tuple(words[i:i + width]) for i in range(max(1, len(words) - width + 1))} if words else set()


def components(sets, percent=80):
    parent = {i: i for i in sets}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in itertools.combinations(sorted(sets), 2):
        shared = len(sets[a] & sets[b])
        if sets[a] and sets[b] and 100 * shared >= percent * (len(sets[a]) + len(sets[b]) - shared):
            parent[max(root(a), root(b))] = min(root(a), root(b))
    return {i: root(i) for i in sets}


def test_near_duplicates(spark, texts):
    rows = by_id(minhash.op2_minhash(spark, SF))
    sets = {i: shingles(t, 4) for i, t in texts}
    assert {i: r["n_shingles"] for i, r in rows.items()} == {i: len(s) for i, s in sets.items()}
    assert {i: r["component_id"] for i, r in rows.items()} == components(sets)
    assert all(r["kept"] == (r["component_id"] == i) for i, r in rows.items())


@pytest.mark.parametrize("dense", [0, 4])
def test_near_duplicates_of_chains_and_lookalikes(spark, monkeypatch, dense):
    """A family in a chain, and texts that share a long passage without being similar enough."""
    rng = random.Random(5)
    base = [f"b{i}" for i in range(60)]
    docs, words = [], list(base)
    for i in range(12):  # each differs a little from the one before
        docs.append((i, " ".join(words)))
        words = words[2:] + [f"n{i}a", f"n{i}b"]
    passage = [f"p{i}" for i in range(70)]
    docs += [(100 + i, " ".join(passage + [f"q{rng.random()}" for _ in range(25)])) for i in range(15)]
    monkeypatch.setattr(minhash.links_of, "__defaults__", (dense,))
    found = by_id(minhash.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string"), width=4))
    assert {i: r["component_id"] for i, r in found.items()} == components({i: shingles(t, 4) for i, t in docs})


def test_near_dedup_keeps_one_row_without_or_with_repeated_ids(spark, tmp_path):
    base = [f"w{i}" for i in range(200)]
    rows = [(None, " ".join(base)), (None, " ".join(base[1:])), (None, " ".join(base)),
            (7, " ".join(f"v{x}" for x in base)), (7, " ".join(f"v{x}" for x in base[1:])), (7, " ".join(f"v{x}" for x in base)),
            (None, " ".join(f"u{x}" for x in base))]
    spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).write.parquet(str(tmp_path / "docs"))
    left = corpus_pipeline.near(spark, spark.read.parquet(str(tmp_path / "docs")), SF).collect()
    assert sorted((r["doc_id"] or -1, r["text"][0]) for r in left) == [(-1, "u"), (-1, "w"), (7, "v")]


def test_prefix_buckets_hold_every_similar_pair(spark):
    rng = random.Random(1)
    sets = [(i, sorted(rng.sample(range(40), rng.randint(5, 25)))) for i in range(60)]
    frame = spark.createDataFrame(sets, "node long, shingles array<long>")
    buckets = {}
    for r in minhash._prefix_buckets(frame, frame.select("node"), 80).collect():
        buckets.setdefault(r["key"], set()).add(r["node"])
    for (a, x), (b, y) in itertools.combinations(sets, 2):
        shared = len(set(x) & set(y))
        if 100 * shared >= 80 * (len(x) + len(y) - shared):
            assert any({a, b} <= nodes for nodes in buckets.values())


def test_packing_plan():
    for seed in range(200):
        rng = random.Random(seed)
        capacity = rng.choice([6, 10, 21])
        counts = {k: rng.randint(0, 5) for k in range(1, capacity + 1)}
        have = {}
        for pattern, copies in packing.plan(counts, capacity):
            assert sum(pattern) <= capacity and copies > 0
            assert sum(3 * k > capacity for k in pattern) <= 2
            for k in pattern:
                have[k] = have.get(k, 0) + copies
        assert have == {k: n for k, n in counts.items() if n}


def test_packed_ids(spark, texts):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    rows = packing.op3_best_fit_packing(spark, SF).toPandas()
    packed = rows.sort_values(["sequence_id", "offset"])
    ends = packed.groupby("sequence_id")["length"].cumsum()
    assert ((ends - packed["length"]) == packed["offset"]).all() and ends.max() <= 2048
    least = -(-int(rows["length"].sum()) // 2048)
    assert rows["sequence_id"].nunique() <= least * 1.02 + 1
    own = {k: g for k, g in rows.sort_values("piece").groupby("doc_id")}
    for i, text in texts:
        ids = np.array(tokenizer.encode(text, add_special_tokens=False).ids + [0], dtype="<u4")
        cuts = list(range(0, len(ids), 2048))
        assert own[i]["start"].tolist() == cuts
        assert own[i]["ids_crc32"].tolist() == [zlib.crc32(ids[c:c + 2048].tobytes()) for c in cuts]


def test_word_tokens_of_odd_texts():
    from tokenizers import Tokenizer

    with open(P.path("word_bpe_49k.json"), encoding="utf-8") as file:
        tokens = packing.WordTokens(file.read())
    plain = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    odd = ["", "a\x1cb", "it's I'LL", "x<|endoftext|>y", "É é ΣΑΣ", "a b c\u0085d", "12 3,4;--- _x_"]
    assert [i.tolist() for i in tokens.ids(odd)] == [plain.encode(t, add_special_tokens=False).ids for t in odd]


def test_word_tokens_remember_few_words(monkeypatch):
    """Within one batch too; and a task may have words of its own, which do not stay in its worker."""
    monkeypatch.setattr(packing, "CACHE", 100)
    monkeypatch.setattr(packing, "SPLIT_CHARS", 200, raising=False)
    with open(P.path("word_bpe_49k.json"), encoding="utf-8") as file:
        spec = file.read()
    many = [" ".join(f"word{i}x{j}" for j in range(10)) for i in range(200)]
    kept = packing._worker_tokens(spec)
    tokens = kept.without_words()
    found = [i.tolist() for i in tokens.ids(many)]
    assert found == [tokens.tokenizer.encode(t, add_special_tokens=False).ids for t in many]
    assert len(tokens.known) + len(tokens.older) < 600
    assert kept.tokenizer is tokens.tokenizer and kept.known is not tokens.known and "word199x9" not in kept.known


def test_pieces_equal_the_library(spark, texts, awkward):
    from sentencepiece import SentencePieceProcessor

    with open(P.path("piece_bpe_32k.model"), "rb") as file:
        model = file.read()
    library, encoder = SentencePieceProcessor(model_proto=model), Encoder(model)
    rng = random.Random(1)
    many = [t for _, t in texts] + ["".join(rng.choice(" abcthe,.\néñ日\x00\x01\t▁Z9") for _ in range(rng.randint(0, 60)))
                                    for _ in range(500)]
    for text, ids in zip(many, encoder.encode(many), strict=True):
        assert ids.tolist() == library.encode(text)
        assert encoder.decode(ids) == text.replace("▁", " ")
    back = decode(encode(awkward, model), model).collect()
    assert sorted(r["text"] for r in back) == sorted((t or "").replace("▁", " ") for _, t, _ in AWKWARD)


def test_license_places(spark, texts):
    rows = by_id(catalog.QUERIES["op5_license_scan"](spark, SF))
    for i, text in texts:
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))
        places, found = [], set()
        for phrase, label in BASE_PHRASES.items():
            p = phrase.split()
            here = [k for k in range(len(words) - len(p) + 1) if words[k:k + len(p)] == p]
            places += here
            found |= {label} if here else set()
        r = rows[i]
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) == (
            len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(found)))
        assert found <= set(r["labels"].split(","))


def test_surrogates():
    s = pii.Surrogates(b"key")
    for size in (2, 3, 10, 257):
        moved = [s.moved(b"t", v, size) for v in range(size)]
        assert sorted(moved) == list(range(size)) and all(a != b for a, b in enumerate(moved))
    text = "Mr. James Kant, jo.12@mail4.example.com, 4539578763621486, 10.1.2.3, +1 (017) 555-7713; JO.12@MAIL4.example.com"
    new, pairs = pii.replace_entities(text, s)
    kinds = [k for k, *_ in pairs]
    assert kinds == ["name", "email", "card", "ip", "phone", "email"]
    assert pairs[1][2].lower() == pairs[5][2].lower() != pairs[1][1]
    assert pii._luhn([c for c in pairs[2][2] if c.isdigit()]) == 0
    assert not any(old in new for _, old, _ in pairs)
    assert pii.replace_entities("nothing here, 12 of 1999", s) == ("nothing here, 12 of 1999", [])
    assert pii.replace_entities(text, pii.Surrogates(b"other"))[0] != new


def test_surrogates_keep_to_one_person_and_format():
    s = pii.Surrogates(b"key")

    def new(text):
        return pii.replace_entities(text, s)[0]

    text = new("Mr. James Kant left. Kant said James was ill; JAMES KANT, kant and the kantian")
    title, given, family, *_ = text.split(" ")
    assert text == f"Mr. {given} {family} left. {family} said {given} was ill; {given.upper()} {family.upper()}, {family.lower()} and the kantian"
    assert {given, family}.isdisjoint({"James", "Kant"})
    assert "correcthorsebattery" not in new('password = "correcthorsebattery"')
    assert new("the password is required here, token: something") == "the password is required here, token: something"
    assert "abcdefghijklmnopqrst" not in new("Authorization: Bearer abcdefghijklmnopqrst")
    for address in ("2001:0db8:85a3:0000:0000:8a2e:0370:7334", "fe80::1ff:fe23:4567:890a"):
        other = new(f"at {address}.")[3:-1]
        assert other != address and [c == ":" for c in other] == [c == ":" for c in address]
    assert new("at 12:30:45 and 10:20") == "at 12:30:45 and 10:20"
    iban = new("to DE89 3704 0044 0532 0130 00 now")[3:-4]
    number = iban.replace(" ", "")
    assert pii._mod_97(number[4:] + number[:4]) == 1 and iban != "DE89 3704 0044 0532 0130 00" and iban.count(" ") == 5
    assert len({new(f"DE{98 - pii._mod_97(f'{n:018d}DE00'):02d}{n:018d}") for n in range(50)}) == 50


def brute_license(words, idf, template, min_share=0.7):
    """The best share of a template over all places, with all its mandatory phrases in place."""
    want, total, best = template.words, sum(idf[w] for w in template.words) or 1.0, 0.0
    for start in range(-len(want) + 1, len(words)):
        found = [words[start + i] if 0 <= start + i < len(words) else "" for i in range(len(want))]
        if all(f" {p} " in f" {' '.join(found)} " for p in template.mandatory):
            best = max(best, sum(idf[w] for w, f in zip(want, found, strict=True) if w == f) / total)
    return best


def test_license_templates_against_brute_force(spark):
    rng = random.Random(4)
    rows = [(0, "Permission is hereby granted, free of charge, to any person getting a copy of this "
                "software and linked documentation files"), (1, "version 2 of the apache license"), (2, None), (3, "")]
    for i in range(4, 60):
        words = []
        for t in rng.sample(TEMPLATES, 2):
            words += [w if rng.random() < 0.85 else rng.choice(["zzz", "license", "the"]) for w in t.words] + ["and"] * rng.randint(0, 2)
        rows.append((i, " ".join(words)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    idf = inverse_frequencies(docs, vocabulary())
    found = by_id(license_scan(docs))
    assert found[0]["labels"] == "mit" and found[0]["score"] < 1
    for i, text in rows:
        words = re.findall("[a-z0-9]+", (text or "").lower())
        shares = [brute_license(words, idf, t) for t in TEMPLATES]
        labels = set(found[i]["base_labels"].split(",")) | {t.label for t, s in zip(TEMPLATES, shares, strict=True) if s >= 0.7}
        assert set(found[i]["labels"].split(",")) - {""} == labels - {""}
        assert found[i]["n_base"] or abs(found[i]["score"] - min(1, max(shares))) < 1e-9


def test_no_surrogates_collide(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert pii.collisions(pii.entity_pairs(docs)).isEmpty()
    made = spark.createDataFrame([("ip", "a", "x"), ("ip", "b", "x"), ("ip", "c", "y")], "kind string, entity string, surrogate string")
    assert [r["value"] for r in pii.collisions(made).collect()] == ["x"]


def test_url_filter_over_time(spark):
    captures = spark.createDataFrame(
        [(1, "http://a.bad.com/x?q=1", "2020-01-01"), (2, "http://A.BAD.com/x", "2020-02-01"), (3, "http://bad.com", "2021-06-01"),
         (4, None, "2020-02-01"), (5, "http://good.org/p/", "2020-02-01"), (5, "http://good.org/p/", None)],
        "page_id long, url string, fetched_on string")
    entries = spark.createDataFrame(
        [("l", "bad.com", "2020-01-15", "add"), ("l", "bad.com", "2021-01-01", "remove"), ("m", "good.org/p", "2019-01-01", "add"),
         ("m", "good.org/p", "2020-02-01", "remove"), ("m", "good.org/p", "2020-02-01", "add"), ("n", None, "2020-01-01", "add")],
        "list_name string, key string, listed_on string, action string")
    found = sorted((r["page_id"], r["blocked"], r["lists"]) for r in url_filter(captures, entries).collect())
    assert found == [(1, False, ""), (2, True, "l"), (3, False, ""), (4, False, ""), (5, False, ""), (5, False, "")]
    assert url_filter(captures, entries.limit(0)).where("blocked").count() == 0
    assert url_filter(captures.limit(0), entries).count() == 0


def test_quality_model_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.01"
    rows = classifier.op1_quality_classifier(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").toPandas()
    held = rows[rows["held_out"]]
    assert (held["predicted"] == held["quality"]).mean() > 0.9
    assert rows["score"].between(0, 1).all()


def test_toxicity_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.1"
    docs = spark.read.parquet(f"{sf}/documents.parquet").where("doc_id < 3000")
    marks = spark.read.parquet(f"{sf}/labels.parquet")
    rows = toxicity.toxicity_scores(docs, marks).join(marks, "doc_id").toPandas()
    held = rows[rows["held_out"]]
    assert (held["predicted"] == held["toxic"]).mean() > 0.95


@pytest.mark.parametrize("sf, least", [("sf0.001", 0.4), ("sf0.01", 0.8)])
def test_toxicity_with_few_examples(spark, sf, least):
    """Plain cosine: at sf0.01 three of 18 held-out toxic texts hold no word tied to the label, and are not found."""
    marks = spark.read.parquet(f"/root/testdata/{sf}/labels.parquet")
    rows = toxicity.op4_toxicity(spark, f"/root/testdata/{sf}").join(marks, "doc_id").toPandas()
    held = rows[rows["held_out"] & (rows["toxic"] == 1)]
    assert (held["neighbours"].map(len) > 0).all() and held["predicted"].mean() >= least
    clean = rows[rows["held_out"] & (rows["toxic"] == 0)]
    assert sf == "sf0.001" or clean["predicted"].mean() < 0.03


def test_block_max_search_is_exact():
    rng = random.Random(2)
    for n, n_terms, longest in ((400, 30, 6), (400, 3000, 400), (3, 5, 2), (1, 1, 1)):
        vectors = []
        for _ in range(n):
            terms = sorted({int(n_terms * rng.random() ** 3) for _ in range(rng.randint(0, longest))})
            w = np.array([rng.random() for _ in terms])
            vectors.append((np.array(terms, dtype=np.int64), w / (np.sqrt((w * w).sum()) or 1)))
        ties = np.array([rng.choice([0, 0, 1.0]) for _ in range(n_terms)])
        index = toxicity.BlockMaxIndex(vectors, n_terms, ties)
        dense = np.zeros((n, n_terms))
        for i, (terms, w) in enumerate(vectors):
            dense[i, terms] = w
        for q, (found, cosines) in enumerate(index.nearest(vectors, 7)):
            full = (dense @ dense[q]).round(9)
            want = sorted((-s, i) for i, s in enumerate(full) if s > 0)[:7]
            assert found.tolist() == [i for _, i in want] and np.allclose(cosines, [-s for s, _ in want])
            assert np.allclose(index.tied_parts(vectors[q], found), (dense[found] * ties) @ dense[q])


def test_toxicity_neighbours_are_those_of_plain_cosine(spark, texts):
    """Terms, document frequencies, cosines and votes against brute force over all of sf0.001."""
    labels = dict(duckdb.sql(f"SELECT doc_id, toxic FROM '{SF}/labels.parquet'").fetchall())
    words = {i: re.findall(r"[^\W\d_]+", t.lower()) for i, t in texts}
    rows = by_id(toxicity.op4_toxicity(spark, SF))
    examples = [i for i, _ in sorted(texts) if labels.get(i) is not None and zlib.crc32(str(i).encode()) % 3 != 1]
    known = {w for i in examples for w in words[i]}
    df = {w: sum(w in set(words[i]) for i in words) for w in known}

    def vector(i):
        v = {w: (1 + np.log(words[i].count(w))) * (np.log((1 + len(texts)) / (1 + df[w])) + 1) for w in set(words[i]) & known}
        norm = np.sqrt(sum(x * x for x in v.values())) or 1
        return {w: x / norm for w, x in v.items()}

    vectors = {i: vector(i) for i in words}
    for i, v in vectors.items():
        full = sorted((-round(sum(x * vectors[e].get(w, 0) for w, x in v.items()), 9), e) for e in examples)
        want = [(e, -s) for s, e in full if s < 0][:toxicity.EVIDENCE]
        assert np.allclose(rows[i]["cosines"], [s for _, s in want], atol=2e-9)
        assert rows[i]["neighbours"] == [e for e, _ in want] or len({round(s, 7) for _, s in want}) < len(want)


def test_toxicity_labels_with_ties_nulls_and_repeats(spark):
    docs = spark.createDataFrame([(i, f"word{'abcdefghij'[i % 10]} common {'vile' if i % 2 else 'kind'}") for i in range(40)]
                                 + [(3, "word common vile"), (None, "vile")], "doc_id long, text string")
    marks = spark.createDataFrame([(i, i % 2) for i in range(40)] + [(3, 0), (3, None), (None, 1), (5, 1), (90, 1)],
                                  "doc_id long, toxic int")
    rows = toxicity.toxicity_scores(docs, marks).collect()
    assert len(rows) == 42 and all(0 <= r["score"] <= 1 for r in rows)
    vile = [r["score"] for r in rows if r["doc_id"] is not None and r["doc_id"] % 2]
    assert min(vile) > max(r["score"] for r in rows if r["doc_id"] is not None and r["doc_id"] % 2 == 0)
    assert toxicity.toxicity_scores(docs, marks.where("toxic IS NULL")).where("score <> 0.5").count() == 0


def test_pipeline_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        stage(spark, docs, SF).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        if name == "packing":
            break
        assert docs.columns == columns
        ids = {r["doc_id"] for r in docs.select("doc_id").collect()}
        own = {r["doc_id"]: r["text"] for r in before.collect()}
        if name == "exact_dedup":
            groups = {}
            for i, t in own.items():
                groups.setdefault(re.sub(r"[\x20\x09-\x0D]", "", t), []).append((-len(t), i))
            assert ids == {min(g)[1] for g in groups.values()}
        elif name == "near_dedup":
            assert ids == set(components({i: shingles(t, 5) for i, t in own.items()}).values())
        elif name == "pii":
            s = pii.Surrogates(pii.DEFAULT_KEY)
            assert {r["doc_id"]: r["text"] for r in docs.collect()} == {i: pii.replace_entities(t, s)[0] for i, t in own.items()}
            assert docs.where(F.char_length("text") != F.col("n_chars")).isEmpty()
        else:
            kept = {r["doc_id"] for r in quality_rules(before).where("kept").collect()}
            assert ids == kept
    assert {r["doc_id"] for r in docs.collect()} == {r["doc_id"] for r in before.collect()}
    assert sum(r["length"] for r in docs.collect()) > 0


def test_pipeline_of_an_empty_table(spark, tmp_path, empty):
    docs = empty.select("doc_id", "text", "lang", "source", "n_chars")
    for name, stage in corpus_pipeline.STAGES:
        docs.write.parquet(str(tmp_path / f"in-{name}"))
        docs = stage(spark, spark.read.parquet(str(tmp_path / f"in-{name}")), SF)
    assert docs.count() == 0


def test_near_duplicates_of_one_large_bucket(spark, monkeypatch):
    """Unlike texts with one long passage: tested in rounds of bounded size, and no link is lost."""
    monkeypatch.setattr(minhash, "OUTSIDERS", 8)
    rng = random.Random(8)
    passage = [f"p{i}" for i in range(70)]
    docs = [(i, " ".join(passage + [f"q{rng.random()}" for _ in range(18)])) for i in range(80)]
    for i in range(0, 80, 4):  # near copies of some of them
        words = docs[i][1].split()
        words[-1] = "changed"
        docs.append((100 + i, " ".join(words)))
    found = by_id(minhash.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string"), width=4))
    assert {i: r["component_id"] for i, r in found.items()} == components({i: shingles(t, 4) for i, t in docs})
    assert sum(r["kept"] for r in found.values()) == 80


def test_members_apart_are_tested_block_by_block(spark, monkeypatch):
    """One bucket of 60 sets: as few links as join what similar pairs join, whatever the blocks."""
    monkeypatch.setattr(minhash, "OUTSIDERS", 8)
    monkeypatch.setattr(minhash, "COLUMNS", 7)
    rng = random.Random(3)
    sets = {bytes([i]): sorted(rng.sample(range(24), rng.randint(16, 22))) for i in range(60)}
    frame = spark.createDataFrame([(bytearray(i), s) for i, s in sets.items()], "node binary, shingles array<long>")
    bucket = frame.select(F.lit(1).cast("long").alias("key"), "node", F.col("node").alias("comp"),
                          F.lit(bytes([0])).alias("main"))
    links = [(bytes(r["u"]), bytes(r["v"])) for r in minhash._block_links(bucket, frame, 80).collect()]

    def groups(pairs):
        names = {i: i for i in sets}
        for a, b in pairs:
            old, new = names[a], names[b]
            names = {i: new if n == old else n for i, n in names.items()}
        return {frozenset(i for i in names if names[i] == n) for n in names.values()}

    similar = lambda a, b: 100 * len(set(sets[a]) & set(sets[b])) >= 80 * len(set(sets[a]) | set(sets[b]))
    assert all(similar(a, b) for a, b in links)
    assert groups(links) == groups([p for p in itertools.combinations(sets, 2) if similar(*p)])


def test_block_of_similar_sets_takes_little_memory():
    """Nearly all pairs of a block are similar: one link joins each set, and no list of all pairs is made."""
    n = 1024
    sets = [np.append(np.arange(60), 60 + i) for i in range(2 * n)]
    comps = [i.to_bytes(2, "big") for i in range(2 * n)]
    tracemalloc.start()
    try:
        links = minhash._cell_links(comps, sets, np.arange(n), np.arange(n, 2 * n), 80)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert len(links) == 2 * n - 1 and {i for pair in links for i in pair} == set(range(2 * n))
    assert peak < 64 << 20


def test_exact_dedup_of_joined_files(spark, tmp_path):
    """Rows that come from files but do not know their places any more."""
    rows = [(1, "a b"), (2, "ab"), (3, "c"), (None, "c"), (3, "c")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "docs"))
    docs = spark.read.parquet(str(tmp_path / "docs"))
    for many in (docs.unionByName(docs), docs.join(docs.select("doc_id").distinct().withColumnRenamed("doc_id", "i"), F.col("doc_id").eqNullSafe(F.col("i")))):
        found = exact_dedup(many).collect()
        assert len(found) == many.count() and sum(r["kept"] for r in found) == 2


def test_exact_dedup_compares_bytes(spark, monkeypatch):
    """Two texts under one digest are set apart by their contents."""
    from loomtrace.llm import exact_dedup as module

    plain = module.arrivals
    monkeypatch.setattr(module, "arrivals", lambda d: plain(d).withColumn("digest", F.lit("one")))
    rows = [(1, "aa"), (2, "a a"), (3, "bb"), (4, "bb"), (5, None)]
    found = by_id(exact_dedup(spark.createDataFrame(rows, "doc_id long, text string")))
    assert {i: (r["keep_id"], r["group_size"], r["kept"]) for i, r in found.items()} == {
        1: (2, 2, False), 2: (2, 2, True), 3: (3, 2, True), 4: (3, 2, False), 5: (5, 1, True)}


def test_stages_leave_clashing_columns_alone(spark, tmp_path):
    rows = [(i, "one two three four five six" if i in (1, 2) else f"text {i} " * 9, f"mine{i}", i) for i in (1, 2, 3, None)]
    spark.createDataFrame(rows, "doc_id long, text string, _file string, _row long").coalesce(1).write.parquet(str(tmp_path / "d"))
    docs = spark.read.parquet(str(tmp_path / "d"))
    for stage in (corpus_pipeline.exact, corpus_pipeline.near):
        left = stage(spark, docs, SF)
        assert left.columns == docs.columns
        assert sorted((r["_file"], r["_row"]) for r in left.collect() if r["doc_id"]) == [("mine1", 1), ("mine3", 3)]
        assert left.count() == 3
