"""Each operator against brute force, exact round trips or held-out truth, and with odd input."""

import collections
import random

import numpy as np
import pyarrow as pa
import pytest

from quillgraph.llm import bpe, html_text, minhash, packing, pii, pu_quality, quality, simhash, substring, toxicity

P = pytest.importorskip("public_tokenizers")
SCHEMA = "doc_id long, text string, _text string, sequence_id string"
WORDS = ["alpha", "beta", "gamma", "delta", "the", "of", "and", "omega", "sigma", "rho", "tau", "phi"]


def prose(seed, n):
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) + str(r.randrange(40)) * (r.random() < 0.5) + ("." if r.random() < 0.1 else "") for _ in range(n))


def odd(spark):
    rows = [(1, "", "x", "y"), (2, None, None, None), (None, "null id", "x", "y"), (3, prose(1, 9000), "", ""), (4, "twice", "", ""), (4, "twice", "", ""), (5, "a\n\n  b\té \U0001f600", "", "")]
    return spark.createDataFrame(rows, SCHEMA)


def test_packing_matches_tokenizers_and_fills(spark):
    from tokenizers import Tokenizer

    hf = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    texts = {i: prose(i, 5 + 97 * i % 900) for i in range(60)}
    rows = packing.pack_documents(spark.createDataFrame(list(texts.items()), "doc_id long, text string"), P.path("byte_bpe_50k.json")).collect()
    packing.check_layout([(r.sequence_id, r.offset, r.length) for r in rows], 2048)
    lengths = collections.Counter()
    for r in rows:
        lengths[r.doc_id] += r.length
    assert lengths == {i: len(hf.encode(t, add_special_tokens=False).ids) + 1 for i, t in texts.items()}
    assert len({r.sequence_id for r in rows}) <= -(-sum(lengths.values()) // 2048) + 1


def test_packing_odd_rows(spark):
    out = packing.pack_documents(odd(spark), P.path("byte_bpe_50k.json")).collect()
    packing.check_layout([(r.sequence_id, r.offset, r.length) for r in out], 2048)
    assert sum(r.doc_id == 4 for r in out) == 2
    assert packing.pack_documents(odd(spark).limit(0), P.path("byte_bpe_50k.json")).collect() == []


def test_plan_uses_every_length():
    r = random.Random(3)
    h = {n: r.randrange(1, 50) for n in r.sample(range(1, 257), 120)}
    used = collections.Counter()
    for content, repeats in packing.plan(h, 256):
        assert sum(content) <= 256
        for n in content:
            used[n] += repeats
    assert used == h


def test_bpe_round_trip_with_small_chunks(spark):
    import tiktoken

    path = P.path("byte_bpe_multi_50k.tiktoken")
    enc = tiktoken.Encoding("t", pat_str=P.PATTERN, mergeable_ranks=bpe.load_ranks(path), special_tokens={})
    ids = bpe.encode(odd(spark), path, chunk_chars=120, overlap_chars=30)
    got = sorted((r.doc_id or 0, tuple(r.ids), bytes(r.decoded)) for r in bpe.decode(ids, path).collect())
    want = sorted((r.doc_id or 0, tuple(enc.encode_ordinary(r.text or "")), (r.text or "").encode()) for r in odd(spark).collect())
    assert got == want


def test_quality_stats_and_verdicts(spark):
    good = prose(5, 200)
    rows = [(1, good), (2, "spam spam spam " * 60), (3, "BUY!! NOW!! " * 40), (4, None), (5, "short"), (6, " ".join(w + "###" for w in prose(6, 100).split()))] + [(10 + i, prose(50 + i, 150)) for i in range(20)]
    out = {r.doc_id: r for r in quality.judge(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert out[1].kept and all(out[10 + i].kept for i in range(20))
    assert not any(out[i].kept for i in (2, 3, 4, 5, 6))
    words = ("spam spam spam " * 60).split()
    windows = collections.Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    cover = {i + k for i in range(len(words) - 7) if windows[tuple(words[i : i + 8])] > 1 for k in range(8)}
    assert out[2].n_repeat_words == len(cover)
    assert quality.accept(odd(spark)).columns == odd(spark).columns


def test_html_blocks():
    page = "<html><head><title>t</title><style>p{}</style></head><body><nav><a href=x>Home</a></nav><div class='ad'>Buy this now</div><article><h1>A &amp; B</h1><p><b>One\n two<br><p>Three.</p><section class=comments><p>me too</p></section></article><footer>&copy; x</footer>"
    assert html_text.main_text(page, html_text.default_tree()) == "A & B\nOne two\nThree."
    assert html_text.main_text("", html_text.default_tree()) == ""


@pytest.mark.parametrize("start", ['<div id="content" class="with-sidebar">', '<article class="review">', '<main class="no-header">', '<article class="post related-none">'])
def test_html_names_of_what_an_element_has_or_lacks(start):
    end = "</" + start[1:].split()[0] + ">"
    page = f'<nav><a href=x>Home</a></nav>{start}<h1>Title</h1><p>{"word " * 30}</p><div class="comments"><p>me too</p></div>{end}<div class="sidebar"><p>{"other " * 20}</p></div>'
    assert html_text.main_text(page, html_text.default_tree()) == "Title\n" + ("word " * 30).strip()


def test_html_clashing_names_and_empty_table(spark):
    pages = spark.createDataFrame([(1, "u", "<article><p>Some words.</p></article>", "x", "y")], "page_id long, url string, html string, text string, n_chars string")
    assert [tuple(r) for r in html_text.extract(pages).collect()] == [(1, "u", "Some words.", 11)]
    assert html_text.extract(pages.limit(0)).collect() == []


def test_html_odd_rows(spark):
    pages = spark.createDataFrame([(1, "u", None), (1, "u", None), (None, None, "<p>" + "word " * 5000)], "page_id long, url string, html string")
    out = html_text.extract(pages).collect()
    assert sorted(r.n_chars for r in out) == [0, 0, 24999]


def test_substring_removes_later_passages(spark):
    passage = " ".join(f"w{i}" + ("." if i % 9 == 8 else "") for i in range(72))
    rows = [(1, "first one. " + passage + "\ntail a."), (2, "other start here. " + passage + "\ntail b."), (3, prose(9, 80)), (4, None), (5, "")]
    out = {r.doc_id: r.text for r in substring.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert out[1] == rows[0][1] and out[3] == rows[2][1] and out[4] is None and out[5] == ""
    assert "w40" not in out[2] and "tail b." in out[2]
    assert substring.remove_repeats(odd(spark)).count() == odd(spark).count()


def test_substring_removes_passages_in_mid_sentence(spark):
    """50 words without punctuation between words of the document's own; of some the words are all alike."""
    rows, passage = [], {}
    for p in range(40):
        shared = ["same"] * 50 if p == 0 else [f"p{p}x{random.Random(p * 100 + i).randrange(10**6)}" for i in range(50)]
        for copy in range(2):
            own = [f"own{p}c{copy}n{i}" for i in range(160)]
            passage[2 * p + copy] = (shared, own)
            rows.append((2 * p + copy, " ".join(own[: 70 + 11 * copy] + shared + own[70 + 11 * copy :])))
    out = {r.doc_id: r.text.split() for r in substring.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    left = {}
    for i, (shared, own) in passage.items():
        kept = set(out[i])
        assert i % 2 or i == 0 or kept == set(shared) | set(own)
        left[i] = sum(w in set(shared) for w in out[i])
        assert len(set(own) & kept) == 160
    later = [left[i] for i in left if i % 2]
    assert max(later) <= 29 and sum(later) < 0.3 * 50 * len(later)


def test_sentences_cover_the_text():
    for seed in range(20):
        text = prose(seed, 300)
        assert "".join(text[a:b] for a, b, _ in substring.sentences(text)) == text


def test_pii_formats(spark):
    rows = [(1, "pay 4111 1111 1111 1111 on 2024-02-29, mail a.b@mail.example.com or +1 (269) 555-3296"), (2, "4111 1111 1111 1111"), (3, "number 4111111111111112 stays, version 4.0. too"), (4, None), (5, "from 10.1.2.3")]
    out = {r.doc_id: (r.text, r.n) for r in pii.pseudonymise(spark.createDataFrame(rows, "doc_id long, text string"), "k", count="n").collect()}
    assert out[3] == (rows[2][1], 0) and out[4] == (None, 0) and out[1][1] == 4
    card = out[2][0]
    assert card in out[1][0] and card != rows[1][1] and len(card) == 19
    digits = [int(c) for c in card.replace(" ", "")][::-1]
    assert (sum(digits[::2]) + sum(sum(divmod(2 * d, 10)) for d in digits[1::2])) % 10 == 0
    assert "10.1.2.3" not in out[5][0]


def test_feistel_is_a_permutation(spark):
    from pyspark.sql import functions as F

    out = spark.range(1000).select(pii.permute_digits("k", "t", F.lpad(F.col("id").cast("string"), 3, "0")).alias("d"))
    assert out.distinct().count() == 1000 and out.filter("length(d) <> 3").count() == 0


def test_fingerprints_edit_and_search(spark):
    rows = [(i, prose(100 + i, 40)) for i in range(30)] + [(30, prose(100, 40)), (31, ""), (32, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    out = {r.doc_id: r for r in simhash.edited_fingerprints(docs).collect()}
    import hashlib

    for i in range(32):
        t, n = rows[i][1] or "", rows[i + 1][1] or ""
        assert out[i].edited_sha256 == hashlib.sha256((t[: len(t) - len(t) // 2] + n[: len(t) // 2]).encode()).hexdigest()
    bits = {i: sum((getattr(r, f"f{k}") & (2**64 - 1)) << (64 * k) for k in range(4)) for i, r in out.items()}
    assert bits[0] == bits[30] and bits[31] == bits[32] == 0
    index = spark.createDataFrame([(i, *(getattr(r, f"f{k}") for k in range(4))) for i, r in out.items()], "doc_id long, f0 long, f1 long, f2 long, f3 long")
    near = [(i, b ^ sum(1 << random.Random(i * 7 + j).randrange(256) for j in range(3))) for i, b in bits.items()]
    signed = lambda v: v - 2**64 if v >= 2**63 else v
    queries = spark.createDataFrame([(i, *(signed((b >> (64 * k)) & (2**64 - 1)) for k in range(4))) for i, b in near], "doc_id long, f0 long, f1 long, f2 long, f3 long")
    got = {(r["query"], r["class"]): r["distance"] for r in simhash.within_radius(queries, index, radius=4, agree=1).collect()}
    first = {b: min(i for i, x in bits.items() if x == b) for b in bits.values()}
    want = {(i, first[b]): (q ^ b).bit_count() for i, q in near for b in set(bits.values()) if (q ^ b).bit_count() <= 4}
    assert got == want


def test_toxicity_learns_and_folds(spark):
    docs = [(i, prose(i, 30) + (" you vile toad" if i % 4 == 0 else "")) for i in range(200)] + [(900, "such a v1le tоad"), (901, ""), (902, None)]
    labels = [(i, int(i % 4 == 0)) for i in range(200)]
    d = spark.createDataFrame(docs, "doc_id long, text string")
    lexicon = toxicity.fit(d, spark.createDataFrame(labels, "doc_id long, toxic int"))
    out = {r.doc_id: r.score for r in toxicity.score(d, lexicon).collect()}
    assert all((out[i] >= 0.5) == (i % 4 == 0) for i in range(200)) and out[900] > 0.5 > out[901] == out[902]
    assert toxicity.Lexicon({"trash": 5.0}).hits("into the trash can now") == {}


def junk(seed, n):
    r = random.Random(seed)
    return " ".join(r.choice(["zzkq", "BUY!!", "wq###", "|", "$$$"]) + str(r.randrange(9)) * (r.random() < 0.3) for _ in range(n))


def test_pu_quality_learns_from_positives_alone(spark):
    texts = [(i, prose(i, 60) if i % 4 else junk(i, 60)) for i in range(400)]
    labels = [(i, int(i % 4 > 0)) for i in range(200)] + [(1, 1), (None, 1), (3, None)]
    docs = spark.createDataFrame(texts + [(900, ""), (901, None), (None, prose(1, 60)), (5, prose(5, 60))], "doc_id long, text string")
    rows = pu_quality.classify(docs, spark.createDataFrame(labels, "doc_id long, quality int")).collect()
    assert len(rows) == 404 and all(0 <= r.score <= 1 for r in rows)
    out = {r.doc_id: r.score for r in rows}
    assert sum((out[i] >= 0.5) == bool(i % 4) for i in range(200, 400)) >= 196
    assert out[900] == out[901] and len({r.score for r in rows if r.doc_id == 5}) == 1
    clash = docs.withColumn("_terms", docs.doc_id).withColumn("_text", docs.text)
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert {r.score for r in pu_quality.classify(clash, none).collect()} == {0.5}
    assert pu_quality.classify(docs.limit(0), none).collect() == []


def test_pu_prior_and_own_contribution():
    r = np.random.default_rng(1)
    good = np.stack([r.integers(0, 2, 1300) if k else r.integers(6, 11, 1300) for k in range(len(pu_quality.MEASURES))], axis=1)
    bad = np.stack([r.integers(1, 3, 300) if k else r.integers(0, 4, 300) for k in range(len(pu_quality.MEASURES))], axis=1)
    bins = np.concatenate([good, bad])
    half = np.eye(2)[np.arange(len(bins)) % 2]
    positive, unlabelled = half.copy(), half.copy()
    positive[400:], unlabelled[:400] = 0, 0
    model = pu_quality.fit_counts(bins, positive, unlabelled)
    assert abs(model.prior - 0.75) < 0.08
    dense = np.zeros((len(bins), pu_quality.WIDTH))
    dense[:, 0], at = 1, 1
    for k, (_, _, edges) in enumerate(pu_quality.MEASURES):
        dense[np.arange(len(bins)), at + bins[:, k]] = 1
        at += len(edges) + 1
    score = dense @ np.array(model.weights)
    sparse = pu_quality.Indicators(bins)
    assert np.allclose(sparse.times(np.array(model.weights)), score) and np.allclose(sparse.summed(score), dense.T @ score)
    assert (score[:1300] > 0).mean() > 0.97 and (score[1300:] < 0).mean() > 0.95
    # A trusted text meets the log-odds that the other trusted texts alone would give.
    texts = pa.array([prose(i, 50) for i in range(12)])
    owner, bucket = pu_quality.terms(texts)
    share = 1 / np.bincount(owner)[owner]
    count = lambda of: [(b, share[bucket == b].sum(), (share * of[owner])[bucket == b].sum(), float((bucket == b).sum())) for b in np.unique(bucket)]
    trusted = np.arange(12) < 5
    without = trusted.copy()
    without[2] = False
    one = owner == 2
    alone = np.zeros(one.sum(), dtype=int)
    a = pu_quality.TermTable.of(count(trusted)).means(alone, bucket[one], np.array([True]))
    b = pu_quality.TermTable.of(count(without)).means(alone, bucket[one], np.array([False]))
    assert abs(a[1][0] - b[0][0]) < 1e-9 and b[0][0] == b[1][0]
    # The plain mean does not know whether the text itself is trusted.
    c = pu_quality.TermTable.of(count(trusted)).means(alone, bucket[one], np.array([False]))
    assert a[0][0] == c[0][0] == c[1][0] != a[1][0]


def test_pu_score_ignores_a_documents_own_label(spark):
    """Equal texts, one of them labelled, score alike, and so do all others of that text."""
    texts = [(i, prose(i % 40, 60) if i % 4 else junk(i % 40, 60)) for i in range(240)]
    labels = [(i, int(i % 4 > 0)) for i in range(80)]
    rows = pu_quality.classify(spark.createDataFrame(texts, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int")).collect()
    by_text = collections.defaultdict(set)
    for r in rows:
        by_text[dict(texts)[r.doc_id]].add(r.score)
    assert len(rows) == 240 and all(len(s) == 1 for s in by_text.values())


def brute_classes(texts):
    def shingles(t):
        w = (t or "").split()
        return collections.Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else collections.Counter([tuple(w)] if w else [])

    s = [shingles(t) for t in texts]
    parent = list(range(len(s)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(s)):
        for j in range(i):
            both = sum((s[i] & s[j]).values())
            either = sum((s[i] | s[j]).values())
            if not either or both >= 0.8 * either:
                parent[max(find(i), find(j))] = min(find(i), find(j))
    return [find(i) for i in range(len(s))]


def test_near_duplicates_against_brute_force(spark):
    texts = [prose(i, 120) for i in range(25)]
    for i in range(25):
        w = texts[i % 5].split()
        w[(i * 11) % len(w)] = f"changed{i}"
        texts.append(" ".join(w))
    texts += ["", None, "", texts[3], "two words", "two  words"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    out = {r["_id"]: r["class_id"] for r in minhash.near_duplicates(docs).collect()}
    assert [out[i] for i in range(len(texts))] == brute_classes(texts)
    assert sorted(r.doc_id for r in minhash.keep_one(docs).collect()) == sorted(set(out.values()))
    assert minhash.keep_one(odd(spark)).count() == 5


def test_near_duplicates_lose_no_link_in_large_bands(spark):
    """Texts of one template with 26 slots: nearly all pairs are below the threshold, a few reach it by chance."""
    n, words, slots = 2000, 404, 26
    choice = np.random.default_rng(7).integers(0, 3, (n, slots))
    texts = []
    for row in choice:
        w = [f"w{i}" for i in range(words)]
        for k, c in enumerate(row):
            w[6 + 15 * k] = f"slot{k}{c}"
        texts.append(" ".join(w))
    differ = slots - sum((choice == c).astype(float) @ (choice == c).T.astype(float) for c in range(3))
    label = np.arange(n)  # a slot that differs changes five of the 400 shingles
    linked = 400 - 5 * differ >= 0.8 * (400 + 5 * differ)
    while (new := np.where(linked, label, n).min(axis=1)).tolist() != label.tolist():
        label = new
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    out = {r["_id"]: r["class_id"] for r in minhash.near_duplicates(docs).collect()}
    assert len(set(label.tolist())) < n and sum(out[i] != label[i] for i in range(n)) == 0


def test_signature_estimates_weighted_jaccard():
    a = ["x y z " * 30 + prose(1, 200)]
    b = ["x y z " * 15 + prose(1, 200)]
    left, right = (minhash.signatures(*minhash.shingles(pa.array(t)), 1, 4096) for t in (a, b))
    truth = minhash.overlap(pa.array(a), pa.array(b))[0]
    assert abs((left == right).mean() - truth) < 0.04


def test_pipeline_stages_keep_columns(spark):
    corpus = pytest.importorskip("corpus_pipeline")
    docs = spark.createDataFrame([(i, prose(i, 120), "en", "s", 1) for i in range(12)] + [(50, prose(3, 120), "en", "s", 1)], "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in corpus.STAGES[:-1]:
        docs = stage(spark, docs, "")
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    assert {r.doc_id for r in docs.collect()} == set(range(12))


def test_blocks_of_one_band_meet(spark, monkeypatch):
    """Blocks of 8 texts: links between blocks, within them and to the largest class are all found."""
    monkeypatch.setattr(minhash, "BLOCK_ROWS", 8)
    base = [f"b{i}" for i in range(200)]
    texts = []
    for i in range(60):
        r = random.Random(i)
        w = list(base)
        for k in r.sample(range(40), r.choice([1, 2, 7, 8, 9])):
            w[5 * k] = f"x{k}v{r.randrange(3)}"
        texts.append(" ".join(w))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    out = {r["_id"]: r["class_id"] for r in minhash.near_duplicates(docs).collect()}
    assert [out[i] for i in range(len(texts))] == brute_classes(texts)


def test_common_weights_against_counters():
    texts = [prose(i, 40) + " a b c d e" * (i % 7) + " q r s t u v" * 3 for i in range(60)]
    owner, shingle, weight = minhash.shingles(pa.array(texts))
    got = minhash.common_weights(owner, shingle, weight, len(texts))
    bags = [collections.Counter() for _ in texts]
    for o, s, w in zip(owner.tolist(), shingle.tolist(), weight.tolist()):
        bags[o][s] += w
    assert all(got[i, j] == sum((bags[i] & bags[j]).values()) for i in range(60) for j in range(i))


def test_near_duplicates_odd_tables(spark):
    """Null keys, clashing names, repeated rows and an empty table."""
    rows = [(None, "a b c d e f g", "1", "2"), (None, "another text with other words in it", "1", "2"), (7, "a b c d e f g", "3", "4"), (7, "a b c d e f g", "3", "4"), (8, None, "5", None), (9, " \n ", None, "6")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _node string, _keep string")
    out = minhash.keep_one(docs)
    assert out.columns == docs.columns
    assert sorted(map(str, out.collect())) == sorted(map(str, (docs.collect()[k] for k in (1, 2, 4))))
    assert sorted(str(r.class_id) for r in minhash.near_duplicates(docs).collect()) == ["7", "7", "7", "8", "8", "None"]
    assert minhash.near_duplicates(docs.limit(0)).collect() == [] == minhash.keep_one(docs.limit(0)).collect()


def test_pack_gives_no_place_without_length(spark):
    rows = [(i, 0, n, "x") for i, n in enumerate([5, 5, 5, 7, None, 3, 10])] + [(None, None, 4, None), (None, None, 4, None)]
    pieces = spark.createDataFrame(rows, "doc_id long, piece int, length long, _salt string")
    out = packing.pack(pieces, capacity=10).collect()
    assert out[0].asDict().keys() == {"doc_id", "piece", "length", "_salt", "sequence_id", "offset"} and len(out) == len(rows)
    packing.check_layout([(r.sequence_id, r.offset, r.length) for r in out if r.length is not None], 10)
    assert [(r.sequence_id, r.offset) for r in out if r.length is None] == [(None, None)]
    with pytest.raises(ValueError):
        packing.pack(pieces, capacity=6)


def brute_repeats(rows, min_words, min_sentences):
    """What remains of each text when a part goes that any repeated run covers: plain dictionaries of word tuples."""
    first, parts, all_runs = {}, {}, {}
    for key, text in rows:
        found = substring.sentences(text or "")
        parts[key] = found
        words = [tuple((text or "")[a:b].split()) for a, b, _ in found]
        all_runs[key] = []
        for i in range(len(found)):
            n, j = 0, i
            while j < len(found) and (n < min_words or j - i < min_sentences):
                n += len(words[j])
                j += 1
            if n >= min_words and j - i >= min_sentences:
                run = tuple(words[i:j])
                all_runs[key].append((i, j, run))
                first.setdefault(run, []).append((key, i))
    out = {}
    for key, text in rows:
        gone = set()
        for i, j, run in all_runs[key]:
            if min(first[run]) < (key, i):
                gone.update(range(i, j))
        out[key] = None if text is None else "".join(text[a:b] for k, (a, b, _) in enumerate(parts[key]) if k not in gone)
    return out


def test_substring_against_brute_force(spark, monkeypatch):
    """Passages shared by many, some or two documents, in batches smaller than their groups."""
    r = random.Random(11)
    common = [prose(1000 + i, 70) for i in range(6)]
    rows = []
    for i in range(150):
        body = [prose(i, r.randrange(5, 90))]
        for c in range(6):
            if r.random() < (0.8, 0.5, 0.2, 0.05, 0.02, 0.02)[c]:
                body.insert(r.randrange(len(body) + 1), common[c])
        if i % 17 == 0:
            body += body[:1]
        rows.append((i, ". ".join(body)))
    rows += [(200, None), (201, ""), (-5, common[2])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = {x.doc_id: x.text for x in substring.remove_repeats(docs).collect()}
    assert got == brute_repeats(rows, substring.MIN_WORDS, substring.MIN_SENTENCES)


def test_substring_clashing_names_and_empty_table(spark):
    text = prose(5, 90)
    docs = spark.createDataFrame([(1, text, "x", 3), (2, text, "y", 4)], "doc_id long, text string, _covers string, _text_hash long")
    out = sorted(substring.remove_repeats(docs).collect())
    assert [(x.doc_id, x._covers, x._text_hash) for x in out] == [(1, "x", 3), (2, "y", 4)] and out[0].text == text and len(out[1].text.split()) < 20
    assert substring.remove_repeats(docs.limit(0)).collect() == []


def brute_fingerprint(text):
    """Votes of xxhash64 over adjacent word pairs, bit by bit, in plain Python."""
    import xxhash

    def chained(parts):
        seed = 42
        for p in parts:
            seed = (xxhash.xxh64_intdigest(p.encode(), seed) if isinstance(p, str) else xxhash.xxh64_intdigest(p.to_bytes(4, "little"), seed))
        return seed

    words = (text or "").split()
    out = []
    for k in range(4):
        votes = np.zeros(64, dtype=int)
        for a, b in zip(words, [*words[1:], ""], strict=False):
            h = chained([a, b, k])
            votes += np.array([(h >> i) & 1 for i in range(64)])
        out.append(sum(1 << i for i in range(64) if 2 * votes[i] > len(words)))
    return out


def test_fingerprint_bits_against_brute_force(spark):
    texts = [prose(i, 5 + 30 * i) for i in range(6)] + ["one", "", None, "a b"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: [getattr(r, f"f{k}") & (2**64 - 1) for k in range(4)] for r in simhash.text_fingerprints(docs).collect()}
    assert got == {i: brute_fingerprint(t) for i, t in enumerate(texts)}


def test_fingerprints_keep_every_row(spark):
    rows = [(None, "null key", "x"), (1, "same words here", "x"), (1, "same words here", "y"), (1, "other words", "z"), (2, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _row string")
    out = simhash.edited_fingerprints(docs).collect()
    assert len(out) == 5 and sorted(r.n_chars for r in out) == [0, 8, 11, 15, 15]
    one = simhash.edited_fingerprints(docs.limit(1)).collect()
    assert len(one) == 1 and one[0].near_next == 1.0
    assert simhash.edited_fingerprints(docs.filter("false")).collect() == []


def brute_article(page):
    """Text of the article element's headings and paragraphs by the standard library's parser."""
    from html.parser import HTMLParser

    class Reader(HTMLParser):
        def __init__(self):
            super().__init__(convert_charrefs=True)
            self.inside, self.blocks = False, [""]

        def handle_starttag(self, tag, attrs):
            if tag == "article":
                self.inside = True
            if tag in ("p", "h1", "article"):
                self.blocks.append("")
            if tag == "br":
                self.blocks[-1] += " "

        def handle_endtag(self, tag):
            if tag == "article":
                self.inside = False
            if tag in ("p", "h1", "article"):
                self.blocks.append("")

        def handle_data(self, data):
            if self.inside:
                self.blocks[-1] += data

    reader = Reader()
    reader.feed(page)
    return "\n".join(b for b in (" ".join(x.split()) for x in reader.blocks) if b)


def _pages(limit):
    duckdb = pytest.importorskip("duckdb")
    return [r[0] for r in duckdb.sql(f"SELECT html FROM '/root/testdata/sf0.001/pages.parquet' LIMIT {limit}").fetchall()]


def test_html_pages_against_brute_force():
    tree = html_text.default_tree()
    pages = _pages(1000)
    assert pages and all(html_text.main_text(p, tree) == brute_article(p) for p in pages)


def test_html_neighbours_decide_where_no_role_is_named():
    import re

    tree = html_text.default_tree()
    whole = blind = total = 0
    for p in _pages(200):
        bare = re.sub(r"<(/?)(article|nav|footer)\b", r"<\1div", p).replace(' class="ad"', "")
        found = html_text.blocks(bare)
        x = html_text.features(found)
        text = lambda keep: "\n".join(b.text for b, k in zip(found, keep, strict=True) if k)  # noqa: B023, E731
        whole += text(tree.predict(x) >= 0.5) == brute_article(p)
        x[:, 2:6] = 0
        blind += text(tree.predict(x) >= 0.5) == brute_article(p)
        total += 1
    assert whole > 0.95 * total and blind < 0.2 * total


def test_html_broken_markup():
    tree = html_text.default_tree()
    text = lambda body: html_text.main_text(f"<article><p>{body}", tree)
    assert text("Energy <math><mi>E</mi>=<mi>m</mi></math> matters") == "Energy E=m matters"
    assert text("see <object>inside</object>") == "see inside"
    assert text('a</p><p title="open>tail text') == "a\ntail text"
    assert text("kept<script>var x = 1;<p>after") == "kept\nafter"
    assert text("a < b and 3 <4") == "a < b and 3 <4"
    assert html_text.main_text("<div class='content'><p>Yes.</p><p>" + "word " * 40 + "</p></div>", tree).startswith("Yes.\n")
    import time

    began = time.time()
    html_text.main_text('<a "' * 30_000 + "<b <c" * 30_000 + "<script>" * 3_000, tree)
    assert time.time() - began < 5


def test_toxicity_odd_labels(spark):
    docs = spark.createDataFrame([(i, prose(i, 30) + (" you vile toad" if i % 3 == 0 else ""), "x") for i in range(90)] * 2 + [(None, "vile", None), (91, None, None)], "doc_id long, text string, _text string")
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(60)] + [(3, 1), (3, 0), (None, 1), (4, None)], "doc_id long, toxic int")
    out = toxicity.score(docs, toxicity.fit(docs, labels)).collect()
    assert len(out) == 182 and all((r.score >= 0.3) == (r.doc_id % 3 == 0) for r in out if r.doc_id is not None and r.doc_id < 90)
    none = toxicity.fit(docs, labels.filter("toxic = 0"))
    assert len({r.score for r in toxicity.score(docs, none).collect()}) == 1
    assert toxicity.score(docs.limit(0), none).collect() == []


def test_toxicity_matches_brute_force():
    lexicon = toxicity.Lexicon({"vile": 2.0, "toad*": 3.0, "trash": 1.0}, exceptions=("trash can",))
    r = random.Random(4)
    for _ in range(200):
        text = " ".join(r.choice(["vile", "toad", "toads", "toadstool", "trash", "trash can", "ok", "v1le", "evil", "trashcan"]) for _ in range(12))
        folded = toxicity.fold(text)
        want = collections.Counter()
        words = [(m.start(), m.group()) for m in toxicity._WORD.finditer(folded)]
        for at, w in words:
            if w == "vile" or (w == "trash" and not (folded[at:].startswith("trash can") and (folded[at + 9 : at + 10] in ("", " ")))):
                want[w] += 1
            elif w.startswith("toad") and len(w) > 4:
                want["toad*"] += 1
        assert lexicon.hits(folded) == want


def test_bpe_empty_table_and_long_text(spark):
    import tiktoken

    path = P.path("byte_bpe_multi_50k.tiktoken")
    enc = tiktoken.Encoding("t", pat_str=P.PATTERN, mergeable_ranks=bpe.load_ranks(path), special_tokens={})
    long = prose(3, 12_000) + "\n\n  <|endoftext|> é中" + " " * 700 + prose(4, 50)
    docs = spark.createDataFrame([(1, long), (2, long), (2, long)], "doc_id long, text string")
    rows = bpe.encode(docs, path).collect()
    assert len(rows) == 3 and all(list(r.ids) == enc.encode_ordinary(long) for r in rows)
    assert bpe.decode(bpe.encode(docs.limit(0), path), path).collect() == []


def test_pii_shorter_numbers_and_clashing_names(spark):
    rows = [(1, "card 4111111111111111 12/27 ok", "a"), (2, "4111 1111 1111 1111 123", "b"), (3, "BE68 5390 0754 7034 OK", None), (4, None, "d"), (5, "", "e"), (5, "", "e")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _found string")
    out = {r.doc_id: r for r in pii.pseudonymise(docs, "k", count="n").collect()}
    assert out[1].text.endswith(" 12/27 ok") and "4111111111111111" not in out[1].text and out[1]._found == "a"
    assert out[2].text.endswith(" 123") and out[2].n == 1 and out[1].text.split()[1] == out[2].text.replace(" ", "")[:16]
    assert out[3].text.endswith(" OK") and out[3].text.startswith("BE") and out[3].text[2:4] != "68" or out[3].n == 1
    assert out[4].text is None and out[5].text == ""
    assert pii.pseudonymise(docs.limit(0), "k").collect() == []


def test_quality_accept_keeps_rows_whole(spark):
    rows = [(i, prose(i, 120), f"h{i}", i) for i in range(12)] + [(3, prose(3, 120), "h3", 3), (None, prose(40, 120), None, None), (50, None, "x", 1), (51, "", "x", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _text_hash string, n_words long")
    out = quality.accept(docs)
    assert out.columns == docs.columns
    assert sorted(map(str, out.collect())) == sorted(map(str, docs.filter("length(text) > 0").collect()))
    assert quality.accept(docs.limit(0)).collect() == []


def test_pipeline_against_its_operators(spark):
    """Every stage on odd rows; packing at the end holds what the stages before it kept."""
    corpus = pytest.importorskip("corpus_pipeline")
    passage = prose(77, 80)
    rows = [(i, prose(i, 120 + i) + (". " + passage if i in (2, 9) else ""), "en", "s", 1) for i in range(12)]
    rows += [(20, prose(3, 123), "en", "s", 1), (21, "spam " * 200, "en", "s", 1), (22, None, None, None, None), (23, "", "en", "s", 0), (5, rows[5][1], "en", "s", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    kept = {}
    for name, stage in corpus.STAGES[:-1]:
        docs = stage(spark, docs, "")
        kept[name] = {r.doc_id: r.text for r in docs.collect()}
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    assert set(kept["quality_rules"]) == {*range(12), 20} and set(kept["minhash_near_dedup"]) == set(range(12))
    assert kept["substring_dedup"] == brute_repeats(sorted(kept["minhash_near_dedup"].items()), substring.MIN_WORDS, substring.MIN_SENTENCES)
    assert len(kept["substring_dedup"][9]) < len(kept["minhash_near_dedup"][9]) - len(passage) // 2
    pieces = corpus.STAGES[-1][1](spark, docs, "").collect()
    packing.check_layout([(r.sequence_id, r.offset, r.length) for r in pieces], 2048)
    assert {r.doc_id for r in pieces} == set(range(12))
    empty = spark.createDataFrame([], docs.schema)
    for _, stage in corpus.STAGES:
        empty = stage(spark, empty, "")
    assert empty.collect() == []
