"""Training-data operators against brute force on small tables with nulls, empty and long texts, ties and repeats."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from scoutml.llm import chunk_bpe, components, jaccard, langid, packing, quality, secrets, sharding, topk, toxicity, url_filter
from scoutml.llm.common import load_tokenizer
from scoutml.llm.components import connected_components
from scoutml.llm.words_bpe import VOCABULARY, WordEncoder

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key string, n long, label int, code long"


def docs(spark, texts, langs=None):
    langs = langs or ["en"] * len(texts)
    return spark.createDataFrame([(i, t, g, "s", 0, "k", 1, 2, 3) for i, (t, g) in enumerate(zip(texts, langs))], SCHEMA)


@pytest.fixture(scope="module")
def texts():
    rng = np.random.default_rng(3)
    vocabulary = ["alpha", "It's", "béta", "gamma,", "10", "Δelta", "ε", "WORD", "x", "they'll", "<|endoftext|>", "naïve"]
    base = [" ".join(rng.choice(vocabulary, rng.integers(1, 90))) for _ in range(30)]
    copies = []
    for t in base[:12]:
        w = t.split(" ")
        w[rng.integers(0, len(w))] = "changed"
        copies.append(" ".join(w))
    return [None, "", " \n ", "one two", "One TWO", *base, *copies, *base[:3], "long " * 3000 + "y" * 6000, "a\nb\na\nb"]


def test_encoder_equals_library(texts):
    tok, enc = load_tokenizer(VOCABULARY), WordEncoder()
    rows = [t or "" for t in texts] + ["'S 'll a's''t \x85x\xa0y\x1cz", "²½ªµß"]
    got = enc.encode(rows)
    assert [g.tolist() for g in got] == [tok.encode(t, add_special_tokens=False).ids for t in rows]


def test_chunked_encoding_and_decoding(spark, texts):
    tok = load_tokenizer(VOCABULARY)
    rows = chunk_bpe.decode_documents(chunk_bpe.encode_documents(docs(spark, texts), bits=4)).collect()
    assert len(rows) == len(texts)
    for r in rows:
        ids = tok.encode(texts[r.doc_id] or "", add_special_tokens=False).ids
        assert r.ids == ids and r.decoded == tok.decode(ids, skip_special_tokens=False)


def test_chunked_encoding_of_control_separators(spark):
    tok = load_tokenizer(VOCABULARY)
    rows = ["a \x1c b", "\x1c", " \x1d\x1e \x1f\n", "word " * 40 + " \x1c " * 40 + "\x1f" * 9 + " end", "a \u2003 \x85 \x1c\u2003 b"]
    for r in chunk_bpe.encode_documents(docs(spark, rows), bits=3).collect():
        assert r.ids == tok.encode(rows[r.doc_id], add_special_tokens=False).ids


def test_packing_covers_every_id(spark, texts):
    tok = load_tokenizer(VOCABULARY)
    full = {i: tok.encode(t or "", add_special_tokens=False).ids + [1] for i, t in enumerate(texts)}
    pieces = packing.pack_documents(docs(spark, texts).repartition(2), capacity=64, smallest=4).collect()
    seen, places = defaultdict(list), defaultdict(list)
    for p in pieces:
        assert p.ids == full[p.doc_id][p.start : p.start + p.length] and p.doc_tokens == len(full[p.doc_id])
        seen[p.doc_id].append((p.start, p.length))
        places[p.sequence_id].append((p.offset, p.length))
    for spans, limit in [(s, len(full[d])) for d, s in seen.items()] + [(s, None) for s in places.values()]:
        at = 0
        for start, size in sorted(spans):
            assert start == at
            at += size
        assert at == limit if limit else at <= 64
    assert len(seen) == len(texts)
    sums = packing.piece_checksums(packing.pack_documents(docs(spark, texts[:9]))).collect()
    assert all(r.ids_crc32 == zlib.crc32(np.array(full[r.doc_id][r.start : r.start + r.length], "<u4").tobytes()) for r in sums)


def brute_components(texts):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    sets = []
    for t in texts:
        w = WORD.findall((t or "").translate(lower))
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    label = list(range(len(texts)))
    changed = True
    while changed:
        changed = False
        for i, x in enumerate(sets):
            for j, y in enumerate(sets[:i]):
                if x and y and 100 * len(x & y) >= 80 * len(x | y) and label[i] != label[j]:
                    label[i] = label[j] = min(label[i], label[j])
                    changed = True
    return [len(s) for s in sets], label


def test_jaccard_components(spark, texts):
    sizes, label = brute_components(texts)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.jaccard_components(docs(spark, texts)).collect()}
    assert got == {i: (sizes[i], label[i]) for i in range(len(texts))}
    left = jaccard.one_of_each(docs(spark, texts).unionByName(docs(spark, texts)))
    assert left.columns == docs(spark, texts).columns
    assert sorted(r.doc_id for r in left.collect()) == sorted(set(label))


def test_jaccard_of_null_and_clashing_ids(spark):
    words = lambda tag, n=60: " ".join(f"{tag}{i}" for i in range(n))
    near = lambda t: t + " end"
    rows = [
        (None, words("a")), (None, words("a")), (None, near(words("a"))),  # a component without ids
        (None, words("b")),  # one row, no copy
        (None, words("c")), (7, near(words("c"))),  # the id is the lowest
        (5, words("d")), (5, words("e")), (6, near(words("d"))), (8, near(words("e"))),  # one id, two texts
        (9, words("f")), (9, words("f")), (10, None), (10, words("g")), (None, None), (None, " "), (11, ""), (11, ""),
    ]
    frame = spark.createDataFrame([(i, t, k) for k, (i, t) in enumerate(rows)], "doc_id long, text string, place int")
    found = Counter((r.doc_id, r.n_shingles, r.component_id) for r in jaccard.jaccard_components(frame).collect())
    assert found == Counter({
        (None, 56, None): 3, (None, 57, None): 1, (None, 56, 7): 1, (7, 57, 7): 1, (5, 56, 5): 2, (6, 57, 5): 1, (8, 57, 5): 1,
        (9, 56, 9): 2, (10, 0, 10): 1, (10, 56, 10): 1, (None, 0, None): 2, (11, 0, 11): 2})
    left = jaccard.one_of_each(frame)
    assert left.columns == frame.columns
    got = Counter((r.doc_id, r.text) for r in left.collect())
    one = [(None, near(words("a"))), (None, words("a"))]
    assert sum(got.pop(k, 0) for k in one) == 1
    assert got == Counter([(None, words("b")), (7, near(words("c"))), (5, words("d")), (5, words("e")), (9, words("f")),
                           (10, None), (10, words("g")), (None, None), (None, " "), (11, "")])


def test_jaccard_of_one_large_group(spark):
    rng = np.random.default_rng(5)
    base = [f"w{i}" for i in range(120)]
    texts = []
    for _ in range(150):
        w = list(base)
        for p in rng.integers(0, 120, rng.integers(0, 6)):
            w[p] = f"z{rng.integers(0, 10**6)}"
        texts.append(" ".join(w))
    _, label = brute_components(texts)
    got = {r.doc_id: r.component_id for r in jaccard.jaccard_components(docs(spark, texts)).collect()}
    assert got == dict(enumerate(label))


def test_components_of_a_path(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101)], "a long, b long")
    got = {r.node: r.comp for r in connected_components(links).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100}


def test_few_links_take_few_jobs(spark, tmp_path):
    spark.createDataFrame([(i, i + 1) for i in range(400)], "a long, b long").repartition(16).write.parquet(f"{tmp_path}/links")
    links = spark.read.parquet(f"{tmp_path}/links")
    sc = spark.sparkContext
    sc.setJobGroup("components of a path", "")
    try:
        got = {r.node: r.comp for r in connected_components(links).collect()}
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)
    assert got == {i: 0 for i in range(401)}
    assert len(sc.statusTracker().getJobIdsForGroup("components of a path")) <= 8


def test_components_of_more_links_than_one_task_takes(spark, monkeypatch):
    monkeypatch.setattr(components, "PART", 3)
    links = [(i, i + 1) for i in range(30)] + [(100 + i, 100 + (i + 1) % 9) for i in range(9)] + [(7, 7), (200, 201)]
    got = {r.node: r.comp for r in connected_components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(31)}, **{100 + i: 100 for i in range(9)}, 200: 200, 201: 200}
    none = connected_components(spark.createDataFrame([(7, 7)], "a long, b long"))
    assert none.count() == 0


def test_secrets(spark):
    hexa = hashlib.sha1(b"a").hexdigest()
    rows = [None, "", f"Token: '{hexa}' é password=short API_KEY=longenough1", "AKIAABCDEFGHIJKL2 AKIA123",
            "d41d8cd98f00b204e9800998ecf8427e", "key Zx9Qm2Lp7Rt4Vb8Nc3Hd6Kf1Ws5 end", "some-words-with-dashes-and-more-words", "a" * 50000]
    got = {r.doc_id: [(s.kind, s.start, s.end) for s in r.spans] for r in secrets.scan(docs(spark, rows)).collect()}
    kinds = lambda i: [k for k, _, _ in got[i]]
    assert got[0] == got[1] == got[6] == [] and kinds(7) == ["hex"]
    assert kinds(2) == ["assign", "hex", "entropy", "assign"] and kinds(3) == ["access"] and kinds(5) == ["entropy"]
    assert kinds(4) == ["hex"]  # the base pattern stays, the entropy span is on the allow list
    clean = {r.doc_id: r.text for r in secrets.redact(docs(spark, rows)).collect()}
    assert clean[0] is None and hexa not in clean[2] and "short" in clean[2]


def test_entropy_windows_match_recount():
    rng = np.random.default_rng(1)
    s = "".join(rng.choice(list("aB3dE5gH7"), 200))
    keep = set()
    for i in range(len(s) - 23):
        w = s[i : i + 24]
        h = -sum(c / 24 * np.log2(c / 24) for c in Counter(w).values())
        if h >= 2.9:
            keep.update(range(i, i + 24))
    got = set()
    for a, b in secrets.entropy_windows(s, 24, 2.9, 2):
        got.update(range(a, b))
    assert got == keep


def test_secrets_of_short_runs_and_inner_stretches():
    rng = np.random.default_rng(9)
    draw = lambda letters, n: "".join(rng.choice(list(letters), n))
    base64 = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    spans = lambda t: [(a, b) for k, a, b in secrets.find_secrets(t) if k == "entropy"]
    for letters, lengths in ((base64, range(20, 24)), ("0123456789abcdef", range(20, 24)), ("0123456789", range(20, 29))):
        found = [spans(f"see {draw(letters, n)} there") == [(4, 4 + n)] for n in lengths for _ in range(50)]
        assert np.mean(found) > 0.85
    for prefix in ("KEY=", "id_", "a/b-"):
        for letters in ("0123456789ABCDEF", "0123456789abcdefABCDEF"):
            found = [spans(prefix + draw(letters, 40)) for _ in range(50)]
            assert np.mean([sum(b - max(a, len(prefix)) for a, b in f) >= 24 for f in found]) > 0.95
    assert spans("sum=da39a3ee5e6b4b0d3255bfef95601890afd80709") == []
    assert spans("internationalization getElementsByTagName " + "ab" * 11 + " " + "7" * 25) == []


def test_urls(spark):
    urls = [None, "nothing", "http://A.example.net/en/x?a", "https://x.net", "https://x.net/", "http://example.com/de/1",
            "http://a.org/fr/", "http://notnet/", "http://h.com/casino", "http://h.com/casinos", "http://ads-track.com/", "http://ads.com/ads"]
    frame = spark.createDataFrame([(i, u, "rule") for i, u in enumerate(urls)], "page_id long, url string, host string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.judge_urls(frame).collect()}
    assert got[0] == got[1] == ("", "", None, "allow")
    assert got[2] == ("a.example.net", "/en/x", "example.net/en/", "allow")
    assert got[3] == ("x.net", "", None, "allow") and got[4][2:] == ("net/", "block")
    assert got[5][2:] == ("example.com/de/", "block") and got[6][2:] == ("org/fr/", "allow") and got[7][2] is None
    assert [got[i][3] for i in (8, 9, 10, 11)] == ["block", "allow", "block", "allow"]


def test_quality_counts_and_outliers(spark):
    rng = np.random.default_rng(2)
    clean = [" ".join("abcdefgh"[: rng.integers(2, 9)] + str(i * j) for j in range(60)) for i in range(1, 240)]
    odd = ["### ".join(f"q{i}r{j}" for j in range(60)) for i in range(4)]
    rows = [None, "", *clean, *odd, "a b c d e f g h i j\nx\nx " + "r s t u v " * 2]
    out = quality.quality(docs(spark, rows)).collect()
    assert len(out) == len(rows)
    for r in out:
        t = rows[r.doc_id] or ""
        w = WORD.findall(t)
        grams = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
        count = Counter(grams)
        covered = {p for i, g in enumerate(grams) if count[g] > 1 for p in range(i, i + 5)}
        lines = [x for x in t.split("\n") if WORD.search(x)]
        assert (r.n_words, r.word_chars, r.n_dup_lines, r.n_repeat_words) == (
            len(w), sum(map(len, w)), len(lines) - len(set(lines)), len(covered))
        assert r.n_symbols == sum(c in "#*$%&|<>" for c in t)
        assert r.base_failed == (len(w) < 10 or 100 * len(covered) > 20 * len(w))
        if 2 <= r.doc_id < 2 + len(clean) + len(odd):
            assert r.kept == (r.doc_id < 2 + len(clean))
    assert quality.keep_good(docs(spark, rows)).columns == docs(spark, rows).columns
    assert quality.quality(docs(spark, rows).limit(0)).count() == 0


def counted_rows(spark, n, rare):
    """Counts of n documents; those of the first ``rare`` are of a source of their own, far from the others."""
    odd = "id < %d" % rare
    rate = lambda k: "cast(pmod(xxhash64(id, %d), 200) + if(%s, 900, 0) as long)" % (k, odd)
    names = [f"'{r}', {rate(i)}" for i, r in enumerate(quality.RATES)]
    return spark.range(n).selectExpr("id as doc_id", "'en' as lang", f"if({odd}, 'rare', 'main') as source",
                                     f"named_struct('base_failed', false, {', '.join(names)}) as __q")


def test_quality_estimates_of_small_sources_in_a_large_table(spark):
    counted = counted_rows(spark, 130_000, 120)
    est = quality.fit(counted)
    assert {r.grp for r in est.collect()} == {"*", "l=en", "s=en|=main", "s=en|=rare"}
    judged = quality.judge(counted, quality.estimates_of(counted, est))
    assert judged.count() == 130_000 and judged.where("__q.kept and source = 'rare'").count() > 100


def test_quality_by_shuffle_equals_by_broadcast(spark, monkeypatch):
    rng = np.random.default_rng(2)
    text = lambda i, mark: f"{mark} ".join("abcdefgh"[: rng.integers(2, 9)] + str(i * j) for j in range(30))
    rows = [(i, text(i, "#" if i % 150 == 7 else ""), ("en", "de", None)[i % 3], (None, "a", f"b{i}")[i % 4 % 3]) for i in range(900)]
    rows += [(900, None, "xx", "a"), (901, "one two", None, "zz"), (7, rows[7][1], rows[7][2], rows[7][3])]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    found = []
    for hot in (0, 5, 10**9):
        monkeypatch.setattr(quality, "HOT", hot)
        judged = quality.quality(frame).collect()
        key = lambda r: (r.doc_id, r.kept, r.distance)
        found.append((sorted(map(key, judged), key=str), sorted(r.doc_id for r in quality.keep_good(frame).collect())))
        assert found[-1][1] == sorted(r.doc_id for r in judged if r.kept)
    assert found[0] == found[1] == found[2] and 800 < len(found[0][1]) < 900


def test_topk_with_ties_and_bad_vectors(spark):
    rng = np.random.default_rng(4)
    vectors = [list(map(float, v)) for v in rng.normal(size=(180, 8))] + [[0.5] * 8] * 40
    rows = [(i, v) for i, v in enumerate(vectors)] + [(500, None), (550, [1.0, None]), (600, [float("nan")] * 8), (650, [1.0])]
    frame = topk.whole_vectors(spark.createDataFrame(rows, "vec_id long, e array<float>"), "vec_id", "e")
    got = defaultdict(list)
    for r in topk.top_k(frame, frame.where("vec_id % 50 = 0"), 5, row_block=32, query_block=2).collect():
        got[r.query_id].append((r.rank, r.vec_id, r.score))
    x = {i: np.floor(256 * np.float32(v).astype(float)).astype(int) for i, v in rows[:220]}
    x[650] = np.array([256] + [0] * 7)
    for q in (0, 50, 100, 150, 200, 650):
        best = sorted((-int(x[q] @ v), i) for i, v in x.items() if i != q)[:5]
        assert sorted(got[q]) == [(k + 1, i, -s) for k, (s, i) in enumerate(best)]
    assert set(got) == {0, 50, 100, 150, 200, 650}


def test_sharding(spark, texts):
    rows = sharding.place(docs(spark, texts), 5).collect()
    slots = defaultdict(list)
    for r in rows:
        body = (texts[r.doc_id] or "").encode()
        assert (r.size, r.text_crc32, r.law) == (len(body) + 8, zlib.crc32(body), "key")
        assert r.grown_shard in (r.shard, 5)
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    weighted = sharding.assign_shards(spark.range(20000), [1.0, 3.0], key="id").groupBy("shard").count().collect()
    share = {r.shard: r["count"] / 20000 for r in weighted}
    assert abs(share[1] - 0.75) < 0.02


def test_languages(spark):
    one, two = "der die und nicht schön ist ein haus", "the and not nice is a house with"
    rows = [one] * 30 + [two] * 30 + [None, "", "123 !", " ".join([one] * 8 + [two] * 8), "дом"]
    frame = docs(spark, rows, ["de"] * 30 + ["en"] * 30 + [None] * 5)
    got = {r.doc_id: r for r in langid.identify(frame, langid.train(frame)).collect()}
    assert {got[i].lang_pred for i in range(30)} == {"de"} and {got[i].lang_pred for i in range(30, 60)} == {"en"}
    assert [got[i].lang_pred for i in (60, 61, 62)] == ["und"] * 3
    assert [s.lang for s in got[63].spans] == ["de", "en"]
    empty = langid.identify(frame, langid.train(frame.limit(0)))
    assert {r.lang_pred for r in empty.collect()} == {"und"}


def test_best_path_equals_search():
    rng = np.random.default_rng(8)
    import itertools

    for _ in range(40):
        s = rng.normal(size=(6, 3)) * 3
        value = lambda p: sum(s[i, k] for i, k in enumerate(p)) - 2.0 * sum(a != b for a, b in zip(p, p[1:]))
        best = max(itertools.product(range(3), repeat=6), key=value)
        assert abs(value(best) - value(langid.best_path(s, 2.0).tolist())) < 1e-9


def test_best_path_of_two_languages_beside_a_third():
    s = np.array([[0.0, -12, -5]] * 2 + [[-12.0, 0, -5]] * 2)
    assert langid.best_path(s, 12.0).tolist() == [0, 0, 1, 1]
    rng = np.random.default_rng(11)
    import itertools

    for _ in range(60):  # words that favour no language, and two that adjoin
        s = -rng.integers(0, 4, (6, 3)).astype(float)
        value = lambda p: sum(s[i, k] for i, k in enumerate(p)) - 4.0 * sum(a != b for a, b in zip(p, p[1:]))
        assert value(langid.best_path(s, 4.0).tolist()) == max(map(value, itertools.product(range(3), repeat=6)))


def test_toxicity(spark):
    rng = np.random.default_rng(6)
    words = [f"plain{chr(97 + i)}{chr(97 + j)}" for i in range(20) for j in range(10)]
    rows, marks = [], []
    for i in range(600):
        w = list(rng.choice(words, 40))
        if i % 4 == 0:
            for p in rng.integers(0, 40, 4):
                w[p] = rng.choice(["vileone", "viletwo", "vilethree"])
        rows.append(" ".join(w))
        marks.append(int(i % 4 == 0))
    frame = docs(spark, [*rows, None, ""])
    labels = spark.createDataFrame([(i, 1, m) for i, m in enumerate(marks)] + [(5, 1, None)], "doc_id long, quality int, toxic int")
    scorer = toxicity.train(frame, labels)
    out = {r.doc_id: r.score for r in scorer.score(frame).collect()}
    assert len(out) == 602 and all(0 <= s <= 1 for s in out.values())
    held = [i for i in range(600) if zlib.crc32(str(i).encode()) % 5 == 0]
    assert np.mean([(out[i] >= 0.5) == bool(marks[i]) for i in held]) > 0.95
    none = toxicity.train(frame, labels.limit(0)).score(frame).select("score").distinct().collect()
    assert [r.score for r in none] == [0.0]


def test_jaccard_with_tokens_that_fall_together(spark, texts, monkeypatch):
    """Few bits a token and few frequent tokens change the candidates only."""
    monkeypatch.setattr(jaccard, "TOKEN_BITS", 14)
    monkeypatch.setattr(jaccard, "FREQUENT", 20)
    sizes, label = brute_components(texts)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.jaccard_components(docs(spark, texts)).collect()}
    assert got == {i: (sizes[i], label[i]) for i in range(len(texts))}


def test_jaccard_with_postings_sent_in_small_parts(spark, texts, monkeypatch):
    """Few postings a row, and places that are cut early, change the candidates only."""
    monkeypatch.setattr(jaccard, "GATHERED", 40)
    monkeypatch.setattr(jaccard, "FAR_PLACE", 3)
    sizes, label = brute_components(texts)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.jaccard_components(docs(spark, texts)).collect()}
    assert got == {i: (sizes[i], label[i]) for i in range(len(texts))}


def test_postings_are_shuffled_once_in_rows_of_many(spark):
    """Before, every posting was a row of its own and went through a second shuffle."""
    texts = [" ".join(f"w{i % 20}x{k}" for k in range(100)) for i in range(40)] + [" ".join(f"b{k}" for k in range(60)) + f" a{i}" for i in range(30)]
    rows = docs(spark, texts)
    frequent = jaccard._frequent_tokens(rows)
    posts = jaccard._postings(rows, frequent)
    lists = jaccard._lists(posts)
    plan = lists._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(") == 1
    assert plan.index("Generate") < plan.index("Exchange hashpartitioning(")  # a row is a part while it travels
    got = Counter((r.token, r.salt, r.key) for r in lists.collect())
    assert set(got.values()) == {1}
    some = {r.key for r in posts.select("key").distinct().collect()}
    assert len(some) == 50 and all(k in some for _, _, k in got)
    # the tokens that all the last texts share are frequent: their lists are split by salts and hold every text
    held = Counter(t for t, salt, _ in got if salt)
    assert held and max(held.values()) == 30


def test_lists_that_are_done_are_not_read_again(spark):
    """A list whose classes are in one component, or that was compared in full, leaves the rounds."""
    rows = [(t, 0, k, 10, 0, k) for t, keys in ((1, (1, 2, 3)), (2, (4, 5, 6)), (3, (7, 8))) for k in keys]
    state = spark.createDataFrame(rows, "token long, salt int, key long, n long, pos long, comp long")
    comps = spark.createDataFrame([(k, 1 if k < 4 else min(k, 5)) for k in range(1, 7)] + [(7, 7), (8, 8)], "node long, comp long")
    left = jaccard._mixed(state, comps, 2)
    assert sorted((r.token, r.key, r.comp, r["all"]) for r in left.collect()) == [(2, 4, 4, 3), (2, 5, 5, 3), (2, 6, 5, 3)]


def test_frequent_tokens_are_those_with_high_counts(spark, monkeypatch):
    """The list is bounded also where most counts are equal; no token left out is counted more often than one in it."""
    rows = docs(spark, [f"a b c d e {i % 3} x{i} y{i} z{i} u{i} v{i}" for i in range(60)])
    every = jaccard._frequent_tokens(rows)
    assert len(every) == len(set(every)) >= 4 and (np.diff(every) > 0).all() and every.dtype == np.int32
    for many in (10, 10_000):
        monkeypatch.setattr(jaccard, "MANY", many)
        monkeypatch.setattr(jaccard, "FREQUENT", 1)
        assert set(jaccard._frequent_tokens(rows)) <= set(every)
