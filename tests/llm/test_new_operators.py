"""Token alignment, decontamination and collocations against brute force: nulls, empty and long texts, ties, repeats, clashing columns."""

import random
import re
from collections import Counter

import numpy as np
import pytest

from scoutml.llm import collocations, decontaminate, token_align
from scoutml.llm.common import stored
from tests.llm.test_operators import SCHEMA, docs

LOW = {c: c + 32 for c in range(65, 91)}


def naive_alignment(coder, text):
    """Counts, groups as text and linked pairs from the vocabularies' own codes of the whole text."""
    none = (0, 0, 0, 0), "", Counter()
    if not text:
        return none
    a, b = coder.a.encode(" " + text, add_special_tokens=False).ids, coder.b.encode(text)
    size_a, size_b = [coder.a_bytes[i] for i in a], [coder.b_bytes[i] for i in b]
    raw = (" " + text).encode()
    if b"".join(size_a) != raw or b"".join(size_b) != raw:
        return none
    ends_a, ends_b = np.cumsum([len(x) for x in size_a]).tolist(), np.cumsum([len(x) for x in size_b]).tolist()
    groups, links, i, j = [], Counter(), 0, 0
    for end in sorted(set(ends_a) & set(ends_b)):
        x, y = i, j
        while i < len(a) and ends_a[i] <= end:
            i += 1
        while j < len(b) and ends_b[j] <= end:
            j += 1
        groups.append(",".join(map(str, a[x:i])) + "|" + ",".join(map(str, b[y:j])))
        for k in range(x, i):
            for m in range(y, j):
                if max(ends_a[k] - len(size_a[k]), ends_b[m] - len(size_b[m])) < min(ends_a[k], ends_b[m]):
                    links[a[k], b[m]] += 1
    return (len(a), len(b), len(groups), sum(links.values())), ";".join(groups), links


@pytest.fixture(scope="module")
def coder():
    return token_align.Aligner()


@pytest.fixture(scope="module")
def odd_texts():
    rnd = random.Random(5)
    parts = ["a", "b", " ", " ", "  ", "the", " the", "\n", "\t", " \n", "1", "23", "é", "ñ", "日本", "😀", "\x00", "\x1c", "▁", "<|endoftext|>", "<s>",
             "\xa0", "　", "'s", "...", "=", "x" * 300, "\r\n", "\x85", "ﬁ", " Cor", "ciónñ", "²", "½ "]
    made = ["".join(rnd.choice(parts) for _ in range(rnd.randint(1, 30))) for _ in range(1500)]
    return [None, "", " ", "  ", "a ", "\n", "▁", " foo", " \n x ", "the same", "the same", "word " * 20000, *made]


def test_alignment_equals_brute_force(coder, odd_texts):
    counts, groups, codes, uses = coder.align(odd_texts)
    for i, text in enumerate(odd_texts):
        c, g, links = naive_alignment(coder, text)
        assert (tuple(counts[i]), groups[i]) == (c, g), text
        got = {divmod(x, token_align.WIDTH): n for x, n in zip(np.frombuffer(codes[i], np.int32).tolist(), np.frombuffer(uses[i], np.int32).tolist())}
        assert got == links
    small = token_align.Aligner(limit=50)  # forgets all the time
    assert [small.align([t])[1][0] for t in odd_texts[:400]] == groups[:400]


def test_runs_and_irregular_groups():
    rnd = random.Random(1)
    for _ in range(300):
        n = rnd.randint(1, 60)
        a, b = (sorted({n, *rnd.sample(range(1, n + 1), rnd.randint(0, n - 1))}) for _ in range(2))
        groups = token_align.align_ends(a, b)
        common = sorted(set(a) & set(b))
        assert groups.tolist() == [[a.index(c) + 1, b.index(c) + 1] for c in common]
        links = token_align.links_of(np.array(a), np.array(b), groups)
        starts = lambda e: [0, *e[:-1]]
        assert links.tolist() == [[i, j] for i, (s, e) in enumerate(zip(starts(a), a)) for j, (t, f) in enumerate(zip(starts(b), b)) if max(s, t) < min(e, f)]


def test_link_counts_over_documents(spark, coder, odd_texts):
    texts = odd_texts[:300]
    known = [naive_alignment(coder, t) for t in texts]
    held = Counter(x for _, _, links in known for x in links)
    top = Counter()
    for (a, _), n in held.items():
        top[a] = max(top[a], n)
    rows = token_align.weigh_links(stored(token_align.align_documents(docs(spark, texts).repartition(3)))).collect()
    assert len(rows) == len(texts)
    for r in rows:
        c, g, links = known[r.doc_id]
        assert (r.n_a, r.n_b, r.n_groups, r.n_links) == c and r.groups == g
        assert r.count_sum == sum(held[x] * n for x, n in links.items())
        assert r.n_best == sum(n for x, n in links.items() if held[x] == top[x[0]])
    empty = token_align.weigh_links(stored(token_align.align_documents(spark.createDataFrame([], SCHEMA))))
    assert empty.count() == 0


def naive_hits(texts, items):
    """Per text: words, hit words, ids of items with windows in it."""
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(LOW))
    windows = [(tuple(w[k : k + 10]), item) for item, t in items for w in [words(t)] if w for k in range(max(len(w) - 9, 1))]
    out = []
    for t in texts:
        w, hit, ids = words(t), set(), set()
        for window, item in windows:
            n = len(window)
            for k in range(len(w) - n + 1):
                if tuple(w[k : k + n]) == window:
                    hit.update(range(k, k + n))
                    ids.add(item)
        out.append((len(w), len(hit), sorted(str(i) for i in ids if i is not None)))
    return out


def test_windows_equal_brute_force(spark, monkeypatch):
    rnd = random.Random(2)
    words = [f"w{k}" for k in range(12)] + ["É", "é", "İ", "ǅ", "ab9", "日本"]
    run = lambda n: " ".join(rnd.choice(words) for _ in range(n))
    items = [(f"i{k}", run(rnd.randint(10, 25))) for k in range(12)]
    items += [("i3", run(12)), ("short", "w1 w2 w3"), ("one", "日本"), ("seven", run(7)), (None, run(14)), ("blank", "... "), ("null", None), ("again", items[0][1]),
              ("b,c", items[1][1]), (" long", " ".join(["w1"] * 30))]
    texts = [None, "", " . ", "W1, W2? w3!", "日本日本 x", "É é", run(3000), " ".join(["w1"] * 500)]
    for _, t in items:
        w = (t or "x").split()
        texts.append(run(5) + " - " + "; ".join(w[: rnd.randint(1, len(w) + 1)]).upper() + ", " + run(4))
    texts += texts[:6]
    table = spark.createDataFrame(items, "item_id string, text string")
    for block in (decontaminate.BLOCK, 7):  # one block, and many
        monkeypatch.setattr(decontaminate, "BLOCK", block)
        rows = {r.doc_id: r for r in decontaminate.contaminated_words(docs(spark, texts), table).collect()}
        assert len(rows) == len(texts)
        for i, want in enumerate(naive_hits(texts, items)):
            assert (rows[i].n_words, rows[i].n_hit, rows[i]["items"]) == want, texts[i]
        texts, items = texts[:6] + texts[-12:], items[-10:]
        table = spark.createDataFrame(items, "item_id string, text string")


def test_decontamination_without_rows(spark):
    items = spark.createDataFrame([(1, "w1 w2")], "item_id long, text string")
    assert decontaminate.contaminated_words(spark.createDataFrame([], SCHEMA), items).count() == 0
    for none in (items.where("false"), items.selectExpr("item_id", "cast(null as string) as text")):
        (row,) = decontaminate.contaminated_words(docs(spark, ["w1 w2"]), none).collect()
        assert (row.n_words, row.n_hit, row["items"], row.spans) == (2, 0, [], [])
    absent = decontaminate.contaminated_words(docs(spark, ["w1 w3"]), items).collect()
    assert [(r.n_hit, r["items"]) for r in absent] == [(0, [])]


def naive_collocations(rows, least, cover, top):
    f, n = {}, Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOW)):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in (1, 2, 3):
                for i in range(len(w) - k + 1):
                    key = lang, tuple(w[i : i + k])
                    f[key] = f.get(key, 0) + 1
    out = {}
    for (lang, p), a in f.items():
        if len(p) < 2 or a < least:
            continue
        if any(100 * f[lang, q] >= cover * a and f[lang, q] >= least for lang2, q in f if lang2 == lang and len(q) > len(p) and p in (q[:2], q[1:])):
            continue
        cuts = [(1_000_000 * a * a // (f[lang, p[:k]] * f[lang, p[k:]]), k) for k in range(1, len(p))]
        score, k = min(cuts)
        out.setdefault(lang, []).append((-score, -a, " ".join(p).encode(), f[lang, p[:k]], f[lang, p[k:]]))
    return sorted((g, i + 1, p.decode(), -a, l, r, n[g], -s) for g, found in out.items() for i, (s, a, p, l, r) in enumerate(sorted(found)[:top]))


def test_collocations_equal_brute_force(spark, monkeypatch):
    rnd = random.Random(9)
    words = ["New", "york", "city", "the", "a", "é", "Ångström", "日本", "x\x1cy", "\x00", "it's", "(z)"]
    phrases = ["new york city", "san francisco", "the a", "日本 é", "a b c"]
    line = lambda: " ".join(rnd.choice(phrases) if rnd.random() < 0.4 else rnd.choice(words) for _ in range(rnd.randint(0, 40)))
    texts = [line() + rnd.choice([". ", ", ", "\n", "\t", ";;", "\x0b"]) + line() for _ in range(120)]
    rows = [(rnd.choice(["en", "en", "de", "und", None, "x y"]), t) for t in texts]
    rows += [("en", None), ("en", ""), ("de", "..."), (None, "a"), ("en", "tail " * 3000 + "q" * 9000), rows[0], rows[0]]
    table = spark.createDataFrame([(g, t, 1, 2, "k") for g, t in rows], "lang string, text string, a long, f long, w1 string")
    want = naive_collocations(rows, 10, 50, 25)
    for chunk, part in ((collocations.CHUNK, collocations._PART), (500, 64)):
        monkeypatch.setattr(collocations, "CHUNK", chunk)
        monkeypatch.setattr(collocations, "_PART", part)
        got = collocations.top_phrases(collocations.collocations(table.repartition(3)), top=25).collect()
        assert sorted(tuple(r) for r in got) == want
    assert len(want) > 20


def test_collocations_without_rows(spark):
    assert collocations.collocations(spark.createDataFrame([], "lang string, text string")).count() == 0
    assert collocations.collocations(spark.createDataFrame([("en", "a b")], "lang string, text string")).count() == 0


def test_scores_are_exact_past_64_bits(spark):
    from pyspark.sql import functions as F

    a, left, right = 3_000_000_017, 3_100_000_007, 9_000_000_000_011
    (row,) = spark.range(1).select(collocations._score(F.lit(a), F.lit(left), F.lit(right)).alias("s")).collect()
    assert row.s == 1_000_000 * a * a // (left * right)


def test_long_words_with_exchanged_blocks_differ():
    from scoutml.llm import shingles
    from scoutml.llm.common import load_tokenizer
    from scoutml.llm.words_bpe import VOCABULARY, WordEncoder

    a, b = ("one " + x * 4096 + y * 4096 + " two" for x, y in ("ab", "ba"))
    first, second = shingles.shingle_sets([a, b])
    assert first.tolist() != second.tolist()
    tok = load_tokenizer(VOCABULARY)
    assert [g.tolist() for g in WordEncoder().encode([a, b])] == [tok.encode(t, add_special_tokens=False).ids for t in (a, b)]


def test_numerals_are_no_letters(spark):
    from scoutml.llm import langid

    assert langid.words_of("² ½ ① Ⅳ 12 _") == [] and langid.words_of("a² b_c Ünï 12x 一") == ["a", "b", "c", "Ünï", "x", "一"]
    frame = docs(spark, ["the cat and the dog", "der hund und die katze", "² ½"], ["en", "de", "en"])
    found = {r.doc_id: r for r in langid.identify(frame, langid.train(frame)).collect()}
    assert (found[2].lang_pred, found[2].score) == ("und", 0.0)


def test_top_k_counts_repeated_rows_and_is_exact():
    from scoutml.llm import topk

    rng = np.random.default_rng(4)
    rows = rng.integers(-(10**9), 10**9, (120, 5))
    rows[100:] = rows[:20]
    ids = np.concatenate([np.arange(100), np.repeat([3, 3, 500, 501], 5)])
    queries, own = rows[:6], ids[:6]
    got = sorted(topk.block_top(queries, own, rows, ids, 5))
    want = []
    for q, mine in zip(queries, own):
        scores = sorted((-sum(int(a) * int(b) for a, b in zip(q, r)), int(i)) for r, i in zip(rows, ids) if i != mine)
        want += [(int(mine), i, -s) for s, i in scores[:5]]
    assert got == sorted(want)
    with pytest.raises(OverflowError):
        topk.block_top(rows[:1] * 10**8, ids[:1], rows * 10**3, ids, 5)


def test_pipeline_stages_keep_columns_with_clashing_names(spark):
    import corpus_pipeline
    from pyspark.sql import functions as F

    rnd = random.Random(3)
    line = lambda: " ".join(rnd.choice("alpha beta gamma delta house river stone cloud".split()) + str(rnd.randint(0, 99)) for _ in range(30))
    texts = [line() for _ in range(12)] + [None, "", "too short"]
    texts += texts[:2]
    names = ["__q", "__l", "__s", "__e", "hot", "__row", "__x", "__raw", "__score", "score", "__seat", "__keep", "grp"]
    plain = docs(spark, texts).drop("key", "n", "label", "code")
    extra = plain.withColumns({c: F.concat(F.lit(c), F.coalesce(F.col("text"), F.lit(""))) for c in names})
    for name, stage in corpus_pipeline.STAGES[:4]:
        kept = stage(spark, extra, "/root/testdata/sf0.001")
        assert kept.columns == extra.columns, name
        rows = kept.collect()
        if name != "secret_scans":
            assert all(r[c] == c + (r.text or "") for r in rows for c in names), name
            assert sorted(r.doc_id for r in rows) == sorted(r.doc_id for r in stage(spark, plain, "/root/testdata/sf0.001").collect()), name
        assert stage(spark, extra.where("false"), "/root/testdata/sf0.001").count() == 0
