"""Training-data operators against brute force on small fixtures with the awkward cases."""

import hashlib
import itertools
import random
import re
import tracemalloc

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from lamella.llm import chat, exact_dedup, fingerprint, html_text, html_training, langid, mixing, pieces, quality, simhash, toxicity
from lamella.llm.common import crc32_of, pieces as slices

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = "the of and ion the red fox runs over a lazy dog while rain falls on old roofs and green hills sleep under slow clouds".split()


def sentence(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(1)
    long = sentence(rng, 4000)
    out = [(i, sentence(rng, int(rng.integers(0, 60))), "en", f"s{i % 3}", 0) for i in range(60)]
    out += [(100, None, None, None, None), (101, "", "en", "s1", 0), (102, "  \n", "en", "s1", 0), (103, long, "de", "s1", 0), (104, long.upper(), "de", None, 0), (105, long + " x", "de", "s1", 0)]
    out += [(106 + i, "Ein GUTER Text É", "de", "s2", 0) for i in range(5)] + [(None, "no id", "en", "s2", 0), (0, out[0][1], "en", "s0", 0)]
    return out


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, DOCS).withColumns({"key": F.lit(1), "n": F.lit("x"), "name": F.lit("y"), "row_id": F.lit(0), "label": F.lit(3), "fp": F.lit(7), "r": F.lit(2)}).repartition(3)


def low(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


@pytest.mark.parametrize("naming", [exact_dedup.BlockNaming(), exact_dedup.BlockNaming(8, 64), exact_dedup.BlockNaming(8, 3)])
def test_exact_groups(docs, rows, naming):
    got = exact_dedup.exact_groups(docs, naming=naming).collect()
    groups = {}
    for i, text, *_ in rows:
        groups.setdefault(low(text), []).append(i)
    assert len(got) == len(rows)
    for r in got:
        own = next(v for k, v in groups.items() if hashlib.sha256(k.encode()).hexdigest() == r.text_sha256)
        assert r.group_size == len(own) and r.keep_id == max((x for x in own if x is not None), default=None)
    assert sum(r.kept for r in got) == len(groups)


def test_exact_groups_without_rows(spark):
    empty = spark.createDataFrame([], DOCS)
    assert exact_dedup.exact_groups(empty).count() == 0
    assert exact_dedup.drop_copies(empty).count() == 0


def test_copies_go_by_row(spark):
    rows = [(7, "a copy", "en", "s0", 0), (None, "A copy", "de", "s1", 1), (None, "only here", "en", "s2", 2), (None, "here too", "en", "s3", 3)]
    rows += [(5, "another", "en", "s4", 4), (5, "a copy", "en", "s5", 5), (8, "same row", "en", "s6", 6), (8, "same row", "en", "s6", 6), (None, None, None, None, 7), (None, "", "en", "s8", 7)]
    left = exact_dedup.drop_copies(spark.createDataFrame(rows, DOCS).repartition(3))
    assert left.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    assert sorted(r.n_chars for r in left.collect()) == [0, 2, 3, 4, 6, 7]


def test_fingerprints(docs, rows):
    got = fingerprint.edited_likeness(docs).collect()
    order = sorted(((i, t or "") for i, t, *_ in rows), key=lambda x: (x[0] is None, -(x[0] or 0), x[1]))
    want = {}
    for (i, t), (_, after) in zip(order, order[1:] + order[:1], strict=True):
        h = len(t) // 2
        want.setdefault(i, set()).add(hashlib.sha256((t[: len(t) - h] + after[:h]).encode()).hexdigest())
    assert len(got) == len(rows) and all(r.edited_sha256 in want[r.doc_id] for r in got)
    assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in got)
    by_text = {}
    for r in fingerprint.fingerprints(docs).collect():
        by_text.setdefault(next((t or "") for i, t, *_ in rows if i == r.doc_id), set()).add(r.fingerprint)
    assert all(len(v) == 1 for v in by_text.values())


def test_chunks_shift_with_the_text():
    c = fingerprint.Chunking()
    text = sentence(np.random.default_rng(5), 600).encode()
    a, b, again = c.sets([text, b"some words before " + text, text])
    assert a == again and fingerprint.containment(a, b) > 0.95
    assert sum((x & 255) + 1 for x in c.sets([b"abc" * 5])[0]) == 15


def brute_components(prints):
    distinct = sorted(set(prints.values()))
    root = {x: x for x in distinct}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(distinct, 2):
        if bin(a ^ b).count("1") <= 2:
            root[find(a)] = find(b)
    best = {}
    for i, p in prints.items():
        if i is not None:
            best[find(p)] = min(best.get(find(p), i), i)
    return {i: best.get(find(p)) for i, p in prints.items()}


@pytest.mark.parametrize("joined", [256, 0])
def test_simhash(docs, rows, joined):
    got = {r.doc_id: r for r in simhash.near_groups(docs, simhash=simhash.SimHash(3, joined)).collect()}
    prints = {}
    for i, text, *_ in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", low(text))
        h = [xxhash.xxh64_intdigest(" ".join(words[k : k + 3]).encode(), 42) for k in range(max(1, len(words) - 2))] if words else []
        prints[i] = sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h)) if h else 0
    want = brute_components(prints)
    assert {i: (f"{p:016x}", want[i]) for i, p in prints.items()} == {i: (r.fingerprint, r.component_id) for i, r in got.items()}


def test_golay_keys_meet():
    rng = np.random.default_rng(0)
    x = rng.integers(0, 1 << 63, 2000, dtype=np.uint64)
    for a, b in itertools.combinations_with_replacement(range(0, 64, 7), 2):
        y = x ^ (np.uint64(1) << np.uint64(a)) ^ (np.uint64(1) << np.uint64(b)) if a != b else x ^ (np.uint64(1) << np.uint64(a))
        near, every = simhash.key_arrays(x)[0], simhash.key_arrays(y)[1]
        assert (near[:, :, None] == every[:, None, :]).any((1, 2)).all()


@pytest.mark.parametrize("joined", [32, 1])
def test_near_copies(spark, joined):
    rng = np.random.default_rng(2)
    base = [sentence(rng, 150).split() for _ in range(6)]
    texts = []
    for b in base:
        for k in range(7):
            t = list(b)
            for _ in range(k):
                t[int(rng.integers(len(t)))] = f"w{rng.integers(99)}"
            texts.append(" ".join(t))
    near = simhash.NearCopies(joined=joined)
    kept = {r.doc_id for r in simhash.drop_near_copies(spark.createDataFrame([(i, t, "en", "s", 0) for i, t in enumerate(texts)], DOCS), near).collect()}
    sets = [frozenset(near.shingles(t.encode()).tolist()) for t in texts]
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(range(len(texts)), 2):
        if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
            x, y = sorted((find(a), find(b)))
            root[y] = x
    assert kept == {find(i) for i in range(len(texts))}


def test_near_copies_under_a_common_passage(spark):
    rng = np.random.default_rng(5)
    fresh = lambda n: [f"w{x}" for x in rng.integers(1 << 40, size=n)]
    texts = []
    for share in (0.75, 0.8, 0.85, 0.88):
        passage = fresh(int(150 * share))
        for i in range(900):
            own = fresh(150 - len(passage))
            texts.append(" ".join(passage + own))
            if i % 6 == 0:  # a copy with a similarity of 0.82
                texts.append(" ".join(passage + own[:-15] + fresh(15)))
    near = simhash.NearCopies()
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in enumerate(texts)], DOCS)
    sets = [frozenset(near.shingles(t.encode()).tolist()) for t in texts]
    alike = [(i, i + 1) for i in range(len(texts) - 1) if len(sets[i] & sets[i + 1]) >= 0.8 * len(sets[i] | sets[i + 1])]
    assert len(alike) == 600
    kept = {r.doc_id for r in simhash.drop_near_copies(docs, near).collect()}
    assert kept == set(range(len(texts))) - {b for _, b in alike}


def test_unlike_pairs_go_by_their_parities(spark, monkeypatch):
    """Texts that share most minima but less than a link asks for never ask for sets, and alike ones still do."""
    rng = np.random.default_rng(7)
    fresh = lambda n: [f"w{x}" for x in rng.integers(1 << 40, size=n)]
    passage = fresh(120)
    texts = [" ".join(passage + fresh(30)) for _ in range(30)]
    texts += [" ".join([*t.split()[:-2], *fresh(2)]) for t in texts[:5]]
    near = simhash.NearCopies()
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in enumerate(texts)], DOCS)
    asked, chosen = [], simhash.NearCopies.chosen
    monkeypatch.setattr(simhash.NearCopies, "chosen", lambda self, docs, ids, *rest: (asked.append(ids.count()), chosen(self, docs, ids, *rest))[1])
    pairs = spark.createDataFrame([(b, a) for a, b in itertools.combinations(range(len(texts)), 2)], "a long, b long")
    alike = near.verified(docs, near.sketches(docs), pairs).collect()
    assert {(r.a, r.b) for r in alike} == {(30 + i, i) for i in range(5)} and asked == [2 * 5]
    sets = [near.shingles(t.encode()) for t in texts]
    odd = [np.frombuffer(simhash.parities(x), dtype=np.uint8) for x in sets]
    assert all(np.bitwise_count(odd[i] ^ odd[j]).sum() <= len(np.setxor1d(sets[i], sets[j])) for i, j in itertools.combinations(range(len(texts)), 2))


def test_mixing_by_the_subjects_of_whole_texts(spark):
    """Topics follow what texts say, not their first line; their targets hold within each language and leave enough to draw."""
    rng = np.random.default_rng(8)
    words = {s: [f"{s}{''.join(rng.choice(list('abcdefgh'), 6))}" for _ in range(30)] for s in ("sea", "tax", "mehl", "wald")}
    rows = []
    for i in range(400):
        lang, subject = [("en", "sea"), ("en", "sea"), ("en", "tax"), ("de", "mehl"), ("de", "wald")][i % 5]
        rows.append((i, f"line {i}\n" + " ".join(rng.choice(words[subject], 12)), lang, f"s{i % 2}", 0))
    said = {r[0]: [("en", "sea"), ("en", "sea"), ("en", "tax"), ("de", "mehl"), ("de", "wald")][r[0] % 5][1] for r in rows}
    drawn = mixing.Mixture(rounds=30).draws(spark.createDataFrame(rows, DOCS)).toPandas()
    subjects = drawn.assign(said=drawn.doc_id.map(said)).groupby(["lang", "topic"]).said.agg(lambda x: x.value_counts(normalize=True).iloc[0])
    assert len(drawn) == 400 and (subjects > 0.9).all() and drawn.sampled.mean() > 0.5
    drawn["raked"] = drawn.tokens * drawn.weight
    flat = drawn.groupby(["lang", "topic"]).tokens.sum() ** 0.7
    share = drawn.groupby(["lang", "topic"]).raked.sum()
    for lang, n in (drawn.groupby("lang").tokens.sum() ** 0.7).pipe(lambda x: x / x.sum()).items():
        assert (share[lang] / share.sum()).to_numpy() == pytest.approx((n * flat[lang] / flat[lang].sum()).to_numpy(), abs=1e-5)


def test_mixing_meets_its_targets(spark, docs):
    rng = np.random.default_rng(3)
    every = [(i, sentence(rng, int(rng.integers(5, 60))), lang, source, 0, topic) for i, (lang, source, topic) in enumerate(itertools.product(["en", "de"], ["a", "b", "c"], ["t", "u"] * 4))]
    full = spark.createDataFrame(every, DOCS + ", topic string")
    drawn = mixing.Mixture(rounds=30, weights={"lang": {"de": 0.25}}).draws(full, "topic").toPandas()
    total = (drawn.tokens * drawn.weight).sum()
    assert total == pytest.approx(drawn.tokens.sum(), rel=1e-6)
    share = lambda c, x: ((drawn.tokens * drawn.weight)[drawn[c] == x]).sum() / total
    plain = lambda c, x: drawn.tokens[drawn[c] == x].sum() / drawn.tokens.sum()
    assert share("lang", "de") == pytest.approx(0.25, abs=1e-6)
    for c, names in (("source", "abc"), ("topic", "tu")):
        flat = {x: plain(c, x) ** 0.7 for x in names}
        assert all(share(c, x) == pytest.approx(v / sum(flat.values()), abs=1e-6) for x, v in flat.items())
    assert drawn.prob.max() == pytest.approx(1) and ((drawn.u < drawn.prob) == drawn.sampled).all()
    # Awkward rows: every row comes back, and the same rows are drawn whole.
    assert mixing.Mixture().draws(docs).count() == docs.count()
    assert mixing.Mixture().draws(docs.limit(0)).count() == 0
    assert set(mixing.mixed(docs).columns) == set(docs.columns)


def test_html_text():
    cut = html_text.MinCut(html_training.trained())
    assert cut.text(None) == cut.text("") == cut.text("<script>x</script>") == ""
    page = """<html><head><title>t</title></head><body><header><div>Site</div></header><nav><ul><li><a href=/>Home</a></ul></nav>
    <div class="cookie-notice"><p>We use cookies to improve your experience on our site. Please accept.</p></div>
    <article><h1>Head &amp; line</h1><p>First  paragraph<br>goes on &lt;here&gt;.<p>Short.<div class=ad>Buy now, the best offer.</div><p>Last&nbsp;one</article>
    <section class=comments><p>I liked this article a lot, it is so long.</p></section><form><p>Subscribe here.</p></form><footer>&copy; 2020</footer>"""
    assert cut.text(page) == "Head & line\nFirst paragraph goes on <here>.\nShort.\nLast one"
    cut.text("<div " * 3000 + "<!-- " + '<a b="' * 50)


def test_articles_survive_names_and_foreign_elements():
    cut = html_text.MinCut(html_training.trained())
    said = "Nobody knew the old mill as she did, and nobody else had walked the long way round in winter. " * 3
    said = said.strip()
    assert cut.text(f"<p>Icon <svg width=1/> second paragraph of it, with some words.</p><p>Third {said}</p>").split("\n")[1:] == ["second paragraph of it, with some words.", f"Third {said}"]
    for names in ("review related-story", "post-comment-free story"):
        assert cut.text(f'<article class="{names}"><p>{said}</p><p>{said} Yes.</p></article>') == f"{said}\n{said} Yes."
    assert cut.text(f"<article><p>{said}</p><object><object>a</object>b</object><svg><title>t</title><path d=''></svg><p>{said}</p></article>") == f"{said}\n{said}"
    assert cut.text(f"<article><p>{said}</p><template><p>{said}") == f"{said}\n{said}"  # it never ends


def test_deep_pages_take_linear_time():
    import time

    cut = html_text.MinCut(html_training.trained())
    for page in ("<div>" * 100_000 + "x", "<div>x" * 10_000, "</b>" * 100_000 + "y", "<li>x" * 10_000, "<p><b>x" * 10_000):
        began = time.thread_time()
        cut.text(page)
        assert time.thread_time() - began < 4


def test_blocks_are_labelled_as_written():
    x, y = html_training.rows(40, seed=99)
    assert ((x @ np.array(html_training.trained()) > 0) == (y == 1)).mean() > 0.95


def test_minimum_cut_is_minimal():
    rng = np.random.default_rng(4)
    for _ in range(40):
        n = int(rng.integers(1, 9))
        lean = rng.normal(size=n).tolist()
        edges = [(i, j, float(rng.random())) for i, j in itertools.combinations(range(n), 2) if rng.random() < 0.5]
        cost = lambda x: -sum(v for v, k in zip(lean, x, strict=True) if k) + sum(w for i, j, w in edges if x[i] != x[j])  # noqa: E731, B023
        assert cost(html_text.minimum_cut(lean, edges)) == pytest.approx(min(map(cost, itertools.product([False, True], repeat=n))))


def test_pages(spark):
    pages = spark.createDataFrame([(1, "u", None), (1, "u", "<p>A text of some words, that is long enough."), (None, None, "")], "page_id long, url string, html string").withColumn("text", F.lit(1))
    got = sorted((r.page_id or 0, r.text, r.n_chars) for r in html_text.main_texts(pages).collect())
    assert got == [(0, "", 0), (1, "", 0), (1, "A text of some words, that is long enough.", 42)]


def test_languages(spark, docs):
    rng = np.random.default_rng(6)
    say = {"x": "the quick thing with others", "y": "der schnelle und alte hund", "z": "el perro viejo y rapido"}
    rows = [(i, " ".join(rng.permutation(say[lang].split() * 4)), lang, "s", 0) for i in range(90) for lang in [list(say)[i % 3]]] + [(900, None, "x", "s", 0), (901, "12 !", "x", "s", 0)]
    got = {r.doc_id: r for r in langid.languages_of(spark.createDataFrame(rows, DOCS)).collect()}
    assert all(got[i].lang_pred == lang for i, _, lang, *_ in rows[:90])
    assert got[900].lang_pred == got[901].lang_pred == "und" and got[900].score == 0
    assert all(got[i].held_out == (crc32_of(i) % 4 == 2) and 0 <= got[i].score <= 1 for i in got)
    assert {r.lang_pred for r in langid.languages_of(docs.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}


def learnt(spark, f, good, bad, column):
    rng = np.random.default_rng(8)
    rows = [(i, sentence(rng, 40) if i % 2 else bad(rng), "en", "s", 0) for i in range(160)] + [(1000, None, "en", "s", 0), (1001, "", "en", "s", 0)]
    labels = spark.createDataFrame([(i, int(good if i % 2 else 1 - good)) for i in range(160)] + [(5, None), (None, 1)], f"doc_id long, {column} int")
    docs = spark.createDataFrame(rows, DOCS).withColumn("label", F.lit(9))
    got = {r.doc_id: r for r in f(docs, labels).collect()}
    assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got.values())
    right = [(got[i].score >= 0.5) == bool(good if i % 2 else 1 - good) for i in range(160) if got[i].held_out]
    assert np.mean(right) > 0.9
    none = f(docs, labels.limit(0)).collect()
    assert len({r.score for r in none}) == 1
    assert f(docs.limit(0), labels).count() == 0


def test_quality(spark):
    learnt(spark, quality.quality_of, 1, lambda rng: " ".join(f"{w}*** ### {w.upper()}!!" for w in sentence(rng, 15).split()), "quality")


def test_toxicity(spark):
    insults = ["stinkworm", "blubberhead", "stinkworms", "blubberheads"]
    learnt(spark, toxicity.toxicity_of, 0, lambda rng: sentence(rng, 20) + f" {rng.choice(insults)} " + sentence(rng, 9) + f" {rng.choice(insults)}.", "toxic")


def test_kernel_tolerates_gaps():
    rng = np.random.default_rng(9)
    texts = [f"{sentence(rng, 12)} stinkworm {sentence(rng, 5)} blubberhead" for _ in range(60)] + [sentence(rng, 20) for _ in range(60)]
    m = toxicity.fit(texts, np.array([1.0] * 60 + [0.0] * 60))
    f = lambda w: toxicity.margins([w.encode()], m.weights, m.bias)[0].max()
    clean = max(f(w) for w in WORDS if len(w) > 2)
    for form in ("stinkworm", "s.t.i.n.k.w.o.r.m", "stink-worm", "s t i n k w o r m", "st1nkw0rm", "stinxkworm"):
        assert f(form) > clean, form


def test_kernel_is_the_direct_sum():
    def direct(word):
        """Weights of the subsequences of a word between spaces, and the sum of squared weights of its steps."""
        s, out, d = [int(x) for x in toxicity.symbols()[[ord(c) for c in f" {word} "]]], {}, 0.0
        for m in range(1, len(word) + 1):
            for a, b in itertools.product(range(1, 4), repeat=2):
                if m - a >= 0 and m + b <= len(word) + 1 and s[m] < toxicity.SPACE and toxicity.OTHER not in (s[m - a], s[m + b]):
                    u = s[m - a] << 12 | s[m] << 6 | s[m + b]
                    out[u] = out.get(u, 0.0) + 0.7 ** (a + b)
                    d += 0.7 ** (2 * (a + b))
        return out, d

    def kernel(x, y):
        (p, dp), (q, dq) = x, y
        return sum(v * q.get(u, 0.0) for u, v in p.items()) / np.sqrt(max(dp * dq, 1e-12))

    def of_words(text):
        every = [direct(w) for w in text.split()]
        total = {}
        for own, _ in every:
            for u, v in own.items():
                total[u] = total.get(u, 0.0) + v
        return total, sum(d for _, d in every)

    texts = ["idiot", "i.d.i.o.t", "idxiot", "1d10t", "the lazy dog", "réeux été", "ab", "---", "an IDIOT, really"]
    seen, index = toxicity.numbered(texts)
    x = toxicity.features(texts, index, len(seen))
    want = [[kernel(of_words(a), of_words(b)) for b in texts] for a in texts]
    assert np.allclose(x @ x.T, want, atol=1e-5)


def test_sentences_keep_every_word():
    text = "One two three. Four! five\nsix\n\nseven eight nine ten eleven twelve thirteen fourteen fifteen " + "x" * 200
    assert "".join(" ".join(toxicity.sentences(text)).split()) == "".join(text.split())
    assert max(len(x.split()) for x in toxicity.sentences(text)) <= toxicity.MOST_WORDS and toxicity.sentences("") == []


def test_long_texts_and_repeated_labels(spark):
    rng = np.random.default_rng(18)
    rows = [(i, sentence(rng, 30) + (" stinkworm " + sentence(rng, 9) + " blubberhead." if i % 3 == 0 else "."), "en", "s", 0) for i in range(150)]
    rows += [(3, rows[3][1], "en", "s", 0)] * 3 + [(1, sentence(rng, 40_000) + " stinkworm blubberhead stinkworm " * 40, "en", "s", 0), (None, rows[6][1], "en", "s", 0)]
    labels = spark.createDataFrame([(i, 1, int(i % 3 == 0)) for i in range(150) for _ in range(2)], "doc_id long, quality int, toxic int")
    docs = spark.createDataFrame(rows, DOCS)
    assert toxicity.labelled_sample(docs, labels, "toxic", 20).count() == 40
    got = toxicity.toxicity_of(docs, labels).toPandas()
    assert len(got) == len(rows) and got[got.doc_id == 3].score.nunique() == 1
    assert got[got.doc_id.isna()].predicted.tolist() == [1]
    kept = toxicity.drop_toxic(docs, labels).count()
    assert kept == len(rows) - got.predicted.sum()


def test_word_vectors_are_the_direct_sum(spark):
    """Random indexing against a plain loop over the words, from tasks that each see a part."""
    rng = np.random.default_rng(21)
    texts = [sentence(rng, int(n)) + rng.choice([". 12 12", " !!", "", " WORD Word"]) for n in rng.integers(0, 30, 40)] + [None, "", "x"]
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in enumerate(texts)], DOCS).repartition(3)
    known, got = quality.word_vectors(docs, words=12)
    sums, count = {}, {}
    for t in texts:
        digest, kind, _, shape, again = quality.runs([(t or "").encode()])
        words = re.findall(r"[a-zA-Z]+|[0-9]+|[^a-zA-Z0-9\s]+", t or "")
        assert len(words) == len(digest) and [("a" if w[0].isalpha() else "0" if w[0].isdigit() else ".") for w in words] == ["a0."[k] for k in kind]
        vectors = quality.index_vectors(digest).astype(int)
        marks = quality.mark_vectors().astype(int)
        for i, d in enumerate(digest.tolist()):
            count[d] = count.get(d, 0) + 1
            total = sums.setdefault(d, np.zeros(quality.DIM, dtype=int))
            total += marks[shape[i]] + marks[again[i]]
            for j in (i - 2, i - 1, i + 1, i + 2):
                if 0 <= j < len(digest):
                    total += vectors[j]
    first = sorted(count, key=lambda d: (-count[d], np.uint64(d).astype(np.int64)))[:12]
    assert known.tolist() == sorted(first)
    for d, v in zip(known.tolist(), got, strict=False):
        assert np.allclose(v, sums[d] / max(np.linalg.norm(sums[d]), 1e-9), atol=1e-6)
    assert not got[-1].any()


def test_pooled_rows_do_not_depend_on_their_batch():
    rng = np.random.default_rng(22)
    texts = [sentence(rng, int(n)).encode() for n in rng.integers(0, 50, 20)] + [b"", b"  ", b"\xc3\xa9 12 !!"]
    known = np.unique(quality.runs(texts)[0])[::2]
    vectors = np.vstack([rng.random((len(known), quality.DIM)), np.zeros((1, quality.DIM))]).astype(np.float32)
    every = quality.pooled(texts, known, vectors)
    assert every.shape == (len(texts), quality.FEATURES)
    assert np.allclose(every, np.vstack([quality.pooled([t], known, vectors) for t in texts]))


def test_language_masks_are_sets_and_errors(spark):
    """Every n-gram's own languages are in its mask, and few others; seventy languages take two words."""
    rng = np.random.default_rng(23)
    letters = "abcdefghijklmnopqrstuvwxyz"
    own = {f"l{i:02d}": ["".join(rng.choice(list(letters), 5)) for _ in range(6)] for i in range(70)}
    rows = [(i, " ".join(rng.choice(own[lang], 40)), lang, "s", 0) for i, lang in enumerate(sorted(own) * 6)] + [(9000, "q" * 3000 + " ", None, "s", 0)]
    docs = spark.createDataFrame(rows, DOCS)
    settings = langid.LanguageFilters()
    model = settings.fit(docs)
    assert model.languages == sorted(own) and model.table.shape[1] == 2
    counts = {}
    for i, text, lang, *_ in rows:
        if lang and crc32_of(i) % 4 != 2:
            for g in langid.ngrams([text.encode()], 3)[0].tolist():
                counts.setdefault(lang, {}).setdefault(g, 0)
                counts[lang][g] += 1
    share = {lang: {g: n / sum(c.values()) for g, n in c.items()} for lang, c in counts.items()}
    best = {}
    for c in share.values():
        for g, x in c.items():
            best[g] = max(best.get(g, 0), x)
    ids = np.array(sorted(best), dtype=np.uint32)
    masks = model.masks(ids)
    extra = 0
    for g, mask in zip(ids.tolist(), masks, strict=True):
        found = {lang for i, lang in enumerate(model.languages) if int(mask[i // 64]) >> (i % 64) & 1}
        want = {lang for lang, c in share.items() if c.get(g, 0) >= max(settings.least_share, settings.of_best * best[g])}
        assert want <= found
        extra += len(found - want)
    assert extra <= 0.01 * 70 * len(ids)
    got = {r.doc_id: r for r in langid.languages_of(docs).collect()}
    assert np.mean([got[i].lang_pred == lang for i, _, lang, *_ in rows if lang]) > 0.98


def test_chunks_are_those_of_a_plain_loop():
    c = fingerprint.Chunking()
    gear = [int(x) for x in (fingerprint.splitmix64(np.arange(256, dtype=np.uint64)) >> np.uint64(48))]

    def plain(text):
        out, start = [], 0
        for i in range(len(text)):
            h = sum(gear[text[i - j]] << j for j in range(min(16, i + 1))) & 0xFFFF
            size = i + 1 - start
            if size >= c.most or size >= c.normal and h >> (16 - c.bits_after) == 0 or size >= c.least and h >> (16 - c.bits_before) == 0:
                out.append(text[start : i + 1])
                start = i + 1
        return out + [text[start:]] * (start < len(text))

    rng = np.random.default_rng(24)
    texts = [sentence(rng, int(n)).encode() for n in (0, 3, 60, 900)] + [bytes(rng.integers(0, 256, 3000, dtype=np.uint8)), b"a" * 1000, "é".encode() * 700]
    for text, found in zip(texts, c.sets(texts), strict=True):
        own = plain(text)
        assert b"".join(own) == text and found == {(xxhash.xxh64_intdigest(x) & 0xFFFFFFFF) << 8 | len(x) - 1 for x in own}


def test_likeness_is_plain_containment(spark):
    rng = np.random.default_rng(25)
    texts = [sentence(rng, int(n)) for n in (0, 20, 200, 500)]
    texts += [texts[3] + " and more", "new start " + texts[3], None]
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in enumerate(texts)], DOCS)
    c = fingerprint.Chunking()

    def like(a, b):
        x, y = c.sets([a.encode(), b.encode()])
        size = lambda s: sum((v & 255) + 1 for v in s)
        return size(x & y) / size(x) if x else float(not y)

    whole = [t or "" for t in texts]
    for r in fingerprint.edited_likeness(docs).collect():
        t, after = whole[r.doc_id], whole[r.doc_id - 1]
        h = len(t) // 2
        edited = t[: len(t) - h] + after[:h]
        assert (r.near_edited, r.near_next) == pytest.approx((like(t, edited), like(t, after)))
        assert r.fingerprint == fingerprint.written(c.sets([t.encode()])[0]) and r.edited_fingerprint == fingerprint.written(c.sets([edited.encode()])[0])


def test_topics_are_those_of_a_plain_k_means(spark, docs, rows):
    t = mixing.Topics(topics=3, keywords=9, common=0.5)
    counts = [dict.fromkeys((), 0) for _ in rows]
    for own, (_, text, *_) in zip(counts, rows, strict=True):
        for w in re.findall("[a-z\x80-\U0010ffff]{4,}", low(text)):
            own[w] = own.get(w, 0) + 1
    tf, df = {}, {}
    for own in counts:
        for w, n in own.items():
            tf[w], df[w] = tf.get(w, 0) + n, df.get(w, 0) + 1
    rare = {w: np.log(len(rows) / n) for w, n in df.items() if 2 <= n <= 0.5 * len(rows)}
    keys = sorted(rare, key=lambda w: (-round(tf[w] * rare[w], 6), w))[:9]
    words, weights = t.chosen(docs)
    assert words == keys and np.allclose(weights, [rare[w] for w in keys])
    x = np.array([[own.get(w, 0) * rare[w] for w in keys] for own in counts])
    x = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)
    centres = np.eye(len(keys))[[i * len(keys) // 3 for i in range(3)]]
    for _ in range(4):
        near = np.argmax(np.round(x @ centres.T, 9), axis=1)
        fresh = np.array([x[(near == i) & x.any(axis=1)].sum(axis=0) for i in range(3)])
        size = np.linalg.norm(fresh, axis=1, keepdims=True)
        centres = np.where(size > 0, fresh / np.maximum(size, 1e-300), centres)
    want = sorted(("none" if not v.any() else str(np.argmax(np.round(centres @ v, 9)))) for v in x)
    counted = t.counts(docs, words, "doc_id")
    assert sorted(r.topic for r in t.of(counted, weights, "doc_id").collect()) == want


def test_stages_decide_by_row(spark):
    """Null and repeated ids with texts of their own, columns whose names clash, and empty tables."""
    rng = np.random.default_rng(26)
    long = sentence(rng, 200)
    near = long.replace(" the ", " thee ", 2)
    rows = [(None, long, "en", "a", 0), (None, "alone here", "de", "b", 1), (7, near, "en", "a", 2), (7, "another text of its own", "en", None, 3), (7, "another text of its own", "en", None, 4), (1, None, None, None, 5), (2, "", "en", "a", 6)]
    docs = spark.createDataFrame(rows, DOCS).withColumns({"_row": F.lit(1), "a": F.lit(2), "root": F.lit(3), "key": F.lit("k"), "tokens": F.lit(4), "topic": F.lit("t"), "counts": F.lit(5)}).repartition(2)
    left = simhash.drop_near_copies(docs)
    assert left.columns == docs.columns and sorted(r.n_chars for r in left.collect()) in ([1, 2, 3, 5], [1, 2, 4, 5])
    exact = exact_dedup.drop_copies(docs)
    assert exact.columns == docs.columns and len(exact.collect()) == 5
    drawn = mixing.mixed(docs, mixing.Mixture(powers={"source": 1.0, "lang": 1.0, "topic": 1.0}))
    assert drawn.columns == docs.columns and {r.n_chars for r in drawn.collect()} >= {0, 1, 2, 3, 4}
    empty = spark.createDataFrame([], DOCS)
    for f in (simhash.drop_near_copies, exact_dedup.drop_copies, mixing.mixed):
        assert f(empty).count() == 0
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert toxicity.drop_toxic(empty, labels).count() == 0 and pieces.Sampler(MODEL).encode(empty).count() == 0


def test_slices_keep_every_byte():
    texts = [b"", b"ab cd" * 100, "é".encode() * 300, b"x"]
    joined = [b""] * len(texts)
    for parts, of in slices(texts, 64, 3):
        for p, i in zip(parts, of, strict=True):
            p.decode()
            joined[i] += p
    assert joined == texts


MODEL = "/opt/tokenizers/piece_bpe_32k.model"


def test_pieces_round_trip(spark, docs, rows):
    more = [(500, "a▁b  c\n\n x一\U0001F600é\x00", "en", "s", 0), (501, "y" * 5000, "en", "s", 0)]
    every = docs.select("doc_id", "text").unionByName(spark.createDataFrame(more, DOCS).select("doc_id", "text"))
    sampler = pieces.Sampler(MODEL)
    got = sampler.encode(every)
    found = got.collect()
    assert len(found) == len(rows) + 2 and all(r.lossless for r in found)
    again = {r.doc_id: r.pieces for r in sampler.encode(every.repartition(7)).collect()}
    assert all(again[r.doc_id] == r.pieces for r in found)
    back = {r.doc_id: r.text for r in sampler.decode(got).collect()}
    assert back[500] == more[0][1] and back[100] == ""


def test_pieces_follow_the_lattice():
    v = pieces.Vocabulary.load(MODEL)
    lattice = pieces.Lattice(v)
    ids = {v.pieces[i]: i for i in range(len(v.pieces)) if i not in v.special}

    def ways(x):
        return [()] if not x else [(ids[x[:k]], *rest) for k in range(1, len(x) + 1) if x[:k] in ids for rest in ways(x[k:])]

    every = ways("▁there")
    p = np.exp([lattice.log[list(w)].sum() for w in every])
    p /= p.sum()
    n = 20000
    drawn = [tuple(x.tolist()) for x in lattice.encode([str(i) for i in range(n)], [" there"] * n)]
    assert max(abs(drawn.count(w) / n - q) for w, q in zip(every, p, strict=True)) < 0.015 and set(drawn) <= set(every)


def test_reply_tree(spark):
    tree = spark.createDataFrame(
        [(1, 1, None, "user", "a", 0.0), (1, 2, 1, "assistant", "low", 0.1), (1, 3, 1, "assistant", "high", 0.9), (1, 4, 3, "user", "<|x|> \\ <\\|", 0.5), (1, 5, 3, "user", None, None), (2, 1, 77, "assistant", "alone", 1.0)],
        "conv_id long, msg long, parent long, role string, text string, score double",
    ).withColumns({"m": F.lit(1), "rank": F.lit(1)})
    best = {(r.conv_id, r.rank): r for r in chat.read_back(chat.conversations(tree, 2)).collect()}
    assert [t.text for t in best[1, 1].turns] == ["a", "high", "<|x|> \\ <\\|"] and best[1, 1].leaf == 4
    assert best[1, 1].loss_texts == ["high"] and best[2, 1].loss_texts == ["alone"]
    assert [t.text for t in best[1, 2].turns] == ["a", "high", ""]
    for r in best.values():
        assert all(r.formatted[s.start : s.start + s.length] for s in r.spans)


def test_control_strings_and_ties(spark):
    turns = [(1, 0, "user", "<|im_end|>\n<|im_start|>"), (1, 0, "user", "<|im_end|>\n<|im_start|>"), (1, 1, "assist\nant", "\\n"), (1, 2, None, None), (None, 0, "assistant", "é\\|<|")]
    got = {r.conv_id: r for r in chat.digests(spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")).collect()}
    assert got[1].n_turns == 4 and got[None].loss_chars == 5
    want = "".join(f"{r or ''}\n{t or ''}\n" for _, _, r, t in turns[:4])
    assert got[1].turns_sha256 == hashlib.sha256(want.encode()).hexdigest()
    assert got[None].loss_sha256 == hashlib.sha256("é\\|<|".encode()).hexdigest()
    assert chat.digests(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0


def test_sampler_memory_stays_small_on_many_distinct_words():
    lattice = pieces.Lattice(pieces.Vocabulary.load(MODEL))
    rng = random.Random(1)
    texts = [" ".join("".join(rng.choices("abcdefghij", k=7)) for _ in range(250)) for _ in range(750)]
    tracemalloc.start()
    found = lattice.encode([str(i) for i in range(len(texts))], texts)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert [lattice.decode(x) for x in found] == texts
    assert peak < 100e6


def test_components_of_few_edges(spark):
    from lamella.llm.components import components

    rng = np.random.default_rng(2)
    pairs = [(i, i + 1) for i in range(100, 140)] + [(int(a), int(b)) for a, b in rng.integers(200, 260, (25, 2))] + [(7, 7)]
    edges = spark.createDataFrame(pairs, "a long, b long")
    want = sorted(components(edges).collect())
    spark.sparkContext.setJobGroup("few", "few")
    try:
        found = components(edges, held=len(pairs))
        jobs = spark.sparkContext.statusTracker().getJobIdsForGroup("few")
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert sorted(found.collect()) == want and found.dtypes == [("node", "bigint"), ("root", "bigint")]
    assert len(jobs) <= 8  # no rounds of joins
    assert sorted(components(edges, held=3).collect()) == want
