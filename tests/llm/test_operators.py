"""Every operator on small cases: brute force, ties, nulls, repeated rows, empty tables, clashing columns."""

import collections
import hashlib
import io
import math
import re
import zlib

import numpy as np
import pytest

from isobath.llm import bagminhash, classifier, decontaminate, html_extract, line_dedup, ngram_trie, quality_rules, sentencepiece_dropout, sharding, warc
from isobath.llm.textkit import U

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
rng = np.random.default_rng(12)
VOCABULARY = ["".join(rng.choice(list("abcdeéü"), 5)) for _ in range(400)]


def prose(n, seed):
    own = np.random.default_rng(seed)
    words = [str(w) for w in own.choice(VOCABULARY, n)]
    return "\n".join(" ".join(words[k : k + 12]) + "." for k in range(0, n, 12))


def odd_rows():
    """Nulls in any column, empty and white texts, repeated rows, one long text."""
    rows = [(k, prose(60, k), "en", f"s{k % 2}", 5) for k in range(12)]
    rows += [(20, None, "en", "s0", None), (21, "", None, "s1", 0), (22, " \n\t ", "de", None, 4), (None, prose(40, 99), None, None, None), (3, rows[3][1], "en", "s1", 5), (30, prose(9000, 5), "en", "s0", 1), (31, rows[4][1], "en", "s0", 5), (32, "the " * 300, "en", "s0", 5), (33, "é", "en", "s0", 1)]
    return rows


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(odd_rows(), SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


# ---- sharding -----------------------------------------------------------------------


def test_sharding_is_near_equal_and_gapless(docs, none):
    rows = sharding.shard_by_bytes(docs, 5, carry=("lang",)).collect()
    assert len(rows) == len(odd_rows())
    by = collections.defaultdict(list)
    for r in rows:
        by[r.shard].append(r)
        assert r.law == "bytes" and r.grown_shard is None
    for own in by.values():
        assert sorted(r.slot for r in own) == list(range(len(own)))
    expected = collections.Counter((i, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for i, t, *_ in odd_rows())
    assert collections.Counter((r.doc_id, r.size, r.text_crc32) for r in rows) == expected
    assert sharding.shard_by_bytes(none, 5).count() == 0
    with pytest.raises(ValueError):
        sharding.shard_by_bytes(docs.withColumn("size", docs.doc_id), 5, carry=("size",))


def test_sharding_splits_identical_rows(spark):
    same = spark.createDataFrame([(1, "x" * 84)] * 300 + [(k, "y" * 84) for k in range(300)], "doc_id long, text string").repartition(3)
    sizes = collections.Counter(r.shard for r in sharding.shard_by_bytes(same, 6).collect())
    assert sorted(sizes.values()) == [100] * 6


# ---- quality rules ------------------------------------------------------------------


def plain_counts(text):
    text = text or ""
    words = WORD.findall(text)
    windows = collections.Counter(tuple(words[k : k + 5]) for k in range(len(words) - 4))
    covered = {j for k in range(len(words) - 4) if windows[tuple(words[k : k + 5])] > 1 for j in range(k, k + 5)}
    lines, seen = 0, set()
    for line in text.split("\n"):
        if WORD.search(line):
            lines += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), lines, len(covered)


def test_base_counts_match_plain_python(docs, none):
    judged = quality_rules.judge(docs, keep_text=False).collect()
    got = collections.Counter((r.doc_id, *[r.quality[c] for c in quality_rules.COUNTS], r.quality.base_failed) for r in judged)
    expected = collections.Counter()
    for i, t, *_ in odd_rows():
        c = plain_counts(t)
        expected[(i, *c, c[0] < 10 or 100 * c[4] > 20 * c[0])] += 1
    assert got == expected
    assert quality_rules.judge(none).count() == 0


def test_outliers_go_and_plain_texts_stay(spark):
    rows = [(k, prose(80 + k % 50, k), "en", "s", 1) for k in range(150)] + [(1000 + k, prose(80, k).replace(" ", "*** "), "en", "s", 1) for k in range(8)] + [(2000 + k, prose(80, k).upper(), "en", "s", 1) for k in range(8)]
    frame = spark.createDataFrame(rows, SCHEMA).withColumnRenamed("n_chars", "quality")
    judged = {r.doc_id: r.quality.kept for r in quality_rules.judge(frame).collect()}
    assert all(judged[k] for k in range(150)) and not any(judged[k] for k in judged if k >= 1000)


def plain_estimate(v, others):
    """The least determinant over all starts and ever more random ones, by sorting; without prior rows."""
    own = np.random.default_rng(4)
    floor, h = np.diag(np.square(quality_rules.FLOORS)), int(np.ceil(quality_rules.KEEP * len(v)))
    best = (np.inf, None)
    for _ in range(60):
        keep = own.choice(len(v), 8, replace=False)
        for _ in range(60):
            mean, cov = v[keep].mean(0), np.cov(v[keep].T, bias=True) * quality_rules.consistency(quality_rules.KEEP) + floor
            d = np.einsum("ni,ij,nj->n", v - mean, np.linalg.inv(cov), v - mean)
            keep = np.argsort(d, kind="stable")[:h]
        best = min(best, (np.linalg.slogdet(np.cov(v[keep].T, bias=True) * quality_rules.consistency(quality_rules.KEEP) + floor)[1], tuple(keep)))
    return best[0]


def test_estimates_reach_the_least_determinant(spark, monkeypatch):
    """Against brute force from many random starts, with few groups and by tables; groups of one row and of none sound have a result."""
    own = np.random.default_rng(9)
    mix_ = own.normal(size=(6, 6)) * 0.3
    v = own.normal(size=(400, 6)) @ mix_
    v[:90] = v[:90] * 0.2 + 6
    rows = [("a", "x", r.tolist()) for r in v] + [("b", "x", [0.5] * 6), ("c", "y", [0.1] * 6)]
    frame = spark.createDataFrame(rows, "g string, l string, v array<double>").repartition(3)
    monkeypatch.setattr(quality_rules, "PRIOR", 1e-9)
    groups = quality_rules.Groups(frame)
    few = quality_rules.FewGroups(groups)
    mu, inv = few.starts()
    for _ in range(12):
        mu, inv, det = few.concentrated(mu, inv)
    assert det[0].min() <= plain_estimate(v, None) + 0.05
    monkeypatch.setattr(quality_rules, "PRIOR", 50.0)
    got = {r.g: (np.array(r.mu), np.array(r.inv)) for r in quality_rules.fit(frame)[0].collect()}
    assert np.abs(got["a"][0]).max() < 0.5 and set(got) == {"a", "b", "c"}
    out = np.einsum("ni,ij,nj->n", v - got["a"][0], got["a"][1].reshape(6, 6), v - got["a"][0]) > quality_rules.chi2_quantile(1 - quality_rules.TAIL, 6)
    assert out[:90].all() and not out[90:].any()
    monkeypatch.setattr(quality_rules, "BROADCAST_GROUPS", 0)
    many = {r.g: (np.array(r.mu), np.array(r.inv)) for r in quality_rules.fit(frame)[0].collect()}
    for g in got:
        assert np.allclose(got[g][0], many[g][0], atol=0.02) and np.allclose(got[g][1], many[g][1], rtol=0.1, atol=0.5)


def test_chi_square_functions():
    assert abs(quality_rules.chi2_quantile(0.95, 2) - 5.991) < 1e-3 and abs(quality_rules.chi2_cdf(7.815, 3) - 0.95) < 1e-4


# ---- sentencepiece ------------------------------------------------------------------


@pytest.mark.parametrize("dropout", [0.0, 0.3])
def test_encoding_round_trip(dropout):
    from sentencepiece import SentencePieceProcessor

    m = sentencepiece_dropout.model()
    plain = SentencePieceProcessor(model_file=sentencepiece_dropout.MODEL)
    texts = [prose(200, 1), "", " ", "  a  b ", "\n", "a\n\nb ", "日本語 🙂🙂", "<s> <0x0A> </s>", "x" * 3000, "\t\tt", "▁x▁"]
    raw = [t.encode() for t in texts]
    data, at = np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0] + [len(r) for r in raw])
    tokens, offsets = sentencepiece_dropout.encode(data, at, np.arange(len(texts)).astype(U), m, dropout)
    back, ends = sentencepiece_dropout.decode(tokens, offsets, m)
    assert [back[a:b].tobytes() for a, b in zip(ends[:-1], ends[1:], strict=True)] == raw
    own = [tokens[a:b].tolist() for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
    if not dropout:
        assert own[:-1] == [plain.encode(t) for t in texts[:-1]]
    else:
        assert len(own[0]) > len(plain.encode(texts[0]))


def test_encoding_of_rows(docs, none):
    encoded = sentencepiece_dropout.encode_texts(docs)
    rows = encoded.collect()
    assert len(rows) == len(odd_rows()) and all(r.decodes for r in rows)
    assert [r.n_tokens for r in rows if r.doc_id in (20, 21)] == [0, 0]
    decoded = collections.Counter((r.doc_id, r.text) for r in sentencepiece_dropout.decode_tokens(encoded).collect())
    assert decoded == collections.Counter((i, t or "") for i, t, *_ in odd_rows())
    assert sentencepiece_dropout.encode_texts(none).count() == 0


def test_long_units_are_cut_like_short_ones(monkeypatch):
    """The heap and the side-by-side agenda give the same pieces and merges, and time grows with the length."""
    own = np.random.default_rng(3)
    texts = ["".join(own.choice(list("abcdeistnr日ü"), int(n))) for n in own.integers(60, 260, 40)] + ["x" * 400, "inter" * 60]
    for dropout in (0.0, 0.1, 0.5, 1.0):
        monkeypatch.setattr(sentencepiece_dropout, "LONG_UNIT", 10)
        heap = _cuts(texts, range(len(texts)), dropout=dropout)
        monkeypatch.setattr(sentencepiece_dropout, "LONG_UNIT", 100)
        mixed = _cuts(texts, range(len(texts)), dropout=dropout)
        monkeypatch.setattr(sentencepiece_dropout, "LONG_UNIT", 1000)
        assert _cuts(texts, range(len(texts)), dropout=dropout) == heap == mixed
    monkeypatch.setattr(sentencepiece_dropout, "LONG_UNIT", 100)
    import time

    taken = []
    for n in (20_000, 160_000):
        text = "".join(own.choice(list("abcdeistnr"), n))
        begin = time.perf_counter()
        assert len(_cuts([text], [1])[0]) > n / 8
        taken.append(time.perf_counter() - begin)
    assert taken[1] < 25 * max(taken[0], 0.1)


def test_same_word_is_cut_in_several_ways():
    m = sentencepiece_dropout.model()
    data = np.frombuffer(b" international" * 200, np.uint8)
    tokens, _ = sentencepiece_dropout.encode(data, np.array([0, len(data)]), np.array([7], U), m, 0.3, variants=6)
    text = [tuple(w) for w in np.split(tokens, np.flatnonzero(np.isin(tokens, [i for i in set(tokens.tolist()) if m.bytes[m.offsets[i]] == 32])))]
    assert len(set(text)) > 3


def _cuts(texts, keys, **how):
    """The cut of every text's units, joined by text."""
    m = sentencepiece_dropout.model()
    raw = [t.encode() for t in texts]
    data, at = np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0] + [len(r) for r in raw])
    tokens, offsets = sentencepiece_dropout.encode(data, at, np.array(keys).astype(U), m, **how)
    return [tuple(tokens[a:b].tolist()) for a, b in zip(offsets[:-1], offsets[1:], strict=True)]


def test_dropout_is_drawn_for_every_occurrence(monkeypatch):
    """With the operator's own parameters: shares of standard cuts, more than a few cuts of a unit, and the same cuts as without shared work."""
    for word in ("the", "international", "international" * 5):
        standard = _cuts([word], [0], dropout=0.0)[0]
        cuts = collections.Counter(_cuts([word] * 3000, range(3000)))
        made: list = []
        raw = np.frombuffer((" " + word).encode(), np.uint8)
        sentencepiece_dropout._cut(sentencepiece_dropout.model(), raw, np.array([0]), np.array([len(raw)]), np.zeros(1, U), 0.0, made)
        share = 0.9 ** sum(len(x[0]) for x in made)
        # other orders of merges can end in the same cut
        assert cuts[standard] / 3000 > share - 0.04 and cuts[standard] < 3000
        assert len(cuts) > (4 if len(word) > 3 else 1)
    texts = [prose(300, 1), "日本語 🙂🙂\n\n a", "the the the", prose(300, 1), prose(300, 1)]
    shared = _cuts(texts, [1, 2, 3, 1, 4])
    assert shared[0] == shared[3] != shared[4]
    monkeypatch.setattr(sentencepiece_dropout, "_skips", lambda agenda, *_: np.ones(len(agenda), bool))
    assert _cuts(texts, [1, 2, 3, 1, 4]) == shared


# ---- classifier ---------------------------------------------------------------------


def test_classifier(spark, docs, none):
    rows = [(k, prose(60, k), "en", "s", 1) for k in range(120)] + [(200 + k, prose(60, k).replace(" ", "$$$ "), "en", "s", 1) for k in range(60)]
    labels = spark.createDataFrame([(k, 1, 0) for k in range(120)] + [(200 + k, 0, 0) for k in range(60)] + [(None, 1, 0), (5, None, 0)], "doc_id long, quality int, toxic int")
    scored = {r.doc_id: r for r in classifier.classify(spark.createDataFrame(rows, SCHEMA), labels).collect()}
    for i, r in scored.items():
        assert r.held_out == (zlib.crc32(str(i).encode()) % 4 == 2) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7)
    assert np.mean([r.predicted == int(i < 200) for i, r in scored.items() if r.held_out]) > 0.95
    odd = classifier.classify(docs, labels).collect()
    assert len(odd) == len(odd_rows()) and all(0 <= r.score <= 1 for r in odd)
    assert classifier.classify(none, labels).count() == 0
    assert {r.score for r in classifier.classify(docs, labels.limit(0)).collect()} == {0.5}


def test_classifier_learns_from_every_pair(spark):
    """The gradient of the mean loss over all pairs, summed pair by pair, is nought at the learnt weights; quantiles are those of all scores."""
    rows = [(k, prose(20 + k % 40, k) + (" $$$" * (k % 5) if k % 3 else ""), k % 2) for k in range(260)]
    docs, labels = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string"), spark.createDataFrame([(r[0], r[2], 0) for r in rows], "doc_id long, quality int, toxic int")
    table = classifier.training_table(docs, labels)
    assert table.count() == sum(zlib.crc32(str(r[0]).encode()) % 4 != 2 for r in rows)
    model = classifier.learn(table)
    y, x = (np.array(c) for c in zip(*[(r.y, np.frombuffer(r.x, np.float32).astype(float)) for r in table.collect()], strict=True))
    w, d = model["w"], (x[y == 1][:, None] - x[y == 0][None]).reshape(-1, x.shape[1])
    ridge = np.where(np.arange(len(w)) < len(w) - classifier.WORD_BINS - classifier.RUN_BINS, classifier.RIDGE, classifier.BIN_RIDGE)
    assert np.abs(d.T @ (1 / (1 + np.exp(d @ w))) / len(d) - ridge * w).max() < 1e-5
    s = np.sort(x @ w)
    assert model["cut"] == pytest.approx((s[(y == 0).sum() - 1] + s[(y == 0).sum()]) / 2)
    values = [0.5] * 7 + [float(v) for v in np.random.default_rng(2).normal(size=300)] + [1e9]
    assert classifier.at_ranks(spark.createDataFrame([(v,) for v in values], "s double"), list(range(0, 308, 9)), 3) == sorted(values)[::9]


# ---- near-duplicates ----------------------------------------------------------------


def weighted(text):
    words = WORD.findall(text or "")
    return collections.Counter(tuple(words[k : k + 5]) for k in range(len(words) - 4)) if len(words) >= 5 else collections.Counter([tuple(words)] if words else [])


def plain_classes(rows):
    texts = {}
    for i, t, *_ in rows:
        if i is not None:
            texts.setdefault(i, weighted(t))
    up = {i: i for i in texts}

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    ids = sorted(texts)
    for a in ids:
        for b in ids:
            if a < b:
                both, either = sum((texts[a] & texts[b]).values()), sum((texts[a] | texts[b]).values())
                if either and both >= 0.8 * either:
                    x, y = top(a), top(b)
                    up[max(x, y)] = min(x, y)
    return {i: top(i) for i in ids}


def edited(text, count, seed):
    own, words = np.random.default_rng(seed), text.split(" ")
    for k in own.integers(0, len(words), count):
        words[k] = "edit" + str(own.integers(100))
    return " ".join(words)


def test_near_duplicates_match_brute_force(spark, docs, none):
    rows = [r for r in odd_rows() if r[0] != 30]
    rows += [(100 + k, edited(prose(300, 77), k % 9, k), "en", "s", 1) for k in range(40)] + [(300 + k, prose(150, 500 + k // 2), "en", "s", 1) for k in range(30)]
    got = bagminhash.classify_rows(spark.createDataFrame(rows, SCHEMA)).collect()
    expected = plain_classes(rows)
    assert len(got) == len(rows)
    assert {r.doc_id: r.class_id for r in got if r.doc_id is not None} == expected
    kept = bagminhash.keep_one(spark.createDataFrame(rows, SCHEMA)).collect()
    assert {r.doc_id for r in kept} == {i for i, c in expected.items() if i == c} | {None}
    assert bagminhash.classify_rows(none).count() == 0


def test_hot_bucket_of_unlike_copies(spark):
    """A source, many copies linked to it, many too far from it and from each other, and pairs of those; blocks of few texts."""
    own = np.random.default_rng(8)
    source = prose(200, 4242).replace("\n", " ")
    rows = [(0, source)]
    rows += [(100 + k, edited(source, int(own.integers(1, 4)), k)) for k in range(60)]
    far = [edited(source, int(own.integers(6, 16)), 900 + k) for k in range(60)]
    rows += [(300 + k, t) for k, t in enumerate(far)] + [(500 + k, edited(t, 1, 77 + k)) for k, t in enumerate(far[:30])]
    rows = [(i, t, "en", "s", 1) for i, t in rows]
    expected = plain_classes(rows)
    assert len(set(expected.values())) > 20
    frame = spark.createDataFrame(rows, SCHEMA).repartition(5)
    assert {r.id: r.class_id for r in bagminhash.classes(frame, block=500).collect()} == expected
    text_ids = frame.selectExpr("cast(doc_id as string) doc_id", "text", "doc_id h1", "doc_id bucket", "doc_id class")
    named = {r.doc_id: r.class_id for r in bagminhash.classify_rows(text_ids).collect()}
    by = collections.defaultdict(set)
    for i, c in expected.items():
        by[c].add(str(i))
    assert named == {i: min(group) for group in by.values() for i in group}


def test_block_links_match_all_pairs():
    own = np.random.default_rng(5)
    for _ in range(30):
        sets = [sorted(own.integers(0, 12, own.integers(1, 12)).tolist()) for _ in range(14)]
        owner = np.repeat(np.arange(14), [len(x) for x in sets])
        hashes = np.array([v for x in sets for v in x], U)
        kinds = own.integers(0, 9, 14)
        up = {int(k): int(k) for k in kinds}

        def top(k, up=up):
            return k if up[k] == k else top(up[k], up)

        for a in range(14):
            for b in range(a):
                x, y = collections.Counter(sets[a]), collections.Counter(sets[b])
                if sum((x & y).values()) >= 0.5 * sum((x | y).values()):
                    i, j = top(int(kinds[a])), top(int(kinds[b]))
                    up[max(i, j)] = min(i, j)
        mine = {int(k): int(k) for k in kinds}
        found = bagminhash.block_links(owner, hashes, kinds, np.ones(14, bool), None, 0.5)
        for q, y in found:
            i, j = top(int(kinds[q]), mine), top(int(kinds[y]), mine)
            assert i != j
            mine[max(i, j)] = min(i, j)
        assert {k: top(k) for k in up} == {k: top(k, mine) for k in mine}


def test_signatures_are_unbiased():
    errors = []
    for seed in range(40):
        own = np.random.default_rng(seed)
        base = np.unique(own.integers(0, 1 << 44, 120).astype(U))
        a, b = own.integers(1, 7, len(base)), own.integers(1, 7, len(base))
        s = bagminhash.signatures(np.repeat([0, 1], len(base)), np.concatenate([base, base]), np.concatenate([a, b]), 2, 256)
        errors.append((s[0] == s[1]).mean() - np.minimum(a, b).sum() / np.maximum(a, b).sum())
    assert abs(np.mean(errors)) < 0.015 and np.std(errors) < 0.045


# ---- pages --------------------------------------------------------------------------


def extract(html):
    weights, trans = html_extract.train()
    return html_extract.main_text(html, weights, trans.tolist())


def test_main_text_of_pages(spark):
    page = '<html><head><title>No</title><script>var t="<p>no</p>"</script></head><body><nav><ul><li><a href="/">Menu</a></li></ul></nav><article><h1>A &amp; B</h1><p>First  line<br>goes\n on.<p>Second <b>one</b> here.</article><footer>&copy; nobody</footer>'
    assert extract(page) == "A & B\nFirst line goes on.\nSecond one here."
    assert extract(None) == extract("") == extract("<p") == ""
    frame = spark.createDataFrame([(1, "u", page), (2, None, None), (1, "u", page)], "page_id long, url string, html string")
    assert sorted((r.page_id, r.n_chars) for r in html_extract.extract(frame).collect()) == [(1, 42), (1, 42), (2, 0)]
    assert html_extract.extract(frame.limit(0)).count() == 0


def test_deep_pages_cost_time_in_proportion():
    import time
    import tracemalloc

    inner = "<article><p>Some text of an article that goes on.</p>"
    for opened in ("<div>", "<b><div class='nav x'>", "<x{}>", "<li><ul>"):
        page = "<p>" + "".join(opened.replace("{}", str(k)) + "<i>text</i> </s><hr><div/>" for k in range(4_000)) + inner
        tracemalloc.start()
        begin = time.perf_counter()
        assert "Some text of an article that goes on." in extract(page) or len(html_extract.blocks_of(page, frozenset())) > 1
        spent, most = time.perf_counter() - begin, tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert spent < 10 and most < 40e6, (opened, spent, most)


def test_closed_elements_take_their_features_along():
    page = "<nav class=menu><ul><li><a href=x>one<b>two</nav><main><p>three<li>four</main>five</x></nav>"
    blocks = html_extract.blocks_of(page)
    assert [(b[1], b[2]) for b in blocks] == [("onetwo", 6), ("three", 0), ("four", 0), ("five", 0)]
    assert blocks[0][0] == {"t:nav", "c:nav", "c:menu", "t:ul", "t:li", "own:li", "near:nav"} - {"c:nav"}
    assert blocks[1][0] == {"t:main", "t:p", "own:p", "near:main"} and blocks[3][0] == {"own:", "near:none"}


def test_held_out_pages_are_labelled_well():
    own, hit, total = np.random.default_rng(321), 0, 0
    for _ in range(120):
        page, main = html_extract.labelled_page(own)
        got, want = collections.Counter(extract(page).split("\n")), collections.Counter(" ".join(m.split()) for m in main)
        hit += sum((got & want).values())
        total += max(sum(got.values()), sum(want.values()))
    assert hit / total > 0.93


def test_viterbi_matches_enumeration():
    own = np.random.default_rng(0)
    for _ in range(20):
        s, t = own.normal(size=5).tolist(), own.normal(size=(2, 2)).tolist()
        value = lambda y: sum(a * b for a, b in zip(s, y, strict=True)) + sum(t[a][b] for a, b in zip(y[:-1], y[1:], strict=True))  # noqa: B023, E731
        best = max(([k >> i & 1 for i in range(5)] for k in range(32)), key=value)
        assert html_extract.viterbi(s, t) == best


def test_archives_round_trip(spark):
    long = "<p>" + "é" * 80
    rows = [(5, "http://www.B.example.com/x?b=2&a=1#f", long), (2, "https://a.example.com", long), (7, "http://b.example.com/x?a=1&b=2", long), (8, None, None), (None, "http://c.org/\r\nX: y", "short"), (9, "u", "short"), (2, "https://a.example.com", long)]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    read = warc.archive_pages(frame).collect()
    assert len(read) == len(rows) and all(r.intact for r in read) and sorted(r.history_rank for r in read) == list(range(len(rows)))
    digest = hashlib.sha256(long.encode()).hexdigest()
    by = collections.defaultdict(list)
    for r in read:
        by[r.page].append(r)
    assert [(r.record_type, r.refers_to, r.payload_digest, r.payload_bytes) for r in by[5] + by[7]] == [("revisit", 2, digest, 163)] * 2
    assert [(r.record_type, r.refers_to) for r in by[2] + by[9] + by[None] + by[8]] == [("response", None)] * 5
    order = [(r.url_key, r.time) for r in sorted(read, key=lambda r: r.history_rank)]
    assert order == sorted(order) and by[5][0].url_key == by[7][0].url_key == "com,example,b)/x?a=1&b=2"
    assert warc.archive_pages(frame.limit(0)).count() == 0


def test_loser_tree():
    own = np.random.default_rng(2)
    for k in (0, 1, 2, 5, 8):
        runs = [sorted(map(tuple, own.integers(0, 9, (own.integers(0, 12), 2)).tolist())) for _ in range(k)]
        assert warc.merge_runs(runs) == sorted(x for r in runs for x in r)


def test_damaged_archives_are_refused():
    import gzip

    raw = gzip.compress(warc.record_bytes(1, "u", b"payload", "0" * 64, None))
    assert [warc.parse_record(c)["block"] for *_, c in warc.members(io.BytesIO(raw * 3))] == [b"payload"] * 3
    assert [a for a, *_ in warc.members(io.BytesIO(raw * 3))] == [0, len(raw), 2 * len(raw)]
    with pytest.raises((ValueError, zlib.error)):
        list(warc.members(io.BytesIO(raw[:-9])))


@pytest.mark.parametrize("url", ["http://[abc/x", "http://[::1]:80/x", "//", "", "?", "http://a b/\x00", "x" * 5000, "http://user@[", "::::", "http://h#?q"])
def test_any_address_has_a_key(url):
    assert ")" in warc.url_key(url) and "#" not in warc.url_key(url)


def test_malformed_addresses_are_archived(spark, tmp_path):
    rows = [(k, url, f"<p>{k}") for k, url in enumerate(["http://[abc/x", "", None, "http://ok.org/a", "http://[abc/x"])]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.page: r.url_key for r in warc.archive_pages(frame, folder=str(tmp_path / "w")).collect()}
    assert got == {k: warc.url_key(url or "") for k, url, _ in rows}
    # what a lost attempt leaves behind is not read
    (tmp_path / "w" / "stale.warc.gz").write_bytes(b"no archive")
    records = warc.plan_records(frame)
    manifest = warc.write_archives(records, str(tmp_path / "w"), most=1)
    read = warc.read_archives(manifest, str(tmp_path / "w"), payload=True).collect()
    assert sorted((r.page, bytes(r.payload)) for r in read) == [(k, html.encode()) for k, _, html in rows] and manifest.count() == 5
    assert [r.history_rank for r in warc.merge_index(warc.read_archives(manifest, str(tmp_path / "w")), per_range=1).orderBy("url_key", "time").collect()] == list(range(5))


# ---- line chunks --------------------------------------------------------------------


def test_line_chunks_match_brute_force(spark, docs, none, monkeypatch):
    passage = "\n".join(prose(24, k) for k in range(900, 908))
    rows = [(k, prose(60, k) + "\n" + passage + "\n" + prose(36, 50 + k), "en", "s", 1) for k in range(6)] + [r for r in odd_rows() if r[0] is None or r[0] > 5]
    held = collections.defaultdict(set)
    cut = {}
    for i, t, *_ in rows:
        raw = np.frombuffer((t or "").encode(), np.uint8)
        c = line_dedup.chunks(raw, np.array([0, len(raw)]))
        own = [raw[a:b].tobytes().rstrip(b"\n") for a, b, good in zip(c["lo"], c["hi"], line_dedup._candidates(c), strict=True) if good]
        cut[i] = own
        if i is not None:
            for piece in own:
                held[piece].add(i)
    got = line_dedup.remove_repeated_chunks(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(got) == len(rows)
    for r in got:
        seen, gone = set(), 0
        for piece in cut[r.doc_id] if r.doc_id is not None else ():
            gone += min(held[piece]) != r.doc_id or piece in seen
            seen.add(piece)
        assert r.removed_chunks == gone, r.doc_id
    monkeypatch.setattr("isobath.llm.shared.BROADCAST_BYTES", 0)
    assert collections.Counter(line_dedup.remove_repeated_chunks(spark.createDataFrame(rows, SCHEMA)).collect()) == collections.Counter(got)
    monkeypatch.undo()
    by = {r.doc_id: r for r in got}
    assert by[0].text == rows[0][1] and all(len(by[k].text) < len(rows[k][1]) - 400 for k in range(1, 6))
    assert line_dedup.without_repeats(none).count() == 0
    names = {"n_chars": "_id", "lang": "_spans", "source": "removed_chunks"}
    clash = spark.createDataFrame(rows, SCHEMA).withColumnsRenamed(names).selectExpr("*", "1 _differs", "2 `_row`", "3 `a.b`", "4 Removed_Bytes", "5 _inner", "6 _outer")
    left = line_dedup.without_repeats(clash)
    assert left.columns == clash.columns
    plain = line_dedup.without_repeats(spark.createDataFrame(rows, SCHEMA)).withColumnsRenamed(names)
    assert collections.Counter(left.select(plain.columns).collect()) == collections.Counter(plain.collect())


def test_repeated_passages_go_whole(spark):
    """Every line run of 50 words or more that an earlier text has, or the same text before, goes wherever chunks end; one copy of each line stays."""
    own = np.random.default_rng(77)
    line = lambda n: " ".join(str(w) for w in own.choice(VOCABULARY, n)) + f" {own.integers(10**12)}"
    passages = [[line(-(-55 // n)) for _ in range(n)] for n in (2, 2, 2, 3, 3, 4, 5, 8, 13)] + [["", line(30), "", "", line(30)]]
    texts = []
    for _ in range(40):
        parts = [[line(int(own.integers(1, 20))) for _ in range(own.integers(1, 4))] for _ in range(4)]
        for k, j in enumerate(own.integers(0, len(passages), 3)):
            parts.insert(2 * k + 1, passages[j])
        texts.append([x for p in parts for x in p])
    texts += [[x for x in texts[3]], texts[4][2:], [line(11)] * 30, passages[0], [line(20), *passages[3][1:], *passages[3][:2]]]
    size = lambda rows: sum(len(WORD.findall(x)) for x in rows)
    repeated = []
    for i, b in enumerate(texts):
        flags = [False] * len(b)
        for a in texts[:i]:
            for y in range(len(b)):
                for x in range(len(a)):
                    n = 0
                    if x and y and a[x - 1] == b[y - 1]:
                        continue
                    while x + n < len(a) and y + n < len(b) and a[x + n] == b[y + n]:
                        n += 1
                    if size(b[y : y + n]) >= line_dedup.LONG_WORDS:
                        flags[y : y + n] = [True] * n
        repeated.append(flags)
    frame = spark.createDataFrame([(i, "\n".join(t), "en", "s", 1) for i, t in enumerate(texts)], SCHEMA).repartition(3)
    got = {r.doc_id: r for r in line_dedup.remove_repeated_chunks(frame).collect()}
    left = [set(got[i].text.split("\n")) for i in range(len(texts))]
    for i, (t, flags) in enumerate(zip(texts, repeated, strict=True)):
        assert not [x for x, f in zip(t, flags, strict=True) if f and x and x in left[i] and t.count(x) == 1], i
        assert got[i].removed_bytes == len("\n".join(t).encode()) - len(got[i].text.encode())
    assert {x for t in texts for x in t if x} == {x for s in left for x in s if x}
    assert [got[i].text for i in (40, 43)] == ["", ""] and 5 <= got[42].text.count("\n") + 1 <= 6
    # lines of no repeated passage stay
    many = collections.Counter(x for t in texts for x in set(t))
    assert all(many[x] > 1 or x in left[i] for i, t in enumerate(texts) for x in t)


def test_chunk_boundaries_resist_shifts():
    text = "\n".join(f"line {k} {k * 7}" for k in range(200))
    pieces = lambda t: {t.encode()[a:b].rstrip(b"\n") for a, b in zip(*(line_dedup.chunks(np.frombuffer(t.encode(), np.uint8), np.array([0, len(t.encode())]))[c] for c in ("lo", "hi")), strict=True)}
    one, two = pieces(text), pieces("a new line\n" + text)
    assert len(one & two) >= 0.9 * len(one)


# ---- decontamination ----------------------------------------------------------------


def test_decontamination(spark, none):
    items = [(k, prose(40, 4000 + k).replace("\n", " ")) for k in range(4)] + [(10, "only three words"), (11, None), (12, "")]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    swapped = items[0][1].split()
    for k in (9, 19, 29):
        swapped[k] = "zzz"
    rows = [(1, prose(50, 1) + " " + items[0][1].upper() + "\n" + prose(30, 2)), (2, prose(30, 3) + " " + " ".join(swapped)), (3, prose(80, 4)), (4, "x Only, THREE words! y"), (5, None), (6, ""), (7, " ".join(items[1][1].split()[:8])), (None, items[2][1]), (1, prose(50, 1) + " " + items[0][1])]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    got = collections.Counter((r.doc_id, r.item_id) for r in decontaminate.contaminated(frame, benchmark).collect())
    assert got == {(1, 0): 2, (2, 0): 1, (4, 10): 1, (None, 2): 1}
    # equal items are one, by any type of id, and whatever the columns are called
    named = benchmark.union(benchmark).selectExpr("cast(item_id + 0.5 as decimal(9,1)) key", "text passage", "1 doc", "2 hits")
    texts = frame.selectExpr("to_date('2024-01-01') + cast(doc_id as int) hash", "text item", "3 _key", "4 text")
    assert collections.Counter(str(r.key) for r in decontaminate.contaminated(texts, named, "hash", "item", "key", "passage").collect()) == {"0.5": 3, "10.5": 1, "2.5": 1}
    left = decontaminate.drop_contaminated(texts, named, "hash", "item", "key", "passage")
    assert left.columns == texts.columns and left.count() == 4
    assert {r.doc_id for r in decontaminate.drop_contaminated(frame, benchmark).collect()} == {3, 5, 6, 7}
    assert decontaminate.contaminated(none, benchmark).count() == 0 and decontaminate.contaminated(frame, benchmark.limit(0)).count() == 0


def test_letters_of_any_script_are_lowered_alike(spark):
    words = ["ΟΔΟΣ0", "ΛΟΓΟΣ1", "İSTANBUL", "ΑΣ", "ÉTÉ", "STRASSE", "ẞ", "Ⅷ", "DŽ", "ІНША"] * 2
    benchmark = spark.createDataFrame([(1, " ".join(words))], "item_id long, text string")
    rows = spark.createDataFrame([(1, " ".join(words)), (2, "x " + " ".join(words) + " y"), (3, "other text")], "doc_id long, text string")
    assert sorted(r.doc_id for r in decontaminate.contaminated(rows, benchmark).collect()) == [1, 2]


def test_repetitive_items_are_checked_in_lots(monkeypatch):
    monkeypatch.setattr(decontaminate, "LOT", 50)
    h = _hashes([["a"] * 60])[0]
    seeds, place, _ = decontaminate.seeds_of(h)
    hits = [(int(x), p) for x, p in zip(seeds.view(np.int64), place, strict=True)][:30]
    shifts = decontaminate.diagonals(hits, (seeds.view(np.int64), place))
    expected = {p - int(q) for x, p in hits for y, q in zip(seeds.view(np.int64), place, strict=True) if x == y}
    assert set(shifts.tolist()) == expected
    assert decontaminate.best_overlap(h, h, shifts) == (60, 0, 60)


def findings(hashes, firsts, sought):
    """(text, item) -> equal tokens, by seeds and diagonals."""
    bits, out = 18, {}
    sieve = np.zeros(1 << bits - 3, np.uint8)
    for item in sought:
        head = (decontaminate.seeds_of(item)[0] >> U(64 - bits)).astype(np.int64)
        np.bitwise_or.at(sieve, head >> 3, (1 << (head & 7)).astype(np.uint8))
    text, place, h = decontaminate.places(hashes, firsts, decontaminate.ALL_MASKS, sieve, bits)
    for t in range(len(firsts) - 1):
        hits = list(zip(h[text == t].view(np.int64).tolist(), place[text == t].tolist(), strict=True))
        for k, item in enumerate(sought):
            seeds, at, _ = decontaminate.seeds_of(item)
            if matched := decontaminate.best_overlap(hashes[firsts[t] : firsts[t + 1]], item, decontaminate.diagonals(hits, (seeds.view(np.int64), at)))[0]:
                out[t, k] = matched
    return out


def _hashes(rows):
    texts = [" ".join(r).encode() for r in rows]
    return decontaminate.tokens(np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0] + [len(x) for x in texts]))


@pytest.mark.parametrize("length", range(1, 21))
def test_whatever_is_enough_has_a_seed(length):
    """All places of misses in items of up to 15 tokens, random ones in longer items; then all diagonals of edited copies."""
    own = np.random.default_rng(length)
    patterns = (np.arange(1 << length)[:, None] >> np.arange(length) & 1).astype(bool) if length < 16 else own.random((20_000, length)) > own.choice([0.1, 0.2, 0.3], (20_000, 1))
    need = min(decontaminate.MIN_MATCHED, length - length // 5)
    placements = [np.arange(k, k + len(m))[np.array(list(m)) == "1"] for m in decontaminate.masks_of(length) for k in range(length - len(m) + 1)]
    seeded = np.any([patterns[:, p].all(1) for p in placements], axis=0)
    for e in patterns[(patterns.sum(1) >= need) & ~seeded]:
        assert not decontaminate.enough(decontaminate.best_run(e)[2], length), e.astype(int)
    items = [[f"w{v}" for v in own.integers(0, 30, length)] for _ in range(6)]
    rows = []
    for k in range(90):
        copy = list(items[k % 6])
        for at in own.integers(0, length, k % 5):
            copy[at] = f"x{at}"
        if k % 3 == 1:
            copy.insert(int(own.integers(0, length + 1)), "y")
        lo = int(own.integers(0, max(1, length - 12)))
        rows.append([f"z{v}" for v in own.integers(0, 9, own.integers(0, 4))] + (copy[lo : lo + 13] if k % 7 == 6 else copy) + ["z"] * (k % 2))
    hashes, firsts = _hashes([[*r, ","] for r in rows])
    sought, expected = [_hashes([x])[0] for x in items], {}
    for t in range(len(rows)):
        for item in range(6):
            for shift in range(firsts[t] - length + 1, firsts[t + 1]):
                lo, hi = max(firsts[t], shift), min(firsts[t + 1], shift + length)
                matched = decontaminate.best_run(hashes[lo:hi] == sought[item][lo - shift : hi - shift])[2] if hi > lo else 0
                if decontaminate.enough(matched, length):
                    expected[t, item] = max(matched, expected.get((t, item), 0))
    assert findings(hashes, firsts, sought) == expected and expected


# ---- language model -----------------------------------------------------------------


def test_language_model_matches_plain_counts(docs, none):
    got = ngram_trie.score_texts(docs, ngram_trie.held_out_fold(), block_bytes=3000, shard_entries=200).collect()
    tokens = [(i, WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) + ["</s>"]) for i, t, *_ in odd_rows()]
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2
    one, two = collections.Counter(), collections.Counter()
    for i, w in tokens:
        if not held(i):
            one.update(w)
            two.update(zip(["</s>", *w[:-1]], w, strict=True))
    n, v, mu = sum(one.values()), len(one), ngram_trie.MU
    p1 = lambda w: (one[w] + 1) / (n + v + 1)
    expected = sorted((str(i), held(i), len(w), sum(one[x] > 0 for x in w), sum(math.log10(p1(x)) for x in w), sum(math.log10((two[h, x] + mu * p1(x)) / (one[h] + mu)) for h, x in zip(["</s>", *w[:-1]], w, strict=True))) for i, w in tokens)
    for r, e in zip(sorted((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.base_score, r.score) for r in got), expected, strict=True):
        assert r[:4] == e[:4] and abs(r[4] - e[4]) < 1e-6 and abs(r[5] - e[5]) < 2e-3 * e[2]
    assert {r.train_tokens for r in got} == {n}
    assert ngram_trie.score_texts(none).count() == 0


def test_elias_fano_and_trie():
    own = np.random.default_rng(1)
    for bound in (1, 50, 1000, 1 << 40):
        values = np.unique(own.integers(0, bound, 300)).astype(U)
        coded = ngram_trie.EliasFano(ngram_trie.mapped(ngram_trie.EliasFano.build(values, bound)))
        assert (coded.get(np.arange(len(values))) == values).all()
        asked = own.integers(0, bound, 200).astype(U)
        assert [i >= 0 for i in coded.find(asked)] == [int(a) in set(values.tolist()) for a in asked]
    h, w = np.array([3, 3, 9, 9, 9]), np.array([1, 7, 0, 2, 8])
    trie = ngram_trie.Trie(ngram_trie.Trie.build(h, w, np.arange(1, 6), 10, 20))
    assert trie.query(np.array([3, 9, 9, 4, 3]), np.array([7, 8, 1, 1, 8])).tolist() == [2, 5, 0, 0, 0]
