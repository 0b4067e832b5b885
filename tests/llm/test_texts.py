import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from graphloom.llm import html_extract as H
from graphloom.llm import language_id, packing, quality_classifier, quality_rules, sharding, substring, topk
from graphloom.llm import ngram_join as J
from graphloom.llm.textgrams import ngrams, word_hashes

WORD = re.compile(r"[^\x20\x09-\x0d]+")
texts = st.lists(st.text(alphabet="ab c\n\té,.", max_size=40), max_size=6)


@settings(max_examples=60, deadline=None)
@given(texts)
def test_words_and_grams_are_those_of_the_pattern(ts):
    words, offsets = word_hashes(ts)
    split = [WORD.findall(t) for t in ts]
    assert np.diff(offsets).tolist() == [len(x) for x in split]
    same = {}
    for w, h in zip((w for x in split for w in x), words.tolist(), strict=True):
        assert same.setdefault(w, h) == h
    assert len(set(same.values())) == len(same)
    grams, starts = ngrams(words, offsets, 3)
    for i, x in enumerate(split):
        want = [tuple(x[k : k + 3]) for k in range(max(1, len(x) - 2))] if x else []
        got = grams[starts[i] : starts[i + 1]].tolist()
        assert len(got) == len(want) and [want.index(g) for g in want] == [got.index(g) for g in got]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.integers(0, 9), max_size=14), max_size=4), st.integers(1, 4))
def test_compact_windows_hold_every_passage_once(docs, least):
    docs = [d for d in docs]
    values = np.array([v << 40 for d in docs for v in d], np.uint64)
    offsets = np.concatenate([[0], np.cumsum([len(d) for d in docs])]).astype(np.int64)
    l, p, r = substring.compact_windows(values, offsets, least)
    for i in range(len(docs)):
        for s in range(offsets[i], offsets[i + 1]):
            for e in range(s + least - 1, offsets[i + 1]):
                holds = [k for k in range(len(p)) if l[k] <= s <= p[k] <= e <= r[k]]
                assert len(holds) == 1
                at = p[holds[0]]
                assert values[at] == values[s : e + 1].min() and (values[s:at] > values[at]).all()


def test_passages_part_what_is_not_similar_as_a_whole():
    a = np.arange(200, dtype=np.uint64)
    b = np.concatenate([np.arange(60), np.arange(1000, 1012), np.arange(60, 130)]).astype(np.uint64)
    got = substring.passages(a, b, [0, 12], 5, 50, 0.95)
    assert [(s, n) for s, n, *_ in got] == [(0, 64), (60, 74)]
    whole = substring.passages(a[:130], b, [0, 12], 5, 50, 0.8)
    assert [(s, n) for s, n, *_ in whole] == [(0, 134)]
    assert substring.passages(a, b, [], 5, 50, 0.8) == [] and substring.passages(a[:0], b, [0], 5, 50, 0.8) == []


def test_passages_keep_the_longest_similar_part_and_all_open_chains():
    def runs(*lengths):  # runs of equal tokens with five others between, as after an edit of one word
        own, other, n = [], [], 0
        for x in lengths:
            own += [*range(n, n + x), *range(10_000 + n, 10_005 + n)]
            other += [*range(n, n + x), *range(20_000 + n, 20_005 + n)]
            n += x
        return np.array(own, np.uint64), np.array(other, np.uint64)

    a, b = runs(44, 44, 6, 6, 6, 6)
    assert substring.passages(a, b, [0], 5, 50, 0.8) == [(0, 108, 0, 108, 94 / 114)]
    # twelve repeats elsewhere in b of tokens in the passage's gap start chains between its two runs
    own = np.concatenate([np.arange(44), np.arange(500, 512), np.arange(44, 88)]).astype(np.uint64)
    other = np.concatenate([np.arange(44), np.arange(600, 612), np.arange(44, 88)] + [[900 + i, 500 + i, 950 + i] for i in range(12)]).astype(np.uint64)
    at = {int(x): i for i, x in enumerate(other)}
    diagonals = [0, *[at[500 + i] - 44 - i for i in range(12)]]
    assert (0, 104) in [x[:2] for x in substring.passages(own, other, diagonals, 5, 50, 0.75)]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 30), st.integers(1, 12)), max_size=10))
def test_cover_covers_all_with_few(spans):
    words = lambda xs: {w for s, n in xs for w in range(s, s + n)}
    got = substring.cover(spans)
    assert words(got) == words(spans) and set(got) <= set(spans)
    assert all(words([x for x in got if x is not y]) != words(spans) for y in got)


def test_without_cuts_words():
    assert substring.without("a b  c d\ne", [(1, 2)]) == "a d\ne"
    assert substring.without("a b", [(0, 9)]) == "" and substring.without("", [(0, 1)]) == "" and substring.without(" a b", [(1, 1)]) == " a "


@settings(max_examples=30, deadline=None)
@given(st.lists(st.sets(st.integers(0, 30), max_size=12), min_size=2, max_size=9), st.sampled_from([0.5, 0.8, 1.0]))
def test_links_are_those_of_plain_jaccard(sets, least):
    arrays = [np.array(sorted(s), np.uint64) for s in sets]
    n = len(sets)
    left, right = np.arange(n), np.arange(n)
    got = J.links_within(arrays, left, right, least)
    for i in range(n):
        for j in (j for j in range(n) if j != i):
            union = sets[i] | sets[j]
            assert got[i, j] == (bool(union) and len(sets[i] & sets[j]) / len(union) >= least - 1e-12)


def test_bands_reach_their_recall():
    count, rows = J.bands(0.8, 0.999, 128)
    assert count * rows <= 128 and 1 - (1 - 0.8**rows) ** count >= 0.999


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(0, 40), min_size=1, max_size=5), st.integers(1, 6))
def test_transfers_move_no_more_than_must(sizes, shards):
    rooms = sharding.even(sum(sizes), shards)
    flow = sharding.transfers(sizes, rooms)
    assert [sum(r) for r in flow] == sizes and [sum(c) for c in zip(*flow, strict=True)] == rooms
    moved = sum(x for i, r in enumerate(flow) for j, x in enumerate(r) if i != j)
    least = sum(max(0, s - (rooms[i] if i < shards else 0)) for i, s in enumerate(sizes))
    assert moved == least


def test_transfers_follow_a_cost():
    flow = sharding.transfers([10, 0], [5, 5, 5], cost=lambda i, j: [1, 5, 2][j])
    assert flow == [[5, 0, 5], [0, 0, 0]]
    with pytest.raises(ValueError):
        sharding.transfers([3], [1, 1])


@settings(max_examples=30, deadline=None)
@given(st.integers(0, 30_000))
def test_cut_covers_a_document(n):
    pieces = packing.cut(n)
    assert sum(pieces) == n and all(0 < p <= packing.WINDOW for p in pieces) and sum(p not in (4096, 2048) for p in pieces) <= 1


def test_nnls_against_brute_force():
    rng = np.random.default_rng(0)
    for _ in range(20):
        a, b = rng.normal(size=(5, 4)), rng.normal(size=5)
        x = packing.nnls(a, b)
        best = min((np.linalg.norm(a[:, s] @ np.maximum(y := np.linalg.lstsq(a[:, s], b, rcond=None)[0], 0) - b) for s in ([i for i in range(4) if m >> i & 1] for m in range(1, 16)) if (np.linalg.lstsq(a[:, s], b, rcond=None)[0] >= -1e-12).all()), default=np.linalg.norm(b))
        assert (x >= 0).all() and np.linalg.norm(a @ x - b) <= min(best, np.linalg.norm(b)) + 1e-9


def test_combinations_fill_and_plan_stays_within_the_histogram():
    found = packing.combinations(12, 3, [2, 4, 6, 12])
    assert set(found) == {(12,), (6, 6), (6, 4, 2), (4, 4, 4)}
    histogram = {2: 5, 4: 9, 6: 7, 12: 2}
    used = Counter()
    for combo, times in packing.plan(histogram, 12, 3):
        assert sum(combo) == 12
        for u in combo:
            used[u] += times
    assert all(used[u] <= histogram[u] for u in used) and used[12] == 2
    assert packing.plan({}, 12, 3) == []


def test_tokens_are_the_tokenizers():
    own = packing.Tokens(packing.vocabulary())
    ts = ["it's Don't we'LL x'sam <|endoftext|>b", "Été é a b 12ab3 !!a's ÀÖß", "", None, "a\x1cb \x85 Σας İx ﬁ ¡¿ 中文", "the the"]
    for t, ids in zip(ts, own.many(ts), strict=True):
        assert ids[:-1].tolist() == own.tokenizer.encode(t or "", add_special_tokens=False).ids and ids[-1] == packing.END_ID


def test_quality_measures_by_hand():
    m = quality_rules.measures("a b c a b c\nx #$\n\n a b c a b c\nx #$")
    assert (m["n_words"], m["n_symbols"], m["n_dup_lines"]) == (16, 4, 1)
    words = "a b c a b c x #$ a b c a b c x #$".split()
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    count = Counter(windows)
    assert m["n_repeat_words"] == len({i + k for i, w in enumerate(windows) if count[w] > 1 for k in range(3)})
    assert m["word_chars"] == sum(map(len, words))
    assert quality_rules.measures(None)["n_words"] == 0 and quality_rules.measures("\x1c é")["n_words"] == 2


def test_statistics_and_trees():
    assert not quality_classifier.statistics(None).any() and np.isfinite(quality_classifier.statistics("a 😀 B!\n" * 3)).all()
    rng = np.random.default_rng(0)
    x = rng.random((3000, 4)).astype(np.float32)
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)
    model = quality_classifier.train(x[:2000], y[:2000])
    assert ((model.score(x[2000:]) > 0.5) == y[2000:]).mean() > 0.95
    assert quality_classifier.train(x[:0], y[:0]).score(x[:3]) == pytest.approx(0.5)
    assert (quality_classifier.train(x[:100], np.ones(100)).score(x[:3]) > 0.9).all()


def test_language_features_and_training():
    for t in (None, "", "123 !!", "\n"):
        assert not len(language_id.grams(t)[0])
    long = "der hund und die katze " * 30_000
    a, b = language_id.grams(long[: 23 * 5000]), language_id.grams(long)
    assert set(a[0]) == set(b[0])
    whole = language_id.grams(("ab " * 200_000)[: (1 << 18) + 5])
    assert whole[1].sum() > 3 * (1 << 18) * 0.95
    rows = [(np.array([i % 2, 2]), np.array([1.0, 0.2])) for i in range(200)]
    w = language_id.ftrl(rows, np.arange(200) % 2, 2)
    p = [int((x @ w[at] + w[-1]).argmax()) for at, x in rows]
    assert p == [i % 2 for i in range(200)] and (w[3:-1] == 0).all()
    assert language_id.temperature(np.array([[9.0, 0.0], [9.0, 0.0]]), np.array([0, 1])) > 3


def test_top_k_scores_without_overflow():
    q, c = np.array([[1 << 25, -3]]), np.array([[1 << 25, 2], [5, 7]])
    assert topk._accumulate(q, c).tolist() == [[(1 << 50) - 6, 5 * (1 << 25) - 21]]


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style><script>x="</p>";</script></head><body>
<header>Site</header><nav><ul><li><a href=/a>{0}</a><li>Two</ul></nav><div class="ad">Buy {0}</div>
<article><h1>Title &amp; {1}</h1><p><b>Lead {1}<br>more<p>Body &lt;x&gt; &#233; {1}</p><div class="comments"><p>Nice {1}</p></div></article>
<aside>Side</aside><footer>&copy; {0}</footer></body>"""


def test_parse_and_check_of_one_page():
    blocks, _ = H.blocks_of(PAGE.format("n", "k"), None)
    assert [t for _, t, ok in blocks if ok] == ["Title & k", "Lead k more", "Body <x> é k"]
    for bad in (None, "", "<", "<p", "a < b", "<!-- x", "<script>", "</p></p>", "<td>1<td>2"):
        H.blocks_of(bad, H.parse(bad)[0])
    assert [t for _, t, _ in H.blocks_of("a < b <i>c</i>", None)[0]] == ["a < b c"]


def brute_matching(a, b):
    if not H._same(a, b):
        return 0
    m = [[0] * (len(b.kids) + 1) for _ in range(len(a.kids) + 1)]
    for i, x in enumerate(a.kids):
        for j, y in enumerate(b.kids):
            m[i + 1][j + 1] = max(m[i][j + 1], m[i + 1][j], m[i][j] + brute_matching(x, y))
    return m[-1][-1] + 1


@settings(max_examples=60, deadline=None)
@given(st.lists(st.sampled_from(["<div>", "<ul>", "<li>x", "</div>", "</ul>", "<p>t"]), max_size=14), st.lists(st.sampled_from(["<div>", "<ul>", "<li>x", "</div>", "</ul>", "<p>t"]), max_size=14))
def test_simple_tree_matching(a, b):
    x, y = H.parse("".join(a))[0], H.parse("".join(b))[0]
    n, pairs = H.align(x, y)
    assert n == len(pairs) == brute_matching(x, y)
    assert all(H._same(p, q) for p, q in pairs) and len({id(p) for p, _ in pairs}) == len(pairs)


def test_crc_and_window_constants():
    assert zlib.crc32(np.array([2], "<u4").tobytes()) >= 0 and math.log2(packing.WINDOW) == 12


@pytest.mark.parametrize("cells", [None, 50])
def test_alignment_compares_all_siblings_of_wide_pages(monkeypatch, cells):
    rng = random.Random(4)
    if cells:  # rows between kept ones are made again
        monkeypatch.setattr(H, "CELLS", cells)
    for n, m in ((700, 650), (40, 700), (700, 30)) if not cells else ((60, 70), (20, 9), (9, 90)):
        xs, ys = ([(rng.choice("abc"), rng.randrange(3)) for _ in range(k)] for k in (n, m))
        trees = [H.parse("".join(f"<div class={c}>{'<h2></h2>' * i}</div>" for c, i in side))[0] for side in (xs, ys)]
        above = [0] * (m + 1)
        for c, i in xs:
            row = [0]
            for j, (d, k) in enumerate(ys):
                row.append(max(row[-1], above[j + 1], above[j] + (1 + min(i, k) if c == d else 0)))
            above = row
        count, pairs = H.align(*trees)
        assert count == above[-1] + 1 == len(pairs) and all(x.tag == y.tag and x.mark == y.mark for x, y in pairs)
