"""Chains, repeats, hot tokens and odd layouts, against brute force."""

import os
import random
import re
import time

import corpus_pipeline
import numpy as np
import pytest
from pyspark.sql import functions as F

from graphloom.llm import html_extract as H
from graphloom.llm import ngram_join, packing, sharding, substring, topk
from graphloom.llm.common import written
from graphloom.llm.components import components

WORD = re.compile(r"[^\x20\x09-\x0d]+")


@pytest.mark.parametrize("shape", ["path", "star", "forest"])
def test_components_of_long_chains_and_stars(spark, shape):
    rng = random.Random(3)
    if shape == "path":
        order = list(range(1000))
        edges = list(zip(order, order[1:]))
    elif shape == "star":
        edges = [(500, i) for i in range(1000) if i != 500]
    else:
        edges = [(i, rng.randrange(max(0, i - 40), i)) for i in range(1, 600) if i % 60]
    root = {}
    for a, b in edges:
        root.setdefault(a, a), root.setdefault(b, b)
    changed = True
    while changed:
        changed = False
        for a, b in edges:
            low = min(root[a], root[b])
            if root[a] != low or root[b] != low:
                root[a] = root[b] = low
                changed = True
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == root


def test_drifting_documents_are_one_class(spark):
    rng = random.Random(9)
    words, rows = [f"w{i}" for i in range(100)], []
    for i in range(300):
        words[rng.randrange(100)] = f"x{i}"
        rows.append((i, " ".join(words)))
    sets = [{tuple(w[k : k + 5]) for k in range(len(w) - 4)} for w in (t.split() for _, t in rows)]
    links = [sum(j != i and 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]) for j in range(300)) for i in range(300)]
    got = {r.doc_id: (r.class_id, r.n_links) for r in ngram_join.join(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    whole = {i: int(sum(5 * len(sets[i] & sets[i - 1]) >= 4 * len(sets[i] | sets[i - 1]) for _ in (0,))) for i in range(1, 300)}
    want, at = {}, 0
    for i in range(300):
        at = at if i and whole[i] else i
        want[i] = (at, links[i])
    assert got == want


def test_texts_under_one_id_are_documents_of_their_own(spark):
    rng = random.Random(4)
    text = lambda: " ".join(f"w{rng.randrange(10_000)}" for _ in range(120))
    a, b, c = text(), text(), text()
    rows = [(7, a, "en", "s", 1), (7, b, "en", "s", 1), (7, b, "en", "s", 1), (9, b + " more", "en", "s", 1), (11, c, "en", "s", 1), (12, a, "en", "s", 1), (None, a, "en", "s", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = sorted((r.doc_id or 0, r.text) for r in corpus_pipeline.near_duplicates(spark, docs, "").collect())
    assert got == sorted([(7, a), (7, b), (11, c), (0, a)])
    links = sorted((r.doc_id, r.class_id, r.n_links) for r in ngram_join.join(docs.where("doc_id IS NOT NULL")).collect())
    assert links == [(7, 7, 1), (7, 7, 2), (7, 7, 2), (9, 7, 2), (11, 11, 0), (12, 7, 1)]
    shared = text()
    rows = [(7, f"{a} {shared}", "en", "s", 1), (7, f"{shared} {b}", "en", "s", 1), (5, c, "en", "s", 1)]
    kept = corpus_pipeline.passages(spark, spark.createDataFrame(rows, docs.schema), "").collect()
    texts = [r.text for r in kept]
    assert sorted(r.doc_id for r in kept) == [5, 7, 7] and sum(shared in t for t in texts) == 1 and any(a in t for t in texts) and any(b in t for t in texts)


def first_holders(rows, least):
    """Places of all stretches of ``least`` words that an earlier document holds."""
    first, out = {}, {}
    for i, text in rows:
        w = text.split()
        for k in range(len(w) - least + 1):
            if first.setdefault(tuple(w[k : k + least]), i) != i:
                out.setdefault(i, set()).update(range(k, k + least))
    return out


@pytest.mark.parametrize("few", [64, 4])
def test_hot_tokens_cover_what_earlier_documents_hold(spark, monkeypatch, few):
    rng = random.Random(6)
    own = lambda n: [f"o{rng.randrange(10**9)}" for _ in range(n)]
    notice, licence = [f"n{i}" for i in range(55)], [f"l{i}" for i in range(200)]
    rows = []
    for i in range(50):  # a notice that all hold, alone or with what only some hold around it
        around = [f"r{i % 5}x{k}" for k in range(30)] if i % 2 else own(30)
        rows.append((i, " ".join([*own(40), *notice, *around, *own(20)])))
    for i in range(50, 90):  # near copies, and a common line of nine words that is no passage
        words = list(licence)
        for _ in range(3):
            words[rng.randrange(200)] = f"e{i}x{rng.randrange(99)}"
        rows.append((i, " ".join([*[f"c{k}" for k in range(9)], *own(60), *words])))
    rows += [(90 + i, " ".join([*[f"c{k}" for k in range(9)], *own(100)])) for i in range(30)]
    rows += [(200, " ".join(["spam"] * 400)), (201, " ".join([*own(30), *["spam"] * 90])), (202, " ".join(["a b c d e f g h"] * 30)), (203, " ".join(["a b c d e f g h"] * 12 + own(10)))]
    monkeypatch.setattr(substring, "FEW", few)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found = substring.repeats(df).collect()
    covered = {}
    for r in found:
        assert r.match_doc_id < r.doc_id and r.n_words >= 50 and r.similarity >= 0.8
        covered.setdefault(r.doc_id, set()).update(range(r.start, r.start + r.n_words))
    want = first_holders(rows, 50)
    missing = {i: sorted(places - covered.get(i, set())) for i, places in want.items() if places - covered.get(i, set())}
    assert not missing
    assert not set(covered) & {*range(90, 120), 200, 202} and (few > 4 or len(found) < 1500) and len({(r.doc_id, r.match_doc_id) for r in found if r.doc_id == 201}) == 1


def test_rewriting_leaves_other_shards_and_reads_its_own_folder(spark, tmp_path):
    path = f"file://{tmp_path}/layout"
    rows = [(i, "x" * (50 if i % 3 else 40), i % 3) for i in range(90)] + [(None, None, 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, old int")
    docs.withColumnRenamed("old", "shard").write.partitionBy("shard").parquet(path)
    sizes = [sum(len(t or "") + 1 for _, t, s in rows if s == j) for j in range(3)]
    stays = {str(f.relative_to(tmp_path)) for f in tmp_path.glob("layout/shard=0/*.parquet")}
    room = [sizes[0], sizes[1] + 30, sum(sizes) - sizes[0] - sizes[1] - 30]
    read = spark.read.parquet(path).withColumnRenamed("shard", "old")
    assert sharding.rewrite(read, "old", path, shards=3, capacities=room) == [1, 2]
    back = spark.read.parquet(path)
    assert sorted(back.select("doc_id", "text").collect(), key=str) == sorted(docs.select("doc_id", "text").collect(), key=str)
    assert {str(f.relative_to(tmp_path)) for f in tmp_path.glob("layout/shard=0/*.parquet")} == stays
    assert 0 in sharding.rewrite(spark.read.parquet(path).withColumnRenamed("shard", "old"), "old", path, shards=2)
    back = spark.read.parquet(path)
    assert back.count() == 91 and {r[0] for r in back.select("shard").distinct().collect()} == {0, 1}


def test_slots_agree_on_reruns_and_null_ids_spread(spark):
    rows = [(None if i % 2 else 5, 10, i) for i in range(400)]
    df = written(spark.createDataFrame(rows, "doc_id long, size long, text_crc32 long").withColumn("old", F.lit(0)), "same-ids")
    run = lambda d: sorted(map(tuple, sharding.slots(written(sharding.reshard(d, "old", "size", shards=4, tie_cols=("text_crc32",)), "x"), tie_cols=("size", "text_crc32")).select("text_crc32", "shard", "slot").collect()))
    assert run(df) == run(df.repartition(7))


def test_repeated_queries_are_one(spark):
    rows = [(50, [1, 2]), (50, [1, 2]), (1, [3, 4]), (1, [3, 4]), (2, [1, 1]), (100, [2, 0])]
    df = written(spark.createDataFrame(rows, "vec_id long, _v array<long>"), "vectors")
    got = {}
    for r in topk.top_k(df, df.where("vec_id % 50 = 0"), 3).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    assert {q: sorted(x) for q, x in got.items()} == {50: [(1, 1, 11), (2, 1, 11), (3, 2, 3)], 100: [(1, 1, 6), (2, 1, 6), (3, 2, 2)]}
    with pytest.raises(ValueError):
        huge = spark.createDataFrame([(0, [1 << 40]), (1, [1 << 40])], "vec_id long, _v array<long>")
        topk.top_k(huge, huge, 3)


def test_packing_fills_windows_and_spreads_null_ids(spark):
    rng = random.Random(2)
    rows = [(None if i < 300 else i, " ".join(f"word{rng.randrange(500)}" for _ in range(rng.randrange(900)))) for i in range(1500)]
    got = packing.packed(spark.createDataFrame(rows, "doc_id long, text string")).toPandas()
    total = got.groupby("sequence_id").length.sum()
    assert (total <= 4096).all() and total.sum() / (4096 * len(total)) > 0.99
    for _, g in got.groupby("sequence_id"):
        g = g.sort_values("offset")
        assert g.offset.tolist() == [0, *g.length.cumsum().tolist()[:-1]]


def test_another_vocabulary_goes_through_the_library():
    import public_tokenizers

    own = packing.Tokens(public_tokenizers.path("byte_bpe_50k.json"))
    texts = ["It's  a\tTEST 12.", "", "été\n\nx"]
    assert own.merged is None
    for t, ids in zip(texts, own.many(texts), strict=True):
        assert np.array_equal(ids, [*own.tokenizer.encode(t, add_special_tokens=False).ids, packing.END_ID])


def test_deep_wide_and_broken_pages():
    deep = "<div>" * 10_000 + "<p>core</p>" + "</div>" * 10_000
    wide = "<ul>" + "".join(f"<li>item {i}</li>" for i in range(50_000)) + "</ul>"
    mixed = "".join(f"<p>a{i}</p><div><b>b{i}</b><p>c</p></div>" for i in range(700))
    for page, n in ((deep, 10_003), (wide, 50_003)):
        tree, blocks = H.parse(page)
        H._number(tree)
        count, pairs = H.align(H.parse(page)[0], tree)
        assert count == len(pairs) == n - 1 and all(a.tag == b.tag for a, b in pairs)
        assert len(H.checked(page, tree)[0]) == len(blocks)
    tree = H.parse(mixed)[0]
    assert H.align(H.parse(mixed)[0], tree)[0] == 1 + 700 * 3
    assert H.align(H.parse("<p>x</p>" + mixed[: len(mixed) // 2])[0], tree)[0] > 1000
    assert [t for _, t in H.parse('a<a title="foo>bar')[1]] == ["abar"]  # a quote without an end ends with the tag
    assert [t for _, t in H.parse("<p title='x\">y</p><p>z")[1]] in (["y", "z"], [])


def test_templates_decide_without_names(spark, monkeypatch):
    """Menus, adverts and lines at the foot that change from page to page, under no telling name, on small hosts."""
    rng = random.Random(8)
    pool = [" ".join(f"v{i}x{k}" for k in range(6)) for i in range(12)]
    page = "<html><body><div><ul>{menu}</ul></div><div class='x'>{top}</div><div class='y'><h1>Title {i}</h1><p>Text {i}</p><p>More {i}</p></div><div class='z'>(c) {host} {end}</div></body></html>"
    rows, want = [], {}
    for i in range(48):
        host = f"h{i % 6}.example"
        menu = "".join(f"<li>{w}</li>" for w in rng.choice(pool).split())
        rows.append((i, f"http://{host}/{i}", page.format(menu=menu, top=rng.choice(pool), end=rng.choice(pool), host=host, i=i)))
        want[i] = f"Title {i}\n\nText {i}\n\nMore {i}"
    got = {r.page_id: r.text for r in H.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == want


def test_no_pair_at_the_threshold_is_left_to_chance(spark):
    rng = random.Random(1)  # texts of 20 and 25 n-grams, 20 of them common; 18 bands of 5 hashes miss the pairs 623 and 808
    pairs = [[f"w{rng.randrange(10**6)}" for _ in range(29)] for _ in range(900)]
    rows = [(2 * i + k, " ".join(w[: 24 + 5 * k])) for i, w in enumerate(pairs) for k in (0, 1)]
    got = {r.doc_id: (r.class_id, r.n_links) for r in ngram_join.join(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i: (i - i % 2, 1) for i, _ in rows}


def test_prefixes_of_similar_sets_meet():
    rng = random.Random(2)
    for _ in range(3000):
        n = rng.randrange(1, 40)
        extra = [rng.randrange(n + 1) for _ in range(2)]
        whole = rng.sample(range(10**6), n + sum(extra))
        sets = [set(whole[:n] + whole[n : n + extra[0]]), set(whole[:n] + whole[n + extra[0] :])]
        similarity = n / len(whole)
        rarity = {g: rng.randrange(4) for g in whole}
        prefixes = []
        for x in sets:
            most, k = (int(v[0]) for v in ngram_join.sampled(np.array([len(x)]), similarity))
            prefixes.append(set(sorted(sorted(x)[:most], key=lambda g: (rarity[g], g))[:k]))
        assert prefixes[0] & prefixes[1]


def test_passages_of_the_least_length_are_found_where_pieces_of_them_are_frequent(spark, monkeypatch):
    rng = random.Random(8)
    words = lambda n: [f"w{rng.randrange(10**7)}" for _ in range(n)]
    rows, holders = [], []
    passages = [words(50) for _ in range(12)]
    for passage in passages:  # pieces too short to count, in documents before those that hold the whole
        for _ in range(10):
            for at in (0, 1):
                rows.append((len(rows), " ".join(words(60) + passage[at : at + 49] + words(60))))
    for passage in passages:
        pair = len(rows), len(rows) + 1
        holders.append(pair)
        rows += [(i, " ".join(words(70) + passage + words(70))) for i in pair]
    monkeypatch.setattr(substring, "FEW", 4)
    found = substring.repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {(r.match_doc_id, r.doc_id) for r in found if r.start <= 70 and r.start + r.n_words >= 120} == set(holders)


def _tables_left(spark, before):
    """Names of the scratch tables that are there now and not before, with how often each is."""
    folder = spark.conf.get("spark.checkpoint.dir").removeprefix("file://")
    names = [x.split("-", 1)[1].rsplit("-", 1)[0] for x in os.listdir(folder) if x.startswith("graphloom-") and x not in before]
    return sorted(names)


def _near(n, words=120):
    """Documents of which each third is a near copy of the one before."""
    rng = random.Random(5)
    texts = []
    for i in range(n):
        ws = [f"w{rng.randrange(4000)}" for _ in range(words)] if i % 3 or not i else texts[-1].split()[:-1] + [f"x{i}"]
        texts.append(" ".join(ws))
    return list(enumerate(texts))


def test_shuffles_of_a_written_table_go_with_it(spark):
    folders = list(spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString())
    files = lambda: {f for top in folders for _, _, names in os.walk(top) for f in names if re.match(r"shuffle_\d+_\d+_\d+\.data", f)}
    before, asked = files(), spark.conf.get(setting := "spark.sql.classic.shuffleDependency.fileCleanup.enabled")
    got = written(spark.range(0, 20_000, 1, 4).withColumn("k", F.col("id") % 100).groupBy("k").agg(F.collect_list("id").alias("all")), "grouped")
    for _ in range(50):
        left = files() - before
        if not left:
            break
        time.sleep(0.1)
    assert not left
    assert got.selectExpr("sum(size(all))").first()[0] == 20_000
    assert spark.conf.get(setting) == asked


def test_the_ngram_join_keeps_no_samples_beyond_their_use(spark):
    before = set(os.listdir(folder)) if os.path.isdir(folder := spark.conf.get("spark.checkpoint.dir").removeprefix("file://")) else set()
    joined = ngram_join.join(spark.createDataFrame(_near(60), "doc_id long, text string"))
    left = _tables_left(spark, before)
    assert set(left) <= {"keys", "classes", "links", "roots", "edges"} and len(left) <= 5, left
    got = {r.doc_id: (r.class_id, r.n_links) for r in joined.collect()}
    assert all(got[i] == (i - 1, 1) for i in range(3, 60, 3)) and got[1] == (1, 0)


def test_the_passages_are_all_that_stays_of_their_search(spark):
    before = set(os.listdir(folder)) if os.path.isdir(folder := spark.conf.get("spark.checkpoint.dir").removeprefix("file://")) else set()
    found = substring.repeats(spark.createDataFrame(_near(30), "doc_id long, text string"))
    assert _tables_left(spark, before) == ["found"]
    assert {(r.doc_id, r.match_doc_id, r.start, r.n_words) for r in found.collect()} == {(i, i - 1, 0, 119) for i in range(3, 30, 3)}
