"""Operators and stages on small tables: nulls, empty tables, ties, repeated rows, long texts, clashing columns, brute force."""

import importlib
import random
import re
import sys
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from graphloom.llm import html_extract, language_id, mixing, ngram_join, packing, quality_classifier, quality_rules, sharding, substring, topk
from graphloom.llm.common import written

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORD = re.compile(r"[^\x20\x09-\x0d]+")


def sentence(rng, n, words):
    return " ".join(rng.choice(words) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(5)
    en, de = [f"the{a}{b}ing" for a in "abcdefgh" for b in "xyzuvw"], [f"der{a}{b}ung" for a in "äöüklmn" for b in "abcdef"]
    out = []
    for i in range(120):
        out.append((i, sentence(rng, rng.randint(40, 160), en if i % 3 else de), "en" if i % 3 else "de", f"s{i % 4}" if i % 7 else None, 0))
    base = out[1][1].split()
    out += [(200 + k, " ".join(base), "en", "s1", 0) for k in range(5)]
    out += [(210 + k, " ".join(base[:k + 5] + ["changed"] + base[k + 6 :]), "en", "s1", 0) for k in range(3)]
    shared = sentence(rng, 60, en)
    out += [(220 + k, f"{sentence(rng, 40, en)} {shared} {sentence(rng, 30, en)}", "en", "s2", 0) for k in range(6)]
    out += [(230, None, None, None, None), (231, "", "en", "s0", 0), (232, " \n", None, "s0", 0), (None, out[2][1], "en", "s0", 0), (3, out[3][1], out[3][2], out[3][3], 0), (240, "12 !! ## 34", "en", "s3", 11), (241, sentence(rng, 30_000, en), "en", "s3", 0)]
    return out


@pytest.fixture(scope="module")
def docs(spark, rows):
    return written(spark.createDataFrame(rows, SCHEMA), "test-docs")


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def clashing(docs):
    for c in ("size", "target", "copies", "score", "rank", "shard", "_hash", "n_words", "kept", "lang_pred", "class_id", "start", "_spans"):
        docs = docs.withColumn(c, F.lit("mine"))
    return docs


def test_mix(docs, none):
    from graphloom.llm.common import n_words

    sized = docs.select("doc_id", "source", n_words(F.col("text")).alias("size"))
    got = mixing.copies(sized).toPandas()
    assert len(got) == docs.count() and (got.copies * got["size"] <= 2 * got["size"]).all()
    g = got.assign(taken=got.copies * got["size"], source=got.source.fillna("~")).groupby("source").agg(size=("size", "sum"), given=("source_size", "first"), target=("target", "first"), taken=("taken", "sum"), top=("size", "max"))
    assert (g["size"] == g.given).all() and g.target.sum() == pytest.approx(1.5 * g["size"].sum()) and (g.target <= 2 * g["size"] + 1e-9).all()
    assert ((g.taken - g.target).abs() <= g.top + 1e-9).all()
    # the targets, shared again and again as the rule says
    names = sorted(g.index[:-1]) + ["~"]
    weight = {n: (5, 2, 1)[i % 3] for i, n in enumerate(names)}
    want, open_, left = {}, set(names), 1.5 * g["size"].sum()
    while True:
        level = {n: left * weight[n] / sum(weight[m] for m in open_) for n in open_}
        over = {n for n in open_ if level[n] > 2 * g["size"][n]}
        if not over:
            break
        for n in over:
            want[n] = 2 * g["size"][n]
            left -= want[n]
        open_ -= over
    want |= level
    assert {n: g.target[n] for n in names} == pytest.approx(want)
    again = mixing.copies(sized.repartition(7)).toPandas()
    key = lambda x: sorted(x[["doc_id", "size", "copies"]].fillna(-1).itertuples(index=False, name=None))
    assert key(got) == key(again)
    assert mixing.mixed(clashing(docs)).columns == clashing(docs).columns and mixing.mixed(docs).count() == got.copies.sum()
    assert mixing.mixed(none).count() == 0


def test_shards(spark, docs, none, tmp_path):
    sized = written(docs.select("doc_id", (F.octet_length(F.coalesce("text", F.lit(""))) + 1).cast("long").alias("size"), F.pmod(F.xxhash64("doc_id"), F.lit(5)).cast("int").alias("old")), "sized")
    got = sharding.slots(written(sharding.reshard(sized, "old", "size", shards=4), "placed")).toPandas()
    assert len(got) == docs.count()
    for _, g in got.groupby("shard"):
        assert sorted(g.slot) == list(range(len(g)))
    small = got[got["size"] < 100_000].groupby("shard")["size"].sum()
    assert len(small) == 4
    assert sharding.reshard(sized.limit(0), "old", "size").count() == 0
    whole = docs.withColumn("old", F.pmod(F.coalesce("doc_id", F.lit(0)), F.lit(3)).cast("int"))
    changed = sharding.rewrite(whole, "old", f"file://{tmp_path}/shards", shards=4)
    assert 3 in changed
    back = spark.read.parquet(f"file://{tmp_path}/shards")
    assert back.count() == docs.count() if len(changed) == 4 else back.count() <= docs.count()


def test_top_k(spark):
    rng = random.Random(1)
    vectors = [(i, [rng.uniform(-1, 1) for _ in range(5)]) for i in range(60)] + [(100 + i, [0.5, 0.5, 0.0, 0.0, 0.0]) for i in range(8)]
    odd = [(200, None), (201, [None, 1.0, 1.0, 1.0, 1.0]), (202, [float("nan")] * 5), (203, [float("inf")] * 5), (None, [1.0] * 5)]
    df = topk.quantised(spark.createDataFrame(vectors + odd, "vec_id long, embedding array<float>"))
    import numpy as np

    q = {i: np.floor(256 * np.array(v, np.float32).astype(float)).astype(int) for i, v in vectors}
    want = set()
    for i in (x for x in q if x % 50 == 0):
        best = sorted(((-int(q[i] @ q[j]), j) for j in q if j != i))[:5]
        want |= {(i, r + 1, j, -s) for r, (s, j) in enumerate(best)}
    for block in (7, 1000):
        got = topk.top_k(df, df.where("vec_id % 50 = 0"), 5, block, block).collect()
        assert {(r.query_id, r["rank"], r.vec_id, r.score) for r in got} == want
    assert topk.top_k(df.limit(0), df.limit(0), 5).count() == 0
    assert topk.top_k(df.where("vec_id < 2"), df.where("vec_id = 0"), 5).count() == 1


def brute_links(rows):
    sets = []
    for r in rows:
        w = WORD.findall(r[1] or "")
        sets.append(frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset())
    links = defaultdict(set)
    for i, a in enumerate(rows):
        for j, b in enumerate(rows):
            if i != j and a[0] is not None and b[0] is not None and ((a[1] or "") == (b[1] or "") or (sets[i] and 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]))):
                links[i].add(j)
    return links


def test_ngram_join(docs, none, rows):
    got = ngram_join.join(clashing(docs)).collect()
    links = brute_links(rows)
    group = list(range(len(rows)))

    def find(i):
        while group[i] != i:
            i = group[i]
        return i

    for i in links:
        for j in links[i]:
            a, b = sorted((find(i), find(j)), key=lambda k: rows[k][0])
            group[b] = a
    want = sorted((r[0] if r[0] is not None else -1, -1 if r[0] is None else min(rows[k][0] for k in range(len(rows)) if rows[k][0] is not None and find(k) == find(i)), len(links[i])) for i, r in enumerate(rows))
    assert sorted((-1 if r.doc_id is None else r.doc_id, -1 if r.class_id is None else r.class_id, r.n_links) for r in got) == want
    assert ngram_join.join(none).count() == 0


def test_big_groups_of_near_copies_in_blocks(spark, monkeypatch):
    rng = random.Random(2)
    base = [f"w{i}" for i in range(120)]
    rows = []
    for i in range(60):
        w = list(base)
        w[rng.randrange(120)] = f"x{i}"
        rows.append((i, " ".join(w)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    links = brute_links(rows)
    monkeypatch.setattr(ngram_join, "BLOCK_SETS", 16)
    got = {r.doc_id: r.n_links for r in ngram_join.join(df).collect()}
    assert got == {i: len(links[i]) for i in range(60)}


def test_substrings(docs, none, rows):
    found = written(substring.repeats(clashing(docs)), "found").collect()
    covered = defaultdict(set)
    for r in found:
        assert r.match_doc_id < r.doc_id and r.n_words >= 50 and r.similarity >= 0.8
        covered[r.doc_id] |= set(range(r.start, r.start + r.n_words))
    first = {}
    for i, text, *_ in sorted((r for r in rows if r[0] is not None), key=lambda r: r[0]):
        w = WORD.findall(text or "")
        for k in range(len(w) - 49):
            at = first.setdefault(tuple(w[k : k + 50]), i)
            if at != i:
                assert set(range(k, k + 50)) <= covered[i], (i, k)
    assert not {r.doc_id for r in found} & {i for i in range(120) if i not in (1, 3)} and {221, 222, 223, 224, 225} <= set(covered) and 220 not in covered
    cut = {r.doc_id: r.text for r in substring.removed(clashing(docs), substring.repeats(docs)).collect()}
    assert 204 not in cut and cut[220] == dict((r[0], r[1]) for r in rows)[220] and 55 <= len(cut[223].split()) <= 75
    assert substring.repeats(none).count() == 0 and substring.removed(none, substring.repeats(none)).count() == 0


def test_a_longer_match_does_not_hide_another(spark):
    w = [f"w{i}" for i in range(100)]
    rows = [(3, " ".join(w)), (7, " ".join([*(f"x{i}" for i in range(30)), *w[20:80]])), (9, " ".join([*w[:50], "y", *w[51:]]))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found = {(r.doc_id, r.match_doc_id, r.start, r.n_words) for r in substring.repeats(df).collect()}
    assert found == {(7, 3, 30, 60), (9, 3, 0, 100), (9, 7, 20, 60)}
    cut = {r.doc_id: r.text for r in substring.removed(df, substring.repeats(df)).collect()}
    assert cut == {3: rows[0][1], 7: " ".join(f"x{i}" for i in range(30)) + " "}


@pytest.mark.parametrize("block", [512, 4])
def test_filled_in_templates_meet_every_earlier_filling(spark, monkeypatch, block):
    rng = random.Random(5)
    template, rows, fillings = [f"t{i}" for i in range(60)], [], []
    for i in range(60):
        filling = tuple(rng.randrange(4) for _ in range(3))
        notice = list(template)
        for place, x in zip((15, 30, 45), filling, strict=True):
            notice[place] = f"fill{place}x{x}"
        fillings.append(filling)
        rows.append((i, " ".join([*(f"a{i}x{j}" for j in range(40)), *notice, *(f"b{i}x{j}" for j in range(40))])))
    monkeypatch.setattr(substring, "BLOCK", block, raising=False)
    got = {(r.doc_id, r.match_doc_id) for r in substring.repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect() if r.start <= 40 and r.start + r.n_words >= 100}
    equal = {(i, j) for i in range(60) for j in range(i) if fillings[i] == fillings[j]}
    near = {(i, j) for i in range(60) for j in range(i) if sum(x == y for x, y in zip(fillings[i], fillings[j], strict=True)) >= 2}  # 0.836 or 1
    assert equal <= got <= near and len(got) >= 0.9 * len(near)


def test_packing(docs, none):
    got = packing.packed(docs, with_ids=True).toPandas()
    import zlib

    import numpy as np

    assert all(zlib.crc32(bytes(x)) == c for x, c in zip(got.ids, got.ids_crc32, strict=True))
    own = packing.Tokens(packing.vocabulary())
    text = {r.doc_id: r.text for r in docs.collect()}
    for i, g in got[got.doc_id != 3].groupby("doc_id"):
        ids = np.concatenate([np.frombuffer(bytes(x), "<u4") for x in g.sort_values("start").ids])
        assert ids.tolist() == [*own.tokenizer.encode(text[i] or "", add_special_tokens=False).ids, 2] and (g.doc_tokens == len(ids)).all()
    for _, g in got.groupby("sequence_id"):
        g = g.sort_values("offset")
        assert g.offset.tolist() == [0, *g.length.cumsum().tolist()[:-1]] and g.length.sum() <= 4096
    assert packing.packed(none).count() == 0


def test_rules(docs, none, spark):
    got = {r.doc_id: r for r in quality_rules.rule(clashing(docs).drop("source").withColumn("source", F.lit("h"))).collect()}
    assert got[230].base_failed and got[231].n_words == 0 and not got[232].kept and got[241].n_words == 30_000
    lines = [(i, f"own words of document {i} " * 12 + ("\n" + "common line of the site " * (1 if i % 2 else 30)), "h") for i in range(30)] + [(100, "a page " + "alone with other words " * 15, "h"), (101, None, None)]
    df = spark.createDataFrame(lines, "doc_id long, text string, source string")
    out = {r.doc_id: r for r in quality_rules.rule(df, limit=10).collect()}
    assert [i for i in range(30) if out[i].shared_words] == list(range(30))
    copies = spark.createDataFrame([(i, "the same " * 40, "h") for i in range(40)], "doc_id long, text string, source string")
    assert quality_rules.rule(copies, limit=10).where("shared_words > 0").count() == 0
    assert quality_rules.rule(none).count() == 0


def test_classifier(docs, none, spark):
    stats = quality_classifier.with_statistics(docs.select("doc_id", "text"))
    model = quality_classifier.fit(stats.withColumn("quality", (F.col("doc_id") % 3 > 0).cast("int")))
    got = quality_classifier.score(stats, model).collect()
    assert len(got) == docs.count() and all(0 <= r.score <= 1 for r in got)
    empty = quality_classifier.with_statistics(none.select("doc_id", "text"))
    assert quality_classifier.score(empty, quality_classifier.fit(empty.withColumn("quality", F.lit(1)))).count() == 0


def test_language(docs, none):
    model = language_id.fit(docs)
    got = {r.doc_id: r for r in language_id.predict(clashing(docs), model).collect()}
    assert {got[i].lang_pred for i in (230, 231, 232, 240)} == {"und"}
    assert sum(got[i].lang_pred == ("en" if i % 3 else "de") for i in range(120)) >= 118 and got[241].lang_pred == "en"
    nothing = language_id.fit(none)
    assert language_id.predict(none, nothing).count() == 0 and {r.lang_pred for r in language_id.predict(docs, nothing).collect()} == {"und"}


def test_pages(spark):
    page = '<html><body><nav><a>Home</a></nav><div class="box"><p>{menu}</p></div><div class="main"><h1>Title {i}</h1><p>Text {i} &amp; more</p>{more}</div><div class="end"><p>{menu} end</p></div></body></html>'
    pages = [(i, "http://Site.example/x", page.format(menu="Same everywhere", i=i, more=f"<p>Also {i}</p>" * (i % 3))) for i in range(12)]
    pages += [(50, "http://site.example/y", None), (51, None, "<p>alone</p>"), (52, "", ""), (53, "http://other.example/", page.format(menu="Once", i=1, more="")), (53, "http://other.example/", page.format(menu="Once", i=1, more=""))]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").withColumn("text", F.lit("clash")).withColumn("host", F.lit(1))
    rows = html_extract.extract(df).collect()
    got = {r.page_id: r.text for r in rows}
    assert len(rows) == len(pages)
    for i in range(12):
        assert got[i] == "\n\n".join([f"Title {i}", f"Text {i} & more", *[f"Also {i}"] * (i % 3)])
    assert got[50] == got[52] == "" and got[51] == "alone" and "Text 1 & more" in got[53]
    assert html_extract.extract(df.limit(0)).count() == 0


def test_names_around_the_most_varied_slot_drop_nothing(spark):
    page = '<html><body><form><div class="layout has-sidebar"><nav><a>Home {i}</a></nav><div class="text"><p>A long text of page {i}</p><div class="share"><p>Share {i}</p></div></div><div class="sidebar"><p>See {i}</p></div></div></form></body></html>'
    pages = [(i, "http://site.example/x", page.format(i=i)) for i in range(12)] + [(20, "http://one.example/", page.format(i=20))]
    got = html_extract.extract(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()
    assert {r.page_id: r.text for r in got} == {i: f"A long text of page {i}" for i in [*range(12), 20]}


def test_stages_take_clashing_columns_and_empty_tables(spark, docs, none):
    import corpus_pipeline

    for table in (clashing(docs), none):
        now = table
        for name, stage in corpus_pipeline.STAGES[:-1]:
            now = written(stage(spark, now, ""), f"test-{name}")
            assert now.columns == table.columns, name
        kept = {r.doc_id for r in now.collect()}
        out = corpus_pipeline.STAGES[-1][1](spark, now, "")
        assert {r.doc_id for r in out.collect()} == kept
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language", "near_duplicates", "passages", "mixing", "packing"]


def test_the_rest_imports_without_this_package(monkeypatch):
    monkeypatch.setitem(sys.modules, "corpus_pipeline", None)
    sys.modules.pop("__spark_entry__", None)
    entry = importlib.import_module("__spark_entry__")
    assert not any(n.startswith("op") and n[2].isdigit() or n == "pipeline" for n in entry.queries())
    sys.modules.pop("__spark_entry__", None)
