"""The operators of the llm subpackage: brute force, round trips, held-out accuracy and edge cases."""

import random
import unicodedata

import numpy as np
import pyarrow as pa
import pytest
from conftest import rows_of, same_as_sql
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from leafgauge.llm import canonical, chunking, groupsplit, leakage, moderation, packing, pairs, percentiles, queries

SQL = queries.oracle_sql()


@pytest.mark.parametrize("name", sorted(queries.queries()))
def test_queries(spark, data, duck, name):
    df = queries.queries()[name](spark, data)
    if name in SQL:
        same_as_sql(duck, df, SQL[name])
    else:
        assert len(rows_of(df)) >= 0
    if name.endswith("_found"):
        assert df.distinct().count() == df.count()


# 1 --------------------------------------------------------------------------------------------

REGIONS = "row_id long, region_id string, chapter_id string, page_id string, region_order int, source_text string, updated_at timestamp, max_chars string"
MANIFEST = "chapter_id string, max_chars int, overlap_pages int, source_files array<struct<page_id:string,sha256:string>>"


def chapter(spark, pages, limit, overlap):
    from datetime import datetime

    rows = [(p * 1000 + r, f"r{p}-{r}", "c", f"p{p}", r, t, datetime(2025, 1, 1), "clash") for p, ts in enumerate(pages) for r, t in enumerate(ts)]
    return spark.createDataFrame(rows, REGIONS), spark.createDataFrame([("c", limit, overlap, [(f"p{p}", None) for p in range(len(pages))])], MANIFEST)


def new_text(fragments):
    rows = fragments.where("not repeated").orderBy("page_no", "region_id", "start_char").collect()
    out = {}
    for r in rows:
        out[r.region_id] = out.get(r.region_id, "") + r.fragment_text
    return out


def test_pieces(spark):
    rnd = random.Random(1)
    pages = [["".join(rnd.choice("あいうえお。") for _ in range(rnd.randrange(0, 60))) for _ in range(rnd.randrange(1, 5))] for _ in range(30)]
    pages[3] = ["長" * 500 + "。" + "文" * 400]
    pages[7] = [None, ""]
    r, m = chapter(spark, pages, 200, 1)
    f = chunking.split_oversized(r, m).cache()
    sizes = f.groupBy("seg", "block", "local_piece").agg(F.sum(F.col("end_char") - F.col("start_char")).alias("n"))
    assert sizes.where("n > 200").count() == 0
    assert new_text(f) == {f"r{p}-{k}": t or "" for p, ts in enumerate(pages) for k, t in enumerate(ts)}
    assert f.where("repeated").count() > 0
    found = {tuple(x) for x in chunking.items_over_limit(f).collect()}
    expect = {("chapter", "c")} | {("page", f"p{p}") for p, ts in enumerate(pages) if sum(len(t or "") for t in ts) > 200} | {("region", f"r{p}-{k}") for p, ts in enumerate(pages) for k, t in enumerate(ts) if len(t or "") > 200}
    assert found == expect
    p = chunking.numbered_pieces(f).orderBy("piece_no").collect()
    assert [x.piece_no for x in p] == list(range(len(p))) and [x.page_to for x in p] == sorted(x.page_to for x in p)
    # An edit leaves the pieces of other segments as they are.
    pages[29] = ["変更。"]
    r2, m2 = chapter(spark, pages, 200, 1)
    key = lambda df: {(x.seg, x.local_piece, x.region_id, x.start_char) for x in df.where("not repeated").collect() if x.page_no < 20}
    seg = f.where("page_no = 29").first().seg
    far = lambda s: {x for x in s if x[0] < seg}
    assert far(key(f)) == far(key(chunking.split_oversized(r2, m2)))


def test_pieces_repeat_pages_up_to_the_limit(spark):
    """Pages of over half the limit are repeated whole, longer ones by their tail from a sentence's begin."""
    pages = [["あ" * 69 + "。"], ["い" * 69 + "。"], ["う" * 45 + "。" + "え" * 46 + "。"], ["お" * 49 + "。"]]
    r, m = chapter(spark, pages, 100, 1)
    f = chunking.split_oversized(r, m).cache()
    sizes = f.groupBy("seg", "block", "local_piece").agg(F.sum(F.col("end_char") - F.col("start_char")).alias("n"), F.sum(F.when(F.col("repeated"), F.length("fragment_text")).otherwise(0)).alias("old")).orderBy("seg", "block", "local_piece").collect()
    assert max(x.n for x in sizes) <= 100 and [x.old > 0 for x in sizes] == [False] + [True] * (len(sizes) - 1)
    assert "あ" * 69 + "。" in {x.fragment_text for x in f.where("repeated").collect()}
    assert new_text(f) == {f"r{p}-{k}": t for p, ts in enumerate(pages) for k, t in enumerate(ts)}


def test_pieces_repeat_at_every_start(spark, monkeypatch):
    """Starts after dense pages, blocks, pages without regions and of unlisted pages repeat what stands before."""
    monkeypatch.setattr(chunking, "DENSE_REGIONS", 20)
    monkeypatch.setattr(chunking, "ORDER_BLOCK", 16)
    r, m = chapter(spark, [["まえ。"], ["あいう。"] * 40, ["y。"], [], ["z。"]], 50, 1)
    monkeypatch.setattr(chunking, "SEGMENT_PAGES", 1)
    r = r.unionByName(r.where("page_id = 'p4'").withColumns({"page_id": F.lit("unlisted"), "region_id": F.lit("u"), "row_id": F.col("row_id") + 1000}))
    f = chunking.split_oversized(r, m)
    per = f.groupBy("seg", "block", "local_piece").agg(F.max("repeated").alias("old"), F.min("repeated").alias("only_old")).orderBy("seg", "block", "local_piece").collect()
    assert [x.old for x in per] == [False] + [True] * (len(per) - 1) and not any(x.only_old for x in per)
    assert f.where("not repeated").count() >= 44


def test_pieces_of_nothing_and_of_dense_pages(spark, monkeypatch):
    r, m = chapter(spark, [["a"]], 0, 0)
    assert chunking.items_over_limit(chunking.split_oversized(r, m)).count() == 0
    assert chunking.split_oversized(r.limit(0), m).count() == 0
    assert chunking.split_oversized(r, m.limit(0)).count() == 1
    monkeypatch.setattr(chunking, "DENSE_REGIONS", 50)
    monkeypatch.setattr(chunking, "ORDER_BLOCK", 16)
    r, m = chapter(spark, [["x。"], ["あいう。"] * 200, ["y"]], 100, 1)
    r = r.withColumn("region_order", F.when(F.col("row_id") % 5 > 0, F.col("region_order")))
    f = chunking.split_oversized(r, m)
    assert f.select("block").distinct().count() > 4 and len(new_text(f)) == 202
    assert {tuple(x) for x in chunking.items_over_limit(f).collect()} == {("chapter", "c"), ("page", "p1")}


# 2 --------------------------------------------------------------------------------------------


def components(edges):
    up = {}

    def find(x):
        up.setdefault(x, x)
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return {x: find(x) for x in list(up)}


def test_forest_against_union_find(spark):
    rnd = random.Random(2)
    edges = {tuple(sorted(rnd.sample(range(120), 2))) for _ in range(90)} | {(i, i + 1) for i in range(200, 260)} | {(300, i) for i in range(301, 340)}
    labels, forest = groupsplit.spanning_forest(spark.createDataFrame([(1, a, b) for a, b in edges], "k int, a long, b long"))
    expect = components(edges)
    assert {r.page: r.root for r in labels.collect()} == expect
    assert forest.count() == len(expect) - len(set(expect.values()))
    assert components([(r.a, r.b) for r in forest.collect()]) == expect
    none, tree = groupsplit.spanning_forest(spark.createDataFrame([], "k int, a long, b long"))
    assert none.count() == 0 and tree.count() == 0


def test_splits(spark):
    m = spark.createDataFrame([("pg-00000001", "AB" * 32, None), ("pg-00000002", "ab" * 32, None), ("pg-00000003", "f" * 64, "Pg 4"), ("pg-00000004", "F" * 64, None), ("pg-00000005", None, None), ("pg-00000006", "0" * 64, None)], "page_id string, sha256 string, reissue_of string")
    rows = [("t", i, f"r{i}", p) for i, p in enumerate(["pg_1", " pg-００００００02 ", "PG-3", "pg‐00000004", "pg-5", "pg-6", None, "none", "pg-99", "pg-" + "9" * 40])] + [("u", 0, "r4", "pg-6"), ("u", 1, None, "pg-5"), ("t", 0, "r0", "pg_1")]
    r = spark.createDataFrame(rows, "row_table string, row_id long, region_id string, page_id string")
    works = rows_of(groupsplit.works_of_pages(m, r), ["group_page_id", "page_id"])
    assert works == [("pg-00000001", "pg-00000002"), ("pg-00000003", "pg-00000004"), ("pg-00000005", "pg-00000006")]
    s = groupsplit.assign_splits(r, m, {"train": 0.5, "test": 0.5})
    assert s.count() == len(rows) and s.where("split is null").count() == 0
    assert s.where("group_page_id is not null").groupBy("group_page_id").agg(F.countDistinct("split").alias("n")).where("n > 1").count() == 0
    assert groupsplit.assign_splits(r.limit(0), m, {"train": 1}).count() == 0
    roots = spark.range(5000).select(F.col("id").alias("root"), (F.col("id") % 9 + 1).alias("size"))
    got = {x["split"]: x["count"] for x in groupsplit.deal_roots(roots, {"train": 0.8, "validation": 0.1, "test": 0.1}).groupBy("split").count().collect()}
    assert abs(got["train"] - 4000) <= 40 and abs(got["test"] - 500) <= 40


# 3 --------------------------------------------------------------------------------------------


def test_percentiles(spark):
    rnd = random.Random(3)
    values = [("a", rnd.choice([0.0, 0.0, 0.1, rnd.expovariate(1), 1e300, 1e-300])) for _ in range(400)] + [("b", 5.0)] * 7 + [(None, -1.0 * i) for i in range(20)] + [("a", float("nan")), ("a", None), ("b", float("inf"))]
    df = percentiles.measurements(spark.createDataFrame(values, "g string, x double"), "x", negative=True)
    probs = [0.0, 0.5, 0.9, 0.95, 1.0]
    got = {(r.g, r.p): (r.n, r.value) for r in percentiles.exact_percentiles(percentiles.counted_values(df, ["g"], "x"), ["g"], probs).collect()}
    for g in ("a", "b", None):
        v = sorted(x for k, x in values if k == g and x is not None and np.isfinite(x))
        for p in probs:
            assert got[g, p] == (len(v), v[max(1, int(np.ceil(p * len(v)))) - 1])
    days = percentiles.ledger(df.withColumn("day", F.monotonically_increasing_id() % 5), ["day", "g"], "x")
    for r in percentiles.ledger_percentiles(percentiles.merge_ledgers(days, ["g"]), ["g"], probs).collect():
        true = got[r.g, r.p][1]
        assert abs(r.value - true) <= r.error_bound * 1.000001 + 1e-300 and r.error_bound <= abs(true) / 2**percentiles.BITS + 1e-18
    empty = percentiles.counted_values(df.limit(0), ["g"], "x")
    assert percentiles.exact_percentiles(empty, ["g"], probs).count() == 0
    assert percentiles.measurements(spark.createDataFrame([(1, 1.0), (1, 1.0)], "k int, x double"), "x", "k").count() == 1


# 4 --------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def pair_model(spark, data):
    valid = pairs.valid_sources(spark.read.parquet(f"{data}/partial_regions.parquet"))
    return pairs.train_pairs(valid, spark.read.parquet(f"{data}/documents.parquet"))


def test_pair_defects(pair_model):
    s, t = "古い駅の壊れた石板は63個だった。格納庫で灯台守が最後の鍵を磨いた。", "旧车站的坏掉的石板共有63个。灯塔看守在机库擦亮了最后一个钥匙。"
    canon = lambda x: canonical.canonical_array(pa.array([x])).to_pylist()[0]
    of = lambda a, source=s: pair_model.defect(canon(source), canon(a))
    assert of(t) is None and of(t[:-1]) is None
    assert of("") == of("……") == of("​") == "empty"
    assert of(s) == "copy" and of("No.31", "No.31") is None
    assert of("I'm sorry, but I can't translate this text.") == "refusal" and of("抱歉，我无法翻译这段内容。") == "refusal"
    assert of("The stone tablet of the old station was broken.") == "wrong_language" and of("전학생은 낡은 역에서 부서진 거울을 태웠다.") == "wrong_language"
    assert of(t[:6]) == "truncated"
    assert of("……", "……") is None


def test_pair_held_out_accuracy(spark, data, pair_model):
    rows = [(r.source_text, r.translated_text) for r in pairs.valid_sources(spark.read.parquet(f"{data}/partial_regions.parquet")).where("source_text is not null and translated_text is not null").collect()]
    canon = lambda x: canonical.canonical_array(pa.array(x, pa.string())).to_pylist()
    s, a = canon([r[0] for r in rows]), canon([r[1] for r in rows])
    assert sum(pair_model.defect(x, y) is not None for x, y in zip(s, a)) <= 0.05 * len(rows)


def test_pair_unseen_refusals(spark, data):
    """Refusals of words that no training refusal has."""
    rows = [(r.source_text, r.translated_text) for r in pairs.valid_sources(spark.read.parquet(f"{data.replace('0.001', '0.01')}/partial_regions.parquet")).where("source_text is not null and translated_text is not null").collect()]
    model = pairs.fit_pairs(rows, [], 0)
    rng = np.random.default_rng(5)
    told = [pairs.refusal(rng, 1) for _ in range(400)]
    canon = lambda x: canonical.canonical_array(pa.array(x, pa.string())).to_pylist()
    k = model.defects(canon([rows[i % len(rows)][0] for i in range(400)]), [t.lower() for t in canon(told)])
    found = (k == pairs.DEFECTS.index("refusal")).mean()
    print("unseen refusals found", found, "flagged", (k >= 0).mean())
    assert found >= 0.3 and (k >= 0).mean() >= 0.6
    alone = pairs.pair_features(["あい", "か"], ["啊", "n/a"], model.length)
    for i, pair in enumerate((("あい", "啊"), ("か", "n/a"))):
        b, _ = pairs.pair_features([pair[0]], [pair[1]], model.length)
        assert b.tolist() == alone[0][alone[1] == i].tolist()


def test_pairs_with_nulls(spark, pair_model):
    valid = spark.createDataFrame([("r", "あ。", "啊。"), ("n", None, None)], "region_key string, source_text string, translated_text string")
    a = spark.createDataFrame([("t", 1, "r", None), ("t", 1, "r", None), ("t", 2, None, "x"), ("t", 3, "n", "x"), ("t", 4, "zz", "x")], "pair_table string, candidate_row long, region_id string, answer string")
    assert [tuple(r) for r in pairs.judged_pairs(a, valid, pair_model).collect()] == [("t", 1, "empty")]
    assert pairs.judged_pairs(a.limit(0), valid, pair_model).count() == 0
    assert pairs.fit_pairs([], []).thresholds.tolist() == [1.0] * 6


# 6 --------------------------------------------------------------------------------------------


def canon(*texts, **kw):
    return canonical.canonical_array(pa.array(texts, pa.string()), **kw).to_pylist()


@pytest.mark.parametrize("a,b", [("ﾊﾞﾅﾅ", "バナナ"), ("が", "が"), ("a​b", "a b"), ("⽇本", "日本"), ("エ", "工"), ("ー", "一"), ("Ｎｏ．３", "No.3"), ("ベ", "べ"), ("…", "⋯"), ("a\r\nb", "ab"), ("Νο", "No"), ("见️", "见")])
def test_same_shapes(a, b):
    assert canon(a) == canon(b)


@pytest.mark.parametrize("a,b", [("っ", "つ"), ("シ", "ツ"), ("は", "ば"), ("い", "り"), ("ああ", "あ"), ("ケ", "ク"), ("。", "、"), ("a", "A")])
def test_different_letters(a, b):
    assert canon(a) != canon(b)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(st.characters(codec="utf-8"), max_size=30)), max_size=8))
def test_canonical_properties(texts):
    got = canon(*texts)
    assert canon(*got) == got
    assert got == [canon(t)[0] for t in texts]
    assert [None if t is None else canon(unicodedata.normalize("NFC", t))[0] for t in texts] == got
    spaced = canon(*texts, keep_space=True)
    assert [None if t is None else t.replace(" ", "") for t in spaced] == [None if t is None else t for t in got]


def test_same_reading(spark):
    r = spark.createDataFrame([("t", 1, "a", "ﾊﾅ"), ("t", 1, "a", "ﾊﾅ"), ("t", 2, "a", "ハナ"), ("t", 3, "a", None), ("t", 4, None, "ﾊﾅ"), ("t", 5, "b", "x"), ("t", 6, "a", "ハナナ")], "text_table string, candidate_row long, region_id string, text string")
    e = spark.createDataFrame([("a", "ハナ"), ("a", "ハナ"), ("b", None)], "region_id string, expected string")
    assert rows_of(canonical.same_reading(r, e)) == [(1, "t")]
    assert canonical.same_reading(r.limit(0), e).count() == 0
    assert canonical.canonical_texts(r, "text", "text_table").columns == ["text_table", "candidate_row", "region_id", "text"]


# 7 --------------------------------------------------------------------------------------------


def test_packing(spark):
    rnd = random.Random(7)
    sizes = [(i, rnd.choice([0, 1, 30, 300, 700, 1500, 2048, 2049, 5000])) for i in range(800)]
    items = packing.items_of(spark.createDataFrame(sizes, "doc_id long, tokens long")).cache()
    p = packing.pack(items).cache()
    assert rows_of(p.select("doc_id", "piece", "token_start", "size")) == rows_of(items)
    assert p.groupBy("container_id").agg(F.sum("size").alias("n")).where("n > 2048").count() == 0
    assert {r.doc_id for r in packing.over_capacity(p).collect()} == {i for i, n in sizes if n > 2048}
    for i, n in sizes[:40]:
        parts = sorted((r.token_start, r.size) for r in p.where(f"doc_id = {i}").collect()) if n > 2048 else None
        assert parts is None or (parts[0][0] == 0 and all(a + b == c for (a, b), (c, _) in zip(parts, parts[1:])) and sum(b for _, b in parts) == n)
    assert packing.pack(items.limit(0)).count() == 0


def test_packing_beats_first_fit():
    rng = np.random.default_rng(1)
    sizes = rng.integers(200, 900, 300)
    best = packing.breed(sizes, 2048, 1, [])
    first: list[int] = []
    for s in sizes:
        at = next((i for i, x in enumerate(first) if x + s <= 2048), None)
        first.append(int(s)) if at is None else first.__setitem__(at, first[at] + int(s))
    assert np.bincount(best, weights=sizes).max() <= 2048 and best.max() + 1 <= len(first)
    a, b = packing.breed(sizes, 2048, 2, []), packing.breed(sizes, 2048, 3, [])
    child = packing.crossover(a, b, sizes, 2048, rng)
    assert len(child) == 300 and np.bincount(child, weights=sizes).max() <= 2048


def test_token_sizes(spark):
    df = spark.createDataFrame([(1, "hello world", "x"), (1, "hello world", "x"), (2, None, "x"), (3, "", "x"), (4, "あ" * 50_000, "x"), (None, "a", "x")], "doc_id long, text string, tokens string")
    for name in ("byte_bpe_multi_50k.tiktoken", "byte_bpe_50k.json", "piece_bpe_32k.model"):
        got = {r.doc_id: r.tokens for r in packing.token_sizes(df, packing.tokenizer_path(name)).collect()}
        assert set(got) == {1, 2, 3, 4} and got[2] == got[3] == 0 and 2 <= got[1] <= 4 and got[4] > 2048


# 8 --------------------------------------------------------------------------------------------

WORDS = "the council keeper pale lantern harbour stole repaired behind secret copper engine winter river quiet market seven bridges stone".split()


def test_leaks(spark):
    rnd = random.Random(8)
    sentence = lambda n: " ".join(rnd.choice(WORDS) + str(rnd.randrange(50)) for _ in range(n))
    items = [(i, sentence(30)) for i in range(20)] + [(90, None), (91, ""), (92, "！？")]
    docs, truth = [], set()
    for d in range(120):
        body = [sentence(20), sentence(20)]
        k = d % 20
        words = items[k][1].split()
        if d % 3 == 0:
            body.insert(1, " ".join(words).upper())
            truth.add((k, d))
        elif d % 3 == 1:
            part = words[5:21]
            part[7] = "altered"
            body.insert(1, "\nMara: " + " ".join(part[:9]) + ",\nJo： " + "  ".join(part[9:]))
            truth.add((k, d))
        else:
            body.insert(1, " ".join(words[:6]))
        docs.append((d, "\n".join(body), 0))
    docs += [(500, None, 0), (501, "", 0), (0, docs[0][1], 0)]
    df, it = spark.createDataFrame(docs, "doc_id long, text string, item_id int"), spark.createDataFrame(items, "item_id long, item_text string")
    assert {(r.item_id, r.doc_id) for r in leakage.leaked_items(df, it).collect()} == truth
    assert leakage.leaked_items(df, it.limit(0)).count() == 0 and leakage.leaked_items(df.limit(0), it).count() == 0


def test_leaks_of_short_and_spoken_items(spark):
    items = spark.createDataFrame([(1, "Paris shone"), (2, "花が咲く"), (3, "Q: who?\nA: Tom Bowling\nQ: when?\nA: on the eve of the battle\nQ: where did the apothecary go?")], "item_id long, item_text string")
    docs = spark.createDataFrame([(1, "At night PARIS  shone again."), (2, "庭に花が、咲くころ。"), (3, "Notes.\nQ: who?\nA: Tom Bowling\nQ: when?\nA: on the eve of the battle\nQ: where did the apothecary go?\nEnd."), (4, "Paris was shown; 花は咲く。")], "doc_id long, text string")
    assert {(r.item_id, r.doc_id) for r in leakage.leaked_items(docs, items).collect()} == {(1, 1), (2, 2), (3, 3)}


def test_leaks_in_blocks(spark, data, monkeypatch):
    d, i = spark.read.parquet(f"{data}/documents.parquet"), spark.read.parquet(f"{data}/eval_items.parquet")
    whole = rows_of(leakage.leaked_items(d, i))
    monkeypatch.setattr(leakage, "BLOCK_CHARS", 20_000)
    assert rows_of(leakage.leaked_items(d, i)) == whole


# 9 --------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def moderator(spark, data):
    return moderation.train_moderator(spark.read.parquet(f"{data}/labelled_texts.parquet"), spark.read.parquet(f"{data}/documents.parquet"))


def test_moderation_accuracy(spark, data, moderator):
    rows = spark.read.parquet(f"{data}/labelled_texts.parquet").collect()
    scores = moderator.score(pa.array([r.sample_text for r in rows], pa.string()))
    for c, name in enumerate(moderation.CATEGORIES):
        hit = scores[:, c] >= moderator.thresholds[c]
        truth = np.array([r[name] > 0 for r in rows])
        assert (hit & truth).sum() >= 0.85 * truth.sum() and (hit & ~truth).sum() <= 0.1 * truth.sum() + 2


def test_moderation_disguises(moderator):
    plain = moderation.sentences(pa.array(["You l o s e r. Bad L0$3R! ク​ズ・だ"]))[0]
    assert any("loser" in p for p in plain) and any("クズ" in p for p in plain)


def test_moderation_edges(spark, moderator):
    df = spark.createDataFrame([(1, None, None), (2, "", "s"), (3, " \n", "s"), (4, "The sign was drawn well.", None), (4, "The sign was drawn well.", None)], "doc_id long, text string, source string").withColumn("abusive", F.lit("clash"))
    s = moderation.score_documents(df, moderator)
    assert s.count() == 5 and s.where("is_abusive or is_hateful or is_sexual").count() == 0
    assert {r.source: r.documents for r in moderation.source_rates(s).collect()} == {None: 3, "s": 2}
    assert moderation.flagged_documents(s.limit(0)).count() == 0
    none = moderation.fit_moderator([None, "a"], np.zeros((2, 3)))
    assert none.score(pa.array(["a", None])).max() <= 1 and none.thresholds == (2.0,) * 3


def test_moderation_frequent_abuse(spark, data):
    """A source with a third of all rows doesn't make its abuse common wording."""
    labelled = spark.read.parquet(f"{data}/labelled_texts.parquet")
    documents = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "source", "text").where("text is not null")
    abuse = ["You are a worthless piece of trash and everybody here knows it.", "Shut your mouth, you braindead idiot.", "你这个没用的废物，滚出去。", "黙れ、このクズ野郎。"]
    n = documents.count()
    loud = spark.createDataFrame([(10**9 + i, "loud", f"Page {i} is done. {abuse[i % 4]}") for i in range(n // 2)], "doc_id long, source string, text string")
    model = moderation.train_moderator(labelled, documents.unionByName(loud))
    scores = model.score(pa.array(abuse, pa.string()))[:, 0]
    assert (scores >= model.thresholds[0]).all(), scores


def test_moderation_held_out_wordings(spark, data):
    """Wordings that no training text shows are found by their rare n-grams and those they share."""
    held = ["vermin and should", "crawl back under", "did not stop until he came", "undid his trousers", "ネズミ", "人間以下", "果てるまで", "死ねよ", "赶进海里", "没见过像你", "骑到丈夫"]
    rows = spark.read.parquet(f"{data}/labelled_texts.parquet").where("sample_text is not null").orderBy("label_id").collect()
    unseen = np.array([any(h in r.sample_text.lower() for h in held) for r in rows])
    labels = np.array([[r[c] for c in moderation.CATEGORIES] for r in rows])
    larger = data.replace("0.001", "0.01")
    documents = spark.read.parquet(f"{larger}/documents.parquet")
    rarity = moderation.corpus_rarity(documents)
    keep = np.flatnonzero(~unseen)
    model = moderation.fit_moderator([rows[i].sample_text for i in keep], labels[keep], rarity)
    told = np.flatnonzero(unseen & labels.any(1))
    scores = model.score(pa.array([rows[i].sample_text for i in told], pa.string())).max(1)
    corpus = moderation.sentences(pa.array([r.text for r in documents.select("text").collect()], pa.string()))[0]
    usual = np.quantile(1 - moderation._sentence_scores(model.table, corpus)[:, 0], 0.98)
    assert len(told) > 20 and (scores >= usual).mean() >= 0.8, (usual, sorted(scores)[:10])


def test_moderation_threshold_and_trimming():
    assert moderation.bulk_end({-12: 90_000, -11: 9_000, -10: 900, -9: 90, -8: 80, -5: 60}) == -8
    assert moderation.bulk_end({-12: 20}) is None and moderation.bulk_end({}) is None
    counts = np.ones((4, moderation.BUCKETS), np.int64)
    counts[2, 5] = 10_000
    f = moderation.trimmed_frequency(counts, np.array([10, 10, 10_000, 10]))
    assert f[5] == 3 / 30 and not moderation.trimmed_frequency(counts * 0, np.zeros(4)).any()


def test_moderation_finds_speak_for_their_wording(spark):
    """Of a wording that is mostly found the rest is found too; short names that stand in harmless sentences everywhere are not."""
    names = [f"{a}{b}{c}" for a in ("ka", "ri", "to", "mu") for b in ("be", "fi", "no") for c in ("zo", "ya")]
    said = [(f"the quarrelsome grobs ought to vanish {n}", some) for n, some in zip(names * 2, [0.4] * 36 + [0.08] * 12)] + [(n, 0.2) for n in names]
    harmless = [f"{n} {verb} the lantern" for n in names for verb in ("lit", "sold", "found", "carried") for _ in range(5)]
    count = moderation.count_grams([s for s, _ in said] + harmless) + 20_000 * moderation.count_grams(["before dawn they rowed past a quiet harbour"])
    rarity = moderation.Rarity.of(count / (len(said) + len(harmless) + 20_000), count)
    rows = [(i, "s", 0.0, 0.0, 0.0, [-8], [(s, 1 - some, 0.8 * some, 0.1 * some, 0.1 * some)]) for i, (s, some) in enumerate(said)]
    found = spark.createDataFrame(rows, "doc_id long, source string, abusive double, hateful double, sexual double, bins array<tinyint>, " + moderation._FINDS)
    model = moderation.settled(found, moderation.Moderator(np.zeros((moderation.BUCKETS + 1, 4), np.float32), rarity, 0.15))
    assert rows_of(moderation.flagged_documents(moderation.judged_documents(found, model)), ["doc_id", "category"]) == sorted(((i, "abusive") for i in range(48)), key=repr)


def test_moderation_minor_categories():
    """However sure a sentence is, a category that holds little of it isn't flagged."""
    model = moderation.Moderator(np.zeros((moderation.BUCKETS + 1, 4), np.float32), moderation.Rarity.of(np.zeros(moderation.BUCKETS), np.zeros(moderation.BUCKETS)), 0.15)
    scores = model.given(["a"], np.array([[0.02, 0.7, 0.2, 0.08]]))
    assert (scores >= model.threshold).tolist() == [[True, False, False]]
