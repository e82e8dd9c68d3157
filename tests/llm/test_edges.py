"""Nulls, empty and very long texts, ties and repeated rows, empty tables and clashing column names, for each operator and stage."""

import random
import zlib

import corpus_pipeline as pipeline
import numpy as np
import pytest
from brute import conversation, dedup, near, targets, token_rows, toxic_chain, vectors
from pyspark.sql import functions as F

from strandspark.llm import chat, exact_dedup, html, mixing, packing, sharding, simhash, token_files, toxicity
from strandspark.llm import vectors as vec
from strandspark.llm._graph import components
from strandspark.llm._shared import fresh_dir, list_names

#: Names that operators might use themselves.
CLASH = ["size", "taken", "target", "count", "n", "key", "block", "ids", "bucket", "digest", "norm", "h", "fp", "node", "component", "batch", "shard", "a", "b", "path", "tokens", "toxic", "rows"]
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def rows():
    r = random.Random(3)
    long = " ".join("w%d" % r.randrange(5000) for _ in range(60000))
    base = " ".join("v%d" % r.randrange(300) for _ in range(200))
    out = [(1, "", "en", "s1", 0), (2, None, None, None, None), (3, " \n\t ", "en", "s1", 4), (4, "One", "en", None, 3), (5, "one two", "en", "s2", 7), (6, "a b  c", "en", "s2", 6), (7, "a b\tc", "en", "s2", 5), (9, long, "en", "s3", len(long)), (10, base, "en", "s1", 1), (11, base + " x", "en", "s1", 1), (12, base, "en", "s1", 1), (13, "a" * 5000 + " <|endoftext|> don't ΣΑΣ.", "en", "s2", 2)]
    return out + [(100 + i, " ".join("u%d" % r.randrange(50) for _ in range(r.randrange(1, 30))), "en", "s%d" % (i % 3), 1) for i in range(40)]


@pytest.fixture(scope="module")
def docs(spark):
    df = spark.createDataFrame(rows(), SCHEMA)
    return df.withColumns({c: F.lit(i) for i, c in enumerate(CLASH)})


@pytest.fixture(scope="module")
def twice(docs):
    """With a null id and a row repeated."""
    return docs.unionByName(docs.where("doc_id IN (5, 10)")).unionByName(docs.where("doc_id = 4").withColumn("doc_id", F.lit(None).cast("bigint")))


@pytest.fixture(scope="module")
def none(docs):
    return docs.where("false")


def data():
    return [(r[0], r[1]) for r in rows()]


def test_mix(docs, twice, none):
    got = mixing.mix(docs).collect()
    sizes = {}
    for d, t, _, s, _ in rows():
        sizes[s] = sizes.get(s, 0) + len((t or "").split())
    want, taken = targets(sizes), {}
    for r in got:
        assert r["target"] == pytest.approx(want[r["source"]]) and r["taken"] <= 3 * r["size"]
        taken[r["source"]] = taken.get(r["source"], 0) + r["taken"]
    assert all(abs(taken[s] - want[s]) <= 1 for s in want)
    mixed = mixing.mix_documents(docs)
    assert mixed.columns == docs.columns
    words = {}
    for r in mixed.collect():
        words[r["doc_id"]] = words.get(r["doc_id"], 0) + len((r["text"] or "").split())
    assert {d: n for d, n in words.items() if n} == {r["doc_id"]: r["taken"] for r in got if r["taken"]}
    assert mixing.mix(twice).count() == twice.count() and mixing.mix_documents(twice).count() > 0
    assert mixing.mix(none).count() == 0 and mixing.mix_documents(none).count() == 0
    assert mixing.mix(docs.where("doc_id <= 3")).agg(F.sum("taken")).first()[0] == 0


PAGES = [
    (None, "", 0), ("", "", 0), ("   ", "", 0), ("plain words", None, None), ("<p>unclosed <b>bold<p>next &amp; last", None, None), ("<div", "", 0), ("<article><p>" + "word " * 50000, None, None),
    ("<html><body><nav><ul><li><a href=x>Home</a></li></ul></nav><article><h1>Title of it</h1><p>First\n  block &lt;here&gt; with words enough.</p><div class='ad'>Buy now</div><p>Second<br>block of some words.</p></article><div class='comments'><p>I liked reading this one.</p></div><footer>&copy; me</footer></body></html>", "Title of it\nFirst block <here> with words enough.\nSecond block of some words.", None),
]


def test_html(spark):
    df = spark.createDataFrame([(i if i else None, None if i == 1 else "u", h) for i, (h, _, _) in enumerate(PAGES)], "page_id bigint, url string, html string").withColumn("text", F.lit(1)).withColumn("n_chars", F.lit("x"))
    got = {r["page_id"]: r for r in html.extract(df).collect()}
    assert len(got) == len(PAGES)
    for i, (_, want, _) in enumerate(PAGES):
        r = got[i if i else None]
        assert r["n_chars"] == len(r["text"]) and (want is None or r["text"] == want)
    assert html.extract(df.where("false")).count() == 0 and html.extract(df.union(df)).count() == 2 * len(PAGES)


def test_html_stray_quotes():
    """A quote opens a string only where a value starts; elsewhere the tag ends at the first >."""
    text = lambda s: " ".join(html.Page(s).strings()).split()
    for tag in ('<p class="x"">', '<p class=foo">', "<p title=it's>", '<p "x>', '<p a=b="c>', "<p class='x''>", '<p class="x"y="z">', '<p a = ">" b=\'>"\'>', '<p title="a>b"/>', '<p a=>', '<p a="x>'):
        tail = "" if tag.endswith('="x>') else '<p id="last">three</p>'
        assert text(f"<div>one</div>{tag}two</p>{tail}") == ["one", "two"] + (["three"] if tail else []), tag
    assert text('<div>one</div><p title="cut off') == ["one"]


def test_html_held_out():
    """Accuracy on pages that the trees have not seen, and decoding without contradictions."""
    r, right, wrong = random.Random(77), 0, 0
    for _ in range(150):
        page = html.training_page(r)
        every = [w for s in html.Page(page).strings() for w in s.split()]
        got = html.extract_all([page])[0].split()
        good = sum(w[0] in "mM" for w in got)
        right += good
        wrong += len(got) - good + sum(w[0] in "mM" for w in every) - good
    assert right > 50 * wrong
    kept = html.decode([-1, 0, 1, 1, 0], np.array([10.0, 6, 3, 3, 4]), np.array([0.0, 5, -1, 5, -5]))
    assert kept.tolist() in ([False, True, True, True, False], [False, False, False, True, False])


def test_chat(spark):
    table = [(1, 0, "user", "a\\0 <s>[INST]x"), (1, 1, "assistant", "</s>\\1[/INST] ok"), (1, 1, "assistant", None), (1, 2, None, "é"), (None, 0, "assistant", "n"), (None, None, "user", "m"), (2, 5, "assistant", ""), (3, 0, "user", "x" * 20000)]
    table += [(4, i, "assistant" if i % 2 else "user", f"t{i}") for i in range(70)]
    df = spark.createDataFrame(table, "conv_id bigint, turn bigint, role string, text string").withColumns({c: F.lit(1) for c in ("node", "tree", "leaf", "up", "score")})
    by = {}
    for c, t, r, x in table:
        by.setdefault(c, []).append((-1 if t is None else t, r or "", x or ""))
    got = {r["conv_id"]: r for r in chat.conversation_digests(df).collect()}
    assert got.keys() == by.keys()
    for c, turns in by.items():
        r = got[c]
        assert (r["n_turns"], r["turns_sha256"], r["loss_chars"], r["loss_sha256"]) == conversation(turns)
    assert chat.conversation_digests(df.where("false")).count() == 0


def test_chat_branches(spark):
    tree = [(1, 1, None, "user", "q", 0.0), (1, 2, 1, "assistant", "bad", 0.1), (1, 3, 1, "assistant", "good", 0.9), (1, 4, 3, "user", "more", 0.5), (2, 1, 9, "user", "lone", 1.0)]
    df = spark.createDataFrame(tree, "tree bigint, node bigint, parent bigint, role string, text string, score double")
    got = {(r["tree"], r["branch_rank"]): r["formatted"] for r in chat.format_trees(df, top=2).collect()}
    assert got[(1, 1)] == "<s>[INST]user[/INST]q</s>[INST]assistant[/INST]good</s>[INST]user[/INST]more</s>"
    assert got[(1, 2)].endswith("bad</s>") and got[(2, 1)] == "<s>[INST]user[/INST]lone</s>" and len(got) == 3
    twice = df.unionByName(df).unionByName(df.where("node = 3").withColumn("text", F.lit("later"))).unionByName(df.limit(1).withColumn("node", F.lit(None).cast("bigint")))
    assert {(r["tree"], r["branch_rank"]): r["formatted"] for r in chat.format_trees(twice, top=2).collect()} == got
    loop = spark.createDataFrame([(1, 1, 2, "u", "x", 0.0), (1, 2, 1, "u", "y", 0.0)], df.schema)
    with pytest.raises(ValueError, match="cycle"):
        chat.format_trees(loop)


def test_packing(docs, twice, none):
    _, ids = token_rows(data())
    at = {}
    for p in sorted(packing.pack(docs).collect(), key=lambda p: (p["doc_id"], p["start"])):
        assert p["start"] == at.get(p["doc_id"], 0)
        assert np.frombuffer(bytes(p["ids"]), "<u4").tolist() == ids[p["doc_id"]][p["start"] : p["start"] + p["length"]]
        at[p["doc_id"]] = p["start"] + p["length"]
    assert at == {d: len(x) for d, x in ids.items()}
    total = packing.pack_digests(twice).agg(F.sum("length")).first()[0]
    assert total == sum(map(len, ids.values())) + len(ids[5]) + len(ids[10]) + len(ids[4])
    assert packing.pack(none).count() == 0


def test_html_tags_as_in_html():
    page = "<html><body><article><h1>Title</h1><p>First words of the story here.</p>{}<p>Second paragraph of the text.</p></article></body></html>"
    plain = "Title\nFirst words of the story here.\n{}Second paragraph of the text."
    for part in ("<script src=https://cdn.example/lib/>var secret = 1;</script>", "<script src='x.js'/>var secret = 1;</script>", "<style/>p {}</style>", "<svg width='1'/>", "<svg><text>x</text></svg>", "<!-- x > y -->", "<!-- a --!>", "</3 a>", "</>", "<?php x ?>"):
        assert html.extract_all([page.format(part)]) == [plain.format("")], part
    for part, text in (("<!--><p>Between the two of them.</p><!-- x -->", "Between the two of them."), ("<!---><p>Between the two of them.</p>", "Between the two of them."), ("<div/>Between the two of them.</div>", "Between the two of them."), ("<p>Between <a name=x/>the two</a> of them.", "Between the two of them.")):
        assert html.extract_all([page.format(part)]) == [plain.format(text + "\n")], part


def test_html_deep_nesting():
    import time

    n = 100_000
    for page in ("<div>" * n + "some words here", "<div>" * n + "</section>" * n, "<ul>" + "<div>" * n + "<li></li>" * 1000, "<a href=x><div>" + "<b>" * n + "</a>" * n):
        began = time.process_time()
        html.Page(page)
        assert time.process_time() - began < 2


def test_differencing():
    r = random.Random(5)
    for _ in range(60):
        n, k = r.randrange(1, 60), r.randrange(1, 12)
        sizes = [r.randrange(1, 100) for _ in range(n)]
        groups = packing.differencing(sizes, k)
        assert sorted(i for g in groups for i in g) == list(range(n)) and len(groups) <= k
        sums = [sum(sizes[i] for i in g) for g in groups] + [0] * (k - len(groups))
        assert max(sums) - min(sums) <= max(sizes)
        windows = packing.pack_block(sizes, 64)
        joined = [packing._joined(w) for w in windows]
        assert joined == windows
        assert all(sum(p[2] for p in w) <= 64 for w in windows)
        assert sorted((d, x) for w in windows for d, s, m in w for x in range(s, s + m)) == [(d, x) for d, m in enumerate(sizes) for x in range(m)]


def test_every_window_is_of_a_differencing(monkeypatch):
    """In distributions where the least count never fits: what is packed is what the last differencing returned."""
    r = np.random.default_rng(6)
    made, real = [], packing.differencing

    def noted(sizes, k):
        got = real(sizes, k)
        made.append(sorted(sum(sizes[i] for i in g) for g in got if g))
        assert len(got) <= k
        return got

    monkeypatch.setattr(packing, "differencing", noted)
    for lengths in (r.integers(900, 2000, 1500), np.exp(r.normal(6, 1.2, 2000)).astype(int) + 1, r.integers(20, 400, 4000), np.full(900, 1500), r.integers(2, 5, 3000), r.integers(1020, 1100, 1200)):
        made.clear()
        windows = packing.pack_block(lengths.tolist(), 2048)
        full = sum(int(n) // 2048 for n in lengths)
        assert made[-1] == sorted(sum(p[2] for p in w) for w in windows[full:]) and max(made[-1]) <= 2048
        assert sum(p[2] for w in windows for p in w) == lengths.sum()
        assert len(windows) * 2048 <= 1.02 * lengths.sum() + 2 * 2048


def test_tokens_against_the_library():
    """Random strings of characters that normalise, combine, lower-case or divide in unusual ways."""
    import pyarrow as pa

    from strandspark.llm import tokens

    enc, r = tokens.encoder(tokens.default_vocabulary()), random.Random(9)
    marks = ["\x1c", "\x1d", "\x1e", "\x1f", "\x85", "\xa0", "\u2028", "\u3000", "\n", "\t", "\r", "\x0b", "\x0c", "\u0300", "\u0301", "\u0307", "\u030c", "\u0338", "\u0345", "\u03a3", "\u03c2", "\u212b", "\u1e9e", "\ufb01", "\uac00", "\u1100", "\u1161", "\u11a8", "\U0001f600", "\u200d", "<|", "|>", "<|endoftext|>", "<|ENDOFTEXT|>", "'s", "'S", "\u0483", "\u0416", "\u0663", "\u2167", "\x00", "\ufeff"]
    parts = [*"abcXYJK\xe9\xc9\xdf\u0130\u0149\u01f0.,.,  '!?-_09=<>", *marks]
    texts = ["".join(r.choice(parts) for _ in range(r.randrange(15))) for _ in range(100_000)] + ["a" * 300 + " b", None, "\x1c,", "word\x1c, a", "J\u030c. K"]
    want = [np.array(e.ids, "<u2").tobytes() for e in enc.tokenizer.encode_batch_fast([t or "" for t in texts], add_special_tokens=False)]
    got = [x for _, ids in enc.encode_array(pa.array(texts), None) for x in ids.to_pylist()]
    assert got == want
    assert [x for _, ids in enc.encode_array(pa.array(texts[-5:]), 1) for x in ids.to_pylist()] == [x + b"\x01\x00" for x in want[-5:]]


def test_vectors(spark):
    r = random.Random(8)
    base = [[r.gauss(0, 1) for _ in range(16)] for _ in range(150)]
    table = [(i, v) for i, v in enumerate(base)] + [(200 + i, [x + r.gauss(0, 0.05) for x in base[i % 40]]) for i in range(120)] + [(400 + i, base[7]) for i in range(30)]
    table += [(500, None), (501, []), (502, [0.0] * 16), (503, [1.0, None] + [0.0] * 14), (504, [float("nan")] * 16), (505, [float("inf")] + [0.0] * 15), (506, [1.0, 2.0]), (507, [2.0, 4.0]), (7, base[7]), (None, base[9]), (508, [-2 * x for x in base[3]]), (509, [3 * x for x in base[3]])]
    df = spark.createDataFrame(table, "vec_id bigint, embedding array<double>").withColumns({c: F.lit(1) for c in ("label", "v", "class", "shard", "dim", "rep")})
    assert sorted(map(str, (tuple(r) for r in vec.near_vectors(df).collect()))) == sorted(map(str, vectors(table)))
    assert vec.near_vectors(df.where("false")).count() == 0


def test_vector_clusters(spark):
    """Clusters narrower and wider than a node's reach, one of them most of the table, against all pairs; the recall of
    links is measured and at least 0.99."""
    r = np.random.default_rng(4)
    parts = [r.normal(size=(1500, 24))]
    for noise, n in ((0.02, 900), (0.15, 250), (0.3, 400), (0.5, 200)):
        c = r.normal(size=24)
        parts.append(c / np.linalg.norm(c) + noise * r.normal(size=(n, 24)) / np.sqrt(24))
    x = np.concatenate(parts)
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    want = ((unit @ unit.T) >= 0.95).sum(axis=1) - 1
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id bigint, embedding array<double>")
    got = {r["vec_id"]: r["n_links"] for r in vec.near_vectors(df).collect()}
    found = np.array([got[i] for i in range(len(x))])
    assert (found <= want).all() and found.sum() >= 0.99 * want.sum()
    assert (found[:1500] == want[:1500]).all()
    shards = vec.build_shards(df)[2].select("shard", "ef", "recall", "nodes").distinct().collect()
    assert len(shards) == vec.SHARDS and all(s["recall"] >= vec.RECALL for s in shards) and sum(s["nodes"] for s in shards) < 2700


def test_large_group_pairs(monkeypatch):
    """Groups that neither lie wholly within nor wholly beyond the threshold are compared member by member, in blocks."""
    r = np.random.default_rng(5)
    c, d = r.normal(size=(2, 16))
    d -= (d @ c) * c / (c @ c)
    c, d = c / np.linalg.norm(c), d / np.linalg.norm(d)
    far = np.cos(0.3) * c + np.sin(0.3) * d
    x = vec._unit(np.concatenate([v + 0.05 * r.normal(size=(700, 16)) / 4 for v in (c, far)]))
    want = (x @ x.T >= 0.95).sum(axis=1) - 1
    for pairs in (1 << 19, 1 << 10):
        monkeypatch.setattr(vec, "PAIRS", pairs)
        s = vec.Shard(x, np.ones(len(x), np.int64), np.arange(len(x)), 0.95)
        assert len(s.start) - 1 < 20
        total, forest = vec.links(s, 0, len(s.start) - 1, s, True)
        assert (total[np.argsort(s.key)] == want).all() and len(forest) == len(s.start) - 2


def test_toxicity(spark, docs, twice, none):
    r = random.Random(2)
    word = lambda: "word%d" % r.randrange(400)
    bad = ["vilem", "grubst", "snarkle"]
    table, labels = [], []
    for i in range(400):
        toxic = i % 4 == 0
        t = [word() for _ in range(30)] + ([r.choice(bad) + r.choice(["", "er", "est"]) for _ in range(2)] if toxic else [])
        r.shuffle(t)
        table.append((i, " ".join(t), "en", "s", 1))
        if i < 300:
            labels.append((i, int(i % 3 > 0), int(toxic)))
    table += [(900, None, None, None, None), (901, "", None, None, None)]
    labels += [(None, 1, 1), (5000, None, 1), (4, None, None)]
    d, lab = spark.createDataFrame(table, SCHEMA).withColumns({c: F.lit(1) for c in CLASH}), spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")
    got = {r["doc_id"]: r["rejected"] for r in toxicity.score_documents(d, lab).collect()}
    assert len(got) == len(table)
    assert all(got[i] == (i % 4 == 0) for i in range(300, 400)) and not got[900] and not got[901]
    want = toxic_chain([(r[0], r[1]) for r in table], [x for x in labels if x[0] is not None and x[2] is not None])
    for r in toxicity.score_documents(d, lab).collect():
        assert tuple(r)[1:4] == pytest.approx(want[r["doc_id"]][:3], abs=1e-5) and r["rejected"] == want[r["doc_id"]][3]
    again = toxicity.score_documents(d.unionByName(d), lab.unionByName(lab)).collect()
    assert len(again) == 2 * len(table) and all(r["rejected"] == got[r["doc_id"]] for r in again)
    kept = toxicity.drop_toxic(d, lab)
    assert kept.columns == d.columns and sorted(r["doc_id"] for r in kept.collect()) == sorted(i for i in got if not got[i])
    assert toxicity.drop_toxic(twice, lab.where("false")).count() == twice.count()
    assert toxicity.drop_toxic(twice, lab.withColumn("toxic", F.lit(0))).count() == twice.count()
    assert toxicity.score_documents(none, lab).count() == 0


def test_toxic_threshold():
    """Between different scores only, highest of equal ones; equal scores are all kept."""
    f = toxicity.best_threshold
    assert f(np.array([3.0, 2.0, 1.0, 0.0]), np.array([True, True, False, False])) == 1.5
    assert f(np.array([2.0, 2.0, 2.0, 0.0]), np.array([True, True, False, False])) == 1.0
    assert f(np.array([1.0, 1.0]), np.array([True, False])) < 1.0
    assert f(np.zeros(3), np.zeros(3, bool)) == f(np.zeros(0), np.zeros(0, bool)) == float("inf")


def test_token_files(spark, docs, twice, none):
    assert sorted(tuple(r) for r in token_files.token_offsets(docs).collect()) == token_rows(data())[0]
    got = token_files.token_offsets(twice).collect()
    assert len(got) == twice.count() and sorted(r["start"] for r in got)[-1] == [r["start"] for r in got if r["doc_id"] is None][0]
    assert token_files.token_offsets(none).count() == 0


def test_elias_fano():
    r = np.random.default_rng(1)
    for n, top in ((0, 1), (1, 1), (1, 1 << 40), (500, 3), (1000, 1 << 45), (3000, 90000), (3, (1 << 63) - 1), (130, 1 << 62)):
        v = np.sort(r.integers(0, top, n)).astype(np.uint64)
        ef, end = token_files.EliasFano.read(memoryview(b"xx" + token_files.EliasFano.build(v).tobytes()), 2)
        assert ef.select_many(np.arange(n)).tolist() == v.tolist() and [ef.select(i) for i in range(n)] == v.tolist()
    ids = [np.arange(k, dtype="<u2").tobytes() for k in (1, 5, 300)]
    s = token_files.Shard(token_files.encode_shard([-7, 2, None], ids, 2))
    assert [s.ids(i) for i in range(3)] == ids and [s.doc_id(i) for i in range(3)] == [-7, 2, None] and s.span(2) == (6, 306)


def same(a, b):
    return a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


def test_sharding(spark, twice, none):
    store, version = sharding.shard_documents(twice, arrivals=5)
    back = store.read()
    assert back.columns == twice.columns and store.read(shard_col="_file").columns == [*twice.columns, "_file"]
    assert same(spark.createDataFrame(back.collect(), twice.schema), twice)
    assert store.manifest().agg(F.sum("rows")).first()[0] == twice.count() and store.versions() == list(range(1, version + 1))
    assert store.read(1).count() == twice.count()
    names = [r["shard"] for r in store.manifest().collect()]
    assert len(set(names)) == len(names)
    counts = {r["_file"]: r["count"] for r in store.read(shard_col="_file").groupBy("_file").count().collect()}
    assert counts == {r["file"]: r["rows"] for r in store.manifest().where("rows > 0").collect()}
    before = store.manifest().count()
    store.append(twice)
    assert store.read().count() == 2 * twice.count() and store.manifest(store.versions()[-1]).count() > before
    store.compact()
    assert store.read().count() == 2 * twice.count()
    with pytest.raises(ValueError, match="holds rows of"):
        store.append(twice.drop("text"))
    empty, _ = sharding.shard_documents(none, arrivals=3)
    assert empty.read().count() == 0 and empty.read(shard_col="_file").count() == 0


def test_sharding_reopened(spark, docs):
    """A new object that knows the folder only appends, compacts and reads; a reader made before goes on."""
    root = fresh_dir(spark, "reopened")
    with pytest.raises(ValueError, match="no version"):
        sharding.ShardStore(spark, root).read()
    for i in range(4):
        sharding.ShardStore(spark, root).append(docs.withColumn("doc_id", F.col("doc_id") + 1000 * i), 3, "doc_id")
    reader = sharding.ShardStore(spark, root).read()
    before = sharding.ShardStore(spark, root).manifest().count()
    version = sharding.ShardStore(spark, root).compact()
    store = sharding.ShardStore(spark, root)
    assert store.versions()[-1] == version and store.manifest().count() < before
    assert reader.count() == store.read().count() == 4 * docs.count() and same(reader.drop("x"), spark.createDataFrame(store.read().collect(), store.schema))
    assert store.vacuum() == 0 and reader.count() == 4 * docs.count()
    assert store.vacuum(retain_s=0) == version - 1 and store.versions() == [version]
    assert sharding.ShardStore(spark, root).read().count() == 4 * docs.count()
    assert not any(n.startswith(".") for n in list_names(spark, f"{root}/versions"))


def test_sharding_writers_race(spark, docs):
    """Of writers that start from one version, one commits and the others are told."""
    from concurrent.futures import ThreadPoolExecutor

    root = fresh_dir(spark, "conflict")
    sharding.ShardStore(spark, root).append(docs.limit(3))
    stores = [sharding.ShardStore(spark, root) for _ in range(4)]

    def commit(store):
        try:
            return store.commit(store.manifest(1), 1)
        except RuntimeError as exc:
            assert "first" in str(exc)
            return None

    with ThreadPoolExecutor(4) as pool:
        done = list(pool.map(commit, stores))
    assert sorted(map(str, done)) == ["2", "None", "None", "None"] and stores[0].versions() == [1, 2]
    assert stores[0].read().count() == 3


def test_exact_dedup(docs, twice, none):
    got = exact_dedup.duplicate_groups(docs).collect()
    assert sorted((r["doc_id"], r["keep_id"], r["group_size"], r["digest"]) for r in got) == sorted(dedup(data()))
    table = [(r["doc_id"], r["text"]) for r in twice.select("doc_id", "text").collect()]
    got = exact_dedup.duplicate_groups(twice).collect()
    assert sorted(map(str, ((r["doc_id"], r["keep_id"], r["group_size"], r["digest"]) for r in got))) == sorted(map(str, dedup(table)))
    assert sum(r["kept"] for r in got) == len({d[3] for d in dedup(table)})
    kept = exact_dedup.drop_duplicates(twice)
    assert kept.columns == twice.columns and sorted(r["doc_id"] for r in kept.collect()) == sorted(r["doc_id"] for r in got if r["kept"])
    assert exact_dedup.duplicate_groups(none).count() == 0 and exact_dedup.drop_duplicates(none).count() == 0


def test_exact_dedup_collisions(docs):
    """With a digest of one digit, only the byte check tells texts apart."""
    got = exact_dedup.duplicate_groups(docs, digest=lambda t: F.substring(F.sha2(t, 256), 1, 1)).collect()
    assert sorted((r["doc_id"], r["keep_id"], r["group_size"]) for r in got) == sorted(r[:3] for r in dedup(data()))


def test_binary_fuse():
    r = np.random.default_rng(3)
    for n in (0, 1, 2, 50, 20000):
        keys = r.integers(0, 1 << 63, n).astype(np.uint64)
        f = exact_dedup.BinaryFuse8.frombytes(exact_dedup.BinaryFuse8.build(np.r_[keys, keys]).tobytes())
        assert f.may_contain(keys).all() and f.may_contain(r.integers(0, 1 << 63, 20000).astype(np.uint64)).mean() < 0.02


def test_simhash(docs, twice, none):
    got = simhash.fingerprint_rows(docs).collect()
    assert sorted(tuple(r) for r in got) == sorted(near(data()))
    assert simhash.fingerprint_rows(twice).count() == twice.count()
    kept = simhash.drop_near_duplicates(docs)
    assert kept.columns == docs.columns and sorted(r["doc_id"] for r in kept.collect()) == sorted({c for _, _, c in near(data())})
    assert simhash.fingerprint_rows(none).count() == 0


def test_simhash_null_and_repeated_ids(spark):
    """Rows that share an id, or have none, stay or go each by its own group; against all pairs of fingerprints."""
    from brute import fingerprint, union

    r = random.Random(12)
    text = lambda n=40: " ".join("n%d" % r.randrange(3000) for _ in range(n))
    long = [text(400) for _ in range(3)]
    near_ = [" ".join(x.split()[:-1]) for x in long]
    a, b, c, lone = text(), text(), text(), text()
    table = [(7, a), (None, a.upper()), (None, b), (3, c), (5, lone), (5, c.upper()), (None, lone), (9, None), (None, ""), (None, None), (None, c), (None, b.upper())]
    table += [(20, long[0]), (None, near_[0]), (None, long[1]), (None, near_[1]), (31, long[2]), (30, near_[2]), (30, text()), (5, text()), (5, a), (2, text()), (2, text())]
    table += [(r.choice([None, 40, 41, 42]), text()) for _ in range(30)]
    fps = np.array([fingerprint(t) for _, t in table], np.uint64)
    part = union(len(table), [(i, j) for i in range(len(fps)) for j in range(i) if np.bitwise_count(fps[i] ^ fps[j]) <= 3])
    assert any(part[i] == part[j] and fps[i] != fps[j] for i in range(len(fps)) for j in range(i) if table[i][0] is None)
    ids = {p: [d for (d, _), q in zip(table, part) if q == p and d is not None] for p in part}
    least = [min(ids[p], default=None) for p in part]
    d = spark.createDataFrame(table, "doc_id bigint, text string").withColumns({x: F.lit(1) for x in CLASH})
    got = simhash.fingerprint_rows(d).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(str((x, f"{int(f):016x}", m)) for (x, _), f, m in zip(table, fps, least))
    kept = simhash.drop_near_duplicates(d)
    assert kept.columns == d.columns
    assert sorted(map(str, ((x["doc_id"], x["text"]) for x in kept.collect()))) == sorted(str(row) for row, m in zip(table, least) if row[0] == m)


def test_simhash_hot_shards(spark):
    """Many fingerprints around few centres, so that shards are split again and again; none of the links is lost."""
    r = random.Random(6)
    centres = [r.getrandbits(64) for _ in range(3)]
    fps = set()
    for _ in range(1500):
        x = r.choice(centres)
        for b in r.sample(range(64), r.randrange(0, 7)):
            x ^= 1 << b
        fps.add(x)
    fps |= {r.getrandbits(64) for _ in range(300)}
    fps = sorted(fps)
    df = spark.createDataFrame([(f - (1 << 64) if f >= 1 << 63 else f, i) for i, f in enumerate(fps)], "fp bigint, id bigint")
    got = {r["node"]: r["component"] for r in components(simhash.near_links(df, shard=20)).collect()}
    a = np.array(fps, np.uint64)
    from brute import union

    want = union(len(fps), [(i, int(j)) for i in range(len(fps)) for j in np.flatnonzero(np.bitwise_count(a[:i] ^ a[i]) <= 3)])
    assert [got.get(i, i) for i in range(len(fps))] == want


def test_components(spark):
    chain = [(i, i + 1) for i in range(0, 60)] + [(100, 200 + i) for i in range(50)] + [(7, 7), (None, 3), (300, 60)]
    got = dict(tuple(r) for r in components(spark.createDataFrame(chain, "a bigint, b bigint")).collect())
    assert all(got[i] == 0 for i in [*range(61), 300]) and all(got[200 + i] == 100 for i in range(50))


@pytest.mark.parametrize("name, stage", pipeline.STAGES)
def test_stages(spark, sf_dir, name, stage, docs, twice, none):
    for table in (docs, twice, none):
        out = stage(spark, table, sf_dir)
        rows_ = out.count()
        assert (rows_ > 0) == (table is not none)
        if name != "packing":
            assert out.columns == docs.columns


def test_pipeline(spark, sf_dir):
    """Every stage's decisions against plain Python over what its predecessor kept."""
    stages = dict(pipeline.STAGES)
    d = spark.read.parquet(f"{sf_dir}/documents.parquet")
    a = stages["toxicity"](spark, d, sf_dir)
    b = stages["exact_dedup"](spark, a, sf_dir)
    text = lambda df: [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]
    assert sorted(x for x, _ in text(b)) == sorted({k for _, k, _, _ in dedup(text(a))})
    c = stages["simhash"](spark, b, sf_dir)
    assert sorted(x for x, _ in text(c)) == sorted({k for _, _, k in near(text(b))})
    e = stages["mixing"](spark, c, sf_dir)
    mixed = text(e)
    want = sum(len((t or "").split()) for _, t in text(c))
    assert abs(sum(len((t or "").split()) for _, t in mixed) - want) <= 20
    f = stages["packing"](spark, e, sf_dir).collect()
    crc = lambda x: zlib.crc32(np.array(x, "<u4").tobytes())
    whole = {}
    for x, t in mixed:
        ids = token_rows([(x, t)])[1][x]
        whole.setdefault((x, len(ids)), ids)
    assert sum(r["length"] for r in f) == sum(len(whole[(x, len(token_rows([(x, t)])[1][x]))]) for x, t in mixed)
    assert all(r["ids_crc32"] == crc(whole[(r["doc_id"], r["doc_tokens"])][r["start"] : r["start"] + r["length"]]) for r in f)
