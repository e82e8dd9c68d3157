"""The queries over the whole small tables against plain Python."""

import hashlib
import zlib

import numpy as np
import pytest
from brute import conversation, dedup, near, targets, token_rows, vectors

from strandspark.llm import queries as Q
from strandspark.llm import toxicity


def table(spark, sf_dir, name, *cols):
    return [tuple(r) for r in spark.read.parquet(f"{sf_dir}/{name}.parquet").select(*cols).collect()]


@pytest.fixture(scope="module")
def docs(spark, sf_dir):
    return table(spark, sf_dir, "documents", "doc_id", "text")


def test_mix(spark, sf_dir):
    got = Q.op1_mix(spark, sf_dir).collect()
    rows = table(spark, sf_dir, "documents", "doc_id", "source", "text")
    size = {d: len((t or "").split()) for d, _, t in rows}
    sources = {}
    for d, s, _ in rows:
        sources[s] = sources.get(s, 0) + size[d]
    want = targets(sources)
    taken = {}
    assert len(got) == len(rows)
    for r in got:
        assert r["size"] == size[r["doc_id"]] and r["source_size"] == sources[r["source"]]
        assert r["target"] == pytest.approx(want[r["source"]], rel=1e-9)
        assert 0 <= r["taken"] <= 3 * r["size"]
        taken[r["source"]] = taken.get(r["source"], 0) + r["taken"]
    assert all(abs(taken[s] - want[s]) <= 1 for s in want)
    assert {(r["doc_id"], r["taken"]) for r in got} == {(r["doc_id"], r["taken"]) for r in Q.op1_mix(spark, sf_dir).collect()}


def test_html(spark, sf_dir):
    import html
    import re

    wrong, rows = [], Q.op2_html(spark, sf_dir).collect()
    pages = dict(table(spark, sf_dir, "pages", "page_id", "html"))
    assert len(rows) == len(pages)
    for r in rows:
        a = re.search(r"<article>(.*?)(?:</article>|$)", pages[r["page_id"]], re.S)
        a = re.sub(r"<[^>]*$", "", a[1]) if a else ""
        blocks = [" ".join(html.unescape(re.sub(r"<[^>]+>", "", b.replace("<br>", " "))).split()) for b in re.split(r"</?(?:p|h1)>", a)]
        wrong += [r["page_id"]] if r["text"] != "\n".join(b for b in blocks if b) else []
        assert r["n_chars"] == len(r["text"])
    assert not wrong


def test_chat(spark, sf_dir):
    rows, said = {}, "</s>[INST] ok [/INST]"
    for c, *r in table(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text"):
        rows.setdefault(c, []).append(tuple(r))
    rows[-1] = [(0, "user", said), (1, "assistant", said)]
    got = Q.op3_chat(spark, sf_dir).collect()
    assert len(got) == len(rows)
    for r in got:
        assert (r["n_turns"], r["turns_sha256"], r["loss_chars"], r["loss_sha256"]) == conversation(rows[r["conv_id"]])


def test_packing(spark, sf_dir, docs):
    rows, ids = token_rows(docs)
    got = Q.op4_packing(spark, sf_dir).collect()
    by_doc, by_seq = {}, {}
    for r in got:
        by_doc.setdefault(r["doc_id"], []).append(r)
        by_seq.setdefault(r["sequence_id"], []).append(r)
    assert by_doc.keys() == ids.keys()
    for d, pieces in by_doc.items():
        at = 0
        for p in sorted(pieces, key=lambda p: p["start"]):
            x = ids[d][p["start"] : p["start"] + p["length"]]
            assert p["start"] == at and p["length"] == len(x) > 0 and p["doc_tokens"] == len(ids[d])
            assert p["ids_crc32"] == zlib.crc32(np.array(x, "<u4").tobytes())
            at += p["length"]
        assert at == len(ids[d])
    padded = 0
    for pieces in by_seq.values():
        at = 0
        for p in sorted(pieces, key=lambda p: p["offset"]):
            assert p["offset"] == at
            at += p["length"]
        assert at <= 2048
        padded += 0 if at & (at - 1) == 0 else 2048 - at
    assert padded <= 0.02 * sum(map(len, ids.values())) + 2048


def test_vectors(spark, sf_dir):
    want = vectors(table(spark, sf_dir, "embeddings", "vec_id", "embedding"))
    assert sorted(tuple(r) for r in Q.op5_vectors(spark, sf_dir).collect()) == sorted(want)


def test_toxicity(spark, sf_dir):
    labels = dict(table(spark, sf_dir, "labels", "doc_id", "toxic"))
    got = {r["doc_id"]: r["rejected"] for r in Q.op6_toxicity(spark, sf_dir).collect()}
    assert len(got) == len(table(spark, sf_dir, "documents", "doc_id"))
    assert sum(got[d] == (t == 1) for d, t in labels.items()) >= 0.95 * len(labels)


def test_toxicity_held_out(spark):
    """Labels of a fifth of the documents are not given; their documents are judged as the labels say."""
    sf_dir = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{sf_dir}/{n}.parquet") for n in ("documents", "labels"))
    got = {r["doc_id"]: r["rejected"] for r in toxicity.score_documents(docs, labels.where("doc_id % 5 <> 0")).collect()}
    held = labels.where("doc_id % 5 = 0 AND toxic IS NOT NULL").collect()
    right = sum(got[r["doc_id"]] == (r["toxic"] == 1) for r in held)
    clean = [r for r in held if r["toxic"] == 0]
    assert len(held) > 50 and right >= 0.93 * len(held)
    assert sum(not got[r["doc_id"]] for r in clean) >= 0.97 * len(clean)


def test_token_files(spark, sf_dir, docs):
    assert sorted(tuple(r) for r in Q.op7_token_files(spark, sf_dir).collect()) == token_rows(docs)[0]


def test_sharding(spark, sf_dir, docs):
    got = Q.op8_sharding(spark, sf_dir).collect()
    assert sorted((r["doc_id"], r["n_chars"], r["text_sha256"]) for r in got) == sorted((d, len(t), hashlib.sha256(t.encode()).hexdigest()) for d, t in docs)
    assert all(r["listed"] for r in got)


def test_exact_dedup(spark, sf_dir, docs):
    got = Q.op9_exact_dedup(spark, sf_dir).collect()
    assert sorted((r["doc_id"], r["keep_id"], r["group_size"], r["text_sha256"]) for r in got) == sorted(dedup(docs))
    assert all(r["kept"] == (r["doc_id"] == r["keep_id"]) for r in got)


def test_simhash(spark, sf_dir, docs):
    assert sorted(tuple(r) for r in Q.op10_simhash(spark, sf_dir).collect()) == sorted(near(docs))
