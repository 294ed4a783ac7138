"""SimHash groups, aligned tokenizers and centroids, against brute force and SQL."""

import hashlib
import math
import os
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from test_operators import ODD, WORD, docs, fuzz, near_texts, prose

from gridloom.llm import alignment, centroids, pretokens, simhash
from gridloom.llm.bytesplit import Texts
from gridloom.llm.queries import oracle_sql

# 11: SimHash


def print_by_hand(text, k=3):
    from xxhash import xxh64_intdigest

    words = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + k]) for i in range(max(1, len(words) - k + 1))]
    hashes = [xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components_by_hand(prints, ids, bits=2):
    parent = list(range(len(prints)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(prints)):
        for b in range(a):
            if (prints[a] ^ prints[b]).bit_count() <= bits:
                parent[root(a)] = root(b)
    least = {}
    for k, v in enumerate(ids):
        if v is not None:
            least[root(k)] = min(v, least.get(root(k), v))
    return [least.get(root(k)) for k in range(len(prints))]


def test_fingerprints_are_those_of_the_contract():
    texts = [*ODD, *fuzz(200, 3), *near_texts(5)[:40], "A b", "a B", "ÀB c", "x " * 90_000]
    got = simhash.fingerprints(Texts.of(texts))
    assert got.tolist() == [print_by_hand(t) for t in texts]
    assert simhash.fingerprints(Texts.of(texts), chunk=7).tolist() == got.tolist()
    assert got[texts.index("")] == 0 and got[texts.index("A b")] == got[texts.index("a B")] != 0


@pytest.mark.parametrize("bits", [0, 1, 2])
def test_linked_fingerprints_share_an_anchor(bits):
    rng = np.random.default_rng(bits)
    x = rng.integers(0, 1 << 64, 400, dtype=np.uint64)
    y = x.copy()
    for k in range(len(x)):
        for b in rng.choice(64, rng.integers(0, bits + 1), replace=False):
            y[k] ^= np.uint64(1) << np.uint64(b)
    for a, b in zip(x, y, strict=True):
        ours, theirs = (set(simhash.anchors(np.array([v]), bits)[0].tolist()) for v in (a, b))
        assert ours & theirs
    at, own = simhash.anchors(x, bits)
    reach = 1 + (bits + 1) // 2
    assert (np.bitwise_count(at ^ own) <= reach).all() and not simhash.syndromes(at).any()
    assert len(set(zip(at.tolist(), own.tolist(), strict=True))) == len(at)


def test_simhash_components(spark):
    rng = random.Random(2)
    texts = [*near_texts(3)[:60], *ODD, *[prose(rng, 200)] * 5]
    long = prose(rng, 4000).split()
    for k in range(60):  # near copies that differ in a word each: a chain of close fingerprints
        texts.append(" ".join([*long[: 60 * k], "other", *long[60 * k + 1 :]]))
    ids = [None if k % 11 == 3 else 1000 - k // 2 for k in range(len(texts))]
    frame = docs(spark, texts, ids=ids).withColumn("fp", F.lit("own")).withColumn("component_id", F.lit(1)).repartition(5)
    prints = [print_by_hand(t) for t in texts]
    want = components_by_hand(prints, ids)
    assert len({v for v in want}) < len(set(ids))
    got = simhash.near_duplicates(frame).collect()
    assert sorted((str(r["doc_id"]), r["fingerprint"], str(r["component_id"])) for r in got) == sorted((str(i), f"{p:016x}", str(c)) for i, p, c in zip(ids, prints, want, strict=True))
    assert simhash.near_duplicates(frame.limit(0)).count() == 0


@pytest.mark.parametrize("spread", [1, 3])
def test_simhash_links_of_a_dense_ball(spark, spread):
    rng = np.random.default_rng(spread)
    middle = rng.integers(0, 1 << 64, 3, dtype=np.uint64)
    prints = set(rng.integers(0, 1 << 64, 300, dtype=np.uint64).tolist())
    for k in range(600):
        v = int(middle[k % 3])
        for b in rng.choice(64, spread, replace=False):
            v ^= 1 << int(b)
        prints.add(v)
    prints = sorted(prints)
    rows = [(int(np.uint64(p).astype(np.int64)),) for p in prints]
    edges = simhash.links(spark.createDataFrame(rows, "fp long").repartition(4)).collect()
    unsigned = lambda v: v & (1 << 64) - 1
    place = {p: k for k, p in enumerate(prints)}
    parent = list(range(len(prints)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for r in edges:
        a, b = place[unsigned(r["a"])], place[unsigned(r["b"])]
        parent[max(root(a), root(b))] = min(root(a), root(b))
    want = components_by_hand(prints, list(range(len(prints))))
    assert [root(k) for k in range(len(prints))] == want


# 12: alignment


@pytest.fixture(scope="module")
def tokenizers():
    import public_tokenizers
    import sentencepiece

    a = pretokens.library(pretokens.tokenizer_text(None, alignment.A_FILE))
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(alignment.B_FILE))


def aligned_by_hand(text, tokenizers):
    """(n_a, n_b, groups, links) of a text, token by token."""
    a, b = tokenizers
    letters = alignment.byte_alphabet()
    want = b" " + (text or "").encode()
    if not text:
        return [], []
    ids_a, ids_b = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
    bytes_a = [bytes(letters[c] for c in a.id_to_token(k)) for k in ids_a]
    bytes_b = []
    for k in ids_b:
        p = b.id_to_piece(k)
        bytes_b.append(bytes([int(p[3:5], 16)]) if b.is_byte(k) else p.replace("▁", " ").encode())
    if b"".join(bytes_a) != want or b"".join(bytes_b) != want:
        return [], []
    groups, i, j, at, to = [], 0, 0, 0, 0
    mine, theirs = [], []
    while i < len(ids_a) or j < len(ids_b):
        if at <= to:
            mine.append(ids_a[i])
            at += len(bytes_a[i])
            i += 1
        else:
            theirs.append(ids_b[j])
            to += len(bytes_b[j])
            j += 1
        if at == to:
            groups.append((mine, theirs))
            mine, theirs = [], []
    return groups, [(x, y) for p, q in groups for x in p for y in q]


def alignment_by_hand(texts, tokenizers):
    found = [aligned_by_hand(t, tokenizers) for t in texts]
    counts, top = {}, {}
    for _, links in found:
        for pair in set(links):
            counts[pair] = counts.get(pair, 0) + 1
    for (x, _), n in counts.items():
        top[x] = max(n, top.get(x, 0))
    out = []
    for groups, links in found:
        shown = ";".join(",".join(map(str, p)) + "|" + ",".join(map(str, q)) for p, q in groups)
        out.append((
            sum(len(p) for p, _ in groups), sum(len(q) for _, q in groups), len(groups), len(links), sum(counts[x] == top[x[0]] for x in links), sum(counts[x] for x in links),
            hashlib.sha256(shown.encode()).hexdigest() if groups else "",
        ))
    return out


HARD = ["a▁b", "▁", " ", "  ", "\n", "\n\n a", " \n ", "a\nb \n  c", "<|endoftext|>", "<s> </s> <unk> <0x0A>", "\x00", "👍🏽 é́ 日本語", "1234567890 " * 5, "=" * 400, "a" * 1000, " " * 300, "\t\t x", "don't", "x y　z"]


@pytest.mark.parametrize("expand", [1 << 20, 3])
def test_alignment(spark, tokenizers, expand):
    texts = [*ODD, *HARD, *fuzz(150, 9), *near_texts(4)[:30], "long text. " * 20_000, None]
    ids = [None if k % 7 == 2 else k // 2 for k in range(len(texts))]
    want = alignment_by_hand(texts, tokenizers)
    frame = docs(spark, texts, ids=ids).withColumn("block", F.lit("own")).withColumn("pairs", F.lit(1)).repartition(4)
    got, pairs = alignment.align(frame, alignment.Align(block_bytes=5000, salts=3, expand=expand))
    names = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert sorted((str(r["doc_id"]), *(r[c] for c in names)) for r in got.collect()) == sorted((str(i), *w) for i, w in zip(ids, want, strict=True))
    held = {}
    for t in texts:
        for pair in set(aligned_by_hand(t, tokenizers)[1]):
            held[pair] = held.get(pair, 0) + 1
    assert {(r["a"], r["b"]): r["n"] for r in pairs.collect()} == held
    assert sum(w[0] == 0 for w in want) > 4 and max(w[3] for w in want) > 1000


def test_alignment_of_an_empty_table(spark):
    out, pairs = alignment.align(docs(spark, ["x"]).limit(0))
    assert out.count() == 0 and pairs.count() == 0


def test_pieces_are_those_of_the_library(tokenizers):
    import public_tokenizers

    with open(public_tokenizers.path(alignment.B_FILE), "rb") as f:
        side = alignment.PieceSide(f.read())
    texts = [t for t in [*HARD, *fuzz(3000, 5, alpha="ab '\n\t  sStre1٣.!-é日\x1c\x85​　👍_=")] if t and "▁" not in t]
    flat, rows, odd = side.ids(Texts.of(alignment.spaced(pa.array(texts))))
    assert not len(odd)
    assert [flat[a:b].tolist() for a, b in zip(rows[:-1], rows[1:], strict=True)] == [tokenizers[1].encode(t) for t in texts]


# 13: centroids


def clusters_by_hand(vectors, how):
    kept = []
    for key, v in vectors:
        if v is not None and len(v) == how.components and all(x is not None and math.isfinite(x) for x in v):
            kept.append((key, [how.scale * int(x) if abs(x) > 1e15 else math.floor(how.scale * x) for x in v], v))
    order = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"2:{r[0]}".encode()).hexdigest(), r[2]))
    centers = [v for _, v, _ in order[: how.k]]

    def assigned():
        return [min((sum((x - y) ** 2 for x, y in zip(v, c, strict=True)), k) for k, c in enumerate(centers)) for _, v, _ in kept]

    for _ in range(how.rounds):
        own = assigned()
        for k in range(len(centers)):
            members = [v for (_, v, _), (_, c) in zip(kept, own, strict=True) if c == k]
            if members:
                centers[k] = [sum(x) // len(members) for x in zip(*members, strict=True)]
    own = assigned()
    held = lambda v: v if v < 1 << 63 else None
    total = sum(d for d, _ in own)
    return sorted(
        (str(key), k, str(held(d)), str(held(sum(x for x, c in own if c == k))), str(held(total)), hashlib.sha256(",".join(map(str, centers[k])).encode()).hexdigest())
        for (key, _, _), (d, k) in zip(kept, own, strict=True)
    )


def clusters(spark, vectors, how, kind="double"):
    frame = spark.createDataFrame(vectors, f"vec_id long, embedding array<{kind}>").withColumn("cluster", F.lit("own")).withColumn("data", F.lit(1)).repartition(5)
    rows = centroids.cluster(frame, how).collect()
    return sorted((str(r["vec_id"]), r["cluster"], str(r["distance"]), str(r["cluster_inertia"]), str(r["inertia"]), r["centroid_sha256"]) for r in rows)


@pytest.mark.parametrize("kind", ["float", "double"])
def test_centroids(spark, kind):
    rng, how = np.random.default_rng(4), centroids.Clustering(k=7, rows=64)
    vectors = [(None if k % 13 == 5 else k // 2, rng.normal(size=64).astype(np.float32).tolist()) for k in range(300)]
    vectors += [vectors[9]] * 20 + [(1, None), (2, [1.0] * 63), (3, [1.0] * 65), (4, [float("nan")] * 64), (5, [float("-inf")] * 64), (6, [None] * 64), (7, []), (8, [0.0] * 64), (9, [-0.0] * 64)]
    assert clusters(spark, vectors, how, kind) == clusters_by_hand(vectors, how)


@pytest.mark.parametrize("size", [1e5, 1e7, 1e12, 1e30, 1e306])
def test_centroids_of_large_vectors(spark, size):
    rng, how = np.random.default_rng(7), centroids.Clustering(k=4, rounds=3, rows=16)
    vectors = [(k, (rng.normal(size=64) * (size if k % 3 == 0 else 1.0)).tolist()) for k in range(90)]
    assert clusters(spark, vectors, how) == clusters_by_hand(vectors, how)
    vectors = [(k, (rng.normal(size=64) * size).tolist()) for k in range(20)]
    assert clusters(spark, vectors, how) == clusters_by_hand(vectors, how)


def test_centroids_ties_few_and_none(spark):
    how = centroids.Clustering(k=5)
    vectors = [(k, [float(k % 2)] * 64) for k in range(12)]
    assert clusters(spark, vectors, how) == clusters_by_hand(vectors, how)
    assert clusters(spark, vectors[:3], how) == clusters_by_hand(vectors[:3], how)
    assert clusters(spark, [(1, [1.0] * 3)], how) == []


def test_centroids_equal_sql(spark):
    duckdb = pytest.importorskip("duckdb")
    path = "/root/testdata/sf0.001"
    if not os.path.isdir(path):
        pytest.skip("no test tables here")
    con = duckdb.connect()
    con.execute(f"create view embeddings as select * from '{path}/embeddings.parquet'")
    want = con.execute(oracle_sql()["op13_centroids"])
    names = [x[0] for x in want.description]
    got = centroids.query(spark, path)
    assert sorted(names) == sorted(got.columns)
    assert sorted(tuple(r[c] for c in names) for r in got.collect()) == sorted(want.fetchall())


# Components


@pytest.mark.parametrize("kind", ["long", "binary"])
@pytest.mark.parametrize("together", [3, 1 << 19])
def test_thinned_edges_connect_the_same(spark, monkeypatch, kind, together):
    from gridloom.llm import components as c

    monkeypatch.setattr(c, "TOGETHER", together)
    rng = random.Random(8)
    pairs = [(rng.randrange(60), 100 + rng.randrange(4)) for _ in range(300)] + [(k, k) for k in range(5)] + [(300, 301), (301, 300)]
    made = (lambda v: v) if kind == "long" else (lambda v: str(v).encode())
    edges = spark.createDataFrame([(made(a), made(b)) for a, b in pairs], f"a {kind}, b {kind}").repartition(5)
    few = c.thinned(edges, "a").collect()
    assert len(few) < 200 if together == 3 else len(few) <= 64 + 4 * 5
    want = {r["v"]: r["c"] for r in c.components(edges).collect()}
    got = {r["v"]: r["c"] for r in c.components(spark.createDataFrame(few, f"a {kind}, b {kind}")).collect()}
    apart = {made(a) for a, b in pairs if a == b} - {made(a) for a, b in pairs if a != b}
    assert {v: c for v, c in want.items() if v not in apart} == got
    assert c.thinned(edges.limit(0), "a").count() == 0


# Repeated pages, encodings, names in another case, tokenizer files, samples


def test_ids_of_equal_pages_do_not_depend_on_the_split(spark, monkeypatch):
    from gridloom.llm import warc

    monkeypatch.setattr(warc, "EQUALS", 4)
    rows = [(k, f"http://h/{k}", f"<p>{k}</p>") for k in range(6)] + [(1, "http://h/1", "<p>1</p>")] * 10 + [(9, None, None), (9, None, ""), (9, None, None)]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string")
    ids = [sorted(r["record_id"] for r in warc.responses(frame.repartition(n)).collect()) for n in (1, 3, 7)]
    assert ids[0] == ids[1] == ids[2] and len(set(ids[0])) == len(rows)
    once = [r["record_id"] for r in warc.responses(frame.limit(6)).collect()]
    assert set(once) <= set(ids[0])


def test_encodings_by_list():
    import gzip
    import zlib

    import zstandard

    from gridloom.llm import warc

    body = b"<p>text</p>" * 50
    chunk = lambda x: b"%x\r\n%s\r\n0\r\n\r\n" % (len(x), x)
    cases = [
        ("Content-Encoding: gzip\r\nTransfer-Encoding: chunked", chunk(gzip.compress(body)), body, True),
        ("Transfer-Encoding: gzip, chunked", chunk(gzip.compress(body)), body, True),
        ("Content-Encoding: deflate, gzip", gzip.compress(zlib.compress(body)), body, True),
        ("Content-Encoding: zstd", zstandard.compress(body), body, True),
        ("Content-Encoding: identity", body, body, True),
        ("Content-Encoding: br", b"packed", b"packed", False),
        ("Content-Encoding: br\r\nTransfer-Encoding: chunked", chunk(b"packed"), b"packed", False),
        ("Content-Encoding: zstd", b"broken", b"", False),
        ("Transfer-Encoding: chunked", b"5\r\nabcde\r\n", b"abcde", False),
        ("Content-Encoding: gzip\r\nContent-Encoding: deflate", zlib.compress(gzip.compress(body)), body, True),
    ]
    for head, payload, want, right in cases:
        _, _, got, told = warc.http_parts(f"HTTP/1.1 200 OK\r\n{head}\r\n\r\n".encode() + payload)
        assert (got, told) == (want, right), head


def test_columns_in_another_case_are_replaced(spark):
    from gridloom.llm import byte_cnn, labelled_pages, main_text, quality_rules, warc

    frame = docs(spark, [prose(random.Random(k), 60) for k in range(30)]).withColumn("Score", F.lit("own")).withColumn("KEPT", F.lit("own")).withColumn("N_words", F.lit("own"))
    labels = spark.createDataFrame([(k, k % 2, 0) for k in range(30)], "doc_id long, quality int, toxic int")
    assert byte_cnn.score(frame, byte_cnn.fit(frame, labels)).select("score").count() == 30
    assert quality_rules.keep(frame, frame, labels).columns == frame.columns
    pages = spark.createDataFrame([(k, "u", h) for k, (h, _) in enumerate(labelled_pages.made(3, 1))], "page_id long, url string, html string").withColumn("Text", F.lit("own"))
    assert main_text.extract(pages, main_text.fit()).select("text").count() == 3
    records = warc.responses(pages).withColumn("extra", F.lit(1)).withColumnRenamed("block", "Block")
    assert warc.derivatives(records).select("block", "extra").count() == 6


def test_unknown_tokenizer_files_are_refused(tmp_path):
    import json

    from gridloom.llm import pair_bpe

    for file, made in ((alignment.A_FILE, pretokens.ByteTokenizer), (pair_bpe.WORD_FILE, pair_bpe.PairTokenizer)):
        told = json.loads(pretokens.tokenizer_text(None, file))
        made(json.dumps(told))
        for part, value in (("normalizer", {"type": "Lowercase"}), ("pre_tokenizer", {"type": "Whitespace"})):
            with pytest.raises(ValueError, match="not built in"):
                made(json.dumps(told | {part: value}))
        with pytest.raises(ValueError, match="not built in"):
            made(json.dumps(told | {"model": told["model"] | {"dropout": 0.1}}))


def test_samples_are_bounded_in_bytes(spark):
    from gridloom.llm.labelled import training_rows

    frame = docs(spark, ["x" * (100 * k) for k in range(40)])
    labels = spark.createDataFrame([(k, k % 2, 0) for k in range(40)], "doc_id long, quality int, toxic int")
    every = training_rows(frame, labels, "quality", 1000, 1).collect()
    few = training_rows(frame, labels, "quality", 1000, 1, class_bytes=5000).collect()
    for y in (0, 1):
        assert 0 < sum(len(r["text"]) for r in few if r["y"] == y) <= 5000 < sum(len(r["text"]) for r in every if r["y"] == y)
    assert {r["doc_id"] for r in few} < {r["doc_id"] for r in every}


def test_sections_of_documents_by_hand(spark):
    """op3's lines: start, end, whole and crossing tokens of each, from offsets of the library."""
    from gridloom.llm import token_counts

    texts = ["one two\nthree\n\n four", "a\n", "\n\n", "don't\nstop — ok\n" * 3, "x", "日本\n語 é\n"]
    library = pretokens.library(pretokens.tokenizer_text(None, "byte_bpe_50k.json"))
    frame = docs(spark, texts)
    frame.write.mode("overwrite").parquet(path := f"{spark.conf.get('spark.checkpoint.dir')}/op3-documents/documents.parquet")
    got = {}
    for r in token_counts.query(spark, path.rsplit("/", 1)[0]).collect():
        got.setdefault(r["doc_id"], []).append(r)
    for k, text in enumerate(texts):
        total = len(library.encode(text, add_special_tokens=False).ids)
        rows = sorted(got.get(k, []), key=lambda r: r["start"])
        assert sum(r["n_tokens"] for r in rows) == total
        lines = [m for m in text.split("\n")]
        for r in rows:
            assert 0 <= r["start"] <= r["end"] <= len(text) and r["n_crossing"] <= r["n_tokens"] + 1
        assert "".join(text[r["start"] : r["end"]] for r in rows).replace("\n", "") == "".join(lines)


@pytest.mark.parametrize("kind", ["int", "string"])
def test_simhash_ids_of_other_types_and_columns_in_another_case(spark, kind):
    texts = ["a b c d", None, "A b c D", "other words here", ""]
    frame = docs(spark, texts, ids=[7, 5, 3, 9, 6]).select(F.col("doc_id").cast(kind).alias("Doc_ID"), F.col("text").alias("TEXT"))
    got = simhash.near_duplicates(frame)
    assert got.columns == ["doc_id", "fingerprint", "component_id"] and got.schema["component_id"].dataType.simpleString() == kind
    prints = [f"{print_by_hand(t):016x}" for t in texts]
    want = zip(["7", "5", "3", "9", "6"], prints, ["3", "5", "3", "9", "5"], strict=True)
    assert sorted((str(r["doc_id"]), r["fingerprint"], str(r["component_id"])) for r in got.collect()) == sorted(want)


def test_rounds_and_steps_have_two_joins(spark, monkeypatch):
    """Small joins are broadcasts, which the driver of the pipeline holds all at once."""
    from gridloom.llm import components, mixing

    kind, joins, made = type(spark.range(1)), [], []
    monkeypatch.setattr(kind, "join", lambda self, *a, f=kind.join: joins.append(1) or f(self, *a))
    for module in (components, mixing):
        monkeypatch.setattr(module, "written", lambda frame, name, f=module.written: made.append(name) or f(frame, name))
    edges = [(k, k + 1) for k in range(40)] + [(70, 60), (61, 60)]
    got = {r["v"]: r["c"] for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {k: 0 if k <= 40 else 60 for k in (*range(41), 60, 61, 70)}
    rounds = (made.count("labels") - 1) // 2
    assert rounds > 1 and len(joins) <= 2 * rounds and len(made) <= 2 * rounds + 2

    joins.clear(), made.clear()
    spare = spark.createDataFrame([(1, 1, 3, 9), (1, 1, 4, 50), (1, 2, 1, 30), (1, 2, 2, 8), (1, 3, 1, 2), (2, 1, 1, 70), (3, 5, 2, 4)], "s int, place int, mix_rank int, mix_size long")
    state = spark.createDataFrame([(1, 18, 1, 2), (2, 60, 1, 0), (3, 4, 5, 1), (4, 9, 1, 1)], "s int, lack long, from_place int, from_rank int")
    got = sorted(tuple(r) for r in mixing._steps(spare, state).collect())
    far = 2**31 - 1
    assert got == [(1, 18, 1, 2, 3, 0, 1), (3, 4, 5, 1, far, 0, 0)]
    steps = made.count("steps")
    assert steps > 1 and len(joins) == 2 * steps


def test_forests_of_one_group_have_one_root_and_edges_are_made_once(spark, monkeypatch):
    """Members of a group that all hang on the same few vertices: a star, so two rounds do."""
    from gridloom.llm import components as c

    made = []
    monkeypatch.setattr(c, "written", lambda frame, name, f=c.written: made.append(name) or f(frame, name))
    pairs = [(1000 - k, 5000 + h) for k in range(300) for h in range(4)]
    edges = spark.createDataFrame(pairs, "a long, b long").repartition(7)
    few = c.thinned(edges, "a")
    assert {r["b"] for r in few.collect()} == {5000}
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    got = {r["v"]: r["c"] for r in c.components(few.mapInArrow(count, few.schema)).collect()}
    assert got == {v: 701 for v in (*range(701, 1001), *range(5000, 5004))}
    assert made.count("labels") == 1 + 2 * 2
    assert seen.value == few.count()


def test_units_of_a_mix_have_four_joins_besides_the_steps(spark, monkeypatch):
    """Small joins are broadcasts, which the driver of the pipeline holds all at once."""
    from pyspark.sql import functions as F

    from gridloom.llm import mixing

    rng = random.Random(4)
    rows = [(k, " ".join("x" * rng.randint(1, 40)), rng.choice(["a", "b", None])) for k in range(400)]
    documents = spark.createDataFrame(rows, "doc_id long, text string, source string")
    how = mixing.Mix(least_blocks=8)
    ranked = mixing._rows(documents, how, 8)
    goals = mixing.targets(ranked.groupBy("source").agg(F.sum("mix_size").alias("source_size")), how)
    kind, joins, made = type(documents), [], []
    monkeypatch.setattr(kind, "join", lambda self, *a, f=kind.join: joins.append(1) or f(self, *a))
    monkeypatch.setattr(mixing, "written", lambda frame, name, f=mixing.written: made.append(name) or f(frame, name))
    units = mixing._units(ranked, goals, how).collect()
    assert len(joins) == 4 + 2 * made.count("steps")
    passes = {r["s"]: int(r["target"] // r["source_size"]) for r in goals.collect()}
    assert units and all(u["pass"] == passes[u["s"]] + 1 for u in units if not u["whole"])


def planned(frame) -> str:
    return frame._jdf.queryExecution().executedPlan().toString()


def test_small_tables_meet_without_shuffles(spark, monkeypatch):
    """Each stage of a shuffle is work and memory of the pipeline's driver, however few its rows are.
    The threshold is that of a store where Spark cannot tell how small a table is."""
    from gridloom.llm import chosen_path, components, mixing

    plans = {}
    for module in (components, mixing, chosen_path):
        monkeypatch.setattr(module, "written", lambda frame, name, f=module.written: plans.setdefault(name, []).append(planned(frame)) or f(frame, name))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        edges = spark.createDataFrame([(k, k + 1) for k in range(9)], "a long, b long")
        assert {(r["v"], r["c"]) for r in components.components(edges).collect()} == {(k, 0) for k in range(10)}
        first, *rest = plans["labels"]
        assert len(rest) > 2 and first.count("Exchange hash") == 1
        assert [p.count("Exchange hash") for p in rest] == [0, 1] * (len(rest) // 2)
        monkeypatch.setattr(components, "FEW", 9)
        plans.clear()
        assert {(r["v"], r["c"]) for r in components.components(edges).collect()} == {(k, 0) for k in range(10)}
        assert [p.count("Exchange hash") for p in plans["labels"][1:]] == [2, 3] * (len(rest) // 2)

        rows = [(k, " ".join("x" * (1 + k * 7 % 40)), "ab"[k % 2]) for k in range(300)]
        documents = spark.createDataFrame(rows, "doc_id long, text string, source string")
        got = {}
        for few in (2, 1):
            plans.clear()
            how = mixing.Mix(least_blocks=8, few=few)
            got[few] = sorted(map(str, mixing.assign(documents, how).select("doc_id", "draws").collect()))
            assert ["SortMergeJoin" in p for p in plans["ends"]] == [few == 1] * len(plans["ends"]) and plans["ends"]
            assert ("SortMergeJoin" in plans["fitted"][0]) == (few == 1)
        assert got[1] == got[2]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    plans.clear()
    docs_ = spark.createDataFrame([(k, f"a b c d e f g {k // 2}") for k in range(10)], "doc_id long, text string")
    assert {r["class_id"] for r in chosen_path.classes(docs_).collect()} == {0, 2, 4, 6, 8}
    assert plans["linked"][0].count("SortMergeJoin") == 2 and "BroadcastHashJoin" not in plans["linked"][0]


def test_few_rows_take_few_tasks(spark):
    """op7 where a session asks for many partitions and nothing merges them: what is known to be
    small is not dealt over all of them, and the classes are the same."""
    from gridloom.llm import chosen_path

    rows = [(k, f"a b c d e f g h i j k l m n o p q r s t {k // 8} {'u v w' if k % 2 else ''}") for k in range(64)]
    documents = spark.createDataFrame(rows, "doc_id long, text string").coalesce(2)
    want = sorted(chosen_path.classes(documents, chosen_path.Join(small=4)).collect())
    changed = {"spark.sql.shuffle.partitions": "64", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in changed}
    for k, v in changed.items():
        spark.conf.set(k, v)
    try:
        spark.sparkContext.setJobGroup("few rows", "")
        assert sorted(chosen_path.classes(documents, chosen_path.Join(small=4)).collect()) == want
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        for k, v in before.items():
            spark.conf.set(k, v)
    tracker = spark.sparkContext.statusTracker()
    stages = {s for j in tracker.getJobIdsForGroup("few rows") for s in tracker.getJobInfo(j).stageIds}
    tasks = sum(i.numTasks for s in stages if (i := tracker.getStageInfo(s)) and i.numCompletedTasks)
    assert tasks < 1000


@pytest.mark.parametrize("levels", [0, 1, 3, 4])
def test_the_tree_takes_two_levels_at_once(spark, monkeypatch, levels):
    import numpy as np

    from gridloom.llm import mixing

    plans = []
    monkeypatch.setattr(mixing, "written", lambda frame, name, f=mixing.written: plans.append(planned(frame)) or f(frame, name))
    mix = mixing.Mix(levels=levels)
    want = {1: np.array([700, 3, 0, 41])}
    for _ in range(levels):
        below = {}
        for node, q in want.items():
            below[2 * node] = np.random.default_rng([mix.seed, node]).multivariate_hypergeometric(q, int(q.sum()) // 2, method="marginals") if q.sum() else q
            below[2 * node + 1] = q - below[2 * node]
        want = below
    quotas = spark.createDataFrame([(3, 0), (1, 700), (4, 41), (2, 3)], "s long, q long")
    got = {(r["shard"], r["s"]): r["q"] for r in mixing._tree(quotas, mix).collect()}
    assert got == {(n - (1 << levels), s + 1): int(x) for n, q in want.items() for s, x in enumerate(q) if x}
    assert plans[0].count("FlatMapGroupsInPandas") == (levels + 1) // 2


def test_a_sample_reaches_the_driver_in_small_pieces(spark):
    """The window over a label's sizes leaves all of its texts in one task."""
    from gridloom.llm import labelled

    documents = docs(spark, [f"text {k} " * 20 for k in range(600)])
    labels = spark.createDataFrame([(k, k % 2) for k in range(600)], "doc_id long, quality int")
    rows = labelled.training_rows(documents, labels, "quality", 200, 1)
    own = [r["n"] for r in rows.groupBy(F.spark_partition_id().alias("p")).agg(F.count("*").alias("n")).collect()]
    assert sum(own) == 400 and max(own) < 40


def test_draws_give_each_shard_its_quota(spark, monkeypatch):
    """Places of a source are no rows that are joined: its shards' ends are one row."""
    from gridloom.llm import mixing

    rng = random.Random(8)
    rows = [(k, " ".join("x" * rng.randint(1, 30)), rng.choice(["a", "b", None])) for k in range(500)]
    documents = spark.createDataFrame(rows, "doc_id long, text string, source string")
    seen, plans = {}, {}

    def kept(frame, name, f=mixing.written):
        plans[name] = planned(frame)
        out = f(frame, name)
        seen[name] = [r.asDict() for r in out.collect()] if name in ("units", "quotas", "draws") else []
        return out

    monkeypatch.setattr(mixing, "written", kept)
    mix = mixing.Mix(least_blocks=8)
    ranked = mixing._rows(documents, mix, 8)
    mixing._plan(ranked, mix)
    source = {u["source"]: u["s"] for u in seen["units"]}
    drawn = [(source[r["source"]], d["shard"]) for r in seen["draws"] for d in r["draws"]]
    assert len(drawn) == len(seen["units"])
    assert {(q["s"], q["shard"]): q["q"] for q in seen["quotas"]} == {k: drawn.count(k) for k in set(drawn)}
    assert "explode" not in plans["draws"].lower() and "Generate" not in plans["draws"]
