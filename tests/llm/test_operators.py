"""The ten operators on small fixtures, against brute force or an exact round trip."""

import gzip
import hashlib
import io
import os
import json
import random
import re
import struct
import time
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.llm import byte_cnn, chosen_path, html_tree, labelled_pages, main_text, mixing, pair_bpe, pretokens, quality_rules, token_counts, token_store, vector_join, warc
from gridloom.llm.bytesplit import Texts, Words
from gridloom.llm.components import components
from gridloom.llm.labelled import training_rows
from gridloom.llm.html_tree import Page

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
ODD = ["", None, " \n\t ", "a", "don't we'll 's", "<|endoftext|> x", "É日本 ΑΣ x\x85y", "x" * 3000, "Hello, wORLD! 12345\n\nagain  ", "  two  ", "a\x00b"]


def docs(spark, texts, sources=None, ids=None):
    rows = [(k if ids is None else ids[k], t, "en", "s" if sources is None else sources[k], 0) for k, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS)


def fuzz(n, seed, alpha="ab '\n\t  sStredvml1٣²½.!-é日本Σ\x1c\x85​ 　👍İ"):
    rng = random.Random(seed)
    return ["".join(rng.choice(alpha) for _ in range(rng.randint(0, 40))) for _ in range(n)]


def prose(rng, n):
    return " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 7))) for _ in range(n))


# 1: mixing


def targets_by_hand(sizes):
    """Water filling: shares by weight, what is above three sizes goes to the others."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (1, 2, 3)[k % 3] for k, s in enumerate(names)}
    total, out, full = sum(sizes.values()), {}, set()
    while True:
        rest = total - sum(3 * sizes[s] for s in full)
        left = sum(weight[s] for s in names if s not in full)
        out = {s: 3.0 * sizes[s] if s in full else rest * weight[s] / left for s in names}
        over = {s for s in names if s not in full and out[s] > 3 * sizes[s] + 1e-9}
        if not over:
            return out
        full |= over


@pytest.mark.parametrize("hot", [False, True])
def test_mix_meets_its_targets(spark, hot):
    rng = random.Random(1)
    names = ["b", "a", None, "é"]
    sources = [names[0] if hot and k % 3 else rng.choice(names) for k in range(400)]
    texts = [None if k % 37 == 0 else prose(rng, rng.randint(0, 30)) for k in range(400)]
    frame = docs(spark, texts, sources, [k if k % 11 else 7 for k in range(400)])
    got = mixing.assign(frame).collect()
    assert len(got) == 400 and sorted(r["size"] for r in got) == sorted(len(WORD.findall(t or "")) for t in texts)
    sizes = {}
    for s, t in zip(sources, texts, strict=True):
        sizes[s] = sizes.get(s, 0) + len(WORD.findall(t or ""))
    want = targets_by_hand(sizes)
    taken = dict.fromkeys(sizes, 0)
    for r in got:
        assert r["target"] == pytest.approx(want[r["source"]]) and r["source_size"] == sizes[r["source"]] and len(r["draws"]) <= 3
        taken[r["source"]] += r["size"] * len(r["draws"])
    for s in sizes:
        assert abs(taken[s] - want[s]) <= 30
    assert sorted(map(str, mixing.assign(frame).collect())) == sorted(map(str, got))
    out = mixing.mixed(frame.withColumn("mix_draws", F.lit(1)).withColumn("block", F.lit(2)))
    assert out.columns[-2:] == ["mix_draws", "block"] and out.count() == sum(len(r["draws"]) for r in got)


def test_mix_fills_up_behind_a_long_document(spark):
    """A fifth of each source's words in one document, at which its last pass may end."""
    rng = random.Random(1)
    names = [chr(97 + k) for k in range(16)]
    sources = [s for s in names for _ in range(61)]
    texts = [prose(rng, rng.randint(1, 20) if k % 61 else 150) for k in range(len(sources))]
    got = mixing.assign(docs(spark, texts, sources), mixing.Mix(weights=(1, 3))).collect()
    for s in names:
        own = [r for r in got if r["source"] == s]
        assert abs(sum(r["size"] * len(r["draws"]) for r in own) - own[0]["target"]) <= 10


def test_splitting_tree_keeps_quotas(spark):
    quotas = spark.createDataFrame([(1, 700), (2, 3), (3, 0)], "s long, q long")
    got = mixing._tree(quotas, mixing.Mix()).groupBy("s").agg(F.sum("q").alias("q")).collect()
    assert {r["s"]: r["q"] for r in got} == {1: 700, 2: 3}


def test_mix_of_nothing(spark):
    assert mixing.assign(docs(spark, [])).count() == 0 and mixing.mixed(docs(spark, [])).count() == 0
    one = docs(spark, ["a b c", None])
    assert mixing.mixed(one).count() >= 1


# 2: token segments


def test_boundaries_select():
    for size in (1, 2, 255, 256, 257, 3000):
        z = np.random.default_rng(size).integers(1, 900, size)
        b = token_store.Boundaries.of(np.cumsum(z))
        assert (b.all() == np.cumsum(z)).all() and all(b.select(k) == x for k, x in enumerate(np.cumsum(z)))
        used = 8 * (b.low.nbytes + b.high.nbytes + b.samples.nbytes)
        assert used <= size * (3.2 + b.low_bits) + 80
    with pytest.raises(IndexError):
        b.select(3000)


def test_segments_round_trip(spark, tmp_path):
    texts = [*ODD, *fuzz(200, 3)]
    ids = [k * 3 if k != 5 else None for k in range(len(texts))]
    ids[20] = ids[21]
    frame = docs(spark, texts, ids=ids)
    made = token_store.write(frame, token_store.Store(segment_ids=300, segment_documents=20))
    library = pretokens.library(pretokens.tokenizer_text(None, "byte_bpe_50k.json"))
    want = sorted(([-1 if k is None else k, [*library.encode(t or "", add_special_tokens=False).ids, 0]] for k, t in zip(ids, texts, strict=True)), key=str)
    rows = token_store.read(made).collect()
    got = [[-1 if r["doc_id"] is None else r["doc_id"], list(struct.unpack(f"<{r['n_tokens']}I", r["ids"]))] for r in rows]
    assert sorted(got, key=str) == want
    rows.sort(key=lambda r: r["start"])
    assert [r["start"] for r in rows] == list(np.cumsum([0] + [r["n_tokens"] for r in rows])[:-1])
    keys = [-1 if r["doc_id"] is None else r["doc_id"] for r in rows]
    assert keys == sorted(keys)
    image = bytes(made.where("before = 0").first()["image"])
    assert list(token_store.document(image, 0)) == list(token_store.unpack(image)[0][: token_store.unpack(image)[1].select(0)])
    paths = [r["path"] for r in token_store.export(made, f"file://{tmp_path}/segments").collect()]
    assert len(paths) == made.count() and open(paths[0], "rb").read()[:6] == token_store.MAGIC


def test_sums_are_made_where_segments_are_read(spark, tmp_path):
    """Ids do not go to the JVM and back for their checksum."""
    frame = docs(spark, [*ODD, *fuzz(60, 8)])
    frame.write.parquet(f"{tmp_path}/documents.parquet")
    got = token_store.query(spark, str(tmp_path))
    assert got._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1
    want = token_store.read(token_store.write(frame)).collect()
    assert sorted(map(tuple, got.collect())) == sorted((r["doc_id"], r["start"], r["n_tokens"], zlib.crc32(r["ids"])) for r in want)


def test_no_documents_no_segments(spark):
    assert token_store.read(token_store.write(docs(spark, []))).count() == 0


# 3: token counts


@pytest.mark.parametrize("rule", token_counts.RULES)
def test_counts_by_section(spark, rule):
    rng = random.Random(5)
    texts = [*ODD, *fuzz(100, 8)]
    spans = []
    for k, t in enumerate(texts):
        cuts = sorted(rng.sample(range(len(t or "") + 1), min(4, len(t or "") + 1)))
        spans += [(k, n, a, b) for n, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True))]
    frame = spark.createDataFrame(spans, "doc_id long, section int, start long, end long")
    got = {(r["doc_id"], r["section"]): (r["n_tokens"], r["n_crossing"]) for r in token_counts.attribute(docs(spark, texts), frame, token_counts.Count(rule)).collect()}
    library = pretokens.library(pretokens.tokenizer_text(None, "byte_bpe_50k.json"))
    want = {(d, n): [0, 0] for d, n, _, _ in spans}
    for k, t in enumerate(texts):
        own = [(n, a, b) for d, n, a, b in spans if d == k]
        for a, b in library.encode(t or "", add_special_tokens=False).offsets:
            hit = [(n, min(b, q) - max(a, p), p, q) for n, p, q in own if p < b and q > a]
            if not hit:
                want.setdefault((k, None), [0, 0])[0] += 1
                continue
            n, _, p, q = {"most": max(hit, key=lambda h: (h[1], -h[0])), "first": hit[0], "last": hit[-1]}[rule]
            want[k, n][0] += 1
            want[k, n][1] += a < p or b > q
    assert got == {k: tuple(v) for k, v in want.items()}


def test_counts_of_lines_and_fields(spark):
    rows = token_counts.attribute(docs(spark, ["one\ntwo three\n", "", None])).collect()
    assert sorted((r["doc_id"], r["section"], r["start"], r["end"]) for r in rows) == [(0, 0, 0, 4), (0, 1, 4, 14), (1, 0, 0, 0), (2, 0, 0, 0)]
    frame = spark.createDataFrame([(1, "user", "hello there"), (2, None, "x")], "conv_id long, role string, text string")
    joined = token_counts.join_fields(frame, "conv_id", ["role", "text"])
    got = {(r["doc_id"], r["section"]): r["n_tokens"] for r in token_counts.attribute(joined, "sections").collect()}
    same = token_counts.attribute(joined, joined.select("doc_id", F.explode("sections").alias("s")).select("doc_id", "s.*"))
    assert got == {(r["doc_id"], r["section"]): r["n_tokens"] for r in same.collect()}
    odd = spark.createDataFrame([(None, "user", "hello there"), (None, "a", "x y z"), (7, "b", "one"), (7, "longer", "two words")], "conv_id long, role string, text string")
    counts = token_counts.attribute(token_counts.join_fields(odd, "conv_id", ["role", "text"]), "sections").where("section is not null")
    assert counts.count() == 8 and counts.where("n_tokens = 0").count() == 0
    assert got[1, 0] == 1 and got[1, 1] == 2 and got[2, 0] == 0 and got[1, None] == 1
    with pytest.raises(ValueError):
        token_counts.Count("nearest")
    assert token_counts.attribute(docs(spark, [])).count() == 0


# 4: WARC


def test_derivatives_are_linked(spark, tmp_path):
    pages = spark.createDataFrame([(1, "http://a/", "<title>T &amp; x</title><p>one<p>two"), (2, None, None), (1, "http://a/", "<title>T &amp; x</title><p>one<p>two")], "page_id long, url string, html string")
    source = warc.responses(pages)
    made = warc.derivatives(source.withColumn("extra", F.lit(5)))
    rows = made.collect()
    assert len(rows) == 6 and {r["type"] for r in rows} == {"metadata", "conversion"} and {r["extra"] for r in rows} == {5}
    by = {r["record_id"]: r for r in source.collect()}
    for r in rows:
        origin = by[r["headers"]["WARC-Refers-To"]]
        assert r["target_uri"] == origin["target_uri"] and r["headers"]["WARC-Block-Digest"] == warc.digest(bytes(r["block"]))
        assert r["headers"]["WARC-Source-Payload-Digest"] == origin["headers"]["WARC-Payload-Digest"]
    text = {r["page_id"]: bytes(r["block"]).decode() for r in rows if r["type"] == "conversion"}
    assert text == {1: "one\ntwo", 2: ""}
    fields = next(bytes(r["block"]).decode() for r in rows if r["type"] == "metadata" and r["page_id"] == 1)
    assert "title: T & x\r\n" in fields and "payload-digest-matches: true" in fields and "http-header-content-type: text/html" in fields
    assert warc.derivatives(made).count() == 0
    place = f"file://{tmp_path}/warc"
    assert sum(r["n_records"] for r in warc.export(made, place).collect()) == 6
    again = warc.read(spark, place)
    same = lambda f: sorted(str((r["record_id"], r["type"], r["date"], r["target_uri"], sorted(r["headers"].items()), bytes(r["block"]))) for r in f.collect())
    assert same(again) == same(made.select(*again.columns))


def test_http_bodies():
    pack = lambda kind, data: b"HTTP/1.1 200 OK\r\nContent-Encoding: " + kind + b"\r\nX:\r\n y\r\n\r\n" + data
    gz = gzip.compress(b"<p>x</p>")
    status, fields, body, right = warc.http_parts(pack(b"gzip", gz))
    assert body == b"<p>x</p>" and ("X", "y") in fields and status == "HTTP/1.1 200 OK" and right
    assert warc.http_parts(pack(b"gzip", gz + gzip.compress(b"more" * 5000)))[2:] == (b"<p>x</p>" + b"more" * 5000, True)
    bare = zlib.compressobj(9, zlib.DEFLATED, -15)
    assert warc.http_parts(pack(b"deflate", bare.compress(b"abc" * 9) + bare.flush()))[2:] == (b"abc" * 9, True)
    assert warc.http_parts(pack(b"deflate", zlib.compress(b"abc" * 9)))[2:] == (b"abc" * 9, True)
    assert warc.http_parts(pack(b"gzip", b"no gzip at all"))[2:] == (b"", False)
    assert not warc.http_parts(pack(b"gzip", gzip.compress(random.Random(1).randbytes(40_000))[:20_000]))[3]
    assert warc.http_parts(b"HTTP/1.1 200 OK\r\nTransfer-Encoding: chunked\r\n\r\n3\r\nabc\r\n0\r\n\r\n")[2] == b"abc"
    assert warc.decoded("é".encode("latin-1"), "text/html; charset=iso-8859-1") == "é"
    late = b"<!-- " + b"x" * 9000 + b" --><meta name=a><meta charset=iso-8859-1>" + "é".encode("latin-1")
    assert warc.decoded(late, "text/html").endswith("é")


def test_broken_records_do_not_stop_the_reader():
    good = warc.record_bytes({"record_id": "<urn:x>", "type": "response", "date": "d", "target_uri": "u", "headers": {}, "block": b"abc"})
    for length in (b"many", b"-5", b""):
        bad = b"WARC/1.1\r\nWARC-Type: response\r\nContent-Length: " + length + b"\r\n\r\nlost\r\n\r\n"
        got = list(warc.parse_records(io.BytesIO(bad + good)))
        assert [bytes(r["block"]) for r in got] == [b"", b"abc"] and got[1]["record_id"] == "<urn:x>"


# 5: main text


@pytest.fixture(scope="module")
def tree():
    return main_text.fit()


def test_main_text_of_unseen_pages(tree):
    pairs = labelled_pages.made(200, 77)
    got = main_text.main_texts([a for a, _ in pairs], tree)
    assert np.mean([g == t for g, (_, t) in zip(got, pairs, strict=True)]) > 0.9


@pytest.mark.parametrize(("semantic", "least"), [(True, 0.85), (False, 0.68)])
def test_main_text_without_any_names(tree, semantic, least):
    """Pages none of whose elements has a class, id or role that tells what it is."""
    rng, pairs = random.Random(903), []
    for _ in range(200):
        maker = labelled_pages._Maker(rng)
        maker.hints, maker.semantic = False, semantic
        pairs.append(maker.page())
    got = main_text.main_texts([a for a, _ in pairs], tree)
    assert np.mean([g == t for g, (_, t) in zip(got, pairs, strict=True)]) > least


def test_main_text_by_hand(spark, tree):
    page = (
        "<html><head><title>no</title><style>p{}</style></head><body><header class='site-header'><a href=/>Home</a></header><nav><ul><li><a href=/a>A</a></li></ul></nav>"
        "<div class='cookie-banner'><p>We use cookies here.</p><button>Fine</button></div><article><h1>A &lt;title&gt;</h1><p>First   para&amp;more,\nwith <b>bold</b> words that go on.<br>"
        "<p>Second paragraph, which is also rather long. It has two sentences.</p><script>var x='</p>'</script></article><aside class='sidebar'><p>Related things.</p></aside>"
        "<section id='comments'><h3>2 comments</h3><div class='comment'><p>I liked this a lot.</p></div></section><form class='search'><label>Find</label><input></form><footer>&copy; 2024 Me</footer>"
    )
    frame = spark.createDataFrame([(1, "u", page), (2, "v", None), (3, "w", ""), (4, "x", "<nav><a href=1>only</a></nav>")], "page_id long, url string, html string")
    got = {r["page_id"]: r for r in main_text.extract(frame.withColumn("text", F.lit("old")), tree).collect()}
    want = "A <title>\nFirst para&more, with bold words that go on.\nSecond paragraph, which is also rather long. It has two sentences."
    assert got[1]["text"] == want and got[1]["n_chars"] == len(want)
    assert [got[k]["text"] for k in (2, 3, 4)] == ["", "", ""] and got[2]["url"] == "v"


def test_messages_are_exact(tree):
    """Marginals equal sums over all labellings."""
    page = Page("<div><p>aa bb cc.</p><nav><a href=1>x</a></nav></div>")
    forest = main_text.Forest([page], tree.names)
    got = forest.marginals(tree.unary, tree.edge)
    n, weights = len(page.tag), []
    own = [tree.unary[forest.slots[a:b]].sum() for a, b in zip(forest.bounds[:-1], forest.bounds[1:], strict=True)]
    for mask in range(1 << n):
        y = [(mask >> k) & 1 for k in range(n)]
        weights.append((y, np.exp(sum(own[k] * y[k] for k in range(n)) + sum(tree.edge[forest.kind[k], y[forest.parent[k]], y[k]] for k in range(1, n)))))
    total = sum(w for _, w in weights)
    assert np.allclose(got, [sum(w for y, w in weights if y[k]) / total for k in range(n)])


@pytest.mark.parametrize("page", ["<a ", "<x>", "</y>", "<!", "<a \"'>", "<p><b '>", "İ<script>x</script>", "<title>", "<meta ", "<div></div>", "<li><td>"])
def test_time_is_linear_in_hostile_pages(page):
    for head in ("", "<p><button>" + "<x>" * 30_000, "a > b "):
        start = time.time()
        html_tree.Page(head + page * 30_000)
        warc.decoded((head + page * 30_000).encode(), "")
        assert time.time() - start < 5


def test_pages_hold_their_text_behind_odd_letters():
    assert html_tree.Page("<p>İ</p><SCRIPT>x</SCRIPT><p>kept</p>").text() == "İ\nkept"
    assert html_tree.Page("a<!-- b > c <p>d").text() == "a" and html_tree.Page("a<![CDATA[<b> & c").text() == "a<b> & c"
    assert html_tree.Page("<p>1 < 2 and <b").text() == "1 < 2 and <b"


def test_odd_markup():
    assert Page("<p>a<!-- <p>no</p> --><b>c").text() == "ac"
    assert Page("<ul><li>a<li>b</ul>c").text() == "a\nb\nc"
    assert Page("x < y & z <a title='>'>q</a>").text() == "x < y & z q"
    assert Page("<script>").text() == "" and Page("<p>a</p></p></div>b").text() == "a\nb"


# 6: BPE


def test_bpe_equals_the_library(spark):
    source = pretokens.tokenizer_text(None, "word_bpe_49k.json")
    library = pretokens.library(source)
    texts = [*ODD, *fuzz(2000, 4), "<|startoftext|>a<|endoftext|><|endoftext|>b"]
    got = {r["doc_id"]: r for r in pair_bpe.digests(docs(spark, texts)).collect()}
    for k, t in enumerate(texts):
        ids = library.encode(t or "", add_special_tokens=False).ids
        assert got[k]["n_tokens"] == len(ids) and got[k]["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert got[k]["decoded_sha256"] == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()
    both = pair_bpe.decode(pair_bpe.encode(docs(spark, texts).withColumn("token_ids", F.lit("clash")))).collect()
    assert all(r["decoded"] == library.decode(r["token_ids"], skip_special_tokens=False) for r in both)
    assert pair_bpe.with_tokens(docs(spark, [])).count() == 0


def test_a_lower_rank_interrupts():
    """A merge file in which a product has a lower rank than its parts."""
    vocab = {c: k for k, c in enumerate(pair_bpe.byte_letters())}
    for t in ("ab", "abc", "ca"):
        vocab[t] = len(vocab)
    data = {"model": {"vocab": vocab, "merges": [["ab", "c"], ["c", "a"], ["a", "b"]]}, "added_tokens": []}
    import json

    merges = pair_bpe.Merges.of(json.dumps(data))
    flat, bounds = pair_bpe.apply_merges(["abcabc", "ab", "cab"], merges)
    plain = []
    for word in ("abcabc", "ab", "cab"):
        parts = list(word)
        while True:
            ranked = [(data["model"]["merges"].index([x, y]), k) for k, (x, y) in enumerate(zip(parts, parts[1:], strict=False)) if [x, y] in data["model"]["merges"]]
            if not ranked:
                break
            _, k = min(ranked)
            parts[k : k + 2] = ["".join(parts[k : k + 2])]
        plain.append([vocab[p] for p in parts])
    assert [flat[a:b].tolist() for a, b in zip(bounds[:-1], bounds[1:], strict=True)] == plain


def test_byte_level_equals_the_library():
    source = pretokens.tokenizer_text(None, "byte_bpe_50k.json")
    made, library = pretokens.ByteTokenizer(source), pretokens.library(source)
    texts = [t or "" for t in [*ODD, *fuzz(3000, 6)]]
    flat, bounds = made.ids(Texts.of(texts))
    assert [flat[a:b].tolist() for a, b in zip(bounds[:-1], bounds[1:], strict=True)] == [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]


def test_a_byte_level_file_without_some_bytes():
    """The library drops such bytes, so tokens do not add up to their words."""
    told = json.loads(pretokens.tokenizer_text(None, "byte_bpe_50k.json"))
    told["model"]["merges"] = []
    told["model"]["vocab"] = {k: v for k, v in told["model"]["vocab"].items() if len(k) == 1 and k != "e"}
    source = json.dumps(told)
    made, library = pretokens.ByteTokenizer(source), pretokens.library(source)
    texts = ["", "e", "eee the tree", "a b", " e x e", "text"]
    flat, bounds = made.ids(Texts.of(texts))
    assert [flat[a:b].tolist() for a, b in zip(bounds[:-1], bounds[1:], strict=True)] == [library.encode(t, add_special_tokens=False).ids for t in texts]


# 7: Jaccard join


def shingles(text):
    words = WORD.findall(text or "")
    if not words:
        return None
    return {tuple(words)} if len(words) < 5 else {tuple(words[k : k + 5]) for k in range(len(words) - 4)}


def near_texts(seed=2):
    rng = random.Random(seed)
    texts = [None, "", "a b", "a b", "one two three four five"]
    for _ in range(25):
        base = prose(rng, rng.randint(30, 200)).split()
        texts.append(" ".join(base))
        for _ in range(rng.randint(0, 6)):
            other = base.copy()
            for _ in range(rng.randint(0, 4)):
                other[rng.randrange(len(other))] = "changed" + str(rng.random())
            texts.append("  ".join(other) if rng.random() < 0.3 else " ".join(other))
    base = prose(rng, 400).split()
    for k in range(150):  # one large group of near copies
        other = base.copy()
        other[k * 2] = f"v{k}"
        texts.append(" ".join(other))
    texts += [" ".join(base)] * 40
    return texts


def by_hand(texts, ids):
    sets = [shingles(t) for t in texts]
    links = [[v for v in range(len(texts)) if v != u and sets[u] and sets[v] and len(sets[u] & sets[v]) >= 0.8 * len(sets[u] | sets[v])] for u in range(len(texts))]
    name = [-1] * len(texts)
    for u in range(len(texts)):
        if name[u] == -1:
            seen, todo = {u}, [u]
            while todo:
                for v in links[todo.pop()]:
                    if v not in seen:
                        seen.add(v)
                        todo.append(v)
            least = min((ids[v] for v in seen if ids[v] is not None), default=None)
            for v in seen:
                name[v] = least
    return name, [len(x) for x in links]


@pytest.mark.parametrize("join", [chosen_path.Join(), chosen_path.Join(small=4, pays=9, depth=4, block=16, tile=5), chosen_path.Join(small=24, pivots=2, pays=0, block_tokens=300, tile=16)])
def test_classes_by_brute_force(spark, join):
    texts = near_texts()
    ids = list(range(len(texts)))
    random.Random(9).shuffle(ids)
    got = {r["doc_id"]: r for r in chosen_path.classes(docs(spark, texts, ids=ids), join).collect()}
    names, links = by_hand(texts, ids)
    assert all((got[d]["class_id"], got[d]["n_links"]) == (c, n) for d, c, n in zip(ids, names, links, strict=True))


def test_links_count_once_where_blocks_are_empty(spark):
    """Groups of a few long sets, with more blocks than members."""
    rng = random.Random(6)
    texts = []
    for n in (2, 2, 2, 3, 3, 5):
        base = prose(rng, 60).split()
        texts += [" ".join([*base, f"end{k}"]) for k in range(n)]
    ids = list(range(len(texts)))
    got = {r["doc_id"]: r for r in chosen_path.classes(docs(spark, texts), chosen_path.Join(block_tokens=20)).collect()}
    names, links = by_hand(texts, ids)
    assert max(links) == 4 and [(got[d]["class_id"], got[d]["n_links"]) for d in ids] == list(zip(names, links, strict=True))


def test_sketches_of_tiny_sets_agree():
    """Pairs of 4 and 5 tokens, exactly at the similarity."""
    join, rng, missed = chosen_path.Join(), np.random.default_rng(5), 0
    p = join.similarity + (1 - join.similarity) / 4
    least = chosen_path.SKETCH * (p - join.slack * (p * (1 - p) / chosen_path.SKETCH) ** 0.5)
    for tokens in rng.integers(0, 2**64, (10_000, 5), dtype=np.uint64):
        x = np.frombuffer(chosen_path._sketch(tokens[:4]), np.uint8) ^ np.frombuffer(chosen_path._sketch(tokens), np.uint8)
        missed += sum(((x >> s) & 3 == 0).sum() for s in (0, 2, 4, 6)) < least
    assert missed <= 2


def test_recall_at_the_defaults():
    """Pairs exactly at the similarity, through paths and sketches at the production
    parameters; a shared node at the first level is enough, and one is asked for at the second."""
    join, rng = chosen_path.Join(), np.random.default_rng(9)
    roots, found, deep, n = chosen_path._roots(join), 0, 0, 600
    least = join.least()
    for _ in range(n):
        tokens = rng.integers(0, 2**64, 90, dtype=np.uint64)
        pair = [np.sort(tokens[:81]), np.sort(np.concatenate([tokens[:72], tokens[81:]]))]  # 72 of 90
        held = []
        for own in pair:
            sample = own[: join.sample]
            _, first = chosen_path._children(roots, np.zeros(len(roots), np.int64), sample, np.array([len(sample)]), join.branch)
            _, second = chosen_path._children(first, np.zeros(len(first), np.int64), sample, np.array([len(sample)]), join.branch)
            held.append((set(first.tolist()), set(second.tolist())))
        x = np.frombuffer(chosen_path._sketch(pair[0]), np.uint8) ^ np.frombuffer(chosen_path._sketch(pair[1]), np.uint8)
        near = sum(((x >> s) & 3 == 0).sum() for s in (0, 2, 4, 6)) >= least
        found += near and bool(held[0][0] & held[1][0])
        deep += near and bool(held[0][1] & held[1][1])
    assert found >= 0.995 * n and deep >= 0.99 * n


@pytest.mark.parametrize("share", [0.3, 0.6])
def test_buckets_with_a_common_passage(spark, share):
    """Many texts share a passage without being near; near copies among them are found."""
    rng = random.Random(12)
    passage = prose(rng, int(150 * share)).split()
    texts = []
    for k in range(160):
        own = prose(rng, 150 - len(passage)).split()
        texts.append(" ".join(passage + own))
        if k % 20 == 0:
            texts.append(" ".join([*passage, *own[:-1], f"end{k}"]))
    ids = list(range(len(texts)))
    got = {r["doc_id"]: r for r in chosen_path.classes(docs(spark, texts), chosen_path.Join(small=16)).collect()}
    names, links = by_hand(texts, ids)
    assert sum(links) == 16 and [(got[d]["class_id"], got[d]["n_links"]) for d in ids] == list(zip(names, links, strict=True))


def test_keep_one_of_each_class(spark):
    texts = [t for t in near_texts(4)[:60]]
    ids = [k if k % 9 else None for k in range(len(texts))]
    frame = docs(spark, [*texts, texts[7], texts[7]], ids=[*ids, ids[7], 500]).withColumn("text_key", F.lit("own"))
    kept = chosen_path.keep_one(frame)
    rows = kept.collect()
    assert kept.columns == frame.columns and {r["text_key"] for r in rows} == {"own"}
    names, _ = by_hand(texts, list(range(len(texts))))
    wordless = [t for t in texts if not shingles(t)]
    classes = {c for c, t in zip(names, texts, strict=True) if shingles(t)}
    assert len(rows) == len(classes) + len(wordless)
    where = {}
    for c, t in zip(names, texts, strict=True):
        where.setdefault(t, c)
    assert {where[r["text"]] for r in rows if shingles(r["text"])} == classes
    assert chosen_path.keep_one(docs(spark, [])).count() == 0 and chosen_path.classes(docs(spark, [])).count() == 0


def test_components(spark):
    edges = [(k, k + 1) for k in range(0, 40)] + [(100, 101), (101, 102), (50, 50)]
    got = {r["v"]: r["c"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert {got[k] for k in range(41)} == {0} and {got[k] for k in (100, 101, 102)} == {100}


# 9: vectors


def nearest_by_hand(rows, k):
    fine = [(i, np.array(v, float)) for i, v in rows if i is not None and v is not None and None not in v and np.isfinite(np.array(v, float)).all() and np.any(np.array(v, float))]
    out = {}
    for i, v in fine:
        if i % 50 == 0:
            best = out.setdefault(i, {})
            for j, w in fine:
                if j != i and len(w) == len(v):
                    s = (v * w).sum() / (np.sqrt((v * v).sum()) * np.sqrt((w * w).sum()))
                    best[j] = max(best.get(j, -9), s)
    return {i: sorted(best.items(), key=lambda x: (-x[1], x[0]))[:k] for i, best in out.items()}


def test_nearest_by_brute_force(spark):
    rng = np.random.default_rng(3)
    rows = [(k, rng.normal(size=8).tolist()) for k in range(400)]
    rows += [(1000 + k, rows[0][1]) for k in range(150)]  # ties
    rows += [(2000, None), (2001, [0.0] * 8), (2002, [float("nan")] * 8), (2050, [None] * 8), (2003, [1.0, 2.0]), (2100, [2.0, 1.0]), (None, rows[3][1]), (7, rows[7][1]), (2150, [1e-30] * 8)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {}
    how = vector_join.Search(stripe=64, group=5, least=16, tile=32, rows=4)
    for r in vector_join.search(frame.where("vec_id % 50 = 0"), frame, how).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    want = nearest_by_hand(rows, 5)
    assert {q: [v for _, v, _ in sorted(x)] for q, x in got.items()} == {q: [v for v, _ in x] for q, x in want.items() if x}
    for q, x in got.items():
        assert np.allclose([s for _, _, s in sorted(x)], [s for _, s in want[q]], rtol=0, atol=1e-15)
    assert vector_join.search(frame.limit(0), frame).count() == 0 and vector_join.search(frame.where("vec_id = 0"), frame.limit(0)).count() == 0


def test_error_bounds_hold():
    rng = np.random.default_rng(1)
    a, b = rng.normal(size=(40, 64)), rng.standard_cauchy(size=(50, 64))
    near, off = vector_join.tile_bounds(vector_join.Quantised(a), slice(0, 40), vector_join.Quantised(b), slice(0, 50))
    exact = (a @ b.T) / np.linalg.norm(a, axis=1)[:, None] / np.linalg.norm(b, axis=1)[None, :]
    assert (np.abs(near - exact) <= off).all() and off.max() < 0.5


# 8 and 10: quality


def base_by_hand(text):
    text = text or ""
    words = WORD.findall(text)
    runs = {}
    for k in range(len(words) - 7):
        runs.setdefault(tuple(words[k : k + 8]), []).append(k)
    covered = {p for at in runs.values() if len(at) > 1 for k in at for p in range(k, k + 8)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    n = len(words)
    return (n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered), n < 20 or 100 * len(covered) > 30 * n)


def labelled(spark, n=400, seed=0):
    """Good texts are of one alphabet, bad ones of another with symbols."""
    rng = random.Random(seed)
    rows, marks = [], []
    for k in range(n):
        good = rng.random() < 0.6
        words = [("".join(rng.choice("aeiourst" if good else "aeiouxzq") for _ in range(rng.randint(2, 8)))) + ("" if good else rng.choice(["", "%%", "##"])) for _ in range(rng.randint(25, 200))]
        rows.append((k, " ".join(words), "en", "s", 0))
        marks.append((k, int(good), 0))
    return spark.createDataFrame(rows, DOCS), spark.createDataFrame(marks, "doc_id long, quality int, toxic int")


def accuracy(frame, labels, column):
    rows = frame.join(labels, "doc_id").where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2).select((F.col(column).cast("int") == F.col("quality")).alias("ok")).collect()
    return np.mean([r["ok"] for r in rows])


def test_base_counts(spark):
    rng = random.Random(3)
    loop = prose(rng, 12)
    texts = [*ODD, loop + " " + loop + " " + prose(rng, 30), "\n".join(["same line here"] * 9 + ["other"]), " \n".join(prose(rng, 4) for _ in range(20)), *fuzz(200, 1), "w " * 5000]
    frame, labels = labelled(spark, 60)
    model = quality_rules.fit(frame, labels, quality_rules.Rules(steps=5))
    got = {r["doc_id"]: r for r in quality_rules.score(docs(spark, texts), model).collect()}
    for k, t in enumerate(texts):
        assert tuple(got[k][c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")) == base_by_hand(t), repr(t)[:80]
        assert not (got[k]["base_failed"] and got[k]["kept"])


def test_quality_rules_learn(spark):
    frame, labels = labelled(spark)
    model = quality_rules.fit(frame, labels)
    assert accuracy(quality_rules.score(frame, model), labels, "kept") > 0.9
    kept = quality_rules.keep(frame.withColumn("Kept", F.lit("mine")), frame, labels)
    assert kept.columns[-1] == "Kept" and kept.first()["Kept"] == "mine"


def test_network_learns(spark):
    frame, labels = labelled(spark)
    net = byte_cnn.fit(frame, labels)
    scored = byte_cnn.score(frame, net)
    assert accuracy(scored.withColumn("p", F.col("score") >= 0.5), labels, "p") > 0.9
    odd = byte_cnn.score(docs(spark, [*ODD, "x" * 200_000]), net).collect()
    assert len(odd) == len(ODD) + 1 and all(0 <= r["score"] <= 1 for r in odd)
    kept = byte_cnn.keep(frame.withColumn("score", F.lit("mine")), frame, labels, 0.5)
    assert kept.columns[-1] == "score" and kept.first()["score"] == "mine"


def test_network_reads_the_whole_text(spark):
    """A long text's score moves when only its end changes."""
    frame, labels = labelled(spark)
    net = byte_cnn.fit(frame, labels)
    good = "aes tor uis " * 600
    a, b = (r["score"] for r in byte_cnn.score(docs(spark, [good, good[:3600] + "xq%% zx## " * 360]), net).orderBy("doc_id").collect())
    assert a != b


def test_logits_equal_a_plain_convolution():
    """Every window of every half, the largest of each two halves, the mean over them."""
    rng = np.random.default_rng(2)
    shape = byte_cnn.Shape(filters=5, half=16, width=6)
    net = byte_cnn.Network(rng.normal(size=(6, 256, 5)), rng.normal(size=5), rng.normal(size=5), 0.3, 1.0, 0.0, shape)
    texts = ["", "a", "short text", "x" * 16, "long text é " * 30, None]
    got = byte_cnn.logits(Texts.of(texts), net, byte_cnn._pairs(net))
    for text, z in zip(texts, got, strict=True):
        data = (text or "").encode()
        n = -(-(len(data) + 5) // 16)
        data += bytes(n * 16 + 6 - len(data))
        tops = []
        for half in range(n):
            own = [max(0.0, *(net.bias[f] + sum(net.filters[j, data[p + j], f] for j in range(6)) for p in range(half * 16, half * 16 + 16) if p + 6 <= n * 16)) for f in range(5)]
            tops.append(np.array(own))
        chunks = [np.maximum(a, b) for a, b in zip(tops, tops[1:])] or tops
        assert z == pytest.approx(np.mean(chunks, axis=0) @ net.out + 0.3, abs=1e-4)


def test_all_chunks_of_a_text_are_fitted():
    shape = byte_cnn.Shape()
    texts = Texts.of(["", "x" * 10, "y" * 100_000])
    x, owner = byte_cnn._chunks(texts, shape)
    assert list(np.bincount(owner)) == [1, 1, -(-100_005 // 128) - 1] and (x[owner == 2] == ord("y")).any(axis=1).all()
    assert (x[1, :10] == ord("x")).all() and not x[0].any() and not x[1, 10:].any()


def test_raw_scores_equal_a_plain_sum():
    rules = quality_rules.Rules(bits=8)
    model = quality_rules.RuleModel(np.random.default_rng(3).normal(size=(2, 256)).astype(np.float32), 0.25, 1.0, 0.0, rules)
    texts = Texts.of(["", "one", "two words here", "é x\n\ty é", "z" * 500])
    words = Words(texts)
    hashes = words.hashes()
    got = quality_rules.raw_scores(texts, words, hashes, model)
    for r in range(texts.rows):
        alone = Texts.of([texts.row(r).decode()])
        own = Words(alone)
        sums, counts = [0.0, 0.0], [0, 0]
        for family, _, ids in quality_rules.gram_ids(alone, own, own.hashes(), rules):
            for i in ids.tolist():
                sums[family] += float(model.weights[family][i])
                counts[family] += 1
        data = texts.row(r)
        assert counts[1] == sum(max(len(data) - k + 1, 0) for k in (2, 3, 4)) and counts[0] == sum(max(len(data.split()) - k + 1, 0) for k in (1, 2))
        assert got[r] == pytest.approx(0.25 + sum(s / max(c, 1) for s, c in zip(sums, counts, strict=True)))


def test_one_text_of_a_repeated_id_is_fitted(spark):
    frame, labels = labelled(spark, 60)
    again = frame.unionByName(frame.where("doc_id < 30").withColumn("text", F.concat("text", F.lit(" again")))).unionByName(frame.where("doc_id = 1").crossJoin(spark.range(500)).drop("id"))
    rows = training_rows(again, labels, "quality", 20, 3).collect()
    assert len(rows) == len({r["doc_id"] for r in rows}) <= 40
    assert sorted(map(str, rows)) == sorted(map(str, training_rows(again.repartition(7), labels, "quality", 20, 3).collect()))


@pytest.mark.parametrize("which", ["none", "one class", "nulls"])
def test_models_without_labels(spark, which):
    frame, labels = labelled(spark, 40)
    labels = {"none": labels.limit(0), "one class": labels.where("quality = 1"), "nulls": labels.withColumn("quality", F.lit(None).cast("int"))}[which]
    assert byte_cnn.score(frame, byte_cnn.fit(frame, labels)).count() == 40
    assert quality_rules.score(frame, quality_rules.fit(frame, labels)).count() == 40
    assert quality_rules.score(frame.limit(0), quality_rules.fit(frame.limit(0), labels)).count() == 0


def test_crc_of_ids(spark):
    rows = spark.range(50).select("id", byte_cnn.held_out_flag("id").alias("h")).collect()
    assert all(r["h"] == (zlib.crc32(str(r["id"]).encode()) % 4 == 2) for r in rows)


# the pipeline


def test_pipeline_stages(spark, tmp_path):
    pipeline = pytest.importorskip("corpus_pipeline")
    data = "/root/testdata/sf0.001"
    if not os.path.isdir(data):
        pytest.skip("no test tables here")
    frame = spark.read.parquet(f"{data}/documents.parquet")
    columns = frame.columns
    assert [n for n, _ in pipeline.STAGES] == ["quality_rules", "quality_classifier", "jaccard_join", "mixing", "bpe_encoding"]
    before = frame
    for k, (name, stage) in enumerate(pipeline.STAGES):
        stage(spark, before, data).write.parquet(f"{tmp_path}/{k}")
        after = spark.read.parquet(f"{tmp_path}/{k}")
        old, new = before.collect(), after.collect()
        ids = {r["doc_id"] for r in new}
        assert ids <= {r["doc_id"] for r in old}, name
        if name == "jaccard_join":
            names, _ = by_hand([r["text"] for r in old], [r["doc_id"] for r in old])
            assert len(new) == len(set(names)) and ids == set(names)
        if name == "bpe_encoding":
            library = pretokens.library(pretokens.tokenizer_text(None, "word_bpe_49k.json"))
            texts = {r["doc_id"]: r["text"] for r in old}
            assert len(new) == len(old) and all(r["token_ids"] == library.encode(texts[r["doc_id"]], add_special_tokens=False).ids for r in new)
        else:
            assert after.columns == columns
        before = after
