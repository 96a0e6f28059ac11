"""The training-data operators against brute force, libraries and hand-made cases."""

import hashlib
import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from lagspark.llm import (
    ann, embedding_dedup, html_extract, language_id, line_dedup, minhash_dedup, mixing, sentencepiece_codec, substring_dedup, toxicity,
)
from lagspark.llm.common import tokenizer_path
from lagspark.llm.components import components
from pyspark.sql import functions as F

DOCS = "doc_id long, text string"


def rows(df, *keys):
    return {tuple(r[k] for k in keys) if len(keys) > 1 else r[keys[0]]: r for r in df.collect()}


# 1. SentencePiece.


@pytest.fixture(scope="module")
def model():
    return sentencepiece_codec.load_model(tokenizer_path("piece_bpe_32k.model"))


def test_codec_equals_library(model):
    sp = pytest.importorskip("sentencepiece").SentencePieceProcessor(model_proto=model)
    codec, rng = sentencepiece_codec.Codec(model), random.Random(1)
    letters = " ab \n\t▁éßñ日本😀\0<s></s>&#$%1290 the <0x0A>⁇"
    texts = ["", " ", "  ", " x", "x ", "▁", "a" * 500, " " * 200, "�"]
    texts += ["".join(rng.choice(letters) for _ in range(rng.randint(0, 60))) for _ in range(1500)]
    texts += ["".join(rng.choice("ethaisnor") for _ in range(rng.randint(1, 400))) for _ in range(200)]
    codec.learn_runs(run for t in texts[::2] for run in codec.split(t))
    for text in texts:
        want = sp.encode(text, add_bos=True, add_eos=True)
        assert codec.encode(text).tolist() == want, text
        assert codec.decode(want) == sp.decode(want), text


def test_codec_spans_tile_the_text(model):
    codec = sentencepiece_codec.Codec(model)
    for text in ("Hello  world", "é▁x 😀 y", " lead"):
        begins, ends = codec.spans(text, codec.encode(text))
        assert begins[0] == ends[0] == 0 and ends[-1] == len(text.encode())
        assert begins[1:].tolist() == ends[:-1].tolist()


def test_charmap_longest_prefix():
    # A trie with the keys "a" -> "x" and "ab" -> "yz", units laid out by hand.
    units = [0] * 1024

    def node(index, label, offset, leaf):
        units[index] = label | (leaf << 8) | (offset << 10)

    node(0, 0, 256, 0)
    a = 256 ^ ord("a")
    node(a, ord("a"), 512, 1)
    value = a ^ 512
    units[value] = 0x80000000 | 0
    b = value ^ ord("b")
    node(b, ord("b"), 128, 1)
    units[b ^ 128] = 0x80000000 | 2
    blob = (4 * len(units)).to_bytes(4, "little") + np.array(units, "<u4").tobytes() + b"x\0yz\0"
    charmap = sentencepiece_codec.CharMap(blob)
    assert charmap.longest(b"abc", 0) == (2, b"yz")
    assert charmap.longest(b"ac", 0) == (1, b"x")
    assert charmap.longest(b"c", 0) is None


def test_encode_rows(spark, model):
    data = [(1, "Hello world"), (1, "Hello world"), (2, None), (3, "")]
    out = sentencepiece_codec.encode(spark.createDataFrame(data, DOCS), model, columns=["n_tokens", "ids", "decoded"]).collect()
    assert len(out) == 4
    for r in out:
        assert r["decoded"] == ("Hello world" if r["doc_id"] == 1 else "")
        assert r["n_tokens"] == len(r["ids"])
    assert sentencepiece_codec.encode(spark.createDataFrame([], DOCS), model).count() == 0


# 2. Mixing.


def edf(shares, frame):
    had, out = [0] * len(shares), []
    for t in range(frame):
        ready = [(-(-(c + 1) * frame // a), i) for i, (c, a) in enumerate(zip(had, shares)) if c * frame // a <= t]
        had[min(ready)[1]] += 1
        out.append(min(ready)[1])
    return out


def test_mixing_deviates_less_than_a_block(spark):
    data = [(i, f"s{min(9, int(i ** 0.4))}") for i in range(3000)] + [(5000 + i, None) for i in range(40)]
    out = mixing.schedule(spark.createDataFrame(data, "doc_id long, source string"), frame=64, block=4).toPandas()
    assert sorted(out["position"]) == list(range(len(data)))
    assert ((out["release"] <= out["slot"]) & (out["slot"] < out["deadline"])).all()
    blocks = out.drop_duplicates(["slot"])
    assert (out.groupby("slot")[["block"]].nunique() == 1).all().all()
    order = out.sort_values(["slot", "position"])
    assert (order["position"].diff().dropna() == 1).all()
    per_frame = blocks[blocks["slot"] < 64].fillna({"source": ""}).groupby("source").size()
    full = {s: n for s, n in per_frame.items()}
    picked = blocks[blocks["slot"] < 64].sort_values("slot")
    if len(picked) == 64:  # no source has run out yet
        seen = Counter()
        for t, s in enumerate(picked["source"].fillna(""), 1):
            seen[s] += 1
            assert all(abs(seen[x] - full[x] * t / 64) < 1 for x in full)


def test_mixing_weights_order_and_empty(spark):
    docs = spark.createDataFrame([(i, "ab"[i % 2], "x") for i in range(40)], "doc_id long, source string, slot string")
    out = mixing.mix(docs, {"a": 3.0, "b": 1.0}, partitions=2, frame=8, block=1)
    assert out.columns == docs.columns
    first = [r["source"] for r in out.collect()[:20]]
    assert first.count("a") == 15
    assert mixing.schedule(spark.createDataFrame([], "doc_id long, source string")).count() == 0
    one = spark.range(1).select(F.array(*[F.lit(a).cast("long") for a in (5, 2, 1)]).alias("a")).select(mixing._frame(8).alias("p")).first()["p"]
    assert [x["pick"] for x in one] == edf([5, 2, 1], 8)


def test_mix_follows_the_given_weights(spark):
    """Over several frames, with weights that are no whole shares of one: less than one block off."""
    sizes = [1200] + [400] * 19
    data = [(i, f"s{k:02}") for i, k in enumerate(k for k, n in enumerate(sizes) for _ in range(n))]
    given = {f"s{k:02}": math.sqrt(n) for k, n in enumerate(sizes)}
    docs = spark.createDataFrame(data, "doc_id long, source string")
    order = [r["source"] for r in mixing.mix(docs, given, partitions=4, frame=128, block=1).collect()]
    assert sorted(order) == sorted(s for _, s in data)
    total, seen = sum(given.values()), Counter()
    for t, s in enumerate(order[:6000], 1):
        seen[s] += 1
        assert all(abs(seen[k] - w / total * t) < 1 for k, w in given.items()), t
    picks, slots = mixing.earliest_deadlines(mixing.whole_weights([0.5] + [0.5 / 255] * 255, 1024), [20000] + [100] * 255)
    first = picks[slots < 20000]
    assert abs((first == 0).sum() - 10000) < 1 and len(picks) == 45500 and len(set(slots.tolist())) == 45500


# 3. HTML.


def test_html_main_text():
    page = (
        "<body><header>Top</header><div class='cookie-notice'>We use</div><article><header><h1>T &amp; x</h1></header><p>a <b>b</b>c<p>d"
        "<ul><li>one<li>two</ul><table><tr><td>x<td>y</table><section id=comments><p>reader</p></section><script>var t='</p>';</script>"
        "</article><aside>side</aside><form><p>f</p></form><footer>f"
    )
    assert html_extract.main_text(html_extract.parse(page)) == "T & x\na bc\nd\none\ntwo\nx\ny"
    assert html_extract.main_text(html_extract.parse("")) == ""
    assert html_extract.main_text(html_extract.parse("1 < 2 &lt;b&gt;<p>x&nbsp; y<br>z")) == "1 < 2 <b>\nx y z"


def test_html_template_is_dropped(spark):
    page = "<body><div><p>Same box</p></div><div><p>Text {0}</p></div></body>"
    data = [(i, "http://a.example/x", page.format(i)) for i in range(8)] + [(99, None, None), (100, "http://b.example/", page.format(1))]
    out = rows(html_extract.extract(spark.createDataFrame(data, "page_id long, url string, html string")), "page_id")
    assert all(out[i]["text"] == f"Text {i}" for i in range(8))
    assert out[99]["text"] == "" and out[99]["n_chars"] == 0
    assert out[100]["text"] == "Same box\nText 1"
    article = "<body><article><p>Shared</p></article></body>"
    same = spark.createDataFrame([(i, "http://a.example/", article) for i in range(9)], "page_id long, url string, html string")
    assert {r["text"] for r in html_extract.extract(same).collect()} == {"Shared"}
    assert html_extract.extract(same.limit(0)).count() == 0


# 4. Nearest neighbours and 8. embedding dedup.


@pytest.fixture(scope="module")
def vectors(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(300, 16))
    x[50:90] = x[50] + rng.normal(size=(40, 16)) * 0.02
    x[120:123] = x[119]
    data = [(i, v.astype(np.float32).tolist()) for i, v in enumerate(x)]
    data += [(300, None), (301, [0.0] * 16), (302, [float("nan")] * 16), (303, [None] + [1.0] * 15), (None, [1.0] * 16), (7, data[7][1])]
    return spark.createDataFrame(data, "vec_id long, embedding array<float>"), np.array([v for _, v in data[:300]], float)


def test_nearest_is_exact(vectors):
    df, x = vectors
    out = rows(ann.nearest(df, F.col("vec_id") % 20 == 0, 20, candidate_block=100, query_block=7), "query_id", "rank")
    assert len(out) == 15 * 20
    for q in range(0, 300, 20):
        s = (x[q] * x).sum(axis=1)
        s[q] = -np.inf
        best = np.lexsort((np.arange(300), -s))[:20]
        assert [out[q, r]["vec_id"] for r in range(1, 21)] == best.tolist()
        assert all(math.isclose(out[q, r]["score"], s[out[q, r]["vec_id"]], rel_tol=1e-12) for r in range(1, 21))


def test_embedding_links_are_exact(vectors):
    df, x = vectors
    out = embedding_dedup.near_duplicates(df, 0.95, chunk=64)
    assert out.count() == df.count()
    out = rows(out, "vec_id")
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    links = u @ u.T >= 0.95
    np.fill_diagonal(links, False)
    reach = links | np.eye(300, dtype=bool)
    for _ in range(8):
        reach = reach @ reach
    for i in range(300):
        assert out[i]["n_links"] == links[i].sum()
        assert out[i]["component_id"] == np.nonzero(reach[i])[0][0]
        assert out[i]["kept"] == (out[i]["component_id"] == i)
    assert out[301]["n_links"] == 0 and out[None]["kept"]
    assert embedding_dedup.near_duplicates(df.limit(0)).count() == 0
    assert ann.nearest(df.limit(0), F.col("vec_id") % 20 == 0).count() == 0


def test_links_across_nodes_of_several_levels():
    """Graded, overlapping clusters in one chunk, so that pairs are opened over more than one level."""
    rng = np.random.default_rng(11)
    x = []
    for _ in range(6):
        centre = rng.normal(size=8)
        for _ in range(12):
            near = centre + rng.normal(size=8) * 0.35
            x += [near + rng.normal(size=8) * s for s in np.linspace(0.02, 0.25, 10)]
    x = np.array(x)[rng.permutation(len(x))]
    blobs = [v.astype("<f8").tobytes() for v in x]
    n = len(x)
    table = pa.table({"id": pa.array(range(n), pa.int64()), "dim": pa.array([8] * n, pa.int32()), "vec": blobs, "chunk": pa.array([0] * n, pa.int32())})
    table = embedding_dedup._levels(table)
    for name in ("one", "two"):
        table = table.append_column(name, pa.array([0] * n, pa.int32()))
    side = embedding_dedup.Side(table)
    sizes = [len(level[1]) for level in side.levels]
    assert sum(2 * a <= b for a, b in zip(sizes, sizes[1:])) >= 2  # three levels at least are opened
    got = embedding_dedup._traverse(table, 0.95, math.sqrt(0.1)).to_pydict()
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    links = u @ u.T >= 0.95
    np.fill_diagonal(links, False)
    assert dict(zip(got["id"], got["n"])) == {i: k for i, k in enumerate(links.sum(axis=1).tolist()) if k}


def test_components(spark):
    edges = [(i, i + 1) for i in range(0, 20)] + [(100, 101), (5, 5), (101, 100), (None, 3)]
    out = rows(components(spark.createDataFrame(edges, "a long, b long"), "a", "b", "id", "c"), "id")
    assert all(out[i]["c"] == 0 for i in range(21)) and out[101]["c"] == 100


# 5. Lines.


def test_line_dedup(spark):
    data = [(i, "s", f"same line \nown {i}\n\nown {i}") for i in range(20)] + [(50, "t", "same line"), (51, None, None), (52, "s", "")]
    docs = spark.createDataFrame(data, "doc_id long, source string, text string").withColumn("__x", F.lit(1))
    out = rows(line_dedup.drop_boilerplate(docs, 0.5, 5, counts=True), "doc_id")
    assert out[3]["text"] == "own 3\n\nown 3" and out[3]["n_lines"] == 4 and out[3]["n_dropped"] == 1
    assert out[50]["text"] == "same line" and out[51]["text"] is None and out[52]["text"] == ""
    assert line_dedup.drop_boilerplate(docs.limit(0)).count() == 0


# 6. Repeated windows.


def brute_windows(texts, width):
    words = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for t in texts]
    seen = Counter(tuple(w[i : i + width]) for w in words for i in range(len(w) - width + 1))
    out = []
    for w in words:
        gone = set()
        for i in range(len(w) - width + 1):
            if seen[tuple(w[i : i + width])] > 1:
                gone |= set(range(i, i + width))
        out.append((len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone)))
    return out


def test_substring_dedup(spark, monkeypatch):
    monkeypatch.setattr(substring_dedup, "UNIT", 65_536)
    rng = random.Random(2)
    texts = [" ".join(rng.choice("abcd") for _ in range(rng.randint(0, 60))) for _ in range(120)]
    texts += [texts[0], texts[0], None, "", "a\x0bb\xa0c", "x " * 200] + [f"{i} " + " ".join("pqrstuvw") + f" {i}" for i in range(5)]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(0, texts[0])], DOCS)
    want = brute_windows([*texts, texts[0]], 7)
    out = substring_dedup.repeats(docs, 7, bucket=100).collect()
    assert len(out) == len(want)
    for r in out:
        assert (r["n_words"], r["n_removed"], r["kept"]) == want[r["doc_id"]]
        assert sum(b - a for a, b in zip(r["starts"], r["ends"])) == r["n_removed"]
    digest = rows(substring_dedup.digests(docs, 7), "doc_id")
    assert digest[5]["kept_sha256"] == hashlib.sha256(want[5][2].encode()).hexdigest()
    assert substring_dedup.repeats(docs.limit(0), 7).count() == 0


# 7. Toxicity.


def test_grammar_states():
    g = toxicity.Grammar({"fool": 4.0}, {"scoun": 3.0})
    score = lambda t: g.features(t)[1]
    assert score("a scoundrel here") == 3.0
    assert score("you fool") > score("a fool") > score("he said a fool") and score("a fool") > score("not a fool")
    assert score("nothing. here") == 0 and g.features("")[3] == 0


def test_toxicity_learns(spark):
    rng = random.Random(4)
    words = ["".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(300)]
    data, labels = [], []
    for i in range(400):
        text = [rng.choice(words) for _ in range(40)]
        if i % 4 == 0:
            text[rng.randrange(40)] = "zonk" + rng.choice(["el", "or", "us"])
        data.append((i, " ".join(text)))
        labels.append((i, int(i % 4 == 0)))
    docs = spark.createDataFrame([*data, (900, None), (901, "")], DOCS)
    marks = spark.createDataFrame([*labels, (3, None)], "doc_id long, toxic int")
    scorer = toxicity.learn(docs, marks, F.col("doc_id") < 300)
    out = rows(toxicity.score(docs, scorer), "doc_id")
    assert sum(out[i]["predicted"] == int(i % 4 == 0) for i in range(300, 400)) >= 97
    assert out[900]["predicted"] == 0 and 0 <= out[901]["score"] <= 1
    assert toxicity.score(docs, toxicity.learn(docs, marks.limit(0), F.lit(True))).count() == docs.count()


def test_fixed_words_count_beside_learned_ones():
    g = toxicity.Grammar({"zonk": 4.0}, {})
    score = lambda t: g.features(t)[1]
    assert score("a moron") == score("they kill") / 2 == toxicity.FIXED_WEIGHT
    assert score("i will kill you") > score("i will kill") > 0 and score("moron you") < score("kill you")
    assert toxicity.Grammar({"kill": 5.0}, {}).symbol("kill") == (toxicity.THREAT, 5.0)


def test_rare_insults_are_learned_from_distinct_texts(spark):
    rng = random.Random(12)
    words = ["".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(300)]
    text = lambda *more: " ".join([rng.choice(words) for _ in range(30)] + list(more))
    data = [text("zonkel") if i % 2 else text() for i in range(1600)]
    for i in range(1, 41, 2):
        data[i] = text("quirrik")
    copy = text("vexxop")
    for i in range(101, 221, 2):
        data[i] = copy
    docs = spark.createDataFrame(list(enumerate(data)), DOCS)
    marks = spark.createDataFrame([(i, i % 2) for i in range(1600)], "doc_id long, toxic int")
    grammar = toxicity.learn(docs.where("doc_id > 20"), marks, F.lit(True)).grammar  # 10 of 790 toxic texts hold the rare word
    assert "zonkel" in grammar.words and "quirrik" in grammar.words and "vexxop" not in grammar.words


# 9. Language.


def test_language_id(spark):
    rng = random.Random(5)
    make = {"aa": "abcde", "bb": "defgh", "cc": "xyzuv"}
    text = lambda k, n: " ".join("".join(rng.choice(make[k]) for _ in range(5)) for _ in range(n))
    data = [(i, text(k, 30), k) for i, k in enumerate(rng.choice(list(make)) for _ in range(200))]
    data += [(500, None, "aa"), (501, "12 .. 3", "aa"), (502, text("aa", 60) + " " + text("cc", 40), None), (503, "", None)]
    docs = spark.createDataFrame(data, "doc_id long, text string, lang string")
    model = language_id.learn(docs, F.col("doc_id") < 100)
    out = rows(language_id.identify(docs, model), "doc_id")
    assert all(out[i]["lang_pred"] == data[i][2] for i in range(100, 200))
    assert [out[i]["lang_pred"] for i in (500, 501, 503)] == ["und"] * 3
    assert out[502]["languages"] == ["aa", "cc"] and abs(out[502]["proportions"][1] - 0.4) < 0.05
    assert language_id.keep_identified(docs, model).count() == 201
    nothing = language_id.learn(docs.where("lang IS NULL"), F.lit(True))
    assert {r["lang_pred"] for r in language_id.identify(docs, nothing).collect()} == {"und"}


# 10. Near duplicates.


def test_distance_is_that_of_the_longest_common_subsequence():
    rng = random.Random(6)
    for _ in range(200):
        a = rng.sample(range(40), rng.randint(1, 30))
        b = [x for x in a if rng.random() < 0.8] + rng.sample(range(100, 120), rng.randint(0, 6))
        if rng.random() < 0.3:
            rng.shuffle(b)
        b = b or [1]
        table = np.zeros((len(a) + 1, len(b) + 1), int)
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                table[i + 1, j + 1] = table[i, j] + 1 if x == y else max(table[i, j + 1], table[i + 1, j])
        c = table[-1, -1]
        want = 1 - c / (len(a) + len(b) - c)
        got = minhash_dedup.distance(np.array(a, np.uint64), np.array(b, np.uint64), 0.4)
        assert math.isclose(got, want) if want <= 0.4 else got == minhash_dedup.FAR


def test_near_duplicates(spark):
    rng = random.Random(7)
    words = ["".join(rng.choice("abcdefghij") for _ in range(5)) for _ in range(2000)]
    base = [[rng.choice(words) for _ in range(150)] for _ in range(40)]
    texts = [" ".join(b) for b in base]
    for i in range(10):  # near copies: one word changed
        w = list(base[i])
        w[rng.randrange(150)] = "changed"
        texts.append(" ".join(w))
    texts += [texts[3].upper(), "", None, "short text", "Short text!", "..."]
    shared = " ".join(rng.choice(words) for _ in range(60))
    texts += [shared + " " + " ".join(rng.choice(words) for _ in range(60)) for _ in range(12)]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(2, texts[2]), (None, "x")], DOCS)
    out = minhash_dedup.near_duplicates(docs)
    assert out.count() == docs.count()
    out = rows(out, "doc_id")
    assert [out[40 + i]["component_id"] for i in range(10)] == list(range(10))
    assert out[50]["component_id"] == 3 and out[54]["component_id"] == 53
    assert all(out[i]["kept"] for i in (51, 52, 55, *range(56, 68)))
    kept = minhash_dedup.keep_first(docs)
    assert kept.columns == docs.columns and kept.count() == docs.count() - 12 - 1
    assert minhash_dedup.near_duplicates(docs.limit(0)).count() == 0


def test_residue_links_survive(spark):
    """Texts that chain away from their leader are linked through each other."""
    rng = random.Random(8)
    words = [f"w{i}" for i in range(100)]
    chain = [words[:]]
    for step in range(6):
        w = list(chain[-1])
        w[step * 2] = f"new{rng.random()}"
        chain.append(w)
    docs = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(chain)], DOCS)
    out = rows(minhash_dedup.near_duplicates(docs, block=2), "doc_id")
    assert {r["component_id"] for r in out.values()} == {0}


def test_classes_equal_brute_force(spark):
    """Families that drift around the threshold, and texts that share a passage only."""
    rng = random.Random(9)
    words = [f"w{i}" for i in range(5000)]
    passage = [rng.choice(words) for _ in range(70)]
    texts = []
    for _ in range(6):
        base = [rng.choice(words) for _ in range(100)]
        for _ in range(14):
            w = list(base)
            for at in rng.sample(range(100), rng.randint(0, 3)):
                w[at] = rng.choice(words)
            texts.append(w)
    texts += [passage + [rng.choice(words) for _ in range(30)] for _ in range(30)]
    shingles = []
    for w in texts:
        seen, own = Counter(), []
        for i in range(len(w) - 4):
            gram = tuple(w[i : i + 5])
            own.append(hash((gram, seen[gram])) & (1 << 64) - 1)
            seen[gram] += 1
        shingles.append(np.array(own, np.uint64))
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            if minhash_dedup.distance(shingles[i], shingles[j], 0.2) <= 0.2:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    docs = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(texts)], DOCS)
    out = rows(minhash_dedup.near_duplicates(docs, block=16), "doc_id")
    assert [out[i]["component_id"] for i in range(len(texts))] == [find(i) for i in range(len(texts))]
    assert len({find(i) for i in range(84, len(texts))}) == 30
