"""The five-stage pipeline against plain Python, stage after stage."""

import hashlib
import random
import re
from collections import Counter

import corpus_pipeline
import numpy as np
import pytest
import sentencepiece
from lagspark.llm.common import tokenizer_path

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def lines_dropped(rows):
    """Rows without the lines on over a tenth, and at least five, of their source's pages."""
    pages, held = Counter(r[3] for r in rows), Counter()
    for r in rows:
        for line in {x.strip(" \t\r") for x in (r[1] or "").split("\n")} - {""}:
            held[r[3], line] += 1
    out = []
    for i, text, lang, source, _ in rows:
        gone = lambda x: held[source, x.strip(" \t\r")] >= 5 and held[source, x.strip(" \t\r")] / pages[source] > 0.1
        kept = "\n".join(x for x in text.split("\n") if not gone(x))
        out.append((i, kept, lang, source, len(kept)))
    return out


def shingles(text):
    words = re.findall(r"\w+", text.lower())
    seen, out = Counter(), []
    for i in range(max(1, len(words) - 4) if words else 0):
        gram = tuple(words[i : i + 5])
        out.append((gram, seen[gram]))
        seen[gram] += 1
    return out


def common(a, b):
    table = np.zeros((len(a) + 1, len(b) + 1), int)
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            table[i + 1, j + 1] = table[i, j] + 1 if x == y else max(table[i, j + 1], table[i + 1, j])
    return table[-1, -1]


def firsts(rows):
    """The row of the smallest id of each class of near duplicates."""
    own = {r[0]: shingles(r[1]) for r in rows}
    root = {i: i for i in own}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in own:
        for j in own:
            if i < j and own[i] and own[j] and set(own[i]) & set(own[j]):
                c = common(own[i], own[j])
                if c / (len(own[i]) + len(own[j]) - c) >= 0.8:
                    a, b = sorted((find(i), find(j)))
                    root[b] = a
    return [r for r in rows if find(r[0]) == r[0]]


@pytest.fixture(scope="module")
def documents():
    rng = random.Random(12)
    make = {"aa": "abcde", "bb": "mnopq"}
    rows = []

    def add(text, lang, source):
        rows.append((len(rows) * 3, text, lang, source, len(text or "")))

    for n in range(36):
        lang = "ab"[n % 2] * 2
        body = " ".join("".join(rng.choice(make[lang]) for _ in range(4)) for _ in range(60))
        add(f"Sign up here\n{body}\n\n  Sign up here \nend {n}", lang, "site" if n % 3 else "other")
    for n in range(8):  # near copies, and exact ones on another site
        text = rows[n][1]
        at = text.rindex(" ", 0, text.rindex("\n\n"))
        add(text[:at] + " changed" + text[at + 5 :], None, "site")
        add(text, None, None)
    for text in (None, "", "  ", "12 34 .. !", "x", "Sign up here"):
        add(text, None, "site")
    return rows


def written(spark, folder, rows):
    spark.createDataFrame(rows, COLUMNS).write.parquet(f"{folder}/documents.parquet")
    return str(folder)


def test_stages_in_order():
    names = ["language_id", "line_dedup", "minhash_dedup", "mixing", "sentencepiece"]
    assert [name for name, _ in corpus_pipeline.STAGES] == names


def test_run_equals_plain_python(spark, documents, tmp_path):
    folder = written(spark, tmp_path, documents)
    named = [r for r in documents if re.search(r"[^\W\d_]", r[1] or "")]
    plain = lines_dropped(named)
    once = firsts(plain)
    assert len(documents) > len(named) > len(once) and plain != named
    library = sentencepiece.SentencePieceProcessor(model_file=tokenizer_path("piece_bpe_32k.model"))
    want = {}
    for r in once:
        ids = library.encode(r[1], add_bos=True, add_eos=True)
        digest = hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        want[r[0]] = (len(ids), ids, digest, hashlib.sha256(library.decode(ids).encode()).hexdigest())
    got = corpus_pipeline.run(spark, folder).collect()
    assert len(got) == len(want)
    assert {r["doc_id"]: (r["n_tokens"], list(r["ids"]), r["ids_sha256"], r["decoded_sha256"]) for r in got} == want


def test_stages_keep_columns_and_sources(spark, documents, tmp_path):
    folder = written(spark, tmp_path, documents)
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    mixed = corpus_pipeline.mix_sources(spark, docs, folder)
    key = lambda r: (r[0], str(r))
    assert sorted(map(tuple, mixed.collect()), key=key) == sorted(documents, key=key)
    sizes = {}
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, folder)
        assert out.columns == docs.columns
        sizes[stage.__name__] = out.count()
    assert sizes["mix_sources"] == sizes["drop_boilerplate_lines"] == len(documents)


def test_run_on_no_documents(spark, tmp_path):
    assert corpus_pipeline.run(spark, written(spark, tmp_path, [])).count() == 0
