"""The pipeline against each of its stages written plainly, on a small table with nulls, copies, long and empty texts."""

import collections
import hashlib
import random
import re

import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from rondo.llm import compression
from rondo.llm.common import cut, fold, table

from .test_text_operators import WORD, fold_case, prose

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, row string, rank long"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    r = random.Random(21)
    words = [f"word{k}" for k in range(300)]
    item = prose(r, 14, words=words)
    verse = "\n".join(prose(r, 5, words=words) for _ in range(6))
    good = [prose(r, 90, words=words) + "." for _ in range(60)]
    bad = ["".join(r.choice("XQZ!#$ 0189") for _ in range(500)) for _ in range(40)]
    texts = [*good, *bad, None, "", " \n", good[0], good[0], prose(r, 30) + f"\n{verse}\nend one", f"begin two\n{verse}\n" + prose(r, 30)]
    near = good[3].split()
    near[40] = "changed"
    texts += [" ".join(near), f"{prose(r, 40, words=words)} {item.upper()} {prose(r, 40, words=words)}", item, "\n".join(prose(r, 100, words=words) for _ in range(60))]
    rows = [(k, t, "en", f"s{k % 4}", None if t is None else len(t), "x", k) for k, t in enumerate(texts)]
    rows += [(None, good[5] + " of no id", "en", None, 3, "x", 0), (7, good[7], "en", "s3", 3, "x", 0), (7, prose(r, 60, words=words), "en", "s3", 3, "x", 0)]
    out = tmp_path_factory.mktemp("tables")
    spark.createDataFrame(rows, COLUMNS).repartition(3).write.parquet(f"{out}/documents.parquet")
    spark.createDataFrame([(k, int(k < 60), 0) for k in range(100)], "doc_id long, quality int, toxic int").write.parquet(f"{out}/labels.parquet")
    spark.createDataFrame([(1, item), (2, None), (3, "")], "item_id long, text string").write.parquet(f"{out}/benchmark.parquet")
    return str(out), rows, item


def without_repeated_lines(rows):
    """Later copies of runs of lines of 120 characters or more go, and rows that lose every word."""
    first, out = {}, []
    for row in sorted((x for x in rows if x[0] is not None and x[1] is not None), key=lambda x: x[0]):
        own = row[1].split("\n")
        for i in range(len(own)):
            size = 0
            for e in range(i, min(len(own), i + 40)):
                size += len(own[e])
                if size >= 120:
                    first.setdefault(tuple(own[i : e + 1]), (row[0], i))
                    break
    for row in rows:
        if row[0] is None or row[1] is None:
            out.append(row)
            continue
        own, gone = row[1].split("\n"), set()
        for i in range(len(own)):
            for e in range(i, min(len(own), i + 40)):
                if sum(map(len, own[i : e + 1])) >= 120 and first.get(tuple(own[i : e + 1]), (row[0], i)) < (row[0], i):
                    gone |= set(range(i, e + 1))
        text = "\n".join(x for i, x in enumerate(own) if i not in gone)
        if not gone:
            out.append(row)
        elif re.search(WORD, text):
            out.append((row[0], text, *row[2:4], len(text), *row[5:]))
    return out


def shingles(text):
    w = re.findall(WORD, fold_case(text))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def groups(rows):
    sets = [shingles(x[1]) for x in rows]
    up = list(range(len(rows)))
    for _ in range(3):
        for i in range(len(rows)):
            for j in range(i):
                if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                    up[i] = up[j] = min(up[i], up[j])
    return [up[k] if sets[k] else -1 - k for k in range(len(rows))]


def key(x):
    return (x[0] is None, x[0] or 0, x[1] or "", str(x[2:]))


def test_stages_and_run(spark, folder):
    path, rows, item = folder
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["quality classifier", "line dedup", "n-gram Jaccard join", "benchmark decontamination", "BPE encoding and decoding"]
    docs = table(spark, path, "documents")

    score = compression.fit(docs, table(spark, path, "labels"), "quality", fold("doc_id", 5) != 0).scorer()
    want = [x for x in rows if score([(x[1] or "").encode()])[0] >= 0.3]
    assert 60 < len(want) < len(rows)
    now = stages["quality classifier"](spark, docs, path)
    assert now.columns == docs.columns
    assert sorted(map(tuple, now.collect()), key=key) == sorted(want, key=key)

    want = without_repeated_lines(want)
    now = cut(stages["line dedup"](spark, cut(now), path))
    assert now.columns == docs.columns
    assert sorted(map(tuple, now.collect()), key=key) == sorted(want, key=key)

    now = cut(stages["n-gram Jaccard join"](spark, now, path))
    kept = sorted(map(tuple, now.collect()), key=key)
    assert now.columns == docs.columns and set(kept) <= set(want)
    assert {groups(want)[want.index(x)] for x in kept} == set(groups(want)) and len(kept) == len(set(groups(want)))

    now = cut(stages["benchmark decontamination"](spark, now, path))
    assert now.columns == docs.columns
    clean = {key(x)[:2]: x for x in map(tuple, now.collect())}
    told = item.split()
    for x in kept:
        w = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", fold_case(x[1]))
        hit = any(w[i : i + 10] == told[j : j + 10] for i in range(len(w) - 9) for j in range(len(told) - 9))
        if not hit and x[0] != 7:
            assert clean[key(x)[:2]] == x
    assert not any(" ".join(told[2:12]) in fold_case(x[1]) for x in clean.values())

    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    last = stages["BPE encoding and decoding"](spark, now, path).collect()
    assert len(last) == now.count()
    texts = collections.Counter((x[0], tuple(library.encode(x[1] or "", add_special_tokens=False).ids)) for x in map(tuple, now.collect()))
    assert collections.Counter((x.doc_id, tuple(x.ids)) for x in last) == texts
    for x in last:
        assert x.n_tokens == len(x.ids) and x.decoded_sha256 == hashlib.sha256(library.decode(x.ids, skip_special_tokens=False).encode()).hexdigest()



def test_empty_documents(spark, folder, tmp_path):
    path, _, _ = folder
    table(spark, path, "documents").where("false").write.parquet(f"{tmp_path}/documents.parquet")
    for name in ("labels", "benchmark"):
        table(spark, path, name).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
