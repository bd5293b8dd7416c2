"""The pipeline on a small corpus, stage by stage and as a whole, against plain loops over the five stages."""

import random
import zlib

import corpus_pipeline
import numpy as np
import public_tokenizers
import pytest

from fleetfold.llm import toxicity
from tests.llm.test_mixing import brute as brute_mix
from tests.llm.test_near import brute_components, edited

SCHEMA = "doc_id LONG, text STRING, lang STRING, source STRING, n_chars LONG"
ITEMS = [" ".join(f"q{k}x{i}" for i in range(25)) for k in range(3)]


def rows():
    rng = random.Random(12)
    words = lambda n: [f"w{rng.randrange(3000)}" for _ in range(n)]
    out = []
    for i in range(60):
        text = words(rng.randint(30, 120))
        if i % 5 == 0:
            text.insert(3, "vilegrim")
        if i % 7 == 3:
            text[10:10] = ITEMS[i % 3].split()
        out.append((i, " ".join(text)))
        if i % 6 == 1:
            out.append((100 + i, " ".join(text)))
        if i % 6 == 2:
            out.append((200 + i, " ".join(edited(rng, text, 1))))
    out += [(300, None), (301, ""), (302, " \n"), (None, "no id here at all"), (303, "same"), (303, "same"), (304, "Ümläut, ﬁne İ, ok."), (1, out[1][1])]
    rng.shuffle(out)
    return [(i, t, "en", f"s{zlib.crc32(str(i).encode()) % 3}" if i != 304 else None, len(t or "")) for i, t in out]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("sf"))
    docs = rows()
    spark.createDataFrame(docs, SCHEMA).repartition(3).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(d[0], 1, int("vilegrim" in (d[1] or ""))) for d in docs if d[0] is not None and d[0] < 100], "doc_id LONG, quality INT, toxic INT").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame(list(enumerate(ITEMS)), "item_id LONG, text STRING").write.parquet(f"{path}/benchmark.parquet")
    return path


def key(row):
    return (row[0] is None, row[0] or 0, row[1] or "")


def brute_toxic(spark, path, docs):
    """Scores by a loop over features and the trained weights; training itself is tested elsewhere."""
    chain, thresholds = toxicity.train(spark.read.parquet(f"{path}/documents.parquet"), spark.read.parquet(f"{path}/labels.parquet"), toxicity.given_categories())
    names = list(toxicity.given_categories())

    def probability(text):
        given = {}
        for name, weights in zip(names, chain):
            total = weights.get("", 0.0) + sum(weights.get(f, 0.0) for f in toxicity.features(text)) + sum(weights.get(f"\0{n}", 0.0) * p for n, p in given.items())
            given[name] = 1 / (1 + np.exp(-np.clip(total, -30, 30)))
        return given["toxic"]

    return [d for d in docs if probability(d[1]) < thresholds["toxic"]]


def brute_near(docs):
    texts = [d[1] for d in docs]
    root = brute_components(texts)
    order = lambda i: (docs[i][0] is None, docs[i][0] or 0)
    return [docs[min((i for i, r in enumerate(root) if r == c), key=order)] for c in sorted(set(root))]


def brute_clean(docs):
    return [d for d in docs if not any(item in (d[1] or "") for item in ITEMS)]


def brute_mixed(docs):
    return [d for d, n in zip(docs, brute_mix([(d[0], d[1], d[3]) for d in docs])) for _ in range(n)]


def brute_tokens(docs):
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    out, start = [], 0
    for d in sorted(docs, key=lambda d: (d[0] is not None, d[0] or 0)):
        ids = [*own.encode(d[1] or "", add_special_tokens=False).ids, 1]
        out.append((d[0], start, len(ids), zlib.crc32(np.array(ids, dtype="<u4").tobytes())))
        start += len(ids)
    return out


def test_stages_and_run_equal_plain_loops(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    plain = [tuple(r) for r in docs.collect()]
    want = {
        "toxicity": lambda d: brute_toxic(spark, folder, d), "near-duplicates": brute_near, "decontamination": brute_clean, "mixing": brute_mixed,
    }
    for name, stage in corpus_pipeline.STAGES[:-1]:
        got = stage(spark, docs, folder)
        assert got.columns == docs.columns
        found = sorted(map(tuple, got.collect()), key=key)
        plain = want[name](plain)
        assert [f[:2] for f in found] == [p[:2] for p in sorted(plain, key=key)], name
        assert 0 < len(found) and (name == "mixing" or len(found) < docs.count())
        docs = spark.createDataFrame(found, SCHEMA)
        plain = found
    tokens = [(r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in corpus_pipeline.STAGES[-1][1](spark, docs, folder).collect()]
    assert sorted(tokens, key=lambda r: r[1]) == brute_tokens(plain)
    run = [(r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in corpus_pipeline.run(spark, folder).collect()]
    assert sorted(run, key=lambda r: r[1]) == sorted(tokens, key=lambda r: r[1])


def test_every_stage_takes_an_empty_table(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet").limit(0)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, folder).count() == 0, name
